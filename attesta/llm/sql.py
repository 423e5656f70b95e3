"""DuckDB SQL of operators that SQL can express."""

OP9 = r"""
with d as (select doc_id, coalesce(text, '') as t, row_number() over () as rid from documents),
w as (select rid, generate_subscripts(ws, 1) as i, unnest(ws) as word from (select rid, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as ws from d)),
g as (select rid, i, word, case when lead(word, 4) over o is not null then [word, lead(word, 1) over o, lead(word, 2) over o, lead(word, 3) over o, lead(word, 4) over o] end as gram from w window o as (partition by rid order by i)),
r as (select rid, i, gram is not null and count(*) over (partition by rid, gram) > 1 as again from g),
m as (select rid, max(again::int) over (partition by rid order by i rows between 4 preceding and current row) as hit from r),
rep as (select rid, sum(hit)::bigint as n_repeat_words from m group by rid),
wc as (select rid, count(*) as n_words, sum(length(word))::bigint as word_chars from w group by rid),
l as (select rid, generate_subscripts(ls, 1) as i, unnest(ls) as line from (select rid, string_split(t, chr(10)) as ls from d)),
k as (select rid, i, line, regexp_extract_all(line, '[^\x20\x09-\x0D]+') as lw from l),
f as (select rid, i, row_number() over (partition by rid, line order by i) > 1 as dup, len(lw) as words, length(array_to_string(lw, '')) as chars, lw[len(lw)] as tail,
        len(regexp_extract_all(line, '[#*$%&|<>]')) as symbols, len(regexp_extract_all(line, '!')) as bangs, len(regexp_extract_all(line, '\|')) + len(list_filter(lw, lambda x: x in ('/', '>', '»', '›', '•', '·'))) as seps,
        len(list_filter(lw, lambda x: x in ('/', '>', '»', '›', '•', '·', '|', '-', '*', '–', '—'))) as bullets, regexp_matches(line, '[.,;:!?…。！？、，；：؟،।]') as marked,
        length(array_to_string(list_filter(lw, lambda x: regexp_matches(x, '^([hH][tT][tT][pP][sS]?://|[wW][wW][wW]\.)')), '')) as link_chars,
        regexp_matches(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), 'accept all cookies|all rights reserved|back to top|click here to|cookie policy|enable javascript|log in to comment|privacy policy|share this article|sign up for our newsletter|skip to content|subscribe to our newsletter|terms of use|this site uses cookies|we use cookies|alle cookies akzeptieren|alle rechte vorbehalten|diese website verwendet cookies|hier klicken, um|javascript aktivieren|newsletter abonnieren|nutzungsbedingungen|wir verwenden cookies|zum inhalt springen|accepter tous les cookies|activer javascript|ce site utilise des cookies|cliquez ici pour|inscrivez-vous à notre newsletter|mentions légales|nous utilisons des cookies|politique de confidentialité|tous droits réservés|aceptar todas las cookies|aviso legal|este sitio utiliza cookies|haga clic aquí para|política de privacidad|suscríbete a nuestro boletín|términos de uso|todos los derechos reservados|utilizamos cookies') as phrase
      from k where len(lw) > 0),
sh as (select *, words - bullets <= 3 and not regexp_matches(tail, '[.,;:!?…。！？、，；：؟،।"'')\]}»”’]$') as short from f),
ru as (select *, row_number() over (partition by rid order by i) - row_number() over (partition by rid, short order by i) as run from sh),
ju as (select rid, dup, chars, 4 * symbols > chars or (words >= 5 and 2 * bangs >= words) or regexp_matches(tail, '(\.\.\.|…)$') or (words >= 30 and not marked) as punctuation,
        (seps >= 3 and 4 * seps >= words) or (seps >= 2 and 3 * seps >= words) or 2 * link_chars >= chars or (short and count(*) over (partition by rid, short, run) >= 4) as navigation, dup or phrase as boilerplate
      from ru),
lines as (select rid, count(*) filter (where dup) as n_dup_lines, count(*) filter (where punctuation) as n_punctuation_lines, count(*) filter (where navigation) as n_navigation_lines,
        count(*) filter (where boilerplate) as n_boilerplate_lines, coalesce(sum(chars) filter (where punctuation or navigation or boilerplate), 0)::bigint as lost_chars from ju group by rid),
a as (select d.doc_id, coalesce(n_words, 0) as n_words, coalesce(word_chars, 0) as word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) as n_symbols, coalesce(n_dup_lines, 0) as n_dup_lines,
        coalesce(n_punctuation_lines, 0) as n_punctuation_lines, coalesce(n_navigation_lines, 0) as n_navigation_lines, coalesce(n_boilerplate_lines, 0) as n_boilerplate_lines,
        coalesce(n_repeat_words, 0) as n_repeat_words, coalesce(lost_chars, 0) as lost_chars
      from d left join wc using (rid) left join rep using (rid) left join lines using (rid)),
b as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed from a)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and 100 * lost_chars <= 50 * word_chars as kept, lost_chars,
  n_punctuation_lines, n_navigation_lines, n_boilerplate_lines from b
"""

OP7 = r"""
with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as (select distinct doc_id, case when len(w) >= 5 then array_to_string(w[i:i + 4], ' ') else array_to_string(w, ' ') end as g
      from (select doc_id, w, unnest(generate_series(1, greatest(1, len(w) - 4))) as i from d where len(w) > 0)),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (select a.doc_id as a, b.doc_id as b, count(*) as shared from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
links as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * shared >= 75 * (x.n + y.n - shared)),
e as (select a, b from links union select b, a from links),
reach(a, b) as (select a, b from e union select reach.a, e.b from reach join e on reach.b = e.a),
root as (select a, min(b) as b from reach group by a)
select d.doc_id, coalesce(n.n, 0) as n_shingles, least(d.doc_id, coalesce(root.b, d.doc_id)) as component_id from d left join n using (doc_id) left join root on root.a = d.doc_id
"""
