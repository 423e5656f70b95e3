"""Text, HTML, date and URL queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from attesta.functions import places, scalar, tables, text
from attesta.operators import filters, phrases, providers
from attesta.session import small_batches
from attesta.sources.tables import if_small, load

from .registry import query

TERMS = [("the and",), ("of the",), ("que de",), ("die der",), ("license",), ("apache license",)]


@query(
    "term_match",
    r"""
with t as (select unnest(['the and', 'of the', 'que de', 'die der', 'license', 'apache license']) as term)
select d.doc_id, t.term from documents d, t where ' ' || array_to_string(regexp_extract_all(lower(d.text), '[\p{L}\p{N}_]+'), ' ') || ' ' like '% ' || t.term || ' %'
""",
)
def term_match(spark, sf_dir):
    d = load(spark, sf_dir, "documents").select("doc_id", "text")
    return d.select("doc_id", F.explode(text.listed_terms(F.col("text"), [t for (t,) in TERMS])).alias("term"))


@query(
    "term_dictionary",
    r"""
with t as (select distinct lower(regexp_extract(text, '[\p{L}\p{N}_]+ [\p{L}\p{N}_]+')) as term from benchmark)
select d.doc_id, t.term from documents d join t on t.term <> '' and contains(' ' || array_to_string(regexp_extract_all(lower(d.text), '[\p{L}\p{N}_]+'), ' ') || ' ', ' ' || t.term || ' ')
""",
)
def term_dictionary(spark, sf_dir):
    """Terms of a dictionary that is a table."""
    d = load(spark, sf_dir, "documents").select("doc_id", "text")
    first = F.lower(F.regexp_extract("text", r"[\p{L}\p{N}_]+ [\p{L}\p{N}_]+", 0))
    return phrases.dictionary_matches(d, "text", load(spark, sf_dir, "benchmark").select(first.alias("term")), "term", keep=["doc_id"]).select("doc_id", "term")


@query(
    "term_dictionary_marks",
    r"""
with t as (select distinct lower(array_to_string(string_split(regexp_replace(trim(text), '\s+', ' ', 'g'), ' ')[3:5], ' ')) as term from benchmark),
d as (select doc_id, lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) as text from documents)
select doc_id, term from d join t on contains(text, term) and term <> '' and regexp_matches(text, '(^|[^\p{L}\p{N}_])' || regexp_escape(term) || '($|[^\p{L}\p{N}_])')
""",
)
def term_dictionary_marks(spark, sf_dir):
    """Terms with their marks, at the ends of words of the normalised text."""
    d = load(spark, sf_dir, "documents").select("doc_id", "text")
    words = F.split(F.trim(F.regexp_replace("text", r"\s+", " ")), " ")
    terms = load(spark, sf_dir, "benchmark").select(F.lower(F.array_join(F.slice(words, 3, 3), " ")).alias("term"))
    return phrases.dictionary_matches(d, "text", terms, "term", words=False, keep=["doc_id"]).select("doc_id", "term")


@query("word_boundary_match", r"select doc_id from documents where regexp_matches(lower(text), '(^|[^0-9A-Za-z_])mit license([^0-9A-Za-z_]|$)')")
def word_boundary_match(spark, sf_dir):
    return load(spark, sf_dir, "documents").where(text.has_term(F.col("text"), "MIT License")).select("doc_id")


@query("quote_grounding", "select b.item_id, d.doc_id from benchmark b join documents d on contains(d.text, b.text)")
def quote_grounding(spark, sf_dir):
    """Benchmark items that are exact parts of documents."""
    b = load(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text")
    d = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return phrases.grounded_quotes(b, d).select(F.col("quote").alias("item_id"), F.col("source").alias("doc_id")).distinct()


GAP, LETTER = r"[^\p{L}\p{N}_]+", r"[\p{L}\p{N}_]"
#: Words 4 to 15 of each benchmark item, in lower case, with single blanks.
QUOTES = rf"select item_id, array_to_string(list_transform(regexp_extract_all(text, '{LETTER}+')[4:15], lambda w: lower(w)), ' ') as said from benchmark"


@query(
    "quote_repair",
    rf"""
with q as ({QUOTES}), w as (select item_id, said, regexp_extract_all(said, '{LETTER}+') as words from q),
r as (select item_id, doc_id, said, text, case when contains(text, said) then said else regexp_extract(text, '(?i)(?:^|[^\p{{L}}\p{{N}}_])(' || array_to_string(words, '{GAP}') || ')(?:$|[^\p{{L}}\p{{N}}_])', 1) end as repaired
 from w join documents on len(words) >= 3)
select item_id, doc_id, repaired, strpos(text, repaired) - 1 as start, contains(text, said) as exact from r where repaired <> ''
""",
)
def quote_repair(spark, sf_dir):
    """Fragments of benchmark items without marks and capitals, in the wording of the documents that hold them."""
    words = F.slice(F.regexp_extract_all("text", F.lit(LETTER + "+"), 0), 4, 12)
    b = load(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.array_join(F.transform(words, F.lower), " ").alias("text"))
    d = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    got = phrases.repaired_quotes(b, d)
    return got.select(F.col("quote").alias("item_id"), F.col("source").alias("doc_id"), "repaired", "start", "exact")


@query("normalized_digest", r"select doc_id, sha256(lower(trim(regexp_replace(text, '[ \t\n\r\f\v]+', ' ', 'g')))) as digest from documents")
def normalized_digest(spark, sf_dir):
    d = load(spark, sf_dir, "documents")
    return d.select("doc_id", F.sha2(text.normalized_ascii(F.col("text")), 256).alias("digest"))


@query("normalized_casefold", r"select doc_id, sha256(trim(regexp_replace(replace(lower(nfc_normalize(text)), 'ß', 'ss'), '[ \t\n\r\f\v]+', ' ', 'g'))) as digest from documents")
def normalized_casefold(spark, sf_dir):
    """NFKC and case folding, by an Arrow UDF."""
    small_batches(spark)
    return load(spark, sf_dir, "documents").select("doc_id", F.sha2(text.normalized("text"), 256).alias("digest"))


@query("short_content_id", "select page_id, substr(sha256(url), 1, 20) as id, regexp_replace(url, '/+$', '') as canonical from pages")
def short_content_id(spark, sf_dir):
    p = load(spark, sf_dir, "pages")
    return p.select("page_id", scalar.short_id(F.col("url")).alias("id"), scalar.canonical_url(F.col("url")).alias("canonical"))


@query(
    "alias_merge",
    r"""
with p as (select page_id, regexp_extract(url, '://(?:www\.|m\.|blog\.)?([^/?#]+)', 1) as site, length(html) % 3 as priority, regexp_extract(url, '://([^/?#]+)', 1) as alias from pages),
b as (select *, row_number() over (partition by site order by priority desc, page_id) as rn from p), a as (select site, string_agg(distinct alias, ',' order by alias) as aliases from p group by site)
select b.site, b.page_id, a.aliases from b join a using (site) where rn = 1
""",
)
def alias_merge(spark, sf_dir):
    from attesta.operators.latest import merge_aliases

    p = load(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", r"://(?:www\.|m\.|blog\.)?([^/?#]+)", 1).alias("site"), (F.length("html") % 3).alias("priority"), F.array(F.regexp_extract("url", r"://([^/?#]+)", 1)).alias("aliases"))
    got = merge_aliases(p, "site", "priority", "page_id", "aliases")
    return got.select("site", "page_id", F.array_join("aliases", ",").alias("aliases"))


@query("main_text")
def main_text(spark, sf_dir):
    p = load(spark, sf_dir, "pages")
    return p.select("page_id", text.main_text()("html").alias("main"))


@query("html_links", r"select page_id, unnest(regexp_extract_all(html, '(?i)<(?:a|link)\s[^>]*?href=[\x22\x27]([^\x22\x27]+)', 1)) as link from pages")
def html_links(spark, sf_dir):
    return load(spark, sf_dir, "pages").select("page_id", F.explode(text.links(F.col("html"))).alias("link"))


@query(
    "article_text",
    """
with x as (select c_custkey as k, ['US', 'CA', 'RO', 'SI', 'CN', 'SM', 'HU', 'ZZ', 'HR', 'DE', 'VA'][c_custkey % 11 + 1] as c, c_name || repeat(' word', cast(c_custkey // 11 % 30 as integer)) as body from customer),
y as (select *, case c when 'SI' then 'lead ' || body when 'HR' then 'lead ' || body when 'SM' then 'kept ' || body when 'ZZ' then case when length('kept ' || body) > 100 then 'kept ' || body else body end else body end as t from x),
z as (select *, case when c = 'CN' and k % 5 = 0 then 'attachment notice' when length(t) < (case c when 'CA' then 80 when 'CN' then 80 when 'ZZ' then 0 else 40 end) and c <> 'RO' then 'no usable article body' end as fault from y)
select k as c_custkey, case when fault is null then case when c = 'RO' and length(t) < 40 then '' else t end end as article, fault from z
""",
)
def article_text(spark, sf_dir):
    """One page a customer, in the form of its source."""
    k = F.col("c_custkey")
    codes = ["US", "CA", "RO", "SI", "CN", "SM", "HU", "ZZ", "HR", "DE", "VA"]
    code = F.element_at(F.array(*map(F.lit, codes)), (k % 11 + 1).cast("int"))
    body = F.concat("c_name", F.repeat(F.lit(" word"), (F.floor(k / 11) % 30).cast("int")))
    wrap = {
        "US": ('<div class="a wp-block-post-content">', "</div>"),
        "CA": ('<div class="news-release-container"><p class="teaser hidden">no</p>', "<p> Contacts me</p></div>"),
        "RO": ('<p id="pageDescription">', "</p>"),
        "SI": ('<p class="intro">early</p><main><p class="intro">lead</p><div class="content-blocks">', "</div></main>"),
        "CN": ('<div class="Artical_Content">', "</div>"),
        "SM": ("<main>", "</main>"),
        "HU": ("<nav>x</nav><main>", "<script>y</script></main>"),
        "ZZ": ("<main>", "</main>"),
        "HR": ('<p class="article-intro">lead</p><div class="article-content">', "</div>"),
        "DE": ('<p class="bpa-richtext">early</p><div id="rs_reading_area_content"><div class="bpa-richtext">', "</div></div>"),
        "VA": ('<div itemprop="articleBody" class="z">', "</div><div>more</div>"),
    }
    part = lambda n: F.element_at(F.array(*(F.lit(wrap[c][n]) for c in codes)), (k % 11 + 1).cast("int"))
    notice = F.when((code == "CN") & (k % 5 == 0), F.lit(" Please see attachment for the full text")).otherwise("")
    pages = load(spark, sf_dir, "customer").select("c_custkey", code.alias("source"), F.concat(part(0), body, notice, part(1)).alias("html"), F.concat(F.lit("kept "), body).alias("stored"))
    return text.article_text(pages, fallback=100).select("c_custkey", "article", "fault")


@query(
    "long_text_chunks",
    """
with recursive d as (select doc_id, text as t, length(text) as n from documents where n_chars > 6000),
c as (select doc_id, 0 as part, 0::bigint as a, e from (select doc_id, 0::bigint as a, case when n > 6000 then coalesce(nullif(3000 + 3000 - strpos(reverse(substr(t, 3001, 3000)), ' '), 6000), 6000) else n end as e from d)
 union all select doc_id, part + 1, e, case when n > e + 6000 then case when strpos(reverse(substr(t, e + 3001, 3000)), ' ') > 0 then e + 6000 - strpos(reverse(substr(t, e + 3001, 3000)), ' ') else e + 6000 end else n end from c join d using (doc_id) where e < n)
select doc_id, part, length(regexp_replace(substr(t, a + 1, e - a), '^\\s+|\\s+$', '', 'g')) as n_chars from c join d using (doc_id)
""",
)
def long_text_chunks(spark, sf_dir):
    d = load(spark, sf_dir, "documents").where("n_chars > 6000")
    return d.select("doc_id", F.posexplode(text.chunks("text", F.lit(6000))).alias("part", "chunk")).select("doc_id", "part", F.length("chunk").alias("n_chars"))


@query("links_by_function", r"select page_id, unnest(regexp_extract_all(html, '(?i)<(?:a|link)\s[^>]*?href=[\x22\x27]([^\x22\x27]+)', 1)) as link from pages")
def links_by_function(spark, sf_dir):
    """``html_links`` through a table function in SQL."""
    tables.register(spark)
    return spark.sql("select p.page_id, l.link from {pages} p, lateral page_links(p.html) l", pages=load(spark, sf_dir, "pages"))


@query(
    "page_gaps",
    """
with r as (select distinct o_custkey % 50 as source, o_orderkey as page from orders), n as (select source, page, lead(page) over (partition by source order by page) as next from r)
select source::varchar as source, page as after, next from n where next > page + 1
""",
)
def page_gaps(spark, sf_dir):
    """Left out numbers within each partition of a TABLE argument."""
    tables.register(spark)
    o = load(spark, sf_dir, "orders").select((F.col("o_custkey") % 50).cast("string").alias("source"), F.col("o_orderkey").cast("long").alias("page"))
    return spark.sql("select * from page_gaps(table(select source, page from {o}) partition by source order by page)", o=o)


@query(
    "provider_labels",
    """
with a as (select doc_id, case when regexp_matches(text, '(?i)licen[cs]e') then 'license' when regexp_matches(text, '@') then 'contact' else 'prose' end as kind, doc_id % 7 as r from documents)
select doc_id, case when r <> 3 then kind end as kind, case when r = 3 then 'pending' when kind = 'contact' and r = 5 or kind = 'prose' and r = 2 then 'rejected' else 'classified' end as status,
 case when r = 3 then '' else concat_ws(';', case when kind = 'contact' and r = 5 then 'contact of a closed source' end, case when kind = 'prose' and r = 2 then 'answered twice' end) end as errors from a
""",
)
def provider_labels(spark, sf_dir):
    """Labels of a provider that leaves items out, answers some twice and breaks a rule."""
    rules = providers.by_rules("kind", "prose", license="(?i)licen[cs]e", contact="@")

    def provider(items):
        got = rules(items)
        return got.where("id % 7 <> 3").union(got.where("id % 7 = 2 and kind = 'prose'"))

    d = load(spark, sf_dir, "documents").select("doc_id", "text")
    got = providers.labelled(d, "doc_id", F.col("text"), provider, {"contact of a closed source": ~((F.col("kind") == "contact") & (F.col("doc_id") % 7 == 5))})
    return got.select("doc_id", "kind", "status", F.array_join("errors", ";").alias("errors"))


#: Pairs of a quote and a document that a task counts at a time.
PAIRS = 1 << 20


@query(
    "excerpt_overlap",
    r"""
with q as (select item_id, unnest(list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'))) as w from benchmark),
d as (select doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'))) as w from documents),
s as (select item_id, doc_id, count(*) as shared from q join d using (w) group by 1, 2)
select item_id, doc_id, shared from (select *, row_number() over (partition by item_id order by shared desc, doc_id) as nth from s) where nth <= 2
""",
)
def excerpt_overlap(spark, sf_dir):
    """Best two excerpts per quote by shared words, through an inverted join on words.

    Documents are dealt out by id first, in parts of so many pairs with quotes, so pairs
    are counted where they arise and only a part's best two leave it.
    """
    from pyspark.sql import Window

    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}]+"), 0))
    quotes, docs = load(spark, sf_dir, "benchmark"), load(spark, sf_dir, "documents")
    parts = max(spark.sparkContext.defaultParallelism, -(-docs.count() * quotes.count() // PAIRS))
    q = if_small(quotes.select("item_id", F.explode(words).alias("w")), 64)
    d = docs.select("doc_id", words.alias("ws")).repartition(parts, "doc_id").select("doc_id", F.explode_outer("ws").alias("w"))
    shared = d.join(q, "w").groupBy("item_id", "doc_id").agg(F.count("*").alias("shared"))
    nth = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("shared"), "doc_id"))
    return shared.withColumn("nth", nth).where("nth <= 2").select("item_id", "doc_id", "shared")


@query("language_subtag", "select doc_id, lower(split_part(replace(case when doc_id % 5 = 0 then null else upper(lang) || '_XX' end, '_', '-'), '-', 1)) as tag, regexp_matches(text, '[\\p{L}\\p{N}]') as lexical from documents where doc_id % 5 <> 0 union all select doc_id, 'und', regexp_matches(text, '[\\p{L}\\p{N}]') from documents where doc_id % 5 = 0")
def language_subtag(spark, sf_dir):
    d = load(spark, sf_dir, "documents")
    tag = F.when(F.col("doc_id") % 5 != 0, F.concat(F.upper("lang"), F.lit("_XX")))
    return d.select("doc_id", scalar.primary_language(tag).alias("tag"), (~scalar.nonlexical(F.col("text"))).alias("lexical"))


@query("country_cues", r"select n.n_nationkey, string_agg(case when regexp_matches(lower(r.r_name), '(^|[^a-z])' || k || '($|[^a-z])') then k end, ',' order by k) as cues from nation n join region r on n.n_regionkey = r.r_regionkey, (values ('africa'), ('america'), ('asia'), ('europe')) v(k) group by n.n_nationkey having count(case when regexp_matches(lower(r.r_name), '(^|[^a-z])' || k || '($|[^a-z])') then k end) > 0")
def country_cues(spark, sf_dir):
    n = load(spark, sf_dir, "nation").join(F.broadcast(load(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    codes = places.cues(F.col("r_name"), {k: [k] for k in ("africa", "america", "asia", "europe")})
    return n.select("n_nationkey", F.array_join(codes, ",").alias("cues")).where("cues <> ''")


TITLES = ["Things to  do in Rome", "A walking tour", "Viaje a Madrid", "Holiday plans", "Must-visit war museums", "", None]
ABOUT = ["", "the protesters came", "Élections in spring", "warm days"]


@query("travel_exclusion", "select o_orderkey, o_orderkey % 7 in (0, 1, 2) and o_orderkey // 7 % 4 in (0, 3) as excluded from orders")
def travel_exclusion(spark, sf_dir):
    k = F.col("o_orderkey")
    option = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (F.pmod(n, F.lit(len(values))) + 1).cast("int"))
    return load(spark, sf_dir, "orders").select("o_orderkey", filters.travel_only(option(TITLES, k), option(ABOUT, F.floor(k / 7))).alias("excluded"))


@query("map_projection", "select c_custkey, round((c_nationkey * 7 - 90 + 180) / 360.0, 6) as x, round(0.5 - ln(tan(0.7853981633974483 + radians(c_nationkey * 3 - 30) / 2)) / 6.283185307179586, 6) as y, round(sqrt(least(1, greatest(c_acctbal, 0) / 9000.0)), 6) as size from customer")
def map_projection(spark, sf_dir):
    c = load(spark, sf_dir, "customer")
    x, y = scalar.mercator(F.col("c_nationkey") * 3 - 30, F.col("c_nationkey") * 7 - 90)
    return c.select("c_custkey", F.round(x, 6).alias("x"), F.round(y, 6).alias("y"), F.round(scalar.marker_size(F.greatest(F.col("c_acctbal"), F.lit(0.0)), 9000.0), 6).alias("size"))


@query("effective_policy", "select event_id, case when ts >= timestamp '2024-01-20' then 'new' when ts >= timestamp '2024-01-10' then 'middle' else 'old' end as policy from events")
def effective_policy(spark, sf_dir):
    ev = load(spark, sf_dir, "events")
    return ev.select("event_id", scalar.effective_policy(F.col("ts"), [("2024-01-20", "new"), ("2024-01-10", "middle")], "old").alias("policy"))


@query("local_days", "select event_id, (ts + interval 1 hour)::date as local_day from events")
def local_days(spark, sf_dir):
    """Amsterdam days; January has no clock change."""
    return load(spark, sf_dir, "events").select("event_id", scalar.local_day(F.col("ts")).alias("local_day"))


@query(
    "topic_codes",
    "select p_partkey, array_to_string(list_distinct(list_filter([p_type, split_part(p_name, ' ', 1), case when p_size % 2 = 0 then p_type end], lambda t: t is not null and t <> '')), ',') is not null as has_topics, len(list_distinct(list_filter([p_type, split_part(p_name, ' ', 1), case when p_size % 2 = 0 then p_type end], lambda t: t is not null and t <> ''))) as n from part",
)
def topic_codes(spark, sf_dir):
    p = load(spark, sf_dir, "part")
    codes = scalar.topic_codes(F.lit(None).cast("array<string>"), F.col("p_type"), F.array(F.split("p_name", " ")[0], F.when(F.col("p_size") % 2 == 0, F.col("p_type"))))
    return p.select("p_partkey", codes.isNotNull().alias("has_topics"), F.size(codes).alias("n"))


@query(
    "error_categories",
    """
select event_id, case event_id % 10 when 0 then 'source_url_changed_or_removed' when 1 then 'possible_access_restriction' when 2 then 'possible_service_outage' when 3 then 'possible_access_restriction'
 when 4 then 'tls_validation_failure' when 5 then 'dns_failure' when 6 then 'timeout_or_network_path' when 7 then 'connection_closed' when 8 then 'collector_or_page_format_changed' else 'unclassified_failure' end as category from events
""",
)
def error_categories(spark, sf_dir):
    option = lambda values: F.element_at(F.array(*map(F.lit, values)), (F.col("event_id") % 10 + 1).cast("int"))
    status = option([404, 403, 503, None, None, None, None, None, None, 302])
    message = option(["", "", "", "HTTP Error 429: too many", "bad certificate", "no name", "Read Timed out", "gone", "no cards", "moved"])
    kind = option(["", "", "", "", "tls", "dns", "", "closed", "format", ""])
    return load(spark, sf_dir, "events").select("event_id", scalar.error_category(status, message, kind).alias("category"))


@query("week_windows", "select distinct d - cast(dayofweek(d) as integer) - 7 as first_day, d - cast(dayofweek(d) as integer) as end_day, strftime(d - cast(dayofweek(d) as integer) - 1, '%G-W%V') as week from (select (ts + interval 1 hour)::date as d from events)")
def week_windows(spark, sf_dir):
    """Amsterdam weeks; January has no clock change."""
    start, end, week = scalar.week_window(F.col("ts"))
    return load(spark, sf_dir, "events").select(scalar.local_day(start).alias("first_day"), scalar.local_day(end).alias("end_day"), week.alias("week")).distinct()
