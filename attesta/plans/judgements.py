"""Label, comment, review and transcript checks: which rules each row breaks.

Rows are made from the tables by arithmetic on their keys, so that every rule
is broken by some and kept by others; the SQL states the rules by itself.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from attesta.operators import rollups, validation
from attesta.sources.tables import load

from .registry import query

NARRATIVES = ["threat", "other", "none_unclear"]
COUNTRIES = ["NL", "DE"]


def pick(options: list, n: Column) -> Column:
    """The option of a number, counted round."""
    return F.element_at(F.array(*map(F.lit, options)), (F.pmod(n, F.lit(len(options))) + 1).cast("int"))


def broken(rules: dict[str, Column]) -> Column:
    return F.array_join(validation.errors(rules), ";").alias("errors")


def strings(*values) -> Column:
    return F.array(*map(F.lit, values)).cast("array<string>")


@query(
    "classification_checks",
    """
with x as (select l_orderkey as k, l_linenumber as n, l_partkey as p, l_suppkey as s, cast(l_quantity as bigint) as q from lineitem),
y as (select k, n, p % 6 as o, case when k % 13 <> 0 then q % 5 end as a, s % 5 as m, (k % 12) / 10.0 as c, (p % 11) / 10.0 as nc,
  ['negative', 'positive', 'mixed', 'unclear', 'odd'][k % 5 + 1] as dir, ['threat', 'other', 'none_unclear', 'bogus'][p % 4 + 1] as prim, s % 3 = 0 as sec,
  case when q % 2 = 0 then 'label' else ' ' end as ol, case when q % 3 <> 0 then 'why' else '' end as oe, q % 4 <> 0 as has_target, p % 7 = 0 as unnamed,
  ['negative', 'mixed', 'unclear', 'positive', 'bad'][(p + q) % 5 + 1] as td from x),
z as (select *, coalesce(o, 0) + coalesce(a, 0) + coalesce(m, 0) > 0 as framed from y)
select k as l_orderkey, n as l_linenumber, concat_ws(';',
  case when o > 4 then 'othering out of range' end, case when a is null then 'aversion out of range' end,
  case when c > 1 then 'confidence out of range' end, case when nc > 1 then 'narrative_confidence out of range' end,
  case when dir = 'odd' then 'direction unknown' end, case when dir = 'positive' and framed then 'positive but framed' end,
  case when prim = 'bogus' then 'narrative unknown' end, case when (prim = 'other' or sec) and (trim(ol) = '' or trim(oe) = '') then 'other unexplained' end,
  case when has_target and (unnamed or td = 'bad') then 'target incomplete' end,
  case when framed and not (has_target and td in ('negative', 'mixed')) then 'framed without adverse target' end,
  case when k % 17 = 0 then 'country unknown' end, case when k % 11 = 0 then 'rationale missing' end) as errors,
  round((o + a + m) / 3.0, 6) as sfi, o >= 2 and a >= 2 and m >= 2 as strong from z
""",
)
def classification_checks(spark, sf_dir):
    k, p, s, q = F.col("l_orderkey"), F.col("l_partkey"), F.col("l_suppkey"), F.col("l_quantity").cast("bigint")
    target = F.struct(F.lit("group").alias("target_type"), F.when(p % 7 == 0, "").otherwise("n").alias("target_name"), pick(["negative", "mixed", "unclear", "positive", "bad"], p + q).alias("direction"))
    rows = load(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        (p % 6).alias("othering"),
        F.when(k % 13 != 0, q % 5).alias("aversion"),
        (s % 5).alias("moralization"),
        ((k % 12) / 10).alias("confidence"),
        ((p % 11) / 10).alias("narrative_confidence"),
        pick(["negative", "positive", "mixed", "unclear", "odd"], k).alias("direction"),
        pick(["threat", "other", "none_unclear", "bogus"], p).alias("primary_narrative"),
        F.when(s % 3 == 0, strings("other", "threat")).otherwise(strings()).alias("secondary_narratives"),
        F.when(q % 2 == 0, "label").otherwise(" ").alias("other_narrative_label"),
        F.when(q % 3 != 0, "why").alias("other_narrative_explanation"),
        F.filter(F.array(target), lambda t: q % 4 != 0).alias("targets"),
        F.when(k % 17 == 0, strings("XX")).otherwise(strings("NL")).alias("countries"),
        F.when(k % 11 != 0, "r").alias("short_rationale"),
    )
    sfi, strong = rollups.framing_score([F.col(d) for d in validation.DIMENSIONS])
    return rows.select("l_orderkey", "l_linenumber", broken(validation.classification_rules(NARRATIVES, COUNTRIES)), F.round(sfi, 6).alias("sfi"), strong.alias("strong"))


@query(
    "comment_target_checks",
    """
with x as (select conv_id, turn, [['v1'], ['v1', 'v1'], ['v9'], ['']][turn % 4 + 1] as v, turn % 11 = 10 as no_ids, case role when 'user' then 'speaker' else 'main_message' end as focus,
 ['supports', 'opposes', 'mixed', 'no_position'][conv_id % 4 + 1] in ('supports', 'opposes', 'mixed') as side from conversations)
select conv_id, turn, concat_ws(';', case when not no_ids and (turn % 4 in (1, 2, 3)) then 'viewpoint ids faulty' end, case when side and focus = 'speaker' then 'stance beside the message' end,
 case when turn % 5 = 0 then 'rationale missing' end, case when side and conv_id % 3 = 0 then 'stance without target' end, case when side and no_ids then 'stance without viewpoint' end) as errors from x
""",
)
def comment_target_checks(spark, sf_dir):
    c, t = F.col("conv_id"), F.col("turn")
    ids = F.element_at(F.array(strings("v1"), strings("v1", "v1"), strings("v9"), strings("")), (t % 4 + 1).cast("int"))
    rows = load(spark, sf_dir, "conversations").select(
        "conv_id",
        "turn",
        F.when(t % 11 == 10, strings()).otherwise(ids).alias("viewpoint_ids"),
        F.when(F.col("role") == "user", "speaker").otherwise("main_message").alias("response_focus"),
        pick(["supports", "opposes", "mixed", "no_position"], c).alias("alignment"),
        F.when(t % 5 == 0, " ").otherwise("r").alias("rationale"),
        F.when(c % 3 == 0, "").otherwise("t").alias("stance_target"),
    )
    return rows.select("conv_id", "turn", broken(validation.comment_target_rules(["v1", "v2"])))


def sections() -> Column:
    """A document as a title and a transcript."""
    text = F.coalesce("text", F.lit(""))
    one = lambda name, value: F.struct(F.lit(name).alias("id"), value.alias("text"))
    return F.array(one("title", F.substring(text, 1, 30)), one("transcript", text))


@query(
    "evidence_checks",
    """
with x as (select doc_id as i, coalesce(text, '') as t from documents),
y as (select i, t, ['scored', 'insufficient_evidence', 'out_of_scope'][i % 3 + 1] as st,
  case when i % 3 = 2 then case when i % 4 = 0 then 'unclear' else 'out_of_scope' end when i % 10 = 3 then 'out_of_scope' else 'in_scope' end as rel,
  case when i % 3 = 0 or i % 30 = 1 then i % 7 end as o, case when i % 3 = 0 then (i // 3) % 4 end as a, case when i % 3 = 0 then (i // 9) % 2 end as m,
  ['negative', 'unclear', 'mixed'][(i // 2) % 3 + 1] as d1, substr(t, 5, 20) as q1, case when i % 4 = 0 then 'zz not there zz' else substr(t, 1, 10) end as q2 from x),
z as (select *, i % 3 = 0 and o + a + m > 0 as framed, i % 3 = 0 and o > 0 and a = 0 and m = 0 as alone, case when i % 40 = 0 then o else m end as s3 from y)
select i as doc_id, concat_ws(';', case when i % 23 = 0 then 'stance unknown' end,
  case when (st = 'out_of_scope') <> (rel = 'out_of_scope') then 'status and relevance disagree' end,
  case when st <> 'scored' and o is not null then 'unscored but with scores' end,
  case when i % 5 = 0 and framed then 'positive but framed' end,
  case when framed and not (d1 in ('negative', 'mixed') or (alone and d1 = 'unclear')) then 'framed without adverse target' end,
  case when i % 40 = 0 then 'not one piece for each dimension' end, case when i % 8 = 0 then 'explanation missing' end,
  case when (q1 <> '' and not contains(t, q1)) or (q2 <> '' and not contains(t, q2)) then 'quote not in source' end,
  case when (o > 0 and (q1 = '' or i % 6 = 0 or i % 9 = 0)) or (a > 0 and q2 = '') or s3 > 0 then 'score without evidence' end,
  case when a > 0 and (i % 5 = 0 or d1 = 'unclear') then 'score without adverse target' end,
  case when a > 0 and i % 5 = 0 then 'positive target scored' end) as errors,
  case when q1 = '' or contains(substr(t, 1, 30), q1) or not contains(t, q1) then 'title' else 'transcript' end as source_id from z
""",
)
def evidence_checks(spark, sf_dir):
    i, t = F.col("doc_id"), F.coalesce("text", F.lit(""))
    third = lambda n: F.floor(i / n)
    target = lambda name, d: F.struct(F.lit("group").alias("target_type"), F.lit(name).alias("target_name"), d.alias("direction"))

    def piece(dimension, quote, source, to, speaker, explanation, attribution):
        parts = {"dimension": dimension, "quote": quote, "source_id": source, "target": to, "speaker": speaker, "explanation": explanation, "attribution": attribution}
        return F.struct(*((v if isinstance(v, Column) else F.lit(v)).alias(n) for n, v in parts.items()))

    scope = F.when(i % 3 == 2, F.when(i % 4 == 0, "unclear").otherwise("out_of_scope")).when(i % 10 == 3, "out_of_scope").otherwise("in_scope")
    evidence = F.array(
        piece("othering", F.substring(t, 5, 20), "title", "A", F.when(i % 6 == 0, " ").otherwise("S"), F.when(i % 8 == 0, "").otherwise("x"), F.when(i % 9 == 0, "reported").otherwise("author_assertion")),
        piece("aversion", F.when(i % 4 == 0, "zz not there zz").otherwise(F.substring(t, 1, 10)), "transcript", F.when(i % 5 == 0, "B").otherwise("A"), "S", "x", "speaker_assertion"),
        piece(F.when(i % 40 == 0, "othering").otherwise("moralization"), "", "title", "C", "S", "x", "author_assertion"),
    )
    rows = load(spark, sf_dir, "documents").select(
        "doc_id",
        sections().alias("sections"),
        pick(["scored", "insufficient_evidence", "out_of_scope"], i).alias("assessment_status"),
        scope.alias("public_affairs_relevance"),
        F.when(i % 23 == 0, "odd").otherwise("asserted").alias("publisher_stance"),
        F.when((i % 3 == 0) | (i % 30 == 1), i % 7).alias("othering"),
        F.when(i % 3 == 0, third(3) % 4).alias("aversion"),
        F.when(i % 3 == 0, third(9) % 2).alias("moralization"),
        F.lit(0.5).alias("confidence"),
        F.lit(0.5).alias("narrative_confidence"),
        F.when(i % 5 == 0, "positive").otherwise("negative").alias("direction"),
        F.lit("threat").alias("primary_narrative"),
        strings().alias("secondary_narratives"),
        F.lit("").alias("other_narrative_label"),
        F.lit("").alias("other_narrative_explanation"),
        F.array(target("A", pick(["negative", "unclear", "mixed"], third(2))), target("B", F.lit("positive"))).alias("targets"),
        strings("NL").alias("countries"),
        F.lit("r").alias("short_rationale"),
        evidence.alias("dimension_evidence"),
    )
    at = validation.with_located_quotes(F.col("dimension_evidence"), F.col("sections"))
    return rows.select("doc_id", broken(validation.evidence_rules(NARRATIVES, COUNTRIES)), F.element_at(at, 1)["source_id"].alias("source_id"))


@query(
    "source_screen_checks",
    """
with x as (select doc_id as i, coalesce(text, '') as t from documents),
y as (select i, t, case i % 5 when 0 then '' when 2 then 'zz absent zz' when 3 then substr(t, 1, 450) when 4 then substr(t, 3, 30) end as q, ['scored', 'insufficient_evidence', 'out_of_scope', 'odd'][i % 4 + 1] as st from x)
select i as doc_id, concat_ws(';', case when st = 'odd' then 'status unknown' end, case when i % 7 = 0 then 'explanation missing' end, case when q is null or length(q) > 400 then 'quote unusable' end,
 case when q <> '' and not contains(t, q) then 'quote not in source' end, case when st = 'scored' and coalesce(q, '') = '' then 'scored without quote' end, case when i % 12 = 11 then 'confidence out of range' end) as errors,
 case when q is null or q = '' or contains(substr(t, 1, 30), q) or not contains(t, q) then 'title' else 'transcript' end as source_id from y
""",
)
def source_screen_checks(spark, sf_dir):
    i, t = F.col("doc_id"), F.coalesce("text", F.lit(""))
    quote = F.when(i % 5 == 0, "").when(i % 5 == 2, "zz absent zz").when(i % 5 == 3, F.substring(t, 1, 450)).when(i % 5 == 4, F.substring(t, 3, 30))
    rows = load(spark, sf_dir, "documents").select(
        "doc_id",
        sections().alias("sections"),
        quote.alias("evidence_quote"),
        pick(["scored", "insufficient_evidence", "out_of_scope", "odd"], i).alias("assessment_status"),
        F.when(i % 7 == 0, "  ").otherwise("x").alias("explanation"),
        F.lit("title").alias("source_id"),
        ((i % 12) / 10).alias("confidence"),
    )
    at = validation.located(F.col("evidence_quote"), F.col("source_id"), F.col("sections"))
    return rows.select("doc_id", broken(validation.source_screen_rules()), F.coalesce(at, "source_id").alias("source_id"))


@query(
    "comment_review_checks",
    """
with x as (select conv_id as c, turn as t, ['supports', 'opposes', 'no_position'][conv_id % 3 + 1] as model, ['main_message', 'presentation', 'odd'][turn % 3 + 1] as focus from conversations),
y as (select *, case when t % 4 = 3 then 'mixed' else model end as human from x), z as (select *, human in ('supports', 'opposes', 'mixed') as side from y)
select c as conv_id, t as turn, concat_ws(';', case when c % 10 = 0 or t % 7 = 6 or c % 9 = 0 then 'version or hash differs' end, case when c % 8 = 0 then 'reviewer missing' end,
 case when t % 6 = 5 then 'stamp missing' end, case when c % 3 = 2 then 'basis unknown' end, case when t % 5 = 4 then 'decision missing' end, case when c % 4 = 2 then 'decision unknown' end,
 case when human <> model and c % 4 in (0, 3) then 'agreed but changed' end, case when focus = 'odd' or c % 14 = 0 then 'comment label unknown' end, case when t % 5 = 1 then 'viewpoint ids faulty' end,
 case when side and focus = 'presentation' then 'stance beside the message' end, case when side and c % 6 = 1 then 'stance without target' end, case when side and t % 5 = 2 then 'stance without viewpoint' end) as errors from z
""",
)
def comment_review_checks(spark, sf_dir):
    c, t = F.col("conv_id"), F.col("turn")
    model = pick(["supports", "opposes", "no_position"], c)
    human = F.when(t % 4 == 3, "mixed").otherwise(model)
    source = F.when(c % 10 == 0, "v0").otherwise("v2")
    decisions = F.create_map(F.lit("alignment"), pick(["agree", "disagree", "", "agree"], c), F.lit("sentiment"), F.lit("agree"))
    rows = load(spark, sf_dir, "conversations").select(
        "conv_id",
        "turn",
        source.alias("source_version"),
        F.when(t % 7 == 6, "v1").otherwise(source).alias("version"),
        F.lit("h").alias("payload_hash"),
        F.when(c % 9 == 0, "g").otherwise("h").alias("queue_hash"),
        F.when(c % 8 == 0, " ").otherwise("R").alias("reviewer"),
        F.when(t % 6 != 5, "2026-01-01T00:00:00Z").alias("reviewed_at"),
        pick(["english_transcript", "watched_video", "guess"], c).alias("basis"),
        F.create_map(F.lit("alignment"), model, F.lit("sentiment"), F.lit("neutral")).alias("expected"),
        F.create_map(F.lit("alignment"), human, F.lit("sentiment"), F.lit("neutral")).alias("human"),
        F.map_filter(decisions, lambda k, v: (k != "sentiment") | (t % 5 != 4)).alias("decisions"),
        human.alias("alignment"),
        pick(["main_message", "presentation", "odd"], t).alias("response_focus"),
        F.lit("neutral").alias("sentiment"),
        F.when(c % 14 != 0, "x").alias("sentiment_target"),
        F.when(c % 6 == 1, " ").otherwise("x").alias("stance_target"),
        F.when(t % 5 == 1, strings("v1", "v1")).when(t % 5 == 2, strings()).otherwise(strings("v1")).alias("viewpoint_ids"),
    )
    own = validation.comment_review_rules(["supports", "opposes", "mixed", "no_position"], ["main_message", "presentation"], ["neutral"], ["v1", "v2"])
    return rows.select("conv_id", "turn", broken(validation.review_rules(["v1", "v2"]) | own))


@query(
    "video_review_checks",
    """
with x as (select p_partkey as i, p_size as s, ['single_viewpoint', 'multiple_viewpoints', 'unclear', 'odd'][p_partkey % 4 + 1] as st, p_size % 3 as n, ['related', 'unrelated', 'odd'][p_partkey % 3 + 1] as rel, [0, 1, 2, 1][p_partkey // 3 % 4 + 1] as nt from part)
select i as p_partkey, concat_ws(';', case when st = 'odd' then 'structure unknown' end, case when (st = 'single_viewpoint' and n <> 1) or (st = 'multiple_viewpoints' and n < 2) then 'viewpoints do not fit structure' end,
 case when n = 2 and s % 5 = 0 then 'viewpoint ids repeated' end, case when n > 0 and (i % 7 = 0 or i % 11 = 0) then 'viewpoint incomplete' end, case when rel = 'odd' then 'relevance unknown' end,
 case when i // 3 % 4 = 3 then 'topic unknown' end, case when nt = 2 and i % 5 = 0 then 'topic repeated' end, case when rel <> 'related' and (nt > 0 or s % 2 = 0) then 'unrelated but labelled' end,
 case when rel = 'related' and nt = 0 then 'related without topic' end, case when s % 2 = 0 and i % 13 < 3 then 'role faulty' end, case when s % 10 = 1 then 'execution unknown' end,
 case when s % 10 = 2 and i % 2 = 0 then 'absence without watching' end) as errors from x
""",
)
def video_review_checks(spark, sf_dir):
    i, s = F.col("p_partkey"), F.col("p_size")
    view = lambda name, speaker: F.struct(name.alias("viewpoint_id"), speaker.alias("speaker"), F.lit("s").alias("summary"), F.lit("t").alias("target"), F.when(i % 11 == 0, "odd").otherwise("neutral").alias("speaker_sentiment"))
    two = F.array(view(F.lit("v1"), F.when(i % 7 == 0, " ").otherwise("S")), view(F.when(s % 5 == 0, "v1").otherwise("v2"), F.lit("S")))
    kind = F.floor(i / 3) % 4
    topics = F.when(kind == 0, strings()).when(kind == 1, strings("a")).when(kind == 2, F.when(i % 5 == 0, strings("a", "a")).otherwise(strings("a", "b"))).otherwise(strings("odd"))
    role = F.struct(F.when(i % 13 == 0, "odd").otherwise("actor").alias("role"), F.when(i % 13 == 1, "XX").otherwise("NL").alias("entity_code"), F.when(i % 13 == 2, " ").otherwise("e").alias("entity"))
    status = F.when(s % 10 == 1, "odd").when(s % 10 == 2, "absent_after_watching").otherwise("present")
    rows = load(spark, sf_dir, "part").select(
        "p_partkey",
        pick(["single_viewpoint", "multiple_viewpoints", "unclear", "odd"], i).alias("viewpoint_structure"),
        F.slice(two, F.lit(1), s % 3).alias("viewpoints"),
        pick(["related", "unrelated", "odd"], i).alias("relevance"),
        topics.alias("topics"),
        F.filter(F.array(role), lambda r: s % 2 == 0).alias("roles"),
        F.array(F.struct(F.lit("edit").alias("category"), status.alias("status"))).alias("execution"),
        F.when(i % 2 == 0, "english_transcript").otherwise("watched_video").alias("basis"),
    )
    return rows.select("p_partkey", broken(validation.video_review_rules(["a", "b"], ["actor"], ["NL"], ["present"], ["single_viewpoint", "multiple_viewpoints", "unclear"], ["neutral"])))


@query(
    "assisted_review_checks",
    """
with x as (select doc_id as i, doc_id % 4 = 1 as turned, doc_id % 6 = 2 as changed, ['agree', 'disagree', 'maybe'][doc_id % 3 + 1] as d from documents)
select i as doc_id, concat_ws(';', case when i % 9 = 0 then 'hash differs' end, case when i % 10 = 0 then 'method unknown' end, case when i % 2 = 0 and i % 5 = 3 then 'basis missing' end,
 case when i % 7 = 0 then 'decision missing' end, case when d = 'agree' and changed then 'agreed but changed' end, case when d = 'disagree' and not changed then 'disagreed but unchanged' end,
 case when d = 'maybe' then 'decision unknown' end, case when changed and i % 4 = 0 then 'country unknown' end, case when i % 15 = 4 then 'narrative unknown' end, case when i % 8 in (5, 6) then 'stamp without zone' end) as errors from x
""",
)
def assisted_review_checks(spark, sf_dir):
    i = F.col("doc_id")
    same = F.when(i % 4 == 1, strings("NL", "DE")).otherwise(strings("DE", "NL"))
    own = F.when(i % 6 != 2, same).otherwise(F.when(i % 4 == 0, strings("XX")).otherwise(strings("NL")))
    narratives = strings("threat")
    decisions = F.create_map(F.lit("countries"), pick(["agree", "disagree", "maybe"], i), F.lit("narratives"), F.when(i % 15 == 4, "disagree").otherwise("agree"))
    rows = load(spark, sf_dir, "documents").select(
        "doc_id",
        F.lit("h").alias("label_hash"),
        F.when(i % 9 == 0, "g").otherwise("h").alias("queue_hash"),
        F.when(i % 10 == 0, "by_hand").otherwise("ai_assisted_confirmation").alias("review_method"),
        F.when(i % 2 == 0, "transcript").alias("evidence_scope"),
        F.when(i % 5 != 3, "watched_video").alias("review_evidence_basis"),
        F.create_map(F.lit("countries"), strings("DE", "NL"), F.lit("narratives"), narratives).alias("model"),
        F.create_map(F.lit("countries"), own, F.lit("narratives"), F.when(i % 15 == 4, strings()).otherwise(narratives)).alias("human"),
        F.map_filter(decisions, lambda k, v: (k != "narratives") | (i % 7 != 0)).alias("decisions"),
        F.when(i % 8 == 5, "2026-01-01T00:00:00").when(i % 8 == 6, "some day").otherwise("2026-01-01T00:00:00+01:00").alias("reviewed_at"),
    )
    return rows.select("doc_id", broken(validation.assisted_review_rules(COUNTRIES, NARRATIVES)))


@query(
    "transcript_verdicts",
    r"""
with s as (select conv_id as c, count(*) as n, bool_or(turn % 9 = 8) as blank, max(turn) as last, string_agg(case when turn % 9 = 8 then ' ' else text end, ' ' order by turn) as t from conversations group by 1),
w as (select *, regexp_extract_all(lower(t), '[\p{L}\p{N}_]+') as w, 2 * (last + 1) as duration from s)
select c as conv_id, case when c % 10 = 0 or c % 11 = 0 then 'AudioLanguageUncertain' when c % 7 = 0 then 'AudioEnglishTranslationRequired' when c % 13 = 0 then 'AudioInvalidSegments'
 when blank or c % 5 = 4 then 'AudioInvalidSegments' when len(w) = 0 or (len(w) >= 20 and len(list_distinct(w)) < 10) then 'AudioNoUsableSpeech'
 when c % 3 = 0 or c % 8 = 1 or not (duration > 0 and len(w) >= duration / 3.0) then 'AudioIncompleteTranscript' end as failure from w
""",
)
def transcript_verdicts(spark, sf_dir):
    turn, c = F.col("turn"), F.col("conv_id")
    piece = F.struct(turn.alias("at"), F.when(turn % 9 == 8, " ").otherwise(F.col("text")).alias("text"), (2.0 * turn).alias("start"), (2.0 * turn + 1.5).alias("end"))
    rows = load(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(piece)).alias("segments"), F.max("turn").alias("last"))
    rows = rows.withColumn("segments", F.when(c % 5 == 4, F.transform("segments", lambda s: s.withField("end", s["start"]))).otherwise(F.col("segments")))
    duration = 2.0 * (F.col("last") + 1)
    speech = {
        "language": F.when(c % 10 == 0, "und").otherwise("fr"),
        "probability": F.when(c % 11 == 0, 0.5).otherwise(0.9),
        "task": F.lit("translate"),
        "output_language": F.when(c % 7 == 0, "fr").otherwise("en"),
        "duration": F.when(c % 13 == 0, 9000.0).otherwise(duration),
        "speech_seconds": duration,
        "complete": c % 3 != 0,
        "covered": F.lit(True),
        "discarded": F.when(c % 8 == 1, 1).otherwise(0),
    }
    return rows.select("conv_id", validation.transcript_verdict(speech, F.col("segments")).alias("failure"))
