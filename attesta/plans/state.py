"""Queries over versioned state and validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from attesta.operators import budgets, state, validation
from attesta.sources.tables import load

from .registry import query


@query(
    "immutable_insert",
    "select o_orderkey, sha256(cast(o_totalprice as varchar)) is not null as hashed from orders where o_orderkey % 2 = 1",
)
def immutable_insert(spark, sf_dir):
    """Stored even ids are no-ops; odd ones are appended."""
    o = load(spark, sf_dir, "orders").select("o_orderkey", F.sha2(F.col("o_totalprice").cast("string"), 256).alias("digest"))
    got = state.immutable_insert(o, o.where("o_orderkey % 2 = 0"), "o_orderkey", "digest")
    return got.select("o_orderkey", F.col("digest").isNotNull().alias("hashed"))


@query("insert_conflicts", "select o_orderkey, 'conflict with stored' as fault from orders where o_orderkey % 10 = 0")
def insert_conflicts(spark, sf_dir):
    o = load(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("digest"))
    old = o.where("o_orderkey % 2 = 0").withColumn("digest", F.when(F.col("o_orderkey") % 10 == 0, F.lit("other")).otherwise(F.col("digest")))
    return state.insert_faults(o, old, "o_orderkey", "digest")


@query(
    "upsert_keep_date",
    """
with o as (select o_orderkey as k, o_orderstatus as s, o_orderdate::date as d from orders where o_orderkey % 3 <> 0),
n as (select o_orderkey as k, 'N' as s, case when o_orderkey % 4 = 0 then null else date '2002-01-01' end as d from orders where o_orderkey % 2 = 0 and o_orderkey % 7 <> 0)
select coalesce(o.k, n.k) as k, coalesce(n.s, o.s) as s, coalesce(n.d, o.d) as d from o full join n on o.k = n.k
""",
)
def upsert_keep_date(spark, sf_dir):
    rows = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("s"), F.to_date("o_orderdate").alias("d"))
    new = rows.where("k % 2 = 0").select("k", F.lit("N").alias("s"), F.when(F.col("k") % 4 != 0, F.lit("2002-01-01").cast("date")).alias("d"))
    return state.upsert_keep(rows.where("k % 3 <> 0"), new, "k", ["d"], F.col("k") % 7 != 0)


@query("ttl_purge", "select event_id, case when ts < timestamp '2024-01-21' then '{\"purged\":true}' else props end as props, ts < timestamp '2024-01-21' as purged from events")
def ttl_purge(spark, sf_dir):
    ev = load(spark, sf_dir, "events").withColumn("purged_at", F.lit(None).cast("timestamp"))
    got = state.purge(ev, "ts", F.lit("2024-01-31").cast("timestamp"), 10, "props")
    return got.select("event_id", "props", F.col("purged_at").isNotNull().alias("purged"))


@query("stage_bits", "select user_id, string_agg(distinct event_type, ',' order by event_type) filter (where event_type <> 'error') as stages from events group by user_id")
def stage_bits(spark, sf_dir):
    """Set-once stages; failures add none."""
    ev = load(spark, sf_dir, "events").select("user_id", "event_type", F.when(F.col("event_type") == "error", "failed").otherwise("done").alias("status"))
    one = state.complete_stage(F.array().cast("array<string>"), F.col("event_type"), F.col("status"))
    got = ev.select("user_id", one.alias("s")).groupBy("user_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("s")))).alias("stages"))
    return got.select("user_id", F.array_join("stages", ",").alias("stages"))


@query("sequence_assignment", "select user_id, cast(row_number() over (order by min(ts), user_id) as bigint) as number from events group by user_id")
def sequence_assignment(spark, sf_dir):
    ev = load(spark, sf_dir, "events")
    none = spark.createDataFrame([], "user_id long, number long")
    return state.assign_sequence(ev, "user_id", "ts", none)


@query("clone_batch", "select 'B2' || substr('B1-' || cast(doc_id as varchar), 3) as id, 'B2' as batch_id from documents where doc_id % 2 = 0")
def clone_batch(spark, sf_dir):
    d = load(spark, sf_dir, "documents").select(F.concat(F.when(F.col("doc_id") % 2 == 0, "B1-").otherwise("B0-"), F.col("doc_id").cast("string")).alias("id"), F.when(F.col("doc_id") % 2 == 0, "B1").otherwise("B0").alias("batch_id"), F.lit(None).cast("timestamp").alias("purged_at"))
    return state.clone_batch(d, "B1", "B2").select("id", "batch_id")


RESERVATIONS = """
select event_id // 100 as ledger, event_id, row_number() over (partition by event_id // 100 order by ts, event_id) as i, event_type in ('purchase', 'click', 'view') as asks,
 case when event_type in ('purchase', 'click', 'view') then event_id else event_id - 1 - event_id % 5 end as ident,
 case when event_type in ('purchase', 'click', 'view') then round(value * 1000000)::bigint when event_id % 7 > 0 then round(value / 2 * 1000000)::bigint end as amount from events"""


def _reservations(ev):
    """Purchases, clicks and views ask for their value; the others settle an earlier event at half of theirs, some at an unknown cost."""
    asks = F.col("event_type").isin("purchase", "click", "view")
    ident = F.when(asks, F.col("event_id")).otherwise(F.col("event_id") - 1 - F.col("event_id") % 5)
    amount = F.when(asks, F.col("value")).when(F.col("event_id") % 7 > 0, F.col("value") / 2)
    return ev.select(F.expr("event_id div 100").alias("ledger"), "event_id", "ts", F.when(asks, "reserve").otherwise("settle").alias("kind"), ident.alias("ident"), amount.alias("amount"))


LEDGER_SQL = f"""
with recursive e as ({RESERVATIONS}),
f as (select distinct ledger, 0::bigint as i, 0::bigint as event_id, 0::bigint as spent, []::struct(id bigint, amount bigint)[] as held, '' as outcome from e
 union all select f.ledger, e.i, e.event_id, case when asks then case when spent + amount <= 500000000 then spent + amount else spent end when amount is null or k is null then spent else spent + amount - held[k].amount end,
  case when asks then case when spent + amount <= 500000000 then list_append(held, struct_pack(id := ident, amount := amount)) else held end when amount is null or k is null then held else list_filter(held, lambda x: x.id <> ident) end,
  case when asks then case when spent + amount <= 500000000 then 'accepted' else 'refused' end when amount is null or k is null then 'ignored' else 'settled' end
  from (select f.*, e.i as next, list_position(list_transform(f.held, lambda x: x.id), e.ident) as k from f join e on e.ledger = f.ledger and e.i = f.i + 1) f join e on e.ledger = f.ledger and e.i = f.next)
select event_id, outcome, round(spent / 1000000.0, 6) as spent from f where i > 0
"""


@query("budget_ledger", LEDGER_SQL)
def budget_ledger(spark, sf_dir):
    got = budgets.ledger(_reservations(load(spark, sf_dir, "events")), "ledger", ["ts", "event_id"], "kind", "ident", "amount", 500.0)
    return got.select("event_id", "outcome", F.round("spent", 6).alias("spent"))


@query(
    "settled_reservations",
    "select r.event_id, coalesce(s.used, r.value) as cost from events r left join (select event_id - 1 as k, value as used from events where event_type = 'purchase') s on s.k = r.event_id where r.event_type = 'click'",
)
def settled_reservations(spark, sf_dir):
    ev = load(spark, sf_dir, "events")
    r = ev.where("event_type = 'click'").select("event_id", F.col("value").alias("amount"))
    s = ev.where("event_type = 'purchase'").select((F.col("event_id") - 1).alias("event_id"), F.col("value").alias("amount"), F.col("event_id").alias("settlement_id"))
    return state.settled(r, s, "event_id")


@query("monthly_reservation", "select o_custkey as k, strftime(o_orderdate, '%Y-%m') as month, min(o_orderdate) as at from orders where o_custkey % 10 <> 3 group by 1, 2")
def monthly_reservation(spark, sf_dir):
    o = load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderdate").alias("at"))
    made = o.where("k % 10 = 3").select("k", F.date_format("at", "yyyy-MM").alias("month")).distinct()
    return state.once_a_month(o, "k", "at", made)


@query(
    "corrections_overlay",
    "select l.doc_id, case when l.doc_id % 6 = 0 then 1 - l.quality else l.quality end as quality, case when l.doc_id % 6 = 0 then 'applied' when l.doc_id % 6 = 3 then 'stale' else 'none' end as correction from labels l",
)
def corrections_overlay(spark, sf_dir):
    l = load(spark, sf_dir, "labels").select("doc_id", "quality", F.sha2(F.col("doc_id").cast("string"), 256).alias("fp"))
    c = l.where("doc_id % 3 = 0").select("doc_id", (1 - F.col("quality")).alias("quality"), F.when(F.col("doc_id") % 6 == 0, F.col("fp")).otherwise("old").alias("fp"))
    return state.overlay(l, c, "doc_id", "fp", ["quality"]).select("doc_id", "quality", "correction")


ITEMS = """
select d.doc_id, case when d.doc_id % 11 = 0 then 'human_reviewed' when trim(d.text) = '' then 'no_text' when d.n_chars < 300 then 'source_incomplete'
  when l.quality is null then 'pending' when l.quality = 1 then 'provisional' else 'needs_review' end as status
from documents d left join labels l using (doc_id)
"""


def _items(spark, sf_dir):
    d = load(spark, sf_dir, "documents").select("doc_id", "n_chars", (F.trim("text") != "").alias("has_text"))
    rows = d.join(load(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    status = state.item_status(F.col("doc_id") % 11 == 0, F.col("has_text"), F.col("n_chars") >= 300, F.col("quality") == 1, F.col("quality"))
    return rows.select("doc_id", status.alias("status"))


@query("state_machine", ITEMS)
def state_machine(spark, sf_dir):
    return _items(spark, sf_dir)


@query("review_queue", f"select doc_id from ({ITEMS}) where doc_id % 50 = 0 or status in ('needs_review', 'source_incomplete') or cast('0x' || substr(sha256(cast(doc_id as varchar)), 1, 8) as bigint) % 100 < 3")
def review_queue(spark, sf_dir):
    from attesta.operators.sampling import modulo_sample

    rows = _items(spark, sf_dir)
    routine = modulo_sample(F.sha2(F.col("doc_id").cast("string"), 256), 100, 3)
    return rows.where(state.queued(F.col("doc_id") % 50 == 0, F.col("status"), routine)).select("doc_id")


@query("version_requeue", f"select doc_id, case when status = 'provisional' and doc_id % 4 = 0 then 'pending' else status end as status from ({ITEMS})")
def version_requeue(spark, sf_dir):
    version = F.when(F.col("doc_id") % 4 == 0, "1.6").otherwise("1.7")
    return _items(spark, sf_dir).select("doc_id", state.requeue(F.col("status"), F.lit(False), version, "1.7").alias("status"))


@query("incremental_discovery", "select coalesce(k.user_id, f.user_id) as user_id, coalesce(f.d, k.d) as d, k.user_id is null as is_new from (select user_id, max(ts)::date as d from events where ts < timestamp '2024-01-02' group by 1) k full join (select user_id, max(ts)::date as d from events where ts >= timestamp '2024-01-29' group by 1) f on k.user_id = f.user_id")
def incremental_discovery(spark, sf_dir):
    ev = load(spark, sf_dir, "events").select("user_id", F.to_date("ts").alias("d"), "ts")
    cut = lambda s: F.lit(s).cast("timestamp")
    known = ev.where(F.col("ts") < cut("2024-01-02")).groupBy("user_id").agg(F.max("d").alias("d"))
    return state.discovered(ev.where(F.col("ts") >= cut("2024-01-29")), known, "user_id", "d")


@query("day_mode", "select case when bool_and(d >= timestamp '2024-01-25') then 'classify' else 'collect' end as mode from (select user_id, max(ts) as d from events where event_type = 'view' group by 1)")
def day_mode(spark, sf_dir):
    c = load(spark, sf_dir, "events").where("event_type = 'view'").groupBy("user_id").agg(F.max("ts").alias("d"))
    return state.day_mode(c, F.lit(True), F.col("d"), F.lit("2024-01-25").cast("timestamp"))


@query(
    "label_errors",
    """
with r as (select d.doc_id, list_filter([case when l.quality not between 0 and 1 then 'quality out of range' end, case when d.lang not in ('en', 'fr', 'de') then 'language unknown' end, case when length(d.text) < 200 then 'text short' end], lambda x: x is not null) as e from documents d join labels l using (doc_id))
select doc_id, array_to_string(e, ',') as errors from r where len(e) > 0
""",
)
def label_errors(spark, sf_dir):
    d = load(spark, sf_dir, "documents").join(load(spark, sf_dir, "labels"), "doc_id")
    rules = {"quality out of range": validation.within(F.col("quality"), 0, 1), "language unknown": validation.not_one_of(F.col("lang"), ["en", "fr", "de"]), "text short": F.length("text") < 200}
    return d.select("doc_id", validation.errors(rules).alias("e")).where(F.size("e") > 0).select("doc_id", F.array_join("e", ",").alias("errors"))


@query("exact_cover", "select conv_id, not (count(*) = count(distinct turn) and min(turn) = 0 and max(turn) = count(*) - 1) as broken from conversations group by conv_id")
def exact_cover(spark, sf_dir):
    """Turns are 0 .. n-1, each once."""
    c = load(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.collect_list("turn").alias("turns"), F.count("*").alias("n"))
    want = F.sequence(F.lit(0).cast("long"), F.col("n") - 1)
    return c.select("conv_id", validation.not_exact_cover(F.col("turns"), want).alias("broken"))


@query("validation_gate", "select count(*) filter (where quality = 1) >= 100 and count(distinct lang) >= 2 and count(distinct source) >= 3 as passed from documents join labels using (doc_id)")
def validation_gate(spark, sf_dir):
    d = load(spark, sf_dir, "documents").join(load(spark, sf_dir, "labels"), "doc_id")
    facts = d.agg(F.count_if(F.col("quality") == 1).alias("reviews"), F.count_distinct("lang").alias("languages"), F.count_distinct("source").alias("countries"), F.collect_set("lang").alias("tiers"))
    return validation.gate(facts, {"reviews": 100, "languages": 2, "countries": 3}, ["en"]).select("passed")


@query("all_or_nothing_import", "select doc_id from labels where (select count(*) from labels where quality not in (0, 1)) = 0")
def all_or_nothing_import(spark, sf_dir):
    l = load(spark, sf_dir, "labels")
    rows, _ = validation.all_or_nothing(l, {"quality": ~F.col("quality").isin(0, 1)}, "doc_id")
    return rows.select("doc_id")


@query(
    "segment_verdicts",
    """
select event_id, case when value > 60 and user_id % 3 = 0 and event_id % 2 = 0 then 'silence' when user_id % 3 = 0 then 'uncertain_speech' when value % 10 > 8 then 'repetitive_speech' when event_id % 5 = 0 then 'empty_speech' else 'accept' end as verdict from events
""",
)
def segment_verdicts(spark, sf_dir):
    ev = load(spark, sf_dir, "events")
    low = F.when(F.col("user_id") % 3 == 0, -2.0).otherwise(-0.1)
    ratio = F.when(F.col("value") % 10 > 8, 3.0).otherwise(1.0)
    quiet = F.when(F.col("value") > 60, 0.9).otherwise(0.1)
    text = F.when(F.col("event_id") % 5 == 0, "  ").otherwise("words")
    return ev.select("event_id", validation.segment_verdict(quiet, low, ratio, text, F.col("event_id") % 2 == 1).alias("verdict"))


@query(
    "public_export",
    """
with v as (select d.doc_id, d.source, l.quality from documents d join labels l using (doc_id)), c as (select conv_id as doc_id, count(*) as n, count(*) filter (where role = 'user') as users from conversations group by 1)
select v.source, count(*) as videos, count(c.doc_id) as with_comments, coalesce(sum(c.n), 0)::bigint as comments, coalesce(sum(c.users), 0)::bigint as user_comments, count(*) filter (where v.quality = 1) as publishable from v left join c using (doc_id) group by v.source
""",
)
def public_export(spark, sf_dir):
    """Allow-listed rollup of the public snapshot."""
    v = load(spark, sf_dir, "documents").select("doc_id", "source").join(load(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")
    c = load(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("doc_id")).agg(F.count("*").alias("n"), F.count_if(F.col("role") == "user").alias("users"))
    got = v.join(c, "doc_id", "left").groupBy("source").agg(F.count("*").alias("videos"), F.count("n").alias("with_comments"), F.coalesce(F.sum("n"), F.lit(0)).alias("comments"), F.coalesce(F.sum("users"), F.lit(0)).alias("user_comments"), F.count_if(F.col("quality") == 1).alias("publishable"))
    return got


@query("caption_coverage", "select lang, count(*) as sampled, count(*) filter (where quality = 1) as saved, count(*) filter (where toxic = 1 and quality is distinct from 1) as blocked, count(*) - count(*) filter (where quality = 1) as awaiting from documents left join labels using (doc_id) group by lang")
def caption_coverage(spark, sf_dir):
    d = load(spark, sf_dir, "documents").join(load(spark, sf_dir, "labels"), "doc_id", "left")
    saved = F.count_if(F.col("quality") == 1)
    return d.groupBy("lang").agg(F.count("*").alias("sampled"), saved.alias("saved"), F.count_if((F.col("toxic") == 1) & ~F.col("quality").eqNullSafe(F.lit(1))).alias("blocked"), (F.count("*") - saved).alias("awaiting"))
