"""Review, audit and publication queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from attesta.operators import filters, latest, ordered, rollups, sampling, state, validation, vectors
from attesta.sources import tables
from attesta.sources.tables import load

from .registry import query
from .vectors import clusters


@query("superseded_batches", "select o_orderkey from orders where o_orderkey not in (select o_orderkey - 1 from orders where o_orderstatus = 'P')")
def superseded_batches(spark, sf_dir):
    """Rows that no later row replaces: an anti self-join."""
    o = load(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    newer = o.where("o_orderstatus = 'P'").select((F.col("o_orderkey") - 1).alias("o_orderkey"))
    return o.join(newer, "o_orderkey", "left_anti").select("o_orderkey")


@query(
    "audit_checkpoint",
    """
select c.c_custkey, a.c_custkey is not null as checked, b.last as attempted, s.n as seen from customer c
left join (select c_custkey from customer where c_acctbal > 5000) a using (c_custkey)
left join (select o_custkey as c_custkey, max(o_orderdate) as last from orders group by 1) b using (c_custkey)
left join (select o_custkey as c_custkey, count(*) as n from orders where o_orderstatus = 'F' group by 1) s using (c_custkey)
""",
)
def audit_checkpoint(spark, sf_dir):
    """Three lookups per source: checked, attempted, seen."""
    c, o = load(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), load(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey")
    checked = c.where("c_acctbal > 5000").select("c_custkey", F.lit(True).alias("checked"))
    attempted = o.groupBy("c_custkey").agg(F.max("o_orderdate").alias("attempted"))
    seen = o.where("o_orderstatus = 'F'").groupBy("c_custkey").agg(F.count("*").alias("seen"))
    out = c.join(checked, "c_custkey", "left").join(attempted, "c_custkey", "left").join(seen, "c_custkey", "left")
    return out.select("c_custkey", F.coalesce("checked", F.lit(False)).alias("checked"), "attempted", "seen")


@query("audit_progress", "select lang, count(*) as target, least(count(*), count(*) filter (where quality is not null)) as completed from documents left join labels using (doc_id) group by lang")
def audit_progress(spark, sf_dir):
    d = load(spark, sf_dir, "documents").join(load(spark, sf_dir, "labels"), "doc_id", "left")
    return d.groupBy("lang").agg(F.count("*").alias("target"), F.least(F.count("*"), F.count("quality")).alias("completed"))


@query("radar_counts", "select lang, count(distinct source) as sources, count(distinct source) >= 15 as ready from documents group by lang")
def radar_counts(spark, sf_dir):
    got = load(spark, sf_dir, "documents").groupBy("lang").agg(F.count_distinct("source").alias("sources"))
    return got.withColumn("ready", F.col("sources") >= 15)


@query("refresh_report", "select user_id, count(*) as n, count(*) filter (where event_type = 'error') as pending, count(distinct event_type) as kinds from events group by user_id")
def refresh_report(spark, sf_dir):
    return load(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("pending"), F.count_distinct("event_type").alias("kinds"))


@query(
    "uncovered_days",
    """
with i as (select l_orderkey as k, date_diff('day', timestamp '1995-01-01', l_shipdate) as s, date_diff('day', timestamp '1995-01-01', l_shipdate) + l_quantity as e from lineitem),
r as (select k, min(s) as s, max(e) as e from i group by k), p as (select *, max(e) over (partition by k order by s, e rows between unbounded preceding and 1 preceding) as reach from i)
select r.k, round(coalesce(sum(case when p.s - p.reach > 0.02 then p.s - p.reach end), 0), 6)::double as uncovered, (r.e - r.s)::double as total from r join p using (k) group by r.k, r.e, r.s
""",
)
def uncovered_days(spark, sf_dir):
    """Seconds (here days) of a region that no segment covers, and in all."""
    l = load(spark, sf_dir, "lineitem")
    start = F.datediff("l_shipdate", F.lit("1995-01-01")).cast("double")
    seg = l.select(F.col("l_orderkey").alias("k"), start.alias("start"), (start + F.col("l_quantity")).alias("end"))
    regions = seg.groupBy("k").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    gaps = ordered.coverage_gaps(regions, seg, "k", 0.0).groupBy("k").agg(F.sum(F.col("gap_end") - F.col("gap_start")).alias("g"))
    return regions.join(gaps, "k", "left").select("k", F.round(F.coalesce("g", F.lit(0.0)), 6).alias("uncovered"), (F.col("end") - F.col("start")).alias("total"))


@query("review_facets", "select o_orderkey from orders where o_orderpriority in ('1-URGENT', '2-HIGH') and o_orderstatus = 'F' and contains(lower(concat_ws(' ', o_orderpriority, o_orderstatus, cast(o_custkey as varchar))), '1-u')")
def review_facets(spark, sf_dir):
    """Workload, status and text facets in conjunction."""
    o = load(spark, sf_dir, "orders")
    body = F.lower(F.concat_ws(" ", "o_orderpriority", "o_orderstatus", F.col("o_custkey").cast("string")))
    checks = {"workload": F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "status": F.col("o_orderstatus") == "F", "type": None, "text": F.contains(body, F.lit("1-u"))}
    return o.where(filters.facets(checks)).select("o_orderkey")


@query("status_distribution", "select string_agg(k || '=' || n, ',' order by k) as scores, sum(n)::bigint as total from (select coalesce(cast(quality as varchar), 'null') as k, count(*) as n from documents left join labels using (doc_id) group by 1)")
def status_distribution(spark, sf_dir):
    """Counts by stringified score, unscored included."""
    d = load(spark, sf_dir, "documents").join(load(spark, sf_dir, "labels"), "doc_id", "left")
    n = d.groupBy(F.coalesce(F.col("quality").cast("string"), F.lit("null")).alias("k")).agg(F.count("*").alias("n"))
    got = n.agg(rollups.ordered_map(F.col("k"), F.col("n")).alias("m"), F.sum("n").alias("total"))
    return got.select(F.array_join(F.transform(F.map_entries("m"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",").alias("scores"), "total")


@query("disjoint_labels", "with r as (select conv_id, list_distinct(list(role)) as roles from conversations group by conv_id) select a.conv_id, len(list_intersect(a.roles, b.roles)) = 0 and len(a.roles) > 0 and len(b.roles) > 0 as disjoint from r a join r b on b.conv_id = a.conv_id + 3")
def disjoint_labels(spark, sf_dir):
    r = load(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.collect_set("role").alias("roles"))
    b = r.select((F.col("conv_id") - 3).alias("conv_id"), F.col("roles").alias("other"))
    return r.join(b, "conv_id").select("conv_id", (~F.arrays_overlap("roles", "other") & (F.size("roles") > 0) & (F.size("other") > 0)).alias("disjoint"))


@query("collated_order", "select n_name, row_number() over (order by lower(n_name), n_name) as place from nation")
def collated_order(spark, sf_dir):
    """Locale order of names; binary order is the default elsewhere."""
    n = load(spark, sf_dir, "nation").select("n_name")
    return n.withColumn("place", F.row_number().over(Window.orderBy(F.collate("n_name", "UNICODE"))))


@query("classification_order", "select doc_id, row_number() over (order by case when contains(lower(text), 'license') then 0 when lang = 'en' then 1 else 2 end, sha256(cast(doc_id as varchar))) as place from documents")
def classification_order(spark, sf_dir):
    """Priority bucket, then hash."""
    d = load(spark, sf_dir, "documents")
    bucket = F.when(F.contains(F.lower("text"), F.lit("license")), 0).when(F.col("lang") == "en", 1).otherwise(2)
    rows = d.select("doc_id", bucket.alias("bucket"), F.sha2(F.col("doc_id").cast("string"), 256).alias("h"))
    return sampling.placed_by_hash(rows, "bucket", "h", "doc_id").select("doc_id", "place")


@query("valid_reviews", "select doc_id from labels where doc_id % 3 = 0 or doc_id % 3 = 1")
def valid_reviews(spark, sf_dir):
    """Reviews of the current label: by hash, or where only comments changed."""
    l = load(spark, sf_dir, "labels").select("doc_id", "quality", F.lit("new").alias("comments"), F.sha2(F.concat_ws(":", "doc_id", "quality"), 256).alias("label_hash"))
    r = l.select("doc_id", F.when(F.col("doc_id") % 3 == 2, F.col("quality") + 5).otherwise(F.col("quality")).alias("quality"), F.lit("old").alias("comments"), F.when(F.col("doc_id") % 3 == 0, F.col("label_hash")).otherwise("x").alias("label_hash"))
    return latest.valid_for_current(r, l, "doc_id", "comments").select("doc_id")


@query("single_requeue", "select doc_id, case when doc_id = 4 then 'pending' else 'provisional' end as status from labels")
def single_requeue(spark, sf_dir):
    l = load(spark, sf_dir, "labels").select("doc_id", F.col("doc_id").cast("string").alias("id"), F.lit("provisional").alias("status"), F.lit("u").alias("url"))
    return state.single_requeue(l, {"id": "4", "url": "u", "status": "provisional"}).select("doc_id", "status")


@query("camera_availability", "select event_id from events where event_type <> 'error' and ts > timestamp '2024-01-29' and user_id % 2 = 0")
def camera_availability(spark, sf_dir):
    ev = load(spark, sf_dir, "events")
    id_ = F.when(F.col("user_id") % 2 == 0, "abcdefghij-").otherwise("short")
    return ev.where(filters.camera_available(F.col("event_type") != "error", id_, F.col("ts"), F.lit("2024-01-31").cast("timestamp"))).select("event_id")


@query("cooldown_queue", "select user_id, last_try from (select user_id, max(ts) filter (where event_type = 'error') as last_try, bool_or(event_type = 'error' and value > 40) as bad from events group by user_id) where last_try is null or last_try + case when bad then interval 7 days else interval 1 day end <= timestamp '2024-01-29'")
def cooldown_queue(spark, sf_dir):
    """Untried first, then past their waiting time."""
    ev = load(spark, sf_dir, "events")
    u = ev.groupBy("user_id").agg(F.expr("max(ts) filter (where event_type = 'error')").alias("last_try"), F.bool_or(F.expr("event_type = 'error' and value > 40")).alias("bad"))
    return u.where(filters.cooled_down(F.col("last_try"), F.col("bad"), F.lit("2024-01-29").cast("timestamp"))).orderBy(F.asc_nulls_first("last_try"), "user_id").select("user_id", "last_try")


@query("retained_weeks", "select distinct strftime(o_orderdate, '%G-W%V') as week from orders where date_trunc('week', o_orderdate) between timestamp '1998-01-21' - interval 30 days and timestamp '1998-01-21' + interval 7 days")
def retained_weeks(spark, sf_dir):
    from attesta.functions.scalar import iso_week

    o = load(spark, sf_dir, "orders").select(iso_week(F.col("o_orderdate")).alias("week")).distinct()
    return o.where(filters.retained_week(F.col("week"), F.lit("1998-01-21").cast("date")))


@query("precision_window", "select event_id from events where case when event_id % 2 = 0 then (ts + interval 1 hour)::date between date '2024-01-05' and date '2024-01-07' else ts between timestamp '2024-01-05 08:00:00' and timestamp '2024-01-07 08:00:00' end")
def precision_window(spark, sf_dir):
    """Day-precise rows compare local days, others instants."""
    ev = load(spark, sf_dir, "events")
    t = lambda s: F.lit(s).cast("timestamp")
    zone = F.lit("Europe/Amsterdam")
    day = F.to_date(F.from_utc_timestamp("ts", zone))
    precision = F.when(F.col("event_id") % 2 == 0, "day").otherwise("instant")
    return ev.where(filters.in_window(day, F.col("ts"), precision, t("2024-01-05 08:00:00"), t("2024-01-07 08:00:00"), zone)).select("event_id")


@query("allow_list", "select doc_id, lang from documents")
def allow_list(spark, sf_dir):
    return filters.allow(load(spark, sf_dir, "documents"), ["doc_id", "lang", "secret"])


@query("merge_precedence", "select doc_id, case when doc_id % 3 = 0 then null when doc_id % 3 = 1 then 'right' else lang end as lang from documents")
def merge_precedence(spark, sf_dir):
    """An explicit null of the right side wins; a missing key does not."""
    d = load(spark, sf_dir, "documents")
    right = F.when(F.col("doc_id") % 3 == 1, "right")
    return d.select("doc_id", filters.merged_value(right, F.col("doc_id") % 3 < 2, F.col("lang")).alias("lang"))


@query("cluster_relation_rules", "select doc_id, case when quality = 1 and toxic = 1 then 'unrelated but labelled' else '' end as errors from labels")
def cluster_relation_rules(spark, sf_dir):
    """Closed rules of a topic label: unrelated labels carry no topics."""
    none = F.array().cast("array<string>")
    l = load(spark, sf_dir, "labels").select(
        "doc_id",
        F.when(F.col("toxic") == 1, "unrelated").otherwise("related").alias("relevance"),
        F.when((F.col("toxic") == 0) | (F.col("quality") == 1), F.array(F.lit("security"))).otherwise(none).alias("topics"),
        none.alias("roles"),
        F.lit(None).cast("string").alias("quote"),
        F.lit("").alias("source_text"),
    )
    return l.select("doc_id", F.array_join(validation.errors(validation.label_rules(["security"], ["actor"])), ",").alias("errors"))


@query(
    "nearest_classified",
    clusters("vec_id % 5", 0.3)
    + """, r as (select g, cluster, min(vec_id) as rep from k group by 1, 2)
select k.vec_id, e.label as taken, case when k.vec_id = rep then 'direct' else 'propagated' end as provenance from k join r using (g, cluster) join embeddings e on e.vec_id = rep""",
)
def nearest_classified(spark, sf_dir):
    """Every row takes the label of its cluster's representative."""
    e = load(spark, sf_dir, "embeddings").withColumn("video", F.col("vec_id") % 5)
    members = vectors.representatives(vectors.complete_link(e, "video", "vec_id", "embedding", 0.3), "video", "vec_id")
    return members.join(e.select(F.col("vec_id").alias("representative"), F.col("label").alias("taken")), "representative").select("vec_id", "taken", "provenance")


@query("pooled_comments", "select conv_id, turn from (select conv_id, turn, row_number() over (partition by conv_id order by turn) as nth from conversations) where nth <= 3")
def pooled_comments(spark, sf_dir):
    """First comments of each pool in page order."""
    return tables.pool_first(load(spark, sf_dir, "conversations").select("conv_id", "turn"), "conv_id", "turn", "turn", 3).select("conv_id", "turn")


@query("cached_requests", "select doc_id, doc_id % 2 = 0 as cached from documents")
def cached_requests(spark, sf_dir):
    d = load(spark, sf_dir, "documents").select(F.sha2(F.col("doc_id").cast("string"), 256).alias("digest"), "doc_id")
    known, open_ = tables.cached_fetch(d, d.where("doc_id % 2 = 0").select("digest"))
    return known.select("doc_id", F.lit(True).alias("cached")).union(open_.select("doc_id", F.lit(False)))


@query("content_build_id", "select substr(sha256(string_agg(n_name, '' order by lpad(cast(n_nationkey as varchar), 3, '0'))), 1, 16) as build_id from nation")
def content_build_id(spark, sf_dir):
    n = load(spark, sf_dir, "nation").select(F.lpad(F.col("n_nationkey").cast("string"), 3, "0").alias("name"), F.col("n_name").alias("content"))
    return tables.build_id(n)
