"""Relational queries: filters, latest versions, joins, aggregates, rollups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.operators import filters, latest, rollups
from attesta.sources.tables import keyset_page, load

from .registry import query

TS = "cast(ts as timestamp)"


@query(
    "review_population",
    """
with eligible as (select d.doc_id, d.source from documents d join labels l using (doc_id) where l.quality = 1),
roles as (select conv_id as doc_id, count(*) as n_comments, string_agg(distinct role, ',' order by role) as roles from conversations group by conv_id),
pop as (select e.doc_id, coalesce(r.n_comments, 0) as n_comments, coalesce(r.roles, '') as roles, sha256('20261004:2026-W40:' || cast(e.doc_id as varchar)) as h
        from eligible e left join roles r using (doc_id)),
target as (select least(count(*), greatest(5, cast(ceil(0.06 * count(*)) as bigint))) as n from pop),
forced as (select doc_id from (select doc_id, row_number() over (partition by n_comments > 0 order by h, doc_id) as rn from pop) where rn = 1),
ranked as (select p.*, row_number() over (order by case when f.doc_id is null then 1 else 0 end, h, p.doc_id) as place from pop p left join forced f using (doc_id))
select doc_id, n_comments, roles, place from ranked, target where place <= n
""",
)
def review_population(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeded hash-rank plan over eligible documents with both comment strata."""
    from attesta.operators.sampling import hash_plan

    docs = load(spark, sf_dir, "documents").select("doc_id")
    good = load(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    roles = load(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("doc_id")).agg(F.count("*").alias("n_comments"), F.array_join(F.sort_array(F.collect_set("role")), ",").alias("roles"))
    pop = docs.join(good, "doc_id").join(roles, "doc_id", "left").withColumn("n_comments", F.coalesce("n_comments", F.lit(0))).withColumn("roles", F.coalesce("roles", F.lit("")))
    return hash_plan(pop, "doc_id", "20261004:2026-W40", 0.06, 5, F.col("n_comments") > 0).select("doc_id", "n_comments", "roles", "place")


@query("latest_per_key", "select user_id, event_id, event_type from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) rn from events where event_type <> 'view') where rn = 1")
def latest_per_key(spark, sf_dir):
    """Filter first, then the latest row of each key."""
    ev = load(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "ts")
    return latest.filter_then_latest(ev, ["user_id"], ["ts", "event_id"], F.col("event_type") != "view").select("user_id", "event_id", "event_type")


@query("latest_then_filter", "select user_id, event_id from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) rn from events) where rn = 1 and event_type <> 'error'")
def latest_then_filter(spark, sf_dir):
    ev = load(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "ts")
    return latest.latest_then_filter(ev, ["user_id"], ["ts", "event_id"], F.col("event_type") != "error").select("user_id", "event_id")


@query("sticky_latest", "select user_id, event_id, event_type from (select *, row_number() over (partition by user_id order by (event_type <> 'error') desc, ts desc, event_id desc) rn from events) where rn = 1")
def sticky_latest(spark, sf_dir):
    ev = load(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "ts")
    return latest.sticky_latest(ev, ["user_id"], F.col("event_type") != "error", ["ts", "event_id"]).select("user_id", "event_id", "event_type")


@query("first_wins_dedupe", "select user_id, event_type, event_id from (select *, row_number() over (partition by user_id, event_type order by event_id) rn from events) where rn = 1")
def first_wins_dedupe(spark, sf_dir):
    ev = load(spark, sf_dir, "events").select("user_id", "event_type", "event_id")
    return latest.first_per_key(ev, ["user_id", "event_type"], ["event_id"])


@query("last_wins_dedupe", "select user_id, event_type, event_id from (select *, row_number() over (partition by user_id, event_type order by event_id desc) rn from events) where rn = 1")
def last_wins_dedupe(spark, sf_dir):
    ev = load(spark, sf_dir, "events").select("user_id", "event_type", "event_id")
    return latest.latest_per_key(ev, ["user_id", "event_type"], ["event_id"])


@query(
    "latest_review",
    "select user_id, event_id from (select *, row_number() over (partition by user_id order by case when event_id % 3 = 0 then null else ts end desc nulls last, sha256(cast(event_id as varchar)) desc) rn from events) where rn = 1",
)
def latest_review(spark, sf_dir):
    """Stamps that do not parse lose; the digest breaks ties."""
    ev = load(spark, sf_dir, "events").select("user_id", "event_id", F.when(F.col("event_id") % 3 == 0, "not a date").otherwise(F.col("ts").cast("string")).alias("stamp"), F.sha2(F.col("event_id").cast("string"), 256).alias("digest"))
    return latest.latest_review(ev, ["user_id"], "stamp", "digest").select("user_id", "event_id")


@query(
    "latest_snapshot",
    "select user_id, event_id from (select *, row_number() over (partition by user_id order by strftime(ts, '%Y-%m') || '|' || case when event_type = 'view' then '' else strftime(ts, '%d') end desc, event_id) rn from events) where rn = 1",
)
def latest_snapshot(spark, sf_dir):
    """Greatest batch|captured text; the first position wins ties."""
    ev = load(spark, sf_dir, "events").select("user_id", "event_id", F.date_format("ts", "yyyy-MM").alias("batch"), F.when(F.col("event_type") != "view", F.date_format("ts", "dd")).alias("captured"))
    return latest.latest_snapshot(ev, "user_id", "batch", "captured", "event_id").select("user_id", "event_id")


@query(
    "union_distinct_on",
    """
with a as (select user_id, event_id from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) rn from events where event_type = 'click') where rn = 1),
b as (select user_id, event_id from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) rn from events where event_type in ('click', 'purchase')) where rn = 1)
select user_id, event_id from a union select user_id, event_id from b
""",
)
def union_distinct_on(spark, sf_dir):
    ev = load(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "ts")
    parts = [latest.filter_then_latest(ev, ["user_id"], ["ts", "event_id"], c).select("user_id", "event_id") for c in (F.col("event_type") == "click", F.col("event_type").isin("click", "purchase"))]
    return latest.union_latest(parts, "event_id")


@query("min_threshold_row", "select o_custkey, o_orderkey from (select *, row_number() over (partition by o_custkey order by o_totalprice, o_orderkey) rn from orders) where rn = 1")
def min_threshold_row(spark, sf_dir):
    """The row with the smallest threshold of each key."""
    rows = load(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.struct("o_totalprice", "o_orderkey").alias("least"))
    return latest.union_min_threshold(rows, "o_custkey", "least").select("o_custkey", "o_orderkey")


@query("json_key_filter", "select event_id, cast(props->>'k' as bigint) as k from events where json_exists(props, '$.k') and cast(props->>'k' as bigint) >= 50")
def json_key_filter(spark, sf_dir):
    """Key existence in a payload, then a strict integer."""
    ev = load(spark, sf_dir, "events")
    rows = ev.where(filters.tagged(F.col("props"), ["k", "missing"])).withColumn("v", F.try_parse_json("props"))
    rows = rows.where(F.schema_of_variant(F.try_variant_get("v", "$.k", "variant")) == "BIGINT")
    return rows.select("event_id", F.try_variant_get("v", "$.k", "bigint").alias("k")).where("k >= 50")


@query(
    "null_safe_conflict",
    """
with old as (select o_orderkey, case when o_orderkey % 7 = 0 then null else o_orderstatus end s from orders),
new as (select o_orderkey, case when o_orderkey % 5 = 0 then null else o_orderstatus end s from orders)
select old.o_orderkey from old join new using (o_orderkey) where old.s is distinct from new.s
""",
)
def null_safe_conflict(spark, sf_dir):
    o = load(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    old = o.select("o_orderkey", F.expr("case when o_orderkey % 7 = 0 then null else o_orderstatus end").alias("a"))
    new = o.select("o_orderkey", F.expr("case when o_orderkey % 5 = 0 then null else o_orderstatus end").alias("b"))
    return old.join(new, "o_orderkey").where(filters.distinct_from(F.col("a"), F.col("b"))).select("o_orderkey")


@query("request_conflicts", "select o_custkey, count(distinct o_orderstatus) as n_status from orders group by o_custkey having count(distinct o_orderstatus) > 1")
def request_conflicts(spark, sf_dir):
    """Ids with more than one payload within one request."""
    o = load(spark, sf_dir, "orders")
    return o.groupBy("o_custkey").agg(F.count_distinct("o_orderstatus").alias("n_status")).where("n_status > 1")


@query("half_open_window", "select o_orderkey, strftime(o_orderdate, '%G-W%V') as week from orders where o_orderdate >= timestamp '1998-01-01' and o_orderdate < timestamp '1998-02-01'")
def half_open_window(spark, sf_dir):
    from attesta.functions.scalar import iso_week

    o = load(spark, sf_dir, "orders")
    return o.where(filters.half_open(F.col("o_orderdate"), "1998-01-01", "1998-02-01")).select("o_orderkey", iso_week(F.col("o_orderdate")).alias("week"))


@query(
    "date_facets",
    """
select o.o_orderkey, o.o_orderdate >= timestamp '2001-07-25' and o.o_orderdate < timestamp '2001-08-01' as in_week,
  o.o_orderdate >= timestamp '2001-07-20' and o.o_orderdate < timestamp '2001-07-24' as in_custom
from orders o join customer c on o.o_custkey = c.c_custkey where c.c_mktsegment = 'BUILDING' and o.o_orderdate >= timestamp '2001-07-01'
""",
)
def date_facets(spark, sf_dir):
    o = load(spark, sf_dir, "orders").where(F.col("o_orderdate") >= F.lit("2001-07-01").cast("timestamp"))
    c = load(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    now = F.lit("2001-08-01").cast("timestamp")
    rows = o.join(c, o["o_custkey"] == c["c_custkey"]).where(filters.facets({"segment": F.col("c_mktsegment") == "BUILDING", "all": filters.date_facet(F.col("o_orderdate"), "all", now)}))
    return rows.select("o_orderkey", filters.date_facet(F.col("o_orderdate"), "week", now).alias("in_week"), filters.date_facet(F.col("o_orderdate"), "custom", now, "2001-07-20", "2001-07-23").alias("in_custom"))


@query(
    "publishable_filter",
    """
select d.doc_id, case when l.quality = 1 then 'saved' when l.toxic = 1 then 'blocked' when d.n_chars < 600 then 'unavailable' else 'unverified' end as state
from documents d left join labels l using (doc_id) where d.lang = 'en' and trim(d.text) <> ''
""",
)
def publishable_filter(spark, sf_dir):
    d = load(spark, sf_dir, "documents").where((F.col("lang") == "en") & (F.trim("text") != "")).select("doc_id", "n_chars")
    rows = d.join(load(spark, sf_dir, "labels"), "doc_id", "left")
    state = filters.caption_state(F.col("quality") == 1, F.lit(False), F.col("toxic") == 1, F.col("n_chars") < 600)
    return rows.select("doc_id", state.alias("state"))


@query("semi_eligible", "select c_custkey from customer where exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'F')")
def semi_eligible(spark, sf_dir):
    c, o = load(spark, sf_dir, "customer").select("c_custkey"), load(spark, sf_dir, "orders").where("o_orderstatus = 'F'")
    return c.join(o.select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi")


@query("anti_finished", "select c_custkey from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'F') and not exists (select 1 from orders where o_custkey = c_custkey and o_orderpriority = '1-URGENT')")
def anti_finished(spark, sf_dir):
    """Exclusion by two key shapes."""
    c, o = load(spark, sf_dir, "customer").select("c_custkey"), load(spark, sf_dir, "orders")
    for cond in ("o_orderstatus = 'F'", "o_orderpriority = '1-URGENT'"):
        c = c.join(o.where(cond).select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")
    return c


@query("exists_state", "select c_custkey, case when exists (select 1 from orders where o_custkey = c_custkey and o_orderpriority = '1-URGENT') then 'saved' else 'unverified' end as state from customer")
def exists_state(spark, sf_dir):
    load(spark, sf_dir, "customer").createOrReplaceTempView("attesta_customer")
    load(spark, sf_dir, "orders").createOrReplaceTempView("attesta_orders")
    return spark.sql("select c_custkey, case when exists (select 1 from attesta_orders where o_custkey = c_custkey and o_orderpriority = '1-URGENT') then 'saved' else 'unverified' end as state from attesta_customer")


@query(
    "scalar_progress",
    """
select n_nationkey, coalesce((select count(*) from customer where c_nationkey = n_nationkey), 0) as customers,
  coalesce((select count(*) from supplier where s_nationkey = n_nationkey), 0) as suppliers,
  coalesce((select count(*) from customer join orders on o_custkey = c_custkey where c_nationkey = n_nationkey), 0) as orders from nation
""",
)
def scalar_progress(spark, sf_dir):
    n = load(spark, sf_dir, "nation").select("n_nationkey")
    c = load(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey"))
    o = load(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("k"))
    per = c.join(o, "c_custkey").groupBy("n_nationkey").agg(F.sum("k").alias("orders"))
    out = rollups.progress(n, "n_nationkey", {"customers": c, "suppliers": load(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("n_nationkey"))})
    return out.join(per, "n_nationkey", "left").withColumn("orders", F.coalesce("orders", F.lit(0)))


@query(
    "coverage_by_array",
    "select array_to_string(tags, ',') as tags, source, count(*) as n from (select source, list_sort(list_distinct([lang, case when n_chars > 2000 then 'long' else 'short' end])) as tags from documents) group by tags, source",
)
def coverage_by_array(spark, sf_dir):
    """Grouping on an array value."""
    d = load(spark, sf_dir, "documents")
    tags = F.array_sort(F.array_distinct(F.array("lang", F.when(F.col("n_chars") > 2000, "long").otherwise("short"))))
    return d.groupBy(tags.alias("tags"), "source").agg(F.count("*").alias("n")).select(F.array_join("tags", ",").alias("tags"), "source", "n")


@query("ordered_json_agg", "select conv_id, string_agg(cast(turn as varchar) || ':' || role, ',' order by turn) as turns from conversations group by conv_id")
def ordered_json_agg(spark, sf_dir):
    c = load(spark, sf_dir, "conversations")
    text = F.concat_ws(":", F.col("turn").cast("string"), "role")
    return c.groupBy("conv_id").agg(F.array_join(rollups.ordered_list(text, F.col("turn")), ",").alias("turns"))


@query("object_agg", "select conv_id, string_agg(role || '=' || cast(n as varchar), ',' order by role) as roles from (select conv_id, role, count(*) as n from conversations group by conv_id, role) group by conv_id")
def object_agg(spark, sf_dir):
    c = load(spark, sf_dir, "conversations").groupBy("conv_id", "role").agg(F.count("*").alias("n"))
    got = c.groupBy("conv_id").agg(rollups.ordered_map(F.col("role"), F.col("n")).alias("m"))
    return got.select("conv_id", F.array_join(F.transform(F.map_entries("m"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",").alias("roles"))


@query("filtered_distinct_agg", "select conv_id, coalesce(string_agg(distinct role, ',' order by role) filter (where length(text) > 400), '') as roles from conversations group by conv_id")
def filtered_distinct_agg(spark, sf_dir):
    c = load(spark, sf_dir, "conversations")
    return c.groupBy("conv_id").agg(F.expr("array_join(sort_array(collect_set(role) filter (where length(text) > 400)), ',')").alias("roles"))


@query("lateral_outer_unnest", "select n.n_name, s.s_name from nation n left join lateral (select s_name from supplier where s_nationkey = n.n_nationkey and s_acctbal > 5000) s on true")
def lateral_outer_unnest(spark, sf_dir):
    """Keeps rows whose array is empty."""
    n = load(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    s = load(spark, sf_dir, "supplier").where("s_acctbal > 5000").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.collect_list("s_name").alias("names"))
    return n.join(s, "n_nationkey", "left").select("n_name", F.explode_outer("names").alias("s_name"))


@query(
    "known_counter_sums",
    "select o_custkey, sum(case when o_orderkey % 3 = 0 then null else cast(floor(o_totalprice) as bigint) end)::bigint as views, count(case when o_orderkey % 3 = 0 then null else 1 end) as views_known from orders group by o_custkey",
)
def known_counter_sums(spark, sf_dir):
    o = load(spark, sf_dir, "orders")
    value = F.when(F.col("o_orderkey") % 3 != 0, F.expr("cast(floor(o_totalprice) as bigint)"))
    return o.groupBy("o_custkey").agg(*rollups.known_sum(value, "views"))


@query(
    "response_rollup",
    """
with t as (select * from (values ('view'), ('click'), ('error'), ('purchase'), ('signup'), ('none')) v(event_type)),
c as (select event_type, case when value >= 20 then 'high' else 'low' end as level, count(*) as n from events group by 1, 2)
select t.event_type, l.level, coalesce(c.n, 0) as n from t cross join (values ('high'), ('low'), ('unclear')) l(level) left join c on c.event_type = t.event_type and c.level = l.level
""",
)
def response_rollup(spark, sf_dir):
    ev = load(spark, sf_dir, "events").select("event_type", F.when(F.col("value") >= 20, "high").otherwise("low").alias("level"))
    kinds = spark.createDataFrame([(a, b) for a in ("view", "click", "error", "purchase", "signup", "none") for b in ("high", "low", "unclear")], "event_type string, level string")
    return rollups.zero_filled(rollups.cross_tab(ev, "event_type", "level"), kinds, ["event_type", "level"])


@query("joint_or_null", "select user_id, case when user_id % 2 = 0 then count(*) filter (where event_type = 'click' and value > 10) when count(*) > 0 then null else 0 end as joint from events group by user_id")
def joint_or_null(spark, sf_dir):
    ev = load(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("total"), F.count_if(F.expr("event_type = 'click' and value > 10")).alias("j"))
    return ev.select("user_id", rollups.joint_or_null(F.when(F.col("user_id") % 2 == 0, F.col("j")), F.col("total")).alias("joint"))


@query(
    "overlap_ranking",
    """
select n_name, count(distinct o.o_custkey) as n, round(100.0 * count(distinct o.o_custkey) / (select count(distinct o_custkey) from orders), 6) as pct
from nation left join (select o_custkey, c_nationkey from orders join customer on o_custkey = c_custkey where o_orderpriority = '1-URGENT') o on o.c_nationkey = n_nationkey group by n_name
""",
)
def overlap_ranking(spark, sf_dir):
    n = load(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    o, c = load(spark, sf_dir, "orders"), load(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey"))
    total = o.agg(F.count_distinct("o_custkey").alias("total"))
    members = o.where("o_orderpriority = '1-URGENT'").join(c, F.col("o_custkey") == F.col("c_custkey")).select("n_nationkey", "o_custkey")
    dim = n.crossJoin(F.broadcast(total))
    return rollups.overlap_ranking(dim, "n_nationkey", "n_name", members, "o_custkey", F.col("total")).select("n_name", "n", F.round("pct", 6).alias("pct"))


@query("multilabel_topics", "select topic, count(*) as n from (select unnest(list_distinct([p_type, split_part(p_name, ' ', 1), split_part(p_name, ' ', 2)])) as topic from part) group by topic order by n desc, topic limit 7")
def multilabel_topics(spark, sf_dir):
    p = load(spark, sf_dir, "part")
    words = F.split("p_name", " ")
    topics = p.select(F.explode(F.array_distinct(F.array("p_type", words[0], words[1]))).alias("topic"))
    return topics.groupBy("topic").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "topic").limit(7)


@query(
    "role_and_status_counts",
    "select count(*) as total, count(*) filter (where o_orderstatus = 'F') as finished, count(*) filter (where o_orderstatus = 'O') as open, count(*) - count(*) filter (where o_orderstatus in ('F', 'O')) as pending, count(distinct o_custkey) filter (where o_orderpriority = '1-URGENT') as urgent_customers from orders",
)
def role_and_status_counts(spark, sf_dir):
    """Status counts; pending is the remainder."""
    return load(spark, sf_dir, "orders").agg(
        F.count("*").alias("total"),
        F.count_if(F.col("o_orderstatus") == "F").alias("finished"),
        F.count_if(F.col("o_orderstatus") == "O").alias("open"),
        (F.count("*") - F.count_if(F.col("o_orderstatus").isin("F", "O"))).alias("pending"),
        F.expr("count(distinct o_custkey) filter (where o_orderpriority = '1-URGENT')").alias("urgent_customers"),
    )


@query(
    "agreement_metrics",
    """
with p as (select d.lang, l.quality as a, case when d.n_chars > 500 then 1 else 0 end as b from labels l join documents d using (doc_id))
select lang, count(*) as n, round(avg(case when a = b then 1.0 else 0.0 end), 9) as exact, round(avg(abs(a - b)), 9) as mae,
  round(sum(case when a > 0 and b > 0 then 1 else 0 end) / nullif(sum(case when a > 0 then 1 else 0 end), 0), 9) as precision,
  round(sum(case when a > 0 and b > 0 then 1 else 0 end) / nullif(sum(case when b > 0 then 1 else 0 end), 0), 9) as recall from p group by lang
""",
)
def agreement_metrics(spark, sf_dir):
    d = load(spark, sf_dir, "documents").select("doc_id", "lang", F.when(F.col("n_chars") > 500, 1).otherwise(0).alias("b"))
    p = load(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("a")).join(d, "doc_id")
    got = rollups.agreement(p, "a", "b", ["lang"])
    return got.select("lang", "n", *(F.round(c, 9).alias(c) for c in ("exact", "mae", "precision", "recall")))


@query(
    "confusion_grid",
    "select q.a, t.b, count(l.doc_id) as n from (values (0), (1), (2)) q(a) cross join (values (0), (1), (2)) t(b) left join labels l on l.quality = q.a and l.toxic = t.b group by q.a, t.b",
)
def confusion_grid(spark, sf_dir):
    l = load(spark, sf_dir, "labels").select(F.col("quality").alias("a"), F.col("toxic").alias("b"))
    return rollups.confusion(l, "a", "b", 2)


@query(
    "set_jaccard",
    """
with r as (select conv_id, list_distinct(list(role)) as roles from conversations group by conv_id)
select a.conv_id, round(case when len(list_distinct(list_concat(a.roles, b.roles))) = 0 then 1.0 else len(list_intersect(a.roles, b.roles)) / len(list_distinct(list_concat(a.roles, b.roles))) end, 9) as jaccard
from r a join r b on b.conv_id = a.conv_id + 1
""",
)
def set_jaccard(spark, sf_dir):
    r = load(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.collect_set("role").alias("roles"))
    b = r.select((F.col("conv_id") - 1).alias("conv_id"), F.col("roles").alias("other"))
    return r.join(b, "conv_id").select("conv_id", F.round(rollups.jaccard(F.col("roles"), F.col("other")), 9).alias("jaccard"))


@query(
    "hhi_concentration",
    """
with c as (select event_type, user_id, count(*) as c from events group by all), s as (select event_type, count(*) as n, sum(c * c)::double as sq, sum(c)::double as total from c group by event_type)
select event_type, n, round(case when n <= 1 then 0 else (sq / (total * total) - 1.0::double / n) / (1 - 1.0::double / n) end, 9) as hhi from s
""",
)
def hhi_concentration(spark, sf_dir):
    got = rollups.concentration(load(spark, sf_dir, "events"), ["event_type"], "user_id")
    return got.withColumn("hhi", F.round("hhi", 9))


@query("majority_label", "select user_id, event_type as majority, n from (select user_id, event_type, count(*) as n, row_number() over (partition by user_id order by count(*) desc, min(event_id)) as rn from events group by user_id, event_type) where rn = 1")
def majority_label(spark, sf_dir):
    return rollups.majority(load(spark, sf_dir, "events"), ["user_id"], "event_type", "event_id")


@query(
    "weighted_score",
    """
with s as (select c_custkey, ln(1 + greatest(c_acctbal, 0)) / ln(1 + 10000.0) as a, case when c_nationkey % 4 = 0 then null else c_nationkey / 25.0 end as b, 0.5 as c from customer)
select c_custkey, round((0.25 * least(1, a) + coalesce(0.35 * b, 0) + 0.2 * c) / (0.25 + case when b is null then 0 else 0.35 end + 0.2), 6) as score, round((a + coalesce(b, 0) + c) / 3, 6) as mean from s
""",
)
def weighted_score(spark, sf_dir):
    c = load(spark, sf_dir, "customer")
    bal = F.greatest(F.col("c_acctbal"), F.lit(0.0))
    b = F.when(F.col("c_nationkey") % 4 != 0, F.col("c_nationkey") / 25.0)
    score = rollups.weighted_mean([(rollups.log_share(bal, 10_000), 0.25), (b, 0.35), (F.lit(0.5), 0.2)])
    mean, _ = rollups.framing_score([F.log1p(bal) / F.log1p(F.lit(10_000.0)), F.coalesce(b, F.lit(0.0)), F.lit(0.5)])
    return c.select("c_custkey", F.round(score, 6).alias("score"), F.round(mean, 6).alias("mean"))


@query(
    "framing_scores",
    "select doc_id, round((quality + toxic + 2) / 3.0, 9) as score, quality >= 2 and toxic >= 2 as strong from labels",
)
def framing_scores(spark, sf_dir):
    mean, strong = rollups.framing_score([F.col("quality"), F.col("toxic"), F.lit(2)])
    return load(spark, sf_dir, "labels").select("doc_id", F.round(mean, 9).alias("score"), strong.alias("strong"))


@query(
    "cost_rollup",
    "select event_type as kind, round(sum(value), 4) as amount, round(sum(case when event_type in ('click', 'error') then value else 0 end), 4) as reserved, bool_or(value > 90) as any_large, bool_and(value >= 0) as all_known from events group by event_type",
)
def cost_rollup(spark, sf_dir):
    return load(spark, sf_dir, "events").groupBy(F.col("event_type").alias("kind")).agg(
        F.round(F.sum("value"), 4).alias("amount"),
        F.round(F.sum(F.when(F.col("event_type").isin("click", "error"), F.col("value")).otherwise(0.0)), 4).alias("reserved"),
        F.bool_or(F.col("value") > 90).alias("any_large"),
        F.bool_and(F.col("value") >= 0).alias("all_known"),
    )


@query(
    "reconcile_counts",
    """
select * from (values ('customers have nations', (select count(*) = (select count(*) from customer join nation on c_nationkey = n_nationkey) from customer)),
 ('statuses partition orders', (select count(*) = count(*) filter (where o_orderstatus = 'F') + count(*) filter (where o_orderstatus = 'O') + count(*) filter (where o_orderstatus = 'P') from orders)),
 ('toxic within labels', (select count(*) filter (where toxic = 1) <= count(*) from labels)),
 ('every label has a document', (select count(*) = 0 from labels where doc_id not in (select doc_id from documents)))) v("check", passed)
""",
)
def reconcile_counts(spark, sf_dir):
    c, n, o = load(spark, sf_dir, "customer"), load(spark, sf_dir, "nation"), load(spark, sf_dir, "orders")
    l, d = load(spark, sf_dir, "labels"), load(spark, sf_dir, "documents").select("doc_id")
    customers = rollups.reconcile([("customers have nations", F.col("x") == F.col("y"))], c.join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left").agg(F.count("*").alias("x"), F.count("n_nationkey").alias("y")))
    orders = rollups.reconcile([("statuses partition orders", F.col("x") == F.col("f") + F.col("o") + F.col("p"))], o.agg(F.count("*").alias("x"), *(F.count_if(F.col("o_orderstatus") == s).alias(s.lower()) for s in "FOP")))
    labels = rollups.reconcile([("toxic within labels", F.col("t") <= F.col("x"))], l.agg(F.count("*").alias("x"), F.count_if(F.col("toxic") == 1).alias("t")))
    orphans = rollups.reconcile([("every label has a document", F.col("x") == 0)], l.join(d, "doc_id", "left_anti").agg(F.count("*").alias("x")))
    return customers.union(orders).union(labels).union(orphans)


@query(
    "health_check",
    """
with w as (select c_nationkey as batch, c_custkey as id, c_acctbal > 0 as saved, exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'P') as labelled from customer),
b as (select n_nationkey as batch, count(id) as sampled, count(id) filter (where labelled) as classified, count(id) filter (where saved) as saved, count(id) filter (where saved and not labelled) as open from nation left join w on batch = n_nationkey and n_nationkey % 6 <> 5 group by 1)
select batch, sampled, classified, saved, open, case when sampled = 0 then 'nothing sampled' when classified = 0 then 'nothing classified' when open > 0 then 'saved but unclassified' end as fault from b
""",
)
def health_check(spark, sf_dir):
    """Batches, sampled items and labels as nations, customers and their open orders; every sixth nation has no sample."""
    c = load(spark, sf_dir, "customer").where("c_nationkey % 6 <> 5").select(F.col("c_nationkey").alias("batch"), F.col("c_custkey").alias("id"), (F.col("c_acctbal") > 0).alias("saved"))
    done = load(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("id")).distinct()
    return rollups.batch_health(load(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("batch")), c, done)


@query(
    "weekly_summary",
    """
with old as (select c_nationkey as k, count(*) filter (where c_acctbal > 9000) as related, count(*) filter (where c_acctbal > 5000) as classified, count(*) as sampled from customer group by 1),
new as (select c_nationkey as k, count(*) filter (where c_acctbal > 8000) as related, count(*) filter (where c_acctbal > 4000) as classified, count(*) - (c_nationkey % 2) as sampled from customer where c_nationkey % 5 <> 0 group by 1)
select coalesce(old.k, new.k) as k, case when new.sampled >= old.sampled then new.related else old.related end as related,
 case when new.sampled >= old.sampled then new.classified else old.classified end as classified, case when new.sampled >= old.sampled then new.sampled else old.sampled end as sampled
from old full join new on old.k = new.k
""",
)
def weekly_summary(spark, sf_dir):
    c = load(spark, sf_dir, "customer").withColumnRenamed("c_nationkey", "k")
    make = lambda df, a, b, less: df.groupBy("k").agg(F.count_if(F.col("c_acctbal") > a).alias("related"), F.count_if(F.col("c_acctbal") > b).alias("classified"), F.count("*").alias("sampled")).withColumn("sampled", F.col("sampled") - less)
    return rollups.bounded_summary(make(c, 9000, 5000, F.lit(0)), make(c.where("k % 5 <> 0"), 8000, 4000, F.col("k") % 2), "k", ["related", "classified", "sampled"])


@query("engagement_ratios", "select o_orderkey, round(o_totalprice / nullif(o_custkey % 10, 0) * 1000, 4) as likes_per_1000, case when o_custkey % 4 = 0 then null else greatest(0, date_diff('hour', o_orderdate, timestamp '2001-01-01')) end as age_hours from orders")
def engagement_ratios(spark, sf_dir):
    from attesta.functions.scalar import age_hours, per_thousand

    o = load(spark, sf_dir, "orders")
    seen = F.when(F.col("o_custkey") % 4 != 0, F.lit("2001-01-01").cast("timestamp"))
    return o.select("o_orderkey", F.round(per_thousand(F.col("o_totalprice"), F.col("o_custkey") % 10), 4).alias("likes_per_1000"), age_hours(F.col("o_orderdate"), seen).cast("bigint").alias("age_hours"))


@query("keyset_pages", "select doc_id, source from documents where doc_id > 100 order by doc_id limit 200")
def keyset_pages(spark, sf_dir):
    """One keyset page in key order."""
    return keyset_page(load(spark, sf_dir, "documents").select("doc_id", "source"), 100, 200, "doc_id")


@query("workload_summary", "select event_type, sum(case when value > 50 then 1 else 0 end) + sum(case when value < 1 then 1 else 0 end) as done, count(*) as target, greatest(0, count(*) - sum(case when value > 50 then 1 else 0 end) - sum(case when value < 1 then 1 else 0 end)) as remaining from events group by event_type")
def workload_summary(spark, sf_dir):
    ev = load(spark, sf_dir, "events")
    one = lambda c: F.when(c, 1).otherwise(0)
    return ev.groupBy("event_type").agg(*rollups.workload(one(F.col("value") > 50), one(F.col("value") < 1), F.lit(1)))


@query("set_operations", "select o_custkey as k, 'difference' as op from orders where o_orderstatus = 'F' except select o_custkey, 'difference' from orders where o_orderstatus = 'P' union all (select o_custkey, 'intersection' from orders where o_orderstatus = 'F' intersect select o_custkey, 'intersection' from orders where o_orderstatus = 'P')")
def set_operations(spark, sf_dir):
    o = load(spark, sf_dir, "orders")
    a, b = (o.where(F.col("o_orderstatus") == s).select(F.col("o_custkey").alias("k")) for s in "FP")
    return a.distinct().join(b, "k", "left_anti").withColumn("op", F.lit("difference")).union(a.intersect(b).withColumn("op", F.lit("intersection")))


@query("complete_groups", "select conv_id from conversations group by conv_id having bool_and(length(text) > 40 and role is not null)")
def complete_groups(spark, sf_dir):
    """Groups of which every member has all inputs."""
    c = load(spark, sf_dir, "conversations")
    return c.groupBy("conv_id").agg(F.bool_and((F.length("text") > 40) & F.col("role").isNotNull()).alias("ok")).where("ok").select("conv_id")


@query("override_label", "select l.doc_id, case when d.doc_id % 4 = 0 then 'human' else 'model' end as basis, case when d.doc_id % 4 = 0 then 1 - l.quality else l.quality end as quality from labels l join documents d using (doc_id)")
def override_label(spark, sf_dir):
    """A human label replaces the whole model label."""
    l = load(spark, sf_dir, "labels").select("doc_id", F.struct(F.lit("model").alias("basis"), "quality").alias("label"))
    h = load(spark, sf_dir, "labels").where("doc_id % 4 = 0").select("doc_id", F.struct(F.lit("human").alias("basis"), (1 - F.col("quality")).alias("quality")).alias("human"))
    return l.join(h, "doc_id", "left").select("doc_id", F.coalesce("human", "label").alias("l")).select("doc_id", "l.basis", "l.quality")


@query("text_search", "select doc_id from documents where contains(lower(concat_ws(' ', text, source)), 'pathetic')")
def text_search(spark, sf_dir):
    d = load(spark, sf_dir, "documents")
    return d.where(filters.search(F.col("text"), F.col("source"), "PATHETIC")).select("doc_id")


@query("default_outer_join", "select c.c_custkey, coalesce(o.status, 'unverified') as status from customer c left join (select o_custkey, max(o_orderstatus) as status from orders where o_orderpriority = '1-URGENT' group by o_custkey) o on o.o_custkey = c.c_custkey")
def default_outer_join(spark, sf_dir):
    """Left join with a computed fallback row."""
    c = load(spark, sf_dir, "customer").select("c_custkey")
    o = load(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderstatus").alias("status"))
    return c.join(o, "c_custkey", "left").select("c_custkey", F.coalesce("status", F.lit("unverified")).alias("status"))


@query("array_membership", "select n_name from nation where n_nationkey in (select unnest([1, 5, 9, 99]))")
def array_membership(spark, sf_dir):
    return load(spark, sf_dir, "nation").where(F.array_contains(F.array(*map(F.lit, (1, 5, 9, 99))), F.col("n_nationkey"))).select("n_name")
