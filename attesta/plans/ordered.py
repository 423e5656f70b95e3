"""Queries over order-dependent operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from attesta.operators import ordered
from attesta.sources.tables import load

from .registry import query


@query("burst_count", "select user_id, max(n) as burst from (select user_id, count(*) over (partition by user_id order by ts range between current row and interval 600 seconds following) as n from events) group by user_id")
def burst_count(spark, sf_dir):
    return ordered.burst(load(spark, sf_dir, "events").select("user_id", "ts"), "user_id", "ts")


@query("tertile_tiers", "select c_custkey, case when below / n::double < 1.0/3 then 'low' when below / n::double < 2.0/3 then 'medium' else 'high' end as tier from (select c_custkey, rank() over (order by c_acctbal) - 1 as below, count(*) over () as n from customer)")
def tertile_tiers(spark, sf_dir):
    return ordered.tertiles(load(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), "c_acctbal").select("c_custkey", "tier")


@query(
    "week_streak",
    "with w as (select distinct user_id, date_trunc('week', ts)::date as w from events), g as (select user_id, w - cast(7 * row_number() over (partition by user_id order by w) as integer) as g from w) select user_id, max(n) as streak from (select user_id, g, count(*) as n from g group by 1, 2) group by user_id",
)
def week_streak(spark, sf_dir):
    return ordered.week_streak(load(spark, sf_dir, "events"), "user_id", "ts")


@query(
    "cumulative_share",
    """
with c as (select ts::date as day, event_type as label, count(*) as n from events group by 1, 2),
d as (select unnest(generate_series((select min(day) from c), (select max(day) from c), interval 1 day))::date as day),
g as (select d.day, l.label, coalesce(c.n, 0) as n from d cross join (select distinct label from c) l left join c on c.day = d.day and c.label = l.label)
select day, label, round(100.0 * sum(n) over (partition by label order by day) / nullif(sum(n) over (order by day), 0), 6) as share from g
""",
)
def cumulative_share(spark, sf_dir):
    ev = load(spark, sf_dir, "events")
    return ordered.cumulative_share(ev, "ts", "event_type").withColumn("share", F.round("share", 6))


@query(
    "topk_visibility",
    """
with i as (select l_orderkey, l_linenumber, max(l_quantity) as l_quantity, max(l_tax) as l_tax from lineitem group by 1, 2),
t as (select l_orderkey, greatest(max(l_quantity), 1) as a, greatest(max(l_tax), 1) as b from i group by 1),
s as (select l.l_orderkey, l.l_linenumber, l.l_quantity / t.a + l.l_tax / t.b as score from i l join t using (l_orderkey))
select l_orderkey, l_linenumber, round(score, 9) as score, rank from (select *, row_number() over (partition by l_orderkey order by score desc, l_linenumber) as rank from s) where rank <= 3
""",
)
def topk_visibility(spark, sf_dir):
    l = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_tax").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("l_quantity"), F.max("l_tax").alias("l_tax"))
    got = ordered.visibility_top(l, "l_orderkey", "l_linenumber", "l_quantity", "l_tax", 3)
    return got.select("l_orderkey", "l_linenumber", F.round("score", 9).alias("score"), "rank")


@query("round_robin", "select doc_id, lang, row_number() over (partition by lang order by doc_id) as turn from documents")
def round_robin(spark, sf_dir):
    return ordered.round_robin(load(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", "doc_id")


@query("prefix_budget", "select conv_id, turn, running from (select conv_id, turn, sum(length(text)) over (partition by conv_id order by turn) as running from conversations) where running <= 1500")
def prefix_budget(spark, sf_dir):
    c = load(spark, sf_dir, "conversations")
    return ordered.prefix_budget(c, "conv_id", "turn", F.length("text"), 1500).select("conv_id", "turn", "running")


@query("prefix_budget_keep_first", "select conv_id, turn from (select conv_id, turn, sum(length(text)) over (partition by conv_id order by turn) as running, row_number() over (partition by conv_id order by turn) as nth from conversations) where running <= 500 or nth = 1")
def prefix_budget_keep_first(spark, sf_dir):
    c = load(spark, sf_dir, "conversations")
    return ordered.prefix_budget(c, "conv_id", "turn", F.length("text"), 500, True).select("conv_id", "turn")


@query("global_top_digest", "select doc_id, sha256(cast(doc_id as varchar)) as h from documents order by h limit 20")
def global_top_digest(spark, sf_dir):
    d = load(spark, sf_dir, "documents").select("doc_id", F.sha2(F.col("doc_id").cast("string"), 256).alias("h"))
    return d.orderBy("h").limit(20)


@query("priority_order", "select doc_id from (select doc_id, row_number() over (order by (lang <> 'fr'), (n_chars <= 3000), doc_id) as p from documents) where p <= 50")
def priority_order(spark, sf_dir):
    d = load(spark, sf_dir, "documents")
    return d.orderBy(F.col("lang") != "fr", F.col("n_chars") <= 3000, "doc_id").limit(50).select("doc_id")


@query("leaders_then_fill", "select doc_id from (select doc_id, row_number() over (order by nth > 1, n_chars desc, doc_id) as p from (select *, row_number() over (partition by source order by n_chars desc, doc_id) as nth from documents)) where p <= 40")
def leaders_then_fill(spark, sf_dir):
    d = load(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    return ordered.leaders_then_fill(d, "source", [F.desc("n_chars"), F.asc("doc_id")], 40).select("doc_id")


@query("rank_then_total", "select event_type, count(*) as total, count(distinct user_id) as coverage, row_number() over (order by count(distinct user_id) desc, count(*) desc, event_type) as place from events group by event_type")
def rank_then_total(spark, sf_dir):
    from pyspark.sql import Window

    got = load(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("total"), F.count_distinct("user_id").alias("coverage"))
    return got.withColumn("place", F.row_number().over(Window.orderBy(F.desc("coverage"), F.desc("total"), "event_type")))


@query("first_day_per_key", "select user_id, min(ts::date) as first_day from events where ts >= timestamp '2024-01-10' group by user_id")
def first_day_per_key(spark, sf_dir):
    ev = load(spark, sf_dir, "events").where(F.col("ts") >= F.lit("2024-01-10").cast("timestamp"))
    return ev.groupBy("user_id").agg(F.min(F.to_date("ts")).alias("first_day"))


@query(
    "monotone_cursor",
    "with p as (select user_id, max(ts) as cursor from events where event_type = 'view' group by 1), e as (select user_id, max(ts) as ended from events where event_type = 'click' group by 1) select coalesce(p.user_id, e.user_id) as user_id, greatest(p.cursor, e.ended) as cursor from p full join e on p.user_id = e.user_id",
)
def monotone_cursor(spark, sf_dir):
    ev = load(spark, sf_dir, "events")
    p = ev.where("event_type = 'view'").groupBy("user_id").agg(F.max("ts").alias("cursor"))
    e = ev.where("event_type = 'click'").groupBy("user_id").agg(F.max("ts").alias("ended"))
    return p.join(e, "user_id", "full").select("user_id", ordered.moved_cursor(F.col("cursor"), F.col("ended")).alias("cursor"))


@query(
    "weighted_order",
    """
with w as (select doc_id, source, -ln((cast('0x' || substr(sha256('7:' || doc_id), 1, 13) as bigint) + 1) / 4503599627370496.0) / ((1 + 4 * exp(-(doc_id % 30) / 4.0)) * case when n_chars > 2000 then 1.8 else 1.0 end) as draw from documents)
select doc_id, source, round(draw, 9) as draw from (select *, row_number() over (partition by source order by draw, doc_id) as nth from w) where nth = 1
""",
)
def weighted_order(spark, sf_dir):
    """Weighted random order, one pick a source."""
    from pyspark.sql import Window

    d = load(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    age = (F.col("doc_id") % 30).cast("double")
    rows = ordered.weighted_order(d, ordered.highlight_weight(age, F.col("n_chars") > 2000, F.lit(False)), 7, "doc_id")
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy("source").orderBy("draw", "doc_id"))).where("nth = 1").select("doc_id", "source", F.round("draw", 9).alias("draw"))


def _lines(spark, sf_dir):
    """Order lines as intervals of days since 1995 per order."""
    l = load(spark, sf_dir, "lineitem")
    start = F.datediff("l_shipdate", F.lit("1995-01-01")).cast("double")
    return l.select((F.col("l_orderkey") % 500).alias("k"), "l_orderkey", "l_linenumber", start.alias("start"), (start + F.col("l_quantity")).alias("end"))


@query(
    "interval_islands",
    """
with i as (select l_orderkey % 500 as k, date_diff('day', timestamp '1995-01-01', l_shipdate) - 0.25 as lo, date_diff('day', timestamp '1995-01-01', l_shipdate) + l_quantity + 0.25 as hi from lineitem),
p as (select *, max(hi) over (partition by k order by lo, hi rows between unbounded preceding and 1 preceding) as reach from i),
g as (select *, sum(case when reach is null or lo > reach then 1 else 0 end) over (partition by k order by lo, hi rows unbounded preceding) as g from p)
select k, min(lo)::double as lo, max(hi)::double as hi from g group by k, g
""",
)
def interval_islands(spark, sf_dir):
    return ordered.interval_islands(_lines(spark, sf_dir), "k", "start", "end")


@query(
    "interval_overlap",
    """
with i as (select l_orderkey, l_linenumber, date_diff('day', timestamp '1995-01-01', l_shipdate) as s, date_diff('day', timestamp '1995-01-01', l_shipdate) + l_quantity as e from lineitem)
select a.l_orderkey, count(*) as n from i a join i b on a.l_orderkey = b.l_orderkey and a.l_linenumber < b.l_linenumber and a.s < b.e and b.s < a.e group by a.l_orderkey
""",
)
def interval_overlap(spark, sf_dir):
    rows = _lines(spark, sf_dir)
    got = ordered.overlaps(rows, rows, "l_orderkey").where("l_linenumber < b_l_linenumber")
    return got.groupBy("l_orderkey").agg(F.count("*").alias("n"))


@query(
    "supplier_overlap",
    """
with i as (select l_suppkey as k, l_orderkey * 10 + l_linenumber as id, date_diff('day', timestamp '1995-01-01', l_shipdate)::double as s, date_diff('day', timestamp '1995-01-01', l_shipdate) + l_quantity % 7 as e from lineitem),
p as (select s_suppkey as k, min(o) as s, max(o) as e from (select s_suppkey, unnest([s_suppkey % 50 * 40, s_suppkey % 50 * 40 + s_suppkey % 90]) as o from supplier) group by 1)
select i.k as supplier, count(*) as n, sum(least(i.e, p.e) - greatest(i.s, p.s)) as shared, min(id) as first from i join p on i.k = p.k and i.s < p.e and p.s < i.e group by 1
""",
)
def supplier_overlap(spark, sf_dir):
    """Shipments of a supplier, thousands a key, against one period each; some have no length."""
    half = F.col("s_suppkey") % 50 * 40
    period = load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("supplier"), half.cast("double").alias("start"), (half + F.col("s_suppkey") % 90).cast("double").alias("end"))
    day = F.datediff("l_shipdate", F.lit("1995-01-01").cast("date")).cast("double")
    lines = load(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("supplier"), day.alias("start"), (day + F.col("l_quantity") % 7).cast("double").alias("end"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"))
    got = ordered.overlaps(lines, period, "supplier")
    return got.groupBy("supplier").agg(F.count("*").alias("n"), F.sum(F.least("end", "b_end") - F.greatest("start", "b_start")).alias("shared"), F.min("id").alias("first"))


@query("iso_week_span", "select user_id, min(strftime(ts, '%G-W%V')) as first_week, max(strftime(ts, '%G-W%V')) as last_week, count(distinct strftime(ts, '%G-W%V')) as weeks from events group by user_id")
def iso_week_span(spark, sf_dir):
    from attesta.functions.scalar import iso_week

    ev = load(spark, sf_dir, "events").select("user_id", iso_week(F.col("ts")).alias("w"))
    return ev.groupBy("user_id").agg(F.min("w").alias("first_week"), F.max("w").alias("last_week"), F.count_distinct("w").alias("weeks"))


@query("nulls_last_sort", "select doc_id, row_number() over (order by case when doc_id % 3 = 0 then null else n_chars end desc nulls last, doc_id) as p from documents")
def nulls_last_sort(spark, sf_dir):
    at = F.when(F.col("doc_id") % 3 != 0, -F.col("n_chars"))
    return ordered.placed(load(spark, sf_dir, "documents").select("doc_id", "n_chars"), at, ["doc_id"], "p").select("doc_id", "p")
