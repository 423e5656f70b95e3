"""Sampling and allocation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from attesta.operators import sampling
from attesta.sources.tables import load

from .registry import query

SEED = 20261004


@query(
    "largest_remainder",
    """
with w as (select c_mktsegment as segment, count(*)::double / (select count(*) from customer) as weight from customer group by 1),
x as (select *, round(weight * 97, 9) as x from w), f as (select *, floor(x) as f, row_number() over (order by x - floor(x) desc, segment) as nth from x)
select segment, round(weight, 9) as weight, cast(f + case when nth <= 97 - (select sum(f) from f) then 1 else 0 end as bigint) as quota from f
""",
)
def largest_remainder(spark, sf_dir):
    c = load(spark, sf_dir, "customer")
    w = c.groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count("*").alias("n")).crossJoin(F.broadcast(c.agg(F.count("*").alias("all"))))
    return sampling.allocate(w.select("segment", (F.col("n") / F.col("all")).alias("weight")), "segment", "weight", 97).withColumn("weight", F.round("weight", 9))


@query("hash_threshold_sample", "select doc_id from documents where substr(sha256('20261004:' || cast(doc_id as varchar)), 1, 16) < '0ccccccccccccc00'")
def hash_threshold_sample(spark, sf_dir):
    return load(spark, sf_dir, "documents").where(sampling.hash_threshold(F.col("doc_id"), SEED, 0.05)).select("doc_id")


@query("modulo_sample", "select doc_id from documents where cast('0x' || substr(sha256(cast(doc_id as varchar)), 1, 8) as bigint) % 100 < 3")
def modulo_sample(spark, sf_dir):
    d = load(spark, sf_dir, "documents").select("doc_id", F.sha2(F.col("doc_id").cast("string"), 256).alias("id"))
    return d.where(sampling.modulo_sample(F.col("id"), 100, 3)).select("doc_id")


@query(
    "stratified_hash_sample",
    """
with r as (select doc_id, lang, source, row_number() over (partition by lang, source order by sha256('20261004:' || cast(doc_id as varchar)), doc_id) as nth, count(*) over (partition by lang, source) as size from documents)
select doc_id, lang, source, size, nth <= 4 as selected, round(least(size, 4) / size::double, 9) as probability from r
""",
)
def stratified_hash_sample(spark, sf_dir):
    d = load(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    got = sampling.stratified_hash_sample(d, ["lang", "source"], "doc_id", F.lit(4), SEED)
    return got.withColumn("probability", F.round("probability", 9))


@query("stratified_rng_sample")
def stratified_rng_sample(spark, sf_dir):
    """The generator-seeded draw; the hash draw is the scalable form."""
    d = load(spark, sf_dir, "documents").select("doc_id", "lang").withColumn("quota", F.lit(10))
    return sampling.stratified_rng_sample(d, "lang", "doc_id", "quota", SEED)


@query(
    "country_assignment",
    """
with c as (select conv_id, unnest(list_distinct(list(role))) as role from conversations group by conv_id)
select conv_id, role from (select conv_id, role, row_number() over (partition by conv_id order by sha256('20261004:' || role)) as rn from c) where rn = 1
""",
)
def country_assignment(spark, sf_dir):
    """One member of a list by smallest hash."""
    c = load(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.collect_set("role").alias("roles"))
    return c.select("conv_id", sampling.country_of(F.col("roles"), SEED).alias("role"))


@query(
    "linked_sample",
    """
with plan as (select doc_id from (select doc_id, row_number() over (order by sha256('20261004:' || cast(doc_id as varchar)), doc_id) as nth, count(*) over () as n from documents) where nth <= greatest(5, ceil(0.06 * n)))
select conv_id, turn from conversations where conv_id in (select doc_id from plan)
""",
)
def linked_sample(spark, sf_dir):
    plan = sampling.hash_plan(load(spark, sf_dir, "documents").select("doc_id"), "doc_id", str(SEED), 0.06, 5)
    return sampling.linked_sample(load(spark, sf_dir, "conversations").select("conv_id", "turn"), plan.withColumnRenamed("doc_id", "conv_id"), "conv_id")


@query(
    "supplemental_sample",
    """
with a as (select doc_id, row_number() over (order by sha256('first:' || cast(doc_id as varchar)), doc_id) as nth from documents), rest as (select doc_id from a where nth > 60)
select doc_id from (select doc_id, row_number() over (order by sha256('second:' || cast(doc_id as varchar)), doc_id) as nth from rest) where nth <= 30
""",
)
def supplemental_sample(spark, sf_dir):
    """A second draw disjoint from the first."""
    d = load(spark, sf_dir, "documents").select("doc_id")
    first = sampling.hash_plan(d, "doc_id", "first", 0.0, 5, fixed=60)
    return sampling.hash_plan(d.join(first, "doc_id", "left_anti"), "doc_id", "second", 0.0, 5, fixed=30).select("doc_id")


@query(
    "qa_groups",
    """
with r as (select doc_id, unnest(list_filter([case when n_chars > 5000 then 'long' end, case when lang = 'fr' then 'french' end, case when source = 'src1' then 'source one' end], lambda x: x is not null)) as reason from documents),
h as (select *, row_number() over (partition by reason order by sha256('qa:' || reason || ':' || cast(doc_id as varchar)), doc_id) as nth from r)
select doc_id, string_agg(reason, ',' order by reason) as reasons from h where nth <= 3 group by doc_id
""",
)
def qa_groups(spark, sf_dir):
    d = load(spark, sf_dir, "documents")
    checks = {"long": F.col("n_chars") > 5000, "french": F.col("lang") == "fr", "source one": F.col("source") == "src1"}
    return sampling.qa_groups(d, "doc_id", checks, "qa").select("doc_id", F.array_join("reasons", ",").alias("reasons"))


@query("population_hash", "select sha256('[' || string_agg('\"' || i || '\"', ',' order by i) || ']') as population_hash from (select distinct cast(conv_id as varchar) as i from conversations)")
def population_hash(spark, sf_dir):
    return sampling.population_hash(load(spark, sf_dir, "conversations"), "conv_id")


@query("calibration_tranche", "select lang, cast(ceil(count(*) * 0.1) as bigint) as first_run, least(count(*), 20) as second_run, count(*) as later from documents group by lang")
def calibration_tranche(spark, sf_dir):
    n = load(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n"))
    return n.select("lang", *(sampling.tranche(F.col("n"), r).cast("bigint").alias(a) for r, a in ((0, "first_run"), (1, "second_run"), (3, "later"))))
