"""Reproducible samples and allocations; draws depend on ids only, never on order."""

from __future__ import annotations

import hashlib
import json
import random

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import placed


def key_hash(seed: str | int, key: Column) -> Column:
    return F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string")), 256)


def allocate(weights: DataFrame, key: str, weight: str, total: int) -> DataFrame:
    """Largest-remainder shares of ``total``; leftovers by fraction, then key.

    Weights must sum to 1.
    """
    exact = weights.withColumn("_x", F.round(F.col(weight) * total, 9)).withColumn("_f", F.floor("_x"))
    sums = weights.agg(F.sum(weight).alias("_w")).crossJoin(exact.agg((F.lit(total) - F.sum("_f")).alias("_left")))
    checked = sums.select(F.when(F.abs(F.col("_w") - 1) < 1e-9, F.col("_left")).otherwise(F.raise_error(F.lit("weights must sum to 1")).cast("bigint")).alias("_left"))
    nth = F.row_number().over(Window.orderBy(F.desc(F.col("_x") - F.col("_f")), F.asc(key)))
    rows = exact.withColumn("_nth", nth).crossJoin(F.broadcast(checked))
    return rows.select(key, weight, (F.col("_f") + (F.col("_nth") <= F.col("_left")).cast("long")).alias("quota"))


def country_of(countries: Column, seed: str | int, none: str = "EU") -> Column:
    """The country with the smallest hash; ``none`` for an empty list."""
    hashed = F.transform(countries, lambda c: F.struct(F.sha2(F.concat(F.lit(f"{seed}:"), c), 256).alias("h"), c.alias("c")))
    return F.coalesce(F.array_min(hashed)["c"], F.lit(none))


def stratified_hash_sample(df: DataFrame, stratum: list[str], key: str, quota: Column, seed: str | int) -> DataFrame:
    """Smallest hashes of each stratum; adds size, probability and selected.

    Ranks come from ranges of the hashes' first digits, so no task sorts a
    stratum.  Shortfalls are not made up elsewhere.
    """
    rows = df.withColumn("h", key_hash(seed, F.col(key))).withColumn("_range", F.substring("h", 1, 3))
    sizes = rows.groupBy(*stratum, "_range").agg(F.count("*").alias("_size"))
    w = Window.partitionBy(*stratum)
    before = F.coalesce(F.sum("_size").over(w.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    named = {c: f"_s{i}" for i, c in enumerate([*stratum, "_range"])}
    sizes = sizes.select(*(F.col(c).alias(n) for c, n in named.items()), before.alias("_start"), F.sum("_size").over(w).alias("size"))
    inside = F.row_number().over(Window.partitionBy(*stratum, "_range").orderBy("h", key))
    same = F.lit(True)
    for c, n in named.items():
        same = same & F.col(c).eqNullSafe(F.col(n))
    rows = rows.withColumn("_in", inside).join(sizes, same).withColumn("nth", F.col("_start") + F.col("_in"))
    n = F.least(F.col("size"), quota)
    return rows.withColumn("selected", F.col("nth") <= quota).withColumn("probability", n / F.col("size")).drop("h", "nth", "_in", "_start", "_range", *named.values())


def stratified_rng_sample(df: DataFrame, stratum: str, key: str, quota: str, seed: int) -> DataFrame:
    """The same plan drawn by Python's generator, seeded per stratum by a digest: (stratum, key, selected, probability).

    What is drawn depends on a stratum's size, quota and seed alone, so places are drawn from
    these and meet the rows by their rank of the key as text.  A task holds a quota, never a
    stratum.  The quota is that of the smallest key; a repeated key is a row of its own.
    """
    rows = df.select(stratum, key, quota).withColumn("_key", F.col(key).cast("string"))
    rows = placed(rows, F.struct(stratum, "_key"), [], "_at", nulls_first=True)
    sizes = rows.groupBy(stratum).agg(F.min("_at").alias("_first"), F.count("*").alias("_all"), F.min_by(quota, "_at").alias("_quota"))
    sizes = sizes.select(F.col(stratum).alias("_of"), F.coalesce(F.col(stratum).cast("string"), F.lit("None")).alias("_name"), "_first", "_all", F.least("_all", F.greatest(F.coalesce("_quota", F.lit(0)), F.lit(0))).cast("long").alias("_take"))

    def draw(batches):
        for batch in batches:
            for name, first, size, take in zip(*(batch.column(c).to_pylist() for c in ("_name", "_first", "_all", "_take"))):
                seeded = hashlib.sha256(json.dumps([seed, name], separators=(",", ":")).encode()).hexdigest()
                picked = random.Random(seeded).sample(range(size), take)
                for lo in range(0, take, 65_536):
                    yield pa.RecordBatch.from_arrays([pa.array([first + i for i in picked[lo : lo + 65_536]], pa.int64())], names=["_picked"])

    drawn = sizes.mapInArrow(draw, "_picked long")
    rows = rows.join(sizes, F.col(stratum).eqNullSafe(F.col("_of"))).join(drawn, F.col("_at") == F.col("_picked"), "left")
    return rows.select(stratum, key, F.col("_picked").isNotNull().alias("selected"), (F.col("_take") / F.col("_all")).alias("probability"))


def hash_threshold(key: Column, seed: str | int, share: float) -> Column:
    """Whether the first 16 hex digits of the hash are below the share."""
    bar = f"{min(int(share * 16**16), 16**16 - 1):016x}"
    return F.substring(key_hash(seed, key), 1, 16) < bar


def modulo_sample(id_hex: Column, modulus: int, below: int) -> Column:
    return F.conv(F.substring(id_hex, 1, 8), 16, 10).cast("bigint") % modulus < below


def placed_by_hash(df: DataFrame, first: str, h: str, key: str) -> DataFrame:
    """Adds ``place``, the rank by (first, h, key), without one global sort.

    Hex hashes are uniform, so their first three digits cut the order into 4,096
    even ranges: places are ranks inside a range plus the sizes of the ranges
    before it.  ``first`` has few values.
    """
    rows = df.withColumn("_range", F.substring(h, 1, 3))
    sizes = rows.groupBy(first, "_range").agg(F.count("*").alias("_size"))
    before = F.coalesce(F.sum("_size").over(Window.orderBy(first, "_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = F.broadcast(sizes.select(first, "_range", before.alias("_start")))
    inside = F.row_number().over(Window.partitionBy(first, "_range").orderBy(h, key))
    return rows.withColumn("_in", inside).join(starts, [first, "_range"]).withColumn("place", F.col("_start") + F.col("_in")).drop("_range", "_start", "_in")


def hash_plan(df: DataFrame, key: str, seed: str, share: float, least: int, stratum: Column | None = None, fixed: int | None = None) -> DataFrame:
    """First rows by hash: ``fixed`` or max(least, ceil(n * share)), at most all.

    With a stratum predicate the first row of either side is taken first.
    """
    rows = df.withColumn("_h", key_hash(seed, F.col(key)))
    n = F.count("*")
    goal = F.lit(fixed) if fixed is not None else F.greatest(F.lit(least), F.ceil(n * F.lit(share)))
    target = rows.agg(F.least(n, goal).alias("_n"))
    if stratum is not None:
        lead = rows.groupBy(stratum.alias("_s")).agg(F.min(F.struct("_h", key)).alias("m")).select(F.col(f"m.{key}").alias(key), F.lit(0).alias("_late"))
        rows = rows.join(F.broadcast(lead), key, "left").withColumn("_late", F.coalesce("_late", F.lit(1)))
    else:
        rows = rows.withColumn("_late", F.lit(1))
    most = placed_by_hash(rows, "_late", "_h", key)
    return most.crossJoin(F.broadcast(target)).where(F.col("place") <= F.col("_n")).drop("_h", "_late", "_n")


def population_hash(df: DataFrame, key: str) -> DataFrame:
    """SHA-256 of the JSON list of sorted distinct ids.

    Ids are sorted by all executors; one task then reads them in order and keeps
    the state of the hash only, as this hash is of one sequence.
    """

    def run(batches):
        state, lead = hashlib.sha256(b"["), b""
        for batch in batches:
            ids = [json.dumps(i, ensure_ascii=False).encode() for i in batch.column(0).to_pylist() if i is not None]
            if ids:
                state.update(lead + b",".join(ids))
                lead = b","
        state.update(b"]")
        yield pa.RecordBatch.from_arrays([pa.array([state.hexdigest()])], ["population_hash"])

    ids = df.select(F.col(key).cast("string").alias("id")).where("id is not null").distinct()
    none = df.sparkSession.range(1).select(F.lit(None).cast("string"))  # a task for an empty table too
    return ids.union(none).orderBy("id").coalesce(1).mapInArrow(run, "population_hash string")


def linked_sample(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    return children.join(parents.select(key), key, "left_semi")


def qa_groups(df: DataFrame, key: str, predicates: dict[str, Column], seed: str, each: int = 3) -> DataFrame:
    """Up to ``each`` seeded draws per predicate; the reasons of every drawn row."""
    reasons = F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in predicates.items())))
    rows = df.select(key, F.explode(reasons).alias("reason"))
    rows = rows.withColumn("h", F.sha2(F.concat_ws(":", F.lit(seed), "reason", F.col(key).cast("string")), 256))
    rows = rows.withColumn("nth", F.row_number().over(Window.partitionBy("reason").orderBy("h", key))).where(F.col("nth") <= each)
    return rows.groupBy(key).agg(F.array_sort(F.collect_list("reason")).alias("reasons"))


def tranche(n: Column, run: int, caps: tuple[int, int] = (20, 30)) -> Column:
    """First run a tenth of the items, then the caps, then all."""
    return F.ceil(n * 0.1) if run == 0 else F.least(n, F.lit(caps[run - 1])) if run <= len(caps) else n
