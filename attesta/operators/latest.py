"""Which version of a record counts: one place for null and tie rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _packed(df: DataFrame) -> Column:
    return F.struct(*(F.col(c) for c in df.columns))


def latest_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key: the last by ``order``; a missing order value loses.

    ``max_by`` over a struct aggregates on the map side, unlike a window.
    """
    got = df.groupBy(*keys).agg(F.max_by(_packed(df), F.struct(*(F.col(c) for c in order))).alias("row"))
    return got.select("row.*")


def first_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key: the first by ``order``, which must not be null."""
    got = df.groupBy(*keys).agg(F.min_by(_packed(df), F.struct(*(F.col(c) for c in order))).alias("row"))
    return got.select("row.*")


def sticky_latest(df: DataFrame, keys: list[str], usable: Column, order: list[str]) -> DataFrame:
    """The last row, except that an unusable one never replaces a usable one."""
    rank = F.struct(F.coalesce(usable, F.lit(False)), *(F.col(c) for c in order))
    return df.groupBy(*keys).agg(F.max_by(_packed(df), rank).alias("row")).select("row.*")


def latest_then_filter(df: DataFrame, keys: list[str], order: list[str], keep: Column) -> DataFrame:
    """Keys whose latest row passes; an older row never comes back."""
    return latest_per_key(df, keys, order).where(keep)


def filter_then_latest(df: DataFrame, keys: list[str], order: list[str], keep: Column) -> DataFrame:
    """The latest of the rows that pass."""
    return latest_per_key(df.where(keep), keys, order)


def latest_review(df: DataFrame, keys: list[str], stamp: str, digest: str) -> DataFrame:
    """Latest by a text stamp; stamps that do not parse come before all others."""
    parsed = df.withColumn("_at", F.try_to_timestamp(F.col(stamp)))
    return latest_per_key(parsed, keys, ["_at", digest]).drop("_at")


def latest_snapshot(df: DataFrame, key: str, batch: str, captured: str, position: str) -> DataFrame:
    """Greatest ``batch|captured`` text per key; the first position wins ties."""
    stamp = F.concat_ws("|", batch, F.coalesce(captured, F.lit("")))
    rows = df.withColumn("_stamp", stamp).withColumn("_back", -F.col(position))
    return latest_per_key(rows, [key], ["_stamp", "_back"]).drop("_stamp", "_back")


def union_latest(parts: list[DataFrame], key: str) -> DataFrame:
    """Union of row sets, one row per id; equal ids hold equal payloads."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.dropDuplicates([key])


def merge_aliases(df: DataFrame, canonical: str, priority: str, position: str, aliases: str) -> DataFrame:
    """One row per canonical id: highest priority, ties keep the earlier one;
    alias arrays are united in sorted order."""
    rank = F.struct(F.col(priority), -F.col(position))
    got = df.groupBy(canonical).agg(F.max_by(_packed(df), rank).alias("row"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(aliases)))).alias("_all"))
    return got.select(*(F.col(f"row.{c}") for c in df.columns if c != aliases), F.col("_all").alias(aliases))


def valid_for_current(reviews: DataFrame, labels: DataFrame, key: str, ignored: str) -> DataFrame:
    """Reviews bound to the current label by hash, or whose label differs in one
    ignored field only."""
    rest = [c for c in labels.columns if c not in (key, "label_hash", ignored)]
    now = labels.select(key, F.col("label_hash").alias("_hash"), F.struct(*rest).alias("_rest"))
    rows = reviews.join(now, key).where((F.col("label_hash") == F.col("_hash")) | F.struct(*rest).eqNullSafe(F.col("_rest")))
    return rows.select(reviews.columns)


def union_min_threshold(df: DataFrame, key: str, threshold: str) -> DataFrame:
    """The row with the smallest threshold per key."""
    return df.groupBy(key).agg(F.min_by(_packed(df), F.col(threshold)).alias("row")).select("row.*")


def nth_in_group(df: DataFrame, groups: list[str], order: list[Column], name: str = "nth") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*groups).orderBy(*order)))
