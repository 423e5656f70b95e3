"""Order-dependent operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attesta.session import written
from attesta.sources.tables import BROADCAST_BYTES, if_small


def burst(df: DataFrame, by: str, at: str, seconds: int = 600) -> DataFrame:
    """Most events within ``seconds`` after any event, both ends included; 0 for a key whose times are all null.

    Events are counted by key and time first.  A window starts in a bucket of ``seconds`` and ends in the next one or at
    its first time, so buckets are windows of their own: each gets a copy of the one after it.
    """
    span = seconds * 1_000_000
    counts = df.groupBy(by, F.unix_micros(at).alias("_at")).agg(F.count("*").alias("_n"))
    rows = counts.where("_at is not null").withColumn("_bucket", F.floor(F.col("_at") / F.lit(span)) if span else F.col("_at"))
    mine = rows.withColumn("_own", F.lit(True))
    if span:
        mine = mine.union(rows.withColumn("_bucket", F.col("_bucket") - 1).withColumn("_own", F.lit(False)))
    w = Window.partitionBy(by, "_bucket").orderBy("_at").rangeBetween(Window.currentRow, span)
    most = mine.withColumn("_n", F.sum("_n").over(w)).where("_own").groupBy(by).agg(F.max("_n").alias("burst"))
    same = F.col(by).eqNullSafe(F.col("_by"))
    keys = counts.select(F.col(by).alias("_by")).distinct()
    return keys.join(most, same, "left").select(F.col("_by").alias(by), F.coalesce("burst", F.lit(0)).alias("burst"))


def tertiles(df: DataFrame, value: str, by: list[str] | None = None, names=("low", "medium", "high")) -> DataFrame:
    """Tier by the share of strictly smaller values; ties share a tier.

    Ranks come from per-value counts.  Approximate quantiles cut each group into
    a hundred ranges of values; a value's rank is its place inside its range plus
    the sizes of the ranges before, so it is exact and no task orders a group.
    """
    by = by or []
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_c"))
    cuts = counts.groupBy(*by).agg(F.percentile_approx(value, [i / 100 for i in range(1, 100)], 1000).alias("_cuts"))
    rows = counts.join(cuts, by) if by else counts.crossJoin(F.broadcast(cuts))
    rows = rows.withColumn("_range", F.size(F.filter("_cuts", lambda c: c < F.col(value)))).drop("_cuts")
    sizes = rows.groupBy(*by, "_range").agg(F.sum("_c").alias("_size"))
    w = Window.partitionBy(*by)
    before = lambda c, o: F.coalesce(F.sum(c).over(o.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select(*by, "_range", before("_size", w.orderBy("_range")).alias("_start"), F.sum("_size").over(w).alias("_all"))
    inside = before("_c", Window.partitionBy(*by, "_range").orderBy(value))
    ranked = rows.withColumn("_in", inside).join(sizes, [*by, "_range"])
    share = (F.col("_start") + F.col("_in")) / F.col("_all")
    tier = F.when(share < 1 / 3, names[0]).when(share < 2 / 3, names[1]).otherwise(names[2])
    return df.join(ranked.select(*by, value, tier.alias("tier")), [*by, value], "left")


ROWS_PER_RANGE = 200_000


def placed(df: DataFrame, value: Column, ties: list[str], name: str = "place", nulls_first: bool = False, write=written) -> DataFrame:
    """Adds the place by (value, ties), from 1, null values last or first, without one global sort.

    Rows are dealt by ranges of the whole order, ties and row numbers included, so a value that
    all rows share is cut too; each range is sorted and written once (``write``) with its rows'
    numbers, and a place is that number plus the sizes of the ranges before, a table of one row a
    range.  Rows that are equal in value and ties get places in any order.
    """
    value = value if isinstance(value, Column) else F.col(value)
    order = [F.col("_placed_v").asc_nulls_first() if nulls_first else F.col("_placed_v").asc_nulls_last()]
    order += [*(F.col(t).asc_nulls_first() for t in ties), F.col("_placed_row")]
    ranges = max(1, -(-df.count() // ROWS_PER_RANGE))
    rows = df.withColumn("_placed_v", value).withColumn("_placed_row", F.monotonically_increasing_id())
    rows = (rows.repartitionByRange(ranges, *order) if ranges > 1 else rows.coalesce(1)).sortWithinPartitions(*order)
    rows = write(rows.drop("_placed_v", "_placed_row").withColumn("_placed_at", F.monotonically_increasing_id()), "placed")
    rows = rows.withColumn("_placed_range", F.shiftright("_placed_at", 33))
    sizes = rows.groupBy("_placed_range").agg(F.count("*").alias("_placed_size"))
    before = F.coalesce(F.sum("_placed_size").over(Window.orderBy("_placed_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("_placed_range", before.alias("_placed_start"))
    starts = F.broadcast(starts) if ranges * 24 <= BROADCAST_BYTES else starts
    inside = F.col("_placed_at") - F.shiftleft("_placed_range", 33) + 1
    rows = rows.join(starts, "_placed_range").withColumn(name, F.col("_placed_start") + inside)
    return rows.drop("_placed_at", "_placed_range", "_placed_start", "_placed_size")


#: Neighbouring rows that a running sum adds up in one window.
SUM_ROWS = 65_536


def running_sum(df: DataFrame, by: str, place: str, value: str, name: str) -> DataFrame:
    """Adds the sum of ``value`` over a key's rows up to each, by a ``place`` that numbers all rows.

    Windows hold SUM_ROWS neighbours; a window over their sums adds what came before, so a key may have any number of rows.
    """
    rows = df.withColumn("_sum_block", F.expr(f"{place} div {SUM_ROWS}"))
    blocks = rows.groupBy(by, "_sum_block").agg(F.sum(value).alias("_sum_all"))
    before = Window.partitionBy(by).orderBy("_sum_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(F.col(by).alias("_sum_by"), "_sum_block", F.coalesce(F.sum("_sum_all").over(before), F.lit(0)).alias("_sum_before"))
    inside = F.sum(value).over(Window.partitionBy(by, "_sum_block").orderBy(place).rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn(name, inside).withColumnRenamed("_sum_block", "_sum_mine")
    same = (F.col("_sum_mine") == F.col("_sum_block")) & F.col(by).eqNullSafe(F.col("_sum_by"))
    return rows.join(blocks, same).withColumn(name, F.col(name) + F.col("_sum_before")).drop("_sum_mine", "_sum_by", "_sum_block", "_sum_before")


def week_streak(df: DataFrame, by: str, day: str) -> DataFrame:
    """Longest run of consecutive ISO weeks."""
    weeks = df.select(by, F.to_date(F.date_trunc("week", day)).alias("w")).distinct()
    nth = F.row_number().over(Window.partitionBy(by).orderBy("w"))
    island = weeks.withColumn("g", F.date_sub("w", nth * 7))
    return island.groupBy(by, "g").agg(F.count("*").alias("n")).groupBy(by).agg(F.max("n").alias("streak"))


def cumulative_share(df: DataFrame, day: str, label: str) -> DataFrame:
    """Share of each label among all labels to date, on a dense day grid; null before the first."""
    counts = df.groupBy(F.to_date(day).alias("day"), F.col(label).alias("label")).agg(F.count("*").alias("n"))
    days = counts.agg(F.min("day").alias("lo"), F.max("day").alias("hi")).select(F.explode(F.sequence("lo", "hi")).alias("day"))
    grid = days.crossJoin(if_small(counts.select("label").distinct(), 100))
    rows = grid.join(counts, ["day", "label"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    mine = F.sum("n").over(Window.partitionBy("label").orderBy("day").rowsBetween(Window.unboundedPreceding, 0))
    per_day = rows.groupBy("day").agg(F.sum("n").alias("d"))
    all_ = per_day.select("day", F.sum("d").over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0)).alias("all"))
    return rows.withColumn("mine", mine).join(all_, "day").select("day", "label", F.when(F.col("all") > 0, 100.0 * F.col("mine") / F.col("all")).alias("share"))


def visibility_top(df: DataFrame, by: str, key: str, likes: str, replies: str, k: int | None) -> DataFrame:
    """Top k of each group by likes and replies, each as a share of the group's
    largest (at least 1); ties by key."""
    tops = df.groupBy(by).agg(F.greatest(F.max(likes), F.lit(1)).alias("_l"), F.greatest(F.max(replies), F.lit(1)).alias("_r"))
    rows = df.join(tops, by).withColumn("score", F.coalesce(F.col(likes) / F.col("_l"), F.lit(0.0)) + F.coalesce(F.col(replies) / F.col("_r"), F.lit(0.0)))
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("score"), key))).drop("_l", "_r")
    return rows if k is None else rows.where(F.col("rank") <= k)


def round_robin(df: DataFrame, by: str, order: str) -> DataFrame:
    """One row of each group a turn: ``turn`` and the group key give the order."""
    return df.withColumn("turn", F.row_number().over(Window.partitionBy(by).orderBy(order)))


def prefix_budget(df: DataFrame, by: str, order: str, size: Column, limit: int, keep_first: bool = False) -> DataFrame:
    """Rows while the running size is within the limit; the first overflow ends it.

    Sizes are not negative, so the running sum alone tells.
    """
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    rows = df.withColumn("running", F.sum(size).over(w)).withColumn("_nth", F.row_number().over(Window.partitionBy(by).orderBy(order)))
    ok = F.col("running") <= limit
    return rows.where(ok | (F.col("_nth") == 1) if keep_first else ok).drop("_nth")


def leaders_then_fill(df: DataFrame, batch: str, order: list[Column], k: int) -> DataFrame:
    """Each batch's first row, then the rest, cut to k."""
    rows = df.withColumn("nth", F.row_number().over(Window.partitionBy(batch).orderBy(*order)))
    return rows.orderBy((F.col("nth") > 1), *order).limit(k)


def weighted_order(df: DataFrame, weight: Column, seed: int, key: str) -> DataFrame:
    """Random order in proportion to weights: -ln(u) / w with u from the key's hash."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256), 1, 13)
    u = (F.conv(digits, 16, 10).cast("bigint") + 1) / F.lit(float(2**52))
    return df.withColumn("draw", -F.log(u) / weight)


def moved_cursor(before: Column, end: Column) -> Column:
    """A cursor only moves forward; null counts as not there."""
    return F.greatest(before, end)


def highlight_weight(age_days: Column, citizen: Column, european: Column) -> Column:
    age = F.coalesce(age_days, F.lit(30.0))
    return (1 + 4 * F.exp(-age / 4)) * F.when(citizen, 1.8).otherwise(1.0) * F.when(european, 1.4).otherwise(1.0)


def interval_islands(df: DataFrame, by: str, start: str, end: str, slack: float = 0.25) -> DataFrame:
    """Union of intervals widened by ``slack`` on both sides: (by, lo, hi)."""
    rows = df.select(by, (F.col(start) - slack).alias("lo"), (F.col(end) + slack).alias("hi"))
    order = Window.partitionBy(by).orderBy("lo", "hi")
    reach = F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("new", (reach.isNull() | (F.col("lo") > reach)).cast("int"))
    rows = rows.withColumn("g", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(by, "g").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("g")


def coverage_gaps(regions: DataFrame, segments: DataFrame, by: str, slack: float = 0.25, least: float = 0.02) -> DataFrame:
    """Parts of speech regions that no segment covers, longer than ``least``."""
    covered = interval_islands(segments, by, "start", "end", slack)
    rows = regions.withColumn("region", F.xxhash64(by, "start", "end"))
    cut = rows.join(covered, by, "left").where(F.col("lo").isNull() | ((F.col("hi") > F.col("start")) & (F.col("lo") < F.col("end"))))
    whole = rows.select(by, "region", "start", "end").join(cut.select(by, "region").distinct(), [by, "region"], "left_anti").select(by, F.col("start").alias("gap_start"), F.col("end").alias("gap_end"))
    order = Window.partitionBy(by, "region").orderBy("lo")
    prior = F.coalesce(F.lag("hi").over(order), F.col("start"))
    inner = cut.where("lo is not null").withColumn("p", F.greatest(prior, F.col("start")))
    before = inner.select(by, F.col("p").alias("gap_start"), F.least("lo", "end").alias("gap_end"))
    last = inner.groupBy(by, "region").agg(F.max("hi").alias("gap_start"), F.max("end").alias("gap_end")).select(by, "gap_start", "gap_end")
    bare = cut.where("lo is null").select(by, F.col("start").alias("gap_start"), F.col("end").alias("gap_end"))
    return before.union(last).union(whole).union(bare).where(F.col("gap_end") - F.col("gap_start") > least)


def _binned(df: DataFrame, start: str, end: str) -> DataFrame:
    """Adds the interval's level, the least power of two that is no shorter, if bins of that width can be numbered."""
    s, e = F.col(start).cast("double"), F.col(end).cast("double")
    ok = (F.col(end) >= F.col(start)) & (F.abs(s) < float("inf")) & (F.abs(e) < float("inf"))
    rows = df.where(ok).withColumns({"_s": s, "_e": e})
    level = F.greatest(F.lit(-20), F.ceil(F.log2(F.greatest(F.abs("_s"), F.abs("_e"), F.lit(1.0)))) - 60, F.ceil(F.log2(F.greatest(F.col("_e") - F.col("_s"), F.lit(2.0**-20)))))
    return rows.withColumn("_level", level.cast("int"))


def _in_bins(df: DataFrame, levels: DataFrame) -> DataFrame:
    """A row for each bin that an interval touches at each level that is no lower than its own."""
    rows = df.join(levels, F.col("_at") >= F.col("_level"))
    wide = F.pow(F.lit(2.0), F.col("_at"))
    rows = rows.withColumns({"_low": F.floor(F.col("_s") / wide), "_high": F.floor(F.col("_e") / wide)})
    return rows.withColumn("_bin", F.explode(F.sequence("_low", "_high"))).drop("_s", "_e", "_high")


#: Intervals of a key on one side that the other side's rows meet one by one, without bins.
FEW_INTERVALS = 16


def overlaps(a: DataFrame, b: DataFrame, by: str) -> DataFrame:
    """Pairs of intervals of one key with start < b_end and b_start < end; b's columns but the key get ``b_``.

    An interval touches two bins or so of any level no lower than its own, levels being powers
    of two.  A pair meets at the level of its longer interval, in the first bin that both touch:
    a key's intervals are spread over its bins, and what meets there lies within two bins of each
    other.  Nulls, ends before starts and infinite ends overlap nothing.
    """
    names = [c for c in b.columns if c != by]
    left = _binned(a.where(F.col(by).isNotNull()), "start", "end")
    right = _binned(b.select(F.col(by).alias("_by"), *(F.col(c).alias(f"b_{c}") for c in names)), "b_start", "b_end")
    cross = (F.col("start") < F.col("b_end")) & (F.col("b_start") < F.col("end"))
    most = right.groupBy("_by").agg(F.count("*").alias("_n")).agg(F.max("_n")).first()[0] or 0
    if most <= FEW_INTERVALS:
        pairs = left.join(right, (F.col(by) == F.col("_by")) & cross)
        return pairs.select(*a.columns, *(f"b_{c}" for c in names))
    # of a double's range there are some thousand levels at most
    levels = F.broadcast(left.select("_level").union(right.select("_level")).distinct().select(F.col("_level").alias("_at")))
    x = _in_bins(left, levels)
    y = _in_bins(right, levels).withColumnsRenamed({c: f"{c}_b" for c in ("_level", "_at", "_low", "_bin")})
    same = (F.col(by) == F.col("_by")) & (F.col("_at") == F.col("_at_b")) & (F.col("_bin") == F.col("_bin_b"))
    met = (F.greatest("_level", "_level_b") == F.col("_at")) & (F.col("_bin") == F.greatest("_low", "_low_b"))
    pairs = x.join(y, same & met & cross)
    return pairs.select(*a.columns, *(f"b_{c}" for c in names))
