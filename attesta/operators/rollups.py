"""Aggregations and published rollups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def known_sum(value: Column, name: str) -> list[Column]:
    """Sum of known values, null if none is, and how many are known."""
    return [F.sum(value).alias(name), F.count(value).alias(f"{name}_known")]


def ordered_list(value: Column, order: Column) -> Column:
    """Values in order; an empty list for no rows."""
    return F.transform(F.array_sort(F.collect_list(F.struct(order.alias("k"), value.alias("v")))), lambda x: x["v"])


def ordered_map(key: Column, value: Column) -> Column:
    return F.map_from_entries(F.array_sort(F.collect_list(F.struct(key.alias("key"), value.alias("value")))))


def zero_filled(counts: DataFrame, dim: DataFrame, keys: list[str], n: str = "n") -> DataFrame:
    """All members of a dimension with their counts, 0 where there is none."""
    return dim.join(counts, keys, "left").withColumn(n, F.coalesce(n, F.lit(0)))


def cross_tab(df: DataFrame, a: str, b: str, missing: str = "unclear") -> DataFrame:
    """(a, b, n) with a name for missing values."""
    fill = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(missing)).alias(c)
    return df.select(fill(a), fill(b)).groupBy(a, b).agg(F.count("*").alias("n"))


def joint_or_null(joint: Column, total: Column) -> Column:
    """A joint count; null where only marginals are known and there are rows."""
    return F.when(joint.isNotNull(), joint).when(total > 0, F.lit(None).cast("bigint")).otherwise(F.lit(0).cast("bigint"))


def overlap_ranking(dim: DataFrame, key: str, name: str, members: DataFrame, member: str, total: Column) -> DataFrame:
    """Members per key with overlap; shares of one total may exceed 100 in sum."""
    counts = members.groupBy(key).agg(F.count_distinct(member).alias("n"))
    rows = dim.join(counts, key, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return rows.withColumn("pct", F.when(total > 0, 100.0 * F.col("n") / total)).orderBy(F.desc("n"), F.asc(name))


def agreement(pairs: DataFrame, a: str, b: str, by: list[str]) -> DataFrame:
    """Exact agreement, mean absolute error, non-zero precision and recall."""
    x, y = F.col(a), F.col(b)
    both, claimed, real = F.count_if((x > 0) & (y > 0)), F.count_if(x > 0), F.count_if(y > 0)
    return pairs.where(x.isNotNull() & y.isNotNull()).groupBy(*by).agg(
        F.count("*").alias("n"),
        F.avg((x == y).cast("double")).alias("exact"),
        F.avg(F.abs(x - y).cast("double")).alias("mae"),
        F.when(claimed > 0, both / claimed).alias("precision"),
        F.when(real > 0, both / real).alias("recall"),
    )


def confusion(pairs: DataFrame, a: str, b: str, top: int) -> DataFrame:
    """(top + 1) squared cells, zero-filled."""
    spark = pairs.sparkSession
    grid = spark.range(top + 1).select(F.col("id").cast("int").alias(a)).crossJoin(F.broadcast(spark.range(top + 1).select(F.col("id").cast("int").alias(b))))
    counts = pairs.groupBy(F.col(a).cast("int").alias(a), F.col(b).cast("int").alias(b)).agg(F.count("*").alias("n"))
    return zero_filled(counts, grid, [a, b])


def jaccard(x: Column, y: Column) -> Column:
    """Of two arrays as sets; 1 when both are empty."""
    union = F.size(F.array_union(x, y))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(x, y)) / union)


def concentration(df: DataFrame, by: list[str], member: str) -> DataFrame:
    """Normalised Herfindahl index of members' shares, 0 for one member."""
    counts = df.groupBy(*by, member).agg(F.count("*").alias("c"))
    got = counts.groupBy(*by).agg(F.count("*").alias("n"), F.sum(F.col("c") * F.col("c")).cast("double").alias("sq"), F.sum("c").cast("double").alias("all"))
    raw = F.col("sq") / (F.col("all") * F.col("all"))
    value = F.when(F.col("n") <= 1, 0.0).otherwise((raw - 1.0 / F.col("n")) / (1.0 - 1.0 / F.col("n")))
    return got.select(*by, "n", F.least(F.lit(1.0), F.greatest(F.lit(0.0), value)).alias("hhi"))


def majority(df: DataFrame, by: list[str], label: str, position: str) -> DataFrame:
    """Most common label; of equals the one seen first."""
    counts = df.groupBy(*by, label).agg(F.count("*").alias("n"), F.min(position).alias("first"))
    return counts.groupBy(*by).agg(F.max_by(F.col(label), F.struct("n", -F.col("first"))).alias("majority"), F.max("n").alias("n"))


def framing_score(parts: list[Column]) -> tuple[Column, Column]:
    """(mean of the dimensions, whether all reach 2)."""
    total, strong = F.lit(0.0), F.lit(True)
    for p in parts:
        total, strong = total + p, strong & (p >= 2)
    return total / len(parts), strong


def weighted_mean(parts: list[tuple[Column, float]]) -> Column:
    """Mean over known values, weights renormalised; null if none is known."""
    top, bottom = F.lit(0.0), F.lit(0.0)
    for value, weight in parts:
        top = top + F.coalesce(value, F.lit(0.0)) * weight
        bottom = bottom + F.when(value.isNotNull(), F.lit(weight)).otherwise(0.0)
    return F.when(bottom > 0, top / bottom)


def log_share(value: Column, cap: float) -> Column:
    """log1p of a value as a share of the cap's, 1 at most."""
    return F.least(F.lit(1.0), F.log1p(value) / F.log1p(F.lit(float(cap))))


def progress(batches: DataFrame, key: str, tables: dict[str, DataFrame]) -> DataFrame:
    """Row counts of several tables per batch, 0 where there are none."""
    out = batches.select(key)
    for name, t in tables.items():
        out = out.join(t.groupBy(key).agg(F.count("*").alias(name)), key, "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return out


def reconcile(checks: list[tuple[str, Column]], of: DataFrame) -> DataFrame:
    """(check, passed) of boolean aggregates over one row."""
    row = of.select(F.array(*(F.struct(F.lit(n).alias("check"), F.coalesce(c, F.lit(False)).alias("passed")) for n, c in checks)).alias("all"))
    return row.select(F.explode("all").alias("c")).select("c.check", "c.passed")


def bounded_summary(old: DataFrame, new: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """Summaries that must be monotone (each at most the next) and never shrink.

    ``cols`` go from the innermost count to the outermost; a new row that breaks
    the order or a bound of zero is ignored.
    """
    ok = F.lit(True)
    for a, b in zip(cols, cols[1:]):
        ok = ok & (F.col(a) <= F.col(b))
    good = new.where(F.coalesce(ok & (F.col(cols[0]) >= 0), F.lit(False)))
    both = old.select(key, *(F.col(c).alias(f"o_{c}") for c in cols)).join(good, key, "full")
    grown = F.coalesce(F.col(cols[-1]) >= F.col(f"o_{cols[-1]}"), F.col(cols[-1]).isNotNull())
    return both.select(key, *(F.when(grown, F.col(c)).otherwise(F.col(f"o_{c}")).alias(c) for c in cols))


def workload(done: Column, imported: Column, target: Column) -> list[Column]:
    """(done in all, target, remaining, never below zero)."""
    total, goal = F.sum(done + imported), F.sum(target)
    return [total.alias("done"), goal.alias("target"), F.greatest(F.lit(0), goal - total).alias("remaining")]


def count_checks(videos: DataFrame, inventory: DataFrame, collection: DataFrame, history: DataFrame, missing: DataFrame) -> DataFrame:
    """(check, passed): whether public counts fit together.

    ``videos`` has batch, id, labelled, related, total, human_reviewed,
    classified_comments, retained_comments, and alignment, sentiment and joint as
    maps of counts (joint by ``alignment/sentiment``); ``inventory`` has batch, id
    and caption; ``collection`` is one row of totals, with caption_total;
    ``history`` has id, sampled, classified and related by week; ``missing`` has id.
    Every rule is one aggregate, so nothing but its counts leaves the tables.
    """
    total = lambda m: F.aggregate(F.map_values(m), F.lit(0).cast("bigint"), lambda s, v: s + v)
    part = lambda m, key, n: F.aggregate(F.map_entries(m), F.lit(0).cast("bigint"), lambda s, e: s + F.when(F.split(e["key"], "/")[n] == key, e["value"]).otherwise(0))
    fits = lambda field, n: F.forall(F.map_entries(field), lambda e: part(F.col("joint"), e["key"], n) == e["value"])
    counts = lambda m: F.forall(F.map_values(m), lambda v: v >= 0)
    rules = {
        "comment total": F.col("total") >= 0,
        "reviewed comments": F.col("human_reviewed").between(0, F.col("total")),
        "per-video comment count": F.col("total") == F.col("classified_comments"),
        "classified exceeds retained": F.col("total") <= F.col("retained_comments"),
        "comments without classified video": F.col("labelled") | (F.col("total") == 0),
        "alignment values": counts("alignment"),
        "alignment sum": total("alignment") == F.col("total"),
        "sentiment values": counts("sentiment"),
        "sentiment sum": total("sentiment") == F.col("total"),
        "joint total": F.col("joint").isNull() | (total("joint") == F.col("total")),
        "joint alignment": F.col("joint").isNull() | fits("alignment", 0),
        "joint sentiment": F.col("joint").isNull() | fits("sentiment", 1),
    }
    held = [(name, F.count_if(~F.coalesce(c, F.lit(False))) == 0) for name, c in rules.items()]
    sums = {f"_{c}": F.coalesce(F.sum(c), F.lit(0)) for c in ("total", "human_reviewed", "retained_comments")}
    ids = F.count_distinct(F.struct("batch", "id"))
    v = videos.agg(*(c.alias(f"rule {i}") for i, (_, c) in enumerate(held)), F.count("*").alias("_videos"), ids.alias("_video_ids"), F.count_if("labelled").alias("_labelled"), *(c.alias(n) for n, c in sums.items()))
    i = inventory.agg(F.count("*").alias("_inventory"), ids.alias("_inventory_ids"))
    weeks = inventory.groupBy(F.col("batch").alias("id")).agg(F.count("*").alias("_in"))
    coded = videos.where("labelled").groupBy(F.col("batch").alias("id")).agg(F.count("*").alias("_coded"), F.count_if("related").alias("_rel"))
    h = history.join(weeks, "id", "left").join(coded, "id", "left").join(missing.select("id", F.lit(True).alias("_gap")).distinct(), "id", "left").fillna(0, ["_in", "_coded", "_rel"])
    whole = F.col("_in") == F.col("sampled")
    h = h.agg(
        (F.count("*") == F.count_distinct("id")).alias("_weeks"),
        (F.count_if(~F.coalesce((F.col("sampled") >= 0) & (F.col("classified") >= 0) & (F.col("related") >= 0), F.lit(False))) == 0).alias("_typed"),
        (F.count_if((F.col("related") > F.col("classified")) | (F.col("classified") > F.col("sampled"))) == 0).alias("_bounds"),
        (F.count_if(whole & (F.col("_coded") != F.col("classified"))) == 0).alias("_kept_classified"),
        (F.count_if(whole & (F.col("_rel") != F.col("related"))) == 0).alias("_kept_related"),
        (F.count_if("_gap") == 0).alias("_gaps"),
    )
    row = collection.crossJoin(F.broadcast(v)).crossJoin(F.broadcast(i)).crossJoin(F.broadcast(h))
    checks = [
        ("video duplicates", F.col("_videos") == F.col("_video_ids")),
        ("inventory duplicates", F.col("_inventory") == F.col("_inventory_ids")),
        ("sample size", F.col("sampled_videos") == F.col("_inventory")),
        ("English text coverage", F.col("transcript_eligible") == F.col("_videos")),
        ("classified videos", F.col("classified_videos") == F.col("_labelled")),
        ("missing text", F.col("awaiting_transcript") + F.col("transcript_eligible") == F.col("sampled_videos")),
        ("caption categories", F.col("caption_total") == F.col("_inventory")),
        *((name, F.col(f"rule {n}")) for n, (name, _) in enumerate(held)),
        ("global comments", F.col("classified_comments") == F.col("_total")),
        ("global reviewed comments", F.col("reviewed_comments") == F.col("_human_reviewed")),
        ("global retained comments", F.col("retained_comments") == F.col("_retained_comments")),
        ("duplicate history weeks", F.col("_weeks")),
        ("history count type", F.col("_typed")),
        ("history count bounds", F.col("_bounds")),
        ("retained history classified count", F.col("_kept_classified")),
        ("retained history related count", F.col("_kept_related")),
        ("history gap overlaps saved week", F.col("_gaps")),
    ]
    return reconcile(checks, row)


def batch_health(batches: DataFrame, inventory: DataFrame, labelled: DataFrame) -> DataFrame:
    """(batch, sampled, classified, saved, open, fault) of every batch.

    inventory is (batch, id, saved), labelled has ids, each once.  fault is the first of: nothing sampled, nothing
    classified, saved texts without a classification; or null.
    """
    rows = inventory.join(labelled.select(F.col("id").alias("_done")), F.col("id") == F.col("_done"), "left")
    n = rows.groupBy("batch").agg(F.count("*").alias("sampled"), F.count("_done").alias("classified"), F.count_if("saved").alias("saved"), F.count_if(F.col("saved") & F.col("_done").isNull()).alias("open"))
    got = batches.join(n, "batch", "left").fillna(0, ["sampled", "classified", "saved", "open"])
    fault = F.when(F.col("sampled") == 0, "nothing sampled").when(F.col("classified") == 0, "nothing classified").when(F.col("open") > 0, "saved but unclassified")
    return got.withColumn("fault", fault)


def week_health(batches: DataFrame, inventory: DataFrame, videos: DataFrame, at: Column) -> DataFrame:
    """(batch, fault, sampled, classified) of the last whole week before ``at``.

    fault is the first of: the week is missing, nothing was sampled, nothing was
    classified, saved texts without a classification; or null.
    """
    from attesta.functions.scalar import week_window

    want = batches.sparkSession.range(1).select(week_window(at)[2].alias("batch"))
    own = lambda df: df.join(F.broadcast(want), "batch", "left_semi")
    known = own(batches.select(F.col("id").alias("batch"))).agg(F.count("*").alias("known"))
    sampled = own(inventory).agg(F.count("*").alias("sampled"))
    done = own(videos).where("labelled")
    classified = done.agg(F.count("*").alias("classified"))
    missing = own(inventory).where("caption = 'saved'").join(done.select("id"), "id", "left_anti").agg(F.count_distinct("id").alias("open"))
    row = want.crossJoin(known).crossJoin(sampled).crossJoin(classified).crossJoin(missing)
    fault = F.when(F.col("known") == 0, "sample missing").when(F.col("sampled") == 0, "nothing sampled").when(F.col("classified") == 0, "nothing classified").when(F.col("open") > 0, "saved but unclassified")
    return row.select("batch", fault.alias("fault"), "sampled", "classified", "open")
