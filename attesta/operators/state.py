"""Immutable inserts, upserts, retention, ledgers and item states, as plans.

Nothing is changed in place: each function returns the next version of a table
(or its additions), which the caller writes as a new version directory.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import placed


def insert_faults(new: DataFrame, old: DataFrame, key: str, digest: str) -> DataFrame:
    """(key, fault) that keep a whole request from being written."""
    bad = new.where(F.col(key).isNull() | F.col(digest).isNull()).select(key, F.lit("bad envelope").alias("fault"))
    rows = new.select(key, digest, F.lit(True).alias("_new")).union(old.select(key, digest, F.lit(False)))
    # dealt by key ahead of all grouping: a task holds its share of the keys, not what its file has
    each = rows.repartition(F.col(key)).groupBy(key, digest).agg(F.count_if("_new").alias("_n"), F.count_if(~F.col("_new")).alias("_o")).where(F.col(digest).isNotNull())
    said, kept = F.col("_n") > 0, F.col("_o") > 0
    sets = each.groupBy(key).agg(F.count_if(said).alias("_said"), F.count_if(kept).alias("_kept"), F.count_if(said & kept).alias("_same"))
    twice = F.when(F.col("_said") > 1, F.lit("conflict in request"))
    # two sets of digests have no unequal pair only where both are the same single one
    stored = F.when(F.col(key).isNotNull() & F.expr("_said > 0 and _kept > 0 and not (_said = 1 and _kept = 1 and _same = 1)"), F.lit("conflict with stored"))
    return bad.union(sets.select(key, F.explode(F.array_compact(F.array(twice, stored))).alias("fault")))


def immutable_insert(new: DataFrame, old: DataFrame, key: str, digest: str) -> DataFrame:
    """Rows to append; stored ids are no-ops.  A request with a fault is an error as
    a whole: ``insert_faults`` says which."""
    n = insert_faults(new, old, key, digest).agg(F.count("*").alias("_n"))
    faults = n.select(F.when(F.col("_n") == 0, F.lit(0)).otherwise(F.raise_error(F.format_string("insert refused, faults: %d", "_n")).cast("int")).alias("_faults"))
    # what is stored goes first, and both steps find the rows dealt by key
    fresh = new.repartition(F.col(key)).join(old.select(key), key, "left_anti").dropDuplicates([key])
    return fresh.crossJoin(F.broadcast(faults)).where("_faults = 0").select(new.columns)


def accepted(new: DataFrame, valid: Column) -> DataFrame:
    """(accepted): the number of rows of an upsert that count."""
    return new.agg(F.count_if(F.coalesce(valid, F.lit(False))).alias("accepted"))


def upsert_keep(old: DataFrame, new: DataFrame, key: str, kept: list[str], valid: Column) -> DataFrame:
    """Merge by key: new values win, but a null never replaces a ``kept`` column.

    Invalid rows are left out; of repeated keys in the request the last by all
    columns counts.
    """
    good = new.where(F.coalesce(valid, F.lit(False)))
    one = good.groupBy(key).agg(F.max(F.struct(*(c for c in new.columns if c != key))).alias("n"))
    both = old.withColumn("_o", F.lit(True)).join(one, key, "full")
    cols = []
    for c in old.columns:
        if c == key:
            cols.append(F.col(key))
        elif c in kept:
            cols.append(F.coalesce(F.col(f"n.{c}"), F.col(c)).alias(c))
        else:
            cols.append(F.when(F.col("n").isNotNull(), F.col(f"n.{c}")).otherwise(F.col(c)).alias(c))
    return both.select(*cols)


def purge(df: DataFrame, created: str, now: Column, days: int, payload: str) -> DataFrame:
    """Overwrites expired payloads with a marker and sets ``purged_at``; ids stay."""
    if not 1 <= days <= 30:
        raise ValueError("days must be from 1 to 30")
    gone = F.col("purged_at").isNull() & (F.col(created) < now - F.expr(f"interval {days} days"))
    gone = F.coalesce(gone, F.lit(False))
    return df.withColumn("_gone", gone).withColumn(payload, F.when(F.col("_gone"), F.lit('{"purged":true}')).otherwise(F.col(payload))).withColumn("purged_at", F.when(F.col("_gone"), now).otherwise(F.col("purged_at"))).drop("_gone")


def open_batch(headers: DataFrame, batch: str, config_hash: str) -> DataFrame:
    """The batch header, new or stored; an error where the configuration changed."""
    spark = headers.sparkSession
    want = spark.createDataFrame([(batch, config_hash)], "batch_id string, want string")
    same = F.col("config_hash").isNull() | (F.col("config_hash") == F.col("want"))
    checked = F.when(same, F.col("want")).otherwise(F.raise_error(F.lit("configuration of a frozen batch changed")))
    return want.join(headers.select("batch_id", "config_hash"), "batch_id", "left").select("batch_id", checked.alias("config_hash"))


#: States that end a stage without completing it.
FAILURES = ("failed", "pending_budget", "awaiting_validation")


def complete_stage(stages: Column, stage: Column, status: Column) -> Column:
    """Stage set with one more, once; failures add nothing."""
    return F.when(status.isin(*FAILURES), stages).otherwise(F.array_union(stages, F.array(stage)))


def assign_sequence(tokens: DataFrame, token: str, order: str, assigned: DataFrame) -> DataFrame:
    """(token, number): known tokens keep theirs, new ones follow in order of arrival."""
    top = assigned.agg(F.coalesce(F.max("number"), F.lit(0)).alias("_top"))
    fresh = tokens.groupBy(token).agg(F.min(order).alias("_at")).join(assigned, token, "left_anti")
    new = placed(fresh, F.col("_at"), [token], "_n").crossJoin(F.broadcast(top)).select(token, (F.col("_n") + F.col("_top")).cast("long").alias("number"))
    return assigned.select(token, F.col("number").cast("long").alias("number")).union(new)


def clone_batch(df: DataFrame, old: str, new: str) -> DataFrame:
    """Rows of a batch under another id; purged rows are an error."""
    rows = df.where(F.col("batch_id") == old)
    id_ = F.when(F.col("purged_at").isNull(), F.concat(F.lit(new), F.expr(f"substring(id, {len(old) + 1})"))).otherwise(F.raise_error(F.lit("purged rows cannot be cloned")))
    return rows.withColumn("id", id_).withColumn("batch_id", F.lit(new))


def settled(reservations: DataFrame, settlements: DataFrame, key: str) -> DataFrame:
    """Cost per reservation: settled once, at the first settlement; unknown usage keeps it."""
    first = settlements.groupBy(key).agg(F.min_by("amount", "settlement_id").alias("used"))
    return reservations.join(first, key, "left").select(key, F.coalesce("used", "amount").alias("cost"))


def once_a_month(requests: DataFrame, key: str, at: str, made: DataFrame) -> DataFrame:
    """First request of each key and month that was not made before."""
    rows = requests.withColumn("month", F.date_format(at, "yyyy-MM"))
    first = rows.groupBy(key, "month").agg(F.min(at).alias(at))
    return first.join(made.select(key, "month"), [key, "month"], "left_anti")


def project_categories(df: DataFrame, items: str, dropped: str) -> DataFrame:
    """Drops one category from an array of structs and hashes the row anew."""
    kept = F.filter(F.col(items), lambda x: x["category"] != dropped)
    return df.withColumn(items, kept).withColumn("label_hash", F.sha2(F.to_json(F.struct(F.array_sort(kept).alias("x"))), 256))


def requeue(status: Column, reviewed: Column, version: Column, current: str) -> Column:
    """pending where a provisional, unreviewed item has an old version."""
    old = (status == "provisional") & ~F.coalesce(reviewed, F.lit(False)) & (version != current)
    return F.when(F.coalesce(old, F.lit(False)), "pending").otherwise(status)


def overlay(items: DataFrame, corrections: DataFrame, key: str, fingerprint: str, fields: list[str]) -> DataFrame:
    """Corrections of items whose fingerprint still matches; others are stale."""
    c = corrections.select(key, F.col(fingerprint).alias("_fp"), *(F.col(f).alias(f"c_{f}") for f in fields))
    rows = items.join(c, key, "left")
    fits = F.coalesce(F.col("_fp") == F.col(fingerprint), F.lit(False))
    out = [F.when(fits, F.coalesce(F.col(f"c_{f}"), F.col(f))).otherwise(F.col(f)).alias(f) for f in fields]
    rest = [c for c in items.columns if c not in fields]
    return rows.select(*rest, *out, F.when(F.col("_fp").isNull(), "none").when(fits, "applied").otherwise("stale").alias("correction"))


def bound_override(items: DataFrame, overrides: DataFrame, key: str, url: str, text: str, summary: str) -> DataFrame:
    """Summary overrides that match url and text hash and have 1 to 45 words."""
    o = overrides.select(key, F.col("url").alias("_u"), F.col("text_hash").alias("_h"), F.col("summary").alias("_s"))
    words = F.size(F.filter(F.split("_s", r"\s+"), lambda w: w != ""))
    fits = (F.col("_u") == F.col(url)) & (F.col("_h") == F.sha2(F.col(text), 256)) & words.between(1, 45)
    return items.join(o, key, "left").withColumn(summary, F.when(F.coalesce(fits, F.lit(False)), F.col("_s")).otherwise(F.col(summary))).drop("_u", "_h", "_s")


def item_status(reviewed: Column, has_text: Column, complete: Column, label_ok: Column, label: Column) -> Column:
    """State of a published item from its inputs."""
    return (
        F.when(F.coalesce(reviewed, F.lit(False)), "human_reviewed")
        .when(~F.coalesce(has_text, F.lit(False)), "no_text")
        .when(~F.coalesce(complete, F.lit(False)), "source_incomplete")
        .when(label.isNull(), "pending")
        .when(F.coalesce(label_ok, F.lit(False)), "provisional")
        .otherwise("needs_review")
    )


def queued(calibration: Column, status: Column, routine: Column) -> Column:
    """Whether an item goes to review."""
    return F.coalesce(calibration, F.lit(False)) | status.isin("needs_review", "source_incomplete") | F.coalesce(routine, F.lit(False))


def discovery_start(requested: Column, cursor: Column, initial: Column) -> Column:
    return F.coalesce(requested, cursor, initial)


def discovered(found: DataFrame, known: DataFrame, key: str, date: str) -> DataFrame:
    """Known and new items; a known item's date follows the newest finding."""
    new = found.groupBy(key).agg(F.max(date).alias("_d"))
    stored = known.withColumn("_known", F.lit(True))
    return stored.join(new, key, "full").select(key, F.coalesce("_d", date).alias(date), F.col("_known").isNull().alias("is_new"))


def day_mode(cursors: DataFrame, ready: Column, cursor: Column, target: Column) -> DataFrame:
    """classify where all ready sources have come to the target, else collect."""
    return cursors.where(ready).agg(F.when(F.bool_and(cursor >= target), "classify").otherwise("collect").alias("mode"))


def due_today(local: Column, last_day: Column) -> Column:
    """Inside the five-minute window from 15:00, and not yet run this local day."""
    minute = F.hour(local) * 60 + F.minute(local)
    return minute.between(900, 904) & ~F.coalesce(last_day == F.to_date(local), F.lit(False))


def reconciled_findings(findings: DataFrame, items: DataFrame, key: str, supported) -> DataFrame:
    """Findings with the issues that hold, dropped where none does.

    ``supported(issue)`` may use columns of the finding and its item.  Findings
    whose item is unknown or whose source was not verified stay as they are.
    """
    rows = findings.join(items.withColumn("_item", F.lit(True)), key, "left").withColumn("_kept", F.filter("issues", supported))
    as_is = F.col("_item").isNull() | (F.col("status") == "source_unverified")
    rows = rows.withColumn("issues", F.when(F.coalesce(as_is, F.lit(False)), F.col("issues")).otherwise(F.col("_kept")))
    return rows.where(F.coalesce(as_is, F.lit(False)) | (F.size("issues") > 0)).select(findings.columns)


def single_requeue(items: DataFrame, identity: dict[str, str], status: str = "status") -> DataFrame:
    """pending for the one item on which all identity fields agree."""
    same = F.lit(True)
    for c, v in identity.items():
        same = same & F.col(c).eqNullSafe(F.lit(v))
    return items.withColumn(status, F.when(same, "pending").otherwise(F.col(status)))
