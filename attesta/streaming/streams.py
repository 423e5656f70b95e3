"""Structured Streaming forms of the incremental paths."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from attesta.operators.budgets import UNIT, units
from attesta.operators.ordered import placed
from attesta.sources.tables import if_small


def file_stream(spark: SparkSession, path: str, like: DataFrame, files_per_trigger: int = 1) -> DataFrame:
    """A Parquet folder as a stream, with the columns of ``like``."""
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def timed(df: DataFrame, at: str, late: str) -> DataFrame:
    """Event time with a watermark; stamps without zone are cast first."""
    return df.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)


def deduplicated(df: DataFrame, keys: list[str]) -> DataFrame:
    """First row of each key inside the watermark."""
    return df.dropDuplicatesWithinWatermark(keys)


def window_counts(df: DataFrame, at: str, size: str, by: list[str], slide: str | None = None) -> DataFrame:
    """Counts by tumbling or sliding window."""
    w = F.window(at, size, slide) if slide else F.window(at, size)
    return df.groupBy(w.alias("w"), *by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *by, "n")


def sessions(df: DataFrame, at: str, gap: str, key: str) -> DataFrame:
    """Counts of sessions that end after a gap."""
    return df.groupBy(F.session_window(at, gap).alias("w"), key).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def running_cursor(df: DataFrame, key: str, at: str) -> DataFrame:
    """Cursor per source that only moves forward, kept in arbitrary state."""
    kind = dict(df.dtypes)[key]

    def step(name, frames, state):
        best = state.get[0] if state.exists else None
        for pdf in frames:
            top = int(pdf["at"].max())
            best = top if best is None else max(best, top)
        state.update((best,))
        yield pd.DataFrame({key: [name[0]], "cursor": [best]})

    rows = df.select(key, F.unix_micros(F.col(at).cast("timestamp")).alias("at"))
    return rows.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, cursor long", "cursor long", "update", "NoTimeout")


def ledger(df: DataFrame, by: str, order: str, kind: str, ident: str, amount: str, limit: float, event: str | None = None) -> DataFrame:
    """(by, ident, kind, at, outcome, spent) of budget events as they arrive, by the rules of ``budgets.ledger``.

    A ledger's state is what it spent, its open reservations and the ids it was asked for; a batch's events are
    taken in order of ``order`` (microseconds) and ident, batches as they come.  ``event``, a column that tells events
    of one time apart, goes ahead of ident in that order and is returned as well.
    """
    kinds = dict(df.dtypes)
    own = [event] if event else []
    top = round(limit * UNIT)

    def step(name, frames, state):
        spent, kept = state.get if state.exists else (0, "[{}, []]")
        open_, asked = json.loads(kept)
        asked, out = set(asked), []
        rows = pd.concat(list(frames)).sort_values(["at", *own, "ident"])
        for i, told, at, n, *known in rows[["ident", "kind", "at", "units", *own]].itertuples(index=False):
            key, n = str(i), None if pd.isna(n) else int(n)
            if told == "reserve" and n is not None and key not in asked:
                asked.add(key)
                outcome = "accepted" if spent + n <= top else "refused"
                if outcome == "accepted":
                    spent, open_[key] = spent + n, n
            elif told == "settle":
                outcome = "settled" if n is not None and key in open_ else "ignored"
                if outcome == "settled":
                    spent += n - open_.pop(key)
            else:
                outcome = "invalid"
            out.append((name[0], i, told, at, outcome, spent / UNIT, *known))
        state.update((spent, json.dumps([open_, sorted(asked)])))
        yield pd.DataFrame(out, columns=[by, "ident", "kind", "at", "outcome", "spent", *own])

    rows = df.where(F.col(by).isNotNull() & F.col(ident).isNotNull())
    rows = rows.select(by, F.col(ident).alias("ident"), F.col(kind).alias("kind"), F.unix_micros(F.col(order).cast("timestamp")).alias("at"), units(F.col(amount).cast("double")).cast("double").alias("units"), *own)
    return rows.groupBy(by).applyInPandasWithState(step, f"{by} {kinds[by]}, ident {kinds[ident]}, kind string, at long, outcome string, spent double{''.join(f', {c} {kinds[c]}' for c in own)}", "spent long, kept string", "append", "NoTimeout")


def insert_batches(df: DataFrame, target: str, key: str, checkpoint: str) -> StreamingQuery:
    """Idempotent append: each micro-batch adds only ids the target lacks.

    A batch has a folder of its own, named by checkpoint and batch id, and is
    compared with all other folders, so a repeated batch writes the same rows.
    The target's ids are read but not shuffled: a batch's ids go to them if they
    are few, and only those found come back.
    """
    run = hashlib.sha256(checkpoint.encode()).hexdigest()[:12]

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        own = f"run-{run}-{number:09d}"
        fresh = batch.dropDuplicates([key])
        try:
            old = spark.read.schema(batch.schema).parquet(f"{target}/run-*").where(~F.contains("_metadata.file_path", F.lit(f"/{own}/"))).select(key)
            asked = if_small(fresh.select(key), 64)
            fresh = fresh.join(old.join(asked, key, "left_semi").distinct(), key, "left_anti")
        except AnalysisException as e:  # the first batch has no target yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
        fresh.write.mode("overwrite").parquet(f"{target}/{own}")

    return df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def numbered_batches(df: DataFrame, target: str, token: str, order: str, checkpoint: str) -> StreamingQuery:
    """Running numbers for new tokens: (token, number) in folders of ``target``, one a micro-batch.

    A token keeps its number; new ones of a batch follow the highest number in order of ``order``,
    ties by token.  A repeated batch, as after a restart, sees only the folders before it and so gives
    the same numbers again.  Ids are placed by ranges: no task holds a batch.
    """
    kind = dict(df.dtypes)[token]

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        schema = f"{token} {kind}, number long"
        try:
            old = spark.read.schema(schema).parquet(f"{target}/batch-*").where(F.regexp_extract("_metadata.file_path", r"/batch-(\d{9})/[^/]*$", 1) < f"{number:09d}")
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            old = spark.createDataFrame([], schema)
        known = old.select(F.col(token).alias("_known"))
        fresh = batch.where(F.col(token).isNotNull()).groupBy(token).agg(F.min(order).alias("_order")).join(known, F.col(token) == F.col("_known"), "left_anti")
        top = old.agg(F.coalesce(F.max("number"), F.lit(0)).alias("_top"))
        new = placed(fresh, F.col("_order"), [token], "_n").crossJoin(F.broadcast(top))
        new.select(token, (F.col("_n") + F.col("_top")).cast("long").alias("number")).write.mode("overwrite").parquet(f"{target}/batch-{number:09d}")

    return df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def drained(df: DataFrame, mode: str, checkpoint: str) -> DataFrame:
    """All output of a stream over what is there now, by files beside the checkpoint.

    In complete mode the last batch holds all; in update mode every batch's rows.
    A repeated batch overwrites its own folder.
    """
    spark, schema, out, last = df.sparkSession, df.schema, f"{checkpoint}-rows", []

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch-{number:09d}")
        last.append(number)

    df.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    if not last:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{out}/batch-{last[-1]:09d}" if mode == "complete" else f"{out}/*")


def drained_to_files(df: DataFrame, checkpoint: str) -> DataFrame:
    """All appended rows of a stream over what is there now, by files beside the checkpoint."""
    path = f"{checkpoint}-rows"
    q = df.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(path)


def closed_before(df: DataFrame, start: str, bound: Column) -> DataFrame:
    """Windows that were closed when the stream ended."""
    return df.where(F.col(start) < bound)
