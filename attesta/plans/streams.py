"""Streaming queries, drained over the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from attesta.session import scratch
from attesta.streaming import streams

from .registry import query
from .state import LEDGER_SQL, _reservations


def _checkpoint(spark) -> str:
    return scratch(spark, "stream")


#: More files than a table has: all that are there are one batch.
ALL_FILES = (1 << 31) - 1


def _events(spark, sf_dir, files_per_trigger=1):
    raw = spark.read.parquet(f"{sf_dir}/events.parquet")
    return streams.timed(streams.file_stream(spark, f"{sf_dir}/events.parquet*", raw, files_per_trigger), "ts", "1 day")


@query("stream_dedupe", "select event_id, user_id from events")
def stream_dedupe(spark, sf_dir):
    """Distinct events by id; files whose times overlap are one batch, so that no row is late."""
    rows = streams.deduplicated(_events(spark, sf_dir, ALL_FILES), ["event_id"]).select("event_id", "user_id")
    return streams.drained_to_files(rows, _checkpoint(spark))


@query("stream_day_counts", "select cast(ts as date) as day, event_type, count(*) as n from events group by 1, 2")
def stream_day_counts(spark, sf_dir):
    got = streams.window_counts(_events(spark, sf_dir), "ts", "1 day", ["event_type"])
    return streams.drained(got, "complete", _checkpoint(spark)).select(F.to_date("start").alias("day"), "event_type", "n")


@query(
    "stream_session",
    """
with e as (select user_id, ts, case when lag(ts) over (partition by user_id order by ts) is null or ts >= lag(ts) over (partition by user_id order by ts) + interval 6 hours then 1 else 0 end as fresh from events),
s as (select user_id, ts, sum(fresh) over (partition by user_id order by ts rows unbounded preceding) as g from e)
select user_id, min(ts) as start, count(*) as n from s group by user_id, g
""",
)
def stream_session(spark, sf_dir):
    got = streams.sessions(_events(spark, sf_dir), "ts", "6 hours", "user_id")
    return streams.drained(got, "complete", _checkpoint(spark)).select("user_id", "start", "n")


@query("stream_sliding_counts", "with b as (select date_trunc('day', ts) as d, count(*) as n from events group by 1), w as (select distinct d from b union select distinct d - interval 1 day from b) select w.d as start, cast(sum(b.n) as bigint) as n from w join b on b.d >= w.d and b.d < w.d + interval 2 days group by w.d")
def stream_sliding_counts(spark, sf_dir):
    """Two-day windows that slide by a day."""
    got = streams.window_counts(_events(spark, sf_dir), "ts", "2 days", [], "1 day")
    return streams.drained(got, "complete", _checkpoint(spark)).select("start", "n")


@query("stream_cursor", "select user_id, epoch_us(max(ts)) as cursor from events group by user_id")
def stream_cursor(spark, sf_dir):
    """Forward-only cursors in arbitrary state."""
    got = streams.running_cursor(_events(spark, sf_dir), "user_id", "ts")
    rows = streams.drained(got, "update", _checkpoint(spark))
    return rows.groupBy("user_id").agg(F.max("cursor").alias("cursor"))


@query("stream_ledger", LEDGER_SQL)
def stream_ledger(spark, sf_dir):
    """The ledgers of ``budget_ledger`` as a stream; files whose times overlap are one batch."""
    got = streams.ledger(_reservations(_events(spark, sf_dir, ALL_FILES)), "ledger", "ts", "kind", "ident", "amount", 500.0, event="event_id")
    rows = streams.drained_to_files(got, _checkpoint(spark))
    return rows.select("event_id", "outcome", F.round("spent", 6).alias("spent"))


@query("stream_numbers", "select user_id, cast(row_number() over (order by min(ts), user_id) as bigint) as number from events group by user_id")
def stream_numbers(spark, sf_dir):
    """Numbers of users in order of their first event, as a stream; files whose times overlap are one batch."""
    check = _checkpoint(spark)
    streams.numbered_batches(_events(spark, sf_dir, ALL_FILES), f"{check}-numbers", "user_id", "ts", check).awaitTermination()
    return spark.read.schema("user_id long, number long").parquet(f"{check}-numbers/batch-*")
