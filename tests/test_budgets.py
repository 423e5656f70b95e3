"""Budget ledgers against a plain fold, in batch and as a stream."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from attesta.operators import budgets, ordered
from attesta.session import scratch
from attesta.streaming import streams

SCHEMA = "ledger string, at int, kind string, ident string, amount double, outcome_of int"


def plain(events, limit):
    """{(ledger, at, ident): (outcome, spent)} of events that have a ledger."""
    got, state = {}, {}
    for by, at, kind, ident, amount in sorted((e for e in events if e[0] is not None), key=lambda e: (e[0], e[1], e[3])):
        spent, held, asked = state.setdefault(by, [0, {}, set()])
        n = round(amount * 1e6) if amount is not None and amount == amount and 0 <= amount < 1e12 else None
        outcome = "invalid"
        if kind == "reserve" and n is not None and ident not in asked:
            asked.add(ident)
            outcome = "accepted" if spent + n <= limit * 1e6 else "refused"
            if outcome == "accepted":
                spent, held[ident] = spent + n, n
        elif kind == "settle":
            outcome = "settled" if n is not None and ident in held else "ignored"
            if outcome == "settled":
                spent += n - held.pop(ident)
        state[by][0] = spent
        got[by, at, ident] = (outcome, spent / 1e6)
    return got


def batch(spark, events, limit):
    got = budgets.ledger(spark.createDataFrame([(*e, 1) for e in events], SCHEMA), "ledger", ["at"], "kind", "ident", "amount", limit)
    return {(r.ledger, r.at, r.ident): (r.outcome, r.spent) for r in got.collect()}


def test_a_refused_reservation_does_not_count(spark):
    got = batch(spark, [("l", i, "reserve", f"r{i}", a) for i, a in enumerate((60.0, 50.0, 30.0))], 100.0)
    assert [got["l", i, f"r{i}"] for i in range(3)] == [("accepted", 60.0), ("refused", 60.0), ("accepted", 90.0)]


def test_settlements_count_once(spark):
    events = [("l", 0, "reserve", "a", 80.0), ("l", 1, "reserve", "b", 30.0), ("l", 2, "settle", "b", 1.0), ("l", 3, "settle", "a", 10.0), ("l", 4, "settle", "a", 5.0), ("l", 5, "reserve", "c", 90.0), ("l", 6, "settle", "c", None), ("l", 7, "settle", "c", -1.0), ("l", 8, "settle", "d", 1.0), ("l", 9, "settle", "c", 95.0), ("l", 10, "reserve", "a", 1.0), ("l", 11, "reserve", "e", float("nan")), ("l", 12, "other", "f", 1.0)]
    got = batch(spark, events, 100.0)
    assert got == plain(events, 100.0)
    assert [got[e[0], e[1], e[3]][0] for e in events] == ["accepted", "refused", "ignored", "settled", "ignored", "accepted", "ignored", "ignored", "ignored", "settled", "invalid", "invalid", "invalid"]


def some(seed, n):
    rng = random.Random(seed)
    events = []
    for i in range(n):
        ask = rng.random() < 0.6
        amount = rng.choice([None, -1.0, float("inf"), 0.0]) if rng.random() < 0.1 else rng.choice([0.1, 0.2, 0.3, 1.0, 7.5, 20.0])
        events.append((rng.choice(["hot", "hot", "hot", "a", "b"]), i, "reserve" if ask else "settle", f"i{rng.randrange(max(1, i - 12), i + 2)}", amount))
    return events


@pytest.mark.parametrize("seed,limit", [(0, 15.0), (1, 60.0), (2, 1e6)])
def test_ledgers_are_those_of_a_plain_fold(spark, monkeypatch, seed, limit):
    monkeypatch.setattr(ordered, "ROWS_PER_RANGE", 70)
    monkeypatch.setattr(ordered, "SUM_ROWS", 9)
    events = some(seed, 400)
    got = batch(spark, [*events, (None, 3, "reserve", "x", 1.0), (None, 3, "reserve", "y", 1.0)], limit)
    assert got.pop((None, 3, "x")) == got.pop((None, 3, "y")) == ("invalid", None)
    assert got == plain(events, limit)


def test_empty_ledger(spark):
    assert batch(spark, [], 1.0) == {}


def test_stream_goes_on_from_its_checkpoint(spark, tmp_path):
    events = some(5, 120)
    start = datetime.datetime(2026, 1, 1)
    schema = "ledger string, ts timestamp, kind string, ident string, amount double"
    check = scratch(spark, "ledger")
    for part in (events[:50], events[50:80], events[80:]):
        spark.createDataFrame([(e[0], start + datetime.timedelta(seconds=e[1]), *e[2:]) for e in part], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        rows = streams.ledger(streams.file_stream(spark, str(tmp_path / "in"), spark.createDataFrame([], schema)), "ledger", "ts", "kind", "ident", "amount", 60.0)
        got = streams.drained_to_files(rows, check)
    first = int(start.replace(tzinfo=datetime.timezone.utc).timestamp())
    assert {(r.ledger, r.at // 1_000_000 - first, r.ident): (r.outcome, r.spent) for r in got.collect()} == plain(events, 60.0)


def test_places_split_a_value_that_all_rows_share(spark, monkeypatch):
    monkeypatch.setattr(ordered, "ROWS_PER_RANGE", 100)
    df = spark.range(1000).select(F.lit(7).alias("v"), (F.col("id") % 500).alias("t"), "id").repartition(4)
    rows = ordered.placed(df, F.col("v"), ["t"], "p")
    got = rows.collect()
    assert sorted(r.p for r in got) == list(range(1, 1001)) and all((r.p - 1) // 2 == r.t for r in got)
    nulls = ordered.placed(spark.createDataFrame([(None, 1), (5, 2), (1, 3)], "v int, t int"), F.col("v"), ["t"], "p", nulls_first=True)
    assert {r.t: r.p for r in nulls.collect()} == {1: 1, 3: 2, 2: 3}


def test_stream_ledger_tells_events_of_one_time_apart(spark, tmp_path):
    from attesta.plans.streams import stream_ledger

    start = datetime.datetime(2024, 1, 1)
    kinds = ("view", "signup", "purchase", "error", "click")
    rows = [(i, start + datetime.timedelta(seconds=(i * 7 % 200) // 9), i % 3, kinds[i % 5], 40.0 + i % 11, "{}") for i in range(200)]
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    from attesta.plans.state import budget_ledger

    want = sorted(map(tuple, budget_ledger(spark, str(tmp_path)).collect()))
    assert len(want) == 200 and sorted(map(tuple, stream_ledger(spark, str(tmp_path)).collect())) == want
