"""Versioned state: atomic failure, idempotency, retention."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from attesta.operators import state, validation
from attesta.streaming import streams


def frame(spark, rows):
    return spark.createDataFrame(rows, "id string, digest string")


def test_insert_is_idempotent_and_atomic(spark):
    old = frame(spark, [("a", "1"), ("b", "2")])
    same = frame(spark, [("a", "1"), ("c", "3"), ("c", "3")])
    assert [r.id for r in state.immutable_insert(same, old, "id", "digest").collect()] == ["c"]
    assert state.immutable_insert(same, old.union(frame(spark, [("c", "3")])), "id", "digest").count() == 0
    for bad in ([("a", "9"), ("d", "4")], [("d", "4"), ("d", "5")], [("d", None), ("e", "1")]):
        with pytest.raises(Exception, match="insert refused"):
            state.immutable_insert(frame(spark, bad), old, "id", "digest").collect()


def test_insert_deals_rows_by_key_once(spark):
    rng = random.Random(11)
    some = lambda n: [(rng.choice(["a", "b", "c", "d", None]), rng.choice(["1", "2", None])) for _ in range(n)]
    for _ in range(8):
        new, old = some(rng.randint(1, 5)), some(rng.randint(0, 5))
        want = [(k, "bad envelope") for k, d in new if k is None or d is None]
        told = {k: {d for x, d in new if x == k and d is not None} for k, _ in new}
        want += [(k, "conflict in request") for k, ds in told.items() if len(ds) > 1]
        want += [(k, "conflict with stored") for k, ds in told.items() if k is not None and any(x == k and y is not None and y != d for d in ds for x, y in old)]
        got = [tuple(r) for r in state.insert_faults(frame(spark, new), frame(spark, old), "id", "digest").collect()]
        assert Counter(got) == Counter(want)
    plan = state.immutable_insert(frame(spark, [("a", "1")]), frame(spark, [("b", "1")]), "id", "digest")._jdf.queryExecution().executedPlan().toString()
    # one for the faults, two for the rows to append: digests are neither grouped ahead of them nor joined
    assert plan.count("Exchange hashpartitioning") == 3


def test_upsert_keeps_dates_and_drops_invalid(spark):
    old = spark.createDataFrame([("a", "x", "2026-01-01")], "id string, t string, d string")
    new = spark.createDataFrame([("a", "y", None), ("b", "bad", "2026-01-02"), ("c", "z", None)], "id string, t string, d string")
    got = {(r.id, r.t, r.d) for r in state.upsert_keep(old, new, "id", ["d"], F.col("t") != "bad").collect()}
    assert got == {("a", "y", "2026-01-01"), ("c", "z", None)}


def test_purge_bounds(spark):
    df = spark.createDataFrame([("a", "2026-01-01", "p", None), ("b", "2026-01-20", "p", None)], "id string, created string, payload string, purged_at string").withColumn("created", F.col("created").cast("timestamp")).withColumn("purged_at", F.col("purged_at").cast("timestamp"))
    got = {r.id: r.purged_at is not None for r in state.purge(df, "created", F.lit("2026-01-25").cast("timestamp"), 10, "payload").collect()}
    assert got == {"a": True, "b": False}
    for days in (0, 31):
        with pytest.raises(ValueError):
            state.purge(df, "created", F.current_timestamp(), days, "payload")


def test_frozen_configuration(spark):
    headers = spark.createDataFrame([("2026-W40", "h")], "batch_id string, config_hash string")
    assert state.open_batch(headers, "2026-W41", "k").first().config_hash == "k"
    assert state.open_batch(headers, "2026-W40", "h").first().config_hash == "h"
    with pytest.raises(Exception, match="configuration"):
        state.open_batch(headers, "2026-W40", "k").collect()


def test_sequence_is_stable(spark):
    t = spark.createDataFrame([("x", 2), ("y", 1), ("x", 3)], "token string, at int")
    none = spark.createDataFrame([], "token string, number long")
    first = state.assign_sequence(t, "token", "at", none)
    assert dict(map(tuple, first.collect())) == {"y": 1, "x": 2}
    more = t.union(spark.createDataFrame([("z", 0)], "token string, at int"))
    assert dict(map(tuple, state.assign_sequence(more, "token", "at", first).collect())) == {"y": 1, "x": 2, "z": 3}


def test_settlement_counts_once(spark):
    r = spark.createDataFrame([("a", 5.0), ("b", 5.0)], "id string, amount double")
    s = spark.createDataFrame([("a", 1.0, 1), ("a", 9.0, 2)], "id string, amount double, settlement_id int")
    assert dict(map(tuple, state.settled(r, s, "id").collect())) == {"a": 1.0, "b": 5.0}


def test_bound_override(spark):
    items = spark.createDataFrame([("a", "u", "text", "old"), ("b", "u", "text", "old")], "id string, url string, text string, summary string")
    o = items.select("id", F.lit("u").alias("url"), F.when(F.col("id") == "a", F.sha2("text", 256)).otherwise("x").alias("text_hash"), F.lit("new one").alias("summary"))
    assert dict((r.id, r.summary) for r in state.bound_override(items, o, "id", "url", "text", "summary").collect()) == {"a": "new one", "b": "old"}


def test_daily_window(spark):
    at = lambda s: F.lit(s).cast("timestamp")
    got = spark.range(1).select(state.due_today(at("2026-01-01 15:04:59"), F.lit(None).cast("date")), state.due_today(at("2026-01-01 15:05:00"), F.lit(None).cast("date")), state.due_today(at("2026-01-01 15:00:00"), F.lit("2026-01-01").cast("date"))).first()
    assert tuple(got) == (True, False, False)


def test_closed_schema(spark):
    df = spark.createDataFrame([('{"a":1,"b":2}',), ('{"a":1}',), ('{"a":1,"b":2,"c":3}',), (None,)], "j string")
    assert [r[0] for r in df.select(validation.foreign_keys(F.col("j"), ["a", "b"])).collect()] == [False, True, True, True]


def test_gate_lists_what_is_missing(spark):
    facts = spark.createDataFrame([(99, 20, ["low"])], "reviews int, clusters int, tiers array<string>")
    r = validation.gate(facts, {"reviews": 100, "clusters": 20}, ["low", "high"]).first()
    assert not r.passed and set(r.missing) == {"fewer than 100 reviews", "tier missing"}


def test_stream_insert_is_idempotent(spark, tmp_path):
    src, target = str(tmp_path / "src"), str(tmp_path / "target")
    spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "id int, v string").write.parquet(src)
    like = spark.read.parquet(src)
    for n in range(2):
        streams.insert_batches(streams.file_stream(spark, src, like, 10), target, "id", str(tmp_path / f"c{n}")).awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(f"{target}/run-*").collect()) == [1, 2]
