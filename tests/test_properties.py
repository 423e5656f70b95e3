"""Operators against plain Python on random inputs."""

import datetime as dt
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from attesta.operators import ordered, sampling, vectors


@pytest.mark.parametrize("seed", [1, 2])
def test_burst_and_tertiles(spark, seed):
    rng = random.Random(seed)
    base = dt.datetime(2024, 1, 1)
    rows = [(rng.choice("abc"), rng.randint(0, 4000), rng.choice([None, *range(40)])) for _ in range(400)]
    df = spark.createDataFrame([(k, base + dt.timedelta(seconds=s), v) for k, s, v in rows], "k string, at timestamp, v int")
    want = {k: max(sum(t <= u <= t + 600 for q, u, _ in rows if q == k) for p, t, _ in rows if p == k) for k in "abc"}
    assert dict(map(tuple, ordered.burst(df, "k", "at").collect())) == want
    known = [v for _, _, v in rows if v is not None]
    tier = lambda v: None if v is None else ("low", "medium", "high")[(sum(x < v for x in known) / len(known) >= 1 / 3) + (sum(x < v for x in known) / len(known) >= 2 / 3)]
    assert {(r.v, r.tier) for r in ordered.tertiles(df, "v").collect()} == {(v, tier(v)) for _, _, v in rows}
    own = {k: [v for q, _, v in rows if q == k and v is not None] for k in "abc"}
    for r in ordered.tertiles(df, "v", ["k"]).where("v is not null").collect():
        share = sum(x < r.v for x in own[r.k]) / len(own[r.k])
        assert r.tier == ("low" if share < 1 / 3 else "medium" if share < 2 / 3 else "high")


@pytest.mark.parametrize("seed", [3, 4])
def test_islands_and_gaps(spark, seed):
    rng = random.Random(seed)
    seg = [("k", s, s + rng.randint(1, 6)) for s in (rng.randint(0, 60) for _ in range(14))]
    df = spark.createDataFrame([(k, float(a), float(b)) for k, a, b in seg], "k string, start double, end double")
    got = sorted((r.lo, r.hi) for r in ordered.interval_islands(df, "k", "start", "end", 0.0).collect())
    want: list[list[int]] = []
    for _, a, b in sorted(seg, key=lambda x: x[1:]):
        if want and a <= want[-1][1]:
            want[-1][1] = max(want[-1][1], b)
        else:
            want.append([a, b])
    assert got == [tuple(map(float, w)) for w in want]
    region = spark.createDataFrame([("k", 0.0, 70.0)], "k string, start double, end double")
    gaps = sum(r.gap_end - r.gap_start for r in ordered.coverage_gaps(region, df, "k", 0.0).collect())
    assert gaps == 70 - sum(b - a for a, b in want)


@pytest.mark.parametrize("seed", [7, 8])
def test_overlaps_are_those_of_the_plain_join(spark, seed):
    rng = random.Random(seed)
    span = lambda: (rng.choice("aab"), s := rng.choice([rng.uniform(-50, 50), float(rng.randint(-9, 9)), 1.7e15]), s + rng.choice([0.0, 0.25, 1.0, rng.random() * 8, 64.0, 5000.0]))
    a, b = [span() for _ in range(120)], [span() for _ in range(120)]
    odd = [("a", 5.0, 4.0), ("a", None, 4.0), ("a", 1.0, None), ("a", 0.0, float("inf")), ("a", float("nan"), 1.0), (None, 0.0, 9.0)]
    frame = lambda rows: spark.createDataFrame([(*r, i) for i, r in enumerate(rows + odd)], "k string, start double, end double, id int")
    got = sorted((r.id, r.b_id) for r in ordered.overlaps(frame(a), frame(b), "k").collect())
    assert got == sorted((i, j) for i, (k, s, e) in enumerate(a) for j, (q, t, f) in enumerate(b) if k == q and s < f and t < e)
    assert len(got) > 500


def test_overlaps_of_one_key_are_spread(spark):
    df = spark.range(20_000).select(F.lit("k").alias("k"), (F.col("id") * 2.0).alias("start"), (F.col("id") * 2.0 + 3).alias("end"))
    got = ordered.overlaps(df, df, "k")
    assert got.count() == 20_000 + 2 * 19_999
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "_at" in plan and "CartesianProduct" not in plan


def test_bursts_of_odd_rows(spark):
    base = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([("a", None), ("b", base), ("b", base), (None, base)], "k string, at timestamp")
    assert set(map(tuple, ordered.burst(df, "k", "at").collect())) == {("a", 0), ("b", 2), (None, 1)}
    assert set(map(tuple, ordered.burst(df, "k", "at", 0).collect())) == {("a", 0), ("b", 2), (None, 1)}
    assert ordered.burst(df.where("false"), "k", "at").count() == 0


@pytest.mark.parametrize("seed", [13, 14])
def test_large_groups_are_clustered_in_rounds(spark, seed, monkeypatch):
    for name, n in (("RANGE_ROWS", 40), ("CELL_ROWS", 30), ("BLOCK_ROWS", 25), ("STRIP_ROWS", 9)):
        monkeypatch.setattr(vectors, name, n)
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(9, 5))
    m = middle[rng.integers(0, 9, 240)] + 0.35 * rng.normal(size=(240, 5))
    m[100:130] = m[20]
    m[130:133] = 0
    group = [None if i % 40 == 7 else "small" if i % 8 == 0 else "big" for i in range(240)]
    df = spark.createDataFrame([(i, group[i], [float(x) for x in v]) for i, v in enumerate(m)] + [(900, "big", None)], "id long, g string, v array<double>")
    got: dict = {}
    for r in vectors.complete_link(df, "g", "id", "v", 0.8, 2).collect():
        got.setdefault(r.g, {}).setdefault(r.cluster, []).append(r.id)
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    u = np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)
    sim = u @ u.T
    for g in ("big", "small", None):
        plain: list[list[int]] = []
        for i in (i for i in range(240) if group[i] == g):
            home = next((c for c in plain if all(sim[i, j] >= 0.8 - 1e-12 for j in c)), None)
            plain.append([i]) if home is None else home.append(i)
        assert {n: sorted(c) for n, c in got.get(g, {}).items()} == dict(enumerate(c for c in plain if len(c) > 1))
    assert len(got["big"]) > 8


@pytest.mark.parametrize("seed", [11, 12])
def test_cells_leave_out_nothing_that_is_near(spark, seed, monkeypatch):
    for name, n in (("CELL_ROWS", 25), ("BLOCK_ROWS", 20), ("STRIP_ROWS", 7)):
        monkeypatch.setattr(vectors, name, n)
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(12, 6))
    m = middle[rng.integers(0, 12, 300)] + 0.1 * rng.normal(size=(300, 6))
    m[40:70] = m[3]  # copies of one vector, and vectors of no length
    m[70:74] = 0
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)] + [(999, None)], "id long, v array<double>")
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    u = np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)
    sim = np.round(u @ u.T, 12)
    want = {(q, int(n), r) for q in range(300) for r, n in enumerate(np.lexsort((np.arange(300), -sim[q]))[:5], 1)}
    assert {(r.query, r.neighbour, r["rank"]) for r in vectors.knn(df, "id", "v", 5).collect()} == want
    for least in (0.9, -0.2):
        assert {(r.a, r.b) for r in vectors.similar_pairs(df, "id", "v", least).collect()} == {(i, j) for i in range(300) for j in range(i + 1, 300) if (u @ u.T)[i, j] >= least}
    cells = vectors.Cells(df, "id", "v")
    visits = vectors.nearest_visits(cells, cells.rows.select("key", "vector"), 5)
    assert cells.pairs(visits) < 0.6 * 300 * 300
    assert cells.pairs(cells.visits(cells.rows.select("key", "vector"), least=0.9)) < 0.5 * 300 * 300
    assert vectors.knn(df.where("false"), "id", "v", 5).count() == 0
    assert vectors.knn(df, "id", "v", 400).count() == 300 * 300


def test_hash_places_are_the_global_order(spark):
    df = spark.range(3000).withColumn("h", sampling.key_hash("s", F.col("id"))).withColumn("late", (F.col("id") % 2).cast("int"))
    got = sampling.placed_by_hash(df, "late", "h", "id").select("late", "h", "id", "place").collect()
    assert [r.place for r in sorted(got, key=lambda r: (r.late, r.h, r.id))] == list(range(1, 3001))


@pytest.mark.parametrize("seed", [5, 6])
def test_search_and_clusters(spark, seed, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK_ROWS", 32)
    rng = np.random.default_rng(seed)
    m = rng.normal(size=(90, 5))
    df = spark.createDataFrame([(i, i % 3, [float(x) for x in v]) for i, v in enumerate(m)], "id long, g long, v array<double>")
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    sim = u @ u.T
    near = {(r.query, r.neighbour) for r in vectors.knn(df, "id", "v", 4).collect()}
    assert near == {(i, int(j)) for i in range(90) for j in np.argsort(-sim[i], kind="stable")[:4]}
    pairs = {(r.a, r.b) for r in vectors.similar_pairs(df, "id", "v", 0.6).collect()}
    assert pairs == {(i, j) for i in range(90) for j in range(i + 1, 90) if sim[i, j] >= 0.6}
    for g in range(3):
        groups: list[list[int]] = []
        for i in range(g, 90, 3):
            home = next((c for c in groups if all(sim[i, j] >= 0.3 for j in c)), None)
            groups.append([i]) if home is None else home.append(i)
        got: dict[int, list[int]] = {}
        for r in vectors.complete_link(df.where(F.col("g") == g), "g", "id", "v", 0.3).collect():
            got.setdefault(r.cluster, []).append(r.id)
        assert sorted(map(sorted, got.values())) == sorted(map(sorted, groups))


@pytest.mark.parametrize("seed", [7, 8])
def test_recurrence_clusters(spark, seed, tmp_path):
    from attesta.plans.vectors import recurrence_clusters

    rng = np.random.default_rng(seed)
    m = rng.normal(size=(70, 6))
    m[60:] = m[0]
    spark.createDataFrame([(i, i % 3, [float(x) for x in v]) for i, v in enumerate(m)], "vec_id long, label long, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    sim = np.round(u @ u.T, 12)
    groups = {(0, *range(60, 70))}
    for i in range(70):
        g = sorted(int(j) for j in np.argsort(-sim[i], kind="stable")[:8] if sim[i, j] >= 0.3)
        if len(g) > 1 and all(sim[a, b] >= 0.3 for a in g for b in g):
            groups.add(tuple(g))
    want = sorted((len({i % 3 for i in g}), len({i % 7 for i in g}), g[0], g[-1], len(g)) for g in groups if len({i % 3 for i in g}) > 1)
    assert sorted((r.sources, r.owners, r.first_seen, r.last_seen, r.n) for r in recurrence_clusters(spark, str(tmp_path)).collect()) == want and max(w[-1] for w in want) == 11


def test_stream_dedupe_keeps_files_of_overlapping_times(spark, tmp_path):
    import os

    import pyarrow as pa
    import pyarrow.parquet as pq

    from attesta.plans.streams import stream_dedupe

    os.makedirs(path := f"{tmp_path}/events.parquet")
    for part in range(3):
        at = [dt.datetime(2024, 1, 1) + dt.timedelta(days=5 * i + (1 - part)) for i in range(20)]
        pq.write_table(pa.table({"event_id": [100 * part + i for i in range(20)] + [7], "user_id": [1] * 20 + [1], "ts": pa.array([*at, dt.datetime(2024, 2, 6)], pa.timestamp("us"))}), f"{path}/part-{part}.parquet")
        os.utime(f"{path}/part-{part}.parquet", (1_700_000_000 + part, 1_700_000_000 + part))
    assert sorted(r.event_id for r in stream_dedupe(spark, str(tmp_path)).collect()) == [*range(20), *range(100, 120), *range(200, 220)]


def test_large_groups_are_clustered_each_for_itself(spark, monkeypatch):
    for name, n in (("RANGE_ROWS", 30), ("CELL_ROWS", 30), ("BLOCK_ROWS", 16), ("STRIP_ROWS", 9)):
        monkeypatch.setattr(vectors, name, n)
    rng = np.random.default_rng(3)
    m = rng.normal(size=(4, 6))[rng.integers(0, 4, 300)] + 0.5 * rng.normal(size=(300, 6))
    df = spark.createDataFrame([(i, i % 2, [float(x) for x in v]) for i, v in enumerate(m)], "id long, g int, v array<double>")
    got: dict = {}
    for r in vectors.complete_link(df, "g", "id", "v", 0.3).collect():
        got.setdefault((r.g, r.cluster), []).append(r.id)
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    sim, want = u @ u.T, {}
    for g in range(2):
        plain: list[list[int]] = []
        for i in range(g, 300, 2):
            home = next((c for c in plain if all(sim[i, j] >= 0.3 - 1e-12 for j in c)), None)
            plain.append([i]) if home is None else home.append(i)
        want |= {(g, n): c for n, c in enumerate(plain)}
    assert max(map(len, want.values())) > 8
    assert {k: sorted(c) for k, c in got.items()} == want


def test_few_intervals_of_a_key_meet_without_bins(spark):
    a = spark.range(2000).select((F.col("id") % 5).alias("k"), (F.col("id") * 1.5).alias("start"), (F.col("id") * 1.5 + F.col("id") % 7).alias("end"), "id")
    b = spark.range(5).select(F.col("id").alias("k"), (F.col("id") * 90.0).alias("start"), (F.col("id") * 90.0 + 400).alias("end"))
    got = ordered.overlaps(a, b, "k")
    assert "explode" not in got._jdf.queryExecution().analyzed().toString()
    want = {i for i in range(2000) if i * 1.5 < i % 5 * 90 + 400 and i % 5 * 90 < i * 1.5 + i % 7}
    assert sorted(r.id for r in got.collect()) == sorted(want)


def test_places_of_documents_carry_no_texts(spark, tmp_path, monkeypatch):
    from attesta.plans import ordered as plans

    seen = []
    monkeypatch.setattr(plans.ordered, "placed", lambda df, *a: seen.extend(df.columns) or df.withColumn("p", F.lit(1)))
    spark.createDataFrame([(1, "text", 4)], "doc_id long, text string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    plans.nulls_last_sort(spark, str(tmp_path))
    assert "text" not in seen


def test_nearest_search_by_a_reached_bound_keeps_ties():
    rng = np.random.default_rng(2)
    m = rng.normal(size=(60, 5))
    m[20:40] = m[3]
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    sim = np.round(u @ u.T, 12)
    order = [np.lexsort((np.arange(60), -sim[q]))[:4] for q in range(60)]
    reached = [sim[q, order[q][3]] if q % 2 else None for q in range(60)] + [None] * 60
    table = pa.table({"side": [0] * 60 + [1] * 60, "key": [*range(60)] * 2, "vector": [list(x) for x in m] * 2, "reached": pa.array(reached, pa.float64())})
    got = vectors._best(4)(table)
    odd = {(q, int(n)) for q in range(60) for n in order[q]}
    assert set(zip(got.column("query").to_pylist(), got.column("neighbour").to_pylist())) == odd
    # rows below the bound are not even ranked
    far = table.set_column(3, "reached", pa.array([2.0] * 120))
    assert vectors._best(4)(far).num_rows == 0
