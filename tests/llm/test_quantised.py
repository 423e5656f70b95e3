"""Search by additive quantisation against brute force."""

import functools
import operator

import duckdb
import numpy as np
import pytest

from attesta.llm import quantised

SCHEMA = "vec_id long, embedding array<float>, code string, side int"


def plain(rows, every, k):
    """(query_id, rank, vec_id, score) of all pairs, products added in order."""
    best = {}
    for i, x in rows:
        if i is None or x is None or any(c is None or not np.isfinite(c) for c in x) or not any(x):
            continue
        x = tuple(float(np.float32(c)) for c in x)
        best[i] = min(best.get(i, x), x)
    out = []
    for q, x in best.items():
        if q % every == 0:
            score = lambda y: functools.reduce(operator.add, (a * b for a, b in zip(x, y)))
            found = sorted(((-score(y), i) for i, y in best.items() if i != q))[:k]
            out += [(q, n, i, -s) for n, (s, i) in enumerate(found, 1)]
    return sorted(out)


def some(seed, n, d=8, centres=6):
    """Clusters, copies of one vector, a zero vector, nulls and non-finite components."""
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(centres, d))
    rows = [(int(i), (middle[i % centres] + 0.2 * rng.normal(size=d)).tolist()) for i in range(n)]
    rows += [(n + i, middle[0].tolist()) for i in range(n // 3)]
    odd = [None, [0.0] * d, [float("nan")] * d, [float("inf")] + [1.0] * (d - 1), [None] + [1.0] * (d - 1)]
    rows += [(10_000 + 10 * i, x) for i, x in enumerate(odd)] + [(None, [1.0] * d), (-20, [1.0] * d), (-20, [1.0] * d), (40, [9.0] * d), rows[3]]
    return rows


def small(monkeypatch):
    for name, value in (("BOOKS", 3), ("WORDS", 8), ("SAMPLE", 200), ("ROWS", 90), ("QUERIES", 15), ("STRIP", 4), ("ENCODED", 32), ("PAIRS", 100), ("FIRST", 6)):
        monkeypatch.setattr(quantised, name, value)


@pytest.mark.parametrize("margin", [None, quantised.MARGIN])
def test_search_over_blocks(spark, monkeypatch, margin):
    small(monkeypatch)
    rows = some(1, 400)
    df = spark.createDataFrame([(*r, "x", 5) for r in rows], SCHEMA).repartition(3)
    got = sorted(map(tuple, quantised.search(df, 10, 5, margin).collect()))
    want = plain(rows, 10, 5)
    if margin is None:
        assert got == want
    else:
        hits = {r[::2] for r in got} & {r[::2] for r in want}
        assert len(got) == len(want) and len(hits) >= 0.95 * len(want)


def test_recall_on_vectors_without_clusters(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(6000, 32)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = quantised.search(df, 100, 20).collect()
    found = {}
    for r in got:
        found.setdefault(r.query_id, set()).add(r.vec_id)
    hit = 0
    for q in range(0, 6000, 100):
        s = x.astype(np.float64) @ x[q].astype(np.float64)
        s[q] = -np.inf
        hit += len(found[q] & set(np.argsort(-s)[:20].tolist()))
    assert len(got) == 60 * 20 and hit >= 0.98 * len(got)


def test_codes_come_near(spark):
    rng = np.random.default_rng(2)
    rows = rng.normal(size=(1500, 12))
    books = quantised.fitted(rows)
    code = quantised.encoded(rows, books)
    rest = rows - sum(books[b][code[:, b]] for b in range(len(books)))
    assert (rest**2).sum() < 0.05 * (rows**2).sum()


def test_few_rows_and_empty_tables(spark):
    kind = "vec_id long, embedding array<double>"
    assert quantised.search(spark.createDataFrame([], kind), 20, 20).count() == 0
    assert quantised.search(spark.createDataFrame([(0, [0.0, 0.0]), (20, None)], kind), 20, 20).count() == 0
    assert quantised.search(spark.createDataFrame([(20, [1.0, 2.0])], kind), 20, 20).count() == 0
    rows = [(0, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, [-1.0, 0.5]), (4, [1.0, 2.0, 3.0])]
    got = sorted(map(tuple, quantised.search(spark.createDataFrame(rows, kind), 20, 20).collect()))
    assert got == [(0, 1, 1, 5.0), (0, 2, 2, 5.0), (0, 3, 3, 0.0)]


def test_sql_agrees(spark, sf):
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{sf}/embeddings.parquet'")
    rel = con.sql(quantised.OP12_SQL)
    got = quantised.op12_additive_quantisation(spark, sf)
    assert rel.columns == got.columns and sorted(rel.fetchall()) == sorted(map(tuple, got.collect()))
