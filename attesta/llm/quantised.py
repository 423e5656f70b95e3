"""Nearest vectors by additive quantisation.

A vector is written as a sum of one full-length word from each of BOOKS codebooks.  Codebooks are fitted
by means of residuals on a bounded sample and then all at once by least squares; every vector is
encoded by a beam search over sums of words and keeps its code and the norm of what the code
leaves out.  A search adds up table entries: a query's inner products with all words, looked up by code.  The error of that score
is the query's product with the residual, about |q| r / sqrt(d) in size, so all rows whose score plus
MARGIN such errors reaches the k-th best exact score of their block are scored exactly again.  With
``margin=None`` the bound is |q| r, which nothing exceeds, and the result is that of brute force.

Queries meet all rows in blocks, two bounded blocks a task.  Vectors that are null, zero or hold null or non-finite
components take no part, nor do rows without vec_id; of vectors of several lengths the most frequent length counts (the smaller
one on a tie), and of several rows of one vec_id the smallest vector.  Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import work

#: Codebooks, their words, beams of an encoding, rows that the codebooks are fitted on (about) and rounds of means.
BOOKS, WORDS, BEAMS, SAMPLE, ROUNDS = 16, 256, 4, 8192, 5
#: Rows and queries of a task, queries of a strip, rows encoded at a time, exactly scored pairs at a time.
ROWS, QUERIES, STRIP, ENCODED, PAIRS = 16_384, 4096, 128, 1024, 1 << 17
#: Errors of a score that are allowed for, and rows of a block that are scored exactly to begin with.
MARGIN, FIRST = 4.0, 64


def usable(embeddings: DataFrame) -> DataFrame:
    """(vec_id, embedding) of the rows that take part, once a vec_id."""
    ok = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    rows = embeddings.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(ok).select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    lengths = rows.groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    rows = rows.where(F.size("embedding") == (lengths.d if lengths else 0))
    return rows.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Rows of equal length as a matrix of doubles."""
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.float64).reshape(len(column), -1)


def means(rows: np.ndarray, words: int, rng) -> np.ndarray:
    """``words`` centres of the rows (repeated ones where rows are few)."""
    centres = rows[rng.choice(len(rows), words, replace=len(rows) < words)].copy()
    for _ in range(ROUNDS):
        near = np.argmin((centres**2).sum(1) - 2 * rows @ centres.T, axis=1)
        n = np.bincount(near, minlength=words)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, rows)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


def fitted(rows: np.ndarray) -> np.ndarray:
    """Codebooks (BOOKS, WORDS, d): centres of residuals, then least squares over the sample's codes."""
    rng, left, books = np.random.default_rng(0), rows.astype(np.float32), []
    for _ in range(BOOKS):
        books.append(means(left, WORDS, rng))
        left = left - books[-1][np.argmin((books[-1] ** 2).sum(1) - 2 * left @ books[-1].T, axis=1)]
    books = np.stack(books)
    at = encoded(rows, books) + WORDS * np.arange(BOOKS)
    size = BOOKS * WORDS
    together = np.bincount((at[:, :, None] * size + at[:, None, :]).ravel(), minlength=size * size).reshape(size, size).astype(np.float32)
    sums = np.zeros((size, rows.shape[1]), np.float32)
    for b in range(BOOKS):
        np.add.at(sums, at[:, b], rows.astype(np.float32))
    # words that few rows use stay near where they were
    together[np.diag_indices(size)] += 1
    return np.linalg.solve(together, sums + books.reshape(size, -1)).reshape(books.shape).astype(np.float32)


def encoded(rows: np.ndarray, books: np.ndarray) -> np.ndarray:
    """Codes (n, BOOKS) by a beam search: after each book the BEAMS sums nearest to the row go on."""
    out = np.empty((len(rows), len(books)), np.int64)
    for lo in range(0, len(rows), ENCODED):
        x = rows[lo : lo + ENCODED].astype(np.float32)
        n = len(x)
        left, codes, far = x[:, None, :], np.zeros((n, 1, 0), np.int64), (x**2).sum(1)[:, None]
        for words in books:
            cost = far[:, :, None] + ((words**2).sum(1) - 2 * left @ words.T)
            beams = min(BEAMS, cost.shape[1] * len(words))
            flat = cost.reshape(n, -1)
            best = np.argpartition(flat, beams - 1, axis=1)[:, :beams]
            far = np.take_along_axis(flat, best, 1)
            beam, word = best // len(words), best % len(words)
            left = np.take_along_axis(left, beam[:, :, None], 1) - words[word]
            codes = np.concatenate([np.take_along_axis(codes, beam[:, :, None], 1), word[:, :, None]], axis=2)
        out[lo : lo + n] = codes[np.arange(n), far.argmin(1)]
    return out


def codebooks(vectors: DataFrame, n: int) -> np.ndarray:
    """Fitted in one task on about SAMPLE rows, those of the smallest hashes."""

    def run(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("vec_id").to_numpy())
        return pa.table({"books": pa.array([fitted(matrix(table.column("embedding"))[order]).tobytes()], pa.binary())})

    draw = F.pmod(F.xxhash64("vec_id", F.lit(5)), F.lit(1 << 40)) < int((1 << 40) * min(1.0, SAMPLE / max(n, 1)))
    got = vectors.where(draw).withColumn("all", F.lit(0)).groupBy("all").applyInArrow(run, "books binary").first()
    return np.frombuffer(bytes(got.books), np.float32).reshape(BOOKS, WORDS, -1)


def index(vectors: DataFrame, books: np.ndarray) -> DataFrame:
    """(vec_id, embedding, code, rest): every row with its code and its residual's norm."""

    def run(batches):
        for batch in batches:
            if not len(batch):
                continue
            x = matrix(pa.chunked_array([batch.column("embedding")]))
            code = encoded(x, books)
            rest = np.linalg.norm(x - sum(books[b][code[:, b]] for b in range(BOOKS)).astype(np.float64), axis=1)
            code = pa.array([c.tobytes() for c in code.astype(np.uint8)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("embedding"), code, pa.array(rest, pa.float64())], names=["vec_id", "embedding", "code", "rest"])

    kind = dict(vectors.dtypes)["embedding"]
    return vectors.mapInArrow(work.tidy(run), f"vec_id long, embedding {kind}, code binary, rest double")


def products(x: np.ndarray, i: np.ndarray, q: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Inner products of pairs of rows of x and q, given by columns, added in order: equal vectors have equal scores."""
    out = np.zeros(len(i))
    for lo in range(0, len(i), PAIRS):
        a, b, some = i[lo : lo + PAIRS], j[lo : lo + PAIRS], out[lo : lo + PAIRS]
        for c, d in zip(x, q):
            some += c[a] * d[b]
    return out


def strip(lookup: np.ndarray, codes: np.ndarray, room: np.ndarray, own: np.ndarray, exact, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, score) of the k best rows, and of all that tie with the k-th, of each query of a strip.

    ``room`` is by how much a row's score may be too low, ``own`` marks pairs that are left out,
    ``exact`` gives scores of pairs.
    """
    n_q, n = own.shape
    score = np.take(lookup[0], codes[0], axis=1)
    for b in range(1, len(codes)):
        score += np.take(lookup[b], codes[b], axis=1)
    score += room
    score[own] = -np.inf
    first = min(max(FIRST, k), n)
    row = np.argpartition(score, n - first, axis=1)[:, n - first :]
    col = np.repeat(np.arange(n_q), first)
    got = exact(row.ravel(), col).reshape(n_q, first)
    got[own[col, row.ravel()].reshape(n_q, first)] = -np.inf
    least = np.partition(got, first - k, axis=1)[:, first - k] if first >= k else np.full(n_q, -np.inf)
    query, row = np.nonzero((score >= (least - 1e-9 * np.abs(np.where(np.isfinite(least), least, 0)))[:, None]) & ~own)
    got = exact(row, query)
    order = np.lexsort((row, -got, query))
    query, row, got = query[order], row[order], got[order]
    start = np.searchsorted(query, np.arange(n_q + 1))
    last = got[np.minimum(start[:-1] + k, np.maximum(start[1:], 1)) - 1] if len(got) else np.zeros(n_q)
    kept = got >= last[query]
    return query[kept], row[kept], got[kept]


def searcher(books: np.ndarray, k: int, margin: float | None):
    """Function of one block of queries (side 0) and one of rows (side 1): (query_id, vec_id, score)."""

    def run(table: pa.Table) -> pa.Table:
        side, ids = table.column("side").to_numpy(), table.column("vec_id").to_numpy()
        order = np.lexsort((ids, side))
        table, side, ids = table.take(pa.array(order)), side[order], ids[order]
        cut = int(np.searchsorted(side, 1))
        parts = [pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})]
        if 0 < cut < len(side):
            both = matrix(table.column("embedding"))
            x = np.ascontiguousarray(both[cut:].T)
            codes = np.ascontiguousarray(np.frombuffer(b"".join(table.column("code")[cut:].to_pylist()), np.uint8).reshape(-1, len(books)).T).astype(np.intp)
            rest = table.column("rest")[cut:].to_numpy()
            for lo in range(0, cut, STRIP):
                q = both[lo : min(lo + STRIP, cut)]
                lookup = [(q @ w.T).astype(np.float32) for w in books]
                reach = np.linalg.norm(q, axis=1)[:, None] * rest[None, :]
                # what sums of single precision may lose is allowed for too
                room = (reach if margin is None else margin / np.sqrt(len(x)) * reach) + 1e-5 * np.abs(lookup).max((0, 2))[:, None] * len(books)
                columns = np.ascontiguousarray(q.T)
                query, row, got = strip(lookup, codes, room.astype(np.float32), ids[lo : lo + len(q), None] == ids[None, cut:], lambda i, j: products(x, i, columns, j), k)
                # rows are in order of their ids, so ties are cut to the k smallest
                nth = np.arange(len(query)) - np.searchsorted(query, query)
                top = nth < k
                parts.append(pa.table({"query_id": ids[lo : lo + len(q)][query[top]], "vec_id": ids[cut:][row[top]], "score": got[top]}))
        return pa.concat_tables(parts)

    return run


def nearest(rows: DataFrame, queries: DataFrame, books: np.ndarray, n: int, n_queries: int, k: int, margin: float | None = MARGIN) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k nearest rows of an ``index`` to each query, itself not counted."""
    blocks, strips = max(1, -(-n // ROWS)), max(1, -(-n_queries // QUERIES))
    block = F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")
    part = F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(strips)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    names = ["vec_id", "embedding", "code", "rest"]
    left = queries.select(part.alias("part"), every(blocks).alias("block"), F.lit(0).alias("side"), *names)
    right = rows.select(every(strips).alias("part"), block.alias("block"), F.lit(1).alias("side"), *names)
    found = left.union(right).groupBy("part", "block").applyInArrow(searcher(books, k, margin), "query_id long, vec_id long, score double")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def search(embeddings: DataFrame, every: int, k: int, margin: float | None = MARGIN) -> DataFrame:
    """The k nearest of each row whose vec_id is divisible by ``every`` among all others."""
    vectors = work.cut(usable(embeddings), "vectors")
    n = vectors.count()
    if not n:
        return embeddings.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    books = codebooks(vectors, n)
    rows = work.cut(index(vectors, books), "codes")
    queries = rows.where(F.col("vec_id") % every == 0)
    return nearest(rows, queries, books, n, queries.count(), k, margin)


def op12_additive_quantisation(spark, sf_dir: str) -> DataFrame:
    """The 20 nearest of every 20th vector of ``embeddings``, by inner product."""
    with work.scope() as made:
        out = work.cut(search(work.table(spark, sf_dir, "embeddings"), 20, 20), "nearest")
        made.remove(out)
    return out


#: Brute force.  MARGIN lets four times the usual error pass, so nothing is expected to be missed on small tables.
OP12_SQL = """
with v as (select vec_id, embedding::double[] as x from embeddings where vec_id is not null and len(embedding) > 0 and len(list_filter(embedding, lambda c: c is null or not isfinite(c))) = 0 and len(list_filter(embedding, lambda c: c <> 0)) > 0),
s as (select a.vec_id as query_id, b.vec_id, list_reduce(list_transform(generate_series(1, len(a.x)), lambda i: a.x[i] * b.x[i]), lambda p, q: p + q) as score from v a join v b on a.vec_id % 20 = 0 and a.vec_id <> b.vec_id)
select query_id, rank, vec_id, score from (select *, (row_number() over (partition by query_id order by score desc, vec_id))::int as rank from s) where rank <= 20
"""
