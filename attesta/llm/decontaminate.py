"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman.

Words are the runs of letters, digits and marks of any script, in lower case.
Seeds are the rare ones of the distinct 4-word windows of the items (all words,
for shorter items): those of at most ``MOST_ITEMS`` items, and of each item the
``RAREST`` that fewest items have, whatever their number.  So a phrase that all items of
a benchmark share nominates no pairs, and an item of such phrases alone is
found by them.  How frequent a window is in the documents plays no part: what
is found in a document does not depend on other documents.  One scan of the documents tests every window against a bit map of the
seeds, sized by their number, and writes the stretches of words around the
hits.  A join with the seeds makes (passage, item) candidates.  A candidate whose words, counted with repetitions, have too
few in common with the item for the least score is out before alignment, which
loses nothing, as a score is at most twice the matched words.  Each other
candidate is aligned with the item by Smith-Waterman over words (match 2,
mismatch -1, gap -1).  An item counts as contained if the
alignment reaches ``MIN_SCORE`` of the item's full score and matches at least
``MIN_WORDS`` words, or the whole item if that is shorter.

Null and empty texts, items without words, and null ids of items match nothing.
``matched_words`` is what a score needs at least, half of it.  An item longer
than a document is compared as it is.  Repeated rows give one result.
``contained`` leaves rows without a doc_id out, ``without_leaks`` judges them.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import kernel, work

GRAM = 4
#: Bits of the seed map for each seed, and the most and least there are of them.
BITS_PER_SEED, MIN_BITS, MAX_BITS = 16, 1 << 20, 1 << 28
#: Items that a rare seed is in at most, and seeds of an item that are used however many items they are in.
MOST_ITEMS, RAREST = 32, 8
MIN_SCORE = 0.5
MIN_WORDS = 4
#: Words around a hit, as a multiple of the longest item.
AROUND = 1.5
ALIGN_CELLS = 4_000_000


def _code_points() -> tuple[np.ndarray, np.ndarray]:
    """(lower case, whether it belongs to words) of every code point of the BMP.

    Letters, digits and marks do.  Lower case is a code point that UTF-8 writes
    in as many bytes, else the code point itself.
    """
    width = lambda c: 1 if c < 0x80 else 2 if c < 0x800 else 3
    low, word = np.arange(1 << 16, dtype=np.uint32), np.zeros(1 << 16, bool)
    for c in (c for c in range(1 << 16) if not 0xD800 <= c < 0xE000):
        small = chr(c).lower()
        if len(small) == 1 and width(ord(small)) == width(c):
            low[c] = ord(small)
        word[c] = unicodedata.category(chr(c))[0] in "LNM"
    return low, word


def _folded(buf: np.ndarray) -> np.ndarray:
    """Lower-cased bytes of valid UTF-8, with a blank for every byte outside words.

    Code points past the BMP count as letters.
    """
    lower, word = kernel.cached("code points", _code_points)
    out = np.where(word[buf] & (buf < 128), kernel.LOWER[buf], np.uint8(32))
    out = np.where(buf < 128, out, buf)
    at = np.flatnonzero((buf >= 0xC2) & (buf < 0xE0))
    if len(at):
        c = (buf[at].astype(np.uint32) & 31) << 6 | buf[at + 1] & 63
        own, c = word[c], lower[c]
        out[at], out[at + 1] = np.where(own, 0xC0 | c >> 6, 32), np.where(own, 0x80 | c & 63, 32)
    at = np.flatnonzero((buf >= 0xE0) & (buf < 0xF0))
    if len(at):
        c = (buf[at].astype(np.uint32) & 15) << 12 | (buf[at + 1].astype(np.uint32) & 63) << 6 | buf[at + 2] & 63
        own, c = word[c], lower[c]
        for j, value in enumerate((0xE0 | c >> 12, 0x80 | c >> 6 & 63, 0x80 | c & 63)):
            out[at + j] = np.where(own, value, 32)
    return out


def _words(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of every word: runs of letters, digits and marks."""
    low = _folded(buf)
    start, end, row = kernel.words(low, offs)
    return kernel.span_hash(low, start, end), row


def _grams(h: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first word) of windows; a row of fewer words is one window."""
    got, at = kernel.windows(h, row, GRAM)
    counts = np.bincount(row, minlength=rows) if len(row) else np.zeros(rows, np.int64)
    lead = np.cumsum(counts) - counts
    few = np.flatnonzero((counts > 0) & (counts < GRAM))
    if len(few):
        total = np.zeros(len(few), np.uint64)
        for j in range(GRAM - 1):
            live = counts[few] > j
            total[live] += h[lead[few][live] + j] * np.uint64(kernel._ORDER[j])
        got, at = np.concatenate((got, kernel.mix(total + counts[few].astype(np.uint64)))), np.concatenate((at, lead[few]))
    return got, at


def _item_rows(batches):
    for batch in batches:
        buf, offs = kernel.column_bytes(batch.column("text"))
        h, row = _words(buf, offs)
        n = len(offs) - 1
        gram, at = _grams(h, row, n)
        ends = np.cumsum(np.bincount(row, minlength=n))
        sizes = np.bincount(row, minlength=n)
        grams = [np.unique(gram[row[at] == i]).view(np.int64).tolist() for i in range(n)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("item_id"), pa.array(sizes, pa.int64()), pa.array([h[e - k : e].tobytes() for e, k in zip(ends, sizes)], pa.binary()), pa.array(grams, pa.list_(pa.int64()))],
            ["item_id", "size", "words", "grams"],
        )


def bits_for(seeds: int) -> int:
    """A power of two; past 16 million seeds the map gets denser, not larger."""
    return min(MAX_BITS, max(MIN_BITS, 1 << (max(1, seeds) * BITS_PER_SEED - 1).bit_length()))


def _places(h: np.ndarray, size: int) -> np.ndarray:
    """The first and the second bit number of each hash, in two rows."""
    return np.stack((h, kernel.mix(h))) & np.uint64(size - 1)


def _held(seen: np.ndarray, size: int, h: np.ndarray) -> np.ndarray:
    """Indices of the hashes the map may hold."""
    at = np.arange(len(h))
    for place in (lambda x: x, kernel.mix):
        bit = (place(h[at]) & np.uint64(size - 1)).astype(np.int64)
        at = at[seen[bit >> 3] >> (bit & 7).astype(np.uint8) & 1 == 1]
    return at


def _bitmap(size: int):
    """One row of set bit numbers for each batch of seeds."""

    def run(batches):
        for batch in batches:
            h = batch.column("gram").to_numpy().view(np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array([np.unique(_places(h, size)).astype(np.uint32).tobytes()], pa.binary())], ["bits"])

    return run


def seed_map(seeds: DataFrame, size: int) -> bytes:
    """The packed map of all seeds."""
    out = np.zeros(size >> 3, np.uint8)
    for part in seeds.select("gram").distinct().mapInArrow(work.tidy(_bitmap(size)), "bits binary").toLocalIterator():
        bit = np.frombuffer(part["bits"], np.uint32)
        np.bitwise_or.at(out, bit >> 3, np.left_shift(np.uint8(1), (bit & 7).astype(np.uint8)))
    return out.tobytes()


def _scan(bits, size: int, around: int, short: list[int]):
    """Passages (doc_id, first, words, grams) around windows the map may hold.

    Windows of fewer than GRAM words only arise from texts that short, so short
    items are found in longer texts by windows of their own lengths.
    """
    windows = sorted({GRAM, *short})

    def run(batches):
        seen = np.frombuffer(bits.value, np.uint8)
        for batch in batches:
            buf, offs = kernel.column_bytes(batch.column("text"))
            ids = batch.column("doc_id")
            for a, b in kernel.slices(offs):
                h, row = _words(buf[offs[a] : offs[b]], offs[a : b + 1] - offs[a])
                hit_h, hit_at = [], []
                for n in windows:
                    got, at = kernel.windows(h, row, GRAM) if n == GRAM else _short(h, row, n)
                    ok = _held(seen, size, got)
                    hit_h.append(got[ok])
                    hit_at.append(at[ok])
                hit_h, hit_at = np.concatenate(hit_h), np.concatenate(hit_at)
                if not len(hit_at):
                    continue
                order = np.argsort(hit_at, kind="stable")
                hit_h, hit_at = hit_h[order], hit_at[order]
                counts = np.bincount(row, minlength=b - a)
                ends = np.cumsum(counts)
                hrow = row[hit_at]
                lo = np.maximum(hit_at - around, (ends - counts)[hrow])
                hi = np.minimum(hit_at + around + GRAM, ends[hrow])
                fresh = np.ones(len(lo), bool)
                fresh[1:] = (lo[1:] > np.maximum.accumulate(hi)[:-1]) | (hrow[1:] != hrow[:-1])
                first = np.flatnonzero(fresh)
                last = np.append(first[1:], len(lo))
                docs, at0, parts, grams = [], [], [], []
                for x, y in zip(first, last):
                    docs.append(int(hrow[x]))
                    p, q = int(lo[x]), int(hi[y - 1])
                    at0.append(p - int((ends - counts)[hrow[x]]))
                    parts.append(h[p:q].tobytes())
                    grams.append(np.unique(hit_h[x:y]).view(np.int64).tolist())
                yield pa.RecordBatch.from_arrays([ids.take(pa.array([a + d for d in docs])), pa.array(at0, pa.int64()), pa.array(parts, pa.binary()), pa.array(grams, pa.list_(pa.int64()))], ["doc_id", "first", "words", "grams"])

    return run


def _short(h: np.ndarray, row: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    total = np.zeros(n, np.uint64)
    for j in range(size):
        total += h[j : j + n] * np.uint64(kernel._ORDER[j])
    at = np.flatnonzero(row[:n] == row[size - 1 :])
    return kernel.mix(total[at] + np.uint64(size)), at


def smith_waterman(items: list[np.ndarray], passages: list[np.ndarray]) -> list[tuple[int, int, int]]:
    """(score, matched words, end word in the passage) of each pair.

    All pairs of the call go through the rows together; gaps along a row are
    resolved by a running maximum.  ``matched`` is the number of equal words a
    score needs at least: (score + 1) // 2.
    """
    if not items:
        return []
    n, m = max(map(len, items)), max(map(len, passages))
    x, y = np.zeros((len(items), n), np.uint64), np.zeros((len(items), m), np.uint64)
    for k, (i, p) in enumerate(zip(items, passages)):
        x[k, : len(i)], y[k, : len(p)] = i, p
    lens = np.array([len(i) for i in items])
    ylens = np.array([len(p) for p in passages])
    inside = np.arange(m)[None, :] < ylens[:, None]
    slope = np.arange(m, dtype=np.int32)[None, :]
    before = np.zeros((len(items), m + 1), np.int32)
    best, end = np.zeros(len(items), np.int32), np.zeros(len(items), np.int64)
    for r in range(n):
        gain = np.where((y == x[:, r : r + 1]) & inside & (lens > r)[:, None], 2, -1).astype(np.int32)
        row = np.maximum(np.maximum(before[:, :-1] + gain, before[:, 1:] - 1), 0)
        row = np.maximum.accumulate(row + slope, axis=1) - slope
        row = np.where(inside, row, 0)
        top = row.argmax(axis=1)
        value = row[np.arange(len(items)), top]
        better = (value > best) & (lens > r)
        best, end = np.where(better, value, best), np.where(better, top, end)
        before[:, 1:] = row
    return [(int(s), (int(s) + 1) // 2, int(e)) for s, e in zip(best, end)]


def _in_common(item: np.ndarray, passage: np.ndarray) -> int:
    """Words of the item that the passage has too, with repetitions."""
    words, n = np.unique(item, return_counts=True)
    there = np.sort(passage)
    return int(np.minimum(n, there.searchsorted(words, "right") - there.searchsorted(words)).sum())


def _align(batches):
    for batch in batches:
        pairs = zip(batch.column("item_words"), batch.column("words"))
        likely = [2 * _in_common(x, y) >= 2 * MIN_SCORE * len(x) for x, y in ((np.frombuffer(i.as_buffer(), np.uint64), np.frombuffer(p.as_buffer(), np.uint64)) for i, p in pairs)]
        batch = batch.filter(pa.array(likely, pa.bool_()))
        items = [np.frombuffer(w.as_buffer(), np.uint64) for w in batch.column("item_words")]
        parts = [np.frombuffer(w.as_buffer(), np.uint64) for w in batch.column("words")]
        order = sorted(range(len(items)), key=lambda k: (len(parts[k]), len(items[k])))
        got: list = [None] * len(items)
        k = 0
        while k < len(order):
            j = k + 1
            while j < len(order) and (j - k + 1) * len(parts[order[j]]) * 8 <= ALIGN_CELLS // 8:
                j += 1
            for at, res in zip(order[k:j], smith_waterman([items[i] for i in order[k:j]], [parts[i] for i in order[k:j]])):
                got[at] = res
            k = j
        score, matched, end = zip(*got) if got else ((), (), ())
        out = batch.select(["doc_id", "item_id", "size", "first"])
        for name, col in (("score", score), ("matched", matched), ("end", end)):
            out = out.append_column(name, pa.array(col, pa.int64()))
        yield out


def rare_seeds(items: DataFrame) -> DataFrame:
    """(item_id, gram) of the seeds that nominate, by the number of items that have them."""
    seeds = items.select("item_id", F.explode("grams").alias("gram")).distinct()
    n = seeds.groupBy("gram").agg(F.count("*").alias("n"))
    nth = F.row_number().over(Window.partitionBy("item_id").orderBy("n", "gram"))
    return seeds.join(n, "gram").withColumn("nth", nth).where((F.col("n") <= MOST_ITEMS) | (F.col("nth") <= RAREST)).select("item_id", "gram")


def nominated(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """(doc_id, item_id, size, first, words, item_words) of the passages and items that are aligned."""
    spark = docs.sparkSession
    items = work.cut(bench.select("item_id", "text").where("item_id is not null").mapInArrow(work.tidy(_item_rows), "item_id long, size long, words binary, grams array<long>").where("size > 0"), "items")
    facts = items.agg(F.count("*").alias("n"), F.coalesce(F.max("size"), F.lit(1)).alias("top"), F.coalesce(F.sum("size"), F.lit(0)).alias("total")).first()
    seeds = work.cut(rare_seeds(items), "seeds")
    size = bits_for(facts["total"])
    short = [r[0] for r in items.where(F.col("size") < GRAM).select("size").distinct().collect()]
    bits = spark.sparkContext.broadcast(seed_map(seeds, size))
    around = int(facts["top"] * AROUND) + GRAM
    passages = docs.select("doc_id", "text").where("doc_id is not null").mapInArrow(work.tidy(_scan(bits, size, around, short)), "doc_id long, first long, words binary, grams array<long>")
    passages = work.cut(passages, "passages")
    hits = passages.select("doc_id", "first", F.explode("grams").alias("gram"))
    near = hits.join(work.small_or_not(seeds, facts["total"], 24), "gram").select("doc_id", "first", "item_id").distinct()
    pairs = near.join(passages.select("doc_id", "first", "words"), ["doc_id", "first"]).join(
        work.small_or_not(items.select("item_id", "size", F.col("words").alias("item_words")), facts["total"], 16), "item_id"
    )
    return pairs.select("doc_id", "item_id", "size", "first", "words", "item_words")


def contained(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """(doc_id, item_id, score, matched_words, item_words, last_word) of items found."""
    got = nominated(docs, bench).mapInArrow(work.tidy(_align), "doc_id long, item_id long, size long, first long, score long, matched long, end long")
    got = got.where((F.col("score") >= 2 * MIN_SCORE * F.col("size")) & (F.col("matched") >= F.least(F.lit(MIN_WORDS), "size")))
    best = got.groupBy("doc_id", "item_id").agg(F.max(F.struct("score", (-F.col("first")).alias("back"), "size", "matched", "end")).alias("m"))
    return best.select("doc_id", "item_id", (F.col("m.score") / (2 * F.col("m.size"))).alias("score"), F.col("m.matched").alias("matched_words"), F.col("m.size").alias("item_words"), (F.col("m.end") - F.col("m.back")).alias("last_word"))


def without_leaks(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """Documents in which no item is contained, with all columns.

    Rows of one doc_id go together; a row without one is known by its text.
    """
    key = F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text"))
    gone = work.cut(contained(docs.select(key.alias("doc_id"), "text"), bench).select(F.col("doc_id").alias("_leaked")).distinct(), "leaked")
    return docs.join(work.small_or_not(gone, gone.count(), 16), key == F.col("_leaked"), "left_anti")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained(work.table(spark, sf_dir, "documents"), work.table(spark, sf_dir, "benchmark"))
