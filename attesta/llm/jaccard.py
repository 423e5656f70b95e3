"""N-gram Jaccard join by PartEnum signatures.

A document's feature set is its distinct 5-word shingles (52-bit hashes).  Sets
are put into size bands whose bounds grow by 4/3, so two sets of similarity
0.75 or more lie in one band or in neighbouring ones.  Instance i of PartEnum
serves bands i-1 and i: such sets differ in at most k = 2 r / 7 features, where
r is the largest size in band i.  The feature domain is dealt into n1 > k
partitions (first level; the second level is the single subset of size one),
and the projection of a set on a partition is a signature.  Similar sets differ
in k partitions at most, so of their non-empty signatures at least
``max(ne) - k`` agree, and by the prefix principle it is enough that each set
emits its first k + 1 signatures in one global order.  The order puts
signatures made of frequent shingles only last.  It affects cost, never the
result; the frequencies are a count-min sketch over all documents.

If both sets have k or fewer non-empty partitions the guarantee is empty; such
sets also emit single features (prefix of ``n - ceil(0.75 n) + 1``).

Signature groups are verified from their pivot (a star), links are joined into
components, and only members of one group that are still in different
components, and were not compared with the pivot, are compared as well.  No
pair is dropped, capped or sampled.  No task holds an unbounded group: an
infrequent signature has one infrequent shingle at least, which bounds its
sets; the pivots of frequent signatures come from a pre-aggregated minimum and
a join; later comparisons are dealt into blocks.

Nulls, empty texts and texts of white space only have an empty set, n = 0, no
link, and are their own component.  Equal sets are one class; repeated rows of
one doc_id stay repeated.  A null doc_id is dropped, as it cannot be a class.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernel, work

#: Bounds of the sketch's counters, and counters per document between them.
MIN_COUNTERS, MAX_COUNTERS, COUNTERS_PER_DOC = 1 << 16, 1 << 26, 128
BLOCK = 1 << 14
#: Bits of a signature that order it; equal ones are in order of partition.
RANK_BITS = 28
FLUSH_SIGNATURES = 1_000_000
SIGNATURES_PER_BUCKET = 1_000_000
BLOCK_MEMBERS = 1024


def band_bounds(largest: int) -> np.ndarray:
    """Lower bounds of the size bands, from 1 past ``largest``."""
    out = [1]
    while out[-1] <= largest * 2 + 2:
        out.append(-(-4 * out[-1] // 3))
    return np.array(out, np.int64)


def _sets(batch: pa.RecordBatch, limit: int = kernel.SLICE_BYTES):
    """Per slice: (first row, rows, row of each feature, feature, size by row)."""
    buf, offs = kernel.column_bytes(batch.column("text"))
    for a, b in kernel.slices(offs, limit):
        row, h = kernel.shingle_sets(buf[offs[a] : offs[b]], offs[a : b + 1] - offs[a])
        yield a, b, row, h, np.bincount(row, minlength=b - a)


def _class_ids(row: np.ndarray, h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """One 64-bit id per set: mixed sum of its mixed features and its size."""
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(kernel.mix(h ^ np.uint64(0xA5A5)), dtype=np.uint64)))
    ends = np.cumsum(n)
    return kernel.mix(total[ends] - total[ends - n] + n.astype(np.uint64)).view(np.int64)


def _survey(counters: int):
    """Rows (doc_id, n, cls) of documents and (block, counts) of the task's sketch."""

    def run(batches):
        counts = np.zeros(counters, np.uint8)
        for batch in batches:
            ids = batch.column("doc_id")
            for a, b, row, h, n in _sets(batch):
                cell, seen = np.unique((h % np.uint64(counters)).astype(np.int64), return_counts=True)
                counts[cell] = np.minimum(counts[cell].astype(np.int64) + seen, 255)
                nothing = pa.nulls(b - a)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(a, b - a), pa.array(n, pa.int64()), pa.array(_class_ids(row, h, n)), nothing.cast(pa.int32()), nothing.cast(pa.binary())],
                    ["doc_id", "n", "cls", "block", "counts"],
                )
        for k, part in enumerate(counts.reshape(-1, BLOCK)):
            if part.any():
                none = pa.nulls(1, pa.int64())
                yield pa.RecordBatch.from_arrays([none, none, none, pa.array([k], pa.int32()), pa.array([zlib.compress(part.tobytes(), 1)], pa.binary())], ["doc_id", "n", "cls", "block", "counts"])

    return run


def _frequent(threshold: int):
    def merge(table: pa.Table) -> pa.Table:
        total = np.zeros(BLOCK, np.int64)
        for part in table.column("counts").to_pylist():
            total += np.frombuffer(zlib.decompress(part), np.uint8)
        return pa.table({"block": table.column("block").slice(0, 1), "bits": pa.array([np.packbits(total > threshold).tobytes()], pa.binary())})

    return merge


def counters_for(n_docs: int) -> int:
    return min(MAX_COUNTERS, max(MIN_COUNTERS, 1 << (max(1, n_docs) * COUNTERS_PER_DOC - 1).bit_length()))


def survey(docs: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """(facts, sketch, counters): one pass over all texts.

    facts is (doc_id, n, cls); sketch holds each task's saturating count-min
    counters of shingles by block.
    """
    counters = counters_for(docs.count())
    both = work.cut(docs.select("doc_id", "text").mapInArrow(work.tidy(_survey(counters)), "doc_id long, n long, cls long, block int, counts binary"), "survey")
    return both.where("block is null").select("doc_id", "n", "cls"), both.where("block is not null").select("block", "counts"), counters


def frequent_bits(sketch: DataFrame, counters: int, shingles: int) -> bytes:
    """Bitmap of counters well above the mean: at most 8 MB."""
    threshold = 8 + 3 * (shingles // counters)
    rows = sketch.groupBy("block").applyInArrow(_frequent(threshold), "block int, bits binary").collect()
    bits = np.zeros((counters // BLOCK, BLOCK // 8), np.uint8)
    for r in rows:
        bits[r["block"]] = np.frombuffer(r["bits"], np.uint8)
    return bits.tobytes()


def _order(high: np.ndarray, low: np.ndarray, low_bits: int) -> np.ndarray:
    """argsort by (high, low), ties by place; one plain sort where 64 bits hold it."""
    width = max(1, (len(high) - 1).bit_length())
    if int(high.max(initial=0)).bit_length() + low_bits + width > 64:
        return np.lexsort((low, high))
    key = (high.astype(np.uint64) << np.uint64(low_bits) | low) << np.uint64(width) | np.arange(len(high), dtype=np.uint64)
    key.sort()
    return (key & np.uint64((1 << width) - 1)).astype(np.int64)


def signatures(row, h, n, rare, bounds):
    """(signature, row, frequent) of all sets of a slice, for both of their instances.

    A signature is frequent if all its shingles are: a property of the signature
    itself, so all sets that share it agree.
    """
    has = n > 0
    band = np.searchsorted(bounds, np.maximum(n, 1), "right") - 1
    out_sig, out_row, out_often = [], [], []
    for step in (0, 1):
        inst = band + step
        r = bounds[inst + 1] - 1
        k = 2 * r // 7
        n1 = np.maximum(k + 1, (r + 1) // 2)
        salt = kernel.mix(inst.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(7))
        dealt = kernel.mix(h ^ salt[row])
        part = (dealt >> np.uint64(20)) % n1[row].astype(np.uint64)
        order = _order(row, part, int(n1.max()).bit_length())
        key_s = row[order].astype(np.uint64) << np.uint64(32) | part[order]
        first = np.ones(len(key_s), bool)
        first[1:] = key_s[1:] != key_s[:-1]
        at = np.flatnonzero(first)
        if not len(at):
            continue
        total = np.add.reduceat(kernel.mix(dealt + np.uint64(0x51))[order], at)
        known = np.maximum.reduceat(rare[order], at)
        srow = row[order][at]
        sig = kernel.mix(total ^ kernel.mix(part[order][at] + salt[srow])) >> np.uint64(1)
        ranked = _order(srow, sig >> np.uint64(63 - RANK_BITS) | np.uint64(1 << RANK_BITS) * (~known).astype(np.uint64), RANK_BITS + 1)
        srow, sig, known = srow[ranked], sig[ranked], known[ranked]
        ne = np.bincount(srow, minlength=len(n))
        lead = np.cumsum(ne) - ne
        pos = np.arange(len(srow)) - lead[srow]
        keep = pos <= k[srow]
        out_sig.append(sig[keep])
        out_row.append(srow[keep])
        out_often.append(~known[keep])
        poor = has & (ne <= k)
        if poor.any():
            mine = poor[row]
            prow, ph = row[mine], h[mine]
            ranked = np.lexsort((kernel.mix(ph), ~rare[mine], prow))
            prow, ph, pknown = prow[ranked], ph[ranked], rare[mine][ranked]
            cnt = np.bincount(prow, minlength=len(n))
            pos = np.arange(len(prow)) - (np.cumsum(cnt) - cnt)[prow]
            keep = pos <= n[prow] - (3 * n[prow] + 3) // 4
            out_sig.append(kernel.mix(ph[keep] + salt[prow[keep]] + np.uint64(0xF00D)) >> np.uint64(1))
            out_row.append(prow[keep])
            out_often.append(~pknown[keep])
    if not out_sig:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, bool)
    return np.concatenate(out_sig), np.concatenate(out_row), np.concatenate(out_often)


BLOB = "bucket long, flush long, low binary, high binary, local binary"
_BLOB_NAMES = ("bucket", "flush", "low", "high", "local")


def _steps(local: np.ndarray) -> bytes:
    """Ascending numbers as differences of one byte; 255 adds and goes on."""
    gap = np.diff(local, prepend=0)
    more = gap // 255
    out = np.full(len(gap) + int(more.sum()), 255, np.uint8)
    out[np.cumsum(more + 1) - 1] = gap - 255 * more
    return out.tobytes()


def _places(steps: bytes) -> np.ndarray:
    step = np.frombuffer(steps, np.uint8)
    return np.cumsum(step, dtype=np.int64)[step != 255]


def _owner(flush: int, local: np.ndarray) -> np.ndarray:
    """64-bit ids of a flush's documents."""
    return kernel.mix(local.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(flush & (1 << 64) - 1)).view(np.int64)


def _emit(bits, largest: int, buckets: int):
    """Signature blobs of flushes: a row per bucket, 6 bytes a signature and about
    one for its document's place in the flush, and one row of the documents.

    Documents go to buckets of their own, as (class, size) by place, so what is
    shuffled does not grow with the number of buckets a document meets.  A
    flush is known by a hash of its classes in order: a task that runs again
    names it alike.
    """
    bounds = band_bounds(largest)

    def flush(sig, local, often, cls, size):
        with np.errstate(over="ignore"):
            name = int(np.bitwise_xor.reduce(kernel.mix(cls.view(np.uint64) + np.arange(len(cls), dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))).view(np.int64))
        spread = name % buckets
        bucket = ((sig >> np.uint64(31)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
        bucket[often] = buckets + spread
        order = _order(bucket, local.astype(np.uint64), max(1, len(cls).bit_length()))
        bucket, sig, local = bucket[order], sig[order], local[order]
        cuts = np.flatnonzero(np.diff(bucket)) + 1
        los, his = np.concatenate(([0], cuts)), np.concatenate((cuts, [len(bucket)]))
        rows = [(2 * buckets + spread, name, cls.tobytes(), size.astype(np.uint32).tobytes(), b"")]
        for k, (lo, hi) in enumerate(zip(los.tolist(), his.tolist()), 1):
            rows.append((int(bucket[lo]), name, sig[lo:hi].astype(np.uint32).tobytes(), (sig[lo:hi] >> np.uint64(32)).astype(np.uint16).tobytes(), _steps(local[lo:hi])))
            if k % 256 == 0 or k == len(los):
                types = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], list(_BLOB_NAMES))
                rows = []

    def run(batches):
        held, seen, count, base = [], [], 0, 0
        frequent = np.unpackbits(np.frombuffer(bits.value, np.uint8)).astype(bool)
        for batch in batches:
            for a, b, row, h, n in _sets(batch):
                rare = ~frequent[(h % np.uint64(len(frequent))).astype(np.int64)]
                cls = _class_ids(row, h, n)
                _, lead = np.unique(cls, return_index=True)
                once = np.zeros(len(n), bool)
                once[lead] = True
                once &= n > 0
                if seen:
                    once &= ~np.isin(cls, np.concatenate([c for c, _ in seen]))
                place = np.cumsum(once) - 1 + base
                mine = once[row]
                s, r, often = signatures(row[mine], h[mine], n * once, rare[mine], bounds)
                held.append((s, place[r], often))
                seen.append((cls[once], n[once]))
                count, base = count + len(s), base + int(once.sum())
                if count >= FLUSH_SIGNATURES:
                    yield from flush(*(np.concatenate(x) for x in (*zip(*held), *zip(*seen))))
                    held, seen, count, base = [], [], 0, 0
        if count:
            yield from flush(*(np.concatenate(x) for x in (*zip(*held), *zip(*seen))))

    return run


EDGE, MEMBER, OWNER = 0, 1, 2
STARS = "kind int, sig long, a long, b long, n long"


def _stars(buckets: int):
    """Distinct star edges (a, b) of a bucket's owners: each group of one signature
    around its pivot, the smallest owner.

    Buckets past the last hold frequent signatures of some flushes, whose
    members (sig, b) are passed on as they are, or owners (b, class a, size).
    """

    def rows(kind: int, **columns) -> pa.Table:
        n = len(next(iter(columns.values())))
        none = pa.nulls(n, pa.int64())
        return pa.table({"kind": pa.array(np.full(n, kind, np.int32)), **{c: columns.get(c, none) for c in ("sig", "a", "b", "n")}})

    def run(table: pa.Table) -> pa.Table:
        flushes, lows, highs, locals_ = (table.column(c).to_pylist() for c in _BLOB_NAMES[1:])
        bucket = table.column("bucket")[0].as_py()
        if bucket >= 2 * buckets:
            cls = np.concatenate([np.frombuffer(x, np.int64) for x in lows])
            size = np.concatenate([np.frombuffer(x, np.uint32) for x in highs]).astype(np.int64)
            own = np.concatenate([_owner(f, np.arange(len(x) // 8)) for f, x in zip(flushes, lows)])
            return rows(OWNER, a=cls, b=own, n=size)
        sig = np.concatenate([np.frombuffer(high, np.uint16).astype(np.uint64) << np.uint64(32) | np.frombuffer(low, np.uint32) for low, high in zip(lows, highs)])
        own = np.concatenate([_owner(f, _places(x)) for f, x in zip(flushes, locals_)])
        if bucket >= buckets:
            return rows(MEMBER, sig=sig.view(np.int64), b=own)
        order = _order(sig >> np.uint64(8), sig & np.uint64(255), 8)
        sig = sig[order]
        again = np.zeros(len(sig), bool)
        again[1:] = sig[1:] == sig[:-1]
        again[:-1] |= again[1:]
        order, sig = order[again], sig[again]
        own = own[order]
        order = np.lexsort((own, sig))
        sig, own = sig[order], own[order]
        lead = np.ones(len(sig), bool)
        lead[1:] = sig[1:] != sig[:-1]
        start = np.flatnonzero(lead)
        pivot = np.repeat(start, np.diff(np.concatenate((start, [len(sig)]))))
        rest = own != own[pivot]
        found = pa.table({"a": own[pivot][rest], "b": own[rest]}).group_by(["a", "b"]).aggregate([])
        work.trim()
        return rows(EDGE, a=found.column("a"), b=found.column("b"))

    return run


def _cells(h: np.ndarray, n: int) -> bytes:
    """Counts of a set's features in about n cells, a power of two."""
    m = 1 << max(0, int(n).bit_length() - 1)
    return np.minimum(np.bincount((h & np.uint64(m - 1)).astype(np.int64), minlength=m), 255).astype(np.uint8).tobytes()


def _far(x: bytes, y: bytes) -> int:
    """L1 distance of two cell counts: never more than the sets' difference."""
    x, y = np.frombuffer(x, np.uint8).astype(np.int64), np.frombuffer(y, np.uint8).astype(np.int64)
    while len(x) > len(y):
        x = x[: len(x) // 2] + x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] + y[len(y) // 2 :]
    return int(np.abs(x - y).sum())


def _with_id(pack):
    """(doc_id, cls, data) of each text, with what a comparison needs as data."""

    def run(batches):
        for batch in batches:
            for a, b, row, h, n in _sets(batch):
                ends = np.cumsum(n)
                data = pa.array([pack(h[e - k : e], k) for e, k in zip(ends, n)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array(_class_ids(row, h, n)), data], ["doc_id", "cls", "data"])

    return run


def _features(h: np.ndarray, n: int) -> bytes:
    """The sorted features in 7 bytes each."""
    return h.astype(np.uint32).tobytes() + (h >> np.uint64(32)).astype(np.uint32).view(np.uint8).reshape(-1, 4)[:, :3].tobytes()


def _unpack(data: bytes) -> np.ndarray:
    n = len(data) // 7
    high = np.frombuffer(data, np.uint8, offset=4 * n).reshape(-1, 3).astype(np.uint64)
    return np.frombuffer(data, np.uint32, n).astype(np.uint64) | (high[:, 0] | high[:, 1] << np.uint64(8) | high[:, 2] << np.uint64(16)) << np.uint64(32)


def _near(x: bytes, y: bytes, s: int, t: int) -> bool:
    return 7 * _far(x, y) <= s + t


def _linked(x: bytes, y: bytes, s: int, t: int) -> bool:
    both = len(np.intersect1d(_unpack(x), _unpack(y), assume_unique=True))
    return 100 * both >= 75 * (s + t - both)


def _where(test):
    def run(batches):
        for batch in batches:
            ok = [test(*x) for x in zip(*(batch.column(c).to_pylist() for c in ("xa", "xb", "na", "nb")))]
            yield batch.select(["a", "b", "na", "nb"]).filter(pa.array(ok, pa.bool_()))

    return run


def _compare(pairs: DataFrame, data: DataFrame, test, name: str) -> DataFrame:
    """Pairs (a, b, na, nb) that pass ``test`` on the data of both."""
    rows = (
        pairs.join(data.select(F.col("cls").alias("a"), F.col("data").alias("xa")), "a")
        .join(data.select(F.col("cls").alias("b"), F.col("data").alias("xb")), "b")
        .select("a", "b", "na", "nb", "xa", "xb")
    )
    return work.cut(rows.mapInArrow(work.tidy(_where(test)), "a long, b long, na long, nb long"), name)


def _data(docs: DataFrame, facts: DataFrame, pairs: DataFrame, pack) -> DataFrame:
    """(cls, data) of the classes in pairs, from one document of each.

    A blocked Bloom filter of the owners thins the scan ahead of the join.
    """
    from .urls import bloom_blocks, bloom_probe

    wanted = pairs.select(F.col("a").alias("cls")).union(pairs.select("b")).distinct()
    owners = work.cut(facts.groupBy("cls").agg(F.min("doc_id").alias("doc_id")).join(wanted, "cls", "left_semi").select("doc_id"), "owners")
    count = owners.count()
    blocks = bloom_blocks(owners.select(F.xxhash64("doc_id").alias("h")), count)
    thin = bloom_probe(docs.select("doc_id", "text").withColumn("h", F.xxhash64("doc_id")), blocks, count).select("doc_id", "text")
    sets = thin.mapInArrow(work.tidy(_with_id(pack)), "doc_id long, cls long, data binary")
    return work.cut(sets.join(owners, "doc_id", "left_semi").groupBy("cls", "doc_id").agg(F.first("data").alias("data")).select("cls", "data"), "sets")


def _named(edges: DataFrame, owners: DataFrame) -> DataFrame:
    """Distinct edges (a, b, na, nb) of classes from edges of owners.

    An owner without its row would be a lost link, so it is an error: it means
    that a repeated task read its rows in another order.
    """
    of = lambda side: owners.select(F.col("b").alias(side), F.col("a").alias(f"c{side}"), F.col("n").alias(f"n{side}"))
    rows = edges.join(of("b"), "b", "left").join(of("a"), "a", "left")
    lost = F.raise_error(F.lit("signatures of a document that no task named"))
    known = lambda c: F.coalesce(F.col(c), lost.cast("long")).alias(c)
    rows = rows.select(known("ca"), known("cb"), "na", "nb").where("ca <> cb")
    return rows.select(F.col("ca").alias("a"), F.col("cb").alias("b"), "na", "nb").distinct()


def links(docs: DataFrame, facts: DataFrame, sketch: DataFrame, counters: int) -> DataFrame:
    """Verified links (a, b) between classes that span every component."""
    spark = docs.sparkSession
    total = facts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.max("n"), F.lit(0)).alias("top")).first()
    bits = spark.sparkContext.broadcast(frequent_bits(sketch, counters, total["n"]))
    buckets = max(24, -(-total["n"] // SIGNATURES_PER_BUCKET))
    raw = work.cut(
        docs.select("text")
        .mapInArrow(work.tidy(_emit(bits, total["top"], buckets)), BLOB)
        .groupBy("bucket")
        .applyInArrow(_stars(buckets), STARS),
        "members",
    )
    work.release(spark)
    often = raw.where(f"kind = {MEMBER}").select("sig", "b")
    pivots = work.cut(often.groupBy("sig").agg(F.min("b").alias("a"), F.count("*").alias("k")).where("k > 1").select("sig", "a"), "pivots")
    often = often.join(work.small_or_not(pivots, pivots.count(), 40), "sig").where("a <> b").select("a", "b")
    stars = work.cut(_named(raw.where(f"kind = {EDGE}").select("a", "b").union(often).distinct(), raw.where(f"kind = {OWNER}")), "stars")
    work.drop(raw, pivots)
    pairs = stars.where("3 * greatest(na, nb) <= 4 * least(na, nb)")
    ordered = lambda x, y: F.when(F.col("a") < F.col("b"), F.col(x)).otherwise(F.col(y))
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), ordered("na", "nb").alias("na"), ordered("nb", "na").alias("nb")).distinct()
    cells = _data(docs, facts, stars, _cells)
    near = _compare(pairs, cells, _near, "near")
    sets = _data(docs, facts, near, _features)
    found = _compare(near, sets, _linked, "linked").select("a", "b")
    more = _unsettled(stars, found, cells)
    work.drop(stars, cells, sets)
    if not more.isEmpty():
        sets = _data(docs, facts, more, _features)
        found = work.cut(found.union(_compare(more, sets, _linked, "linked").select("a", "b")), "found")
        work.drop(sets)
    return found


def _fold(rows: list[bytes], m: int) -> np.ndarray:
    """Cell counts of several sets, each folded to m cells."""
    out = np.zeros((len(rows), m), np.int16)
    for k, x in enumerate(rows):
        out[k] = np.frombuffer(x, np.uint8).reshape(-1, m).sum(0)
    return out


def _across(table: pa.Table) -> pa.Table:
    """Near pairs between a block of unsettled members (side 0) and a block of all
    members (side 1) of one pivot, in different components.

    A pair is reported by the smallest pivot that both have, and once if both
    are unsettled.
    """
    x, n, root, side, main = (table.column(c).to_numpy() for c in ("x", "nx", "root", "side", "main"))
    cells, pivots, pivot = table.column("data").to_pylist(), table.column("pivots").to_pylist(), table.column("a")[0].as_py()
    width = np.array([len(c) for c in cells])
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    out_a, out_b = [], []
    for wa in np.unique(width[left]):
        for wb in np.unique(width[right]):
            m = int(min(wa, wb))
            if max(wa, wb) > 2 * m:
                continue
            ia, ib = left[width[left] == wa], right[width[right] == wb]
            other = _fold([cells[k] for k in ib], m)
            for k, row in zip(ia, _fold([cells[k] for k in ia], m)):
                fits = (root[ib] != root[k]) & (3 * np.maximum(n[ib], n[k]) <= 4 * np.minimum(n[ib], n[k])) & ((root[ib] == main[ib]) | (x[ib] > x[k]))
                at = np.flatnonzero(fits)
                if len(at):
                    far = np.abs(other[at] - row).sum(1, dtype=np.int64)
                    known = set(pivots[k])
                    good = [j for j in ib[at[7 * far <= n[ib[at]] + n[k]]].tolist() if next(p for p in pivots[j] if p in known) == pivot]
                    out_a.append(np.full(len(good), k))
                    out_b.append(np.array(good, np.int64))
    a = np.concatenate(out_a) if out_a else np.zeros(0, np.int64)
    b = np.concatenate(out_b) if out_b else np.zeros(0, np.int64)
    swap = x[a] > x[b]
    a, b = np.where(swap, b, a), np.where(swap, a, b)
    return pa.table({"a": x[a], "b": x[b], "na": n[a], "nb": n[b]})


def _unsettled(stars: DataFrame, found: DataFrame, cells: DataFrame) -> DataFrame:
    """Near pairs of members of one pivot that are in different components.

    Two sets of one signature group are members of its pivot, and each was
    compared with the pivot itself.  Pairs inside a pivot's largest component
    need no test, so only its other members meet all members, in blocks of about
    BLOCK_MEMBERS on either side dealt by hash: no task holds or sorts an
    unbounded group, and a settled group costs nothing.
    """
    roots = work.components(found).select(F.col("node").alias("x"), "root")
    rows = stars.select("a", F.col("b").alias("x"), F.col("nb").alias("nx")).join(roots, "x", "left").withColumn("root", F.coalesce("root", "x"))
    each = rows.groupBy("a", "root").agg(F.count("*").alias("n"))
    main = each.groupBy("a").agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.sum("n").alias("all"), F.max("n").alias("most")).where("all > most")
    blocks = lambda c: F.greatest(F.lit(1), F.ceil(c / BLOCK_MEMBERS)).cast("long")
    main = work.cut(main.select("a", "main", blocks(F.col("all") - F.col("most")).alias("lefts"), blocks(F.col("all")).alias("rights")), "unsettled")
    main = work.small_or_not(main, main.count(), 48)
    rows = rows.join(main, "a")
    dealt = lambda seed, n: F.pmod(F.xxhash64(F.lit(seed), "x"), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    left = rows.where("root <> main").select("a", "x", "nx", "root", "main", F.lit(0).alias("side"), dealt(0, "lefts").alias("lo"), every("rights").alias("hi"))
    right = rows.select("a", "x", "nx", "root", "main", F.lit(1).alias("side"), every("lefts").alias("lo"), dealt(1, "rights").alias("hi"))
    pivots = stars.join(main, "a", "left_semi").groupBy(F.col("b").alias("x")).agg(F.array_sort(F.collect_set("a")).alias("pivots"))
    both = left.union(right).join(pivots, "x").join(cells.select(F.col("cls").alias("x"), "data"), "x")
    return work.cut(both.groupBy("a", "lo", "hi").applyInArrow(_across, "a long, b long, na long, nb long"), "near")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document with an id."""
    docs = docs.select("doc_id", "text").where("doc_id is not null")
    facts, sketch, counters = survey(docs)
    roots = work.components(links(docs, facts, sketch, counters))
    rep = facts.where("n > 0").groupBy("cls").agg(F.min("doc_id").alias("least"))
    label = rep.join(roots.select(F.col("node").alias("cls"), "root"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    smallest = label.groupBy("root").agg(F.min("least").alias("component_id"))
    of = label.join(smallest, "root").select("cls", "component_id")
    linked = facts.where("n > 0").join(of, "cls", "left").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return linked.union(facts.where("n = 0").select("doc_id", "n", "doc_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """Drops all but the smallest doc_id of every component.

    Rows without a doc_id stay; of repeated rows of one doc_id one stays.
    """
    found = work.cut(near_duplicates(docs), "components")
    count = found.agg(F.count("*").alias("rows"), F.count_distinct("doc_id").alias("ids"), F.count_if(F.expr("doc_id <> component_id")).alias("gone")).first()
    gone = found.where("doc_id <> component_id").select("doc_id").distinct()
    kept = docs.join(work.small_or_not(gone, count["gone"], 16), "doc_id", "left_anti").select(docs.columns)
    if count["rows"] == count["ids"]:
        return kept
    return kept.where("doc_id is not null").dropDuplicates(["doc_id"]).union(kept.where("doc_id is null"))


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(work.table(spark, sf_dir, "documents"))
