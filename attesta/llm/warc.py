"""WARC archives and their external index merge.

Pages are written as gzip-per-record WARC 1.1 files to the shared folder, by
tasks that name their files afresh; only files whose index entries were
committed are ever read, so a lost or repeated task leaves no trace.  Of
records with equal payloads of at least ``min_bytes`` bytes, the one with the
smallest page_id is the response and the others are revisits of it.

Each file's index entries are a run, sorted by (URL key, timestamp, page_id,
file, offset).  Ranges of that composite key are cut at quantiles of a sample
that grows with them (they only balance the work), each run is dealt into its range pieces in order, and
one task a range merges its pieces with a loser tree.  A URL with a third of
all captures is cut by timestamp and page like any other stretch of keys.

The archives are then read back, record by record, and joined with the merged
index on (file, offset).

A null html is the empty payload, a null url the empty URL.  Repeated rows are
records of their own, and still one of a payload is the response: of equal
page_ids that of the smallest url and time, a null page_id only if there is no
other (its revisits refer to no page).  Pages have no capture time: ``capture_ts`` is the column of that
name if there is one, else 2024-01-01 plus page_id seconds.
"""

from __future__ import annotations

import base64
import bisect
import uuid
import zlib
from urllib.parse import urlsplit

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import work

FILE_BYTES = 256 << 20
ENTRIES_PER_RANGE = 20_000
SAMPLE_PER_RANGE = 64
#: Sorts records without a page_id last.
LAST_ID = (1 << 63) - 1
EPOCH = "2024-01-01 00:00:00"
#: Seconds that made-up capture times span, ranges that the driver has bounds of, and the numbers that each may be cut into.
SPAN, FIRST_RANGES, RANGE_STEP = 315_576_000, 256, 1 << 32
LEVEL = 2


class LoserTree:
    """k-way merge of sorted lists of tuples.

    Inner nodes hold the losers of their matches, so each step replays one path
    from the winner's leaf to the root.  Ties go to the earlier list.
    """

    def __init__(self, runs: list[list[tuple]]):
        self.runs = runs
        self.at = [0] * len(runs)
        self.k = max(1, len(runs))
        self.losers = [-1] * self.k
        self.winner = self._build(1) if runs else -1

    def _key(self, run: int):
        return self.runs[run][self.at[run]] if self.at[run] < len(self.runs[run]) else None

    def _beats(self, a: int, b: int) -> bool:
        x, y = self._key(a), self._key(b)
        if x is None or y is None:
            return y is None and (x is not None or a < b)
        return (x, a) < (y, b)

    def _build(self, node: int) -> int:
        if node >= self.k:
            return node - self.k
        a, b = self._build(2 * node), self._build(2 * node + 1)
        if not self._beats(a, b):
            a, b = b, a
        self.losers[node] = b
        return a

    def __iter__(self):
        while self.winner >= 0:
            top = self._key(self.winner)
            if top is None:
                return
            yield top
            w = self.winner
            self.at[w] += 1
            node = (w + self.k) // 2
            while node >= 1:
                if self._beats(self.losers[node], w):
                    self.losers[node], w = w, self.losers[node]
                node //= 2
            self.winner = w


def url_key(url: str) -> str:
    """Sort key of a URL: host labels reversed, then path and query."""
    try:
        parts = urlsplit(url)
        host = parts.hostname or ""
    except ValueError:
        return url.lower()
    key = ",".join(reversed(host.split("."))) + ")" + (parts.path or "/")
    return (key + ("?" + parts.query if parts.query else "")).lower()


def _clean(value: str) -> str:
    return "".join(c if 32 <= ord(c) != 127 else f"%{ord(c):02X}" for c in value)


HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def record(page_id, url: str, date: str, payload: bytes, size: int, digest: str, revisit: bool, refers_to) -> bytes:
    """One WARC record; a revisit has the HTTP head only and needs no payload."""
    kind = "revisit" if revisit else "response"
    block = HTTP + (b"" if revisit else payload)
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {_clean(url)}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {size}",
        f"X-Page-ID: {'' if page_id is None else page_id}",
    ]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{refers_to}')}>", f"X-Refers-To-Page: {refers_to}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """(headers, payload) of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    return fields, block.partition(b"\r\n\r\n")[2]


INDEX = "url_key string, ts string, page_id long, file string, offset long, size long"
_KEY = pa.struct([("url_key", pa.string()), ("ts", pa.string()), ("page_id", pa.int64()), ("file", pa.string()), ("offset", pa.int64())])
_INDEX_NAMES = ("url_key", "ts", "page_id", "file", "offset", "size")


def _open(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def _write(folder: str):
    """Writes a task's pages; yields each file's entries as one sorted batch."""

    def close(out, entries):
        out.close()
        entries.sort(key=lambda e: (e[0], e[1], LAST_ID if e[2] is None else e[2], e[3], e[4]))
        cols = list(zip(*entries))
        types = (pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], list(_INDEX_NAMES))

    def run(batches):
        store, base = _open(folder)
        store.create_dir(base, recursive=True)
        out, entries, offset = None, [], 0
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in _RECORD)):
                page_id, url, payload, size, sha1, ts, refers_to, revisit = row
                if out is None:
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    out, offset = store.open_output_stream(f"{base}/{name}", compression=None), 0
                packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                raw = record(page_id, url, ts, payload, size, base64.b32encode(bytes.fromhex(sha1)).decode(), revisit, refers_to)
                data = packer.compress(raw) + packer.flush()
                out.write(data)
                entries.append((url_key(url), ts, page_id, name, offset, len(data)))
                offset += len(data)
                if offset >= FILE_BYTES:
                    yield close(out, entries)
                    out, entries = None, []
        if out is not None:
            yield close(out, entries)

    return run


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0) -> DataFrame:
    """Writes WARC files; returns the index entries of all runs, run by run.

    A column ``capture_ts`` that is a time stamp is the capture time; one of another type is any
    column.  Else, and where it is null, the time follows from page_id, within SPAN seconds of EPOCH.
    """
    ts = F.timestamp_seconds(F.unix_timestamp(F.lit(EPOCH)) + F.coalesce(F.pmod("page_id", F.lit(SPAN)), F.lit(0)))
    if dict(pages.dtypes).get("capture_ts") in ("timestamp", "timestamp_ntz"):
        ts = F.coalesce(F.col("capture_ts").cast("timestamp"), ts)
    rows = pages.select(
        "page_id",
        F.coalesce("url", F.lit("")).alias("url"),
        F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"),
        F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("ts"),
    ).withColumn("sha1", F.sha1("payload"))
    rows = rows.withColumn("bytes", F.octet_length("payload").cast("long"))
    return work.cut(_referred(rows, min_bytes).mapInArrow(work.tidy(_write(folder)), INDEX), "runs")


_RECORD = ["page_id", "url", "payload", "bytes", "sha1", "ts", "refers_to", "revisit"]


def _referred(rows: DataFrame, min_bytes: int) -> DataFrame:
    """Rows with ``revisit`` and ``refers_to``: one response per payload.

    The response of a payload is its row of smallest (page_id, url, ts), null
    page_ids last; of rows that are equal in all of these one is taken.  The
    table of repeated payloads is pre-aggregated.  If it is not small, a Bloom
    filter of its digests parts the rows first: those of a payload of their own
    are not shuffled, and of the others only ids and digests are, beside one
    copy of each payload.
    """
    from .urls import bloom_flag

    order = F.struct(F.col("page_id").isNull().alias("no_id"), "page_id", "url", "ts")
    first = rows.where(F.col("bytes") >= min_bytes).groupBy("sha1").agg(F.min(order).alias("first"), F.count("*").alias("n")).where("n > 1").select("sha1", "first")
    first = work.cut(first, "payloads")
    n = first.count()
    if n * 400 <= work.BROADCAST_BYTES:
        return _one_response(rows.join(F.broadcast(first), "sha1", "left"), order)
    flagged = bloom_flag(rows.withColumn("h", F.xxhash64("sha1")), first.select(F.xxhash64("sha1").alias("h")), n)
    alone = flagged.where("not maybe").withColumn("first", F.lit(None).cast(first.schema["first"].dataType))
    shared = flagged.where("maybe")
    payloads = shared.groupBy("sha1").agg(F.first("payload").alias("payload"))
    named = _one_response(shared.drop("payload").join(first, "sha1", "left").withColumn("payload", F.lit(b"")), order).drop("payload")
    named = named.where("not revisit").join(payloads, "sha1").unionByName(named.where("revisit").withColumn("payload", F.lit(b"")))
    return _one_response(alone, order).unionByName(named.select(*_RECORD))


def _one_response(rows: DataFrame, order: Column) -> DataFrame:
    """Revisits are rows behind ``first`` and all but one of those equal to it."""
    found = rows.withColumn("leads", order == F.col("first")).withColumn("refers_to", F.when(~F.col("leads"), F.col("first.page_id")))
    plain = found.where("leads is null or not leads").withColumn("revisit", F.col("leads").isNotNull())
    leads = found.where("leads").groupBy("page_id", "url", "payload", "bytes", "sha1", "ts", "first").agg(F.count("*").alias("n"))
    leads = leads.select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("nth"))
    leads = leads.withColumn("revisit", F.col("nth") > 1).withColumn("refers_to", F.when(F.col("nth") > 1, F.col("first.page_id")))
    return plain.select(*_RECORD).unionByName(leads.select(*_RECORD))


def _sample(entries: DataFrame, ranges: int) -> DataFrame:
    """Composite keys, SAMPLE_PER_RANGE a range or so.  File and offset make keys distinct, so equal captures can be cut as well."""
    share = min(1.0, SAMPLE_PER_RANGE * ranges / max(1, entries.count()))
    return entries.select("url_key", "ts", F.coalesce("page_id", F.lit(LAST_ID)).alias("page_id"), "file", "offset").sample(share, 7)


def _quantiles(keys: list[tuple], ranges: int) -> list[tuple]:
    keys = sorted(set(keys))
    return sorted({keys[len(keys) * i // ranges] for i in range(1, ranges)}) if keys else []


def _bounds(entries: DataFrame, ranges: int) -> list[tuple]:
    """Bounds of FIRST_RANGES ranges at most, of a sample that is bounded with them."""
    ranges = min(ranges, FIRST_RANGES)
    return _quantiles([tuple(r) for r in _sample(entries, ranges).collect()], ranges) if ranges > 1 else []


def _own_bounds(entries: DataFrame, bounds: list[tuple], ranges: int) -> DataFrame:
    """(range, bounds): each first range's own bounds, of the sample that falls into it; no machine sees those of all."""
    each = -(-ranges // FIRST_RANGES)
    kind = "array<struct<url_key:string,ts:string,page_id:long,file:string,offset:long>>"

    def run(table: pa.Table) -> pa.Table:
        keys = _quantiles(list(zip(*(table.column(c).to_pylist() for c in _INDEX_NAMES[:5]))), each)
        listed = [dict(zip(_INDEX_NAMES[:5], k)) for k in keys]
        return pa.table({"range": table.column("range").slice(0, 1), "bounds": pa.array([listed], pa.list_(_KEY))})

    def deal(batches):
        for batch in batches:
            keys = zip(*(c.to_pylist() for c in batch.columns))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([bisect.bisect_right(bounds, k) for k in keys], pa.int64())], [*_INDEX_NAMES[:5], "range"])

    told = _sample(entries, ranges).mapInArrow(work.tidy(deal), "url_key string, ts string, page_id long, file string, offset long, range long")
    return told.groupBy("range").applyInArrow(run, f"range long, bounds {kind}")


def _deal_again(batches):
    """Cuts pieces of first ranges by these ranges' own bounds, each still in order; ranges are numbered within RANGE_STEP."""
    for batch in batches:
        out: list[tuple] = []
        cols = [batch.column(c).to_pylist() for c in ("range", "run", "bounds", *_INDEX_NAMES)]
        for first, run, bounds, *lists in zip(*cols):
            bounds = [tuple(b.values()) for b in bounds or ()]
            rows = list(zip(*lists))
            keys = [(k, t, LAST_ID if p is None else p, f, o) for k, t, p, f, o, _ in rows]
            cuts = [0, *(bisect.bisect_left(keys, b) for b in bounds), len(rows)]
            for n, (lo, hi) in enumerate(zip(cuts, cuts[1:])):
                if lo < hi:
                    out.append((first * RANGE_STEP + n, f"{run}-{n}", *(list(c) for c in zip(*rows[lo:hi]))))
        types = (pa.int64(), pa.string(), *(pa.list_(t) for t in (pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())))
        cols = list(zip(*out)) if out else [()] * len(types)
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types)], ["range", "run", *_INDEX_NAMES])


def _deal(bounds: list[tuple]):
    """Cuts runs into range pieces (range, run, entries), each still in order."""

    def run(batches):
        piece, last, name, serial = [], None, None, uuid.uuid4().hex

        def flush(r, rows, number):
            cols = list(zip(*rows))
            lists = [pa.array([list(c)], pa.list_(t)) for c, t in zip(cols, (pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()))]
            return pa.RecordBatch.from_arrays([pa.array([r], pa.int64()), pa.array([f"{serial}-{number}"]), *lists], ["range", "run", *_INDEX_NAMES])

        number = 0
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in _INDEX_NAMES)):
                r = bisect.bisect_right(bounds, (row[0], row[1], LAST_ID if row[2] is None else row[2], row[3], row[4]))
                if (r, row[3]) != (last, name):
                    if piece:
                        yield flush(last, piece, number)
                        number += 1
                    piece, last, name = [], r, row[3]
                piece.append(row)
        if piece:
            yield flush(last, piece, number)

    return run


def _merge(table: pa.Table) -> pa.Table:
    runs = []
    for cols in zip(*(table.column(c).to_pylist() for c in _INDEX_NAMES)):
        runs.append([(k, t, LAST_ID if p is None else p, f, o, s) for k, t, p, f, o, s in zip(*cols)])
    merged = list(LoserTree(runs))
    n = len(merged)
    cols = list(zip(*merged)) if merged else [()] * 6
    cols = [[None if v == LAST_ID else v for v in col] if c == "page_id" else col for c, col in zip(_INDEX_NAMES, cols)]
    out = pa.table({c: pa.array(v, t) for c, v, t in zip(_INDEX_NAMES, cols, (pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()))})
    return out.append_column("range", pa.array([table.column("range")[0].as_py()] * n, pa.int64())).append_column("position", pa.array(range(n), pa.int64()))


def merge_index(entries: DataFrame) -> DataFrame:
    """Globally ordered capture histories: order by (range, position).

    Over FIRST_RANGES ranges, runs are cut twice: by bounds that the driver knows, and by each of these ranges' own.
    """
    ranges = -(-entries.count() // ENTRIES_PER_RANGE)
    bounds = _bounds(entries, ranges)
    schema = "range long, run string, url_key array<string>, ts array<string>, page_id array<long>, file array<string>, offset array<long>, size array<long>"
    pieces = entries.mapInArrow(work.tidy(_deal(bounds)), schema)
    if ranges > FIRST_RANGES:
        own = work.cut(_own_bounds(entries, bounds, ranges), "bounds")
        pieces = pieces.join(own, "range", "left").mapInArrow(work.tidy(_deal_again), schema)
    return pieces.groupBy("range").applyInArrow(_merge, INDEX + ", range long, position long")


def _read(folder: str):
    def run(batches):
        store, base = _open(folder)
        for batch in batches:
            for name in batch.column("file").to_pylist():
                rows, offset = [], 0
                with store.open_input_stream(f"{base}/{name}", compression=None) as src:
                    rest, opener, parts = b"", zlib.decompressobj(31), []
                    used = 0
                    while True:
                        data = rest or src.read(1 << 20)
                        if not data:
                            break
                        parts.append(opener.decompress(data))
                        rest = opener.unused_data
                        used += len(data) - len(rest)
                        if not opener.eof:
                            continue
                        fields, payload = parse(b"".join(parts))
                        refers = fields.get("X-Refers-To-Page")
                        size, digest = int(fields["X-Payload-Length"]), fields["WARC-Payload-Digest"].removeprefix("sha1:")
                        if fields["WARC-Type"] == "response" and (size != len(payload) or digest != base64.b32encode(hashlib.sha1(payload).digest()).decode()):
                            raise ValueError(f"damaged record at {name}:{offset}")
                        own = fields["X-Page-ID"]
                        rows.append((name, offset, int(own) if own else None, size, digest, fields["WARC-Type"], None if refers is None else int(refers)))
                        offset, opener, parts = used, zlib.decompressobj(31), []
                cols = list(zip(*rows))
                types = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["file", "offset", "page", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return run


def read_archives(files: DataFrame, folder: str, parts: int) -> DataFrame:
    """Records of the named files, with payloads checked against their digests."""
    return files.repartition(max(1, parts), "file").mapInArrow(work.tidy(_read(folder)), "file string, offset long, page long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archive(pages: DataFrame, folder: str, min_bytes: int = 0) -> DataFrame:
    """Write, merge and read back: a row per page with its place in the index."""
    entries = write_archives(pages, folder, min_bytes)
    files = entries.select("file").distinct()
    records = read_archives(files, folder, files.count())
    index = merge_index(entries).select("file", "offset", "url_key", F.col("ts").alias("capture_ts"), "range", "position")
    rows = records.join(index.hint("merge"), ["file", "offset"])
    return rows.select(F.col("page").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "capture_ts", "range", "position")


def op3_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive(work.table(spark, sf_dir, "pages"), work.scratch_path(spark, "warc"))
