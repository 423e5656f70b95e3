"""Best-two-fit packing of token sequences.

Texts become token ids with ``tokenizers``.  Tokens of the vocabulary never
span white space, so ids are looked up by white-space-separated chunk and only
chunks not seen before are encoded, in batches; the memo is bounded.

Documents longer than a sequence are cut into full pieces; all other lengths
are integers up to the capacity, so a packing task works on a histogram with a
bit set of the lengths at hand.  It fills a bin with the longest document that
fits until none does; then it takes the bin's smallest document out if two
unpacked ones fill the expanded gap more tightly, and puts these in.

Packing tasks are independent groups of pieces, dealt by hash; their number grows
with the pieces that the texts can have at most, so no task grows however long
texts are, and a group of some 30,000 pieces leaves one open bin at most and loses no more than a fraction of a per mille.

Null and empty texts are the end id alone.  Repeated rows are packed each.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernel, work

CAPACITY = 4096
END_ID = 1
PIECES_PER_GROUP = 32_768
MEMO_CHUNKS = 1_000_000
JOINED = 500


class ChunkIds:
    """Ids of texts, as little-endian unsigned 32-bit bytes.

    The vocabulary lowers case and parts letters and digits from punctuation,
    so texts are lowered (A-Z) and a full stop or comma between an ASCII letter
    or digit and white space is a chunk of its own: fewer chunks to know.
    Texts with special strings are left as they are.
    """

    ENDING = re.compile(rb"[.,](?<=[a-z0-9][.,])(?=\s)")

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        special = [(i, t.content) for i, t in self.tok.get_added_tokens_decoder().items() if t.special and not t.normalized and t.content.startswith("<|")]
        self.mark_id, self.mark = (special[0][0], special[0][1].encode()) if special else (-1, b"")
        self.memo: dict[bytes, bytes] = {}

    def of(self, texts: list[bytes]) -> list[bytes]:
        part = self.ENDING.sub
        chunks = [(t if b"<|" in t else part(rb" \g<0>", t.lower())).split() for t in texts]
        memo = self.memo
        if len(memo) > MEMO_CHUNKS:
            memo.clear()
        self._learn(set().union(*chunks).difference(memo))
        return [b"".join([memo[c] for c in each]) for each in chunks]

    def _learn(self, new: set[bytes]) -> None:
        """Encodes chunks, JOINED at a time with a special token between them, which
        no text's encoding reaches across; chunks that could hold one go alone."""
        plain = [c for c in new if b"<|" not in c] if self.mark else []
        alone = list(new.difference(plain))
        got = self.tok.encode_batch_fast([c.decode() for c in alone], add_special_tokens=False)
        self.memo.update(zip(alone, [array("I", e.ids).tobytes() for e in got]))
        parts = [plain[k : k + JOINED] for k in range(0, len(plain), JOINED)]
        for part, e in zip(parts, self.tok.encode_batch_fast([self.mark.join(p).decode() for p in parts], add_special_tokens=False) if parts else []):
            ids = np.array(e.ids, "<u4")
            raw, cuts = ids.tobytes(), (4 * np.flatnonzero(ids == self.mark_id)).tolist()
            self.memo.update(zip(part, [raw[a:b] for a, b in zip([0, *(c + 4 for c in cuts)], [*cuts, len(raw)])], strict=True))


def pack(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of every item by best-two-fit."""
    n = len(lengths)
    bins, offs = np.zeros(n, np.int64), np.zeros(n, np.int64)
    order = np.argsort(lengths, kind="stable")
    stacks: dict[int, list[int]] = {}
    for size, at in zip(*_runs(lengths[order])):
        stacks[size] = order[at[0] : at[1]].tolist()[::-1]
    have = back = 0
    for size in stacks:
        have |= 1 << size
        back |= 1 << (capacity - size)

    def take(size: int) -> int:
        nonlocal have, back
        item = stacks[size].pop()
        if not stacks[size]:
            have ^= 1 << size
            back ^= 1 << (capacity - size)
        return item

    def give(size: int, item: int) -> None:
        nonlocal have, back
        stacks[size].append(item)
        have |= 1 << size
        back |= 1 << (capacity - size)

    def two(most: int, least: int) -> tuple[int, int] | None:
        """Lengths at hand with the largest sum in (least, most]."""
        for total in range(most, least, -1):
            pairs = have & (back >> (capacity - total))
            while pairs:
                a = pairs.bit_length() - 1
                if 2 * a != total or len(stacks[a]) > 1:
                    return a, total - a
                pairs ^= 1 << a
        return None

    number = 0
    while have:
        gap, held = capacity, []
        while fits := have & ((1 << (gap + 1)) - 1):
            size = fits.bit_length() - 1
            held.append((size, take(size)))
            gap -= size
        if gap and len(held) > 1:
            size, item = held[-1]
            if better := two(gap + size, size):
                held.pop()
                held += [(x, take(x)) for x in better]
                give(size, item)
        at = 0
        for size, item in held:
            bins[item], offs[item] = number, at
            at += size
        number += 1
    return bins, offs


def _runs(ordered: np.ndarray) -> tuple[list[int], list[tuple[int, int]]]:
    if not len(ordered):
        return [], []
    lead = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
    ends = np.concatenate((lead[1:], [len(ordered)]))
    return ordered[lead].tolist(), list(zip(lead.tolist(), ends.tolist()))


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Pieces of every document's ids; ``with_ids`` adds the ids as binary."""
    step = 4 * capacity
    end = np.array([END_ID], "<u4").tobytes()

    def run(batches):
        tok = kernel.cached(("chunks", tokenizer_path), lambda: ChunkIds(tokenizer_path))
        for batch in batches:
            buf, offs = kernel.column_bytes(batch.column("text"))
            ids = batch.column("doc_id").to_pylist()
            for a, b in kernel.slices(offs):
                raw = buf[offs[a] : offs[b]].tobytes()
                cuts = (offs[a : b + 1] - offs[a]).tolist()
                got = tok.of([raw[x:y] for x, y in zip(cuts, cuts[1:])])
                rows = []
                for doc, data in zip(ids[a:b], got):
                    data += end
                    for k, lo in enumerate(range(0, len(data), step)):
                        part = data[lo : lo + step]
                        rows.append((doc, k, lo // 4, len(part) // 4, zlib.crc32(part), part))
                cols = list(zip(*rows))
                types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
                names = ("doc_id", "piece", "start", "length", "ids_crc32", "ids")
                keep = 6 if with_ids else 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols[:keep], types)], list(names[:keep]))

    return docs.select("doc_id", "text").mapInArrow(work.tidy(run), PIECES + (", ids binary" if with_ids else ""))


def _place(capacity: int):
    def run(table: pa.Table) -> pa.Table:
        length = table.column("length").to_numpy()
        bins, offs = pack(length, capacity)
        group = table.column("grp").to_numpy()
        table = table.append_column("sequence_id", pa.array((group.astype(np.int64) << 32) + bins)).append_column("offset", pa.array(offs))
        return table.drop_columns(["grp"])

    return run


def most_pieces(docs: DataFrame, capacity: int = CAPACITY) -> int:
    """An upper bound of the number of pieces: no token is shorter than a byte."""
    spare = F.octet_length("text") / capacity
    return int(docs.agg(F.count("*") + F.coalesce(F.sum(F.floor(spare)), F.lit(0))).first()[0])


def best_two_fit(cut: DataFrame, n_pieces: int, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to pieces with a ``length``, some n_pieces."""
    groups = max(1, -(-n_pieces // PIECES_PER_GROUP))
    dealt = cut.withColumn("grp", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(groups)))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cut.schema.fields)
    return dealt.groupBy("grp").applyInArrow(_place(capacity), f"{schema}, sequence_id long, offset long")


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = work.table(spark, sf_dir, "documents")
    return best_two_fit(pieces(docs, public_tokenizers.path("word_bpe_49k.json")), most_pieces(docs))
