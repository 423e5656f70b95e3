"""Token counts by a compiled finite-state transducer.

The transducer reads characters and annotates each transition with the change
of the token count.  Its states come from the fact that a merge encoding is
right exactly if every two neighbouring tokens are compatible (encoding their
joined text gives just the two back): the last token of the encoding of a
prefix follows from the last tokens at the places where a piece can still
start.  A state is that finite context - a chain of trie nodes, each with the
token before its start and the relative count - so equal contexts of any texts
are one state.  States and transitions are compiled when first met and kept in
one dense table per process.

Texts are dealt into chunks of equal length, and all chunks run in lock-step
through the table.  A chunk's entry state is unknown, so it first runs from the
state behind a blank.  Its state map has a row (entry, exit, tokens) for each
entry that the map of the chunk before can give; such an entry runs only until
both runs are in one state, mostly to the first word boundary.  The maps are
composed by a parallel prefix scan: in round j those of 2^j successive chunks,
which gives all true entries in as many rounds as the number of chunks has
bits.  Words of any length stay exact.

The table and the memo of pairs are bounded: between blocks of chunks, also of
one long text, a full table starts anew from the state at hand.

Null and empty texts have no tokens.  Every row is counted, repeated rows too.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import kernel, work

LIMIT = 4096
CHUNK = 256
LANES = 4096
TABLE_CELLS = 24_000_000
BLANK = "▁"


class Transducer:
    """Counts tokens of a sentencepiece BPE model with byte fallback."""

    def __init__(self, model_path: str):
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(model_path, "rb") as f:
            model.ParseFromString(f.read())
        spec = model.normalizer_spec
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.add_dummy_prefix or model.trainer_spec.model_type != 2 or not model.trainer_spec.byte_fallback:
            raise ValueError("only identity-normalised BPE models with byte fallback are compiled")
        self.score = {p.piece: p.score for p in model.pieces if p.type == 1}
        self.kids: list[dict[str, int]] = [{}]
        self.text = [""]
        for piece in self.score:
            at = 0
            for c in piece:
                nxt = self.kids[at].get(c)
                if nxt is None:
                    nxt = len(self.kids)
                    self.kids[at][c] = nxt
                    self.kids.append({})
                    self.text.append(self.text[at] + c)
                at = nxt
        self.fits: dict[tuple[str, str], bool] = {}
        self.known = {c: i for i, c in enumerate(sorted(self.kids[0]))}
        lut = np.zeros(0x110000, np.int32)
        lut[:0x80], lut[0x80:0x800], lut[0x800:0x10000], lut[0x10000:] = 0, 1, 2, 3
        for c, i in self.known.items():
            lut[ord(c)] = 4 + i
        lut[32] = lut[ord(BLANK)]
        self.lut = lut
        self.chars = [None] * 4 + list(self.known)
        self.clear()

    def clear(self) -> None:
        self.states: list[tuple] = []
        self.ids: dict[tuple, int] = {}
        self.column = np.full(len(self.chars), -1, np.int32)
        self.used: list[int] = []
        self.rows, self.cols = 1024, 64
        self.table = np.full(self.rows * self.cols, -1, np.int64)
        self.reset = self.intern(((0, None, 0),))
        self.blank = self.step(self.reset, self.chars.index(BLANK))[0]

    def intern(self, chain: tuple) -> int:
        got = self.ids.get(chain)
        if got is None:
            got = self.ids[chain] = len(self.states)
            self.states.append(chain)
        return got

    def merge(self, s: str) -> list[str]:
        parts = list(s)
        while True:
            best, where = None, -1
            for i in range(len(parts) - 1):
                x = self.score.get(parts[i] + parts[i + 1])
                if x is not None and (best is None or x > best):
                    best, where = x, i
            if where < 0:
                return parts
            parts[where : where + 2] = [parts[where] + parts[where + 1]]

    def fit(self, left: str | None, right: str) -> bool:
        if left is None or (left[-1] != BLANK and right[0] == BLANK):
            return True
        key = (left, right)
        got = self.fits.get(key)
        if got is None:
            if len(self.fits) > 2_000_000:
                self.fits.clear()
            got = self.fits[key] = self.merge(left + right) == [left, right]
        return got

    def step(self, state: int, cls: int) -> tuple[int, int]:
        """(next state, change of the count) for a character class."""
        if cls < 4:
            return self.reset, cls + 1
        c, chain = self.chars[cls], self.states[state]
        if c == BLANK and chain[-1][1] is not None and chain[-1][1][-1] != BLANK:
            chain = ((0, None, 0),)
        grown = [(self.kids[node][c], tok, rel) for node, tok, rel in chain if c in self.kids[node]]
        for node, tok, rel in grown:
            piece = self.text[node]
            if (piece in self.score or len(piece) == 1) and self.fit(tok, piece):
                cost = 1 if piece in self.score else len(piece.encode())
                delta, last = rel + cost, piece
                break
        else:
            raise AssertionError("no piece fits")
        out = tuple((node, tok, rel - delta) for node, tok, rel in grown if self.kids[node]) + ((0, last, 0),)
        return self.intern(out), delta

    def compile(self, states: np.ndarray, classes: np.ndarray) -> None:
        """Add the transitions of (state, class) pairs to the table."""
        for s, c in set(zip(states.tolist(), classes.tolist())):
            nxt, delta = self.step(s, c)
            if len(self.states) > self.rows:
                self.resize(2 * self.rows, self.cols)
            self.table[s * self.cols + self.column[c]] = nxt | (delta + 64) << 32

    def resize(self, rows: int, cols: int) -> None:
        old = self.table.reshape(self.rows, self.cols)
        new = np.full((rows, cols), -1, np.int64)
        new[: self.rows, : self.cols] = old
        self.rows, self.cols, self.table = rows, cols, new.reshape(-1)

    def columns(self, classes: np.ndarray) -> np.ndarray:
        """Table columns of character classes, with new ones added."""
        got = self.column[classes]
        if len(got) and got.min() < 0:
            for c in np.unique(classes[got < 0]).tolist():
                self.column[c] = len(self.used)
                self.used.append(c)
            if len(self.used) > self.cols:
                self.resize(self.rows, max(2 * self.cols, len(self.used)))
            got = self.column[classes]
        return got

    def move(self, state: np.ndarray, col: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cell = self.table.take(state * self.cols + col)
        if cell.min() < 0:
            miss = cell < 0
            used = np.array(self.used)
            self.compile(state[miss], used[col[miss]])
            cell = self.table.take(state * self.cols + col)
        return cell & 0xFFFFFFFF, (cell >> 32) - 64

    def count(self, codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Tokens of each text; text i is codes[starts[i]:starts[i + 1]]."""
        size = np.diff(starts)
        total = (size > 0).astype(np.int64)
        pieces = -(-size // CHUNK)
        owner = np.repeat(np.arange(len(size)), pieces)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        begin = starts[:-1][owner] + nth * CHUNK
        length = np.minimum(CHUNK, starts[1:][owner] - begin)
        col = self.columns(self.lut[codes])
        entry = self.blank
        for lo in range(0, len(owner), LANES):
            if self.rows * self.cols > TABLE_CELLS:
                chain = self.states[entry]
                self.clear()
                col, entry = self.columns(self.lut[codes]), self.intern(chain)
            entry = self._lanes(col, begin, length, nth, owner, total, entry, lo, min(lo + LANES, len(owner)))
        return total

    def _replay(self, col, run: dict, lane: np.ndarray, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(exit, tokens) of chunks for other entries, run until they meet the first run."""
        st, add = entry.copy(), np.zeros(len(lane), np.int64)
        exits, tokens = np.empty(len(lane), np.int64), np.empty(len(lane), np.int64)
        at, t = np.arange(len(lane)), 0
        while len(at):
            mine = lane[at]
            same = st[at] == run["path"][t, mine]
            done = same | (run["length"][mine] == t)
            k = at[done]
            tokens[k] = run["tokens"][lane[k]] - run["sums"][t, lane[k]] + add[k]
            exits[k] = np.where(same[done], run["exit"][lane[k]], st[k])
            at = at[~done]
            if len(at):
                s, d = self.move(st[at], col[run["begin"][lane[at]] + t])
                st[at] = s
                add[at] += d
                t += 1
        return exits, tokens

    def _lanes(self, col, begin, length, nth, owner, total, entry, lo, hi) -> int:
        """Adds the tokens of chunks lo to hi; returns the last one's exit state.

        ``entry`` is the state ahead of chunk lo where that goes on with a text.
        """
        n, m = hi - lo, int(length[lo:hi].max())
        order = np.argsort(-length[lo:hi], kind="stable")
        b, ln = begin[lo:hi][order], length[lo:hi][order]
        state = np.full(n, self.blank, np.int64)
        count = np.zeros(n, np.int64)
        path = np.zeros((m + 1, n), np.int64)
        sums = np.zeros((m + 1, n), np.int64)
        path[0] = state
        for t in range(m):
            live = int(np.searchsorted(-ln, -t, "left"))
            s, d = self.move(state[:live], col[b[:live] + t])
            state[:live] = s
            count[:live] += d
            path[t + 1], sums[t + 1] = state, count
        place = np.empty(n, np.int64)
        place[order] = np.arange(n)
        run = {"path": path, "sums": sums, "exit": state, "tokens": count, "begin": b, "length": ln}
        heads = nth[lo:hi] == 0
        heads[0] = True
        chunk, into, out, tokens = self._maps(col, run, place, heads, entry if nth[lo] else self.blank)
        true = _scan(chunk, into, out, heads)
        np.add.at(total, owner[lo:hi], tokens[true])
        return int(out[true[-1]])

    def _maps(self, col, run, place, heads, entry):
        """State maps of all chunks: sorted rows (chunk, entry, exit, tokens).

        A head has one entry.  The entries of any other chunk are the exits of
        the one before it, for each of that one's entries, and for the blank that
        all started from: rows are added until every exit is an entry.
        """
        n = len(place)
        at = np.arange(n)
        first = np.full(n, self.blank, np.int64)
        first[0] = entry
        first[1:][~heads[1:]] = run["exit"][place[:-1]][~heads[1:]]
        seen = np.zeros(0, np.int64)
        parts = []
        chunk, into = at, first
        while len(chunk):
            out, tokens = self._replay(col, run, place[chunk], into)
            parts.append((chunk, into, out, tokens))
            seen = np.union1d(seen, chunk << 32 | into)
            follows = np.flatnonzero((chunk + 1 < n) & ~heads[np.minimum(chunk + 1, n - 1)])
            new = np.setdiff1d((chunk[follows] + 1) << 32 | out[follows], seen)
            chunk, into = new >> 32, new & 0xFFFFFFFF
        chunk, into, out, tokens = (np.concatenate(x) for x in zip(*parts))
        order = np.argsort(chunk << 32 | into, kind="stable")
        return chunk[order], into[order], out[order], tokens[order]


def _scan(chunk: np.ndarray, into: np.ndarray, out: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """The row of each chunk's true entry, by a parallel prefix scan of the maps.

    Round j holds the maps of 2^j successive chunks, each composed of two maps of
    the round before; they carry the true rows of the chunks less than 2^j past a
    head over to those less than 2^(j+1) past it.
    """
    n, key = len(heads), chunk << 32 | into
    lead = np.searchsorted(chunk, np.arange(n))
    jump = np.searchsorted(key, (chunk + 1) << 32 | out)
    jump[(chunk + 1 >= n) | heads[np.minimum(chunk + 1, n - 1)]] = -1
    at = np.flatnonzero(heads)
    past = np.arange(n) - at[np.searchsorted(at, np.arange(n), "right") - 1]
    true, step = lead.copy(), 1
    while step <= past.max(initial=0):
        mine = np.flatnonzero((past >= step) & (past < 2 * step))
        true[mine] = jump[true[mine - step]]
        jump = np.where(jump >= 0, jump[jump], -1)
        step *= 2
    return true


def transducer(model_path: str) -> Transducer:
    return kernel.cached(("transducer", model_path), lambda: Transducer(model_path))


def count_column(column: pa.Array, machine: Transducer) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, tokens) of every text of an Arrow string column."""
    buf, offs = kernel.column_bytes(column)
    out = np.zeros(len(offs) - 1, np.int64)
    for a, b in kernel.slices(offs):
        part = buf[offs[a] : offs[b]]
        codes = np.frombuffer(part.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        chars = np.concatenate(([0], np.cumsum((part & 0xC0) != 0x80)))
        out[a:b] = machine.count(codes, chars[offs[a : b + 1] - offs[a]])
    return np.diff(offs), out


def token_counts(docs: DataFrame, model_path: str, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every document."""

    def run(batches):
        machine = transducer(model_path)
        for batch in batches:
            size, tokens = count_column(batch.column("text"), machine)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(size, pa.int64()), pa.array(tokens, pa.int64()), pa.array(tokens > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select("doc_id", "text").mapInArrow(work.tidy(run), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(work.table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
