"""Toxicity by a misspelling-tolerant lexicon and context windows.

The lexicon is learned from labelled documents: words, and stems written
``stem*``, are added greedily while they explain toxic documents that the terms
so far do not, each toxic document weighing 1 and each clean one -3.  Its trie
is intersected with Levenshtein automata (one edit from five letters on, two
from nine, same first letter): sets of (trie node, edits) are the states of one
deterministic automaton, compiled when first met, which rejects most words
after two or three letters.

Every hit is judged in its window of six words: words of reporting there, or
quotation marks within two characters on both sides, make it a quotation, words
of address make it abuse.  A
logistic model over hits by kind and context gives the score.  Only labels of
rows with ``crc32(doc_id) mod 5 <> 0`` are learned from, at most TOXIC_ROWS and
CLEAN_ROWS of them (a bounded sample in hash order) and texts of at most
TRAIN_TEXT_BYTES; labels, lang, source and doc_id are no inputs of a score.  Of
the texts of one doc_id the smallest is learned from, and equal texts are one,
toxic if any is, so the model does not depend on the order of rows.

Null and empty texts get the model's score of no hit.  Without labelled rows
the seed lexicon and fixed weights are used.  Repeated rows are each scored.
Rows without a doc_id are scored too; nothing is learned from them, and whether
they are held out is null.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernel, work

TOXIC_ROWS, CLEAN_ROWS = 3000, 6000
WINDOW = 6
CLEAN_COST = 3
MIN_SUPPORT = 2
#: Toxic documents from which a word of no clean document is a term anyway.
SURE_SUPPORT = 8
STEMS = range(4, 11)
#: Bounds of the memo of words: how many, and of how many letters; longer ones are matched anew.
MEMO_WORDS, MEMO_LETTERS = 200_000, 64
#: Longer texts are not learned from, which bounds what the driver holds.
TRAIN_TEXT_BYTES = 1 << 15

#: Terms used where nothing can be learned.
SEED = ("idiot", "moron", "scum", "loser", "pathetic", "worthless", "disgusting", "stupid", "trash", "clown")

#: Words of reporting and of address around a hit.
REPORTING = frozenset("said says wrote quote quoted quoting called word words term dit écrit cite mot sagte schrieb zitat wort dijo escribió cita palabra".split())
ADDRESS = frozenset("you your yours you're u tu toi vous ton votre du dich dein ihr tú te eres usted vosotros".split())
QUOTES = "\"“”„«»‹›‘’"

WORD = re.compile(r"[^\W\d_]+")


class Automaton:
    """Deterministic automaton of a lexicon trie within bounded edits."""

    def __init__(self, terms):
        self.kids, self.end, self.stem = [{}], [0], [False]
        for term in terms:
            at = 0
            for c in term.rstrip("*"):
                if c not in self.kids[at]:
                    self.kids[at][c] = len(self.kids)
                    self.kids.append({})
                    self.end.append(0)
                    self.stem.append(False)
                at = self.kids[at][c]
            if term.endswith("*"):
                self.stem[at] = True
            else:
                self.end[at] = len(term)
        self.alphabet = {c for kids in self.kids for c in kids}
        self.states: list[frozenset] = []
        self.ids: dict[frozenset, int] = {}
        self.moves: list[dict[str, int]] = []
        self.kind: list[int] = []
        self.dead = self._state(frozenset())
        self.start = self._state(frozenset({(0, 0)}))
        self.memo: dict[str, int] = {}

    def _state(self, items: frozenset) -> int:
        got = self.ids.get(items)
        if got is None:
            got = self.ids[items] = len(self.states)
            self.states.append(items)
            self.moves.append({})
            exact = any(e == 0 and self.end[n] for n, e in items)
            near = any(e and self.end[n] >= (5 if e == 1 else 9) for n, e in items)
            self.kind.append(3 if any(e == 0 and self.stem[n] for n, e in items) else 1 if exact else 2 if near else 0)
        return got

    def _move(self, state: int, c: str) -> int:
        out: dict[int, int] = {}

        def add(node: int, edits: int) -> None:
            if edits <= 2 and edits < out.get(node, 3):
                out[node] = edits
                for kid in self.kids[node].values():
                    add(kid, edits + 1)

        for node, edits in self.states[state]:
            if c in self.kids[node]:
                add(self.kids[node][c], edits)
            if node:
                add(node, edits + 1)
                for kid in self.kids[node].values():
                    add(kid, edits + 1)
        return self._state(frozenset(out.items()))

    def match(self, word: str) -> int:
        """0 no term, 1 a term, 2 a misspelled term, 3 a stem's word."""
        state = self.start
        for c in word:
            c = c if c in self.alphabet else ""
            nxt = self.moves[state].get(c)
            if nxt is None:
                nxt = self.moves[state][c] = self._move(state, c)
            if nxt == self.dead:
                return 0
            state = nxt
            if self.kind[state] == 3:
                return 3
        return self.kind[state]

    def hits(self, words: list[str]) -> dict[str, int]:
        """Terms among distinct words, with their kinds."""
        memo, new = self.memo, set(words)
        if len(memo) > MEMO_WORDS:
            memo.clear()
        long = {w: self.match(w) for w in new if len(w) > MEMO_LETTERS}
        for w in new.difference(memo, long):
            memo[w] = self.match(w)
        return {w: k for w in new if (k := long[w] if w in long else memo[w])}


def features(text: str, machine: Automaton) -> list[float]:
    """Hits by kind and context: log counts, and the share of hit words."""
    low = text.lower()
    words = WORD.findall(low)
    found = machine.hits(words)
    counts = [0.0] * 5
    if found:
        spans = list(WORD.finditer(low))
        for i, w in enumerate(words):
            kind = found.get(w)
            if kind:
                counts[kind - 1] += 1
                around = words[max(0, i - WINDOW) : i + WINDOW + 1]
                left = low[max(0, spans[i].start() - 2) : spans[i].start()]
                right = low[spans[i].end() : spans[i].end() + 2]
                quoted = any(q in left for q in QUOTES) and any(q in right for q in QUOTES)
                if quoted or not REPORTING.isdisjoint(around):
                    counts[3] += 1
                if not ADDRESS.isdisjoint(around):
                    counts[4] += 1
    hits = sum(counts[:3])
    return [1.0, *np.log1p(counts).tolist(), float(hits > 0), min(1.0, 50 * hits / max(1, len(words)))]


def terms_of(text: str) -> set[str]:
    """Words of a text and the stems they begin with, written ``stem*``."""
    words = set(WORD.findall(text.lower()))
    out = {w for w in words if len(w) >= 3}
    out.update(w[:n] + "*" for w in words for n in STEMS if len(w) > n)
    return out


def learn_lexicon(texts: list[str], labels: np.ndarray) -> list[str]:
    """Greedy choice of words and stems that explain toxic documents.

    Terms are counted by hash first, so only those of two toxic documents or
    more are ever held as strings.
    """
    toxic = np.flatnonzero(labels == 1).tolist()
    hashes, times = np.unique(np.concatenate([np.fromiter(map(hash, terms_of(texts[i])), np.int64) for i in toxic]), return_counts=True)
    often = set(hashes[times >= MIN_SUPPORT].tolist())
    owners: dict[str, list[int]] = {}
    for i in toxic:
        for t in terms_of(texts[i]):
            if hash(t) in often:
                owners.setdefault(t, []).append(i)
    clean: dict[str, int] = {}
    for i in np.flatnonzero(labels != 1).tolist():
        for t in terms_of(texts[i]):
            if t in owners:
                clean[t] = clean.get(t, 0) + 1
    open_ = set(toxic)
    pool = {t: set(v) for t, v in owners.items() if len(v) > CLEAN_COST * clean.get(t, 0)}
    out = []
    while pool:
        gain = {t: len(v) - CLEAN_COST * clean.get(t, 0) for t, v in pool.items()}
        best = max(gain, key=lambda t: (gain[t], not t.endswith("*"), -len(t), t))
        if gain[best] < MIN_SUPPORT:
            break
        out.append(best)
        open_ -= pool.pop(best)
        pool = {t: v & open_ for t, v in pool.items() if gain[t] >= MIN_SUPPORT}
    stems = tuple(t[:-1] for t in out if t.endswith("*"))
    sure = [t for t, v in owners.items() if len(v) >= SURE_SUPPORT and not clean.get(t, 0) and not t.endswith("*") and not t.startswith(stems)]
    return out + sorted(t for t in set(sure).difference(out) if not _copies(terms_of(texts[i]) for i in owners[t]))


def _copies(docs: Iterable[set[str]]) -> bool:
    """Whether the pairs of all term sets share over half of their terms on the
    whole: then a term of them says nothing alone.  The shared terms of all pairs
    are known from how many sets hold each term."""
    held, n, sizes = Counter(), 0, 0
    for terms in docs:
        held.update(terms)
        n, sizes = n + 1, sizes + len(terms)
    shared = sum(k * (k - 1) // 2 for k in held.values())
    return 2 * shared > (n - 1) * sizes - shared


def learn_weights(x: np.ndarray, y: np.ndarray) -> list[float]:
    """Ridge logistic regression by Newton steps."""
    w = np.zeros(x.shape[1])
    ridge = np.diag([1e-6] + [1.0] * (x.shape[1] - 1))
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + ridge @ w
        hess = (x * (p * (1 - p))[:, None]).T @ x + ridge
        step = np.linalg.solve(hess + 1e-9 * np.eye(len(w)), grad)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w.tolist()


def _remainder(doc_id):
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5))


def train(docs: DataFrame, labels: DataFrame) -> tuple[list[str], list[float]]:
    """(lexicon, weights) from a bounded sample of rows that are not held out."""
    own = labels.where("doc_id is not null and toxic is not null").where(_remainder(F.col("doc_id")) != 0).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    picked = [own.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for y, n in ((1, TOXIC_ROWS), (0, CLEAN_ROWS))]
    picked = F.broadcast(picked[0].union(picked[1]))
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).where(F.octet_length("text") <= TRAIN_TEXT_BYTES)
    rows = texts.join(picked, "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")).select("text", "toxic")
    # a partition at a time: the JVM never holds the sample whole
    model = _learned(rows.toLocalIterator())
    work.trim()
    return model


def _learned(rows: Iterable) -> tuple[list[str], list[float]]:
    """(lexicon, weights) from rows (text, toxic) in any order."""
    marks: dict[str, float] = {}
    for text, toxic in rows:
        marks[text] = max(marks.get(text, 0.0), float(toxic))
    texts = sorted(marks, key=lambda t: (hash_text(t), t))
    y = np.array([marks[t] for t in texts])
    if not len(y) or y.min() == y.max():
        return list(SEED), [-4.0, 2.0, 1.0, 2.0, -1.0, 0.5, 3.0, 0.0]
    terms = learn_lexicon(texts, y) or list(SEED)
    machine = Automaton(terms)
    return terms, learn_weights(np.array([features(t, machine) for t in texts]), y)


def hash_text(text: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(text.encode())


def score(docs: DataFrame, model: tuple[list[str], list[float]]) -> DataFrame:
    """(doc_id, score) of every document."""
    terms, weights = model

    def run(batches):
        machine = kernel.cached(("lexicon", tuple(terms)), lambda: Automaton(terms))
        w = np.array(weights)
        for batch in batches:
            x = np.array([features(t.as_py() or "", machine) for t in batch.column("text")]).reshape(-1, len(w))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(1 / (1 + np.exp(-np.clip(x @ w, -30, 30))))], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(work.tidy(run), "doc_id long, score double")


def reject(docs: DataFrame, model: tuple[list[str], list[float]], least: float = 0.5) -> DataFrame:
    """Documents whose score is below ``least``, with all columns."""
    terms, weights = model

    def run(batches):
        machine = kernel.cached(("lexicon", tuple(terms)), lambda: Automaton(terms))
        w = np.array(weights)
        for batch in batches:
            x = np.array([features(t.as_py() or "", machine) for t in batch.column("text")]).reshape(-1, len(w))
            yield batch.filter(pa.array(1 / (1 + np.exp(-np.clip(x @ w, -30, 30))) < least))

    return docs.mapInArrow(work.tidy(run), docs.schema)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = work.table(spark, sf_dir, "documents")
    got = score(docs, train(docs, work.table(spark, sf_dir, "labels")))
    return got.select("doc_id", (_remainder(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
