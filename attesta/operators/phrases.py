"""Dictionaries and quotes in texts: terms by one automaton, quotes by their rarest window of words."""

from __future__ import annotations

import hashlib
import re
import sys
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.functions.text import matched_terms
from attesta.session import small_batches, written

#: Bytes of the terms of one automaton, automata at most (beyond these n-grams are joined), bits of the map of
#: wanted windows, words of a window, quotes that are looked up in a text at a time, and words whose hashes a task keeps.
AUTOMATON_BYTES, AUTOMATA, MAP_BITS, WINDOW, LOOKUPS, KNOWN_WORDS = 8 << 20, 16, 1 << 26, 3, 1000, 1 << 16
WORD = re.compile(r"\w+")


def _normal(text: str) -> str:
    return " ".join(unicodedata.normalize("NFKC", text).casefold().split())


def _automaton(terms: list[str], as_written=str):
    """The automaton of the terms' forms, or None without any; compiled once a worker."""
    import ahocorasick

    kept = sys.__dict__.setdefault("_attesta_automata", {})
    name = as_written.__name__ + hashlib.sha256("\n".join(terms).encode()).hexdigest()
    if name not in kept:
        kept.clear()
        made = ahocorasick.Automaton()
        said: dict[str, list[str]] = {}
        for t in terms:
            said.setdefault(as_written(t), []).append(t)
        for key, own in said.items():
            if key:
                made.add_word(key, (key, own))
        made.make_automaton()
        kept[name] = made if len(made) else None
    return kept[name]


def _held(text: str, terms, words: bool) -> set[str]:
    """Terms of the automaton that a text holds."""
    if words:
        return {key[1:-1] for _, (key, _) in terms.iter(f" {' '.join(WORD.findall(text.lower()))} ")}
    text = _normal(text)
    inside = lambda i: 0 <= i < len(text) and WORD.match(text[i]) is not None
    return {t for end, (key, own) in terms.iter(text) if not inside(end + 1) and not inside(end - len(key)) for t in own}


def dictionary_matches(docs: DataFrame, text: str, terms: DataFrame, term: str, words: bool = True, keep: list[str] | None = None) -> DataFrame:
    """Documents joined with the terms of a table that they hold, each once; of the documents' columns all, or ``keep``.

    With ``words``, terms are lower-case words with single blanks, and are held where these words follow
    each other with any marks between.  Without, terms are any strings,
    held where the normalised text (see ``text.normalized``) has their normalised form and no word goes on at either end.  Terms have any length and script; null and empty ones are in no text.

    The terms' automaton goes to the texts, which are not shuffled.  A dictionary of over AUTOMATON_BYTES is
    parted by first letters, an automaton and a pass over the texts each; one of words of over AUTOMATA such parts joins n-grams.
    """
    terms = terms.select(F.col(term)).where(F.col(term).isNotNull() & (F.trim(term) != "")).distinct()
    size, longest = terms.agg(F.sum(F.octet_length(term) + 8), F.max(F.size(F.split(term, " ")))).first()
    parts = max(1, -(-(size or 0) // AUTOMATON_BYTES))
    if words and parts > AUTOMATA:
        return matched_terms(docs, text, terms, term, longest).select(*(docs.columns if keep is None else keep), term)
    small_batches(docs.sparkSession)
    names = docs.columns if keep is None else keep
    kinds = ", ".join(f"`{c}` {t}" for c, t in docs.select(*names).dtypes)
    out = None
    for n in range(parts):
        mine = terms.where(F.pmod(F.xxhash64(F.substring(term, 1, 2)), F.lit(parts)) == n)
        # a part's terms, of a checked size, go to the workers with the function
        listed = sorted(f" {r[0]} " if words else r[0] for r in mine.collect())

        def run(batches, listed=listed):
            made = _automaton(listed, str if words else _normal)
            for batch in batches:
                row, found = [], []
                for i, t in enumerate(batch.column(text).to_pylist() if made else []):
                    held = _held(t, made, words) if t else ()
                    row += [i] * len(held)
                    found += sorted(held)
                part = batch.select(names).take(pa.array(row, pa.int64()))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, pa.string())], names=[*names, term])

        got = docs.mapInArrow(run, f"{kinds}, `{term}` string")
        out = got if out is None else out.union(got)
    return out


def _windows(words: list[str], known: dict[str, int]) -> np.ndarray:
    """Hashes of all WINDOW following words, rolled over the hashes of the words without case.

    ``known`` keeps the words' hashes from text to text.
    """
    if len(known) > KNOWN_WORDS:
        known.clear()
    for w in set(words).difference(known):
        known[w] = int.from_bytes(hashlib.blake2b(w.casefold().encode(errors="surrogatepass"), digest_size=8).digest(), "little")
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    n = len(h) - WINDOW + 1
    if n < 1:
        return np.zeros(0, np.int64)
    out = np.zeros(n, np.uint64)
    for k in range(WINDOW):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n]
    return (out ^ (out >> np.uint64(31))).view(np.int64)


def folded(text: str) -> list[str]:
    return [w.casefold() for w in WORD.findall(text)]


def _index(texts: DataFrame, inner: int, wanted: np.ndarray | None) -> DataFrame:
    """(id, window) of rows (id, text), each once; without ``inner`` words at both ends, and only what the map may want."""
    kind = dict(texts.dtypes)["id"]

    def run(batches):
        known: dict[str, int] = {}
        for batch in batches:
            ids, parts = [], [np.zeros(0, np.int64)]
            for i, t in enumerate(batch.column("text").to_pylist()):
                words = WORD.findall(t) if t else []
                found = _windows(words[inner : len(words) - inner], known)
                if wanted is not None:
                    at = found & (len(wanted) * 64 - 1)
                    found = found[(wanted[at >> 6] >> (at & 63)) & 1 == 1]
                found = np.unique(found)
                ids += [i] * len(found)
                parts.append(found)
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(ids, pa.int64())), pa.array(np.concatenate(parts), pa.int64())], names=["id", "window"])

    return texts.mapInArrow(run, f"id {kind}, window long")


def candidates(quotes: DataFrame, sources: DataFrame, *inner: int) -> DataFrame:
    """(quote, source) ids of the sources that hold the quote's rarest window of words.

    quotes and sources are (id, text).  A map of the quotes' windows, of bounded size, goes to
    the sources; what passes is the index, which holds no texts.  Of several ``inner`` each has its
    pairs, from one reading of the sources.
    """
    asked = None
    for n in inner:
        some = _index(quotes, n, None).withColumn("inner", F.lit(n))
        asked = some if asked is None else asked.union(some)
    asked = written(asked, "asked")
    n = asked.count()
    size = 1 << max(12, min(MAP_BITS, 16 * n).bit_length() - 1)
    bit = F.col("window").bitwiseAND(F.lit(size - 1))
    cells = asked.groupBy(F.shiftright(bit, 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(window & 63 as int))")).alias("bits"))
    wanted = np.zeros(size >> 6, np.int64)
    for r in cells.toLocalIterator():  # no more than MAP_BITS bits
        wanted[r.at] = r.bits
    index = written(_index(sources, 0, wanted), "windows")
    counts = index.groupBy("window").agg(F.count("*").alias("n"))
    told = asked.join(counts, "window", "left")
    rarest = told.groupBy("id", "inner").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "window")).alias("r")).where("r.n > 0")
    rarest = rarest.select(F.col("id").alias("quote"), F.col("r.window").alias("window")).distinct()
    return rarest.join(index.withColumnRenamed("id", "source"), "window").select("quote", "source")


def _verified(pairs: DataFrame, quotes: DataFrame, sources: DataFrame, test, schema: str, names: list[str]) -> DataFrame:
    """(quote, source, ...) of the pairs that ``test(quote, its words, text, its words)`` has a row for.

    A text is fetched once for LOOKUPS of its quotes or so.
    """
    pairs = written(pairs, "pairs")
    most = pairs.groupBy("source").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    chunk = F.pmod(F.xxhash64("quote"), F.lit(max(1, -(-most // LOOKUPS))))
    told = pairs.join(quotes.select(F.col("id").alias("quote"), F.col("text").alias("said")), "quote")
    told = told.groupBy("source", chunk.alias("chunk")).agg(F.collect_list(F.struct("quote", "said")).alias("asked"))
    rows = told.join(sources.select(F.col("id").alias("source"), "text"), "source").select("source", "asked", "text")
    kinds = dict(pairs.dtypes)

    def run(batches):
        for batch in batches:
            found: list[dict] = []
            for source, asked, text in zip(*(c.to_pylist() for c in batch.columns)):
                spans = [(m.group().casefold(), m.start(), m.end()) for m in WORD.finditer(text)]
                words = [w for w, _, _ in spans]
                where: dict[str, list[int]] = {}
                for i, w in enumerate(words):
                    where.setdefault(w, []).append(i)
                for q in asked:
                    row = test(q["said"], text, spans, words, where)
                    if row is not None:
                        found.append({"quote": q["quote"], "source": source, **dict(zip(names, row))})
            yield pa.RecordBatch.from_pylist(found, arrow)

    whole = f"quote {kinds['quote']}, source {kinds['source']}, {schema}"
    arrow = pa.schema([(f.name, _arrow(f.dataType.simpleString())) for f in sources.sparkSession.createDataFrame([], whole).schema.fields])
    return rows.mapInArrow(run, whole)


def _arrow(kind: str) -> pa.DataType:
    return {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}[kind]


def _repair(said, text, spans, words, where):
    want = folded(said)
    n = len(want)
    if said and said in text:
        at = text.index(said)
        return at, said, True
    rare = min(range(n), key=lambda k: len(where.get(want[k], ()))) if n >= WINDOW else 0
    for i in where.get(want[rare], ()) if n >= WINDOW else ():
        if i >= rare and words[i - rare : i - rare + n] == want:
            return spans[i - rare][1], text[spans[i - rare][1] : spans[i - rare + n - 1][2]], False
    return None


def repaired_quotes(quotes: DataFrame, sources: DataFrame) -> DataFrame:
    """(quote, source, start, repaired, exact) of quotes (id, text) in sources (id, text), whose ids are whole numbers or strings.

    A quote is where it stands as it is, or where its words, three or more, follow each other with any marks between
    and in any case; ``repaired`` is the source's own wording there, at its first place.  Quotes of fewer words, of which exact ones are left to
    ``grounded_quotes``, and null texts give no row.
    """
    q, s = quotes.where("id is not null and text is not null"), sources.where("id is not null and text is not null")
    # words in the middle of an exact quote are whole words of its source, all words of another are
    pairs = candidates(q, s, 0, 1).distinct()
    return _verified(pairs, q, s, _repair, "start long, repaired string, exact boolean", ["start", "repaired", "exact"])


def grounded_quotes(quotes: DataFrame, sources: DataFrame) -> DataFrame:
    """(quote, source) of the quotes that are exact parts of sources; empty and null ones are in none.

    Quotes of five words or more meet texts by windows of their inner words, shorter ones, of all kinds of marks, by an automaton over the texts.
    """
    q, s = quotes.where("id is not null and text <> ''"), sources.where("id is not null and text is not null")
    size = F.size(F.regexp_extract_all(F.col("text"), F.lit(r"[\p{L}\p{N}_]+"), 0))
    long_, short = q.where(size >= WINDOW + 4), q.where(size < WINDOW + 4)
    found = _verified(candidates(long_, s, 1), long_, s, lambda said, text, *_: (True,) if said in text else None, "exact boolean", ["exact"])
    return found.select("quote", "source").union(_short(short, s))


def _short(quotes: DataFrame, sources: DataFrame) -> DataFrame:
    """(quote, source) of short quotes, by automata of AUTOMATON_BYTES of them."""
    kinds = dict(quotes.dtypes)["id"], dict(sources.dtypes)["id"]
    texts = quotes.select("text").distinct()
    parts = max(1, -(-(texts.agg(F.sum(F.octet_length("text") + 8)).first()[0] or 0) // AUTOMATON_BYTES))
    out = None
    for n in range(parts):
        listed = sorted(r[0] for r in texts.where(F.pmod(F.xxhash64("text"), F.lit(parts)) == n).collect())

        def run(batches, listed=listed):
            made = _automaton(listed)
            for batch in batches:
                row, found = [], []
                for i, t in enumerate(batch.column("text").to_pylist() if made else []):
                    held = sorted({x for _, (x, _) in made.iter(t)})
                    row += [i] * len(held)
                    found += held
                yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(row, pa.int64())), pa.array(found, pa.string())], names=["source", "said"])

        got = sources.select("id", "text").mapInArrow(run, f"source {kinds[1]}, said string")
        out = got if out is None else out.union(got)
    return out.join(quotes.select(F.col("id").alias("quote"), F.col("text").alias("said")), "said").select("quote", "source")
