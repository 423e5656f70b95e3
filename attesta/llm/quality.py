"""Quality rules, line first.

Every line with a word is judged by itself; failing lines are removed, and a
document that loses too much of its text is rejected.  Line rules:

* punctuation: over a quarter of the line's characters are symbols of
  ``[#*$%&|<>]``; at least half as many ``!`` as words in a line of five words
  or more; the line breaks off in an ellipsis; or it has 30 words or more and no
  mark of punctuation at all;
* navigation: separators (``|`` anywhere, or one of ``/ > » › • ·`` standing
  alone) that are two or more and a third of the words, or three or more and a
  quarter; web addresses that make up half of the line; or a menu, that is four
  or more lines in a row, of three words at most each (bullets and separators
  not counted), none of which ends in a mark;
* boilerplate: a line equal to an earlier one, or one that holds a phrase of
  the boilerplate list (cookie notices, script warnings, rights and the like in
  the languages of the documents).

A line without a mark at its end does not fail by that alone: headings have none.
Lines without a word neither count nor part the lines of a menu.

Ahead of it stand document figures: characters in words, symbols, repeated
lines, and words in 5-word windows that occur twice or more.  Everything is
computed from the bytes of a batch at once.

Null and empty texts have no words, fail the base rule and are not kept.
Repeated rows are each judged.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import kernel, work

MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
MAX_LOST_PERCENT = 50

ELLIPSIS_BYTES = 3
UNMARKED_WORDS = 30
MENU_LINES, MENU_WORDS = 4, 3

#: Phrases of boilerplate lines, A-Z in lower case; lines are compared likewise.
BOILERPLATE = (
    # English
    "accept all cookies",
    "all rights reserved",
    "back to top",
    "click here to",
    "cookie policy",
    "enable javascript",
    "log in to comment",
    "privacy policy",
    "share this article",
    "sign up for our newsletter",
    "skip to content",
    "subscribe to our newsletter",
    "terms of use",
    "this site uses cookies",
    "we use cookies",
    # German
    "alle cookies akzeptieren",
    "alle rechte vorbehalten",
    "diese website verwendet cookies",
    "hier klicken, um",
    "javascript aktivieren",
    "newsletter abonnieren",
    "nutzungsbedingungen",
    "wir verwenden cookies",
    "zum inhalt springen",
    # French
    "accepter tous les cookies",
    "activer javascript",
    "ce site utilise des cookies",
    "cliquez ici pour",
    "inscrivez-vous à notre newsletter",
    "mentions légales",
    "nous utilisons des cookies",
    "politique de confidentialité",
    "tous droits réservés",
    # Spanish
    "aceptar todas las cookies",
    "aviso legal",
    "este sitio utiliza cookies",
    "haga clic aquí para",
    "política de privacidad",
    "suscríbete a nuestro boletín",
    "términos de uso",
    "todos los derechos reservados",
    "utilizamos cookies",
)
#: Words that separate the items of a navigation line, and those that may also lead one.
SEPARATORS = "/>»›•·"
BULLETS = SEPARATORS + "|-*–—"
#: Marks of punctuation, and what may close a sentence after or in place of one.
MARKS = ".,;:!?…。！？、，；：؟،।"
CLOSERS = "\"')]}»”’"
PHRASES = tuple(p.encode() for p in BOILERPLATE)
LINKS = (b"http://", b"https://", b"www.")


def _flag(chars: bytes) -> np.ndarray:
    t = np.zeros(256, bool)
    t[list(chars)] = True
    return t


SYMBOL, BANG, PIPE = _flag(b"#*$%&|<>"), _flag(b"!"), _flag(b"|")


def _ends_of(buf: np.ndarray, chars: str) -> np.ndarray:
    """Flags of the last bytes of the given characters."""
    out = np.zeros(256, bool)
    out[[ord(c) for c in chars if c.isascii()]] = True
    out = out[buf]
    for c in chars:
        if not c.isascii():
            _mark(out, buf, c.encode(), True)
    return out


def _mark(out: np.ndarray, buf: np.ndarray, seq: bytes, last: bool) -> None:
    """Set flags at the first or last byte of every place of ``seq``."""
    n = len(buf) - len(seq) + 1
    if n > 0:
        at = np.flatnonzero(buf[:n] == seq[0])
        for j in range(1, len(seq)):
            at = at[buf[at + j] == seq[j]]
        out[at + (len(seq) - 1 if last else 0)] = True


def _starts(buf: np.ndarray, seq: bytes) -> np.ndarray:
    out = np.zeros(len(buf), bool)
    _mark(out, buf, seq, False)
    return out


def _single(buf: np.ndarray, start: np.ndarray, end: np.ndarray, chars: str) -> np.ndarray:
    """Which words are one of the given characters alone."""
    out, size = np.zeros(len(start), bool), end - start
    for c in chars:
        seq = c.encode()
        at = np.flatnonzero(size == len(seq))
        for j, byte in enumerate(seq):
            at = at[buf[start[at] + j] == byte]
        out[at] = True
    return out


def _links(low: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which words are web addresses; ``low`` is in lower case."""
    out = np.zeros(len(start), bool)
    for seq in LINKS:
        at = np.flatnonzero(end - start >= len(seq))
        for j, byte in enumerate(seq):
            at = at[low[start[at] + j] == byte]
        out[at] = True
    return out


def _runs(flags: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Length of the run of set flags within a row that each place is in, else 0."""
    if not len(flags):
        return np.zeros(0, np.int64)
    new = np.ones(len(flags), bool)
    new[1:] = (flags[1:] != flags[:-1]) | (row[1:] != row[:-1])
    run = np.cumsum(new) - 1
    return np.where(flags, np.bincount(run)[run], 0)


def _within(flags: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Set flags in each span."""
    total = np.concatenate((np.zeros(1, np.int64), np.cumsum(flags, dtype=np.int64)))
    return total[end] - total[start]


def _twice(row: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(occurs twice or more in its row, is not the row's first of its kind)."""
    key = kernel.mix(h + kernel.mix(row.astype(np.uint64) + np.uint64(0x5851F42D4C957F2D)))
    order = np.argsort(key, kind="stable")
    k = key[order]
    same = np.zeros(len(k) + 1, bool)
    same[1:-1] = k[1:] == k[:-1]
    both, later = np.empty(len(k), bool), np.empty(len(k), bool)
    both[order] = same[1:] | same[:-1]
    later[order] = same[:-1]
    return both, later


def figures(buf: np.ndarray, offs: np.ndarray) -> dict[str, np.ndarray]:
    """Document figures and the method's verdict for the texts of one slice."""
    n = len(offs) - 1
    start, end, row = kernel.words(buf, offs)
    lead = (buf & 0xC0) != 0x80
    by_row = lambda at, weight=None: np.bincount(at, weight, minlength=n).astype(np.int64)
    out = {"n_words": by_row(row), "word_chars": by_row(row, _within(lead, start, end)), "n_symbols": _within(SYMBOL[buf], offs[:-1], offs[1:])}
    h = kernel.span_hash(buf, start, end)
    win, at = kernel.windows(h, row)
    again = np.zeros(len(row) + kernel.SHINGLE, np.int64)
    if len(win):
        hit = at[_twice(row[at], win)[0]]
        np.add.at(again, hit, 1)
        np.add.at(again, hit + kernel.SHINGLE, -1)
    out["n_repeat_words"] = by_row(row[np.cumsum(again)[: len(row)] > 0])

    cuts = np.flatnonzero(buf == 10)
    begin = np.unique(np.concatenate((offs[:-1], cuts + 1)))
    begin = begin[begin < len(buf)]
    stop = np.minimum(np.append(begin[1:], len(buf)), len(buf))
    line = np.searchsorted(begin, start, "right") - 1
    words = np.bincount(line, minlength=len(begin))
    mine = words > 0
    begin, stop, words = begin[mine], stop[mine], words[mine]
    lrow = np.searchsorted(offs, begin, "right") - 1
    body = stop - (buf[stop - 1] == 10) if len(stop) else stop
    dup = _twice(lrow, kernel.span_hash(buf, begin, body))[1] if len(begin) else np.zeros(0, bool)
    out["n_dup_lines"] = by_row(lrow[dup])

    chars = _within(lead & ~kernel.SPACE[buf], begin, body)
    low = kernel.LOWER[buf]
    last = np.cumsum(words) - 1  # the last word of each line
    per_line = lambda of: np.add.reduceat(of, last + 1 - words, dtype=np.int64) if len(words) else np.zeros(0, np.int64)
    marks = _ends_of(buf, MARKS)
    closed = (marks | _ends_of(buf, CLOSERS))[end[last] - 1] if len(words) else np.zeros(0, bool)

    punctuation = 4 * _within(SYMBOL[buf], begin, body) > chars
    punctuation |= (words >= 5) & (2 * _within(BANG[buf], begin, body) >= words)
    punctuation |= (words >= UNMARKED_WORDS) & (_within(marks, begin, body) == 0)
    if len(words):
        tail = end[last] - ELLIPSIS_BYTES  # "..." and the one character have three bytes each
        tail = np.where(tail >= start[last], tail, 0)
        punctuation |= (end[last] - start[last] >= ELLIPSIS_BYTES) & (_starts(buf, b"...")[tail] | _starts(buf, "…".encode())[tail])

    seps = _within(PIPE[buf], begin, body) + per_line(_single(buf, start, end, SEPARATORS))
    navigation = ((seps >= 3) & (4 * seps >= words)) | ((seps >= 2) & (3 * seps >= words))
    navigation |= 2 * per_line(np.where(_links(low, start, end), _within(lead, start, end), 0)) >= np.maximum(chars, 1)
    short = ~closed & (words - per_line(_single(buf, start, end, BULLETS)) <= MENU_WORDS)
    navigation |= _runs(short, lrow) >= MENU_LINES

    boilerplate, raw = dup.copy(), low.tobytes()
    for phrase in PHRASES:
        p = raw.find(phrase)
        while p >= 0:
            k = int(np.searchsorted(begin, p, "right")) - 1
            if k >= 0 and p + len(phrase) <= body[k]:
                boilerplate[k] = True
            p = raw.find(phrase, p + 1)
    bad = punctuation | navigation | boilerplate
    for name, of in (("punctuation", punctuation), ("navigation", navigation), ("boilerplate", boilerplate)):
        out[f"n_{name}_lines"] = by_row(lrow[of])
    out["lost_chars"] = by_row(lrow[bad], chars[bad]) if len(lrow) else np.zeros(n, np.int64)
    out["base_failed"] = (out["n_words"] < MIN_WORDS) | (100 * out["n_repeat_words"] > MAX_REPEAT_PERCENT * out["n_words"])
    out["kept"] = ~out["base_failed"] & (100 * out["lost_chars"] <= MAX_LOST_PERCENT * out["word_chars"])
    out["line_bad"], out["line_at"] = bad, np.stack((begin, body), 1) if len(begin) else np.zeros((0, 2), np.int64)
    return out


COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lost_chars", "n_punctuation_lines", "n_navigation_lines", "n_boilerplate_lines")


def judge(docs: DataFrame) -> DataFrame:
    """Figures and verdict of every document."""

    def run(batches):
        for batch in batches:
            buf, offs = kernel.column_bytes(batch.column("text"))
            for a, b in kernel.slices(offs):
                got = figures(buf[offs[a] : offs[b]], offs[a : b + 1] - offs[a])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), *(pa.array(got[c]) for c in COLUMNS)], ["doc_id", *COLUMNS])

    types = ", ".join(f"{c} {'boolean' if c in ('base_failed', 'kept') else 'long'}" for c in COLUMNS)
    return docs.select("doc_id", "text").mapInArrow(work.tidy(run), f"doc_id long, {types}")


def clean(docs: DataFrame) -> DataFrame:
    """Kept documents with their failing lines removed, all columns kept."""

    def run(batches):
        for batch in batches:
            buf, offs = kernel.column_bytes(batch.column("text"))
            at = batch.schema.get_field_index("text")
            for a, b in kernel.slices(offs):
                part, own = buf[offs[a] : offs[b]], offs[a : b + 1] - offs[a]
                got = figures(part, own)
                live = np.ones(len(part), bool)
                for lo, hi in got["line_at"][got["line_bad"]].tolist():
                    live[lo : min(hi + 1, len(part))] = False
                texts = [part[lo:hi][live[lo:hi]].tobytes().decode() for lo, hi in zip(own[:-1].tolist(), own[1:].tolist())]
                rows = batch.slice(a, b - a)
                rows = rows.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))
                yield rows.filter(pa.array(got["kept"]))

    return docs.mapInArrow(work.tidy(run), docs.schema)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(work.table(spark, sf_dir, "documents"))
