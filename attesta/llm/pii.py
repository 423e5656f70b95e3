"""Personal data: proposals by pattern, confirmation by checksum, context score.

Built from DataFrame functions only.  A pattern's matches are found with their
places by one expression: ``\\G(gap)(pattern)``, where the gap skips runs that
cannot begin a match and is possessive, so a text is read once however long it
is; places are running sums of the lengths of what was skipped and matched.

Kinds of the base, leftmost and without overlap within a kind: email; ip with
parts of at most 255; card of 13 to 19 digits with a right Luhn sum; phone of 9
to 15 digits.  A match that fails its test is dropped without another try.
The method adds two kinds:

* iban: two letters, two check digits, then letters or digits up to the
  country's length, or 11 to 30 for other countries, in groups or not, whose
  mod-97 remainder is 1 (score 0.9);
* national_phone: digit groups without ``+`` and 9 to 11 digits (score 0.3).

A context word within 40 characters before or 20 after the match adds 0.4, a
word of numbering (order, invoice, ...) takes 0.4; spans of 0.6 or more stay.

Null and empty texts have no spans.  Rows are independent, repeated ones too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import work

# The patterns, those of the base with possessive loops (nothing
# after a loop could use what it gives back), and the runs that cannot begin a match.
EMAIL = r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Length and the countries whose account numbers have it.
IBAN_SIZES = {
    15: "NO",
    16: "BE",
    18: "DK FI FK FO GL NL SD",
    19: "MK SI",
    20: "AT BA EE KZ LT LU MN XK",
    21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL",
    24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "LY PT ST",
    26: "IS TR",
    27: "BI DJ FR GR IT MC MR SM",
    28: "AL AZ BY CY DO GT HN HU LB NI PL SV",
    29: "BR EG PS QA UA",
    30: "JO KW MU YE",
    31: "MT SC",
    32: "LC",
    33: "RU",
}
_COUNTRY = "|".join(c for codes in IBAN_SIZES.values() for c in codes.split())
_OWN_SIZE = "|".join(rf"(?:{codes.replace(' ', '|')})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{size - 4}}}" for size, codes in IBAN_SIZES.items())
# Loops before a lookahead give back: what follows a number may look like its next group.
IBAN = rf"(?<![A-Za-z0-9])(?:{_OWN_SIZE}|(?!{_COUNTRY})[A-Z]{{2}}[0-9]{{2}}(?:(?!\x20(?:{_COUNTRY})[0-9]{{2}})\x20?[A-Z0-9]){{11,30}})(?![A-Za-z0-9])"
NATIONAL = r"(?<![+0-9A-Za-z.-])\(?0[0-9]{1,4}\)?(?:[\x20./-][0-9]{2,4}){2,4}(?![.-]?[0-9A-Za-z])"
PATTERNS = {
    "email": (EMAIL, r"(?:[^A-Za-z0-9._%+-]++|(?!{p})[A-Za-z0-9._%+-]++)*+"),
    "ip": (IP, r"(?:[^0-9]++|(?!{p})[0-9]++)*+"),
    "card": (CARD, r"(?:[^0-9]++|(?!{p})[0-9])*+"),
    "phone": (PHONE, r"(?:[^+]++|(?!{p})\+)*+"),
    "iban": (IBAN, r"(?:[^A-Z]++|(?!{p})[A-Z])*+"),
    "national_phone": (NATIONAL, r"(?:[^0(]++|(?!{p})[0(])*+"),
}
BASE = ("email", "ip", "card", "phone")
#: What a text must hold for a kind's search to run at all.
NEEDS = {"email": "@", "phone": "+"}
#: Context words of the added kinds.
FOR = {"iban": r"\b(?:iban|account|bank|konto|compte|cuenta)\b", "national_phone": r"\b(?:tel|phone|call|mobile|fax|telefon|téléphone|teléfono)\b"}
AGAINST = r"\b(?:order|invoice|isbn|serial|version|ticket|bestellung|commande|pedido)\b"
SCORE = {"iban": 0.9, "national_phone": 0.3}
STEP, LEAST, BEFORE, AFTER = 0.4, 0.6, 40, 20
#: Elements that a fold gathers in one list, and code points of a piece of a text.
GROUP, PIECE = 256, 4096


def bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def grouped(items: Column) -> Column:
    """An array as arrays of GROUP of its elements, so that a fold copies short lists only."""
    last = F.floor((F.size(items) - 1) / GROUP).cast("int")
    groups = F.transform(F.sequence(F.lit(0), last), lambda g: F.slice(items, g * GROUP + 1, F.lit(GROUP)))
    return F.when(F.size(items) > 0, groups).otherwise(F.array())


def matches(text: Column, kind: str) -> Column:
    """array<struct<start,end,match>> of a kind's matches, in code points; work is linear in text and matches."""
    pattern, gap = PATTERNS[kind]
    gap = gap.replace("{p}", pattern)
    both = F.regexp_extract_all(text, F.lit(rf"\G({gap})({pattern})"), 0)
    whole = F.transform(both, lambda e: F.struct(F.char_length(e).alias("size"), F.regexp_extract(e, rf"^(?:{gap})({pattern})$", 1).alias("match")))

    def add(acc: Column, e: Column) -> Column:
        end = acc["at"] + e["size"]
        span = F.struct((end - F.char_length(e["match"])).alias("start"), end.alias("end"), e["match"].alias("match"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

    def told(group: Column, start: Column) -> Column:
        zero = F.struct(start.alias("at"), F.array().cast("array<struct<start:int,end:int,match:string>>").alias("out"))
        return F.aggregate(group, zero, add, lambda acc: acc["out"])

    def starts(groups: Column) -> Column:
        sizes = F.transform(groups, lambda g: F.aggregate(g, F.lit(0), lambda n, e: n + e["size"]))
        return F.aggregate(sizes, F.array(F.lit(0)), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))

    spans_of = lambda groups: F.flatten(F.zip_with(groups, F.slice(starts(groups), F.lit(1), F.size(groups)), told))
    found = bound(whole, lambda w: F.when(F.size(w) > 0, bound(grouped(w), spans_of)).otherwise(F.array().cast("array<struct<start:int,end:int,match:string>>")))
    need = text.contains(NEEDS[kind]) if kind in NEEDS else text.rlike("[0-9]")
    return F.when(need, found).otherwise(F.array().cast("array<struct<start:int,end:int,match:string>>"))


def pieces(text: Column) -> Column:
    """A text in pieces of PIECE code points: parts of it are found without counting from its start."""
    return F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{PIECE}}}"), 0)


def part(parts: Column, start: Column, end: Column) -> Column:
    """The code points from start to before end of the text that ``pieces`` are of."""
    i, j = F.floor(start / PIECE).cast("int"), F.floor(end / PIECE).cast("int")
    piece = lambda n: F.coalesce(F.get(parts, n), F.lit(""))
    same = F.substring(piece(i), start - i * PIECE + 1, end - start)
    between = F.array_join(F.slice(parts, i + 2, F.greatest(j - i - 1, F.lit(0))), "")
    return F.when(end <= start, "").when(i == j, same).otherwise(F.concat(F.substring(piece(i), start - i * PIECE + 1, F.lit(PIECE)), between, F.substring(piece(j), F.lit(1), end - j * PIECE)))


def digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def octets_fit(match: Column) -> Column:
    part = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
    return match.rlike(rf"^{part}\.{part}\.{part}\.{part}$")


def luhn(match: Column) -> Column:
    """13 to 19 digits with a right Luhn sum."""
    d = digits(match)
    padded = F.lpad(d, 19, "0")
    total = F.lit(0)
    for i in range(19):
        c = F.substring(padded, 19 - i, 1)
        total = total + (F.translate(c, "0123456789", "0246813579") if i % 2 else c).cast("int")
    size = F.char_length(d)
    return F.when(size.between(13, 19), total % 10 == 0).otherwise(F.lit(False))


def mod97(match: Column) -> Column:
    """Right mod-97 remainder of an account number, read in pairs of digits."""
    s = F.replace(match, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(s, 5, 60), F.substring(s, 1, 4))
    chars = F.filter(F.split(turned, ""), lambda c: c != "")
    code = lambda c: F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    rest = F.aggregate(chars, F.lit(0), lambda acc, c: (acc * F.when(code(c) < 10, 10).otherwise(100) + code(c)) % 97)
    return F.char_length(s).between(15, 34) & (rest == 1)


def _valid(kind: str, m: Column) -> Column:
    n = F.char_length(digits(m))
    return {"email": F.lit(True), "ip": octets_fit(m), "card": luhn(m), "phone": n.between(9, 15), "iban": mod97(m), "national_phone": n.between(9, 11)}[kind]


def score(parts: Column, span: Column, kind: str) -> Column:
    """Base score of an added kind, moved by the words around the match in a text's pieces."""
    lo = F.greatest(span["start"] - BEFORE, F.lit(0))
    near = F.lower(F.concat(part(parts, lo, span["start"]), F.lit("\n"), part(parts, span["end"], span["end"] + AFTER)))
    return F.lit(SCORE[kind]) + F.when(near.rlike(FOR[kind]), STEP).otherwise(0.0) - F.when(near.rlike(AGAINST), STEP).otherwise(0.0)


def spans(text: Column, kind: str) -> Column:
    """Confirmed spans of a kind."""
    found = F.filter(matches(text, kind), lambda s: _valid(kind, s["match"]))
    if kind in BASE:
        return found
    near = lambda f: F.when(F.size(f) > 0, bound(pieces(text), lambda p: F.filter(f, lambda s: score(p, s, kind) >= LEAST))).otherwise(f)
    return bound(found, near)


def free_prefix(docs: DataFrame) -> str:
    """A prefix under which the span columns clash with no column of ``docs``."""
    prefix = "pii_"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix += "_"
    return prefix


def with_spans(docs: DataFrame, text: str = "text", prefix: str = "pii_") -> DataFrame:
    """Adds one array column ``<prefix><kind>`` for each kind."""
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.select("*", *(spans(body, k).alias(f"{prefix}{k}") for k in PATTERNS))


def _labels(kind: str) -> Column:
    return F.transform(F.col(f"pii_{kind}"), lambda s: F.concat_ws(":", F.lit(kind), s["start"].cast("string"), s["end"].cast("string")))


def report(docs: DataFrame) -> DataFrame:
    """(doc_id, counts of the base kinds, base_sha256, spans, found) of every document.

    ``found`` says whether there is any span, of the added kinds too.
    """
    rows = with_spans(docs.select("doc_id", "text"))
    base = F.concat_ws(",", *(_labels(k) for k in BASE))
    every = F.concat_ws(",", *(_labels(k) for k in PATTERNS))
    return rows.select("doc_id", *(F.size(f"pii_{k}").cast("long").alias(f"n_{k}") for k in BASE), F.sha2(base, 256).alias("base_sha256"), every.alias("spans"), (every != "").alias("found"))


def redact(docs: DataFrame) -> DataFrame:
    """Documents with every span replaced by ``[KIND]``, all columns kept.

    Overlapping spans are one stretch, named after the kind that begins first
    (then the longer, then in order of the list).
    """
    cols, prefix = docs.columns, free_prefix(docs)

    def marked_as(i: int, k: str):
        return lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), F.lit(i).alias("rank"), F.lit(f"[{k.upper()}]").alias("mark"))

    typed = [F.transform(F.col(f"{prefix}{k}"), marked_as(i, k)) for i, k in enumerate(PATTERNS)]
    body = F.coalesce(F.col("text"), F.lit(""))
    ordered = F.array_sort(F.concat(*typed))

    def add(parts: Column):
        def one(acc: Column, s: Column) -> Column:
            end = F.greatest(acc["at"], -s["back"])
            fresh = F.concat(acc["out"], F.array(part(parts, acc["at"], s["start"]), s["mark"]))
            return F.struct(end.alias("at"), F.when(s["start"] >= acc["at"], fresh).otherwise(acc["out"]).alias("out"))

        return one

    def told(parts: Column) -> Column:
        none = F.array().cast("array<string>")

        def group(acc: Column, g: Column) -> Column:
            inner = F.aggregate(g, F.struct(acc["at"].alias("at"), none.alias("out")), add(parts), lambda x: F.struct(x["at"].alias("at"), F.array(F.array_join(x["out"], "")).alias("out")))
            return bound(inner, lambda x: F.struct(x["at"].alias("at"), F.concat(acc["out"], x["out"]).alias("out")))

        start = F.struct(F.lit(0).alias("at"), none.alias("out"))
        rest = lambda acc: F.concat(F.array_join(acc["out"], ""), part(parts, acc["at"], F.char_length(body)))
        return bound(ordered, lambda o: F.aggregate(grouped(o), start, group, rest))

    text = bound(pieces(body), told)
    marked = with_spans(docs, prefix=prefix)
    any_ = sum((F.size(f"{prefix}{k}") for k in PATTERNS), F.lit(0)) > 0
    return marked.withColumn("text", F.when(any_, text).otherwise(F.col("text"))).select(cols)


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(work.table(spark, sf_dir, "documents"))
