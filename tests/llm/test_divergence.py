"""The source divergence audit against plain sums over all terms."""

import random
import re
from collections import Counter, defaultdict

import duckdb
import pytest

from attesta.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}
SCHEMA = "text string, lang string, source string, term int, gid string"


def plain(docs):
    """Rows of the audit from (text, lang, source) rows, over every kept term and pair."""
    found, n, groups = defaultdict(set), defaultdict(Counter), defaultdict(set)
    for i, (text, lang, source) in enumerate(docs):
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        for t in TERM.findall(text or ""):
            t = t.translate(LOWER)
            found[lang, t].add(i)
            n[lang, source][t] += 1
    out = []
    for lang, sources in groups.items():
        kept = sorted((t for g, t in found if g == lang and len(found[g, t]) >= 10), key=str.encode)
        p = {}
        for s in [*sources, None]:
            counts = [sum(n[lang, x][t] for x in (sources if s is None else [s])) for t in kept]
            p[s] = [1 + 10**9 * (c + 2) // (sum(counts) + 2 * len(kept)) for c in counts]
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            far = [(o, sum(map(f, p[s], p[o]))) for o in sources if o != s]
            more = [(t, f(a, b)) for t, a, b in zip(kept, p[s], p[None]) if n[lang, s][t] and a > b]
            for part, rows, top in (("pair", far, None), ("term", more, 10)):
                rows = sorted(rows, key=lambda r: (-r[1], r[0].encode()))[:top]
                out += [(lang, s, part, item, value, k) for k, (item, value) in enumerate(rows, 1)]
    return sorted(out)


def some(rng, n, sources):
    words = ["Alpha", "beta", "ALPHA", "été", "É", "x1y", "don't", "日本", "zz", "a b", *(f"w{chr(97 + i)}" for i in range(20))]
    text = lambda: " ".join(rng.choice(words) for _ in range(rng.randint(0, 30)))
    return [(rng.choice([None, "", "123 !", text(), text(), text()]), rng.choice(["en", "fr", None, ""]), rng.choice([*sources, None, ""])) for _ in range(n)]


@pytest.mark.parametrize("seed", range(3))
def test_audit_is_that_of_plain_sums(spark, monkeypatch, seed):
    if seed:  # flushes, cut texts, blocks of sources and parts of terms as on large tables
        for name, value in (("COUNTERS", 15), ("CHUNK", 7), ("BLOCK", 3), ("POSTINGS", 11)):
            monkeypatch.setattr(divergence, name, value)
    rng = random.Random(seed)
    docs = some(rng, 150, [f"src{i}" for i in range(8)]) + [("rare words only", "xx", "src1"), (None, "xx", "src2")] + [("alpha beta", "one", "only")] * 12
    got = divergence.audit(spark.createDataFrame([(*d, 1, "x") for d in docs], SCHEMA).repartition(3))
    assert sorted(map(tuple, got.collect())) == plain(docs)


def test_long_texts_and_empty_tables(spark):
    assert [w for part in divergence.terms("Ab1cd " * 400_000) for w in part] == [b"ab", b"cd"] * 400_000
    assert divergence.audit(spark.createDataFrame([], SCHEMA)).count() == 0


def test_sql_is_that_of_plain_sums(spark, sf):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf}/documents.parquet'")
    rel = con.sql(divergence.OP11_SQL)
    got = divergence.op11_source_divergence(spark, sf)
    assert rel.columns == got.columns
    want = plain(con.sql("select text, lang, source from documents").fetchall())
    assert sorted(rel.fetchall()) == want == sorted(map(tuple, got.collect()))
