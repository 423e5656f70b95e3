"""Dictionaries and quotes against plain searches."""

import random
import re

import pytest
from pyspark.sql import functions as F

from attesta.functions import text
from attesta.operators import phrases


def some(seed):
    rng = random.Random(seed)
    words = ["alpha", "Beta", "gamma", "été", "日本", "x_1", "the", "of"]
    marks = [" ", " ", ", ", ". ", " - ", "\n"]
    said = lambda n: "".join(rng.choice(words) + rng.choice(marks) for _ in range(n))
    sources = [(i, said(rng.randint(0, 60))) for i in range(60)] + [(100, None), (101, ""), (102, "...")]
    quotes = []
    for i in range(40):
        w = re.findall(r"\w+", rng.choice(sources[:60])[1])
        a = rng.randint(0, max(0, len(w) - 3))
        part = w[a : a + rng.randint(1, 8)]
        quotes.append((i, rng.choice([" ", ", ", " "]).join(x.upper() if rng.random() < 0.3 else x for x in part)))
    quotes += [(50, None), (51, ""), (52, ". "), (53, "a b"), (54, "pha, B"), (55, sources[3][1][5:60])]
    return quotes, sources


@pytest.mark.parametrize("seed", range(3))
def test_quotes(spark, monkeypatch, seed):
    monkeypatch.setattr(phrases, "LOOKUPS", 2)
    if seed == 2:  # a map too dense to rule much out, and more automata than one
        monkeypatch.setattr(phrases, "MAP_BITS", 1 << 12)
        monkeypatch.setattr(phrases, "AUTOMATON_BYTES", 40)
    quotes, sources = some(seed)
    q = spark.createDataFrame([(*r, 1) for r in quotes], "id int, text string, source int")
    s = spark.createDataFrame([(*r, 1) for r in sources], "id long, text string, quote int").repartition(3)
    exact = {(i, j) for i, a in quotes for j, b in sources if a and b and a in b}
    assert {tuple(r) for r in phrases.grounded_quotes(q, s).collect()} == exact and len(exact) > 20
    every = q.select("id", F.col("text").alias("q")).crossJoin(s.select(F.col("id").alias("j"), F.col("text").alias("s")))
    want = {(r.id, r.j): r.r for r in every.select("id", "j", "q", text.repaired_quote("q", "s").alias("r")).collect() if r.r is not None and len(re.findall(r"\w+", r.q)) >= 3}
    got = {(r.quote, r.source): (r.repaired, r.start, r.exact) for r in phrases.repaired_quotes(q, s).collect()}
    whole = {p: r for p, r in want.items() if p in got or p not in exact}
    assert {p: r[0] for p, r in got.items()} == whole
    # exact quotes of three or four words may begin or end inside of words: those are left to grounded_quotes
    assert all(p in exact and len(re.findall(r"\w+", dict(quotes)[p[0]])) < 5 for p in want.keys() - got.keys())
    texts, asked = dict(sources), dict(quotes)
    assert all(texts[j][n : n + len(r)] == r and e == (asked[i] in texts[j]) for (i, j), (r, n, e) in got.items())


def test_sources_are_read_once(spark, monkeypatch):
    calls = []
    index = phrases._index
    monkeypatch.setattr(phrases, "_index", lambda texts, inner, wanted: (calls.append((inner, wanted is not None)), index(texts, inner, wanted))[1])
    monkeypatch.setattr(phrases, "KNOWN_WORDS", 3)
    q = spark.createDataFrame([(1, "beta Gamma delta epsilon zeta"), (2, "pha beta gamma delta eps"), (3, "no such words here")], "id int, text string")
    s = spark.createDataFrame([(7, "Alpha Beta, gamma. DELTA epsilon-zeta"), (8, "alpha beta gamma delta epsilon"), (9, None)], "id int, text string")
    got = {tuple(r) for r in phrases.repaired_quotes(q, s).select("quote", "source", "start", "repaired", "exact").collect()}
    assert got == {(1, 7, 6, "Beta, gamma. DELTA epsilon-zeta", False), (2, 8, 2, "pha beta gamma delta eps", True)}
    assert [c for c in calls if c[1]] == [(0, True)]


@pytest.mark.parametrize("parts", [1, 3, 100])
def test_dictionaries(spark, monkeypatch, parts):
    quotes, sources = some(7)
    terms = sorted({" ".join(re.findall(r"\w+", a.lower())) for _, a in quotes if a} | {"", "the", "of the", "the of the"})
    size = sum(len(t.encode()) + 8 for t in terms if t)
    monkeypatch.setattr(phrases, "AUTOMATON_BYTES", -(-size // parts))
    docs = spark.createDataFrame([(*s, 1) for s in sources], "id long, text string, term_id int")
    table = spark.createDataFrame([(t,) for t in [*terms, None, "the"]], "term string")
    got = sorted((r.id, r.term) for r in phrases.dictionary_matches(docs, "text", table, "term").collect())
    held = lambda t, s: f" {t} " in f" {' '.join(re.findall(chr(92) + 'w+', s.lower()))} "
    assert got == sorted((i, t) for i, s in sources if s for t in terms if t and held(t, s))
    assert phrases.dictionary_matches(docs, "text", table.where("false"), "term").count() == 0


def test_terms_with_marks(spark):
    docs = spark.createDataFrame([(1, "The U.K.  and\nthe ＵＫ"), (2, "funk, ok"), (3, "c++ and c"), (4, None), (5, "Die Straße.")], "id int, text string")
    table = spark.createDataFrame([("u.k.",), ("uk",), ("c++",), ("c",), ("and the",), ("unk",), ("STRASSE",), ("straße",)], "term string")
    got = {(r.id, r.term) for r in phrases.dictionary_matches(docs, "text", table, "term", words=False).collect()}
    assert got == {(1, "u.k."), (1, "uk"), (1, "and the"), (3, "c++"), (3, "c"), (5, "STRASSE"), (5, "straße")}


def test_matches_carry_the_kept_columns_in_small_batches(spark):
    from attesta.plans.texts import normalized_casefold, term_dictionary
    from attesta.session import BATCH_ROWS

    docs = spark.createDataFrame([(1, "An apple, a pear"), (2, None)], "id long, text string")
    got = phrases.dictionary_matches(docs, "text", spark.createDataFrame([("a pear",), ("an apple",)], "term string"), "term", keep=["id"])
    assert got.columns == ["id", "term"] and sorted(map(tuple, got.collect())) == [(1, "a pear"), (1, "an apple")]
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    for query in (normalized_casefold, term_dictionary):
        spark.conf.set(name, "10000")
        query(spark, "/root/testdata/sf0.001")
        assert int(spark.conf.get(name)) == BATCH_ROWS


def test_overlaps_are_counted_where_documents_lie(spark, monkeypatch, tmp_path):
    from attesta.plans import texts

    docs = [(1, "a b c d"), (2, "A, b! x"), (2, "c a"), (3, None), (4, "d c b a"), (5, "é a")]
    items = [(10, "a b c"), (11, "d É"), (12, "zz"), (13, None)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = texts.excerpt_overlap(spark, str(tmp_path))
    assert sorted(map(tuple, got.collect())) == [(10, 1, 3), (10, 2, 4), (11, 1, 1), (11, 4, 1)]
    assert "hashpartitioning(item_id#" in (plan := got._jdf.queryExecution().executedPlan().toString())
    assert not re.search(r"hashpartitioning\(item_id#\w+, doc_id", plan)
    monkeypatch.setattr(texts, "PAIRS", 2)
    few = texts.excerpt_overlap(spark, str(tmp_path))
    assert re.search(r"hashpartitioning\(doc_id#\w+, 12\)", few._jdf.queryExecution().executedPlan().toString())
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, got.collect()))
