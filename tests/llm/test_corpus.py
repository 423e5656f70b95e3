"""Decontamination, archives, licenses, URL filters, toxicity and the pipeline."""

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from attesta.llm import decontaminate, licenses, toxicity, urls, warc, work


def plain_alignment(item, passage):
    best, before = 0, [0] * (len(passage) + 1)
    for x in item:
        row = [0]
        for j, y in enumerate(passage):
            row.append(max(0, before[j] + (2 if x == y else -1), before[j + 1] - 1, row[j] - 1))
        best, before = max(best, *row), row
    return best


def test_alignment_scores():
    rng = np.random.default_rng(1)
    items = [rng.integers(0, 6, rng.integers(1, 30)).astype(np.uint64) for _ in range(60)]
    parts = [rng.integers(0, 6, rng.integers(1, 60)).astype(np.uint64) for _ in range(60)]
    got = [s for s, _, _ in decontaminate.smith_waterman(items, parts)]
    assert got == [plain_alignment(i.tolist(), p.tolist()) for i, p in zip(items, parts)]


def test_leaks_are_caught_and_clean_texts_left(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    items = [(i, " ".join(word() for _ in range(40))) for i in range(20)] + [(20, "just three words"), (21, None), (22, "")]
    common = items[0][1]
    docs = []
    for i in range(200):
        own = [word() for _ in range(150)]
        if i % 3 == 0:
            own[50:50] = common.split()
        docs.append([i, " ".join(own)])
    edited = items[5][1].upper().split()
    for k in range(3, 40, 6):
        edited[k] = "changed"
    docs[1][1] += " " + ", ".join(edited)
    docs[2][1] = "xx JUST, three words yy " + docs[2][1]
    docs[4][1] += " " + " ".join(items[6][1].split()[:6])
    docs += [[None, common], [300, None], [301, ""], [1, docs[1][1]]]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("score", F.lit(1))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contained(df, bench).collect()}
    assert got == {(i, 0) for i in range(0, 200, 3)} | {(1, 5), (2, 20)}
    left = decontaminate.without_leaks(df, bench)
    assert left.columns == df.columns and left.where("doc_id in (1, 2, 3)").count() == 0 and left.where("doc_id = 4").count() == 1
    assert decontaminate.contained(df, bench.where("false")).count() == 0
    assert decontaminate.contained(df.where("false"), bench).count() == 0


def test_a_phrase_of_all_items_nominates_no_pairs(spark):
    rng = random.Random(8)
    said = lambda n: " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(n))
    items = [(i, "which of the following is " + said(25)) for i in range(400)]
    alike = [(1000 + i, "please answer the question below with one word") for i in range(50)]
    docs = [(i, said(60) + " which of the following is " + said(60)) for i in range(400)] + [(500 + i, said(30) + " " + items[i][1] + " " + said(30)) for i in range(20)] + [(600, alike[0][1])]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items + alike, "item_id long, text string")
    assert decontaminate.nominated(d, b).count() < 2000
    got = {(r.doc_id, r.item_id) for r in decontaminate.contained(d, b).collect()}
    assert got == {(500 + i, i) for i in range(20)} | {(600, i) for i, _ in alike}


def test_edited_copies_of_one_kind_are_all_caught(spark):
    item = [f"w{i}" for i in range(40)]
    edited = [f"x{i}" if i in (4, 12, 20, 28, 36) else w for i, w in enumerate(item)]
    docs = [(0, " ".join(item))] + [(i, f"own{i} " + " ".join(edited) + f" words{i}") for i in range(1, 30)] + [(30, "w0 w1 w2 w3 and no more of it")]
    got = decontaminate.contained(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(7, " ".join(item))], "item_id long, text string"))
    assert {r.doc_id: r.score for r in got.collect()} == {0: 1.0} | {i: 65 / 80 for i in range(1, 30)}


@pytest.mark.parametrize("seed", range(3))
def test_loser_tree_merges(seed):
    rng = random.Random(seed)
    runs = [sorted((rng.randint(0, 9), rng.randint(0, 9)) for _ in range(rng.randint(0, 12))) for _ in range(rng.randint(0, 9))]
    assert list(warc.LoserTree(runs)) == sorted(x for r in runs for x in r)


@pytest.mark.parametrize("first_ranges", [256, 3])
def test_archive_round_trip(spark, tmp_path, monkeypatch, first_ranges):
    monkeypatch.setattr(warc, "ENTRIES_PER_RANGE", 7)
    monkeypatch.setattr(warc, "FIRST_RANGES", first_ranges)
    monkeypatch.setattr(warc, "FILE_BYTES", 3000)
    rows = [(i, f"http://{'ab'[i % 2]}.example.com/{i % 3}", "same" if i % 3 == 0 else f"<p>é\r\n\r\n{i}</p>" * (i + 1)) for i in range(40)]
    rows += [(50, None, None), (51, "", ""), (52, "not a url\n", "x" * 100_000), (53, "http://[bad", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5).withColumn("sha1", F.lit("clash"))
    got = warc.archive(df, f"file://{tmp_path}/w").collect()
    payload = {i: (h or "").encode() for i, _, h in rows}
    first = {}
    for i in sorted(payload):
        first.setdefault(payload[i], i)
    assert len(got) == len(rows)
    for r in got:
        p = payload[r.page_id]
        kind, refers = ("response", None) if first[p] == r.page_id else ("revisit", first[p])
        assert (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) == (len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), kind, refers)
    keys = [(r.url_key, r.capture_ts, r.page_id) for r in sorted(got, key=lambda r: (r.range, r.position))]
    assert keys == sorted(keys) and len({r.range for r in got}) > 2


def test_archives_of_any_ids_and_capture_times(spark, tmp_path):
    ids = [4611686018427387904, 5_000_000_000_000, -(1 << 62), 7, None]
    rows = [(i, "http://a.example.com/", f"page {i}", "n/a", n) for n, i in enumerate(ids)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, capture_ts string, n int")
    got = {r.page_id: r.capture_ts for r in warc.archive(df, f"file://{tmp_path}/a").collect()}
    assert got.keys() == set(ids) and all(re.fullmatch(r"20[23][0-9]-[0-9]{2}-[0-9]{2}T[0-9:]{8}Z", t) for t in got.values())
    stamped = df.withColumn("capture_ts", F.when(F.col("n") == 3, F.lit("2020-02-03 04:05:06").cast("timestamp")))
    times = {r.page_id: r.capture_ts for r in warc.archive(stamped, f"file://{tmp_path}/b").collect()}
    assert times == got | {7: "2020-02-03T04:05:06Z"}
    assert warc.archive(df.withColumn("capture_ts", F.col("n")), f"file://{tmp_path}/c").count() == 5


def test_filters_of_any_size_shuffle_no_rows(spark):
    keys = spark.range(50).select(F.xxhash64("id").alias("h"))
    rows = spark.range(0, 100, 1, 3).select("id", F.xxhash64("id").alias("h"), F.lit("text").alias("text"))
    for count in (50, 3_000_000, 1 << 40):
        assert urls.n_blocks(count) * 64 <= work.BROADCAST_BYTES
        flagged = urls.bloom_flag(rows, keys, count)
        assert set(range(50)) <= {r.id for r in flagged.where("maybe").collect()} and flagged.count() == 100
        for got in (flagged, urls.bloom_probe(rows, urls.bloom_blocks(keys, count), count)):
            plan = got._jdf.queryExecution().sparkPlan().toString()
            assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_archives_below_the_minimum_and_empty_tables(spark, tmp_path):
    df = spark.createDataFrame([(2, "u", "aa"), (1, "u", "aa"), (3, "u", "long one"), (4, "u", "long one")], "page_id long, url string, html string")
    got = {r.page_id: (r.record_type, r.refers_to) for r in warc.archive(df, f"file://{tmp_path}/a", 5).collect()}
    assert got == {1: ("response", None), 2: ("response", None), 3: ("response", None), 4: ("revisit", 3)}
    assert warc.archive(df.where("false"), f"file://{tmp_path}/b").count() == 0


def test_near_twins_of_full_texts_have_their_own_names(spark):
    text = dict(licenses.full_texts())
    third = re.compile(r"(?s)(?:3\.|\*|-)?\s*Neither the name.*?prior written permission\.\s*")
    bsd2 = third.sub("", text["BSD-3-Clause"])
    assert "endorse" not in bsd2
    rows = [
        (1, "a/LICENSE", text["GPL-3.0"].replace("GNU GENERAL", "GNU AFFERO GENERAL").replace("GNU General", "GNU Affero General"), "AGPL-3.0"),
        (2, "b/LICENSE", bsd2, "BSD-2-Clause"),
        (3, "c/LICENSE", re.sub(r"(?s)subject to the following\s+conditions:.*?shall be included in all\s+copies or substantial portions of the Software\.", "", text["MIT"]), "MIT-0"),
        (4, "a/x.c", "int main", "AGPL-3.0"),
        (5, "d/x.py", "# Licensed under CC BY-NC-ND 4.0", None),
        (6, "e/x.py", "# Licensed under CC BY-NC 4.0", "CC-BY-NC-4.0"),
        *((10 + i, f"{n}/LICENSE", t, n) for i, (n, t) in enumerate(text.items())),
    ]
    got = {r.file: r.license for r in licenses.scan(spark.createDataFrame([r[:3] for r in rows], "file long, path string, text string")).collect()}
    assert got == {r[0]: r[3] for r in rows}


def test_texts_of_many_license_lines(spark):
    text = "\n".join(f"# License line {i} of the MIT License" for i in range(20_000))
    lines = licenses.header_lines(spark.createDataFrame([(1, text)], "file long, text string"))
    assert lines.agg(F.count("*"), F.min("n_words"), F.max("n_words"), F.min("line_words")).first() == (20_000, 160_000, 160_000, 8)


def test_full_texts_and_wrapped_headers(spark):
    text = dict(licenses.full_texts())
    mit = text["MIT"].replace("[year] [fullname]", "2024 A Person")
    bare = mit.split("\n", 2)[2]
    rows = [(n, f"{n}/LICENSE", t) for n, t in text.items()] + [(f"{n}/x", f"{n}/src/x.py", "code") for n in text]
    rows += [("bare", "b/LICENSE", bare), ("below", "b/c/x.py", "code"), ("head", "h/x.py", "\n".join("# " + x for x in mit.split("\n")) + "\ncode here" * 900), ("beside", "h/y.py", "code")]
    rows += [("wrapped", "w/x.py", "# Licensed under the Apache\n# License, Version 2.0\n" + "code " * 50)]
    rows += [("prose", "p/x.txt", "The driver of the car has to show the license to the officer, and any of the papers that are in the car. " * 9)]
    got = {r.file: (r.license, r.origin) for r in licenses.scan(spark.createDataFrame(rows, "file string, path string, text string")).collect()}
    want = {n: (n, "header") for n in text} | {f"{n}/x": (n, "inherited") for n in text}
    want |= {"bare": ("MIT", "header"), "below": ("MIT", "inherited"), "head": ("MIT", "header"), "beside": (None, "none"), "wrapped": ("Apache-2.0", "header"), "prose": (None, "none")}
    assert got == want


def test_licenses_and_inheritance(spark):
    rows = [
        ("LICENSE", "a/LICENSE", "Released under the MIT License."),
        ("x", "a/b/c/x.py", "code only"),
        ("y", "a/b/y.py", "Licensed under the Apache License, Version 2.0.\n" + "code " * 50),
        ("g", "a/b/g/COPYING", "This work is licensed under the GNU General Public License, version 3."),
        ("z", "a/b/g/h/z.py", None),
        ("o", "o/o.py", "a driving licence is no notice"),
        ("n", None, "words"),
        ("t", "top.py", ""),
    ]
    got = {r.file: (r.license, r.origin, r.from_dir) for r in licenses.scan(spark.createDataFrame(rows, "file string, path string, text string")).collect()}
    assert got == {
        "LICENSE": ("MIT", "header", None),
        "x": ("MIT", "inherited", "a"),
        "y": ("Apache-2.0", "header", None),
        "g": ("GPL-3.0", "header", None),
        "z": ("GPL-3.0", "inherited", "a/b/g"),
        "o": (None, "none", None),
        "n": (None, "none", None),
        "t": (None, "none", None),
    }
    assert licenses.scan(spark.createDataFrame([], "file string, path string, text string")).count() == 0


def test_url_rules_and_bloom(spark):
    rows = [(1, "https://WWW.example.com/en/1?x"), (2, "http://a.example.com/en/1"), (3, "http://x.net/es/9#a"), (4, "http://x.net/de/9"), (5, "http://com?q"), (6, None), (7, "nonsense"), (8, "http://sub.bad.org/p/"), (9, "http://bad.org.uk/p"), (10, "http://bad.org:80/q"), (11, "http://page.org/one/"), (11, "http://page.org/one/")]
    listed = spark.createDataFrame([("bad.org/",), ("page.org/one/",), (None,), ("bad.org/",)], "key string")
    df = spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit("clash"))
    got = [(r.page_id, r.rule, r.verdict) for r in urls.url_filter(df, listed).collect()]
    assert len(got) == len(rows)
    assert set(got) == {(1, "www.example.com/en/", "allow"), (2, "example.com/en/", "block"), (3, "net/es/", "block"), (4, None, "allow"), (5, None, "allow"), (6, None, "allow"), (7, None, "allow"), (8, None, "block"), (9, None, "allow"), (10, None, "block"), (11, None, "block")}
    assert {r.verdict for r in urls.url_filter(df.where("page_id > 7"), listed.where("false")).collect()} == {"allow"}


def test_bloom_has_no_false_negatives(spark):
    keys = spark.range(5000).select(F.xxhash64("id").alias("h"))
    blocks = urls.bloom_blocks(keys, 5000)
    probe = spark.range(20_000).withColumn("h", F.xxhash64("id"))
    passed = {r.id for r in urls.bloom_probe(probe, blocks, 5000).collect()}
    assert set(range(5000)) <= passed and len(passed) < 5000 + 0.1 * 15_000


def test_automaton_catches_misspellings():
    m = toxicity.Automaton(["idiot", "disgusting", "scum", "vequ*"])
    kinds = {w: m.match(w) for w in ("idiot", "idiott", "ideot", "dioit", "xdiot", "disgsting", "disgustnig", "disgust", "scum", "scums", "vequalo", "vequ", "vaqualo", "")}
    assert kinds == {"idiot": 1, "idiott": 2, "ideot": 2, "dioit": 0, "xdiot": 0, "disgsting": 2, "disgustnig": 2, "disgust": 0, "scum": 1, "scums": 0, "vequalo": 3, "vequ": 3, "vaqualo": 0, "": 0}


def test_quotation_is_told_from_abuse():
    m = toxicity.Automaton(["idiot"])
    quote, abuse = toxicity.features('She said he wrote "idiot" there', m), toxicity.features("you are an idiot", m)
    assert quote[4] > 0 and abuse[4] == 0 and abuse[5] > 0


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs, labels)
    rows = toxicity.score(docs.join(labels.select("doc_id"), "doc_id", "left_semi"), model).join(labels, "doc_id").collect()
    held = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert len(held) > 500 and sum((r.score >= 0.5) == r.toxic for r in held) / len(held) > 0.96


def test_toxicity_without_labels_and_with_nulls(spark):
    docs = spark.createDataFrame([(1, "you idiot you moron you scum", 1), (2, None, 1), (3, "", 1), (None, "fine words", 1)], "doc_id long, text string, score int")
    model = toxicity.train(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    assert got[1] > 0.5 and got[2] == got[3] and got[2] < 0.5 and 0 <= got[None] <= 1
    kept = toxicity.reject(docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {2, 3, None}


def test_rows_without_an_id_are_scored_and_not_held_out(spark, tmp_path):
    rows = [(None, "you idiot", "x"), (None, None, "y"), (7, "you idiot", "z"), (7, "you idiot", "z")]
    spark.createDataFrame(rows, "doc_id long, text string, score string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(None, 0, 1), (7, 0, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = toxicity.op10_toxicity(spark, str(tmp_path)).collect()
    out = zlib.crc32(b"7") % 5 == 0
    assert sorted((r.doc_id or 0, str(r.held_out), r.predicted) for r in got) == [(0, "None", 0), (0, "None", 1), (7, str(out), 1), (7, str(out), 1)]
    assert all(0 <= r.score <= 1 for r in got)


def test_pipeline_runs_over_small_tables(spark, sf):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_jaccard", "decontaminate", "pii", "best_fit_packing"]
    docs = work.table(spark, sf, "documents")
    out = corpus_pipeline.run(spark, sf).collect()
    assert 0 < len({r.doc_id for r in out}) < docs.count()
    rest = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        rest = stage(spark, rest, sf)
        assert rest.columns == docs.columns
        rest = work.cut(rest, "t")
    assert {r.doc_id for r in out} == {r.doc_id for r in rest.collect()}


def plain_words(text):
    return re.findall(r"\w+", (text or "").lower().replace("_", " "))


def test_recall_against_alignment_of_all_pairs(spark):
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(400)]
    items = [(i, " ".join(rng.choices(vocab, k=rng.choice([3, 8, 25, 60])))) for i in range(25)]
    docs = []
    for i in range(120):
        words = rng.choices(vocab, k=rng.randint(0, 200))
        part = items[rng.randrange(25)][1].split()
        for k in range(len(part)):
            if rng.random() < (i % 4) / 12:
                part[k] = rng.choice(vocab)
        at = rng.randint(0, len(words))
        docs.append((i, " ".join(words[:at] + part + words[at:]) if i % 5 else " ".join(words)))
    want = set()
    for d, t in docs:
        for n, item in items:
            x = plain_words(item)
            s = plain_alignment(x, plain_words(t))
            if s >= len(x) and (s + 1) // 2 >= min(decontaminate.MIN_WORDS, len(x)):
                want.add((d, n))
    got = {(r.doc_id, r.item_id) for r in decontaminate.contained(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got <= want and len(got) >= 0.95 * len(want) and len(want) > 60


def test_words_of_any_script_without_punctuation(spark):
    item = "Élan vital Ünder ÇA Привет мир über façade 東京 tower"
    docs = [(1, " ".join(f"“{w.lower()}”…" for w in item.split())), (2, item.upper().replace(" ", " —　")), (None, f"see «{item}»"), (None, "clean words only"), (3, "long " * 60_000 + item + " tail" * 60_000)]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(7, item), (None, "clean words only")], "item_id long, text string")
    assert {(r.doc_id, r.score) for r in decontaminate.contained(df, bench).collect()} == {(1, 1.0), (2, 1.0), (3, 1.0)}
    assert [tuple(r) for r in decontaminate.without_leaks(df, bench).collect()] == [(None, "clean words only")]


def test_the_seed_map_grows_with_the_seeds(spark):
    assert decontaminate.bits_for(0) == decontaminate.MIN_BITS and decontaminate.bits_for(10**6) == 1 << 24 and decontaminate.bits_for(10**12) == decontaminate.MAX_BITS
    seeds = spark.range(3000).select(F.xxhash64("id").alias("gram"))
    size = decontaminate.MIN_BITS
    held = np.frombuffer(decontaminate.seed_map(seeds, size), np.uint8)
    h = np.array([r[0] for r in seeds.collect()], np.int64).view(np.uint64)
    assert len(decontaminate._held(held, size, h)) == 3000
    assert len(decontaminate._held(held, size, np.arange(100_000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))) < 50


def expected_records(rows):
    """One response per payload: least (no id, id, url) of its rows, one of equal ones."""
    groups = {}
    for i, u, h in rows:
        groups.setdefault(h or "", []).append((i is None, i, u or ""))
    out = []
    for h, g in groups.items():
        lead = min(g, key=lambda r: (r[0], r[1] or 0, r[2]))
        out += [(lead[1], h, "response", None)] + [(r[1], h, "revisit", lead[1]) for k, r in enumerate(g) if k != g.index(lead)]
    return sorted(map(repr, out))


@pytest.mark.parametrize("small", [True, False])
def test_one_response_for_each_payload_with_repeats_and_null_ids(spark, tmp_path, monkeypatch, small):
    monkeypatch.setattr(warc, "ENTRIES_PER_RANGE", 5)
    if not small:
        monkeypatch.setattr(work, "BROADCAST_BYTES", 0)
    rng = random.Random(4)
    rows = [(1, "u", "p"), (1, "u", "p"), (2, "u", "p"), (None, "u", "q"), (None, "v", "q"), (None, "v", "r"), (5, "b", "s"), (5, "a", "s"), (6, "x", "alone")]
    rows += [(rng.choice([None, *range(20)]), rng.choice("uvw"), rng.choice(["", None, "hot", "hot", "hot", f"own {k}"])) for k in range(150)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    got = warc.archive(df, f"file://{tmp_path}/{small}").collect()
    digest = {base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode(): h or "" for _, _, h in rows}
    assert sorted(repr((r.page_id, digest[r.payload_digest], r.record_type, r.refers_to)) for r in got) == expected_records(rows)
    assert all(r.payload_bytes == len(digest[r.payload_digest]) for r in got)
    keys = [(r.url_key, r.capture_ts, r.page_id is None, r.page_id or 0) for r in sorted(got, key=lambda r: (r.range, r.position))]
    assert keys == sorted(keys) and len({r.range for r in got}) > 10


@pytest.mark.parametrize("small", [True, False])
def test_equal_texts_declare_licenses_once_and_ids_may_be_null(spark, monkeypatch, small):
    if not small:
        monkeypatch.setattr(work, "BROADCAST_BYTES", 0)
    mit = "Released under the MIT License.\n" + "word " * 12
    rows = [("f", "d/f", mit), ("f", "d/f", mit), (None, "n/x", "Released under the MIT License."), (None, "n/y", "code"), ("g", "d/g", "code"), ("s", "s/s.py", "# SPDX-License-Identifier: Apache-2.0\ncode"), ("long", "l/l", "code words " * 50_000 + "\nReleased under the MIT License.")]
    df = spark.createDataFrame(rows, "file string, path string, text string").withColumn("license", F.lit("clash"))
    got = sorted(((r.path, r.license, r.origin) for r in licenses.scan(df).collect()), key=str)
    assert got == [("d/f", "MIT", "header"), ("d/f", "MIT", "header"), ("d/g", None, "none"), ("l/l", "MIT", "header"), ("n/x", "MIT", "header"), ("n/y", "MIT", "inherited"), ("s/s.py", "Apache-2.0", "header")]


def test_cosines_against_plain_ones(spark):
    rows = [(i, t) for i, t in enumerate(["Licensed under the MIT license", "licensed under the Apache License, Version 2.0 today", "This license is none of those named", "Dedicated to the public domain", "GNU General Public License, version 3"])]
    lines = spark.createDataFrame([(str(i), t, i + 1) for i, t in rows], "line string, text string, times long")
    templates = spark.createDataFrame([(n, t, False) for n, t in licenses.TEMPLATES], "license string, text string, full boolean")
    got = {r.line: (r.license, round(r.cosine, 6)) for r in licenses.match_lines(lines, templates).collect()}
    terms = lambda t: Counter(re.findall(r"[^\W_]+(?:[.-][^\W_]+)*", t.lower()))
    df, total = Counter(), len(licenses.TEMPLATES)
    for i, t in rows:
        total += i + 1
        df.update({w: i + 1 for w in terms(t)})
    for _, t in licenses.TEMPLATES:
        df.update(terms(t).keys())
    vec = lambda t: {w: n * (math.log((1 + total) / (1 + df[w])) + 1) for w, n in terms(t).items()}
    cos = lambda a, b: sum(v * b.get(w, 0) for w, v in a.items()) / math.sqrt(sum(v * v for v in a.values()) * sum(v * v for v in b.values()))
    want = {}
    for i, t in rows:
        best = min((-round(cos(vec(t), vec(x)), 9), n) for n, x in licenses.TEMPLATES)
        if -best[0] >= licenses.MIN_COSINE:
            want[str(i)] = (best[1], round(-best[0], 6))
    assert got == want and len(want) >= 3


def test_hits_that_are_not_small_are_parted_by_a_filter(spark, monkeypatch):
    rows = [(i, f"http://h{i % 50}.org/{'p' * (i % 3)}") for i in range(400)] + [(900, None), (901, "http://h1.org/" + "x" * 50_000)]
    df, listed = spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame([(f"h{i}.org/",) for i in range(0, 50, 7)], "key string")
    want = sorted(map(str, urls.url_filter(df, listed).collect()))
    monkeypatch.setattr(work, "BROADCAST_BYTES", 0)
    assert sorted(map(str, urls.url_filter(df, listed).collect())) == want and sum("listed=True" in r for r in want) == 64


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


def test_automaton_against_plain_edit_distances():
    rng = random.Random(8)
    terms = ["idiot", "scum", "disgusting", "abcabcabc", "aaaaa", "worthless"]
    words = {"".join(rng.choices("abc", k=rng.randint(0, 12))) for _ in range(3000)} | set(terms)
    for t in terms:
        for _ in range(400):
            w = list(t)
            for _ in range(rng.randint(0, 3)):
                k = rng.randrange(len(w) + 1)
                w[k : k + rng.randint(0, 1)] = rng.choices("abcdistu", k=rng.randint(0, 1))
            words.add("".join(w))
    m = toxicity.Automaton(terms)
    for w in words:
        near = [t for t in terms if t[0] == w[:1] and edits(w, t) <= (2 if len(t) >= 9 else 1 if len(t) >= 5 else 0)]
        assert m.match(w) == (1 if w in terms else 2 if near else 0), w


def test_words_of_any_length_and_a_quoted_term_scores_lower(spark):
    long = "vequ" + "a" * 100
    assert toxicity.Automaton(["vequ*"]).hits([long, "x" * 500]) == {long: 3}
    model = (["idiot"], [-4.0, 2.0, 1.0, 2.0, -1.0, 0.5, 3.0, 0.0])
    docs = spark.createDataFrame([(1, "you idiot"), (2, "she said the word «idiot» there"), (3, "calm words" * 30_000)], "doc_id long, text string")
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    assert got[1] > got[2] > got[3]


def test_the_model_does_not_depend_on_the_order_of_rows(spark):
    rng = random.Random(1)
    texts = [" ".join(rng.choices("calm sunny field river stone cloud".split(), k=12) + (["vile", "scumbag"] if i % 3 == 0 else [])) for i in range(60)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(i, "other calm words") for i in range(0, 60, 4)] + [(100 + i, texts[i]) for i in range(10)]
    labels = [(i, 1, int(i % 3 == 0)) for i in range(60)] + [(100 + i, 1, 0) for i in range(10)] + [(i, 1, 1) for i in range(0, 60, 5)]
    make = lambda rows, schema: spark.createDataFrame(rows, schema)
    models = []
    for flip in (1, -1):
        models.append(toxicity.train(make(rows[::flip], "doc_id long, text string"), make(labels[::flip], "doc_id long, quality int, toxic int")))
    assert models[0] == models[1]


def test_stages_over_odd_rows(spark, sf):
    """Nulls, empty and very long texts, ties, repeated rows, empty tables: no crash, columns stay."""
    import corpus_pipeline

    rows = [(1, None), (2, ""), (3, "word " * 100_000), (4, "same text of some words here"), (4, "same text of some words here"), (None, "no id but words"), (5, " \n\t"), (6, "write to a@b.org or 4111 1111 1111 1111 now")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "'en' as lang", "'s' as source", "cast(length(text) as long) as n_chars")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, df, sf)
        ids = {r.doc_id for r in out.collect()}
        assert ids == {1, 2, 3, 4, 5, 6, None}, name
        if name != "best_fit_packing":
            assert out.columns == df.columns
        assert stage(spark, df.where("false"), sf).count() == 0


def test_driver_lets_go_of_the_sample(spark, sf, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame

    kept = []
    monkeypatch.setattr(work, "trim", lambda: kept.append(1))
    monkeypatch.setattr(DataFrame, "collect", lambda self: pytest.fail("the sample is collected whole"))
    terms, weights = toxicity.train(work.table(spark, sf, "documents"), work.table(spark, sf, "labels"))
    assert terms and len(weights) == 8 and kept
