"""PartEnum join against brute force."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from attesta.llm import jaccard, kernel, work


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    held = defaultdict(list)
    for i in sorted(sets):
        for j, n in Counter(j for g in sets[i] for j in held[g]).items():
            if 100 * n >= 75 * (len(sets[i]) + len(sets[j]) - n):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
        for g in sets[i]:
            held[g].append(i)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def corpus(seed, n=140):
    """Families of edited copies, shared passages, short and empty texts."""
    rng = random.Random(seed)
    word = lambda: rng.choice("alpha beta gamma delta eps zeta eta theta".split()) + str(rng.randint(0, 400))
    passage = " ".join(word() for _ in range(60))
    rows, base = [], [word() for _ in range(80)]
    for i in range(n):
        kind = i % 7
        if kind == 0:
            base = [word() for _ in range(rng.choice([4, 6, 9, 30, 80, 300]))]
        if kind < 5:
            own = list(base)
            for _ in range(rng.randint(0, max(1, len(own) // 25))):
                own[rng.randrange(len(own))] = word()
            text = " ".join(own)
        elif kind == 5:
            text = passage + " " + " ".join(word() for _ in range(rng.randint(5, 200)))
        else:
            text = rng.choice(["", None, "  \n", "One", "one", "a b c d", "A b  c d", "a b c d e", passage])
        rows.append((i, text))
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_components_match_brute_force(spark, seed):
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(df).collect()}
    assert got == brute(rows)


def test_one_large_family_with_a_common_passage(spark):
    rng = random.Random(9)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(300):
        own = list(base)
        for _ in range(rng.randint(1, 6)):
            own[rng.randrange(len(own))] = f"x{rng.random()}"
        rows.append((i, " ".join(own)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(df).collect()}
    assert got == brute(rows)


def test_blocks_split_a_large_group(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK_MEMBERS", 16)
    test_one_large_family_with_a_common_passage(spark)


def test_signatures_never_lose_a_pair():
    """Any two sets of similarity .75 or more share a signature."""
    rng = np.random.default_rng(4)
    bounds = jaccard.band_bounds(4000)
    for n in (1, 2, 3, 4, 5, 7, 12, 40, 173, 900):
        for _ in range(12):
            base = np.unique(rng.integers(0, 1 << 52, n, dtype=np.uint64))
            union = -(-len(base) * 100 // 75) if rng.random() < 0.5 else len(base)
            a = base
            extra = np.unique(rng.integers(0, 1 << 52, max(0, min(union - len(base), len(base) // 3)), dtype=np.uint64))
            b = np.unique(np.concatenate((base, extra)))
            both = len(np.intersect1d(a, b))
            if 100 * both < 75 * len(np.union1d(a, b)):
                continue
            out = []
            for h in (a, b):
                s, _, _ = jaccard.signatures(np.zeros(len(h), np.int64), h, np.array([len(h)]), rng.random(len(h)) < 2, bounds)
                out.append(set(s.tolist()))
            assert out[0] & out[1]


def test_nulls_ties_empty_tables_and_extra_columns(spark):
    df = spark.createDataFrame([(1, "a b c d e f", "x"), (1, "a b c d e f", "y"), (None, "a b c d e f", "z"), (2, None, None)], "doc_id long, text string, n string").withColumnRenamed("n", "cls")
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.near_duplicates(df).collect())
    assert got == [(1, 2, 1), (1, 2, 1), (2, 0, 2)]
    kept = jaccard.keep_one(df)
    assert kept.columns == df.columns and sorted(r.doc_id or -1 for r in kept.collect()) == [-1, 1, 2]
    assert jaccard.near_duplicates(df.where("false")).count() == 0


def test_components_are_exact(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (102, 101)] + [(7, 7)]
    got = dict(map(tuple, work.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert {i: got[i] for i in range(41)} == {i: 0 for i in range(41)} and {got[i] for i in (100, 101, 102)} == {100}
    assert work.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_words_of_a_batch_with_nulls_and_long_text():
    texts = [None, "", " a  bc\t", "é\x0bñ", "x" * (kernel.SLICE_BYTES + 5), "z z"]
    buf, offs = kernel.column_bytes(pa.array(texts, pa.string()))
    found = [[] for _ in texts]
    for a, b in kernel.slices(offs):
        part = buf[offs[a] : offs[b]]
        for s, e, r in zip(*kernel.words(part, offs[a : b + 1] - offs[a])):
            found[a + r].append(part[s:e].tobytes().decode())
    assert found == [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]


def thue_morse(n: int) -> str:
    return "".join("ab"[bin(i).count("1") % 2] for i in range(n))


@pytest.mark.parametrize("n", [64, 1024, 2048, 4096])
def test_words_of_a_simple_pattern_do_not_collide(n):
    """Sums of powers modulo 2^64 of a Thue-Morse word and its complement are equal."""
    word = thue_morse(n)
    other = word.translate(str.maketrans("ab", "ba"))
    text = f"{word} {other} {word}".encode()
    buf = np.frombuffer(text, np.uint8)
    a, b, c = kernel.span_hash(buf, *kernel.words(buf, np.array([0, len(text)]))[:2])
    assert a == c and a != b
    sets = [set(kernel.shingle_sets(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)]))[1].tolist()) for t in (f"w x {word} y z q", f"w x {other} y z q")]
    assert len(sets[0] & sets[1]) == 0


def test_span_hashes_depend_on_the_bytes_of_the_span_only():
    rng = np.random.default_rng(2)
    pool = [bytes(rng.integers(97, 100, n, dtype=np.uint8)) for n in [*range(1, 20), 63, 64, 65, 200] for _ in range(3)]
    text = b" ".join(pool[i] for i in rng.integers(0, len(pool), 500))
    buf = np.frombuffer(text, np.uint8)
    start, end, _ = kernel.words(buf, np.array([0, len(text)]))
    seen = {}
    for s, e, h in zip(start.tolist(), end.tolist(), kernel.span_hash(buf, start, end).tolist()):
        assert seen.setdefault(text[s:e], h) == h
    assert len(set(seen.values())) == len(seen)


def test_steps_round_trip():
    rng = np.random.default_rng(1)
    for top in (3, 300, 100_000):
        local = np.sort(rng.integers(0, top, 50))
        assert jaccard._places(jaccard._steps(local)).tolist() == local.tolist()
    assert jaccard._places(jaccard._steps(np.array([255, 510, 510, 765]))).tolist() == [255, 510, 510, 765]


def test_the_sketch_saturates(spark):
    rows = [(i, "one two three four five six") for i in range(3000)]
    facts, sketch, counters = jaccard.survey(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1))
    bits = np.unpackbits(np.frombuffer(jaccard.frequent_bits(sketch, counters, 6000), np.uint8))
    assert bits.sum() == 2 and facts.count() == 3000
