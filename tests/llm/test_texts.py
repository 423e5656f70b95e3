"""Token counts, packing, quality and personal data against plain versions."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece

from attesta.llm import packing, pii, quality, token_counts

EDGE = [None, "", " ", "\n", "a", "▁", "  a ", " " * 5000, "x" * 5000, "ab" * 3000, "中文" * 900, "é" * 999, "a b", "<s></s>", "\0", "🙂🙂"]


def fuzz(parts, n, longest, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, longest))) for _ in range(n)]


def test_token_counts_equal_the_library(spark, sf):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    parts = ["a", "b", "the", "ing", " ", "  ", "   ", "\n", "\t", "é", "ß", "中", "🙂", "́", "1", "▁", "x" * 5, ".", "(", "--", "<s>", "    " * 9]
    texts = EDGE + fuzz(parts, 400, 300) + [r[0] for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    size, got = token_counts.count_column(pa.array(texts, pa.string()), token_counts.Transducer(path))
    assert got.tolist() == [len(x) for x in lib.encode([t or "" for t in texts], num_threads=1)]
    assert size.tolist() == [len((t or "").encode()) for t in texts]


def test_small_tables_start_anew(monkeypatch):
    import sentencepiece

    monkeypatch.setattr(token_counts, "TABLE_CELLS", 1 << 16)
    path = public_tokenizers.path("piece_bpe_32k.model")
    texts = fuzz(["ab", "cd", "é", " ", "中", "ing", "tion"], 60, 400, 3)
    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    machine = token_counts.Transducer(path)
    for _ in range(2):
        assert token_counts.count_column(pa.array(texts), machine)[1].tolist() == [len(x) for x in lib.encode(texts)]


def test_token_counts_of_a_frame(spark):
    df = spark.createDataFrame([(1, "hello world", 5), (None, None, 6), (1, "hello world", 7)], "doc_id long, text string, n_tokens int")
    got = token_counts.token_counts(df, public_tokenizers.path("piece_bpe_32k.model"), 1).collect()
    assert sorted((r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in got) == [(0, 0, 0, False), (1, 11, 3, True), (1, 11, 3, True)]


def test_chunk_ids_equal_the_library():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tok, own = Tokenizer.from_file(path), packing.ChunkIds(path)
    parts = ["a", "The", "ING", " ", "\n", "é", "ß", "中", "🙂", "́", "1", "'s", "'LL", ".", ", ", "!!", "<|endoftext|>", "<|ENDOFTEXT|>", "</w>", "\0", "\x1c", "\x85", " ", "Σ", "İ", "ﬁ", "a. ", "1, ", "€. "]
    texts = [t or "" for t in EDGE] + fuzz(parts, 600, 150, 2)
    got = own.of([t.encode() for t in texts])
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [e.ids for e in tok.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("seed", range(4))
def test_packing_places_all_tightly(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(1, 4097 if seed else 20, 3000 if seed else 500)
    bins, offs = packing.pack(lengths)
    order = np.lexsort((offs, bins))
    for b in np.unique(bins):
        mine = order[bins[order] == b]
        assert offs[mine].tolist() == (np.cumsum(lengths[mine]) - lengths[mine]).tolist() and lengths[mine].sum() <= 4096
    assert bins.max() + 1 <= -(-lengths.sum() // 4096) * 1.2 + 1


def test_two_unpacked_replace_the_smallest():
    bins, _ = packing.pack(np.array([6, 3, 2, 2, 1]), 10)
    assert len(set(bins.tolist())) == 2 and sorted(np.bincount(bins, [6, 3, 2, 2, 1]).tolist()) == [4.0, 10.0]
    bins, _ = packing.pack(np.array([]), 10)
    assert len(bins) == 0


def test_pieces_cover_documents(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    df = spark.createDataFrame([(1, "word " * 9000), (2, None), (3, ""), (2, "x")], "doc_id long, text string")
    rows = packing.best_two_fit(packing.pieces(df, path, 4096, True), 4).collect()
    one = sorted((r.piece, r.start, r.length) for r in rows if r.doc_id == 1)
    assert one == [(0, 0, 4096), (1, 4096, 4096), (2, 8192, 809)]
    assert all(zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length for r in rows)
    assert sorted(r.length for r in rows if r.doc_id != 1) == [1, 1, 2]


def figures(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    again = {j for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(again)


def test_quality_figures(spark, sf):
    texts = [t or "" for t in EDGE] + fuzz(["a", "b", "\n", " ", "é", "|", "# ", "\n\n", "\t", "a b a b a\n"], 500, 120, 5) + [r[0] for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in quality.judge(df).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == figures(texts[r.doc_id])
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert not (r.base_failed and r.kept)


def lines_of(text):
    """(punctuation, navigation, boilerplate) of each line with a word, rule by rule."""
    word, sep = re.compile(r"[^\x20\x09-\x0D]+"), set(quality.SEPARATORS)
    lines = [(x, word.findall(x)) for x in text.split("\n") if word.search(x)]
    short, seen, out = [], set(), []
    for line, ws in lines:
        n, chars = len(ws), sum(map(len, ws))
        p = 4 * len(re.findall(r"[#*$%&|<>]", line)) > chars or (n >= 5 and 2 * line.count("!") >= n)
        p |= ws[-1].endswith(("...", "…")) or (n >= 30 and not set(line) & set(quality.MARKS))
        seps = line.count("|") + sum(w in sep for w in ws)
        v = (seps >= 3 and 4 * seps >= n) or (seps >= 2 and 3 * seps >= n)
        v |= 2 * sum(len(w) for w in ws if re.match(r"https?://|www\.", w, re.I | re.A)) >= chars
        low = "".join(c.lower() if c.isascii() else c for c in line)
        out.append([p, v, line in seen or any(b in low for b in quality.BOILERPLATE)])
        seen.add(line)
        short.append(n - sum(w in set(quality.BULLETS) for w in ws) <= 3 and ws[-1][-1] not in quality.MARKS + quality.CLOSERS)
    for i, s in enumerate(short):
        a, b = i, i
        while s and a and short[a - 1]:
            a -= 1
        while s and b + 1 < len(short) and short[b + 1]:
            b += 1
        out[i][1] |= s and b - a >= 3
    return [sum(x[j] for x in out) for j in range(3)], sum(sum(map(len, w)) for (_, w), x in zip(lines, out) if any(x))


def test_line_rules_equal_a_plain_version(spark, sf):
    parts = ["a", "Home", "News item", "\n", "\n", "\n\n", " ", " ", " | ", " > ", " » ", "• ", "- ", "*", "!", ".", "...", "…", "…\n", "é", "。", "”", "http://x.org/a", " HTTPS://b", "www.", "wwwa", " ", "\t", "\r\n", "We use COOKIES", "TERMES", "mentions légales", "ſ", "w " * 31]
    parts += [b.upper() for b in quality.BOILERPLATE[::9]]
    texts = [t or "" for t in EDGE] + fuzz(parts, 1500, 40, 11) + ["w " * 30, "w " * 29, "a\nb\nc", "a\n\nb\nc c c\n• d", "…", "..", "a..", "we use", " cookies"]
    texts += [r[0] for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    for r in quality.judge(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(2)).collect():
        rules, lost = lines_of(texts[r.doc_id] or "")
        assert ([r.n_punctuation_lines, r.n_navigation_lines, r.n_boilerplate_lines], r.lost_chars) == (rules, lost), texts[r.doc_id]
        assert r.kept == (not r.base_failed and 100 * lost <= 50 * r.word_chars)


@pytest.mark.parametrize(
    "line",
    ["Home » News » Sport", "a | b | c | d", "Read on at https://news.example.org/2024/long-name", "Wir verwenden Cookies, um zu helfen.", "Voir la Politique de confidentialité.", "Todos los derechos reservados.", "And then it broke off...", "word " * 30],
)
def test_a_failing_line_of_each_kind_goes(spark, line):
    good = "A long sentence stands here, so that this text is kept whatever a single odd line may take away from it."
    more = "The next one is as long as that, since thirty words of the same kind would else weigh more than all others together, which is not what is looked at here."
    rows = [(1, f"{good}\n{line}\nA heading\n{more}")]
    assert quality.judge(spark.createDataFrame(rows, "doc_id long, text string")).first().lost_chars == len("".join(line.split()))
    if not line.startswith("word"):  # thirty equal words fail the base rule
        assert quality.clean(spark.createDataFrame(rows, "doc_id long, text string")).first().text == f"{good}\nA heading\n{more}"


def test_cleaning_removes_lines(spark):
    good = "one two three four five six seven eight nine ten eleven twelve thirteen"
    more = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    rows = [(1, f"{good}\na | b | c | d\nwe use cookies here\n{more}\nend\nend", "k"), (2, "a | b | c | d | e\n" * 9, "k"), (3, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept string")
    assert [tuple(r) for r in quality.clean(df).collect()] == [(1, f"{good}\n{more}\nend\n", "k")]


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def base(t):
    out = []
    for kind, pattern in (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(pattern, t):
            g, d = m.group(), re.sub("[^0-9]", "", m.group())
            if {"email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in g.split(".")), "card": lambda: 13 <= len(d) <= 19 and luhn(d), "phone": lambda: 9 <= len(d) <= 15}[kind]():
                out.append((kind, m.start(), m.end()))
    return out


def test_base_spans(spark):
    parts = ["a", "b.", "@", "é", "🙂", " ", "-", "+", "1", "23", "4111 1111 1111 1111", "4111-1111-1111-1111", "192.168.0.1", "256.1.1.1", "001.2.3.4", "(", ")", ".", "+1 (743) 555-3824", "x@y.com", "_", "%", "\n", "a@b", "a@b.c_d@e.f", "1.2.3.4.5.6.7.8"]
    texts = [t or "" for t in EDGE] + fuzz(parts, 700, 40, 6) + ["1" * 20000, "a" * 40000, "1 " * 9000, "a@b" + ".c" * 9000, "+1" + " " * 9000, "4 1 1 1 1 1 1 1 1 1 1 1 1 1 1 1"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pii.report(df).collect():
        want = base(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join("%s:%d:%d" % s for s in want).encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == s[0] for s in want) for k in pii.BASE)
        assert r.spans.startswith(",".join("%s:%d:%d" % s for s in want))


def test_added_kinds_and_context(spark):
    rows = [(1, "IBAN GB82WEST12345698765432 here"), (2, "IBAN GB82WEST12345698765433 here"), (3, "phone 030 1234 5678"), (4, "order 030 1234 5678"), (5, "invoice DE89 3704 0044 0532 0130 00")]
    got = {r.doc_id: r.spans for r in pii.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert "iban:5:27" in got[1] and "iban" not in got[2] and "national_phone:6:19" in got[3] and "national" not in got[4] and "iban" not in got[5]


def test_added_kinds_end_before_what_follows(spark):
    iban = ["DE89370400440532013000", "DE89 3704 0044 0532 0130 00", "GB82 WEST 1234 5698 7654 32"]
    after = ["", ".", " Please pay", " Bitte", " BY FRIDAY", " 12 times", ", DE", "\nX", " A"]
    phone = ["", ".", " - home", ". Then", "- or"]
    texts = [f"IBAN {i}{a}" for i in iban for a in after] + [f"IBAN AB12 {i}" for i in iban] + [f"call 030 1234 5678{a}" for a in phone] + ["call 030 1234 5678.9", "call 030 1234 5678-a", "call 030 1234 5678 12345"]
    want = [["[IBAN]"]] * 30 + [["[NATIONAL_PHONE]"]] * 5 + [[], [], ["[NATIONAL_PHONE]"]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.text for r in pii.redact(df).collect()}
    for i, t in enumerate(texts):
        assert re.findall(r"\[[A-Z_]+\]", got[i]) == want[i], (t, got[i])
    assert got[4] == "IBAN [IBAN] BY FRIDAY" and got[31] == "call [NATIONAL_PHONE]."


def test_redaction(spark):
    df = spark.createDataFrame([(1, "mail x@y.com or +1 (743) 555-3824 🙂 4111 1111 1111 1111.", "s"), (2, None, "s"), (3, "none", None)], "doc_id long, text string, pii_email string")
    got = pii.redact(df)
    assert got.columns == df.columns
    assert {r.doc_id: r.text for r in got.collect()} == {1: "mail [EMAIL] or [PHONE] 🙂 [CARD].", 2: None, 3: "none"}


@pytest.mark.parametrize("seed", range(2))
def test_many_matches_in_groups_and_pieces(spark, monkeypatch, seed):
    rng = random.Random(seed)
    bits = ["a@b.com", "ü", "x", "10.0.0.1", "4111 1111 1111 1111", "+1 743 555 3824", "iban DE89370400440532013000", "tel 030 1234 5678", "order 030 1234 5678", "🙂", " ", "\n", "word " * 9]
    texts = ["".join(rng.choice(bits) + rng.choice(["", " ", ", "]) for _ in range(rng.choice([0, 1, 40, 200]))) for _ in range(30)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(99, None)], "doc_id long, text string")
    want = {r.doc_id: r for r in pii.report(df).collect()}
    cut = {}
    for i, t in enumerate(texts):
        ends, out = 0, []
        for kind, a, b in sorted((x.split(":") for x in want[i].spans.split(",") if x), key=lambda x: (int(x[1]), -int(x[2]), list(pii.PATTERNS).index(x[0]))):
            if int(a) >= ends:
                out += [t[ends : int(a)], f"[{kind.upper()}]"]
            ends = max(ends, int(b))
        cut[i] = "".join(out) + t[ends:]
    for group, piece in ((256, 4096), (3, 16)):
        monkeypatch.setattr(pii, "GROUP", group)
        monkeypatch.setattr(pii, "PIECE", piece)
        assert {r.doc_id: r for r in pii.report(df).collect()} == want
        assert {r.doc_id: r.text for r in pii.redact(df).collect()} == cut | {99: None}


def test_lines_and_words_of_a_simple_pattern_are_told_apart(spark):
    """Thue-Morse lines and their complements have equal sums of powers modulo 2^64."""
    line = "".join("ab"[bin(i).count("1") % 2] for i in range(2048))
    other = line.translate(str.maketrans("ab", "ba"))
    texts = [f"{line}\n{other}\n{line}", f"{line} {other} " * 8]
    got = quality.judge(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == figures(texts[r.doc_id])


def test_empty_tables_and_clashing_names(spark):
    df = spark.createDataFrame([(1, "some words here")], "doc_id long, text string").selectExpr("*", *(f"'x' as {c}" for c in ("n_tokens", "grp", "length", "kept", "n_words", "spans", "bin")))
    path, model = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")
    for make in (lambda d: packing.best_two_fit(packing.pieces(d, path), packing.most_pieces(d)), lambda d: token_counts.token_counts(d, model), quality.judge, pii.report):
        assert make(df).count() == 1 and make(df.where("false")).count() == 0


def test_groups_grow_with_pieces_not_documents(spark):
    df = spark.createDataFrame([(1, "é" * 10_000), (2, None), (3, "x")], "doc_id long, text string")
    assert packing.most_pieces(df) == 3 + 20_000 // 4096


@pytest.mark.parametrize("seed", range(3))
def test_number_of_sequences_is_near_the_least(seed):
    lengths = np.minimum(4096, np.random.default_rng(seed).lognormal(5.5, 1.2, 20_000).astype(np.int64) + 1)
    bins, _ = packing.pack(lengths)
    assert bins.max() + 1 <= -(-lengths.sum() // 4096) * 1.005 + 1


@pytest.mark.parametrize("chunk,lanes", [(1, 5), (3, 7), (8, 64), (256, 2)])
def test_state_maps_compose_over_chunks_of_any_size(monkeypatch, chunk, lanes):
    """Words that span many chunks, whose states meet late or never, and blocks that end inside a text."""
    monkeypatch.setattr(token_counts, "CHUNK", chunk)
    monkeypatch.setattr(token_counts, "LANES", lanes)
    path = public_tokenizers.path("piece_bpe_32k.model")
    texts = ["ab" * 300, "x" * 700, "=" * 333, "aaab" * 90, "the" * 150, "e" * 17 + " " * 40 + "é" * 60, "", "a", "中文字" * 50] + fuzz(["a", "b", "ab", " ", "th", "e", "é", "\n", "==", "▁"], 60, 90, 3)
    codes = [np.frombuffer(t.encode("utf-32-le"), np.uint32) for t in texts]
    starts = np.concatenate(([0], np.cumsum([len(c) for c in codes])))
    library = sentencepiece.SentencePieceProcessor(model_file=str(path))
    got = token_counts.Transducer(path).count(np.concatenate(codes), starts)
    assert got.tolist() == [len(library.encode(t)) for t in texts]


def test_the_table_starts_anew_inside_a_long_text(monkeypatch):
    monkeypatch.setattr(token_counts, "CHUNK", 8)
    monkeypatch.setattr(token_counts, "LANES", 16)
    monkeypatch.setattr(token_counts, "TABLE_CELLS", 1)
    path = public_tokenizers.path("piece_bpe_32k.model")
    text = " ".join(fuzz(["a", "b", "ab", "th", "e", "é", "q", "x"], 200, 30, 4))
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    machine = token_counts.Transducer(path)
    assert machine.count(codes, np.array([0, len(codes)])).tolist() == [len(sentencepiece.SentencePieceProcessor(model_file=str(path)).encode(text))]
