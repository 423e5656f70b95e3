"""The conversation trie against a plain one."""

import hashlib
import random
import zlib

import duckdb
import pytest

from attesta.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string"


def plain(rows):
    """Nodes of a dict of lists, as tuples in the order of the query's columns."""
    own = {}
    for c, _, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0)):
        own.setdefault(c, []).append((role or "", text or ""))
    members, ends = {}, {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        turns = own.get(c - c % 100, [])[:h] + turns[h:]
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
        ends.setdefault(tuple(turns), []).append(c)
    kids = {k: 0 for k in members}
    for k in members:
        if k:
            kids[k[:-1]] += 1
    leaves, saved = dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for k in sorted(members, key=len, reverse=True):
        leaves[k] = leaves[k] or 1
        saved[k] += (len(members[k]) - 1) * len(k[-1][1]) if k else 0
        if k:
            leaves[k[:-1]] += leaves[k]
            saved[k[:-1]] += saved[k]
    sha = lambda k: hashlib.sha256(",".join(map(str, sorted(ends.get(k, [])))).encode()).hexdigest()
    return sorted(repr((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), kids[k], leaves[k], saved[k], sha(k))) for k, m in members.items())


def run(df):
    return sorted(repr(tuple(r)) for r in trie.trie(*trie.rebuilt(trie.numbered(df))).collect())


def some(rng, n):
    """Conversations with common openings, null turns, roles and texts, and long ones."""
    rows = []
    for c in rng.sample(range(0, 400), n):
        for t in range(rng.choice([1, 1, 2, 3, 6, 9, 40])):
            rows.append((c, None if t == 0 and c % 5 == 0 else t, rng.choice(["user", "assistant", None]), rng.choice(["", None, "a", "bé", "long text " * 30])))
    return rows


@pytest.mark.parametrize("seed", range(2))
def test_trie_is_that_of_a_plain_one(spark, monkeypatch, seed):
    if seed:  # pieces, slots and rounds as on large tables
        monkeypatch.setattr(trie, "PIECE", 4)
        monkeypatch.setattr(trie, "SLOT_ROWS", 5)
        monkeypatch.setattr(trie, "FAN_IN", 3)
    rows = some(random.Random(seed), 90)
    rows += [(c, t, "user", "same") for c in range(1000, 1040) for t in range(4)] + [(None, 0, "user", "x"), (7_000_000_000_000_000_001, 3, "user", "far")]
    rng = random.Random(9)
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA + ", slot int, depth string").repartition(5)
    assert run(df) == plain(rows)


def test_odd_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert trie.trie(*trie.rebuilt(trie.numbered(empty))).count() == 0
    # 13 has no turns left where its hundred's first conversation is absent: a member of the root alone
    gone = next(c for c in range(1, 100) if zlib.crc32(str(c).encode()) % 6 > 1)
    assert run(spark.createDataFrame([(gone, 0, "user", "x")], SCHEMA)) == plain([(gone, 0, "user", "x")]) and len(plain([(gone, 0, "user", "x")])) == 1
    # repeated rows are turns of their own; ties have one order
    twice = [(100, 0, "user", "x"), (100, 0, "user", "x"), (100, 0, "bot", "y")]
    a, b = (run(spark.createDataFrame(x, SCHEMA)) for x in (twice, twice[::-1]))
    assert a == b and len(a) == 4


def test_sql_is_that_of_a_plain_one(spark, sf):
    con = duckdb.connect()
    con.sql(f"create view conversations as select * from '{sf}/conversations.parquet'")
    rows = con.sql("select conv_id, turn, role, text from conversations").fetchall()
    got = trie.op13_prefix_trie(spark, sf)
    assert sorted(repr(tuple(r)) for r in got.collect()) == plain(rows)
    assert sorted(map(repr, con.sql(trie.OP13_SQL).fetchall())) == plain(rows)
