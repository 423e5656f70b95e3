"""Prefix trie of conversations: one row for each distinct sequence of first turns.

A node is known by its depth and a key of 128 bits: the XOR of two hashes of each
(place, turn) from the top.  Such keys add up in any order, so a conversation may lie
in many tasks.  Tasks combine the node tables of their rows (Spark's map-side
aggregation), which hash-keyed merges then sum in rounds, ``FAN_IN`` slots of neighbouring
conversations at a time, so that a node that all conversations share gets few rows in each.
Sums over subtrees go the same way: each node is told once, in the path of its smallest
member, and each conversation adds what lies at or below its turns.

Rows without conv_id take no part.  Turns of one conversation that tie are ordered by a hash of
their role and text; repeated rows are turns of their own.  Keys are exact up to collisions of
128 bits.  Columns beside conv_id, turn, role and text are not read.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from attesta.operators.ordered import placed

from . import work

#: Turns of one conversation that a task sees together, rows of neighbouring conversations in
#: a slot, and slots that a merge round sums.
PIECE, SLOT_ROWS, FAN_IN = 1024, 16_384, 4096
#: A rebuilt conversation opens with fewer turns than this of the first one of its hundred.
SHARED = 6

NODE = ["depth", "k1", "k2"]


def numbered(conversations: DataFrame) -> DataFrame:
    """(conv_id, place, t, length, slot): turns from 1 in order, with a digest and the text's code points.

    Only digests are shuffled.  Places come from one order of all rows, so turns of one
    conversation need not meet; ``slot`` grows with conv_id and holds SLOT_ROWS of its conversations at most.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    told = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.unhex(F.md5(told.cast("binary"))).alias("t"), F.char_length(text).cast("long").alias("length"))
    order = F.struct("conv_id", F.col("turn").isNotNull().alias("told"), "turn", "t")
    rows = placed(rows, order, [], "at", write=work.cut).drop("turn")
    first = rows.groupBy("conv_id").agg(F.min("at").alias("first"))
    got = rows.join(first, "conv_id")
    return got.select("conv_id", (F.col("at") - F.col("first") + 1).alias("place"), "t", "length", F.expr(f"(first - 1) div {SLOT_ROWS}").alias("slot"))


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The conversations (conv_id, slot, turns) and rows (conv_id, slot, turns, depth, t, length) as
    they are rebuilt: the first turns of the hundred's first conversation, then their own others."""
    convs = turns.groupBy("conv_id", "slot").agg(F.count("*").alias("n"))
    convs = convs.withColumn("base", F.col("conv_id") - F.col("conv_id") % 100)
    convs = convs.withColumn("h", F.crc32(F.col("conv_id").cast("string").cast("binary")) % SHARED)
    bases = convs.where("conv_id = base").select("base", F.least("n", F.lit(SHARED)).alias("has"))
    convs = convs.join(bases, "base", "left").withColumn("open", F.least("h", F.coalesce("has", F.lit(0))))
    convs = work.cut(convs.withColumn("turns", F.col("open") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).select("conv_id", "slot", "base", "h", "open", "turns"), "convs")
    own = turns.drop("slot").join(convs, "conv_id").where("place > h").withColumn("depth", F.col("open") + F.col("place") - F.col("h"))
    heads = turns.where(f"place < {SHARED} and conv_id % 100 = 0").select(F.col("conv_id").alias("base"), F.col("place").alias("depth"), "t", "length")
    opened = convs.where("open > 0").join(heads, "base").where("depth <= open")
    names = ["conv_id", "slot", "turns", "depth", "t", "length"]
    return convs.select("conv_id", "slot", "turns"), own.select(*names).union(opened.select(*names))


def scanned(rows: DataFrame, value: str, total, join, back: bool = False) -> Column | DataFrame:
    """``value`` of each row as summed by ``total`` and ``join`` over its conversation up to it (``back``: from it on).

    Pieces of PIECE turns are summed each by a window, and the sums of the pieces of long
    conversations by another one over pieces alone.
    """
    rows = rows.withColumn("piece", F.expr(f"(depth - 1) div {PIECE}"))
    by = lambda c: F.desc(c) if back else F.asc(c)
    pieces = rows.where(F.col("turns") > PIECE).groupBy("conv_id", "piece").agg(total(value).alias("whole"))
    others = pieces.select("conv_id", "piece", total("whole").over(Window.partitionBy("conv_id").orderBy(by("piece")).rowsBetween(Window.unboundedPreceding, -1)).alias("others"))
    inside = total(value).over(Window.partitionBy("conv_id", "piece").orderBy(by("depth")).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn(value, inside).join(others, ["conv_id", "piece"], "left").withColumn(value, join(F.col(value), F.coalesce("others", F.lit(0)))).drop("piece", "others")


def keyed(rows: DataFrame) -> DataFrame:
    """Adds the node of each row, k1 and k2, and its parent's, p1 and p2."""
    rows = rows.withColumns({"g1": F.xxhash64(F.lit(1), "depth", "t"), "g2": F.xxhash64(F.lit(2), "depth", "t")}).drop("t")
    for n in ("1", "2"):
        rows = scanned(rows.withColumn(f"k{n}", F.col(f"g{n}")), f"k{n}", F.bit_xor, lambda a, b: a.bitwiseXOR(b))
    return rows.withColumns({"p1": F.col("k1").bitwiseXOR(F.col("g1")), "p2": F.col("k2").bitwiseXOR(F.col("g2"))}).drop("g1", "g2")


def merged(tables: DataFrame, slots: int, **how) -> DataFrame:
    """Partial node tables (NODE, slot, ...) merged by node in rounds; ``how`` has each column's aggregate."""
    while True:
        slots = -(-slots // FAN_IN)
        tables = tables.withColumn("slot", F.expr(f"slot div {FAN_IN}")).groupBy(*NODE, "slot").agg(*(f(c).alias(c) for c, f in how.items()))
        if slots <= 1:
            return tables.drop("slot")


def end_digests(ends: DataFrame) -> DataFrame:
    """(NODE, ends_sha256) of rows (NODE, slot, conv_id).

    Slots' lists are sorted in one row each, of SLOT_ROWS ids at most.  A node's lists are hashed in order as they
    are read, so a task holds one list; the hash itself has to see a node's ids one after another.
    """
    lists = ends.groupBy(*NODE, "slot").agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids"))

    def run(batches):
        node, state = None, None
        for batch in batches:
            done: list[tuple] = []
            d, a, b, ids = (batch.column(c).to_pylist() for c in (*NODE, "ids"))
            for key, more in zip(zip(d, a, b), ids):
                if key == node:
                    state.update(b"," + more.encode())
                    continue
                if node is not None:
                    done.append((*node, state.hexdigest()))
                node, state = key, hashlib.sha256(more.encode())
            yield pa.RecordBatch.from_pylist([dict(zip((*NODE, "ends_sha256"), r)) for r in done], SHA_SCHEMA)
        if node is not None:
            yield pa.RecordBatch.from_pylist([dict(zip((*NODE, "ends_sha256"), (*node, state.hexdigest())))], SHA_SCHEMA)

    return lists.repartition(*NODE).sortWithinPartitions(*NODE, "slot").mapInArrow(work.tidy(run), "depth long, k1 long, k2 long, ends_sha256 string")


SHA_SCHEMA = pa.schema([("depth", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("ends_sha256", pa.string())])


def trie(convs: DataFrame, rows: DataFrame) -> DataFrame:
    """Nodes of rebuilt conversations, as op13 returns them; convs and rows as ``rebuilt`` gives them.

    Without conversations there are no nodes; conversations without turns are members of the root alone.
    """
    slots = (convs.agg(F.max("slot")).first()[0] or 0) + 1
    rows = work.cut(keyed(rows), "keyed")
    none = F.lit(0).cast("long")
    root = convs.select("conv_id", "slot", "turns", *(none.alias(c) for c in ("depth", "length", "k1", "k2")), *(F.lit(None).cast("long").alias(c) for c in ("p1", "p2")))
    members = rows.unionByName(root)
    ended = (F.col("depth") == F.col("turns")).cast("long")
    nodes = members.select(*NODE, "slot", F.col("conv_id"), "p1", "p2", "length", F.lit(1).cast("long").alias("n_convs"), ended.alias("ends"))
    nodes = work.cut(merged(nodes, slots, conv_id=F.min, p1=F.max, p2=F.max, length=F.max, n_convs=F.sum, ends=F.sum), "nodes")

    # Each node is told in the path of its smallest member, and summed from there upwards.
    told = nodes.where("depth > 0").select("conv_id", "depth", ((F.col("n_convs") - 1) * F.col("length")).alias("saved"), (F.col("ends") == F.col("n_convs")).cast("long").alias("leaves"))
    paths = rows.select("conv_id", "slot", "turns", *NODE).join(told, ["conv_id", "depth"], "left").fillna(0, ["saved", "leaves"])
    for c in ("saved", "leaves"):
        paths = scanned(paths, c, F.sum, lambda a, b: a + b, back=True)
    paths = paths.where("saved > 0 or leaves > 0").select(*NODE, "slot", "saved", "leaves")
    tops = paths.where("depth = 1").select(*(none.alias(c) for c in NODE), "slot", "saved", "leaves")
    below = merged(paths.union(tops), slots, saved=F.sum, leaves=F.sum)

    up = [(F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2")]
    children = nodes.where("depth > 0").select(*up).groupBy(*NODE).agg(F.count("*").alias("n_children"))
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    ends = end_digests(members.where("depth = turns").select(*NODE, "slot", "conv_id"))
    got = nodes.join(parents, ["depth", "p1", "p2"], "left").join(children, NODE, "left").join(below, NODE, "left").join(ends, NODE, "left")
    number = lambda c, least: F.greatest(F.coalesce(c, F.lit(0)), F.lit(least)).cast("long").alias
    return got.select("conv_id", "depth", "parent_conv_id", "n_convs", number("n_children", 0)("n_children"), number("leaves", 1)("n_leaves"), number("saved", 0)("saved_tokens"), F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"))


def op13_prefix_trie(spark, sf_dir: str) -> DataFrame:
    """A row a node over all of ``conversations``."""
    with work.scope() as made:
        out = work.cut(trie(*rebuilt(work.cut(numbered(work.table(spark, sf_dir, "conversations")), "turns"))), "trie")
        made.remove(out)
    return out


#: crc32 is spelt out bit by bit, as DuckDB has none.
OP13_SQL = """
with recursive crc as (select conv_id, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(conv_id::varchar, ''), lambda x: ascii(x)::bigint)),
   lambda a, x: list_reduce([xor(a, x), 0, 0, 0, 0, 0, 0, 0, 0], lambda y, z: xor(y >> 1, 3988292384 * (y & 1)))), 4294967295) % 6 as h from (select distinct conv_id from conversations where conv_id is not null)),
n as (select conv_id, row_number() over (partition by conv_id order by turn nulls first, role, text) as i, struct_pack(r := coalesce(role, ''), t := coalesce(text, '')) as x from conversations where conv_id is not null),
r as (select c.conv_id, row_number() over (partition by c.conv_id order by own, i) as d, x from (
   select crc.conv_id, 0 as own, i, x from crc join n on n.conv_id = crc.conv_id - crc.conv_id % 100 where i <= h
   union all select crc.conv_id, 1, i, x from crc join n using (conv_id) where i > h) c),
whole as (select conv_id, coalesce(xs, []) as xs from crc left join (select conv_id, list(x order by d) as xs from r group by 1) using (conv_id)),
m as (select conv_id, len(xs) as size, unnest(generate_series(0, len(xs))) as depth, xs from whole),
k as (select conv_id, size, depth, xs[1:depth] as key, xs[1:depth - 1] as up, case when depth > 0 then length(xs[depth].t) else 0 end as chars from m),
node as (select key, depth, min(conv_id) as conv_id, count(*) as n_convs, (count(*) - 1) * any_value(chars) as saved, any_value(up) as up,
   sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (where size = depth), '')) as ends_sha256 from k group by 1, 2),
kid as (select up as key, depth - 1 as depth, count(*) as n_children from node where depth > 0 group by 1, 2),
whole_node as (select node.*, coalesce(n_children, 0) as n_children from node left join kid using (key, depth)),
under as (select a.key, a.depth, sum(b.saved) as saved_tokens, count(*) filter (where b.n_children = 0) as n_leaves from whole_node a join whole_node b on b.depth >= a.depth and b.key[1:a.depth] = a.key group by 1, 2)
select w.conv_id::bigint as conv_id, w.depth::bigint as depth, p.conv_id::bigint as parent_conv_id, w.n_convs::bigint as n_convs, w.n_children::bigint as n_children, u.n_leaves::bigint as n_leaves, u.saved_tokens::bigint as saved_tokens, w.ends_sha256
from whole_node w join under u using (key, depth) left join whole_node p on p.depth = w.depth - 1 and p.key = w.up and w.depth > 0
"""
