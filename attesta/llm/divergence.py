"""Source divergence audit: how far each source's terms lie from those of the other sources of its language.

The distance of two sources is a sum over all kept terms of the language, of which most occur in
one of the two or in neither.  It is taken by inclusion and exclusion over the supports, so work
follows the terms that occur: histograms of counts price each source's terms against the other's
price of an absent term, as if no term were in both; a join of the postings of a term corrects
the pairs that both hold; and terms that neither holds are a count times one constant.

Null text, lang and source are empty strings, and each row is a document, repeated ones too.
A language without kept terms has distances of 0.  Other columns are not read.  All arithmetic is on whole
numbers, exact for totals of under 9e15 terms.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attesta.operators.ordered import placed

from . import work

#: Documents of a language in which a term is kept, the scale of prices, and ranks of terms that are reported.
LEAST_DOCS, SCALE, TOP = 10, 1_000_000_000, 10
#: Counters that a task holds, bytes of a text that are split at a time, sources of a block, and postings of a task's block.
COUNTERS, CHUNK, BLOCK, POSTINGS = 200_000, 1 << 20, 256, 200_000

#: Bytes as terms see them: A-Z in lower case, other ASCII but a-z as spaces, the rest as it is.
TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms(text: str):
    """Lists of the terms of a text, in UTF-8, about CHUNK bytes of it at a time."""
    data = text.encode().translate(TERM_BYTES)
    at = 0
    while at < len(data):
        end = data.find(b" ", at + CHUNK)
        end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end


def counted(documents: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs) of all texts, summed within tasks only."""
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])

    def told(groups):
        for (lang, source), (n, docs) in groups.items():
            size = len(n)
            yield pa.record_batch([pa.array([lang] * size, pa.string()), pa.array([source] * size, pa.string()), pa.array(list(n), pa.binary()).cast(pa.string()), pa.array(list(n.values()), pa.int64()), pa.array([docs[t] for t in n], pa.int64())], schema=schema)

    def run(batches):
        groups: dict[tuple, tuple[Counter, Counter]] = {}
        held = 0
        for batch in batches:
            for lang, source, text in zip(*(batch.column(c) for c in ("lang", "source", "text"))):
                n, docs = groups.setdefault((lang.as_py(), source.as_py()), (Counter(), Counter()))
                before, seen = len(n), set()
                for words in terms(text.as_py()):
                    n.update(words)
                    seen.update(words)
                docs.update(seen)
                held += len(n) - before
                if held > COUNTERS:
                    yield from told(groups)
                    groups, held = {}, 0
        yield from told(groups)

    rows = documents.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")))
    return rows.mapInArrow(work.tidy(run), "lang string, source string, term string, n long, docs long")


def kept_terms(counts: DataFrame) -> DataFrame:
    """(lang, source, term, n, lang_n, lead) of the terms in LEAST_DOCS documents of their language; one row of each term leads."""
    sums = counts.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    each = Window.partitionBy("lang", "term")
    sums = sums.withColumns({"lang_n": F.sum("n").over(each), "in_docs": F.sum("docs").over(each), "lead": F.row_number().over(each.orderBy("source")) == 1})
    return sums.where(F.col("in_docs") >= LEAST_DOCS).drop("docs", "in_docs")


def price(n: Column, total: Column, v: Column) -> Column:
    """1 + floor(SCALE (n + 2) / (total + 2 v)), null without kept terms."""
    wide = lambda c: c.cast("decimal(20,0)")
    return F.when(v > 0, F.call_function("div", wide(n + 2) * F.lit(SCALE), wide(total + 2 * v)) + 1)


def apart(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)) of two prices, each of 1e9 + 1 at most."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def priced(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Groups (lang, source, gid, total, terms, v, p0), their postings (lang, source, gid, term, n, p, p0, q).

    gid numbers the groups by (lang, source); p is the group's price of the term, p0 of an
    absent one, q the language's.
    """
    postings = work.cut(kept_terms(counted(documents)), "postings")
    langs = postings.groupBy("lang").agg(F.count_if("lead").alias("v"), F.sum("n").alias("lang_total"))
    sizes = postings.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("terms"))
    every = documents.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source")).distinct()
    groups = every.join(sizes, ["lang", "source"], "left").join(langs, "lang", "left").fillna(0, ["total", "terms", "v", "lang_total"])
    groups = placed(groups, F.struct("lang", "source"), [], "gid", write=work.cut)
    groups = work.cut(groups.withColumn("p0", price(F.lit(0).cast("long"), F.col("total"), F.col("v"))), "groups")
    known = work.small_or_not(groups, groups.count(), 256)
    rows = postings.join(known.drop("terms"), ["lang", "source"])
    rows = rows.withColumns({"p": price(F.col("n"), F.col("total"), F.col("v")), "q": price(F.col("lang_n"), F.col("lang_total"), F.col("v"))})
    return groups, work.cut(rows.select("lang", "source", "gid", "term", "n", "p", "p0", "q"), "priced")


def shared(table: pa.Table) -> pa.Table:
    """(lang, a, b, value): what terms that both hold add to the sum as if none were shared, for the pairs of two blocks of sources.

    Postings are ordered by term and source, and each meets the k-th after it for k = 1, 2 and
    so on while these are of one term, so a pair is met once a term and nothing else is.
    """
    low, high = table.column("low")[0].as_py(), table.column("high")[0].as_py()
    term = table.column("term").combine_chunks().dictionary_encode().indices.to_numpy()
    gid, p, p0 = (table.column(c).to_numpy() for c in ("gid", "p", "p0"))
    order = np.lexsort((gid, term))
    term, gid, p, p0 = term[order], gid[order], p[order], p0[order]
    ids, at = np.unique(gid, return_inverse=True)
    block = gid // BLOCK
    starts, k = np.arange(len(term)), 0
    f = lambda x, y: (x - y) ** 2 // (x + y)
    total = np.zeros(len(ids) ** 2, np.int64)
    while True:
        k += 1
        starts = starts[starts + k < len(term)]
        starts = starts[term[starts] == term[starts + k]]
        if not len(starts):
            break
        i = starts[(block[starts] == low) & (block[starts + k] == high)]
        j = i + k
        value = f(p[i], p[j]) - f(p[i], p0[j]) - f(p0[i], p[j]) + f(p0[i], p0[j])
        pair = at[i] * len(ids) + at[j]
        # whole numbers under 2^53 in each sum: floats add them exactly
        total += np.bincount(pair, value, minlength=len(total)).astype(np.int64)
    some = np.flatnonzero(total)
    lang = pa.array([table.column("lang")[0].as_py()] * len(some), pa.string())
    return pa.table({"lang": lang, "a": ids[some // len(ids)], "b": ids[some % len(ids)], "value": total[some]})


def distances(groups: DataFrame, postings: DataFrame) -> DataFrame:
    """(lang, a, b, value) of the groups a < b of one language, by inclusion and exclusion over their terms."""
    two = lambda n: groups.select("lang", F.col("gid").alias(n), F.col("p0").alias(f"p0_{n}"), F.col("terms").alias(f"terms_{n}"), "v")
    neither = two("a").join(two("b").drop("v"), "lang").where("a < b")
    neither = neither.select("lang", "a", "b", F.coalesce((F.col("v") - F.col("terms_a") - F.col("terms_b")) * apart(F.col("p0_a"), F.col("p0_b")), F.lit(0)).alias("value"))

    counts = postings.groupBy("lang", "gid", "p").agg(F.count("*").alias("k"))
    others = groups.select("lang", F.col("gid").alias("other"), F.col("p0").alias("p0_other"))
    one = counts.join(others, "lang").where("gid <> other")
    one = one.select("lang", F.least("gid", "other").alias("a"), F.greatest("gid", "other").alias("b"), (F.col("k") * apart(F.col("p"), F.col("p0_other"))).alias("value"))

    parts = max(1, -(-postings.count() // POSTINGS))
    ends = groups.groupBy("lang").agg(F.expr(f"min(gid) div {BLOCK}").alias("first"), F.expr(f"max(gid) div {BLOCK}").alias("last"))
    rows = postings.join(work.small_or_not(ends, ends.count(), 128), "lang").withColumn("block", F.expr(f"gid div {BLOCK}"))
    rows = rows.withColumn("with", F.explode(F.sequence("first", "last"))).withColumn("part", F.pmod(F.xxhash64("term"), F.lit(parts)))
    rows = rows.select("lang", "part", F.least("block", "with").alias("low"), F.greatest("block", "with").alias("high"), "term", "gid", "p", "p0")

    both = rows.groupBy("lang", "part", "low", "high").applyInArrow(shared, "lang string, a long, b long, value long")
    return neither.union(one).union(both).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def audit(documents: DataFrame) -> DataFrame:
    """(lang, source, part, item, value, rank): distances to the other sources, and the terms most in excess."""
    groups, postings = priced(documents)
    pairs = work.cut(distances(groups, postings), "distances")
    both = pairs.union(pairs.select("lang", F.col("b"), F.col("a"), "value"))
    name = lambda n, c: work.small_or_not(groups.select(F.col("gid").alias(n), F.col("source").alias(c)), known, 128)
    known = groups.count()
    both = both.join(name("a", "source"), "a").join(name("b", "item"), "b").select("lang", "source", "item", "value")
    excess = postings.where("p > q").select("lang", "source", F.col("term").alias("item"), apart(F.col("p"), F.col("q")).alias("value"))
    place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    names = ["lang", "source", "part", "item", "value", "rank"]
    ranked = lambda rows, part: rows.withColumns({"part": F.lit(part), "rank": place}).select(*names)
    return ranked(both, "pair").union(ranked(excess, "term").where(F.col("rank") <= TOP))


def op11_source_divergence(spark, sf_dir: str) -> DataFrame:
    """Distances and terms of all sources of ``documents``."""
    with work.scope() as made:
        out = work.cut(audit(work.table(spark, sf_dir, "documents")), "audit")
        made.remove(out)
    return out


OP11_SQL = """
with d as (select row_number() over () as id, coalesce(lang, '') as lang, coalesce(source, '') as source, coalesce(text, '') as text from documents),
t as (select id, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as term from d),
k as (select lang, term, count(*) as lang_n from t group by 1, 2 having count(distinct id) >= 10),
g as (select distinct lang, source from d),
c as (select lang, source, term, count(*) as n from t semi join k using (lang, term) group by 1, 2, 3),
v as (select lang, count(*) as v, sum(lang_n) as total from k group by 1),
s as (select lang, source, sum(n) as total from c group by 1, 2),
x as (select g.lang, g.source, k.term, coalesce(n, 0) as n, 1 + 1000000000::hugeint * (coalesce(n, 0) + 2) // (coalesce(s.total, 0) + 2 * v.v)::hugeint as p, 1 + 1000000000::hugeint * (lang_n + 2) // (v.total + 2 * v.v)::hugeint as q
   from g join k using (lang) join v using (lang) left join c using (lang, source, term) left join s using (lang, source)),
pair as (select g.lang, g.source, o.source as item, coalesce(value, 0) as value from g join g o on g.lang = o.lang and g.source <> o.source
   left join (select a.lang, a.source, b.source as item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) as value from x a join x b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by 1, 2, 3) y on y.lang = g.lang and y.source = g.source and y.item = o.source),
r as (select lang, source, 'pair' as part, item, value::bigint as value, (row_number() over (partition by lang, source order by value desc, item))::int as rank from pair
 union all select * from (select lang, source, 'term', term, (((p - q) * (p - q)) // (p + q))::bigint as value, (row_number() over (partition by lang, source order by ((p - q) * (p - q)) // (p + q) desc, term))::int as rank from x where n > 0 and p > q) where rank <= 10)
select * from r
"""
