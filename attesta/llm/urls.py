"""URL filters: a blocked Bloom filter ahead of an exact hash join.

``listed`` canonical URLs are dealt into 256-bit blocks (four longs) by one
hash; four bits of the block, one in each long, come from another.  The filter
is a DataFrame with one row per block, of MOST_BLOCKS at most, so building it is one pre-aggregated
``bit_or`` and probing it a broadcast join on the block number.  What passes goes to
an exact join with the list, which removes the false positives.  All other pages
stay where they were read.

Null urls, and those without ``://``, have an empty host and path, fit no rule
and are allowed.  Repeated page rows stay repeated; an empty list allows all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import work

BITS_PER_KEY = 16
#: Blocks of any filter at most: 64 bytes each, so that a filter is always broadcast.
MOST_BLOCKS = work.BROADCAST_BYTES // 64
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Rules of the query (host, path) and their verdicts.
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)

#: Kinds of listed sites of the query, and the domains they are under.
KINDS = ("adult-x", "ads-track", "casino-win", "cheap-pills", "free-bets", "spam-farm")
DOMAINS = ("example.com", "example.net", "example.org")
NUMBERED = 200


def listed_sites() -> list[str]:
    """Canonical sites of the query's list: each kind by its name and numbered, under each domain."""
    return [f"{k}{n}.{d}/" for k in KINDS for n in ("", *range(NUMBERED)) for d in DOMAINS]


def n_blocks(keys: int) -> int:
    """A power of two: 16 bits a key at least, up to MOST_BLOCKS of 256 bits.

    A filter of more keys gets denser and lets more pass, which the exact steps after it remove.
    """
    return min(MOST_BLOCKS, 1 << max(0, (max(keys, 1) * BITS_PER_KEY // 256).bit_length()))


def _block(h: Column, blocks: int) -> Column:
    return F.shiftrightunsigned(h, 40).bitwiseAND(F.lit(blocks - 1))


def _mask(h: Column, lane: int) -> Column:
    bit = F.shiftrightunsigned(h, 6 * lane).bitwiseAND(F.lit(63)).cast("int")
    return F.call_function("shiftleft", F.lit(1).cast("long"), bit)


def bloom_blocks(keys: DataFrame, count: int) -> DataFrame:
    """The filter of a DataFrame of 64-bit hashes ``h``: (block, w0..w3)."""
    h, blocks = F.col("h"), n_blocks(count)
    return keys.groupBy(_block(h, blocks).alias("block")).agg(*(F.bit_or(_mask(h, j)).alias(f"w{j}") for j in range(4)))


def _hit(h: Column) -> Column:
    out = F.lit(True)
    for j in range(4):
        m = _mask(h, j)
        out = out & (F.col(f"w{j}").bitwiseAND(m) == m)
    return out


def bloom_probe(rows: DataFrame, blocks: DataFrame, count: int) -> DataFrame:
    """Rows whose hash ``h`` the filter may hold; rows are not shuffled, however many keys there are."""
    h, n = F.col("h"), n_blocks(count)
    return rows.withColumn("block", _block(h, n)).join(F.broadcast(blocks), "block").where(_hit(h)).select(*rows.columns)


def bloom_flag(rows: DataFrame, keys: DataFrame, count: int) -> DataFrame:
    """All rows, with ``maybe`` in place of ``h``: whether the filter may hold it.  Rows are not shuffled."""
    h, n = F.col("h"), n_blocks(count)
    out = rows.withColumn("block", _block(h, n)).join(F.broadcast(bloom_blocks(keys, count)), "block", "left")
    return out.withColumn("maybe", F.coalesce(_hit(h), F.lit(False))).drop("h", "block", "w0", "w1", "w2", "w3")


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lowered."""
    at = F.instr(url, "://")
    rest = url.substr(at + 3, F.length(url))
    text = F.regexp_extract(rest, r"^[^/?#]*", 0)
    return F.when(at > 0, F.translate(text, _UPPER, _LOWER)).otherwise(F.lit(""))


def path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    at = F.instr(url, "://")
    rest = url.substr(at + 3, F.length(url))
    return F.when(at > 0, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)).otherwise(F.lit(""))


def canonical(host_col: Column, path_col: Column) -> Column:
    """host without port and leading www., and path without a last slash."""
    h = F.regexp_replace(F.regexp_replace(host_col, r":[0-9]+$", ""), r"^www\.", "")
    return F.concat(h, F.regexp_replace(path_col, r"/+$", ""), F.lit("/"))


def lookup_keys(host_col: Column, path_col: Column) -> Column:
    """Keys under which a listed entry covers a url: its own canonical form and
    the canonical site of its host and of every parent domain."""
    h = F.regexp_replace(host_col, r":[0-9]+$", "")
    parts = F.split(h, r"\.")
    size = F.size(parts)
    sites = F.transform(F.sequence(F.lit(1), size), lambda i: F.concat(F.array_join(F.slice(parts, i, size), "."), F.lit("/")))
    return F.when(h != "", F.array_distinct(F.concat(F.array(canonical(host_col, path_col)), sites)))


def listed_urls(pages: DataFrame, listed: DataFrame) -> DataFrame:
    """Distinct (host, path) of ``pages`` that a listed canonical ``key`` covers.

    The filter is probed where the pages are read, so only what passes is
    shuffled, and reduced to distinct rows by task first.
    """
    count = listed.count()
    keys = listed.select("key").where("key is not null").distinct()
    blocks = bloom_blocks(keys.select(F.xxhash64("key").alias("h")), count)
    probes = pages.select("host", "path").where("host <> ''").select("host", "path", F.explode(lookup_keys(F.col("host"), F.col("path"))).alias("key"))
    maybe = bloom_probe(probes.withColumn("h", F.xxhash64("key")), blocks, count).select("host", "path", "key").distinct()
    return maybe.join(work.small_or_not(keys, count, 200), "key", "left_semi").select("host", "path").distinct()


def marked(rows: DataFrame, hits: DataFrame) -> DataFrame:
    """Rows with ``listed``.  If the hits are not small, a filter of them parts the
    rows, and only those that it may hold are shuffled to the join."""
    hits = work.cut(hits.withColumn("listed", F.lit(True)), "listed")
    n = hits.count()
    if n * 400 <= work.BROADCAST_BYTES:
        out = rows.join(F.broadcast(hits), ["host", "path"], "left")
    else:
        flagged = bloom_flag(rows.withColumn("h", F.xxhash64("host", "path")), hits.select(F.xxhash64("host", "path").alias("h")), n)
        out = flagged.where("maybe").drop("maybe").join(hits, ["host", "path"], "left")
        out = out.unionByName(flagged.where("not maybe").drop("maybe").withColumn("listed", F.lit(False)))
    return out.withColumn("listed", F.coalesce("listed", F.lit(False)))


def rule_of(host_col: Column, path_col: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; null where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host_col == h) | host_col.endswith("." + h)) & path_col.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def url_filter(pages: DataFrame, listed: DataFrame, rules=RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, listed) of every page."""
    rows = pages.select("page_id", F.col("url").alias("u")).select("page_id", F.coalesce(host(F.col("u")), F.lit("")).alias("host"), F.coalesce(path(F.col("u")), F.lit("")).alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    out = marked(rows, listed_urls(rows, listed))
    return out.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"), "listed")


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = spark.createDataFrame([(x,) for x in listed_sites()], "key string")
    return url_filter(work.table(spark, sf_dir, "pages"), listed)


OP8_SQL = r"""
with u as (
  select page_id, strpos(url, '://') as found, substr(url, strpos(url, '://') + 3) as rest from pages
), p as (
  select page_id,
    case when found > 0 then translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') else '' end as host,
    case when found > 0 then regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) else '' end as path
  from u
), r as (
  select *,
    case when (host = 'www.example.com' or suffix(host, '.www.example.com')) and starts_with(path, '/en/') then 'www.example.com/en/'
         when (host = 'example.com' or suffix(host, '.example.com')) and starts_with(path, '/en/') then 'example.com/en/'
         when (host = 'net' or suffix(host, '.net')) and starts_with(path, '/es/') then 'net/es/'
         when (host = 'net' or suffix(host, '.net')) and starts_with(path, '/fr/') then 'net/fr/'
         when (host = 'com' or suffix(host, '.com')) and starts_with(path, '/') then 'com/' end as rule,
    regexp_matches(host, '(^|\.)(adult-x|ads-track|casino-win|cheap-pills|free-bets|spam-farm)([1-9]?[0-9]|1[0-9][0-9])?\.example\.(com|net|org)(:[0-9]+)?$') as listed
  from p
)
select page_id, host, path, rule,
  case when rule in ('com/', 'www.example.com/en/') then 'allow' when rule is not null then 'block'
       when listed then 'block' else 'allow' end as verdict, listed
from r
"""
