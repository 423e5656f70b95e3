"""Archive pages of official sources: one extractor with a contract per source.

Bodies are fetched elsewhere; here they are a table (source, page, body).  A
source's contract says how entries are cut out of a body (XML items, or cards
by patterns), how the window is tested and what makes an archive complete.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attesta.functions.scalar import lenient_date
from attesta.functions.text import cards
from attesta.sources.tables import feed_entries


@dataclass(frozen=True)
class Contract:
    """How one source's archive is read and checked."""

    source: str
    form: str = "html"  # html or xml
    item: str = r"(?s)<li class=\"item\">.*?</li>"
    date: str = r"<time datetime=\"([^\"]+)\""
    title: str = r"<h3>(.*?)</h3>"
    link: str = r"href=\"([^\"]+)\""
    whole_days: bool = True  # local days, both ends included; else instants
    zone: str = "Europe/Amsterdam"
    repeated: str = "error"  # or first
    descending: bool = False
    scope: str = r"^https?://"


def entries(bodies: DataFrame, contract: Contract) -> DataFrame:
    """(source, page, position, url, title, published_at) of one source's bodies."""
    own = bodies.where(F.col("source") == contract.source)
    if contract.form == "xml":
        rows = feed_entries(own).select("source", F.lit(0).alias("page"), "position", F.col("link").alias("url"), "title", F.col("published").alias("raw"))
    else:
        got = own.select("source", "page", F.posexplode(cards(F.col("body"), contract.item, contract.date, contract.title, contract.link)).alias("position", "c"))
        rows = got.select("source", "page", "position", F.col("c.link").alias("url"), F.col("c.title").alias("title"), F.col("c.date").alias("raw"))
    return rows.withColumn("published_at", lenient_date(F.col("raw"), contract.zone)).drop("raw")


def inside(contract: Contract, at: Column, start: Column, end: Column) -> Column:
    if not contract.whole_days:
        return (at >= start) & (at <= end)
    day = lambda c: F.to_date(F.from_utc_timestamp(c, contract.zone))
    return (day(at) >= day(start)) & (day(at) <= day(end))


def discover(bodies: DataFrame, contract: Contract, start: Column, end: Column) -> DataFrame:
    """Entries in the window, one per url (the first), in the source's order."""
    rows = entries(bodies, contract).where(inside(contract, F.col("published_at"), start, end))
    nth = F.row_number().over(Window.partitionBy("url").orderBy("page", "position"))
    return rows.withColumn("nth", nth).where("nth = 1").drop("nth")


def archive_faults(bodies: DataFrame, contract: Contract, start: Column, totals: DataFrame | None = None) -> DataFrame:
    """(fault) of a fetched archive; an empty result means it is complete.

    Checked: undated entries, urls out of scope, repeated urls (where they are
    errors), order, reach back before the window, and reported totals (source,
    page, total), which must stay the same and be reached.
    """
    rows = entries(bodies, contract)
    w = Window.orderBy("page", "position")
    facts = rows.withColumn("before", F.lag("published_at").over(w)).agg(
        F.count_if(F.col("published_at").isNull()).alias("undated"),
        F.count_if(~F.col("url").rlike(contract.scope)).alias("foreign"),
        (F.count("*") - F.count_distinct("url")).alias("repeats"),
        F.count_if(F.col("published_at") > F.col("before")).alias("rises"),
        F.min("published_at").alias("oldest"),
        F.count("*").alias("n"),
    )
    checks = [
        ("undated entry", F.col("undated") > 0),
        ("url out of scope", F.col("foreign") > 0),
        ("repeated url", (F.col("repeats") > 0) & F.lit(contract.repeated == "error")),
        ("order is not descending", (F.col("rises") > 0) & F.lit(contract.descending)),
        ("archive does not reach back", F.coalesce(F.col("oldest") >= start, F.lit(True))),
    ]
    if totals is not None:
        t = totals.where(F.col("source") == contract.source).agg(F.min("total").alias("lo"), F.max("total").alias("hi"))
        facts = facts.crossJoin(F.broadcast(t))
        checks += [("total changed", F.col("lo") != F.col("hi")), ("total not reached", F.col("n") != F.col("hi"))]
    found = F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in checks)))
    return facts.select(F.explode(found).alias("fault"))


def bilingual_once(rows: DataFrame, language: str, at: str, main: str = "en") -> DataFrame:
    """Drops other-language releases with exactly a main-language one's timestamp."""
    known = rows.where(F.col(language) == main).select(at).distinct()
    other = rows.where(F.col(language) != main).join(known, at, "left_anti").select(rows.columns)
    return rows.where(F.col(language) == main).union(other)


def preferred_language(rows: DataFrame, number: str, language: str, url: str, main: str = "en") -> DataFrame:
    """One row a release number, the main language first; (row, conflict)."""
    clash = rows.groupBy(number, language).agg((F.count_distinct(url) > 1).alias("c")).groupBy(number).agg(F.bool_or("c").alias("conflict"))
    nth = F.row_number().over(Window.partitionBy(number).orderBy((F.col(language) != main), url))
    return rows.withColumn("nth", nth).where("nth = 1").drop("nth").join(clash, number)


def reconciled_date(issued: Column, dateline: Column, confirmed: Column) -> tuple[Column, Column]:
    """(date, conflict): a differing dateline counts only where the page confirms it."""
    differs = dateline.isNotNull() & (dateline != issued)
    ok = F.coalesce(confirmed, F.lit(False))
    return F.when(differs & ok, dateline).otherwise(issued), F.coalesce(differs & ~ok, F.lit(False))
