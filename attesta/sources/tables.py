"""Table, page and file sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attesta.session import scratch

#: The record envelope: one payload column, typed projections are made on read.
ENVELOPE = T.StructType(
    [
        T.StructField("id", T.StringType(), False),
        T.StructField("batch_id", T.StringType()),
        T.StructField("video_id", T.StringType()),
        T.StructField("payload", T.StringType()),
        T.StructField("payload_hash", T.StringType()),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("purged_at", T.TimestampType()),
    ]
)

MAX_PAGE = 200


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; time stamps without zone become UTC time stamps."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    for f in df.schema.fields:
        if isinstance(f.dataType, T.TimestampNTZType):
            df = df.withColumn(f.name, F.col(f.name).cast("timestamp"))
    return df


#: A table is broadcast only when its counted rows, at the given width, are under this.
BROADCAST_BYTES = 8 << 20


def if_small(df: DataFrame, row_bytes: int) -> DataFrame:
    """With a broadcast hint if the table is small, which takes a count of its rows."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df


def read_batch(df: DataFrame, batch: str | None = None) -> DataFrame:
    """Rows of one batch, or of all for None; prunes when stored by batch."""
    return df if batch is None else df.where(F.col("batch_id") == batch)


def active(df: DataFrame) -> DataFrame:
    """Rows whose payload was not purged."""
    return df.where(F.col("purged_at").isNull())


def keyset_page(df: DataFrame, after: str | None, limit: int, key: str = "id", batch: str | None = None) -> DataFrame:
    """The next page in binary key order after ``after``."""
    if not isinstance(limit, int) or isinstance(limit, bool) or not 1 <= limit <= MAX_PAGE:
        raise ValueError(f"limit must be from 1 to {MAX_PAGE}")
    rows = read_batch(df, batch)
    if after is not None:
        rows = rows.where(F.col(key) > after)
    return rows.orderBy(key).limit(limit)


def page_walk_faults(pages: DataFrame, limit: int = MAX_PAGE) -> DataFrame:
    """Faults of a finished walk (page, position, id, batch_id, asked_batch).

    Ids must grow strictly over the walk, belong to the asked batch, and no
    page may be longer than the limit.
    """
    from pyspark.sql import Window

    order = Window.partitionBy("asked_batch").orderBy("page", "position")
    rows = pages.withColumn("before", F.lag("id").over(order)).withColumn("size", F.count("*").over(Window.partitionBy("asked_batch", "page")))
    rules = {"not increasing": F.col("before") >= F.col("id"), "wrong batch": ~F.col("batch_id").eqNullSafe(F.col("asked_batch")), "page too long": F.col("size") > limit}
    faults = F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items())))
    return rows.select("asked_batch", "page", "position", "id", faults.alias("faults")).where(F.size("faults") > 0)


def read_json_config(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).json(path)


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    return (spark.read.schema(schema) if schema else spark.read).json(path)


def read_csv_audit(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).csv(path)


def snapshot_faults(tables: DataFrame, required: list[str], taken_at: Column, now: Column, hours: int = 24) -> DataFrame:
    """Faults of a snapshot: age over the limit, a stamp more than five minutes
    ahead, and required tables that are missing.

    ``tables`` has one row for each table held (column ``name``).
    """
    spark = tables.sparkSession
    want = spark.createDataFrame([(n,) for n in required], "name string")
    missing = want.join(tables.select("name").distinct(), "name", "left_anti").select(F.concat(F.lit("missing table "), "name").alias("fault"))
    seconds = F.unix_timestamp(now) - F.unix_timestamp(taken_at)
    age = spark.range(1).select(F.when(seconds > hours * 3600, "snapshot too old").when(seconds < -300, "snapshot of the future").alias("fault")).where("fault is not null")
    return missing.union(age)


class ReadCache:
    """Reads of one run: a table read once stays as it was, whatever is written later.

    The first read of a table or batch is written to the shared folder; all later
    reads of the run come from there, on whichever executor.
    """

    def __init__(self, read):
        self.read, self.held = read, {}

    def get(self, spark: SparkSession, table: str, batch: str | None = None) -> DataFrame:
        key = (table, batch)
        if key not in self.held:
            rows = self.read(table) if batch is None else read_batch(self.read(table), batch)
            path = scratch(spark, "read")
            rows.write.parquet(path)
            self.held[key] = spark.read.schema(rows.schema).parquet(path)
        return self.held[key]


def looked_up(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows of the asked ids, each once however often it is asked: chunked requests as one join."""
    return df.join(ids.select(key).distinct(), key, "left_semi")


def cached_fetch(requests: DataFrame, cache: DataFrame, key: str = "digest") -> tuple[DataFrame, DataFrame]:
    """(answers known, requests still to make) for memoised fetches."""
    return requests.join(cache, key), requests.join(cache.select(key), key, "left_anti")


def pool_first(comments: DataFrame, group: str, key: str, order: str, limit: int) -> DataFrame:
    """First ``limit`` distinct comments of each group in page order."""
    from pyspark.sql import Window

    once = comments.withColumn("nth", F.row_number().over(Window.partitionBy(group, key).orderBy(order))).where("nth = 1")
    return once.withColumn("nth", F.row_number().over(Window.partitionBy(group).orderBy(order, key))).where(F.col("nth") <= limit).drop("nth")


def write_json_export(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").json(path)


def build_id(assets: DataFrame) -> DataFrame:
    """First 16 hex digits of the SHA-256 of all assets in name order."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("name", "content"))), lambda x: x["content"]), "")
    return assets.agg(F.substring(F.sha2(joined, 256), 1, 16).alias("build_id"))


def unescaped(c: Column) -> Column:
    """Text with the entities that XML has by name resolved."""
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&amp;", "&")):
        c = F.replace(c, F.lit(entity), F.lit(char))
    return c


def feed_entries(bodies: DataFrame) -> DataFrame:
    """(source, title, link, published, text) of RSS items and Atom entries.

    Prefixes are dropped ahead of parsing, so namespaces do not matter; an
    entry's link is the href of the link element or its text; the date is the
    first of four elements that is there.  Entries without title or link go.
    """
    plain = F.regexp_replace("body", r"<(/?)[A-Za-z0-9_]+:([A-Za-z])", "<$1$2")
    items = F.expr(r"regexp_extract_all(plain, '(?s)<(?:item|entry)[ >].*?</(?:item|entry)>', 0)")
    rows = bodies.withColumn("plain", plain).select("source", F.posexplode(items).alias("position", "item"))

    def tag(name: str) -> Column:
        got = F.regexp_extract("item", rf"(?s)<{name}(?:\s[^>]*)?>(?:<!\[CDATA\[)?(.*?)(?:\]\]>)?</{name}>", 1)
        return F.nullif(F.trim(got), F.lit(""))

    href = F.nullif(F.regexp_extract("item", r"<link\s[^>]*href=[\"']([^\"']+)", 1), F.lit(""))
    return rows.select(
        "source",
        "position",
        F.trim(F.regexp_replace(unescaped(unescaped(tag("title"))), "<[^>]+>", " ")).alias("title"),
        unescaped(unescaped(F.coalesce(href, tag("link")))).alias("link"),
        F.coalesce(tag("published"), tag("updated"), tag("pubDate"), tag("date")).alias("published"),
        F.trim(F.regexp_replace(unescaped(F.regexp_replace(unescaped(F.coalesce(tag("description"), tag("summary"), tag("content"))), "<[^>]+>", " ")), r"\s+", " ")).alias("text"),
    ).where("title <> '' and link <> ''")
