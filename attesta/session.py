"""Session settings every query expects."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def builder(app: str = "attesta", cores: str = "*", shuffle_partitions: int | None = None) -> SparkSession.Builder:
    """UTC, ANSI and adaptive execution; partitions are left to the cluster unless given."""
    b = (
        SparkSession.builder.appName(app)
        .master(f"local[{cores}]")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.ansi.enabled", "true")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    return b.config("spark.sql.shuffle.partitions", str(shuffle_partitions)) if shuffle_partitions else b


#: Rows of an Arrow batch of texts: ten thousand, Spark's default, may be a gigabyte of them.
BATCH_ROWS = 512


def small_batches(spark: SparkSession) -> None:
    """Lets Python workers have at most BATCH_ROWS rows at a time."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all machines share, ``spark.checkpoint.dir``.

    Without that setting only a local master gets a folder of this machine.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: machines share no folder")
        root = "file://" + tempfile.mkdtemp(prefix="attesta-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The table as written to a scratch folder: rows stay as they are once, whatever is lost."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
