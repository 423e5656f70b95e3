"""Shared scratch tables and small helpers of the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import sys
import tempfile
import uuid
from contextlib import contextmanager

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Functions sent to Python workers carry their code: executors need no install.
cloudpickle.register_pickle_by_value(sys.modules["attesta.llm"])

#: A table is broadcast only when its measured size is under this.
BROADCAST_BYTES = 8 << 20
BATCH_ROWS = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, from the session.

    Where it is unset only a local master gets a folder of this machine, which the
    session then keeps; on a cluster that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: machines share no folder")
        root = "file://" + tempfile.mkdtemp(prefix="attesta-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends here."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._attesta_path = path
    if _scopes():
        _scopes()[-1].append(out)
    return out


def _scopes() -> list[list[DataFrame]]:
    """Open scopes; no name of this module, whose names go to the workers."""
    return sys.__dict__.setdefault("_attesta_scopes", [])


@contextmanager
def scope():
    """Scratch tables written inside are deleted at the end, so what is made of them
    has to be written before, outside of the list: ``kept.remove`` takes it out."""
    made: list[DataFrame] = []
    _scopes().append(made)
    try:
        yield made
    finally:
        _scopes().pop()
        drop(*made)


def tidy(f):
    """A mapInArrow function that hands memory back when its task ends.

    Workers are reused by later stages, and their batches are kept small: at
    most BATCH_ROWS rows, which Arrow would else gather by the ten thousand.
    """
    spark = SparkSession.active()
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))

    def run(batches):
        yield from f(batches)
        trim()

    return run


def trim() -> None:
    """Returns freed memory of this worker to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of frames that are no longer referenced."""
    gc.collect()
    spark._jvm.System.gc()


def drop(*frames: DataFrame) -> None:
    """Delete scratch tables that nothing reads any more."""
    for df in frames:
        path = getattr(df, "_attesta_path", None)
        if path:
            jvm = df.sparkSession._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


def small_or_not(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """Broadcast hint when rows x row_bytes, both known, is under the bound."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


def components(edges: DataFrame) -> DataFrame:
    """(node, root): smallest node reachable over undirected edges (a, b).

    Alternating large-star and small-star rounds; each round is one shuffle of
    edges and lineage is cut by a written table, so nothing is collected.  The
    rounds end when the edge set's size and hash stay the same.  Only nodes of
    at least one edge appear.
    """

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())

    pair = lambda u, v: F.struct(F.col(u).alias("u"), F.col(v).alias("v"))
    e = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    now, before = state(e), None
    while now != before:
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low2, "u").select(F.explode(F.array(pair("u", "m"), pair("v", "m"))).alias("e")).select("e.u", "e.v")
        after = cut(small.where("u <> v").distinct(), "edges")
        drop(e)
        e, now, before = after, state(after), now
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select(F.col("v"), F.col("v"))).distinct()
