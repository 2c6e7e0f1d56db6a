"""Scratch tables and Arrow batch bounds shared by the operators of this subpackage.

Lineage is cut by writing Parquet below ``spark.checkpoint.dir``, which driver and executors share, so that a lost
executor costs a reread and nothing else. Only where that setting is missing (tests) is a local folder taken.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL: list[str] = []
#: Rows of text in an Arrow batch; a batch of very long texts stays small enough for a Python worker.
TEXT_ROWS = 256


def scratch_root(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a local one only where the session runs in one machine."""
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if root:
        return root
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _LOCAL:
        _LOCAL.append("file://" + tempfile.mkdtemp(prefix="lexmill-scratch-"))
    return _LOCAL[0]


def scratch_path(spark: SparkSession, tag: str) -> str:
    return f"{scratch_root(spark)}/{tag}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, tag: str) -> tuple[DataFrame, str]:
    """Writes ``df`` once; returns the table read back and its path."""
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def release(spark: SparkSession, *paths: str) -> None:
    """Deletes scratch tables that no later plan reads."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in paths:
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(conf).delete(target, True)


def bound_batches(spark: SparkSession, rows: int = TEXT_ROWS) -> None:
    """Keeps Arrow batches of whole texts small; an own smaller setting of the session stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > rows:
        spark.conf.set(key, str(rows))


def unused(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def input_bytes(df: DataFrame) -> int:
    """The optimizer's size estimate of a plan, in bytes; no job runs."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def crc_mod(key: Column, n: int) -> Column:
    """crc32 of the key as text, modulo n; null keys give null."""
    return F.crc32(key.cast("string")) % F.lit(n)
