"""Intermediate tables that cut lineage.

They are Parquet below ``spark.checkpoint.dir``, which driver and executors share, so a lost executor costs a reread.
Where the setting is missing a local folder is taken if the session runs in one machine (tests), else an error is raised.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: list[str] = []


def root(spark: SparkSession) -> str:
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if folder:
        return folder
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _LOCAL:
        _LOCAL.append("file://" + tempfile.mkdtemp(prefix="lexmill-"))
    return _LOCAL[0]


def written(df: DataFrame, tag: str) -> DataFrame:
    """``df``, written once and read back."""
    path = f"{root(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
