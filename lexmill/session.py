"""Session factory and table loader."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession


def local_session(name: str = "lexmill", cores: str | int = 8, **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; a cluster brings its own."""
    settings = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": os.environ.get("LEXMILL_DRIVER_MEMORY", "8g"),
        "spark.driver.host": "127.0.0.1",
    } | conf
    builder = SparkSession.builder.master(f"local[{cores}]").appName(name)
    return builder.config(map=settings).getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table by name."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
