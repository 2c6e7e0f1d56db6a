"""Count services as batch and stream lookups, and incremental n-gram counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.functions import text as X
from lexmill.operators.ngrams import counts_of, occurrences


def requests(spark: SparkSession, host: str, port: int) -> DataFrame:
    """A stream of words, one a line, from a socket."""
    return spark.readStream.format("socket").option("host", host).option("port", port).load().withColumnRenamed("value", "word")


def answer(queries: DataFrame, model: DataFrame, ready: bool = True) -> DataFrame:
    """(word, cnt, reply) for a batch or a stream of words against a static model; "Not yet" while it is being built."""
    if not ready:
        return queries.select("word", F.lit(None).cast("long").alias("cnt"), F.lit("Not yet").alias("reply"))
    found = counts_of(queries.select("word"), model)
    return found.select("word", "cnt", F.col("cnt").cast("string").alias("reply"))


def describe(queries: DataFrame, model: DataFrame, entropy: DataFrame) -> DataFrame:
    """(word, cnt, entropy, reply) against a model and its entropies; a word that nothing follows has entropy 0."""
    found = counts_of(queries.select("word"), model).join(entropy.select("word", "entropy"), "word", "left").withColumn("entropy", F.coalesce("entropy", F.lit(0.0)))
    return found.select("word", "cnt", "entropy", F.concat_ws("\t", "word", "cnt", "entropy").alias("reply"))


def bounds_reply(bounds: DataFrame) -> DataFrame:
    """``prefix_bounds`` with cnt and the reply: the word, upper and lower rank and the count."""
    cnt = F.col("upper") - F.col("lower")
    return bounds.withColumns({"cnt": cnt, "reply": F.concat(F.col("word"), F.lit(" \t"), F.col("upper"), F.lit(":"), F.col("lower"), F.lit("\t"), cnt)})


def answer_lengths(queries: DataFrame, stats: DataFrame) -> DataFrame:
    """(len, uniq_cnt) for lengths as text; what is no known length gives null."""
    asked = queries.select(F.try_to_number("word", F.lit("999999999")).cast("int").alias("len"))
    return asked.join(F.broadcast(stats.select("len", "uniq_cnt")), "len", "left")


def running_counts(texts: DataFrame, text_col: str, max_len: int = 4, breaks: str = "default") -> DataFrame:
    """Word model of a stream, for output mode update or complete."""
    cut = texts.select(F.explode(X.chunks(F.col(text_col), breaks)).alias("chunk"))
    return occurrences(cut, F.col("chunk"), 1, max_len).groupBy("word", "len").agg(F.count("*").alias("cnt"))
