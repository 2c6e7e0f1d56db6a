"""Statistics of word models: by length, by count, and of following characters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions import text as X


def model_length_stats(model: DataFrame) -> DataFrame:
    """(len, uniq_cnt, mean, stddev, sqrt_sum, log_sum) over words with a count; log_sum adds ln(cnt)."""
    return model.where("cnt <> 0").groupBy("len").agg(
        F.count("*").alias("uniq_cnt"), F.avg("cnt").alias("mean"), F.stddev_pop("cnt").alias("stddev"),
        F.sum(F.sqrt("cnt")).alias("sqrt_sum"), F.sum(F.ln("cnt")).alias("log_sum"),
    )


def text_length_stats(texts: DataFrame, text_col: str, max_len: int) -> DataFrame:
    """As :func:`model_length_stats` over every place of whole texts, short tails as classes of their own.

    log_sum adds ln(cnt + 1); p01_count is the smallest class size that 1 % of the classes do not exceed.
    """
    base = texts.select(X.chars(F.col(text_col)).alias("c")).where(F.size("c") > 0)
    cut = lambda p, k: F.struct(k.alias("len"), F.array_join(F.slice("c", p, k), "").alias("w"))
    places = F.transform(F.sequence(F.lit(1), F.size("c")), lambda p: F.transform(F.sequence(F.lit(1), F.lit(max_len)), lambda k: cut(p, k)))
    classes = base.select(F.explode(F.flatten(places)).alias("g")).groupBy("g.len", "g.w").agg(F.count("*").alias("cnt"))
    sizes = classes.groupBy("len", "cnt").agg(F.count("*").alias("n"))
    w = Window.partitionBy("len")
    ranked = sizes.withColumns({"upto": F.sum("n").over(w.orderBy("cnt")), "all": F.sum("n").over(w)})
    n, cnt = F.col("n"), F.col("cnt")
    mean = F.sum(n * cnt) / F.sum(n)
    return ranked.groupBy("len").agg(
        F.sum("n").alias("uniq_cnt"), mean.alias("mean"), F.sqrt(F.greatest(F.lit(0.0), F.sum(n * cnt * cnt) / F.sum(n) - mean * mean)).alias("stddev"),
        F.sum(n * F.sqrt(cnt)).alias("sqrt_sum"), F.sum(n * F.ln(cnt + 1)).alias("log_sum"),
        F.min(F.when(F.col("upto") >= 0.01 * F.col("all"), cnt)).alias("p01_count"),
    )


def words_per_count(model: DataFrame, length: int, seed: int = 10) -> DataFrame:
    """(cnt, words) for words of a length; counts 1..seed always appear."""
    own = model.where(F.col("len") == length).groupBy("cnt").agg(F.count("*").alias("words"))
    always = model.sparkSession.range(1, seed + 1).select(F.col("id").alias("cnt"), F.lit(0).cast("long").alias("words"))
    return own.unionByName(always).groupBy("cnt").agg(F.sum("words").alias("words"))


def next_char_entropy(model: DataFrame) -> DataFrame:
    """(word, entropy): of the counts of the words one character longer; only words that have such."""
    longer = model.where("len > 1 and cnt > 0").select(F.expr("left(word, len - 1)").alias("word"), "cnt")
    # sum(-p ln p) = ln(S) - sum(c ln c) / S needs no window over the group
    folded = longer.groupBy("word").agg(F.sum("cnt").alias("s"), F.sum(F.col("cnt") * F.ln("cnt")).alias("l"))
    return folded.select("word", F.greatest(F.lit(0.0), F.ln("s") - F.col("l") / F.col("s")).alias("entropy"))


def identified(words: DataFrame, word_col: str = "word") -> DataFrame:
    """n_words and n_chars of a segmentation."""
    return words.agg(F.count(word_col).alias("n_words"), F.coalesce(F.sum(F.length(word_col)), F.lit(0)).alias("n_chars"))
