"""Phrase extraction: frequency, cohesion and the entropies of neighbours on both sides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions import text as X
from lexmill.operators.ngrams import window_counts
from lexmill.scratch import written


def _entropy(sides: DataFrame, side: str, name: str) -> DataFrame:
    counts = sides.where(F.col(side).isNotNull()).groupBy("word", side).agg(F.sum("c").alias("c"))
    folded = counts.groupBy("word").agg(F.sum("c").alias("s"), F.sum(F.col("c") * F.ln("c")).alias("l"))
    return folded.select("word", F.greatest(F.lit(0.0), F.ln("s") - F.col("l") / F.col("s")).alias(name))


def signals(texts: DataFrame, text_col: str, min_len: int = 2, max_len: int = 2, neighbours: int = 1) -> DataFrame:
    """(word, len, freq, prob, log_prob, cohesion, suffix_entropy, prefix_entropy) of all substrings of 1..max_len.

    Probabilities are shares of all occurrences of all lengths. Cohesion is the least pointwise mutual information over
    the ways to cut a word in two, infinite for one character. Entropies look at ``neighbours`` characters, 0 where no
    text goes on; texts do not run into each other. Texts are cut once, into distinct windows that hold a longest word and
    its neighbours; words are cut from these. Counts by word and neighbours are written; everything else comes from them.
    """
    windows_ = window_counts(texts, text_col, neighbours, max_len + neighbours)
    each = windows_.withColumn("room", F.length("window") - F.col("at")).withColumn("len", F.explode(F.expr(f"sequence(1, least({max_len}, room))")))
    after = F.expr(f"CASE WHEN len + {neighbours} <= room THEN substring(window, at + len + 1, {neighbours}) END")
    before = F.expr(f"CASE WHEN at = {neighbours} THEN substring(window, 1, at) END")
    found = each.select(F.expr("substring(window, at + 1, len)").alias("word"), "len", after.alias("next"), before.alias("prev"), "cnt")
    sides = written(found.groupBy("word", "len", "next", "prev").agg(F.sum("cnt").alias("c")), "phrase-sides")
    counts = written(sides.groupBy("word", "len").agg(F.sum("c").alias("freq")), "phrase-counts")
    total = counts.agg(F.sum("freq").alias("_all"))
    probs = counts.join(F.broadcast(total)).select("word", "len", "freq", (F.col("freq") / F.col("_all")).alias("prob"), (F.ln("freq") - F.ln("_all")).alias("log_prob"))
    cut = probs.where(F.col("len") >= max(2, min_len)).select("word", "log_prob", F.explode(F.sequence(F.lit(1), F.col("len") - 1)).alias("k"))
    halves = cut.select("word", "log_prob", F.expr("left(word, k)").alias("a"), F.expr("substring(word, k + 1)").alias("b"))
    left = probs.select(F.col("word").alias("a"), F.col("log_prob").alias("pa"))
    right = probs.select(F.col("word").alias("b"), F.col("log_prob").alias("pb"))
    cohesion = halves.join(left, "a").join(right, "b").groupBy("word").agg(F.min(F.col("log_prob") - F.col("pa") - F.col("pb")).alias("cohesion"))
    wanted = sides.where(F.col("len") >= min_len)
    after, before = _entropy(wanted, "next", "suffix_entropy"), _entropy(wanted, "prev", "prefix_entropy")
    told = probs.where(F.col("len") >= min_len).join(cohesion, "word", "left").join(after, "word", "left").join(before, "word", "left")
    return told.select(
        "word", "len", "freq", "prob", "log_prob", F.when(F.col("len") == 1, F.lit(float("inf"))).otherwise(F.col("cohesion")).alias("cohesion"),
        F.coalesce("suffix_entropy", F.lit(0.0)).alias("suffix_entropy"), F.coalesce("prefix_entropy", F.lit(0.0)).alias("prefix_entropy"),
    )


def candidates(words: DataFrame, pre_filter: Column | None = None) -> DataFrame:
    """Words without punctuation that no pre-filter drops."""
    kept = words.where(~X.has_punctuation(F.col("word")))
    return kept.where(pre_filter) if pre_filter is not None else kept


def listed(words: DataFrame) -> DataFrame:
    """Candidates or phrases in their listing order: by freq descending, then word."""
    return words.orderBy(F.desc("freq"), "word")


def default_post_filter() -> Column:
    c, lp, pre, suf = (F.col(x) for x in ("cohesion", "log_prob", "prefix_entropy", "suffix_entropy"))
    spread = F.sqrt(pre * (suf + 1)) - 0.85 * lp
    return (c - 0.5 * lp > 9) & (spread > 11) & (pre > 0.5) & (suf > 0) & (pre + suf > 3)


def extract(texts: DataFrame, text_col: str, min_len: int = 2, max_len: int = 2, neighbours: int = 1, pre_filter: Column | None = None, post_filter: Column | None = None) -> DataFrame:
    """Phrases: candidates that pass the post filter."""
    found = candidates(signals(texts, text_col, min_len, max_len, neighbours), pre_filter)
    return found.where(default_post_filter() if post_filter is None else post_filter)


def windows(texts: DataFrame, text_col: str, size: int, backwards: bool = False) -> DataFrame:
    """(pos, window): the up to ``size`` characters from each place on, or up to each place."""
    base = texts.select(X.chars(F.col(text_col)).alias("c")).where(F.size("c") > 0)

    def one(p: Column) -> Column:
        start = F.greatest(F.lit(1), p - size + 1) if backwards else p
        n = F.least(p, F.lit(size)) if backwards else F.lit(size)
        return F.struct((p - 1).alias("pos"), F.array_join(F.slice("c", start, n), "").alias("window"))

    return base.select(F.explode(F.transform(F.sequence(F.lit(1), F.size("c")), one)).alias("w")).select("w.*")


def sorted_windows(texts: DataFrame, text_col: str, size: int, backwards: bool = False) -> DataFrame:
    """The windows in order, those up to each place in the order of their reversed text; of equal ones the later place first."""
    key = F.reverse("window") if backwards else F.col("window")
    return windows(texts, text_col, size, backwards).orderBy(key, F.desc("pos"))
