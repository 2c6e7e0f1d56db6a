"""Self-training: segment with the model, let old counts decay, count the found words in."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill import scratch
from lexmill.functions import scores as S
from lexmill.functions import text as X
from lexmill.operators import ngrams, segment, stats


def scored_words(model: DataFrame, chunks: DataFrame, base_length: float, score: str = "Sigmoid", expression: str | None = None, max_len: int = 4) -> DataFrame:
    """(word, score) of the substrings of the chunks, by a named score or a SQL expression.

    Scores are rounded to nine digits, so that sums that tie do so on every machine. An expression may call C(..), the
    count of any text made of the word (see :func:`lexmill.functions.scores.count_scores`).
    """
    words = segment.candidates(chunks, "chunk", max_len)
    if expression is not None and S.count_calls(expression):
        table = S.count_scores(words, model, base_length, expression)
        return table.select("word", F.round("score", 9).alias("score"))
    need = expression is not None
    table = stats.model_length_stats(model) if need or score in S.NEEDS_STATS else None
    entropy = stats.next_char_entropy(model) if need or score in S.NEEDS_ENTROPY else None
    if need:
        told = S.score_table(words, model, table, entropy, base_length, [], {"score": expression})
        return told.select("word", F.round("score", 9).alias("score"))
    return S.score_table(words, model, table, entropy, base_length, [score]).select("word", F.round(score, 9).alias("score"))


def iterate(model: DataFrame, texts: DataFrame, text_col: str, rounds: int = 1, ratio: float = 0.5, score: str = "Sigmoid", expression: str | None = None, max_len: int = 4, char_class: str = X.CJK, folder: str | None = None) -> DataFrame:
    """The model after ``rounds`` passes, each written as ``round-k`` below ``folder`` (or to the scratch folder).

    Statistics and scores are those of the model before its decay; words go in after it. Distinct chunks are segmented
    once and weigh as often as they occur. A round reads the written model of the one before, so plans do not grow.
    """
    spark = texts.sparkSession
    base = texts.agg(F.coalesce(F.sum(X.class_length(F.col(text_col), char_class)), F.lit(0))).first()[0]
    chunked = scratch.written(ngrams.chunk_counts(texts, text_col, "space"), "train-chunks")
    model = scratch.written(model, "train-model")
    for k in range(rounds):
        found = segment.segment(chunked, scored_words(model, chunked, float(base), score, expression, max_len), max_len=max_len)
        words = segment.word_rows(found, ("times",)).groupBy("word").agg(F.sum("times").alias("times"))
        after = ngrams.add_words(ngrams.decay(model, ratio), words, "word", "times")
        if folder:
            after.write.parquet(f"{folder}/round-{k + 1}")
            model = spark.read.parquet(f"{folder}/round-{k + 1}")
        else:
            model = scratch.written(after, "train-round")
    return model
