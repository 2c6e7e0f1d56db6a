"""Word segmentation: dynamic programming over word scores, and dictionary max-match."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.scratch import written

#: What a character that no score reaches is worth, so that every text has a segmentation.
FLOOR = -1e6
#: Score rows that are broadcast; beyond it each distinct chunk gets its own scores by a join.
BROADCAST_WORDS = 200_000


def best_split(text: str, score: dict[str, float], max_len: int, floor: float = FLOOR) -> list[str]:
    """The words of the largest score sum; of equal sums the one whose last word starts first.

    Words without a finite score are not taken; a single character without one is worth ``floor``.
    """
    n, get = len(text), score.get
    best, back = [-math.inf] * (n + 1), [0] * (n + 1)
    best[0] = 0.0
    for i in range(n):
        top = best[i]
        for k in range(1, min(max_len, n - i) + 1):
            s = get(text[i : i + k])
            if s is None or s - s != 0.0:  # nothing finite
                if k > 1:
                    continue
                s = floor
            if (v := top + s) > best[i + k]:
                best[i + k], back[i + k] = v, k
    out = []
    while n:
        out.append(text[n - back[n] : n])
        n -= back[n]
    return out[::-1]


def candidates(chunks: DataFrame, chunk_col: str, max_len: int) -> DataFrame:
    """Distinct substrings of 1..max_len characters of the chunks."""
    from lexmill.operators.ngrams import occurrences

    distinct = chunks.select(F.col(chunk_col).alias("chunk")).where(F.col(chunk_col) != "").distinct()
    return occurrences(distinct, F.col("chunk"), 1, max_len).select("word").distinct()


def segment(chunks: DataFrame, scores: DataFrame, chunk_col: str = "chunk", score_col: str = "score", max_len: int = 4, out: str = "words", broadcast_words: int = BROADCAST_WORDS) -> DataFrame:
    """``chunks`` with an array of words whose concatenation is the chunk; null chunks give null, empty ones [].

    The score table (word, score) is broadcast as a dictionary up to ``broadcast_words`` rows. A larger one stays
    distributed: each distinct chunk is joined with the scores of its own substrings.
    """
    spark = chunks.sparkSession
    table = scores.select("word", F.col(score_col).cast("double").alias("score")).where((F.length("word") <= max_len) & F.col(score_col).isNotNull())
    table = written(table, "segment-scores")  # scored once: counted and read from here
    if table.count() <= broadcast_words:
        own_rows = table.toPandas()
        shared = spark.sparkContext.broadcast(dict(zip(own_rows["word"], own_rows["score"], strict=True)))

        @F.pandas_udf("array<string>")
        def split(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            own = shared.value
            for batch in texts:
                yield pd.Series([None if x is None else best_split(x, own, max_len) for x in batch], dtype=object)

        return chunks.withColumn(out, split(F.col(chunk_col)))
    from lexmill.operators.ngrams import occurrences

    distinct = chunks.select(F.col(chunk_col).alias("_c")).where("_c is not null").distinct()
    parts = occurrences(distinct, F.col("_c"), 1, max_len, ("_c",)).select("_c", "word").distinct()
    own = parts.join(table.where("score is not null"), "word").groupBy("_c").agg(F.map_from_entries(F.collect_list(F.struct("word", "score"))).alias("_m"))

    @F.pandas_udf("array<string>")
    def split_own(texts: pd.Series, maps: pd.Series) -> pd.Series:
        return pd.Series([best_split(x, dict(m or {}), max_len) for x, m in zip(texts, maps, strict=True)], dtype=object)

    told = distinct.join(own, "_c", "left").select("_c", split_own(F.col("_c"), F.col("_m")).alias(out))
    return chunks.join(told, chunks[chunk_col] == told["_c"], "left").drop("_c")


def joined(words: Column) -> Column:
    """Cut text: words with blanks between."""
    return F.array_join(words, " ")


def word_rows(segmented: DataFrame, keep: tuple[str, ...] = (), words_col: str = "words") -> DataFrame:
    """One row a word with its place in the chunk."""
    return segmented.select(*keep, F.posexplode(words_col).alias("pos", "word"))


def max_match(text: str, longest: Iterable[tuple[dict, int]]) -> list[str]:
    """Greedy longest prefixes; characters that start no entry gather in one segment."""
    tables = list(longest)
    out, loose, i = [], [], 0
    while i < len(text):
        found = ""
        for table, k in tables:
            found = next((text[i : i + n] for n in range(min(k, len(text) - i), 0, -1) if text[i : i + n] in table), "")
            if found:
                break
        if found:
            if loose:
                out.append("".join(loose))
                loose = []
            out.append(found)
            i += len(found)
        else:
            loose.append(text[i])
            i += 1
    if loose:
        out.append("".join(loose))
    return out
