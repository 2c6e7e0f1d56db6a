"""Suffix order, common prefixes and what follows from them.

Suffixes are ordered within a text, first by keys of some characters. Where keys agree in full the order is refined by
prefix doubling: pairs of ranks (of a place, and of the place a key's length on) give ranks over twice the length, until
all ranks differ. So order and heights are exact for texts of any length and repetition.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from lexmill import scratch
from lexmill.functions import text as X
from lexmill.operators import codes


def suffixes(texts: DataFrame, id_col: str, text_col: str, key_len: int = 64) -> DataFrame:
    """(id, pos, suffix) with suffixes cut to key_len characters."""
    base = texts.select(id_col, X.chars(F.col(text_col)).alias("c")).where(F.size("c") > 0)
    each = F.transform(F.sequence(F.lit(1), F.size("c")), lambda p: F.struct((p - 1).alias("pos"), F.array_join(F.slice("c", p, key_len), "").alias("suffix")))
    return base.select(id_col, F.explode(each).alias("s")).select(id_col, "s.pos", "s.suffix")


def suffix_array(texts: DataFrame, id_col: str, text_col: str, key_len: int = 64) -> DataFrame:
    """(id, rank, pos, height) per text: rank from 0, height the characters shared with the suffix before.

    Each text is ordered inside its row, without a shuffle, scratch table or join. ``key_len`` has no effect on the result;
    it is kept for callers of the keyed plan.
    """
    base = texts.where(F.length(text_col) > 0).select(id_col, F.col(text_col).alias("__text"))
    number = lambda name: StructField(name, IntegerType())
    schema = StructType([base.schema[id_col], number("rank"), number("pos"), number("height")])

    def order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, end in codes.groups(batch.column(1)):
                part = batch.slice(low, end - low)
                owner, *told = codes.suffix_order(*codes.flat(part.column(1)))
                for at in range(0, len(owner), codes.ROWS):
                    own = slice(at, at + codes.ROWS)
                    columns = [pa.array(x[own].astype("int32")) for x in told]
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(owner[own])), *columns], names=[id_col, "rank", "pos", "height"])

    return base.mapInArrow(order, schema)


def prefix_bounds(queries: DataFrame, texts: DataFrame, id_col: str, text_col: str, word_col: str = "word", key_len: int = 64) -> DataFrame:
    """(word, id, lower, upper): the suffixes of each text that start with a word are those of rank lower..upper - 1.

    An empty word covers all suffixes. The result is a row for each word and text, so words go into each text's rows; the
    ranks come from one sort of a text's suffixes and words together, not from comparing each with each. Keys are as long
    as the longest word.
    """
    words = queries.select(F.col(word_col).alias("word")).where(F.col("word").isNotNull()).distinct()
    longest = words.agg(F.max(F.length("word"))).first()[0]
    if longest is None:
        return texts.limit(0).select(F.lit("").alias("word"), id_col, F.lit(0).cast("long").alias("lower"), F.lit(0).cast("long").alias("upper"))
    keys = suffixes(texts, id_col, text_col, max(key_len, longest)).select(id_col, F.col("suffix").alias("key"), F.lit(None).cast("string").alias("word"), F.lit(1).alias("n"), F.lit(0).alias("end"))
    ids = texts.where(F.length(text_col) > 0).select(id_col).distinct()
    # each word once before and once behind all that starts with it
    ends = ids.crossJoin(words).select(id_col, "word", F.explode(F.array(F.lit(0), F.lit(1))).alias("end"))
    marks = ends.select(id_col, F.when(F.col("end") == 1, F.concat("word", F.lit("\U0010ffff"))).otherwise(F.col("word")).alias("key"), "word", F.lit(0).alias("n"), "end")
    w = Window.partitionBy(id_col).orderBy("key", "n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = keys.union(marks).withColumn("upto", F.sum("n").over(w)).where("word is not null")
    return upto.groupBy("word", id_col).agg(F.min("upto").alias("lower"), F.max("upto").alias("upper"))


def substring_classes(texts: DataFrame, text_col: str, max_len: int | None = None) -> DataFrame:
    """(word, len, cnt, freq) of all substrings of 1..max_len characters over all texts, of every length where it is None.

    cnt counts occurrences. A substring is closed if no longer one by a character before it has the same count; freq of a
    closed one is cnt less the counts of the closed ones whose longest shorter closed suffix it is, else null: occurrences
    that no longer repeated context accounts for. Words of max_len have no longer ones here. All lengths are quadratic in
    the length of a text, as are the classes themselves; for long texts give a max_len.
    """
    from lexmill.operators.ngrams import occurrences

    if max_len is None:
        max_len = texts.agg(F.max(F.length(text_col))).first()[0] or 1
    counts = occurrences(texts, F.col(text_col), 1, max_len).groupBy("word", "len").agg(F.count("*").alias("cnt"))
    counts = scratch.written(counts, "suffix-counts")
    longer = counts.where("len > 1").select(F.expr("substring(word, 2)").alias("word"), F.col("cnt").alias("c"))
    best = longer.groupBy("word").agg(F.max("c").alias("c"))
    marked = counts.join(best, "word", "left").select("word", "len", "cnt", (F.coalesce("c", F.lit(0)) < F.col("cnt")).alias("closed"))
    closed = marked.where("closed")
    tails = closed.where("len > 1").select(F.col("word").alias("of"), "cnt", F.explode(F.expr("transform(sequence(1, len - 1), k -> right(word, k))")).alias("word"))
    parent = tails.join(closed.select("word", F.col("len").alias("n")), "word").groupBy("of").agg(F.max_by("word", "n").alias("word"), F.first("cnt").alias("c"))
    taken = parent.groupBy("word").agg(F.sum("c").alias("taken"))
    return marked.join(taken, "word", "left").select("word", "len", "cnt", F.when(F.col("closed"), F.col("cnt") - F.coalesce("taken", F.lit(0))).alias("freq"))


def top_residual(classes: DataFrame, k: int = 20) -> DataFrame:
    return classes.where("freq is not null").orderBy(F.desc("freq"), "word").limit(k)


def export_lines(arrays: DataFrame, id_col: str) -> DataFrame:
    """(id, sa, height, rank): each text's arrays as blank-joined text; for texts whose arrays fit a row."""
    by_rank = F.array_sort(F.collect_list(F.struct("rank", "pos", "height")))
    told = arrays.groupBy(id_col).agg(by_rank.alias("r"), F.array_sort(F.collect_list(F.struct("pos", "rank"))).alias("p"))
    join = lambda a, f: F.array_join(F.transform(a, lambda x: x[f].cast("string")), " ")
    return told.select(id_col, join("r", "pos").alias("sa"), join("r", "height").alias("height"), join("p", "rank").alias("rank"))


def export_listing(arrays: DataFrame, texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, lines): four labelled lines a text, its characters, suffix array, ranks and heights, blank-joined."""
    told = export_lines(arrays, id_col).join(texts.select(id_col, F.array_join(X.chars(F.col(text_col)), " ").alias("s")), id_col)
    label = lambda name, c: F.concat(F.lit(f"SA.{name}\n"), F.col(c))
    return told.select(id_col, F.concat_ws("\n", label("S", "s"), label("SA", "sa"), label("RANK", "rank"), label("HEIGHT", "height")).alias("lines"))
