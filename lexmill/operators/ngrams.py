"""N-gram counts, word models and frequent substrings.

A word model is a table (word, len, cnt). Chunks are counted first and n-grams are cut from distinct chunks with their
counts as weights, so repeated chunks cost one row each before the shuffle on n-grams.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill import scratch
from lexmill.functions import text as X
from lexmill.operators import codes

#: Characters of a level's words that are broadcast at most.
FEW_CHARS = 200_000
#: Words that are sent to tasks at most.
MANY_WORDS = 200_000


def occurrences(rows: DataFrame, text: Column, low: int, high: int, keep: tuple[str, ...] = (), context: int = 0) -> DataFrame:
    """One row for each substring of low..high characters: ``keep``, pos (from 0), len, word.

    ``context`` n > 0 adds next and prev, the n characters after and before, null where the text has fewer.
    """
    base = rows.select(*keep, X.chars(text).alias("__chars")).where(F.size("__chars") >= low)
    c, n = F.col("__chars"), F.size("__chars")
    cut = lambda start, k: F.array_join(F.slice(c, start, k), "")

    def at(p: Column) -> Column:
        def one(k: Column) -> Column:
            fields = [(p - 1).alias("pos"), k.alias("len"), cut(p, k).alias("word")]
            if context:
                fields.append(F.when(p + k + context - 1 <= n, cut(p + k, F.lit(context))).alias("next"))
                fields.append(F.when(p > context, cut(F.greatest(p - context, F.lit(1)), F.lit(context))).alias("prev"))
            return F.struct(*fields)

        return F.transform(F.sequence(F.lit(low), F.least(F.lit(high), n - p + 1)), one)

    # built inside the row, so that no row after the explode carries its whole text
    places = F.transform(F.sequence(F.lit(1), n - low + 1), at)
    return base.select(*keep, F.explode(F.flatten(places)).alias("_g")).select(*keep, "_g.*")


def window_counts(texts: DataFrame, text_col: str, before: int, ahead: int, least: int = 1) -> DataFrame:
    """(window, at, cnt): distinct windows around the places of whole texts and how often each is there.

    A window reaches from ``before`` characters before a place, ``at`` of which the text has, to ``ahead`` from it on, as far
    as the text goes; places with fewer than ``least`` characters from them on are left out. Groups of texts are counted as
    arrays, so only their distinct windows become rows.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, end in codes.groups(batch.column(0), codes.STEP):
                for window, at, cnt in codes.window_counts(batch.column(0).slice(low, end - low), before, ahead, least):
                    yield pa.RecordBatch.from_arrays([window, pa.array(at.astype("int32")), pa.array(cnt.astype("int64"))], names=["window", "at", "cnt"])

    own = texts.where(F.length(text_col) >= least).select(text_col).mapInArrow(count, "window string, at int, cnt bigint")
    return own.groupBy("window", "at").agg(F.sum("cnt").alias("cnt"))


def fixed_counts(texts: DataFrame, text_col: str, n: int) -> DataFrame:
    """(word, cnt) of all substrings of n characters of whole texts."""
    return window_counts(texts, text_col, 0, n, n).select(F.col("window").alias("word"), "cnt")


def top(counts: DataFrame, k: int = 100) -> DataFrame:
    return counts.orderBy(F.desc("cnt"), "word").limit(k)


def chunk_counts(texts: DataFrame, text_col: str, breaks: str = "default") -> DataFrame:
    return texts.select(F.explode(X.chunks(F.col(text_col), breaks)).alias("chunk")).groupBy("chunk").agg(F.count("*").alias("times"))


def build_model(texts: DataFrame, text_col: str, max_len: int = 4, breaks: str = "default") -> DataFrame:
    """(word, len, cnt) of all substrings of 1..max_len characters inside chunks."""
    pieces = occurrences(chunk_counts(texts, text_col, breaks), F.col("chunk"), 1, max_len, ("times",))
    return pieces.groupBy("word", "len").agg(F.sum("times").alias("cnt"))


def add_words(model: DataFrame, words: DataFrame, word_col: str = "word", count_col: str | None = None) -> DataFrame:
    """The model with words counted in, their prefixes left alone."""
    weight = F.col(count_col).cast("long") if count_col else F.lit(1).cast("long")
    more = words.select(F.col(word_col).alias("word"), F.length(word_col).alias("len"), weight.alias("cnt"))
    return model.unionByName(more).groupBy("word", "len").agg(F.sum("cnt").alias("cnt"))


def decay(model: DataFrame, ratio: float) -> DataFrame:
    """Counts times the ratio, rounded down; words that reach 0 stay."""
    return model.withColumn("cnt", F.floor(F.col("cnt") * F.lit(float(ratio))).cast("long"))


def node_count(model: DataFrame) -> DataFrame:
    """n_nodes: distinct prefixes of all words and the root."""
    prefixes = model.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("word")), lambda k: F.left(F.col("word"), k))).alias("p"))
    return prefixes.distinct().agg((F.count("*") + 1).alias("n_nodes"))


def trie_nodes(model: DataFrame) -> DataFrame:
    """(node, depth, cnt) of all prefixes of the words and the root, in the order in which a walk reaches them.

    A walk goes down to a row deeper than the one before and up before a row that is not.
    """
    own = model.select("word", "cnt").withColumn("k", F.explode(F.sequence(F.lit(0), F.length("word"))))
    nodes = own.groupBy(F.expr("left(word, k)").alias("node")).agg(F.sum(F.when(F.col("k") == F.length("word"), F.col("cnt")).otherwise(0)).alias("cnt"))
    return nodes.select("node", F.length("node").alias("depth"), "cnt").orderBy("node")


def total_mass(model: DataFrame) -> DataFrame:
    return model.agg(F.coalesce(F.sum("cnt"), F.lit(0)).alias("total"))


def word_list(model: DataFrame) -> DataFrame:
    """(word, cnt) of counted words."""
    return model.where("cnt > 0").select("word", "cnt")


def repeated(texts: DataFrame, text_col: str, n: int) -> tuple[DataFrame, DataFrame]:
    """Substrings of n characters that occur twice or more, without those that hold a line end; and their total, with them."""
    found = fixed_counts(texts, text_col, n).where("cnt > 1")
    return found.where(~X.has_line_break(F.col("word"))), found.agg(F.coalesce(F.sum("cnt"), F.lit(0)).alias("total"))


def repeated_listing(texts: DataFrame, text_col: str, n: int) -> DataFrame:
    """The lines of a listing in order: ``count<TAB>text`` by count descending and text, then the total.

    Texts that hold a line end are counted in the total and not listed.
    """
    found = scratch.written(fixed_counts(texts, text_col, n).where("cnt > 1"), "ngram-repeated")
    own = found.where(~X.has_line_break(F.col("word"))).select(F.lit(0).alias("part"), "cnt", "word", F.concat_ws("\t", "cnt", "word").alias("line"))
    total = found.agg(F.coalesce(F.sum("cnt"), F.lit(0)).alias("t")).select(F.lit(1).alias("part"), F.lit(0).cast("long").alias("cnt"), F.lit("").alias("word"), F.concat(F.lit("Total Count: "), F.col("t").cast("string")).alias("line"))
    return own.union(total).orderBy("part", F.desc("cnt"), "word").select("line")


def frequent_substrings(texts: DataFrame, id_col: str, text_col: str, threshold: int, max_len: int | None = None, checkpoint_every: int = 4) -> DataFrame:
    """(word, len, cnt) of every substring that occurs ``threshold`` times or more, whatever its length.

    Equal texts are walked once, with their number as a weight. Level k + 1 looks at places whose first k and last k
    characters are both frequent. A level is one aggregation; the places that live on are written every few levels. Tables
    of places grow with the input though their files are small, so no join on them may broadcast; a level's words are
    broadcast where they are few.
    """
    held = texts.where(F.length(text_col) > 0).groupBy(F.col(text_col).alias("_t")).agg(F.count("*").alias("times"))
    rows = scratch.written(held.select(F.monotonically_increasing_id().alias("_d"), "_t", "times"), "frequent-rows")
    alive = occurrences(rows, F.col("_t"), 1, 1, ("_d", "times")).select("_d", "pos", "times", "word")
    chars = alive.select("_d", "pos", F.col("word").alias("ch"))
    found, k = None, 1
    while True:
        kept = alive.groupBy("word").agg(F.sum("times").alias("cnt")).where(F.col("cnt") >= threshold)
        level = scratch.written(kept.select("word", F.lit(k).alias("len"), "cnt"), "frequent-level")
        n = level.count()
        if n == 0:
            break
        found = level if found is None else found.unionByName(level)
        if max_len is not None and k >= max_len:
            break
        alive = alive.join(level.select("word").hint("broadcast" if n * k <= FEW_CHARS else "merge"), "word", "left_semi")
        after = alive.select("_d", (F.col("pos") - 1).alias("pos"))
        longer = alive.join(after.hint("merge"), ["_d", "pos"], "left_semi")
        tail = chars.select("_d", (F.col("pos") - k).alias("pos"), "ch")
        alive = longer.join(tail.hint("merge"), ["_d", "pos"]).select("_d", "pos", "times", F.concat("word", "ch").alias("word"))
        k += 1
        if k % checkpoint_every == 0:
            alive = scratch.written(alive, "frequent-places")
    return found if found is not None else level


def counts_of(queries: DataFrame, model: DataFrame, word_col: str = "word") -> DataFrame:
    """``queries`` with cnt from the model, 0 where it has none."""
    own = model.select(F.col("word").alias("_w"), F.col("cnt"))
    return queries.join(own, F.col(word_col) == F.col("_w"), "left").drop("_w").withColumn("cnt", F.coalesce("cnt", F.lit(0)))


def occurrence_counts(queries: DataFrame, texts: DataFrame, text_col: str, word_col: str = "word", missing: int = 0) -> DataFrame:
    """(word, cnt): occurrences, overlapping ones too, of each distinct query word in whole texts; ``missing`` where none.

    One pass over the texts, whatever the number of lengths. Up to MANY_WORDS words are sent to the tasks, which look for
    them in the bytes of whole groups of texts; more words are joined to the substrings of the lengths that are asked for.
    """
    words = queries.select(F.col(word_col).alias("word")).where(F.length(word_col) > 0).distinct()
    own = [r[0] for r in words.limit(MANY_WORDS + 1).collect()]
    if not own:
        return words.withColumn("cnt", F.lit(missing).cast("long"))
    if len(own) > MANY_WORDS:
        each = _cut_lengths(texts, text_col, words)
        hits = each.join(words, "word", "left_semi").groupBy("word").agg(F.count("*").alias("cnt"))
    else:

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            asked = codes.Words(own)
            total = sum((asked.count(batch.column(0)) for batch in batches), np.zeros(len(own), np.int64))
            found = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([own[i] for i in found], pa.string()), pa.array(total[found])], names=["word", "cnt"])

        found = texts.where(F.length(text_col) > 0).select(text_col).mapInArrow(count, "word string, cnt bigint")
        hits = found.groupBy("word").agg(F.sum("cnt").alias("cnt"))
    return words.join(hits, "word", "left").withColumn("cnt", F.coalesce("cnt", F.lit(missing).cast("long")))


def _cut_lengths(texts: DataFrame, text_col: str, words: DataFrame) -> DataFrame:
    """(word) for each place of the texts and each length that a word has."""
    lengths = [r[0] for r in words.select(F.length("word").alias("n")).distinct().orderBy("n").collect()]
    base = texts.select(X.chars(F.col(text_col)).alias("__c")).where(F.size("__c") >= lengths[0])
    asked = F.array(*(F.lit(n) for n in lengths))
    cut = lambda p: F.transform(F.filter(asked, lambda n: n <= F.size("__c") - p + 1), lambda n: F.array_join(F.slice("__c", p, n), ""))
    return base.select(F.explode(F.flatten(F.transform(F.sequence(F.lit(1), F.size("__c") - lengths[0] + 1), cut))).alias("word"))


def occurring(queries: DataFrame, texts: DataFrame, text_col: str, word_col: str = "word") -> DataFrame:
    """The rows of ``queries`` whose word occurs in some text; an empty word occurs wherever there is a text."""
    found = occurrence_counts(queries, texts, text_col, word_col).where("cnt > 0").select(F.col("word").alias(word_col))
    empty = texts.where(F.col(text_col).isNotNull()).limit(1).select(F.lit("").alias(word_col))
    return queries.join(found.union(empty), word_col, "left_semi")


def shares(counts: DataFrame, group: str, count_col: str = "cnt") -> DataFrame:
    """Each row's share of its group's counts."""
    return counts.withColumn("share", F.col(count_col) / F.sum(count_col).over(Window.partitionBy(group)))
