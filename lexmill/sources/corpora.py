"""Scans and sinks of corpora, dumps, title lists, models and indexes."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.functions import text as X

DUMP_SCHEMA = "title array<string>, ns long, revision array<struct<id: long, text: array<struct<_VALUE: string, _bytes: long>>>>"
RULE = "=" * 20


# Scans
def text_files(spark: SparkSession, path: str | list[str], encoding: str = "UTF-8", limit: int | None = None) -> DataFrame:
    """(path, text) of whole files; ``limit`` keeps the first characters, for trials."""
    if encoding.upper().replace("-", "") == "UTF8":
        base = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.regexp_replace("value", "^﻿", "").alias("text"))
    else:
        base = spark.read.format("binaryFile").load(path).select("path", F.decode("content", encoding).alias("text"))
    return base.withColumn("text", F.left("text", F.lit(limit))) if limit is not None else base


def concatenated(files: DataFrame, sep: str = "") -> DataFrame:
    """(text): all files in the order of their paths as one text, so that n-grams run across them. For texts that fit a row."""
    parts = files.agg(F.array_sort(F.collect_list(F.struct("path", "text"))).alias("f"))
    return parts.select(F.array_join(F.transform("f", lambda x: x["text"]), sep).alias("text"))


def first_given(*tables: DataFrame | None) -> DataFrame:
    """The first input that is given and has rows, such as typed text before a loaded file before the model's text."""
    for t in tables:
        if t is not None and not t.isEmpty():
            return t
    raise ValueError("no input has rows")


def lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return spark.read.text(path).withColumnRenamed("value", "text")


def title_index(spark: SparkSession, path: str, blacklist: DataFrame | None = None) -> DataFrame:
    """(title) of ``offset:pageid:title`` lines, plain or bz2, without the blacklisted ones."""
    return without_titles(spark.read.text(path).select(X.index_title(F.col("value")).alias("title")), blacklist)


def title_list(spark: SparkSession, path: str, blacklist: DataFrame | None = None) -> DataFrame:
    return without_titles(spark.read.text(path).where("value <> ''").select(F.col("value").alias("title")), blacklist)


def without_titles(titles: DataFrame, blacklist: DataFrame | None) -> DataFrame:
    return titles if blacklist is None else titles.join(blacklist.select("title"), "title", "left_anti")


def xml_dump(spark: SparkSession, path: str, strict_text: bool = False, broken: str = "raise") -> DataFrame:
    """(title, text) of the namespace-0 pages of a dump; ``strict_text`` leaves pages with an empty text out.

    A page of namespace 0 must have exactly one title and one text. ``broken``: others "raise" an error or are "drop"ped.
    """
    if broken not in ("raise", "drop"):
        raise ValueError(f"broken {broken!r}")
    pages = spark.read.format("xml").option("rowTag", "page").option("ignoreNamespace", "true").schema(DUMP_SCHEMA).load(path).where("ns = 0")
    texts = F.flatten(F.transform(F.coalesce("revision", F.array()), lambda r: F.coalesce(r["text"], F.array())))
    counted = pages.select("title", texts.alias("texts"))
    sound = (F.size(F.coalesce("title", F.array())) == 1) & (F.size("texts") == 1)
    if broken == "drop":
        counted = counted.where(sound)
    text = F.when(sound, F.coalesce(F.col("texts")[0]["_VALUE"], F.lit(""))).otherwise(F.raise_error(F.concat(F.lit("not exactly one title and text: "), F.array_join(F.coalesce("title", F.array()), ", "))))
    kept = counted.select(F.get("title", F.lit(0)).alias("title"), text.alias("text"))
    return kept.where("text <> ''") if strict_text else kept


def emission_table(rows: DataFrame, text_col: str = "value") -> DataFrame:
    """(state, ch, log_prob) of a table written as a program text with one braced literal."""
    literal = F.regexp_extract(F.col(text_col), r"(?s)(\{.*\})", 1)
    parsed = F.from_json(F.regexp_replace(literal, "'", '"'), "map<string,map<string,double>>")
    return rows.select(F.explode(parsed).alias("state", "m")).select("state", F.explode("m").alias("ch", "log_prob"))


# Binary forms
def trie_bytes(words: list[tuple[str, int]]) -> bytes:
    """Preorder: count, then (1, character, subtree) for each child, then 0; characters in UTF-8."""
    root: dict = {}
    counts: dict[tuple, int] = {}
    for w, c in words:
        node, path = root, ()
        for ch in w:
            node, path = node.setdefault(ch, {}), (*path, ch)
        counts[path] = counts.get(path, 0) + c
    out: list[bytes] = []
    todo: list = [("node", root, ())]
    while todo:
        kind, node, path = todo.pop()
        if kind == "raw":
            out.append(node)
            continue
        out.append(struct.pack("<q", counts.get(path, 0)))
        todo.append(("raw", b"\0", ()))
        for ch, child in sorted(node.items(), reverse=True):
            todo += [("node", child, (*path, ch)), ("raw", b"\1" + ch.encode("utf-8"), ())]
    return b"".join(out)


def trie_words(data: bytes) -> Iterator[tuple[str, int]]:
    """(word, count) of counted words, in order."""
    at, path = 0, []
    fresh = True
    while at < len(data):
        if fresh:
            (count,) = struct.unpack_from("<q", data, at)
            at += 8
            if count:
                yield "".join(path), count
            fresh = False
        flag, at = data[at], at + 1
        if not flag:
            if path:
                path.pop()
            continue
        size = 1 if data[at] < 0x80 else 2 if data[at] < 0xE0 else 3 if data[at] < 0xF0 else 4
        path.append(data[at : at + size].decode("utf-8"))
        at += size
        fresh = True


def load_trie(spark: SparkSession, path: str) -> DataFrame:
    """(word, len, cnt) of saved tries; one file is one task."""
    files = spark.read.format("binaryFile").load(path).select("content")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for content in b["content"]:
                rows = []
                for w, c in trie_words(bytes(content)):
                    rows.append((w, len(w), c))
                    if len(rows) == 100_000:
                        yield pd.DataFrame(rows, columns=["word", "len", "cnt"])
                        rows = []
                yield pd.DataFrame(rows, columns=["word", "len", "cnt"])

    return files.mapInPandas(read, "word string, len int, cnt long")


def save_model(model: DataFrame, path: str) -> None:
    model.write.parquet(path)


def load_model(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def save_suffix_array(array: DataFrame, path: str) -> None:
    """The array's places and heights by rank; the inverse of rank and place is not stored twice."""
    array.write.parquet(path)


def load_suffix_array(spark: SparkSession, path: str) -> DataFrame:
    """The saved array as it was; nothing is sorted again."""
    return spark.read.parquet(path)


# Sinks
def article_block(title: Column, body: Column, style: str = "crawl") -> Column:
    """A page as text: a ruled title line, then the body. Style crawl or dump."""
    end = "\r\n" if style == "crawl" else "\n"
    return F.concat(F.lit(end + RULE), title, F.lit(RULE + ("\r\n" if style == "crawl" else "\n")), body)


def write_articles(pages: DataFrame, path: str, title_col: str = "title", text_col: str = "text", style: str = "crawl") -> None:
    pages.select(article_block(F.col(title_col), F.col(text_col), style).alias("value")).write.text(path)


def write_words(segmented: DataFrame, path: str, words_col: str = "words") -> None:
    segmented.select(F.explode(words_col).alias("value")).write.text(path)


def write_counts(counts: DataFrame, path: str, header: bool = False, ordered: bool = False) -> None:
    """``word,count`` lines, or with a header for words-per-count tables; ``ordered``: by their first column."""
    (counts.orderBy(counts.columns[0]) if ordered else counts).write.csv(path, header=header)


def write_phrases(phrases: DataFrame, path: str) -> None:
    cols = ["word", "freq", "log_prob", "cohesion", "suffix_entropy", "prefix_entropy"]
    total = (F.col("suffix_entropy") + F.col("prefix_entropy")).alias("entropy")
    phrases.select(F.concat_ws(" ", *cols[:4], total, cols[5], cols[4]).alias("value")).write.text(path)


def write_texts(texts: DataFrame, path: str, text_col: str = "text") -> None:
    texts.select(F.col(text_col).alias("value")).write.text(path)


def preview(text: Column, n: int = 10_000, mark: str = "(Cut)") -> Column:
    return F.when(F.length(text) > n, F.concat(F.left(text, F.lit(n)), F.lit(mark))).otherwise(text)


def errors(pages: DataFrame, error_col: str = "extract_error") -> DataFrame:
    """Dead letters: rows whose extraction named an error."""
    return pages.where(F.col(error_col).isNotNull())
