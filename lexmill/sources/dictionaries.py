"""Conversion dictionaries and configurations: scans, checks, search path, derived tables, writers.

A dictionary is a table (key, values array) or, on the driver, a mapping key -> values in file order.
"""

from __future__ import annotations

import json
import os
import struct
from collections.abc import Iterable
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class InvalidFormat(ValueError):
    """A dictionary or configuration that breaks its format."""


class FileNotFound(FileNotFoundError):
    """A dictionary or configuration that no folder of the search path holds."""


def parse_entry(line: str, number: int) -> tuple[str, list[str]]:
    key, tab, rest = line.partition("\t")
    if not tab:
        raise InvalidFormat(f"line {number}: no tab")
    values = [v for v in rest.split(" ") if v]
    if not values:
        raise InvalidFormat(f"line {number}: no value")
    return key, values


def load(path: str) -> dict[str, list[str]]:
    """A text dictionary on the driver; of repeated keys the last counts."""
    out: dict[str, list[str]] = {}
    with open(path, encoding="utf-8-sig") as file:
        for number, line in enumerate(file, 1):
            if line := line.rstrip("\r\n"):
                key, values = parse_entry(line, number)
                out[key] = values
    return out


def scan(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(line, key, values, error) of text dictionaries; ``error`` is null, "no tab" or "no value"."""
    text = spark.read.text(path).select(F.regexp_replace("value", "^﻿", "").alias("v"), F.monotonically_increasing_id().alias("line")).where("v <> ''")
    parts = F.split("v", "\t", 2)
    values = F.filter(F.split(F.coalesce(F.get(parts, F.lit(1)), F.lit("")), " "), lambda x: x != "")
    error = F.when(F.size(parts) < 2, "no tab").when(F.size(values) == 0, "no value")
    return text.select("line", parts[0].alias("key"), values.alias("values"), error.alias("error"))


def write(entries: DataFrame, path: str) -> None:
    """Text format, sorted by key."""
    line = F.concat_ws("\t", "key", F.array_join("values", " "))
    entries.orderBy("key").select(line.alias("value")).write.text(path)


# Binary form: number of entries, the keys' and the values' bytes (each string closed by a zero byte) behind their lengths,
# then for each entry the number of its values, the key's offset and the values' offsets; all numbers 8 bytes, little endian.
def to_binary(entries: dict[str, list[str]]) -> bytes:
    keys, values, table = bytearray(), bytearray(), []
    for key, own in sorted(entries.items(), key=lambda kv: kv[0].encode()):
        table += [len(own), len(keys)]
        keys += key.encode() + b"\0"
        for v in own:
            table.append(len(values))
            values += v.encode() + b"\0"
    number = struct.Struct("<Q").pack
    return b"".join([number(len(entries)), number(len(keys)), bytes(keys), number(len(values)), bytes(values), *map(number, table)])


def from_binary(data: bytes) -> dict[str, list[str]]:
    """Entries of the binary form; a header of 12 capitals or digits and the trie behind it are passed over."""
    at = 0
    if len(data) >= 20 and data[:12].isalnum() and data[:12].isupper():
        at = 20 + int.from_bytes(data[12:20], "little")

    def number() -> int:
        nonlocal at
        if at + 8 > len(data):
            raise InvalidFormat(f"binary dictionary ends at byte {len(data)}")
        at += 8
        return int.from_bytes(data[at - 8 : at], "little")

    def block() -> bytes:
        nonlocal at
        size = number()
        if at + size > len(data):
            raise InvalidFormat(f"binary dictionary ends at byte {len(data)}")
        at += size
        return data[at - size : at]

    def text(held: bytes, offset: int) -> str:
        end = held.find(b"\0", offset)
        if offset > len(held) or end < 0:
            raise InvalidFormat(f"binary dictionary: no string at offset {offset}")
        return held[offset:end].decode()

    n = number()
    keys, values = block(), block()
    out = {}
    for _ in range(n):
        many, key = number(), number()
        out[text(keys, key)] = [text(values, number()) for _ in range(many)]
    return out


def convert_file(source: str, target: str) -> None:
    """A dictionary file from text to binary or back, by the ending: .txt is text, everything else binary."""
    entries = load(source) if source.endswith(".txt") else from_binary(open(source, "rb").read())
    if target.endswith(".txt"):
        with open(target, "w", encoding="utf-8") as out:
            out.writelines(f"{k}\t{' '.join(v)}\n" for k, v in sorted(entries.items(), key=lambda kv: kv[0].encode()))
    else:
        with open(target, "wb") as out:
            out.write(to_binary(entries))


def scan_binary(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(key, values) of binary dictionaries; a file is one task's."""

    def read(batches):
        for b in batches:
            for content in b["content"]:
                entries = from_binary(bytes(content))
                yield pd.DataFrame({"key": list(entries), "values": list(entries.values())})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(read, "key string, values array<string>")


# Relational tooling
def merge(entries: DataFrame, order_col: str = "line") -> DataFrame:
    """One row a key: of repeated keys the one latest in ``order_col``."""
    return entries.groupBy("key").agg(F.max_by("values", order_col).alias("values"))


def reverse(entries: DataFrame, order_col: str = "line") -> DataFrame:
    """value -> its keys in input order."""
    each = entries.select(F.explode("values").alias("value"), "key", order_col).groupBy("value", "key").agg(F.min(order_col).alias("o"))
    listed = each.groupBy("value").agg(F.array_sort(F.collect_list(F.struct("o", "key"))).alias("k"))
    return listed.select(F.col("value").alias("key"), F.transform("k", lambda x: x["key"]).alias("values"))


def find_values(entries: DataFrame, keyword: str) -> DataFrame:
    """(key, value) for each value that holds the keyword."""
    return entries.select("key", F.explode("values").alias("value")).where(F.col("value").contains(keyword))


def lookup(queries: DataFrame, lexicon: DataFrame, word_col: str = "word") -> DataFrame:
    """``queries`` with ``values`` of the entry that is the word itself, null where none is; the group's first dictionary counts."""
    first = lexicon.groupBy(F.col("key").alias(word_col)).agg(F.min_by("values", "dict").alias("values"))
    return queries.join(first, word_col, "left")


def group_lexicon(entries: list[DataFrame]) -> DataFrame:
    """All entries of all dictionaries with their place in the group, repeated keys kept."""
    out = None
    for i, e in enumerate(entries):
        own = e.select(F.lit(i).alias("dict"), "key", "values")
        out = own if out is None else out.unionByName(own)
    return out


def prefix_matches(texts: DataFrame, text_col: str, lexicon: DataFrame) -> DataFrame:
    """(text, len, key, values): the entries that start a text; of one length the group's first dictionary counts."""
    each = texts.where(F.length(text_col) > 0).select(F.col(text_col).alias("text"), F.explode(F.sequence(F.lit(1), F.length(text_col))).alias("len"))
    heads = each.select("text", "len", F.expr("left(text, len)").alias("key"))
    found = heads.join(lexicon, "key")
    return found.groupBy("text", "len", "key").agg(F.min_by("values", "dict").alias("values"), F.min("dict").alias("dict"))


def longest_prefix(texts: DataFrame, text_col: str, lexicon: DataFrame) -> DataFrame:
    """(text, key, values): the first dictionary with a match wins, in it the longest."""
    found = prefix_matches(texts, text_col, lexicon)
    best = F.struct("dict", (-F.col("len")).alias("n"))
    return found.groupBy("text").agg(F.min_by("key", best).alias("key"), F.min_by("values", best).alias("values"))


# Configurations
#: Preset -> (segmentation dictionary, steps of dictionary groups).
PRESETS = {
    "s2t": ("STPhrases", (("STPhrases", "STCharacters"),)),
    "t2s": ("TSPhrases", (("TSPhrases", "TSCharacters"),)),
    "s2tw": ("STPhrases", (("STPhrases", "STCharacters"), ("TWVariants",))),
    "tw2s": ("TSPhrases", (("TWVariantsRevPhrases", "TWVariantsRev"), ("TSPhrases", "TSCharacters"))),
    "s2hk": ("STPhrases", (("STPhrases", "STCharacters"), ("HKVariantsPhrases", "HKVariants"))),
    "hk2s": ("TSPhrases", (("HKVariantsRevPhrases", "HKVariantsRev"), ("TSPhrases", "TSCharacters"))),
    "s2twp": ("STPhrases", (("STPhrases", "STCharacters"), ("TWPhrases",), ("TWVariants",))),
    "tw2sp": ("TSPhrases", (("TWVariantsRevPhrases", "TWVariantsRev"), ("TWPhrasesRev",), ("TSPhrases", "TSCharacters"))),
    "t2tw": ("TWVariants", (("TWVariants",),)),
    "t2hk": ("HKVariants", (("HKVariants",),)),
}
#: Dictionaries that are made of others.
DERIVED = {
    "TWPhrases": ("merge", ("TWPhrasesIT", "TWPhrasesName", "TWPhrasesOther")),
    "TWVariantsRev": ("reverse", ("TWVariants",)),
    "TWPhrasesRev": ("reverse", ("TWPhrases",)),
    "HKVariantsRev": ("reverse", ("HKVariants",)),
}


def named(name: str, folders: tuple[str, ...]) -> dict[str, list[str]]:
    """A dictionary by name: a file of the search path, or made of those it derives from.

    Merged ones hold all entries, of repeated keys the last; reversed ones the keys of each value in order. FileNotFound
    names the file that is missing.
    """
    try:
        return cached(find_file(name + ".txt", folders))
    except FileNotFound:
        if name not in DERIVED:
            raise
    way, sources = DERIVED[name]
    out: dict[str, list[str]] = {}
    for part in (named(s, folders) for s in sources):
        if way == "merge":
            out |= part
        else:
            for key, values in part.items():
                for v in values:
                    out.setdefault(v, []).append(key)
    return out


def find_file(name: str, folders: Iterable[str]) -> str:
    """The first match of the working directory and the folders in turn, as named or with an ending."""
    for folder in ("", *folders):
        for tail in ("", ".txt", ".json"):
            path = os.path.join(folder, name + tail)
            if os.path.isfile(path):
                return path
    raise FileNotFound(name)


@lru_cache(maxsize=64)
def cached(path: str) -> dict[str, list[str]]:
    """By path and so by form: .txt and files without an ending are text, .ocd is binary."""
    return from_binary(open(path, "rb").read()) if path.endswith(".ocd") else load(path)


def _need(node: dict, key: str, kind: type, where: str):
    if key not in node:
        raise InvalidFormat(f"{where}: property {key} is missing")
    if not isinstance(node[key], kind):
        raise InvalidFormat(f"{where}: property {key} must be of type {kind.__name__}")
    return node[key]


def read_dict(node: dict, folders: tuple[str, ...]) -> list[dict[str, list[str]]]:
    kind = _need(node, "type", str, "dict")
    if kind == "group":
        return [d for sub in _need(node, "dicts", list, "dict") for d in read_dict(sub, folders)]
    if kind not in ("text", "ocd", "inline"):
        raise InvalidFormat(f"dict: unknown type {kind}")
    if kind == "inline":
        return [{k: [v] if isinstance(v, str) else list(v) for k, v in _need(node, "entries", dict, "dict").items()}]
    name = _need(node, "file", str, "dict")
    return [cached(find_file(name, folders))]


def read_config(text: str, folders: tuple[str, ...] = ()):
    """A parsed JSON configuration: (name, segmentation dictionaries, steps of dictionaries)."""
    try:
        root = json.loads(text)
    except ValueError as e:
        raise InvalidFormat(f"config: {e}") from e
    if not isinstance(root, dict):
        raise InvalidFormat("config: root must be an object")
    segmentation = _need(root, "segmentation", dict, "config")
    if _need(segmentation, "type", str, "segmentation") != "mmseg":
        raise InvalidFormat(f"segmentation: unknown type {segmentation['type']}")
    first = read_dict(_need(segmentation, "dict", dict, "segmentation"), folders)
    steps = [read_dict(_need(s, "dict", dict, "conversion_chain"), folders) for s in _need(root, "conversion_chain", list, "config")]
    return str(root.get("name", "")), first, steps


def preset(name: str, folders: tuple[str, ...]):
    """A preset, or the configuration file of that name, whose own folder is searched before the others."""
    if name not in PRESETS:
        path = find_file(name, folders)
        with open(path, encoding="utf-8") as file:
            return read_config(file.read(), (os.path.dirname(path), *folders))
    seg, chain = PRESETS[name]
    return name, [named(seg, folders)], [[named(d, folders) for d in step] for step in chain]
