"""Text conversion: max-match segmentation and a chain of dictionary conversions inside each segment."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from lexmill.operators.segment import max_match
from lexmill.sources import dictionaries as D

#: Entries that a converter may broadcast.
MAX_ENTRIES = 2_000_000


def _ready(tables: list[dict]) -> list[tuple[dict, int]]:
    return [(t, max(map(len, t), default=0)) for t in tables]


def replace_longest(text: str, tables: list[tuple[dict, int]]) -> str:
    """Each longest match, the first dictionary with any match winning, becomes its first value; other characters stay."""
    out, i = [], 0
    while i < len(text):
        for table, k in tables:
            n = next((n for n in range(min(k, len(text) - i), 0, -1) if text[i : i + n] in table), 0)
            if n:
                values = table[text[i : i + n]]
                out.append(values[0] if values else text[i : i + n])
                i += n
                break
        else:
            out.append(text[i])
            i += 1
    return "".join(out)


class Converter:
    def __init__(self, segmentation: list[dict], chain: list[list[dict]]):
        size = sum(len(t) for step in [segmentation, *chain] for t in step)
        if size > MAX_ENTRIES:
            raise ValueError(f"{size} dictionary entries; at most {MAX_ENTRIES} are broadcast")
        self.first, self.chain = _ready(segmentation), [_ready(step) for step in chain]

    def segments(self, text: str) -> list[str]:
        return max_match(text, self.first)

    def convert(self, text: str) -> str:
        parts = self.segments(text)
        for step in self.chain:
            parts = [replace_longest(p, step) for p in parts]
        return "".join(parts)


def converter(config: str, folders: tuple[str, ...] = ()) -> Converter:
    """From a preset's or file's name or from JSON text."""
    _, first, chain = D.read_config(config, folders) if config.lstrip().startswith("{") else D.preset(config, folders)
    return Converter(first, chain)


def convert(spark: SparkSession, text: Column, own: Converter) -> Column:
    shared = spark.sparkContext.broadcast(own)

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(lambda x: None if x is None else shared.value.convert(x))

    return run(text)


def segments(spark: SparkSession, text: Column, own: Converter) -> Column:
    shared = spark.sparkContext.broadcast(own)

    @F.pandas_udf("array<string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([None if x is None else shared.value.segments(x) for x in texts], dtype=object)

    return run(text)


def register(spark: SparkSession, folders: tuple[str, ...] = (), configs: tuple[str, ...] = tuple(D.PRESETS)) -> list[str]:
    """SQL function convert_zh(text, config) for the configurations whose dictionaries are there, which are returned.

    Dictionaries are read here, once, and broadcast; workers read no files. Another configuration's name is an error.
    """
    made: dict[str, Converter] = {}
    for c in configs:
        try:
            made[c] = converter(c, folders)
        except D.FileNotFound:
            continue
    shared = spark.sparkContext.broadcast(made)

    @F.pandas_udf("string")
    def convert_zh(texts: pd.Series, names: pd.Series) -> pd.Series:
        own = shared.value
        if missing := set(names.dropna()) - set(own):
            raise ValueError(f"no dictionaries for {sorted(missing)}")
        return pd.Series([None if x is None or c is None else own[c].convert(x) for x, c in zip(texts, names, strict=True)], dtype=object)

    spark.udf.register("convert_zh", convert_zh)
    return list(made)


def main(args: list[str] | None = None) -> None:
    """Command line: converts text line by line, without Spark."""
    import argparse
    import sys

    cli = argparse.ArgumentParser(description="Convert text by a configuration.")
    cli.add_argument("-c", "--config", required=True, help="a preset, a configuration file or JSON text")
    cli.add_argument("-i", "--input", help="input file; standard input by default")
    cli.add_argument("-o", "--output", help="output file; standard output by default")
    cli.add_argument("-p", "--path", action="append", default=[], help="folder of dictionaries and configurations, repeatable")
    cli.add_argument("--noflush", action="store_true", help="do not flush after each line")
    given = cli.parse_args(args)
    own = converter(given.config, tuple(given.path))
    source = open(given.input, encoding="utf-8") if given.input else sys.stdin
    sink = open(given.output, "w", encoding="utf-8") if given.output else sys.stdout
    try:
        for line in source:
            sink.write(own.convert(line))
            if not given.noflush:
                sink.flush()
    finally:
        if given.input:
            source.close()
        if given.output:
            sink.close()


if __name__ == "__main__":
    main()
