"""Benchmark decontamination with a broadcast hash set of normalised test n-grams.

Texts are lower-cased (A-Z) and cut into words of digits, letters and non-ASCII characters. Every window of ``n`` words
of every item (a shorter item is one window) is a key of a hash set that is sent to all executors; document windows are
looked up whole, so each hit is verified by equality of its words and no hash collision can remove a document. The set's
size is checked by what it holds, pairs of window and item: beyond ``max_pairs`` the pairs are dealt by hash into groups
within that bound, whatever item they are of, and the corpus is scanned once a group, with the hits of all groups merged
by document. So memory on driver and executors does not grow with the benchmark; the number of scans does.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.llm.runtime import bound_batches, materialise, release, unused

WINDOW = 10
#: Pairs of window and item that one broadcast set holds, about 60 MB in a worker.
MAX_PAIRS = 250_000
TABLE = bytes(b | 32 if 65 <= b <= 90 else b if b > 127 or 97 <= b <= 122 or 48 <= b <= 57 else 32 for b in range(256))
_RESULT = "n_words long, hits array<struct<lo:int,hi:int>>, items array<string>, chars array<struct<lo:int,hi:int>>"


def normal_words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(TABLE).split()


def windows_of(text: str | None, n: int = WINDOW) -> set[bytes]:
    """The distinct windows of one item, words joined by blanks. A null item and one without words hold none."""
    words = normal_words(text)
    k = min(n, len(words))
    return {b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)} if k else set()


def window_set(pairs: Iterable[tuple[str, bytes]]) -> dict[int, dict[bytes, tuple[str, ...]]]:
    """Length of window -> window -> the items that hold it, from pairs (item, window)."""
    found: dict[int, dict[bytes, set[str]]] = {}
    for item, window in pairs:
        found.setdefault(window.count(b" ") + 1, {}).setdefault(window, set()).add(item)
    return {k: {w: tuple(sorted(s)) for w, s in v.items()} for k, v in found.items()}


class Scanner:
    """Looks a document's windows up; first whether all its words are known to the set, by runs of known words."""

    def __init__(self, windows: dict[int, dict[bytes, tuple[str, ...]]]):
        self.windows = windows
        self.known = {w for v in windows.values() for key in v for w in key.split(b" ")}

    def scan(self, text: str | None) -> tuple[int, list[tuple[int, int]], list[str]]:
        """Words, hit runs of words (merged, end exclusive) and items, sorted."""
        words = normal_words(text)
        known = np.fromiter(map(self.known.__contains__, words), dtype=np.int8, count=len(words))
        edges = np.flatnonzero(np.diff(np.r_[0, known, 0]))
        hit, items = np.zeros(len(words), dtype=bool), set()
        for lo, hi in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            for k, table in self.windows.items():
                for i in range(lo, hi - k + 1):
                    if (of := table.get(b" ".join(words[i : i + k]))) is not None:
                        hit[i : i + k] = True
                        items.update(of)
        runs = np.flatnonzero(np.diff(np.r_[0, hit.view(np.int8), 0]))
        return len(words), list(zip(runs[::2].tolist(), runs[1::2].tolist(), strict=True)), sorted(items)


def char_spans(text: str, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Code-point spans of runs of words."""
    if not runs:
        return []
    bounds = [m.span() for m in re.finditer(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text)]
    return [(bounds[lo][0], bounds[hi - 1][1]) for lo, hi in runs]


def _scan_column(shared: Broadcast, text: Column) -> Column:
    @F.pandas_udf(_RESULT)
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scanner = Scanner(shared.value)
        for texts in batches:
            rows = []
            for x in texts:
                n, runs, items = scanner.scan(x)
                rows.append((n, [{"lo": a, "hi": b} for a, b in runs], items, [{"lo": a, "hi": b} for a, b in char_spans(x or "", runs)]))
            yield pd.DataFrame(rows, columns=["n_words", "hits", "items", "chars"])

    return scan(text)


def _pairs(benchmark: DataFrame, item_col: str, text_col: str, n: int) -> tuple[DataFrame, str]:
    """The distinct pairs (item, window), written."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for item, text in zip(b["item"], b["text"], strict=True):
                own = sorted(windows_of(text, n))
                for at in range(0, len(own), 10_000):
                    yield pd.DataFrame({"item": item, "window": own[at : at + 10_000]})

    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).alias("text")).where("item is not null")
    return materialise(items.mapInPandas(cut, "item string, window binary").distinct(), "decontam-pairs")


def _groups(pairs: DataFrame, max_pairs: int) -> Iterator[dict]:
    """Window sets of groups of pairs, each of about max_pairs at most."""
    total = pairs.count()
    count = math.ceil(1.2 * total / max_pairs) if total > max_pairs else 1
    for g in range(count):
        part = pairs if count == 1 else pairs.where(F.pmod(F.xxhash64("item", "window"), F.lit(count)) == g)
        yield window_set((r["item"], bytes(r["window"])) for r in part.toLocalIterator())


def scan(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", n: int = WINDOW, max_pairs: int = MAX_PAIRS, out: str = "_scan") -> DataFrame:
    """``docs`` and a column ``out``: struct(n_words, hits, items, chars); ``out`` must be no column of ``docs``.

    hits are merged runs of hit words, chars their code-point spans, items the sorted items whose windows occur. A null
    or empty text has no words and no hits; rows repeat as they come; an empty benchmark hits nothing; items with a null
    id or without words hold no window. One scan of ``docs`` while the pairs of window and item fit ``max_pairs``; beyond
    it one scan a group of pairs, and the parts of a row (told apart by id and text) are merged.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    pairs, pairs_path = _pairs(benchmark, item_col, item_text, n)
    groups = _groups(pairs, max_pairs)
    base = docs.withColumn(out, _scan_column(spark.sparkContext.broadcast(next(groups)), F.col(text_col)))
    key = [F.col(id_col).cast("string").alias("i"), F.sha2(F.col(text_col).cast("binary"), 256).alias("t")]
    hits = None
    for windows in groups:
        shared = spark.sparkContext.broadcast(windows)
        found, _ = materialise(docs.select(*key, _scan_column(shared, F.col(text_col)).alias("s")).where(F.size("s.hits") > 0).distinct(), "decontam-hits")
        shared.destroy()
        hits = found if hits is None else hits.union(found)
    release(spark, pairs_path)
    if hits is None:
        return base
    first = base.select(*key, F.col(out).alias("s")).where(F.size("s.hits") > 0).distinct()
    parts, _ = materialise(hits.union(first), "decontam-hits")
    i, t, ri, rt, own, rest = (unused(docs, c) for c in ("_i", "_t", "_ri", "_rt", "_own", "_rest"))
    merged = parts.groupBy(F.col("i").alias(i), F.col("t").alias(t)).agg(F.struct(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("s.items")))).alias("items"),
        _merged(F.flatten(F.collect_list("s.hits"))).alias("hits"),
        _merged(F.flatten(F.collect_list("s.chars"))).alias("chars"),
    ).alias(rest))
    keyed = base.withColumns({ri: key[0], rt: key[1]}).withColumnRenamed(out, own)
    told = keyed.join(merged, F.col(ri).eqNullSafe(F.col(i)) & F.col(rt).eqNullSafe(F.col(t)), "left")
    pick = lambda c: F.coalesce(F.col(rest)[c], F.col(own)[c]).alias(c)
    return told.withColumn(out, F.struct(F.col(own)["n_words"].alias("n_words"), pick("hits"), pick("items"), pick("chars"))).select(*docs.columns, out)


def _merged(spans: Column) -> Column:
    """Union of spans as sorted, disjoint runs."""
    empty = F.array().cast("array<struct<lo:int,hi:int>>")

    def put(done: Column, s: Column) -> Column:
        last = F.element_at(done, -1)
        joined = F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(F.struct(last["lo"].alias("lo"), F.greatest(last["hi"], s["hi"]).alias("hi"))))
        return F.when((F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["hi"] >= s["lo"]), joined).otherwise(F.concat(done, F.array(s)))

    return F.aggregate(F.array_sort(spans), empty, put)


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kwargs) -> DataFrame:
    """(id, n_words, n_hit, n_items, items_sha256, contaminated) of each row of ``docs``."""
    s = lambda c: F.col(f"_scan.{c}")
    n_hit = F.aggregate(s("hits"), F.lit(0).cast("long"), lambda a, x: a + (x["hi"] - x["lo"]))
    scanned = scan(docs.select(id_col, text_col), benchmark, id_col, text_col, **kwargs)
    return scanned.select(
        id_col, s("n_words").alias("n_words"), n_hit.alias("n_hit"), F.size(s("items")).cast("long").alias("n_items"),
        F.sha2(F.array_join(s("items"), ",").cast("binary"), 256).alias("items_sha256"), (F.size(s("hits")) > 0).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, mode: str = "documents", text_col: str = "text", id_col: str = "doc_id", length_col: str | None = "n_chars", **kwargs) -> DataFrame:
    """``docs`` without contaminated rows (mode "documents") or with the hit spans cut from the texts (mode "spans").

    Clean rows stay as they are, null texts too. In mode "spans" a length column, where there is one, follows the text.
    """
    if mode not in ("documents", "spans"):
        raise ValueError(f"mode {mode!r}")
    out = unused(docs, "_scan")
    scanned = scan(docs, benchmark, id_col, text_col, out=out, **kwargs)
    hit = F.size(F.col(out)["hits"]) > 0
    if mode == "documents":
        return scanned.where(~hit).select(*docs.columns)

    @F.pandas_udf("string")
    def cut(texts: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for x, own in zip(texts, spans, strict=True):
            if x is not None and len(own):
                ends = [0, *(e for s in own for e in (s["lo"], s["hi"])), len(x)]
                x = "".join(x[a:b] for a, b in zip(ends[::2], ends[1::2], strict=True))
            out.append(x)
        return pd.Series(out, dtype=object)

    changed = scanned.withColumn(text_col, F.when(hit, cut(F.col(text_col), F.col(out)["chars"])).otherwise(F.col(text_col)))
    if length_col in docs.columns:
        changed = changed.withColumn(length_col, F.when(hit, F.length(text_col).cast("long")).otherwise(F.col(length_col)))
    return changed.select(*docs.columns)
