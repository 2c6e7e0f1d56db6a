"""SimHash near-duplicates with pigeonring candidate filtering.

The 64 bits form a ring of 16 segments of four bits. For two fingerprints that differ in at most 3 bits there is a start
from which every chain of l consecutive segments holds at most floor(3 l / 16) differences: none in the first five
segments, one in ten, two in fifteen. Bits 1-20 from such a start agree and so does one half of bits 21-40: those 30
bits are the join key (16 starts x 2 halves). A bucket's members are pruned by the chain budgets at 10 and 15 segments
before the full Hamming check. Buckets are never turned into all their pairs: two members are compared in the plan,
up to ``BUCKET`` members by a walk that leaves a spanning forest, and larger buckets by bit variants (below), all exact.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexmill.llm.graph import connected_components
from lexmill.llm.runtime import bound_batches, materialise, release, unused

SEGMENTS, WIDTH, MAX_DIFF, SHINGLE, SEED = 16, 4, 3, 3, 42
#: Members of a bucket that one task compares directly.
BUCKET = 4096
#: Rows from which a fingerprint counts as shared by very many, and how many such are broadcast (200 kB).
HOT_ROWS, HOT_CLASSES = 200, 8_000
_SLICE = 1 << 16


def simhash_value(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The unsigned 64-bit fingerprint of one text; null and word-free texts give 0."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    xx, join = xxhash.xxh64_intdigest, b" ".join
    if len(words) < shingle:
        return xx(join(words), seed)
    grams = map(join, zip(*(words[i:] for i in range(shingle)), strict=False))
    return majority(np.fromiter((xx(s, seed) for s in grams), dtype="<u8", count=len(words) - shingle + 1))


def majority(hashes: np.ndarray) -> int:
    """The 64 bits that more than half of the hashes have set."""
    total = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), _SLICE):
        bits = np.unpackbits(np.ascontiguousarray(hashes[at : at + _SLICE]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(total * 2 > len(hashes), bitorder="little").view("<u8")[0])


def simhash(text: Column | str) -> Column:
    """The fingerprint as a signed long."""

    @F.pandas_udf(T.LongType())
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([simhash_value(x) for x in texts], dtype=np.uint64).view(np.int64))

    return of(text)


def fingerprint_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def _rotated(c: Column, start: int) -> Column:
    k = start * WIDTH
    return c if not k else F.shiftleft(c, k).bitwiseOR(F.shiftrightunsigned(c, 64 - k))


def _keys(fp: Column) -> Column:
    out = []
    for start in range(SEGMENTS):
        top = F.shiftrightunsigned(_rotated(fp, start), 24)  # 40 bits: chains of ten segments
        first = F.shiftrightunsigned(top, 20)
        for half, ten in enumerate((F.shiftrightunsigned(top, 10), top)):
            bits = F.shiftleft(first, 10).bitwiseOR(ten.bitwiseAND(F.lit(1023)))
            out.append(F.lit((start * 2 + half) << 30).cast("long").bitwiseOR(bits))
    return F.array(*out)


def _within(x: Column, start: Column) -> Column:
    """Chain budgets from the start, then the whole distance; x is the xor of two fingerprints."""
    ring = F.lit(False)
    for s in range(SEGMENTS):
        r = _rotated(x, s)
        ring = ring | ((start == s) & (F.bit_count(F.shiftrightunsigned(r, 24)) <= 1) & (F.bit_count(F.shiftrightunsigned(r, 4)) <= 2))
    return ring & (F.bit_count(x) <= MAX_DIFF)


def _forest(values: np.ndarray, start: int) -> Iterator[tuple[int, np.ndarray]]:
    """Links of one bucket that span what the key's chain connects: fewer than it has members."""
    rest, k = values, np.uint64(start * WIDTH)
    while len(rest):
        stack, rest = [rest[0]], rest[1:]
        while stack and len(rest):
            x = rest ^ (one := stack.pop())
            r = (x << k) | (x >> np.uint64(64 - start * WIDTH)) if start else x
            near = (np.bitwise_count(r >> np.uint64(24)) <= 1) & (np.bitwise_count(r >> np.uint64(4)) <= 2)
            near &= np.bitwise_count(x) <= MAX_DIFF
            if near.any():
                found = rest[near]
                yield one, found
                stack += list(found)
                rest = rest[~near]


def _link_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches sorted by key: each run of a key (at most BUCKET rows) becomes its forest."""

    def linked(key: int, values: np.ndarray) -> Iterator[pa.RecordBatch]:
        for one, found in _forest(np.unique(values), int(key) >> 31):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), one).view(np.int64)), pa.array(found.view(np.int64))], names=["src", "dst"])

    held_key, held = None, []
    for batch in batches:
        keys, values = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
        cuts = np.flatnonzero(np.diff(keys)) + 1
        for key, part in zip(keys[np.r_[0, cuts]] if len(keys) else (), np.split(values, cuts), strict=False):
            if key != held_key and held:
                yield from linked(held_key, np.concatenate(held))
                held = []
            held_key = key
            held.append(part)
    if held:
        yield from linked(held_key, np.concatenate(held))


def _variant_links(hot: DataFrame) -> DataFrame:
    """Exact links of fingerprints in very large buckets, linear in their number.

    a and b differ in at most 3 bits exactly if some x is within 1 bit of a and within 2 bits of b. All that are within 2
    bits of an x hang on the smallest that is within 1 bit of it.
    """
    ones = [0, *(1 << i for i in range(64))]
    twos = [*ones, *((1 << i) | (1 << j) for i in range(64) for j in range(i))]
    signed = lambda masks: F.array(*(F.lit(m - (1 << 64) if m >> 63 else m).cast("long") for m in masks))

    def around(masks: list[int]) -> DataFrame:
        return hot.withColumn("m", F.explode(signed(masks))).select(F.col("fp").bitwiseXOR(F.col("m")).alias("x"), "fp")

    least = around(ones).groupBy("x").agg(F.min("fp").alias("src"))
    return around(twos).join(least, "x").where("src <> fp").select("src", F.col("fp").alias("dst")).distinct()


def near_links(fps: DataFrame, fp: str = "fp", bucket: int = BUCKET) -> DataFrame:
    """(src, dst) between distinct long fingerprints at most 3 bits apart, enough to connect all that are."""
    spark = fps.sparkSession
    distinct = fps.select(F.col(fp).cast("long").alias("fp")).where("fp is not null").distinct()
    # few bytes become 32 keys each: a number of partitions that is asked for is not coalesced before that
    distinct = distinct.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    keyed = distinct.select(F.explode(_keys(F.col("fp"))).alias("key"), "fp")
    counts, counts_path = materialise(keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("fp").alias("lo"), F.max("fp").alias("hi")).where("n > 1"), "simhash-keys")
    pairs = counts.where("n = 2").where(_within(F.col("lo").bitwiseXOR(F.col("hi")), F.shiftright("key", 31))).select(F.col("lo").alias("src"), F.col("hi").alias("dst"))
    members = keyed.join(counts.where("n > 2").select("key", "n"), "key")
    runs = members.where(F.col("n") <= bucket).select("key", "fp").repartition("key").sortWithinPartitions("key")
    links = pairs.union(runs.mapInArrow(_link_runs, "src long, dst long"))
    if not counts.where(F.col("n") > bucket).isEmpty():
        links = links.union(_variant_links(members.where(F.col("n") > bucket).select("fp").distinct()))
    out, _ = materialise(links.distinct(), "simhash-links")
    release(spark, counts_path)
    return out


def _fingerprints(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    bound_batches(docs.sparkSession)
    return materialise(docs.select(F.col(id_col).alias("id"), simhash(F.col(text_col)).alias("fp")), "simhash-fps")[0]


def _classes(firsts: DataFrame, links: DataFrame) -> DataFrame:
    """(fp, first, n, component_id, kept) of each distinct fingerprint: its smallest id, how many rows, whether one stays.

    Components may share their smallest id, where that id occurs with several texts; each keeps a fingerprint of its own.
    """
    labels = connected_components(links)
    named = firsts.join(labels.withColumnRenamed("vertex", "fp"), "fp")
    least = named.where("first is not null").groupBy("component").agg(F.min(F.struct("first", "fp")).alias("least"))
    told = named.join(least, "component").select("fp", F.col("least.first").alias("component_id"), (F.col("fp") == F.col("least.fp")).alias("kept"))
    every = firsts.join(told, "fp", "left")
    return every.select("fp", "first", "n", F.coalesce("component_id", "first").alias("component_id"), F.coalesce("kept", F.col("first").isNotNull()).alias("kept"))


def _firsts(fps: DataFrame) -> DataFrame:
    return materialise(fps.groupBy("fp").agg(F.min("id").alias("first"), F.count("*").alias("n")), "simhash-firsts")[0]


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (id, fp, component_id) per row of ``docs``; component_id is the smallest id reachable over links.

    Null texts count as empty (fingerprint 0, linked like any other); repeated rows stay; a component whose ids are all
    null has a null component_id; an empty table gives no rows. Other columns of ``docs`` are not read. Fingerprints of
    very many rows are told their class by a broadcast of at most ``HOT_CLASSES``, so large groups of copies meet in no task.
    """
    fps = _fingerprints(docs, id_col, text_col)
    firsts = _firsts(fps)
    classes, _ = materialise(_classes(firsts, near_links(firsts)), "simhash-classes")
    hot = classes.where(F.col("n") > HOT_ROWS).orderBy(F.desc("n"), "fp").limit(HOT_CLASSES).select("fp", F.col("component_id").alias("hot"), F.lit(True).alias("is_hot"))
    near = fps.join(F.broadcast(hot), "fp", "left").withColumn("key", F.when(F.col("is_hot").isNull(), F.col("fp")).otherwise(F.xxhash64("id", "fp")))
    told = near.join(classes.select(F.col("fp").alias("key"), "component_id"), "key", "left")
    return told.select(F.col("id").alias(id_col), "fp", F.when(F.col("is_hot").isNull(), F.col("component_id")).otherwise(F.col("hot")).alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns as they are, of which one stays for each near-duplicate component.

    The row with the component's smallest id stays. Of the component's rows that share that id one stays; rows with a null id stay all.
    Classes are never joined to rows by fingerprint, so a large group of copies meets in no task.
    """
    fps = _fingerprints(docs, id_col, text_col)
    return keep_first(docs, fps, near_links(fps), simhash, id_col, text_col)


def keep_first(docs: DataFrame, fps: DataFrame, links: DataFrame, of: Callable[[Column], Column], id_col: str, text_col: str) -> DataFrame:
    """``keep_one`` for fingerprints (id, fp), which ``of`` makes of a text, and the links between them."""
    classes, _ = materialise(_classes(_firsts(fps), links), "simhash-classes")
    key, own, wanted = unused(docs, "_kept"), unused(docs, "_fp"), unused(docs, "_fp_kept")
    first = classes.where("kept").select(F.col("first").alias(key), F.col("fp").alias(wanted))
    if fps.where("id is not null").groupBy("id").count().where("count > 1").isEmpty():
        kept = docs.join(first.select(key), F.col(id_col) == F.col(key), "left_semi")
    else:  # rows of one id may differ in text, so the fingerprint has to fit too
        same = (F.col(id_col) == F.col(key)) & (F.col(own) == F.col(wanted))
        kept = docs.withColumn(own, of(F.col(text_col))).join(first, same, "left_semi").dropDuplicates([id_col, own]).select(*docs.columns)
    if not fps.where("id is null").isEmpty():
        kept = kept.union(docs.where(F.col(id_col).isNull()))
    return kept
