"""Element-wise vector operations and exact integer convolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def increment(a: Column, by: int = 1) -> Column:
    return F.transform(a, lambda x: x + by)


def equal(a: Column, b: Column) -> Column:
    """Whether both have the same length and elements; null elements equal each other."""
    return (F.size(a) == F.size(b)) & F.forall(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), lambda x: x)


def convolve(a: Column, b: Column) -> Column:
    """Bigint array of length n + m - 1 for two integer arrays of a row; [] where one is empty."""
    n, m = F.size(a), F.size(b)

    def at(k: Column) -> Column:
        low, high = F.greatest(F.lit(0), k - m + 1), F.least(k, n - 1)
        return F.aggregate(F.sequence(low, high), F.lit(0).cast("bigint"), lambda s, i: s + F.get(a, i).cast("bigint") * F.get(b, k - i).cast("bigint"))

    return F.when((n > 0) & (m > 0), F.transform(F.sequence(F.lit(0), n + m - 2), at)).otherwise(F.array().cast("array<bigint>"))


def convolve_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """(k, value) for two vectors as rows (i, value), exactly, as the sum over all pairs of their blocks of 4,096.

    The work is the product of the two lengths, as the definition has it, dealt by pairs of blocks: two vectors of n and m
    places make n m / 2^24 pairs. Blocks are joined each with each; a pair is one row that a task convolves.
    """
    block = 4096
    packed = lambda v, name: v.groupBy((F.col("i") / block).cast("long").alias(f"{name}b")).agg(F.array_sort(F.collect_list(F.struct("i", "value"))).alias(name))
    pairs = packed(a, "x").join(packed(b, "y"), F.lit(True))
    part = pairs.select((F.col("xb") * block + F.col("yb") * block).alias("base"), convolve(_dense(F.col("x"), block), _dense(F.col("y"), block)).alias("c"))
    return part.select("base", F.posexplode("c").alias("p", "v")).groupBy((F.col("base") + F.col("p")).alias("k")).agg(F.sum("v").alias("value"))


def _dense(entries: Column, block: int) -> Column:
    held = F.map_from_entries(F.transform(entries, lambda e: F.struct((e["i"] % block).cast("int").alias("k"), e["value"].alias("v"))))
    return F.transform(F.sequence(F.lit(0), F.array_max(F.map_keys(held))), lambda k: F.coalesce(F.try_element_at(held, k), F.lit(0)))
