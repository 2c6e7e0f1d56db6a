"""Distributed connected components by randomised contraction.

Each round sends every vertex to the smallest member of its closed neighbourhood under a fresh permutation of the 64-bit
ids and contracts the edges. A constant share of the vertices goes in each round whatever the shape (chains, stars,
cliques), so the rounds grow with the logarithm of the vertices. Permutations are bijections (xor and shifts), so the
permuted value is itself the new vertex id: minima are taken over plain longs with map-side combining. Once at most
``SMALL`` edges are left, one task joins them up, which bounds its memory and saves the last rounds.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.llm.runtime import materialise, release


#: Edges that one task joins up, about 50 MB in a Python worker.
SMALL = 300_000


def _joined_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(v, r): each vertex of the edges (a, b) with the smallest one that it is connected to."""
    held = [b.to_numpy(dtype=np.int64) for b in batches]
    names, ends = np.unique(np.concatenate(held) if held else np.empty((0, 2), dtype=np.int64), return_inverse=True)
    up = list(range(len(names)))
    for a, b in ends.reshape(-1, 2).tolist():
        while up[a] != a:
            up[a] = a = up[up[a]]
        while up[b] != b:
            up[b] = b = up[up[b]]
        if a != b:
            up[max(a, b)] = min(a, b)
    for i, x in enumerate(up):  # parents come before their children
        up[i] = up[x]
    yield pd.DataFrame({"v": names, "r": names[up]})


def _permute(c: Column, rng: random.Random) -> Column:
    for left, right in ((13, 7), (17, 9)):
        c = c.bitwiseXOR(F.lit(rng.randrange(-(2**63), 2**63)))
        c = c.bitwiseXOR(F.shiftleft(c, left))
        c = c.bitwiseXOR(F.shiftrightunsigned(c, right))
    return c


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 200, small: int | None = None) -> DataFrame:
    """(vertex, component): one row per long vertex of ``edges``; equal component values mean connected.

    Null ends, loops and repeated edges are ignored; a vertex with loops alone gives no row. No edges give no rows.
    The component value is an opaque long: take a minimum over the members to name it.
    """
    spark = edges.sparkSession
    a, b = F.col(src).cast("long"), F.col(dst).cast("long")
    live, live_path = materialise(
        edges.where(a.isNotNull() & b.isNotNull() & (a != b)).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct(),
        "cc-edges",
    )
    both = live.select(F.col("a").alias("vertex")).union(live.select("b")).distinct()
    labels, labels_path = materialise(both.select("vertex", F.col("vertex").alias("component")), "cc-labels")
    small = SMALL if small is None else small
    for turn in range(max_rounds):
        left = live.limit(small + 1).count()
        if not left:
            break
        if left <= small:
            rep = live.repartition(1).mapInPandas(_joined_up, "v long, r long")
            told = labels.join(rep, labels["component"] == rep["v"], "left")
            renamed, renamed_path = materialise(told.select("vertex", F.coalesce("r", "component").alias("component")), "cc-labels")
            release(spark, labels_path)
            labels, labels_path = renamed, renamed_path
            break
        rng = random.Random(turn)
        state = rng.getstate()

        def h(c: Column) -> Column:
            rng.setstate(state)
            return _permute(c, rng)

        ends = live.select(F.col("a").alias("v"), h(F.col("b")).alias("h")).union(live.select(F.col("b"), h(F.col("a"))))
        nearest = ends.groupBy("v").agg(F.min("h").alias("h"))
        rep, rep_path = materialise(nearest.select("v", F.least(F.col("h"), h(F.col("v"))).alias("r")), "cc-rep")
        ra, rb = rep.select(F.col("v").alias("a"), F.col("r").alias("ra")), rep.select(F.col("v").alias("b"), F.col("r").alias("rb"))
        moved = live.join(ra, "a").join(rb, "b").where("ra <> rb")
        shrunk, shrunk_path = materialise(moved.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "cc-edges")
        told = labels.join(rep, labels["component"] == rep["v"], "left")
        renamed, renamed_path = materialise(told.select("vertex", F.coalesce("r", h(F.col("component"))).alias("component")), "cc-labels")
        release(spark, live_path, labels_path, rep_path)
        live, live_path, labels, labels_path = shrunk, shrunk_path, renamed, renamed_path
    else:
        raise RuntimeError(f"components unfinished after {max_rounds} rounds")
    release(spark, live_path)
    return labels
