"""Word scores from counts as Column expressions.

Inputs by name: word, len, cnt, and where a score needs them mean, stddev, sqrt_sum, log_sum (of the word's length) and
entropy. ``n`` is the base length. Logarithms of 0 are -infinity; a spread of 0 makes the deviation 0.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EPS = "4.9e-324D"
HANK_WEIGHTS = (1.0, 1.0, 0.05, 0.0001)
NEEDS_STATS = frozenset("CdM CxLdM CmMdSTDE sqCdS sqCxLdS lnCdS lnCxLdS Sigmoid".split())
NEEDS_ENTROPY = frozenset("Entropy Entropy_L".split())


def _ln(x: Column) -> Column:
    return F.coalesce(F.ln(x), F.lit(float("-inf")))


def _deviation() -> Column:
    return F.coalesce(F.try_divide(F.col("cnt") - F.col("mean"), F.col("stddev")), F.lit(0.0))


def _sq(n: Column) -> Column:
    return _ln(F.try_divide(F.sqrt("cnt"), F.try_divide(F.col("sqrt_sum"), F.try_divide(n, F.col("mean")))))


def _lg(n: Column) -> Column:
    share = F.try_divide(_ln(F.col("cnt")), F.try_divide(F.col("log_sum"), F.try_divide(n, F.col("mean"))))
    return F.ln(F.greatest(F.expr(EPS), F.coalesce(share, F.lit(0.0))))


SCORES: dict[str, Callable[[Column], Column]] = {
    "CdL": lambda n: _ln(F.try_divide(F.col("cnt"), n - F.col("len") + 1)),
    "CdM": lambda n: _ln(F.try_divide(F.col("cnt"), F.col("mean"))),
    "CxLdM": lambda n: _ln(F.try_divide(F.col("cnt"), F.col("mean"))) * F.col("len"),
    "CmMdSTDE": lambda n: _deviation(),
    "sqCdS": _sq,
    "sqCxLdS": lambda n: _sq(n) * F.col("len"),
    "lnCdS": _lg,
    "lnCxLdS": lambda n: _lg(n) * F.col("len"),
    "Sigmoid": lambda n: F.col("len") / (1 + F.exp(-_deviation())),
    "Entropy": lambda n: F.coalesce(F.col("entropy"), F.lit(0.0)),
    "Entropy_L": lambda n: F.coalesce(F.col("entropy"), F.lit(0.0)) * F.col("len"),
    "Hank": lambda n: F.ln(F.greatest(F.coalesce(F.col("hank"), F.lit(0.0)), F.lit(1e-300))),
}


def hank(words: DataFrame, model: DataFrame, n: float, weights: tuple[float, float, float, float] = HANK_WEIGHTS) -> DataFrame:
    """``words`` (word, len, cnt) with ``hank``: chains of orders 0 to 3 mixed by ``weights``; 0 above 4 characters.

    The counts of every part of a word (at most nine) come from one join of exploded parts.
    """
    spans = [(a, k) for k in (1, 2, 3) for a in range(1, 6 - k)]
    part = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(k).alias("k")) for a, k in spans))
    cut = words.where("len <= 4").select("word", "len", "cnt", F.explode(part).alias("s")).where("s.a + s.k - 1 <= len")
    parts = cut.select("word", F.expr("s.a * 10 + s.k").alias("s"), F.expr("substring(word, s.a, s.k)").alias("w"))
    found = parts.join(model.select(F.col("word").alias("w"), F.col("cnt").alias("c")), "w")
    counts = found.groupBy("word").agg(F.map_from_entries(F.collect_list(F.struct("s", "c"))).alias("_m"))  # nine entries at most
    c = lambda a, k: F.coalesce(F.try_element_at("_m", F.lit(a * 10 + k)), F.lit(0)).cast("double")
    total = F.lit(float(n))

    def ratio(a: tuple[int, int], b: tuple[int, int]) -> Column:
        return F.coalesce(F.try_divide(c(*a), c(*b)), F.lit(0.0))

    def free(length: int) -> Column:
        out = F.lit(1.0)
        for a in range(1, length + 1):
            out = out * (c(a, 1) / total)
        return out

    def chain(length: int, order: int) -> Column:
        """p(first character) times conditional counts, each on up to ``order`` characters before."""
        out = c(1, 1) / total
        for end in range(2, length + 1):
            start = max(1, end - order)
            out = out * ratio((start, end - start + 1), (start, end - start))
        return out

    whole = F.col("cnt") / total
    w0, w1, w2, w3 = weights
    value = (
        F.when(F.col("len") == 1, w0 * whole)
        .when(F.col("len") == 2, w0 * free(2) + w1 * whole)
        .when(F.col("len") == 3, w0 * free(3) + w1 * chain(3, 1) + w2 * whole)
        .when(F.col("len") == 4, w0 * free(4) + w1 * chain(4, 1) + w2 * chain(4, 2) + w3 * whole)
        .otherwise(0.0)
    )
    told = words.join(counts, "word", "left")
    return told.withColumn("_m", F.coalesce("_m", F.create_map().cast("map<int,bigint>"))).withColumn("hank", value).drop("_m")


def score_table(words: DataFrame, model: DataFrame, stats: DataFrame | None, entropy: DataFrame | None, n: float, names: list[str] | None = None, custom: dict[str, str] | None = None) -> DataFrame:
    """Candidates (word) with len, cnt and a column for each score; missing words count 0.

    ``custom``: name -> SQL expression over word, L, C, E, M, S, N (length, count, entropy, mean, deviation, base length).
    Length statistics and entropies are joined only where a score asks for them.
    """
    wanted = list(SCORES) if names is None else names
    custom = custom or {}
    table = words.select("word").distinct().join(model.select("word", "cnt"), "word", "left")
    table = table.select("word", F.length("word").alias("len"), F.coalesce("cnt", F.lit(0)).cast("long").alias("cnt"))
    if custom or NEEDS_STATS & set(wanted):
        if stats is None:
            raise ValueError("length statistics are needed")
        columns = [c for c in ("mean", "stddev", "sqrt_sum", "log_sum") if c in stats.columns]
        table = table.join(F.broadcast(stats.select("len", *columns)), "len", "left")  # one row a word length
    if custom or NEEDS_ENTROPY & set(wanted):
        if entropy is None:
            raise ValueError("entropies are needed")
        table = table.join(entropy.select("word", "entropy"), "word", "left")
    if "Hank" in wanted:
        table = hank(table, model, n)
    base = F.lit(float(n))
    scored = table.select("word", "len", "cnt", *(SCORES[s](base).alias(s) for s in wanted), *([c for c in ("entropy", "mean", "stddev") if custom]))
    if custom:
        named = scored.withColumns({"L": F.col("len"), "C": F.col("cnt"), "E": F.coalesce("entropy", F.lit(0.0)), "M": F.col("mean"), "S": F.col("stddev"), "N": base})
        scored = named.select("word", "len", "cnt", *wanted, *(F.expr(e).cast("double").alias(k) for k, e in custom.items()))
    return scored


def count_calls(expression: str) -> list[tuple[int, int]]:
    """(start, end) of the calls C(..) of an expression, outer ones only."""
    out, at = [], 0
    while found := re.compile(r"(?<![\w.`])C\(").search(expression, at):
        depth, end = 1, found.end()
        while depth and end < len(expression):
            depth += {"(": 1, ")": -1}.get(expression[end], 0)
            end += 1
        if depth:
            raise ValueError(f"unclosed call in {expression!r}")
        out.append((found.start(), end))
        at = end
    return out


def count_scores(words: DataFrame, model: DataFrame, n: float, expression: str) -> DataFrame:
    """(word, score) by a SQL expression over S (the word), N (the base length) and the function C(text).

    C is the count of any text in the model, 0 where it has none, such as C(S) / C(left(S, 1)). Each different call is
    one join with the model; calls do not nest.
    """
    calls = {expression[a + 2 : b - 1] for a, b in count_calls(expression)}
    if any(count_calls(c) for c in calls):
        raise ValueError("calls of C do not nest")
    table = words.select("word").distinct().withColumns({"S": F.col("word"), "N": F.lit(float(n))})
    names = {call: f"_c{i}" for i, call in enumerate(sorted(calls))}
    for call, name in names.items():
        own = model.select(F.col("word").alias(f"{name}w"), F.col("cnt").alias(name))
        table = table.join(own, F.expr(call) == F.col(f"{name}w"), "left").withColumn(name, F.coalesce(name, F.lit(0))).drop(f"{name}w")
    parts, at = [], 0
    for a, b in count_calls(expression):
        parts += [expression[at:a], names[expression[a + 2 : b - 1]]]
        at = b
    return table.select("word", F.expr("".join([*parts, expression[at:]])).cast("double").alias("score"))
