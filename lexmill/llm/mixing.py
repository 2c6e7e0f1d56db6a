"""Mixing sources to target weights by hierarchical budgeting.

A token budget flows down a tree of domain, language and source. At each node it is shared among the children by weight,
up to their capacities (tokens times ``max_epochs``, summed over the subtree), so a child's shortage goes to its siblings
first and reaches the ancestors' siblings only where a whole subtree falls short. Each leaf then takes whole epochs and of
the next one a token prefix, in the order of a seeded hash of epoch and document.

Sharing is water-filling in closed form over the leaf table: with children in order of capacity over weight, the level is
the largest of (budget - capacities before) / (weights from here on). A leaf's prefix is found from token sums of hash
buckets, 256 of a leaf, then 256 of the bucket where the budget ends, ``DEPTH`` times; only the documents of the last
bucket, a 16-millionth of the leaf, are ordered by themselves, so no leaf is ever sorted in one task.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.llm.runtime import materialise, unused

LEVELS = ("domain", "lang", "source")
#: Rounds of buckets, of two hexadecimal digits each.
DEPTH = 3


@dataclass(frozen=True)
class Plan:
    """budget: tokens; None is the tokens of the input. Weights by name, others get ``other``."""

    budget: int | None = None
    max_epochs: int = 4
    seed: int = 17
    domains: dict[str, float] = field(default_factory=lambda: {"web": 0.5, "books": 0.2, "forum": 0.2, "code": 0.1})
    langs: dict[str, float] = field(default_factory=lambda: {"en": 0.5, "de": 0.2, "fr": 0.2, "es": 0.1})
    sources: dict[str, float] = field(default_factory=dict)
    other: float = 1.0

    def domain_of(self, source: Column) -> Column:
        """Domain of a source by its number; sources without one belong to the web."""
        n = F.try_to_number(F.regexp_extract(source, "([0-9]{1,4})$", 1), F.lit("9999"))
        return F.when(n % 4 == 1, "books").when(n % 4 == 2, "forum").when(n % 4 == 3, "code").otherwise("web")


def token_count(text: Column) -> Column:
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+"), "")).cast("long")


def _weight(c: Column, table: dict[str, float], other: float) -> Column:
    out = F.lit(float(other))
    for name, w in table.items():
        out = F.when(c == name, F.lit(float(w))).otherwise(out)
    return out


def _shared(nodes: DataFrame, parent: list[str], budget: Column) -> DataFrame:
    """nodes with cap and weight -> column ``got``: the parent's budget by weight within capacities."""
    by = Window.partitionBy(*parent)
    order = by.orderBy(F.col("cap") / F.col("weight"), *(c for c in LEVELS if c in nodes.columns))
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    onward = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    levels = nodes.where("weight > 0").withColumn("_level", (budget - before) / onward)
    return levels.withColumn("got", F.least(F.col("cap"), F.col("weight") * F.max("_level").over(by))).drop("_level")


def leaf_budgets(leaves: DataFrame, plan: Plan) -> DataFrame:
    """(domain, lang, source, tokens) -> with ``got``, ``whole`` epochs and ``rest`` tokens of the next epoch."""
    total = F.sum("tokens").over(Window.partitionBy(F.lit(1))).cast("double") if plan.budget is None else F.lit(float(plan.budget))
    named = leaves.withColumns({
        "w0": _weight(F.col("domain"), plan.domains, plan.other), "w1": _weight(F.col("lang"), plan.langs, plan.other), "w2": _weight(F.col("source"), plan.sources, plan.other),
        "budget": total,
    })
    cap = F.when(F.col("w0") * F.col("w1") * F.col("w2") > 0, F.col("tokens").cast("double") * plan.max_epochs).otherwise(0.0)
    named = named.withColumn("cap", cap).where("cap > 0")
    d = named.groupBy("domain").agg(F.sum("cap").alias("cap"), F.max("w0").alias("weight"), F.max("budget").alias("up"))
    d = _shared(d.withColumn("_all", F.lit(1)), ["_all"], F.col("up")).select("domain", F.col("got").alias("up"))
    g = named.groupBy("domain", "lang").agg(F.sum("cap").alias("cap"), F.max("w1").alias("weight")).join(d, "domain")
    g = _shared(g, ["domain"], F.col("up")).select("domain", "lang", F.col("got").alias("up"))
    s = named.select("domain", "lang", "source", "tokens", "cap", F.col("w2").alias("weight")).join(g, ["domain", "lang"])
    got = _shared(s, ["domain", "lang"], F.col("up")).withColumn("got", F.floor(F.round("got", 4)).cast("long"))
    whole = F.floor(F.col("got") / F.col("tokens")).cast("int")
    return got.select(*LEVELS, "tokens", "got", whole.alias("whole"), (F.col("got") - whole * F.col("tokens")).alias("rest"))


def _order(seed: int, epoch: Column, key: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(key.cast("string"), F.lit("null"))).cast("binary"))


def _tree(source_col: str, lang_col: str, plan: Plan) -> tuple[Column, Column, Column]:
    """Domain, language and source of a row."""
    source = F.coalesce(F.col(source_col), F.lit("?"))
    return plan.domain_of(source), F.coalesce(F.col(lang_col), F.lit("?")), source


def leaf_cuts(sizes: DataFrame, plan: Plan) -> DataFrame:
    """sizes (domain, lang, source, key, n) -> each leaf's ``whole`` epochs and ``cut``, the last order hash of its prefix.

    The prefix is the longest whose tokens stay within the rest; equal hashes (repeated ids) go in or out together.
    """
    by, leaf = list(LEVELS), Window.partitionBy(*LEVELS)
    leaves = sizes.groupBy(*LEVELS).agg(F.sum("n").alias("tokens"))
    budgets, _ = materialise(leaf_budgets(leaves, plan), "mix-leaves")
    told = budgets
    # done: tokens before the bucket ``b`` in which the budget ends
    edge = budgets.where("rest > 0").select(*LEVELS, "whole", "rest", F.lit("").alias("b"), F.lit(0).cast("long").alias("done"))
    cuts = []
    for level in range(1, DEPTH + 1):
        inside = sizes.join(edge, by).withColumn("h", _order(plan.seed, F.col("whole"), F.col("key"))).where(F.col("h").startswith(F.col("b")))
        sums = inside.groupBy(*LEVELS, F.left("h", F.lit(2 * level)).alias("next")).agg(F.sum("n").alias("n"), F.max("h").alias("last"), F.first("whole").alias("whole"), F.first("rest").alias("rest"), F.first("done").alias("done"))
        upto = sums.withColumn("sum", F.col("done") + F.sum("n").over(leaf.orderBy("next")))
        found = upto.groupBy(*LEVELS).agg(
            F.max(F.when(F.col("sum") <= F.col("rest"), F.col("last"))).alias(f"cut{level}"), F.min(F.when(F.col("sum") > F.col("rest"), F.struct(F.col("next").alias("b"), (F.col("sum") - F.col("n")).alias("done"), "whole", "rest"))).alias("e"),
        )
        found, _ = materialise(found, "mix-edges")
        cuts.append(f"cut{level}")
        told = told.join(found.drop("e"), by, "left")
        edge = found.where("e is not null").select(*LEVELS, "e.whole", "e.rest", "e.b", "e.done")
    inside = sizes.join(edge, by).withColumn("h", _order(plan.seed, F.col("whole"), F.col("key"))).where(F.col("h").startswith(F.col("b")))
    run = inside.withColumn("sum", F.col("done") + F.sum("n").over(leaf.orderBy("h")))
    more = run.where("sum <= rest").groupBy(*LEVELS).agg(F.max("h").alias("more"))
    return told.join(more, by, "left").select(*LEVELS, "whole", F.greatest(*cuts, "more").alias("cut"))


def mix(docs: DataFrame, plan: Plan | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", with_docs: bool = False) -> DataFrame:
    """Selected documents, a row for each epoch that holds them: (id, domain, lang, source, epoch, n_tokens).

    ``with_docs``: all columns of ``docs`` as they are and ``_epoch`` (with more underscores where ``docs`` has one). Null
    languages and sources are the name "?"; texts without words and leaves of weight 0 are never selected; a null id is
    ordered as the word null; an empty table gives no rows.
    """
    plan = plan or Plan()
    tree = _tree(source_col, lang_col, plan)
    sized = docs.select(*(c.alias(name) for c, name in zip(tree, LEVELS, strict=True)), F.col(id_col).alias("key"), token_count(F.col(text_col)).alias("n")).where("n > 0")
    sizes, _ = materialise(sized, "mix-sizes")
    cuts, _ = materialise(leaf_cuts(sizes, plan), "mix-cuts")

    def epochs(key: Column, whole: Column, cut: Column) -> Column:
        none = F.array().cast("array<int>")
        partial = F.when(_order(plan.seed, whole, key) <= cut, F.array(whole)).otherwise(none)
        return F.concat(F.when(whole > 0, F.sequence(F.lit(0), whole - 1)).otherwise(none), partial)

    if not with_docs:
        told = sizes.join(cuts, list(LEVELS)).withColumn("epoch", F.explode(epochs(F.col("key"), F.col("whole"), F.col("cut"))))
        return told.select(F.col("key").alias(id_col), *LEVELS, "epoch", F.col("n").alias("n_tokens"))
    names = {c: unused(docs, f"_{c}") for c in (*LEVELS, "whole", "cut", "epoch")}
    own = cuts.select(*(F.col(c).alias(names[c]) for c in (*LEVELS, "whole", "cut")))
    worded = docs.where(F.col(text_col).rlike("[^\\x20\\x09-\\x0D]")).withColumns({names[c]: x for c, x in zip(LEVELS, tree, strict=True)})
    told = worded.join(own, [names[c] for c in LEVELS])
    return told.withColumn(names["epoch"], F.explode(epochs(F.col(id_col), F.col(names["whole"]), F.col(names["cut"])))).select(*docs.columns, names["epoch"])


def oracle(plan: Plan | None = None) -> str:
    """DuckDB SQL for :func:`mix` over ``documents``."""
    p = plan or Plan()
    case = lambda c, table: "CASE " + " ".join(f"WHEN {c}='{k}' THEN {float(v)}" for k, v in table.items()) + f" ELSE {float(p.other)} END" if table else str(float(p.other))
    budget = "(SELECT sum(tokens) FROM leaves)::DOUBLE" if p.budget is None else f"{float(p.budget)}"

    def share(name: str, nodes: str, parent: str, ties: str) -> str:
        over = f"PARTITION BY {parent}" if parent else ""
        return f"""{name}_l AS (SELECT *, (up - coalesce(sum(cap) OVER ({over} ORDER BY cap/weight, {ties} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(weight) OVER ({over} ORDER BY cap/weight, {ties} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM ({nodes}) WHERE weight > 0),
{name} AS (SELECT *, least(cap, weight * max(level) OVER ({over})) AS got FROM {name}_l)"""

    return rf"""
WITH sizes AS (
  SELECT doc_id, coalesce(lang,'?') AS lang, coalesce(source,'?') AS source,
    CASE try_cast(regexp_extract(coalesce(source,'?'), '([0-9]{{1,4}})$', 1) AS INT) % 4 WHEN 1 THEN 'books' WHEN 2 THEN 'forum' WHEN 3 THEN 'code' ELSE 'web' END AS domain,
    len(regexp_extract_all(coalesce(text,''), '[^\x20\x09-\x0D]+')) AS n FROM documents),
leaves AS (SELECT domain, lang, source, sum(n)::BIGINT AS tokens FROM sizes WHERE n > 0 GROUP BY ALL),
named AS (SELECT *, {case("domain", p.domains)} AS w0, {case("lang", p.langs)} AS w1, {case("source", p.sources)} AS w2, tokens::DOUBLE * {p.max_epochs} AS cap FROM leaves),
{share("d", f"SELECT domain, sum(cap) AS cap, max(w0) AS weight, {budget} AS up FROM named GROUP BY domain", "", "domain")},
{share("g", "SELECT n.domain, lang, sum(n.cap) AS cap, max(w1) AS weight, max(d.got) AS up FROM named n JOIN d USING (domain) GROUP BY n.domain, lang", "domain", "domain, lang")},
{share("s", "SELECT n.domain, n.lang, source, tokens, n.cap, w2 AS weight, g.got AS up FROM named n JOIN g USING (domain, lang)", "domain, lang", "domain, lang, source")},
leaf AS (SELECT domain, lang, source, tokens, floor(round(got, 4))::BIGINT AS got, floor(floor(round(got, 4)) / tokens)::INT AS whole FROM s),
placed AS (SELECT z.*, whole, got - whole * tokens AS rest, md5('{p.seed}:' || whole || ':' || coalesce(doc_id::VARCHAR, 'null')) AS h FROM sizes z JOIN leaf USING (domain, lang, source) WHERE n > 0),
summed AS (SELECT *, sum(n) OVER (PARTITION BY domain, lang, source ORDER BY h) AS upto FROM placed)
SELECT doc_id, domain, lang, source, whole AS epoch, n::BIGINT AS n_tokens FROM summed WHERE upto <= rest
UNION ALL
SELECT doc_id, domain, lang, source, e::INT AS epoch, n::BIGINT AS n_tokens FROM (SELECT *, unnest(range(whole)) AS e FROM summed)
"""
