"""DuckDB SQL of the steps that walk a text: dynamic programming, max-match, training rounds. Oracles only."""

from __future__ import annotations

FLOOR = "-1e6"


def best_split(name: str, chunks: str, scores: str) -> str:
    """CTE ``name`` (chunk, words): the best cut of each chunk of ``chunks`` by ``scores`` (word, s), words of 1..4.

    A step knows the best sums and cuts at the four places before; of equal sums the longest last word wins.
    """
    word = lambda k: f"substring(chunk, (i + 2 - {k})::INT, {k})"
    joins = " ".join(f"LEFT JOIN {scores} c{k} ON c{k}.word = {word(k)} AND i + 1 >= {k}" for k in range(1, 5))
    value = {k: f"b{k} + " + (f"coalesce(c1.s, {FLOOR})" if k == 1 else f"c{k}.s") for k in range(1, 5)}
    best = f"greatest({', '.join(value[k] for k in range(1, 5))})"
    cut = " ".join(f"WHEN {value[k]} = {best} THEN CASE WHEN w{k} = '' THEN {word(k)} ELSE w{k} || ' ' || {word(k)} END" for k in (4, 3, 2, 1))
    return f"""{name}_steps AS (
  SELECT chunk, 0 AS i, 0.0::DOUBLE AS b1, NULL::DOUBLE AS b2, NULL::DOUBLE AS b3, NULL::DOUBLE AS b4, '' AS w1, NULL::VARCHAR AS w2, NULL::VARCHAR AS w3, NULL::VARCHAR AS w4 FROM {chunks}
  UNION ALL SELECT chunk, i + 1, {best}, b1, b2, b3, CASE {cut} END, w1, w2, w3 FROM {name}_steps {joins} WHERE i < length(chunk)),
{name} AS (SELECT chunk, w1 AS words FROM {name}_steps WHERE i = length(chunk))"""


def grams(chunks: str) -> str:
    """SQL: the distinct substrings of 1..4 characters of a table's chunks."""
    one = "list_transform(range(1, 5), lambda l: list_transform(range(1, length(chunk) - l + 2), lambda p: substring(chunk, p, l)))"
    return f"SELECT DISTINCT unnest(flatten({one})) AS word FROM {chunks}"


def scored(name: str, words: str, model: str, value: str) -> str:
    """CTE ``name`` (word, s): a score over cnt, len, mean and sd, nine digits, null where it is not finite."""
    return f"""{name}_st AS (SELECT len, avg(cnt) AS mean, stddev_pop(cnt) AS sd FROM {model} WHERE cnt <> 0 GROUP BY len),
{name}_t AS (SELECT w.word, length(w.word) AS len, coalesce(m.cnt, 0) AS cnt, mean, sd FROM {words} w LEFT JOIN {model} m USING (word) LEFT JOIN {name}_st t ON t.len = length(w.word)),
{name} AS (SELECT word, round({value}, 9) AS s FROM {name}_t WHERE isfinite({value}))"""


SIGMOID = "len / (1 + exp(-(CASE WHEN sd > 0 THEN (cnt - mean) / sd ELSE 0 END)))"
CXLDM = "CASE WHEN cnt > 0 THEN ln(cnt / mean) * len END"


def segmented(chunks: str, model: str, value: str) -> str:
    """SQL head: CTEs up to ``seg`` (chunk, words) of ``ck`` (chunk, times)."""
    return f"WITH RECURSIVE ck AS MATERIALIZED ({chunks}), m AS MATERIALIZED ({model}), gr AS MATERIALIZED ({grams('ck')}), {scored('sc', 'gr', 'm', value).replace('sc AS (', 'sc AS MATERIALIZED (')}, {best_split('seg', 'ck', 'sc')}"


def trained(chunks: str, model: str, rounds: int, ratio: float) -> str:
    """SQL: the model after rounds of decay and counting the found words in."""
    parts = [f"ck AS MATERIALIZED ({chunks})", f"m0 AS MATERIALIZED ({model})", f"gr AS MATERIALIZED ({grams('ck')})"]
    for k in range(1, rounds + 1):
        parts += [scored(f"s{k}", "gr", f"m{k - 1}", SIGMOID), best_split(f"d{k}", "ck", f"s{k}")]
        found = f"SELECT unnest(string_split(words, ' ')) AS word, times AS cnt FROM d{k} JOIN ck USING (chunk)"
        parts.append(f"m{k} AS MATERIALIZED (SELECT word, length(word)::INT AS len, sum(cnt)::BIGINT AS cnt FROM (SELECT word, floor(cnt * {ratio})::BIGINT AS cnt FROM m{k - 1} UNION ALL {found}) GROUP BY word)")
    return f"WITH RECURSIVE {', '.join(parts)} SELECT word, len, cnt FROM m{rounds}"
