"""Plans whose driver memory and row counts must not grow with the input."""

import math
import os
import random
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexmill.operators import codes, ngrams, phrases, suffix
from lexmill.plans import catalog


def texts(spark, *items):
    return spark.createDataFrame(list(enumerate(items)), "doc_id long, text string")


def plans(monkeypatch, module):
    """The physical plans of all scratch tables that a module writes."""
    told, write = [], module.scratch.written

    def written(df, tag):
        told.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, tag)

    monkeypatch.setattr(module.scratch, "written", written)
    return told


@pytest.mark.parametrize("few", [0, 10_000])
def test_frequent_substrings_broadcast_no_places(spark, monkeypatch, few):
    monkeypatch.setattr(ngrams, "FEW_CHARS", few)
    rng = random.Random(7)
    held = ["".join(rng.choice("abé") for _ in range(rng.randint(0, 12))) for _ in range(20)] * 3 + [None]
    told = plans(monkeypatch, ngrams)
    got = {r["word"]: (r["len"], r["cnt"]) for r in ngrams.frequent_substrings(texts(spark, *held), "doc_id", "text", 6).collect()}
    want = Counter(t[i : i + n] for t in held if t for n in range(1, len(t) + 1) for i in range(len(t) - n + 1))
    assert got == {w: (len(w), c) for w, c in want.items() if c >= 6}
    assert max(map(len, got)) > 4
    for plan in told:  # inner and neighbour joins are on (_d, pos)
        assert "BroadcastHashJoin [_d" not in plan
        assert few or "BroadcastHashJoin" not in plan


def test_frequent_substrings_walk_equal_texts_once(spark, monkeypatch):
    seen, own = [], ngrams.occurrences
    monkeypatch.setattr(ngrams, "occurrences", lambda rows, *a: seen.append(rows.count()) or own(rows, *a))
    got = ngrams.frequent_substrings(texts(spark, *["abc"] * 40, "abd"), "doc_id", "text", 40)
    assert {r["word"]: r["cnt"] for r in got.collect()} == {"a": 41, "b": 41, "c": 40, "ab": 41, "bc": 40, "abc": 40}
    assert seen == [2]


def test_suffix_array_needs_no_joins(spark, monkeypatch):
    rng = random.Random(5)
    held = ["banana", "", None, "é😀\0a" * 20, "".join(rng.choice("ab") for _ in range(500)), "a" * 700]
    told = plans(monkeypatch, suffix)
    array = suffix.suffix_array(texts(spark, *held), "doc_id", "text")
    plan = array._jdf.queryExecution().executedPlan().toString()
    assert not told and "Exchange" not in plan and "Join" not in plan
    for d, t in enumerate(held):
        got = sorted((r["rank"], r["pos"], r["height"]) for r in array.where(F.col("doc_id") == d).collect())
        order = sorted(range(len(t or "")), key=lambda i: t[i:].encode())
        heights = [0] + [len(os.path.commonprefix([t[p:], t[q:]])) for p, q in zip(order, order[1:], strict=False)]
        assert got == list(zip(range(len(order)), order, heights, strict=False))


def test_suffix_order_of_groups(monkeypatch):
    rng = random.Random(6)
    held = ["".join(rng.choice("abcdé") for _ in range(rng.randint(0, 40))) for _ in range(300)] + ["x" * 300]
    monkeypatch.setattr(codes, "GROUP", 100)
    column, seen = pa.array(held), []
    for low, end in codes.groups(column):
        assert end == low + 1 or sum(len(t.encode()) for t in held[low:end]) <= 100
        owner, rank, pos, _ = codes.suffix_order(*codes.flat(column.slice(low, end - low)))
        seen += zip((owner + low).tolist(), rank.tolist(), pos.tolist(), strict=True)
    assert seen == [(d, r, p) for d, t in enumerate(held) for r, p in enumerate(sorted(range(len(t)), key=lambda i: t[i:].encode()))]


def test_signals_cut_texts_into_few_rows(spark, monkeypatch):
    """Whole texts become rows of distinct windows, not a row for each place and length."""
    seen, own = [], phrases.window_counts
    monkeypatch.setattr(phrases, "window_counts", lambda *a: seen.append(own(*a)) or seen[-1])
    held = ["abcab", "x", "", None, "é😀\0a" * 30] + ["the cat sat on the mat"] * 200
    for neighbours in (1, 2):
        told = phrases.signals(texts(spark, *held), "text", 1, 3, neighbours)
        got = {r["word"]: (r["freq"], r["suffix_entropy"], r["prefix_entropy"]) for r in told.collect()}
        want, after, before = Counter(), defaultdict(Counter), defaultdict(Counter)
        for t in filter(None, held):
            for n in (1, 2, 3):
                for i in range(len(t) - n + 1):
                    w = t[i : i + n]
                    want[w] += 1
                    if i + n + neighbours <= len(t):
                        after[w][t[i + n : i + n + neighbours]] += 1
                    if i >= neighbours:
                        before[w][t[i - neighbours : i]] += 1
        entropy = lambda c: -sum(x / c.total() * math.log(x / c.total()) for x in c.values())
        assert {w: f for w, (f, _, _) in got.items()} == want
        for w, (_, s, p) in got.items():
            assert s == pytest.approx(entropy(after[w]), abs=1e-9) and p == pytest.approx(entropy(before[w]), abs=1e-9)
    assert seen[0].count() < 100 < sum(map(len, filter(None, held)))


@pytest.mark.parametrize("step", [13, 1 << 22])
def test_windows_of_arrays(monkeypatch, step):
    monkeypatch.setattr(codes, "STEP", step)
    rng = random.Random(4)
    held = ["x", "", "é😀\0a" * 7, "".join(chr(rng.randrange(0x4E00, 0x9F00)) for _ in range(400))] + ["".join(rng.choice("ab é") for _ in range(rng.randint(0, 30))) for _ in range(50)]
    for before, ahead, least in ((0, 2, 2), (1, 4, 1), (2, 5, 3), (7, 9, 2)):
        got = Counter()
        for window, at, cnt in codes.window_counts(pa.array([None, *held]).slice(1), before, ahead, least):
            for w, a, c in zip(window.to_pylist(), at.tolist(), cnt.tolist(), strict=True):
                got[w, a] += c
        assert got == Counter((t[max(0, i - before) : i + ahead], min(i, before)) for t in held for i in range(len(t) - least + 1))


def test_fixed_counts_make_no_row_of_each_place(spark, monkeypatch):
    seen, own = [], ngrams.window_counts
    monkeypatch.setattr(ngrams, "window_counts", lambda *a: seen.append(own(*a)) or seen[-1])
    held = ["", None, "a", "é😀\0a" * 9] + ["banana"] * 300
    for n in (1, 2, 5):
        got = {r["word"]: r["cnt"] for r in ngrams.fixed_counts(texts(spark, *held), "text", n).collect()}
        assert got == Counter(t[i : i + n] for t in held if t for i in range(len(t) - n + 1))
    assert [w.count() for w in seen] == [6, 7, 6]


@pytest.mark.parametrize("many", [200_000, 3])
def test_asked_words_make_no_row_of_each_place(spark, monkeypatch, many):
    """Few words are looked for in the texts as they lie; more than MANY_WORDS by a join, with the same counts."""
    monkeypatch.setattr(ngrams, "MANY_WORDS", many)
    held = ["", None, "é", "é😀\0a" * 9, "aaaa", "ab" * 30] + ["banana"] * 50
    asked = ["a", "é", "aa", "an", "ana", "😀\0", "ab" * 29, "ab" * 31, "nab", "ba", "bananab", "", None]
    words = spark.createDataFrame([(w,) for w in [*asked, "a"]], "word string")
    told = ngrams.occurrence_counts(words, texts(spark, *held), "text", missing=-1)
    got = {r["word"]: r["cnt"] for r in told.collect()}
    want = {w: sum(t.startswith(w, i) for t in held if t for i in range(len(t))) for w in asked if w}
    assert got == {w: c or -1 for w, c in want.items()}
    plan = told._jdf.queryExecution().executedPlan().toString()
    assert ("Generate" in plan) == (many == 3)


@pytest.mark.parametrize("step", [7, 1 << 22])
def test_words_across_steps(monkeypatch, step):
    monkeypatch.setattr(codes, "STEP", step)
    rng = random.Random(8)
    held = ["".join(rng.choice("abé") for _ in range(rng.randint(0, 40))) for _ in range(60)]
    asked = ["a", "é", "ab", "bé", "aab", "abéab", "x", "abababab"]
    want = [sum(t.startswith(w, i) for t in held for i in range(len(t))) for w in asked]
    assert codes.Words(asked).count(pa.array(["ab", *held]).slice(1)).tolist() == want


@pytest.mark.parametrize("name", ["phrase_select", "phrase_signals"])
def test_phrase_queries_explode_no_places(spark, monkeypatch, name):
    """Queries on signals explode the lengths of distinct windows, not the characters of the texts."""
    told, write = [], phrases.written
    monkeypatch.setattr(phrases, "written", lambda df, tag: told.append(df._jdf.queryExecution().executedPlan().toString()) or write(df, tag))
    catalog.queries()[name](spark, "/root/testdata/sf0.001")
    assert "MapInArrow" in told[0] and "explode(flatten" not in told[0]
