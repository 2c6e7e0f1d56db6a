import random

import numpy as np
import pytest

from lexmill.llm import shingles

from .conftest import prose
from .test_llm import components
from .test_whole import similar


def edited(rng, base, n, edits, pool):
    """Copies of ``base`` with so many elements replaced at random."""
    out = []
    for _ in range(n):
        own = list(base)
        for at in rng.sample(range(len(own)), rng.randint(*edits)):
            own[at] = rng.randrange(pool)
        out.append(set(own))
    return out


@pytest.mark.parametrize("seed", range(12))
def test_crowds_against_all_pairs(seed, monkeypatch):
    rng = random.Random(seed)
    base = [10**9 + i for i in range(60)]
    monkeypatch.setattr(shingles, "TELLING", (10, 400)[seed % 2])
    monkeypatch.setattr(shingles, "RARE", (2, 5, 16)[seed % 3])
    sets = edited(rng, base, 120, (2, 14), (40, 1 << 40)[seed // 2 % 2])  # few or no differences in common
    sets += [set(base[:30]) | {rng.randrange(1 << 40) for _ in range(30)} for _ in range(40)]  # a passage in common
    if seed % 4 == 0:
        sets.append(set(base))
    if seed > 5:
        sets += [set(rng.sample(range(50), 40)) for _ in range(60)] + [{1}, {2}, {1, 2, 3}, {1, 2, 3, 4}]
    rng.shuffle(sets)
    sets = [sorted(s) for s in {frozenset(s) for s in sets}]
    crowd = shingles._Crowd(1, 0.8)
    for lo in range(0, len(sets), 50):
        part = sets[lo : lo + 50]
        crowd.add(np.arange(lo, lo + len(part)), np.array([len(s) for s in part]), np.array([x for s in part for x in s]))
    links = [(int(a), int(b)) for a, b in zip(*crowd.links(), strict=True)]
    near = [(a, b) for a in range(len(sets)) for b in range(a) if len(both := set(sets[a]) & set(sets[b])) >= 0.8 * (len(sets[a]) + len(sets[b]) - len(both))]
    assert {(max(p), min(p)) for p in links} <= set(near) and len(links) < len(sets)
    assert components(len(sets), links) == components(len(sets), near)


def test_candidates_of_a_large_group_are_few(spark, monkeypatch):
    """Copies with so many changes that they are not linked are not compared with the rest of the group one by one."""
    rng = random.Random(6)
    base = prose(rng, 150).split()
    texts = []
    for _ in range(300):
        words = base[:]
        for at in rng.sample(range(len(words)), rng.randint(1, 7)):
            words[at] = f"new{rng.randrange(10**6)}"
        texts.append(" ".join(words))
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    sets = shingles.sketches(docs, "id", "text").cache()
    place = {r["fp"]: r["id"] for r in sets.collect()}
    counts, checked = [], shingles._checked

    def counted(pairs, *rest):
        counts.append(pairs.count())
        return checked(pairs, *rest)

    monkeypatch.setattr(shingles, "_checked", counted)
    got = [(place[r["src"]], place[r["dst"]]) for r in shingles.similar_links(sets, docs.select("text")).collect()]
    assert {(max(p), min(p)) for p in got} <= set(similar(texts))
    assert components(300, got) == components(300, similar(texts))
    assert sum(counts) < 20 * 300  # those of bands of at most CROWD members; 26,504 with all bands compared so
