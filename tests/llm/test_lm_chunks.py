import random
from collections import Counter

import numpy as np
import pandas as pd

from lexmill.llm import lm

from .conftest import prose


def test_triples_of_lone_pairs_are_not_sent(tmp_path):
    """Every chunk knows the counts of its triples over all chunks, though few of them travel."""
    rng = random.Random(8)
    docs = [(i, rng.randrange(3), prose(rng, rng.randint(0, 60)) + f" new{rng.randrange(40)}") for i in range(120)]
    chunks, plain, ranges, sent, every = [], [Counter(), Counter()], 3, 0, 0
    for c in range(4):
        chunk = lm._Gathering()
        for d in docs[c::4]:
            chunk.add(*d)
        tokens = chunk.done()
        tokens.write(f"{tmp_path}/{c}")
        chunks.append(f"{tmp_path}/{c}")
        for key, part in zip(tokens.keys[1][tokens.place[1]].tolist(), tokens.part, strict=True):
            plain[0][key] += part >= 1
            plain[1][key] += part >= 2

    def told(blocks, words, suffix):
        rows = pd.DataFrame([(c, r, d) for c, of in zip(chunks, blocks, strict=True) for r, d in of], columns=["chunk", "range", "data"])
        answers = pd.concat([lm._answers(words)(x) for _, x in rows.groupby("range")])
        for _, x in answers.groupby("chunk"):
            lm._packed(suffix)(x)

    told([lm._Tokens.read(c).blocks(ranges, (0, 1)) for c in chunks], True, "-answers")
    asked = [lm._Scored(c, False) for c in chunks]
    told([s.t.blocks(ranges, (2,), s.wanted()) for s in asked], False, "-triples")
    for s, c in zip(asked, chunks, strict=True):
        got = lm._Scored(c)
        sent, every = sent + s.wanted().sum(), every + len(s.t.keys[1])
        for held, want in zip(got.counts[2], plain, strict=True):
            assert held.tolist() == [want[k] for k in got.t.keys[1].tolist()]
    assert 0 < sent < 0.7 * every and np.all(got.counts[2][0] >= got.counts[2][1])
