"""Whole jobs: cases beyond the bounds that operators once had."""

import itertools
import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lexmill.llm import chat, queries, shingles, simhash, toxicity, urls

from .conftest import prose
from .test_llm import components, plain_simhash, toxic_corpus


def plain_shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or {tuple(words)}


def similar(texts):
    sets = [plain_shingles(t) for t in texts]
    return [(a, b) for a in range(len(sets)) for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]


def test_pipeline_links_by_five_words(spark):
    rng = random.Random(3)
    texts = []
    for _ in range(12):
        words = prose(rng, 150).split()
        for _ in range(5):
            texts.append(" ".join(words))
            words = words[:]
            for at in rng.sample(range(len(words)), rng.randint(1, 4)):
                words[at] = f"new{rng.randrange(10**6)}"
    texts += [texts[3], "", None, "one two", "One  two", "one two three"]
    links, fps = similar(texts), [plain_simhash(t) for t in texts]
    assert sum((fps[a] ^ fps[b]).bit_count() > simhash.MAX_DIFF for a, b in links) > 10
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted(r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect())
    assert got == sorted(set(components(len(texts), links)))


def test_similar_links_of_large_buckets(spark, monkeypatch):
    rng = random.Random(4)
    base = prose(rng, 120).split()
    texts = []
    for _ in range(60):
        words = base[:]
        for at in rng.sample(range(len(words)), rng.randint(1, 6)):
            words[at] = f"new{rng.randrange(10**6)}"
        texts.append(" ".join(words))
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    sets = shingles.sketches(docs, "id", "text").cache()
    place = {r["fp"]: r["id"] for r in sets.collect()}
    for broadcast in (shingles.BROADCAST_KEYS, 0):
        monkeypatch.setattr(shingles, "BROADCAST_KEYS", broadcast)
        got = [(place[r["src"]], place[r["dst"]]) for r in shingles.similar_links(sets, docs.select("text"), centres=1).collect()]
        assert {(max(p), min(p)) for p in got} <= set(similar(texts))
        assert components(60, got) == components(60, similar(texts))
    close = [(place[r["src"]], place[r["dst"]]) for r in shingles.simhash_links(sets, docs.select("text")).collect()]
    assert {(max(p), min(p)) for p in close} <= set(similar(texts)) and close


def test_band_recall_and_estimates():
    rng, missed, told = np.random.default_rng(1), 0, []
    for _ in range(3000):
        pool = rng.integers(0, 1 << 64, 100, dtype=np.uint64)
        a, b = shingles.minima(pool[:90]), shingles.minima(pool[10:])
        missed += not np.intersect1d(shingles.band_keys(a), shingles.band_keys(b)).size
        told.append((a == b).mean())
    assert missed <= 1  # similarity 0.8
    wide = shingles.SURE * (0.8 * 0.2 / (shingles.BANDS * shingles.ROWS)) ** 0.5
    assert abs(np.mean(told) - 0.8) < 0.005 and max(abs(x - 0.8) for x in told) < wide


def test_deep_chains(spark):
    depth, rows = 1300, []
    call = lambda i, *refs: json.dumps({"tool_calls": [{"id": i, "name": "calculate", "arguments": {"expression": "1"}, "depends_on": list(refs)}]})
    for i in range(depth):
        rows.append((1, depth - i, "assistant", call(f"c{i}", *([f"c{i - 1}"] if i else []))))
    rows.append((1, 5000, "tool", json.dumps({"tool_call_id": "c700"})))
    rows += [(1, 1, "assistant", call("two", "c10", "c900")), (1, 2, "assistant", call("tail", "two")), (1, 3, "assistant", call("both", "tail", "c1299"))]
    rows += [(1, 4, "assistant", call("x", "y")), (1, 4, "assistant", call("y", "x")), (1, 4, "assistant", call("z", "y")), (1, 4, "assistant", call("w", "z", "c0"))]
    rows += [(2, None, "assistant", call("a")), (2, 4, "assistant", call("b", "a"))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {(r["conv_id"], r["call_id"]): r for r in chat.link(df, queries.TOOLS).collect() if r["kind"] == "call"}
    for i in range(depth):
        r = got[1, f"c{i}"]
        assert (r["depth"], r["ready"], r["status"]) == (2 * i, depth if i <= 700 else 5000, "linked" if i == 700 else "unanswered"), i
    assert [(got[1, k]["depth"], got[1, k]["ready"]) for k in ("two", "tail", "both")] == [(1802, 5000), (1804, 5000), (2600, 5000)]
    assert {got[1, k]["status"] for k in "xyzw"} == {"cycle"}
    assert (got[2, "b"]["status"], got[2, "b"]["depth"], got[2, "b"]["ready"]) == ("unanswered", 2, 4)


def test_targets_as_pages_write_them(spark):
    link = lambda u: f'<link rel="canonical" href="{u}">'
    pages = [
        ("http://a.com/x/y?q", link("/de/x"), "http://a.com/de/x"), ("http://a.com/x/y", link("page2"), "http://a.com/x/page2"), ("https://a.com", link("p"), "https://a.com/p"),
        ("https://a.com/x", link("//b.net/z"), "https://b.net/z"), ("http://a.com/x/y/z", link("../../up/./p?a=1&amp;b=2"), "http://a.com/up/p?a=1&b=2"),
        ("http://a.com/x/y/", link(".."), "http://a.com/x/"), ("http://a.com/x?q#f", link("?r=1"), "http://a.com/x?r=1"), ("http://a.com/x?q#f", link("#top"), "http://a.com/x?q"),
        ("http://a.com/x", link("mailto:me@a.com"), None), ("http://a.com/x", link("/go?to=http://b.net/"), "http://a.com/go?to=http://b.net/"),
        ("http://a.com/x", '<base href="http://c.org/d/">' + link("e"), "http://c.org/d/e"), ("http://a.com/x", '<meta content="0;url=http://b.net/m" http-equiv="refresh">', "http://b.net/m"),
        ("http://a.com/x", "<meta content='http://b.net/o' property='og:url'>", "http://b.net/o"), ("http://a.com/x", '<meta name="refreshing" content="http://b.net/o">', None),
    ]
    df = spark.createDataFrame([(i, u, h) for i, (u, h, _) in enumerate(pages)], "page_id long, url string, html string")
    got = df.select("page_id", urls.targets(F.col("html"), F.col("url")).alias("t")).orderBy("page_id").collect()
    assert [r["t"] for r in got] == [[t] if t else [] for _, _, t in pages]


def test_blocks_pass_on_to_relative_aliases(spark):
    pages = [("http://x.com/1", '<link rel="canonical" href="//a.net/p">'), ("http://y.com/2", '<meta content="0; url=/three?a=1&amp;b=2" http-equiv="refresh">'), ("http://y.com/three?a=1&b=2", '<meta content="http://a.net/p" property="og:url">'), ("http://z.com/", "")]
    df = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(pages)], "page_id long, url string, html string")
    assert {r["page_id"]: r["verdict"] for r in urls.filter_urls(df).collect()} == {0: "block", 1: "block", 2: "block", 3: "allow"}


def test_fit_takes_all_windows(monkeypatch):
    told = {}
    monkeypatch.setattr(toxicity, "_ascend", lambda model, held, *_: told.update(words=int(held.length.sum() + (held.plain[:, 1] * held.plain[:, 2]).sum()), toxic=int(held.gold.sum())))
    rng = random.Random(8)
    docs = [(t.encode().split(), y) for _, t, y in toxic_corpus(rng, 400)]
    docs += [(prose(rng, 1000).encode().split(), 0) for _ in range(60)] + [(b" ".join([b"zorgle the of"] * 20_000).split(), 1)]
    toxicity.fit(docs)
    assert told["words"] == sum(len(words) for words, _ in docs)
    assert told["toxic"] >= sum(w.startswith((b"zorgle", b"blatch", b"grunkel")) for words, label in docs if label for w in words)


def latent_likelihood(weights, params, docs, names):
    """Log chance of the document labels by enumeration of all token labels."""
    index, total = {f: i for i, f in enumerate(names)}, 0.0
    trans, start = params[1:5].reshape(2, 2), params[5:]
    for words, label in docs:
        clean = 1.0
        for s in range(0, len(words), toxicity.WINDOW):
            part = words[s : s + toxicity.WINDOW]
            score = {}
            for y in itertools.product((0, 1), repeat=len(part)):
                x = start[y[0]] + sum(trans[a, b] for a, b in zip(y, y[1:], strict=False))
                score[y] = math.exp(x + sum(params[0] + sum(weights[index[f]] for f in toxicity.features_of(w) if f in index) for w, k in zip(part, y, strict=True) if k))
            clean *= score[(0,) * len(part)] / sum(score.values())
        total += math.log(1 - clean if label else clean)
    return total


def test_latent_gradient_is_the_likelihoods(monkeypatch):
    monkeypatch.setattr(toxicity, "WINDOW", 4)
    docs = [(b"a bad b c bad d".split(), 1), (b"a b".split(), 0), (b"meh b c d bad".split(), 0), (b"meh".split(), 1)]
    names, seen = ["=bad", "=meh"], {}
    monkeypatch.setattr(toxicity, "_kept_features", lambda _: set(names))
    monkeypatch.setattr(toxicity, "_ascend", lambda model, held, *_: seen.update(held=held))
    toxicity.fit(docs)
    held, rng = seen["held"], np.random.default_rng(3)
    weights, params = rng.normal(size=2), rng.normal(size=7)
    push = toxicity._push(weights, params, held, 1e9)
    got, got_p = toxicity._gradient(weights, params, held.cells, np.zeros_like(held.gold), held.length, -push[held.of])
    for d, n, k in held.plain:
        more = toxicity._gradient(weights, params, toxicity._NO_CELLS, np.zeros((1, 4), dtype=np.int8), np.array([n]), np.array([-push[d] * k]))
        got_p = got_p + more[1]
    step = 1e-6
    for i in range(2):
        up, down = (weights + step * sign * np.eye(2)[i] for sign in (1, -1))
        assert got[i] == pytest.approx((latent_likelihood(up, params, docs, names) - latent_likelihood(down, params, docs, names)) / (2 * step), rel=1e-4, abs=1e-6)
    for i in range(7):
        up, down = (params + step * sign * np.eye(7)[i] for sign in (1, -1))
        assert got_p[i] == pytest.approx((latent_likelihood(weights, up, docs, names) - latent_likelihood(weights, down, docs, names)) / (2 * step), rel=1e-4, abs=1e-6)


def test_training_does_not_depend_on_partitions(spark):
    data = toxic_corpus(random.Random(6), 300)
    docs = spark.createDataFrame([(i, t) for i, t, _ in data], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in data], "doc_id long, quality int, toxic int")
    one, two = toxicity.train(docs.coalesce(1), labels), toxicity.train(docs.repartition(7), labels.repartition(3))
    assert one.weights == two.weights and one.weights and (one.trans == two.trans).all() and one.slope == two.slope


def test_gradient_by_chunks(monkeypatch):
    docs = [(t.encode().split(), y) for _, t, y in toxic_corpus(random.Random(9), 200)]
    whole = toxicity.fit(docs, rounds=5)
    monkeypatch.setattr(toxicity, "_CHUNK", 7)
    parts = toxicity.fit(docs, rounds=5)
    assert np.allclose(list(whole.weights.values()), list(parts.weights.values())) and np.allclose(whole.trans, parts.trans) and whole.weights


def test_keep_one_of_components_that_share_an_id(spark):
    rng = random.Random(5)
    a, b = prose(rng, 60), prose(rng, 60)
    docs = spark.createDataFrame([(5, a), (5, b), (7, b), (5, b)], "doc_id long, text string")
    for keep in (simhash.keep_one, shingles.keep_one):
        assert sorted(map(tuple, keep(docs).collect())) == sorted([(5, a), (5, b)])
