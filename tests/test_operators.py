import itertools
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lexmill.functions import scores as S
from lexmill.functions import text as X
from lexmill.operators import convert, html, ngrams, phrases, segment, stats, suffix, train, vectors
from lexmill.sources import corpora
from lexmill.sources import dictionaries as D
from lexmill.streaming import lookups

GOLDEN = "四是四十是十十四是十四四十是四十"


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def texts(spark, *items):
    return spark.createDataFrame(list(enumerate(items)), "doc_id long, text string")


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    return ["".join(rng.choice("abc") for _ in range(rng.randint(2, 25))) for _ in range(12)]


def substrings(items, low, high):
    return Counter(t[i : i + n] for t in items for n in range(low, high + 1) for i in range(len(t) - n + 1))


def test_phrase_goldens(spark):
    told = phrases.signals(texts(spark, GOLDEN), "text", 1, 3)
    got = {r["word"]: r for r in told.collect()}
    assert sum(r["freq"] for r in got.values()) == 45
    assert {w: got[w]["freq"] for w in ("四", "十", "是", "四十", "是四十")} == {"四": 6, "十": 6, "是": 4, "四十": 3, "是四十": 2}
    assert got["四"]["log_prob"] == pytest.approx(-2.0149030205)
    assert got["四十"]["cohesion"] == pytest.approx(1.3217558400)
    assert got["十四"]["cohesion"] == pytest.approx(0.9162907319)
    assert got["四"]["cohesion"] == math.inf
    assert got["十"]["suffix_entropy"] == pytest.approx(1.0549201680)
    assert got["十四"]["suffix_entropy"] == pytest.approx(0.6931471806)
    assert got["四十"]["suffix_entropy"] == 0
    assert got["四十"]["prefix_entropy"] == pytest.approx(0.6365141683)
    assert len(got) == 23
    assert phrases.extract(texts(spark, GOLDEN), "text", 1, 3, post_filter=F.col("freq") > 1).count() == 11


def test_punctuation_and_windows(spark):
    assert phrases.candidates(phrases.signals(texts(spark, "一.二.三"), "text", 1, 2)).count() == 3
    assert rows(phrases.windows(texts(spark, "abc"), "text", 2)) == [(0, "ab"), (1, "bc"), (2, "c")]
    assert rows(phrases.windows(texts(spark, "abc"), "text", 2, True)) == [(0, "a"), (1, "ab"), (2, "bc")]


def test_models(spark, corpus):
    docs = texts(spark, *(f"{a} {b}\n{a}" for a, b in itertools.pairwise(corpus)), "", None)
    chunks = [c for a, b in itertools.pairwise(corpus) for c in (a, b, a)]
    model = ngrams.build_model(docs, "text", 4)
    want = substrings(chunks, 1, 4)
    assert {r["word"]: r["cnt"] for r in model.collect()} == want
    assert ngrams.node_count(model).first()[0] == len(want) + 1
    assert ngrams.total_mass(model).first()[0] == sum(want.values())
    half = ngrams.decay(model, 0.3)
    assert {r["word"]: r["cnt"] for r in half.collect()} == {w: math.floor(c * 0.3) for w, c in want.items()}
    more = ngrams.add_words(model, spark.createDataFrame([("abca", 5), ("zz", 1)], "word string, n long"), count_col="n")
    assert {r["word"]: r["cnt"] for r in more.collect()} == want + Counter({"abca": 5, "zz": 1})
    ents = {r["word"]: r["entropy"] for r in stats.next_char_entropy(model).collect()}
    for w, e in ents.items():
        c = [want[w + ch] for ch in "abc" if want[w + ch]]
        assert e == pytest.approx(-sum(x / sum(c) * math.log(x / sum(c)) for x in c), abs=1e-9)


def test_length_stats(spark, corpus):
    got = {r["len"]: r for r in stats.text_length_stats(texts(spark, *corpus), "text", 3).collect()}
    for g in (1, 2, 3):
        c = sorted(Counter(t[i : i + g] for t in corpus for i in range(len(t))).values())
        assert got[g]["uniq_cnt"] == len(c)
        assert got[g]["mean"] == pytest.approx(sum(c) / len(c))
        assert got[g]["log_sum"] == pytest.approx(sum(math.log(x + 1) for x in c))
        assert got[g]["p01_count"] == next(x for i, x in enumerate(c, 1) if i >= 0.01 * len(c) and (i == len(c) or c[i] > x))


@pytest.mark.parametrize("threshold", [2, 4])
def test_frequent_substrings(spark, corpus, threshold):
    want = {w: c for w, c in substrings(corpus, 1, 25).items() if c >= threshold}
    got = ngrams.frequent_substrings(texts(spark, *corpus), "doc_id", "text", threshold)
    assert {r["word"]: r["cnt"] for r in got.collect()} == want


def test_suffix_order(spark, corpus):
    got = suffix.suffix_array(texts(spark, *corpus), "doc_id", "text")
    for d, t in enumerate(corpus):
        own = sorted((r["rank"], r["pos"], r["height"]) for r in got.where(F.col("doc_id") == d).collect())
        order = sorted(range(len(t)), key=lambda i: t[i:])
        assert [p for _, p, _ in own] == order
        for (_, p, h), q in zip(own[1:], order, strict=False):
            assert h == next((k for k in range(len(t)) if t[p + k : p + k + 1] != t[q + k : q + k + 1] or p + k >= len(t) or q + k >= len(t)), 0)
    words = spark.createDataFrame([("",), ("a",), ("ab",), ("zz",)], "word string")
    bounds = {(r["word"], r["doc_id"]): (r["lower"], r["upper"]) for r in suffix.prefix_bounds(words, texts(spark, *corpus), "doc_id", "text").collect()}
    t = corpus[0]
    s = sorted(t[i:] for i in range(len(t)))
    for w in ("", "a", "ab", "zz"):
        assert bounds[w, 0] == (sum(x < w for x in s), sum(x < w for x in s) + sum(x.startswith(w) for x in s))
    counts = {r["word"]: r["cnt"] for r in ngrams.occurrence_counts(words, texts(spark, *corpus), "text", missing=-1).collect()}
    every = substrings(corpus, 1, 2)
    assert counts == {"a": every["a"], "ab": every["ab"], "zz": -1}


def test_residuals(spark, corpus):
    every = substrings(corpus, 1, 25)
    got = {r["word"]: r["freq"] for r in suffix.substring_classes(texts(spark, *corpus), "text").collect()}
    closed = {w for w in every if max((every[c + w] for c in "abc"), default=0) < every[w]}
    assert {w for w, f in got.items() if f is not None} == closed
    taken = Counter()
    for w in closed:
        up = next((w[k:] for k in range(1, len(w)) if w[k:] in closed), None)
        if up:
            taken[up] += every[w]
    assert {w: got[w] for w in closed} == {w: every[w] - taken[w] for w in closed}


def brute_split(text, score, limit):
    best = None
    for cuts in itertools.product([0, 1], repeat=len(text) - 1):
        words, at = [], 0
        for i, c in enumerate(cuts, 1):
            if c:
                words.append(text[at:i])
                at = i
        words.append(text[at:])
        if all(len(w) <= limit and (w in score or len(w) == 1) for w in words):
            best = max(best, sum(score.get(w, segment.FLOOR) for w in words)) if best is not None else sum(score.get(w, segment.FLOOR) for w in words)
    return best


def test_segmentation(spark, corpus):
    rng = random.Random(1)
    score = {w: rng.uniform(-2, 2) for w in substrings(corpus, 1, 3) if rng.random() < 0.7}
    table = spark.createDataFrame(list(score.items()), "word string, score double")
    chunks = spark.createDataFrame([(c[:9],) for c in corpus] + [("",), (None,)], "chunk string")
    for limit in (10**6, 1):
        for r in segment.segment(chunks, table, max_len=3, broadcast_words=limit).collect():
            if r["chunk"]:
                assert "".join(r["words"]) == r["chunk"]
                assert sum(score.get(w, segment.FLOOR) for w in r["words"]) == pytest.approx(brute_split(r["chunk"], score, 3))
            else:
                assert r["words"] == (None if r["chunk"] is None else [])
    assert segment.best_split("aa", {"a": 1.0, "aa": 2.0}, 2) == ["aa"]
    assert segment.best_split("xy", {"x": -math.inf}, 2) == ["x", "y"]


def test_training(spark):
    docs = texts(spark, "中国人 中国人 中国", "国人")
    model = ngrams.build_model(docs, "text", 3)
    after = train.iterate(model, docs, "text", 1, 0.5)
    got = {r["word"]: r["cnt"] for r in after.collect()}
    before = {r["word"]: r["cnt"] for r in model.collect()}
    added = sum(got.values()) - sum(c // 2 for c in before.values())
    assert 4 <= added <= 10 and set(before) <= set(got)


def test_scores_without_spread(spark):
    model = spark.createDataFrame([("a", 1, 3), ("b", 1, 3), ("ab", 2, 2)], "word string, len int, cnt long")
    asked = spark.createDataFrame([("a",), ("ab",), ("zz",)], "word string")
    told = S.score_table(asked, model, stats.model_length_stats(model), stats.next_char_entropy(model), 8.0)
    got = {r["word"]: r for r in told.collect()}
    assert got["a"]["CmMdSTDE"] == 0 and got["a"]["Sigmoid"] == 0.5
    assert got["zz"]["CdL"] == -math.inf and got["zz"]["Hank"] == pytest.approx(math.log(1e-300))
    assert got["a"]["CdL"] == pytest.approx(math.log(3 / 8))
    assert got["ab"]["Hank"] == pytest.approx(math.log(9 / 64 + 2 / 8))


SMALL = {"BYVoid": ["byv"], "清": ["Qing"], "清華": ["Tsinghua"], "清華大學": ["TsinghuaUniversity"], "積羽沉舟": ["x"], "zigzagzig": ["zag"]}
PHRASES = {"太后": ["太后"], "头发": ["頭髮"], "干燥": ["乾燥"], "鼠标": ["鼠標"]}
CHARACTERS = {"里": ["裏", "里"], "干": ["幹", "乾", "干"], "发": ["發", "髮"], "后": ["後", "后"]}
TAIWAN = {"鼠标": ["滑鼠"], "克罗地亚": ["克羅埃西亞"]}


def test_conversion():
    assert segment.max_match("太后的头发干燥", [(PHRASES, 2)]) == ["太后", "的", "头发", "干燥"]
    own = convert.Converter([PHRASES], [[PHRASES, CHARACTERS]])
    assert own.convert("太后的头发干燥") == "太后的頭髮乾燥"
    assert convert.replace_longest("鼠标克罗地亚", [(PHRASES, 2), (TAIWAN, 4)]) == "鼠標克羅埃西亞"
    chain = convert.Converter([{"里面": ["裏面"]}], [[{"里面": ["裏面"]}], [{"裏": ["裡"]}]])
    assert chain.convert("里面") == "裡面"
    text = '{"segmentation": {"type": "mmseg", "dict": {"type": "inline", "entries": {"燕燕": "燕燕", "于归": "于歸"}}}, "conversion_chain": [{"dict": {"type": "group", "dicts": [{"type": "inline", "entries": {"燕燕于飞": "燕燕于飛", "之子于归": "之子于歸"}}, {"type": "inline", "entries": {"飞": "飛", "归": "歸", "远": "遠"}}]}}]}'
    assert convert.converter(text).convert("燕燕于飞差池其羽之子于归远送于野") == "燕燕于飛差池其羽之子于歸遠送于野"
    with pytest.raises(D.InvalidFormat, match="missing"):
        D.read_config("{}")
    with pytest.raises(D.FileNotFound):
        D.preset("none", ())


def test_dictionaries(spark, tmp_path):
    path = tmp_path / "d.txt"
    path.write_text("﻿b\tx y\na\tz\nbad\nempty\t\nb\tq\n", encoding="utf-8")
    got = {r["key"]: (r["values"], r["error"]) for r in D.scan(spark, str(path)).collect()}
    assert got["bad"][1] == "no tab" and got["empty"][1] == "no value" and got["a"] == (["z"], None)
    good = D.scan(spark, str(path)).where("error is null")
    assert rows(D.merge(good)) == [("a", ["z"]), ("b", ["q"])]
    assert rows(D.reverse(good)) == [("q", ["b"]), ("x", ["b"]), ("y", ["b"]), ("z", ["a"])]
    assert rows(D.find_values(good, "x")) == [("b", "x")]
    with pytest.raises(D.InvalidFormat, match="line 3"):
        D.load(str(path))
    group = D.group_lexicon([spark.createDataFrame(list(d.items()), "key string, values array<string>") for d in (SMALL, {"清華大學計": ["later"], "清": ["no"]})])
    asked = spark.createDataFrame([("BYVoid123",), ("清華大學計算機系",), ("Unknown",)], "t string")
    assert rows(D.longest_prefix(asked, "t", group).select("text", "key")) == [("BYVoid123", "BYVoid"), ("清華大學計算機系", "清華大學")]
    found = [r["key"] for r in D.prefix_matches(asked, "t", group).orderBy(F.desc("len")).collect() if r["text"][0] == "清"]
    assert found == ["清華大學計", "清華大學", "清華", "清"]


def test_cleaning(spark):
    mixed = texts(spark, "ab中文　 1，文\t字x").select("text")
    got = mixed.select(X.squeeze_others(F.col("text")), X.drop_others(F.col("text")), X.drop_controls(F.col("text")), X.class_length(F.col("text"))).first()
    assert tuple(got) == (" 中文 文 字 ", "中文文字", "ab中文1，文字x", 4)
    cites = texts(spark, "a[12]b[註 3]c[a 9]d[ab][][5").select(X.drop_citations(F.col("text"))).first()[0]
    assert cites == "abcd[ab][][5"
    assert texts(spark, " a \n\n\n　b\t\n").select(X.drop_empty_lines(F.col("text"))).first()[0] == "a\nb\n"
    assert texts(spark, "東菄鶇䍶𠍀倲").select(X.truncate_bytes(F.col("text"), 4), X.truncate_bytes(F.col("text"), 16)).first()[:] == ("東", "東菄鶇䍶𠍀")
    assert [r[0] for r in texts(spark, "1:2:a:b", "x", "1:2").select(X.index_title(F.col("text"))).collect()] == ["a:b", "x", "1:2"]
    lcp = spark.createDataFrame([("abc", "abd"), ("ab", "abc"), ("", "x")], "a string, b string")
    assert [tuple(r) for r in lcp.select(X.common_prefix_length(F.col("a"), F.col("b")), X.common_prefix_length(F.col("a"), F.col("b"), True)).collect()] == [(2, 2), (2, 0), (0, 0)]
    assert spark.createDataFrame([(bytearray("é", "utf-8"),)], "b binary").select(X.transcode(F.col("b"), "UTF-8", "UTF-16LE"), X.transcode_any(F.col("b"), "utf-8", "gbk")).first()[:] == ("é".encode("utf-16-le"), "é".encode("gbk"))


PAGE = """<html><head><title>no</title><script>var a="</div>";</script></head><body>out<div class="mw-parser-output"><p>Text <b>bold</b> &amp; x[1]</p>
<table class="navbox"><tr><td>table</td></tr></table><h2>Head</h2><ul class="gallery"><li>pic</li></ul><p>{\\displaystyle a{b}c}after</p></i><!-- c -->
<span id="參考文獻">r</span><p>late</p></div></body></html>"""


def test_extraction(spark):
    got = html.extract_pages(spark.createDataFrame([(PAGE,), (None,), ("",)], "html string")).collect()
    assert got[0]["cut_off"] and got[0]["extra_end_tags"] == 1 and got[0]["extract_error"] is None
    assert "Text bold & x" in " ".join(got[0]["text"].split()) and "after" in got[0]["text"]
    for word in ("no", "table", "Head", "pic", "late", "out", "displaystyle", "[1]"):
        assert word not in got[0]["text"]
    assert got[1]["text"] is None and got[2]["text"] == ""
    tags = spark.createDataFrame([("a<div class='x'>b<div>c</div></div>d",)], "h string")
    assert tags.select(html.select_elements(F.col("h"), "div", "x"), html.remove_elements(F.col("h"), "div", "x"), html.remove_elements(F.col("h"), "div", "x", True)).first()[:] == (["b<div>c</div>"], "ad", "ab<div>c</div>d")


def test_sources(spark, tmp_path):
    words = [("a", 2), ("ab", 1), ("中", 3)]
    assert list(corpora.trie_words(corpora.trie_bytes(words))) == sorted(words)
    (tmp_path / "m.bin").write_bytes(corpora.trie_bytes(words))
    assert rows(corpora.load_trie(spark, str(tmp_path / "m.bin")).select("word", "cnt")) == sorted(words)
    dump = '<m:mediawiki xmlns:m="u"><m:page><m:title>A</m:title><m:ns>0</m:ns><m:revision><m:id>1</m:id><m:text bytes="2">hi</m:text></m:revision></m:page><m:page><m:title>T</m:title><m:ns>1</m:ns><m:revision><m:text>no</m:text></m:revision></m:page></m:mediawiki>'
    (tmp_path / "d.xml").write_text(dump)
    assert rows(corpora.xml_dump(spark, str(tmp_path / "d.xml"))) == [("A", "hi")]
    (tmp_path / "u16.txt").write_bytes("中x".encode("utf-16-le"))
    assert corpora.text_files(spark, str(tmp_path / "u16.txt"), "UTF-16LE").first()["text"] == "中x"
    table = spark.createDataFrame([("P={'B': {'a': -1.5}, 'E': {'b': -2.0}}",)], "value string")
    assert rows(corpora.emission_table(table)) == [("B", "a", -1.5), ("E", "b", -2.0)]
    black = spark.createDataFrame([("b",)], "title string")
    (tmp_path / "i.txt").write_text("1:2:a\n1:3:b\n")
    assert rows(corpora.title_index(spark, str(tmp_path / "i.txt"), black)) == [("a",)]


def test_vectors(spark):
    v = spark.createDataFrame([([1, 2, 3], [4, 5]), ([], [1])], "a array<int>, b array<int>")
    assert [r[0] for r in v.select(vectors.convolve(F.col("a"), F.col("b"))).collect()] == [[4, 13, 22, 15], []]
    one = spark.createDataFrame([(i, x) for i, x in enumerate([1, 2, 3])], "i long, value int")
    two = spark.createDataFrame([(i, x) for i, x in enumerate([4, 5])], "i long, value int")
    assert rows(vectors.convolve_rows(one, two)) == [(0, 4), (1, 13), (2, 22), (3, 15)]


def test_lookups(spark, tmp_path):
    model = spark.createDataFrame([("a", 1, 3)], "word string, len int, cnt long")
    asked = spark.createDataFrame([("a",), ("q",)], "word string")
    assert rows(lookups.answer(asked, model)) == [("a", 3, "3"), ("q", 0, "0")]
    assert {r["reply"] for r in lookups.answer(asked, model, ready=False).collect()} == {"Not yet"}
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("ab ab\n")
    stream = lookups.running_counts(spark.readStream.text(str(tmp_path / "in")), "value", 2)
    q = stream.writeStream.format("memory").queryName("running").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert {r["word"]: r["cnt"] for r in spark.table("running").collect()} == {"a": 2, "b": 2, "ab": 2}
