"""Sinks, saved forms, dictionaries and configurations; and cases of suffix order and training that need long ways."""

import io
import math
import random
import sys
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lexmill.functions import scores as S
from lexmill.functions import text as X
from lexmill.operators import convert, ngrams, phrases, segment, suffix, train
from lexmill.sources import corpora
from lexmill.sources import dictionaries as D
from lexmill.streaming import lookups

from .test_operators import rows, texts


def lines_of(folder):
    return [line for part in sorted(Path(folder).glob("part-*")) for line in part.read_text(encoding="utf-8").splitlines()]


def test_sinks(spark, tmp_path):
    model = spark.createDataFrame([("b", 1, 2), ("a", 1, 3), ("c", 1, 0), ("ab", 2, 1)], "word string, len int, cnt long")
    corpora.save_model(model, f"{tmp_path}/model")
    assert rows(corpora.load_model(spark, f"{tmp_path}/model")) == rows(model)
    corpora.write_counts(ngrams.word_list(model), f"{tmp_path}/counts", ordered=True)
    assert lines_of(tmp_path / "counts") == ["a,3", "ab,1", "b,2"]
    corpora.write_counts(model.select("cnt", "len").where("cnt = 2"), f"{tmp_path}/head", header=True)
    assert lines_of(tmp_path / "head") == ["cnt,len", "2,1"]
    corpora.write_words(spark.createDataFrame([(["x", "y"],)], "words array<string>"), f"{tmp_path}/words")
    assert lines_of(tmp_path / "words") == ["x", "y"]
    corpora.write_texts(texts(spark, "one"), f"{tmp_path}/texts")
    assert lines_of(tmp_path / "texts") == ["one"]
    corpora.write_articles(spark.createDataFrame([("T", "body")], "title string, text string"), f"{tmp_path}/articles", style="dump")
    assert lines_of(tmp_path / "articles") == ["", "=" * 20 + "T" + "=" * 20, "body"]
    told = spark.createDataFrame([("w", 4, -1.0, 2.0, 0.5, 0.25)], "word string, freq long, log_prob double, cohesion double, suffix_entropy double, prefix_entropy double")
    corpora.write_phrases(told, f"{tmp_path}/phrases")
    assert lines_of(tmp_path / "phrases") == ["w 4 -1.0 2.0 0.75 0.25 0.5"]
    cut = texts(spark, "abcdef", "ab").select(corpora.preview(F.col("text"), 3)).collect()
    assert [r[0] for r in cut] == ["abc(Cut)", "ab"]
    pages = spark.createDataFrame([("a", None), ("b", "broken")], "t string, extract_error string")
    assert rows(corpora.errors(pages)) == [("b", "broken")]


def test_inputs(spark, tmp_path):
    for name, text in (("a", "one"), ("b", "two")):
        (tmp_path / f"{name}.txt").write_text(text)
    both = corpora.text_files(spark, str(tmp_path))
    assert corpora.concatenated(both).first()["text"] == "onetwo"
    assert "tw" in {r["word"] for r in ngrams.occurrences(corpora.concatenated(both), F.col("text"), 2, 2).collect()}
    assert rows(corpora.first_given(None, both.limit(0), texts(spark, "x")).select("text")) == [("x",)]
    with pytest.raises(ValueError):
        corpora.first_given(None, both.limit(0))
    (tmp_path / "titles").write_text("a\n\nb\n")
    assert rows(corpora.title_list(spark, str(tmp_path / "titles"), spark.createDataFrame([("b",)], "title string"))) == [("a",)]
    page = lambda body: f"<page><title>A</title>{body}<ns>0</ns><revision><text>x</text></revision></page>"
    (tmp_path / "d.xml").write_text(f"<mediawiki>{page('')}{page('<title>B</title>')}</mediawiki>")
    assert rows(corpora.xml_dump(spark, str(tmp_path / "d.xml"), broken="drop")) == [("A", "x")]
    with pytest.raises(Exception, match="exactly one title"):
        corpora.xml_dump(spark, str(tmp_path / "d.xml")).collect()


def test_saved_suffix_array(spark, tmp_path):
    t = texts(spark, "banana", "ab" * 5)
    array = suffix.suffix_array(t, "doc_id", "text")
    corpora.save_suffix_array(array, f"{tmp_path}/sa")
    assert rows(corpora.load_suffix_array(spark, f"{tmp_path}/sa")) == rows(array)
    told = {r["doc_id"]: r["lines"] for r in suffix.export_listing(array, t, "doc_id", "text").collect()}
    assert told[0].split("\n") == ["SA.S", "b a n a n a", "SA.SA", "5 3 1 0 4 2", "SA.RANK", "3 2 5 1 4 0", "SA.HEIGHT", "0 1 3 0 0 2"]


@pytest.mark.parametrize("key_len", [1, 3])
def test_suffix_order_by_doubling(spark, key_len):
    rng = random.Random(key_len)
    held = ["".join(rng.choice("ab") for _ in range(60)), "a" * 40, "abcabc" * 9, "x", "".join(rng.choice("abc") for _ in range(20)) * 3]
    got = suffix.suffix_array(texts(spark, *held), "doc_id", "text", key_len).collect()
    for d, t in enumerate(held):
        own = sorted((r["rank"], r["pos"], r["height"]) for r in got if r["doc_id"] == d)
        order = sorted(range(len(t)), key=lambda i: t[i:])
        heights = [0] + [next(k for k in range(len(t)) if t[p + k : p + k + 1] != t[q + k : q + k + 1] or not t[p + k : p + k + 1]) for p, q in zip(order, order[1:], strict=False)]
        assert own == list(zip(range(len(t)), order, heights, strict=True))


def test_bounds_of_long_words(spark):
    t = "ab" * 100
    words = spark.createDataFrame([(t[:150],), ("ab" * 40 + "b",)], "word string")
    got = {r["word"]: (r["lower"], r["upper"]) for r in suffix.prefix_bounds(words, texts(spark, t), "doc_id", "text").collect()}
    s = sorted(t[i:] for i in range(len(t)))
    for w, bounds in got.items():
        assert bounds == (sum(x < w for x in s), sum(x < w or x.startswith(w) for x in s))
    assert len(got) == 2
    assert rows(lookups.bounds_reply(suffix.prefix_bounds(spark.createDataFrame([("an",)], "word string"), texts(spark, "banana"), "doc_id", "text")).select("reply")) == [("an \t3:1\t2",)]


def test_binary_dictionaries(spark, tmp_path):
    entries = {"清華": ["Tsinghua"], "b": ["x", "y z"], "清": ["Qing"]}
    data = D.to_binary(entries)
    assert D.from_binary(data) == entries
    trie = b"not read"
    assert D.from_binary(b"ABCDEFGHIJK1" + len(trie).to_bytes(8, "little") + trie + data) == entries
    for broken in (data[:4], data[:30], data[:-1]):
        with pytest.raises(D.InvalidFormat):
            D.from_binary(broken)
    (tmp_path / "d.txt").write_text("a\tx y\nb\tz\n", encoding="utf-8")
    D.convert_file(str(tmp_path / "d.txt"), str(tmp_path / "d.ocd"))
    D.convert_file(str(tmp_path / "d.ocd"), str(tmp_path / "again.txt"))
    assert (tmp_path / "again.txt").read_text() == (tmp_path / "d.txt").read_text()
    assert rows(D.scan_binary(spark, str(tmp_path / "d.ocd"))) == [("a", ["x", "y"]), ("b", ["z"])]
    node = {"type": "ocd", "file": "d.ocd"}
    assert D.read_dict(node, (str(tmp_path),)) == [{"a": ["x", "y"], "b": ["z"]}]
    with pytest.raises(D.FileNotFound):
        D.read_dict({"type": "ocd", "file": "again.ocd"}, (str(tmp_path),))
    group = D.group_lexicon([spark.createDataFrame(list(d.items()), "key string, values array<string>") for d in (entries, {"b": ["late"], "c": ["c"]})])
    asked = spark.createDataFrame([("b",), ("c",), ("清華大",)], "word string")
    assert rows(D.lookup(asked, group)) == [("b", ["x", "y z"]), ("c", ["c"]), ("清華大", None)]
    D.write(spark.createDataFrame(list(entries.items()), "key string, values array<string>").coalesce(1), f"{tmp_path}/out")
    assert lines_of(tmp_path / "out") == ["b\tx y z", "清\tQing", "清華\tTsinghua"]


FILES = {
    "STPhrases": "里面\t裏面\n鼠标\t鼠標", "STCharacters": "里\t裏 里\n面\t面\n发\t發 髮", "TSPhrases": "裏面\t里面", "TSCharacters": "裏\t里\n發\t发\n鼠\t鼠\n標\t标", "TWVariants": "裏\t裡", "HKVariants": "裏\t裡",
    "TWPhrasesIT": "鼠標\t滑鼠", "TWPhrasesName": "面包\t麵包", "TWPhrasesOther": "鼠標\t滑鼠 鼠標器", "TWVariantsRevPhrases": "那裡\t那裏", "HKVariantsRevPhrases": "那裡\t那裏", "HKVariantsPhrases": "里程\t里程",
}


def test_presets_with_derived_dictionaries(spark, tmp_path, monkeypatch):
    for name, text in FILES.items():
        (tmp_path / f"{name}.txt").write_text(text + "\n", encoding="utf-8")
    folders = (str(tmp_path),)
    assert D.named("TWPhrases", folders) == {"鼠標": ["滑鼠", "鼠標器"], "面包": ["麵包"]}
    assert D.named("TWPhrasesRev", folders) == {"滑鼠": ["鼠標"], "鼠標器": ["鼠標"], "麵包": ["面包"]}
    want = {"s2t": ("里面", "裏面"), "t2s": ("裏面", "里面"), "s2tw": ("里面", "裡面"), "tw2s": ("裡面", "里面"), "s2hk": ("里面", "裡面"), "hk2s": ("裡面", "里面"), "s2twp": ("鼠标", "滑鼠"), "tw2sp": ("滑鼠", "鼠标"), "t2tw": ("裏", "裡"), "t2hk": ("裏", "裡")}
    for name, (given, told) in want.items():
        assert convert.converter(name, folders).convert(given) == told, name
    assert convert.register(spark, folders) == list(D.PRESETS)
    asked = spark.createDataFrame([("里面", "s2tw"), (None, "s2t")], "t string, c string")
    assert rows(asked.selectExpr("convert_zh(t, c)")) == [("裡面",), (None,)]
    (tmp_path / "in.txt").write_text("里面\n发\n", encoding="utf-8")
    convert.main(["-c", "s2t", "-p", str(tmp_path), "-i", str(tmp_path / "in.txt"), "-o", str(tmp_path / "o.txt")])
    assert (tmp_path / "o.txt").read_text(encoding="utf-8") == "裏面\n發\n"
    out = io.StringIO()
    monkeypatch.setattr(sys, "stdin", io.StringIO("里面\n"))
    monkeypatch.setattr(sys, "stdout", out)
    convert.main(["-c", "s2tw", "-p", str(tmp_path), "--noflush"])
    assert out.getvalue() == "裡面\n"
    (tmp_path / "STCharacters.txt").unlink()
    with pytest.raises(D.FileNotFound, match="STCharacters"):
        D.preset("s2t", folders)


def test_listings(spark):
    t = texts(spark, "abab\nab", "xx")
    assert [r["line"] for r in ngrams.repeated_listing(t, "text", 2).collect()] == ["3\tab", "Total Count: 3"]
    found = phrases.listed(spark.createDataFrame([("b", 2), ("a", 2), ("c", 9)], "word string, freq long"))
    assert [r["word"] for r in found.collect()] == ["c", "a", "b"]
    one = texts(spark, "cabab")
    assert [r["window"] for r in phrases.sorted_windows(one, "text", 2).collect()] == ["ab", "ab", "b", "ba", "ca"]
    assert [r["window"] for r in phrases.sorted_windows(one, "text", 2, True).collect()] == ["ba", "ca", "ab", "ab", "c"]
    asked = spark.createDataFrame([("ab", 1), ("zz", 2), ("", 3)], "word string, k int")
    assert sorted(r["k"] for r in ngrams.occurring(asked, t, "text").collect()) == [1, 3]
    model = spark.createDataFrame([("ab", 2, 3), ("a", 1, 5)], "word string, len int, cnt long")
    assert [tuple(r) for r in ngrams.trie_nodes(model).collect()] == [("", 0, 0), ("a", 1, 5), ("ab", 2, 3)]


def test_text_helpers(spark):
    df = spark.createDataFrame([("清a華", "華", {"x": 1})], "t string, p string, m map<string,bigint>")
    t, p, m = F.col("t"), F.col("p"), F.col("m")
    got = df.select(
        X.move_right(t), X.move_left(t), X.byte_position(t, p), X.byte_position(t, F.lit("q")), X.not_shorter_than(t, 7), X.not_shorter_than(t, 8), X.reverse_compare(t, p), X.reverse_compare(p, p),
        X.multiset_add(m, F.lit("x")), X.multiset_remove(X.multiset_add(m, F.lit("y")), F.lit("x")), X.multiset_remove(m, F.lit("z")), X.stamp(F.to_timestamp(F.lit("2020-01-02 03:04:05.678901"))),
    ).first()
    assert tuple(got) == ("a華", "清a", 4, None, True, False, 1, 0, {"x": 2}, {"y": 1}, {"x": 1}, "2020-01-02 03-04-05.6789010")


def test_count_function(spark):
    model = spark.createDataFrame([("a", 1, 8), ("ab", 2, 4), ("b", 1, 5)], "word string, len int, cnt long")
    words = spark.createDataFrame([("ab",), ("ba",)], "word string")
    got = {r["word"]: r["score"] for r in S.count_scores(words, model, 10, "C(S) / C(left(S, 1)) + C(right(S, 1)) * N + length(S)").collect()}
    assert got == {"ab": pytest.approx(4 / 8 + 5 * 10 + 2), "ba": pytest.approx(0 + 8 * 10 + 2)}
    for bad in ("C(S", "C(C(S))"):
        with pytest.raises(ValueError):
            S.count_scores(words, model, 10, bad)
    chunks = spark.createDataFrame([("abb",)], "chunk string")
    table = train.scored_words(model, chunks, 10.0, expression="ln(C(S) + 1) * length(S)", max_len=2)
    assert segment.segment(chunks, table, max_len=2).first()["words"] == ["a", "b", "b"]


def test_training_rounds(spark, tmp_path):
    rng = random.Random(3)
    held = [" ".join("".join(rng.choice("abc") for _ in range(rng.randint(2, 7))) for _ in range(5)) for _ in range(8)]
    t = texts(spark, *held)
    model = ngrams.build_model(t, "text", 3)
    got = train.iterate(model, t, "text", 3, 0.5, max_len=3, char_class=X.LETTERS, folder=str(tmp_path))
    counts = {r["word"]: r["cnt"] for r in model.collect()}
    chunks = Counter(c for line in held for c in line.split(" "))
    for k in range(3):
        stats = {}
        for n in {len(w) for w in counts}:
            own = [c for w, c in counts.items() if len(w) == n and c]
            mean = sum(own) / len(own)
            stats[n] = mean, math.sqrt(sum((c - mean) ** 2 for c in own) / len(own))
        score = {}
        for c in chunks:
            for i in range(len(c)):
                for j in range(i + 1, min(len(c), i + 3) + 1):
                    w = c[i:j]
                    mean, sd = stats[len(w)]
                    score[w] = round(len(w) / (1 + math.exp(-((counts.get(w, 0) - mean) / sd if sd else 0))), 9)
        counts = {w: c // 2 for w, c in counts.items()}
        for c, times in chunks.items():
            for w in segment.best_split(c, score, 3):
                counts[w] = counts.get(w, 0) + times
        if k < 2:
            assert {r["word"]: r["cnt"] for r in spark.read.parquet(f"{tmp_path}/round-{k + 1}").collect()} == counts
    assert {r["word"]: r["cnt"] for r in got.collect()} == counts


def test_word_table_beyond_the_broadcast(spark):
    chunks = spark.createDataFrame([("abab",), ("",), (None,), ("abab",)], "chunk string")
    scores = spark.createDataFrame([("ab", 2.0), ("a", 0.5), ("b", 0.5), ("aba", 2.2), ("x", None)], "word string, score double")
    both = [sorted(map(repr, segment.segment(chunks, scores, broadcast_words=k).collect())) for k in (10, 0)]
    assert both[0] == both[1]
