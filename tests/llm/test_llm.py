import base64
import hashlib
import json
import math
import random
import re
import string
import zipfile
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from lexmill.llm import chat, decontam, graph, lm, mixing, queries, secrets, simhash, syncmers, toxicity, urls, warc

from .conftest import prose, secret


def ordered(df):
    return sorted(map(tuple, df.collect()), key=repr)


def components(n, links):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


# Graph
@pytest.mark.parametrize("small", [0, 40, None])
def test_components(spark, small):
    rng = random.Random(5)
    links = [(i, i + 1) for i in range(60)] + [(100, 101 + i) for i in range(50)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    edges = spark.createDataFrame(links + [(5, 5), (3, 4), (None, 1)], "src long, dst long")
    got = {r["vertex"]: r["component"] for r in graph.connected_components(edges, small=small).collect()}
    want = components(300, links)
    ids = {v for a, b in links if a != b for v in (a, b)}
    assert set(got) == ids
    assert len({(got[v], want[v]) for v in ids}) == len({got[v] for v in ids}) == len({want[v] for v in ids})
    assert graph.connected_components(edges.limit(0)).count() == 0


# 1 SimHash
def plain_simhash(text):
    low = (text or "").translate({i: i + 32 for i in range(65, 91)})
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def near(fps, limit=3):
    f = np.array(fps, dtype=np.uint64)
    return np.argwhere(np.triu(np.bitwise_count(f[:, None] ^ f[None, :]) <= limit, 1)).tolist()


@pytest.mark.parametrize("bucket", [4096, 3])
def test_links(spark, bucket):
    rng = random.Random(bucket)
    seeds = [rng.getrandbits(64) for _ in range(25)]
    fps = {0, *seeds}
    for s in seeds[:8]:
        for _ in range(12):
            s ^= sum(1 << b for b in rng.sample(range(64), rng.randint(1, 3)))
            fps.add(s)
    fps = sorted(fps)
    df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps], "fp long")
    got = simhash.near_links(df, bucket=bucket).collect()
    place = {x: i for i, x in enumerate(fps)}
    links = [(place[r["src"] % 2**64], place[r["dst"] % 2**64]) for r in got]
    assert all((fps[a] ^ fps[b]).bit_count() <= 3 for a, b in links)
    assert components(len(fps), links) == components(len(fps), near(fps))


def test_near_duplicates(spark, odd, none):
    rows = odd.select("doc_id", "text").collect()
    fps = [plain_simhash(r["text"]) for r in rows]
    got = simhash.near_duplicates(odd).collect()
    assert Counter((r["doc_id"], r["fp"] % 2**64) for r in got) == Counter((r["doc_id"], f) for r, f in zip(rows, fps, strict=True))
    comp = components(len(rows), near(fps))
    least = {}
    for r, c in zip(rows, comp, strict=True):
        if r["doc_id"] is not None:
            least[c] = min(least.get(c, 10**9), r["doc_id"])
    want = Counter((r["doc_id"], least.get(c)) for r, c in zip(rows, comp, strict=True))
    assert Counter((r["doc_id"], r["component_id"]) for r in got) == want
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns
    assert Counter(r["doc_id"] for r in kept.where("doc_id is not null").collect()) == Counter(set(least.values()))
    assert kept.where("doc_id is null").count() == 2
    assert simhash.near_duplicates(none).count() == 0 and simhash.keep_one(none).count() == 0


# 2 WARC
@pytest.mark.parametrize("zip64", [False, True])
def test_package(tmp_path, zip64):
    items = [(i, warc.record(i, f"http://x/{i}", b"p" * i, i, warc.payload_digest(b"p" * i), None)) for i in range(5)]
    items.append((9, warc.record(9, "", b"", 4, warc.payload_digest(b"pppp"), 4)))
    path = tmp_path / "a.zip"
    size = warc.write_package(str(path), items, zip64)
    with zipfile.ZipFile(path) as z:
        assert z.testzip() is None and z.namelist() == [warc.DATA, warc.INDEX]
    got = list(warc.read_package(str(path), size, True))
    assert [r["payload"] for r in got[:5]] == [b"p" * i for i in range(5)] and all(r["verified"] for r in got[:5])
    assert (got[5]["record_type"], got[5]["refers_to"], got[5]["payload_bytes"]) == ("revisit", 4, 4)
    path.write_bytes(path.read_bytes()[:-5])
    with pytest.raises(ValueError):
        list(warc.read_package(str(path), size - 5, True))


@pytest.mark.parametrize("hot", [500, 1])
def test_round_trip(spark, tmp_path, monkeypatch, hot):
    monkeypatch.setattr(warc, "HOT_ROWS", hot)
    pages = [(i, f"http://h/{i}", h) for i, h in enumerate(["a", "b", "a", None, "", "ü" * 3000, "a"])] + [(None, "u", "x"), (None, None, "b"), (None, "v", "x"), (7, None, "b"), (4, "w", "")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    first = {}
    for i, _, h in pages:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    want = Counter()
    for i, _, h in pages:
        body, one = (h or "").encode(), first.get(h or "")
        want[i, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), *(("response", None) if one == i else ("revisit", one))] += 1
    assert Counter(map(tuple, warc.round_trip(df).collect())) == want
    assert warc.round_trip(df.limit(0)).count() == 0
    small = warc.write_archives(df, f"file://{tmp_path}/x", min_bytes=2)
    assert warc.read_archives(small).where("record_type = 'revisit'").count() == 0
    assert {bytes(r["payload"]).decode() for r in warc.read_archives(small).collect()} == {h or "" for _, _, h in pages}


def test_packages_are_read_by_many_tasks(spark, monkeypatch):
    df = spark.range(0, 400, 1, 40).selectExpr("id AS page_id", "'u' AS url", "concat('x', id) AS html")
    manifest = warc.write_archives(df, f"{warc.scratch_path(spark, 'many')}")
    packages = manifest.count()
    got = warc.read_archives(manifest, False).select(F.spark_partition_id().alias("p"), "record_id").collect()
    assert packages > 1 and len(got) == 400 and len({r["p"] for r in got}) == min(packages, 16)


# 3 Secrets
def plain_spans(text):
    found = [(m.start(), "assign", m.end()) for m in re.finditer(secrets.ASSIGN, text) if len(m[2]) >= 6]
    found += [(m.start(), "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found, key=lambda s: (s[0], ("assign", "access", "hex").index(s[1])))


def test_secrets(spark, odd, none):
    rng = random.Random(2)
    token = secret(rng, 44)
    planted = ["中 token = token: abcdefgh PASSWORD:'hunter22' 𠍀 api_key=\"k1234567\"", "AKIA" + "A1" * 9 + " x " + "0a" * 15, "secret=abc password==xyzzyx", f"say {token} now", "internationalisation counterrevolutionary " * 30]
    extra = spark.createDataFrame([(1000 + i, t) for i, t in enumerate(planted)], "doc_id long, text string")
    df = odd.select("doc_id", "text").union(extra)
    got = secrets.secret_report(df).collect()
    texts = Counter()
    for r in df.collect():
        base = ",".join(f"{k}:{a}:{b}" for a, k, b in plain_spans(r["text"] or ""))
        texts[r["doc_id"], hashlib.sha256(base.encode()).hexdigest()] += 1
    assert Counter((r["doc_id"], r["base_sha256"]) for r in got) == texts
    by = {r["doc_id"]: r["spans"] for r in got}
    assert by[1003] == f"random:4:{4 + len(token)}"
    assert "random" not in by[1004] and "random" not in by[30]
    clean = {r["doc_id"]: r["text"] for r in secrets.redact(df).collect()}
    assert clean[1003] == "say [SECRET] now" and clean[1004] == planted[4] and "hunter22" not in clean[1000]
    assert secrets.redact(odd).columns == odd.columns and secrets.redact(odd).count() == odd.count()
    assert secrets.secret_report(none).count() == 0 and secrets.redact(none).count() == 0


def test_battery(spark):
    rng = random.Random(4)
    good = [secret(rng, 32, a) for a in ("0123456789abcdef", string.ascii_letters + string.digits, string.ascii_uppercase + "234567") for _ in range(60)]
    bad = ["ab" * 16, "a" * 32, "abcdefghijklmnopqrstuvwxyz012345", "thethethethethethethethethethethe"]
    got = {r["t"]: r["b"] for r in spark.createDataFrame([(x,) for x in good + bad], "t string").select("t", secrets.battery(F.col("t")).alias("b")).collect()}
    assert sum(got[x]["p"] < 0.01 for x in good) <= 9
    assert all(got[x]["p"] < 0.05 for x in bad)
    assert got[good[0]]["encoding"] == "hex"


# 4 Mixing
def plain_fill(budget, items):
    """items: (weight, capacity) -> amounts, by repeated rounds."""
    got, live, left = [0.0] * len(items), {i for i, (w, c) in enumerate(items) if w > 0 and c > 0}, budget
    while live and left > 1e-9:
        total = sum(items[i][0] for i in live)
        full = {i for i in live if left * items[i][0] / total >= items[i][1] - got[i] - 1e-12}
        if not full:
            for i in live:
                got[i] += left * items[i][0] / total
            break
        for i in full:
            left -= items[i][1]
            got[i] = items[i][1]
        live -= full
    return got


def plain_mix(rows, plan):
    leaf = {}
    for r in rows:
        n = len((r["text"] or "").split())
        number = re.search(r"([0-9]{1,4})$", r["source"] or "?")
        domain = {1: "books", 2: "forum", 3: "code"}.get(int(number[1]) % 4 if number else 9, "web")
        if n:
            leaf.setdefault((domain, r["lang"] or "?", r["source"] or "?"), []).append((r["doc_id"], n))
    cap = {k: sum(n for _, n in v) * plan.max_epochs for k, v in leaf.items()}
    budget = plan.budget or sum(cap.values()) / plan.max_epochs
    out = Counter()

    def share(prefix, amount):
        kids = sorted({k[: len(prefix) + 1] for k in cap if k[: len(prefix)] == prefix})
        names = (plan.domains, plan.langs, plan.sources)[len(prefix)]
        parts = plain_fill(amount, [(names.get(k[-1], plan.other), sum(c for x, c in cap.items() if x[: len(k)] == k)) for k in kids])
        for k, x in zip(kids, parts, strict=True):
            if len(k) < 3:
                share(k, x)
                continue
            x = math.floor(round(x, 4))
            tokens = cap[k] // plan.max_epochs
            whole, rest = x // tokens, x % tokens
            keyed = sorted((hashlib.md5(f"{plan.seed}:{whole}:{'null' if d is None else d}".encode()).hexdigest(), d, n) for d, n in leaf[k] if True)
            for e in range(whole):
                out.update((d, e) for d, _ in leaf[k])
            done = 0
            for h in sorted({h for h, _, _ in keyed}):
                own = [(d, n) for g, d, n in keyed if g == h]
                done += sum(n for _, n in own)
                if done > rest:
                    break
                out.update((d, whole) for d, _ in own)

    share((), budget)
    return out


@pytest.mark.parametrize("plan", [mixing.Plan(), mixing.Plan(budget=3000, seed=5), mixing.Plan(budget=10**9, max_epochs=2), mixing.Plan(langs={"en": 0.0}, other=0.5)])
def test_mixing(odd, none, plan):
    rows = odd.where("doc_id is not null").collect()
    df = odd.where("doc_id is not null")
    want = plain_mix(rows, plan)
    assert Counter((r["doc_id"], r["epoch"]) for r in mixing.mix(df, plan).collect()) == want
    full = mixing.mix(df, plan, with_docs=True)
    assert full.columns == [*odd.columns, "_epoch"]
    assert Counter((r["doc_id"], r["_epoch"]) for r in full.collect()) == want
    assert mixing.mix(none, plan).count() == 0


# 5 URLs
def test_urls(spark):
    canon = lambda u: f'<head><link rel="canonical" href="{u}"></head>'
    pages = [
        ("http://A.example.net/en/x?q", ""), ("http://example.net/de/", ""), ("http://www.example.com/de/a", ""), ("http://fr.org/fr/", ""),
        ("http://x.com/1", canon("http://a.net/p")), ("http://y.com/2", '<meta http-equiv="refresh" content="0; url=http://x.com/1">'), ("http://y.com/2#top", ""),
        ("http://z.com/3", canon("http://b.net/p")), ("http://z.com/3?utm_source=a", canon("http://o.org/fr/1")),
        ("http://notexample.com/de/", ""), ("http://q.com", None), ("no url", ""), (None, ""), ("http://q.com/?a=1&ref=2", ""), ("http://q.com?a=1", ""),
    ]
    got = {r["page_id"]: r for r in urls.filter_urls(spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(pages)], "page_id long, url string, html string")).collect()}
    assert [got[i]["verdict"] for i in range(len(pages))] == ["allow", "block", "block", "allow", "block", "block", "block", "allow", "allow", *["allow"] * 6]
    assert [got[i]["rule"] for i in range(4)] == ["example.net/en/", "net/", "example.com/de/", "org/fr/"]
    assert (got[0]["host"], got[0]["path"]) == ("a.example.net", "/en/x") and (got[12]["host"], got[12]["path"]) == ("", "")
    assert urls.filter_urls(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


# 6 Syncmers
def signed(x):
    return x - (1 << 64) if x >> 63 else x


def text_hash(data, seed=42):
    return xxhash.xxh64_intdigest(data if isinstance(data, bytes) else data.encode(), seed % 2**64)


def long_hash(values):
    seed = 42
    for v in values:
        seed = text_hash(v.to_bytes(8, "little", signed=True), seed)
    return seed


def plain_anchors(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text.lower())
    inner = [signed(text_hash(b, text_hash(a))) for a, b in zip(words, words[1:], strict=False)]
    out = []
    for i in range(len(words) - 4):
        own = inner[i : i + 4]
        if own.index(min(own)) in (0, 3):
            out.append((i, long_hash([own[0], own[2], own[3]]) & syncmers.MASK))
    return out or ([(0, text_hash(" ".join(words)) & syncmers.MASK)] if words else [])


def dice(a, b):
    return 2 * len(set(a) & set(b)) / (len(a) + len(b)) if a or b else 1.0


def plain_shift(a, b):
    first = [{}, {}]
    for own, side in zip((a, b), first, strict=True):
        for pos, h in own:
            side.setdefault(h, pos)
    votes = Counter(first[1][h] - p for h, p in first[0].items() if h in first[1])
    best = max(votes.items(), key=lambda v: (v[1], -abs(v[0]), v[0]), default=(None, 0))
    return best


@pytest.mark.parametrize("cell_rows", [512, 4])
def test_syncmers(spark, odd, none, monkeypatch, cell_rows):
    monkeypatch.setattr(syncmers, "CELL_ROWS", cell_rows)
    monkeypatch.setattr(syncmers.with_next, "__defaults__", (cell_rows,))
    docs = [(r["doc_id"], r["text"] or "") for r in odd.collect()]
    seq = sorted(docs, key=lambda d: (d[0] is None, -(d[0] or 0), signed(text_hash(d[1]))))
    want = Counter()
    told = lambda marks: " ".join(f"{h:x}" for h in marks)
    for (i, t), (_, nxt) in zip(seq, seq[1:] + seq[:1], strict=True):
        h = len(t) // 2
        edited = t[: len(t) - h] + nxt[:h]
        own, changed, following = (plain_anchors(x) for x in (t, edited, nxt))
        a, b, c = (list(dict.fromkeys(h for _, h in x)) for x in (own, changed, following))
        want[i, len(t), hashlib.sha256(edited.encode()).hexdigest(), told(a), told(b), round(dice(a, b), 9), round(dice(a, c), 9), *plain_shift(own, changed)] += 1
    got = syncmers.fingerprint_report(odd).collect()
    assert Counter((*r[:5], round(r[5], 9), round(r[6], 9), *r[7:]) for r in got) == want
    assert syncmers.fingerprint_report(none).count() == 0
    assert syncmers.fingerprint_report(odd.where("doc_id = 5")).first()["near_next"] == 1.0


def test_anchor_choice(spark):
    rng = random.Random(9)
    words = prose(rng, 300).split()
    whole = spark.createDataFrame([(" ".join(words), "new " + " ".join(words))], "a string, b string")
    a, b = whole.select(syncmers.anchors(F.col("a"), True), syncmers.anchors(F.col("b"), True)).first()
    assert {(x["pos"] + 1, x["hash"]) for x in a} <= {(x["pos"], x["hash"]) for x in b}
    assert 0.35 < len(a) / 296 < 0.65
    best = whole.select(syncmers.best_shift(syncmers.anchors(F.col("a"), True), syncmers.anchors(F.col("b"), True)).alias("s")).first()["s"]
    assert best["shift"] == 1


def test_cells_are_even(spark):
    ids = spark.range(1500).selectExpr("if(id = 0, 4611686018427387904L, id) AS doc_id", "concat('w', id) AS text")
    alike = spark.range(700).selectExpr("cast(null AS long)", "concat('n', id)").union(spark.range(800).selectExpr("5L", "concat('f', id)"))
    rows, _ = syncmers.with_next(ids.union(alike), "doc_id", "text", 100)
    sizes = [r["count"] for r in rows.groupBy("_cell").count().collect()]
    assert len(sizes) == 30 and max(sizes) <= 101 and sum(sizes) == 3030


# 7 Decontamination
def plain_contamination(docs, items):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = lambda t: word.findall((t or "").translate({i: i + 32 for i in range(65, 91)}))
    out = Counter()
    for i, t in docs:
        w, hit, own = low(t), set(), set()
        for item, text in items:
            b = low(text)
            k = min(10, len(b))
            for s in range(len(b) - k + 1 if k else 0):
                for p in range(len(w) - k + 1):
                    if w[p : p + k] == b[s : s + k]:
                        hit.update(range(p, p + k))
                        own.add(str(item))
        out[i, len(w), len(hit), len(own), hashlib.sha256(",".join(sorted(own)).encode()).hexdigest(), bool(hit)] += 1
    return out


@pytest.mark.parametrize("max_pairs", [1 << 20, 12])
def test_contamination(spark, odd, none, max_pairs):
    src = {r["doc_id"]: r["text"] for r in odd.where("doc_id is not null").collect()}
    longest = max((t for t in src.values() if t and len(t) < 2000), key=len)
    items = [(1, longest.split(" ", 3)[3].upper()[:150]), (12, "Two, words!"), (2, ""), (3, None), (4, "never " * 12), (5, longest[-90:]), (6, longest[-90:])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = odd.where("length(text) < 5000 or text is null")
    want = plain_contamination([(r["doc_id"], r["text"]) for r in docs.collect()], items)
    got = decontam.contamination(docs, bench, max_pairs=max_pairs)
    assert Counter(map(tuple, got.collect())) == want and sum(k[5] for k in want) >= 2
    kept = decontam.decontaminate(docs, bench, max_pairs=max_pairs)
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(i for k, n in want.items() if not k[5] for i in [k[0]] * n)
    cut = decontam.decontaminate(docs, bench, "spans", max_pairs=max_pairs)
    assert cut.columns == docs.columns and cut.count() == docs.count()
    assert decontam.contamination(cut, bench).where("n_hit > 0 and n_words > 30").count() == 0
    assert decontam.contamination(none, bench).count() == 0
    assert decontam.contamination(docs, bench.limit(0)).where("contaminated").count() == 0


# 8 Chat
def test_tool_calls(spark):
    call = lambda *c: json.dumps({"tool_calls": list(c)})
    a = {"id": "a", "name": "search", "arguments": {"query": "x", "limit": 3.0}}
    b = {"id": "b", "name": "search", "arguments": {"query": {"$ref": "a"}}}
    rows = [
        (1, 0, "user", "hi"), (1, 3, "assistant", call(a)), (1, 2, "tool", json.dumps({"tool_call_id": "a", "content": "r"})), (1, 1, "assistant", call(b)),
        (1, 5, "tool", json.dumps({"tool_call_id": "zz"})), (1, 6, "assistant", call({"id": "c", "name": "nope", "arguments": {}})), (1, 7, "assistant", call(a)),
        (2, 0, "assistant", call({"id": "p", "name": "calculate", "arguments": {"expression": {"$ref": "q"}}}, {"id": "q", "name": "calculate", "arguments": {"expression": "1"}, "depends_on": ["p"]})),
        (3, 0, None, None), (3, 1, "assistant", "{broken"), (None, None, "tool", json.dumps({"tool_call_id": "a"})), (3, 2, "assistant", call({"id": "d", "name": "calculate", "arguments": "{\"expression\": \"2\"}"})),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = chat.link(df, queries.TOOLS).collect()
    status = {(r["conv_id"], r["turn"], r["place"]): r["status"] for r in got if r["kind"] != "message"}
    assert status[1, 3, 0] == "linked" and status[1, 2, 0] == "linked" and status[1, 1, 0] == "invalid" and status[1, 5, 0] == "orphan"
    assert status[1, 6, 0] == "invalid" and status[1, 7, 0] == "repeated" and status[2, 0, 0] == "cycle" and status[2, 0, 1] == "cycle"
    assert status[None, None, 0] == "orphan" and status[3, 2, 0] == "unanswered"
    assert len(got) == len(rows) + 1
    one = sorted((r for r in got if r["conv_id"] == 1), key=lambda r: (r["ready"], r["depth"], r["turn"], r["place"]))
    names = [(r["kind"], r["call_id"]) for r in one]
    assert names.index(("call", "a")) < names.index(("result", "a")) < names.index(("call", "b"))
    assert any(r["json"] == '{"arguments":{"limit":3,"query":"x"},"id":"a","name":"search","role":"assistant"}' for r in got)
    assert chat.schema_error({"query": "x", "limit": 0}, queries.TOOLS["search"]) == "$.limit: out of bounds"
    assert chat.link(df.limit(0)).count() == 0


# 9 Toxicity
def toxic_corpus(rng, n):
    bad = ["zorgle", "blatch", "grunkel"]
    out = []
    for i in range(n):
        words, label = prose(rng, rng.randint(5, 60)).split(), int(i % 5 == 0)
        for _ in range(rng.randint(1, 4) if label else 0):
            words.insert(rng.randrange(len(words) + 1), rng.choice(bad) + rng.choice(["", "s", "ing", "ish"]))
        out.append((i, " ".join(words), label))
    return out


def test_marginals():
    model = toxicity.Model({"=bad": 3.0, "=meh": 0.5}, -2.0, np.array([[0.2, -1.0], [-0.5, 0.7]]), np.array([0.1, -0.4]))
    words = [b"a", b"bad", b"b", b"c", b"meh", b"bad", b"d"]
    tagger = toxicity.Tagger(model)
    score = {}
    for code in range(2 ** len(words)):
        y = [code >> i & 1 for i in range(len(words))]
        s = model.start[y[0]] + sum(model.trans[p, q] for p, q in zip(y, y[1:], strict=False))
        score[code] = math.exp(s + sum(model.bias + (tagger.emission(w) or 0) for w, k in zip(words, y, strict=True) if k))
    total = sum(score.values())
    got = tagger.marginals(tagger.active(words), len(words))
    assert got == pytest.approx([sum(v for c, v in score.items() if c >> i & 1) / total for i in (1, 4, 5)])


def test_toxicity(spark, odd, none):
    data = toxic_corpus(random.Random(6), 600)
    docs = spark.createDataFrame([(i, t) for i, t, _ in data], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in data] + [(None, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in toxicity.predictions(docs, labels).collect()}
    held = [i for i, _, _ in data if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sorted(i for i, r in got.items() if r["held_out"]) == held
    assert np.mean([got[i]["predicted"] == data[i][2] for i in held]) > 0.97
    assert all((r["score"] >= 0.5) == (r["predicted"] == 1) and 0 <= r["score"] <= 1 for r in got.values())
    model = toxicity.train(docs, labels)
    spans = toxicity.score(docs, model).where("doc_id = 0").first()
    assert spans["_tox"]["spans"] and all(spans["text"][s["lo"] : s["hi"]][:3] in ("zor", "bla", "gru") for s in spans["_tox"]["spans"])
    kept = toxicity.drop_toxic(odd, labels)
    assert kept.columns == odd.columns and kept.count() == odd.count()
    assert toxicity.predictions(none, labels).count() == 0
    assert toxicity.predictions(odd, labels.limit(0)).where("predicted = 1").count() == 0


# 10 LM
def lm_counts(tokens, parts, least):
    """Counts of words, pairs and triples in documents of at least a part; starts are counted as one context."""
    out = [Counter(), Counter(), Counter()]
    for w, part in zip(tokens, parts, strict=True):
        if part >= least:
            out[0].update(["<s>", *w])
            out[1].update(zip(["<s>", *w], w, strict=False))
            out[2].update(zip(["<s>", "<s>", *w], ["<s>", *w], w, strict=False))
    return out


def lm_estimates(w, counts, n, v):
    """Bucket and the four estimates of each token."""
    one, two, three = counts
    bucket, told = [], []
    for u, a, b in zip(["<s>", "<s>", *w], ["<s>", *w], w, strict=False):
        context = one["<s>"] if u == a == "<s>" and not told else two[u, a]
        bucket.append((lm.BUCKETS if context else 0) + min((context or one[a]).bit_length(), lm.BUCKETS - 1))
        told.append([three[u, a, b] / context if context else 0, two[a, b] / one[a] if one[a] else 0, one[b] / n, (one[b] + 0.5) / (n + 0.5 * (v + 1))])
    return np.array(bucket), np.array(told).T


def test_lm(spark, odd, none, monkeypatch):
    rows = [(r["doc_id"], r["text"] or "") for r in odd.collect()]
    tokens = [re.findall(r"[^\x20\x09-\x0D]+", t.translate({k: k + 32 for k in range(65, 91)})) + [""] for _, t in rows]
    rest = [None if i is None else zlib.crc32(str(i).encode()) % 5 for i, _ in rows]
    parts = [{1: 0, 0: 2}.get(r, 1) for r in rest]
    every, deleted = lm_counts(tokens, parts, 1), lm_counts(tokens, parts, 2)
    core = [a - b for a, b in zip(every, deleted, strict=True)]
    size = lambda c: (sum(c[0].values()) - c[0]["<s>"], sum(k > 0 for w, k in c[0].items() if w != "<s>"))
    (n, v), (core_n, core_v) = size(every), size(core)
    held = [lm_estimates(w, core, core_n, core_v) for w, p in zip(tokens, parts, strict=True) if p == 2]
    bucket, told = np.concatenate([b for b, _ in held]), np.concatenate([t for _, t in held], axis=1)
    cells, times = np.unique(lm.cells_of(bucket, told), return_counts=True)
    weights = lm.expectation_maximisation(cells, times.astype(float))
    exact = lm.mixed(bucket, told.T, np.ones(len(bucket)))
    want, close = Counter(), []
    for (i, _), w, r in zip(rows, tokens, rest, strict=True):
        b, p = lm_estimates(w, every, n, v)
        score, near = (float(np.log10((x[b].T * p).sum(0)).sum()) for x in (weights, exact))
        close.append(abs(score - near) / len(w))
        want[i, r == 1, len(w), sum(every[0][a] > 0 for a in w), n, round(float(np.log10(p[3]).sum()), 6), round(score, 6)] += 1
    got = lm.lm_scores(odd, ranges=5)
    assert Counter((*r[:5], round(r["base_score"], 6), round(r["score"], 6)) for r in got.collect()) == want
    assert max(close) < 0.05  # what the quantised ratios cost, in digits a token
    assert lm.lm_scores(none).count() == 0
    monkeypatch.setattr(lm, "CHUNK_TOKENS", 300)
    again = Counter((r["doc_id"], round(r["score"], 6)) for r in lm.lm_scores(odd.repartition(7), ranges=2).collect())
    assert again == Counter({(k[0], k[6]): 0 for k in want}) + Counter(x for k, c in want.items() for x in [(k[0], k[6])] * c)


def test_expectation_maximisation():
    no = -lm.SPAN * lm.GRID

    def cell(bucket, *ratios):
        for r in ratios:
            bucket = bucket * lm.SIDE + r + lm.SPAN * lm.GRID
        return bucket

    w = lm.expectation_maximisation(np.array([cell(3, no, 40, 0), cell(3, no, no, 4), cell(0, no, no, 0), cell(lm.BUCKETS + 2, 60, 8, 0)]), np.array([90.0, 10.0, 5.0, 50.0]))
    assert w[3, 1] > 0.8 and w[3, 0] == 0 and w[0, 1] == 0 and np.allclose(w.sum(1), 1) and np.allclose(w[5], w[3])
    assert w[lm.BUCKETS + 2, 0] > 0.8 and np.allclose(w[lm.BUCKETS + 4], w[lm.BUCKETS + 2])


def test_registered(spark):
    assert [int(re.match(r"op(\d+)_", k)[1]) for k in queries.queries()] == list(range(1, 11))
    assert set(queries.oracle_sql()) <= set(queries.queries())
    assert pd is not None


def test_keep_one_repeated_ids_and_clashing_columns(spark):
    rng = random.Random(5)
    a, b, c = (prose(rng, 60) for _ in range(3))
    rows = [(3, a), (5, b), (5, a), (5, b), (7, b), (8, c), (None, c), (9, None), (10, "")]
    docs = spark.createDataFrame([(i, t, "x", 1, 2, 3) for i, t in rows], "doc_id long, text string, _kept string, _fp int, _tox int, _clean int")
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=repr) == sorted([(3, a), (5, b), (8, c), (None, c), (9, None)], key=repr)
    once = simhash.keep_one(docs.where("doc_id in (7, 8, 9, 10)"))
    assert sorted(r["doc_id"] for r in once.collect()) == [7, 8, 9]
    labels = spark.createDataFrame([(3, 1, 0)], "doc_id long, quality int, toxic int")
    for out in (secrets.redact(docs), toxicity.drop_toxic(docs, labels)):
        assert [tuple(r)[2:] for r in out.collect()] == [("x", 1, 2, 3)] * len(rows)
