"""Operators against plain implementations where SQL has no equivalent."""

import json
import math
import random
import re
import string
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lexmill.llm import chat, queries, secrets, urls

from .conftest import prose, secret
from .test_llm import components, plain_spans


# Secrets
def upper(z):
    return 0.5 * math.erfc(z / math.sqrt(2))


def plain_battery(token):
    name, _, letters, stray = next(e for e in secrets.ENCODINGS if re.fullmatch(e[1], token))
    m, n, codes = len(letters), len(token), [letters.index(c) for c in token]
    counts = Counter(codes)
    chi = sum((counts[k] - n / m) ** 2 / (n / m) for k in range(m))
    above = [c >= m / 2 for c in codes]
    high, low = sum(above), n - sum(above)
    turns = 1 + sum(a != b for a, b in zip(above, above[1:], strict=False))
    mean, var = 2 * high * low / n + 1, 2 * high * low * (2 * high * low - n) / (n * n * (n - 1))
    serial = sum((a - (m - 1) / 2) * (b - (m - 1) / 2) for a, b in zip(codes, codes[1:], strict=False)) / (math.sqrt(n - 1) * (m * m - 1) / 12)
    p_runs = min(2.0, 2 * upper(abs(turns - mean) / math.sqrt(var))) if var > 0 else 0.0
    free = m - 1
    p_chi = upper(((chi / free) ** (1 / 3) - 1 + 2 / (9 * free)) / math.sqrt(2 / (9 * free)))
    rate, equal, pairs = (stray + 1) / m, sum(c * (c - 1) / 2 for c in counts.values()), n * (n - 1) / 2
    spread = math.sqrt(pairs * rate * (1 - rate) + n * (n - 1) * (n - 2) * secrets.TEXT_SPREAD * rate * rate)
    return name, n, p_chi, p_runs, 2 * upper(abs(serial)), min(1.0, 3 * min(p_chi, p_runs, 2 * upper(abs(serial)))), upper((pairs * rate - equal - 0.5) / spread)


def tokens(rng):
    alphabets = {"hex": "0123456789abcdef", "low": string.ascii_lowercase, "b32": string.ascii_uppercase + "234567", "b62": string.ascii_letters + string.digits, "b64": string.ascii_letters + string.digits + "+/", "url": string.ascii_letters + string.digits + "-_"}
    return [secret(rng, rng.randint(20, 90), a) for a in alphabets.values() for _ in range(12)]


def worded(rng):
    """Names made of words: camel case, snake case, slugs, runs together."""
    words = [w for w in prose(rng, 12).split() if len(w) > 2][: rng.randint(5, 8)]
    way = rng.choice(["camel", "snake", "slug", "plain", "upper"])
    name = {"camel": "".join(w.title() for w in words), "snake": "_".join(words), "slug": "-".join(words), "plain": "".join(words), "upper": "".join(words).upper()}[way]
    return name if len(name) >= 20 else name + "andotherthingsthatwere"


def test_battery_against_plain(spark):
    rng = random.Random(1)
    given = [*tokens(rng), *(worded(rng) for _ in range(30)), "a" * 30, "ab" * 20, "0123456789abcdef" * 2, "x" * 20 + "-", secret(rng, 30_000, "0123456789abcdef")]
    got = spark.createDataFrame([(t,) for t in given], "t string").select("t", secrets.battery(F.col("t")).alias("b")).collect()
    for r in got:
        b = r["b"]
        want = plain_battery(r["t"])
        assert (b["encoding"], b["size"]) == want[:2]
        assert [b["chi"], b["runs"], b["serial"], b["p"], b["p_text"]] == pytest.approx(want[2:], rel=0.02, abs=2e-6), r["t"][:60]


def plain_report(texts):
    """(base, added) spans of each text by a plain run of the whole method."""
    runs = []
    for d, t in enumerate(texts):
        for m in re.finditer(secrets.RUN, t):
            name, n, *_, p, p_text = plain_battery(m[0].rstrip("="))
            runs.append((d, m.start(), m.end(), f"{name}/{int(math.log2(n))}", min(secrets.BINS, int(-math.log(p_text) * secrets.BINS_PER_E)) if p_text > 0 else secrets.BINS, p))
    by = defaultdict(list)
    for r in runs:
        by[r[3]].append(r[4])
    cut = {}
    for stratum, bins in by.items():
        for b in sorted(set(bins)):
            if math.exp(-b / secrets.BINS_PER_E) <= secrets.Q * sum(x >= b for x in bins) / len(bins):
                cut[stratum] = b
                break
    base = [plain_spans(t) for t in texts]
    added = [[] for _ in texts]
    for d, lo, hi, stratum, b, p in runs:
        if b >= cut.get(stratum, 10**6) and p >= secrets.ALPHA and not any(a < hi and lo < e for a, _, e in base[d]):
            added[d].append((lo, "random", hi))
    return base, added


def test_reports_against_plain(spark):
    rng = random.Random(5)
    texts = [" ".join([prose(rng, 5), *(f"{rng.choice(['', 'token=', '𠍀 '])}{x}" for x in rng.sample([*tokens(rng), *(worded(rng) for _ in range(40))], 4)), prose(rng, 3)]) for _ in range(60)] + ["", "x"]
    base, added = plain_report(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in secrets.secret_report(df).collect()}
    order = lambda s: (s[0], ("assign", "access", "hex", "random").index(s[1]))
    assert sum(map(len, added)) > 20
    for d in range(len(texts)):
        assert got[d] == ",".join(f"{k}:{a}:{b}" for a, k, b in sorted(base[d] + added[d], key=order)), texts[d]
    clean = {r["doc_id"]: r["text"] for r in secrets.redact(df).collect()}
    for d, t in enumerate(texts):
        want, at = [], 0
        for a, _, b in sorted(base[d] + added[d], key=order):
            want += [t[at:a], "[SECRET]"] if a >= at else []
            at = max(at, b)
        assert clean[d] == "".join([*want, t[at:]])


def test_false_reports_by_class():
    """Of reported tokens few are words, whatever their mix; random tokens of 40 characters and more are found."""
    for share in (0.02, 0.3):
        rng = random.Random(7)
        held = [(worded(rng), False) for _ in range(3000)] + [(secret(rng, rng.randint(40, 64), string.ascii_letters + string.digits), True) for _ in range(int(3000 * share))]
        _, added = plain_report([t for t, _ in held])
        told = [truth for (_, truth), own in zip(held, added, strict=True) if own]
        assert sum(not t for t in told) <= 0.1 * len(told) + 3
        assert sum(told) >= 0.9 * sum(t for _, t in held)


def test_many_spans_and_long_tokens(spark):
    many = "password=hunter22 " * 20_000
    long = secret(random.Random(3), 200_000)
    df = spark.createDataFrame([(0, many), (1, "see " + long + " there")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in secrets.secret_report(df).collect()}
    assert got[0]["n_assign"] == 20_000 and got[1]["spans"] == f"random:4:{4 + len(long)}"
    clean = {r["doc_id"]: r["text"] for r in secrets.redact(df).collect()}
    assert clean[0] == "[SECRET] " * 20_000 and clean[1] == "see [SECRET] there"


# URLs
def test_classes_of_random_links(spark):
    rng = random.Random(4)
    hosts = ["a.net", "b.com", "c.org", "example.net", "example.com", "d.io"]
    names = [f"http://{rng.choice(hosts)}/{rng.choice(['de/', 'en/', 'fr/', ''])}p{i}" for i in range(120)]
    links = [(i, rng.randrange(120)) for i in range(120) if rng.random() < 0.45]
    html = defaultdict(str)
    for a, b in links:
        html[a] += rng.choice(['<link rel="canonical" href="{}">', '<meta http-equiv="refresh" content="0; url={}">', '<meta property="og:url" content="{}">']).format(names[b])

    def ruled(url):
        host, _, path = url.split("://")[1].partition("/")
        fits = [(len(h) + len(p), v) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and ("/" + path).startswith(p)]
        return max(fits)[1] if fits else None

    comp = components(120, links)
    votes = defaultdict(set)
    for i, n in enumerate(names):
        votes[comp[i]].add(ruled(n))
    df = spark.createDataFrame([(i, n, html[i]) for i, n in enumerate(names)], "page_id long, url string, html string")
    got = {r["page_id"]: r["verdict"] for r in urls.filter_urls(df).collect()}
    want = {i: ruled(n) or ("block" if "block" in votes[comp[i]] and "allow" not in votes[comp[i]] else "allow") for i, n in enumerate(names)}
    assert got == want
    assert sum(want[i] == "block" and ruled(n) is None for i, n in enumerate(names)) > 3


# Tool calls
def plain_link(messages):
    """(conv, turn, place, kind, call_id) -> (status, ready, depth) by plain rounds."""
    calls, results, out = {}, defaultdict(list), {}
    events = [(conv, turn, e) for conv, turn, role, text in messages for e in chat.events_of(role, text, queries.TOOLS)]
    for conv, turn, e in sorted((x for x in events if x[2]["kind"] == "call" and x[2]["call_id"]), key=lambda x: (x[0], x[1], x[2]["place"], x[2]["json"])):
        calls.setdefault((conv, e["call_id"]), (turn, e))
    for conv, turn, e in events:
        if e["kind"] == "result":
            results[conv, e["call_id"]].append(turn)
    refs = {k: [(k[0], r) for r in set(e["refs"]) if (k[0], r) in calls] for k, (_, e) in calls.items()}
    level, ready = {}, {}
    moved = True
    while moved:
        moved = False
        for k, own in refs.items():
            if k not in level and all(r in level for r in own):
                level[k] = max((level[r] + 1 for r in own), default=0)
                ready[k] = max([calls[k][0], *(max([ready[r], *results[r]]) for r in own)])
                moved = True
    for conv, turn, e in events:
        k = conv, e["call_id"]
        if e["kind"] == "message":
            told = None, turn, 0
        elif e["kind"] == "result":
            told = ("linked" if k in calls else "orphan"), max(turn, ready.get(k, turn if k not in calls else calls[k][0])), 2 * level.get(k, 0) + 1
        else:
            first = k in calls and calls[k][0] == turn and calls[k][1] == e
            status = "invalid" if e["call_id"] is None else "repeated" if not first else "cycle" if k not in level else "invalid" if not e["valid"] else "linked" if results[k] else "unanswered"
            told = status, (max(turn, ready.get(k, calls[k][0])) if k in calls else turn), 2 * level.get(k, 0)
        out[conv, turn, e["place"], e["kind"], e["call_id"]] = told
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_links_of_random_conversations(spark, seed):
    rng, rows = random.Random(seed), []
    for conv in range(12):
        ids = [f"c{i}" for i in range(rng.randint(1, 14))]
        for turn, i in enumerate(rng.sample(ids, len(ids))):
            want = rng.sample(ids, min(len(ids), rng.choice([0, 0, 1, 1, 2]))) if rng.random() < 0.5 else [x for x in ids if int(x[1:]) < int(i[1:])][-rng.randint(1, 2) :]
            args = rng.choice([{"expression": "1"}, {"expression": {"$ref": want[0]}} if want else {"expression": "2"}, {"wrong": 1}])
            rows.append((conv, 2 * turn, "assistant", json.dumps({"tool_calls": [{"id": i, "name": rng.choice(["calculate", "calculate", "none"]), "arguments": args, "depends_on": want}]})))
            if rng.random() < 0.6:
                rows.append((conv, rng.randint(0, 40) * 2 + 1, "tool", json.dumps({"tool_call_id": rng.choice([i, i, "zz"]), "content": turn})))
        rows.append((conv, 100, "assistant", json.dumps({"tool_calls": [{"id": ids[0], "name": "calculate", "arguments": {"expression": "9"}}, {"name": "calculate"}]})))
        rows.append((conv, 101, "user", "hello"))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {(r["conv_id"], r["turn"], r["place"], r["kind"], r["call_id"]): (r["status"], r["ready"], r["depth"]) for r in chat.link(df, queries.TOOLS).collect()}
    assert got == plain_link(rows)


def test_numbers_and_texts_that_json_cannot_hold(spark):
    rows = [
        (1, 0, "tool", '{"tool_call_id":"a","content":NaN}'), (1, 1, "tool", '{"tool_call_id":"a","content":1e400}'), (1, 2, "tool", '{"tool_call_id":"a","content":"\\ud800"}'),
        (1, 3, "assistant", json.dumps({"tool_calls": [{"id": "b", "name": "calculate", "arguments": '{"expression": -Infinity}'}]})),
        (1, 4, "assistant", '{"tool_calls":[{"id":"c\\udc00","name":"calculate","arguments":{"expression":"1"}}]}'), (1, 5, "tool", '{"tool_call_id":"c\\udc00"}'),
        (1, 6, "assistant", '{"tool_calls":[{"id":"x","name":"calculate","arguments":{"a":' + "[" * 5000 + "]" * 5000 + "}}]}"), (1, 7, "tool", '{"tool_call_id":"a","content":1' + "0" * 5000 + "}"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["turn"]: r for r in chat.link(df, queries.TOOLS).collect()}
    assert [got[i]["kind"] for i in range(8)] == ["message", "message", "result", "call", "call", "result", "message", "message"]
    assert got[2]["json"] == '{"content":"\\ud800","role":"tool","tool_call_id":"a"}'
    assert got[3]["status"] == "invalid" and got[4]["status"] == "linked" and got[5]["status"] == "linked"
    assert all(json.loads(got[i]["json"]) is not None for i in got)
