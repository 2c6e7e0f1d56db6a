"""Toxic spans by a linear-chain conditional random field.

Two states, clean and toxic. A token's features are its word and its prefixes and suffixes of 3 to 6 characters, kept
where labelled documents tie them to toxicity; tokens with none are neutral and carry the bias alone. Training is by
gradient ascent on forward-backward expectations over the windows of the labelled documents; all windows of all sampled
texts count. It starts from token labels that are guessed (in a toxic document each token with a kept feature is toxic,
everything else is clean) and then learns them: token labels are latent, and what is maximised is the likelihood of the
document labels, that a toxic document has a toxic token and a clean one has none. Scoring is exact and sparse: runs of neutral tokens are powers of one 2 x 2 matrix, so forward-backward
steps only on tokens that carry a feature. Marginals add up to a document score, calibrated on the labelled sample, and
give the offending code-point spans.

The model is fitted in one task from at most ``SAMPLE_DOCS`` labelled rows (the smallest hashes of their ids), whole
texts; it has at most ``MAX_FEATURES`` features, so what is broadcast is bounded.
"""

from __future__ import annotations

import math
import pickle
import re
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.decontam import normal_words
from lexmill.llm.runtime import bound_batches, crc_mod, unused

SAMPLE_DOCS, MAX_FEATURES, AFFIX = 6_000, 20_000, range(3, 7)
#: Labelled rows whose crc32 of the id modulo FOLDS is this are held out.
FOLDS, HELD = 5, 0
_SPANS = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_MEMO = 400_000
WINDOW = 24
#: Windows whose forward-backward arrays are in memory at once.
_CHUNK = 4_096
_NONE: list = []


def features_of(word: bytes) -> list[str]:
    w = word.decode("utf-8", "replace")
    return [f"={w}", *(f"^{w[:k]}" for k in AFFIX if len(w) > k), *(f"${w[-k:]}" for k in AFFIX if len(w) > k)]


@dataclass
class Model:
    """Weights: a feature's is the toxic state's log-odds beside the bias; trans[i, j] scores a step from i to j."""

    weights: dict[str, float] = field(default_factory=dict)
    bias: float = -4.0
    trans: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    start: np.ndarray = field(default_factory=lambda: np.zeros(2))
    slope: float = 1.0
    shift: float = 0.0
    prior: float = 0.0


class Tagger:
    def __init__(self, model: Model):
        self.m, self.memo = model, {}
        self.pows: dict[int, np.ndarray] = {}
        self.whole = {f[1:]: x for f, x in model.weights.items() if f[0] == "="}
        self.heads, self.tails = (
            [(k, t) for k in AFFIX if (t := {f[1:]: x for f, x in model.weights.items() if f[0] == sign and len(f) == k + 1})] for sign in "^$"
        )
        self.step = np.exp(model.trans) * np.exp(np.array([0.0, model.bias]))[None, :]

    def emission(self, word: bytes) -> float | None:
        w, found, total = word.decode("utf-8", "replace"), False, 0.0
        n = len(w)
        if (x := self.whole.get(w)) is not None:
            found, total = True, x
        for k, table in self.heads:
            if n > k and (x := table.get(w[:k])) is not None:
                found, total = True, total + x
        for k, table in self.tails:
            if n > k and (x := table.get(w[-k:])) is not None:
                found, total = True, total + x
        return total if found else None

    def active(self, words: list[bytes]) -> list[tuple[int, float]]:
        """Positions that carry a feature, with the sum of its weights."""
        memo = self.memo
        if len(memo) > _MEMO:
            memo.clear()
        for w in set(words).difference(memo):
            memo[w] = self.emission(w)
        return [(i, e) for i, w in enumerate(words) if (e := memo[w]) is not None]

    def _gap(self, k: int) -> np.ndarray:
        """k neutral steps, scaled to a largest entry of 1."""
        if k not in self.pows:
            out, base, left = np.eye(2), self.step, k
            while left:
                if left & 1:
                    out = out @ base
                    out /= out.max()
                base = base @ base
                base = base / base.max()
                left >>= 1
            if len(self.pows) > 50_000:
                self.pows.clear()
            self.pows[k] = out
        return self.pows[k]

    def marginals(self, active: list[tuple[int, float]], n: int) -> list[float]:
        """P(toxic) of each active token of n tokens."""
        m, tokens = self.m, []
        at, state = -1, None
        for i, e in active:
            emit = np.exp(np.array([0.0, m.bias + e]))
            if state is None:
                first = np.exp(m.start)
                if i == 0:
                    state = first * emit
                else:
                    state = ((first * np.exp(np.array([0.0, m.bias]))) @ self._gap(i - 1)) @ np.exp(m.trans) * emit
            else:
                state = (state @ self._gap(i - at - 1)) @ np.exp(m.trans) * emit
            state = state / state.sum()
            tokens.append((i, emit, state))
            at = i
        out, back = [], None
        for j in range(len(tokens) - 1, -1, -1):
            i, _, forward = tokens[j]
            if back is None:
                back = self._gap(n - 1 - i) @ np.ones(2)
            else:
                following, emit, _ = tokens[j + 1]
                back = self._gap(following - i - 1) @ (np.exp(m.trans) @ (emit * back))
            back = back / back.sum()
            both = forward * back
            out.append(float(both[1] / both.sum()))
        return out[::-1]

    def score(self, words: list[bytes]) -> tuple[float, list[tuple[int, float]]]:
        active = self.active(words)
        marginals = self.marginals(active, len(words)) if active else []
        return self.calibrated(evidence(marginals)), [(i, p) for (i, _), p in zip(active, marginals, strict=True)]

    def calibrated(self, x: float) -> float:
        return 1 / (1 + math.exp(-min(50.0, max(-50.0, self.m.slope * x + self.m.shift))))


def evidence(marginals: list[float]) -> float:
    """Log-odds that some token is toxic, as if tokens were independent given the text; bounded."""
    none = sum(math.log1p(-min(p, 1 - 1e-6)) for p in marginals)
    some = -math.expm1(none)
    return max(-6.0, min(6.0, math.log(some + 1e-3) - none))


def _kept_features(docs: list[tuple[list[bytes], int]]) -> set[str]:
    """Features that clean documents nearly never have and that a chance draw of documents would not tie to the label.

    A feature of a documents, t of them toxic, stays if t >= 0.95 a and a draw of t toxic ones at the base rate is rarer
    than 1 in 50 over all features. As many different neighbours are asked for, so that copies of one toxic document do
    not make its other words count. The most frequent ones come first where there are more than MAX_FEATURES.
    """
    n_toxic = sum(label for _, label in docs)
    if not n_toxic or n_toxic == len(docs):
        return set()
    toxic: Counter[str] = Counter()
    places: dict[bytes, set[int]] = {}
    for words, label in docs:
        if label:
            toxic.update({f for w in set(words) for f in features_of(w)})
            for before, w, after in zip([b"", *words], words, [*words[1:], b""], strict=False):
                places.setdefault(w, set()).add(hash((before, after)))
    need = math.log(50 * max(1, len(toxic))) / -math.log(n_toxic / len(docs))
    toxic = Counter({f: t for f, t in toxic.items() if t >= need})
    spread: Counter[str] = Counter()
    for w, own in places.items():
        for f in features_of(w):
            if f in toxic:
                spread[f] += len(own)
    del places
    frequent = {f for f in toxic if spread[f] >= need}
    clean: Counter[str] = Counter()
    cache: dict[bytes, list[str]] = {}
    for words, label in docs:
        if not label:
            own = set(words)
            for w in own.difference(cache):
                cache[w] = [f for f in features_of(w) if f in frequent] or _NONE
            clean.update({f for w in own for f in cache[w]})
    kept = [(t, f) for f in frequent if (t := toxic[f]) >= 0.95 * (t + clean[f])]
    return {f for _, f in sorted(kept, key=lambda x: (-x[0], x[1]))[:MAX_FEATURES]}


def fit(docs: list[tuple[list[bytes], int]], rounds: int = 60, ridge: float = 1e-3) -> Model:
    """docs: words and label of each labelled document."""
    model = Model(trans=np.array([[0.0, -1.0], [0.0, 0.0]]))
    total = max(1, len(docs))
    model.prior = (sum(label for _, label in docs) + 0.5) / (total + 1)
    kept = _kept_features(docs)
    names = sorted(kept)
    index = {f: i for i, f in enumerate(names)}
    memo: dict[bytes, list[int]] = {}

    def ids(w: bytes) -> list[int]:
        if w not in memo:
            memo[w] = [index[f] for f in features_of(w) if f in index] or _NONE
        return memo[w]

    cells, gold, length, of = array("q"), array("b"), array("q"), array("q")  # window, place and feature in turn; WINDOW states a window
    plain: Counter[tuple[int, int]] = Counter()  # a document's windows without a kept feature are alike but for their length
    for d, (words, label) in enumerate(docs):
        for s in range(0, len(words), WINDOW):
            part = [ids(w) for w in words[s : s + WINDOW]]
            if not any(part):
                plain[d, len(part)] += 1
                continue
            at = len(length)
            for p, own in enumerate(part):
                for f in own:
                    cells.extend((at, p, f))
            gold.extend([label if own else 0 for own in part] + [0] * (WINDOW - len(part)))
            length.append(len(part))
            of.append(d)
    if length:
        held = _Windows(
            np.frombuffer(cells, dtype=np.int64).reshape(-1, 3), np.frombuffer(gold, dtype=np.int8).reshape(-1, WINDOW), np.array(length), np.array(of),
            np.array([(*k, n) for k, n in plain.items()], dtype=np.int64).reshape(-1, 3), np.array([label for _, label in docs]),
        )
        _ascend(model, held, names, rounds, ridge)
    tagger = Tagger(model)
    xs = np.array([evidence([p for _, p in tagger.score(words)[1]]) for words, _ in docs] or [0.0])
    _calibrate(model, xs, np.array([label for _, label in docs] or [0]))
    return model


@dataclass
class _Windows:
    """cells: (window, place, feature), in the order of windows; of: a window's document; plain: (document, length, how many)."""

    cells: np.ndarray
    gold: np.ndarray
    length: np.ndarray
    of: np.ndarray
    plain: np.ndarray
    labels: np.ndarray

    def parts(self) -> Iterator[tuple[slice, np.ndarray]]:
        """Windows and their cells, ``_CHUNK`` windows at once."""
        cuts = [*range(0, len(self.gold), _CHUNK), len(self.gold)]
        places = np.searchsorted(self.cells[:, 0], cuts)
        for lo, hi, first, last in zip(cuts, cuts[1:], places, places[1:], strict=False):
            yield slice(lo, hi), self.cells[first:last] - np.array([lo, 0, 0])


_NO_CELLS = np.empty((0, 3), dtype=np.int64)


def _ascend(model: Model, held: _Windows, names: list[str], rounds: int, ridge: float) -> None:
    """``rounds`` steps towards the guessed token labels, then half as many towards the document labels."""
    weights, params = np.zeros(len(names)), np.array([-3.0, 0.0, -1.0, 0.0, 0.5, 0.0, -1.0])  # bias, trans (4), start (2)
    counts = np.bincount(held.cells[:, 2], minlength=len(names))
    lengths = np.arange(1, WINDOW + 1)
    blank = np.zeros((WINDOW, WINDOW), dtype=np.int8)  # one window of each length, without features

    def gradient(gold: np.ndarray, by_window: np.ndarray, by_length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        grad, grad_p = _gradient(weights, params, _NO_CELLS, blank, lengths, by_length)
        for rows, part in held.parts():
            more, more_p = _gradient(weights, params, part, gold[rows], held.length[rows], by_window[rows])
            grad, grad_p = grad + more, grad_p + more_p
        return grad, grad_p

    size = len(held.length) + held.plain[:, 2].sum()
    by_length = np.bincount(held.plain[:, 1] - 1, weights=held.plain[:, 2], minlength=WINDOW)
    none = np.zeros_like(held.gold)
    for stage, steps, pace in (("guessed", rounds, 1.0), ("latent", rounds // 2, 0.25)):
        square, square_p = np.full(len(names), 1e-8), np.full(7, 1e-8)
        for _ in range(steps):
            if stage == "guessed":
                grad, grad_p = gradient(held.gold, np.ones(len(held.length)), by_length)
            else:
                push = _push(weights, params, held)
                grad, grad_p = gradient(none, -push[held.of], np.bincount(held.plain[:, 1] - 1, weights=-push[held.plain[:, 0]] * held.plain[:, 2], minlength=WINDOW))
            grad = grad / np.maximum(counts, 1) - ridge * weights
            grad_p = grad_p / size - ridge * params
            square, square_p = 0.9 * square + 0.1 * grad**2, 0.9 * square_p + 0.1 * grad_p**2
            weights += pace * 0.2 * grad / np.sqrt(square + 1e-6)
            params += pace * 0.1 * grad_p / np.sqrt(square_p + 1e-6)
    model.weights = {f: float(x) for f, x in zip(names, weights, strict=True)}
    model.bias, model.trans, model.start = float(params[0]), params[1:5].reshape(2, 2), params[5:]


def _push(weights: np.ndarray, params: np.ndarray, held: _Windows, most: float = 20.0) -> np.ndarray:
    """How much each document's label asks for more toxic tokens: P0 / (1 - P0) of a toxic one, -1 of a clean one.

    P0 is the chance that all its tokens are clean; these are the factors by which the expected features, less those of
    an all-clean text, enter the gradient of the document labels' likelihood. ``most`` bounds a step.
    """
    clean = np.bincount(held.plain[:, 0], weights=held.plain[:, 2] * _log_clean(weights, params, _NO_CELLS, np.arange(1, WINDOW + 1))[held.plain[:, 1] - 1], minlength=len(held.labels))
    for rows, part in held.parts():
        clean += np.bincount(held.of[rows], weights=_log_clean(weights, params, part, held.length[rows]), minlength=len(held.labels))
    odds = np.minimum(most, np.exp(clean) / np.maximum(-np.expm1(np.minimum(clean, -1e-9)), 1e-9))
    return np.where(held.labels > 0, odds, -1.0)


def _emissions(weights: np.ndarray, params: np.ndarray, cells: np.ndarray, n: int, w: int) -> np.ndarray:
    raw = np.bincount(cells[:, 0] * w + cells[:, 1], weights=weights[cells[:, 2]], minlength=n * w).reshape(n, w)
    emit = np.ones((n, w, 2))
    emit[:, :, 1] = np.exp(np.clip(raw + params[0], -30, 30))
    return emit


def _log_clean(weights: np.ndarray, params: np.ndarray, cells: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Log chance that all tokens of a window are clean."""
    n, trans, start = len(length), np.exp(params[1:5].reshape(2, 2)), np.exp(params[5:])
    emit = _emissions(weights, params, cells, n, WINDOW)
    state = start * emit[:, 0]
    total = np.log(state.sum(1))
    state /= state.sum(1, keepdims=True)
    for i in range(1, WINDOW):
        step = (state @ trans) * emit[:, i]
        size = step.sum(1)
        live = i < length
        total += np.where(live, np.log(size), 0.0)
        state = np.where(live[:, None], step / size[:, None], state)
    return params[5] + (length - 1) * params[1] - total


def _gradient(weights: np.ndarray, params: np.ndarray, cells: np.ndarray, gold: np.ndarray, length: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the gradient over windows, for the weights and for bias, trans and start."""
    n, w = gold.shape
    live = np.arange(w)[None, :] < length[:, None]
    pair = live[:, 1:] * times[:, None]
    gold_pairs = np.array([[((gold[:, :-1] == a) & (gold[:, 1:] == b)) * pair for b in (0, 1)] for a in (0, 1)]).sum((2, 3))
    gold_start = np.array([((gold[:, 0] == s) * times).sum() for s in (0, 1)])
    trans, start = np.exp(params[1:5].reshape(2, 2)), np.exp(params[5:])
    emit = _emissions(weights, params, cells, n, w)
    fwd, back = np.zeros((n, w, 2)), np.ones((n, w, 2))
    fwd[:, 0] = start * emit[:, 0]
    fwd[:, 0] /= fwd[:, 0].sum(1, keepdims=True)
    for i in range(1, w):
        step = (fwd[:, i - 1] @ trans) * emit[:, i]
        fwd[:, i] = np.where(live[:, i, None], step / step.sum(1, keepdims=True), fwd[:, i - 1])
    pairs = np.zeros((2, 2))
    for i in range(w - 2, -1, -1):
        step = (emit[:, i + 1] * back[:, i + 1]) @ trans.T
        back[:, i] = np.where(live[:, i + 1, None], step / step.sum(1, keepdims=True), 1.0)
        joint = fwd[:, i, :, None] * trans[None] * (emit[:, i + 1] * back[:, i + 1])[:, None, :]
        pairs += (joint / joint.sum((1, 2), keepdims=True) * pair[:, i, None, None]).sum(0)
    marginal = fwd * back
    marginal /= marginal.sum(2, keepdims=True)
    miss = gold * live - np.where(live, marginal[:, :, 1], 0.0)
    miss = miss * times[:, None]
    grad = np.bincount(cells[:, 2], weights=miss[cells[:, 0], cells[:, 1]], minlength=len(weights))
    return grad, np.r_[miss.sum(), (gold_pairs - pairs).ravel(), gold_start - (marginal[:, 0] * times[:, None]).sum(0)]


def _calibrate(model: Model, x: np.ndarray, y: np.ndarray) -> None:
    """Logistic map from evidence to the chance of label 1, by Newton steps with a weak pull to slope 1."""
    a, b = 1.0, math.log(model.prior / (1 - model.prior))
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -40, 40)))
        g = np.array([((y - p) * x).sum() - (a - 1), (y - p).sum() - 0.01 * b])
        s = p * (1 - p)
        h = np.array([[(s * x * x).sum() + 1, (s * x).sum()], [(s * x).sum(), s.sum() + 0.01]])
        move = np.linalg.solve(h, g)
        a, b = a + float(np.clip(move[0], -1, 1)), b + float(np.clip(move[1], -1, 1))
    model.slope, model.shift = max(a, 0.05), b


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE_DOCS) -> Model:
    """Fits the model on labelled rows outside the held-out fold, at most ``sample`` of them.

    The sample is the labelled ids with the smallest hashes. Labels without an id or a value are ignored; of repeated
    labels of an id the largest counts, of repeated texts the one with the smallest hash. The fit takes its rows in the
    order of the ids' hashes, so the model does not depend on how the tables are partitioned. No labelled rows give a
    model that finds nothing.
    """
    usable = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & (crc_mod(F.col(id_col), FOLDS) != HELD))
    one = usable.groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).alias("_label")).orderBy(F.xxhash64("_id"), "_id").limit(sample)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = texts.join(F.broadcast(one), F.col("id") == F.col("_id")).groupBy(F.xxhash64("_id").alias("rank"), F.col("id").cast("string").alias("id"), (F.col("_label") > 0).cast("int").alias("label"))
    chosen = rows.agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    bound_batches(docs.sparkSession)
    told = chosen.repartition(1).sortWithinPartitions("rank", "id").mapInPandas(_fit_task, "model binary").collect()  # one row, bounded by MAX_FEATURES
    return pickle.loads(told[0]["model"]) if told else fit([])


def _fit_task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Fits on the sample in one task, so that its words never reach the driver."""
    once: dict[bytes, bytes] = {}  # one object a distinct word keeps the sample small
    docs = [([once.setdefault(w, w) for w in normal_words(t)], int(y)) for b in batches for t, y in zip(b["text"], b["label"], strict=True)]
    yield pd.DataFrame({"model": [pickle.dumps(fit(docs))]})


def score(docs: DataFrame, model: Model, text_col: str = "text", out: str = "_tox") -> DataFrame:
    """``docs`` and a column ``out``: struct(score, spans of (lo, hi, marginal)), marginals of at least one half.

    Null and empty texts have no spans and get the score of a text without evidence. Rows stay as they come.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("score double, spans array<struct<lo:int,hi:int,marginal:double>>")
    def tag(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        tagger = Tagger(shared.value)
        for texts in batches:
            rows = []
            for x in texts:
                value, tagged = tagger.score(normal_words(x))
                spans = []
                if any(p >= 0.5 for _, p in tagged):
                    bounds = [s.span() for s in _SPANS.finditer(x)]
                    spans = [{"lo": bounds[i][0], "hi": bounds[i][1], "marginal": p} for i, p in tagged if p >= 0.5]
                rows.append((value, spans))
            yield pd.DataFrame(rows, columns=["score", "spans"])

    return docs.withColumn(out, tag(F.col(text_col)))


def predictions(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, score, predicted) of each row; a null id is never held out."""
    scored = score(docs.select(id_col, text_col), train(docs, labels, id_col, text_col), text_col)
    held = F.coalesce(crc_mod(F.col(id_col), FOLDS) == HELD, F.lit(False))
    return scored.select(id_col, held.alias("held_out"), F.col("_tox.score").alias("score"), (F.col("_tox.score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that score under one half, as they are."""
    out = unused(docs, "_tox")
    return score(docs, train(docs, labels, id_col, text_col), text_col, out).where(F.col(out)["score"] < 0.5).select(*docs.columns)
