"""Trigram scoring by deleted interpolation.

p(w | u v) = a3 c(u v w) / c(u v) + a2 c(v w) / c(v) + a1 c(w) / N + a0 q(w): the maximum-likelihood estimates of orders 3, 2
and 1 and the add-half base q(w) = (c(w) + 1/2) / (N + (V + 1) / 2), mixed with four weights for each bucket of the
context's frequency (powers of two of c(u v), or of c(v) where u v was never seen). The weights are learned by
expectation-maximisation on the counts of held-out training documents, whose estimates come from the remaining training
documents; final counts cover all training documents.

Counts are never gathered in one place. Texts are packed into chunks: a file of token numbers, and the sorted distinct
keys of the chunk's words (64 bits), word pairs and triples (60 bits). Keys travel as compressed differences by hash range;
each range sums its blocks and answers each block in the block's order, and a chunk is scored beside the file of its
answers. A frequent word costs one key a chunk, and only keys and counts are shuffled. Of n different pairs or triples one
in 2^60 / n shares its key with another, one in 100,000 for ten thousand billion of them.
Triples come after words and pairs: where one chunk has a pair alone, it has the triples with that pair alone too, and
their counts in the chunk are whole without a shuffle.
A chunk is named by its partition and place, so a task that runs again writes the same chunk. The expectation step reads a
histogram of quantised probability ratios whose size is bounded whatever the corpus.
"""

from __future__ import annotations

import itertools
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.runtime import bound_batches, crc_mod, input_bytes, materialise, scratch_path
from lexmill.llm.warc import Output, open_read

FOLDS, HELD_OUT, DELETED = 5, 1, 0
#: Tokens of a chunk; bounds a Python worker's memory.
CHUNK_TOKENS = 800_000
#: Input bytes for each hash range.
RANGE_BYTES = 8 << 20
#: Buckets of c(v), then as many of c(u v).
BUCKETS = 32
#: Steps a binary digit of the quantised ratios, and the ratios' bounds in digits.
GRID, SPAN = 4, 40
SIDE = 2 * SPAN * GRID + 1
#: Orders above 1 whose keys are made of a context and a word.
ORDERS = (2, 3)
KEY_BITS = 60
_END, _START = np.uint64(xxhash.xxh64_intdigest(b"", seed=1)), np.uint64(xxhash.xxh64_intdigest(b"", seed=2))
_BLOCK = "chunk string, range int, data binary"


def _pack(values: np.ndarray) -> bytes:
    """Bytes of equal significance together, compressed."""
    width = values.dtype.itemsize
    return zstandard.compress(np.ascontiguousarray(values.view(np.uint8).reshape(-1, width).T).tobytes(), 3)


def _unpack(data: bytes, kind: str) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(data), dtype=np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(raw.T).view(kind).ravel()


def _pack_sorted(keys: np.ndarray) -> bytes:
    return _pack(np.diff(keys, prepend=np.uint64(0)))


def _unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(_unpack(data, "<u8"), dtype=np.uint64)


def _join(parts: list[bytes]) -> bytes:
    return b"".join(len(x).to_bytes(8, "little") + x for x in parts)


def _key(context: np.ndarray, w: np.ndarray) -> np.ndarray:
    x = context * np.uint64(0x9E3779B97F4A7C15) + (w ^ (w >> np.uint64(31))) * np.uint64(0xC2B2AE3D27D4EB4F)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return (x ^ (x >> np.uint64(29))) >> np.uint64(64 - KEY_BITS)


def _bounds(ranges: int, bits: int) -> np.ndarray:
    return np.array([(i << bits) // ranges for i in range(ranges)], dtype=np.uint64)


def _fields(data: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(data):
        n = int.from_bytes(data[at : at + 8], "little")
        out.append(data[at + 8 : at + 8 + n])
        at += 8 + n
    return out


class _Tokens:
    """A chunk's tokens as ranks in the order of the words' hashes, and its documents (id, part, tokens).

    part: 0 held out, 1 training, 2 training and deleted.
    """

    def __init__(self, word: np.ndarray, hashes: np.ndarray, docs: pd.DataFrame):
        self.word, self.hashes, self.docs = word, hashes, docs
        n = docs["n"].to_numpy()
        self.stops = np.cumsum(n)
        self.starts = self.stops - n
        self.part = np.repeat(docs["part"].to_numpy(), n)
        self.start = int(np.searchsorted(hashes, _START))
        self.before = np.roll(word, 1)
        self.before[self.starts] = self.start
        # the sorted distinct keys of each order and the place of each token's among them
        self.keys, self.place = [], []
        context, own = hashes[self.before], hashes[word]
        for _ in ORDERS:
            told = _key(context, own)
            keys, place = np.unique(told, return_inverse=True)
            self.keys.append(keys)
            self.place.append(place.astype(np.int32))
            context = np.roll(told, 1)
            context[self.starts] = _START

    def counted(self, i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The keys of words (0), pairs (1) or triples (2) with their counts in training and in deleted documents."""
        keys, place = (self.hashes, self.word) if not i else (self.keys[i - 1], self.place[i - 1])
        counts = [np.bincount(place[self.part >= least], minlength=len(keys)).astype(np.int32) for least in (1, 2)]
        if not i:
            for least, held in enumerate(counts, 1):
                held[self.start] = (self.docs["part"].to_numpy() >= least).sum()
        return keys, *counts

    def blocks(self, ranges: int, orders: tuple[int, ...], wanted: np.ndarray | None = None) -> Iterator[tuple[int, bytes]]:
        """(range, keys of the orders with their counts), the wanted ones; the first range has a block at any rate."""
        held = [self.counted(i) for i in orders]
        if wanted is not None:
            held = [tuple(x[wanted] for x in columns) for columns in held]
        cuts = [np.r_[np.searchsorted(keys, _bounds(ranges, KEY_BITS if i else 64)), len(keys)] for i, (keys, *_) in zip(orders, held, strict=True)]
        for r in range(ranges):
            if not r or any(c[r + 1] > c[r] for c in cuts):
                yield r, _join([x for (keys, *counts), c in zip(held, cuts, strict=True) for x in (_pack_sorted(keys[c[r] : c[r + 1]]), *(_pack(n[c[r] : c[r + 1]]) for n in counts))])

    def write(self, path: str) -> None:
        docs = zstandard.compress(pa.serialize_pandas(self.docs, preserve_index=False).to_pybytes(), 3)
        out = Output(path)
        out.file.write(_join([docs, _pack(self.word.astype("<i4")), _pack_sorted(self.hashes)]))
        out.close()

    @classmethod
    def read(cls, path: str) -> _Tokens:
        with open_read(path) as file:
            docs, word, hashes = _fields(file.read())
        return cls(_unpack(word, "<i4"), _unpack_sorted(hashes), pa.deserialize_pandas(zstandard.decompress(docs)))


class _Gathering:
    """Documents on their way into a chunk."""

    def __init__(self) -> None:
        self.number: dict[bytes, int] = defaultdict(itertools.count().__next__)
        self.tokens: list[np.ndarray] = []
        self.ids: list[int | None] = []
        self.parts: list[int] = []
        self.size = 0

    def add(self, doc_id: int | None, part: int, text: str | None) -> None:
        words = (text or "").encode("utf-8", "replace").lower().split()
        self.tokens.append(np.fromiter(map(self.number.__getitem__, words), dtype=np.int32, count=len(words)))
        self.ids.append(doc_id)
        self.parts.append(part)
        self.size += len(words) + 1

    def done(self) -> _Tokens:
        hashes = np.r_[np.fromiter((xxhash.xxh64_intdigest(w, 42) for w in self.number), dtype=np.uint64, count=len(self.number)), _END, _START]
        self.number.clear()
        order = np.argsort(hashes, kind="stable")
        rank = np.empty(len(hashes), dtype=np.int32)
        rank[order] = np.arange(len(hashes), dtype=np.int32)
        lengths = np.array([len(t) + 1 for t in self.tokens])
        stops = np.cumsum(lengths)
        word = np.empty(int(stops[-1]), dtype=np.int32)
        inner = np.ones(len(word), dtype=bool)
        inner[stops - 1] = False
        word[stops - 1] = rank[-2]
        word[inner] = rank[np.concatenate(self.tokens)]
        docs = pd.DataFrame({"id": pd.array(self.ids, dtype="Int64"), "part": np.array(self.parts, dtype=np.int8), "n": lengths})
        return _Tokens(word, hashes[order], docs)


def _chunked(ranges: int, folder: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        numbers = itertools.count()
        partition = TaskContext.get().partitionId()

        def flush() -> pd.DataFrame:
            tokens = chunk.done()
            path = f"{folder}/{partition}-{next(numbers)}"
            tokens.write(path)
            return pd.DataFrame([(path, r, data) for r, data in tokens.blocks(ranges, (0, 1))], columns=["chunk", "range", "data"])

        chunk = _Gathering()
        for batch in batches:
            for doc_id, part, text in zip(batch["id"], batch["part"], batch["text"], strict=True):
                chunk.add(None if pd.isna(doc_id) else int(doc_id), int(part), text)
                if chunk.size >= CHUNK_TOKENS:
                    yield flush()
                    chunk = _Gathering()
        if chunk.ids:
            yield flush()

    return run


def _answers(words: bool):
    """One hash range: sums the counts of all chunks' blocks and answers each block in its order.

    words: the keys are of words and pairs. Then pairs are also told whether no other chunk has them, and the row of the empty chunk has the range's tokens and distinct words, of all
    training documents and without the deleted ones.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        blocks = [_fields(d) for d in rows["data"]]
        back: list[list[bytes]] = [[] for _ in blocks]
        r = int(rows["range"].iloc[0])
        told = []
        for at in range(0, len(blocks[0]), 3):
            keys = [_unpack_sorted(b[at]) for b in blocks]
            every, inverse = np.unique(np.concatenate(keys), return_inverse=True)
            stops = np.cumsum([len(k) for k in keys])[:-1]
            both = []
            for i in (1, 2):
                held = np.concatenate([_unpack(b[at + i], "<i4") for b in blocks])
                both.append(np.bincount(inverse, weights=held, minlength=len(every)).astype(np.int64))
            if words and not at:
                own = every != _START
                total, core = both[0][own], (both[0] - both[1])[own]
                told.append(("", r, np.array([total.sum(), (total > 0).sum(), core.sum(), (core > 0).sum()], dtype=np.int64).tobytes()))
            for own, mine in zip(back, np.split(inverse, stops), strict=True):
                own += [_pack(both[0][mine]), _pack(both[1][mine])]
            if words and at:
                alone = (np.bincount(inverse, minlength=len(every)) == 1).astype(np.int64)
                for own, mine in zip(back, np.split(inverse, stops), strict=True):
                    own.append(_pack(alone[mine]))
        out = [(c, r, _join(parts)) for c, parts in zip(rows["chunk"], back, strict=True)]
        return pd.DataFrame([*out, *told], columns=["chunk", "range", "data"])

    return run


def _packed(suffix: str):
    """Writes all answers of a chunk beside its file; the sums of ranges, which belong to no chunk, are added up."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        chunk, data = rows["chunk"].iloc[0], rows.sort_values("range")["data"]
        if not chunk:
            sums = np.sum([np.frombuffer(d, dtype=np.int64) for d in data], axis=0)
            return pd.DataFrame({"chunk": [""], "data": [sums.tobytes()]})
        answers = [_fields(d) for d in data]
        whole = [_pack(np.concatenate([_unpack(a[i], "<i8") for a in answers])) for i in range(len(answers[0]))]
        out = Output(chunk + suffix)
        out.file.write(_join(whole))
        out.close()
        return pd.DataFrame({"chunk": [chunk], "data": [b""]})

    return run


class _Scored:
    """A chunk beside its answers; triples: with those for triples."""

    def __init__(self, chunk: str, triples: bool = True):
        self.chunk, self.t = chunk, _Tokens.read(chunk)
        word_all, word_deleted, pair_all, pair_deleted, self.alone = self._told("-answers")
        self.counts = [(word_all, word_deleted), (pair_all, pair_deleted)]
        if any(len(c[0]) != len(k) for c, k in zip(self.counts, (self.t.hashes, self.t.keys[0]), strict=True)):
            raise ValueError(f"chunk {chunk} was written anew in another order")
        if triples:
            wanted, told, (_, *own) = self.wanted(), self._told("-triples"), self.t.counted(2)
            self.counts.append(tuple(x.astype(np.int64) for x in own))
            for x, y in zip(self.counts[2], told, strict=True):
                x[wanted] = y

    def _told(self, suffix: str) -> list[np.ndarray]:
        with open_read(self.chunk + suffix) as file:
            return [_unpack(x, "<i8") for x in _fields(file.read())]

    def wanted(self) -> np.ndarray:
        """Which triples other chunks may hold: those without a pair that this chunk has alone."""
        t = self.t
        own = (self.alone > 0)[t.place[0]]
        before = np.roll(own, 1)
        before[t.starts] = False
        out = np.zeros(len(t.keys[1]), dtype=bool)
        out[t.place[1][~(own | before)]] = True
        return out

    def estimates(self, n: float, v: float, core: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each token its bucket, the estimates of orders 3, 2, 1 and the base, and c(w); core: without deleted documents."""
        t = self.t
        single, pairs, triples = (x[0] - x[1] if core else x[0] for x in self.counts)
        of, before = single[t.word], single[t.before]
        pair = pairs[t.place[0]]
        context = np.roll(pair, 1)
        context[t.starts] = before[t.starts]
        share = lambda x, y: np.divide(x, y, out=np.zeros(len(x)), where=y > 0)
        told = np.stack([share(triples[t.place[1]], context), share(pair, before), of / max(n, 1), (of + 0.5) / (n + 0.5 * (v + 1))])
        return np.where(context > 0, BUCKETS + _bucket(context), _bucket(before)), told, of


def _bucket(context: np.ndarray) -> np.ndarray:
    return np.minimum(np.frexp(context.astype(np.float64))[1], BUCKETS - 1).astype(np.int64)


def cells_of(bucket: np.ndarray, told: np.ndarray) -> np.ndarray:
    """A number for each token's bucket and quantised log ratios of its three estimates to the base."""
    code = bucket
    for p in told[:3]:
        ratio = np.full(len(p), -SPAN * GRID, dtype=np.int64)
        seen = p > 0
        ratio[seen] = np.clip(np.rint(np.log2(p[seen] / told[3][seen]) * GRID), -SPAN * GRID + 1, SPAN * GRID)
        code = code * SIDE + ratio + SPAN * GRID
    return code


def _histogram(n: float, v: float):
    """Held-out tokens by cell."""

    def run(s: _Scored) -> pd.DataFrame:
        bucket, told, _ = s.estimates(n, v, core=True)
        pick = s.t.part == 2
        found, count = np.unique(cells_of(bucket[pick], told[:, pick]), return_counts=True)
        return pd.DataFrame({"cell": found, "n": count})

    return _each(run)


def _asked(ranges: int):
    """Blocks of the triples that are to be counted with other chunks."""
    return _each(lambda s: pd.DataFrame([(s.chunk, r, data) for r, data in s.t.blocks(ranges, (2,), s.wanted())], columns=["chunk", "range", "data"]), False)


def _each(run, triples: bool = True):
    """For a mapping of rows (chunk), a chunk at once."""

    def over(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for chunk in b["chunk"]:
                yield run(_Scored(chunk, triples))

    return over


def expectation_maximisation(cells: np.ndarray, count: np.ndarray, rounds: int = 60) -> np.ndarray:
    """Weights (bucket, order 3 | order 2 | order 1 | base) from the histogram; those of buckets without tokens are of the nearest below."""
    ratios, rest = [], cells
    for _ in range(3):
        ratios.append(rest % SIDE - SPAN * GRID)
        rest = rest // SIDE
    p = np.ones((len(cells), 4))
    for i, r in enumerate(ratios[::-1]):
        p[:, i] = np.where(r == -SPAN * GRID, 0.0, 2.0 ** (r / GRID))
    return mixed(rest, p, count, rounds)


def mixed(bucket: np.ndarray, p: np.ndarray, count: np.ndarray, rounds: int = 60) -> np.ndarray:
    """Expectation-maximisation of the mixture weights of estimates ``p`` by bucket, each row ``count`` times."""
    weights = np.full((2 * BUCKETS, 4), 1 / 4)
    mass = np.bincount(bucket, weights=count, minlength=2 * BUCKETS)
    for _ in range(rounds):
        share = weights[bucket] * p
        share *= (count / share.sum(1))[:, None]
        new = np.stack([np.bincount(bucket, weights=share[:, i], minlength=2 * BUCKETS) for i in range(4)], axis=1) + np.array([0.0, 0.0, 0.01, 0.01])
        weights = np.where(mass[:, None] > 0, new / new.sum(1, keepdims=True), weights)
    weights[:BUCKETS, 0] = 0  # an unseen context has no estimate
    weights[0, 1] = 0
    weights /= weights.sum(1, keepdims=True)
    for b in [*range(1, BUCKETS), *range(BUCKETS + 1, 2 * BUCKETS)]:
        if not mass[b]:
            weights[b] = weights[b - 1]
    return weights


def _final(weights: np.ndarray, n: float, v: float):
    def run(s: _Scored) -> pd.DataFrame:
        bucket, told, of = s.estimates(n, v, core=False)
        p = (weights[bucket].T * told).sum(0)
        add = lambda x: np.add.reduceat(x, s.t.starts)
        return pd.DataFrame({"id": s.t.docs["id"].astype("Int64"), "n_tokens": s.t.docs["n"].astype(np.int64), "n_known": add((of > 0).astype(np.int64)), "base_score": add(np.log10(told[3])), "score": add(np.log10(p))})

    return _each(run)


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranges: int | None = None) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of each row of ``docs``, whole texts.

    Null texts count as empty: one end token. Rows with a null id are scored and train (their remainder is no 1). Repeated
    rows count and come as often as they are there. An empty table gives no rows. Ids are longs.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    rest = crc_mod(F.col(id_col), FOLDS)
    part = F.when(rest == HELD_OUT, 0).when(rest == DELETED, 2).otherwise(1)
    n_ranges = ranges or max(int(spark.conf.get("spark.sql.shuffle.partitions")), input_bytes(docs) // RANGE_BYTES)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), part.alias("part"), F.col(text_col).alias("text"))
    packed = texts.mapInPandas(_chunked(n_ranges, scratch_path(spark, "lm-tokens")), _BLOCK)
    answered = packed.groupBy("range").applyInPandas(_answers(True), _BLOCK).groupBy("chunk").applyInPandas(_packed("-answers"), "chunk string, data binary")
    answers, _ = materialise(answered, "lm-answers")
    told = answers.where("chunk = ''").select("data").collect()  # one row
    sums = np.frombuffer(told[0]["data"], dtype=np.int64) if told else np.zeros(4, dtype=np.int64)
    n, v, core_n, core_v = (int(x) for x in sums)
    chunks = answers.where("chunk <> ''").select("chunk")
    many = chunks.count()
    beside = chunks.repartition(max(1, min(many, max(4 * spark.sparkContext.defaultParallelism, many // 4))))
    asked = beside.mapInPandas(_asked(n_ranges), _BLOCK)
    materialise(asked.groupBy("range").applyInPandas(_answers(False), _BLOCK).groupBy("chunk").applyInPandas(_packed("-triples"), "chunk string, data binary"), "lm-triples")
    cells = beside.mapInPandas(_histogram(core_n, core_v), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    weights = expectation_maximisation(cells["cell"].to_numpy(dtype=np.int64), cells["n"].to_numpy(dtype=float)) if len(cells) else np.tile([0.0, 0.0, 0.0, 1.0], (2 * BUCKETS, 1))
    scored = beside.mapInPandas(_final(weights, n, v), "id long, n_tokens long, n_known long, base_score double, score double")
    return scored.select(
        F.col("id").alias(id_col), F.coalesce(crc_mod(F.col("id"), FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"),
        "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score",
    )
