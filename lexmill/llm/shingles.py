"""Near-duplicates by SimHash with pigeonring filtering, completed to a Jaccard similarity of shingle sets.

Texts are linked where their sets of ``WORDS``-word shingles have a similarity of at least ``SIMILARITY``. Candidates come
from two sides. The first is the SimHash operator: fingerprints over the same shingles, joined by the pigeonring keys,
give the pairs at most 3 bits apart. At a similarity of 0.8 fingerprints lie about 10 bits apart, out of reach of any
radius that keys can serve, so the second side are min-wise hashes: pairs that agree in all ``ROWS`` minima of one of
``BANDS`` bands. A pair at 0.8 exactly agrees in none with a chance of (1 - 0.8 ** ROWS) ** BANDS, 2.5e-5, a closer one with
less; a pair at 0.3, such as texts that share a passage, in any with a chance of one in a hundred.

The share of equal minima estimates a candidate's similarity with a deviation of 0.0225 at 0.8. Beyond ``SURE`` deviations
to either side it decides (wrong once in 5e7); in between the whole sets are compared, made from the texts again, since
sets are several times as large as texts. The members of a band are never turned into all their pairs at once: a few of
them are compared with the rest, and only where the rest is not connected yet more of them follow, 16 times as many each
round. Bands of over ``CROWD`` members are linked from whole sets instead (``_Crowd``), exact too.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.llm import simhash
from lexmill.llm.graph import connected_components
from lexmill.llm.runtime import bound_batches, materialise, release

WORDS, SIMILARITY, BANDS, ROWS, SEED = 5, 0.8, 45, 7, 42
#: Deviations of the estimate from the similarity asked for, beyond which it decides.
SURE = 5.5
#: Members of a band that are compared with its rest in the first round, about, and how many times as many in the next.
CENTRES, GROWTH = 2, 16
#: Members from which a band is linked by differences from its common set, the first members that tell this set, and how
#: often a difference occurs at most to be looked up.
CROWD, TELLING, RARE = 32, 256, 16
#: Keys that a semi-join may broadcast, 30 MB; beyond it texts are shuffled.
BROADCAST_KEYS = 500_000
_SLICE = 512
_RNG = np.random.default_rng(SEED)
_XOR = _RNG.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)
_TIMES = _RNG.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32) | np.uint32(1)


def shingle_hashes(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes; a text of fewer words is one shingle, null and word-free texts the empty one."""
    parts = (text or "").encode("utf-8", "replace").lower().split()
    xx, join = xxhash.xxh64_intdigest, b" ".join
    if len(parts) < words:
        return np.array([xx(join(parts), SEED)], dtype=np.uint64)
    grams = map(join, zip(*(parts[i:] for i in range(words)), strict=False))
    return np.unique(np.fromiter((xx(s, SEED) for s in grams), dtype=np.uint64, count=len(parts) - words + 1))


def minima(hashes: np.ndarray) -> np.ndarray:
    """The smallest value of a set under each of BANDS * ROWS hash functions."""
    high, least = (hashes >> np.uint64(32)).astype(np.uint32), np.full(BANDS * ROWS, 0xFFFFFFFF, dtype=np.uint32)
    for at in range(0, len(high), _SLICE):
        mixed = (high[at : at + _SLICE, None] ^ _XOR) * _TIMES
        mixed ^= mixed >> np.uint32(15)
        mixed *= np.uint32(0x2C1B3C6D)
        np.minimum(least, mixed.min(axis=0), out=least)
    return least


def band_keys(least: np.ndarray) -> np.ndarray:
    """A long for each band: the hash of the band's number and its minima."""
    return np.array([xxhash.xxh64_intdigest(row.tobytes(), band) for band, row in enumerate(least.reshape(BANDS, ROWS))], dtype=np.uint64).view(np.int64)


def set_hash(hashes: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(hashes.tobytes(), SEED)


def shingle_fingerprint(text: Column | str) -> Column:
    """The hash of a text's shingle set as a signed long."""

    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([set_hash(shingle_hashes(x)) for x in texts], dtype=np.uint64).view(np.int64))

    return of(text)


def sketch(text: Column | str) -> Column:
    """struct(fp, sim, n, keys, sig): the set's hash, its SimHash, its size, its band keys and a byte of each minimum."""

    @F.pandas_udf("fp long, sim long, n int, keys array<long>, sig binary")
    def of(texts: pd.Series) -> pd.DataFrame:
        sets = [shingle_hashes(x) for x in texts]
        least = [minima(s) for s in sets]
        longs = lambda x: np.array(x, dtype=np.uint64).view(np.int64)
        return pd.DataFrame({
            "fp": longs([set_hash(s) for s in sets]), "sim": longs([simhash.majority(s) for s in sets]), "n": [len(s) for s in sets],
            "keys": [band_keys(x) for x in least], "sig": [(x >> np.uint32(24)).astype(np.uint8).tobytes() for x in least],
        })

    return of(text)


def _estimate(one: str, two: str) -> Column:
    """Similarity by the share of equal bytes, of which one in 256 is equal by chance."""

    @F.pandas_udf("double")
    def of(a: pd.Series, b: pd.Series) -> pd.Series:
        x, y = (np.frombuffer(b"".join(c), dtype=np.uint8).reshape(len(c), BANDS * ROWS) for c in (a, b))
        return pd.Series(((x == y).mean(axis=1) - 1 / 256) / (1 - 1 / 256), dtype=float)

    return of(one, two)


def _hashes(text: Column) -> Column:
    @F.pandas_udf("fp long, hashes array<long>")
    def of(texts: pd.Series) -> pd.DataFrame:
        sets = [shingle_hashes(x) for x in texts]
        return pd.DataFrame({"fp": np.array([set_hash(s) for s in sets], dtype=np.uint64).view(np.int64), "hashes": [s.view(np.int64) for s in sets]})

    return of(text)


def whole_sets(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(fp, hashes) of the texts whose hashes are among ``wanted`` (th, fp)."""
    keys = wanted.select("th").distinct()
    few = keys.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
    found = texts.where("text is not null").withColumn("th", F.xxhash64("text")).join(F.broadcast(keys) if few else keys, "th", "left_semi")
    once = found.groupBy("th").agg(F.min("text").alias("text"))  # texts of one hash are the same but for chance
    made = once.withColumn("s", _hashes(F.col("text"))).select("s.*")
    return made.join(wanted.select("fp").distinct(), "fp", "left_semi").dropDuplicates(["fp"])


def _checked(pairs: DataFrame, sets: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """The pairs (src, dst) of ``sets`` (fp, th, sig, ..) that are similar enough."""
    spark = pairs.sparkSession
    wide = SURE * (similarity * (1 - similarity) / (BANDS * ROWS)) ** 0.5
    ends = pairs.select(F.explode(F.array("src", "dst")).alias("fp")).distinct()
    own, own_path = materialise(sets.join(ends, "fp", "left_semi").groupBy("fp").agg(F.min("th").alias("th"), F.first("sig").alias("sig")), "shingle-ends")
    a, b = (own.select(F.col("fp").alias(end), F.col("th").alias(f"{end}_th"), F.col("sig").alias(f"{end}_sig")) for end in ("src", "dst"))
    told = pairs.join(a, "src").join(b, "dst").withColumn("like", _estimate("src_sig", "dst_sig")).where(F.col("like") >= similarity - wide)
    told, told_path = materialise(told.select("src", "dst", "src_th", "dst_th", "like"), "shingle-estimates")
    sure, open_pairs = told.where(F.col("like") >= similarity + wide).select("src", "dst"), told.where(F.col("like") < similarity + wide)
    wanted = open_pairs.select(F.explode(F.array(F.struct(F.col("src_th").alias("th"), F.col("src").alias("fp")), F.struct(F.col("dst_th").alias("th"), F.col("dst").alias("fp")))).alias("x")).select("x.*").distinct()
    whole, whole_path = materialise(whole_sets(texts, wanted), "shingle-whole")
    x, y = (whole.select(F.col("fp").alias(end), F.col("hashes").alias(f"{end}_set")) for end in ("src", "dst"))
    common = F.size(F.array_intersect("src_set", "dst_set"))
    alike = common >= similarity * (F.size("src_set") + F.size("dst_set") - common) - 1e-9
    exact = open_pairs.select("src", "dst").join(x, "src").join(y, "dst").where(alike).select("src", "dst")
    links, _ = materialise(sure.union(exact), "shingle-links")
    release(spark, own_path, told_path, whole_path)
    return links


def simhash_links(sets: DataFrame, texts: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(src, dst) between similar sets (fp, sim, ..) whose SimHash fingerprints are equal or linked by the pigeonring.

    Sets of one fingerprint hang on the smallest of them, and linked fingerprints on each other's smallest.
    """
    first, path = materialise(sets.groupBy("sim").agg(F.min("fp").alias("first")), "shingle-sims")
    ends = [first.select(F.col("sim").alias(e), F.col("first").alias(f"{e}_first")) for e in ("src", "dst")]
    across = simhash.near_links(first, "sim").join(ends[0], "src").join(ends[1], "dst").select(F.col("src_first").alias("src"), F.col("dst_first").alias("dst"))
    within = sets.select("sim", "fp").distinct().join(first, "sim").where("fp <> first").select(F.col("first").alias("src"), F.col("fp").alias("dst"))
    pairs, pairs_path = materialise(across.union(within).select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct(), "shingle-pairs")
    links = _checked(pairs, sets, texts, similarity)
    release(sets.sparkSession, path, pairs_path)
    return links


class _Crowd:
    """One band: each member as the difference of its set from a common set, the shingles of most of its first members.

    Sets x and y with differences X and Y differ in |X| + |Y| - 2 |X & Y| shingles and are similar if that is at most k(|x| +
    |y|), k = (1 - similarity) / (1 + similarity): g(x) + g(y) <= 2 |X & Y| for g(x) = |X| - k|x|. Pairs with g(x) + g(y) <= 0
    are similar whatever they share, and each end is similar to the member of the smallest g, so a star links them all. Other
    similar pairs share a difference: a rare one, and are looked up by it; or frequent ones alone, and then at least half of
    g(x) + g(y) of them. Members with too few frequent ones for that are done, the rest is multiplied out.
    """

    def __init__(self, key: int, similarity: float):
        self.key, self.k = key, (1 - similarity) / (1 + similarity)
        self.common: np.ndarray | None = None
        self.held: list[tuple[np.ndarray, np.ndarray]] = []
        self.waiting = self.count = 0
        self.fps: list[np.ndarray] = []
        self.sizes: list[np.ndarray] = []
        self.owner: list[np.ndarray] = []
        self.what: list[np.ndarray] = []

    def add(self, fps: np.ndarray, sizes: np.ndarray, hashes: np.ndarray) -> None:
        """Members with their sets one after another."""
        self.fps.append(fps)
        self.sizes.append(sizes)
        if self.common is not None:
            return self._reduce(sizes, hashes)
        self.held.append((sizes, hashes))
        self.waiting += len(sizes)
        if self.waiting >= TELLING:
            self._tell()

    def _tell(self) -> None:
        found, times = np.unique(np.concatenate([h for _, h in self.held]), return_counts=True)
        self.common = found[2 * times > self.waiting]
        for sizes, hashes in self.held:
            self._reduce(sizes, hashes)
        self.held.clear()

    def _reduce(self, sizes: np.ndarray, hashes: np.ndarray) -> None:
        own, common = np.repeat(np.arange(len(sizes)), sizes), self.common
        place = np.searchsorted(common, hashes)
        there = np.zeros(len(hashes), dtype=bool)
        inner = place < len(common)
        there[inner] = common[place[inner]] == hashes[inner]
        has = np.zeros((len(sizes), len(common)), dtype=bool)
        has[own[there], place[there]] = True
        lacks, which = np.nonzero(~has)
        self.owner += [self.count + own[~there], self.count + lacks]
        self.what += [hashes[~there], common[which]]
        self.count += len(sizes)

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """A spanning forest of the similar pairs."""
        if self.common is None:
            self._tell()
        n, fps = self.count, np.concatenate(self.fps)
        _, what, times = np.unique(np.concatenate(self.what), return_inverse=True, return_counts=True)
        owner, eps = np.concatenate(self.owner), 1e-9
        order = np.lexsort((what, owner))
        owner, what = owner[order], what[order]
        many = np.bincount(owner, minlength=n)
        starts = np.concatenate([[0], np.cumsum(many)])
        g = many - self.k * np.concatenate(self.sizes)
        often = times[what] > RARE
        shared = np.bincount(owner[often], minlength=n)
        up, src, dst = np.arange(n), [], []

        def root(a: int) -> int:
            while up[a] != a:
                up[a] = a = up[up[a]]
            return a

        def link(a: int, b: int) -> None:
            x, y = root(a), root(b)
            if x != y:
                up[max(x, y)] = min(x, y)
                src.append(a)
                dst.append(b)

        hub = int(g.argmin())
        star = g + g[hub] <= eps
        star[hub] = True
        for x in np.flatnonzero(star).tolist():
            link(hub, x)

        # pairs that share a rare difference
        rare = np.flatnonzero((times[what] > 1) & ~often)
        rare = rare[np.argsort(what[rare], kind="stable")]
        for d in range(2, RARE + 1):
            rows = owner[rare[times[what[rare]] == d]].reshape(-1, d)
            codes = []
            for i in range(d):
                for j in range(i):
                    a, b = rows[:, j], rows[:, i]
                    worth = ~(star[a] & star[b]) & (g[a] + g[b] <= 2 * np.minimum(many[a], many[b]) + eps)
                    codes.append(a[worth] * np.int64(n) + b[worth])
            for code in np.unique(np.concatenate(codes)).tolist():
                a, b = divmod(code, n)
                if root(a) != root(b):
                    both = np.intersect1d(what[starts[a] : starts[a + 1]], what[starts[b] : starts[b + 1]], assume_unique=True)
                    if g[a] + g[b] <= 2 * len(both) + eps:
                        link(a, b)

        # pairs that share frequent ones alone
        least = g - 2 * shared
        left = np.flatnonzero(~star & (g + least.min() <= eps))
        if len(left):
            others = np.flatnonzero((least + g[left].min() <= eps) & (g + least[left].min() <= eps))
            column = np.cumsum(times > RARE) - 1
            wide = int(column[-1]) + 1 if len(column) else 0
            step = max(1, (1 << 24) // max(1, wide))

            def dense(of: np.ndarray) -> np.ndarray:
                out = np.zeros((len(of), wide), dtype=np.float32)
                for i, x in enumerate(of):
                    at = slice(starts[x], starts[x + 1])
                    out[i, column[what[at][often[at]]]] = 1
                return out

            for lo in range(0, len(others), min(step, 4096)):
                ends = others[lo : lo + min(step, 4096)]
                right = dense(ends).T
                for at in range(0, len(left), min(step, 1024)):
                    own = left[at : at + min(step, 1024)]
                    near = g[own][:, None] + g[ends][None, :] <= 2 * (dense(own) @ right).astype(float) + eps
                    for i in np.flatnonzero(near.any(axis=1)).tolist():
                        for j in ends[near[i]].tolist():
                            link(int(own[i]), j)
        return fps[np.array(src, dtype=np.int64)], fps[np.array(dst, dtype=np.int64)]


def _crowd_links(similarity: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For batches (key, fp, hashes) sorted by key: links of each key's members."""

    def done(crowd: _Crowd) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x) for x in crowd.links()], names=["src", "dst"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crowd = None
        for batch in batches:
            keys, fps, lists = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2)
            sizes, hashes = lists.value_lengths().to_numpy().astype(np.int64), lists.flatten().to_numpy()
            cuts = np.flatnonzero(np.diff(keys)) + 1
            ends = np.concatenate([[0], np.cumsum(sizes)])
            for lo, hi in zip([0, *cuts], [*cuts, len(keys)], strict=True):
                if lo == hi:
                    continue
                if crowd is None or crowd.key != keys[lo]:
                    if crowd is not None:
                        yield done(crowd)
                    crowd = _Crowd(keys[lo], similarity)
                crowd.add(fps[lo:hi], sizes[lo:hi], hashes[ends[lo] : ends[hi]])
        if crowd is not None:
            yield done(crowd)

    return run


def crowd_links(members: DataFrame, sets: DataFrame, texts: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(src, dst) that connect all similar pairs of ``members`` (key, fp, lot) with a key in common."""
    spark = members.sparkSession
    wanted = sets.join(members.select("fp").distinct(), "fp", "left_semi").groupBy("fp").agg(F.min("th").alias("th"))
    whole, path = materialise(whole_sets(texts, wanted), "shingle-crowds")
    rows = members.select("key", "fp", "lot").join(whole, "fp").repartition("key").sortWithinPartitions("key", "lot")
    links, _ = materialise(rows.select("key", "fp", "hashes").mapInArrow(_crowd_links(similarity), "src long, dst long").distinct(), "shingle-links")
    release(spark, path)
    return links


def similar_links(sets: DataFrame, texts: DataFrame, similarity: float = SIMILARITY, centres: int = CENTRES) -> DataFrame:
    """(src, dst) between similar sets (fp, th, n, keys, sig), enough to connect all similar pairs that share a band.

    ``texts``: a column text, of which th are the hashes.
    """
    spark = sets.sparkSession
    keyed = sets.groupBy("fp", "n").agg(F.first("keys").alias("keys")).select(F.explode("keys").alias("key"), "fp", "n")
    sizes = keyed.groupBy("key").agg(F.count("*").alias("many"), F.min(_lot()).alias("least")).where("many > 1")
    members = keyed.join(sizes, "key").select("key", "fp", "n", "many", (_lot() == F.col("least")).alias("least"), _lot().alias("lot"))
    every, live_path = materialise(members.withColumn("part", F.lit(0).cast("long")), "shingle-members")
    live, crowd = every.where(F.col("many") <= CROWD), every.where(F.col("many") > CROWD)
    links, upto = None if crowd.isEmpty() else crowd_links(crowd, sets, texts, similarity), centres
    while not live.isEmpty():
        first = live.where(_centre(upto)).select("key", F.col("fp").alias("src"), F.col("n").alias("m"), F.col("lot").alias("l"), F.col("part").alias("p"))
        later = (F.col("lot") > F.col("l")) | ((F.col("lot") == F.col("l")) & (F.col("fp") > F.col("src")))
        near = later & ((F.col("part") != F.col("p")) | (F.col("part") == 0)) & (F.least("n", "m") >= similarity * F.greatest("n", "m") - 1e-9)
        met = first.join(live, "key").where(near).select(F.least("src", "fp").alias("src"), F.greatest("src", "fp").alias("dst")).distinct()
        pairs, pairs_path = materialise(met, "shingle-pairs")
        found = _checked(pairs, sets, texts, similarity)
        links = found if links is None else links.union(found)
        release(spark, pairs_path)
        rest = live.where(~_centre(upto))
        if rest.isEmpty():
            break
        # a band goes on where its rest is in several parts; part 0 is a set without links
        parts = connected_components(links).withColumnRenamed("vertex", "fp")
        rest = rest.drop("part").join(parts, "fp", "left").withColumn("part", F.coalesce("component", F.lit(0))).drop("component")
        open_keys = rest.groupBy("key").agg(F.count("*").alias("c"), F.min("part").alias("x"), F.max("part").alias("y")).where("c > 1 and (x <> y or x = 0)").select("key")
        rest, rest_path = materialise(rest.join(open_keys, "key", "left_semi"), "shingle-members")
        release(spark, live_path)
        live, live_path, upto = rest, rest_path, upto * GROWTH
    release(spark, live_path)
    return links if links is not None else spark.createDataFrame([], "src long, dst long")


def _lot() -> Column:
    return F.xxhash64("fp")


def _centre(upto: float) -> Column:
    """Whether a member is among about the ``upto`` smallest lots of its band; the smallest always is."""
    share = F.col("lot") / F.lit(2.0**64) + 0.5
    return F.col("least") | (share < F.lit(float(upto)) / F.col("many"))


def sketches(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, th, fp, sim, n, keys, sig) of each row."""
    bound_batches(docs.sparkSession)
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("_text"))
    return own.withColumn("s", sketch("_text")).select("id", F.xxhash64("_text").alias("th"), "s.*")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs``, all columns as they are, of which one stays for each component of similar texts.

    Rows, ids and nulls as in ``simhash.keep_one``; texts with the same shingle set are one, as are all without words.
    """
    sets, _ = materialise(sketches(docs, id_col, text_col), "shingle-sketches")
    texts = docs.select(F.col(text_col).alias("text"))
    links = simhash_links(sets, texts, similarity).union(similar_links(sets, texts, similarity)).distinct()
    return simhash.keep_first(docs, sets.select("id", "fp"), links, shingle_fingerprint, id_col, text_col)
