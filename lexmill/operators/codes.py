"""Whole Arrow columns of texts as flat numpy arrays: suffix order, counts of windows, counts of words.

A column's texts lie one behind the other, so each step is a few array operations for thousands of texts. Rows are taken
in groups of bounded size; a longer text is a group of its own. Nothing leaves a text: what lies behind its end is a pad.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of a group of texts, positions looked at in one step, rows of a batch given back.
GROUP = 1 << 20
STEP = 1 << 22
ROWS = 1 << 17


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column of strings without nulls, and where each text begins and the last one ends."""
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    held = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return held[at[0] : at[-1]], at - at[0]


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """As :func:`raw` in code points instead of bytes."""
    data, at = raw(column)
    first = (data & 0xC0) != 0x80
    if first.all():
        return data.astype(np.uint32), at
    first[at[:-1][at[:-1] < at[1:]]] = True
    places = np.flatnonzero(first)
    lead = data[places]
    codes = lead.astype(np.uint32)
    wide = np.flatnonzero(lead >= 0xC0)
    size = 2 + (lead[wide] >= 0xE0) + (lead[wide] >= 0xF0).astype(np.int64)
    told = codes[wide] & (0xFF >> (size + 1)).astype(np.uint32)
    for j in (1, 2, 3):
        more = size > j
        told[more] = told[more] << 6 | (data[np.minimum(places[wide][more] + j, len(data) - 1)] & 0x3F)
    codes[wide] = told
    return codes, np.searchsorted(places, at)


def strings(codes: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """Texts of the given numbers of code points, one behind the other."""
    sizes = 1 + (codes >= 0x80) + (codes >= 0x800) + (codes >= 0x10000).astype(np.int64)
    ends = np.concatenate([[0], np.cumsum(sizes)])
    offsets = ends[np.concatenate([[0], np.cumsum(lengths)])].astype(np.int64)
    data = codes.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")
    return pa.LargeStringArray.from_buffers(len(lengths), pa.py_buffer(offsets), pa.py_buffer(data)).cast(pa.string())


def groups(column: pa.Array, most: int | None = None) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most ``most`` bytes (GROUP where it is None), one row at least."""
    _, at = raw(column)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(at, at[row] + (most or GROUP), "right")) - 1)
        yield row, end
        row = end


def _small(codes: np.ndarray) -> tuple[np.ndarray, int]:
    """Code points numbered from 1 in their order, and the bits of a number."""
    held = np.zeros(int(codes.max(initial=0)) + 1, np.int64)
    held[codes] = 1
    number = np.cumsum(held)
    return number[codes], max(1, int(number[-1]).bit_length())


def suffix_order(codes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, rank, pos, height) of all suffixes, text by text in their order.

    The first ranks are of as many characters as 63 bits hold behind the text's number. Places that share a rank are ranked
    again by the rank of the place so many characters on, which doubles the length, until all ranks differ. Heights add up
    the lengths on which ranks agree, the longest first; what is left is shorter than the first keys and is compared.
    """
    n, lengths = len(codes), np.diff(at)
    text = np.repeat(np.arange(len(lengths)), lengths)
    end = at[1:][text]
    number, bits = _small(codes)
    span = max(1, (63 - max(1, len(lengths)).bit_length()) // bits)
    span = min(span, max(1, int(lengths.max(initial=1))))
    key = text.astype(np.int64)
    for j in range(span):
        key <<= bits
        inside = np.minimum(np.arange(j, n + j), n - 1)
        key |= np.where(np.arange(j, n + j) < end, number[inside], 0)
    order = np.argsort(key, kind="stable")
    sorted_key = key[order]
    fresh = np.concatenate([[True], sorted_key[1:] != sorted_key[:-1]])
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    alone = fresh & np.concatenate([fresh[1:], [True]])
    tied = order[~alone]
    kept = np.int32 if n < 1 << 31 else np.int64
    levels, reach = [rank.astype(kept)], span
    while len(tied):
        on = np.where(tied + reach < end[tied], rank[np.minimum(tied + reach, n - 1)] + 1, 0)
        pair = rank[tied] * (n + 1) + on
        by = np.argsort(pair, kind="stable")
        tied, pair = tied[by], pair[by]
        old = rank[tied]
        index = np.arange(len(tied))
        fresh = np.concatenate([[True], pair[1:] != pair[:-1]])
        begun = np.maximum.accumulate(np.where(np.concatenate([[True], old[1:] != old[:-1]]), index, 0))
        rank[tied] = old + np.maximum.accumulate(np.where(fresh, index, 0)) - begun
        tied = tied[~(fresh & np.concatenate([fresh[1:], [True]]))]
        levels.append(rank.astype(kept))
        reach *= 2
    sa = np.empty(n, np.int64)
    sa[rank] = np.arange(n)
    before = np.concatenate([[0], sa[:-1]])
    owner = text[sa]
    paired = np.flatnonzero(np.concatenate([[False], owner[1:] == owner[:-1]]))
    p, q, stop = sa[paired], before[paired], end[sa[paired]]
    height = np.zeros(len(paired), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        a, b = p + height, q + height
        same = (a < stop) & (b < stop) & (levels[k][np.minimum(a, n - 1)] == levels[k][np.minimum(b, n - 1)])
        height[same] += span << k
    open_ = np.arange(len(paired))
    while len(open_):
        a, b = p[open_] + height[open_], q[open_] + height[open_]
        same = (a < stop[open_]) & (b < stop[open_]) & (codes[np.minimum(a, n - 1)] == codes[np.minimum(b, n - 1)])
        open_ = open_[same]
        height[open_] += 1
    heights = np.zeros(n, np.int64)
    heights[paired] = height
    return owner, np.arange(n) - at[owner], sa - at[owner], heights


def window_counts(column: pa.Array, before: int, ahead: int, least: int = 1) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """(window, at, cnt): the distinct windows around all places, how many characters lie before the place, how often.

    A window reaches from ``before`` characters before its place to ``ahead`` from it on, as far as the text goes; places
    with fewer than ``least`` characters from them on are left out.
    """
    codes, starts = flat(column)
    if not len(codes):
        return
    number, bits = _small(codes)
    gap, lengths = max(before, ahead), np.diff(starts)
    shift = np.repeat(gap * (np.arange(len(lengths)) + 1), lengths)
    places = np.arange(len(codes)) + shift
    size = len(codes) + gap * (len(lengths) + 1)
    padded, own = np.zeros(size, np.int64), np.zeros(size, np.uint32)
    padded[places], own[places] = number, codes
    for low in range(0, len(places), STEP):
        chosen = places[low : low + STEP]
        chosen = chosen[padded[chosen + least - 1] > 0]
        if not len(chosen):
            continue
        a, b = int(chosen[0]), int(chosen[-1]) + 1
        key, used = np.zeros(b - a, np.int64), 0
        for j in range(-before, ahead):
            if used + bits > 63:
                held, key = np.unique(key, return_inverse=True)
                used = len(held).bit_length()
            key = key << bits | padded[a + j : b + j]
            used += bits
        key = key[chosen - a]
        if used <= 20:  # few possible keys: counted without a sort
            counted, some = np.bincount(key), np.zeros(1 << used, np.int64)
            some[key] = chosen
            held = np.flatnonzero(counted)
            first, counts = some[held], counted[held]
        else:
            order = np.argsort(key)
            key = key[order]
            edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            first, counts = chosen[order[edge]], np.diff(np.append(edge, len(key)))
        cells = first[:, None] + np.arange(-before, ahead)
        held = padded[cells] > 0
        yield strings(own[cells][held], held.sum(1)), held[:, :before].sum(1), counts


class Words:
    """Occurrences of given words in texts, overlapping ones too."""

    def __init__(self, words: list[str]):
        self.by_size: dict[int, tuple] = {}
        sizes: dict[int, list[tuple[bytes, int]]] = {}
        for i, word in enumerate(words):
            held = word.encode("utf-8", "surrogatepass")
            sizes.setdefault(len(held), []).append((held, i))
        for size, own in sizes.items():
            letters = np.frombuffer(b"".join(w for w, _ in own), np.uint8).reshape(len(own), size)
            seed = 0
            while True:  # until no two words share a hash
                powers = np.random.default_rng(seed).integers(1, 1 << 63, size, np.uint64) | np.uint64(1)
                hashes = (letters * powers).sum(1, dtype=np.uint64)
                if len(np.unique(hashes)) == len(own):
                    break
                seed += 1
            by = np.argsort(hashes)
            heads = np.zeros(1 << 16, bool)
            if size == 1:
                heads[(letters[:, 0].astype(np.int64)[:, None] << 8 | np.arange(256)).ravel()] = True
            else:
                heads[letters[:, 0].astype(np.int64) << 8 | letters[:, 1]] = True
            self.by_size[size] = heads, powers, hashes[by], letters[by], np.array([i for _, i in own])[by]
        self.n = len(words)

    def count(self, column: pa.Array) -> np.ndarray:
        """How often each word occurs in a column's texts."""
        data, at = raw(column)
        counts = np.zeros(self.n, np.int64)
        for low in range(0, len(data), STEP):
            part = data[low : low + STEP + 1].astype(np.uint16)
            pairs = part << 8
            pairs[:-1] |= part[1:]
            pairs = pairs[:STEP]
            for size, (heads, powers, hashes, letters, number) in self.by_size.items():
                found = np.flatnonzero(heads[pairs]) + low
                found = found[found + size <= len(data)]
                found = found[found + size <= at[np.searchsorted(at, found, "right")]]
                told = np.zeros(len(found), np.uint64)
                for j in range(size):
                    told += data[found + j] * powers[j]
                which = np.minimum(np.searchsorted(hashes, told), len(hashes) - 1)
                same = hashes[which] == told
                found, which = found[same], which[same]
                for j in range(size):
                    same = data[found + j] == letters[which, j]
                    found, which = found[same], which[same]
                counts += np.bincount(number[which], minlength=self.n)
        return counts
