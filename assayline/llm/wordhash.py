"""Vectorised hashing of words and shingles over a whole batch of texts.

A batch is one run of bytes plus the offset of each text. Words are found by byte
classes; the hash of a word is a polynomial over its bytes, read off a running sum, so
no Python loop touches a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers = np.ones(1, np.uint64)
_inverse_powers = np.ones(1, np.uint64)

#: Bytes handled at once; one longer text is handled alone.
SLICE_BYTES = 1 << 20

#: White space of the near-duplicate contract: 0x20 and 0x09 to 0x0D.
SPACE_CLASSES = np.ones(256, np.uint8)
SPACE_CLASSES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = 0

#: Classes for classifiers: 0 between tokens, 1 letters, digits and bytes of non-ASCII characters, 2 signs.
SIGN_CLASSES = SPACE_CLASSES.copy() * 2
for _low, _high in ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)):
    SIGN_CLASSES[_low : _high + 1] = 1

#: Words only; signs separate.
WORD_CLASSES = (SIGN_CLASSES == 1).astype(np.uint8)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse."""
    global _powers, _inverse_powers
    if len(_powers) < n:
        with np.errstate(over="ignore"):
            size = max(n, SLICE_BYTES + 1)
            steps = np.full(size, _BASE)
            steps[0] = 1
            powers = np.multiply.accumulate(steps)
            steps[1:] = _BASE_INVERSE
            inverse = np.multiply.accumulate(steps)
        if size > 8 * SLICE_BYTES:  # a very long text is not worth keeping tables for
            return powers, inverse
        _powers, _inverse_powers = powers, inverse
    return _powers[:n], _inverse_powers[:n]


def mix(h: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective scramble of 64-bit values (the finaliser of splitmix64)."""
    with np.errstate(over="ignore"):
        h = h + np.uint64(((seed + 1) * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
        h ^= h >> np.uint64(30)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(27)
        h *= np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(31)
    return h


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(index of the first text, bytes, offsets) of runs of texts; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return
    _, offsets_buffer, data = texts.buffers()
    offsets = np.frombuffer(offsets_buffer, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        yield first, whole[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def words(data: np.ndarray, offsets: np.ndarray, classes: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash, index of its text) of each word, in order. A word is a longest run of one class other than 0."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    kinds = classes[data]
    begins = np.empty(n, bool)
    begins[0] = True
    np.not_equal(kinds[1:], kinds[:-1], out=begins[1:])
    begins[offsets[:-1][offsets[:-1] < n]] = True
    edges = np.flatnonzero(begins)
    ends = np.append(edges[1:], n)
    inside = kinds[edges] != 0
    starts, ends = edges[inside], ends[inside]
    powers, inverse = _tables(n + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(n + 1, np.uint64)
        values = (LOWER[data] if lower else data).astype(np.uint64)
        values += np.uint64(1)
        values *= powers[:n]
        np.cumsum(values, out=sums[1:])
        h = (sums[ends] - sums[starts]) * inverse[starts]
        h += (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    owner = np.searchsorted(offsets, starts, "right") - 1
    return mix(h), owner


def joined(h: np.ndarray, owner: np.ndarray, gap: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the pairs of words gap apart within a text, with their text."""
    if len(h) <= gap:
        return h[:0], owner[:0]
    same = owner[gap:] == owner[:-gap]
    with np.errstate(over="ignore"):
        pairs = mix(h[:-gap][same], seed) * np.uint64(0x9FB21C651E98DF25) + h[gap:][same]
    return mix(pairs, seed), owner[gap:][same]


def runs(h: np.ndarray, owner: np.ndarray, n_texts: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words; a text with 1 to k - 1 words gives its whole sequence as one run."""
    counts = np.bincount(owner, minlength=n_texts)
    first = np.zeros(n_texts, np.int64)
    np.cumsum(counts[:-1], out=first[1:])
    with np.errstate(over="ignore"):
        if len(h) >= k:
            whole = h[: len(h) - k + 1].copy()
            for i in range(1, k):
                whole = mix(whole, i) * np.uint64(0x9FB21C651E98DF25) + h[i : len(h) - k + 1 + i]
            full = owner[: len(owner) - k + 1] == owner[k - 1 :]
            out, whose = mix(whole[full], k), owner[: len(owner) - k + 1][full]
        else:
            out, whose = h[:0], owner[:0]
        short = np.flatnonzero((counts > 0) & (counts < k))
        if len(short):
            one = h[first[short]].copy()
            for i in range(1, k - 1):
                longer = counts[short] > i
                one[longer] = mix(one[longer], i) * np.uint64(0x9FB21C651E98DF25) + h[first[short[longer]] + i]
            out = np.concatenate([out, mix(one, 1000) + counts[short].astype(np.uint64)])
            whose = np.concatenate([whose, short])
            order = np.argsort(whose, kind="stable")
            out, whose = out[order], whose[order]
    return out, whose
