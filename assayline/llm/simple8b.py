"""Simple-8b: word-aligned coding of integers, vectorised over blocks.

Each 64-bit word has a selector in its top 4 bits; the other 60 bits hold as many ids
of one width as fit. Blocks of BLOCK ids are coded alone, and the directory has the
first word of each, so any block can be decoded without the ones before it. An id of
more than 60 bits is an escape: its word holds a place in the list of exceptions.

Layout of a segment, all little-endian: magic, 6 unsigned 64-bit counts (ids, blocks,
words, exceptions, documents, checksum), then document ids (int64), their presence
(uint8), their lengths (uint32), the block directory (uint32, blocks + 1), words
(uint64) and exceptions (uint64). A file is a run of segments; no document is split.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np

MAGIC = b"ALS8B\x00\x00\x01"
BLOCK = 1024
#: Fixed values of the format: ids in a word and bits of an id, by selector. 0 is the escape, 15 a run of zeros.
COUNTS = np.array([1, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1, 120], np.int64)
BITS = np.array([60, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60, 0], np.int64)
ESCAPE, ZEROS = 0, 15
_HEADER = len(MAGIC) + 6 * 8
_WIDTHS = np.frexp(np.arange(1 << 16, dtype=np.float64))[1].astype(np.uint8)


def _widths(ids: np.ndarray) -> np.ndarray:
    """Bits that each id needs."""
    if ids.dtype == np.uint32:
        out = _WIDTHS[ids & np.uint32(0xFFFF)]
        high = ids >> np.uint32(16)
        big = np.flatnonzero(high)
        out[big] = 16 + _WIDTHS[high[big]]
        return out
    out = np.zeros(len(ids), np.uint8)
    high = (ids >> np.uint64(32)).astype(np.uint32)
    np.copyto(out, _widths((ids & np.uint64(0xFFFFFFFF)).astype(np.uint32)))
    big = high > 0
    out[big] = 32 + _widths(high[big])
    return out


def encode(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, block directory, exceptions) of unsigned ids."""
    n = len(ids)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(1, np.uint32), np.zeros(0, np.uint64)
    blocks = -(-n // BLOCK)
    # Beyond a block's end ids count as width 0, so that the last word of a block may run over it.
    width = np.zeros((blocks, BLOCK + int(COUNTS.max())), np.uint8)
    flat = np.zeros(blocks * BLOCK, np.uint8)
    flat[:n] = _widths(ids)
    width[:, :BLOCK] = flat.reshape(blocks, BLOCK)
    best = np.zeros((blocks, BLOCK), np.uint8)  # stays at the escape where nothing fits
    most, span = width, 1
    for s in [*range(14, 0, -1), ZEROS]:  # from one id a word to the most
        while span < COUNTS[s]:
            step = min(span, int(COUNTS[s]) - span)
            most = np.maximum(most[:, :-step], most[:, step:])
            span += step
        np.copyto(best, s, where=most[:, :BLOCK] <= BITS[s])
    jump = COUNTS[best]
    at = np.zeros(blocks, np.int64)
    live = np.arange(blocks)
    begins = np.zeros(blocks * BLOCK, bool)
    while len(live):
        begins[live * BLOCK + at] = True
        at = at + jump[live, at]
        inside = (at < BLOCK) & (live * BLOCK + at < n)
        live, at = live[inside], at[inside]
    start = np.flatnonzero(begins)
    row = start // BLOCK
    selector = best.reshape(-1)[start].astype(np.int64)
    padded = np.zeros(blocks * BLOCK + int(COUNTS.max()), np.uint64)
    padded[:n] = ids
    room = np.minimum((row + 1) * BLOCK, n) - start
    words = selector.astype(np.uint64) << np.uint64(60)
    for s in range(1, 15):
        own = np.flatnonzero(selector == s)
        if len(own):
            k = np.arange(COUNTS[s])
            value = padded[start[own][:, None] + k]
            cut = np.flatnonzero(room[own] < COUNTS[s])
            value[cut] *= k < room[own[cut]][:, None]
            value <<= (k * BITS[s]).astype(np.uint64)
            words[own] |= np.bitwise_or.reduce(value, axis=1)
    escapes = np.flatnonzero(selector == ESCAPE)
    words[escapes] = np.arange(len(escapes), dtype=np.uint64)
    directory = np.searchsorted(row, np.arange(blocks + 1)).astype(np.uint32)
    return words, directory, padded[start[escapes]]


def decode(words: np.ndarray, directory: np.ndarray, exceptions: np.ndarray, n: int) -> np.ndarray:
    """The n ids, all blocks at once."""
    out = np.zeros(n, np.uint64)
    if not n:
        return out
    selector = (words >> np.uint64(60)).astype(np.int64)
    count = COUNTS[selector]
    before = np.cumsum(count) - count
    block = np.repeat(np.arange(len(directory) - 1), np.diff(directory.astype(np.int64)))
    start = block * BLOCK + before - before[directory[:-1].astype(np.int64)][block]
    end = np.minimum((block + 1) * BLOCK, n)
    for s in range(1, 15):
        own = np.flatnonzero(selector == s)
        if not len(own):
            continue
        mask = np.uint64((1 << int(BITS[s])) - 1)
        value, first, last = words[own], start[own], end[own]
        for k in range(int(COUNTS[s])):
            inside = first + k < last
            out[first[inside] + k] = (value[inside] >> np.uint64(k * int(BITS[s]))) & mask
    own = np.flatnonzero(selector == ESCAPE)
    out[start[own]] = exceptions[words[own].astype(np.int64)]
    return out


def pack(doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray) -> bytes:
    """One segment."""
    words, directory, exceptions = encode(ids)
    body = b"".join(
        (
            np.array([x or 0 for x in doc_ids], "<i8").tobytes(),
            np.array([x is not None for x in doc_ids], np.uint8).tobytes(),
            np.asarray(lengths).astype("<u4").tobytes(),
            directory.astype("<u4").tobytes(),
            words.astype("<u8").tobytes(),
            exceptions.astype("<u8").tobytes(),
        )
    )
    counts = np.array([len(ids), len(directory) - 1, len(words), len(exceptions), len(doc_ids), zlib.crc32(body)], "<u8")
    return MAGIC + counts.tobytes() + body


def unpack(data: bytes) -> Iterator[tuple[list[int | None], np.ndarray, np.ndarray]]:
    """(document ids, lengths, ids) of each segment of a file. A damaged segment raises ValueError."""
    at = 0
    while at < len(data):
        if data[at : at + len(MAGIC)] != MAGIC:
            raise ValueError(f"no segment at byte {at}")
        n, blocks, n_words, n_exceptions, docs, checksum = map(int, np.frombuffer(data, "<u8", 6, at + len(MAGIC)))
        at += _HEADER
        sizes = (docs * 8, docs, docs * 4, (blocks + 1) * 4, n_words * 8, n_exceptions * 8)
        body = memoryview(data)[at : at + sum(sizes)]
        if len(body) != sum(sizes) or zlib.crc32(body) != checksum:
            raise ValueError(f"damaged segment before byte {at}")
        cut = np.cumsum((0, *sizes))
        ids, present, lengths, directory, words, exceptions = (np.frombuffer(body[cut[i] : cut[i + 1]], t) for i, t in enumerate(("<i8", np.uint8, "<u4", "<u4", "<u8", "<u8")))
        yield [int(i) if p else None for i, p in zip(ids, present, strict=True)], lengths, decode(words, directory, exceptions, n)
        at += sum(sizes)
