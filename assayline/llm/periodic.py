"""Runs of words that repeat with a period, by suffix trees of each text and of its reversal.

A run is a longest stretch of words with smallest period q and at least max(least, times * q) words. Every run has a
Lyndon root that is the longest Lyndon word at its place, in the order of the words or in the reverse order; those
words are read off the suffixes' order, and each is extended to both sides by common extensions in constant time.

Before the trees, stretches that cannot lie in a run go: each word of a run lies in three words in a row that occur
three times at least in the same stretch. Counts go by hashes, which may count too many and so keep too much, never
too little. What is left of a text is one sequence, with a symbol of its own in place of each gap.

Texts that are null, empty or without words have no runs and an empty collapsed text. Rows of equal id or text each
give their own row; no row gives no rows. A null doc_id counts as one that changes nothing. The input's other columns
are not looked at, whatever their names.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from assayline.llm.shared import short_batches
from assayline.llm.suffixtree import Extensions
from assayline.llm.wordhash import mix
from assayline.sources.tables import ship, table


@dataclass(frozen=True)
class RunConfig:
    """least: words of a run; times: periods of a run, 4 at least, as the words' filter counts on it. portion_bytes:
    text whose words are filtered at once; a longer text goes alone."""

    least: int = 6
    times: int = 4
    portion_bytes: int = 1 << 20

    def __post_init__(self) -> None:
        if self.least < 5 or self.times < 4:
            raise ValueError("runs have five words and four periods at least")


SCHEMA = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def planted(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words with the repetition that the query's contract plants in a tenth of the documents, by id."""
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    piece = words[a : a + p]
    return words[:a] + (piece * (-(-(n - a) // p)))[: n - a]


def repeated(ids: np.ndarray, piece: np.ndarray) -> np.ndarray:
    """Whether each word lies in three words of its piece that occur there three times (or share a bucket with some)."""
    keep = np.zeros(len(ids), bool)
    if len(ids) < 3:
        return keep
    with np.errstate(over="ignore"):
        h = mix(mix(mix(ids[:-2].astype(np.uint64)) + ids[1:-1].astype(np.uint64)) + ids[2:].astype(np.uint64)) + piece[:-2].astype(np.uint64)
    slots = 1 << max(12, int(len(h)).bit_length() + 2)
    slot = (mix(h) & np.uint64(slots - 1)).astype(np.int64)
    often = (np.bincount(slot, minlength=slots)[slot] >= 3) & (piece[:-2] == piece[2:])
    keep[:-2] |= often
    keep[1:-1] |= often
    keep[2:] |= often
    return keep


def stretches(ids: np.ndarray, owner: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(places of words that may lie in a run, piece of each): filtered until little more goes."""
    places, piece = np.arange(len(ids)), owner
    while len(places):
        keep = repeated(ids[places], piece)
        # A piece ends where a word goes or the piece before ended.
        cut = np.ones(len(places), bool)
        cut[1:] = (piece[1:] != piece[:-1]) | ~keep[1:] | ~keep[:-1]
        number = np.cumsum(cut)
        keep &= np.bincount(number)[number] >= least
        before = len(places)
        places, piece = places[keep], number[keep]
        if len(places) > 0.9 * before:
            break
    return places, piece


def lyndon_ends(rank: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Where the longest Lyndon word at each place ends, in the order of the ranks and in the reverse order."""
    n = len(rank)
    less, more = [n] * n, [n] * n
    down: list[int] = []
    up: list[int] = []
    for i, r in enumerate(rank):
        while down and rank[down[-1]] > r:
            less[down.pop()] = i
        while up and rank[up[-1]] < r:
            more[up.pop()] = i
        down.append(i), up.append(i)
    return np.array(less), np.array(more)


def runs_of(s: list[int], cfg: RunConfig) -> np.ndarray:
    """(start, length, period) of all runs of a sequence of numbers from 1, by start and then period."""
    n = len(s)
    sigma = max(s) + 1
    forth = Extensions([*s, 0], sigma)
    roots = [np.stack([np.arange(n), end[:n] - np.arange(n)], axis=1) for end in lyndon_ends(forth.rank.tolist())]
    found = np.concatenate(roots)
    found = found[(found[:, 1] * cfg.times <= n) & (found.sum(axis=1) < n)]
    i, p = found[:, 0], found[:, 1]
    end = i + p + forth.common(i, i + p)
    del forth
    back = Extensions([*s[::-1], 0], sigma)
    left = np.zeros(len(i), np.int64)
    inner = np.flatnonzero(i > 0)
    left[inner] = back.common(n - i[inner], n - i[inner] - p[inner])
    start = i - left
    whole = end - start >= np.maximum(cfg.least, cfg.times * p)
    rows = np.stack([start, end - start, p], axis=1)[whole]
    rows = np.unique(rows, axis=0)
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def document_runs(texts: list[list[bytes]], cfg: RunConfig = RunConfig()) -> list[np.ndarray]:
    """The runs of each of several texts, given as words."""
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for words in texts for w in words], np.int64)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    owner = np.repeat(np.arange(len(texts)), sizes)
    places, piece = stretches(ids, owner, cfg.least)
    out = [np.zeros((0, 3), np.int64)] * len(texts)
    if not len(places):
        return out
    first = np.cumsum(sizes) - sizes
    edges = np.flatnonzero(np.diff(owner[places], prepend=-1))
    for low, high in zip(edges, np.append(edges[1:], len(places)), strict=True):
        doc = int(owner[places[low]])
        at, part = places[low:high] - first[doc], piece[low:high]
        # A symbol of its own goes before each piece but the first.
        gaps = np.flatnonzero(part[1:] != part[:-1]) + 1
        _, symbol = np.unique(ids[places[low:high]], return_inverse=True)
        symbol, at = symbol + 1, np.insert(at, gaps, -1)
        found = runs_of(np.insert(symbol, gaps, symbol.max() + 1 + np.arange(len(gaps))).tolist(), cfg)
        if len(found):
            found[:, 0] = at[found[:, 0]]
            out[doc] = found
    return out


def digest(doc_id: int | None, words: list[bytes], runs: np.ndarray) -> tuple:
    """The row of one document."""
    gone = np.zeros(len(words) + 1, np.int64)
    np.add.at(gone, runs[:, 0] + runs[:, 2], 1)
    np.add.at(gone, runs[:, 0] + runs[:, 1], -1)
    left = words if not len(runs) else [w for w, g in zip(words, np.cumsum(gone[:-1]).tolist(), strict=True) if not g]
    rows = runs.tolist()
    listed = "".join(f"{a},{b},{c}\n" for a, b, c in rows).encode()
    best: list[int | None] = [None, None, None]
    for row in rows:  # by start, then period, so that the first of equal exponents stays
        if best[0] is None or row[1] * best[2] > best[1] * row[2]:
            best = row
    milli = None if best[0] is None else 1000 * best[1] // best[2]
    return doc_id, len(rows), *best, milli, hashlib.sha256(listed).hexdigest(), hashlib.sha256(b" ".join(left)).hexdigest()


def periodic_runs(docs: DataFrame, cfg: RunConfig = RunConfig(), plant: bool = False) -> DataFrame:
    """One row for each row of docs (doc_id, text): its runs' number, the one of greatest exponent, digests.

    Each text is read where it lies: no exchange, and no more at once than portion_bytes or one text. plant puts the
    contract's repetitions in first.
    """
    short_batches(docs.sparkSession)

    def batch(held: list[tuple[int | None, list[bytes]]]) -> pa.RecordBatch:
        rows = [digest(d, w, r) for (d, w), r in zip(held, document_runs([w for _, w in held], cfg), strict=True)]
        kinds = [pa.int64()] * 6 + [pa.string()] * 2
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int | None, list[bytes]]] = []
        size = 0
        for b in batches:
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").cast(pa.large_binary()), strict=True):
                raw = text.as_py() or b""
                if held and size + len(raw) > cfg.portion_bytes:
                    yield batch(held)
                    held, size = [], 0
                words = raw.split()  # at 0x20 and 0x09 to 0x0D
                held.append((doc_id, planted(words, doc_id) if plant else words))
                size += len(raw)
        if held:
            yield batch(held)

    return docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(work, SCHEMA)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every document, with the planted repetitions."""
    ship(spark)
    return periodic_runs(table(spark, sf_dir, "documents").select("doc_id", "text"), plant=True)
