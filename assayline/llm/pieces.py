"""SentencePiece BPE, encoded by rounds of merges over flat numpy arrays, and decoded.

Each round finds the best rank of a pair in every word still being merged and merges all its leftmost places at once,
then takes the array together; words without a pair leave it. This is what the library's queue does one merge at a
time: merges of one rank go from left to right, and only where a merge makes a pair that is as good or better at once
do the places after it wait for the next round. A word ends before a run of spaces, and where two characters follow
each other that no piece holds side by side; no merge crosses such a place.

Texts that are null or empty have no ids and decode to the empty text. Rows of equal id or text each give their own
row; no row gives no rows. The input's other columns are not looked at, whatever their names.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from assayline.llm.shared import short_batches
from assayline.sources.tables import ship, table


@dataclass(frozen=True)
class PieceConfig:
    """model: a file of public_tokenizers, or a path. portion_bytes: text that is merged at once; a longer text goes
    alone. long_word: symbols from which a word is looked at for places that no piece spans."""

    model: str = "piece_bpe_32k.model"
    portion_bytes: int = 4 << 20
    long_word: int = 64


SPACE = 0x2581
NONE = np.iinfo(np.int32).max
#: Of codes of pairs: left symbol times this, plus right symbol.
WIDTH = 1 << 22
#: What must come out of the model's normaliser as it went in, but for spaces.
PROBE = "  A ﬁ é　\t\x00​Ａ "


class PieceModel:
    """Tables of a BPE model with byte fall-back and no normalisation but that of spaces.

    Symbols are ids of pieces; characters that are no piece follow them, by code point.
    """

    def __init__(self, cfg: PieceConfig):
        import sentencepiece

        path = cfg.model
        if not os.path.isabs(path):
            import public_tokenizers

            path = public_tokenizers.path(path)
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        if sp.normalize(PROBE) != chr(SPACE) + PROBE.replace(" ", chr(SPACE)):
            raise ValueError(f"{path} changes texts before it encodes them")
        self.cfg, self.size = cfg, sp.get_piece_size()
        kinds = [sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) for i in range(self.size)]
        self.byte = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int64)
        if not all(map(sp.is_byte, self.byte.tolist())):
            raise ValueError(f"{path} has no bytes to fall back on")
        pieces = {sp.id_to_piece(i): i for i in range(self.size) if not kinds[i]}
        ranks = {s: r for r, s in enumerate(sorted({sp.get_score(i) for i in pieces.values()}, reverse=True))}
        # The symbol of each code point.
        self.symbol = np.arange(0x110000, dtype=np.int64) + self.size
        for piece, i in pieces.items():
            if len(piece) == 1:
                self.symbol[ord(piece)] = i
        code = {c: int(self.symbol[ord(c)]) for piece in pieces for c in piece}
        splits = [(pieces.get(p[:k], code[p[0]]) * WIDTH + pieces.get(p[k:], code[p[-1]]), i, ranks[sp.get_score(i)])
                  for p, i in pieces.items() for k in range(1, len(p))
                  if (k == 1 or p[:k] in pieces) and (k == len(p) - 1 or p[k:] in pieces)]
        table_ = np.array(sorted(splits), np.int64).reshape(-1, 3)
        self.pair, self.merged, self.rank = table_[:, 0].copy(), table_[:, 1].copy(), table_[:, 2].astype(np.int32)
        self.bits = 22
        self.filter = np.zeros(1 << self.bits, bool)
        self.filter[self.slot(self.pair)] = True
        self.beside = np.unique(np.array([code[a] * WIDTH + code[b] for p in pieces for a, b in zip(p, p[1:], strict=False)], np.int64))
        if any(SPACE in map(ord, p.lstrip(chr(SPACE))) for p in pieces):
            raise ValueError(f"{path} has pieces over several words")
        blanks = {len(p): sp.get_score(i) for p, i in pieces.items() if set(p) == {chr(SPACE)} and len(p) > 1}
        others = [sp.get_score(i) for p, i in pieces.items() if len(p) > 1 and set(p) != {chr(SPACE)}]
        # Where runs of spaces are merged after all else, and from their left, the longest such piece can be cut off
        # the left of a run, if that is what merges make of one twice as long.
        self.blank = 0
        if blanks and len(set(blanks.values())) == 1 and max(blanks.values()) < min(others, default=0.0):
            longest = max(blanks)
            got, _ = self.merge(np.repeat(self.symbol[SPACE], 2 * longest), np.zeros(1, np.int64))
            self.blank = longest if got[0] == pieces[chr(SPACE) * longest] else 0
        # What each id decodes to.
        shown = [b"" if sp.is_control(i) else sp.decode([i]).encode() if sp.is_unknown(i) else
                 sp.id_to_piece(i).replace(chr(SPACE), " ").encode() for i in range(self.size)]
        for value, i in enumerate(self.byte.tolist()):
            shown[i] = bytes([value])
        self.shown_size = np.array(list(map(len, shown)), np.int64)
        self.shown_start = np.cumsum(self.shown_size) - self.shown_size
        self.shown = np.frombuffer(b"".join(shown), np.uint8)
        self.names = list(map(str, range(self.size)))

    def slot(self, pair: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((pair.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def look(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, symbol) of the piece that each pair makes; NONE where there is none."""
        pair = left * WIDTH + right
        rank, merged = np.full(len(pair), NONE, np.int32), np.zeros(len(pair), np.int64)
        may = np.flatnonzero(self.filter[self.slot(pair)])
        at = np.minimum(np.searchsorted(self.pair, pair[may]), len(self.pair) - 1)
        is_ = self.pair[at] == pair[may]
        may, at = may[is_], at[is_]
        rank[may], merged[may] = self.rank[at], self.merged[at]
        return rank, merged

    def merge(self, sym: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(symbols, first place of each word) after all merges, for words given one after the other."""
        n_words = len(starts)
        word = np.repeat(np.arange(n_words), np.diff(starts, append=len(sym)))
        done_sym: list[np.ndarray] = []
        done_word: list[np.ndarray] = []

        def ranks(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            rank, merged = np.full(len(at), NONE, np.int32), np.zeros(len(at), np.int64)
            inside = np.flatnonzero(at + 1 < len(sym))
            inside = inside[word[at[inside]] == word[at[inside] + 1]]
            rank[inside], merged[inside] = self.look(sym[at[inside]], sym[at[inside] + 1])
            return rank, merged

        rank, merged = ranks(np.arange(len(sym)))
        while len(sym):
            first = np.flatnonzero(np.diff(word, prepend=-1))
            sizes = np.diff(first, append=len(sym))
            best = np.minimum.reduceat(rank, first)
            over = best == NONE
            if over.any():
                out = np.repeat(over, sizes)
                done_sym.append(sym[out]), done_word.append(word[out])
                left = ~out
                sym, word, rank, merged = sym[left], word[left], rank[left], merged[left]
                if not len(sym):
                    break
                sizes, best = sizes[~over], best[~over]
            hit = np.flatnonzero(rank == np.repeat(best, sizes))
            # Of places that overlap, every other one from the left.
            chain = np.ones(len(hit), bool)
            chain[1:] = hit[1:] != hit[:-1] + 1
            begin = np.flatnonzero(chain)
            hit = hit[(np.arange(len(hit)) - np.repeat(begin, np.diff(begin, append=len(hit)))) % 2 == 0]
            hit = self.undisturbed(sym, word, rank, merged, hit)
            sym[hit] = merged[hit]
            stay = np.ones(len(sym), bool)
            stay[hit + 1] = False
            changed = np.zeros(len(sym), bool)
            changed[hit] = True
            # The place before a merged one also makes a new pair; it is that place or the one before, itself gone.
            before = hit[hit > 0] - 1
            changed[before - ~stay[before]] = True
            sym, word, rank, merged, changed = sym[stay], word[stay], rank[stay], merged[stay], np.flatnonzero(changed[stay])
            rank[changed], merged[changed] = ranks(changed)
        sym = np.concatenate(done_sym) if done_sym else sym
        word = np.concatenate(done_word) if done_word else word
        order = np.argsort(word, kind="stable")
        return sym[order], np.searchsorted(word[order], np.arange(n_words))

    def undisturbed(self, sym: np.ndarray, word: np.ndarray, rank: np.ndarray, merged: np.ndarray, hit: np.ndarray) -> np.ndarray:
        """hit without the places of a word after one whose merge makes a pair of the same rank or a better one."""
        new = np.ones(len(hit), bool)
        new[1:] = word[hit[1:]] != word[hit[:-1]]
        several = ~new
        several[:-1] |= ~new[1:]
        k = np.flatnonzero(several)  # places in words with several
        if not len(k):
            return hit
        at, whole = hit[k], merged[hit[k]]
        # On the left lies the symbol before, or what the place before has become.
        left_at = np.maximum(at - 1, 0)
        joined = np.zeros(len(k), bool)
        joined[1:] = at[1:] == at[:-1] + 2
        left = sym[left_at]
        left[joined] = whole[np.flatnonzero(joined) - 1]
        right_at = np.minimum(at + 2, len(sym) - 1)
        worse = np.full(len(k), NONE, np.int32)
        inside = np.flatnonzero((at > 0) & (word[left_at] == word[at]))
        worse[inside] = self.look(left[inside], whole[inside])[0]
        inside = np.flatnonzero((at + 2 < len(sym)) & (word[right_at] == word[at]))
        worse[inside] = np.minimum(worse[inside], self.look(whole[inside], sym[right_at[inside]])[0])
        disturbed = worse <= rank[at]
        if not disturbed.any():
            return hit
        # Places after the first such one of their word go.
        begin = np.flatnonzero(new[k])
        upto = np.cumsum(disturbed) - disturbed
        after = upto - np.repeat(upto[begin], np.diff(begin, append=len(k)))
        gone = np.zeros(len(hit), bool)
        gone[k[after > 0]] = True
        return hit[~gone]

    def word_starts(self, sym: np.ndarray, points: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Where words begin, in texts given one after the other that begin at starts."""
        blank = points == SPACE
        begin = np.zeros(len(sym), bool)
        begin[starts] = True
        begin[1:] |= blank[1:] & ~blank[:-1]
        if self.blank:
            # Of runs of spaces longer than the longest such piece, a piece after the other from the left.
            edge = np.flatnonzero(blank & ~np.concatenate([[False], blank[:-1] & ~begin[1:]]))
            if len(edge):
                since = np.arange(len(sym)) - edge[np.maximum(np.searchsorted(edge, np.arange(len(sym)), "right") - 1, 0)]
                run = blank & (since % self.blank == 0) & (since > 0)
                begin |= run
        at = np.flatnonzero(begin)
        sizes = np.diff(at, append=len(sym))
        if (sizes > self.cfg.long_word).any():
            inside = np.flatnonzero(np.repeat(sizes > self.cfg.long_word, sizes) & ~begin)
            pair = sym[inside - 1] * WIDTH + sym[inside]
            found = self.beside[np.minimum(np.searchsorted(self.beside, pair), len(self.beside) - 1)] == pair
            begin[inside[~found]] = True
            at = np.flatnonzero(begin)
        return at

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, one after the other; ids of each text)."""
        whole = "".join([chr(SPACE) + t for t in texts if t])
        points = np.frombuffer(whole.encode("utf-32-le"), "<u4").astype(np.int64)
        points[points == 0x20] = SPACE
        sizes = np.array([len(t) + 1 if t else 0 for t in texts], np.int64)
        if not len(points):
            return np.zeros(0, np.int64), sizes
        sym = self.symbol[points]
        first_of_text = (np.cumsum(sizes) - sizes)[sizes > 0]
        at = self.word_starts(sym, points, first_of_text)
        distinct, which = self.distinct(sym, at)
        some, some_sizes = at[distinct], np.diff(at, append=len(sym))[distinct]
        flat = np.repeat(some - (np.cumsum(some_sizes) - some_sizes), some_sizes) + np.arange(int(some_sizes.sum()))
        got, first = self.merge(sym[flat], np.cumsum(some_sizes) - some_sizes)
        got, first = self.spell(got, first)
        counts = np.diff(first, append=len(got))
        per_word = counts[which]
        ids = got[np.repeat(first[which] - (np.cumsum(per_word) - per_word), per_word) + np.arange(int(per_word.sum()))]
        out = np.zeros(len(texts), np.int64)
        out[sizes > 0] = np.add.reduceat(per_word, np.searchsorted(at, first_of_text))
        return ids, out

    @staticmethod
    def distinct(sym: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(one place in at of each distinct word, the distinct word of each): by hash, then symbol by symbol."""
        sizes = np.diff(at, append=len(sym))
        with np.errstate(over="ignore"):
            place = (np.arange(len(sym)) - np.repeat(at, sizes)).astype(np.uint64)
            h = (sym.astype(np.uint64) + np.uint64(1)) * (place * np.uint64(0xD6E8FEB86659FD93) + np.uint64(0x9E3779B97F4A7C15) | np.uint64(1))
            h ^= h >> np.uint64(29)
            h *= np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(32)
            h = np.add.reduceat(h, at) + sizes.astype(np.uint64)
        _, kept, which = np.unique(h, return_index=True, return_inverse=True)
        like = at[kept[which]]
        equal = sizes == sizes[kept[which]]
        if equal.all():
            equal = (sym == sym[np.repeat(like - at, sizes) + np.arange(len(sym))]).all()
        if not np.all(equal):  # two words of one hash: each on its own
            kept = which = np.arange(len(at))
        return kept, which

    def spell(self, sym: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Characters that are no piece, as their bytes."""
        odd = np.flatnonzero(sym >= self.size)
        if not len(odd):
            return sym, first
        spelt = [self.byte[list(chr(c - self.size).encode())] for c in sym[odd].tolist()]
        sizes = np.ones(len(sym), np.int64)
        sizes[odd] = list(map(len, spelt))
        ends = np.cumsum(sizes)
        out = np.repeat(sym, sizes)
        out[np.repeat(ends[odd] - sizes[odd] - (np.cumsum(sizes[odd]) - sizes[odd]), sizes[odd]) + np.arange(int(sizes[odd].sum()))] = np.concatenate(spelt)
        return out, np.append(0, ends)[first]

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """The text of each run of ids, in UTF-8, for ids without control symbols; bytes that form no character each
        become U+FFFD."""
        sizes = self.shown_size[ids]
        ends = np.cumsum(sizes)
        raw = self.shown[np.repeat(self.shown_start[ids] - (ends - sizes), sizes) + np.arange(int(sizes.sum()))].tobytes()
        bound = np.append(0, ends)[np.append(0, np.cumsum(counts))].tolist()
        texts = [raw[a:b] for a, b in zip(bound, bound[1:], strict=False)]
        return [_valid(t[1:] if t[:1] == b" " else t) for t in texts]  # the first space is the encoder's


def _valid(text: bytes) -> bytes:
    try:
        text.decode()
        return text
    except UnicodeDecodeError:
        out = []
        while text:
            try:
                out.append(text.decode())
                break
            except UnicodeDecodeError as e:
                out += [text[: e.start].decode(), "�"]
                text = text[e.start + 1 :]
        return "".join(out).encode()


@lru_cache(maxsize=1)
def model_of(cfg: PieceConfig) -> PieceModel:
    """The model's tables in this Python worker, which its next tasks use too."""
    return PieceModel(cfg)


def portions(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[list[int | None], list[str]]]:
    """(ids, texts) of at most so many characters of text, one text at least."""
    names: list[int | None] = []
    texts: list[str] = []
    size = 0
    for b in batches:
        for name, text in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
            t = text.as_py() or ""
            if texts and size + len(t) > most:
                yield names, texts
                names, texts, size = [], [], 0
            names.append(name), texts.append(t)
            size += len(t)
    if texts:
        yield names, texts


def encoded(docs: DataFrame, cfg: PieceConfig = PieceConfig()) -> DataFrame:
    """(doc_id, ids, decoded) of each row of docs (doc_id, text): the ids of its text, and the text they decode to."""
    short_batches(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of(cfg)
        for names, texts in portions(batches, cfg.portion_bytes):
            ids, counts = model.encode(texts)
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)), pa.int32()), pa.array(ids, pa.int32()))
            decoded = pa.array([t.decode() for t in model.decode(ids, counts)], pa.string())
            yield pa.record_batch([pa.array(names, pa.int64()), lists, decoded], ["doc_id", "ids", "decoded"])

    return docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(work, "doc_id long, ids array<int>, decoded string")


def piece_digests(docs: DataFrame, cfg: PieceConfig = PieceConfig()) -> DataFrame:
    """Number and digests of what encoded() gives for each row, worked out where the ids are, so that none leaves its task."""
    short_batches(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of(cfg)
        for names, texts in portions(batches, cfg.portion_bytes):
            ids, counts = model.encode(texts)
            said = [model.names[i] for i in ids.tolist()]
            ends = np.cumsum(counts).tolist()
            listed = [hashlib.sha256(",".join(said[e - n : e]).encode()).hexdigest() for e, n in zip(ends, counts.tolist(), strict=True)]
            back = [hashlib.sha256(t).hexdigest() for t in model.decode(ids, counts)]
            yield pa.record_batch([pa.array(names, pa.int64()), pa.array(counts, pa.int64()), pa.array(listed), pa.array(back)],
                                  ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(work, schema)


def op12_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every whole text and what they decode to, as digests."""
    ship(spark)
    return piece_digests(table(spark, sf_dir, "documents").select("doc_id", "text"))
