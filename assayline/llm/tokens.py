"""Token-ID output: whole texts through a public tokenizer into Simple-8b shards, and back.

Documents are dealt into ranges of doc_id, each range into one shard file in ascending
order; ids equal, repeated rows follow each other by text. Null and empty texts give
the end id alone; a null doc_id sorts first and comes back null. No document at all
gives no rows.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assayline.llm import simple8b
from assayline.llm.binary import write_whole
from assayline.llm.shared import give_back, short_batches, stored, work_path
from assayline.sources.tables import ship, table


@dataclass(frozen=True)
class TokenConfig:
    """vocabulary: a file of public_tokenizers, or a path. segment_ids: ids after which a segment ends.
    file_segments: segments of a file. known_chunks: the bound of a worker's memory of coded chunks. portion_bytes:
    text that goes through at once; a longer text goes alone."""

    vocabulary: str = "word_bpe_49k.json"
    end_id: int = 2
    segment_ids: int = 1 << 20
    file_segments: int = 16
    known_chunks: int = 700_000
    portion_bytes: int = 8 << 20


#: Stands between chunks that go through the tokenizer together; a chunk that holds it goes alone.
MARK = "\x01"
#: Chunks with this in them take the tokenizer's own normaliser: all beyond Latin letters, special tokens, the mark.
UNUSUAL = re.compile("[^\x02-\u012f]|<\\|")
PROBE = "".join(map(chr, (*range(0x21, 0x7F), *range(0xA1, 0x130))))


class ChunkEncoder:
    """Ids of texts through the tokenizers library.

    The tokenizer splits at white space before anything else, so the ids of a text are those of its chunks between
    spaces and line ends; each distinct chunk goes through the library once and is remembered.
    """

    def __init__(self, cfg: TokenConfig):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers

        path = cfg.vocabulary
        if not os.path.isabs(path):
            import public_tokenizers

            path = public_tokenizers.path(path)
        self.cfg, self.tokenizer = cfg, Tokenizer.from_file(path)
        # For plain chunks: the same tokenizer without its normaliser, whose work on them is to lower the case.
        self.plain = Tokenizer.from_file(path)
        self.plain.normalizer = normalizers.Sequence([])
        self.mark = self.plain.encode(MARK, add_special_tokens=False).ids
        # Whether the normaliser changes plain chunks by lower-casing only.
        self.lowers = self.tokenizer.normalizer is not None and self.tokenizer.normalizer.normalize_str(PROBE) == PROBE.lower()
        ids = lambda text: self.plain.encode(text, add_special_tokens=False).ids
        self.stops = frozenset(t for t in ".,;:!?" if ids("probe" + t) == ids("probe") + ids(t))
        self.empty()

    def forget(self) -> None:
        """Keeps only chunks that were met more than once, or none where these fill half of the memory."""
        kept = np.flatnonzero(self.uses[: len(self.place)] > 1)
        kept = kept[kept > 0] if len(kept) <= self.cfg.known_chunks // 2 else kept[:0]
        names = list(self.place)
        lengths = self.lengths[kept]
        chunks, flat, uses = [names[i] for i in kept.tolist()], self.ids_of(kept), self.uses[kept] // 2
        self.empty()
        self.remember(chunks, flat, lengths)
        self.uses[1 : len(uses) + 1] = uses

    def empty(self) -> None:
        self.place: dict[str, int] = {"": 0}
        self.filled = 0
        self.flat = np.zeros(1 << 16, np.uint32)
        self.starts, self.lengths, self.uses = (np.zeros(1 << 14, np.int64) for _ in range(3))

    def learn(self, chunks: list[str]) -> None:
        if len(self.mark) != 1 or not self.lowers:
            odd = chunks
        else:
            blocks = (chunks[k : k + 512] for k in range(0, len(chunks), 512))
            odd = [c for b in blocks if UNUSUAL.search("\n".join(b)) for c in b if UNUSUAL.search(c)]
        if odd:
            got = [e.ids for e in self.tokenizer.encode_batch_fast(odd, add_special_tokens=False)]
            self.remember(odd, np.fromiter((i for ids in got for i in ids), np.uint32), np.fromiter(map(len, got), np.int64, len(got)))
            chunks = [c for c in chunks if c not in self.place]
        # A chunk is its lower-case core and perhaps a stop after a letter; each distinct core goes through the library once.
        cores = [c.lower() for c in chunks]
        stops = [c[-1] if c[-1] in self.stops and c[-2:-1].isalpha() else "" for c in cores]
        cores = [c[:-1] if t else c for c, t in zip(cores, stops, strict=True)]
        units = [c for c in dict.fromkeys([*cores, *set(stops)]) if c not in self.place]
        flat, lengths = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for first in range(0, len(units), 512):
            some = units[first : first + 512]
            ids = np.array(self.plain.encode_batch_fast([f" {MARK} ".join(some) + f" {MARK}"], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.flatnonzero(ids == self.mark[0])
            flat.append(ids[ids != self.mark[0]])
            lengths.append(np.diff(ends, prepend=-1) - 1)
        self.remember(units, np.concatenate(flat), np.concatenate(lengths))
        parts = np.stack([self.places(cores), self.places(stops)], axis=1)
        left = [i for i, c in enumerate(chunks) if c not in self.place]
        self.remember([chunks[i] for i in left], self.ids_of(parts[left].ravel()), self.lengths[parts[left]].sum(axis=1))

    def ids_of(self, which: np.ndarray) -> np.ndarray:
        """The ids of known chunks, one after the other."""
        lengths = self.lengths[which]
        return self.flat[np.repeat(self.starts[which] - (np.cumsum(lengths) - lengths), lengths) + np.arange(int(lengths.sum()))]

    def remember(self, chunks: list[str], flat: np.ndarray, lengths: np.ndarray) -> None:
        first, known, more = self.filled, len(self.place), len(chunks)
        if first + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(len(self.flat) + len(flat), np.uint32)])
        if known + more > len(self.starts):
            self.starts, self.lengths, self.uses = (np.concatenate([a, np.zeros(len(a) + more, np.int64)]) for a in (self.starts, self.lengths, self.uses))
        self.flat[first : first + len(flat)] = flat
        self.starts[known : known + more] = first + np.cumsum(lengths) - lengths
        self.lengths[known : known + more] = lengths
        self.filled += len(flat)
        self.place.update(zip(chunks, range(known, known + more), strict=True))

    def places(self, chunks: list[str]) -> np.ndarray:
        """Where each chunk is remembered, or -1."""
        return np.fromiter(map(self.place.get, chunks, repeat(-1)), np.int64, len(chunks))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, each with the end id; ids of each text)."""
        split = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        sizes = np.diff(split.offsets.to_numpy())
        coded = split.flatten().dictionary_encode()  # from here on each distinct chunk of the batch once
        # No chunk holds a space, so that joining and splitting is the short way to Python's strings.
        whole = pa.ListArray.from_arrays([0, len(coded.dictionary)], coded.dictionary.cast(pa.string()))
        chunks = pc.binary_join(whole, " ")[0].as_py().split(" ") if len(coded.dictionary) else []
        place = self.places(chunks)
        new = np.flatnonzero(place < 0)
        if len(self.place) + len(new) > self.cfg.known_chunks:
            self.forget()
            place = self.places(chunks)
            new = np.flatnonzero(place < 0)
        if len(new):
            some = [chunks[i] for i in new.tolist()]
            self.learn(some)
            place[new] = self.places(some)
        self.uses[place] += np.bincount(coded.indices.to_numpy(), minlength=len(chunks))
        which = place[coded.indices.to_numpy()]
        lengths = self.lengths[which]
        upto = np.concatenate([[0], np.cumsum(lengths)])
        ends = np.cumsum(sizes)
        per_text = upto[ends] - upto[ends - sizes]
        out = np.full(int(per_text.sum()) + len(texts), self.cfg.end_id, np.uint32)
        inside = np.ones(len(out), bool)
        inside[np.cumsum(per_text + 1) - 1] = False
        out[inside] = self.ids_of(which)
        return out, per_text + 1


@lru_cache(maxsize=1)
def encoder_of(cfg: TokenConfig) -> ChunkEncoder:
    """The encoder of this Python worker, which its next tasks use too."""
    return ChunkEncoder(cfg)


def write_shards(docs: DataFrame, folder: str, cfg: TokenConfig = TokenConfig()) -> DataFrame:
    """Writes (doc_id, text) as shard files into folder; returns (part, file, n_docs, n_ids, n_bytes) of each file."""
    spark = docs.sparkSession
    short_batches(spark)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, encoder = TaskContext.get().partitionId(), 0, encoder_of(cfg)
        ids: list[np.ndarray] = []
        lengths: list[np.ndarray] = []
        names: list[int | None] = []
        held: list[bytes] = []
        docs_held = ids_held = 0

        def segment() -> None:
            nonlocal docs_held, ids_held
            if names:
                whole = np.concatenate(ids)
                held.append(simple8b.pack(names, np.concatenate(lengths), whole))
                docs_held, ids_held = docs_held + len(names), ids_held + len(whole)
                ids.clear(), lengths.clear(), names.clear()

        def file() -> pa.RecordBatch:
            nonlocal number, docs_held, ids_held
            name = f"part-{part:06d}-{number:04d}.s8b"
            size = write_whole(folder, name, held)
            row = pa.record_batch([[part], [name], [docs_held], [ids_held], [size]], ["part", "file", "n_docs", "n_ids", "n_bytes"])
            number, docs_held, ids_held = number + 1, 0, 0
            held.clear()
            return row

        for doc_ids, texts in _portions(batches, cfg.portion_bytes):
            got, n = encoder.encode(texts)
            ids.append(got), lengths.append(n), names.extend(doc_ids)
            if sum(map(len, ids)) >= cfg.segment_ids:
                segment()
                if len(held) >= cfg.file_segments:
                    yield file()
        segment()
        if held:
            yield file()
        give_back()

    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    schema = "part int, file string, n_docs long, n_ids long, n_bytes long"
    written = dealt.mapInArrow(lambda it: (_typed(b) for b in write(it)), schema)
    return stored(written, "token-manifest")


def _portions(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[list[int | None], pa.Array]]:
    """Rows again in portions of at most so many bytes of text, one row at least: large ones repeat fewer chunks."""
    names: list[int | None] = []
    held: list[pa.Array] = []
    size = 0
    for b in batches:
        texts = b.column("text").cast(pa.large_string()).fill_null("")
        doc_ids, ends = b.column("doc_id").to_pylist(), np.cumsum(pc.binary_length(texts).to_numpy())
        first = 0
        while first < len(texts):
            before = int(ends[first - 1]) if first else 0
            last = max(int(np.searchsorted(ends, before + most - size, "right")), first + (not held))
            if last > first:
                held.append(texts.slice(first, last - first))
                names += doc_ids[first:last]
                size += int(ends[last - 1]) - before
                first = last
            if first < len(texts):
                yield names, pa.concat_arrays(held)
                names, held, size = [], [], 0
    if held:
        yield names, pa.concat_arrays(held)


def _typed(b: pa.RecordBatch) -> pa.RecordBatch:
    return b.cast(pa.schema([("part", pa.int32()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("n_bytes", pa.int64())]))


def read_shards(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from the shard files of folder."""
    ship(spark)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column("path").to_pylist(), b.column("content"), strict=True):
                part, number = map(int, path.rsplit("/", 1)[-1].removesuffix(".s8b").split("-")[1:])
                first = 0
                for names, lengths, ids in simple8b.unpack(content.as_py()):
                    ends = np.cumsum(lengths.astype(np.int64))
                    raw = memoryview(ids.astype("<u4").tobytes())
                    starts = ends - lengths
                    crc = [zlib.crc32(raw[4 * s : 4 * e]) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
                    k = len(names)
                    yield pa.record_batch(
                        [pa.array([part * 10_000 + number] * k, pa.int64()), pa.array(names, pa.int64()), pa.array(first + starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(crc, pa.int64())],
                        ["shard", "doc_id", "local", "n_tokens", "ids_crc32"],
                    )
                    first += len(ids)
        give_back()

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.s8b").load(folder).select("path", "content")
    rows = stored(files.mapInArrow(read, "shard long, doc_id long, local long, n_tokens long, ids_crc32 long"), "token-index")
    sizes = rows.groupBy("shard").agg(F.sum("n_tokens").alias("n"))  # one row a file
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return rows.join(base, "shard").select("doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")


def token_output(spark: SparkSession, docs: DataFrame, cfg: TokenConfig = TokenConfig()) -> DataFrame:
    """Shards of docs written to a new folder and read back."""
    ship(spark)
    folder = work_path(spark, "tokens")
    if not write_shards(docs, folder, cfg).take(1):
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    return read_shards(spark, folder)


def op6_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files."""
    return token_output(spark, table(spark, sf_dir, "documents").select("doc_id", "text"))
