"""Spelling variants: words one edit apart, found by asymmetric chunks, and the form and root of each.

Of two words that may be near, the shorter one (of equal lengths, the one that sorts first) gives two disjoint chunks,
its halves, and the other its positional grams of the same sizes. One edit leaves a half as it is: the first one stays
at its place, the second one at its place or, after an inserted letter, one further on. Those shifts are the only ones
that can pair, so that only grams at them become rows; pairs that share a half are then compared, and those of
distance one are links.

A frequent half is one key of many rows. Keys with more than `bucket` grams are dealt into parts, and their chunks
to each of them, so that a task never holds more than a bucket of one key; nothing is left out.

Null and empty texts have no words. Rows of equal id or text count each; no row gives no rows. A null doc_id changes no
letter. Of equal counts, the word that sorts first by code points is the form. The input's other columns are not looked
at, whatever their names.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assayline.llm.shared import discard, short_batches, stored
from assayline.sources.tables import ship, table


@dataclass(frozen=True)
class VariantConfig:
    """least_points, least_count: of a word. times: how often the form must occur, counted in the word's occurrences.
    bucket: grams of one key that a task compares at most with a chunk. portion_bytes: text counted at once; a longer
    text goes alone."""

    least_points: int = 5
    least_count: int = 3
    times: int = 2
    bucket: int = 2048
    portion_bytes: int = 4 << 20


def letters(raw: bytes) -> list[bytes]:
    """Longest runs of A-Z, a-z and U+00C0 to U+00FF (in UTF-8 C3 80 to C3 BF), only A-Z in lower case."""
    b = np.frombuffer(raw.lower(), np.uint8)
    kept = (b >= 0x61) & (b <= 0x7A)
    latin = b == 0xC3
    kept |= latin
    kept[1:] |= latin[:-1]
    return np.where(kept, b, np.uint8(0x20)).tobytes().split()


def altered(word: bytes, h: int) -> bytes:
    """The word without one of its letters, which h chooses."""
    text = word.decode()
    at = h % len(text)
    return (text[:at] + text[at + 1 :]).encode()


def word_counts(docs: DataFrame, cfg: VariantConfig = VariantConfig(), plant: bool = False) -> DataFrame:
    """(word, n) of the words of docs (doc_id, text). plant first deletes letters as the query's contract says."""
    short_batches(docs.sparkSession)

    def count(held: list[tuple[int | None, bytes]]) -> pa.RecordBatch:
        seen: Counter[bytes] = Counter()
        for doc_id, raw in held:
            words = letters(raw)
            if plant and doc_id is not None:
                before = zlib.crc32(f"{doc_id}:".encode())
                marks = [zlib.crc32(w, before) for w in words]
                for i in [i for i, h in enumerate(marks) if not h % 97]:
                    words[i] = altered(words[i], marks[i])
            seen.update(words)
        least = cfg.least_points
        some = [w for w in seen if len(w) >= least and (len(w) >= 2 * least or len(w) - w.count(b"\xc3") >= least)]
        return pa.record_batch([pa.array(some, pa.binary()).cast(pa.string()), pa.array([seen[w] for w in some], pa.int64())], ["word", "n"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int | None, bytes]] = []
        size = 0
        for b in batches:
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").cast(pa.large_binary()), strict=True):
                raw = text.as_py() or b""
                if held and size + len(raw) > cfg.portion_bytes:
                    yield count(held)
                    held, size = [], 0
                held.append((doc_id, raw))
                size += len(raw)
        if held:
            yield count(held)

    counted = docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(work, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= cfg.least_count)


def _key(length: Column, half: int, chunk: Column) -> Column:
    return F.xxhash64(length, F.lit(half), chunk)


def near_pairs(words: DataFrame, cfg: VariantConfig = VariantConfig()) -> DataFrame:
    """(word, n, other, other_n) of all pairs of words (word, n) at a distance of one edit, each pair once, the shorter first."""
    size = F.char_length("word")
    # One bit for each letter that occurs an odd number of times (letters share bits): an edit changes two at most.
    odd = F.aggregate(F.split("word", ""), F.lit(0).cast("long"), lambda m, c: m.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.ascii(c).bitwiseAND(63))))
    known = words.select("word", "n", size.alias("size"), odd.alias("odd"))
    half = F.floor(F.col("size") / 2).cast("int")
    chunks = known.select(
        "word", "n", "odd", "size", half.alias("half"),
        F.posexplode(F.array(_key(F.col("size"), 0, F.expr("left(word, size div 2)")), _key(F.col("size"), 1, F.expr("substring(word, 1 + size div 2)")))).alias("part", "key"),
    )
    other = known.select("word", "n", "odd", "size", F.explode(F.expr("array(size, size - 1)")).alias("as_size")).where(F.col("as_size") > 0)
    grams = other.select(
        F.col("word").alias("other"), F.col("n").alias("other_n"), F.col("odd").alias("other_odd"), F.col("size").alias("other_size"),
        F.explode(F.array(_key(F.col("as_size"), 0, F.expr("left(word, as_size div 2)")), _key(F.col("as_size"), 1, F.expr("right(word, as_size - as_size div 2)")))).alias("key"),
    )
    busy = grams.groupBy("key").count().where(F.col("count") > cfg.bucket).select("key", F.ceil(F.col("count") / cfg.bucket).cast("int").alias("parts"))
    parts = F.coalesce("parts", F.lit(1))
    grams = grams.join(busy, "key", "left").withColumn("place", F.pmod(F.xxhash64("other"), parts).cast("int")).drop("parts")
    chunks = chunks.join(busy, "key", "left").withColumn("place", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")
    on = (
        (chunks["key"] == grams["key"])
        & (chunks["place"] == grams["place"])
        & (F.bit_count(chunks["odd"].bitwiseXOR(grams["other_odd"])) <= 2)
        & ((chunks["size"] < grams["other_size"]) | (chunks["word"] < grams["other"]))
        # What the first halves have found is not found again by the second.
        & ((chunks["part"] == 0) | (F.left("word", chunks["half"]) != F.left("other", chunks["half"])))
        & (F.levenshtein("word", "other", 1) == 1)
    )
    return chunks.join(grams, on).select("word", "n", "other", "other_n")


def variant_forms(words: DataFrame, cfg: VariantConfig = VariantConfig()) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of each of words (word, n), each word once."""
    words = stored(words, "words")
    pairs = near_pairs(words, cfg)
    both = F.explode(F.array(
        F.struct("word", F.col("other").alias("near"), F.col("other_n").alias("near_n")),
        F.struct(F.col("other").alias("word"), F.col("word").alias("near"), F.col("n").alias("near_n")),
    ))
    near = pairs.select(both.alias("r")).select("r.*").groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best")
    )
    counts = F.col("n") * cfg.times <= -F.col("best.less")
    found = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(counts, F.col("best.near")).alias("form"), F.when(counts, -F.col("best.less")).alias("form_n"),
    )
    found = stored(found, "variants")
    roots = root_of(found.where("form is not null").select("word", F.col("form").alias("root")), cfg)
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def root_of(links: DataFrame, cfg: VariantConfig) -> DataFrame:
    """(word, root): links (word, root) followed to their ends. Each step doubles how far a word looks; counts grow by
    `times` from link to link, so that a few steps are always enough."""
    links = stored(links, "links")
    while True:
        onward = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        further = stored(links.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "links")
        discard(links)
        links = further.select("word", "root")
        if further.where("moved").isEmpty():
            return links


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near words, form and root of every word of the documents, with the deleted letters of the contract."""
    ship(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return variant_forms(word_counts(docs, plant=True))
