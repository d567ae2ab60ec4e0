"""Near-duplicate documents by a chosen-path similarity join.

Each document is the set of its word shingles. Equal sets are one class from the start.
In each of several independent trees a class walks from the root down: a node, which is
the path so far, picks one or two of the minwise functions (1 / similarity on average),
and the class goes to the children named by its values there, so that a pair at the
threshold is expected to share one child at every level. Nodes of few classes are
leaves; larger ones branch on, to a greatest depth.

Within leaves: every class is first compared with the smallest class of its node, a
number of comparisons in proportion to the rows; the exact links found make components.
Then members of different components are compared with each other, all of them in a
node, so nothing is left out and the many pairs within a known group are not made. A
128-bit sketch on each row drops pairs far below the threshold inside the join; every
link is confirmed on the full sets of both texts.

Words and shingles are 64-bit hashes; sets are taken as equal where their size and a
128-bit fingerprint of those hashes agree.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assayline.llm import wordhash
from assayline.llm.graph import components
from assayline.llm.shared import give_back, short_batches, stored
from assayline.sources.tables import ship, table

FUNCTIONS = 128
#: Bits of the parity sketch; two sets differ in at least as many members as their sketches in bits.
PARITY = 1024
_SEEDS = wordhash.mix(np.arange(2 * FUNCTIONS, dtype=np.uint64), 99)
_FACTORS = (_SEEDS[:FUNCTIONS] >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_MASKS = (_SEEDS[FUNCTIONS:] >> np.uint64(32)).astype(np.uint32)


@dataclass(frozen=True)
class PathConfig:
    """shingle: words in a shingle. percent: least Jaccard similarity, in hundredths. trees: independent trees; a pair
    at the threshold misses all with a chance of about 0.4 to the power of trees. first_depth: levels every class walks.
    leaf: classes up to which a node is a leaf. depth: the last level, whose nodes are leaves of any size.
    far: unequal minwise bits beyond which a pair is dropped, over four deviations from what the threshold gives.
    deviations: of the parity sketch. broadcast_ids: ids up to which a list of them is broadcast."""

    shingle: int = 5
    percent: int = 80
    trees: int = 16
    first_depth: int = 3
    leaf: int = 64
    depth: int = 6
    far: int = 30
    deviations: float = 5.0
    broadcast_ids: int = 2_000_000


# --- inside tasks ----------------------------------------------------------------------


def shingle_sets(texts: pa.Array, k: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    for _, data, offsets in wordhash.slices(texts):
        n = len(offsets) - 1
        h, owner = wordhash.runs(*wordhash.words(data, offsets, wordhash.SPACE_CLASSES, True), n, k)
        for s in np.split(h, np.searchsorted(owner, np.arange(1, n))):
            yield np.unique(s)


def minima(s: np.ndarray) -> np.ndarray:
    """The least value of a set under each minwise function."""
    x = (s >> np.uint64(32)).astype(np.uint32)
    out = np.full(FUNCTIONS, 0xFFFFFFFF, np.uint32)
    for first in range(0, len(x), 2048):
        part = x[first : first + 2048]
        np.minimum(out, ((part ^ _MASKS[:, None]) * _FACTORS[:, None]).min(axis=1), out=out)
    return out


def children(signature: np.ndarray, who: np.ndarray, node: np.ndarray, branch: float) -> tuple[np.ndarray, np.ndarray]:
    """(row of signature, child) for all rows who at their nodes; a node picks 1 or 2 functions, 1 + branch on average."""
    picked = [(who, node, wordhash.mix(node, 1) % np.uint64(FUNCTIONS))]
    twice = wordhash.mix(node, 2) < np.uint64(int(branch * 2**64))
    other = wordhash.mix(node[twice], 3) % np.uint64(FUNCTIONS - 1)
    picked.append((who[twice], node[twice], (picked[0][2][twice] + np.uint64(1) + other) % np.uint64(FUNCTIONS)))
    rows, out = [], []
    with np.errstate(over="ignore"):
        for w, n, f in picked:
            value = signature[w, f.astype(np.int64)].astype(np.uint64)
            rows.append(w)
            out.append(wordhash.mix(wordhash.mix(n + f + np.uint64(7)) + value, 5))
    return np.concatenate(rows), np.concatenate(out)


# --- tables ----------------------------------------------------------------------------


def signatures(docs: DataFrame, cfg: PathConfig) -> DataFrame:
    """(doc_id, n, f1, f2, sig, parity) of (doc_id, text): the set's size, its 128-bit fingerprint, minwise values and
    the parity of the number of its members in each of PARITY buckets."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, f1, f2, sig, parity = [], [], [], [], []
            for s in shingle_sets(b.column("text"), cfg.shingle):
                n.append(len(s))
                with np.errstate(over="ignore"):
                    f1.append(np.int64(wordhash.mix(s, 11).sum(dtype=np.uint64).astype(np.int64)))
                    f2.append(np.int64(wordhash.mix(s, 12).sum(dtype=np.uint64).astype(np.int64)))
                sig.append(minima(s).tobytes() if len(s) else None)
                odd = np.bincount((s & np.uint64(PARITY - 1)).astype(np.int64), minlength=PARITY) & 1
                parity.append(np.packbits(odd.astype(np.uint8)).tobytes() if len(s) else None)
            yield pa.record_batch([b.column("doc_id"), *(pa.array(c, pa.int64()) for c in (n, f1, f2)), *(pa.array(c, pa.binary()) for c in (sig, parity))], ["doc_id", "n", "f1", "f2", "sig", "parity"])
        give_back()

    return docs.select("doc_id", "text").mapInArrow(sign, "doc_id long, n long, f1 long, f2 long, sig binary, parity binary")


def _walk(rows: DataFrame, cfg: PathConfig, start: bool) -> DataFrame:
    """(node, rep) after the first levels (rows: rep, sig), or one level on (rows: rep, sig, node)."""
    branch = 100 / cfg.percent - 1

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not len(b):
                continue
            signature = np.frombuffer(b"".join(b.column("sig").to_pylist()), np.uint32).reshape(len(b), FUNCTIONS)
            who = np.arange(len(b))
            if start:
                node = np.repeat(wordhash.mix(np.arange(cfg.trees, dtype=np.uint64), 77), len(b))
                who = np.tile(who, cfg.trees)
                for _ in range(cfg.first_depth):
                    who, node = children(signature, who, node, branch)
            else:
                who, node = children(signature, who, b.column("node").to_numpy().view(np.uint64), branch)
            yield pa.record_batch([pa.array(node.view(np.int64)), b.column("rep").take(pa.array(who))], ["node", "rep"])
        give_back()

    return rows.mapInArrow(go, "node long, rep long")


def _near(a: str, b: str, cfg: PathConfig) -> Column:
    """Sizes that allow the threshold, and sketches that do not speak against it."""
    (na, nb), (xa, xb), (ya, yb) = ((F.col(f"{a}.{x}"), F.col(f"{b}.{x}")) for x in ("n", "s1", "s2"))
    sizes = (na * 100 >= nb * cfg.percent) & (nb * 100 >= na * cfg.percent)
    return sizes & (F.bit_count(xa.bitwiseXOR(xb)) + F.bit_count(ya.bitwiseXOR(yb)) <= cfg.far)


def _close(a: str, b: str, cfg: PathConfig) -> Column:
    """Parity sketches that allow the threshold: no more unequal bits than members the sets may differ in, and no more
    than cfg.deviations above what that many members would leave unequal."""
    n = F.col(f"{a}.n") + F.col(f"{b}.n")
    most = F.floor(n * (100 - cfg.percent) / F.lit(100 + cfg.percent) + 1e-9)
    unequal = sum((F.bit_count(F.col(f"{a}.p{i}").bitwiseXOR(F.col(f"{b}.p{i}"))) for i in range(1, PARITY // 64)), F.bit_count(F.col(f"{a}.p0").bitwiseXOR(F.col(f"{b}.p0"))))
    mean = PARITY / 2 * (1 - F.pow(F.lit(1 - 2 / PARITY), most))
    spread = F.sqrt(PARITY / 4 * (1 - F.pow(F.lit(1 - 4 / PARITY), most)))
    return (unequal <= most) & (unequal <= mean + cfg.deviations * spread + 2)


def _confirmed(pairs: DataFrame, docs: DataFrame, cfg: PathConfig) -> DataFrame:
    """Those of pairs (u, v) whose full shingle sets reach the threshold."""

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size = sum(pc.binary_length(b.column(c)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("text_u", "text_v"))
            group = np.cumsum(size) // (4 << 20)  # a few long texts at a time
            good = []
            for g in np.unique(group):
                part = b.slice(int(np.searchsorted(group, g)), int((group == g).sum()))
                for x, y in zip(shingle_sets(part.column("text_u"), cfg.shingle), shingle_sets(part.column("text_v"), cfg.shingle), strict=True):
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    good.append(both > 0 and 100 * both >= cfg.percent * (len(x) + len(y) - both))
            yield b.select(["u", "v"]).filter(pa.array(good, pa.bool_()))
        give_back()

    ids = stored(pairs.select(F.explode(F.array("u", "v")).alias("doc_id")).distinct(), "candidate-ids")
    if ids.count() <= cfg.broadcast_ids:  # the texts then stay where they are
        ids = F.broadcast(ids)
    texts = docs.select("doc_id", "text").where("doc_id is not null").join(ids, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    texts = stored(texts, "candidate-texts")
    held = pairs.join(texts.select(F.col("doc_id").alias("v"), F.col("text").alias("text_v")), "v")
    held = held.join(texts.select(F.col("doc_id").alias("u"), F.col("text").alias("text_u")), "u").select("u", "v", "text_u", "text_v")
    return held.mapInArrow(confirm, "u long, v long")


def _leaves(sig: DataFrame, cfg: PathConfig) -> DataFrame:
    """(node, size, rep) of the leaves with two classes or more."""
    level = stored(_walk(sig, cfg, True), "paths")
    found = None
    for depth in range(cfg.first_depth, cfg.depth + 1):
        sizes = level.groupBy("node").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
        level = stored(level.join(sizes, "node").select("node", "size", "rep"), "nodes")
        last = depth == cfg.depth
        leaf = level if last else level.where(F.col("size") <= cfg.leaf)
        found = leaf if found is None else found.union(leaf)
        large = level.where(F.col("size") > cfg.leaf)
        if last or not large.take(1):
            break
        level = stored(_walk(large.join(sig, "rep").select("rep", "sig", "node"), cfg, False), "paths")
    return found


def link(docs: DataFrame, cfg: PathConfig = PathConfig()) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of docs (doc_id, text).

    component_id is the smallest doc_id reachable by links of Jaccard similarity percent / 100 or more. Texts that are
    null, empty or without words have no shingle and no link; rows without doc_id take no part and have component_id
    null and kept true. Repeated rows are linked like equal texts; of different texts under one doc_id each has a row of
    its own, and any one of them stands for the id where a link is confirmed.
    """
    spark = docs.sparkSession
    ship(spark)
    short_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = stored(signatures(docs, cfg), "signatures")
    real = signed.where("n > 0 and doc_id is not null")
    classes = stored(real.groupBy("n", "f1", "f2").agg(F.min("doc_id").alias("rep"), F.first("sig").alias("sig"), F.first("parity").alias("parity")), "classes")
    sig = classes.select("rep", "sig")
    leaves = stored(_leaves(sig, cfg), "leaves")
    sketches = stored(_sketches(classes), "sketches")
    members = stored(leaves.join(sketches, "rep").select("node", "size", "rep", "n", "s1", "s2"), "members")

    heads = members.groupBy("node").agg(F.min(F.struct("rep", "n", "s1", "s2")).alias("h")).select("node", "h.*")
    stars = members.alias("m").join(heads.alias("h"), "node").where((F.col("m.rep") > F.col("h.rep")) & _near("m", "h", cfg))
    stars = stored(stars.select(F.col("h.rep").alias("u"), F.col("m.rep").alias("v")).distinct(), "stars-tried")
    links = stored(_confirmed(stars, docs, cfg), "links-1")
    grouped = components(links)

    labelled = members.join(grouped.withColumnRenamed("u", "rep"), "rep", "left").withColumn("comp", F.coalesce("component", "rep")).drop("component")
    shares = labelled.groupBy("node", "comp").agg(F.count(F.lit(1)).alias("k"))
    mixed = shares.groupBy("node").agg(F.count(F.lit(1)).alias("comps"), F.max(F.struct("k", "comp")).alias("top")).where("comps > 1").select("node", F.col("top.comp").alias("top"))
    labelled = labelled.select("node", "rep", "n", "s1", "s2", "comp").join(mixed, "node")
    labelled = stored(labelled.join(_parities(classes), "rep"), "mixed-nodes")
    # The side that is walked for each partner never holds a node's largest component.
    a, b = labelled.where("comp <> top").alias("a"), labelled.alias("b")
    once = (F.col("b.comp") == F.col("b.top")) | (F.col("a.rep") < F.col("b.rep"))
    rest = a.join(b, F.col("a.node") == F.col("b.node")).where((F.col("a.comp") != F.col("b.comp")) & once & _near("a", "b", cfg) & _close("a", "b", cfg))
    rest = rest.select(F.least("a.rep", "b.rep").alias("u"), F.greatest("a.rep", "b.rep").alias("v")).distinct()
    rest = stored(rest.join(stars, ["u", "v"], "left_anti"), "rest-tried")
    more = stored(_confirmed(rest, docs, cfg), "links-2")
    if more.take(1):
        grouped = components(grouped.select("u", F.col("component").alias("v")).union(more))

    named = classes.select("n", "f1", "f2", "rep").join(grouped.withColumnRenamed("u", "rep"), "rep", "left").select("n", "f1", "f2", F.coalesce("component", "rep").alias("component_id"))
    out = signed.drop("sig", "parity").join(named, ["n", "f1", "f2"], "left")
    component = F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(F.coalesce(F.when(F.col("n") > 0, F.col("component_id")), F.col("doc_id")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def _sketches(classes: DataFrame) -> DataFrame:
    """(rep, n, s1, s2): 128 bits, one of each minwise value."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                values = np.frombuffer(b"".join(b.column("sig").to_pylist()), np.uint32).reshape(len(b), FUNCTIONS)
                mixed = wordhash.mix(values.astype(np.uint64), 21) >> np.uint64(63)
                two = np.packbits(mixed.astype(np.uint8), axis=1).view(np.int64)
                yield pa.record_batch([b.column("rep"), b.column("n"), pa.array(np.ascontiguousarray(two[:, 0])), pa.array(np.ascontiguousarray(two[:, 1]))], ["rep", "n", "s1", "s2"])

    return classes.select("rep", "n", "sig").mapInArrow(sketch, "rep long, n long, s1 long, s2 long")


def _parities(classes: DataFrame) -> DataFrame:
    """(rep, p0, p1, ...): the parity sketch as longs."""
    word = lambda i: F.conv(F.hex(F.substring("parity", 8 * i + 1, 8)), 16, -10).cast("long").alias(f"p{i}")
    return classes.select("rep", *(word(i) for i in range(PARITY // 64)))


def drop_near_duplicates(docs: DataFrame, cfg: PathConfig = PathConfig()) -> DataFrame:
    """docs without those that are near copies of one with a smaller doc_id that stays; all columns.

    Of repeated rows with one doc_id one row stays; rows without doc_id all stay.
    """
    gone = link(docs, cfg).where("not kept").select("doc_id")
    left = docs.join(gone, "doc_id", "left_anti")
    repeated = docs.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    if not repeated.take(1):
        return left
    return left.where("doc_id is not null").dropDuplicates(["doc_id"]).unionByName(left.where("doc_id is null"))


def op8_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every document, on shingles of two words."""
    return link(table(spark, sf_dir, "documents").select("doc_id", "text"), PathConfig(shingle=2))
