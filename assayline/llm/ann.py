"""Nearest neighbours by largest inner product, from randomly rotated one-bit codes.

Every vector is turned by several random orthogonal matrices and kept as the signs of
its components, packed in bits, with two scalars: its length and how well the signs
point its way. A query is turned alike and its components cut to a few bits, so that
inner products are estimated from the packed codes by counting common bits, plane by
plane. Each estimate has an error bound, a number of standard deviations wide.

Blocks of codes meet blocks of queries; original vectors stay out of that. The k-th
largest lower bound over all blocks is a query's floor; those whose upper bound reaches
it are chosen and scored on the original vectors. Equal vectors tie in every search, so beyond the k + 1 smallest ids of
one vector no other can be an answer; only those are candidates, and a vector that
occurs very often is no burden.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assayline.llm.shared import short_batches, stored
from assayline.sources.tables import ship, table


@dataclass(frozen=True)
class CodeConfig:
    """k: neighbours of a query. rotations: one-bit codes of a vector, each of as many bits as it has components.
    deviations: half width of the error bound; at 1.9 about three in a hundred bounds fail on one side, mostly far
    from the k-th. planes: bits of a query's component. block: codes in a block; query_block: queries in a block.
    stack: queries estimated at once. seed: of the rotations."""

    k: int = 20
    rotations: int = 8
    deviations: float = 1.9
    planes: int = 4
    block: int = 16384
    query_block: int = 2048
    stack: int = 8
    seed: int = 17


def rotation(dim: int, cfg: CodeConfig) -> np.ndarray:
    """cfg.rotations random orthogonal matrices side by side."""
    rng = np.random.default_rng(cfg.seed)
    parts = []
    for _ in range(cfg.rotations):
        q, r = np.linalg.qr(rng.standard_normal((dim, dim)))
        parts.append(q * np.sign(np.diag(r)))
    return np.hstack(parts)


def units(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(unit vectors, lengths), by way of the largest component, whose square may be out of range."""
    most = np.abs(vectors).max(axis=1, keepdims=True)
    scaled = vectors / most
    length = np.linalg.norm(scaled, axis=1)
    with np.errstate(over="ignore"):
        return scaled / length[:, None], np.minimum(length * most[:, 0], np.finfo(float).max)


def _words(bits: np.ndarray) -> np.ndarray:
    """Rows of booleans as rows of 64-bit words."""
    return np.packbits(np.pad(bits, ((0, 0), (0, -bits.shape[1] % 64))), axis=1).view(np.uint64)


def encode(vectors: np.ndarray, cfg: CodeConfig) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(packed signs as words, length, cosine between a vector and its signs) of each row."""
    unit, length = units(vectors)
    turned = unit @ rotation(vectors.shape[1], cfg)
    return _words(turned >= 0), length, np.abs(turned).sum(axis=1) / np.sqrt(vectors.shape[1]) / cfg.rotations


def usable(vector: Column) -> Column:
    """Neither null nor zero, and all components finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return F.coalesce(vector.isNotNull() & ~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def usable_rows(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding) of the usable rows, repeated ones once; different vectors under one vec_id all stay."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return rows.where(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).distinct()


def _matrix(lists: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, matrix) of the vectors of each dimension."""
    offsets = lists.offsets.to_numpy()
    sizes, flat = np.diff(offsets), lists.values.to_numpy(zero_copy_only=False)
    for dim in np.unique(sizes):
        own = np.flatnonzero(sizes == dim)
        yield own, flat[offsets[:-1][own][:, None] + np.arange(dim)]


def index(rows: DataFrame, cfg: CodeConfig = CodeConfig()) -> DataFrame:
    """(vec_id, dim, code, length, cosine) of the rows of usable_rows() that can be an answer."""
    short_batches(rows.sparkSession)
    order = Window.partitionBy("embedding").orderBy("vec_id")
    able = rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= cfg.k + 1).select("vec_id", "embedding")

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for own, v in _matrix(b.column("embedding")):
                words, length, cosine = encode(v, cfg)
                yield pa.record_batch(
                    [b.column("vec_id").take(pa.array(own)), pa.array(np.full(len(own), v.shape[1]), pa.int32()), pa.array([x.tobytes() for x in words], pa.binary()), pa.array(length), pa.array(cosine)],
                    ["vec_id", "dim", "code", "length", "cosine"],
                )

    return able.mapInArrow(code, "vec_id long, dim int, code binary, length double, cosine double")


def estimates(words: np.ndarray, turned: np.ndarray, cfg: CodeConfig) -> np.ndarray:
    """Sums of turned queries' components under the signs of each code, from common bits of words and query planes."""
    least = turned.min(axis=1, keepdims=True)
    step = np.maximum((turned.max(axis=1, keepdims=True) - least) / ((1 << cfg.planes) - 1), 1e-300)
    level = np.rint((turned - least) / step).astype(np.uint8)
    columns = np.ascontiguousarray(words.T)
    common = np.zeros((len(turned), len(words)), np.int32)
    for j in range(cfg.planes):
        plane = _words((level >> j & 1).astype(bool))
        for w, column in enumerate(columns):
            common += np.bitwise_count(plane[:, w, None] & column).astype(np.int32) << j
    ones = np.bitwise_count(words).sum(axis=1, dtype=np.int32)
    whole = least[:, 0] * turned.shape[1] + step[:, 0] * level.sum(axis=1, dtype=np.int64)
    return 2 * (least * ones + step * common) - whole[:, None]


def _search_block(data: pd.DataFrame, queries: pd.DataFrame, cfg: CodeConfig) -> pd.DataFrame:
    """(query_id, vec_id, low): of a block of codes, for each of a block of queries, the k largest lower bounds; where
    queries have a floor, all whose upper bound reaches it."""
    out: dict[str, list[np.ndarray]] = {"query_id": [], "vec_id": [], "low": []}
    if len(data) and len(queries):
        data = data.sort_values("vec_id", kind="stable")
        ids, dim = data["vec_id"].to_numpy(), int(data["dim"].iloc[0])
        words = np.frombuffer(b"".join(data["code"]), np.uint64).reshape(len(ids), -1)
        length, cosine = data["length"].to_numpy(), data["cosine"].to_numpy()
        scale = length / (cosine * np.sqrt(dim) * cfg.rotations)
        spread = cfg.deviations * length * np.sqrt(np.maximum(1 - cosine**2, 0) / max(dim - 1, 1) / cfg.rotations) / cosine
        asked = queries["query_id"].to_numpy()
        turned = units(np.stack(queries["embedding"].to_numpy()))[0] @ rotation(dim, cfg)
        own = np.flatnonzero(np.diff(ids, prepend=ids[0] - 1))  # where each vec_id begins
        for first in range(0, len(asked), cfg.stack):
            part = slice(first, first + cfg.stack)
            estimate = estimates(words, turned[part], cfg) * scale
            itself = asked[part, None] == ids
            if "floor" in queries:
                q, near = np.nonzero((estimate + spread >= queries["floor"].to_numpy()[part, None]) & ~itself)
                found = (asked[part][q], ids[near], (estimate - spread)[q, near])
            else:
                low = np.where(itself, -np.inf, estimate - spread)
                low = np.maximum.reduceat(low, own, axis=1)
                top = np.argpartition(-low, min(cfg.k, len(own)) - 1, axis=1)[:, : cfg.k]
                found = (np.repeat(asked[part], top.shape[1]), ids[own][top].ravel(), np.take_along_axis(low, top, axis=1).ravel())
            for name, values in zip(out, found, strict=True):
                out[name].append(values)
    empty = {"query_id": np.int64, "vec_id": np.int64, "low": np.float64}
    return pd.DataFrame({name: np.concatenate([np.zeros(0, t), *out[name]]) for name, t in empty.items()})


def chosen(codes: DataFrame, queries: DataFrame, cfg: CodeConfig) -> DataFrame:
    """(query_id, vec_id): the candidates to be scored, from the codes alone.

    Codes and queries meet twice: first each block gives its k largest lower bounds, which make the k-th of all, the
    floor of a query; then it gives what reaches the floor.
    """
    n_data = max(1, -(-codes.count() // cfg.block))
    n_query = max(1, -(-queries.count() // cfg.query_block))
    data = codes.withColumn("db", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(n_data))).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(n_query - 1))))

    def both(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return _search_block(left, right, cfg)

    def meet(asked: DataFrame) -> DataFrame:
        dealt = asked.withColumn("dim", F.size("embedding")).withColumn("qb", F.pmod(F.xxhash64("query_id", F.lit(2)), F.lit(n_query)).cast("int"))
        dealt = dealt.withColumn("db", F.explode(F.sequence(F.lit(0), F.lit(n_data - 1)).cast("array<long>")))
        keys = ["dim", "db", "qb"]
        return data.groupBy(*keys).cogroup(dealt.groupBy(*keys)).applyInPandas(both, "query_id long, vec_id long, low double")

    best = meet(queries.select("query_id", "embedding")).groupBy("query_id", "vec_id").agg(F.max("low").alias("low"))
    best = best.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("low")))).where(F.col("place") == cfg.k)
    floors = stored(best.select("query_id", F.col("low").alias("floor")), "floors")
    floored = queries.join(floors, "query_id", "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf"))))
    return meet(floored.select("query_id", "embedding", "floor")).select("query_id", "vec_id").distinct()


def search(rows: DataFrame, codes: DataFrame, queries: DataFrame, cfg: CodeConfig = CodeConfig()) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k nearest found of each query; ties go to the smaller vec_id.

    rows: what usable_rows() gives; codes: what index() gives of them; queries: (query_id, embedding), usable. An id with
    several vectors, on either side, counts by the pair with the largest product and takes one place. A query's own
    vec_id is no candidate. Vectors of another dimension than the query's are none either. Fewer candidates than k give
    fewer rows; empty tables none. Products beyond the range of a double come out infinite.
    """
    ship(codes.sparkSession)
    pairs = stored(chosen(codes, queries, cfg), "neighbour-candidates")
    held = pairs.join(rows, "vec_id").join(queries.withColumnRenamed("embedding", "asked"), "query_id")
    held = held.where(F.size("embedding") == F.size("asked")).select("query_id", "vec_id", "embedding", "asked")

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for (own, v), (_, q) in zip(_matrix(b.column("embedding")), _matrix(b.column("asked")), strict=True):
                with np.errstate(over="ignore", invalid="ignore"):
                    score = np.einsum("ij,ij->i", v, q)
                yield pa.record_batch([b.column("query_id").take(pa.array(own)), b.column("vec_id").take(pa.array(own)), pa.array(score)], ["query_id", "vec_id", "score"])

    scored = held.mapInArrow(exact, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = scored.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= cfg.k)
    return best.select("query_id", "rank", "vec_id", "score")


def op3_rotated_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every vector whose id is divisible by 20, among all."""
    ship(spark)
    rows = stored(usable_rows(table(spark, sf_dir, "embeddings").select("vec_id", "embedding")), "vectors")
    codes = stored(index(rows), "codes")
    return search(rows, codes, rows.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id"))
