"""Sparse logistic regression on hashed word n-grams, fitted with FTRL-proximal.

Features of a text are the set of its hashed n-grams and skip-grams, so a text's size
does not scale its score. Whole texts are hashed where they lie; only the feature
numbers of a bounded sample of labelled rows go to the fit, and only the non-zero
weights come back and are broadcast.

Nulls and empty texts have no feature: their score is that of the intercept alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayline.llm import wordhash
from assayline.llm.shared import give_back, short_batches


@dataclass(frozen=True)
class LinearConfig:
    """bits: log2 of the number of features. gaps: distances of word pairs (1: bigrams, more: skip-grams).
    signs: runs of signs are tokens too. lower: A-Z count as a-z. repeats: all trigrams of one word three times over
    share a feature. max_rows, max_bytes: bounds of the labelled sample, in documents and in bytes of their features.
    min_rows: documents that a feature needs."""

    bits: int = 20
    gaps: tuple[int, ...] = (1,)
    signs: bool = False
    lower: bool = True
    repeats: bool = False
    max_rows: int = 8000
    max_bytes: int = 256 << 20
    epochs: int = 4
    alpha: float = 0.15
    beta: float = 1.0
    l1: float = 1.0
    l2: float = 1.0
    min_rows: int = 4


@dataclass(frozen=True)
class LinearModel:
    """Non-zero weights by feature number; all else is zero."""

    config: LinearConfig
    intercept: float = 0.0
    index: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    weight: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))


def features(data: np.ndarray, offsets: np.ndarray, cfg: LinearConfig) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(feature, text) of each n-gram, one order after the other."""
    h, owner = wordhash.words(data, offsets, wordhash.SIGN_CLASSES if cfg.signs else wordhash.WORD_CLASSES, cfg.lower)
    shift = np.uint64(64 - cfg.bits)
    yield (h >> shift).astype(np.int64), owner
    for gap in cfg.gaps:
        pairs, whose = wordhash.joined(h, owner, gap, gap)
        yield (pairs >> shift).astype(np.int64), whose
    if cfg.repeats:
        again = np.flatnonzero((h[2:] == h[1:-1]) & (h[1:-1] == h[:-2]) & (owner[2:] == owner[:-2]))
        yield np.ones(len(again), np.int64), owner[again]


def feature_sets(texts: pa.Array, cfg: LinearConfig) -> list[np.ndarray]:
    """The distinct features of each text, sorted."""
    out: list[np.ndarray] = []
    for _, data, offsets in wordhash.slices(texts):
        n = len(offsets) - 1
        keys = np.unique(np.concatenate([(whose << cfg.bits) | f for f, whose in features(data, offsets, cfg)]))
        cuts = np.searchsorted(keys, np.arange(1, n) << cfg.bits)
        out += [x & ((1 << cfg.bits) - 1) for x in np.split(keys, cuts)]
    return out


def ftrl(rows: list[np.ndarray], labels: np.ndarray, cfg: LinearConfig) -> tuple[float, np.ndarray, np.ndarray]:
    """FTRL-proximal with a rate for each coordinate; the intercept carries no penalty. Returns intercept, features, weights."""
    if not rows:
        return 0.0, np.zeros(0, np.int64), np.zeros(0, np.float32)
    counts = np.zeros(1 << cfg.bits, np.int32)
    for r in rows:
        counts[r] += 1
    keep = counts >= cfg.min_rows  # a feature of a few rows can't outweigh the L1 penalty
    known, place = np.flatnonzero(keep), (np.cumsum(keep) - 1).astype(np.int32)
    compact = [place[r[keep[r]]] for r in rows]
    z, n = np.zeros(len(known)), np.zeros(len(known))
    bz = bn = 0.0
    rng = np.random.default_rng(7)

    def weights(zi: np.ndarray, ni: np.ndarray) -> np.ndarray:
        w = -(zi - np.sign(zi) * cfg.l1) / ((cfg.beta + np.sqrt(ni)) / cfg.alpha + cfg.l2)
        return np.where(np.abs(zi) <= cfg.l1, 0.0, w)

    for _ in range(cfg.epochs):
        for i in rng.permutation(len(rows)):
            x = compact[i]
            zi, ni = z[x], n[x]
            w = weights(zi, ni)
            b = -bz / ((cfg.beta + np.sqrt(bn)) / cfg.alpha)
            g = 1.0 / (1.0 + np.exp(-np.clip(w.sum() + b, -35, 35))) - labels[i]
            g2 = g * g
            z[x] = zi + g - (np.sqrt(ni + g2) - np.sqrt(ni)) / cfg.alpha * w
            n[x] = ni + g2
            bz += g - (np.sqrt(bn + g2) - np.sqrt(bn)) / cfg.alpha * b
            bn += g2
    w = weights(z, n)
    used = w != 0
    return float(-bz / ((cfg.beta + np.sqrt(bn)) / cfg.alpha)), known[used], w[used].astype(np.float32)


def fit(docs: DataFrame, labels: DataFrame, label: str, cfg: LinearConfig) -> LinearModel:
    """Fits on at most cfg.max_rows labelled documents, those whose ids hash lowest, as far as max_bytes goes.

    docs: (doc_id, text); labels: (doc_id, <label> 0 or 1). Rows without id or label are left out; several labels of
    one id count as their largest. Without any labelled row the model is empty and scores 0.5.
    """
    spark = docs.sparkSession
    short_batches(spark)
    picked = (
        labels.select("doc_id", F.col(label).cast("double").alias("y"))
        .where("doc_id is not null and y is not null")
        .groupBy("doc_id").agg(F.max("y").alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(cfg.max_rows)
    )
    sample = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [x.astype("<u4").tobytes() for x in feature_sets(b.column("text"), cfg)]
            yield pa.record_batch([b.column("doc_id"), b.column("y"), pa.array(found, pa.binary())], ["doc_id", "y", "x"])
        give_back()

    def train(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "y"], kind="stable")
        rows = [np.frombuffer(x, "<u4") for x in pdf["x"]]
        b, index, w = ftrl(rows, pdf["y"].to_numpy(), cfg)
        return pd.DataFrame({"i": np.append(index, -1), "w": np.append(w, b).astype(float)})

    hashed = sample.mapInArrow(sets, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, y double, x binary")
    upto = F.sum(F.octet_length("x")).over(Window.partitionBy(F.lit(0)).orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    hashed = hashed.withColumn("upto", upto).where(F.col("upto") <= cfg.max_bytes).drop("upto")  # of max_rows rows at most
    got = hashed.withColumn("one", F.lit(0)).groupBy("one").applyInPandas(train, "i long, w double").toPandas()
    if not len(got):
        return LinearModel(cfg)
    weights = got[got["i"] >= 0].sort_values("i")
    return LinearModel(cfg, float(got.loc[got["i"] < 0, "w"].iloc[0]), weights["i"].to_numpy(np.int64), weights["w"].to_numpy(np.float32))


def scores(texts: pa.Array, model: LinearModel, dense: np.ndarray) -> np.ndarray:
    """Probability of label 1 for each text: a sparse dot product over its set of features."""
    cfg, out = model.config, []
    for _, data, offsets in wordhash.slices(texts):
        n, found = len(offsets) - 1, []
        for f, whose in features(data, offsets, cfg):
            used = np.flatnonzero(dense[f])
            found.append((whose[used] << cfg.bits) | f[used])
        keys = np.unique(np.concatenate(found))
        total = np.bincount(keys >> cfg.bits, weights=dense[keys & ((1 << cfg.bits) - 1)], minlength=n) + model.intercept
        out.append(1.0 / (1.0 + np.exp(-np.clip(total, -35, 35))))
    return np.concatenate(out) if out else np.zeros(0)


def score(text: Column, model: LinearModel, docs: DataFrame) -> Column:
    """The score of a text column of docs, between 0 and 1. The weights travel as one small broadcast."""
    spark = docs.sparkSession
    short_batches(spark)
    shipped = spark.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = shipped.value
        dense = np.zeros(1 << m.config.bits, np.float32)
        dense[m.index] = m.weight
        for texts in batches:
            yield pa.array(scores(texts, m, dense), pa.float64())
        give_back()

    return of(text)
