"""Toxicity: FTRL-proximal logistic regression over hashed words, bigrams and skip-grams.

Per-coordinate rates let rare words move far; the L1 penalty leaves a compact set of
weights, which is what the executors get.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayline.llm import linear
from assayline.llm.shared import id_remainder
from assayline.sources.tables import table

CONFIG = linear.LinearConfig(gaps=(1, 2), max_rows=16_000, alpha=2.0, l1=4.0, l2=0.0, epochs=10, min_rows=8)


def fit(docs: DataFrame, labels: DataFrame, cfg: linear.LinearConfig = CONFIG) -> linear.LinearModel:
    """labels: (doc_id, toxic). Only rows outside the held-out fold are learnt from."""
    learnt = labels.where(id_remainder(F.col("doc_id"), 5) != 0)
    return linear.fit(docs, learnt, "toxic", cfg)


def score(docs: DataFrame, model: linear.LinearModel) -> DataFrame:
    """docs with toxic_score (0 to 1; null and empty texts get that of the intercept)."""
    return docs.withColumn("toxic_score", linear.score(F.col("text"), model, docs))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return score(docs, model).select(
        "doc_id",
        (id_remainder(F.col("doc_id"), 5) == 0).alias("held_out"),
        F.col("toxic_score").alias("score"),
        (F.col("toxic_score") >= 0.5).cast("int").alias("predicted"),
    )
