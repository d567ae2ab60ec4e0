"""Quality classifier: hashed word n-gram logistic regression, fitted with follow-the-regularised-leader updates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayline.llm import linear
from assayline.llm.shared import id_remainder
from assayline.sources.tables import table

#: Words keep their case and runs of signs are tokens, since both tell prose from junk.
CONFIG = linear.LinearConfig(gaps=(1,), signs=True, lower=False, repeats=True, alpha=0.5, l1=2.0, l2=0.0, epochs=8, min_rows=8)


def fit(docs: DataFrame, labels: DataFrame, cfg: linear.LinearConfig = CONFIG) -> linear.LinearModel:
    """labels: (doc_id, quality). Only rows outside the held-out fold are learnt from."""
    learnt = labels.where(id_remainder(F.col("doc_id"), 3) != 1)
    return linear.fit(docs, learnt, "quality", cfg)


def score(docs: DataFrame, model: linear.LinearModel) -> DataFrame:
    """docs with quality_score (0 to 1; null and empty texts get that of the intercept)."""
    return docs.withColumn("quality_score", linear.score(F.col("text"), model, docs))


def keep(docs: DataFrame, model: linear.LinearModel, least: float = 0.5) -> DataFrame:
    """Rows of docs that score least or more, with its columns."""
    return docs.where(linear.score(F.col("text"), model, docs) >= least)


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"))
    return score(docs, model).select(
        "doc_id",
        (id_remainder(F.col("doc_id"), 3) == 1).alias("held_out"),
        F.col("quality_score").alias("score"),
        (F.col("quality_score") >= 0.5).cast("int").alias("predicted"),
    )
