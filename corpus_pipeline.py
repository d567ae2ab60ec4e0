"""From raw documents to token shards: five stages, each over all that the one before kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from assayline.llm import decontaminate, mixing, neardup, quality, tokens
from assayline.llm.shared import stored
from assayline.sources.tables import ship, table


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier scores at 0.5 or more."""
    ship(spark)
    model = quality.fit(docs.select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "quality"))
    return quality.keep(docs, model)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near copies (five-word shingles, similarity 0.8)."""
    return neardup.drop_near_duplicates(docs).select(*docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item, re-parameterised or not."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled to the target weights of source, language and topic."""
    return mixing.sample(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token shards of what is left; one row a document, read back from them."""
    # Workers that ran the stages before still hold memory, so that fewer chunks are remembered and less goes through at once.
    return tokens.token_output(spark, docs.select("doc_id", "text"), tokens.TokenConfig(known_chunks=100_000, portion_bytes=2 << 20))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", keep_good),
    ("MinHash near-dedup", drop_copies),
    ("benchmark decontamination", drop_leaks),
    ("mixing sources to target weights", mix),
    ("token-ID / binary output", write_tokens),
]

#: SQL can express neither a fitted classifier nor the tokenizer; tests/llm/test_pipeline.py compares with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), "stage-" + name.split()[0].lower())
    return docs
