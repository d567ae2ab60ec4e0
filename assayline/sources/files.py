"""Readers and writers of the record files: JSON lines with quarantine, CSV, dated folders, snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assayline.functions.text import blank_to_null


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with an explicit schema; malformed lines are kept, whole, in _corrupt. Blank lines give no row."""
    full = f"{schema}, _corrupt string"
    return spark.read.schema(full).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)


def read_issue_document(spark: SparkSession, path: str, item: str) -> DataFrame:
    """One row an issue of {"metadata": …, "issues": […]} documents or bare lists."""
    raw = spark.read.option("wholetext", True).text(path)
    both = raw.select(F.coalesce(F.from_json("value", f"struct<issues:array<{item}>>")["issues"], F.from_json("value", f"array<{item}>")).alias("issues"))
    return both.select(F.explode("issues").alias("i")).select("i.*")


def read_golden_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header, all text; blank cells are null."""
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return df.select(*(blank_to_null(F.col(f"`{c}`")).alias(c) for c in df.columns))


def read_dated(spark: SparkSession, path: str, schema: str, cutoff: str) -> DataFrame:
    """Rows of folders date=YYYY-MM-DD not before cutoff; older folders are never opened."""
    return spark.read.schema(f"{schema}, date date").json(path).where(F.col("date") >= F.lit(cutoff).cast("date"))


def scenario_steps(document: Column, step: str = "struct<step:int,action:string,target:string,value:string>") -> Column:
    """Steps of a document that is a list or has one under "steps"; a missing number is the position."""
    both = F.coalesce(F.from_json(document, f"struct<steps:array<{step}>>")["steps"], F.from_json(document, f"array<{step}>"))
    return F.transform(both, lambda s, i: s.withField("step", F.coalesce(s["step"], i + 1)))


def write_jsonl(df: DataFrame, path: str) -> None:
    """One object a line, keys in order of their names."""
    df.select(*sorted(df.columns)).write.mode("append").json(path)


def write_by_path(df: DataFrame, folder: str, runtime_only: tuple[str, ...] = ()) -> None:
    """Chunks sorted by path into files, each path in one file; columns only needed at run time are left out."""
    df.drop(*runtime_only).repartitionByRange("path").sortWithinPartitions("path").write.mode("overwrite").json(folder)


def write_snapshot(keys: DataFrame, folder: str, run: str) -> str:
    """The key set of a run in a folder of its own; earlier ones stay as they are. Returns its path."""
    path = f"{folder}/run={run}"
    keys.select("key").distinct().write.mode("overwrite").parquet(path)
    return path
