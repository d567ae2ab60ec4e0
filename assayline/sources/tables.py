"""Reading the tables of a data folder, and making this package importable on the executors."""

from __future__ import annotations

import io
import os
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession

_ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def ship(spark: SparkSession) -> None:
    """Sends the package's Python files to the executors, once for each application."""
    key = "assayline.shipped"
    app = spark.sparkContext.applicationId
    if spark.conf.get(key, "") == app:
        return
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in sorted(os.walk(_ROOT)):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.relpath(path, os.path.dirname(_ROOT)))
    path = os.path.join(tempfile.mkdtemp(prefix="assayline-ship-"), "assayline_package.zip")
    with open(path, "wb") as f:
        f.write(held.getvalue())
    spark.sparkContext.addPyFile(path)
    spark.conf.set(key, app)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder; only Spark's reader touches the path."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(df: DataFrame, *keys: str, rows: int = 400_000) -> DataFrame:
    """df dealt by keys into tasks of about so many rows, counted first, so that what a task holds does not grow with the
    input. Spark puts small partitions together by what they hold on disk, but leaves a number that is asked for as it is."""
    n = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows))
    return df.repartition(n, *keys)
