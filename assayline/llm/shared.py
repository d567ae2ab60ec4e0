"""What several corpus operators share: durable cuts of lineage, folds of documents, batches."""

from __future__ import annotations

import ctypes

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assayline.sources.workdir import shared_dir, stored, work_path

__all__ = ["ARROW_ROWS", "discard", "give_back", "id_remainder", "shared_dir", "short_batches", "stored", "work_path"]

#: Rows in one Arrow batch. Texts may be long, so batches are kept short.
ARROW_ROWS = 1024


def short_batches(spark: SparkSession) -> None:
    """Keeps Arrow batches short where the session still has Spark's default of 10,000 rows."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > ARROW_ROWS:
        spark.conf.set(key, str(ARROW_ROWS))


def give_back() -> None:
    """Returns memory that a task has freed to the system at its end: its Python worker lives on, beside the next stage's."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # the GNU library's
    if trim is not None:
        trim(0)


def id_remainder(col: Column, modulus: int) -> Column:
    """crc32 of the id's text, mod modulus: the fold of a document."""
    return F.crc32(col.cast("string").cast("binary")) % modulus


def discard(*tables: DataFrame) -> None:
    """Deletes results of stored() that nothing reads any more; only whole folders below the shared folder."""
    for df in tables:
        spark = df.sparkSession
        base = shared_dir(spark)
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if folder.rsplit("/", 2)[-2:][0] == base.rsplit("/", 1)[-1]:
                path = spark._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
