"""Session helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder

#: Rows and bytes in one Arrow batch at most: whole documents are wide, and batches are held on both sides of the pipe.
BATCH_ROWS, BATCH_BYTES = 2000, 4_000_000


def small_batches(spark: SparkSession) -> None:
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > BATCH_ROWS:
        spark.conf.set(key, BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Tables that :func:`written` has made and that are still there.
made: list[str] = []


def _at(spark: SparkSession, path: str):
    """A path of Spark's file systems, and its file system."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def written(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table of the shared folder and read it back: cuts lineage and survives lost executors.

    The table goes when the application ends, or before by :func:`dropped`.
    """
    spark = df.sparkSession
    small_batches(spark)
    path = f"{shared_folder(spark)}/quaver/{uuid.uuid4().hex}"
    df.write.parquet(path)
    made.append(path)
    place, files = _at(spark, path)
    files.deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)


def dropped(spark: SparkSession, paths: list[str]) -> None:
    """Delete tables that nothing reads any more."""
    for path in paths:
        place, files = _at(spark, path)
        files.delete(place, True)
        made.remove(path)


def released() -> None:
    """At the end of a task: give back what its arrays left in the allocators of a worker that other stages use again."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library
        pass


def free(name: str, columns: list[str]) -> str:
    """``name``, with as many underscores behind it as it takes to be no column."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def fold_of(doc_id: str | Column = "doc_id") -> Column:
    """crc32 of the id as text, modulo 5; a null id counts as the empty text (fold 0)."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % 5


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
