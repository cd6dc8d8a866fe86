"""Tables, the shared scratch folder and small helpers over a session."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(df: DataFrame) -> DataFrame:
    """Send rows to Python a few MB at a time, not by a number of rows of any length.

    The session's setting is lowered from Spark's default of 64 MB; a setting of the
    user's own stays.
    """
    conf = df.sparkSession.conf
    if conf.get(_BATCH, "1b") == "67108864b":
        conf.set(_BATCH, "4m")
    return df


def give_back() -> None:
    """Return freed memory to the machine; allocators keep it otherwise, in idle workers too."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only glibc has it
    if trim:
        trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for mapInArrow; at a task's end its worker gives back what it no longer holds."""

    def out(it):
        yield from run(it)
        give_back()

    return out


def documents(df: DataFrame) -> DataFrame:
    """doc_id as long and text as string, whatever other columns there are."""
    return small_batches(df).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def scratch(spark: SparkSession) -> str:
    """A new path in the folder that ``spark.checkpoint.dir`` names for all machines.

    Only where that is unset (a local session, as in tests) a local folder is made.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        base = spark.sparkContext.getCheckpointDir()
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
            base = tempfile.mkdtemp(prefix="emberlog-")
            spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/emberlog-{uuid.uuid4().hex}"


def save(df: DataFrame) -> tuple[DataFrame, str]:
    """Write to the scratch folder and read again: lineage ends there."""
    spark, path = df.sparkSession, scratch(df.sparkSession)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def drop(spark: SparkSession, *paths: str) -> None:
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def crc_mod(column: str, n: int):
    return F.crc32(F.col(column).cast("string").cast("binary")) % n
