"""Text files as numbered lines with byte offsets.

Lines end at ``\\n`` only. One scan reads all files, split as Spark likes; the result is
written once, and numbers and offsets come from that copy: within a split by a window,
across splits by sums over one row per split. No task ever holds a whole large file.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import scratch

LINES = "file_id long, split long, line_no long, byte_offset long, value string"


def scan(spark: SparkSession, files: DataFrame, paths: list[str], also: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> tuple[DataFrame, str]:
    """file_id, split (its first byte), mid (order within a split), value, bytes.

    What ``also`` adds to a line is worked out by the scan's own tasks.
    """
    text = spark.read.option("lineSep", "\n").text(paths)
    rows = text.select(
        "value",
        F.octet_length("value").cast("long").alias("bytes"),
        F.regexp_replace(F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))), r"^file:/*(?=/)", "").alias("path"),
        F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("mid"),
    )
    # the list of files has one row for each file that is read
    return scratch.save(also(rows.join(files.select("file_id", "path"), "path").drop("path")))


#: Lines that one window holds.
CHUNK = 4096


def number(raw: DataFrame) -> DataFrame:
    """Line numbers (from 1) and byte offsets of scanned lines; ``split`` becomes the chunk.

    ``mid`` counts on within a split, so one row per split gives the line numbers. Offsets
    come from windows over chunks of lines and one row per chunk.
    """
    splits = raw.groupBy("file_id", "split").agg(F.count("*").alias("n"), F.min("mid").alias("mid0"))
    before = Window.partitionBy("file_id").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    starts = splits.select("file_id", "split", "mid0", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("line0"))
    lines = raw.join(starts, ["file_id", "split"]).withColumn("line_no", F.col("line0") + F.col("mid") - F.col("mid0") + 1)
    lines = lines.withColumn("chunk", F.floor((F.col("line_no") - 1) / CHUNK))
    sizes = lines.groupBy("file_id", "chunk").agg(F.sum(F.col("bytes") + 1).alias("size"))
    before = Window.partitionBy("file_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("file_id", "chunk", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("byte0"))
    inside = Window.partitionBy("file_id", "chunk").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    placed = lines.join(starts, ["file_id", "chunk"]).withColumn("past", F.coalesce(F.sum(F.col("bytes") + 1).over(inside), F.lit(0)))
    others = [c for c in raw.columns if c not in ("file_id", "split", "mid", "value", "bytes")]
    return placed.select("file_id", F.col("chunk").alias("split"), "line_no", (F.col("byte0") + F.col("past")).alias("byte_offset"), "value", *others)


def read(spark: SparkSession, files: DataFrame, paths: list[str], also: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> DataFrame:
    if not paths:
        return also(spark.createDataFrame([], LINES))
    raw, _ = scan(spark, files, paths, also)
    return number(raw)
