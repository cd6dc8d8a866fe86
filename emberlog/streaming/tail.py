"""New log files as a stream of micro-batches.

Each file is read once, when it appears; its entries are assembled as in a batch and
appended to a Parquet folder named by the batch, so that a batch that runs again replaces
its own output. (Following a file that still grows is left to the file's rotation.)
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..operators.custom import CustomLayout
from ..operators.entries import assemble
from ..sources import lines


def follow(spark: SparkSession, folder: str, out: str, checkpoint: str, layout: str | CustomLayout = "default") -> StreamingQuery:
    """Start the query; its file ids are hashes of paths, since no list of files is final."""
    stream = spark.readStream.option("lineSep", "\n").text(folder)
    rows = stream.select(
        "value",
        F.octet_length("value").cast("long").alias("bytes"),
        F.xxhash64(F.col("_metadata.file_path")).alias("file_id"),
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("split"),
    )

    def write(batch: DataFrame, number: int) -> None:
        kept = batch.withColumn("mid", F.monotonically_increasing_id()).persist()
        entries, _ = assemble(lines.number(kept.drop("path")), layout)
        entries.join(kept.select("file_id", "path").distinct(), "file_id").write.mode("overwrite").parquet(f"{out}/batch={number}")
        kept.unpersist()

    return stream_writer(rows, checkpoint).foreachBatch(write).start()


def stream_writer(rows: DataFrame, checkpoint: str):
    return rows.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
