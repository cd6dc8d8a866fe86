"""Entries from lines: a header line and what follows it up to the next one.

A line that is no header continues the entry before it; before any header it is skipped,
if it is not blank. Blank lines count as lines and stay in an entry's bytes. A header
whose time cannot be read is skipped too; it ends no entry and stays in its bytes.

The last header before a line is found within its split, and across splits from one row
for each split, so that one large file is as many tasks as it has splits.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.strings import is_blank_line, preview
from ..sources import scratch
from .custom import CustomLayout
from .layouts import with_header

ENTRY = ("file_id", "line_no", "byte_offset", "end_byte_offset", "ts_millis", "logger", "level", "thread", "message", "raw")
SAMPLES = 5
Format = str | CustomLayout


def with_head(lines: DataFrame, layout: Format, name: str = "head") -> DataFrame:
    """Lines with what a layout reads from them (null for no header)."""
    value = F.col("value")
    return layout.with_header(lines, value, name) if isinstance(layout, CustomLayout) else with_header(lines, layout, value, name)


def headed(lines: DataFrame, layout: Format) -> DataFrame:
    """Lines with head (parsed, or null), broken (a header that cannot be read) and blank."""
    value = F.col("value")
    broken = F.col("head").isNull() & layout.shape(value) if isinstance(layout, CustomLayout) else F.lit(False)
    return with_head(lines, layout).withColumn("broken", broken).withColumn("blank", is_blank_line(value))


def marked(seen: DataFrame) -> DataFrame:
    """Lines of ``headed`` with entry_line, the line number of their header, and a skip flag."""
    at = F.when(F.col("head").isNotNull(), F.col("line_no"))
    last = seen.groupBy("file_id", "split").agg(F.max(at).alias("last"))
    before = Window.partitionBy("file_id").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    carry = last.select("file_id", "split", F.max("last").over(before).alias("carry"))
    inside = Window.partitionBy("file_id", "split").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    own = seen.withColumn("own", F.max(at).over(inside)).join(carry, ["file_id", "split"])
    tied = own.withColumn("entry_line", F.coalesce("own", "carry")).drop("own", "carry")
    return tied.withColumn("skipped", ~F.col("blank") & F.col("head").isNull() & (F.col("entry_line").isNull() | F.col("broken")))


def assemble(lines: DataFrame, layout: Format, sizes: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(entries, skipped lines).

    Lines that went through ``headed`` already are not parsed again. ``sizes`` (file_id,
    size) tells where files end; without it every line ends with ``\\n``. ``raw`` is the text of the entry's bytes, with the line ends in it.
    """
    # marked once; entries and skipped lines read that copy
    rows, _ = scratch.save(marked(lines if "head" in lines.columns else headed(lines, layout)))
    named = rows.where("entry_line is not null")
    # lines of one entry are sorted within its own group
    bodies = named.groupBy("file_id", "entry_line").agg(
        F.max_by("head", F.col("head").isNotNull()).alias("head"),
        F.min("byte_offset").alias("byte_offset"),
        F.max(F.col("byte_offset") + F.octet_length("value") + 1).alias("end"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "value"))), lambda x: x["value"]), "\n").alias("body"),
    )
    if sizes is not None:
        bodies = bodies.join(sizes.select("file_id", "size"), "file_id", "left")
        end, whole = F.least("end", F.coalesce("size", "end")), F.col("end") <= F.coalesce("size", "end")
    else:
        end, whole = F.col("end"), F.lit(True)
    entries = bodies.select(
        "file_id",
        F.col("entry_line").alias("line_no"),
        "byte_offset",
        end.alias("end_byte_offset"),
        *[F.col(f"head.{c}") for c in ("ts_millis", "logger", "level", "thread", "message")],
        F.when(whole, F.concat("body", F.lit("\n"))).otherwise(F.col("body")).alias("raw"),
    )
    skipped = rows.where("skipped").select("file_id", "line_no", preview(F.col("value")).alias("preview"))
    return entries, skipped


def skipped_summary(skipped: DataFrame) -> tuple[int, list[tuple[int, int, str]]]:
    """How many lines were skipped, and the first few in order."""
    kept, copy = scratch.save(skipped)
    first = kept.orderBy("file_id", "line_no").limit(SAMPLES).collect()
    count = kept.count()
    scratch.drop(skipped.sparkSession, copy)
    return count, [(r.file_id, r.line_no, r.preview) for r in first]


DETECT_LINES = 500


def detect(lines: DataFrame, candidates: list[Format]) -> str:
    """The id of the layout that reads most of the first 500 lines of the first file; ties go to the
    earlier one, and ``default`` wins if none reads any."""
    if not candidates:
        return "default"
    few = lines.where((F.col("file_id") == 1) & (F.col("line_no") <= DETECT_LINES)).select("value").limit(DETECT_LINES).collect()
    head = lines.sparkSession.createDataFrame(few, "value string")
    # one small compiled plan for each layout
    counts = [with_head(head, x).agg(F.count("head").alias("n")).select(F.lit(i).alias("i"), "n") for i, x in enumerate(candidates)]
    hits = {r.i: r.n for r in reduce(DataFrame.unionAll, counts).collect()}
    best = max(hits, key=lambda i: (hits[i], -i))
    chosen = candidates[best]
    return "default" if not hits[best] else chosen.id if isinstance(chosen, CustomLayout) else chosen
