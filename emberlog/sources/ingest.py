"""Entries of log files in one scan: splits are assembled where they are read.

A task reads the lines of its splits in order, so it can number them, sum their bytes and
put entries together itself; it tells places within the split only. What a split begins
with before its first header belongs to an entry of an earlier split: it comes as one piece
of its own. A last row for each split has its numbers of lines and bytes. From these rows,
one for each split, windows give what lies before each split of a file and the split that
its first piece goes back to. Lines are never shuffled, only the last entries of splits
meet pieces, and one copy of the entries is written.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.strings import is_blank_line, preview
from . import scratch

FIELDS = ("ts_millis", "logger", "level", "thread", "message")
ENTRY, LEAD, BROKEN, SPLIT = range(4)
SCHEMA = pa.schema(
    [("kind", pa.int32()), ("path", pa.string()), ("split", pa.int64()), ("line", pa.int64()), ("byte", pa.int64()), ("size", pa.int64()), ("flag", pa.bool_()), ("ts_millis", pa.int64()), *((c, pa.binary()) for c in FIELDS[1:]), ("raw", pa.binary())]
)
#: Texts travel as bytes, which need not be valid UTF-8.
#: ``flag``: of an entry, that it is its split's last; of a broken line, that it is before the first header; of a split, that it has a header.
PARTS = "kind int, path string, split long, line long, byte long, size long, flag boolean, ts_millis long, logger binary, level binary, thread binary, message binary, raw binary"
FLUSH = 4 << 20


class _Split:
    """What is known of the split that is being read."""

    def __init__(self, path: str, split: int):
        self.path, self.split, self.lines, self.bytes = path, split, 0, 0
        self.head: list | None = None  # of the entry that is open
        self.line = self.byte = 0
        self.texts: list[bytes] = []
        self.begun = False


class _Rows:
    """Finished rows, sent a few MB at a time."""

    def __init__(self):
        self.rows: list[list] = []
        self.held = 0

    def add(self, *row) -> None:
        self.rows.append(list(row))
        self.held += len(row[-1] or "") + 64

    def batch(self) -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array([r[i] for r in self.rows], f.type) for i, f in enumerate(SCHEMA)], schema=SCHEMA)
        self.rows, self.held = [], 0
        return out


_NONE = [None] * len(FIELDS)


def _close(rows: _Rows, s: _Split, last: bool) -> None:
    """The open entry, or what stood before the first header, is finished."""
    if s.begun or s.texts:
        raw = b"\n".join(s.texts)
        kind, head = (ENTRY, s.head) if s.begun else (LEAD, _NONE)
        rows.add(kind, s.path, s.split, s.line, s.byte, s.bytes - s.byte, last, *head, raw)
    s.texts = []


def _end(rows: _Rows, s: _Split) -> None:
    _close(rows, s, True)
    rows.add(SPLIT, s.path, s.split, s.lines, s.bytes, 0, s.begun, *_NONE, None)


def _assembled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows, now = _Rows(), None
    for b in batches:
        if not b.num_rows:
            continue
        path, split = b.column("path"), b.column("split").to_numpy()
        size = b.column("bytes").to_numpy() + 1
        heads, broken = np.flatnonzero(b.column("is_head").to_numpy(zero_copy_only=False)), np.flatnonzero(b.column("broken").to_numpy(zero_copy_only=False))
        values, fields = b.column("value").to_pylist(), [b.column(c).take(pa.array(heads)).to_pylist() for c in FIELDS]
        ends = np.cumsum(size)
        other = np.flatnonzero((split[1:] != split[:-1]) | pc.not_equal(path.slice(1), path.slice(0, len(path) - 1)).to_numpy(zero_copy_only=False)) + 1
        for s, e in zip([0, *other.tolist()], [*other.tolist(), b.num_rows]):
            own = path[s].as_py(), int(split[s])
            if now is None or (now.path, now.split) != own:
                if now is not None:
                    _end(rows, now)
                now = _Split(*own)
            lines0, bytes0, base = now.lines - s, now.bytes, int(ends[s - 1]) if s else 0
            cuts = heads[np.searchsorted(heads, s) : np.searchsorted(heads, e)].tolist()
            nth = int(np.searchsorted(heads, s))
            for k in broken[np.searchsorted(broken, s) : np.searchsorted(broken, e)].tolist():
                rows.add(BROKEN, *own, lines0 + k, 0, 0, not now.begun and (not cuts or k < cuts[0]), *_NONE, values[k])
            now.texts += values[s : cuts[0] if cuts else e]
            for i, (at, to) in enumerate(zip(cuts, [*cuts[1:], e])):
                now.bytes = bytes0 + (int(ends[at - 1]) if at else 0) - base
                _close(rows, now, False)
                now.begun, now.head = True, [f[nth + i] for f in fields]
                now.line, now.byte, now.texts = lines0 + at, now.bytes, values[at:to]
                if rows.held >= FLUSH:
                    yield rows.batch()
            now.lines, now.bytes = lines0 + e, bytes0 + int(ends[e - 1]) - base
        if rows.held >= FLUSH:
            yield rows.batch()
    if now is not None:
        _end(rows, now)
    if rows.rows:
        yield rows.batch()


def scanned(spark: SparkSession, paths: list[str], headed: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Rows of ``PARTS`` for all splits of the files."""
    text = spark.read.option("lineSep", "\n").text(paths)
    rows = text.select(
        "value",
        F.octet_length("value").cast("long").alias("bytes"),
        F.regexp_replace(F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))), r"^file:/*(?=/)", "").alias("path"),
        F.col("_metadata.file_block_start").alias("split"),
    )
    seen = headed(rows).select("path", "split", "bytes", F.col("value").cast("binary").alias("value"), "broken", F.col("head").isNotNull().alias("is_head"), "head.ts_millis", *[F.col(f"head.{c}").cast("binary").alias(c) for c in FIELDS[1:]])
    return seen.mapInArrow(_assembled, PARTS)


def read(spark: SparkSession, files: DataFrame, paths: list[str], headed: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame, list[str]]:
    """(entries, skipped lines, copies to drop when both are done with)."""
    parts, copy = scratch.save(scanned(spark, paths, headed))
    for c in (*FIELDS[1:], "raw"):
        parts = parts.withColumn(c, F.col(c).cast("string"))
    past = Window.partitionBy("path").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    splits = parts.where(F.col("kind") == SPLIT).select(
        "path",
        "split",
        F.coalesce(F.sum("line").over(past), F.lit(0)).alias("line0"),
        F.coalesce(F.sum("byte").over(past), F.lit(0)).alias("byte0"),
        F.max(F.when(F.col("flag"), F.col("split"))).over(past).alias("owner"),
    )
    splits, splits_copy = scratch.save(splits.join(files.select("path", "file_id", F.col("size").alias("file_size")), "path"))
    placed = parts.where(F.col("kind") != SPLIT).join(splits, ["path", "split"]).withColumn("line_no", F.col("line0") + F.col("line") + 1).withColumn("byte_offset", F.col("byte0") + F.col("byte"))
    found = placed.where(F.col("kind") == ENTRY).select("file_id", "split", "flag", "line_no", "byte_offset", (F.col("byte_offset") + F.col("size")).alias("end"), "file_size", *FIELDS, "raw")
    # what splits begin with goes to the last entry of the split that it goes back to
    leads = placed.where((F.col("kind") == LEAD) & F.col("owner").isNotNull()).groupBy("file_id", F.col("owner").alias("split")).agg(
        F.max(F.col("byte_offset") + F.col("size")).alias("lead_end"), F.concat(F.lit("\n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col("split").alias("at"), "raw"))), lambda x: x["raw"]), "\n")).alias("more")
    )
    last = found.where("flag").join(leads, ["file_id", "split"], "left")
    last = last.withColumn("raw", F.concat("raw", F.coalesce("more", F.lit("")))).withColumn("end", F.coalesce("lead_end", "end")).select(found.columns)
    entries = found.where("not flag").unionAll(last).select(
        "file_id",
        "line_no",
        "byte_offset",
        F.least("end", "file_size").alias("end_byte_offset"),
        *FIELDS,
        # the last line of a file may have no line end
        F.when(F.col("end") <= F.col("file_size"), F.concat("raw", F.lit("\n"))).otherwise(F.col("raw")).alias("raw"),
    )
    orphans = placed.where((F.col("kind") == LEAD) & F.col("owner").isNull()).select("file_id", "line_no", F.posexplode(F.split("raw", "\n")).alias("nth", "value")).select("file_id", (F.col("line_no") + F.col("nth")).alias("line_no"), "value").where(~is_blank_line(F.col("value")))
    broken = placed.where((F.col("kind") == BROKEN) & ~(F.col("flag") & F.col("owner").isNull())).select("file_id", "line_no", F.col("raw").alias("value"))
    skipped = orphans.unionAll(broken).select("file_id", "line_no", preview(F.col("value")).alias("preview"))
    return entries, skipped, [copy, splits_copy]
