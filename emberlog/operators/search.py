"""Counts, pages and single entries, always in the order (ts_millis, file_id, line_no)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.strings import truncated, without_line_end
from ..functions.times import format_iso
from .filters import QueryFilter
from .summary import Summary, answers

ORDER = ("ts_millis", "file_id", "line_no")
DEFAULT_LIMIT, MAX_LIMIT = 500, 5000


def number_of(text: str | int | None, default: int) -> int:
    """A whole number that a user typed; ValueError for other text."""
    if text is None or text == "":
        return default
    try:
        return int(text)
    except (TypeError, ValueError) as e:
        raise ValueError(f"not a whole number: {text}") from e


def ordered(rows: DataFrame, newest_first: bool = False) -> DataFrame:
    return rows.orderBy(*[F.desc(c) if newest_first else F.asc(c) for c in ORDER])


def page(rows: DataFrame, offset: int = 0, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """One page; offsets and limits are brought into their bounds."""
    limit = max(0, min(limit, MAX_LIMIT))
    return rows.limit(0) if limit == 0 else ordered(rows).offset(max(0, offset)).limit(limit)


def pages(total: int, limit: int) -> int:
    return -(-total // limit) if limit > 0 else 0


def search(entries: DataFrame, files: DataFrame, query: QueryFilter, offset: int = 0, limit: int = DEFAULT_LIMIT, postings: DataFrame | None = None, counts: Summary | None = None) -> tuple[int, DataFrame]:
    """(total, page). The total counts all matches, whatever the page; a pattern's text is
    read only where the cheaper conditions hold, and a page alone reads ``raw``.

    With ``counts``, levels, files and times are counted there, and a page reads its blocks."""
    query.check(entries.sparkSession)
    if counts is not None and answers(query) and (found := counts.of(query, entries, files)) is not None:
        total, offset, limit = found.total(), max(0, offset), max(0, min(limit, MAX_LIMIT))
        rows, skipped = found.page(offset, limit, total)
        return total, with_source(page(rows, skipped, limit), files)
    matching = query.apply(entries, files, postings)
    return matching.count(), with_source(page(matching, offset, limit), files)


def with_source(rows: DataFrame, files: DataFrame) -> DataFrame:
    return ordered(rows.join(files.select("file_id", F.col("path").alias("source")), "file_id"))


def shown(rows: DataFrame, raw: Column | None = None) -> DataFrame:
    """The columns of a result list."""
    text = F.lit(None).cast("string") if raw is None else truncated(raw)
    return rows.select(format_iso(F.col("ts_millis")).alias("timestamp"), "level", "logger", "thread", "message", "source", "line_no", text.alias("raw"))


def bounds(entries: DataFrame) -> DataFrame:
    """total, first and last time (ISO, null if there is nothing)."""
    return entries.agg(F.count("*").alias("total"), format_iso(F.min("ts_millis")).alias("first"), format_iso(F.max("ts_millis")).alias("last"))


def find_entry(entries: DataFrame, files: DataFrame, source: str, line_no: int, ts_millis: int | None = None) -> DataFrame:
    """The entry of a file's line, with its text without the line end."""
    at = files.where(F.col("path") == source).select("file_id", F.col("path").alias("source"))
    rows = entries.where(F.col("line_no") == line_no)
    if ts_millis is not None:
        rows = rows.where(F.col("ts_millis") == ts_millis)
    return rows.join(at, "file_id").withColumn("raw", without_line_end(F.col("raw"))).limit(1)
