"""The conditions of a search as one Column.

All conditions hold together; a missing or empty one holds always. Patterns are Java
regular expressions, found anywhere, with only ASCII letters folded.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.strings import find_ignoring_case, is_plain, quoted
from ..functions.times import parse_ui_datetime
from . import postings as text_index
from .custom import check_pattern


def parse_levels(text: str | None) -> frozenset[str]:
    return frozenset(x.strip().upper() for x in (text or "").split(",") if x.strip())


@dataclass(frozen=True)
class QueryFilter:
    levels: frozenset[str] = frozenset()
    source: str = ""
    logger: str = ""
    thread: str = ""
    message: str = ""
    grep: str = ""
    since: int | None = None
    until: int | None = None

    @classmethod
    def of(cls, level: str | None = None, since: str | None = None, until: str | None = None, **patterns: str | None) -> QueryFilter:
        """From what users type."""
        return cls(parse_levels(level), since=parse_ui_datetime(since), until=parse_ui_datetime(until), **{k: v or "" for k, v in patterns.items()})

    def check(self, spark: SparkSession) -> None:
        """ValueError before anything runs, if a pattern does not compile by itself."""
        for p in (self.source, self.logger, self.thread, self.message, self.grep):
            if p:
                check_pattern(spark, p)

    def column(self) -> Column:
        """All but ``source``; cheap conditions first, the whole text last."""
        found = []
        if self.levels:
            found.append(F.col("level").isin(*sorted(self.levels)))
        if self.since is not None:
            found.append(F.col("ts_millis") >= self.since)
        if self.until is not None:
            found.append(F.col("ts_millis") <= self.until)
        found += [find_ignoring_case(F.col(c), p) for c, p in (("logger", self.logger), ("thread", self.thread), ("message", self.message), ("raw", self.grep)) if p]
        out = F.lit(True)
        for c in found:
            out = out & c
        return out

    def apply(self, entries: DataFrame, files: DataFrame, postings: DataFrame | None = None) -> DataFrame:
        """Source patterns are tried once for each file; the file list joins as a semi-join.

        With ``postings`` a literal text is looked for only in the blocks that may hold it.
        """
        out = text_index.narrowed(entries, postings, self.grep) if is_plain(self.grep) else entries
        out = out.where(self.column())
        if self.source:
            matching = files.where(find_ignoring_case(F.col("path"), self.source)).select("file_id")
            out = out.join(matching, "file_id", "left_semi")
        return out


def same_context(source: str, thread: str) -> dict[str, str]:
    """Conditions for the rows of one file and thread."""
    return {"source": quoted(source), "thread": quoted(thread)}
