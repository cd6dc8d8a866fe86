"""Counts of each block's rows by level and file: totals, bounds and pages without a scan.

Blocks (``postings.numbered``) of a stored index follow one another in the order of results,
so the place of any offset among the rows of some levels, files and times is found from
sums of counts alone: by groups of blocks first, then by blocks. A block may straddle the
beginning or the end of the time asked for; there is one at most for each, and its rows are
counted themselves. A page then reads the blocks between its first and its last row.

Up to ``SMALL`` rows the summary is held by the driver; a larger one is summed by Spark, a
few thousand groups at a time.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.strings import find_ignoring_case
from ..functions.times import format_iso
from .filters import QueryFilter
from .postings import BLOCK

SMALL = 1 << 17
#: Steps from groups of blocks to blocks; a partition's blocks share what is above 22 bits.
SHIFTS = (32, 22, 0)
#: Files that a condition on sources may name.
FILES = 10_000


def build(entries: DataFrame) -> DataFrame:
    return entries.groupBy(BLOCK, "level", "file_id").agg(F.count("*").alias("n"), F.min("ts_millis").alias("first_ts"), F.max("ts_millis").alias("last_ts"))


def write(summary: DataFrame, path: str) -> None:
    summary.repartitionByRange(BLOCK).sortWithinPartitions(BLOCK).write.parquet(path)


def answers(query: QueryFilter) -> bool:
    """Whether only levels, files and times are asked for."""
    return not (query.logger or query.thread or query.message or query.grep)


class Summary:
    def __init__(self, rows: DataFrame, small: int = SMALL):
        self.rows, self.small = rows, small
        self._held: dict[str, np.ndarray] | None | bool = None

    def held(self) -> dict[str, np.ndarray] | bool:
        """The columns where they are few, or False."""
        if self._held is None:
            t = self.rows.limit(self.small + 1).toArrow()
            self._held = {c: t.column(c).to_numpy() for c in t.column_names} if t.num_rows <= self.small else False
        return self._held

    def bounds(self) -> DataFrame:
        """total, first and last time (ISO, null if there is nothing)."""
        return self.rows.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), format_iso(F.min("first_ts")).alias("first"), format_iso(F.max("last_ts")).alias("last"))

    def of(self, query: QueryFilter, entries: DataFrame, files: DataFrame) -> Counts | None:
        """The counts of a query that ``answers``; None where it names too many files."""
        wanted = None
        if query.source:
            wanted = [r.file_id for r in files.where(find_ignoring_case(F.col("path"), query.source)).select("file_id").limit(FILES + 1).collect()]
            if len(wanted) > FILES:
                return None
        return Counts(self, query, wanted, entries)


class Counts:
    """Numbers of matching rows by groups of blocks."""

    def __init__(self, summary: Summary, query: QueryFilter, files: list[int] | None, entries: DataFrame):
        self.summary, self.query, self.files, self.entries = summary, query, files, entries
        self.exact: dict[int, int] = {}
        edges = [t for t in (query.since, None if query.until is None else query.until + 1) if t is not None]
        if edges:
            blocks = sorted({b for t in edges for b in self._straddling(t)})
            self.exact = dict.fromkeys(blocks, 0)
            if blocks:
                self.exact |= {r[BLOCK]: r["count"] for r in self.rows(entries.where(F.col(BLOCK).isin(blocks))).groupBy(BLOCK).count().collect()}

    def rows(self, entries: DataFrame) -> DataFrame:
        out = entries.where(self.query.column())
        return out if self.files is None else out.where(F.col("file_id").isin(self.files))

    def _straddling(self, t: int) -> list[int]:
        """The blocks with rows before and from time t on."""
        if (held := self.summary.held()) is not False:
            if not len(held[BLOCK]):
                return []
            blocks, at = np.unique(held[BLOCK], return_inverse=True)
            least, most = np.full(len(blocks), np.iinfo(np.int64).max), np.full(len(blocks), np.iinfo(np.int64).min)
            np.minimum.at(least, at, held["first_ts"])
            np.maximum.at(most, at, held["last_ts"])
            return blocks[(least < t) & (most >= t)].tolist()
        each = self.summary.rows.groupBy(BLOCK).agg(F.min("first_ts").alias("a"), F.max("last_ts").alias("b"))
        return [r[BLOCK] for r in each.where((F.col("a") < t) & (F.col("b") >= t)).collect()]  # blocks are in order of time: one

    def sums(self, shift: int, group: tuple[int, int] | None = None) -> list[tuple[int, int]]:
        """(group of blocks, rows) in order, within one group of an earlier shift."""
        low, high = (None, None) if group is None else (group[1] << group[0], (group[1] + 1) << group[0])
        q, out = self.query, {}
        if (held := self.summary.held()) is not False:
            on = np.ones(len(held[BLOCK]), bool)
            for given, test in ((q.levels, lambda: np.isin(held["level"].astype(str), sorted(q.levels))), (self.files is not None, lambda: np.isin(held["file_id"], self.files or [])), (q.since is not None, lambda: held["first_ts"] >= q.since), (q.until is not None, lambda: held["last_ts"] <= q.until), (self.exact, lambda: ~np.isin(held[BLOCK], list(self.exact))), (low is not None, lambda: (held[BLOCK] >= low) & (held[BLOCK] < high))):
                if given:
                    on &= test()
            groups, at = np.unique(held[BLOCK][on] >> shift, return_inverse=True)
            out = dict(zip(groups.tolist(), np.bincount(at, held["n"][on], len(groups)).astype(np.int64).tolist(), strict=True))
        else:
            rows = self.summary.rows
            for given, test in ((q.levels, F.col("level").isin(*sorted(q.levels))), (self.files is not None, F.col("file_id").isin(self.files or [])), (q.since is not None, F.col("first_ts") >= F.lit(q.since)), (q.until is not None, F.col("last_ts") <= F.lit(q.until)), (self.exact, ~F.col(BLOCK).isin(list(self.exact))), (low is not None, F.col(BLOCK).between(low, (high or 0) - 1))):
                if given:
                    rows = rows.where(test)
            out = {r.g: r.n for r in rows.groupBy(F.shiftright(BLOCK, shift).alias("g")).agg(F.sum("n").alias("n")).collect()}
        for block, n in self.exact.items():
            if low is None or low <= block < high:
                out[block >> shift] = out.get(block >> shift, 0) + n
        return sorted((g, n) for g, n in out.items() if n)

    def total(self) -> int:
        return sum(n for _, n in self.sums(SHIFTS[0]))

    def place(self, position: int) -> tuple[int, int]:
        """The block of a row by its position among the matching ones, and the rows before that block."""
        group, before = None, 0
        for shift in SHIFTS:
            for g, n in self.sums(shift, group):
                if before + n > position:
                    group = shift, g
                    break
                before += n
        return group[1], before

    def page(self, offset: int, limit: int, total: int) -> tuple[DataFrame, int]:
        """The matching rows of the blocks that hold a page, and how many of them come before it."""
        if limit <= 0 or offset >= total:
            return self.entries.limit(0), 0
        first, before = self.place(offset)
        last, _ = self.place(min(offset + limit, total) - 1)
        return self.rows(self.entries.where(F.col(BLOCK).between(first, last))), offset - before
