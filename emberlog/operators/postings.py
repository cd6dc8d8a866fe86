"""An inverted index of trigrams for searches of literal text.

Entries lie in blocks of ``ROWS`` rows in their stored order. ``build`` gives a row for each
block and distinct trigram of code points of its ASCII-lowered texts; stored in the order of
(trigram, block), a look-up opens only the parts of its trigrams. A search intersects the
blocks of its rarest trigrams and turns what is left into ranges of blocks, a condition
that the scan pushes down to row groups and pages. It is only a sieve: texts decide. A
text of fewer than three code points, or one that over ``MOST`` blocks may hold, is not
sieved.

Blocks are rows in bounded number, so a text that is everywhere adds a row for each block
and trigram, and no list grows with the data. A trigram across two texts of a block may be
listed though no text holds it, which does no harm.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.strings import ascii_lowered, trigrams
from ..sources import scratch

BLOCK = "block"
SHIFT = 11
ROWS = 1 << SHIFT
#: Trigrams that are looked up at most, blocks that a sieve may leave, and ranges in a condition.
RAREST, MOST, RANGES = 8, 4096, 200
#: Code points of texts that are handled at once.
PART = 1 << 21


def numbered(rows: DataFrame) -> DataFrame:
    """Rows with their block, in the order in which the partitions hold them."""
    return rows.withColumn(BLOCK, F.shiftright(F.monotonically_increasing_id(), SHIFT))


def codes(text: str) -> list[int]:
    """The trigrams of a text as numbers, as ``build`` gives them."""
    return [ord(g[0]) << 42 | ord(g[1]) << 21 | ord(g[2]) for g in trigrams(ascii_lowered(text))]


def _distinct(texts: list[str]) -> np.ndarray:
    x = np.frombuffer("".join(texts).encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
    x = np.where((x >= 65) & (x <= 90), x + 32, x)
    return np.unique(x[:-2] << 42 | x[1:-1] << 21 | x[2:]) if len(x) > 2 else x[:0]


def build(entries: DataFrame, column: str = "raw") -> DataFrame:
    """gram, block: the trigrams of each block's texts (twice where two tasks read a block)."""
    schema = pa.schema([("gram", pa.int64()), (BLOCK, pa.int64())])

    def sent(block: int, grams: set[int] | np.ndarray):
        return pa.RecordBatch.from_arrays([pa.array(grams, pa.int64()), pa.array(np.full(len(grams), block), pa.int64())], schema=schema)

    def run(batches):
        now, held = -1, np.zeros(0, np.int64)
        for b in batches:
            blocks, texts = b.column(BLOCK).to_numpy(), b.column("text")
            sizes = pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False)
            ends = np.append(np.flatnonzero(blocks[1:] != blocks[:-1]) + 1, b.num_rows)
            at = 0
            while at < b.num_rows:
                # rows of one block, a bounded number of bytes at a time (a longer text alone)
                to = int(ends[np.searchsorted(ends, at, "right")])
                to = max(at + 1, at + int(np.searchsorted(np.cumsum(sizes[at:to]), PART, "right")))
                if blocks[at] != now:
                    if len(held):
                        yield sent(now, held)
                    now, held = int(blocks[at]), np.zeros(0, np.int64)
                held = np.union1d(held, _distinct([x for x in texts.slice(at, to - at).to_pylist() if x]))
                at = to
        if len(held):
            yield sent(now, held)

    return entries.select(BLOCK, F.col(column).cast("string").alias("text")).mapInArrow(run, f"gram long, {BLOCK} long")


def write(postings: DataFrame, path: str) -> None:
    """In the order of trigrams; small pages and steps instead of values, as blocks of a trigram follow one another."""
    kept, copy = scratch.save(postings)  # ranges are found on a copy
    out = kept.repartitionByRange("gram", BLOCK).sortWithinPartitions("gram", BLOCK)
    out.write.option("parquet.writer.version", "PARQUET_2_0").option("parquet.page.row.count.limit", 4096).parquet(path)
    scratch.drop(kept.sparkSession, copy)


def candidates(postings: DataFrame, text: str, most: int = MOST) -> list[int] | None:
    """The blocks that may hold a text; None where it is too short or too many may."""
    wanted = codes(text)
    if not wanted:
        return None
    there = postings.where(F.col("gram").isin(wanted))
    counts = {r.gram: r["count"] for r in there.groupBy("gram").count().collect()}  # a row for each trigram of the text
    if len(counts) < len(wanted):
        return []
    rare = sorted(wanted, key=lambda g: (counts[g], g))[:RAREST]
    if counts[rare[0]] > 64 * most:
        return None
    meet = postings.where(F.col("gram").isin(rare)).groupBy(BLOCK).agg(F.count_distinct("gram").alias("n")).where(F.col("n") == len(rare))
    found = sorted(r[BLOCK] for r in meet.select(BLOCK).limit(most + 1).collect())
    return None if len(found) > most else found


def condition(blocks: list[int]) -> Column:
    """Ranges that hold the blocks; the narrowest gaps are closed where there are too many."""
    if not blocks:
        return F.lit(False)
    x = np.array(blocks)
    gaps = np.diff(x)
    cuts = np.flatnonzero(gaps > 1)
    if len(cuts) >= RANGES:
        cuts = np.sort(cuts[np.argsort(-gaps[cuts], kind="stable")[: RANGES - 1]])
    edges = [(int(x[a]), int(x[b])) for a, b in zip([0, *(cuts + 1).tolist()], [*cuts.tolist(), len(x) - 1])]
    return reduce(Column.__or__, [F.col(BLOCK) == a if a == b else F.col(BLOCK).between(a, b) for a, b in edges])


def narrowed(entries: DataFrame, postings: DataFrame | None, text: str) -> DataFrame:
    """Entries of the blocks that may hold a literal text, whatever the case of its ASCII letters."""
    if postings is None or not text:
        return entries
    blocks = candidates(postings, text)
    return entries if blocks is None else entries.where(condition(blocks))
