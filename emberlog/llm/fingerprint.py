"""Document fingerprints by a quartile bucket digest.

Every three neighbouring bytes of a text are hashed into one of ``BUCKETS`` counters.
The digest is the length on a log scale (3 hex digits), the ratios q1/q3 and q2/q3 of the
counters' quartiles (1 hex digit each), then for each counter the quartile it falls into
(2 bits). Two digests differ by at most 3 classes a counter; far classes weigh more, and
the sum is bounded, so that likeness lies in [0, 1]. It is 1 for equal digests.

Null text is the empty text. A text of fewer than three bytes has only empty counters.
Equal texts have equal digests. Extra columns are ignored. Rows with a null doc_id come
after all others in ``next_pairs``; rows of equal doc_id, or without one, are ordered by a hash
of their texts, and of rows equal in both each is followed by another but the last. No rows
give no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import store, text

BUCKETS = 128
#: Cost of codes that differ by 0, 1, 2, 3 quartiles (fixed values of the score).
COSTS = np.array([0, 1, 2, 6], np.int64)
#: Bytes of text in a block of neighbouring documents, about.
BLOCK_BYTES = 1 << 28
#: Rows of the sample from which a block's bounds come.
PER_BLOCK = 8
#: Rows of equal ones that one step writes out again.
COPIES = 4096


def digest(data: np.ndarray, off: np.ndarray, buckets: int = BUCKETS) -> np.ndarray:
    """One row of bytes for each document: length (2), ratios (1), codes (buckets / 4)."""
    docs, size = len(off) - 1, np.diff(off)
    counts = np.zeros((docs, buckets), np.int32)
    if len(data) > 2:
        d = data.astype(np.uint32)
        h = (d[:-2] * np.uint32(0x9E3779B1)) ^ ((d[1:-1] + np.uint32(1)) * np.uint32(0x85EBCA6B)) ^ ((d[2:] + np.uint32(7)) * np.uint32(0xC2B2AE35))
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        slot = (h >> np.uint32(12)) % np.uint32(buckets) + np.repeat(np.arange(docs, dtype=np.int64) * buckets, size)[:-2]
        keep = np.ones(len(slot), bool)
        for back in (1, 2):  # triplets must not cross from one document to the next
            cut = off[1:-1] - back
            keep[cut[(cut >= 0) & (cut < len(keep))]] = False
        counts = np.bincount(slot[keep], minlength=docs * buckets).reshape(docs, buckets)
    ranked = np.sort(counts, axis=1)
    q1, q2, q3 = (ranked[:, buckets * k // 4 - 1][:, None] for k in (1, 2, 3))
    codes = ((counts > q1).astype(np.uint8) + (counts > q2) + (counts > q3)).astype(np.uint8)
    out = np.empty((docs, 3 + buckets // 4), np.uint8)
    length = np.round(16 * np.log2(size + 1)).astype(np.int64)
    out[:, 0], out[:, 1] = length >> 8, length & 255
    top = np.maximum(q3, 1)
    out[:, 2] = ((15 * q1 // top) << 4 | (15 * q2 // top))[:, 0]
    out[:, 3:] = codes[:, 0::4] << 6 | codes[:, 1::4] << 4 | codes[:, 2::4] << 2 | codes[:, 3::4]
    return out


_HALF = np.array([[(x >> s) & 3 for s in (6, 4, 2, 0)] for x in range(256)])
_PAIR = COSTS[np.abs(_HALF[:, None, :] - _HALF[None, :, :])].sum(2).astype(np.uint8)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bounded score of digests row by row; an unrelated pair of random codes gives 0."""
    buckets = 4 * (a.shape[1] - 3)
    apart = _PAIR[a[:, 3:], b[:, 3:]].sum(1, dtype=np.int64)
    lengths = np.abs((a[:, 0].astype(np.int64) << 8 | a[:, 1]) - (b[:, 0].astype(np.int64) << 8 | b[:, 1]))
    ratios = np.abs((a[:, 2] >> 4).astype(np.int64) - (b[:, 2] >> 4)) + np.abs((a[:, 2] & 15).astype(np.int64) - (b[:, 2] & 15))
    bound = 1.625 * buckets
    return np.maximum(0.0, 1.0 - (apart + np.minimum(lengths, 64) + ratios) / bound)


def hexed(rows: np.ndarray) -> list[str]:
    """The length's first hex digit is always 0 and is left out."""
    raw, width = rows.tobytes().hex(), 2 * rows.shape[1]
    return [raw[i + 1 : i + width] for i in range(0, len(raw), width)]


FINGERPRINTS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("fingerprint", T.StringType())])


def fingerprints(docs: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, fingerprint of every row, without a shuffle."""
    schema = pa.schema([("doc_id", pa.int64()), ("fingerprint", pa.string())])

    def run(it):
        for part, data, off in text.slices(it):
            yield text.table(schema, part.column("doc_id"), hexed(digest(data, off, buckets)))

    return store.documents(docs).mapInArrow(run, FINGERPRINTS)


NEXT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edited(own: str, following: str) -> str:
    """The last third of ``own`` replaced by the beginning of ``following``."""
    cut = len(own) // 3
    return own[: len(own) - cut] + following[:cut]


class Blocks:
    """Ranges of documents in their order: descending doc_id (null last), then a hash of the text.

    ``bounds`` are the first keys (~doc_id, hash) of all blocks but the first.
    """

    def __init__(self, bounds: list[tuple[int, int]]):
        self.ids, self.ties = (np.array([b[i] for b in bounds], np.int64) for i in (0, 1))

    def of(self, ids: np.ndarray, ties: np.ndarray) -> np.ndarray:
        low, high = np.searchsorted(self.ids, ids, "left"), np.searchsorted(self.ids, ids, "right")
        for x in np.unique(ids[low < high]).tolist():  # an id whose rows are spread over blocks
            at = np.flatnonzero(ids == x)
            a, b = int(low[at[0]]), int(high[at[0]])
            low[at] = a + np.searchsorted(self.ties[a:b], ties[at], "right")
        return low


def _keys(d: DataFrame) -> DataFrame:
    """doc_id, text, the key (id, tie) by which documents follow one another."""
    last = F.lit((1 << 63) - 1)
    return d.select("doc_id", "text", F.coalesce(F.bitwise_not("doc_id"), last).alias("id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("tie"))


def next_pairs(docs: DataFrame, count: int | None = None, buckets: int = BUCKETS) -> DataFrame:
    """Each document against its edited text and against the next one in descending doc_id.

    Documents are dealt once, by block of neighbouring ones. The first document of a
    block is also sent to the block before it (and the very first one to the last block),
    so each block finds all its successors itself. The driver holds the bounds and first keys
    of the blocks, which come from a sample; any bounds give the same rows. Of rows equal
    in doc_id and text one takes part, under the number of them.
    """
    spark, d = docs.sparkSession, _keys(store.documents(docs))
    shared, _ = store.save(d.select("id", "tie").groupBy("id", "tie").agg(F.count("*").alias("n")).where("n > 1"))
    repeated = bool(shared.head(1))
    one = F.lit(1).cast("long")
    if repeated:
        again = d.join(shared, ["id", "tie"]).dropDuplicates(["id", "tie"]).select("doc_id", "text", "id", "tie", "n")
        d = d.join(shared, ["id", "tie"], "left_anti").select("doc_id", "text", "id", "tie", one.alias("n")).unionByName(again)
    else:
        d = d.withColumn("n", one)
    size = d.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    count = max(1, min(count or max(2 * store.partitions(spark), size.bytes // BLOCK_BYTES), size.n))
    step = max(1, size.n // (count * PER_BLOCK))
    some = sorted((r.id, r.tie) for r in d.where(F.pmod(F.xxhash64("id", "tie"), F.lit(step)) == 0).select("id", "tie").collect())
    blocks = Blocks(sorted({some[len(some) * i // count] for i in range(1, count)} if some else ()))

    def find(it):
        for b in it:
            ids, ties = (b.column(x).to_numpy() for x in ("id", "tie"))
            yield pa.RecordBatch.from_arrays([pa.array(blocks.of(ids, ties)), b.column("id"), b.column("tie")], names=["block", "id", "tie"])

    tops = {r.block: (r.top.id, r.top.tie) for r in d.select("id", "tie").mapInArrow(find, "block long, id long, tie long").groupBy("block").agg(F.min(F.struct("id", "tie")).alias("top")).collect()}
    order = sorted(tops)
    before = {b: order[i - 1] for i, b in enumerate(order)}  # the block whose last row needs b's first one

    def deal(it):
        schema = pa.schema([("block", pa.int64()), ("tail", pa.int32()), ("id", pa.int64()), ("tie", pa.int64()), ("doc_id", pa.int64()), ("text", pa.string()), ("n", pa.int64())])
        for part, _, _ in text.slices(it):
            ids, ties, body = part.column("id"), part.column("tie"), part.column("text").fill_null("")
            own = blocks.of(ids.to_numpy(), ties.to_numpy())
            yield text.table(schema, own, np.zeros(len(own), np.int32), ids, ties, part.column("doc_id"), body, part.column("n"))
            heads = [i for i, (b, *k) in enumerate(zip(own.tolist(), ids.to_pylist(), ties.to_pylist(), strict=True)) if tops[b] == tuple(k)]
            if heads:
                take = pa.array(heads)
                yield text.table(schema, [before[own[i]] for i in heads], np.ones(len(heads), np.int32), *(x.take(take) for x in (ids, ties, part.column("doc_id"), body, part.column("n"))))

    def compare(it):
        schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("times", pa.int64())])
        last = None  # the block's row whose successor is still to come: block, id, text, digest
        for part, data, off in text.slices(it):
            own, tail, ids, n, texts = *(part.column(x).to_pylist() for x in ("block", "tail", "doc_id", "n")), text.strings(data, off)
            prints = digest(data, off, buckets)
            out, mine, nexts = [], [], []
            for i, b in enumerate(own):
                if last is not None and last[0] == b:
                    out.append((last[1], last[2], edited(last[2], texts[i]), 1))
                    mine.append(last[3])
                    nexts.append(prints[i])
                if tail[i]:
                    last = None
                    continue
                if n[i] > 1:  # equal rows, each but the last one followed by another
                    out.append((ids[i], texts[i], edited(texts[i], texts[i]), n[i] - 1))
                    mine.append(prints[i])
                    nexts.append(prints[i])
                last = (b, ids[i], texts[i], prints[i])
            if out:
                new = pa.array([x[2] for x in out], pa.large_string())
                changed = digest(*text.buffers(new), buckets)
                mine, nexts = np.array(mine), np.array(nexts)
                yield text.table(schema, [x[0] for x in out], [len(x[1]) for x in out], [hashlib.sha256(x[2].encode()).hexdigest() for x in out], hexed(mine), hexed(changed), likeness(mine, changed), likeness(mine, nexts), [x[3] for x in out])

    dealt = d.mapInArrow(deal, "block long, tail int, id long, tie long, doc_id long, text string, n long")
    found = dealt.repartitionById(store.partitions(spark), (F.col("block") % store.partitions(spark)).cast("int")).sortWithinPartitions("block", "tail", "id", "tie").mapInArrow(compare, f"{NEXT}, times long")
    if repeated:
        found = found.withColumn("step", F.explode(F.sequence(F.lit(0), F.floor((F.col("times") - 1) / COPIES)))).repartition(store.partitions(spark))
        found = found.withColumn("copy", F.explode(F.sequence(F.lit(1), F.least(F.lit(COPIES), F.col("times") - COPIES * F.col("step")))))
    return found.select(*[x.split()[0] for x in NEXT.split(", ")])
