"""Near-duplicate documents by HyperMinHash, confirmed on full shingle sets.

A document's shingles are hashed into ``REGISTERS`` buckets. A bucket keeps its least hash
as a count of leading zeros (6 bits) and the 10 mantissa bits after them; empty buckets
borrow from filled ones in a fixed order. Registers are banded, four to a band. In a
band's bucket, registers are compared block by block; pairs whose collision-corrected
Jaccard estimate is not below the threshold by ``MARGIN`` standard errors form families,
and within a family full sets decide, members being compared until each is in its
component. A pair at the threshold 0.85 is missed by all 32 bands with a chance of 6e-11 and
by the estimate with one of 4e-9 (at 0.80: 5e-8 and 1e-9); pairs above it with less.

Equal sets are one class, so copies are never compared with one another. A family or
bucket of any size is cut into blocks; no pair is written out. Null or blank text has no
shingles and links with nothing; a text of fewer words than a shingle is one shingle.
Each row is judged by its own text, rows of one doc_id too; rows whose doc_id is null
link with nothing and keep a null component. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import graph, store, text

REGISTERS, ROWS = 128, 4
BANDS = REGISTERS // ROWS
MANTISSA = 10
MARGIN = 6.5
#: Members of a bucket or family that one block holds, and shingles of a family's block, about.
BLOCK, HEAVIEST = 512, 1 << 20

_U = np.uint64
_rank = np.random.default_rng(20240229).permuted(np.tile(np.arange(REGISTERS), (REGISTERS, 1)), axis=1)
#: _borrow[i] lists the buckets from which an empty bucket i borrows, first choice first.
_borrow = np.argsort(_rank, axis=1)


def shingle_sets(data: np.ndarray, off: np.ndarray, size: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each document."""
    w = text.words(data, off)
    hashes = text.word_hashes(data, w)
    counts = np.diff(w.first)
    begin = np.arange(len(hashes))
    whole = np.minimum(size, counts)[w.doc]
    ok = begin + whole <= w.first[1:][w.doc]
    begin, whole = begin[ok], whole[ok]
    grams = text.span_hashes(hashes, begin, begin + whole)
    edges = np.searchsorted(begin, w.first)
    return [np.unique(grams[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """Compressed registers (uint16) of non-empty sets, one row for each."""
    n = len(sets)
    if not n:
        return np.zeros((0, REGISTERS), np.uint16)
    allh = text.mix(np.concatenate(sets) ^ _U(0x5851F42D4C957F2D))
    slot = np.repeat(np.arange(n) * REGISTERS, [len(x) for x in sets]) + (allh & _U(REGISTERS - 1)).astype(np.int64)
    least = np.full(n * REGISTERS, ~_U(0))
    np.minimum.at(least, slot, allh >> _U(7))
    filled = least != ~_U(0)
    r = np.where(filled, least, _U(1))
    bits = np.frexp(r.astype(np.float64))[1].astype(np.int64)
    bits -= (r >> np.maximum(bits - 1, 0).astype(np.uint64)) == 0
    bits = np.maximum(bits, 1)
    mantissa = ((r << (_U(58) - bits.astype(np.uint64))) & _U((1 << 57) - 1)) >> _U(57 - MANTISSA)
    out = np.where(filled, (58 - bits).astype(np.uint64) << _U(MANTISSA) | mantissa, _U(0)).astype(np.uint16).reshape(n, REGISTERS)
    filled = filled.reshape(n, REGISTERS)
    row, col = np.nonzero(~filled)
    for k in range(REGISTERS):
        if not len(row):
            break
        source = _borrow[col, k]
        got = filled[row, source]
        out[row[got], col[got]] = out[row[got], source[got]]
        row, col = row[~got], col[~got]
    return out


def band_keys(regs: np.ndarray) -> np.ndarray:
    """One key for each row and band."""
    packed = np.ascontiguousarray(regs).view(np.uint64).reshape(len(regs), BANDS)
    return text.mix(packed ^ text.mix(np.arange(1, BANDS + 1, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))).view(np.int64)


def estimate(matches: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Jaccard estimate from equal registers, less those expected to be equal by chance."""
    big, small = np.maximum(n, m), np.maximum(np.minimum(n, m), 1)
    ratio = (1 + big / small) ** 2
    chance = 0.169919487159739 * 4 * (big / small) / ratio / (1 << MANTISSA)
    return (matches / REGISTERS - chance) / (1 - chance)


def linked(inter, n, m, percent: int):
    return 100 * inter >= percent * (n + m - inter)


def families(regs: np.ndarray, sizes: np.ndarray, ids: np.ndarray, side: np.ndarray, cross: bool, percent: int) -> list[tuple[int, int]]:
    """Star edges among members that may be linked, by the estimate."""
    t = percent / 100
    floor = t - MARGIN * np.sqrt(t * (1 - t) / REGISTERS)
    n = len(ids)
    adjacent = np.zeros((n, n), bool)
    for a in range(0, n, 32):
        same = (regs[a : a + 32, None, :] == regs[None, :, :]).sum(2)
        adjacent[a : a + 32] = estimate(same, sizes[a : a + 32, None], sizes[None, :]) >= floor
    np.fill_diagonal(adjacent, False)
    if cross:
        adjacent &= side[:, None] != side[None, :]
    return graph.stars(adjacent, ids)


def confirmed(sets: list[np.ndarray], ids: np.ndarray, side: np.ndarray, cross: bool, percent: int) -> list[tuple[int, int]]:
    """Star edges of the components under exact links (between sides only, if ``cross``)."""
    n = len(sets)
    sizes = np.array([len(x) for x in sets])
    if n == 2:
        inter = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        yes = linked(inter, sizes[0], sizes[1], percent) and (not cross or side[0] != side[1])
        return [(int(max(ids)), int(min(ids)))] if yes and ids[0] != ids[1] else []
    _, label = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    mark = np.zeros(int(label.max()) + 1, np.int32)
    pool = np.ones(n, bool)
    out = []
    while pool.any():
        first = int(np.flatnonzero(pool)[0])
        pool[first] = False
        members, at = [first], 0
        while at < len(members) and pool.any():
            r = members[at]
            at += 1
            open_ = pool & linked(np.minimum(sizes, sizes[r]), sizes, sizes[r], percent)
            if cross:
                open_ &= side != side[r]
            if not open_.any():
                continue
            own = label[starts[r] : starts[r + 1]]
            mark[own] = 1
            if open_.sum() * 4 > n:
                inter = np.add.reduceat(mark[label], starts[:-1])
                hit = open_ & linked(inter, sizes, sizes[r], percent)
                found = np.flatnonzero(hit)
            else:
                found = [i for i in np.flatnonzero(open_) if linked(int(mark[label[starts[i] : starts[i + 1]]].sum()), sizes[i], sizes[r], percent)]
            mark[own] = 0
            for i in found:
                pool[i] = False
                members.append(int(i))
        if len(members) > 1:
            got = ids[members]
            least = got.min()
            out += [(int(x), int(least)) for x in np.unique(got) if x != least]
    return out


EDGE = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def pair_columns(edges: list[tuple[int, int]]) -> pa.RecordBatch:
    return text.table(EDGE, [e[0] for e in edges], [e[1] for e in edges])


def sketches(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, n_shingles, d1, d2 (digest of the set), regs (null for an empty set)."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("regs", pa.binary())])

    def run(it):
        for part, data, off in text.slices(it):
            sets = shingle_sets(data, off, size)
            n = np.array([len(x) for x in sets])
            flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
            ends = np.concatenate([[0], np.cumsum(n)])
            d1, d2 = (text.span_hashes(flat, ends[:-1], ends[1:], lane).view(np.int64) for lane in (0, 1))
            some = np.flatnonzero(n)
            raw = iter(registers([sets[i] for i in some]))
            regs = [next(raw).tobytes() if k else None for k in n.tolist()]
            yield text.table(schema, part.column("doc_id"), n, d1, d2, regs)

    return store.documents(docs).mapInArrow(run, "doc_id long, n_shingles long, d1 long, d2 long, regs binary")


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row.

    Documents are linked if 100 * |A & B| >= percent * |A | B| for their shingle sets.
    """
    spark = store.small_batches(docs).sparkSession
    n = store.partitions(spark)
    facts, _ = store.save(sketches(docs, size))
    live = facts.where("n_shingles > 0 and doc_id is not null")
    # written, so that joins to them are plain ones, which Spark splits where a digest is hot
    classes, _ = store.save(live.groupBy("d1", "d2").agg(F.min("doc_id").alias("id")))
    ones = live.join(classes, ["d1", "d2"]).where("doc_id = id").select("id", "n_shingles", "regs").dropDuplicates(["id", "regs"])
    reps, reps_path = store.save(ones)

    def bands(it):
        schema = pa.schema([("band", pa.int64()), ("id", pa.int64())])
        for b in it:
            regs = np.frombuffer(b"".join(b.column("regs").to_pylist()), np.uint16).reshape(-1, REGISTERS)
            yield text.table(schema, band_keys(regs).ravel(), np.repeat(b.column("id").to_numpy(), BANDS))

    def estimated(it):
        for t, edges in graph.whole_groups(it, "unit"):
            ids, sizes, side = (t.column(c).to_numpy() for c in ("id", "n_shingles", "blk"))
            cross = t.column("lo").to_numpy() != t.column("hi").to_numpy()
            regs = np.frombuffer(b"".join(t.column("regs").to_pylist()), np.uint16).reshape(-1, REGISTERS)
            out = []
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                if b - a > 1:
                    out += families(regs[a:b], sizes[a:b], ids[a:b], side[a:b], bool(cross[a]), percent)
            yield pair_columns(list(set(out)))

    banded = reps.select("id", "regs").mapInArrow(bands, "band long, id long")
    units = graph.deal(banded, "band", "id", BLOCK).join(reps, "id").select("unit", "id", "blk", "lo", "hi", "n_shingles", "regs")
    maybe = units.repartition(n, "unit").sortWithinPartitions("unit").mapInArrow(estimated, "a long, b long")
    found, paths = graph.components(maybe)
    family = found.unionByName(found.select(F.col("component").alias("id"), "component").distinct())

    def sets_of(it):
        schema = pa.schema([("id", pa.int64()), ("digest", pa.int64()), ("shingles", pa.binary())])
        for part, data, off in text.slices(it):
            raw = [x.tobytes() for x in shingle_sets(data, off, size)]
            digest = [int.from_bytes(hashlib.blake2b(x, digest_size=8).digest(), "little", signed=True) for x in raw]
            yield text.table(schema, part.column("id"), digest, raw)

    def exact(it):
        for t, edges in graph.whole_groups(it, "unit"):
            ids, side = t.column("id").to_numpy(), t.column("blk").to_numpy()
            cross = t.column("lo").to_numpy() != t.column("hi").to_numpy()
            raw, out = t.column("shingles"), []
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                if b - a > 1:
                    sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in raw.slice(a, b - a)]
                    out += confirmed(sets, ids[a:b], side[a:b], bool(cross[a]), percent)
            yield pair_columns(list(set(out)))

    # blocks are dealt on ids alone; the sets follow in one shuffle
    whole = store.documents(docs).join(family.withColumnRenamed("id", "doc_id"), "doc_id").select(F.col("doc_id").alias("id"), "text").mapInArrow(sets_of, "id long, digest long, shingles binary")
    sized = family.select(F.col("component").alias("family"), "id").join(reps.select("id", "n_shingles"), "id")
    dealt = graph.deal(sized, "family", "id", BLOCK, "n_shingles", HEAVIEST).drop("n_shingles")
    units = whole.repartition(n, "id").dropDuplicates(["id", "digest"]).join(dealt, "id").select("unit", "id", "blk", "lo", "hi", "shingles")
    sure = units.repartition(n, "unit").sortWithinPartitions("unit").mapInArrow(exact, "a long, b long")
    linked_, more = graph.components(sure)
    store.drop(spark, reps_path, *paths)

    named = facts.join(classes, ["d1", "d2"], "left").select("doc_id", "n_shingles", F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("id")).otherwise(F.col("doc_id")).alias("id"))
    out = named.join(linked_, "id", "left").select("doc_id", "n_shingles", F.coalesce("component", "id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def representatives(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that near_duplicates keeps, with all their columns.

    Of rows with equal (doc_id, text) one stays. A row without a doc_id is judged under a
    number made from its text, far above real ids: it may be a copy of any row, but goes
    before none that has an id. Only the ids of rows that go, or that more rows share, are
    joined back. A doc_id whose rows hold different texts stays if any of them is kept.
    """
    made = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).bitwiseAND(F.lit((1 << 62) - 1)).bitwiseOR(F.lit(1 << 62))
    key = F.coalesce(F.col("doc_id").cast("long"), made)
    judged = near_duplicates(docs.select(key.alias("doc_id"), "text"), size, percent)
    by_id = judged.groupBy(F.col("doc_id").alias("_id")).agg(F.max("kept").alias("_any"), F.count("*").alias("_n")).where("not _any or _n > 1")
    marks, _ = store.save(by_id)
    keyed = docs.withColumn("_key", key)
    stays = keyed.join(marks.where("not _any"), F.col("_key") == F.col("_id"), "left_anti")
    shared = marks.where("_any").select("_id")
    alone = stays.join(shared, F.col("_key") == F.col("_id"), "left_anti")
    once = stays.join(shared, F.col("_key") == F.col("_id"), "left_semi").dropDuplicates(["_key", "text"])
    return alone.unionByName(once).select(*[F.col(f"`{c}`") for c in docs.columns])
