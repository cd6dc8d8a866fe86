"""Near-duplicate embeddings by randomised-rotation binary codes.

A unit vector x of D dimensions is rotated by a random orthogonal matrix; its code is the
signs of the result y, kept with the factor f = <sign(y)/sqrt(D), y>. For another rotated
vector q, <sign(y)/sqrt(D), q> / f estimates <x, q> without bias, and its error is within

    EPSILON * sqrt((1 - f^2) / f^2) / sqrt(D - 1)

but for a vanishing chance. q itself is kept in 8 bits, rounded at random. Pairs meet in
tables keyed by a few sign bits of further rotations; the bits per key grow with the
logarithm of the table's size, so that buckets stay small, and the number of tables is
that at which a pair at the threshold is missed with a chance of MISS. A pair whose upper
bound, from either side, is below the threshold is done with; the others form families,
within which exact cosines (double precision) are computed for the pairs that the bounds
leave. No pair below the threshold is linked.

Equal vectors are one class with a weight and are never compared. Buckets and families of
any size are cut into blocks, and no pair is written out, only counts and stars. Vectors
that are null, empty, zero or hold null or non-finite components link with nothing, and so
do vectors of different lengths. A row that repeats counts as a vector of its own. Rows
with a null vec_id have a null component and are kept. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import graph, store, text

EPSILON = 3.0
MISS = 1e-4
BLOCK = 256
_rotations: dict[tuple[int, int], np.ndarray] = {}


def rotation(dims: int, k: int) -> np.ndarray:
    """The k-th random orthogonal matrix, the same in every process."""
    if (dims, k) not in _rotations:
        q, r = np.linalg.qr(np.random.default_rng([20240521, dims, k]).standard_normal((dims, dims)))
        _rotations[dims, k] = q * np.sign(np.diag(r))
    return _rotations[dims, k]


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled first, so that no square overflows or vanishes."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


class Codes:
    """Binary codes of unit vectors and their factors and bounds."""

    def __init__(self, x: np.ndarray, salt: np.ndarray):
        y = x @ rotation(x.shape[1], 0).T
        self.dims = x.shape[1]
        self.sign = np.where(y >= 0, np.float32(1), np.float32(-1))
        self.factor = np.abs(y).sum(1) / math.sqrt(self.dims)
        self.scale = np.abs(y).max(1) / 127
        # the dither depends on the row's id alone: a task that is run again rounds alike
        seeds = text.mix(salt.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + np.arange(self.dims, dtype=np.uint64))
        self.query = np.floor(y / self.scale[:, None] + (seeds >> np.uint64(11)) / float(1 << 53)).clip(-128, 127).astype(np.int8)

    def packed(self) -> list[bytes]:
        return [a.tobytes() + b.tobytes() + c.tobytes() for a, b, c in zip(np.packbits(self.sign > 0, axis=1), self.query, np.stack([self.factor, self.scale], 1).astype(np.float32), strict=True)]

    @classmethod
    def unpacked(cls, rows: list[bytes], dims: int) -> Codes:
        self = cls.__new__(cls)
        bits = (dims + 7) // 8
        raw = np.frombuffer(b"".join(rows), np.uint8).reshape(len(rows), bits + dims + 8)
        self.dims = dims
        self.sign = np.unpackbits(raw[:, :bits], axis=1, count=dims).astype(np.float32) * 2 - 1
        self.query = np.ascontiguousarray(raw[:, bits : bits + dims]).view(np.int8)
        self.factor, self.scale = np.ascontiguousarray(raw[:, bits + dims :]).view(np.float32).astype(np.float64).T
        return self

    def maybe(self, threshold: float) -> np.ndarray:
        """Pairs that neither side's upper bound rules out."""
        error = EPSILON * np.sqrt((1 - self.factor**2).clip(0) / self.factor**2) / math.sqrt(max(self.dims - 1, 1))
        dots = self.sign @ (self.query * self.scale[:, None].astype(np.float32)).T
        upper = dots / (math.sqrt(self.dims) * self.factor[:, None]) + error[:, None]
        ok = upper >= threshold
        return ok & ok.T


def plan(n: int, threshold: float) -> tuple[int, int]:
    """Bits of a table's key and number of tables for n vectors."""
    bits = max(6, min(40, math.ceil(math.log2(max(n, 2))) - 6))
    agree = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(MISS) / math.log1p(-agree))


def table_keys(x: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """One key for each vector and table."""
    n, dims = x.shape
    need = -(-bits * tables // dims)
    signs = np.concatenate([x @ rotation(dims, 1 + k).T for k in range(need)], 1)[:, : bits * tables] >= 0
    value = (signs.reshape(n, tables, bits) * (np.uint64(1) << np.arange(bits, dtype=np.uint64))).sum(2, dtype=np.uint64)
    return text.mix(value ^ text.mix((np.arange(tables, dtype=np.uint64) << np.uint64(20)) + np.uint64(dims))).view(np.int64)


def rows_of(column: pa.Array, zero: bool = False) -> list[np.ndarray | None]:
    """Each usable vector of a list column, or None; zero vectors only where asked for."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten()
    values = flat.to_numpy(zero_copy_only=False).astype(np.float64)  # null components become nan
    size = np.diff(np.concatenate([[0], np.cumsum(np.nan_to_num(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)).astype(np.int64))]))
    ends = np.cumsum(size)
    out: list[np.ndarray | None] = []
    for a, b in zip((ends - size).tolist(), ends.tolist(), strict=True):
        x = values[a:b]
        out.append(x if b > a and np.isfinite(x).all() and (zero or x.any()) else None)
    return out


def exact(x: np.ndarray, weight: np.ndarray, flags: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Links (with weights) of each row, and the adjacency, for flagged pairs only."""
    hits = np.zeros(flags.shape, bool)
    rows = np.flatnonzero(flags.any(1))
    for k in range(0, len(rows), 256):
        r = rows[k : k + 256]
        c = np.flatnonzero(flags[r].any(0))
        hits[np.ix_(r, c)] = (x[r] @ x[c].T >= threshold) & flags[np.ix_(r, c)]
    return hits @ weight, hits


def near_duplicates(vectors: DataFrame, threshold: float = 0.9, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of (vec_id, embedding)."""
    spark = store.small_batches(vectors).sparkSession
    n_parts = store.partitions(spark)
    given = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))

    def read(it):
        schema = pa.schema([("vec_id", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("x", pa.binary())])
        for b in it:
            for at in range(0, b.num_rows, 2000):
                part = b.slice(at, 2000)
                # adding 0.0 makes -0.0 and 0.0 alike
                raw = [None if x is None else (x + 0.0).tobytes() for x in rows_of(part.column("embedding"))]
                keys = [(None, None) if x is None else np.frombuffer(hashlib.blake2b(x, digest_size=16).digest(), np.int64).tolist() for x in raw]
                yield text.table(schema, part.column("vec_id"), [k[0] for k in keys], [k[1] for k in keys], raw)

    rows = given.mapInArrow(read, "vec_id long, k1 long, k2 long, x binary")
    facts, _ = store.save(rows.drop("x"))
    live = facts.where("k1 is not null and vec_id is not null")
    # written, so that joins to them are plain ones, which Spark splits where a vector is hot
    classes, _ = store.save(live.groupBy("k1", "k2").agg(F.min("vec_id").alias("id"), F.count("*").alias("weight")))
    ones = rows.where("x is not null").join(classes, ["k1", "k2"]).where("vec_id = id").select("id", "weight", "x", "k1").dropDuplicates(["id", "k1"]).drop("k1")
    reps, reps_path = store.save(ones)
    bits, tables = plan(reps.count(), threshold)

    def groups(column) -> dict[int, list[int]]:
        by: dict[int, list[int]] = {}
        for i, x in enumerate(column):
            by.setdefault(len(x.as_buffer()) // 8, []).append(i)
        return by

    def matrix(column, rows_: list[int], dims: int) -> np.ndarray:
        return unit(np.frombuffer(b"".join(column[i].as_buffer() for i in rows_), np.float64).reshape(len(rows_), dims))

    def code(it):
        schema = pa.schema([("id", pa.int64()), ("dims", pa.int32()), ("code", pa.binary())])
        for b in it:
            ids = b.column("id").to_numpy()
            for dims, some in groups(b.column("x")).items():
                yield text.table(schema, ids[some], np.full(len(some), dims, np.int32), Codes(matrix(b.column("x"), some, dims), ids[some]).packed())

    def tabled(it):
        schema = pa.schema([("band", pa.int64()), ("id", pa.int64())])
        for b in it:
            ids = b.column("id").to_numpy()
            for dims, some in groups(b.column("x")).items():
                keys = table_keys(matrix(b.column("x"), some, dims), bits, tables)
                yield text.table(schema, keys.ravel(), np.repeat(ids[some], tables))

    def sides(t: pa.Table, a: int, b: int) -> np.ndarray | None:
        if t.column("lo")[a].as_py() == t.column("hi")[a].as_py():
            return None
        side = t.column("blk").to_numpy()[a:b]
        return side[:, None] != side[None, :]

    def bounded(it):
        for t, edges in graph.whole_groups(it, "unit"):
            ids, dims, codes, out = t.column("id").to_numpy(), t.column("dims").to_numpy(), t.column("code").to_pylist(), set()
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                if b - a < 2 or (dims[a:b] != dims[a]).any():
                    continue
                flags = Codes.unpacked(codes[a:b], int(dims[a])).maybe(threshold)
                np.fill_diagonal(flags, False)
                if (apart := sides(t, a, b)) is not None:
                    flags &= apart
                if flags.any():
                    out.update(graph.stars(flags, ids[a:b]))
            yield text.table(pa.schema([("a", pa.int64()), ("b", pa.int64())]), [x for x, _ in out], [x for _, x in out])

    def confirm(it):
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])
        for t, edges in graph.whole_groups(it, "unit"):
            ids, weight, xs, out = t.column("id").to_numpy(), t.column("weight").to_numpy(), t.column("x").combine_chunks(), []
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                for dims, some in groups(xs.slice(a, b - a)).items():
                    if len(some) < 2:
                        continue
                    x = matrix(xs.slice(a, b - a), some, dims)
                    flags = Codes(x, ids[a:b][some]).maybe(threshold)
                    np.fill_diagonal(flags, False)
                    if (apart := sides(t, a, b)) is not None:
                        flags &= apart[np.ix_(some, some)]
                    n, hits = exact(x, weight[a:b][some], flags, threshold)
                    least = dict(graph.stars(hits, ids[a:b][some]))
                    out += [(i, least.get(i, i), k) for i, k in zip(ids[a:b][some].tolist(), n.tolist(), strict=True) if k]
            yield text.table(schema, *map(list, zip(*out, strict=True))) if out else text.table(schema, [], [], [])

    codes, codes_path = store.save(reps.mapInArrow(code, "id long, dims int, code binary"))
    banded = reps.mapInArrow(tabled, "band long, id long")
    units = graph.deal(banded, "band", "id", block).join(codes, "id").select("unit", "id", "blk", "lo", "hi", "dims", "code")
    maybe = units.repartition(n_parts, "unit").sortWithinPartitions("unit").mapInArrow(bounded, "a long, b long")
    found, paths = graph.components(maybe)
    family = found.select("id", F.col("component").alias("family")).unionByName(found.select(F.col("component").alias("id"), F.col("component").alias("family")).distinct())
    units = graph.deal(family, "family", "id", block).join(reps, "id").select("unit", "id", "blk", "lo", "hi", "weight", "x")
    sure, sure_path = store.save(units.repartition(n_parts, "unit").sortWithinPartitions("unit").mapInArrow(confirm, "a long, b long, n long"))
    linked, _ = graph.components(sure.select("a", "b"))
    counts, _ = store.save(sure.groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("n")))
    store.drop(spark, reps_path, codes_path, sure_path, *paths)

    named = facts.join(classes, ["k1", "k2"], "left").select("vec_id", F.coalesce("id", "vec_id").alias("id"), F.when(F.col("vec_id").isNotNull(), F.coalesce("weight", F.lit(1))).otherwise(1).alias("weight"))
    named = named.withColumn("id", F.when(F.col("vec_id").isNotNull(), F.col("id")))
    out = named.join(counts, "id", "left").join(linked, "id", "left")
    out = out.select("vec_id", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
