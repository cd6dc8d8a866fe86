"""Hard negatives by a vector-approximation file: cells, score bounds, exact scores.

Each component x becomes the integer floor(256 * x), and a score is an integer inner
product. Every dimension is cut into ``CELLS`` cells of equal width between its least and
greatest value in the table; a row's approximation is its cell in every dimension. For an
anchor a table holds the least product of each dimension and cell, so that the sum of the
looked-up entries is a lower bound of the score; cells of a dimension are of one width, so
the upper bound lies above it by a number that belongs to the anchor alone. A row is scored
exactly only if these bounds let it into what is asked for: the first ``k`` rows of the
anchor's label (positives), and for each of them the first ``k`` rows of other labels with
a score of ``low`` to 100 percent of the positive's.

Anchors are a stated query set, rows whose vec_id is divisible by ``every``. They are taken
in blocks of ``BLOCK`` at most, each sent to all tasks; a task keeps the best k of each
window while its rows pass, and only those meet in a shuffle. So the work is anchors times
rows, no rows of a label are gathered, and a label or vector that a third of the rows share
changes nothing in how rows are dealt.

Rows without vec_id, label or vector, with an empty vector, or with a null or non-finite
component take no part, nor do vectors whose scores could leave 62 bits (a squared length
of over 2^62). Vectors of different lengths have no score. Equal scores go by smaller
vec_id. Rows equal in vec_id, label and vector are one row, and rows of one vec_id and score
take one place in a list; rows with the anchor's vec_id are not its positives. Extra
columns are ignored; without anchors or rows the result is empty.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import store, text, vectors

SCALE, CELLS, BLOCK = 256, 64, 1 << 15
#: Rows and anchors whose bounds are looked up together.
ROWS, ANCHORS = 2048, 256
_NONE = np.iinfo(np.int64).min


def relabelled() -> Column:
    """The label, moved by one where vec_id is divisible by 7."""
    return F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))


def integers(rows: DataFrame) -> DataFrame:
    """vec_id, label, dims, x (64-bit integers, packed) of the rows that take part."""
    schema = pa.schema([("vec_id", pa.int64()), ("label", pa.int64()), ("dims", pa.int32()), ("x", pa.binary())])

    def run(it):
        for b in it:
            for at in range(0, b.num_rows, 2000):
                part = b.slice(at, 2000)
                out: list[tuple[int, bytes] | None] = []
                for x in floors(part.column("embedding")):
                    out.append(None if x is None else (len(x), x.tobytes()))
                some = [i for i, x in enumerate(out) if x is not None]
                yield text.table(schema, part.column("vec_id").take(pa.array(some, pa.int64())), part.column("label").take(pa.array(some, pa.int64())), [out[i][0] for i in some], [out[i][1] for i in some])

    given = store.small_batches(rows).where("vec_id is not null and label is not null and size(embedding) > 0")
    given = given.select(F.col("vec_id").cast("long").alias("vec_id"), relabelled().cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    return given.mapInArrow(run, "vec_id long, label long, dims int, x binary")


def floors(column: pa.Array) -> list[np.ndarray | None]:
    """floor(256 x) of each vector whose components are all there and whose scores fit."""
    out = []
    for x in vectors.rows_of(column, zero=True):
        y = None if x is None else np.floor(SCALE * x)
        out.append(None if y is None or not float(y @ y) < 2.0**62 else y.astype(np.int64))
    return out


class Cells:
    """Cells of one number of dimensions: least value and width in each."""

    def __init__(self, least: np.ndarray, most: np.ndarray):
        self.least = least
        self.width = np.maximum(1, -(-(most - least + 1) // CELLS))

    def codes(self, x: np.ndarray) -> np.ndarray:
        """Cell of each row (second axis) in each dimension."""
        return np.ascontiguousarray(((x - self.least) // self.width).astype(np.uint8).T)

    def tables(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(anchor, dimension, cell) least product, and how far the greatest score is above the least."""
        low = self.least + np.arange(CELLS)[:, None] * self.width
        products = q[:, None, :] * np.where(q[:, None, :] >= 0, low[None], (low + self.width - 1)[None])
        return np.ascontiguousarray(products.transpose(0, 2, 1)), (np.abs(q) * (self.width - 1)).sum(1)


def bounds(table: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Lower bounds of one anchor's scores with all rows of ``codes``."""
    out = table[0].take(codes[0])
    for d in range(1, len(codes)):
        out += table[d].take(codes[d])
    return out


def scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact products; floating point is exact where nothing leaves 53 bits."""
    if len(q) and len(x) and float(np.abs(q).max()) * float(np.abs(x).max()) * q.shape[-1] < 2.0**53:
        return (x.astype(np.float64) @ q.astype(np.float64)).astype(np.int64)
    return x @ q


class Best:
    """The k best (score, vec_id) of one window, and the least score that may still enter."""

    __slots__ = ("held", "k", "least", "low", "most")

    def __init__(self, k: int, low: int = _NONE, most: int = 1 << 62):
        self.k, self.low, self.most, self.least = k, low, most, low
        self.held: list[tuple[int, int]] = []

    def add(self, score: np.ndarray, ids: np.ndarray) -> None:
        on = (score >= self.least) & (score <= self.most)
        if on.any():
            score, ids = score[on], ids[on]
            if len(score) > 64 * self.k:
                # rows of less than the k-th distinct score cannot stay
                distinct = np.unique(score)
                on = score >= distinct[-min(self.k, len(distinct))]
                score, ids = score[on], ids[on]
                if len(score) > 64 * self.k:
                    at = np.lexsort((ids, -score))
                    score, ids = score[at], ids[at]
                    on = np.append(True, (score[1:] != score[:-1]) | (ids[1:] != ids[:-1]))
                    score, ids = score[on][: self.k], ids[on][: self.k]
            self.held = sorted({*self.held, *zip((-score).tolist(), ids.tolist(), strict=True)})[: self.k]
            if len(self.held) == self.k:
                self.least = max(self.low, -self.held[-1][0])


class Searcher:
    """Anchors of a block, their windows, and what the rows seen so far put into them."""

    def __init__(self, anchors: list[tuple[int, int, bytes]], windows: list[list[tuple[int, int]]] | None, cells: dict[int, Cells], k: int):
        self.ids, self.labels = [a for a, _, _ in anchors], [b for _, b, _ in anchors]
        self.q = [np.frombuffer(x, np.int64) for _, _, x in anchors]
        self.cells, self.k, self.same = cells, k, windows is None
        self.best = [[Best(k)] if windows is None else [Best(k, low, most) for low, most in windows[i]] for i in range(len(anchors))]
        self.by: dict[int, list[int]] = {}
        for i, x in enumerate(self.q):
            self.by.setdefault(len(x), []).append(i)

    def see(self, ids: np.ndarray, labels: np.ndarray, dims: int, x: np.ndarray) -> None:
        codes = self.cells[dims].codes(x)
        of_label = {y: np.flatnonzero(labels == y) for y in np.unique(labels).tolist()}
        mine = self.by.get(dims, [])
        for at in range(0, len(mine), ANCHORS):
            some = mine[at : at + ANCHORS]
            tables, above = self.cells[dims].tables(np.stack([self.q[i] for i in some]))
            by_label = {y: np.ascontiguousarray(codes[:, rows]) for y, rows in of_label.items()} if self.same else {}
            for j, i in enumerate(some):
                if self.same:
                    rows = of_label.get(self.labels[i])
                    if rows is None:
                        continue
                    lower = bounds(tables[j], by_label[self.labels[i]])
                else:
                    rows, lower = None, bounds(tables[j], codes)
                self.enter(i, ids, labels, x, rows, lower, int(above[j]))

    def enter(self, i: int, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, rows: np.ndarray | None, lower: np.ndarray, above: int) -> None:
        """Exact scores of the rows whose bounds let them into a window of anchor i."""
        best = self.best[i]
        if not best:
            return
        if self.same:
            # k rows are sure to reach the k-th greatest lower bound (k + 1 where the anchor may be one of them)
            reach = best[0].least
            if len(lower) > self.k + 1 and not (ids[rows] == self.ids[i]).sum() > 1 and len(np.unique(ids[rows])) == len(rows):
                reach = max(reach, int(np.partition(lower, -self.k - 1)[-self.k - 1]))
            on = rows[lower + above >= reach]
            on = on[ids[on] != self.ids[i]]
        else:
            on = np.flatnonzero((lower + above >= min(b.least for b in best)) & (lower <= max(b.most for b in best)))
            on = on[labels[on] != self.labels[i]]
        if len(on):
            score = scores(self.q[i], x[on])
            for b in best:
                b.add(score, ids[on])


def search(rows: DataFrame, anchors: list[tuple[int, int, bytes]], windows: list[list[tuple[int, int]]] | None, cells: dict[int, Cells], k: int) -> DataFrame:
    """anchor and window (places in the lists), score, vec_id: the best k of all rows."""
    sent = rows.sparkSession.sparkContext.broadcast((anchors, windows, cells, k))  # BLOCK anchors at most
    schema = pa.schema([("anchor", pa.int32()), ("win", pa.int32()), ("score", pa.int64()), ("vec_id", pa.int64())])

    def run(it):
        s = Searcher(*sent.value)
        for b in it:
            for at in range(0, b.num_rows, ROWS):
                part = b.slice(at, ROWS)
                ids, labels, dims, xs = part.column("vec_id").to_numpy(), part.column("label").to_numpy(), part.column("dims").to_numpy(), part.column("x").to_pylist()
                for n in np.unique(dims).tolist():
                    some = np.flatnonzero(dims == n)
                    x = np.frombuffer(b"".join([xs[i] for i in some.tolist()]), np.int64).reshape(len(some), n)
                    s.see(ids[some], labels[some], n, x)
        out = [(i, w, -score, vec_id) for i, best in enumerate(s.best) for w, b in enumerate(best) for score, vec_id in b.held]
        for at in range(0, len(out), 1 << 16):
            yield text.table(schema, *map(list, zip(*out[at : at + (1 << 16)], strict=True)))

    found = rows.mapInArrow(run, "anchor int, win int, score long, vec_id long").distinct()
    order = Window.partitionBy("anchor", "win").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def cells_of(rows: DataFrame) -> dict[int, Cells]:
    """Least and greatest value of each dimension, from each task's."""
    schema = pa.schema([("dims", pa.int32()), ("least", pa.list_(pa.int64())), ("most", pa.list_(pa.int64()))])

    def run(it):
        edges: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for b in it:
            dims, xs = b.column("dims").to_numpy(), b.column("x").to_pylist()
            for n in np.unique(dims).tolist():
                x = np.frombuffer(b"".join([xs[i] for i in np.flatnonzero(dims == n).tolist()]), np.int64).reshape(-1, n)
                least, most = edges.get(n, (x[0], x[0]))
                edges[n] = np.minimum(least, x.min(0)), np.maximum(most, x.max(0))
        yield text.table(schema, list(edges), [a.tolist() for a, _ in edges.values()], [b.tolist() for _, b in edges.values()])

    each = rows.mapInArrow(run, "dims int, least array<long>, most array<long>")
    edges = each.select("dims", F.posexplode(F.arrays_zip("least", "most")).alias("d", "x")).groupBy("dims", "d").agg(F.min("x.least").alias("least"), F.max("x.most").alias("most"))
    out: dict[int, list] = {}
    for r in edges.orderBy("dims", "d").collect():  # a row for each dimension
        out.setdefault(r.dims, []).append((r.least, r.most))
    return {n: Cells(*np.array(x, np.int64).T) for n, x in out.items()}


def mine(given: DataFrame, every: int = 100, k: int = 5, low: int = 80, block: int = BLOCK) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    spark = given.sparkSession
    rows, _ = store.save(integers(given))
    cells = cells_of(rows)
    anchors, anchors_path = store.save(rows.where(F.col("vec_id") % every == 0).distinct())
    blocks = -(-anchors.count() * 5 // (4 * block))  # dealt by a hash, so with a fifth of room
    columns = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    out = spark.createDataFrame([], columns)
    for n in range(blocks):
        own = sorted((r.vec_id, r.label, bytes(r.x)) for r in anchors.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == n).collect())
        for at in range(0, len(own), block):
            some = own[at : at + block]
            found = sorted((r.anchor, r["rank"], r.score, r.vec_id) for r in search(rows, some, None, cells, k).collect())  # k rows an anchor
            positives: list[list[tuple[int, int]]] = [[] for _ in some]
            for i, _, score, vec_id in found:
                positives[i].append((score, vec_id))
            # 100 * negative >= low * positive in integers
            windows = [[(-(-low * p // 100), p) for p, _ in x] for x in positives]
            negatives, _ = store.save(search(rows, some, windows, cells, k))
            named = [(i, w, some[i][0], p, score) for i, x in enumerate(positives) for w, (score, p) in enumerate(x)]
            if named:
                of = F.broadcast(spark.createDataFrame(named, "anchor int, win int, anchor_id long, positive_id long, positive_score long"))  # k rows an anchor of the block
                part = negatives.join(of, ["anchor", "win"]).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
                out = out.unionByName(part)
    store.drop(spark, anchors_path)
    return out


ORACLE = """WITH e AS (SELECT vec_id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS x FROM embeddings
WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
r AS (SELECT DISTINCT * FROM e),
s AS (SELECT a.vec_id AS anchor_id, a.label AS al, r.vec_id, r.label, CAST(list_inner_product(a.x, r.x) AS BIGINT) AS score FROM r a JOIN r ON a.vec_id % 100 = 0 AND len(a.x) = len(r.x)),
p AS (SELECT * FROM (SELECT DISTINCT anchor_id, al, vec_id AS positive_id, score AS positive_score FROM s WHERE label = al AND vec_id <> anchor_id) QUALIFY row_number() OVER (PARTITION BY anchor_id, al ORDER BY positive_score DESC, positive_id) <= 5),
n AS (SELECT DISTINCT p.anchor_id, p.al, positive_id, positive_score, s.vec_id AS negative_id, s.score AS negative_score FROM p JOIN s ON s.anchor_id = p.anchor_id AND s.al = p.al AND s.label <> p.al AND 80 * positive_score <= 100 * s.score AND s.score <= positive_score)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n
WINDOW w AS (PARTITION BY anchor_id, al, positive_id, positive_score ORDER BY negative_score DESC, negative_id) QUALIFY row_number() OVER w <= 5"""
