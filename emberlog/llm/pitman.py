"""Language-model scores by a hierarchical Pitman-Yor model.

Tokens are lower-cased (A-Z) words and one end per document. A context is the word before,
or the start of the document. Every word that comes before another has a restaurant, so
their number grows with the corpus; all restaurants share one parent, that of no context,
whose own parent is uniform over the V known words and one unknown one. The chance of word
w after word u is

    P(w | u) = (c_uw - d t_uw) / (theta + c_u) + (theta + d t_u) / (theta + c_u) P(w)

with c customers and t tables, and so on at the root, whose customers are the restaurants'
tables. Seating is sampled by Gibbs. A sweep draws the number of tables of each dish in each
restaurant given all others: its own customers are taken out of the root, and

    p(t) ~ S_d(c, t) prod_{j<t} (theta + d (T + j)) P_j(w)

where S are generalised Stirling numbers and P_j is the root's chance with j customers back.
Dishes with one customer have one table and are never drawn. Then the root's tables are drawn
in the same way. Totals of other dishes are those of the sweep before, as is usual where
Gibbs runs on many machines. Up to ``EXACT`` customers of a dish the numbers S come from their
recursion, beyond that from a saddle point. Scores use (c - d t), (theta + d t_u) and P(w), each
averaged over the sampled sweeps, so that P(. | u) sums to one.
A draw's random numbers come from the sweep and the dish's own keys, so that a table has one
score however its rows are dealt to partitions and tasks.

Words have codes: the ``FREQUENT`` most frequent ones, which are broadcast, an index, all
others a negative hash. Words are counted by blocks, by their hashes; pairs of words are counted and looked
up by blocks, a hash of both words. A row holds a block's words or pairs as arrays. Dishes of frequent words stay in such rows,
meet the totals of their restaurants by broadcast and are summed by word within a task; those of
rare words, none of which can be hot, are single rows and meet them in joins. What blocks know of
documents is summed by document within a task and goes on as arrays too. In scoring, the most frequent pairs are broadcast too and the others of a document meet the
model in one shuffle; what comes back is summed by document.

Null text is the empty text, whose only token is the end. Long texts are read whole, in
slices. Rows are scored one by one, also
those of equal doc_id; ties do not matter, as nothing is ranked but frequencies, by which
equal ones fall on the same side. A null doc_id counts as the text '' in the split. With no training
rows at all every score comes from the uniform parent. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import graph, store, text

#: Bounds of what is broadcast: words and pairs of words.
FREQUENT, PAIRS = 1 << 19, 1 << 19
EXACT = 256
#: Bits of a hash by which it is looked up.
DRAWERS = 19
BURN_IN, SAMPLES = 2, 3
STRENGTH = 1.0
#: Distinct words or pairs, and places to be looked up, that a task holds before it passes them
#: on, and bytes of text and rows handled at once.
HELD, ASKED = 1 << 19, 1 << 19
SLICE_BYTES, PER_BATCH = 1 << 19, 1 << 15
#: Tokens of a block of pairs, about, and pairs of a stored row.
PER_BLOCK, PER_ROW = 1 << 19, 1 << 17
#: Blocks of words of a partition.
SHARES = 4
#: Codes whose sums are a row, and the power of two of documents that are summed together at most.
PER_SUM, GROUP = 1 << 14, 8
#: Hashes that stand for the end of a document and for its start.
END, START = np.uint64(0x2545F4914F6CDD1D), np.uint64(0x1B873593CC9E2D51)
_RARE = -(1 << 63)


def token_hashes(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of a slice with an end after each document, and the documents' offsets."""
    w = text.words(data, off)
    h = text.word_hashes(data, w)
    docs = len(off) - 1
    first = w.first + np.arange(docs + 1)
    out = np.full(len(h) + docs, END)
    at = np.arange(len(h)) + w.doc
    out[at] = h
    return out, first


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, where each stands first, and their summed counts."""
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    at = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
    return k[at], order[at], np.add.reduceat(counts[order], at, dtype=counts.dtype) if len(at) else np.zeros(0, counts.dtype)


@dataclass(frozen=True)
class Frequent:
    """The most frequent words (sorted hashes, start and end always) and their numbers."""

    hashes: np.ndarray
    count: np.ndarray  # tokens of training
    guests: np.ndarray  # customers as a context
    start: int  # code of the start
    drawers: np.ndarray  # where the hashes with each value of their first bits begin

    @classmethod
    def of(cls, hashes: np.ndarray, count: np.ndarray, guests: np.ndarray) -> Frequent:
        order = np.argsort(hashes)
        hashes, first = hashes[order], np.arange((1 << DRAWERS) + 1, dtype=np.uint64)
        drawers = np.append(np.searchsorted(hashes, first[:-1] << np.uint64(64 - DRAWERS)), len(hashes)).astype(np.int32)
        return cls(hashes, count[order], guests[order], int(np.searchsorted(hashes, START)), drawers)

    def codes(self, h: np.ndarray) -> np.ndarray:
        drawer = (h >> np.uint64(64 - DRAWERS)).astype(np.int64)
        at, end = self.drawers[drawer], self.drawers[drawer + 1]
        out = (h | np.uint64(1 << 63)).view(np.int64)
        live = np.flatnonzero(at < end)
        while len(live):
            hit = self.hashes[at[live]] == h[live]
            out[live[hit]] = at[live[hit]]
            live = live[~hit]
            at[live] += 1
            live = live[at[live] < end[live]]
        return out

    def before(self, codes: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The context of each token."""
        u = np.empty_like(codes)
        u[1:] = codes[:-1]
        u[first[:-1]] = self.start  # every document has a token, its end
        return u


def pair_keys(u: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Both codes of frequent words, or a negative hash if one is rare."""
    mixed = text.mix(u.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ text.mix(w.view(np.uint64)))
    return np.where((u >= 0) & (w >= 0), (u << 32) | w, (mixed | np.uint64(1 << 63)).view(np.int64))


def block_of(keys: np.ndarray, blocks: int) -> np.ndarray:
    high = text.mix(keys.view(np.uint64) ^ np.uint64(0x8E9D5A3C6B1F2704)) >> np.uint64(32)
    return (high * np.uint64(blocks) >> np.uint64(32)).astype(np.int64)


def packed(x: np.ndarray, rising: bool = False) -> bytes:
    """An array in few bytes: integers less their least one (or, rising, as steps) in as many bytes
    as they need, first bytes together, then second ones and so on, compressed."""
    base = 0
    if x.dtype.kind == "i" and len(x):
        base = int(x[0]) if rising else int(x.min())
        wide = x.astype(np.int64).view(np.uint64)
        x = np.diff(wide, prepend=wide[:1]) if rising else wide - np.uint64(base % (1 << 64))
        x = x.astype(np.min_scalar_type(int(x.max())))
    planes = np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.dtype.itemsize).T)
    head = (len(x), base % (1 << 64), x.dtype.itemsize)
    return np.array(head, np.uint64).tobytes() + pa.compress(planes.ravel(), codec="zstd", asbytes=True)


def unpacked(x: pa.BinaryScalar, kind, rising: bool = False) -> np.ndarray:
    raw = x.as_buffer()
    n, base, width = np.frombuffer(raw, np.uint64, 3).tolist()
    planes = np.frombuffer(pa.decompress(raw.slice(24), n * width, codec="zstd"), np.uint8).reshape(width, n)
    x = np.ascontiguousarray(planes.T)
    if np.dtype(kind).kind != "i":
        return x.view(kind).ravel()
    x = x.view(f"u{width}").ravel().astype(np.uint64)
    return ((np.cumsum(x) if rising else x) + np.uint64(base)).view(np.int64).astype(kind, copy=False)


def by_block(keys: np.ndarray, blocks: int, *columns: np.ndarray, rising: int = 0) -> Iterator[tuple]:
    """(block, each column packed), rows of a block as they come; the first ``rising`` columns rise."""
    block = block_of(keys, blocks)
    order = np.argsort(block, kind="stable")
    block = block[order]
    edges = np.concatenate([np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]])), [len(block)]]) if len(block) else np.zeros(1, np.int64)
    columns = [c[order] for c in columns]
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        yield (int(block[a]), *(packed(c[a:b], i < rising) for i, c in enumerate(columns)))


def some_rows(schema: pa.Schema, *columns) -> Iterator[pa.RecordBatch]:
    """The columns as batches of a bounded number of rows."""
    for a in range(0, len(columns[0]), PER_BATCH):
        yield text.table(schema, *(c[a : a + PER_BATCH] for c in columns))


def some_blocks(schema: pa.Schema, rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    while some := list(islice(rows, 8)):
        yield text.table(schema, *map(list, zip(*some, strict=True)))


def word_counts(train: DataFrame) -> DataFrame:
    """w (hash), c: summed within each task, then by blocks of words, whose rows are arrays."""
    schema = pa.schema([("block", pa.int64()), ("w", pa.binary()), ("c", pa.binary())])
    parts = store.partitions(train.sparkSession)
    blocks = SHARES * parts

    def fold(sets):
        keys, _, counts = summed(*(np.concatenate(x) for x in zip(*sets, strict=True)))
        return keys, counts

    def run(it):
        none = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        all_, held, size = none, [], 0

        def out():
            # as signed numbers in their order, so that each block's rise
            keys = all_[0].view(np.int64)
            order = np.argsort(keys)
            return some_blocks(schema, by_block(keys[order], blocks, keys[order], all_[1][order], rising=1))

        for _, data, off in text.slices(it, SLICE_BYTES):
            h = token_hashes(data, off)[0]
            held.append(fold([(h, np.ones(len(h), np.int64))]))
            size += len(held[-1][0])
            if size > HELD:
                all_ = fold([all_, *held])
                held, size = [], 0
                if len(all_[0]) > HELD:
                    yield from out()
                    all_ = none
        all_ = fold([all_, *held])
        held = []
        yield from out()

    def merge(it):
        schema = pa.schema([("w", pa.int64()), ("c", pa.int64())])
        for t, edges in graph.whole_groups(it, "block"):
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                w = np.concatenate([unpacked(x, np.int64, True) for x in t.column("w").slice(a, b - a)])
                c = np.concatenate([unpacked(x, np.int64) for x in t.column("c").slice(a, b - a)])
                yield from some_rows(schema, *fold([(w, c)]))

    kind = "block long, w binary, c binary"
    rows = train.select("text").mapInArrow(store.lean(run), kind).repartition(parts, "block").sortWithinPartitions("block")
    return rows.mapInArrow(store.lean(merge), "w long, c long")


def pair_counts(train: DataFrame, words, blocks: int) -> DataFrame:
    """Rows (block, u, w, c): arrays of each block's distinct pairs and their counts."""
    schema = pa.schema([("block", pa.int64()), ("u", pa.binary()), ("w", pa.binary()), ("c", pa.binary())])

    def fold(sets):
        u, w, n = (np.concatenate(x) for x in zip(*sets, strict=True))
        _, at, n = summed(pair_keys(u, w), n)
        return u[at], w[at], n

    def run(it):
        known = words.value
        none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        all_, held, size = none, [], 0

        def out():
            return some_blocks(schema, by_block(pair_keys(all_[0], all_[1]), blocks, *all_))

        for _, data, off in text.slices(it, SLICE_BYTES):
            h, first = token_hashes(data, off)
            if not len(h):
                continue
            code = known.codes(h)
            held.append(fold([(known.before(code, first), code, np.ones(len(code), np.int32))]))
            size += len(held[-1][0])
            if size > HELD // 2:
                all_ = fold([all_, *held])
                held, size = [], 0
                if len(all_[0]) > HELD:
                    yield from out()
                    all_ = none
        all_ = fold([all_, *held])
        held = []
        yield from out()

    def merge(it):
        for t, edges in graph.whole_groups(it, "block"):
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                u, w, c = (np.concatenate([unpacked(x, kind) for x in t.column(name).slice(a, b - a)]) for name, kind in (("u", np.int64), ("w", np.int64), ("c", np.int32)))
                u, w, c = fold([(u, w, c.astype(np.int64))])
                for x in range(0, len(u), PER_ROW):
                    s = slice(x, x + PER_ROW)
                    yield text.table(schema, [t.column("block")[a].as_py()], [packed(u[s])], [packed(w[s])], [packed(c[s])])

    kind = "block long, u binary, w binary, c binary"
    parts = store.partitions(train.sparkSession)
    return train.select("text").mapInArrow(store.lean(run), kind).repartition(parts, "block").sortWithinPartitions("block").mapInArrow(store.lean(merge), kind)


def word_pairs(pairs: DataFrame) -> DataFrame:
    """code, after, before: how many pairs a word begins and ends; ones, twos: in sum, pairs seen once and twice."""
    names = ("code", "after", "before", "ones", "twos")
    schema = pa.schema([("block", pa.int64()), *((x, pa.binary()) for x in names[:3]), *((x, pa.int64()) for x in names[3:])])
    parts = store.partitions(pairs.sparkSession)
    blocks = SHARES * parts

    def fold(codes, after, before):
        codes, at = np.unique(np.concatenate(codes), return_inverse=True)
        return codes, *(np.bincount(at, np.concatenate(x), len(codes)).astype(np.int64) for x in (after, before))

    def run(it):
        none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        all_, ones, twos = none, 0, 0

        def out():
            some = by_block(all_[0], blocks, *all_, rising=1)
            return some_blocks(schema, ((*x, *(n * (i == 0) for n in (ones, twos))) for i, x in enumerate(some)))

        for b in it:
            for u, w, c in arrays(b, "u", "w", "c"):
                us, n = np.unique(u, return_counts=True)
                ws, m = np.unique(w, return_counts=True)
                all_ = fold(*zip(all_, (us, n, 0 * n), (ws, 0 * m, m), strict=True))
                ones, twos = ones + int((c == 1).sum()), twos + int((c == 2).sum())
                if len(all_[0]) > HELD:
                    yield from out()
                    all_, ones, twos = none, 0, 0
        yield from out()

    def merge(it):
        schema = pa.schema([(x, pa.int64()) for x in names])
        for t, edges in graph.whole_groups(it, "block"):
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                rows = t.slice(a, b - a)
                sums = fold(*([unpacked(x, np.int64, i == 0) for x in rows.column(name)] for i, name in enumerate(names[:3])))
                extra = np.zeros((2, len(sums[0])), np.int64)
                extra[:, 0] = [rows.column(x).to_numpy().sum() for x in names[3:]]
                yield from some_rows(schema, *sums, *extra)

    kind = "block long, code binary, after binary, before binary, ones long, twos long"
    rows = pairs.mapInArrow(store.lean(run), kind).repartition(parts, "block").sortWithinPartitions("block")
    return rows.mapInArrow(store.lean(merge), ", ".join(f"{x} long" for x in names))


def arrays(b: pa.RecordBatch, *names: str) -> Iterable[tuple[np.ndarray, ...]]:
    """The int64 arrays of each row."""
    for row in zip(*(b.column(x) for x in names), strict=True):
        yield tuple(unpacked(x, np.int64) for x in row)


# seating -----------------------------------------------------------------------------------


def log_stirling(d: float, n: int) -> np.ndarray:
    """log of the generalised Stirling numbers S_d(c, t) for c, t up to n."""
    out = np.full((n + 1, n + 1), -np.inf)
    out[0, 0] = 0.0
    for c in range(1, n + 1):
        t = np.arange(1, c + 1)
        stay = np.where(c - 1 > d * t, np.log(np.maximum(c - 1 - d * t, 1e-300)), -np.inf) + out[c - 1, 1 : c + 1]
        out[c, 1 : c + 1] = np.logaddexp(out[c - 1, :c], stay)
    return out


@dataclass(frozen=True)
class Root:
    """Totals of the root restaurant, the size of the vocabulary and all parameters."""

    customers: float
    tables: float
    vocabulary: int
    discount: float
    root_discount: float
    strength: float = STRENGTH

    def chance(self, c, t):
        s = self.strength
        return (c - self.root_discount * t + (s + self.root_discount * self.tables) / (self.vocabulary + 1)) / (s + self.customers)


def mixed(x: np.ndarray) -> np.ndarray:
    """Numbers of 64 bits, each bit of which depends on all of x's (the finaliser of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Draws:
    """Random numbers that depend on a seed and a row's own keys, however rows are dealt to tasks."""

    STEP = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, seed: Iterable[int], *keys: np.ndarray):
        self.keys = np.zeros(len(keys[0]), np.uint64)
        for x in [*(np.array([n], np.uint64) for n in seed), *(k.astype(np.int64).view(np.uint64) for k in keys)]:
            self.keys = mixed(self.keys + self.STEP + x)

    def of(self, rows: np.ndarray) -> Draws:
        out = object.__new__(Draws)
        out.keys = self.keys[rows]
        return out

    def _open(self, first: int, n: int) -> np.ndarray:
        """n numbers a row between 0 and 1, without either."""
        x = mixed(self.keys[:, None] + self.STEP * np.arange(first + 1, first + n + 1, dtype=np.uint64))
        return ((x >> np.uint64(12)) + 0.5) * 2.0**-52

    def gumbel(self, size: tuple[int, int]) -> np.ndarray:
        return -np.log(-np.log(self._open(1, size[1])))

    def random(self, n: int) -> np.ndarray:
        return self._open(0, 1)[:, 0]


def draw(customers: np.ndarray, new, d: float, rng: np.random.Generator | Draws, stirling: np.ndarray) -> np.ndarray:
    """Tables of each dish; new(rows, j) is the weight of a new table when j are there."""
    own = rng.of if isinstance(rng, Draws) else lambda rows: rng
    tables = np.minimum(customers, 1)
    small = np.flatnonzero((customers > 1) & (customers <= EXACT))
    small = small[np.argsort(customers[small], kind="stable")]
    sizes, at = np.unique(customers[small], return_index=True)
    edges = [*at.tolist(), len(small)]
    for c, a, b in zip(sizes.tolist(), edges, edges[1:], strict=False):
        room = max(1, (1 << 18) // c)
        for x in range(a, b, room):
            some = small[x : min(x + room, b)]
            weight = np.log(new(some[:, None], np.arange(c)[None, :])).cumsum(1) + stirling[c, 1 : c + 1]
            tables[some] = (weight + own(some).gumbel(size=weight.shape)).argmax(1) + 1
    big = np.flatnonzero(customers > EXACT)
    for x in range(0, len(big), 4096):
        some = big[x : x + 4096]
        tables[some] = draw_many(customers[some].astype(np.float64), lambda i, j, some=some: new(some[i], j), d, own(some), stirling)
    return tables


def log_factorial(n: np.ndarray) -> np.ndarray:
    """For real n >= 0, by Stirling's series."""
    m = n + 8
    out = (m + 0.5) * np.log(m) - m + 1 / (12 * m) - 1 / (360 * m**3) + 0.5 * math.log(2 * math.pi)
    for k in range(8):
        out = out - np.log(n + k + 1)
    return out


class Seatings:
    """log S_d(c, t), but for a term of c alone, by the saddle point of its generating function.

    S_d(c, t) = c! / t! [x^c] g(x)^t for g(x) = (1 - (1 - x)^d) / d; the saddle point depends on
    c / t alone. What this lacks for few tables hardly depends on c and is taken from c = EXACT.
    """

    def __init__(self, d: float, stirling: np.ndarray):
        self.d = d
        self.logs = -np.exp(np.linspace(math.log(200.0), math.log(1e-9), 8192))  # log (1 - x)
        x, g, slope, _ = self.parts(self.logs)
        self.ratio = np.log(x * slope / g)
        few = np.arange(1, EXACT // 2)
        self.lack = stirling[EXACT, 1 : EXACT // 2] - self.plain(np.full(len(few), float(EXACT)), few.astype(np.float64))

    def parts(self, y: np.ndarray):
        d = self.d
        return -np.expm1(y), -np.expm1(d * y) / d, np.exp((d - 1) * y), (1 - d) * np.exp((d - 2) * y)

    def plain(self, c: np.ndarray, t: np.ndarray) -> np.ndarray:
        x, g, g1, g2 = self.parts(np.interp(-np.log(c / t), -self.ratio, self.logs))
        spread = x * g1 / g + x * x * (g2 / g - (g1 / g) ** 2)
        return t * np.log(g) - c * np.log(x) - log_factorial(t) - 0.5 * np.log(t * np.maximum(spread, 1e-300))

    def __call__(self, c: np.ndarray, t: np.ndarray) -> np.ndarray:
        return self.plain(c, np.minimum(t, c - 0.5)) + self.lack[np.minimum(t.astype(np.int64), len(self.lack)) - 1]


def draw_many(c: np.ndarray, new, d: float, rng: np.random.Generator | Draws, stirling: np.ndarray, points: int = 64) -> np.ndarray:
    """The same for dishes of many customers, on a grid that closes in on where the weight lies."""
    seatings, rows = Seatings(d, stirling), np.arange(len(c))[:, None]
    lo, hi = np.ones((len(c), 1)), c[:, None].copy()
    for turn in range(4):
        k = np.arange(points + 1) / points
        t = np.rint(lo * (hi / lo) ** k if turn == 0 else lo + (hi - lo) * k)
        steps = np.diff(t, axis=1)
        added = np.where(steps > 0, steps * np.log(new(rows, np.maximum(t[:, :-1] + (steps - 1) / 2, 0))), 0)
        p = seatings(np.broadcast_to(c[:, None], t.shape), t) + np.concatenate([np.zeros((len(c), 1)), added.cumsum(1)], 1)
        near = p > p.max(1, keepdims=True) - 25
        if turn < 3:
            first, last = near.argmax(1), points - near[:, ::-1].argmax(1)
            lo, hi = (np.take_along_axis(t, np.clip(x, 0, points)[:, None], 1) for x in (first - 1, last + 1))
    # a point stands for the numbers from half-way back to half-way on; of equal points one counts
    left = np.concatenate([t[:, :1], np.floor((t[:, 1:] + t[:, :-1]) / 2) + 1], 1)
    width = np.concatenate([left[:, 1:], t[:, -1:] + 1], 1) - left
    with np.errstate(divide="ignore"):
        at = (p + np.log(np.maximum(width, 0)) + rng.gumbel(size=p.shape)).argmax(1)[:, None]
    start, size = np.take_along_axis(left, at, 1)[:, 0], np.take_along_axis(width, at, 1)[:, 0]
    return np.clip(start + np.floor(rng.random(len(c)) * size), 1, c).astype(np.int64)


def seat(c: np.ndarray, t: np.ndarray, total: np.ndarray, c0: np.ndarray, t0: np.ndarray, z: Root, rng: np.random.Generator | Draws, stirling: np.ndarray) -> np.ndarray:
    """New numbers of tables of dishes with c customers at t tables.

    ``total`` are the tables of each one's restaurant, c0 and t0 the customers and tables of
    its word at the root, all with these t.
    """
    rest, other = total - t, np.maximum(c0 - t, 0)
    kept = np.minimum(t0, other)
    share = (z.strength + z.root_discount * z.tables) / (z.vocabulary + 1)

    def new(i, j):
        here = other[i] + j
        parent = (here - z.root_discount * np.maximum(kept[i], np.minimum(here, 1)) + share) / (z.strength + z.customers - t[i] + j)
        return (z.strength + z.discount * (rest[i] + j)) * parent

    return draw(c, new, z.discount, rng, stirling)


def seat_root(c0: np.ndarray, t0: np.ndarray, z: Root, rng: np.random.Generator | Draws, stirling: np.ndarray) -> np.ndarray:
    rest = z.tables - t0

    def new(i, j):
        return (z.strength + z.root_discount * (rest[i] + j)) / (z.vocabulary + 1)

    return draw(c0, new, z.root_discount, rng, stirling)


def discount(ones: int, twos: int) -> float:
    """The usual estimate from how many dishes have one and two customers."""
    return min(0.95, max(0.05, ones / max(ones + 2 * twos, 1)))


# the model ---------------------------------------------------------------------------------


@dataclass(frozen=True)
class Model:
    """Averages over the samples; ``free`` is (theta + d t_u) / (theta + c_u)."""

    frequent: Frequent
    free: np.ndarray  # of frequent words
    chance: np.ndarray  # of frequent words at the root
    rare: DataFrame  # code, c, free, chance
    common: DataFrame  # block, u, w, c, ts as arrays: pairs of frequent words seen twice and more, ts: tables summed over the samples
    others: DataFrame  # u, w, c, ts: those of which a word is rare
    pairs: DataFrame  # all pairs, in blocks
    root: Root
    unknown: float  # chance at the root of a word that training lacks
    tokens: int
    blocks: int
    samples: int

    @property
    def dishes(self) -> DataFrame:
        """u, w, c, ts of all pairs seen twice and more, a row each."""
        return flat(self.common).unionByName(self.others)

    def alone(self) -> Model:
        """The numbers without the tables."""
        return replace(self, frequent=None, free=None, chance=None, rare=None, common=None, others=None, pairs=None)

    def gain(self, c, t, guests, free, chance):
        """log10 of how much likelier a pair is than its two words alone make it."""
        return np.log10(1 + (c - self.root.discount * t) / ((self.root.strength + guests) * free * chance))


def bins(c: str) -> Column:
    return F.floor(F.log2(c) * 16)


def cut_off(histogram: DataFrame, most: int) -> int:
    """The least bin from which on at most ``most`` rows remain; histogram: bin, n."""
    least = 1 << 20
    for r in histogram.groupBy("bin").agg(F.sum("n").alias("n")).orderBy(F.desc("bin")).collect():
        most -= r.n
        if most < 0:
            break
        least = r.bin
    return least


def array_bins(c: np.ndarray) -> np.ndarray:
    return np.floor(np.log2(c) * 16).astype(np.int64)


def flat(common: DataFrame, least: int = 0) -> DataFrame:
    """u, w, c, ts of the dishes in arrays from a bin of counts on, a row each."""
    schema = pa.schema([(x, pa.int64()) for x in ("u", "w", "c", "ts")])

    def run(it):
        for b in it:
            for x in arrays(b, *schema.names):
                on = array_bins(x[2]) >= least
                yield from some_rows(schema, *(y[on] for y in x))

    return common.mapInArrow(store.lean(run), "u long, w long, c long, ts long")


def frequent_words(words: DataFrame, docs: int, most: int) -> tuple[Frequent, int]:
    """The broadcast table and the bin of counts from which on words are in it."""
    own = F.col("w").isin(int(END.view(np.int64)), int(START.view(np.int64)))
    least = cut_off(words.where(~own).select(bins("c").alias("bin"), F.lit(1).alias("n")), most)
    rows = words.where((bins("c") >= least) & ~own).select("w", "c").toArrow().combine_chunks()
    h = np.concatenate([rows.column("w").to_numpy().astype(np.int64).view(np.uint64), [END, START]])
    c = np.concatenate([rows.column("c").to_numpy().astype(np.int64), [docs, 0]])
    guests = np.concatenate([c[:-2], [0, docs]])
    return Frequent.of(h, c, guests), least


def _by_code(rows: DataFrame, size: int, *names: str) -> list[np.ndarray]:
    """Columns of frequent words' rows (code, ...) as dense arrays: at most ``size`` rows."""
    got = rows.where("code >= 0").select("code", *names).toArrow().combine_chunks()
    out = []
    for n in names:
        x = np.zeros(size, np.int64)
        x[got.column("code").to_numpy()] = got.column(n).to_numpy()
        out.append(x)
    return out


def train_model(train: DataFrame, frequent: int = FREQUENT, burn_in: int = BURN_IN, samples: int = SAMPLES) -> Model:
    """Counts and seating over all rows of ``train``."""
    spark = store.small_batches(train).sparkSession
    words, words_path = store.save(word_counts(train))
    end = int(END.view(np.int64))
    stats = words.agg(F.count("*").alias("V"), F.coalesce(F.sum("c"), F.lit(0)).alias("N"), F.coalesce(F.max(F.when(F.col("w") == end, F.col("c"))), F.lit(0)).alias("docs")).first()
    known, least = frequent_words(words, stats.docs, frequent)
    size = len(known.hashes)
    table = spark.sparkContext.broadcast(known)
    blocks = max(16, int(stats.N) // PER_BLOCK)
    pairs, _ = store.save(pair_counts(train, table, blocks))

    kept, kept_path = store.save(word_pairs(pairs))
    seen = kept.agg(*[F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in ("ones", "twos", "before")], F.coalesce(F.sum((F.col("before") == 1).cast("long")), F.lit(0)).alias("r1"), F.coalesce(F.sum((F.col("before") == 2).cast("long")), F.lit(0)).alias("r2")).first()
    after, before = _by_code(kept, size, "after", "before")
    # a dish has one table to begin with, in its restaurant and at the root
    z = Root(float(seen.before), float(stats.V), stats.V, discount(seen.ones, seen.twos), discount(seen.r1, seen.r2))
    plain = words.where((bins("c") < least) & (F.col("w") != end)).select(F.col("w").bitwiseOR(F.lit(_RARE)).alias("code"), "c")
    zero = F.lit(0).cast("long")
    rare, rare_path = store.save(plain.join(kept.where("code < 0"), "code").select("code", "c", "after", "before", F.col("after").alias("total"), F.col("before").alias("c0"), F.lit(1).cast("long").alias("t0"), zero.cast("double").alias("chances"), zero.alias("totals")))

    def rare_twice(it):
        schema = pa.schema([(x, pa.int64()) for x in ("u", "w", "c", "t", "ts")])
        for b in it:
            for u, w, c in arrays(b, "u", "w", "c"):
                on = (c > 1) & ((u < 0) | (w < 0))
                yield from some_rows(schema, u[on], w[on], c[on], np.ones(on.sum(), np.int64), np.zeros(on.sum(), np.int64))

    kind = "u long, w long, c long, t long, ts long"
    others, path = store.save(pairs.mapInArrow(store.lean(rare_twice), kind))
    common, common_path = pairs, None
    store.drop(spark, words_path, kept_path)
    total, c0 = after.copy(), before.copy()
    t0 = np.minimum(c0, 1)
    totals, chances, unknown = np.zeros(size), np.zeros(size), 0.0

    def sweep(seed: int, z: Root, shared, sampled: bool):
        schema = pa.schema([(x, pa.int64()) for x in ("u", "w", "c", "t", "ts")])

        def run(it):
            total, c0, t0 = shared.value
            low = log_stirling(z.discount, EXACT)
            for b in it:
                u, w, c, t, ts = (b.column(x).to_numpy() for x in ("u", "w", "c", "t", "ts"))
                if not len(u):
                    continue
                at, at0 = np.maximum(u, 0), np.maximum(w, 0)
                mine = [total[at], c0[at0], t0[at0]]
                if "total" in b.schema.names:
                    for i, (x, code) in enumerate((("total", u), ("c0", w), ("t0", w))):
                        mine[i] = np.where(code < 0, b.column(x).fill_null(0).to_numpy(), mine[i])
                fresh = seat(c, t, *mine, z, Draws([seed], u, w), low)
                yield text.table(schema, u, w, c, fresh, ts + fresh if sampled else ts)

        return run

    def common_sweep(number: int, z: Root, shared, sampled: bool):
        """Rows of ``common``; then, by ``part`` of the codes, (u) codes, (c) tables beyond the first of their restaurants and (t) of their dishes."""
        schema = pa.schema([("block", pa.int64()), ("part", pa.int64()), *((x, pa.binary()) for x in ("u", "w", "c", "t", "ts"))])

        def run(it):
            total, c0, t0 = shared.value
            low = log_stirling(z.discount, EXACT)
            up, down = np.zeros(size, np.int64), np.zeros(size, np.int64)
            for b in it:
                for i, block in enumerate(b.column("block").to_pylist()):
                    stored = [b.column(x)[i] for x in ("u", "w", "c")]
                    u, w, c = (unpacked(x, np.int64) for x in stored)
                    if number:
                        t, ts = (unpacked(b.column(x)[i], np.int64) for x in ("t", "ts"))
                    else:  # rows of pairs
                        on = (c > 1) & (u >= 0) & (w >= 0)
                        u, w, c = u[on], w[on], c[on]
                        t, ts = np.ones(len(u), np.int64), np.zeros(len(u), np.int64)
                        stored = [pa.scalar(packed(x), pa.binary()) for x in (u, w, c)]
                    if len(u):
                        fresh = seat(c, t, total[u], c0[w], t0[w], z, Draws([number], u, w), low)
                        up += np.bincount(u, fresh - 1, size).astype(np.int64)
                        down += np.bincount(w, fresh - 1, size).astype(np.int64)
                        yield text.table(schema, [block], [None], *([x.as_py()] for x in stored), [packed(fresh)], [packed(ts + fresh if sampled else ts)])
            for a in range(0, size, PER_SUM):
                at = a + np.flatnonzero(up[a : a + PER_SUM] + down[a : a + PER_SUM])
                if len(at):
                    yield text.table(schema, [None], [a // PER_SUM], [packed(at, True)], [None], [packed(up[at])], [packed(down[at])], [None])

        return run

    def part_sums(it):
        """The sums of whole parts, whatever the number of rows of a part."""
        schema = pa.schema([("part", pa.int64()), ("up", pa.binary()), ("down", pa.binary())])
        sums: dict[int, np.ndarray] = {}
        for b in it:
            for part, u, c, t in zip(b.column("part").to_pylist(), *(b.column(x) for x in ("u", "c", "t")), strict=True):
                have = sums.setdefault(part, np.zeros((2, PER_SUM), np.int64))
                have[:, unpacked(u, np.int64, True) - part * PER_SUM] += np.stack([unpacked(c, np.int64), unpacked(t, np.int64)])
        for part, (up, down) in sums.items():
            yield text.table(schema, [part], [packed(up)], [packed(down)])

    def root_sweep(number: int, z: Root):
        schema = pa.schema([("code", pa.int64()), ("c", pa.int64()), ("after", pa.int64()), ("before", pa.int64()), ("total", pa.int64()), ("c0", pa.int64()), ("t0", pa.int64()), ("chances", pa.float64()), ("totals", pa.int64())])

        def run(it):
            top = log_stirling(z.root_discount, EXACT)
            for b in it:
                c0 = b.column("c0").to_numpy()
                t0 = seat_root(c0, b.column("t0").to_numpy(), z, Draws([number, 1], b.column("code").to_numpy()), top)
                yield text.table(schema, *(b.column(x) for x in ("code", "c", "after", "before", "total", "c0")), t0, b.column("chances"), b.column("totals"))

        return run

    top = log_stirling(z.root_discount, EXACT)
    for number in range(burn_in + samples):
        sampled = number >= burn_in
        shared = spark.sparkContext.broadcast((total, c0, t0))
        seated, seated_path = store.save(common.mapInArrow(store.lean(common_sweep(number, z, shared, sampled)), "block long, part long, u binary, w binary, c binary, t binary, ts binary"))
        met = others.join(rare.select(F.col("code").alias("u"), "total"), "u", "left").join(rare.select(F.col("code").alias("w"), "c0", "t0"), "w", "left")
        new, new_path = store.save(met.mapInArrow(store.lean(sweep(number, z, shared, sampled)), kind))
        store.drop(spark, path, *([common_path] if common_path else []))
        shared.unpersist()
        others, path, common_path = new, new_path, seated_path
        common = seated.where("block is not null").select("block", "u", "w", "c", "t", "ts")
        more = others.where("t > 1")
        less = F.col("t") - 1
        moves = more.select(F.col("u").alias("code"), less.alias("x"), zero.alias("y")).unionByName(more.select(F.col("w").alias("code"), zero.alias("x"), less.alias("y")))
        moves = moves.groupBy("code").agg(F.sum("x").alias("x"), F.sum("y").alias("y"))
        total, c0 = (a + x for a, x in zip((after, before), _by_code(moves, size, "x", "y"), strict=True))
        whole = seated.where("part is not null").select("part", "u", "c", "t").repartition(-(-size // PER_SUM), "part").mapInArrow(store.lean(part_sums), "part long, up binary, down binary")
        for r in whole.collect():
            at = slice(r.part * PER_SUM, min((r.part + 1) * PER_SUM, size))
            for have, x in ((total, r.up), (c0, r.down)):
                have[at] += unpacked(pa.scalar(bytes(x), pa.binary()), np.int64)[: at.stop - at.start]
        moved = rare.join(moves.where("code < 0"), "code", "left")
        moved = moved.select("code", "c", "after", "before", (F.col("after") + F.coalesce("x", zero)).alias("total"), (F.col("before") + F.coalesce("y", zero)).alias("c0"), "t0", "chances", "totals")
        sat, sat_path = store.save(moved.mapInArrow(store.lean(root_sweep(number, z)), rare.schema))
        store.drop(spark, rare_path)
        t0 = seat_root(c0, np.minimum(t0, c0), z, Draws([number, 2], np.arange(size)), top)
        sums = sat.agg(F.coalesce(F.sum("c0"), zero).alias("c"), F.coalesce(F.sum("t0"), zero).alias("t")).first()
        z = replace(z, customers=float(sums.c + c0.sum()), tables=float(sums.t + t0.sum()))
        rare, rare_path = sat, sat_path
        if sampled:
            totals, chances, unknown = totals + total, chances + z.chance(c0, t0), unknown + z.chance(0, 0)
            level = (z.strength + z.root_discount * z.tables) / (z.vocabulary + 1)
            p = (F.col("c0") - F.lit(z.root_discount) * F.col("t0") + F.lit(level)) / F.lit(z.strength + z.customers)
            rare = rare.withColumn("chances", F.col("chances") + p).withColumn("totals", F.col("totals") + F.col("total"))
    table.unpersist()
    free = (F.lit(z.strength) + F.lit(z.discount / samples) * F.col("totals")) / (F.lit(z.strength) + F.col("c"))
    rare = rare.select("code", "c", free.alias("free"), (F.col("chances") / samples).alias("chance"))
    mine = (z.strength + z.discount * totals / samples) / (z.strength + known.guests)
    return Model(known, mine, chances / samples, rare, common, others.select("u", "w", "c", "ts"), pairs, z, unknown / samples, int(stats.N), blocks, samples)


# scores ------------------------------------------------------------------------------------


def gains(model: Model, table) -> DataFrame:
    """Rows (block, kind, key, gain, ...) of all pairs of training.

    Kind 5 has no gain: pairs of frequent words seen once, whose gain their words tell.
    """
    schema = pa.schema([("block", pa.int64()), ("kind", pa.int32()), ("key", pa.binary()), ("value", pa.binary()), ("n", pa.binary()), ("rid", pa.binary())])

    def rows_of(u, w, gain):
        keys = pair_keys(u, w)
        order = np.argsort(keys)
        keys, gain = keys[order], gain[order].astype(np.float32)
        return some_blocks(schema, ((b, 0, *x, None, None) for b, *x in by_block(keys, model_blocks, keys, gain, rising=1)))

    model_blocks, samples, gain = model.blocks, model.samples, model.alone().gain

    # a row of frequent words' pairs is one of a block, sorted by key, as it was counted

    def twice(it):
        known, free, chance = table.value
        for b in it:
            for block, (u, w, c, ts) in zip(b.column("block").to_pylist(), arrays(b, "u", "w", "c", "ts"), strict=True):
                more = gain(c, ts / samples, known.guests[u], free[u], chance[w]).astype(np.float32)
                yield text.table(schema, [block], [0], [packed(pair_keys(u, w), True)], [packed(more)], [None], [None])

    def once(it):
        for b in it:
            for block, (u, w, c) in zip(b.column("block").to_pylist(), arrays(b, "u", "w", "c"), strict=True):
                on = (c == 1) & (u >= 0) & (w >= 0)
                yield text.table(schema, [block], [5], [packed(pair_keys(u[on], w[on]), True)], [None], [None], [None])

    def rare_once(it):
        schema = pa.schema([("u", pa.int64()), ("w", pa.int64()), ("c", pa.int64()), ("t", pa.float64())])
        for b in it:
            for u, w, c in arrays(b, "u", "w", "c"):
                on = (c == 1) & ((u < 0) | (w < 0))
                yield from some_rows(schema, u[on], w[on], c[on], c[on].astype(np.float64))

    def rare(it):
        known, free, chance = table.value
        for b in it:
            u, w, c, t = (b.column(x).to_numpy() for x in ("u", "w", "c", "t"))
            guests, f, p = (b.column(x).to_numpy(zero_copy_only=False) for x in ("guests", "free", "chance"))
            at, at0 = np.maximum(u, 0), np.maximum(w, 0)
            yield from rows_of(u, w, gain(c, t, np.where(u < 0, guests, known.guests[at]), np.where(u < 0, f, free[at]), np.where(w < 0, p, chance[at0])))

    kind = "block long, kind int, key binary, value binary, n binary, rid binary"
    few = model.pairs.mapInArrow(store.lean(rare_once), "u long, w long, c long, t double").unionByName(model.others.select("u", "w", "c", (F.col("ts") / samples).alias("t")))
    few = few.join(model.rare.select(F.col("code").alias("u"), F.col("c").alias("guests"), "free"), "u", "left").join(model.rare.select(F.col("code").alias("w"), "chance"), "w", "left")
    few = few.select("u", "w", "c", "t", F.coalesce("guests", F.lit(0)).alias("guests"), F.coalesce("free", F.lit(1.0)).alias("free"), F.coalesce("chance", F.lit(1.0)).alias("chance"))
    return model.common.mapInArrow(store.lean(twice), kind).unionByName(model.pairs.mapInArrow(store.lean(once), kind)).unionByName(few.mapInArrow(store.lean(rare), kind))


def frequent_pairs(model: Model, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys and gains of the most frequent pairs of frequent words."""
    schema = pa.schema([("bin", pa.int64()), ("n", pa.int64())])

    def histogram(it):
        n = np.zeros(64 * 16, np.int64)
        for b in it:
            for (c,) in arrays(b, "c"):
                n += np.bincount(array_bins(c), minlength=len(n))
        yield text.table(schema, np.flatnonzero(n), n[n > 0])

    got = flat(model.common, cut_off(model.common.mapInArrow(store.lean(histogram), "bin long, n long"), most)).toArrow().combine_chunks()
    u, w, c, ts = (got.column(x).to_numpy() for x in ("u", "w", "c", "ts"))
    keys = pair_keys(u, w)
    order = np.argsort(keys)
    gain = model.gain(c, ts / model.samples, model.frequent.guests[u], model.free[u], model.chance[w])
    return keys[order], gain[order]


def by_document(rids: np.ndarray, *values: np.ndarray | None) -> tuple[np.ndarray, ...]:
    r, at = np.unique(rids, return_inverse=True)
    return r, *(np.zeros(len(r)) if x is None else np.bincount(at, x, len(r)) for x in values)


def by_bucket(buckets: int, rids: np.ndarray, *sums: np.ndarray) -> Iterator[tuple]:
    """(bucket, rids, sums) packed, one row for all documents of a bucket; rids rise."""
    three = np.stack(sums, 1).copy().view("V24")[:, 0]
    return by_block(rids >> GROUP, buckets, rids, three, rising=1)


def score(docs: DataFrame, model: Model, modulus: int = 7, rest: int = 2, pairs: int = PAIRS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity."""
    spark, parts = docs.sparkSession, store.partitions(docs.sparkSession)
    size = model.tokens + model.root.vocabulary + 1
    table = spark.sparkContext.broadcast((model.frequent, model.free, model.chance))
    top = spark.sparkContext.broadcast(frequent_pairs(model, pairs))
    blocks, unknown = model.blocks, float(np.log10(model.unknown))
    schema = pa.schema([("block", pa.int64()), ("kind", pa.int32()), ("key", pa.binary()), ("value", pa.binary()), ("n", pa.binary()), ("rid", pa.binary())])

    def ask(it):
        """Each document's sums (kind 3), and its pairs (1) and rare words (2) that others must look up."""
        (known, free, chance), (hot, hot_gain) = table.value, top.value
        bases, lower, lone = np.log10((known.count + 1) / size), np.log10(chance), np.log10(free)
        rid = TaskContext.get().partitionId() << 40
        held, total = {1: [], 2: []}, 0

        def flush():
            for kind, sets in held.items():
                if sets:
                    k, r, n = (np.concatenate(x) for x in zip(*sets, strict=True))
                    sets.clear()
                    order = np.argsort(k, kind="stable")
                    k, r, n = k[order], r[order], n[order]
                    yield from some_blocks(schema, ((b, kind, k, None, n, r) for b, k, n, r in by_block(k, blocks, k, n, r, rising=1)))

        for part, data, off in text.slices(it, SLICE_BYTES):
            docs_ = len(off) - 1
            h, first = token_hashes(data, off)
            w = known.codes(h)
            u = known.before(w, first)
            doc = np.repeat(np.arange(docs_), np.diff(first))
            fw, fu = w >= 0, u >= 0
            wf = w[fw]
            base = np.bincount(doc[fw], bases[wf], docs_)
            sure = np.bincount(doc[fw & (known.count[np.maximum(w, 0)] > 0)], minlength=docs_)
            points = np.bincount(doc[fw], lower[wf], docs_) + np.bincount(doc[fu], lone[u[fu]], docs_)
            keys = pair_keys(u, w)
            if len(hot):
                at = np.minimum(np.searchsorted(hot, keys), len(hot) - 1)
                hit = hot[at] == keys
                points += np.bincount(doc[hit], hot_gain[at[hit]], docs_)
                keys, at = keys[~hit], doc[~hit]
            else:
                at = doc
            rids = rid + np.arange(docs_)
            rid += -(-docs_ >> GROUP) << GROUP  # a group's documents are of one slice
            if len(keys):
                held[1].append((keys, rids[at], np.ones(len(keys), np.int32)))
            # n is 1 for a word and 2 for a context
            if not fw.all():
                held[2].append((w[~fw], rids[doc[~fw]], np.ones((~fw).sum(), np.int32)))
            if not fu.all():
                held[2].append((u[~fu], rids[doc[~fu]], np.full((~fu).sum(), 2, np.int32)))
            total += len(keys) + 2 * int((~fw).sum())
            ids = part.column("doc_id")
            for a in range(0, docs_, 1 << GROUP):
                s = slice(a, a + (1 << GROUP))
                facts = np.stack([ids[s].fill_null(0).to_numpy().astype(np.int64), ids[s].is_null().to_numpy(zero_copy_only=False).astype(np.int64), np.diff(first)[s], sure[s]])
                yield text.table(schema, [int(block_of(rids[a : a + 1], blocks)[0])], [3], [packed(facts.ravel())], [packed(np.stack([base[s], points[s]]).ravel())], [None], [packed(rids[s], True)])
            if total > ASKED:
                yield from flush()
                store.give_back()
                total = 0
        yield from flush()

    sum_schema = pa.schema([("bucket", pa.int64()), ("rid", pa.binary()), ("facts", pa.binary()), ("sums", pa.binary())])

    def numbers(t: pa.Table, name: str, at: np.ndarray, kind) -> np.ndarray:
        column = t.column(name).chunk(0)
        return np.concatenate([np.zeros(0, kind), *(unpacked(column[i], kind, name == "key") for i in at.tolist())])

    gain = model.alone().gain

    def table_of(t: pa.Table, at: np.ndarray, kind, width: int, plain=()) -> tuple[np.ndarray, np.ndarray]:
        """A block's keys in order and what is known of them (nan: nothing); never empty."""
        bare = numbers(t, "key", np.array(plain, np.int64), np.int64)
        keys = np.concatenate([numbers(t, "key", at, np.int64), bare, np.zeros(int(len(at) + len(plain) == 0), np.int64)])
        values = np.full((len(keys), width), np.nan, kind)
        known = numbers(t, "value", at, kind).reshape(-1, width)
        values[: len(known)] = known
        order = np.argsort(keys, kind="stable")
        return keys[order], values[order]

    def met_pairs(t: pa.Table, known, asked, once):
        words, free, chance = table.value
        keys, gains_ = table_of(t, known, np.float32, 1, once)
        ask_ = numbers(t, "key", asked, np.int64)
        at = np.minimum(np.searchsorted(keys, ask_), len(keys) - 1)
        hit = (keys[at] == ask_) & (len(known) + len(once) > 0)
        more, key = gains_[at[hit], 0].astype(np.float64), ask_[hit]
        bare = np.flatnonzero(np.isnan(more))
        u, w = key[bare] >> 32, key[bare] & 0xFFFFFFFF
        more[bare] = gain(1, 1, words.guests[u], free[u], chance[w])
        return numbers(t, "rid", asked, np.int64)[hit], None, None, more * numbers(t, "n", asked, np.int32)[hit]

    def met_words(t: pa.Table, known, asked, _):
        keys, facts = table_of(t, known, np.float64, 3)
        ask_, n = numbers(t, "key", asked, np.int64), numbers(t, "n", asked, np.int32)
        at = np.minimum(np.searchsorted(keys, ask_), len(keys) - 1)
        hit, word = (keys[at] == ask_) & (len(known) > 0), n == 1
        c = np.where(hit, facts[at, 0], 0)
        with np.errstate(divide="ignore"):
            value = np.where(hit, np.log10(np.where(word, facts[at, 2], facts[at, 1])), np.where(word, unknown, 0.0))
        return numbers(t, "rid", asked, np.int64), word & hit, np.where(word, np.log10((c + 1) / size), 0.0), value

    def out(held):
        return some_blocks(sum_schema, ((b, r, None, x) for b, r, x in by_bucket(blocks, *by_document(*map(np.concatenate, zip(*held, strict=True))))) if held else iter(()))

    def answer(it):
        """Sums by document of what a task's blocks know, and the documents' own facts and sums."""
        held: list[tuple] = []
        for t, edges in graph.whole_groups(it, "block"):
            kinds = t.column("kind").to_numpy()
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                where = {k: a + np.flatnonzero(kinds[a:b] == k) for k in range(6)}
                for met_, known, asked in ((met_pairs, where[0], where[1]), (met_words, where[4], where[2])):
                    if len(asked):
                        rids, *rest_ = met_(t, known, asked, where[5])
                        held.append(by_document(rids, *rest_))
                if sum(len(x[0]) for x in held) > HELD:
                    held = [by_document(*map(np.concatenate, zip(*held, strict=True)))]
                    if len(held[0][0]) > HELD // 2:
                        yield from out(held)
                        held = []
                for i in where[3].tolist():
                    first = unpacked(t.column("rid")[i], np.int64, True)[:1] >> GROUP
                    yield text.table(sum_schema, block_of(first, blocks), [t.column("rid")[i].as_py()], [t.column("key")[i].as_py()], [t.column("value")[i].as_py()])
            del t
            store.give_back()
        yield from out(held)

    def rare_words(it):
        for b in it:
            keys = b.column("code").to_numpy()
            facts = np.stack([b.column(x).to_numpy().astype(np.float64) for x in ("c", "free", "chance")], 1)
            order = np.argsort(keys)
            found = by_block(keys[order], blocks, keys[order], facts[order].copy().view("V24")[:, 0], rising=1)
            yield from some_blocks(schema, ((block, 4, k, f, None, None) for block, k, f in found))

    kind = "block long, kind int, key binary, value binary, n binary, rid binary"
    met = gains(model, table).unionByName(model.rare.mapInArrow(store.lean(rare_words), kind)).unionByName(store.documents(docs).mapInArrow(store.lean(ask), kind))
    rows = met.repartition(parts, "block").sortWithinPartitions("block").mapInArrow(store.lean(answer), "bucket long, rid binary, facts binary, sums binary")
    out_schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

    def whole(it):
        """Documents with all their sums, bucket by bucket."""
        for t, edges in graph.whole_groups(it, "bucket"):
            plain = t.column("facts").is_null().to_numpy()
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                own, met_ = a + np.flatnonzero(~plain[a:b]), a + np.flatnonzero(plain[a:b])
                rids = np.concatenate([unpacked(t.column("rid")[i], np.int64, True) for i in own.tolist()])
                ids, null, tokens, known = np.concatenate([unpacked(t.column("facts")[i], np.int64).reshape(4, -1) for i in own.tolist()], 1)
                base, points = np.concatenate([unpacked(t.column("sums")[i], np.float64).reshape(2, -1) for i in own.tolist()], 1)
                if len(met_):
                    order = np.argsort(rids)
                    r = np.concatenate([unpacked(t.column("rid")[i], np.int64, True) for i in met_.tolist()])
                    sums = np.concatenate([unpacked(t.column("sums")[i], np.float64).reshape(-1, 3) for i in met_.tolist()])
                    at = order[np.searchsorted(rids, r, sorter=order)]
                    more, base_, points_ = (np.bincount(at, x, len(rids)) for x in sums.T)
                    known, base, points = known + np.rint(more).astype(np.int64), base + base_, points + points_
                yield from some_rows(out_schema, pa.array(ids, mask=null.astype(bool)), tokens, known, base, points)

    sums = rows.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(store.lean(whole), "doc_id long, n_tokens long, n_known long, base_score double, score double")
    out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % modulus == rest
    return sums.select("doc_id", out.alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"))


def scores(docs: DataFrame, modulus: int = 7, rest: int = 2) -> DataFrame:
    """Train on the rows outside the held-out share, score all rows."""
    d = store.documents(docs)
    out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % modulus == rest
    return score(d, train_model(d.where(~out)), modulus, rest)
