"""Order-preserving packing of token streams into windows by dynamic programming.

Documents are tokenised in the order in which they are read, each followed by ``END``.
Cuts are chosen among document ends, sentence ends and, inside long sentences, word ends
(or any token, where even a word is longer than a window). With f(j) the least cost of a
packing that cuts at boundary j,

    f(j) = penalty(j) + min over i of f(i) + padding(pos j - pos i)

where padding(n) is ``WINDOW - n``, or 0 if n is a power of two from ``LEAST_POWER``. The
minimum over all i within a window is a sliding one, kept by a monotone queue; the powers
of two are looked up. Every boundary costs constant time.

The scan's partitions are packed on their own, without a shuffle; within one, blocks of
``BLOCK`` tokens are solved and the last window of a block is opened again with the next.
A sequence id is the partition's number and a running one, so a task that is run again
gives the same rows. Null text is the empty text: one piece, ``END`` alone. Rows of equal
or null doc_id are packed like any others; extra columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from . import bpe, store, text

WINDOW = 2048
END = 1
LEAST_POWER = 256
#: Tokens that are solved at once.
BLOCK = 1 << 19


@dataclass(frozen=True)
class Penalties:
    """Cost, in tokens of padding, of a cut that ends a window inside a document."""

    sentence: int = 2
    word: int = 24
    token: int = 64
    #: A stretch without a sentence end of more tokens than this may be cut at words.
    long_sentence: int = 256


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def boundaries(ids: np.ndarray, doc_ends: np.ndarray, sentence_end: np.ndarray, word_end: np.ndarray, p: Penalties, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Ascending cut positions (0 first, then up to the end) and the penalty of each."""
    cost = np.full(len(ids) + 1, -1, np.int64)
    after = np.minimum(ids, len(sentence_end) - 1)
    ends = np.flatnonzero(sentence_end[after]) + 1
    cost[ends] = p.sentence
    cost[doc_ends] = 0
    cost[0] = 0
    cost[-1] = max(cost[-1], 0)

    def fill(longest: int, where, price: int) -> None:
        at = np.flatnonzero(cost >= 0)
        for i in np.flatnonzero(np.diff(at) > longest):
            inner = where(at[i] + 1, at[i + 1])
            cost[inner] = price

    fill(p.long_sentence, lambda a, b: np.flatnonzero(word_end[after[a - 1 : b - 1]]) + a, p.word)
    fill(window // 2, lambda a, b: np.arange(a, b), p.token)
    at = np.flatnonzero(cost >= 0)
    return at, cost[at]


def cuts(at: list[int], cost: list[int], window: int = WINDOW, least_power: int = LEAST_POWER) -> list[int]:
    """Positions (0 and the end included) of the cheapest packing."""
    sizes = [1 << k for k in range(window.bit_length()) if least_power <= 1 << k < window]
    longest = max(sizes, default=0)
    # boundary at a position, or the last index, whose f stays infinite while it is looked up;
    # positions below 0 wrap round into the free room at the end
    none = len(at)
    place = [none] * (at[-1] + 1 + longest)
    for i, p in enumerate(at):
        place[p] = i
    f, back = [math.inf] * (none + 1), [0] * none
    f[0] = 0
    g = [0] * none  # f + position, ascending along the queue
    g[0] = at[0]
    queue, head = [0], 0
    for j in range(1, none):
        pos = at[j]
        low = pos - window
        while at[queue[head]] < low:
            head += 1
        best_i = queue[head]
        best = g[best_i] - low
        for size in sizes:
            i = place[pos - size]
            if f[i] < best:
                best, best_i = f[i], i
        f[j] = best = best + cost[j]
        back[j] = best_i
        g[j] = value = best + pos
        while len(queue) > head and g[queue[-1]] >= value:
            del queue[-1]
        queue.append(j)
    out, j = [], len(at) - 1
    while j:
        out.append(at[j])
        j = back[j]
    return [at[0], *reversed(out)]


class Packer:
    """Packs one partition's documents as they come."""

    def __init__(self, sentence_end, word_end, window: int = WINDOW, p: Penalties = Penalties(), block: int = BLOCK):  # noqa: B008
        self.rules = sentence_end, word_end, p, window
        self.window, self.block = window, block
        self.ids: list[np.ndarray] = []
        self.held, self.made = 0, 0
        self.docs: list[tuple] = []  # doc_id, position of its first token here (it may be negative), tokens

    def add(self, doc_id, ids: np.ndarray) -> None:
        """``ids`` with ``END``."""
        self.docs.append((doc_id, self.held, len(ids)))
        self.ids.append(ids)
        self.held += len(ids)

    def flush(self, last: bool) -> Iterator[tuple]:
        """doc_id, start, ids, doc_tokens, sequence, offset of each piece."""
        if not self.held or not last and self.held < self.block:
            return
        ids = np.concatenate(self.ids)
        begins = np.array([b for _, b, _ in self.docs])
        ends = begins + np.array([n for _, _, n in self.docs])
        sentence_end, word_end, p, window = self.rules
        at, cost = boundaries(ids, ends, sentence_end, word_end, p, window)
        chosen = np.array(cuts(at.tolist(), cost.tolist(), window))
        if not last:
            chosen = chosen[:-1]
        upto = int(chosen[-1])
        edges = np.unique(np.concatenate([chosen, begins[(begins > 0) & (begins < upto)]]))
        window_of = np.searchsorted(chosen, edges[:-1], "right") - 1
        doc_of = np.searchsorted(begins, edges[:-1], "right") - 1
        for a, b, w, d in zip(edges[:-1].tolist(), edges[1:].tolist(), window_of.tolist(), doc_of.tolist(), strict=True):
            doc_id, begin, size = self.docs[d]
            yield doc_id, a - begin, ids[a:b], size, self.made + w, a - int(chosen[w])
        self.made += len(chosen) - 1
        rest = int(np.searchsorted(ends, upto, "right"))
        self.docs = [(k, b - upto, n) for k, b, n in self.docs[rest:]]
        self.ids, self.held = ([ids[upto:]], len(ids) - upto) if upto < len(ids) else ([], 0)


def pack(docs: DataFrame, path: str | None = None, window: int = WINDOW, penalties: Penalties = Penalties(), with_ids: bool = False) -> DataFrame:  # noqa: B008
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids) of each piece."""
    path = path or default_path()
    fields = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())]
    schema = pa.schema(fields + [("ids", pa.list_(pa.int64()))] * with_ids)

    def run(it):
        t = bpe.tokens(path)
        end = np.array([END], "<u4")
        packer = Packer(t.sentence_end, t.word_end, window, penalties)
        first = TaskContext.get().partitionId() << 40

        def out(last: bool):
            rows = [(k, s, len(x), zlib.crc32(x.tobytes()), n, first + q, o) + ((x.tolist(),) if with_ids else ()) for k, s, x, n, q, o in packer.flush(last)]
            for i in range(0, len(rows), 20_000):
                yield text.table(schema, *map(list, zip(*rows[i : i + 20_000], strict=True)))

        for part, data, off in text.slices(it, text.WORD_SLICE_BYTES):
            for k, ids in zip(part.column("doc_id").to_pylist(), t.encode(text.strings(data, off)), strict=True):
                packer.add(k, np.concatenate([ids, end]))
            yield from out(False)
        yield from out(True)

    return store.documents(docs).mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<long>" * with_ids)
