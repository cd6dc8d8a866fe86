"""Vectorised handling of Arrow text columns: slices, words and 64-bit word hashes.

A word is ``[^\\x20\\x09-\\x0D]+``; A-Z is lower-cased, nothing else is folded. A null
text counts as the empty text everywhere.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import compress, repeat
from operator import is_
from typing import NamedTuple

import numpy as np
import pyarrow as pa

U = np.uint64
_BASES = (U(0x9E3779B97F4A7C15), U(0xD6E8FEB86659FD93))
_INVERSES = tuple(U(pow(int(b), -1, 1 << 64)) for b in _BASES)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: dict[tuple[int, bool], np.ndarray] = {}

#: Bytes of text handled at once; a longer document is handled alone.
SLICE_BYTES = 1 << 18
#: The same where new words of a slice are worked out together, without arrays over bytes.
WORD_SLICE_BYTES = 1 << 21


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64 bits."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def powers(n: int, lane: int = 0, inverse: bool = False) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64."""
    have = _powers.get((lane, inverse))
    if have is None or len(have) < n:
        x = np.full(max(n, SLICE_BYTES + 16), (_INVERSES if inverse else _BASES)[lane])
        x[0] = 1
        have = _powers[lane, inverse] = np.multiply.accumulate(x)
    return have[:n]


def span_hashes(units: np.ndarray, starts: np.ndarray, ends: np.ndarray, lane: int = 0) -> np.ndarray:
    """Hash of units[s:e] for each span, the same wherever the span lies."""
    n = len(units)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((units.astype(np.uint64) + U(1)) * powers(n, lane), out=sums[1:])
    out = (sums[ends] - sums[starts]) * powers(n + 1, lane, True)[starts]
    return mix(out + (ends - starts).astype(np.uint64))


class Words(NamedTuple):
    """Words of a slice: byte spans, document index and first word of each document."""

    starts: np.ndarray
    ends: np.ndarray
    doc: np.ndarray
    first: np.ndarray  # len(documents) + 1


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets (from 0) of a text column; null is empty."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    n, at = len(column), column.offset
    _, offsets, data = column.buffers()
    if n == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[at : at + n + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[off[0] : off[-1]], off - off[0]


def slices(batches: Iterator[pa.RecordBatch], limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, bytes, offsets) of column ``text``, about ``limit`` bytes at a time."""
    for batch in batches:
        at = 0
        _, off = buffers(batch.column("text"))
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(off, off[at] + limit, "right")) - 1)
            part = batch.slice(at, to - at)
            yield (part, *buffers(part.column("text")))
            at = to


def lowered(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def words(data: np.ndarray, off: np.ndarray) -> Words:
    n, docs = len(data), len(off) - 1
    if n == 0:
        none = np.zeros(0, np.int64)
        return Words(none, none, none, np.zeros(docs + 1, np.int64))
    space = _SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    before = np.empty(n, bool)
    before[0] = True
    before[1:] = space[:-1]
    starts = np.flatnonzero(~space & (before | edge[:-1]))
    after = np.empty(n, bool)
    after[-1] = True
    after[:-1] = space[1:]
    ends = np.flatnonzero(~space & (after | edge[1:])) + 1
    first = np.searchsorted(starts, off)
    return Words(starts, ends, np.repeat(np.arange(docs), np.diff(first)), first)


def word_hashes(data: np.ndarray, w: Words, lane: int = 0) -> np.ndarray:
    return span_hashes(lowered(data), w.starts, w.ends, lane)


def characters(data: np.ndarray) -> np.ndarray:
    """Code points before each byte position (one more entry than bytes)."""
    out = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=out[1:])
    return out


def strings(data: np.ndarray, off: np.ndarray) -> list[str]:
    raw = data.tobytes()
    return [raw[a:b].decode("utf-8", "replace") for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]


class Cache:
    """Bounded memory of words in two generations: a word in use is never forgotten.

    A word counts once for every ``UNIT`` characters.
    """

    UNIT = 32

    def __init__(self, size: int):
        self.size, self.held = size, 0
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def look_up(self, cut: list[list[str]], learn: Callable[[list[str]], Iterable[bytes]]) -> list[list[bytes]]:
        """Values of all words; ``learn`` gives those of words that are new."""
        get = self.young.get
        found = [list(map(get, x)) for x in cut]
        gaps = [list(compress(range(len(x)), map(is_, x, repeat(None)))) for x in found]
        wanted = {words[k] for words, at in zip(cut, gaps, strict=True) for k in at}
        if wanted:
            new = sum(1 + len(w) // self.UNIT for w in wanted)
            if self.held + new > self.size:
                self.old, self.young, self.held = self.young, {}, 0
            self.held += new
            fresh = []
            for w in wanted:
                if (v := self.old.get(w)) is None:
                    fresh.append(w)
                else:
                    self.young[w] = v
            if fresh:
                self.young.update(zip(fresh, learn(fresh), strict=True))
            young = self.young
            for words, values, at in zip(cut, found, gaps, strict=True):
                for k in at:
                    values[k] = young[words[k]]
        return found


def table(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
