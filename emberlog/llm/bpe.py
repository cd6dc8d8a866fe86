"""Word-wise byte-pair encoding of many words in step, for tokenizers with word ends.

``Tokens`` gives the ids that the public ``tokenizers`` library gives for a vocabulary
that lower-cases, drops white space and marks word ends with ``</w>``. Texts of Latin
letters, digits and ASCII punctuation are cut here and their words are merged together
in numpy; every other stretch between blanks goes to the library itself.
"""

from __future__ import annotations

import json
import re

import numpy as np

from . import text

#: Words of each generation whose ids a worker keeps.
CACHE = 300_000
LONG = 64
_FAR = np.int32(2**31 - 1)


def byte_letters() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shifted = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in set(plain))}
    return [chr(shifted.get(b, b)) for b in range(256)]


class Pairs:
    """Rank and result of each merge, by open addressing on the pair of ids."""

    BITS = 19

    def __init__(self, pairs: list[tuple[int, int]], results: list[int]):
        size = 1 << self.BITS
        self.keys = np.full(size, -1, np.int64)
        self.rank = np.full(size, _FAR, np.int32)
        self.result = np.zeros(size, np.int32)
        self.probes = 1
        for r, ((a, b), c) in enumerate(zip(pairs, results, strict=True)):
            slot = int(self.slot(np.array([a << 20 | b]))[0])
            probes = 1
            while self.keys[slot] >= 0:
                slot, probes = (slot + 1) & (size - 1), probes + 1
            self.keys[slot], self.rank[slot], self.result[slot] = a << 20 | b, r, c
            self.probes = max(self.probes, probes)

    def slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.BITS)).astype(np.int64)

    def find(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (or _FAR) and table slot of each pair."""
        key = a.astype(np.int64) << 20 | b
        slot = self.slot(key)
        rank = np.where(self.keys[slot] == key, self.rank[slot], _FAR)
        where = slot
        open_ = (rank == _FAR) & (self.keys[slot] >= 0)
        for k in range(1, self.probes):
            if not open_.any():
                break
            at = (slot + k) & ((1 << self.BITS) - 1)
            hit = open_ & (self.keys[at] == key)
            rank = np.where(hit, self.rank[at], rank)
            where = np.where(hit, at, where)
            open_ &= ~hit & (self.keys[at] >= 0)
        return rank, where


class Tokens:
    GAP = re.compile(r"[^ \t\r\n]+")
    #: Characters whose handling is plain: no contraction, no special token, one case fold.
    SAFE = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ0-9 \t\r\n!-&(-/:;=-@\[-`{-~]*")
    CUT = re.compile(r"[a-zß-öø-ÿ]+|[0-9]|[!-/:-@\[-`{-~]+")
    WORD = re.compile(r"[a-zß-öø-ÿ]+")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.inner = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab = model["vocab"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.pairs = Pairs([(vocab[a], vocab[b]) for a, b in merges], [vocab[a + b] for a, b in merges])
        letters = byte_letters()
        self.inside = np.array([vocab[c] for c in letters], np.int32)
        self.final = np.array([vocab[c + "</w>"] for c in letters], np.int32)
        n = self.inner.get_vocab_size(with_added_tokens=True)
        names = [self.inner.id_to_token(i) or "" for i in range(n)]
        self.word_end = np.array([x.endswith("</w>") for x in names])
        self.sentence_end = np.array([x.isascii() and bool(re.fullmatch(r"[^\w\s]*[.!?][^\w\s]*</w>", x)) for x in names])
        self.cache = text.Cache(CACHE)

    def pieces(self, x: str) -> list[str]:
        """Cached units of a text; only plain words and other whole stretches occur."""
        if self.SAFE.fullmatch(x):
            return self.CUT.findall(x.lower())
        out: list[str] = []
        for gap in self.GAP.findall(x):
            if self.SAFE.fullmatch(gap):
                out += self.CUT.findall(gap.lower())
            else:
                out.append(gap)
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        cut = [self.pieces(x) for x in texts]
        return [np.frombuffer(b"".join(x), "<u4") for x in self.cache.look_up(cut, self.learn)]

    def learn(self, units: list[str]) -> list[bytes]:
        known: dict[str, bytes] = {}
        words, rest = [], []
        for x in units:
            (words if self.WORD.fullmatch(x) else rest).append(x)
        keys = [w.encode() for w in words]
        order = sorted(range(len(keys)), key=lambda i: len(keys[i]))
        at = 0
        while at < len(order) and len(keys[order[at]]) <= LONG:
            room, to = max(6, len(keys[order[at]]) * 3 // 2), at
            while to < len(order) and len(keys[order[to]]) <= min(room, LONG) and to - at < 30_000:
                to += 1
            group = [keys[i] for i in order[at:to]]
            for i, ids in zip(order[at:to], self.merged(group), strict=True):
                known[words[i]] = ids
            at = to
        rest += [words[i] for i in order[at:]]
        for i in range(0, len(rest), 10_000):
            some = rest[i : i + 10_000]
            for w, e in zip(some, self.inner.encode_batch(some, add_special_tokens=False), strict=True):
                known[w] = np.array(e.ids, "<u4").tobytes()
        return [known[w] for w in units]

    def merged(self, keys: list[bytes]) -> list[bytes]:
        """Lowest rank first, leftmost among equals, in all words at once."""
        n, width = len(keys), max(map(len, keys))
        size = np.array([len(k) for k in keys])
        inside = np.arange(width)[None, :] < size[:, None]
        raw = np.zeros((n, width), np.uint8)
        raw[inside] = np.frombuffer(b"".join(keys), np.uint8)
        ids = self.inside[raw]
        ids[np.arange(n), size - 1] = self.final[raw[np.arange(n), size - 1]]
        out, left = ids.copy(), size.copy()
        live = np.flatnonzero(size > 1)
        ids, have = ids[live], size[live]
        rank, slot = self.pairs.find(ids[:, :-1], ids[:, 1:])
        rank[np.arange(width - 1)[None, :] >= (have - 1)[:, None]] = _FAR
        cols = np.arange(width)
        while len(live):
            at = rank.argmin(1)
            rows = np.arange(len(live))
            on = rank[rows, at] < _FAR
            if not on.all():
                done = ~on
                out[live[done]], left[live[done]] = ids[done], have[done]
                live, ids, have, rank, slot, at = live[on], ids[on], have[on], rank[on], slot[on], at[on]
                rows = np.arange(len(live))
                if not len(live):
                    break
            ids[rows, at] = self.pairs.result[slot[rows, at]]
            take = np.minimum(cols[None, :] + (cols[None, :] > at[:, None]), width - 1)
            ids = np.take_along_axis(ids, take, 1)
            have = have - 1
            take = np.minimum(take[:, :-1], width - 2)
            rank, slot = np.take_along_axis(rank, take, 1), np.take_along_axis(slot, take, 1)
            for p in (at - 1, at):
                ok = np.flatnonzero((p >= 0) & (p < have - 1))
                q = p[ok]
                rank[ok, q], slot[ok, q] = self.pairs.find(ids[ok, q], ids[ok, q + 1])
            last = np.flatnonzero(at >= have - 1)
            rank[last, np.minimum(at[last], width - 2)] = _FAR
            rank[cols[None, : width - 1] >= (have - 1)[:, None]] = _FAR
        flat = out[cols[None, :] < left[:, None]].astype("<u4").tobytes()
        ends = (4 * np.cumsum(left)).tolist()
        return [flat[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]


_tokens: dict[str, Tokens] = {}


def tokens(path: str) -> Tokens:
    """One for each worker process and file."""
    if path not in _tokens:
        _tokens[path] = Tokens(path)
    return _tokens[path]
