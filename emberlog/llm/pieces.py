"""SentencePiece-compatible unigram encoding and decoding.

The pieces and log scores come from a given model file; nothing is trained. Pieces lie in
a double-array trie over their UTF-8 bytes. The best segmentation is the Viterbi path of
the greatest total score; of equal paths the one whose last piece begins first wins, as
in the public library. A character that no piece covers falls back to its UTF-8 bytes.

Blanks become the marker U+2581 and a text gets one in front. No piece holds a marker
after another character (checked when the model is loaded) or a line end, so a text's
segmentation is that of its stretches between those places, one after another; stretches
are solved together, position by position, and kept in a bounded cache.

Null text is the empty text and has no pieces. Decoding restores every valid text except
that markers in it come back as blanks. Rows of equal doc_id are encoded alike. Columns other
than doc_id and text are ignored; no rows give no rows.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import store, text

MARK = "▁"
#: Score of an unknown character below the least score (a fixed value of the format).
UNKNOWN_PENALTY = 10.0
CACHE = 300_000
#: Longer stretches share a walk with those of their own length only.
LONG = 48
#: Longer ones, as scripts without blanks have, are solved alone, so many bytes at once.
ALONE, PART = 512, 1 << 15


class DoubleArray:
    """base[s] + byte is the child of s if check there is s; value is a piece or -1."""

    def __init__(self, keys: list[bytes], values: list[int]):
        children: list[dict[int, int]] = [{}]
        value = [-1]
        for key, v in zip(keys, values, strict=True):
            node = 0
            for c in key:
                if c not in children[node]:
                    children[node][c] = len(children)
                    children.append({})
                    value.append(-1)
                node = children[node][c]
            value[node] = v
        size = 8 * len(children) + 4096
        self.base = np.zeros(size, np.int32)
        self.check = np.full(size, -1, np.int32)
        self.value = np.full(size, -1, np.int32)
        used = bytearray(size)
        used[0] = 1
        self.value[0] = value[0]
        # only children fill the holes that families leave; families move on where it is crowded
        queue, hole, front = deque([(0, 0)]), 1, 1
        while queue:
            node, at = queue.popleft()
            if not children[node]:
                continue
            codes = sorted(children[node])
            if len(codes) == 1:
                hole = used.index(0, max(hole, codes[0] + 1))
                b = hole - codes[0]
            else:
                b, tries = max(1, front - codes[0]), 0
                while any(used[b + c] for c in codes):
                    b += 1
                    tries += 1
                if tries > 64:
                    front += 32
            self.base[at] = b
            for c in codes:
                used[b + c] = 1
                self.check[b + c] = at
                child = children[node][c]
                self.value[b + c] = value[child]
                queue.append((child, b + c))
        used = np.frombuffer(used, np.uint8)
        last = int(np.flatnonzero(used)[-1]) + 257
        self.base, self.check, self.value = (x[:last].copy() for x in (self.base, self.check, self.value))


class Unigram:
    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.vocab_size()
        names = [sp.id_to_piece(i) for i in range(n)]
        scores = [sp.get_score(i) for i in range(n)]
        plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        if any(re.search(f"[^{MARK}]{MARK}|\n", names[i]) for i in plain):
            raise ValueError("a piece holds a marker after another character, or a line end")
        self.byte = np.full(256, sp.unk_id(), np.int32)
        for i in range(n):
            if sp.is_byte(i):
                self.byte[int(names[i][1:-1], 16)] = i
        self.trie = DoubleArray([names[i].encode() for i in plain], plain)
        self.score = np.array(scores, np.float64)
        self.unknown = min(scores[i] for i in plain) - UNKNOWN_PENALTY
        chosen = set(plain)
        self.out = [x.replace(MARK, " ").encode() if i in chosen else b"" for i, x in enumerate(names)]
        for b in range(256):
            if self.byte[b] != sp.unk_id():
                self.out[self.byte[b]] = bytes([b])
        self.cache = text.Cache(CACHE)
        self.stretch = re.compile(f"\n|{MARK}*[^{MARK}\n]+|{MARK}+")

    def solve(self, keys: list[bytes]) -> list[np.ndarray]:
        """Ids of each stretch; all of one length class are walked in step."""
        out: list = [None] * len(keys)
        order = sorted(range(len(keys)), key=lambda i: len(keys[i]))
        at = 0
        while at < len(order):
            if len(keys[order[at]]) > ALONE:  # and so are all that follow
                for i in order[at:]:
                    out[i] = self.alone(keys[i])
                break
            room = max(len(keys[order[at]]), 8)
            to = at
            while to < len(order) and len(keys[order[to]]) <= ALONE and (len(keys[order[to]]) <= room or len(keys[order[to]]) <= LONG and len(keys[order[to]]) <= 2 * room) and to - at < 20_000:
                to += 1
            group = order[at:to]
            for i, ids in zip(group, self.together([keys[i] for i in group]), strict=True):
                out[i] = ids
            at = to
        return out

    def together(self, keys: list[bytes]) -> list[np.ndarray]:
        base, check, value = self.trie.base, self.trie.check, self.trie.value
        n, width = len(keys), max(map(len, keys))
        size = np.array([len(k) for k in keys])
        text_ = np.zeros((n, width + 1), np.uint8)
        for i, k in enumerate(keys):
            text_[i, : len(k)] = np.frombuffer(k, np.uint8)
        lead = (text_ & 0xC0) != 0x80
        step = np.where(text_ < 0x80, 1, np.where(text_ < 0xE0, 2, np.where(text_ < 0xF0, 3, 4)))
        best = np.full((n, width + 1), -np.inf)
        best[:, 0] = 0
        back = np.zeros((n, width + 1), np.int32)
        piece = np.full((n, width + 1), -1, np.int32)
        for s in range(width):
            who = np.flatnonzero((size > s) & lead[:, s] & (best[:, s] > -np.inf))
            if not len(who):
                continue
            from_, single = best[who, s], np.zeros(len(who), bool)
            live, state, at = np.arange(len(who)), np.zeros(len(who), np.int32), s
            while len(live) and at < width:
                rows = who[live]
                child = base[state] + text_[rows, at]
                on = (check[child] == state) & (size[rows] > at)
                live, state = live[on], child[on]
                at += 1
                got = np.flatnonzero(value[state] >= 0)
                if len(got):
                    found, rows = value[state[got]], who[live[got]]
                    total = from_[live[got]] + self.score[found]
                    single[live[got]] |= at - s == step[rows, s]
                    better = total > best[rows, at]
                    rows = rows[better]
                    best[rows, at], back[rows, at], piece[rows, at] = total[better], s, found[better]
            lone = np.flatnonzero(~single)
            if len(lone):
                rows = who[lone]
                to = np.minimum(s + step[rows, s], size[rows])
                total = from_[lone] + self.unknown
                better = total > best[rows, to]
                rows, to = rows[better], to[better]
                best[rows, to], back[rows, to], piece[rows, to] = total[better], s, -1
        out = []
        backs, pieces = back.tolist(), piece.tolist()
        for i, k in enumerate(keys):
            ids, at, b, p = [], len(k), backs[i], pieces[i]
            while at:
                if p[at] >= 0:
                    ids.append(p[at])
                else:
                    ids.extend(self.byte[x] for x in reversed(k[b[at] : at]))
                at = b[at]
            out.append(np.array(ids[::-1], "<u4"))
        return out

    def alone(self, key: bytes) -> np.ndarray:
        """Ids of one long stretch: all pieces that begin in a part of it are found at once."""
        base, check, value = self.trie.base, self.trie.check, self.trie.value
        x, n = np.frombuffer(key, np.uint8), len(key)
        best, back, piece = [-math.inf] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        best[0] = 0.0
        for part in range(0, n, PART):
            begin = part + np.flatnonzero((x[part : part + PART] & 0xC0) != 0x80)
            first = x[begin]
            after = np.minimum(begin + np.where(first < 0x80, 1, np.where(first < 0xE0, 2, np.where(first < 0xF0, 3, 4))), n)
            single = np.zeros(len(begin), bool)
            live, state, at = np.arange(len(begin)), np.zeros(len(begin), np.int32), begin.copy()
            found = []
            while len(live):
                child = base[state] + x[at]
                on = check[child] == state
                live, state, at = live[on], child[on], at[on] + 1
                got = np.flatnonzero(value[state] >= 0)
                found.append((live[got], at[got], value[state[got]]))
                single[live[got]] |= at[got] == after[live[got]]
                on = at < n
                live, state, at = live[on], state[on], at[on]
            lone = np.flatnonzero(~single)
            found.append((lone, after[lone], np.full(len(lone), -1, np.int32)))
            who, end, what = (np.concatenate(c) for c in zip(*found, strict=True))
            order = np.lexsort((end, who))
            gain = np.where(what >= 0, self.score[what], self.unknown)[order].tolist()
            for s, e, p, g in zip(begin[who[order]].tolist(), end[order].tolist(), what[order].tolist(), gain, strict=True):
                if (total := best[s] + g) > best[e]:
                    best[e], back[e], piece[e] = total, s, p
        ids: list[int] = []
        at = n
        while at:
            s = back[at]
            if piece[at] >= 0:
                ids.append(piece[at])
            else:
                ids.extend(int(self.byte[b]) for b in reversed(key[s:at]))
            at = s
        return np.array(ids[::-1], "<u4")

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        cut = [self.stretch.findall(MARK + x.replace(" ", MARK)) if x else [] for x in texts]
        learn = lambda new: [ids.tobytes() for ids in self.solve([w.encode("utf-8", "replace") for w in new])]
        return [np.frombuffer(b"".join(x), "<u4") for x in self.cache.look_up(cut, learn)]

    def decode(self, ids) -> str:
        """Bytes that are no valid UTF-8 become U+FFFD; the first blank is the added one."""
        raw = b"".join(map(self.out.__getitem__, ids.tolist() if isinstance(ids, np.ndarray) else ids))
        return raw.decode("utf-8", "replace").removeprefix(" ")


_models: dict[str, Unigram] = {}


def model(path: str) -> Unigram:
    if path not in _models:
        _models[path] = Unigram(path)
    return _models[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids array<int> of every row."""
    path = path or default_path()
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(it):
        m = model(path)
        for part, data, off in text.slices(it, text.WORD_SLICE_BYTES):
            found = m.encode(text.strings(data, off))
            flat = np.concatenate(found) if found else np.zeros(0)
            ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
            yield text.table(schema, part.column("doc_id"), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.astype(np.int32))))

    return store.documents(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, text of rows of ``encode``; null ids give the empty text."""
    path = path or default_path()
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def run(it):
        m = model(path)
        for b in it:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                yield text.table(schema, part.column("doc_id"), [m.decode(x or []) for x in part.column("ids").to_pylist()])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trips(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_chars, n_pieces, n_bytes (pieces from byte fallback), ids_crc32, round_trip.

    Encodes every whole text, decodes the ids and compares, in one pass.
    """
    path = path or default_path()
    schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("n_pieces", pa.int64()), ("n_bytes", pa.int64()), ("ids_crc32", pa.int64()), ("round_trip", pa.bool_())])

    def run(it):
        m = model(path)
        is_byte = np.zeros(len(m.out), bool)
        is_byte[m.byte] = True
        for part, data, off in text.slices(it, text.WORD_SLICE_BYTES):
            texts = text.strings(data, off)
            rows = [(len(x), len(ids), int(is_byte[ids].sum()), zlib.crc32(ids.tobytes()), m.decode(ids) == x) for x, ids in zip(texts, m.encode(texts), strict=True)]
            yield text.table(schema, part.column("doc_id"), *map(list, zip(*rows, strict=True)))

    return store.documents(docs).mapInArrow(run, "doc_id long, n_chars long, n_pieces long, n_bytes long, ids_crc32 long, round_trip boolean")
