"""Toxicity scores by a bidirectional gated recurrent network in numpy.

A word enters as its own vector (words that the sample has often enough) and as the mean
of its hashed character trigrams' vectors. Two gated recurrent units read a window of
``WINDOW`` words from both ends; attention pools their states into one vector and a
logistic unit gives the window's logit. A document's logit is the greatest of all its
overlapping windows (``STRIDE`` words apart, half a window: any stretch of up to 33 words
is whole in one of them), each scored in full.

Training runs on the driver over a bounded sample: at most ``SAMPLE`` labelled documents
of each class with texts of up to ``LONGEST`` characters, the least by a hash of doc_id.
The bias is then moved from the sample's class shares to those of all labelled training
rows. Only text is an input of a score. All documents are scored, whole, where they lie.

Null or blank text has one empty window. Without labels of both classes every document
gets the share of toxic labels (0.5 without any label). Rows of equal doc_id are scored
one by one; a null doc_id counts as the text '' in the split. Extra columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import store, text

WINDOW, STRIDE = 64, 32
SAMPLE, LONGEST = 1500, 20_000
WORD, CHAR, HIDDEN, ATTEND = 8, 8, 8, 8
VOCABULARY, TRIGRAMS = 30_000, 4096
EPOCHS, BATCH, LEAST_STEPS = 8, 32, 300
_G = 3 * HIDDEN


class Words:
    """Distinct words of a slice with their trigrams, and each document's words."""

    def __init__(self, data: np.ndarray, off: np.ndarray):
        w = text.words(data, off)
        hashes = text.word_hashes(data, w)
        self.hashes, at, self.index = np.unique(hashes, return_index=True, return_inverse=True)
        self.first = w.first
        low = text.lowered(data).astype(np.uint32)
        starts, ends = w.starts[at], w.ends[at]
        size = ends - starts
        # trigrams over the word with a border on either side: one for each byte
        self.ends = np.cumsum(size)
        pos = np.arange(int(size.sum())) - np.repeat(self.ends - size, size) + np.repeat(starts, size)
        if len(low):
            left = np.where(pos > np.repeat(starts, size), low[np.maximum(pos - 1, 0)], 256)
            right = np.where(pos + 1 < np.repeat(ends, size), low[np.minimum(pos + 1, len(low) - 1)], 257)
            h = (left * np.uint32(0x9E3779B1)) ^ ((low[pos] + np.uint32(3)) * np.uint32(0x85EBCA6B)) ^ (right * np.uint32(0xC2B2AE35))
            h ^= h >> np.uint32(13)
            h *= np.uint32(0x2C1B3C6D)
            self.trigrams = ((h >> np.uint32(11)) % np.uint32(TRIGRAMS)).astype(np.int64)
        else:
            self.trigrams = np.zeros(0, np.int64)
        self.size = size

    def windows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct-word index by window and place (-1: none), length, document of each window."""
        counts = np.diff(self.first)
        many = np.maximum(1, 1 + -(-(counts - WINDOW) // STRIDE))
        doc = np.repeat(np.arange(len(counts)), many)
        nth = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)
        begin = nth * STRIDE
        length = np.clip(counts[doc] - begin, 0, WINDOW)
        place = np.arange(WINDOW)[None, :]
        at = self.first[:-1][doc][:, None] + begin[:, None] + place
        inside = place < length[:, None]
        if not len(self.index):
            return np.full(inside.shape, -1), length, doc
        return np.where(inside, self.index[np.minimum(at, len(self.index) - 1)], -1), length, doc


def tanh(x):
    return np.tanh(x, out=x)


@dataclass
class Network:
    vocabulary: np.ndarray  # sorted hashes; a word's vector is its place + 1, 0 is the unknown word's
    p: dict[str, np.ndarray]

    @classmethod
    def start(cls, vocabulary: np.ndarray, odds: np.ndarray) -> Network:
        rng = np.random.default_rng(5)
        n = lambda *s, scale=0.3: (rng.standard_normal(s) * scale).astype(np.float32)
        p = {"word": n(len(vocabulary) + 1, WORD, scale=0.05), "char": n(TRIGRAMS, CHAR, scale=0.1), "x": n(WORD + CHAR, 2 * _G), "xb": np.zeros(2 * _G, np.float32), "uf": n(HIDDEN, _G), "ub": n(HIDDEN, _G), "nf": np.zeros(HIDDEN, np.float32), "nb": np.zeros(HIDDEN, np.float32), "a": n(2 * HIDDEN, ATTEND), "ab": np.zeros(ATTEND, np.float32), "v": n(ATTEND), "o": n(2 * HIDDEN), "ob": np.zeros(1, np.float32)}
        p["word"][1:, 0] = odds
        return cls(vocabulary, p)

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.vocabulary):
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at + 1, 0)

    def inputs(self, w: Words, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Vectors of the distinct words, and the gates' share of them (a last row of zeros)."""
        if not len(ids):
            return np.zeros((0, WORD + CHAR), np.float32), np.zeros((1, 2 * _G), np.float32)
        mean = np.add.reduceat(self.p["char"][w.trigrams], w.ends - w.size, axis=0) / w.size[:, None].astype(np.float32)
        x = np.concatenate([self.p["word"][ids], mean], 1)
        return x, np.concatenate([x @ self.p["x"] + self.p["xb"], np.zeros((1, 2 * _G), np.float32)])

    def read(self, gates: np.ndarray, index: np.ndarray, length: np.ndarray, way: str, kept: list | None) -> np.ndarray:
        """States (place, window, HIDDEN) of one direction."""
        u, nb = self.p[f"u{way}"], self.p[f"n{way}"]
        g = np.ascontiguousarray(gates[:, :_G] if way == "f" else gates[:, _G:])
        h = np.zeros((len(index), HIDDEN), np.float32)
        out = np.zeros((WINDOW, len(index), HIDDEN), np.float32)
        shortest = int(length.min()) if len(length) else 0
        for t in range(WINDOW) if way == "f" else range(WINDOW - 1, -1, -1):
            x, hu = g[index[:, t]], h @ u
            zr = tanh((x[:, : 2 * HIDDEN] + hu[:, : 2 * HIDDEN]) * np.float32(0.5)) * np.float32(0.5) + np.float32(0.5)
            z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
            inner = hu[:, 2 * HIDDEN :] + nb
            n = tanh(x[:, 2 * HIDDEN :] + r * inner)
            new = n + z * (h - n)
            on = None
            if t >= shortest:
                on = (t < length)[:, None]
                new = np.where(on, new, h)
            if kept is not None:
                kept.append((t, h, z, r, inner, n, on))
            h = out[t] = new
        return out

    def pool(self, states: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, ...]:
        s = tanh(states @ self.p["a"] + self.p["ab"])
        e = s @ self.p["v"]
        e = np.where(np.arange(WINDOW)[:, None] < length[None, :], e, np.float32(-1e9))
        e = np.exp(e - e.max(0))
        weight = e / e.sum(0) * (length > 0)
        pooled = np.einsum("tb,tbh->bh", weight, states)
        return s, weight, pooled, pooled @ self.p["o"] + self.p["ob"][0]

    def logits(self, gates: np.ndarray, index: np.ndarray, length: np.ndarray) -> np.ndarray:
        out = np.empty(len(index), np.float32)
        for a in range(0, len(index), 2048):
            i, n = index[a : a + 2048], length[a : a + 2048]
            states = np.concatenate([self.read(gates, i, n, "f", None), self.read(gates, i, n, "b", None)], 2)
            out[a : a + 2048] = self.pool(states, n)[3]
        return out

    def gradients(self, w: Words, ids: np.ndarray, x: np.ndarray, gates: np.ndarray, index: np.ndarray, length: np.ndarray, toxic: np.ndarray) -> dict[str, np.ndarray]:
        p, kf, kb = self.p, [], []
        states = np.concatenate([self.read(gates, index, length, "f", kf), self.read(gates, index, length, "b", kb)], 2)
        s, weight, pooled, logit = self.pool(states, length)
        d = ((1 / (1 + np.exp(-logit)) - toxic) / len(toxic)).astype(np.float32)
        g = {"o": pooled.T @ d, "ob": d.sum(keepdims=True)}
        dp = d[:, None] * p["o"]
        ds = weight[:, :, None] * dp
        dw = np.einsum("tbh,bh->tb", states, dp)
        de = weight * (dw - (weight * dw).sum(0))
        g["v"] = np.einsum("tb,tba->a", de, s)
        da = de[:, :, None] * p["v"] * (1 - s * s)
        g["a"] = np.einsum("tbh,tba->ha", states, da)
        g["ab"] = da.sum((0, 1))
        ds = ds + da @ p["a"].T
        dgates = np.zeros_like(gates)
        for way, kept, at in (("f", kf, 0), ("b", kb, 1)):
            u = p[f"u{way}"]
            du, dn_bias, dh = np.zeros_like(u), np.zeros(HIDDEN, np.float32), np.zeros((len(index), HIDDEN), np.float32)
            for t, h, z, r, inner, n, on in reversed(kept):
                dh = dh + ds[t][:, at * HIDDEN : (at + 1) * HIDDEN]
                back = dh if on is None else dh * on
                dn = back * (1 - z) * (1 - n * n)
                dz = back * (h - n) * z * (1 - z)
                dr = dn * inner * r * (1 - r)
                di = dn * r
                dhu = np.concatenate([dz, dr, di], 1)
                du += h.T @ dhu
                dn_bias += di.sum(0)
                np.add.at(dgates[:, at * _G : (at + 1) * _G], index[:, t], np.concatenate([dz, dr, dn], 1))
                dh = (dh - back) + back * z + dhu @ u.T
            g[f"u{way}"], g[f"n{way}"] = du, dn_bias
        dgates = dgates[:-1]
        g["xb"], g["x"] = dgates.sum(0), x.T @ dgates
        dx = dgates @ p["x"].T
        g["word"], g["char"] = np.zeros_like(p["word"]), np.zeros_like(p["char"])
        np.add.at(g["word"], ids, dx[:, :WORD])
        np.add.at(g["char"], w.trigrams, np.repeat(dx[:, WORD:] / w.size[:, None].astype(np.float32), w.size, axis=0))
        return g


def log_odds(docs: list[np.ndarray], toxic: np.ndarray, vocabulary: np.ndarray) -> np.ndarray:
    """First component of the words' vectors: how much more often toxic documents hold them."""
    n = np.zeros((2, len(vocabulary)))
    for x, y in zip(docs, toxic.astype(int), strict=True):
        at = np.minimum(np.searchsorted(vocabulary, x), max(len(vocabulary) - 1, 0))
        n[y, at[vocabulary[at] == x]] += 1 if len(vocabulary) else 0
    many = max(toxic.sum(), 1), max((1 - toxic).sum(), 1)
    odds = np.log((n[1] + 0.5) / (many[0] + 1)) - np.log((n[0] + 0.5) / (many[1] + 1))
    seen = n.sum(0)
    return (np.clip(odds * seen / (seen + 4), -4, 4) / 2).astype(np.float32)


def train(texts: list[str], toxic: np.ndarray, epochs: int = EPOCHS) -> Network:
    """Adam on single documents' greatest windows; the same sample gives the same network."""
    toxic = np.asarray(toxic, np.float32)
    hashes = []
    for x in texts:
        data = np.frombuffer(x.encode("utf-8", "replace"), np.uint8)
        hashes.append(np.unique(text.word_hashes(data, text.words(data, np.array([0, len(data)])))))
    every, seen = np.unique(np.concatenate(hashes) if hashes else np.zeros(0, np.uint64), return_counts=True)
    often = np.flatnonzero(seen >= 3)
    often = np.sort(often[np.argsort(-seen[often], kind="stable")[:VOCABULARY]])
    net = Network.start(every[often], log_odds(hashes, toxic, every[often]) if len(often) else np.zeros(0, np.float32))
    rng = np.random.default_rng(6)
    m = {k: np.zeros_like(v) for k, v in net.p.items()}
    v = {k: np.zeros_like(x) for k, x in net.p.items()}
    epochs = max(epochs, -(-LEAST_STEPS // -(-len(texts) // BATCH)))  # a small sample is read more often
    step, total = 0, epochs * -(-len(texts) // BATCH)
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for a in range(0, len(order), BATCH):
            some = order[a : a + BATCH]
            data, off = text.buffers(pa.array([texts[i] for i in some], pa.large_string()))
            w = Words(data, off)
            ids = net.ids(w.hashes)
            ids = np.where(rng.random(len(ids)) < 0.1, 0, ids)
            x, gates = net.inputs(w, ids)
            index, length, doc = w.windows()
            logit = net.logits(gates, index, length)
            first = np.searchsorted(doc, np.arange(len(some)))
            top = np.array([f + int(np.argmax(logit[f:e])) for f, e in zip(first, [*first[1:], len(logit)], strict=True)])
            g = net.gradients(w, ids, x, gates, index[top], length[top], toxic[some])
            step += 1
            rate = 0.01 * min(1, step / 20) * (1 - 0.9 * step / total)
            for k, grad in g.items():
                if k in ("word", "char"):
                    grad = grad + 1e-6 * net.p[k]
                m[k] += 0.1 * (grad - m[k])
                v[k] += 0.01 * (grad * grad - v[k])
                net.p[k] -= (rate / (1 - 0.9**step)) * m[k] / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-7)
    return net


@dataclass(frozen=True)
class Model:
    network: Network | None
    shift: float

    def scores(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        docs = len(off) - 1
        if self.network is None:
            return np.full(docs, 1 / (1 + math.exp(-self.shift)))
        w = Words(data, off)
        _, gates = self.network.inputs(w, self.network.ids(w.hashes))
        index, length, doc = w.windows()
        logit = self.network.logits(gates, index, length).astype(np.float64)
        best = np.maximum.reduceat(logit, np.searchsorted(doc, np.arange(docs))) if docs else np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(best + self.shift, -500, 500)))


def is_held_out(modulus: int = 5) -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % modulus == 0


def fit(docs: DataFrame, labels: DataFrame, modulus: int = 5, sample: int = SAMPLE) -> Model:
    """Labels of held-out rows are never read into the model; null labels are left out."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)").where(~is_held_out(modulus)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    # lengths, not texts, meet the labels
    sizes = store.documents(docs).where(~is_held_out(modulus)).select("doc_id", F.length(F.coalesce("text", F.lit(""))).alias("n"))
    fitting = sizes.where(F.col("n") <= LONGEST).groupBy("doc_id").agg(F.count("*").alias("rows")).join(known, "doc_id")
    counts = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}
    pos, neg = counts.get(1, 0), counts.get(0, 0)
    share = math.log((pos + 0.5) / (neg + 0.5)) if pos + neg else 0.0
    least = []
    for y in (0, 1):
        ids = fitting.where(F.col("toxic") == y).select("doc_id", F.lit(y).alias("toxic"), F.xxhash64("doc_id").alias("h")).orderBy("h", "doc_id").limit(sample)
        least += [(r.doc_id, y, r.h) for r in ids.collect()]
    chosen: tuple[list[str], list[str]] = ([], [])
    if least:
        ids = F.broadcast(docs.sparkSession.createDataFrame(least, "doc_id long, toxic int, h long"))  # 2 * sample rows at most
        found = store.documents(docs).join(ids, "doc_id").where(F.length(F.coalesce("text", F.lit(""))) <= LONGEST)
        texts = found.groupBy("toxic", "h", "doc_id").agg(F.min(F.coalesce("text", F.lit(""))).alias("text")).collect()
        for r in sorted(texts, key=lambda r: (r.h, r.doc_id)):
            chosen[r.toxic].append(r.text)
    if not all(chosen):
        return Model(None, share)
    toxic = np.repeat([0, 1], [len(x) for x in chosen])
    return Model(train(chosen[0] + chosen[1], toxic), share - math.log(len(chosen[1]) / len(chosen[0])))


def score(docs: DataFrame, model: Model, modulus: int = 5) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(model)  # at most VOCABULARY and TRIGRAMS vectors
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(it):
        for part, data, off in text.slices(it):
            yield text.table(schema, part.column("doc_id"), sent.value.scores(data, off))

    rows = store.documents(docs).mapInArrow(run, "doc_id long, score double")
    return rows.select("doc_id", is_held_out(modulus).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def reject(docs: DataFrame, model: Model, column: str = "text") -> DataFrame:
    """``docs`` without the rows that the model finds toxic; all columns stay."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(it):
        for batch in it:
            where = batch.schema.get_field_index(column)
            for part, data, off in text.slices([batch.rename_columns(["text" if i == where else f"c{i}" for i in range(batch.num_columns)])]):
                keep = sent.value.scores(data, off) < 0.5
                yield part.filter(pa.array(keep)).rename_columns(batch.schema.names)

    return store.small_batches(docs).mapInArrow(run, docs.schema)
