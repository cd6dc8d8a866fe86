"""Quality by attention-based multiple-instance learning in numpy.

A document is a bag of passages, ``PASSAGE`` words each and what is left in the last; its
label belongs to the bag. Every passage is encoded: the mean of its words' hashed byte
trigrams (learned vectors, case kept) and some shares of the passage (capitals, digits,
other signs, word lengths, words said before or just now) go through one hidden layer to h. A gate
learned from the documents' labels weighs the passages,

    weight ~ softmax over the document of w . (tanh(V h) * sigmoid(U h)),

and the weighted mean of h gives the document's logit. All passages of all documents are
scored, where they lie; no text is shuffled.

Training runs on the driver over a bounded sample of labelled rows outside the held-out
part: the least by a hash of doc_id, ``SAMPLE`` of each class at most and ``BYTES`` of text
in all at most (a document that alone exceeds them is passed over). The bias is then moved
from the sample's class shares to those of all labelled training rows. Labels, lang, source
and doc_id are no inputs of a score.

Null and blank texts have one empty passage. Without labels of both classes every document
gets the share of good labels (0.5 without any). Rows are scored one by one, so equal rows
have equal scores; of several labels of a doc_id the greatest counts; a null doc_id counts
as the text '' in the split. Texts of any length are read whole. Extra columns are ignored,
and an empty table gives no rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import store, text

PASSAGE = 64
SAMPLE, BYTES = 1500, 24_000_000
TRIGRAMS, CHAR, SHARES, HIDDEN, GATE = 4096, 12, 11, 24, 12
EPOCHS, BATCH, LEAST_STEPS = 6, 32, 300
_KIND = np.zeros((256, 4), np.float32)  # capital, digit, other ASCII sign, byte of another letter
_KIND[65:91, 0] = 1
_KIND[48:58, 1] = 1
_KIND[[b for b in range(33, 127) if not chr(b).isalnum()], 2] = 1
_KIND[128:, 3] = 1


class Bags:
    """Distinct words of a slice, and the passages of its documents."""

    def __init__(self, data: np.ndarray, off: np.ndarray):
        w = text.words(data, off)
        _, at, self.index = np.unique(text.span_hashes(data, w.starts, w.ends), return_index=True, return_inverse=True)
        starts, size = w.starts[at], (w.ends - w.starts)[at]
        self.size, self.ends = size, np.cumsum(size)
        pos = np.arange(int(size.sum())) - np.repeat(self.ends - size, size) + np.repeat(starts, size)
        if len(pos):
            raw, last = data.astype(np.uint32), np.repeat(starts + size - 1, size)
            left = np.where(pos > np.repeat(starts, size), raw[np.maximum(pos - 1, 0)], np.uint32(256))
            right = np.where(pos < last, raw[np.minimum(pos + 1, len(raw) - 1)], np.uint32(257))
            h = (left * np.uint32(0x9E3779B1)) ^ ((raw[pos] + np.uint32(3)) * np.uint32(0x85EBCA6B)) ^ (right * np.uint32(0xC2B2AE35))
            h ^= h >> np.uint32(13)
            h *= np.uint32(0x2C1B3C6D)
            self.trigrams = ((h >> np.uint32(11)) % np.uint32(TRIGRAMS)).astype(np.int64)
            kinds = np.add.reduceat(_KIND[data[pos]], self.ends - size, axis=0)
        else:
            self.trigrams, kinds = np.zeros(0, np.int64), np.zeros((0, 4), np.float32)
        n = np.diff(w.first)
        passages = np.maximum(1, -(-n // PASSAGE))
        self.first = np.concatenate([[0], np.cumsum(passages)])
        self.doc = np.repeat(np.arange(len(n)), passages)
        begin = w.first[:-1][self.doc] + (np.arange(len(self.doc)) - self.first[:-1][self.doc]) * PASSAGE
        self.words = np.minimum(PASSAGE, w.first[1:][self.doc] - begin)
        self.passage = np.repeat(np.arange(len(self.words)), self.words)
        self.shares = self._shares(kinds, size)

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Sums over each passage's words of values of distinct words."""
        out = np.zeros((len(self.words), values.shape[1]), np.float32)
        full = np.flatnonzero(self.words > 0)
        if len(full):
            out[full] = np.add.reduceat(values[self.index], (np.cumsum(self.words) - self.words)[full], axis=0)
        return out

    def _shares(self, kinds: np.ndarray, size: np.ndarray) -> np.ndarray:
        out = np.zeros((len(self.words), SHARES), np.float32)
        if not len(self.index):
            return out
        signs = kinds[:, 2:3]
        got = self.sums(np.concatenate([kinds, size[:, None], (size[:, None] > 12), (signs > 0), (signs >= 2), (signs == size[:, None])], 1).astype(np.float32))
        n, letters = np.maximum(self.words, 1)[:, None], np.maximum(got[:, 4:5], 1)
        out[:, :4] = got[:, :4] / letters
        out[:, 4] = np.minimum(got[:, 4] / n[:, 0] / 16, 2)
        out[:, 5:9] = got[:, 5:9] / n
        # words of the passage that it has said before
        pair = np.sort(self.passage * np.int64(len(self.size)) + self.index)
        again = np.bincount(pair[1:][pair[1:] == pair[:-1]] // len(self.size), minlength=len(self.words))
        out[:, 9] = again / n[:, 0]
        same = (self.index[1:] == self.index[:-1]) & (self.passage[1:] == self.passage[:-1])
        out[:, 10] = np.bincount(self.passage[1:][same], minlength=len(self.words)) / n[:, 0]
        return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -50, 50)))


def softmax(e: np.ndarray, first: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Weights of passages within their documents; every document has a passage."""
    e = np.exp(e - np.maximum.reduceat(e, first[:-1])[doc])
    return e / np.add.reduceat(e, first[:-1])[doc]


class Network:
    def __init__(self):
        rng = np.random.default_rng(7)
        n = lambda *s, scale: (rng.standard_normal(s) * scale).astype(np.float32)
        self.p = {"char": n(TRIGRAMS, CHAR, scale=0.3), "x": n(CHAR + SHARES, HIDDEN, scale=0.4), "xb": np.zeros(HIDDEN, np.float32), "V": n(HIDDEN, GATE, scale=0.3), "U": n(HIDDEN, GATE, scale=0.3), "w": n(GATE, scale=0.3), "o": n(HIDDEN, scale=0.3), "ob": np.zeros(1, np.float32)}

    def encode(self, b: Bags) -> tuple[np.ndarray, np.ndarray]:
        """Inputs of each passage, and h."""
        mean = np.add.reduceat(self.p["char"][b.trigrams], b.ends - b.size, axis=0) / b.size[:, None].astype(np.float32) if len(b.size) else np.zeros((0, CHAR), np.float32)
        x = np.concatenate([b.sums(mean) / np.maximum(b.words, 1)[:, None].astype(np.float32), b.shares], 1)
        return x, np.tanh(x @ self.p["x"] + self.p["xb"])

    def attend(self, h: np.ndarray, first: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, ...]:
        """Both sides of the gate, the weights, the weighted passages, the logits."""
        t, s = np.tanh(h @ self.p["V"]), sigmoid(h @ self.p["U"])
        weight = softmax((t * s) @ self.p["w"], first, doc)
        z = np.add.reduceat(weight[:, None] * h, first[:-1], axis=0)
        return t, s, weight, z, z @ self.p["o"] + self.p["ob"][0]

    def logits(self, b: Bags) -> np.ndarray:
        return self.attend(self.encode(b)[1], b.first, b.doc)[4] if len(b.first) > 1 else np.zeros(0)

    def gradients(self, b: Bags, good: np.ndarray) -> dict[str, np.ndarray]:
        p = self.p
        x, h = self.encode(b)
        t, s, weight, z, logit = self.attend(h, b.first, b.doc)
        d = ((sigmoid(logit) - good) / len(good)).astype(np.float32)
        g = {"o": z.T @ d, "ob": d.sum(keepdims=True)}
        dz = (d[:, None] * p["o"])[b.doc]
        share = (dz * h).sum(1)
        de = weight * (share - np.add.reduceat(weight * share, b.first[:-1])[b.doc])
        g["w"] = (t * s).T @ de
        dt, ds = (de[:, None] * p["w"] * s) * (1 - t * t), (de[:, None] * p["w"] * t) * s * (1 - s)
        g["V"], g["U"] = h.T @ dt, h.T @ ds
        da = (weight[:, None] * dz + dt @ p["V"].T + ds @ p["U"].T) * (1 - h * h)
        g["x"], g["xb"] = x.T @ da, da.sum(0)
        dx = (da @ p["x"].T)[:, :CHAR] / np.maximum(b.words, 1)[:, None].astype(np.float32)
        words = np.zeros((len(b.size), CHAR), np.float32)
        np.add.at(words, b.index, dx[b.passage])
        g["char"] = np.zeros_like(p["char"])
        np.add.at(g["char"], b.trigrams, np.repeat(words / np.maximum(b.size, 1)[:, None].astype(np.float32), b.size, axis=0))
        return g


def bags(texts: list[str]) -> Bags:
    return Bags(*text.buffers(pa.array(texts, pa.large_string())))


def train(texts: list[str], good: np.ndarray, epochs: int = EPOCHS) -> Network:
    """Adam on batches of documents; the same sample gives the same network."""
    good, net, rng = np.asarray(good, np.float32), Network(), np.random.default_rng(8)
    steps = -(-len(texts) // BATCH)
    epochs = max(epochs, -(-LEAST_STEPS // steps))  # a small sample is read more often
    m, v = ({k: np.zeros_like(x) for k, x in net.p.items()} for _ in range(2))
    batches = [(bags([texts[i] for i in some]), good[some]) for some in np.array_split(rng.permutation(len(texts)), steps)]
    step = 0
    for _ in range(epochs):
        for k in rng.permutation(len(batches)).tolist():
            step += 1
            rate = 0.01 * min(1, step / 20) * (1 - 0.9 * step / (epochs * steps))
            for name, grad in net.gradients(*batches[k]).items():
                grad = grad + (1e-5 if name in ("x", "V", "U", "o") else 1e-6) * net.p[name]
                m[name] += 0.1 * (grad - m[name])
                v[name] += 0.01 * (grad * grad - v[name])
                net.p[name] -= (rate / (1 - 0.9**step)) * m[name] / (np.sqrt(v[name] / (1 - 0.99**step)) + 1e-7)
    return net


@dataclass(frozen=True)
class Model:
    network: Network | None
    shift: float

    def scores(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        if self.network is None:
            return np.full(len(off) - 1, 1 / (1 + math.exp(-self.shift)))
        x = np.clip(self.network.logits(Bags(data, off)).astype(np.float64) + self.shift, -500, 500)
        return 1 / (1 + np.exp(-x))


def is_held_out(modulus: int = 3, rest: int = 1) -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % modulus == rest


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, most: int = BYTES) -> Model:
    """Labels of held-out rows are never read into the model; null labels are left out."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("good")).where("doc_id is not null and good in (0, 1)").where(~is_held_out()).groupBy("doc_id").agg(F.max("good").alias("good"))
    counts = {r.good: r["count"] for r in known.groupBy("good").count().collect()}
    many = [counts.get(0, 0), counts.get(1, 0)]
    share = math.log((many[1] + 0.5) / (many[0] + 0.5)) if sum(many) else 0.0
    # lengths, not texts, meet the labels
    sizes = store.documents(docs).where(~is_held_out()).groupBy("doc_id").agg(F.min(F.octet_length(F.coalesce("text", F.lit("")))).alias("n")).join(known, "doc_id")
    chosen: list[tuple[int, int, int]] = []
    for y in (0, 1):
        left = most // 2
        for r in sizes.where(F.col("good") == y).select("doc_id", "n", F.xxhash64("doc_id").alias("h")).orderBy("h", "doc_id").limit(sample).collect():  # numbers of at most ``sample`` rows
            if r.n > most // 2:
                continue
            left -= r.n
            if left < 0:
                break
            chosen.append((r.doc_id, y, r.n))
    if len({y for _, y, _ in chosen}) < 2:
        return Model(None, share)
    ids = F.broadcast(docs.sparkSession.createDataFrame(chosen, "doc_id long, good int, n int"))  # 2 * sample rows at most
    found = store.documents(docs).join(ids, "doc_id").where(F.octet_length(F.coalesce("text", F.lit(""))) == F.col("n"))
    rows = found.groupBy("good", "doc_id").agg(F.min(F.coalesce("text", F.lit(""))).alias("text")).orderBy("doc_id").collect()
    texts, good = [r.text for r in rows], np.array([r.good for r in rows])
    return Model(train(texts, good), share - math.log(good.sum() / (len(good) - good.sum())))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # TRIGRAMS vectors and some small matrices
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(it):
        for part, data, off in text.slices(it):
            yield text.table(schema, part.column("doc_id"), sent.value.scores(data, off))

    rows = store.documents(docs).mapInArrow(run, "doc_id long, score double")
    return rows.select("doc_id", is_held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
