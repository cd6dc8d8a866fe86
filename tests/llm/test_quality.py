"""Attention over passages: gradients, held-out accuracy, odd rows."""

import random
import zlib

import numpy as np
import pytest

from emberlog.llm import quality

from .test_operators import corpus, make, words


def sample(n=240, seed=1):
    """Good texts, and texts of which one passage is spoilt."""
    r, rows = random.Random(seed), []
    for i in range(n):
        w = words(r.randrange(20, 300), 1000 + i)
        if i % 3 == 0:
            a = r.randrange(max(1, len(w) - 40))
            w[a : a + 40] = [x.upper() + "$$$" for x in w[a : a + 40]]
        rows.append((i, " ".join(w), int(i % 3 != 0)))
    return rows


def labels(spark, rows):
    return spark.createDataFrame([(i, y, 0) for i, y in rows], "doc_id long, quality int, toxic int")


def test_gradients_against_differences():
    b, good = quality.bags(["Hello wOrld 12 !!", "", "a b c " * 80, "x"]), np.array([1, 0, 1, 0])
    net = quality.Network()
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}

    def loss():
        x = net.logits(b)
        return np.mean(np.log1p(np.exp(x)) - good * x)

    rng, got = np.random.default_rng(0), net.gradients(b, good)
    for k, v in net.p.items():
        at = (b.trigrams[0], 3) if k == "char" else tuple(rng.integers(0, n) for n in v.shape)
        v[at] += 1e-3
        up = loss()
        v[at] -= 2e-3
        assert abs((up - loss()) / 2e-3 - got[k][at]) < 1e-5, k
        v[at] += 1e-3


def test_passages_against_a_plain_loop():
    """Weights of a document's passages add up to one, and other documents do not matter."""
    texts = [x for _, x in corpus() if x is not None]
    net = quality.Network()
    together = net.logits(quality.bags(texts))
    for x, logit in zip(texts, together, strict=True):
        b = quality.bags([x])
        h = net.encode(b)[1].astype(np.float64)
        n = len(x.translate({9: 32, 10: 32, 11: 32, 12: 32, 13: 32}).split(" ")) - x.translate({9: 32, 10: 32, 11: 32, 12: 32, 13: 32}).split(" ").count("")
        assert len(h) == max(1, -(-n // quality.PASSAGE))
        e = np.array([(np.tanh(k @ net.p["V"]) / (1 + np.exp(-(k @ net.p["U"])))) @ net.p["w"] for k in h])
        weight = np.exp(e) / np.exp(e).sum()
        assert abs(logit - ((weight @ h) @ net.p["o"] + net.p["ob"][0])) < 1e-3


@pytest.fixture(scope="module")
def fitted(spark):
    rows = sample()
    docs = make(spark, [(i, x) for i, x, _ in rows])
    return rows, docs, quality.fit(docs, labels(spark, [(i, y) for i, _, y in rows]))


def test_held_out_accuracy(fitted):
    rows, docs, model = fitted
    got = {r.doc_id: r for r in quality.score(docs, model).collect()}
    held = [(i, y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert {r.doc_id for r in got.values() if r.held_out} == {i for i, _ in held}
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())
    assert np.mean([got[i].predicted == y for i, y in held]) >= 0.95


def test_held_out_labels_and_other_columns_are_no_inputs(spark, fitted):
    rows, docs, model = fitted
    turned = [(i, 1 - y if zlib.crc32(str(i).encode()) % 3 == 1 else y) for i, _, y in rows]
    other = make(spark, [(i, x) for i, x, _ in rows]).replace("en", "de", "lang")
    again = quality.fit(other, labels(spark, turned))
    assert again.shift == model.shift and all((again.network.p[k] == v).all() for k, v in model.network.p.items())


def test_odd_rows(spark, fitted):
    model = fitted[2]
    got = quality.score(make(spark, corpus()), model).collect()
    assert len(got) == len(corpus()) and all(0 <= r.score <= 1 for r in got)
    blank = {r.score for r in got if r.doc_id in (300, 301, 302)}
    assert len(blank) == 1  # null, empty and blank texts
    assert quality.score(make(spark, [(1, "x")]).where("false"), model).collect() == []


def test_without_labels_of_both_classes(spark):
    docs = make(spark, [(i, f"text {i}") for i in range(9)])
    for rows, least, most in (([], 0.5, 0.5), ([(i, 1) for i in range(9)], 0.6, 1), ([(i, 0) for i in range(9)], 0, 0.4), ([(None, 1), (1, None)], 0.5, 0.5)):
        assert all(least <= r.score <= most for r in quality.score(docs, quality.fit(docs, labels(spark, rows))).collect())


def test_sample_is_bounded_by_rows_and_bytes(spark, fitted):
    rows, docs, _ = fitted
    known = labels(spark, [(i, y) for i, _, y in rows])
    small = quality.fit(docs, known, sample=20)
    assert small.network is not None
    # one text that alone exceeds the bytes is passed over, the others are read
    more = docs.unionByName(make(spark, [(9000, "x " * 50_000)]))
    assert quality.fit(more, known.unionByName(labels(spark, [(9000, 0)])), sample=20, most=60_000).network is not None
