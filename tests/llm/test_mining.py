"""Mined negatives against all scores."""

import math
import random

import numpy as np
import pytest

from emberlog.llm import mining

SCHEMA = "vec_id long, embedding array<float>, label int, score double, x string, rank int, dims string"


def plain(rows, every, k=5, low=80):
    """By all pairs in Python integers."""
    live = {}
    for vec_id, x, label in rows:
        if vec_id is None or label is None or not x or any(v is None or not math.isfinite(v) for v in x):
            continue
        label = (label + 1) % 10 if vec_id % 7 == 0 else label
        live[vec_id, label, tuple(math.floor(256 * float(np.float32(v))) for v in x)] = None
    out = []
    for a, mine, q in live:
        if a % every:
            continue
        scored = [(-sum(map(int.__mul__, q, x)), i, label) for i, label, x in live if len(x) == len(q)]
        positives = sorted({(s, i) for s, i, label in scored if label == mine and i != a})[:k]
        for s, p in positives:
            near = sorted({(t, i) for t, i, label in scored if label != mine and low * -s <= 100 * -t <= 100 * -s})[:k]
            out += [(a, p, rank, i, -s, -t) for rank, (t, i) in enumerate(near, 1)]
    return sorted(out)


def table(spark, rows):
    return spark.createDataFrame([(i, x, label, 0.5, "x", 1, "d") for i, x, label in rows], SCHEMA)


def vectors(n, dims, seed, labels=3):
    r = np.random.default_rng(seed)
    centres = r.standard_normal((5, dims)) / math.sqrt(dims)
    return [(i, [float(np.float32(v)) for v in centres[i % 5] + r.standard_normal(dims) * 0.4 / math.sqrt(dims)], int(r.integers(labels))) for i in range(n)]


def mined(spark, rows, **how):
    return sorted(map(tuple, mining.mine(table(spark, rows), **how).collect()))


@pytest.mark.parametrize("block", [mining.BLOCK, 3])
def test_all_pairs(spark, block):
    rows = vectors(400, 16, 1)
    assert mined(spark, rows, every=20, block=block) == plain(rows, 20)


def test_odd_rows(spark):
    """Nulls, other lengths, zero vectors, ties, repeats, one id with two vectors, a hot vector."""
    rows = vectors(80, 8, 2)
    rows += [(80 + i, rows[0][1], i % 4) for i in range(60)]  # one vector, many ids and labels
    rows += [rows[0], rows[0], rows[5], (20, rows[3][1], 1), (200, [0.0] * 8, 1), (201, [0.0] * 8, 2)]
    rows += [(220, None, 1), (240, [], 1), (260, [1.0, None] * 4, 1), (280, [math.nan] * 8, 1), (300, [math.inf] * 8, 1), (320, rows[1][1], None), (None, rows[0][1], 1)]
    rows += [(340 + i, [0.5, 0.25, i / 8], i % 2) for i in range(12)]
    random.Random(3).shuffle(rows)
    assert mined(spark, rows, every=20) == plain(rows, 20)


def test_negative_scores_and_few_rows(spark):
    rows = [(20, [1.0, 0.0], 1), (1, [-1.0, 0.0], 1), (2, [-1.0, 0.1], 2), (3, [0.5, 0.0], 1), (4, [0.45, 0.0], 2), (5, [0.0, 1.0], 1), (6, [0.0, -1.0], 2)]
    assert mined(spark, rows, every=20) == plain(rows, 20) == [(20, 3, 1, 4, 32768, 29440), (20, 5, 1, 6, 0, 0)]


def test_large_components(spark):
    """Beyond 53 bits scores are exact; vectors that could leave 62 bits take no part."""
    big = [(i, [float(2**20 + i), 3.0, float(2**21 - i)], i % 2) for i in range(12)]
    assert mined(spark, big, every=4) == plain(big, 4)
    assert mined(spark, [*big, (40, [1e30, 1.0, 1.0], 1), (44, [3e38] * 3, 0)], every=4) == plain(big, 4)


def test_empty(spark):
    assert mined(spark, []) == [] and mined(spark, [(1, [1.0], 1)]) == [] and mined(spark, [(100, [1.0], 1)]) == []


def test_bounds_hold():
    r = np.random.default_rng(4)
    x, q = r.integers(-300, 300, (500, 24)), r.integers(-300, 300, (7, 24))
    cells = mining.Cells(x.min(0), x.max(0))
    tables, above = cells.tables(q)
    for j in range(len(q)):
        lower = mining.bounds(tables[j], cells.codes(x))
        assert (lower <= x @ q[j]).all() and (x @ q[j] <= lower + above[j]).all()
