"""Memory of a worker, whatever a batch holds."""

import collections
import re
import tracemalloc
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from emberlog.llm import pitman, store, text, units


def test_a_batch_of_texts_takes_little_memory():
    words = [f"word{i % 977}" for i in range(40_000)]
    one = " ".join(w + "." * (i % 9 == 8) for i, w in enumerate(words))
    batch = pa.RecordBatch.from_pydict({"text": [one[k : k + 4000] for k in range(0, len(one), 4000)] * 12})  # 4 MB
    tracemalloc.start()
    for _, data, off in text.slices([batch]):
        u = units.Units(data, off)
        i, j = u.spans(units.MIN_WORDS, True)
        u.digest(i, j, 0)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20 << 20, peak


def own_mb() -> float:
    return int(re.search(r"\nPss_Anon:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text())[1]) / 1024


def test_a_worker_gives_back_what_a_task_held():
    kept = []

    def run(it):
        yield from it
        held = [np.ones(12_000) for _ in range(1500)]  # too small to be mapped one by one
        kept.append(np.ones(12_000))  # what stays lies above them
        assert len(held) * held[0].nbytes > 140e6

    store.give_back()
    before = own_mb()
    assert list(store.lean(run)(iter("ab"))) == ["a", "b"]
    assert own_mb() < before + 40


@pytest.mark.parametrize("held", [pitman.HELD, 50])
def test_words_are_counted_as_rows_of_arrays(spark, monkeypatch, held):
    monkeypatch.setattr(pitman, "HELD", held)
    monkeypatch.setattr(pitman, "SLICE_BYTES", 1000)
    texts = [" ".join(f"w{i * k % 601}" for k in range(i)) for i in range(120)] + ["", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = pitman.word_counts(docs)
    assert "HashAggregate" not in got._jdf.queryExecution().executedPlan().toString()
    names = sorted({w for x in texts for w in (x or "").split()})
    h = text.word_hashes(*(lambda data, off: (data, text.words(data, off)))(*text.buffers(pa.array(names)))).view(np.int64)
    want = collections.Counter(w for x in texts for w in (x or "").split())
    rows = got.collect()
    assert len(rows) == len(want) + 1
    assert {r.w: r.c for r in rows} == {int(x): want[w] for x, w in zip(h, names, strict=True)} | {int(pitman.END.view(np.int64)): len(texts)}


@pytest.mark.parametrize("held", [pitman.HELD, 20])
def test_pairs_of_words_are_counted_as_rows_of_arrays(spark, monkeypatch, held):
    monkeypatch.setattr(pitman, "HELD", held)
    r = np.random.default_rng(1)
    rows, want, pairs = [], collections.Counter(), set()
    for k in range(6):
        u, w = np.unique(np.stack([r.integers(-40, 40, 90), r.integers(-40, 40, 90)]), axis=1)
        on = np.array([(x, y) not in pairs for x, y in zip(u.tolist(), w.tolist(), strict=True)])
        u, w, c = u[on], w[on], r.integers(1, 4, on.sum())
        pairs |= set(zip(u.tolist(), w.tolist(), strict=True))
        want.update({("ones", 0): int((c == 1).sum()), ("twos", 0): int((c == 2).sum())})
        rows.append((k % 2, *(bytearray(pitman.packed(x)) for x in (u, w, c))))
    want.update(("after", u) for u, _ in pairs)
    want.update(("before", w) for _, w in pairs)
    got = pitman.word_pairs(spark.createDataFrame(rows, "block long, u binary, w binary, c binary").repartition(2))
    assert "HashAggregate" not in got._jdf.queryExecution().executedPlan().toString()
    out = got.collect()
    assert len(out) == len({x for p in pairs for x in p})
    have = collections.Counter({(k, x.code): x[k] for x in out for k in ("after", "before")}) + collections.Counter({(k, 0): sum(x[k] for x in out) for k in ("ones", "twos")})
    assert have == want
