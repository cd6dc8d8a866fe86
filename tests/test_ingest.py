"""Entries put together in the scan against entries put together from numbered lines."""

import random

import pytest

from emberlog.operators import entries as assembly
from emberlog.operators.custom import define
from emberlog.sources import discovery, ingest, lines

OWN = define("own", None, r"(?<ts>\d{4}/\d\d/\d\d) (?<message>.*)", "yyyy/MM/dd")
PIECES = {
    "default": [b"2026-06-15 00:01:00.000[main][INFO][a.B] - one\n", b"2026-06-15 00:02:00.000[t][WARN][a.C] - two \xff\xfe bad\r\n", b"\n", b" \t\r\n", b"  at x.y(Z)\n", b"caf\xc3\xa9\n", b"\xe6\x97\xa5\xff\n", b"z" * 90 + b"\n"],
    "own": [b"2026/01/01 a\n", b"2026/13/01 b\n", b"more\n", b"\n", b"2026/02/03 \xc3\xa9\n", b"q" * 60 + b"\n"],
}


def both(spark, paths, layout):
    files = discovery.files_table(spark, paths)
    how = lambda rows: assembly.headed(rows, layout)
    one, skipped, _ = ingest.read(spark, files, paths, how)
    two, skipped2 = assembly.assemble(lines.read(spark, files, paths, how), layout, files)

    def told(found, skips):
        cast = [c if c not in ("raw", "message", "logger", "thread", "level") else found[c].cast("binary").alias(c) for c in sorted(found.columns)]
        return sorted(tuple(bytes(v) if isinstance(v, bytearray) else v for v in r) for r in found.select(*cast).collect()), sorted(tuple(r) for r in skips.collect())

    return told(one, skipped), told(two, skipped2)


@pytest.fixture
def small_splits(spark):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "400")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", old)


@pytest.mark.parametrize("kind", PIECES)
@pytest.mark.parametrize("seed", range(3))
def test_splits(spark, tmp_path, small_splits, kind, seed):
    """Splits without headers, junk before the first one, bytes that are no UTF-8, no line end at the end."""
    r = random.Random(seed)
    paths = []
    for i in range(4):
        weights = [r.choice([1, 1, 5]) for _ in PIECES[kind]]
        if i == 1:
            weights[0] = weights[1] = 0  # hardly any header: pieces of several splits go back to one entry
        text = b"".join(r.choices(PIECES[kind], weights, k=r.choice([0, 3, 40, 60])))
        text = text + (b"2026-06-15 00:03:00.000[t][INFO][a.D] - last" if i == 2 and kind == "default" else b"tail" if i == 3 else b"")
        (tmp_path / f"f{i}.log").write_bytes((PIECES[kind][0] if i == 1 and seed else b"") + text)
        paths.append(str(tmp_path / f"f{i}.log"))
    one, two = both(spark, paths, "default" if kind == "default" else OWN)
    assert one == two


def test_a_long_entry_over_many_splits(spark, tmp_path, small_splits):
    text = PIECES["default"][0] + b"".join(b"  at frame %d\n" % i for i in range(400)) + PIECES["default"][1]
    (tmp_path / "a.log").write_bytes(text)
    (one, skipped), two = both(spark, [str(tmp_path / "a.log")], "default")
    assert (one, skipped) == two and len(one) == 2 and not skipped


def test_small_batches(spark, tmp_path, monkeypatch):
    """Entries that go on from one batch of lines to the next."""
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        text = b"junk\n" + b"".join(p + b"  at x\n" * (i % 9) for i, p in enumerate([PIECES["default"][0]] * 30))
        (tmp_path / "a.log").write_bytes(text)
        one, two = both(spark, [str(tmp_path / "a.log")], "default")
        assert one == two and len(one[0]) == 30
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
