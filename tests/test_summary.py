"""Totals and pages from counts against those of a scan."""

import random

import pytest

from emberlog.operators import postings, search, summary
from emberlog.operators.filters import QueryFilter

SCHEMA = "file_id long, line_no long, ts_millis long, level string, logger string, thread string, message string, raw string"


@pytest.fixture(scope="module", params=[summary.SMALL, 3], ids=["held", "summed"])
def stored(request, spark, tmp_path_factory):
    """Blocks of four rows in several partitions, with many rows of one time; the summary held or summed by Spark."""
    r, at = random.Random(1), str(tmp_path_factory.mktemp("summary"))
    rows = [(r.choice([1, 1, 1, 2, 3]), i, r.choice([1000, r.randrange(3000)]), r.choice(["INFO"] * 6 + ["WARN", "ERROR"]), "l", "t", "m", "r") for i in range(300)]
    df = spark.createDataFrame(rows, SCHEMA).repartitionByRange(3, "ts_millis", "file_id").sortWithinPartitions("ts_millis", "file_id", "line_no")
    shift, postings.SHIFT = postings.SHIFT, 2
    postings.numbered(df).write.parquet(f"{at}/rows")
    postings.SHIFT = shift
    kept = spark.read.parquet(f"{at}/rows")
    summary.write(summary.build(kept), f"{at}/counts")
    files = spark.createDataFrame([(i, f"/logs/app{i}.log") for i in (1, 2, 3)], "file_id long, path string")
    return kept, files, summary.Summary(spark.read.parquet(f"{at}/counts"), request.param)


QUERIES = [QueryFilter(), QueryFilter(levels=frozenset({"ERROR"})), QueryFilter(levels=frozenset({"WARN", "ERROR"})), QueryFilter(since=700, until=1000), QueryFilter(since=1001), QueryFilter(until=999, levels=frozenset({"INFO"})), QueryFilter(source="app[23]"), QueryFilter(source="app1", since=1000, until=1000), QueryFilter(levels=frozenset({"NONE"})), QueryFilter(source="nothing"), QueryFilter(since=9999)]


@pytest.mark.parametrize("n", range(len(QUERIES)))
def test_pages_equal_those_of_a_scan(stored, n):
    kept, files, counts = stored
    for offset, limit in ((0, 7), (11, 9), (10_000, 5), (3, 0)):
        got, want = (search.search(kept, files, QUERIES[n], offset, limit, counts=c) for c in (counts, None))
        assert got[0] == want[0]
        assert [tuple(r) for r in got[1].collect()] == [tuple(r) for r in want[1].collect()]


def test_other_conditions_are_scanned(stored):
    kept, files, counts = stored
    assert not summary.answers(QueryFilter(grep="x")) and not summary.answers(QueryFilter(thread="x")) and summary.answers(QueryFilter(source="x"))
    assert search.search(kept, files, QueryFilter(message="^m$"), 0, 5, counts=counts)[0] == 300


def test_a_page_reads_few_blocks(stored):
    kept, files, counts = stored
    found = counts.of(QueryFilter(), kept, files)
    rows, skipped = found.page(100, 5, found.total())
    assert rows.count() <= 12 and 0 <= skipped < 4


def test_bounds(stored):
    kept, _, counts = stored
    assert tuple(counts.bounds().first()) == tuple(search.bounds(kept).first())


def test_nothing_stored(spark, stored):
    kept, files, _ = stored
    none = summary.Summary(summary.build(kept.where("false")))
    total, rows = search.search(kept.where("false"), files, QueryFilter(since=5), 0, 5, counts=none)
    assert total == 0 and rows.count() == 0 and tuple(none.bounds().first()) == (0, None, None)
