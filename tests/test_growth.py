"""Work that grows with the input is dealt out, and done once."""

import re

import pytest
from emberlog.operators.custom import define
from emberlog.plans import events
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("parts", [1, 7])
def test_rendered_files_are_sorted_in_parts_of_bounded_size(spark, monkeypatch, parts):
    n = spark.read.parquet(f"{SF}/events.parquet").count()
    monkeypatch.setattr(events, "PART_ROWS", n + 1 if parts == 1 else -(-n // (parts - 1)) - 1)
    folder = events._rendered(spark, SF)
    got = {k: [r.value for r in spark.read.text(f"{folder}/app{k}.log", lineSep="\n").withColumn("i", F.monotonically_increasing_id()).orderBy("i").collect()] for k in (1, 2, 3)}
    want: dict[int, list[str]] = {1: [], 2: [], 3: []}
    for r in events.entries(spark, SF).orderBy("file_id", "line_no").collect():
        want[r.file_id] += [r.raw.rstrip("\n")] + (["  at " + r.logger.split(".")[2]] if r.event_id % 3 == 0 else [])
    assert got == want


def test_formats_are_detected_in_one_scan(spark):
    assert plan(events.q_detect_format(spark, SF)).count("FileScan parquet") == 1


def test_a_custom_layout_runs_its_expression_once_a_line(spark):
    assert len(re.findall(r"regexp_replace\([^\n]*\\A\(\?:", plan(events.q_custom_format(spark, SF)))) == 1


def test_steps_of_a_custom_layout_are_its_plain_column(spark):
    lines = ["02/Jan/2024 03:04:05 <info> t1 a.B|hello\x02\x03 | x\r\n", "31/Feb/2024 03:04:05 <info> t1 a.B|no such day", "02/Jan/2024 3 <info> t a|time of another shape", "nothing", "", "\n", None, "02/Jan/2024 03:04:05 <> t a|", "02/Jan/2024 23:59:60 <warn> t a|leap", "\x01\x02\x0102/Jan/2024 03:04:05 <warn> t a|m"]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, line string")
    for pattern, ts in ((r"(?<ts>\d\d/\w{3}/\d{4} [\d:]+) <(?<level>\w*)> (?<thread>\S+) (?<logger>[^ |]+)\|(?<message>.*)", "dd/MMM/yyyy HH:mm:ss"), (r"(?<ts>.*?) <(?<level>.*)", "dd/MMM/yyyy HH:mm[:ss]"), (r"(?<ts>\d\d).*", "HH")):
        x = define("own", None, pattern, ts, spark)
        assert x.with_header(rows, F.col("line"), "p").orderBy("i").collect() == rows.withColumn("p", x.parse(F.col("line"))).orderBy("i").collect()
