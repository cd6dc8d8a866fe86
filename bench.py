"""Times of the headline operations; prints one JSON line.

Log lines are rendered from ``lineitem`` (one in eight with two lines of a stack trace),
then the index is built from those files and searched. ``events`` queries follow.
"""

from __future__ import annotations

import contextlib
import json
import os
import shutil
import sys
import tempfile
import time
from pathlib import Path
from statistics import median

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from emberlog.functions import times
from emberlog.operators import search, trace
from emberlog.operators.filters import QueryFilter
from emberlog.plans import events
from emberlog.sources import index

DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
FILES = 8


def session() -> SparkSession:
    s = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    return s


def render(spark: SparkSession, folder: str) -> int:
    """Log files of about 100 bytes a line; their size in bytes."""
    rows = spark.read.parquet(f"{DIR}/lineitem.parquet")
    n = F.monotonically_increasing_id()
    ms = F.lit(1_700_000_000_000) + F.col("i") * 37
    level = F.element_at(F.array(*[F.lit(x) for x in ("INFO", "INFO", "DEBUG", "INFO", "WARN", "INFO", "ERROR", "INFO")]), (F.col("i") % 8 + 1).cast("int"))
    line = F.concat(
        F.translate(times.format_iso(ms), "T", " "), F.lit("[http-nio-8080-exec-"), (F.col("i") % 40).cast("string"), F.lit("]["), level, F.lit("][com.example.shop.Service"),
        (F.col("i") % 25).cast("string"), F.lit("] - order "), F.col("l_orderkey").cast("string"), F.lit(" part "), F.col("l_partkey").cast("string"),
        F.when(F.col("i") % 20 == 0, " request start").when(F.col("i") % 20 == 19, " request end").otherwise(" working"),
        F.when(F.col("i") % 100_000 == 77, " circuit breaker open").otherwise(""),
        F.when(F.col("i") % 8 == 6, "\njava.lang.IllegalStateException: out of stock\n\tat com.example.shop.Stock.take(Stock.java:42)").otherwise(""),
    )
    out = rows.coalesce(1).select(n.alias("i"), "l_orderkey", "l_partkey").repartitionByRange(FILES, "i").sortWithinPartitions("i").select(line.alias("value"))
    out.write.text(folder)
    size = 0
    for i, p in enumerate(sorted(Path(folder).glob("part-*"))):
        size += p.stat().st_size
        p.rename(Path(folder) / f"app{i}.log")
    return size


def bytes_read(spark: SparkSession) -> int:
    """Bytes that this JVM has read from local files so far, but for vectored reads."""
    return sum(s.getBytesRead() for s in spark._jvm.org.apache.hadoop.fs.FileSystem.getAllStatistics())


def main() -> None:
    spark = session()
    work = tempfile.mkdtemp(prefix="bench-")
    found: dict[str, float] = {}

    def timed(name: str, run, times_: int = 3) -> None:
        took = []
        for _ in range(times_):
            t = time.perf_counter()
            run()
            took.append(time.perf_counter() - t)
        found[name] = round(median(took), 4)

    try:
        size = render(spark, f"{work}/logs")
        paths = [str(p) for p in sorted(Path(f"{work}/logs").glob("app*.log"))]
        timed("build_index", lambda: index.build(spark, paths, "default", f"{work}/index"), 2)
        ix = index.open_index(spark, f"{work}/index")

        def page(indexed=False, **given):
            q = QueryFilter.of(**given)

            def run():
                total, rows = search.search(ix.entries, ix.files, q, 0, 200, ix.postings if indexed else None, ix.counts)
                rows.collect()

            return run

        for name, given in {
            "page_all": {}, "page_info": {"level": "INFO"}, "page_error": {"level": "ERROR"}, "page_two_levels": {"level": "WARN,ERROR"},
            "page_error_range": {"level": "ERROR", "since": "2023-11-14 23:00", "until": "2023-11-15 01:00"}, "regex_source": {"source": r"app[0-4]\.log$"},
            "regex_logger": {"logger": r"service1\d$"}, "regex_message": {"message": r"order \d*77 "}, "regex_thread": {"thread": r"exec-1\d$"},
            "grep_literal": {"grep": "out of stock"}, "grep_regex": {"grep": r"stock\.java:4\d"},
        }.items():
            timed(name, page(**given))
        rare = ix.entries.orderBy("ts_millis").select("message").first().message.split()[1]
        # the rare literal again with the text index, and the bytes that both ways read
        timed("build_index_with_text", lambda: index.build(spark, paths, "default", f"{work}/index2", trigrams=True), 1)
        ix, read = index.open_index(spark, f"{work}/index2"), {}
        hadoop = spark.sparkContext._jsc.hadoopConfiguration()
        for name, indexed in (("grep_rare_scanned", False), ("grep_rare_indexed", True)):
            run = page(indexed, grep="breaker open")
            run()
            timed(name, run)
            hadoop.set("parquet.hadoop.vectored.io.enabled", "false")  # these are not counted
            before = bytes_read(spark)
            run()
            read[name] = bytes_read(spark) - before
            hadoop.unset("parquet.hadoop.vectored.io.enabled")
        spec = trace.boundary(f"order {rare} ", "request start", "request end", 10)
        timed("trace_boundary", lambda: trace.run(ix.entries, ix.files, spec).rows.collect())
        timed("trace_window", lambda: trace.run(ix.entries, ix.files, trace.window(f"order {rare} ", 10)).rows.collect())
        for name in ("q_page_offset", "q_grep_regex", "q_parse_default", "q_entries_from_text", "q_trace_boundary", "q_trace_window"):
            timed(name, lambda name=name: events.QUERIES[name](spark, DIR).write.format("noop").mode("overwrite").save(), 2)
        out = {"metric": "total seconds of the headline operations", "value": round(sum(found.values()), 3), "unit": "sec", "queries": found, "sf": os.path.basename(DIR).removeprefix("sf"), "log_mb": round(size / 1e6, 1), "build_mb_per_s": round(size / 1e6 / found["build_index"], 1), "bytes_read": read}
    finally:
        shutil.rmtree(work, ignore_errors=True)
    print(json.dumps(out))
    sys.stdout.flush()
    with contextlib.suppress(Exception):
        spark.stop()


if __name__ == "__main__":
    main()
