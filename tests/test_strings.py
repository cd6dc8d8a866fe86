import pytest
from pyspark.sql import functions as F

from emberlog.functions import strings
from emberlog.sources import discovery


def test_trigrams(spark):
    assert strings.trigrams("abcd") == ["abc", "bcd"]
    assert strings.trigrams("aaaaa") == ["aaa"]
    assert strings.trigrams("😀😀") == []
    rows = spark.createDataFrame([("abcd",), ("aaaaa",), ("ab",), ("",)], "x string")
    assert [r[0] for r in rows.select(strings.trigram_column(F.col("x"))).collect()] == [["abc", "bcd"], ["aaa"], [], []]


def test_only_ascii_is_folded(spark):
    rows = spark.createDataFrame([("AÀＡ",)], "x string")
    got = rows.select(strings.find_ignoring_case(F.col("x"), "aÀ"), strings.find_ignoring_case(F.col("x"), "aà"), strings.find_ignoring_case(F.col("x"), "ａ"), strings.find_ignoring_case(F.col("x"), "a.Ａ$")).first()
    assert list(got) == [True, False, False, True]


def test_literal_and_pattern_agree(spark):
    rows = spark.createDataFrame([("Error 12",), ("eRROR",), ("none",), (None,)], "x string")
    plain, pattern = rows.select(strings.find_ignoring_case(F.col("x"), "error")).collect(), rows.select(F.col("x").rlike("(?i)error")).collect()
    assert [r[0] for r in plain] == [r[0] for r in pattern]


def test_quoting(spark):
    literal = "a.b\\E[c"
    assert spark.createDataFrame([(literal,), ("aXb\\E[c",)], "x string").select(F.col("x").rlike(strings.quoted(literal))).collect() == [(True,), (False,)]


def test_preview_labels_levels(spark):
    df = spark.createDataFrame([("x" * 121 + "\r\n", "a.b.C", "/v/w/y.log", "FINER")], "line string, logger string, path string, level string")
    r = df.select(strings.preview(F.col("line")), strings.short_logger(F.col("logger")), strings.source_label(F.col("path"), F.lit(7)), strings.level_class(F.col("level"))).first()
    assert list(r) == ["x" * 117 + "...", "C", "w/y.log:7", "debug"]


def test_blank_lines(spark):
    rows = spark.createDataFrame([("",), (" \t\r",), ("\u3000",), ("a",)], "x string")
    assert [r[0] for r in rows.select(strings.is_blank_line(F.col("x"))).collect()] == [True, True, False, False]


def test_paths(spark):
    given = ["\\\\?\\C:\\logs", "\\\\?\\UNC\\host\\share", "/var/log"]
    want = ["C:\\logs", "\\\\host\\share", "/var/log"]
    assert [strings.plain_path(x) for x in given] == want
    rows = spark.createDataFrame([(x,) for x in given], "x string")
    assert [r[0] for r in rows.select(strings.path_column(F.col("x"))).collect()] == want


NAMES = {"application.log": True, "Server.LOG.1": True, "catalina.out": True, "app-1.log.2024": True, "app.log.zip": True, "app.log.gz": False, "x.LOG": True, "x.log.1": False, "x.bz2": False, "notes.txt": False, "localhost_access.log": True}


@pytest.mark.parametrize("name", NAMES)
def test_log_names(name):
    assert discovery.is_log_name(name) is NAMES[name]


def test_log_name_column(spark):
    rows = spark.createDataFrame([(n,) for n in NAMES], "n string").select("n", discovery.log_name_column(F.col("n")).alias("is_log")).collect()
    assert {r.n: r.is_log for r in rows} == NAMES


@pytest.mark.parametrize(("pattern", "name", "want"), [("a*b?c", "aXXbYc", True), ("a*b", "ab", True), ("*", "", True), ("a?", "a", False), ("*.log*", "x.lo", False), ("a*a*a", "aaXa", True)])
def test_glob(pattern, name, want):
    assert discovery.glob_match(pattern, name) is want


def test_discovery(spark, tmp_path):
    for p in ("b/app.log", "a.log", ".git/x.log", "node_modules/y.log", "c/readme.md", "c/z.log.gz"):
        (tmp_path / p).parent.mkdir(exist_ok=True)
        (tmp_path / p).write_text("")
    assert discovery.find_log_files(spark, str(tmp_path)) == [str(tmp_path / "a.log"), str(tmp_path / "b/app.log")]
    assert discovery.find_log_files(spark, str(tmp_path / "none")) == []
    assert discovery.browse(str(tmp_path))["directories"] == ["b", "c", "node_modules"]
