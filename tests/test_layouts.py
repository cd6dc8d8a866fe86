import random
import re

import pytest
from pyspark.sql import functions as F

from emberlog.functions.times import iso
from emberlog.operators.custom import TimePattern, define, scan_groups, try_layout
from emberlog.operators.layouts import LAYOUTS, LEVELS, parse, with_header

LINES = {
    "default": "2031-03-09 17:42:05.318[pool-4-thread-9][INFO][org.acme.Cart] - Cart opened - twice",
    "spring-boot": "2031-03-09 17:42:05.318  INFO 902 --- [           main] org.acme.Cart                         : Cart opened : twice",
    "logback": "2031-03-09 17:42:05,318 [main] INFO  org.acme.Cart - Cart opened",
    "iso8601": "2031-03-09T17:42:05.318+09:00 WARN [main] org.acme.Cart - Cart opened",
    "tomcat-juli": "09-Mar-2031 17:42:05.318 SEVERE [main] org.acme.Till.open Till opened",
}


def read(spark, layout, *lines):
    rows = spark.createDataFrame(list(enumerate(lines)), "i int, line string").select("i", parse(layout, F.col("line")).alias("p")).orderBy("i").collect()
    return [r.p for r in rows]


def test_each_layout_reads_its_own_lines_only(spark):
    for layout in LAYOUTS:
        got = dict(zip(LINES, read(spark, layout, *LINES.values()), strict=True))
        assert {k for k, v in got.items() if v} == {layout}
        assert iso(got[layout].ts_millis) == "2031-03-09T17:42:05.318"


def test_roles(spark):
    got = read(
        spark,
        "default",
        "2031-03-09 06:30:00.000[main][info][a.b] - x",
        "2031-03-09 06:30:00.000[a.b][INFO][pool-1-thread-2] - x",
        "2031-03-09 06:30:00.000[Basket][ERROR][main] - x",
        "2031-03-09 06:30:00.000[worker][INFO][Basket] - x",
        "2031-03-09 06:30:00.000[a.b][INFO][worker] - x",
        "2031-03-09 06:30:00.000[a.b.C][INFO][x[1][2]] - y] - z",
        "2031-03-09 06:30:00.000[][INFO][] - ",
        "2031-03-09 06:30:00.000[a][NOTE][b] - x",
        "2031-03-09 06:30:00.000 [a][INFO][b] - x",
    )
    assert [(p.thread, p.logger) if p else None for p in got] == [("main", "a.b"), ("pool-1-thread-2", "a.b"), ("main", "Basket"), ("worker", "Basket"), ("worker", "a.b"), ("x[1][2]", "a.b.C"), ("", ""), None, None]
    assert got[0].level == "INFO" and got[5].message == "y] - z"


def test_zones_and_orders(spark):
    got = read(
        spark,
        "iso8601",
        "2031-03-09T17:42:05.318Z INFO [t] l - m",
        "2031-03-09T17:42:05,318 [t] INFO l - m",
        "2031-03-09T17:42:05.318-0930 INFO [t] l - m",
        "2031-03-09T17:42:05.318+09 INFO [t] l - m",
        "2031-03-09T17:42:05.318+09:3 INFO [t] l - m",
        "2031-03-09T17:42:05.318 INFO t l - m",
        "2031-03-09T17:42:05.318 INFO [ t ]   l x  - m - n\r\n",
    )
    assert [bool(p) for p in got] == [True, True, True, False, False, False, True]
    assert (got[6].thread, got[6].logger, got[6].message) == ("t", "l x", "m - n")


def test_messages_may_be_empty_or_hold_odd_characters(spark):
    got = read(spark, "tomcat-juli", "09-Mar-2031 17:42:05.318 FINE [t] x.y", "09-Mar-2031 17:42:05.318 FINE [t] x.y  z", "09-Mrz-2031 17:42:05.318 FINE [t] x.y z")
    assert [p.message if p else None for p in got] == ["", " z", None]
    assert read(spark, "default", "2031-03-09 06:30:00.000[a][INFO][b] - x\u0085y\rz")[0].message == "x\u0085y\rz"


def test_any_character_may_stand_in_a_field(spark):
    line = "2031-03-09 06:30:00.000[a\x01\x02\x01b][INFO][c.\x02\x03d] - \x01\x02\x01 \x02"
    df = spark.createDataFrame([(line,)], "line string")
    for p in (read(spark, "default", line)[0], with_header(df, "default", F.col("line")).first().head):
        assert (p.thread, p.logger, p.message) == ("a\x01\x02\x01b", "c.\x02\x03d", "\x01\x02\x01 \x02")
    x = define("own", None, r"(?<ts>\d{4}) (?<thread>.*?) (?<message>.*)", "yyyy")
    assert df.select(x.group(F.lit("2031 a\x01\x02\x01b c"), "thread").alias("t")).first().t == "a\x01\x02\x01b"


def test_both_ways_to_parse_agree(spark):
    df = spark.createDataFrame([(x,) for x in [*LINES.values(), "no", ""]], "line string")
    for layout in LAYOUTS:
        both = with_header(df, layout, F.col("line")).select("head", parse(layout, F.col("line")).alias("other")).collect()
        assert all(r.head == r.other for r in both) and sum(r.head is not None for r in both) == 1


def test_group_scanner():
    assert scan_groups(r"(?<ts>\d+) (x)(?<level>\w+)").names == {"ts": 1, "level": 3}
    assert scan_groups(r"[(?<no>a-z[x]](?<ts>.)").names == {"ts": 1}
    assert scan_groups(r"\(?<no>\Q(?<no>\E(?<ts>.)(?<=a)(?<!b)").names == {"ts": 1}
    assert scan_groups(r"(?<ts>.)\Qabc").open_quote
    assert scan_groups("(?x)(?<ts>.) # end").comments


def test_custom_layout(spark):
    x = define("shop", None, r"^(?<ts>\d{4}/\d+/\d+ [\d:.]+) (?<level>\w+)(?: (?<thread>\S+))? : (?<message>.*)$", "yyyy/M/d HH:mm:ss.SSS", spark)
    lines = ["2026/06/5 01:02:03.004 warn t1 : hi\r\n", "2026/2/31 01:02:03.004 WARN : hi", "2026/1/1 24:00:00.000 INFO : x", "2026/1/1 00:00:60.000 INFO : x", "no", ""]
    rows = spark.createDataFrame(list(enumerate(lines)), "i int, l string").select("i", x.parse(F.col("l")).alias("p"), x.shape(F.col("l")).alias("s")).orderBy("i").collect()
    assert [(bool(r.p), r.s) for r in rows] == [(True, True), (False, True), (False, True), (False, True), (False, False), (False, False)]
    p = rows[0].p
    assert (iso(p.ts_millis), p.level, p.thread, p.logger, p.message) == ("2026-06-05T01:02:03.004", "WARN", "t1", "", "hi")


@pytest.mark.parametrize(
    ("pattern", "text", "want"),
    [
        ("dd/MMM/yyyy:HH:mm:ss Z", "09/Mar/2031:08:05:59 -0300", "2031-03-09T08:05:59.000"),
        ("dd/MMM/yyyy", "09/MAR/2031", None),
        ("yyyyMMdd'T'HHmmss", "20310309T080559", "2031-03-09T08:05:59.000"),
        ("yy-M-d h:mm a", "26-6-5 12:05 AM", "2026-06-05T00:05:00.000"),
        ("yyyy-MM-dd HH:mm:ss[.SSSSSS][X]", "2026-06-05 01:02:03.004567Z", "2026-06-05T01:02:03.004"),
        ("yyyy-MM-dd HH:mm:ss[.SSS]", "2026-06-05 01:02:03", "2026-06-05T01:02:03.000"),
        ("HH:mm", "10:20", None),
        ("yyyy-MM-dd", "2026-02-30", None),
        ("EEE MMM dd HH:mm:ss yyyy", "Sun Mar 09 08:05:59 2031", "2031-03-09T08:05:59.000"),
        ("yyyy-MM-dd HH:mm:ss.SSS", "2026-06-05 01:02:03.7", None),
    ],
)
def test_time_patterns(spark, pattern, text, want):
    got = spark.createDataFrame([(text,)], "t string").select(TimePattern(pattern).millis(F.col("t"))).first()[0]
    assert (None if got is None else iso(got)) == want


@pytest.mark.parametrize("bad", ["yyyy-MM-dd'", "bb", "yyyy]", "{yyyy}"])
def test_bad_time_patterns(bad):
    with pytest.raises(ValueError):
        TimePattern(bad)


@pytest.mark.parametrize("change", [{"id": "Shop"}, {"id": "default"}, {"id": "auto"}, {"pattern": "(.*)"}, {"pattern": "(?<ts>["}, {"timestamp": ""}, {"id": "x" * 41}, {"name": "a\tb"}])
def test_bad_definitions(spark, change):
    good = {"id": "shop", "name": "Shop", "pattern": "(?<ts>.*)", "timestamp": "yyyy-MM-dd"}
    define(**good, spark=spark)
    with pytest.raises(ValueError):
        define(**good | change, spark=spark)


def test_open_quotes_and_comments_still_match(spark):
    for pattern, line in ((r"(?<ts>\d{4}-\d\d-\d\d) \Qa.b", "2026-01-02 a.b"), ("(?x)(?<ts>\\d{4}-\\d\\d-\\d\\d) # day", "2026-01-02")):
        assert try_layout(spark, line, pattern, "yyyy-MM-dd")["matched"]


def test_try_reasons(spark):
    p = r"(?<ts>\S+) (?<level>\w+)"
    assert try_layout(spark, "x", p, "yyyy-MM-dd")["reason"] == "the line does not match the pattern"
    assert "shape" in try_layout(spark, "x info", p, "yyyy-MM-dd")["reason"]
    assert "no such time" in try_layout(spark, "2026-02-31 info", p, "yyyy-MM-dd")["reason"]
    assert "lacks" in try_layout(spark, "10:20 info", p, "HH:mm")["reason"]
    assert try_layout(spark, "x info", p, "") == {"timestamp_checked": False, "matched": True, "timestamp": "x", "level": "INFO", "thread": "", "logger": "", "message": ""}
    with pytest.raises(ValueError):
        try_layout(spark, "", p, "")


_D, _C, _Z = r"\d{4}-\d{2}-\d{2}", r"\d{2}:\d{2}:\d{2}", r"(?:[Zz]|[+-]\d{2}:*\d{2})?+"
_B = r" *+(?:\[(?P<t>[^\]]*+)\] *+(?P<v>[^ ]++)|(?!\[)(?P<v2>[^ ]++) *+\[(?P<t2>[^\]]*+)\]) *+(?P<l>.*?) - (?P<m>.*)"
#: The layouts as whole regular expressions, the plain version.
PLAIN = {
    "default": rf"{_D} {_C}\.\d{{3}}\[(?P<t>[^\]]*+)\]\[(?P<v>[^\]]*+)\]\[(?P<l>.*?)\] - (?P<m>.*)",
    "spring-boot": rf"{_D}[ T]{_C}\.\d{{3}}(?=[ +\-Zz]){_Z} *+(?P<v>[^ ]++) *+\d*+ *+--- *+\[(?P<t>[^\]]*+)\] *+(?P<l>.*?) : (?P<m>.*)",
    "logback": rf"{_D} {_C}[.,]\d{{3}}(?= ){_B}",
    "iso8601": rf"{_D}T{_C}[.,]\d{{3}}(?=[ +\-Zz]){_Z}{_B}",
    "tomcat-juli": rf"\d{{2}}-(?:Mar)-\d{{4}} {_C}\.\d{{3}}(?= ) *+(?P<v>[^ ]++) *+\[(?P<t>[^\]]*+)\] *+(?P<l>[^ ]++)(?: (?P<m>.*))?",
}


def _plain(layout, line):
    m = re.fullmatch(PLAIN[layout], re.sub(r"[\r\n]+\Z", "", line), re.S | re.A)
    if not m:
        return None
    g = m.groupdict()
    level = (g["v"] or g.get("v2") or "").upper()
    if level not in LEVELS:
        return None
    thread = g["t"] if g["t"] is not None else g["t2"]
    blank = "".join(map(chr, range(33)))
    outer = [thread, g["l"]] if layout == "default" else [thread.strip(blank), g["l"] if layout == "tomcat-juli" else g["l"].strip(blank)]
    return sorted(outer), level, g["m"] or ""


def test_changed_lines_are_read_as_the_plain_expressions_say(spark):
    r = random.Random(11)
    bits = [" ", "  ", "[", "]", "][", "] - ", " - ", " : ", "---", "INFO", "\t", "\x00", "é", "😀", "Z", "+09:00", "+09::00", ".", ",", "1", "\r", "\n", "main"]
    lines = list(LINES.values())
    for _ in range(4000):
        x = r.choice(list(LINES.values()))
        for _ in range(r.randint(1, 3)):
            i, cut = r.choice([r.randrange(len(x) + 1), 22 + r.randrange(12)]), r.choice([0, 0, 1, 2])
            x = x[:i] + (r.choice(bits) if cut < 2 else "") + x[i + cut :]
        if "Mar" in x or "-03-" in x:
            lines.append(x)
    df = spark.createDataFrame([(x,) for x in lines], "line string")
    for layout in LAYOUTS:
        found = 0
        for row in with_header(df, layout, F.col("line")).collect():
            p = row.head
            got = None if p is None else (sorted([p.thread, p.logger]), p.level, p.message)
            want = _plain(layout, row.line)
            found += want is not None
            # a month's name in other case is one too, and only the Spark side looks it up
            assert got == want or (layout == "tomcat-juli" and "-Mar-" not in row.line), (layout, row.line)
        assert found > 50
