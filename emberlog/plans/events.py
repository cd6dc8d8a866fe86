"""The engine's operators over the driver's tables, each with its SQL.

``events`` becomes log entries: a file for each third of the users, a thread for each user.
Every query takes the whole table it names.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import strings, times
from ..operators import entries as assembly
from ..operators import postings, search, summary, trace
from ..operators.custom import define
from ..operators.filters import QueryFilter, same_context
from ..operators.layouts import LAYOUTS, with_header
from ..sources import discovery, index, scratch
from ..sources.discovery import log_name_column
from ..sources.paths import Paths

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

LEVEL_OF = {"click": "INFO", "error": "ERROR", "purchase": "WARN", "signup": "DEBUG", "view": "TRACE"}
_CASES = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in LEVEL_OF.items())
#: The entries in SQL.
E = f"""WITH ev AS (SELECT event_id, ts, user_id % 3 + 1 AS file_id, event_id + 1 AS line_no, CAST(epoch_us(ts) // 1000 AS BIGINT) AS ts_millis,
  'com.example.' || event_type || '.Handler' AS logger, CASE event_type {_CASES} END AS level, 'exec-' || user_id AS thread,
  event_type || ' ' || props AS message FROM events),
entries AS (SELECT *, '/logs/app' || file_id || '.log' AS source, strftime(ts, '%Y-%m-%d %H:%M:%S.%g') AS shown,
  strftime(ts, '%Y-%m-%d %H:%M:%S.%g') || '[' || thread || '][' || level || '][' || logger || '] - ' || message || chr(10) AS raw FROM ev) """


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spaced(millis: Column) -> Column:
    return F.translate(times.format_iso(millis), "T", " ")


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    level = F.element_at(F.create_map(*[F.lit(x) for kv in LEVEL_OF.items() for x in kv]), F.col("event_type"))
    micros = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col("ts").cast("timestamp_ntz"))
    out = ev.select(
        "event_id",
        (F.col("user_id") % 3 + 1).alias("file_id"),
        (F.col("event_id") + 1).alias("line_no"),
        F.floor(micros / 1000).alias("ts_millis"),
        F.concat(F.lit("com.example."), "event_type", F.lit(".Handler")).alias("logger"),
        level.alias("level"),
        F.concat(F.lit("exec-"), F.col("user_id").cast("string")).alias("thread"),
        F.concat_ws(" ", "event_type", "props").alias("message"),
    )
    raw = F.concat(spaced(F.col("ts_millis")), F.lit("["), "thread", F.lit("]["), "level", F.lit("]["), "logger", F.lit("] - "), "message", F.lit("\n"))
    return out.withColumn("raw", raw)


def files(spark: SparkSession) -> DataFrame:
    return spark.range(1, 4).select(F.col("id").alias("file_id"), F.concat(F.lit("/logs/app"), F.col("id").cast("string"), F.lit(".log")).alias("path"))


def query(sql: str, name: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        ORACLE_SQL[name or f.__name__] = sql
        return f

    return add


ROW = ("event_id", "file_id", "line_no", "ts_millis", "level", "logger", "thread", "message")
_ROW = ", ".join(ROW)


def _filtered(name: str, condition: str, **given: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        q = QueryFilter.of(**given)
        q.check(spark)
        return q.apply(entries(spark, sf_dir), files(spark)).select(*ROW)

    query(f"{E} SELECT {_ROW} FROM entries WHERE {condition}", name)(run)


_RANGE = "ts_millis BETWEEN epoch_ms(TIMESTAMP '2024-01-05 00:00:00') AND epoch_ms(TIMESTAMP '2024-01-10 12:30:59.999')"
_SINCE = {"since": "2024-01-05", "until": "2024-01-10T12:30:59.999"}
_filtered("q_level_in", "level IN ('ERROR', 'WARN')", level=" error, Warn,,")
_filtered("q_time_range", _RANGE, **_SINCE)
_filtered("q_level_time", f"level = 'ERROR' AND {_RANGE}", level="ERROR", **_SINCE)
_filtered("q_logger_regex", r"regexp_matches(logger, 'SIGN.*handler$', 'i')", logger="SIGN.*handler$")
_filtered("q_thread_regex", r"regexp_matches(thread, '^exec-1\d$', 'i')", thread=r"^EXEC-1\d$")
_filtered("q_message_regex", r'''regexp_matches(message, '"k": [67]\d', 'i')''', message=r'"K": [67]\d')
_filtered("q_grep_regex", r"regexp_matches(raw, 'exec-4\d?\]\[error', 'i')", grep=r"exec-4\d?\]\[error")
_filtered("q_grep_literal_nocase", "contains(lower(raw), 'exec-42')", grep="EXEC-42")
_filtered("q_source_pushdown", r"regexp_matches(source, 'app[12]\.log$', 'i')", source=r"APP[12]\.log$")
_filtered("q_all_conditions", rf"level IN ('ERROR', 'INFO') AND {_RANGE} AND contains(source, 'app2') AND contains(thread, 'exec-1') AND contains(raw, '\"k\": 1')".replace('\\"', '"'), level="ERROR,INFO", source="app2", thread="exec-1", grep='"k": 1', **_SINCE)


@query(f"{E} SELECT {_ROW} FROM entries WHERE contains(raw, '\"k\": 6')")
def q_contains_case(spark, sf_dir):
    return entries(spark, sf_dir).where(strings.holds(F.col("raw"), '"k": 6')).select(*ROW)


@query(f"{E} SELECT {_ROW} FROM entries ORDER BY ts_millis, file_id, line_no LIMIT 50 OFFSET 100")
def q_page_offset(spark, sf_dir):
    return search.page(entries(spark, sf_dir), 100, 50).select(*ROW)


@query(f"{E} SELECT {_ROW} FROM entries ORDER BY ts_millis DESC, file_id DESC, line_no DESC LIMIT 20")
def q_topk_latest(spark, sf_dir):
    return search.ordered(entries(spark, sf_dir), newest_first=True).limit(20).select(*ROW)


@query(f"{E} SELECT (SELECT count(*) FROM entries WHERE level = 'WARN') AS total, event_id, source FROM entries WHERE level = 'WARN' ORDER BY ts_millis, file_id, line_no LIMIT 25 OFFSET 10")
def q_total_and_page(spark, sf_dir):
    total, rows = search.search(entries(spark, sf_dir), files(spark), QueryFilter.of(level="WARN"), 10, 25)
    return rows.select(F.lit(total).cast("long").alias("total"), "event_id", "source")


_ISO = "strftime(make_timestamp(CAST({} AS BIGINT) * 1000), '%Y-%m-%dT%H:%M:%S.%g')"


@query(f"{E} SELECT count(*) AS total, {_ISO.format('min(ts_millis)')} AS first, {_ISO.format('max(ts_millis)')} AS last FROM entries")
def q_bounds(spark, sf_dir):
    return search.bounds(entries(spark, sf_dir))


@query(f"{E} SELECT event_id FROM entries WHERE ts_millis <= (SELECT min(ts_millis) FROM entries) + 24 * 3600000")
def q_first_hours(spark, sf_dir):
    return _between(spark, sf_dir, times.first_hours)


@query(f"{E} SELECT event_id FROM entries WHERE ts_millis >= (SELECT max(ts_millis) FROM entries) - 24 * 3600000")
def q_last_hours(spark, sf_dir):
    return _between(spark, sf_dir, times.last_hours)


def _between(spark, sf_dir, bounds) -> DataFrame:
    rows = entries(spark, sf_dir)
    ends = rows.agg(F.min("ts_millis").alias("a"), F.max("ts_millis").alias("b")).first()
    low, high = bounds(ends.a, ends.b, 24)
    return rows.where(F.col("ts_millis").between(low, high)).select("event_id")


@query(f"{E} SELECT event_id FROM entries, (SELECT ts_millis // 1000 * 1000 AS mid FROM entries WHERE event_id = 77) WHERE ts_millis BETWEEN mid - 300000 AND mid + 300000")
def q_around(spark, sf_dir):
    rows = entries(spark, sf_dir)
    low, high = times.around(rows.where("event_id = 77").first().ts_millis, 5)
    return rows.where(F.col("ts_millis").between(low, high)).select("event_id")


@query(f"{E} SELECT event_id, source, rtrim(raw, chr(10)) AS raw FROM entries WHERE source = '/logs/app2.log' AND line_no = (SELECT min(line_no) FROM entries WHERE file_id = 2)")
def q_point_lookup(spark, sf_dir):
    rows = entries(spark, sf_dir)
    line = rows.where("file_id = 2").agg(F.min("line_no")).first()[0]
    return search.find_entry(rows, files(spark), "/logs/app2.log", line).select("event_id", "source", "raw")


@query(f"{E} SELECT event_id, source, row_number() OVER (ORDER BY ts_millis, file_id, line_no) AS nth FROM entries ORDER BY nth LIMIT 500")
def q_multi_file_merge(spark, sf_dir):
    rows = search.with_source(search.page(entries(spark, sf_dir), 0, 500), files(spark))  # one page: the window is bounded
    return rows.select("event_id", "source", F.row_number().over(Window.orderBy(*search.ORDER)).alias("nth"))


def _line(layout: str) -> Column:
    ts, iso = spaced(F.col("ts_millis")), times.format_iso(F.col("ts_millis"))
    lit = F.lit
    thread, level, logger, message = "thread", "level", "logger", "message"
    if layout == "spring-boot":
        return F.concat(iso, lit("+09:00  "), level, lit(" 123 --- ["), thread, lit("] "), logger, lit("   : "), message)
    if layout == "logback":
        return F.concat(F.regexp_replace(ts, r"\.", ","), lit(" ["), thread, lit("] "), level, lit(" "), logger, lit(" - "), message)
    if layout == "iso8601":
        return F.concat(iso, lit("Z "), level, lit(" ["), thread, lit("] "), logger, lit(" - "), message)
    if layout == "tomcat-juli":
        day = F.date_format(times.civil_from_days(F.floor(F.col("ts_millis") / times.DAY_MS)), "dd-MMM-yyyy")
        return F.concat(day, lit(" "), F.substring(iso, 12, 12), lit(" "), level, lit(" ["), thread, lit("] "), logger, lit(" "), message)
    return F.concat(ts, lit("["), thread, lit("]["), level, lit("]["), logger, lit("] - "), message)


def _parsed(name: str, layout: str, line: Callable[[], Column] | None = None) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = entries(spark, sf_dir).select("event_id", (_line(layout) if line is None else line()).alias("line"))
        return with_header(rows, layout, F.col("line"), "p").where("p is not null").select("event_id", "p.*")

    query(f"{E} SELECT event_id, ts_millis, logger, level, thread, message FROM entries", name)(run)


for _name, _id in (("q_parse_default", "default"), ("q_parse_spring", "spring-boot"), ("q_parse_logback", "logback"), ("q_parse_iso", "iso8601"), ("q_parse_juli", "tomcat-juli")):
    _parsed(_name, _id)
_parsed("q_role_swap", "default", lambda: F.concat(spaced(F.col("ts_millis")), F.lit("["), "logger", F.lit("]["), F.lower("level"), F.lit("]["), "thread", F.lit("] - "), "message"))


@query("""SELECT line_layout, layout, CASE WHEN line_layout = layout OR (line_layout = 'iso8601' AND layout = 'iso8601') THEN n ELSE 0 END AS hits
FROM (SELECT count(*) AS n FROM events), (SELECT unnest(['default', 'spring-boot', 'logback', 'iso8601', 'tomcat-juli']) AS layout), (SELECT unnest(['default', 'spring-boot', 'logback', 'iso8601', 'tomcat-juli']) AS line_layout)""")
def q_detect_format(spark, sf_dir):
    rows = entries(spark, sf_dir)
    lines = rows.select(F.explode(F.array(*[F.struct(F.lit(k).alias("line_layout"), _line(k).alias("line")) for k in LAYOUTS])).alias("x")).select("x.*")
    for k in LAYOUTS:  # all layouts read the lines of one scan
        lines = with_header(lines, k, F.col("line"), f"head {k}").withColumn(f"head {k}", F.col(f"head {k}").isNotNull())
    hits = lines.groupBy("line_layout").agg(*[F.count_if(f"`head {k}`").alias(k) for k in LAYOUTS])
    return hits.select("line_layout", F.explode(F.array(*[F.struct(F.lit(k).alias("layout"), F.col(f"`{k}`").alias("hits")) for k in LAYOUTS])).alias("x")).select("line_layout", "x.*")


_HEADER = "2024-01-01 00:00:00.000[main][INFO][a.b] - "
_DOC = f"""WITH lines AS (SELECT doc_id AS file_id, generate_subscripts(ls, 1) AS line_no, unnest(ls) AS l FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)),
marked AS (SELECT file_id, line_no, regexp_matches(l, '^[A-M]') AS head, CASE WHEN regexp_matches(l, '^[A-M]') THEN '{_HEADER}' || l ELSE l END AS value FROM lines),
placed AS (SELECT *, CAST(coalesce(sum(octet_length(encode(value)) + 1) OVER (PARTITION BY file_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS byte_offset,
  max(CASE WHEN head THEN line_no END) OVER (PARTITION BY file_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS entry FROM marked) """


def _document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files whose lines with a capital A to M are headers."""
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_id"), F.posexplode(F.split("text", "\n")).alias("i", "l"))
    rows = rows.select("file_id", F.lit(0).cast("long").alias("split"), (F.col("i") + 1).cast("long").alias("line_no"), F.when(F.col("l").rlike("^[A-M]"), F.concat(F.lit(_HEADER), "l")).otherwise(F.col("l")).alias("value"))
    past = Window.partitionBy("file_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("byte_offset", F.coalesce(F.sum(F.octet_length("value") + 1).over(past), F.lit(0)))


@query(f"{_DOC} SELECT file_id, entry AS line_no, string_agg(value, chr(10) ORDER BY line_no) || chr(10) AS raw FROM placed WHERE entry IS NOT NULL GROUP BY file_id, entry")
def q_entries_from_text(spark, sf_dir):
    return assembly.assemble(_document_lines(spark, sf_dir), "default")[0].select("file_id", "line_no", "raw")


@query(f"{_DOC} SELECT file_id, entry AS line_no, min(byte_offset) AS byte_offset, CAST(max(byte_offset + octet_length(encode(value)) + 1) AS BIGINT) AS end_byte_offset FROM placed WHERE entry IS NOT NULL GROUP BY file_id, entry")
def q_end_offsets(spark, sf_dir):
    return assembly.assemble(_document_lines(spark, sf_dir), "default")[0].select("file_id", "line_no", "byte_offset", "end_byte_offset")


@query(rf"{_DOC} SELECT file_id, line_no, CASE WHEN length(value) > 120 THEN substring(value, 1, 117) || '...' ELSE value END AS preview FROM (SELECT file_id, line_no, entry, regexp_replace(value, '[\r\n]+$', '') AS value, value AS v FROM placed) WHERE entry IS NULL AND NOT regexp_matches(v, '^[ \t\r\n]*$')")
def q_skipped_lines(spark, sf_dir):
    return assembly.assemble(_document_lines(spark, sf_dir), "default")[1]


@query(f"{E} SELECT event_id, CAST(ts_millis // 1000 * 1000 AS BIGINT) AS ts_millis, level, thread, logger, message FROM entries")
def q_custom_format(spark, sf_dir):
    x = define("shop", None, r"(?<ts>\d\d/\w{3}/\d{4} [\d:]+) <(?<level>\w+)> (?<thread>\S+) (?<logger>[^ |]+)\|(?<message>.*)", "dd/MMM/yyyy HH:mm:ss", spark)
    day = F.date_format(times.civil_from_days(F.floor(F.col("ts_millis") / times.DAY_MS)), "dd/MMM/yyyy")
    line = F.concat(day, F.lit(" "), F.substring(times.format_iso(F.col("ts_millis")), 12, 8), F.lit(" <"), F.lower("level"), F.lit("> "), "thread", F.lit(" "), "logger", F.lit("|"), "message", F.lit("\r\n"))
    rows = entries(spark, sf_dir).select("event_id", line.alias("line"))
    return x.with_header(rows, F.col("line"), "p").where("p is not null").select("event_id", "p.*")


@query("SELECT o_orderkey, CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) AS days FROM orders")
def q_civil_days(spark, sf_dir):
    d = F.col("o_orderdate").cast("date")
    return table(spark, sf_dir, "orders").select("o_orderkey", times.civil_days(F.year(d), F.month(d), F.day(d)).alias("days"))


@query(f"{E} SELECT event_id, {_ISO.format('ts_millis')} AS iso FROM entries")
def q_format_iso(spark, sf_dir):
    return entries(spark, sf_dir).select("event_id", times.format_iso(F.col("ts_millis")).alias("iso"))


@query("""SELECT event_id, CAST(epoch_ms(try_strptime(t, '%Y-%m-%d %H:%M')) AS BIGINT) AS millis FROM (SELECT event_id,
  '20' || lpad(CAST(event_id % 30 + 10 AS VARCHAR), 2, '0') || '-' || lpad(CAST(event_id % 14 AS VARCHAR), 2, '0') || '-' || lpad(CAST(event_id % 33 AS VARCHAR), 2, '0') || ' ' || lpad(CAST(event_id % 26 AS VARCHAR), 2, '0') || ':' || lpad(CAST(event_id % 61 AS VARCHAR), 2, '0') AS t FROM events)""")
def q_ui_datetime_valid(spark, sf_dir):
    def two(n, add=0):
        return F.lpad((F.col("event_id") % n + add).cast("string"), 2, "0")

    t = F.concat(F.lit("20"), two(30, 10), F.lit("-"), two(14), F.lit("-"), two(33), F.lit("T"), two(26), F.lit(":"), two(61))
    return table(spark, sf_dir, "events").select("event_id", times.ui_millis(t).alias("millis"))


_NEEDLE = "rror {"


@query(f"{E} SELECT event_id FROM entries WHERE list_has_all(list_transform(range(1, length(message) - 1), lambda i: substring(message, i, 3)), {strings.trigrams(_NEEDLE)})")
def q_trigram_candidates(spark, sf_dir):
    grams = strings.trigrams(_NEEDLE)
    rows = entries(spark, sf_dir).select("event_id", strings.trigram_column(F.col("message")).alias("g"))
    return rows.where(F.size(F.array_intersect("g", F.array(*[F.lit(g) for g in grams]))) == len(grams)).select("event_id")


@query(f"""{E} SELECT event_id, ts_millis, source FROM entries WHERE contains(lower(raw), 'purchase {{"k": 77') OR contains(lower(raw), 'exec-93')""")
def q_grep_indexed(spark, sf_dir):
    kept, _ = scratch.save(postings.numbered(search.ordered(entries(spark, sf_dir))))
    path = scratch.folder(spark)
    postings.write(postings.build(kept), path)
    grams = spark.read.parquet(path)
    # a pattern with signs that mean something is searched without the index
    found = [QueryFilter(grep=g).apply(kept, files(spark), grams) for g in (r'Purchase \{"K": 77', "EXEC-93")]
    return search.with_source(found[0].unionByName(found[1]).dropDuplicates(["event_id"]), files(spark)).select("event_id", "ts_millis", "source")


_COUNTED = {  # page: (condition in SQL, the query, offset)
    1: ("true", QueryFilter(), 3000),
    2: ("level IN ('ERROR', 'WARN')", QueryFilter(levels=frozenset({"ERROR", "WARN"})), 700),
    3: ("level = 'INFO' AND ts_millis BETWEEN 1704500000000 AND 1705500000000", QueryFilter(levels=frozenset({"INFO"}), since=1704500000000, until=1705500000000), 50),
    4: ("file_id IN (2, 3) AND ts_millis >= 1704800000000", QueryFilter(source="app[23]", since=1704800000000), 900),
}


@query(
    E + " UNION ALL ".join(f"SELECT * FROM (SELECT {k} AS page, count(*) OVER () AS total, event_id FROM entries WHERE {c} ORDER BY ts_millis, file_id, line_no LIMIT 40 OFFSET {o})" for k, (c, _, o) in _COUNTED.items())
)
def q_counted_pages(spark, sf_dir):
    rows, _ = scratch.save(postings.numbered(search.ordered(entries(spark, sf_dir))))
    path = scratch.folder(spark)
    summary.write(summary.build(rows), path)
    counts, pages = summary.Summary(spark.read.parquet(path)), []
    for k, (_, q, offset) in _COUNTED.items():
        total, page = search.search(rows, files(spark), q, offset, 40, counts=counts)
        pages.append(page.select(F.lit(k).alias("page"), F.lit(total).cast("long").alias("total"), "event_id"))
    return pages[0].unionAll(pages[1]).unionAll(pages[2]).unionAll(pages[3])


@query(f"""{E} SELECT event_id, CASE WHEN contains(lower(raw), 'exec-1') THEN 1 WHEN contains(lower(raw), 'error') THEN 2 WHEN contains(lower(raw), '"k": 5') THEN 3 END AS class FROM entries""")
def q_highlight_class(spark, sf_dir):
    return entries(spark, sf_dir).select("event_id", strings.highlight_class(F.col("raw"), ["EXEC-1", "error", '"k": 5']).alias("class"))


@query(f"{E} SELECT event_id, lower(level) AS class FROM (SELECT event_id, CASE level WHEN 'ERROR' THEN 'ERROR' ELSE level END AS level FROM entries)")
def q_level_class(spark, sf_dir):
    given = F.element_at(F.create_map(*[F.lit(x) for kv in {"ERROR": "SEVERE", "WARN": "WARNING", "INFO": "CONFIG", "DEBUG": "FINE", "TRACE": "FINEST"}.items() for x in kv]), F.col("level"))
    return entries(spark, sf_dir).select("event_id", strings.level_class(given).alias("class"))


@query(f"{E} SELECT event_id, 'Handler' AS short, 'logs/app' || file_id || '.log:' || line_no AS label, substring(raw, 1, 64) AS cut FROM entries")
def q_labels(spark, sf_dir):
    rows = search.with_source(entries(spark, sf_dir), files(spark))
    return rows.select("event_id", strings.short_logger(F.col("logger")).alias("short"), strings.source_label(F.col("source"), F.col("line_no")).alias("label"), strings.truncated(F.col("raw"), 64).alias("cut"))


@query("""SELECT page_id, name, (regexp_matches(lower(name), '\\.log$|^app.*\\.log|\\.out$') AND NOT regexp_matches(lower(name), '\\.(gz|bz2|xz)$')) AS is_log
FROM (SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'x' || page_id || '.LOG' WHEN 1 THEN 'App' || page_id || '.log.1' WHEN 2 THEN 'app' || page_id || '.log.gz' WHEN 3 THEN 'x' || page_id || '.log.1' ELSE 'std.Out' END AS name FROM pages)""")
def q_log_file_names(spark, sf_dir):
    i = F.col("page_id").cast("string")
    kind = F.col("page_id") % 5
    name = F.when(kind == 0, F.concat(F.lit("x"), i, F.lit(".LOG"))).when(kind == 1, F.concat(F.lit("App"), i, F.lit(".log.1"))).when(kind == 2, F.concat(F.lit("app"), i, F.lit(".log.gz"))).when(kind == 3, F.concat(F.lit("x"), i, F.lit(".log.1"))).otherwise(F.lit("std.Out"))
    return table(spark, sf_dir, "pages").select("page_id", name.alias("name")).withColumn("is_log", log_name_column(F.col("name")))


@query(f"{E} SELECT event_id, sha256(source) AS key FROM entries")
def q_root_key(spark, sf_dir):
    return search.with_source(entries(spark, sf_dir), files(spark)).select("event_id", strings.root_key_column(F.col("source")).alias("key"))


_DAY = 1440 * 60_000
REQUEST = ("file_id", "thread", "first_line", "last_line", "n_rows", "n_anchors", "end_reason", "start_found")


def requests(members: DataFrame, kept_only: bool = False) -> DataFrame:
    """One row for each request of ``trace.members``."""
    rows = members.where("kept") if kept_only else members
    return rows.groupBy("file_id", "thread", "req").agg(
        F.min("line_no").alias("first_line"), F.max("line_no").alias("last_line"), F.count("*").alias("n_rows"), F.first("n_anchors").alias("n_anchors"), F.first("end_reason").alias("end_reason"), F.first("start_found").alias("start_found")
    ).select(*REQUEST)


_FLAGS = f"""{E}, flagged AS (SELECT *, starts_with(message, 'signup') AS s, starts_with(message, 'purchase') AS e, contains(message, 'error') AS bad FROM entries),
numbered AS (SELECT *, row_number() OVER (PARTITION BY file_id, thread ORDER BY ts_millis, line_no) AS i FROM flagged), """
_FROM_START = f"""{_FLAGS}
nexts AS (SELECT a.file_id, a.thread, a.i AS i0, a.ts_millis AS t0, min(b.i) FILTER (b.s) AS ns, min(b.i) FILTER (b.e) AS ne FROM numbered a LEFT JOIN numbered b
  ON a.file_id = b.file_id AND a.thread = b.thread AND b.i > a.i AND b.ts_millis <= a.ts_millis + {_DAY} WHERE a.s GROUP BY ALL)
SELECT n.file_id, n.thread, min(r.line_no) AS first_line, max(r.line_no) AS last_line, count(*) AS n_rows, 1 AS n_anchors,
  CASE WHEN ne IS NOT NULL AND (ns IS NULL OR ne < ns) THEN 'end' WHEN ns IS NOT NULL THEN 'next_start' ELSE 'not_found' END AS end_reason, true AS start_found
FROM nexts n JOIN numbered r ON r.file_id = n.file_id AND r.thread = n.thread AND r.i >= n.i0 AND r.ts_millis <= n.t0 + {_DAY} AND (ns IS NULL OR r.i < ns) AND (ne IS NULL OR r.i <= ne)
GROUP BY n.file_id, n.thread, i0, ns, ne"""


@query(_FROM_START)
def q_trace_from_start(spark, sf_dir):
    return requests(trace.members(entries(spark, sf_dir), trace.boundary("signup", "^signup", "^purchase", 1440)))


_TO_END = f"""{_FLAGS}
backs AS (SELECT a.file_id, a.thread, a.i AS i1, a.ts_millis AS t1, max(b.i) FILTER (b.e) AS pe, max(b.i) FILTER (b.s) AS ps FROM numbered a LEFT JOIN numbered b
  ON a.file_id = b.file_id AND a.thread = b.thread AND b.i < a.i AND b.ts_millis >= a.ts_millis - {_DAY} WHERE a.e GROUP BY ALL),
found AS (SELECT k.file_id, k.thread, k.i1, min(r.line_no) AS first_line, max(r.line_no) AS last_line, count(*) AS n_rows, 1 AS n_anchors, 'end' AS end_reason,
  (ps IS NOT NULL AND (pe IS NULL OR ps > pe)) AS start_found, bool_or(r.bad) AS bad
FROM backs k JOIN numbered r ON r.file_id = k.file_id AND r.thread = k.thread AND r.i <= k.i1 AND r.ts_millis >= k.t1 - {_DAY} AND (pe IS NULL OR r.i > pe) AND (ps IS NULL OR r.i >= ps)
GROUP BY k.file_id, k.thread, k.i1, ps, pe)
SELECT {", ".join(REQUEST)} FROM found"""


def _to_end(spark, sf_dir, **words) -> DataFrame:
    return requests(trace.members(entries(spark, sf_dir), trace.boundary("purchase", "^signup", "^purchase", 1440).filtered(**words)), kept_only=True)


@query(_TO_END)
def q_trace_boundary(spark, sf_dir):
    return _to_end(spark, sf_dir)


@query(_TO_END + " WHERE bad")
def q_trace_filter_contains(spark, sf_dir):
    return _to_end(spark, sf_dir, contains="] - ERROR ")


@query(_TO_END + " WHERE NOT bad")
def q_trace_filter_excludes(spark, sf_dir):
    return _to_end(spark, sf_dir, excludes="] - error ")


# what ``trace.run`` shows: limits, totals and the order of requests
_CREATED = _TO_END.replace("bool_or(r.bad) AS bad", "bool_or(r.bad) AS bad, k.t1 AS c_ts, max(r.line_no) FILTER (r.i = k.i1) AS c_line, min(r.ts_millis) AS first_ts, min_by(r.line_no, r.i) AS first_row").replace("GROUP BY k.file_id, k.thread, k.i1, ps, pe)", "GROUP BY k.file_id, k.thread, k.i1, k.t1, ps, pe)")
_CREATED = (
    _CREATED[: _CREATED.rindex("SELECT")].rstrip()
    + """,
tried AS (SELECT *, row_number() OVER (ORDER BY c_ts, file_id, c_line) AS nth, coalesce(sum(CAST(bad AS INT)) OVER (ORDER BY c_ts, file_id, c_line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS kept_before FROM found),
live AS (SELECT * FROM tried WHERE nth <= 2000 AND kept_before < 200) """
)


def _run(spark, sf_dir) -> trace.Result:
    return trace.run(entries(spark, sf_dir), files(spark), trace.boundary("purchase", "^signup", "^purchase", 1440).filtered(contains="] - ERROR "))


@query(_CREATED + "SELECT (SELECT count(*) FROM entries WHERE contains(raw, 'purchase')) AS anchor_total, (SELECT count(*) FROM found) > count(*) AS truncated, count(*) FILTER (NOT bad) AS filtered_out, count(*) FILTER (bad) AS n_requests FROM live")
def q_trace_totals(spark, sf_dir):
    out = _run(spark, sf_dir)
    return out.requests.agg(F.count("*").alias("n_requests")).select(F.lit(out.anchor_total).cast("long").alias("anchor_total"), F.lit(out.truncated).alias("truncated"), F.lit(out.filtered_out).cast("long").alias("filtered_out"), "n_requests")


@query(_CREATED + "SELECT CAST(row_number() OVER (ORDER BY first_ts, file_id, first_row) AS INT) AS req_no, '/logs/app' || file_id || '.log' AS source, thread, start_found, end_reason, false AS truncated, n_rows, n_anchors FROM live WHERE bad")
def q_trace_request_order(spark, sf_dir):
    return _run(spark, sf_dir).requests


@query(_CREATED + """, shown AS (SELECT *, CAST(row_number() OVER (ORDER BY first_ts, file_id, first_row) AS INT) AS req_no FROM live WHERE bad)
SELECT req_no, CAST(row_number() OVER (PARTITION BY req_no ORDER BY r.i) - 1 AS BIGINT) AS pos, r.line_no, r.e AS anchor FROM shown q JOIN numbered r ON r.file_id = q.file_id AND r.thread = q.thread AND r.ts_millis >= q.first_ts AND r.ts_millis <= q.c_ts
  AND (r.ts_millis, r.line_no) >= (q.first_ts, q.first_row) AND (r.ts_millis, r.line_no) <= (q.c_ts, q.c_line)""")
def q_trace_request_rows(spark, sf_dir):
    return _run(spark, sf_dir).rows.select("req_no", "pos", "line_no", "anchor")


@query(f"""{E} SELECT CAST(row_number() OVER (ORDER BY ts_millis, file_id, line_no) AS INT) AS req_no, source, thread, 'standalone' AS end_reason, count(*) OVER () > 200 AS limited FROM entries WHERE contains(raw, '"k": 7') QUALIFY req_no <= 200""")
def q_trace_standalone(spark, sf_dir):
    out = trace.run(entries(spark, sf_dir), files(spark), trace.boundary('"k": 7', "^no start$", "^no end$", 1))
    return out.requests.select("req_no", "source", "thread", "end_reason", F.lit(out.truncated).alias("limited"))


_W = 3600_000


@query(f"""{E}, anchors AS (SELECT file_id, thread, ts_millis, line_no, CASE WHEN ts_millis - lag(ts_millis) OVER w <= {_W} THEN 0 ELSE 1 END AS fresh FROM entries WHERE contains(raw, '"k": 7') WINDOW w AS (PARTITION BY file_id, thread ORDER BY ts_millis, line_no)),
islands AS (SELECT *, sum(fresh) OVER (PARTITION BY file_id, thread ORDER BY ts_millis, line_no ROWS UNBOUNDED PRECEDING) AS g FROM anchors),
spans AS (SELECT file_id, thread, g, min(ts_millis) - {_W} AS a, max(ts_millis) + {_W} AS b, count(*) AS n_anchors FROM islands GROUP BY ALL),
held AS (SELECT r.file_id, r.thread, r.line_no, min(g) AS g FROM entries r JOIN spans s ON r.file_id = s.file_id AND r.thread = s.thread AND r.ts_millis BETWEEN a AND b GROUP BY ALL)
SELECT s.file_id, s.thread, min(line_no) AS first_line, max(line_no) AS last_line, count(*) AS n_rows, n_anchors, 'window' AS end_reason, false AS start_found FROM held h JOIN spans s USING (file_id, thread, g) GROUP BY s.file_id, s.thread, g, n_anchors""")
def q_trace_window(spark, sf_dir):
    return requests(trace.members(entries(spark, sf_dir), trace.window('"k": 7', 3600)))


# limits on rows: all rows of a file are one thread, at a hundredth of their times
_QUICK = f"""{E}, numbered AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY ts_millis // 100, line_no) AS i, count(*) OVER (PARTITION BY file_id) AS n FROM entries),
a AS (SELECT file_id, i, n FROM numbered WHERE contains(raw, '"k": 7')),"""


@query(
    _QUICK.replace("WITH ev", "WITH RECURSIVE ev")
    + """
spans AS (SELECT file_id, min(i) AS made, greatest(min(i) - 500, 1) AS b, least(greatest(min(i) - 500, 1) + 999, any_value(n)) AS z, any_value(n) AS n FROM a GROUP BY file_id
  UNION ALL SELECT s.file_id, min(a.i), greatest(min(a.i) - 500, 1), least(greatest(min(a.i) - 500, 1) + 999, any_value(s.n)), any_value(s.n) FROM spans s JOIN a ON a.file_id = s.file_id AND a.i > s.z + 501 GROUP BY s.file_id)
SELECT s.file_id, f.line_no AS first_line, z - b + 1 AS n_rows, (SELECT count(*) FROM a WHERE a.file_id = s.file_id AND a.i BETWEEN s.made AND s.z + 501) AS n_anchors,
  'not_found' AS end_reason, (made > 501 OR z < s.n) AS truncated FROM spans s JOIN numbered f ON f.file_id = s.file_id AND f.i = b WHERE made > 501 OR z < s.n"""
)
def q_trace_rows_cut(spark, sf_dir):
    rows = entries(spark, sf_dir).withColumn("thread", F.lit("all")).withColumn("ts_millis", F.floor(F.col("ts_millis") / 100))
    found = trace.members(rows, trace.boundary('"k": 7', "^no start$", "^no end$", 1440)).where("truncated")
    heads = found.groupBy("file_id", "req").agg(F.min_by("line_no", "pos").alias("first_line"), F.count("*").alias("n_rows"), F.first("n_anchors").alias("n_anchors"), F.first("end_reason").alias("end_reason"), F.first("truncated").alias("truncated"))
    return heads.drop("req")


# a request counts as kept from the anchor on that brings the first row with the word; the first 200 of them stay
@query(
    f"""{E}, gaps AS (SELECT *, ts_millis - lag(ts_millis) OVER w > 3600000 AS fresh FROM entries WHERE contains(raw, '"k": 7') WINDOW w AS (PARTITION BY file_id, thread ORDER BY ts_millis, line_no)),
numbered AS (SELECT *, sum(CASE WHEN fresh IS DISTINCT FROM false THEN 1 ELSE 0 END) OVER (PARTITION BY file_id, thread ORDER BY ts_millis, line_no) AS g FROM gaps),
sessions AS (SELECT file_id, thread, g, min(ts_millis) AS t0, max(ts_millis) AS t1, arg_min(line_no, (ts_millis, line_no)) AS l0, count(*) AS n_anchors FROM numbered GROUP BY ALL),
apart AS (SELECT *, lag(t1) OVER (PARTITION BY file_id, thread ORDER BY g) AS past FROM sessions),
held AS (SELECT s.*, e.line_no, e.ts_millis, e.level FROM apart s JOIN entries e ON e.file_id = s.file_id AND e.thread = s.thread AND e.ts_millis BETWEEN t0 - 3600000 AND t1 + 3600000 AND (past IS NULL OR e.ts_millis > past + 3600000)),
hits AS (SELECT h.file_id, h.thread, h.g, CASE WHEN h.ts_millis <= t0 + 3600000 THEN (t0, h.file_id, l0) ELSE (SELECT min((a.ts_millis, a.file_id, a.line_no)) FROM numbered a WHERE a.file_id = h.file_id AND a.thread = h.thread AND a.g = h.g AND a.ts_millis >= h.ts_millis - 3600000) END AS k
  FROM held h WHERE level = 'ERROR'),
first AS (SELECT file_id, thread, g, min(k) AS k FROM hits GROUP BY ALL ORDER BY k LIMIT 200)
SELECT '/logs/app' || h.file_id || '.log' AS source, h.thread, min(h.line_no) AS first_line, count(*) AS n_rows, any_value(n_anchors) AS n_anchors FROM held h JOIN first f ON h.file_id = f.file_id AND h.thread = f.thread AND h.g = f.g GROUP BY h.file_id, h.thread, h.g"""
)
def q_trace_filter_order(spark, sf_dir):
    out = trace.run(entries(spark, sf_dir), files(spark), trace.window('"k": 7', 3600).filtered(contains=r"\]\[ERROR\]\["))
    first = out.rows.groupBy("req_no").agg(F.min("line_no").alias("first_line"))
    return out.requests.join(first, "req_no").select("source", "thread", "first_line", "n_rows", "n_anchors")


@query("""WITH c AS (SELECT conv_id, turn, role, contains(text, 'the') AS hit, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS g FROM conversations),
cut AS (SELECT *, coalesce(sum(CASE WHEN role = 'assistant' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id, g ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS past FROM c)
SELECT conv_id, min(turn) AS first_turn, max(turn) AS last_turn, count(*) FILTER (hit) AS n_anchors FROM cut WHERE g > 0 AND past = 0 GROUP BY conv_id, g HAVING count(*) FILTER (hit) > 0""")
def q_conversation_requests(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    rows = c.select(F.col("conv_id").alias("file_id"), F.lit("talk").alias("thread"), F.col("turn").alias("line_no"), (F.col("turn") * 1000).alias("ts_millis"), F.col("role").alias("message"), F.coalesce("text", F.lit("")).alias("raw"))
    members = trace.members(rows, trace.boundary("the", "^user$", "^assistant$", 1440)).where("start_found")
    return members.groupBy(F.col("file_id").alias("conv_id"), "req").agg(F.min("line_no").alias("first_turn"), F.max("line_no").alias("last_turn"), F.first("n_anchors").alias("n_anchors")).drop("req")


# conditions and pages -----------------------------------------------------------------------


@query(f"{E} SELECT {_ROW} FROM entries WHERE contains(lower(source), '/logs/app2.log') AND contains(lower(thread), 'exec-1')")
def q_same_context(spark, sf_dir):
    # the patterns are quoted literals, found anywhere: exec-1 also stands in exec-10
    return QueryFilter.of(**same_context("/logs/app2.log", "exec-1")).apply(entries(spark, sf_dir), files(spark)).select(*ROW)


@query(f"{E} SELECT {_ROW} FROM entries WHERE ts_millis BETWEEN epoch_ms(TIMESTAMP '2024-01-03 04:05:00') AND epoch_ms(TIMESTAMP '2024-01-06 07:08:59.999')")
def q_minute_range(spark, sf_dir):
    since, until = times.minute_range("2024-01-03", "04:05", "2024-01-06", "07:08")
    return QueryFilter.of(since=since, until=until).apply(entries(spark, sf_dir), files(spark)).select(*ROW)


@query(f"{E} SELECT event_id FROM entries WHERE contains(message, '{{\"k\": 5')".replace('\\"', '"'))
def q_quoted_literal(spark, sf_dir):
    return entries(spark, sf_dir).where(F.col("message").rlike(strings.quoted('{"k": 5'))).select("event_id")


@query(f"{E} SELECT level, count(*) AS total, CAST(ceil(count(*) / 200) AS BIGINT) AS pages FROM entries GROUP BY level")
def q_page_counts(spark, sf_dir):
    totals = entries(spark, sf_dir).groupBy("level").count().collect()  # a handful of levels
    return spark.createDataFrame([(r.level, r["count"], search.pages(r["count"], 200)) for r in totals], "level string, total long, pages long")


@query(f"{E} SELECT count(*) AS total, 0 AS n_rows FROM entries WHERE level = 'ERROR'")
def q_empty_page(spark, sf_dir):
    total, rows = search.search(entries(spark, sf_dir), files(spark), QueryFilter.of(level="ERROR"), 0, 0)
    return rows.agg(F.count("*").alias("n_rows")).select(F.lit(total).cast("long").alias("total"), "n_rows")


@query(f"{E} SELECT {_ISO.format('ts_millis')} AS timestamp, level, logger, thread, message, source, line_no, substring(raw, 1, 4096) AS raw FROM entries ORDER BY ts_millis, file_id, line_no LIMIT 300")
def q_shown_rows(spark, sf_dir):
    return search.shown(search.with_source(search.page(entries(spark, sf_dir), 0, 300), files(spark)), F.col("raw"))


# strings ------------------------------------------------------------------------------------


@query("SELECT page_id, CASE WHEN page_id % 3 = 0 THEN '\\\\srv\\s' || page_id WHEN page_id % 3 = 1 THEN 'C:\\s' || page_id ELSE url END AS path FROM pages".replace("\\\\", "\\\\"))
def q_plain_path(spark, sf_dir):
    i = F.col("page_id").cast("string")
    given = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("\\\\?\\UNC\\srv\\s"), i)).when(F.col("page_id") % 3 == 1, F.concat(F.lit("\\\\?\\C:\\s"), i)).otherwise(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", strings.path_column(given).alias("path"))


@query(r"SELECT doc_id, coalesce(regexp_matches(text, '[\x00-\x1f\x7f]'), false) AS has_control FROM documents")
def q_control_characters(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.coalesce(strings.has_control_column(F.col("text")), F.lit(False)).alias("has_control"))


@query("""SELECT event_id, CASE WHEN event_id % 4 = 0 THEN CAST(epoch_ms(date_trunc('day', ts)) AS BIGINT) WHEN event_id % 4 = 1 THEN CAST(epoch_ms(date_trunc('minute', ts)) AS BIGINT)
  WHEN event_id % 4 = 2 THEN CAST(epoch_ms(date_trunc('second', ts)) AS BIGINT) ELSE CAST(epoch_us(ts) // 1000 AS BIGINT) END AS millis FROM events""")
def q_ui_datetime_lengths(spark, sf_dir):
    """A date, a minute, a second and a millisecond, as users type them."""
    size = F.element_at(F.array(F.lit(10), F.lit(16), F.lit(19), F.lit(23)), (F.col("event_id") % 4 + 1).cast("int"))
    return entries(spark, sf_dir).select("event_id", times.ui_millis(F.substring(spaced(F.col("ts_millis")), F.lit(1), size)).alias("millis"))


_ALIASES = ("FATAL", "SEVERE", "WARNING", "CONFIG", "FINE", "FINER", "FINEST", "INFO", "Error")


@query("""SELECT event_id, CASE event_id % 9 WHEN 0 THEN 'error' WHEN 1 THEN 'error' WHEN 2 THEN 'warn' WHEN 3 THEN 'info' WHEN 4 THEN 'debug' WHEN 5 THEN 'debug' WHEN 6 THEN 'trace' WHEN 7 THEN 'info' ELSE 'error' END AS class FROM events""")
def q_level_aliases(spark, sf_dir):
    given = F.element_at(F.array(*[F.lit(x) for x in _ALIASES]), (F.col("event_id") % 9 + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", strings.level_class(given).alias("class"))


# layouts ------------------------------------------------------------------------------------


@query("SELECT unnest(['default', 'spring-boot', 'logback', 'iso8601', 'tomcat-juli', 'none of them']) AS line_layout, unnest(['default', 'spring-boot', 'logback', 'iso8601', 'tomcat-juli', 'default']) AS layout")
def q_chosen_layout(spark, sf_dir):
    rows = entries(spark, sf_dir)
    first = rows.orderBy("line_no").limit(assembly.DETECT_LINES).withColumn("nth", F.row_number().over(Window.orderBy("line_no")))
    found = []
    for k in [*LAYOUTS, "none of them"]:
        lines = first.select(F.lit(1).alias("file_id"), F.col("nth").alias("line_no"), (_line(k) if k in LAYOUTS else F.col("message")).alias("value"))
        found.append((k, assembly.detect(lines, list(LAYOUTS))))
    return spark.createDataFrame(found, "line_layout string, layout string")


@query(f"{_DOC} SELECT (SELECT count(*) FROM skipped) AS total, file_id, line_no FROM (SELECT * FROM skipped ORDER BY file_id, line_no LIMIT 5)".replace(" SELECT (SELECT", r", skipped AS (SELECT file_id, line_no FROM placed WHERE entry IS NULL AND NOT regexp_matches(value, '^[ \t\r\n]*$')) SELECT (SELECT", 1))
def q_skipped_summary(spark, sf_dir):
    count, samples = assembly.skipped_summary(assembly.assemble(_document_lines(spark, sf_dir), "default")[1])
    return spark.createDataFrame([(count, f, n) for f, n, _ in samples], "total long, file_id long, line_no long")


@query(f"""{E}, lines AS (SELECT file_id, line_no, event_id, CASE WHEN event_id % 5 = 0 THEN 'broken' WHEN event_id % 5 = 1 THEN 'more' ELSE 'head' END AS kind FROM entries),
tied AS (SELECT *, max(CASE WHEN kind = 'head' THEN line_no END) OVER (PARTITION BY file_id ORDER BY line_no) AS entry_line FROM lines)
SELECT file_id, line_no, kind = 'broken' OR (kind = 'more' AND entry_line IS NULL) AS skipped, entry_line FROM tied""")
def q_unreadable_headers(spark, sf_dir):
    """A header of a user's layout with a month 13 is skipped and ends no entry."""
    x = define("own", None, r"(?<ts>\d{4}/\d\d/\d\d) (?<message>.*)", "yyyy/MM/dd", spark)
    kind = F.when(F.col("event_id") % 5 == 0, "2024/13/01 x").when(F.col("event_id") % 5 == 1, "more text").otherwise("2024/01/02 x")
    lines = entries(spark, sf_dir).select("file_id", F.lit(0).cast("long").alias("split"), "line_no", kind.alias("value"))
    return assembly.marked(assembly.headed(lines, x)).select("file_id", "line_no", "skipped", "entry_line")


# files --------------------------------------------------------------------------------------

_FILES = f"""{E}, numbered AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY line_no) AS n FROM entries),
rendered AS (SELECT *, rtrim(raw, chr(10)) || CASE WHEN event_id % 3 = 0 THEN chr(10) || '  at ' || event_type || chr(10) ELSE chr(10) END AS body FROM (SELECT *, regexp_extract(logger, 'example.(.*).Handler', 1) AS event_type FROM numbered)),
placed AS (SELECT *, coalesce(sum(octet_length(encode(body))) OVER past, 0) AS byte_offset, coalesce(sum(CASE WHEN event_id % 3 = 0 THEN 2 ELSE 1 END) OVER past, 0) + 1 AS first_line FROM rendered WINDOW past AS (PARTITION BY file_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) """


#: Rows of a part of a rendered file: what one task sorts.
PART_ROWS = 250_000


def _rendered(spark: SparkSession, sf_dir: str) -> str:
    """The entries as three log files in the shared folder, some with a second line.

    Parts in order of lines are sorted and written by as many tasks as there are parts. A log
    file has one writer, a task that copies the parts one after the other and holds a line.
    """
    kind = F.regexp_extract("logger", r"example\.(.*)\.Handler", 1)
    folder, parts = scratch.folder(spark), scratch.folder(spark)
    rows = entries(spark, sf_dir).withColumn("body", F.when(F.col("event_id") % 3 == 0, F.concat(F.regexp_replace("raw", "\n$", ""), F.lit("\n  at "), kind)).otherwise(F.regexp_replace("raw", "\n$", "")))
    many = 1 + table(spark, sf_dir, "events").count() // PART_ROWS
    rows.repartitionByRange(many, "file_id", "line_no").sortWithinPartitions("file_id", "line_no").select("body", "file_id").write.partitionBy("file_id").text(parts)
    at = Paths(spark)
    for held in at.listed(parts):
        if held.folder and held.name.startswith("file_id="):
            number = held.name.removeprefix("file_id=")
            found = sorted(e.path for e in at.listed(held.path) if e.name.startswith("part-"))
            # partitions of a union are in the order of its members, and coalesce(1) takes them in turn
            whole = reduce(DataFrame.unionAll, [spark.read.text(p, lineSep="\n") for p in found])
            whole.coalesce(1).write.text(f"{folder}/joined-{number}")
            (one,) = [e.path for e in at.listed(f"{folder}/joined-{number}") if e.name.startswith("part-")]
            at.move(one, f"{folder}/app{number}.log")
            at.delete(f"{folder}/joined-{number}")
    scratch.drop(spark, parts)
    return folder


def _read(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    paths = discovery.find_log_files(spark, _rendered(spark, sf_dir))
    found, _, listed, _ = index.read_entries(spark, paths, "default")
    return found, listed


@query(_FILES + "SELECT file_id, CAST(first_line AS BIGINT) AS line_no, CAST(byte_offset AS BIGINT) AS byte_offset, CAST(byte_offset + octet_length(encode(body)) AS BIGINT) AS end_byte_offset, ts_millis, level, logger, thread FROM placed")
def q_entries_of_files(spark, sf_dir):
    """Files are found, read in splits, numbered and assembled."""
    return _read(spark, sf_dir)[0].select("file_id", "line_no", "byte_offset", "end_byte_offset", "ts_millis", "level", "logger", "thread")


@query(_FILES + "SELECT file_id, CAST(first_line AS BIGINT) AS line_no, body AS raw FROM placed")
def q_raw_of_files(spark, sf_dir):
    return _read(spark, sf_dir)[0].select("file_id", "line_no", "raw")


@query(_FILES + "SELECT 'app' || file_id || '.log' AS name, file_id, CAST(sum(octet_length(encode(body))) AS BIGINT) AS size FROM placed GROUP BY file_id")
def q_discovered_files(spark, sf_dir):
    paths = discovery.find_log_files(spark, _rendered(spark, sf_dir))
    return discovery.files_table(spark, paths).select(F.substring_index("path", "/", -1).alias("name"), "file_id", "size")


@query(_FILES + "SELECT level, count(*) AS n, CAST(min(ts_millis) AS BIGINT) AS first, CAST(max(octet_length(encode(body))) AS BIGINT) AS longest FROM placed GROUP BY level")
def q_stored_index(spark, sf_dir):
    """An index is built, published, found again by its fingerprint and read."""
    home, logs = scratch.folder(spark), _rendered(spark, sf_dir)
    index.load(spark, home, logs)
    ix = index.load(spark, home, logs)
    return ix.entries.groupBy("level").agg(F.count("*").alias("n"), F.min("ts_millis").alias("first"), F.max(F.octet_length("raw")).cast("long").alias("longest"))


@query(_FILES + "SELECT 'app' || file_id || '.log' AS name, CASE file_id WHEN 1 THEN 1 ELSE 2 END AS file_id, CAST(sum(octet_length(encode(body))) AS BIGINT) AS size FROM placed WHERE file_id <> 2 GROUP BY placed.file_id")
def q_pruned_folders(spark, sf_dir):
    """One of three files lies in a folder that is not entered."""
    folder, at = _rendered(spark, sf_dir), Paths(spark)
    at.write(f"{folder}/node_modules/server.log", "not found either")
    at.move(f"{folder}/app2.log", f"{folder}/node_modules/app2.log")
    return discovery.files_table(spark, discovery.find_log_files(spark, folder)).select(F.substring_index("path", "/", -1).alias("name"), "file_id", "size")


@query(
    """WITH x AS (SELECT event_id, md5(CAST(event_id AS VARCHAR)) AS h FROM events),
ids AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'fmt-' || event_id WHEN 1 THEN '-' || h WHEN 2 THEN 'Fmt' || event_id WHEN 3 THEN substring(h, 1, 8) || '-' || substring(h, 9, 4) || '-' || substring(h, 13, 4) || '-' || substring(h, 17, 4) || '-' || substring(h, 21) ELSE substring(h, 1, 8) || '-' || substring(h, 9) END AS id FROM x)
SELECT event_id, regexp_full_match(id, '[a-z0-9][a-z0-9-]*') AS is_format, regexp_full_match(id, '[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}') AS is_uuid FROM ids"""
)
def q_safe_ids(spark, sf_dir):
    n, h = F.col("event_id"), F.md5(F.col("event_id").cast("string"))
    cut = F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12))
    given = F.when(n % 5 == 0, F.concat(F.lit("fmt-"), n.cast("string"))).when(n % 5 == 1, F.concat(F.lit("-"), h)).when(n % 5 == 2, F.concat(F.lit("Fmt"), n.cast("string"))).when(n % 5 == 3, cut).otherwise(F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 24)))
    return table(spark, sf_dir, "events").select("event_id", strings.is_format_id_column(given).alias("is_format"), strings.is_uuid_column(given).alias("is_uuid"))


@query(f"SELECT '/documents/' || file_id || '.log' AS source, line_no, preview FROM ({ORACLE_SQL['q_skipped_lines']})")
def q_skipped_sources(spark, sf_dir):
    """Skipped lines with the paths of their files."""
    _, skipped = assembly.assemble(_document_lines(spark, sf_dir), "default")
    listed = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_id"), F.concat(F.lit("/documents/"), F.col("doc_id").cast("string"), F.lit(".log")).alias("source"))
    return skipped.join(listed, "file_id").select("source", "line_no", "preview")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors and warnings of a time range whose text matches, one page in order."""
    q = QueryFilter.of(level="ERROR,WARN", since="2024-01-02", grep=r'"k": \d')
    return search.with_source(search.page(q.apply(entries(spark, sf_dir), files(spark)), 0, 200), files(spark))
