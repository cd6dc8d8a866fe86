"""User-defined line layouts: a regular expression with named groups and a time pattern.

A layout is compiled into Columns; no line passes through Python. The group ``ts`` is
needed, ``level``, ``thread``, ``logger`` and ``message`` are optional. A line whose shape
matches but whose time cannot be read (or does not exist) is an unreadable header.

Expressions run in the JVM's regular-expression engine, which has no step budget for Spark to
set. A pattern whose repetitions make it exponential (``ambiguity.explodes``) is refused when it is
defined; of those that cannot be judged, ``Engine.load`` bounds the time of an ingest.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.strings import has_control, is_format_id, without_line_end
from ..functions.times import bound, to_millis
from .ambiguity import explodes
from .layouts import LAYOUTS, PARSED

#: Limits of a definition (fixed values).
MAX_ID, MAX_NAME, MAX_PATTERN, MAX_TIMESTAMP = 40, 100, 4000, 100
FIELDS = ("level", "thread", "logger", "message")
_TIME = ("year", "month", "day", "hour", "minute", "second", "milli")
_SHORT = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")
_LONG = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")
_DAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")


@dataclass(frozen=True)
class Groups:
    """Capture numbers of named groups, and how the pattern ends."""

    names: dict[str, int]
    open_quote: bool
    comments: bool


def scan_groups(pattern: str) -> Groups:
    r"""Named groups that are neither escaped, quoted (\Q...\E) nor in a character class."""
    names: dict[str, int] = {}
    at, depth, count, comments = 0, 0, 0, False
    while at < len(pattern):
        rest = pattern[at:]
        if rest.startswith("\\Q"):
            end = pattern.find("\\E", at + 2)
            if end < 0:
                return Groups(names, True, comments)
            at = end + 2
        elif rest[0] == "\\":
            at += 2
        elif rest[0] == "[":
            depth, at = depth + 1, at + 1
        elif rest[0] == "]" and depth:
            depth, at = depth - 1, at + 1
        else:
            if not depth and rest[0] == "(":
                if named := re.match(r"\(\?<([A-Za-z][A-Za-z0-9]*)>", rest):
                    count += 1
                    names.setdefault(named[1], count)
                elif flags := re.match(r"\(\?([a-zA-Z]*)(?:-[a-zA-Z]*)?[:)]", rest):
                    comments |= "x" in flags[1]
                elif not rest.startswith("(?"):
                    count += 1
            at += 1
    return Groups(names, False, comments)


def whole(pattern: str, groups: Groups) -> str:
    """The pattern over a whole line, closed where it leaves a quote or comment open."""
    return "\\A(?:" + pattern + ("\\E" if groups.open_quote else "") + ("\n" if groups.comments else "") + ")\\z"


def check_pattern(spark: SparkSession, pattern: str) -> None:
    """ValueError for a pattern that the JVM does not compile."""
    try:
        spark._jvm.java.util.regex.Pattern.compile(pattern)
    except Exception as e:
        raise ValueError(f"not a regular expression: {pattern}") from e


#: Stands between groups while they are cut apart. In a text U+0002 is followed by U+0003 until
#: then, so that no text holds it.
_CUT, _HELD, _ESCAPED = "\x01\x02\x01", "\x02", "\x02\x03"


def _parts(text: Column, regex: str, count: int) -> Column:
    """The groups of a text that the (anchored) regex matches, behind an empty one.

    The regex runs once for each line: it rewrites the text into its groups.
    """
    spread = F.regexp_replace(F.replace(text, F.lit(_HELD), F.lit(_ESCAPED)), regex, "".join(f"{_CUT}${i}" for i in range(1, count + 1)))
    return F.split(spread, _CUT, count + 1)


def _built(parts: Column, count: int, build: Callable[[Callable[[int], Column]], Column]) -> Column:
    made = build(lambda i: F.replace(parts[i], F.lit(_ESCAPED), F.lit(_HELD)))
    return F.when((F.size(parts) == count + 1) & (parts[0] == ""), made)


def with_groups(text: Column, regex: str, count: int, build: Callable[[Callable[[int], Column]], Column]) -> Column:
    """``build`` of the groups of a text that the (anchored) regex matches, else null.

    The groups are bound to one variable, however often ``build`` uses them.
    """
    return F.element_at(F.transform(F.array(_parts(text, regex, count)), lambda p: _built(p, count, build)), 1)


class TimePattern:
    """A pattern of date and time letters as a regular expression with one group per field."""

    def __init__(self, pattern: str):
        self.pattern = pattern
        self.fields: dict[str, tuple[int, str]] = {}  # field: group, kind
        self.groups = 0
        self.regex = "\\A" + self._compile(pattern) + "\\z"

    def _field(self, name: str, body: str, kind: str = "int") -> str:
        self.groups += 1
        self.fields.setdefault(name, (self.groups, kind))
        return f"({body})"

    def _letters(self, c: str, n: int) -> str:
        digits = r"\d{1,2}" if n == 1 else r"\d{2}"
        match c:
            case "y" | "u":
                return self._field("year", r"\d{2}", "short") if n == 2 else self._field("year", r"\d{1,4}" if n == 1 else rf"\d{{{n}}}")
            case "M" | "L" if n < 3:
                return self._field("month", digits)
            case "M" | "L" if n == 3:
                return self._field("month", "|".join(_SHORT), "abbreviated")
            case "M" | "L" if n == 4:
                return self._field("month", "|".join(_LONG), "full")
            case "d" | "H" | "m" | "s" if n <= 2:
                return self._field({"d": "day", "H": "hour", "m": "minute", "s": "second"}[c], digits)
            case "h" if n <= 2:
                return self._field("half", digits)
            case "a" if n == 1:
                return self._field("noon", "AM|PM", "text")
            case "S" if n <= 9:
                return self._field("fraction", rf"\d{{{n}}}", "fraction")
            case "E" if n <= 4:
                return "(?:" + "|".join(d if n == 4 else d[:3] for d in _DAYS) + ")"
            case "X" | "x" if n <= 3:
                offset = (r"[+-]\d{2}(?:\d{2})?", r"[+-]\d{4}", r"[+-]\d{2}:\d{2}")[n - 1]
                return f"(?:Z|{offset})" if c == "X" else f"(?:{offset})"
            case "Z" if n <= 3:
                return r"(?:[+-]\d{4})"
            case "z" | "V" | "O" | "v":
                return r"(?:[A-Za-z][A-Za-z0-9/_+:\-]*)"
        raise ValueError(f"not a time pattern: {self.pattern} ({c * n})")

    def _compile(self, pattern: str) -> str:
        out, at, open_ = [], 0, 0
        while at < len(pattern):
            c = pattern[at]
            if c.isascii() and c.isalpha():
                n = len(pattern[at:]) - len(pattern[at:].lstrip(c))
                out.append(self._letters(c, n))
                at += n
            elif c == "'":
                end = at + 1
                text = ""
                while True:
                    close = pattern.find("'", end)
                    if close < 0:
                        raise ValueError(f"not a time pattern: {pattern} (open quote)")
                    text += pattern[end:close]
                    if pattern[close + 1 : close + 2] == "'" and close > at:
                        text += "'"
                        end = close + 2
                        continue
                    break
                out.append(re.escape(text) if text else "'")
                at = close + 1
            elif c == "[":
                out.append("(?:")
                open_, at = open_ + 1, at + 1
            elif c == "]":
                if not open_:
                    raise ValueError(f"not a time pattern: {pattern} (bracket)")
                out.append(")?")
                open_, at = open_ - 1, at + 1
            elif c in "{}#":
                raise ValueError(f"not a time pattern: {pattern} ({c})")
            else:
                out.append(re.escape(c) if c != " " else " ")
                at += 1
        return "".join(out) + ")?" * open_

    def dated(self) -> bool:
        return {"year", "month", "day"} <= set(self.fields)

    def _value(self, part: Callable[[int], Column], name: str) -> Column:
        if name not in self.fields:
            return F.lit(0)
        group, kind = self.fields[name]
        got = part(group)
        if kind == "short":
            return got.try_cast("int") + 2000
        if kind in ("abbreviated", "full"):
            return F.element_at(F.create_map(*[F.lit(x) for i, m in enumerate(_SHORT if kind == "abbreviated" else _LONG, 1) for x in (m, i)]), got)
        if kind == "fraction":  # its first three digits
            return F.rpad(F.substring(F.when(got != "", got).otherwise("0"), 1, 3), 3, "0").try_cast("int")
        return F.when(got != "", got.try_cast("int")).otherwise(0 if name not in ("year", "month", "day") else None)

    def shape(self, text: Column) -> Column:
        return text.rlike(self.regex)

    def millis(self, text: Column) -> Column:
        """Null for another shape, a missing date, or a time that does not exist."""
        if not self.dated():
            return F.lit(None).cast("long")
        return with_groups(text, self.regex, self.groups, self._millis)

    def _millis(self, part: Callable[[int], Column]) -> Column:
        return bound(self.places(part), _existing)

    def places(self, part: Callable[[int], Column]) -> list[Column]:
        """Year to millisecond."""
        y, mo, d, mi, s, ms = (self._value(part, f) for f in ("year", "month", "day", "minute", "second", "fraction"))
        if "hour" in self.fields or "half" not in self.fields:
            h = self._value(part, "hour")
        elif "noon" in self.fields:
            half = self._value(part, "half")
            late = part(self.fields["noon"][0]) == "PM"
            h = F.when((half >= 1) & (half <= 12), half % 12 + F.when(late, 12).otherwise(0))
        else:  # without AM or PM the hour of the day is not known, and counts as 0
            h = F.lit(0)
        return [y, mo, d, h, mi, s, ms]


def _existing(y: Column, mo: Column, d: Column, h: Column, mi: Column, s: Column, ms: Column) -> Column:
    real = F.try_make_timestamp_ntz(F.when(y > 0, y), mo, d, h, mi, F.when(s < 60, s).cast("decimal(8,6)")).isNotNull()
    return F.when(real, to_millis(y, mo, d, h, mi, s, ms))


@dataclass(frozen=True)
class CustomLayout:
    id: str
    name: str
    pattern: str
    timestamp: str
    groups: Groups
    times: TimePattern

    @property
    def regex(self) -> str:
        return whole(self.pattern, self.groups)

    def fingerprint(self) -> str:
        return f"{self.id}\n{self.pattern}\n{self.timestamp}"

    def shape(self, line: Column) -> Column:
        """Whether the whole line (without its end) matches."""
        text = without_line_end(line)
        return (text != "") & text.rlike(self.regex)

    def group(self, line: Column, name: str) -> Column:
        if name not in self.groups.names:
            return F.lit("")
        return F.regexp_extract(without_line_end(line), self.regex, self.groups.names[name])

    def parse(self, line: Column) -> Column:
        text = without_line_end(line)

        def build(part: Callable[[int], Column]) -> Column:
            ts = self.times.millis(part(self.groups.names["ts"]))
            level, thread, logger, message = (part(self.groups.names[f]) if f in self.groups.names else F.lit("") for f in FIELDS)
            made = F.struct(ts.alias("ts_millis"), logger.alias("logger"), F.upper(level).alias("level"), thread.alias("thread"), message.alias("message"))
            return F.when((text != "") & made["ts_millis"].isNotNull(), made)

        return with_groups(text, self.regex, max(self.groups.names.values()), build).cast(PARSED)

    def with_header(self, rows: DataFrame, line: Column, name: str = "head") -> DataFrame:
        """``rows`` with ``parse`` of a line in a column; every step is a projection, which Spark compiles."""
        count, held = max(self.groups.names.values()), F.col

        def cut(parts: Column, i: int) -> Column:
            return F.replace(F.get(parts, F.lit(i)), F.lit(_ESCAPED), F.lit(_HELD))

        def fits(parts: Column, count: int) -> Column:
            return (F.size(parts) == count + 1) & (F.get(parts, F.lit(0)) == "")

        def fields() -> dict[str, Column]:
            own = {n: cut(held("_head_parts"), self.groups.names[n]) if n in self.groups.names else F.lit("") for n in ("ts", *FIELDS)}
            return own | {"fits": fits(held("_head_parts"), count) & (held("_head_text") != "")}

        def stamps() -> dict[str, Column]:
            # only of lines that match: another line's parts are no fields
            return {"stamps": _parts(F.when(held("_head_fits"), held("_head_ts")), self.times.regex, self.times.groups)}

        def places() -> dict[str, Column]:
            made = self.times.places(lambda i: cut(held("_head_stamps"), i))
            return {n: F.when(fits(held("_head_stamps"), self.times.groups), c).cast("int") for n, c in zip(_TIME, made, strict=True)}

        def head() -> dict[str, Column]:
            made = F.struct(held("_head_ts_millis").alias("ts_millis"), held("_head_logger").alias("logger"), F.upper("_head_level").alias("level"), held("_head_thread").alias("thread"), held("_head_message").alias("message"))
            return {"head": F.when(held("_head_fits") & held("_head_ts_millis").isNotNull(), made).cast(PARSED)}

        steps = [lambda: {"text": without_line_end(line)}, lambda: {"parts": _parts(held("_head_text"), self.regex, count)}, fields]
        if self.times.dated():
            steps += [stamps, places, lambda: {"ts_millis": _existing(*[held(f"_head_{n}") for n in _TIME])}]
        else:
            steps += [lambda: {"ts_millis": F.lit(None).cast("long")}]
        seen = rows
        for step in [*steps, head]:
            seen = seen.withColumns({f"_head_{n}": c for n, c in step().items()})
        # a generated row, as in ``layouts.with_header``
        return seen.select(*[F.col(f"`{c}`") for c in rows.columns if c != name], F.explode(F.array("_head_head")).alias(name))


def _needed(what: str, value: str, longest: int) -> str:
    if not value:
        raise ValueError(f"{what} is missing")
    if len(value) > longest:
        raise ValueError(f"{what} is longer than {longest} characters")
    if has_control(value):
        raise ValueError(f"{what} holds control characters")
    return value


def define(id: str | None, name: str | None, pattern: str | None, timestamp: str | None, spark: SparkSession | None = None, saved: bool = True) -> CustomLayout:
    """A checked definition; ``saved=False`` (for a try) leaves the id unchecked."""
    id, pattern, timestamp = ((x or "").strip() for x in (id, pattern, timestamp))
    if saved:
        _needed("id", id, MAX_ID)
        if not is_format_id(id):
            raise ValueError(f"an id holds small letters, digits and hyphens: {id}")
        if id in LAYOUTS or id == "auto":
            raise ValueError(f"id of a built-in layout: {id}")
    label = (name or "").strip() or id
    _needed("name", label, MAX_NAME)
    _needed("pattern", pattern, MAX_PATTERN)
    _needed("timestamp", timestamp, MAX_TIMESTAMP)
    if spark is not None:
        check_pattern(spark, pattern)
    if explodes(pattern):
        raise ValueError(f"layout {id}: a repetition of the pattern can read the same text in more than one way, which takes exponential time")
    groups = scan_groups(pattern)
    if "ts" not in groups.names:
        raise ValueError("pattern has no group (?<ts>...)")
    return CustomLayout(id, label, pattern, timestamp, groups, TimePattern(timestamp))


def try_layout(spark: SparkSession, sample: str, pattern: str | None, timestamp: str | None, id: str | None = None, name: str | None = None) -> dict:
    """How a definition reads one line, and if it does not, why.

    Without a time pattern only the regular expression is tried.
    """
    timed = bool((timestamp or "").strip())
    x = define(id or "sample", name, pattern, timestamp if timed else "yyyy", spark, saved=False)
    if not sample:
        raise ValueError("there is no line to try")
    line = F.col("line")
    parsed = x.parse(line)
    ts = x.group(line, "ts")
    row = spark.createDataFrame([(sample,)], "line string").select(x.shape(line).alias("shape"), ts.alias("ts"), parsed.alias("parsed"), x.times.shape(ts).alias("timed"), *[(F.upper(x.group(line, f)) if f == "level" else x.group(line, f)).alias(f) for f in FIELDS]).first()
    out: dict = {"timestamp_checked": timed}
    if not row["shape"]:
        return out | {"matched": False, "reason": "the line does not match the pattern"}
    if not timed:
        return out | {"matched": True, "timestamp": row["ts"], **{f: row[f] for f in FIELDS}}
    if row["parsed"] is not None:
        from ..functions.times import iso

        return out | {"matched": True, "timestamp": iso(row["parsed"]["ts_millis"]), **{f: row[f] for f in FIELDS}}
    if not row["timed"]:
        return out | {"matched": False, "reason": f"the time does not have the shape {x.timestamp}"}
    if not x.times.dated():
        return out | {"matched": False, "reason": "the time pattern lacks a year, month or day"}
    return out | {"matched": False, "reason": "there is no such time"}
