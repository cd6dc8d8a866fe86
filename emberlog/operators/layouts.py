"""The five built-in line layouts as Columns that parse a line.

``parse(layout, line)`` is null for a line that is no header, else a struct (ts_millis,
logger, level, thread, message). Timestamps sit at fixed places; a zone after them is
skipped and not applied; calendar values are not checked.

A layout is a chain of steps. Each names values made from those of the steps before, so
that no value is worked out twice: ``with_header`` makes every step one projection, which
Spark compiles with its neighbours. A regular expression sees the fixed places at the
line's beginning and single short fields, never the whole line.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.strings import without_line_end
from ..functions.times import log_places, month_day_places, to_millis

#: Levels that a built-in layout accepts (fixed values).
LEVELS = ("TRACE", "DEBUG", "INFO", "WARN", "WARNING", "ERROR", "FATAL", "SEVERE", "CONFIG", "FINE", "FINER", "FINEST")
#: What thread names look like (fixed value).
THREAD_HINT = r"(?i)(?:^main(?:$|:)|exec-\d+|pool-\d+-thread-\d+|scheduler-\d+|ajp-|http-nio-|https-nio-|catalina-|-exec-\d+$)"

_DATE, _CLOCK = r"\d{4}-\d{2}-\d{2}", r"\d{2}:\d{2}:\d{2}"
_ZONE = r"\A(?:[Zz]|[+-]\d{2}:*\d{2})"
#: Characters up to the blank.
_BLANK = "".join(map(chr, range(33)))

#: Values of the steps so far, by name.
Known = Callable[[str], Column]
Step = Callable[[Known], dict[str, Column]]


@dataclass(frozen=True)
class Layout:
    id: str
    label: str
    #: Regular expression of the fixed places, and how many characters they are.
    fixed: str
    width: int
    #: Year, month, day, hour, minute, second and millisecond of a text with such places.
    places: Callable[[Column], list[Column]]
    #: Steps from ``body``, the text from the timestamp's end on (null without a
    #: timestamp), to ``logger``, ``level``, ``thread``, ``message`` and ``fits``.
    steps: tuple[Step, ...]


def _before(text: Column, at: Column) -> Column:
    return F.substring(text, F.lit(1), at - 1)


def _after(text: Column, at: Column, skip: int = 1) -> Column:
    return F.substring(text, at + skip, F.length(text))


def _blanks(x: Column) -> Column:
    """Without leading and trailing characters up to the blank."""
    return F.btrim(x, F.lit(_BLANK))


def _fields(k: Known) -> dict[str, Column]:
    return {"parts": F.split(k("body"), r"\]", 3)}


def _opened(k: Known) -> dict[str, Column]:
    part = [F.get(k("parts"), F.lit(i)) for i in range(3)]
    return {
        "first": F.substring(part[0], 2, 1 << 30),
        "level": F.upper(F.substring(part[1], 2, 1 << 30)),
        "third": F.substring(part[2], 2, 1 << 30),
        "open": part[1].startswith("[") & part[2].startswith("["),
    }


def _third_end(k: Known) -> dict[str, Column]:
    return {"end": F.instr(k("third"), "] - ")}


def _outer(k: Known) -> dict[str, Column]:
    return {"last": _before(k("third"), k("end")), "message": _after(k("third"), k("end"), 4), "fits": k("open") & (k("end") > 0)}


def _looks(k: Known) -> dict[str, Column]:
    """Which of the outer fields is the thread: by its looks, else the one without a dot, else the first."""
    a, b = k("first").rlike(THREAD_HINT), k("last").rlike(THREAD_HINT)
    return {"swap": F.when(a == b, k("first").contains(".") & ~k("last").contains(".")).otherwise(b)}


def _roles(k: Known) -> dict[str, Column]:
    return {"logger": F.when(k("swap"), k("first")).otherwise(k("last")), "thread": F.when(k("swap"), k("last")).otherwise(k("first"))}


def _zone(k: Known) -> dict[str, Column]:
    body = k("body")
    return {"body": F.ltrim(F.when(body.startswith(" "), body).otherwise(F.regexp_replace(body, _ZONE, "")))}


def _no_zone(k: Known) -> dict[str, Column]:
    return {"body": F.ltrim(k("body"))}


def _bracket(k: Known) -> dict[str, Column]:
    """What stands before the first bracket."""
    return {"lead": F.substring_index(k("body"), "[", 1)}


def _inside(k: Known) -> dict[str, Column]:
    return {"inner": F.substring(k("body"), F.length(k("lead")) + 2, F.length(k("body")))}


def _closed(k: Known) -> dict[str, Column]:
    return {"close": F.instr(k("inner"), "]")}


def _thread(k: Known) -> dict[str, Column]:
    return {"thread": _blanks(_before(k("inner"), k("close"))), "rest": F.ltrim(_after(k("inner"), k("close")))}


def _spring(k: Known) -> dict[str, Column]:
    return {"level": F.upper(F.substring_index(k("lead"), " ", 1)), "end": F.instr(k("rest"), " : "), "shaped": k("lead").rlike(r"\A[^ ]++ *+\d*+ *+--- *+\z")}


def _either(k: Known) -> dict[str, Column]:
    # either [thread] LEVEL, with nothing before the bracket, or LEVEL [thread]
    return {"word": F.when(k("lead") == "", F.substring_index(k("rest"), " ", 1)).otherwise("")}


def _level(k: Known) -> dict[str, Column]:
    front = k("lead") == ""
    return {
        "level": F.upper(F.when(front, k("word")).otherwise(F.rtrim(k("lead")))),
        "shaped": front | k("lead").endswith(" "),
        "rest": F.when(front, F.ltrim(_after(k("rest"), F.length(k("word"))))).otherwise(k("rest")),
    }


def _dash(k: Known) -> dict[str, Column]:
    return {"end": F.instr(k("rest"), " - ")}


def _named(k: Known) -> dict[str, Column]:
    return {"logger": _blanks(_before(k("rest"), k("end"))), "message": _after(k("rest"), k("end"), 3), "fits": k("shaped") & (k("close") > 0) & (k("end") > 0)}


def _word(k: Known) -> dict[str, Column]:
    return {"level": F.upper(F.rtrim(k("lead"))), "logger": F.substring_index(k("rest"), " ", 1)}


def _rest(k: Known) -> dict[str, Column]:
    return {"message": _after(k("rest"), F.length(k("logger")), 2), "fits": k("lead").endswith(" ") & (k("close") > 0) & (k("rest") != "")}


_THREADED = (_bracket, _inside, _closed, _thread)
_DASHED = (*_THREADED, _either, _level, _dash, _named)

LAYOUTS = {
    x.id: x
    for x in (
        Layout("default", "date time[thread][LEVEL][logger] - message", rf"\A{_DATE} {_CLOCK}\.\d{{3}}\[", 23, log_places, (_fields, _opened, _third_end, _outer, _looks, _roles)),
        Layout("spring-boot", "date time LEVEL pid --- [thread] logger : message", rf"\A{_DATE}[ T]{_CLOCK}\.\d{{3}}[ +\-Zz]", 23, log_places, (_zone, *_THREADED, _spring, _named)),
        Layout("logback", "date time LEVEL [thread] logger - message", rf"\A{_DATE} {_CLOCK}[.,]\d{{3}} ", 23, log_places, (_no_zone, *_DASHED)),
        Layout("iso8601", "dateTtime LEVEL [thread] logger - message", rf"\A{_DATE}T{_CLOCK}[.,]\d{{3}}[ +\-Zz]", 23, log_places, (_zone, *_DASHED)),
        Layout("tomcat-juli", "dd-MMM-yyyy time LEVEL [thread] logger message", rf"\A\d{{2}}-[A-Za-z]{{3}}-\d{{4}} {_CLOCK}\.\d{{3}} ", 24, month_day_places, (_no_zone, *_THREADED, _word, _rest)),
    )
}

PARSED = "struct<ts_millis:bigint,logger:string,level:string,thread:string,message:string>"
_TIME = ("year", "month", "day", "hour", "minute", "second", "milli")


def _chain(x: Layout, line: Column) -> tuple[Step, ...]:
    def text(k: Known) -> dict[str, Column]:
        return {"text": without_line_end(line)}

    def fixed(k: Known) -> dict[str, Column]:
        # bytes that are no text become the replacement character
        stamped = F.substring(k("text"), 1, x.width + 1).rlike(x.fixed)
        return {"stamp": F.when(stamped, F.substring(k("text"), 1, x.width)), "body": F.when(stamped, F.make_valid_utf8(F.substring(k("text"), x.width + 1, 1 << 30)))}

    def time(k: Known) -> dict[str, Column]:
        return {n: c.cast("int") for n, c in zip(_TIME, x.places(k("stamp")), strict=True)}

    def millis(k: Known) -> dict[str, Column]:
        return {"ts_millis": to_millis(*[k(n) for n in _TIME])}

    def head(k: Known) -> dict[str, Column]:
        made = F.struct(*[k(n).alias(n) for n in ("ts_millis", "logger", "level", "thread", "message")])
        return {"head": F.when(k("fits") & k("level").isin(*LEVELS) & k("ts_millis").isNotNull(), made).cast(PARSED)}

    return (text, fixed, time, millis, *x.steps, head)


def parse(layout: str, line: Column) -> Column:
    """Header fields of a line (its end is ignored), or null.

    One Column, which Spark interprets; ``with_header`` is several times faster.
    """

    def bound(steps: tuple[Step, ...], known: Known) -> Column:
        if not steps:
            return known("head")
        made = steps[0](known)
        row = F.array(F.struct(*[c.alias(n) for n, c in made.items()]))
        return F.element_at(F.transform(row, lambda r: bound(steps[1:], lambda n: r[n] if n in made else known(n))), 1)

    return bound(_chain(LAYOUTS[layout], line), F.col)


def with_header(rows: DataFrame, layout: str, line: Column, name: str = "head") -> DataFrame:
    """``rows`` with the same in a column."""
    seen = rows
    for step in _chain(LAYOUTS[layout], line):
        seen = seen.withColumns({f"_head_{n}": c for n, c in step(lambda n: F.col(f"_head_{n}")).items()})
    # a generated row, so that conditions on the header are not worked out from the line again
    return seen.select(*[F.col(f"`{c}`") for c in rows.columns if c != name], F.explode(F.array("_head_head")).alias(name))
