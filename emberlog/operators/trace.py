"""Requests around the occurrences of an identifier.

An anchor is an entry whose text holds the identifier (in this case). Its context is its
file and thread. In BOUNDARY mode the request runs from the nearest start pattern before
the anchor to the end pattern, or the next start, after it; in WINDOW mode it is the rows
within some seconds of anchors that follow one another.

Anchors are written first. Rounds take the anchors up to a time, ``FIRST`` times as many as
requests may be tried, then eight times as many, and so on, until a limit bites or all are
taken; a round reads the rows of the anchors' stretches of time only, so what is read does
not grow with the anchors once a limit bites. The rows of a context meet sorted in one
task, as numbers and flags without texts, and ``spans`` finds its requests; contexts are
independent but for the limits over all of them.

Those are applied on the driver to the first ``examined`` + 1 requests in the order in
which they are made, with what the request filter says of each whenever it grows. From the
anchor on at which a limit bites, no request is made (until an excluded one leaves room
again): the spans are found once more with these times barred, so that later anchors join
what there is. In WINDOW mode with an ``excludes`` filter all anchors are one round.
"""


from __future__ import annotations

from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.strings import find_ignoring_case, holds
from ..sources import scratch
from . import postings as text_index
from . import spans
from .custom import check_pattern

#: Limits (fixed values).
MAX_REQUESTS, MAX_EXAMINED, MAX_ROWS, MAX_BEFORE = 200, 2000, 1000, 500


@dataclass(frozen=True)
class Limits:
    requests: int = MAX_REQUESTS
    examined: int = MAX_EXAMINED
    rows: int = MAX_ROWS
    before: int = MAX_BEFORE


@dataclass(frozen=True)
class Trace:
    """What to look for; ``boundary`` and ``window`` make checked ones."""

    id: str
    mode: str
    start: str = ""
    end: str = ""
    reach_ms: int = 0
    contains: str = ""
    excludes: str = ""
    limits: Limits = field(default_factory=Limits)

    def filtered(self, contains: str | None = None, excludes: str | None = None) -> Trace:
        return replace(self, contains=contains or "", excludes=excludes or "")


def _id(text: str | None) -> str:
    if not (text or "").strip():
        raise ValueError("an identifier is needed")
    return text.strip()


def boundary(id: str, start: str, end: str, minutes: int = 10) -> Trace:
    if not start or not end:
        raise ValueError("start and end patterns are needed")
    if not 1 <= minutes <= 1440:
        raise ValueError("minutes are 1 to 1440")
    return Trace(_id(id), "boundary", start, end, minutes * 60_000)


def window(id: str, seconds: int = 10) -> Trace:
    if not 1 <= seconds <= 3600:
        raise ValueError("seconds are 1 to 3600")
    return Trace(_id(id), "window", reach_ms=seconds * 1000)


@dataclass
class Result:
    anchor_total: int
    truncated: bool
    filtered_out: int
    requests: DataFrame  # req_no, source, thread, start_found, end_reason, truncated, n_rows, n_anchors
    rows: DataFrame  # req_no, pos, file_id, line_no, ts_millis, level, logger, thread, message, anchor


CONTEXT = ("file_id", "thread")
KEY = ("ts_millis", "file_id", "line_no")
#: Anchors of the first round for each request that may be tried.
FIRST = 8
#: Rows of a context that are held before those far from anchors go.
HELD = 1 << 20

HEADS = pa.schema(
    [("file_id", pa.int64()), ("thread", pa.string()), ("req", pa.int64()), ("c_ts", pa.int64()), ("start_found", pa.bool_()), ("end_reason", pa.string()), ("truncated", pa.bool_()), ("n_rows", pa.int64()), ("n_anchors", pa.int64()),
     ("first_ts", pa.int64()), ("first_line", pa.int64()), ("last_ts", pa.int64()), ("last_line", pa.int64()), ("turn_ts", pa.list_(pa.int64())), ("turn_line", pa.list_(pa.int64())), ("turn_kept", pa.list_(pa.bool_()))]
)
#: A row for each member of each request; ``req`` is the line of the anchor that made it.
MEMBERS = pa.schema(
    [("file_id", pa.int64()), ("thread", pa.string()), ("req", pa.int64()), ("start_found", pa.bool_()), ("end_reason", pa.string()), ("truncated", pa.bool_()), ("kept", pa.bool_()), ("n_anchors", pa.int64()),
     ("pos", pa.int64()), ("line_no", pa.int64()), ("ts_millis", pa.int64()), ("joined", pa.bool_())]
)
_DDL = {pa.int64(): "long", pa.string(): "string", pa.bool_(): "boolean", pa.list_(pa.int64()): "array<long>", pa.list_(pa.bool_()): "array<boolean>"}

Key = tuple[int, int, int]
#: Times (first key, last key or None) in which no request is made.
Barred = list[tuple[Key, Key | None]]


def _schema(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {_DDL[f.type]}" for f in schema)


def anchors_of(entries: DataFrame, spec: Trace, postings: DataFrame | None = None) -> DataFrame:
    return text_index.narrowed(entries, postings, spec.id).where(holds(F.col("raw"), spec.id)).select(*CONTEXT, "ts_millis", "line_no")


def flagged(entries: DataFrame, anchors: DataFrame, spec: Trace) -> DataFrame:
    """Entries in reach of an anchor of their context, as numbers and flags."""
    stretch = F.floor(F.col("ts_millis") / spec.reach_ms)
    # no request reaches further from an anchor than reach_ms: only its stretch of time and the two beside it count
    near = anchors.select(*CONTEXT, F.explode(F.array(stretch - 1, stretch, stretch + 1)).alias("stretch")).distinct()
    text = [c for c, on in (("message", spec.mode == "boundary"), ("raw", True)) if on]
    rows = entries.select(*CONTEXT, "ts_millis", "line_no", *text).withColumn("stretch", stretch).join(near, [*CONTEXT, "stretch"])
    none = F.lit(False)
    return rows.select(
        *CONTEXT,
        "ts_millis",
        "line_no",
        holds(F.col("raw"), spec.id).alias("is_anchor"),
        (find_ignoring_case(F.col("message"), spec.start) if spec.mode == "boundary" else none).alias("is_start"),
        (find_ignoring_case(F.col("message"), spec.end) if spec.mode == "boundary" else none).alias("is_end"),
        (find_ignoring_case(F.col("raw"), spec.contains) if spec.contains else none).alias("has"),
        (find_ignoring_case(F.col("raw"), spec.excludes) if spec.excludes else none).alias("hasnt"),
    )


def _at_or_after(ts: np.ndarray, line: np.ndarray, file_id: int, key: Key) -> np.ndarray:
    return (ts > key[0]) | ((ts == key[0]) & ((file_id > key[1]) | ((file_id == key[1]) & (line >= key[2]))))


def may_make(ts: np.ndarray, line: np.ndarray, file_id: int, barred: Barred) -> np.ndarray:
    """Whether each anchor of a file lies outside the barred times (a time ends with its last key)."""
    free = np.ones(len(ts), bool)
    for begin, end in barred:
        past = np.zeros(len(ts), bool) if end is None else _at_or_after(ts, line, file_id, (end[0], end[1], end[2] + 1))
        free &= ~_at_or_after(ts, line, file_id, begin) | past
    return free


def _near_anchors(rows: spans.Rows, rule: spans.Rule) -> spans.Rows:
    """Rows that no request can hold go: those with too many rows between them and any anchor."""
    if rule.sessions and not (np.diff(rows.line) > 0).all():
        return rows
    index, a = np.arange(len(rows.ts)), np.flatnonzero(rows.anchor)
    past = index - np.concatenate([[-rule.rows - 2], a])[np.searchsorted(a, index, "right")]
    ahead = np.append(a, len(index))[np.searchsorted(a, index)] - index  # an anchor may still follow the last row
    on = (past <= rule.rows + 1) | (ahead <= rule.before + 2)
    return spans.Rows(*(x[on] for x in rows))


def _contexts(batches, rule: spans.Rule):
    """(file, thread, rows) of each context of sorted batches."""
    held: list[spans.Rows] = []
    who, n = None, 0

    def whole() -> spans.Rows:
        return spans.Rows(*(np.concatenate(x) for x in zip(*held, strict=True)))

    for b in batches:
        if not b.num_rows:
            continue
        file_id, thread = b.column("file_id").to_numpy(), b.column("thread")
        rows = spans.Rows(*(b.column(c).to_numpy(zero_copy_only=False) for c in ("ts_millis", "line_no", "is_anchor", "is_start", "is_end", "has", "hasnt")))
        other = pc.not_equal(thread.slice(1), thread.slice(0, len(thread) - 1)).to_numpy(zero_copy_only=False)
        edges = [0, *(np.flatnonzero((file_id[1:] != file_id[:-1]) | other) + 1).tolist(), b.num_rows]
        for s, e in zip(edges, edges[1:]):
            own = (int(file_id[s]), thread[s].as_py())
            if who is not None and own != who:
                yield *who, whole()
                held, n = [], 0
            who = own
            held.append(spans.Rows(*(x[s:e] for x in rows)))
            n += e - s
            if n > HELD:
                held = [_near_anchors(whole(), rule)]
                n = len(held[0].ts) // 2  # looked at again when as many more have come
    if who is not None:
        yield *who, whole()


def _rule(spec: Trace, most: int | None = None) -> spans.Rule:
    return spans.Rule(spec.mode == "window", spec.reach_ms, spec.limits.before, spec.limits.rows, bool(spec.contains), bool(spec.excludes), most)


def _found(rows: DataFrame, rule: spans.Rule, schema: pa.Schema, out, barred: Barred = []) -> DataFrame:  # noqa: B006
    """What ``out`` tells of each context's requests."""

    def run(batches):
        made: list[list] = []
        for file_id, thread, x in _contexts(batches, rule):
            t = spans.Thread(x, rule, thread != "", may_make(x.ts[x.anchor], x.line[x.anchor], file_id, barred))
            found = t.resolve()
            n = np.bincount(t.owner[t.owner >= 0], minlength=len(found))
            for k, span in enumerate(found):
                out(made, file_id, thread, t, k, span, int(n[k]))
                if len(made) >= 256:
                    yield _batch(schema, made)
                    made = []
        if made:
            yield _batch(schema, made)

    sorted_rows = rows.repartition("file_id", "thread").sortWithinPartitions("file_id", "thread", "ts_millis", "line_no")
    return sorted_rows.mapInArrow(run, _schema(schema))


def _batch(schema: pa.Schema, made: list[list]) -> pa.RecordBatch:
    """Records of single values, or of arrays that single values are repeated along."""
    columns = []
    for i, f in enumerate(schema):
        if isinstance(made[0][-1], np.ndarray):
            sizes = [len(r[-1]) for r in made]
            if isinstance(made[0][i], np.ndarray):
                columns.append(pa.array(np.concatenate([r[i] for r in made]), f.type))
            else:
                columns.append(pa.array([r[i] for r in made], f.type).take(pa.array(np.repeat(np.arange(len(made)), sizes))))
        else:
            columns.append(pa.array([r[i] for r in made], f.type))
    return pa.RecordBatch.from_arrays(columns, schema=schema)


def _head(made, file_id, thread, t: spans.Thread, k: int, span: spans.Span, n: int) -> None:
    r, turns = t.rows, t.turns(k)
    by = [t.anchors[i] for i, _ in turns]
    first, last, own = span.at[0], span.at[-1], t.anchors[int(span.by[0])]
    made.append([file_id, thread, int(r.line[own]), int(r.ts[own]), span.started, span.reason, span.cut, len(span.at), n, int(r.ts[first]), int(r.line[first]), int(r.ts[last]), int(r.line[last]), [int(r.ts[p]) for p in by], [int(r.line[p]) for p in by], [kept for _, kept in turns]])


def _members(chosen: frozenset | None):
    def out(made, file_id, thread, t: spans.Thread, k: int, span: spans.Span, n: int) -> None:
        r = t.rows
        req = int(r.line[t.anchors[int(span.by[0])]])
        if chosen is None or (file_id, thread, req) in chosen:
            mine = np.isin(span.at, t.anchors[t.owner == k]) if not t.steady else r.anchor[span.at] & (t.owner[np.minimum(np.searchsorted(t.anchors, span.at), len(t.anchors) - 1)] == k)
            made.append([file_id, thread, req, span.started, span.reason, span.cut, [kept for _, kept in t.turns(k) if kept is not None][-1], n, np.arange(len(span.at)), r.line[span.at], r.ts[span.at], mine])

    return out


def members(entries: DataFrame, spec: Trace) -> DataFrame:
    """A row for each member of each request, without the limits over all contexts."""
    rows, _ = scratch.save(flagged(entries, anchors_of(entries, spec), spec))
    return _found(rows, _rule(spec), MEMBERS, _members(None))


@dataclass
class _Course:
    """How the limits and the filter go over requests in the order of their making."""

    kept: list[bool]
    bites: Key | None = None  # an anchor that may not make a request
    room: Key | None = None  # after a limit bit, an anchor that leaves room again
    refused: bool = False


def _course(heads: list, limits: Limits, since: Key | None) -> _Course:
    steps = sorted(((ts, h.file_id, line), nth, i, kept) for i, h in enumerate(heads) for nth, (ts, line, kept) in enumerate(zip(h.turn_ts, h.turn_line, h.turn_kept, strict=True)))
    out, shown, tried = _Course([False] * len(heads)), 0, 0
    for key, nth, i, kept in steps:
        if nth == 0 or kept is None:
            if shown >= limits.requests or tried >= limits.examined:
                out.bites = key
                return out
            if kept is None:
                continue
            tried += 1
        elif kept and not out.kept[i] and shown >= limits.requests:
            out.refused = True
            continue
        shown += kept - out.kept[i]
        out.kept[i] = kept
        if nth and not kept and since is not None and key > since and shown < limits.requests and tried < limits.examined:
            out.room = key
            return out
    return out


def bar(barred: Barred, course: _Course) -> bool:
    """Whether a limit bit, or left room again, so that the spans must be found once more."""
    if course.bites:
        barred.append((course.bites, None))
    elif course.room:
        barred[-1] = (barred[-1][0], course.room)
    return bool(course.bites or course.room)


def _settled(rows: DataFrame, spec: Trace, barred: Barred) -> tuple[list, _Course]:
    """The requests within the limits; ``barred`` gains the times at which none could be made."""
    while True:
        found = _found(rows, _rule(spec, spec.limits.examined + 1), HEADS, _head, barred)
        # at most this many can be tried, so one bounded top-k holds all that can survive
        heads = found.orderBy("c_ts", "file_id", "req").limit(spec.limits.examined + 1).collect()
        course = _course(heads, spec.limits, barred[-1][0] if barred and barred[-1][1] is None else None)
        if not bar(barred, course):
            return heads, course


def run(entries: DataFrame, files: DataFrame, spec: Trace, postings: DataFrame | None = None) -> Result:
    """Anchors (by the text index, if there is one), requests in time order, and their rows."""
    spark = entries.sparkSession
    for p in (spec.start, spec.end, spec.contains, spec.excludes):
        if p:
            check_pattern(spark, p)
    entries = entries.withColumn("thread", F.coalesce("thread", F.lit("")))
    anchors, anchors_path = scratch.save(anchors_of(entries, spec, postings))
    total, barred = anchors.count(), Barred()
    wanted = total if spec.mode == "window" and spec.excludes else FIRST * spec.limits.examined
    while True:
        until = None if total <= wanted else anchors.select("ts_millis").orderBy("ts_millis").limit(wanted).agg(F.max("ts_millis")).first()[0]
        some = anchors if until is None else anchors.where(F.col("ts_millis") <= until)
        reached = entries if until is None else entries.where(F.col("ts_millis") <= until + spec.reach_ms)
        rows, path = scratch.save(flagged(reached, some, spec))
        if until is not None:  # anchors past the round's time wait for the next
            rows = rows.withColumn("is_anchor", F.col("is_anchor") & (F.col("ts_millis") <= until))
        heads, course = _settled(rows, spec, barred)
        if barred or until is None:
            break
        scratch.drop(spark, path)
        wanted *= 8
    if until is not None:
        rows, more_path = scratch.save(_late(entries, rows, anchors, heads, until, spec))
        scratch.drop(spark, path)
        path = more_path
        heads, course = _settled(rows, spec, barred)
    shown = sorted((h for h, kept in zip(heads, course.kept, strict=True) if kept), key=lambda h: (h.first_ts, h.file_id, h.first_line))
    chosen = frozenset((h.file_id, h.thread, h.req) for h in shown)
    number = spark.createDataFrame([(i, h.file_id, h.thread, h.req, h.start_found, h.end_reason, h.truncated, h.n_rows, h.n_anchors) for i, h in enumerate(shown, 1)], "req_no int, file_id long, thread string, req long, start_found boolean, end_reason string, truncated boolean, n_rows long, n_anchors long")
    held, _ = scratch.save(_found(rows, _rule(spec, spec.limits.examined + 1), MEMBERS, _members(chosen), barred).join(F.broadcast(number.select("req_no", *CONTEXT, "req")), [*CONTEXT, "req"]).select("req_no", "pos", "file_id", "line_no", "ts_millis", "thread", F.col("joined").alias("anchor")))
    for p in (path, anchors_path):
        scratch.drop(spark, p)
    requests = number.join(files.select("file_id", F.col("path").alias("source")), "file_id").select("req_no", "source", "thread", "start_found", "end_reason", "truncated", "n_rows", "n_anchors")
    least, most = (min((h.first_ts for h in shown), default=0), max((h.last_ts for h in shown), default=0))
    named = entries.where(F.col("ts_millis").between(least, most)).select("file_id", "line_no", "level", "logger", "message")
    out = held.join(named, ["file_id", "line_no"]).select("req_no", "pos", "file_id", "line_no", "ts_millis", "level", "logger", "thread", "message", "anchor").orderBy("req_no", "pos")
    return Result(total, bool(barred) or course.refused, course.kept.count(False), requests.orderBy("req_no"), out)


def _late(entries: DataFrame, rows: DataFrame, anchors: DataFrame, heads: list, until: int, spec: Trace) -> DataFrame:
    """The rows of the contexts that have requests, with the anchors that came after the last round's time."""
    last: dict[tuple[int, str], int] = {}
    for h in heads:
        last[h.file_id, h.thread] = max(last.get((h.file_id, h.thread), -1), h.last_line)
    own = F.broadcast(entries.sparkSession.createDataFrame([(*k, v) for k, v in last.items()], "file_id long, thread string, last_line long"))  # a row for each request tried at most
    late = anchors.where(F.col("ts_millis") > until).join(own, [*CONTEXT])
    if spec.mode == "window":
        every = anchors.join(own, [*CONTEXT], "left_semi")
        return flagged(entries.join(own, [*CONTEXT], "left_semi"), every, spec)
    # no request is made any more, so an anchor counts only within a request's lines
    inside = late.where("line_no <= last_line").select(*CONTEXT, "ts_millis", "line_no", F.lit(True).alias("is_anchor"), *[F.lit(False).alias(c) for c in ("is_start", "is_end", "has", "hasnt")])
    kept = rows.join(own, [*CONTEXT], "left_semi")
    # rows beside the last round's anchors are there already; of them the late anchors are marked
    marked = kept.join(inside.select(*CONTEXT, "line_no", F.lit(True).alias("is_late")), [*CONTEXT, "line_no"], "left").withColumn("is_anchor", F.col("is_anchor") | F.coalesce("is_late", F.lit(False))).select(inside.columns)
    return marked.unionByName(inside.join(kept, [*CONTEXT, "line_no"], "left_anti"))
