"""Requests of one thread of one file, as spans of positions in its rows.

Rows are arrays in the order of time and line. Look-ups of all anchors at once give what
each would make by itself; then one step per request leads from it to the next anchor that
is free: an anchor inside a request's lines belongs to it and is leapt over. Sessions are
the runs between anchors that lie further apart than the reach. Only where a thread's lines
run against its times are rows compared line by line.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import NamedTuple

import numpy as np


class Rows(NamedTuple):
    ts: np.ndarray
    line: np.ndarray
    anchor: np.ndarray
    start: np.ndarray
    end: np.ndarray
    has: np.ndarray
    hasnt: np.ndarray


class Rule(NamedTuple):
    """What requests are made by; ``most`` is how many of a thread are wanted at most."""

    sessions: bool
    reach: int
    before: int
    rows: int
    contains: bool
    excludes: bool
    most: int | None = None


@dataclass
class Span:
    at: np.ndarray  # positions of its rows
    by: np.ndarray  # of each row the anchor (its number) that brought it
    started: bool = False
    reason: str = "standalone"
    cut: bool = False
    full: bool = False


def first_true(flags: np.ndarray, begin: int) -> int:
    """The first place from ``begin`` on that is true, or the length; looks ahead in growing steps."""
    step = 64
    while begin < len(flags):
        part = flags[begin : begin + step]
        k = int(part.argmax())
        if part[k]:
            return begin + k
        begin, step = begin + step, step * 4
    return len(flags)


def last_below(marks: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The last of the sorted ``marks`` below each position, or -1."""
    return np.concatenate([[-1], marks])[np.searchsorted(marks, at)]


class Thread:
    def __init__(self, rows: Rows, rule: Rule, named: bool, free: np.ndarray):
        """``free``: whether each anchor may make a request; ``named``: whether the thread has a name."""
        self.rows, self.rule, self.named = rows, rule, named
        self.anchors = np.flatnonzero(rows.anchor)
        self.lines, self.times = rows.line[self.anchors], rows.ts[self.anchors]
        self.free = free.copy()
        self.owner = np.full(len(self.anchors), -1)  # the request that each anchor belongs to
        self.inside = np.full(len(self.anchors), -1)  # the first settled request whose lines hold the anchor's
        self.steady = bool((np.diff(rows.line) > 0).all())
        self.spans: list[Span] = []
        self.asked: dict[int, list[int]] = {}  # anchors that would have made a request of their own but for a full one

    def resolve(self) -> list[Span]:
        (self._sessions if self.rule.sessions else self._segments)()
        return self.spans

    def last_line(self) -> int:
        return int(self.rows.line[self.spans[-1].at[-1]]) if self.spans else -1

    def done(self) -> bool:
        return self.rule.most is not None and len(self.spans) >= self.rule.most

    def settle(self, k: int, i: int) -> None:
        """Anchors after the i-th that lie in the lines of request k, and in no earlier one's, are inside it."""
        first, last = (int(self.rows.line[self.spans[k].at[p]]) for p in (0, -1))
        if self.steady:
            a, b = np.searchsorted(self.lines, [first, last + 1]).tolist()
            at = slice(max(a, i + 1), max(b, i + 1))
            hit = self.inside[at] < 0
        else:
            at = slice(i + 1, None)
            hit = (self.inside[at] < 0) & (self.lines[at] >= first) & (self.lines[at] <= last)
        self.inside[at][hit] = k
        self.free[at] &= ~hit

    # between start and end patterns

    def _segments(self) -> None:
        ts, line, a = self.rows.ts, self.rows.line, self.anchors
        starts, ends = np.flatnonzero(self.rows.start), np.flatnonzero(self.rows.end)
        own = self.rows.start[a]
        low = np.searchsorted(ts, ts[a] - self.rule.reach)
        started_at, ended_at, room = last_below(starts, a), last_below(ends, a), a - 1 - self.rule.before
        stop = np.maximum.reduce([started_at, ended_at, room, low - 1])
        started = own | ((started_at == stop) & (ended_at != stop) & (stop >= low))
        cut = ~own & (room == stop) & (started_at != stop) & (ended_at != stop) & (stop >= low)
        begin = np.where(own, a, np.where(started, stop, stop + 1))
        following = np.append(starts, len(ts))[np.searchsorted(starts, a, "right")]
        ending = np.append(ends, len(ts))[np.searchsorted(ends, a)]
        i = 0
        while not self.done() and (i := first_true(self.free, i)) < len(a):
            p, b, s, c = int(a[i]), int(begin[i]), bool(started[i]), bool(cut[i])
            if not self.named:
                self._add(i, Span(a[i : i + 1], np.array([i])))
                continue
            if self.spans and not own[i]:
                # rows that the request before holds end the way back
                from_ = max(int(stop[i]), int(low[i]))
                held = np.flatnonzero(line[from_:p] <= self.last_line())
                if len(held) and self.spans[-1].full:
                    self.owner[i], self.free[i] = len(self.spans) - 1, False
                    self.asked.setdefault(len(self.spans) - 1, []).append(i)
                    continue
                if len(held):
                    b, s, c = from_ + int(held[-1]) + 1, False, False
            out_of_time = int(np.searchsorted(ts, ts[b] + self.rule.reach, "right"))
            nxt, end, full = int(following[i]), int(ending[i]), b + self.rule.rows
            if end < min(nxt, full, out_of_time):
                to, reason = end + 1, "end"
            elif nxt <= full and nxt < out_of_time:
                to, reason = nxt, "next_start"
            else:
                to, reason = min(full, out_of_time), "not_found"
            filled = reason == "not_found" and full < out_of_time
            if s or c or filled or reason == "end":
                self._add(i, Span(np.arange(b, to), np.full(to - b, i), s, reason, c or filled, filled))
            else:
                self._add(i, Span(a[i : i + 1], np.array([i])))
        inside = self.owner < 0
        self.owner[inside] = self.inside[inside]

    def _add(self, i: int, span: Span) -> None:
        self.spans.append(span)
        self.owner[i], self.free[i] = len(self.spans) - 1, False
        self.settle(len(self.spans) - 1, i)

    # around anchors

    def _sessions(self) -> None:
        ts, line, a, rule = self.rows.ts, self.rows.line, self.anchors, self.rule
        # the run of each anchor ends before the next gap longer than the reach
        gaps = np.append(np.flatnonzero(np.diff(self.times) > rule.reach) + 1, len(a))
        i = first_true(self.free, 0)
        while i < len(a) and not self.done():
            p, floor = int(a[i]), self.last_line()
            if self.spans:
                self.settle(len(self.spans) - 1, i)
            self.owner[i] = len(self.spans)
            if not self.named:  # a row without a thread is always alone
                self.spans.append(Span(a[i : i + 1], np.array([i])))
                i = first_true(self.free, i + 1)
                continue
            low = int(np.searchsorted(ts, ts[p] - rule.reach))
            early = np.arange(low + int(np.append(-1, np.flatnonzero(line[low:p] <= floor))[-1]) + 1, p)
            early = early[line[early] < line[p]]
            span = Span(early[max(0, len(early) - rule.before) :], np.full(min(len(early), rule.before), i), False, "window", len(early) > rule.before)
            self.spans.append(span)
            edge = self._take(span, i, int(np.searchsorted(ts, ts[p])), int(ts[p]) + rule.reach, max(floor, int(line[p]) - 1))
            i = self._grow(i + 1, edge, int(ts[p]), gaps)

    def _take(self, span: Span, i: int, low: int, upto: int, floor: int) -> int:
        """Rows from a position to a time that lie below line ``floor``, as far as there is room."""
        more = np.arange(low, int(np.searchsorted(self.rows.ts, upto, "right")))
        if not self.steady:
            more = more[self.rows.line[more] > floor]
        elif len(more):
            more = more[int(np.searchsorted(self.rows.line[more], floor, "right")) :]
        room = self.rule.rows - len(span.at)
        if len(more) > room:
            span.cut = span.full = True
        span.at, span.by = np.concatenate([span.at, more[:room]]), np.concatenate([span.by, np.full(len(more[:room]), i)])
        return upto

    def _grow(self, i: int, edge: int, latest: int, gaps: np.ndarray) -> int:
        """Anchors that go on with the last request; the next one that makes another, or the end."""
        span, k, reach = self.spans[-1], len(self.spans) - 1, self.rule.reach
        while i < len(self.anchors):
            if self.times[i] - latest <= reach:
                to = int(gaps[np.searchsorted(gaps, i, "right")])
                if self.steady:
                    # all rows up to the last anchor's reach, each brought by the first anchor that reaches it
                    n = len(span.at)
                    low = int(np.searchsorted(self.rows.ts, edge, "right"))
                    edge = max(edge, self._take(span, i, low, int(self.times[to - 1]) + reach, self.last_line()))
                    span.by[n:] = i + np.searchsorted(self.times[i:to] + reach, self.rows.ts[span.at[n:]])
                else:
                    for j in range(i, to):
                        edge = self._further(span, j, edge)
                self.owner[i:to], latest, i = k, int(self.times[to - 1]), to
                continue
            later = slice(i, None)
            if self.steady:
                return first_true(self.free, i)
            joins = self.lines[later] <= self.last_line()
            j = i + first_true(joins | self.free[later], 0)
            between = slice(i, j)
            self.owner[between] = self.inside[between]
            if j == len(self.anchors) or not joins[j - i]:
                return j
            edge = self._further(span, j, edge)
            self.owner[j], latest, i = k, max(latest, int(self.times[j])), j + 1
        return i

    def _further(self, span: Span, j: int, edge: int) -> int:
        upto = int(self.times[j]) + self.rule.reach
        return self._take(span, j, int(np.searchsorted(self.rows.ts, edge, "right")), upto, self.last_line()) if upto > edge else edge

    # what the filter says of a request while it grows

    def turns(self, k: int) -> list[tuple[int, bool | None]]:
        """(anchor, passes) when request k is made and whenever rows that came changed that or may still change it.

        An anchor that asked for a request of its own is told with None.
        """
        span, c, x = self.spans[k], self.rule.contains, self.rule.excludes
        asked: list[tuple[int, bool | None]] = [(i, None) for i in self.asked.get(k, [])]
        if not (c or x):
            return [(int(span.by[0]), True), *asked]
        good = np.logical_or.accumulate(self.rows.has[span.at]) if c else np.ones(len(span.at), bool)
        bad = np.logical_or.accumulate(self.rows.hasnt[span.at]) if x else np.zeros(len(span.at), bool)
        last = np.flatnonzero(np.append(span.by[1:] != span.by[:-1], True))
        passes = (good & ~bad)[last]
        keep = passes | np.concatenate([[True], passes[:-1]])
        return [*zip(span.by[last][keep].tolist(), passes[keep].tolist(), strict=True), *asked]
