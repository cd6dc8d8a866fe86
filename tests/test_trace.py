"""Traces: the rules one by one on written cases, and both ways of finding requests against each other."""

import random

import numpy as np
import pytest
from pyspark.sql import Row

from emberlog.operators import spans, trace

SCHEMA = "file_id long, line_no long, ts_millis long, level string, logger string, thread string, message string, raw string"
SMALL = trace.Limits(requests=2, examined=3, rows=5, before=2)


def entries(spark, rows):
    """From (line, second, text) or (line, second, text, thread, file): S, E and ID mark starts, ends and anchors."""
    full = [(*r, "t", 1)[:5] if len(r) == 3 else (*r, 1)[:5] for r in rows]
    return spark.createDataFrame([(f, line, int(s * 1000), "INFO", "l", thread, x, x) for line, s, x, thread, f in full], SCHEMA)


def shown(spark, rows, spec):
    """(lines, anchors, reason, start found, truncated) of each request in order, and the result."""
    files = spark.createDataFrame([(1, "/a.log"), (2, "/b.log")], "file_id long, path string")
    out = trace.run(entries(spark, rows), files, spec)
    lines, anchors = {}, {}
    for r in out.rows.collect():
        lines.setdefault(r.req_no, []).append(r.line_no)
        anchors.setdefault(r.req_no, []).extend([r.line_no] * r.anchor)
    return [(lines[q.req_no], anchors[q.req_no], q.end_reason, q.start_found, q.truncated) for q in out.requests.collect()], out


def between(seconds=60, limits=None):
    return trace.Trace("ID", "boundary", "S", "E", seconds * 1000, limits=limits or trace.Limits())


def around(seconds=2, limits=None):
    return trace.Trace("ID", "window", reach_ms=seconds * 1000, limits=limits or trace.Limits())


CASES = {
    "from start to end": ([(1, 0, "x"), (2, 1, "S"), (3, 2, "ID"), (4, 3, "E"), (5, 4, "x")], [([2, 3, 4], [3], "end", True, False)]),
    "the next start ends it": ([(1, 0, "S"), (2, 1, "ID"), (3, 2, "S"), (4, 3, "E")], [([1, 2], [2], "next_start", True, False)]),
    "nothing ends it": ([(1, 0, "S"), (2, 1, "ID"), (3, 2, "x")], [([1, 2, 3], [2], "not_found", True, False)]),
    "an end alone will do": ([(1, 0, "x"), (2, 1, "ID"), (3, 2, "E")], [([1, 2, 3], [2], "end", False, False)]),
    "an end before stops the way back": ([(1, 0, "E"), (2, 1, "x"), (3, 2, "ID"), (4, 3, "E")], [([2, 3, 4], [3], "end", False, False)]),
    "no boundary: alone": ([(1, 0, "x"), (2, 1, "ID"), (3, 2, "ID")], [([2], [2], "standalone", False, False), ([3], [3], "standalone", False, False)]),
    "a next start alone is no boundary": ([(1, 0, "ID"), (2, 1, "S")], [([1], [1], "standalone", False, False)]),
    "the anchor is the start": ([(1, 0, "S"), (2, 1, "S ID"), (3, 2, "E")], [([2, 3], [2], "end", True, False)]),
    "the anchor is the end": ([(1, 0, "S"), (2, 1, "E ID"), (3, 2, "x")], [([1, 2], [2], "end", True, False)]),
    "the anchor is both": ([(1, 0, "S"), (2, 1, "S E ID"), (3, 2, "x")], [([2], [2], "end", True, False)]),
    "on the way back a row that is both is an end": ([(1, 0, "S E"), (2, 1, "ID"), (3, 2, "E")], [([2, 3], [2], "end", False, False)]),
    "on the way on a row that is both is a start": ([(1, 0, "S"), (2, 1, "ID"), (3, 2, "S E")], [([1, 2], [2], "next_start", True, False)]),
    "anchors of one request": ([(1, 0, "S ID"), (2, 1, "x ID"), (3, 2, "E ID")], [([1, 2, 3], [1, 2, 3], "end", True, False)]),
    "threads and files are apart": ([(1, 0, "S"), (2, 1, "S", "u"), (3, 2, "ID"), (4, 3, "E", "u"), (5, 4, "E"), (1, 0, "S", "t", 2), (2, 1, "E ID", "t", 2)], [([1, 3, 5], [3], "end", True, False), ([1, 2], [2], "end", True, False)]),
    "without a thread: alone": ([(1, 0, "S", ""), (2, 1, "ID", ""), (3, 2, "E ID", "")], [([2], [2], "standalone", False, False), ([3], [3], "standalone", False, False)]),
    "a start out of reach": ([(1, 0, "S"), (2, 61, "ID"), (3, 62, "E")], [([2, 3], [2], "end", False, False)]),
    "a start just in reach": ([(1, 0, "S"), (2, 60, "ID"), (3, 61, "E")], [([1, 2], [2], "not_found", True, False)]),
    "time counts from the first row": ([(1, 0, "S"), (2, 30, "ID"), (3, 59, "x"), (4, 61, "E")], [([1, 2, 3], [2], "not_found", True, False)]),
    "what one request holds the next does not": ([(1, 0, "S"), (2, 50, "ID"), (3, 65, "x"), (4, 70, "ID"), (5, 71, "E")], [([1, 2], [2], "not_found", True, False), ([3, 4, 5], [4], "end", False, False)]),
    "of one time the lower line comes first": ([(2, 0, "ID"), (1, 0, "S"), (3, 0, "E")], [([1, 2, 3], [2], "end", True, False)]),
}


@pytest.mark.parametrize("name", CASES)
def test_between_boundaries(spark, name):
    rows, want = CASES[name]
    got, out = shown(spark, rows, between())
    assert got == want
    assert (out.anchor_total, out.truncated, out.filtered_out) == (sum("ID" in r[2] for r in rows), False, 0)


LIMITED = {
    "two rows before, then cut": ([(i, i, "x") for i in range(1, 6)] + [(6, 6, "ID"), (7, 7, "E")], [([4, 5, 6, 7], [6], "end", False, True)]),
    "a start as the row too many is taken": ([(1, 1, "S"), (2, 2, "x"), (3, 3, "x"), (4, 4, "ID"), (5, 5, "E")], [([1, 2, 3, 4, 5], [4], "end", True, False)]),
    "an end as the row too many is none": ([(1, 1, "E"), (2, 2, "x"), (3, 3, "x"), (4, 4, "ID"), (5, 5, "E")], [([2, 3, 4, 5], [4], "end", False, False)]),
    "five rows in all": ([(1, 1, "S"), (2, 2, "ID")] + [(i, i, "x") for i in range(3, 9)] + [(9, 9, "E")], [([1, 2, 3, 4, 5], [2], "not_found", True, True)]),
    "of more requests the first two": ([(i, i, "S ID E") for i in range(1, 6)], [([1], [1], "end", True, False), ([2], [2], "end", True, False)]),
}


@pytest.mark.parametrize("name", LIMITED)
def test_limits_between_boundaries(spark, name):
    rows, want = LIMITED[name]
    got, out = shown(spark, rows, between(limits=SMALL))
    assert got == want and out.truncated == (sum("ID" in r[2] for r in rows) > 2)


def test_an_anchor_right_after_a_full_request_is_counted_there(spark):
    rows = [(1, 1, "S"), (2, 2, "ID"), (3, 3, "x"), (4, 4, "x"), (5, 5, "x"), (6, 6, "ID"), (7, 7, "E")]
    got, out = shown(spark, rows, between(limits=SMALL))
    assert got == [([1, 2, 3, 4, 5], [2], "not_found", True, True)]
    assert [q.n_anchors for q in out.requests.collect()] == [2] and out.anchor_total == 2


AROUND = {
    "rows within reach": ([(1, 0, "x"), (2, 1, "x"), (3, 3, "ID"), (4, 5, "x"), (5, 5.1, "x")], [([2, 3, 4], [3], "window", False, False)]),
    "anchors that follow one another": ([(1, 0, "ID"), (2, 2, "ID"), (3, 3, "x"), (4, 4, "x"), (5, 4.5, "x")], [([1, 2, 3, 4], [1, 2], "window", False, False)]),
    "overlapping ones stay apart": ([(1, 0, "ID"), (2, 1, "x"), (3, 2, "x"), (4, 2.5, "x"), (5, 3.5, "ID")], [([1, 2, 3], [1], "window", False, False), ([4, 5], [5], "window", False, False)]),
    "without a thread: alone": ([(1, 0, "ID", ""), (2, 1, "ID", "")], [([1], [1], "standalone", False, False), ([2], [2], "standalone", False, False)]),
}


@pytest.mark.parametrize("name", AROUND)
def test_within_seconds(spark, name):
    rows, want = AROUND[name]
    assert shown(spark, rows, around())[0] == want


def test_limits_within_seconds(spark):
    rows = [(i, i / 10, "x") for i in range(1, 10)] + [(10, 1, "ID"), (11, 1.1, "ID")] + [(i, i / 10, "x") for i in range(12, 20)]
    got, out = shown(spark, rows, around(limits=SMALL))
    assert got == [([8, 9, 10, 11, 12], [10, 11], "window", False, True)] and not out.truncated


def test_filters_drop_requests_and_count_them(spark):
    rows = [(1, 1, "S ID"), (2, 2, "good E"), (3, 3, "S ID"), (4, 4, "BAD E"), (5, 5, "S ID"), (6, 6, "bad good E")]
    for contains, excludes, want in (("GOOD", None, [[1, 2], [5, 6]]), (None, "bad", [[1, 2]]), ("good", "bad", [[1, 2]])):
        got, out = shown(spark, rows, between().filtered(contains, excludes))
        assert [g[0] for g in got] == want and out.filtered_out == 3 - len(want)


def test_dropped_requests_count_as_examined(spark):
    rows = [(i, i, "S ID E" + " good" * (i in (2, 4))) for i in range(1, 7)]
    got, out = shown(spark, rows, between(limits=SMALL).filtered("good"))
    assert [g[0] for g in got] == [[2]] and out.truncated and out.filtered_out == 2 and out.anchor_total == 6


def test_requests_come_in_the_order_of_their_first_rows(spark):
    rows = [(1, 5, "S", "a"), (2, 6, "ID E", "a"), (3, 1, "S", "b"), (4, 8, "ID E", "b"), (1, 1, "S ID E", "a", 2)]
    assert [g[0] for g in shown(spark, rows, between())[0]] == [[3, 4], [1], [1, 2]]


def test_lines_whose_times_run_backwards(spark):
    # the rows in order of time are 1, 4, 2, 3; the request of anchor 4 spans the lines from 1 to 3
    rows = [(1, 0, "S"), (4, 1, "ID"), (2, 2, "x"), (3, 3, "E ID")]
    assert shown(spark, rows, between())[0] == [([1, 4, 2, 3], [4, 3], "end", True, False)]


def plain(rows, spec):
    """The rules for one anchor after the other over lists; what ``run`` shows, in the form of ``shown``."""
    rows = sorted(((int(s * 1000), f, line, t, x) for line, s, x, t, f in ((*r, "t", 1)[:5] if len(r) == 3 else (*r, 1)[:5] for r in rows)))
    limits, reach, window = spec.limits, spec.reach_ms, spec.mode == "window"
    made, by, flags = [], {}, {"cut": False}

    def verdict(q):
        texts = [r[4].lower() for r in q["rows"]]
        return not (spec.excludes and any(spec.excludes.lower() in x for x in texts)) and (not spec.contains or any(spec.contains.lower() in x for x in texts))

    def shown_now():
        return sum(q["kept"] for q in made)

    def judge(q):
        if (spec.contains or spec.excludes) and verdict(q) != q["kept"]:
            if not q["kept"] and shown_now() >= limits.requests:
                flags["cut"] = True
            else:
                q["kept"] = not q["kept"]

    def more(q, own, low, high, floor):
        had = len(q["rows"])
        for r in own:
            if low <= r[0] <= high and r[2] > floor:
                if len(q["rows"]) >= limits.rows:
                    q["cut"] = q["full"] = True
                    break
                q["rows"].append(r)
        q["edge"] = max(q["edge"], high)
        return len(q["rows"]) > had

    def request(a, own, last):
        q = {"rows": [], "anchors": {a}, "why": "standalone", "start": False, "cut": False, "full": False, "edge": 0, "latest": a[0], "made": a}
        p = own.index(a)
        if not a[3]:
            return q | {"rows": [a]}
        floor = last["rows"][-1][2] if last else -1
        if window:
            back = []
            for r in reversed(own[:p]):
                if r[0] < a[0] - reach or (r[2] < a[2] and r[2] <= floor):
                    break
                if r[2] < a[2]:
                    back.append(r)
            q |= {"why": "window", "cut": len(back) > limits.before, "rows": back[: limits.before][::-1]}
            more(q, own, a[0], a[0] + reach, max(floor, a[2] - 1))
            return q
        back, cut = [], False
        for r in reversed(own[:p]) if "S" not in a[4] else ():
            if r[0] < a[0] - reach:
                break
            if last and r[2] <= floor:
                if last["full"]:
                    return last
                break
            if "E" in r[4]:
                break
            if "S" in r[4]:
                back.append(r)
                q["start"] = True
                break
            if len(back) >= limits.before:
                cut = True
                break
            back.append(r)
        q["start"] |= "S" in a[4]
        on, why, full, begin = [], "not_found", False, back[-1][0] if back else a[0]
        for r in own[p:]:
            if r[0] > begin + reach:
                break
            if r != a and "S" in r[4]:
                why = "next_start"
                break
            if len(on) >= limits.rows - len(back):
                full = True
                break
            on.append(r)
            if "E" in r[4]:
                why = "end"
                break
        if q["start"] or why == "end" or cut or full:
            return q | {"rows": back[::-1] + on, "why": why, "cut": cut or full, "full": full}
        return q | {"rows": [a], "start": False}

    for a in rows:
        if "ID" not in a[4]:
            continue
        key, own = a[1:4:2], [r for r in rows if r[1] == a[1] and r[3] == a[3]]
        mine = by.setdefault(key, [])
        last = mine[-1] if mine else None
        if window and a[3] and last and (a[2] <= last["rows"][-1][2] or a[0] - last["latest"] <= reach):
            last["anchors"].add(a)
            last["latest"] = max(last["latest"], a[0])
            if more(last, own, last["edge"] + 1, a[0] + reach, last["rows"][-1][2]):
                judge(last)
            continue
        inside = [q for q in mine if q["rows"][0][2] <= a[2] <= q["rows"][-1][2]]
        if inside:
            inside[0]["anchors"].add(a)
        elif shown_now() >= limits.requests or len(made) >= limits.examined:
            flags["cut"] = True
        else:
            q = request(a, own, last)
            if q is last:
                last["anchors"].add(a)
                continue
            mine.append(q)
            q["kept"] = verdict(q)
            made.append(q)
    out = sorted((q for q in made if q["kept"]), key=lambda q: q["rows"][0])
    return [([r[2] for r in q["rows"]], [r[2] for r in q["rows"] if r in q["anchors"]], q["why"], q["start"], q["cut"]) for q in out], (flags["cut"], sum(not q["kept"] for q in made), [len(q["anchors"]) for q in out])


def told(spark, rows, spec):
    got, out = shown(spark, rows, spec)
    return got, (out.truncated, out.filtered_out, [q.n_anchors for q in out.requests.collect()])


def test_lines_out_of_time_order_far_apart(spark):
    """A request's lines may span an anchor of quite another time."""
    far = [(1, 0, "S"), (10, 1, "ID E"), (5, 1000, "ID")]
    assert told(spark, far, between()) == plain(far, between()) == ([([1, 10], [10], "end", True, False)], (False, 0, [2]))
    far = [(1, 0, "ID"), (10, 1, "ID"), (5, 1000, "ID")]
    got, (_, _, n) = told(spark, far, around(10))
    assert n == [3] and (got, (False, 0, n)) == plain(far, around(10))


def some_rows(seed):
    """Rows of some threads and files, some of them with lines that run against their times."""
    r = random.Random(seed)
    n = r.choice([30, 60, 90])
    times = sorted(r.choice([1, 0.5, 7]) * r.randrange(300) for _ in range(n))
    lines = list(range(1, n + 1))
    for _ in range(r.choice([0, 0, 3, 12])):
        i, j = r.randrange(n), r.randrange(n)
        lines[i], lines[j] = lines[j], lines[i]
    weights = r.choice([["", "", "S", "E", "S E", "x"], ["x"] * 9 + ["S", "E"], ["x"]])
    return [(lines[i], times[i], f"{r.choice(weights)} {r.choice(['ID', '', '', ''])} {r.choice(['good', 'bad', '', '', ''])}", r.choice("tttu") if seed % 5 else r.choice(["t", ""]), r.choice([1, 1, 1, 2])) for i in range(n)]


@pytest.mark.parametrize("mode", ["boundary", "window"])
def test_requests_against_the_rules(spark, mode):
    """Limits, filters that change while requests grow, and lines out of order, all at once."""
    seen = []
    for seed in range(9):
        limits = [SMALL, trace.Limits(requests=3, examined=8, rows=6, before=3), trace.Limits()][seed % 3]
        spec = (between(15, limits) if mode == "boundary" else around([2, 6, 20][seed % 3], limits)).filtered("good" if seed % 4 in (1, 3) else "", "bad" if seed % 4 in (2, 3) else "")
        rows = some_rows(seed)
        assert told(spark, rows, spec) == plain(rows, spec), seed
        seen.append(plain(rows, spec)[1][0])
    assert any(seen) and not all(seen)


def found(rows, spec, seed):
    """The spans and their course alone, without Spark."""
    by = {}
    for ts, f, line, t, x in sorted((int(s * 1000), f, line, t, x) for line, s, x, t, f in rows):
        by.setdefault((f, t), []).append((ts, line, "ID" in x, spec.mode == "boundary" and "S" in x, spec.mode == "boundary" and "E" in x, "good" in x and bool(spec.contains), "bad" in x and bool(spec.excludes)))
    barred = []
    while True:
        heads = []
        for (f, t), own in by.items():
            x = spans.Rows(*map(np.array, zip(*own, strict=True)))
            free = trace.may_make(x.ts[x.anchor], x.line[x.anchor], f, barred)
            thread = spans.Thread(x, trace._rule(spec, spec.limits.examined + 1), t != "", free)
            for k, q in enumerate(thread.resolve()):
                turns = thread.turns(k)
                heads.append((int(x.ts[thread.anchors[int(q.by[0])]]), f, int(x.line[thread.anchors[int(q.by[0])]]), x.line[q.at].tolist(), [int(x.line[p]) for p in q.at if x.anchor[p] and thread.owner[np.searchsorted(thread.anchors, p)] == k], q.reason, q.started, q.cut, int((thread.owner == k).sum()), int(x.ts[q.at[0]]), [(int(x.ts[thread.anchors[i]]), int(x.line[thread.anchors[i]]), kept) for i, kept in turns]))
        heads = sorted(heads)[: spec.limits.examined + 1]
        course = trace._course([Row(file_id=h[1], turn_ts=[t[0] for t in h[10]], turn_line=[t[1] for t in h[10]], turn_kept=[t[2] for t in h[10]]) for h in heads], spec.limits, barred[-1][0] if barred and barred[-1][1] is None else None)
        if not trace.bar(barred, course):
            break
    out = sorted((((h[9], h[1], h[3][0]), (h[3], h[4], h[5], h[6], h[7]), h[8]) for h, kept in zip(heads, course.kept, strict=True) if kept), key=lambda o: o[0])
    return [o[1] for o in out], (bool(barred) or course.refused, course.kept.count(False), [o[2] for o in out])


@pytest.mark.parametrize("mode", ["boundary", "window"])
def test_many_small_cases_against_the_rules(mode):
    again = 0
    for seed in range(1500):
        limits = [SMALL, trace.Limits(requests=2, examined=9, rows=6, before=3), trace.Limits(requests=1, examined=5), trace.Limits()][seed % 4]
        spec = (between(15, limits) if mode == "boundary" else around([2, 6, 20][seed % 3], limits)).filtered(["", "good", "", "good"][seed // 4 % 4], ["", "", "bad", "bad"][seed // 4 % 4])
        rows = some_rows(seed)
        want = plain(rows, spec)
        assert found(rows, spec, seed) == want, seed
        again += want[1][0]
    assert again > 100


def test_rounds_read_no_more_than_they_need(spark, monkeypatch):
    """Few anchors a round, so that limits bite in early rounds and late anchors join what there is."""
    monkeypatch.setattr(trace, "FIRST", 1)
    read = []
    flagged = trace.flagged
    monkeypatch.setattr(trace, "flagged", lambda e, a, s: read.append(a.count()) or flagged(e, a, s))
    for seed in range(4):
        for mode in (between(15, SMALL), around(6, SMALL)):
            spec = mode.filtered("good" if seed % 2 else "")
            rows = some_rows(100 + seed)
            assert told(spark, rows, spec) == plain(rows, spec), seed
    assert min(read) <= 4


def test_rows_far_from_anchors_are_not_held(spark, monkeypatch):
    monkeypatch.setattr(trace, "HELD", 20)
    for seed in range(4):
        for spec in (between(15, SMALL), around(20, SMALL)):
            rows = some_rows(200 + seed)
            assert told(spark, rows, spec) == plain(rows, spec), seed


def test_many_anchors_of_one_thread(spark):
    from pyspark.sql import functions as F

    n = 30_000
    df = spark.range(n).select(F.lit(1).cast("long").alias("file_id"), (F.col("id") + 1).alias("line_no"), (F.col("id") * 10).alias("ts_millis"), F.lit("INFO").alias("level"), F.lit("l").alias("logger"), F.lit("t").alias("thread"), F.when(F.col("id") % 4 == 0, "S").otherwise("x").alias("message"), F.lit("ID").alias("raw"))
    out = trace.run(df, spark.createDataFrame([(1, "/a.log")], "file_id long, path string"), between())
    assert out.anchor_total == n and out.truncated and out.requests.count() == 200 and out.rows.count() == 800
    alone = trace.run(df.withColumn("message", F.lit("x")), spark.createDataFrame([(1, "/a.log")], "file_id long, path string"), between())
    # 1,000 rows each; an anchor within 500 rows of a full request goes to it, the one after begins anew 500 rows back
    assert not alone.truncated and [q.n_rows for q in alone.requests.collect()] == [1000] * 29 + [30_000 - 29 * 1001]


def test_identifier_is_literal_and_in_its_case(spark):
    rows = [(1, 1, 0, "INFO", "l", "t", "m", "a.b"), (1, 2, 1, "INFO", "l", "t", "m", "aXb"), (1, 3, 2, "INFO", "l", "t", "m", "A.B")]
    df = spark.createDataFrame(rows, SCHEMA)
    assert trace.members(df, trace.window("a.b", 1)).where("joined").count() == 1


@pytest.mark.parametrize("bad", [lambda: trace.boundary("", "a", "b"), lambda: trace.boundary("x", "", "b"), lambda: trace.boundary("x", "a", "b", 1441), lambda: trace.window("x", 0), lambda: trace.window(" ", 5)])
def test_bad_traces(bad):
    with pytest.raises(ValueError):
        bad()
