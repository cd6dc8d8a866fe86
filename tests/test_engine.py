"""Ingest, index, search, stores and service on small files."""

import json
import os

import pytest
from pyspark.sql import functions as F

from emberlog.operators import search
from emberlog.operators.custom import define
from emberlog.operators.filters import QueryFilter, parse_levels, same_context
from emberlog.service import Engine
from emberlog.sources import discovery, formats, index, saved

H = "2026-06-15 00:0{m}:00.000[{t}][{lv}][a.B] - {msg}\n"


def head(m, msg, t="main", lv="INFO"):
    return H.format(m=m, t=t, lv=lv, msg=msg)


def write(folder, **files):
    for name, text in files.items():
        (folder / f"{name}.log").write_bytes(text.encode() if isinstance(text, str) else text)
    return sorted(str(folder / f"{n}.log") for n in files)


def rows(spark, paths, layout="default"):
    found, skipped, _, _ = index.read_entries(spark, paths, layout)
    return found.orderBy("file_id", "line_no").collect(), skipped.orderBy("file_id", "line_no").collect()


def test_entries_and_skipped_lines(spark, tmp_path):
    text = "junk\n\nmore junk\n" + head(1, "one") + "  at x\n\n  at y\r\n" + head(2, "two") + "tail"
    found, skipped = rows(spark, write(tmp_path, a=text))
    assert [(r.line_no, r.message) for r in found] == [(4, "one"), (8, "two")]
    raw = text.encode()
    assert [raw[r.byte_offset : r.end_byte_offset].decode() for r in found] == [r.raw for r in found]
    assert "".join(r.raw for r in found) == text[text.index("2026") :]
    assert [(s.line_no, s.preview) for s in skipped] == [(1, "junk"), (3, "more junk")]


def test_offsets_survive_splits(spark, tmp_path):
    text = "".join(head(i % 10, f"m{i} é\r") + "x" * (i % 7) + "\n" for i in range(3000))
    paths = write(tmp_path, a=text, b=head(1, "b"))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        found, _ = rows(spark, paths)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    raw, mine = text.encode(), [r for r in found if r.file_id == 1]
    assert [r.line_no for r in mine] == list(range(1, 6001, 2))
    assert b"".join(raw[r.byte_offset : r.end_byte_offset] for r in mine) == raw
    assert all(raw[r.byte_offset : r.end_byte_offset].decode() == r.raw for r in mine)


def test_unreadable_custom_headers(spark, tmp_path):
    x = define("d", None, r"(?<ts>\d{4}/\d\d/\d\d) (?<message>.*)", "yyyy/MM/dd")
    found, skipped = rows(spark, write(tmp_path, a="2026/01/01 a\n2026/13/01 b\nmore\n"), x)
    assert [(r.line_no, r.message, r.raw) for r in found] == [(1, "a", "2026/01/01 a\n2026/13/01 b\nmore\n")]
    assert [s.line_no for s in skipped] == [2]


def test_empty_files_and_none(spark, tmp_path):
    found, skipped = rows(spark, write(tmp_path, a="", b=head(1, "x")))
    assert len(found) == 1 and found[0].file_id == 2 and not skipped
    assert rows(spark, [])[0] == []


def test_detection(spark, tmp_path):
    juli = "15-Jun-2026 00:19:11.705 INFO [t] x.y z\n"
    x = define("own", None, r"(?<ts>\d\d-\w{3}-\d{4}) .*", "dd-MMM-yyyy")
    assert index.choose_layout(spark, write(tmp_path, a=juli), []) == "tomcat-juli"
    assert index.choose_layout(spark, write(tmp_path, a=juli), [x]) == "tomcat-juli"  # ties: built-in first
    assert index.choose_layout(spark, write(tmp_path, a=juli + "15-Jun-2026 zz\n"), [x]) is x
    assert index.choose_layout(spark, write(tmp_path, a="\n" * 500 + juli), []) == "default"
    with pytest.raises(ValueError):
        index.choose_layout(spark, [], [], "none")


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    root, home = tmp_path_factory.mktemp("logs"), tmp_path_factory.mktemp("home")
    write(root, a=head(1, "Alpha") + "\tcause: Boom\n" + head(4, "gamma", "exec-1", "ERROR"), b=head(2, "beta [x]", "exec-1", "WARN"), c=head(3, "delta"))
    e = Engine(spark, str(home))
    e.load(str(root))
    return e


def messages(engine, **q):
    r = engine.logs(**q)
    assert r["total"] >= len(r["items"])
    return [i["message"] for i in r["items"]]


def test_search_order_and_conditions(engine):
    assert messages(engine) == ["Alpha", "beta [x]", "delta", "gamma"]
    assert messages(engine, level=" warn , Error ") == ["beta [x]", "gamma"]
    assert messages(engine, since="2026-06-15 00:02", until="2026-06-15 00:03") == ["beta [x]", "delta"]
    assert messages(engine, source=r"[AB]\.LOG$") == ["Alpha", "beta [x]", "gamma"]
    assert messages(engine, grep="BOOM") == ["Alpha"]
    assert messages(engine, grep=r"cause:\s+boom$") == ["Alpha"]
    assert messages(engine, message="a$", thread="EXEC") == ["gamma"]
    assert messages(engine, source="none") == []
    assert messages(engine, **same_context(engine.logs()["items"][1]["source"], "exec-1")) == ["beta [x]"]


def test_pages(engine):
    r = engine.logs(offset=1, limit=2)
    assert (r["total"], [i["message"] for i in r["items"]]) == (4, ["beta [x]", "delta"])
    assert engine.logs(limit=0) == {"total": 4, "items": []}
    assert len(engine.logs(offset=-5, limit=9999)["items"]) == 4
    assert search.pages(4, 3) == 2
    for bad in ({"limit": "x"}, {"grep": "["}, {"since": "2026-02-30"}):
        with pytest.raises(ValueError):
            engine.logs(**bad)


def test_detail(engine):
    item = engine.logs()["items"][0]
    assert engine.detail(item["source"], item["line_no"], item["timestamp"])["raw"].endswith("\tcause: Boom")
    assert engine.detail(item["source"], 2) is None


def test_meta_and_reuse(engine, spark):
    meta = engine.meta()
    assert (meta["total"], meta["first"], meta["last"], meta["log_format"]) == (4, "2026-06-15T00:01:00.000", "2026-06-15T00:04:00.000", "default")
    path = engine.index.path
    before = os.stat(f"{path}/meta.json").st_mtime_ns
    engine.load(engine.root)
    assert os.stat(f"{path}/meta.json").st_mtime_ns == before
    with open(os.path.join(engine.root, "c.log"), "a") as f:
        f.write(head(5, "new"))
    assert engine.load(engine.root)["total"] == 5
    with pytest.raises(ValueError):
        engine.load(engine.root, "nothing")
    assert engine.state == "error"
    engine.load(engine.root, "default")


def test_trigrams_change_no_result(spark, tmp_path):
    root = tmp_path / "logs"
    root.mkdir()
    write(root, a=head(1, "Out of Stock É") + "x\n" + head(2, "stock") + head(3, "st"))
    plain, sieved = Engine(spark, str(tmp_path / "h1")), Engine(spark, str(tmp_path / "h2"))
    plain.load(str(root))
    sieved.load(str(root), trigrams=True)
    assert sieved.index.postings.count() and plain.index.postings is None
    for grep in ("STOCK", "st", "é", "É", "t of s", "s.o", "none", ""):
        assert plain.logs(grep=grep) == sieved.logs(grep=grep)
    assert index.needs_rebuild(spark, sieved.index.path, sorted(str(p) for p in root.iterdir()), "default", False)


def test_failed_builds_leave_nothing(spark, tmp_path):
    paths = write(tmp_path, a=head(1, "x"))
    with pytest.raises(Exception):
        index.build(spark, paths, "no-such-layout", str(tmp_path / "ix"))
    assert not (tmp_path / "ix").exists() and not (tmp_path / "ix.new").exists()


def test_files_below_a_directory(spark, tmp_path):
    for name in ("app.log", "x/server1.log.2", "x/y/z.out", "x/notes.txt", "x/app.log.gz", ".git/app.log", "elsewhere/app.log"):
        (tmp_path / "root" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "root" / name).write_text("x")
    os.rename(tmp_path / "root" / "elsewhere", tmp_path / "elsewhere")
    os.symlink(tmp_path / "elsewhere", tmp_path / "root" / "linked")
    os.symlink(tmp_path / "elsewhere" / "app.log", tmp_path / "root" / "x" / "b.log")
    found = discovery.find_log_files(spark, str(tmp_path / "root"))
    assert [os.path.relpath(p, tmp_path) for p in found] == ["elsewhere/app.log", "root/app.log", "root/x/server1.log.2", "root/x/y/z.out"]
    assert discovery.find_log_files(spark, f"file://{tmp_path}/root") == found and discovery.find_log_files(spark, str(tmp_path / "none")) == []
    rows = discovery.files_table(spark, found).collect()
    assert [(r.file_id, r.path, r.mtime_secs, r.size) for r in rows] == [(i, p, int(os.stat(p).st_mtime), 1) for i, p in enumerate(found, 1)]


def test_index_garbage(spark, tmp_path):
    for i in range(25):
        (tmp_path / f"i{i}").mkdir()
        os.utime(tmp_path / f"i{i}", (1_000_000 + i, 1_000_000 + i))
    active = str(tmp_path / "i0")
    gone = index.collect_garbage(spark, str(tmp_path), active, now=1_000_100)
    assert len(gone) == 5 and os.path.isdir(active)
    assert len(index.collect_garbage(spark, str(tmp_path), active, now=9_000_000)) == 19


def test_filter_parts():
    assert parse_levels(None) == parse_levels(" , ") == frozenset()
    assert parse_levels("info, Warn ,,") == {"INFO", "WARN"}
    assert QueryFilter.of(level="x", since=None).levels == {"X"}


FILE = "﻿# head\n\n# of a\n[a]\nname = A = B\npattern = (?<ts>.*)=\ntimestamp = yyyy\n# of b\n[b]\npattern=(?<ts>.*)\ntimestamp=yyyy\nodd\nwhat = 1\n[bad id]\npattern=(?<ts>.)\ntimestamp=yyyy\n"


def test_format_file(spark, tmp_path):
    x = formats.read_text(FILE, spark)
    assert [(f.id, f.name, f.pattern) for f in x.formats] == [("a", "A = B", "(?<ts>.*)="), ("b", "b", "(?<ts>.*)")]
    assert (x.skipped_formats, x.skipped_lines, x.header, x.comments) == (1, 2, ["# head", "# of a"], {"b": ["# of b"]})
    path = tmp_path / "f.txt"
    path.write_text(FILE)
    store = formats.FormatStore(str(path), spark)
    with pytest.raises(ValueError):
        store.upsert("c", None, "(?<ts>.*)", "yyyy")
    path.write_text(FILE[: FILE.index("odd")])
    store.upsert("c", "C", "(?<ts>.*)", "yyyy")
    store.upsert("a", "A2", "(?<ts>.*)", "yyyy")
    assert [f.name for f in store.list()] == ["A2", "b", "C"] and "# of b" in path.read_text()
    assert store.delete("b") and not store.delete("b") and store.by_id("b") is None
    full = "".join(f"[f{i}]\npattern=(?<ts>.)\ntimestamp=yyyy\n" for i in range(22))
    assert (len(formats.read_text(full).formats), formats.read_text(full).overflow) == (20, True)


def test_saved_searches(spark, tmp_path):
    s = saved.SavedSearches(str(tmp_path / "s.json"))
    a = s.upsert(" errors ", "search", {"level": "ERROR", "grep": "<[(", "unknown": "x", "thread": ""})
    assert a.fields == {"level": "ERROR", "grep": "<[("}
    b = s.upsert("errors", "search", {"level": "WARN"})
    assert b.id == a.id and len(s.list()) == 1
    s.upsert("errors", "trace", {"trace-id": "X"})
    assert s.frame(spark).orderBy("mode").select("mode", F.col("fields")["level"]).collect() == [("search", "WARN"), ("trace", None)]
    data = json.loads((tmp_path / "s.json").read_text())
    data["items"].append({"id": "zz"})
    (tmp_path / "s.json").write_text(json.dumps(data))
    assert s.load()[1] == 1
    with pytest.raises(ValueError):
        s.delete(a.id)
    (tmp_path / "s.json").write_text("{")
    with pytest.raises(ValueError):
        s.list()
    for bad in (("", "search", {}), ("x", "other", {}), ("x", "search", {"level": "y" * 4001})):
        with pytest.raises(ValueError):
            saved.SavedSearches(str(tmp_path / "t.json")).upsert(*bad)


def test_stream(spark, tmp_path):
    from emberlog.streaming.tail import follow

    write_to = tmp_path / "in"
    write_to.mkdir()
    write(write_to, a=head(1, "one") + "more\n", b=head(2, "two"))
    for _ in range(2):
        follow(spark, str(write_to), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("ts_millis").select("message", "raw").collect()
    assert [(r.message, r.raw) for r in got] == [("one", head(1, "one") + "more\n"), ("two", head(2, "two"))]


def test_a_build_that_stops_anywhere_leaves_the_version_before(spark, tmp_path, monkeypatch):
    from pyspark.sql.readwriter import DataFrameWriter

    from emberlog.sources.paths import Paths

    (tmp_path / "logs").mkdir()
    place, old, new = str(tmp_path / "ix"), write(tmp_path / "logs", a=head(1, "old")), write(tmp_path / "logs", b=head(2, "new"))
    first = index.build(spark, old, "default", place, trigrams=True)
    steps = {"n": 0, "stop": 0}

    def stopping(f):
        def run(self, *a, **k):
            if "ix" in str(a[0]):
                steps["n"] += 1
                if steps["n"] == steps["stop"]:
                    raise RuntimeError("stopped")
            return f(self, *a, **k)

        return run

    monkeypatch.setattr(DataFrameWriter, "parquet", stopping(DataFrameWriter.parquet))
    monkeypatch.setattr(Paths, "write", stopping(Paths.write))
    for stop in range(1, 7):  # entries, counts, postings, files, the version's sidecar, the place's
        steps |= {"n": 0, "stop": stop}
        with pytest.raises(RuntimeError):
            index.build(spark, old + new, "default", place, trigrams=True)
        found = index.open_index(spark, place)
        assert [r.message for r in found.entries.collect()] == ["old"] and [e.name for e in os.scandir(place) if e.is_dir()] == [first.meta["version"]]
    steps |= {"n": 0, "stop": 0}
    second = index.build(spark, old + new, "default", place, trigrams=True)
    assert sorted(r.message for r in second.entries.collect()) == ["new", "old"]
    assert [r.message for r in first.entries.collect()] == ["old"]  # whoever opened it goes on reading it
    (tmp_path / "ix" / "meta.json").write_text('{"ver')  # torn: the newest complete version counts
    assert index.open_index(spark, place).meta["version"] == second.meta["version"]
    third = index.build(spark, old, "default", place)
    assert sorted(e.name for e in os.scandir(place) if e.is_dir()) == sorted([second.meta["version"], third.meta["version"]])


def test_loading_in_the_background(spark, tmp_path, monkeypatch):
    import time

    (tmp_path / "a").mkdir()
    (tmp_path / "b").mkdir()
    write(tmp_path / "a", a=head(1, "first"))
    write(tmp_path / "b", b=head(2, "second"))
    engine, load, seen = Engine(spark, str(tmp_path / "home")), index.load, []

    def slow(batches):
        time.sleep(60)
        yield from batches

    def slowly(spark, home, root, *rest):
        if root.endswith("/a"):
            spark.range(4).mapInArrow(slow, "id long").count()
        return load(spark, home, root, *rest)

    monkeypatch.setattr(index, "load", slowly)
    assert engine.start(str(tmp_path / "a")) == {"state": "loading"}
    begun = time.time()
    while not seen or not seen[-1]["progress"]["tasks"]:
        seen.append(engine.meta())
        assert seen[-1]["state"] == "loading" and engine.logs() == {"loading": True, "total": 0, "items": []} and time.time() < begun + 30
        time.sleep(0.2)
    engine.start(str(tmp_path / "b"))  # cancels the first
    while engine.meta()["state"] == "loading" and time.time() < begun + 50:
        time.sleep(0.2)
    assert time.time() < begun + 50 and [i["message"] for i in engine.logs()["items"]] == ["second"] and engine.root.endswith("/b")
    engine.start(str(tmp_path / "a"))
    engine.cancel()
    assert engine.meta()["state"] == "ready" and engine.root.endswith("/b")
    with pytest.raises(ValueError):
        engine.start(str(tmp_path / "none"))
    engine.start(str(tmp_path / "b"), "nothing")
    while engine.meta()["state"] == "loading":
        time.sleep(0.1)
    assert engine.meta()["state"] == "error" and "nothing" in engine.meta()["error"]
