import json
import threading
import uuid

import pytest

from emberlog.service import Engine
from emberlog.sources import discovery, formats, saved, textfile
from emberlog.sources.paths import Paths

ITEM = {"id": "0a1b2c3d-0000-4000-8000-00000000000{}", "name": "n{}", "savedAt": "", "mode": "search", "fields": {"level": "WARN"}}


def item(i, **other):
    one = {k: v.format(i) if isinstance(v, str) else v for k, v in ITEM.items()} | other
    return {k: v for k, v in one.items() if v is not ...}


def file_of(tmp_path, text):
    path = tmp_path / f"{uuid.uuid4().hex}.json"
    path.write_text(text if isinstance(text, str) else json.dumps(text), encoding="utf-8")
    return saved.SavedSearches(str(path))


@pytest.mark.parametrize("text", ["", " \n ", "﻿", "{}", '{"version": 1}', '{"items": null}', '{"version": "1", "items": []}'])
def test_files_without_items_hold_none(spark, tmp_path, text):
    assert file_of(tmp_path, text).load() == ([], 0, False)


@pytest.mark.parametrize("text", ["[]", "{", '{"version": 2, "items": []}', '{"version": true}', '{"version": "x"}', '{"version": 1, "items": {}}'])
def test_broken_files_fail_as_a_whole(spark, tmp_path, text):
    with pytest.raises(ValueError):
        file_of(tmp_path, text).load()


def test_odd_items(spark, tmp_path):
    rows = [item(1), item(2, name="n1"), item(3, mode=...), item(4, mode=""), item(5, mode="other"), item(6, fields=...), item(7, fields=[]), item(8, fields={"level": 3}), item(9, id="x"), 5, None]
    got, skipped, overflow = file_of(tmp_path, {"items": rows}).load()
    assert [(i.id[-1], i.name, i.mode, i.fields) for i in got] == [("1", "n1", "search", {"level": "WARN"}), ("2", "n1", "search", {"level": "WARN"}), ("3", "n3", "search", {"level": "WARN"}), ("4", "n4", "search", {"level": "WARN"}), ("6", "n6", "search", {})]
    assert (skipped, overflow) == (6, False)
    twice = file_of(tmp_path, {"version": 1, "items": rows[:2]})
    assert twice.upsert("n1", "search", {}).id[-1] == "1" and [i.fields for i in twice.list()] == [{}, {"level": "WARN"}]


def test_items_beyond_the_limit_are_counted_and_nothing_is_written(spark, tmp_path):
    s = file_of(tmp_path, {"items": [item(0, id=str(uuid.uuid4()), name=f"n{i}") for i in range(202)]})
    got, skipped, overflow = s.load()
    assert (len(got), skipped, overflow) == (200, 2, True)
    with pytest.raises(ValueError):
        s.delete(got[0].id)


@pytest.mark.parametrize("scheme", ["", "file:", "file://"])
def test_stores_on_spark_paths(spark, tmp_path, scheme):
    at = f"{scheme}{tmp_path}/new folder"
    s = saved.SavedSearches(f"{at}/saved.json", spark)
    one = s.upsert("späte", "trace", {"trace-id": "X"})
    s.upsert("b", "search", {})
    assert s.delete(one.id) and [i.name for i in s.list()] == ["b"]
    f = formats.FormatStore(f"{at}/formats.txt", spark)
    f.upsert("own", "Own", "(?<ts>.*)", "yyyy-MM-dd")
    assert [x.id for x in f.list()] == ["own"] and f.delete("own") and f.list() == []
    assert sorted(p.name for p in (tmp_path / "new folder").iterdir()) == ["formats.txt", "saved.json"]
    assert [p.name for p in tmp_path.iterdir()] == ["new folder"]


def test_a_file_system_that_is_not_there_is_an_error(spark, tmp_path, monkeypatch):
    monkeypatch.chdir(tmp_path)
    with pytest.raises(Exception, match="nowhere"):
        saved.SavedSearches("nowhere://nn/home/saved.json", spark).upsert("a", "search", {})
    assert list(tmp_path.iterdir()) == []


def test_two_writers_keep_each_others_items(spark, tmp_path):
    path, failed = str(tmp_path / "s.json"), []

    def write(who):
        try:
            for i in range(8):
                saved.SavedSearches(path, spark).upsert(f"{who} {i}", "search", {})
        except ValueError as e:
            failed.append(e)

    threads = [threading.Thread(target=write, args=(w,)) for w in "abc"]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not failed and {i.name for i in saved.SavedSearches(path, spark).list()} == {f"{w} {i}" for w in "abc" for i in range(8)}
    assert [p.name for p in tmp_path.iterdir()] == ["s.json"]


def test_turns(spark, tmp_path, monkeypatch):
    path = tmp_path / "x.txt"
    f = textfile.TextFile(str(path), 20, spark)
    lock = tmp_path / "x.txt.lock"
    lock.write_text("")
    monkeypatch.setattr(textfile, "PATIENCE", 0.1)
    with pytest.raises(ValueError, match="another program"), f.turn():
        pass
    monkeypatch.setattr(textfile, "STALE", -1.0)
    with f.turn():  # the lock was left behind
        f.replace("one", None)
        with pytest.raises(ValueError, match="changed meanwhile"):
            f.replace("two", None)
        with pytest.raises(ValueError, match="more than"):
            f.replace("x" * 21, f.stamp())
    assert path.read_text() == "one" and [p.name for p in tmp_path.iterdir()] == ["x.txt"]
    monkeypatch.setattr(Paths, "move_over", lambda *_: False)
    f.replace("three", f.stamp())
    assert path.read_text() == "three"


def test_browse_by_scheme(spark, tmp_path):
    for d in ("b", "A", ".c", "a b"):
        (tmp_path / d).mkdir()
    (tmp_path / "f").write_text("")
    for at in (str(tmp_path), f"file:{tmp_path}"):
        assert discovery.browse(at, spark) == {"path": str(tmp_path), "parent": str(tmp_path.parent), "directories": ["A", "a b", "b"]}
    assert discovery.browse("/", spark)["parent"] is None
    with pytest.raises(ValueError):
        discovery.browse(str(tmp_path / "f"), spark)


def test_engine_keeps_and_replays(spark, tmp_path):
    (tmp_path / "logs").mkdir()
    (tmp_path / "logs/a.log").write_text("".join(f"2031-03-09 06:3{i}:00.000[main][{x}][a.B] - id {i}\n" for i, x in enumerate(("INFO", "ERROR", "ERROR"))))
    e = Engine(spark, str(tmp_path / "home"))
    assert e.saved_searches()["items"] == [] and e.log_formats()["items"] == []
    one = e.save_search("errors", "search", {"level": "ERROR", "since-date": "2031-03-09", "since-time": "06:32:40", "until-date": "2031-03-09", "page-limit": "5"})
    two = e.save_search("of id", "trace", {"trace-mode": "window", "trace-id": "id 1", "trace-window-secs": "60"})
    assert [i["name"] for i in e.saved_searches()["items"]] == ["errors", "of id"] and e.saved_searches()["writable"]
    e.load(str(tmp_path / "logs"))
    assert [r["message"] for r in e.replay(one["id"])["items"]] == ["id 2"]
    assert len(e.replay(two["id"])["requests"][0]["entries"]) == 3
    assert e.replay(one["id"], level="INFO")["total"] == 0
    assert e.delete_search(one["id"]) and not e.delete_search(one["id"])
    with pytest.raises(ValueError):
        e.replay(one["id"])
    assert e.save_format("own", None, "(?<ts>.*)", "yyyy")["name"] == "own" and e.delete_format("own") and not e.delete_format("own")


def test_a_load_that_takes_too_long_is_stopped(spark, tmp_path):
    (tmp_path / "logs").mkdir()
    (tmp_path / "logs/a.log").write_text("2031-03-09 06:30:00.000[main][INFO][a.B] - id\n" * 1000)
    e = Engine(spark, str(tmp_path / "home"))
    with pytest.raises(ValueError, match="layout default took longer than 0.01 seconds"):
        e.load(str(tmp_path / "logs"), "default", seconds=0.01)
    assert e.meta()["state"] == "idle" and e.load(str(tmp_path / "logs"), "default", seconds=600)["total"] == 1000
