"""The engine's operations as plain functions of a session, and a command line."""

from __future__ import annotations

import argparse
import json
import os
import threading
import uuid

from pyspark import InheritableThread
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions.times import minute_range, parse_ui_datetime
from .operators import search, trace
from .operators.custom import CustomLayout, try_layout
from .operators.filters import QueryFilter
from .operators.layouts import LAYOUTS
from .sources import discovery, index
from .sources.formats import FormatStore
from .sources.paths import Paths
from .sources.saved import SavedSearches


class Engine:
    """One directory of logs at a time; errors in what users give are ValueErrors."""

    def __init__(self, spark: SparkSession, home: str):
        self.spark, self.home = spark, home
        self.formats = FormatStore(os.path.join(home, "log-formats.txt"), spark)
        self.saved = SavedSearches(os.path.join(home, "saved-searches.json"), spark)
        self.root: str | None = None
        self.state, self.error = "idle", ""
        self.index: index.Index | None = None
        self._lock = threading.Lock()
        self._group = ""  # of the jobs of the load that counts; an earlier one's result is dropped
        self._loader: threading.Thread | None = None

    def load(self, directory: str, layout: str = "auto", trigrams: bool = False, seconds: float | None = None) -> dict:
        """Load and wait for it; what goes wrong is raised, as is that it takes longer than ``seconds``.

        A task inside an expression sees its end late: let the cluster's task reaper
        (``spark.task.reaper.enabled``) end its executor."""
        failed: list[BaseException] = []
        loader = self._begin(directory, layout, trigrams, failed)
        loader.join(seconds)
        if loader.is_alive():
            self.cancel()
            raise ValueError(f"loading {directory} with layout {layout} took longer than {seconds} seconds; its pattern may be to blame")
        if failed:
            raise failed[0]
        return self.meta()

    def start(self, directory: str, layout: str = "auto", trigrams: bool = False) -> dict:
        """Load in the background; ``meta`` tells how far it is. A load under way is cancelled."""
        self._begin(directory, layout, trigrams, [])
        return {"state": "loading"}

    def cancel(self) -> None:
        """Stop the load under way, its jobs to come included; an index that was ready stays."""
        with self._lock:
            group, loader, self._group = self._group, self._loader, ""
            if self.state == "loading":
                self.state = "idle" if self.index is None else "ready"
        if loader is not None and loader.is_alive():
            self.spark.sparkContext._jsc.sc().cancelJobGroupAndFutureJobs(group)
            loader.join(90)

    def _begin(self, directory: str, layout: str, trigrams: bool, failed: list[BaseException]) -> threading.Thread:
        root = Paths(self.spark).real(directory)
        if not Paths(self.spark).is_folder(root):
            raise ValueError(f"not a directory: {directory}")
        self.cancel()
        group = f"load-{uuid.uuid4().hex}"

        def work() -> None:
            self.spark.sparkContext.setJobGroup(group, f"load {root}")
            found, error = None, ""
            try:
                found = index.load(self.spark, os.path.join(self.home, "index"), root, self.formats.list(), layout, trigrams)
            except BaseException as e:  # noqa: BLE001  told by the state, and by ``load``
                failed.append(e)
                error = str(e)
            with self._lock:
                if self._group != group:
                    return
                self.state, self.error = ("error", error) if found is None else ("ready", "")
                if found is not None:
                    self.index, self.root = found, root

        with self._lock:
            self._group, self.state, self.error = group, "loading", ""
            self._loader = InheritableThread(target=work, daemon=True)
        self._loader.start()
        return self._loader

    def progress(self) -> dict:
        """Jobs begun, and tasks done and known, of the load that counts."""
        tracker, jobs, done, known = self.spark.sparkContext.statusTracker(), 0, 0, 0
        for job in tracker.getJobIdsForGroup(self._group) if self._group else ():
            jobs += 1
            for stage in (info.stageIds if (info := tracker.getJobInfo(job)) else ()):
                if at := tracker.getStageInfo(stage):
                    done, known = done + at.numCompletedTasks, known + at.numTasks
        return {"jobs": jobs, "tasks_done": done, "tasks": known}

    def meta(self) -> dict:
        out: dict = {"state": self.state, "directory": self.root, "layouts": [{"id": x.id, "name": x.label} for x in LAYOUTS.values()] + [{"id": x.id, "name": x.name} for x in self.formats.list()]}
        if self.state == "loading":
            return out | {"progress": self.progress()}
        if self.error:
            out["error"] = self.error
        if self.index is not None:
            sources = {r.file_id: r.path for r in self.index.files.collect()}
            out |= (self.index.counts.bounds() if self.index.counts else search.bounds(self.index.entries)).first().asDict()
            out |= {"log_format": self.index.meta["log_format"], "skipped_lines": self.index.meta["skipped_lines"], "skipped_samples": [{"source": sources.get(f), "line_no": n, "preview": p} for f, n, p in self.index.meta["skipped_samples"]]}
        return out

    def browse(self, path: str | None = None) -> dict:
        return discovery.browse(path, self.spark)

    def _ready(self) -> index.Index:
        if self.index is None:
            raise ValueError("no directory is loaded")
        return self.index

    def logs(self, offset=None, limit=None, **conditions) -> dict:
        """Conditions: level, since, until, source, logger, thread, message, grep."""
        if self.state == "loading":
            return {"loading": True, "total": 0, "items": []}
        ix = self._ready()
        offset, limit = search.number_of(offset, 0), search.number_of(limit, search.DEFAULT_LIMIT)
        total, rows = search.search(ix.entries, ix.files, QueryFilter.of(**conditions), offset, limit, ix.postings, ix.counts)
        return {"total": total, "items": [json.loads(x) for x in search.shown(rows, F.col("raw")).toJSON().collect()]}

    def detail(self, source: str, line_no, timestamp: str | None = None) -> dict | None:
        ix = self._ready()
        rows = search.find_entry(ix.entries, ix.files, source, search.number_of(line_no, 0), parse_ui_datetime(timestamp)).collect()
        return rows[0].asDict() if rows else None

    def session_trace(self, id: str, mode: str = "boundary", start: str = "", end: str = "", minutes=None, seconds=None, contains: str = "", excludes: str = "") -> dict:
        ix, mode = self._ready(), (mode or "boundary").strip()
        if mode not in ("boundary", "window"):
            raise ValueError("mode is boundary or window")
        spec = trace.boundary(id, start, end, search.number_of(minutes, 10)) if mode == "boundary" else trace.window(id, search.number_of(seconds, 10))
        out = trace.run(ix.entries, ix.files, spec.filtered(contains, excludes), ix.postings)
        rows: dict[int, list] = {}
        for r in out.rows.collect():
            rows.setdefault(r.req_no, []).append(r.asDict())
        requests = [r.asDict() | {"entries": rows[r.req_no]} for r in out.requests.collect()]
        return {"anchor_total": out.anchor_total, "truncated": out.truncated, "filtered_out": out.filtered_out, "requests": requests}

    def saved_searches(self) -> dict:
        """What is saved, how many items of the file were left out, and why nothing can be saved."""
        items, skipped, overflow = self.saved.load()
        return {"file": self.saved.path, "items": [i.record() for i in items], "skipped": skipped, "writable": not (skipped or overflow)}

    def save_search(self, name: str, mode: str = "search", fields: dict[str, str] | None = None) -> dict:
        return self.saved.upsert(name, mode, fields or {}).record()

    def delete_search(self, id: str) -> bool:
        """False if there is none of this id."""
        return self.saved.delete(id)

    def replay(self, id: str, **more) -> dict:
        """The answer to a saved search or trace; ``more`` goes to ``logs`` or ``session_trace``."""
        item = next((i for i in self.saved.list() if i.id == id), None)
        if item is None:
            raise ValueError(f"no such saved search: {id}")
        f = item.fields
        if item.mode == "trace":
            asked = {"id": f.get("trace-id", ""), "mode": f.get("trace-mode", "boundary"), "start": f.get("trace-start", ""), "end": f.get("trace-end", ""), "minutes": f.get("trace-max-minutes"), "seconds": f.get("trace-window-secs"), "contains": f.get("trace-contains", ""), "excludes": f.get("trace-excludes", "")}
            return self.session_trace(**(asked | more))
        asked = {k: f[k] for k in ("level", "logger", "thread", "message", "grep", "source") if k in f} | {"limit": f.get("page-limit")}
        clock = [(f.get(f"{k}-time") or "")[:5] for k in ("since", "until")]
        asked["since"], asked["until"] = minute_range(f.get("since-date"), clock[0], f.get("until-date"), clock[1])
        return self.logs(**(asked | more))

    def log_formats(self) -> dict:
        """User-defined layouts, and what of their file was left out and why."""
        now = self.formats.load()
        return {"file": self.formats.path, "items": [_format(x) for x in now.formats], "skipped_formats": now.skipped_formats, "skipped_lines": now.skipped_lines, "warnings": now.warnings}

    def save_format(self, id: str, name: str | None, pattern: str, timestamp: str) -> dict:
        return _format(self.formats.upsert(id, name, pattern, timestamp))

    def delete_format(self, id: str) -> bool:
        return self.formats.delete(id)

    def try_format(self, sample: str, pattern: str | None, timestamp: str | None = None, id: str | None = None, name: str | None = None) -> dict:
        return try_layout(self.spark, sample, pattern, timestamp, id, name)


def _format(x: CustomLayout) -> dict:
    return {"id": x.id, "name": x.name, "pattern": x.pattern, "timestamp": x.timestamp}


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="emberlog", description="Search application logs.")
    p.add_argument("--dir", required=True)
    p.add_argument("--home", default=os.path.join(os.path.expanduser("~"), ".emberlog"))
    p.add_argument("--format", default="auto")
    p.add_argument("--trigrams", action="store_true")
    for name in ("level", "since", "until", "source", "logger", "thread", "message", "grep", "offset", "limit"):
        p.add_argument(f"--{name}")
    a = vars(p.parse_args(args))
    spark = SparkSession.builder.appName("emberlog").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    engine = Engine(spark, a.pop("home"))
    engine.load(a.pop("dir"), a.pop("format"), a.pop("trigrams"))
    print(json.dumps(engine.logs(**{k: v for k, v in a.items() if v is not None}), ensure_ascii=False, indent=2))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
