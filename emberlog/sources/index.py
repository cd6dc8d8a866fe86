"""The stored index of a directory: entries as Parquet in time order, and a sidecar.

Every build is a version, a folder of its own below the index's place; its sidecar is
written last and says that it is complete. Then the place's sidecar names it. Nothing is
moved or replaced before that, so a build that stops anywhere leaves the version before,
and those who opened that go on reading it: it goes with the build after the next one. Where
the place's sidecar is missing or torn, the newest complete version counts. An index is used
again while the fingerprint of files and layout is the same.
"""

from __future__ import annotations

import json
import posixpath
import time
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..functions.strings import root_key
from ..operators import entries as assembly
from ..operators import postings as text_index
from ..operators import summary
from ..operators.custom import CustomLayout
from ..operators.layouts import LAYOUTS
from . import discovery, ingest, lines, scratch
from .paths import Paths

KEEP_DAYS, KEEP_NEWEST = 7, 20
VERSION = "v-"


@dataclass
class Index:
    entries: DataFrame
    files: DataFrame
    meta: dict
    path: str | None = None
    postings: DataFrame | None = None
    counts: summary.Summary | None = None


def fingerprint(spark: SparkSession, paths: list[str], layout: str | CustomLayout, trigrams: bool = False) -> str:
    """Sorted path:mtime (whole seconds):size lines, the trigram option and the layout's own fingerprint."""
    at = Paths(spark)
    rows = [f"{p}:{(e := at.status(p)).mtime_ms // 1000}:{e.size}" for p in sorted(paths)]
    return "\n".join([*rows, f"trigrams:{int(trigrams)}", "format:" + (layout.fingerprint() if isinstance(layout, CustomLayout) else layout)])


def choose_layout(spark: SparkSession, paths: list[str], custom: list[CustomLayout], wanted: str = "auto") -> str | CustomLayout:
    """The layout by its id, or the one that reads the first file best."""
    by_id = {x.id: x for x in custom}
    if wanted != "auto":
        if wanted in LAYOUTS:
            return wanted
        if wanted in by_id:
            return by_id[wanted]
        raise ValueError(f"no such layout: {wanted}")
    if not paths:
        return "default"
    head = spark.read.option("lineSep", "\n").text(sorted(paths)[0]).take(assembly.DETECT_LINES)
    rows = [(1, i, r.value) for i, r in enumerate(head, 1)]
    sample = spark.createDataFrame(rows, "file_id long, line_no long, value string")
    best = assembly.detect(sample, [*LAYOUTS, *custom])
    return by_id.get(best, best)


def read_entries(spark: SparkSession, paths: list[str], layout: str | CustomLayout) -> tuple[DataFrame, DataFrame, DataFrame, list[str]]:
    """(entries, skipped lines, files, copies to drop) of log files."""
    files = discovery.files_table(spark, paths)
    if not paths:
        return *assembly.assemble(spark.createDataFrame([], lines.LINES), layout, files), files, []
    found, skipped, copies = ingest.read(spark, files, sorted(paths), lambda rows: assembly.headed(rows, layout))
    return found, skipped, files, copies


def build(spark: SparkSession, paths: list[str], layout: str | CustomLayout, path: str, trigrams: bool = False) -> Index:
    """Parse, write and publish; ``trigrams`` adds an inverted index for literal searches."""
    at, mark = Paths(spark), fingerprint(spark, paths, layout, trigrams)
    found, skipped, files, copies = read_entries(spark, paths, layout)
    before = _version(spark, path)
    version = f"{VERSION}{uuid.uuid4().hex}"
    new = f"{path}/{version}"
    try:
        # ranges of time: min/max statistics then prune time conditions
        inorder = text_index.numbered(found.repartitionByRange("ts_millis", "file_id").sortWithinPartitions("ts_millis", "file_id", "line_no"))
        inorder.write.option("parquet.page.row.count.limit", text_index.ROWS).parquet(f"{new}/entries")
        summary.write(summary.build(spark.read.parquet(f"{new}/entries")), f"{new}/counts")
        if trigrams:
            text_index.write(text_index.build(spark.read.parquet(f"{new}/entries")), f"{new}/postings")
        files.coalesce(1).write.parquet(f"{new}/files")
        count, samples = assembly.skipped_summary(skipped)
        meta = {"fingerprint": mark, "log_format": layout if isinstance(layout, str) else layout.id, "skipped_lines": count, "skipped_samples": samples, "version": version}
        at.write(f"{new}/meta.json", json.dumps(meta))
        at.write(f"{path}/meta.json", json.dumps(meta))
    except BaseException:
        at.delete(new)
        if not at.listed(path):
            at.delete(path)
        raise
    finally:
        for copy in copies:
            scratch.drop(spark, copy)
    _clear(spark, path, {version, before})
    return open_index(spark, path)


def _complete(spark: SparkSession, path: str) -> list[tuple[int, str]]:
    """(time, name) of the versions that were written to their end."""
    at = Paths(spark)
    return [(e.mtime_ms, e.name) for e in at.listed(path) if e.folder and e.name.startswith(VERSION) and at.exists(f"{e.path}/meta.json")]


def _version(spark: SparkSession, path: str) -> str | None:
    """The version that the place's sidecar names, or the newest complete one."""
    at = Paths(spark)
    try:
        named = json.loads(at.read(f"{path}/meta.json"))["version"]
        if at.exists(f"{path}/{named}/meta.json"):
            return named
    except Exception:  # noqa: BLE001  missing or torn, as the JVM or the parser says it
        pass
    return max(_complete(spark, path), default=(0, None))[1]


def _clear(spark: SparkSession, path: str, kept: set[str | None]) -> None:
    """Complete versions that nobody should still read; others may be in the making."""
    for _, name in _complete(spark, path):
        if name not in kept:
            Paths(spark).delete(f"{path}/{name}")


def open_index(spark: SparkSession, path: str) -> Index:
    at, meta = Paths(spark), read_meta(spark, path)
    here = f"{path}/{meta['version']}"
    postings = spark.read.parquet(f"{here}/postings") if at.exists(f"{here}/postings") else None
    counts = summary.Summary(spark.read.parquet(f"{here}/counts"))
    return Index(spark.read.parquet(f"{here}/entries"), spark.read.parquet(f"{here}/files"), meta, path, postings, counts)


def read_meta(spark: SparkSession, path: str) -> dict:
    """The sidecar; broken samples count as none."""
    version = _version(spark, path)
    if version is None:
        raise ValueError(f"no index at {path}")
    meta = json.loads(Paths(spark).read(f"{path}/{version}/meta.json"))
    samples = meta.get("skipped_samples")
    meta["skipped_samples"] = [tuple(x) for x in samples if isinstance(x, list) and len(x) == 3] if isinstance(samples, list) else []
    return meta


def in_memory(spark: SparkSession, paths: list[str], layout: str | CustomLayout) -> Index:
    """An index for this session only."""
    found, skipped, files, copies = read_entries(spark, paths, layout)
    kept, _ = scratch.save(found)
    count, samples = assembly.skipped_summary(skipped)
    for copy in copies:
        scratch.drop(spark, copy)
    return Index(kept, files, {"fingerprint": fingerprint(spark, paths, layout), "log_format": layout if isinstance(layout, str) else layout.id, "skipped_lines": count, "skipped_samples": samples})


def needs_rebuild(spark: SparkSession, path: str, paths: list[str], layout: str | CustomLayout, trigrams: bool = False) -> bool:
    if not paths:
        return False
    try:
        return read_meta(spark, path)["fingerprint"] != fingerprint(spark, paths, layout, trigrams)
    except (ValueError, KeyError):
        return True


def load(spark: SparkSession, home: str, root: str, custom: list[CustomLayout] | None = None, wanted: str = "auto", trigrams: bool = False) -> Index:
    """Discover, choose a layout, and build the index or use the stored one."""
    paths = discovery.find_log_files(spark, root)
    layout = choose_layout(spark, paths, custom or [], wanted)
    path = place(spark, home, root)
    if needs_rebuild(spark, path, paths, layout, trigrams) or _version(spark, path) is None:
        out = build(spark, paths, layout, path, trigrams)
    else:
        out = open_index(spark, path)
    collect_garbage(spark, home, path)
    return out


def place(spark: SparkSession, home: str, root: str) -> str:
    return posixpath.join(home, root_key(Paths(spark).real(root)))


def collect_garbage(spark: SparkSession, home: str, active: str | None = None, now: float | None = None) -> list[str]:
    """Delete indexes that are old or beyond the newest few, never the active one."""
    now, at = now or time.time(), Paths(spark)
    found = sorted(((e.mtime_ms / 1000, e.path) for e in at.listed(home) if e.folder), reverse=True)
    room = KEEP_NEWEST - (active is not None)
    gone = []
    for age, p in found:
        if active is not None and at.real(p) == at.real(active):
            continue
        if now - age > KEEP_DAYS * 86_400 or room <= 0:
            at.delete(p)
            gone.append(p)
        else:
            room -= 1
    return gone
