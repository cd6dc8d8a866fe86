"""Saved searches and traces in a JSON file.

An item is known by its name and mode; saving again replaces it, the first where the file
has several. Field values are kept as they are. An item without a mode is a search. A broken
item is left out and counted, as are those beyond the limit; a broken file fails as a whole,
and a file of which anything was left out is not written. A file without text or items has
none. It may lie on any file system of Spark's.
"""

from __future__ import annotations

import datetime as dt
import json
import uuid
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession

from ..functions.strings import has_control, is_uuid
from .textfile import TextFile

#: Limits (fixed values).
MAX_ITEMS, MAX_NAME, MAX_FIELD, MAX_BYTES = 200, 100, 4000, 1_000_000
#: Fields that are kept, by mode (fixed values).
FIELDS = {
    "search": ("level", "logger", "thread", "message", "grep", "source", "page-limit", "since-date", "since-time", "until-date", "until-time"),
    "trace": ("trace-mode", "trace-id", "trace-start", "trace-end", "trace-max-minutes", "trace-window-secs", "trace-contains", "trace-excludes"),
}


@dataclass(frozen=True)
class SavedSearch:
    id: str
    name: str
    saved_at: str
    mode: str
    fields: dict[str, str]

    def record(self) -> dict:
        return {"id": self.id, "name": self.name, "savedAt": self.saved_at, "mode": self.mode, "fields": self.fields}


def checked(id: str, name: object, saved_at: object, mode: object, fields: object) -> SavedSearch:
    if not isinstance(id, str) or not is_uuid(id):
        raise ValueError("not an id")
    if not isinstance(name, str) or not name.strip() or len(name.strip()) > MAX_NAME or has_control(name):
        raise ValueError("not a name")
    mode = mode or "search"
    if not isinstance(mode, str) or mode not in FIELDS:
        raise ValueError("mode is search or trace")
    fields, kept = {} if fields is None else fields, {}
    if not isinstance(fields, dict):
        raise ValueError("fields are no object")
    for key in FIELDS[mode]:
        value = fields.get(key)
        if value is None or value == "":
            continue
        if not isinstance(value, str) or len(value) > MAX_FIELD:
            raise ValueError(f"not a value of {key}")
        kept[key] = value
    return SavedSearch(id, name.strip(), saved_at if isinstance(saved_at, str) else "", mode, kept)


class SavedSearches:
    def __init__(self, path: str, spark: SparkSession | None = None):
        self.path = path
        self._file = TextFile(path, MAX_BYTES, spark)

    def load(self) -> tuple[list[SavedSearch], int, bool]:
        """Items, how many were left out, and whether there are too many."""
        text = self._file.read().strip()
        data = json.loads(text) if text else {}
        if not isinstance(data, dict):
            raise ValueError(f"{self.path} holds no saved searches")
        version, found = data.get("version"), data.get("items")
        if version is not None and not isinstance(version, (dict, list)) and (isinstance(version, bool) or int(version) != 1):
            raise ValueError(f"{self.path} has another version: {version}")
        if not isinstance([] if found is None else found, list):
            raise ValueError(f"the items of {self.path} are no list")
        items: list[SavedSearch] = []
        skipped, overflow = 0, False
        for x in found or ():
            overflow |= len(items) >= MAX_ITEMS
            try:
                if overflow:
                    raise ValueError("too many")
                items.append(checked(*(x.get(k) for k in ("id", "name", "savedAt", "mode", "fields"))))
            except (ValueError, AttributeError, TypeError):
                skipped += 1
        return items, skipped, overflow

    def list(self) -> list[SavedSearch]:
        return self.load()[0]

    def _write(self, items: list[SavedSearch], seen: tuple[int, int] | None) -> None:
        self._file.replace(json.dumps({"version": 1, "items": [i.record() for i in items]}, ensure_ascii=False, indent=2), seen)

    def _writable(self) -> list[SavedSearch]:
        items, skipped, overflow = self.load()
        if skipped or overflow:
            raise ValueError(f"{self.path} has items that were left out; correct it by hand first")
        return items

    def upsert(self, name: str, mode: str, fields: dict[str, str]) -> SavedSearch:
        now = dt.datetime.now(dt.UTC).isoformat(timespec="milliseconds").replace("+00:00", "Z")
        item = checked(str(uuid.uuid4()), name, now, mode, fields)
        with self._file.turn():
            seen, items = self._file.stamp(), self._writable()
            place = next((n for n, i in enumerate(items) if (i.name, i.mode) == (item.name, item.mode)), len(items))
            if place < len(items):
                item = replace(item, id=items[place].id)
            elif place >= MAX_ITEMS:
                raise ValueError(f"more than {MAX_ITEMS} saved searches")
            self._write([*items[:place], item, *items[place + 1 :]], seen)
        return item

    def delete(self, id: str) -> bool:
        with self._file.turn():
            seen, items = self._file.stamp(), self._writable()
            rest = [i for i in items if i.id != id]
            if len(rest) == len(items):
                return False
            self._write(rest, seen)
        return True

    def frame(self, spark: SparkSession) -> DataFrame:
        rows = [(i.id, i.name, i.saved_at, i.mode, i.fields) for i in self.list()]
        return spark.createDataFrame(rows, "id string, name string, savedAt string, mode string, fields map<string,string>")
