"""Small text files on any of Spark's file systems that people and several programs write.

A file is read whole and replaced whole: the new text is written beside it and moved over it
in one step, so a reader finds the old text or the new one. Those who change a file take
turns, by a lock beside it, and read it in their turn; so none loses another's change. A text
that was edited by hand between reading and replacing is left as it is, and the change fails.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

from .paths import Paths

#: Seconds to wait for one's turn, and after which a lock counts as left behind.
PATIENCE, STALE = 20.0, 60.0


class TextFile:
    def __init__(self, path: str, longest: int, spark: SparkSession | None = None):
        self.path, self.longest, self._spark = path, longest, spark

    @property
    def _at(self) -> Paths:
        return Paths(self._spark or SparkSession.active())

    def stamp(self) -> tuple[int, int] | None:
        """Time and size; None if there is no file."""
        if not self._at.exists(self.path):
            return None
        e = self._at.status(self.path)
        if e.folder:
            raise ValueError(f"{self.path} is no file")
        return e.mtime_ms, e.size

    def read(self) -> str:
        """The text without a byte order mark; nothing if there is no file."""
        seen = self.stamp()
        if seen is None:
            return ""
        if seen[1] > self.longest:
            raise ValueError(f"{self.path} is larger than {self.longest} bytes")
        return self._at.read_plain(self.path).removeprefix("\ufeff")

    @contextmanager
    def turn(self) -> Iterator[None]:
        """One's turn to change the file; ValueError if it does not come."""
        at, lock, end = self._at, f"{self.path}.lock", time.monotonic() + PATIENCE
        while not at.claim(lock):
            held = at.age(lock)
            if held is not None and held > STALE:
                at.delete(lock)
            elif time.monotonic() > end:
                raise ValueError(f"{self.path} is being changed by another program")
            else:
                time.sleep(0.05)
        try:
            yield
        finally:
            at.delete(lock)

    def replace(self, text: str, seen: tuple[int, int] | None) -> None:
        """Put a text in the place of the one whose stamp was ``seen``."""
        if len(text.encode()) > self.longest:
            raise ValueError(f"more than {self.longest} bytes")
        new = f"{self.path}.{uuid.uuid4().hex}.new"
        self._at.write_plain(new, text)
        try:
            if self.stamp() != seen:
                raise ValueError(f"{self.path} was changed meanwhile")
            if not self._at.move_over(new, self.path):  # a mounted file, say, can only be written
                self._at.write_plain(self.path, text)
        finally:
            self._at.delete(new)
