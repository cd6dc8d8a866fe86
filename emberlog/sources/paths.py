"""Files and folders wherever Spark reads them: a disk, HDFS, an object store.

A path without a scheme is one of Spark's default file system.
"""

from __future__ import annotations

import os
import time
from collections.abc import Callable, Iterator
from typing import NamedTuple

from pyspark.sql import SparkSession


class Entry(NamedTuple):
    path: str  # without a scheme on a local disk
    name: str
    folder: bool
    mtime_ms: int
    size: int


class Paths:
    def __init__(self, spark: SparkSession):
        self._jvm, self._conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, path: str):
        p = self._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self._conf), p

    def is_local(self, path: str) -> bool:
        return self._at(path)[0].getScheme() == "file"

    def real(self, path: str) -> str:
        """The absolute path; on a local disk without a scheme and with links followed."""
        fs, p = self._at(path)
        whole = p.makeQualified(fs.getUri(), fs.getWorkingDirectory())
        return os.path.realpath(whole.toUri().getPath()) if self.is_local(path) else whole.toString()

    def _entry(self, status, local: bool) -> Entry:
        p = status.getPath()
        return Entry(p.toUri().getPath() if local else p.toString(), p.getName(), status.isDirectory(), status.getModificationTime(), status.getLen())

    def status(self, path: str) -> Entry:
        fs, p = self._at(path)
        return self._entry(fs.getFileStatus(p), self.is_local(path))

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p)

    def is_folder(self, path: str) -> bool:
        return self.exists(path) and self.status(path).folder

    def listed(self, folder: str) -> list[Entry]:
        """What a folder holds; nothing if it cannot be read."""
        fs, p = self._at(folder)
        local = self.is_local(folder)
        try:
            return [self._entry(s, local) for s in fs.listStatus(p)]
        except Exception:  # noqa: BLE001  the JVM's errors on folders that may not be read
            return []

    def files(self, root: str, enter: Callable[[str], bool]) -> Iterator[Entry]:
        """All files below a folder; linked folders of a local disk are not entered."""
        local, open_ = self.is_local(root), [root]
        while open_:
            for e in self.listed(open_.pop()):
                if not e.folder:
                    yield e
                elif enter(e.name) and not (local and os.path.islink(e.path)):
                    open_.append(e.path)

    def write(self, path: str, text: str) -> None:
        fs, p = self._at(path)
        out = fs.create(p, True)
        out.write(bytearray(text.encode()))
        out.close()

    def read(self, path: str) -> str:
        fs, p = self._at(path)
        stream = fs.open(p)
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _plain(self, path: str):
        """Without the checksum file that Hadoop keeps beside a local one."""
        fs, p = self._at(path)
        return (fs.getRawFileSystem() if fs.getScheme() == "file" else fs), p

    def write_plain(self, path: str, text: str) -> None:
        fs, p = self._plain(path)
        out = fs.create(p, True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()

    def read_plain(self, path: str) -> str:
        fs, p = self._plain(path)
        stream = fs.open(p)
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def move_over(self, new: str, path: str) -> bool:
        """Move a file over another in one step; False where the file system refuses."""
        fs, a = self._plain(new)
        b = self._at(path)[1]
        try:
            if self.is_local(path):
                return fs.rename(a, b)
            rename = self._jvm.org.apache.hadoop.fs.Options.Rename
            how = SparkSession.active().sparkContext._gateway.new_array(rename, 1)
            how[0] = rename.OVERWRITE
            self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self._conf).rename(a, b, how)
            return True
        except Exception:  # noqa: BLE001  the JVM's errors on what may not be moved
            return False

    def claim(self, path: str) -> bool:
        """Make a file that nobody has made yet; False if it is there."""
        fs, p = self._plain(path)
        fs.mkdirs(p.getParent())
        if self.is_local(path):  # Hadoop looks first and makes it then
            try:
                os.close(os.open(p.toUri().getPath(), os.O_CREAT | os.O_EXCL))
            except FileExistsError:
                return False
            return True
        try:
            fs.create(p, False).close()
        except Exception:  # noqa: BLE001  the JVM's error on a file that is there
            if not fs.exists(p):
                raise
            return False
        return True

    def age(self, path: str) -> float | None:
        """Seconds since a file was written; None if it is gone."""
        try:
            return time.time() - self.status(path).mtime_ms / 1000
        except Exception:  # noqa: BLE001  the JVM's error on a file that is gone
            return None

    def home(self) -> str:
        """The user's folder on the default file system."""
        p = self._jvm.org.apache.hadoop.fs.FileSystem.get(self._conf).getHomeDirectory()
        return p.toUri().getPath() if self.is_local(p.toString()) else p.toString()

    def above(self, path: str) -> tuple[str, str | None]:
        """A folder's absolute path and the one above it; links are not followed."""
        fs, p = self._at(path)
        whole = p.makeQualified(fs.getUri(), fs.getWorkingDirectory())
        return tuple(None if x is None else x.toUri().getPath() if self.is_local(path) else x.toString() for x in (whole, whole.getParent()))

    def delete(self, path: str) -> None:
        fs, p = self._at(path)
        fs.delete(p, True)

    def move(self, new: str, path: str) -> None:
        """Move a file or folder to its place; what stood there goes first."""
        self.delete(path)
        fs, p = self._at(new)
        if not fs.rename(p, self._at(path)[1]):
            raise OSError(f"{new} could not be moved to {path}")
