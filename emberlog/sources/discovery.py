"""Which files are logs, and in which order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.strings import plain_path
from .paths import Paths

#: File names that are logs, in any case (fixed values).
NAMES = ("application*.log*", "server*.log*", "spring*.log*", "catalina*.log*", "localhost*.log*", "app*.log*", "*.log", "*.out")
#: Endings of compressed files, which are not read (fixed values).
PACKED = (".gz", ".bz2", ".xz")
#: Directories that are not entered (fixed values), and this engine's own.
PRUNED = frozenset((".git", "__pycache__", "node_modules", ".venv", "venv", ".tox", ".mypy_cache", ".pytest_cache", ".emberlog"))

FILES = "file_id long, path string, mtime_secs long, size long"


def glob_regex(pattern: str) -> str:
    """A glob of ``*`` and ``?`` as an anchored regular expression."""
    return r"(?s)\A" + "".join(".*" if c == "*" else "." if c == "?" else "\\" + c if not c.isalnum() and c.isascii() else c for c in pattern) + r"\z"


def glob_match(pattern: str, name: str) -> bool:
    """Greedy match with one step back to the last ``*``."""
    p = n = 0
    star, mark = -1, 0
    while n < len(name):
        if p < len(pattern) and pattern[p] == "*":
            star, mark, p = p, n, p + 1
        elif p < len(pattern) and pattern[p] in ("?", name[n]):
            p, n = p + 1, n + 1
        elif star >= 0:
            mark += 1
            p, n = star + 1, mark
        else:
            return False
    return all(c == "*" for c in pattern[p:])


def is_log_name(name: str) -> bool:
    low = name.lower()
    return not low.endswith(PACKED) and any(glob_match(g, low) for g in NAMES)


def log_name_column(name: Column) -> Column:
    low = F.lower(name)
    every = "|".join(f"(?:{glob_regex(g)})" for g in NAMES)
    return low.rlike(every) & ~low.rlike(r"\.(gz|bz2|xz)$")


def find_log_files(spark: SparkSession, root: str) -> list[str]:
    """Real paths of the log files below a directory, in order; linked directories are not entered."""
    at = Paths(spark)
    return sorted({at.real(e.path) for e in at.files(root, lambda name: name not in PRUNED) if is_log_name(e.name)})


def files_table(spark: SparkSession, paths: list[str]) -> DataFrame:
    """file_id (from 1, by path), path, mtime_secs, size."""
    at = Paths(spark)
    rows = [(i, p, (e := at.status(p)).mtime_ms // 1000, e.size) for i, p in enumerate(sorted(paths), 1)]
    return spark.createDataFrame(rows, FILES)


def browse(path: str | None, spark: SparkSession | None = None) -> dict:
    """Sub-directories of a directory, without hidden ones, in any case's order."""
    at = Paths(spark or SparkSession.active())
    here, parent = at.above(plain_path(path) if path else at.home())
    if not at.is_folder(here):
        raise ValueError(f"not a directory: {path}")
    names = [e.name for e in at.listed(here) if e.folder and not e.name.startswith(".")]
    return {"path": here, "parent": parent, "directories": sorted(names, key=lambda n: (n.lower(), n))}
