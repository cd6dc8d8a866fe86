"""String functions: ASCII folding, literals in patterns, labels and cuts."""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_META = set(".^$*+?()[]{}|\\")


def ascii_lower(x: Column) -> Column:
    return F.translate(x, UPPER, LOWER)


def ascii_lowered(x: str) -> str:
    return x.translate(str.maketrans(UPPER, LOWER))


def is_plain(pattern: str) -> bool:
    """No character of the pattern has a meaning in regular expressions."""
    return not _META & set(pattern)


def quoted(literal: str) -> str:
    r"""A pattern that matches exactly this text: \Q...\E, also if \E occurs in it."""
    return "\\Q" + literal.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def find_ignoring_case(x: Column, pattern: str) -> Column:
    """Whether the pattern is found; only ASCII letters are folded."""
    if is_plain(pattern):
        return ascii_lower(x).contains(ascii_lowered(pattern))
    return x.rlike("(?i)" + pattern)


def holds(x: Column, literal: str) -> Column:
    """Whether the text holds the literal, in this case."""
    return x.contains(literal)


def trigrams(text: str) -> list[str]:
    """Distinct trigrams of code points in order; none for shorter texts."""
    return list(dict.fromkeys(text[i : i + 3] for i in range(len(text) - 2)))


def trigram_column(x: Column) -> Column:
    return F.when(F.char_length(x) >= 3, F.array_distinct(F.transform(F.sequence(F.lit(1), F.char_length(x) - 2), lambda i: F.substring(x, i, F.lit(3))))).otherwise(F.array().cast("array<string>"))


def without_line_end(x: Column) -> Column:
    return F.when(x.endswith("\n") | x.endswith("\r"), F.regexp_replace(x, r"[\r\n]+\z", "")).otherwise(x)


def is_blank_line(x: Column) -> Column:
    return x.rlike(r"\A[ \t\r\n]*\z")


def preview(x: Column, longest: int = 120) -> Column:
    """The line without its end, cut with ``...`` if it is longer than ``longest``."""
    line = without_line_end(x)
    return F.when(F.length(line) > longest, F.concat(F.substring(line, 1, longest - 3), F.lit("..."))).otherwise(line)


def truncated(x: Column, longest: int = 4096) -> Column:
    return F.substring(x, 1, longest)


def short_logger(x: Column) -> Column:
    return F.substring_index(x, ".", -1)


def source_label(path: Column, line_no: Column | None = None) -> Column:
    """The last two components of a path, and the line."""
    label = F.substring_index(F.regexp_replace(path, r"\\", "/"), "/", -2)
    return label if line_no is None else F.concat(label, F.lit(":"), line_no.cast("string"))


#: Levels that are shown like another one (fixed values).
LEVEL_CLASSES = {"FATAL": "error", "SEVERE": "error", "WARNING": "warn", "CONFIG": "info", "FINE": "debug", "FINER": "debug", "FINEST": "trace"}


def level_class(level: Column) -> Column:
    out = F.lower(level)
    for name, shown in LEVEL_CLASSES.items():
        out = F.when(F.upper(level) == name, shown).otherwise(out)
    return out


def highlight_class(row: Column, needles: list[str]) -> Column:
    """Number, from 1, of the first needle that the row holds in any case; else null."""
    low = F.lower(row)
    cases = [F.when(low.contains(n.lower()), i) for i, n in enumerate(needles, 1) if n]
    return F.coalesce(*cases) if cases else F.lit(None).cast("int")


def path_column(path: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(path, r"^\\\\\?\\UNC\\", r"\\\\"), r"^\\\\\?\\", "")


def plain_path(path: str) -> str:
    """A Windows path without its long-path prefix."""
    if path.startswith("\\\\?\\UNC\\"):
        return "\\\\" + path[8:]
    return path.removeprefix("\\\\?\\")


def root_key(path: str) -> str:
    return hashlib.sha256(path.encode()).hexdigest()


def root_key_column(path: Column) -> Column:
    return F.sha2(path.cast("binary"), 256)


def is_format_id(x: str) -> bool:
    return bool(re.fullmatch(r"[a-z0-9][a-z0-9-]*", x))


def is_uuid(x: str) -> bool:
    return bool(re.fullmatch(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}", x))


def is_format_id_column(x: Column) -> Column:
    return x.rlike(r"\A[a-z0-9][a-z0-9-]*\z")


def is_uuid_column(x: Column) -> Column:
    return x.rlike(r"\A[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}\z")


def has_control(x: str) -> bool:
    return any(ord(c) < 32 or ord(c) == 127 for c in x)


def has_control_column(x: Column) -> Column:
    return x.rlike(r"[\x00-\x1f\x7f]")
