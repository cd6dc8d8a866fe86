"""Secret scans over a trigram inverted index.

Every rule's regular expression is parsed into a Boolean query over the trigrams that any
match must hold. A slice of documents (an index segment) gets postings for the trigrams
that the rules ask for; a rule's query intersects and unites postings, and only the
documents it leaves are verified with the regular expression. A rule without mandatory
trigrams (``hex``) scans every document. Segments need no shuffle and stay in memory, so
the work is spread by scan partitions alone.

Null text is the empty text and has no spans. Offsets are code points, end exclusive.
Matches of one kind are leftmost and do not overlap; those that fail the rule's test are
dropped after matching. Extra columns are ignored; rows of equal doc_id are scanned alike.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from re import _constants as op
from re import _parser as parser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import store, text

#: A query is True (no mandatory trigram), a trigram, or ("and" | "or", queries).
Query = bool | str | tuple

#: Alternatives kept as whole strings while a regular expression is taken apart.
MAX_STRINGS = 48
MAX_CLASS = 10


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    flags: int = re.ASCII
    test: Callable[[re.Match], bool] | None = None

    @property
    def regex(self) -> re.Pattern:
        return re.compile(self.pattern, self.flags)


#: The base rules, in the order of ``base_sha256``.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE, lambda m: m.end(2) - m.start(2) >= 12),
    Rule("access", r"AKIA[A-Z0-9]+", re.ASCII, lambda m: m.end() - m.start() >= 18),
    Rule("hex", r"[0-9a-f]{16,}"),  # the runs [0-9a-f]+ of 16 and more
)
#: Rules that the method adds.
ADDED = (
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("cloud", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("pay", r"[sr]k_(?:live|test)_[0-9A-Za-z]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("pem", r"-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----"),
)
RULES = BASE + ADDED


def both(*qs: Query) -> Query:
    qs = tuple(dict.fromkeys(q for q in qs if q is not True))
    return True if not qs else qs[0] if len(qs) == 1 else ("and", qs)


def either(*qs: Query) -> Query:
    qs = tuple(dict.fromkeys(qs))
    return True if True in qs or not qs else qs[0] if len(qs) == 1 else ("or", qs)


def of_strings(found: set[str]) -> Query:
    """What a text must hold if it holds one of these (ASCII-lowered) strings.

    Postings are over bytes, so only trigrams of ASCII characters are asked for.
    """
    if any(len(x) < 3 for x in found):
        return True
    return either(*(both(*(g for i in range(len(x) - 2) if (g := x[i : i + 3]).isascii())) for x in sorted(found)))


def fold(code: int) -> str:
    c = chr(code)
    return c.lower() if c.isascii() else c


def alternatives(items) -> set[str] | None:
    """The characters of a small class, or None."""
    out: set[str] = set()
    for kind, value in items:
        if kind is op.LITERAL:
            out.add(fold(value))
        elif kind is op.RANGE and value[1] - value[0] < MAX_CLASS:
            out |= {fold(x) for x in range(value[0], value[1] + 1)}
        else:
            return None
    return out if len(out) <= MAX_CLASS else None


def derive(tree) -> tuple[set[str] | None, Query]:
    """All strings a piece can match (None: too many), and the query it implies."""
    run: set[str] = {""}
    whole, needs = True, []

    def cut() -> None:
        nonlocal run, whole
        needs.append(of_strings(run))
        run, whole = {""}, False

    def append(strings: set[str]) -> None:
        nonlocal run
        if len(run) * len(strings) > MAX_STRINGS:
            cut()
        run = {a + b for a in run for b in strings}

    for kind, value in tree:
        if kind is op.LITERAL:
            append({fold(value)})
        elif kind is op.IN:
            if (some := alternatives(value)) is None:
                cut()
            else:
                append(some)
        elif kind is op.SUBPATTERN:
            strings, query = derive(value[-1])
            if strings is None or len(strings) > MAX_STRINGS:
                cut()
                needs.append(query)
            else:
                append(strings)
        elif kind is op.BRANCH:
            parts = [derive(x) for x in value[1]]
            if all(s is not None for s, _ in parts) and len(strings := set().union(*(s for s, _ in parts))) <= MAX_STRINGS:
                append(strings)
            else:
                cut()
                needs.append(either(*(q if s is None else of_strings(s) for s, q in parts)))
        elif kind in (op.MAX_REPEAT, op.MIN_REPEAT, op.POSSESSIVE_REPEAT):
            least, most, inner = value
            strings, query = derive(inner)
            if strings is not None and least == 0 and most == 1:
                append(strings | {""})
            elif strings is not None and least == most == 1:
                append(strings)
            else:
                if strings is not None and 0 < least <= 8 and len(strings) <= MAX_CLASS:
                    for _ in range(least):
                        append(strings)
                cut()
                if least and strings is None:
                    needs.append(query)
        elif kind not in (op.AT, op.ASSERT, op.ASSERT_NOT):
            cut()
    return (run, of_strings(run)) if whole else (None, both(*needs, of_strings(run)))


def trigram_query(rule: Rule) -> Query:
    strings, query = derive(parser.parse(rule.pattern, rule.flags))
    return of_strings(strings) if strings is not None else query


def mentioned(q: Query) -> set[str]:
    if q is True:
        return set()
    return {q} if isinstance(q, str) else set().union(*map(mentioned, q[1]))


class Index:
    """Postings of the trigrams that the rules mention, for one segment after another."""

    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = rules
        self.queries = [trigram_query(r) for r in rules]
        self.regexes = [r.regex for r in rules]
        grams = sorted(set().union(*map(mentioned, self.queries)))
        self.slots = {g: i for i, g in enumerate(grams)}
        self.lookup = np.full(1 << 24, -1, np.int16)
        for g, i in self.slots.items():
            a, b, c = g.encode()
            self.lookup[a << 16 | b << 8 | c] = i

    def postings(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Bitmap of documents for each trigram."""
        docs = len(off) - 1
        bits = np.zeros((len(self.slots), docs), bool)
        if len(data) > 2:
            d = text.lowered(data).astype(np.int32)
            slot = self.lookup[d[:-2] << 16 | d[1:-1] << 8 | d[2:]]
            at = np.flatnonzero(slot >= 0)
            bits[slot[at], np.searchsorted(off, at, "right") - 1] = True
        return bits

    def candidates(self, q: Query, bits: np.ndarray) -> np.ndarray:
        if q is True:
            return np.ones(bits.shape[1], bool)
        if isinstance(q, str):
            return bits[self.slots[q]]
        join = np.logical_and if q[0] == "and" else np.logical_or
        return join.reduce([self.candidates(x, bits) for x in q[1]])

    def spans(self, data: np.ndarray, off: np.ndarray) -> list[list[tuple[str, int, int]]]:
        """(kind, start, end) of each document, by start, then kind as listed."""
        bits, texts = self.postings(data, off), text.strings(data, off)
        found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        for k, (rule, query, regex) in enumerate(zip(self.rules, self.queries, self.regexes, strict=True)):
            for i in np.flatnonzero(self.candidates(query, bits)).tolist():
                for m in regex.finditer(texts[i]):
                    if rule.test is None or rule.test(m):
                        found[i].append((m.start(), k, m.end()))
        return [[(self.rules[k].kind, a, b) for a, k, b in sorted(x)] for x in found]


SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
_index: dict[tuple, Index] = {}


def index(rules: tuple[Rule, ...]) -> Index:
    """One for each worker process; rules are told apart by kind and pattern."""
    key = tuple((r.kind, r.pattern, r.flags) for r in rules)
    if key not in _index:
        _index[key] = Index(rules)
    return _index[key]


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, spans array<struct<kind, start, end>> of every row."""
    schema = pa.schema([("doc_id", pa.int64()), ("spans", SPAN)])

    def run(it):
        ix = index(rules)
        for part, data, off in text.slices(it):
            rows = [[{"kind": k, "start": a, "end": b} for k, a, b in x] for x in ix.spans(data, off)]
            yield text.table(schema, part.column("doc_id"), rows)

    return store.documents(docs).mapInArrow(run, "doc_id long, spans array<struct<kind:string,start:long,end:long>>")


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, column: str = "text") -> DataFrame:
    """``docs`` with every span in ``column`` replaced by ``[kind]``; null stays null.

    Spans that overlap become one, named by the first of them. All rows and columns stay.
    """

    def clean(x: str, spans: list[tuple[str, int, int]]) -> str:
        out, at, n = [], 0, len(spans)
        i = 0
        while i < n:
            kind, a, b = spans[i]
            i += 1
            while i < n and spans[i][1] < b:
                b = max(b, spans[i][2])
                i += 1
            out += [x[at:a], f"[{kind}]"]
            at = b
        return "".join([*out, x[at:]])

    def run(it):
        ix = index(rules)
        for batch in it:
            where = batch.schema.get_field_index(column)
            for part, data, off in text.slices([batch.rename_columns([("text" if i == where else f"c{i}") for i in range(batch.num_columns)])]):
                spans = ix.spans(data, off)
                if any(spans):
                    null = part.column(where).is_null().to_pylist()
                    texts = [None if gone else clean(x, s) if s else x for x, s, gone in zip(text.strings(data, off), spans, null, strict=True)]
                    part = part.set_column(where, "text", pa.array(texts, part.column(where).type))
                yield part.rename_columns(batch.schema.names)

    return store.small_batches(docs).mapInArrow(run, docs.schema)


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def of_kind(kind: str) -> Callable[[Column], Column]:
    return lambda s: s["kind"] == kind


def digests(scanned: DataFrame) -> DataFrame:
    """Counts, digest and listing of the spans that ``scan`` found."""
    base = [r.kind for r in BASE]
    own = F.filter("spans", lambda s: s["kind"].isin(base))
    counts = [F.size(F.filter("spans", of_kind(k))).cast("long").alias(f"n_{k}") for k in base]
    return scanned.select("doc_id", *counts, F.sha2(joined(own).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
