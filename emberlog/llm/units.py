"""Removal of repeated passages by hashing units of text.

Units are lines, of any number of words, and the sentences inside them of at least
``MIN_WORDS`` words, since shared passages also lie inside longer lines. A sentence is a run
without ``.!?`` and line ends, with the run of those that follows it; a line ends with a
sentence that a line end closes. A unit is normalised to its lower-cased (A-Z) words joined by
one blank and grouped by a 128-bit digest over the whole table. The occurrence that ranks
first, by doc_id and offset, stays; all later ones are removed, in the same document too.
Removed spans keep their original code-point offsets.

With ``runs`` the minimum applies to what repeats, not to each sentence: a run of
neighbouring sentences of a document, short ones included, goes where the same words in a row
stand earlier. Digests are taken of the shortest runs of ``MIN_WORDS`` words and more that
begin, and of those that end, with each sentence. Together they cover every sentence of a
longer repeated run. Lines of fewer words are units as above. A short sentence inside a line
of its own making stays, as may a blank one between two runs.

Digests alone are shuffled to find repeated ones; partial aggregation meets hot units, and
the join that returns to the occurrences is one that Spark splits where it is skewed.
Null text has no units and stays null; so does empty text. Rows with a null doc_id rank after
all others, and rows of one doc_id, or without one, by a hash of their texts. Of rows equal in
doc_id and text one keeps what stands first there, and all others lose every line. A very long
text is one row of its task. No rows give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import store, text

MIN_WORDS = 6
_END = np.zeros(256, bool)
_END[[ord("."), ord("!"), ord("?"), ord("\n")]] = True
_LAST = (1 << 63) - 1


def edges(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Ascending byte offsets of all sentences of a slice, the end included."""
    n = len(data)
    start = np.zeros(n + 1, bool)
    start[off] = True
    if n:
        end = _END[data]
        start[1:n] |= end[:-1] & ~end[1:]
    start[n] = True
    return np.flatnonzero(start)


class Units:
    """Sentences of a slice: byte offsets, document, words and both digest lanes."""

    def __init__(self, data: np.ndarray, off: np.ndarray):
        self.edges = edges(data, off)
        w = text.words(data, self.edges)
        hashes = text.word_hashes(data, w)
        first, last = w.first[:-1], w.first[1:]
        self.words = last - first
        self.hashes, self.first = hashes, w.first
        self.doc = np.searchsorted(off, self.edges[:-1], "right") - 1
        self.off = off
        newlines = np.concatenate([[0], np.cumsum(data == ord("\n"))])
        self.closes = np.diff(newlines[self.edges]) > 0  # the sentence ends its line

    def lines(self) -> tuple[np.ndarray, np.ndarray]:
        """First and last sentence of each line that holds a word."""
        n = len(self.words)
        last = self.closes.copy()
        last[:-1] |= self.doc[1:] != self.doc[:-1]
        if n:
            last[-1] = True
        to = np.flatnonzero(last)
        begin = np.concatenate([[0], to[:-1] + 1]) if len(to) else to
        some = self.first[to + 1] > self.first[begin]
        return begin[some], to[some]

    def spans(self, min_words: int, runs: bool) -> tuple[np.ndarray, np.ndarray]:
        """First and last sentence of whatever is digested."""
        begin_, to_ = self.lines()
        size = self.first[to_ + 1] - self.first[begin_]
        if not runs:
            on = np.flatnonzero(self.words >= min_words)
            new = (begin_ < to_) | (size < min_words)  # a line of one long sentence is there already
            return np.concatenate([on, begin_[new]]), np.concatenate([on, to_[new]])
        on = np.flatnonzero(self.words > 0)
        a, b = self.first[on], self.first[on + 1]
        # sentences that hold the min_words-th word from one's begin on, and back from its end
        word = np.repeat(np.arange(len(self.words)), self.words)
        n, doc = len(word), self.doc
        to = np.where(a + min_words <= n, word[np.minimum(a + min_words, n) - 1], -1)
        begin = np.where(b >= min_words, word[np.maximum(b - min_words, 0)], -1)
        ahead = (to >= 0) & (doc[to] == doc[on])
        back = (begin >= 0) & (doc[begin] == doc[on])
        end = np.full(len(self.words), -1)
        end[on[ahead]] = to[ahead]
        back &= end[begin] != on  # not both
        short = size < min_words
        return np.concatenate([on[ahead], begin[back], begin_[short]]), np.concatenate([to[ahead], on[back], to_[short]])

    def digest(self, i: np.ndarray, j: np.ndarray, lane: int) -> np.ndarray:
        """Of the words of sentences i to j."""
        return text.span_hashes(self.hashes, self.first[i], self.first[j + 1], lane).view(np.int64)


def _ranked(docs: DataFrame) -> DataFrame:
    """key and tie, by which rows rank, and text."""
    body = F.col("text").cast("string")
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("key"), F.xxhash64(F.coalesce(body, F.lit(""))).alias("tie"), body.alias("text"))


def occurrences(docs: DataFrame, min_words: int, runs: bool = False) -> DataFrame:
    """key, tie, start (bytes), h1, h2 of every unit."""
    schema = pa.schema([("key", pa.int64()), ("tie", pa.int64()), ("start", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64())])

    def run(it):
        for part, data, off in text.slices(it):
            u = Units(data, off)
            i, j = u.spans(min_words, runs)
            keys, ties = part.column("key").to_numpy(), part.column("tie").to_numpy()
            yield text.table(schema, keys[u.doc[i]], ties[u.doc[i]], u.edges[i] - off[u.doc[i]], u.digest(i, j, 0), u.digest(i, j, 1))

    return _ranked(docs).mapInArrow(run, "key long, tie long, start long, h1 long, h2 long")


def _marked(docs: DataFrame, columns: list) -> DataFrame:
    """``columns`` of all rows with text, key, tie and whether the row repeats another.

    Only rows whose doc_id and text another row shares are written, under a number each, so
    that exactly one of them is the first, however many there are.
    """
    body = F.col("text").cast("string")
    rows = docs.select(*columns, body.alias("text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("key"), F.xxhash64(F.coalesce(body, F.lit(""))).alias("tie"))
    shared, _ = store.save(_ranked(docs).groupBy("key", "tie").agg(F.count("*").alias("n")).where("n > 1").select("key", "tie"))
    if not shared.head(1):
        return rows.withColumn("again", F.lit(False))
    copies, _ = store.save(rows.join(shared, ["key", "tie"], "left_semi").withColumn("number", F.monotonically_increasing_id()))
    first = copies.groupBy("key", "tie").agg(F.min("number").alias("first"))
    again = copies.join(first, ["key", "tie"]).withColumn("again", F.col("number") > F.col("first")).drop("number", "first")
    return rows.join(shared, ["key", "tie"], "left_anti").withColumn("again", F.lit(False)).unionByName(again)


def _cut(docs: DataFrame, min_words: int, runs: bool) -> DataFrame:
    """Columns of ``docs`` as c0, c1, ..., the text cut, with n_units, n_removed and removed."""
    docs = store.small_batches(docs)
    found = occurrences(docs, min_words, runs)
    first = found.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min(F.struct("key", "tie", "start")).alias("first")).where("n > 1").select("h1", "h2", "first")
    later = found.join(first, ["h1", "h2"]).where(F.struct("key", "tie", "start") != F.col("first"))
    cut = later.groupBy("key", "tie").agg(F.collect_set(F.struct("start", "h1")).alias("cut"))
    names = docs.columns
    at = names.index("text")
    plain = _marked(docs, [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names) if i != at]).join(cut, ["key", "tie"], "left").drop("key", "tie")
    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    fields = [T.StructField(f"c{i}", f.dataType if i != at else T.StringType()) for i, f in enumerate(docs.schema.fields)]
    schema = T.StructType([*fields, T.StructField("n_units", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("removed", T.ArrayType(span))])
    spans_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(it):
        for part, data, off in text.slices(it):
            u, cuts, again = Units(data, off), part.column("cut"), part.column("again").to_numpy(zero_copy_only=False)
            n_units = np.bincount(u.doc[u.words > 0], minlength=part.num_rows)
            some = cuts.is_valid().to_numpy(zero_copy_only=False) | again
            spans: list[list[dict]] = [[] for _ in range(part.num_rows)]
            body = part.column("text")
            if some.any():
                chars = text.characters(data)
                texts = body.to_pylist()
                a, b = u.spans(min_words, runs)
                a, b, h1 = (x[np.argsort(a, kind="stable")] for x in (a, b, u.digest(a, b, 0)))
                first = np.searchsorted(u.doc[a], np.arange(part.num_rows + 1))
                at_, to_, h1 = (u.edges[a] - off[u.doc[a]]).tolist(), b.tolist(), h1.tolist()
                for i in np.flatnonzero(some).tolist():
                    named = {(x["start"], x["h1"]) for x in cuts[i].as_py() or ()}
                    ks = sorted({k for r in range(int(first[i]), int(first[i + 1])) if again[i] or (at_[r], h1[r]) in named for k in range(int(a[r]), to_[r] + 1)})
                    spans[i] = [{"start": int(chars[u.edges[k]] - chars[off[i]]), "end": int(chars[u.edges[k + 1]] - chars[off[i]])} for k in ks]
                    if ks:
                        x, pieces, to = texts[i], [], 0
                        for s in spans[i]:
                            pieces.append(x[to : s["start"]])
                            to = s["end"]
                        texts[i] = "".join([*pieces, x[to:]])
                body = pa.array(texts, pa.string())
            out = [body if i == at else part.column(f"c{i}") for i in range(len(names))]
            out += [pa.array(n_units), pa.array([len(x) for x in spans], pa.int64()), pa.array(spans, spans_type)]
            yield pa.RecordBatch.from_arrays(out, names=schema.names)

    return plain.mapInArrow(run, schema)


def deduplicated(docs: DataFrame, min_words: int = MIN_WORDS, runs: bool = False) -> DataFrame:
    """``docs`` with later occurrences cut out of ``text``; all rows and columns stay.

    Adds n_units (sentences that hold a word), n_removed and removed, an array of (start, end)
    in code points of the text as it was, one for each sentence that goes. Columns of ``docs``
    with these names are replaced; ``without_repeats`` keeps them. ``runs`` is told above.
    """
    added = ["n_units", "n_removed", "removed"]
    docs = docs.drop(*added)
    return _cut(docs, min_words, runs).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)], *added)


def without_repeats(docs: DataFrame, min_words: int = MIN_WORDS, runs: bool = False) -> DataFrame:
    """The same with the columns of ``docs`` alone, whatever their names."""
    return _cut(docs, min_words, runs).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])


def listing(done: DataFrame) -> DataFrame:
    """doc_id, n_units, n_removed, spans (start:end, comma-joined) and the text that stays."""
    spans = F.array_join(F.transform("removed", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return done.select("doc_id", "n_units", "n_removed", spans.alias("spans"), "text")


#: The same in DuckDB SQL, over ``documents``.
ORACLE = f"""
WITH pieces AS (SELECT doc_id, text, regexp_extract_all(coalesce(text, ''), '[^.!?\\n]+[.!?\\n]*|[.!?\\n]+') AS us FROM documents),
one AS (SELECT doc_id, generate_subscripts(us, 1) AS i, unnest(us) AS unit FROM pieces),
placed AS (SELECT *, CAST(coalesce(sum(length(unit)) OVER before, 0) AS BIGINT) AS s, coalesce(sum(CAST(contains(unit, chr(10)) AS INT)) OVER before, 0) AS line,
  list_filter(regexp_split_to_array(translate(unit, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\t-\\r]+'), lambda w: w <> '') AS ws FROM one
  WINDOW before AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
units AS (SELECT doc_id, s, i AS a, i AS b, array_to_string(ws, ' ') AS unit FROM placed WHERE len(ws) >= {MIN_WORDS}
  UNION ALL SELECT doc_id, min(s), min(i), max(i), string_agg(array_to_string(ws, ' '), ' ' ORDER BY i) FILTER (len(ws) > 0) FROM placed GROUP BY doc_id, line HAVING sum(len(ws)) > 0),
ranked AS (SELECT *, min(struct_pack(doc_id := doc_id, s := s)) OVER (PARTITION BY unit) AS first FROM units),
gone AS (SELECT DISTINCT doc_id, unnest(range(a, b + 1)) AS i FROM ranked WHERE doc_id <> first.doc_id OR s <> first.s),
done AS (SELECT doc_id, count(*) FILTER (len(ws) > 0) AS n_units, count(g.i) AS n_removed,
  coalesce(string_agg(s || ':' || (s + length(unit)), ',' ORDER BY p.i) FILTER (g.i IS NOT NULL), '') AS spans,
  coalesce(string_agg(unit, '' ORDER BY p.i) FILTER (g.i IS NULL), '') AS rest FROM placed p LEFT JOIN gone g USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_units, 0) AS n_units, coalesce(n_removed, 0) AS n_removed, coalesce(spans, '') AS spans,
  CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(rest, '') END AS text
FROM documents d LEFT JOIN done USING (doc_id)
"""
