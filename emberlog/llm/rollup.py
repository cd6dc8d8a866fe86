"""Token counts in totals that signed deltas maintain.

A delta row is (source, lang, tokenizer_version, docs, tokens) with docs and tokens signed:
an insert adds, a delete subtracts, a revision does both. A batch of deltas is aggregated
and committed under its id; to commit an id again changes nothing, so a batch that was
sent twice, or whose executors were lost half-way, counts once. Totals are the sum of all
commits; ``compact`` folds them into a snapshot, which counts as a whole or not at all.

Null text has no tokens; null sources and languages are groups of their own. Groups whose
documents and tokens are all gone leave the totals. Repeated rows count each time, ties do
not matter. Extra columns are ignored. An empty batch commits its id and changes no total;
without any commit there are no totals.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import store

GROUP = ["source", "lang", "tokenizer_version"]
#: Patterns whose matches are tokens, by tokenizer version.
VERSIONS: Mapping[str, str] = {
    "words-1": r"[^ \t-\r]+",
    "parts-2": r"\p{L}+|\p{N}|[^ \t-\r\p{L}\p{N}]+",
}


def tokens(column: str, pattern: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(column), F.lit(pattern)), F.lit(0)).cast("long")


def deltas(rows: DataFrame, sign: int = 1, column: str = "text", versions: Mapping[str, str] = VERSIONS) -> DataFrame:
    """Signed rows for documents that come (sign 1) or go (sign -1), for every version."""
    each = F.explode(F.array(*[F.struct(F.lit(v).alias("tokenizer_version"), tokens(column, p).alias("tokens")) for v, p in versions.items()]))
    return rows.select("source", "lang", each.alias("t")).select("source", "lang", F.col("t.tokenizer_version"), F.lit(sign).cast("long").alias("docs"), (sign * F.col("t.tokens")).alias("tokens"))


def revisions(rows: DataFrame, old: str, new: str, versions: Mapping[str, str] = VERSIONS) -> DataFrame:
    """One signed row for each version and document whose text changes from ``old`` to ``new``."""
    each = F.explode(F.array(*[F.struct(F.lit(v).alias("tokenizer_version"), (tokens(new, p) - tokens(old, p)).alias("tokens")) for v, p in versions.items()]))
    return rows.select("source", "lang", each.alias("t")).select("source", "lang", F.col("t.tokenizer_version"), F.lit(0).cast("long").alias("docs"), F.col("t.tokens"))


class Rollup:
    """Totals in a folder that all machines share.

    A commit is a folder ``batch-<id>``, written in full or not at all (it counts from its
    ``_SUCCESS`` file on). A snapshot is a folder ``snapshot-<number>`` with the sums, the ids
    of the batches in them and, last of all, a file ``done``. The snapshot of the greatest number
    that is done counts, with the batches that it does not name; all else is left over from
    before or from a run that failed, and ``compact`` clears it away. One writer at a time.
    """

    SCHEMA = "source string, lang string, tokenizer_version string, docs long, tokens long"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), self.spark._jvm.org.apache.hadoop.fs.Path

    def _listed(self) -> tuple[str | None, list[str], list[str]]:
        """The snapshot that counts, complete batches, and the names of all folders."""
        fs, path = self._fs()
        if not fs.exists(path(self.path)):
            return None, [], []
        names = sorted(s.getPath().getName() for s in fs.listStatus(path(self.path)))
        done = [n for n in names if n.startswith("snapshot-") and fs.exists(path(f"{self.path}/{n}/done"))]
        return max(done, default=None), [n for n in names if n.startswith("batch-") and fs.exists(path(f"{self.path}/{n}/_SUCCESS"))], names

    def _state(self) -> tuple[str | None, set[str], list[str]]:
        """The snapshot that counts, the ids in it, and the batches beside it."""
        snapshot, batches, _ = self._listed()
        ids = {r.id for r in self.spark.read.schema("id string").parquet(f"{self.path}/{snapshot}/ids").collect()} if snapshot else set()
        return snapshot, ids, [n for n in batches if n.removeprefix("batch-") not in ids]

    def committed(self) -> set[str]:
        """Ids of the batches that count."""
        _, ids, batches = self._state()
        return ids | {n.removeprefix("batch-") for n in batches}

    def commit(self, batch_id: int | str, rows: DataFrame) -> bool:
        """Add a batch; False, and nothing else, if its id is committed already."""
        name = str(batch_id)
        if not name.replace("_", "").isalnum() or len(name) > 128:
            raise ValueError("a batch id holds up to 128 letters, digits and underscores")
        if name in self.committed():
            return False
        sums = rows.groupBy(*GROUP).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        sums.write.mode("overwrite").parquet(f"{self.path}/batch-{name}")
        return True

    def _sums(self, snapshot: str | None, batches: list[str]) -> DataFrame:
        folders = [f"{self.path}/{snapshot}/sums"] * bool(snapshot) + [f"{self.path}/{n}" for n in batches]
        if not folders:
            return self.spark.createDataFrame([], self.SCHEMA)
        return self.spark.read.schema(self.SCHEMA).parquet(*folders).groupBy(*GROUP).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))

    def totals(self) -> DataFrame:
        """source, lang, tokenizer_version, n_docs, n_tokens."""
        snapshot, _, batches = self._state()
        return self._sums(snapshot, batches).where("docs <> 0 or tokens <> 0").withColumnsRenamed({"docs": "n_docs", "tokens": "n_tokens"})

    def compact(self) -> None:
        """Fold all commits into one snapshot that names their ids."""
        fs, path = self._fs()
        snapshot, ids, batches = self._state()
        if batches:
            name = f"snapshot-{int((snapshot or 'snapshot-0').removeprefix('snapshot-')) + 1:012}"
            self._sums(snapshot, batches).write.mode("overwrite").parquet(f"{self.path}/{name}/sums")
            named = sorted(ids | {n.removeprefix("batch-") for n in batches})
            self.spark.createDataFrame([(i,) for i in named], "id string").write.mode("overwrite").parquet(f"{self.path}/{name}/ids")
            fs.create(path(f"{self.path}/{name}/done")).close()  # from here on it counts
        self._clear()

    def _clear(self) -> None:
        """Remove what does not count; to stop half-way does no harm."""
        fs, path = self._fs()
        snapshot, _, batches = self._state()
        for n in self._listed()[2]:
            if n != snapshot and n not in batches:
                fs.delete(path(f"{self.path}/{n}"), True)


def history(docs: DataFrame, path: str | None = None) -> Rollup:
    """A corpus's life in three commits: all documents come; those of fewer than five words
    go; all is folded into a snapshot; the others lose their last line. The first two batches
    are sent once more, one after the snapshot and one at the end."""
    spark = docs.sparkSession
    roll = Rollup(spark, path or store.scratch(spark))
    d = docs.select("source", "lang", F.col("text").cast("string").alias("text"))
    short = tokens("text", VERSIONS["words-1"]) < 5
    roll.commit(1, deltas(d))
    roll.commit(2, deltas(d.where(short), -1))
    roll.compact()
    roll.commit(1, deltas(d))
    roll.commit(3, revisions(d.where(~short).withColumn("new", F.regexp_replace("text", r"\n[^\n]*\z", "")), "text", "new"))
    roll.commit(2, deltas(d.where(short), -1))
    return roll


#: ``history`` in DuckDB SQL.
ORACLE = r"""
WITH rows AS (SELECT source, lang, text, coalesce(len(regexp_extract_all(text, '[^ \t-\r]+')), 0) AS w FROM documents),
live AS (SELECT source, lang, regexp_replace(text, '\n[^\n]*$', '') AS text FROM rows WHERE w >= 5),
counted AS (
  SELECT source, lang, 'words-1' AS tokenizer_version, len(regexp_extract_all(text, '[^ \t-\r]+')) AS n FROM live
  UNION ALL SELECT source, lang, 'parts-2', len(regexp_extract_all(text, '\p{L}+|\p{N}|[^ \t-\r\p{L}\p{N}]+')) FROM live)
SELECT source, lang, tokenizer_version, count(*) AS n_docs, CAST(sum(coalesce(n, 0)) AS BIGINT) AS n_tokens FROM counted GROUP BY ALL
"""
