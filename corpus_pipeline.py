"""The corpus pipeline: stages over ``documents``, each written as Parquet and read again.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a
DataFrame that becomes the next one's ``docs``. Every stage works on all rows its
predecessor kept, and all but the last return the columns of ``documents``. ``n_chars`` is
kept equal to the text's length where a stage changes texts (null text: 0).

Rows with a null doc_id or text pass like others: an empty text is not toxic, has no
duplicates and no secrets, and packs as one end token. Rows of one doc_id are one document
to the near-duplicate stage, which keeps one of equal rows. Of near duplicates the least
doc_id stays, so ties cannot arise between ids; texts of any length are read whole. Columns
beside those of ``documents``, whatever their names, come through all stages but the last.
An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.llm import minhash, packing, secrets, store, toxicity, units

#: Words in a shingle and percent of similarity of the near-duplicate stage.
SHINGLE, PERCENT = 5, 80


def _measured(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier finds toxic go; it learns from the labelled ones."""
    return toxicity.reject(docs, toxicity.fit(docs, store.table(spark, sf_dir, "labels")))


def near_duplicates_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the one with the least doc_id stays, one row of equal ones."""
    return minhash.representatives(docs, SHINGLE, PERCENT)


def repeats_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines and runs of sentences that stand earlier are cut out, short sentences with them."""
    return _measured(units.without_repeats(docs, runs=True))


def secrets_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets give way to their kinds in brackets."""
    return _measured(secrets.redact(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the packed sequences."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", toxic_out),
    ("minhash", near_duplicates_out),
    ("units", repeats_out),
    ("secrets", secrets_out),
    ("packing", packed),
]

#: The stages are no SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents``; a stage's copy goes when the next one is written."""
    docs, old = store.table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        docs, path = store.save(stage(spark, docs, sf_dir))
        if old:
            store.drop(spark, old)
        old = path
    return STAGES[-1][1](spark, docs, sf_dir)
