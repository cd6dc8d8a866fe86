"""The registered queries of the subpackage: thin wrappers over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import alignment, fingerprint, mining, minhash, packing, pieces, pitman, quality, rollup, secrets, store, toxicity, units, vectors


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of ``documents``, of their edited texts, and their likeness."""
    return fingerprint.next_pairs(store.table(spark, sf_dir, "documents"))


def op1_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate vectors of ``embeddings`` at cosine 0.9."""
    return vectors.near_duplicates(store.table(spark, sf_dir, "embeddings"))


def op2_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated lines and sentences cut out of ``documents``, with what was cut."""
    return units.listing(units.deduplicated(store.table(spark, sf_dir, "documents")))


def op3_pitman(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of ``documents`` under a model of all rows but the held-out seventh."""
    return pitman.scores(store.table(spark, sf_dir, "documents"), modulus=7, rest=2)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of ``documents``, learned from the labels outside the held-out fifth."""
    docs = store.table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, store.table(spark, sf_dir, "labels"), modulus=5), modulus=5)


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets found in ``documents``: counts, a digest of the base spans, all spans."""
    return secrets.digests(secrets.scan(store.table(spark, sf_dir, "documents")))


def op6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` encoded, decoded and compared."""
    return pieces.round_trips(store.table(spark, sf_dir, "documents"))


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near duplicates of ``documents``: three-word shingles, similarity 0.85."""
    return minhash.near_duplicates(store.table(spark, sf_dir, "documents"), size=3, percent=85)


def op8_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token totals by source, language and tokenizer version after a small history of ``documents``."""
    return rollup.history(store.table(spark, sf_dir, "documents")).totals()


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of ``documents`` packed into sequences of 2,048 tokens."""
    return packing.pack(store.table(spark, sf_dir, "documents"))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of two tokenizers over ``documents``, their groups, links and the links' counts."""
    return alignment.align(store.table(spark, sf_dir, "documents"))


def op12_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of the anchors of ``embeddings`` and their first five positives."""
    return mining.mine(store.table(spark, sf_dir, "embeddings"))


def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of ``documents``, learned from the labels outside the held-out third."""
    docs = store.table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, store.table(spark, sf_dir, "labels")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_codes": op1_codes,
    "op2_units": op2_units,
    "op3_pitman": op3_pitman,
    "op4_toxicity": op4_toxicity,
    "op5_secrets": op5_secrets,
    "op6_pieces": op6_pieces,
    "op7_minhash": op7_minhash,
    "op8_rollup": op8_rollup,
    "op9_packing": op9_packing,
    "op10_fingerprints": op10_fingerprints,
    "op11_alignment": op11_alignment,
    "op12_mining": op12_mining,
    "op13_quality": op13_quality,
}

_LINKS = """WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
ok AS (SELECT * FROM v WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9),
reach(id, r) AS (SELECT vec_id, vec_id FROM v UNION SELECT reach.id, links.b FROM reach JOIN links ON links.a = reach.r),
least AS (SELECT id, min(r) AS component_id FROM reach GROUP BY id)
SELECT vec_id, (SELECT count(*) FROM links WHERE a = vec_id) AS n_links, component_id, vec_id = component_id AS kept FROM v JOIN least ON id = vec_id"""

_NEAR = """WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\t-\\r]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')] ELSE list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) END AS sh FROM w),
n AS (SELECT doc_id, len(sh) AS n FROM s), one AS (SELECT doc_id, unnest(sh) AS g FROM s),
met AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM one a JOIN one b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
half AS (SELECT a, b FROM met JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 85 * (x.n + y.n - i)),
links AS (SELECT a, b FROM half UNION ALL SELECT b, a FROM half),
reach(id, r) AS (SELECT doc_id, doc_id FROM n UNION SELECT reach.id, links.b FROM reach JOIN links ON links.a = reach.r),
least AS (SELECT id, min(r) AS component_id FROM reach GROUP BY id)
SELECT n.doc_id, n.n AS n_shingles, component_id, n.doc_id = component_id AS kept FROM n JOIN least ON id = n.doc_id"""

ORACLE_SQL: dict[str, str] = {
    "op1_codes": _LINKS,
    "op2_units": units.ORACLE,
    "op7_minhash": _NEAR,
    "op8_rollup": rollup.ORACLE,
    "op12_mining": mining.ORACLE,
}
