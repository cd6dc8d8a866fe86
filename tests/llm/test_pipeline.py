"""The pipeline's stages by brute force on one small corpus."""

import os

import corpus_pipeline
import pyarrow as pa
import pyarrow.parquet as pq
from emberlog.llm import queries
from pyspark.sql import functions as F
from tests.llm.test_operators import shingles, toxic_rows


def test_stages(spark, tmp_path):
    rows, labels = toxic_rows()
    secret = "key material token=abcdefghijklmnop0123 stays hidden here."
    passage = "Every reader of this text knows the same ten words by heart."
    rows += [(500, rows[1][1]), (501, f"{passage} {secret}"), (502, f"First some words of my own choice. {passage} And then some more of them."), (503, None), (None, "odd one out"), (504, "")]
    cols = {"doc_id": pa.array([k for k, _ in rows], pa.int64()), "text": [x for _, x in rows], "lang": ["en"] * len(rows), "source": ["s"] * len(rows), "n_chars": pa.array([len(x or "") for _, x in rows], pa.int64())}
    pq.write_table(pa.table(cols), tmp_path / "documents.parquet")
    pq.write_table(pa.table({"doc_id": pa.array([r[0] for r in labels], pa.int64()), "quality": pa.array([r[1] for r in labels], pa.int32()), "toxic": pa.array([r[2] for r in labels], pa.int32())}), tmp_path / "labels.parquet")
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        path = os.path.join(tmp_path, f"out-{name}")
        out.write.parquet(path)
        new = spark.read.parquet(path)
        if name != "packing":
            assert new.columns == docs.columns
            assert new.where(F.col("n_chars") != F.length(F.coalesce("text", F.lit("")))).count() == 0
        docs = seen[name] = new
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "minhash", "units", "secrets", "packing"]
    kept = {r.doc_id: r.text for r in seen["toxicity"].collect()}
    bad = {k for k, _, y in labels if y}
    assert len(bad & set(kept)) < 0.1 * len(bad) and len([k for k, _, y in labels if not y and k not in kept]) < 10
    left = {r.doc_id: r.text for r in seen["minhash"].collect()}
    assert 500 not in left and set(left) <= set(kept) and {503, 504, None} <= set(left)
    sets = [(k, shingles(x, 5)) for k, x in left.items() if x and k is not None]
    assert not any(100 * len(a & b) >= 80 * len(a | b) for i, (_, a) in enumerate(sets) for _, b in sets[:i])
    cut = {r.doc_id: r.text for r in seen["units"].collect()}
    assert passage in cut[501] and passage not in cut[502] and "First some words" in cut[502] and set(cut) == set(left)
    clean = {r.doc_id: r.text for r in seen["secrets"].collect()}
    assert "abcdefghijklmnop0123" not in clean[501] and "[assign]" in clean[501] and set(clean) == set(cut)
    packed = seen["packing"].groupBy("doc_id").agg(F.sum("length").alias("n"), F.first("doc_tokens").alias("all")).collect()
    assert {r.doc_id for r in packed} == set(clean) and all(r.n == r.all for r in packed)


def test_run_equals_its_stages(spark, tmp_path):
    test_stages(spark, tmp_path)
    a = corpus_pipeline.run(spark, str(tmp_path)).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    b = spark.read.parquet(str(tmp_path / "out-packing")).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    assert sorted(map(tuple, a), key=repr) == sorted(map(tuple, b), key=repr)


def test_odd_rows_go_through_all_stages(spark, tmp_path):
    line = "These are nine words that stand in two texts.\n"
    rows = [(1, line + "Own words of one."), (1, line + "Own words of one."), (None, line + "Own words of nobody else here."), (None, line + "Own words of nobody else here."), (2, None), (2, None), (None, None), (3, ""), (4, "word " * 40_000), (5, "ok"), (6, "ok too")]
    docs = spark.createDataFrame([(k, x, "en", "s", len(x or ""), "mine", 7, "again") for k, x in rows], "doc_id long, text string, lang string, source string, n_chars long, removed string, n_units int, cut string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for empty in (False, True):
        home = tmp_path / str(empty)
        (docs.where("false") if empty else docs).write.parquet(f"{home}/documents.parquet")
        labels.write.parquet(f"{home}/labels.parquet")
        now = spark.read.parquet(f"{home}/documents.parquet")
        for name, stage in corpus_pipeline.STAGES[1:]:  # without labels the classifier rejects nothing or all
            stage(spark, now, str(home)).write.parquet(f"{home}/{name}")
            now = spark.read.parquet(f"{home}/{name}")
            if name == "units":
                got = [(r.doc_id, r.text, r.removed, r.n_units, r.cut) for r in now.collect()]
        want = [] if empty else [(1, rows[0][1]), (None, "Own words of nobody else here."), (2, None), (None, None), (3, ""), (4, rows[8][1]), (5, "ok"), (6, "ok too")]
        assert sorted(got, key=repr) == sorted(((*w, "mine", 7, "again") for w in want), key=repr)
        assert now.select("doc_id").distinct().count() == (0 if empty else 7)


def test_every_operator_has_a_query():
    names = list(queries.QUERIES)
    assert [int(n[2:].split("_")[0]) for n in names] == list(range(1, 11))
    assert set(queries.ORACLE_SQL) <= set(names)
