"""The inverted index against looking at every text."""

import random

import pytest
from pyspark.sql import functions as F

from emberlog.functions import strings
from emberlog.operators import postings
from emberlog.operators.filters import QueryFilter

TEXTS = ["Out of Stock É", "out OF stock é", "😀😀😀 ok", None, "", "ab", "a\nb\r\nc", "x" * 50, "ÀÉ straße K", "tail"]


@pytest.fixture(scope="module")
def rows(spark):
    r = random.Random(1)
    words = ["alpha", "Beta", "gamma", "delta", "Étage", "日本語", "stock"]
    texts = [(i, TEXTS[i] if i < len(TEXTS) else " ".join(r.choice(words) for _ in range(r.randrange(1, 6)))) for i in range(900)] + [(900, "the needle in the hay"), (901, None)]
    return spark.createDataFrame(texts, "id long, raw string").coalesce(3).sortWithinPartitions("id")


@pytest.fixture(scope="module")
def stored(spark, rows, tmp_path_factory):
    """Blocks of eight rows, written and read again."""
    shift, postings.SHIFT = postings.SHIFT, 3
    at = str(tmp_path_factory.mktemp("postings"))
    postings.numbered(rows).write.parquet(f"{at}/rows")
    kept = spark.read.parquet(f"{at}/rows")
    postings.write(postings.build(kept), f"{at}/grams")
    postings.SHIFT = shift
    return kept, spark.read.parquet(f"{at}/grams")


def test_every_text_is_found_by_its_trigrams(stored):
    kept, grams = stored
    have = {}
    for r in grams.collect():
        have.setdefault(r.block, set()).add(r.gram)
    for r in kept.collect():
        assert set(postings.codes(r.raw or "")) <= have.get(r.block, set())


def test_codes_fold_ascii_letters_only():
    assert postings.codes("ABC") == postings.codes("abc") and postings.codes("ÉÉÉ") != postings.codes("ééé")
    assert len(postings.codes("abab")) == 2 and postings.codes("ab") == [] and len(postings.codes("😀😀😀")) == 1


@pytest.mark.parametrize("text", ["needle in", "STOCK", "É", "Ét", "étage", "Étage", "日本語", "of s", "not there", "zzz", "ab", "x", "\r\nc", "😀😀😀", "xxxxxxxx", "K", ""])
def test_a_search_with_the_index_finds_the_same(spark, stored, text):
    kept, grams = stored
    files = spark.createDataFrame([(1, "a")], "file_id long, path string")
    for grep in (text, strings.quoted(text)):
        q = QueryFilter(grep=grep)
        assert sorted(r.id for r in q.apply(kept, files, grams).collect()) == sorted(r.id for r in q.apply(kept, files).collect())


def test_a_rare_text_leaves_one_block(stored):
    kept, grams = stored
    assert postings.narrowed(kept, grams, "needle").count() <= 16
    assert postings.candidates(grams, "no such thing") == [] and postings.narrowed(kept, grams, "no such thing").count() == 0
    assert postings.candidates(grams, "ab") is None


def test_too_many_blocks_are_not_sieved(stored):
    kept, grams = stored
    assert postings.candidates(grams, "stock", most=3) is None
    assert len(postings.candidates(grams, "stock")) > 3


def test_ranges_hold_all_blocks(spark):
    r = random.Random(2)
    blocks = sorted(r.sample(range(10_000), 700))
    df = spark.range(10_000).withColumnRenamed("id", postings.BLOCK)
    kept = {x.block for x in df.where(postings.condition(blocks)).collect()}
    assert set(blocks) <= kept and len(kept) < 10_000
    assert {x.block for x in df.where(postings.condition(blocks[:50])).collect()} == set(blocks[:50])
    assert df.where(postings.condition([])).count() == 0


def test_the_condition_reaches_the_scan(stored):
    kept, grams = stored
    plan = postings.narrowed(kept, grams, "needle").where(F.col("raw").contains("needle"))._jdf.queryExecution().toString()
    assert "PushedFilters" in plan and "EqualTo(block" in plan


def test_an_empty_table(spark, rows, tmp_path):
    grams = postings.build(postings.numbered(rows.where("false")))
    assert grams.count() == 0 and postings.candidates(grams, "text") == []
