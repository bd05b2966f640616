"""Posting lists of a block of reviews, made in Arrow: equal to those of the DataFrame plans, whatever slices and blocks are cut."""

import pytest
from pyspark.sql import functions as F

from quillon.plans import blocks
from quillon.plans import index as ix
from quillon.sources.reviews import from_documents

ODD = [None, "", "a", "tea tea 2go", "é caffè2 \n\x00x", "-- ", "ⅷ kK 漢字a1", "the " * 40, "z" * 300, "tea"]


def test_blocks_equal_plans(spark, monkeypatch):
    monkeypatch.setattr(ix, "BLOCK_TOKENS", 64)
    ids = [1, 2, 3, 5, 8, 9, 40, 41, 1000, 100_000]
    reviews = ix.with_length(spark.createDataFrame([(i, "p", 5, 0, 1, t and t.lower()) for i, t in zip(ids, ODD, strict=True)], "review_id long, product_id string, score int, helpful_num int, helpful_den int, text string"))
    n = reviews.agg(F.sum("length")).first()[0]
    for chunk in (1, 2, 1024):
        got = ix.chunks_by_block(reviews, chunk, len(ids), n)
        want = ix.with_skips(ix.chunk_lists(ix.entries_of(reviews), chunk))
        assert got.dtypes == want.dtypes
        assert sorted(got.collect()) == sorted(want.collect())


@pytest.mark.parametrize("size", [1, 700, 1 << 20])
def test_slices_change_nothing(spark, sf_dir, monkeypatch, size):
    table = from_documents(spark, sf_dir).select("review_id", "text").toArrow()
    plain = blocks.postings(table).ordered()
    monkeypatch.setattr(blocks, "SLICE", size)
    cut = blocks.postings(table).ordered()
    assert cut.terms.equals(plain.terms)
    for a, b in zip((cut.ids, cut.lengths, cut.term, cut.review, cut.tf), (plain.ids, plain.lengths, plain.term, plain.review, plain.tf), strict=True):
        assert (a == b).all()


def test_lists_are_not_collected_or_shuffled(spark, sf_dir):
    reviews = ix.with_length(from_documents(spark, sf_dir))
    plan = ix.chunks_by_block(reviews, 32, 200, 80_000)._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "ObjectHashAggregate" not in plan and "SortMergeJoin" not in plan


def test_stored_lexicon_is_numbered_in_order(spark, tmp_path):
    reviews = spark.createDataFrame([(i, "p", 5, 0, 1, f"w{i * 37 % 500} w{i % 7}") for i in range(1, 501)], "review_id long, product_id string, score int, helpful_num int, helpful_den int, text string")
    stored = ix.write(reviews, str(tmp_path / "x"), chunk=8)
    assert sorted(stored.lexicon.collect()) == sorted(ix.build(reviews).lexicon.collect())
    assert not list(tmp_path.glob("x/data-*/terms"))
