"""What the write of an index moves and writes: texts once, no row for a term that is new in a block, and of short chunks each value once."""

import glob

import pytest
from pyspark.sql import functions as F

from quillon.operators import lookup
from quillon.plans import index as ix
from quillon.sources.reviews import Joined, documents, from_documents

ROWS = [(i * i, f"p{i % 3}", 5, 1, 2, None if i == 9 else "the of worthless " * (i % 5) + f"w{i % 7} x{i}") for i in range(1, 200)]
REVIEWS = "review_id long, product_id string, score int, helpful_num int, helpful_den int, text string"


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path, plans = str(tmp_path_factory.mktemp("buckets") / "ix"), []
    real = ix.chunks_of_blocks

    def seen(*args):
        out = real(*args)
        plans.append(out._jdf.queryExecution().executedPlan().toString())
        return out

    reviews = spark.createDataFrame(ROWS, REVIEWS)
    with pytest.MonkeyPatch.context() as m:
        m.setattr(ix, "chunks_of_blocks", seen)
        return ix.write(reviews, path, 32), ix.build(reviews, 32), path, plans[0]


def test_texts_stay_in_their_buckets(stored):
    """Exchanges are those of short rows alone, by term and back to the block."""
    plan = stored[3]
    assert plan.count("Bucketed: true") == 2
    assert plan.count("Exchange hashpartitioning(term") == 1 and plan.count("Exchange") == 2


def test_stored_tables_are_what_is_built(spark, stored):
    index, lazy = stored[:2]
    for name in ix.STORED:
        got, want = getattr(index, name), getattr(lazy, name)
        assert got.dtypes == want.dtypes and sorted(map(str, got.collect())) == sorted(map(str, want.collect())), name
    assert [r.review_id for r in lookup.review(index, 49).collect()] == [49] and lookup.review(index, 50).collect() == []
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("quillon_reviews_")]


def test_a_chunk_of_one_posting_says_things_once(spark, stored):
    rows = spark.read.parquet(*glob.glob(f"{stored[2]}/data-*/chunks"))
    short = ("last_id", "cf", "max_ratio", "ids", "tfs", "lengths")
    said = lambda one: rows.where((F.col("n") == 1) == one).agg(F.count("*"), *[F.count(c) for c in short]).first()
    alone, others = said(True), said(False)
    assert alone[0] > 0 and set(alone[1:]) == {0} and len(set(others)) == 1 and others[0] > 0


def test_bloom_filters_are_as_large_as_their_keys(stored):
    sizes = [len(open(f, "rb").read()) for f in glob.glob(f"{stored[2]}/data-*/*/*.parquet")]
    assert max(sizes) < 1 << 18


def test_a_failed_write_leaves_no_name(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ix, "chunks_of_blocks", lambda *_: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        ix.write(spark.createDataFrame(ROWS[:9], REVIEWS), str(tmp_path / "x"), 32)
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("quillon_reviews_")] and not list(tmp_path.glob("x/data-*"))


def test_texts_are_counted_before_labels_join(spark, sf_dir, tmp_path, monkeypatch):
    """A join with more labels than are broadcast moves the texts: it's made once."""
    steps, join, sizes = [], Joined.reviews, ix.blocks_for
    monkeypatch.setattr(Joined, "reviews", lambda self: steps.append("join") or join(self))
    monkeypatch.setattr(ix, "blocks_for", lambda *args: steps.append("sizes") or sizes(*args))
    made = documents(spark, sf_dir)
    assert "Join" not in made.texts._jdf.queryExecution().executedPlan().toString()
    index = ix.write(made, str(tmp_path / "x"), 32)
    assert steps == ["sizes", "join"]
    assert sorted(index.reviews.collect()) == sorted(ix.with_length(from_documents(spark, sf_dir)).collect())
