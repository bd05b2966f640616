"""n-grams of a slice are counted by one sort; words of the head are looked up in the filter once."""

import numpy as np
import pytest

from quillon.llm import lm_score


@pytest.mark.parametrize("n", [0, 1, 2, 1000])
def test_counts_of_a_slice(n):
    keys = np.random.default_rng(n).integers(0, 50, n).astype(np.uint64)
    for got, want in zip(lm_score._counted(keys), lm_score._merge(keys, np.ones(n, np.int64)), strict=True):
        assert got.dtype == want.dtype and (got == want).all()


@pytest.mark.parametrize("head", [0, 3, 1 << 20])
def test_scores_do_not_depend_on_the_head(spark, head):
    docs = spark.createDataFrame([(i, " ".join(f"w{(i * k) % 11}" for k in range(1 + i % 9)) if i else None) for i in range(60)], "doc_id long, text string")
    model = lm_score.train(docs.where("doc_id % 3 > 0"))
    rows = lambda most: sorted((r.row.doc_id, r.n_tokens, r.n_known, round(r.base_score, 9), r.score) for r in lm_score.score(docs, model, ["doc_id"], head=most).collect())
    assert rows(head) == rows(5)
