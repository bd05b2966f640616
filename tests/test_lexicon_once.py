"""Queries on terms cut the texts into tokens once, not once for each use of an ordinal's keys."""

import pytest

from quillon import catalogue


@pytest.mark.parametrize(("name", "most"), [("token_frequency", 1), ("token_collection_frequency", 1), ("corpus_stats", 1), ("lexicon", 0), ("front_coding", 0), ("lexicon_blocks", 0)])
def test_texts_are_cut_once(spark, sf_dir, name, most):
    plan = catalogue.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Generate inline") == most
    assert most or "regexp_extract_all" not in plan
