"""Keys that very many rows have: equal rows in mixing, windows in decontamination."""

import re

from pyspark.sql import functions as F

from quillon.llm import decontaminate as D
from quillon.llm import mixing as M


def test_equal_rows_are_numbered_in_several_tasks(spark):
    rows = spark.range(0, 60_000, 1, 12).select(F.lit(7).alias("doc_id"), F.lit("a").alias("source"), F.lit("three words here").alias("text"))
    others = spark.range(100, 400).select(F.col("id").cast("int").alias("doc_id"), F.lit("b").alias("source"), F.concat(F.lit("w "), "id").alias("text"))
    out = M.numbered(M.sized(rows.unionByName(others)))
    equal = out.where("id = 7")
    assert equal.agg(F.min("copy"), F.max("copy"), F.count_distinct("copy"), F.count("*")).first()[:] == (0, 59_999, 60_000, 60_000)
    assert out.where("id >= 100 and copy = 0").count() == 300
    assert not re.search(r"Window \[row_number\(\)[^\n]*\[key#\d+, id#\d+, hash#\w+\], ", out._jdf.queryExecution().optimizedPlan().toString())
    mixed = M.mix(M.sized(rows.unionByName(others))).apply(M.sized(rows.unionByName(others)))
    assert mixed.where("taken > 2 * size").count() == 0 and mixed.count() == 60_300


def test_null_ids_and_rows_beside_are_numbered(spark):
    rows = [(None, "a", "x y", i % 3) for i in range(40)] + [(1, "a", "x y", 0), (1, "a", "x y", 1), (1, None, "x y", 1)]
    df = spark.createDataFrame(rows, "doc_id int, source string, text string, extra int").repartition(5)
    out = M.numbered(M.sized(df, keep=["doc_id", "extra"])).collect()
    assert sorted(r.copy for r in out if r.id is None) == list(range(40)) and sorted((r.key, r.copy) for r in out if r.id == 1) == [("=a", 0), ("=a", 1), ("null", 0)]
    first = [r.row.extra for r in sorted((r for r in out if r.id is None), key=lambda r: r.copy)]
    assert sum(a != b for a, b in zip(first, first[1:], strict=False)) == 2  # rows that differ elsewhere keep one order


def test_frequent_windows_do_not_multiply_places(spark):
    """400 items of one word that stands 50 times in each of 40 texts: a row a text and item, not a place and item."""
    docs = spark.createDataFrame([(i, f"own{i} " + "the cat sat " * 50) for i in range(40)] + [(99, "none of it")], "doc_id long, text string")
    bench = spark.createDataFrame([(f"i{k:03}", "The") for k in range(400)] + [("long", "the cat sat the cat sat the cat sat the")], "item_id string, text string")
    got = {r.row.doc_id: r.found for r in D.decontaminate(docs, bench, block_bytes=0).collect()}
    held = {r.row.doc_id: r.found for r in D.decontaminate(docs, bench).collect()}
    assert got == held and got[99].n_hit == 0 and len(got[3]["items"]) == 401 and got[3].n_hit == 148  # the last two words are in no window of ten


def test_keys_are_cut_by_the_segments_that_occur():
    import time

    import numpy as np

    from quillon.llm import lm_score as LM

    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 63, 30_000).astype(np.uint64) << np.uint64(1))
    took = {}
    for segments in (1, 16, 1 << 10, 1 << 20, 1 << 23):
        began = time.perf_counter()
        some, parts = LM.by_segment(keys, segments)
        took[segments] = time.perf_counter() - began
        assert (np.concatenate(parts) == keys).all() and len(some) == len(parts)
        assert all((LM.segment_of(p, segments) == s).all() and len(p) for s, p in list(zip(some, parts, strict=True))[:200])
    assert took[1 << 23] < 0.25
    assert [len(x) for x in LM.by_segment(keys[:0], 1 << 20)] == [0, 0]
