import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillon.functions.codec import common_prefix, front_decode, front_encode, gamma_decode, gamma_encode
from quillon.functions.ordinals import ranged, with_ordinal
from quillon.operators import gaps as G
from quillon.plans.index import chunk_lists, with_skips
from quillon.sources.reviews import from_conversations
from pyspark.sql.window import Window

QUICK = settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def test_gamma_codes(spark):
    rows = spark.createDataFrame([(n,) for n in (0, 1, 2, 5, 13)], "n long").select("n", gamma_encode(F.col("n")).alias("c")).collect()
    assert {r.n: r.c for r in rows} == {0: None, 1: "0", 2: "100", 5: "11001", 13: "1110101"}


@QUICK
@given(st.lists(st.integers(1, 1 << 62), min_size=1, max_size=200))
def test_gamma_round_trip(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "n long")
    assert df.where(gamma_decode(gamma_encode(F.col("n"))) != F.col("n")).count() == 0


def test_common_prefix(spark):
    pairs = [("abc", "abd", 2), ("", "a", 0), ("a", "a", 1), (None, "a", 0), ("ab", "abab", 2), ("x", "y", 0)]
    rows = spark.createDataFrame(pairs, "a string, b string, n int").select("n", common_prefix(F.col("a"), F.col("b")).alias("m")).collect()
    assert all(r.n == r.m for r in rows)


def test_front_coding_round_trip(spark):
    r = random.Random(3)
    words = sorted({"".join(r.choice("abc") for _ in range(r.randint(1, 9))) for _ in range(500)})
    df = with_ordinal(spark.createDataFrame([(w,) for w in words], "term string"), "term", "id", split=3)
    df = df.withColumn("block", F.floor(F.col("id") / 6)).withColumn("before", F.lag("term").over(Window.partitionBy("block").orderBy("id")))
    prefix, rest = front_encode(F.col("id"), F.col("term"), F.col("before"), 6)
    coded = df.select("block", "id", prefix.alias("prefix"), rest.alias("rest")).groupBy("block").agg(F.array_sort(F.collect_list(F.struct("id", "prefix", "rest"))).alias("c"))
    back = [w for row in coded.orderBy("block").select(front_decode(F.col("c")).alias("w")).collect() for w in row.w]
    assert back == words


def test_gaps_and_back_with_small_chunks(spark):
    r = random.Random(5)
    rows = [(t, i) for t in "ab" for i in sorted(r.sample(range(1, 1000), 200))]
    entries = spark.createDataFrame([(t, i, 1, 9) for t, i in rows], "term string, review_id long, tf long, length int")
    chunks = with_skips(chunk_lists(entries, 16))
    gapped = G.gaps(chunks)
    last = {}
    expected = set()
    for t, i in rows:
        expected.add((t, i, i - last.get(t, 0)))
        last[t] = i
    assert {tuple(x) for x in gapped.collect()} == expected
    back = G.ids(G.gap_lists(chunks))
    assert sorted((x.term, x.seq, x.review_id) for x in back.collect()) == sorted((t, k, i) for t in "ab" for k, i in enumerate(i for u, i in rows if u == t))


@pytest.mark.parametrize("split, bound", [(2, 8), (4, 64)])
def test_ordinal_ranges_follow_the_data(spark, split, bound):
    """Keys with one long beginning: however many there are, ranges keep their size, and so do the rows that one key of the join meets."""
    r = random.Random(7)
    words = sorted({"one beginning of all " * 3 + str(r.random())[2 : 2 + r.randint(1, 9)] for _ in range(4000)})
    largest = {}
    for n in (len(words) // 8, len(words)):
        df = spark.createDataFrame([(w, i) for i, w in enumerate(words[:n])], "term string, i long").repartition(3)
        numbered = with_ordinal(df, "term", "id", split, bound).collect()
        assert len(numbered) == n and all(x.id == x.i for x in numbered)
        sizes = [x["count"] for x in ranged(df, "term", split, bound).groupBy("_top", "_low").count().collect()]
        largest[n] = max(sizes)
        assert len(sizes) > n / bound / 2 and largest[n] <= bound * 8, (len(sizes), largest)


def test_ordinals_of_few_and_of_structs(spark):
    df = spark.createDataFrame([("b",), ("a",)], "t string")
    assert with_ordinal(df.limit(0), "t", "id").collect() == []
    assert sorted(map(tuple, with_ordinal(df, "t", "id").collect())) == [("a", 0), ("b", 1)]
    pairs = [(a, b) for a in (None, -1, 10**15) for b in range(20)]
    keyed = spark.createDataFrame(pairs, "a long, b long").select("a", "b", F.struct("a", "b").alias("k"))
    assert [(x.a, x.b) for x in sorted(with_ordinal(keyed, "k", "id", 2, 4).collect(), key=lambda x: x.id)] == pairs


def test_turns_of_sparse_conversations(spark, tmp_path):
    """Ids far apart, a turn without an id, and a repeated turn."""
    turns = [(c, t, "user", f"T {c} {t}") for c in (-7, 5, 10**12, 10**15) for t in (2, 0, 1)] + [(5, 1, "user", "again"), (None, 0, "user", None)]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").repartition(3).write.parquet(str(tmp_path / "conversations.parquet"))
    got = sorted(from_conversations(spark, str(tmp_path)).select("review_id", "product_id", "text").collect())
    order = sorted(turns, key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    assert [x.review_id for x in got] == list(range(1, len(turns) + 1))
    assert [x.product_id for x in got] == [None if x[0] is None else str(x[0]) for x in order]
    assert sorted(str(x.text) for x in got) == sorted("None" if x[3] is None else x[3].lower() for x in turns)
