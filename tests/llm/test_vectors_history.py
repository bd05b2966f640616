"""Hard negatives (11), exact top-k search (12) and dimension history (13) against brute force and the SQL."""

import math
import os
import random
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm import hard_negatives as H
from quillon.llm import history as V
from quillon.llm import queries as Q
from quillon.llm import topk_search as K
from quillon.llm import vectors as X

SCHEMA = T.StructType(
    [T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType())] + [T.StructField(n, T.StringType()) for n in ("id", "v", "score", "rank", "block", "ids", "VEC_ID")]
)


def table(spark, rows):
    return spark.createDataFrame([(*r, *["x"] * 7) for r in rows], SCHEMA)


def made(n, dim, seed, labels=3):
    """Random vectors, a hot one, ties, and broken rows."""
    rng = random.Random(seed)
    hot = [rng.uniform(-0.4, 0.4) for _ in range(dim)]
    rows = [(i, list(hot) if rng.random() < 0.33 else [rng.gauss(0, 0.12) for _ in range(dim)], rng.randrange(labels)) for i in range(n)]
    rows += [(n + 1, None, 1), (n + 2, [None] * dim, 1), (n + 3, [float("nan")] * dim, 2), (n + 4, [float("inf")] + [0.0] * (dim - 1), 2), (None, hot, 1), (n + 6, [], 0), (n + 7, hot[: dim // 2], 2), (n + 8, [3.5] * dim, None), rows[0], rows[0]]
    return [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], label) for i, v, label in rows]


def usable(rows, with_label):
    seen = {}
    for i, v, label in rows:
        if i is None or v is None or any(x is None or not math.isfinite(x) for x in v) or (with_label and label is None):
            continue
        seen[i] = ([math.floor(256 * x) for x in v], label)
    return seen


def product(a, b):
    return sum(x * y for x, y in zip(a, b, strict=False))


def best(scored, k):
    return sorted(scored, key=lambda s: (-s[1], s[0]))[:k]


def brute_top_k(rows, every, k):
    held = usable(rows, False)
    return sorted((q, r + 1, i, s) for q in held if q % every == 0 for r, (i, s) in enumerate(best(((i, product(held[q][0], v)) for i, (v, _) in held.items() if i != q), k)))


def brute_negatives(rows, every, k=5):
    held, out = usable(rows, True), []
    for a in (i for i in held if i % every == 0):
        scores = [(i, product(held[a][0], v), label == held[a][1]) for i, (v, label) in held.items() if i != a]
        for p, ps in best(((i, s) for i, s, same in scores if same), k):
            out += [(a, p, r + 1, i, ps, s) for r, (i, s) in enumerate(best(((i, s) for i, s, same in scores if not same and 80 * ps <= 100 * s <= 100 * ps), k))]
    return sorted(out)


@pytest.mark.parametrize(("n", "dim", "members", "asked"), [(300, 7, 64, 16), (150, 70, 1000, 1000), (4, 3, 2, 1)])
def test_search_and_negatives_equal_brute_force(spark, n, dim, members, asked):
    rows = made(n, dim, n)
    df = table(spark, rows).repartition(5)
    found = K.top_k(df, F.col("id") % 3 == 0, 5, members=members, asked=asked)
    assert sorted(tuple(r) for r in found.select("query_id", "rank", "id", "score").collect()) == brute_top_k(rows, 3, 5)
    hard = H.hard_negatives(df, F.col("id") % 4 == 0, members=members, asked=asked)
    assert sorted(tuple(r)[1:] for r in hard.select("anchor_row", "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()) == brute_negatives(rows, 4)


def test_empty_tables(spark):
    df = table(spark, [])
    assert K.top_k(df, F.lit(True)).collect() == [] and H.hard_negatives(df, F.lit(True)).collect() == []
    one = table(spark, made(20, 4, 1))
    assert K.top_k(one, F.lit(False)).collect() == [] and H.hard_negatives(one, F.lit(False)).collect() == []


def test_repeated_ids_are_rows_of_their_own(spark):
    rows = [(0, [1.0, 0.0], 1), (0, [0.0, 1.0], 1), (1, [0.5, 0.0], 1), (2, [0.0, 0.5], 1)]
    got = K.top_k(table(spark, rows), F.col("id") == 0, 1).collect()
    assert sorted((r.query_id, r.rank, r.id, r.score) for r in got) == [(0, 1, 1, 256 * 128), (0, 1, 2, 256 * 128)] and len({r.query_row for r in got}) == 2


def test_a_hot_vector_is_one_class_of_few_ids(spark):
    rows = spark.range(0, 9000, 1, 9).select(F.col("id").alias("vec_id"), F.array(F.lit(0.5), F.when(F.col("id") % 3 == 0, 0.25).otherwise(F.col("id") / 9000.0)).alias("embedding"))
    c = X.classes(X.integer_rows(rows, "vec_id", "embedding"), 6)
    assert c.count() <= 257 and c.agg(F.max(F.size("ids"))).first()[0] == 6
    plan = c._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2  # ids are cut before the shuffle, too


@pytest.mark.parametrize(("part", "kind"), [(0.95, "even"), (0.6, "uneven")])
def test_postings_and_planes_are_left_out(part, kind):
    rng = np.random.default_rng(5)
    v = np.floor(rng.normal(0, 30, (4000, 64)) if kind == "even" else rng.standard_t(1.5, (4000, 64)).clip(-100, 100) * 5).astype(np.int64)
    block = {**K._build({"v": v, "ids": X.pa.array([[i] for i in range(4000)])})}
    s = K.Segments(block, v[:20])
    for q in s.queries:
        members, scores = s.best(q, 5)
        exact = v @ q
        assert set(np.argsort(-exact, kind="stable")[:6]) <= set(members) and (scores == exact[members]).all()
        assert len(members) <= max(6, 4000 // K.FEW)
    assert s.processed < part * 20 * 4000 * 64
    held = H._build({"v": v, "label": X.pa.array([0] * 4000), "ids": X.pa.array([[i] for i in range(4000)])})
    p = H.Planes(held, v[:20])
    for a in p.anchors:
        live, scores = p.scores(a, np.arange(4000), H._best(6))
        exact = v @ a
        assert set(np.argsort(-exact, kind="stable")[:6]) <= set(live) and (scores == exact[live]).all() and len(live) < 10
    assert p.worked < 0.75 * 20 * 4000 * held["bits"]


def test_planes_give_the_numbers_back():
    v = np.array([[0, -1, 5, -128, 127, 1 << 20], [3, 0, 0, 0, 0, -(1 << 20)]])
    bits = H.width(v)
    planes = H.planes_of(v, bits)
    back = sum(w * np.unpackbits(planes[p].view(np.uint8), axis=1, bitorder="little")[:, :6].astype(np.int64) for p, w in enumerate(H.weights(bits)))
    assert (back == v).all() and H.width(np.array([[0]])) == 1 and H.width(np.array([[-1]])) == 1 and H.width(np.array([[-2]])) == 2


def test_scores_that_do_not_fit_are_an_error(spark):
    rows = [(i, [3e18, 3e18], 1) for i in range(12)]
    with pytest.raises(Exception, match="don't fit"):
        K.top_k(table(spark, rows), F.lit(True)).collect()


# 13


def brute_history(changes, last):
    """changes: (key, kind, since, until, value) in order of arrival."""
    out, by_key = [], defaultdict(list)
    for c in changes:
        by_key[c[0]].append(c[1:])
    for key, cs in by_key.items():
        days = []
        for day in range(-30, last + 1):
            state = None
            covering = [c for c in cs if c[0] == "correction" and c[1] <= day < c[2]]
            before = [(c[1], n, c) for n, c in enumerate(cs) if c[0] != "correction" and c[1] <= day]
            if covering:
                state = (covering[-1][3],)
            elif before and (c := max(before, key=lambda b: b[:2])[2])[0] == "update":
                state = (c[3],)
            days.append(state)
        runs = []
        for day, state in enumerate(days, -30):
            if state is not None and runs and runs[-1][1] == day and runs[-1][2] == state:
                runs[-1][1] = day + 1
            elif state is not None:
                runs.append([day, day + 1, state])
        out += [(key, n + 1, lo, None if hi > last else hi, s[0]) for n, (lo, hi, s) in enumerate(runs)]
    return sorted(out, key=str)


CHANGES = "key string, kind string, since long, until long, value string, arrival long, span string, k string"


@pytest.mark.parametrize("span", [1, 4, 7, 1024])
def test_history_equals_brute_force(spark, span):
    rng = random.Random(span)
    changes = []
    for n in range(900):
        kind = rng.choice(["update", "update", "delete", "correction"])
        since = rng.randrange(-20, 40)
        changes.append((rng.choice(["hot", "hot", "hot", *"abcdefgh"]), kind, since, since + rng.randrange(1, 12) if kind == "correction" else rng.choice([None, 3]), rng.choice(["x", "y", None]) if kind != "delete" else "gone", n, "s", "k"))
    odd = [(None, "update", 1, None, "x", 1000, "s", "k"), ("a", None, 1, None, "x", 1001, "s", "k"), ("a", "update", None, None, "x", 1002, "s", "k"), ("a", "correction", 5, None, "z", 1003, "s", "k"), ("a", "correction", 5, 5, "z", 1004, "s", "k"), ("a", "other", 5, 9, "z", 1005, "s", "k"), ("none", "delete", 3, None, None, 1006, "s", "k")]
    rows = changes + odd
    rng.shuffle(rows)
    got = V.history(spark.createDataFrame(rows, CHANGES).repartition(3), span=span)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_history([c[:5] for c in changes], 60)


def test_history_of_nothing(spark):
    assert V.history(spark.createDataFrame([], CHANGES)).collect() == []


def test_equal_changes_and_ties(spark):
    rows = [("a", "update", 1, None, "x", 5, "", ""), ("a", "update", 1, None, "y", 5, "", ""), ("a", "update", 1, None, None, 5, "", ""), ("a", "update", 1, None, "y", 5, "", ""), ("a", "update", 3, None, "y", 1, "", "")]
    assert [tuple(r) for r in V.history(spark.createDataFrame(rows, CHANGES)).collect()] == [("a", 1, 1, None, "y")]


def test_a_hot_key_is_reduced_before_it_is_shuffled(spark):
    """A third of a million changes of one key on 50 days: what arrives at its spans is a change a day and range."""
    df = spark.range(0, 300_000, 1, 6).select(F.lit("k").alias("key"), F.when(F.col("id") % 4 == 0, "correction").otherwise("update").alias("kind"), (F.col("id") % 50).alias("since"), (F.col("id") % 50 + 1 + F.col("id") % 3).alias("until"), (F.col("id") % 7).cast("string").alias("value"), F.col("id").alias("arrival"))
    out = V.history(df, span=16)
    assert out.agg(F.min("valid_from"), F.max("valid_from")).first()[:] == (0, 51)
    assert out.where("valid_to is null").count() == 1


def test_arrivals_keep_lists_linked_and_merged():
    rng = random.Random(3)
    h = V.History(0, 60, None)
    for _ in range(400):
        s = rng.randrange(0, 59)
        h.arrive(rng.choice(["update", "delete", "correction"]), s, s + rng.randrange(1, 9), rng.choice("xy"))
        for held in (h.base, h.corrections, h.visible):
            seen = list(held)
            assert [x[0] for x in seen] == held.starts and seen[0][0] == 0 and seen[-1][1] == 60
            assert all(a[1] == b[0] for a, b in zip(seen, seen[1:], strict=False))
            if held.merging:
                assert all(a[2] != b[2] for a, b in zip(seen, seen[1:], strict=False))
            v, back = held.by_start[held.starts[-1]], []
            while v:
                back.append(v.since)
                v = v.before
            assert back[::-1] == held.starts


@pytest.mark.parametrize("name", ["op11_hard_negatives", "op12_topk_search", "op13_dimension_history"])
def test_new_queries_equal_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for n in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {n.split('.')[0]} AS SELECT * FROM read_parquet('{sf_dir}/{n}')")
    cursor = con.execute(Q.oracle_sql()[name])
    df = Q.queries()[name](spark, sf_dir)
    assert df.columns == [c[0] for c in cursor.description]
    got, expected = (sorted(map(tuple, rows), key=str) for rows in (df.collect(), cursor.fetchall()))
    assert got == expected and got
