"""shares of moves between shards are one literal, with the values as they are."""

import random

from pyspark.sql import functions as F

from quillon.llm.sharding import flows, share


def test_shares_are_one_literal(spark):
    rng = random.Random(7)
    part = {(a, b): rng.random() ** 9 for a in range(24) for b in range(24) if a != b and (a + b) % 5}
    rows = spark.range(24).select(F.col("id").cast("int").alias("a")).crossJoin(spark.range(24).select(F.col("id").cast("int").alias("b")))
    out = rows.withColumn("p", share(part, 24, F.col("a"), F.col("b")))
    assert out._jdf.queryExecution().analyzed().toString().count("0.0") < 24 * 24  # a literal is cut short where it's shown, pairs of their own aren't
    assert {(x.a, x.b): x.p for x in out.collect()} == {(a, b): part.get((a, b), 0.0) for a in range(24) for b in range(24)}


def test_flows(spark):
    moves = spark.createDataFrame([(0, 1, 5), (0, 1, 2), (1, 1, 4), (2, None, 3)], "shard int, to int, w long")
    assert flows(moves) == {(0, 1): 7, (1, 1): 4, (2, None): 3}
