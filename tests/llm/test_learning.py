"""What operators learn and round, against plain Python: trigram counts of language ID, shifts of mixing."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.llm import language_id as LI
from quillon.llm import mixing as M


def plain_buckets(text):
    """The bucket of the trigram of bytes around each byte of a letter, ASCII in lower case and all else as a space."""
    spaced = [32]
    for b in text.encode():
        spaced.append(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32)
    spaced.append(32)
    for i in range(1, len(spaced) - 1):
        if spaced[i] != 32:
            yield ((spaced[i - 1] * 65536 + spaced[i] * 256 + spaced[i + 1]) * 0x9E3779B97F4A7C15 % 2**64) >> 48


def test_learning_equals_plain_counts(spark, sf_dir, monkeypatch):
    """Also where tasks must send on what they have counted many times."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("lang", "text")
    odd = spark.createDataFrame([("en", None), (None, "not learned"), ("xx", "\u00e9t\u00e9 A"), ("yy", ""), ("xx", "123")], "lang string, text string")
    rows = docs.unionByName(odd)
    counts = {}
    for r in rows.collect():
        if r.lang is not None:
            counts.setdefault(r.lang, Counter()).update(plain_buckets(r.text or ""))
    langs = sorted(k for k, c in counts.items() if c)
    expected = np.full((LI.BUCKETS, len(langs)), LI.SMOOTH)
    for j, k in enumerate(langs):
        for b, n in counts[k].items():
            expected[b, j] += n
    expected = np.log(expected / expected.sum(axis=0)).astype(np.float32)
    for held in (LI.HELD, 500):
        monkeypatch.setattr(LI, "HELD", held)
        model = LI.learn(rows.repartition(3))
        assert model.langs == langs and np.array_equal(model.table, expected)


def test_learning_many_labels(spark):
    rows = spark.range(300).select(F.concat(F.lit("l"), "id").alias("lang"), F.lit("some words of it").alias("text"))
    assert len(LI.learn(rows.where(f"id < {LI.MOST_LANGS}")).langs) == LI.MOST_LANGS
    with pytest.raises(ValueError, match="300 labels"):
        LI.learn(rows)


def test_shifts_are_the_greatest_that_meet_the_target(spark):
    """Against copies counted at each shift, for targets below, within and above what shifts can reach."""
    made = spark.range(400).select("id", F.concat(F.lit("="), (F.col("id") % 4).cast("string")).alias("key"), (F.pmod(F.xxhash64("id"), F.lit(97)) + F.lit(0)).alias("size"), F.lit(0).cast("long").alias("hash"), F.lit(0).alias("copy"))
    sources = spark.createDataFrame([("=0", 0.0, False, 0.1), ("=1", 5000.0, False, 0.2), ("=2", 4000.5, False, -0.4), ("=3", 1e9, False, 0.0)], "key string, target double, full boolean, lam double").withColumn("mean", F.lit(48.0))
    own = M.Mix(sources, made.limit(0), 2, 1.5)
    got = {r.key: r["shift"] for r in M.shifts(own, made).collect()}
    rows = own.rated(made).select("key", "size", "rate", "u", "target").collect()
    for key, shift in got.items():
        mine = [r for r in rows if r.key == key]
        words = lambda s: sum(r.size * max(0, min(2, math.floor(r.rate + r.u + s))) for r in mine)
        step = 2 / M.CELLS
        assert (shift + 1) / step == int((shift + 1) / step) and -1 <= shift < 1
        assert words(shift) <= mine[0].target or shift == -1
        assert shift == 1 - step or words(shift + step) > mine[0].target
