"""Sharding along links of near copies, against links found by comparing all pairs."""

from collections import Counter

from pyspark.sql import functions as F

from quillon.llm.queries import sharding_by_links


def shingles(text):
    words = text.split()
    return frozenset(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else frozenset()


def test_links_are_cut_less_than_by_hash(spark, tmp_path):
    """Groups of near copies whose texts differ in one word of sixty, beside single texts, nulls, a repeated row and an id with two texts."""
    texts = {}
    for g in range(40):
        for k in range(6):
            words = [f"w{g}x{i}" for i in range(60)]
            words[-1] = f"own{k // 2}"
            texts[g * 6 + k] = " ".join(words)
    texts |= {1000 + i: f"single text number {i} about nothing else {i}" for i in range(300)} | {2000: None, 2001: ""}
    rows = [(i, t) for i, t in texts.items()] + [(0, texts[0]), (None, texts[6]), (5000, texts[18]), (5000, texts[24])]
    spark.createDataFrame(rows, "doc_id long, text string").withColumn("shard", F.lit("x")).repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    out = sharding_by_links(spark, str(tmp_path)).collect()
    assert len(out) == len(rows)
    counts = Counter(x.shard for x in out)
    assert set(counts) == set(range(24)) and max(counts.values()) - min(counts.values()) <= 1
    assert all(sorted(x.slot for x in out if x.shard == s) == list(range(n)) for s, n in counts.items())
    sets = {i: shingles(t or "") for i, t in texts.items()}
    least = {i: min([j for j in sets if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])], default=i) for i in sets}
    assert {x.doc_id: x.linked_to for x in out if x.doc_id is not None} == {i: j if j != i else None for i, j in least.items()} | {5000: 18}
    first = {i: min(x.shard for x in out if x.doc_id == i) for i in sets}
    for x in out:
        assert x.cut == (None if x.linked_to is None else x.shard != first[x.linked_to])
    cut, by_hash = sum(bool(x.cut) for x in out), sum(bool(x.hash_cut) for x in out)
    assert cut < 0.6 * by_hash, (cut, by_hash)


def test_no_documents(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert sharding_by_links(spark, str(tmp_path)).collect() == []
