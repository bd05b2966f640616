"""The pipeline's stages against brute force, each on what the stage before kept."""

import re
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from quillon.llm.common import documents, stash
from quillon.llm.ngram_join import Alike
from test_operators import brute_components, brute_hits, brute_targets, check_shards, words


def test_stages(spark, sf_dir):
    docs, held = documents(spark, sf_dir), {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stash(stage(spark, docs, sf_dir), name)
        held[name] = (before.collect(), docs.collect())
        if name != "sharding":
            assert docs.columns == before.columns
    old, new = held["language_id"]
    assert {r.doc_id for r in new} == {r.doc_id for r in old if any(c.isalpha() for c in r.text or "")}
    old, new = held["near_duplicates"]
    groups = brute_components([(r.doc_id, r.text) for r in old], Alike(5, 80, 100))
    assert sorted(r.doc_id for r in new) == sorted(i for i, (_, c) in groups.items() if i == c)
    old, new = held["decontamination"]
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    hits = brute_hits([(r.doc_id, r.text) for r in old], bench)
    assert sorted(r.doc_id for r in new) == sorted(i for i, h in hits.items() if not h[1])
    old, new = held["mixing"]
    size, taken = defaultdict(int), defaultdict(int)
    for r in old:
        size[r.source] += len(words(r.text))
    for r in new:
        taken[r.source] += len(words(r.text))
    target, largest = brute_targets(size), {s: max(len(words(r.text)) for r in old if r.source == s) for s in size}
    assert max(Counter(r.doc_id for r in new).values()) <= 2 and all(abs(taken[s] - target[s]) <= max(0.03 * target[s], largest[s] / 2) for s in size)
    old, new = held["sharding"]
    check_shards(new, len(old), 24)
    assert Counter(r.doc_id for r in old) == Counter(r.doc_id for r in new)
    shards = defaultdict(set)
    for r in new:
        shards[r.doc_id].add(r.shard)
    assert sum(len(s) > 1 for s in shards.values()) <= len(shards) // 20
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_duplicates", "decontamination", "mixing", "sharding"]


def test_no_guard_in_the_pipeline():
    with open(corpus_pipeline.__file__) as f:
        assert not re.search(r"except|find_spec", f.read())


def odd_rows(spark, columns=("doc_id", "text", "lang", "source", "n_chars", "_row", "id")):
    long = " ".join(f"Word{i % 977}" for i in range(30_000))
    said = " ".join(f"say{i}" for i in range(40))
    texts = [(1, None), (2, ""), (3, "  \n"), (4, "123 456"), (5, long), (1, said), (1, said), (None, said), (2, said + " more"), (None, "alone without an id at all"), (None, "alone without an id at all"), (7, "alone without an id at all"), (8, "été à la plage"), (8, "another text of the same id"), (9, long)]
    rows = [(i, t, "en" if k % 3 else None, "ab"[k % 2] if k % 5 else None, len(t or ""), "x", "y") for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, ", ".join(f"`{c}` {k}" for c, k in zip(columns, ("long", "string", "string", "string", "long", "string", "string"), strict=True)))


def pairs_of(df):
    return sorted(((r[0], r[1]) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def odd_docs(spark):
    return stash(odd_rows(spark), "odd")


def test_language_stage_odd(spark, odd_docs, sf_dir):
    out = corpus_pipeline.detect_language(spark, odd_docs, sf_dir)
    assert out.columns == odd_docs.columns
    assert pairs_of(out) == sorted(((i, t) for i, t in pairs_of(odd_docs) if any(c.isalpha() for c in t or "")), key=str)


def test_near_duplicates_stage_odd(spark, odd_docs, sf_dir):
    out = corpus_pipeline.drop_near_duplicates(spark, odd_docs, sf_dir)
    assert out.columns == odd_docs.columns
    got = pairs_of(out)
    texts = dict.fromkeys(t for _, t in pairs_of(odd_docs))
    long, said = next(t for t in texts if t and t.startswith("Word")), next(t for t in texts if t and t.endswith("say39"))
    alone = "alone without an id at all"
    assert got == sorted([(1, None), (2, ""), (3, "  \n"), (4, "123 456"), (5, long), (1, said), (7, alone), (8, "été à la plage"), (8, "another text of the same id")], key=str)
    four = spark.createDataFrame([(1, said), (1, said), (None, said), (2, said)], "doc_id long, text string")
    assert pairs_of(corpus_pipeline.drop_near_duplicates(spark, four, sf_dir)) == [(1, said)]
    assert pairs_of(corpus_pipeline.drop_near_duplicates(spark, four.where("doc_id is null").unionByName(four.where("doc_id is null")), sf_dir)) == [(None, said)]


def test_decontamination_stage_odd(spark, odd_docs, sf_dir):
    out = corpus_pipeline.drop_contaminated(spark, odd_docs, sf_dir)
    assert out.columns == odd_docs.columns
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    hits = {t: brute_hits([(0, t)], bench)[0][1] for _, t in pairs_of(odd_docs)}
    assert pairs_of(out) == sorted(((i, t) for i, t in pairs_of(odd_docs) if not hits[t]), key=str)


def test_mixing_stage_odd(spark, odd_docs, sf_dir):
    out = corpus_pipeline.mix_sources(spark, odd_docs, sf_dir)
    assert out.columns == odd_docs.columns
    before, after = Counter(pairs_of(odd_docs)), Counter(pairs_of(out))
    assert set(after) <= set(before) and all(n <= 2 * before[k] for k, n in after.items())
    assert pairs_of(corpus_pipeline.mix_sources(spark, odd_docs.repartition(3), sf_dir)) == pairs_of(out)


def test_sharding_stage_odd(spark, odd_docs, sf_dir):
    out = corpus_pipeline.deal_to_shards(spark, odd_docs, sf_dir)
    assert out.columns[: len(odd_docs.columns) - 1] == [c for c in odd_docs.columns if c != "text"]
    check_shards(out.collect(), odd_docs.count(), 24)


def test_empty_stages(spark, odd_docs, sf_dir):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd_docs.limit(0), sf_dir).count() == 0, name


def test_run_leaves_the_last_stage_alone(spark, sf_dir):
    """Of the tables on the way only what the result reads is left."""
    from quillon.llm import common

    held = len(common._stashed(spark))
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.count() > 0
    left = common._stashed(spark)[held:]
    assert sum("mixing" in p for p in left) == 1 and not any(n in p for p in left for n in ("language_id", "near_duplicates", "decontamination", "sketch", "lambdas"))
