"""F1, F2: where probes go to the segments, they go by large chunks, and a chunk that is read in parts gives the same scores."""

import numpy as np
import pytest

from quillon.llm import lm_score


def text(i):
    return " ".join(f"w{(i * k * k) % 211}" for k in range(1 + i % 60)) if i % 50 else None


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, text(i)) for i in range(600)], "doc_id long, text string").repartition(3, "doc_id").cache()


def scores(docs, model, **more):
    return sorted((r.row.doc_id, r.n_tokens, r.n_known, round(r.base_score, 9), round(r.score, 9)) for r in lm_score.score(docs, model, ["doc_id"], **more).collect())


@pytest.mark.parametrize("chunk", [1, 3000, 4 << 20])
@pytest.mark.parametrize("records", [7, 10_000])
def test_chunks_read_in_parts(spark, docs, monkeypatch, chunk, records):
    monkeypatch.setattr(lm_score, "CHUNK_BYTES", chunk)
    monkeypatch.setattr(lm_score, "PROBED", 16)
    model = lm_score.train(docs.where("doc_id % 3 > 0"))
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(records))
    try:
        assert scores(docs, model, broadcast_bytes=0) == scores(docs, model)
    finally:
        spark.conf.set(key, before)


def test_chunk_in_two_files(spark, docs, tmp_path):
    """Rows of one chunk that two tasks read, in any order."""
    model = lm_score.train(docs.where("doc_id % 3 > 0"))
    rows = spark.createDataFrame([(i, i // 40 * 40, text(i)) for i in range(200)], "rid long, chunk long, t string")
    rows.where("rid % 40 >= 17").coalesce(1).write.parquet(f"{tmp_path}/rows")
    rows.where("rid % 40 < 17").coalesce(1).write.mode("append").parquet(f"{tmp_path}/rows")
    got = {r.rid: round(r.score, 9) for r in lm_score.score_routed(spark.read.parquet(f"{tmp_path}/rows"), model, "t").collect()}
    assert got == {i: s for i, *_, s in scores(docs, model) if i < 200}


def test_probes_go_by_chunk(spark, docs):
    """A row for each chunk, kind and segment: 600 texts of three tasks make three chunks."""
    model = lm_score.train(docs.where("doc_id % 3 > 0"))
    rows = docs.selectExpr("monotonically_increasing_id() AS rid", "spark_partition_id() AS chunk", "text AS t").selectExpr("rid", "cast(chunk AS long) AS chunk", "t")
    asked = lm_score._levels_at_segments(rows, model, "t").collect()
    assert len({(r.chunk, r.sub, r.kind, r.seg) for r in asked}) == len(asked) <= 3 * 2 * model.n_segments


@pytest.mark.parametrize("segments", [1, 16])
def test_levels_bit_by_bit(segments):
    """level() stops at a key's first bit that isn't set; it says what all its bits say."""
    r = np.random.default_rng(segments)
    keys, counts = np.unique(r.integers(0, 1 << 64, 4000, dtype=np.uint64)), 1 + r.geometric(0.1, 4000)
    own = lm_score.segment_of(keys, segments)
    blobs = {s: lm_score.build_segment(keys[own == s], counts[: len(keys)][own == s], 3.0) for s in range(segments)}
    f = lm_score.LogFilter({s: len(b) for s, b in blobs.items()}, segments)
    for s, b in blobs.items():
        f.fill(s, b)
    for k in np.concatenate([keys[:100], r.integers(0, 1 << 64, 300, dtype=np.uint64)]):
        s = int(lm_score.segment_of(np.array([k]), segments)[0])
        bits = np.unpackbits(np.frombuffer(blobs[s], np.uint8, offset=8), bitorder="little")
        want = 0
        while all(bits[p[0]] for p in lm_score._places(np.array([k]), want + 1, int.from_bytes(blobs[s][:8], "little"))):
            want += 1
        assert f.level(np.array([k]))[0] == want


def test_rare_words_of_a_text_move_once(spark, docs):
    """A text's words outside the head come counted: they are dealt by word, joined with counts, and summed by text, without a grouping before."""
    model = lm_score.train(docs.where("doc_id % 3 > 0"))
    out = lm_score.score(docs, model, ["doc_id"], head=3)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 1
    want = scores(docs, model)
    assert sorted((r.row.doc_id, r.n_tokens, r.n_known, round(r.base_score, 9), round(r.score, 9)) for r in out.collect()) == want
