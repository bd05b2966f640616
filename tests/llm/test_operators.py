"""The ten operators against brute force in plain Python, over odd rows and over the small documents table."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from conftest_llm import SCHEMA, table  # noqa: F401
from quillon.llm import decontaminate as D
from quillon.llm import language_id as LI
from quillon.llm import license_rules, lm_score
from quillon.llm import license_scan as LS
from quillon.llm import ngram_join as J
from quillon.llm import queries as Q
from quillon.llm.chat_format import chat_format, escape, parse, read_back, render, unescape
from quillon.llm.common import documents, plain
from quillon.llm.components import components
from quillon.llm.exact_dedup import exact_dedup
from quillon.llm.mixing import mix, sized
from quillon.llm.sharding import let_through, shard_documents
from quillon.llm.token_counts import PrefixCounter, token_counts

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ALNUM, SPACED = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), re.compile(r"[^\x20\x09-\x0D]+")


def words(text, kind=SPACED):
    return kind.findall((text or "").translate(LOW))


def rows_of(docs):
    return [(r.doc_id, r.text) for r in plain(docs).select("doc_id", "text").collect()]


# 1


def places(text):
    w = words(text, ALNUM)
    return len(w), sorted((k, label) for label, p in LS.BASE for k in range(len(w)) if w[k : k + len(p.split())] == p.split())


def check_licenses(found, docs):
    got = defaultdict(list)
    for r in LS.summary(found).collect():
        got[r.row.doc_id].append(r)
    for i, text in rows_of(docs):
        n, base = places(text)
        r = got[i].pop()
        assert (r.n_words, r.n_base) == (n, len(base)) and 0 <= r.score <= 1
        assert (r.first_word, r.last_word) == ((base[0][0], base[-1][0]) if base else (None, None))
        assert r.base_labels == ",".join(sorted({x for _, x in base}))
        assert {x for _, x in base} <= set(r.labels.split(",")) or not base


def test_license_base(spark, sf_dir, odd):
    docs = documents(spark, sf_dir)
    check_licenses(LS.license_scan(docs, keep=["doc_id"]), docs)
    check_licenses(LS.license_scan(odd[0], keep=["doc_id"]), odd[0])


def test_what_rules_always_have():
    has = license_rules.always_has
    assert has("mit licen[sc]e") and has("a|b", "a") is False and has("(?:a|ba) c", "a") and not has("(?:a|b)?c", "a") and not has("a?b", "a") and has("(?:x )?(?:a licen[sc]e|b licen[sc]e)(?: y)?")
    assert not has("(?:licen[sc]e){0,3}? x") and not has("li ?cen") and not has("cc0(?: licen[sc]e)?|creative commons zero")
    assert sum(r.also == license_rules.STEM for r in license_rules.rules()) > 200


def test_license_detections_equal_python(spark):
    texts = ["Licensed under the Apache License, Version 2.0", "SPDX-License-Identifier: MIT", "GNU General Public License version 3 or later. MIT license", "CC BY-NC-SA 4.0 / Creative Commons Attribution-ShareAlike 4.0 International", "Redistribution and use in source and binary forms, with or without modification", "all rights reserved MIT License Apache License", "Released under the BSD 3-clause license. " * 300, "no words about it", "the ＭＩＴ license İ MIT LICENSE"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    table_ = license_rules.rules()
    assert len(table_) > 300
    got = {r.row.doc_id: [(d.first, d.last, d.label) for d in r.detections] for r in LS.license_scan(docs).collect()}
    for i, text in enumerate(texts):
        found = []
        numbered = " " + " ".join(f"{w}~{k}" for k, w in enumerate(words(text, ALNUM))) + " "
        for k, rule in enumerate(table_):
            for m in re.finditer(LS.pattern(rule.text), numbered):
                n = re.findall(r"~(\d+)", m[0])
                found.append((int(n[0]), -int(n[-1]), rule.priority, k, rule.label))
        kept = []
        found.sort()
        for k, (a, b, p, _, label) in enumerate(found):
            if not any(e <= b and q <= p for _, e, q, _, _ in found[:k]):
                kept.append((a, -b, label))
        assert got[i] == kept, text[:60]
    assert [x[2] for x in got[0]] == ["apache-2.0"] and [x[2] for x in got[3]] == ["cc-by-nc-sa-4.0", "cc-by-sa-4.0"] and len(got[6]) == 300


def test_license_rules_are_tried_on_every_text(spark):
    """Brute force without gate or keywords: all rules on all texts."""
    texts = ["Released under Apache 2.0", "distributed under MPL 2.0", "available under the terms of the 3-clause BSD", "see mozilla.org/MPL/2.0", "https://www.eclipse.org/legal/epl-v10.html", "http://scripts.sil.org/OFL", "licensed under\nEUPL 1.2", "covered by CDDL 1.1", "provided under GFDL 1.3", "All rights\nreserved", "is in the public\n domain", "(c) All  Rights\tReserved", "spdx license identifier EDL 1.0", "nothing here but a permit, a summit and the 3rd option", "released under (MPL 2.0)", "mpl 2.0", None]
    texts += ["released under " + f.name.split("|")[0].replace(license_rules.L, "license") + " x" for f in license_rules.FAMILIES if "(" not in f.name and "[" not in f.name.replace(license_rules.L, "")]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    table_ = license_rules.rules()
    got = {r.row.doc_id: [(d.first, d.last, d.label) for d in r.detections] for r in LS.license_scan(docs).collect()}
    for i, text in enumerate(texts):
        numbered = " " + " ".join(f"{w}~{k}" for k, w in enumerate(words(text, ALNUM))) + " "
        found = []
        for k, rule in enumerate(table_):
            for m in re.finditer(LS.pattern(rule.text), numbered):
                n = re.findall(r"~(\d+)", m[0])
                found.append((int(n[0]), -int(n[-1]), rule.priority, k, rule.label))
        found.sort()
        kept = [(a, -b, label) for k, (a, b, p, _, label) in enumerate(found) if not any(e <= b and q <= p for _, e, q, _, _ in found[:k])]
        assert got[i] == kept, text
    assert all(got[i] for i in range(13)) and not got[13]


# 2


def check_shards(out, n_docs, shards):
    per = defaultdict(list)
    for r in out:
        per[r.shard].append(r.slot)
    counts = [len(per[s]) for s in range(shards)]
    assert sum(counts) == n_docs == len(out) and max(counts) - min(counts) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in per.values())


def test_sharding(spark, odd):
    r = random.Random(1)
    rows = [(i, f"text {r.randint(0, 250)}", "en", "a") for i in range(600)] + [(600 + i, "hot", "en", "a") for i in range(300)]
    docs = table(spark, rows)
    out = shard_documents(docs, shards=6).collect()
    check_shards(out, 900, 6)
    group = defaultdict(set)
    for x in out:
        group[rows[x.id][1]].add(x.shard)
        assert x.size == len(rows[x.id][1].encode()) + 8 and x.text_crc32 == zlib.crc32(rows[x.id][1].encode()) and x.law == "rows" and x.grown_shard is None
    assert len(group.pop("hot")) <= 3 and sum(len(s) > 1 for s in group.values()) <= len(group) // 10
    out = shard_documents(odd[0], shards=3).collect()
    check_shards(out, len(odd[1]), 3)
    assert {x.size for x in out if x.id in (1, 2)} == {8}


def test_sharding_follows_edges(spark):
    """Communities of linked documents: far fewer edges are cut than by hash or without edges, and counts stay even."""
    r = random.Random(5)
    n, size = 1200, 20
    docs = table(spark, [(i, f"text {i if i % 7 else i // 14}", "en", "a") for i in range(n)])
    team = r.sample(range(n), n)
    edges = [(team[a], team[b], 1) for k in range(0, n, size) for _ in range(60) for a, b in [r.sample(range(k, k + size), 2)]] + [(r.randrange(n), r.randrange(n), 1) for _ in range(300)] + [(5, 99_999, 1)]
    linked = spark.createDataFrame(edges, "a long, b long, w long")
    cut = {}
    for name, given in (("edges", linked), ("none", None)):
        out = shard_documents(docs, shards=6, edges=given).collect()
        check_shards(out, n, 6)
        at = {x.id: x.shard for x in out}
        cut[name] = sum(at[a] != at[b] for a, b, _ in edges if b in at)
    by_hash = sum(zlib.crc32(str(a).encode()) % 6 != zlib.crc32(str(b).encode()) % 6 for a, b, _ in edges)
    assert cut["edges"] < 0.6 * by_hash and cut["edges"] < 0.7 * cut["none"], (cut, by_hash)


def test_sharding_repeats(spark):
    """One id and one text a third of all rows; reruns agree."""
    rows = [(1, "same", "en", "a")] * 100 + [(None, None, "en", "a")] * 30 + [(i, f"t{i % 50}", "en", "a") for i in range(170)]
    out = [sorted(((x.id, x.size, x.shard, x.slot) for x in shard_documents(table(spark, rows).repartition(k), shards=4).collect()), key=str) for k in (1, 3)]
    assert out[0] == out[1]
    check_shards(shard_documents(table(spark, rows), shards=4).collect(), 300, 4)


def test_quota_flow():
    part = let_through({(0, 1): 10, (2, 1): 10, (1, 0): 4}, [10, 10, 10], 12)
    assert 10 + 10 * part[0, 1] + 10 * part[2, 1] - 4 * part[1, 0] <= 12.6


# 3


def check_scores(docs, head=lm_score.HEAD, broadcast=lm_score.BROADCAST_BYTES):
    train = docs.where("crc32(cast(doc_id as string)) % 7 <> 2")
    model = lm_score.train(train)
    got = defaultdict(list)
    for r in lm_score.score(docs, model, ["doc_id"], head=head, broadcast_bytes=broadcast).collect():
        got[r.row.doc_id].append(r)
    counts = Counter()
    for i, t in rows_of(docs):
        if i is not None and zlib.crc32(str(i).encode()) % 7 != 2:
            counts.update([*words(t), None])
    n, types = sum(counts.values()), len(counts)
    assert (model.n_tokens, model.n_types) == (n, types)
    out = {}
    for i, t in rows_of(docs):
        own = [*words(t), None]
        r = got[i].pop()
        base = sum(math.log10((counts[w] + 1) / (n + types + 1)) for w in own)
        assert r.n_tokens == len(own) and r.n_known == sum(counts[w] > 0 for w in own)
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score <= 0
        out[i] = (r.score, len(own))
    return out


def test_lm_scores(spark, sf_dir, odd):
    docs = documents(spark, sf_dir)
    one = check_scores(docs)
    two = check_scores(docs, head=40, broadcast=0)  # words joined, probes sent to the segments
    assert one.keys() == two.keys() and all(one[i][0] == pytest.approx(two[i][0], rel=1e-12) for i in one)
    check_scores(odd[0].where("doc_id is not null"))


def exact_scores(docs):
    """log10 probabilities from exact counts of words and pairs, with the levels' ends but without a filter."""
    one, two, n = Counter(), Counter(), lm_score.GROWTH
    for i, t in docs:
        if i is None or zlib.crc32(str(i).encode()) % 7 != 2:
            own = [None, *words(t), None]
            one.update(own[1:])
            two.update(zip(own, own[1:]))
    level = lambda c: 1 + math.floor(math.log(c) / math.log(n) + 1e-9)
    low = lambda c: math.floor(n ** (level(c) - 1) + 1e-6) if c else 0
    up = lambda c: math.ceil(n ** level(c)) if c else 0
    total, types = sum(map(low, one.values())), len(one)
    out = []
    for i, t in docs:
        own, s = [None, *words(t), None], 0.0
        for a, b in zip(own, own[1:]):
            alone = (low(one[b]) + 1) / (total + types + 1)
            s += math.log10(min(1.0, (min(low(two[a, b]), max(up(one[a]), 1)) + lm_score.MU * alone) / (up(one[a]) + lm_score.MU)))
        out.append((i or -1, s, len(own) - 1))
    return sorted(out)


def test_lm_scores_equal_exact_counts(spark, sf_dir, odd):
    """With many bits the filter's scores are those of exact counts; with its usual bits a token's score is off by little."""
    for docs in (documents(spark, sf_dir), odd[0]):
        train = docs.where("coalesce(crc32(cast(doc_id as string)) % 7, 0) <> 2")
        expected = exact_scores(rows_of(docs))
        for bits, near in ((512.0, 1e-7), (lm_score.BITS, 0.06)):
            model = lm_score.train(train, bits_each=bits)
            for routed in (lm_score.BROADCAST_BYTES, 0):
                got = sorted((r.row.doc_id or -1, r.score, r.n_tokens) for r in lm_score.score(docs, model, ["doc_id"], broadcast_bytes=routed).collect())
                off = [abs(a[1] - b[1]) / a[2] for a, b in zip(got, expected, strict=True)]
                assert [(a[0], a[2]) for a in got] == [(b[0], b[2]) for b in expected] and sum(off) / len(off) <= near


def test_lm_null_ids_are_trained_on(spark):
    docs = spark.createDataFrame([(None, "a b a"), (None, None), (2, "a c")], "doc_id long, text string")
    model = lm_score.train(docs.where("coalesce(crc32(cast(doc_id as string)) % 7, 0) <> 2"))
    assert model.n_tokens >= 5


def test_filter_levels_never_fall_short():
    import numpy as np

    r = np.random.default_rng(1)
    keys, counts = r.integers(0, 1 << 63, 5000, dtype=np.uint64), r.integers(1, 1000, 5000)
    blob = lm_score.build_segment(keys, counts)
    f = lm_score.LogFilter({0: len(blob)}, 1).fill(0, blob)
    got, true = f.level(keys), lm_score.levels(counts)
    assert (got >= true).all() and (got == true).mean() > 0.93
    assert (f.level(r.integers(0, 1 << 63, 5000, dtype=np.uint64)) == 0).mean() > 0.93


# 4


@pytest.fixture(scope="module")
def counter():
    import public_tokenizers

    return PrefixCounter(public_tokenizers.path("word_bpe_49k.json"))


ODD_TEXTS = ["", "don't they're I'LL 'r ''s .\"'s x", "<|endoftext|>a<|startoftext|> b <|endoftext|>", "日本語テスト １２ ½²", "ΑΣ Σ ΟΔΟΣ", "été İx İ", "a\x1cb\x85c\xa0d e﻿", "\U0001f600\U0001f468‍\U0001f469 ok", "ﬁ Ǆ ŉ", "<|ENDOFTEXT|>", "été", "a" * 500, "ab " * 3000]


def library(counter, text):
    return len(counter.tokenizer.encode(text, add_special_tokens=False).ids)


def test_token_counts_equal_the_library(counter, spark, sf_dir, odd):
    texts = ODD_TEXTS + [t for _, t in rows_of(documents(spark, sf_dir))]
    assert [int(t[-1]) for t in counter.prefix_counts(texts)] == [library(counter, t) for t in texts]
    found = token_counts(odd[0], keep=["doc_id"]).collect()
    assert sorted((r.row.doc_id or 0, r.found.n_tokens) for r in found) == sorted((i or 0, library(counter, t or "")) for i, t, *_ in odd[1])


def test_token_counts_of_another_vocabulary(spark, sf_dir, tmp_path):
    """Spaces belong to words there, and there is no normalizer."""
    import json

    import public_tokenizers

    other = PrefixCounter(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ODD_TEXTS + ["  two  spaces \n\n x", "\t\ttab 's", "12345 67"] + [t for _, t in rows_of(documents(spark, sf_dir))][:120]
    assert [int(t[-1]) for t in other.prefix_counts(texts)] == [library(other, t) for t in texts]
    found = token_counts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "byte_bpe_50k.json", limit=50, keep=["doc_id"]).collect()
    assert sorted((r.row.doc_id, r.found.n_tokens) for r in found) == [(i, library(other, t)) for i, t in enumerate(texts)]
    words_ = {w for t in texts[:40] for w in other.words(t)}
    for w in sorted(words_)[:80]:
        assert other.word_prefix_counts(w) == [library(other, w[:k]) for k in range(len(w) + 1)], w
    with open(public_tokenizers.path("byte_bpe_50k.json")) as f:
        spec = json.load(f)
    spec["pre_tokenizer"] = {"type": "Whitespace"}
    (tmp_path / "other.json").write_text(json.dumps(spec))
    with pytest.raises(ValueError):
        PrefixCounter(str(tmp_path / "other.json"))


def test_every_prefix_of_a_word(counter, spark, sf_dir):
    r = random.Random(2)
    some = r.sample([w for _, t in rows_of(documents(spark, sf_dir))[:50] for w in counter.words(t)], 60) + ["'re", "'ll", "'s", "!!!???", "日本語", "ééé"]
    for w in some:
        assert counter.word_prefix_counts(w) == [library(counter, w[:k]) for k in range(len(w) + 1)]


def test_cut_is_the_longest_prefix(counter):
    text = "Thnteron unbelievable things, done again and again"
    for budget in range(0, library(counter, text) + 2):
        k, chars = counter.cut(text, budget)
        w = counter.words(text)
        assert library(counter, " ".join([*w[:k], w[k][:chars] if k < len(w) else ""])) <= budget
        if k < len(w):
            assert library(counter, " ".join([*w[:k], w[k][: chars + 1]])) > budget


def test_fit_goes_into_the_next_word(counter, spark):
    texts = ["qzxj" * 2000, "some words and " + "zq" * 900 + " tail", "a b c", "", None, "unbelievable" * 40, "ab <|endoftext|> cd " * 9]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for limit in (3, 20):
        got = {r.row.doc_id: r.found for r in token_counts(docs, limit=limit, keep=["doc_id"]).collect()}
        assert {i: (f.fit_words, f.fit_chars) for i, f in got.items()} == {i: counter.cut(t or "", limit) for i, t in enumerate(texts)}
        for i in (0, 5):  # one word
            n, fits = got[i].fit_chars, [library(counter, texts[i][:k]) <= limit for k in range(min(len(texts[i]), 400) + 1)]
            assert got[i].fit_words == 0 and 0 < n == max(k for k, x in enumerate(fits) if x) < 400


# 5


def brute_targets(size, share=1.5, most=2, weights=(3, 1, 2)):
    names = sorted(size, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % 3] for k, s in enumerate(names)}
    total, full = share * sum(size.values()), set()
    while True:
        left = total - sum(most * size[s] for s in full)
        w = sum(weight[s] for s in names if s not in full)
        t = {s: most * size[s] if s in full else left * weight[s] / w for s in names}
        over = {s for s in names if s not in full and t[s] > most * size[s]}
        if not over:
            return t
        full |= over


def test_mixing(spark, sf_dir):
    docs = documents(spark, sf_dir)
    sizes = sized(docs).cache()
    got = {r.id: r for r in mix(sizes).apply(sizes).collect()}
    again = {r.id: r for r in mix(sizes).apply(sizes).collect()}
    size = defaultdict(int)
    for r in docs.collect():
        size[r.source] += len(words(r.text))
        assert got[r.doc_id].size == len(words(r.text)) and got[r.doc_id].taken in (0, got[r.doc_id].size, 2 * got[r.doc_id].size)
        assert got[r.doc_id].taken == again[r.doc_id].taken
    target, taken = brute_targets(size), defaultdict(int)
    for r in docs.select("doc_id", "source").collect():
        x = got[r.doc_id]
        taken[r.source] += x.taken
        assert x.source_size == size[r.source] and x.target == pytest.approx(target[r.source])
    assert all(abs(taken[s] - target[s]) <= 0.03 * target[s] for s in size)


def test_mixing_rates_meet_the_targets(spark):
    r = random.Random(4)
    rows = [(i, " ".join(["w"] * min(3000, int(r.paretovariate(0.9) * 20))), "en", r.choice("abcdefg")) for i in range(2000)]
    sizes = sized(table(spark, rows)).cache()
    out = mix(sizes).apply(sizes).select("id", "size", "rate", "target", "taken").collect()
    met, taken = defaultdict(float), defaultdict(int)
    for x in out:
        met[rows[x.id][3], x.target] += x.rate * x.size
        taken[rows[x.id][3], x.target] += x.taken
    assert all(v == pytest.approx(t, rel=1e-5) for (_, t), v in met.items())
    assert all(abs(v - t) < 0.005 * t for (_, t), v in taken.items())


def test_mixing_odd(spark, odd, empty):
    sizes = sized(odd[0]).cache()
    out = mix(sizes).apply(sizes).collect()
    assert len(out) == len(odd[1]) and all(x.taken <= 2 * x.size for x in out)
    none = sized(empty).cache()
    assert mix(none).apply(none).count() == 0


def test_mixing_tells_repeats_apart(spark):
    """50 rows of one id: with one text, with many, and without an id; each source comes near its target, however rows are dealt."""
    for ids in ([1] * 50, [None] * 50):
        for same in (True, False):
            rows = [(i, " ".join(["w"] * (999 if same else 700 + 13 * k) + ["x"]), "en", "a") for k, i in enumerate(ids)] + [(100 + k, " ".join(["v"] * (20 + k)), "en", "abc"[k % 3]) for k in range(300)]
            docs = table(spark, rows)
            out = []
            for n in (1, 5):
                sizes = sized(docs.repartition(n)).cache()
                out.append(sorted(((x.id or -1, x.size, x.source_size, x.target, x.taken) for x in mix(sizes).apply(sizes).collect())))
            assert out[0] == out[1] and len(out[0]) == len(rows)
            taken = defaultdict(int)
            for _, _, size, target, t in out[0]:
                taken[size, target] += t
            assert all(abs(t - target) <= 0.01 * target for (_, target), t in taken.items()), taken


# 6


def test_language_held_out(spark):
    docs = documents(spark, "/root/testdata/sf0.01")
    model = LI.learn(docs.where(~LI.held_out(F.col("doc_id"))))
    out = LI.language_id(docs, model, keep=["doc_id", "lang"]).where(LI.held_out(F.col("row.doc_id"))).collect()
    assert len(out) > 200 and sum(r.row.lang == r.found.lang for r in out) >= 0.97 * len(out)
    assert all(0 <= r.found.score <= 1 for r in out)


def test_language_mixtures(spark):
    docs = documents(spark, "/root/testdata/sf0.01").where("length(text) > 800").select("lang", "text")
    model = LI.learn(docs)
    first = {r.lang: r.text[:700] for r in docs.groupBy("lang").agg(F.first("text").alias("text")).collect()}
    both = spark.createDataFrame([(1, first["en"] + " " + first["de"]), (2, first["fr"])], "doc_id long, text string")
    got = {r.row.doc_id: r.found for r in LI.language_id(both, model).collect()}
    assert set(got[1].langs) == {"en", "de"} and got[2].langs == ["fr"]


@pytest.mark.parametrize("many", [4, 6])
def test_language_sets_of_more_than_three(spark, many):
    """A text in four of four languages, or five of six, has them all."""
    r = random.Random(many)
    alphabets = ["abcd", "efgh", "ijkl", "mnop", "qrst", "uvwx"][:many]
    say = lambda letters, n: " ".join("".join(r.choices(letters, k=r.randint(3, 8))) for _ in range(n))
    model = LI.learn(spark.createDataFrame([(x, say(x, 3000)) for x in alphabets], "lang string, text string"))
    said = alphabets[: min(many, 5)]
    rows = [(1, " ".join(say(x, 60) for x in said)), (2, say("abcd", 60)), (3, say("abcd", 60) + " " + say("efgh", 60))]
    got = {x.row.doc_id: x.found for x in LI.language_id(spark.createDataFrame(rows, "doc_id long, text string"), model, keep=["doc_id"]).collect()}
    assert sorted(got[1].langs) == said and abs(sum(got[1].shares) - 1) < 1e-6
    assert got[2].langs == ["abcd"] and sorted(got[3].langs) == ["abcd", "efgh"]


def plain_mixture(model, text):
    """EM and the penalised choice for one text, language by language, without arrays of texts."""
    import numpy as np
    import pyarrow as pa

    buckets, first, _, _ = LI._trigrams(pa.array([text]))
    log = model.word_scores(buckets, first).astype(float)
    like = [[math.exp(x - max(row)) + 1e-30 for x in row] for row in log]
    n = len(like)

    def fit(mix, rounds):
        for _ in range(rounds):
            new = [0.0] * len(mix)
            for row in like:
                whole = sum(m * x for m, x in zip(mix, row))
                for k, (m, x) in enumerate(zip(mix, row)):
                    new[k] += m * x / whole / n
            mix = new
        return mix, sum(math.log(sum(m * x for m, x in zip(mix, row))) for row in like)

    size = len(model.langs)
    full, total = fit([1 / size] * size, LI.ROUNDS)
    alone = [sum(math.log(row[k]) for row in like) for k in range(size)]
    first_ = int(np.argmax(alone))
    best, value = [float(k == first_) for k in range(size)], alone[first_]
    order = sorted(range(size), key=lambda k: (-full[k], k))
    for k in range(2, size + 1):
        mix = [full[j] + 1e-6 if j in order[:k] else 0.0 for j in range(size)]
        mix, reached = (full, total) if k == size else fit([m / sum(mix) for m in mix], LI.ROUNDS // 2)
        if reached - 0.5 * (k - 1) * math.log(n) > value:
            best, value = mix, reached - 0.5 * (k - 1) * math.log(n)
    return {model.langs[k]: m for k, m in enumerate(best) if m > 0}


def test_language_mixtures_equal_plain_em(spark, sf_dir):
    docs = documents(spark, sf_dir)
    model = LI.learn(docs)
    texts = [r.text for r in docs.where("text is not null").limit(400).collect()][::9]
    texts = [t for t in texts if any(c.isalpha() for c in t)][:30]
    texts += [texts[k][:400] + " " + texts[k + 7][:400] for k in range(12)]
    found = {r.row.doc_id: r.found for r in LI.language_id(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model, keep=["doc_id"]).collect()}
    for i, t in enumerate(texts):
        expected = plain_mixture(model, t)
        assert set(found[i].langs) == set(expected) and found[i].lang == max(expected, key=expected.get)
        assert dict(zip(found[i].langs, found[i].shares)) == pytest.approx(expected, abs=1e-4)


def test_language_odd(spark, odd, empty):
    model = LI.learn(odd[0])
    assert model.langs == ["en", "fr"]
    got = {(r.row.doc_id, r.found.lang) for r in LI.language_id(odd[0], model, keep=["doc_id"]).collect()}
    assert {(1, "und"), (2, "und"), (3, "und"), (7, "und"), (8, "fr")} <= got and (6, "en") in got
    assert LI.language_id(odd[0], LI.learn(empty), keep=["doc_id"]).where("found.lang <> 'und'").count() == 0


# 7


def brute_components(rows, alike):
    sets = {}
    for i, t in rows:
        w = words(t)
        sets[i] = {tuple(w[k : k + alike.words]) for k in range(max(1, len(w) - alike.words + 1))} if w else set()
    up = {i: i for i in sets}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                k = len(sets[a] & sets[b])
                if alike.enough(k, len(sets[a]), len(sets[b])) and top(a) != top(b):
                    up[max(top(a), top(b))] = min(top(a), top(b))
    return {i: (len(s), top(i)) for i, s in sets.items()}


def families(seed, groups=12, each=9, length=60):
    """Texts edited from bases, chains of edits, a passage that all share, copies."""
    r = random.Random(seed)
    passage = [f"shared{k}" for k in range(30)]
    rows = []
    for g in range(groups):
        base = [f"w{r.randint(0, 400)}" for _ in range(r.randint(3, length))]
        if g % 3 == 0:
            base += passage
        now = list(base)
        for _ in range(each):
            kind = r.random()
            if kind < 0.3:
                now = list(base)
            for _ in range(r.randint(0, 3)):
                now[r.randrange(len(now))] = f"x{r.randint(0, 10_000)}"
            rows.append((len(rows) * 3 + 1, " ".join(now).replace("w1", "W1")))
    r.shuffle(rows)
    return rows


SMALL = J.Tiling(members=5, whole=3, pivots=1)


@pytest.mark.parametrize(("alike", "tiling"), [(J.Alike(), J.Tiling()), (J.Alike(5, 80, 100), SMALL), (J.Alike(2, 60, 100), J.Tiling(members=3, whole=0, pivots=2)), (J.Alike(1, 50, 100), J.Tiling(bitmap_bytes=40, whole=2)), (J.Alike(1, 50, 100), J.Tiling())])
def test_ngram_join(spark, alike, tiling):
    rows = families(alike.words)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.id: (r.n_shingles, r.component_id) for r in J.ngram_join(docs, alike, tiling=tiling).collect()}
    assert got == brute_components(rows, alike)


@pytest.mark.parametrize("tiling", [J.Tiling(whole=0, pivots=0), J.Tiling(members=4, whole=0, pivots=0)])
def test_ngram_join_without_stars(spark, tiling):
    """All links come from the cells, of one block or of several."""
    rows, alike = families(9), J.Alike(2, 70, 100)
    assert {r.id: (r.n_shingles, r.component_id) for r in J.ngram_join(spark.createDataFrame(rows, "doc_id long, text string"), alike, tiling=tiling).collect()} == brute_components(rows, alike)


def test_ngram_join_large_tiles(spark):
    """A passage that all texts share, a cluster of near copies beyond a block, and blocks read over many batches."""
    r = random.Random(3)
    passage, base = [f"p{k}" for k in range(40)], [f"b{k}" for k in range(60)]
    rows = []
    for k in range(240):
        w = list(base) if k % 2 else passage + [f"u{r.randint(0, 9000)}" for _ in range(r.randint(5, 30))]
        for _ in range(r.randint(0, 2)):
            w[r.randrange(len(w))] = f"x{r.randint(0, 9000)}"
        rows.append((k, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    expected = brute_components(rows, J.Alike(4, 85, 100))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        for tiling in (J.Tiling(), J.Tiling(members=16, whole=4, pivots=2)):
            assert {x.id: (x.n_shingles, x.component_id) for x in J.ngram_join(docs, tiling=tiling).collect()} == expected
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_ngram_join_takes_rows_for_documents(spark):
    """One id on different texts, and classes without an id, lose no links."""
    base = [f"w{k}" for k in range(100)]
    chain = [" ".join(base[:k] + [f"x{j}" for j in range(k)] + base[k:]) for k in (0,)] + [" ".join([*base[:50], "y", *base[50:]]), " ".join([*base[:50], "y", *base[50:90], "z", *base[90:]])]
    docs = spark.createDataFrame([(7, chain[0]), (7, "quite another text of some words"), (None, chain[1]), (3, chain[2]), (9, "quite another text of some words")], "doc_id long, text string")
    got = sorted(((r.id, r.component_id) for r in J.ngram_join(docs).collect()), key=str)
    assert got == sorted([(7, 3), (7, 7), (None, 3), (3, 3), (9, 7)], key=str)


def test_ngram_join_odd(spark, odd, empty):
    got = {(r.id, r.n_shingles, r.component_id) for r in J.ngram_join(odd[0]).collect()}
    assert {(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (5, 1, 4), (7, 1, 7), (None, 1, 4)} <= got
    assert J.ngram_join(odd[0]).count() == len(odd[1]) and J.ngram_join(empty).count() == 0


def test_bitmaps_bound_the_overlap():
    import numpy as np

    r = np.random.default_rng(3)
    for _ in range(200):
        n = int(r.integers(1, 900))
        a = np.unique(r.integers(0, 1 << 63, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[: int(r.integers(0, len(a) + 1))], r.integers(0, 1 << 63, int(r.integers(1, 600)), dtype=np.uint64)]))
        x, y = J.bitmap(a), J.bitmap(b)
        while len(x) != len(y):
            x, y = (J.fold(x), y) if len(x) > len(y) else (x, J.fold(y))
        apart = int(np.bitwise_count(x ^ y).sum())
        assert (len(a) + len(b) - apart) // 2 >= len(np.intersect1d(a, b))


def test_components(spark):
    r = random.Random(8)
    edges = [(i, i + 1) for i in range(100, 160)] + [(r.randint(200, 400), r.randint(200, 400)) for _ in range(150)] + [(500, k) for k in range(501, 560)]
    edges = [(min(e), max(e)) for e in edges if e[0] != e[1]]
    up = {v: v for e in edges for v in e}
    for _ in range(len(up)):
        for a, b in edges:
            up[a] = up[b] = min(up[a], up[b])
    assert {x.v: x.c for x in components(spark.createDataFrame(edges, "a long, b long")).collect()} == up


@pytest.mark.parametrize("order", ["shuffled", "falling"])
def test_components_of_long_paths(spark, order):
    """Paths whose labels would cross a link a round: shuffled ids, and ids that fall towards one end with the least at the other."""
    n = 3000
    ids = random.Random(4).sample(range(n), n) if order == "shuffled" else [0, *range(n - 1, 0, -1)]
    edges = [(min(e), max(e)) for e in zip(ids, ids[1:])]
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert sorted(x.v for x in got) == list(range(n)) and {x.c for x in got} == {0}


def test_components_raises_at_its_bound(spark):
    edges = spark.createDataFrame([(0, 9), (9, 8), (8, 1), (1, 7), (7, 2)], "a long, b long")
    with pytest.raises(RuntimeError):
        components(edges, most_rounds=1)


# 8


def brute_hits(docs, bench, span=10):
    items = [(str(i), words(t, ALNUM)) for i, t in bench]
    windows = {(tuple(w[k : k + min(span, len(w))]), i) for i, w in items if w for k in range(max(1, len(w) - span + 1))}
    by = defaultdict(set)
    for w, i in windows:
        by[w].add(i)
    out = {}
    for d, t in docs:
        w, hit, found = words(t, ALNUM), set(), set()
        for n in {len(x) for x in by}:
            for k in range(len(w) - n + 1):
                if (own := tuple(w[k : k + n])) in by:
                    found |= by[own]
                    hit |= set(range(k, k + n))
        out[d] = (len(w), len(hit), sorted(found))
    return out


@pytest.mark.parametrize("block", [D.BLOCK_BYTES, 600])
def test_decontamination(spark, block):
    r = random.Random(6)
    bench = [(k, " ".join(f"b{r.randint(0, 60)}" for _ in range(r.choice([3, 5, 9, 10, 11, 14, 30])))) for k in range(25)] + [(90, None), (91, ""), (92, "...")]
    docs = []
    for d in range(60):
        w = [f"b{r.randint(0, 60)}" if r.random() < 0.5 else f"z{r.randint(0, 9)}" for _ in range(r.randint(0, 60))]
        for _ in range(r.randint(0, 3)):
            own = (r.choice(bench)[1] or "").split()
            at = r.randint(0, len(w))
            w[at:at] = own[: r.randint(0, len(own))]
        docs.append((d, "-".join(w).upper()))
    docs.append((60, None))
    got = D.decontaminate(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(bench, "item_id long, text string"), keep=["doc_id"], block_bytes=block)
    got = {x.row.doc_id: x.found for x in got.collect()}
    assert {i: (f.n_words, f.n_hit, f["items"]) for i, f in got.items()} == brute_hits(docs, bench)
    for f in got.values():
        assert all(a.last + 1 < b.first for a, b in zip(f.spans, f.spans[1:])) and sum(x.last - x.first + 1 for x in f.spans) == f.n_hit


@pytest.mark.parametrize("block", [D.BLOCK_BYTES, 0])
def test_decontamination_odd(spark, odd, empty, block):
    none = spark.createDataFrame([], "item_id long, text string")
    assert D.decontaminate(odd[0], none, block_bytes=block).where("found.n_hit > 0").count() == 0
    bench = spark.createDataFrame([(1, "same text here"), (2, None), (2, "same text here")], "item_id long, text string")
    out = D.decontaminate(odd[0], bench, keep=["doc_id"], block_bytes=block).where("found.n_hit > 0").collect()
    assert sorted(x.row.doc_id or 0 for x in out) == [0, 4, 5, 5] and {x.found.n_hit for x in out} == {3}
    assert D.decontaminate(empty, bench).count() == 0


# 9


@pytest.mark.parametrize("block", [3, 8192])
def test_exact_dedup(spark, block, odd):
    r = random.Random(7)
    texts = ["", "a", "aa", "aaa", "aab", "aaaaaaa", "aaabaaa", "é", None, "aaaaaaaaaaaaaaaaaaaaaaa", "aaaaaaaaaaaaaaaaaaaaaab"]
    rows = [(i, r.choice(texts)) for i in range(200)]
    got = {x.id: x for x in exact_dedup(spark.createDataFrame(rows, "doc_id long, text string"), block=block).collect()}
    for i, t in rows:
        same = [j for j, u in rows if (u or "") == (t or "")]
        assert (got[i].keep_id, got[i].group_size, got[i].kept, got[i].text_sha256) == (max(same), len(same), i == max(same), hashlib.sha256((t or "").encode()).hexdigest())


def test_block_names_are_the_datas_own(spark):
    from quillon.llm.exact_dedup import block_names

    r = random.Random(9)
    rows = [(i, "".join(r.choice("ab") for _ in range(r.randint(0, 12)))) for i in range(120)]
    docs = spark.createDataFrame(rows, "id long, t string").selectExpr("id", "octet_length(t) n", "xxhash64(t) h", "cast(t as binary) raw").selectExpr("id", "cast(n as long) n", "h", "raw")
    names = [{x.id: x.name for x in block_names(docs.repartition(k), block=3).collect()} for k in (1, 5)]
    assert names[0] == names[1] and len({(len(t), names[0][i]) for i, t in rows}) == len({t for _, t in rows})


def test_exact_dedup_odd(odd, empty):
    got = sorted((x.id or 0, x.keep_id, x.group_size, x.kept) for x in exact_dedup(odd[0]).collect())
    assert got == sorted([(1, 2, 2, False), (2, 2, 2, True), (3, 3, 1, True), (4, 5, 4, False), (5, 5, 4, True), (5, 5, 4, True), (0, 5, 4, False), (6, 6, 1, True), (7, 7, 1, True), (8, 8, 1, True)])
    assert exact_dedup(empty).count() == 0


# 10


def test_escapes_round_trip():
    r = random.Random(10)
    for _ in range(2000):
        t = "".join(r.choice(["<", "|", "\\", ">", "a", "<|turn|>", "<|end|>", "é"]) for _ in range(r.randint(0, 9)))
        assert unescape(escape(t)) == t and "<|" not in escape(t)
        turns = [("user", t), ("assistant", t), (t, "x")]
        assert parse(render(turns)[0]) == turns


def test_chat_format(spark):
    r = random.Random(11)
    pieces = ["Hello, world", " leading", "trailing ", "\n", "<|end|>", "<\\|end|>", "日本語\U0001f600", "!!!", "", "...<", "|>"]
    rows = [(c, t, r.choice(["user", "assistant", "system", None]), r.choice([None, "".join(r.choice(pieces) for _ in range(4))])) for c in range(40) for t in range(r.randint(1, 6))]
    out = chat_format(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {x.conv_id: x for x in read_back(out).collect()}
    for c in got:
        own = [(a or "", b or "") for i, _, a, b in rows if i == c]
        loss = "".join(b for a, b in own if a == "assistant")
        whole = "".join(f"{a}\n{b}\n" for a, b in own)
        assert (got[c].n_turns, got[c].turns_sha256) == (len(own), hashlib.sha256(whole.encode()).hexdigest())
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert len(got) == 40


def test_offsets_equal_the_library():
    """Tokens and offsets by ranks are those of the same vocabulary's other file."""
    from quillon.llm import chat_format as C

    r = random.Random(12)
    pieces = ["Hello, world", " leading", "trailing ", "\n\n", "<\\|end|>", "日本語\U0001f600", "é", "!!!", "123", "...<", "don't", "<|turn|>", "<|text|>", "<|end|>", "<|endoftext"]
    one, two = C.tokenizer_of("byte_bpe_50k.tiktoken"), C.tokenizer_of("byte_bpe_50k.json")
    for text in ["", "é", *("".join(r.choices(pieces, k=r.randint(1, 12))) for _ in range(300))]:
        a, b = one.encode(text), two.encode(text)
        assert all(list(x) == list(y) for x, y in zip(a[1:], b[1:], strict=True)) and [i for i in a[0] if i < 50256] == [i for i in b[0] if i < 50256], text


@pytest.mark.parametrize("tokenizer", ["byte_bpe_50k.tiktoken", "byte_bpe_50k.json"])
def test_chat_format_odd(spark, tokenizer):
    """Repeated rows, equal and null turn numbers, null ids, clashing names, a long conversation."""
    said = "<|end|>\\### Assistant: </turn> é" * 3
    rows = [(1, 0, "user", "a"), (1, 0, "user", "a"), (1, None, "assistant", "first"), (1, 1, "assistant", "b"), (1, 1, "assistant", "a"), (None, 0, "assistant", said), (2, 0, "assistant", ""), (2, 1, None, None)]
    rows += [(3, k, "assistant" if k % 2 else "user", f"turn {k} {said}") for k in range(3000)]
    docs = spark.createDataFrame([(*x, "x", "y", "z") for x in rows], "conv_id long, turn long, role string, text string, turns string, formatted string, TEXT string")
    got = {x.conv_id: x for x in read_back(chat_format(docs, tokenizer)).collect()}
    assert len(got) == 4
    for c in got:
        own = sorted(((t is not None, t or 0, a or "", b or "") for i, t, a, b in rows if i == c))
        loss, whole = "".join(b for *_, a, b in own if a == "assistant"), "".join(f"{a}\n{b}\n" for *_, a, b in own)
        assert (got[c].n_turns, got[c].turns_sha256) == (len(own), hashlib.sha256(whole.encode()).hexdigest())
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_empty_tables(spark, empty):
    assert LS.license_scan(empty).count() == 0
    assert shard_documents(empty, shards=4).count() == 0
    assert token_counts(empty).count() == 0
    assert lm_score.score(empty, lm_score.train(empty), ["doc_id"]).count() == 0
    assert chat_format(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


@pytest.mark.parametrize("name", Q.oracle_sql())
def test_queries_equal_sql(spark, sf_dir, name):
    import os

    import duckdb

    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{sf_dir}/{f}')")
    df = Q.queries()[name](spark, sf_dir)
    cursor = con.execute(Q.oracle_sql()[name])
    at = [[c[0] for c in cursor.description].index(c) for c in df.columns]
    got, expected = sorted((tuple(r) for r in df.collect()), key=repr), sorted((tuple(r[i] for i in at) for r in cursor.fetchall()), key=repr)
    assert got == expected and len(got) > 0
