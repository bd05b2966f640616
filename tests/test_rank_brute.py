"""Rankers against a brute force in plain Python, over documents as reviews."""

import math
import re
from collections import Counter, defaultdict

import pytest

from quillon.operators.rank import language_model, product_search, vector_space
from quillon.plans.index import build
from quillon.sources.reviews import from_documents

QUERIES = [["the", "of", "worthless"], ["The", "of", "the"], ["the", "notaword"], ["adoci", "anelle", "le"], ["notaword"]]


@pytest.fixture(scope="module")
def corpus(spark, sf_dir):
    reviews = from_documents(spark, sf_dir).cache()
    rows = reviews.collect()
    words = {r.review_id: re.findall("[a-z0-9]+", r.text) for r in rows}
    return build(reviews), {r.review_id: r for r in rows}, words, {i: Counter(w) for i, w in words.items()}


def totals(tfs):
    df, cf = Counter(), Counter()
    for c in tfs.values():
        df.update(c.keys())
        cf.update(c)
    return df, cf


@pytest.mark.parametrize("query", QUERIES)
def test_vector_space(corpus, query):
    index, _, words, tfs = corpus
    df, _ = totals(tfs)
    q = Counter(w.lower() for w in query)
    w = {t: (1 + math.log10(n)) * (math.log10(len(words) / df[t]) if df[t] else 0) for t, n in q.items()}
    norm = math.sqrt(sum(x * x for x in w.values()))
    scores = {i: sum((1 + math.log10(c[t])) * w[t] / norm for t in sorted(q) if c[t]) for i, c in tfs.items() if any(c[t] for t in q)}
    best = sorted(((s, i) for i, s in scores.items()), key=lambda x: (-x[0], x[1]))[:10]
    got = vector_space(index, query, 10).collect()
    assert [r.review_id for r in got] == [i for _, i in best]
    assert [r.score for r in got] == pytest.approx([s for s, _ in best], abs=2e-9)


def language(corpus, query, lam):
    _, _, words, tfs = corpus
    _, cf = totals(tfs)
    n = sum(map(len, words.values()))
    out = {}
    for i, c in tfs.items():
        if any(c[t.lower()] for t in query):
            p = 1.0
            for t in query:
                p *= lam * c[t.lower()] / len(words[i]) + (1.0 - lam) * cf[t.lower()] / n
            out[i] = p
    return sorted(out.items(), key=lambda x: (-x[1], x[0]))


@pytest.mark.parametrize("query", QUERIES)
@pytest.mark.parametrize("lam", [0.0, 0.5, 1.0])
def test_language_model(corpus, query, lam):
    best = language(corpus, query, lam)[:7]
    got = language_model(corpus[0], query, lam, 7).collect()
    assert [r.review_id for r in got] == [i for i, _ in best]
    assert [r.score for r in got] == pytest.approx([s for _, s in best], rel=1e-12)


@pytest.mark.parametrize("query", QUERIES[:3])
def test_product_search(corpus, query):
    index, rows, words, _ = corpus
    per = Counter(r.product_id for r in rows.values())
    total = defaultdict(float)
    for i, _ in sorted(language(corpus, query, 0.5)[:12]):
        r = rows[i]
        total[r.product_id] += 0.5 * (r.score // 5) + 0.3 * (r.helpful_num / r.helpful_den if r.helpful_den else 0) + 0.2 * (per[r.product_id] // len(rows))
    best = [(p, round(s, 9)) for p, s in sorted(total.items(), key=lambda x: (-x[1], x[0]))[:3]]
    assert [tuple(r) for r in product_search(index, query, 3).collect()] == best
