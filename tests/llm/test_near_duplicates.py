"""Op7 on texts of one template, and which row near duplicates leave."""

import random

import numpy as np
import pytest

from quillon.llm import ngram_join as J


def template(n, own=1, words=33):
    """n texts of one template with words of their own in its middle: with one of 33, 4 of 30 shingles are a text's own, too many for a link."""
    common = [f"common{i}" for i in range(words)]
    return [(i, " ".join(common[: words // 2] + [f"own{i}x{k}" for k in range(own)] + common[words // 2 + own :])) for i in range(n)]


def counted(monkeypatch):
    pairs, plain = [], J.links_of
    monkeypatch.setattr(J, "links_of", lambda docs, p, *rest: (pairs.append(p.count()), plain(docs, p, *rest))[1])
    return pairs


def test_template_texts_make_few_pairs(spark, monkeypatch):
    pairs = counted(monkeypatch)
    found = []
    for n in (1000, 4000):
        pairs.clear()
        rows = J.ngram_join(spark.createDataFrame(template(n), "doc_id long, text string")).collect()
        assert all(r.n_shingles == 30 and r.component_id == r.id for r in rows) and len(rows) == n
        found.append(sum(pairs))
    assert found[1] <= 5 * found[0] + 50 and found[0] < 1000


def test_linked_template_texts_stay_linked(spark, monkeypatch):
    """With one own word of 60 all are linked: 53 of 61 shingles; a text of another size in between, too."""
    pairs = counted(monkeypatch)
    rows = [*template(500, words=61), (500, template(1, words=61)[0][1] + " more"), (501, "nothing of this kind at all")]
    got = {r.id: r.component_id for r in J.ngram_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {**dict.fromkeys(range(501), 0), 501: 501} and sum(pairs) < 5 * 501


def test_reach_is_the_largest_alike_size():
    rng = random.Random(1)
    for alike in (J.Alike(), J.Alike(5, 80, 100), J.Alike(1, 50, 100)):
        for _ in range(300):
            n = rng.randrange(1, 90)
            place = rng.randrange(alike.prefix(n))
            assert alike.reach(n, place) == max((m for m in range(0, 300) if alike.enough(n - place, n, m) and m >= n - place), default=alike.reach(n, place))


def test_tiles_cut_by_reach_over_batches_and_blocks():
    """Whatever batches and blocks rows come in, every pair that can be alike by its places is in a tile or in two blocks of one."""
    rng = np.random.default_rng(7)
    alike = J.Alike(4, 70, 100)
    rows = sorted((int(t), (int(n) << J.PLACE_BITS) | int(rng.integers(alike.prefix(int(n)))), r) for r, (t, n) in enumerate(zip(rng.integers(0, 3, 400), rng.integers(5, 60, 400), strict=True)))
    token, packed, rep = (np.array(c, np.int64) for c in zip(*rows, strict=True))
    n, place = packed >> J.PLACE_BITS, packed & ((1 << J.PLACE_BITS) - 1)
    reach = alike.reach(n, place)
    for step in (7, 50, 400):
        for tiling in (J.Tiling(), J.Tiling(members=6)):
            batches = [J.pa.RecordBatch.from_arrays([J.pa.array(c[k : k + step]) for c in (token, packed, rep)], names=["token", "n", "rep"]) for k in range(0, len(rep), step)]
            together = {}
            for b in J._tiles(alike, tiling)(iter(batches)):
                for tile, members in zip(b["tile"].to_pylist(), b["members"].to_pylist(), strict=True):
                    together.setdefault(tile, set()).update(members)
            for t in range(3):
                of = np.flatnonzero(token == t)
                for x in of.tolist():
                    for y in of[of > x].tolist():
                        if n[y] <= reach[x] and n[x] <= reach[y]:
                            assert any({int(rep[x]), int(rep[y])} <= m for m in together.values())


@pytest.mark.parametrize("tied", [True, False])
def test_the_row_that_stays_is_the_same_however_rows_are_dealt(spark, tied):
    """Rows with one id and text differ in source; or texts of one component repeat the least id."""
    text = " ".join(f"word{i}" for i in range(40))
    rows = [(3, text if tied else text + f" {i % 5}", None, f"s{(7 * i) % 40:02}", {"k": i % 3}) for i in range(40)] + [(9, text, "en", "z", {}), (10, None, "en", "z", {})]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, extra map<string,long>")
    kept = [sorted(((r.doc_id, r.text, r.source) for r in J.distinct_documents(df.repartition(n), J.Alike(5, 80, 100)).collect()), key=str) for n in (1, 3, 7)]
    assert kept[0] == kept[1] == kept[2] and len(kept[0]) == 2
    if tied:
        assert (3, text, "s00") in kept[0]
