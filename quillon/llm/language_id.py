"""Language identification by multilingual mixtures.

Learning counts the byte trigrams of letters in each language, over all labelled training rows, in BUCKETS hash buckets.
A text is a mixture: each word is drawn from one language, with the probability of its trigrams there; expectation-
maximisation estimates the proportions. Of the sets of its 1, 2, ... likeliest languages, up to all, the one with the greatest
penalised likelihood (BIC) is chosen; the language with the largest proportion in it is the prediction.

Defined results: a null text or one without a letter is `und` with score 0; nulls in the label are not learned from;
without any label all texts are `und`. More than MOST_LANGS labels are an error, so what the driver gets and what is broadcast,
BUCKETS numbers a language, is bounded. Texts are read whole.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkernel as K
from .common import map_text, plain, release, slices, small_batches, stash, unstash

BUCKETS = 1 << 16
SMOOTH = 0.2
ROUNDS = 12
UNKNOWN = "und"
#: Labels that a model can have: 64 MiB of BUCKETS numbers of four bytes each.
MOST_LANGS = 256
#: Distinct (label, bucket) counts that a task holds before it sends them on.
HELD = 1 << 20

_ASCII = np.zeros(256, bool)
_ASCII[65:91] = _ASCII[97:123] = True
_LETTER = _ASCII.copy()
_LETTER[128:] = True
#: Letters in lower case, all else as a space.
_FOLD = np.where(_LETTER, np.arange(256), 32).astype(np.uint32)
_FOLD[65:91] += 32


def _trigrams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the trigram around each letter; where words start in them; words' offsets by text; whether a text has a letter."""
    data, offsets = K.text_bytes(texts)
    n = len(texts)
    spaced = np.full(len(data) + n + 1, 32, np.uint32)  # a space before each text and one at the end
    at = np.arange(len(data)) + np.repeat(np.arange(1, n + 1), np.diff(offsets))
    spaced[at] = _FOLD[data]
    middle = np.flatnonzero(spaced != 32)
    code = (spaced[middle - 1] << np.uint32(16)) | (spaced[middle] << np.uint32(8)) | spaced[middle + 1]
    buckets = ((code.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)).astype(np.int64)
    first = np.flatnonzero(spaced[middle - 1] == 32)
    words = np.searchsorted(middle[first], offsets + np.arange(n + 1))
    has = np.diff(np.searchsorted(np.flatnonzero(_ASCII[data]), offsets)) > 0
    for k in np.flatnonzero(~has & (np.diff(words) > 0)).tolist():
        has[k] = any(c.isalpha() for c in texts[k].as_py())
    return buckets, first, words, has


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray  # BUCKETS x languages, log probabilities

    def word_scores(self, buckets: np.ndarray, first: np.ndarray) -> np.ndarray:
        return np.add.reduceat(self.table[buckets], first, axis=0)

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray, list[list[str]], list[list[float]]]:
        n, size = len(texts), len(self.langs)
        names, scores, sets, shares = [UNKNOWN] * n, np.zeros(n), [[] for _ in range(n)], [[] for _ in range(n)]
        buckets, first, words, has = _trigrams(texts)
        rows = np.flatnonzero(has)
        if not len(rows) or not size:
            return names, scores, sets, shares
        log = self.word_scores(buckets, first)
        counts = np.diff(words)[rows]
        use = np.repeat(has, np.diff(words))
        log = log[use]
        start = np.concatenate([[0], np.cumsum(counts)[:-1]])
        doc = np.repeat(np.arange(len(rows)), counts)
        like = np.exp(log - log.max(axis=1, keepdims=True)) + 1e-30

        def fit(mix: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
            for _ in range(rounds):
                part = mix[doc] * like
                part /= part.sum(axis=1, keepdims=True)
                mix = np.add.reduceat(part, start, axis=0) / counts[:, None]
            return mix, np.add.reduceat(np.log((mix[doc] * like).sum(axis=1)), start)

        alone = np.add.reduceat(np.log(like), start, axis=0)
        full, total = fit(np.full((len(rows), size), 1 / size), ROUNDS)
        best = np.zeros_like(full)
        best[np.arange(len(rows)), alone.argmax(axis=1)] = 1
        value = alone.max(axis=1)
        order = np.argsort(-full, axis=1, kind="stable")
        # no mixture's likelihood exceeds that of full by more than its steepest slope to a language allows
        slope = np.add.reduceat(like / (full[doc] * like).sum(axis=1, keepdims=True), start, axis=0) / counts[:, None]
        most = total + counts * np.log(np.maximum(slope.max(axis=1), 1))
        for k in range(2, size + 1):
            if not (most - 0.5 * (k - 1) * np.log(counts) > value).any():
                break
            if k == size:
                mix, reached = full, total
            else:
                held = np.zeros_like(full)
                np.put_along_axis(held, order[:, :k], 1, axis=1)
                mix = (full + 1e-6) * held
                mix, reached = fit(mix / mix.sum(axis=1, keepdims=True), ROUNDS // 2)
            reached = reached - 0.5 * (k - 1) * np.log(counts)
            better = reached > value
            value = np.where(better, reached, value)
            best[better] = mix[better]
        top = best.argmax(axis=1)
        sure = (best[np.arange(len(rows)), top] * counts + 1) / (counts + size)
        for i, r in enumerate(rows.tolist()):
            names[r] = self.langs[top[i]]
            own = [j for j in order[i].tolist() if best[i, j] > 0]
            sets[r] = [self.langs[j] for j in own]
            shares[r] = [float(best[i, j]) for j in own]
        scores[rows] = np.minimum(sure, 1.0)
        return names, scores, sets, shares


def learn(labelled: DataFrame, text: str = "text", lang: str = "lang", buckets: int = BUCKETS) -> Model:
    """Counts over all rows of labelled, kept and sent sparsely; the driver gets buckets numbers a language at most."""
    labelled = plain(labelled)
    small_batches(labelled.sparkSession)
    rows = labelled.where(labelled[f"`{lang}`"].isNotNull()).select(labelled[f"`{lang}`"].cast("string").alias("lang"), F.coalesce(labelled[f"`{text}`"].cast("string"), F.lit("")).alias("text"))

    def count(batches):
        place: dict[str, int] = {}
        keys, counts, fresh, waiting = np.empty(0, np.int64), np.empty(0, np.int64), [], 0

        def merged():
            every = np.concatenate([keys, *[k for k, _ in fresh]])
            some, back = np.unique(every, return_inverse=True)
            return some, np.bincount(back, weights=np.concatenate([counts, *[c for _, c in fresh]]), minlength=len(some)).astype(np.int64)

        def sent():
            names = pa.array(list(place), pa.string())
            for lo in range(0, len(keys), 1 << 16):
                part = slice(lo, lo + (1 << 16))
                yield pa.RecordBatch.from_arrays([names.take(pa.array(keys[part] // buckets)), pa.array(keys[part] % buckets), pa.array(counts[part])], names=["lang", "bucket", "n"])

        for batch in batches:
            for lo, hi in slices(batch.column(1)):
                texts, names = batch.column(1).slice(lo, hi - lo), batch.column(0).slice(lo, hi - lo)
                own, first, words, _ = _trigrams(texts)
                coded = pc.dictionary_encode(names)
                at = np.array([place.setdefault(x, len(place)) for x in coded.dictionary.to_pylist()], np.int64)
                letters = np.repeat(at[coded.indices.to_numpy()], np.diff(np.append(first, len(own))[words]))
                fresh.append(np.unique(letters * buckets + own, return_counts=True))
                waiting += len(fresh[-1][0])
                if waiting > HELD:
                    (keys, counts), fresh, waiting = merged(), [], 0
                    if len(keys) > HELD:
                        yield from sent()
                        place, keys, counts = {}, keys[:0], counts[:0]
        keys, counts = merged()
        yield from sent()
        release()

    found = stash(rows.mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")), "trigrams")
    many = found.select("lang").distinct().count()
    if many > MOST_LANGS:
        raise ValueError(f"learn: {many} labels in {lang}, at most {MOST_LANGS} are allowed")
    counts = found.toArrow()
    unstash(found)
    langs = sorted(pc.unique(counts["lang"]).to_pylist())
    table = np.full((buckets, len(langs)), SMOOTH)
    if langs:
        at = pc.index_in(counts["lang"], value_set=pa.array(langs)).to_numpy()
        table[counts["bucket"].to_numpy(), at] += counts["n"].to_numpy()
    return Model(langs, np.log(table / table.sum(axis=0)).astype(np.float32))


FOUND = T.StructType([T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("langs", T.ArrayType(T.StringType())), T.StructField("shares", T.ArrayType(T.DoubleType()))])


def language_id(docs: DataFrame, model: Model, keep: list[str] | None = None, text: str = "text") -> DataFrame:
    """row (struct of the columns keep) and found: lang, score, and the chosen set with its proportions."""

    docs = plain(docs)

    def kernel(texts: pa.Array, _):
        names, scores, sets, shares = model.predict(texts)
        return {"lang": pa.array(names, pa.string()), "score": pa.array(scores, pa.float64()), "langs": pa.array(sets, pa.list_(pa.string())), "shares": pa.array(shares, pa.list_(pa.float64()))}

    return map_text(docs, text, keep or docs.columns, kernel, FOUND)


def held_out(id_col: Column) -> Column:
    """Rows that nothing is learned from: crc32 of the id as text is 2 modulo 4."""
    return F.coalesce(F.crc32(id_col.cast("string")) % 4 == 2, F.lit(False))
