"""Benchmark decontamination by winnowing.

Of every SPAN consecutive words, the least hash of GRAM consecutive words is kept, in benchmark items and in documents
alike. Two texts that share SPAN words keep the same fingerprint there, so every shared span of at least SPAN words has
a common fingerprint. Where a document's fingerprint is one of the benchmark's, the hit is extended to the SPAN words
around it and compared whole. Items of fewer words than SPAN keep one fingerprint, of all their words.

Defined results: a null or empty text has no words and no hits; items without words are never found; repeated rows each
give a row; an empty benchmark finds nothing. A benchmark of at most BLOCK_BYTES of text is held by every worker. A larger
one stays a table of windows: workers hold a set of common.PICK_BITS bits of its fingerprints, find the documents' places
that may be hits, and these places are joined with the distinct windows by hash; documents without such a place aren't shuffled. A
document's distinct windows are then joined with the items that have them, so places aren't multiplied by the items that share one;
a window that very many places have is a skewed key of a join of one row a window, which Spark splits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkernel as K
from .common import PICK_BITS, is_picked, map_text, picked, plain, stash

SPAN = 10
GRAM = 5
BLOCK_BYTES = 16 << 20

FOUND = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("spans", T.ArrayType(T.StructType([T.StructField("first", T.IntegerType()), T.StructField("last", T.IntegerType())]))),
        T.StructField("items", T.ArrayType(T.StringType())),
    ]
)


def _least(hashes: np.ndarray, span: int, gram: int) -> np.ndarray:
    """For every span consecutive words the least hash of gram words."""
    g = K.grams(hashes, gram)
    size = max(0, len(hashes) - span + 1)
    out = g[:size].copy()
    for k in range(1, span - gram + 1):
        np.minimum(out, g[k : k + size], out=out)
    return out


def _known(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Which values are in a sorted table."""
    if not len(table):
        return np.zeros(len(values), bool)
    return table[np.minimum(np.searchsorted(table, values), len(table) - 1)] == values


class BenchmarkIndex:
    """Fingerprints and windows of items; arrays only, so that it pickles small."""

    def __init__(self, items: list[tuple[str, str]], span: int, gram: int):
        self.span, self.gram, self.ids = span, gram, [str(i) for i, _ in items]
        hashes, at = K.words(pa.array([t for _, t in items], pa.string()), K.ALNUM)
        prints, windows, by_length = [], [], {}
        for k in range(len(items)):
            h = hashes[at[k] : at[k + 1]]
            if len(h) >= span:
                prints.append(_least(h, span, gram))
                windows.append((K.grams(h, span), k))
            elif len(h):
                by_length.setdefault(len(h), []).append((K.grams(h, len(h)), k))
        self.prints = np.unique(np.concatenate(prints)) if prints else np.empty(0, np.uint64)
        self.tables = {n: self._table(w) for n, w in ({span: windows} | by_length).items() if w}

    @staticmethod
    def _table(windows: list[tuple[np.ndarray, int]]) -> tuple[np.ndarray, np.ndarray]:
        """(hash, item) pairs, sorted and distinct."""
        h = np.concatenate([w for w, _ in windows])
        k = np.concatenate([np.full(len(w), i, np.int64) for w, i in windows])
        order = np.lexsort((k, h))
        h, k = h[order], k[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (k[1:] != k[:-1])
        return h[new], k[new]

    def hits(self, hashes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, length, window hash) of all places where a window of an item stands."""
        starts, lengths, values = [], [], []
        for n, (table, _) in self.tables.items():
            if len(hashes) < n:
                continue
            if n == self.span:
                least = _least(hashes, n, self.gram)
                change = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))  # a fingerprint is kept once for the windows that share it
                known = np.repeat(_known(least[change], self.prints), np.diff(np.append(change, len(least))))
                places = np.flatnonzero(known)
                if not len(places):
                    continue
                g = hashes[places] + np.uint64(n)
                for k in range(1, n):
                    g = K.mix(g) + hashes[places + k]
                g = K.mix(g)
            else:
                places, g = np.arange(len(hashes) - n + 1), K.grams(hashes, n)
            inside = at[np.searchsorted(at, places, side="right")] >= places + n  # not across documents
            good = inside & _known(g, table)
            starts.append(places[good])
            lengths.append(np.full(int(good.sum()), n))
            values.append(g[good])
        if not starts:
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
        return np.concatenate(starts), np.concatenate(lengths), np.concatenate(values)

    def items(self, lengths: np.ndarray, values: np.ndarray) -> list[str]:
        found: set[int] = set()
        for n, (table, owner) in self.tables.items():
            v = np.unique(values[lengths == n])
            lo, hi = np.searchsorted(table, v), np.searchsorted(table, v, side="right")
            for a, b in zip(lo, hi, strict=True):
                found.update(owner[a:b].tolist())
        return sorted({self.ids[k] for k in found})


def _kernel(index: BenchmarkIndex):
    span_type = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))

    def run(texts: pa.Array, _):
        hashes, at = K.words(texts, K.ALNUM)
        starts, lengths, values = index.hits(hashes, at)
        doc = np.searchsorted(at, starts, side="right") - 1
        spans: list[list[dict]] = [[] for _ in range(len(texts))]
        items: list[list[str]] = [[] for _ in range(len(texts))]
        for d in np.unique(doc).tolist():
            own = np.flatnonzero(doc == d)
            items[d] = index.items(lengths[own], values[own])
            s = starts[own] - at[d]
            e = s + lengths[own]
            order = np.argsort(s, kind="stable")
            s, reach = s[order], np.maximum.accumulate(e[order])
            cut = np.flatnonzero(np.concatenate([[True], s[1:] > reach[:-1]]))
            spans[d] = [{"first": a, "last": b - 1} for a, b in zip(s[cut].tolist(), reach[np.append(cut[1:], len(s)) - 1].tolist(), strict=True)]
        return {"n_words": pa.array(np.diff(at), pa.int64()), "spans": pa.array(spans, span_type), "items": pa.array(items, pa.list_(pa.string()))}

    return run


def _pick(prints: np.ndarray, n: int) -> np.ndarray:
    """The bit of fingerprints of windows of n words."""
    return (K.mix(prints + np.uint64(n)) >> np.uint64(64 - PICK_BITS)).astype(np.int64) + 1


def _windows(span: int, gram: int):
    """item, text: n (words of the window), h (its hash), k (its fingerprint's bit), item."""

    def run(batches):
        for batch in batches:
            hashes, at = K.words(batch.column(1), K.ALNUM)
            for i, item in enumerate(batch.column(0).to_pylist()):
                own = hashes[at[i] : at[i + 1]]
                n = min(span, len(own))
                if n:
                    h = K.grams(own, n)
                    k = _pick(_least(own, span, gram) if n == span else h, n)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), n, np.int32)), pa.array(h.view(np.int64)), pa.array(k), pa.array([item] * len(h), pa.string())], names=["n", "h", "k", "item"])

    return run


def _places(bits, lengths: list[int], span: int, gram: int):
    """Of each text the places (first, n, h) of windows whose fingerprint's bit is set."""
    kind = pa.struct([("first", pa.int32()), ("n", pa.int32()), ("h", pa.int64())])

    def run(texts: pa.Array, _):
        hashes, at = K.words(texts, K.ALNUM)
        firsts, sizes, values = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.uint64)]
        for n in lengths:
            if len(hashes) < n:
                continue
            prints = _least(hashes, span, gram) if n == span else K.grams(hashes, n)
            places = np.flatnonzero(is_picked(bits.value, _pick(prints, n)))
            places = places[at[np.searchsorted(at, places, side="right")] >= places + n]  # not across documents
            h = hashes[places] + np.uint64(n)
            for k in range(1, n):
                h = K.mix(h) + hashes[places + k]
            firsts.append(places), sizes.append(np.full(len(places), n)), values.append(K.mix(h))
        first, size, h = (np.concatenate(x) for x in (firsts, sizes, values))
        order = np.argsort(first, kind="stable")
        first, size, h = first[order], size[order], h[order]
        doc = np.searchsorted(at, first, side="right") - 1
        own = pa.StructArray.from_arrays([pa.array((first - at[doc]).astype(np.int32)), pa.array(size.astype(np.int32)), pa.array(h.view(np.int64))], fields=list(kind))
        return {"n_words": pa.array(np.diff(at), pa.int64()), "places": pa.ListArray.from_arrays(pa.array(np.searchsorted(first, at).astype(np.int32)), own)}

    return run


PLACES = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("places", T.ArrayType(T.StructType([T.StructField("first", T.IntegerType()), T.StructField("n", T.IntegerType()), T.StructField("h", T.LongType())])))])


def _joined(spans):
    """Sorted spans, those that overlap or touch as one."""
    last = lambda done: F.element_at(done, -1)
    longer = lambda done, s: F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(F.struct(last(done)["first"].alias("first"), F.greatest(last(done)["last"], s["last"]).alias("last"))))
    return F.aggregate(spans, F.slice(spans, 1, 0), lambda done, s: F.when((F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["last"] + 1 >= s["first"]), longer(done, s)).otherwise(F.concat(done, F.array(s))))


def _by_join(docs: DataFrame, source: DataFrame, keep: list[str], text: str, span: int, gram: int) -> DataFrame:
    """row and found for a benchmark of any size."""
    windows = stash(source.mapInArrow(_windows(span, gram), "n int, h long, k long, item string").distinct(), "windows")
    lengths = sorted(r.n for r in windows.select("n").distinct().collect())  # at most span
    bits = docs.sparkSession.sparkContext.broadcast(picked(windows.select("k")))
    placed = map_text(docs, text, keep, _places(bits, lengths, span, gram), PLACES)
    some = stash(placed.where(F.size("found.places") > 0).select(F.monotonically_increasing_id().alias("rid"), "row", "found"), "places")
    places = stash(some.select("rid", F.inline("found.places")).join(windows.select("n", "h").distinct(), ["n", "h"]), "hits")
    one = F.struct(F.col("first"), (F.col("first") + F.col("n") - 1).cast("int").alias("last"))
    spans = places.groupBy("rid").agg(F.array_sort(F.collect_set(one)).alias("spans")).withColumn("spans", _joined(F.col("spans")))
    owned = places.select("rid", "n", "h").distinct().join(windows.select("n", "h", "item"), ["n", "h"])
    hits = spans.join(owned.groupBy("rid").agg(F.array_sort(F.collect_set("item")).alias("items")), "rid")
    kind = FOUND["spans"].dataType.simpleString()
    none = F.struct(F.col("found.n_words"), F.array().cast(kind).alias("spans"), F.array().cast("array<string>").alias("items")).alias("found")
    clean = placed.where(F.size("found.places") == 0).select("row", none)
    found = F.struct(F.col("found.n_words"), F.coalesce("spans", F.array().cast(kind)).alias("spans"), F.coalesce("items", F.array().cast("array<string>")).alias("items")).alias("found")
    return clean.unionByName(some.join(hits, "rid", "left").select("row", found))


def _covered(spans):
    """Words inside any of possibly overlapping spans."""
    sorted_ = F.array_sort(spans)
    zero = F.struct(F.lit(0).alias("n"), F.lit(-1).alias("end"))
    return F.aggregate(sorted_, zero, lambda a, s: F.struct((a.n + F.greatest(F.lit(0), s.last - F.greatest(a.end + 1, s.first) + 1)).alias("n"), F.greatest(a.end, s.last).alias("end")), lambda a: a.n.cast("long"))


def decontaminate(docs: DataFrame, bench: DataFrame, keep: list[str] | None = None, text: str = "text", item: str = "item_id", item_text: str = "text", span: int = SPAN, gram: int = GRAM, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of docs: row (struct of the columns keep) and found (n_words, n_hit, spans of hit words, items)."""
    docs, bench = plain(docs), plain(bench)
    keep = keep or docs.columns
    source = bench.select(bench[f"`{item}`"].cast("string").alias("i"), F.coalesce(bench[f"`{item_text}`"], F.lit("")).alias("t"))
    n_bytes = source.agg(F.sum(F.octet_length("t") + 16)).first()[0] or 0
    if n_bytes <= block_bytes:
        merged = map_text(docs, text, keep, _kernel(BenchmarkIndex([tuple(r) for r in source.collect()], span, gram)), FOUND)
    else:
        merged = _by_join(docs, source, keep, text, span, gram)
    return merged.select("row", F.struct(F.col("found.n_words").alias("n_words"), _covered(F.col("found.spans")).alias("n_hit"), F.col("found.spans").alias("spans"), F.col("found.items").alias("items")).alias("found"))
