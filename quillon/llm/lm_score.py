"""Language-model scores from a log-frequency Bloom filter.

The counts c of words and of pairs of words are quantised to levels 1 + floor(log(c) / log(GROWTH)). An n-gram with level
q enters the filter as the q events (n-gram, 1) to (n-gram, q); its level is found again by probing for event after event
until one is absent. The probability of a word after another is smoothed: the pair's count, plus MU times the word's own
probability, over the first word's count plus MU. Pairs take the lower and contexts the upper end of a level, so a
context's probabilities don't exceed 1 but for the filter's rare false positives.

The filter lies in segments by n-gram hash, one for about SEGMENT_TEXT bytes of text, each built by one task from what all
tasks counted; nothing is pruned. Up to
BROADCAST_BYTES all segments go to every worker. A larger filter stays where it is, and the probes go to it: the same
segments, the same scores (score_routed). The distinct n-grams of about CHUNK_BYTES of text go together, one row for each
segment, and a segment looks up all that it is asked at once.

The base score needs exact counts. The words with the greatest counts, HEAD at most, go to every worker; all others are
joined by hash, and none of them can be frequent. Words are identified by 64-bit hashes.

Defined results: null counts as an empty text, which is one end token; repeated rows each give a row; without training
rows all counts are 0.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkernel as K
from .common import map_text, plain, release, slices, small_batches, stash

GROWTH = 1.5
MU = 400.0
HASHES = 4
BITS = 8.0
HEAD = 1 << 20
BROADCAST_BYTES = 160 << 20
#: Bytes of training text for each segment, about.
SEGMENT_TEXT = 16 << 20
#: Bytes of text whose probes go to the segments together; a longer text comes alone.
CHUNK_BYTES = 4 << 20
#: n-grams in a batch of probes, so that their bytes stay far below what four bytes reach.
PROBED = 1 << 23
#: Tokens that a task counts at most before it sends, so that a count fits four bytes.
COUNTED = 1 << 31
#: n-grams that a task holds before it merges and, beyond twice as many, sends them on.
HELD = 2_000_000

END = np.uint64(0x2545F4914F6CDD1D)
_PAIR = np.uint64(0xD6E8FEB86659FD93)
_LEVEL = np.uint64(0xA0761D6478BD642F)
WORDS, PAIRS = 1, 2


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of each text and its end, and the texts' offsets in them."""
    hashes, at = K.words(texts, K.NOT_SPACE)
    n = len(texts)
    out = np.full(len(hashes) + n, END, np.uint64)
    out[np.arange(len(hashes)) + np.repeat(np.arange(n), np.diff(at))] = hashes
    return out, at + np.arange(n + 1)


def pairs(words: np.ndarray) -> np.ndarray:
    """Each word with the one before it; before the first of a text stands an end."""
    before = np.empty_like(words)
    before[:1] = END
    before[1:] = words[:-1]
    return K.mix(K.mix(before + _PAIR) + words)


def _merge(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return keys, counts
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts, first)


def _counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """_merge of keys that count once each."""
    keys = np.sort(keys)
    first = np.flatnonzero(np.concatenate([[len(keys) > 0], keys[1:] != keys[:-1]])[: len(keys)])
    return keys[first], np.diff(first, append=len(keys))


def levels(counts: np.ndarray) -> np.ndarray:
    return (1 + np.floor(np.log(counts) / math.log(GROWTH) + 1e-9)).astype(np.int64)


def _places(keys: np.ndarray, level: int, size: np.ndarray | int) -> list[np.ndarray]:
    """Where the event's HASHES bits lie among size bits."""
    a = K.mix(keys + np.uint64(int(_LEVEL) * level & 0xFFFFFFFFFFFFFFFF))
    step = (a >> np.uint64(32)) | np.uint64(1)
    size = np.uint64(size) if isinstance(size, int) else size
    return [((((a + np.uint64(k) * step) & np.uint64(0xFFFFFFFF)) * size) >> np.uint64(32)).astype(np.int64) for k in range(HASHES)]


def build_segment(keys: np.ndarray, counts: np.ndarray, bits_each: float = BITS) -> bytes:
    q = levels(counts)
    size = max(64, int(math.ceil(bits_each * q.sum())))
    if size > 1 << 32:
        raise OverflowError(f"a segment of {len(keys)} n-grams has more bits than its places reach")
    bits = np.zeros(-(-size // 8) * 8, bool)
    for level in range(1, int(q.max(initial=0)) + 1):
        for p in _places(keys[q >= level], level, size):
            bits[p] = True
    return size.to_bytes(8, "little") + np.packbits(bits, bitorder="little").tobytes()


def segment_of(keys: np.ndarray, segments: int) -> np.ndarray:
    return (keys >> np.uint64(65 - segments.bit_length())).astype(np.int64) if segments > 1 else np.zeros(len(keys), np.int64)


def by_segment(keys: np.ndarray, segments: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """The segments that sorted keys occur in, and the keys of each; as much work as there are keys, however many segments there are."""
    own = segment_of(keys, segments)
    edge = np.flatnonzero(np.concatenate([[len(own) > 0], own[1:] != own[:-1]]))
    return own[edge], np.split(keys, edge[1:])[: len(edge)]


class LogFilter:
    """Segments of the filter for one kind of n-gram: lengths of their blobs, to be filled. Those without are empty."""

    def __init__(self, lengths: dict[int, int], segments: int):
        self.segments = segments
        held = np.array([max(16, lengths.get(s, 0)) - 8 for s in range(segments)], np.int64)
        self.start = np.concatenate([[0], np.cumsum(held)[:-1]]) * 8
        self.sizes = np.full(segments, 64, np.uint64)
        self.bits = np.zeros(int(held.sum()), np.uint8)

    def fill(self, segment: int, blob: bytes) -> LogFilter:
        at = self.start[segment] // 8
        self.sizes[segment] = int.from_bytes(blob[:8], "little")
        self.bits[at : at + len(blob) - 8] = np.frombuffer(blob, np.uint8, offset=8)
        return self

    def level(self, keys: np.ndarray) -> np.ndarray:
        out, own = np.zeros(len(keys), np.int64), segment_of(keys, self.segments)
        size, start, left, level = self.sizes[own], self.start[own], np.arange(len(keys)), 1
        while len(keys):
            a = K.mix(keys + np.uint64(int(_LEVEL) * level & 0xFFFFFFFFFFFFFFFF))
            step = (a >> np.uint64(32)) | np.uint64(1)
            some = np.flatnonzero(self._set(a, size, start))  # the first bit tells most of those that are absent
            a, step, size, start = a[some], step[some], size[some], start[some]
            present = np.ones(len(some), np.uint8)
            for _ in range(1, HASHES):
                a += step
                present &= self._set(a, size, start)
            yes = np.flatnonzero(present)
            some, size, start = some[yes], size[yes], start[yes]
            keys, left = keys[some], left[some]
            out[left] = level
            level += 1
        return out

    def _set(self, hashes: np.ndarray, size: np.ndarray, start: np.ndarray) -> np.ndarray:
        """The bits, 0 or 1, at the places of hashes (as _places has them)."""
        p = (((hashes & np.uint64(0xFFFFFFFF)) * size) >> np.uint64(32)).view(np.int64) + start
        return (self.bits[p >> 3] >> (p & 7).astype(np.uint8)) & 1


def count_ngrams(texts: DataFrame, segments: int) -> DataFrame:
    """texts: one string column. kind, seg, keys (sorted uint64), counts (uint32): what each task has counted."""

    def run(batches):
        held: dict[int, list] = {WORDS: [], PAIRS: []}
        size, counted = {WORDS: 0, PAIRS: 0}, {WORDS: 0, PAIRS: 0}

        def merged(kind):
            k, c = _merge(np.concatenate([x for x, _ in held[kind]]), np.concatenate([y for _, y in held[kind]]))
            held[kind], size[kind] = [(k, c)], len(k)

        def sent(kind):
            if not held[kind]:
                return
            merged(kind)
            k, c = held[kind].pop()
            size[kind] = counted[kind] = 0
            own = segment_of(k, segments)
            edge = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1], [True]])).tolist()
            for lo in range(0, len(edge) - 1, 64):
                ends = list(zip(edge[lo : lo + 64], edge[lo + 1 : lo + 65], strict=False))
                columns = [pa.array([kind] * len(ends), pa.int32()), pa.array([int(own[x]) for x, _ in ends], pa.int32()), pa.array([k[x:y].tobytes() for x, y in ends], pa.binary()), pa.array([c[x:y].astype(np.uint32).tobytes() for x, y in ends], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["kind", "seg", "keys", "counts"])

        for batch in batches:
            for lo, hi in slices(batch.column(0)):
                w, _ = tokens(batch.column(0).slice(lo, hi - lo))
                for kind, grams in ((WORDS, w), (PAIRS, pairs(w))):
                    held[kind].append(_counted(grams))
                    size[kind] += len(held[kind][-1][0])
                    counted[kind] += len(grams)
                    if size[kind] > HELD or counted[kind] > COUNTED:
                        merged(kind)
                        if size[kind] > HELD * 2 // 3 or counted[kind] > COUNTED:
                            yield from sent(kind)
        for kind in held:
            yield from sent(kind)
        release()

    return texts.mapInArrow(run, "kind int, seg int, keys binary, counts binary")


def _build(bits_each: float):
    def build(table: pa.Table) -> pa.Table:
        kind, seg = table["kind"][0].as_py(), table["seg"][0].as_py()
        keys, counts = _merge(np.concatenate([np.frombuffer(x.as_buffer(), np.uint64) for x in table["keys"]]), np.concatenate([np.frombuffer(x.as_buffer(), np.uint32).astype(np.int64) for x in table["counts"]]))
        words = kind == WORDS
        low = np.floor(GROWTH ** (levels(counts) - 1.0) + 1e-6)
        row = {"kind": kind, "seg": seg, "n": len(keys), "total": int(counts.sum()), "low": float(low.sum()), "keys": keys.tobytes() if words else None, "counts": counts.tobytes() if words else None, "filter": build_segment(keys, counts, bits_each)}
        return pa.Table.from_pylist([row], schema=pa.schema([("kind", pa.int32()), ("seg", pa.int32()), ("n", pa.int64()), ("total", pa.int64()), ("low", pa.float64()), ("keys", pa.binary()), ("counts", pa.binary()), ("filter", pa.binary())]))

    return build


@dataclass
class Model:
    segments: DataFrame  # kind, seg, n, total, low, keys, counts, filter
    n_segments: int
    n_tokens: int
    n_types: int
    low_sum: float  # of the words' counts at the lower end of their levels
    filter_bytes: int

    def counts(self) -> DataFrame:
        """h, c: exact counts of the words."""

        def run(batches):
            for batch in batches:
                for keys, counts in zip(batch.column(0), batch.column(1), strict=True):
                    yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(keys.as_buffer(), np.int64)), pa.array(np.frombuffer(counts.as_buffer(), np.int64))], names=["h", "c"])

        return self.segments.where(F.col("kind") == WORDS).select("keys", "counts").mapInArrow(run, "h long, c long")

    def filters(self) -> list[LogFilter]:
        """The filters for words and pairs, filled segment by segment, so that the driver holds them once."""
        sizes = {(r.kind, r.seg): r.n for r in self.segments.select("kind", "seg", F.octet_length("filter").alias("n")).collect()}
        out = [LogFilter({s: n for (k, s), n in sizes.items() if k == kind}, self.n_segments) for kind in (WORDS, PAIRS)]
        for r in self.segments.select("kind", "seg", "filter").toLocalIterator(prefetchPartitions=False):
            out[r.kind - 1].fill(r.seg, r["filter"])
        return out


def train(docs: DataFrame, text: str = "text", bits_each: float = BITS) -> Model:
    """bits_each: of the filter for each event; more bits, fewer false positives."""
    docs = plain(docs)
    small_batches(docs.sparkSession)
    raw = docs.select(F.coalesce(docs[f"`{text}`"].cast("string"), F.lit("")).alias("t"))
    n_bytes = raw.agg(F.sum(F.octet_length("t").cast("long"))).first()[0] or 0
    segments = 1 << max(4, (n_bytes // SEGMENT_TEXT).bit_length())
    schema = "kind int, seg int, n long, total long, low double, keys binary, counts binary, filter binary"
    built = stash(count_ngrams(raw, segments).groupBy("kind", "seg").applyInArrow(_build(bits_each), schema), "filter")
    sums = {r.kind: r for r in built.groupBy("kind").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.sum("low").alias("low"), F.sum(F.octet_length("filter")).alias("size")).collect()}
    w = sums.get(WORDS)
    return Model(built, segments, w.total if w else 0, w.n if w else 0, w.low if w else 0.0, sum(r.size for r in sums.values()))


def _log_prob(word: np.ndarray, context: np.ndarray, pair: np.ndarray, n: float, types: int, mu: float) -> np.ndarray:
    """log10 of the smoothed probability, from levels."""
    q = np.arange(1 + max(int(x.max(initial=0)) for x in (word, context, pair)))
    low = np.where(q > 0, np.floor(GROWTH ** (q - 1.0) + 1e-6), 0.0)  # by level: there are few, and many n-grams
    alone = (low + 1) / (n + types + 1)
    up = np.where(q > 0, np.ceil(GROWTH ** q.astype(float)), 0.0)[context]
    return np.log10(np.minimum(1.0, (np.minimum(low[pair], np.maximum(up, 1)) + mu * alone[word]) / (up + mu)))


def _distinct_levels(f: LogFilter, keys: np.ndarray) -> np.ndarray:
    some, back = np.unique(keys, return_inverse=True)
    return f.level(some)[back]


FOUND = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("n_known", T.LongType()), T.StructField("base", T.DoubleType()), T.StructField("score", T.DoubleType()), T.StructField("tail", T.ArrayType(T.LongType())), T.StructField("tf", T.ArrayType(T.LongType()))])
#: Beside them, where probes go to the segments: the text, and which chunk of its task it is in.
ROUTED = T.StructType([*FOUND, T.StructField("chunk", T.LongType()), T.StructField("t", T.StringType())])


def _head(counts: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and counts of the words with the greatest counts, sorted by hash; at most `most`, ties in or out together."""
    kinds = counts.groupBy("c").agg(F.count("*").alias("n")).orderBy(F.desc("c"))
    held, least = 0, None
    for row in kinds.limit(most).toLocalIterator():
        if held + row.n > most:
            break
        held, least = held + row.n, row.c
    if least is None:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    t = counts.where(F.col("c") >= least).toArrow()
    h, c = t["h"].to_numpy().view(np.uint64), t["c"].to_numpy()
    order = np.argsort(h)
    return h[order], c[order]


def _blobs(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Binary values, one for values up to each of the ends."""
    offsets = np.concatenate([[0], ends]) * values.itemsize
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def _values(blobs: pa.ChunkedArray, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """All values of a column of binary values, one after another, and how many each has."""
    parts, lengths = [np.empty(0, kind)], [np.empty(0, np.int64)]
    for x in blobs.chunks:
        if len(x):
            at = np.frombuffer(x.buffers()[1], np.int32)[x.offset : x.offset + len(x) + 1].astype(np.int64)
            parts.append(np.frombuffer(x.buffers()[2], np.uint8)[at[0] : at[-1]].view(kind) if at[-1] > at[0] else np.empty(0, kind))
            lengths.append(np.diff(at) // np.dtype(kind).itemsize)
    return np.concatenate(parts), np.concatenate(lengths)


def _levels_at_segments(rows: DataFrame, model: Model, text: str) -> DataFrame:
    """rows: rid, chunk, text. chunk, sub, kind, seg, levels (a byte for each distinct key of the run of rows in that segment, sorted): the probes go to the segments.

    A run is what one task reads of a chunk in a row, all of it but where a file is read in parts; sub is its first rid.
    """
    n = model.n_segments

    def asked(chunk, sub, texts):
        w, _ = tokens(pa.concat_arrays(texts))
        for kind, keys in ((WORDS, _counted(w)[0]), (PAIRS, _counted(pairs(w))[0])):  # np.unique is many times slower: it hashes
            own = segment_of(keys, n)
            ends = np.append(np.flatnonzero(own[1:] != own[:-1]) + 1, len(keys))
            lo = 0
            while lo < len(ends):
                at = ends[lo - 1] if lo else 0
                hi = max(lo + 1, int(np.searchsorted(ends, at + PROBED, side="right")))
                some = hi - lo
                yield pa.RecordBatch.from_arrays([pa.array(np.full(some, chunk)), pa.array(np.full(some, sub)), pa.array(np.full(some, kind, np.int32)), pa.array(own[ends[lo:hi] - 1].astype(np.int32)), _blobs(keys[at : ends[hi - 1]], ends[lo:hi] - at)], names=["chunk", "sub", "kind", "seg", "keys"])
                lo = hi

    def ask(batches):
        texts, chunk, sub, last = [], None, None, None
        for batch in batches:
            rids, chunks = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for lo, hi in _runs(rids, chunks):
                if texts and (chunks[lo] != chunk or rids[lo] != last + 1):
                    yield from asked(chunk, sub, texts)
                    texts = []
                if not texts:
                    chunk, sub = chunks[lo], rids[lo]
                texts.append(batch.column(2).slice(lo, hi - lo))
                last = rids[hi - 1]
        if texts:
            yield from asked(chunk, sub, texts)
        release()

    def answer(asked: pa.Table, parts: pa.Table) -> pa.Table:
        blob = parts["filter"][0].as_py() if parts.num_rows else bytes(16)
        keys, lengths = _values(asked["keys"], np.uint64)
        levels_ = _distinct_levels(LogFilter({0: len(blob)}, 1).fill(0, blob), keys).astype(np.uint8)
        return asked.select(["chunk", "sub", "kind", "seg"]).append_column("levels", _blobs(levels_, np.cumsum(lengths)))

    asks = rows.select("rid", "chunk", F.coalesce(rows[text], F.lit("")).alias("t")).mapInArrow(ask, "chunk long, sub long, kind int, seg int, keys binary")
    return asks.groupBy("kind", "seg").cogroup(model.segments.select("kind", "seg", "filter").groupBy("kind", "seg")).applyInArrow(answer, "chunk long, sub long, kind int, seg int, levels binary")


def _runs(rids: np.ndarray, chunks: np.ndarray) -> list[tuple[int, int]]:
    """Rows that follow each other in one chunk."""
    edge = np.flatnonzero(np.concatenate([[True], (chunks[1:] != chunks[:-1]) | (rids[1:] != rids[:-1] + 1), [True]]))
    return list(zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)) if len(rids) else []


def score_routed(rows: DataFrame, model: Model, text: str, mu: float = MU) -> DataFrame:
    """rows: rid, chunk, text, stashed. rid and score, by a filter that no worker holds whole."""
    low_sum, types = model.low_sum, model.n_types

    def join(texts: pa.Table, got: pa.Table) -> pa.Table:
        if not texts.num_rows:
            return pa.table({"rid": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        got = got.sort_by([("sub", "ascending"), ("kind", "ascending"), ("seg", "ascending")])
        known, lengths = _values(got["levels"], np.uint8)
        ends, sub, kind = np.cumsum(lengths), got["sub"].to_numpy(), got["kind"].to_numpy()
        last = np.flatnonzero(np.append((sub[1:] != sub[:-1]) | (kind[1:] != kind[:-1]), True))  # words and pairs of each run
        parts = np.split(known.astype(np.int64), ends[last[:-1]])
        texts = texts.sort_by("rid")
        rid, t = texts["rid"].to_numpy(), texts["t"].combine_chunks()
        starts = np.append(np.searchsorted(rid, sub[last[::2]]), len(rid))
        out = []
        for i, (lo, hi) in enumerate(zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)):
            w, at = tokens(t.slice(lo, hi - lo))
            some, back = np.unique(w, return_inverse=True)
            word = parts[2 * i][back]
            context = np.concatenate([parts[2 * i][np.searchsorted(some, [END])], word[:-1]])
            _, back = np.unique(pairs(w), return_inverse=True)
            out.append(np.add.reduceat(_log_prob(word, context, parts[2 * i + 1][back], low_sum, types, mu), at[:-1]))
        return pa.table({"rid": texts["rid"], "score": pa.array(np.concatenate(out))})

    texts = rows.select("rid", "chunk", F.coalesce(rows[text], F.lit("")).alias("t"))
    return texts.groupBy("chunk").cogroup(_levels_at_segments(rows, model, text).groupBy("chunk")).applyInArrow(join, "rid long, score double")


def score(docs: DataFrame, model: Model, keep: list[str], text: str = "text", head: int = HEAD, broadcast_bytes: int = BROADCAST_BYTES, mu: float = MU) -> DataFrame:
    """row (struct of the columns keep), n_tokens, n_known, base_score and score."""
    docs, spark = plain(docs), docs.sparkSession
    counts = stash(model.counts(), "counts")
    routed = model.filter_bytes > broadcast_bytes
    filters = None if routed else model.filters()
    hs, cs = _head(counts, head)
    known = filters[WORDS - 1].level(hs).astype(np.uint8) if filters else None  # words of the head are looked up once, not in each slice
    shared = spark.sparkContext.broadcast((hs, cs, known, filters))
    n, types, low_sum = model.n_tokens, model.n_types, model.low_sum
    below = float(n + types + 1)
    ready: dict[str, object] = {}
    chunk = [0, 0]  # number, bytes

    def kernel(texts: pa.Array, _):
        if not ready:
            ready["head"], ready["known"], filters = shared.value[:2], *shared.value[2:]
            if filters is not None:
                ready["words"], ready["pairs"] = filters
        w, at = tokens(texts)
        some, back = np.unique(w, return_inverse=True)
        hs, cs = ready["head"]
        place = np.minimum(np.searchsorted(hs, some), max(0, len(hs) - 1))
        in_head = hs[place] == some if len(hs) else np.zeros(len(some), bool)
        c = np.zeros(len(some), np.int64)
        c[in_head] = cs[place[in_head]]
        base, here = np.where(c > 0, np.log10((c + 1) / below), 0.0)[back], (c > 0)[back]
        out = {"n_tokens": pa.array(np.diff(at), pa.int64()), "n_known": pa.array(np.add.reduceat(here.astype(np.int64), at[:-1]), pa.int64()), "base": pa.array(np.add.reduceat(base, at[:-1]))}
        if "words" in ready:
            level = np.zeros(len(some), np.int64)
            level[in_head] = ready["known"][place[in_head]]
            level[~in_head] = ready["words"].level(some[~in_head])
            word = level[back]
            context = np.empty_like(word)
            context[1:] = word[:-1]
            context[:1] = ready["words"].level(np.array([END]))
            logs = _log_prob(word, context, _distinct_levels(ready["pairs"], pairs(w)), low_sum, types, mu)
            out["score"] = pa.array(np.add.reduceat(logs, at[:-1]))
        else:
            out["score"] = pa.nulls(len(texts), pa.float64())
        tail = np.flatnonzero(~here)
        of, rare = np.searchsorted(at, tail, side="right") - 1, w[tail]
        order = np.lexsort((rare, of))
        of, rare = of[order], rare[order]
        first = np.flatnonzero(np.concatenate([[len(rare) > 0], (rare[1:] != rare[:-1]) | (of[1:] != of[:-1])])[: len(rare)])
        ends = np.searchsorted(of[first], np.arange(len(at)))
        out["tail"], out["tf"] = K.lists(rare[first].view(np.int64), ends, pa.int64()), K.lists(np.diff(first, append=len(rare)), ends, pa.int64())
        if routed:
            size = len(K.text_bytes(texts)[0])
            if chunk[1] and chunk[1] + size > CHUNK_BYTES:
                chunk[:] = chunk[0] + 1, 0
            chunk[1] += size
            out["chunk"], out["t"] = pa.array(np.full(len(texts), chunk[0])), texts
        return out

    found = map_text(docs, text, keep, kernel, ROUTED if routed else FOUND).select(F.monotonically_increasing_id().alias("rid"), "row", "found.*")
    if routed:  # a rid has its partition from bit 33 on
        found = found.withColumn("chunk", F.shiftleft(F.shiftright("rid", 33), 33) + F.col("chunk"))
    scored = stash(found, "scored")
    rare = scored.select("rid", F.inline(F.arrays_zip("tail", "tf")).alias("h", "tf"))
    c = F.coalesce("c", F.lit(0))
    sums = rare.join(counts, "h", "left").groupBy("rid").agg(F.sum(F.when(c > 0, F.col("tf")).otherwise(0)).alias("more"), F.sum(F.col("tf") * F.log10((c + 1) / F.lit(below))).alias("base_more"))
    out = scored.drop("tail", "tf", "chunk", "t").join(sums, "rid", "left")
    if routed:
        out = out.drop("score").join(score_routed(scored, model, "t", mu), "rid")
    return out.select("row", "n_tokens", (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"), (F.col("base") + F.coalesce("base_more", F.lit(0.0))).alias("base_score"), "score")
