"""N-gram Jaccard join: all links between documents whose sets of word shingles are at least NUM/DEN alike.

Equal sets become one class first. Two alike sets share one of the first n - ceil(n * NUM / DEN) + 1 shingles of each, by
any fixed order of shingles. The order is by frequency level, then by hash: one pass over the texts counts all shingles
into 2 ** LEVEL_BITS buckets, and a bucket's level tells by which power of two it stands out from the mean. So what many
texts share comes last, by a threshold that is relative to the corpus, and one sketch of each text suffices.

The classes that share a shingle of their prefixes are a tile, sorted by size. Where that shingle is the first that two of
them have in common, at places p and q, they share at most the lesser of n - p and m - q shingles; so its place says up to
what size a class can find an alike one there, and tiles are cut where no class before reaches the next size. Texts of one
template that differ in a few words of their own, too few for a link, thus leave nothing of the tile that the template's
first shingle makes. Equal tiles are worked on once. A tile is dealt in blocks of at most Tiling.members classes and bitmap_bytes of
bitmaps, and pairs of blocks whose sizes may meet are cells: no task holds more than a cell. Each class has a parity bitmap
with twice as many bits as it has shingles, to a power of two, and LEAST_BITS at least; the number of bits in which two bitmaps differ bounds the symmetric
difference from below, and so the overlap from above. Pairs that pass are decided by intersecting the sorted arrays.

Pairs of alike classes are not all listed. Stars come first: within each block, classes are paired with pivots, those with
the most neighbours, or nearest to the majority of bits; the links among these pairs join classes into components. Then
come the cells of the tiles in which pairs are left: only pairs of different components are tried, so thousands of near
copies cost about as many pairs as there are copies, and no link between components is lost.

Defined results: rows are the documents, so rows that repeat an id with the same text are copies, and with another text are
documents of their own; null and empty texts have no shingles and no links; a text of fewer words than a shingle has one,
of all its words; a component is named by the least id that isn't null among its rows, and has null if there is none.
Broadcast are a byte for each bucket of shingles, common.PICK_BITS bits and, to drop rows, 2 ** BUCKET_BITS numbers; the driver
gets these and nothing that grows.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkernel as K
from .common import is_picked, map_text, pick_key, picked, plain, release, slices, small_batches, stash, unstash
from .components import components

LEAST_BITS, MOST_BITS = 256, 1 << 16
#: Low bits of a packed size that hold a shingle's place in its class's order; further places count as the last.
PLACE_BITS = 24
LEVEL_BITS, PART_BITS = 20, 14
BUCKET_BITS = 20


@dataclass(frozen=True)
class Alike:
    words: int = 4
    num: int = 85
    den: int = 100

    def prefix(self, n: int) -> int:
        return n - -(-n * self.num // self.den) + 1

    def reach(self, n, place):
        """The largest set that one of n shingles can be alike, if the first that both have is at place of the n."""
        return (n - place) * (self.den + self.num) // self.num - n

    def enough(self, overlap, a, b):
        return self.den * overlap >= self.num * (a + b - overlap)


@dataclass(frozen=True)
class Tiling:
    """What a task holds of a tile. None of it changes results."""

    members: int = 1 << 14
    bitmap_bytes: int = 8 << 20
    whole: int = 64  # blocks of so many classes are compared pair by pair before pivots are chosen
    pivots: int = 8


def shingle_sets(texts: pa.Array, words: int) -> list[np.ndarray]:
    """For each text its distinct shingles, sorted."""
    hashes, at = K.words(texts, K.NOT_SPACE)
    g = K.grams(hashes, words)
    out = []
    for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if hi - lo >= words:
            out.append(np.unique(g[lo : hi - words + 1]))
        else:
            out.append(K.grams(hashes[lo:hi], hi - lo) if hi > lo else np.empty(0, np.uint64))
    return out


def bitmap_bits(n):
    """Bits of the bitmap of n shingles: rises with n, by powers of two."""
    return min(MOST_BITS, max(LEAST_BITS, 2 << (n - 1).bit_length()))


def bitmap(shingles: np.ndarray) -> np.ndarray:
    """Parities of the shingles by bucket, as 64-bit words."""
    bits = bitmap_bits(len(shingles))
    at = (K.mix(shingles) >> np.uint64(65 - bits.bit_length())).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=bits) & 1).astype(np.uint8), bitorder="little").view(np.uint64)


def fold(maps: np.ndarray) -> np.ndarray:
    """The bitmaps of half the width that the same sets have, row by row: neighbouring buckets fall together."""
    bits = np.unpackbits(maps.view(np.uint8), axis=-1, bitorder="little")
    return np.packbits(bits[..., 0::2] ^ bits[..., 1::2], axis=-1, bitorder="little").view(np.uint64)


# Frequency levels


def _bucket(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(64 - LEVEL_BITS)).astype(np.int64)


def _sparse(held: dict[int, np.ndarray]):
    """part, at (uint16), n (int64) of the counts that aren't 0."""
    rows = []
    for part, counts in held.items():
        some = np.flatnonzero(counts)
        if len(some):
            rows.append((part, some.astype(np.uint16).tobytes(), counts[some].tobytes()))
    if rows:
        p, a, n = zip(*rows, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(a, pa.binary()), pa.array(n, pa.binary())], names=["part", "at", "n"])


def _count(words: int):
    def run(batches):
        counts, waiting, size = np.zeros(1 << LEVEL_BITS, np.int64), [], 0
        for batch in batches:
            for lo, hi in slices(batch.column(0)):
                hashes, at = K.words(pc.fill_null(batch.column(0).slice(lo, hi - lo), ""), K.NOT_SPACE)
                g = K.grams(hashes, words)
                inside = np.repeat(at[1:], np.diff(at))[: len(g)] >= np.arange(len(g)) + words  # not across texts
                waiting.append(_bucket(g[inside]))
                size += len(waiting[-1])
                if size > 1 << 19:
                    counts += np.bincount(np.concatenate(waiting), minlength=len(counts))
                    waiting, size = [], 0
        if waiting:
            counts += np.bincount(np.concatenate(waiting), minlength=len(counts))
        yield from _sparse(dict(enumerate(counts.reshape(-1, 1 << PART_BITS))))
        release()

    return run


def _summed(batches):
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, at, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            held.setdefault(part, np.zeros(1 << PART_BITS, np.int64))[np.frombuffer(at, np.uint16)] += np.frombuffer(n, np.int64)
    yield from _sparse(held)


def frequency_levels(docs: DataFrame, words: int, text: str) -> np.ndarray:
    """For each bucket of shingles 0, or the power of two by which its count stands out. The driver gets 2 ** LEVEL_BITS counts."""
    kind = "part int, at binary, n binary"
    small_batches(docs.sparkSession)
    counted = docs.select(docs[f"`{text}`"].cast("string").alias("t")).mapInArrow(_count(words), kind).withColumn("task", F.spark_partition_id() % 64)
    some = counted.repartition("part", "task").select("part", "at", "n").mapInArrow(_summed, kind).repartition("part").mapInArrow(_summed, kind)
    counts = np.zeros((1 << (LEVEL_BITS - PART_BITS), 1 << PART_BITS), np.int64)
    for r in some.toLocalIterator():
        counts[r.part][np.frombuffer(r["at"], np.uint16)] += np.frombuffer(r["n"], np.int64)
    mean = counts.mean()
    over = counts.reshape(-1) - mean
    usual = 6 * np.sqrt(mean) + 8
    return np.where(over > usual, 1 + np.log2(np.maximum(over, usual) / usual), 0).astype(np.uint8)


# Sketches


def _sketch(alike: Alike, levels: np.ndarray):
    def kernel(texts: pa.Array, _):
        n, fp, maps, prefixes = [], [], [], []
        for s in shingle_sets(texts, alike.words):
            n.append(len(s))
            if not len(s):
                fp.append(None), maps.append(None), prefixes.append(None)
                continue
            fp.append(fingerprint(s))
            maps.append(bitmap(s).tobytes())
            level = levels[_bucket(s)]
            if level.any():
                s = s[np.argsort(level, kind="stable")]
            prefixes.append(s[: alike.prefix(len(s))].view(np.int64))
        return {"n": pa.array(n, pa.int64()), "fp": pa.array(fp, pa.binary()), "bits": pa.array(maps, pa.binary()), "prefix": pa.array(prefixes, pa.list_(pa.int64()))}

    return kernel


SKETCH = T.StructType([T.StructField("n", T.LongType()), T.StructField("fp", T.BinaryType()), T.StructField("bits", T.BinaryType()), T.StructField("prefix", T.ArrayType(T.LongType()))])


def fingerprint(shingles: np.ndarray) -> bytes:
    """128 bits of a set."""
    m = K.mix(shingles)
    return m.sum(dtype=np.uint64).tobytes() + np.bitwise_xor.reduce(K.mix(m + np.uint64(1))).tobytes()


# Tiles


def _bytes_of(n: np.ndarray) -> np.ndarray:
    """Bytes of the bitmaps of sets of n shingles."""
    return np.clip(2 << np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64), LEAST_BITS, MOST_BITS) >> 3


def _tiles(alike: Alike, tiling: Tiling):
    """token, n (packed), rep sorted by them: tile, block, members, and their least and greatest n. A tile of one block is named by its members."""

    def block_end(n: np.ndarray) -> int:
        return max(2, min(tiling.members, int(np.searchsorted(np.cumsum(_bytes_of(n)), tiling.bitmap_bytes))))

    def name(token: np.ndarray, n: np.ndarray) -> np.ndarray:
        return K.mix(token.view(np.uint64) ^ K.mix(n.view(np.uint64))).view(np.int64)

    def rows(tile, block, rep, n, first, size):
        if not len(first):
            return
        take = np.repeat(first - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
        offsets = np.concatenate([[0], np.cumsum(size)])
        yield pa.RecordBatch.from_arrays([pa.array(tile), pa.array(block), K.lists(rep[take], offsets, pa.int64()), pa.array(n[first]), pa.array(n[first + size - 1])], names=["tile", "block", "members", "lo", "hi"])

    def run(batches):
        held = [np.empty(0, np.int64)] * 4
        after, named, reached = 0, None, 0  # blocks that the first tile of held has had, its name, and how far they reach

        def cut(last: bool):
            nonlocal held, after, named, reached
            token, n, rep, reach = held
            if not len(token):
                return
            other = token[1:] != token[:-1]
            shift = np.concatenate([[0], np.cumsum(other)]) << 40  # so that a token's reach ends with it
            far = np.maximum.accumulate(np.maximum(reach, np.where(shift == 0, reached, 0)) + shift) - shift
            apart = other | (far[:-1] < n[1:])
            edge = np.flatnonzero(np.concatenate([[True], apart, [True]]))
            first, size = edge[:-1], np.diff(edge)
            done = len(first) if last else len(first) - 1
            skip = 0
            if after and done:  # the end of a tile of several blocks
                yield from rows(named, np.array([after], np.int32), rep, n, first[:1], size[:1])
                after, skip, reached = 0, 1, 0
            first_, size_ = first[skip:done], size[skip:done]
            many = size_ > 1
            first_, size_ = first_[many], size_[many]
            big = np.flatnonzero((size_ > tiling.members) | (np.add.reduceat(_bytes_of(n), first_) > tiling.bitmap_bytes if len(first_) else False))
            for k in big.tolist():
                lo, end, b = first_[k], first_[k] + size_[k], 0
                own = name(token[lo : lo + 1], n[lo : lo + 1])
                while lo < end:
                    step = min(end - lo, block_end(n[lo:end]))
                    yield from rows(own, np.array([b], np.int32), rep, n, np.array([lo]), np.array([step]))
                    lo, b = lo + step, b + 1
            keep = np.ones(len(first_), bool)
            keep[big] = False
            first_, size_ = first_[keep], size_[keep]
            if len(first_):
                end = int(first_[-1] + size_[-1])
                hashed = K.mix(rep[:end].view(np.uint64))
                inside = np.zeros(end + 1, np.int64)
                inside[first_] += 1
                inside[first_ + size_] -= 1
                hashed = np.where(np.cumsum(inside[:-1]) > 0, hashed, np.uint64(0))
                tile = np.add.reduceat(hashed, first_) ^ np.bitwise_xor.reduceat(np.where(hashed, K.mix(hashed + np.uint64(1)), np.uint64(0)), first_)
                _, some = np.unique(tile, return_index=True)
                yield from rows(tile[some].view(np.int64), np.zeros(len(some), np.int32), rep, n, first_[some], size_[some])
            rest = int(edge[done]) if done < len(edge) else len(token)
            held = [x[rest:] for x in held]
            while not last and len(held[0]) > (step := block_end(held[1])):  # a tile that goes on
                token, n, rep, reach = held
                named, reached = named if after else name(token[:1], n[:1]), max(reached, int(reach[:step].max()))
                yield from rows(named, np.array([after], np.int32), rep, n, np.array([0]), np.array([step]))
                held, after = [x[step:] for x in held], after + 1

        for batch in batches:
            token, packed, rep = (c.to_numpy() for c in batch.columns)
            n = packed >> PLACE_BITS
            new = (token, n, rep, alike.reach(n, packed & ((1 << PLACE_BITS) - 1)))
            held = [np.concatenate([h, c]) for h, c in zip(held, new, strict=True)]
            yield from cut(False)
        yield from cut(True)
        release()

    return run


TILES = "tile long, block int, members array<long>, lo long, hi long"


# Cells


def _cells(batches, keys: int):
    """The rows that agree in the first columns, over batches sorted by them."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [c.to_numpy() for c in batch.columns[:keys]]
        new = np.zeros(batch.num_rows, bool)
        for c, name in zip(columns, range(keys), strict=True):
            new[1:] |= c[1:] != c[:-1]
            new[0] |= bool(held) and held[-1].column(name)[-1].as_py() != c[0]
        edge = np.flatnonzero(new)
        for lo, hi in zip([0, *edge[edge > 0].tolist()], [*edge[edge > 0].tolist(), batch.num_rows], strict=True):
            if held and new[lo]:
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


class _Band:
    """The classes of a cell, sorted by size, with their bitmaps, each at its own width and, for meeting smaller sets, at half of it."""

    def __init__(self, alike: Alike, n: np.ndarray, bits: pa.BinaryArray):
        self.alike, self.n = alike, n
        offsets = np.frombuffer(bits.buffers()[1], np.int32)[bits.offset : bits.offset + len(bits) + 1]
        data = np.frombuffer(bits.buffers()[2], np.uint8)
        self.width = np.diff(offsets) // 8
        self.range, own = {}, {}
        for w in np.unique(self.width).tolist():
            lo, hi = np.searchsorted(self.width, w), np.searchsorted(self.width, w, side="right")
            own[w] = data[offsets[lo] : offsets[hi]].copy().view(np.uint64).reshape(hi - lo, w)
            self.range[w] = (int(lo), int(hi), int(hi))
        self.maps = {}
        for w, m in own.items():
            self.maps[w] = m
            if 2 * w in own:
                self.maps[w] = np.concatenate([m, fold(own[2 * w])])
                self.range[w] = (*self.range[w][:2], self.range[w][1] + len(own[2 * w]))

    def may(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (of rows, of all) that can be alike by size and by the bound on the overlap. Sizes that may meet have widths of at most a factor 2."""
        left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for w, (lo, middle, hi) in self.range.items():
            narrow, wide = rows[(rows >= lo) & (rows < middle)], rows[(rows >= middle) & (rows < hi)]
            for some, start, end in ((narrow, lo, hi), (wide, lo, middle)):
                step = max(1, (1 << 18) // max(1, (end - start) * w))
                for k in range(0, len(some), step):
                    self._compare(some[k : k + step], w, lo, start, end, left, right)
        return np.concatenate(left), np.concatenate(right)

    def _compare(self, rows, w, base, start, end, left, right):
        a, alike = self.n[rows], self.alike
        start = max(start, int(np.searchsorted(self.n, -(-alike.num * int(a.min()) // alike.den))))
        end = min(end, int(np.searchsorted(self.n, alike.den * int(a.max()) // alike.num, side="right")))
        if end <= start:
            return
        maps, b = self.maps[w], self.n[start:end]
        apart = np.bitwise_count(maps[rows - base][:, None, :] ^ maps[start - base : end - base][None, :, :]).sum(axis=2, dtype=np.int64)
        a = a[:, None]
        overlap = np.minimum((a + b - apart) // 2, np.minimum(a, b))
        i, j = np.nonzero(alike.enough(overlap, a, b))
        i, j = rows[i], j + start
        left.append(i[i != j])
        right.append(j[i != j])

    def middle(self, left: np.ndarray) -> int:
        """Of the most frequent width among left, the class nearest to the majority of its bits."""
        widths, counts = np.unique(self.width[left], return_counts=True)
        w = int(widths[counts.argmax()])
        own = left[self.width[left] == w]
        maps = self.maps[w][own - self.range[w][0]]
        ones = np.zeros(64 * w, np.int64)
        for k in range(0, len(maps), 1024):
            ones += np.unpackbits(maps[k : k + 1024].view(np.uint8), axis=1).sum(axis=0, dtype=np.int64)
        majority = np.packbits(ones * 2 > len(own)).view(np.uint64)
        return int(own[np.bitwise_count(maps ^ majority).sum(axis=1).argmin()])


class _Out:
    """Pairs of classes, and names of tiles with pairs left, as batches of a, b, tile."""

    def __init__(self):
        self.pairs, self.tiles, self.size = [], [], 0

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        if len(a):
            self.pairs.append(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1))
            self.size += len(a)

    def batch(self) -> pa.RecordBatch:
        both = np.unique(np.concatenate([*self.pairs, np.empty((0, 2), np.int64)]), axis=0)
        k, t = len(both), len(self.tiles)
        out = pa.RecordBatch.from_arrays([pa.concat_arrays([pa.array(both[:, x]), pa.nulls(t, pa.int64())]) for x in (0, 1)] + [pa.concat_arrays([pa.nulls(k, pa.int64()), pa.array(self.tiles, pa.int64())])], names=["a", "b", "tile"])
        self.pairs, self.tiles, self.size = [], [], 0
        return out

    def full(self) -> bool:
        return self.size + len(self.tiles) > 1 << 15


PAIRS = "a long, b long, tile long"


def _stars(alike: Alike, tiling: Tiling):
    """tile, block, n, rep, bits sorted by the first four: pairs of pivots with the members that may be alike them."""

    def run(batches):
        out = _Out()
        for cell in _cells(batches, 2):
            rep, n = cell["rep"].to_numpy(), cell["n"].to_numpy()
            band = _Band(alike, n, cell["bits"].chunk(0))
            if len(rep) <= tiling.whole:
                i, j = band.may(np.arange(len(rep)))
                if len(i):
                    near = np.zeros((len(rep), len(rep)), bool)
                    near[i, j] = near[j, i] = True
                    listed, all_ = 0, int(near.sum()) // 2
                    while near.any():
                        pivot = int(near.sum(axis=1).argmax())
                        others = np.flatnonzero(near[pivot])
                        out.add(np.full(len(others), rep[pivot]), rep[others])
                        listed += len(others)
                        gone = np.append(others, pivot)
                        near[gone] = False
                        near[:, gone] = False
                    if listed < all_:
                        out.tiles.append(cell["tile"][0].as_py())
            else:
                left = np.arange(len(rep))
                for _ in range(tiling.pivots):
                    if len(left) < 2:
                        break
                    pivot = band.middle(left)
                    _, others = band.may(np.array([pivot]))
                    others = others[np.isin(others, left, assume_unique=True)]
                    out.add(np.full(len(others), rep[pivot]), rep[others])
                    left = np.setdiff1d(left, np.append(others, pivot), assume_unique=True)
                out.tiles.append(cell["tile"][0].as_py())
            if out.full():
                yield out.batch()
        yield out.batch()
        release()

    return run


def _rest(alike: Alike):
    """tile, i, j, n, rep, bits, c, block sorted by the first five: pairs of different components c that may be alike, of blocks i and j."""

    def run(batches):
        out = _Out()
        for cell in _cells(batches, 3):
            rep, c, block = (cell[x].to_numpy() for x in ("rep", "c", "block"))
            names, counts = np.unique(c, return_counts=True)
            few = np.flatnonzero(c != names[counts.argmax()])  # of two different components one isn't the largest
            if not len(few):
                continue
            band = _Band(alike, cell["n"].to_numpy(), cell["bits"].chunk(0))
            across = cell["i"][0].as_py() != cell["j"][0].as_py()
            for k in range(0, len(few), 1024):
                x, y = band.may(few[k : k + 1024])
                good = c[x] != c[y]
                if across:
                    good &= block[x] != block[y]
                out.add(rep[x[good]], rep[y[good]])
                if out.full():
                    yield out.batch()
        yield out.batch()
        release()

    return run


# Links


def _chosen(chosen):
    """The rows whose first column, k, is chosen."""

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(is_picked(chosen.value, batch.column(0).to_numpy())))

    return run


def _tokens(chosen):
    """k, rid, n, prefix: token, n packed with the token's place, rid of the rows whose k isn't chosen."""

    def run(batches):
        for batch in batches:
            batch = batch.filter(pa.array(~is_picked(chosen.value, batch.column(0).to_numpy())))
            prefix = batch.column(3)
            each = pc.list_value_length(prefix).to_numpy(zero_copy_only=False)
            rid, n = (np.repeat(batch.column(c).to_numpy(), each) for c in (1, 2))
            place = np.arange(len(n)) - np.repeat(np.cumsum(each) - each, each)
            yield pa.RecordBatch.from_arrays([prefix.flatten(), pa.array((n << PLACE_BITS) | np.minimum(place, (1 << PLACE_BITS) - 1)), pa.array(rid)], names=["token", "n", "rep"])
        release()

    return run


def _sets(alike: Alike, chosen):
    """k, text: fp and set of the rows whose k is chosen."""

    def run(batches):
        for batch in batches:
            batch = batch.filter(pa.array(is_picked(chosen.value, batch.column(0).to_numpy())))
            for lo, hi in slices(batch.column(1)):
                sets = [s for s in shingle_sets(pc.fill_null(batch.column(1).slice(lo, hi - lo), ""), alike.words) if len(s)]
                yield pa.RecordBatch.from_arrays([pa.array([fingerprint(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["fp", "set"])
        release()

    return run


def _verified(alike: Alike):
    def run(batches):
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                s, t = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                small, large = (s, t) if len(s) <= len(t) else (t, s)
                place = np.searchsorted(large, small)
                overlap = int((large[np.minimum(place, len(large) - 1)] == small).sum())
                good.append(bool(alike.enough(overlap, len(s), len(t))))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(good)), batch.column(1).filter(pa.array(good))], names=["a", "b"])

    return run


def links_of(docs: DataFrame, pairs: DataFrame, sketch: DataFrame, alike: Alike, id_col: str, text: str) -> DataFrame:
    """The pairs (a, b) of sketch's rows that are links. Only texts whose id falls on a chosen bit are cut into shingles again."""
    ends = pairs.select(F.col("a").alias("rid")).unionByName(pairs.select(F.col("b").alias("rid"))).distinct()
    some = stash(sketch.select("rid", "id", "fp").join(ends, "rid"), "ends")
    chosen = docs.sparkSession.sparkContext.broadcast(picked(some.select(pick_key(F.col("id")))))
    texts = docs.select(pick_key(docs[f"`{id_col}`"].cast("long")), docs[f"`{text}`"].cast("string").alias("t"))
    sets = texts.mapInArrow(_sets(alike, chosen), "fp binary, set binary").groupBy("fp").agg(F.first("set").alias("set"))
    sets = stash(sets.join(some.select("rid", "fp"), "fp").select("rid", "set"), "sets")
    of = lambda end, name: sets.select(F.col("rid").alias(end), F.col("set").alias(name))
    out = stash(pairs.join(of("a", "s"), "a").join(of("b", "t"), "b").select("a", "b", "s", "t").mapInArrow(_verified(alike), "a long, b long"), "links")
    chosen.destroy()
    unstash(some, sets)
    return out


def ngram_join(docs: DataFrame, alike: Alike = Alike(), id_col: str = "doc_id", text: str = "text", tiling: Tiling = Tiling()) -> DataFrame:
    """id, n_shingles, component_id (the least id reachable by links) for every row of docs."""
    return grouped(docs, alike, id_col, text, tiling).select("id", "n_shingles", "component_id")


def distinct_documents(docs: DataFrame, alike: Alike, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs of which one a component is left: of those with the least id, or without one if no row has an id, the
    one whose text has the least hash, and of rows with that id and text the least by all columns, in their order. So the
    row that stays doesn't depend on how rows are dealt. Rows without shingles all stay. Only rows whose id and text fall on
    one of at most 2 ** BUCKET_BITS buckets are shuffled."""
    names = docs.columns
    docs = plain(docs)
    rows = grouped(docs, alike, id_col, text)
    per = rows.where("n_shingles > 0").groupBy("id", "h").agg(F.max("kept").alias("kept"), F.count("*").alias("n"))
    cut = stash(per.where("not kept or n > 1").select("id", "h", "kept"), "cut")
    bucket = lambda i, h: F.pmod(F.xxhash64(i, h), F.lit(1 << BUCKET_BITS)).alias("_bucket")
    buckets = F.broadcast(cut.select(bucket(F.col("id"), F.col("h"))).distinct())
    key, h = docs[f"`{id_col}`"].cast("long"), F.xxhash64(docs[f"`{text}`"].cast("string"))
    marked = docs.select(F.struct(*[docs[f"`{n}`"] for n in docs.columns]).alias("_row"), key.alias("_id"), h.alias("_h"), bucket(key, h))
    some = marked.join(buckets, "_bucket", "left_semi")
    gone = cut.where("not kept")
    some = some.join(gone, some["_id"].eqNullSafe(gone["id"]) & (some["_h"] == gone["h"]), "left_anti")
    worded = F.col(f"_row.`{text}`").rlike(r"[^\x20\x09-\x0D]")
    def ordered(name: str):  # maps have no order
        return F.to_json(F.struct(F.col(f"_row.`{name}`"))) if "map<" in docs.schema[name].dataType.simpleString() else F.col(f"_row.`{name}`")

    least = F.min_by("_row", F.struct(*[ordered(n) for n in docs.columns]))
    once = some.where(worded).groupBy("_id", "_h").agg(least.alias("_row")).select("_row")
    parts = [marked.join(buckets, "_bucket", "left_anti").select("_row"), once, some.where(~F.coalesce(worded, F.lit(False))).select("_row")]
    return reduce(DataFrame.unionByName, parts).select("_row.*").toDF(*names)


def grouped(docs: DataFrame, alike: Alike, id_col: str = "doc_id", text: str = "text", tiling: Tiling = Tiling()) -> DataFrame:
    """id, h (hash of the text), n_shingles, component_id and kept (one row a component: of the least id, the least of its rows) for every row of docs."""
    docs = plain(docs)
    levels = frequency_levels(docs, alike.words, text)
    raw = docs[f"`{text}`"].cast("string")
    found = map_text(docs.select(docs[f"`{id_col}`"].cast("long").alias("id"), F.xxhash64(raw).alias("h"), raw.alias("t")), "t", ["id", "h"], _sketch(alike, levels), SKETCH)
    sketch = stash(found.select(F.monotonically_increasing_id().alias("rid"), "row.*", "found.*"), "sketch")
    first = F.struct(F.col("id").isNull(), "id", "h", "rid")
    classes = stash(sketch.where("n > 0").groupBy("fp").agg(F.min("rid").alias("rid"), F.min(first).alias("first"), F.count("*").alias("rows")), "classes")
    shared = docs.sparkSession.sparkContext.broadcast(picked(classes.where("rows > 1").select(pick_key(F.col("fp")))))
    rows = sketch.where("n > 0").select(pick_key(F.col("fp")), "rid", "n", "prefix")
    alone = rows.mapInArrow(_tokens(shared), "token long, n long, rep long")
    copies = rows.mapInArrow(_chosen(shared), rows.schema).join(classes.where("rows > 1").select("rid"), "rid", "left_semi").select("n", "rid", F.posexplode("prefix").alias("place", "token"))
    packed = F.shiftleft("n", PLACE_BITS).bitwiseOR(F.least("place", F.lit((1 << PLACE_BITS) - 1)).cast("long"))
    copies = copies.select("token", packed.alias("n"), F.col("rid").alias("rep"))
    sorted_ = alone.unionByName(copies).repartition("token").sortWithinPartitions("token", "n", "rep")
    tiles = stash(sorted_.mapInArrow(_tiles(alike, tiling), TILES).dropDuplicates(["tile", "block"]), "tiles")
    bits = sketch.select(F.col("rid").alias("rep"), "n", "bits")
    blocks = tiles.select("tile", "block", F.explode("members").alias("rep")).join(bits, "rep").select("tile", "block", "n", "rep", "bits")
    stars = stash(blocks.repartition("tile", "block").sortWithinPartitions("tile", "block", "n", "rep").mapInArrow(_stars(alike, tiling), PAIRS), "stars")
    pairs = stash(stars.where("a is not null").select("a", "b").distinct(), "pairs")
    links = links_of(docs, pairs, sketch, alike, id_col, text)
    joined = components(links)

    many = tiles.where("block > 0").select("tile")
    left = tiles.join(many.unionByName(stars.where("tile is not null").select("tile")).distinct(), "tile", "left_semi")
    placed = left.select("tile", "block", "lo", "hi", F.explode("members").alias("rep")).join(joined.withColumnRenamed("v", "rep"), "rep", "left")
    placed = stash(placed.select("tile", "block", "lo", "hi", "rep", F.coalesce("c", "rep").alias("c")), "placed")
    mixed = placed.groupBy("tile").agg(F.min("c").alias("least"), F.max("c").alias("most"), F.array_sort(F.collect_set(F.struct("block", "lo", "hi"))).alias("all")).where("least < most").select("tile", "all")
    meets = lambda small, large: F.lit(alike.den) * small >= F.lit(alike.num) * large
    up = F.transform(F.filter("all", lambda x: (x["block"] >= F.col("block")) & meets(F.col("hi"), x["lo"])), lambda x: F.struct(F.col("block").alias("i"), x["block"].alias("j")))
    down = F.transform(F.filter("all", lambda x: (x["block"] < F.col("block")) & meets(x["hi"], F.col("lo"))), lambda x: F.struct(x["block"].alias("i"), F.col("block").alias("j")))
    cells = placed.join(mixed, "tile").select("tile", "block", "rep", "c", F.explode(F.concat(up, down)).alias("cell")).join(bits, "rep")
    cells = cells.select("tile", "cell.i", "cell.j", "n", "rep", "bits", "c", "block").repartition("tile", "i", "j").sortWithinPartitions("tile", "i", "j", "n", "rep")
    rest = stash(cells.mapInArrow(_rest(alike), PAIRS).select("a", "b").distinct().join(pairs, ["a", "b"], "left_anti"), "rest")
    if rest.limit(1).count():
        more = links_of(docs, rest, sketch, alike, id_col, text)
        if more.limit(1).count():
            links = links.unionByName(more)
            joined = components(links)
    unstash(tiles, stars, pairs, placed, rest)

    linked = classes.join(joined.withColumnRenamed("v", "rid"), "rid").select("fp", "first", "c")
    linked = linked.join(linked.groupBy("c").agg(F.min("first").alias("of_all")), "c").select("fp", "of_all")
    named = classes.join(linked, "fp", "left").select("fp", F.coalesce("of_all", "first").alias("first"))
    out = sketch.where("n > 0").select("rid", "id", "h", "n", "fp").join(named, "fp")
    out = out.select("id", "h", F.col("n").alias("n_shingles"), F.col("first.id").alias("component_id"), (F.col("rid") == F.col("first.rid")).alias("kept"))
    alone = sketch.where("n = 0").select("id", "h", F.col("n").alias("n_shingles"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    return out.unionByName(alone)
