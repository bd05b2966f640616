"""Hard-negative mining by bit-sliced integer products.

Classes of rows with equal label and vector stand in blocks; a block holds its vectors as bit-planes, most significant first
(two's complement, so the first plane is the sign's), a plane being 64-bit words with a bit for each component. For an anchor,
whose components are sliced in the same way, the product with one plane is a sum of population counts of the words' meets,
weighted by the anchor's planes. Once the planes down to bit p are processed, the rest of a score lies between 2 ** p - 1 times
the sums of the anchor's negative and positive components: an interval that halves with each plane. A candidate is dropped when
its interval can't qualify any more; after the last plane the intervals are the exact scores.

First the anchors' positives are found: the rows of the same label with the highest scores; a candidate can't qualify when
its interval ends below k others' beginnings. Then, with the positives' scores known, the rows of other labels: for a positive
of score s those between low and high percent of s, which can't qualify when the interval misses that range, or ends below
the beginnings of k others that surely are in it.

Defined results: rows with a null id, label or vector, or a null or non-finite component, take no part. Equal rows count once.
Rows that repeat an id with another label or vector are candidates and anchors each for itself (anchor_row tells them apart),
and neither positives nor negatives of their own id. A positive with a negative score has no negatives, as no score is between 80 and 100
percent of it. Anchors without positives, and positives without negatives, have no rows. An empty vector takes part, with all
scores 0. An empty table gives an empty table. Other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stash
from .vectors import ASKED, MEMBERS, SCALE, Blocks, blocks, cells, classes, first_rows, fitted, integer_rows, lists, packed, spread, unpacked

HELD = "n int, dim int, bits int, most binary, planes binary, labels array<bigint>, ids array<bigint>, id_ends array<bigint>"
ASKING = "n int, dim int, vectors binary, ids array<bigint>, rows array<bigint>, labels array<bigint>"
FOUND = "anchor_row long, anchor_id long, positive_score long, id long, score long"


def width(v: np.ndarray) -> int:
    """Bits of the components in two's complement."""
    return max(int(v.max(initial=0)).bit_length(), (-int(v.min(initial=0)) - 1).bit_length() if v.min(initial=0) < 0 else 0) + 1


def planes_of(v: np.ndarray, bits: int) -> np.ndarray:
    """[bits, rows, words]: the bits of the components, the sign's plane first."""
    n, dim = v.shape
    wide = np.zeros((n, -(-dim // 64) * 64), np.int64)
    wide[:, :dim] = v
    words = [np.packbits(((wide >> (bits - 1 - p)) & 1).astype(np.uint8), axis=1, bitorder="little").view("<u8") for p in range(bits)]
    return np.stack(words)


def weights(bits: int) -> list[int]:
    return [-(1 << (bits - 1)) if p == 0 else 1 << (bits - 1 - p) for p in range(bits)]


def _build(columns: dict) -> dict:
    by_label = np.argsort(labels := columns["label"].to_numpy(), kind="stable")  # a label's classes are one run
    v, bits = columns["v"][by_label], width(columns["v"])
    ids, ends = lists(columns["ids"].take(by_label))
    most = np.abs(v).max(axis=0, initial=0)[None, :]
    return {"n": len(v), "dim": v.shape[1], "bits": bits, "most": packed(most), "planes": planes_of(v, bits).tobytes(), "labels": labels[by_label].tolist(), "ids": ids, "id_ends": ends}


def _anchors(columns: dict) -> dict:
    n, dim = columns["v"].shape
    return {"n": n, "dim": dim, "vectors": packed(columns["v"]), "ids": columns["id"].to_pylist(), "rows": columns["anchor_row"].to_pylist(), "labels": columns["label"].to_pylist()}


class Planes:
    """A block's bit-planes, for a block of anchors."""

    def __init__(self, held: dict, anchors: np.ndarray):
        self.bits, n, words = held["bits"], held["n"], -(-held["dim"] // 64)
        fitted(unpacked(held["most"], 1, held["dim"]), anchors, room=4)
        self.planes = np.frombuffer(held["planes"], "<u8").reshape(self.bits, n, words)
        self.labels = np.array(held["labels"], np.int64)
        self.anchors = np.zeros((len(anchors), held["dim"]), np.int64)  # components that no candidate has add nothing
        shared = min(anchors.shape[1], held["dim"])
        self.anchors[:, :shared] = anchors[:, :shared]
        self.worked = 0

    def scores(self, anchor: np.ndarray, live: np.ndarray, drop: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Of the classes live those left over, and their exact scores. drop(lowest, highest) says after each plane who stays."""
        bits = width(anchor[None, :])
        sliced = planes_of(anchor[None, :], bits)[:, 0]
        below, above = int(np.minimum(anchor, 0).sum()), int(np.maximum(anchor, 0).sum())
        so_far = np.zeros(len(live), np.int64)
        for p, weight in enumerate(weights(self.bits)):
            plane = self.planes[p, live]
            for part, w in zip(sliced, weights(bits), strict=True):
                if part.any():
                    so_far += weight * w * np.bitwise_count(plane & part).sum(axis=1, dtype=np.int64)
            self.worked += len(live)
            rest = (1 << (self.bits - 1 - p)) - 1
            stay = drop(so_far + rest * below, so_far + rest * above)
            if not stay.all():
                live, so_far = live[stay], so_far[stay]
            if not len(live):
                break
        return live, so_far


def _best(k: int) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Who can be among the k best."""

    def drop(lowest: np.ndarray, highest: np.ndarray) -> np.ndarray:
        if len(lowest) <= k:
            return np.ones(len(lowest), bool)
        return highest >= np.partition(lowest, len(lowest) - k)[len(lowest) - k]

    return drop


def _within(ranges: list[tuple[int, int]], k: int) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Who can be among the k best of those whose scores are in one of the ranges."""

    def drop(lowest: np.ndarray, highest: np.ndarray) -> np.ndarray:
        stay = np.zeros(len(lowest), bool)
        for low, high in ranges:
            may = (highest >= low) & (lowest <= high)
            sure = lowest[(lowest >= low) & (highest <= high)]
            if len(sure) >= k:
                may &= highest >= np.partition(sure, len(sure) - k)[len(sure) - k]
            stay |= may
        return stay

    return drop


def _positives(k: int):
    def answer(asked: dict, held: dict) -> Iterator[dict]:
        block = Planes(held, unpacked(asked["vectors"], asked["n"], asked["dim"]))
        ids, ends = np.array(held["ids"], np.int64), np.array(held["id_ends"], np.int64)
        for anchor, label, row, own in zip(block.anchors, asked["labels"], asked["rows"], asked["ids"], strict=True):
            lo, hi = np.searchsorted(block.labels, [label, label + 1])
            live, scores = block.scores(anchor, np.arange(lo, hi), _best(k + 1))  # the anchor itself may be one
            for i, score in spread(scores, live, ids, ends, own, k):
                yield {"anchor_row": row, "anchor_id": own, "positive_score": score, "id": i, "score": score}

    return answer


def _negatives(k: int, low: int, high: int):
    def answer(asked: dict, held: dict) -> Iterator[dict]:
        block = Planes(held, unpacked(asked["vectors"], asked["n"], asked["dim"]))
        ids, ends = np.array(held["ids"], np.int64), np.array(held["id_ends"], np.int64)
        starts = np.concatenate([[0], asked["score_ends"][:-1]]).astype(int)
        for anchor, label, row, own, a, b in zip(block.anchors, asked["labels"], asked["rows"], asked["ids"], starts, asked["score_ends"], strict=True):
            ranges = {s: (-(-low * s // 100), high * s // 100) for s in asked["scores"][a:b]}
            lo, hi = np.searchsorted(block.labels, [label, label + 1])
            others = np.concatenate([np.arange(lo), np.arange(hi, len(block.labels))])
            live, scores = block.scores(anchor, others, _within(list(ranges.values()), k))
            for s, (least, most) in ranges.items():
                here = (scores >= least) & (scores <= most)
                for i, score in spread(scores[here], live[here], ids, ends, own, k):
                    yield {"anchor_row": row, "anchor_id": own, "positive_score": s, "id": i, "score": score}

    return answer


def _anchors_with_scores(columns: dict) -> dict:
    scores, ends = lists(columns["scores"])
    return _anchors(columns) | {"scores": scores, "score_ends": ends}


def held_blocks(vectors: DataFrame, least: int, members: int = MEMBERS) -> Blocks:
    return blocks(classes(vectors, least), members, _build, HELD, "negatives-classes")


def hard_negatives(
    rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, id_col: str = "vec_id", vector: str = "embedding", label: str = "label", scale: int = SCALE, members: int = MEMBERS, asked: int = ASKED
) -> DataFrame:
    """anchor_row, anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score. is_anchor: over id, v and label."""
    vectors = integer_rows(rows, id_col, vector, label, scale)
    held = held_blocks(vectors, max(positives + 1, negatives + 1), members)
    anchors = stash(vectors.where(is_anchor).distinct().withColumn("anchor_row", F.monotonically_increasing_id()), "anchors")
    found = cells(blocks(anchors, asked, _anchors, ASKING, "anchors"), held, _positives(positives), FOUND)
    near = stash(first_rows(found, ["anchor_row"], positives).select("anchor_row", "anchor_id", F.col("id").alias("positive_id"), "positive_score"), "positives")
    wanted = near.where("positive_score >= 0").groupBy("anchor_row").agg(F.array_sort(F.collect_set("positive_score")).alias("scores"))
    again = blocks(anchors.join(wanted, "anchor_row"), asked, _anchors_with_scores, f"{ASKING}, scores array<bigint>, score_ends array<bigint>", "anchors-again")
    hard = first_rows(cells(again, held, _negatives(negatives, low, high), FOUND), ["anchor_row", "positive_score"], negatives)
    hard = hard.select("anchor_row", "positive_score", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    return near.join(hard, ["anchor_row", "positive_score"]).select("anchor_row", "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
