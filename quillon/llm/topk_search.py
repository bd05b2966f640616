"""Exact top-k search by inner product over an impact-ordered index, score at a time.

The index has a row for each block of vectors. In it every dimension has a posting list of the block's vectors, sorted by
component and cut into segments of equal quantised component (a power of two wide, at most LEVELS of them). For a query the
impact of a segment is the most that its postings can add to a score: the query's component times the upper or lower end of
the segment. Segments of all dimensions are processed in the order of falling impact, down to a falling threshold t: each
posting adds the impact to its vector's accumulator and counts. A vector's score is then at most its accumulator plus t for
each dimension not counted yet. The k + 1 vectors with the best accumulators are scored exactly after each round, which gives a
score that the result reaches at least; once the vectors that may still reach it are few, which is the proof that no others
belong to the result, those are scored exactly. Without such a proof all segments are processed.

Blocks answer each for themselves with their k best; the k best of these are the result.

Defined results: rows with a null id, a null vector or a null or non-finite component take no part, neither as queries nor as
candidates; an empty vector takes part, with all scores 0. Equal rows count once. Rows that repeat an id with another vector are
candidates and queries each for itself (query_row tells them apart), and no candidates of their own id. Fewer candidates than
k: all. An empty table, or one without queries, gives an empty table. Other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .vectors import ASKED, MEMBERS, SCALE, Blocks, blocks, cells, classes, first_rows, fitted, integer_rows, lists, packed, spread, unpacked

LEVELS = 256
#: Thresholds as parts of a query's largest impact; after the last one everything is processed.
FALL = (0.4, 0.2, 0.1, 0.04, 0.0, -0.04, -0.1, -0.3)
#: Vectors that may belong to the result are scored once they are at most a FEW-th of the block.
FEW = 16
INDEX = "n int, dim int, shift int, low int, vectors binary, postings binary, ends binary, ids array<bigint>, id_ends array<bigint>"


def _build(columns: dict) -> dict:
    v = columns["v"]
    n, dim = v.shape
    reach = max(int(v.max(initial=0)) - int(v.min(initial=0)), 1)
    shift = max(0, reach.bit_length() - LEVELS.bit_length() + 1)
    level = v >> shift
    low = int(level.min(initial=0))
    level -= low
    postings = np.argsort(level, axis=0, kind="stable").T  # a row a dimension
    many = int(level.max(initial=0)) + 1
    ends = np.stack([np.searchsorted(np.sort(level[:, d]), np.arange(many), "right") for d in range(dim)])
    ids, id_ends = lists(columns["ids"])
    return {"n": n, "dim": dim, "shift": shift, "low": low, "vectors": packed(v), "postings": packed(postings), "ends": packed(ends), "ids": ids, "id_ends": id_ends}


def index(vectors: DataFrame, least: int, members: int = MEMBERS) -> Blocks:
    """vectors: id, label, v. least: ids of a class that a result may name."""
    return blocks(classes(vectors, least).select("v", "ids"), members, _build, INDEX, "topk-index")


class Segments:
    """A block of the index, for queries of dim components."""

    def __init__(self, block: dict, queries: np.ndarray):
        self.n, dim = block["n"], block["dim"]
        v, self.queries = fitted(unpacked(block["vectors"], self.n, dim), queries, room=4 * (max(dim, queries.shape[1]) + 1))
        self.v, self.dim = v, dim
        self.postings = unpacked(block["postings"], dim, self.n).astype(np.intp)
        ends = unpacked(block["ends"], dim, -1).astype(np.int64)
        self.ends = np.concatenate([np.zeros((dim, 1), np.int64), ends], axis=1)
        self.sizes = np.diff(self.ends, axis=1)
        levels = np.arange(ends.shape[1], dtype=np.int64) + block["low"]
        self.lower, self.upper = levels << block["shift"], ((levels + 1) << block["shift"]) - 1
        self.count = max(1, dim.bit_length())  # low bits of an accumulator count
        self.processed = 0

    def best(self, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Members and exact scores of all that can be among the k + 1 best."""
        if self.n <= k + 1:
            return np.arange(self.n), self.v @ query
        q = query[: self.dim]
        impact = q[:, None] * np.where(q[:, None] > 0, self.upper, self.lower)
        added = (impact << self.count) + 1
        held, acc = np.zeros(self.dim, np.int64), np.zeros(self.n, np.int64)
        reached, most, levels = None, int(impact.max()), impact.shape[1]
        for part in (*FALL, None):
            t = int(most * part) if part is not None else int(impact.min()) - 1
            now = (impact > t).sum(axis=1)  # segments of a dimension that are processed: a rising run of its list, from either end
            for d in np.flatnonzero(now > held):
                lo, hi = (levels - now[d], levels - held[d]) if q[d] > 0 else (held[d], now[d])
                at = self.postings[d, self.ends[d, lo] : self.ends[d, hi]]
                acc[at] += np.repeat(added[d, lo:hi], self.sizes[d, lo:hi])
                self.processed += len(at)
            held = np.maximum(held, now)
            seen = acc & ((1 << self.count) - 1)
            bound = (acc >> self.count) + (self.dim - seen) * t
            front = np.argpartition(bound, self.n - k - 1)[self.n - k - 1 :]
            least = int((self.v[front] @ query).min())
            reached = least if reached is None else max(reached, least)
            may = np.flatnonzero(bound >= reached)
            if part is None or len(may) <= max(k + 1, self.n // FEW):
                return may, self.v[may] @ query


def _answer(k: int):
    def answer(asked: dict, held: dict) -> Iterator[dict]:
        n = asked["n"]
        segments = Segments(held, unpacked(asked["vectors"], n, asked["dim"]))
        ids, ends = np.array(held["ids"], np.int64), np.array(held["id_ends"], np.int64)
        for query, row, own in zip(segments.queries, asked["rows"], asked["ids"], strict=True):
            members, scores = segments.best(query, k)
            for i, score in spread(scores, members, ids, ends, own, k):
                yield {"query_row": row, "query_id": own, "id": i, "score": score}

    return answer


def _queries(columns: dict) -> dict:
    n, dim = columns["v"].shape
    return {"n": n, "dim": dim, "vectors": packed(columns["v"]), "ids": columns["id"].to_pylist(), "rows": columns["query_row"].to_pylist()}


def top_k(rows: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector: str = "embedding", scale: int = SCALE, members: int = MEMBERS, asked: int = ASKED) -> DataFrame:
    """query_row, query_id, rank (from 1), id, score: the k best candidates of each query. is_query: over the columns id and v."""
    vectors = integer_rows(rows, id_col, vector, scale=scale)
    queries = vectors.where(is_query).select("id", "v").distinct().withColumn("query_row", F.monotonically_increasing_id())
    q = blocks(queries, asked, _queries, "n int, dim int, vectors binary, ids array<bigint>, rows array<bigint>", "topk-queries")
    found = cells(q, index(vectors, k + 1, members), _answer(k), "query_row long, query_id long, id long, score long")
    return first_rows(found, ["query_row"], k).select("query_row", "query_id", F.col("rank").cast("int").alias("rank"), "id", "score")
