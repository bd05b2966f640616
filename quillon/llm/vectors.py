"""What the two operators over vectors share: integer vectors, classes of equal ones, blocks, and cells of two blocks.

A component x becomes floor(scale * x), x as a double. Rows with a null id or vector, or with a null or non-finite component,
take no part. Equal vectors are one class with its `least` smallest ids, which are all that a result of a few rows can name,
so a vector that a third of all rows has is one class; Spark cuts the ids of a class before they are shuffled. Classes are
dealt by hash into blocks of about `members`. A cell is a block of queries with a block of classes; cells are dealt out by
their number, and a task holds one cell at a time. Vectors of other lengths count as filled up with zeros. Scores must fit
into 62 bits, else an OverflowError says so.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import plain, release, small_batches, stash, unstash

SCALE = 256
#: Classes of a block, queries of a block.
MEMBERS, ASKED = 8192, 2048
_WIDTHS = ("<i1", "<i2", "<i4", "<i8")


@dataclass
class Blocks:
    rows: DataFrame  # block and what the builder returned for it
    n: int


def sound(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def integer_rows(rows: DataFrame, id_col: str, vector: str, label: str | None = None, scale: int = SCALE) -> DataFrame:
    """id, v (array of long), label (0 where none is given), of the rows that take part."""
    rows = plain(rows)
    v = rows[f"`{vector}`"].cast("array<double>")
    ints = F.transform(v, lambda x: F.floor(F.lit(float(scale)) * x).cast("long"))
    out = rows.where(sound(v)).select(rows[f"`{id_col}`"].cast("long").alias("id"), ints.alias("v"), (rows[f"`{label}`"] if label else F.lit(0)).cast("long").alias("label"))
    return out.where(F.col("id").isNotNull() & F.col("label").isNotNull())


def classes(rows: DataFrame, least: int) -> DataFrame:
    """label, v, ids: the least smallest ids of the rows with equal label and vector, sorted."""
    rank = F.dense_rank().over(Window.partitionBy("label", "v").orderBy("id"))
    few = rows.select("label", "v", "id", rank.alias("rank")).where(F.col("rank") <= least)
    return few.groupBy("label", "v").agg(F.array_sort(F.collect_set("id")).alias("ids"))


def blocks(rows: DataFrame, size: int, build: Callable[[dict[str, np.ndarray | pa.Array]], dict[str, object]], fields: str, label: str) -> Blocks:
    """Rows with v in blocks of about size, each one row of block and fields: what build makes of the block's columns, v as a matrix."""
    small_batches(rows.sparkSession)
    rows = stash(rows, label)
    n = -(-rows.count() // size)
    if not n:
        return Blocks(rows.sparkSession.createDataFrame([], f"block int, {fields}"), 0)

    def made(table: pa.Table) -> pa.Table:
        columns = {c: table[c].combine_chunks() for c in table.column_names}
        out = {"block": columns.pop("block")[0].as_py()} | build(columns | {"v": matrix(columns["v"])})
        return pa.Table.from_pylist([out], schema)

    schema = pa.schema([pa.field("block", pa.int32()), *(pa.field(name, _ARROW[kind]) for name, kind in (f.split() for f in fields.split(", ")))])
    placed = rows.withColumn("block", F.pmod(F.xxhash64(*rows.columns), F.lit(n)).cast("int"))
    out = Blocks(stash(placed.groupBy("block").applyInArrow(made, f"block int, {fields}"), f"{label}-blocks"), n)
    unstash(rows)
    return out


_ARROW = {"int": pa.int32(), "binary": pa.binary(), "array<bigint>": pa.list_(pa.int64())}


def cells(asked: Blocks, held: Blocks, answer: Callable[[dict, dict], Iterator[dict]], schema: str) -> DataFrame:
    """answer(block of queries, block of classes) for each pair of blocks; rows of schema."""
    cell = F.col("a") * held.n + F.col("b")
    many = max(1, min(4 * asked.n * held.n, 1 << 15))  # so that few cells meet in a task
    other = lambda n: F.explode(F.sequence(F.lit(0), F.lit(max(n, 1) - 1)))
    left = asked.rows.select(F.struct(*asked.rows.columns).alias("asked"), F.col("block").cast("long").alias("a"), other(held.n).alias("b"))
    right = held.rows.select(F.struct(*held.rows.columns).alias("held"), F.col("block").cast("long").alias("b"), other(asked.n).alias("a"))
    both = left.select("asked", cell.alias("cell")).repartition(many, "cell").join(right.select("held", cell.alias("cell")).repartition(many, "cell"), "cell")
    kind = pa.schema([pa.field(f.split()[0], _LONGS[f.split()[1]]) for f in schema.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                x, y = (batch.column(c)[i].as_py() for c in (0, 1))
                yield from pa.Table.from_pylist(list(answer(x, y)), kind).to_batches()
        release()

    return both.select("asked", "held").mapInArrow(run, schema)


_LONGS = {"long": pa.int64(), "int": pa.int32()}


def matrix(vectors: pa.Array) -> np.ndarray:
    """A row a vector, shorter ones filled up with zeros."""
    ends, flat = np.asarray(vectors.offsets), vectors.values.to_numpy(zero_copy_only=False).astype(np.int64)
    sizes, flat = np.diff(ends), flat[ends[0] : ends[-1]]
    dim = max(1, int(sizes.max(initial=1)))
    out = np.zeros((len(sizes), dim), np.int64)
    out[np.arange(dim) < sizes[:, None]] = flat
    return out


def lists(values: pa.Array) -> tuple[list[int], list[int]]:
    """All values of the lists, and where each list ends."""
    ends = np.asarray(values.offsets)
    return values.values.to_numpy(zero_copy_only=False)[ends[0] : ends[-1]].tolist(), (ends[1:] - ends[0]).tolist()


def packed(m: np.ndarray) -> bytes:
    """The matrix in the least width that its values fit, with the width as first byte."""
    lo, hi = int(m.min(initial=0)), int(m.max(initial=0))
    width = next(i for i, w in enumerate(_WIDTHS) if np.iinfo(w).min <= lo and hi <= np.iinfo(w).max)
    return bytes([width]) + np.ascontiguousarray(m).astype(_WIDTHS[width]).tobytes()


def unpacked(data: bytes, *shape: int) -> np.ndarray:
    return np.frombuffer(data, _WIDTHS[data[0]], offset=1).reshape(shape)


def fitted(a: np.ndarray, b: np.ndarray, room: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Both with as many columns, as 64-bit integers; products of their rows, times room, fit into 62 bits."""
    dim = max(a.shape[1], b.shape[1])
    a, b = (np.pad(m.astype(np.int64), ((0, 0), (0, dim - m.shape[1]))) for m in (a, b))
    most = [max(abs(int(m.min(initial=0))), abs(int(m.max(initial=0)))) for m in (a, b)]
    if most[0] * most[1] * dim * room >= 1 << 62:
        raise OverflowError(f"scores of vectors with components up to {most[0]} and {most[1]} don't fit into 62 bits")
    return a, b


def spread(scores: np.ndarray, members: np.ndarray, ids: np.ndarray, ends: np.ndarray, own: int, k: int) -> Iterator[tuple[int, int]]:
    """The first k (id, score) of the classes members with scores, but for own: higher scores first, ties by smaller id."""
    begins = np.concatenate([[0], ends[:-1]])[members]
    sizes = ends[members] - begins
    at = np.repeat(begins - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
    found, score = ids[at], np.repeat(scores, sizes)
    keep = found != own
    found, score = found[keep], score[keep]
    for i in np.lexsort((found, -score))[:k]:
        yield int(found[i]), int(score[i])


def first_rows(found: DataFrame, by: list[str], k: int) -> DataFrame:
    """The first k rows of each by: higher scores first, ties by smaller id; rank from 1. Spark cuts before it shuffles."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)
