"""What the operators of this folder share: stored intermediate tables, and a way to run a kernel over text columns."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import shared_dir

#: Bytes of text that a kernel sees at once; a longer text comes alone.
SLICE_BYTES = 1 << 18
#: Bytes of a batch of rows that goes to Python at once.
BATCH = "4m"
#: Sets of keys that go to all workers have 2 ** PICK_BITS bits, 8 MiB: a key that isn't in the set may seem to be, and exact joins follow.
PICK_BITS = 26


def _own_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/quillon/{spark.sparkContext.applicationId}"


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def sweep(spark: SparkSession) -> None:
    """Deletes all that this application has stashed; for when no result is read any more."""
    _delete(spark, _own_dir(spark))


def stash(df: DataFrame, label: str) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back: cuts the lineage, and survives lost executors."""
    path = f"{_own_dir(df.sparkSession)}/{uuid.uuid4().hex}-{label}"
    df.write.parquet(path)
    _stashed(df.sparkSession).append(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back._quillon_path = path
    return back


def _stashed(spark: SparkSession) -> list[str]:
    """Paths of the stashed tables that are still there, in order."""
    if not hasattr(spark, "_quillon_stashed"):
        spark._quillon_stashed = []
    return spark._quillon_stashed


def unstash(*frames: DataFrame) -> None:
    """Deletes stashed tables that no later plan reads."""
    for df in frames:
        _drop(df.sparkSession, [df._quillon_path])


def _drop(spark: SparkSession, paths: list[str]) -> None:
    held = _stashed(spark)
    for path in paths:
        _delete(spark, path)
        if path in held:
            held.remove(path)


def last_of(spark: SparkSession, make: Callable[[], DataFrame], label: str, *before: DataFrame) -> DataFrame:
    """What make() returns, stashed; all that was stashed on the way, and the stashed tables before, are deleted."""
    held = len(_stashed(spark))
    out = stash(make(), label)
    _drop(spark, [p for p in _stashed(spark)[held:] if p != out._quillon_path])
    unstash(*before)
    return out


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once, also where body uses it inside a lambda."""
    return F.transform(F.array(value), body)[0]


def small_batches(spark: SparkSession) -> None:
    """Has Arrow batches of at most BATCH from now on, unless the session has a bound of its own: they stand in each task's
    JVM and Python memory several times over."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, "67108864b") == "67108864b":
        spark.conf.set(key, BATCH)


def pick_key(value: Column) -> Column:
    """k: a number from 1 to 2 ** PICK_BITS, by hash."""
    return (F.pmod(F.xxhash64(value), F.lit(1 << PICK_BITS)) + 1).alias("k")


def picked(keys: DataFrame) -> np.ndarray:
    """A bit for each number from 1 to 2 ** PICK_BITS, set where the column k has it. The driver gets these bits alone."""
    maps = keys.groupBy(F.bitmap_bucket_number("k").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("k")).alias("map")).toArrow()
    out = np.zeros((1 << PICK_BITS) // 8, np.uint8)
    for part, blob in zip(maps["part"].to_pylist(), maps["map"].to_pylist(), strict=True):
        out[(part - 1) * 4096 : part * 4096] = np.frombuffer(blob, np.uint8)
    return out


def is_picked(bits: np.ndarray, k: np.ndarray) -> np.ndarray:
    return (bits[(k - 1) >> 3] >> ((k - 1) & 7).astype(np.uint8)) & 1 != 0


def release() -> None:
    """Gives back to the system what a task has freed: Python workers are used again, and idle ones keep it otherwise."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def plain(df: DataFrame) -> DataFrame:
    """df with names told apart that are equal but for case: all but the first get their place as a suffix."""
    seen: set[str] = set()
    names = [n if n.lower() not in seen and not seen.add(n.lower()) else f"{n}__{i}" for i, n in enumerate(df.columns)]
    return df if names == df.columns else df.toDF(*names)


def slices(texts: pa.Array, budget: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about budget bytes each."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
    lo, held = 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > budget:
            yield lo, i
            lo, held = i, 0
        held += n + 16
    if lo < len(sizes):
        yield lo, len(sizes)


def map_text(docs: DataFrame, text: str, keep: Sequence[str], kernel: Callable[[pa.Array, list[pa.Array]], dict[str, pa.Array]], fields: T.StructType, beside: Sequence[str] = ()) -> DataFrame:
    """Runs kernel(texts, beside columns) over slices of the rows and returns struct columns row (of keep) and found (of fields).

    Nulls in the text column reach the kernel as empty texts. Columns that docs has besides are not read. As keep and
    fields stay in structs of their own, their names may clash.
    """
    docs = plain(docs)
    small_batches(docs.sparkSession)
    names = list(dict.fromkeys([*keep, text, *beside]))
    at = {n: i for i, n in enumerate(names)}
    inner = docs.select(F.struct(*[docs[f"`{n}`"].alias(f"c{i}") for n, i in at.items()]).alias("row"))
    kept = [at[n] for n in keep]
    schema = T.StructType([T.StructField("row", T.StructType([T.StructField(n, docs.schema[n].dataType) for n in keep])), T.StructField("found", fields)])
    order = fields.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = batch.column(0).flatten()
            texts = columns[at[text]]
            for lo, hi in slices(texts):
                part = [c.slice(lo, hi - lo) for c in columns]
                got = kernel(pc.fill_null(part[at[text]], ""), [part[at[n]] for n in beside])
                yield pa.RecordBatch.from_arrays([pa.StructArray.from_arrays([part[i] for i in kept], names=list(keep)), pa.StructArray.from_arrays([got[n] for n in order], names=order)], names=["row", "found"])
        release()

    return inner.mapInArrow(run, schema)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
