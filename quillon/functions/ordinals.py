"""0-based ranks of keys without one task that sorts them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: The upper level has SPLIT * SPLIT splitters at most; about one in BOUND keys is a splitter of the lower level.
SPLIT, BOUND = 32, 1 << 16


def _at_most(splitters: Column, key: Column) -> Column:
    return F.size(F.filter(splitters, lambda t: t <= key))


def ranged(df: DataFrame, key: str, split: int = SPLIT, bound: int = BOUND) -> DataFrame:
    """df with _top and _low, which order its keys: all keys of a pair are below those of the next one.

    Splitters are the keys whose hashes are multiples of bound, so the data alone decide them and a range has about bound keys,
    however many there are and whatever beginnings they share. The split * split keys with the least hashes are the upper
    level, one broadcast row. The lower level is a sorted list for each upper range and is joined; an upper range has a key of that
    join, and a copy of its list, for about every bound of its keys, so none meets in one task.
    """
    s, cols = F.col("_s"), [f"`{c}`" for c in df.columns]
    keys = df.select(F.col(key).alias("_s"))
    top = keys.orderBy(F.xxhash64(s), s).limit(split * split).agg(F.array_sort(F.collect_list(s)).alias("_all"))
    splitters = F.broadcast(top.select("_all", F.transform(F.sequence(F.lit(0), F.lit(split - 1)), lambda k: F.get("_all", k * split)).alias("_tops")))

    def placed(rows: DataFrame, k: str) -> DataFrame:
        group = F.greatest(F.lit(0), _at_most(F.col("_tops"), F.col(k)) - 1)
        within = _at_most(F.slice("_all", F.col("_group") * split + 1, F.lit(split)), F.col(k))
        kept = [c for c in rows.columns if c not in ("_all", "_tops")]
        return rows.crossJoin(splitters).withColumn("_group", group).select(*[F.col(f"`{c}`") for c in kept], (F.col("_group") * split + within).alias("_top"))

    lower = placed(keys.where(F.pmod(F.xxhash64(s), F.lit(bound)) == 0), "_s").groupBy("_top").agg(F.array_sort(F.collect_list(s)).alias("_list"))
    copies = lower.select("_top", "_list", F.explode(F.sequence(F.lit(0), F.size("_list"))).alias("_copy"))
    many = F.broadcast(lower.agg(F.map_from_entries(F.collect_list(F.struct("_top", F.size("_list").alias("n")))).alias("_many")))  # one row, an entry for each upper range
    rows = placed(df, key).crossJoin(many)
    copy = F.pmod(F.xxhash64(F.col(key), F.lit(1)), F.coalesce(F.try_element_at("_many", F.col("_top")), F.lit(0)) + 1).cast("int")
    return rows.withColumn("_copy", copy).join(copies, ["_top", "_copy"], "left").select(*cols, "_top", F.coalesce(_at_most(F.col("_list"), F.col(key)), F.lit(0)).alias("_low"))


def with_ordinal(df: DataFrame, key: str, name: str, split: int = SPLIT, bound: int = BOUND) -> DataFrame:
    """df with the rank of the column key, which isn't null and may be a struct; equal keys are numbered in any order.

    Ranks count within a range, plus the rows of the ranges before: of its upper range a window over a row a range knows those,
    and of the upper ranges before one over at most split * split + 1 rows.
    """
    rows = ranged(df, key, split, bound)
    before = lambda w: F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = rows.groupBy("_top", "_low").agg(F.count("*").alias("_n"))
    tops = counts.groupBy("_top").agg(F.sum("_n").alias("_n")).select("_top", before(Window.orderBy("_top")).alias("_above"))
    lows = counts.select("_top", "_low", before(Window.partitionBy("_top").orderBy("_low")).alias("_beside"))
    offsets = lows.join(F.broadcast(tops), "_top").select("_top", "_low", (F.col("_above") + F.col("_beside")).alias("_before"))
    rank = F.row_number().over(Window.partitionBy("_top", "_low").orderBy(key)) - 1
    return rows.withColumn("_rank", rank).join(offsets, ["_top", "_low"]).withColumn(name, (F.col("_before") + F.col("_rank")).cast("long")).drop("_top", "_low", "_before", "_rank")
