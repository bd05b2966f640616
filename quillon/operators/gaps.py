"""Gaps between the reviews of a term, and back, chunk by chunk.

A chunk's row has all that its gaps and sums need: its postings, and the last id and the number of postings before it. So
nothing is shuffled, however frequent a term is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sums within a chunk are taken over groups of so many gaps, then within a group.
GROUP = 32


def gap_lists(chunks: DataFrame) -> DataFrame:
    """term, chunk, before, previous, gaps: to the posting before, across chunks, or to 0."""
    gaps = F.transform("ids", lambda x, i: x - F.when(i == 0, F.col("previous")).otherwise(F.get("ids", i - 1)))
    return chunks.select("term", "chunk", "before", "previous", gaps.alias("gaps"))


def gaps(chunks: DataFrame) -> DataFrame:
    """term, review_id, gap."""
    both = F.arrays_zip("ids", F.transform("ids", lambda x, i: x - F.when(i == 0, F.col("previous")).otherwise(F.get("ids", i - 1))).alias("gaps"))
    return chunks.select("term", F.inline(both)).toDF("term", "review_id", "gap")


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + x)


def ids(gapped: DataFrame) -> DataFrame:
    """Of gap_lists: term, seq (from 0 within a term), review_id, from the gaps and what stands before the chunk alone."""
    groups = F.transform(F.sequence(F.lit(0), F.floor((F.size("gaps") - 1) / GROUP).cast("int")), lambda g: _sum(F.slice("gaps", g * GROUP + 1, F.lit(GROUP))))
    rows = gapped.withColumn("groups", groups)
    rows = rows.withColumn("sums", F.transform("groups", lambda x, g: F.col("previous") + _sum(F.slice("groups", F.lit(1), g))))
    at = lambda i: F.get("sums", F.floor(i / GROUP).cast("int")) + _sum(F.slice("gaps", F.floor(i / GROUP).cast("int") * GROUP + 1, i % GROUP + 1))
    out = F.transform("gaps", lambda x, i: F.struct((F.col("before") + i).alias("seq"), at(i).alias("review_id")))
    return rows.select("term", F.inline(out))
