"""Exact deduplication by deterministic block naming.

A text is cut into blocks of BLOCK bytes. Distinct blocks are sorted, in parts by hash, and numbered; then adjacent pairs of
numbers are sorted and numbered, again and again, until each text has one number, the same however rows are dealt. Equal numbers mean equal bytes: no hash decides
that two texts are equal. A length and a hash serve only to prove texts different: a row that is alone with its length
and hash has no copy and isn't cut. The rows that aren't alone are found by a set of at most 2 ** BUCKET_BITS hash
buckets, which is what is broadcast.

Defined results: null counts as empty text; repeated rows count as copies of each other; of copies the row with the
largest id stays (rows that repeat that id all stay; a null id stays only if its copies have none either); other columns
aren't read.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import plain, stash, unstash

BLOCK = 8192
BUCKET_BITS = 18
NAME_PARTS = 1 << 20
KEY = ["id", "n", "h"]


def _names(values: DataFrame, label: str) -> DataFrame:
    """Distinct rows with an integer each that the rows alone decide: their hash's part of NAME_PARTS, and their place in it when it is sorted."""
    part = F.pmod(F.xxhash64(*values.columns), F.lit(NAME_PARTS))
    rank = F.row_number().over(Window.partitionBy("part").orderBy(*values.columns)).cast("long")
    return stash(values.distinct().withColumn("part", part).withColumn("name", F.shiftleft("part", 40) + rank).drop("part"), label)


def _blocks(raw: Column, n: Column, block: int) -> Column:
    at = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((n - 1) / block)).cast("int"))
    return F.transform(at, lambda i: F.substring(raw, i * block + 1, F.lit(block)))


def block_names(texts: DataFrame, block: int = BLOCK) -> DataFrame:
    """texts: id, n (bytes), h, raw (binary). Returns id, n, h, name: equal n and name mean equal raw."""
    pieces = texts.select(*KEY, F.posexplode(_blocks(F.col("raw"), F.col("n"), block)).alias("pos", "block"))
    names = _names(pieces.select("block"), "names")
    left = F.floor((F.greatest(F.col("n"), F.lit(1)) + block - 1) / block).cast("long")
    level = stash(pieces.join(names, "block").select(*KEY, "pos", "name", left.alias("left")), "level")
    unstash(names)
    done = [level.where("left = 1").select(*KEY, "name")]
    most = level.agg(F.max("left")).first()[0] or 1
    while most > 1:
        pair = level.where("left > 1").groupBy(*KEY, F.floor(F.col("pos") / 2).cast("int").alias("pos"))
        pairs = pair.agg(*[F.coalesce(F.max(F.when(F.col("pos") % 2 == k, F.col("name"))), F.lit(-1)).alias(x) for k, x in enumerate("ab")], F.max(F.floor((F.col("left") + 1) / 2).cast("long")).alias("left"))
        pairs = stash(pairs, "pairs")
        names = _names(pairs.select("a", "b"), "names")
        level = stash(pairs.join(names, ["a", "b"]).select(*KEY, "pos", "name", "left"), "level")
        unstash(names, pairs)
        done.append(level.where("left = 1").select(*KEY, "name"))
        most = (most + 1) // 2
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.distinct()


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """id, keep_id, group_size, kept, text_sha256 (hex), a row for each row of docs."""
    docs = plain(docs)
    raw = F.coalesce(docs[f"`{text}`"].cast("string"), F.lit(""))
    n, h = F.octet_length(raw).cast("long"), F.xxhash64(raw)
    bucket = F.pmod(F.col("h"), F.lit(1 << BUCKET_BITS))
    seen = stash(docs.select(docs[f"`{id_col}`"].alias("id"), n.alias("n"), h.alias("h"), F.unhex(F.sha2(raw, 256)).alias("sha")), "seen")
    twice = seen.groupBy("n", "h").count().where("count > 1")
    buckets = twice.select(bucket.alias("bucket")).distinct()
    texts = docs.select(docs[f"`{id_col}`"].alias("id"), n.alias("n"), h.alias("h"), raw.cast("binary").alias("raw"))
    named = block_names(texts.withColumn("bucket", bucket).join(F.broadcast(buckets), "bucket", "left_semi").drop("bucket"), block)
    same = reduce(and_, [seen[k].eqNullSafe(named[k]) for k in KEY])
    rows = stash(seen.join(named, same, "left").select(*[seen[k] for k in KEY], "sha", "name"), "rows")
    groups = rows.where("name is not null").groupBy("n", "name").agg(F.max("id").alias("keep_id"), F.count("*").alias("group_size"))
    copies = rows.where("name is not null").join(groups, ["n", "name"]).select("id", "keep_id", "group_size", "sha")
    alone = rows.where("name is null").select("id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), "sha")
    return copies.unionByName(alone).select("id", "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))
