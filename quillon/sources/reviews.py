"""Reviews from raw files (S1, S2) and from tables.

All give review_id, product_id, score, helpful_num, helpful_den, text. Ids are 1-based and dense, in order of appearance.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.ordinals import with_ordinal

PRODUCT, HELPFULNESS, SCORE, TEXT = "product/productId:", "review/helpfulness:", "review/score:", "review/text:"


@dataclass
class Joined:
    """Reviews that a table of texts makes with a table of short rows beside it, by review_id. What asks for texts alone needs no join, which may move them."""

    texts: DataFrame
    beside: DataFrame
    finish: Callable[[DataFrame], DataFrame]

    def reviews(self) -> DataFrame:
        return self.finish(self.texts.join(self.beside, "review_id", "left"))


def normalised(num: Column, den: Column) -> tuple[Column, Column]:
    """The larger of the two is the denominator."""
    return F.least(num, den), F.greatest(num, den)


def records(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """review_id and value, a record from behind its first line's prefix; numbered over all files in order.

    The reader cuts files where a line begins with the product prefix, so a row is a record, whatever blocks it reaches over.
    A row's number is its place among its block's rows plus the records of the blocks before. Only a count a block moves, and
    comes back as a broadcast: a row for each block that the driver plans a task for, some tens of bytes for 128 MB of input.
    """
    rows = spark.read.option("lineSep", f"\n{PRODUCT}").text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("at")
    )
    blocks = rows.groupBy("file", "start").agg(F.count("*").alias("n"), F.min("at").alias("least"), F.min_by(F.startswith("value", F.lit(PRODUCT)), "at").alias("head"))
    other = (F.col("start") == 0) & ~F.col("head")  # a file's first row, if it has other lines before the first record
    before = Window.orderBy("file", "start").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("file", "start", "least", other.alias("other"), F.coalesce(F.sum(F.col("n") - other.cast("int")).over(before), F.lit(0)).alias("before"))
    placed = rows.join(F.broadcast(blocks), ["file", "start"]).withColumn("place", F.col("at") - F.col("least")).where(~(F.col("other") & (F.col("place") == 0)))
    first_of_file = (F.col("start") == 0) & (F.col("place") == 0)  # with the prefix, as no separator stood before it
    value = F.when(first_of_file, F.substring("value", len(PRODUCT) + 1, 1 << 30)).otherwise(F.col("value"))
    return placed.select((F.col("before") + F.col("place") + 1 - F.col("other").cast("int")).cast("long").alias("review_id"), value.alias("value"))


def parse_reviews(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """A file, a folder or several paths. A field that a record lacks or that is malformed is null there only; of repeated
    fields the first counts; lines before the first product line, and of other kinds, are skipped; texts are one line. Lines end
    with a line feed, a carriage return or both; a record begins behind a line feed. Texts aren't shuffled."""

    def field(prefix: str) -> Column:
        return F.substring(F.get(F.filter("lines", lambda line: F.startswith(line, F.lit(prefix))), F.lit(0)), len(prefix) + 2, 1 << 30)

    rows = records(spark, path).select("review_id", F.split("value", "\r\n|\n|\r").alias("lines"))
    rows = rows.select("review_id", F.substring(F.get("lines", F.lit(0)), 2, 1 << 30).alias("product_id"), field(HELPFULNESS).alias("help"), field(SCORE).alias("stars"), field(TEXT).alias("text"))
    part = lambda k: F.expr(f"try_cast(get(split(help, '/'), {k}) AS INT)")
    num, den = normalised(part(0), part(1))
    whole = part(0).isNotNull() & part(1).isNotNull()
    return rows.select("review_id", "product_id", F.expr("try_cast(substring(stars, 1, 1) AS INT)").alias("score"), F.when(whole, num).alias("helpful_num"), F.when(whole, den).alias("helpful_den"), F.lower("text").alias("text"))


def documents(spark: SparkSession, sf_dir: str) -> Joined:
    """Documents as reviews of their source. Scores and helpfulness are synthetic: made from labels, ids and lengths."""
    d, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    num, den = normalised(F.col("doc_id") % 7, F.col("n_chars") % 11)
    texts = d.select((F.col("doc_id") + 1).alias("review_id"), F.col("source").alias("product_id"), (1 + F.col("doc_id") % 5).alias("unlabelled"), num.cast("int").alias("helpful_num"), den.cast("int").alias("helpful_den"), F.lower("text").alias("text"))
    stars = F.coalesce(F.when(F.col("quality") == 1, 5).when(F.col("quality") == 0, 2), "unlabelled").cast("int").alias("score")
    return Joined(texts, labels.select(F.try_add("doc_id", F.lit(1)).alias("review_id"), "quality"), lambda both: both.select("review_id", "product_id", stars, "helpful_num", "helpful_den", "text"))


def from_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).reviews()


def from_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as reviews of their conversation, without score and helpfulness. Ids follow conversation and turn, however far apart
    those are; turns without either come first, and of a repeated turn role and text decide."""
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    key = F.struct("conv_id", "turn", F.xxhash64("role", "text").alias("rest")).alias("place")
    numbered = with_ordinal(c.select(key, F.col("conv_id").cast("string").alias("product_id"), F.lower("text").alias("text")), "place", "before")
    none = F.lit(None).cast("int")
    return numbered.select((F.col("before") + 1).alias("review_id"), "product_id", none.alias("score"), none.alias("helpful_num"), none.alias("helpful_den"), "text")
