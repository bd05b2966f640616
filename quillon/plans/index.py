"""The index: reviews, posting chunks, lexicon, products, their reviews and stats, as DataFrames over other DataFrames or over Parquet.

A term's posting list is cut by ranges of CHUNK review ids into chunks, one row each: a chunk's arrays hold at most CHUNK postings with
their reviews' lengths, and beside them stand what a search or a scan needs to skip or enter the chunk: its first and last
id, count, greatest tf, least length and greatest tf / length, the last id and the number of postings before it. All terms are
cut at the same ids, so a range of ids can be judged for a whole query.

A stored index's reviews are a bucketed table, by blocks of review ids, and its lists are made and written by the same blocks, each in one task, from that
table: what moves are the texts, once in all, and a short row for each term of a block, which says what stands before the block. No posting and no chunk is ever shuffled.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.ordinals import with_ordinal
from ..functions.text import tokens
from ..sources.reviews import Joined
from . import blocks

MARK = "_QUILLON_INDEX"
CHUNK = 1024
#: A block of a stored index has at most about so many tokens, which its task sorts, but at least a chunk's ids; small tables have a block a core.
BLOCK_TOKENS = 1 << 21
#: Tokens of a text that isn't cut yet are taken to be so many bytes long, with what separates them.
TOKEN_BYTES = 6
STORED = ("reviews", "chunks", "lexicon", "products", "product_reviews", "stats")
#: Columns by which rows are looked up; row groups without the value are told by Bloom filters.
LOOKED_UP = {"reviews": "review_id", "chunks": "term", "lexicon": "term", "products": "product_id", "product_reviews": "product_id"}


@dataclass
class Index:
    reviews: DataFrame  # review_id, product_id, score, helpful_num, helpful_den, length, text
    entries: DataFrame  # term, review_id, tf, length
    chunks: DataFrame  # term, chunk, first_id, last_id, n, cf, max_tf, min_length, max_ratio, before, previous, ids, tfs, lengths
    lexicon: DataFrame  # term_id, term, df, cf
    products: DataFrame  # product_ord, product_id, n_reviews
    product_reviews: DataFrame  # product_id, review_id
    stats: DataFrame  # n_terms, n_reviews, n_tokens
    chunk: int = CHUNK
    n_reviews: int | None = None  # known of a stored index alone

    @property
    def postings(self) -> DataFrame:
        return self.entries.select("term", "review_id", "tf")


def entries_of(reviews: DataFrame, beside: Sequence[str] = ()) -> DataFrame:
    """A1, A2: term, review_id, tf, length and the columns beside. All occurrences of a (term, review) are in one row, so they are counted there, as runs of the sorted tokens: nothing is shuffled."""
    rows = reviews.select(*beside, "review_id", F.sort_array(tokens("text")).alias("s"))
    heads = F.filter(F.transform("s", lambda t, i: i), lambda i: (i == 0) | (F.get("s", i) != F.get("s", i - 1)))
    rows = rows.withColumn("at", heads)
    runs = F.transform("at", lambda p, k: F.struct(F.get("s", p).alias("term"), (F.coalesce(F.get("at", k + 1), F.size("s")) - p).cast("long").alias("tf")))
    return rows.select(*beside, "review_id", F.size("s").alias("length"), F.inline(runs)).select("term", "review_id", "tf", "length", *beside)


def postings_of(reviews: DataFrame) -> DataFrame:
    return entries_of(reviews).select("term", "review_id", "tf")


def chunk_lists(entries: DataFrame, chunk: int = CHUNK, beside: Sequence[str] = ()) -> DataFrame:
    """The chunks, without what stands before them. A frequent term is as many keys as it has chunks. beside: columns that are one value for a chunk."""
    number = F.floor(F.col("review_id") / chunk).cast("long").alias("chunk")
    skips = [F.min("review_id").alias("first_id"), F.max("review_id").alias("last_id"), F.count("*").alias("n"), F.sum("tf").alias("cf")]
    bounds = [F.max("tf").alias("max_tf"), F.min("length").alias("min_length"), F.max(F.col("tf") / F.col("length")).alias("max_ratio")]
    lists = entries.groupBy(*beside, "term", number).agg(*skips, *bounds, F.sort_array(F.collect_list(F.struct("review_id", "tf", "length"))).alias("l"))
    return lists.select(*beside, "term", "chunk", "first_id", "last_id", "n", "cf", "max_tf", "min_length", "max_ratio", F.col("l.review_id").alias("ids"), F.col("l.tf").alias("tfs"), F.col("l.length").alias("lengths"))


def with_skips(lists: DataFrame) -> DataFrame:
    """before and previous: postings of the term before the chunk, and the last of their ids, else 0. The window sees a short row a chunk."""
    order = Window.partitionBy("term").orderBy("chunk")
    before = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long").alias("before")
    slim = lists.select("term", "chunk", "n", "last_id").select("term", "chunk", before, F.coalesce(F.lag("last_id").over(order), F.lit(0)).cast("long").alias("previous"))
    return lists.join(slim, ["term", "chunk"]).select("term", "chunk", "first_id", "last_id", "n", "cf", "max_tf", "min_length", "max_ratio", "before", "previous", "ids", "tfs", "lengths")


def blocks_for(spark: SparkSession, chunk: int, n_reviews: int, n_tokens: int) -> tuple[int, int]:
    """Review ids of a block, and how many partitions or buckets blocks are dealt to by hash: as many as there are blocks, and enough for all cores."""
    cores = spark.sparkContext.defaultParallelism
    tokens_a_block = min(BLOCK_TOKENS, max(1, n_tokens // cores))
    block = chunk * max(1, tokens_a_block * n_reviews // (max(1, n_tokens) * chunk))
    return block, max(1, math.ceil(n_reviews / block), 2 * cores)


def with_block(reviews: DataFrame, block: int) -> DataFrame:
    return reviews.withColumn("block", F.floor(F.col("review_id") / block).cast("long"))


def chunks_by_block(reviews: DataFrame, chunk: int, n_reviews: int, n_tokens: int) -> DataFrame:
    """The chunks of reviews that lie anyhow."""
    block, parts = blocks_for(reviews.sparkSession, chunk, n_reviews, n_tokens)
    texts = with_block(reviews.select("review_id", "text"), block).where("block is not null")
    return chunks_of_blocks(texts.repartition(parts, "block"), chunk, parts)


def chunks_of_blocks(texts: DataFrame, chunk: int, parts: int) -> DataFrame:
    """The chunks with what stands before them, by term and chunk within a block of ids. texts: review_id, text and block, dealt to parts by the hash of block, by an exchange or as buckets.

    before and previous are counted within the block; what stands before a block's first chunk of a term comes from a window over a
    row for each (term, block), and moves for blocks that a term isn't new in. Blocks and those rows are dealt alike, and both passes over a block read the same texts."""
    sums = texts.groupBy("block").applyInArrow(blocks.sums, blocks.SUMS)
    over = Window.partitionBy("term").orderBy("block")
    sums = sums.select("block", "term", F.coalesce(F.sum("n").over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long").alias("earlier"), F.coalesce(F.lag("last_id").over(over), F.lit(0)).cast("long").alias("latest"))
    both = texts.groupBy("block").cogroup(sums.where("earlier > 0").repartition(parts, "block").groupBy("block"))  # said for both sides, so that the texts stay where they are
    return both.applyInArrow(lambda reviews, before: blocks.chunks(reviews, before, chunk), blocks.CHUNKS)


def slim(chunks: DataFrame) -> DataFrame:
    """As they are stored: of a chunk of one posting, which most are, all that its first_id, max_tf and min_length say is null."""
    said = ("last_id", "cf", "max_ratio", "ids", "tfs", "lengths")
    return chunks.select(*[F.when(F.col("n") > 1, F.col(c)).alias(c) if c in said else F.col(c) for c in chunks.columns])


def whole(chunks: DataFrame) -> DataFrame:
    """The chunks again."""
    said = {"last_id": F.col("first_id"), "cf": F.col("max_tf"), "max_ratio": F.col("max_tf") / F.col("min_length"), "ids": F.array("first_id"), "tfs": F.array("max_tf"), "lengths": F.array("min_length")}
    return chunks.select(*[F.coalesce(c, said[c]).alias(c) if c in said else F.col(c) for c in chunks.columns])


def entries_in(chunks: DataFrame) -> DataFrame:
    """term, review_id, tf, length again."""
    return chunks.select("term", F.inline(F.arrays_zip("ids", "tfs", "lengths"))).toDF("term", "review_id", "tf", "length")


def terms_of(postings: DataFrame) -> DataFrame:
    """A3, A4."""
    return postings.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def lexicon_of(terms: DataFrame) -> DataFrame:
    """W1."""
    return with_ordinal(terms, "term", "term_id").select("term_id", "term", "df", "cf")


def placed_by_range(df: DataFrame, key: str) -> DataFrame:
    """df by ranges of key, with the number of its range and its place there; to be written, as a second run may cut other ranges."""
    rows = df.repartitionByRange(key).sortWithinPartitions(key)
    return rows.select(*df.columns, F.spark_partition_id().alias("_range"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("_place"))


def numbered(terms: DataFrame) -> DataFrame:
    """W1 of what placed_by_range has placed: what moves is a count a range, which comes back as a broadcast."""
    before = F.sum("n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    offsets = terms.groupBy("_range").agg(F.count("*").alias("n")).select("_range", F.coalesce(before, F.lit(0)).alias("_before"))
    return terms.join(F.broadcast(offsets), "_range").withColumn("term_id", F.col("_before") + F.col("_place")).drop("_range", "_place", "_before")


def with_length(reviews: DataFrame) -> DataFrame:
    """A8."""
    return reviews.withColumn("length", F.size(tokens("text"))).select("review_id", "product_id", "score", "helpful_num", "helpful_den", "length", "text")


def products_of(reviews: DataFrame) -> DataFrame:
    """Counts alone; partial sums meet, whatever a product's share of the reviews."""
    counts = product_reviews_of(reviews).groupBy("product_id").agg(F.count("*").alias("n_reviews"))
    return with_ordinal(counts, "product_id", "product_ord").select("product_ord", "product_id", "n_reviews")


def product_reviews_of(reviews: DataFrame) -> DataFrame:
    """A10: a row for each review of a product, so that no list is ever held."""
    return reviews.where("product_id is not null").select("product_id", "review_id")


def stats_of(reviews: DataFrame, terms: DataFrame) -> DataFrame:
    """A5 to A7. terms: a row for each."""
    r = reviews.agg(F.count("*").alias("n_reviews"), F.coalesce(F.sum("length"), F.lit(0)).cast("long").alias("n_tokens"))
    return terms.agg(F.count("*").alias("n_terms")).crossJoin(F.broadcast(r)).select("n_terms", "n_reviews", "n_tokens")  # one row by one row


def build(reviews: DataFrame, chunk: int = CHUNK) -> Index:
    """The tables as lazy plans over reviews; review_id tells the rows apart."""
    r = with_length(reviews)
    entries = entries_of(r)
    terms = terms_of(entries)
    return Index(r, entries, with_skips(chunk_lists(entries, chunk)), lexicon_of(terms), products_of(r), product_reviews_of(r), stats_of(r, terms), chunk)


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def write(reviews: DataFrame | Joined, directory: str, chunk: int = CHUNK) -> Index:
    """Writes the tables into a folder of their own in the directory, and last a small manifest that names it. Only the manifest makes them
    an index: what a failed write leaves is never read, and no rename is asked for, which object stores can't do at once. Of
    two writers the first one with a manifest wins. Tables are built from those written before; the texts alone are read twice, at first
    for their number and bytes, before anything is joined with them. Their table has a name in the session's catalogue while lists are made from its buckets."""
    texts = reviews.texts if isinstance(reviews, Joined) else reviews
    spark = texts.sparkSession
    if _manifest(spark, directory):
        raise FileExistsError(directory)
    data = f"data-{uuid.uuid4().hex}"
    table = f"quillon_reviews_{data[5:]}"
    beside = f"{directory.rstrip('/')}/{data}"

    def put(df: DataFrame, name: str, buckets: int = 0) -> DataFrame:
        writer = df.write.option("compression", "zstd")
        if name in LOOKED_UP:
            writer = writer.option(f"parquet.bloom.filter.enabled#{LOOKED_UP[name]}", "true").option("parquet.bloom.filter.adaptive.enabled", "true")
        if buckets:
            writer.bucketBy(buckets, "block").sortBy("review_id").format("parquet").option("path", f"{beside}/{name}").saveAsTable(table)
        else:
            writer.parquet(f"{beside}/{name}")
        return spark.read.parquet(f"{beside}/{name}")

    def drop(path: str) -> None:
        fs, p = _fs(spark, path)
        fs.delete(p, True)

    try:
        size = texts.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
        block, parts = blocks_for(spark, chunk, size["n"], size["bytes"] // TOKEN_BYTES)
        rows = reviews.reviews() if isinstance(reviews, Joined) else reviews
        r = put(with_block(with_length(rows), block).repartition(parts, "block"), "reviews", parts)
        texts = spark.table(table).select("review_id", "text", "block").where("block is not null")
        chunks = whole(put(slim(chunks_of_blocks(texts, chunk, parts)), "chunks"))
        terms = put(placed_by_range(chunks.groupBy("term").agg(F.sum("n").alias("df"), F.sum("cf").alias("cf")), "term"), "terms")
        x = put(numbered(terms).select("term_id", "term", "df", "cf"), "lexicon")
        drop(f"{beside}/terms")
        put(product_reviews_of(r).repartitionByRange("product_id", "review_id").sortWithinPartitions("product_id", "review_id"), "product_reviews")
        put(products_of(r).repartitionByRange("product_id").sortWithinPartitions("product_id"), "products")
        totals = put(stats_of(r, x), "stats").first()
        _commit(spark, directory, {"data": data, "chunk": chunk, "n_reviews": totals["n_reviews"]})
    except BaseException:
        drop(beside)
        raise
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {table}")  # the name alone
    return open_index(spark, directory)


def _commit(spark: SparkSession, directory: str, manifest: dict) -> None:
    fs, p = _fs(spark, f"{directory.rstrip('/')}/{MARK}")
    if fs.exists(p):
        raise FileExistsError(directory)
    out = fs.create(p, False)
    out.writeBytes(json.dumps(manifest))
    out.close()


def _manifest(spark: SparkSession, directory: str) -> dict | None:
    fs, p = _fs(spark, f"{directory.rstrip('/')}/{MARK}")
    if not fs.exists(p):
        return None
    source = fs.open(p)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8"))
    finally:
        source.close()


def _marked(spark: SparkSession, directory: str) -> dict:
    manifest = _manifest(spark, directory)
    if manifest is None:
        raise FileNotFoundError(f"{directory} is no index")
    return manifest


def open_index(spark: SparkSession, directory: str) -> Index:
    """Lazy; a look-up reads the row groups that its key may be in."""
    manifest = _marked(spark, directory)
    tables = {name: spark.read.parquet(f"{directory.rstrip('/')}/{manifest['data']}/{name}") for name in STORED}
    tables |= {"reviews": tables["reviews"].drop("block"), "chunks": whole(tables["chunks"])}
    return Index(entries=entries_in(tables["chunks"]), chunk=manifest["chunk"], n_reviews=manifest["n_reviews"], **tables)


def delete(spark: SparkSession, directory: str) -> None:
    """Only what write has made; the manifest goes first, so that no reader opens what is half gone."""
    data = _marked(spark, directory)["data"]
    fs, top = _fs(spark, directory)
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs.delete(path(f"{directory.rstrip('/')}/{MARK}"), False)
    fs.delete(path(f"{directory.rstrip('/')}/{data}"), True)
    if not list(fs.listStatus(top)):
        fs.delete(top, False)
