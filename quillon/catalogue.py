"""The registered queries over documents and conversations, and the same in SQL."""

from __future__ import annotations

import dataclasses
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .functions.codec import PRODUCT_BLOCK, TERM_BLOCK, front_decode, front_encode, gamma_decode, gamma_encode
from .functions.text import tokens
from .operators import gaps as G
from .operators import lookup, rank
from .plans.index import Index, build, delete, lexicon_of, open_index, terms_of, write
from .session import shared_dir
from .sources.reviews import Joined, documents, from_conversations, from_documents, parse_reviews

K = 10
PLAIN = ["the", "of", "worthless"]
REPEATED = ["The", "of", "the"]
UNKNOWN = ["the", "notaword"]
SEEN = ["the", "of", "anly", "notaword", "worthless"]
IDS = [0, 1, 2, 17, 100, 1_000_000]

Query = Callable[[SparkSession, str], DataFrame]


def _index(spark: SparkSession, sf_dir: str) -> Index:
    return build(from_documents(spark, sf_dir))


def _over(f: Callable[[Index], DataFrame]) -> Query:
    return lambda spark, sf_dir: f(_index(spark, sf_dir))


#: Review ids of a chunk in the indices that queries write: few, so that searches have ranges to skip in small tables, too.
NARROW = 32


def _new_path(spark: SparkSession, kind: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/quillon-{kind}-{uuid.uuid4().hex}"


def _once(spark: SparkSession, key: tuple[str, str], write_to: Callable[[str], object]) -> str:
    """The path in the shared folder that write_to has written in this session for key; written again if it has gone. Hadoop deletes it when the driver ends."""
    if not hasattr(spark, "_quillon_written"):
        spark._quillon_written = {}
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    files = lambda path: hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration())
    path = spark._quillon_written.get(key)
    if not path or not files(path).exists(hadoop(path)):
        path = _new_path(spark, key[0])
        write_to(path)
        files(path).deleteOnExit(hadoop(path))
        spark._quillon_written[key] = path
    return path


def _stored(f: Callable[[Index], DataFrame], kind: str = "index", source: Callable[[SparkSession, str], DataFrame | Joined] = documents) -> Query:
    """f over an index of the source's reviews that is written and opened again."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return f(open_index(spark, _once(spark, (kind, sf_dir), lambda path: write(source(spark, sf_dir), path, NARROW))))

    return query


def _ranked(f: Callable[[Index], DataFrame]) -> Query:
    """f over an index whose terms are counted and written once: ordinals read their keys several times, and texts would be cut into tokens each time."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        ix = _index(spark, sf_dir)
        terms = spark.read.parquet(_once(spark, ("terms", sf_dir), lambda path: terms_of(ix.entries).write.parquet(path)))
        return f(dataclasses.replace(ix, lexicon=lexicon_of(terms)))

    return query


def review_lookup(ix: Index) -> DataFrame:
    return ix.reviews.where(F.col("review_id").isin(IDS) & (F.col("review_id") >= 1)).select("review_id", "product_id", "score", "helpful_num", "helpful_den", "length")


def token_rows(ix: Index) -> DataFrame:
    return ix.reviews.select("review_id", F.posexplode(tokens("text")).alias("pos", "term")).select("review_id", F.col("pos").cast("long"), "term")


def dgap_rows(ix: Index) -> DataFrame:
    return G.gaps(ix.chunks)


def gap_prefix_sum(ix: Index) -> DataFrame:
    """Gaps, then ids again from gaps and what stands before a chunk alone."""
    return G.ids(G.gap_lists(ix.chunks)).select("term", "seq", "review_id")


def posting_list_array(ix: Index) -> DataFrame:
    """Whole lists of a few terms as text, put together from their chunks."""
    parts = lookup.posting_lists(ix, SEEN).select("term", "chunk", F.array_join(F.transform("list", lambda x: x.cast("string")), ",").alias("part"))
    return parts.groupBy("term").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "part"))), lambda x: x["part"]), ",").alias("list"))


def posting_chunks(ix: Index) -> DataFrame:
    """Every list in chunks with what skips and enters them."""
    joined = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return ix.chunks.select("term", "chunk", "first_id", "last_id", "n", "cf", "max_tf", F.col("min_length").cast("long").alias("min_length"), F.round("max_ratio", 12).alias("max_ratio"), "before", "previous", joined("ids").alias("ids"), joined("tfs").alias("tfs"))


def gamma_codes(ix: Index) -> DataFrame:
    return ix.postings.groupBy("tf").agg(F.count("*").alias("n")).select("tf", "n", gamma_encode(F.col("tf")).alias("code"))


def gamma_roundtrip(ix: Index) -> DataFrame:
    coded = G.gaps(ix.chunks).select("term", "review_id", gamma_encode(F.col("gap")).alias("code"))
    return coded.groupBy(gamma_decode(F.col("code")).alias("gap")).agg(F.count("*").alias("n"), F.max(F.length("code")).cast("long").alias("bits"))


def _coded(ix: Index) -> DataFrame:
    block = F.floor(F.col("term_id") / TERM_BLOCK)
    rows = ix.lexicon.withColumn("block", block)
    rows = rows.withColumn("previous", F.lag("term").over(Window.partitionBy("block").orderBy("term_id")))
    prefix, rest = front_encode(F.col("term_id"), F.col("term"), F.col("previous"), TERM_BLOCK)
    return rows.select("term_id", "block", "term", prefix.cast("long").alias("prefix"), rest.alias("rest"))


def front_coding(ix: Index) -> DataFrame:
    return _coded(ix).select("term_id", "prefix", "rest")


def front_decoding(ix: Index) -> DataFrame:
    """Terms again, from prefixes and rests alone."""
    lists = _coded(ix).groupBy("block").agg(F.array_sort(F.collect_list(F.struct("term_id", F.col("prefix").cast("int").alias("prefix"), "rest"))).alias("coded"))
    return lists.select(F.posexplode(front_decode(F.col("coded"))).alias("pos", "term"), "block").select((F.col("block") * TERM_BLOCK + F.col("pos")).cast("long").alias("term_id"), "term")


def product_front_coding(ix: Index) -> DataFrame:
    before = F.lag("product_id").over(Window.partitionBy(F.floor(F.col("product_ord") / PRODUCT_BLOCK)).orderBy("product_ord"))
    rows = ix.products.withColumn("previous", before)
    prefix, rest = front_encode(F.col("product_ord"), F.col("product_id"), F.col("previous"), PRODUCT_BLOCK)
    return rows.select("product_ord", prefix.cast("long").alias("prefix"), rest.alias("rest"))


def lexicon_blocks(ix: Index) -> DataFrame:
    block = F.floor(F.col("term_id") / TERM_BLOCK).cast("long")
    return ix.lexicon.groupBy(block.alias("block")).agg(F.min("term").alias("head"), F.count("*").alias("n"))


def _weights(ix: Index) -> DataFrame:
    w = rank.query_weights(ix, [*REPEATED, "anly", "notaword"])
    return w.select("term", "qtf", "df", F.round("weight", 9).alias("weight"), F.round("unit", 9).alias("unit"))


def _language(query: Sequence[str], lam: float) -> Callable[[Index], DataFrame]:
    return lambda ix: rank.language_model(ix, query, lam, K).select("review_id", F.when(F.col("score") > 0, F.round(F.log10("score"), 7)).alias("log_score"))


def vsm_zero_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over the reviews that have the term, its df is N."""
    reviews = from_documents(spark, sf_dir).where(F.array_contains(tokens("text"), "worthless"))
    return rank.vector_space(build(reviews), ["worthless"], K)


def lm_lambda_edges(ix: Index) -> DataFrame:
    parts = [rank.language_model(ix, PLAIN, lam, K).select(F.lit(lam).alias("lam"), "review_id", F.when(F.col("score") > 0, F.round(F.log10("score"), 7)).alias("log_score")) for lam in (0.0, 1.0)]
    return parts[0].unionByName(parts[1])


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, source, text, stars, num, den; what raw files are made of."""
    d, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    stars = F.coalesce(F.when(F.col("quality") == 1, 5).when(F.col("quality") == 0, 2), 1 + F.col("doc_id") % 5)
    return d.join(labels, "doc_id", "left").select("doc_id", "source", "text", stars.alias("stars"), (F.col("doc_id") % 7).alias("num"), (F.col("n_chars") % 11).alias("den"))


def _one_line() -> Column:
    """Put behind the exchange by ranges, which runs what stands before it twice."""
    return F.replace(F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit(" ")), F.lit("\r"), F.lit(" "))


def _raw_file(spark: SparkSession, sf_dir: str) -> str:
    """The documents as a folder of raw review files, in the shared folder: fields that are skipped, helpfulness unsorted, one line a text."""
    lines = F.concat(F.lit("product/productId: "), "source", F.lit("\nreview/userId: U"), "doc_id", F.lit("\nreview/helpfulness: "), "num", F.lit("/"), "den", F.lit("\nreview/score: "), "stars", F.lit(".0\nreview/summary: skipped\nreview/text: "), _one_line(), F.lit("\n"))
    rows = lambda: _labelled(spark, sf_dir).repartitionByRange("doc_id").sortWithinPartitions("doc_id").select(lines.alias("value"))
    return _once(spark, ("raw", sf_dir), lambda path: rows().write.text(path))


def raw_malformed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S1, X3, X4 where records are broken: by id, a field is missing, malformed, without a value or there twice, or lines end with both signs."""
    case = F.col("doc_id") % 8
    fields = [
        F.concat(F.lit("product/productId: "), "source"),
        F.when(case != 1, F.concat(F.lit("review/helpfulness: "), F.when(case == 2, F.lit("two/3")).when(case == 3, F.lit("4")).otherwise(F.concat("num", F.lit("/"), "den")))),
        F.when(case == 4, F.lit("review/helpfulness: 1/1")),
        F.when(case != 5, F.concat(F.lit("review/score: "), F.when(case == 6, F.lit("good")).otherwise(F.concat("stars", F.lit(".0"))))),
        F.lit("anything else: 1"),
        F.when(case == 7, F.lit("review/text:")).when(case != 3, F.concat(F.lit("review/text: "), _one_line())),
        F.when(case == 4, F.lit("review/text: a second text")),
        F.lit("product: no record begins here"),
    ]
    end = F.when(F.col("doc_id") % 3 == 0, F.lit("\r\n")).otherwise(F.lit("\n"))
    value = F.concat(F.array_join(F.array_compact(F.array(*fields)), "\u0001"), F.lit("\u0001"))
    rows = lambda: _labelled(spark, sf_dir).repartitionByRange("doc_id").sortWithinPartitions("doc_id").select(F.replace(value, F.lit("\u0001"), end).alias("value"))
    path = _once(spark, ("broken", sf_dir), lambda path: rows().write.option("lineSep", "\n").text(path))
    return parse_reviews(spark, path).select("review_id", "product_id", "score", "helpful_num", "helpful_den", F.sha2("text", 256).alias("text_sha256"))


def raw_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parsed again."""
    parsed = parse_reviews(spark, _raw_file(spark, sf_dir))
    return parsed.select("review_id", "product_id", "score", "helpful_num", "helpful_den", F.sha2("text", 256).alias("text_sha256"))


def _raw_index(spark: SparkSession, sf_dir: str) -> str:
    return _once(spark, ("raw-index", sf_dir), lambda path: write(parse_reviews(spark, _raw_file(spark, sf_dir)), path))


def raw_index_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parsed, written, opened and read."""
    ix = open_index(spark, _raw_index(spark, sf_dir))
    return ix.reviews.select("review_id", "product_id", "score", "helpful_num", "helpful_den", F.col("length").cast("long").alias("length"))


def raw_index_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lexicon that the written postings add up to."""
    ix = open_index(spark, _raw_index(spark, sf_dir))
    sums = ix.postings.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))
    return ix.lexicon.select("term_id", "term").join(sums, "term").select("term_id", "term", "df", "cf")


def index_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts of an index, and whether one is there after it has been deleted."""
    path = _new_path(spark, "deleted")
    r = write(parse_reviews(spark, _raw_file(spark, sf_dir)), path).stats.first()
    delete(spark, path)
    try:
        open_index(spark, path)
        there = True
    except FileNotFoundError:
        there = False
    return spark.createDataFrame([(r.n_terms, r.n_reviews, r.n_tokens, there)], "n_terms long, n_reviews long, n_tokens long, there boolean")


def _turns(f: Callable[[Index], DataFrame]) -> Query:
    return _stored(f, "turns", from_conversations)


QUERIES: dict[str, Query] = {
    "review_lookup": _stored(review_lookup),
    "review_lengths": _over(lambda ix: ix.reviews.select("review_id", F.col("length").cast("long").alias("length"))),
    "product_of_review": _over(lambda ix: ix.reviews.select("review_id", "product_id")),
    "helpfulness_normalized": _over(lambda ix: ix.reviews.select("review_id", "score", "helpful_num", "helpful_den")),
    "tokens": _over(token_rows),
    "postings": _over(lambda ix: ix.postings),
    "posting_list_array": _stored(posting_list_array),
    "posting_chunks": _stored(posting_chunks),
    "posting_lookup": _stored(lambda ix: lookup.postings(ix, "The").select("review_id", "tf")),
    "token_frequency": _over(lambda ix: terms_of(ix.entries).select("term", "df")),
    "token_collection_frequency": _over(lambda ix: terms_of(ix.entries).select("term", "cf")),
    "corpus_stats": _over(lambda ix: ix.stats),
    "lexicon": _ranked(lambda ix: ix.lexicon),
    "products": _over(lambda ix: ix.products.select("product_ord", "product_id", "n_reviews")),
    "product_reviews": _over(lambda ix: ix.product_reviews.groupBy("product_id").agg(F.array_sort(F.collect_list("review_id")).alias("ids")).select("product_id", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("review_ids"))),
    "product_review_rows": _over(lambda ix: ix.product_reviews),
    "product_reviews_lookup": _stored(lambda ix: lookup.product_reviews(ix, "src3")),
    "product_review_counts": _over(lambda ix: ix.reviews.groupBy("product_id").agg(F.count("*").alias("n_reviews"))),
    "dgaps": _stored(dgap_rows),
    "gap_prefix_sum": _stored(gap_prefix_sum),
    "gamma_codes": _over(gamma_codes),
    "gamma_roundtrip": _stored(gamma_roundtrip),
    "front_coding": _ranked(front_coding),
    "front_decoding": _ranked(front_decoding),
    "product_front_coding": _over(product_front_coding),
    "lexicon_blocks": _ranked(lexicon_blocks),
    "candidates": _stored(lambda ix: rank.candidates(ix, ["anly", "worthless", "notaword"])),
    "query_weights": _stored(_weights),
    "vsm_topk": _stored(lambda ix: rank.vector_space(ix, PLAIN, K)),
    "vsm_duplicate_terms": _stored(lambda ix: rank.vector_space(ix, REPEATED, K)),
    "vsm_zero_norm": vsm_zero_norm,
    "lm_topk": _stored(_language(PLAIN, 0.5)),
    "lm_lambda_edges": _stored(lm_lambda_edges),
    "lm_unknown_term": _stored(_language(UNKNOWN, 0.5)),
    "lm_repeated_term": _stored(_language(REPEATED, 0.3)),
    "product_search": _stored(lambda ix: rank.product_search(ix, PLAIN, 5)),
    "product_search_exact_ratio": _stored(lambda ix: rank.product_search(ix, PLAIN, 5, exact_ratio=True)),
    "raw_reviews": raw_reviews,
    "raw_malformed": raw_malformed,
    "raw_index_reviews": raw_index_reviews,
    "raw_index_lexicon": raw_index_lexicon,
    "index_delete": index_delete,
    "conversation_postings": _turns(lambda ix: ix.postings),
    "conversation_lexicon": _turns(lambda ix: ix.lexicon),
    "conversation_vsm_topk": _turns(lambda ix: rank.vector_space(ix, PLAIN, K)),
}

_DOCS = """
reviews AS (
  SELECT d.doc_id + 1 AS review_id, d.source AS product_id, lower(d.text) AS text,
    CAST(coalesce(CASE l.quality WHEN 1 THEN 5 WHEN 0 THEN 2 END, 1 + d.doc_id % 5) AS INTEGER) AS score,
    CAST(least(d.doc_id % 7, d.n_chars % 11) AS INTEGER) AS helpful_num, CAST(greatest(d.doc_id % 7, d.n_chars % 11) AS INTEGER) AS helpful_den
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)"""
_RAW = _DOCS.replace("d.doc_id + 1 AS review_id", "row_number() OVER (ORDER BY d.doc_id) AS review_id").replace("lower(d.text)", "lower(translate(coalesce(d.text, ''), chr(10) || chr(13), '  '))")
_TURNS = """
reviews AS (SELECT row_number() OVER (ORDER BY conv_id, turn) AS review_id, CAST(conv_id AS VARCHAR) AS product_id, lower(text) AS text FROM conversations)"""
_INDEX = """,
words AS (SELECT review_id, product_id, coalesce(regexp_extract_all(text, '[a-z0-9]+'), []) AS ws FROM reviews),
lengths AS (SELECT review_id, len(ws) AS length FROM words),
postings AS (SELECT term, review_id, count(*) AS tf FROM (SELECT review_id, unnest(ws) AS term FROM words) GROUP BY term, review_id),
lexicon AS (SELECT row_number() OVER (ORDER BY term) - 1 AS term_id, term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM postings GROUP BY term),
stats AS (SELECT (SELECT count(*) FROM lexicon) AS n_terms, count(*) AS n_reviews, CAST(coalesce(sum(length), 0) AS BIGINT) AS n_tokens FROM lengths),
products AS (SELECT row_number() OVER (ORDER BY product_id) - 1 AS product_ord, product_id, list(review_id ORDER BY review_id) AS review_ids, count(*) AS n_reviews FROM reviews GROUP BY product_id),
gaps AS (SELECT term, review_id, review_id - lag(review_id, 1, 0) OVER (PARTITION BY term ORDER BY review_id) AS gap FROM postings)"""


def _values(words: Sequence[str]) -> str:
    return ", ".join(f"({i}, '{w.lower()}')" for i, w in enumerate(words))


def _list(words: Sequence[str]) -> str:
    return ", ".join(f"'{w.lower()}'" for w in words)


def _gamma(n: str) -> str:
    return f"repeat('1', length(bin({n})) - 1) || '0' || substr(bin({n}), 2)"


def _query(words: Sequence[str]) -> str:
    return f"""
q AS (SELECT term, count(*) AS qtf FROM (VALUES {_values(words)}) AS v(pos, term) GROUP BY term),
qw AS (SELECT q.term, qtf, coalesce(df, 0) AS df, CASE WHEN df > 0 THEN (1 + log10(qtf)) * log10(n_reviews / df) ELSE 0.0 END AS weight FROM q LEFT JOIN lexicon ON q.term = lexicon.term, stats),
norm AS (SELECT sqrt(sum(weight * weight)) AS norm FROM qw),
unit AS (SELECT qw.*, CASE WHEN norm > 0 THEN weight / norm END AS unit FROM qw, norm)"""


def _fold(value: str, order: str) -> str:
    """The sum in a fixed order: scores that aren't rounded decide the ranks."""
    return f"list_reduce(list_prepend(CAST(0.0 AS DOUBLE), list(CAST({value} AS DOUBLE) ORDER BY {order})), lambda a, y: a + y)"


def _vsm(words: Sequence[str], reviews: str = _DOCS) -> str:
    return f"""WITH {reviews}{_INDEX},{_query(words)}
SELECT review_id, round(raw, 9) AS score FROM (
  SELECT review_id, {_fold("coalesce((1 + log10(tf)) * unit, 0.0)", "unit.term")} AS raw FROM postings JOIN unit ON postings.term = unit.term GROUP BY review_id ORDER BY raw DESC, review_id LIMIT {K})"""


def _lm(words: Sequence[str], lam: float, k: int) -> str:
    return f"""(SELECT review_id, list_reduce(list_prepend(CAST(1.0 AS DOUBLE), list(f ORDER BY pos)), lambda a, y: a * y) AS score FROM (
  SELECT c.review_id, v.pos, CAST({lam} AS DOUBLE) * coalesce(p.tf, 0) / l.length + CAST({1.0 - lam} AS DOUBLE) * coalesce(x.cf, 0) / s.n_tokens AS f
  FROM (SELECT DISTINCT review_id FROM postings WHERE term IN ({_list(words)})) c CROSS JOIN (VALUES {_values(words)}) AS v(pos, term)
  JOIN lengths l ON l.review_id = c.review_id LEFT JOIN postings p ON p.review_id = c.review_id AND p.term = v.term LEFT JOIN lexicon x ON x.term = v.term, stats s)
 GROUP BY review_id ORDER BY score DESC, review_id LIMIT {k})"""


_LOG = "CASE WHEN score > 0 THEN round(log10(score), 7) END AS log_score"


def _products(exact: bool) -> str:
    q = (lambda a, b: f"CAST({a} AS DOUBLE) / {b}") if exact else (lambda a, b: f"floor({a} / {b})")
    return f"""WITH {_DOCS}{_INDEX}
SELECT product_id, round(raw, 9) AS score FROM (
  SELECT r.product_id, {_fold(f"0.5 * {q('r.score', '5')} + 0.3 * CASE WHEN helpful_den > 0 THEN helpful_num / helpful_den ELSE 0 END + 0.2 * {q('p.n_reviews', 's.n_reviews')}", "r.review_id")} AS raw
  FROM {_lm(PLAIN, 0.5, 20)} b JOIN reviews r ON r.review_id = b.review_id JOIN products p ON p.product_id = r.product_id, stats s
  GROUP BY r.product_id ORDER BY raw DESC, r.product_id LIMIT 5)"""


def _select(body: str, reviews: str = _DOCS) -> str:
    return f"WITH {reviews}{_INDEX}\n{body}"



def _front(table: str, ordinal: str, column: str, block: int) -> str:
    return f"""WITH {_DOCS}{_INDEX},
p AS (SELECT {ordinal}, {column} AS x, CASE WHEN {ordinal} % {block} > 0 THEN lag({column}) OVER (ORDER BY {ordinal}) END AS prev FROM {table}),
c AS (SELECT {ordinal}, x, CASE WHEN prev IS NULL THEN 0 ELSE len(list_filter(range(1, least(length(prev), length(x)) + 1), lambda i: substr(prev, 1, i) = substr(x, 1, i))) END AS prefix FROM p)
SELECT {ordinal}, CAST(prefix AS BIGINT) AS prefix, substr(x, CAST(prefix + 1 AS BIGINT)) AS rest FROM c"""


SQL: dict[str, str] = {
    "review_lookup": _select(f"SELECT r.review_id, product_id, score, helpful_num, helpful_den, CAST(length AS INTEGER) AS length FROM reviews r JOIN lengths l ON l.review_id = r.review_id WHERE r.review_id IN ({', '.join(map(str, IDS))}) AND r.review_id >= 1"),
    "review_lengths": _select("SELECT review_id, CAST(length AS BIGINT) AS length FROM lengths"),
    "product_of_review": _select("SELECT review_id, product_id FROM reviews"),
    "helpfulness_normalized": _select("SELECT review_id, score, helpful_num, helpful_den FROM reviews"),
    "tokens": _select("SELECT review_id, CAST(i - 1 AS BIGINT) AS pos, ws[i] AS term FROM (SELECT review_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM words)"),
    "postings": _select("SELECT term, review_id, tf FROM postings"),
    "posting_list_array": _select(f"SELECT term, string_agg(review_id || ',' || tf, ',' ORDER BY review_id) AS list FROM postings WHERE term IN ({_list(SEEN)}) GROUP BY term"),
    "posting_chunks": _select(f"""SELECT term, chunk, first_id, last_id, n, cf, max_tf, min_length, max_ratio, CAST(coalesce(sum(n) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before, lag(last_id, 1, 0) OVER w AS previous, ids, tfs FROM (
  SELECT term, p.review_id // {NARROW} AS chunk, min(p.review_id) AS first_id, max(p.review_id) AS last_id, count(*) AS n, CAST(sum(tf) AS BIGINT) AS cf, max(tf) AS max_tf, CAST(min(length) AS BIGINT) AS min_length, round(max(tf / length), 12) AS max_ratio,
    string_agg(CAST(p.review_id AS VARCHAR), ',' ORDER BY p.review_id) AS ids, string_agg(CAST(tf AS VARCHAR), ',' ORDER BY p.review_id) AS tfs
  FROM postings p JOIN lengths l ON l.review_id = p.review_id GROUP BY term, p.review_id // {NARROW}) WINDOW w AS (PARTITION BY term ORDER BY chunk)"""),
    "posting_lookup": _select("SELECT review_id, tf FROM postings WHERE term = 'the'"),
    "token_frequency": _select("SELECT term, df FROM lexicon"),
    "token_collection_frequency": _select("SELECT term, cf FROM lexicon"),
    "corpus_stats": _select("SELECT n_terms, n_reviews, n_tokens FROM stats"),
    "lexicon": _select("SELECT term_id, term, df, cf FROM lexicon"),
    "products": _select("SELECT product_ord, product_id, n_reviews FROM products"),
    "product_reviews": _select("SELECT product_id, array_to_string(review_ids, ',') AS review_ids FROM products"),
    "product_review_rows": _select("SELECT product_id, review_id FROM reviews"),
    "product_reviews_lookup": _select("SELECT review_id FROM reviews WHERE product_id = 'src3'"),
    "product_review_counts": _select("SELECT product_id, count(*) AS n_reviews FROM reviews GROUP BY product_id"),
    "dgaps": _select("SELECT term, review_id, gap FROM gaps"),
    "gap_prefix_sum": _select("SELECT term, row_number() OVER (PARTITION BY term ORDER BY review_id) - 1 AS seq, review_id FROM postings"),
    "gamma_codes": _select(f"SELECT tf, count(*) AS n, {_gamma('tf')} AS code FROM postings GROUP BY tf"),
    "gamma_roundtrip": _select(f"SELECT gap, count(*) AS n, CAST(max(length({_gamma('gap')})) AS BIGINT) AS bits FROM gaps GROUP BY gap"),
    "front_coding": _front("lexicon", "term_id", "term", TERM_BLOCK),
    "front_decoding": _select("SELECT term_id, term FROM lexicon"),
    "product_front_coding": _front("products", "product_ord", "product_id", PRODUCT_BLOCK),
    "lexicon_blocks": _select(f"SELECT term_id // {TERM_BLOCK} AS block, min(term) AS head, count(*) AS n FROM lexicon GROUP BY 1"),
    "candidates": _select(f"SELECT DISTINCT review_id FROM postings WHERE term IN ({_list(['anly', 'worthless', 'notaword'])})"),
    "query_weights": f"WITH {_DOCS}{_INDEX},{_query([*REPEATED, 'anly', 'notaword'])}\nSELECT term, qtf, df, round(weight, 9) AS weight, round(unit, 9) AS unit FROM unit",
    "vsm_topk": _vsm(PLAIN),
    "vsm_duplicate_terms": _vsm(REPEATED),
    "vsm_zero_norm": _vsm(["worthless"], _DOCS.replace("reviews AS (", "every AS (", 1) + ",\nreviews AS (SELECT * FROM every WHERE list_contains(regexp_extract_all(text, '[a-z0-9]+'), 'worthless'))"),
    "lm_topk": _select(f"SELECT review_id, {_LOG} FROM {_lm(PLAIN, 0.5, K)}"),
    "lm_lambda_edges": _select(" UNION ALL ".join(f"SELECT CAST({lam} AS DOUBLE) AS lam, review_id, {_LOG} FROM {_lm(PLAIN, lam, K)}" for lam in (0.0, 1.0))),
    "lm_unknown_term": _select(f"SELECT review_id, {_LOG} FROM {_lm(UNKNOWN, 0.5, K)}"),
    "lm_repeated_term": _select(f"SELECT review_id, {_LOG} FROM {_lm(REPEATED, 0.3, K)}"),
    "product_search": _products(False),
    "product_search_exact_ratio": _products(True),
    "raw_reviews": _select("SELECT review_id, product_id, score, helpful_num, helpful_den, sha256(text) AS text_sha256 FROM reviews", _RAW),
    "raw_malformed": _select("""SELECT review_id, product_id, CASE WHEN doc_id % 8 NOT IN (5, 6) THEN score END AS score, CASE WHEN doc_id % 8 NOT IN (1, 2, 3) THEN helpful_num END AS helpful_num, CASE WHEN doc_id % 8 NOT IN (1, 2, 3) THEN helpful_den END AS helpful_den,
  CASE doc_id % 8 WHEN 3 THEN NULL WHEN 7 THEN sha256('') ELSE sha256(text) END AS text_sha256 FROM reviews""", _RAW.replace("SELECT d.doc_id", "SELECT d.doc_id", 1).replace("AS review_id,", "AS review_id, d.doc_id,", 1)),
    "raw_index_reviews": _select("SELECT r.review_id, product_id, score, helpful_num, helpful_den, CAST(length AS BIGINT) AS length FROM reviews r JOIN lengths l ON l.review_id = r.review_id", _RAW),
    "raw_index_lexicon": _select("SELECT term_id, term, df, cf FROM lexicon", _RAW),
    "index_delete": _select("SELECT n_terms, n_reviews, n_tokens, false AS there FROM stats", _RAW),
    "conversation_postings": _select("SELECT term, review_id, tf FROM postings", _TURNS),
    "conversation_lexicon": _select("SELECT term_id, term, df, cf FROM lexicon", _TURNS),
    "conversation_vsm_topk": _vsm(PLAIN, _TURNS),
}
