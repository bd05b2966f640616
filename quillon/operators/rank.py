"""Ranked searches. Query words are lower-cased, not cut into tokens.

Candidates carry the few counts of the query's terms, and postings carry their reviews' lengths, so nothing is crossed with the
query or joined by review. Sums and products fold in a fixed order, so equal input gives equal scores.

A stored index is searched in two phases. Chunks of all terms are cut at the same ids, so their greatest counts bound what any
review of a range of ids can score. The best ranges are scored first; their k-th score is a threshold that the result
reaches. Then only ranges whose bound reaches it are read, or whose bound equals it and whose ids are small enough to win the
tie. Bounds are a billionth larger than computed, far more than rounding can be. The driver gets a row a term, the k best of
the first ranges, and numbers of at most PUSHED ranges, which the scan then gets as a filter; more ranges are joined.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.index import Index, entries_in

LAMBDA, POOL = 0.5, 4
SCORE_PART, HELPFUL_PART, COUNT_PART = 0.5, 0.3, 0.2
#: Ranges that are scored first, at least; ranges that the scan gets as a filter; results that are kept on the driver, each at most.
SEEDS, PUSHED, MOST_KEPT = 8, 4096, 10_000
SLACK = 1 + 1e-9


def _terms(query: Sequence[str]) -> list[str]:
    return [w.lower() for w in query]


def query_postings(index: Index, query: Sequence[str]) -> DataFrame:
    """The filter on terms reaches the scan."""
    return index.postings.where(F.col("term").isin(sorted(set(_terms(query)))))


def candidates(index: Index, query: Sequence[str]) -> DataFrame:
    """U1."""
    return query_postings(index, query).select("review_id").distinct()


def query_weights(index: Index, query: Sequence[str]) -> DataFrame:
    """term, qtf, df, weight (before the norm), norm and unit (weight / norm, null where the norm is 0)."""
    spark = index.reviews.sparkSession
    counts = sorted(Counter(_terms(query)).items())
    given = F.array(*[F.struct(F.lit(t).alias("term"), F.lit(n).alias("qtf")) for t, n in counts]).cast("array<struct<term:string,qtf:bigint>>")
    q = spark.range(0, 1, 1, 1).select(F.inline(given))  # a constant: no job for the query itself
    known = index.lexicon.where(F.col("term").isin([t for t, _ in counts])).select("term", "df")
    n = index.stats.select("n_reviews")
    w = F.when(F.col("df") > 0, (1 + F.log10("qtf")) * F.log10(F.col("n_reviews") / F.col("df"))).otherwise(F.lit(0.0))
    rows = q.join(known, "term", "left").crossJoin(F.broadcast(n)).select("term", "qtf", F.coalesce("df", F.lit(0)).alias("df"), w.alias("weight"))
    squares = F.transform(F.array_sort(F.collect_list(F.struct("term", "weight"))), lambda x: x["weight"] * x["weight"])
    norm = rows.agg(F.sqrt(F.aggregate(squares, F.lit(0.0), lambda a, x: a + x)).alias("norm"))
    return rows.crossJoin(F.broadcast(norm)).withColumn("unit", F.try_divide("weight", F.nullif("norm", F.lit(0.0))))


def _top(scored: DataFrame, k: int) -> DataFrame:
    return scored.orderBy(F.desc("score"), "review_id").limit(k)


def id_ranges(index: Index, terms: list[str], bound: Callable[[Column], Column]) -> DataFrame:
    """chunk, first_id, n (postings) and bound of the ranges of ids that have a term. bound: over a map of term to its greatest tf and tf / length."""
    rows = index.chunks.where(F.col("term").isin(sorted(set(terms)))).select("term", "chunk", "first_id", "n", "max_tf", "max_ratio")
    per = rows.groupBy("chunk").agg(F.min("first_id").alias("first_id"), F.sum("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("term", F.struct("max_tf", "max_ratio")))).alias("greatest"))
    return per.select("chunk", "first_id", "n", (bound(F.col("greatest")) * SLACK).alias("bound"))


def _best(index: Index, terms: list[str], scored: Callable[[DataFrame], DataFrame], bound: Callable[[Column], Column] | None, k: int) -> DataFrame:
    """The k best of scored(entries of the terms), of which all ranges or those that can matter are read."""
    wanted = F.col("term").isin(sorted(set(terms)))
    seeds_wanted = max(k, SEEDS)
    if bound is None or index.n_reviews is None or index.n_reviews // index.chunk < seeds_wanted or not 0 < k <= MOST_KEPT:
        return _top(scored(index.entries.where(wanted)), k)
    ranges, chunks = id_ranges(index, terms, bound), index.chunks.where(wanted)
    number = F.col("chunk")
    first = [r.chunk for r in ranges.orderBy(F.desc("bound"), "chunk").limit(seeds_wanted).select("chunk").collect()]
    best = _top(scored(entries_in(chunks.where(number.isin(first)))), k)
    if len(first) < seeds_wanted:
        return best
    kept = best.collect()
    if len(kept) == k:
        least = kept[-1]
        ranges = ranges.where((F.col("bound") > least.score) | ((F.col("bound") == least.score) & (F.col("first_id") < least.review_id)))
    others = ranges.where(~number.isin(first)).select("chunk")
    pushed = [r.chunk for r in others.limit(PUSHED + 1).collect()]
    if len(pushed) <= PUSHED:
        return _top(scored(entries_in(chunks.where(number.isin(first + pushed)))), k)
    return _top(scored(entries_in(chunks.join(ranges.select("chunk"), "chunk", "left_semi"))), k)  # the first ranges are among them


def vector_space(index: Index, query: Sequence[str], k: int) -> DataFrame:
    """R1, lnn.ltc: review_id, score (9 decimals), the k best by the score before it is rounded; with a norm of 0 scores are 0 and ids decide."""
    if not query:
        return index.entries.where("false").select("review_id", F.lit(0.0).alias("score"))
    units = {r.term: r.unit or 0.0 for r in query_weights(index, query).select("term", "unit").collect()}
    table = F.create_map(*[F.lit(x) for pair in sorted(units.items()) for x in pair])

    def scored(entries: DataFrame) -> DataFrame:
        parts = entries.select("review_id", "term", ((1 + F.log10("tf")) * F.element_at(table, F.col("term"))).alias("x"))
        ordered = F.transform(F.array_sort(F.collect_list(F.struct("term", "x"))), lambda s: s["x"])
        return parts.groupBy("review_id").agg(F.aggregate(ordered, F.lit(0.0), lambda a, x: a + x).alias("score"))

    def bound(greatest: Column) -> Column:
        parts = [F.coalesce((1 + F.log10(F.try_element_at(greatest, F.lit(t))["max_tf"])) * u, F.lit(0.0)) for t, u in sorted(units.items())]
        return F.aggregate(F.array(*parts), F.lit(0.0), lambda a, x: a + x)

    return _best(index, list(units), scored, bound, k).select("review_id", F.round("score", 9).alias("score"))


def language_model(index: Index, query: Sequence[str], lam: float, k: int) -> DataFrame:
    """R2: review_id, score, the k best. A repeated word counts again; a word that no review has makes all scores 0. Weights outside 0 to 1 have no bounds, so all is read."""
    terms = _terms(query)
    if not terms:
        return index.entries.where("false").select("review_id", F.lit(0.0).alias("score"))
    known = index.lexicon.where(F.col("term").isin(sorted(set(terms)))).select("term", "cf").crossJoin(F.broadcast(index.stats.select("n_tokens"))).collect()
    common = {r.term: (r.cf, r.n_tokens) for r in known}
    rest = {t: (1.0 - lam) * common[t][0] / common[t][1] if t in common else 0.0 for t in terms}

    def product(factor: Callable[[str], Column]) -> Column:
        return F.aggregate(F.array(*[factor(t) for t in terms]), F.lit(1.0), lambda a, x: a * x)

    def scored(entries: DataFrame) -> DataFrame:
        own = entries.groupBy("review_id").agg(F.first("length").alias("length"), F.map_from_entries(F.collect_list(F.struct("term", "tf"))).alias("tfs"))
        tf = lambda t: F.coalesce(F.try_element_at("tfs", F.lit(t)), F.lit(0))
        return own.select("review_id", product(lambda t: F.lit(lam) * tf(t) / F.col("length") + F.lit(rest[t])).alias("score"))

    def bound(greatest: Column) -> Column:
        return product(lambda t: F.lit(lam) * F.coalesce(F.try_element_at(greatest, F.lit(t))["max_ratio"], F.lit(0.0)) + F.lit(rest[t]))

    return _best(index, terms, scored, bound if 0 <= lam <= 1 else None, k)


def product_search(index: Index, query: Sequence[str], k: int, exact_ratio: bool = False) -> DataFrame:
    """product_id, score, the k best by the sum over their reviews among the best 4k. Stars and review counts enter as
    whole quotients unless exact_ratio. The ids of a pool that the driver holds, and their products, are filters of the scans."""
    best = language_model(index, query, LAMBDA, POOL * k).select("review_id")
    products = index.products.select("product_id", "n_reviews")
    if POOL * k <= MOST_KEPT:
        reviews = index.reviews.where(F.col("review_id").isin([r.review_id for r in best.collect()])).select("review_id", "product_id", "score", "helpful_num", "helpful_den")
        products = products.where(F.col("product_id").isin([r.product_id for r in reviews.where("product_id is not null").select("product_id").distinct().collect()]))
    else:
        reviews = best.join(index.reviews, "review_id")
    rows = reviews.join(products, "product_id").crossJoin(F.broadcast(index.stats.select(F.col("n_reviews").alias("n_all"))))
    quotient = (lambda a, b: F.col(a) / b) if exact_ratio else (lambda a, b: F.floor(F.col(a) / b).cast("double"))
    num, den = F.least("helpful_num", "helpful_den"), F.greatest("helpful_num", "helpful_den")
    helpful = F.when(den > 0, num / den).otherwise(F.lit(0.0))
    score = F.lit(SCORE_PART) * quotient("score", F.lit(5)) + F.lit(HELPFUL_PART) * helpful + F.lit(COUNT_PART) * quotient("n_reviews", F.col("n_all"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("review_id", F.coalesce(score, F.lit(0.0)).alias("x")))), lambda s: s["x"])
    total = rows.groupBy("product_id").agg(F.aggregate(ordered, F.lit(0.0), lambda a, x: a + x).alias("score"))
    return total.orderBy(F.desc("score"), "product_id").limit(k).select("product_id", F.round("score", 9).alias("score"))
