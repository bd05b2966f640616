"""Point look-ups as plans, and a reader that returns plain values."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.index import Index
from .rank import language_model, product_search, vector_space


def review(index: Index, review_id: int) -> DataFrame:
    """The review's row, or none; ids begin at 1."""
    return index.reviews.where((F.col("review_id") == review_id) & (F.col("review_id") >= 1))


def postings(index: Index, term: str) -> DataFrame:
    return index.postings.where(F.col("term") == term.lower()).orderBy("review_id")


def posting_lists(index: Index, terms: Sequence[str]) -> DataFrame:
    """The terms' lists as id, tf, id, tf, ... by id, a row a chunk, so that no row holds more than a chunk's postings: term, chunk, first_id, last_id, n, list."""
    rows = index.chunks.where(F.col("term").isin([t.lower() for t in terms]))
    return rows.select("term", "chunk", "first_id", "last_id", "n", F.flatten(F.transform(F.arrays_zip("ids", "tfs"), lambda s: F.array(s["ids"], s["tfs"]))).alias("list"))


def product_reviews(index: Index, product_id: str) -> DataFrame:
    """A10: the reviews of a product by id; the filter reaches the scan."""
    return index.product_reviews.where(F.col("product_id") == product_id).select("review_id").orderBy("review_id")


class Reader:
    """Look-ups with the sentinels of the command-line days: -1, None, 0 and empty iterators for what is missing."""

    def __init__(self, index: Index):
        self.index = index

    def _one(self, review_id: int, column: str, missing):
        row = review(self.index, review_id).select(column).first()
        return missing if row is None or row[0] is None else row[0]

    def product_id(self, review_id: int) -> str | None:
        return self._one(review_id, "product_id", None)

    def review_score(self, review_id: int) -> int:
        return self._one(review_id, "score", -1)

    def review_helpfulness_numerator(self, review_id: int) -> int:
        return self._one(review_id, "helpful_num", -1)

    def review_helpfulness_denominator(self, review_id: int) -> int:
        return self._one(review_id, "helpful_den", -1)

    def review_length(self, review_id: int) -> int:
        return self._one(review_id, "length", -1)

    def _term(self, term: str, column: str) -> int:
        row = self.index.lexicon.where(F.col("term") == term.lower()).select(column).first()
        return 0 if row is None else row[0]

    def token_frequency(self, term: str) -> int:
        return self._term(term, "df")

    def token_collection_frequency(self, term: str) -> int:
        return self._term(term, "cf")

    def number_of_reviews(self) -> int:
        return self.index.stats.first()["n_reviews"]

    def token_size_of_reviews(self) -> int:
        return self.index.stats.first()["n_tokens"]

    def number_of_tokens(self) -> int:
        return self.index.stats.first()["n_terms"]

    def number_of_products(self) -> int:
        return self.index.products.count()

    def reviews_with_token(self, term: str) -> Iterator[int]:
        """id, tf, id, tf, ...; partitions of a long list come one at a time."""
        for row in postings(self.index, term).select("review_id", "tf").toLocalIterator():
            yield row.review_id
            yield row.tf

    def product_reviews(self, product_id: str) -> Iterator[int]:
        """Partitions of a long list come one at a time."""
        for row in product_reviews(self.index, product_id).toLocalIterator():
            yield row.review_id

    def vector_space_search(self, query: Sequence[str], k: int) -> list[int]:
        return [r.review_id for r in vector_space(self.index, query, k).collect()]

    def language_model_search(self, query: Sequence[str], lam: float, k: int) -> list[int]:
        return [r.review_id for r in language_model(self.index, query, lam, k).collect()]

    def product_search(self, query: Sequence[str], k: int) -> list[str]:
        return [r.product_id for r in product_search(self.index, query, k).collect()]
