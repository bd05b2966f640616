import pytest
from pyspark.sql import types as T

#: Columns whose names operators use themselves, and one that differs from another in case alone.
SCHEMA = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType())]
    + [T.StructField(n, T.StringType()) for n in ("row", "found", "id", "n", "size", "shard", "copies", "score", "TEXT")]
)


def table(spark, rows):
    """rows: (doc_id, text, lang, source)."""
    return spark.createDataFrame([(*r, *["x"] * (len(SCHEMA) - 4)) for r in rows], SCHEMA)


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and blank texts, repeated rows, ties, a long text, names that clash."""
    long = " ".join(f"Word{i % 977}" for i in range(60_000))
    rows = [(1, None, "en", "a"), (2, "", "en", None), (3, " \n ", None, "b"), (4, "same text here again", "en", "a"), (5, "same text here again", "en", "a"), (5, "same text here again", "en", "a"), (6, long, "en", "b"), (7, "123 456", None, None), (None, "same text here again", "en", "a"), (8, "été à la plage", "fr", "c")]
    return table(spark, rows).cache(), rows


@pytest.fixture(scope="session")
def empty(spark):
    return table(spark, []).cache()
