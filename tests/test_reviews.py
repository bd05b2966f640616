"""Raw review files: the golden corpus of six reviews, and files that are odd."""

import pytest

from quillon.operators.lookup import Reader
from quillon.operators.rank import language_model, product_search, vector_space
from quillon.plans import index as ix
from quillon.sources.reviews import parse_reviews

GOLDEN = """product/productId: B000000002
review/userId: U1
review/profileName: A
review/helpfulness: 2/3
review/score: 5.0
review/time: 1
review/summary: ignored
review/text: Great tea, GREAT price

product/productId: B000000001
review/helpfulness: 5/3
review/score: 4.7
review/text: Don't buy this tea

product/productId: B000000002
review/helpfulness: 0/0
review/score: 1.0
review/text: 

product/productId: B000000010
review/helpfulness: 1/2
review/score: 5.0
review/text: Café crème: great coffee; not tea

product/productId: B000000001
review/helpfulness: 4/4
review/score: 2.0
review/text: tea tea tea

product/productId: B000000010
review/helpfulness: 0/5
review/score: 3.0
review/text: price 2 high, coffee-2-go
"""
ROWS = [(1, "B000000002", 5, 2, 3, 4), (2, "B000000001", 4, 3, 5, 5), (3, "B000000002", 1, 0, 0, 0), (4, "B000000010", 5, 1, 2, 7), (5, "B000000001", 2, 4, 4, 3), (6, "B000000010", 3, 0, 5, 6)]


def parsed(spark, path):
    return [tuple(r) for r in parse_reviews(spark, str(path)).orderBy("review_id").collect()]


@pytest.fixture(scope="module")
def golden(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("golden")
    (at / "r.txt").write_text(GOLDEN, encoding="utf-8")
    return ix.write(parse_reviews(spark, str(at / "r.txt")), str(at / "index"))


def test_fields_and_lengths(golden):
    got = golden.reviews.select("review_id", "product_id", "score", "helpful_num", "helpful_den", "length").orderBy("review_id").collect()
    assert [tuple(r) for r in got] == ROWS


def test_lexicon(golden):
    got = {r.term: (r.term_id, r.df, r.cf) for r in golden.lexicon.collect()}
    assert list(sorted(got)) == [t for t, _ in sorted(got.items(), key=lambda x: x[1][0])] and len(got) == 15
    assert got["tea"][1:] == (4, 6) and got["great"][1:] == (2, 3) and got["2"][1:] == (1, 2) and got["caf"][1:] == (1, 1)
    assert tuple(golden.stats.first()) == (15, 6, 25)


def test_reader(golden):
    r = Reader(golden)
    assert [r.product_id(i) for i in (0, 1, 6, 7)] == [None, "B000000002", "B000000010", None]
    assert [r.review_score(i) for i in (-1, 0, 2, 7)] == [-1, -1, 4, -1]
    assert (r.review_helpfulness_numerator(2), r.review_helpfulness_denominator(2), r.review_length(3), r.review_length(9)) == (3, 5, 0, -1)
    assert (r.token_frequency("TEA"), r.token_collection_frequency("tea"), r.token_frequency("notaword"), r.token_collection_frequency("notaword")) == (4, 6, 0, 0)
    assert list(r.reviews_with_token("Tea")) == [1, 1, 2, 1, 4, 1, 5, 3] and not list(r.reviews_with_token("notaword"))
    assert list(r.product_reviews("B000000010")) == [4, 6] and not list(r.product_reviews("b000000010"))
    assert (r.number_of_reviews(), r.token_size_of_reviews(), r.number_of_tokens(), r.number_of_products()) == (6, 25, 15, 3)


@pytest.mark.parametrize(
    ("query", "expected"),
    [("Great tea", [(1, 1.566796856), (4, 1.284386951), (5, 0.511440757), (2, 0.346241553)]), ("coffee coffee great", [(4, 1.402264645), (1, 0.792857272), (6, 0.792857272)]), ("notaword", []), ("don't", [])],
)
def test_vector_space(golden, query, expected):
    assert [tuple(r) for r in vector_space(golden, query.split(), 10).collect()] == expected
    assert [tuple(r) for r in vector_space(golden, query.split(), 2).collect()] == expected[:2]
    assert vector_space(golden, query.split(), 0).collect() == []


@pytest.mark.parametrize(
    ("query", "lam", "expected"),
    [("great tea", 0.5, [(1, 0.07595), (5, 0.0372), (4, 0.025159184), (2, 0.0132)]), ("tea notaword", 0.5, [(1, 0), (2, 0), (4, 0), (5, 0)]), ("tea", 1.0, [(5, 1.0), (1, 0.25), (2, 0.2), (4, 0.142857143)])],
)
def test_language_model(golden, query, lam, expected):
    assert [(r.review_id, round(r.score, 9)) for r in language_model(golden, query.split(), lam, 10).collect()] == expected


def test_empty_query(golden):
    assert vector_space(golden, [], 3).collect() == language_model(golden, [], 0.5, 3).collect() == product_search(golden, [], 3).collect() == []


def test_product_search(golden):
    assert [tuple(r) for r in product_search(golden, ["great", "tea"], 2).collect()] == [("B000000002", 0.7), ("B000000010", 0.65)]
    assert Reader(golden).product_search(["great", "tea"], 1) == ["B000000002"]


def test_pool_is_cut_before_products(spark):
    """With k = 1 only four reviews count: five weaker reviews of b would outweigh a."""
    rows = [(i, "a", 1, 1, 1, "tea tea") for i in range(1, 3)] + [(i, "b", 1, 1, 1, "tea x y z") for i in range(3, 9)]
    index = ix.build(spark.createDataFrame(rows, "review_id long, product_id string, score int, helpful_num int, helpful_den int, text string"))
    assert product_search(index, ["tea"], 1).first().product_id == "a"


def test_missing_fields_stay_on_their_row(spark, tmp_path):
    (tmp_path / "r.txt").write_text("junk before\nproduct/productId: A\nreview/text:\n\nproduct/productId: B\nreview/helpfulness: x/y\nreview/score: z\nproduct/productId: C\nreview/score: 3.0\nreview/text: One\nline two\n")
    assert parsed(spark, tmp_path) == [(1, "A", None, None, None, ""), (2, "B", None, None, None, None), (3, "C", 3, None, None, "one")]


def test_crlf(spark, tmp_path):
    (tmp_path / "r.txt").write_bytes(GOLDEN.replace("\n", "\r\n").encode())
    assert [r[:5] for r in parsed(spark, tmp_path)] == [r[:5] for r in ROWS]


def test_ids_over_many_blocks(spark, tmp_path):
    n = 3000
    (tmp_path / "r.txt").write_text("".join(f"product/productId: P{i % 7}\nreview/score: {i % 5}.0\nreview/text: word{i}\n\n" for i in range(n)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        got = parsed(spark, tmp_path)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert [(r[0], r[1], r[2], r[5]) for r in got] == [(i + 1, f"P{i % 7}", i % 5, f"word{i}") for i in range(n)]


def test_write_refuses_and_delete_needs_an_index(spark, tmp_path):
    reviews = spark.createDataFrame([(1, "p", 5, 0, 0, "a b")], "review_id long, product_id string, score int, helpful_num int, helpful_den int, text string")
    at = str(tmp_path / "index")
    ix.write(reviews, at)
    with pytest.raises(FileExistsError):
        ix.write(reviews, at)
    with pytest.raises(FileNotFoundError):
        ix.delete(spark, str(tmp_path))
    ix.delete(spark, at)
    assert not (tmp_path / "index").exists()


def test_one_review_one_term(spark, tmp_path):
    reviews = spark.createDataFrame([(1, "p", 5, 0, 0, "a")], "review_id long, product_id string, score int, helpful_num int, helpful_den int, text string")
    index = ix.write(reviews, str(tmp_path / "index"))
    assert [tuple(r) for r in index.postings.collect()] == [("a", 1, 1)]
    assert [tuple(r) for r in vector_space(index, ["a"], 3).collect()] == [(1, 0.0)]


def test_look_ups_reach_the_scan(golden):
    plan = golden.postings.where("term = 'tea'")._jdf.queryExecution().toString()
    assert "EqualTo(term,tea)" in plan
