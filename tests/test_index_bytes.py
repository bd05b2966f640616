"""What searches of a stored index move and write is the index alone, and its files are small."""

import glob

import pyarrow.parquet as pq
import pytest

from quillon import catalogue
from quillon.plans import index

ROWS = [(i, f"p{i % 3}", 5, 1, 2, "the of worthless " * (i % 5) + f"w{i % 7}") for i in range(1, 200)]


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("bytes") / "ix")
    rows = spark.createDataFrame(ROWS, "review_id long, product_id string, score int, helpful_num int, helpful_den int, text string")
    return index.write(rows, path, 32), path


def test_stored_tables_are_zstd(stored):
    files = glob.glob(f"{stored[1]}/**/*.parquet", recursive=True)
    codecs = {pq.ParquetFile(f).metadata.row_group(g).column(c).compression for f in files for g in range(pq.ParquetFile(f).num_row_groups) for c in range(pq.ParquetFile(f).metadata.num_columns)}
    assert files and codecs == {"ZSTD"}


def test_gaps_of_a_stored_index_move_nothing(stored):
    plan = catalogue.dgap_rows(stored[0])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
