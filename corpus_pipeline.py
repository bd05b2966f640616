"""From raw documents to shards of a training corpus: five stages, each by one operator of quillon.llm.

language_id      drops documents without any language
near_duplicates  keeps one document of each group linked by five-word shingles at 0.8 or more: the one with the least doc_id
decontamination  drops documents that share ten words in a row, or a whole short item, with the benchmark
mixing           repeats and drops documents so that sources meet their target weights
sharding         deals the rows to 24 shards with equal counts, the copies of a text together

Every stage takes (spark, docs, sf_dir) and all but the last return the columns of docs, whatever columns those are.

Defined results: rows are the documents. Null, empty and letterless texts have no language, and the first stage drops them;
the others take them: they have no links, no hits and 0 or few words, and stay, but that mixing may take or leave those that
have words. Rows that repeat a doc_id, and rows without one, are documents of their own: of copies among them one stays,
others are rounded and dealt each for itself. An empty table gives an empty table.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import documents, last_of, stash
from quillon.llm.decontaminate import decontaminate
from quillon.llm.language_id import UNKNOWN, held_out, language_id, learn
from quillon.llm.mixing import mix, sized
from quillon.llm.ngram_join import Alike, distinct_documents
from quillon.llm.sharding import shard_documents


def detect_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = learn(docs.where(~held_out(F.col("doc_id"))))
    return language_id(docs, model).where(F.col("found.lang") != UNKNOWN).select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return distinct_documents(docs, Alike(words=5, num=80, den=100))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.where("found.n_hit = 0").select("row.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    plan = mix(stash(sized(docs), "mix-sizes"))
    taken = plan.apply(sized(docs, keep=docs.columns)).where("copies > 0")
    return taken.select("row", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int")))).select("row.*")


def deal_to_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    dealt = shard_documents(docs, shards=24, keep=[c for c in docs.columns if c != "text"])
    return dealt.select("row.*", "size", "text_crc32", "law", "shard", "slot")


STAGES = [
    ("language_id", detect_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", deal_to_shards),
]

#: Mixtures, tilted rates and label propagation can't be said in SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = documents(spark, sf_dir), []
    for name, stage in STAGES[:-1]:
        docs = last_of(spark, partial(stage, spark, docs, sf_dir), name, *before)
        before = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
