"""A training corpus from ``documents``: five stages, each by one of the operators.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; :func:`run` writes it as Parquet in
the session's shared folder and reads it again as the next stage's docs. All but the last return
the columns of ``documents``; the last returns the documents' places in the token shards.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from chirpline.llm import decontaminate as benchmark_search
from chirpline.llm import mixing, neardup, quality, token_files
from chirpline.llm.common import cut, table


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the neighbours' vote rejects go."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one of lowest doc_id."""
    return neardup.keep_one(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark passages, by the contamination rule, go."""
    return benchmark_search.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are repeated to their target weights, in shuffled order."""
    return mixing.resample(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in packed shards; per document its place and checksum, read back from them."""
    return token_files.token_files(docs)


STAGES = [
    ("good_quality", good_quality),
    ("near_duplicates", near_duplicates),
    ("decontaminated", decontaminated),
    ("mixed", mixed),
    ("tokens", tokens),
]

#: The stages hold a trained classifier and a tokenizer's ids, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
