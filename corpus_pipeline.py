"""The training-data pipeline: toxicity, near-duplicates, pseudonyms, the mix, and tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last keep the
columns of ``documents``.  A stage's result is written as Parquet and reread by the next.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from stackweave.llm import bpe, mixing, pii, simhash, toxicity
from stackweave.llm.common import shared_dir
from stackweave.llm.queries import PII_KEY, RANKS


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine does not reject."""
    return toxicity.keep_clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group: the one with the smallest id."""
    return simhash.one_of_each(docs)


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal numbers, dates and addresses under pseudonyms."""
    return pii.pseudonymize(docs, PII_KEY)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights take them."""
    return mixing.mixed_rows(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of each document.

    Bundles are smaller than the operator's own: executors still hold the earlier stages' workers.
    """
    return bpe.encode_texts(docs, RANKS, public_tokenizers.PATTERN, max_words=1 << 16, max_codes=1 << 20)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash", one_of_near_copies),
    ("pii", hide_personal_data),
    ("mixing", mix_sources),
    ("bpe", tokenize),
]

#: A learnt classifier and connected components are not SQL: tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and reread."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
