"""The registered queries of the ten operators, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import anchors, ann, bpe, flac, mixing, pii, secretscan, simhash, toxicity, urlfilter

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PII_KEY = "stackweave-pseudonyms-1"


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_byte_level_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_texts(_read(spark, sf_dir, "documents"), RANKS, public_tokenizers.PATTERN)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_read(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op4_flac(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flac.store_as_flac(_read(spark, sf_dir, "documents"))


def op5_kmeans_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.neighbours(_read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonym_table(_read(spark, sf_dir, "documents"), PII_KEY)


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return anchors.remove_repeats(_read(spark, sf_dir, "documents"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(_read(spark, sf_dir, "documents"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secretscan.scan(_read(spark, sf_dir, "documents"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.filter_urls(_read(spark, sf_dir, "pages"), urlfilter.PAGE_RULES)


OP10_SQL = """
WITH parsed AS (
  SELECT page_id,
    translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
rules(verdict, rhost, rpath) AS (VALUES %s),
fits AS (
  SELECT p.page_id, p.host, p.path, r.rhost || r.rpath AS rule, r.verdict,
    row_number() OVER (PARTITION BY p.page_id, p.host, p.path ORDER BY length(r.rhost || r.rpath) DESC) AS n
  FROM parsed p JOIN rules r ON ('.' || p.host) LIKE ('%%.' || r.rhost) AND starts_with(p.path, r.rpath))
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.verdict, 'allow') AS verdict
FROM parsed p LEFT JOIN fits f ON f.page_id = p.page_id AND f.host = p.host AND f.path = p.path AND f.n = 1
""" % ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in urlfilter.PAGE_RULES)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_byte_level_bpe, op2_mixing, op3_toxicity, op4_flac, op5_kmeans_tree, op6_pii, op7_substring_dedup, op8_simhash, op9_secrets, op10_url_filter)}
ORACLES: dict[str, str] = {"op2_mixing": mixing.oracle(), "op10_url_filter": OP10_SQL}
