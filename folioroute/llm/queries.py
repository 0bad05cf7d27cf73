"""The registered queries of this subpackage: thin, whole tables, fixed parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from folioroute.llm import bpe, decontaminate, embeddings, jaccard, language, licenses, merkle, neighbours, pii, quality, secrets, spelling, token_counts
from folioroute.llm.oracle import ORACLE

__all__ = ["ORACLE", "QUERIES"]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return language.identify(docs, language.fit(docs))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return bpe.digests(bpe.encode_decode(docs, public_tokenizers.path(bpe.RANKS), cache=bpe.WIDE_CACHE))


def op3_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digests(secrets.find_secrets(_table(spark, sf_dir, "documents")))


def op5_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(_table(spark, sf_dir, "documents"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(pii.find_pii(_table(spark, sf_dir, "documents")))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.find_licenses(_table(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return token_counts.count_tokens(docs, public_tokenizers.path(token_counts.VOCABULARY))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")
    return decontaminate.digests(decontaminate.decontaminate(docs, items))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    return quality.score(docs, quality.fit(docs, labels))


def op11_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(_table(spark, sf_dir, "embeddings"))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(_table(spark, sf_dir, "documents"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language": op1_language,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_embeddings": op3_embeddings,
    "op4_secrets": op4_secrets,
    "op5_jaccard": op5_jaccard,
    "op6_pii": op6_pii,
    "op7_licenses": op7_licenses,
    "op8_token_counts": op8_token_counts,
    "op9_decontaminate": op9_decontaminate,
    "op10_quality": op10_quality,
    "op11_neighbours": op11_neighbours,
    "op12_merkle": op12_merkle,
    "op13_spelling": op13_spelling,
}
