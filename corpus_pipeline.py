"""From raw documents to tokens: five stages, each on all its predecessor kept.

Language ID drops documents without a learned language; the n-gram Jaccard join
keeps one document of each group; decontamination drops documents that hold a
benchmark window; personal data is masked; what is left is encoded.
"""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioroute.llm import bpe, decontaminate, jaccard, language, pii
from folioroute.llm.common import stored

#: Least score of a document's language.
LEAST_SCORE = 0.3
#: Lists of rejected documents up to this size (counted before) are broadcast, larger ones shuffled.
BROADCAST_ROWS = 500_000


def _without(docs: DataFrame, rejected: DataFrame, purpose: str) -> DataFrame:
    """Documents not in ``rejected`` (id, digest of the text; null ids match by text)."""
    rejected = stored(rejected.select("id", "digest").distinct(), purpose)
    few = F.broadcast(rejected) if rejected.count() <= BROADCAST_ROWS else rejected
    same = docs["doc_id"].eqNullSafe(few["id"]) & (F.xxhash64(docs["text"]) == few["digest"])
    return docs.join(few, same, "left_anti")


def detect_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a learned language of at least LEAST_SCORE; null texts and texts without letters go."""
    return language.keep(docs, language.fit(docs), LEAST_SCORE)


def _row_key(docs: DataFrame) -> Column:
    """One string per id and text, in the order of ids, then of the text's digest; null without an id."""
    doc_id = docs["doc_id"].cast("string")
    if isinstance(docs.schema["doc_id"].dataType, T.IntegralType):
        doc_id = F.lpad((docs["doc_id"].cast("decimal(20,0)") + F.lit(Decimal(2**63))).cast("string"), 20, "0")
    return F.concat(doc_id, F.lit("\0"), F.lpad(F.hex(F.xxhash64(docs["text"])), 16, "0"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest id of each group of near duplicates; of rows equal in id and text, one.

    Texts that share an id are documents of their own, in the order of their
    digests. Documents without words or without an id belong to no group and
    stay. Of rows equal in id and text, the first by its other columns as JSON stays.
    """
    repeated = stored(docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated-ids")
    none = repeated.isEmpty()
    texts = docs.join(repeated, "doc_id", "left_semi").select("doc_id", F.xxhash64("text").alias("is"))
    several = not none and not texts.groupBy("doc_id").agg(F.min("is").alias("low"), F.max("is").alias("high")).where("low <> high").isEmpty()
    row = _row_key(docs) if several else docs["doc_id"]
    groups = stored(jaccard.jaccard_components(docs.select(row.alias("row"), "text"), "row"), "groups")
    later = groups.where("component_id <> row").select("row").distinct()
    few = F.broadcast(later) if later.count() <= BROADCAST_ROWS else later
    kept = docs.join(few, row == few["row"], "left_anti").select(*docs.columns)
    if none:
        return kept
    whole = F.struct(*docs.columns)
    again = kept.join(repeated, "doc_id", "left_semi").groupBy("doc_id", "text").agg(F.min_by(whole, F.to_json(whole)).alias("first"))
    return kept.join(repeated, "doc_id", "left_anti").select(*docs.columns).union(again.select("first.*"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark window."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontaminate.decontaminate(docs, items)
    return _without(docs, found.where("contaminated").select(F.col("doc_id").alias("id"), "digest"), "contaminated")


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind; n_chars follows."""
    return pii.mask_pii(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, their byte offsets and the digest of the decoded bytes of every document."""
    encoded = bpe.encode_decode(docs, public_tokenizers.path(bpe.RANKS))
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        "ids",
        "starts",
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("detect_language", detect_language),
    ("drop_near_duplicates", drop_near_duplicates),
    ("drop_contaminated", drop_contaminated),
    ("mask_personal_data", mask_personal_data),
    ("encode", encode),
]

#: A trained network decides the first stage, so SQL cannot give these rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
