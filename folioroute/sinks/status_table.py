"""A stored status table that takes small updates without being rewritten.

Rows are laid out in folders by a hash of the path. An update reads and replaces
only the folders its paths belong to, and in those the table is probed by the
changes, not shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioroute.operators import status as S
from folioroute.session import reliable
from folioroute.sources.tables import STATUS_SCHEMA

BUCKETS = 64


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("path"), F.lit(buckets)).cast("int").alias("bucket")


def write_status_table(status: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Lay a status table out anew; later merges name the same number of buckets."""
    rows = status.select(*S.STATUS_COLUMNS, _bucket(buckets))
    rows.repartition("bucket").write.mode("error").partitionBy("bucket").parquet(path)


def read_status_table(spark: SparkSession, path: str) -> DataFrame:
    return _stored(spark, path).drop("bucket")


def _stored(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(T.StructType([*STATUS_SCHEMA.fields, T.StructField("bucket", T.IntegerType())])).parquet(path)


def merged_buckets(spark: SparkSession, path: str, changes: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """The touched folders of a stored table after ``fold_updates`` rows."""
    # At most as many numbers as there are folders.
    touched = [r[0] for r in changes.select(_bucket(buckets)).distinct().collect()]
    old = _stored(spark, path).where(F.col("bucket").isin(touched)).drop("bucket")
    return S.merge_small(old, changes).select(*S.STATUS_COLUMNS, _bucket(buckets))


def merge_into_status_table(spark: SparkSession, path: str, changes: DataFrame, buckets: int = BUCKETS) -> None:
    """Merge ``fold_updates`` rows into a stored table. Merging the same rows again
    changes nothing, so a run that was lost can be repeated."""
    merged = merged_buckets(spark, path, reliable(changes), buckets)
    merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
