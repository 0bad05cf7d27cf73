"""Status and log tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

STATUS_SCHEMA = T.StructType(
    [
        T.StructField("path", T.StringType(), False),
        T.StructField("status", T.IntegerType()),
        T.StructField("message", T.StringType()),
        T.StructField("thread", T.LongType()),
        T.StructField("start_time", T.DoubleType()),
        T.StructField("end_time", T.DoubleType()),
    ]
)

LOG_SCHEMA = T.StructType(
    [
        T.StructField("timestamp", T.StringType()),
        T.StructField("level", T.StringType()),
        T.StructField("thread", T.StringType()),
        T.StructField("message", T.StringType()),
    ]
)


def read_status(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(STATUS_SCHEMA).parquet(path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LOG_SCHEMA).parquet(path)
