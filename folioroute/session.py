"""Small helpers around the Spark session that every layer shares."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

# Contents that a Python worker turns into objects at once.
SLICE_BYTES = 4 * 1024 * 1024


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach: ``spark.checkpoint.dir`` of the
    session. A local session that names none gets a temporary folder; any other
    is refused, since its executors would not see that folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="folioroute-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def run_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder for one run below the shared folder."""
    return f"{shared_dir(spark)}/{purpose}-{uuid.uuid4().hex}"


def local_frame(spark: SparkSession, rows: list[tuple], schema: T.StructType | str) -> DataFrame:
    """A small frame that is part of the plan.

    Unlike one made from an RDD its size is known, so Spark joins it by
    broadcast when it is below the session's limit and not otherwise.
    """
    if isinstance(schema, str):
        schema = T._parse_datatype_string(schema)
    columns = list(zip(*rows)) if rows else [[] for _ in schema.names]
    arrow = to_arrow_schema(schema)
    arrays = [pa.array(list(c), type=f.type) for c, f in zip(columns, arrow)]
    return spark.createDataFrame(pa.Table.from_arrays(arrays, schema=arrow), schema)


def arrow_schema(schema: str) -> pa.Schema:
    return to_arrow_schema(T._parse_datatype_string(schema))


def arrow_rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    """Rows of a ``mapInArrow`` function as Spark takes them."""
    columns = list(zip(*rows)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(list(c), type=f.type) for c, f in zip(columns, schema)], schema=schema)


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches cut so that the values of a text or binary column have about ``limit``
    bytes together, or are a single one. Spark's own bounds are ten thousand rows and
    64 MB, and a worker would hold several copies of those."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        piece = np.cumsum(sizes, dtype="int64") // limit
        starts = [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), batch.num_rows]
        for first, end in zip(starts, starts[1:]):
            yield batch.slice(first, end - first)


def reliable(df: DataFrame) -> DataFrame:
    """Cut the lineage of a slim result that several branches read.

    The rows go to the shared folder, so they outlive executors and every
    branch sees the same rows.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def spread(df: DataFrame, *keys: str, partitions: int | None = None) -> DataFrame:
    """Deal rows out to ``partitions`` tasks before costly per-row work.

    Off by default: a large input has a split per core and more, and no text
    should be shuffled there. Sessions that work on small single files set
    ``folioroute.partitions``; streams are never dealt out.
    """
    wanted = partitions or int(df.sparkSession.conf.get("folioroute.partitions", "0"))
    if df.isStreaming or not wanted:
        return df
    return df.repartition(wanted, *keys)
