"""What the operators of this subpackage share: batches, sinks, links."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Texts of one call of a batch function hold about this many bytes together.
SLICE_BYTES = 1_000_000


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Where the session names none, a local session gets a temporary folder;
    any other session is refused, as its executors would not see that folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        import tempfile

        folder = tempfile.mkdtemp(prefix="folioroute-llm-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def small_batches(spark: SparkSession) -> None:
    """Hand rows to Python workers 1,000 at a time where the session has Spark's 10,000.

    A batch is held by the JVM and the worker at once, so long texts would fill
    both. Only the size of batches changes, never a result.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, "1000")


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """Write a slim result to the shared folder and read it back.

    Executors may be lost afterwards: the rows are in shared storage, and every
    branch that reads them sees the same ones.
    """
    spark = df.sparkSession
    small_batches(spark)
    path = f"{shared_folder(spark)}/{purpose}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def schema_with(docs: DataFrame, key: str, columns: str) -> T.StructType:
    """The key as the table has it, and the given columns."""
    added = T._parse_datatype_string(columns)
    return T.StructType([T.StructField(key, docs.schema[key].dataType), *added.fields])


def slices(batch: pa.RecordBatch, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch of (key, text) so that each part has about ``size`` bytes."""
    lengths = pa.compute.fill_null(pa.compute.binary_length(batch.column(1)), 0).to_pylist()
    start, held = 0, 0
    for row, length in enumerate(lengths):
        if held and held + length > size:
            yield batch.slice(start, row - start)
            start, held = row, 0
        held += length
    if start < batch.num_rows:
        yield batch.slice(start)


def parts_of(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[pa.RecordBatch]:
    """Whole rows in parts of about SLICE_BYTES by their column ``text``."""
    for batch in batches:
        step = max(1, batch.num_rows * SLICE_BYTES // max(batch.column(text).nbytes, 1))
        for start in range(0, batch.num_rows, step):
            yield batch.slice(start, step)
        pa.default_memory_pool().release_unused()


def range_sorted(df: DataFrame, keys: list[str], purpose: str) -> DataFrame:
    """The rows in the order of ``keys``, written with their place: ``part`` and, from 0 in each part, ``row``.

    Parts are ranges of the order, so (part, row) ascends with it; rows equal in
    all keys share a part. Once written, the places stay as they are whatever is lost.
    """
    row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return stored(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumns({"part": F.spark_partition_id(), "row": row}), purpose)


def grouped_rows(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.Table]:
    """Rows of sorted batches, cut where the first ``width`` columns (integers, not null) change."""
    held: list[pa.RecordBatch] = []
    mark = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([np.asarray(batch.column(i)) for i in range(width)], 1)
        cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), batch.num_rows]
        for start, end in zip(cuts, cuts[1:]):
            now = tuple(keys[start])
            if held and now != mark:
                yield pa.Table.from_batches(held)
                held = []
            mark = now
            held.append(batch.slice(start, end - start))
    if held:
        yield pa.Table.from_batches(held)


def map_texts(
    docs: DataFrame,
    make: Callable[[], Callable[[list], list]],
    columns: str,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Apply a batch function to whole texts, one output row per input row.

    ``make`` is called once per task and returns a function from a list of texts
    (null stays None) to one list or Arrow array per output column. Only the key
    and the text are read, so other columns may have any name.
    """
    small_batches(docs.sparkSession)
    schema = schema_with(docs, key, columns)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for part in slices(batch):
                made = work(part.column(1).to_pylist())
                arrays = [
                    m if isinstance(m, pa.Array) else pa.array(m, type=f.type)
                    for m, f in zip(made, list(arrow)[1:])
                ]
                yield pa.RecordBatch.from_arrays([part.column(0).cast(arrow[0].type), *arrays], schema=arrow)
            pa.default_memory_pool().release_unused()

    return docs.select(F.col(key), F.col(text)).mapInArrow(run, schema)


def safe_segments(text: str, size: int = 500_000) -> list[str]:
    """Cut a long text before single blanks that stand between other characters.

    Such a blank always begins a pre-token in byte-level tokenizers and is
    dropped by those that drop white space, so the segments' tokens together are
    the text's. A text without such blanks stays whole.
    """
    if len(text) <= size:
        return [text]
    out, start = [], 0
    while len(text) - start > size:
        at = text.find(" ", start + size)
        while at >= 0 and (at + 1 >= len(text) or text[at + 1].isspace() or text[at - 1].isspace()):
            at = text.find(" ", at + 1)
        if at < 0:
            break
        out.append(text[start:at])
        start = at
    out.append(text[start:])
    return out


def connected(links: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """Connected components of links: (id, component), the smallest id reachable.

    Alternates two steps until nothing changes. Each node hands the smallest
    neighbour to its larger neighbours (large star), then to its smaller ones
    (small star); both are one aggregation and one join on the node, combined
    before the shuffle, and the links are written to the shared folder in every
    round. Only a count comes to the driver. Nodes without links are not listed.
    """
    spark = links.sparkSession
    edges = stored(
        links.select(
            F.greatest(left, right).alias("u"), F.least(left, right).alias("v")
        ).where("u <> v").distinct(),
        "links",
    )
    if edges.isEmpty():
        return edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("w")).select("u", F.least("u", "w").alias("w"))
        large = (
            both.where("v > u").join(least, "u").where("v <> w")
            .select(F.col("v").alias("u"), F.col("w").alias("v")).distinct()
        )
        large = stored(large, "large-star")
        low = large.groupBy("u").agg(F.min("v").alias("w"))
        joined = large.join(low, "u")
        small = (
            joined.select("u", F.col("w").alias("v"))
            .union(joined.where("v <> w").select(F.col("v").alias("u"), F.col("w").alias("v")))
            .distinct()
        )
        small = stored(small, "small-star")
        # A star forest: every node has one link, to a root that has none of its own.
        ends = small.select(F.col("u").alias("node"), F.lit(1).alias("links"), F.lit(0).alias("root")).union(
            small.select(F.col("v").alias("node"), F.lit(0).alias("links"), F.lit(1).alias("root"))
        )
        counted = ends.groupBy("node").agg(F.sum("links").alias("links"), F.max("root").alias("root"))
        edges = small
        if counted.where("links > 1 OR (links > 0 AND root > 0)").isEmpty():
            break
    stars = edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return stars.union(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
