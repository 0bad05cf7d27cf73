"""File inventories and file contents."""

from __future__ import annotations

import os
from collections.abc import Iterator
from datetime import datetime, timezone

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioroute.functions import text as X
from folioroute.session import SLICE_BYTES, reliable

PDF_GLOB = "*.[pP][dD][fF]"
# A Spark value ends below 2 GB; Arrow batches of contents are closed at this size.
_LARGEST_FILE = 2**31 - 1024
_BATCH_BYTES = SLICE_BYTES
# Stores that tasks can list themselves; others are listed by Spark's own source.
_LISTABLE = ("file", "hdfs", "s3", "s3a", "s3n", "gs", "gcs")
_LISTING = "path string, is_dir boolean, length long, modified timestamp"


def list_files(
    spark: SparkSession, root: str, recursive: bool = True, fan_out_levels: int = 2, suffix: str = ".pdf"
) -> DataFrame:
    """Every PDF below ``root``, or every file with another ``suffix`` in any case:
    ``path, length, modified``, empty ones too.

    Executors do the listing. The first levels are unfolded one by one and
    dealt out again, then each task walks the folders it was given.
    """
    if not _listable(root):
        return _spark_listing(spark, root, recursive, suffix).select("path", "length", "modified")
    tasks = spark.sparkContext.defaultParallelism
    entries = spark.createDataFrame([(root, True, None, None)], _LISTING)
    entries = entries.mapInPandas(_lister(1), _LISTING)
    if recursive:
        for depth in [1] * (fan_out_levels - 1) + [None]:
            entries = entries.repartition(tasks, "path").mapInPandas(_lister(depth), _LISTING)
    fits = F.lower("path").endswith(suffix.lower())
    return entries.where(~F.col("is_dir") & fits).select("path", "length", "modified")


def _listable(root: str) -> bool:
    return "://" not in root or root.split("://", 1)[0] in _LISTABLE


def _spark_listing(spark: SparkSession, root: str, recursive: bool, suffix: str) -> DataFrame:
    glob = "*" + "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in suffix)
    reader = spark.read.format("binaryFile").option("pathGlobFilter", glob)
    if recursive:
        reader = reader.option("recursiveFileLookup", True)
    return reader.load(root).withColumnRenamed("modificationTime", "modified")


def _lister(depth: int | None):
    """Replace folders by their entries, one level or all the way down."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            files = batch[~batch.is_dir.astype(bool)]
            if len(files):
                yield files
            for folder in batch.path[batch.is_dir.astype(bool)]:
                yield from _walk(folder, depth)

    return run


def open_filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path, and the path as that system names it."""
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    if "://" in path:
        # Spark's names of this store are not known to the file systems used here.
        return pafs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1).replace("s3n://", "s3://", 1))
    return pafs.LocalFileSystem(), path


def _walk(folder: str, depth: int | None) -> Iterator[pd.DataFrame]:
    folder = folder.rstrip("/") or "/"
    system, start = open_filesystem(folder)
    # Entries come without the scheme; local ones are left so.
    prefix = "" if folder.startswith("file:") else folder.removesuffix(start)
    waiting = [start]
    while waiting:
        rows = []
        for path, is_dir, size, modified in _entries(system, waiting.pop()):
            if is_dir and depth is None:
                waiting.append(path)
            else:
                rows.append((prefix + path, is_dir, size, modified))
            if len(rows) == 10_000:
                yield _listed(rows)
                rows = []
        if rows:
            yield _listed(rows)


def _listed(rows: list[tuple]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=["path", "is_dir", "length", "modified"])
    return frame.assign(length=frame.length.astype("Int64"))


def _entries(system: pafs.FileSystem, folder: str) -> Iterator[tuple]:
    """Entries of one folder: path, whether to descend, size, time.

    A local folder is read entry by entry and its links to folders are not
    followed; a folder that may not be read has no entries, and the rest goes on.
    """
    if isinstance(system, pafs.LocalFileSystem):
        try:
            with os.scandir(folder) as found:
                for entry in found:
                    if entry.is_dir():
                        if not entry.is_symlink():
                            yield entry.path, True, None, None
                        continue
                    try:
                        facts = entry.stat()
                    except OSError:
                        continue
                    yield entry.path, False, facts.st_size, datetime.fromtimestamp(facts.st_mtime, timezone.utc)
        except PermissionError:
            return
        return
    for info in system.get_file_info(pafs.FileSelector(folder)):
        yield info.path, info.type == pafs.FileType.Directory, info.size, info.mtime


def scan_files(spark: SparkSession, root: str, recursive: bool = True, suffix: str = ".pdf") -> DataFrame:
    """PDF files, or those with another ``suffix``, with their bytes: ``path, length, modified, content``.

    The listing is the only inventory, so empty files and names that begin with
    a dot or an underscore are there too. It is dealt out by path, and every
    task reads its files into batches of bounded size. A file beyond the size of
    a Spark value, or one that cannot be opened, has null content.
    """
    if not _listable(root):
        return _spark_listing(spark, root, recursive, suffix).select("path", "length", "modified", "content")
    return read_listed(list_files(spark, root, recursive, suffix=suffix))


def read_listed(listed: DataFrame) -> DataFrame:
    """The files of a listing with their bytes, dealt out by path."""
    tasks = int(listed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = "path string, length long, modified timestamp, content binary"
    spread = listed.select(plain_path("path").alias("path"), "length", "modified").repartition(tasks, "path")
    return spread.mapInPandas(_read_bytes, schema)


def compare_listings(before: DataFrame, now: DataFrame) -> DataFrame:
    """``path, state, length, modified`` of all files of two listings: ``new``,
    ``changed`` (in length or time), ``same`` or ``gone``; with the newer facts."""
    old, new = before.alias("o"), now.alias("n")
    alike = F.col("o.length").eqNullSafe(F.col("n.length")) & F.col("o.modified").eqNullSafe(F.col("n.modified"))
    state = (
        F.when(F.col("o.path").isNull(), "new").when(F.col("n.path").isNull(), "gone")
        .when(alike, "same").otherwise("changed")
    )
    facts = [F.when(F.col("n.path").isNull(), F.col(f"o.{c}")).otherwise(F.col(f"n.{c}")).alias(c) for c in ("length", "modified")]
    return old.join(new, F.col("o.path") == F.col("n.path"), "full_outer").select(F.coalesce("n.path", "o.path").alias("path"), state.alias("state"), *facts)


def rescan_files(spark: SparkSession, root: str, before: DataFrame, recursive: bool = True) -> DataFrame:
    """What became of a folder since a stored listing: ``path, state, length, modified,
    content``. Only new and changed files are opened; the others have null content.

    ``before`` is what ``list_files`` gave, as it was stored then.
    """
    states = reliable(compare_listings(before, list_files(spark, root, recursive)))
    fresh = F.col("state").isin("new", "changed")
    opened = read_listed(states.where(fresh))
    known = states.select(plain_path("path").alias("path"), "state")
    return (
        opened.join(known, "path").select("path", "state", "length", "modified", "content")
        .unionByName(states.where(~fresh).withColumn("path", plain_path("path")), allowMissingColumns=True)
    )


def _read_bytes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = ["path", "length", "modified", "content"]
    for batch in batches:
        held, size = [], 0
        for row in batch.itertuples(index=False):
            content = None
            if row.length is None or pd.isna(row.length) or row.length < _LARGEST_FILE:
                try:
                    system, path = open_filesystem(row.path)
                    with system.open_input_stream(path) as stream:
                        content = stream.read()
                except OSError:
                    pass
            held.append((row.path, row.length, row.modified, content))
            size += len(content or b"")
            if size >= _BATCH_BYTES:
                yield pd.DataFrame(held, columns=columns)
                held, size = [], 0
        if held:
            yield pd.DataFrame(held, columns=columns)


def plain_path(path) -> Column:
    """Local paths without their scheme, others as they are."""
    return F.regexp_replace(X._col(path), r"\Afile:/+", "/")
