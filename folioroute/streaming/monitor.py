"""Live status: update events to a status table that is always current.

State is one row per path, with built-in aggregates only. Each trigger appends
the rows that changed to a change log, one folder per batch, and a repeated
batch overwrites its own folder. Every few batches the stream itself folds the
last snapshot and the changes since into a new snapshot, so reading the current
table costs one snapshot and a few batches, however long the stream has run.

Layout: ``changes/after=S/batch_id=N`` holds the changes that follow snapshot S
(-1: nothing), ``snapshots/upto=S`` the whole table, ``marks/upto=S`` a row that
tells that the snapshot is complete.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from folioroute.operators import status as S

#: Batches between two snapshots.
COMPACT_EVERY = 20


def monitor_status(
    updates: DataFrame,
    change_log: str,
    checkpoint: str,
    every: str | None = "1 second",
    caller_thread: int | None = S.CALLER_THREAD,
    compact_every: int = COMPACT_EVERY,
) -> StreamingQuery:
    """Start folding a stream of updates (``path, seq, status, message, thread,
    ts``) into ``change_log``. Without an interval it handles what is there and
    stops. ``compact_every`` stays the same for a log."""

    def append(batch: DataFrame, batch_id: int) -> None:
        after = batch_id // compact_every * compact_every - 1
        batch.write.mode("overwrite").parquet(f"{change_log}/changes/after={after}/batch_id={batch_id}")
        if (batch_id + 1) % compact_every == 0 and newest_snapshot(batch.sparkSession, change_log) < batch_id:
            _write_snapshot(_folded(batch.sparkSession, change_log, after), change_log, batch_id)

    writer = (
        S.latest_status(updates, caller_thread)
        .writeStream.outputMode("update")
        .foreachBatch(append)
        .option("checkpointLocation", checkpoint)
    )
    trigger = {"availableNow": True} if every is None else {"processingTime": every}
    return writer.trigger(**trigger).start()


def _read(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def newest_snapshot(spark: SparkSession, change_log: str) -> int:
    """The last batch in a complete snapshot; -1 if there is none."""
    marks = _read(spark, f"{change_log}/marks")
    return -1 if marks is None else marks.agg(F.max("upto")).first()[0]


def _folded(spark: SparkSession, change_log: str, snapshot: int) -> DataFrame:
    """A snapshot and the changes after it: the newest row per path."""
    base = _read(spark, f"{change_log}/snapshots/upto={snapshot}")
    tail = _read(spark, f"{change_log}/changes/after={snapshot}")
    parts = []
    if base is not None:
        parts.append(base.withColumn("batch_id", F.lit(snapshot).cast("long")))
    if tail is not None:
        parts.append(tail.withColumn("batch_id", F.col("batch_id").cast("long")))
    if not parts:
        raise ValueError(f"no status below {change_log}")
    if len(parts) == 1 and base is not None:
        return base.select(*S.STATUS_COLUMNS)
    rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    newest = F.max_by(F.struct(*S.STATUS_COLUMNS[1:]), "batch_id")
    return rows.groupBy("path").agg(newest.alias("_s")).select("path", "_s.*")


def _write_snapshot(table: DataFrame, change_log: str, upto: int) -> None:
    table.write.mode("overwrite").parquet(f"{change_log}/snapshots/upto={upto}")
    done = table.sparkSession.range(1).select(F.lit(True).alias("complete"))
    done.coalesce(1).write.mode("overwrite").parquet(f"{change_log}/marks/upto={upto}")


def current_status(spark: SparkSession, change_log: str) -> DataFrame:
    """Status table as of the last finished batch, from one snapshot and what follows it."""
    return _folded(spark, change_log, newest_snapshot(spark, change_log))


def compact(spark: SparkSession, change_log: str, target: str) -> None:
    """Write the current status as the first snapshot of a fresh log, for a monitor
    that starts anew there."""
    _write_snapshot(current_status(spark, change_log), target, -1)
