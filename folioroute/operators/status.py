"""Processing status: current state, counts, errors, exports.

A status frame has one row per ``path`` with ``status, message, thread,
start_time, end_time``. An update frame has ``path, seq, status, message,
thread, ts`` with ``ts`` in epoch seconds and ``seq`` the order of updates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioroute import constants as K
from folioroute.functions import labels as L
from folioroute.functions import text as X

STATUS_COLUMNS = ["path", "status", "message", "thread", "start_time", "end_time"]
# Thread of updates that name none: whoever submits the files.
CALLER_THREAD = 0
STATES = ["pending", "queued", "processing", "completed", "failed"]


def fold_columns(caller_thread: int | None = CALLER_THREAD) -> list[Column]:
    """Aggregates that fold a file's updates into its status, in any order.

    Only updates with a message set the message (null if none did); the first
    start and the last end count. An update without a thread takes the
    caller's, so a file has a thread from its first update on; None leaves such
    updates without.
    """
    thread = F.col("thread")
    if caller_thread is not None:
        thread = F.coalesce(thread, F.lit(caller_thread))
    started = F.col("status") == K.RUNNING
    ended = F.col("status").isin(K.DONE, K.FAILED)
    said = F.col("message").isNotNull()
    # Rows whose order is null do not take part in max_by and min_by.
    return [
        F.max_by("status", "seq").alias("status"),
        F.max_by("message", F.when(said, F.col("seq"))).alias("message"),
        F.max_by(thread, "seq").alias("thread"),
        F.min_by("ts", F.when(started, F.col("seq"))).alias("start_time"),
        F.max_by("ts", F.when(ended, F.col("seq"))).alias("end_time"),
    ]


def fold_updates(updates: DataFrame, caller_thread: int | None = CALLER_THREAD) -> DataFrame:
    """What a set of updates says about every path they touch. State per path
    has constant size and is combined before the shuffle, however many updates
    a path has."""
    return updates.groupBy("path").agg(*fold_columns(caller_thread))


def latest_status(updates: DataFrame, caller_thread: int | None = CALLER_THREAD) -> DataFrame:
    """Current status of every path, from all its updates."""
    return fold_updates(updates, caller_thread).withColumn(
        "message", F.coalesce("message", F.lit(""))
    )


def distinct_paths(paths: DataFrame) -> DataFrame:
    return paths.select("path").dropDuplicates(["path"])


def waiting_rows(paths: DataFrame) -> DataFrame:
    return paths.select(
        "path",
        F.lit(K.WAITING).alias("status"),
        F.lit(K.WAITING_MESSAGE).alias("message"),
        F.lit(None).cast("bigint").alias("thread"),
        F.lit(None).cast("double").alias("start_time"),
        F.lit(None).cast("double").alias("end_time"),
    )


def missing_rows(status: DataFrame, paths: DataFrame) -> DataFrame:
    """Waiting rows for the paths the status table does not have yet."""
    new = distinct_paths(paths).join(status.select("path"), "path", "left_anti")
    return waiting_rows(new)


def insert_missing(status: DataFrame, paths: DataFrame) -> DataFrame:
    return status.select(*STATUS_COLUMNS).unionByName(missing_rows(status, paths))


def merge_small(status: DataFrame, changes: DataFrame) -> DataFrame:
    """``merge_status`` for few changes to a large table.

    The table is only probed: where Spark can broadcast the changes, no row of it
    is shuffled. What the changes add is found by the paths they did meet.
    """
    old, new = status.alias("o"), changes.alias("n")
    kept = old.join(new, F.col("o.path") == F.col("n.path"), "left").select(
        F.col("o.path").alias("path"),
        F.coalesce("n.status", "o.status").alias("status"),
        F.coalesce("n.message", "o.message", F.lit("")).alias("message"),
        F.coalesce("n.thread", "o.thread").alias("thread"),
        F.coalesce("o.start_time", "n.start_time").alias("start_time"),
        F.coalesce("n.end_time", "o.end_time").alias("end_time"),
    )
    met = status.select("path").join(changes.select("path"), "path", "left_semi")
    added = changes.join(met, "path", "left_anti").withColumn("message", F.coalesce("message", F.lit("")))
    return kept.unionByName(added.select(*kept.columns))


def merge_status(status: DataFrame, changes: DataFrame) -> DataFrame:
    """Status table after ``fold_updates`` of new updates.

    A change leaves alone what it does not know, and the start once it is set.
    Both sides have one row per path, so no key is hot.
    """
    old, new = status.alias("o"), changes.alias("n")
    return old.join(new, F.col("o.path") == F.col("n.path"), "full_outer").select(
        F.coalesce("n.path", "o.path").alias("path"),
        F.coalesce("n.status", "o.status").alias("status"),
        F.coalesce("n.message", "o.message", F.lit("")).alias("message"),
        F.coalesce("n.thread", "o.thread").alias("thread"),
        F.coalesce("o.start_time", "n.start_time").alias("start_time"),
        F.coalesce("n.end_time", "o.end_time").alias("end_time"),
    )


def status_of(status: DataFrame, path: str) -> DataFrame:
    return status.where(F.col("path") == path)


def pending(status: DataFrame, limit: int | None = None) -> DataFrame:
    """Waiting paths; with a limit the first ones in path order."""
    waiting = status.where(F.col("status") == K.WAITING).select("path")
    return waiting if limit is None else waiting.orderBy("path").limit(limit)


def status_counts(status: DataFrame) -> DataFrame:
    """One row with the number of files per display state and in total."""
    state = L.display_state("status", "thread")
    counts = [F.count_if(state == name).alias(name) for name in STATES]
    return status.agg(*counts, F.count_if(state.isNotNull()).alias("total"))


def simple_status_counts(status: DataFrame) -> DataFrame:
    """The counts without the queued state: every waiting file is pending."""
    return status_counts(status.withColumn("thread", F.lit(None).cast("bigint"))).drop("queued")


def all_done(status: DataFrame) -> DataFrame:
    """Whether there are files and all of them are done."""
    done = F.count_if(F.col("status") == K.DONE)
    total = F.count("*")
    return status.agg(
        total.alias("total"), done.alias("done"), ((total > 0) & (total == done)).alias("finished")
    )


def progress(status: DataFrame) -> DataFrame:
    done, total = F.count_if(F.col("status") == K.DONE), F.count("*")
    return status.agg(done.alias("done"), total.alias("total")).select(
        "done", "total", L.progress_text("done", "total").alias("progress")
    )


def run_summary(results: DataFrame) -> DataFrame:
    """Totals of a run over rows of ``ok, matched, start_time, end_time``."""
    return results.agg(
        F.count("*").alias("searched"),
        F.count_if("ok").alias("succeeded"),
        F.count_if("matched").alias("matched"),
        (F.max("end_time") - F.min("start_time")).alias("seconds"),
    ).withColumn("elapsed", L.format_duration("seconds"))


def state_sample(status: DataFrame, per_state: int) -> DataFrame:
    """Up to so many files per state in path order, and how many more there are.

    The ranking drops the surplus before it is shuffled; the counts are five
    rows.
    """
    named = status.select(
        "path",
        L.display_state("status", "thread").alias("state"),
        X.short_name(X.base_name("path")).alias("shown"),
    ).where("state is not null")
    order = Window.partitionBy("state").orderBy("path")
    sample = named.withColumn("position", F.row_number().over(order)).where(
        F.col("position") <= per_state
    )
    more = named.groupBy("state").agg(F.greatest(F.count("*") - per_state, F.lit(0)).alias("more"))
    return sample.join(more, "state").select("state", "position", "path", "shown", "more")


# --- log ---------------------------------------------------------------------


def errors_only(log: DataFrame) -> DataFrame:
    """Entries of the error level, in the spelling entries are written with."""
    return log.where(F.col("level") == K.LEVEL_ERROR)


def recent_errors(log: DataFrame, number: int = 5, order: str | None = None) -> DataFrame:
    """Latest errors first; entries of one time stay in the ``order`` column's order."""
    tie = [F.asc(order)] if order else []
    return errors_only(log).orderBy(F.desc("timestamp"), *tie).limit(number)


# --- exports -----------------------------------------------------------------


def export_rows(status: DataFrame) -> DataFrame:
    """Status rows under their export header, codes and times as text."""
    values = [
        F.col("path"),
        L.status_label("status"),
        F.col("message"),
        F.col("thread").cast("string"),
        L.format_epoch("start_time"),
        L.format_epoch("end_time"),
    ]
    return status.select(*[v.alias(n) for v, n in zip(values, K.STATUS_EXPORT_HEADER)])


def log_export_rows(log: DataFrame) -> DataFrame:
    """Log entries under their export header, unknown origin spelled out."""
    values = [
        F.coalesce("timestamp", F.lit("")),
        F.coalesce("level", F.lit(K.UNKNOWN)),
        F.coalesce("thread", F.lit(K.UNKNOWN)),
        F.coalesce("message", F.lit("")),
    ]
    return log.select(*[v.alias(n) for v, n in zip(values, K.LOG_EXPORT_HEADER)])
