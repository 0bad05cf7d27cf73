"""Column functions that turn codes, times and counts into display text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioroute import constants as K
from folioroute.functions.text import _col


def _lookup(value: Column, table: dict) -> Column:
    pairs = [F.lit(x) for item in table.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), value)


def _fixed(number: Column, pattern: str) -> Column:
    # The pattern form rounds the exact binary value half to even and groups nothing.
    return F.call_function("format_number", number, F.lit(pattern))


def status_label(code) -> Column:
    """Label of a status code, the number itself when unknown."""
    c = _col(code).cast("int")
    return F.coalesce(_lookup(c, K.STATUS_LABELS), c.cast("string"))


def level_label(number) -> Column:
    return F.coalesce(_lookup(_col(number).cast("int"), K.LEVEL_LABELS), F.lit(K.LEVEL_DEFAULT))


def format_epoch(seconds) -> Column:
    """Epoch seconds as session-local time; '' for null and zero."""
    s = _col(seconds)
    return F.when(s.isNull() | (s == 0), F.lit("")).otherwise(
        F.from_unixtime(F.floor(s).cast("long"), "yyyy-MM-dd HH:mm:ss")
    )


def format_duration(seconds) -> Column:
    """Elapsed seconds as hours, minutes and seconds with two decimals."""
    s = _col(seconds).cast("double")
    rest = F.pmod(s, F.lit(3600.0))
    hours = F.round((s - rest) / 3600).cast("long")
    left = F.pmod(rest, F.lit(60.0))
    minutes = F.round((rest - left) / 60).cast("long")
    return F.concat(
        F.when(hours > 0, F.concat(hours.cast("string"), F.lit(K.DURATION_HOURS))).otherwise(""),
        F.when(
            (minutes > 0) | (hours > 0), F.concat(minutes.cast("string"), F.lit(K.DURATION_MINUTES))
        ).otherwise(""),
        _fixed(left, "0.00"),
        F.lit(K.DURATION_SECONDS),
    )


def display_state(status, thread) -> Column:
    """State shown for a file: a waiting file that has a thread is queued."""
    code = _col(status)
    return (
        F.when((code == K.WAITING) & _col(thread).isNotNull(), "queued")
        .when(code == K.WAITING, "pending")
        .when(code == K.RUNNING, "processing")
        .when(code == K.DONE, "completed")
        .when(code == K.FAILED, "failed")
    )


def progress_text(done, total) -> Column:
    """Share of finished files with one decimal; null when there are none."""
    ratio = F.try_divide(_col(done), _col(total))
    return F.concat(_fixed(ratio * 100, "0.0"), F.lit("%"))
