"""Collision-free target names.

A file claims ``name`` in its directory, else ``name_1`` ... ``name_99``, in
path order; names that exist already are skipped and after the last one the
file goes without (``name_exhausted``).

Any (directory, name) may be claimed by a large part of all files, but only
the first 100 by path can win. So claimants are ranked in salted pieces first;
who is not among the first 100 of a piece is out, and what is left of a group
is at most 100 rows per piece. Rows are slim (no text) and every step spills.
"""

from __future__ import annotations

import re

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioroute import constants as K
from folioroute.functions import text as X
from folioroute.session import local_frame, reliable

_SLOTS = K.SLOTS_PER_NAME
_NUMBERED = r"(?s)\A(.*)_([1-9][0-9]?)\z"
IN_RACE = _REST = -1  # piece of those still in the race


def target_file(name, slot) -> Column:
    """``name.pdf`` for slot 0, else ``name_slot.pdf``."""
    n, s = X._col(name), X._col(slot)
    return F.concat(
        n, F.when(s > 0, F.concat(F.lit("_"), s.cast("string"))).otherwise(""), F.lit(".pdf")
    )


def target_path(directory, name, slot) -> Column:
    return X.join_path(directory, target_file(name, slot))


def readings(file) -> list[Column]:
    """What a file name stands on, as (name, slot): slot 0 of its stem, and a numbered
    slot of what is before the number. The slot is null where there is no such reading."""
    stem = F.nullif(F.regexp_extract(X._col(file), r"(?s)\A(.*)\.pdf\z", 1), F.lit(""))
    number = F.nullif(F.regexp_extract(stem, _NUMBERED, 2), F.lit("")).cast("int")
    return [
        F.struct(stem.alias("name"), F.when(stem.isNotNull(), F.lit(0)).alias("slot")),
        F.struct(F.regexp_extract(stem, _NUMBERED, 1).alias("name"), number.alias("slot")),
    ]


def taken_slots(inventory: DataFrame, names: list[str]) -> DataFrame:
    """Slots of the given names that exist: ``dir``, ``name``, ``slot``.

    ``inventory`` has ``path``. A listing is read once, without a shuffle;
    only files that carry one of the names remain.
    """
    spark = inventory.sparkSession
    wanted = local_frame(spark, [(n,) for n in names], "name string")
    return (
        inventory.select(X.dir_name("path").alias("dir"), X.base_name("path").alias("_file"))
        .select("dir", F.explode(F.array(*readings("_file"))).alias("_r"))
        .select("dir", "_r.name", "_r.slot")
        .where("slot is not null")
        .join(wanted, "name", "left_semi")
        .select("dir", "name", "slot")
    )


def assign_slots(claims: DataFrame, taken: DataFrame | None = None) -> DataFrame:
    """Add ``slot`` (null if there is none) to rows of ``path, dir, name``.

    Rows with a null name claim nothing and pass through. ``taken`` is
    ``dir, name, slot``.
    """
    ranked = _race(claims)
    rows = ranked.withColumns({"_slot": F.lit(None).cast("int"), "_claim": F.lit(True)})
    if taken is not None:
        marks = taken.select(
            "dir",
            "name",
            F.lit(_REST).alias("_piece"),
            F.col("slot").alias("_slot"),
            F.lit(False).alias("_claim"),
        )
        rows = rows.unionByName(marks, allowMissingColumns=True)
    # Taken slots sort before the claims, so one running window sees them all.
    running = (
        Window.partitionBy("dir", "name", "_piece")
        .orderBy("_claim", "path")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    free = F.array_except(
        F.sequence(F.lit(0), F.lit(_SLOTS - 1)), F.collect_set("_slot").over(running)
    )
    rank = F.count_if("_claim").over(running).cast("int")
    in_race = F.col("name").isNotNull() & (F.col("_piece") == _REST)
    return (
        rows.withColumns({"_free": free, "_rank": rank})
        .where("_claim")
        .withColumn("slot", F.when(in_race, F.try_element_at("_free", F.col("_rank"))))
        .drop("_piece", "_slot", "_claim", "_free", "_rank")
    )


def _race(claims: DataFrame) -> DataFrame:
    """Add ``_piece``: ``_REST`` for the claimants that may win, the salt for
    the others. Every claimant among the first 100 of its group is in."""
    pieces = _piece_count(claims)
    salted = claims.withColumn("_salt", F.pmod(F.xxhash64("path"), F.lit(pieces)).cast("int"))
    order = Window.partitionBy("dir", "name", "_salt").orderBy("path")
    may_win = F.col("name").isNotNull() & (F.row_number().over(order) <= _SLOTS)
    return salted.withColumn("_piece", F.when(may_win, F.lit(_REST)).otherwise(F.col("_salt"))).drop(
        "_salt"
    )


def _piece_count(df: DataFrame) -> int:
    """As many pieces as shuffle partitions, so that a hot group reaches all of
    them; the race then holds at most 100 rows for each."""
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(16, min(4096, partitions))


# --- names that may collide with each other's numbered forms -----------------


def name_families(names: list[str]) -> dict[str, str]:
    """Names whose slots overlap, each with the family it belongs to.

    ``x`` may be given out as ``x_1``; a rule named ``x_1`` wants the same
    file. Such names form a family; names on their own are left out.
    """
    known = set(names)
    parent = {name: name for name in known}

    def root(name: str) -> str:
        while parent[name] != name:
            name = parent[name]
        return name

    for name in known:
        numbered = re.match(_NUMBERED.replace(r"\z", r"\Z"), name)
        if numbered and numbered[1] in known:
            parent[root(name)] = root(numbered[1])
    sizes: dict[str, int] = {}
    for name in known:
        sizes[root(name)] = sizes.get(root(name), 0) + 1
    return {name: root(name) for name in names if sizes[root(name)] > 1}


def assign_names(claims: DataFrame, names: list[str], inventory: DataFrame | None) -> DataFrame:
    """``assign_slots`` for claims on the given names against a listing.

    Names that overlap are settled together, in path order, per directory and
    family; the others by rank alone.
    """
    families = name_families(names)
    taken = None if inventory is None else taken_slots(inventory, names)
    if not families:
        return assign_slots(claims, taken)
    claims = reliable(claims)
    shared = F.coalesce(F.col("name").isin(list(families)), F.lit(False))
    alone = assign_slots(claims.where(~shared), None if taken is None else taken.where(~shared))
    settled = _settle_families(
        claims.where(shared), families, None if taken is None else taken.where(shared)
    )
    return alone.unionByName(settled)


def _settle_families(
    claims: DataFrame, families: dict[str, str], taken: DataFrame | None
) -> DataFrame:
    """Claims on overlapping names.

    A name has 100 slots, and whoever comes after 100 earlier claimants of the
    same name finds them all gone. Only the first 100 per name are settled one
    after the other: a family's group holds at most that many rows per name.
    The others pass in as many groups as there are pieces.
    """
    order = Window.partitionBy("dir", "name", "_piece").orderBy("path")
    wins = (F.col("_piece") == _REST) & (F.row_number().over(order) <= _SLOTS)
    aside = F.pmod(F.xxhash64("path"), F.lit(_piece_count(claims))).cast("int")
    rows = (
        _race(claims)
        .withColumn("_piece", F.when(wins, F.lit(_REST)).otherwise(aside))
        .withColumn("_slot", F.lit(None).cast("int"))
    )
    if taken is not None:
        marks = taken.distinct().withColumnRenamed("slot", "_slot")
        rows = rows.unionByName(marks.withColumn("_piece", F.lit(_REST)), allowMissingColumns=True)
    family = local_frame(claims.sparkSession, list(families.items()), "name string, family string")
    result = T.StructType(claims.schema.fields + [T.StructField("slot", T.IntegerType())])
    return (
        rows.join(family, "name")
        .groupBy("dir", "family", "_piece")
        .applyInArrow(_settler(claims.columns), result)
    )


def _settler(columns: list[str]):
    rest, slots = _REST, _SLOTS

    def file(name: str, slot: int) -> str:
        return f"{name}_{slot}" if slot else name

    def settle(group: pa.Table) -> pa.Table:
        is_claim = group["path"].is_valid()
        claims = group.filter(is_claim).sort_by("path")
        given: list[int | None] = [None] * claims.num_rows
        if group["_piece"][0].as_py() == rest:
            existing = group.filter(pc.invert(is_claim))
            used = {
                file(*pair)
                for pair in zip(existing["name"].to_pylist(), existing["_slot"].to_pylist())
            }
            for i, name in enumerate(claims["name"].to_pylist()):
                given[i] = next((k for k in range(slots) if file(name, k) not in used), None)
                if given[i] is not None:
                    used.add(file(name, given[i]))
        return claims.select(columns).append_column("slot", pa.array(given, pa.int32()))

    return settle
