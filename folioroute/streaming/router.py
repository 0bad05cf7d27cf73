"""Routing a folder that keeps receiving files.

Matching is stateless and runs where the files are read. Names depend on what was
given out before in the same directory: that is kept as state, one row per
directory and name with a map of its 100 slots, so a batch reads no earlier
manifest and its work is its own size. The state begins with a listing of the
target directories, where one is given, and every arriving file takes the slot it
already stands on. A path that was routed before is left out, by state as well.
A batch writes its own folder and replaces it when repeated.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from folioroute import constants as K
from folioroute.functions import text as X
from folioroute.operators import matching, naming
from folioroute.plans import routing
from folioroute.session import local_frame
from folioroute.sources.files import PDF_GLOB
from folioroute.sources.rules import RuleSet

MANIFEST_SCHEMA = (
    "path string, target_path string, action string, outcome string, rule_id int, "
    "encrypt boolean, ref_status int, batch_id int"
)
# Groups over which rows without a chance of a name are dealt out; part of the
# state's key, so fixed.
PIECES = 64
# Rows a task holds back to find the first claimants of its names.
HELD_ROWS = 100_000
# A batch then commits what it has changed, not the whole store.
_STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}
_SLOTS = K.SLOTS_PER_NAME
_KEYS = ("dir", "family", "piece")


def stream_files(spark: SparkSession, root: str) -> DataFrame:
    """New PDF files below a folder with their bytes."""
    return (
        spark.readStream.format("binaryFile")
        .schema("path string, modificationTime timestamp, length long, content binary")
        .option("pathGlobFilter", PDF_GLOB)
        .option("recursiveFileLookup", True)
        .load(root)
    )


class SlotMap:
    """Which slots of the names of one family are taken in a directory.

    Names of a family share files: ``x_1`` is slot 1 of ``x`` and slot 0 of
    ``x_1``. Each name has one integer with a bit per slot.
    """

    def __init__(self, names: set[str], taken: dict[str, int]):
        self.names, self.taken = names, taken
        self.changed: set[str] = set()

    def mark(self, name: str, slot: int) -> None:
        """Take a file, under every name that could give it out."""
        stem = f"{name}_{slot}" if slot else name
        readings = [(name, slot), (stem, 0)]
        head, _, number = stem.rpartition("_")
        if number.isascii() and number.isdecimal() and number[0] != "0" and int(number) < _SLOTS:
            readings.append((head, int(number)))
        for other, k in readings:
            if other in self.names and not self.taken.get(other, 0) >> k & 1:
                self.taken[other] = self.taken.get(other, 0) | 1 << k
                self.changed.add(other)

    def claim(self, name: str) -> int | None:
        """The first free slot, taken; none if all are gone."""
        free = ~self.taken.get(name, 0) & (1 << _SLOTS) - 1
        if not free:
            return None
        slot = (free & -free).bit_length() - 1
        self.mark(name, slot)
        return slot


class _NameGiver(StatefulProcessor):
    """Gives the names of one directory and family out in path order.

    State: per name the taken slots, as two integers of 50 bits.
    """

    HALF = 50

    def __init__(self, members: dict[str, set[str]], columns: list[str]):
        self.members, self.columns = members, columns

    def init(self, handle) -> None:
        self.state = handle.getMapState("slots", "name string", "low long, high long")

    def _load(self, family: str) -> SlotMap:
        half = self.HALF
        names = self.members.get(family, {family})
        return SlotMap(names, {k[0]: v[0] | v[1] << half for k, v in self.state.iterator()})

    def _save(self, slots: SlotMap) -> None:
        half = self.HALF
        for name in sorted(slots.changed):
            bits = slots.taken[name]
            self.state.updateValue((name,), (bits & (1 << half) - 1, bits >> half))

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        slots = self._load(key[1])
        for name, slot in zip(initialState["name"], initialState["slot"]):
            slots.mark(name, int(slot))
        self._save(slots)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        if key[2] != naming.IN_RACE:
            for part in rows:
                yield part.assign(slot=pd.array([None] * len(part), "Int32"))[self.columns]
            return
        part = pd.concat(rows, ignore_index=True)
        slots = self._load(key[1])
        marks = part[~part["claim"]]
        for name, slot in zip(marks["name"], marks["mark"]):
            slots.mark(name, int(slot))
        claims = part[part["claim"]].sort_values("path", key=lambda c: c.map(_utf8), ignore_index=True)
        given = pd.array([slots.claim(name) for name in claims["name"]], "Int32")
        self._save(slots)
        if len(claims):
            yield claims.assign(slot=given)[self.columns]

    def close(self) -> None:
        pass


def _utf8(path: str) -> bytes:
    """Sort key in Spark's order of strings."""
    return path.encode("utf-8", "surrogatepass")


def _pick_claimants(held_rows: int):
    """Mark the rows that may win a name: among a task's claimants of a directory
    and name the first hundred by path. The others are dealt out to groups
    that give nothing, so a name that most files want stays off a single task."""

    def pick(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, list] = {}
        waiting = 0

        def placed(rows: list[tuple], columns, race: bool) -> pd.DataFrame:
            out = pd.DataFrame(rows, columns=columns).astype({"rule_id": "Int32", "mark": "Int32"})
            return out.assign(piece=naming.IN_RACE if race else out["spare"])

        for batch in batches:
            columns = list(batch.columns)
            path, name, where = (columns.index(c) for c in ("path", "name", "dir"))
            sure = ~batch["claim"]
            if sure.any():
                yield placed(list(batch[sure].itertuples(index=False, name=None)), columns, True)
            lost = []
            for row in batch[~sure].itertuples(index=False, name=None):
                if row[name] is None:
                    lost.append(row)
                    continue
                group = held.setdefault((row[where], row[name]), [])
                entry = (_Late(_utf8(row[path])), row)
                if len(group) < _SLOTS:
                    heapq.heappush(group, entry)
                    waiting += 1
                else:
                    lost.append(heapq.heappushpop(group, entry)[1])
            if lost:
                yield placed(lost, columns, False)
            if waiting >= held_rows:
                # Too many names to wait for: these rows go on as they are.
                yield placed([r for g in held.values() for _, r in g], columns, True)
                held, waiting = {}, 0
        if waiting:
            yield placed([r for g in held.values() for _, r in g], columns, True)

    return pick


class _Late:
    """Orders a heap by the largest path first."""

    __slots__ = ("path",)

    def __init__(self, path: bytes):
        self.path = path

    def __lt__(self, other: _Late) -> bool:
        return self.path > other.path


def _with_family(rows: DataFrame, names: list[str], how: str) -> DataFrame:
    families = naming.name_families(names)
    table = local_frame(rows.sparkSession, [(n, families.get(n, n)) for n in names], "name string, family string")
    return rows.join(table, "name", how)


def give_names(routed: DataFrame, rules: RuleSet, inventory: DataFrame | None = None) -> DataFrame:
    """Add ``slot`` to a stream of routed files (``path, rule_id`` and maybe ``error``).

    Every path is settled once. Files of a batch are settled in path order, after
    all files that the batch brings have taken the slots they stand on.
    ``inventory`` (``path``) lists the files that are there when the stream begins.
    """
    live = {r.name for r in matching.live_rules(rules)}
    names = [n for n in rules.names() if n in live]
    if "error" not in routed.columns:
        routed = routed.withColumn("error", F.lit(None).cast("string"))
    once = routed.select("path", "rule_id", "error").dropDuplicates(["path"])
    rows = matching.attach_rule(once.withColumn("dir", X.dir_name("path")), rules, "name")
    entry = "claim boolean, name string, mark int"
    stands = [
        F.struct(F.lit(False).alias("claim"), reading["name"].alias("name"), reading["slot"].alias("mark"))
        for reading in naming.readings(X.base_name("path"))
    ]
    claim = F.struct(F.lit(True).alias("claim"), F.col("name"), F.lit(None).cast("int").alias("mark"))
    every = F.array(claim, *stands).cast(f"array<struct<{', '.join(e.replace(' ', ':', 1) for e in entry.split(', '))}>>")
    spare = F.pmod(F.xxhash64("path"), F.lit(PIECES)).cast("int")
    flat = (
        rows.select("path", "rule_id", "error", "dir", spare.alias("spare"), F.explode(every).alias("_e"))
        .select("path", "rule_id", "error", "dir", "spare", "_e.*")
        .where(F.col("claim") | F.col("mark").isNotNull())
    )
    flat = _with_family(flat, names, "left").where(F.col("claim") | F.col("family").isNotNull())
    picked = flat.mapInPandas(_pick_claimants(HELD_ROWS), T.StructType([*flat.schema.fields, T.StructField("piece", T.IntegerType())]))
    seed = None
    if inventory is not None:
        taken = _with_family(naming.taken_slots(inventory, names), names, "inner")
        seed = taken.withColumn("piece", F.lit(naming.IN_RACE)).select(*_KEYS, "name", "slot").groupBy(*_KEYS)
    families = naming.name_families(names)
    members: dict[str, set[str]] = {}
    for name, family in families.items():
        members.setdefault(family, set()).add(name)
    out = ["path", "rule_id", "error", "dir", "name", "slot"]
    return picked.groupBy(*_KEYS).transformWithStateInPandas(
        _NameGiver(members, out), "path string, rule_id int, error string, dir string, name string, slot int", "append", "none", seed
    )


def route_stream(
    files: DataFrame,
    rules: RuleSet,
    manifest: str,
    checkpoint: str,
    every: str | None = None,
    copy_mode: bool = False,
    prepare: Callable[[DataFrame], DataFrame] | None = None,
    inventory: DataFrame | None = None,
) -> StreamingQuery:
    """Start routing a stream of files to the ``manifest`` folder.

    ``prepare`` turns the stream into ``path``, ``text`` and ``metadata``, for
    instance with a reader. Without an interval the stream stops when it has
    handled what is there. ``manifest`` and ``checkpoint`` belong together:
    batches are numbered by the checkpoint. ``inventory`` is read when the stream
    starts for the first time.
    """
    docs = files if prepare is None else prepare(files)
    named = give_names(routing.route(docs, rules), rules, inventory)
    rows = routing.placed_manifest(matching.attach_rule(named, rules, "encrypt"), copy_mode)

    def store(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{manifest}/batch_id={batch_id}")

    writer = rows.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
    trigger = {"availableNow": True} if every is None else {"processingTime": every}
    conf = files.sparkSession.conf
    before = {name: conf.get(name, None) for name in _STATE_STORE}
    for name, value in _STATE_STORE.items():
        conf.set(name, value)
    try:
        return writer.trigger(**trigger).start()  # the query keeps a copy of the settings
    finally:
        for name, value in before.items():
            if value is None:
                conf.unset(name)
            else:
                conf.set(name, value)


def read_manifest(spark: SparkSession, manifest: str) -> DataFrame:
    """Manifest written so far."""
    return spark.read.schema(MANIFEST_SCHEMA).parquet(manifest)
