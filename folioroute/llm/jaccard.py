"""N-gram Jaccard join: exact links of documents by distinct word shingles.

Sets of equal digest are one class. Classes are first linked to some that share
one of a few minimum hashes with them, which joins up most groups of copies. What is left is found without loss: under one order of all shingles,
frequent ones last, two sets that link share one of their first
``n - ceil(0.75 n) + 1``. Classes that share such a shingle but not a component
meet in tiles of neighbouring sizes. The places of the shingle in both orders and
hashed bitmaps bound the overlap from above, the latter by counting bits; only pairs
that the bounds let through, in either pass, are compared on sorted arrays.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from folioroute.llm.common import connected, schema_with, slices, stored

SHINGLE, NUMERATOR, DENOMINATOR = 5, 3, 4
MINIMA = 2
#: Shingles counted together in a task, and the least count there worth reporting.
COUNTED, OFTEN = 4_000_000, 2
#: A shingle is frequent from this many reports on, and this share of documents.
FREQUENT, SHARE = 32, 0.0001
#: The most frequent shingles that are put last; more only cost time, not links.
MOST_FREQUENT = 1_000_000
#: Members of a tile.
TILE = 512
#: Tables of ids whose texts are wanted are broadcast up to this size (counted before).
#: Nothing else is broadcast, whatever its size.
BROADCAST_IDS = 500_000
#: A bitmap has at least so many bits, and so many for each shingle: the fuller it is, the looser is its bound.
LEAST_BITS, BITS = 1024, 4
#: Bytes of text that are turned to shingles at once.
SLICE = 1_000_000

_CODE = np.random.default_rng(17).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_INSIDE = ~np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_FACTORS = np.random.default_rng(19).integers(1, 2**63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SALTS = np.random.default_rng(23).integers(1, 2**63, MINIMA, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def shingles(texts: list) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the shingles of each text."""
    encoded = [(t or "").encode() for t in texts]
    data = b" ".join(encoded) + b" "
    lengths = np.fromiter(map(len, encoded), np.int64, len(encoded))
    starts = np.concatenate([[0], np.cumsum(lengths + 1)])
    low = _LOWER[np.frombuffer(data, np.uint8)]
    inside = _INSIDE[low]
    first = np.flatnonzero(inside & ~np.concatenate([[False], inside[:-1]]))
    if not len(first):
        return [np.zeros(0, np.uint64) for _ in texts]
    word = np.cumsum(np.concatenate([[False], ~inside[:-1] & inside[1:]])) - (0 if inside[0] else 1)
    place = np.arange(len(low)) - first[np.maximum(word, 0)]
    power = np.full(int(place.max()) + 2, 0x9E3779B97F4A7C15, np.uint64)
    power[0] = 1
    power = np.multiply.accumulate(power)
    weighed = np.where(inside, _CODE[low] * power[np.maximum(place, 0)], np.uint64(0))
    words = _mix(np.add.reduceat(weighed, first))
    edge = np.searchsorted(first, starts)
    runs = np.zeros(max(len(words) - SHINGLE + 1, 0), np.uint64)
    for at, factor in enumerate(_FACTORS):
        runs += words[at : at + len(runs)] * factor
    runs = _mix(runs)
    out = []
    for a, b in zip(edge[:-1].tolist(), edge[1:].tolist()):
        if b - a >= SHINGLE:
            out.append(np.unique(runs[a : b - SHINGLE + 1]))
        elif b > a:
            short = (words[a:b] * _FACTORS[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)
            out.append(_mix(np.array([short])))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def least_overlap(n: int) -> int:
    """Shingles of a set of ``n`` that any linked set must share."""
    return -(-NUMERATOR * n // DENOMINATOR)


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets link, by exact intersection."""
    if not len(a) or not len(b) or min(len(a), len(b)) * DENOMINATOR < max(len(a), len(b)) * NUMERATOR:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return DENOMINATOR * both >= NUMERATOR * (len(a) + len(b) - both)


def bitmap(hashes: np.ndarray) -> bytes:
    """Hashed bitmap; its size is the power of two at or above BITS for each shingle."""
    size = max(LEAST_BITS, 1 << int(max(BITS * len(hashes) - 1, 0)).bit_length())
    bits = np.zeros(size, np.uint8)
    bits[(hashes >> np.uint64(20)) & np.uint64(size - 1)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def folded(bits: np.ndarray, size: int) -> np.ndarray:
    """A bitmap brought to a smaller power of two: the same hash, fewer bits."""
    return np.bitwise_or.reduce(bits.reshape(-1, size), axis=0)


def possible(n: np.ndarray | int, m: np.ndarray | int, most: np.ndarray | int) -> np.ndarray | bool:
    """Whether sets of ``n`` and ``m`` shingles can link if they share ``most`` at most."""
    return DENOMINATOR * most >= NUMERATOR * (n + m - most)


def most_common(n: int, bits: np.ndarray, m: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Bound of a set's overlap with others, from bitmaps of one size.

    Each bit set in one map and not in the other is a shingle the other lacks, so
    a set's size less those bits bounds the overlap from above.
    """
    mine = np.bitwise_count(bits & ~others).sum(1).astype(np.int64)
    theirs = np.bitwise_count(others & ~bits).sum(1).astype(np.int64)
    return np.minimum(n - mine, m - theirs)


def _frequent(docs: DataFrame, key: str, text: str) -> np.ndarray:
    """Shingles that stand in many documents, sorted.

    Every task counts the shingles of all its documents and reports those that
    come often; reports are added up. Which shingles are found affects the time,
    never the links.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, seen = [], 0, 0

        def report() -> pa.RecordBatch:
            values, times = np.unique(np.concatenate([*held, np.zeros(0, np.uint64)]), return_counts=True)
            often = times >= OFTEN
            values, times = values[often].view(np.int64), times[often]
            return pa.RecordBatch.from_arrays(
                [pa.array(np.append(values, 0)), pa.array(np.append(times, 0)), pa.array(np.append(np.zeros(len(values), np.int64), seen))],
                names=["shingle", "times", "documents"],
            )

        for batch in batches:
            for part in slices(batch, SLICE):
                made = shingles(part.column(1).to_pylist())
                held += made
                size += sum(map(len, made))
                seen += part.num_rows
                if size >= COUNTED:
                    yield report()
                    held, size, seen = [], 0, 0
        yield report()

    reports = docs.select(F.col(key), F.col(text)).mapInArrow(run, "shingle bigint, times bigint, documents bigint")
    reports = stored(reports.groupBy("shingle").agg(F.sum("times").alias("times"), F.sum("documents").alias("documents")), "frequent")
    total = reports.agg(F.sum("documents")).first()[0] or 0
    often = reports.where(F.col("times") >= max(FREQUENT, int(SHARE * total)))
    found = often.orderBy(F.desc("times"), "shingle").limit(MOST_FREQUENT).select("shingle").toArrow()
    return np.sort(found["shingle"].to_numpy().view(np.uint64))


def _sketches(docs: DataFrame, key: str, text: str, frequent: np.ndarray) -> DataFrame:
    """Per document: digest of the text, set size, digest of the set, minimum hashes, first shingles in the common order, bitmap."""
    schema = schema_with(docs, key, "mark bigint, n bigint, one bigint, two bigint, minima array<bigint>, prefix array<bigint>, bits binary")
    arrow = to_arrow_schema(schema)
    sent = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = sent.value
        for batch in batches:
            for part in slices(batch, SLICE):
                rows: list[list] = [[], [], [], [], [], []]
                for own in shingles(part.column(1).to_pylist()):
                    n = len(own)
                    first = n - least_overlap(n) + 1 if n else 0
                    late = np.zeros(n, bool)
                    if len(frequent) and n:
                        at = np.minimum(np.searchsorted(frequent, own), len(frequent) - 1)
                        late = frequent[at] == own
                    prefix = np.concatenate([own[~late], own[late]])[:first] if late.any() else own[:first]
                    minima = [int(_mix(own * s).min().view(np.int64)) for s in _SALTS] if n else []
                    made = (
                        n, int(own.sum(dtype=np.uint64).view(np.int64)) if n else 0,
                        int(_mix(own ^ _SALTS[0]).sum(dtype=np.uint64).view(np.int64)) if n else 0,
                        minima, prefix.view(np.int64), bitmap(own) if n else b"",
                    )
                    for column, value in zip(rows, made):
                        column.append(value)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).cast(arrow[0].type), part.column(2), *(pa.array(c, type=f.type) for c, f in zip(rows, list(arrow)[2:]))], schema=arrow
                )

    return docs.select(F.col(key), F.col(text), F.xxhash64(F.col(text)).alias("mark")).mapInArrow(run, schema)


def _grouped(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[list[dict]]:
    """Rows of sorted batches, cut where the first ``width`` columns change."""
    held: list[dict] = []
    mark = None
    for batch in batches:
        names = batch.schema.names[:width]
        for row in batch.to_pylist():
            now = tuple(row[n] for n in names)
            if held and now != mark:
                yield held
                held = []
            mark = now
            held.append(row)
    if held:
        yield held


def _sized(table: DataFrame) -> DataFrame:
    """A written table of ids, to be broadcast where its count allows it, so that texts stay in place."""
    return F.broadcast(table) if table.count() <= BROADCAST_IDS else table


def _bounded(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (a, b) of classes that sizes and bitmaps allow to link."""
    left, right = (classes.select(F.col("id").alias(x), F.col("n").alias(f"n_{x}"), F.col("bits").alias(f"bits_{x}")) for x in "ab")
    near = (F.least("n_a", "n_b") * DENOMINATOR) >= (F.greatest("n_a", "n_b") * NUMERATOR)
    sized = pairs.join(right, "b").join(left, "a").where(near)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = (np.asarray(batch.column(c)) for c in ("n_a", "n_b"))
            keep = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch.column("bits_a").to_pylist(), batch.column("bits_b").to_pylist())):
                size = min(len(x), len(y))
                x, y = (folded(np.frombuffer(v, np.uint8), size).view(np.uint64) for v in (x, y))
                keep[i] = possible(n[i], m[i], most_common(n[i], x, m[i : i + 1], y[None])[0])
            yield batch.filter(pa.array(keep)).select(["a", "b"])

    return sized.select("a", "b", "n_a", "n_b", "bits_a", "bits_b").mapInArrow(run, "a long, b long")


def _verify(pairs: DataFrame, docs: DataFrame, classes: DataFrame, key: str, text: str, once: bool) -> DataFrame:
    """The pairs (a, b) of classes that link by exact intersection.

    All partners of ``a`` are compared with it in groups of up to about TILE, so
    a class with very many partners is spread over tasks. Only the texts of
    classes in pairs are moved: one row's each, told by its id and the digest of its text.
    ``once``: no row of ``docs`` repeats an id.
    """
    sizes = pairs.groupBy("a").agg(F.ceil(F.count("*") / F.lit(TILE)).cast("int").alias("groups"))
    placed = pairs.join(sizes, "a").withColumn("part", F.pmod(F.xxhash64("b"), F.col("groups")).cast("int"))
    members = placed.select("a", "part", F.col("b").alias("id"), F.lit(1).alias("role"))
    heads = sizes.select("a", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("part"), F.col("a").alias("id"), F.lit(0).alias("role"))
    needed = stored(members.union(heads), "pairs-to-verify")
    wanted = needed.select("id").distinct().join(classes.select("id", "key", "mark"), "id")
    ids = _sized(stored(wanted, "ids-to-verify"))
    rows_of = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("mark"))
    texts = rows_of.join(ids, ["key", "mark"]).select("id", "text")
    if not once:
        texts = texts.dropDuplicates(["id"])
    rows = needed.join(texts, "id").select("a", "part", "role", "id", "text")
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, mark, found = None, None, set()
        for batch in batches:
            for part in slices(batch.select(["id", "text", "a", "part", "role"]), SLICE):
                sets = shingles(part.column(1).to_pylist())
                for own, a, p, role, b in zip(sets, *(part.column(c).to_pylist() for c in (2, 3, 4, 0))):
                    if (a, p) != mark:
                        mark, head = (a, p), None
                    if role == 0:
                        head = own
                    elif head is not None and linked(head, own):
                        found.add((a, b))
            out = sorted(found)
            found = set()
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], type=arrow[i].type) for i in (0, 1)], schema=arrow)

    spread = rows.repartition("a", "part").sortWithinPartitions("a", "part", "role", "id")
    return spread.mapInArrow(run, schema)


def _tiles(rows: DataFrame, bits: DataFrame, nearest: bool) -> DataFrame:
    """Candidate pairs (a, b) from members (shingle, pos, id, component, n) that share a shingle;
    with ``nearest`` only each member's best one of a tile.

    A band holds sizes within a factor of 4/3; a pair's bands differ by one at
    most, so members go to their own band and the next as tiles. Large tiles are
    cut into pieces, and each two pieces meet once. Bitmaps (id, bits) join last.
    """
    band = F.floor(F.log(F.col("n").cast("double")) / F.lit(float(np.log(DENOMINATOR / NUMERATOR))) + F.lit(1e-9)).cast("int")
    banded = rows.withColumn("own", band).withColumn("band", F.explode(F.array("own", F.col("own") + 1)))
    sizes = (
        banded.groupBy("shingle", "band")
        .agg(F.ceil(F.count("*") / F.lit(TILE)).cast("int").alias("pieces"), F.min("component").alias("low"), F.max("component").alias("high"), F.max(F.col("own") == F.col("band")).alias("home"))
        .where("low <> high and home").drop("low", "high", "home")
    )
    placed = banded.join(sizes, ["shingle", "band"]).withColumn("piece", F.pmod(F.xxhash64("id"), F.col("pieces")).cast("int"))
    spread = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))).select(
        "shingle", "band", F.least("piece", "other").alias("left"), F.greatest("piece", "other").alias("right"),
        "piece", "own", "id", "component", "n", "pos",
    ).join(bits, "id")
    spread = spread.select("shingle", "band", "left", "right", "piece", "own", "id", "component", "n", "pos", "bits")
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _grouped(batches, 4):
            out = tile_pairs(group, nearest)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], type=arrow[i].type) for i in (0, 1)], schema=arrow)

    sorted_tiles = spread.repartition("shingle", "band", "left", "right").sortWithinPartitions("shingle", "band", "left", "right", "id")
    return sorted_tiles.mapInArrow(run, schema).distinct()


def tile_pairs(group: list[dict], nearest: bool = False) -> list[tuple]:
    """Pairs of a tile that the places of its shingle and the bit counts allow to link.

    Of two sets' first common shingle, none before it is shared: what follows it in
    the shorter rest bounds the overlap. A pair that fails here by another than its
    first common shingle meets again at that one. With ``nearest`` each member has the
    pair with the highest bound only.
    """
    size = min(len(r["bits"]) for r in group)
    maps = np.stack([folded(np.frombuffer(r["bits"], np.uint8), size) for r in group]).view(np.uint64)
    n, left = np.array([r["n"] for r in group]), np.array([r["n"] - r["pos"] for r in group])
    band = group[0]["band"]
    own = np.array([r["own"] for r in group])
    piece = np.array([r["piece"] for r in group])
    _, component = np.unique([r["component"] for r in group], return_inverse=True)
    split = group[0]["left"] != group[0]["right"]
    out = []
    for at in range(len(group)):
        rest = np.arange(at + 1, len(group))
        ok = (own[rest] == band) | (own[at] == band)
        ok &= (np.minimum(n[rest], n[at]) * DENOMINATOR) >= (np.maximum(n[rest], n[at]) * NUMERATOR)
        ok &= possible(n[rest], n[at], np.minimum(left[rest], left[at])) & (component[rest] != component[at])
        if split:
            ok &= piece[rest] != piece[at]
        rest = rest[ok]
        if not len(rest):
            continue
        most = most_common(n[at], maps[at], n[rest], maps[rest])
        allowed = possible(n[rest], n[at], most)
        out += zip((most[allowed] / (n[rest[allowed]] + n[at])).tolist(), repeat(at), rest[allowed].tolist())
    if nearest:
        best: dict[int, tuple] = {}
        for pair in out:
            for end in pair[1:]:
                best[end] = max(best.get(end, pair), pair)
        out = set(best.values())
    return [tuple(sorted((group[i]["id"], group[k]["id"]))) for _, i, k in out]


def _stars(groups: DataFrame) -> DataFrame:
    """The groups found so far as links, one a member."""
    return groups.where("g <> component").select(F.col("g").alias("a"), F.col("component").alias("b"))


def jaccard_components(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Shingle count and component of every document: key, n_shingles, component_id.

    One row per input row. Documents without words have 0 shingles and are their
    own component, as are rows without an id (null component). Hashes have 64
    bits. Rows that share an id but not their set are documents of their own; each
    has the smallest id reachable from it.
    """
    known = docs.where(F.col(key).isNotNull())
    sketches = stored(_sketches(docs, key, text, _frequent(docs, key, text)), "sketches")
    base = sketches.where((F.col("n") > 0) & F.col(key).isNotNull())
    once = base.groupBy(key).count().where("count > 1").isEmpty()
    # Classes have ids of their own: the ids of documents may repeat.
    first = F.min(F.struct(F.col(key).alias("key"), "mark")).alias("row")
    made = base.groupBy("n", "one", "two").agg(first, *(F.first(c).alias(c) for c in ("minima", "prefix", "bits")))
    classes = stored(made.select(F.monotonically_increasing_id().alias("id"), "row.*", "n", "one", "two", "minima", "prefix", "bits"), "classes")

    # Link every class to one of those with a minimum hash in common, another one
    # for each hash: copies of one text need not all be near any single copy.
    minima = classes.select("id", F.posexplode("minima").alias("which", "least"))
    pivots = minima.groupBy("which", "least").agg(
        F.min_by("id", F.xxhash64("id", "which")).alias("a"), F.min("id").alias("low"), F.max("id").alias("high")
    ).where("low <> high").drop("low", "high")
    near = minima.join(pivots, ["which", "least"]).where("id <> a").select("a", F.col("id").alias("b")).distinct()
    near = stored(_bounded(stored(near, "pairs"), classes), "bounded-pairs")
    links = stored(_verify(near, known, classes, key, text, once), "links")
    groups = stored(connected(links).withColumnRenamed("id", "g"), "groups")

    # Then whatever shares a first shingle across components.
    labels = classes.join(groups, F.col("id") == F.col("g"), "left").select("id", "n", F.coalesce("component", "id").alias("component"), "prefix")
    flat = labels.select("id", "component", "n", F.posexplode("prefix").alias("pos", "shingle"))
    shared = stored(
        flat.groupBy("shingle").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("shingle"),
        "shared-shingles",
    )
    meeting = stored(flat.join(shared, "shingle"), "meeting")
    # Shingles with the same members (those of one passage, say) need one tile only:
    # that of the first in the common order, which has the smallest places.
    members = meeting.groupBy("shingle").agg(
        F.count("*").alias("size"), F.bit_xor(F.xxhash64("id")).alias("first"),
        F.bit_xor(F.xxhash64("id", F.lit(1))).alias("second"), F.sum("pos").alias("places"),
    )
    one_each = stored(members.groupBy("size", "first", "second").agg(F.min_by("shingle", "places").alias("shingle")).select("shingle"), "tiles")
    rows = stored(meeting.join(one_each, "shingle"), "tile-members")
    bits = classes.select("id", "bits")
    # Groups of copies that are near each other, but not to any one, first grow
    # together by everyone's nearest; then no pair of two groups is left out.
    nearest = stored(_verify(stored(_tiles(rows, bits, True), "nearest-pairs"), known, classes, key, text, once), "nearest-links")
    groups = stored(connected(_stars(groups).union(nearest)).withColumnRenamed("id", "g"), "groups")
    rows = rows.join(groups.withColumnRenamed("component", "now"), F.col("id") == F.col("g"), "left")
    rows = rows.select("shingle", "pos", "id", F.coalesce("now", "id").alias("component"), "n")
    more = stored(_verify(stored(_tiles(rows, bits, False), "pairs"), known, classes, key, text, once), "more-links")

    whole = connected(_stars(groups).union(more)).withColumnsRenamed({"id": "c_id", "component": "c_component"})
    placed = classes.join(whole, F.col("id") == F.col("c_id"), "left").select("n", "one", "two", "key", F.coalesce("c_component", "id").alias("group"))
    least = placed.groupBy("group").agg(F.min("key").alias("component_id"))
    named = placed.join(least, "group").select(*(F.col(c).alias(f"c_{c}") for c in ("n", "one", "two")), "component_id")
    slim = sketches.select(key, "n", "one", "two")
    joined = slim.join(named, (F.col("n") == F.col("c_n")) & (F.col("one") == F.col("c_one")) & (F.col("two") == F.col("c_two")), "left")
    own_id = F.when(F.col(key).isNull(), F.lit(None)).when(F.col("n") == 0, F.col(key)).otherwise(F.col("component_id"))
    return joined.select(key, F.col("n").alias("n_shingles"), own_id.alias("component_id"))
