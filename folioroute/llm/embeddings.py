"""Embedding near-duplicates by collision-counting projections.

Unit vectors are projected on many random lines. On each line only the far end
is kept, sorted: there, few vectors stand, and near vectors stand together. Two
vectors collide on a line when each lies in the window around the other. Tail,
window, number of lines and the least number of collisions are calibrated so that
a pair just at the threshold is found with the wanted probability; pairs with
enough collisions are verified by their cosine in double precision.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from folioroute.llm.common import connected, stored
from folioroute.llm.jaccard import _grouped

COSINE, RECALL, LEAST = 0.93, 0.9995, 2
#: Vectors wanted in the tail of a line for the largest label, and members of a tile.
TAIL, TILE = 96, 256


@dataclass
class Plan:
    lines: int
    tail: float
    window: float
    least: int


def _below(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.vectorize(math.erf)(x / math.sqrt(2)))


def collision_probability(tail: float, window: float, cosine: float) -> float:
    """Chance that a pair of this cosine collides in the tail of one random line.

    On a Gaussian line, two unit vectors' values are normal with the cosine as
    their correlation, whatever the data.
    """
    x = np.linspace(tail, tail + 8, 2001)
    spread = math.sqrt(1 - cosine * cosine)
    low, high = np.maximum(tail, x - window), x + window
    inside = _below((high - cosine * x) / spread) - _below((low - cosine * x) / spread)
    return float(np.trapezoid(np.exp(-x * x / 2) / math.sqrt(2 * math.pi) * inside, x))


def calibrate(largest: int, cosine: float = COSINE, recall: float = RECALL, least: int = LEAST) -> Plan:
    """Lines, tail and window for labels of up to ``largest`` vectors.

    The tail gets rarer with the number of vectors, so a line's end holds about
    TAIL of them at any size; the number of lines makes up for it slowly.
    """
    share = min(0.25, TAIL / max(largest, 1))
    low, high = 0.0, 10.0
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if 1 - float(_below(np.array(middle))) > share else (low, middle)
    window = 2 * math.sqrt(2 - 2 * cosine)
    p = collision_probability(low, window, cosine)

    def found(lines: int) -> float:
        miss = sum(math.exp(math.lgamma(lines + 1) - math.lgamma(k + 1) - math.lgamma(lines - k + 1) + k * math.log(p) + (lines - k) * math.log1p(-p)) for k in range(least))
        return 1 - miss

    lines = least
    while found(lines) < recall:
        lines = math.ceil(lines * 1.05) + 1
    return Plan(lines, low, window, least)


def usable(embedding: str, label: str):
    """Vectors that can link: a label, no null or non-finite component, not zero."""
    bad = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    some = F.exists(embedding, lambda x: x != 0)
    return F.coalesce(F.col(label).isNotNull() & F.col(embedding).isNotNull() & ~bad & some, F.lit(False))


def _signatures(classes: DataFrame, plan: Plan) -> DataFrame:
    """Per distinct vector: its bytes and the lines on whose far end it stands."""
    kind = {f.name: f.dataType for f in classes.schema}
    schema = T.StructType([
        T.StructField("id", kind["id"]), T.StructField("label", kind["label"]), T.StructField("dims", T.IntegerType()),
        T.StructField("weight", T.LongType()), T.StructField("vector", T.BinaryType()),
        T.StructField("lines", T.ArrayType(T.IntegerType())), T.StructField("places", T.ArrayType(T.FloatType())),
    ])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drawn: dict[int, np.ndarray] = {}
        for whole in batches:
            for start in range(0, whole.num_rows, 1000):
                batch = whole.slice(start, 1000)
                vectors = batch.column("embedding").to_pylist()
                rows: list = [None] * len(vectors)
                dims = np.fromiter(map(len, vectors), np.int64, len(vectors))
                for d in np.unique(dims).tolist():
                    if d not in drawn:
                        drawn[d] = np.random.default_rng(d).normal(size=(d, plan.lines))
                    at = np.flatnonzero(dims == d)
                    x = np.array([vectors[i] for i in at], float)
                    scaled = x / np.abs(x).max(1, keepdims=True)
                    values = (scaled / np.linalg.norm(scaled, axis=1, keepdims=True)) @ drawn[d]
                    for i, own, value in zip(at, x, values):
                        lines = np.flatnonzero(value > plan.tail)
                        rows[i] = (own.tobytes(), lines.tolist(), value[lines].tolist())
                arrays = [
                    batch.column("id"), batch.column("label"), pa.array(dims, pa.int32()), batch.column("weight"),
                    *(pa.array([r[k] for r in rows], arrow[4 + k].type) for k in range(3)),
                ]
                yield pa.RecordBatch.from_arrays([a.cast(f.type) for a, f in zip(arrays, arrow)], schema=arrow)

    return classes.select("id", "label", "weight", "embedding").mapInArrow(run, schema)


def tile_links(group: list[dict], plan: Plan, cosine: float) -> list[tuple]:
    """Links of a tile: (id, null, linked vectors) per member, (a, b, 0) to join members up.

    A pair counts on the first line it collides on, so once over all tiles.
    """
    size = len(group)
    counts = [len(r["lines"]) for r in group]
    row = np.repeat(np.arange(size), counts)
    line = np.concatenate([r["lines"] for r in group])
    place = np.concatenate([r["places"] for r in group])
    order = np.lexsort((place, line))
    row, line, place = row[order], line[order], place[order]
    codes, on = [], []
    step = 1
    while step < len(row):
        near = np.flatnonzero((line[step:] == line[:-step]) & (place[step:] - place[:-step] <= plan.window))
        if not len(near):
            break
        a, b = row[near], row[near + step]
        codes.append(np.minimum(a, b) * size + np.maximum(a, b))
        on.append(line[near])
        step += 1
    if not codes:
        return []
    code, on = np.concatenate(codes), np.concatenate(on)
    order = np.lexsort((on, code))
    code, on = code[order], on[order]
    first = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
    collisions = np.diff(np.append(first, len(code)))
    keep = (collisions >= plan.least) & (on[first] == group[0]["line"])
    a, b = np.divmod(code[first[keep]], size)
    if group[0]["left"] != group[0]["right"]:
        piece = np.array([r["piece"] for r in group])
        apart = piece[a] != piece[b]
        a, b = a[apart], b[apart]
    vectors = np.stack([np.frombuffer(r["vector"]) for r in group])
    vectors = vectors / np.abs(vectors).max(1, keepdims=True)
    norm = np.linalg.norm(vectors, axis=1)
    linked = np.zeros(len(a), bool)
    for at in range(0, len(a), 20_000):
        s = slice(at, at + 20_000)
        linked[s] = np.einsum("ij,ij->i", vectors[a[s]], vectors[b[s]]) / (norm[a[s]] * norm[b[s]]) >= cosine
    a, b = a[linked], b[linked]
    weight = np.array([r["weight"] for r in group])
    total = np.bincount(a, weights=weight[b], minlength=size) + np.bincount(b, weights=weight[a], minlength=size)
    ids = [r["id"] for r in group]
    out = [(ids[i], None, int(total[i])) for i in np.flatnonzero(total)]
    root = list(range(size))
    for i, k in zip(a.tolist(), b.tolist()):
        while root[i] != i:
            root[i] = i = root[root[i]]
        while root[k] != k:
            root[k] = k = root[root[k]]
        if i != k:
            root[max(i, k)] = min(i, k)
            out.append((ids[i], ids[k], 0))
    return out


def near_duplicates(
    vectors: DataFrame, key: str = "vec_id", embedding: str = "embedding", label: str = "label", cosine: float = COSINE
) -> DataFrame:
    """Links and components of vectors of equal label: key, n_links, component_id, kept.

    One row per input row. Equal vectors of a label are one class that is compared
    once; its members link to each other. Vectors without a label, null, zero, or
    with null or non-finite components, link with nothing, and so do vectors of
    different lengths and rows without a key. Rows that share a key but not their
    vector are vectors of their own. Every vector is indexed.
    """
    rows = vectors.select(F.col(key).alias("key"), F.col(label).alias("label"), F.col(embedding).alias("embedding"))
    rows = rows.withColumn("usable", usable("embedding", "label") & F.col("key").isNotNull())
    classes = stored(
        rows.where("usable").groupBy("label", "embedding").agg(F.min("key").alias("least"), F.count("*").alias("weight"))
        # Classes have ids of their own: keys may repeat.
        .withColumn("id", F.monotonically_increasing_id()), "vector-classes",
    )
    largest = classes.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    plan = calibrate(largest, cosine)
    ends = stored(_signatures(classes, plan), "projections")
    tile = ["label", "dims", "line"]
    sizes = (
        ends.select("label", "dims", F.explode("lines").alias("line"))
        .groupBy(*tile).agg(F.count("*").alias("n")).where("n > 1")
        .select(*tile, F.ceil(F.col("n") / F.lit(TILE)).cast("int").alias("pieces"))
    )
    placed = ends.withColumn("line", F.explode("lines")).join(sizes, tile).withColumn("piece", F.pmod(F.xxhash64("id"), F.col("pieces")).cast("int"))
    spread = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))).select(
        *tile, F.least("piece", "other").alias("left"), F.greatest("piece", "other").alias("right"),
        "piece", "id", "weight", "vector", "lines", "places",
    )
    kind = classes.schema["id"].dataType
    schema = T.StructType([T.StructField("a", kind), T.StructField("b", kind), T.StructField("n", T.LongType())])
    arrow = to_arrow_schema(schema)
    by = [*tile, "left", "right"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _grouped(batches, len(by)):
            out = tile_links(group, plan, cosine) if len(group) > 1 else []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], type=arrow[i].type) for i in range(3)], schema=arrow)

    made = stored(spread.repartition(*by).sortWithinPartitions(*by, "id").mapInArrow(run, schema), "vector-links")
    counts = made.where("b IS NULL").groupBy("a").agg(F.sum("n").alias("links")).withColumnRenamed("a", "counted")
    whole = connected(made.where("b IS NOT NULL")).withColumnRenamed("id", "joined")
    placed = classes.join(whole, classes["id"] == whole["joined"], "left").select(
        "id", "label", "embedding", "weight", "least", F.coalesce("component", "id").alias("group")
    )
    smallest = placed.groupBy("group").agg(F.min("least").alias("component_id"))
    known = (
        placed.join(smallest, "group").join(counts, F.col("id") == F.col("counted"), "left")
        .select(
            F.col("label").alias("c_label"), F.col("embedding").alias("c_embedding"),
            (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id",
        )
    )
    same = F.col("usable") & (F.col("label") == F.col("c_label")) & (F.col("embedding") == F.col("c_embedding"))
    return (
        rows.join(known, same, "left")
        .select(
            F.col("key").alias(key),
            F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
            F.coalesce("component_id", "key").alias("component_id"),
        )
        .withColumn("kept", F.coalesce(F.col(key) == F.col("component_id"), F.lit(False)))
    )
