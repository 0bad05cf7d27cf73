"""Approximate nearest neighbours by stable projections and a kd-tree.

Vectors get one coordinate more, so that the largest inner product is the smallest
distance, and are projected on a few random Gaussian lines. A pair's projected
squared distance over its true one is chi-square with as many degrees of freedom
as there are lines. A kd-tree over the projections gives a query's neighbours in
their order there; each is verified by its true product, until the projected
distance is so large that a vector still to come is closer than the k-th found so
far with a small chance only.

The upper levels of the tree deal the vectors out to tasks, each of which builds
the rest over its own. A query first searches the leaf it falls in. The k-th
distance found there bounds, by the same test, the leaves it has to visit at all.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from folioroute.llm.common import grouped_rows, stored

NEAREST, EVERY = 20, 20
#: Lines projected on, and the chance that a true neighbour is inside the radius of the stopping test.
LINES, CERTAINTY = 12, 0.95
#: Vectors wanted in a leaf of the upper tree, its most leaves, and the projected vectors (at most twice that many) that fit its cuts.
LEAF, MOST_LEAVES, SAMPLE = 2048, 4096, 32_768
#: Vectors and queries that one group holds; larger leaves are dealt out to several groups.
PIECE, QUERIES = 16_384, 8_192
#: Vectors of a bucket at the end of the tree.
BUCKET = 64


def chi_square_below(x: float, freedom: int) -> float:
    """The chi-square distribution's probability below ``x``, for an even number of degrees of freedom."""
    term = total = math.exp(-x / 2)
    for i in range(1, freedom // 2):
        term *= x / 2 / i
        total += term
    return 1 - total


def stopping_ratio(certainty: float = CERTAINTY, lines: int = LINES) -> float:
    """Projected over true squared distance below which the test has not yet stopped."""
    low, high = 0.0, 1000.0
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square_below(middle, lines) < certainty else (low, middle)
    return high


@dataclass
class Space:
    """How vectors become points: the largest component and the largest squared length after dividing by it."""

    scale: float
    reach: float

    def lines(self, dims: int) -> np.ndarray:
        return np.random.default_rng(dims).normal(size=(dims + 1, LINES))

    def project(self, vectors: np.ndarray, asked: bool = False) -> np.ndarray:
        """Points of vectors of one length; those of queries have no further coordinate."""
        x = vectors / self.scale
        rest = np.zeros(len(x)) if asked else np.sqrt(np.maximum(self.reach - np.einsum("ij,ij->i", x, x), 0))
        return np.column_stack([x, rest]) @ self.lines(vectors.shape[1])

    def distance(self, vector: np.ndarray, product: float) -> float:
        """Squared distance of a query to a vector of this product with it."""
        x = vector / self.scale
        return float(x @ x) + self.reach - 2 * product / self.scale / self.scale


def cut(points: np.ndarray, most: int, depth: int = 64) -> list:
    """kd-tree of points as nested lists: [line, value, below, above] or an array of row numbers."""

    def split(rows: np.ndarray, depth: int) -> list | np.ndarray:
        if len(rows) <= most or not depth:
            return rows
        own = points[rows]
        line = int(np.argmax(own.max(0) - own.min(0)))
        value = float(np.median(own[:, line]))
        under = own[:, line] < value
        if not under.any() or under.all():
            return rows
        return [line, value, split(rows[under], depth - 1), split(rows[~under], depth - 1)]

    return split(np.arange(len(points)), depth)


def ends(tree: list | np.ndarray) -> Iterator[np.ndarray]:
    if isinstance(tree, list):
        yield from ends(tree[2])
        yield from ends(tree[3])
    else:
        yield tree


def numbered(tree: list | np.ndarray, count: list[int] | None = None) -> list | int:
    """The tree's cuts, with a number in place of each end."""
    count = [0] if count is None else count
    if isinstance(tree, list):
        return [tree[0], tree[1], numbered(tree[2], count), numbered(tree[3], count)]
    count[0] += 1
    return count[0] - 1


def leaf_of(tree: list | int, points: np.ndarray) -> np.ndarray:
    """The number of the end each point falls in."""
    out = np.zeros(len(points), np.int32)

    def fall(node: list | int, rows: np.ndarray) -> None:
        if not len(rows):
            return
        if isinstance(node, list):
            under = points[rows, node[0]] < node[1]
            fall(node[2], rows[under])
            fall(node[3], rows[~under])
        else:
            out[rows] = node

    fall(tree, np.arange(len(points)))
    return out


def box_distance(low: np.ndarray, high: np.ndarray, point: np.ndarray) -> np.ndarray:
    """Squared distances of a point to boxes."""
    away = np.maximum(np.maximum(low - point, point - high), 0)
    return np.einsum("ij,ij->i", away, away)


class Index:
    """The lower part of the tree: vectors of one length in buckets, searched in projected order."""

    def __init__(self, space: Space, vectors: np.ndarray, points: np.ndarray):
        rows = list(ends(cut(points, BUCKET)))
        order = np.concatenate(rows)
        self.space, self.order = space, order
        self.vectors, self.points = vectors[order], points[order]
        self.start = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
        self.low = np.stack([points[r].min(0) for r in rows])
        self.high = np.stack([points[r].max(0) for r in rows])

    def search(self, vector: np.ndarray, point: np.ndarray, weight: np.ndarray, wanted: int, bound: float, ratio: float) -> tuple[np.ndarray, np.ndarray]:
        """Rows and products of the best found. ``bound``: a product that ``wanted`` rows elsewhere reach already.

        ``weight`` is the number of candidates a row stands for. Buckets come by their
        projected distance, so the next one's is the least of all that are left.
        """
        away = box_distance(self.low, self.high, point)
        turn = np.argsort(away, kind="stable")
        rows, products = np.zeros(0, np.int64), np.zeros(0)
        at, step = 0, 1
        while at < len(turn):
            limit = ratio * self.space.distance(vector, bound) if bound > -np.inf else np.inf
            if away[turn[at]] > limit:
                break
            buckets = turn[at : at + step]
            at, step = at + step, step * 2
            near = np.concatenate([np.arange(self.start[b], self.start[b + 1]) for b in buckets])
            gap = self.points[near] - point
            near = near[np.einsum("ij,ij->i", gap, gap) <= limit]
            made = np.einsum("ij,j->i", self.vectors[near], vector)
            good = made >= bound
            rows, products = np.concatenate([rows, self.order[near[good]]]), np.concatenate([products, made[good]])
            best = np.argsort(-products, kind="stable")
            held = np.cumsum(weight[rows[best]])
            enough = int(np.searchsorted(held, wanted))
            if enough < len(best):
                bound = max(bound, float(products[best[enough]]))
                best = best[products[best] >= bound]
            rows, products = rows[best], products[best]
        return rows, products


def usable(embedding: str):
    """Vectors that take part: not null, no null or non-finite component, not zero."""
    bad = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(F.col(embedding).isNotNull() & ~bad & F.exists(embedding, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.ChunkedArray | pa.Array, dims: int) -> np.ndarray:
    """Vectors of one length, stored as bytes."""
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, dims)


def _points(classes: DataFrame, space: Space) -> DataFrame:
    """Per distinct vector its bytes and its point."""
    schema = T.StructType([
        classes.schema["uid"], classes.schema["ids"], classes.schema["asks"], T.StructField("dims", T.IntegerType()),
        T.StructField("vector", T.BinaryType()), T.StructField("point", T.ArrayType(T.DoubleType())),
    ])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 2000):
                batch = whole.slice(start, 2000)
                values = batch.column("embedding")
                dims = np.asarray(pa.compute.list_value_length(values))
                for d in np.unique(dims).tolist():
                    part = batch.filter(pa.array(dims == d))
                    vectors = np.asarray(part.column("embedding").flatten(), float).reshape(-1, d)
                    points = space.project(vectors)
                    arrays = [
                        *(part.column(c) for c in ("uid", "ids", "asks")), pa.array(np.full(len(vectors), d), pa.int32()),
                        pa.array([v.tobytes() for v in vectors], pa.binary()), pa.array(points.tolist(), pa.list_(pa.float64())),
                    ]
                    yield pa.RecordBatch.from_arrays([a.cast(f.type) for a, f in zip(arrays, arrow)], schema=arrow)

    return classes.select("uid", "ids", "asks", "embedding").mapInArrow(run, schema)


def _search(points: DataFrame, asked: DataFrame, space: Space, wanted: int, ratio: float) -> DataFrame:
    """(uid, score, id, other): the best candidates each group finds for its queries.

    ``points`` has leaf, piece, uid, ids, dims, vector; ``asked`` has leaf, uid, dims,
    vector and bound. Every query of a leaf meets all its pieces; many queries are
    dealt out to several groups.
    """
    pieces = points.groupBy("leaf").agg((F.max("piece") + 1).alias("pieces"))
    # A row a leaf, so at most MOST_LEAVES.
    loads = F.broadcast(asked.groupBy("leaf").agg(F.ceil(F.count("*") / F.lit(QUERIES)).cast("int").alias("slices")).join(pieces, "leaf"))
    kind = points.schema["ids"].dataType
    left = points.join(loads, "leaf").select(
        "leaf", "piece", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), F.lit(0).alias("kind"),
        "dims", "uid", "vector", "ids", F.lit(None).cast("double").alias("bound"),
    )
    right = asked.join(loads, "leaf").select(
        "leaf", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"), F.pmod(F.xxhash64("uid"), "slices").cast("int").alias("slice"), F.lit(1).alias("kind"),
        "dims", "uid", "vector", F.lit(None).cast(kind).alias("ids"), "bound",
    )
    schema = T.StructType([
        T.StructField("uid", T.LongType()), T.StructField("score", T.DoubleType()), T.StructField("id", kind.elementType), T.StructField("other", T.LongType()),
    ])
    arrow = to_arrow_schema(schema)
    by = ["leaf", "piece", "slice"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in grouped_rows(batches, 3):
            what, lengths = np.asarray(group.column("kind")), np.asarray(group.column("dims"))
            for dims in np.unique(lengths[what == 1]).tolist():
                own = group.filter(pa.array((what == 0) & (lengths == dims)))
                if not own.num_rows:
                    continue
                asks = group.filter(pa.array((what == 1) & (lengths == dims)))
                vectors, ids, uids = _matrix(own.column("vector"), dims), own.column("ids").to_pylist(), own.column("uid").to_pylist()
                weight = np.fromiter(map(len, ids), np.int64, len(ids))
                index = Index(space, vectors, space.project(vectors))
                queries = _matrix(asks.column("vector"), dims)
                places = space.project(queries, asked=True)
                out: list[tuple] = []
                for uid, bound, query, place in zip(asks.column("uid").to_pylist(), asks.column("bound").to_pylist(), queries, places):
                    rows, products = index.search(query, place, weight, wanted, -np.inf if bound is None else bound, ratio)
                    found = sorted((-s, i, uids[r]) for r, s in zip(rows.tolist(), products.tolist()) for i in ids[r])
                    out += [(uid, -s, i, other) for s, i, other in found[:wanted]]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), arrow)], schema=arrow)

    return left.union(right).repartition(*by).sortWithinPartitions(*by, "kind", "dims", "uid").mapInArrow(run, schema)


def nearest(vectors: DataFrame, key: str = "vec_id", embedding: str = "embedding", wanted: int = NEAREST, every: int = EVERY, certainty: float = CERTAINTY) -> DataFrame:
    """The nearest by inner product found for each row whose key ``every`` divides: query_id, rank, key, score.

    All rows but the query's own are candidates, those of other lengths excepted;
    ties go to the smaller key; where there are fewer candidates, all are returned.
    Null vectors, zero ones, those with null or non-finite components and rows
    without a key take no part. Rows equal in key and vector count once; rows that
    share a key only are vectors, and queries, of their own. Equal vectors are one
    point of the index that knows its smallest keys, as many as a result can hold.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(key).alias("id"), F.col(embedding).cast("array<double>").alias("embedding")).where(usable("embedding") & F.col("id").isNotNull()).distinct()
    asks = F.col("id") % every == 0
    smallest = Window.partitionBy("embedding", "asks").orderBy("id")
    short = rows.withColumn("asks", asks).withColumn("turn", F.row_number().over(smallest)).where(F.col("turn") <= wanted + 1)
    classes = short.groupBy("embedding").agg(F.slice(F.array_sort(F.collect_list("id")), 1, wanted + 1).alias("ids"), F.max("asks").alias("asks"))
    classes = stored(classes.withColumn("uid", F.monotonically_increasing_id()), "vector-classes")

    largest = F.aggregate("embedding", F.lit(0.0), lambda a, x: F.greatest(a, F.abs(x)))
    count, scale = classes.agg(F.count("*"), F.max(largest)).first()
    scale = scale or 1.0
    reach = classes.agg(F.max(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x / scale * (x / scale)))).first()[0] or 0.0
    space, ratio = Space(scale, reach), stopping_ratio(certainty)
    placed = stored(_points(classes, space), "projections")

    # The sample fits the cuts of the upper tree only; every vector is indexed.
    share = max(1, -(-count // SAMPLE))
    drawn = np.array([r[0] for r in placed.where(F.pmod(F.xxhash64("uid"), F.lit(share)) == 0).select("point").collect()], float).reshape(-1, LINES)
    leaves = min(MOST_LEAVES, max(1, count // LEAF))
    tree = numbered(cut(drawn, max(1, -(-len(drawn) // leaves)), max(0, leaves.bit_length())))
    schema = T.StructType([*placed.schema.fields, T.StructField("leaf", T.IntegerType())])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = np.asarray(batch.column("point").flatten()).reshape(-1, LINES)
            yield batch.append_column("leaf", pa.array(leaf_of(tree, points), pa.int32()))

    dealt = placed.mapInArrow(deal, schema)
    edges = [f(F.col("point")[i]).alias(f"{f.__name__}{i}") for f in (F.min, F.max) for i in range(LINES)]
    boxes = dealt.groupBy("leaf").agg(F.count("*").alias("held"), *edges).orderBy("leaf").collect()
    number = np.array([b["leaf"] for b in boxes], np.int32)
    low, high = (np.array([[b[f"{f}{i}"] for i in range(LINES)] for b in boxes], float).reshape(-1, LINES) for f in ("min", "max"))
    held = dict(zip(number.tolist(), (b["held"] for b in boxes)))
    pieces = F.lit(1)
    for leaf, n in held.items():
        if n > PIECE:
            pieces = F.when(F.col("leaf") == leaf, F.lit(-(-n // PIECE))).otherwise(pieces)
    points = stored(dealt.withColumn("piece", F.pmod(F.xxhash64("uid"), pieces).cast("int")).drop("point"), "leaves")
    queries = points.where("asks").select("uid", "dims", "vector")

    def visits(bounded: bool):
        """Leaves to search: the one nearest to the query's point, or those that the test leaves over beside it."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                leaf: list[np.ndarray] = []
                row: list[np.ndarray] = []
                for i, (vector, bound) in enumerate(zip(batch.column("vector").to_pylist(), batch.column("bound").to_pylist())):
                    query = np.frombuffer(vector)
                    away = box_distance(low, high, space.project(query[None], asked=True)[0])
                    home = int(np.argmin(away))
                    limit = np.inf if bound is None else ratio * space.distance(query, bound)
                    to = np.setdiff1d(np.flatnonzero(away <= limit), [home]) if bounded else np.array([home])
                    leaf.append(number[to])
                    row.append(np.full(len(to), i))
                if not row:
                    continue
                at = pa.array(np.concatenate(row), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(leaf), pa.int32()), *(batch.column(c).take(at) for c in ("uid", "dims", "vector", "bound"))], ["leaf", "uid", "dims", "vector", "bound"])

        return run

    sent = "leaf int, uid long, dims int, vector binary, bound double"
    best = Window.partitionBy("uid").orderBy(F.desc("score"), "id", "other")

    def top(found: DataFrame) -> DataFrame:
        return found.withColumn("turn", F.row_number().over(best)).where(F.col("turn") <= wanted + 1)

    first = stored(queries.withColumn("bound", F.lit(None).cast("double")).mapInArrow(visits(False), sent), "first-visits")
    found = stored(top(_search(points, first, space, wanted + 1, ratio)), "first-found")
    bound = found.where(F.col("turn") == wanted + 1).select(F.col("uid").alias("known"), F.col("score").alias("bound"))
    further = queries.join(bound, queries["uid"] == bound["known"], "left").select("uid", "dims", "vector", "bound")
    further = stored(further.mapInArrow(visits(True), sent), "visits")
    more = _search(points, further, space, wanted + 1, ratio)
    whole = top(found.drop("turn").union(more)).groupBy("uid").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("less"), "id", "other"))).alias("found"))

    asking = rows.where(asks).join(classes.select("uid", F.col("embedding").alias("same")), F.col("embedding") == F.col("same")).select(F.col("id").alias("query_id"), "uid")
    others = F.filter("found", lambda x: ~((x["id"] == F.col("query_id")) & (x["other"] == F.col("uid"))))
    return (
        asking.join(whole, "uid").select("query_id", F.posexplode(F.slice(others, 1, wanted)).alias("at", "one"))
        .select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("one.id").alias(key), (-F.col("one.less")).alias("score"))
    )
