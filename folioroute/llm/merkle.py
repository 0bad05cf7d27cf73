"""Merkle manifest of a dataset with octopus multiproofs.

Each row is a leaf; the leaves of a group (a language) form a tree of eight
children a node, and the groups' roots form one tree more. The leaves are sorted
once as slim digests and dealt out in leaf partitions of consecutive places. Each
partition folds its own leaves as far up as they reach and hands over only the
nodes at its border; those few nodes are joined up level by level.

For the proofs a leaf partition works out the minimal union of the nodes that its
leaves need and cannot derive themselves (an octopus of paths to the root),
fetches them in one join, derives the shared interiors, and expands the proof of
every single leaf from them.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioroute.llm.common import grouped_rows, range_sorted, stored
from folioroute.session import local_frame

FANOUT = 8
#: Consecutive leaves of a leaf partition.
LEAVES = 512
#: Leaf partitions that ask one copy of a node.
ASKERS = 1000
#: Rows and bytes of a written table up to which (both counted) it is broadcast.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 16_000_000
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest_of(parts: list[str]) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def encoded(value: Column) -> Column:
    """A field inside a leaf: ``-`` if null, else its UTF-8 length, a colon and itself."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(fields: list[Column]) -> Column:
    return F.sha2(F.concat(*(encoded(f) for f in fields)), 256)


# one segment of consecutive leaves


def widths(n: int) -> list[int]:
    """Nodes of each level of a tree of ``n`` leaves, up to the one root."""
    out = [n]
    while out[-1] > 1:
        out.append(-(-out[-1] // FANOUT))
    return out


def border(first: int, leaves: list[str], n: int) -> Iterator[tuple[int, int, str]]:
    """(level, place, digest) of the nodes a segment of leaves can derive whose parents it cannot.

    The root counts as such a node.
    """
    nodes = leaves
    for level, width in enumerate(widths(n)):
        last = first + len(nodes)
        low = -(-first // FANOUT)
        high = -(-width // FANOUT) if last == width else last // FANOUT
        if width == 1 or high <= low:
            yield from ((level, first + i, d) for i, d in enumerate(nodes))
            return
        yield from ((level, first + i, nodes[i]) for i in range(low * FANOUT - first))
        yield from ((level, i, nodes[i - first]) for i in range(min(high * FANOUT, width), last))
        nodes = [digest_of(nodes[p * FANOUT - first : (p + 1) * FANOUT - first]) for p in range(low, high)]
        first = low


def missing(first: int, last: int, n: int) -> Iterator[tuple[int, int]]:
    """The octopus: the fewest (level, place) that complete the paths of leaves ``first`` to ``last`` to the root."""
    for level, width in enumerate(widths(n)):
        if width == 1:
            return
        start, end = first // FANOUT * FANOUT, min((last // FANOUT + 1) * FANOUT, width)
        yield from ((level, i) for i in range(start, first))
        yield from ((level, i) for i in range(last + 1, end))
        first, last = first // FANOUT, last // FANOUT


def interiors(first: int, leaves: list[str], n: int, fetched: dict[tuple[int, int], str]) -> list[dict[int, str]]:
    """Per level, the digests by place that the leaves' proofs need: derived ones and fetched ones."""
    last = first + len(leaves) - 1
    levels = [dict(enumerate(leaves, first))]
    for level, width in enumerate(widths(n)):
        known = levels[level]
        if width == 1:
            return levels
        start, end = first // FANOUT * FANOUT, min((last // FANOUT + 1) * FANOUT, width)
        known |= {i: fetched[level, i] for i in range(start, end) if i not in known}
        first, last = first // FANOUT, last // FANOUT
        levels.append({p: digest_of([known[i] for i in range(p * FANOUT, min((p + 1) * FANOUT, width))]) for p in range(first, last + 1)})
    return levels


def path(levels: list[dict[int, str]], place: int, n: int) -> list[tuple[list[str], list[str]]]:
    """The proof of one leaf: its siblings to the left and to the right on every level."""
    out = []
    for known, width in zip(levels, widths(n)[:-1]):
        start = place // FANOUT * FANOUT
        end = min(start + FANOUT, width)
        out.append(([known[i] for i in range(start, place)], [known[i] for i in range(place + 1, end)]))
        place //= FANOUT
    return out


def fold(leaf: str, proof: list[tuple[list[str], list[str]]]) -> str:
    """The root that a leaf and its siblings give."""
    for left, right in proof:
        leaf = digest_of([*left, leaf, *right])
    return leaf


# trees as tables


def _sized(table: DataFrame, text: str) -> DataFrame:
    """A written table, to be broadcast where its counted rows and bytes allow it."""
    rows, size = table.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(F.col(text).cast("string"))), F.lit(0))).first()
    return F.broadcast(table) if rows <= BROADCAST_ROWS and size <= BROADCAST_BYTES else table


def tree_nodes(leaves: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """Nodes (tree, n, level, place, digest) that leaf partitions share, and the roots (tree, n, root).

    ``leaves`` has tree, n (its number of leaves), place and leaf. A leaf partition
    is ``size`` consecutive places, so no task holds more of a tree at once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in grouped_rows(batches, 2):
            tree, n, first = (group.column(c)[0].as_py() for c in ("tree", "n", "place"))
            level, place, digest = zip(*border(first, group.column("leaf").to_pylist(), n))
            ids = [pa.array(np.full(len(level), x), pa.int64()) for x in (tree, n)]
            yield pa.RecordBatch.from_arrays([*ids, pa.array(level, pa.int32()), pa.array(place, pa.int64()), pa.array(digest, pa.string())], ["tree", "n", "level", "place", "digest"])

    spread = leaves.select("tree", F.floor(F.col("place") / F.lit(size)).alias("part"), "n", "place", "leaf").repartition("tree", "part").sortWithinPartitions("tree", "part", "place")
    edge = stored(spread.mapInArrow(run, "tree long, n long, level int, place long, digest string"), "border-nodes")
    high = edge.agg(F.max("n")).first()[0]
    found, built = edge, None
    for level, width in enumerate(widths(high)[:-1] if high else []):
        below = edge.where(F.col("level") == level)
        below = below if built is None else below.union(built)
        parent = F.floor(F.col("place") / F.lit(FANOUT))
        joined = (
            below.where(F.col("n") > F.lit(FANOUT**level)).groupBy("tree", "n", parent.alias("place"))
            .agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "digest"))), lambda x: x["digest"]), ""), 256).alias("digest"))
        )
        built = stored(joined.select("tree", "n", F.lit(level + 1).alias("level"), "place", "digest"), "inner-nodes")
        found = found.union(built)
    # A tree of n leaves has its root on the first level of FANOUT^level >= n.
    top = F.when(F.col("n") == 1, F.col("level") == 0).otherwise((F.pow(F.lit(FANOUT), F.col("level")) >= F.col("n")) & (F.pow(F.lit(FANOUT), F.col("level") - 1) < F.col("n")))
    return found, found.where(top).select("tree", "n", F.col("digest").alias("root"))


def fetched_nodes(segments: DataFrame, nodes: DataFrame, size: int) -> DataFrame:
    """(tree, part, nodes): for each leaf partition the nodes it is missing, fetched in one join.

    ``segments`` has tree, part, n. A node of level k is asked for by the leaf partitions
    below its parent, whose number is known, so it is dealt out in as many copies as keep
    the askers of each below ASKERS; on all levels that are fewer rows than leaf partitions.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for tree, part, n in zip(*(batch.column(i).to_pylist() for i in range(3))):
                first = part * size
                rows += ((tree, part, level, place) for level, place in missing(first, min(first + size, n) - 1, n))
            columns = list(zip(*rows)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int64()))], ["tree", "part", "level", "place"])

    copies = F.greatest(F.lit(1), F.ceil(F.pow(F.lit(FANOUT), F.col("level") + 1) / F.lit(size * ASKERS))).cast("int")
    wanted = segments.select("tree", "part", "n").mapInArrow(run, "tree long, part long, level int, place long").withColumn("copy", F.pmod(F.col("part"), copies).cast("int"))
    dealt = nodes.select("tree", "level", "place", "digest", F.explode(F.sequence(F.lit(0), F.least(copies, F.ceil(F.col("n") / F.lit(size)).cast("int")) - 1)).alias("copy"))
    return (
        wanted.join(dealt, ["tree", "level", "place", "copy"])
        .groupBy("tree", "part").agg(F.collect_list(F.struct("level", "place", "digest")).alias("nodes"))
    )


def manifest(docs: DataFrame, key: str = "doc_id", group: str = "lang", fields: tuple[str, ...] = FIELDS, changed: str = "text", size: int = LEAVES) -> DataFrame:
    """Leaf, subroot, root and checked proof of every row: key, leaf, subroot, root, proof_sha256, folded_root, verified.

    Leaves of a group ascend by key, null first, and by their digest where keys
    repeat; rows equal in all fields give as many equal leaves, each with its own
    proof. A null group is a tree of its own, the first. Where 3 divides the crc32 of
    the key, the leaf that is folded up has its A-Z in ``changed`` lower-cased
    (a null key is never changed). No rows give no rows.
    """
    columns = {f: F.col(f) for f in fields}
    touched = F.crc32(F.col(key).cast("string")) % 3 == 0
    other = columns | {changed: F.translate(columns[changed], UPPER, LOWER)}
    slim = docs.select(
        F.col(key).alias("key"), F.col(group).alias("group"), leaf_digest(list(columns.values())).alias("leaf"),
        F.when(touched & (other[changed] != columns[changed]), leaf_digest(list(other.values()))).alias("tampered"),
    )
    placed = range_sorted(stored(slim, "leaves"), ["group", "key", "leaf"], "sorted-leaves")
    # One row a group and part: at most as many as there are groups and parts.
    runs = stored(placed.groupBy("part", "group").agg(F.min("row").alias("first"), F.count("*").alias("held")), "runs")
    groups = range_sorted(runs.groupBy("group").agg(F.sum("held").alias("n")), ["group"], "groups")
    before, total = [], 0
    for r in groups.groupBy("part").count().orderBy("part").collect():  # a row a task
        before.append((r["part"], total))
        total += r["count"]
    offset = F.broadcast(local_frame(docs.sparkSession, before, "part int, before bigint"))
    trees = stored(groups.join(offset, "part").select("group", "n", (F.col("row") + F.col("before")).alias("tree")), "trees")
    ahead = Window.partitionBy("group").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = runs.withColumn("base", F.coalesce(F.sum("held").over(ahead), F.lit(0)) - F.col("first"))
    known = _sized(trees, "group")
    bases = stored(bases.join(known, bases["group"].eqNullSafe(known["group"])).select(bases["part"], bases["group"], "base", "n", "tree"), "bases")
    few = _sized(bases, "group")
    same = (placed["part"] == few["part"]) & placed["group"].eqNullSafe(few["group"])
    leaves = stored(placed.join(few, same).select("tree", "n", (F.col("row") + F.col("base")).alias("place"), "key", "leaf", "tampered"), "placed-leaves")

    nodes, subroots = tree_nodes(leaves, size)
    subroots = stored(subroots, "subroots")
    upper = subroots.select(F.lit(0).cast("long").alias("tree"), F.lit(total).cast("long").alias("n"), F.col("tree").alias("place"), F.col("root").alias("leaf"))
    top, roots = tree_nodes(upper, 1)
    root = roots.first()
    root = root["root"] if root else ""
    # A group's way from its root to the dataset's is the same for all its leaf partitions.
    up = fetched_nodes(upper.select("tree", F.col("place").alias("part"), "n"), top, 1).select(F.col("part").alias("up_tree"), F.col("nodes").alias("up"))
    ways = subroots.join(up, subroots["tree"] == up["up_tree"], "left").select("tree", "n", F.col("root").alias("subroot"), "up")
    segments = ways.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / F.lit(size)))))
    segments = stored(segments, "leaf-partitions")
    fetched = fetched_nodes(segments, nodes, size).withColumnsRenamed({"tree": "f_tree", "part": "f_part"})
    heads = segments.join(fetched, (segments["tree"] == fetched["f_tree"]) & (segments["part"] == fetched["f_part"]), "left")

    def digests(node: Column) -> Column:
        return F.coalesce(node, F.array().cast("array<struct<level:int,place:bigint,digest:string>>"))

    kind = docs.schema[key].dataType.simpleString()
    rows = leaves.select("tree", F.floor(F.col("place") / F.lit(size)).alias("part"), "place", "n", "key", "leaf", "tampered", F.lit(None).cast("string").alias("subroot"), digests(F.lit(None)).alias("up"), digests(F.lit(None)).alias("nodes"))
    head = heads.select("tree", "part", F.lit(-1).cast("long").alias("place"), "n", F.lit(None).cast(kind).alias("key"), F.lit(None).cast("string").alias("leaf"), F.lit(None).cast("string").alias("tampered"), "subroot", digests(F.col("up")).alias("up"), digests(F.col("nodes")).alias("nodes"))

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own in grouped_rows(batches, 2):
            info = own.slice(0, 1).to_pylist()[0]
            own = own.slice(1)
            tree, n, first = info["tree"], info["n"], own.column("place")[0].as_py()
            leaf = own.column("leaf").to_pylist()
            levels = interiors(first, leaf, n, {(x["level"], x["place"]): x["digest"] for x in info["nodes"]})
            above = path(interiors(tree, [info["subroot"]], total, {(x["level"], x["place"]): x["digest"] for x in info["up"]}), tree, total)
            proofs, folded = [], []
            for i, (own_leaf, other_leaf) in enumerate(zip(leaf, own.column("tampered").to_pylist())):
                proof = path(levels, first + i, n) + above
                proofs.append(digest_of([x for left, right in proof for x in (*left, *right)]))
                folded.append(fold(other_leaf or own_leaf, proof))
            text = [pa.array(x, pa.string()) for x in ([info["subroot"]] * len(leaf), [root] * len(leaf), proofs, folded)]
            yield pa.RecordBatch.from_arrays(
                [own.column("key").combine_chunks(), own.column("leaf").combine_chunks(), *text, pa.array([x == root for x in folded], pa.bool_())],
                [key, "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"],
            )

    out = f"`{key}` {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return head.union(rows).repartition("tree", "part").sortWithinPartitions("tree", "part", "place").mapInArrow(expand, out)
