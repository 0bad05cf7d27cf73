"""Operators of the older rule dialect that depend on file order."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioroute import constants as K
from folioroute.functions import patterns as P
from folioroute.functions import text as X
from folioroute.operators import matching, naming
from folioroute.session import reliable
from folioroute.sources.rules import RuleSet


def running_total(rows: DataFrame, value: Column, order: str = "path", name: str = "running") -> DataFrame:
    """Running sum of one value; see ``running_totals``."""
    return running_totals(rows, {name: value}, order)


def running_totals(rows: DataFrame, values: dict[str, Column], order: str = "path") -> DataFrame:
    """Running sums over all rows in the order of a unique column.

    A plain window without partitions would pass everything through one task.
    Here the rows are split into ranges of the order column, each range sums
    up on its own, and the totals of the ranges before it are added: one row
    per range.
    """
    ranged = rows.withColumns({f"_{n}": v for n, v in values.items()}).repartitionByRange(F.col(order))
    # Range limits come from a sample; both uses below have to see the same.
    parts = reliable(ranged.withColumn("_range", F.spark_partition_id()))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        parts.groupBy("_range").agg(*[F.sum(f"_{n}").alias(f"_sum_{n}") for n in values])
        .select("_range", *[F.coalesce(F.sum(f"_sum_{n}").over(before), F.lit(0)).alias(f"_before_{n}") for n in values])
    )
    inside = (
        Window.partitionBy("_range").orderBy(order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        parts.withColumns({f"_inside_{n}": F.sum(f"_{n}").over(inside) for n in values})
        .join(offsets, "_range")
        .select(*rows.columns, *[(F.col(f"_before_{n}") + F.col(f"_inside_{n}")).alias(n) for n in values])
    )


def running_metadata_hits(
    files: DataFrame, pattern: str, seed: str = "", dialect=P.compile_legacy_pattern
) -> DataFrame:
    """``path``, the ``hits`` in a file's own metadata, and ``running_hits`` in that of
    all files up to it.

    The older dialect never clears the metadata between files, so file k is
    tested against that of files 1..k after ``seed`` (the metadata of the
    document they were cut from), without anything between them.
    """
    compiled = dialect(pattern)
    own = files.select("path", P.hit_count(F.col("metadata"), compiled).alias("hits"))
    running = _running_hits(files, compiled, seed)
    return own.join(running, "path").select("path", "hits", "running_hits")


def _running_hits(files: DataFrame, pattern: P.Pattern, seed: str) -> DataFrame:
    """``path, running_hits``: hits in the joined metadata of all files up to each.

    The joined text is cut at characters that no match can hold. What lies
    between two of them in one file is counted there. A stretch that goes on from
    file to file gets a number, which is a running count of the files that cut;
    it is put together from the pieces at the ends of its files, and tells for
    each file how many hits the stretch has so far. Every file adds the difference
    it makes, and the differences are summed up in the order of the files.

    Patterns that may match any character, or nothing, have no such places: their
    hits are counted per file, and one that reaches across two files is not seen.
    """
    cut = P.divider(pattern)
    if cut is None:
        hits = files.select("path", P.hit_count(F.col("metadata"), pattern).cast("long").alias("_hits"))
        totals = running_total(hits, F.col("_hits"), name="running_hits")
        return totals.select("path", (F.col("running_hits") + P.hit_count(F.lit(seed), pattern)).alias("running_hits"))
    source, flags = pattern.source, pattern.flags

    def count(text: str) -> int:
        return sum(1 for _ in re.finditer(source, text, flags))

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(path, *_stretches(text or "", cut, count)) for path, text in zip(batch["path"], batch["metadata"])]
            yield pd.DataFrame(rows, columns=["path", "cuts", "inside", "head", "tail"])

    pieces = files.select("path", "metadata").mapInPandas(split, "path string, cuts long, inside long, head string, tail string")
    numbered = reliable(running_totals(pieces, {"stretch": F.col("cuts")}))
    ends = F.col("cuts") == 1
    part = F.struct((F.col("stretch") - F.col("cuts")).alias("stretch"), "path", F.col("head").alias("text"), ends.alias("ends"))
    tail = F.struct("stretch", "path", F.col("tail").alias("text"), F.lit(False).alias("ends"))
    parts = (
        numbered.select(F.explode(F.when(ends, F.array(part, tail)).otherwise(F.array(part))).alias("_p")).select("_p.*")
        .where((F.length("text") > 0) | F.col("ends"))
    )
    before, so_far = _seeded(seed, cut, count)

    def grow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, text, known = None, "", 0
        for batch in batches:
            rows = []
            for stretch, path, piece in zip(batch["stretch"], batch["path"], batch["text"]):
                if stretch != current:
                    current, text, known = stretch, before if stretch == 0 else "", so_far if stretch == 0 else 0
                text += piece
                now = count(text)
                rows.append((path, now - known))
                known = now
            yield pd.DataFrame(rows, columns=["path", "more"])

    grown = parts.repartition("stretch").sortWithinPartitions("stretch", "path").mapInPandas(grow, "path string, more long")
    more = numbered.select("path", F.col("inside").alias("more")).unionByName(grown).groupBy("path").agg(F.sum("more").alias("more"))
    totals = running_total(more, F.col("more"), name="running_hits")
    return totals.select("path", (F.col("running_hits") + count(seed)).alias("running_hits"))


def _stretches(text: str, cut: str, count: Callable[[str], int]) -> tuple[int, int, str, str]:
    """Whether a text has a cut, the hits between its first and last, what is up to
    the first and what is from the last on, both with the cut itself."""
    first = re.search(cut, text)
    if first is None:
        return 0, 0, text, ""
    last = first.start()
    for at in range(len(text) - 1, last, -1):
        if re.match(cut, text[at]):
            last = at
            break
    return 1, count(text[first.start() : last + 1]), text[: first.end()], text[last:]


def _seeded(seed: str, cut: str, count: Callable[[str], int]) -> tuple[str, int]:
    """What of the seed goes on into the first file, and the hits in it."""
    cuts, _, head, tail = _stretches(seed, cut, count)
    open_end = tail if cuts else head
    return open_end, count(open_end)


def run_matches(docs: DataFrame, rules: RuleSet, seed: str = "") -> DataFrame:
    """``path, rule_id`` of every rule that fits in a whole run of the older
    dialect: content rules by the file's own text, metadata rules by the
    metadata of all files up to it, after ``seed``."""
    content = RuleSet([r for r in rules if r.target == K.TARGET_CONTENT], legacy=True)
    found = [matching.match_all(docs, content).select("path", "rule_id")] if len(content) else []
    for rule in rules:
        pattern = rules.pattern(rule)
        if rule.target == K.LEGACY_TARGET_METADATA and pattern.valid:
            running = _running_hits(docs, pattern, seed)
            found.append(running.where(F.col("running_hits") == rule.min_hits).select("path", F.lit(rule.rule_id).alias("rule_id")))
    if not found:
        return docs.select("path", F.lit(None).cast("int").alias("rule_id")).where(F.lit(False))
    return reduce(DataFrame.unionByName, found)


def claim_names(
    docs: DataFrame, rules: RuleSet, inventory: DataFrame | None = None, matches: DataFrame | None = None
) -> DataFrame:
    """Each name goes to one file: in path order a file takes its first
    fitting rule whose name is free. Returns the placed files, ``path,
    rule_id, name``.

    Settled by proposals in rounds. Every file proposes to the first name it may
    still have; a name keeps its earliest proposer so far, and all later files
    give it up. A name's keeper only ever becomes an earlier file, so nothing
    given up is missed, and once nobody has to give up, this is what going
    through the files in order would give. A round is two combined aggregations
    and a broadcast of one row per name; after the first one few rows are left.
    There are at most as many rounds as names.
    """
    names = rules.names()
    matches = matching.attach_rule(matching.match_all(docs, rules) if matches is None else matches, rules, "name")
    if inventory is not None:
        slots = naming.taken_slots(inventory, names).where("slot = 0").select("name").distinct()
        matches = matches.join(slots, "name", "left_anti")
    wanted = reliable(matches.select("path", "rule_id", "name"))
    while True:
        proposals = wanted.groupBy("path").agg(F.min(F.struct("rule_id", "name")).alias("_p")).select("path", "_p.*")
        # One row a name of the rule table, which is held by the driver anyway.
        keepers = F.broadcast(proposals.groupBy("name").agg(F.min("path").alias("keeper")))
        judged = wanted.join(keepers, "name", "left")
        stays = F.col("keeper").isNull() | (F.col("path") <= F.col("keeper"))
        left = reliable(judged.where(stays).select("path", "rule_id", "name"))
        if left.count() == wanted.count():
            return proposals.select("path", "rule_id", "name")
        wanted = left


def claim_manifest(
    docs: DataFrame,
    rules: RuleSet,
    directory: str,
    inventory: DataFrame | None = None,
    matches: DataFrame | None = None,
) -> DataFrame:
    """Placed files with their target in the one directory of the run. ``matches``
    (by default each file on its own) are what ``run_matches`` finds, for a run
    whose metadata goes on from file to file."""
    placed = claim_names(docs, rules, inventory, matches)
    target = X.join_path(F.lit(directory), F.concat("name", F.lit(".pdf")))
    return placed.select("path", "rule_id", target.alias("target_path"))
