"""Spelling variants: words one edit apart, found by dynamic programming over a sorted list.

The vocabulary is sorted and cut into ranges. A range is scanned word by word;
the rows of the banded edit matrix of all words looked up there are kept by depth,
so a word only computes the rows below the prefix it shares with the word before.
A look-up leaves at the depth where no cell of its band is below two, which skips
every word with that prefix; a range whose shared prefix exceeds one edit is not
visited at all.

One edit leaves the first half of the looked-up word whole or its second half. The
list is scanned forwards for the first kind and with reversed words for the second,
so only ranges that hold the whole half are visited, and no pair is missed.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioroute.llm.common import grouped_rows, range_sorted, small_batches, stored
from folioroute.session import local_frame

RUN = re.compile("[A-Za-zÀ-ÿ]+")
#: One run in this many loses a code point (a fixed value of the task).
DROPS = 199
LEAST_LENGTH, LEAST_COUNT, RATIO = 6, 5, 5
#: Words of a range; ranges grow with the vocabulary, so that there are at most MOST_RANGES and one a task.
RANGE, MOST_RANGES = 4096, 20_000
#: Look-ups of a range that one group holds; more are dealt out to several groups.
LOOKUPS = 32_768
#: No code point: stands around look-ups.
NONE = 2**32 - 1
#: Code points of a range's ends that its directory entry keeps.
ENDS = 64
#: Words and code points that a task's counter holds before its counts go to the shuffle.
HELD_WORDS, HELD_POINTS = 200_000, 4_000_000


def words_of(doc_id: object, text: str | None) -> Counter:
    """Counts of a document's words as the task takes them: lower-cased in A-Z, one run in DROPS a code point shorter.

    A null text has none; a null id is written as nothing before the colon.
    """
    found: Counter = Counter()
    if not text:
        return found
    seed = crc32(b"%s:" % ("" if doc_id is None else str(doc_id)).encode())
    lowered = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
    for run, n in Counter(RUN.findall(lowered)).items():
        h = crc32(run.encode(), seed)
        if h % DROPS == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
        found[run] += n
    return found


def count_words(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LEAST_LENGTH, least: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of all words of at least ``length`` code points and ``least`` occurrences.

    Tasks add up their own documents first, in a counter of bounded size, so a
    word that stands everywhere reaches the shuffle a few times a task.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        points = 0

        def flushed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                for word, n in words_of(doc_id, text.as_py()).items():
                    if len(word) >= length:
                        if word not in held:
                            points += len(word)
                        held[word] += n
                if len(held) >= HELD_WORDS or points >= HELD_POINTS:
                    yield flushed()
                    held, points = Counter(), 0
        if held:
            yield flushed()

    parts = docs.select(key, text).mapInArrow(run, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def _deeper(band: np.ndarray, depth: int, char: int, flat: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The next row of the banded matrix: cells of depth, depth + 1 and depth + 2 characters of the look-ups.

    ``flat`` holds the look-ups' characters one after another, NONE three times behind each.
    """
    low, middle, high = band
    at = start + depth
    first = np.minimum(middle + 1, low + (flat[at - 1] != char))
    second = np.minimum(np.minimum(high + 1, middle + (flat[at] != char)), first + 1)
    third = np.minimum(high + (flat[at + 1] != char), second + 1)
    return np.minimum(np.stack([first, second, third]), 2).astype(np.uint8)


def scan_range(words: list[str], lookups: list[str], whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (look-up, word) exactly one edit apart whose first ``whole[look-up]`` characters are equal.

    ``words`` ascend. Rows of the matrices are kept by depth; a new word goes
    back to the depth of the prefix it shares with the one before.
    """
    length = np.fromiter(map(len, lookups), np.int64, len(lookups))
    start = np.concatenate([[0], np.cumsum(length + 3)[:-1]]) + 1 if len(lookups) else np.zeros(0, np.int64)
    flat = np.frombuffer(("\0" + "".join(f"{x}\0\0\0" for x in lookups)).encode("utf-32-le"), np.uint32).copy()
    flat[np.concatenate([[0], *(start + length + i for i in range(3))])] = NONE
    everyone = np.arange(len(lookups))
    # Row of depth 0: no character of a look-up costs nothing, one costs one.
    first = np.repeat(np.array([[2], [0], [1]], np.uint8), len(lookups), 1)
    rows: list[tuple[np.ndarray, np.ndarray]] = [(everyone, first)]
    hits_a: list[np.ndarray] = []
    hits_b: list[np.ndarray] = []
    before, dead = "", 0
    for number, word in enumerate(words):
        shared = 0
        most = min(len(before), len(word))
        while shared < most and before[shared] == word[shared]:
            shared += 1
        before = word
        if dead and shared >= dead:
            continue
        dead = 0
        depth = min(shared, len(rows) - 1)
        del rows[depth + 1 :]
        alive, band = rows[depth]
        for depth in range(depth, len(word)):
            band = _deeper(band, depth, ord(word[depth]), flat, start[alive])
            now = depth + 1
            stays = (band.min(0) <= 1) & (length[alive] >= depth) & ((whole[alive] < now) | (band[1] == 0))
            if not stays.all():
                alive, band = alive[stays], band[:, stays]
            rows.append((alive, band))
            if not len(alive):
                dead = now
                break
            if len(alive) == 1 and lookups[alive[0]] == word:
                break  # only the word itself has this prefix or one near it
        else:
            offset = length[alive] - len(word) + 1
            near = (offset >= 0) & (offset <= 2)
            at = np.flatnonzero(near)
            hit = alive[at[band[offset[at], at] == 1]]
            if len(hit):
                hits_a.append(hit)
                hits_b.append(np.full(len(hit), number))
    if not hits_a:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(hits_a), np.concatenate(hits_b)


def within_one(prefix: str, key: str) -> bool:
    """Whether some word that begins with ``prefix`` can be one edit from ``key``, by the banded matrix."""
    band = [2, 0, 1]
    for depth, char in enumerate(prefix):
        own = [key[i] if 0 <= i < len(key) else "" for i in (depth - 1, depth, depth + 1)]
        first = min(band[1] + 1, band[0] + (own[0] != char))
        second = min(band[2] + 1, band[1] + (own[1] != char), first + 1)
        third = min(band[2] + (own[2] != char), second + 1)
        band = [min(first, 2), min(second, 2), min(third, 2)]
        if min(band) > 1 or depth > len(key):
            return False
    return True


class Directory:
    """First and last word of every range, cut to ENDS code points, in order."""

    def __init__(self, low: list[str], high: list[str]):
        self.low, self.high = [x[:ENDS] for x in low], [x[:ENDS] + "\U0010ffff" for x in high]
        self.shared = []
        for a, b in zip(self.low, self.high):
            n = 0
            while n < min(len(a), len(b)) and a[n] == b[n]:
                n += 1
            self.shared.append(a[:n])

    def targets(self, key: str, whole: int) -> list[int]:
        """Ranges that may hold a word one edit from ``key`` with its first ``whole`` characters."""
        prefix = key[: min(whole, ENDS)]
        first, last = bisect_left(self.high, prefix), bisect_right(self.low, prefix + "\U0010ffff")
        if last - first <= 1:
            return list(range(first, last))
        return [i for i in range(first, last) if within_one(self.shared[i], key)]


def _near(listed: DataFrame, size: int, backwards: bool) -> DataFrame:
    """(word, n_near, form, form_n) of the near words that the scan in one direction finds; one row a look-up and range.

    ``listed`` holds the words in the order of ``key`` with their place ``part``, ``row``.
    """
    spark = listed.sparkSession
    placed = listed.withColumn("range", F.floor(F.col("row") / F.lit(size)))
    ends = placed.groupBy("part", "range").agg(F.min(F.left("key", F.lit(ENDS))).alias("low"), F.max(F.left("key", F.lit(ENDS))).alias("high")).orderBy("part", "range").collect()
    book = Directory([r.low for r in ends], [r.high for r in ends])
    number = local_frame(spark, [(r.part, r.range, i) for i, r in enumerate(ends)], "part int, range bigint, tile int")

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_pylist()
            tile: list[int] = []
            row: list[int] = []
            for i, key in enumerate(keys):
                found = book.targets(key, (len(key) + 1) // 2 if backwards else len(key) // 2)
                tile += found
                row += [i] * len(found)
            yield pa.RecordBatch.from_arrays([pa.array(tile, pa.int32()), batch.column(0).take(pa.array(row, pa.int64()))], ["tile", "key"])

    sent = stored(placed.select("key").mapInArrow(send, "tile int, key string"), "look-ups")
    # At most MOST_RANGES rows and one a task.
    loads = F.broadcast(sent.groupBy("tile").agg(F.ceil(F.count("*") / F.lit(LOOKUPS)).cast("int").alias("slices")))
    words = (
        placed.join(F.broadcast(number), ["part", "range"]).join(loads, "tile")
        .select("tile", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), F.lit(0).alias("kind"), "key", "n")
    )
    asked = sent.join(loads, "tile").select("tile", F.pmod(F.xxhash64("key"), "slices").cast("int").alias("slice"), F.lit(1).alias("kind"), "key", F.lit(0).cast("long").alias("n"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in grouped_rows(batches, 2):
            kind = np.array(group.column("kind"))
            keys, counts = np.array(group.column("key").to_pylist(), object), np.array(group.column("n"))
            words, asked, counts = list(keys[kind == 0]), list(keys[kind == 1]), counts[kind == 0]
            whole = np.array([(len(x) + 1) // 2 if backwards else len(x) // 2 for x in asked], np.int64)
            a, b = scan_range(words, asked, whole)
            if backwards:
                asked, words = [x[::-1] for x in asked], [x[::-1] for x in words]
                # The scan forwards has found those whose first half is whole as well.
                new = np.array([not words[j].startswith(asked[i][: len(asked[i]) // 2]) for i, j in zip(a.tolist(), b.tolist())], bool)
                a, b = a[new], b[new]
            if not len(a):
                continue
            order = sorted(range(len(a)), key=lambda k: (a[k], -counts[b[k]], words[b[k]]))
            a, b = a[order], b[order]
            first = np.flatnonzero(np.append(True, a[1:] != a[:-1]))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([asked[i] for i in a[first]], pa.string()), pa.array(np.diff(np.append(first, len(a))), pa.int64()),
                    pa.array([words[j] for j in b[first]], pa.string()), pa.array(counts[b[first]], pa.int64()),
                ], ["word", "n_near", "form", "form_n"],
            )

    by = ["tile", "slice"]
    return words.union(asked).repartition(*by).sortWithinPartitions(*by, "kind", "key").mapInArrow(scan, "word string, n_near long, form string, form_n long")


def follow(forms: DataFrame) -> DataFrame:
    """(word, root) from (word, form): each round doubles the steps, so there are as many as the longest chain has bits.

    A form is more frequent than its word, so there are no circles.
    """
    found = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        beyond = found.select(F.col("word").alias("root"), F.col("root").alias("further"))
        made = stored(found.join(beyond, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        found = made.select("word", "root")
        if made.where("moved").isEmpty():
            return found


def group_spellings(vocabulary: DataFrame, ratio: int = RATIO, size: int | None = None) -> DataFrame:
    """Near words of a vocabulary (word, n): word, form, root, n, n_near, form_n.

    Words are distinct and not null; two are near if one inserted, deleted or replaced
    code point makes one of the other. The form is the most frequent near word (ties:
    the smallest in code-point order) if it is at least ``ratio`` times as frequent,
    else null. An empty vocabulary gives no rows.
    """
    known = stored(vocabulary.select("word", F.col("n").cast("long").alias("n")), "vocabulary")
    size = size or max(RANGE, -(-known.count() // MOST_RANGES))
    found = None
    for backwards in (False, True):
        key = F.reverse("word") if backwards else F.col("word")
        near = _near(range_sorted(known.select(key.alias("key"), "n"), ["key"], "sorted-words"), size, backwards)
        found = near if found is None else found.union(near)
    # The largest count wins; of equal ones the smallest word, as the negated count ascends with it.
    best = stored(
        found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("form_n")).alias("less"), F.col("form").alias("form"))).alias("best")),
        "near-words",
    )
    joined = known.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.col("best.form").alias("best"), (-F.col("best.less")).alias("best_n"))
    clear = F.col("best_n") >= ratio * F.col("n")
    formed = stored(joined.select("word", "n", "n_near", F.when(clear, F.col("best")).alias("form"), F.when(clear, F.col("best_n")).alias("form_n")), "forms")
    roots = follow(formed.where("form IS NOT NULL"))
    return formed.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Words of at least LEAST_LENGTH code points and LEAST_COUNT occurrences, grouped by spelling.

    Whole texts count; null and empty texts have no words, repeated rows count each time,
    a null id counts as an empty one. Only key and text are read.
    """
    return group_spellings(count_words(docs, key, text))
