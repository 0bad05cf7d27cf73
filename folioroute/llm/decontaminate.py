"""Benchmark decontamination with a positional inverted index, on built-in functions only.

The words of all documents are counted against the benchmark's words. Every
window of a benchmark item is then represented by its rarest words; postings
(word, document, position) are stored for these words alone. Shifting a posting
by its word's place in the item gives where the item would begin; places that
agree on a beginning are intersected, and windows whose rare words all agree are
phrase candidates. The words of these documents are then compared exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioroute.llm.common import stored

WINDOW, RAREST = 10, 2
#: A table of words is broadcast up to this many rows, counted before; beyond, the join is shuffled.
BROADCAST_WORDS = 200_000

# What separates words, and the letters that are lowered.
SEPARATOR = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_as_written(text: Column) -> Column:
    """Words of a text in order, letters as they are; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SEPARATOR), "")


def item_words(items: DataFrame, key: str, text: str) -> DataFrame:
    """Distinct items with words: no (a number of its own), item, words in lower case."""
    words = words_as_written(F.translate(F.col(text), UPPER, LOWER))
    return (
        items.select(F.col(key).cast("string").alias("item"), words.alias("words"))
        .where(F.size("words") > 0)
        .distinct()
        .withColumn("no", F.xxhash64("item", "words"))
    )


def _sized(frame: DataFrame) -> DataFrame:
    return F.broadcast(frame) if frame.count() <= BROADCAST_WORDS else frame


def anchors_of(items: DataFrame, docs: DataFrame, text: str, rarest: int = RAREST) -> DataFrame:
    """The rarest words of every window: no, first (start of the window), place, word.

    Rarity is the number of occurrences in all documents.
    """
    starts = F.sequence(F.lit(0), F.greatest(F.size("words") - WINDOW, F.lit(0)))
    each = (
        items.select("no", "words", F.explode(starts).alias("first"))
        .select("no", "first", F.posexplode(F.slice("words", F.col("first") + 1, F.lit(WINDOW))).alias("at", "exact"))
        .select("no", "first", (F.col("first") + F.col("at")).alias("place"), F.lower("exact").alias("word"))
    )
    vocabulary = stored(each.select("word").distinct(), "benchmark-words")
    counts = (
        docs.select(F.explode(words_as_written(F.col(text))).alias("w"))
        .select(F.lower("w").alias("word"))
        .join(_sized(vocabulary), "word", "left_semi")
        .groupBy("word").count()
    )
    order = Window.partitionBy("no", "first").orderBy(F.coalesce("count", F.lit(0)), "place")
    ranked = each.join(counts, "word", "left").withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= rarest).select("no", "first", "place", "word")


def postings(docs: DataFrame, words: DataFrame, key: str, text: str) -> DataFrame:
    """The positional index of the given words: word, document, position.

    ``digest`` tells texts of one id apart. Nothing is shuffled as long as the
    words fit a broadcast.
    """
    return (
        docs.select(F.col(key).alias("key"), F.xxhash64(text).alias("digest"), words_as_written(F.col(text)).alias("all"))
        .select("key", "digest", F.posexplode("all").alias("position", "written"))
        .select("key", "digest", "position", F.lower("written").alias("word"))
        .join(_sized(words), "word")
    )


def phrase_candidates(index: DataFrame, anchors: DataFrame, items: DataFrame) -> DataFrame:
    """Windows whose rare words all stand at their places: document, start, words, item.

    Lists are intersected per document, item and beginning; a list holds places
    of one item, so its length is bounded by the item's.
    """
    terms = anchors.select("word", "no", "place").distinct()
    windows = (
        anchors.groupBy("no", "first").agg(F.collect_list("place").alias("places"))
        .groupBy("no").agg(F.collect_list(F.struct("first", "places")).alias("windows"), F.min(F.size("places")).alias("least"))
        .join(items, "no")
    )
    agreed = (
        index.join(_sized(terms), "word")
        .select("key", "digest", "no", (F.col("position") - F.col("place")).alias("begin"), "place")
        .groupBy("key", "digest", "no", "begin").agg(F.collect_set("place").alias("seen"))
        .join(_sized(windows), "no")
        .where(F.size("seen") >= F.col("least"))
    )
    whole = F.filter("windows", lambda w: F.forall(w["places"], lambda p: F.array_contains("seen", p)))
    return (
        agreed.select("key", "digest", "begin", "item", "words", F.explode(whole).alias("w"))
        .select("key", "digest", "item", (F.col("begin") + F.col("w.first")).alias("start"), F.slice("words", F.col("w.first") + 1, F.lit(WINDOW)).alias("words"))
        .where("start >= 0")
    )


def phrase_matches(candidates: DataFrame, docs: DataFrame, key: str, text: str) -> DataFrame:
    """Exact occurrences of windows: document, start, end, item."""
    ids = _sized(candidates.select(F.col("key").alias("id")).distinct())
    some = docs.select(F.col(key).alias("id"), F.xxhash64(text).alias("is"), F.col(text).alias("text"))
    some = some.join(ids, some["id"].eqNullSafe(ids["id"]), "left_semi")
    some = some.select("id", "is", words_as_written(F.col("text")).alias("all")).dropDuplicates(["id", "is"])
    both = candidates.join(some, F.col("key").eqNullSafe(F.col("id")) & (F.col("digest") == F.col("is")))
    stands = F.transform(F.slice("all", F.col("start") + 1, F.size("words")), lambda w: F.translate(w, UPPER, LOWER))
    return both.where(stands == F.col("words")).select(
        "key", "digest", "start", (F.col("start") + F.size("words")).alias("end"), "item"
    )


def proximity_matches(index: DataFrame, anchors: DataFrame, slack: int) -> DataFrame:
    """Windows whose rare words stand near their places: the beginnings they give differ by at most ``slack``."""
    need = anchors.groupBy("no", "first").agg(F.count("*").alias("need"))
    order = Window.partitionBy("key", "digest", "no", "first").orderBy("start").rangeBetween(0, slack)
    return (
        index.join(_sized(anchors), "word")
        .withColumn("start", F.col("position") - F.col("place") + F.col("first"))
        .withColumn("seen", F.size(F.collect_set("place").over(order)))
        .join(_sized(need), ["no", "first"])
        .where("seen = need")
        .select("key", "digest", "no", "first", "start")
        .distinct()
    )


def decontaminate(
    docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """Hits of benchmark windows in every whole document.

    One row per input row: key, digest of the text, n_words, n_hit (words inside
    any occurring window), n_items, items (ids as strings, sorted), contaminated. Null and
    empty texts have no words; items without words have no windows; items that
    share an id count once.
    """
    known = stored(item_words(items, item, item_text), "items")
    anchors = stored(anchors_of(known, docs, text), "anchors")
    index = stored(postings(docs, anchors.select("word").distinct(), key, text), "postings")
    candidates = stored(phrase_candidates(index, anchors, known), "phrase-candidates")
    found = stored(phrase_matches(candidates, docs, key, text), "phrases")
    earlier = Window.partitionBy("key", "digest").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    reached = F.coalesce(F.max("end").over(earlier), F.lit(0))
    hits = (
        found.select("key", "digest", "start", "end").distinct()
        .withColumn("new", F.greatest(F.col("end") - F.greatest("start", reached), F.lit(0)))
        .groupBy("key", "digest").agg(F.sum("new").alias("n_hit"))
    )
    named = (
        found.groupBy("key", "digest").agg(F.array_sort(F.collect_set("item")).alias("items"))
    )
    hit = hits.join(named.withColumnsRenamed({"key": "k", "digest": "d"}), F.col("key").eqNullSafe(F.col("k")) & (F.col("digest") == F.col("d")))
    hit = hit.select(F.col("key").alias("hit_key"), F.col("digest").alias("hit_digest"), "n_hit", "items")
    slim = docs.select(F.col(key), F.xxhash64(text).alias("digest"), F.size(words_as_written(F.col(text))).cast("long").alias("n_words"))
    joined = slim.join(hit, slim[key].eqNullSafe(hit["hit_key"]) & (slim["digest"] == hit["hit_digest"]), "left")
    return joined.select(
        key,
        "digest",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.size(F.coalesce("items", F.array().cast("array<string>"))).cast("long").alias("n_items"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"),
    )


def digests(found: DataFrame, key: str = "doc_id") -> DataFrame:
    return found.select(
        key, "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated"
    )
