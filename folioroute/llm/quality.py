"""Quality scores by supervised subword embeddings.

Words, pairs of words and sequences of 3 to 5 bytes are hashed to buckets with a learned vector
each; a document is the mean of its vectors, and a softmax layer gives the
probability of label 1. Trained in numpy by stochastic gradient descent. As the
layer is linear, a trained bucket counts as one number when texts are scored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioroute.llm.common import map_texts, slices
from folioroute.llm.language import held_out

BITS, DEPTH, SIZES = 15, 10, (3, 4, 5)
#: The bound of the training sample: labelled documents of each label.
PER_LABEL = 1500
THRESHOLD = 0.3

_EDGE = b"\n" * max(SIZES)
_MIX = np.uint32(2654435761)
_POWER = np.array([pow(0x01000193, k, 2**32) for k in range(64)], np.uint32)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def _codes() -> np.ndarray:
    return np.random.default_rng(11).integers(1, 2**32, 256, dtype=np.uint32)


_CODES = _codes()


def _buckets(texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Per kind of feature: buckets in text order, and where each text's begin."""
    data = b"".join(_EDGE + t.encode() for t in texts) + _EDGE
    lengths = np.fromiter((len(_EDGE) + len(t.encode()) for t in texts), np.int64, len(texts))
    starts = np.concatenate([[0], np.cumsum(lengths)])[: len(texts)]
    low = _LOWER[np.frombuffer(data, np.uint8)]
    code = _CODES[low]
    out, begin = [], []
    shift = np.uint32(32 - BITS)
    running = code.copy()
    for size in range(2, max(SIZES) + 1):
        running = running[:-1] + code[size - 1 :] * _POWER[size - 1]
        if size in SIZES:
            mixed = running * _MIX
            mixed ^= mixed >> np.uint32(15)
            # Those that begin in the last edge belong to no text.
            out.append(((mixed * _MIX) >> shift)[: len(low) - len(_EDGE)])
            begin.append(starts)
    space = _SPACE[low]
    inside = ~space
    first = np.flatnonzero(inside[1:] & space[:-1]) + 1
    if len(first):
        place = np.arange(len(low)) - first[np.maximum(np.searchsorted(first, np.arange(len(low)), side="right") - 1, 0)]
        weighed = np.where(inside, code * _POWER[np.clip(place, 0, 63)], np.uint32(0))
        words = np.add.reduceat(weighed, first, dtype=np.uint32) * np.uint32(0x85EBCA6B)
        words ^= words >> np.uint32(13)
        out.append((words * _MIX) >> shift)
        begin.append(np.searchsorted(first, starts))
        # Pairs of words, the order left out: a word repeated is the same pair whatever the word.
        following = np.append(words[1:], 0).astype(np.uint32)
        last = begin[-1][1:] - 1
        following[last[last >= 0]] = np.uint32(0x27D4EB2F)
        following[-1] = np.uint32(0x27D4EB2F)
        out.append(((words ^ following) * _MIX) >> shift)
        begin.append(begin[-1])
    return out, begin


def _sums(values: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum and number of the values of each text."""
    through = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    edge = np.append(begin, len(values))
    return np.diff(through[edge]), np.diff(edge)


class Scorer:
    """One number per bucket and a bias."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights.astype(np.float32), float(bias)

    def __call__(self, texts: list) -> np.ndarray:
        kinds, begins = _buckets([t or "" for t in texts])
        total, count = np.zeros(len(texts)), np.zeros(len(texts))
        for buckets, begin in zip(kinds, begins):
            sums, numbers = _sums(self.weights[buckets], begin)
            total += sums
            count += numbers
        return 1 / (1 + np.exp(-np.clip(total / np.maximum(count, 1) + self.bias, -30, 30)))


def counted(texts: list) -> list[tuple[np.ndarray, np.ndarray]]:
    """Distinct buckets of each text and their shares of its features."""
    kinds, begins = _buckets([t or "" for t in texts])
    edges = [np.append(b, len(k)) for k, b in zip(kinds, begins)]
    out = []
    for row in range(len(texts)):
        own = np.concatenate([k[e[row] : e[row + 1]] for k, e in zip(kinds, edges)])
        buckets, number = np.unique(own, return_counts=True)
        out.append((buckets.astype(np.int32), (number / max(len(own), 1)).astype(np.float32)))
    return out


def train(
    rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, prior: float, epochs: int = 12, batch: int = 16, rate: float = 25.0
) -> Scorer:
    """Stochastic gradient descent on shares of buckets; ``prior`` is added to the log odds."""
    size = 1 << BITS
    if not len(rows) or labels.min() == labels.max():
        share = (labels.sum() + 1) / (len(labels) + 2)
        return Scorer(np.zeros(size), np.log(share / (1 - share)))
    random = np.random.default_rng(5)
    vectors = random.normal(0, 0.05, (size, DEPTH)).astype(np.float32)
    output = random.normal(0, 1 / np.sqrt(DEPTH), (DEPTH, 2)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    steps = epochs * -(-len(rows) // batch)
    done = 0
    for _ in range(epochs):
        order = random.permutation(len(rows))
        for start in range(0, len(order), batch):
            part = order[start : start + batch]
            x = np.zeros((len(part), size), np.float32)
            for at, row in enumerate(part):
                x[at, rows[row][0]] = rows[row][1]
            hidden = x @ vectors
            score = hidden @ output + bias
            score -= score.max(1, keepdims=True)
            error = np.exp(score)
            error /= error.sum(1, keepdims=True)
            error[np.arange(len(part)), labels[part]] -= 1
            error /= len(part)
            now = rate * (1 - done / steps)
            to_output = hidden.T @ error
            vectors -= now * (x.T @ (error @ output.T))
            output -= 0.02 * now * to_output
            bias -= 0.02 * now * error.sum(0)
            done += 1
    return Scorer(vectors @ (output[:, 1] - output[:, 0]), bias[1] - bias[0] + prior)


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality") -> Scorer:
    """A scorer from labelled documents that are not held out.

    At most PER_LABEL documents of each label, by hash of the id, are read; they
    weigh alike in training, and the log odds of all labels are added back.
    """
    usable = labels.select(F.col(key).alias("key"), F.col(label).cast("int").alias("label")).where(
        ~held_out("key") & F.col("key").isNotNull() & F.col("label").isin(0, 1)
    )
    totals = {r["label"]: r["count"] for r in usable.groupBy("label").count().collect()}
    drawn = None
    for value in sorted(totals):
        part = usable.where(F.col("label") == value).orderBy(F.xxhash64("key"), "key").limit(PER_LABEL)
        drawn = part if drawn is None else drawn.union(part)
    if drawn is None:
        return train([], np.zeros(0, int), 0.0)
    schema = "key string, label int, buckets array<int>, shares array<float>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                made = counted(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).cast(pa.string()), part.column(2).cast(pa.int32()),
                     pa.array([m[0] for m in made], pa.list_(pa.int32())), pa.array([m[1] for m in made], pa.list_(pa.float32()))],
                    names=["key", "label", "buckets", "shares"],
                )

    sample = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).join(F.broadcast(drawn.distinct()), "key")
    table = sample.select(F.col("key").cast("string").alias("key"), "text", "label").mapInArrow(run, schema).toArrow()
    found = sorted(
        zip(table["key"].to_pylist(), table["label"].to_pylist(), range(table.num_rows))
    )
    rows = [(table["buckets"][at].values.to_numpy(), table["shares"][at].values.to_numpy()) for _, _, at in found]
    target = np.array([v for _, v, _ in found], int)
    drawn_odds = (target.sum() + 1) / (len(target) - target.sum() + 1)
    odds = (totals.get(1, 0) + 1) / (totals.get(0, 0) + 1)
    return train(rows, target, float(np.log(odds / drawn_odds)))


def score(docs: DataFrame, scorer: Scorer, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Quality of every whole text: key, held_out, score, predicted.

    One row per input row. Null and empty texts get the score of a text of line
    edges alone; without labels the score is one half everywhere.
    """
    made: Callable[[], Callable[[list], list]] = lambda: lambda texts: [scorer(texts).tolist()]
    scored = map_texts(docs, made, "score double", key, text)
    return scored.select(
        key, held_out(key).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
