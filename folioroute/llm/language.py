"""Language identification by a byte convolutional network.

A text's UTF-8 bytes are cut into fixed-length windows that overlap by the widest
filter, so every byte sequence is seen. Byte vectors pass filters of several
widths, the maximum of each over the window passes a softmax layer, and a text's
probabilities are the length-weighted mean of its windows'. The network is
trained in numpy on windows of labelled documents.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioroute.llm.common import map_texts, parts_of, small_batches

WINDOW, DEPTH, WIDTHS, FILTERS = 256, 8, (2, 3, 4, 5), 12
WIDEST = max(WIDTHS)
#: The bound of the training sample: documents of each language, windows of each.
PER_LANGUAGE, PER_DOCUMENT = 1200, 2
UNKNOWN = "und"


def held_out(key: str = "doc_id") -> F.Column:
    """Documents kept out of training: a fifth of them, by checksum of the id."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _mask() -> np.ndarray:
    """Which offsets each filter sees: a filter of width 2 ignores the last three."""
    mask = np.zeros((WIDEST, 1, len(WIDTHS) * FILTERS), np.float32)
    for at, width in enumerate(WIDTHS):
        mask[:width, :, at * FILTERS : (at + 1) * FILTERS] = 1
    return mask


@dataclass
class Network:
    labels: list[str]
    vectors: np.ndarray  # 256 x DEPTH
    filters: np.ndarray  # WIDEST * DEPTH x filters
    offsets: np.ndarray
    output: np.ndarray  # filters x labels
    bias: np.ndarray

    def patches(self, windows: np.ndarray) -> np.ndarray:
        """Vectors of WIDEST bytes from every place of every window."""
        x = self.vectors[windows].reshape(len(windows), -1)
        view = np.lib.stride_tricks.as_strided(
            x,
            (len(windows), windows.shape[1] - WIDEST + 1, WIDEST * DEPTH),
            (x.strides[0], DEPTH * x.itemsize, x.itemsize),
        )
        return np.ascontiguousarray(view).reshape(-1, WIDEST * DEPTH)

    def pooled(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        patches = self.patches(windows)
        grid = (patches @ self.filters).reshape(len(windows), -1, self.filters.shape[1])
        return patches, grid, np.maximum(grid.max(1) + self.offsets, 0)

    def probabilities(self, windows: np.ndarray, step: int = 128) -> np.ndarray:
        out = [softmax(self.pooled(windows[a : a + step])[2] @ self.output + self.bias) for a in range(0, len(windows), step)]
        return np.concatenate(out) if out else np.zeros((0, len(self.labels)), np.float32)


def softmax(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def windows_of(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Windows over all bytes of a text, and how many bytes each adds."""
    step = WINDOW - WIDEST + 1
    count = max(1, -(-(len(data) - WIDEST + 1) // step))
    padded = np.zeros(count * step + WIDEST - 1, np.uint8)
    padded[: len(data)] = np.frombuffer(data, np.uint8)
    view = np.lib.stride_tricks.as_strided(padded, (count, WINDOW), (step, 1))
    weight = np.full(count, step, np.float64)
    weight[-1] = max(1, len(data) - (count - 1) * step)
    return view, weight


def train(windows: np.ndarray, labels: list[str], epochs: int = 6, batch: int = 64, rate: float = 0.003) -> Network | None:
    """Train on labelled windows with Adam; classes weigh alike. None without windows."""
    names = sorted(set(labels))
    if not names:
        return None
    random = np.random.default_rng(7)
    wanted = np.array([names.index(label) for label in labels])
    weight = (len(wanted) / (len(names) * np.bincount(wanted, minlength=len(names))))[wanted].astype(np.float32)
    n_filters = len(WIDTHS) * FILTERS
    mask = np.broadcast_to(_mask(), (WIDEST, DEPTH, n_filters)).reshape(-1, n_filters)
    net = Network(
        names,
        random.normal(0, 0.5, (256, DEPTH)).astype(np.float32),
        random.normal(0, 0.3, (WIDEST * DEPTH, n_filters)).astype(np.float32) * mask,
        np.zeros(n_filters, np.float32),
        random.normal(0, 0.1, (n_filters, len(names))).astype(np.float32),
        np.zeros(len(names), np.float32),
    )
    parts = [net.vectors, net.filters, net.offsets, net.output, net.bias]
    first, second = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts]
    step = 0
    for _ in range(epochs):
        order = random.permutation(len(windows))
        for start in range(0, len(order), batch):
            rows = order[start : start + batch]
            part = windows[rows]
            patches, grid, hidden = net.pooled(part)
            error = softmax(hidden @ net.output + net.bias)
            error[np.arange(len(rows)), wanted[rows]] -= 1
            error *= weight[rows, None] / len(rows)
            back = (error @ net.output.T) * (hidden > 0)
            # only the place of each maximum gets a gradient
            spot = grid.argmax(1)
            at = np.arange(len(rows))[:, None] * grid.shape[1] + spot
            taken = patches[at]  # rows x filters x patch
            to_filters = np.einsum("rf,rfp->pf", back, taken) * mask
            to_patch = (back[:, :, None] * net.filters.T[None]).reshape(-1, WIDEST, DEPTH)
            seen = part[np.arange(len(rows))[:, None, None], spot[:, :, None] + np.arange(WIDEST)].reshape(-1)
            flat = to_patch.reshape(-1, DEPTH)
            to_vectors = np.stack([np.bincount(seen, weights=flat[:, d], minlength=256) for d in range(DEPTH)], 1)
            step += 1
            gradients = [to_vectors, to_filters, back.sum(0), hidden.T @ error, error.sum(0)]
            for p, g, m, v in zip(parts, gradients, first, second):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return net


def training_windows(docs: DataFrame, key: str, text: str, lang: str) -> DataFrame:
    """Windows of at most PER_LANGUAGE labelled documents of each language.

    A first pass counts documents by language; the hash threshold it gives keeps
    the sorted sample small before any text is read, and tied hashes are cut by id.
    """
    usable = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(lang).alias("lang")).where(
        ~held_out("key") & F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.octet_length("text") > 0)
    )
    counts = {r["lang"]: r["count"] for r in usable.groupBy("lang").count().collect()}
    if not counts:
        return usable.select("lang", F.lit(b"").alias("bytes")).limit(0)
    share = F.create_map(*[F.lit(v) for k, n in counts.items() for v in (k, min(1.0, 1.5 * PER_LANGUAGE / n + 200 / n))])
    draw = F.pmod(F.xxhash64("key"), F.lit(1_000_000)) / F.lit(1_000_000.0)
    drawn = usable.withColumn("draw", draw).where(F.col("draw") < share[F.col("lang")])
    order = Window.partitionBy("lang").orderBy("draw", "key", F.xxhash64("text"))
    kept = drawn.withColumn("place", F.row_number().over(order)).where(F.col("place") <= PER_LANGUAGE)
    spots = F.transform(
        F.sequence(F.lit(0), F.lit(PER_DOCUMENT - 1)),
        lambda i: F.pmod(F.xxhash64("key", i), F.greatest(F.octet_length("text") - WINDOW + 1, F.lit(1))).cast("int") + 1,
    )
    return kept.select(
        "lang", F.explode(spots).alias("spot"), F.col("text").cast("binary").alias("text")
    ).select("lang", F.substring("text", F.col("spot"), F.lit(WINDOW)).alias("bytes"))


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> Network | None:
    """A network from the labelled documents that are not held out."""
    rows = sorted((r["lang"], bytes(r["bytes"])) for r in training_windows(docs, key, text, lang).collect())
    windows = np.zeros((len(rows), WINDOW), np.uint8)
    for at, (_, data) in enumerate(rows):
        windows[at, : len(data)] = np.frombuffer(data, np.uint8)
    return train(windows, [name for name, _ in rows])


def _work(net: Network | None) -> Callable[[list], list]:
    def run(texts: list) -> list:
        held, weights, owner = [], [], []
        for row, text in enumerate(texts):
            if net is not None and text and any(map(str.isalpha, text)):
                view, weight = windows_of(text.encode())
                held.append(view)
                weights.append(weight)
                owner.append(np.full(len(view), row))
        names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        if held:
            guess = net.probabilities(np.concatenate(held)).astype(np.float64)
            weight, row_of = np.concatenate(weights), np.concatenate(owner)
            total = np.zeros((len(texts), guess.shape[1]))
            np.add.at(total, row_of, guess * weight[:, None])
            amount = np.bincount(row_of, weights=weight, minlength=len(texts))
            for row in np.flatnonzero(amount):
                best = int(total[row].argmax())
                names[row] = net.labels[best]
                scores[row] = float(min(1.0, max(0.0, total[row, best] / amount[row])))
        return [names, scores]

    return run


def identify(docs: DataFrame, net: Network | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Language and score of every whole text: key, held_out, lang_pred, score.

    One row per input row. Null texts, texts without letters, and all texts when
    nothing was learned are ``und`` with score 0; a null id is not held out.
    """
    guessed = map_texts(docs, lambda: _work(net), "lang_pred string, score double", key, text)
    return guessed.select(key, held_out(key).alias("held_out"), "lang_pred", "score")


def keep(docs: DataFrame, net: Network | None, least: float, text: str = "text") -> DataFrame:
    """Rows and columns of ``docs`` whose text has a learned language of at least ``least``.

    Without a network nothing is known about languages, and all rows stay.
    """
    if net is None:
        return docs
    small_batches(docs.sparkSession)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = _work(net)
        for part in parts_of(batches, at):
            names, scores = work(part.column(at).to_pylist())
            good = [n != UNKNOWN and s >= least for n, s in zip(names, scores)]
            yield part.filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
