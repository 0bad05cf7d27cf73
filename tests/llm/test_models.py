"""The trained models' scores against plain loops over the same numbers."""

from __future__ import annotations

import math
import random

import numpy as np

from folioroute.llm import language, quality

TEXTS = ["", "a", "Hello  wörld\n", "x" * 300, "one two two three THREE " * 30, "日本 語🙂", "\x00\x01 \t end", " lead and trail "]


def test_language_scores_equal_a_plain_forward_pass():
    """Every window, place, filter and byte one after the other."""
    rng = np.random.default_rng(3)
    n = len(language.WIDTHS) * language.FILTERS
    mask = np.broadcast_to(language._mask(), (language.WIDEST, language.DEPTH, n)).reshape(-1, n)
    net = language.Network(
        ["aa", "bb", "cc"], rng.normal(0, 0.5, (256, language.DEPTH)), rng.normal(0, 0.3, (language.WIDEST * language.DEPTH, n)) * mask,
        rng.normal(0, 0.1, n), rng.normal(0, 0.4, (n, 3)), rng.normal(0, 0.1, 3),
    )
    names, scores = language._work(net)(TEXTS)
    step = language.WINDOW - language.WIDEST + 1
    for text, name, score in zip(TEXTS, names, scores):
        if not any(map(str.isalpha, text)):
            assert (name, score) == ("und", 0.0)
            continue
        data = text.encode()
        total, amount, at = [0.0] * 3, 0, 0
        while True:
            window = data[at : at + language.WINDOW].ljust(language.WINDOW, b"\0")
            own = min(step, len(data) - at) if at + step < len(data) - language.WIDEST + 1 else max(1, len(data) - at)
            hidden = []
            for f in range(n):
                width = language.WIDTHS[f // language.FILTERS]
                best = max(
                    sum(float(net.vectors[window[p + k]] @ net.filters[k * language.DEPTH : (k + 1) * language.DEPTH, f]) for k in range(width))
                    for p in range(step)
                )
                hidden.append(max(0.0, best + net.offsets[f]))
            values = [math.exp(sum(h * net.output[i, j] for i, h in enumerate(hidden)) + net.bias[j]) for j in range(3)]
            total = [t + own * v / sum(values) for t, v in zip(total, values)]
            amount += own
            at += step
            if at >= len(data) - language.WIDEST + 1:
                break
        assert name == net.labels[int(np.argmax(total))]
        assert abs(score - max(total) / amount) < 1e-6


def features_of(text: str) -> list[int]:
    """Buckets of a text's features, one by one."""
    lowered = bytes(b + 32 if 65 <= b <= 90 else b for b in text.encode())
    edge = b"\n" * max(quality.SIZES)
    data, limit = edge + lowered + edge, 2**32
    top = 32 - quality.BITS
    out = []
    for size in quality.SIZES:
        for p in range(len(edge + lowered)):
            h = sum(int(quality._CODES[b]) * pow(0x01000193, k, limit) for k, b in enumerate(data[p : p + size])) * 2654435761 % limit
            h ^= h >> 15
            out.append(h * 2654435761 % limit >> top)
    words = []
    for word in lowered.translate(bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")).split(b" "):
        if word:
            h = sum(int(quality._CODES[b]) * pow(0x01000193, min(k, 63), limit) for k, b in enumerate(word)) * 0x85EBCA6B % limit
            words.append(h ^ h >> 13)
    out += [h * 2654435761 % limit >> top for h in words]
    out += [(h ^ after) * 2654435761 % limit >> top for h, after in zip(words, [*words[1:], 0x27D4EB2F])]
    return out


def test_quality_scores_equal_plain_sums_of_features():
    """Features one by one; a text's score is the same wherever it stands in a batch."""
    scorer = quality.Scorer(np.random.default_rng(5).normal(size=1 << quality.BITS), -0.3)
    want = []
    for text in TEXTS:
        found = features_of(text)
        mean = sum(float(scorer.weights[b]) for b in found) / max(len(found), 1)
        want.append(1 / (1 + math.exp(-(mean - 0.3))))
    for order in (range(len(TEXTS)), random.Random(1).sample(range(len(TEXTS)), len(TEXTS)), [4], [0]):
        got = scorer([TEXTS[i] for i in order])
        assert all(abs(g - want[i]) < 1e-9 for g, i in zip(got, order))
    for (buckets, shares), text in zip(quality.counted(TEXTS), TEXTS):
        found = features_of(text)
        assert buckets.tolist() == sorted(set(found))
        assert all(abs(s - found.count(b) / len(found)) < 1e-6 for b, s in zip(buckets.tolist(), shares.tolist()))
