"""Token counts: batches encoded in Arrow functions that return lengths only.

Texts are cut at white space, where this kind of tokenizer never joins; the runs
between are encoded once per batch of about equal bytes and their counts kept in
a bounded cache, so repeated words cost one look-up.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioroute.llm.common import map_texts

VOCABULARY = "word_bpe_49k.json"
#: Runs in each of the two generations a task remembers, and bytes of runs handed to the library at once.
CACHE, BATCH_BYTES = 200_000, 1_000_000


def balanced(runs: list[str], size: int = BATCH_BYTES) -> list[list[str]]:
    """Split runs into batches of about ``size`` bytes, longest runs first."""
    out: list[list[str]] = []
    held = 0
    for run in sorted(runs, key=len, reverse=True):
        if not out or held + len(run) > size:
            out.append([])
            held = 0
        out[-1].append(run)
        held += len(run) + 16
    return out


def _work(path: str) -> Callable[[list], list]:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    known: dict[str, int] = {}
    earlier: dict[str, int] = {}

    def run(texts: list) -> list:
        nonlocal known, earlier
        # Blanks and line feeds only: both are white space to every library.
        split = [(t or "").replace("\n", " ").split(" ") for t in texts]
        new = set().union(*split).difference(known) if split else set()
        if len(known) + len(new) > CACHE:
            earlier, known = known, {}
            new = set().union(*split)
            known.update((word, earlier[word]) for word in new.intersection(earlier))
            new.difference_update(known)
        for batch in balanced(list(new)):
            for word, made in zip(batch, tokenizer.encode_batch_fast(batch, add_special_tokens=False)):
                known[word] = len(made)
        look = known.__getitem__
        tokens = [sum(map(look, words)) for words in split]
        n_bytes = [len((t or "").encode()) for t in texts]
        return [np.array(n_bytes, np.int64).tolist(), tokens]

    return run


def count_tokens(docs: DataFrame, path: str, limit: int = 2048, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Bytes and tokens of every whole text, and whether it is over ``limit``.

    One row per input row. Null and empty texts have no bytes and no tokens.
    Special strings inside texts count as the library has them by default.
    """
    counted = map_texts(docs, lambda: _work(path), "n_bytes bigint, n_tokens bigint", key, text)
    return counted.withColumn("over_limit", F.col("n_tokens") > F.lit(limit))
