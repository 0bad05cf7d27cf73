"""License scans by template markup.

A template is plain wording with two kinds of markup: ``[[ ... ]]`` may be left
out, ``{{name:least-most}}`` stands for that many free words. Templates compile
to automata over words; a text is accepted from a given place when every
mandatory word stands there exactly. The score of a text is the best share of a
template's wording that the automaton got through.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame

from folioroute.llm.common import map_texts

# Base phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Wording of common licence notices, in the markup above.
TEMPLATES = {
    "mit-notice": "released under the mit license",
    "mit-text": (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and "
        "associated documentation files the software to deal in the software without restriction including "
        "without limitation the rights to use copy modify merge publish distribute sublicense and or sell "
        "copies of the software and to permit persons to whom the software is furnished to do so subject to "
        "the following conditions the above copyright notice and this permission notice [[including the next "
        "paragraph]] shall be included in all copies or substantial portions of the software"
    ),
    "isc-text": (
        "permission to use copy modify and [[or]] distribute this software for any purpose with or without "
        "fee is hereby granted provided that the above copyright notice and this permission notice appear in "
        "all copies"
    ),
    "bsd-text": (
        "redistribution and use in source and binary forms with or without modification are permitted "
        "provided that the following conditions are met [[1]] redistributions of source code must retain the "
        "above copyright notice this list of conditions and the following disclaimer [[2]] redistributions in "
        "binary form must reproduce the above copyright notice this list of conditions and the following "
        "disclaimer in the documentation and or other materials provided with the distribution"
    ),
    "bsd-3-clause": (
        "neither the name of {{holder:1-12}} nor the names of its contributors may be used to endorse or "
        "promote products derived from this software without specific prior written permission"
    ),
    "apache-2.0": "licensed under the apache license version 2 0",
    "gpl-notice": "licensed under the [[terms of the]] gnu general public license [[as published by {{who:1-6}}]] version {{number:1-1}}",
    "cc-notice": "licensed under [[a]] cc by [[nc]] [[nd]] [[sa]] {{major:1-1}} 0",
    "mpl-2.0": "subject to the terms of the mozilla public license v 2 0",
}

_ASCII = "".join(chr(c) for c in range(128))
#: A-Z to lower case, every other ASCII character but digits and letters to a blank.
_WORDS = str.maketrans(
    {c: c.lower() if c.isalnum() else " " for c in _ASCII if not (c.isdigit() or c.islower())}
)
#: Bytes that belong to words: digits, letters, and all beyond ASCII.
_WORD_BYTE = np.array([b >= 0x80 or chr(b).isalnum() for b in range(256)])


def words_of(text: str) -> list[str]:
    """Words of a text, A-Z in lower case."""
    return [w for w in text.translate(_WORDS).split(" ") if w]


def count_words(text: str) -> int:
    """The number of words, from the bytes alone."""
    inside = _WORD_BYTE[np.frombuffer(text.encode(), np.uint8)]
    return int(inside[0]) + int(np.count_nonzero(inside[1:] & ~inside[:-1])) if len(inside) else 0


class Template:
    """Automaton of one template: per state, the word it takes or the states it may skip to."""

    def __init__(self, markup: str):
        self.takes: list[str | None] = []  # a word, or None for any word
        self.skips: list[list[int]] = []
        self.mandatory = 0
        opened: list[int] = []
        for part in re.findall(r"\[\[|\]\]|\{\{[^}]*\}\}|[^\s\[\]{}]+", markup):
            if part == "[[":
                opened.append(len(self.takes))
            elif part == "]]":
                self.skips[opened.pop()].append(len(self.takes))
            elif part.startswith("{{"):
                least, most = map(int, re.search(r"(\d+)-(\d+)", part).groups())
                end = len(self.takes) + most
                for step in range(most):
                    self._add(None)
                    if step >= least:
                        self.skips[-1].append(end)
            else:
                self._add(part)
                self.mandatory += not opened
        self.skips.append([])
        self.first = self.takes[0]

    def _add(self, word: str | None) -> None:
        self.takes.append(word)
        self.skips.append([])

    def _closed(self, states: set[int]) -> set[int]:
        todo = list(states)
        while todo:
            for to in self.skips[todo.pop()]:
                if to not in states:
                    states.add(to)
                    todo.append(to)
        return states

    def run(self, words: list[str], start: int) -> float:
        """Share of the automaton passed from ``start``; 1 means accepted."""
        states, reached, end = self._closed({0}), 0, len(self.takes)
        for word in words[start : start + end]:
            states = self._closed({s + 1 for s in states if s < end and self.takes[s] in (None, word)})
            if not states:
                break
            reached = max(reached, *states)
            if end in states:
                return 1.0
        return reached / end


AUTOMATA = {label: Template(markup) for label, markup in TEMPLATES.items()}
_BASE = [(phrase.split(" "), label) for phrase, label in PHRASES.items()]
#: A text without any of these has no base phrase and no template.
_HINTS = re.compile(r"licens|cc[^0-9a-z\x80-\U0010ffff]+by|permission|redistribution|neither")


def scan(words: list[str]) -> tuple[list[int], set[str], set[str], float]:
    """Starts of base phrases, base labels, all labels, and the best template score."""
    where: dict[str, list[int]] = {}
    wanted = {p[0] for p, _ in _BASE} | {a.first for a in AUTOMATA.values()}
    for at, word in enumerate(words):
        if word in wanted:
            where.setdefault(word, []).append(at)
    starts, base = [], set()
    for phrase, label in _BASE:
        hits = [at for at in where.get(phrase[0], ()) if words[at : at + len(phrase)] == phrase]
        starts += hits
        if hits:
            base.add(label)
    labels, best = set(base), 1.0 if base else 0.0
    for label, automaton in AUTOMATA.items():
        score = max((automaton.run(words, at) for at in where.get(automaton.first, ())), default=0.0)
        best = max(best, score)
        if score == 1.0:
            labels.add(label)
    return starts, base, labels, best


def _work() -> Callable[[list], list]:
    def run(texts: list) -> list:
        out: list[list] = [[], [], [], [], [], [], []]
        for text in texts:
            text = text or ""
            starts: list[int] = []
            base: set[str] = set()
            labels: set[str] = set()
            best = 0.0
            if _HINTS.search(text.lower()):
                words = words_of(text)
                n = len(words)
                starts, base, labels, best = scan(words)
            else:
                n = count_words(text)
            row = (
                n, len(starts), min(starts, default=None), max(starts, default=None),
                ",".join(sorted(base)), ",".join(sorted(labels)), best,
            )
            for column, value in zip(out, row):
                column.append(value)
        return out

    return run


def find_licenses(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """License wording of every whole text.

    One row per input row: words, places of base phrases with the first and last
    (null without any), base labels, all labels and the score. Null and empty
    texts have no words, empty labels and score 0.
    """
    return map_texts(
        docs,
        _work,
        "n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, "
        "labels string, score double",
        key,
        text,
    )
