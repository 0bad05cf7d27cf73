"""Which of many rules can fit a document at all, in one pass over its text.

A rule with a text that every match must contain can only fit where that text
stands, and as often as the rule wants matches, as these do not overlap. All such
texts of a table are one Aho-Corasick automaton per document column, so a document
is read once however many rules there are; the few rules whose text was met often
enough are then tested on their own. Texts of rules that ignore case are looked for
in the folded document, by an automaton of their own. Rules without such a text are
candidates everywhere.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass
from importlib.util import find_spec
from operator import itemgetter

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from folioroute.functions.patterns import fold_case

_WORD = itemgetter(1)


def available() -> bool:
    """Whether the automaton library is installed (it has to be on the executors, too)."""
    return find_spec("ahocorasick") is not None


@dataclass(frozen=True)
class Key:
    """What an entry needs to fit: ``text`` at least ``least`` times in a document
    ``column``, or in its folded form. Without a text it may fit any document."""

    column: str
    text: str | None
    least: int = 1
    folded: bool = False


def candidates(keys: Sequence[Key]) -> Column:
    """Ascending positions of the entries that may fit: ``array<int>``."""
    always = [i for i, key in enumerate(keys) if key.text is None]
    places: dict[tuple[str, bool], dict[str, list[tuple[int, int]]]] = {}
    for i, key in enumerate(keys):
        if key.text is not None:
            places.setdefault((key.column, key.folded), {}).setdefault(key.text, []).append((i, key.least))
    columns = sorted({column for column, _ in places})
    if not columns:
        return F.array(*map(F.lit, always)).cast("array<int>")
    sought = [(columns.index(column), folded, texts) for (column, folded), texts in sorted(places.items())]

    built: list = []

    def search() -> list:
        if not built:  # once a worker
            import ahocorasick

            for column, folded, texts in sought:
                automaton = ahocorasick.Automaton()
                for text in texts:
                    automaton.add_word(text, text)
                automaton.make_automaton()
                built.append((column, folded, texts, automaton))
        return built

    @F.pandas_udf("array<int>")
    def find(*documents: pd.Series) -> pd.Series:
        automata = search()
        rows = []
        for row in zip(*documents):
            fits = list(always)
            for column, folded, texts, automaton in automata:
                text = row[column]
                if not text:
                    continue
                # Places may overlap, so there are at least as many as matches.
                met = Counter(map(_WORD, automaton.iter(fold_case(text) if folded else text)))
                for word, times in met.items():
                    fits += [i for i, least in texts[word] if times >= least]
            rows.append(sorted(fits))
        return pd.Series(rows, dtype=object)

    return find(*[F.col(c) for c in columns])
