"""Secret scans by assignment-aware lexing.

Three base kinds are plain shapes. On top of them, texts are lexed as source or
configuration: every ``name = literal`` (also ``:``, ``:=``, ``=>``, quoted names,
``export``) becomes a pair, names assigned another name take over its literal
(constants propagate in text order), and a pair is reported when its literal is
strong enough for how sensitive its target name is.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioroute.llm.common import map_texts

# The base shapes.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.ASCII | re.IGNORECASE,
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KEYWORDS = ("passw", "secret", "token", "api")

KINDS = ("assign", "access", "hex", "literal", "propagated")

#: How sensitive a part of a target name is, from 0 to 1.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "pass": 0.9, "pwd": 0.9, "passphrase": 1.0, "secret": 0.9, "token": 0.8,
    "apikey": 0.9, "credential": 0.8, "credentials": 0.8, "auth": 0.6, "private": 0.6, "key": 0.5,
    "access": 0.4, "bearer": 0.7, "cookie": 0.4, "session": 0.4, "dsn": 0.6, "salt": 0.5,
}
PLACEHOLDERS = {
    "changeme", "example", "password", "secret", "token", "none", "null", "true", "false",
    "undefined", "required", "optional", "string", "your_password", "xxx", "todo",
}

# Nothing is capped. Possessive parts keep the lexer linear: what each repeats excludes what follows it.
_PAIR = re.compile(
    r"""(?P<q>["']?)(?P<name>(?<![A-Za-z0-9_.-])[A-Za-z_][A-Za-z0-9_.-]*+)(?P=q)"""
    r"""[\x20\t]*+(?::=|=>|=(?!=)|:(?!:))[\x20\t]*+"""
    r"""(?:"(?P<double>[^"\\\n]*+(?:\\.[^"\\\n]*+)*+)"|'(?P<single>[^'\\\n]*+(?:\\.[^'\\\n]*+)*+)'"""
    r"""|(?P<bare>[A-Za-z0-9_+/.=~$-]++))"""
)
_PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_.-]*\Z")
#: Literals that stand for a value as a whole, and bare variables.
_WHOLE = re.compile(
    r"""\s*+(?:\$\{[^{}]*+\}|\{\{[^{}]*+\}\}|\{[A-Za-z_][A-Za-z0-9_.]*+\}|<[^<>]*+>|\$[A-Z_][A-Z0-9_]*+)\s*+"""
)
_VARIABLE = re.compile(r"\$[A-Za-z_][A-Za-z0-9_]*+\Z")
#: Configuration lines that hold one word: NAME=word, name: word and, below a [section], name = word.
_LINE = re.compile(
    r"""^[\x20\t]*+(?:export[\x20\t]++|-[\x20\t]++)?(["']?)[A-Za-z_][A-Za-z0-9_.-]*+\1"""
    r"""(?:=|:[\x20\t]++|(?P<spaced>[\x20\t]*+[=:][\x20\t]*+))(?P<word>[A-Za-z]++)"""
    r"""[\x20\t]*+(?:(?<=[\x20\t])[#;].*+)?\r?$""",
    re.MULTILINE,
)
_SECTION = re.compile(r"^[\x20\t]*+\[[^\[\]\n]++\][\x20\t]*+\r?$", re.MULTILINE)
#: Least product of name and literal scores.
THRESHOLD = 0.35


def name_score(name: str) -> float:
    """How sensitive a target name is: its most telling part, or two parts joined."""
    parts = [p.lower() for p in _PART.findall(name)]
    joined = [a + b for a, b in zip(parts, parts[1:])]
    return max((SENSITIVE.get(p, 0.0) for p in parts + joined), default=0.0)


def literal_score(literal: str) -> float:
    """How much a literal looks like a secret: length, variety, kinds of characters.

    Any character may stand in it; only whole placeholders are ruled out.
    """
    if len(literal) < 6 or literal.strip().lower() in PLACEHOLDERS or _WHOLE.fullmatch(literal):
        return 0.0
    counts = Counter(literal)
    entropy = -sum(n / len(literal) * math.log2(n / len(literal)) for n in counts.values())
    kinds = sum(any(test(c) for c in counts) for test in (str.islower, str.isupper, str.isdigit))
    mixed = kinds + any(not c.isalnum() for c in counts)
    return min(1.0, entropy / 4) * min(1.0, len(literal) / 12) * (0.5 + 0.25 * min(mixed, 2))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Leftmost non-overlapping matches of each base kind; short ones are dropped."""
    out = []
    low = text.lower()
    if any(word in low for word in KEYWORDS):
        out += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return out


def configured_words(text: str) -> set[int]:
    """Where the bare words of configuration lines begin."""
    sections = _SECTION.search(text)
    below = sections.end() if sections else len(text)
    return {m.start("word") for m in _LINE.finditer(text) if m["spaced"] is None or m.start() > below}


def lexed_spans(text: str) -> list[tuple[str, int, int]]:
    """Literals of sensitive names, and literals that reach one through other names."""
    constants: dict[str, tuple[str, int, int]] = {}
    scores: dict[int, float] = {}
    configured: set[int] | None = None
    out = []
    for m in _PAIR.finditer(text):
        group = "double" if m["double"] is not None else "single" if m["single"] is not None else "bare"
        value, start, end = m[group], m.start(group), m.end(group)
        kind = "literal"
        if group == "bare" and _NAME.match(value):
            if value in constants:
                value, start, end = constants[value]
                kind = "propagated"
            elif value.isalpha():
                configured = configured_words(text) if configured is None else configured
                if start not in configured:
                    constants.pop(m["name"], None)
                    continue
        elif group == "bare" and _VARIABLE.match(value):
            constants.pop(m["name"], None)
            continue
        constants[m["name"]] = (value, start, end)
        sensitive = name_score(m["name"])
        if sensitive < THRESHOLD:
            continue
        if start not in scores:
            scores[start] = literal_score(value)
        if sensitive * scores[start] >= THRESHOLD:
            out.append((kind, start, end))
    return list(dict.fromkeys(out))


def _ordered(spans: list[tuple[str, int, int]]) -> str:
    ranked = sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))
    return ",".join(f"{k}:{a}:{b}" for k, a, b in ranked)


def _work() -> Callable[[list], list]:
    def run(texts: list) -> list:
        counts: list[list[int]] = [[], [], []]
        base, every = [], []
        for text in texts:
            text = text or ""
            found = base_spans(text)
            for column, kind in zip(counts, KINDS):
                column.append(sum(s[0] == kind for s in found))
            base.append(_ordered(found))
            more = lexed_spans(text) if "=" in text or ":" in text else []
            every.append(_ordered(found + more) if more else base[-1])
        return [*counts, base, every]

    return run


def find_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Secrets of every whole text: counts by base kind, base spans and all spans.

    One row per input row; spans are ``kind:start:end`` in code points, ordered by
    start and kind. Null and empty texts have none. A literal reported under its
    own name and reached through another appears once per kind.
    """
    return map_texts(
        docs, _work, "n_assign bigint, n_access bigint, n_hex bigint, base_spans string, spans string", key, text
    )


def digests(found: DataFrame) -> DataFrame:
    return found.select(
        "doc_id", "n_assign", "n_access", "n_hex", F.sha2("base_spans", 256).alias("base_sha256"), "spans"
    )
