"""Personal data by weak supervision.

Candidate spans come from four base shapes and from looser ones. Seven labelers
(shape, checksum, gazetteer, context, neighbourhood, variety, edges) vote yes, no
or nothing on every candidate of the whole table. Only counts of vote patterns
leave the executors; expectation-maximisation over them estimates how reliable
each labeler is for each kind, and its posteriors train a logistic span
classifier on shape and context features. Base spans always stay; looser ones
stay when the classifier says so.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioroute.llm.common import map_texts, parts_of, stored

BASE = ("email", "ip", "card", "phone")
ADDED = ("ssn", "local", "iban", "spelled", "person")
KINDS = BASE + ADDED
LABELERS = 7

# The base shapes. What precedes an @ is taken by walking back.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_PART = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

_LOOSE = {
    "ssn": re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    "local": re.compile(r"(?<![0-9+])\(?[2-9][0-9]{2}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])"),
    "iban": re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    "spelled": re.compile(r"(?<![A-Za-z0-9])[A-Za-z0-9._-]{2,64}\x20[\[(]?at[\])]?\x20[A-Za-z0-9-]{2,63}\x20[\[(]?dot[\])]?\x20[a-z]{2,6}(?![A-Za-z0-9])"),
    "person": re.compile(r"(?<![A-Za-z])(?:Mr|Mrs|Ms|Dr|Prof)\.?\x20[A-Z][a-z]{1,30}(?:\x20[A-Z][a-z]{1,30})?(?![A-Za-z])"),
}
#: What a text must hold for a loose shape to be looked for.
_NEEDS = {"ssn": "-", "local": "", "iban": "", "spelled": "dot", "person": ""}

GIVEN_NAMES = frozenset(
    "james mary john patricia robert jennifer michael linda david elizabeth william barbara richard susan "
    "joseph jessica thomas sarah charles karen anna maria jose juan carlos luis ana laura marta pedro "
    "hans peter klaus ursula monika stefan jean pierre marie michel nathalie isabelle francois wei ming "
    "yuki kenji fatima ahmed omar priya raj".split()
)
TOP_LEVEL = frozenset("com org net edu gov io de fr es uk it nl ch at eu info".split())
COUNTRIES = frozenset("AT BE CH CZ DE DK ES FI FR GB IE IT LU NL NO PL PT SE".split())
CUES = {
    "email": ("mail", "contact", "write"), "ip": ("ip", "host", "address", "server"),
    "card": ("card", "visa", "credit", "payment"), "phone": ("phone", "call", "tel", "mobile", "fax"),
    "ssn": ("ssn", "social", "security"), "local": ("phone", "call", "tel", "mobile", "fax"),
    "iban": ("iban", "account", "bank"), "spelled": ("mail", "contact", "write", "reach"),
    "person": ("dear", "name", "from", "by", "signed", "contact"),
}
AGAINST = ("version", "order", "invoice", "isbn", "chapter", "section", "figure", "page", "ref")


def luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + place % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_PART:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            out.append((start, found.end()))
            done = found.end()
        at = text.find("@", max(at + 1, done))
    return out


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Leftmost non-overlapping matches of each base kind; failing ones are dropped."""
    out = {"email": _emails(text), "ip": [], "card": [], "phone": []}
    out["ip"] = [m.span() for m in _IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) <= 255 for p in m.groups())]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out["card"].append(m.span())
    for m in _PHONE.finditer(text):
        if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
            out["phone"].append(m.span())
    return out


def _loose_spans(text: str, taken: list[tuple[int, int]]) -> dict[str, list[tuple[int, int]]]:
    """Matches of the looser shapes that touch no base span (``taken``, by start)."""
    starts = [a for a, _ in taken]
    reach = list(accumulate((b for _, b in taken), max))
    out = {}
    for kind, shape in _LOOSE.items():
        if _NEEDS[kind] in text:
            found = []
            for m in shape.finditer(text):
                before = bisect_left(starts, m.end())
                if not before or reach[before - 1] <= m.start():
                    found.append(m.span())
            out[kind] = found
    return out


def _iban_valid(value: str) -> bool:
    moved = value[4:] + value[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def votes(text: str, kind: str, start: int, end: int, places: list[int]) -> str:
    """One character per labeler: ``+``, ``-`` or ``0`` for nothing to say."""
    value = text[start:end]
    digits = "".join(c for c in value if "0" <= c <= "9")
    before = text[max(0, start - 40) : start].lower()
    shape = checked = names = "0"
    if kind in ("phone", "local"):
        shape = "+" if 10 <= len(digits) <= 13 else "-"
    elif kind == "ip":
        shape = "+" if not re.search(r"(?:^|\.)0[0-9]", value) else "-"
    elif kind == "email":
        shape = "+" if not value.startswith(".") and ".." not in value else "-"
    elif kind == "person":
        shape = "+" if value.count(" ") == 2 else "0"
    if kind == "card":
        checked = "+" if luhn(digits) else "-"
    elif kind == "iban":
        checked = "+" if _iban_valid(value.replace(" ", "")) else "-"
    elif kind == "ssn":
        checked = "-" if digits[:3] in ("000", "666") or digits[0] == "9" or digits[3:5] == "00" or digits[5:] == "0000" else "+"
    if kind in ("email", "spelled"):
        names = "+" if re.split(r"[.\x20]", value)[-1].lower() in TOP_LEVEL else "-"
    elif kind == "iban":
        names = "+" if value[:2] in COUNTRIES else "-"
    elif kind == "person":
        names = "+" if any(w.lower() in GIVEN_NAMES for w in value.split(" ")[1:]) else "0"
    context = "+" if any(c in before for c in CUES[kind]) else "-" if any(c in before for c in AGAINST) else "0"
    at = bisect_left(places, start)
    near = "+" if (at and start - places[at - 1] < 200) or any(0 < p - start < 200 for p in places[at : at + 2]) else "0"
    varied = "0" if len(digits) < 6 else "-" if len(set(digits)) <= 2 or digits in "01234567890123456789" else "+"
    edges = "-" if (start and text[start - 1].isalnum()) or (end < len(text) and text[end].isalnum()) else "+"
    return shape + checked + names + context + near + varied + edges


def features(text: str, kind: str, start: int, end: int) -> str:
    """What the final classifier sees: kind, length, digits, case, edges, cues. At most 9 x 4 x 3 x 2 x 3 x 3 values."""
    value, before = text[start:end], text[max(0, start - 40) : start].lower()
    share = sum("0" <= c <= "9" for c in value) / len(value)
    cue = 2 if any(c in before for c in CUES[kind]) else 1 if any(c in before for c in AGAINST) else 0
    edge = (start > 0 and text[start - 1].isalnum()) + (end < len(text) and text[end].isalnum())
    return f"{kind}|{min(3, len(value) // 8)}|{int(share * 2.99)}|{int(value[:1].isupper())}|{cue}|{edge}"


def _work() -> Callable[[list], list]:
    span = pa.list_(pa.struct([
        ("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("votes", pa.string()), ("features", pa.string()),
    ]))

    def run(texts: list) -> list:
        rows = []
        for text in texts:
            text = text or ""
            base = base_spans(text)
            taken = sorted(s for spans in base.values() for s in spans)
            found = {**base, **_loose_spans(text, taken)}
            places = sorted({s[0] for spans in found.values() for s in spans})
            rows.append([
                {"kind": k, "start": a, "end": b, "votes": votes(text, k, a, b, places), "features": features(text, k, a, b)}
                for k in KINDS for a, b in found.get(k, ())
            ])
        return [pa.array(rows, type=span)]

    return run


def reliabilities(patterns: list[tuple[str, str, int]], rounds: int = 50) -> dict[tuple[str, str], float]:
    """Posterior that a candidate is real, per kind and vote pattern, by EM.

    Per kind, each labeler says yes, no or nothing with probabilities that differ
    between real and false candidates; smoothed counts start from the majority.
    """
    out = {}
    for kind in sorted({k for k, _, _ in patterns}):
        own = [(v, n) for k, v, n in patterns if k == kind]
        said = np.array([["-0+".index(c) for c in v] for v, _ in own])
        weight = np.array([n for _, n in own], float)
        real = 1 / (1 + np.exp(-((said - 1).sum(1) - 0.5)))
        for _ in range(rounds):
            prior = (real @ weight + 2) / (weight.sum() + 4)
            score = np.log(prior) - np.log1p(-prior) + np.zeros(len(own))
            for labeler in range(said.shape[1]):
                yes = np.bincount(said[:, labeler], weights=weight * real, minlength=3) + np.array([0.5, 1, 1.5])
                no = np.bincount(said[:, labeler], weights=weight * (1 - real), minlength=3) + np.array([1.5, 1, 0.5])
                score += np.log(yes / yes.sum())[said[:, labeler]] - np.log(no / no.sum())[said[:, labeler]]
            real = 1 / (1 + np.exp(-np.clip(score, -30, 30)))
        out.update({(kind, v): float(p) for (v, _), p in zip(own, real)})
    return out


def train(rows: list[tuple[str, float, float]], steps: int = 400) -> dict[str, float]:
    """Logistic regression from features to soft labels: rows of (features, real, false)."""
    columns: dict[tuple, int] = {}
    for text, _, _ in rows:
        parts = text.split("|")
        for at, value in enumerate(parts):
            columns.setdefault((at, value), len(columns))
            columns.setdefault((parts[0], at, value), len(columns))
    matrix = np.zeros((len(rows), len(columns) + 1))
    for row, (text, _, _) in enumerate(rows):
        parts = text.split("|")
        for at, value in enumerate(parts):
            matrix[row, columns[at, value]] = matrix[row, columns[parts[0], at, value]] = 1
    matrix[:, -1] = 1
    real, false = (np.array([r[i] for r in rows]) for i in (1, 2))
    total = real + false
    weight = np.zeros(matrix.shape[1])
    # a row's say grows with the logarithm of its count, so common shapes do not drown rare ones
    say = np.log1p(total) / np.maximum(total, 1e-9)
    for _ in range(steps):
        guess = 1 / (1 + np.exp(-np.clip(matrix @ weight, -30, 30)))
        weight -= 0.3 * (matrix.T @ (say * (total * guess - real)) / max((say * total).sum(), 1) + 1e-4 * weight)
    guess = 1 / (1 + np.exp(-np.clip(matrix @ weight, -30, 30)))
    return {row[0]: float(p) for row, p in zip(rows, guess)}


def _joined(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def candidates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """All candidate spans of every whole text with their votes and features."""
    kind = "array<struct<kind:string,start:int,end:int,votes:string,features:string>>"
    return map_texts(docs, _work, f"candidates {kind}", key, text)


def accepted_features(scanned: DataFrame) -> list[str]:
    """Features of looser spans that the final classifier takes for personal data.

    Pattern counts (at most 3^7 per kind) and feature counts (a few thousand) are
    all that the driver sees; they cover the whole table.
    """
    rows = (
        scanned.select(F.explode("candidates").alias("c"))
        .groupBy("c.kind", "c.votes", "c.features").count().collect()
    )
    per_pattern: dict[tuple[str, str], int] = {}
    for row in rows:
        per_pattern[row["kind"], row["votes"]] = per_pattern.get((row["kind"], row["votes"]), 0) + row["count"]
    real = reliabilities([(k, v, n) for (k, v), n in sorted(per_pattern.items())])
    soft: dict[str, list[float]] = {}
    for row in rows:
        p = real[row["kind"], row["votes"]]
        held = soft.setdefault(row["features"], [0.0, 0.0])
        held[0] += p * row["count"]
        held[1] += (1 - p) * row["count"]
    scores = train([(f, a, b) for f, (a, b) in sorted(soft.items())]) if soft else {}
    return sorted(f for f, p in scores.items() if p >= 0.5 and f.split("|")[0] not in BASE)


def find_pii(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Personal data of every whole text.

    One row per input row: the key, ``base`` and ``found`` (arrays of kind, start
    and end in code points, by kind, then start). Null and empty texts have none.
    The scan writes its slim candidates to the shared folder.
    """
    scanned = stored(candidates(docs, key, text), "pii-candidates")
    accepted = accepted_features(scanned)
    is_base = lambda s: s["kind"].isin(*BASE)
    slim = lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))
    keep = (lambda s: is_base(s) | s["features"].isin(*accepted)) if accepted else is_base
    return scanned.select(
        key,
        F.transform(F.filter("candidates", is_base), slim).alias("base"),
        F.transform(F.filter("candidates", keep), slim).alias("found"),
    )


def digests(found: DataFrame, key: str = "doc_id") -> DataFrame:

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in BASE]
    return found.select(
        key, *counts, F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("found")).alias("spans")
    )


def mask_text(text: str, accepted: frozenset[str]) -> str:
    """The text with each span replaced by its kind in brackets.

    Where spans overlap, the earliest start counts, the longest of equals.
    """
    base = base_spans(text)
    found = {**base, **_loose_spans(text, sorted(s for spans in base.values() for s in spans))}
    spans = sorted(
        (a, -b, k) for k, own in found.items() for a, b in own if k in BASE or features(text, k, a, b) in accepted
    )
    out, done = [], 0
    for start, end, kind in spans:
        if start >= done:
            out += [text[done:start], f"[{kind.upper()}]"]
            done = -end
        elif -end > done:
            # the rest of an overlapping span goes too
            done = -end
    return "".join([*out, text[done:]]) if spans else text


def mask_pii(docs: DataFrame, key: str = "doc_id", text: str = "text", size: str = "n_chars") -> DataFrame:
    """All rows and columns of ``docs`` with personal data masked in ``text``.

    ``size``, where the table has it, becomes the new number of characters. Null
    texts stay null, and rows without personal data stay as they are.
    """
    accepted = frozenset(accepted_features(stored(candidates(docs, key, text), "pii-candidates")))
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts_of(batches, at):
            old = batch.column(at).to_pylist()
            new = [t if t is None else mask_text(t, accepted) for t in old]
            columns = batch.columns
            columns[at] = pa.array(new, type=batch.schema.field(at).type)
            if size in batch.schema.names:
                place = batch.schema.names.index(size)
                kind = batch.schema.field(place).type
                sizes = batch.column(place).to_pylist()
                columns[place] = pa.array(
                    [n if a == b else len(b) for n, a, b in zip(sizes, old, new)], type=kind
                )
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)
