"""Neighbours, manifest and spelling variants against brute force."""

from __future__ import annotations

import random
import zlib
from collections import Counter
from hashlib import sha256

import numpy as np
import pytest

from folioroute.llm import merkle, neighbours, spelling

SF = "/root/testdata/sf0.01"


def ordered(rows) -> list[tuple]:
    return sorted((tuple(r) for r in rows), key=lambda r: tuple((v is not None, v) for v in r))


# nearest neighbours


def nearest_by_force(rows: list[tuple], wanted: int = 20, every: int = 20) -> list[tuple]:
    good = {(i, tuple(map(float, v))) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)}
    out = []
    for q, v in good:
        if q % every == 0:
            others = sorted((-float(np.dot(v, w)), i) for i, w in good if (i, w) != (q, v) and len(v) == len(w))
            out += [(q, k, i, -s) for k, (s, i) in enumerate(others[:wanted], 1)]
    return out


def close(got, want) -> bool:
    got, want = ordered(got), ordered(want)
    return len(got) == len(want) and all(g[:3] == w[:3] and abs(g[3] - w[3]) <= 1e-9 for g, w in zip(got, want))


@pytest.mark.parametrize("leaf", [2048, 40])
def test_neighbours_recall_and_scores(spark, monkeypatch, leaf):
    monkeypatch.setattr(neighbours, "LEAF", leaf)
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = {r.vec_id: np.array(r.embedding, float) for r in table.collect()}
    got = neighbours.nearest(table).collect()
    want = nearest_by_force([(i, v.tolist()) for i, v in rows.items()])
    assert Counter(r.query_id for r in got) == Counter(w[0] for w in want)
    assert len({(r.query_id, r.vec_id) for r in got} & {(w[0], w[2]) for w in want}) / len(want) >= 0.95
    assert all(abs(r.score - rows[r.query_id] @ rows[r.vec_id]) < 1e-12 for r in got)
    by_query: dict = {}
    for r in got:
        by_query.setdefault(r.query_id, []).append(r)
    for found in by_query.values():
        found.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in found] == list(range(1, 21))
        assert [(-r.score, r.vec_id) for r in found] == sorted((-r.score, r.vec_id) for r in found)


def test_neighbours_copies_pieces_and_edges(spark, monkeypatch):
    """A certain test finds all: copies, ties (of sums without rounding), repeated ids, unusable rows, other lengths, clashing columns."""
    monkeypatch.setattr(neighbours, "LEAF", 30)
    monkeypatch.setattr(neighbours, "PIECE", 12)
    monkeypatch.setattr(neighbours, "QUERIES", 3)
    rng = np.random.default_rng(7)
    same = [0.5, -0.25, 0.125]
    rows = [(i, same) for i in range(0, 90)] + [(i, (rng.integers(-16, 17, 3) / 16).tolist()) for i in range(90, 300)]
    rows += [(i, (rng.integers(-16, 17, 2) / 16).tolist()) for i in range(300, 345)] + rows[100:130] + [(100, same), (120, [3.0, 1.0, 2.0]), (340, [9.0])]
    bad = [(400, None), (420, []), (440, [0.0, 0.0, 0.0]), (460, [1.0, None, 1.0]), (480, [1.0, float("nan"), 1.0]), (500, [float("inf"), 1.0, 1.0]), (None, same)]
    schema = "vec_id long, embedding array<double>, label int, uid string, leaf string, score string"
    table = spark.createDataFrame([(*r, 1, "u", "l", "s") for r in rows + bad], schema)
    got = neighbours.nearest(table, certainty=1 - 1e-12)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert close(got.collect(), nearest_by_force(rows))
    assert neighbours.nearest(table.limit(0)).count() == 0


def test_chi_square():
    draws = (np.random.default_rng(1).normal(size=(200_000, 12)) ** 2).sum(1)
    for p in (0.5, 0.9, 0.95):
        assert abs((draws < neighbours.stopping_ratio(p)).mean() - p) < 0.005


# Merkle manifest


def joined(parts) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def field(value) -> str:
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def lowered(text):
    return text if text is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def levels_of(nodes: list[str]) -> list[list[str]]:
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([joined(out[-1][i : i + 8]) for i in range(0, len(out[-1]), 8)])
    return out


def siblings(levels: list[list[str]], place: int) -> list[tuple]:
    out = []
    for level in levels[:-1]:
        start = place // 8 * 8
        out.append((level[start:place], level[place + 1 : start + 8]))
        place //= 8
    return out


def manifest_by_force(rows: list[tuple]) -> list[tuple]:
    groups: dict = {}
    for doc_id, text, lang, source, n_chars in rows:
        own, other = (joined(map(field, (doc_id, source, lang, n_chars, t))) for t in (text, lowered(text)))
        touched = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 0
        groups.setdefault(lang, []).append((doc_id, own, other if touched else own))
    langs = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    for lang in langs:
        groups[lang].sort(key=lambda r: (r[0] is not None, r[0], r[1]))
    trees = [levels_of([r[1] for r in groups[lang]]) for lang in langs]
    top = levels_of([t[-1][0] for t in trees])
    root, out = top[-1][0], []
    for k, lang in enumerate(langs):
        for i, (doc_id, own, folded) in enumerate(groups[lang]):
            proof = siblings(trees[k], i) + siblings(top, k)
            for left, right in proof:
                folded = joined([*left, folded, *right])
            out.append((doc_id, own, trees[k][-1][0], root, joined(x for a, b in proof for x in (*a, *b)), folded, folded == root))
    return out


ODD = [(i % 70 if i % 11 else None, f"Text {i % 5}" if i % 7 else None, ["en", None, "", "zz", "é", f"l{i}"][i % 6], None, i) for i in range(200)] * 2


@pytest.mark.parametrize("size", [512, 3])
def test_manifest_equals_brute_force(spark, size):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    assert ordered(merkle.manifest(docs, size=size).collect()) == ordered(manifest_by_force([tuple(r) for r in docs.collect()]))


@pytest.mark.parametrize("size", [512, 8, 1])
def test_manifest_edges(spark, size):
    """Null and repeated keys, null groups, repeated rows, groups of one, clashing columns; empty and lone tables."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, part int, leaf string, tree int, place long, row int"
    table = spark.createDataFrame([(*r, 1, "x", 2, 3, 4) for r in ODD], schema)
    assert ordered(merkle.manifest(table, size=size).collect()) == ordered(manifest_by_force(ODD))
    assert merkle.manifest(table.limit(0), size=size).count() == 0
    lone = merkle.manifest(table.where("doc_id = 1").limit(1), size=size).first()
    assert lone.leaf == lone.subroot == lone.root and lone.proof_sha256 == joined([])


def test_multiproof_is_minimal_and_complete():
    """Without any one of the missing nodes no proof is possible; with them every leaf has its proof."""
    rng = random.Random(2)
    for n in (1, 2, 8, 9, 64, 65, 700):
        levels = levels_of([joined([str(i)]) for i in range(n)])
        for _ in range(6):
            first = rng.randrange(n)
            last = rng.randrange(first, n)
            wanted = {key: levels[key[0]][key[1]] for key in merkle.missing(first, last, n)}
            known = merkle.interiors(first, levels[0][first : last + 1], n, wanted)
            for place in (first, last, rng.randint(first, last)):
                assert merkle.path(known, place, n) == siblings(levels, place)
                assert merkle.fold(levels[0][place], merkle.path(known, place, n)) == levels[-1][0]
            for key in list(wanted)[:20]:
                with pytest.raises(KeyError):
                    merkle.interiors(first, levels[0][first : last + 1], n, {k: v for k, v in wanted.items() if k != key})


def test_border_nodes_build_the_tree():
    for n in (1, 7, 8, 9, 70, 600):
        levels = levels_of([joined([str(i)]) for i in range(n)])
        for size in (1, 3, 8, 64, 1000):
            found = {(k, i): d for at in range(0, n, size) for k, i, d in merkle.border(at, levels[0][at : at + size], n)}
            assert all(levels[k][i] == d for (k, i), d in found.items())
            # Level by level, what is not there has all its children there.
            for k in range(1, len(levels)):
                for i in range(len(levels[k])):
                    below = [(k - 1, j) for j in range(i * 8, min(i * 8 + 8, len(levels[k - 1])))]
                    if all(b in found for b in below):
                        found.setdefault((k, i), levels[k][i])
            assert (len(levels) - 1, 0) in found


# spelling variants


def one_edit(a: str, b: str) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(a == b[:i] + b[i + 1 :] for i in range(len(b)))


def spelling_by_force(counts: dict[str, int], ratio: int = 5) -> list[tuple]:
    near = {w: [x for x in counts if one_edit(w, x)] for w in counts}
    form = {w: min(near[w], key=lambda x: (-counts[x], x), default=None) for w in counts}
    form = {w: f if f is not None and counts[f] >= ratio * counts[w] else None for w, f in form.items()}

    def root(w: str) -> str:
        while form[w] is not None:
            w = form[w]
        return w

    return [(w, form[w], root(w), n, len(near[w]), counts[form[w]] if form[w] else None) for w, n in counts.items()]


def vocabulary(alphabet: str, longest: int, size: int, seed: int) -> dict[str, int]:
    rng = random.Random(seed)
    words = {"".join(rng.choice(alphabet) for _ in range(rng.randint(1, longest))) for _ in range(size)}
    return {w: rng.choice([1, 2, 5, 10, 30, 150, 1000]) for w in words}


@pytest.mark.parametrize("alphabet, longest", [("ab", 9), ("abé🙂", 6), ("abcdefgh", 4)])
def test_scan_range_equals_brute_force(alphabet, longest):
    words = sorted(vocabulary(alphabet, longest, 500, 1))
    whole = np.array([len(w) // 2 for w in words])
    a, b = spelling.scan_range(words, words, whole)
    got = list(zip(a.tolist(), b.tolist()))
    want = {(i, j) for i, x in enumerate(words) for j, y in enumerate(words) if one_edit(x, y) and y.startswith(x[: len(x) // 2])}
    assert len(got) == len(set(got)) and set(got) == want
    asked = words[::3]
    a, b = spelling.scan_range(words[::2], asked, np.zeros(len(asked), np.int64))
    assert {(asked[i], words[::2][j]) for i, j in zip(a, b)} == {(x, y) for x in asked for y in words[::2] if one_edit(x, y)}


def test_ranges_are_skipped_only_beyond_one_edit():
    words = sorted(vocabulary("abc", 7, 300, 5))
    for prefix in ("", "a", "ab", "abc", "bca", "ccab"):
        for key in words:
            if any(w.startswith(prefix) and (w == key or one_edit(w, key)) for w in words):
                assert spelling.within_one(prefix, key)


@pytest.mark.parametrize("size, lookups", [(7, 2), (50, 32_768), (4096, 32_768)])
def test_grouping_equals_brute_force(spark, monkeypatch, size, lookups):
    monkeypatch.setattr(spelling, "LOOKUPS", lookups)
    counts = vocabulary("abc", 7, 250, 3) | {"x" * 3000: 4, "x" * 2999: 40, "x" * 3000 + "y": 2, "\0a": 1, "a\0": 5}
    table = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert ordered(spelling.group_spellings(table, size=size).collect()) == ordered(spelling_by_force(counts))


def test_spelling_counts_and_edges(spark):
    texts = [
        (1, None), (2, ""), (3, "Garden GARDEN garden"), (3, "Garden GARDEN garden"), (None, "gardén ÀÉ×÷ naïvely"), (4, "gardenia " * 30_000),
        (5, "gar-den gard3n"), *((i, "Garden überall ÜBERALL wonderful wonderfull wonderfuls") for i in range(10, 900)),
    ]
    counts: Counter = Counter()
    for doc_id, text in texts:
        run = ""
        for c in (text or "") + " ":
            if "A" <= c <= "Z" or "a" <= c <= "z" or "À" <= c <= "ÿ":
                run += c.lower() if "A" <= c <= "Z" else c
            elif run:
                h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
                counts[run if h % 199 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
                run = ""
    wanted = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    table = spark.createDataFrame([(*t, "w", 1, "f") for t in texts], "doc_id long, text string, word string, n int, form string")
    got = spelling.spelling_variants(table).collect()
    assert ordered(got) == ordered(spelling_by_force(wanted))
    assert spelling.spelling_variants(table.limit(0)).count() == 0
