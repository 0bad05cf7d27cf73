import random
import re

import pytest
from pyspark.sql import functions as F

from folioroute.functions import patterns as P

from folioroute.operators import legacy as G
from folioroute.operators import matching as M
from folioroute.plans import routing
from folioroute.sources.rules import make_rules


@pytest.mark.parametrize("seed", range(3))
def test_claims_equal_one_file_after_the_other(spark, seed):
    rnd = random.Random(seed)
    letters = "abcdefgh"
    names = [rnd.choice("PQRSTUV") + str(i % 5) for i in range(8)]
    entries = [dict(pattern=c, name=n, target="內容", occurrence=1) for c, n in zip(letters, names)]
    rules = make_rules(entries, legacy=True)
    size = 400 if seed else 5
    rows = [(f"/in/{rnd.random():.10f}.pdf", "".join(rnd.sample(letters, rnd.choice([0, 1, 1, 2, 3])))) for _ in range(size)]
    existing = [f"/out/{names[0]}.pdf"]
    files = spark.createDataFrame(rows, "path string, text string")
    listing = spark.createDataFrame([(p,) for p in existing], "path string")
    got = G.claim_names(routing.as_documents(files), rules, listing).collect()

    taken, want = {names[0]}, []
    for path, text in sorted(rows):
        for number, entry in enumerate(entries):
            if text.count(entry["pattern"]) == 1 and entry["name"] not in taken:
                taken.add(entry["name"])
                want.append((path, number, entry["name"]))
                break
    assert sorted(tuple(r) for r in got) == want


def test_claims_when_one_rule_fits_everything(spark):
    entries = [dict(pattern="x", name=f"n{i}", target="內容", occurrence=0) for i in range(6)]
    rules = make_rules(entries, legacy=True)
    files = spark.range(3000).select(F.format_string("/in/%05d.pdf", "id").alias("path"), F.lit("").alias("text"))
    got = {r.name: r.path for r in G.claim_names(routing.as_documents(files), rules).collect()}
    assert got == {f"n{i}": f"/in/{i:05d}.pdf" for i in range(6)}


def test_claim_manifest_is_flat(spark):
    files = spark.createDataFrame([("/in/a/b.pdf", "x"), ("/in/c.pdf", "x")], "path string, text string")
    rules = make_rules([dict(pattern="x", name="n", target="內容")], legacy=True)
    rows = G.claim_manifest(routing.as_documents(files), rules, "/out").collect()
    assert [tuple(r) for r in rows] == [("/in/a/b.pdf", 0, "/out/n.pdf")]


def test_running_total(spark):
    rnd = random.Random(5)
    rows = [(f"{rnd.random():.9f}", rnd.randint(0, 9)) for _ in range(2000)]
    frame = spark.createDataFrame(rows, "path string, n int").repartition(7)
    got = {r.path: r.running for r in G.running_total(frame, F.col("n").cast("long")).collect()}
    total, want = 0, {}
    for path, n in sorted(rows):
        total += n
        want[path] = total
    assert got == want


def test_running_metadata_with_seed(spark):
    frame = spark.createDataFrame([("b", "xx"), ("a", "x"), ("c", "")], "path string, metadata string")
    rows = G.running_metadata_hits(frame, "x", seed="axa").collect()
    assert {r.path: (r.hits, r.running_hits) for r in rows} == {"a": (1, 2), "b": (2, 4), "c": (0, 4)}


def test_legacy_rules_ignore_the_current_metadata_label(spark):
    rules = make_rules([dict(pattern="x", name="n", target="元數據")], legacy=True)
    assert M.live_rules(rules) == []


SPANNING = [
    "the", "abab", "aa+b", "[ab]+c", r"\bab", r"ab\b", "a(?=b)", "(?<=a)b", "(?<!c)ab", "b$", "^ab", "ab|bc|c+a", "(?i)AB", r"(a)b\1",
    "(?:ab){2,3}?", r"a[^b]{0,2}c", r"\d+-\d", r"b\n?$", r"(?m)^a", r"\Aab", r"c\Z",
]


@pytest.mark.parametrize("alphabet", ["abc", "abc \n", "ab1-9c."])
def test_running_hits_across_files_equal_the_joined_text(spark, alphabet):
    """Hits that begin in one file's metadata and end in another's, after a seed, with empty and repeated ones."""
    rnd = random.Random(alphabet)
    for size in (1, 60):
        rows = [(f"/in/{rnd.random():.8f}.pdf", "".join(rnd.choice(alphabet) for _ in range(rnd.choice([0, 0, 1, 1, 2, 5, 9])))) for _ in range(size)]
        files = spark.createDataFrame(rows, "path string, metadata string").repartition(3).cache()
        for pattern in rnd.sample(SPANNING, 5):
            seed = rnd.choice(["", "a", "ab", "c.ab", "\nab"])
            joined, want = seed, {}
            for path, text in sorted(rows):
                joined += text
                want[path] = len(re.findall(f"(?:{pattern})" if "|" in pattern else pattern, joined))
            assert P.divider(P.compile_legacy_pattern(pattern)) is not None
            got = {r.path: r.running_hits for r in G.running_metadata_hits(files, pattern, seed).collect()}
            assert got == want, (pattern, seed)


def test_dividers_are_characters_no_match_holds():
    rnd = random.Random(9)
    for pattern in SPANNING:
        cut = P.divider(P.compile_legacy_pattern(pattern))
        for _ in range(200):
            text = "".join(rnd.choice("abcABC 19-.\nx") for _ in range(12))
            held = {i for m in re.finditer(pattern, text) for i in range(*m.span())}
            assert not any(re.match(cut, text[i]) for i in held), (pattern, text)
    assert P.divider(P.compile_legacy_pattern("a*")) is None
    assert not re.match(P.divider(P.compile_pattern("a.c")), "x") and not re.match(P.divider(P.compile_pattern("a.c")), "\n")
    assert re.match(P.divider(P.compile_legacy_pattern("a.c")), "\n")


def test_whole_run_counts_metadata_across_files(spark):
    """A name whose wanted hit lies half in one file's metadata and half in the next one's."""
    files = spark.createDataFrame([("/in/a.pdf", "", "xsr"), ("/in/b.pdf", "", "c1"), ("/in/c.pdf", "", "src1")], "path string, text string, metadata string")
    rules = make_rules([dict(pattern="src1", name="n", target="中介"), dict(pattern="src1", name="m", target="中介", occurrence=2)], legacy=True)
    docs = routing.as_documents(files, rules)
    rows = G.claim_manifest(docs, rules, "/out", matches=G.run_matches(docs, rules)).collect()
    assert {(r.path, r.target_path) for r in rows} == {("/in/b.pdf", "/out/n.pdf"), ("/in/c.pdf", "/out/m.pdf")}


def test_claims_have_no_single_task(spark):
    files = spark.range(2000).select(F.format_string("/in/%05d.pdf", "id").alias("path"), F.lit("x").alias("text"))
    rules = make_rules([dict(pattern="x", name=f"n{i}", target="內容") for i in range(9)], legacy=True)
    placed = G.claim_names(routing.as_documents(files), rules)
    text = placed._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in text and "Python" not in text and "InPandas" not in text
    assert {r.name: r.path for r in placed.collect()} == {f"n{i}": f"/in/{i:05d}.pdf" for i in range(9)}
