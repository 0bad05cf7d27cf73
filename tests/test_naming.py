import random

import pytest
from pyspark.sql import functions as F

from folioroute.operators import naming as N
from folioroute.plans import routing
from folioroute.sources.rules import make_rules


def in_order(claims, existing):
    """One file after the other, in path order, against what exists by then."""
    used, slots = set(existing), {}
    for path, directory, name in sorted(claims):
        slots[path] = None
        if name is None:
            continue
        for k in range(100):
            target = f"{directory}/{name}_{k}.pdf" if k else f"{directory}/{name}.pdf"
            if target not in used:
                used.add(target)
                slots[path] = k
                break
    return slots


def assigned(spark, claims, existing):
    frame = spark.createDataFrame(claims, "path string, dir string, name string")
    listing = spark.createDataFrame([(p,) for p in existing], "path string") if existing else None
    names = list(dict.fromkeys(n for _, _, n in claims if n))
    rows = N.assign_names(frame, names, listing).collect()
    assert len(rows) == len(claims)
    return {r.path: r.slot for r in rows}


def test_hundred_names_and_existing_ones(spark):
    claims = [(f"/in/f{i:03d}.pdf", "/in", "x") for i in range(105)]
    got = assigned(spark, claims, ["/in/x.pdf", "/in/x_2.pdf", "/in/x_02.pdf", "/in/x_100.pdf", "/else/x_1.pdf"])
    assert got == in_order(claims, ["/in/x.pdf", "/in/x_2.pdf"])
    assert sum(slot is None for slot in got.values()) == 7
    assert max(slot for slot in got.values() if slot is not None) == 99


def test_groups_are_independent_and_unmatched_pass(spark):
    claims = [("/a/1.pdf", "/a", "x"), ("/a/2.pdf", "/a", None), ("/b/3.pdf", "/b", "x"), ("/a/4.pdf", "/a", "y")]
    assert assigned(spark, claims, []) == {"/a/1.pdf": 0, "/a/2.pdf": None, "/b/3.pdf": 0, "/a/4.pdf": 0}


def test_a_file_that_has_its_target_name_sees_itself(spark):
    assert assigned(spark, [("/in/x.pdf", "/in", "x")], ["/in/x.pdf"]) == {"/in/x.pdf": 1}


def test_families():
    assert N.name_families(["x", "y", "x_100", "x_0", "x_01", "z_1"]) == {}
    families = N.name_families(["x", "x_1", "x_1_2", "y", "q_3"])
    assert set(families) == {"x", "x_1", "x_1_2"} and len(set(families.values())) == 1


@pytest.mark.parametrize("seed", range(4))
def test_random_claims_against_a_plain_loop(spark, seed):
    random.seed(seed)
    names = ["x", "x_1", "x_1_2", "y", "z_9"] if seed % 2 else ["x", "y", "z_9"]
    claims, existing = [], set()
    for directory in ("/a", "/b"):
        for i in range(random.choice([30, 260])):
            name = random.choice(names + [None])
            claims.append((f"{directory}/{random.random():.12f}.pdf", directory, name))
        for _ in range(40):
            name, k = random.choice(names), random.randint(0, 110)
            existing.add(f"{directory}/{name}_{k}.pdf" if k else f"{directory}/{name}.pdf")
    assert assigned(spark, claims, existing) == in_order(claims, existing)


def test_one_hot_name(spark):
    """A third and more of all files wants one name; nothing is lost."""
    claims = [(f"/in/{i:05d}.pdf", "/in", "hot" if i % 3 else f"n{i % 50}") for i in range(6000)]
    got = assigned(spark, claims, ["/in/hot_5.pdf"])
    assert got == in_order(claims, ["/in/hot_5.pdf"])


def test_manifest_outcomes(spark):
    files = spark.createDataFrame(
        [("/in/a.pdf", "hit", None), ("/in/b.pdf", "miss", None), ("/in/c.pdf", "", "unreadable"),
         ("/in/d.pdf", "secret", None), ("/in/e9.pdf", "", "unreadable")],
        "path string, text string, error string",
    )
    rules = make_rules([dict(pattern="hit", name="n"), dict(pattern="secret", name="s", user_pass="u"), dict(pattern="9", name="f", target="檔名")])
    rows = {r.path: r for r in routing.build_manifest(files, rules, copy_mode=True).collect()}
    assert [rows[f"/in/{x}.pdf"].outcome for x in "abcd"] == ["matched", "unmatched", "error", "matched"]
    # The name of an unreadable file still counts.
    assert rows["/in/e9.pdf"].outcome == "matched" and rows["/in/e9.pdf"].target_path == "/in/f.pdf"
    assert [rows[f"/in/{x}.pdf"].action for x in "abcd"] == ["copy", None, None, "encrypt"]
    assert rows["/in/a.pdf"].target_path == "/in/n.pdf"
    # Whatever the outcome, the job itself did not fail.
    assert {r.ref_status for r in rows.values()} == {2}
    assert "user_pass" not in rows["/in/a.pdf"].asDict()


def test_first_match_wins_even_without_a_free_name(spark):
    claims = [(f"/in/{i:03d}.pdf", "both") for i in range(101)]
    files = spark.createDataFrame(claims, "path string, text string")
    rules = make_rules([dict(pattern="bo", name="one"), dict(pattern="th", name="two")])
    rows = routing.build_manifest(files, rules, directory=F.lit("/out")).where("rule_id = 0").collect()
    assert len(rows) == 101 and [r.outcome for r in rows if r.path == "/in/100.pdf"] == ["name_exhausted"]
