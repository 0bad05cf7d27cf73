import random
import re

import pytest
from pyspark.sql import functions as F

from folioroute.operators import matching as M
from folioroute.plans import routing
from folioroute.sources.rules import make_rules

DOCS = [
    ("/in/a7.pdf", "one two\ntwo", "meta-x"),
    ("/in/b.pdf", "", "x x x"),
    ("/in/c77.pdf", None, None),
    ("/in/d.pdf", "two two two", ""),
]


@pytest.fixture(scope="module")
def docs(spark):
    files = spark.createDataFrame(DOCS, "path string, text string, metadata string")
    return routing.as_documents(files).cache()


def first(docs, entries, legacy=False):
    rows = M.first_match(docs, make_rules(entries, legacy)).collect()
    return [r.rule_id for r in sorted(rows, key=lambda r: r.path)]


def rule(pattern, target="內容", n=1, name="x"):
    return dict(pattern=pattern, target=target, occurrence=n, name=name)


def test_threshold_below_one_acts_as_one(docs):
    assert first(docs, [rule("two", n=0)]) == [0, None, None, 0]
    assert first(docs, [rule("two", n=-5)]) == [0, None, None, 0]
    assert first(docs, [rule("two", n=3)]) == [None, None, None, 0]


def test_exact_count_and_absence(docs):
    assert first(docs, [rule("two", n=2)], legacy=True) == [0, None, None, None]
    assert first(docs, [rule("two", n=0)], legacy=True) == [None, 0, 0, None]


def test_first_rule_wins(docs):
    rules = [rule("nothing"), rule("two", n=3), rule("two"), rule("[0-9]", "檔名")]
    assert first(docs, rules) == [2, None, 3, 1]


def test_targets_and_unknown_target(docs):
    assert first(docs, [rule("x", "元數據", 3)]) == [None, 0, None, None]
    assert first(docs, [rule("7", "檔名", 2)]) == [None, None, 0, None]
    assert first(docs, [rule("two", "其他")]) == [0, None, None, 0]
    # Legacy knows content and its own metadata label only.
    assert first(docs, [rule("two", "其他", 1)], legacy=True) == [None] * 4
    assert first(docs, [rule("x", "中介", 3)], legacy=True) == [None, 0, None, None]


def test_dot_crosses_lines_only_in_the_current_dialect(docs):
    assert first(docs, [rule("one.*two$")]) == [0, None, None, None]
    assert first(docs, [rule("two.two", n=1)], legacy=True) == [None, None, None, 0]


def test_invalid_rule_is_skipped(docs):
    assert first(docs, [rule("(", n=0), rule("two")]) == [1, None, None, 1]
    assert first(docs, [rule("(")]) == [None] * 4


def test_all_matches_with_counts(docs):
    rules = make_rules([rule("two", n=2), rule("two", n=3), rule("o", n=1), rule("(")])
    got = {(r.path, r.rule_id, r.hits) for r in M.match_all(docs, rules).collect()}
    assert got == {
        ("/in/a7.pdf", 0, 2), ("/in/a7.pdf", 2, 3), ("/in/d.pdf", 0, 3), ("/in/d.pdf", 1, 3),
        ("/in/d.pdf", 2, 3),
    }


@pytest.mark.parametrize("legacy", [False, True])
def test_few_and_many_rules_agree(spark, monkeypatch, legacy):
    random.seed(3)
    words = ["ab", "b", "a+", "(?i)AB", "[ab]c", "ca", "a.c", "cc*"]
    targets = ["內容", "檔名", "中介" if legacy else "元數據"]
    entries = [rule(random.choice(words), random.choice(targets), random.randint(0, 3), f"n{i}") for i in range(60)]
    text = lambda: "".join(random.choice("abcAB ") for _ in range(random.randint(0, 20)))
    files = spark.createDataFrame(
        [(f"/in/{i}{text().strip()}.pdf", text(), text()) for i in range(120)],
        "path string, text string, metadata string",
    )
    docs = routing.as_documents(files).cache()
    rules = make_rules(entries, legacy)
    assert len(M.live_rules(rules)) > M.EXPRESSION_RULES

    def run():
        one = {r.path: r.rule_id for r in M.first_match(docs, rules).collect()}
        return one, sorted(tuple(r) for r in M.match_all(docs, rules).collect())

    walked = run()
    monkeypatch.setattr(M, "AUTOMATON_RULES", 20)
    assert run() == walked
    monkeypatch.setattr(M, "EXPRESSION_RULES", 1000)
    assert run() == walked
    flags = 0 if legacy else re.DOTALL

    def fits(row, e):
        column = {"內容": row.text, "檔名": row.stem}.get(e["target"], row.metadata)
        if legacy and e["target"] == "檔名":
            return False
        hits = len(re.findall(e["pattern"], column, flags))
        return hits == e["occurrence"] if legacy else hits >= max(1, e["occurrence"])

    for row in docs.collect():
        want = next((i for i, e in enumerate(entries) if fits(row, e)), None)
        assert walked[0][row.path] == want


def test_rules_without_a_java_form_work_in_both_plans(docs, monkeypatch):
    odd = rule(r"(t)?(?(1)wo|x)", n=2)
    entries = [rule("nothing"), odd, rule("two")]
    assert first(docs, entries) == [1, None, None, 1]
    monkeypatch.setattr(M, "EXPRESSION_RULES", 1)
    assert first(docs, entries) == [1, None, None, 1]
    hits = {(r.path, r.rule_id, r.hits) for r in M.match_all(docs, make_rules(entries)).collect()}
    assert ("/in/a7.pdf", 1, 2) in hits


def test_only_needed_columns_are_computed(spark):
    files = spark.createDataFrame(DOCS, "path string, text string, metadata string")
    assert routing.as_documents(files, make_rules([rule("7", "檔名")])).columns == ["path", "stem"]
    assert routing.as_documents(files, make_rules([rule("("), rule("a")])).columns == ["path", "text"]


def test_attach_rule_keeps_unmatched(docs):
    rules = make_rules([rule("two", name="found")])
    rows = M.attach_rule(M.first_match(docs, rules), rules, "name").collect()
    assert sorted((r.path, r.name) for r in rows)[1] == ("/in/b.pdf", None)


@pytest.mark.parametrize("size, legacy", [(240, False), (240, True), (5000, True)])
def test_automaton_equals_the_walk(spark, monkeypatch, size, legacy):
    """Long tables: the same first matches and the same counts as testing every rule on every text."""
    rnd = random.Random(size)
    syllables = ["ab", "ba", "cé", "d.", "e1", "日本", "🙂x", "''", "-\\n", "zz"]
    word = lambda least: "".join(rnd.choice(syllables) for _ in range(rnd.randint(least, 4)))
    shapes = ["{}", r"\b{}", "{}+", "(?:{})|q", "(?i){}", "[ab]{{2}}{}", "x{}.*y", "(?={})"]
    targets = ["內容", "內容", "檔名", "中介" if legacy else "元數據"]
    entries = [
        rule(rnd.choice(shapes).format(re.escape(word(1))), rnd.choice(targets), rnd.choice([0, 1, 1, 2, 3]), f"n{i}")
        for i in range(size)
    ]
    rows = [(f"/in/{i}-{word(0)}.pdf".replace("\n", ""), "".join(word(0) for _ in range(rnd.randint(0, 12))), word(0)) for i in range(40)]
    docs = routing.as_documents(spark.createDataFrame(rows, "path string, text string, metadata string")).cache()
    rules = make_rules(entries, legacy)

    def run():
        one = {r.path: r.rule_id for r in M.first_match(docs, rules).collect()}
        return one, sorted(tuple(r) for r in M.match_all(docs, rules).collect())

    by_automaton = run()
    plan = M.match_all(docs, rules)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython [") <= 1 + sum(not rules.pattern(r).runs_in_jvm for r in M.live_rules(rules))
    monkeypatch.setattr(M, "AUTOMATON_RULES", size)
    assert run() == by_automaton
    assert len(by_automaton[1]) > 40


def test_candidates_were_met_often_enough_in_any_case(spark):
    """Random tables and texts, with the letters that fold to ASCII ones; against Python's counts."""
    rnd = random.Random(11)
    pairs = [a + b for a in "sikKbt" for b in "isktaéS-"]
    entries = [
        dict(pattern=rnd.choice(["", "(?i)"]) + rnd.choice(["{}", "{}", "x?{}", "({})+", "{}|zz"]).format(pair), name=f"n{i}", target="內容", occurrence=rnd.randrange(1, 7))
        for i, pair in enumerate(pairs * 3)
    ]
    texts = ["".join(rnd.choices("sSikKbtKſİıéÉaxz- ", k=rnd.randrange(90))) for _ in range(60)] + ["", "ΑΣİſ sı"]
    for legacy in (False, True):
        rules = make_rules(entries, legacy=legacy)
        docs = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "path string, text string")
        live = M.live_rules(rules)
        walked = M._split_by_plan(live, rules)[0]
        assert len(walked) > M.AUTOMATON_RULES
        first = {int(r.path): r.rule_id for r in M.first_match(docs, rules).collect()}
        met = {int(r.path): r.c for r in docs.select("path", M._candidates(walked, rules).alias("c")).collect()}
        for number, text in enumerate(texts):
            counts = [len(re.findall(r.pattern, text, 0 if legacy else re.DOTALL)) for r in live]
            fitting = [r.rule_id for r, n in zip(live, counts) if (n == r.min_hits if legacy else n >= max(1, r.min_hits))]
            assert first[number] == (fitting[0] if fitting else None)
            chosen = {walked[i].rule_id for i in met[number]}
            assert chosen >= set(fitting) & {r.rule_id for r in walked}
    # Met once too seldom is no candidate, whatever its case.
    rules = make_rules([dict(pattern="(?i)ab", name="a", target="內容", occurrence=3), dict(pattern="cd", name="c", target="內容", occurrence=2)] * 60)
    docs = spark.createDataFrame([("abABcd",), ("aBAbabcd",)], "text string")
    found = docs.select(F.size(M._candidates(M.live_rules(rules), rules)).alias("n")).collect()
    assert [r.n for r in found] == [0, 60]
