import random
import re

import pytest
from pyspark.sql import functions as F

from folioroute.functions import patterns as P

TEXTS = [
    "", "baac", "abab", "١2 x", "a　b", "end\r\n", "end\n", "x\n", "a", "aab", "[a&b]", "É é", "aa",
    "hello world", "foo_bar-baz", "naïve café", "e\u0301 combining", "x\u2028y", "line1\nline2\n",
    "𝒜𝒷 math", "a𝟘b𝒜", "😀b😀", "Kelvin \u212a ſ", "İstanbul ıSTIK aA",
    "a.b@c.de", "the cat and the dog and", "\n\n", "aaa bbb", "0x1F 12 34",
]

PATTERNS = [
    "a*", "", "(a)(b)", r"\d", r"\s", "end$", r"x\Z", r"\Aa", "^line", "(?m)^line", "(?m)$",
    "(?P<n>a)", "(?P<n>a)(?P=n)", "a{,2}b", "[[a]", "[a&&b]", "[a&b]", "(?i)É", r"(a)\1", r"\bb",
    r"\Bb", r"\w+", r"\W", r"\S+", r"[^\W\d]+", r"[\s\d]", "a+?", "a*?", r"\b|\w+", "(?:foo|bar)",
    "(?i)[a-z]+", "(?i:K)s?", "(?s:.)", "(?-s:.)+", ".", "the.*?and", "(?=a)", "(?<=a)b", "(?<!a)b",
    "(?>a+)b", "a++b", "(a|b)*", "(?:ab)+", "(?a:\\w+)", r"(?a)\d", "[\\]\\[]", r"\.", r"\x41|\u00e9",
    "(a)?(?(1)b|c)", "(?x) a  b # c", "[^a]", "[^\\n]+", r"a{2}", r"a{1,}", "#", " ", "(?i)ſ",
    r"(?<=\D)b", r"(?<!\w)b", "..", "[^b]b", "b?", "(?i)stik", "(?i)[i-s]+", "(?i)[^a-k]", "(?i)[é-ü]", r"(?i)(a)\1", "(?ai)k", "(?i)[^É]b", "(?i)i",
]


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string").cache()


@pytest.mark.parametrize("start", range(0, len(PATTERNS), 12))
def test_counts_are_those_of_the_rule_dialect(texts, start):
    part = PATTERNS[start : start + 12]
    columns = []
    for k, source in enumerate(part):
        pattern = P.compile_pattern(source)
        columns.append(P.hit_count(F.col("t"), pattern).alias(f"c{k}"))
        columns.append(P.has_hit(F.col("t"), pattern).alias(f"h{k}"))
    got = texts.orderBy("i").select(*columns).collect()
    for k, source in enumerate(part):
        want = [len(re.findall(source, t, re.DOTALL)) for t in TEXTS]
        assert [r[f"c{k}"] for r in got] == want, source
        assert [r[f"h{k}"] for r in got] == [n > 0 for n in want], source


def test_usual_patterns_stay_in_the_jvm():
    for source in ["a*", r"\bfoo\b", r"(?i)licen[sc]e", "^x$", r"\d+-\d+", "the.*?and", ".*"]:
        assert P.compile_pattern(source).runs_in_jvm, source
    for source in ["(a)?(?(1)b|c)", r"\b|\w+", "(?:foo|bar)*x"]:
        assert not P.compile_pattern(source).runs_in_jvm, source


def test_invalid_patterns_never_match(texts):
    for source in ["(", "*", "[", "(?P<n", "a{2,1}"]:
        pattern = P.compile_pattern(source)
        assert not pattern.valid
        assert texts.where(P.has_hit(F.col("t"), pattern)).count() == 0
        assert texts.where(P.at_least(F.col("t"), pattern, 0)).count() == 0


def test_required_texts_are_part_of_every_match():
    required = lambda source: P.compile_pattern(source).required
    assert required(r"[a-z]+@[a-z]+") == ("@",)
    assert required(r"the.*?and") == ("and", "the")
    assert required(r"(?i)the") == required(r"ab|cd") == required("(?:xyz){0,2}") == ()
    assert required(r"(?i)no-12.*x") == ("-12",)
    assert required(r"(?:xyz){2}qq(?i:rr)(?=ss)") == ("xyz", "qq")
    assert P.compile_legacy_pattern(r"[A-Za-z]+@x").required == ("@x",)
    assert P.compile_legacy_pattern(r"[a-z-[aeiou]]x").required == ()
    assert P.compile_legacy_pattern(r"\p{L}+").required == ()


def test_random_patterns(spark):
    random.seed(7)
    atoms = ["a", "b", ".", r"\w", r"\d", r"\s", "[ab]", "[^a]", r"\b", "^", "$", "é", r"\W", "(?:ab)",
             "(a)", "(?i:B)", "(?=b)", "(?<!a)", "a|b", "(?:a|bb)"]
    quantifiers = ["", "", "", "*", "+", "?", "{2}", "{,2}", "*?", "+?", "{1,3}"]
    sources = set()
    while len(sources) < 150:
        parts = []
        for _ in range(random.randint(1, 4)):
            atom, many = random.choice(atoms), random.choice(quantifiers)
            parts.append(atom if atom[0] in "^$" or atom in (r"\b", "(?=b)", "(?<!a)", "a|b") else atom + many)
        source = "".join(parts)
        try:
            re.compile(source)
            sources.add(source)
        except re.error:
            pass
    texts = ["".join(random.choice("aabB é1\n_-") for _ in range(random.randint(0, 14))) for _ in range(25)]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").cache()
    # Rules that stay in the JVM; the others run the dialect's own engine.
    jvm = [s for s in sorted(sources) if P.compile_pattern(s).runs_in_jvm]
    assert len(jvm) > 50
    for start in range(0, len(jvm), 25):
        part = jvm[start : start + 25]
        rows = frame.orderBy("i").select(
            *[P.hit_count(F.col("t"), P.compile_pattern(s)).alias(f"c{k}") for k, s in enumerate(part)]
        ).collect()
        for k, source in enumerate(part):
            want = [len(re.findall(source, t, re.DOTALL)) for t in texts]
            assert [r[k] for r in rows] == want, source


def test_long_texts_do_not_exhaust_the_stack(spark):
    frame = spark.createDataFrame([("ab" * 200_000 + "\n",)], "t string")
    for source in ["(?:a|b)*", "(a|b)+", "(?:ab)+", "(?:.|\n)*x?", ".*"]:
        pattern = P.compile_pattern(source)
        want = len(re.findall(source, "ab" * 200_000 + "\n", re.DOTALL))
        assert frame.select(P.hit_count(F.col("t"), pattern)).first()[0] == want, source


def test_legacy_dialect(spark):
    frame = spark.createDataFrame([("a\nb c",), ("end\r\n",), ("١",)], "t string")

    def counts(source):
        return [r[0] for r in frame.select(P.hit_count(F.col("t"), P.compile_legacy_pattern(source))).collect()]

    assert counts("a.b") == [0, 0, 0]  # a dot stops at line feeds
    assert counts(r"\d") == [0, 0, 1]
    assert counts("end$") == [0, 0, 0]
    assert counts("(?i)END.$") == [0, 1, 0]


LEGACY = {
    "[a-z-[aeiou]]": ("abcde", 3), "[a&&b]": ("a&b", 3), "[[a]": ("[a]", 2), "a{,2}": ("xa{,2}y aa", 1),
    "(?'n'a)b": ("abab", 2), r"(?<n>a)\k<n>": ("aaab", 1), r"\p{Lu}": ("aBÉ", 2), "a.b": ("a\nb a-b", 1),
    "(?:ab|c)+": ("abccab x", 1), r"b\Z": ("ab\n", 1),
}


def test_legacy_dialect_counts(spark):
    for source, (text, count) in LEGACY.items():
        pattern = P.compile_legacy_pattern(source)
        frame = spark.createDataFrame([(text,)], "t string")
        row = frame.select(P.hit_count(F.col("t"), pattern).alias("n"), P.has_hit(F.col("t"), pattern).alias("h")).first()
        assert (row.n, row.h) == (count, True), source


def test_legacy_patterns_no_engine_reads_never_fire(texts):
    for source in ["(", "(?<a-b>x)", r"b\z(?n)"]:
        pattern = P.compile_legacy_pattern(source)
        assert texts.where(P.has_hit(F.col("t"), pattern)).count() == 0


@pytest.mark.parametrize(
    "compile_one, source, text, count",
    [
        (P.compile_legacy_pattern, "(ab|c)*d", "abc" * 60_000 + "d", 1),
        (P.compile_pattern, "(?:[^x]y)*e", "ay😀y" * 20_000 + "e", 1),
        (P.compile_pattern, r"(?:\wy)+e", "ay𝒜y" * 20_000 + "e", 1),
        (P.compile_pattern, "(?:ay)+e", "ay" * 100_000 + "e", 1),
    ],
)
def test_long_repeats_do_not_exhaust_the_stack(spark, compile_one, source, text, count):
    frame = spark.createDataFrame([(text,)], "t string")
    pattern = compile_one(source)
    assert frame.select(P.hit_count(F.col("t"), pattern)).first()[0] == count
