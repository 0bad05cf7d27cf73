"""Rule patterns: from the dialect rule files are written in to Spark columns.

Rule files hold Python regular expressions. Spark evaluates Java ones. The two
read alike but count differently on line ends, Unicode classes, word borders
and several escapes, so a pattern is restated construct by construct in terms
both agree on. What has no exact Java form keeps Python's engine, in an Arrow
batch function for that rule alone.
"""

from __future__ import annotations

import re
import warnings
from dataclasses import dataclass
from functools import lru_cache, reduce
from importlib import import_module
from operator import and_

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from folioroute.functions.text import WHITESPACE

try:
    from re import _parser as _sre
except ImportError:  # before Python 3.11
    import sre_parse as _sre

# Java matches a repeated group by recursion; longer repeats of groups over a
# long text would exhaust the task's stack.
_LONGEST_GROUP_REPEAT = 200

_DIGIT = r"\p{Nd}"
# U+10000 is a letter already; naming it makes Java look behind by whole
# characters instead of UTF-16 units.
_WORD = "\\p{L}\\p{N}_\U00010000"
# Java tries matches between the two UTF-16 units of one character as well.
_WHOLE_CHARACTER = r"(?![\x{DC00}-\x{DFFF}])"
# Always true, and by its last character it makes a lookbehind step whole ones.
_BY_CHARACTERS = "(?!(?!)\U00010000)"
_CLASSES = {
    "DIGIT": (_DIGIT, "0-9"),
    "SPACE": (WHITESPACE, r"\x09-\x0D\x20"),
    "WORD": (_WORD, "0-9A-Za-z_"),
}


class _NoJavaForm(Exception):
    pass


@dataclass(frozen=True)
class Pattern:
    """A rule pattern ready for use.

    ``java`` is the Spark form, None if there is none; ``counts_agree`` tells
    whether the number of its matches (not only their existence) is exact.
    ``literal`` is set if the pattern is plain text, ``required`` are
    texts every match contains, ``folded`` those that its ``fold_case`` contains.
    """

    source: str
    valid: bool
    flags: int = re.DOTALL
    java: str | None = None
    counts_agree: bool = True
    never_empty: bool = False
    literal: str | None = None
    required: tuple[str, ...] = ()
    folded: tuple[str, ...] = ()
    engine: str = "re"

    @property
    def runs_in_jvm(self) -> bool:
        return self.literal is not None or (self.java is not None and self.counts_agree)


def compile_pattern(source: str) -> Pattern:
    """Read a rule pattern. One that does not compile is kept as invalid."""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            re.compile(source, re.DOTALL)
            tree = _sre.parse(source, re.DOTALL)
    except Exception:
        return Pattern(source, valid=False)
    flags = tree.state.flags
    try:
        body = _sequence(tree, flags)
        java = "(?s)" + (_WHOLE_CHARACTER if _may_start_inside(tree, flags) else "") + body
    except _NoJavaForm:
        java = None
    literal = None
    if len(tree) and not flags & re.IGNORECASE and all(str(op) == "LITERAL" for op, _ in tree):
        literal = "".join(chr(code) for _, code in tree)
    return Pattern(
        source,
        valid=True,
        java=java,
        counts_agree=tree.getwidth()[0] > 0 or _only_greedy_characters(tree),
        never_empty=tree.getwidth()[0] > 0,
        literal=literal,
        required=_required_texts(tree, flags),
        folded=_required_texts(tree, flags, folded=True),
    )


def compile_legacy_pattern(source: str) -> Pattern:
    """A pattern of the older rule dialect.

    A dot stops at line feeds, a class may subtract another, ``{,n}`` is plain
    text, and groups may be named in quotes or angle brackets. What Python can
    parse after that is restated for Java like any other pattern; the rest runs
    in a batch function with an engine that knows Unicode properties.
    """
    plain = bool(source) and not re.search(r"[\\^$.|?*+()\[\]{}]", source)
    if plain:
        return Pattern(source, valid=True, flags=0, java=re.escape(source), literal=source, required=())
    restated = _restate_legacy(source)
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            re.compile(restated)
            tree = _sre.parse(restated)
    except Exception:
        return _by_other_engine(restated)
    flags = tree.state.flags
    try:
        java = (_WHOLE_CHARACTER if _may_start_inside(tree, flags) else "") + _sequence(tree, flags)
    except _NoJavaForm:
        java = None
    return Pattern(
        restated,
        valid=True,
        flags=0,
        java=java,
        counts_agree=tree.getwidth()[0] > 0 or _only_greedy_characters(tree),
        never_empty=tree.getwidth()[0] > 0,
        required=_required_texts(tree, flags),
        folded=_required_texts(tree, flags, folded=True),
    )


def _by_other_engine(source: str) -> Pattern:
    """A pattern for the engine that knows Unicode properties; what it cannot read
    either (balancing groups, say) never fires."""
    try:
        import_module("regex").compile(source)
    except Exception:
        return Pattern(source, valid=False)
    return Pattern(source, valid=True, flags=0, counts_agree=False, engine="regex")


# Escapes of the older dialect that Python spells otherwise.
_LEGACY_ESCAPES = {r"\Z": r"(?=\n?\Z)", r"\z": r"\Z", r"\e": r"\x1b"}


def _restate_legacy(source: str) -> str:
    """Group names, plain braces and class subtraction in Python's spelling."""
    out, at = [], 0
    while at < len(source):
        if source[at] == "\\":
            named = re.compile(r"\\k[<'](\w+)[>']").match(source, at)
            escape = source[at : at + 2]
            out.append(f"(?P={named[1]})" if named else _LEGACY_ESCAPES.get(escape, escape))
            at = named.end() if named else at + 2
        elif named := re.compile(r"\(\?(?:<([A-Za-z_]\w*)>|'([A-Za-z_]\w*)')").match(source, at):
            out.append(f"(?P<{named[1] or named[2]}>")
            at = named.end()
        elif braces := re.compile(r"\{,\d*\}").match(source, at):
            out.append("".join("\\" + c if c in "{}" else c for c in braces[0]))
            at = braces.end()
        elif source[at] == "[":
            text, at = _legacy_class(source, at)
            out.append(text)
        else:
            out.append(source[at])
            at += 1
    return "".join(out)


def _legacy_class(source: str, at: int) -> tuple[str, int]:
    """A class that starts at ``at`` and where it ends; ``[a-[b]]`` becomes a
    lookahead that rules out ``b``. Brackets and ampersands within are plain."""
    start, inner = at, at + 1
    if source[inner : inner + 1] == "^":
        inner += 1
    if source[inner : inner + 1] == "]":
        inner += 1
    members = [source[start + 1 : inner]]
    while inner < len(source) and source[inner] != "]":
        if source.startswith("-[", inner):
            less, inner = _legacy_class(source, inner + 1)
            if source[inner : inner + 1] != "]":
                break
            return f"(?:(?!{less})[{''.join(members)}])", inner + 1
        step = 2 if source[inner] == "\\" else 1
        piece = source[inner : inner + step]
        members.append("\\" + piece if piece in ("[", "&") else piece)
        inner += step
    return source[start:at + 1] + "".join(members) + source[inner : inner + 1], inner + 1


# --- restating a parsed pattern -------------------------------------------


def _any_case(body: str, flags: int) -> str:
    return f"(?{'i' if flags & re.ASCII else 'iu'}:{body})"


_FOLDS_TO_ASCII = {"İ": "i", "ı": "i", "\u212a": "k", "ſ": "s"}


def fold_case(text: str) -> str:
    """A text in which all variants of an ASCII character are one."""
    if not text.isascii():
        for variant, char in _FOLDS_TO_ASCII.items():
            text = text.replace(variant, char)
    return text.lower()


@lru_cache(maxsize=512)
def _variants(code: int, ascii_only: bool) -> tuple[int, ...]:
    """The characters an ASCII character stands for when case is ignored.

    Spelled out they match much faster than by Java's case folding.
    """
    char = chr(code)
    # Unicode letters that fold to ASCII ones are among these.
    candidates = {char, char.lower(), char.upper(), *_FOLDS_TO_ASCII}
    same = re.compile(re.escape(char), re.IGNORECASE | (re.ASCII if ascii_only else 0))
    return tuple(sorted(ord(c) for c in candidates if same.fullmatch(c)))


def _spelled_out(code: int, flags: int) -> str:
    return "".join(_character(v) for v in _variants(code, bool(flags & re.ASCII)))


def _character(code: int) -> str:
    if 0xD800 <= code <= 0xDFFF:
        raise _NoJavaForm("lone surrogate")
    char = chr(code)
    return char if char.isalnum() or char in " _" else f"\\x{{{code:X}}}"


def _class_items(items, flags: int) -> str:
    ascii_only = bool(flags & re.ASCII)
    out = []
    for op, arg in items:
        name = str(op)
        if name == "NEGATE":
            continue
        if name == "LITERAL":
            out.append(_spelled_out(arg, flags) if flags & re.IGNORECASE and arg < 128 else _character(arg))
        elif name == "RANGE":
            out.append(f"{_character(arg[0])}-{_character(arg[1])}")
            if flags & re.IGNORECASE and arg[1] < 128:
                out += [_spelled_out(c, flags) for c in range(arg[0], arg[1] + 1) if chr(c).isalpha()]
        elif name == "CATEGORY":
            out.append(_category(str(arg), ascii_only))
        else:
            raise _NoJavaForm(name)
    return "".join(out)


def _category(name: str, ascii_only: bool) -> str:
    kind = name.rsplit("_", 1)[-1]
    members = _CLASSES[kind][1 if ascii_only else 0]
    return f"[^{members}]" if "_NOT_" in name else members


def _word(flags: int) -> str:
    return _CLASSES["WORD"][1 if flags & re.ASCII else 0]


def _position(name: str, flags: int) -> str:
    w = f"[{_word(flags)}]"
    many_lines = bool(flags & re.MULTILINE)
    return {
        "AT_BEGINNING": r"(?:\A|(?<=\n))" if many_lines else r"\A",
        "AT_BEGINNING_STRING": r"\A",
        "AT_END": r"(?=\n|\z)" if many_lines else r"(?=\n?\z)",
        "AT_END_STRING": r"\z",
        "AT_BOUNDARY": f"(?:(?<={w})(?!{w})|(?<!{w})(?={w}))",
        "AT_NON_BOUNDARY": rf"(?:(?<={w})(?={w})|(?<!{w})(?!{w})(?!\A\z))",
    }[name]


def _sequence(tree, flags: int) -> str:
    return "".join(_item(str(op), arg, flags) for op, arg in tree)


def _beyond_ascii(name: str, arg) -> bool:
    """Whether case folding of an item needs more than spelling it out."""
    if name in ("LITERAL", "NOT_LITERAL"):
        return arg >= 128
    return name == "GROUPREF" or name == "IN" and any(
        str(op) == "LITERAL" and a >= 128 or str(op) == "RANGE" and a[1] >= 128 for op, a in arg
    )


def _item(name: str, arg, flags: int) -> str:
    if flags & re.IGNORECASE:
        if _beyond_ascii(name, arg):
            return _any_case(_item(name, arg, flags & ~re.IGNORECASE), flags)
        if name == "LITERAL":
            letters = _spelled_out(arg, flags)
            return f"[{letters}]" if len(_variants(arg, bool(flags & re.ASCII))) > 1 else letters
        if name == "NOT_LITERAL":
            return f"[^{_spelled_out(arg, flags)}]"
    if name == "LITERAL":
        return _character(arg)
    if name == "NOT_LITERAL":
        return f"[^{_character(arg)}]"
    if name == "ANY":
        return "." if flags & re.DOTALL else r"[^\n]"
    if name == "IN":
        negated = str(arg[0][0]) == "NEGATE"
        return f"[{'^' if negated else ''}{_class_items(arg, flags)}]"
    if name == "AT":
        return _position(str(arg), flags)
    if name == "BRANCH":
        return "(?:" + "|".join(_sequence(branch, flags) for branch in arg[1]) + ")"
    if name == "SUBPATTERN":
        group, add, drop, body = arg
        inner = (flags | add) & ~drop
        text = _sequence(body, inner)
        return f"(?:{text})" if group is None else f"({text})"
    if name == "ATOMIC_GROUP":
        return f"(?>{_sequence(arg, flags)})"
    if name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
        return _repeat(name, arg, flags)
    if name in ("ASSERT", "ASSERT_NOT"):
        direction, body = arg
        mark = ("?" if direction > 0 else "?<") + ("=" if name == "ASSERT" else "!")
        tail = "" if direction > 0 else _BY_CHARACTERS
        return f"({mark}{_sequence(body, flags)}{tail})"
    if name == "GROUPREF":
        return f"(?:\\{arg})"
    if name == "FAILURE":
        return "(?!)"
    raise _NoJavaForm(name)


def _repeat(name: str, arg, flags: int) -> str:
    least, most, body = arg
    unbounded = most == _sre.MAXREPEAT
    if not _one_character(body):
        if body.getwidth()[0] == 0 and (unbounded or most > 1):
            raise _NoJavaForm("repeat of a possibly empty group")
        if (unbounded or most > _LONGEST_GROUP_REPEAT) and not _fixed_characters(body):
            raise _NoJavaForm("long repeat of a group")
    count = f"{{{least},{'' if unbounded else most}}}"
    mark = {"MAX_REPEAT": "", "MIN_REPEAT": "?", "POSSESSIVE_REPEAT": "+"}[name]
    inner = _sequence(body, flags)
    return f"(?:{inner}){count}{mark}" if not _one_character(body) else f"{inner}{count}{mark}"


_SINGLE = {"LITERAL", "NOT_LITERAL", "ANY", "IN"}


def _one_character(tree) -> bool:
    return len(tree) == 1 and str(tree[0][0]) in _SINGLE


def _fixed_characters(tree) -> bool:
    if len(tree) == 1 and str(tree[0][0]) == "SUBPATTERN" and not tree[0][1][1] | tree[0][1][2]:
        tree = tree[0][1][3]
    return all(str(op) in _SINGLE and _fixed_units(str(op), arg) for op, arg in tree)


def _fixed_units(name: str, arg) -> bool:
    """Whether all characters an item takes have one number of UTF-16 units; if
    not, Java repeats the group by recursion."""
    if name == "LITERAL":
        return True
    return name == "IN" and all(
        str(op) == "LITERAL" and a < 0x10000 or str(op) == "RANGE" and a[1] < 0x10000 for op, a in arg
    )


def _only_greedy_characters(tree) -> bool:
    """Nothing but greedy repeats of single characters: an empty match then
    proves that no longer one starts at the same place."""
    return all(str(op) == "MAX_REPEAT" and _one_character(arg[2]) for op, arg in tree)


def _may_start_inside(tree, flags: int) -> bool:
    """Whether a match could begin in the middle of a two-unit character."""
    if not len(tree):
        return True
    op, arg = tree[0]
    name = str(op)
    if name == "LITERAL":
        return False
    if name == "IN":
        return any(
            str(o) == "NEGATE" or "_NOT_" in str(a) or (str(o) == "RANGE" and a[1] >= 0xD800)
            for o, a in arg
        )
    if name == "AT":
        first = str(arg)
        return not (first == "AT_BEGINNING_STRING" or first == "AT_BEGINNING" and not flags & re.MULTILINE)
    if name == "SUBPATTERN":
        return _may_start_inside(arg[3], flags | arg[1])
    if name == "BRANCH":
        return any(_may_start_inside(branch, flags) for branch in arg[1])
    if name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and arg[0] > 0:
        return _may_start_inside(arg[2], flags)
    return True


def _required_texts(tree, flags: int, folded: bool = False) -> tuple[str, ...]:
    """The longest runs of plain characters that are part of every match; ``folded``,
    of ASCII ones in its ``fold_case``."""
    found = _required_runs(tree, flags, folded)
    runs = sorted({fold_case(run) if folded else run for run in found}, key=lambda run: (-len(run), run))
    telling = [run for run in runs if len(run) > 1 or not run.isalnum()]
    return tuple(run for run in telling if not any(run in o and run != o for o in telling))[:3]


def _required_runs(tree, flags: int, folded: bool = False):
    run = ""
    for op, arg in tree:
        name = str(op)
        if name == "LITERAL" and (arg < 128 if folded else not flags & re.IGNORECASE or _has_no_case(arg)):
            run += chr(arg)
            continue
        if run:
            yield run
        run = ""
        if name == "SUBPATTERN":
            yield from _required_runs(arg[3], (flags | arg[1]) & ~arg[2], folded)
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and arg[0] > 0:
            yield from _required_runs(arg[2], flags, folded)
    if run:
        yield run


def _has_no_case(code: int) -> bool:
    char = chr(code)
    return code < 128 and char.lower() == char.upper()


# --- where matches cannot be -------------------------------------------------


_CATEGORIES = {
    "CATEGORY_DIGIT": r"\d", "CATEGORY_NOT_DIGIT": r"\D", "CATEGORY_SPACE": r"\s",
    "CATEGORY_NOT_SPACE": r"\S", "CATEGORY_WORD": r"\w", "CATEGORY_NOT_WORD": r"\W",
}


def divider(pattern: Pattern) -> str | None:
    """A regular expression for single characters that no match can hold or look at
    beyond its ends, other than as a neighbour; None if there may be none.

    Text between two such characters can be searched on its own, as long as the
    characters stand at its ends.
    """
    if not pattern.valid or not (pattern.never_empty or pattern.literal) or pattern.engine != "re":
        return None
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        tree = _sre.parse(pattern.source, pattern.flags)
    atoms = sorted(set(_atoms(tree, tree.state.flags)))
    return f"(?s)(?!{'|'.join(atoms)})."


def _atoms(tree, flags: int):
    """Single characters and classes that a pattern is made of, as expressions."""

    def spelled(body: str) -> str:
        on = "".join(c for c, f in (("i", re.IGNORECASE), ("a", re.ASCII), ("s", re.DOTALL)) if flags & f)
        return f"(?{on}:{body})" if on else f"(?-s:{body})" if body == "." else body

    for op, arg in tree:
        name = str(op)
        if name == "LITERAL":
            yield spelled(re.escape(chr(arg)))
        elif name == "NOT_LITERAL":
            yield spelled(f"[^{re.escape(chr(arg))}]")
        elif name == "ANY":
            yield spelled(".")
        elif name == "IN":
            yield spelled(_class_text(arg))
        elif name == "AT":
            if str(arg) == "AT_END":  # also stands before a line feed that ends the text
                yield r"\n"
        elif name == "SUBPATTERN":
            yield from _atoms(arg[3], (flags | arg[1]) & ~arg[2])
        elif name == "BRANCH":
            for branch in arg[1]:
                yield from _atoms(branch, flags)
        elif name in ("ASSERT", "ASSERT_NOT"):
            yield from _atoms(arg[1], flags)
        elif name == "GROUPREF_EXISTS":
            yield from _atoms(arg[1], flags)
            yield from _atoms(arg[2] or [], flags)
        elif name == "ATOMIC_GROUP":
            yield from _atoms(arg, flags)
        elif name.endswith("_REPEAT"):
            yield from _atoms(arg[2], flags)


def _class_text(items) -> str:
    out = "["
    for op, arg in items:
        name = str(op)
        if name == "NEGATE":
            out += "^"
        elif name == "LITERAL":
            out += re.escape(chr(arg))
        elif name == "RANGE":
            out += f"{re.escape(chr(arg[0]))}-{re.escape(chr(arg[1]))}"
        else:
            out += _CATEGORIES[str(arg)]
    return out + "]"


# --- columns ---------------------------------------------------------------


def _python_hits(pattern: Pattern):
    source, flags, engine = pattern.source, pattern.flags, pattern.engine

    @F.pandas_udf("int")
    def hits(texts: pd.Series) -> pd.Series:
        find = import_module(engine).compile(source, flags).finditer
        return texts.map(lambda text: sum(1 for _ in find(text)))

    return hits


def _contains_required(target: Column, pattern: Pattern) -> Column | None:
    tests = [F.contains(target, F.lit(text)) for text in pattern.required]
    return reduce(and_, tests) if tests else None


def hit_count(target: Column, pattern: Pattern) -> Column:
    """Number of non-overlapping matches in a text (never null)."""
    text = F.coalesce(target, F.lit(""))
    if not pattern.valid:
        return F.lit(0)
    if pattern.literal is not None:
        return literal_count(text, F.lit(pattern.literal), len(pattern.literal.encode()))
    if pattern.java is None or not pattern.counts_agree:
        return _python_hits(pattern)(text)
    count = F.regexp_count(text, F.lit(pattern.java))
    needed = _contains_required(text, pattern)
    return count if needed is None else F.when(needed, count).otherwise(0)


def has_hit(target: Column, pattern: Pattern) -> Column:
    """Whether a text has any match; stops at the first one."""
    text = F.coalesce(target, F.lit(""))
    if not pattern.valid:
        return F.lit(False)
    if pattern.literal is not None:
        return F.contains(text, F.lit(pattern.literal))
    if pattern.java is None:
        return _python_hits(pattern)(text) > 0
    found = text.rlike(pattern.java)
    needed = _contains_required(text, pattern)
    return found if needed is None else needed & found


def literal_count(text: Column, literal: Column, byte_length: int) -> Column:
    """Occurrences of a plain text, by the bytes its removal takes away."""
    removed = F.octet_length(text) - F.octet_length(F.replace(text, literal, F.lit("")))
    return (removed / F.lit(byte_length)).cast("int")


def at_least(target: Column, pattern: Pattern, least: int) -> Column:
    """No hit never qualifies, so a threshold below one acts as one."""
    if least <= 1:
        return has_hit(target, pattern)
    splits = pattern.java is not None and pattern.literal is None and pattern.never_empty
    if not splits or least >= 2**31 - 1:  # no text holds as many characters
        return hit_count(target, pattern) >= least
    # Splitting stops once there are enough matches; counting reads on.
    text = F.coalesce(target, F.lit(""))
    enough = F.size(F.split(text, pattern.java, least + 1)) > least
    needed = _contains_required(text, pattern)
    return enough if needed is None else needed & enough


def exactly(target: Column, pattern: Pattern, count: int) -> Column:
    """Exact count; zero asks for the absence of the pattern."""
    if count == 0:
        return ~has_hit(target, pattern)
    return hit_count(target, pattern) == count
