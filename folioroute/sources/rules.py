"""Rule tables: reading, normalizing and holding them."""

from __future__ import annotations

import codecs
import csv
import io
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioroute import constants as K
from folioroute.functions.patterns import Pattern, compile_legacy_pattern, compile_pattern
from folioroute.functions.text import strip
from folioroute.session import local_frame

RAW_FIELDS = ["pattern", "name", "target", "occurrence", "user_pass", "owner_pass"]

RULE_SCHEMA = T.StructType(
    [
        T.StructField("rule_id", T.IntegerType(), False),
        T.StructField("pattern", T.StringType(), False),
        T.StructField("name", T.StringType(), False),
        T.StructField("target", T.StringType(), False),
        T.StructField("min_hits", T.IntegerType(), False),
        T.StructField("user_pass", T.StringType(), False),
        T.StructField("owner_pass", T.StringType(), False),
        T.StructField("encrypt", T.BooleanType(), False),
        T.StructField("valid", T.BooleanType(), False),
    ]
)


@dataclass(frozen=True)
class Rule:
    rule_id: int
    pattern: str
    name: str
    target: str = K.TARGET_CONTENT
    min_hits: int = 1
    user_pass: str = ""
    owner_pass: str = ""
    encrypt: bool = False


@dataclass
class RuleSet:
    """Ordered rules and the way they match: at least, or (legacy) exactly,
    the wanted number of hits."""

    rules: list[Rule]
    legacy: bool = False
    _patterns: dict[str, Pattern] = field(default_factory=dict, repr=False)

    def __post_init__(self):
        compile_one = compile_legacy_pattern if self.legacy else compile_pattern
        for rule in self.rules:
            if rule.pattern not in self._patterns:
                self._patterns[rule.pattern] = compile_one(rule.pattern)

    def __iter__(self):
        return iter(self.rules)

    def __len__(self):
        return len(self.rules)

    def pattern(self, rule: Rule) -> Pattern:
        return self._patterns[rule.pattern]

    def names(self) -> list[str]:
        """Distinct target names in rule order."""
        return list(dict.fromkeys(rule.name for rule in self.rules))

    def to_df(self, spark: SparkSession) -> DataFrame:
        rows = [
            (r.rule_id, r.pattern, r.name, r.target, r.min_hits, r.user_pass, r.owner_pass,
             r.encrypt, self.pattern(r).valid)
            for r in self.rules
        ]
        return local_frame(spark, rows, RULE_SCHEMA)


def make_rules(entries: list[dict], legacy: bool = False) -> RuleSet:
    """Rules from typed-in entries.

    ``target`` may be a label or one of the codes 1, 2, 3; unknown codes mean
    the content. Occurrence defaults to 1.
    """
    rules = []
    for number, entry in enumerate(entries):
        user, owner = entry.get("user_pass", ""), entry.get("owner_pass", "")
        target = str(entry.get("target", "1"))
        if target not in K.TARGET_CODES.values() and not legacy:
            target = K.TARGET_CODES.get(target, K.TARGET_CONTENT)
        rules.append(
            Rule(
                rule_id=number,
                pattern=entry["pattern"],
                name=entry["name"],
                target=target,
                min_hits=int(entry.get("occurrence", 1)),
                user_pass=user,
                owner_pass=owner,
                encrypt=entry.get("encrypt", bool(user or owner)),
            )
        )
    return RuleSet(rules, legacy)


def read_rules(
    spark: SparkSession,
    path: str,
    header: bool = False,
    legacy: bool = False,
    encrypt: bool = False,
    default_user_pass: str = "",
    default_owner_pass: str = "",
) -> RuleSet:
    """Read a rule file: UTF-8 CSV, six columns by position.

    Rows with fewer columns are dropped, extra columns ignored. The legacy
    dialect skips the first row, takes ``encrypt`` for the whole run and
    rejects an occurrence that is no number.
    """
    raw = read_rule_rows(spark, path, header=header or legacy, legacy=legacy)
    rows = normalize_rules(raw, legacy, encrypt, default_user_pass, default_owner_pass)
    rules = []
    for r in rows.orderBy("file", "position").collect():
        if r.user_pass is None or r.owner_pass is None:
            break  # a password with a bad escape ends the reading; earlier rules stay
        rules.append(Rule(len(rules), r.pattern, r.name, r.target, r.min_hits, r.user_pass, r.owner_pass, r.encrypt))
    return RuleSet(rules, legacy)


def read_rule_rows(spark: SparkSession, path: str, header: bool = False, legacy: bool = False) -> DataFrame:
    """The six text columns of each complete row, its ``file`` and ``position``.

    Rows are ordered by file name, then position; a header is skipped in every
    file. Legacy files lose blank lines before that, and blanks around fields. A
    rule file is small. It is taken as one text, because Spark's CSV reader
    cannot tell a missing last column from an empty one.
    """
    fields = ", ".join(f"{name} string" for name in RAW_FIELDS)
    whole = spark.read.text(path, wholetext=True).select("value", F.input_file_name().alias("file"))
    return whole.mapInPandas(_row_parser(header, legacy), f"file string, position int, {fields}")


def _row_parser(header: bool, legacy: bool = False):
    columns, wanted = ["file", "position", *RAW_FIELDS], len(RAW_FIELDS)

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for text, file in zip(batch["value"], batch["file"]):
                plain = text.removeprefix("\ufeff").replace("\r\n", "\n").replace("\r", "\n")
                rows = list(csv.reader(io.StringIO(plain)))
                if legacy:
                    rows = [[field.strip() for field in row] for row in rows if "".join(row).strip()]
                complete = [row[:wanted] for row in rows[1 if header else 0 :] if len(row) >= wanted]
                yield pd.DataFrame([(file, i, *row) for i, row in enumerate(complete)], columns=columns)

    return parse


def normalize_rules(
    raw: DataFrame,
    legacy: bool = False,
    encrypt: bool = False,
    default_user_pass: str = "",
    default_owner_pass: str = "",
) -> DataFrame:
    """Raw text columns to typed rule columns; other columns pass through."""
    others = [c for c in raw.columns if c not in RAW_FIELDS]

    def password(name: str, default: str) -> Column:
        given = F.coalesce(F.nullif(F.col(name), F.lit("")), F.lit(default))
        if not legacy:  # an escape that cannot be decoded stays visible as null
            given = F.when(raw_literal(name) & F.col(name).isNull(), F.lit(None)).otherwise(given)
        return given.alias(name)

    def raw_literal(name: str) -> Column:
        return F.coalesce(F.col(f"_raw_{name}").startswith("b'"), F.lit(False))

    if legacy:
        number = F.col("occurrence")
        valid_number = strip(number).rlike(r"\A[+-]?[0-9]+\z")
        problem = F.concat(F.lit("occurrence is not a number: "), number)
        return raw.select(
            *others, "pattern", "name", "target",
            F.when(valid_number, strip(number).cast("int"))
            .otherwise(F.raise_error(problem).cast("int")).alias("min_hits"),
            password("user_pass", default_user_pass),
            password("owner_pass", default_owner_pass),
            F.lit(encrypt).alias("encrypt"),
        )
    clean = raw.select(*others, *[strip(F.col(c)).alias(c) for c in RAW_FIELDS]).withColumns(
        {"_raw_user_pass": F.col("user_pass"), "_raw_owner_pass": F.col("owner_pass")}
    ).withColumns(
        {
            "user_pass": decode_byte_literal(F.col("user_pass")),
            "owner_pass": decode_byte_literal(F.col("owner_pass")),
        }
    )
    has_password = (strip("user_pass") != "") | (strip("owner_pass") != "")
    return clean.select(
        *others, "pattern", "name", "target",
        F.when(
            F.col("occurrence").rlike(r"\A[+-]?[0-9]+\z"),
            F.coalesce(F.col("occurrence").try_cast("int"), _beyond(F.col("occurrence"))),
        )
        # Digits of other scripts and underscores between digits are numbers too.
        .when(
            F.col("occurrence").rlike(r"\A[+-]?\p{Nd}+(?:_\p{Nd}+)*\z"),
            _number_reader()(F.coalesce("occurrence", F.lit(""))),
        )
        .otherwise(1).alias("min_hits"),
        password("user_pass", default_user_pass),
        password("owner_pass", default_owner_pass),
        has_password.alias("encrypt"),
    )


def _beyond(number: Column) -> Column:
    """The nearest threshold to a number beyond the integers: its sign decides."""
    return F.when(number.startswith("-"), -(2**31)).otherwise(2**31 - 1)


def _number_reader():
    @F.pandas_udf("int")
    def read(values: pd.Series) -> pd.Series:
        def one(value: str) -> int:
            try:
                return max(-(2**31), min(2**31 - 1, int(value)))
            except ValueError:
                return 1

        return values.map(one)

    return read


def decode_byte_literal(value: Column) -> Column:
    """``b'...'`` to the text between the quotes with its escapes decoded; null
    where an escape is broken. A lone ``b'`` is a literal of nothing."""
    inner = F.regexp_extract(value, r"(?s)\Ab'(.*)'\z", 1)
    is_literal = value.rlike(r"(?s)\Ab'.*'\z") | (value == "b'")
    # Escapes and non-ASCII text need the full decoder; plain passwords do not.
    plain = inner.rlike(r"\A[\x00-\x7F&&[^\\]]*\z")
    return (
        F.when(~is_literal | value.isNull(), value)
        .when(plain, inner)
        .otherwise(_escape_decoder()(F.when(is_literal & ~plain, inner).otherwise("")))
    )


def _escape_decoder():
    @F.pandas_udf("string")
    def decode(values: pd.Series) -> pd.Series:
        def one(value: str) -> str | None:
            try:
                return codecs.decode(value.encode("utf-8"), "unicode_escape")
            except UnicodeDecodeError:
                return None

        return values.map(one)

    return decode
