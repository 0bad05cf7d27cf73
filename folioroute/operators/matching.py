"""Matching documents against an ordered rule table.

A document frame has ``path`` and any of ``text``, ``stem`` and ``metadata``.
Rules are few next to documents, so they enter the plan as expressions: no
join, no shuffle, and the text never leaves the scan stage.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioroute import constants as K
from folioroute.functions import automaton
from folioroute.functions import patterns as P
from folioroute.sources.rules import Rule, RuleSet

# Up to this many rules each one becomes an expression of its own. Beyond it
# the rules are one constant array that is walked per document: as fast from a
# few dozen rules on, and it does not outgrow what the JVM compiles.
EXPRESSION_RULES = 16
# Beyond this many an automaton over the texts they require picks the candidates
# of each document, and only those are tested; measured, it overtakes the walk
# at about a hundred. Where its library is missing, the array is walked.
AUTOMATON_RULES = 100

_TARGETS = {
    K.TARGET_CONTENT: "text",
    K.TARGET_FILE_NAME: "stem",
    K.TARGET_METADATA: "metadata",
}
_LEGACY_TARGETS = {K.TARGET_CONTENT: "text", K.LEGACY_TARGET_METADATA: "metadata"}


def target_column(rule: Rule, legacy: bool = False) -> str | None:
    """Column a rule looks at. Unknown targets mean the content; the legacy
    dialect has no such default and the rule never fires."""
    if legacy:
        return _LEGACY_TARGETS.get(rule.target)
    return _TARGETS.get(rule.target, "text")


def needed_columns(rules: RuleSet) -> set[str]:
    """Document columns the live rules look at; others need not be extracted."""
    return {target_column(rule, rules.legacy) for rule in live_rules(rules)}


def live_rules(rules: RuleSet) -> list[Rule]:
    return [
        rule
        for rule in rules
        if rules.pattern(rule).valid and target_column(rule, rules.legacy) is not None
    ]


def rule_condition(rule: Rule, rules: RuleSet) -> Column:
    target = F.col(target_column(rule, rules.legacy))
    pattern = rules.pattern(rule)
    if rules.legacy:
        return P.exactly(target, pattern, rule.min_hits)
    return P.at_least(target, pattern, rule.min_hits)


def first_match(docs: DataFrame, rules: RuleSet) -> DataFrame:
    """Add ``rule_id``: the first rule that fits, null if none does.

    Later rules are not evaluated once one fits.
    """
    return docs.withColumn("rule_id", first_match_column(rules))


def first_match_column(rules: RuleSet) -> Column:
    live = live_rules(rules)
    walked, own = _split_by_plan(live, rules)
    if not walked:
        tests = [F.when(rule_condition(r, rules), F.lit(r.rule_id)) for r in own]
        return F.coalesce(*tests, F.lit(None).cast("int"))

    table = _rule_array(walked, rules)
    by_place = _by_automaton(walked)

    def step(found: Column, entry: Column) -> Column:
        # The entry stands inside the condition, so nothing is looked up once a rule fits.
        rule = F.get(table, entry) if by_place else entry
        return F.when(found.isNotNull(), found).otherwise(F.when(_walked_condition(rule, rules), rule["rule_id"]))

    entries = _candidates(walked, rules) if by_place else table
    first = F.aggregate(entries, F.lit(None).cast("int"), step)
    others = [F.when(rule_condition(r, rules), F.lit(r.rule_id)) for r in own]
    return F.least(first, F.coalesce(*others, F.lit(None).cast("int"))) if others else first


def match_all(docs: DataFrame, rules: RuleSet, keep: tuple[str, ...] = ("path",)) -> DataFrame:
    """One row per document and fitting rule, with the hit count.

    The hits are gathered in an array per document and unfolded after the text
    has been dropped, so no text is copied per rule.
    """
    walked, own = _split_by_plan(live_rules(rules), rules)
    parts = []
    if own:
        parts.append(F.array(*[_counted(rule, rules) for rule in own]))
    if walked:
        table = _rule_array(walked, rules)
        by_place = _by_automaton(walked)

        def counted(entry: Column) -> Column:
            rule = F.get(table, entry) if by_place else entry
            return F.struct(
                rule["rule_id"].alias("rule_id"),
                _walked_hits(rule, rules).alias("hits"),
                rule["min_hits"].alias("min_hits"),
            )

        parts.append(F.transform(_candidates(walked, rules) if by_place else table, counted))
    if not parts:
        return docs.select(*keep, F.lit(0).alias("rule_id"), F.lit(0).alias("hits")).where("false")
    every = F.concat(*parts) if len(parts) > 1 else parts[0]
    fitting = F.filter(every, lambda x: _fits(x["hits"], x["min_hits"], rules.legacy))
    # The outer form keeps the optimizer from testing the array in a filter of
    # its own, which would count all hits twice.
    return (
        docs.select(*keep, fitting.alias("_fitting"))
        .select(*keep, F.explode_outer("_fitting").alias("_hit"))
        .where(F.col("_hit").isNotNull())
        .select(*keep, "_hit.rule_id", "_hit.hits")
    )


def _counted(rule: Rule, rules: RuleSet) -> Column:
    hits = P.hit_count(F.col(target_column(rule, rules.legacy)), rules.pattern(rule))
    return F.struct(
        F.lit(rule.rule_id).alias("rule_id"),
        hits.alias("hits"),
        F.lit(rule.min_hits).alias("min_hits"),
    )


def _fits(hits: Column, wanted: Column, legacy: bool) -> Column:
    return hits == wanted if legacy else hits >= F.greatest(F.lit(1), wanted)


def _split_by_plan(live: list[Rule], rules: RuleSet) -> tuple[list[Rule], list[Rule]]:
    """Rules to walk as an array, and rules with an expression each."""
    if len(live) <= EXPRESSION_RULES:
        return [], live
    walked = [r for r in live if rules.pattern(r).runs_in_jvm]
    return walked, [r for r in live if not rules.pattern(r).runs_in_jvm]


def _by_automaton(live: list[Rule]) -> bool:
    return len(live) > AUTOMATON_RULES and automaton.available()


def _candidates(live: list[Rule], rules: RuleSet) -> Column:
    """Positions of the rules that may fit a document. A rule of the legacy dialect
    that asks for absence may fit anywhere."""
    return automaton.candidates([_candidate_key(rule, rules) for rule in live])


def _candidate_key(rule: Rule, rules: RuleSet) -> automaton.Key:
    pattern, column = rules.pattern(rule), target_column(rule, rules.legacy)
    texts = [pattern.literal] if pattern.literal else list(pattern.required)
    folded = not texts
    texts = texts or list(pattern.folded)
    if not texts or rules.legacy and rule.min_hits == 0:
        return automaton.Key(column, None)
    return automaton.Key(column, max(texts, key=len), max(1, rule.min_hits), folded)


_RULE_ENTRY = (
    "array<struct<rule_id:int,target:string,java:string,plain:string,plain_bytes:int,"
    "required:array<string>,splits:boolean,min_hits:int>>"
)


def _rule_array(live: list[Rule], rules: RuleSet) -> Column:
    """The rules as one constant array (the optimizer evaluates it once)."""
    entries = []
    for rule in live:
        pattern = rules.pattern(rule)
        plain = pattern.literal or ""
        entries.append(
            {
                "rule_id": rule.rule_id,
                "target": target_column(rule, rules.legacy),
                "java": pattern.java,
                "plain": plain,
                "plain_bytes": len(plain.encode()),
                "required": list(pattern.required),
                "splits": pattern.never_empty and rule.min_hits < 2**31 - 1,
                "min_hits": rule.min_hits,
            }
        )
    return F.from_json(F.lit(json.dumps(entries)), _RULE_ENTRY)


def _walked_target(rule: Column, rules: RuleSet) -> Column:
    used = sorted(needed_columns(rules))
    return F.coalesce(*[F.when(rule["target"] == name, F.col(name)) for name in used], F.lit(""))


def _has_required(target: Column, rule: Column) -> Column:
    return F.forall(rule["required"], lambda text: F.contains(target, text))


def _walked_hits(rule: Column, rules: RuleSet) -> Column:
    """Hits of an array entry on the current document."""
    target = _walked_target(rule, rules)
    return (
        F.when(~_has_required(target, rule), F.lit(0))
        .when(
            rule["plain_bytes"] > 0, P.literal_count(target, rule["plain"], rule["plain_bytes"])
        )
        .otherwise(F.regexp_count(target, rule["java"]))
    )


def _walked_condition(rule: Column, rules: RuleSet) -> Column:
    """Whether an array entry fits the current document."""
    wanted = rule["min_hits"]
    if rules.legacy:
        return _walked_hits(rule, rules) == wanted
    target = _walked_target(rule, rules)
    # As in the expressions: one hit is enough for a threshold of one, and a
    # split ends once there are enough.
    return _has_required(target, rule) & (
        F.when(
            rule["plain_bytes"] > 0,
            F.when(wanted <= 1, F.contains(target, rule["plain"])).otherwise(
                P.literal_count(target, rule["plain"], rule["plain_bytes"]) >= wanted
            ),
        )
        .when(wanted <= 1, F.rlike(target, rule["java"]))
        .when(rule["splits"], F.size(F.split(target, rule["java"], wanted + 1)) > wanted)
        .otherwise(F.regexp_count(target, rule["java"]) >= wanted)
    )


def attach_rule(matched: DataFrame, rules: RuleSet, *fields: str) -> DataFrame:
    """Add fields of the chosen rule by ``rule_id``.

    The rule frame is local, so Spark knows its size and broadcasts it only
    when it is below the session's limit.
    """
    table = rules.to_df(matched.sparkSession).select("rule_id", *fields)
    return matched.join(table, "rule_id", "left")
