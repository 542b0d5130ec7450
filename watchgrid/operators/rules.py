"""Expectation rules: which alerts a running test explains."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from watchgrid.functions.text import checked


@dataclass
class Rule:
    """All clauses that are given must hold; of patterns any may. A pattern equals the value or matches it."""

    rule_id: int
    priority: int
    task_types: Sequence[str] = ()
    observers: Sequence[str] = ()
    levels: Sequence[str] = ()
    messages: Sequence[str] = ()
    enabled: bool = True


def any_of(tests: Sequence[Column]) -> Column:
    return reduce(Column.__or__, tests, F.lit(False))


def holds(rule: Rule, bad: frozenset[str] = frozenset()) -> Column:
    """The rule as one condition. Patterns in bad, which aren't valid, match nothing but an observer of that name."""
    terms = []
    if rule.task_types:
        terms.append(F.col("task_type").isin(*rule.task_types))
    if rule.observers:
        terms.append(any_of([(F.col("observer") == p) | (F.lit(False) if p in bad else F.col("observer").rlike(f"(?i){p}")) for p in rule.observers]))
    if rule.levels:
        terms.append(F.col("level").isin(*rule.levels))
    if rule.messages:
        terms.append(any_of([F.coalesce("message", F.lit("")).rlike(f"(?i){p}") for p in rule.messages if p not in bad]))
    return reduce(Column.__and__, terms, F.lit(True))


def expected(alerts: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """alerts with is_expected and the first rule by priority that holds; without a task it is unknown, 0.

    Rules are configuration: they become one CASE in the plan. Invalid patterns are found before it runs.
    """
    bad = frozenset(p for r in rules for p in (*r.observers, *r.messages) if checked(alerts.sparkSession, p))
    first = F.lit(None).cast("int")
    for rule in sorted((r for r in rules if r.enabled), key=lambda r: (r.priority, r.rule_id), reverse=True):
        first = F.when(holds(rule, bad), rule.rule_id).otherwise(first)
    matched = F.when(F.nullif("task_type", F.lit("")).isNotNull(), first)
    return alerts.withColumn("matched_rule_id", matched).withColumn("is_expected", F.col("matched_rule_id").isNotNull().cast("int"))
