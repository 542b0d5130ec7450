"""Guarded SQL: questions of users run only as a single SELECT over tables that they may read.

Spark's parser reads the text; the policy looks at the plan, so neither comments, case, quoting nor strings that
hold words of SQL can mislead it. Whatever isn't named here is rejected: kinds of plan nodes, kinds of expressions
that name something, and functions.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

LIMIT = 200
ALLOWED_ROOTS = {"Project", "Filter", "Aggregate", "Sort", "GlobalLimit", "LocalLimit", "Offset", "Join", "SubqueryAlias", "UnresolvedRelation", "UnresolvedHaving", "Distinct"}
#: Functions that only compute from their arguments. None reads files, settings, other tables or the JVM.
ALLOWED_FUNCTIONS = frozenset(
    """abs avg bround cast ceil ceiling char_length coalesce concat concat_ws contains count count_if current_date current_timestamp date date_add date_diff date_format
    date_sub date_trunc datediff day dayofmonth dayofweek endswith floor from_unixtime get_json_object greatest hour if ifnull initcap instr isnotnull isnull lag
    last_day lead least left length like lower lpad ltrim max max_by mean median min min_by minute mod month nullif nvl percentile percentile_approx pow power quarter
    rank dense_rank regexp_extract regexp_replace replace right round row_number rpad rtrim second sign split_part sqrt startswith stddev stddev_samp substr substring
    sum timestamp timestampdiff to_date to_timestamp trim trunc try_cast unix_timestamp upper variance when year
    + - * / % = == <=> != <> < <= > >= and or not in between is null""".split()
)


class Rejected(ValueError):
    """Why a text may not run."""


def listed(items) -> Iterator:
    for k in range(items.size()):
        yield items.apply(k)


def nodes(plan) -> Iterator:
    yield plan
    for child in listed(plan.children()):
        yield from nodes(child)


def check_names(names: list[str], hidden: set[str]) -> None:
    """Each part of a name counts: a hidden column stays hidden with a field or a table around it."""
    for part in names:
        if part.lower() in hidden:
            raise Rejected(f"column {part.lower()} is hidden")


def check_expression(e, hidden: set[str]) -> None:
    name = e.nodeName().removeprefix("'")
    if "Star" in name:
        raise Rejected("* is not allowed")
    if "Subquery" in name or name == "Exists":
        raise Rejected("subqueries are not allowed")
    if name == "UnresolvedAttribute":
        check_names(list(listed(e.nameParts())), hidden)
    elif name == "UnresolvedFunction":
        called = list(listed(e.nameParts()))
        if len(called) != 1 or called[0].lower() not in ALLOWED_FUNCTIONS:
            raise Rejected(f"function {'.'.join(called)} is not allowed")
    elif name.startswith("Unresolved") and name not in ("UnresolvedAlias", "UnresolvedOrdinal", "UnresolvedExtractValue", "UnresolvedWindowExpression"):
        raise Rejected(f"{name} is not allowed")
    elif name == "Alias":
        check_names([e.name()], hidden)


def validate(spark: SparkSession, sql: str, tables: set[str], hidden: set[str]) -> None:
    """Raise Rejected unless sql is one plain SELECT over tables.

    Neither *, subqueries, set operations, natural joins, hidden columns nor functions beyond ALLOWED_FUNCTIONS may
    occur in it, and it must read a table.
    """
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql.strip().rstrip(";"))
    except Exception as e:
        raise Rejected("it can't be parsed") from e
    read = 0
    for node in nodes(plan):
        kind = node.nodeName().removeprefix("'")
        if kind not in ALLOWED_ROOTS:
            raise Rejected(f"{kind} is not allowed")
        if kind == "UnresolvedRelation":
            name = ".".join(listed(node.multipartIdentifier())).lower()
            if name not in tables:
                raise Rejected(f"table {name} is not allowed")
            read += 1
        if kind == "Join":
            joined = node.joinType().toString()
            if joined.startswith("Natural"):
                raise Rejected("natural joins are not allowed")
            if joined.startswith("UsingJoin"):
                check_names(list(listed(node.joinType().usingColumns())), hidden)
        for expression in listed(node.expressions()):
            for e in nodes(expression):
                check_expression(e, hidden)
    if not read:
        raise Rejected("it reads no table")


def run(spark: SparkSession, sql: str, tables: set[str], hidden: set[str], limit: int = LIMIT) -> DataFrame:
    """The rows of a text that passes, limit at most."""
    validate(spark, sql, tables, hidden)
    return spark.sql(sql.strip().rstrip(";")).limit(limit)
