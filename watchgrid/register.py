"""The registry of the monitoring queries, each with its SQL for the check where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from watchgrid.schema import SQL

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

RANK_NAME = "['info', 'warning', 'error', 'critical'][{} + 1]"


def query(sql: str | None = None, raw: bool = False) -> Callable[[Query], Query]:
    """Register a query under its function's name; sql is put behind the entities unless it is raw."""

    def add(f: Query) -> Query:
        name = f.__name__
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql if raw else f"WITH {SQL.strip()}{sql if sql.lstrip().startswith(',') else ' ' + sql}"
        return f

    return add
