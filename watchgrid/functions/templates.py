"""Query templates: a rule over captured command output, built-in ones, and conversion of old monitor settings."""

from __future__ import annotations

import json
import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from watchgrid.functions.text import checked, find_all, verdict


@dataclass(frozen=True)
class Template:
    """kind is valid_match, invalid_match or regex_extract; patterns go by field for the last."""

    name: str
    kind: str
    pattern: str
    groups: int = 0
    expect: bool = True
    fields: Mapping[str, str] = field(default_factory=dict)


#: The patterns of the built-in templates, which match over lines and case aside.
BUILT_IN = (
    Template("disk_state", "valid_match", r"(?im)running|online|active"),
    Template("raid_health", "invalid_match", r"(?im)degraded|failed|inactive", expect=False),
    Template("service_state", "valid_match", r"(?im)^active$"),
    Template("memory_use", "regex_extract", r"(?im)Mem:\s+(\d+)\s+(\d+)", 2, fields={"total_mb": r"(?im)Mem:\s+(\d+)", "used_mb": r"(?im)Mem:\s+\d+\s+(\d+)"}),
    Template("cpu_load", "regex_extract", r"(?im)load average:\s*([\d.]+)", 1, fields={"load_1": r"(?im)load average:\s*([\d.]+)", "load_5": r"(?im)load average:\s*[\d.]+,\s*([\d.]+)"}),
    Template("network", "valid_match", r"(?im)1 (packets )?received|1 received"),
)


def executed(runs: DataFrame, templates: Sequence[Template]) -> DataFrame:
    """Each run with each template's found values and verdict; a run that could not start, exit -1, is an error.

    runs has exit_code, stdout and stderr. A template whose pattern isn't valid finds nothing.
    """
    spark = runs.sparkSession
    output = F.coalesce(F.nullif("stdout", F.lit("")), "stderr", F.lit(""))
    rows = []
    for t in templates:
        good = checked(spark, t.pattern) is None
        found = find_all(output, t.pattern, t.groups) if good else F.array().cast("array<string>")
        rows.append(F.struct(F.lit(t.name).alias("template"), found.alias("found"), verdict(found, t.kind, t.expect).alias("verdict")))
    held = runs.withColumn("t", F.explode(F.array(*rows))).select(*runs.columns, "t.*")
    failed = F.col("exit_code") == -1
    return held.withColumn("state", F.when(failed, "error").otherwise("ok")).withColumn("verdict", F.when(failed, "abnormal").otherwise(F.col("verdict")))


def tested(spark: SparkSession, pattern: str, text: str, groups: int = 0) -> tuple[str | None, list[str]]:
    """What is wrong with a pattern, or None and what it finds in a text."""
    wrong = checked(spark, pattern)
    if wrong:
        return wrong, []
    return None, spark.range(1).select(find_all(F.lit(text), pattern, groups).alias("f")).first()["f"]


#: Strategies of the second version.
STRATEGIES = ("pipe", "kv", "json", "table", "lines", "diff", "exit_code")


def converted(match_type: str, match_expression: str) -> tuple[str, dict[str, Any]]:
    """The strategy and its settings of a monitor's first version; a strategy's own name brings its settings as JSON.

    Text that must be contained becomes an escaped pattern to count lines by; whatever else is unknown takes the
    first line that matches.
    """
    if match_type in STRATEGIES:
        try:
            settings = json.loads(match_expression) if match_expression else {}
        except ValueError:
            settings = {}
        return match_type, settings if isinstance(settings, dict) else {}
    if match_type == "jsonpath":
        return "json", {"path": match_expression}
    if match_type == "contains":
        return "lines", {"pattern": re.escape(match_expression), "mode": "count"}
    return "lines", {"pattern": match_expression if match_type == "regex" else match_expression or ".", "mode": "first"}
