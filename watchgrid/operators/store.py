"""Reads of the alert store: filters, pages, statistics, lookups and latest rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from watchgrid.schema import LEVELS, level_rank, micros

#: Categories of observers; an observer in none is of the system.
CATEGORIES = {"interaction": ("click", "view"), "commerce": ("purchase",), "session": ("login", "signup", "logout")}


def matching(alerts: DataFrame, array_id: int | None = None, observer: str | None = None, level: str | None = None, min_level: str | None = None, start: str | None = None, end: str | None = None, category: str | None = None) -> DataFrame:
    """The rows that meet all conditions given; bounds belong to the range. An exact observer wins over a category, and an unknown category is no condition."""
    terms: list[Column] = []
    if array_id is not None:
        terms.append(F.col("array_id") == array_id)
    if observer is not None:
        terms.append(F.col("observer") == observer)
    elif category in CATEGORIES:
        terms.append(F.col("observer").isin(*CATEGORIES[category]))
    if level is not None:
        terms.append(F.col("level") == level)
    if min_level is not None:
        terms.append(level_rank(F.col("level")) >= LEVELS.index(min_level))
    if start is not None:
        terms.append(F.col("ts") >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        terms.append(F.col("ts") <= F.lit(end).cast("timestamp_ntz"))
    return alerts.where(reduce(Column.__and__, terms)) if terms else alerts


def page(rows: DataFrame, limit: int, offset: int = 0, newest_first: bool = True) -> DataFrame:
    """One page by time, ties by id."""
    order = [F.desc("ts"), F.desc("id")] if newest_first else [F.asc("ts"), F.asc("id")]
    return rows.orderBy(*order).offset(offset).limit(limit)


def counted(alerts: DataFrame, *by: str) -> DataFrame:
    return alerts.groupBy(*by).agg(F.count("*").alias("n"))


def level_counts(alerts: DataFrame) -> DataFrame:
    """Rows by level, with zero for levels that don't occur."""
    names = alerts.sparkSession.createDataFrame([(x,) for x in LEVELS], "level string")
    return names.join(alerts.groupBy("level").agg(F.count("*").alias("c")), "level", "left").select("level", F.coalesce("c", F.lit(0)).alias("n"))


def bundle(alerts: DataFrame) -> DataFrame:
    """Total, and counts by level, observer and array, in one pass by grouping sets."""
    return (
        alerts.groupingSets([[], ["level"], ["observer"], ["array_id"]], "level", "observer", "array_id")
        .agg(F.grouping_id().alias("g"), F.count("*").alias("n"))
        .select(F.when(F.col("g") == 7, "total").when(F.col("g") == 3, "level").when(F.col("g") == 5, "observer").otherwise("array").alias("part"), F.coalesce("level", "observer", F.col("array_id").cast("string"), F.lit("all")).alias("key"), "n")
    )


def trend(alerts: DataFrame, at: Column, hours: int) -> DataFrame:
    """Counts in buckets that end at a moment: ten minutes up to four hours, else hours, 48 at most.

    A bucket holds its start and not its end; rows after the moment fall into the last.
    """
    width, n = (600, hours * 6) if hours <= 4 else (3600, min(hours, 48))
    spine = alerts.sparkSession.range(n).select(F.col("id").cast("int").alias("bucket"))
    back = F.floor((micros(at) - micros(F.col("ts")) - 1) / (width * 1_000_000))
    own = alerts.select((n - 1 - F.greatest(back, F.lit(0))).cast("int").alias("bucket")).where("bucket >= 0").groupBy("bucket").agg(F.count("*").alias("c"))
    return spine.join(own, "bucket", "left").select("bucket", F.coalesce("c", F.lit(0)).alias("n"))


def summary(alerts: DataFrame) -> DataFrame:
    """Total, errors (critical ones too), and the rest as warnings."""
    errors = F.count_if(F.col("level").isin("error", "critical"))
    return alerts.agg(F.count("*").alias("total"), errors.alias("error_count"), (F.count("*") - errors).alias("warning_count"))


def histogram(alerts: DataFrame, key: str = "array_id") -> DataFrame:
    """Counts of each level by key."""
    return alerts.groupBy(key).agg(*[F.count_if(F.col("level") == x).alias(x) for x in LEVELS])


def worst(alerts: DataFrame) -> DataFrame:
    """By array and observer the worst level, the newest message at it, and when it was last seen at all."""
    rank = level_rank(F.col("level"))
    top = F.max_by(F.struct("level", "message"), F.struct(rank, "ts", "id"))
    status = F.when(F.col("level").isin("error", "critical"), "error").when(F.col("level") == "warning", "warning").otherwise("ok")
    return alerts.groupBy("array_id", "observer").agg(top.alias("t"), F.max("ts").alias("last_seen")).select("array_id", "observer", "t.level", "t.message", "last_seen").withColumn("status", status)


def newest(alerts: DataFrame, n: int, by: Sequence[str] = ("array_id", "observer")) -> DataFrame:
    """The n newest rows of each group, numbered from 1."""
    return alerts.withColumn("rn", F.row_number().over(W.partitionBy(*by).orderBy(F.desc("ts"), F.desc("id")))).where(F.col("rn") <= n)


def latest(alerts: DataFrame, by: Sequence[str] = ("observer",)) -> DataFrame:
    """The row with the largest id of each group, by one aggregation."""
    others = [c for c in alerts.columns if c not in by]
    return alerts.groupBy(*by).agg(F.max_by(F.struct(*others), "id").alias("r")).select(*by, "r.*")


def with_ack_flag(alerts: DataFrame, acks: DataFrame) -> DataFrame:
    seen = acks.select(F.col("alert_id").alias("id")).distinct().withColumn("acked", F.lit(True))
    return alerts.join(seen, "id", "left").withColumn("acked", F.coalesce("acked", F.lit(False)))


def unacknowledged(alerts: DataFrame, acks: DataFrame) -> DataFrame:
    return alerts.join(acks, alerts["id"] == acks["alert_id"], "left_anti")


def missing(ids: DataFrame, alerts: DataFrame) -> DataFrame:
    """Of the ids asked for, those that aren't there."""
    return ids.join(alerts, "id", "left_anti")


def with_category(alerts: DataFrame) -> DataFrame:
    category = F.lit("system")
    for name, observers in CATEGORIES.items():
        category = F.when(F.col("observer").isin(*observers), name).otherwise(category)
    return alerts.withColumn("category", category)


def search(rows: DataFrame, query: str, fields: Sequence[str]) -> DataFrame:
    """Rows in whose fields, joined and lower-cased, each word of the query occurs."""
    hay = F.lower(F.concat_ws(" ", *fields))
    words = query.lower().split()
    return rows.where(reduce(Column.__and__, [hay.contains(w) for w in words])) if words else rows


def top_groups(rows: DataFrame, key: str, n: int) -> DataFrame:
    return rows.groupBy(key).agg(F.count("*").alias("n")).orderBy(F.desc("n"), key).limit(n)


def recovered(before: DataFrame, after: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that had an issue before and have none now."""
    return before.select(*keys).distinct().join(after.select(*keys), list(keys), "left_anti")
