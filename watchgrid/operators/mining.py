"""Baselines and causal rules kept up by periods instead of mined anew: partials of each period that add up.

A period's alerts are read once. Metrics leave counts of their values by day. Episodes leave counts of their pairs and
observers by the day of their last alert, once no later alert can belong to them; the alerts of those still open at
the period's end are kept and join the next period's. What 30 days say is the sum of their partials, plus the open
episodes as they stand, and equals what mining all of those alerts anew says.

A period writes folders of its own, run=..., which a rerun writes again: it changes nothing.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from watchgrid.operators import baseline, episodes, ranks
from watchgrid.schema import micros, once
from watchgrid.scratch import written

BY = ["array_id", "observer", "metric"]


def value_counts(points: DataFrame, by: list[str] = BY, value: str = "metric_value") -> DataFrame:
    """day, by, value and n of points."""
    return points.where(F.col(value).isNotNull()).groupBy(F.to_date("ts").alias("day"), *by, F.col(value).alias("value")).agg(F.count("*").alias("n"))


def learned(partials: DataFrame, by: list[str] = BY, least: int = 3, small: int = ranks.SMALL) -> DataFrame:
    """baseline.learn() from value counts of any number of days."""
    held = partials.groupBy(*by, "value").agg(F.sum("n").alias("n"))
    means = held.groupBy(*by).agg(F.sum("n").alias("total"), (F.sum(F.col("n") * F.col("value")) / F.sum("n")).alias("mean")).where(F.col("total") >= least)
    spread = held.join(means, by).groupBy(*by).agg(F.first("total").alias("total"), F.sqrt(F.sum(F.col("n") * F.pow(F.col("value") - F.col("mean"), 2)) / (F.first("total") - 1)).alias("deviation"))
    return spread.join(ranks.medians(held, by, "value", "n", small), by).select(*by, F.col("total").alias("n"), "median", "deviation")


def episode_counts(alerts: DataFrame, gap_seconds: float, by: str = "array_id") -> DataFrame:
    """by, day, antecedent, consequent, n and lag_us of the pairs of alerts' episodes; consequent null counts the
    episodes that hold the antecedent. The day is that of an episode's last alert."""
    return counted(episodes.split(alerts, gap_seconds, by), by)


def counted(split: DataFrame, by: str = "array_id") -> DataFrame:
    """episode_counts() of alerts with their episode. An episode's observers are put in order in one array, which stays
    within their number, and each goes alone and with those after it."""
    first = split.groupBy(by, "episode", "observer").agg(F.min(F.struct("ts", "id")).alias("f"), F.max("ts").alias("last"))
    row = F.struct(F.col("f.ts").alias("ts"), F.col("f.id").alias("id"), "observer", micros(F.col("f.ts")).alias("us"))
    each = first.groupBy(by, "episode").agg(F.to_date(F.max("last")).alias("day"), F.array_sort(F.collect_list(row)).alias("o"))
    said = lambda a, b, lag: F.struct(a["observer"].alias("antecedent"), b.cast("string").alias("consequent"), lag.cast("long").alias("lag"))
    single = F.transform("o", lambda a: said(a, F.lit(None), F.lit(0)))
    double = F.flatten(F.transform("o", lambda a, i: F.transform(F.slice("o", i + 2, F.size("o")), lambda b: said(a, b["observer"], b["us"] - a["us"]))))
    held = once(each.select(by, "day", F.concat(single, double).alias("p")), "p").select(by, "day", F.explode("p").alias("p"))
    return held.groupBy(by, "day", "p.antecedent", "p.consequent").agg(F.count("*").alias("n"), F.sum("p.lag").alias("lag_us"))


def rules(partials: DataFrame, min_count: int = 2, min_confidence: float = 0.15, by: str = "array_id") -> DataFrame:
    """episodes.rules() from episode counts."""
    held = partials.groupBy(by, "antecedent", "consequent").agg(F.sum("n").alias("n"), F.sum("lag_us").alias("lag_us"))
    single = held.where("consequent is null").select(by, "antecedent", F.col("n").alias("episodes"))
    found = held.where(F.col("consequent").isNotNull() & (F.col("n") >= min_count)).join(single, [by, "antecedent"]).withColumn("c", F.col("n") / F.col("episodes"))
    lag = F.round(F.col("lag_us") / F.col("n") / 1_000_000, 2)
    return found.where(F.col("c") >= min_confidence).select(by, "antecedent", "consequent", "n", lag.alias("avg_lag_s"), F.round("c", 3).alias("confidence"))


class Store:
    """The partials at a path, for alerts (id, array_id, observer, details, ts)."""

    def __init__(self, spark: SparkSession, path: str, gap_seconds: float = 60):
        self.spark, self.path, self.gap = spark, path, gap_seconds

    def _name(self, kind: str, end: datetime) -> str:
        return f"{self.path}/{kind}/run={end:%Y%m%d%H%M%S}"

    def advance(self, alerts: DataFrame, end: datetime, before: datetime | None = None) -> None:
        """Take in a period's alerts, which ends at end; before is the end of the period before it, if there is one."""
        value_counts(baseline.metric_points(alerts)).write.mode("overwrite").parquet(self._name("values", end))
        held = alerts.select("array_id", "observer", "ts", "id").where("ts is not null")
        if before is not None:
            held = held.unionByName(self.spark.read.parquet(self._name("open", before)))
        last = F.lit(end).cast("timestamp_ntz")
        # an episode is open if an alert at the period's end would still belong to it
        until = F.max("ts").over(W.partitionBy("array_id", "episode"))
        split = episodes.split(held, self.gap).withColumn("open", micros(last) - micros(until) <= int(self.gap * 1_000_000))
        split = written(split, "split")
        split.where("open").select("array_id", "observer", "ts", "id").write.mode("overwrite").parquet(self._name("open", end))
        counted(split.where("not open")).write.mode("overwrite").parquet(self._name("episodes", end))

    def _days(self, kind: str, end: datetime, days: int) -> DataFrame:
        runs = self.spark.read.parquet(f"{self.path}/{kind}").where(F.col("run").cast("string") <= f"{end:%Y%m%d%H%M%S}")
        return within(runs.drop("run"), end, days)

    def baselines(self, end: datetime, days: int = 30) -> DataFrame:
        return learned(self._days("values", end, days))

    def rules(self, end: datetime, days: int = 30) -> DataFrame:
        still = episode_counts(self.spark.read.parquet(self._name("open", end)), self.gap)
        return rules(self._days("episodes", end, days).unionByName(within(still, end, days)))


def within(rows: DataFrame, end: datetime, days: int) -> DataFrame:
    """Rows of the last so many days before end, by their day."""
    return rows.where((F.col("day") < F.lit(end).cast("timestamp_ntz")) & (F.col("day") >= F.date_sub(F.to_date(F.lit(end).cast("timestamp_ntz")), days)))
