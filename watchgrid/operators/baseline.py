"""Adaptive baselines: metrics out of alerts, their usual range, and what lies beyond it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from watchgrid.schema import once

#: Numbers that a disk's first item may have.
DISK_FIELDS = ("reallocated_sectors", "current_pending", "offline_uncorrectable", "value")


def metrics(observer: Column, details: Column) -> Column:
    """Metrics in an alert's details by its observer, as a map; details that are no JSON object give none.

    Of two spellings of a field the first that is there and not zero counts.
    """
    raw = lambda path: F.get_json_object(details, path)
    # a number, not a number in quotes
    number = lambda v: F.when(v.rlike(r"^-?[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?$"), v.try_cast("double"))
    either = lambda *paths: F.coalesce(*[F.nullif(number(raw(p)), F.lit(0.0)) for p in paths])
    ports = F.map_values(F.from_json(raw("$.port_counters"), "map<string,map<string,double>>"))
    total = F.aggregate(F.flatten(F.transform(F.filter(ports, lambda m: m.isNotNull()), lambda m: F.map_values(m))), F.lit(0.0), lambda a, v: a + F.coalesce(v, F.lit(0.0)))
    listed = lambda path: F.json_array_length(raw(path))
    item = F.when(raw("$.alerts").isNotNull(), raw("$.alerts[0]")).otherwise(raw("$.items[0]"))
    found = {
        "error_code": {"error_count": F.when(total > 0, total)},
        "cpu_usage": {"cpu_percent": either("$.current_usage_percent", "$.cpu_usage", "$.current_percent")},
        "memory_leak": {"rss_mb": F.coalesce(number(raw("$.current_rss_mb")), number(raw("$.current_used_mb"))), "rss_growth_per_hour": number(raw("$.rss_growth_mb_per_hour"))},
        "card_info": {"card_flag_count": F.when(raw("$.alerts").isNull(), F.when(raw("$").startswith("{"), 0.0)).otherwise(listed("$.alerts").cast("double"))},
        "disk_smart": {k: number(F.get_json_object(item, f"$.{k}")) for k in DISK_FIELDS},
    }
    out = F.create_map().cast("map<string,double>")
    for name, values in found.items():
        made = F.map_from_arrays(F.array(*[F.lit(k) for k in values]), F.array(*values.values()))
        out = F.when(observer == name, made).otherwise(out)
    return F.map_filter(out, lambda _, v: v.isNotNull())


def metric_points(alerts: DataFrame) -> DataFrame:
    """A row for each metric of each alert, with its name and value."""
    held = once(alerts.withColumn("_m", metrics(F.col("observer"), F.col("details"))), "_m")
    return held.select(*alerts.columns, F.explode("_m").alias("metric", "metric_value"))


def learn(points: DataFrame, by: list[str], value: str = "value", least: int = 3) -> DataFrame:
    """Median and sample deviation of each group of at least so many points."""
    return points.where(F.col(value).isNotNull()).groupBy(*by).agg(F.count("*").alias("n"), F.median(value).alias("median"), F.stddev_samp(value).alias("deviation")).where(F.col("n") >= least)


def judged(points: DataFrame, learned: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """points with status: no_baseline, anomalous beyond median + 3 deviations, else normal."""
    held = points.join(learned.select(*by, "median", "deviation"), by, "left")
    status = F.when(F.col("median").isNull(), "no_baseline").when(F.col(value) > F.col("median") + 3 * F.col("deviation"), "anomalous").otherwise("normal")
    return held.withColumn("status", status).drop("median", "deviation")


def alert_status(points: DataFrame, learned: DataFrame, by: list[str], deviations: float = 3.0) -> DataFrame:
    """For each alert of metric_points(): no_baseline if none of its metrics has one, anomalous if any lies beyond."""
    held = points.join(learned.select(*by, "median", "deviation"), by, "left")
    beyond = F.max((F.col("metric_value") > F.col("median") + deviations * F.col("deviation")).cast("int"))
    return held.groupBy("id").agg(F.when(F.count("median") == 0, "no_baseline").when(beyond == 1, "anomalous").otherwise("normal").alias("status"))


def spikes(points: DataFrame, by: list[str], history: int = 5, percent: float = 50.0, value: str = "value") -> DataFrame:
    """Points that exceed the mean of the points before them by more than so many percent; a zero mean is no spike."""
    before = W.partitionBy(*by).orderBy("ts", "id").rowsBetween(-history, -1)
    held = points.withColumn("mean", F.avg(value).over(before))
    rise = F.when(F.col("mean") != 0, (F.col(value) - F.col("mean")) / F.col("mean") * 100)
    return held.withColumn("rise", rise).where(F.col("rise") > percent)


def last_known(points: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """The newest value that isn't null of each column."""
    return points.groupBy(*by).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.struct("ts", "id"))).alias(c) for c in columns])
