"""Stateful detectors over keyed readings, as window plans: four families that the observers share.

A reading is a row with a key, ts, id and a value or state. Each family returns the rows that alert.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from watchgrid.operators.passes import cooldown, gate, ordered_pass
from watchgrid.schema import LEVELS, level_rank, micros

RESET = 10_000_000


def ordered(by: Sequence[str]) -> WindowSpec:
    return W.partitionBy(*by).orderBy("ts", "id")


def delta(readings: DataFrame, by: Sequence[str], value: str, threshold: float = 0, reset: float = RESET) -> DataFrame:
    """Counters that grew by more than threshold; the first reading is silent, and a growth beyond reset is one."""
    grown = F.col(value) - F.lag(value).over(ordered(by))
    return readings.withColumn("delta", grown).where((F.col("delta") > threshold) & (F.col("delta") <= reset))


def rate(readings: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """readings with the growth of a counter per second; null at first, at no time passed, and after a reset."""
    order = ordered(by)
    seconds = (micros(F.col("ts")) - micros(F.lag("ts").over(order))) / 1_000_000
    grown = F.col(value) - F.lag(value).over(order)
    return readings.withColumn("s", seconds).withColumn("rate", F.when((F.col("s") > 0) & (grown >= 0), grown / F.col("s"))).drop("s")


def change(readings: DataFrame, by: Sequence[str], state: str, down: Sequence[str] | None = None, bad: Sequence[str] = ()) -> DataFrame:
    """Readings whose state differs from the one before; with down, those that enter one of these states.

    A reading in a bad state alerts whether or not it changed, the first one too; case doesn't matter.
    """
    before = F.lag(state).over(ordered(by))
    differs = F.col(state) != F.col("previous")
    if down:
        differs = differs & F.col(state).isin(*down)
    if bad:
        differs = F.coalesce(differs, F.lit(False)) | F.lower(state).isin(*bad)
    return readings.withColumn("previous", before).where(differs)


#: States that alert in each cycle, and those of a disk that make an error of it.
CONTROLLER_BAD = ("offline", "degraded", "fault", "absent")
DISK_BAD = ("offline", "fault", "failed", "degraded", "rebuilding", "absent")
DISK_ERROR = ("offline", "fault", "failed")


def controllers(readings: DataFrame, by: Sequence[str] = ("array_id", "unit"), state: str = "state") -> DataFrame:
    """Controllers that changed or are in a bad state, as errors."""
    return change(readings, by, state, bad=CONTROLLER_BAD).withColumn("level", F.lit("error"))


def disks(readings: DataFrame, by: Sequence[str] = ("array_id", "unit"), state: str = "state", cycle: Sequence[str] = ("array_id", "ts")) -> DataFrame:
    """Disks that changed or are in a bad state; all of a cycle are errors if one of them is off, at fault or failed."""
    found = change(readings, by, state, bad=DISK_BAD)
    worst = F.max(F.lower(state).isin(*DISK_ERROR)).over(W.partitionBy(*cycle))
    return found.withColumn("level", F.when(worst, "error").otherwise("warning"))


def vanished(before: DataFrame, after: DataFrame, keys: Sequence[str]) -> DataFrame:
    return before.join(after.select(*keys), list(keys), "left_anti")


def hysteresis(readings: DataFrame, by: Sequence[str], value: str, threshold: float, count: int = 1) -> DataFrame:
    """Each reading's event: enter at the count-th in a row at or beyond threshold, stay, recovered once below.

    Readings not in alert have no event and are left out.
    """
    order = ordered(by)
    held = readings.withColumn("high", F.col(value) >= threshold)
    held = held.withColumn("turns", (F.coalesce(F.lag("high").over(order), F.lit(False)) != F.col("high")).cast("int"))
    held = held.withColumn("island", F.sum("turns").over(order))
    held = held.withColumn("streak", F.row_number().over(W.partitionBy(*by, "island").orderBy("ts", "id")))
    before = F.lag(F.when(F.col("high"), F.col("streak")).otherwise(0)).over(order)
    event = F.when(F.col("high") & (F.col("streak") == count), "enter").when(F.col("high") & (F.col("streak") > count), "stay").when(~F.col("high") & (before >= count), "recovered")
    return held.withColumn("event", event).where("event is not null").drop("turns", "island", "high")


def rolling_all(readings: DataFrame, by: Sequence[str], flag: Column, n: int) -> DataFrame:
    """Readings that end n or more in a row with the flag."""
    frame = ordered(by).rowsBetween(-(n - 1), 0)
    held = readings.withColumn("all", F.min(flag.cast("int")).over(frame)).withColumn("seen", F.count("*").over(frame))
    return held.where((F.col("all") == 1) & (F.col("seen") == n)).drop("all", "seen")


def streaks(readings: DataFrame, by: Sequence[str], flag: Column) -> DataFrame:
    """The longest run of rows with the flag, by key."""
    order = ordered(by)
    held = readings.withColumn("flag", flag).withColumn("others", F.sum(F.when(F.col("flag"), 0).otherwise(1)).over(order))
    runs = held.where("flag").groupBy(*by, "others").agg(F.count("*").alias("n"))
    return runs.groupBy(*by).agg(F.max("n").alias("longest"))


def leak(readings: DataFrame, by: Sequence[str], value: str, enter: int = 8, leave: int = 3) -> DataFrame:
    """Readings within a leak: it begins when the last enter readings rose strictly, and ends when the last leave fell.

    Ends and beginnings have different tests, so the state at a reading is that of the last reading which met
    either.
    """
    order = ordered(by)
    held = readings.withColumn("step", F.signum(F.col(value) - F.lag(value).over(order)))
    rising = F.min((F.col("step") > 0).cast("int")).over(order.rowsBetween(-(enter - 2), 0)) == 1
    falling = F.min((F.col("step") < 0).cast("int")).over(order.rowsBetween(-(leave - 2), 0)) == 1
    place = F.row_number().over(order)
    held = held.withColumn("place", place).withColumn("sign", F.when(rising & (F.col("place") >= enter), 1).when(falling & (F.col("place") >= leave), 0))
    held = held.withColumn("in_leak", F.last("sign", ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, 0)))
    return held.where("in_leak = 1").drop("step", "place", "sign", "in_leak")


def cpu_usage(total: Column, idle: Column, by: Sequence[str]) -> Column:
    """Usage in percent from two readings of tick counters, between 0 and 100."""
    order = ordered(by)
    ticks, quiet = total - F.lag(total).over(order), idle - F.lag(idle).over(order)
    return F.when(ticks > 0, F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100 * (ticks - quiet) / ticks)))


def rebooted(readings: DataFrame, by: Sequence[str], uptime: str, slack: float = 60) -> DataFrame:
    before = F.lag(uptime).over(ordered(by))
    return readings.withColumn("previous", before).where(F.col(uptime) < F.col("previous") - slack)


def level_of(value: Column, *limits: tuple[float, str]) -> Column:
    """The name of the highest limit that the value reaches, else ok."""
    out = F.lit("ok")
    for limit, name in sorted(limits):
        out = F.when(value >= limit, name).otherwise(out)
    return out


def cooled(reports: DataFrame, by: Sequence[str], seconds: float) -> DataFrame:
    """Reports that go out: none within so many seconds of the last one that did."""
    return ordered_pass(reports, by, cooldown(seconds), "_goes", T.BooleanType()).where("_goes").drop("_goes")


def reported(alerts: DataFrame, by: Sequence[str] = ("observer", "message"), seconds: float = 300, min_level: str = "info", sticky: str = "sticky") -> DataFrame:
    """Alerts that a reporter sends: of min_level or worse, and cooled by key; a sticky one is sent always.

    What is sent starts the cooldown anew, sticky or not.
    """
    held = alerts.where(level_rank(F.col("level")) >= LEVELS.index(min_level)).withColumn(sticky, F.coalesce(sticky, F.lit(False)))
    return ordered_pass(held, by, cooldown(seconds, sticky), "_goes", T.BooleanType(), (sticky,)).where("_goes").drop("_goes")


def consecutive_gate(checks: DataFrame, by: Sequence[str], flag: str, n: int, seconds: float) -> DataFrame:
    """Checks that fire: the n-th in a row that holds, after which counting starts anew and rests for the cooldown."""
    held = checks.withColumn(flag, F.coalesce(flag, F.lit(False)))
    return ordered_pass(held, by, gate(n, seconds, flag), "_fires", T.BooleanType(), (flag,)).where("_fires").drop("_fires")


def new_lines(before: Column, now: Column, exclude: str | None = None) -> Column:
    """Lines that weren't there before, without those that match exclude."""
    fresh = F.filter(now, lambda x: ~F.array_contains(before, x))
    return F.filter(fresh, lambda x: ~x.rlike(exclude)) if exclude else fresh


def backoff(failures: Column, interval: float, cap: float) -> Column:
    """Seconds until the next attempt after so many failures in a row."""
    return F.least(F.lit(float(interval)) * F.pow(F.lit(2.0), failures), F.lit(float(cap)))


def failures(runs: DataFrame, by: Sequence[str], failed: Column, log_from: int = 3, alert_every: int = 10) -> DataFrame:
    """Failed runs with their place in the streak: logged as errors from log_from on, alerting at every alert_every-th."""
    order = ordered(by)
    held = runs.withColumn("_failed", F.coalesce(failed, F.lit(False))).withColumn("_others", F.sum((~F.col("_failed")).cast("int")).over(order)).where("_failed")
    held = held.withColumn("streak", F.row_number().over(W.partitionBy(*by, "_others").orderBy("ts", "id")).cast("bigint"))
    return held.withColumn("logged", F.when(F.col("streak") >= log_from, "error").otherwise("warning")).withColumn("alerts", F.col("streak") % alert_every == 0).drop("_failed", "_others")


def latched(readings: DataFrame, by: Sequence[str], value: str, threshold: float, count: int) -> DataFrame:
    """hysteresis() as alerts: an error while it lasts, informative on recovery."""
    return hysteresis(readings, by, value, threshold, count).withColumn("alert_level", F.when(F.col("event") == "recovered", "info").otherwise("error"))


def leveled(readings: DataFrame, by: Sequence[str], value: str, limits: Sequence[tuple[float, str]]) -> DataFrame:
    """Readings at or beyond a limit alert each time, at the highest one's level; the first below all has recovered."""
    held = readings.withColumn("_level", F.nullif(level_of(F.col(value), *limits), F.lit("ok")))
    before = F.lag("_level").over(ordered(by))
    event = F.when(F.col("_level").isNotNull(), "alert").when(before.isNotNull(), "recovered")
    return held.withColumn("event", event).where("event is not null").withColumn("alert_level", F.coalesce("_level", F.lit("info"))).drop("_level")


def sustained_rate(readings: DataFrame, by: Sequence[str], value: str, per_second: float, cycles: int = 3) -> DataFrame:
    """Rates of a counter that exceed a limit in this and all of the last cycles that are known, and the recovery."""
    held = rate(readings, by, value).withColumn("_high", F.coalesce(F.col("rate") > per_second, F.lit(False)).cast("int"))
    held = held.withColumn("_all", F.min("_high").over(ordered(by).rowsBetween(-(cycles - 1), 0)))
    before = F.lag("_all").over(ordered(by))
    event = F.when(F.col("_all") == 1, "alert").when(before == 1, "recovered")
    return held.withColumn("event", event).where("event is not null").drop("_high", "_all")


def fresh_lines(readings: DataFrame, by: Sequence[str], lines: str, exclude: str | None = None, few: int = 5) -> DataFrame:
    """Readings with lines that the one before hadn't: a warning for a few of them, else an error."""
    before = F.coalesce(F.lag(lines).over(ordered(by)), F.array().cast("array<string>"))
    held = readings.withColumn("_before", before).withColumn("fresh", new_lines(F.col("_before"), F.col(lines), exclude)).drop("_before")
    return held.where(F.size("fresh") > 0).withColumn("n", F.size("fresh")).withColumn("alert_level", F.when(F.col("n") <= few, "warning").otherwise("error"))


def boots(readings: DataFrame, by: Sequence[str], uptime: str, slack: float = 60, young: float = 300) -> DataFrame:
    """Reboots, where the uptime fell by more than slack, and first readings that are younger than young."""
    held = readings.withColumn("previous", F.lag(uptime).over(ordered(by)))
    event = F.when(F.col(uptime) < F.col("previous") - slack, "reboot").when(F.col("previous").isNull() & (F.col(uptime) < young), "first boot")
    return held.withColumn("event", event).where("event is not null")
