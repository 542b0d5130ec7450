"""Detectors of a host's disks, load, descriptors, swap and connections, and of commands run at intervals.

Each takes readings with a key, ts and id and finds the reasons for which a reading alerts. While there are any, it
alerts each time, as a warning; the first reading without any has recovered. A reading without data has null reasons:
it neither alerts nor ends an alert.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from watchgrid.functions import text
from watchgrid.operators import detectors
from watchgrid.operators.passes import Step, ordered_pass


def number(v: Column, places: int = 1) -> Column:
    return F.format_string(f"%.{places}f", v.cast("double"))


def flagged(readings: DataFrame, by: Sequence[str], reasons: Column) -> DataFrame:
    """Readings with event alert or recovered, alert_level and reasons."""
    held = readings.withColumn("reasons", reasons).where("reasons is not null")
    before = F.lag(F.size("reasons") > 0).over(detectors.ordered(by))
    event = F.when(F.size("reasons") > 0, "alert").when(before, "recovered")
    return held.withColumn("event", event).where("event is not null").withColumn("alert_level", F.when(F.col("event") == "alert", "warning").otherwise("info"))


#: Kinds of file systems and beginnings of places that are passed over.
PASSED_KINDS = ("tmpfs", "devtmpfs", "squashfs", "overlay")
PASSED_PLACES = ("/dev", "/run", "/snap")


def full_disks(readings: DataFrame, by: Sequence[str], mounts: str = "mounts", space: float = 90, inodes: float = 90, kinds: Sequence[str] = PASSED_KINDS, places: Sequence[str] = PASSED_PLACES) -> DataFrame:
    """mounts is an array of (mount, fstype, space, inode), in percent: those at or beyond a limit, space first.

    Those of a kind or place that is passed over don't count; inodes are listed without a kind, so its place decides.
    """
    out_of = lambda m: F.exists(F.array(*[F.lit(p) for p in places]), lambda p: m["mount"].startswith(p)) if places else F.lit(False)
    kept = F.filter(mounts, lambda m: ~out_of(m))
    said = lambda m, what, value, limit: F.concat(m["mount"], F.lit(f": {what} "), number(value, 0), F.lit(f"% >= {limit:g}%"))
    full = F.filter(kept, lambda m: ~F.coalesce(m["fstype"].isin(*kinds), F.lit(False)) & (m["space"] >= space))
    out = F.concat(F.transform(full, lambda m: said(m, "space", m["space"], space)), F.transform(F.filter(kept, lambda m: m["inode"] >= inodes), lambda m: said(m, "inodes", m["inode"], inodes)))
    return flagged(readings, by, F.when(F.size(mounts) > 0, out))


def loaded(readings: DataFrame, by: Sequence[str], loads: Sequence[str] = ("load1", "load5", "load15"), cores: str = "cores", times: float = 2) -> DataFrame:
    """Loads of one, five and fifteen minutes beyond so many times the cores; one of them is enough."""
    limit = F.col(cores) * times
    one = lambda name, minutes: F.when(F.col(name) > limit, F.concat(F.lit(f"load of {minutes} min "), number(F.col(name), 2), F.lit(" > "), number(limit)))
    return flagged(readings, by, F.when(F.col(loads[0]).isNotNull(), F.array_compact(F.array(*[one(n, m) for n, m in zip(loads, (1, 5, 15))]))))


def used_up(readings: DataFrame, by: Sequence[str], used: Column, total: Column, limit: float, what: str, none: bool) -> DataFrame:
    """A share in percent at or beyond a limit. Where the total is zero, none says whether there is nothing to judge
    (swap that isn't set up) rather than a share of zero."""
    share = F.when(total > 0, used / total * 100).otherwise(F.lit(None).cast("double") if none else F.lit(0.0))
    held = readings.withColumn("share", share)
    reasons = F.when(F.col("share") >= limit, F.array(F.concat(F.lit(f"{what} "), number(F.col("share")), F.lit(f"% >= {limit:g}%")))).otherwise(F.array().cast("array<string>"))
    return flagged(held, by, F.when(F.col("share").isNotNull(), reasons))


def descriptors(readings: DataFrame, by: Sequence[str], limit: float = 80) -> DataFrame:
    """allocated, free and most of file descriptors: the used share."""
    return used_up(readings, by, F.col("allocated") - F.col("free"), F.col("most"), limit, "descriptors", none=False)


def swap(readings: DataFrame, by: Sequence[str], limit: float = 50) -> DataFrame:
    """swap_total and swap_free: the used share; a host without swap isn't judged."""
    return used_up(readings, by, F.col("swap_total") - F.col("swap_free"), F.col("swap_total"), limit, "swap", none=True)


def connections(readings: DataFrame, by: Sequence[str], states: str = "states", waiting: int = 10_000, established: int = 5_000) -> DataFrame:
    """states maps a state of TCP connections to its number, under either tool's names: those beyond a limit."""
    count = lambda *names: sum((F.coalesce(F.try_element_at(states, F.lit(n)), F.lit(0)) for n in names), F.lit(0))
    one = lambda what, n, limit: F.when(n > limit, F.concat(F.lit(f"{what} "), n.cast("string"), F.lit(f" > {limit}")))
    found = F.array_compact(F.array(one("TIME_WAIT", count("TIME-WAIT", "TIME_WAIT"), waiting), one("ESTABLISHED", count("ESTAB", "ESTABLISHED"), established)))
    return flagged(readings, by, F.when(F.col(states).isNotNull(), found))


# Commands


def due(interval: str) -> Step:
    """Whether a command runs at each poll: its interval, in seconds in that column, has passed since it last ran."""

    def step(ran: int | None, us: np.ndarray, seen: dict[str, np.ndarray]) -> tuple[np.ndarray, int | None]:
        out, wait = np.zeros(len(us), bool), (seen[interval].astype(float) * 1_000_000).astype(np.int64).tolist()
        for k, at in enumerate(us.tolist()):
            if ran is None or at - ran >= wait[k]:
                out[k], ran = True, at
        return out, ran

    return step


def command_alerts(name: Column, exit_code: Column, fields: Column, conditions: Sequence[tuple[str, str, str, bool]]) -> Column:
    """What one run says: that it failed, or each condition (field, operator, operand, on missing) that holds.

    fields is a map of what was parsed; a missing field counts only where its condition says so.
    """
    value = lambda f: F.try_element_at(fields, F.lit(f))
    one = lambda f, op, operand, missing: F.when(value(f).isNull(), F.concat(name, F.lit(f": no field '{f}'")) if missing else F.lit(None)).when(text.holds(value(f), op, operand), F.concat(name, F.lit(f": {f}="), value(f), F.lit(f" ({op} {operand})")))
    held = F.array_compact(F.array(*[one(*c) for c in conditions])) if conditions else F.array().cast("array<string>")
    return F.when(exit_code != 0, F.array(F.concat(name, F.lit(" failed ("), exit_code.cast("string"), F.lit(")")))).otherwise(held)


def polled(polls: DataFrame, by: Sequence[str], command: str, alerts: Column, interval: str = "interval_s") -> DataFrame:
    """polls with ran, and the alerts of the command's last run: a poll before its interval is up says what that said."""
    key = [*by, command]
    held = ordered_pass(polls, key, due(interval), "ran", T.BooleanType(), (interval,))
    last = F.last(F.when(F.col("ran"), F.struct(alerts.alias("a"))), ignorenulls=True).over(detectors.ordered(key).rowsBetween(W.unboundedPreceding, 0))
    return held.withColumn("alerts", last["a"])


def rounds(found: DataFrame, by: Sequence[str], command: str, most: int = 3) -> DataFrame:
    """Of polls of several commands at one time those that alert: the first few alerts in order of command, and their number."""
    each = found.groupBy(*by, "ts").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(command, "id", "alerts"))), lambda x: x["alerts"])).alias("all")).where(F.size("all") > 0)
    message = F.concat(F.array_join(F.slice("all", 1, most), "; "), F.when(F.size("all") > most, F.concat(F.lit(" ("), F.size("all").cast("string"), F.lit(")"))).otherwise(""))
    return each.select(*by, "ts", message.alias("message"), F.size("all").alias("n"))


def monitored(runs: DataFrame, by: Sequence[str], value: Column, operator: str, operand: str, template: str, name: str = "monitor", n: int = 1, cooldown: float = 0, **values: Column) -> DataFrame:
    """A monitor as a whole: its value is extracted from a run's output, its condition judged, counted in a row,
    cooled down, and a message made of its template; without one, or if that comes out blank, it says what was met."""
    held = runs.withColumn("value", value)
    held = held.withColumn("met", text.condition(F.col("value"), F.col("value").isNotNull(), operator, operand))
    fired = detectors.consecutive_gate(held, by, "met", n, cooldown).drop("met")
    said = text.rendered(template, value=F.coalesce("value", F.lit("")), **values)
    return fired.withColumn("message", F.when(F.trim(said) != "", said).otherwise(f"{name}: condition {operator} met"))
