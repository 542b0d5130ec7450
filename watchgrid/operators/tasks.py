"""Test windows, snapshots and the timeline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from watchgrid.schema import micros
from watchgrid.scratch import written


#: Lengths of the time cells that windows are cut into, in microseconds: an hour, and eight times more each.
CELLS = tuple(3_600_000_000 * 8**k for k in range(5))


def window_cells(start: Column, end: Column) -> Column:
    """The cells (size, cell) of a window from start to end in microseconds: those wholly inside that no larger such
    cell covers, and of the smallest those at its edges. There are some dozen of them, however long the window is
    short of the largest cell."""
    longs = lambda low, high: F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<bigint>"))
    first = lambda s: F.ceil(start / s).cast("long")
    last = lambda s: (F.floor((end + 1) / s) - 1).cast("long")
    out = []
    for k, size in enumerate(CELLS):
        low, high = first(size), last(size)
        cells = longs(low, high)
        if k + 1 < len(CELLS):
            inner_low, inner_high = first(CELLS[k + 1]) * 8, last(CELLS[k + 1]) * 8 + 7
            cells = F.when(inner_low <= inner_high, F.concat(longs(low, inner_low - 1), longs(inner_high + 1, high))).otherwise(cells)
        if not k:
            edges = F.array_distinct(F.array(F.floor(start / size).cast("long"), F.floor(end / size).cast("long")))
            cells = F.concat(cells, F.filter(edges, lambda c: (c < low) | (c > high)))
        out.append(sized(cells, size))
    return F.concat(*out)


def sized(cells: Column, size: int) -> Column:
    return F.transform(cells, lambda c: F.struct(F.lit(size).alias("size"), c.alias("cell")))


def within(alerts: DataFrame, tasks: DataFrame) -> DataFrame:
    """Each alert with each task whose window holds it and whose arrays, if any are named, hold its array.

    Windows are cut into cells of several lengths, large ones inside and small ones at the edges, and joined to the
    cells of each alert, by array too for windows that name arrays. Only alerts in an edge's cell are looked at in
    vain, so the work follows the result, however many windows overlap. A window that is still open runs to the last
    alert, which is looked up as one number.
    """
    last = alerts.agg(F.max("ts").alias("_last"))
    end = F.coalesce(F.col("ended_at"), F.greatest("_last", "started_at"))
    cut = tasks.join(F.broadcast(last)).where(F.col("started_at") <= end)
    cut = cut.withColumn("_c", F.explode(window_cells(micros(F.col("started_at")), micros(end)))).drop("_last")
    at = micros(F.col("ts"))
    cells = F.array(*[F.struct(F.lit(s).alias("size"), F.floor(at / s).cast("long").alias("cell")) for s in CELLS])
    held = alerts.withColumn("_c", F.explode(cells))
    every = held.join(cut.where(F.size("array_ids") == 0), "_c")
    named = held.join(cut.where(F.size("array_ids") > 0).withColumn("array_id", F.explode(F.array_distinct("array_ids"))), ["array_id", "_c"])
    inside = (F.col("ts") >= F.col("started_at")) & (F.col("ended_at").isNull() | (F.col("ts") <= F.col("ended_at")))
    columns = [*alerts.columns, *tasks.columns]
    return every.select(columns).unionByName(named.select(columns)).where(inside)


def summed(alerts: DataFrame, tasks: DataFrame, n: str, slice_us: int = CELLS[3]) -> DataFrame:
    """task_id and n, the sum of n over the alerts that within() gives a task; tasks without alerts are left out.

    No alert meets a window: what an array's alerts come to before the window's end, less what they come to before its
    start, is looked up. Such sums run within slices of time, and each slice begins with the sum of those before it. A
    window without arrays is looked up among the alerts of all arrays. n must not be negative, as counts are not.
    """
    last = alerts.agg(F.max("ts").alias("_last"))
    end = F.coalesce(F.col("ended_at"), F.greatest("_last", "started_at"))
    cut = tasks.join(F.broadcast(last)).where(F.col("started_at") <= end)
    every = F.size("array_ids") == 0
    arrays = F.when(every, F.array(F.lit(0).cast("bigint"))).otherwise(F.array_compact(F.array_distinct("array_ids")))
    marks = F.array(F.struct(micros(F.col("started_at")).alias("at"), F.lit(-1).alias("sign")), F.struct((micros(end) + 1).alias("at"), F.lit(1).alias("sign"))).cast("array<struct<at:bigint,sign:int>>")
    looked = cut.select("task_id", every.alias("every"), F.explode(arrays).alias("array_id"), marks.alias("m")).select("task_id", "every", "array_id", F.inline("m"))
    key = ["every", "array_id"]
    own = alerts.where("array_id is not null and ts is not null").select(F.lit(False).alias("every"), F.col("array_id").cast("bigint").alias("array_id"), micros(F.col("ts")).alias("at"), F.col(n).alias("n"))
    of_all = alerts.where("ts is not null").select(F.lit(True).alias("every"), F.lit(0).cast("bigint").alias("array_id"), micros(F.col("ts")).alias("at"), F.col(n).alias("n"))
    points = looked.select(*key, "at", F.lit(0).cast("bigint").alias("n")).unionByName(own).unionByName(of_all)
    points = written(points.groupBy(*key, "at").agg(F.sum("n").alias("n")).withColumn("slice", F.expr(f"at div {int(slice_us)}")), "points")
    past = lambda by, order: F.coalesce(F.sum("n").over(W.partitionBy(*by).orderBy(order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    begun = points.groupBy(*key, "slice").agg(F.sum("n").alias("n")).select(*key, "slice", past(key, "slice").alias("begun"))
    sums = points.select(*key, "slice", "at", past([*key, "slice"], "at").alias("within")).join(begun, [*key, "slice"])
    sums = sums.select(*key, "at", (F.col("begun") + F.col("within")).alias("before"))
    return looked.join(sums, [*key, "at"]).groupBy("task_id").agg(F.sum(F.col("sign") * F.col("before")).alias("n")).where("n > 0")


def summaries(alerts: DataFrame, tasks: DataFrame, expected: tuple[str, ...] = ()) -> DataFrame:
    """For each task its alerts by level, those of observers it expects, and its length; tasks without alerts too."""
    count = lambda c, name: F.count_if(c).alias(name)
    found = within(alerts, tasks).groupBy("task_id").agg(
        F.count("*").alias("total"), count(F.col("level") == "critical", "critical"), count(F.col("level") == "error", "error"), count(F.col("level") == "warning", "warning"), count(F.col("level") == "info", "info"), count(F.col("observer").isin(*expected) if expected else F.lit(False), "expected")
    )
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("total", "critical", "error", "warning", "info", "expected")}
    hours = F.timestamp_diff("HOUR", F.col("started_at"), F.col("ended_at"))
    return tasks.join(found, "task_id", "left").withColumns(zero).select("task_id", "name", "total", "critical", "error", "warning", "info", "expected", (F.col("total") - F.col("expected")).alias("unexpected"), hours.alias("hours"))


def snapshot(alerts: DataFrame, by: str = "array_id") -> DataFrame:
    """The alert with the largest id of each array's observer."""
    return alerts.groupBy(by, "observer").agg(F.max_by(F.struct("level", "message"), "id").alias("s")).select(by, "observer", "s.*")


def diff(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """What was added, removed, or changed in level or message between two snapshots."""
    a = before.select(*keys, F.col("level").alias("old_level"), F.col("message").alias("old_message"), F.lit(True).alias("was"))
    b = after.select(*keys, F.col("level").alias("new_level"), F.col("message").alias("new_message"), F.lit(True).alias("is"))
    kind = F.when(F.col("was").isNull(), "added").when(F.col("is").isNull(), "removed").when((F.col("old_level") != F.col("new_level")) | (F.col("old_message") != F.col("new_message")), "changed")
    return a.join(b, keys, "full").withColumn("change", kind).where("change is not null").drop("was", "is")


def conflicts(wanted: DataFrame, locks: DataFrame, key: str = "array_id") -> DataFrame:
    """Each wanted key and whether it can be had."""
    held = locks.select(key).distinct().withColumn("locked", F.lit(True))
    return wanted.join(held, key, "left").select(key, F.col("locked").isNull().alias("available"))
