"""Exact medians of groups of any size, without sorting or buffering a large one."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from watchgrid.scratch import written

#: Rows up to which a group's median is Spark's own, which holds the group's values; and the bins of a round.
SMALL, BINS = 100_000, 4096


def medians(rows: DataFrame, by: Sequence[str], value: str, weight: str | None = None, small: int = SMALL, bins: int = BINS) -> DataFrame:
    """by and median of each group's values that aren't null; a row counts weight times. Values are finite.

    A large group's middle ranks are found by histograms: values between bounds are counted by bins of equal width,
    the bin that holds the rank has the bounds of the next round, and a round ends a rank when its bin's smallest and
    largest value are one. Counts are combined before their shuffle, so a round sends some thousand rows a task and
    group however large the group is. Bounds shrink by the number of bins each time; a few rounds do.
    """
    by = list(by)
    held = rows.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_v"), (F.col(weight).cast("long") if weight else F.lit(1).cast("long")).alias("_w"))
    sizes = written(held.groupBy(*by).agg(F.sum("_w").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")), "sizes")
    large = sizes.where(F.col("_n") > small)
    if large.isEmpty():
        return held.groupBy(*by).agg(F.expr("percentile(_v, 0.5, _w)").alias("median"))
    few = held.join(sizes.where(F.col("_n") <= small).select(*by), by, "left_semi").groupBy(*by).agg(F.expr("percentile(_v, 0.5, _w)").alias("median"))
    many = selected(held.join(large.select(*by), by, "left_semi"), large, by, bins)
    return few.unionByName(many)


def selected(held: DataFrame, groups: DataFrame, by: list[str], bins: int) -> DataFrame:
    """Medians of groups (by, _n, _lo, _hi) of held (by, _v, _w)."""
    ranks = F.array_distinct(F.array(F.expr("(_n - 1) div 2"), F.expr("_n div 2")))
    open_ = written(groups.select(*by, F.explode(ranks).alias("_r"), F.lit(0).cast("long").alias("_below"), "_lo", "_hi"), "ranks")
    done = open_.where("_lo = _hi").select(*by, "_r", F.col("_lo").alias("_v"))
    # bounds far apart are cut by powers of two, near ones evenly: few rounds, however the values are spread
    power = lambda v: F.when(v == 0, 0.0).otherwise(F.signum(v) * (F.log2(F.abs(v)) + 1100))
    v, low, high = F.col("_v"), F.col("_lo"), F.col("_hi")
    wide = power(high) - power(low)
    share = F.when(wide > 1.5, (power(v) - power(low)) / wide).otherwise(F.try_divide(v - low, high - low))
    before = W.partitionBy(*by, "_r").orderBy("_bin").rowsBetween(W.unboundedPreceding, -1)
    while not (rest := open_.where("_lo < _hi")).isEmpty():
        inside = held.join(rest, by).where("_v between _lo and _hi").withColumn("_bin", F.least(F.floor(share * bins), F.lit(bins - 1)))
        counts = inside.groupBy(*by, "_r", "_below", "_bin").agg(F.sum("_w").alias("_c"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
        placed = counts.withColumn("_below", F.col("_below") + F.coalesce(F.sum("_c").over(before), F.lit(0)))
        open_ = written(placed.where("_below <= _r and _r < _below + _c").select(*by, "_r", "_below", "_lo", "_hi"), "ranks")
        done = done.unionByName(open_.where("_lo = _hi").select(*by, "_r", F.col("_lo").alias("_v")))
    return done.groupBy(*by).agg(F.avg("_v").alias("median"))
