"""Detectors of ports and links: counters by category, their rollup, link states and bandwidth."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from watchgrid.operators.detectors import RESET, ordered
from watchgrid.schema import LEVELS, level_rank

#: Counters by category.
CATEGORIES = {
    "physical_error": ("rx_crc_errors", "fcs_errors", "rx_frame_errors", "tx_carrier_errors"),
    "drop": ("rx_dropped", "tx_dropped"),
    "fifo_overrun": ("rx_fifo_errors", "tx_fifo_errors", "rx_missed_errors", "rx_overruns", "tx_overruns"),
    "generic_error": ("rx_errors", "tx_errors", "collisions"),
}
#: Counters that a command lists, by the family of the port's id.
LISTED = {
    "0x2": {"generic_error": ("Rx Errors", "Tx Errors", "Collisions"), "drop": ("Rx Dropped", "Tx Dropped")},
    "0x11": {"physical_error": ("LossOfSignal Count", "BadRXChar Count", "LossOfSync Count", "InvalidCRC Count", "ProtocolErr Count", "LinkFail Count", "LinkLoss Count")},
}


def category_of(counter: Column) -> Column:
    out = F.lit("generic_error")
    for name, counters in CATEGORIES.items():
        out = F.when(counter.isin(*counters), name).otherwise(out)
    return out


def counter_alerts(readings: DataFrame, by: Sequence[str] = ("array_id", "port"), threshold: float = 0, rate_threshold: float = 10, reset: float = RESET) -> DataFrame:
    """Counters that grew by more than their category allows: threshold for physical errors, rate_threshold for others.

    readings has by, counter, ts, id and value. The first reading of a counter is silent, a growth beyond reset is a
    restart; physical errors are warnings, others informative.
    """
    category = category_of(F.col("counter"))
    grown = F.col("value") - F.lag("value").over(ordered([*by, "counter"]))
    held = readings.withColumn("category", category).withColumn("delta", grown)
    limit = F.when(F.col("category") == "physical_error", threshold).otherwise(rate_threshold)
    level = F.when(F.col("category") == "physical_error", "warning").otherwise("info")
    return held.where((F.col("delta") > 0) & (F.col("delta") > limit) & (F.col("delta") <= reset)).withColumn("level", level)


def rolled_up(alerts: DataFrame, cycles: DataFrame, by: Sequence[str] = ("array_id",), cycle: str = "cycle", previews: int = 3) -> DataFrame:
    """One event for each cycle with alerts, and one recovery in the first cycle after without.

    cycles has every cycle of each key. An event has its worst level, how many counters it is about, and of each
    category with warnings up to previews messages in order.
    """
    per = alerts.withColumn("rn", F.row_number().over(W.partitionBy(*by, cycle, "category").orderBy("message")))
    warned = (F.max(level_rank(F.col("level"))) >= 1).alias("warned")
    parts = per.groupBy(*by, cycle, "category").agg(F.count("*").alias("n"), warned, F.max(level_rank(F.col("level"))).alias("rank"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("rn") <= previews, F.col("message")))), "; ").alias("preview"))
    said = F.when(F.col("warned"), F.concat_ws(": ", "category", "preview")).otherwise(F.concat_ws(" ", "category", F.col("n").cast("string")))
    one = parts.groupBy(*by, cycle).agg(F.sum("n").alias("n"), F.max("rank").alias("rank"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("category", said.alias("said")))), lambda x: x["said"]), " | ").alias("message"))
    held = cycles.select(*by, cycle).distinct().join(one, [*by, cycle], "left")
    before = F.lag("n").over(W.partitionBy(*by).orderBy(cycle))
    event = F.when(F.col("n").isNotNull(), "alert").when(before.isNotNull(), "recovered")
    level = F.element_at(F.array(*[F.lit(x) for x in LEVELS]), (F.coalesce("rank", F.lit(0)) + 1).cast("int"))
    return held.withColumn("event", event).where("event is not null").select(*by, cycle, "event", level.alias("level"), F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("message", F.lit("")).alias("message"))


def listed_counters(listings: DataFrame, port: str = "port_id", text: str = "text") -> DataFrame:
    """Counters above zero in a command's text, for ports of the families that have any, case aside."""
    entries = []
    for family, categories in LISTED.items():
        for category, names in categories.items():
            for name in names:
                value = F.regexp_extract(text, rf"(?i)\Q{name}\E\s*[=:]\s*(\d+)", 1).try_cast("bigint")
                entries.append(F.when(F.lower(port).startswith(family) & (value > 0), F.struct(F.lit(category).alias("category"), F.lit(name).alias("counter"), value.alias("value"))))
    return listings.withColumn("c", F.explode(F.array_compact(F.array(*entries)))).select(*[c for c in listings.columns if c != text], "c.*").withColumn("level", F.lit("warning"))


#: States of an interface that alert when entered.
DOWN = ("down", "notpresent", "lowerlayerdown")


def link_changes(states: DataFrame, by: Sequence[str] = ("array_id",), ignored: Sequence[str] = ()) -> DataFrame:
    """What changed of each port between cycles: carrier lost or found, a state of DOWN entered, speed lost, port gone.

    states has by, port, cycle, carrier, operstate and speed, all text, one row for each port of a cycle. A port's
    first cycle is silent. A port that had a carrier and isn't in the next cycle of its array is gone.
    """
    cycles = states.select(*by, "cycle").distinct().withColumn("next", F.lead("cycle").over(W.partitionBy(*by).orderBy("cycle")))
    held = states.where(~F.col("port").isin(*ignored)) if ignored else states
    order = W.partitionBy(*by, "port").orderBy("cycle")
    own = held.join(cycles, [*by, "cycle"]).withColumns({f"old_{c}": F.lag(c).over(order) for c in ("carrier", "operstate", "speed")} | {"back": F.lead("cycle").over(order), "came": F.lag("next").over(order)})
    # a port that was away starts anew
    known = F.col("came") == F.col("cycle")
    slower = F.col("speed").try_cast("int") < F.col("old_speed").try_cast("int")
    gone = F.col("next").isNotNull() & (F.col("back").isNull() | (F.col("back") > F.col("next"))) & (F.col("carrier") == "1")
    kinds = F.array(
        F.when(known & (F.col("old_carrier") == "1") & (F.col("carrier") == "0"), F.struct("cycle", F.lit("link down").alias("change"))),
        F.when(known & (F.col("old_carrier") == "0") & (F.col("carrier") == "1"), F.struct("cycle", F.lit("link up").alias("change"))),
        F.when(known & (F.col("old_operstate") != F.col("operstate")) & F.col("operstate").isin(*DOWN), F.struct("cycle", F.concat(F.lit("state "), "operstate").alias("change"))),
        F.when(known & slower, F.struct("cycle", F.lit("slower").alias("change"))),
        F.when(gone, F.struct(F.col("next").alias("cycle"), F.lit("gone").alias("change"))),
    )
    return own.withColumn("k", F.explode(F.array_compact(kinds))).select(*by, "port", "k.cycle", "k.change")


#: Generations of a link by how its speed is written.
SPEEDS = (("gen1|2\\.5gt", 1), ("gen2|5gt|5\\.0gt", 2), ("gen3|8gt|8\\.0gt", 3), ("gen4|16gt|16\\.0gt", 4), ("gen5|32gt|32\\.0gt", 5))


def width_of(text: Column) -> Column:
    return F.coalesce(F.regexp_extract(text, r"x?(\d+)", 1).try_cast("int"), F.lit(0))


def speed_rank(text: Column) -> Column:
    """The generation of a link's speed, 0 for one that isn't known; 2.5GT is none of the 5GT."""
    out = F.lit(0)
    for pattern, rank in reversed(SPEEDS):
        out = F.when(F.lower(text).rlike(rf"(?<![\d.])(?:{pattern})"), rank).otherwise(out)
    return F.coalesce(out, F.lit(0))


def downgrades(links: DataFrame, by: Sequence[str] = ("array_id", "device")) -> DataFrame:
    """links (by, ts, id, width, speed, cap_width, cap_speed) with kinds, an array of what each reading fell short of:
    what the link can do, or the reading before."""
    order = ordered(by)
    held = links.withColumns({"w": width_of(F.col("width")), "cw": width_of(F.col("cap_width")), "s": speed_rank(F.col("speed")), "cs": speed_rank(F.col("cap_speed"))})
    held = held.withColumns({"ow": F.lag("w").over(order), "os": F.lag("s").over(order), "old_speed": F.lag("speed").over(order)})
    both = lambda a, b: (F.col(a) > 0) & (F.col(b) > 0) & (F.col(a) < F.col(b))
    kinds = F.array(
        F.when(both("w", "cw"), "width below capability"), F.when(both("s", "cs"), "speed below capability"), F.when(both("w", "ow"), "width fell"),
        F.when((F.coalesce("old_speed", F.lit("")) != "") & (F.col("speed") != "") & (F.col("s") < F.col("os")), "speed fell"),
    )
    return held.withColumn("kinds", F.array_compact(kinds)).drop("w", "cw", "s", "cs", "ow", "os", "old_speed")


def bandwidth(links: DataFrame, by: Sequence[str] = ("array_id", "device")) -> DataFrame:
    """Readings with downgrades, and the first without after them, by device. event is alert or recovered; what lists
    the kinds."""
    event = F.when(F.size("kinds") > 0, "alert").when(F.lag(F.size("kinds")).over(ordered(by)) > 0, "recovered")
    return downgrades(links, by).withColumn("event", event).where("event is not null").withColumn("what", F.array_join("kinds", "; ")).drop("kinds")


def bandwidth_cycles(links: DataFrame, array: str = "array_id", device: str = "device", cycle: str = "cycle") -> DataFrame:
    """Cycles of an array's links that alert, with all downgrades of the cycle; the first in which no device falls short
    has recovered."""
    said = F.transform("kinds", lambda k: F.concat(F.col(device), F.lit(" "), k))
    each = downgrades(links, (array, device)).groupBy(array, cycle).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(device, "ts", "id", said.alias("said")))), lambda x: x["said"])).alias("downgrades"))
    before = F.lag(F.size("downgrades")).over(W.partitionBy(array).orderBy(cycle))
    event = F.when(F.size("downgrades") > 0, "alert").when(before > 0, "recovered")
    return each.withColumn("event", event).where("event is not null")
