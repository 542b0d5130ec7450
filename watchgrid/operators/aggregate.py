"""Alert aggregation: storms, shared causes, merging in time, and folding by what a message says."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from watchgrid.operators.passes import anchors, ordered_pass
from watchgrid.schema import LEVELS, level_rank, micros, once
from watchgrid.scratch import written


def storms(alerts: DataFrame, seconds: int = 60, threshold: int = 20, by: str = "array_id") -> DataFrame:
    """For each array the first moment that a trailing window, its start included, holds threshold alerts.

    The group is the window at that moment: its size, span and worst level.
    """
    trailing = W.partitionBy(by).orderBy("us").rangeBetween(-seconds * 1_000_000, 0)
    order = W.partitionBy(by).orderBy("ts", "id")
    # the frame by time holds later rows of the same moment too, so rows are counted up to their own place
    seen = alerts.where("ts is not null").withColumn("us", micros(F.col("ts"))).withColumn("place", F.row_number().over(order))
    seen = seen.withColumn("first", F.min("place").over(trailing)).withColumn("size", F.col("place") - F.col("first") + 1)
    hits = seen.where(F.col("size") == threshold).groupBy(by).agg(F.min_by(F.struct("first", "place"), "place").alias("hit"))
    inside = seen.join(hits, by).where(F.col("place").between(F.col("hit.first"), F.col("hit.place")))
    return inside.groupBy(by).agg(F.count("*").alias("size"), F.min("ts").alias("earliest"), F.max("ts").alias("latest"), worst_level().alias("worst_level"), *ends())


def ends() -> tuple[Column, Column]:
    """The first and the last id of a group, by time."""
    return F.min_by("id", F.struct("ts", "id")).alias("first_id"), F.max_by("id", F.struct("ts", "id")).alias("last_id")


def worst_level() -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in LEVELS]), (F.max(level_rank(F.col("level"))) + 1).cast("int"))


def correlated(alerts: DataFrame, keys: list[str], seconds: float) -> DataFrame:
    """Groups of two or more alerts that share a key and all lie within so many seconds of each other."""
    span = (micros(F.max("ts")) - micros(F.min("ts"))) / 1_000_000
    groups = alerts.where(" and ".join(f"{k} is not null" for k in keys)).groupBy(*keys).agg(F.count("*").alias("size"), F.min("ts").alias("earliest"), F.max("ts").alias("latest"), span.alias("span_s"), worst_level().alias("worst_level"))
    return groups.where((F.col("size") >= 2) & (F.col("span_s") <= seconds)).drop("span_s")


def port_of(details: Column, message: Column) -> Column:
    """The port of the first change in the details, else the first one named in the message; blank is none."""
    given = F.get_json_object(details, "$.changes[0].port")
    there = F.get_json_object(details, "$.changes[0]").startswith("{")
    named = F.when(there, F.coalesce(given, F.lit(""))).otherwise(F.regexp_extract(message, r"(eth\d+|bond\d+|ens\w+)", 1))
    return F.nullif(named, F.lit(""))


def card_of(details: Column, message: Column) -> Column:
    """The card of the first alert in the details, else the first one named in the message; blank is none."""
    given = F.get_json_object(details, "$.alerts[0].card")
    there = F.get_json_object(details, "$.alerts[0]").startswith("{")
    named = F.when(there, F.coalesce(given, F.lit(""))).otherwise(F.regexp_extract(message, r"(?i)(No\d+)", 1))
    return F.nullif(named, F.lit(""))


@dataclass(frozen=True)
class Cause:
    """A rule of shared causes: which observers it looks at, and what their alerts must have in common."""

    name: str
    observers: tuple[str, ...]
    key: Callable[[Column, Column], Column]


#: The rules in order, with the observers that each looks at.
CAUSES = (
    Cause("port", ("link_status", "port_fec", "port_speed", "error_code"), port_of),
    Cause("card", ("card_info", "pcie_bandwidth", "card_recovery"), card_of),
)


def caused(alerts: DataFrame, causes: Sequence[Cause] = CAUSES) -> DataFrame:
    """Alerts that a rule may group, each with the first rule for its observer and its key; arrays don't matter."""
    rule, key = F.lit(None).cast("string"), F.lit(None).cast("string")
    for c in reversed(causes):
        ours = F.col("observer").isin(*c.observers)
        rule = F.when(ours, c.name).otherwise(rule)
        key = F.when(ours, c.key(F.col("details"), F.col("message"))).otherwise(key)
    return once(alerts.withColumn("rule", rule).withColumn("key", key), "rule", "key").where("key is not null and ts is not null")


def root_causes(alerts: DataFrame, seconds: float = 30, causes: Sequence[Cause] = CAUSES) -> DataFrame:
    """(rule, key) groups with size, span and worst level: all or nothing, two alerts at least.

    Each observer belongs to one rule only, so rules never compete for an alert. An alert whose key is blank, or
    that of no group, stays free for merging in time.
    """
    owned = [o for c in causes for o in c.observers]
    if len(owned) != len(set(owned)):
        raise ValueError("an observer belongs to two rules")
    return correlated(caused(alerts, causes), ["rule", "key"], seconds)


def anchored_rows(alerts: DataFrame, seconds: float, by: Sequence[str] = ("array_id", "observer")) -> DataFrame:
    """alerts with anchor, the time in microseconds of the alert that each is merged into; without a time none."""
    return ordered_pass(alerts, by, anchors(seconds), "anchor", T.LongType())


def anchored(alerts: DataFrame, seconds: float, by: tuple[str, ...] = ("array_id", "observer")) -> DataFrame:
    """Groups in time order: the first row not yet taken is an anchor and takes those up to so many seconds later.

    Not chained: distance counts from the anchor. Rows without a time are in no group.
    """
    moments = anchored_rows(alerts.select(*by, "ts", "id", "level"), seconds, by)
    return moments.groupBy(*by, "anchor").agg(F.count("*").alias("size"), F.min("ts").alias("earliest"), F.max("ts").alias("latest"), worst_level().alias("worst_level")).drop("anchor")


def skeleton(message: Column) -> Column:
    """What a message says apart from times and numbers: 80 characters."""
    timed = F.regexp_replace(message, r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:\.\d+)?", "<time>")
    return F.left(F.trim(F.regexp_replace(F.regexp_replace(timed, r"\d+", "#"), r"\s+", " ")), F.lit(80))


def subjects(alerts: DataFrame, subject: str | None) -> DataFrame:
    return alerts.withColumn("identity", F.col(subject) if subject else skeleton(F.col("message")))


def folded(alerts: DataFrame, subject: str | None = None) -> DataFrame:
    """Alerts of an array's observer about one subject: how many, from when to when, worst and newest.

    subject is a column; without one it is what the message says apart from times and numbers.
    """
    return subjects(alerts, subject).groupBy("array_id", "observer", "identity").agg(F.count("*").alias("size"), F.min("ts").alias("earliest"), F.max("ts").alias("latest"), worst_level().alias("worst_level"), F.max_by("message", F.struct("ts", "id")).alias("newest"), (F.count_distinct("message") > 1).alias("differs"))


def progress(alerts: DataFrame, subject: str | None = None) -> DataFrame:
    """Of folded groups with differing messages, the first number that differs between the oldest and the newest.

    unit is what follows that number in the newest message: %, s, ms, MB, GB or KB, else blank.
    """
    ends = subjects(alerts, subject).groupBy("array_id", "observer", "identity").agg(F.min_by("message", F.struct("ts", "id")).alias("oldest"), F.max_by("message", F.struct("ts", "id")).alias("newest"))
    numbers = lambda c: F.regexp_extract_all(F.col(c), F.lit(r"\d+\.?\d*"), F.lit(0))
    pairs = F.filter(F.arrays_zip(numbers("oldest").alias("a"), numbers("newest").alias("b")), lambda p: p["a"] != p["b"])
    held = ends.withColumn("p", F.try_element_at(pairs, F.lit(1))).where("p is not null")
    # where the newest message first says that number with a unit
    unit = F.call_function("regexp_extract", F.col("newest"), F.concat(F.replace(F.col("p.b"), F.lit("."), F.lit(r"\.")), F.lit(r"\s*(%|s|ms|MB|GB|KB)")), F.lit(1))
    return held.select("array_id", "observer", F.col("p.a").try_cast("double").alias("from_value"), F.col("p.b").try_cast("double").alias("to_value"), unit.alias("unit"))


def aggregated(alerts: DataFrame, storm_seconds: float = 60, storm_size: int = 20, cause_seconds: float = 30, merge_seconds: float = 10, causes: Sequence[Cause] = CAUSES) -> DataFrame:
    """All entries of a view, newest first: storms, shared causes, groups in time, and single alerts.

    A storm only tells of its alerts, which stay free. Alerts of a shared cause are taken by it; the rest is merged
    in time by array and observer, and an alert without a time stands alone. Each entry has kind, label, key,
    array_id where it has one, size, earliest, latest, worst_level, and members: the first and the last id of its
    alerts, by time. members() lists all of them.
    """
    columns = ["kind", "label", "key", "array_id", "size", "earliest", "latest", "worst_level", "first_id", "last_id"]
    storm = storms(alerts, storm_seconds, storm_size).withColumns({"kind": F.lit("storm"), "key": F.col("array_id").cast("string")})
    storm = storm.withColumn("label", F.concat(F.lit("storm of "), F.col("size").cast("string"), F.lit(" alerts on "), F.col("key")))
    found = members(alerts, cause_seconds, merge_seconds, causes)
    by = ["kind", "key", "array_id", "observer", "anchor"]
    groups = found.groupBy(*by).agg(F.count("*").alias("size"), F.min("ts").alias("earliest"), F.max("ts").alias("latest"), worst_level().alias("worst_level"), *ends())
    single = (F.col("kind") == "time_window") & (F.col("size") == 1)
    said = F.when(F.col("kind") == "root_cause", F.concat(F.col("key"), F.lit(": "), F.col("size").cast("string"), F.lit(" related alerts"))).when(single, F.col("observer")).otherwise(F.concat(F.col("observer"), F.lit(" repeated")))
    groups = groups.withColumn("label", said).withColumn("key", F.when(F.col("kind") == "root_cause", F.col("key")).otherwise("")).withColumn("kind", F.when(single, "single").otherwise(F.col("kind")))
    return storm.select(*columns).unionByName(groups.select(*columns)).orderBy(F.desc("latest"), "kind", "label", "first_id")


def members(alerts: DataFrame, cause_seconds: float = 30, merge_seconds: float = 10, causes: Sequence[Cause] = CAUSES) -> DataFrame:
    """alerts, each once, with what takes it: kind root_cause with its key, or time_window with its anchor."""
    held = alerts.select("id", "array_id", "observer", "ts", "level", "message", "details")
    groups = written(root_causes(alerts, cause_seconds, causes).select("rule", "key"), "groups")
    taken = caused(held, causes).join(groups, ["rule", "key"])
    # read by the pass twice, and once more for alerts without a time
    rest = written(held.select("id", "array_id", "observer", "ts", "level").join(taken.select("id"), "id", "left_anti"), "rest")
    none = lambda kind: F.lit(None).cast(kind)
    shape = ["kind", "key", "array_id", "observer", "anchor", "id", "ts", "level"]
    a = taken.select("id", "ts", "level", "key", F.lit("root_cause").alias("kind"), none("bigint").alias("array_id"), none("string").alias("observer"), none("bigint").alias("anchor"))
    b = anchored_rows(rest.select("array_id", "observer", "ts", "id", "level"), merge_seconds).withColumn("kind", F.lit("time_window")).withColumn("key", none("string"))
    c = rest.where("ts is null").select("array_id", "observer", "ts", "id", "level", F.lit("time_window").alias("kind"), F.concat(F.lit("id "), F.col("id").cast("string")).alias("key"), none("bigint").alias("anchor"))
    return a.select(*shape).unionByName(b.select(*shape)).unionByName(c.select(*shape))
