"""Active issues of an array and its health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from watchgrid.operators.store import newest
from watchgrid.schema import level_rank, micros

#: Observers that have issues.
OBSERVERS = ("alarm_type", "cpu_usage", "memory_leak", "pcie_bandwidth", "card_info", "port_error_code", "error_code")
#: Those whose newest alert lists all that is wrong.
LISTING = ("alarm_type", "pcie_bandwidth", "card_info")
ALARM = "array<struct<alarm_id:string,obj_type:string,timestamp:string>>"
CARD = "array<struct<card:string,board_id:string,level:string,fields:array<struct<field:string,value:string,level:string>>>>"


def recovered(details: Column) -> Column:
    return F.coalesce(F.get_json_object(details, "$.recovered") == "true", F.lit(False))


def parts(observer: Column, level: Column, message: Column, details: Column, ts: Column, any_level: bool = False) -> Column:
    """The issues that an alert stands for: an array of (key, level, message, since).

    An alarm list gives one for each alarm, at any level; downgrades one for each device and card alerts one for
    each card and field, from warnings on, or at any level where that is asked for; error codes need a count by
    category; others are one issue each. since is an alarm's own time, where it has one.
    """
    high = level_rank(level) >= 1
    raw = lambda p: F.get_json_object(details, p)
    kind = "array<struct<key:string,level:string,message:string,since:timestamp_ntz>>"
    none = F.array().cast(kind)
    one = lambda key, lv, said, since=ts: F.struct(key.alias("key"), lv.alias("level"), said.alias("message"), since.alias("since"))
    some = lambda c: F.coalesce(c, F.lit("?"))
    alarms = F.transform(F.from_json(raw("$.active_alarms"), ALARM), lambda a: one(F.concat(F.lit("alarm_type:"), some(a["alarm_id"])), F.lit("warning"), F.concat(F.lit("AlarmId:"), some(a["alarm_id"]), F.lit(" objType:"), F.coalesce(a["obj_type"], F.lit(""))), F.coalesce(a["timestamp"].try_cast("timestamp_ntz"), ts)))
    downs = F.transform(F.from_json(raw("$.downgrades"), "array<string>"), lambda d: one(F.concat(F.lit("pcie_bandwidth:"), F.substring_index(d, " ", 1)), level, d))
    label = lambda c: F.when(F.coalesce(c["board_id"], F.lit("")) != "", F.concat(some(c["card"]), F.lit(" (BoardId:"), c["board_id"], F.lit(")"))).otherwise(some(c["card"]))
    cards = F.flatten(F.transform(F.from_json(raw("$.alerts"), CARD), lambda c: F.transform(c["fields"], lambda f: one(F.concat_ws(":", F.lit("card_info"), some(c["card"]), some(f["field"])), F.coalesce(f["level"], c["level"], level), F.concat(F.lit("card "), label(c), F.lit(" "), some(f["field"]), F.lit("="), some(f["value"]))))))
    count = lambda p: F.coalesce(raw(p).try_cast("double"), F.lit(0.0)) > 0
    counted = (observer != "error_code") | count("$.by_category.error_code") | count("$.by_category.pcie")
    said = F.when(observer == "port_error_code", F.coalesce(F.nullif(F.array_join(F.slice(F.from_json(raw("$.alerts"), "array<string>"), 1, 3), "; "), F.lit("")), message)).otherwise(message)
    listed = F.lit(True) if any_level else high
    return (
        F.when(observer == "alarm_type", F.coalesce(alarms.cast(kind), none))
        .when(observer == "pcie_bandwidth", F.when(listed, F.coalesce(downs.cast(kind), none)).otherwise(none))
        .when(observer == "card_info", F.when(listed, F.coalesce(cards.cast(kind), none)).otherwise(none))
        .when(observer.isin(*OBSERVERS) & high & counted, F.array(one(observer, level, F.left(said, F.lit(200)))).cast(kind))
        .otherwise(none)
    )


def latest_two(alerts: DataFrame) -> DataFrame:
    """For each array's observer its newest alert and the one before, as structs now and before."""
    two = newest(alerts.where(F.col("observer").isin(*OBSERVERS)), 2)
    fields = F.struct("ts", "id", "level", "message", "details")
    return two.groupBy("array_id", "observer").agg(F.max(F.when(F.col("rn") == 1, fields)).alias("now"), F.max(F.when(F.col("rn") == 2, fields)).alias("before"))


def stale_ack(observer: Column, before: Column, recovered_at: Column, acked_at: Column) -> Column:
    """Whether an acknowledgement of the newest alert no longer counts.

    The alert before it was a recovery, or was informative for cards; or a recovery was recorded after it.
    """
    return F.coalesce(recovered(before["details"]), F.lit(False)) | F.coalesce((observer == "card_info") & (before["level"] == "info"), F.lit(False)) | F.coalesce(recovered_at > acked_at, F.lit(False))


def active(alerts: DataFrame, acks: DataFrame, recoveries: DataFrame | None = None) -> DataFrame:
    """The issues that the newest alert of each array's observer stands for, unless it is a recovery.

    suppressed tells whether its acknowledgement counts; of several the newest does. recoveries (array_id, observer,
    recovered_at) are recorded moments of recovery. since is, for processor and memory, the time of the alert
    before, if that alerted too.
    """
    held = judged(alerts, acks, recoveries).where(~recovered(F.col("now.details")))
    before_high = (level_rank(F.col("before.level")) >= 1) & ~recovered(F.col("before.details"))
    since = F.when(F.col("observer").isin("cpu_usage", "memory_leak") & before_high, F.col("before.ts")).otherwise(F.col("now.ts"))
    issues = parts(F.col("observer"), F.col("now.level"), F.coalesce("now.message", F.lit("")), F.col("now.details"), since)
    one = held.withColumn("i", F.explode(issues))
    return one.select("array_id", "observer", "i.key", "i.level", "i.message", F.col("now.id").alias("alert_id"), "i.since", F.col("now.ts").alias("latest"), (F.col("acked_at").isNotNull() & ~F.col("stale")).alias("suppressed"))


def judged(alerts: DataFrame, acks: DataFrame, recoveries: DataFrame | None = None) -> DataFrame:
    seen = acks.groupBy("alert_id").agg(F.max("acked_at").alias("acked_at"))
    two = latest_two(alerts)
    held = two.join(seen, two["now.id"] == seen["alert_id"], "left")
    if recoveries is None:
        held = held.withColumn("recovered_at", F.lit(None).cast("timestamp_ntz"))
    else:
        held = held.join(recoveries.select("array_id", "observer", "recovered_at"), ["array_id", "observer"], "left")
    return held.withColumn("stale", F.col("acked_at").isNotNull() & ~recovered(F.col("now.details")) & stale_ack(F.col("observer"), F.col("before"), F.col("recovered_at"), F.col("acked_at")))


def stale_acks(alerts: DataFrame, acks: DataFrame, recoveries: DataFrame | None = None) -> DataFrame:
    """Ids of the alerts whose acknowledgement no longer counts and is to be deleted."""
    return judged(alerts, acks, recoveries).where("stale").select(F.col("now.id").alias("alert_id"))


def followed(alerts: DataFrame) -> DataFrame:
    """The issues after all alerts were taken in one by one, in order of time and id.

    For observers that list, the newest alert's list replaces what was there. For others a recovery clears the
    issue and an alert opens it or brings it up to date: since is the first alert after the last recovery.
    """
    held = alerts.where(F.col("observer").isin(*OBSERVERS)).withColumn("at", F.struct("ts", "id"))
    listing = held.where(F.col("observer").isin(*LISTING))
    row = F.struct("ts", "id", "level", "message", "details")
    last = listing.groupBy("array_id", "observer").agg(F.max_by(row, "at").alias("now"))
    issues = parts(F.col("observer"), F.col("now.level"), F.coalesce("now.message", F.lit("")), F.col("now.details"), F.col("now.ts"), any_level=True)
    out = last.withColumn("i", F.explode(issues)).select("array_id", "observer", "i.key", "i.level", "i.message", "i.since", F.col("now.ts").alias("latest"))
    # replaced sets never hold a key twice
    out = out.groupBy("array_id", "observer", "key").agg(F.max_by("level", "message").alias("level"), F.max("message").alias("message"), F.min("since").alias("since"), F.max("latest").alias("latest"))
    others = held.where(~F.col("observer").isin(*LISTING))
    cleared = others.where(recovered(F.col("details"))).groupBy("array_id", "observer").agg(F.max("at").alias("cleared"))
    opened = others.withColumn("p", F.try_element_at(parts(F.col("observer"), F.col("level"), F.coalesce("message", F.lit("")), F.col("details"), F.col("ts")), F.lit(1)))
    opened = opened.where(F.col("p").isNotNull() & ~recovered(F.col("details"))).join(cleared, ["array_id", "observer"], "left").where("cleared is null or at > cleared")
    one = opened.groupBy("array_id", "observer").agg(F.max_by("p", "at").alias("p"), F.min("ts").alias("since"), F.max("ts").alias("latest"))
    return out.unionByName(one.select("array_id", "observer", "p.key", "p.level", "p.message", "since", "latest"))


def recoveries(alerts: DataFrame) -> DataFrame:
    """array_id, observer, key and recovered_at of each issue that was open and no longer is: the time of the first
    alert of its observer after the last one that held it. For active(), recovered_at of an observer is its latest."""
    listing = F.col("observer").isin(*LISTING)
    found = parts(F.col("observer"), F.col("level"), F.coalesce("message", F.lit("")), F.col("details"), F.col("ts"), any_level=True)
    keys = F.transform(found, lambda p: p["key"])
    clears = ~listing & recovered(F.col("details"))
    held = alerts.where(F.col("observer").isin(*OBSERVERS)).select("array_id", "observer", "ts", "id", F.when(clears, F.array().cast("array<string>")).otherwise(keys).alias("keys"), clears.alias("clears"))
    # of an observer that doesn't list, alerts that neither open nor clear say nothing
    held = held.where(listing | F.col("clears") | (F.size("keys") > 0)).withColumn("next", F.lead("ts").over(W.partitionBy("array_id", "observer").orderBy("ts", "id")))
    last = held.select("array_id", "observer", "ts", "id", "next", F.explode("keys").alias("key")).groupBy("array_id", "observer", "key").agg(F.max_by("next", F.struct("ts", "id")).alias("recovered_at"))
    return last.where("recovered_at is not null")


def runtime(seen: DataFrame, at: Column, fresh_seconds: int = 120) -> DataFrame:
    """State of each array and of its collection, by its newest heartbeat or push.

    seen has heartbeat_at, pushed_at, connected, deployed and running; of equal times the heartbeat is the source.
    """
    last = F.greatest("heartbeat_at", "pushed_at")
    age = (micros(at) - micros(F.col("last_seen"))) / 1_000_000
    source = F.when(F.col("last_seen").isNull(), "none").when(F.col("heartbeat_at") == F.col("last_seen"), "heartbeat").otherwise("push")
    held = seen.withColumn("last_seen", last).withColumn("health_source", source).withColumn("healthy", F.coalesce(F.col("running") & (age <= fresh_seconds), F.lit(False)))
    state = F.when(~F.col("connected"), "disconnected").when(F.col("running") & ~F.col("healthy"), "degraded").otherwise("connected")
    collect = F.when(~F.col("connected"), "unreachable").when(~F.col("deployed"), "not_deployed").when(~F.col("running"), "agent_stopped").when(~F.col("healthy"), "no_heartbeat").otherwise("ok")
    return held.withColumn("state", state).withColumn("collect_status", collect)


def freshness(ts: Column, at: Column) -> Column:
    """fresh up to five minutes, stale up to thirty, else unknown."""
    minutes = (micros(at) - micros(ts)) / 60_000_000
    return F.when(minutes <= 5, "fresh").when(minutes <= 30, "stale").otherwise("unknown")


def status_class(state: Column, issues: Column, worst_issue: Column, errors: Column, warnings: Column) -> Column:
    """How an array shows: offline, by its issues, else by its recent alerts; nulls count as none."""
    count = lambda c: F.coalesce(c, F.lit(0))
    return (
        F.when(F.coalesce(state, F.lit("")) != "connected", "offline")
        .when(count(issues) > 0, F.when(count(worst_issue) >= 2, "error").otherwise("warning"))
        .when(count(errors) > 0, "attention")
        .when(count(warnings) > 0, "warning")
        .otherwise("ok")
    )
