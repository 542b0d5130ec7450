"""Queries of host detectors, commands at intervals, whole monitors and JSON paths, each with its SQL for the check."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from watchgrid.functions import paths
from watchgrid.functions import text as tx
from watchgrid.operators import hosts
from watchgrid.register import query
from watchgrid.schema import alerts, observed

KEY = ["array_id", "observer"]
OVER = "OVER (PARTITION BY array_id, observer ORDER BY ts, id)"
FLAGGED = "p AS (SELECT *, lag(len(reasons) > 0) {over} AS before FROM h WHERE reasons IS NOT NULL) SELECT id, CASE WHEN len(reasons) > 0 THEN 'alert' ELSE 'recovered' END AS event, CASE WHEN len(reasons) > 0 THEN 'warning' ELSE 'info' END AS alert_level, array_to_string(reasons, '; ') AS message FROM p WHERE len(reasons) > 0 OR before".format(over=OVER)


def shown(found: DataFrame) -> DataFrame:
    return found.select("id", "event", "alert_level", F.array_join("reasons", "; ").alias("message"))


@query(
    f""", h AS (SELECT *, CASE WHEN k % 13 > 0 THEN list_filter([
  CASE WHEN k >= 90 THEN '/: space ' || k || '% >= 90%' END, CASE WHEN k % 3 > 0 AND id % 100 >= 90 THEN '/data' || k % 4 || ': space ' || id % 100 || '% >= 90%' END,
  CASE WHEN k % 3 > 0 AND k >= 95 THEN '/data' || k % 4 || ': inodes ' || k || '% >= 90%' WHEN k % 3 = 0 AND k >= 95 THEN '/data' || k % 4 || ': inodes ' || k || '% >= 90%' END], lambda x: x IS NOT NULL) END AS reasons FROM alerts), {FLAGGED}"""
)
def disk_space(spark: SparkSession, sf: str) -> DataFrame:
    k, used = F.col("k").cast("double"), (F.col("id") % 100).cast("double")
    mount = lambda name, kind, space, inode: F.struct(name.alias("mount"), kind.alias("fstype"), space.alias("space"), inode.alias("inode"))
    data = mount(F.concat(F.lit("/data"), (F.col("k") % 4).cast("string")), F.when(F.col("k") % 3 == 0, "tmpfs").otherwise("xfs"), used, F.when(k >= 95, k).otherwise(10.0))
    mounts = F.array(mount(F.lit("/"), F.lit("ext4"), k, F.lit(1.0)), data, mount(F.lit("/run/user"), F.lit("ext4"), F.lit(99.0), F.lit(99.0)), mount(F.lit("/snap/x"), F.lit("squashfs"), F.lit(100.0), F.lit(100.0)))
    held = alerts(spark, sf).withColumn("mounts", F.when(F.col("k") % 13 > 0, mounts))
    return shown(hosts.full_disks(held, KEY))


@query(
    f""", v AS (SELECT *, 2 + k % 3 AS cores, value / 10 AS l1, k / 10.0 AS l5, (id % 80) / 10.0 AS l15 FROM alerts),
h AS (SELECT *, list_filter([CASE WHEN l1 > cores * 2 THEN printf('load of 1 min %.2f > %.1f', l1, cores * 2.0) END, CASE WHEN l5 > cores * 2 THEN printf('load of 5 min %.2f > %.1f', l5, cores * 2.0) END, CASE WHEN l15 > cores * 2 THEN printf('load of 15 min %.2f > %.1f', l15, cores * 2.0) END], lambda x: x IS NOT NULL) AS reasons FROM v), {FLAGGED.replace("array_to_string(reasons, '; ')", "len(reasons)")}"""
)
def load_average(spark: SparkSession, sf: str) -> DataFrame:
    held = alerts(spark, sf).withColumns({"cores": 2 + F.col("k") % 3, "load1": F.col("value") / 10, "load5": F.col("k") / 10.0, "load15": (F.col("id") % 80) / 10.0})
    return hosts.loaded(held, KEY).select("id", "event", "alert_level", F.size("reasons").cast("bigint").alias("message"))


@query(f", v AS (SELECT *, CASE WHEN k % 17 > 0 THEN 200 ELSE 0 END AS most, CAST(k + id % 100 AS DOUBLE) AS used FROM alerts), h AS (SELECT *, CASE WHEN most > 0 AND used / most * 100 >= 80 THEN [printf('descriptors %.1f%% >= 80%%', used / most * 100)] ELSE [] END AS reasons FROM v), {FLAGGED}")
def file_descriptors(spark: SparkSession, sf: str) -> DataFrame:
    held = alerts(spark, sf).withColumns({"most": F.when(F.col("k") % 17 > 0, 200).otherwise(0), "free": F.lit(50), "allocated": F.col("k") + F.col("id") % 100 + 50})
    return shown(hosts.descriptors(held, KEY))


@query(f", v AS (SELECT *, CASE WHEN k % 5 > 0 THEN 1000 ELSE 0 END AS total, CAST(k * 9 AS DOUBLE) AS used FROM alerts), h AS (SELECT *, CASE WHEN total > 0 THEN CASE WHEN used / total * 100 >= 50 THEN [printf('swap %.1f%% >= 50%%', used / total * 100)] ELSE [] END END AS reasons FROM v), {FLAGGED}")
def swap_usage(spark: SparkSession, sf: str) -> DataFrame:
    total = F.when(F.col("k") % 5 > 0, 1000).otherwise(0)
    return shown(hosts.swap(alerts(spark, sf).withColumns({"swap_total": total, "swap_free": total - F.col("k") * 9}), KEY))


@query(f", h AS (SELECT *, CASE WHEN k % 19 > 0 THEN list_filter([CASE WHEN k * 2 + 1 > 120 THEN 'TIME_WAIT ' || (k * 2 + 1) || ' > 120' END, CASE WHEN id % 200 > 150 THEN 'ESTABLISHED ' || id % 200 || ' > 150' END], lambda x: x IS NOT NULL) END AS reasons FROM alerts), {FLAGGED}")
def tcp_connections(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("k").cast("bigint")
    states = F.create_map(F.lit("TIME-WAIT"), k, F.lit("TIME_WAIT"), k + 1, F.lit("ESTAB"), F.col("id") % 200, F.lit("LISTEN"), F.lit(9_999).cast("bigint"))
    held = alerts(spark, sf).withColumn("states", F.when(F.col("k") % 19 > 0, states))
    return shown(hosts.connections(held, KEY, waiting=120, established=150))


COMMANDS = """w AS (SELECT *, 21600 * (1 + length(observer) % 3) AS wait, row_number() OVER (PARTITION BY array_id, observer ORDER BY ts, id) AS place,
  CASE WHEN k % 9 = 0 THEN [observer || ' failed (1)'] ELSE list_filter([CASE WHEN k > 60 THEN observer || ': used=' || k || ' (> 60)' END, CASE WHEN k % 4 = 0 THEN observer || ': no field ''state''' END], lambda x: x IS NOT NULL) END AS own FROM alerts),
g AS (WITH RECURSIVE g AS (SELECT array_id, observer, place, id, ts, ts AS ran_at, own AS said, true AS ran FROM w WHERE place = 1
  UNION ALL SELECT w.array_id, w.observer, w.place, w.id, w.ts, CASE WHEN epoch_us(w.ts) - epoch_us(g.ran_at) >= w.wait * 1000000 THEN w.ts ELSE g.ran_at END, CASE WHEN epoch_us(w.ts) - epoch_us(g.ran_at) >= w.wait * 1000000 THEN w.own ELSE g.said END, epoch_us(w.ts) - epoch_us(g.ran_at) >= w.wait * 1000000
  FROM g JOIN w ON w.array_id = g.array_id AND w.observer = g.observer AND w.place = g.place + 1) SELECT * FROM g)"""


def polls(spark: SparkSession, sf: str) -> DataFrame:
    """A poll of each array's commands, named by observer, with what a run would say at that time."""
    k = F.col("k").cast("string")
    out = F.concat(F.lit("used = "), k, F.when(F.col("k") % 4 == 0, "").otherwise("\nstate: ok"))
    held = alerts(spark, sf).withColumns({"out": out, "exit_code": F.when(F.col("k") % 9 == 0, 1).otherwise(0), "interval_s": (21_600 * (1 + F.length("observer") % 3)).cast("double")})
    said = hosts.command_alerts(F.col("observer"), F.col("exit_code"), tx.pairs(F.col("out")), (("used", ">", "60", False), ("state", "==", "bad", True)))
    return hosts.polled(held, ["array_id"], "observer", said)


@query(f", {COMMANDS} SELECT id, ran, array_to_string(said, '; ') AS alerts FROM g")
def custom_commands(spark: SparkSession, sf: str) -> DataFrame:
    return polls(spark, sf).select("id", "ran", F.array_join("alerts", "; ").alias("alerts"))


@query(f", {COMMANDS}, d AS (SELECT array_id, date_trunc('day', ts) AS ts, flatten(list(said ORDER BY observer, id)) AS a FROM g GROUP BY 1, 2) SELECT array_id, ts, array_to_string(a[1:3], '; ') || CASE WHEN len(a) > 3 THEN ' (' || len(a) || ')' ELSE '' END AS message, CAST(len(a) AS INT) AS n FROM d WHERE len(a) > 0")
def command_rounds(spark: SparkSession, sf: str) -> DataFrame:
    """The alerts of all commands of an array, a day taken as one round."""
    return hosts.rounds(polls(spark, sf).withColumn("ts", F.date_trunc("day", "ts").cast("timestamp_ntz")), ["array_id"], "observer")


@query(
    """, o AS (SELECT *, row_number() OVER (PARTITION BY array_id ORDER BY ts, id) AS place FROM alerts),
g AS (WITH RECURSIVE g AS (SELECT array_id, place, id, k, CAST(k > 40 AS INT) AS run, CAST(NULL AS TIMESTAMP) AS fired, false AS fires FROM o WHERE place = 1
UNION ALL SELECT n.array_id, n.place, n.id, n.k, CASE WHEN n.f THEN 0 ELSE n.r END, CASE WHEN n.f THEN n.ts ELSE n.fired END, n.f FROM (
SELECT o.array_id, o.place, o.id, o.k, o.ts, g.fired, CASE WHEN o.k > 40 THEN g.run + 1 ELSE 0 END AS r, CASE WHEN o.k > 40 THEN g.run + 1 ELSE 0 END >= 2 AND (g.fired IS NULL OR o.ts - g.fired >= INTERVAL 24 HOUR) AS f FROM g JOIN o ON o.array_id = g.array_id AND o.place = g.place + 1) n) SELECT * FROM g)
SELECT id, CAST(k AS VARCHAR) AS value, 'used ' || k || ' on ' || array_id AS message FROM g WHERE fires"""
)
def custom_monitor(spark: SparkSession, sf: str) -> DataFrame:
    runs = alerts(spark, sf).withColumn("out", F.concat(F.lit("# a comment\nUSED = "), F.col("k").cast("string"), F.lit("\nrest: 5")))
    return hosts.monitored(runs, ["array_id"], tx.key_value(F.col("out"), "used"), "gt", "40", "used {value} on {array}", n=2, cooldown=86_400, array=F.col("array_id")).select("id", "value", "message")


def joined(text: Column, path: str) -> Column:
    return F.array_join(paths.all_matches(text, path), ",")


@query(
    """ SELECT id, array_to_string(coalesce(json_extract_string(details, '$.alerts[*].fields[*].field'), []), ',') AS fields, coalesce(json_extract_string(details, '$.active_alarms[#-1].alarm_id'), '') AS last_alarm,
array_to_string(list_filter([CASE WHEN observer = 'alarm_type' THEN k || ',9' END], lambda x: x IS NOT NULL), ',') AS deep, json_extract_string(details, '$.items[0].current_pending') AS nested, json_extract_string(details, '$.recovered') AS first FROM observed"""
)
def json_paths(spark: SparkSession, sf: str) -> DataFrame:
    d = F.col("details")
    return observed(spark, sf).select("id", joined(d, "$.alerts[*].fields[*].field").alias("fields"), joined(d, "$.active_alarms[-1].alarm_id").alias("last_alarm"), joined(d, "$..alarm_id").alias("deep"), paths.nested(d, "items.0.current_pending").alias("nested"), paths.first_match(d, "$.recovered").alias("first"))
