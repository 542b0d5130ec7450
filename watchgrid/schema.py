"""Entities of the monitoring domain over the source tables, and the severity order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The moment that relative ranges count back from in queries over recorded data.
NOW = "2024-01-31 00:00:00"
LEVELS = ("info", "warning", "error", "critical")


def level_rank(level: Column) -> Column:
    """0 to 3 by severity; an unknown level counts as info."""
    rank = F.lit(0)
    for k, name in enumerate(LEVELS):
        rank = F.when(level == name, k).otherwise(rank)
    return rank


def level_of(value: Column) -> Column:
    return F.when(value >= 150, "critical").when(value >= 100, "error").when(value >= 50, "warning").otherwise("info")


def now() -> Column:
    return F.lit(NOW).cast("timestamp_ntz")


def micros(ts: Column) -> Column:
    """Microseconds since the epoch of a timestamp without zone, read as UTC."""
    return F.unix_micros(F.convert_timezone(F.lit("UTC"), F.lit("UTC"), ts).cast("timestamp_ltz"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, array_id, observer, level, message, details, ts, value and k."""
    k = F.get_json_object("props", "$.k")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.col("user_id").alias("array_id"), F.col("event_type").alias("observer"), level_of(F.col("value")).alias("level"),
        F.concat("event_type", F.lit(" k="), k).alias("message"), F.col("props").alias("details"), "ts", "value", k.cast("int").alias("k"),
    )


def acknowledgements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fixed subset of alerts counts as acknowledged; the type cycles."""
    kind = F.element_at(F.array(F.lit("dismiss"), F.lit("deferred"), F.lit("confirmed_ok")), (F.col("id") % 3 + 1).cast("int"))
    return alerts(spark, sf_dir).where("id % 7 = 0").select(F.col("id").alias("alert_id"), kind.alias("ack_type"), F.col("ts").alias("acked_at"))


def tasks(spark: SparkSession) -> DataFrame:
    """Test windows: an empty array list means all arrays, and no end means still open."""
    rows = [
        (1, "burn_in", "stress", [], "2024-01-03 00:00:00", "2024-01-05 00:00:00"),
        (2, "upgrade", "upgrade", [1, 2, 3, 5, 8, 13], "2024-01-04 12:00:00", "2024-01-10 00:00:00"),
        (3, "failover", "fault_injection", [7, 14, 21], "2024-01-15 06:00:00", "2024-01-15 18:00:00"),
        (4, "soak", "stress", [100, 101, 102], "2024-01-20 00:00:00", None),
    ]
    return spark.createDataFrame(rows, "task_id int, name string, task_type string, array_ids array<bigint>, started string, ended string").select("task_id", "name", "task_type", "array_ids", F.col("started").cast("timestamp_ntz").alias("started_at"), F.col("ended").cast("timestamp_ntz").alias("ended_at"))


#: What observers of the domain say, as expressions that Spark and the SQL of the checks share; OF names the observer.
OF = """CASE k % 10 WHEN 0 THEN 'link_status' WHEN 1 THEN 'port_speed' WHEN 2 THEN 'card_info' WHEN 3 THEN 'pcie_bandwidth' WHEN 4 THEN 'cpu_usage'
  WHEN 5 THEN 'memory_leak' WHEN 6 THEN 'alarm_type' WHEN 7 THEN 'error_code' WHEN 8 THEN 'port_error_code' ELSE 'disk_smart' END"""
HOUR = "CAST(CASE WHEN id % 5 = 0 THEN 0 ELSE day(ts) * 24 + hour(ts) END AS STRING)"
K = "CAST(k AS STRING)"
SAYS = f"""CASE k % 10 WHEN 1 THEN 'ens' || {HOUR} || ' at ' || {K} || ' Gb' WHEN 3 THEN 'no' || {HOUR} || ' narrowed' ELSE observer || ' k=' || {K} END"""
TELLS = f"""CASE WHEN k % 10 IN (4, 5, 7, 8) AND id % 4 = 0 THEN '{{"recovered":true}}'
  ELSE CASE k % 10
  WHEN 0 THEN '{{"changes":[{{"port":"ens' || {HOUR} || '"}}]}}'
  WHEN 2 THEN '{{"alerts":[{{"card":"No' || {HOUR} || '","board_id":"' || CASE WHEN k < 50 THEN 'b' || {K} ELSE '' END || '","level":"error","fields":[{{"field":"Model","value":"x"}},{{"field":"HealthState","value":"bad","level":"warning"}}]}}]}}'
  WHEN 3 THEN '{{"downgrades":["' || {K} || ':00.0 x16 to x8","other narrower"]}}'
  WHEN 4 THEN '{{"current_percent":' || {K} || '}}'
  WHEN 5 THEN '{{"current_rss_mb":' || {K} || ',"rss_growth_mb_per_hour":' || CAST(id % 7 AS STRING) || '}}'
  WHEN 6 THEN '{{"active_alarms":[{{"alarm_id":"' || {K} || '","obj_type":"disk"}},{{"alarm_id":"9"}}]}}'
  WHEN 7 THEN '{{"port_counters":{{"eth0":{{"rx":' || {K} || ',"tx":2}},"eth1":{{"rx":1}}}},"by_category":{{"pcie":' || CAST(id % 2 AS STRING) || '}}}}'
  WHEN 8 THEN '{{"alerts":["a' || {K} || '","b","c","d"]}}'
  ELSE '{{"items":[{{"current_pending":' || {K} || ',"value":3}}]}}' END END"""

#: Log lines as the log detectors know them.
LINE = f"""CASE k % 12
  WHEN 0 THEN 'app' || CAST(array_id AS STRING) || '[' || CAST(id AS STRING) || ']: segfault at ' || {K}
  WHEN 1 THEN 'Out of memory: Killed process ' || CAST(id AS STRING) || ' (worker)'
  WHEN 2 THEN 'recv sig ' || CAST(k % 70 AS STRING) || ' then SIG' || CAST(id % 20 AS STRING) || ' and sig 61'
  WHEN 3 THEN 'sda: Buffer I/O error on dev'
  WHEN 4 THEN 'task abort on scsi error'
  WHEN 5 THEN '2024-01-05 10:00:00 AlarmType:1 fault AlarmId:' || CAST(id % 3 AS STRING) || ' objType:disk'
  WHEN 6 THEN '[12.5] alarmtype:2 Resume AlarmId:' || CAST(id % 3 AS STRING) || ' objType:disk'
  WHEN 7 THEN 'AlarmType:0 event objType:fan'
  WHEN 8 THEN 'Jan  5 10:00:00 Recover ChipErr dev(0:04.' || CAST(k % 40 AS STRING) || '.00)'
  WHEN 9 THEN 'kernel BUG at mm, login password=Abc' || CAST(id AS STRING) || 'x'
  WHEN 10 THEN 'enter password: token=tok' || CAST(id AS STRING)
  ELSE 'send alarm type(' || CAST(k % 3 AS STRING) || ') alarm name(fan ' || {K} || ') alarm id(' || CAST(id % 5 AS STRING) || ') nqn.2014-08.org:x' || {K} END"""


def once(rows: DataFrame, *names: str) -> DataFrame:
    """rows with the columns of these names made once a row, as a list of one.

    A condition on a column goes down to where the column is made, and there each mention of it makes it anew: one on
    a JSON member of a text that other members were put into ran for a tenth of a millisecond a row.
    """
    return rows.select(*[c for c in rows.columns if c not in names], F.inline(F.array(F.struct(*names))))


def observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """alerts as the observers of the domain would raise them."""
    held = alerts(spark, sf_dir).selectExpr("id", "array_id", f"{OF} AS observer", "level", f"{SAYS} AS message", f"{TELLS} AS details", "ts", "value", "k")
    return once(held, "observer", "message", "details").select(held.columns)


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, array_id, ts, k and line."""
    return once(alerts(spark, sf_dir).selectExpr("id", "array_id", "ts", "k", f"{LINE} AS line"), "line")


#: The same entities for the SQL of the checks.
SQL = rf"""
alerts AS (
  SELECT event_id AS id, user_id AS array_id, event_type AS observer,
         CASE WHEN value >= 150 THEN 'critical' WHEN value >= 100 THEN 'error' WHEN value >= 50 THEN 'warning' ELSE 'info' END AS level,
         CASE WHEN value >= 150 THEN 3 WHEN value >= 100 THEN 2 WHEN value >= 50 THEN 1 ELSE 0 END AS rank,
         event_type || ' k=' || json_extract_string(props, '$.k') AS message, props AS details, ts, value,
         CAST(json_extract_string(props, '$.k') AS INT) AS k
  FROM events),
acks AS (SELECT id AS alert_id, ['dismiss', 'deferred', 'confirmed_ok'][CAST(id % 3 + 1 AS INT)] AS ack_type, ts AS acked_at FROM alerts WHERE id % 7 = 0),
tasks AS (
  SELECT * FROM (VALUES
    (1, 'burn_in', 'stress', CAST([] AS BIGINT[]), TIMESTAMP '2024-01-03 00:00:00', TIMESTAMP '2024-01-05 00:00:00'),
    (2, 'upgrade', 'upgrade', [1, 2, 3, 5, 8, 13], TIMESTAMP '2024-01-04 12:00:00', TIMESTAMP '2024-01-10 00:00:00'),
    (3, 'failover', 'fault_injection', [7, 14, 21], TIMESTAMP '2024-01-15 06:00:00', TIMESTAMP '2024-01-15 18:00:00'),
    (4, 'soak', 'stress', [100, 101, 102], TIMESTAMP '2024-01-20 00:00:00', NULL)
  ) t(task_id, name, task_type, array_ids, started_at, ended_at)),
observed AS (SELECT id, array_id, {OF} AS observer, level, rank, {SAYS} AS message, {TELLS} AS details, ts, value, k FROM alerts),
loglines AS (SELECT id, array_id, ts, k, {LINE} AS line FROM alerts)
"""
