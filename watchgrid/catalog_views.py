"""Queries of views over alerts, arrays, issues, users and tasks, each with its SQL for the check."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from watchgrid.operators import aggregate, archives, baseline, issues, lifecycle, mining, ranks, store, tasks, views
from watchgrid.register import RANK_NAME, query
from watchgrid.schema import NOW, acknowledgements, alerts, level_rank, log_lines, now, observed, table
from watchgrid.schema import tasks as test_windows
from watchgrid.scratch import new_folder
from watchgrid.sources import readers

# The aggregated view

CAUSES = f"""ca AS (SELECT id, array_id, observer, ts, level, rank, CASE WHEN observer IN ('link_status', 'port_speed', 'error_code') THEN 'port' WHEN observer IN ('card_info', 'pcie_bandwidth') THEN 'card' END AS rule,
CASE observer WHEN 'link_status' THEN json_extract_string(details, '$.changes[0].port') WHEN 'port_speed' THEN regexp_extract(message, '(eth\\d+|bond\\d+|ens\\w+)', 1) WHEN 'card_info' THEN json_extract_string(details, '$.alerts[0].card') WHEN 'pcie_bandwidth' THEN regexp_extract(message, '(?i)(no\\d+)', 1) WHEN 'error_code' THEN regexp_extract(message, '(eth\\d+|bond\\d+|ens\\w+)', 1) END AS key FROM observed),
rc AS (SELECT rule, key, count(*) AS size, min(ts) AS earliest, max(ts) AS latest, {RANK_NAME.format("max(rank)")} AS worst_level, arg_min(id, (ts, id)) AS first_id, arg_max(id, (ts, id)) AS last_id FROM ca WHERE key <> '' GROUP BY 1, 2 HAVING count(*) >= 2 AND epoch_us(max(ts)) - epoch_us(min(ts)) <= 3600000000)"""


@query(f", {CAUSES} SELECT key, size, earliest, latest, worst_level FROM rc WHERE rule = 'port'")
def root_cause_by_port(spark: SparkSession, sf: str) -> DataFrame:
    return aggregate.root_causes(observed(spark, sf), 3600).where("rule = 'port'").drop("rule")


@query(f", {CAUSES} SELECT key, size, earliest, latest, worst_level FROM rc WHERE rule = 'card'")
def root_cause_by_card(spark: SparkSession, sf: str) -> DataFrame:
    return aggregate.root_causes(observed(spark, sf), 3600).where("rule = 'card'").drop("rule")


@query(
    f""", {CAUSES},
so AS (SELECT *, row_number() OVER (PARTITION BY array_id ORDER BY ts, id) AS place FROM observed),
ss AS (SELECT *, min(place) OVER (PARTITION BY array_id ORDER BY ts RANGE BETWEEN INTERVAL 24 HOUR PRECEDING AND CURRENT ROW) AS first FROM so),
sh AS (SELECT array_id, arg_min(first, place) AS lo, min(place) AS hi FROM ss WHERE place - first + 1 = 8 GROUP BY 1),
st AS (SELECT array_id, count(*) AS size, min(ts) AS earliest, max(ts) AS latest, {RANK_NAME.format("max(rank)")} AS worst_level FROM so JOIN sh USING (array_id) WHERE place BETWEEN lo AND hi GROUP BY 1),
fr AS (SELECT o.* FROM observed o WHERE o.id NOT IN (SELECT ca.id FROM ca JOIN rc ON ca.rule = rc.rule AND ca.key = rc.key)),
fo AS (SELECT *, row_number() OVER (PARTITION BY array_id, observer ORDER BY ts, id) AS place FROM fr),
g AS (WITH RECURSIVE g AS (SELECT array_id, observer, place, ts, id, rank, ts AS anchor FROM fo WHERE place = 1
UNION ALL SELECT o.array_id, o.observer, o.place, o.ts, o.id, o.rank, CASE WHEN o.ts - g.anchor <= INTERVAL 6 HOUR THEN g.anchor ELSE o.ts END FROM g JOIN fo o ON o.array_id = g.array_id AND o.observer = g.observer AND o.place = g.place + 1) SELECT * FROM g),
tw AS (SELECT array_id, observer, anchor, count(*) AS size, min(ts) AS earliest, max(ts) AS latest, {RANK_NAME.format("max(rank)")} AS worst_level, arg_min(id, (ts, id)) AS first_id, arg_max(id, (ts, id)) AS last_id FROM g GROUP BY 1, 2, 3)
SELECT 'storm' AS kind, 'storm of ' || size || ' alerts on ' || array_id AS label, CAST(array_id AS VARCHAR) AS key, array_id, size, earliest, latest, worst_level FROM st
UNION ALL SELECT 'root_cause', key || ': ' || size || ' related alerts', key, NULL, size, earliest, latest, worst_level FROM rc
UNION ALL SELECT CASE WHEN size > 1 THEN 'time_window' ELSE 'single' END, CASE WHEN size > 1 THEN observer || ' repeated' ELSE observer END, '', array_id, size, earliest, latest, worst_level FROM tw"""
)
def aggregated_view(spark: SparkSession, sf: str) -> DataFrame:
    return aggregate.aggregated(observed(spark, sf), 86_400, 8, 3600, 6 * 3600).drop("first_id", "last_id")


@query(f", {CAUSES}, j AS (SELECT ca.* FROM ca JOIN rc ON ca.rule = rc.rule AND ca.key = rc.key) SELECT o.id, CASE WHEN j.id IS NULL THEN 'time_window' ELSE 'root_cause' END AS kind FROM observed o LEFT JOIN j ON j.id = o.id")
def aggregated_members(spark: SparkSession, sf: str) -> DataFrame:
    return aggregate.members(observed(spark, sf), 3600, 6 * 3600).select("id", "kind")


@query(
    """, f AS (SELECT array_id, observer, ts, id, rank, message, CASE WHEN observer IN ('link_status') THEN json_extract_string(details, '$.changes[0].port') WHEN observer = 'card_info' THEN json_extract_string(details, '$.alerts[0].card') || '|' || CASE WHEN k < 50 THEN 'b' || k ELSE '?' END || '|Model,HealthState'
WHEN observer = 'error_code' AND contains(details, 'port_counters') THEN 'eth0' ELSE left(trim(regexp_replace(regexp_replace(message, '\\d+', '#', 'g'), '\\s+', ' ', 'g')), 80) END AS identity FROM observed) SELECT array_id, observer, identity, count(*) AS size, max(ts) AS latest, arg_max(message, (ts, id)) AS newest FROM f GROUP BY 1, 2, 3"""
)
def folded_by_subject(spark: SparkSession, sf: str) -> DataFrame:
    held = observed(spark, sf).withColumn("subject", views.identity(F.col("observer"), F.col("details"), F.col("message")))
    return aggregate.folded(held, "subject").select("array_id", "observer", "identity", "size", "latest", "newest")


@query(", e AS (SELECT array_id, arg_min(k, (ts, id)) AS a, arg_max(k, (ts, id)) AS b FROM observed WHERE observer = 'port_speed' AND id % 5 = 0 GROUP BY 1) SELECT array_id, CAST(a AS DOUBLE) AS from_value, CAST(b AS DOUBLE) AS to_value, 'GB' AS unit FROM e WHERE a <> b")
def message_progress_units(spark: SparkSession, sf: str) -> DataFrame:
    held = observed(spark, sf).where("observer = 'port_speed' and id % 5 = 0").withColumn("message", F.concat(F.lit("copied "), F.col("k").cast("string"), F.lit(" GB")))
    return aggregate.progress(held).select("array_id", "from_value", "to_value", "unit")


# Issues

ISSUES = """r AS (SELECT *, coalesce(contains(details, 'recovered'), false) AS rec, row_number() OVER (PARTITION BY array_id, observer ORDER BY ts DESC, id DESC) AS rn FROM observed WHERE observer NOT IN ('link_status', 'port_speed', 'disk_smart')),
n AS (SELECT a.*, b.rec AS brec, b.level AS blevel, b.rank AS brank, b.ts AS bts FROM r a LEFT JOIN r b ON a.array_id = b.array_id AND a.observer = b.observer AND b.rn = 2 WHERE a.rn = 1),
j AS (SELECT n.*, acked_at, acked_at IS NOT NULL AND NOT rec AND (coalesce(brec, false) OR coalesce(observer = 'card_info' AND blevel = 'info', false)) AS stale FROM n LEFT JOIN acks ON alert_id = id)"""


@query(
    f""", {ISSUES}, i AS (
SELECT *, unnest([{{'key': 'alarm_type:' || k, 'message': 'AlarmId:' || k || ' objType:disk'}}, {{'key': 'alarm_type:9', 'message': 'AlarmId:9 objType:'}}]) AS w, 'warning' AS il FROM j WHERE observer = 'alarm_type' AND NOT rec
UNION ALL SELECT *, unnest([{{'key': 'pcie_bandwidth:' || k || ':00.0', 'message': k || ':00.0 x16 to x8'}}, {{'key': 'pcie_bandwidth:other', 'message': 'other narrower'}}]), level FROM j WHERE observer = 'pcie_bandwidth' AND rank >= 1 AND NOT rec
UNION ALL SELECT j.*, {{'key': 'card_info:' || json_extract_string(details, '$.alerts[0].card') || ':' || f, 'message': 'card ' || json_extract_string(details, '$.alerts[0].card') || CASE WHEN k < 50 THEN ' (BoardId:b' || k || ')' ELSE '' END || ' ' || f || '=' || CASE WHEN f = 'Model' THEN 'x' ELSE 'bad' END}}, CASE WHEN f = 'Model' THEN 'error' ELSE 'warning' END FROM j, (VALUES ('Model'), ('HealthState')) t(f) WHERE observer = 'card_info' AND rank >= 1 AND NOT rec
UNION ALL SELECT *, {{'key': observer, 'message': CASE WHEN observer = 'port_error_code' THEN 'a' || k || '; b; c' ELSE message END}}, level FROM j WHERE observer IN ('cpu_usage', 'memory_leak', 'port_error_code', 'error_code') AND rank >= 1 AND NOT rec AND (observer <> 'error_code' OR id % 2 = 1))
SELECT array_id, observer, w.key AS key, il AS level, w.message AS message, id AS alert_id, CASE WHEN observer IN ('cpu_usage', 'memory_leak') AND brank >= 1 AND NOT brec THEN bts ELSE ts END AS since, ts AS latest, acked_at IS NOT NULL AND NOT stale AS suppressed FROM i"""
)
def active_issues(spark: SparkSession, sf: str) -> DataFrame:
    return issues.active(observed(spark, sf), acknowledgements(spark, sf))


@query(f", {ISSUES} SELECT id AS alert_id FROM j WHERE stale")
def stale_acks(spark: SparkSession, sf: str) -> DataFrame:
    return issues.stale_acks(observed(spark, sf), acknowledgements(spark, sf))


HELD = """, r AS (SELECT *, observer IN ('alarm_type', 'pcie_bandwidth', 'card_info') AS listing, observer NOT IN ('alarm_type', 'pcie_bandwidth', 'card_info') AND coalesce(contains(details, 'recovered'), false) AS rec
  FROM observed WHERE observer IN ('alarm_type', 'pcie_bandwidth', 'card_info', 'cpu_usage', 'memory_leak', 'port_error_code', 'error_code')),
h AS (SELECT *, json_extract_string(details, '$.alerts[0].card') AS card, json_extract_string(details, '$.alerts[0].board_id') AS board FROM r),
keyed AS (SELECT *, CASE
  WHEN observer = 'alarm_type' THEN list_transform(json_extract_string(details, '$.active_alarms[*].alarm_id'), lambda a: {'key': 'alarm_type:' || a, 'level': 'warning', 'message': 'AlarmId:' || a || ' objType:' || CASE WHEN a = '9' AND k <> 9 THEN '' ELSE 'disk' END})
  WHEN observer = 'pcie_bandwidth' THEN list_transform(json_extract_string(details, '$.downgrades[*]'), lambda d: {'key': 'pcie_bandwidth:' || split_part(d, ' ', 1), 'level': level, 'message': d})
  WHEN observer = 'card_info' THEN [
    {'key': 'card_info:' || card || ':Model', 'level': 'error', 'message': 'card ' || card || CASE WHEN board <> '' THEN ' (BoardId:' || board || ')' ELSE '' END || ' Model=x'},
    {'key': 'card_info:' || card || ':HealthState', 'level': 'warning', 'message': 'card ' || card || CASE WHEN board <> '' THEN ' (BoardId:' || board || ')' ELSE '' END || ' HealthState=bad'}]
  WHEN NOT rec AND rank >= 1 AND (observer <> 'error_code' OR id % 2 = 1) THEN [{'key': observer, 'level': level, 'message': message}] ELSE [] END AS items FROM h),
events AS (SELECT *, lead(ts) OVER (PARTITION BY array_id, observer ORDER BY ts, id) AS next FROM keyed WHERE listing OR rec OR len(items) > 0),
held AS (SELECT array_id, observer, ts, id, next, unnest(items) AS i FROM events)"""


@query(
    f"""{HELD}, c AS (SELECT array_id, observer, max((ts, id)) AS at FROM events WHERE rec GROUP BY 1, 2), n AS (SELECT array_id, observer, max((ts, id)) AS at FROM events WHERE listing GROUP BY 1, 2)
SELECT held.array_id, held.observer, i.key AS key, CASE WHEN n.at IS NULL THEN arg_max(i.level, (ts, id)) ELSE arg_max(i.level, i.message) END AS level, min(ts) AS since, max(ts) AS latest
FROM held LEFT JOIN c ON held.array_id = c.array_id AND held.observer = c.observer LEFT JOIN n ON held.array_id = n.array_id AND held.observer = n.observer
WHERE (c.at IS NULL OR (ts, id) > c.at) AND (n.at IS NULL OR (ts, id) = n.at) GROUP BY 1, 2, 3, n.at"""
)
def issues_followed(spark: SparkSession, sf: str) -> DataFrame:
    return issues.followed(observed(spark, sf)).select("array_id", "observer", "key", "level", "since", "latest")


@query(f"{HELD} SELECT array_id, observer, i.key AS key, arg_max(next, (ts, id)) AS recovered_at FROM (SELECT *, coalesce(next, TIMESTAMP '1970-01-01') AS nx FROM held) GROUP BY 1, 2, 3 HAVING arg_max(nx, (ts, id)) > TIMESTAMP '1970-01-01'")
def issue_recoveries(spark: SparkSession, sf: str) -> DataFrame:
    return issues.recoveries(observed(spark, sf))


@query(f"{HELD}, g AS (SELECT array_id, observer, arg_max((nx, i.key), (ts, id)) AS l FROM (SELECT *, coalesce(next, TIMESTAMP '1970-01-01') AS nx FROM held) GROUP BY 1, 2, i.key), o AS (SELECT array_id, observer, max(l[1]) AS recovered_at FROM g WHERE l[1] > TIMESTAMP '1970-01-01' GROUP BY 1, 2), w AS (SELECT *, row_number() OVER (PARTITION BY array_id, observer ORDER BY ts DESC, id DESC) AS rn FROM r), a AS (SELECT alert_id, acked_at - INTERVAL 3 DAY AS acked_at FROM acks) SELECT x.id AS alert_id FROM w x JOIN a ON a.alert_id = x.id LEFT JOIN w y ON y.array_id = x.array_id AND y.observer = x.observer AND y.rn = 2 LEFT JOIN o ON o.array_id = x.array_id AND o.observer = x.observer WHERE x.rn = 1 AND NOT coalesce(contains(x.details, 'recovered'), false) AND (coalesce(contains(y.details, 'recovered'), false) OR coalesce(x.observer = 'card_info' AND y.level = 'info', false) OR coalesce(o.recovered_at > a.acked_at, false))")
def stale_acks_by_recovery(spark: SparkSession, sf: str) -> DataFrame:
    """Acknowledgements, three days before the alert, that a recovery recorded later takes back."""
    found = observed(spark, sf)
    given = acknowledgements(spark, sf).withColumn("acked_at", F.col("acked_at") - F.expr("interval 3 days"))
    latest = issues.recoveries(found).groupBy("array_id", "observer").agg(F.max("recovered_at").alias("recovered_at"))
    return issues.stale_acks(found, given, latest)


@query(
    f""", s AS (SELECT array_id, CASE WHEN array_id % 7 = 0 THEN 'disconnected' ELSE 'connected' END AS state, max(ts) AS seen, count(*) FILTER (WHERE k = 3) AS n, max(rank) FILTER (WHERE k = 3) AS worst, count(*) FILTER (WHERE rank >= 2 AND k % 4 = 0) AS errors, count(*) FILTER (WHERE rank = 1 AND k % 4 = 0) AS warnings FROM alerts GROUP BY 1)
SELECT array_id, CASE WHEN state <> 'connected' THEN 'offline' WHEN n > 0 THEN CASE WHEN worst >= 2 THEN 'error' ELSE 'warning' END WHEN errors > 0 THEN 'attention' WHEN warnings > 0 THEN 'warning' ELSE 'ok' END AS status,
CASE WHEN epoch_us(TIMESTAMP '{NOW}') - epoch_us(seen) <= 300000000 THEN 'fresh' WHEN epoch_us(TIMESTAMP '{NOW}') - epoch_us(seen) <= 1800000000 THEN 'stale' ELSE 'unknown' END AS freshness FROM s"""
)
def array_status(spark: SparkSession, sf: str) -> DataFrame:
    rank, own, recent = level_rank(F.col("level")), F.col("k") == 3, F.col("k") % 4 == 0
    seen = alerts(spark, sf).groupBy("array_id").agg(F.max("ts").alias("seen"), F.count_if(own).alias("n"), F.max(F.when(own, rank)).alias("worst"), F.count_if(recent & (rank >= 2)).alias("errors"), F.count_if(recent & (rank == 1)).alias("warnings"))
    state = F.when(F.col("array_id") % 7 == 0, "disconnected").otherwise("connected")
    return seen.select("array_id", issues.status_class(state, *(F.col(c) for c in ("n", "worst", "errors", "warnings"))).alias("status"), issues.freshness(F.col("seen"), now()).alias("freshness"))


# Baselines by metric

POINTS = """p AS (SELECT id, array_id, observer, ts, unnest(map_entries(m)) AS e FROM (SELECT *, CASE
WHEN observer = 'error_code' AND contains(details, 'port_counters') THEN MAP {'error_count': k + 3.0}
WHEN observer = 'cpu_usage' AND contains(details, 'percent') AND k > 0 THEN MAP {'cpu_percent': CAST(k AS DOUBLE)}
WHEN observer = 'memory_leak' AND contains(details, 'rss') THEN MAP {'rss_mb': CAST(k AS DOUBLE), 'rss_growth_per_hour': CAST(id % 7 AS DOUBLE)}
WHEN observer = 'card_info' THEN MAP {'card_flag_count': 1.0}
WHEN observer = 'disk_smart' THEN MAP {'current_pending': CAST(k AS DOUBLE), 'value': 3.0} END AS m FROM observed) WHERE m IS NOT NULL),
q AS (SELECT id, array_id, observer, ts, e.key AS metric, CAST(e.value AS DOUBLE) AS v FROM p)"""


@query(f", {POINTS} SELECT id, metric, v AS metric_value FROM q")
def metric_extract(spark: SparkSession, sf: str) -> DataFrame:
    return baseline.metric_points(observed(spark, sf)).select("id", "metric", "metric_value")


@query(f", {POINTS} SELECT observer, metric, count(*) AS n, round(median(v), 4) AS median, round(stddev_samp(v), 4) AS deviation FROM q WHERE ts >= TIMESTAMP '{NOW}' - INTERVAL 30 DAY GROUP BY 1, 2 HAVING count(*) >= 3")
def metric_baselines(spark: SparkSession, sf: str) -> DataFrame:
    points = baseline.metric_points(observed(spark, sf)).where(F.col("ts") >= now() - F.expr("interval 30 days"))
    return baseline.learn(points, ["observer", "metric"], "metric_value").select("observer", "metric", "n", F.round("median", 4).alias("median"), F.round("deviation", 4).alias("deviation"))


@query(f", {POINTS}, b AS (SELECT observer, metric, median(v) AS md, stddev_samp(v) AS sd FROM q WHERE id % 2 = 0 AND metric <> 'value' GROUP BY 1, 2 HAVING count(*) >= 3) SELECT q.id, CASE WHEN count(md) = 0 THEN 'no_baseline' WHEN bool_or(v > md + 1 * sd) THEN 'anomalous' ELSE 'normal' END AS status FROM q LEFT JOIN b ON q.observer = b.observer AND q.metric = b.metric GROUP BY 1")
def metric_status(spark: SparkSession, sf: str) -> DataFrame:
    points = baseline.metric_points(observed(spark, sf))
    learned = baseline.learn(points.where("id % 2 = 0 and metric <> 'value'"), ["observer", "metric"], "metric_value")
    return baseline.alert_status(points, learned, ["observer", "metric"], 1.0)


@query(f", {POINTS} SELECT observer, metric, median(v) AS median FROM q GROUP BY 1, 2")
def metric_medians(spark: SparkSession, sf: str) -> DataFrame:
    """Medians of groups that are larger than any task's share."""
    points = baseline.metric_points(observed(spark, sf))
    return ranks.medians(points, ["observer", "metric"], "metric_value", small=50, bins=16)


def mined(spark: SparkSession, sf: str, gap_seconds: float) -> tuple[mining.Store, datetime]:
    """A store that has taken in all alerts in four periods, and its end."""
    held = observed(spark, sf)
    low, high = held.agg(F.min("ts"), F.max("ts")).first()
    store, before = mining.Store(spark, new_folder(spark, "mined"), gap_seconds), None
    step = (high - low) / 4
    for k in range(4):
        begin = low + k * step
        end = low + (k + 1) * step if k < 3 else high + timedelta(days=1)
        store.advance(held.where((F.col("ts") >= F.lit(begin)) & (F.col("ts") < F.lit(end))), end, before)
        before = end
    return store, before


@query(f", {POINTS} SELECT array_id, observer, metric, count(*) AS n, round(median(v), 4) AS median, round(stddev_samp(v), 4) AS deviation FROM q GROUP BY 1, 2, 3 HAVING count(*) >= 3")
def incremental_baselines(spark: SparkSession, sf: str) -> DataFrame:
    store, end = mined(spark, sf, 4 * 3600)
    return store.baselines(end, 10_000).select("array_id", "observer", "metric", "n", F.round("median", 4).alias("median"), F.round("deviation", 4).alias("deviation"))


@query(
    """, o AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY array_id ORDER BY ts, id) <= 14400000000 THEN 0 ELSE 1 END AS b FROM observed),
ep AS (SELECT *, sum(b) OVER (PARTITION BY array_id ORDER BY ts, id) AS episode FROM o),
f AS (SELECT array_id, episode, observer, min((ts, id)) AS f FROM ep GROUP BY 1, 2, 3),
pr AS (SELECT a.array_id, a.observer AS antecedent, b.observer AS consequent, (epoch_us(b.f[1]) - epoch_us(a.f[1])) AS lag_us FROM f a JOIN f b ON a.array_id = b.array_id AND a.episode = b.episode AND a.f < b.f),
s AS (SELECT array_id, observer, count(*) AS episodes FROM f GROUP BY 1, 2)
SELECT pr.array_id, antecedent, consequent, count(*) AS n, round(sum(lag_us) / count(*) / 1000000, 2) AS avg_lag_s, round(count(*) / any_value(episodes), 3) AS confidence
FROM pr JOIN s ON s.array_id = pr.array_id AND observer = antecedent GROUP BY 1, 2, 3 HAVING count(*) >= 2 AND count(*) / any_value(episodes) >= 0.15"""
)
def incremental_rules(spark: SparkSession, sf: str) -> DataFrame:
    store, end = mined(spark, sf, 4 * 3600)
    return store.rules(end, 10_000)


@query(", a AS (SELECT *, strftime(ts, '%Y-%m') AS year_month, coalesce(ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-25', false) AS archived FROM alerts) SELECT array_id, year_month, archived, count(*) AS n, min(id) AS first_id, max(id) AS last_id, max(CASE WHEN id % 3 = 0 AND ts >= TIMESTAMP '2024-01-10' THEN 'second ' || message ELSE message END) AS message FROM a GROUP BY 1, 2, 3")
def archive_merge(spark: SparkSession, sf: str) -> DataFrame:
    """All alerts archived twice, the second time with some of them changed: each counts once, archived or left to stay."""
    held = alerts(spark, sf).select("id", "array_id", "observer", "message", "ts")
    at = lambda day: F.lit(f"2024-01-{day}").cast("timestamp_ntz")
    again = held.withColumn("message", F.when((F.col("id") % 3 == 0) & (F.col("ts") >= at(10)), F.concat(F.lit("second "), "message")).otherwise(F.col("message")))
    kept, stay = archives.Archive(spark, new_folder(spark, "archive")), new_folder(spark, "hot")
    archives.move_to_archive(held, kept, new_folder(spark, "hot"), at(15), at("05"))
    archives.move_to_archive(again, kept, stay, at(25), at("05"))
    others = lifecycle.by_month(spark.read.schema(again.schema).parquet(stay)).withColumn("archived", F.lit(False))
    rows = kept.read().withColumn("archived", F.lit(True)).unionByName(others)
    return rows.groupBy("array_id", "year_month", "archived").agg(F.count("*").alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id"), F.max("message").alias("message"))


# Timeline, search, personal views, users, tasks


@query("SELECT id, left(message, 120) AS message, ts, (SELECT count(*) FROM alerts WHERE ts >= TIMESTAMP '2024-01-20' AND observer IN ('click', 'view')) AS total FROM alerts WHERE ts >= TIMESTAMP '2024-01-20' AND observer IN ('click', 'view') ORDER BY ts DESC, id DESC LIMIT 20 OFFSET 20")
def timeline(spark: SparkSession, sf: str) -> DataFrame:
    return views.timeline(alerts(spark, sf), F.lit("2024-01-20").cast("timestamp_ntz"), ("click", "view"), 20, 20).select("id", "message", "ts", "total")


ORDERED = "w AS (SELECT o_orderkey AS task_id, o_orderpriority AS name, CASE WHEN o_orderkey % 500 = 0 THEN [] ELSE [o_custkey % 97, o_custkey % 89] END AS array_ids, CAST(o_orderdate AS TIMESTAMP) AS started_at, CASE WHEN o_orderkey % 11 > 0 THEN CAST(o_orderdate AS TIMESTAMP) + to_days(CAST(o_orderkey % 40 AS INT)) END AS ended_at FROM orders)"


def ordered_windows(spark: SparkSession, sf: str) -> DataFrame:
    """A test window for each order, most of them for two arrays, some for all, one in eleven still open."""
    start, key = F.col("o_orderdate").cast("timestamp_ntz"), F.col("o_orderkey")
    arrays = F.when(key % 500 == 0, F.array().cast("array<bigint>")).otherwise(F.array(F.col("o_custkey") % 97, F.col("o_custkey") % 89).cast("array<bigint>"))
    ended = F.when(key % 11 > 0, F.timestamp_add("DAY", (key % 40).cast("int"), start))
    return table(spark, sf, "orders").select(key.alias("task_id"), F.col("o_orderpriority").alias("name"), F.lit("stress").alias("task_type"), arrays.alias("array_ids"), start.alias("started_at"), ended.alias("ended_at"))


@query(f", {ORDERED} SELECT task_id, name, started_at FROM (SELECT * FROM w WHERE started_at <= TIMESTAMP '1996-01-18' ORDER BY started_at DESC, task_id DESC LIMIT 400) WHERE len(array_ids) = 0 OR list_contains(array_ids, 5)")
def timeline_tasks(spark: SparkSession, sf: str) -> DataFrame:
    return views.overlapping(ordered_windows(spark, sf), 5, F.lit("1996-01-18").cast("timestamp_ntz"), 400).select("task_id", "name", "started_at")


@query(
    f""", {ORDERED}, s AS (SELECT l_suppkey % 97 AS array_id, CAST(l_shipdate AS TIMESTAMP) AS ts, count(*) AS c FROM lineitem GROUP BY 1, 2),
one AS (SELECT task_id, started_at, ended_at, unnest(list_distinct(array_ids)) AS array_id FROM w WHERE len(array_ids) > 0),
m AS (SELECT task_id, c FROM one JOIN s ON one.array_id = s.array_id AND s.ts >= started_at AND (ended_at IS NULL OR s.ts <= ended_at)
UNION ALL SELECT task_id, c FROM w JOIN s ON len(array_ids) = 0 AND s.ts >= started_at AND (ended_at IS NULL OR s.ts <= ended_at))
SELECT task_id, CAST(sum(c) AS BIGINT) AS n FROM m GROUP BY 1"""
)
def overlapping_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Shipments in each order's window: as many windows as orders, all over each other."""
    sent = table(spark, sf, "lineitem").groupBy((F.col("l_suppkey") % 97).alias("array_id"), F.col("l_shipdate").cast("timestamp_ntz").alias("ts")).agg(F.count("*").alias("c"))
    return tasks.summed(sent, ordered_windows(spark, sf), "c")


@query("SELECT id, ts FROM alerts WHERE level = 'error' ORDER BY ts, id LIMIT 500")
def oldest_points(spark: SparkSession, sf: str) -> DataFrame:
    return store.page(store.matching(alerts(spark, sf), level="error"), 500, newest_first=False).select("id", "ts")


@query("SELECT s_suppkey AS array_id, coalesce(n_name, 'untagged') AS tag, count(*) OVER (PARTITION BY coalesce(n_name, 'untagged')) AS in_tag FROM supplier LEFT JOIN nation ON n_nationkey = CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE s_nationkey END WHERE contains(lower(s_name), '1')", raw=True)
def arrays_by_tag(spark: SparkSession, sf: str) -> DataFrame:
    arrays = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("array_id"), F.col("s_name").alias("host"), F.when(F.col("s_suppkey") % 4 != 0, F.col("s_nationkey")).alias("tag_id"))
    tags = table(spark, sf, "nation").select(F.col("n_nationkey").alias("tag_id"), F.col("n_name").alias("name"))
    return views.found_by_tag(arrays, tags, "1").select("array_id", "tag", "in_tag")


def tags_of(spark: SparkSession, sf: str) -> DataFrame:
    one = table(spark, sf, "region").select((F.col("r_regionkey") + 100).alias("tag_id"), F.col("r_name").alias("name"), F.lit(1).alias("level"), F.lit(None).cast("int").alias("parent_id"))
    two = table(spark, sf, "nation").select(F.col("n_nationkey").alias("tag_id"), F.col("n_name").alias("name"), F.lit(2).alias("level"), F.when(F.col("n_nationkey") % 6 != 0, F.col("n_regionkey") + 100).alias("parent_id"))
    return one.unionByName(two)


TAGS = "t AS (SELECT r_regionkey + 100 AS tag_id, r_name AS name, 1 AS level, NULL AS parent_id FROM region UNION ALL SELECT n_nationkey, n_name, 2, CASE WHEN n_nationkey % 6 <> 0 THEN n_regionkey + 100 END FROM nation)"


@query(f"WITH {TAGS} SELECT CAST(t.tag_id AS INT) AS tag_id, CASE WHEN t.level = 1 THEN t.name ELSE p.name END AS l1, CASE WHEN t.level = 2 THEN t.name END AS l2 FROM t LEFT JOIN t p ON p.tag_id = t.parent_id", raw=True)
def tag_naming(spark: SparkSession, sf: str) -> DataFrame:
    return views.tag_names(tags_of(spark, sf))


@query(f"WITH {TAGS} SELECT CAST(tag_id AS INT) AS tag_id FROM t WHERE tag_id IN (101, 3) OR parent_id IN (101, 3)", raw=True)
def tag_expansion(spark: SparkSession, sf: str) -> DataFrame:
    return views.with_children(tags_of(spark, sf), (101, 3))


@query("WITH f AS (SELECT c_custkey AS array_id, CASE WHEN c_custkey % 4 = 0 THEN '  ' ELSE ' ' || c_mktsegment END AS folder FROM customer), n AS (SELECT DISTINCT trim(folder) AS name FROM f WHERE trim(folder) <> '' AND trim(folder) <> 'MACHINERY'), g AS (SELECT name, 7 + row_number() OVER (ORDER BY name) AS id FROM n UNION ALL SELECT 'MACHINERY', 7) SELECT array_id, coalesce(id, 1) AS tag_id, nullif(trim(folder), '') AS tag FROM f LEFT JOIN g ON g.name = trim(folder)", raw=True)
def folder_tags(spark: SparkSession, sf: str) -> DataFrame:
    arrays = table(spark, sf, "customer").select(F.col("c_custkey").alias("array_id"), F.when(F.col("c_custkey") % 4 == 0, "  ").otherwise(F.concat(F.lit(" "), "c_mktsegment")).alias("folder"), F.lit(1).cast("bigint").alias("tag_id"))
    tags = spark.createDataFrame([(7, "MACHINERY")], "tag_id bigint, name string")
    return views.foldered(arrays, tags)


@query("SELECT id FROM observed WHERE level = 'critical' OR observer IN ('process_crash', 'io_timeout', 'sig_monitor', 'controller_state', 'disk_state')")
def critical_alerts(spark: SparkSession, sf: str) -> DataFrame:
    return observed(spark, sf).where(views.critical(F.col("observer"), F.col("level"))).select("id")


@query("SELECT id FROM alerts WHERE array_id IN (1, 2, 3) OR array_id IN (SELECT c_custkey FROM customer WHERE c_nationkey IN (4, 9))")
def personal_view(spark: SparkSession, sf: str) -> DataFrame:
    arrays = table(spark, sf, "customer").select(F.col("c_custkey").alias("array_id"), F.col("c_nationkey").alias("tag_id"))
    # watched arrays count whether or not they are listed
    arrays = arrays.unionByName(spark.createDataFrame([(1,), (2,), (3,)], "array_id bigint"), allowMissingColumns=True)
    return views.watched(alerts(spark, sf), arrays, (1, 2, 3), (4, 9)).select("id")


@query(
    """, b AS (SELECT *, row_number() OVER (PARTITION BY observer ORDER BY ts, id) AS place FROM observed WHERE level = 'critical'),
g AS (WITH RECURSIVE g AS (SELECT observer, place, id, ts AS sent, true AS goes FROM b WHERE place = 1
UNION ALL SELECT b.observer, b.place, b.id, CASE WHEN b.ts - g.sent >= INTERVAL 24 HOUR THEN b.ts ELSE g.sent END, b.ts - g.sent >= INTERVAL 24 HOUR FROM g JOIN b ON b.observer = g.observer AND b.place = g.place + 1) SELECT * FROM g) SELECT id FROM g WHERE goes"""
)
def critical_banners(spark: SparkSession, sf: str) -> DataFrame:
    return views.banners(observed(spark, sf)).select("id")


@query("SELECT id FROM alerts WHERE ts >= TIMESTAMP '2024-01-30 12:00:00' - INTERVAL 2 HOUR ORDER BY ts DESC, id DESC LIMIT 50")
def recent_feed(spark: SparkSession, sf: str) -> DataFrame:
    return views.feed(alerts(spark, sf), F.lit("2024-01-30 12:00:00").cast("timestamp_ntz")).select("id")


def sessions_of(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").selectExpr("c_custkey", "'10.0.0.' || CAST(c_custkey AS STRING) AS ip", "CASE WHEN c_custkey % 3 = 0 THEN ' ' ELSE c_name END AS nickname", f"timestamp_ntz'{NOW}' - make_dt_interval(0, 0, CAST(c_custkey % 11 AS INT)) AS seen_at", "c_custkey % 4 <> 0 AS active")


SESSIONS = f"s AS (SELECT c_custkey, '10.0.0.' || c_custkey AS ip, CASE WHEN c_custkey % 3 = 0 THEN ' ' ELSE c_name END AS nickname, TIMESTAMP '{NOW}' - to_minutes(CAST(c_custkey % 11 AS INT)) AS seen_at, c_custkey % 4 <> 0 AS active FROM customer)"


@query(f", {SESSIONS}, l AS (SELECT '10.0.0.' || array_id AS ip, arg_max(observer, (ts, id)) AS page FROM alerts GROUP BY 1) SELECT s.ip, CASE WHEN trim(nickname) = '' THEN s.ip ELSE nickname END AS nickname, page FROM s LEFT JOIN l ON l.ip = s.ip WHERE active AND c_custkey % 11 <= 5")
def users_online(spark: SparkSession, sf: str) -> DataFrame:
    presence = alerts(spark, sf).select(F.concat(F.lit("10.0.0."), F.col("array_id").cast("string")).alias("ip"), F.col("observer").alias("page"), "ts", "id")
    return views.online(sessions_of(spark, sf), presence, now(), 5).select("ip", "nickname", "page")


@query(f", {SESSIONS} SELECT count(*) AS users, count(DISTINCT CASE WHEN trim(nickname) = '' THEN s.ip ELSE nickname END) AS names FROM s WHERE active AND c_custkey % 11 <= 5")
def users_online_count(spark: SparkSession, sf: str) -> DataFrame:
    presence = alerts(spark, sf).select(F.concat(F.lit("10.0.0."), F.col("array_id").cast("string")).alias("ip"), F.col("observer").alias("page"), "ts", "id")
    return views.online(sessions_of(spark, sf), presence, now(), 5).agg(F.count("*").alias("users"), F.count_distinct("nickname").alias("names"))


@query(
    f""", a AS (SELECT strftime(ts, '%Y-%m-%d') AS file, date_trunc('second', ts) AS t, observer, message, id FROM alerts),
h AS (SELECT DISTINCT t, observer, message FROM a WHERE id % 5 = 0), d AS (SELECT t, observer, message, min(file) AS file FROM a ANTI JOIN h USING (t, observer, message) GROUP BY 1, 2, 3)
SELECT mode, file, count(*) AS n FROM d, (VALUES ('full'), ('incremental'), ('selective')) m(mode) WHERE mode = 'full' OR mode = 'incremental' AND t >= TIMESTAMP '{NOW}' - INTERVAL 12 DAY OR mode = 'selective' AND file IN ('2024-01-03', '2024-01-11') GROUP BY 1, 2"""
)
def import_modes(spark: SparkSession, sf: str) -> DataFrame:
    """Logs of a day each, imported in three ways over alerts of which one in five is there; each line comes twice."""
    held = alerts(spark, sf).withColumn("ts", F.date_trunc("second", "ts").cast("timestamp_ntz"))
    line = F.to_json(F.struct(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"), F.col("observer").alias("observer_name"), F.upper("level").alias("level"), "message"))
    lines = held.select(F.date_format("ts", "yyyy-MM-dd").alias("file"), line.alias("value"))
    lines, known = lines.union(lines), held.where("id % 5 = 0")
    modes = [readers.imported_alerts(lines, known, mode, now(), 12, ("2024-01-03", "2024-01-11")).groupBy("file").agg(F.count("*").alias("n")).select(F.lit(mode).alias("mode"), "file", "n") for mode in readers.IMPORTS]
    return modes[0].union(modes[1]).union(modes[2])


@query(f", {SESSIONS} SELECT CASE WHEN nickname = 'Customer#000000007' THEN '10.0.0.2' ELSE ip END AS ip, nickname, seen_at FROM s WHERE c_custkey <> 2 OR NOT EXISTS (SELECT 1 FROM s x WHERE x.nickname = 'Customer#000000007')")
def nickname_claim(spark: SparkSession, sf: str) -> DataFrame:
    return views.claimed(sessions_of(spark, sf), "10.0.0.2", "Customer#000000007").select("ip", "nickname", "seen_at")


@query("SELECT o_orderkey AS id, o_orderdate AS created_at FROM orders WHERE o_orderstatus = 'F'", raw=True)
def scheduled_tasks(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("created_at"), (F.col("o_orderstatus") == "F").alias("enabled"))
    return views.tasks_listed(rows, True).select("id", "created_at")


@query("SELECT o_orderkey AS id, task_id, rn FROM (SELECT o_orderkey, o_custkey AS task_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS INT) AS rn FROM orders) WHERE rn <= 3", raw=True)
def task_results(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("task_id"), F.col("o_orderdate").alias("executed_at"))
    return views.results_per_task(rows, 3).select("id", "task_id", "rn")


@query("SELECT o_orderkey AS id FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 50", raw=True)
def recent_task_results(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("task_id"), F.col("o_orderdate").alias("executed_at"))
    return views.task_results(rows, limit=50).select("id")


@query("SELECT id FROM alerts WHERE ts >= TIMESTAMP '2024-01-10' AND observer = 'click' AND level = 'warning' ORDER BY ts DESC, id DESC LIMIT 100")
def audit_recent(spark: SparkSession, sf: str) -> DataFrame:
    logs = alerts(spark, sf).withColumnsRenamed({"observer": "action", "level": "user"})
    return views.recent_audit(logs, F.lit("2024-01-10").cast("timestamp_ntz"), "warning", "click").select("id")


STATE = "CASE k % 5 WHEN 0 THEN 'muted' WHEN 1 THEN 'recovered' WHEN 2 THEN 'expected' WHEN 3 THEN 'closed' END"


@query(
    f""", e AS (SELECT *, {STATE} AS state, CASE WHEN k % 2 = 0 THEN 'confirmed_ok' END AS review, ts + INTERVAL 5 DAY AS mute FROM alerts),
l AS (SELECT array_id || '/' || observer AS fingerprint, min(ts) AS first_seen_at, max(ts) AS last_seen_at, count(*) AS times, arg_max({{'s': state, 'r': review, 'm': mute, 'l': level}}, (ts, id)) AS z FROM e GROUP BY 1)
SELECT fingerprint, first_seen_at, last_seen_at, times, CASE WHEN z.s = 'muted' AND z.m <= TIMESTAMP '{NOW}' THEN 'active' ELSE coalesce(z.s, 'active') END AS state, coalesce(z.r, 'pending') AS review_status, z.l AS level FROM l"""
)
def alert_states(spark: SparkSession, sf: str) -> DataFrame:
    events = alerts(spark, sf).selectExpr("concat_ws('/', CAST(array_id AS STRING), observer) AS fingerprint", "ts", "id", "level", f"{STATE} AS state", "CASE WHEN k % 2 = 0 THEN 'confirmed_ok' END AS review_status", "ts + interval 5 days AS mute_until")
    return views.states(events, now())


@query(", a AS (SELECT *, row_number() OVER (PARTITION BY array_id ORDER BY ts DESC, id DESC) AS rn FROM loglines), b AS (SELECT *, row_number() OVER (PARTITION BY array_id ORDER BY ts DESC, id DESC) AS r2 FROM a WHERE rn <= 60 AND contains(lower(line), 'alarm')) SELECT id FROM b WHERE r2 <= 20")
def log_tail(spark: SparkSession, sf: str) -> DataFrame:
    return views.log_tail(log_lines(spark, sf), 20, "ALARM").select("id")


# Lifecycle of files, sources


@query("SELECT c_custkey AS id, 'array-' || c_custkey AS array_id FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT c_custkey, 'known-' || c_custkey % 10 FROM customer WHERE c_custkey % 3 <> 0 AND c_custkey % 10 < 5", raw=True)
def attributed_events(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "customer").selectExpr("c_custkey AS id", "CASE WHEN c_custkey % 3 = 0 THEN 'array-' ELSE 'push_' END || CAST(c_custkey AS STRING) AS array_id", "'ip' || CAST(c_custkey % 10 AS STRING) AS source_ip")
    hosts = spark.range(5).select(F.concat(F.lit("ip"), F.col("id").cast("string")).alias("host"), F.concat(F.lit("known-"), F.col("id").cast("string")).alias("array_id"))
    return readers.attributed(events, hosts).select("id", "array_id")


@query("WITH d AS (SELECT s_suppkey AS n, 'h' || s_suppkey // 2 AS host, CASE WHEN s_suppkey % 5 = 0 THEN 22 ELSE s_suppkey * 1000 END AS port FROM supplier) SELECT 'name ' || n AS name, host, CAST(port AS INT) AS port, CASE WHEN port NOT BETWEEN 1 AND 65535 THEN 'bad port' WHEN host IN ('h1', 'h3') THEN 'known host' WHEN row_number() OVER (PARTITION BY host, port BETWEEN 1 AND 65535 ORDER BY n) > 1 THEN 'duplicate host' END AS reason FROM d", raw=True)
def dimension_import(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "supplier").selectExpr("s_suppkey AS line", "'name ' || CAST(s_suppkey AS STRING) AS Array_Name", "' h' || CAST(s_suppkey DIV 2 AS STRING) AS IP", "CASE WHEN s_suppkey % 5 = 0 THEN 'x' ELSE CAST(s_suppkey * 1000 AS STRING) END AS ssh_port")
    known = spark.createDataFrame([("h1",), ("h3",)], "host string")
    return readers.imported(rows, known, "line").select("name", "host", "port", "reason")


@query("SELECT id, ts, observer AS port, CASE WHEN k % 2 = 0 THEN 0.0 ELSE CAST(k AS DOUBLE) END AS tx_rate, 'auto' AS mode, 'ethernet' AS protocol FROM alerts WHERE k % 7 <> 0")
def traffic_ingest(spark: SparkSession, sf: str) -> DataFrame:
    lines = alerts(spark, sf).select("id", F.when(F.col("k") % 7 == 0, "broken").otherwise(F.to_json(F.struct(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("timestamp"), F.col("observer").alias("port"), F.when(F.col("k") % 2 != 0, F.col("k").cast("double")).alias("tx_rate")))).alias("value"))
    return readers.parsed_traffic(lines, keep=("id",)).select("id", "ts", "port", "tx_rate", "mode", "protocol")


@query("SELECT array_id, ts, value AS cpu, NULL::DOUBLE AS memory FROM alerts WHERE observer = 'click' AND ts >= TIMESTAMP '2024-01-20' UNION ALL SELECT array_id, ts, NULL, value FROM alerts WHERE observer = 'view' AND ts >= TIMESTAMP '2024-01-20'")
def metrics_union(spark: SparkSession, sf: str) -> DataFrame:
    a = alerts(spark, sf).where("ts >= timestamp_ntz'2024-01-20'")
    tail = a.where("observer = 'click'").select("array_id", "ts", F.col("value").alias("cpu"))
    return readers.metrics(tail, a.where("observer = 'view'").select("array_id", "ts", F.col("value").alias("memory")))


@query("SELECT DISTINCT array_id, observer FROM alerts")
def distinct_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return alerts(spark, sf).select("array_id", "observer").distinct()


@query(", w AS (SELECT a.*, t.task_id FROM alerts a JOIN tasks t ON a.ts >= started_at AND (ended_at IS NULL OR a.ts <= ended_at) AND (len(array_ids) = 0 OR list_contains(array_ids, a.array_id))) SELECT task_id, observer, count(*) AS n, CAST(count(*) FILTER (WHERE rank = 3) AS BIGINT) AS critical FROM w GROUP BY 1, 2")
def task_by_observer(spark: SparkSession, sf: str) -> DataFrame:
    held = tasks.within(alerts(spark, sf), test_windows(spark))
    return held.groupBy("task_id", "observer").agg(F.count("*").alias("n"), F.count_if(F.col("level") == "critical").alias("critical"))


@query(", w AS (SELECT a.id, a.ts, t.task_id FROM alerts a JOIN tasks t ON a.ts >= started_at AND (ended_at IS NULL OR a.ts <= ended_at) AND (len(array_ids) = 0 OR list_contains(array_ids, a.array_id)) WHERE rank = 3) SELECT task_id, id FROM (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY ts DESC, id DESC) AS rn FROM w) WHERE rn <= 50")
def task_critical_events(spark: SparkSession, sf: str) -> DataFrame:
    held = tasks.within(store.matching(alerts(spark, sf), level="critical"), test_windows(spark))
    return store.newest(held, 50, ("task_id",)).select("task_id", "id")


@query("SELECT id FROM alerts WHERE array_id IN (3, 5) AND strftime(ts, '%Y-%m') = '2024-01'")
def archive_read(spark: SparkSession, sf: str) -> DataFrame:
    return lifecycle.archived(lifecycle.by_month(alerts(spark, sf)), (3, 5), ("2024-01",)).select("id")


@query("SELECT id FROM alerts WHERE id NOT IN (SELECT alert_id FROM acks WHERE alert_id % 14 <> 0)")
def ack_batch_undo(spark: SparkSession, sf: str) -> DataFrame:
    undone = lifecycle.undone(acknowledgements(spark, sf), alerts(spark, sf).where("id % 14 = 0").select(F.col("id").alias("alert_id")))
    return store.unacknowledged(alerts(spark, sf), undone).select("id")


@query("SELECT coalesce(a.alert_id, n.id) AS alert_id, coalesce(a.ack_type, 'dismiss') AS ack_type FROM acks a FULL JOIN (SELECT id FROM alerts WHERE id % 21 = 0 OR id % 10 = 0) n ON n.id = a.alert_id")
def ack_idempotent(spark: SparkSession, sf: str) -> DataFrame:
    asked = alerts(spark, sf).where("id % 21 = 0 or id % 10 = 0").select(F.col("id").alias("alert_id"), F.lit("dismiss").alias("ack_type"), F.col("ts").alias("acked_at"))
    return lifecycle.acknowledged(acknowledgements(spark, sf), asked, alerts(spark, sf).select(F.col("id").alias("alert_id"))).select("alert_id", "ack_type")


@query("SELECT alert_id, CASE WHEN alert_id % 3 = 0 THEN 'deferred' ELSE ack_type END AS ack_type, CASE WHEN alert_id % 3 = 0 THEN acked_at + INTERVAL 10 HOUR END AS expires_at FROM acks")
def ack_batch_modify(spark: SparkSession, sf: str) -> DataFrame:
    changes = alerts(spark, sf).where("id % 3 = 0").select(F.col("id").alias("alert_id"))
    return lifecycle.modified(acknowledgements(spark, sf).withColumn("expires_at", F.lit(None).cast("timestamp_ntz")), changes, "deferred", 10).select("alert_id", "ack_type", "expires_at")
