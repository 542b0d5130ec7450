"""The detectors' queries by name, each with its SQL for the check."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from watchgrid.operators import cards, detectors, logs, ports
from watchgrid.register import query
from watchgrid.schema import alerts, level_rank, log_lines

OVER = "OVER (PARTITION BY array_id, observer ORDER BY ts, id)"
STATES = "['Online', 'OFFLINE', 'degraded', 'fault', 'rebuilding'][CAST(k % 5 + 1 AS INT)]"


def states(spark: SparkSession, sf: str) -> DataFrame:
    """Readings of units' states."""
    state = F.element_at(F.array(*[F.lit(x) for x in ("Online", "OFFLINE", "degraded", "fault", "rebuilding")]), (F.col("k") % 5 + 1).cast("int"))
    return alerts(spark, sf).withColumn("state", state).withColumn("unit", F.col("observer"))


@query(f", s AS (SELECT *, {STATES} AS state FROM alerts), c AS (SELECT *, lag(state) {OVER} AS previous FROM s) SELECT id, previous, state, 'error' AS level FROM c WHERE coalesce(state <> previous, false) OR lower(state) IN ('offline', 'degraded', 'fault', 'absent')")
def controller_states(spark: SparkSession, sf: str) -> DataFrame:
    return detectors.controllers(states(spark, sf)).select("id", "previous", "state", "level")


@query(
    f""", s AS (SELECT *, {STATES} AS state, date_trunc('day', ts) AS cycle FROM alerts), c AS (SELECT *, lag(state) {OVER} AS previous FROM s),
b AS (SELECT * FROM c WHERE coalesce(state <> previous, false) OR lower(state) IN ('offline', 'fault', 'failed', 'degraded', 'rebuilding', 'absent'))
SELECT id, previous, state, CASE WHEN bool_or(lower(state) IN ('offline', 'fault', 'failed')) OVER (PARTITION BY array_id, cycle) THEN 'error' ELSE 'warning' END AS level FROM b"""
)
def disk_states(spark: SparkSession, sf: str) -> DataFrame:
    held = states(spark, sf).withColumn("cycle", F.date_trunc("day", "ts"))
    return detectors.disks(held, cycle=("array_id", "cycle")).select("id", "previous", "state", "level")


COUNTERS = ("rx_crc_errors", "rx_dropped", "rx_missed_errors", "collisions")
COUNTER = f"[{', '.join(repr(c) for c in COUNTERS)}][CAST(k % 4 + 1 AS INT)]"
GROWN = f"""r AS (SELECT id, array_id, ts, k, observer AS port, {COUNTER} AS counter, sum(CAST(floor(value) AS BIGINT)) OVER (PARTITION BY array_id, observer, k % 4 ORDER BY ts, id)::BIGINT AS value FROM alerts),
d AS (SELECT *, value - lag(value) OVER (PARTITION BY array_id, port, counter ORDER BY ts, id) AS delta FROM r),
g AS (SELECT *, CASE k % 4 WHEN 0 THEN 'physical_error' WHEN 1 THEN 'drop' WHEN 2 THEN 'fifo_overrun' ELSE 'generic_error' END AS category, CASE WHEN k % 4 = 0 THEN 'warning' ELSE 'info' END AS level FROM d WHERE delta > CASE WHEN k % 4 = 0 THEN 0 ELSE 10 END AND delta <= 10000000)"""


def counters(spark: SparkSession, sf: str) -> DataFrame:
    name = F.element_at(F.array(*[F.lit(c) for c in COUNTERS]), (F.col("k") % 4 + 1).cast("int"))
    held = alerts(spark, sf).withColumn("counter", name).withColumn("port", F.col("observer"))
    return held.withColumn("value", F.sum(F.floor("value").cast("bigint")).over(detectors.ordered(["array_id", "port", "counter"])))


@query(f", {GROWN} SELECT id, port, counter, category, delta, level FROM g")
def port_counters(spark: SparkSession, sf: str) -> DataFrame:
    return ports.counter_alerts(counters(spark, sf)).select("id", "port", "counter", "category", "delta", "level")


@query(f", {GROWN} SELECT id, delta FROM d WHERE delta > 0 AND delta <= 10000000")
def pcie_errors(spark: SparkSession, sf: str) -> DataFrame:
    return detectors.delta(counters(spark, sf), ["array_id", "port", "counter"], "value").select("id", "delta")


@query(
    f""", {GROWN}, p AS (SELECT array_id, date_trunc('day', ts) AS cycle, category, level, port || '.' || counter || ' +' || CAST(delta AS VARCHAR) AS message FROM g),
q AS (SELECT *, row_number() OVER (PARTITION BY array_id, cycle, category ORDER BY message) AS rn FROM p),
c AS (SELECT array_id, cycle, category, count(*) AS n, bool_or(level = 'warning') AS warned, string_agg(message, '; ' ORDER BY message) FILTER (WHERE rn <= 3) AS preview FROM q GROUP BY 1, 2, 3),
o AS (SELECT array_id, cycle, CAST(sum(n) AS BIGINT) AS n, bool_or(warned) AS warned, string_agg(CASE WHEN warned THEN category || ': ' || preview ELSE category || ' ' || CAST(n AS VARCHAR) END, ' | ' ORDER BY category) AS message FROM c GROUP BY 1, 2),
a AS (SELECT DISTINCT array_id, date_trunc('day', ts) AS cycle FROM alerts),
h AS (SELECT a.array_id, a.cycle, n, warned, message, lag(n) OVER (PARTITION BY a.array_id ORDER BY a.cycle) AS before FROM a LEFT JOIN o ON a.array_id = o.array_id AND a.cycle = o.cycle)
SELECT array_id, cycle, CASE WHEN n IS NOT NULL THEN 'alert' ELSE 'recovered' END AS event, CASE WHEN warned THEN 'warning' ELSE 'info' END AS level, coalesce(n, 0) AS n, coalesce(message, '') AS message FROM h WHERE n IS NOT NULL OR before IS NOT NULL"""
)
def port_counter_rollup(spark: SparkSession, sf: str) -> DataFrame:
    day = F.date_trunc("day", "ts").cast("timestamp_ntz")
    found = ports.counter_alerts(counters(spark, sf)).withColumn("cycle", day).withColumn("message", F.concat("port", F.lit("."), "counter", F.lit(" +"), F.col("delta").cast("string")))
    return ports.rolled_up(found, alerts(spark, sf).withColumn("cycle", day))


LISTING = "'Rx Errors: ' || CAST(k % 3 AS STRING) || chr(10) || 'tx dropped=' || CAST(k % 2 AS STRING) || chr(10) || 'InvalidCRC Count : ' || CAST(id % 4 AS STRING)"
PORT_ID = "CASE WHEN id % 3 = 0 THEN '0X11' ELSE '0x2' END || CAST(k AS STRING)"


@query(
    """, c AS (SELECT id, k, unnest([{'f': 2, 'category': 'generic_error', 'counter': 'Rx Errors', 'value': k % 3}, {'f': 2, 'category': 'drop', 'counter': 'Tx Dropped', 'value': k % 2}, {'f': 11, 'category': 'physical_error', 'counter': 'InvalidCRC Count', 'value': id % 4}]) AS c FROM alerts)
SELECT id, c.category, c.counter, CAST(c.value AS BIGINT) AS value FROM c WHERE c.value > 0 AND c.f = CASE WHEN id % 3 = 0 THEN 11 ELSE 2 END"""
)
def listed_port_errors(spark: SparkSession, sf: str) -> DataFrame:
    listings = alerts(spark, sf).selectExpr("id", f"{PORT_ID} AS port_id", f"{LISTING} AS text")
    return ports.listed_counters(listings).select("id", "category", "counter", "value")


LINK = f"""l AS (SELECT array_id, observer AS port, date_trunc('day', ts) AS cycle, arg_max(CAST(k % 2 AS VARCHAR), (ts, id)) AS carrier, arg_max(CASE WHEN k % 3 = 0 THEN 'down' ELSE 'up' END, (ts, id)) AS operstate, arg_max(CAST(k * 10 AS VARCHAR), (ts, id)) AS speed FROM alerts GROUP BY 1, 2, 3),
cy AS (SELECT array_id, cycle, lead(cycle) OVER (PARTITION BY array_id ORDER BY cycle) AS next FROM (SELECT DISTINCT array_id, cycle FROM l)),
o AS (SELECT l.*, next, lag(carrier) OVER w AS oc, lag(operstate) OVER w AS oo, lag(speed) OVER w AS os, lead(l.cycle) OVER w AS back, lag(next) OVER w AS came FROM l JOIN cy ON l.array_id = cy.array_id AND l.cycle = cy.cycle WINDOW w AS (PARTITION BY l.array_id, port ORDER BY l.cycle))"""


@query(
    f""", {LINK} SELECT array_id, port, cycle, 'link down' AS change FROM o WHERE came = cycle AND oc = '1' AND carrier = '0'
UNION ALL SELECT array_id, port, cycle, 'link up' FROM o WHERE came = cycle AND oc = '0' AND carrier = '1'
UNION ALL SELECT array_id, port, cycle, 'state ' || operstate FROM o WHERE came = cycle AND oo <> operstate AND operstate = 'down'
UNION ALL SELECT array_id, port, cycle, 'slower' FROM o WHERE came = cycle AND CAST(speed AS INT) < CAST(os AS INT)
UNION ALL SELECT array_id, port, next, 'gone' FROM o WHERE next IS NOT NULL AND (back IS NULL OR back > next) AND carrier = '1'"""
)
def link_changes(spark: SparkSession, sf: str) -> DataFrame:
    held = alerts(spark, sf).withColumn("cycle", F.date_trunc("day", "ts").cast("timestamp_ntz")).withColumn("port", F.col("observer"))
    newest = F.max_by(F.struct("k"), F.struct("ts", "id")).alias("n")
    last = held.groupBy("array_id", "port", "cycle").agg(newest)
    last = last.select("array_id", "port", "cycle", (F.col("n.k") % 2).cast("string").alias("carrier"), F.when(F.col("n.k") % 3 == 0, "down").otherwise("up").alias("operstate"), (F.col("n.k") * 10).cast("string").alias("speed"))
    return ports.link_changes(last)


BAND = f"""b AS (SELECT id, array_id, observer, ts, CASE WHEN k % 4 = 0 THEN 8 ELSE 16 END AS w, 16 AS cw, k % 5 + 1 AS s, CASE WHEN k % 7 = 0 THEN 5 ELSE 1 END AS cs FROM alerts),
o AS (SELECT *, lag(w) {OVER} AS ow, lag(s) {OVER} AS os FROM b),
d AS (SELECT *, concat_ws('; ', CASE WHEN w < cw THEN 'width below capability' END, CASE WHEN s < cs THEN 'speed below capability' END, CASE WHEN w < ow THEN 'width fell' END, CASE WHEN s < os THEN 'speed fell' END) AS what FROM o),
e AS (SELECT *, lag(what) {OVER} AS before FROM d)"""


def links_of(spark: SparkSession, sf: str) -> DataFrame:
    speed = F.element_at(F.array(*[F.lit(x) for x in ("2.5GT/s", "5GT/s", "8.0GT/s", "Gen4", "32GT/s")]), (F.col("k") % 5 + 1).cast("int"))
    return alerts(spark, sf).withColumns({"device": F.col("observer"), "width": F.when(F.col("k") % 4 == 0, "x8").otherwise("x16"), "cap_width": F.lit("x16"), "speed": speed, "cap_speed": F.when(F.col("k") % 7 == 0, "32GT/s").otherwise("2.5GT/s")})


@query(f", {BAND} SELECT id, CASE WHEN what <> '' THEN 'alert' ELSE 'recovered' END AS event, what FROM e WHERE what <> '' OR coalesce(before, '') <> ''")
def pcie_bandwidth(spark: SparkSession, sf: str) -> DataFrame:
    return ports.bandwidth(links_of(spark, sf)).select("id", "event", "what")


@query(
    f""", {BAND}, c AS (SELECT array_id, date_trunc('day', ts) AS cycle, flatten(list(CASE WHEN what = '' THEN [] ELSE list_transform(string_split(what, '; '), lambda x: observer || ' ' || x) END ORDER BY observer, ts, id)) AS d FROM d GROUP BY 1, 2),
f AS (SELECT *, lag(len(d)) OVER (PARTITION BY array_id ORDER BY cycle) AS before FROM c) SELECT array_id, cycle, CASE WHEN len(d) > 0 THEN 'alert' ELSE 'recovered' END AS event, array_to_string(d, '; ') AS what FROM f WHERE len(d) > 0 OR before > 0"""
)
def pcie_cycles(spark: SparkSession, sf: str) -> DataFrame:
    """Downgrades of all of an array's devices, a day taken as one cycle."""
    found = ports.bandwidth_cycles(links_of(spark, sf).withColumn("cycle", F.date_trunc("day", "ts").cast("timestamp_ntz")))
    return found.select("array_id", "cycle", "event", F.array_join("downgrades", "; ").alias("what"))


# Logs


@query(
    r""", c AS (SELECT *, CASE WHEN regexp_matches(line, '(?i)segfault\s+at') THEN 'segfault' WHEN regexp_matches(line, '(?i)Out\s+of\s+memory.*Killed\s+process') THEN 'oom_kill' WHEN regexp_matches(line, '(?i)kernel\s+BUG\s+at') THEN 'kernel_bug' END AS kind FROM loglines)
SELECT id, kind, CASE WHEN kind = 'segfault' THEN 'app' || array_id || '[' || id || ']' WHEN kind = 'oom_kill' THEN 'worker[' || id || ']' ELSE '' END AS process FROM c WHERE kind IS NOT NULL"""
)
def process_crashes(spark: SparkSession, sf: str) -> DataFrame:
    return logs.crashes(log_lines(spark, sf)).select("id", "kind", "process")


@query(
    r""", c AS (SELECT *, CASE WHEN regexp_matches(line, '(?i)I/O\s+error') THEN 'io_error' WHEN regexp_matches(line, '(?i)scsi\s+error') THEN 'scsi_error' WHEN regexp_matches(line, '(?i)task\s+abort') THEN 'task_abort' END AS kind FROM loglines)
SELECT array_id, count(*) AS events, string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds, CASE WHEN count(*) >= 5 THEN 'critical' ELSE 'error' END AS level FROM c WHERE kind IS NOT NULL GROUP BY 1"""
)
def io_failures(spark: SparkSession, sf: str) -> DataFrame:
    return logs.io_failures(log_lines(spark, sf), ["array_id"])


@query(r", s AS (SELECT id, unnest(regexp_extract_all(line, '(?i)\bsig\s*(\d+)\b', 1)) AS s FROM loglines) SELECT id, CAST(s AS BIGINT) AS signal FROM s WHERE CAST(s AS BIGINT) NOT IN (15, 61)")
def abnormal_signals(spark: SparkSession, sf: str) -> DataFrame:
    return logs.signals(log_lines(spark, sf)).select("id", "signal")


@query(", r AS (SELECT *, row_number() OVER (PARTITION BY array_id ORDER BY ts, id) AS total FROM loglines WHERE contains(lower(line), 'recover chiperr')) SELECT id, 'dev(0:04.' || CAST(k % 40 AS VARCHAR) || '.00)' AS slot, CASE WHEN k % 40 % 3 = 0 THEN 'slot ' || CAST(k % 40 AS VARCHAR) END AS slot_id, CAST(total AS INT) AS total, 'Jan  5 10:00:00' AS at FROM r")
def card_recoveries(spark: SparkSession, sf: str) -> DataFrame:
    slots = spark.range(0, 40, 3).select(F.concat(F.lit("0:04."), F.lpad(F.col("id").cast("string"), 2, "0"), F.lit(".0")).alias("bus"), F.concat(F.lit("slot "), F.col("id").cast("string")).alias("slot_id"))
    return cards.with_slot(logs.recoveries(log_lines(spark, sf), ["array_id"]), slots).select("id", "slot", "slot_id", "total", "at")


ALARMS = """a AS (SELECT id, array_id, ts, CASE WHEN k % 12 = 5 THEN 1 WHEN k % 12 = 6 THEN 2 WHEN k % 12 = 7 THEN 0 ELSE k % 3 END AS t, CASE WHEN k % 12 IN (5, 6) THEN CAST(id % 3 AS VARCHAR) WHEN k % 12 = 11 THEN CAST(id % 5 AS VARCHAR) END AS alarm_id,
CASE WHEN k % 12 = 7 THEN 'fan' WHEN k % 12 = 11 THEN 'fan ' || k ELSE 'disk' END AS name, CASE WHEN k % 12 = 5 OR k % 12 = 11 THEN 'fault' WHEN k % 12 = 6 THEN 'resume' ELSE 'event' END AS action FROM loglines WHERE k % 12 IN (5, 6, 7, 11))"""


@query(f", {ALARMS} SELECT id, CAST(t AS INT) AS alarm_type, action, alarm_id, name FROM a")
def alarm_texts(spark: SparkSession, sf: str) -> DataFrame:
    return log_lines(spark, sf).withColumn("a", logs.alarm(F.col("line"))).where("a is not null").select("id", "a.alarm_type", "a.action", "a.alarm_id", "a.name")


#: Lines of a log, which don't know the form in brackets.
ALARM_LINES = ALARMS.replace("(5, 6, 7, 11))", "(5, 6, 7))")


@query(
    f""", {ALARM_LINES}, r AS (SELECT *, CASE WHEN t = 0 THEN true ELSE alarm_id IS NOT NULL AND coalesce(max(CAST(t = 2 AS INT)) OVER (PARTITION BY array_id, alarm_id ORDER BY ts, id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) = 1 END AS recovered,
count(*) FILTER (WHERE t = 0) OVER (PARTITION BY array_id) AS total_events, count(*) FILTER (WHERE t = 1) OVER (PARTITION BY array_id) AS total_faults, count(*) FILTER (WHERE t = 2) OVER (PARTITION BY array_id) AS total_resumes FROM a),
n AS (SELECT *, row_number() OVER (PARTITION BY array_id ORDER BY ts DESC, id DESC) AS rn FROM r WHERE t <> 2) SELECT id, alarm_id, recovered, total_events, total_faults, total_resumes FROM n WHERE rn <= 5"""
)
def recent_alarms(spark: SparkSession, sf: str) -> DataFrame:
    return logs.alarms(log_lines(spark, sf), ["array_id"]).select("id", "alarm_id", "recovered", "total_events", "total_faults", "total_resumes")


@query(f", {ALARM_LINES} SELECT array_id, alarm_id, arg_max(name, (ts, id)) AS name, max(ts) AS ts, arg_max(id, (ts, id)) AS id FROM a WHERE t IN (1, 2) AND alarm_id IS NOT NULL GROUP BY 1, 2 HAVING arg_max(t, (ts, id)) = 1")
def active_alarms(spark: SparkSession, sf: str) -> DataFrame:
    return logs.active_alarms(log_lines(spark, sf), ["array_id"])


RESET_LOG = "'Reason: ' || CASE k % 3 WHEN 0 THEN 'WatchDog reset' WHEN 1 THEN 'power key' ELSE 'an OOM reset.' END || chr(10) || 'time: t' || CAST(k AS STRING) || chr(10) || chr(10) || 'time : t' || CAST(k % 2 AS STRING) || chr(10) || 'reason: mce reset'"


@query("SELECT array_id, 't' || k AS time, CASE k % 3 WHEN 0 THEN 'WatchDog reset' ELSE 'an OOM reset.' END AS reason FROM alerts WHERE k % 3 <> 1 AND k > 1 GROUP BY ALL UNION ALL SELECT array_id, 't' || k % 2, CASE WHEN bool_or(k = 0 AND k % 2 = 0) THEN 'WatchDog reset' ELSE 'mce reset' END FROM alerts GROUP BY array_id, k % 2")
def abnormal_resets(spark: SparkSession, sf: str) -> DataFrame:
    return logs.resets(alerts(spark, sf).selectExpr("array_id", f"{RESET_LOG} AS text"), ["array_id"])


MODULES = "CASE WHEN k = 0 THEN NULL WHEN k = 1 THEN 'nothing here' ELSE 'sys: 1' || chr(10) || '  app : ' || CAST(k % 2 AS STRING) || chr(10) || 'sys: ' || CAST(CASE WHEN k % 5 = 0 THEN 0 ELSE 1 END AS STRING) END"


@query("SELECT id, k > 1 AND k % 2 = 1 AND k % 5 <> 0 AS started, CASE WHEN k = 0 THEN 'command_failed' WHEN k = 1 THEN 'parse_failed' WHEN k % 2 = 0 OR k % 5 = 0 THEN 'not_started' END AS reason, CASE WHEN k <= 1 THEN '' ELSE concat_ws(',', CASE WHEN k % 2 = 0 THEN 'app' END, CASE WHEN k % 5 = 0 THEN 'sys' END) END AS failed, CASE WHEN k <= 1 THEN 0 ELSE 2 END AS modules FROM alerts")
def start_work(spark: SparkSession, sf: str) -> DataFrame:
    return logs.started(alerts(spark, sf).selectExpr("id", f"{MODULES} AS text"), ["id"])


@query(", m AS (SELECT *, CASE WHEN observer = 'error' THEN k % 3 <> 0 END AS st FROM alerts), l AS (SELECT *, last_value(st IGNORE NULLS) OVER (PARTITION BY array_id ORDER BY ts, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS works FROM m) SELECT id FROM l WHERE observer <> 'error' AND (coalesce(works, true) OR observer = 'click')")
def gated_results(spark: SparkSession, sf: str) -> DataFrame:
    a = alerts(spark, sf)
    starts = a.where("observer = 'error'").select("array_id", "ts", (F.col("k") % 3 != 0).alias("started"))
    return logs.gated(a.where("observer <> 'error'"), starts, gate="click").select("id")


@query("SELECT id, round(value / 100, 4) AS elapsed_s, 'error' AS level FROM alerts WHERE value / 100 > 1.0")
def slow_commands(spark: SparkSession, sf: str) -> DataFrame:
    return logs.slow_commands(alerts(spark, sf).select("id", (F.col("value") / 100).alias("elapsed_s"))).select("id", F.round("elapsed_s", 4).alias("elapsed_s"), "level")


@query(f", p AS (SELECT *, lag(k) {OVER} AS previous FROM alerts) SELECT id, CAST(previous AS BIGINT) AS previous, CAST(k AS BIGINT) AS v FROM p WHERE k > previous")
def process_restarts(spark: SparkSession, sf: str) -> DataFrame:
    text = F.concat(F.lit("root grep devm -v 999\nroot /bin/DEVM -v "), F.col("k").cast("string"), F.lit("\nroot devm -v 0\nroot other -v 500"))
    return logs.restarted(alerts(spark, sf).withColumn("text", text), ["array_id", "observer"], "devm").select("id", "previous", "v")


@query(
    """, i AS (SELECT id, unnest([CASE WHEN k >= 90 THEN 'temperature' END, CASE WHEN k % 3 = 0 THEN 'health' END, CASE WHEN k % 4 = 0 THEN 'running' END, CASE WHEN k % 5 = 0 THEN 'speed unknown' WHEN k % 5 = 1 THEN 'speed differs' END]) AS issue FROM alerts)
SELECT id, 'P1' AS name, CAST(id AS VARCHAR) AS port_id, issue FROM i WHERE issue IS NOT NULL"""
)
def transceiver_issues(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("k")
    text = F.concat(
        F.lit("PortId: "), F.col("id").cast("string"), F.lit("\nName : P1\nTempReal(`C): "), (k + 15).cast("string"), F.lit("\nHealthState: "), F.when(k % 3 == 0, "Fault").otherwise("Normal"),
        F.lit("\nRunningState: "), F.when(k % 4 == 0, "LINK_DOWN").otherwise("link_up"), F.lit("\nRunSpeed: "), F.when(k % 5 == 0, "Unknown Speed").when(k % 5 == 1, "8G").otherwise("16g"), F.lit("\nMaxSpeed: 16G\n-----\n\n"),
    )
    return logs.transceivers(alerts(spark, sf).select("id", text.alias("text")), ["id"])


# The reporter


@query(
    """, o AS (SELECT *, k % 9 = 0 AS sticky, row_number() OVER (PARTITION BY observer, message ORDER BY ts, id) AS place FROM alerts WHERE rank >= 1),
g AS (WITH RECURSIVE g AS (SELECT observer, message, place, id, ts AS sent, true AS goes FROM o WHERE place = 1
UNION ALL SELECT o.observer, o.message, o.place, o.id, CASE WHEN o.sticky OR o.ts - g.sent >= INTERVAL 48 HOUR THEN o.ts ELSE g.sent END, o.sticky OR o.ts - g.sent >= INTERVAL 48 HOUR FROM g JOIN o ON o.observer = g.observer AND o.message = g.message AND o.place = g.place + 1) SELECT * FROM g)
SELECT id FROM g WHERE goes"""
)
def reporter_gate(spark: SparkSession, sf: str) -> DataFrame:
    held = alerts(spark, sf).withColumn("sticky", F.col("k") % 9 == 0)
    return detectors.reported(held, seconds=48 * 3600, min_level="warning").select("id")


@query(f", f AS (SELECT *, sum(CAST(rank = 0 AS INT)) {OVER} AS others FROM alerts), s AS (SELECT *, row_number() OVER (PARTITION BY array_id, observer, others ORDER BY ts, id) AS streak FROM f WHERE rank >= 1) SELECT id, streak, CASE WHEN streak >= 3 THEN 'error' ELSE 'warning' END AS logged, streak % 4 = 0 AS alerts FROM s")
def failure_streaks(spark: SparkSession, sf: str) -> DataFrame:
    return detectors.failures(alerts(spark, sf), ["array_id", "observer"], level_rank(F.col("level")) >= 1, 3, 4).select("id", "streak", "logged", "alerts")


# Composed detectors that share the families


@query(f", u AS (SELECT *, greatest(0, least(100, value / 2)) AS usage FROM alerts), h AS (SELECT *, usage >= 45 AS high FROM u), t AS (SELECT *, CAST(coalesce(lag(high) {OVER}, false) <> high AS INT) AS turns FROM h), i AS (SELECT *, sum(turns) {OVER} AS island FROM t), s AS (SELECT *, row_number() OVER (PARTITION BY array_id, observer, island ORDER BY ts, id) AS streak FROM i), p AS (SELECT *, lag(CASE WHEN high THEN streak ELSE 0 END) {OVER} AS before FROM s) SELECT id, CASE WHEN high THEN 'error' ELSE 'info' END AS alert_level, CASE WHEN high AND streak = 2 THEN 'enter' WHEN high THEN 'stay' ELSE 'recovered' END AS event FROM p WHERE high AND streak >= 2 OR NOT high AND before >= 2")
def cpu_high(spark: SparkSession, sf: str) -> DataFrame:
    held = alerts(spark, sf).withColumn("usage", F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.col("value") / 2)))
    return detectors.latched(held, ["array_id", "observer"], "usage", 45, 2).select("id", "alert_level", "event")


LEVELS_SQL = """h AS (SELECT *, CASE WHEN value >= 150 THEN 'critical' WHEN value >= 75 THEN 'warning' END AS al FROM alerts), p AS (SELECT *, lag(al) OVER (PARTITION BY array_id, observer ORDER BY ts, id) AS before FROM h)"""


@query(f", {LEVELS_SQL} SELECT id, CASE WHEN al IS NOT NULL THEN 'alert' ELSE 'recovered' END AS event, coalesce(al, 'info') AS alert_level FROM p WHERE al IS NOT NULL OR before IS NOT NULL")
def level_detectors(spark: SparkSession, sf: str) -> DataFrame:
    return detectors.leveled(alerts(spark, sf), ["array_id", "observer"], "value", ((75, "warning"), (150, "critical"))).select("id", "event", "alert_level")


@query(f", c AS (SELECT *, value - lag(value) {OVER} AS g, (epoch_us(ts) - lag(epoch_us(ts)) {OVER}) / 1000000.0 AS s FROM alerts), f AS (SELECT *, coalesce(s > 0 AND g >= 0 AND g / s > 0.0002, false) AS high, s IS NOT NULL AS known FROM c), r AS (SELECT *, min(CAST(high AS INT)) OVER (PARTITION BY array_id, observer ORDER BY ts, id ROWS 2 PRECEDING) AS a FROM f), p AS (SELECT *, lag(a) {OVER} AS before FROM r) SELECT id, CASE WHEN a = 1 THEN 'alert' ELSE 'recovered' END AS event FROM p WHERE a = 1 OR coalesce(before, 0) = 1")
def disk_io(spark: SparkSession, sf: str) -> DataFrame:
    return detectors.sustained_rate(alerts(spark, sf), ["array_id", "observer"], "value", 0.0002, 3).select("id", "event")


@query(f", p AS (SELECT *, lag(k) {OVER} AS bk, lag(CASE WHEN k % 2 = 0 THEN ['a' || k, 'usb reset'] ELSE ['a' || k, 'b' || k % 3] END) {OVER} AS old, CASE WHEN k % 2 = 0 THEN ['a' || k, 'usb reset'] ELSE ['a' || k, 'b' || k % 3] END AS now FROM alerts), f AS (SELECT id, list_filter(now, lambda x: NOT list_contains(coalesce(old, []), x) AND NOT contains(x, 'usb')) AS fresh FROM p) SELECT id, CAST(len(fresh) AS INT) AS n, CASE WHEN len(fresh) <= 1 THEN 'warning' ELSE 'error' END AS alert_level FROM f WHERE len(fresh) > 0")
def dmesg_errors(spark: SparkSession, sf: str) -> DataFrame:
    a = F.concat(F.lit("a"), F.col("k").cast("string"))
    now = F.when(F.col("k") % 2 == 0, F.array(a, F.lit("usb reset"))).otherwise(F.array(a, F.concat(F.lit("b"), (F.col("k") % 3).cast("string"))))
    return detectors.fresh_lines(alerts(spark, sf).withColumn("lines", now), ["array_id", "observer"], "lines", "usb", 1).select("id", "n", "alert_level")


@query(f", c AS (SELECT *, lag(value) {OVER} AS previous FROM alerts) SELECT id, CASE WHEN value < previous - 60 THEN 'reboot' ELSE 'first boot' END AS event FROM c WHERE value < previous - 60 OR previous IS NULL AND value < 30")
def uptime_events(spark: SparkSession, sf: str) -> DataFrame:
    return detectors.boots(alerts(spark, sf), ["array_id", "observer"], "value", 60, 30).select("id", "event")
