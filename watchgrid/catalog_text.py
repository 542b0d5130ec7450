"""Queries of text extraction, card listings and sensitive data, each with its SQL for the check."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from watchgrid.functions import templates
from watchgrid.functions import text as tx
from watchgrid.operators import cards, detectors, lifecycle, logs
from watchgrid.register import query
from watchgrid.schema import alerts, log_lines, table

# Command output built from alerts, shared by Spark and the checks' SQL

OUTPUT = "'# state' || chr(10) || 'Name = eth' || CAST(k AS STRING) || chr(10) || 'speed: ' || CAST(id % 100 AS STRING) || chr(10) || 'a=b:c' || chr(10) || 'name=last'"


def outputs(spark: SparkSession, sf: str) -> DataFrame:
    return alerts(spark, sf).selectExpr("id", "k", f"{OUTPUT} AS text")


@query("SELECT id, 'eth' || k AS name, CAST(id % 100 AS VARCHAR) AS speed, NULL::VARCHAR AS colon, 'b:c' AS a FROM alerts")
def key_values(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("text")
    return outputs(spark, sf).select("id", tx.key_value(t, "NAME").alias("name"), tx.key_value(t, "speed").alias("speed"), tx.key_value(t, "a=b").alias("colon"), tx.key_value(t, "a").alias("a"))


@query("SELECT id, 'eth' || k AS upper_name, 'last' AS name, CAST(id % 100 AS VARCHAR) AS speed, 4 AS n FROM alerts")
def key_value_pairs(spark: SparkSession, sf: str) -> DataFrame:
    held = outputs(spark, sf).withColumn("m", tx.pairs(F.col("text")))
    return held.select("id", F.col("m")["Name"].alias("upper_name"), F.col("m")["name"].alias("name"), F.col("m")["speed"].alias("speed"), F.size("m").alias("n"))


@query("SELECT id, CASE WHEN k % 3 = 0 THEN NULL ELSE CAST(k AS VARCHAR) END AS cell, CAST(id AS VARCHAR) AS last, CAST(id % 9 AS VARCHAR) AS number FROM alerts")
def pipes(spark: SparkSession, sf: str) -> DataFrame:
    text = F.concat(F.when(F.col("k") % 3 == 0, "none here\n").otherwise(F.concat(F.lit("eth0 up "), F.col("k").cast("string"), F.lit(" x\n"))), F.lit("id;"), F.col("id").cast("string"), F.lit("\n[v"), (F.col("id") % 9).cast("string"), F.lit("]"))
    t = text
    return alerts(spark, sf).select("id", tx.pipe(t, "eth", r"\s+", 2).alias("cell"), tx.pipe(t, "^id", ";", -1).alias("last"), tx.pipe(t, r"^\[", strip="[]", pattern=r"v(\d+)").alias("number"))


@query("SELECT id, CAST(k AS VARCHAR) AS state, 'p2' AS port FROM alerts")
def table_cells(spark: SparkSession, sf: str) -> DataFrame:
    text = F.concat(F.lit("port  link_state  rate\np1  up  1\np2   "), F.col("k").cast("string"), F.lit("  7"))
    return alerts(spark, sf).select("id", tx.table_cell(text, "STATE", 2).alias("state"), tx.table_cell(text, "port", 2).alias("port"))


@query("SELECT id, len(regexp_extract_all(line, '(\\d+)', 1)) AS numbers, coalesce(regexp_extract_all(line, '([A-Z])(\\w+)', 2)[1], '') AS tail FROM loglines")
def named_fields(spark: SparkSession, sf: str) -> DataFrame:
    held = log_lines(spark, sf).withColumn("f", tx.fields(F.col("line"), {"numbers": r"(\d+)", "tails": r"[A-Z](\w+)"}))
    return held.select("id", F.size(F.col("f")["numbers"]).cast("bigint").alias("numbers"), F.coalesce(F.try_element_at(F.col("f")["tails"], F.lit(1)), F.lit("")).alias("tail"))


TESTS = {"==": "k = 50", "!=": "k <> 50", ">": "k > 50", ">=": "k >= 50", "<": "k < 50", "<=": "k <= 50", "contains": "contains(CAST(k AS VARCHAR), '50')", "not_contains": "NOT contains(CAST(k AS VARCHAR), '50')", "matches": "regexp_matches(CAST(k AS VARCHAR), '50')", "not_matches": "NOT regexp_matches(CAST(k AS VARCHAR), '50')"}


@query(f"SELECT id, {', '.join(f'{sql} AS t{n}' for n, sql in enumerate(TESTS.values()))} FROM alerts")
def comparisons(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("k").cast("string")
    return alerts(spark, sf).select("id", *[tx.holds(k, op, "50").alias(f"t{n}") for n, op in enumerate(TESTS)])


@query("SELECT id, k >= 10 AS found, k < 10 AS not_found, k >= 10 AND k > 50 AS gt, k < 10 OR k < 50 AS lt, k = 50 AS eq, k <> 50 AS ne FROM alerts")
def conditions(spark: SparkSession, sf: str) -> DataFrame:
    value = F.when(F.col("k") >= 10, F.col("k").cast("string"))
    return alerts(spark, sf).select("id", *[tx.condition(value, value.isNotNull(), op, "50").alias(op) for op in ("found", "not_found", "gt", "lt", "eq", "ne")])


@query(
    """SELECT id, CASE WHEN k % 6 = 0 THEN 'error' ELSE 'ok' END AS state, t AS template, n,
CASE WHEN k % 6 = 0 THEN 'abnormal' WHEN t IN ('memory_use', 'cpu_load') THEN 'normal' WHEN t IN ('raid_health', 'disk_state', 'network') AND k % 2 = 1 THEN 'normal' ELSE 'abnormal' END AS verdict
FROM (SELECT *, CASE t WHEN 'memory_use' THEN 2 WHEN 'cpu_load' THEN 0 WHEN 'service_state' THEN 0 WHEN 'raid_health' THEN CAST(k % 2 AS INT) ELSE CAST(k % 2 AS INT) END AS n FROM alerts, (VALUES ('disk_state'), ('raid_health'), ('service_state'), ('memory_use'), ('cpu_load'), ('network')) x(t))"""
)
def template_results(spark: SparkSession, sf: str) -> DataFrame:
    said = F.when(F.col("k") % 2 == 1, "md0 INACTIVE\nMem: 10 20\n1 received").otherwise("fine\nMem: 10 20")
    runs = alerts(spark, sf).select("id", F.when(F.col("k") % 6 == 0, -1).otherwise(0).alias("exit_code"), said.alias("stdout"), F.lit("").alias("stderr"))
    return templates.executed(runs, templates.BUILT_IN).select("id", "state", "template", F.size("found").alias("n"), "verdict")


@query("SELECT c_custkey AS id, contains(lower(c_name), 'omer#00000001') OR contains(lower(c_name), '000003') AS blocked FROM customer", raw=True)
def nickname_filter(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), tx.blocked(F.col("c_name"), ("OMER#00000001", "000003")).alias("blocked"))


@query("SELECT id, CAST(CASE WHEN k % 4 = 0 THEN 7 WHEN k % 4 = 1 THEN k ELSE -1 END AS BIGINT) AS whole, CAST(CASE WHEN k % 4 = 2 THEN 0.5 ELSE 1.5 END AS DOUBLE) AS part FROM alerts")
def safe_numbers(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("k")
    text = F.when(k % 4 == 0, " 7 ").when(k % 4 == 1, k.cast("string")).when(k % 4 == 2, "x1")
    return alerts(spark, sf).select("id", tx.safe_int(text, -1).alias("whole"), tx.safe_number(F.when(k % 4 == 2, "0.5").otherwise("none"), 1.5).alias("part"))


@query("SELECT id, CASE k % 12 WHEN 5 THEN '2024-01-05 10:00:00' WHEN 6 THEN '12.5' WHEN 8 THEN 'Jan  5 10:00:00' ELSE CASE WHEN k % 12 = 0 THEN NULL END END AS stamp FROM loglines")
def line_stamps(spark: SparkSession, sf: str) -> DataFrame:
    return log_lines(spark, sf).select("id", tx.stamp(F.col("line")).alias("stamp"))


# Card listings

CARDS = """'head' || chr(10) || 'No001  BoardId: b' || CAST(k AS STRING) || chr(10) || 'no001 RunningState: ' || CASE WHEN k % 3 = 0 THEN 'STOPPED' ELSE 'RUNNING' END || chr(10) || 'HealthState = NORMAL' || chr(10) || 'Model: m1' || chr(10) || 'Model: ' || CASE WHEN k % 4 = 0 THEN 'undefined' ELSE 'm2' END || chr(10) || '-----' || chr(10) || 'stray: 1' || chr(10) || 'No002' || chr(10) || 'CardNo: c' || CAST(id % 5 AS STRING)"""


def listings(spark: SparkSession, sf: str) -> DataFrame:
    return alerts(spark, sf).selectExpr("id", "array_id", "ts", f"{CARDS} AS text")


@query("SELECT id, CAST(1 AS INT) AS block, 'No001' AS card_no, 'b' || k AS board_id, CASE WHEN k % 3 = 0 THEN 'STOPPED' ELSE 'RUNNING' END AS running_state, 'NORMAL' AS health_state, CASE WHEN k % 4 = 0 THEN '' ELSE 'm2' END AS model, 3 AS raw FROM alerts WHERE false UNION ALL SELECT id, 1, 'No001', 'b' || k, '', '', '', 1 FROM alerts UNION ALL SELECT id, 2, 'no001', '', CASE WHEN k % 3 = 0 THEN 'STOPPED' ELSE 'RUNNING' END, 'NORMAL', CASE WHEN k % 4 = 0 THEN '' ELSE 'm2' END, 2 FROM alerts UNION ALL SELECT id, 8, 'c' || id % 5, '', '', '', '', 1 FROM alerts")
def card_records(spark: SparkSession, sf: str) -> DataFrame:
    return cards.records(listings(spark, sf), ["id"]).withColumn("raw", F.size("raw"))


@query("WITH RECURSIVE x AS (SELECT 1) SELECT event_id AS id, card_no, field, level FROM events, (VALUES ('No001', 'running_state', 'warning', 0), ('No001', 'health_state', 'warning', 0), ('No001', 'model', 'warning', 0), ('no001', 'running_state', 'error', 3), ('no001', 'model', 'warning', 4), ('c', 'running_state', 'warning', 0), ('c', 'health_state', 'warning', 0), ('c', 'model', 'warning', 0)) v(card_no, field, level, m) WHERE m = 0 OR CAST(json_extract_string(props, '$.k') AS INT) % m = 0", raw=True)
def card_assertions(spark: SparkSession, sf: str) -> DataFrame:
    found = cards.assertions(cards.records(listings(spark, sf), ["id"]))
    return found.select("id", F.regexp_replace("card_no", r"^c\d$", "c").alias("card_no"), "field", "level")


@query(
    """, c AS (SELECT array_id, CASE WHEN k % 3 = 0 THEN '' ELSE 'b' || k END AS board_id, 'n' || k AS card_no, id AS block, ts FROM alerts),
h AS (SELECT array_id, board_id, card_no, min(block) AS block FROM c WHERE block % 2 = 0 AND board_id <> '' GROUP BY 1, 2, 3),
f AS (SELECT * FROM c WHERE block % 2 = 1 AND board_id <> '' QUALIFY row_number() OVER (PARTITION BY array_id, board_id ORDER BY block) = 1)
SELECT coalesce(f.array_id, h.array_id) AS array_id, coalesce(f.board_id, h.board_id) AS board_id, coalesce(f.card_no, h.card_no) AS card_no, CASE WHEN f.block IS NULL THEN 'old' ELSE 'new' END AS model FROM h FULL JOIN f ON h.array_id = f.array_id AND h.board_id = f.board_id"""
)
def card_upsert(spark: SparkSession, sf: str) -> DataFrame:
    held = alerts(spark, sf).where("k % 3 <> 0").selectExpr("array_id", "'b' || CAST(k AS STRING) AS board_id", "'n' || CAST(k AS STRING) AS card_no", "'' AS running_state", "'' AS health_state", "id AS block")
    old = held.where("block % 2 = 0").withColumn("model", F.lit("old")).drop("block").distinct()
    return cards.upserted(old, held.where("block % 2 = 1").withColumn("model", F.lit("new"))).select("array_id", "board_id", "card_no", "model")


@query("SELECT * FROM (SELECT array_id, board_id, arg_min(id, id) AS id FROM (SELECT *, 'b' || k AS board_id FROM alerts WHERE k % 5 > 0) GROUP BY 1, 2) UNION ALL SELECT array_id, '', id FROM alerts WHERE k % 5 = 0")
def cards_in_batch(spark: SparkSession, sf: str) -> DataFrame:
    rows = alerts(spark, sf).selectExpr("array_id", "id", "CASE WHEN k % 5 > 0 THEN 'b' || CAST(k AS STRING) ELSE '' END AS board_id")
    keyed = rows.withColumn("key", F.when(F.col("board_id") != "", F.concat_ws("/", F.col("array_id").cast("string"), "board_id")).otherwise(""))
    return lifecycle.first_by(keyed, "key", ["id"]).drop("key")


# Sensitive data


def quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def either(patterns) -> str:
    return quoted("(?i)" + "|".join(f"(?:{p})" for p in patterns))


def found_in_sql() -> str:
    """The scan of one line in the checks' SQL, from the same fixed patterns."""
    parts = []
    for k, (category, pattern) in enumerate(logs.SENSITIVE):
        parts.append(f"SELECT id, '{category}' AS category, {k} AS pattern, unnest(regexp_extract_all(line, {quoted('(?i)' + pattern)}, 1)) AS v FROM o")
    stand_ins, settings = ", ".join(map(quoted, logs.STAND_INS)), ", ".join(map(quoted, logs.SETTINGS))
    ends = " OR ".join(f"ends_with(lower(v), '{e}')" for e in logs.SETTING_ENDS)
    return f""", i AS (SELECT doc_id * 1000000 AS id, unnest(string_split(text, chr(10))) AS line FROM documents UNION ALL SELECT id, line FROM loglines),
o AS (SELECT * FROM i WHERE NOT regexp_matches(line, {either((*logs.SAFE, *logs.ABOUT))})),
f AS ({' UNION ALL '.join(parts)}),
g AS (SELECT * FROM f WHERE NOT regexp_matches(lower(trim(v)), '^[*\\-_x.]*$') AND lower(trim(v)) NOT IN ({stand_ins}) AND NOT regexp_matches(v, '^\\$\\{{?\\w+\\}}?$')
AND (category NOT IN ('password', 'secret') OR (length(v) BETWEEN 6 AND 64 AND NOT regexp_matches(v, '^[0-9]+$') AND lower(v) NOT IN ({settings}) AND NOT (starts_with(v, '/') OR starts_with(v, './') OR starts_with(v, '..')) AND NOT (regexp_matches(v, '^[a-z][a-z0-9_]+$') AND contains(v, '_') AND (NOT regexp_matches(v, '[0-9]') OR length(v) < 10)) AND NOT ({ends}))))
SELECT id, category, CAST(pattern AS INT) AS pattern, CASE WHEN length(v) <= 4 THEN '***' ELSE left(v, 2) || '***' || right(v, 2) END AS shown FROM g"""


@query(found_in_sql())
def sensitive_scan(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select((F.col("doc_id") * 1_000_000).alias("id"), F.explode(F.split("text", "\n")).alias("line"))
    return logs.sensitive(docs.unionByName(log_lines(spark, sf).select("id", "line"))).select("id", "category", "pattern", "shown")


@query(
    """, s AS (SELECT id, ts, array_id, k % 3 AS category FROM alerts WHERE k % 12 IN (9, 10, 11)), o AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY ts, id) AS place FROM s),
g AS (WITH RECURSIVE g AS (SELECT category, place, id, ts AS sent, true AS goes FROM o WHERE place = 1
UNION ALL SELECT o.category, o.place, o.id, CASE WHEN o.ts - g.sent >= INTERVAL 3 HOUR THEN o.ts ELSE g.sent END, o.ts - g.sent >= INTERVAL 3 HOUR FROM g JOIN o ON o.category = g.category AND o.place = g.place + 1) SELECT * FROM g) SELECT id FROM g WHERE goes"""
)
def sensitive_cooled(spark: SparkSession, sf: str) -> DataFrame:
    found = alerts(spark, sf).where("k % 12 in (9, 10, 11)").withColumn("category", F.col("k") % 3)
    return detectors.cooled(found, ["category"], 3 * 3600).select("id")


@query("SELECT id, CAST(k AS VARCHAR) AS used, CASE WHEN k % 2 = 0 THEN 'x' || id END AS tabbed, CASE WHEN k % 3 = 0 THEN 'no json' END AS raw, CASE WHEN k % 3 > 0 THEN CAST(k AS VARCHAR) END AS member, k || chr(9) || 'y' AS whole FROM alerts")
def parsed_outputs(spark: SparkSession, sf: str) -> DataFrame:
    """Output of commands as key and value lines, as JSON and as it is."""
    k = F.col("k").cast("string")
    lines = F.concat(F.lit("used = "), k, F.when(F.col("k") % 2 == 0, F.concat(F.lit("\nname\tx"), F.col("id").cast("string"))).otherwise(""))
    json = F.when(F.col("k") % 3 == 0, " no json ").otherwise(F.concat(F.lit('{"k": '), k, F.lit("}")))
    some, other, all_ = tx.parsed(lines, "key_value"), tx.parsed(json, "json"), tx.parsed(F.concat(k, F.lit("\ty ")), "raw")
    return alerts(spark, sf).select("id", some["used"].alias("used"), some["name"].alias("tabbed"), other["raw"].alias("raw"), other["k"].alias("member"), all_["raw"].alias("whole"))
