"""The queries of the monitoring domain by name, each with its SQL for the check where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from watchgrid.functions import text as tx
from watchgrid.operators import aggregate, baseline, detectors, episodes, issues, lifecycle, reads, rules, store, tasks
from watchgrid.register import ORACLES, QUERIES, RANK_NAME, query  # noqa: F401
from watchgrid.schema import NOW, acknowledgements, alerts, level_rank, log_lines, micros, now, table
from watchgrid.schema import tasks as test_windows
from watchgrid.sources import readers

# Reads of the alert store


@query("SELECT level, observer, count(*) AS n, count(DISTINCT array_id) AS arrays, round(avg(value), 4) AS mean_value FROM alerts GROUP BY ALL")
def alert_stats(spark: SparkSession, sf: str) -> DataFrame:
    return alerts(spark, sf).groupBy("level", "observer").agg(F.count("*").alias("n"), F.count_distinct("array_id").alias("arrays"), F.round(F.avg("value"), 4).alias("mean_value"))


@query("SELECT id, array_id, observer, level, left(message, 200) AS message, ts FROM alerts WHERE level = 'critical' AND ts BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-25 00:00:00' ORDER BY ts DESC, id DESC LIMIT 100 OFFSET 20")
def alert_filter_page(spark: SparkSession, sf: str) -> DataFrame:
    held = store.matching(alerts(spark, sf), level="critical", start="2024-01-05 00:00:00", end="2024-01-25 00:00:00")
    return store.page(held, 100, 20).select("id", "array_id", "observer", "level", F.left("message", F.lit(200)).alias("message"), "ts")


@query("SELECT id, observer, level, value FROM alerts WHERE observer IN ('click', 'view') AND rank >= 2")
def alert_category_min_level(spark: SparkSession, sf: str) -> DataFrame:
    return store.matching(alerts(spark, sf), category="interaction", min_level="error").select("id", "observer", "level", "value")


@query(f"SELECT id, ts FROM alerts WHERE ts >= TIMESTAMP '{NOW}' - INTERVAL 48 HOUR")
def alert_recent_range(spark: SparkSession, sf: str) -> DataFrame:
    return alerts(spark, sf).where(F.col("ts") >= now() - F.expr("interval 48 hours")).select("id", "ts")


@query("SELECT l.level, count(a.id) AS n FROM (VALUES ('info'), ('warning'), ('error'), ('critical')) l(level) LEFT JOIN alerts a USING (level) GROUP BY 1")
def alert_stats_by_level(spark: SparkSession, sf: str) -> DataFrame:
    return store.level_counts(alerts(spark, sf))


@query("SELECT observer, count(*) AS n FROM alerts GROUP BY 1")
def alert_stats_by_observer(spark: SparkSession, sf: str) -> DataFrame:
    return store.counted(alerts(spark, sf), "observer")


@query("SELECT array_id, count(*) AS n FROM alerts GROUP BY 1")
def alert_stats_by_array(spark: SparkSession, sf: str) -> DataFrame:
    return store.counted(alerts(spark, sf), "array_id")


@query("SELECT CASE WHEN grouping(level) = 0 THEN 'level' WHEN grouping(observer) = 0 THEN 'observer' WHEN grouping(array_id) = 0 THEN 'array' ELSE 'total' END AS part, coalesce(level, observer, CAST(array_id AS VARCHAR), 'all') AS key, count(*) AS n FROM alerts GROUP BY GROUPING SETS ((), (level), (observer), (array_id))")
def alert_stats_bundle(spark: SparkSession, sf: str) -> DataFrame:
    return store.bundle(alerts(spark, sf))


@query(f", b AS (SELECT 23 - greatest(CAST(floor((epoch_us(TIMESTAMP '{NOW}') - epoch_us(ts) - 1) / 3600000000.0) AS BIGINT), 0) AS bucket FROM alerts) SELECT CAST(s.bucket AS INT) AS bucket, count(b.bucket) AS n FROM range(24) s(bucket) LEFT JOIN b ON b.bucket = s.bucket GROUP BY 1")
def alert_trend_hourly(spark: SparkSession, sf: str) -> DataFrame:
    return store.trend(alerts(spark, sf), now(), 24)


@query(f", b AS (SELECT 23 - greatest(CAST(floor((epoch_us(TIMESTAMP '{NOW}') - epoch_us(ts) - 1) / 600000000.0) AS BIGINT), 0) AS bucket FROM alerts) SELECT CAST(s.bucket AS INT) AS bucket, count(b.bucket) AS n FROM range(24) s(bucket) LEFT JOIN b ON b.bucket = s.bucket GROUP BY 1")
def alert_trend_ten_minutes(spark: SparkSession, sf: str) -> DataFrame:
    return store.trend(alerts(spark, sf), now(), 4)


@query("SELECT count(*) AS total, count(*) FILTER (WHERE rank >= 2) AS error_count, count(*) FILTER (WHERE rank < 2) AS warning_count FROM alerts")
def alert_summary(spark: SparkSession, sf: str) -> DataFrame:
    return store.summary(alerts(spark, sf))


@query("SELECT array_id, count(*) FILTER (WHERE level = 'info') AS info, count(*) FILTER (WHERE level = 'warning') AS warning, count(*) FILTER (WHERE level = 'error') AS error, count(*) FILTER (WHERE level = 'critical') AS critical FROM alerts GROUP BY 1")
def level_histogram_per_array(spark: SparkSession, sf: str) -> DataFrame:
    return store.histogram(alerts(spark, sf))


@query(", r AS (SELECT *, row_number() OVER (PARTITION BY array_id, observer ORDER BY rank DESC, ts DESC, id DESC) AS rn, max(ts) OVER (PARTITION BY array_id, observer) AS last_seen FROM alerts) SELECT array_id, observer, level, message, last_seen, CASE WHEN rank >= 2 THEN 'error' WHEN rank = 1 THEN 'warning' ELSE 'ok' END AS status FROM r WHERE rn = 1")
def worst_level_per_observer(spark: SparkSession, sf: str) -> DataFrame:
    return store.worst(alerts(spark, sf))


@query(", r AS (SELECT *, row_number() OVER (PARTITION BY array_id, observer ORDER BY ts DESC, id DESC) AS rn FROM alerts) SELECT id, array_id, observer, level, ts, CAST(rn AS INT) AS rn FROM r WHERE rn <= 2")
def top2_per_observer(spark: SparkSession, sf: str) -> DataFrame:
    return store.newest(alerts(spark, sf), 2).select("id", "array_id", "observer", "level", "ts", "rn")


@query(", r AS (SELECT *, row_number() OVER (PARTITION BY array_id, observer ORDER BY id DESC) AS rn FROM alerts) SELECT array_id, observer, id, level, message FROM r WHERE rn = 1")
def latest_per_observer(spark: SparkSession, sf: str) -> DataFrame:
    return store.latest(alerts(spark, sf), ("array_id", "observer")).select("array_id", "observer", "id", "level", "message")


@query("SELECT id, array_id, level FROM alerts a WHERE NOT EXISTS (SELECT 1 FROM acks WHERE alert_id = a.id)")
def unacked_alerts(spark: SparkSession, sf: str) -> DataFrame:
    return store.unacknowledged(alerts(spark, sf), acknowledgements(spark, sf)).select("id", "array_id", "level")


@query("SELECT id, id IN (SELECT alert_id FROM acks) AS acked FROM alerts")
def ack_flag(spark: SparkSession, sf: str) -> DataFrame:
    return store.with_ack_flag(alerts(spark, sf), acknowledgements(spark, sf)).select("id", "acked")


@query("SELECT ack_type, level, count(*) AS n, min(acked_at) AS first_acked FROM alerts JOIN acks ON id = alert_id GROUP BY ALL")
def ack_by_type(spark: SparkSession, sf: str) -> DataFrame:
    a, k = alerts(spark, sf), acknowledgements(spark, sf)
    return a.join(k, a["id"] == k["alert_id"]).groupBy("ack_type", "level").agg(F.count("*").alias("n"), F.min("acked_at").alias("first_acked"))


@query("SELECT o_orderkey AS id FROM orders WHERE o_orderkey NOT IN (SELECT id FROM alerts)")
def missing_ids(spark: SparkSession, sf: str) -> DataFrame:
    return store.missing(table(spark, sf, "orders").select(F.col("o_orderkey").alias("id")), alerts(spark, sf))


@query("SELECT CASE WHEN observer IN ('click', 'view') THEN 'interaction' WHEN observer = 'purchase' THEN 'commerce' WHEN observer IN ('login', 'signup', 'logout') THEN 'session' ELSE 'system' END AS category, count(*) AS n, max(ts) AS newest FROM alerts GROUP BY 1")
def alert_categories(spark: SparkSession, sf: str) -> DataFrame:
    return store.with_category(alerts(spark, sf)).groupBy("category").agg(F.count("*").alias("n"), F.max("ts").alias("newest"))


@query("SELECT n.n_nationkey, r.r_name AS l1, n.n_name AS l2, count(s.s_suppkey) AS arrays FROM nation n LEFT JOIN region r ON n_regionkey = r_regionkey LEFT JOIN supplier s ON s_nationkey = n_nationkey GROUP BY ALL", raw=True)
def tag_counts(spark: SparkSession, sf: str) -> DataFrame:
    n, r, s = (table(spark, sf, t) for t in ("nation", "region", "supplier"))
    named = n.join(r, n["n_regionkey"] == r["r_regionkey"], "left")
    return named.join(s, s["s_nationkey"] == named["n_nationkey"], "left").groupBy("n_nationkey", F.col("r_name").alias("l1"), F.col("n_name").alias("l2")).agg(F.count("s_suppkey").alias("arrays"))


@query("SELECT id, coalesce(c_name, CAST(array_id AS VARCHAR)) AS array_name, coalesce(n_name, '') AS l2, coalesce(r_name, '') AS l1 FROM alerts LEFT JOIN customer ON c_custkey = array_id LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey WHERE rank = 3")
def three_level_dimensions(spark: SparkSession, sf: str) -> DataFrame:
    c, n, r = (table(spark, sf, t) for t in ("customer", "nation", "region"))
    a = store.matching(alerts(spark, sf), level="critical")
    held = a.join(c, a["array_id"] == c["c_custkey"], "left").join(n, c["c_nationkey"] == n["n_nationkey"], "left").join(r, n["n_regionkey"] == r["r_regionkey"], "left")
    return held.select("id", F.coalesce("c_name", F.col("array_id").cast("string")).alias("array_name"), F.coalesce("n_name", F.lit("")).alias("l2"), F.coalesce("r_name", F.lit("")).alias("l1"))


@query("SELECT p_partkey, p_brand, p_type FROM part WHERE contains(lower(concat_ws(' ', p_name, p_brand, p_type)), 'brand') AND contains(lower(concat_ws(' ', p_name, p_brand, p_type)), '1')", raw=True)
def card_search(spark: SparkSession, sf: str) -> DataFrame:
    return store.search(table(spark, sf, "part"), "Brand 1", ["p_name", "p_brand", "p_type"]).select("p_partkey", "p_brand", "p_type")


@query("SELECT array_id, count(*) AS n FROM alerts GROUP BY 1 ORDER BY n DESC, array_id LIMIT 20")
def audit_topn(spark: SparkSession, sf: str) -> DataFrame:
    return store.top_groups(alerts(spark, sf), "array_id", 20)


@query(", b AS (SELECT DISTINCT array_id, observer FROM alerts WHERE rank >= 2 AND ts < TIMESTAMP '2024-01-16 00:00:00'), c AS (SELECT DISTINCT array_id, observer FROM alerts WHERE rank >= 2 AND ts >= TIMESTAMP '2024-01-16 00:00:00') SELECT * FROM b EXCEPT SELECT * FROM c")
def recovered_keys(spark: SparkSession, sf: str) -> DataFrame:
    high = alerts(spark, sf).where(level_rank(F.col("level")) >= 2)
    cut = F.lit("2024-01-16 00:00:00").cast("timestamp_ntz")
    return store.recovered(high.where(F.col("ts") < cut), high.where(F.col("ts") >= cut), ["array_id", "observer"])


# Aggregation


@query(
    f""", o AS (SELECT *, row_number() OVER (PARTITION BY array_id ORDER BY ts, id) AS place FROM alerts),
s AS (SELECT *, min(place) OVER (PARTITION BY array_id ORDER BY ts RANGE BETWEEN INTERVAL 24 HOUR PRECEDING AND CURRENT ROW) AS first FROM o),
h AS (SELECT array_id, arg_min(first, place) AS lo, min(place) AS hi FROM s WHERE place - first + 1 = 8 GROUP BY 1)
SELECT array_id, count(*) AS size, min(ts) AS earliest, max(ts) AS latest, {RANK_NAME.format("max(rank)")} AS worst_level FROM o JOIN h USING (array_id) WHERE place BETWEEN lo AND hi GROUP BY 1"""
)
def storm_first_hit(spark: SparkSession, sf: str) -> DataFrame:
    return aggregate.storms(alerts(spark, sf), 86_400, 8).drop("first_id", "last_id")


@query(f"SELECT array_id, details, count(*) AS size, min(ts) AS earliest, max(ts) AS latest, {RANK_NAME.format('max(rank)')} AS worst_level FROM alerts GROUP BY 1, 2 HAVING count(*) >= 2 AND epoch_us(max(ts)) - epoch_us(min(ts)) <= 432000000000")
def root_cause_groups(spark: SparkSession, sf: str) -> DataFrame:
    return aggregate.correlated(alerts(spark, sf), ["array_id", "details"], 5 * 86_400)


ANCHORED = """o AS (SELECT *, row_number() OVER (PARTITION BY array_id, observer ORDER BY ts, id) AS place FROM alerts),
g AS (WITH RECURSIVE g AS (SELECT array_id, observer, place, ts, rank, ts AS anchor FROM o WHERE place = 1
UNION ALL SELECT o.array_id, o.observer, o.place, o.ts, o.rank, CASE WHEN o.ts - g.anchor <= INTERVAL 6 HOUR THEN g.anchor ELSE o.ts END FROM g JOIN o ON o.array_id = g.array_id AND o.observer = g.observer AND o.place = g.place + 1) SELECT * FROM g)"""


@query(f", {ANCHORED} SELECT array_id, observer, count(*) AS size, min(ts) AS earliest, max(ts) AS latest, {RANK_NAME.format('max(rank)')} AS worst_level FROM g GROUP BY array_id, observer, anchor")
def time_window_merge(spark: SparkSession, sf: str) -> DataFrame:
    return aggregate.anchored(alerts(spark, sf), 6 * 3600)


@query(f", f AS (SELECT *, left(trim(regexp_replace(regexp_replace(message, '\\d+', '#', 'g'), '\\s+', ' ', 'g')), 80) AS identity FROM alerts) SELECT array_id, observer, identity, count(*) AS size, min(ts) AS earliest, max(ts) AS latest, {RANK_NAME.format('max(rank)')} AS worst_level, arg_max(message, (ts, id)) AS newest, count(DISTINCT message) > 1 AS differs FROM f GROUP BY 1, 2, 3")
def message_skeleton_fold(spark: SparkSession, sf: str) -> DataFrame:
    return aggregate.folded(alerts(spark, sf))


@query(", e AS (SELECT array_id, observer, arg_min(k, (ts, id)) AS a, arg_max(k, (ts, id)) AS b FROM alerts GROUP BY 1, 2) SELECT array_id, observer, CAST(a AS DOUBLE) AS from_value, CAST(b AS DOUBLE) AS to_value, '' AS unit FROM e WHERE a <> b")
def message_progress(spark: SparkSession, sf: str) -> DataFrame:
    return aggregate.progress(alerts(spark, sf))


# Episodes and mined rules

EPISODES = """b AS (SELECT *, coalesce(CAST(epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY array_id ORDER BY ts, id) > 14400000000 AS INT), 1) AS begins FROM alerts),
ep AS (SELECT *, sum(begins) OVER (PARTITION BY array_id ORDER BY ts, id) AS episode FROM b),
f AS (SELECT array_id, episode, observer, arg_min(ts, (ts, id)) AS ts, arg_min(id, (ts, id)) AS id FROM ep GROUP BY 1, 2, 3),
pr AS (SELECT a.array_id, a.episode, a.observer AS antecedent, b.observer AS consequent, (epoch_us(b.ts) - epoch_us(a.ts)) / 1000000.0 AS lag_s FROM f a JOIN f b ON a.array_id = b.array_id AND a.episode = b.episode AND (a.ts, a.id) < (b.ts, b.id)),
an AS (SELECT array_id, observer AS antecedent, count(*) AS episodes FROM f GROUP BY 1, 2),
ru AS (SELECT array_id, antecedent, consequent, count(*) AS n, round(avg(lag_s), 2) AS avg_lag_s, round(count(*) / any_value(episodes), 3) AS confidence FROM pr JOIN an USING (array_id, antecedent) GROUP BY 1, 2, 3 HAVING count(*) >= 2 AND count(*) / any_value(episodes) >= 0.15)"""


@query(f", {EPISODES} SELECT array_id, CAST(episode AS BIGINT) AS episode, count(*) AS n, count(DISTINCT observer) AS observers, min(ts) AS earliest, max(ts) AS latest FROM ep GROUP BY 1, 2")
def episode_split(spark: SparkSession, sf: str) -> DataFrame:
    held = episodes.split(alerts(spark, sf), 4 * 3600)
    return held.groupBy("array_id", "episode").agg(F.count("*").alias("n"), F.count_distinct("observer").alias("observers"), F.min("ts").alias("earliest"), F.max("ts").alias("latest"))


@query(f", {EPISODES} SELECT array_id, CAST(episode AS BIGINT) AS episode, antecedent, consequent, round(lag_s, 3) AS lag_s FROM pr")
def episode_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return episodes.pairs(episodes.split(alerts(spark, sf), 4 * 3600)).withColumn("lag_s", F.round("lag_s", 3))


@query(f", {EPISODES} SELECT * FROM ru")
def causal_rules(spark: SparkSession, sf: str) -> DataFrame:
    return episodes.rules(alerts(spark, sf), 4 * 3600)


@query(f", {EPISODES} SELECT * FROM ru WHERE confidence >= 0.3 ORDER BY confidence DESC, array_id, antecedent, consequent LIMIT 500")
def causal_rule_list(spark: SparkSession, sf: str) -> DataFrame:
    return episodes.listed(episodes.rules(alerts(spark, sf), 4 * 3600), 0.3)


@query(
    f""", {EPISODES}, ed AS (SELECT a.array_id, a.episode, a.observer, b.observer AS other FROM f a JOIN f b ON a.array_id = b.array_id AND a.episode = b.episode AND a.ts < b.ts JOIN ru ON ru.array_id = a.array_id AND antecedent = a.observer AND consequent = b.observer)
SELECT array_id, CAST(episode AS BIGINT) AS episode, observer, CASE WHEN (array_id, episode) NOT IN (SELECT (array_id, episode) FROM ed) THEN 'isolated' WHEN (array_id, episode, observer) IN (SELECT (array_id, episode, other) FROM ed) THEN 'consequence' ELSE 'root' END AS role FROM f"""
)
def episode_roles(spark: SparkSession, sf: str) -> DataFrame:
    first = episodes.firsts(episodes.split(alerts(spark, sf), 4 * 3600))
    return episodes.roles_of(first, episodes.scored(first))


@query()
def episode_tree(spark: SparkSession, sf: str) -> DataFrame:
    first = episodes.firsts(episodes.split(alerts(spark, sf), 4 * 3600))
    return episodes.tree(first, episodes.scored(first))


# Baselines


@query("SELECT array_id, observer, count(*) AS n, round(median(value), 4) AS median, round(stddev_samp(value), 4) AS deviation FROM alerts GROUP BY 1, 2 HAVING count(*) >= 3")
def baseline_stats(spark: SparkSession, sf: str) -> DataFrame:
    return baseline.learn(alerts(spark, sf), ["array_id", "observer"]).select("array_id", "observer", "n", F.round("median", 4).alias("median"), F.round("deviation", 4).alias("deviation"))


@query(", m AS (SELECT array_id, observer, median(value) AS md, stddev_samp(value) AS sd FROM alerts GROUP BY 1, 2 HAVING count(*) >= 3) SELECT id, CASE WHEN md IS NULL THEN 'no_baseline' WHEN value > md + 3 * sd THEN 'anomalous' ELSE 'normal' END AS status FROM alerts LEFT JOIN m USING (array_id, observer)")
def baseline_status(spark: SparkSession, sf: str) -> DataFrame:
    a = alerts(spark, sf)
    by = ["array_id", "observer"]
    return baseline.judged(a, baseline.learn(a, by), by).select("id", "status")


@query(", h AS (SELECT *, avg(value) OVER (PARTITION BY array_id, observer ORDER BY ts, id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS mean FROM alerts) SELECT id, round((value - mean) / mean * 100, 4) AS rise FROM h WHERE mean <> 0 AND (value - mean) / mean * 100 > 200")
def metric_spikes(spark: SparkSession, sf: str) -> DataFrame:
    return baseline.spikes(alerts(spark, sf), ["array_id", "observer"], 5, 200.0).select("id", F.round("rise", 4).alias("rise"))


@query("SELECT array_id, arg_max(value, (ts, id)) FILTER (WHERE observer = 'purchase') AS purchase, arg_max(value, (ts, id)) FILTER (WHERE observer = 'click') AS click FROM alerts GROUP BY 1")
def latest_metric(spark: SparkSession, sf: str) -> DataFrame:
    held = alerts(spark, sf).select("array_id", "ts", "id", *[F.when(F.col("observer") == o, F.col("value")).alias(o) for o in ("purchase", "click")])
    return baseline.last_known(held, ["array_id"], ["purchase", "click"])


# Detectors

KEY = ["array_id", "observer"]
OVER = "OVER (PARTITION BY array_id, observer ORDER BY ts, id)"


@query(f", c AS (SELECT *, value - lag(value) {OVER} AS delta FROM alerts) SELECT id, round(delta, 4) AS delta FROM c WHERE delta > 100 AND delta <= 400")
def counter_delta(spark: SparkSession, sf: str) -> DataFrame:
    return detectors.delta(alerts(spark, sf), KEY, "value", 100, 400).select("id", F.round("delta", 4).alias("delta"))


@query(f", c AS (SELECT *, value - lag(value) {OVER} AS g, (epoch_us(ts) - lag(epoch_us(ts)) {OVER}) / 1000000.0 AS s FROM alerts) SELECT id, round(CASE WHEN s > 0 AND g >= 0 THEN g / s * 3600 END, 4) AS per_hour FROM c")
def counter_rate(spark: SparkSession, sf: str) -> DataFrame:
    return detectors.rate(alerts(spark, sf), KEY, "value").select("id", F.round(F.col("rate") * 3600, 4).alias("per_hour"))


@query(f", c AS (SELECT *, lag(level) {OVER} AS previous FROM alerts) SELECT id, previous, level FROM c WHERE level <> previous")
def state_changes(spark: SparkSession, sf: str) -> DataFrame:
    return detectors.change(alerts(spark, sf), KEY, "level").select("id", "previous", "level")


@query(f", c AS (SELECT *, lag(level) {OVER} AS previous FROM alerts) SELECT id, previous, level FROM c WHERE level <> previous AND level IN ('error', 'critical')")
def state_goes_bad(spark: SparkSession, sf: str) -> DataFrame:
    return detectors.change(alerts(spark, sf), KEY, "level", ["error", "critical"]).select("id", "previous", "level")


HYSTERESIS = f"""h AS (SELECT *, value >= 80 AS high FROM alerts),
t AS (SELECT *, CAST(coalesce(lag(high) {OVER}, false) <> high AS INT) AS turns FROM h),
i AS (SELECT *, sum(turns) {OVER} AS island FROM t),
s AS (SELECT *, row_number() OVER (PARTITION BY array_id, observer, island ORDER BY ts, id) AS streak FROM i),
p AS (SELECT *, lag(CASE WHEN high THEN streak ELSE 0 END) {OVER} AS before FROM s)"""


@query(f", {HYSTERESIS} SELECT id, CASE WHEN high AND streak = 2 THEN 'enter' WHEN high AND streak > 2 THEN 'stay' ELSE 'recovered' END AS event FROM p WHERE high AND streak >= 2 OR NOT high AND before >= 2")
def threshold_hysteresis(spark: SparkSession, sf: str) -> DataFrame:
    return detectors.hysteresis(alerts(spark, sf), KEY, "value", 80, 2).select("id", "event")


@query(f", {HYSTERESIS} SELECT array_id, observer, max(streak) AS longest FROM p WHERE high GROUP BY 1, 2")
def consecutive_streak(spark: SparkSession, sf: str) -> DataFrame:
    return detectors.streaks(alerts(spark, sf), KEY, F.col("value") >= 80)


@query(f", w AS (SELECT *, min(CAST(value >= 60 AS INT)) OVER (PARTITION BY array_id, observer ORDER BY ts, id ROWS 2 PRECEDING) AS a, row_number() {OVER} AS rn FROM alerts) SELECT id FROM w WHERE a = 1 AND rn >= 3")
def rolling_all(spark: SparkSession, sf: str) -> DataFrame:
    return detectors.rolling_all(alerts(spark, sf), KEY, F.col("value") >= 60, 3).select("id")


@query(
    """, o AS (SELECT *, row_number() OVER (PARTITION BY array_id ORDER BY ts, id) AS place, value - lag(value) OVER (PARTITION BY array_id ORDER BY ts, id) AS d FROM alerts),
w AS (SELECT *, min(d) OVER (PARTITION BY array_id ORDER BY place ROWS 2 PRECEDING) AS lo, max(d) OVER (PARTITION BY array_id ORDER BY place ROWS 1 PRECEDING) AS hi FROM o),
g AS (SELECT *, CASE WHEN place >= 4 AND lo > 0 THEN 1 WHEN place >= 3 AND hi < 0 THEN 0 END AS sign FROM w),
l AS (SELECT *, last_value(sign IGNORE NULLS) OVER (PARTITION BY array_id ORDER BY place ROWS UNBOUNDED PRECEDING) AS st FROM g) SELECT id FROM l WHERE st = 1"""
)
def memory_leak(spark: SparkSession, sf: str) -> DataFrame:
    return detectors.leak(alerts(spark, sf), ["array_id"], "value", 4, 3).select("id")


@query(", r AS (SELECT *, sum(value) OVER (PARTITION BY array_id ORDER BY ts, id) AS total, sum(value) FILTER (WHERE observer = 'click') OVER (PARTITION BY array_id ORDER BY ts, id) AS idle FROM alerts), d AS (SELECT id, total - lag(total) OVER w AS t, coalesce(idle, 0) - lag(coalesce(idle, 0)) OVER w AS i FROM r WINDOW w AS (PARTITION BY array_id ORDER BY ts, id)) SELECT id, round(CASE WHEN t > 0 THEN greatest(0, least(100, 100 * (t - i) / t)) END, 2) AS usage FROM d")
def cpu_usage(spark: SparkSession, sf: str) -> DataFrame:
    order = W.partitionBy("array_id").orderBy("ts", "id").rangeBetween(W.unboundedPreceding, W.currentRow)
    held = alerts(spark, sf).withColumn("total", F.sum("value").over(order)).withColumn("idle", F.coalesce(F.sum(F.when(F.col("observer") == "click", F.col("value"))).over(order), F.lit(0.0)))
    return held.select("id", F.round(detectors.cpu_usage(F.col("total"), F.col("idle"), ["array_id"]), 2).alias("usage"))


@query("SELECT array_id, CASE WHEN max(value) >= 300 THEN 'critical' WHEN max(value) >= 200 THEN 'warning' ELSE 'ok' END AS heat, max(value) AS hottest FROM alerts GROUP BY 1")
def thermal_levels(spark: SparkSession, sf: str) -> DataFrame:
    held = alerts(spark, sf).groupBy("array_id").agg(F.max("value").alias("hottest"))
    return held.select("array_id", detectors.level_of(F.col("hottest"), (300, "critical"), (200, "warning")).alias("heat"), "hottest")


@query(f", c AS (SELECT *, lag(value) {OVER} AS previous FROM alerts) SELECT id, previous FROM c WHERE value < previous - 60")
def uptime_reset(spark: SparkSession, sf: str) -> DataFrame:
    return detectors.rebooted(alerts(spark, sf), KEY, "value", 60).select("id", "previous")


@query(
    """, o AS (SELECT *, row_number() OVER (PARTITION BY array_id, observer ORDER BY ts, id) AS place FROM alerts),
g AS (WITH RECURSIVE g AS (SELECT array_id, observer, place, id, ts AS sent, true AS goes FROM o WHERE place = 1
UNION ALL SELECT o.array_id, o.observer, o.place, o.id, CASE WHEN o.ts - g.sent >= INTERVAL 12 HOUR THEN o.ts ELSE g.sent END, o.ts - g.sent >= INTERVAL 12 HOUR FROM g JOIN o ON o.array_id = g.array_id AND o.observer = g.observer AND o.place = g.place + 1) SELECT * FROM g)
SELECT id FROM g WHERE goes"""
)
def report_cooldown(spark: SparkSession, sf: str) -> DataFrame:
    return detectors.cooled(alerts(spark, sf), KEY, 12 * 3600).select("id")


@query(
    """, o AS (SELECT *, row_number() OVER (PARTITION BY array_id ORDER BY ts, id) AS place FROM alerts),
g AS (WITH RECURSIVE g AS (SELECT array_id, place, id, CAST(value >= 40 AS INT) AS run, CAST(NULL AS TIMESTAMP) AS fired, false AS fires FROM o WHERE place = 1
UNION ALL SELECT n.array_id, n.place, n.id, CASE WHEN n.f THEN 0 ELSE n.r END, CASE WHEN n.f THEN n.ts ELSE n.fired END, n.f FROM (
SELECT o.array_id, o.place, o.id, o.ts, g.fired, CASE WHEN o.value >= 40 THEN g.run + 1 ELSE 0 END AS r, CASE WHEN o.value >= 40 THEN g.run + 1 ELSE 0 END >= 3 AND (g.fired IS NULL OR o.ts - g.fired >= INTERVAL 24 HOUR) AS f FROM g JOIN o ON o.array_id = g.array_id AND o.place = g.place + 1) n) SELECT * FROM g)
SELECT id FROM g WHERE fires"""
)
def consecutive_gate(spark: SparkSession, sf: str) -> DataFrame:
    checks = alerts(spark, sf).withColumn("high", F.col("value") >= 40)
    return detectors.consecutive_gate(checks, ["array_id"], "high", 3, 86_400).select("id")


@query("SELECT id, least(5.0 * pow(2.0, k % 10), 300.0) AS delay_s FROM alerts WHERE rank = 3")
def retry_backoff(spark: SparkSession, sf: str) -> DataFrame:
    return store.matching(alerts(spark, sf), level="critical").select("id", detectors.backoff(F.col("k") % 10, 5, 300).alias("delay_s"))


# Test windows and snapshots

WITHIN = "wi AS (SELECT a.*, t.task_id, t.task_type FROM alerts a JOIN tasks t ON a.ts >= started_at AND (ended_at IS NULL OR a.ts <= ended_at) AND (len(array_ids) = 0 OR list_contains(array_ids, a.array_id)))"


@query(f", {WITHIN} SELECT task_id, id FROM wi")
def task_intervals(spark: SparkSession, sf: str) -> DataFrame:
    return tasks.within(alerts(spark, sf), test_windows(spark)).select("task_id", "id")


@query(
    f""", {WITHIN}, c AS (SELECT task_id, count(*) AS total, count(*) FILTER (WHERE rank = 3) AS critical, count(*) FILTER (WHERE rank = 2) AS error, count(*) FILTER (WHERE rank = 1) AS warning, count(*) FILTER (WHERE rank = 0) AS info, count(*) FILTER (WHERE observer IN ('click', 'view')) AS expected FROM wi GROUP BY 1)
SELECT task_id, name, coalesce(total, 0) AS total, coalesce(critical, 0) AS critical, coalesce(error, 0) AS error, coalesce(warning, 0) AS warning, coalesce(info, 0) AS info, coalesce(expected, 0) AS expected, coalesce(total, 0) - coalesce(expected, 0) AS unexpected, date_diff('hour', started_at, ended_at) AS hours FROM tasks LEFT JOIN c USING (task_id)"""
)
def task_summary(spark: SparkSession, sf: str) -> DataFrame:
    return tasks.summaries(alerts(spark, sf), test_windows(spark), ("click", "view"))


SNAP = "SELECT array_id, observer, arg_max(level, id) AS level, arg_max(message, id) AS message FROM alerts WHERE ts {} TIMESTAMP '2024-01-16 00:00:00' GROUP BY 1, 2"


@query(
    f""", a AS ({SNAP.format("<")}), b AS ({SNAP.format(">=")})
SELECT coalesce(a.array_id, b.array_id) AS array_id, coalesce(a.observer, b.observer) AS observer, a.level AS old_level, a.message AS old_message, b.level AS new_level, b.message AS new_message, CASE WHEN a.level IS NULL THEN 'added' WHEN b.level IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM a FULL JOIN b ON a.array_id = b.array_id AND a.observer = b.observer WHERE a.level IS NULL OR b.level IS NULL OR a.level <> b.level OR a.message <> b.message"""
)
def snapshot_diff(spark: SparkSession, sf: str) -> DataFrame:
    a, cut = alerts(spark, sf), F.lit("2024-01-16 00:00:00").cast("timestamp_ntz")
    return tasks.diff(tasks.snapshot(a.where(F.col("ts") < cut)), tasks.snapshot(a.where(F.col("ts") >= cut)), ["array_id", "observer"])


@query("SELECT c_custkey AS array_id, NOT EXISTS (SELECT 1 FROM alerts WHERE rank = 3 AND array_id = c_custkey) AS available FROM customer")
def lock_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    return tasks.conflicts(table(spark, sf, "customer").select(F.col("c_custkey").alias("array_id")), store.matching(alerts(spark, sf), level="critical"))


@query("SELECT c_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM customer JOIN orders ON o_custkey = c_custkey AND o_orderdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1996-12-31' GROUP BY 1", raw=True)
def order_intervals(spark: SparkSession, sf: str) -> DataFrame:
    c, o = table(spark, sf, "customer").select("c_custkey"), table(spark, sf, "orders")
    year = F.col("o_orderdate").between(F.lit("1996-01-01").cast("timestamp_ntz"), F.lit("1996-12-31").cast("timestamp_ntz"))
    return c.join(o.where(year), F.col("c_custkey") == F.col("o_custkey")).groupBy("c_custkey").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


# Rules, issues and acknowledgements

RULES = [
    rules.Rule(1, 10, task_types=("stress",), observers=("click",)),
    rules.Rule(2, 20, task_types=("upgrade", "stress"), levels=("warning", "error")),
    rules.Rule(3, 5, observers=("pur.*",), messages=(r"k=1\d\b",)),
]


@query(f", {WITHIN}, m AS (SELECT id, task_id, CASE WHEN regexp_matches(observer, '(?i)pur.*') AND regexp_matches(message, '(?i)k=1\\d\\b') THEN 3 WHEN task_type = 'stress' AND observer = 'click' THEN 1 WHEN task_type IN ('upgrade', 'stress') AND level IN ('warning', 'error') THEN 2 END AS matched_rule_id FROM wi) SELECT *, CAST(matched_rule_id IS NOT NULL AS INT) AS is_expected FROM m")
def expectation_match(spark: SparkSession, sf: str) -> DataFrame:
    return rules.expected(tasks.within(alerts(spark, sf), test_windows(spark)), RULES).select("id", "task_id", "matched_rule_id", "is_expected")


@query("SELECT alert_id, ack_type, h AS hours, CASE ack_type WHEN 'dismiss' THEN acked_at + INTERVAL 24 HOUR WHEN 'deferred' THEN acked_at + to_hours(coalesce(h, 72)) ELSE acked_at + to_hours(CASE WHEN h IN (2, 4, 6, 8, 12, 24) THEN h WHEN h IS NOT NULL THEN 24 END) END AS expires_at FROM (SELECT *, CAST(CASE WHEN alert_id % 5 = 0 THEN NULL ELSE alert_id % 25 END AS INT) AS h FROM acks)")
def ack_expiry(spark: SparkSession, sf: str) -> DataFrame:
    hours = F.when(F.col("alert_id") % 5 != 0, F.col("alert_id") % 25).cast("int")
    held = acknowledgements(spark, sf).withColumn("hours", hours)
    return held.select("alert_id", "ack_type", "hours", lifecycle.expiry(F.col("ack_type"), F.col("acked_at"), F.col("hours")).alias("expires_at"))


@query(
    f""", e AS (SELECT array_id, observer, ack_type, CASE ack_type WHEN 'dismiss' THEN acked_at + INTERVAL 24 HOUR WHEN 'deferred' THEN acked_at + INTERVAL 72 HOUR END AS expires_at FROM acks JOIN alerts ON id = alert_id),
l AS (SELECT array_id, observer, count(*) FILTER (WHERE ack_type = 'confirmed_ok') AS c, max(expires_at) FILTER (WHERE ack_type = 'dismiss' AND expires_at > TIMESTAMP '2024-01-20') AS u FROM e GROUP BY 1, 2)
SELECT id, CASE WHEN c > 0 THEN 'confirmed_ok' WHEN u IS NOT NULL THEN 'dismiss' END AS auto_ack, CASE WHEN coalesce(c, 0) = 0 THEN u END AS expires_at FROM alerts LEFT JOIN l USING (array_id, observer)"""
)
def auto_ack(spark: SparkSession, sf: str) -> DataFrame:
    a, k = alerts(spark, sf), acknowledgements(spark, sf)
    held = k.join(a.select(F.col("id").alias("alert_id"), "array_id", "observer"), "alert_id").withColumn("expires_at", lifecycle.expiry(F.col("ack_type"), F.col("acked_at"), F.lit(None).cast("int")))
    return lifecycle.inherited(a, held, F.lit("2024-01-20").cast("timestamp_ntz")).select("id", "auto_ack", "expires_at")


@query(
    f""", s AS (SELECT array_id, max(ts) AS hb, max(ts) FILTER (WHERE observer = 'click') AS pu, array_id % 7 <> 0 AS connected, array_id % 11 <> 0 AS deployed, array_id % 5 <> 0 AS running FROM alerts GROUP BY 1),
h AS (SELECT *, running AND (epoch_us(TIMESTAMP '{NOW}') - epoch_us(hb)) / 1000000.0 <= 7200 AS healthy FROM s)
SELECT array_id, hb AS last_seen, 'heartbeat' AS health_source, healthy, CASE WHEN NOT connected THEN 'disconnected' WHEN running AND NOT healthy THEN 'degraded' ELSE 'connected' END AS state,
CASE WHEN NOT connected THEN 'unreachable' WHEN NOT deployed THEN 'not_deployed' WHEN NOT running THEN 'agent_stopped' WHEN NOT healthy THEN 'no_heartbeat' ELSE 'ok' END AS collect_status FROM h"""
)
def runtime_status(spark: SparkSession, sf: str) -> DataFrame:
    push = F.max(F.when(F.col("observer") == "click", F.col("ts")))
    seen = alerts(spark, sf).groupBy("array_id").agg(F.max("ts").alias("heartbeat_at"), push.alias("pushed_at"))
    seen = seen.withColumns({"connected": F.col("array_id") % 7 != 0, "deployed": F.col("array_id") % 11 != 0, "running": F.col("array_id") % 5 != 0})
    return issues.runtime(seen, now(), 7200).select("array_id", "last_seen", "health_source", "healthy", "state", "collect_status")


# Lifecycle


@query(", d AS (SELECT *, date_trunc('day', ts) AS d, md5(concat_ws('|', array_id, strftime(ts, '%Y-%m-%d'), observer, message)) AS digest FROM alerts) SELECT arg_min(id, (ts, id)) AS id, digest FROM d WHERE id % 3 > 0 AND digest NOT IN (SELECT digest FROM d WHERE id % 3 = 0) GROUP BY digest")
def md5_dedup(spark: SparkSession, sf: str) -> DataFrame:
    a = alerts(spark, sf).withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    return lifecycle.dedup_new(a.where("id % 3 > 0"), a.where("id % 3 = 0"), ["array_id", "day", "observer", "message"]).select("id", "digest")


@query(", d AS (SELECT *, md5(concat_ws('|', array_id, strftime(ts, '%Y-%m-%d'), observer, message)) AS digest FROM alerts), n AS (SELECT count(*) AS seen FROM d WHERE id % 3 > 0), i AS (SELECT count(DISTINCT digest) AS imported FROM d WHERE id % 3 > 0 AND digest NOT IN (SELECT digest FROM d WHERE id % 3 = 0)) SELECT imported, seen - imported AS skipped FROM n, i")
def sync_outcome(spark: SparkSession, sf: str) -> DataFrame:
    a = alerts(spark, sf).withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    return lifecycle.sync_counts(a.where("id % 3 > 0"), a.where("id % 3 = 0"), ["array_id", "day", "observer", "message"])


@query(", p AS (SELECT *, strftime(ts, '%Y-%m-%d') || '_' || observer || '_' || left(message, 50) AS key FROM alerts), l AS (SELECT key FROM p WHERE id % 3 = 0 ORDER BY ts DESC, id DESC LIMIT 100) SELECT arg_min(id, (ts, id)) AS id FROM p WHERE id % 3 > 0 AND key NOT IN (SELECT key FROM l) GROUP BY key")
def prefix_dedup(spark: SparkSession, sf: str) -> DataFrame:
    a = alerts(spark, sf).withColumn("stamp", F.date_format("ts", "yyyy-MM-dd"))
    return lifecycle.dedup_recent(a.where("id % 3 > 0"), a.where("id % 3 = 0"), "stamp", 100).select("id")


@query(
    """, o AS (SELECT *, row_number() OVER (PARTITION BY array_id ORDER BY ts, id) AS place FROM alerts),
g AS (WITH RECURSIVE g AS (SELECT array_id, place, id, level, ts AS sent, level AS was, true AS goes FROM o WHERE place = 1
UNION ALL SELECT n.array_id, n.place, n.id, n.level, CASE WHEN n.f THEN n.ts ELSE n.sent END, CASE WHEN n.f THEN n.level ELSE n.was END, n.f FROM (SELECT o.*, g.sent, g.was, o.ts - g.sent >= INTERVAL 24 HOUR AND o.level <> g.was AS f FROM g JOIN o ON o.array_id = g.array_id AND o.place = g.place + 1) n) SELECT * FROM g)
SELECT id FROM g WHERE goes"""
)
def status_throttle(spark: SparkSession, sf: str) -> DataFrame:
    return lifecycle.throttled(alerts(spark, sf), ["array_id"], 86_400, "level").select("id")


@query(", h AS (SELECT array_id, observer, max(value) AS best, min(ts) AS seen FROM alerts WHERE ts < TIMESTAMP '2024-01-20' GROUP BY 1, 2), n AS (SELECT array_id, observer, max(value) AS best, CAST(NULL AS TIMESTAMP) AS seen FROM alerts WHERE ts >= TIMESTAMP '2024-01-20' GROUP BY 1, 2) SELECT coalesce(h.array_id, n.array_id) AS array_id, coalesce(h.observer, n.observer) AS observer, coalesce(n.best, h.best) AS best, coalesce(n.seen, h.seen) AS seen FROM h FULL JOIN n ON h.array_id = n.array_id AND h.observer = n.observer")
def upsert_merge(spark: SparkSession, sf: str) -> DataFrame:
    a, cut = alerts(spark, sf), F.lit("2024-01-20").cast("timestamp_ntz")
    held = a.where(F.col("ts") < cut).groupBy(*KEY).agg(F.max("value").alias("best"), F.min("ts").alias("seen"))
    new = a.where(F.col("ts") >= cut).groupBy(*KEY).agg(F.max("value").alias("best")).withColumn("seen", F.lit(None).cast("timestamp_ntz"))
    return lifecycle.upsert(held, new, KEY)


@query("SELECT id, CASE WHEN ts >= TIMESTAMP '2024-01-24' THEN 'active' WHEN ts >= TIMESTAMP '2024-01-08' THEN 'archive' ELSE 'expired' END AS place, strftime(ts, '%Y-%m') AS year_month FROM alerts")
def retention_split(spark: SparkSession, sf: str) -> DataFrame:
    return lifecycle.archive_split(alerts(spark, sf), F.lit("2024-01-24").cast("timestamp_ntz"), F.lit("2024-01-08").cast("timestamp_ntz")).select("id", "place", "year_month")


@query("SELECT array_id, strftime(ts, '%Y-%m') AS year_month, count(*) AS n, CAST(sum(length(details)) AS BIGINT) AS size, min(ts) AS oldest FROM alerts GROUP BY 1, 2")
def archive_rollup(spark: SparkSession, sf: str) -> DataFrame:
    held = alerts(spark, sf).groupBy("array_id", F.date_format("ts", "yyyy-MM").alias("year_month"))
    return held.agg(F.count("*").alias("n"), F.sum(F.length("details")).alias("size"), F.min("ts").alias("oldest"))


@query("SELECT id FROM alerts ORDER BY ts DESC, id DESC LIMIT 500")
def ring_buffer(spark: SparkSession, sf: str) -> DataFrame:
    return lifecycle.ring(alerts(spark, sf), 500)[0].select("id")


@query(f"SELECT id FROM alerts WHERE epoch_us(ts) >= epoch_us(TIMESTAMP '{NOW}') - 7200000000")
def traffic_retention(spark: SparkSession, sf: str) -> DataFrame:
    return lifecycle.retained(alerts(spark, sf), now(), 7200).select("id")


# Text


@query(r"SELECT doc_id, len(regexp_extract_all(text, '[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+')) AS n_addresses, CASE WHEN len(regexp_extract_all(text, '[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+')) > 0 THEN 'normal' ELSE 'abnormal' END AS verdict FROM documents", raw=True)
def regex_rule_eval(spark: SparkSession, sf: str) -> DataFrame:
    found = tx.find_all(F.col("text"), r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", 0)
    return table(spark, sf, "documents").select("doc_id", F.size(found).cast("long").alias("n_addresses"), tx.verdict(found, "valid_match").alias("verdict"))


@query(r"SELECT turn, conv_id, array_to_string(regexp_extract_all(text, '(\w+)@(\w+)', 1), ',') AS users FROM conversations", raw=True)
def regex_extract_fields(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").select("turn", "conv_id", F.array_join(tx.find_all(F.col("text"), r"([A-Za-z0-9_]+)@([A-Za-z0-9_]+)", 1), ",").alias("users"))


@query("SELECT id, json_extract_string(details, '$.k') AS k, CAST(json_extract_string(details, '$.k') AS DOUBLE) > 50 AS high FROM alerts")
def json_extract(spark: SparkSession, sf: str) -> DataFrame:
    k = tx.json_path(F.col("details"), "$.k")
    return alerts(spark, sf).select("id", k.alias("k"), tx.holds(k, ">", "50").alias("high"))


@query("SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[0-9]'))) AS n FROM documents", raw=True)
def lines_count(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", tx.line_count(F.col("text"), "[0-9]").cast("long").alias("n"))


@query("SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[0-9]'))[1] AS line FROM documents", raw=True)
def first_matching_line(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", tx.first_line(F.col("text"), "[0-9]").alias("line"))


def in_sql(column: str) -> str:
    """The redaction of a column in the checks' SQL."""
    for pattern, instead in tx.SECRETS:
        column = f"regexp_replace({column}, '{pattern}', '{instead.replace('$1', chr(92) + '1')}', 'g')"
    return column


@query(f"SELECT doc_id AS id, md5({in_sql('text')}) AS digest FROM documents UNION ALL SELECT id, md5({in_sql('line')}) FROM loglines")
def redact_secrets(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text").union(log_lines(spark, sf).select("id", "line"))
    return rows.select("id", F.md5(tx.redacted(F.col("text")).cast("binary")).alias("digest"))


@query(f", p AS (SELECT *, lag(k) {OVER} AS before FROM alerts) SELECT id FROM p WHERE k > before")
def diff_increased(spark: SparkSession, sf: str) -> DataFrame:
    before = F.lag("k").over(detectors.ordered(KEY))
    held = alerts(spark, sf).withColumn("before", before)
    return held.where(tx.moved(F.col("k").cast("string"), F.col("before").cast("string"), "increased")).select("id")


@query("SELECT id, 'observer ' || observer || ' is ' || level || ' at ' || CAST(k AS VARCHAR) AS said FROM alerts WHERE rank = 3")
def rendered_messages(spark: SparkSession, sf: str) -> DataFrame:
    said = tx.rendered("observer {observer} is {level} at {k}", observer=F.col("observer"), level=F.col("level"), k=F.col("k"))
    return store.matching(alerts(spark, sf), level="critical").select("id", said.alias("said"))


@query("SELECT count(*) FILTER (WHERE k < 50) AS alert, count(*) FILTER (WHERE k >= 50 AND k < 90) AS metrics, count(*) FILTER (WHERE k >= 90) AS error FROM alerts")
def pushed_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    lines = alerts(spark, sf).select(F.to_json(F.struct(F.when(F.col("k") < 50, "alert").when(F.col("k") < 90, "metrics").alias("type"), "message")).alias("value"))
    return readers.outcomes(lines)


@query("SELECT observer, level, count(*) AS n FROM alerts GROUP BY 1, 2")
def alert_log_parse(spark: SparkSession, sf: str) -> DataFrame:
    lines = alerts(spark, sf).select(F.to_json(F.struct(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"), F.col("observer").alias("observer_name"), F.upper("level").alias("level"), "message", "details")).alias("value"))
    bad = spark.createDataFrame([("no json",), ('{"level": "error"}',)], "value string")
    return readers.parsed_alerts(lines.union(bad)).where("ok").groupBy("observer", "level").agg(F.count("*").alias("n"))


# Small reads

AT = "TIMESTAMP '2024-01-04 18:00:00'"


@query(f"SELECT r.array_id, min(t.task_id) AS task_id, min(t.task_id) IS NULL AS available FROM (SELECT DISTINCT array_id FROM alerts) r LEFT JOIN tasks t ON t.started_at <= {AT} AND (t.ended_at IS NULL OR t.ended_at > {AT}) AND (len(t.array_ids) = 0 OR list_contains(t.array_ids, r.array_id)) GROUP BY 1")
def lock_check(spark: SparkSession, sf: str) -> DataFrame:
    return reads.lock_check(alerts(spark, sf), test_windows(spark), F.lit("2024-01-04 18:00:00").cast("timestamp_ntz"))


@query("SELECT r.array_id, min(t.task_id) AS task_id, min(t.task_id) IS NULL AS available FROM (SELECT DISTINCT array_id FROM alerts) r LEFT JOIN tasks t ON t.started_at <= TIMESTAMP '2024-01-15 12:00:00' AND (t.ended_at IS NULL OR t.ended_at > TIMESTAMP '2024-01-15 12:00:00') AND (len(t.array_ids) = 0 OR list_contains(t.array_ids, r.array_id)) GROUP BY 1")
def lock_check_some_free(spark: SparkSession, sf: str) -> DataFrame:
    return reads.lock_check(alerts(spark, sf), test_windows(spark), F.lit("2024-01-15 12:00:00").cast("timestamp_ntz"))


@query(f"SELECT array_id AS user, ts FROM (SELECT *, row_number() OVER (PARTITION BY array_id ORDER BY ts DESC, id DESC) AS rn FROM alerts) WHERE rn = 1 AND observer = 'view' AND ts > TIMESTAMP '{NOW}' - INTERVAL 20 DAY")
def users_on_page(spark: SparkSession, sf: str) -> DataFrame:
    visits = alerts(spark, sf).select(F.col("array_id").alias("user"), "ts", "id", F.col("observer").alias("page"))
    return reads.on_page(visits, "view", now(), "20 days")


@query(f"""
    , ports AS (SELECT array_id, observer, arg_max(level, (ts, id)) FILTER (WHERE ts >= TIMESTAMP '{NOW}' - INTERVAL 10 DAY) AS mode, arg_max(k % 2, (ts, id)) FILTER (WHERE ts >= TIMESTAMP '{NOW}' - INTERVAL 10 DAY) AS protocol FROM alerts GROUP BY 1, 2),
    first AS (SELECT *, row_number() OVER (PARTITION BY array_id ORDER BY observer) AS place FROM ports)
    SELECT array_id, count(*) AS ports, string_agg(DISTINCT mode, ',' ORDER BY mode) AS modes, string_agg(DISTINCT CAST(protocol AS VARCHAR), ',' ORDER BY CAST(protocol AS VARCHAR)) AS protocols FROM first WHERE place <= 4 AND mode IS NOT NULL GROUP BY 1
    """)
def traffic_mode_info(spark: SparkSession, sf: str) -> DataFrame:
    points = alerts(spark, sf).select("array_id", "ts", "id", F.col("observer").alias("port"), F.col("level").alias("mode"), (F.col("k") % 2).cast("string").alias("protocol"))
    return reads.mode_info(points, now() - F.expr("interval 10 days"), 4)


@query("SELECT s_suppkey AS array_id FROM supplier WHERE s_nationkey IN (1, 2, 3) OR s_suppkey IN (1, 4, 9)", raw=True)
def deployment_targets(spark: SparkSession, sf: str) -> DataFrame:
    arrays = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("array_id"), F.col("s_nationkey").alias("tag_id"))
    return reads.targets(arrays, (1, 2, 3), (1, 4, 9))


@query(
    """
    WITH f AS (SELECT 'alerts.log.' || CAST(o_orderkey AS VARCHAR) AS name, o_orderkey * o_orderkey % 5000000 AS size FROM orders)
    SELECT name, size, 'Jan 02 03:04' AS modified,
           CASE WHEN size < 1024 THEN CAST(size AS VARCHAR) || ' B' WHEN size < 1048576 THEN printf('%.1f KB', size / 1024) ELSE printf('%.1f MB', size / 1048576) END AS size_human
    FROM f
    """,
    raw=True,
)
def log_files(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("o_orderkey")
    lines = table(spark, sf, "orders").select(F.concat(F.lit("-rw-r--r-- 1 root  root "), (key * key % 5_000_000).cast("string"), F.lit(" Jan 02 03:04 /var/log/points/alerts.log."), key.cast("string")).alias("value"))
    return reads.listed_files(lines.union(spark.createDataFrame([("total 12",), ("",), ("no file",)], "value string")))


@query(f"SELECT id FROM alerts WHERE id % 11 = 0 OR ts >= TIMESTAMP '{NOW}' - INTERVAL 3 DAY")
def metrics_cutoff(spark: SparkSession, sf: str) -> DataFrame:
    records = alerts(spark, sf).select("id", F.when(F.col("id") % 11 == 0, "no time").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS")).alias("ts"))
    return reads.since_cutoff(records, now() - F.expr("interval 3 days")).select("id")


@query("SELECT id, level, observer, ts FROM alerts WHERE level = 'error' AND observer LIKE '%i%' ORDER BY ts DESC, id DESC LIMIT 50")
def system_log(spark: SparkSession, sf: str) -> DataFrame:
    return reads.system_log(alerts(spark, sf).withColumn("module", F.upper("observer")), "error", "I", 50).select("id", "level", "observer", "ts")


@query("SELECT id, CASE WHEN id % 13 = 0 THEN 0 ELSE 1 END AS n_params, CASE WHEN id % 13 = 0 THEN NULL ELSE CAST(k AS VARCHAR) END AS k FROM alerts")
def observer_settings(spark: SparkSession, sf: str) -> DataFrame:
    rows = alerts(spark, sf).select("id", F.when(F.col("id") % 13 == 0, "{broken").otherwise(F.col("details")).alias("params"))
    return reads.settings(rows).select("id", F.size("params").alias("n_params"), F.try_element_at("params", F.lit("k")).alias("k"))


@query("SELECT k.alert_id, k.ack_type, a.level, CASE WHEN c.c_custkey % 3 = 0 THEN '10.0.0.' || c.c_custkey ELSE c.c_name END AS nickname FROM acks k JOIN alerts a ON a.id = k.alert_id LEFT JOIN customer c ON c.c_custkey = a.array_id")
def ack_detail(spark: SparkSession, sf: str) -> DataFrame:
    names = table(spark, sf, "customer").select(F.col("c_custkey").alias("array_id"), F.when(F.col("c_custkey") % 3 == 0, F.when(F.col("c_custkey") % 2 == 0, "  ")).otherwise(F.col("c_name")).alias("nickname"), F.concat(F.lit("10.0.0."), F.col("c_custkey").cast("string")).alias("ip"))
    return reads.ack_detail(acknowledgements(spark, sf), alerts(spark, sf), names).select("alert_id", "ack_type", "level", "nickname")


PROBES = {
    "service_active": "id % 2 = 0", "main_pid": "CASE WHEN id % 3 = 0 THEN 0 ELSE id END", "main_alive": "id % 5 <> 0", "main_matches": "id % 7 <> 0",
    "file_pid": "CASE WHEN id % 4 <> 0 THEN id + 1 END", "file_alive": "id % 6 <> 0", "file_matches": "id % 9 <> 0",
    "found_pid": "CASE WHEN id % 10 <> 0 THEN id + 2 END", "found_matches": "id % 11 <> 0",
}


@query(f"""
    , p AS (SELECT id, {", ".join(f"{v} AS {k}" for k, v in PROBES.items())} FROM alerts),
    e AS (SELECT *, service_active AND main_pid > 0 AND main_alive AND main_matches AS s, file_pid IS NOT NULL AND file_alive AND file_matches AS f, found_pid IS NOT NULL AND found_matches AS g FROM p)
    SELECT id, s OR f OR g AS running, CASE WHEN s THEN 'systemd' WHEN f THEN 'pidfile' WHEN g THEN 'pgrep' ELSE 'none' END AS source,
           CASE WHEN s OR f THEN 'high' WHEN g THEN 'medium' ELSE 'low' END AS confidence, CASE WHEN s THEN main_pid WHEN f THEN file_pid WHEN g THEN found_pid END AS pid,
           file_pid IS NOT NULL AND NOT file_alive AS stale
    FROM e
    """)
def agent_evidence(spark: SparkSession, sf: str) -> DataFrame:
    probes = alerts(spark, sf).selectExpr("id", *(f"{v} AS {k}" for k, v in PROBES.items()))
    return reads.evidence(probes).select("id", "running", "source", "confidence", "pid", "stale")


@query("SELECT id, CASE WHEN id % 3 = 0 THEN 'see ' || message END AS interpretation, id % 3 = 0 AS cached FROM alerts")
def cached_interpretations(spark: SparkSession, sf: str) -> DataFrame:
    held = alerts(spark, sf)
    cache = held.where("id % 3 = 0").select("id", F.concat(F.lit("see "), "message").alias("interpretation"))
    return reads.interpreted(held.select("id"), cache)


@query("SELECT o_orderkey AS id, o_orderdate AS created_at FROM orders WHERE o_orderstatus = 'O'", raw=True)
def issue_list(spark: SparkSession, sf: str) -> DataFrame:
    issues = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("created_at"), F.col("o_orderstatus").alias("status"))
    return reads.issue_list(issues, "O").select("id", "created_at")


from watchgrid import catalog_hosts, catalog_observers, catalog_text, catalog_views  # noqa: E402, F401
