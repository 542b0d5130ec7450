"""Boundary cases of the monitoring operators on small fixtures."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from watchgrid.functions import text as tx
from watchgrid.operators import aggregate, baseline, cards, detectors, episodes, issues, lifecycle
from watchgrid.plans import sqlguard
from watchgrid.sources import readers


def alerts(spark, rows):
    """rows: (array_id, observer, seconds, value)"""
    data = [(k, a, o, float(s), float(v)) for k, (a, o, s, v) in enumerate(rows)]
    df = spark.createDataFrame(data, "id long, array_id long, observer string, s double, value double")
    level = F.when(F.col("value") >= 2, "error").when(F.col("value") >= 1, "warning").otherwise("info")
    return df.withColumn("ts", F.timestamp_micros((F.col("s") * 1_000_000).cast("long")).cast("timestamp_ntz")).withColumn("level", level).withColumn("message", F.concat("observer", F.lit(" "), F.col("id").cast("string")))


def test_gap_at_the_border(spark):
    df = alerts(spark, [(1, "a", 0, 0), (1, "b", 60, 0), (1, "c", 121, 0)])
    got = {r.id: r.episode for r in episodes.split(df, 60).collect()}
    assert got == {0: 1, 1: 1, 2: 2}


def test_storm_of_exactly_the_threshold(spark):
    twenty = [(1, "a", k * 3, 1) for k in range(20)]
    assert [r["size"] for r in aggregate.storms(alerts(spark, twenty)).collect()] == [20]
    assert aggregate.storms(alerts(spark, twenty[:19])).count() == 0
    same_moment = [(1, "a", 0, 1)] * 25
    assert [r["size"] for r in aggregate.storms(alerts(spark, same_moment)).collect()] == [20]


def test_anchor_does_not_chain(spark):
    df = alerts(spark, [(1, "a", s, 1) for s in (0, 8, 16)])
    assert sorted(r["size"] for r in aggregate.anchored(df, 10).collect()) == [1, 2]


def test_correlation_is_all_or_nothing(spark):
    df = alerts(spark, [(1, "a", 0, 1), (1, "b", 29, 1), (2, "a", 0, 1), (2, "b", 20, 1), (2, "c", 40, 1)])
    assert [r.array_id for r in aggregate.correlated(df, ["array_id"], 30).collect()] == [1]


def test_equal_times_are_mined_but_give_no_edge(spark):
    df = alerts(spark, [(1, "a", 0, 1), (1, "b", 0, 1)])
    held = episodes.split(df)
    assert [(r.antecedent, r.consequent, r.lag_s) for r in episodes.pairs(held).collect()] == [("a", "b", 0.0)]
    known = spark.createDataFrame([(1, "a", "b")], "array_id long, antecedent string, consequent string")
    assert {r.role for r in episodes.roles(held, known).collect()} == {"isolated"}


def test_delta_borders(spark):
    df = alerts(spark, [(1, "a", k, v) for k, v in enumerate([5, 15, 26, 20, 10_000_030, 30_000_000])])
    got = detectors.delta(df, ["array_id"], "value", threshold=10)
    assert [r.id for r in got.orderBy("id").collect()] == [2]  # +11; +10 is the threshold, the others resets


def test_hysteresis_recovers_once(spark):
    df = alerts(spark, [(1, "a", k, v) for k, v in enumerate([1, 9, 9, 9, 1, 1, 9, 1])])
    got = detectors.hysteresis(df, ["array_id"], "value", 9, 2)
    assert [(r.id, r.event) for r in got.orderBy("id").collect()] == [(2, "enter"), (3, "stay"), (4, "recovered")]


def test_cooldown_counts_from_the_last_sent(spark):
    df = alerts(spark, [(1, "a", s, 1) for s in (0, 200, 299, 300, 500, 600)])
    assert sorted(r.s for r in detectors.cooled(df, ["array_id"], 300).collect()) == [0, 300, 600]


def test_leak_enters_and_leaves(spark):
    df = alerts(spark, [(1, "a", k, v) for k, v in enumerate([1, 2, 3, 4, 5, 4, 6, 5, 4, 5])])
    assert sorted(r.id for r in detectors.leak(df, ["array_id"], "value", 4, 3).collect()) == [3, 4, 5, 6, 7]


def test_baseline_border_is_normal(spark):
    df = alerts(spark, [(1, "a", k, v) for k, v in enumerate([0, 1, 2])])
    learned = baseline.learn(df, ["array_id"])
    points = alerts(spark, [(1, "a", 0, 4), (1, "a", 1, 4.1), (2, "a", 0, 1)])
    assert [r.status for r in baseline.judged(points, learned, ["array_id"]).orderBy("id").collect()] == ["normal", "anomalous", "no_baseline"]
    assert baseline.learn(df.limit(2), ["array_id"]).count() == 0


def test_upsert_and_first_by(spark):
    held = spark.createDataFrame([(1, "x", 1), (2, "y", 2)], "k int, a string, b int")
    new = spark.createDataFrame([(2, None, 5), (3, "z", 7)], "k int, a string, b int")
    assert sorted(map(tuple, lifecycle.upsert(held, new, ["k"]).collect())) == [(1, "x", 1), (2, "y", 5), (3, "z", 7)]
    cards = spark.createDataFrame([("b1", 1), ("b1", 2), ("", 3), (None, 4)], "board string, n int")
    assert sorted(r.n for r in lifecycle.first_by(cards, "board", ["n"]).collect()) == [1, 3, 4]


def test_issue_parts(spark):
    details = '{"active_alarms": [{"alarm_id": "7"}], "downgrades": ["pcie0 x8 to x4"], "alerts": [{"card": "No1", "fields": [{"field": "temp"}]}]}'
    df = spark.createDataFrame([(details, "warning"), (details, "info"), ("{}", "error")], "d string, level string")
    ts = F.lit("2024-01-01").cast("timestamp_ntz")
    keys = lambda o, any_level=False: [[i.key for i in r[0]] for r in df.select(issues.parts(F.lit(o), F.col("level"), F.lit("m"), F.col("d"), ts, any_level)).collect()]
    assert keys("alarm_type") == [["alarm_type:7"], ["alarm_type:7"], []]
    assert keys("pcie_bandwidth") == [["pcie_bandwidth:pcie0"], [], []]
    assert keys("card_info") == [["card_info:No1:temp"], [], []] and keys("card_info", True)[1] == ["card_info:No1:temp"]
    assert keys("cpu_usage") == [["cpu_usage"], [], ["cpu_usage"]] and keys("error_code") == [[], [], []] and keys("other") == [[], [], []]


def test_text_functions(spark):
    text = "# note\nName = eth0\nspeed: 10\n\nport  state  rate\np1    up     5\np2    down   7"
    df = spark.createDataFrame([(text,)], "t string")
    t = F.col("t")
    got = df.select(
        tx.key_value(t, "name").alias("kv"), tx.key_value(t, "SPEED").alias("colon"), tx.pipe(t, "p2", r"\s+", -1).alias("pipe"), tx.pipe(t, "p2", r"\s+", 9).alias("far"),
        tx.line_count(t, "^p").alias("n"), tx.masked(F.lit("abcdefg")).alias("masked"), tx.masked(F.lit("abc")).alias("short"),
        tx.slot_key(F.lit("04.40.00")).alias("slot"), tx.stamp(F.lit("x 2024-01-02 03:04:05 y")).alias("stamp"), F.array_join(tx.find_all(F.lit("a1 b2"), r"([a-z])(\d)", 2), "").alias("groups"),
        tx.moved(F.lit("3"), F.lit("2"), "increased").alias("up"), tx.moved(F.lit("3"), F.lit(None).cast("string"), "changed").alias("first"), tx.holds(F.lit("Abc"), "contains", "BC").alias("has"),
    ).first().asDict()
    assert got == {"kv": "eth0", "colon": "10", "pipe": "7", "far": None, "n": 3, "masked": "ab***fg", "short": "***", "slot": "4.40.0", "stamp": "2024-01-02 03:04:05", "groups": "a1b2", "up": True, "first": False, "has": True}
    table = df.select(tx.table_cell(F.lit("port  state\np1  up"), "STA").alias("c")).first().c
    assert table == "up"
    assert tx.checked(spark, "(") and tx.checked(spark, "a+") is None


def test_cards(spark):
    text = "x: 0\nNo001 Model: X1\nModel: X2\nstate: a\nstate: b\n-----\nmodel: 9\nNo002\nModel: N/A\nNo003 BoardId=7\n\nNo003 CardNo: c9\n----"
    df = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "-----\n")], "k long, text string")
    got = {r.card_no: r for r in cards.records(df, ["k"]).collect()}
    assert set(got) == {"No001", "No002", "c9"} and {r.k for r in got.values()} == {1}
    assert got["No001"].model == "X2" and got["No001"].raw == {"Model": "X2", "state": "b"} and got["No002"].model == "" and got["c9"].board_id == "7"
    issues_of = {(r.card_no, r.field, r.level) for r in cards.assertions(cards.records(df, ["k"])).collect()}
    assert ("No001", "running_state", "warning") in issues_of and ("No001", "model", "warning") not in issues_of


def test_card_upsert_by_number(spark):
    shape = "array_id long, board_id string, card_no string, running_state string, health_state string, model string"
    held = spark.createDataFrame([(1, "b1", "n1", "", "", "old"), (1, "", "n2", "", "", "old"), (2, "b1", "n1", "", "", "old")], shape)
    new = spark.createDataFrame([(1, "b1", "n9", "", "", "new", 1), (1, "b2", "n2", "", "", "new", 2), (1, "b2", "n7", "", "", "late", 3), (1, "", "", "", "", "x", 4), (1, "", "", "", "", "y", 5)], shape + ", block int")
    got = sorted((r.array_id, r.board_id, r.card_no, r.model) for r in cards.upserted(held, new).collect())
    assert got == [(1, "", "", "x"), (1, "", "", "y"), (1, "b1", "n9", "new"), (1, "b2", "n2", "new"), (2, "b1", "n1", "old")]


@pytest.mark.parametrize(
    ("sql", "good"),
    [
        ("select id, level from alerts where message = 'drop table x'", True),
        ("SELECT a.id FROM alerts a JOIN arrays b ON a.array_id = b.id -- note", True),
        ("select level, count(1) as n from alerts group by level having count(1) > 1 order by n limit 5;", True),
        ("select id from `alerts`", True),
        ("select * from alerts", False),
        ("select a.* from alerts a", False),
        ("select password from arrays", False),
        ("select id from secrets", False),
        ("select id from alerts, secrets", False),
        ("select id from alerts union select id from arrays", False),
        ("select id from (select id from alerts) x", True),
        ("select id from alerts where id in (select id from arrays)", False),
        ("with x as (select id from alerts) select id from x", False),
        ("drop table alerts", False),
        ("insert into alerts select id from alerts", False),
        ("select id from alerts; drop table alerts", False),
        ("delete from alerts", False),
        ("sel", False),
        ("SELECT id, message FROM alerts WHERE message LIKE '%drop%' OR message = 'select all items' OR message LIKE '%password%'", True),
        ("SELECT observer_name, count(id) AS n FROM alerts GROUP BY observer_name", True),
        ("SELECT id, upper(level) AS l, CASE WHEN id > 3 THEN 1 ELSE 0 END AS c FROM alerts WHERE id BETWEEN 1 AND 9 AND level IN ('a', 'b') AND message IS NOT NULL ORDER BY 1", True),
        ("SELECT id, row_number() OVER (PARTITION BY level ORDER BY id) AS n FROM alerts", True),
        ("select reflect('java.lang.System', 'getProperty', 'user.home') as x from alerts", False),
        ("select java_method('java.lang.System', 'getProperty', 'user.home') as x from alerts", False),
        ("select try_reflect('java.lang.System', 'getProperty', 'user.home') as x from alerts", False),
        ("select input_file_name() as x from alerts", False),
        ("select current_user() as x from alerts", False),
        ("select spark_catalog.default.f(id) as x from alerts", False),
        ("select alerts.password.x from alerts", False),
        ("select a.`PassWord` from arrays a", False),
        ("select password.x as y from arrays", False),
        ("select a.id from alerts a join arrays b using (password)", False),
        ("select a.id from alerts a join arrays b using (id)", True),
        ("select id from alerts natural join arrays", False),
        ("select id from alerts order by password", False),
        ("select count(*) as n from alerts", True),
        ("select id from range(5)", False),
        ("select id from parquet.`/etc`", False),
        ("select 1 as x", False),
        ("select id from alerts, lateral (select password from arrays)", False),
        ("select id from alerts lateral view explode(array(1)) t as x", False),
        ("select transform(id) using 'cat' as x from alerts", False),
        ("select id from alerts where exists (select 1 from arrays)", False),
        ("select (select max(id) from arrays) as x from alerts", False),
        ("select id from values (1) as t(id)", False),
        ("select id from alerts intersect select id from arrays", False),
        ("select id from alerts except select id from arrays", False),
        ("update alerts set id = 1", False),
        ("create table x as select id from alerts", False),
        ("select /* comment */ id from alerts -- password", True),
    ],
)
def test_sql_guard(spark, sql, good):
    if good:
        sqlguard.validate(spark, sql, {"alerts", "arrays"}, {"password"})
    else:
        with pytest.raises(sqlguard.Rejected):
            sqlguard.validate(spark, sql, {"alerts", "arrays"}, {"password"})


def test_guarded_run_is_limited(spark):
    spark.range(500).createOrReplaceTempView("alerts")
    assert sqlguard.run(spark, "select id from alerts", {"alerts"}, set()).count() == 200


def test_readers(spark, tmp_path):
    lines = ['{"timestamp": "2024-01-01T00:00:00Z", "observer_name": "a", "level": "ERROR"}', "junk", '{"timestamp": "2024-01-01 00:00:01", "observer_name": "b", "level": "odd"}']
    (tmp_path / "alerts.log").write_text("\n".join(lines))
    got = readers.read_alert_log(spark, f"file://{tmp_path}/alerts.log").orderBy("ts").collect()
    assert [(r.observer, r.level) for r in got] == [("a", "error"), ("b", "info")]
    traffic = spark.createDataFrame([('{"timestamp": "2024-01-01 00:00:00"}',), ("x",)], "value string")
    assert [(r.port, r.tx_rate, r.mode) for r in readers.parsed_traffic(traffic).collect()] == [("unknown", 0.0, "auto")]
    rows = spark.createDataFrame([("n", " 10.0.0.1 ", "x"), ("m", "", "99")], "Array_Name string, IP string, Port string")
    assert [(r.name, r.host, r.port, r.reason) for r in readers.dimension(rows).collect()] == [("n", "10.0.0.1", 22, None), ("m", None, 99, "no host")]


def test_archive_and_export(spark, tmp_path):
    df = alerts(spark, [(1, "a", 0, 1), (2, "b", 3_000_000, 2)])
    lifecycle.archive(df, f"file://{tmp_path}/arc")
    assert spark.read.parquet(f"file://{tmp_path}/arc").where("year_month = '1970-02'").count() == 1
    readers.export_csv(df, f"file://{tmp_path}/csv")
    assert spark.read.option("header", True).csv(f"file://{tmp_path}/csv").first().time == "1970-02-04 17:20:00"
