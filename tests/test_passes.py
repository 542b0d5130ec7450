"""Greedy passes, causes, views and log detectors against brute force on small fixtures."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from watchgrid.functions import templates
from watchgrid.functions import text as tx
from watchgrid.operators import aggregate, detectors, episodes, issues, lifecycle, logs, passes, ports, rules, views
from watchgrid.operators.passes import anchors, cooldown, gate, ordered_pass, throttle


def rows(spark, data, columns="array_id long, observer string, s double, value double"):
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(data)], f"id long, {columns}")
    return df.withColumn("ts", F.timestamp_micros((F.col("s") * 1_000_000).cast("long")).cast("timestamp_ntz"))


@pytest.fixture(scope="module")
def random_rows(spark):
    rng = random.Random(5)
    data = [(rng.choice([1, 2, None]), rng.choice(["a", None]), float(rng.randrange(0, 400)), float(rng.randrange(0, 4))) for _ in range(600)]
    return data, rows(spark, data).cache()


def by_key(data):
    keys: dict = {}
    for k, r in enumerate(data):
        keys.setdefault(r[:2], []).append((r[2], k, r[3]))
    return [sorted(v) for v in keys.values()]


@pytest.mark.parametrize(("batch", "size"), [(7, None), (10_000, None), (7, 20), (10_000, 60)])
def test_passes_by_brute_force(spark, random_rows, monkeypatch, batch, size):
    """The results of whole keys and of keys that are cut into slices of about size rows."""
    if size:
        monkeypatch.setattr(passes, "SLICE", size)
        monkeypatch.setattr(passes, "UNIT", 5_000_000)
    data, df = random_rows
    anchor, sent, stuck, fired, sends = {}, set(), set(), set(), set()
    for moments in by_key(data):
        at = last = pinned = done = None
        run, state = 0, None
        for s, k, v in moments:
            if at is None or s - at > 10:
                at = s
            anchor[k] = int(at * 1_000_000)
            if last is None or s - last >= 12:
                last = s
                sent.add(k)
            if pinned is None or v == 3 or s - pinned >= 12:
                pinned = s
                stuck.add(k)
            run = run + 1 if v >= 1 else 0
            if run >= 3 and (done is None or s - done >= 15):
                done, run = s, 0
                fired.add(k)
            if state is None or s - state[0] >= 5 and v != state[1]:
                state = (s, v)
                sends.add(k)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        by, ids = ["array_id", "observer"], lambda d: {r.id for r in d.collect()}
        assert {r.id: r.anchor for r in aggregate.anchored_rows(df, 10, by).collect()} == anchor
        assert ids(detectors.cooled(df, by, 12)) == sent
        held = df.withColumn("sticky", F.col("value") == 3).withColumn("level", F.lit("info"))
        assert ids(detectors.reported(held, by, 12)) == stuck
        assert ids(detectors.consecutive_gate(df.withColumn("high", F.col("value") >= 1), by, "high", 3, 15)) == fired
        assert ids(lifecycle.throttled(df, by, 5)) == sends
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_passes_on_edges(spark):
    none = rows(spark, [(1, "a", 0.0, 0.0)]).limit(0)
    for step, kind, using in ((anchors(1), "bigint", ()), (cooldown(1), "boolean", ()), (gate(1, 1, "value"), "boolean", ("value",)), (throttle(1, "value"), "boolean", ("value",))):
        assert ordered_pass(none, ["array_id"], step, "r", T.LongType() if kind == "bigint" else T.BooleanType(), using).count() == 0
    lost = rows(spark, [(1, "a", None, 0.0), (1, "a", 1.0, 0.0)])
    assert [r.id for r in detectors.cooled(lost, ["array_id"], 10).collect()] == [1]


def test_one_key_with_very_many_rows(spark):
    df = spark.range(200_000).select("id", F.lit(1).alias("array_id"), F.timestamp_seconds("id").cast("timestamp_ntz").alias("ts"))
    assert detectors.cooled(df, ["array_id"], 300).count() == 667


def domain(spark, data):
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(data)], "id long, array_id long, observer string, s double, message string, details string")
    return df.withColumn("ts", F.timestamp_micros((F.col("s") * 1_000_000).cast("long")).cast("timestamp_ntz")).withColumn("level", F.lit("warning"))


def test_causes_claim_before_merging(spark):
    port = '{"changes":[{"port":"eth1"}]}'
    df = domain(spark, [
        (1, "link_status", 0.0, "eth9", port), (2, "port_fec", 10.0, "x", port), (1, "port_speed", 30.0, "eth1 slow", None),
        (1, "link_status", 5.0, "eth7 down", '{"changes":[{"port":""}]}'), (1, "link_status", 6.0, "ens7f0 up", "{}"),
        (3, "card_info", 0.0, "no12 bad", "{}"), (4, "card_recovery", 31.0, "No12", "{}"), (1, "cpu_usage", 0.0, "m", None), (1, "cpu_usage", 8.0, "m", None), (1, "cpu_usage", None, "m", None),
    ])
    got = aggregate.root_causes(df, 30).collect()
    assert [(r.rule, r.key, r["size"]) for r in got] == [("port", "eth1", 3)]
    view = aggregate.aggregated(df, 60, 20, 30, 10).collect()
    assert sorted((r.kind, r.key, r["size"]) for r in view) == sorted([("root_cause", "eth1", 3), ("time_window", "", 2), ("single", "", 1), ("single", "", 1), ("time_window", "", 2), ("single", "", 1)])
    assert sum(r["size"] for r in view) == df.count()
    assert [r.latest for r in view] == sorted((r.latest for r in view), key=lambda t: (t is not None, t), reverse=True)
    members = {r.id: r.kind for r in aggregate.members(df, 30, 10).collect()}
    assert len(members) == df.count() and {k for k, v in members.items() if v == "root_cause"} == {0, 1, 2}


def test_bad_states_alert_each_cycle(spark):
    df = rows(spark, [(1, "fault", 0.0, 0.0), (1, "fault", 1.0, 0.0), (1, "Fault", 2.0, 0.0), (1, "online", 3.0, 0.0), (1, "online", 4.0, 0.0)]).withColumnRenamed("observer", "state").withColumn("unit", F.lit("c0"))
    assert sorted(r.id for r in detectors.controllers(df).collect()) == [0, 1, 2, 3]
    got = {r.id: r.level for r in detectors.disks(df).collect()}
    assert got == {0: "error", 1: "error", 2: "error", 3: "warning"}


def test_tree(spark):
    assert [r["role"] for r in episodes.walked(["b", "a"], [])] == ["isolated", "isolated"]
    got = episodes.walked(["a", "b", "c", "d", "e"], [("a", "c"), ("b", "c"), ("c", "d")])
    assert [(r["observer"], r["role"], r["parent"], r["depth"], r["expanded"]) for r in got] == [
        ("a", "root", None, 0, True), ("c", "consequence", "a", 1, True), ("d", "consequence", "c", 2, True), ("b", "root", None, 0, True), ("c", "consequence", "b", 1, False), ("e", "root", None, 0, True),
    ]
    deep = [str(k).zfill(5) for k in range(5000)]
    assert episodes.walked(deep, list(zip(deep, deep[1:])))[-1]["depth"] == 4999
    df = rows(spark, [(1, "a", 0.0, 0.0), (1, "b", 1.0, 0.0), (1, "c", 1.0, 0.0)])
    known = spark.createDataFrame([(1, "a", "b"), (1, "b", "c")], "array_id long, antecedent string, consequent string")
    got = {(r.observer, r.role, r.parent) for r in episodes.tree(episodes.firsts(episodes.split(df)), known).collect()}
    assert got == {("a", "root", None), ("b", "consequence", "a"), ("c", "root", None)}


def test_invalid_patterns_are_skipped(spark):
    df = spark.createDataFrame([("t", "cpu(", "info", "x")], "task_type string, observer string, level string, message string")
    ask = lambda **kw: rules.expected(df, [rules.Rule(1, 1, **kw)]).first().matched_rule_id
    assert ask(messages=("(", "x")) == 1 and ask(messages=("(",)) is None and ask(observers=("cpu(",)) == 1 and ask(observers=("(",)) is None and ask() == 1


def test_incremental_issues(spark):
    df = domain(spark, [
        (1, "cpu_usage", 0.0, "a", "{}"), (1, "cpu_usage", 1.0, "b", '{"recovered": true}'), (1, "cpu_usage", 2.0, "c", "{}"), (1, "cpu_usage", 3.0, "d", "{}"),
        (1, "alarm_type", 0.0, "", '{"active_alarms":[{"alarm_id":"1"},{"alarm_id":"2"}]}'), (1, "alarm_type", 1.0, "", '{"active_alarms":[{"alarm_id":"2","obj_type":"fan"}]}'),
        (2, "memory_leak", 0.0, "a", "{}"), (2, "memory_leak", 1.0, "b", '{"recovered": true}'), (2, "unknown", 0.0, "a", "{}"),
    ])
    got = {(r.array_id, r.key, r.message, r.since.second) for r in issues.followed(df).collect()}
    assert got == {(1, "cpu_usage", "d", 2), (1, "alarm_type:2", "AlarmId:2 objType:fan", 1)}


def test_stale_acknowledgements(spark):
    df = domain(spark, [(1, "cpu_usage", 0.0, "a", '{"recovered": true}'), (1, "cpu_usage", 1.0, "b", "{}"), (2, "cpu_usage", 0.0, "a", "{}"), (2, "cpu_usage", 1.0, "b", "{}"), (3, "card_info", 1.0, "b", '{"alerts":[{"card":"1","fields":[{"field":"f"}]}]}')])
    acks = rows(spark, [(1, "x", 2.0, 0.0), (3, "x", 2.0, 0.0), (4, "x", 2.0, 0.0)]).select(F.col("array_id").alias("alert_id"), F.col("ts").alias("acked_at"))
    late = spark.createDataFrame([(3, "card_info")], "array_id long, observer string").withColumn("recovered_at", F.lit("1970-01-02").cast("timestamp_ntz"))
    assert sorted(r.alert_id for r in issues.stale_acks(df, acks, late).collect()) == [1, 4]
    assert {r.key: r.suppressed for r in issues.active(df, acks, late).collect() if r.array_id != 1} == {"cpu_usage": True, "card_info:1:f": False}


def test_log_detectors(spark):
    lines = ["my-app.x[12]: segfault at 0", "Killed process 7 (abc)", "Oops: and Call Trace: too", "password=abc", "password=Secr3t!x", "password_file: /etc/x", "password: changeme", "passwd=my_setting_name", "token = tok_12345678", "api-key: 12345678", "1.2.3.4, admin, pw", "IQN.2001-04.org:disk", "password=****** and token=Abcdef1"]
    df = spark.createDataFrame(list(enumerate(lines)), "id long, line string")
    assert [(r.id, r.kind, r.process) for r in logs.crashes(df).orderBy("id").collect()] == [(0, "segfault", "my-app.x[12]"), (1, "oom_kill", "abc[7]"), (2, "kernel_panic", "")]
    got = sorted((r.id, r.category, r.shown) for r in logs.sensitive(df).collect())
    assert got == [(4, "password", "Se***!x"), (8, "secret", "to***78"), (10, "ip_with_cred", "1.***.4"), (11, "iqn", "IQ***sk")]
    assert logs.sensitive(df, paths=("IQN",), allowed=("admin",)).count() == 2
    text = "time: 1\nreason: oops reset\n\nreason: user\ntime: 2\n \n\nreason: BIOS RESET now\ntime: 3\n\nreason: mce reset\n\ntime: 3\nReason : panic reset"
    resets = spark.createDataFrame([(1, text), (2, None), (3, "")], "k long, text string")
    assert sorted((r.time, r.reason) for r in logs.resets(resets, ["k"]).collect()) == [("1", "oops reset"), ("3", "BIOS RESET now")]


def test_counter_borders(spark):
    df = rows(spark, [(1, "rx_dropped", float(k), float(v)) for k, v in enumerate([5, 15, 26, 20, 10_000_031, 10_000_042])] + [(1, "fcs_errors", 0.0, 0.0), (1, "fcs_errors", 1.0, 1.0)])
    got = ports.counter_alerts(df.withColumnRenamed("observer", "counter").withColumn("port", F.lit("p")))
    assert sorted((r.id, r.category, r.level) for r in got.collect()) == [(2, "drop", "info"), (5, "drop", "info"), (7, "physical_error", "warning")]
    ranks = spark.createDataFrame([("2.5GT/s",), ("5GT/s",), ("5.0GT/s",), ("Gen4",), ("speed 32GT",), ("",), (None,)], "s string").select(ports.speed_rank(F.col("s")).alias("r"))
    assert [r.r for r in ranks.collect()] == [1, 2, 2, 4, 5, 0, 0]


def test_pairs_and_templates(spark):
    df = spark.createDataFrame([("a = 1\nb: 2=3\n\nnone\na=4\nt\t5",)], "t string")
    assert df.select(tx.pairs(F.col("t")).alias("m")).first().m == {"a": "4", "b: 2": "3"}
    assert templates.converted("contains", "a.b") == ("lines", {"pattern": r"a\.b", "mode": "count"}) and templates.converted("kv", '{"key": 1}') == ("kv", {"key": 1}) and templates.converted("kv", "[1") == ("kv", {})
    assert templates.tested(spark, "(", "x")[0] and templates.tested(spark, "(a)(b)?", "ab a", 2) == (None, ["a", "b", "a"])


def test_nickname_claim(spark):
    df = spark.createDataFrame([("1", "x", 1), ("2", "y", 2), ("3", None, 3)], "ip string, nickname string, seen_at int")
    got = lambda ip, n: sorted((r.ip, r.nickname) for r in views.claimed(df, ip, n).collect() if r.nickname)
    assert got("2", "x") == [("2", "x")] and got("9", "x") == [("2", "y"), ("9", "x")] and got("1", "x") == got("5", "nobody") == [("1", "x"), ("2", "y")]
