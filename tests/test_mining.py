"""Incremental mining against mining anew, exact medians of large groups, and the interval join against brute force."""

from __future__ import annotations

import random
import statistics
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from watchgrid.operators import baseline, episodes, mining, ranks, tasks
from watchgrid.schema import observed

SF = "/root/testdata/sf0.001"


def test_each_period_says_what_mining_anew_says(spark, tmp_path):
    held = observed(spark, SF).where("array_id < 8").cache()
    gap, days, before = 8 * 3600, 10, None
    store = mining.Store(spark, str(tmp_path / "store"), gap)
    for k, day in enumerate((6, 7, 8, 14, 23)):
        end = datetime(2024, 1, day)
        low = F.lit(before or datetime(2000, 1, 1))
        period = held.where((F.col("ts") >= low) & (F.col("ts") < F.lit(end)))
        store.advance(period, end, before)
        if k == 2:
            store.advance(period, end, before)  # a rerun changes nothing
        before = end
        so_far = held.where(F.col("ts") < F.lit(end))
        recent = mining.within(baseline.metric_points(so_far).withColumn("day", F.to_date("ts")), end, days)
        order = ["array_id", "observer", "metric"]
        near = lambda df: sorted((r.array_id, r.observer, r.metric, r.n, round(r["median"], 6), round(r.deviation or 0, 6)) for r in df.collect())
        assert near(store.baselines(end, days)) == near(baseline.learn(recent, order, "metric_value"))
        whole = mining.within(mining.episode_counts(so_far, gap), end, days)
        split = episodes.split(so_far, gap)
        last = split.groupBy("array_id", "episode").agg(F.to_date(F.max("ts")).alias("day"))
        anew = episodes.scored(episodes.firsts(split.join(mining.within(last, end, days), ["array_id", "episode"])))
        got = sorted(map(tuple, store.rules(end, days).collect()))
        assert got == sorted(map(tuple, anew.collect())) == sorted(map(tuple, mining.rules(whole).collect()))
    assert got


def test_medians_of_large_groups(spark):
    rng = random.Random(4)
    groups = {
        "one": [1.5] * 400, "two": [-1.0, 3.0] * 300, "wide": [rng.choice((-1, 1)) * 10 ** rng.uniform(-300, 307.9) for _ in range(1001)],
        "even": [rng.random() for _ in range(1000)], "ties": [float(rng.randrange(5)) for _ in range(999)], "small": [1.0, 2.0, 4.0], "pair": [0.0, 5e-324] * 200,
    }
    rows = spark.createDataFrame([(k, v) for k, vs in groups.items() for v in vs] + [("small", None), (None, 7.0)], "k string, v double")
    want = {k: statistics.median(vs) for k, vs in groups.items()} | {None: 7.0}
    for bins in (64, 4096):
        got = {r.k: r["median"] for r in ranks.medians(rows, ["k"], "v", small=100, bins=bins).collect()}
        assert {k: v for k, v in got.items() if k is not None} == {k: v for k, v in want.items() if k is not None}
    counted = rows.where("k is not null and v is not null").groupBy("k", "v").agg(F.count("*").alias("n"))
    assert {r.k: r["median"] for r in ranks.medians(counted, ["k"], "v", "n", small=100).collect()} == {k: v for k, v in want.items() if k}


def test_windows_by_brute_force(spark):
    rng = random.Random(9)
    base = datetime(2024, 1, 1)
    at = lambda hours: base + timedelta(hours=hours)
    alerts = [(k, rng.randrange(4), at(rng.choice([rng.uniform(0, 5000), rng.randrange(5000)]))) for k in range(300)] + [(999, 1, None)]
    spans = [rng.choice([0, 1, 7.5, 8, 64, 100, 512, 3000, 100_000]) for _ in range(120)]
    windows = [(k, rng.choice([[], [1], [1, 1, 2], [9]]), at(rng.choice([rng.uniform(-600, 5000), rng.randrange(5000)])), s) for k, s in enumerate(spans)]
    windows = [(k, a, s, None if rng.random() < 0.1 else s + timedelta(hours=h)) for k, a, s, h in windows]
    want = sorted((i, k) for i, array, ts in alerts for k, a, s, e in windows if ts and ts >= s and (e is None or ts <= e) and (not a or array in a))
    frame = spark.createDataFrame(alerts, "id long, array_id long, ts timestamp_ntz")
    held = spark.createDataFrame(windows, "task_id long, array_ids array<bigint>, started_at timestamp_ntz, ended_at timestamp_ntz")
    got = tasks.within(frame, held)
    assert sorted((r.id, r.task_id) for r in got.collect()) == want and len(want) > 500
    assert got.columns == [*frame.columns, *held.columns]
