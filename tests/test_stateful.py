"""Stateful processors against the batch forms: late rows, restarts, and state that goes."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from watchgrid.operators import detectors, issues
from watchgrid.schema import observed
from watchgrid.streaming import stateful as S

SF = "/root/testdata/sf0.001"


class Feed:
    """A stream over Parquet files that are added one batch at a time; each step is a new query on one checkpoint."""

    def __init__(self, spark, top, schema):
        self.spark, self.top, self.schema, self.n = spark, str(top), schema, 0

    def step(self, rows, make, mode):
        self.n += 1
        rows.coalesce(1).write.mode("append").parquet(f"{self.top}/in")
        out = f"{self.top}/out"

        def write(batch, k):
            batch.withColumn("batch", F.lit(self.n * 1000 + k)).write.mode("append").parquet(out)

        stream = self.spark.readStream.schema(self.schema).parquet(f"{self.top}/in")
        query = make(stream).writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{self.top}/at").trigger(availableNow=True).start()
        query.awaitTermination()
        self.progress = query.lastProgress
        return self.spark.read.parquet(out)


def stamped(rows):
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def test_followed_issues(spark, tmp_path):
    """After each batch the stream's issues and recoveries are those of all alerts so far; late ones and a new query each time."""
    held = observed(spark, SF).where("array_id < 12").select("array_id", "id", "observer", "level", "message", "details", "ts")
    rows = stamped(held).orderBy("ts", "id").collect()
    rng = random.Random(2)
    # rows come up to two days late, less than the watermark allows
    order = sorted(rows, key=lambda r: r.ts.timestamp() + rng.random() * 2 * 86_400)
    schema = stamped(held).schema
    feed = Feed(spark, tmp_path, schema)
    size = -(-len(order) // 4)
    for k in range(4):
        out = feed.step(spark.createDataFrame(order[k * size : (k + 1) * size], schema), lambda s: S.followed(s, "3 days", 24 * 400), "update")
        so_far = spark.createDataFrame(order[: (k + 1) * size], schema).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
        columns = ["array_id", "observer", "key", "level", "message", "since", "latest"]
        got = sorted(map(tuple, S.current(out).select(columns).collect()))
        assert got == sorted(map(tuple, issues.followed(so_far).select(columns).collect())), k
        gone = sorted(map(tuple, S.current(out, "recoveries").collect()))
        assert gone == sorted(map(tuple, issues.recoveries(so_far).select("array_id", "observer", "key", "recovered_at").collect())), k
    assert got and gone


FAMILIES = {
    "delta": ("value", S.delta(5, 60), lambda r: detectors.delta(r, ["key"], "value", 5, 60).select("id", "delta")),
    "change": ("state", S.change(bad=("b",)), lambda r: detectors.change(r, ["key"], "state", bad=("b",)).select("id", "previous")),
    "down": ("state", S.change(down=("c", "d")), lambda r: detectors.change(r, ["key"], "state", down=("c", "d")).select("id", "previous")),
    "level": ("value", S.level(60, 2), lambda r: detectors.hysteresis(r, ["key"], "value", 60, 2).select("id", "event")),
    "matched": ("flag", S.matched(2), lambda r: detectors.rolling_all(r, ["key"], F.col("flag"), 2).select("id")),
    "cooled": ("value", S.cooled(600), lambda r: detectors.cooled(r, ["key"], 600).select("id")),
}


@pytest.mark.parametrize("name", FAMILIES)
def test_families(spark, tmp_path, name):
    """The stream's alerts are the batch's, whatever the order of rows within the watermark."""
    rng = random.Random(name)
    value, family, batch = FAMILIES[name]
    rows = [(f"k{rng.randrange(4)}", k, 60 * k + rng.randrange(40), float(rng.randrange(100)), rng.choice("aAbcd"), rng.random() < 0.6) for k in range(240)]
    order = sorted(rows, key=lambda r: r[2] + rng.random() * 3000)
    frame = lambda some: spark.createDataFrame(some, "key string, id long, s long, value double, state string, flag boolean").withColumn("ts", F.timestamp_seconds("s")).drop("s")
    feed = Feed(spark, tmp_path, frame(rows[:1]).schema)
    for part in (order[:110], order[110:], [("end", 9999, 10**6, 0.0, "a", False)], [("end", 10000, 10**6 + 9000, 0.0, "a", False)]):
        out = feed.step(frame(part), lambda s: S.detected(s, ["key"], value, family, "1 hour", 10_000), "append")
    want = batch(frame(rows).withColumn("ts", F.col("ts").cast("timestamp_ntz")))
    columns = want.columns
    assert sorted(map(tuple, out.where("key <> 'end'").select(columns).collect())) == sorted(map(tuple, want.collect()))
    assert want.count() > 5


def test_silent_keys_are_forgotten(spark, tmp_path):
    frame = lambda some: spark.createDataFrame(some, "key string, id long, s long, value double").withColumn("ts", F.timestamp_seconds("s")).drop("s")
    feed, sizes = Feed(spark, tmp_path, frame([("a", 1, 1, 1.0)]).schema), []
    for k in range(5):
        start = k * 400_000
        rows = [(f"k{k}-{j}", j, start + j, 1.0) for j in range(20)] + [(f"k{k}-0", 99, start + 30, 9.0)]
        feed.step(frame(rows), lambda s: S.detected(s, ["key"], "value", S.delta(), "1 minute", 24), "append")
        sizes.append(feed.progress["stateOperators"][0]["numRowsTotal"])
    assert max(sizes[2:]) <= max(sizes[:2]) and max(sizes) < 20 * 8
