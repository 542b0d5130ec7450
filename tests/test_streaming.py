"""The streaming forms over files, run until the input is used up."""

from __future__ import annotations

from pyspark.sql import functions as F

from watchgrid.streaming import jobs


def stream(spark, tmp_path, rows, schema):
    path = f"file://{tmp_path}/in"
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)


def run(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name).collect()


def times(df):
    return df.withColumn("ts", F.timestamp_seconds("s"))


def test_tumbling_and_sessions(spark, tmp_path):
    rows = [(1, "info", 0), (1, "info", 60), (1, "error", 121), (2, "info", 10)]
    df = times(stream(spark, tmp_path, rows, "array_id long, level string, s long"))
    got = run(jobs.tumbling(df), "tumbling", "complete")
    assert sorted((r.level, r.n) for r in got) == [("error", 1), ("info", 3)]
    got = run(jobs.sessions(df), "sessions", "complete")
    assert sorted((r.array_id, r.n) for r in got) == [(1, 1), (1, 2), (2, 1)]


def test_dedup(spark, tmp_path):
    df = times(stream(spark, tmp_path, [(1, "a", "m", 0), (1, "a", "m", 5), (1, "b", "m", 5)], "array_id long, observer string, message string, s long"))
    assert len(run(jobs.deduplicated(df), "dedup")) == 2


def test_storms_and_deltas(spark, tmp_path):
    df = times(stream(spark, tmp_path / "a", [(1, s) for s in range(25)] + [(2, 100 * s) for s in range(25)], "array_id long, s long"))
    assert [(r.array_id, r.size) for r in run(jobs.storms(df), "storms")] == [(1, 20)]
    df = times(stream(spark, tmp_path / "b", [("p", s, float(v)) for s, v in enumerate([1, 3, 3, 90_000_000, 90_000_001], 1)], "key string, s long, value double"))  # a row at the epoch would be late
    assert [r.delta for r in run(jobs.counter_deltas(df), "deltas")] == [2.0, 1.0]


def test_a_late_row_makes_no_storm(spark, tmp_path):
    schema = "array_id long, s long"
    df = times(stream(spark, tmp_path, [(1, 7200 + s) for s in range(19)] + [(2, s * 3) for s in range(18)], schema))
    q = jobs.storms(df).writeStream.format("memory").queryName("late").option("checkpointLocation", f"file://{tmp_path}/cp").trigger(availableNow=True)
    q.start().awaitTermination()
    assert spark.table("late").count() == 0
    spark.createDataFrame([(1, 5000), (2, 52), (2, 1), (2, 2)], schema).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    run_again = jobs.storms(df).writeStream.format("parquet").option("path", f"file://{tmp_path}/out").option("checkpointLocation", f"file://{tmp_path}/cp2").option("maxFilesPerTrigger", 1).trigger(availableNow=True)
    run_again.start().awaitTermination()
    assert [(r.array_id, r.size) for r in spark.read.parquet(f"file://{tmp_path}/out").collect()] == [(2, 20)]


def test_merging(spark):
    seen = []
    each = jobs.merging(lambda df: seen.extend(map(tuple, df.collect())), ["k"])
    each(spark.createDataFrame([(1, 5, "a"), (1, 9, "b"), (2, 1, "c")], "k int, ts int, v string"), 0)
    assert sorted(seen) == [(1, 9, "b"), (2, 1, "c")]
