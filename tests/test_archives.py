"""The merged archive: reruns, and runs that die between the steps."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from watchgrid import catalog
from watchgrid.operators.archives import Archive, move_to_archive


def alerts(spark, ids, said="a"):
    rows = spark.createDataFrame([(i, i % 3 or None, f"{said}{i}") for i in ids], "id long, array_id long, message string")
    return rows.withColumn("ts", F.timestamp_add("DAY", F.col("id").cast("int"), F.lit("2024-01-01").cast("timestamp_ntz")))


def held(archive):
    return sorted((r.id, r.message) for r in archive.read().collect())


def test_merge_rerun_and_crash(spark, tmp_path, monkeypatch):
    archive = Archive(spark, str(tmp_path / "archive"))
    assert archive.read() is None
    archive.merge(alerts(spark, range(60)))
    first = [(i, f"a{i}") for i in range(60)]
    assert held(archive) == first
    archive.merge(alerts(spark, range(60)))
    assert held(archive) == first
    # dies after the files are written, before they are published
    with monkeypatch.context() as m:
        m.setattr(Archive, "publish", lambda *a: (_ for _ in ()).throw(RuntimeError("dead")))
        with pytest.raises(RuntimeError, match="dead"):
            archive.merge(alerts(spark, range(50, 90), "b"))
    assert held(archive) == first
    archive.merge(alerts(spark, range(50, 90), "b"))
    both = first[:50] + [(i, f"b{i}") for i in range(50, 90)]
    assert held(archive) == both
    # January has not been touched by the last merge: its months still are those of the version before
    versions = {(r.year_month): r.version for r in archive.manifest().collect()}
    assert versions["2024-01"] != versions["2024-03"]
    assert archive.clean() >= 2 and held(archive) == both
    assert sorted(r.id for r in archive.read([1], ["2024-02"]).collect()) == [i for i in range(31, 60) if i % 3 == 1]


def test_two_writers_and_the_hot_table(spark, tmp_path):
    archive = Archive(spark, str(tmp_path / "archive"))
    hot, at = alerts(spark, range(100)), lambda k: F.timestamp_add("DAY", F.lit(k), F.lit("2024-01-01").cast("timestamp_ntz"))
    for _ in range(2):
        move_to_archive(hot, archive, str(tmp_path / "kept"), at(70), at(20))
        assert [i for i, _ in held(archive)] == list(range(20, 70))
        assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "kept")).collect()) == [*range(20), *range(70, 100)]
    number, version = archive.newest()
    with pytest.raises(RuntimeError, match="published"):
        archive.publish("other", number - 1)
    assert archive.newest() == (number, version) and [i for i, _ in held(archive)] == list(range(20, 70))
    # a writer that died as it published left an empty file: it says nothing and its number is not used again
    (tmp_path / "archive" / "published" / f"{number:012d}").touch()
    assert archive.newest() == (number + 1, version)


def test_the_query_counts_each_alert(spark):
    """Alerts of every other array, and those before and after the days archived, were left out."""
    folder = "/root/testdata/sf0.001"
    want = spark.read.parquet(f"{folder}/events.parquet").groupBy("user_id").count().collect()
    rows = catalog.QUERIES["archive_merge"](spark, folder).groupBy("array_id").agg(F.sum("n").alias("n")).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, want)) and any(r.array_id % 2 for r in rows)
