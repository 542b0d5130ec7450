"""The tail source and the outbox sink: rotation, truncation, restarts and replays."""

from __future__ import annotations

import json
import os

import pytest
from pyspark.sql import functions as F

from watchgrid.sources import outbox, tail


def take(spark, source, top, n, **options):
    """Run the tail until nothing is new, from the checkpoint on; the lines of run n."""
    out = f"{top}/out-{n}"
    write = lambda batch, _: batch.write.mode("append").parquet(out)
    query = tail.tail(spark, source, **options).writeStream.foreachBatch(write).option("checkpointLocation", f"{top}/at").trigger(processingTime="0 seconds").start()
    query.processAllAvailable()
    query.stop()
    if not os.path.exists(out):
        return []
    return [r.line for r in spark.read.schema("file string, place long, line string").parquet(out).orderBy("file", "place").collect()]


def test_append_rotate_truncate_restart(spark, tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()
    a, b = logs / "a.log", logs / "b.log"
    run = lambda n: take(spark, f"{logs}/*.log", tmp_path / "q", n)
    a.write_text("a1\na2\nhalf")
    b.write_bytes("é1\r\n\n".encode() + b"\xff2\n")
    (logs / "other.txt").write_text("no\n")
    assert run(0) == ["a1", "a2", "é1", "", "2"]
    with a.open("a") as f:
        f.write(" line\na4\n")
    assert run(1) == ["half line", "a4"]
    assert run(2) == []
    a.rename(logs / "a.old")
    a.write_text("fresh 1\nfresh 2\nfresh 3\nfresh 4 is longer than what was there\n")
    assert run(3) == ["fresh 1", "fresh 2", "fresh 3", "fresh 4 is longer than what was there"]
    a.write_text("fresh 1\n")  # cut short: the same beginning, but less of it
    assert run(4) == ["fresh 1"]
    a.unlink()
    assert run(5) == []
    a.write_text("again\n")
    with b.open("a") as f:
        f.write("b4\n")
    assert run(6) == ["again", "b4"]


@pytest.mark.parametrize("part", [1, 7, 64, 1 << 20])
def test_byte_ranges_give_each_line_once(spark, tmp_path, part):
    lines = [f"line {k} " + "x" * (k * 37 % 90) for k in range(300)]
    (tmp_path / "f").write_text("\n".join(lines) + "\n")
    reader = tail.TailReader({"path": f"{tmp_path}/f", "partitionbytes": str(part)})
    end = reader.latestOffset()
    got = [x for p in reader.partitions({}, end) for b in reader.read(p) for x in b.column("line").to_pylist()]
    assert got == lines


def test_skip_existing_and_bounded_batches(spark, tmp_path):
    f = tmp_path / "f"
    f.write_text("old\n" * 10)
    reader = tail.TailReader({"path": str(f), "skipexisting": "true", "filebytes": "20"})
    at, got = reader.initialOffset(), []
    with f.open("a") as out:
        out.write("".join(f"new {k}\n" for k in range(20)) + "one line that is longer than a batch may be\n")
    for _ in range(30):
        end = reader.latestOffset()
        got.append([x for p in reader.partitions(at, end) for b in reader.read(p) for x in b.column("line").to_pylist()])
        at = end
    assert sum(got, []) == [f"new {k}" for k in range(20)] + ["one line that is longer than a batch may be"]
    assert max(map(len, got)) <= 4


def test_lines_of_a_batch_whose_file_was_rotated_are_not_taken_from_the_new_one(tmp_path):
    f = tmp_path / "f"
    f.write_text("old 1\nold 2\n")
    reader = tail.TailReader({"path": str(f)})
    start, end = reader.initialOffset(), reader.latestOffset()
    f.write_text("new 1\nnew 2\nnew 3\n")
    assert reader.partitions(start, end) == []
    later = reader.latestOffset()
    assert [x for p in reader.partitions(end, later) for b in reader.read(p) for x in b.column("line").to_pylist()] == ["new 1", "new 2", "new 3"]


def test_outbox_delivers_once(spark, tmp_path):
    path, at = f"{tmp_path}/box", f"{tmp_path}/at"
    stream = lambda: spark.readStream.schema("id long, said string").parquet(f"{tmp_path}/in")
    for k in range(3):
        spark.range(k * 1000, k * 1000 + 130).select("id", F.concat(F.lit('say "é" '), "id").alias("said")).repartition(2).write.mode("append").parquet(f"{tmp_path}/in")
        outbox.deliver(stream(), path, at, every=None).awaitTermination()
    ids = lambda: sorted(r["id"] for m in outbox.delivered(spark, path).collect() for r in (json.loads(m.message).get("messages") or [json.loads(m.message)]))
    want = sorted(k * 1000 + i for k in range(3) for i in range(130))
    assert ids() == want
    got = outbox.delivered(spark, path).collect()
    assert max(r.n for r in got) == 50 and sum(r.n for r in got) == 390
    # the last batch was delivered but the query died before Spark noted it: it runs again and gives nothing twice
    commits = sorted((int(f) for f in os.listdir(f"{at}/commits") if f.isdigit()))
    os.remove(f"{at}/commits/{commits[-1]}")
    crc = f"{at}/commits/.{commits[-1]}.crc"
    if os.path.exists(crc):
        os.remove(crc)
    before = set(os.listdir(f"{path}/staged"))
    outbox.deliver(stream(), path, at, every=None).awaitTermination()
    assert ids() == want and set(os.listdir(f"{path}/staged")) == before
    # a batch that fails before its entry is made leaves no file
    writer = outbox.OutboxWriter({"path": path})
    import pyarrow as pa

    staged = writer.write(iter([pa.RecordBatch.from_pylist([{"id": 1, "said": "x"}])]))
    writer.abort([staged, None], 99)
    assert ids() == want and set(os.listdir(f"{path}/staged")) == before


def test_outbox_by_trigger(spark, tmp_path):
    rate = spark.readStream.format("rate").option("rowsPerSecond", 200).load()
    query = outbox.deliver(rate, f"{tmp_path}/box", f"{tmp_path}/at", most=7)
    for _ in range(60):
        query.awaitTermination(0.5)
        if query.lastProgress and query.lastProgress["batchId"] >= 3:
            break
    query.stop()
    got = outbox.delivered(spark, f"{tmp_path}/box").collect()
    values = sorted(r["value"] for m in got for r in (json.loads(m.message).get("messages") or [json.loads(m.message)]))
    assert values and values == list(range(len(values))) and max(m.n for m in got) <= 7
