"""What makes a query's work grow faster than its input: seen in plans and in results by brute force."""

from __future__ import annotations

import random
import re
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from watchgrid import catalog
from watchgrid.operators import aggregate, archives, baseline, cards, logs, mining, tasks
from watchgrid.schema import log_lines, observed

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_condition_makes_no_text_anew(spark):
    """Conditions on what is made of k once parsed the JSON of a row some dozens of times."""
    held = observed(spark, SF)
    caused = aggregate.caused(held)
    assert plan(caused).count("get_json_object(props") == 1 and len([n for n in plan(caused).splitlines() if "$.changes[0].port" in n]) == 1
    lines = log_lines(spark, SF).where(F.col("line").rlike("sig") & F.col("line").contains("k"))
    assert plan(lines).count("get_json_object(props") == 1
    assert plan(held.where("observer = 'card_info' and message like '%1%' and details like '%2%'")).count("get_json_object(props") == 1


def test_values_are_looked_for_once_a_line(spark):
    """The list of values was made once more in the condition that it isn't empty."""
    texts = ["PASSWORD=Abcdef9", "pwd: Qwerty12 token=abc123x", "1.2.3.4; Admin, x", "password=***", "nothing", None, "API_KEY=zzzz9999 nqn.2014-08.org:x", "enter password: secret=abc12345"]
    found = logs.sensitive(spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "id int, line string"))
    assert plan(found).count("passwd\\s*[=:]\\s*['") == 1
    assert sorted((r.id, r.pattern) for r in found.collect()) == [(0, 0), (1, 2), (1, 4), (2, 8), (6, 5), (6, 6)]


def test_a_period_reads_its_alerts_once_for_each_kind(spark, monkeypatch, tmp_path):
    """Episodes were split once for those still open, and twice more for those that are not."""
    assert plan(baseline.metric_points(observed(spark, SF))).count("current_rss_mb, ") <= 1
    runs, split = [], mining.episodes.split
    monkeypatch.setattr(mining.episodes, "split", lambda *a, **k: runs.append(1) or split(*a, **k))
    mining.Store(spark, str(tmp_path / "store")).advance(observed(spark, SF).where("array_id < 3"), datetime(2024, 3, 1))
    assert len(runs) == 1


def test_sums_of_windows_are_those_of_the_join(spark):
    rng, base = random.Random(3), datetime(2024, 1, 1)
    at = lambda h: None if h is None else base + timedelta(hours=h)
    alerts = [(rng.choice([0, 1, 2, None]), at(rng.choice([rng.uniform(-50, 900), rng.randrange(900)])), rng.randrange(1, 5)) for _ in range(300)] + [(1, None, 7)]
    spans = [(rng.choice([rng.uniform(-600, 1000), rng.randrange(900)]), rng.choice([-2, 0, 1, 7.5, 64, 512, 3000, None])) for _ in range(150)]
    windows = [(k, rng.choice([[], [1], [1, 1, 2], [0, None], [9]]), at(s), at(None if h is None else s + h)) for k, (s, h) in enumerate(spans)]
    frame = spark.createDataFrame(alerts, "array_id long, ts timestamp_ntz, c long")
    held = spark.createDataFrame(windows, "task_id long, array_ids array<bigint>, started_at timestamp_ntz, ended_at timestamp_ntz")
    want = tasks.within(frame, held).groupBy("task_id").agg(F.sum("c").alias("n"))
    for size in (tasks.CELLS[0], tasks.CELLS[3]):
        got = tasks.summed(frame, held, "c", size)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() > 50


def test_an_archive_has_no_folder_for_each_array(spark, tmp_path):
    rows = spark.range(600).select("id", (F.col("id") % 300).alias("array_id"), F.lit("m").alias("message"), F.lit("2024-01-05").cast("timestamp_ntz").alias("ts"))
    held = archives.Archive(spark, str(tmp_path / "archive"))
    held.merge(rows)
    assert 0 < len(list((tmp_path / "archive" / "versions").rglob("year_month=*"))) <= archives.BUCKETS
    held.merge(rows.where("array_id = 7").withColumn("message", F.lit("n")))
    assert held.read().count() == 600 and {(r.id, r.message) for r in held.read([7]).collect()} == {(7, "n"), (307, "n")}


def test_a_listing_is_taken_apart_in_its_row(spark):
    """Lines were sorted and grouped over all listings, which took a task memory in proportion to its share of them."""
    for name in ("card_assertions", "card_records"):
        held = plan(catalog.QUERIES[name](spark, SF))
        assert not [w for w in ("Window", "Join", "Aggregate", "Sort ") if w in held] and held.count("split(concat(") == 1


def test_blocks_of_a_listing_line_by_line(spark):
    rng = random.Random(9)
    lines = ["No001", "no001", " No002 Model: x", "No003BoardId", "No0 x", "No01: k", "No001: BoardId: b7", "-----", "---", "--", "----x", "", "  ", "Model: undefined", "model = N/A", "Model = ", "Model: a Model: b", "Model:\x0by", "BoardId=", "CardNo: c1", "CardNo", ": lone", "a: 1", "a: 2", "b:c:d", "No12  k: w", "--- ", "No003\rx"]
    texts = ["".join(rng.choice(lines) + rng.choice(["\n", "\r\n"]) for _ in range(rng.choice([0, 1, 3, 8, 40]))) for _ in range(400)]

    def told(text):
        out, card = [], None
        for pos, line in enumerate(re.split("\r?\n", text)):
            line, start = line.strip(" "), re.match(r"(?i)(No0\d+)\b", line.strip(" "))
            if re.fullmatch("-{3,}", line):
                card = None
            elif start and start[1] != card:
                card = start[1]
                out.append([pos, card, "", "", "", "", {}])
            if card is None or not line:
                continue
            for at, name in zip((2, 1, 3, 4, 5), ("BoardId", "CardNo", "RunningState", "HealthState", "Model")):
                if found := re.search(rf"(?i)\b{name}\b\s*[=:\s]+\s*(\S+)", line):
                    out[-1][at] = found[1]
            name, colon, value = line.partition(":")
            if colon:
                out[-1][6][re.sub(r"(?i)^No\d+\s+", "", name.strip(" ")).strip(" ")] = value.strip(" ")
        return [(*r[:5], "" if r[5].lower() in cards.NO_MODEL else r[5], r[6]) for r in out]

    got = cards.records(spark.createDataFrame(list(enumerate(texts)), "k int, text string"), ["k"]).collect()
    want = [(k, *r) for k, text in enumerate(texts) for r in told(text)]
    assert len(want) > 500 and sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
