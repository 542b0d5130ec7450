"""Small reads: locks, presence, traffic modes, targets, file listings, metric cutoffs, logs and settings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from watchgrid.operators.store import page


def lock_check(requested: DataFrame, windows: DataFrame, at: Column) -> DataFrame:
    """Each requested array with the first test window that holds it at a moment; it is available without one.

    A window without arrays holds all of them: the first such window is one number, which goes with every request.
    """
    held = windows.where((F.col("started_at") <= at) & (F.col("ended_at").isNull() | (F.col("ended_at") > at)))
    first = F.min("task_id").alias("task_id")
    named = held.select("task_id", F.explode("array_ids").alias("array_id")).groupBy("array_id").agg(first)
    every = held.where(F.coalesce(F.size("array_ids") <= 0, F.lit(True))).agg(F.min("task_id").alias("_all"))
    found = requested.select("array_id").distinct().join(named, "array_id", "left").join(F.broadcast(every))
    return found.select("array_id", F.least("task_id", "_all").alias("task_id")).withColumn("available", F.col("task_id").isNull())


def on_page(visits: DataFrame, name: str, at: Column, age: str) -> DataFrame:
    """Users whose last visit is to a page and younger than age; equal times go by id."""
    last = visits.groupBy("user").agg(F.max(F.struct("ts", "id", "page")).alias("last"))
    return last.where((F.col("last.page") == name) & (F.col("last.ts") > at - F.expr(f"interval {age}"))).select("user", F.col("last.ts").alias("ts"))


def mode_info(points: DataFrame, since: Column, first: int = 10) -> DataFrame:
    """Per array the modes and protocols of the newest points of its first ports by name, and how many ports have one."""
    # ports in order are few an array: ranked after they are combined to one row each
    newest = F.max(F.when(F.col("ts") >= since, F.struct("ts", "id", "mode", "protocol"))).alias("now")
    ports = points.groupBy("array_id", "port").agg(newest).withColumn("place", F.row_number().over(W.partitionBy("array_id").orderBy("port")))
    held = ports.where((F.col("place") <= first) & F.col("now").isNotNull())
    said = lambda c: F.array_join(F.sort_array(F.collect_set(F.coalesce(F.col(f"now.{c}"), F.lit("unknown")))), ",").alias(f"{c}s")
    return held.groupBy("array_id").agg(F.count("*").alias("ports"), said("mode"), said("protocol"))


def targets(arrays: DataFrame, tag_ids: Sequence[int] = (), array_ids: Sequence[int] = ()) -> DataFrame:
    """The arrays that a deployment reaches by tag or by themselves, each once."""
    return arrays.where(F.col("tag_id").isin(*tag_ids) | F.col("array_id").isin(*array_ids)).select("array_id").distinct()


def human_size(size: Column) -> Column:
    """Bytes in B, KB or MB with one decimal, halves to the even digit."""
    tenth = lambda unit: F.format_string("%.1f", F.bround(size / unit, 1))
    return F.when(size < 1024, F.concat(size.cast("string"), F.lit(" B"))).when(size < 1 << 20, F.concat(tenth(1 << 10), F.lit(" KB"))).otherwise(F.concat(tenth(1 << 20), F.lit(" MB")))


def listed_files(lines: DataFrame, line: str = "value") -> DataFrame:
    """name, size, size_human and modified of each file in the long listing of a folder; other lines are left out."""
    parts = F.split(F.trim(line), r"\s+")
    held = lines.where(~F.lower(line).contains("total")).select(parts.alias("p")).where(F.size("p") >= 9)
    size = F.when(F.col("p")[4].rlike("^[0-9]+$"), F.col("p")[4].try_cast("long")).otherwise(0)
    name = F.substring_index(F.element_at("p", -1), "/", -1)
    return held.select(name.alias("name"), size.alias("size"), F.concat_ws(" ", F.slice("p", 6, 3)).alias("modified")).withColumn("size_human", human_size(F.col("size")))


def since_cutoff(records: DataFrame, cutoff: Column, ts: str = "ts") -> DataFrame:
    """The records from a moment on; those whose time can't be read stay."""
    return records.where(F.coalesce(F.try_to_timestamp(ts).cast("timestamp_ntz") >= cutoff, F.lit(True)))


def system_log(rows: DataFrame, level: str | None = None, module: str | None = None, limit: int = 100) -> DataFrame:
    """The newest entries of a level whose module holds a text in any case."""
    held = rows if level is None else rows.where(F.col("level") == level)
    return page(held if module is None else held.where(F.lower("module").contains(module.lower())), limit)


def settings(rows: DataFrame, params: str = "params") -> DataFrame:
    """rows with their params decoded to a map; what isn't a JSON object is empty."""
    return rows.withColumn(params, F.coalesce(F.from_json(params, "map<string,string>"), F.create_map().cast("map<string,string>")))


def ack_detail(acks: DataFrame, alerts: DataFrame, names: DataFrame) -> DataFrame:
    """Acknowledgements with their alert and the nickname of the array's owner, if there is one; a blank one is the ip."""
    shown = names.withColumn("nickname", F.coalesce(F.nullif(F.trim("nickname"), F.lit("")), "ip"))
    return acks.join(alerts.withColumnRenamed("id", "alert_id"), "alert_id").join(shown, "array_id", "left")


def evidence(probes: DataFrame) -> DataFrame:
    """Whether an agent runs, by the best evidence: its service, its pid file, or a process found by search.

    probes has service_active, main_pid, main_alive, main_matches; file_pid, file_alive, file_matches; found_pid and
    found_matches. A null counts as no.
    """
    yes = lambda *names: F.coalesce(F.expr(" and ".join(names)), F.lit(False))
    service = yes("service_active", "main_pid > 0", "main_alive", "main_matches")
    file = yes("file_pid is not null", "file_alive", "file_matches")
    found = yes("found_pid is not null", "found_matches")
    source = F.when(service, "systemd").when(file, "pidfile").when(found, "pgrep").otherwise("none")
    pid = F.when(service, F.col("main_pid")).when(file, F.col("file_pid")).when(found, F.col("found_pid"))
    trust = F.when(service | file, "high").when(found, "medium").otherwise("low")
    stale = F.col("file_pid").isNotNull() & ~yes("file_alive")
    return probes.withColumns({"running": service | file | found, "source": source, "confidence": trust, "pid": pid, "stale": stale})


def interpreted(alerts: DataFrame, cache: DataFrame) -> DataFrame:
    """alerts with their cached interpretation, and whether there is one."""
    return alerts.join(cache, "id", "left").withColumn("cached", F.col("interpretation").isNotNull())


def issue_list(issues: DataFrame, status: str | None = None) -> DataFrame:
    """Issues newest first, of one status if it is given."""
    return (issues if status is None else issues.where(F.col("status") == status)).orderBy(F.desc("created_at"), F.desc("id"))
