"""Sources and sinks: alert logs, traffic, pushed events, dimension files, metrics, exports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from watchgrid.schema import LEVELS

ALERT = "timestamp string, observer_name string, level string, message string, details string"


def parsed_alerts(lines: DataFrame, line: str = "value", keep: Sequence[str] = ()) -> DataFrame:
    """Rows of a JSONL alert log with ok = false for lines that are no record, and the columns to keep.

    Levels go to lower case, an unknown one to info; a Z behind a time is dropped.
    """
    j = F.from_json(F.col(line), ALERT)
    level = F.lower(j["level"])
    stamp = F.regexp_replace(j["timestamp"], "Z$", "").try_cast("timestamp_ntz")
    return lines.select(
        *keep, (stamp.isNotNull() & j["observer_name"].isNotNull()).alias("ok"), stamp.alias("ts"), j["observer_name"].alias("observer"),
        F.when(level.isin(*LEVELS), level).otherwise("info").alias("level"), j["message"].alias("message"), j["details"].alias("details"),
    )


def read_alert_log(spark: SparkSession, path: str, since_days: int | None = None) -> DataFrame:
    """Alert logs below path, packed ones too; since_days reads only files changed since then."""
    reader = spark.read
    if since_days is not None:
        reader = reader.option("modifiedAfter", spark.sql(f"select date_format(current_timestamp() - interval {int(since_days)} days, \"yyyy-MM-dd'T'HH:mm:ss\")").first()[0])
    return parsed_alerts(reader.text(path)).where("ok").drop("ok")


IMPORTS = ("full", "incremental", "selective")


def imported_alerts(lines: DataFrame, held: DataFrame, mode: str, at: Column, days: int = 7, files: Sequence[str] = (), file: str = "file", line: str = "value") -> DataFrame:
    """Alerts of log lines that an import takes in, with their file: of equal ones the one of the first file, and none
    that held (ts, observer, message) has already.

    full takes all lines, incremental those not older than so many days before at, selective those of the files named.
    """
    if mode not in IMPORTS:
        raise ValueError(f"unknown mode: {mode}")
    some = lines.where(F.col(file).isin(*files)) if mode == "selective" else lines
    rows = parsed_alerts(some, line, (file,)).where("ok").drop("ok")
    rows = rows.where(F.col("ts") >= at - F.expr(f"interval {int(days)} days")) if mode == "incremental" else rows
    key = F.md5(F.concat_ws("|", F.col("ts").cast("string"), "observer", F.coalesce("message", F.lit(""))))
    others = [c for c in rows.columns if c != file]
    first = rows.withColumn("_key", key).groupBy("_key").agg(F.min_by(F.struct(file, *others), file).alias("r"))
    return first.join(held.select(key.alias("_key")).distinct(), "_key", "left_anti").select("r.*")


def parsed_traffic(lines: DataFrame, line: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    """Traffic records with their defaults, and the columns to keep; records without a time go."""
    j = F.from_json(F.col(line), "timestamp string, port string, tx_bytes bigint, rx_bytes bigint, tx_rate double, rx_rate double, mode string, protocol string")
    default = lambda c, v: F.coalesce(j[c], F.lit(v)).alias(c)
    return lines.select(*keep, F.regexp_replace(j["timestamp"], "Z$", "").try_cast("timestamp_ntz").alias("ts"), default("port", "unknown"), default("tx_bytes", 0), default("rx_bytes", 0), default("tx_rate", 0.0), default("rx_rate", 0.0), default("mode", "auto"), default("protocol", "ethernet")).where("ts is not null")


def pushed(lines: DataFrame, line: str = "value") -> DataFrame:
    """Pushed events with their class: alert, metrics or error."""
    kind = F.get_json_object(line, "$.type")
    return lines.withColumn("class", F.when(kind.isin("alert", "metrics"), kind).otherwise("error"))


def outcomes(lines: DataFrame, line: str = "value") -> DataFrame:
    return pushed(lines, line).agg(*[F.count_if(F.col("class") == c).alias(c) for c in ("alert", "metrics", "error")])


def attributed(events: DataFrame, hosts: DataFrame) -> DataFrame:
    """Events with their array: the id given unless it starts with push_, else that of the host; others go."""
    known = hosts.select(F.col("host").alias("source_ip"), F.col("array_id").alias("by_host"))
    given = F.when(~F.col("array_id").startswith("push_"), F.col("array_id"))
    return events.join(known, "source_ip", "left").withColumn("array_id", F.coalesce(given, "by_host")).where("array_id is not null").drop("by_host")


#: Headers that a dimension file may use for a field.
SYNONYMS = {"name": ("name", "array_name"), "host": ("host", "ip", "address"), "port": ("port", "ssh_port"), "username": ("username", "user")}


def dimension(rows: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows of a dimension file by field, whatever synonym its header uses; reason tells why a row is rejected."""
    there = {c.strip().lower(): c for c in rows.columns}
    field = lambda f: F.coalesce(*[F.nullif(F.trim(F.col(there[s])), F.lit("")) for s in SYNONYMS[f] if s in there], F.lit(None).cast("string"))
    out = rows.select(*keep, field("name").alias("name"), field("host").alias("host"), field("port").try_cast("int").alias("port"), field("username").alias("username"))
    return out.withColumn("port", F.coalesce("port", F.lit(22))).withColumn("reason", F.when(F.col("host").isNull(), "no host").when(~F.col("port").between(1, 65535), "bad port"))


def imported(rows: DataFrame, known: DataFrame, order: str) -> DataFrame:
    """dimension() with the duplicates marked: a host that is known already, or that a good line before has."""
    held = dimension(rows, (order,)).join(known.select("host").distinct().withColumn("_known", F.lit(True)), "host", "left")
    rn = F.row_number().over(W.partitionBy("host", F.col("reason").isNull()).orderBy(order))
    again = F.when(F.col("_known"), "known host").when(rn > 1, "duplicate host")
    return held.withColumn("reason", F.coalesce("reason", again)).drop("_known")


def metrics(*parts: DataFrame) -> DataFrame:
    """Metrics of several sources together; a field that one lacks is null."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def export_csv(alerts: DataFrame, path: str, limit: int = 10_000) -> None:
    """The newest alerts as CSV with a header."""
    newest = alerts.orderBy(F.desc("ts"), F.desc("id")).limit(limit)
    newest.select("id", "array_id", "observer", "level", "message", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("time")).write.mode("overwrite").option("header", True).csv(path)
