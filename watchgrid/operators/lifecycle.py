"""Deduplication, upserts, acknowledgement policy, archive and retention."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from watchgrid.operators.passes import ordered_pass, throttle
from watchgrid.schema import micros


def digest(*parts: Column) -> Column:
    return F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]))


def dedup_new(new: DataFrame, held: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Of new rows the first of each key that isn't held yet, by time and id."""
    own = [F.col(k) for k in keys]
    new, held = new.withColumn("digest", digest(*own)), held.select(digest(*own).alias("digest")).distinct()
    first = new.groupBy("digest").agg(F.min_by(F.struct(*new.drop("digest").columns), F.struct("ts", "id")).alias("r"))
    return first.join(held, "digest", "left_anti").select("r.*", "digest")


def sync_counts(new: DataFrame, held: DataFrame, keys: Sequence[str]) -> DataFrame:
    """How many of new rows dedup_new() takes, and how many it skips."""
    taken = dedup_new(new, held, keys).agg(F.count("*").alias("imported"))
    return taken.crossJoin(F.broadcast(new.agg(F.count("*").alias("seen")))).select("imported", (F.col("seen") - F.col("imported")).alias("skipped"))


def dedup_recent(new: DataFrame, held: DataFrame, stamp: str = "stamp", recent: int = 100) -> DataFrame:
    """Of new rows the first of each prefix key that none of the most recent held rows has."""
    key = prefix_key(F.col(stamp), F.col("observer"), F.col("message"))
    last = held.orderBy(F.desc("ts"), F.desc("id")).limit(recent).select(key.alias("key")).distinct()
    first = new.withColumn("key", key).groupBy("key").agg(F.min_by(F.struct(*new.columns), F.struct("ts", "id")).alias("r"))
    return first.join(F.broadcast(last), "key", "left_anti").select("r.*")


def prefix_key(ts: Column, observer: Column, message: Column, size: int = 50) -> Column:
    return F.concat_ws("_", ts, observer, F.left(message, F.lit(size)))


def first_by(rows: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """The first row of each key; rows whose key is blank are all kept."""
    blank = F.coalesce(F.trim(F.col(key)), F.lit("")) == ""
    rn = F.row_number().over(W.partitionBy(key).orderBy(*order))
    return rows.where(~blank).withColumn("rn", rn).where("rn = 1").drop("rn").unionByName(rows.where(blank))


def upsert(held: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """held with the rows of new put over those of the same keys; a null in new leaves the old value."""
    others = [c for c in held.columns if c not in keys]
    a = held.select(*keys, *[F.col(c).alias(f"old_{c}") for c in others])
    b = new.select(*keys, *[F.col(c).alias(f"new_{c}") for c in others])
    return a.join(b, list(keys), "full").select(*keys, *[F.coalesce(f"new_{c}", f"old_{c}").alias(c) for c in others])


def throttled(updates: DataFrame, by: Sequence[str], seconds: float = 0.5, value: str = "value") -> DataFrame:
    """Updates that go out: no sooner than so long after the last sent, and of another value than that."""
    return ordered_pass(updates, by, throttle(seconds, value), "_goes", T.BooleanType(), (value,)).where("_goes").drop("_goes")


def expiry(ack_type: Column, acked_at: Column, hours: Column) -> Column:
    """When an acknowledgement ends: dismissed after a day, deferred after three unless given, confirmed by choice."""
    asked = F.when(hours.isin(2, 4, 6, 8, 12, 24), hours).otherwise(24)
    length = F.when(ack_type == "dismiss", 24).when(ack_type == "deferred", F.coalesce(hours, F.lit(72))).when(hours.isNotNull(), asked)
    return F.timestamp_add("HOUR", length.cast("int"), acked_at)


def inherited(alerts: DataFrame, acks: DataFrame, at: Column) -> DataFrame:
    """New alerts with the acknowledgement that they inherit: confirmed without end, else the longest live dismissal."""
    live = acks.groupBy("array_id", "observer").agg(
        F.count_if((F.col("ack_type") == "confirmed_ok") & F.col("expires_at").isNull()).alias("confirmed"),
        F.max(F.when((F.col("ack_type") == "dismiss") & (F.col("expires_at") > at), F.col("expires_at"))).alias("until"),
    )
    kind = F.when(F.col("confirmed") > 0, "confirmed_ok").when(F.col("until").isNotNull(), "dismiss")
    return alerts.join(live, ["array_id", "observer"], "left").withColumn("auto_ack", kind).withColumn("expires_at", F.when(kind == "dismiss", F.col("until"))).drop("confirmed", "until")


def archive_split(alerts: DataFrame, active_from: Column, archive_from: Column) -> DataFrame:
    """Where each alert belongs: active, archived by month, or gone."""
    place = F.when(F.col("ts") >= active_from, "active").when(F.col("ts") >= archive_from, "archive").otherwise("expired")
    return alerts.withColumn("place", place).withColumn("year_month", F.date_format("ts", "yyyy-MM"))


def by_month(alerts: DataFrame) -> DataFrame:
    return alerts.withColumn("year_month", F.date_format("ts", "yyyy-MM"))


def archive(alerts: DataFrame, path: str) -> None:
    """Write alerts by array and month; a later read of one of either opens no other files."""
    by_month(alerts).repartition("array_id", "year_month").write.mode("append").partitionBy("array_id", "year_month").parquet(path)


def archived(rows: DataFrame, array_ids: Sequence[int] = (), months: Sequence[str] = ()) -> DataFrame:
    """The archive's rows of arrays and months, newest first; both are partitions, so no other files are opened."""
    held = rows.where(F.col("array_id").isin(*array_ids)) if array_ids else rows
    held = held.where(F.col("year_month").isin(*months)) if months else held
    return held.orderBy(F.desc("ts"), F.desc("id"))


def acknowledged(held: DataFrame, asked: DataFrame, alerts: DataFrame) -> DataFrame:
    """Acknowledgements with those asked for, unless their alert is acknowledged already or isn't there."""
    first = asked.dropDuplicates(["alert_id"]).join(alerts, "alert_id", "left_semi").join(held, "alert_id", "left_anti")
    return held.unionByName(first)


def undone(held: DataFrame, ids: DataFrame) -> DataFrame:
    """Acknowledgements without those of the ids."""
    return held.join(ids, "alert_id", "left_anti")


def modified(held: DataFrame, ids: DataFrame, ack_type: str, hours: int | None = None) -> DataFrame:
    """Acknowledgements, those of the ids with another type and end."""
    marked = held.join(ids.distinct().withColumn("_m", F.lit(True)), "alert_id", "left")
    kind = F.when(F.col("_m"), ack_type).otherwise(F.col("ack_type"))
    ends = F.when(F.col("_m"), expiry(F.lit(ack_type), F.col("acked_at"), F.lit(hours).cast("int"))).otherwise(F.col("expires_at"))
    return marked.withColumn("ack_type", kind).withColumn("expires_at", ends).drop("_m")


def retained(rows: DataFrame, at: Column, seconds: float) -> DataFrame:
    return rows.where(micros(F.col("ts")) >= micros(at) - int(seconds * 1_000_000))


def ring(rows: DataFrame, keep: int) -> tuple[DataFrame, DataFrame]:
    """The newest rows that stay in the ring, and those that spill.

    The border is the keep-th newest row, which a top-n finds without sorting all rows in one task.
    """
    border = rows.orderBy(F.desc("ts"), F.desc("id")).limit(keep).agg(F.min(F.struct("ts", "id")).alias("b"))
    held = rows.join(F.broadcast(border))
    newer = F.struct("ts", "id") >= F.col("b")
    return held.where(newer).drop("b"), held.where(~newer).drop("b")
