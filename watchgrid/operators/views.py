"""Views over several entities: timeline, search, personal views, users, tags, tasks, alert states, banners."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from watchgrid.operators.aggregate import skeleton
from watchgrid.operators.passes import cooldown, ordered_pass
from watchgrid.operators.store import newest, page

#: Observers whose every alert is critical.
CRITICAL = ("process_crash", "io_timeout", "sig_monitor", "controller_state", "disk_state")


def critical(observer: Column, level: Column) -> Column:
    return observer.isin(*CRITICAL) | (level == "critical")


def paged(rows: DataFrame, limit: int, offset: int = 0, newest_first: bool = True) -> DataFrame:
    """One page by time with total, the number of all rows; the count is one row and is joined to the page."""
    total = rows.agg(F.count("*").alias("total"))
    return page(rows, limit, offset, newest_first).crossJoin(F.broadcast(total))


def timeline(alerts: DataFrame, since: Column, observers: Sequence[str] = (), limit: int = 20, offset: int = 0) -> DataFrame:
    """A page of the alerts from a moment on, newest first, with the total and short messages."""
    held = alerts.where(F.col("ts") >= since)
    held = held.where(F.col("observer").isin(*observers)) if observers else held
    return paged(held, limit, offset).withColumn("message", F.left("message", F.lit(120)))


def overlapping(tasks: DataFrame, array_id: int, at: Column, limit: int = 20) -> DataFrame:
    """Of the newest tasks that have started those of an array; a task without arrays is of all."""
    begun = tasks.where(F.col("started_at") <= at).orderBy(F.desc("started_at"), F.desc("task_id")).limit(limit)
    return begun.where((F.size("array_ids") == 0) | F.array_contains("array_ids", F.lit(array_id).cast("bigint")))


def found_by_tag(arrays: DataFrame, tags: DataFrame, text: str) -> DataFrame:
    """Arrays whose host holds a text, with their tag, or "untagged" where they have none, and how many the tag has so."""
    held = arrays.where(F.lower("host").contains(text.lower())) if text else arrays
    named = held.join(tags.select("tag_id", F.col("name").alias("tag")), "tag_id", "left").withColumn("tag", F.coalesce("tag", F.lit("untagged")))
    return named.withColumn("in_tag", F.count("*").over(W.partitionBy("tag")))


def tag_names(tags: DataFrame) -> DataFrame:
    """The first and second level's name of each tag: of level two its parent's and its own, of level one its own."""
    parent = tags.select(F.col("tag_id").alias("parent_id"), F.col("name").alias("parent"))
    held = tags.join(parent, "parent_id", "left")
    two = F.col("level") == 2
    return held.select("tag_id", F.when(two, F.col("parent")).otherwise(F.col("name")).alias("l1"), F.when(two, F.col("name")).alias("l2"))


def with_children(tags: DataFrame, wanted: Sequence[int]) -> DataFrame:
    """The ids of tags asked for, and of all tags under them."""
    return tags.where(F.col("tag_id").isin(*wanted) | F.col("parent_id").isin(*wanted)).select("tag_id")


def watched(alerts: DataFrame, arrays: DataFrame, array_ids: Sequence[int], tag_ids: Sequence[int]) -> DataFrame:
    """Alerts of arrays that are watched, or whose tag is."""
    mine = arrays.where(F.col("array_id").isin(*array_ids) | F.coalesce(F.col("tag_id").isin(*tag_ids), F.lit(False))).select("array_id").distinct()
    return alerts.join(mine, "array_id", "left_semi")


def online(sessions: DataFrame, presence: DataFrame, at: Column, minutes: int = 5) -> DataFrame:
    """Users seen within so many minutes and active, with the page that they were last on; a blank nickname is the ip."""
    seen = sessions.where(F.col("active") & (F.col("seen_at") >= at - F.expr(f"interval {int(minutes)} minutes")))
    last = presence.groupBy("ip").agg(F.max_by("page", F.struct("ts", "id")).alias("page"))
    return seen.join(last, "ip", "left").withColumn("nickname", F.coalesce(F.nullif(F.trim("nickname"), F.lit("")), "ip"))


def claimed(sessions: DataFrame, ip: str, nickname: str) -> DataFrame:
    """sessions after an address claims a nickname: the newest session of that name goes over to the address.

    What the address had before goes. Without a session of that name, or where the address has it, nothing changes.
    """
    holder = sessions.where(F.col("nickname") == nickname.strip()).agg(F.max_by("ip", F.struct("seen_at", "ip")).alias("holder"))
    held = sessions.crossJoin(F.broadcast(holder))
    moves = F.col("holder").isNotNull() & (F.col("holder") != ip)
    held = held.where(~(F.coalesce(moves, F.lit(False)) & (F.col("ip") == ip)))
    return held.withColumn("ip", F.when(moves & (F.col("ip") == F.col("holder")), F.lit(ip)).otherwise(F.col("ip"))).drop("holder")


def tasks_listed(tasks: DataFrame, enabled_only: bool = False) -> DataFrame:
    return (tasks.where("enabled") if enabled_only else tasks).orderBy(F.desc("created_at"), F.desc("id"))


def task_results(results: DataFrame, task_id: int | None = None, limit: int = 20) -> DataFrame:
    """The newest results, of one task or of all."""
    held = results if task_id is None else results.where(F.col("task_id") == task_id)
    return held.orderBy(F.desc("executed_at"), F.desc("id")).limit(limit)


def results_per_task(results: DataFrame, n: int) -> DataFrame:
    """The n newest results of each task."""
    return results.withColumn("rn", F.row_number().over(W.partitionBy("task_id").orderBy(F.desc("executed_at"), F.desc("id")))).where(F.col("rn") <= n)


def states(events: DataFrame, at: Column) -> DataFrame:
    """Each fingerprint's alert by its newest event: when it was first and last seen, and its state at a moment.

    A mute that has ended is active again; a recovery, an expected alert or a closed one stay as they are.
    """
    last = F.max_by(F.struct("state", "review_status", "mute_until", "level"), F.struct("ts", "id")).alias("l")
    held = events.groupBy("fingerprint").agg(F.min("ts").alias("first_seen_at"), F.max("ts").alias("last_seen_at"), F.count("*").alias("times"), last)
    state = F.when((F.col("l.state") == "muted") & (F.col("l.mute_until") <= at), "active").otherwise(F.coalesce("l.state", F.lit("active")))
    return held.select("fingerprint", "first_seen_at", "last_seen_at", "times", state.alias("state"), F.coalesce("l.review_status", F.lit("pending")).alias("review_status"), "l.level")


def banners(alerts: DataFrame, seconds: float = 86_400) -> DataFrame:
    """Critical alerts that show a banner, when each is dismissed at once: an observer then rests for so long."""
    held = alerts.where(critical(F.col("observer"), F.col("level")))
    return ordered_pass(held, ["observer"], cooldown(seconds), "_goes", T.BooleanType()).where("_goes").drop("_goes")


def feed(alerts: DataFrame, at: Column, hours: int = 2, limit: int = 50) -> DataFrame:
    """The newest alerts of the last hours."""
    return page(alerts.where(F.col("ts") >= at - F.expr(f"interval {int(hours)} hours")), limit)


def identity(observer: Column, details: Column, message: Column) -> Column:
    """What an alert is about, by its observer's details, else by what its message says apart from numbers."""
    raw = lambda p: F.get_json_object(details, p)
    some = lambda c: F.coalesce(c, F.lit("?"))
    alarm = F.coalesce(raw("$.new_send_alarms[0]"), raw("$.new_resume_alarms[0]"), raw("$.new_events[0]"))
    of = lambda c, p: F.get_json_object(c, p)
    action = F.coalesce(of(alarm, "$.action"), F.when(of(alarm, "$.is_resume") == "true", "resume").when(of(alarm, "$.is_event") == "true", "event").otherwise("fault"))
    by_alarm = F.when(alarm.isNotNull(), F.concat_ws("|", F.coalesce(of(alarm, "$.obj_type"), of(alarm, "$.alarm_name"), F.lit("?")), action))
    card = raw("$.alerts[0]")
    fields = F.array_join(F.transform(F.from_json(of(card, "$.fields"), "array<struct<field:string>>"), lambda f: some(f["field"])), ",")
    by_card = F.when(card.startswith("{"), F.concat_ws("|", some(of(card, "$.card")), some(F.nullif(of(card, "$.board_id"), F.lit(""))), F.coalesce(fields, F.lit(""))))
    ports = F.try_element_at(F.json_object_keys(raw("$.port_counters")), F.lit(1))
    change = lambda field: F.when(raw("$.changes[0]").isNotNull(), some(F.nullif(raw(f"$.changes[0].{field}"), F.lit(""))))
    own = (
        F.when(observer == "alarm_type", by_alarm)
        .when(observer == "card_info", by_card)
        .when(observer == "error_code", ports)
        .when(observer.isin("link_status", "port_speed", "port_fec"), change("port"))
        .when(observer.isin("controller_state", "disk_state"), change("id"))
    )
    return F.coalesce(own, skeleton(message))


def log_tail(lines: DataFrame, n: int = 100, keyword: str | None = None) -> DataFrame:
    """The last n lines of each array's log that hold a keyword in any case, out of its last 3 n."""
    three = newest(lines, 3 * n, ("array_id",)).drop("rn")
    held = three.where(F.lower("line").contains(keyword.lower())) if keyword else three
    return newest(held, n, ("array_id",)).drop("rn")


def recent_audit(logs: DataFrame, since: Column, user: str | None = None, action: str | None = None, limit: int = 100) -> DataFrame:
    """The newest audit entries from a moment on, of one user or action if given."""
    held = logs.where(F.col("ts") >= since)
    for column, value in (("user", user), ("action", action)):
        held = held if value is None else held.where(F.col(column) == value)
    return page(held, limit)


def foldered(arrays: DataFrame, tags: DataFrame) -> DataFrame:
    """arrays whose folder names become tags: a blank folder leaves the tag, else the tag of that name, new ones numbered on.

    New tags are numbered after the largest id in order of name.
    """
    names = arrays.where(F.trim("folder") != "").select(F.trim("folder").alias("name")).distinct()
    last = tags.agg(F.coalesce(F.max("tag_id"), F.lit(0)).alias("last"))
    # folder names are few: a dimension
    new = names.join(tags, "name", "left_anti").crossJoin(F.broadcast(last)).select("name", (F.col("last") + F.row_number().over(W.orderBy("name"))).alias("new_id"))
    known = tags.groupBy("name").agg(F.min("tag_id").alias("new_id")).unionByName(new)
    held = arrays.withColumn("name", F.nullif(F.trim("folder"), F.lit(""))).join(known, "name", "left")
    return held.select("array_id", F.coalesce("new_id", "tag_id").alias("tag_id"), F.col("name").alias("tag"))
