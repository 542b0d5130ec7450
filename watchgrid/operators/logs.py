"""Detectors over log lines: classes by pattern, alarm pairing, resets, start of work, and sensitive data.

A line is a row with a key, ts, id and line. Patterns and lists under "Fixed values" are those that logs and
listings are known by.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from watchgrid.functions.text import lines, masked, slot_key, stamp
from watchgrid.schema import once

#: What a crash looks like; the first that matches counts.
CRASHES = (
    ("segfault", r"segfault\s+at"),
    ("core_dump", r"core\s+dumped"),
    ("oom_kill", r"Out\s+of\s+memory.*Killed\s+process"),
    ("oom_kill", r"Killed\s+process\s+\d+"),
    ("gp_fault", r"general\s+protection\s+fault"),
    ("kernel_bug", r"kernel\s+BUG\s+at"),
    ("kernel_panic", r"Call\s+Trace:"),
    ("kernel_oops", r"Oops:"),
    ("trap_fault", r"trapping.*fault"),
)
#: What a failure of input or output looks like.
IO_FAILURES = (
    ("io_error", r"I/O\s+error"),
    ("io_timeout", r"io\s+timeout"),
    ("scsi_error", r"scsi\s+error"),
    ("medium_error", r"Medium\s+Error"),
    ("hw_error", r"Hardware\s+Error"),
    ("task_abort", r"task\s+abort"),
    ("device_offline", r"device\s+offline"),
    ("target_reset", r"reset\s+target"),
    ("fs_error", r"EXT4-fs.*error"),
    ("fs_error", r"XFS.*error"),
    ("buffer_io_error", r"Buffer\s+I/O\s+error"),
)
#: Resets that nobody asked for.
RESETS = ("watchDog reset", "oops reset", "unknown reset", "oom reset", "panic reset", "kernel reset", "mce reset", "bios reset", "software unknown reset", "failure recovery reset")


def classified(rows: DataFrame, patterns: Sequence[tuple[str, str]], line: str = "line") -> DataFrame:
    """Lines with the class of the first pattern that they match, case aside; others go."""
    kind = F.lit(None).cast("string")
    for name, pattern in reversed(patterns):
        kind = F.when(F.col(line).rlike(f"(?i){pattern}"), name).otherwise(kind)
    return rows.withColumn("kind", kind).where("kind is not null")


def newest_lines(rows: DataFrame, by: Sequence[str], n: int = 500) -> DataFrame:
    """The last n lines of each key."""
    return rows.withColumn("rn", F.row_number().over(W.partitionBy(*by).orderBy(F.desc("ts"), F.desc("id")))).where(F.col("rn") <= n).drop("rn")


def crashes(rows: DataFrame, line: str = "line") -> DataFrame:
    """Crashes with kind and process: name[pid], or the one in brackets after "process pid"."""
    pair = lambda p, name, pid: F.when(F.regexp_extract(line, p, 1) != "", F.concat(F.regexp_extract(line, p, name), F.lit("["), F.regexp_extract(line, p, pid), F.lit("]")))
    process = F.coalesce(pair(r"(\w[\w.-]+)\[(\d+)\]", 1, 2), pair(r"process\s+(\d+)\s*\((\w+)\)", 2, 1), F.lit(""))
    return classified(rows, CRASHES, line).withColumn("process", process).withColumn("level", F.lit("critical"))


def io_failures(rows: DataFrame, by: Sequence[str], line: str = "line", many: int = 5) -> DataFrame:
    """For each key its failures by number: critical from many on, else an error."""
    held = classified(rows, IO_FAILURES, line).groupBy(*by).agg(F.count("*").alias("events"), F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds"))
    return held.withColumn("level", F.when(F.col("events") >= many, "critical").otherwise("error"))


def signals(rows: DataFrame, allowed: Sequence[int] = (15, 61), line: str = "line") -> DataFrame:
    """A row for each signal in each line that isn't allowed."""
    found = F.transform(F.regexp_extract_all(line, F.lit(r"(?i)\bsig\s*(\d+)\b"), F.lit(1)), lambda s: s.try_cast("bigint"))
    return rows.withColumn("signal", F.explode(found)).where(~F.col("signal").isin(*allowed)).withColumn("level", F.lit("error"))


def recoveries(rows: DataFrame, by: Sequence[str], keyword: str = "recover chiperr", line: str = "line") -> DataFrame:
    """Lines with the keyword, case aside: bus address, its normal form, and the running total by key."""
    found = F.nullif(F.regexp_extract(line, r"(?i)((?:dev|top)\(0:[\d.]+\))", 1), F.lit(""))
    held = rows.where(F.lower(line).contains(keyword.lower())).withColumn("slot", found)
    held = held.withColumn("bus", slot_key(F.regexp_extract("slot", r"0:([\d.]+)", 1)))
    return held.withColumn("total", F.row_number().over(W.partitionBy(*by).orderBy("ts", "id"))).withColumn("at", stamp(F.col(line)))


TYPED = r"(?i)AlarmType:(\d+)\s+(event|fault|resume)"


def _typed(text: Column) -> Column:
    some = lambda p: F.nullif(F.regexp_extract(text, p, 1), F.lit(""))
    return F.struct(F.regexp_extract(text, TYPED, 1).try_cast("int").alias("alarm_type"), F.lower(F.regexp_extract(text, TYPED, 2)).alias("action"), F.trim(some(r"(?i)AlarmId:(\S+)")).alias("alarm_id"), F.coalesce(F.trim(some(r"(?i)objType:(\S+)")), F.lit("unknown")).alias("name"))


def alarm_line(text: Column) -> Column:
    """The alarm that a log line tells of in the form "Type:N action"; null for none."""
    return F.when(text.rlike(TYPED), _typed(text))


def alarm(text: Column) -> Column:
    """The alarm that a message tells of, as alarm_line() or in the older form in brackets; null for none."""
    some = lambda p: F.nullif(F.regexp_extract(text, p, 1), F.lit(""))
    kind, name = some(r"(?i)alarm\s*type\s*\((\d+)\)"), some(r"(?i)alarm\s*name\s*\(([^)]+)\)")
    said = F.when(text.rlike(r"(?i)resume\s+alarm"), "resume").when(text.rlike(r"(?i)send\s+alarm"), "fault")
    second = F.struct(kind.try_cast("int").alias("alarm_type"), said.alias("action"), F.trim(some(r"(?i)alarm\s*id\s*\(([^)]+)\)")).alias("alarm_id"), F.coalesce(F.trim(name), F.lit("unknown")).alias("name"))
    return F.when(text.rlike(TYPED), _typed(text)).when(kind.isNotNull() | name.isNotNull(), second)


def alarms(rows: DataFrame, by: Sequence[str], line: str = "line", recent: int = 5) -> DataFrame:
    """The newest events and faults of each key, recent of them, and whether each has recovered.

    An event needs no recovery. A fault has recovered if a resume of its alarm id follows; as long as none does it
    is active. total_events, total_faults and total_resumes count all lines of the key.
    """
    held = rows.withColumn("a", alarm_line(F.col(line))).where("a.alarm_type in (0, 1, 2)").select(*by, "ts", "id", "a.*")
    order = W.partitionBy(*by, "alarm_id").orderBy("ts", "id").rowsBetween(1, W.unboundedFollowing)
    resumed = F.col("alarm_id").isNotNull() & (F.max((F.col("alarm_type") == 2).cast("int")).over(order) == 1)
    held = held.withColumn("recovered", F.when(F.col("alarm_type") == 0, True).otherwise(F.coalesce(resumed, F.lit(False))))
    total = W.partitionBy(*by)
    held = held.withColumns({f"total_{n}": F.sum((F.col("alarm_type") == k).cast("bigint")).over(total) for k, n in enumerate(("events", "faults", "resumes"))})
    held = held.where("alarm_type <> 2").withColumn("rn", F.row_number().over(W.partitionBy(*by).orderBy(F.desc("ts"), F.desc("id"))))
    return held.where(F.col("rn") <= recent).drop("rn")


def active_alarms(rows: DataFrame, by: Sequence[str], line: str = "line") -> DataFrame:
    """Alarms whose last fault no resume follows, one row for each key and alarm id."""
    held = rows.withColumn("a", alarm_line(F.col(line))).where("a.alarm_type in (1, 2) and a.alarm_id is not null").select(*by, "ts", "id", "a.*")
    last = held.groupBy(*by, "alarm_id").agg(F.max_by(F.struct("alarm_type", "name", "ts", "id"), F.struct("ts", "id")).alias("l"))
    return last.where("l.alarm_type = 1").select(*by, "alarm_id", "l.name", "l.ts", "l.id")


def resets(logs: DataFrame, by: Sequence[str], text: str = "text", reasons: Sequence[str] = RESETS) -> DataFrame:
    """Resets without cause in logs of records "reason: ... time: ..." between blank lines, each time once."""
    blocks = F.split(F.regexp_replace(text, r"\r", ""), r"\n[ \t]*(?:\n[ \t]*)+")
    one = logs.select(*by, F.posexplode(blocks).alias("pos", "block"))
    named = lambda name: F.filter(lines(F.col("block")), lambda x: x.contains(":") & (F.lower(F.trim(F.substring_index(x, ":", 1))) == name))
    value = lambda name: F.try_element_at(F.transform(named(name), lambda x: F.trim(F.substring(x, F.position(F.lit(":"), x) + 1, F.length(x)))), F.lit(-1))
    held = one.withColumn("reason", value("reason")).withColumn("time", value("time"))
    bad = F.col("reason").rlike("(?i)" + "|".join(rf"\Q{r}\E" for r in reasons))
    held = held.where(bad & (F.coalesce("time", F.lit("")) != ""))
    return held.groupBy(*by, "time").agg(F.min_by("reason", "pos").alias("reason"))


def started(listings: DataFrame, by: Sequence[str], text: str = "text") -> DataFrame:
    """Whether an array works: all modules of its listing are at 1. reason tells of no text and of no modules."""
    pattern = r"(?m)^\s*([A-Za-z0-9_]+)\s*[:：]\s*([0-9]+)\s*$"
    names, states = (F.regexp_extract_all(text, F.lit(pattern), F.lit(k)) for k in (1, 2))
    # of a module's lines the last counts
    modules = F.arrays_zip(names.alias("name"), states.alias("state"))
    last = F.filter(modules, lambda m, i: ~F.exists(F.slice(modules, i + 2, F.size(modules)), lambda n: n["name"] == m["name"]))
    held = listings.withColumn("modules", last)
    failed = F.transform(F.filter("modules", lambda m: m["state"] != "1"), lambda m: m["name"])
    reason = F.when(F.col(text).isNull(), "command_failed").when(F.size("modules") == 0, "parse_failed").when(F.size(failed) > 0, "not_started")
    return held.select(*by, reason.isNull().alias("started"), reason.alias("reason"), F.coalesce(F.array_join(F.array_sort(failed), ","), F.lit("")).alias("failed"), F.coalesce(F.size("modules"), F.lit(0)).alias("modules"))


def gated(results: DataFrame, starts: DataFrame, by: Sequence[str] = ("array_id",), gate: str = "start_work") -> DataFrame:
    """Detectors' results as they count: while an array hasn't started its work, those of the gate alone.

    starts has by, ts and started; a result follows the newest state before or at its time, and none lets it pass.
    """
    marks = starts.select(*by, "ts", F.lit(-1).cast("bigint").alias("id"), "started").withColumn("mark", F.lit(True))
    both = results.withColumn("mark", F.lit(False)).unionByName(marks, allowMissingColumns=True)
    order = W.partitionBy(*by).orderBy("ts", F.desc("mark"), "id").rowsBetween(W.unboundedPreceding, 0)
    held = both.withColumn("works", F.coalesce(F.last("started", ignorenulls=True).over(order), F.lit(True)))
    return held.where(~F.col("mark") & (F.col("works") | (F.col("observer") == gate))).select(*results.columns)


def slow_commands(runs: DataFrame, seconds: float = 1.0) -> DataFrame:
    return runs.where(F.col("elapsed_s") > seconds).withColumn("level", F.lit("error"))


def restarted(listings: DataFrame, by: Sequence[str], process: str, text: str = "text") -> DataFrame:
    """Listings in which the largest -v number of a process is larger than in the listing before that had one.

    Lines that name grep don't count, nor do those without the process's name.
    """
    own = F.filter(lines(F.col(text)), lambda x: F.lower(x).contains(process.lower()) & ~x.contains("grep"))
    numbers = F.transform(own, lambda x: F.regexp_extract(x, r"(?i)-v\s+(\d+)", 1).try_cast("bigint"))
    held = listings.withColumn("v", F.array_max(numbers)).where("v is not null")
    held = held.withColumn("previous", F.lag("v").over(W.partitionBy(*by).orderBy("ts", "id"))).where("v > previous")
    return held.withColumn("process", F.lit(process)).withColumn("level", F.lit("warning"))


#: Fields of a transceiver's block.
TRANSCEIVER = ("PortId", "parentID", "Name", "HealthState", "RunningState", "RunSpeed", "MaxSpeed", "ConfSpeed")


def transceivers(listings: DataFrame, by: Sequence[str], text: str = "text", hot: float = 105) -> DataFrame:
    """A row for each thing wrong with a transceiver: temperature, health, running state or speed."""
    block = listings.select(*by, F.posexplode(F.split(text, "---+")).alias("pos", "block"))
    value = lambda name: F.trim(F.regexp_extract("block", rf"(?m)^[ \t]*{name}[ \t]*:[ \t]*(.*?)[ \t\r]*$", 1))
    held = block.withColumns({n: value(n) for n in TRANSCEIVER}).withColumn("temp", F.regexp_extract("block", r"(?m)^[^:\n]*TempReal[^:\n]*:[^\n\d.-]*([\d.-]+)", 1).try_cast("double"))
    low = {c: F.lower(c) for c in ("RunSpeed", "MaxSpeed")}
    speed = F.when(low["RunSpeed"].contains("unknown"), "speed unknown").when((F.col("MaxSpeed") != "") & (F.col("RunSpeed") != "") & (low["MaxSpeed"] != low["RunSpeed"]), "speed differs")
    wrong = F.array(
        F.when(F.col("temp") >= hot, "temperature"),
        F.when((F.col("HealthState") != "") & (F.upper("HealthState") != "NORMAL"), "health"),
        F.when((F.col("RunningState") != "") & (F.upper("RunningState") != "LINK_UP"), "running"),
        speed,
    )
    return held.withColumn("issue", F.explode(F.array_compact(wrong))).select(*by, F.when(F.col("Name") == "", "P0").otherwise(F.col("Name")).alias("name"), F.col("PortId").alias("port_id"), "issue")


# Sensitive data

#: What gives sensitive data away, by category; the first group is the value.
SENSITIVE = (
    ("password", r"password\s*[=:]\s*['\x22]?([^\s'\x22]+)"),
    ("password", r"passwd\s*[=:]\s*['\x22]?([^\s'\x22]+)"),
    ("password", r"pwd\s*[=:]\s*['\x22]?([^\s'\x22]+)"),
    ("secret", r"secret\s*[=:]\s*['\x22]?([^\s'\x22]+)"),
    ("secret", r"token\s*[=:]\s*['\x22]?([^\s'\x22]+)"),
    ("secret", r"api[_-]?key\s*[=:]\s*['\x22]?([^\s'\x22]+)"),
    ("nqn", r"(nqn\.[a-zA-Z0-9.\-:]+)"),
    ("iqn", r"(iqn\.[a-zA-Z0-9.\-:]+)"),
    ("ip_with_cred", r"(\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})\s*[,;]\s*(?:user|admin|root)\s*[,;]\s*[^\s,;]+"),
)
#: What a line must hold, in lower case, for the pattern of the same place to match; None is digits and a point.
HINTS = ("password", "passwd", "pwd", "secret", "token", "key", "nqn.", "iqn.", None)
#: Lines that are safe as they are.
SAFE = (r"password\s*[=:]\s*\*+", r"password\s*[=:]\s*<masked>", r"password\s*[=:]\s*\[hidden\]", r"password\s*[=:]\s*\[REDACTED\]", r"password\s*[=:]\s*#")
#: Lines that only speak of passwords.
ABOUT = (
    r"password_\w+\s*[=:]",
    r"passwd_\w+\s*[=:]",
    r"password[^=:]*[/\\][a-zA-Z0-9_/\\]+",
    r"(?:enter|input|type|confirm|prompt)\s+(?:your\s+)?password",
    r"password\s+(?:is\s+)?(?:required|needed|missing)",
    r"password\s+(?:check|verify|valid|invalid|correct|incorrect|match|mismatch|fail|error|success)",
    r"(?:check|verify|validate)\s+password",
    r"(?:field|column|key|name|label|param)\s*[=:]\s*[\x22']?password",
    r"(?:get|set|read|write|check|verify|validate)_?password",
    r"password_(?:hash|encrypt|decrypt|encode|decode)",
    r"password[_-]?(?:length|size|min|max|policy|strength|expire|age)",
    r"%\(password\)s",
    r"\{password\}",
)
#: Stand-ins for a value.
STAND_INS = (
    "xxx", "***", "---", "...", "password", "passwd", "secret", "token", "your_password", "your_secret", "your_token", "<password>", "<secret>", "<token>",
    "${password}", "${secret}", "${token}", "$password", "$secret", "$token", "null", "none", "empty", "undefined", "example", "sample", "test", "demo", "placeholder", "changeme", "fixme",
)
#: Settings that aren't passwords, and ends of settings' names.
SETTINGS = ("true", "false", "yes", "no", "on", "off", "enabled", "disabled", "required", "optional", "strong", "weak", "medium", "none", "null", "empty", "default", "auto", "manual", "file", "path", "dir", "directory")
SETTING_ENDS = ("_file", "_path", "_dir", "_name", "_type", "_mode", "_policy")


def stands_in(value: Column) -> Column:
    low = F.lower(F.trim(value))
    return low.rlike(r"^[*\-_x.]*$") | low.isin(*STAND_INS) | value.rlike(r"^\$\{?\w+\}?$")


def plausible(value: Column) -> Column:
    """Whether a value may be a password: length, and neither digits, a setting, a path nor a variable's name."""
    low = F.lower(value)
    name = value.rlike("^[a-z][a-z0-9_]+$") & value.contains("_") & (~value.rlike("[0-9]") | (F.length(value) < 10))
    path = value.startswith("/") | value.startswith("./") | value.startswith("..")
    ends = F.lit(False)
    for e in SETTING_ENDS:
        ends = ends | low.endswith(e)
    return F.length(value).between(6, 64) & ~value.rlike("^[0-9]+$") & ~low.isin(*SETTINGS) & ~path & ~name & ~ends


FOUND = "array<struct<category:string,pattern:int,shown:string>>"


def finding(category: str, pattern: int) -> Callable[[Column], Column]:
    return lambda v: F.struct(F.lit(category).alias("category"), F.lit(pattern).alias("pattern"), masked(v).alias("shown"))


def sensitive(rows: DataFrame, line: str = "line", allowed: Sequence[str] = (), paths: Sequence[str] = ()) -> DataFrame:
    """A row for each sensitive value in a line, with category, pattern number and the value masked.

    A line is passed over if it is safe, only speaks of passwords, matches an allowed pattern or names an allowed
    path. Stand-ins don't count, and passwords and secrets must look like some. A pattern is tried only on lines that
    hold its hint, and the lines to pass over are told only of those that hold any.
    """
    over = F.col(line).rlike("(?i)" + "|".join(f"(?:{p})" for p in (*SAFE, *ABOUT, *allowed)))
    for p in paths:
        over = over | F.col(line).contains(p)
    found, low = [], F.lower(line)
    hinted = reduce(or_, [low.contains(h) if h else low.rlike(r"\d\.\d") for h in HINTS])
    for k, ((category, pattern), hint) in enumerate(zip(SENSITIVE, HINTS, strict=True)):
        values = F.filter(F.regexp_extract_all(line, F.lit(f"(?i){pattern}"), F.lit(1)), lambda v: ~stands_in(v))
        if category in ("password", "secret"):
            values = F.filter(values, plausible)
        shown = F.transform(values, finding(category, k))
        found.append(F.when(low.contains(hint), shown).otherwise(F.array().cast(FOUND)) if hint else shown)
    # exploded as made, the list would be made once more to see whether it is empty
    held = once(rows.where(hinted & ~over).withColumn("f", F.concat(*found)), "f")
    return held.select(*rows.columns, F.explode("f").alias("f")).select(*rows.columns, "f.*").withColumn("level", F.lit("error"))
