"""Detectors and active issues as stateful processors that take each key's rows in order of time and id.

Rows may come in any order within the watermark. A processor keeps those that a late row can still precede; once the
watermark has passed them they are settled: folded into the key's state in order. So what a stream gives is what the
batch form gives for the same rows, row for row. Detectors give a row's alert when it is settled. Active issues are
given after every batch, as the settled state with the rows not yet settled folded into a copy.

State is bounded: rows not settled are those of the watermark's last stretch, and an event-time timer settles them
without a new row. A key that is silent for idle_hours is forgotten, issues that are still open excepted.
The state store must be RocksDB; use_rocksdb() sets that for a session.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator
from typing import Any, NamedTuple

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from watchgrid.operators import issues
from watchgrid.schema import level_rank

HOUR_MS = 3_600_000
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


def plain(value: Any) -> Any:
    """Structs, which come as dictionaries or rows, as tuples."""
    if isinstance(value, dict):
        return tuple(map(plain, value.values()))
    if isinstance(value, tuple):
        return tuple(map(plain, value))
    return list(map(plain, value)) if isinstance(value, list) else value


class InOrder(StatefulProcessor):
    """Keeps rows (at in microseconds, id, ...) until they are settled. Subclasses fold them and say what goes out.

    Input rows have such a row in the column kept, besides the key and the time that the watermark goes by.
    """

    def __init__(self, row: str, idle_hours: float):
        self.row, self.idle_ms = f"at long, id long, {row}", int(idle_hours * HOUR_MS)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.row)
        self.newest = handle.getValueState("newest", "at long")
        self.open(handle)

    def open(self, handle: StatefulProcessorHandle) -> None:
        raise NotImplementedError

    def out(self, key: tuple, settled: list[tuple], waiting: list[tuple], came: bool) -> Iterator[Row]:
        """Fold settled into the state and give what goes out; came is whether rows came, rather than a timer."""
        raise NotImplementedError

    def forget(self) -> bool:
        """Clear the state of a silent key; False if it must stay."""
        raise NotImplementedError

    def take(self, key: tuple, new: list[tuple], watermark_ms: int) -> Iterator[Row]:
        rows = sorted([plain(r) for r in self.waiting.get()] + new, key=lambda r: r[:2]) if self.waiting.exists() else sorted(new, key=lambda r: r[:2])
        cut = bisect_left(rows, watermark_ms * 1000, key=lambda r: r[0])
        settled, waiting = rows[:cut], rows[cut:]
        if waiting:
            if new or settled:
                self.waiting.put(waiting)
        elif self.waiting.exists():
            self.waiting.clear()
        if rows:
            newest = max(rows[-1][0], self.newest.get()[0] if self.newest.exists() else 0)
            self.newest.update((newest,))
        elif self.newest.exists():
            newest = self.newest.get()[0]
        else:
            return
        yield from self.out(key, settled, waiting, bool(new))
        due = waiting[0][0] // 1000 + 1 if waiting else newest // 1000 + self.idle_ms
        if waiting or due > watermark_ms:
            self.handle.registerTimer(max(due, watermark_ms + 1))
        elif self.forget():
            self.newest.clear()

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        yield from self.take(tuple(key), [plain(r.kept) for r in rows], timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        yield from self.take(tuple(key), [], timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


# Detectors


class Family(NamedTuple):
    """step takes a key's state (None at first) and a row's value and gives the state and what goes out, or None."""

    state: str
    out: str
    step: Callable[[tuple | None, int, Any], tuple[tuple, tuple | None]]


def delta(threshold: float = 0, reset: float = 10_000_000) -> Family:
    """Growth of a counter beyond threshold and up to reset, as detectors.delta()."""

    def step(state: tuple | None, at: int, value: float | None) -> tuple[tuple, tuple | None]:
        before = state[0] if state else None
        grown = value - before if value is not None and before is not None else None
        return (value,), (grown,) if grown is not None and threshold < grown <= reset else None

    return Family("last double", "delta double", step)


def change(down: tuple[str, ...] = (), bad: tuple[str, ...] = ()) -> Family:
    """States that differ from the one before, or are bad, as detectors.change()."""

    def step(state: tuple | None, at: int, now: str | None) -> tuple[tuple, tuple | None]:
        before = state[0] if state else None
        differs = now is not None and before is not None and now != before and (not down or now in down)
        return (now,), (before,) if differs or now is not None and now.lower() in bad else None

    return Family("last string", "previous string", step)


def level(threshold: float, count: int = 1) -> Family:
    """enter, stay and recovered, as detectors.hysteresis(); readings without a value count for nothing."""

    def step(state: tuple | None, at: int, value: float | None) -> tuple[tuple, tuple | None]:
        run = state[0] if state else 0
        if value is None:
            return (run,), None
        if value >= threshold:
            event = "enter" if run + 1 == count else "stay" if run + 1 > count else None
            return (run + 1,), (event,) if event else None
        return (0,), ("recovered",) if run >= count else None

    return Family("run long", "event string", step)


def matched(n: int = 1) -> Family:
    """Rows that end n or more in a row with the flag, as detectors.rolling_all(): with n = 1 classified log lines."""

    def step(state: tuple | None, at: int, flag: bool | None) -> tuple[tuple, tuple | None]:
        run = (state[0] if state else 0) + 1 if flag else 0
        return (run,), (run,) if run >= n else None

    return Family("run long", "run long", step)


def cooled(seconds: float) -> Family:
    """Reports of which none went out within so many seconds before, as detectors.cooled()."""
    limit = int(seconds * 1_000_000)

    def step(state: tuple | None, at: int, value: Any) -> tuple[tuple | None, tuple | None]:
        if state and at - state[0] < limit:
            return state, None
        return (at,), (at,)

    return Family("sent long", "sent long", step)


class Detector(InOrder):
    """One family over one key's readings (at, id, value)."""

    def __init__(self, by: list[str], family: Family, value: str, idle_hours: float):
        super().__init__(f"value {value}", idle_hours)
        self.family, self.result = family, Row(*by, "id", "at", family.out.split()[0])

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", self.family.state)

    def out(self, key: tuple, settled: list[tuple], waiting: list[tuple], came: bool) -> Iterator[Row]:
        state = before = self.held.get() if settled and self.held.exists() else None
        for at, row_id, value in settled:
            state, found = self.family.step(state, at, value)
            if found is not None:
                yield self.result(*key, row_id, at, *found)
        if state is not before:
            self.held.update(tuple(state))

    def forget(self) -> bool:
        self.held.clear()
        return True


def detected(readings: DataFrame, by: list[str], value: str, family: Family, late: str = "1 hour", idle_hours: float = 24) -> DataFrame:
    """by, id, ts and the family's columns for each reading (by, id, ts, value) that alerts, once it is settled."""
    use_rocksdb(readings.sparkSession)
    kinds = dict(readings.dtypes)
    held = readings.withWatermark("ts", late).select(*by, "ts", F.struct(F.unix_micros("ts").alias("at"), F.col("id").cast("long").alias("id"), F.col(value).alias("value")).alias("kept"))
    keys = ", ".join(f"{c} {kinds[c]}" for c in by)
    out = held.groupBy(*by).transformWithState(Detector(by, family, kinds[value], idle_hours), f"{keys}, id long, at long, {family.out}", "Append", "EventTime")
    return out.withColumn("ts", F.timestamp_micros("at")).drop("at")


# Active issues

ISSUE = "struct<key:string,level:string,message:string,since:long,latest:long>"
GONE = "struct<key:string,recovered_at:long>"


class Followed(InOrder):
    """The open issues of one array's observer, and when those that recovered did."""

    def __init__(self, idle_hours: float):
        super().__init__("kind string, items array<struct<key:string,level:string,message:string,since:long>>", idle_hours)

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.issues = handle.getMapState("issues", "key string", "level string, message string, since long, latest long")
        self.gone = handle.getMapState("gone", "key string", "recovered_at long")
        self.version = handle.getValueState("version", "n long")

    @staticmethod
    def fold(held: dict, gone: dict, rows: list[tuple]) -> None:
        for at, _, kind, items in rows:
            if kind == "open":
                key, lv, said, _ = items[0]
                gone.pop(key, None)
                held[key] = (lv, said, held[key][2] if key in held else at, at)
                continue
            new: dict[str, tuple] = {}
            for key, lv, said, since in items if kind == "list" else ():
                old = new.get(key)
                # of one key listed twice the greatest message counts, from the first time on
                new[key] = (lv, said, since, at) if old is None else (*((lv, said) if said > old[1] else old[:2]), min(since, old[2]), at)
            gone.update({key: at for key in held if key not in new})
            for key in new:
                gone.pop(key, None)
            held.clear()
            held.update(new)

    def out(self, key: tuple, settled: list[tuple], waiting: list[tuple], came: bool) -> Iterator[Row]:
        held = {k[0]: tuple(v) for k, v in self.issues.iterator()}
        gone = {k[0]: v[0] for k, v in self.gone.iterator()}
        if settled:
            issues_before, gone_before = dict(held), dict(gone)
            self.fold(held, gone, settled)
            for state, before, now in ((self.issues, issues_before, held), (self.gone, {k: (v,) for k, v in gone_before.items()}, {k: (v,) for k, v in gone.items()})):
                for k in before.keys() - now.keys():
                    state.removeKey((k,))
                for k, v in now.items():
                    if before.get(k) != v:
                        state.updateValue((k,), v)
        if not came:
            return
        self.fold(held, gone, waiting)
        version = (self.version.get()[0] if self.version.exists() else 0) + 1
        self.version.update((version,))
        found = [Row(key=k, level=v[0], message=v[1], since=v[2], latest=v[3]) for k, v in sorted(held.items())]
        yield Row(array_id=key[0], observer=key[1], version=version, issues=found, recoveries=[Row(key=k, recovered_at=v) for k, v in sorted(gone.items())])

    def forget(self) -> bool:
        self.gone.clear()
        if next(iter(self.issues.keys()), None) is not None:
            return False
        self.version.clear()
        return True


def followed(alerts: DataFrame, late: str = "1 hour", idle_hours: float = 24 * 7) -> DataFrame:
    """array_id, observer, version, issues and recoveries whenever a batch has alerts of an array's observer.

    issues and recoveries replace what the version before said; they are what issues.followed() and
    issues.recoveries() find in all alerts taken so far. Alerts later than late allows are passed over.
    """
    use_rocksdb(alerts.sparkSession)
    observer, level_, details = F.col("observer"), F.col("level"), F.col("details")
    items = issues.parts(observer, level_, F.coalesce("message", F.lit("")), details, F.col("ts").cast("timestamp_ntz"), any_level=True)
    items = F.transform(items, lambda p: F.struct(p["key"].alias("key"), p["level"].alias("level"), p["message"].alias("message"), F.unix_micros(p["since"].cast("timestamp")).alias("since")))
    kind = F.when(observer.isin(*issues.LISTING), "list").when(issues.recovered(details), "clear").when((F.size("items") > 0) & (level_rank(level_) >= 1), "open")
    held = alerts.withWatermark("ts", late).where(observer.isin(*issues.OBSERVERS)).withColumn("items", items).withColumn("kind", kind).where("kind is not null")
    held = held.select("array_id", "observer", "ts", F.struct(F.unix_micros("ts").alias("at"), F.col("id").cast("long").alias("id"), "kind", "items").alias("kept"))
    out = held.groupBy("array_id", "observer").transformWithState(
        Followed(idle_hours), f"array_id long, observer string, version long, issues array<{ISSUE}>, recoveries array<{GONE}>", "Update", "EventTime"
    )
    ntz = lambda us: F.timestamp_micros(us).cast("timestamp_ntz")
    found = F.transform("issues", lambda i: F.struct(i["key"].alias("key"), i["level"].alias("level"), i["message"].alias("message"), ntz(i["since"]).alias("since"), ntz(i["latest"]).alias("latest")))
    gone = F.transform("recoveries", lambda r: F.struct(r["key"].alias("key"), ntz(r["recovered_at"]).alias("recovered_at")))
    return out.withColumn("issues", found).withColumn("recoveries", gone)


def current(updates: DataFrame, of: str = "issues") -> DataFrame:
    """The rows of issues, or of recoveries, of the newest version of each array's observer in updates."""
    last = updates.groupBy("array_id", "observer").agg(F.max_by(of, "version").alias("i"))
    return last.select("array_id", "observer", F.explode("i").alias("i")).select("array_id", "observer", "i.*")
