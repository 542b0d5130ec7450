"""Structured Streaming forms of the detectors and the alert path.

Each takes a streaming frame with a TIMESTAMP column and returns one; the caller writes it. State is bounded by
watermarks or by a timeout for each key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def tumbling(alerts: DataFrame, width: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    return alerts.withWatermark("ts", late).groupBy(F.window("ts", width), "level").agg(F.count("*").alias("n")).select("window.start", "level", "n")


def sessions(alerts: DataFrame, gap: str = "60 seconds", late: str = "1 hour") -> DataFrame:
    """Episodes by array: a row exactly a gap later still belongs to one."""
    held = alerts.withWatermark("ts", late).groupBy("array_id", F.session_window("ts", gap).alias("s"))
    return held.agg(F.count("*").alias("n")).select("array_id", "s.start", "s.end", "n")


def deduplicated(alerts: DataFrame, late: str = "1 hour") -> DataFrame:
    return alerts.withWatermark("ts", late).dropDuplicatesWithinWatermark(["array_id", "observer", "message"])


def storms(alerts: DataFrame, seconds: float = 60, threshold: int = 20, late: str = "1 hour") -> DataFrame:
    """The moment of each array's first storm: threshold alerts within so many seconds.

    Rows may come late: moments are kept in order, and a storm is any stretch of threshold of them that spans no more
    than so long. State holds the moments that a row not yet too late can still meet, those of the watermark's last
    window and after, and goes once the watermark has passed them by an hour; a later storm then counts as a first
    one. An array that has fired keeps no moments.
    """
    width = int(seconds * 1_000_000)

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        moments, fired, newest = (list(state.get[0]), state.get[1], state.get[2]) if state.exists else ([], False, 0)
        for part in parts:
            moments += [int(at.timestamp() * 1_000_000) for at in part["ts"]]
        newest = max([newest, *moments])
        moments.sort()
        hits = []
        if not fired:
            end = next((k for k in range(threshold - 1, len(moments)) if moments[k] - moments[k - threshold + 1] <= width), None)
            if end is not None:
                fired = True
                hits.append((key[0], pd.Timestamp(moments[end], unit="us"), threshold))
        low = state.getCurrentWatermarkMs() * 1000 - width
        moments = [] if fired else [m for m in moments if m >= low]
        state.update((moments, fired, newest))
        state.setTimeoutTimestamp(max(newest // 1000, state.getCurrentWatermarkMs()) + 3_600_000)
        yield pd.DataFrame(hits, columns=["array_id", "ts", "size"])

    held = alerts.withWatermark("ts", late).groupBy("array_id")
    return held.applyInPandasWithState(run, "array_id long, ts timestamp, size long", "recent array<long>, fired boolean, newest long", "append", GroupStateTimeout.EventTimeTimeout)


def counter_deltas(readings: DataFrame, threshold: float = 0, reset: float = 10_000_000, late: str = "1 hour", idle_hours: float = 24) -> DataFrame:
    """Growth of each counter beyond threshold; the first reading is silent and a jump beyond reset starts anew.

    A reading older than the last one taken is passed over. A counter that is silent for idle_hours is forgotten.
    """

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last, seen = state.get if state.exists else (None, -1)
        out = []
        rows = sorted((int(r.ts.timestamp() * 1_000_000), float(r.value), r.ts) for part in parts for r in part.itertuples())
        for us, value, ts in rows:
            if us < seen:
                continue
            if last is not None and threshold < value - last <= reset:
                out.append((key[0], ts, value - last))
            last, seen = value, us
        state.update((last, seen))
        state.setTimeoutTimestamp(max(seen // 1000, state.getCurrentWatermarkMs()) + int(idle_hours * 3_600_000))
        yield pd.DataFrame(out, columns=["key", "ts", "delta"])

    held = readings.withWatermark("ts", late).groupBy("key")
    return held.applyInPandasWithState(run, "key string, ts timestamp, delta double", "last double, seen long", "append", GroupStateTimeout.EventTimeTimeout)


def merging(write: Callable[[DataFrame], None], keys: list[str]) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: the newest row of each key in a batch goes to write."""

    def each(batch: DataFrame, _: int) -> None:
        others = [c for c in batch.columns if c not in keys]
        write(batch.groupBy(*keys).agg(F.max_by(F.struct(*others), "ts").alias("r")).select(*keys, "r.*"))

    return each
