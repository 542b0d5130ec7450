"""Greedy rules whose step depends on the step before, as passes over rows in order.

Rows are dealt by key, sorted within their partition by key, time and id, and streamed through a function that holds
only the last state. Nothing of a key is gathered: a key with very many rows takes one task's time for its own rows
and no more memory than a batch. Sorting spills. Rows without a time are left out.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from watchgrid.schema import micros
from watchgrid.scratch import written

#: Rows of a key beyond which it is cut, rows of a slice, and the unit of time that is never cut, in microseconds.
SLICE, UNIT = 1_000_000, 60_000_000

#: (state or None, microseconds of a key's next rows, other columns of them) -> (result for each row, state)
Step = Callable[[Any, np.ndarray, dict[str, np.ndarray]], tuple[np.ndarray, Any]]


def key_starts(batch: pa.RecordBatch, by: Sequence[str]) -> np.ndarray:
    """Whether each row but the first has another key than the row before; nulls equal nulls."""
    new = np.zeros(len(batch) - 1, bool)
    for c in by:
        a, b = batch.column(c).slice(1), batch.column(c).slice(0, len(batch) - 1)
        differs = pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False)
        new |= differs | (a.is_null().to_numpy(zero_copy_only=False) != b.is_null().to_numpy(zero_copy_only=False))
    return new


def ordered_pass(rows: DataFrame, by: Sequence[str], step: Step, result: str, kind: T.DataType, using: Sequence[str] = (), order: Sequence[str] = ("ts", "id")) -> DataFrame:
    """rows with a column that step finds for them, key by key in order; using are the columns that it sees."""
    schema = T.StructType([*rows.schema.fields, T.StructField(result, kind)])
    out_type = {"bigint": pa.int64(), "boolean": pa.bool_()}[kind.simpleString()]
    names = rows.columns
    held = rows.where(F.col("ts").isNotNull()).withColumn("_us", micros(F.col("ts")))

    def given(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[pa.RecordBatch]:
        for batch, found, _ in stepped(batches, keys, step, using):
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(found, out_type)], [*names, result])

    plain = lambda some: some.repartition(*by).sortWithinPartitions(*by, *order).mapInArrow(lambda batches: given(batches, by), schema)
    key = F.to_json(F.struct(*by)).alias("_key")  # nulls are told from values
    large = held.groupBy(*by).agg(F.count("*").alias("_n")).where(F.col("_n") > SLICE).select(key)
    if large.isEmpty():
        return plain(held)
    large = written(large, "large")
    marked = held.withColumn("_key", F.to_json(F.struct(*by)))
    sliced = ["_key", "_slice"]
    hot = slices(marked.join(large, "_key", "left_semi"), SLICE, UNIT)
    begun = begin_states(hot, step, using, order)
    rest = plain(marked.join(large, "_key", "left_anti").drop("_key"))
    cut = hot.join(begun, sliced, "left").repartition(*sliced).sortWithinPartitions(*sliced, *order)
    return rest.unionByName(cut.mapInArrow(lambda batches: given(batches, sliced), schema))


def stepped(batches: Iterator[pa.RecordBatch], by: Sequence[str], step: Step, using: Sequence[str]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, list[tuple[int, Any]]]]:
    """Each batch with the step's results for its rows, and (place of a key's last row, state there) for each of its
    keys. A column _state has the state that a key begins with, as JSON."""
    state, last = None, None
    for batch in batches:
        if not len(batch):
            continue
        us = batch.column("_us").to_numpy()
        seen = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in using}
        begins = batch.column("_state").to_pylist() if "_state" in batch.schema.names else None
        first = tuple(batch.column(c)[0].as_py() for c in by)
        cuts = [0, *(np.flatnonzero(key_starts(batch, by)) + 1).tolist(), len(batch)]
        found, ends = [], []
        for a, b in zip(cuts, cuts[1:]):
            if a or first != last:
                state = as_state(begins[a]) if begins else None
            part, state = step(state, us[a:b], {c: v[a:b] for c, v in seen.items()})
            found.append(part)
            ends.append((b - 1, state))
        last = tuple(batch.column(c)[len(batch) - 1].as_py() for c in by)
        yield batch, np.concatenate(found), ends


def as_state(text: str | None) -> Any:
    state = json.loads(text) if text else None
    return tuple(state) if isinstance(state, list) else state


def slices(rows: DataFrame, size: int, unit: int) -> DataFrame:
    """rows as a written table with _slice, which rises with time by _key; a slice has about size rows."""
    held = rows.withColumn("_unit", F.expr(f"_us div {unit}"))
    before = F.coalesce(F.sum("_c").over(W.partitionBy("_key").orderBy("_unit").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    cuts = held.groupBy("_key", "_unit").agg(F.count("*").alias("_c")).select("_key", "_unit", F.floor(before / size).cast("int").alias("_slice"))
    return written(held.join(cuts, ["_key", "_unit"]).drop("_unit"), "slices")


def begin_states(hot: DataFrame, step: Step, using: Sequence[str], order: Sequence[str]) -> DataFrame:
    """_key, _slice and _state, with which each slice begins."""
    keys = ["_key", "_slice"]

    def ended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting = None
        for batch, _, ends in stepped(batches, keys, step, using):
            rows = [(batch.column("_key")[at].as_py(), batch.column("_slice")[at].as_py(), json.dumps(state, default=float)) for at, state in ends]
            if waiting is not None and waiting[:2] != rows[0][:2]:
                rows.insert(0, waiting)
            waiting = rows.pop()
            yield pa.RecordBatch.from_pylist([dict(zip(("_key", "_slice", "_end"), r)) for r in rows], STATES)
        if waiting is not None:
            yield pa.RecordBatch.from_pylist([dict(zip(("_key", "_slice", "_end"), waiting))], STATES)

    before = F.lag("_end").over(W.partitionBy("_key").orderBy("_slice"))
    known = None  # _key, _slice, _state and _end of each slice as it ran last
    todo = hot.select(*keys).distinct().withColumn("_state", F.lit(None).cast("string"))
    while True:
        some = hot.select(*dict.fromkeys((*keys, "_us", *using, *order))).join(todo, keys)
        ends = some.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(ended, "_key string, _slice int, _end string")
        ran = todo.join(ends, keys)
        known = written(ran if known is None else ran.unionByName(known.join(todo, keys, "left_anti")), "states")
        held = known.withColumn("_next", before)
        todo = written(held.where(~F.col("_next").eqNullSafe(F.col("_state"))).select(*keys, F.col("_next").alias("_state")), "changed")
        if todo.isEmpty():
            return known.select(*keys, "_state")


STATES = pa.schema([("_key", pa.string()), ("_slice", pa.int32()), ("_end", pa.string())])


def anchors(seconds: float) -> Step:
    """The time of each row's anchor: the first row, then each first row later than its anchor by more than so long."""
    limit = int(seconds * 1_000_000)

    def step(anchor: int | None, us: np.ndarray, _: dict[str, np.ndarray]) -> tuple[np.ndarray, int]:
        out, at = np.empty(len(us), np.int64), 0
        if anchor is None:
            anchor = int(us[0])
        while at < len(us):
            end = at + int(np.searchsorted(us[at:], anchor + limit, "right"))
            out[at:end] = anchor
            at = end
            if at < len(us):
                anchor = int(us[at])
        return out, anchor

    return step


def cooldown(seconds: float, sticky: str | None = None) -> Step:
    """Whether each row goes out: none did within so long before it, or it is sticky; what goes out counts either way."""
    limit = int(seconds * 1_000_000)

    def step(sent: int | None, us: np.ndarray, seen: dict[str, np.ndarray]) -> tuple[np.ndarray, int | None]:
        out = np.zeros(len(us), bool)
        stuck = np.flatnonzero(seen[sticky].astype(bool)) if sticky else np.empty(0, np.int64)
        at, s = 0, 0
        while at < len(us):
            free = at if sent is None else at + int(np.searchsorted(us[at:], sent + limit, "left"))
            s += int(np.searchsorted(stuck[s:], at, "left"))
            nxt = min(free, int(stuck[s]) if s < len(stuck) else len(us))
            if nxt >= len(us):
                break
            out[nxt], sent, at = True, int(us[nxt]), nxt + 1
        return out, sent

    return step


def gate(n: int, seconds: float, flag: str) -> Step:
    """Whether each check fires: the n-th in a row or later that holds, once so long has passed since it last did."""
    limit = int(seconds * 1_000_000)

    def step(state: tuple[int, int | None] | None, us: np.ndarray, seen: dict[str, np.ndarray]) -> tuple[np.ndarray, tuple[int, int | None]]:
        run, last = state or (0, None)
        out = np.zeros(len(us), bool)
        for k, (t, holds) in enumerate(zip(us.tolist(), seen[flag].tolist())):
            run = run + 1 if holds else 0
            if run >= n and (last is None or t - last >= limit):
                out[k], last, run = True, t, 0
        return out, (run, last)

    return step


def throttle(seconds: float, value: str) -> Step:
    """Whether each update goes out: so long after the last that did, and of another value than that."""
    limit = int(seconds * 1_000_000)

    def step(state: tuple[int, Any] | None, us: np.ndarray, seen: dict[str, np.ndarray]) -> tuple[np.ndarray, tuple[int, Any] | None]:
        out = np.zeros(len(us), bool)
        for k, (t, v) in enumerate(zip(us.tolist(), seen[value].tolist())):
            if state is None or t - state[0] >= limit and v != state[1]:
                out[k], state = True, (t, v)
        return out, state

    return step
