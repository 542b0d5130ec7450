"""Causal episodes: gap sessions, mined cause and effect pairs, scored rules, and an episode's graph."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from watchgrid.schema import micros


def split(alerts: DataFrame, gap_seconds: float = 60, by: str = "array_id") -> DataFrame:
    """alerts with episode, numbered from 1 by array: a gap longer than gap_seconds begins a new one."""
    order = W.partitionBy(by).orderBy("us", "id")
    held = alerts.where("ts is not null").withColumn("us", micros(F.col("ts")))
    begins = F.coalesce((F.col("us") - F.lag("us").over(order) > int(gap_seconds * 1_000_000)).cast("int"), F.lit(1))
    return held.withColumn("begins", begins).withColumn("episode", F.sum("begins").over(order)).drop("us", "begins")


def firsts(episodes: DataFrame, by: str = "array_id") -> DataFrame:
    """The earliest alert of each observer in each episode, with its place in order; ties by id."""
    first = episodes.groupBy(by, "episode", "observer").agg(F.min(F.struct("ts", "id")).alias("f")).select(by, "episode", "observer", "f.ts", "f.id")
    return first.withColumn("place", F.row_number().over(W.partitionBy(by, "episode").orderBy("ts", "id")))


def pairs(episodes: DataFrame, by: str = "array_id") -> DataFrame:
    """Ordered pairs of an episode's observers, with the lag in seconds; equal times give lag zero."""
    return paired(firsts(episodes, by), by)


def paired(first: DataFrame, by: str = "array_id") -> DataFrame:
    """pairs() of firsts(): the observers of an episode are put in order in one array, and each goes with those after.

    An episode has one row for each observer, so the array stays within their number; one shuffle serves all.
    """
    each = first.groupBy(by, "episode").agg(F.array_sort(F.collect_list(F.struct("place", "ts", "observer"))).alias("o"))
    held = each.select(by, "episode", "o", F.explode("o").alias("a")).select(by, "episode", "a", F.explode(F.slice("o", F.col("a.place") + 1, F.size("o"))).alias("b"))
    lag = (micros(F.col("b.ts")) - micros(F.col("a.ts"))) / 1_000_000
    return held.select(by, "episode", F.col("a.observer").alias("antecedent"), F.col("b.observer").alias("consequent"), lag.alias("lag_s"))


def rules(alerts: DataFrame, gap_seconds: float = 60, min_count: int = 2, min_confidence: float = 0.15, by: str = "array_id") -> DataFrame:
    """By array the pairs seen min_count times or more: their share of the antecedent's episodes and mean lag.

    An array with one alert only has no pair, so it needs no test of its own.
    """
    return scored(firsts(split(alerts, gap_seconds, by), by), min_count, min_confidence, by)


def scored(first: DataFrame, min_count: int = 2, min_confidence: float = 0.15, by: str = "array_id") -> DataFrame:
    """rules() of firsts()."""
    held = first.groupBy(by, F.col("observer").alias("antecedent")).agg(F.count("*").alias("episodes"))
    found = paired(first, by).groupBy(by, "antecedent", "consequent").agg(F.count("*").alias("n"), F.avg("lag_s").alias("lag"))
    out = found.where(F.col("n") >= min_count).join(held, [by, "antecedent"]).withColumn("c", F.col("n") / F.col("episodes")).where(F.col("c") >= min_confidence)
    return out.select(by, "antecedent", "consequent", "n", F.round("lag", 2).alias("avg_lag_s"), F.round("c", 3).alias("confidence"))


def edges(first: DataFrame, known: DataFrame, by: str = "array_id") -> DataFrame:
    """Edges of each episode by known rules: both observers there, the cause strictly earlier."""
    held = paired(first, by).where("lag_s > 0")
    return held.join(known.select(by, "antecedent", "consequent"), [by, "antecedent", "consequent"], "left_semi").select(by, "episode", "antecedent", "consequent")


def roles(episodes: DataFrame, known: DataFrame, by: str = "array_id") -> DataFrame:
    """What each observer of an episode is by the rules that hold there.

    Without an edge in the episode all are isolated; else an observer that another caused is a consequence, and any
    other a root.
    """
    return roles_of(firsts(episodes, by), known, by)


def roles_of(first: DataFrame, known: DataFrame, by: str = "array_id") -> DataFrame:
    """roles() of firsts()."""
    effects = edges(first, known, by).groupBy(by, "episode").agg(F.collect_set("consequent").alias("effects"))
    held = first.select(by, "episode", "observer").join(effects, [by, "episode"], "left")
    role = F.when(F.col("effects").isNull(), "isolated").when(F.array_contains("effects", F.col("observer")), "consequence").otherwise("root")
    return held.select(by, "episode", "observer", role.alias("role"))


def tree(first: DataFrame, known: DataFrame, by: str = "array_id") -> DataFrame:
    """Each episode's observers as a forest: role, parent, depth, and whether what follows hangs on this row.

    From each root in order of name, depth first, children in order of name. An observer that several others cause
    stands under each of them, and what it causes hangs where the walk comes to it first. An episode has one row for
    each observer and goes through one call.
    """
    nodes = first.select(by, "episode", "observer", F.lit(None).cast("string").alias("effect"))
    all_rows = nodes.unionByName(edges(first, known, by).select(by, "episode", F.col("antecedent").alias("observer"), F.col("consequent").alias("effect")))
    grouped = all_rows.groupBy(by, "episode").agg(F.collect_set("observer").alias("observers"), F.array_compact(F.collect_list(F.when(F.col("effect").isNotNull(), F.struct("observer", "effect")))).alias("edges"))

    @F.arrow_udf("array<struct<observer:string,role:string,parent:string,depth:int,expanded:boolean>>")
    def forest(observers: pa.Array, edge_lists: pa.Array) -> pa.Array:
        return pa.array([walked(names, [(e["observer"], e["effect"]) for e in found or []]) for names, found in zip(observers.to_pylist(), edge_lists.to_pylist())], FOREST)

    return grouped.select(by, "episode", F.explode(forest("observers", "edges")).alias("n")).select(by, "episode", "n.*")


FOREST = pa.list_(pa.struct([("observer", pa.string()), ("role", pa.string()), ("parent", pa.string()), ("depth", pa.int32()), ("expanded", pa.bool_())]))


def walked(names: list[str], found: list[tuple[str, str]]) -> list[dict]:
    """The forest of one episode; without recursion, so that a long chain is as good as a short one."""
    row = lambda name, role, parent, depth, expanded: {"observer": name, "role": role, "parent": parent, "depth": depth, "expanded": expanded}
    if not found:
        return [row(n, "isolated", None, 0, False) for n in sorted(names)]
    children: dict[str, list[str]] = {}
    for a, b in found:
        children.setdefault(a, []).append(b)
    out, seen, caused = [], set(), {b for _, b in found}
    for root in sorted(set(names) - caused):
        stack: list[tuple[str, str | None, int]] = [(root, None, 0)]
        while stack:
            name, parent, depth = stack.pop()
            out.append(row(name, "consequence" if depth else "root", parent, depth, name not in seen))
            if name not in seen:
                seen.add(name)
                stack += [(c, name, depth + 1) for c in sorted(set(children.get(name, [])), reverse=True)]
    return out + [row(n, "isolated", None, 0, False) for n in sorted(set(names) - seen)]


def listed(found: DataFrame, min_confidence: float, limit: int = 500) -> DataFrame:
    return found.where(F.col("confidence") >= min_confidence).orderBy(F.desc("confidence"), "array_id", "antecedent", "consequent").limit(limit)
