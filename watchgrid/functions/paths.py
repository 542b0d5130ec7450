"""JSONPath over text columns: first or all matches, list indexes from either end, wildcards and recursive descent.

A text is parsed once into a VARIANT; each step of a path maps an array of nodes to the array of those that it leads
to, so a path is one expression over arrays of VARIANTs and stays in the JVM. Matches of a recursive step come by
depth, and within a depth in order. An object's members come in order of name, as VARIANT holds them.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

STEP = re.compile(r"(?P<deep>\.\.)?\.?(?:\[\s*(?:(?P<index>-?\d+)|(?P<all>\*)|'(?P<single>[^']*)'|\"(?P<double>[^\"]*)\")\s*\]|(?P<star>\*)|(?P<name>[^.\[\]*'\"]+))")
NODES = "array<variant>"


def steps(path: str) -> list[tuple[bool, str, str | int | None]]:
    """(recursive, kind, name or index) for each step of a path; kind is member, index or any."""
    rest, out = path.strip(), []
    at = 1 if rest.startswith("$") else 0
    while at < len(rest):
        m = STEP.match(rest, at)
        if not m or m.end() == at:
            raise ValueError(f"no JSON path: {path}")
        name = next((m[g] for g in ("single", "double", "name") if m[g] is not None), None)
        kind = ("index", int(m["index"])) if m["index"] is not None else ("member", name) if name is not None else ("any", None)
        out.append((bool(m["deep"]), *kind))
        at = m.end()
    return out


def _items(x: Column) -> Column:
    return F.try_variant_get(x, "$", NODES)


def _members(x: Column) -> Column:
    return F.try_variant_get(x, "$", "map<string,variant>")


def _children(x: Column) -> Column:
    return F.coalesce(_items(x), F.map_values(_members(x)), F.array().cast(NODES))


def _index(x: Column, k: int) -> Column:
    return F.try_element_at(_items(x), F.lit(k + 1 if k >= 0 else k))


def _descendants(nodes: Column, depth: Column) -> Column:
    """The nodes and all below them; depth is no less than how deep they go."""
    start = F.struct(nodes.alias("seen"), nodes.alias("last"))

    def deeper(held: Column, _: Column) -> Column:
        below = F.flatten(F.transform(held["last"], _children))
        return F.struct(F.concat(held["seen"], below).alias("seen"), below.alias("last"))

    return F.reduce(F.sequence(F.lit(1), depth), start, deeper, lambda held: held["seen"])


def _named(x: Column, name: str) -> Column:
    return F.map_values(F.map_filter(F.coalesce(_members(x), F.create_map().cast("map<string,variant>")), lambda k, _: k == F.lit(name)))


def _walk(text: Column, path: list[tuple[bool, str, str | int | None]]) -> Column:
    found = F.array_compact(F.array(F.try_parse_json(text)))
    # every level that a text goes down opens a bracket
    depth = F.greatest(F.lit(1), F.length(text) - F.length(F.translate(text, "{[", "")))
    for deep, kind, name in path:
        if deep:
            found = _descendants(found, depth)
        found = F.flatten(_each(found, kind, name))
    return found


def _each(found: Column, kind: str, name: str | int | None) -> Column:
    """What a step makes of each node, as arrays."""
    if kind == "member":
        return F.transform(found, lambda x: _named(x, name))
    if kind == "index":
        return F.transform(found, lambda x: F.array_compact(F.array(_index(x, name))))
    if kind == "either":  # an index into a list, a name in an object
        return F.transform(found, lambda x: F.when(_items(x).isNotNull(), F.array_compact(F.array(_index(x, int(name))))).otherwise(_named(x, name)))
    return F.transform(found, _children)


def nodes(text: Column, path: str) -> Column:
    """The nodes of a JSON text that a path leads to, as an array of VARIANTs; text that is no JSON has none."""
    return _walk(text, steps(path))


def as_text(node: Column) -> Column:
    """A node as text: strings bare, else as JSON."""
    return F.when(F.schema_of_variant(node) == "STRING", F.try_variant_get(node, "$", "string")).otherwise(F.to_json(node))


def all_matches(text: Column, path: str) -> Column:
    return F.transform(nodes(text, path), as_text)


def first_match(text: Column, path: str) -> Column:
    return F.try_element_at(all_matches(text, path), F.lit(1))


def nested(text: Column, field: str) -> Column:
    """The value at a dotted field name, where a number is an index into a list; null where a step leads nowhere."""
    if not field:
        return F.lit(None).cast("string")
    path = [(False, "either" if p.isdigit() else "member", p) for p in field.split(".")]
    return F.try_element_at(F.transform(_walk(text, path), as_text), F.lit(1))
