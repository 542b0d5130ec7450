"""Extraction from log lines and command output, as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def checked(spark: SparkSession, pattern: str) -> str | None:
    """What is wrong with a pattern, or None; Spark would fail while it runs."""
    try:
        spark.sparkContext._jvm.java.util.regex.Pattern.compile(pattern)
    except Exception as e:  # py4j wraps whatever the JVM throws
        return str(e).splitlines()[0]
    return None


def find_all(text: Column, pattern: str, groups: int) -> Column:
    """All matches: whole without groups, the group with one, with more all non-empty groups in order of matching."""
    if groups < 2:
        return F.regexp_extract_all(text, F.lit(pattern), F.lit(groups))
    each = [F.regexp_extract_all(text, F.lit(pattern), F.lit(k + 1)) for k in range(groups)]
    zipped = F.arrays_zip(*[e.alias(f"g{k}") for k, e in enumerate(each)])
    return F.filter(F.flatten(F.transform(zipped, lambda z: F.array(*[z[f"g{k}"] for k in range(groups)]))), lambda x: x != "")


def verdict(found: Column, kind: str, expect: bool = True) -> Column:
    """normal or abnormal of a match rule: valid_match, invalid_match or regex_extract."""
    has = F.size(found) > 0
    good = {"valid_match": has == expect, "invalid_match": has != expect, "regex_extract": F.lit(True)}[kind]
    return F.when(good, "normal").otherwise("abnormal")


def lines(text: Column) -> Column:
    return F.split(text, "\r?\n")


def pipe(text: Column, grep: str | None = None, split: str | None = None, index: int = 0, strip: str = "", pattern: str | None = None) -> Column:
    """The steps of a pipe on the first line that is left: grep, split, index (negative from the end), strip, match."""
    held = lines(text)
    if grep:
        held = F.filter(held, lambda x: x.rlike(grep))
    out = F.try_element_at(held, F.lit(1))
    if split:
        out = F.try_element_at(F.split(out, split), F.lit(index + 1 if index >= 0 else index))
    if strip:
        out = F.btrim(out, F.lit(strip))
    if pattern:
        out = F.nullif(F.regexp_extract(out, pattern, 1), F.lit(""))
    return out


def key_value(text: Column, key: str, separator: str | None = None) -> Column:
    """The value of the first line with the key, case aside; = goes before :, comments and blank lines don't count."""
    held = F.filter(lines(text), lambda x: (F.trim(x) != "") & ~F.ltrim(x).startswith("#"))
    at = lambda x: F.lit(separator) if separator else F.when(x.contains("="), F.lit("=")).otherwise(F.lit(":"))
    name = lambda x: F.lower(F.trim(F.split_part(x, at(x), F.lit(1))))
    hit = F.try_element_at(F.filter(held, lambda x: x.contains(at(x)) & (name(x) == key.lower())), F.lit(1))
    where = F.position(F.lit(separator), hit) if separator else F.when(hit.contains("="), F.position(F.lit("="), hit)).otherwise(F.position(F.lit(":"), hit))
    return F.trim(F.substring(hit, where + len(separator or "="), F.length(hit)))


def json_path(text: Column, path: str) -> Column:
    return F.get_json_object(text, path)


def table_cell(text: Column, header: str, row: int = 1, delimiter: str = r"\s+") -> Column:
    """The cell of a text table below the first header that contains the name, case aside."""
    cells = lambda k: F.split(F.trim(F.try_element_at(lines(text), F.lit(k + 1))), delimiter)
    at = F.array_position(F.transform(cells(0), lambda x: F.lower(x).contains(header.lower())), True)
    return F.when(at > 0, F.try_element_at(cells(row), at.cast("int")))


def line_count(text: Column, pattern: str) -> Column:
    return F.size(F.filter(lines(text), lambda x: x.rlike(pattern)))


def first_line(text: Column, pattern: str) -> Column:
    return F.try_element_at(F.filter(lines(text), lambda x: x.rlike(pattern)), F.lit(1))


def moved(now: Column, before: Column, kind: str) -> Column:
    """changed, increased or decreased against the reading before; text that is no number can only be changed."""
    a, b = before.try_cast("double"), now.try_cast("double")
    plain = before.isNotNull() & (now != before)
    test = {"changed": plain, "increased": F.when(a.isNotNull() & b.isNotNull(), b > a).otherwise(plain), "decreased": F.when(a.isNotNull() & b.isNotNull(), b < a).otherwise(plain)}
    return F.coalesce(test[kind], F.lit(False))


def holds(value: Column, operator: str, operand: str) -> Column:
    """One of ten comparisons; numbers where both are, else text. contains is without regard to case."""
    a, b = value.try_cast("double"), F.lit(operand).try_cast("double")
    both = a.isNotNull() & b.isNotNull()
    text = {
        "==": F.when(both, a == b).otherwise(value == operand), "!=": F.when(both, a != b).otherwise(value != operand),
        ">": both & (a > b), ">=": both & (a >= b), "<": both & (a < b), "<=": both & (a <= b),
        "contains": F.lower(value).contains(operand.lower()), "not_contains": ~F.lower(value).contains(operand.lower()),
        "matches": value.rlike(operand) if operator in ("matches", "not_matches") else F.lit(False), "not_matches": ~value.rlike(operand) if operator in ("matches", "not_matches") else F.lit(False),
    }
    return F.coalesce(text[operator], F.lit(False))


def rendered(template: str, **values: Column) -> Column:
    """A message template with {name} for each value."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value.cast("string"), F.lit("")))
    return out


#: What is not shown of a message, and what stands there instead.
SECRETS = (
    (r"(?i)(password\s*[=:]\s*)\S+", "$1***"),
    (r"(?i)(passwd\s*[=:]\s*)\S+", "$1***"),
    (r"(?i)(secret\s*[=:]\s*)\S+", "$1***"),
    (r"(?i)(token\s*[=:]\s*)\S+", "$1***"),
    (r"(?i)(nqn\.[a-zA-Z0-9.\-:]+)", "nqn.***"),
    (r"(?i)(iqn\.[a-zA-Z0-9.\-:]+)", "iqn.***"),
)


def redacted(text: Column, patterns: Sequence[tuple[str, str]] = SECRETS) -> Column:
    for pattern, instead in patterns:
        text = F.regexp_replace(text, pattern, instead)
    return text


def redacted_values(values: Column) -> Column:
    """A map of strings with each value redacted."""
    return F.transform_values(values, lambda _, v: redacted(v))


def masked(value: Column) -> Column:
    """Nothing of up to four characters, else two at either end."""
    return F.when(F.length(value) <= 4, "***").otherwise(F.concat(F.left(value, F.lit(2)), F.lit("***"), F.right(value, F.lit(2))))


def safe_number(value: Column, default: float) -> Column:
    return F.coalesce(value.try_cast("double"), F.lit(default))


def safe_int(value: Column, default: int) -> Column:
    return F.coalesce(F.trim(value).try_cast("bigint"), F.lit(default).cast("bigint"))


#: The forms of a time in a log line, the first that matches counts.
STAMPS = (r"(\d{4}-\d{2}-\d{2}\s+\d{2}:\d{2}:\d{2})", r"([A-Z][a-z]{2}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2})", r"\[(\d+\.\d+)\]")


def stamp(line: Column) -> Column:
    """The first time in a line, in one of three formats, as text."""
    return F.coalesce(*[F.nullif(F.regexp_extract(line, p, 1), F.lit("")) for p in STAMPS])


def pairs(text: Column, separators: str = "=:") -> Column:
    """Keys and values of the lines that have a separator, as a map; the first separator that a line has splits it.

    Of lines with one key the last counts.
    """
    held = F.filter(lines(text), lambda x: x.rlike(f"[{separators}]"))
    order = list(separators)

    def at(x: Column) -> Column:
        out = F.position(F.lit(order[-1]), x)
        for s in reversed(order[:-1]):
            out = F.when(x.contains(s), F.position(F.lit(s), x)).otherwise(out)
        return out

    entries = F.transform(held, lambda x: F.struct(F.trim(F.substring(x, F.lit(1), at(x) - 1)).alias("key"), F.trim(F.substring(x, at(x) + 1, F.length(x))).alias("value")))
    entries = F.filter(entries, lambda e: e["key"] != "")
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda f: f["key"] == e["key"]))
    return F.map_from_entries(last)


def parsed(text: Column, kind: str) -> Column:
    """A command's output as a map: json by its members, key_value by lines split at =, : or tab, else raw as a whole.

    What should be JSON and isn't is raw too.
    """
    body = F.trim(text)
    raw = F.create_map(F.lit("raw"), body)
    if kind == "json":
        return F.coalesce(F.from_json(F.when(F.try_parse_json(body).isNotNull(), body), "map<string,string>"), raw)
    return pairs(body, "=:\t") if kind == "key_value" else raw


def fields(text: Column, patterns: dict[str, str], groups: int = 1) -> Column:
    """All matches of each named pattern, as a map of lists."""
    return F.map_from_arrays(F.array(*[F.lit(n) for n in patterns]), F.array(*[find_all(text, p, groups) for p in patterns.values()]))


def condition(value: Column, found: Column, operator: str, operand: str = "") -> Column:
    """A monitor's condition: found, not_found, gt, lt, eq or ne; a missing value counts as 0 among numbers."""
    a, b = F.coalesce(value, F.lit("0")).try_cast("double"), F.lit(operand).try_cast("double")
    tests = {"found": found, "not_found": ~found, "gt": a > b, "lt": a < b, "eq": F.when(a.isNotNull() & b.isNotNull(), a == b).otherwise(value == operand), "ne": F.when(a.isNotNull() & b.isNotNull(), a != b).otherwise(value != operand)}
    return F.coalesce(tests[operator], F.lit(False))


def slot_key(bus: Column) -> Column:
    """A bus address without leading zeros in its parts, and without what stands before a colon."""
    return F.array_join(F.transform(F.split(F.regexp_replace(F.trim(bus), r"[()]|^.*:", ""), r"\."), lambda p: F.coalesce(p.try_cast("int").cast("string"), p)), ".")


def blocked(name: Column, words: Sequence[str]) -> Column:
    """Whether a name holds one of the words, case aside."""
    return F.exists(F.array(*[F.lit(w.lower()) for w in words]), lambda w: F.lower(name).contains(w)) if words else F.lit(False)
