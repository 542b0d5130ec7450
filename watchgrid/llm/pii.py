"""Operator 4: personal data by gradient-boosted trees over candidate spans.

All of it is DataFrame functions. Base patterns give spans that always stand. Beside them, generators of high
recall propose spans that look like an address or a number at all, overlapping the base spans and each other:
tokens around an at sign, addresses with "at" and "dot" spelled or bracketed, four numbers with dots between them
in brackets or spaces, and of each run of digits and separators all windows of whole digit groups with 7 to 19
digits. A candidate is described by its format and by what stands around it.

Small boosted trees, one model a kind, learn what the base patterns can't say: their examples are variants of the
base spans in the contexts where those stand (an address spelled out, a phone number without its plus, a card split
otherwise, an address of four numbers in brackets), look-alikes made of the same spans (versions, dates, measures,
order numbers, digits within a code), and the runs of the corpus that no base span meets, as they are. A fifth of
the base spans, by hash, with all that is made of them, is held out: there, with the corpus's own runs, the
threshold of each kind is set, as low as lots of equal score beyond it are right nine times in ten. Candidates
beyond it are added unless they overlap a base span; of added spans of a kind that overlap, the one that scores
higher stays.

The trees are fitted to distinct candidate descriptions with their counts, up to about CELLS of each kind, chosen by
hash; then they become CASE expressions in the plan, and thresholds are set by all descriptions. Places in a text
come from the lengths of matches and of what stands between them; sums, maxima and minima along a text are taken in
blocks, so a text with many matches takes time in proportion to them.

Defined results: a null text is empty and has no spans. Repeated rows and null ids give a row each. Extra columns
are ignored by the query and kept by redact(). Without any base spans nothing is learnt and nothing is added.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from watchgrid.llm.common import materialize, table

KINDS = ("email", "ip", "card", "phone")
#: Equal in what they match to the plain patterns; possessive and anchored at the start of a run, so that no text
#: takes more than linear time.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A quick test of the whole text for each pattern.
NEEDS = {"email": "@", "ip": ".", "card": "", "phone": "+"}
AT, DOT = r"(?:@|[\x20]?[(\[{<]?[\x20]?(?:at|AT)[\x20]?[)\]}>]?[\x20]?)", r"(?:\.|[\x20]?[(\[{][\x20]?\.[\x20]?[)\]}][\x20]?|[\x20]?[(\[{]?[\x20]?(?:dot|DOT)[\x20]?[)\]}]?[\x20]?)"
GENERATORS = {
    "address": r"(?<![^\s@<>(),;:\x22'\[\]])[^\s@<>(),;:\x22'\[\]]++@[^\s@<>(),;:\x22'\[\]]*[^\s@<>(),;:\x22'\[\].!?]",
    "spelled": rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++{AT}[A-Za-z0-9-]++(?:{DOT}[A-Za-z0-9-]++)++",
    "octets": r"(?<![0-9.])[0-9]{1,3}(?:[\x20]?[(\[]?[\x20]?\.[\x20]?[)\]]?[\x20]?[0-9]{1,3}){3}(?![0-9])",
    "number": r"(?<![0-9])[+(]?[0-9](?:[\x20()./-]{0,2}[0-9]){6,}+",
}
#: A quick test of the whole text for the generators that few texts need.
NEEDS |= {"spelled": r"[(\[{<][\x20]?(?:at|AT)|(?:dot|DOT)[\x20)\]}]|[)\]}][\x20]?[A-Za-z0-9-]+[\x20]?[(\[{][\x20]?(?:\.|dot|DOT)", "octets": r"[0-9][\x20]?[(\[][\x20]?\.|[0-9][\x20]\.|[0-9]\.[\x20][0-9]", "address": "@"}
#: What stands between two groups of digits of one number, and how many digits a number has.
GAP, DIGITS = r"^[\x20()./-]{0,2}$", (7, 19)
GENERATED = {"address": ("email",), "spelled": ("email",), "octets": ("ip",), "number": ("card", "phone")}
#: Words before a span, by what they announce.
CONTEXT = {1: r"(?:phone|tel|call|fax|mobile|cell)", 2: r"(?:e-?mail|contact|write)", 3: r"(?:card|visa|credit|payment|account)", 4: r"(?:ip|host|server|addr|address)", 5: r"(?:version|ver|isbn|id|no|ref|order)"}
BLOCK, CELLS, ROUNDS, RATE, PRECISION = 256, 20_000, 12, 0.5, 0.9
FEATURES = ("f_digits", "f_groups", "f_first", "f_last", "f_dots", "f_dashes", "f_spaces", "f_round", "f_square", "f_octets", "f_luhn", "f_before", "f_after", "f_context", "f_size", "f_at", "f_dot", "f_whole")

Rows = list[tuple[tuple[int, ...], int, int]]  # features, positives, all


def digits_of(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(m: Column) -> Column:
    """Whether the digits of m pass Luhn's check."""
    each = F.regexp_extract_all(F.reverse(digits_of(m)), F.lit("[0-9]"), F.lit(0))
    worth = F.transform(each, lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise((c.cast("int") * 2) % 10 + F.floor(c.cast("int") * 2 / 10).cast("int")))
    return F.aggregate(worth, F.lit(0), lambda a, b: a + b) % 10 == 0


def octets(m: Column) -> Column:
    return F.forall(F.split(m, r"\."), lambda p: F.regexp_replace(p, "^0+(?=.)", "").rlike("^(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))


OK: dict[str, Callable[[Column], Column]] = {
    "email": lambda m: F.lit(True),
    "ip": octets,
    "card": lambda m: F.when(F.length(digits_of(m)).between(16, 19), luhn(m)).otherwise(False),
    "phone": lambda m: F.length(digits_of(m)).between(8, 15),
}


def passing(kind: str) -> Callable[[Column], Column]:
    return lambda x: OK[kind](x["m"])


def named(kind: str) -> Callable[[Column], Column]:
    """A span as kind:start:end."""
    return lambda x: F.concat_ws(":", F.lit(kind), x["start"].cast("string"), x["stop"].cast("string"))


def tagged(kind: str) -> Callable[[Column], Column]:
    return lambda x: F.struct(x["start"], x["stop"], F.lit(kind.upper()).alias("kind"))


def running(df: DataFrame, columns: dict[str, str], op: Callable[[Column, Column], Column], start: int) -> DataFrame:
    """df with an array for each column of longs: at each place what op makes of all values up to it, start first.

    In blocks: within each, and then of each block's last with all before, so that no array grows step by step
    beyond a block or the number of blocks.
    """
    none, first = F.array().cast("array<bigint>"), F.lit(start).cast("long")

    def within(part: Column) -> Column:
        return F.aggregate(part, none, lambda acc, v: F.concat(acc, F.array(op(F.coalesce(F.try_element_at(acc, F.lit(-1)), first), v))))

    def cut(values: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / BLOCK).cast("int")), lambda b: within(F.slice(values, b * BLOCK + 1, F.lit(BLOCK))))

    df = df.withColumns({f"_b_{out}": F.when(F.size(c) > 0, cut(F.col(c))).otherwise(F.array().cast("array<array<bigint>>")) for out, c in columns.items()})
    df = df.withColumns({f"_o_{out}": F.aggregate(f"_b_{out}", F.array(first), lambda acc, part: F.concat(acc, F.array(op(F.element_at(acc, -1), F.element_at(part, -1))))) for out in columns})
    whole = {out: F.flatten(F.zip_with(f"_b_{out}", F.slice(f"_o_{out}", F.lit(1), F.size(f"_b_{out}")), lambda part, at: F.transform(part, lambda v: op(at, v)))) for out in columns}
    return df.withColumns(whole).drop(*(f"_{k}_{out}" for k in "bo" for out in columns))


def located(df: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """df with an array at_<name> of structs (start, stop, m, before, after) of all matches, for each pattern.

    start and stop count code points from 0, stop is exclusive; before and after are the text between matches, cut
    to what stands next to the match.
    """
    names = list(patterns)
    need = {n: F.col("text").contains(NEEDS[n]) if len(NEEDS.get(n, "")) == 1 else F.col("text").rlike(NEEDS.get(n) or "[0-9]") for n in names}
    none = F.array().cast("array<string>")
    df = df.withColumns({f"m_{n}": F.when(need[n], F.regexp_extract_all("text", F.lit(patterns[n]), F.lit(0))).otherwise(none) for n in names})
    df = df.withColumns({f"g_{n}": F.when(F.size(f"m_{n}") > 0, F.split("text", patterns[n], -1)).otherwise(none) for n in names})
    df = df.withColumns({f"s_{n}": F.zip_with(f"g_{n}", f"m_{n}", lambda g, m: (F.length(g) + F.coalesce(F.length(m), F.lit(0))).cast("long")) for n in names})

    df = running(df, {f"p_{n}": f"s_{n}" for n in names}, lambda a, b: a + b, 0)

    def spans(n: str) -> Column:
        gaps = F.col(f"g_{n}")
        rows = F.arrays_zip(F.col(f"m_{n}").alias("m"), F.slice(gaps, F.lit(1), F.size(f"m_{n}")).alias("g"), F.slice(gaps, F.lit(2), F.size(f"m_{n}")).alias("h"), F.slice(F.concat(F.array(F.lit(0).cast("long")), f"p_{n}"), F.lit(1), F.size(f"m_{n}")).alias("p"))
        one = lambda x: F.struct((x["p"] + F.length(x["g"])).alias("start"), (x["p"] + F.length(x["g"]) + F.length(x["m"])).alias("stop"), x["m"].alias("m"), F.substring(x["g"], -20, 20).alias("before"), F.substring(x["h"], 1, 1).alias("after"))
        return F.when(F.size(f"m_{n}") > 0, F.transform(rows, one)).otherwise(F.array().cast("array<struct<start:bigint,stop:bigint,m:string,before:string,after:string>>"))

    df = df.withColumns({f"at_{n}": spans(n) for n in names})
    return df.drop(*(f"{k}_{n}" for k in "mgsp" for n in names))


def most(value: Column, cap: int) -> Column:
    return F.least(value, F.lit(cap)).cast("int")


def describe(c: Column) -> list[Column]:
    """The FEATURES of a candidate."""
    m, count = c["m"], lambda pattern: F.length(c["m"]) - F.length(F.regexp_replace(c["m"], pattern, ""))
    runs = F.regexp_extract_all(m, F.lit("[0-9]+"), F.lit(0))
    edge = lambda s: F.when(s.rlike(r"[\p{L}_]$"), 1).when(s.rlike("[0-9]$"), 2).when(s.rlike(r"[^\s]$"), 3).otherwise(0)
    plain = F.regexp_replace(m, r"[\x20()\[\]]", "")
    said = F.lower(c["before"])
    context = F.lit(0)
    for k, words in CONTEXT.items():
        context = F.when(said.rlike(rf"(?:^|[^a-z]){words}[^a-z0-9]*$"), k).otherwise(context)
    values = {
        "f_digits": most(F.length(digits_of(m)), 24),
        "f_groups": most(F.size(runs), 7),
        "f_first": most(F.length(F.coalesce(F.try_element_at(runs, F.lit(1)), F.lit(""))), 6),
        "f_last": most(F.length(F.coalesce(F.try_element_at(runs, F.lit(-1)), F.lit(""))), 6),
        "f_dots": most(count(r"\."), 4),
        "f_dashes": most(count("-"), 4),
        "f_spaces": most(count(r"\x20"), 5),
        "f_round": most(count("[()]"), 2),
        "f_square": most(count(r"[\[\]{}<>]"), 2),
        "f_octets": (plain.rlike(r"^[0-9]{1,3}(?:\.[0-9]{1,3}){3}$") & octets(plain)).cast("int"),
        "f_luhn": F.when(F.length(digits_of(m)).between(13, 19), luhn(m)).otherwise(False).cast("int"),
        "f_before": edge(c["before"]),
        "f_after": edge(c["after"]),
        "f_context": context,
        # of an address: 0 no plain domain, else the length of its last label
        "f_size": most(F.length(F.regexp_extract(m, r"(?:\.|dot|DOT|[)\]}])[\x20)\]}]*([A-Za-z]+)$", 1)), 8),
        # how "at" and the last dot are written: 0 not, 1 as a sign, 2 as a word, 3 in brackets
        "f_at": F.when(m.contains("@"), 1).when(m.rlike(r"[(\[{<][\x20]?(?:at|AT)[\x20]?[)\]}>]"), 3).when(m.rlike(r"[\x20](?:at|AT)[\x20]"), 2).otherwise(0),
        "f_dot": F.when(m.rlike(r"[(\[{][\x20]?(?:\.|dot|DOT)[\x20]?[)\]}]"), 3).when(m.rlike(r"[\x20](?:dot|DOT)[\x20]"), 2).when(m.contains("."), 1).otherwise(0),
        # whether no digits go on before it or after it
        "f_whole": c["whole"].cast("int"),
    }
    return [values[f].alias(f) for f in FEATURES]


def joined(groups: str) -> Column:
    """Digit groups with whether they go on from the group before (joins) and into the next one (goes)."""
    next_ = lambda i: F.coalesce(F.get(groups, i + 1)["before"].rlike(GAP), F.lit(False))
    return F.transform(groups, lambda x, i: x.withField("joins", (i > 0) & x["before"].rlike(GAP)).withField("goes", next_(i)))


def windows(groups: str) -> Column:
    """All windows of neighbouring digit groups with as many digits as a number has, of joined() groups.

    first is where the digits start, whole whether nothing goes on before or after. Each group has a digit, so that at most DIGITS[1] windows start at one.
    """
    kind = "struct<open:boolean,digits:int,m:string,out:array<struct<stop:bigint,m:string,after:string,ends:boolean>>>"
    none = F.struct(F.lit(True).alias("open"), F.lit(0).alias("digits"), F.lit("").alias("m"), F.array().cast("array<struct<stop:bigint,m:string,after:string,ends:boolean>>").alias("out")).cast(kind)

    def step(acc: Column, y: Column) -> Column:
        digits = acc["digits"] + F.length(y["m"])
        goes = acc["open"] & (digits <= DIGITS[1]) & ((acc["digits"] == 0) | y["joins"])
        m = F.when(acc["digits"] == 0, y["m"]).otherwise(F.concat(acc["m"], y["before"], y["m"]))
        out = F.when(goes & (digits >= DIGITS[0]), F.concat(acc["out"], F.array(F.struct(y["stop"].alias("stop"), m.alias("m"), y["after"].alias("after"), (~y["goes"]).alias("ends"))))).otherwise(acc["out"])
        return F.when(goes, F.struct(goes.alias("open"), digits.alias("digits"), m.alias("m"), out.alias("out"))).otherwise(F.struct(F.lit(False).alias("open"), acc["digits"].alias("digits"), acc["m"].alias("m"), acc["out"].alias("out"))).cast(kind)

    def starting(x: Column, i: Column) -> Column:
        lead = F.regexp_extract(x["before"], "[+(]$", 0)
        found = F.aggregate(F.slice(groups, i + 1, F.lit(DIGITS[1])), none, step, lambda acc: acc["out"])
        return F.transform(found, lambda w: F.struct((x["start"] - F.length(lead)).alias("start"), x["start"].alias("first"), w["stop"].alias("stop"), F.concat(lead, w["m"]).alias("m"), F.regexp_replace(x["before"], "[+(]$", "").alias("before"), w["after"].alias("after"), (~x["joins"] & w["ends"]).alias("whole")))

    return F.flatten(F.transform(groups, starting))


CANDIDATE = "struct<start:bigint,first:bigint,stop:bigint,generator:string,whole:boolean,m:string,before:string,after:string>"
SPAN = "array<struct<start:bigint,stop:bigint>>"


def candidates(docs: DataFrame, *keep: str) -> DataFrame:
    """Kept columns, base_<kind> arrays of (start, stop), seen_<kind> of their text and what stands by it, and cand.

    cand has the candidates in order with their features, and found, whether they overlap a base span of any kind.
    """
    held = located(docs.select(*keep, F.coalesce("text", F.lit("")).alias("text")), BASE | {g: GENERATORS[g] for g in ("address", "spelled", "octets")})
    # groups of digits, of texts with a number only
    held = located(held.withColumn("whole", F.col("text")).withColumn("text", F.when(F.col("text").rlike(GENERATORS["number"]), F.col("text")).otherwise("")), {"group": "[0-9]+"}).withColumn("text", F.col("whole")).drop("whole")
    held = held.withColumn("at_group", joined("at_group")).withColumn("at_number", windows("at_group"))
    good = {k: F.filter(f"at_{k}", passing(k)) for k in KINDS}
    held = held.withColumns({f"seen_{k}": F.transform(good[k], lambda x: F.struct(x["m"], x["before"], x["after"])) for k in KINDS} | {f"base_{k}": F.transform(good[k], lambda x: F.struct(x["start"], x["stop"])) for k in KINDS})
    proposed = [F.transform("at_number", lambda x: F.struct(x["start"], x["first"], x["stop"], F.lit("number").alias("generator"), x["whole"], x["m"], x["before"], x["after"]))]
    for g in ("address", "spelled", "octets"):
        proposed.append(F.transform(f"at_{g}", whole_candidate(g)))
    held = held.withColumn("all", F.concat(*[p.cast(f"array<{CANDIDATE}>") for p in proposed])).drop("at_group", "at_number", *(f"at_{n}" for n in [*BASE, "address", "spelled", "octets"]))
    # one order of candidates and base spans: what began before and ends after, or begins before it ends, overlaps
    some = F.size("all") > 0
    marks = F.array_sort(F.concat(F.transform("all", lambda c, i: F.struct(c["start"], c["stop"], i.cast("long").alias("i"))), F.transform(F.concat(*[F.col(f"base_{k}") for k in KINDS]), lambda b: F.struct(b["start"], b["stop"], F.lit(-1).cast("long").alias("i")))))
    held = held.withColumn("marks", F.when(some, marks).otherwise(F.array().cast("array<struct<start:bigint,stop:bigint,i:bigint>>")))
    held = held.withColumn("ends", F.transform("marks", lambda x: F.when(x["i"] < 0, x["stop"]).otherwise(-1).cast("long"))).withColumn("begins", F.reverse(F.transform("marks", lambda x: F.when(x["i"] < 0, x["start"]).otherwise(FAR).cast("long"))))
    held = running(held, {"ended": "ends"}, F.greatest, -1)
    held = running(held, {"began": "begins"}, F.least, FAR)
    zipped = F.filter(F.arrays_zip(F.col("marks").alias("x"), F.col("ended").alias("e"), F.reverse("began").alias("b")), lambda z: z["x"]["i"] >= 0)
    flags = F.transform(F.array_sort(F.transform(zipped, lambda z: F.struct(z["x"]["i"].alias("i"), ((z["e"] > z["x"]["start"]) | (z["b"] < z["x"]["stop"])).alias("found")))), lambda f: f["found"])
    return held.withColumn("cand", F.zip_with("all", flags, lambda c, f: F.struct(c["start"], c["first"], c["stop"], c["generator"], c["whole"], *describe(c), f.alias("found")))).drop("all", "marks", "ends", "begins", "ended", "began")


#: Beyond any place in a text.
FAR = 1 << 60


def whole_candidate(generator: str) -> Callable[[Column], Column]:
    return lambda x: F.struct(x["start"], x["start"].alias("first"), x["stop"], F.lit(generator).alias("generator"), F.lit(True).alias("whole"), x["m"], x["before"], x["after"])


NEUTRAL = " and then it was "


def made(kind: str, s: Column) -> Column:
    """Examples made of a base span s (m, before, after): an array of (m, before, after, label, whole)."""
    m, before, after = s["m"], s["before"], s["after"]
    one = lambda text, label, front=before, behind=after, whole=True: F.struct(text.alias("m"), front.alias("before"), behind.alias("after"), F.lit(label).alias("label"), F.lit(whole).alias("whole"))
    said = lambda words: F.concat(F.right(before, F.lit(8)), F.lit(words))
    # as they stand, and between plain words and before a mark
    both = lambda goods: [x for g in goods for x in (one(g, 1), one(g, 1, F.lit(NEUTRAL), F.lit(" ")), one(g, 1, F.lit(NEUTRAL), F.lit(",")))]
    digits = digits_of(m)
    part = lambda at, n: F.substring(digits, at, n)
    if kind == "email":
        name, domain = F.substring_index(m, "@", 1), F.substring_index(m, "@", -1)
        spelt = lambda a, d: F.concat(name, F.lit(a), F.replace(domain, F.lit("."), F.lit(d)))
        short = lambda a, d: F.concat(name, F.lit(a), F.replace(F.regexp_extract(domain, r"[^.]+\.[^.]+$", 0), F.lit("."), F.lit(d)))
        good = [f(a, d) for f in (spelt, short) for a, d in ((" at ", " dot "), ("(at)", "(dot)"), (" (at) ", " (dot) "), ("[at]", "[dot]"), (" [at] ", " [dot] "), ("[at]", "."), (" (at) ", "."), ("{at}", "{dot}"), ("<at>", "."), (" AT ", " DOT "), ("@", "[.]"))]
        word = F.regexp_extract(name, "^[A-Za-z]+", 0)
        bad = [F.concat(word, F.lit(" at "), domain), F.concat(word, F.lit(" at "), word, F.lit("."), word), F.concat(word, F.lit("@"), word), F.concat(name, F.lit("@"), F.regexp_replace(domain, r"\..*$", ""))]
        # the same without digits, which say nothing of an address
        bare = lambda x: F.regexp_replace(x, "[0-9]", "")
        return F.array(*both([f(g) for g in good for f in (lambda x: x, bare)]), *[one(f(b), 0) for b in bad for f in (lambda x: x, bare)])
    if kind == "ip":
        joined_by = lambda d: F.replace(m, F.lit("."), F.lit(d))
        good = [joined_by(d) for d in ("[.]", "(.)", " [.] ", " . ")]
        bad = [F.concat(F.lit("399"), F.lit(d), F.replace(F.regexp_replace(m, r"^[0-9]+\.", ""), F.lit("."), F.lit(d))) for d in ("[.]", " . ", "(.)")]
        listed_up = [F.lit("1 . 2 . 3 . 4"), F.lit("1. 2. 3. 4")]
        return F.array(*both(good), *[one(b, 0) for b in bad], *[one(x, 0, said(" items ")) for x in listed_up])
    if kind == "card":
        four = lambda d: F.concat(part(1, 4), F.lit(d), part(5, 4), F.lit(d), part(9, 4), F.lit(d), F.substring(digits, 13, 7))
        # the last digit moved on breaks the check
        off = F.concat(F.left(digits, F.length(digits) - 1), ((F.right(digits, F.lit(1)).cast("int") + 1) % 10).cast("string"))
        off_four = lambda d: F.concat(F.substring(off, 1, 4), F.lit(d), F.substring(off, 5, 4), F.lit(d), F.substring(off, 9, 4), F.lit(d), F.substring(off, 13, 7))
        good = [digits, four(" "), four("-"), four("."), four("/"), four("  "), four(" - ")]
        bad = [off, off_four(" "), off_four("-"), off_four("."), off_four("/"), off_four("  "), F.concat(F.left(digits, F.lit(10)), F.lit("/"), part(11, 5)), part(1, 13), part(1, 12)]
        return F.array(*both(good), *[one(g, 1, whole=False) for g in good], *[one(b, 0, whole=w) for b in bad for w in (True, False)], *[one(digits, 0, F.concat(F.right(before, F.lit(19)), F.lit("a"))), one(digits, 0, before, F.lit("f")), one(four("-"), 0, F.concat(F.right(before, F.lit(19)), F.lit("x")))])
    # the national number, ten digits at the end
    local = F.right(digits, F.lit(10))
    three = lambda a, b, c: F.concat(F.lit(a), F.left(local, F.lit(3)), F.lit(b), F.substring(local, 4, 3), F.lit(c), F.right(local, F.lit(4)))
    shapes = [three("(", ") ", "-"), three("", "-", "-"), three("", ".", "."), three("1 ", " ", " "), three("1-", "-", "-"), three("1 (", ") ", "-"), three("1.", ".", ".")]
    spoken = [" call ", " phone: ", " tel. ", " mobile "]
    plain = [three("", "", ""), three("", " ", " ")]
    four_by_four = F.concat(F.left(digits, F.lit(4)), F.lit("."), F.substring(digits, 5, 4), F.lit("."), F.left(digits, F.lit(4)))
    year = F.concat(F.lit("20"), F.left(local, F.lit(2)))
    bad = [F.concat(year, F.lit("-01-"), F.substring(local, 4, 2)), F.concat(F.substring(local, 4, 2), F.lit("/12/"), year), F.concat(F.left(local, F.lit(3)), F.lit("."), F.substring(local, 4, 5)), F.concat(year, F.lit("-"), F.concat(F.lit("20"), F.substring(local, 4, 2))), F.left(digits, F.lit(7)), F.left(digits, F.lit(9)), F.concat(F.left(local, F.lit(1)), F.lit("."), F.substring(local, 2, 7)), F.concat(F.lit("1."), F.left(local, F.lit(2)), F.lit("."), F.substring(local, 3, 5))]
    wrong = [" order ", " id ", " isbn ", " no. ", " ref "]
    return F.array(
        *both(shapes), one(m, 1, whole=False), *[one(g, 0, whole=False) for g in (*shapes, *plain, four_by_four, F.left(four_by_four, F.lit(9)))], *[one(g, 1, said(w)) for g in (*plain, *shapes[:3]) for w in spoken],
        *[one(b, 0) for b in bad], *[one(g, 0, said(w)) for g in (*plain, shapes[1], shapes[2]) for w in wrong], *[one(g, 0, F.lit(NEUTRAL)) for g in plain],
        *[one(g, 0, F.concat(F.right(before, F.lit(19)), F.lit("a"))) for g in (*plain, shapes[1])], *[one(g, 0, before, F.lit("b")) for g in (*plain, shapes[1])],
    )


def example(kind: str) -> Callable[[Column], Column]:
    """What is made of a base span, described, and whether it is held out."""
    return lambda s: F.transform(made(kind, s), lambda c: F.struct((F.pmod(F.xxhash64(s["m"]), F.lit(5)) == 0).alias("test"), c["label"], *describe(c)))


def examples(held: DataFrame) -> DataFrame:
    """Descriptions to learn from: kind, test (held out), the features, pos and n, how many of n are personal data.

    They are what is made of base spans, and the whole candidates of the corpus that no base span meets.
    """
    parts = []
    for kind in KINDS:
        rows = held.select(F.explode(F.flatten(F.transform(f"seen_{kind}", example(kind)))).alias("c"))
        parts.append(rows.select(F.lit(kind).alias("kind"), "c.*"))
    one = held.select(F.explode("cand").alias("c")).where("c.whole and not c.found")
    for kind in KINDS:
        generators = [g for g, kinds in GENERATED.items() if kind in kinds]
        own = one.where(F.col("c.generator").isin(*generators))
        features = [F.col(f"c.{f}").alias(f) for f in FEATURES]
        parts.append(own.select(F.lit(kind).alias("kind"), (F.pmod(F.xxhash64(*features), F.lit(2)) == 0).alias("test"), F.lit(0).alias("label"), *features))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.union(p)
    return rows.groupBy("kind", "test", *FEATURES).agg(F.sum(F.col("label").cast("long")).alias("pos"), F.count("*").alias("n"))


Tree = tuple[int, int, object, object]  # feature, cut, below or at, above: trees or leaf values


def grow(rows: Rows, score: list[float], depth: int) -> object:
    """A tree that lowers the logistic loss most; a leaf is one Newton step."""
    grads = [(pos - n / (1 + math.exp(-s)), n * (p := 1 / (1 + math.exp(-s))) * (1 - p)) for (_, pos, n), s in zip(rows, score)]
    g, h = sum(a for a, _ in grads), sum(b for _, b in grads)
    leaf = max(-4.0, min(4.0, g / (h + 1.0)))
    if not depth or len(rows) < 2:
        return leaf
    best, cut = g * g / (h + 1.0) + 1e-9, None
    for f in range(len(FEATURES)):
        sums: dict[int, list[float]] = {}
        for (x, _, _), (a, b) in zip(rows, grads):
            s = sums.setdefault(x[f], [0.0, 0.0])
            s[0] += a
            s[1] += b
        ga = ha = 0.0
        for value in sorted(sums)[:-1]:
            ga, ha = ga + sums[value][0], ha + sums[value][1]
            gain = ga * ga / (ha + 1.0) + (g - ga) ** 2 / (h - ha + 1.0)
            if gain > best:
                best, cut = gain, (f, value)
    if cut is None:
        return leaf
    low = [k for k, (x, _, _) in enumerate(rows) if x[cut[0]] <= cut[1]]
    high = [k for k, (x, _, _) in enumerate(rows) if x[cut[0]] > cut[1]]
    part = lambda at: grow([rows[k] for k in at], [score[k] for k in at], depth - 1)
    return (*cut, part(low), part(high))


def value_of(tree: object, x: tuple[int, ...]) -> float:
    while isinstance(tree, tuple):
        tree = tree[2] if x[tree[0]] <= tree[1] else tree[3]
    return tree


def boost(rows: Rows) -> tuple[float, list[object]]:
    """Start value and trees; without positives no trees."""
    pos, n = sum(r[1] for r in rows), sum(r[2] for r in rows)
    if not pos:
        return 0.0, []
    start = math.log((pos + 0.5) / (n - pos + 0.5))
    score, trees = [start] * len(rows), []
    for _ in range(ROUNDS):
        tree = grow(rows, score, 3)
        trees.append(tree)
        score = [s + RATE * value_of(tree, x) for s, (x, _, _) in zip(score, rows)]
    return start, trees


def expression(tree: object, c: Column) -> Column:
    if not isinstance(tree, tuple):
        return F.lit(float(tree))
    return F.when(c[FEATURES[tree[0]]] <= tree[1], expression(tree[2], c)).otherwise(expression(tree[3], c))


Models = dict[str, tuple[float, list[object], float | None]]


def total(start: float, trees: list[object], c: Column | DataFrame) -> Column:
    out = F.lit(start)
    for t in trees:
        out = out + RATE * expression(t, c)
    return out


def threshold(cells: DataFrame, start: float, trees: list[object]) -> float | None:
    """From the top: candidates of equal score together, as long as each lot is precise; None where no lot is."""
    if not trees:
        return None
    lots = cells.groupBy(F.round(total(start, trees, cells), 9).alias("s")).agg(F.sum("pos").alias("pos"), F.sum("n").alias("n"))
    vague = lots.where(F.col("pos") < PRECISION * F.col("n")).agg(F.max("s")).first()[0]
    return lots.where(F.col("s") > vague if vague is not None else F.lit(True)).agg(F.min("s")).first()[0]


def some_cells(cells: DataFrame, most_of_them: int = CELLS) -> list:
    """The descriptions to fit to, all of them or about so many, chosen by hash: never more than a bounded number."""
    total = cells.count()
    if total > most_of_them:
        cells = cells.where(F.pmod(F.xxhash64(*FEATURES), F.lit(1 << 30)) < int(most_of_them / total * (1 << 30)))
    return sorted(cells.collect(), key=lambda r: tuple(r[f] for f in FEATURES))


def fit(held: DataFrame) -> Models:
    """A model for each kind, with the threshold set by what was held out.

    With too few base spans of a kind for both, when none is held out or all are, the same examples serve for both.
    """
    cells = materialize(examples(held), "cells")
    there = {(r["kind"], r["test"]) for r in cells.where("pos > 0").select("kind", "test").distinct().collect()}
    models = {}
    for kind in KINDS:
        own = cells.where(F.col("kind") == kind)
        learnt, tried = (own.where(~F.col("test")), own.where("test")) if {(kind, False), (kind, True)} <= there else (own, own)
        start, trees = boost([(tuple(r[f] for f in FEATURES), r["pos"], r["n"]) for r in some_cells(learnt)])
        models[kind] = start, trees, threshold(tried, start, trees)
    return models


def quality(held: DataFrame, models: Models) -> DataFrame:
    """Of what was held out, by kind: recall of what was made as personal data, and precision of what is added."""
    cells = examples(held).where("test")
    out = F.lit(False)
    for kind, (start, trees, least) in models.items():
        out = F.when(F.col("kind") == kind, total(start, trees, cells) >= least - 1e-6 if least is not None else F.lit(False)).otherwise(out)
    held_out = cells.withColumn("taken", out)
    hit, taken = F.sum(F.when(F.col("taken"), F.col("pos"))), F.sum(F.when(F.col("taken"), F.col("n")))
    return held_out.groupBy("kind").agg((F.coalesce(hit, F.lit(0)) / F.sum("pos")).alias("recall"), (hit / taken).alias("precision"), F.sum("pos").alias("made"), F.sum(F.col("n") - F.col("pos")).alias("others"))


def folded(items: Column, kind: str, meets: Callable[[Column, Column], Column], join: Callable[[Column, Column], Column]) -> Column:
    """Items in order where each that meets the last one kept is joined with it, and others are kept as they come.

    What is kept goes to a list of blocks, so that a step copies a block at most.
    """
    none = F.struct(F.array().cast(f"array<array<{kind}>>").alias("done"), F.array().cast(f"array<{kind}>").alias("now"))
    shape = f"struct<done:array<array<{kind}>>,now:array<{kind}>>"

    def step(acc: Column, s: Column) -> Column:
        now = acc["now"]
        last = F.try_element_at(now, F.lit(-1))
        meeting = (F.size(now) > 0) & F.coalesce(meets(last, s), F.lit(False))
        changed = F.when(meeting, F.concat(F.slice(now, F.lit(1), F.greatest(F.size(now) - 1, F.lit(0))), F.array(join(last, s)))).otherwise(F.concat(now, F.array(s)))
        full = ~meeting & (F.size(now) >= BLOCK)
        return F.struct(F.when(full, F.concat(acc["done"], F.array(now))).otherwise(acc["done"]).alias("done"), F.when(full, F.array(s)).otherwise(changed).alias("now")).cast(shape)

    return F.aggregate(items.cast(f"array<{kind}>"), none.cast(shape), step, lambda acc: F.flatten(F.concat(acc["done"], F.array(acc["now"]))))


def apart(spans: Column) -> Column:
    """Of spans (start, stop, score) in order those that stay: of two that overlap the higher score, then the first."""
    return folded(spans, "struct<start:bigint,stop:bigint,score:double>", lambda last, s: last["stop"] > s["start"], lambda last, s: F.when(s["score"] > last["score"], s).otherwise(last))


def selected(held: DataFrame, models: Models) -> DataFrame:
    """held with all_<kind>: the base spans and the added ones, in order."""

    def added(kind: str) -> Column:
        start, trees, least = models[kind]
        if least is None:
            return F.col(f"base_{kind}")
        generators = [g for g, kinds in GENERATED.items() if kind in kinds]
        free = F.filter("cand", lambda c: c["generator"].isin(*generators) & ~c["found"])
        # a plus or bracket before the digits is part of a phone number only
        scored = F.transform(free, lambda c: F.struct((c["start"] if kind in ("email", "phone") else c["first"]).alias("start"), c["stop"].alias("stop"), total(start, trees, c).alias("score")))
        sure = F.array_sort(F.filter(scored, lambda c: c["score"] >= least - 1e-6))
        return F.array_sort(F.concat(f"base_{kind}", F.transform(apart(sure), lambda x: F.struct(x["start"], x["stop"]))))

    return held.withColumns({f"all_{k}": added(k) for k in KINDS})


def listed(prefix: str) -> Column:
    """kind:start:end of all spans, by kind and then start, joined by commas."""
    parts = [F.transform(f"{prefix}_{k}", named(k)) for k in KINDS]
    return F.array_join(F.concat(*parts), ",")


def personal_data(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, the counts of base spans by kind, base_sha256 and spans of each row's whole text."""
    held = materialize(candidates(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "doc_id").drop("text"), "candidates")
    rows = selected(held, fit(held))
    return rows.select("doc_id", *(F.size(f"base_{k}").cast("long").alias(f"n_{k}") for k in KINDS), F.sha2(listed("base").cast("binary"), 256).alias("base_sha256"), listed("all").alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """docs with each span of its text replaced by the span's kind in brackets; n_chars, if it is there, follows.

    Overlapping spans are replaced together, by the kind that starts first. A null text stays null. Rows are written
    once with their candidates, which fitting and redaction both read.
    """
    columns = docs.columns
    held = materialize(candidates(docs.select(F.struct(*columns).alias("row"), F.col("text")), "row").drop("text"), "candidates")
    rows = selected(held, fit(held))
    kind = "struct<start:bigint,stop:bigint,kind:string>"
    spans = F.array_sort(F.concat(*[F.transform(f"all_{k}", tagged(k)) for k in KINDS]))
    merged = folded(spans, kind, lambda last, s: last["stop"] > s["start"], lambda last, s: F.struct(last["start"].alias("start"), F.greatest(last["stop"], s["stop"]).alias("stop"), last["kind"].alias("kind")))
    rows = rows.select("row", merged.alias("spans"))
    whole = F.col("row")["text"]
    rows = rows.withColumn("clean", F.when(F.size("spans") == 0, whole).otherwise(replaced(whole, F.col("spans"))))
    return rows.select(*(F.col("clean").alias(c) if c == "text" else F.when(F.col("clean").isNotNull(), F.length("clean")).otherwise(F.col("row")[c]).cast(dict(docs.dtypes)[c]).alias(c) if c == "n_chars" else F.col("row")[c].alias(c) for c in columns))


#: Code points that one piece of a text has when spans are replaced.
PIECE = 4096


def replaced(text: Column, spans: Column) -> Column:
    """A text with each of its spans, apart and in order, replaced by its kind in brackets.

    A substring is found by counting from the start, so each span's surroundings are cut out of a piece of the text
    that is near, not out of the whole.
    """
    cut = F.transform(F.sequence(F.lit(0), F.floor(F.length(text) / PIECE).cast("int")), lambda b: F.substring(text, b * PIECE + 1, F.lit(PIECE)))
    starts = F.concat(F.array(F.lit(0).cast("long")), F.transform(spans, lambda s: s["stop"]))

    def between(pieces: Column, a: Column, b: Column) -> Column:
        """The text from place a up to b."""
        first, last = F.floor(a / PIECE).cast("int"), F.floor(b / PIECE).cast("int")
        head, tail = F.get(pieces, first), F.get(pieces, last)
        inside = F.substring(head, (a - first * PIECE + 1).cast("int"), (b - a).cast("int"))
        ends = F.substring(tail, F.lit(1), (b - last * PIECE).cast("int"))
        over = F.concat(F.substring(head, (a - first * PIECE + 1).cast("int"), F.lit(PIECE)), F.array_join(F.slice(pieces, first + 2, F.greatest(last - first - 1, F.lit(0))), ""), ends)
        return F.when(first == last, inside).otherwise(over)

    end = F.length(text).cast("long")
    whole = F.transform(F.array(cut), lambda pieces: F.array_join(F.zip_with(starts, spans, lambda a, s: F.concat(between(pieces, a, F.coalesce(s["start"], end)), F.when(s.isNull(), "").otherwise(F.concat(F.lit("["), s["kind"], F.lit("]"))))), ""))
    return F.get(whole, F.lit(0))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(table(spark, sf_dir, "documents"))
