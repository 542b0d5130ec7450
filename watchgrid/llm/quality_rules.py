"""Operator 6: quality rules combined by weak supervision.

Each rule looks at a document's statistics and votes good (1), bad (-1) or abstains (0). A generative model takes
the votes as independent given the hidden quality: each rule has a rate of each vote for good and for bad
documents. Expectation-maximisation estimates those rates and the share of good documents from all documents'
votes. The table of distinct vote patterns with their counts is all that it needs, and with R rules that has 3^R
rows at most, however many documents there are. The posterior probability of good is then a sum of log odds, one
for each vote, computed in the plan. A document is kept at a posterior of one half or more, unless it fails the
base rules.

Defined results: a null text has no words; it and empty texts fail the base rules. Repeated rows are judged alike.
A null doc_id stays null. Extra columns are ignored by the query and kept by the filter. An empty table gives no
rows.
"""

from __future__ import annotations

import math
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from watchgrid.llm.common import materialize, table

SYMBOLS = "#*$%&|<>"
WIDTH = 3
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_digits", "n_ended", "n_letters", "n_marked", "n_stops")
TYPE = T.StructType([T.StructField(c, T.LongType()) for c in COUNTS])


def statistics(text: str) -> tuple[int, ...]:
    """COUNTS of one text. Words stand between ASCII white space; lines between newlines."""
    words = text.encode().split()
    n = len(words)
    chars = len(text) - sum(map(text.count, " \t\n\v\f\r"))
    lines = [line for line in text.split("\n") if line.strip(" \t\v\f\r")]
    repeated = 0
    if n >= WIDTH:
        windows = list(zip(words, words[1:], words[2:]))
        counts = Counter(windows)
        if len(counts) < len(windows):
            end = 0  # of the words covered so far
            for k, w in enumerate(windows):
                if counts[w] > 1:
                    repeated += k + WIDTH - max(k, end)
                    end = k + WIDTH
    return (
        n,
        chars,
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated,
        len(lines),
        len(set(words)),
        sum(map(text.count, "0123456789")),
        sum(1 for line in lines if line.rstrip(" \t\v\f\r")[-1] in ".!?:;\"'”»"),
        sum(1 for w in words if w[:1].isalpha() or w[0] > 127),
        sum(1 for w in words if w.translate(None, SYMBOLS.encode()) != w),
        sum(map(text.count, ".!?")),
    )


@F.arrow_udf(TYPE)
def statistics_of(texts: pa.Array) -> pa.Array:
    rows = [statistics(t or "") for t in texts.to_pylist()]
    columns = zip(*rows) if rows else [[] for _ in COUNTS]
    return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], list(COUNTS))


def votes(s: Column) -> dict[str, Column]:
    """The vote of each rule: -1 bad, 1 good, 0 no opinion."""

    def rate(a: str, b: str) -> Column:
        return s[a] / F.greatest(s[b], F.lit(1))

    def rule(bad: Column, good: Column | None = None, known: Column = s["n_words"] > 0) -> Column:
        return F.when(~known, 0).when(bad, -1).when(F.lit(False) if good is None else good, 1).otherwise(0)

    many, lines = s["n_words"] >= 20, s["n_lines"] >= 3
    length, ended, stops = rate("word_chars", "n_words"), rate("n_ended", "n_lines"), rate("n_stops", "n_words")
    return {
        "short": rule(s["n_words"] < 20, known=F.lit(True)),
        "word_length": rule(~length.between(2.0, 14.0)),
        "symbols": rule(rate("n_symbols", "n_words") > 0.1),
        "marked_words": rule(rate("n_marked", "n_words") > 0.1),
        "digits": rule(rate("n_digits", "word_chars") > 0.2),
        "letters": rule(rate("n_letters", "n_words") < 0.6),
        "repeated_words": rule(rate("n_repeat_words", "n_words") > 0.3, known=many),
        "repeated_lines": rule(rate("n_dup_lines", "n_lines") > 0.3, known=lines),
        "distinct_words": rule(rate("n_distinct", "n_words") < 0.2, known=many),
        "line_ends": rule(ended < 0.4, ended >= 0.8),
        "sentences": rule(stops < 0.01, stops.between(0.02, 0.4), known=many),
        "line_words": rule(rate("n_words", "n_lines") < 5, known=lines),
    }


def fit(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 200) -> tuple[float, list[dict[int, float]]]:
    """Log odds of good before any vote, and for each rule the log odds that each of its votes adds.

    EM starts from the majority of the votes. Rates, of abstaining too, are smoothed by one document a vote. A rule
    can't turn over: a vote for good never counts against it, nor one for bad in favour. In the odds returned,
    abstaining counts for a factor of e at most, so that it alone rejects nothing that other rules find good.
    """
    if not patterns:
        return 0.0, []
    rules = len(patterns[0][0])
    good = [1 / (1 + math.exp(-2.0 * sum(v))) for v, _ in patterns]
    prior, odds = 0.0, [dict.fromkeys((-1, 0, 1), 0.0) for _ in range(rules)]
    for _ in range(rounds):
        total = sum(n for _, n in patterns)
        yes = sum(g * n for g, (_, n) in zip(good, patterns))
        prior = math.log((yes + 1) / (total - yes + 1))
        for r in range(rules):
            for vote in (-1, 0, 1):
                a = sum(g * n for g, (v, n) in zip(good, patterns) if v[r] == vote)
                b = sum((1 - g) * n for g, (v, n) in zip(good, patterns) if v[r] == vote)
                odds[r][vote] = math.log((a + 1) / (yes + 3)) - math.log((b + 1) / (total - yes + 3))
            odds[r][1], odds[r][-1] = max(odds[r][1], 0.0), min(odds[r][-1], 0.0)
        new = [1 / (1 + math.exp(-max(-500.0, min(500.0, prior + sum(odds[r][v[r]] for r in range(rules)))))) for v, _ in patterns]
        moved = max(abs(a - b) for a, b in zip(new, good))
        good = new
        if moved < 1e-9:
            break
    return prior, [o | {0: max(-1.0, min(1.0, o[0]))} for o in odds]


def base_failed(s: Column) -> Column:
    return (s["n_words"] < 50) | (100 * s["n_repeat_words"] > 50 * s["n_words"])


def posterior(stats: DataFrame, column: str = "s") -> Column:
    """Probability of good of each row, by a model fitted to all rows of stats."""
    s = F.col(column)
    named = votes(s)
    rows = stats.select(F.array(*named.values()).alias("v")).groupBy("v").count().collect()  # 3^rules rows at most
    prior, odds = fit(sorted((tuple(r["v"]), r["count"]) for r in rows))
    total = F.lit(prior)
    for vote, by in zip(named.values(), odds):
        total = total + F.when(vote == 1, by[1]).when(vote == -1, by[-1]).otherwise(by[0])
    return 1 / (1 + F.exp(-total))


def judge(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, the base counts, base_failed, kept and the posterior quality of each row."""
    stats = materialize(docs.select(F.col(doc_id).alias("doc_id"), statistics_of(F.col(text)).alias("s")), "statistics")
    quality = posterior(stats)
    failed = base_failed(F.col("s"))
    return stats.select("doc_id", *(F.col("s")[c].alias(c) for c in COUNTS[:5]), failed.alias("base_failed"), (~failed & (quality >= 0.5)).alias("kept"), quality.alias("quality"))


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of docs that are kept, with all their columns."""
    held = docs.withColumn("_wg_stats", statistics_of(F.col("text")))
    s = F.col("_wg_stats")
    return held.where(~base_failed(s) & (posterior(held.select("_wg_stats"), "_wg_stats") >= 0.5)).drop("_wg_stats")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"))
