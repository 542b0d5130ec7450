"""Operator 11: spelling variants, by a positional q-gram index with a count filter.

Two words are near if they differ by one inserted, deleted or replaced code point. One edit leaves the first half of
the shorter word whole, at the start of both, or its second half, at the end of both. So words are dealt to cells: a
cell has a length of the shorter word, and the start and the end that its words share; each word goes to the cells of
its own length and to those of a length less. A cell of more than HEAVY words is dealt again by halves of what its
words don't share, until cells are small or one place is left free, which the alphabet bounds.

Within a cell the free parts, with the letters beside them, are cut into q-grams of two. An inverted index has the
words of each gram and place. A word's lists, those that its length and the limits of place allow, are merged by a
heap; the times that another word comes up is the overlap of their grams. One edit touches two grams, so words with
an overlap of the longer one's number of grams less two or more are compared letter by letter.

Defined results: a null text has no words. A null doc_id counts as the empty text in the checksum that picks runs to
be altered. Repeated rows count again. Extra columns are ignored. Without words there are no rows. Forms rise in
count by FACTOR at each step, so following them ends.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from watchgrid.llm.common import drop, materialize, table

#: Fewest code points and occurrences of a word, and how many times as often its form must occur.
LETTERS, OCCURRENCES, FACTOR = 6, 5, 5
#: One in so many occurrences loses a code point in the query.
ALTERED = 199
Q = 2
#: Words of a cell before it is dealt out again.
HEAVY = 2048
#: Distinct words that a task counts before it hands the counts on.
HELD = 200_000

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def altered(word: str, before: int, every: int | None) -> str:
    """The word, less one code point if every divides its checksum; before is the checksum of what precedes it."""
    if every and (h := zlib.crc32(word.encode(), before)) % every == 0:
        at = h % len(word)
        return word[:at] + word[at + 1 :]
    return word


def word_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", every: int | None = None, letters: int = LETTERS, least: int = OCCURRENCES) -> DataFrame:
    """(word, n) of each word of letters code points and least occurrences or more."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])
            counts.clear()
            return made

        for batch in batches:
            for doc, t in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary())):
                before = zlib.crc32(f"{doc or ''}:".encode())
                for word, n in Counter(RUN.findall((t.as_py() or b"").lower().decode())).items():
                    word = altered(word, before, every)
                    if len(word) >= letters:
                        counts[word] += n
                if len(counts) >= HELD:
                    yield out()
        if counts:
            yield out()

    held = docs.select(F.col(doc_id).cast("string").alias("d"), F.col(text).alias("t")).mapInArrow(counted, "word string, n long")
    return held.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


#: Names a cell by its length and what its words share.
CELL = "concat_ws('|', size, left, left(word, left), right(word, right))"


def cells(words: DataFrame, heavy: int = HEAVY) -> DataFrame:
    """(cell, size, left, right, word): size is the cell's length of the shorter word, left and right the code
    points that its words share at the start and at the end. Every two near words meet in a cell of the length of
    the shorter one."""
    sizes = F.array(F.char_length("word"), F.char_length("word") - 1)
    rows = words.select("word", F.explode(sizes).alias("size"), F.lit(0).alias("left"), F.lit(0).alias("right"))
    now, done = halved(rows), None
    while True:
        now = materialize(now.select(F.expr(CELL).alias("cell"), "size", "left", "right", "word"), "cells")
        large = now.where("size - left - right > 1").groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") > heavy).select("cell")
        large = materialize(large, "large")
        if large.isEmpty():
            return now if done is None else done.union(now)
        rest = now.join(large, "cell", "left_anti")
        done = rest if done is None else done.union(rest)
        now = halved(now.join(large, "cell", "left_semi").drop("cell"))


def halved(rows: DataFrame) -> DataFrame:
    """Each row twice: with the first and with the second half of its free places shared as well."""
    free = F.col("size") - F.col("left") - F.col("right")
    half = F.floor(free / 2).cast("int")
    parts = F.array(F.struct((F.col("left") + half).alias("left"), "right"), F.struct("left", (F.col("right") + free - half).alias("right")))
    return rows.withColumn("p", F.explode(parts)).select("word", "size", "p.left", "p.right")


def one_edit(a: str, b: str) -> bool:
    """Whether b, as long as a or one longer, is a with one code point replaced or inserted."""
    if a == b:
        return False
    at = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[at + (len(a) == len(b)) :] == b[at + 1 :]


def near_in_cell(words: list[str], size: int, left: int, right: int) -> Iterator[tuple[str, str]]:
    """Pairs (a, b) of near words of a cell, a of length size, b as long and after a, or one longer."""
    index: defaultdict[tuple[str, int], list[int]] = defaultdict(list)
    short = [w for w in words if len(w) == size]

    def grams(word: str) -> list[str]:
        part = f"^{word}$"[left : len(word) - right + 2]  # the free places and one on either side
        return [part[k : k + Q] for k in range(len(part) - Q + 1)]

    def overlapping(lists: list[list[int]], bound: int) -> Iterator[str]:
        if bound <= 0:  # one free place: all words of the length are near
            yield from short[:seen]
            return
        for other, times in groupby(heapq.merge(*lists)):
            if sum(1 for _ in times) >= bound:
                yield short[other]

    for seen, word in enumerate(short):
        own = list(enumerate(grams(word)))
        yield from ((a, word) for a in overlapping([index[g, k] for k, g in own if (g, k) in index], len(own) - Q) if one_edit(a, word))
        for k, g in own:
            index[g, k].append(seen)
    seen = len(short)
    for word in words if short else ():
        if len(word) > size:
            own = list(enumerate(grams(word)))
            lists = [index[g, at] for k, g in own for at in (k, k - 1) if (g, at) in index]
            yield from ((a, word) for a in overlapping(lists, len(own) - Q) if one_edit(a, word))


def near_of_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (cell, size, left, right, word), a cell's together, to pairs (a, b) of near words."""
    rows = (r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns)))
    made: list[tuple[str, str]] = []

    def out() -> pa.RecordBatch:
        found = pa.RecordBatch.from_arrays([pa.array([p[k] for p in made], pa.string()) for k in (0, 1)], ["a", "b"])
        made.clear()
        return found

    for (_, size, left, right), group in groupby(rows, key=lambda r: r[:4]):
        for pair in near_in_cell([r[4] for r in group], size, left, right):
            made.append(pair)
            if len(made) >= 1 << 16:
                yield out()
    if made:
        yield out()


def near_pairs(words: DataFrame, heavy: int = HEAVY) -> DataFrame:
    """Each pair (a, b) of near words once, of distinct words in the column word."""
    return cells(words, heavy).repartition("cell").sortWithinPartitions("cell").mapInArrow(near_of_cells, "a string, b string").distinct()


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for rows (word, form): the last of the forms that follow from word."""
    now = materialize(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        new = materialize(now.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        moved = not new.where("moved").isEmpty()
        drop(now)
        now = new.select("word", "root")
        now._wg_path = new._wg_path
        if not moved:
            return now


def variants(words: DataFrame, factor: int = FACTOR, heavy: int = HEAVY) -> DataFrame:
    """word, form, root, n, n_near and form_n for each row of words (word, n); words are distinct."""
    held = materialize(words.select("word", "n"), "words")
    pairs = materialize(near_pairs(held, heavy), "pairs")
    both = pairs.union(pairs.select("b", "a"))
    counted = both.join(held.withColumnRenamed("word", "b"), "b").groupBy(F.col("a").alias("word"))
    # of near words the one of largest n, of equal ones the first in order
    best = counted.agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("n")).alias("less"), "b")).alias("best"))
    joined = held.join(best, "word", "left").withColumn("some", -F.col("best.less") >= factor * F.col("n"))
    rows = joined.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(F.col("some"), F.col("best.b")).alias("form"), F.when(F.col("some"), -F.col("best.less")).alias("form_n"))
    rows = materialize(rows, "forms")
    last = roots(rows.where("form is not null"))
    return rows.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(word_counts(table(spark, sf_dir, "documents"), every=ALTERED))


OP11_SQL = r"""
WITH RECURSIVE crc AS (
    SELECT list(list_reduce([k, 1, 1, 1, 1, 1, 1, 1, 1], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY k) AS t FROM range(256) r(k)
), found AS (
    SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{C0}-\x{FF}]+')) AS w FROM documents
), runs AS (
    SELECT w, count(*) AS n, coalesce(doc_id::VARCHAR, '') || ':' || w AS line FROM found GROUP BY doc_id, w
), bytes AS (
    SELECT w, n, list_concat([4294967295::BIGINT], list_transform(range(strlen(line)), lambda k: ('0x' || substr(hex(line), 2 * k + 1, 2))::BIGINT)) AS b FROM runs
), sums AS (
    SELECT w, n, xor(list_reduce(b, lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) AS h FROM bytes, crc
), words AS (
    SELECT word, sum(n)::BIGINT AS n
    FROM (SELECT CASE WHEN h % 199 = 0 THEN w[1:h % length(w)] || w[h % length(w) + 2:] ELSE w END AS word, n FROM sums)
    WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5
), plain AS (
    -- one byte a letter, so that edits of bytes are edits of letters
    SELECT word, n, translate(word, (SELECT string_agg(chr(k::INT), '' ORDER BY k) FROM range(192, 256) r(k)), (SELECT string_agg(chr(k::INT), '' ORDER BY k) FROM range(33, 97) r(k))) AS p FROM words
), pairs AS (
    SELECT DISTINCT a.word, a.n, b.word AS other, b.n AS m
    FROM (SELECT *, unnest([p[1:3] || '~', '~' || p[-3:]]) AS k FROM plain) a JOIN (SELECT *, unnest([p[1:3] || '~', '~' || p[-3:]]) AS k FROM plain) b USING (k)
    WHERE abs(length(a.p) - length(b.p)) <= 1 AND a.p <> b.p AND levenshtein(a.p, b.p) = 1
), best AS (SELECT word, count(*) AS n_near, min((-m, other)) AS best FROM pairs GROUP BY word),
forms AS (
    SELECT words.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN -best[1] >= 5 * n THEN best[2] END AS form, CASE WHEN -best[1] >= 5 * n THEN -best[1] END AS form_n
    FROM words LEFT JOIN best USING (word)
), follow AS (
    SELECT word, word AS root FROM forms
    UNION ALL SELECT follow.word, form FROM follow JOIN forms ON follow.root = forms.word WHERE form IS NOT NULL
)
SELECT word, form, root, n, n_near, form_n
FROM forms JOIN (SELECT follow.word, root FROM follow JOIN forms f ON follow.root = f.word WHERE f.form IS NULL) USING (word)
"""
