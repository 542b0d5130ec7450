"""Operator 13: benchmark passages in documents, by Wu-Manber search for many strings at once.

The strings are the benchmark's windows of WIDTH words, and whole items of fewer; letters of the search are words.
Strings of one length form a matcher. For each pair of neighbouring words (a block) its shift table holds how far
before a string's end that block stands at the least, and what no string holds shifts by the whole length: a
position is skipped by its block's shift. Where the shift is zero, the block's hash names the bucket of strings that
end so. A bucket is in order of the strings' hashes, so the strings of the text's hash are found by halving, and each
is compared word by word. Texts are joined with a number between them that no string holds, cut into lanes, and all
lanes move on together, each by its own shift.

The benchmark is taken in blocks of about BLOCK_BYTES of its text, however large it is: a block's matchers are built
from its items and broadcast, and the documents are searched once a block. Hits of several blocks are united by row.
Items of the same words are one for the search, so copies of an item cost nothing more.

Defined results: a null text has no words, and neither does an item without a letter or digit; it is never found.
A null item_id isn't listed, but its words count as hit. Repeated rows of documents each give a row; repeated rows of
an item count once. A null doc_id stays null. Extra columns are ignored. Without benchmark rows no word is hit.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from watchgrid.llm.common import ROW, drop, materialize, table, with_row_key

WIDTH = 10
#: Bytes of benchmark text whose matchers are held at once, in the driver and in each Python worker.
BLOCK_BYTES = 8 << 20
#: Words of a lane, and words of documents that are searched together.
LANE, BATCH_WORDS = 512, 1 << 20
#: Slots of a shift table.
SLOTS = 1 << 20
#: Between texts; no string holds it. Words that no item holds share zero.
GAP, UNKNOWN = -1, 0

#: ASCII letters in lower case and digits stand for themselves, bytes beyond ASCII too, the rest for space.
FOLD = bytes(c | 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(FOLD).split()


def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of pairs of numbers."""
    with np.errstate(over="ignore"):
        x = (a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (b.astype(np.uint64) + np.uint64(0x632BE59BD9B4E019))
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(32))


def hashes(ids: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """Hash of the width numbers from each start on."""
    h = np.full(len(starts), width, np.uint64)
    for k in range(width):
        h = mixed(h, ids[starts + k])
    return h


@dataclass
class Matcher:
    """Strings of one length: windows at starts of ids, in order of bucket and hash; owner is an item each."""

    ids: np.ndarray
    starts: np.ndarray
    owner: np.ndarray
    width: int
    shift: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        self.block = min(2, self.width)
        ends = self.starts + self.width - 1
        self.shift = np.full(SLOTS, self.width - self.block + 1, np.int16)
        for back in range(self.width - self.block, -1, -1):
            self.shift[self.slot(self.ids, ends - back)] = back
        slot, whole = self.slot(self.ids, ends), hashes(self.ids, self.starts, self.width)
        order = np.lexsort((whole, slot))
        self.starts, self.owner, self.whole = self.starts[order], self.owner[order], whole[order]
        self.first = np.searchsorted(slot[order], np.arange(SLOTS + 1))

    def slot(self, ids: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The slot of the block that ends at each place."""
        before = ids[ends - 1] if self.block == 2 else np.zeros(len(ends), np.int64)
        return (mixed(before, ids[ends]) & np.uint64(SLOTS - 1)).astype(np.int64)

    def ending(self, text: np.ndarray) -> np.ndarray:
        """Places of text where a string may end: those with shift zero that the walk comes to, in any order."""
        at = np.arange(self.width - 1, len(text), LANE)
        stop = np.minimum(at + LANE, len(text))
        found = [np.empty(0, np.int64)]
        while len(at):
            by = self.shift[self.slot(text, at)]
            found.append(at[by == 0])
            at = at + np.maximum(by, 1)
            going = at < stop
            at, stop = at[going], stop[going]
        return np.concatenate(found)

    def search(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start in text, string) of each occurrence."""
        ends = self.ending(text)
        starts, slot = ends - self.width + 1, self.slot(text, ends)
        whole = hashes(text, starts, self.width)
        low, high = self.first[slot], self.first[slot + 1]
        stop = high.copy()
        while (going := low < high).any():
            mid = (low + high) // 2
            less = going & (self.whole[np.minimum(mid, len(self.whole) - 1)] < whole)
            low, high = np.where(less, mid + 1, low), np.where(going & ~less, mid, high)
        at, string = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        while len(starts):
            same = low < stop
            same[same] = self.whole[low[same]] == whole[same]
            starts, whole, low, stop = starts[same], whole[same], low[same], stop[same]
            equal = np.ones(len(starts), bool)
            for k in range(self.width):
                equal &= text[starts + k] == self.ids[self.starts[low] + k]
            at.append(starts[equal])
            string.append(low[equal])
            low = low + 1  # strings of equal hash: the same window of several items
        return np.concatenate(at), np.concatenate(string)


@dataclass
class Library:
    """The matchers of one block of items, the numbers of its words, and the ids of items of each word sequence."""

    names: dict[bytes, int]
    matchers: list[Matcher]
    items: list[list[str]]


def library(items: list[tuple[str | None, bytes | None]], width: int = WIDTH) -> Library:
    """Matchers for items of (id, text)."""
    same: dict[tuple[bytes, ...], set[str]] = {}
    for item_id, text in items:
        if words := tuple(words_of(text)):
            held = same.setdefault(words, set())
            if item_id is not None:
                held.add(item_id)
    names: dict[bytes, int] = {}
    ids = np.fromiter((names.setdefault(w, len(names) + 1) for words in same for w in words), np.int64)
    counts = np.fromiter(map(len, same), np.int64, len(same))
    begin = np.cumsum(counts) - counts
    matchers = []
    for length in range(1, width + 1):
        some = np.flatnonzero(counts >= width if length == width else counts == length)
        if len(some):
            many = counts[some] - length + 1
            owner = np.repeat(some, many)
            starts = np.repeat(begin[some], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            matchers.append(Matcher(ids, starts, owner, length))
    return Library(names, matchers, [sorted(v) for v in same.values()])


def search(lib: Library, texts: list[bytes | None]) -> list[tuple[int, list[tuple[int, int]], list[int]]]:
    """For each text its number of words, the stretches (start, end) of hit words, and the word sequences found."""
    get = lib.names.get
    numbers = [[get(w, UNKNOWN) for w in words_of(t)] for t in texts]
    counts = np.fromiter(map(len, numbers), np.int64, len(numbers))
    begin = np.cumsum(counts + 1) - counts
    text = np.full(int(counts.sum()) + len(counts) + 1, GAP, np.int64)
    for b, row in zip(begin.tolist(), numbers):
        text[b : b + len(row)] = row
    depth, pairs = np.zeros(len(text) + 1, np.int64), [np.empty((0, 2), np.int64)]
    for m in lib.matchers:
        at, string = m.search(text)
        np.add.at(depth, at, 1)
        np.add.at(depth, at + m.width, -1)
        pairs.append(np.unique(np.c_[np.searchsorted(begin, at, "right") - 1, m.owner[string]], axis=0))
    hit = np.diff(np.r_[False, np.cumsum(depth[:-1]) > 0, False].astype(np.int8))
    opens, closes = np.flatnonzero(hit == 1), np.flatnonzero(hit == -1)
    at = np.searchsorted(begin, opens, "right") - 1
    spans: list[list[tuple[int, int]]] = [[] for _ in texts]
    for k, a, b in zip(at.tolist(), (opens - begin[at]).tolist(), (closes - begin[at]).tolist()):
        spans[k].append((a, b))
    owners: list[set[int]] = [set() for _ in texts]
    for k, owner in np.concatenate(pairs).tolist():
        owners[k].add(owner)
    return [(n, s, sorted(o)) for n, s, o in zip(counts.tolist(), spans, owners)]


SPAN = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
FOUND = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("spans", T.ArrayType(SPAN)), T.StructField("items", T.ArrayType(T.StringType()))])


def finder(spark: SparkSession, items: list[tuple[str | None, bytes | None]], width: int):
    """A column function from texts to FOUND, for one block of items."""
    shared = spark.sparkContext.broadcast(library(items, width))

    @F.arrow_udf(FOUND)
    def find(texts: pa.Array) -> pa.Array:
        lib = shared.value
        rows, held, size = [], [], 0
        for t in texts.cast(pa.large_binary()):
            held.append(t.as_py())
            size += len(held[-1] or b"")
            if size > 8 * BATCH_WORDS:
                rows += search(lib, held)
                held, size = [], 0
        rows += search(lib, held) if held else []
        spans = [[{"start": a, "end": b} for a, b in s] for _, s, _ in rows]
        items_of = [sorted(i for o in owners for i in lib.items[o]) for _, _, owners in rows]
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        return pa.StructArray.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array(spans, span), pa.array(items_of, pa.list_(pa.string()))], ["n_words", "spans", "items"])

    return find


def blocks(benchmark: DataFrame, item_id: str, text: str, size: int) -> Iterator[list[tuple[str | None, bytes | None]]]:
    """The items, a block of about size bytes of text at a time."""
    held = benchmark.select(F.col(item_id).cast("string").alias("i"), F.col(text).cast("binary").alias("t"))
    total = held.agg(F.sum(F.octet_length("t") + 64)).first()[0] or 0
    count = -(-total // size)
    for k in range(count):
        part = held.where(F.pmod(F.xxhash64("t"), F.lit(count)) == k) if count > 1 else held
        rows = part.distinct().toArrow()
        yield list(zip(rows.column("i").to_pylist(), rows.column("t").to_pylist()))


def joined_spans(spans):
    """The union of stretches (start, end), in order, as an array column."""
    one = lambda a, b: F.struct(a.alias("start"), b.alias("end"))
    done = lambda acc, x: F.when((F.size(acc) > 0) & (F.element_at(acc, -1)["end"] >= x["start"]), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(one(F.element_at(acc, -1)["start"], F.greatest(F.element_at(acc, -1)["end"], x["end"]))))).otherwise(F.concat(acc, F.array(x)))
    return F.reduce(F.array_sort(spans), F.array().cast(T.ArrayType(SPAN)), done)


def contamination(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", width: int = WIDTH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, spans (stretches of hit words) and items (ids found, sorted as strings) for each row of docs."""
    spark, rows = docs.sparkSession, None
    held = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("t"))
    parts = blocks(benchmark, item_id, item_text, block_bytes)
    first, second = next(parts, []), next(parts, None)
    if second is None:
        return held.select("doc_id", finder(spark, first, width)("t").alias("f")).select("doc_id", "f.*")
    # each block's hits are written; rows without any are left to the last join
    keyed, made = with_row_key(held), []
    for items in (first, second, *parts):
        found = keyed.select(*ROW, finder(spark, items, width)("t").alias("f"))
        made.append(materialize(found.where("size(f.items) + size(f.spans) > 0").select(*ROW, "f.spans", "f.items"), "hits"))
    for part in made:
        rows = part if rows is None else rows.union(part)
    hits = rows.groupBy(*ROW).agg(joined_spans(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    hits = materialize(hits, "found")
    for part in made:
        drop(part)
    counts = keyed.select("doc_id", *ROW, finder(spark, [], width)("t")["n_words"].alias("n_words"))
    none = lambda c: F.coalesce(c, F.array().cast(hits.schema[c].dataType)).alias(c)
    return counts.join(hits, list(ROW), "left").select("doc_id", "n_words", none("spans"), none("items"))


def op13_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.reduce("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    rows = found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"))
    return rows.withColumn("contaminated", F.col("n_hit") > 0)


OP13_SQL = r"""
WITH d AS (
    SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM documents
), b AS (
    SELECT DISTINCT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM benchmark
), strings AS (
    SELECT DISTINCT item_id, w[k:k + least(len(w), 10) - 1] AS win
    FROM (SELECT *, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS k FROM b WHERE len(w) > 0)
), places AS (
    SELECT r, k, w[k:k + n - 1] AS win
    FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, (SELECT DISTINCT len(win) AS n FROM strings))
), found AS (SELECT r, k, win, item_id FROM places JOIN strings USING (win)),
hits AS (SELECT r, count(DISTINCT place) AS n_hit FROM (SELECT DISTINCT r, unnest(range(k, k + len(win))) AS place FROM found) GROUP BY r),
items AS (
    SELECT r, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS list
    FROM (SELECT DISTINCT r, item_id::VARCHAR AS i FROM found WHERE item_id IS NOT NULL) GROUP BY r
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (r) LEFT JOIN items USING (r)
"""
