"""Operator 5: best-fit packing of token sequences after Martello-Toth dominance reduction.

Only lengths matter to a packing, and there are at most `size` of them, so the instance is a histogram: one count
per length, whatever the number of documents. Sets of pieces that provably dominate every alternative are fixed
first, by length and count; the remainder is packed best-fit decreasing, again by length. The plan is a list of
runs "so many pieces of this length, at this offset of sequences from here on". Pieces are numbered within their
length without gathering them: a count per length and input partition is summed up, and each piece adds its place
in its partition. So no length, however common, meets in one task.

Defined results: a null text is empty; an empty text is one piece, the end id alone. Only documents longer than a
sequence are cut; a length that divides evenly has no empty last piece. Repeated rows and null ids are packed like
any other. Extra columns are ignored. An empty table packs to no rows.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from watchgrid.llm.bpe import default_path
from watchgrid.llm.common import materialize, table

SIZE, END_ID = 4096, 1
#: Bytes that a worker remembers of words and their ids before it starts afresh, and those of an entry itself.
REMEMBERED, ENTRY = 200_000_000, 150

Run = tuple[int, int, int, int, int]  # length, first rank, count, first sequence, offset


#: A special token of the vocabulary.
BETWEEN = "<|endoftext|>"
TAIL = re.compile(rb"[a-z][.,]\Z").search


def plain(text: bytes) -> bytes:
    """The text with A to Z lower-cased, as the tokenizer does it, so that fewer words differ.

    Not where that could matter: beside special tokens, whose case counts, or combining marks, which are joined to
    letters before those are lower-cased.
    """
    return text if b"<|" in text or b"\xcc" in text or b"\xcd" in text else text.lower()


class WordIds:
    """Ids by the tokenizers library; words between ASCII white space encode on their own and are remembered."""

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.between = self.tokenizer.token_to_id(BETWEEN)
        self.word: dict[bytes, bytes] = {}
        self.held = 0

    def learn(self, words: list[bytes], at_once: int) -> None:
        """Encode words, some at once with a special token between them: the library cuts texts there first."""
        groups = [words[k : k + at_once] for k in range(0, len(words), at_once)]
        lines = [BETWEEN.join(w.decode() for w in g) for g in groups]
        for group, e in zip(groups, self.tokenizer.encode_batch_fast(lines, add_special_tokens=False)):
            ids = np.array(e.ids, "<u4")
            cuts = [-1, *np.flatnonzero(ids == self.between).tolist(), len(ids)] if len(group) > 1 else [-1, len(ids)]
            raw = ids.tobytes()
            self.word.update((w, raw[4 * a + 4 : 4 * b]) for w, a, b in zip(group, cuts, cuts[1:]))

    def encode(self, text: bytes) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        words = plain(text).split()
        try:
            return b"".join(map(self.word.__getitem__, words))
        except KeyError:
            pass
        if self.held > REMEMBERED:
            self.word.clear()
            self.held = 0
        new = {w for w in words if w not in self.word}
        # a comma or full stop behind a letter is a piece of its own
        cores = {w: w[:-1] if TAIL(w) else w for w in new}
        missing = {w for w in (b".", b",", *cores.values()) if w not in self.word}
        self.learn([w for w in missing if b"<|" in w], 1)
        self.learn([w for w in missing if b"<|" not in w], 200)
        for w, core in cores.items():
            if w is not core:
                self.word[w] = self.word[core] + self.word[w[-1:]]
        self.held += sum(ENTRY + len(w) + len(self.word[w]) for w in new | missing)
        return b"".join(map(self.word.__getitem__, words))


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


def pieces(path: str | None, size: int, end_id: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of one piece each; place is its number among the pieces of its length in this partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, end = word_ids(path or default_path()), np.array([end_id], "<u4").tobytes()
        part, seen = TaskContext.get().partitionId(), np.zeros(size + 1, np.int64)
        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.large_binary())):
                ids = coder.encode(text.as_py() or b"") + end
                for k in range(0, len(ids), 4 * size):
                    cut = ids[k : k + 4 * size]
                    length = len(cut) // 4
                    for column, value in zip(out, (doc, k // (4 * size), k // 4, length, zlib.crc32(cut), int(seen[length]))):
                        column.append(value)
                    seen[length] += 1
            cols = [pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([*cols, pa.array([part] * len(cols[0]), pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32", "place", "part"])

    return run


def reduce_instance(count: np.ndarray, size: int) -> list[tuple[list[int], int]]:
    """Sets of lengths that dominate all others, with how often each is fixed; count loses them.

    Largest length first. A set is fixed if every other set that holds the length could be exchanged for it:
    the length alone, if not even the shortest other fits beside it; with the one that fills the sequence, since
    whatever else stands beside the length fits into that one's place; with the longest that fits, if no two fit,
    or if no three fit and it is at least as long as any two that fit together.
    """
    fixed = []
    for length in range(size, 0, -1):
        room = size - length
        while count[length]:
            there = count[: room + 1].copy()  # what may stand beside one of this length
            if length <= room:
                there[length] -= 1
            low = np.flatnonzero(there)
            if not len(low):
                times = int(count[length]) if 2 * length > size else 1
                count[length] -= times
                fixed.append(([length], times))
                continue
            best = int(low[-1])
            least = np.repeat(low[:3], np.minimum(there[low[:3]], 3))[:3]
            two, three = (int(least[:k].sum()) if len(least) >= k else size for k in (2, 3))
            if not (best == room or two > room or three > room and largest_pair(there, low, room) <= best):
                break
            # each reason holds on while both lengths last: taking pieces away only leaves fewer alternatives
            times = int(count[length]) // 2 if best == length else int(min(count[length], count[best]))
            count[length] -= times
            count[best] -= times
            fixed.append(([length, best], times))
    return fixed


def largest_pair(there: np.ndarray, low: np.ndarray, room: int) -> int:
    """The largest sum within room of two pieces of there; 0 without any. low: the lengths that are there."""
    most, j = 0, len(low) - 1
    for i, a in enumerate(low):
        while j > i and low[j] + a > room:
            j -= 1
        if j <= i:
            return max(most, int(2 * a)) if there[a] > 1 and 2 * a <= room else most
        most = max(most, int(low[j] + a), int(2 * a) if there[a] > 1 and 2 * a <= room else 0)
    return most


def plan(histogram: dict[int, int], size: int) -> list[Run]:
    """Where the pieces of each length go: dominance first, then best fit for the remainder."""
    count = np.zeros(size + 1, np.int64)
    for length, n in histogram.items():
        count[length] = n
    rank = np.zeros(size + 1, np.int64)
    runs: list[Run] = []
    sequences = 0
    for lengths, times in reduce_instance(count, size):
        offset = 0
        for length in lengths:
            runs.append((length, int(rank[length]), times, sequences, offset))
            rank[length] += times
            offset += length
        sequences += times
    room: list[list[tuple[int, int]]] = [[] for _ in range(size + 1)]  # by free tokens: (first sequence, sequences)
    free = np.zeros(size + 1, bool)
    for length in range(size, 0, -1):
        left = int(count[length])
        while left:
            fits = np.flatnonzero(free[length:])
            if len(fits):
                at = int(fits[0]) + length
                first, n = room[at].pop()
                take = min(n, left)
                if take < n:
                    room[at].append((first + take, n - take))
                free[at] = bool(room[at])
            else:
                at = size
                # as many new sequences as these pieces fill
                first, take = sequences, -(-left // max(1, size // length))
                sequences += take
            runs.append((length, int(rank[length]), take, first, size - at))
            rank[length] += take
            left -= take
            if at > length:
                room[at - length].append((first, take))
                free[at - length] = True
    return runs


def pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SIZE, end_id: int = END_ID, path: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of each piece."""
    spark = docs.sparkSession
    kept = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    cut = materialize(kept.mapInArrow(pieces(path, size, end_id), "doc_id long, piece int, start long, length long, ids_crc32 long, place long, part long"), "pieces")
    # rows by length and part; a part adds at most `size` of them
    counts = materialize(cut.groupBy("length", "part").agg(F.count("*").alias("n")), "counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `size` rows
    runs = plan(histogram, size)
    columns = tuple(np.array(x, np.int64) for x in zip(*sorted(runs))) if runs else tuple(np.zeros((5, 0), np.int64))
    before = F.sum("n").over(W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    starts = counts.select("length", "part", F.coalesce(before, F.lit(0)).alias("before"))
    ranked = cut.join(starts, ["length", "part"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("place")).alias("rank"))
    # the plan's size follows the number of lengths, not of documents
    shared = spark.sparkContext.broadcast(columns)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths, ranks, _, firsts, offsets = shared.value
        span = int(ranks.max(initial=0)) + 1
        keys = lengths * span + ranks
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            # runs of a length begin where the one before ends
            at = np.searchsorted(keys, length * span + np.minimum(rank, span - 1), side="right") - 1
            sequence = firsts[at] + rank - ranks[at]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offsets[at])], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
