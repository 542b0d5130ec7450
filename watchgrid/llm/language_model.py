"""Operator 7: language-model scores by a log-bilinear model trained with noise-contrastive estimation.

Token counts are gathered from all training texts and stay a table. Each token that makes up SHARE of all tokens or
more, and occurs LEAST times, has vectors of its own, so their number follows the corpus; the end has some as well.
Every other token belongs to one of BUCKETS classes by its last two bytes. A token's probability is that of its
class after the two tokens before it, times its share of its class by counts. The class model is log-bilinear: a
class scores by the product of its vector with the sum of the context's two, the nearer token by its own class, the
further one by one of GROUPS groups.

What is learnt from is a table of (context, class) counts of all training texts; it grows with them. It is dealt
over tasks by hash. A round sends the parameters to the tasks; each draws from its part, by the counts and as often
as it has cells, and takes minibatches down the noise-contrastive gradient with noise drawn by the classes'
frequencies. Spark then averages each vector over the tasks, weighted by how often they drew it. At the end
batched matrix products sum over all classes after each context once, so that scores are normalised.

The commonest tokens, at most HEAVY of them, go to the tasks with their counts; a histogram of the counts says from
which count on. Occurrences of rarer ones are joined to the counts by token and summed by row, so no common token
meets in one task and no count table is sent whole.

Defined results: a null text is empty; an empty text is the end token alone. Without training texts every token
has base score 0, and classes are uniform. Repeated rows count and are scored as often as they stand there. A null
doc_id counts as the empty text in the split. Extra columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from watchgrid.llm.common import materialize, split_of, table

END = b""
SHARE, LEAST, BUCKETS, GROUPS, HEAVY = 2e-5, 3, 128, 8, 60_000
DIM, NOISE, SHARED, ROUNDS, RATE, START, BATCH = 32, 16, 256, 4, 0.08, 1.0, 4096
#: Cells of the table that one task trains on.
PART = 1 << 20
#: Different tokens that a task counts, and pairs that it holds, before it sends them on.
COUNTED, HELD = 400_000, 1 << 21
#: Bytes of text that are read together.
TOGETHER = 1 << 17


def count_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter[bytes] = Counter()

    def rows() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.binary()), pa.array(counts.values(), pa.int64())], ["token", "n"])

    for batch in batches:
        for text in batch.column("text").cast(pa.large_binary()):
            counts.update((text.as_py() or b"").lower().split())
            counts[END] += 1
            if len(counts) > COUNTED:
                yield rows()
                counts.clear()
    yield rows()


def bucket(token: bytes) -> int:
    return zlib.crc32(token[-2:]) % BUCKETS


@dataclass
class Known:
    """What tasks know of tokens: the commonest by place, with class and log10(count + 1).

    Class 0 is the end, then come the buckets, then the tokens with vectors of their own.
    """

    place: dict[bytes, int]
    classes: np.ndarray
    logs: np.ndarray
    #: log10 of the size of each class by counts, with one for a token never seen; 0 for classes of one token
    sizes: np.ndarray
    #: share of each class in the training tokens, smoothed by one
    noise: np.ndarray
    tokens: int
    distinct: int

    def read(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[Counter[bytes]]]:
        """Of the tokens of texts, one text after the other, each with its end: place (-1: not there) and class.

        Then where each text starts, and for each its tokens that have no place.
        """
        words: list[bytes] = []
        ends = []
        for text in texts:
            words += text.lower().split()
            words.append(END)
            ends.append(len(words))
        at = np.fromiter(map(self.place.get, words, repeat(-1)), np.int64, len(words))
        classes = self.classes[at]
        others: list[Counter[bytes]] = [Counter() for _ in texts]
        rare = np.flatnonzero(at < 0)
        for k, text in zip(rare.tolist(), np.searchsorted(ends, rare, "right").tolist()):
            word = words[k]
            if word != END:
                others[text][word] += 1
            classes[k] = 1 + bucket(word) if word != END else 0
        return at, classes, np.r_[0, ends[:-1]].astype(np.int64), others


def contexts(classes: np.ndarray, starts: np.ndarray, total: int) -> np.ndarray:
    """The context of each token of texts: the class before it (total: none), and the group of the one before that."""
    near = np.r_[total, classes[:-1]]
    far = np.r_[0, 0, 1 + classes[:-2] % (GROUPS - 1)][: len(classes)]
    near[starts] = total
    far[starts] = 0
    far[np.minimum(starts + 1, len(far) - 1)] = 0  # a text's second token; where a text has none, the next one's first
    return near * GROUPS + far


def in_parts(texts: Iterator[bytes]) -> Iterator[list[bytes]]:
    """Texts in lists of some TOGETHER bytes."""
    held: list[bytes] = []
    size = 0
    for text in texts:
        held.append(text)
        size += len(text)
        if size >= TOGETHER:
            yield held
            held, size = [], 0
    if held:
        yield held


def least_count(counts: DataFrame, most: int = HEAVY) -> int:
    """From which count on there are at most so many tokens, by a histogram with some five hundred bars."""
    bar = F.floor(F.log2("n") * 8)
    bars = counts.groupBy(bar.alias("bar")).agg(F.count("*").alias("c")).orderBy(F.desc("bar")).collect()
    total, low = 0, None
    for r in bars:
        total += r["c"]
        if total > most:
            break
        low = r["bar"]
    return max(1, math.ceil(2 ** (low / 8) - 1e-9)) if low is not None else 1 << 62


def know(counts: DataFrame) -> Known:
    totals = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    heavy = counts.where(F.col("n") >= least_count(counts)).toPandas().sort_values(["n", "token"], ascending=[False, True])
    tokens, n = [bytes(t) for t in heavy["token"]], heavy["n"].to_numpy(dtype=np.int64)
    classes = np.array([1 + bucket(t) for t in tokens] + [0], np.int64)  # the last place is read for -1, and replaced
    own = [k for k, t in enumerate(tokens) if t != END and n[k] >= max(LEAST, SHARE * int(totals["n"]))]
    classes[own] = np.arange(1 + BUCKETS, 1 + BUCKETS + len(own))
    place = {t: k for k, t in enumerate(tokens)}
    if END in place:
        classes[place[END]] = 0
    cell = (F.crc32(F.substring("token", -2, 2)) % BUCKETS).cast("int")
    size = np.ones(1 + BUCKETS + len(own))  # for a token never seen
    for r in counts.where(F.octet_length("token") > 0).groupBy(cell.alias("cell")).agg((F.sum("n") + F.count("*")).alias("n")).collect():
        size[1 + r["cell"]] += r["n"]
    for k in own:
        size[1 + bucket(tokens[k])] -= n[k] + 1
    ends = counts.where(F.octet_length("token") == 0).agg(F.sum("n")).first()[0] or 0
    often = np.r_[ends, size[1 : 1 + BUCKETS] - 1, n[own]] + 1.0
    size[0] = 1
    size[1 + BUCKETS :] = 1
    return Known(place, classes, np.r_[np.log10(n + 1.0), 0.0], np.log10(np.maximum(size, 1)), often / often.sum(), int(totals["n"]), int(totals["v"]))


def gather(docs: DataFrame, known: Known) -> DataFrame:
    """cell and n: how often each class followed each context, over all rows of docs (text)."""
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = len(shared.value.noise)

        def rows(held: list[np.ndarray]) -> pa.RecordBatch:
            cell, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(cell, pa.int64()), pa.array(n, pa.int64())], ["cell", "n"])

        held: list[np.ndarray] = []
        size = 0
        for batch in batches:
            for texts in in_parts(t.as_py() or b"" for t in batch.column("text").cast(pa.large_binary())):
                _, classes, starts, _ = shared.value.read(texts)
                held.append(contexts(classes, starts, total) * total + classes)
                size += len(classes)
                if size > HELD:
                    yield rows(held)
                    held, size = [], 0
        if held:
            yield rows(held)

    return materialize(docs.select("text").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")), "pairs")


@dataclass
class Model:
    """Vectors of the nearer token's class, the further one's group and the class to come, and the latter's bias."""

    near: np.ndarray
    far: np.ndarray
    to: np.ndarray
    bias: np.ndarray
    #: natural logarithm of the sum over all classes after each context
    norms: np.ndarray | None = None

    def scores(self, context: np.ndarray, classes: np.ndarray) -> np.ndarray:
        """log10 probability of each class after its context."""
        near, far = np.divmod(context, GROUPS)
        raw = np.einsum("ij,ij->i", self.near[near] + self.far[far], self.to[classes]) + self.bias[classes]
        return (raw - self.norms[near, far]) / np.log(10)


def started(noise: np.ndarray, seed: int = 3) -> Model:
    """A model that gives each class its share, whatever the context."""
    rng = np.random.default_rng(seed)
    made = lambda n: rng.normal(0, 0.1, (n, DIM)).astype(np.float32)
    return Model(made(len(noise) + 1), made(GROUPS), made(len(noise)), np.log(noise).astype(np.float32))


def descend(model: Model, noise: np.ndarray, cells: np.ndarray, n: np.ndarray, rate: float, seed: int) -> tuple[Model, list[np.ndarray]]:
    """The model after minibatches of noise-contrastive estimation over draws from cells, and how often each row was drawn."""
    rng = np.random.default_rng(seed)
    total = len(noise)
    near, far, to, bias = model.near.copy(), model.far.copy(), model.to.copy(), model.bias.copy()
    squares = [np.full(len(x), START, np.float32) for x in (near, far, to, bias)]
    drawn = [np.zeros(len(x)) for x in (near, far, to)]
    by_count, by_noise = np.cumsum(n), np.cumsum(noise)
    shift = np.log(NOISE * noise).astype(np.float32)

    def move(params: np.ndarray, k: int, rows: np.ndarray, grads: np.ndarray) -> None:
        """An adaptive step for the rows drawn, repeated ones summed."""
        order = np.argsort(rows, kind="stable")
        rows = rows[order]
        first = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
        summed, rows = np.add.reduceat(grads[order], first, axis=0), rows[first]
        squares[k][rows] += (summed * summed).mean(-1) if summed.ndim > 1 else summed * summed
        step = rate / np.sqrt(squares[k][rows])
        params[rows] += summed * (step[:, None] if summed.ndim > 1 else step)

    for _ in range(-(-len(cells) // BATCH)):
        at = cells[np.searchsorted(by_count, rng.random(BATCH) * by_count[-1], "right").clip(max=len(cells) - 1)]
        context, w = np.divmod(at, total)
        a, b = np.divmod(context, GROUPS)
        fake = np.searchsorted(by_noise, rng.random(SHARED), "right").clip(max=total - 1)
        sums = near[a] + far[b]
        # up for real ones taken for noise
        up = (1 - 1 / (1 + np.exp(shift[w] - bias[w] - np.einsum("ij,ij->i", sums, to[w])))).astype(np.float32)
        # down for noise taken for real
        down = sums @ -to[fake].T
        down += shift[fake] - bias[fake]
        np.exp(down, out=down)
        down += 1
        np.divide(np.float32(-NOISE / SHARED), down, out=down)
        back = up[:, None] * to[w] + down @ to[fake]
        move(to, 2, np.r_[w, fake], np.concatenate([up[:, None] * sums, down.T @ sums]))
        move(bias, 3, np.r_[w, fake], np.r_[up, down.sum(0)])
        move(near, 0, a, back)
        move(far, 1, b, back)
        for k, rows in enumerate((a, b, w)):
            np.add.at(drawn[k], rows, 1)
    return Model(near, far, to, bias), drawn


COLUMNS = ["part", "row", "n", *(f"v{k}" for k in range(DIM + 1))]


def train(table: DataFrame, known: Known, rounds: int = ROUNDS) -> Model:
    """A model fitted to table (cell, n); without cells it is the classes' shares."""
    spark, noise = table.sparkSession, known.noise
    model = started(noise)
    cells = table.count()
    if cells:
        parts = -(-cells // PART)
        table = materialize(table.repartition(parts, "cell"), "cells")
        for step in range(rounds):
            shared = spark.sparkContext.broadcast((model, noise, RATE * (1 - step / rounds)))

            def run(batches: Iterator[pa.RecordBatch], shared=shared, step=step) -> Iterator[pa.RecordBatch]:
                model, noise, rate = shared.value
                held = list(batches)
                cells = np.concatenate([b.column("cell").to_numpy() for b in held] or [np.empty(0, np.int64)])
                if not len(cells):
                    return
                n = np.concatenate([b.column("n").to_numpy() for b in held])
                order = np.argsort(cells)  # the same draws, whatever order rows come in
                new, drawn = descend(model, noise, cells[order], n[order], rate, step + 1000 * int(cells[order[0]] % 999))
                for part, (vectors, bias, count) in enumerate(((new.near, None, drawn[0]), (new.far, None, drawn[1]), (new.to, new.bias, drawn[2] + 1))):
                    rows = np.flatnonzero(count)
                    values = np.concatenate([vectors[rows], (bias[rows] if bias is not None else np.zeros(len(rows)))[:, None]], axis=1) * count[rows, None]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), part), pa.int32()), pa.array(rows, pa.int64()), pa.array(count[rows]), *(pa.array(values[:, k].astype(np.float64)) for k in range(DIM + 1))], COLUMNS)

            kinds = "part int, row long, n double, " + ", ".join(f"v{k} double" for k in range(DIM + 1))
            sums = table.mapInArrow(run, kinds).groupBy("part", "row").agg(*[F.sum(c).alias(c) for c in COLUMNS[2:]]).toArrow()
            part, row, n = (sums.column(c).to_numpy() for c in COLUMNS[:3])
            values = np.stack([sums.column(c).to_numpy() for c in COLUMNS[3:]], axis=1) / n[:, None]
            near, far, to, bias = model.near.copy(), model.far.copy(), model.to.copy(), model.bias.copy()
            for k, vectors in enumerate((near, far, to)):
                vectors[row[part == k]] = values[part == k, :DIM]
            bias[row[part == 2]] = values[part == 2, DIM]
            model = Model(near, far, to, bias)
            shared.destroy()
    model.norms = norms(spark, model)
    return model


def norm(model: Model, near: np.ndarray) -> np.ndarray:
    """The logarithm of the sum over all classes, for each class before and each group."""
    out = np.empty((len(near), GROUPS))
    size = max(1, (1 << 22) // len(model.to) // GROUPS)
    for k in range(0, len(near), size):
        sums = (model.near[near[k : k + size], None] + model.far[None]).reshape(-1, DIM)
        raw = sums @ model.to.T + model.bias
        top = raw.max(1)
        out[k : k + size] = (top + np.log(np.exp(raw - top[:, None]).sum(1, dtype=np.float64))).reshape(-1, GROUPS)
    return out


def norms(spark: SparkSession, model: Model) -> np.ndarray:
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                found = norm(shared.value, batch.column("id").to_numpy())
                yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(found[:, k]) for k in range(GROUPS))], ["id", *(f"g{k}" for k in range(GROUPS))])

    total = len(model.near)
    rows = spark.range(total).repartition(-(-total // 512)).mapInArrow(run, "id long, " + ", ".join(f"g{k} double" for k in range(GROUPS))).toArrow()
    out = np.empty((total, GROUPS))
    out[rows.column("id").to_numpy()] = np.stack([rows.column(f"g{k}").to_numpy() for k in range(GROUPS)], axis=1)
    return out


def score(docs: DataFrame, counts: DataFrame, known: Known, model: Model) -> DataFrame:
    """The result columns for each row of docs (doc_id, held_out, text)."""
    shared = docs.sparkSession.sparkContext.broadcast((known, model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, model = shared.value
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for texts in in_parts(t.as_py() or b"" for t in batch.column("text").cast(pa.large_binary())):
                at, classes, starts, rare = known.read(texts)
                logs = known.logs[at]
                each = model.scores(contexts(classes, starts, len(known.noise)), classes) - known.sizes[classes]
                each += np.where((classes > 0) & (classes <= BUCKETS), logs, 0.0)
                sums = lambda x: np.add.reduceat(x, starts)  # noqa: E731, B023
                for column, values in zip(out, (np.diff(np.r_[starts, len(at)]), sums((at >= 0).astype(np.int64)), sums(logs), sums(each))):
                    column += values.tolist()
                out[4] += [list(r.items()) for r in rare]
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.map_(pa.binary(), pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), *(pa.array(c, k) for c, k in zip(out, kinds))], ["doc_id", "held_out", "n_tokens", "n_known", "logs", "score", "rare"])

    kinds = "doc_id long, held_out boolean, n_tokens long, n_known long, logs double, score double, rare map<binary,long>"
    read = docs.select("doc_id", "held_out", "text").mapInArrow(run, kinds)
    rows = materialize(read.withColumn("row", F.monotonically_increasing_id()), "read")
    others = rows.select("row", F.explode("rare").alias("token", "times")).join(counts, "token")
    sums = others.groupBy("row").agg(F.sum("times").alias("known"), F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("more"))
    known_too, more = F.coalesce("known", F.lit(0)), F.coalesce("more", F.lit(0.0))
    each = float(np.log10(known.tokens + known.distinct + 1))
    return rows.drop("rare").join(sums, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + known_too).alias("n_known"), F.lit(known.tokens).cast("long").alias("train_tokens"), (F.col("logs") + more - F.col("n_tokens") * each).alias("base_score"), (F.col("score") + more).alias("score")
    )


def op7_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text", (split_of(F.col("doc_id"), 7) == 2).alias("held_out"))
    training = docs.where("not held_out")
    counts = materialize(training.select("text").mapInArrow(count_tokens, "token binary, n long").groupBy("token").agg(F.sum("n").alias("n")), "counts")
    known = know(counts)
    return score(docs, counts, known, train(gather(training, known), known))
