"""Operator 3: quality classifier with random Fourier features and isotonic calibration.

A document is a short vector of statistics. Random Fourier features of the standardised vector approximate a
Gaussian kernel; ridge regression on them is solved from normal equations, which are sums over rows: each task
adds up its own and Spark adds the tasks'. The equations are kept for each fold, so that the scores that isotonic
regression learns its steps from come from models that never saw their rows. Only sums of fixed size reach the
driver: the equations, and counts of labels by score bin.

The fit takes SAMPLE labelled rows at most, chosen by a hash of the doc_id; statistics, scores and calibration
cover all rows.

Defined results: null and empty texts have the statistics of a text without words and are scored as such. Without
any labelled training row every score is 0.5. A null label teaches nothing; several labels of a document all
count. A null doc_id has no label and counts as the empty text in the split. Repeated rows get equal scores. Extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from watchgrid.llm.common import materialize, split_of, table
from watchgrid.llm.quality_rules import COUNTS, statistics

SAMPLE = 2_000_000
WIDTH, GAMMA, RIDGE, FOLDS, BINS, TASKS = 128, 0.25, 1e-3, 4, 512, 16


UPPER = {c: None for c in range(65, 91)}


def vector(text: str) -> list[float]:
    """Document statistics: sizes as logarithms, and rates."""
    s = dict(zip(COUNTS, statistics(text)))
    words, lines, chars = max(1, s["n_words"]), max(1, s["n_lines"]), max(1, s["word_chars"])
    capitals = len(text) - len(text.translate(UPPER))
    return [
        float(np.log1p(s["n_words"])),
        float(np.log1p(s["n_lines"])),
        s["word_chars"] / words,
        float(np.log1p(20 * s["n_symbols"] / words)),
        s["n_marked"] / words,
        s["n_dup_lines"] / lines,
        s["n_repeat_words"] / words,
        s["n_distinct"] / words,
        s["n_digits"] / chars,
        s["n_ended"] / lines,
        s["n_letters"] / words,
        s["n_stops"] / words,
        text.count(",") / words,
        capitals / words,
        float(np.log1p(s["n_words"] / lines)),
    ]


SIZE = len(vector(""))


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def vector_of(texts: pa.Array) -> pa.Array:
    return pa.array([vector(t or "") for t in texts.to_pylist()], pa.list_(pa.float64()))


class Features:
    """The standardisation and the random features; equal seeds give equal features."""

    def __init__(self, mean: np.ndarray, spread: np.ndarray, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.mean, self.spread = mean, spread
        self.turn = rng.normal(size=(SIZE, WIDTH)) * np.sqrt(2 * GAMMA / SIZE)
        self.phase = rng.uniform(0, 2 * np.pi, WIDTH)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        x = np.clip((x - self.mean) / self.spread, -6, 6)
        return np.hstack([np.cos(x @ self.turn + self.phase) * np.sqrt(2 / WIDTH), x / SIZE, np.ones((len(x), 1))])


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, SIZE)


def equations(rows: DataFrame, features: Features) -> tuple[np.ndarray, np.ndarray]:
    """Per fold the sums of z zᵀ and of z y over rows (x, y, fold)."""
    wide = WIDTH + SIZE + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((FOLDS, wide, wide + 1))
        for batch in batches:
            if not len(batch):
                continue
            z, y, fold = features(matrix(batch.column("x"))), batch.column("y").to_numpy(), batch.column("fold").to_numpy()
            for k in range(FOLDS):
                own = z[fold == k]
                sums[k] += own.T @ np.column_stack([own, y[fold == k]])
        cell = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), pa.array(sums.ravel()[cell])], ["cell", "value"])

    cells = rows.select("x", "y", "fold").mapInArrow(run, "cell int, value double").groupBy("cell").agg(F.sum("value").alias("value")).toPandas()
    sums = np.zeros(FOLDS * wide * (wide + 1))
    sums[cells["cell"].to_numpy(dtype=np.int64)] = cells["value"].to_numpy(dtype=float)
    sums = sums.reshape(FOLDS, wide, wide + 1)
    return sums[:, :, :-1], sums[:, :, -1]


def solve(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    penalty = np.eye(len(a)) * RIDGE * max(1.0, a[-1, -1])
    penalty[-1, -1] = 1e-9
    return np.linalg.solve(a + penalty, b)


def isotonic(yes: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The rising sequence closest to yes / n by weight n, by pooling neighbours that fall."""
    blocks: list[list[float]] = []
    for a, b in zip(yes, n):
        blocks.append([a, b, 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            a2, b2, c2 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + a2, blocks[-1][1] + b2, blocks[-1][2] + c2]
    return np.concatenate([np.full(int(c), a / b) for a, b, c in blocks])


class Model:
    def __init__(self, features: Features | None, weights: np.ndarray | None, knots: np.ndarray | None, values: np.ndarray | None) -> None:
        self.features, self.weights, self.knots, self.values = features, weights, knots, values

    def __call__(self, x: np.ndarray) -> np.ndarray:
        if self.features is None:
            return np.full(len(x), 0.5)
        return np.interp(self.features(x) @ self.weights, self.knots, self.values)


def fit(rows: DataFrame) -> Model:
    """A model from all rows (doc_id, x, y)."""
    means = rows.select(F.count("*"), *(f(F.col("x")[k]) for k in range(SIZE) for f in (F.avg, F.stddev_pop))).first()
    if not means[0]:
        return Model(None, None, None, None)
    features = Features(np.array(means[1::2]), np.maximum(np.array(means[2::2]), 1e-3))
    few = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < max(1, int((1 << 20) * min(1.0, SAMPLE / means[0])))) if means[0] > SAMPLE else rows
    a, b = equations(few.repartition(TASKS), features)
    folds = [solve(a.sum(0) - a[k], b.sum(0) - b[k]) for k in range(FOLDS)]

    def bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            z, fold = features(matrix(batch.column("x"))), batch.column("fold").to_numpy()
            raw = (z @ np.array(folds).T)[np.arange(len(z)), fold]
            cell = ((np.clip(raw, -0.5, 1.5) + 0.5) / 2 * (BINS - 1)).round().astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(cell), batch.column("y")], ["cell", "y"])

    got = rows.select("x", "y", "fold").mapInArrow(bins, "cell int, y double").groupBy("cell").agg(F.sum("y").alias("yes"), F.count("*").alias("n")).orderBy("cell").toPandas()
    # half a row of either label at the ends, so that no score is certain
    yes, n = got["yes"].to_numpy(dtype=float), got["n"].to_numpy(dtype=float)
    values = isotonic(yes, n)
    total = n.sum()
    values = (values * total + 0.5) / (total + 1)
    # between the middles of bins scores rise evenly; a slight slope keeps the order within a step
    knots = got["cell"].to_numpy(dtype=float) / (BINS - 1) * 2 - 0.5
    knots, values = np.r_[-2.0, knots, 3.0], np.r_[values[0], values, values[-1]]
    values = np.clip(values * (1 - 1e-3) + 1e-3 * (knots + 2) / 5, 0, 1)
    return Model(features, solve(a.sum(0), b.sum(0)), knots, values)


def score(vectors: DataFrame, model: Model) -> DataFrame:
    shared = vectors.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = shared.value(matrix(batch.column("x")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(got), pa.array((got >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return vectors.select("doc_id", "held_out", "x").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def op3_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    vectors = materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), (split_of(F.col("doc_id"), 3) == 1).alias("held_out"), vector_of("text").alias("x")), "vectors")
    labels = table(spark, sf_dir, "labels").where("quality is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("y"))
    rows = vectors.where("not held_out").join(labels, "doc_id").select("doc_id", "x", "y", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(FOLDS)).cast("int").alias("fold"))
    return score(vectors, fit(materialize(rows, "labelled")))
