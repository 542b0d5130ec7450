"""Operator 10: language identification by multilingual mixture inference.

A language is a distribution over letter trigrams, counted over all its training documents. A document's trigrams
come from a mixture of languages; expectation-maximisation estimates the shares. Of the sets of its strongest
languages the one with the best likelihood, less half the logarithm of the trigram count for each further
language, is chosen, and the language with the largest share in it is the prediction. The score is that
language's share in the mixture of all languages.

Trigrams are hashed into GRAMS cells, so the model is one row of GRAMS numbers a language however much text there
is, and tasks send on sums alone.

Defined results: a null text, one without letters, and any text where no language was learned is `und` with score
0. Repeated rows get equal results and count as often as they stand in training. A null lang teaches nothing; a
null doc_id counts as the empty text in the split. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from watchgrid.llm.common import split_of, table

GRAMS = 1 << 15
#: Weight of a cell that a language never used.
SMOOTH = 0.1
#: Share below which a language is not tried in a set.
LEAST = 0.02
ROUNDS = 15


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """For each code point itself if it is a letter, else 0."""
    return np.array([c if chr(c).isalpha() else 0 for c in range(0x110000)], np.uint32)


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The trigram cells of a text and how often each occurs; a word has a blank on either side."""
    code = letters()[np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)]
    code = code[np.r_[True, (code[1:] != 0) | (code[:-1] != 0)]]
    if len(code) < 3:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    a, b, c = code[:-2], code[1:-1], code[2:]
    with np.errstate(over="ignore"):
        mixed = a * np.uint32(2654435761) ^ b * np.uint32(2246822519) ^ c * np.uint32(3266489917)
        mixed ^= mixed >> np.uint32(15)
        cell = (mixed * np.uint32(668265263)) >> np.uint32(17)
    return np.unique(cell[b != 0].astype(np.int64), return_counts=True)


def count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, np.ndarray] = {}

    def rows(lang: str, n: np.ndarray) -> pa.RecordBatch:
        cell = np.flatnonzero(n)
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(cell), pa.string()), pa.array(cell, pa.int32()), pa.array(n[cell])], ["lang", "cell", "n"])

    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
            if lang not in held:
                if len(held) >= 64:
                    yield rows(*held.popitem())
                held[lang] = np.zeros(GRAMS, np.int64)
            cell, n = grams(text)
            held[lang][cell] += n
    yield from (rows(lang, n) for lang, n in held.items())


def learn(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """The languages and their trigram distributions, from all rows of docs (text, lang)."""
    some = docs.where("lang is not null and text is not null").select("text", "lang")
    sums = some.mapInArrow(count_grams, "lang string, cell int, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(sums["lang"].unique())
    table_ = np.full((len(langs), GRAMS), SMOOTH)
    table_[np.searchsorted(langs, sums["lang"].to_numpy(dtype=str)) if langs else [], sums["cell"].to_numpy(dtype=np.int64)] += sums["n"].to_numpy(dtype=np.float64)
    return langs, (table_ / table_.sum(1, keepdims=True)).astype(np.float32)


def shares(like: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Shares of the mixture of the rows of like (languages by trigrams) that fit the counts n best, by EM."""
    part = np.full(len(like), 1 / len(like))
    for _ in range(ROUNDS):
        weight = n / np.maximum(part @ like, 1e-300)
        new = part * (like @ weight) / n.sum()
        moved = np.abs(new - part).max()
        part = new
        if moved < 1e-4:
            break
    return part


def predict(text: str | None, langs: list[str], model: np.ndarray) -> tuple[str, float]:
    if not text or not langs:
        return "und", 0.0
    cell, n = grams(text)
    if not len(cell):
        return "und", 0.0
    like, n = model[:, cell].astype(np.float64), n.astype(np.float64)
    part = shares(like, n)
    order = np.argsort(-part, kind="stable")
    order = order[part[order] >= LEAST]
    total = n.sum()
    alone = np.log(like) @ n
    first = int(np.argmax(alone))
    best, chosen = alone[first], first
    for size in range(2, len(order) + 1):
        some = order[:size]
        own = shares(like[some], n)
        fit = np.log(own @ like[some]) @ n - (size - 1) / 2 * np.log(total)
        if fit > best:
            best, chosen = fit, int(some[np.argmax(own)])
    return langs[chosen], float(min(1.0, max(0.0, part[chosen])))


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray], keys: tuple[str, ...] = ("doc_id", "held_out")) -> DataFrame:
    """The key columns, lang_pred and score of each row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # GRAMS numbers a language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, like = shared.value
        for batch in batches:
            got = [predict(t, langs, like) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], [*keys, "lang_pred", "score"])

    held = docs.select(*keys, "text")
    kinds = ", ".join(f"{k} {t}" for k, t in held.dtypes if k != "text")
    return held.mapInArrow(run, f"{kinds}, lang_pred string, score double")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", (split_of(F.col("doc_id"), 3) == 1).alias("held_out"))
    return identify(docs, learn(docs.where("not held_out")))
