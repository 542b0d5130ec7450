"""Near copies against brute force."""

from __future__ import annotations

import random

import pytest

from watchgrid.llm import similar


def brute(texts: dict[int, str | None]) -> set[int]:
    """The smallest id of each group of similar texts."""
    sets = {}
    for k, t in texts.items():
        w = (t or "").lower().split()
        sets[k] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    root = {k: k for k in texts}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    keys = sorted(texts)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            o = len(sets[a] & sets[b])
            if sets[a] == sets[b] or 9 * o >= 4 * (len(sets[a]) + len(sets[b])):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {find(k) for k in keys}


@pytest.mark.parametrize("share", [3, 1024])
def test_keep_one_by_brute_force(spark, monkeypatch, share):
    monkeypatch.setattr(similar, "SHARE", share)
    rng = random.Random(1)
    words = [f"w{k}" for k in range(400)]
    line = rng.choices(words, k=30)
    texts: dict[int, str | None] = {0: None, 1: "", 2: " \n", 3: "One two", 4: "one  two", 5: "one two three"}
    for _ in range(25):
        base = rng.choices(words, k=rng.choice([8, 40, 64, 250])) + line * rng.randrange(2)
        texts[len(texts)] = " ".join(base)
        for _ in range(rng.randrange(6)):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 2, 3, 5, 8])):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts[len(texts)] = " ".join(copy[: len(copy) - rng.randrange(3)])
            if rng.randrange(3) == 0:
                base = copy  # chains
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    kept = similar.keep_one(docs).collect()
    assert sorted(r.doc_id for r in kept) == sorted(brute(texts))


def test_shared_sentences_give_few_candidates(spark):
    """Documents of ten sentences out of 200: none similar, and pairs in proportion to the documents."""
    rng = random.Random(3)
    lines = [" ".join(rng.choices([f"w{k}" for k in range(900)], k=12)) for _ in range(200)]
    counts = []
    for n in (300, 1200):
        docs = similar.with_row_key(spark.createDataFrame([(k, " ".join(rng.sample(lines, 10))) for k in range(n)], "doc_id long, text string"))
        sets = similar.materialize(docs.select(*similar.ROW, similar.signature_of("text").alias("s")).select(*similar.ROW, "s.*"), "sets")
        counts.append(similar.candidates(sets).count())
    assert counts[1] < 8 * max(20, counts[0])


@pytest.mark.parametrize("sf", ["0.01"])
def test_recall_of_similar_pairs(spark, sf):
    """Every pair of similar texts of the corpus falls into one component."""
    docs = similar.with_row_key(spark.read.parquet(f"/root/testdata/sf{sf}/documents.parquet"))
    root = {r.doc_id: r.root for r in similar.components(docs).collect()}
    sets = {r.doc_id: set(similar.shingles((r.text or "").encode()).tolist()) for r in docs.select("doc_id", "text").collect()}
    held: dict[int, list[int]] = {}
    for k, s in sets.items():
        for x in s:
            held.setdefault(x, []).append(k)
    tried = {(a, b) for ks in held.values() if len(ks) < 100 for i, a in enumerate(ks) for b in ks[i + 1 :]}
    pairs = [(a, b) for a, b in tried if 9 * len(sets[a] & sets[b]) >= 4 * (len(sets[a]) + len(sets[b]))]
    joined = sum(root[a] == root[b] for a, b in pairs)
    assert len(pairs) > 100 and joined >= 0.99 * len(pairs), (joined, len(pairs))
