"""Operator 12 against brute force."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from watchgrid.llm import periodic_runs as P

SF = "/root/testdata/sf0.001"


def brute(ids, least=12):
    """Each period's maximal stretches, the smallest period of each first."""
    found, n = {}, len(ids)
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and ids[j] == ids[j + p]:
                j += 1
            if j - i >= p and j - i + p >= least:
                found.setdefault((i, j - i + p), p)
            i = j + 1 if j == i else j
    return sorted((s, n, p) for (s, n), p in found.items())


@pytest.mark.parametrize("grid", [1 << 16, 40, 7])
def test_runs_of_random_sequences(grid):
    rng = random.Random(grid)
    for _ in range(400):
        n, kinds = rng.randint(0, 120), rng.choice([1, 2, 2, 3, 4])
        ids = [rng.randrange(kinds) for _ in range(n)]
        if n > 5 and rng.random() < 0.6:
            a = rng.randrange(n)
            p = rng.randint(1, max(1, (n - a) // 2))
            ids = ids[:a] + [ids[a + (i - a) % p] for i in range(a, n)]
        if rng.random() < 0.3:
            ids = (ids * 3)[:150]
        assert P.runs(np.array(ids, np.int64), grid=grid) == brute(ids)


def test_runs_of_a_fibonacci_word_and_of_one_word():
    a, b = [0], [0, 1]
    while len(b) < 900:
        a, b = b, b + a
    assert P.runs(np.array(b)) == brute(b)
    assert P.runs(np.zeros(300_000, np.int64)) == [(0, 300_000, 1)]


def expected(doc_id, text):
    words = [w for w in re.split("[\x20\x09-\x0d]+", text or "") if w]
    h, n = zlib.crc32(("" if doc_id is None else str(doc_id)).encode()), len(words)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = brute(words)
    gone = {i for s, m, p in found for i in range(s + p, s + m)}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    return (
        *(doc_id, len(found), *best, best[0] if best[0] is None else 1000 * best[1] // best[2]),
        sha("".join(f"{s},{m},{p}\n" for s, m, p in found)),
        sha(" ".join(w for i, w in enumerate(words) if i not in gone)),
    )


def test_query(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").where("length(text) < 3000").collect()
    rows = [(r.doc_id, r.text) for r in docs]
    rows += [(k, " ".join(["so it goes"] * 9 + ["and then"] * 7 + ["é"])) for k in range(1000, 1030)]
    rows += [(2000, None), (2001, ""), (2002, " \n"), (2003, "one"), (2003, "one"), (None, "a b " * 30), (None, None), (2004, "\x1c\x85 " * 12)]
    spark.createDataFrame([(*r, "x", "y", "z") for r in rows], "doc_id long, text string, runs string, start string, n_words string").write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in P.op12_periodic_runs(spark, str(tmp_path)).collect()]
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(got, key=key) == sorted((expected(*r) for r in rows), key=key)
    assert sum(r[1] for r in got) > 30
    spark.read.parquet(f"{tmp_path}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert P.op12_periodic_runs(spark, f"{tmp_path}/none").count() == 0
