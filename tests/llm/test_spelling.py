"""Operator 11 against brute force."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import pytest

from watchgrid.llm import spelling as S

SF = "/root/testdata/sf0.001"


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def expected(counts):
    forms, out = {}, {}
    for w, n in counts.items():
        close = sorted((-m, v) for v, m in counts.items() if near(w, v))
        form = close[0][1] if close and -close[0][0] >= 5 * n else None
        forms[w] = form
        out[w] = [form, n, len(close), counts[form] if form else None]
    rows = []
    for w, (form, n, many, m) in out.items():
        root = w
        while forms[root]:
            root = forms[root]
        rows.append((w, form, root, n, many, m))
    return sorted(rows, key=lambda r: r[0])


def counts_of(docs):
    counts = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
            if h % 199 == 0:
                w = "".join(c for k, c in enumerate(w) if k != h % len(w))
            counts[w] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


@pytest.fixture(scope="module")
def made(spark):
    rng = random.Random(5)
    base = ["".join(rng.choice("abé") for _ in range(rng.randint(6, 12))) for _ in range(150)] + ["aaaaaa", "aaaaaaa", "a" * 300, "a" * 299, "a" * 150 + "b" + "a" * 150]
    words = set(base)
    for w in base:
        k = rng.randrange(len(w))
        words |= {w[:k] + w[k + 1 :], w[:k] + "c" + w[k:], w[:k] + "à" + w[k + 1 :]}
    words |= {f"common{chr(97 + a)}{chr(97 + b)}" for a in range(12) for b in range(12)}
    return {w: rng.choice([5, 6, 25, 30, 125, 700, 4000]) for w in sorted(words) if len(w) >= 6}


@pytest.mark.parametrize("heavy", [S.HEAVY, 3])
def test_variants(spark, made, heavy):
    got = S.variants(spark.createDataFrame(list(made.items()), "word string, n long"), heavy=heavy).collect()
    assert sorted(map(tuple, got), key=lambda r: r[0]) == expected(made)


def test_pairs_of_a_cell_with_one_free_place():
    words = ["abcdefgh", "abcxefgh", "abcyefgh", "abcdzefgh"]
    assert sorted(S.near_in_cell(words, 8, 3, 4)) == sorted((a, b) for i, a in enumerate(words) for b in words[i + 1 :] if near(a, b))


def test_query(spark, tmp_path):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    docs += [(k, f"Wonderful WONDERFUL wonderful-wonderful {'wonderfull' if k % 4 else 'wonderfu'} Ünderneath ünderneath niñerías3niñería") for k in range(5000, 5040)]
    docs += [(6000, None), (6001, ""), (None, "wonderful wonderfull"), (None, None), (6002, "é" * 4000), (6003, "wonderful"), (6003, "wonderful")]
    frame = spark.createDataFrame([(*r, "x", "y", "z", "d") for r in docs], "doc_id long, text string, word string, n string, form string, d string")
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, S.op11_spelling(spark, str(tmp_path)).collect()), key=lambda r: r[0])
    assert got == expected(counts_of(docs))
    assert sum(r[1] is not None for r in got) > 2
    frame.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert S.op11_spelling(spark, f"{tmp_path}/none").count() == 0
