"""Operator 13 against brute force."""

from __future__ import annotations

import hashlib
import random
import re

import pytest

from watchgrid.llm import decontaminate as D

SF = "/root/testdata/sf0.001"
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))


def expected(docs, items, width=10):
    windows = {}
    for item_id, text in items:
        w = words(text)
        for k in range(max(1, len(w) - width + 1) if w else 0):
            windows.setdefault(tuple(w[k : k + width]), set()).add(item_id)
    sizes = {len(w) for w in windows}
    out = []
    for doc_id, text in docs:
        w, hit, found = words(text), set(), set()
        for k in range(len(w)):
            for n in sizes:
                if k + n <= len(w) and (held := windows.get(tuple(w[k : k + n]))):
                    hit |= set(range(k, k + n))
                    found |= held
        ids = sorted(str(i) for i in found if i is not None)
        out.append((doc_id, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    return out


def in_order(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r))


@pytest.mark.parametrize("width", [10, 3, 1])
def test_search_of_random_texts(width):
    rng = random.Random(width)
    text = lambda n: " ".join(rng.choice("abcdé") for _ in range(n)).encode()
    items = [(str(k), text(rng.choice([0, 1, 2, 5, 9, 12, 30]))) for k in range(60)] + [("x", None)]
    docs = [text(rng.choice([0, 1, 3, 40, 900])) for _ in range(40)] + [None]
    docs += [b" ".join([text(20), items[k][1], text(20)]) for k in range(60)]
    lib = D.library(items, width)
    got = [(n, sum(b - a for a, b in spans), sorted(i for o in owners for i in lib.items[o])) for n, spans, owners in D.search(lib, docs)]
    want = expected([(k, (d or b"").decode()) for k, d in enumerate(docs)], [(i, (t or b"").decode()) for i, t in items], width)
    assert [(n, h, len(i), hashlib.sha256(",".join(i).encode()).hexdigest()) for n, h, i in got] == [r[1:5] for r in want]


def test_equal_hashes_are_told_apart(monkeypatch):
    """With one hash for all, buckets are compared string by string."""
    monkeypatch.setattr(D, "hashes", lambda ids, starts, width: D.np.zeros(len(starts), D.np.uint64))
    lib = D.library([("a", b"one two three"), ("b", b"one two four"), ("c", b"two three")], 3)
    assert D.search(lib, [b"zero one two three", b"one two five", b"two three four"]) == [(4, [(1, 4)], [0, 2]), (3, [], []), (3, [(0, 2)], [2])]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    top = str(tmp_path_factory.mktemp("tables"))
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    long = items[0][1]
    items += [(900, "Short one!"), (901, "short ONE"), (901, "short ONE"), (902, ""), (903, None), (904, "..."), (None, "of no id at all"), (905, "Ünï-codé 7"), (906, long)]
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    docs += [(k, f"Before. {items[k % 9][1]} after; short, one") for k in range(2000, 2030)]
    docs += [(3000, None), (3001, ""), (3002, "--"), (3003, "it is of No ID at all."), (3003, "it is of No ID at all."), (None, long), (3004, "ünï codé 7 and short one short one"), (3005, " ".join([long] * 300))]
    columns = "n_words string, spans string, items string, f string"
    spark.createDataFrame([(*r, *"wxyz") for r in docs], f"doc_id long, text string, {columns}").write.parquet(f"{top}/documents.parquet")
    spark.createDataFrame([(*r, *"wxyz") for r in items], f"item_id long, text string, {columns}").write.parquet(f"{top}/benchmark.parquet")
    return top, docs, items


def test_query(spark, tables):
    top, docs, items = tables
    got = [tuple(r) for r in D.op13_decontaminate(spark, top).collect()]
    assert in_order(got) == in_order(expected(docs, items))
    assert sum(r[5] for r in got) > 30


def test_blocks_of_the_benchmark(spark, tables):
    top, docs, items = tables
    read = lambda name: spark.read.parquet(f"{top}/{name}.parquet")
    one = D.contamination(read("documents"), read("benchmark"))
    many = D.contamination(read("documents"), read("benchmark"), block_bytes=1500)
    rows = lambda df: in_order([(r.doc_id, r.n_words, [tuple(s) for s in r.spans], r["items"]) for r in df.collect()])
    assert rows(one) == rows(many)


def test_empty_tables(spark, tables):
    top = tables[0]
    docs, items = spark.read.parquet(f"{top}/documents.parquet"), spark.read.parquet(f"{top}/benchmark.parquet")
    assert D.contamination(docs.limit(0), items).count() == 0
    got = D.contamination(docs, items.limit(0)).collect()
    assert len(got) == docs.count() and not any(r.spans or r["items"] for r in got)
