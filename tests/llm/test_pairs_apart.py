from __future__ import annotations

from itertools import combinations

import numpy as np

from watchgrid.llm import similar, simhash


def test_all_pairs_of_groups(spark):
    rng = np.random.default_rng(3)
    base = [int(x) for x in rng.integers(0, 1 << 62, 20)]
    codes = sorted({b ^ sum(1 << int(k) for k in rng.integers(0, 63, rng.integers(0, 4))) for b in base for _ in range(12)})
    group = {c: None if k % 7 == 0 else k % 3 for k, c in enumerate(codes)}
    want = {(a, b) for a, b in combinations(codes, 2) if (a ^ b).bit_count() <= 3 and (group[a] is None or group[b] is None or group[a] != group[b])}
    prints = spark.createDataFrame([(c, group[c]) for c in codes], "fp long, group long")
    for heavy in (1 << 16, 8):
        assert {(r.u, r.v) for r in simhash.pairs_apart(prints, heavy).collect()} == want and len(want) > 100


def test_near_fingerprints_behind_another(spark):
    """b and c are similar, but each is only the child of a in the tree of near fingerprints."""
    words = [f"w{k}" for k in range(60)]
    texts = {1: " ".join(f"x{k}" for k in range(60)), 2: " ".join(words), 3: " ".join([*words, "more"])}
    docs = similar.with_row_key(spark.createDataFrame([(k, t) for k, t in texts.items()], "doc_id long, text string"))
    docs = similar.materialize(docs, "docs")
    prints = {1: 0, 2: 0b111, 3: 0b11}
    rows = spark.createDataFrame([(k, len(similar.shingles(texts[k].encode())), fp, []) for k, fp in prints.items()], "sign long, n long, fp long, bands array<long>")
    sets = similar.materialize(rows.join(docs.select("doc_id", *similar.ROW), rows["sign"] == docs["doc_id"]).drop("doc_id"), "sets")
    assert {tuple(sorted((r.u, r.v))) for r in similar.links(sets, docs).collect()} == {(2, 3)}
