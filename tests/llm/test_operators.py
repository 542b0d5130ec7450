"""The numbered operators against brute force and the libraries they must agree with, edge cases included."""

from __future__ import annotations

import array
import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest
import xxhash
from tokenizers import Tokenizer

from watchgrid.llm import bpe, exact_dedup, html_extract, language_id, language_model, packing, pii, quality_model, quality_rules, simhash

SF = "/root/testdata/sf0.001"
LONG = " ".join(f"word{k % 977} thing{k % 13}" for k in range(6_000))
TEXTS = [
    "Some plain text, with words. And more of them here, enough for a window or two.",
    "some plain text, with words. and more of them here, enough for a window or two.",
    "Some  plain\ttext, with words. And more of them here, enough for a window or two.",
    "", None, " ", "\n\n", "one", "one two", "é É ß ñ 中文 \U0001f600", LONG, LONG, LONG + " x",
    "Mail a@b.example or call +1 (239) 555-8522, from 10.0.0.1 or 300.1.1.1; card 4111 1111 1111 1111.",
    "a@b.c_x@d.e", "9" * 3000, "<|endoftext|> <|ENDOFTEXT|> it's", "#### $$$$ %%%% &&&& #### $$$$ %%%%",
]
CLASHES = "fp string, n_words string, row string, blocks string, held_out string, kept string, score string, quality string, spans string, block string"


@pytest.fixture(scope="module")
def docs(spark):
    """Ties, nulls, repeated rows, long and empty texts, and columns that operators use themselves."""
    rows = [(k, t, ("en", "fr", None)[k % 3], *[str(k)] * 10) for k, t in enumerate(TEXTS)]
    rows += [rows[0], rows[0], (None, TEXTS[0], "en", *["x"] * 10), (None, None, None, *["x"] * 10)]
    return spark.createDataFrame(rows, f"doc_id long, text string, lang string, {CLASHES}")


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def words(text):
    return [w for w in re.split("[\x20\x09-\x0d]+", text or "") if w]


def test_simhash(spark, docs, empty):
    def fp(text):
        w = words(re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
        shingles = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] or ([" ".join(w)] if w else [])
        hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0

    real = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert [simhash.fingerprint((t or "").encode()) for t in TEXTS[:10] + real[:40]] == [fp(t) for t in TEXTS[:10] + real[:40]]
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == docs.count()
    prints = [int(r.fingerprint, 16) for r in got]
    for r, a in zip(got, prints):
        reach, seen = {a}, set()
        while reach - seen:
            seen |= (now := reach - seen)
            reach |= {b for b in prints for c in now if (b ^ c).bit_count() <= 3}
        assert r.component_id == min((x.doc_id for x, b in zip(got, prints) if b in reach and x.doc_id is not None), default=None)
    assert simhash.near_duplicates(empty).count() == 0
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and kept.count() == len({r.component_id for r in got})
    assert simhash.keep_one(empty).count() == 0


@pytest.mark.parametrize("heavy", [1 << 16, 8])
def test_trie_join(spark, heavy):
    rng = np.random.default_rng(1)
    codes = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    near = codes[:200].copy()
    for k in range(200):
        for b in rng.choice(64, rng.integers(0, 5), replace=False):
            near[k] ^= np.uint64(1) << np.uint64(b)
    ball = np.uint64(12345) ^ (np.uint64(1) << np.arange(64, dtype=np.uint64))  # all within two bits of each other
    codes = np.unique(np.r_[codes, near, ball])
    root = list(range(len(codes)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i in range(len(codes)):
        for j in np.flatnonzero(np.bitwise_count(codes ^ codes[i]) <= 3):
            a, b = find(i), find(int(j))
            root[max(a, b)] = min(a, b)
    prints = spark.createDataFrame([(k, int(c)) for k, c in enumerate(codes.view(np.int64))], "doc_id long, fp long")
    got = {r.fp: r.component_id for r in simhash.components(prints, heavy).collect()}
    want = {int(c): find(k) for k, c in enumerate(codes.view(np.int64))}
    assert got == want


def test_bpe(docs, empty):
    library = Tokenizer.from_file(bpe.default_path())
    coder = bpe.encoder(bpe.default_path())
    for text in [t or "" for t in TEXTS] + ["aaaaaaa" * 9, "haha" * 30, "ΣΑΣ İ J̌", "x\x1cy\x85z", "it'll we've 'S"]:
        ids = library.encode(text, add_special_tokens=False).ids
        assert array.array("I", coder.encode(text.encode())).tolist() == ids
        assert coder.decode(coder.encode(text.encode())) == library.decode(ids, skip_special_tokens=False)
    got = bpe.encoding_digests(docs).collect()
    assert len(got) == docs.count() and {r.n_tokens for r in got if r.doc_id in (3, 4, 5)} == {0}
    coded = bpe.encode_documents(docs)
    assert bpe.decode_documents(coded).count() == docs.count()
    assert bpe.encoding_digests(empty).count() == 0


def test_quality_model(spark, docs, empty, tmp_path):
    got = quality_model.op3_quality_model(spark, SF).collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    held = [(r.score, labels[r.doc_id]) for r in got if r.held_out and r.doc_id in labels]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert np.mean([(s >= 0.5) == bool(q) for s, q in held]) > 0.9
    docs.write.parquet(f"file://{tmp_path}/documents.parquet")
    for name, rows in (("none", []), ("some", [(0, 1), (1, None), (13, 0), (99, 1), (0, 0)])):
        spark.createDataFrame(rows, "doc_id long, quality int").write.mode("overwrite").parquet(f"file://{tmp_path}/labels.parquet")
        got = quality_model.op3_quality_model(spark, f"file://{tmp_path}").collect()
        assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got), name
    assert quality_model.isotonic(np.array([1.0, 0, 2]), np.array([1.0, 1, 2])).tolist() == [0.5, 0.5, 1.0]


def test_pii(spark, docs, empty):
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def ok(kind, m):
        d = re.sub("[^0-9]", "", m)
        if kind == "ip":
            return all(int(p) <= 255 for p in m.split("."))
        if kind == "phone":
            return 8 <= len(d) <= 15
        return kind == "email" or 16 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(d[::-1])) % 10 == 0

    base = lambda t: [f"{k}:{m.start()}:{m.end()}" for k, p in patterns.items() for m in re.finditer(p, t or "") if ok(k, m[0])]
    real = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: r.text for r in real.collect()} | {1_000_000 + k: t for k, t in enumerate(TEXTS)}
    both = real.union(spark.createDataFrame([(1_000_000 + k, t) for k, t in enumerate(TEXTS)], "doc_id long, text string"))
    for r in pii.personal_data(both).collect():
        want = base(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert set(want) <= set(r.spans.split(",")) | {""}
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(w.startswith(k) for w in want) for k in patterns)
    clean = pii.redact(docs)
    assert clean.columns == docs.columns and clean.count() == docs.count()
    shown = {r.doc_id: r.text for r in clean.collect()}
    assert shown[13] == "Mail [EMAIL] or call [PHONE], from [IP] or 300.1.1.1; card [CARD]." and shown[4] is None and shown[0] == TEXTS[0]
    assert pii.personal_data(empty).count() == 0 and pii.redact(empty).count() == 0


def test_packing(docs, empty):
    got = packing.pack(docs).toPandas()
    pieces = collections.Counter(got["doc_id"].fillna(-1))
    assert set(pieces) == {*range(len(TEXTS)), -1} and pieces[0] == 3 and pieces[10] > 2
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert g["offset"].tolist() == [0, *np.cumsum(g["length"])[:-1]] and g["length"].sum() <= 4096
    library = Tokenizer.from_file(bpe.default_path())
    for k, t in enumerate(TEXTS):
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        own = got[got["doc_id"] == k].drop_duplicates("piece").sort_values("piece")
        assert own["start"].tolist() == list(range(0, len(ids), 4096))
        assert own["ids_crc32"].tolist() == [zlib.crc32(ids[s : s + 4096].tobytes()) for s in own["start"]]
    assert packing.pack(empty).count() == 0


def test_dominance_loses_nothing():
    rng = np.random.default_rng(4)

    def least(items, size):
        best = len(items)

        def go(k, rooms):
            nonlocal best
            if len(rooms) >= best:
                return
            if k == len(items):
                best = len(rooms)
                return
            for r in set(rooms):
                if r >= items[k]:
                    rest = list(rooms)
                    rest[rest.index(r)] -= items[k]
                    go(k + 1, rest)
            go(k + 1, [*rooms, size - items[k]])

        items = sorted(items, reverse=True)
        go(0, [])
        return best

    for _ in range(150):
        size = int(rng.choice([10, 20, 30]))
        items = rng.integers(1, size + 1, rng.integers(1, 9)).tolist()
        count = np.bincount(items, minlength=size + 1).astype(np.int64)
        fixed = packing.reduce_instance(count, size)
        rest = np.repeat(np.arange(size + 1), count).tolist()
        assert sum(n for _, n in fixed) + (least(rest, size) if rest else 0) == least(items, size)


def test_quality_rules(docs, empty):
    def brute(text):
        w = words(text)
        windows = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        n = collections.Counter(windows)
        covered = {j for k, x in enumerate(windows) if n[x] > 1 for j in range(k, k + 3)}
        lines = [x for x in (text or "").split("\n") if words(x)]
        return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)

    for text in [*TEXTS[:10], *TEXTS[12:], "a b c a b c d", "a a a a", "x\nx\n\n x\nx"]:
        assert quality_rules.statistics(text or "")[:5] == brute(text)
    got = quality_rules.judge(docs).collect()
    assert len(got) == docs.count()
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.base_failed and r.kept)
    assert quality_rules.judge(empty).count() == 0
    kept = quality_rules.keep_good(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r.kept for r in got)


def test_quality_rules_by_labels(spark):
    got = {r.doc_id: r for r in quality_rules.op6_quality_rules(spark, "/root/testdata/sf0.01").collect()}
    labels = [r for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect() if not got[r.doc_id].base_failed]
    assert np.mean([got[r.doc_id].kept == bool(r.quality) for r in labels]) > 0.95


def test_language_model(spark, docs, tmp_path):
    docs.write.parquet(f"file://{tmp_path}/documents.parquet")
    got = language_model.op7_language_model(spark, f"file://{tmp_path}").collect()
    assert len(got) == docs.count()
    counts = collections.Counter()
    tokens = lambda t: [*(t or "").encode().lower().split(), b""]
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    held = lambda k: zlib.crc32(("" if k is None else str(k)).encode()) % 7 == 2
    for k, t in rows:
        if not held(k):
            counts.update(tokens(t))
    total, distinct = sum(counts.values()), len(counts)
    want = collections.Counter((held(k), len(tokens(t)), sum(counts[w] > 0 for w in tokens(t)), round(sum(math.log10((counts[w] + 1) / (total + distinct + 1)) for w in tokens(t)), 4)) for k, t in rows)
    assert collections.Counter((r.held_out, r.n_tokens, r.n_known, round(r.base_score, 4)) for r in got) == want
    assert {r.train_tokens for r in got} == {total} and all(r.score <= 0 for r in got)
    docs.limit(0).write.mode("overwrite").parquet(f"file://{tmp_path}/documents.parquet")
    assert language_model.op7_language_model(spark, f"file://{tmp_path}").count() == 0


def known_of(often):
    """What is known of made-up classes: the end, the buckets, then tokens with vectors of their own."""
    noise = np.r_[np.ones(1 + language_model.BUCKETS), np.array(often, float) + 1]
    return language_model.Known({}, np.zeros(1, np.int64), np.zeros(1), np.zeros(len(noise)), noise / noise.sum(), 0, 0)


def test_language_model_learns_and_is_normalised(spark, monkeypatch):
    monkeypatch.setattr(language_model, "PART", 40)  # several tasks, whose vectors are averaged
    own = 1 + language_model.BUCKETS
    known = known_of([400] * 20)
    total, counts = len(known.noise), collections.Counter()
    for k in range(20):  # each token has one that follows it
        near, to = own + k, own + (k * 7 + 3) % 20
        for far in range(language_model.GROUPS):
            counts[(near * language_model.GROUPS + far) * total + to] += 40
            counts[(near * language_model.GROUPS + far) * total + own + (k + far) % 20] += 5
    table = spark.createDataFrame(list(counts.items()), "cell long, n long")
    model = language_model.train(table, known, 40)
    every = np.arange(total)
    for context in (0, own * language_model.GROUPS, total * language_model.GROUPS + 3):
        assert abs((10.0 ** model.scores(np.full(total, context), every)).sum() - 1) < 1e-4
    contexts, to = np.divmod(np.array(list(counts)), total)
    n = np.array(list(counts.values()))
    score, unigram = (n * model.scores(contexts, to)).sum() / n.sum(), (n * np.log10(known.noise[to])).sum() / n.sum()
    assert score > unigram + 0.3
    bare = language_model.train(table.limit(0), known)
    assert np.allclose(10.0 ** bare.scores(np.full(total, 5), every), known.noise, atol=0.05) and abs((10.0 ** bare.scores(np.full(total, 5), every)).sum() - 1) < 1e-4


def test_language_model_score_by_brute_force(spark, monkeypatch):
    """Each token's probability by a loop over all classes."""
    texts = ["the cat and the dog", "the the dog", None, "", "a cat the dog x1 x2", "The DOG and the cat"] * 3
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "false held_out")
    counts = docs.select("text").mapInArrow(language_model.count_tokens, "token binary, n long").groupBy("token").sum("n").toDF("token", "n").cache()
    monkeypatch.setattr(language_model, "LEAST", 4)
    known = language_model.know(counts)
    table = language_model.gather(docs, known)
    model = language_model.train(table, known, 3)
    number, total, own = dict(((bytes(r.token), r.n) for r in counts.collect())), len(known.noise), 1 + language_model.BUCKETS
    assert sum(r.n for r in table.collect()) == sum(number.values()) and len(known.noise) == own + sum(n >= 4 and t != b"" for t, n in number.items())

    def brute(text):
        words, classes, out = (text or "").lower().encode().split() + [b""], [], 0.0
        for w in words:
            near = classes[-1] if classes else total
            far = 1 + classes[-2] % (language_model.GROUPS - 1) if len(classes) > 1 else 0
            c = 0 if w == b"" else known.classes[known.place[w]] if w in known.place else 1 + language_model.bucket(w)
            raw = [float((model.near[near] + model.far[far]) @ model.to[k] + model.bias[k]) for k in range(total)]
            p = math.exp(raw[c]) / sum(map(math.exp, raw))
            if 0 < c < own:
                size = 1 + sum(n + 1 for t, n in number.items() if t and known.classes[known.place[t]] == c)
                p *= (number.get(w, 0) + 1) / size
            out += math.log10(p)
            classes.append(c)
        return out

    for r in language_model.score(docs, counts, known, model).collect():
        assert abs(r.score - brute(texts[r.doc_id])) < 1e-3


def test_heavy_tokens_by_histogram(spark):
    counts = spark.createDataFrame([(bytes([k]), 1 + k * k % 50) for k in range(200)], "token binary, n long")
    for most in (0, 3, 50, 199, 200, 1000):
        low = language_model.least_count(counts, most)
        assert counts.where(f"n >= {low}").count() <= most
    assert language_model.least_count(counts, 1000) == 1 and language_model.least_count(counts.limit(0), 5) > 1 << 60


PAGE = """<html><head><title>x</title><style>a{}</style></head><body><header>Site, the, name</header><nav><a href=a>a</a></nav>
<div id="cookie-notice">We use cookies, many, many cookies here on this site indeed.</div>
<div class="post"><h2>Head &amp; tail</h2><p>First paragraph, with commas, and more text than the least.<p>Second <a href=x>one</a>, <b>bold</b>&nbsp;and
long  enough, too.<ul><li>point one<li>point two</ul><form>Search this, now, please and long enough text</form><div class="ad">Buy, buy, buy things now, all of them</div></div>
<aside><p>Side text, which is long enough to be counted, surely.</p></aside><section id=comments><p>Reader says, this is a comment, with length.</p></section><footer>&copy; 2020, someone</footer>"""


def test_html(spark):
    assert html_extract.extract(PAGE) == "Head & tail\nFirst paragraph, with commas, and more text than the least.\nSecond one, bold and long enough, too.\npoint one\npoint two"
    rows = [(1, "u", PAGE), (2, None, None), (3, "u", ""), (3, "u", "no tags,  at all"), (None, "u", "<p"), (5, "u", "<div>" * 3000 + "deep" + "<b>" * 3000), (6, "u", '<a "' * 3000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' as text", "1 as n_chars")
    got = {(r.page_id, r.text) for r in html_extract.main_text(pages).collect()}
    assert len(got) == 7 and {(2, ""), (3, ""), (3, "no tags, at all"), (5, "deep")} <= got
    assert html_extract.main_text(pages.limit(0)).count() == 0


def test_exact_dedup(docs, empty, monkeypatch):
    for block, common in ((4, 2), (4, 1000), (1024, 2), (1024, 1000)):  # two rows make a value common, or none is
        monkeypatch.setattr(exact_dedup, "COMMON", common)
        got = exact_dedup.exact_duplicates(docs, block=block).collect()
        norm = lambda t: re.sub("[\x20\x09-\x0d]+", " ", t or "")
        groups = collections.defaultdict(list)
        for r in docs.select("doc_id", "text").collect():
            groups[hashlib.sha256(norm(r.text).encode()).hexdigest()].append(r.doc_id)
        assert len(got) == docs.count()
        for r in got:
            own = groups[r.text_sha256]
            assert r.group_size == len(own) and r.keep_id == min((k for k in own if k is not None), default=None)
        assert sum(r.kept for r in got) == len(groups) and all(r.doc_id == r.keep_id for r in got if r.kept)
    assert exact_dedup.exact_duplicates(empty).count() == 0
    kept = exact_dedup.keep_one(docs)
    assert kept.columns == docs.columns and kept.count() == len(groups) and exact_dedup.keep_one(empty).count() == 0


def test_language_id(spark, docs, tmp_path):
    got = {r.doc_id: r for r in language_id.op10_language_id(spark, SF).collect()}
    real = spark.read.parquet(f"{SF}/documents.parquet").collect()
    held = [r for r in real if got[r.doc_id].held_out]
    assert np.mean([got[r.doc_id].lang_pred == r.lang for r in held]) > 0.97
    docs.write.parquet(f"file://{tmp_path}/documents.parquet")
    rows = language_id.op10_language_id(spark, f"file://{tmp_path}").collect()
    by_id = {r.doc_id: r for r in rows}
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert {by_id[k].lang_pred for k in (3, 4, 5, 6, 15, 17)} == {"und"} and by_id[0].lang_pred in ("en", "fr")
    assert language_id.predict("text", [], np.zeros((0, language_id.GRAMS))) == ("und", 0.0)
