"""Numbers inside longer runs of digits and separators."""

from __future__ import annotations

from watchgrid.llm import pii

SF = "/root/testdata/sf0.001"
CARD, OTHER = "4465758382889437", "7536784127813050"


def test_numbers_beside_numbers(spark):
    lone = [(k, f"{('paid by card', 'we took the')[k % 2]} {CARD} today") for k in range(40)] + [(100 + k, f"{('invoice', 'card')[k % 2]} {CARD[:-1]}{(int(CARD[-1]) + 1 + k % 9) % 10} sent") for k in range(40)]
    runs = {
        1000: f"cards {CARD} {CARD}",
        1001: f"cards {CARD} {OTHER} 123",
        1002: "no number here",
        1003: f"from 10.0.0.1 {CARD} {CARD}",
    }
    docs = spark.createDataFrame(lone + list(runs.items()), "doc_id long, text string")
    got = {r.doc_id: [s for s in r.spans.split(",") if s.startswith("card")] for r in pii.personal_data(docs).collect()}
    assert got[0] == ["card:13:29"] and got[100] == [] and got[1002] == []
    assert got[1000] == ["card:6:22", "card:23:39"]
    assert "card:6:22" in got[1001]
    assert got[1003] == ["card:14:30", "card:31:47"]


def test_windows(spark):
    text = "tel (030) 123 4567 and 10.0.0.1 555 1234, 12345678901234567890"
    docs = pii.located(spark.createDataFrame([(text,)], "text string"), {"group": "[0-9]+"})
    found = {w.m for w in docs.withColumn("at_group", pii.joined("at_group")).select(pii.windows("at_group").alias("w")).first().w}
    assert {"(030) 123 4567", "123 4567", "555 1234", "10.0.0.1 555 1234"} <= found
    assert not any("and" in m or "1234567890" in m for m in found)
    assert all(7 <= sum(c.isdigit() for c in m) <= 19 for m in found)


def test_threshold_by_all_cells(spark):
    rows = [(*([0] * len(pii.FEATURES)), 5, 5), (*([1] * len(pii.FEATURES)), 0, 9)]
    cells = spark.createDataFrame(rows, ", ".join(f"{f} int" for f in pii.FEATURES) + ", pos long, n long")
    assert pii.threshold(cells, 0.0, [(0, 0, 2.0, -2.0)]) == 1.0
    assert pii.threshold(cells, 0.0, [(0, 0, -2.0, 2.0)]) is None and pii.threshold(cells, 0.0, []) is None


def corpus(n: int = 60) -> list[tuple[int, str]]:
    """Texts with base spans of each kind."""
    card = lambda k: next(c for d in range(10) if luhn(c := f"4{k:014d}{d}"))
    return [(k, f"Write to user{k}.x@mail{k % 7}.example.com or call +1 (2{k % 90 + 10:02d}) 555-{1000 + k} soon; host 10.{k % 250}.7.{k % 99 + 1} took card {card(k * 7919)} today") for k in range(n)]


def luhn(digits: str) -> bool:
    return sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(digits[::-1])) % 10 == 0


ADDED = {
    2000: ("email", "reach ", "jane.doe (at) corp (dot) example (dot) org", " now"),
    2001: ("email", "reach ", "jane.doe[at]corp[dot]org", ""),
    2002: ("email", "reach ", "jane.doe at corp dot org", ", please"),
    2003: ("ip", "see ", "10[.]20[.]30[.]40", " for it"),
    2004: ("phone", "reach us: ", "(239) 555-8522", " daily"),
    2005: ("phone", "you may call ", "239.555.8522", " daily"),
    2006: ("card", "paid by ", "4111.1111.1111.1111", " then"),
    2007: ("card", "paid by ", "4111/1111/1111/1111", " then"),
    2008: ("phone", "the mobile ", "2395558522", " rings"),
}
KEPT = {
    3000: "on 2024-01-05 and 05/12/2024 it was", 3001: "version 1.23.45678 came out", 3002: "paid by 4111.1111.1111.1112 then", 3003: "the order 2395558522 went out",
    3004: "code a2395558522b and a41111111111111b", 3005: "we met at noon. Then we left at the dot", 3006: "see 399[.]20[.]30[.]40 for it", 3007: "items 1 . 2 . 3 . 4 are", 3008: "look at example.com for more",
    3009: "it took 3.14159265 seconds",
}


def test_added_spans_and_look_alikes(spark):
    rows = corpus() + [(k, a + m + b) for k, (_, a, m, b) in ADDED.items()] + list(KEPT.items())
    got = {r.doc_id: r.spans for r in pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {k: got[k] for k in ADDED} == {k: f"{kind}:{len(a)}:{len(a) + len(m)}" for k, (kind, a, m, _) in ADDED.items()}
    assert {k: got[k] for k in KEPT} == dict.fromkeys(KEPT, "")


def test_held_out_quality(spark):
    held = pii.materialize(pii.candidates(spark.createDataFrame(corpus(200), "doc_id long, text string"), "doc_id").drop("text"), "held")
    got = {r.kind: r for r in pii.quality(held, pii.fit(held)).collect()}
    assert all(r.recall > 0.9 and r.precision >= 0.9 and r.made > 50 and r.others > 50 for r in got.values()) and set(got) == set(pii.KINDS)


def test_found_and_apart_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(pii, "BLOCK", 3)
    parts = ["+1 (239) 555-8522", "239-555-8522", "a.b@c.de", "x (at) y (dot) z", "10.0.0.1", "10[.]0[.]0[.]1", "4111 1111 1111 1111", "12 34 56 78", "word"]
    text = " ".join(parts[(k * k + k // 3) % len(parts)] for k in range(120))
    r = pii.candidates(spark.createDataFrame([(1, text)], "doc_id long, text string"), "doc_id").first()
    base = [(b.start, b.stop) for k in pii.KINDS for b in r[f"base_{k}"]]
    assert len(r.cand) > 100 and {c.found for c in r.cand} == {True, False}
    assert all(c.found == any(a < c.stop and c.start < b for a, b in base) for c in r.cand)
    spans = [(k * 2, k * 2 + 3 + k % 4, float(k * 37 % 11)) for k in range(50)]
    want = []
    for s in spans:
        if want and want[-1][1] > s[0]:
            if s[2] > want[-1][2]:
                want[-1] = s
        else:
            want.append(s)
    df = spark.createDataFrame([(spans,)], "s array<struct<start:bigint,stop:bigint,score:double>>")
    assert [tuple(x) for x in df.select(pii.apart(df["s"]).alias("s")).first().s] == want


def test_redaction_over_pieces(spark, monkeypatch):
    monkeypatch.setattr(pii, "PIECE", 7)
    text = "é mail a@b.example, then \U0001f600 +1 (239) 555-8522 and a very long stretch of nothing at all 10.0.0.1"
    got = pii.redact(spark.createDataFrame([(text, 5), (None, None), ("", 0)], "text string, n_chars long")).collect()
    want = "é mail [EMAIL], then \U0001f600 [PHONE] and a very long stretch of nothing at all [IP]"
    assert {(r.text, r.n_chars) for r in got} == {(want, len(want)), (None, None), ("", 0)}


def test_long_list_in_linear_time(spark):
    text = "; ".join(f"+1 (239) 555-{k % 10000:04d}" for k in range(40_000))
    r = pii.candidates(spark.createDataFrame([(text,)], "text string")).selectExpr("size(base_phone) n", "exists(cand, c -> not c.found) free").first()
    assert len(text) > 700_000 and r.n == 40_000
