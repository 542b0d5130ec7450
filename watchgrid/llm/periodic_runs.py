"""Operator 12: maximal runs of periodic word sequences, by probing a harmonic grid.

A run of period p and at least 2 p words holds two grid points jp and (j+1)p, which are the same word. So the words
at jp and (j+1)p are compared for every j, which over all p takes n log n comparisons; periods are taken in blocks
of at most GRID grid points, in rising order, and each block is one array operation. Points that agree are
survivors. A survivor's neighbours must agree too, as a run's words do so over max(p, 12 - p) places; those that
pass are extended both ways, comparing chunks of doubling size. Grid points inside a run already found are skipped
if its period divides theirs: a stretch through them can't leave that run, so nothing is lost. A stretch whose
smallest period is smaller has the same ends as the run of that period, which was found before it.

Defined results: a null text has no words. A document without words or runs has n_runs zero, four nulls, the digest
of the empty string for its runs, and the digest of its words. A null doc_id counts as the empty text in the
checksum that picks the documents to be made periodic. Repeated rows each give a row. Extra columns are ignored. An
empty table gives no rows. A document is searched as a whole within one row, in memory in proportion to its words.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from watchgrid.llm.common import table

#: The fewest words of a run.
LEAST = 12
#: Grid points of a block of periods; one period may have more.
GRID = 1 << 16
#: Words by which survivors are tried together, and the first chunk of an extension.
NEAR, CHUNK = 8, 64

RUN = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])


def blocks_of(n: int, grid: int = GRID):
    """Ranges of periods [low, high) up to n // 2 whose grids have about so many points together."""
    low = 1
    while low <= n // 2:
        points = np.cumsum((n - 1) // np.arange(low, min(n // 2, low + grid) + 1))
        high = low + max(1, int(np.searchsorted(points, grid, "right")))
        yield low, high
        low = high


def reach(ids: np.ndarray, at: int, period: int, step: int) -> int:
    """How many places from at on, at itself left out, agree with those a period later; step is 1 or -1."""
    end = len(ids) - period - 1 - at if step > 0 else at
    done, chunk = 0, CHUNK
    while done < end:
        size = min(chunk, end - done)
        a = at + step * (done + 1)
        part = slice(a, a + size) if step > 0 else slice(a - size + 1, a + 1)
        differ = ids[part] != ids[part.start + period : part.stop + period]
        if step < 0:
            differ = differ[::-1]
        first = int(differ.argmax())
        if differ[first]:
            return done + first
        done, chunk = done + size, chunk * 2
    return done


def survivors(ids: np.ndarray, low: int, high: int, last: np.ndarray, every: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Grid points and their periods in [low, high), in order, that agree with the next, lie in no found run and may
    lie in a run by their neighbours. last and every: for a place the end and the period of a run found over it."""
    n = len(ids)
    periods = np.arange(low, high)
    points = (n - 1) // periods
    period = np.repeat(periods, points)
    at = (np.arange(len(period)) - np.repeat(np.cumsum(points) - points, points)) * period
    keep = ids[at] == ids[at + period]
    at, period = at[keep], period[keep]
    keep = (at + period >= last[at]) | (period % every[at] != 0)
    at, period = at[keep], period[keep]
    total = np.ones(len(at), np.int64)
    whole = np.zeros(len(at), bool)
    for step in (1, -1):
        alive = np.ones(len(at), bool)
        for k in range(1, NEAR + 1):
            i = at + step * k
            inside = alive & (i >= 0) & (i + period < n)
            i = np.where(inside, i, 0)
            alive = inside & (ids[i] == ids[i + np.where(inside, period, 0)])
            total += alive
            if not alive.any():
                break
        whole |= alive
    keep = whole | (total >= np.maximum(period, least - period))
    return at[keep], period[keep]


def runs(ids: np.ndarray, least: int = LEAST, grid: int = GRID) -> list[tuple[int, int, int]]:
    """(start, length, period) of each run of the word numbers ids, by start, then period."""
    n = len(ids)
    found: dict[tuple[int, int], int] = {}
    last, every = np.zeros(n, np.int64), np.ones(n, np.int64)
    for low, high in blocks_of(n, grid) if n >= least else ():
        at, period = survivors(ids, low, high, last, every, least)
        cuts = np.flatnonzero(np.r_[True, period[1:] != period[:-1]]) if len(at) else []
        for a, b in zip(cuts, [*cuts[1:], len(at)]):
            p, k = int(period[a]), a
            while k < b:
                i = int(at[k])
                if i + p < last[i] and p % every[i] == 0:
                    k = max(k + 1, a + int(np.searchsorted(at[a:b], last[i] - p)))
                    continue
                start, stop = i - reach(ids, i, p, -1), i + reach(ids, i, p, 1) + 1
                length = stop - start + p
                if stop - start >= p and length >= least and (start, length) not in found:
                    found[start, length] = p
                    over = slice(start, start + length)
                    more = last[over] < start + length
                    last[over][more], every[over][more] = start + length, p
                k = max(k + 1, a + int(np.searchsorted(at[a:b], stop)))
    return sorted((s, length, p) for (s, length), p in found.items())


def numbered(words: list[bytes]) -> np.ndarray:
    """A number for each word, the same for equal words only."""
    names: dict[bytes, int] = {}
    return np.fromiter((names.setdefault(w, len(names)) for w in words), np.int64, len(words))


def collapsed(n: int, found: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words stay: those that no run holds after its first period."""
    depth = np.zeros(n + 1, np.int64)
    for start, length, period in found:
        depth[start + period] += 1
        depth[start + length] -= 1
    return np.cumsum(depth[:n]) == 0


def periodic_runs(text: Column, least: int = LEAST) -> Column:
    """Struct of n_words, runs (start, length, period, by start, then period) and the text's words that stay."""

    @F.arrow_udf(T.StructType([T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(RUN)), T.StructField("collapsed", T.StringType())]))
    def search(texts: pa.Array) -> pa.Array:
        counts, all_runs, left = [], [], []
        for held in texts.cast(pa.large_binary()):
            words = (held.as_py() or b"").split()
            found = runs(numbered(words), least)
            stays = collapsed(len(words), found)
            counts.append(len(words))
            all_runs.append([dict(zip(("start", "length", "period"), r)) for r in found])
            left.append(b" ".join(w for w, s in zip(words, stays.tolist()) if s).decode() if found else b" ".join(words).decode())
        item = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))
        return pa.StructArray.from_arrays([pa.array(counts, pa.int64()), pa.array(all_runs, item), pa.array(left, pa.string())], ["n_words", "runs", "collapsed"])

    return search(text)


def made_periodic(doc_id: str | None, text: bytes) -> bytes:
    """The text as the query searches it: of one document in ten the words from a place on repeat with a period."""
    h, words = zlib.crc32((doc_id or "").encode()), text.split()
    n, g = len(words), h // 10
    if h % 10 or not n:
        return b" ".join(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return b" ".join(words[:a] + [words[a + (i - a) % p] for i in range(a, n)])


@F.arrow_udf(T.StringType())
def searched_text(doc_ids: pa.Array, texts: pa.Array) -> pa.Array:
    pairs = zip(doc_ids.to_pylist(), texts.cast(pa.large_binary()).to_pylist())
    return pa.array([made_periodic(d, t or b"").decode() for d, t in pairs], pa.string())


def longest(found: Column) -> Column:
    """Of an array of runs the one of greatest length; of equal ones that of the smallest start, then period."""
    return F.reduce(found, F.lit(None).cast(RUN), lambda best, r: F.when(best.isNull() | (r["length"] > best["length"]), r).otherwise(best))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", periodic_runs(searched_text(F.col("doc_id").cast("string"), "text")).alias("r"))
    lines = F.transform("r.runs", lambda x: F.concat(x["start"].cast("string"), F.lit(","), x["length"].cast("string"), F.lit(","), x["period"].cast("string"), F.lit("\n")))
    rows = rows.select("doc_id", F.size("r.runs").cast("long").alias("n_runs"), longest(F.col("r.runs")).alias("best"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("r.collapsed", 256).alias("collapsed_sha256"))
    return rows.select("doc_id", "n_runs", "best.start", "best.length", "best.period", F.expr("best.length * 1000 div best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


OP12_SQL = r"""
WITH crc AS (
    SELECT list(list_reduce([k, 1, 1, 1, 1, 1, 1, 1, 1], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY k) AS t FROM range(256) r(k)
), texts AS (
    SELECT row_number() OVER () AS r, doc_id, coalesce(doc_id::VARCHAR, '') AS d, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), sums AS (
    SELECT r, doc_id, w, len(w) AS n, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(length(d)), lambda k: ascii(d[k + 1])::BIGINT)), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) AS h
    FROM texts, crc
), places AS (SELECT *, h // 10 AS g, CASE WHEN n > 0 THEN (h // 10) % n END AS a FROM sums),
docs AS (
    SELECT r, doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: w[CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END + 1]) ELSE w END AS w FROM places
), words AS MATERIALIZED (SELECT r, n, unnest(w) AS w, unnest(range(n)) AS i FROM docs),
equal AS (SELECT x.r, x.i, y.i - x.i AS p FROM words x JOIN words y ON x.r = y.r AND x.w = y.w AND y.i > x.i AND y.i - x.i <= x.n // 2),
stretches AS (
    SELECT r, p, min(i) AS start, count(*) + p AS length
    FROM (SELECT *, i - row_number() OVER (PARTITION BY r, p ORDER BY i) AS island FROM equal) GROUP BY r, p, island HAVING count(*) >= greatest(p, 12 - p)
), runs AS MATERIALIZED (SELECT r, start, length, min(p) AS p FROM stretches GROUP BY r, start, length),
per AS (
    SELECT r, count(*) AS n_runs, min((-length, start, p)) AS best, string_agg(start || ',' || length || ',' || p || chr(10), '' ORDER BY start, p) AS lines FROM runs GROUP BY r
), gone AS (SELECT DISTINCT r, unnest(range(start + p, start + length)) AS i FROM runs),
kept AS (SELECT r, string_agg(w, ' ' ORDER BY i) AS body FROM words ANTI JOIN gone USING (r, i) GROUP BY r)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, best[2]::BIGINT AS start, -best[1]::BIGINT AS length, best[3]::BIGINT AS period,
       (-1000 * best[1] // best[3])::BIGINT AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(body, '')) AS collapsed_sha256
FROM docs LEFT JOIN per USING (r) LEFT JOIN kept USING (r)
"""
