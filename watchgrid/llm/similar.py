"""Near copies: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more, one of each group kept.

Equal sets are one from the start. Candidates are found in two ways. Operator 1 joins 64-bit fingerprints of the
five-word shingles within its three bits. Beyond those, each set has BANDS * ROWS minimum hashes in BANDS bands; sets
that agree in a band are in one bucket there. In a bucket a set is paired with the bucket's smallest set and with the
one before it by size, so a bucket gives two pairs a set at most, however many sets it holds; the sets before are
looked up in shares of about SHARE sets, dealt by hash. Two sets of similarity s agree in a band with probability
s^ROWS each: at 0.8 all bands miss with probability 0.0004.

Every pair is compared by its whole sets before it links. First each set is compared with the one that it is paired
with in most bands, then pairs whose ends aren't joined yet. The texts of a centre's pairs go to tasks by centre and
share of its members, and are cut into shingles there: a task holds two sets at a time.

Defined results: words are split at ASCII white space and ASCII letters lower-cased; a text of at most five words is
one shingle; texts without words and null texts are equal. A row with a null doc_id stays only where its group has no
other. Repeated rows are one group. Extra columns are kept. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from watchgrid.llm import simhash
from watchgrid.llm.common import ROW, connected_components, drop, materialize, with_row_key

WIDTH, SEED = 5, 42
#: Bands and minimum hashes of a band.
BANDS, ROWS = 20, 5
#: Sets of a bucket or pairs of a centre that stay together.
SHARE = 1024
#: Shingles hashed at a time.
CHUNK = 4096

_RANDOM = np.random.default_rng(SEED)
MASKS, FACTORS = _RANDOM.integers(0, 1 << 63, BANDS * ROWS, np.uint64), _RANDOM.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: bytes | None) -> np.ndarray:
    """Distinct hashes of the shingles of a text, in order."""
    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    line = b" ".join(words)
    if len(words) <= WIDTH:
        return np.array([xxhash.xxh64_intdigest(line, SEED)], np.uint64)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts, stops = [0, *ends[:-WIDTH].tolist()], (ends[WIDTH - 1 :] - 1).tolist()
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(line[a:b], SEED) for a, b in zip(starts, stops)), np.uint64, len(stops)))


def bands_of(found: np.ndarray) -> list[int]:
    """A hash for each band of a set; none for the empty set."""
    if not len(found):
        return []
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for at in range(0, len(found), CHUNK):
        low = np.minimum(low, ((found[at : at + CHUNK, None] ^ MASKS) * FACTORS).min(0))
    return [xxhash.xxh64_intdigest(band.tobytes(), k) for k, band in enumerate(low.reshape(BANDS, ROWS))]


def bits_of(found: np.ndarray) -> int:
    """Fingerprint of a set: the bits set in over half its hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(found), CHUNK):
        ones += np.unpackbits(found[at : at + CHUNK].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(found)).tobytes(), "big")


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether sets of distinct hashes are of similarity o / (a + b - o) >= 4 / 5, that is 9 o >= 4 (a + b)."""
    both = len(a) + len(b)
    return 5 * min(len(a), len(b)) >= 4 * max(len(a), len(b)) and 9 * len(np.intersect1d(a, b, assume_unique=True)) >= 4 * both


SIGNATURE = T.StructType([T.StructField(c, T.LongType()) for c in ("sign", "n", "fp")] + [T.StructField("bands", T.ArrayType(T.LongType()))])


@F.arrow_udf(SIGNATURE)
def signature_of(texts: pa.Array) -> pa.Array:
    sets = [shingles(t.as_py()) for t in texts.cast(pa.large_binary())]
    longs = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
    bands = [np.array(bands_of(s), np.uint64).view(np.int64) for s in sets]
    return pa.StructArray.from_arrays([longs([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets]), pa.array([len(s) for s in sets], pa.int64()), longs([bits_of(s) for s in sets]), pa.array(bands, pa.list_(pa.int64()))], ["sign", "n", "fp", "bands"])


def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (u, share, member, sign, text) in order, a centre first in each share, to links (u, v)."""
    held: tuple[int, int] | None = None
    centre = np.empty(0, np.uint64)
    for batch in batches:
        us, vs = [], []
        keys = (batch.column(k).to_pylist() for k in range(4))
        for u, share, member, sign, text in zip(*keys, batch.column(4).cast(pa.large_binary())):
            if not member:
                held, centre = (u, share), shingles(text.as_py())
            elif held == (u, share) and alike(centre, shingles(text.as_py())):
                us.append(u)
                vs.append(sign)
        yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["u", "v"])


def similar(pairs: DataFrame, docs: DataFrame, places: DataFrame) -> DataFrame:
    """Of pairs (u, v) of signs, a written table, those whose sets are similar; places has a ROW of docs for each sign."""
    shares = F.ceil(F.count("*") / SHARE).cast("int")
    centres = materialize(pairs.groupBy("u").agg(shares.alias("shares")), "centres")
    members = pairs.join(centres, "u").select("u", F.pmod(F.xxhash64("v"), F.col("shares")).cast("int").alias("share"), F.lit(1).alias("member"), F.col("v").alias("sign"))
    firsts = centres.select("u", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), F.lit(0).alias("member"), F.col("u").alias("sign"))
    wanted = materialize(members.union(firsts).join(places, "sign"), "wanted")
    # texts are shuffled whatever the size of the other side, so that the stage needs the same share of disk at every size
    rows = docs.select(*ROW, "text").join(wanted.hint("merge"), list(ROW)).select("u", "share", "member", "sign", "text")
    found = rows.repartition("u", "share").sortWithinPartitions("u", "share", "member").mapInArrow(compared, "u long, v long")
    out = materialize(found, "similar")
    drop(centres)
    drop(wanted)
    return out


def candidates(sets: DataFrame) -> DataFrame:
    """Pairs (u, v) of signs with first and n: in how many buckets u is the smallest set beside v, and in how many
    it is that or the one before v. sets, a written table, has sign, n, fp and bands."""
    bands = materialize(sets.select(F.explode("bands").alias("band"), "sign", "n"), "bands")
    buckets = bands.groupBy("band").agg(F.min(F.struct("n", "sign")).alias("low"), F.ceil(F.count("*") / SHARE).alias("shares"), F.count("*").alias("size"))
    buckets = materialize(buckets.where("size > 1").select("band", F.col("low.n").alias("low_n"), F.col("low.sign").alias("low"), "shares"), "buckets")
    held = bands.join(buckets, "band").withColumn("share", F.pmod(F.xxhash64("sign"), F.col("shares")))
    before = Window.partitionBy("band", "share").orderBy("n", "sign")
    held = held.select("low", "low_n", "sign", "n", F.lag("sign").over(before).alias("before"), F.lag("n").over(before).alias("before_n"))
    # each of a pair's ends is at least four fifths of the other
    one = F.when(F.expr("low <> sign and 5 * low_n >= 4 * n"), F.struct(F.col("low").alias("u"), F.lit(1).alias("first")))
    two = F.when(F.expr("before <> low and 5 * before_n >= 4 * n"), F.struct(F.col("before").alias("u"), F.lit(0).alias("first")))
    pairs = held.select(F.col("sign").alias("v"), F.explode(F.array_compact(F.array(one, two))).alias("p")).groupBy(F.col("p.u").alias("u"), "v").agg(F.sum("p.first").alias("first"), F.count("*").alias("n"))
    # operator 1: sets of one fingerprint, and fingerprints within its three bits, each by its smallest set
    prints = materialize(sets.groupBy("fp").agg(F.min("sign").alias("low")), "prints")
    same = sets.join(prints, "fp").where("low <> sign").select(F.col("low").alias("u"), F.col("sign").alias("v"))
    name = lambda c: prints.select(F.col("fp").alias(c), F.col("low").alias(f"{c}_low"))
    links = simhash.links(prints.select("fp")).distinct().join(name("u"), "u").join(name("v"), "v").select(F.col("u_low").alias("u"), F.col("v_low").alias("v"))
    both = pairs.unionByName(same.union(links).select("u", "v", F.lit(0).cast("long").alias("first"), F.lit(0).cast("long").alias("n")))
    out = materialize(both.groupBy("u", "v").agg(F.sum("first").alias("first"), F.sum("n").alias("n")), "candidates")
    for done in (bands, buckets, prints):
        drop(done)
    return out


def links(sets: DataFrame, docs: DataFrame) -> DataFrame:
    """Edges (u, v) between signs of similar sets: all candidates but those that other edges join already."""
    places = sets.select("sign", *ROW)
    pairs = candidates(sets)
    best = pairs.groupBy("v").agg(F.max(F.struct("first", "n", "u")).alias("b")).select(F.col("b.u").alias("u"), "v")
    best = materialize(best, "best")
    edges = similar(best, docs, places)
    roots = materialize(connected_components(edges), "roots")
    root = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root"))
    rest = pairs.select("u", "v").join(best, ["u", "v"], "left_anti")
    rest = rest.join(root("u"), "u", "left").join(root("v"), "v", "left").where("coalesce(u_root, u) <> coalesce(v_root, v)").select("u", "v")
    rest = materialize(rest, "rest")
    for done in (pairs, roots):
        drop(done)
    more = similar(rest, docs, places)
    found = materialize(edges.union(more), "joined")
    missed = materialize(unjoined(sets, found).join(best.union(rest), ["u", "v"], "left_anti"), "missed")
    last = similar(missed, docs, places)
    out = materialize(found.union(last), "links")
    for done in (best, rest, edges, more, found, missed, last):
        drop(done)
    return out


def unjoined(sets: DataFrame, edges: DataFrame) -> DataFrame:
    """Pairs (u, v) of signs whose fingerprints are within operator 1's three bits and that edges don't join.

    Operator 1 links fingerprints as trees, so of three that are near each other it gives two pairs. Those suffice for
    its own components, but here a pair counts only if its sets are similar, and the third pair may be the one that is.
    """
    roots = connected_components(edges).withColumnRenamed("node", "sign")
    named = materialize(sets.select("sign", "fp", "n").join(roots, "sign", "left").select("sign", "fp", "n", F.coalesce("root", "sign").alias("root")), "named")
    prints = materialize(named.groupBy("fp").agg(F.when(F.min("root") == F.max("root"), F.min("root")).alias("group")), "groups")
    near = simhash.pairs_apart(prints).union(prints.where("group is null").select(F.col("fp").alias("u"), F.col("fp").alias("v")))
    end = lambda c: named.select(F.col("fp").alias(c), F.struct("sign", "n", "root").alias(f"{c}_end"))
    both = near.join(end("u"), "u").join(end("v"), "v").where("u_end.root <> v_end.root and (u <> v or u_end.sign < v_end.sign)")
    both = both.where("5 * least(u_end.n, v_end.n) >= 4 * greatest(u_end.n, v_end.n)")
    return both.select(F.col("u_end.sign").alias("u"), F.col("v_end.sign").alias("v"))


def components(docs: DataFrame) -> DataFrame:
    """doc_id, ROW and root of each row of docs, which has a row key, as a written table: rows of one root are near copies."""
    rows = materialize(docs.select("doc_id", *ROW, signature_of("text").alias("s")).select("doc_id", *ROW, "s.*"), "signed")
    sets = materialize(rows.groupBy("sign").agg(F.min(F.struct(*ROW, "n", "fp", "bands")).alias("r")).select("sign", "r.*"), "sets")
    found = links(sets, docs)
    roots = materialize(connected_components(found).withColumnRenamed("node", "sign"), "roots")
    out = materialize(rows.select("doc_id", *ROW, "sign").join(roots, "sign", "left").select("doc_id", *ROW, F.coalesce("root", "sign").alias("root")), "components")
    for done in (rows, sets, found, roots):
        drop(done)
    return out


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay: of each component the row with the smallest doc_id, of equal ids one."""
    keyed = with_row_key(docs)
    held = components(keyed)
    first = held.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", *ROW)).alias("f"))
    stays = materialize(first.select(*(F.col(f"f.{c}").alias(c) for c in ROW)), "stays")
    drop(held)
    return keyed.join(stays.hint("merge"), list(ROW), "left_semi").drop(*ROW)
