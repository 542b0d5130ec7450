"""Operator 1: SimHash near-duplicates by a self-join of binary tries.

Fingerprints that differ in at most three bits link. Four tries hold each distinct fingerprint, each turned so
that another 16-bit block comes first: three differing bits leave one of four blocks untouched, so every linking
pair meets in the trie whose first block it shares. There the first 16 levels are walked with an error budget of
zero and the other 48 with a budget of three: pairs of nodes go down together, add up the bits in which they
differ, and are pruned once those exceed the budget. Pairs are joined into trees at once, so a block gives at
most one edge per fingerprint, however many pairs link in it.

Defined results: null and empty texts, and texts of white space only, have fingerprint zero and link like any
other. Repeated rows share a component. A null doc_id takes part but never names a component while another
doc_id is there; a component of null ids only has a null component_id. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from watchgrid.llm.common import ROW, connected_components, materialize, table, with_row_key

BITS, BLOCK, BUDGET = 64, 16, 3
#: Fingerprints that one batch walks at most before the next block starts a new batch.
BATCH = 1 << 15
#: A block with more distinct fingerprints than this is dealt out by pairs of its nodes.
HEAVY = 1 << 16
#: Pairs of nodes that one step takes down a level at a time.
SLICE = 1 << 19


def fingerprint(text: bytes, width: int = 3, seed: int = 42) -> int:
    """64-bit SimHash of the width-word shingles of a lower-cased text; zero without words."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) <= width:
        return xxhash.xxh64_intdigest(b" ".join(words), seed)
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts, stops = [0, *ends[:-width].tolist()], (ends[width - 1 :] - 1).tolist()
    hash64, total, counts = xxhash.xxh64_intdigest, len(stops), np.zeros(BITS, np.int64)
    for at in range(0, total, 16384):
        each = np.fromiter((hash64(line[a:b], seed) for a, b in zip(starts[at : at + 16384], stops[at : at + 16384])), np.uint64)
        # bits of each hash, most significant first
        bits = np.unpackbits(each.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        for k in range(0, len(bits), 255):  # a byte holds 255 ones
            counts += bits[k : k + 255].sum(0, dtype=np.uint8)
    return int.from_bytes(np.packbits(counts * 2 > total).tobytes(), "big")


@F.arrow_udf(T.LongType())
def fingerprint_of(texts: pa.Array) -> pa.Array:
    got = [fingerprint(t or b"") for t in texts.cast(pa.large_binary()).to_pylist()]
    return pa.array(np.array(got, np.uint64).view(np.int64))


def linked(codes: np.ndarray, a0: np.ndarray, a1: np.ndarray, b0: np.ndarray, b1: np.ndarray, depth: int, wanted: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of codes within BUDGET bits, found by walking the node pairs ([a0,a1), [b0,b1)) down together.

    A node is a range of sorted codes that share their first depth bits; a pair of equal ranges is a node with
    itself. Where the levels left can't exceed the budget any more, the two ranges are linked through their
    first member, which joins all of them without all pairs. With wanted, a test of pairs, there are no such
    short cuts: every pair within the budget that passes it is given.
    """
    us, vs = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    ones: dict[int, np.ndarray] = {}
    # slices of a level's pairs, deepest first, so that the frontier held stays bounded
    stack = [(depth, a0, a1, b0, b1, np.zeros(len(a0), np.int8))]
    while stack:
        depth, *pairs = stack.pop()
        if len(pairs[0]) > SLICE:
            stack += [(depth, *(x[SLICE:] for x in pairs)), (depth, *(x[:SLICE] for x in pairs))]
            continue
        a0, a1, b0, b1, dist = pairs
        leaf = (a1 - a0 == 1) & (b1 - b0 == 1)
        u, v = a0[leaf], b0[leaf]
        near = np.bitwise_count(codes[u] ^ codes[v]) <= BUDGET
        if wanted is not None:
            near &= wanted(u, v)
        us.append(u[near])
        vs.append(v[near])
        whole = ~leaf & (dist + (BITS - depth) <= BUDGET)
        for k in np.flatnonzero(whole):
            if wanted is not None:
                u, v = (x.ravel() for x in np.meshgrid(np.arange(a0[k], a1[k]), np.arange(b0[k], b1[k])))
                some = wanted(u, v) & ((u < v) | (a0[k] != b0[k]))
                us.append(u[some])
                vs.append(v[some])
                continue
            members = np.r_[a0[k] : a1[k], b0[k] : b1[k]]
            us.append(np.full(len(members), a0[k]))
            vs.append(members)
        a0, a1, b0, b1, dist = (x[~leaf & ~whole] for x in (a0, a1, b0, b1, dist))
        if not len(a0):
            continue
        if depth not in ones:
            ones[depth] = np.r_[0, np.cumsum((codes >> np.uint64(BITS - 1 - depth)) & np.uint64(1))].astype(np.int64)
        count = ones[depth]
        am, bm = a1 - (count[a1] - count[a0]), b1 - (count[b1] - count[b0])
        same = a0 == b0
        children = (
            (a0, am, b0, bm, dist),
            (am, a1, bm, b1, dist),
            (a0, am, bm, b1, dist + 1),
            (am, a1, b0, np.where(same, b0, bm), dist + 1),  # of a node with itself, only one of the mirror images
        )
        kept = [[x[(p1 > p0) & (q1 > q0) & (e <= BUDGET) & ~((p0 == q0) & (p1 - p0 == 1))] for x in (p0, p1, q0, q1, e)] for p0, p1, q0, q1, e in children]
        stack.append((depth + 1, *(np.concatenate(x) for x in zip(*kept))))
    return np.concatenate(us), np.concatenate(vs)


def roots_of(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Smallest index that each of n indexes reaches over the pairs (u, v)."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[u], root[v])
        before = root.copy()
        np.minimum.at(root, root[u], low)
        np.minimum.at(root, root[v], low)
        while (root[root] != root).any():
            root = root[root]
        if (root == before).all():
            return root


def block_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (unit, side, code, fp), sorted, to edges (u, v) between fingerprints; a unit's rows stand together.

    A unit is a pair of nodes: rows of side 0 and of side 1; with side 0 alone, a node with itself. Edges join a
    unit's fingerprints as trees; where rows have a group, every pair of two groups is given instead, a null group
    being none of the others.
    """
    held: list[pa.RecordBatch] = []

    def walk(rows: pa.Table) -> pa.RecordBatch:
        unit = rows.column("unit").combine_chunks().dictionary_encode().indices.to_numpy()
        side, code, fp = (rows.column(k).to_numpy() for k in ("side", "code", "fp"))
        cut = np.flatnonzero(np.r_[True, unit[1:] != unit[:-1]])
        end = np.r_[cut[1:], len(unit)]
        ones = np.r_[0, np.cumsum(side)]
        mid = end - (ones[end] - ones[cut])  # side 1 follows side 0
        own = mid == end
        some = own & (end - cut > 1) | (cut < mid) & (mid < end)
        cut, mid, end, own = cut[some], mid[some], end[some], own[some]
        nodes = (code.view(np.uint64), cut, mid, np.where(own, cut, mid), end, BLOCK)
        if "group" in rows.column_names:
            none, group = (pc.is_null(rows["group"]).to_numpy(), pc.fill_null(rows["group"], 0).to_numpy())
            u, v = linked(*nodes, lambda u, v: (group[u] != group[v]) | none[u] | none[v])
            return pa.RecordBatch.from_arrays([pa.array(fp[u]), pa.array(fp[v])], ["u", "v"])
        u, v = linked(*nodes)
        root = roots_of(len(fp), u, v)
        child = np.flatnonzero(root != np.arange(len(root)))
        return pa.RecordBatch.from_arrays([pa.array(fp[child]), pa.array(fp[root[child]])], ["u", "v"])

    for batch in batches:
        held.append(batch)
        if sum(map(len, held)) >= BATCH:
            rows = pa.Table.from_batches(held)
            last = rows.column("unit")[-1]
            cut = pc.index(rows.column("unit"), last).as_py()  # the last unit may go on in the next batch
            if cut:
                yield walk(rows.slice(0, cut))
                held = rows.slice(cut).to_batches()
    if sum(map(len, held)):
        yield walk(pa.Table.from_batches(held))


def split_heavy(units: DataFrame, heavy: int = HEAVY) -> DataFrame:
    """Take units of more than heavy rows four levels down, again and again: each becomes its pairs of child nodes.

    A row goes to the pairs of its child node with all child nodes of the other side that the budget allows.
    Fingerprints are distinct, so a node at depth d has 2^(64-d) rows at most, and the loop ends.
    """
    done, level = None, BLOCK
    near = [(m, bin(m).count("1")) for m in range(16) if bin(m).count("1") <= BUDGET]
    while True:
        large = units.groupBy("unit").agg(F.count("*").alias("n"), F.max("side").alias("sides"), F.min("side").alias("least")).where(F.col("n") > heavy)
        large = materialize(large.select("unit", (F.col("sides") != F.col("least")).alias("crossed"), (F.col("least") == 0).alias("first")), "heavy")
        if level >= BITS - 4 or large.isEmpty():
            return units if done is None else done.union(units)
        rest = units.join(large.select("unit"), "unit", "left_anti")
        done = rest if done is None else done.union(rest)
        child = F.shiftrightunsigned("code", BITS - 4 - level).bitwiseAND(15)
        pairs = F.array(*[F.struct(F.lit(m).alias("mask"), F.lit(n).alias("more")) for m, n in near])
        other = F.col("c").bitwiseXOR(F.col("p.mask"))
        own = ~F.col("crossed")
        side = F.when(own, (F.col("c") > other).cast("int")).otherwise(F.col("side"))
        a, b = F.when(own, F.least("c", other)).when(F.col("side") == 0, F.col("c")).otherwise(other), F.when(own, F.greatest("c", other)).when(F.col("side") == 0, other).otherwise(F.col("c"))
        units = materialize(
            units.join(large.where("crossed or first"), "unit")
            .withColumn("c", child)
            .withColumn("p", F.explode(pairs))
            .where(F.col("dist") + F.col("p.more") <= BUDGET)
            .select(F.concat_ws("/", "unit", F.concat_ws("-", a.cast("string"), b.cast("string"))).alias("unit"), side.cast("int").alias("side"), "code", "fp", (F.col("dist") + F.col("p.more")).alias("dist")),
            "units",
        )
        level += 4


def blocks(prints: DataFrame, heavy: int) -> DataFrame:
    """Units of the four tries of the distinct fingerprints fp."""
    turned = [F.struct(F.lit(k).alias("k"), (F.shiftleft("fp", BLOCK * k).bitwiseOR(F.shiftrightunsigned("fp", BITS - BLOCK * k)) if k else F.col("fp")).alias("code")) for k in range(BITS // BLOCK)]
    tries = prints.select("fp", F.explode(F.array(*turned)).alias("t"))
    units = tries.select(F.concat_ws("-", F.col("t.k").cast("string"), F.shiftrightunsigned("t.code", BITS - BLOCK).cast("string")).alias("unit"), F.lit(0).alias("side"), F.col("t.code").alias("code"), "fp", F.lit(0).alias("dist"))
    return split_heavy(units, heavy)


def links(prints: DataFrame, heavy: int = HEAVY) -> DataFrame:
    """Edges (u, v) that join every two of the distinct fingerprints fp that lie within BUDGET bits of each other."""
    units = blocks(prints, heavy)
    return units.repartition("unit").sortWithinPartitions("unit", "side", "code").select("unit", "side", "code", "fp").mapInArrow(block_edges, "u long, v long")


def pairs_apart(prints: DataFrame, heavy: int = HEAVY) -> DataFrame:
    """All pairs (u, v) within BUDGET bits of the distinct fingerprints fp whose groups differ, each once; a null group
    differs from any."""
    units = blocks(prints, heavy).join(prints.select("fp", "group"), "fp")
    found = units.repartition("unit").sortWithinPartitions("unit", "side", "code").select("unit", "side", "code", "fp", "group").mapInArrow(block_edges, "u long, v long")
    return found.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def components(prints: DataFrame, heavy: int = HEAVY) -> DataFrame:
    """(fp, component_id) of each distinct fingerprint in prints (doc_id, fp): the smallest doc_id reachable.

    Each side of a join by a key that may be hot is a written table, so that Spark can split the join there.
    """
    low = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("low")), "low")
    found = connected_components(links(prints.select("fp").distinct(), heavy))
    named = materialize(found.join(low, found["node"] == low["fp"]).select("fp", "root", "low"), "named")
    least = materialize(named.groupBy("root").agg(F.min("low").alias("least")), "least")
    small = named.join(least, "root").select(F.col("fp").alias("node"), "least")
    return materialize(low.join(small, low["fp"] == small["node"], "left").select("fp", F.coalesce("least", "low").alias("component_id")), "components")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keys: tuple[str, ...] = (), heavy: int = HEAVY) -> DataFrame:
    """doc_id, fingerprint, component_id for each row of docs, and the key columns asked for."""
    prints = materialize(docs.select(F.col(doc_id).alias("doc_id"), fingerprint_of(F.col(text)).alias("fp"), *keys), "prints")
    named = components(prints, heavy)
    return prints.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", *keys)


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay: of each component the row with the smallest doc_id, of equal ids one."""
    keyed = with_row_key(docs)
    # the component and the row's place in it; null ids come last
    rows = materialize(near_duplicates(keyed, keys=ROW), "members")
    first = rows.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", *ROW)).alias("f"), F.count("*").alias("size"))
    # a null component is a single group of null ids with several fingerprints: told apart by fingerprint
    alone = rows.where("component_id is null").groupBy("fingerprint").agg(F.min(F.struct(*ROW)).alias("f"))
    stays = first.where("component_id is not null").select(*(F.col(f"f.{c}").alias(c) for c in ROW)).union(alone.select(*(F.col(f"f.{c}").alias(c) for c in ROW)))
    return keyed.join(stays, list(ROW), "left_semi").drop(*ROW)


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
