"""Operator 9: exact duplicates by deterministic block naming.

A normalised text is cut into blocks of BLOCK bytes. Distinct blocks are sorted and numbered, so equal blocks,
and only those, share an integer name. Then neighbouring names are paired, distinct pairs are sorted and numbered
in turn, and so on until each document has one name. Names are given to contents, not to hashes, so nothing
collides. A level halves the rows; documents with their one name wait. Documents of different block counts end
at different levels, so (blocks, name) is the identity.

Distinct blocks and pairs are combined before their shuffle, so a text held by a third of all rows is one row a
task there. In the join that gives rows their names, the HOT commonest values are named by broadcast, which is
HOT blocks at most, and their rows are spread over all tasks; any other value has less than one in HOT of the rows.
The last join has a written table on either side, which lets Spark split it at a hot group.

Defined results: a null text counts as empty; empty texts are equal to each other, and a text of white space only
is one space. Among repeated rows of one doc_id exactly one is kept. A null doc_id sorts after all others, and is
the keep_id only where a group has no other. Extra columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from watchgrid.llm.common import ROW, WHITE, drop, materialize, table, with_row_key

BLOCK = 1024
#: How many of the commonest values are named by broadcast, and the rows from which a value counts as common.
HOT, COMMON = 1000, 1000


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"{WHITE}+", " ")


def numbered(values: DataFrame, name: str) -> DataFrame:
    """The distinct rows of values with an integer each, rising in sort order within a partition."""
    return values.distinct().sortWithinPartitions(*values.columns).withColumn(name, F.monotonically_increasing_id())


def with_names(rows: DataFrame, values: DataFrame) -> DataFrame:
    """rows (row, and the columns of values) with the integer name of their value; a hot value has one below -1."""
    columns, key = values.columns, F.xxhash64(*values.columns)
    counts = values.groupBy(key.alias("key")).agg(F.count("*").alias("n")).where(F.col("n") >= COMMON)
    keys = [r["key"] for r in counts.orderBy(F.desc("n"), "key").limit(HOT).collect()]
    names = numbered(values, "name")
    if not keys:
        return rows.join(names, columns)
    hot = numbered(values.where(key.isin(keys)), "hot").withColumn("hot", -2 - F.col("hot"))
    # the row's number takes the place of a hot value in the shuffle; what it may meet there gives way to the hot name
    spread = F.when(F.col("hot").isNull(), F.col(columns[0])).otherwise(F.col("row").cast("string").cast(dict(values.dtypes)[columns[0]]))
    held = rows.join(F.broadcast(hot), columns, "left").withColumn(columns[0], spread)
    return held.join(names, columns, "left").withColumn("name", F.coalesce("hot", "name")).drop("hot")


def identities(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keys: tuple[str, ...] = (), block: int = BLOCK, made: list[DataFrame] | None = None) -> DataFrame:
    """(doc, blocks, name) for each row; doc is a struct of doc_id, sha, row and the key columns. made gets the tables that it reads."""
    made = [] if made is None else made
    held = docs.select(F.col(doc_id).alias("doc_id"), normalised(F.col(text)).cast("binary").alias("data"), *keys)
    count = F.greatest(F.lit(1), F.ceil(F.octet_length("data") / block)).cast("int")
    cut = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.substring(F.col("data"), k * block + 1, F.lit(block)))
    pieces = held.withColumn("blocks", count)
    # a row is numbered before it is cut: one select would number each of its blocks
    rows = pieces.withColumn("row", F.monotonically_increasing_id()).withColumn("sha", F.sha2("data", 256))
    rows = rows.select("row", "sha", "doc_id", *keys, "blocks", F.posexplode(cut).alias("pos", "block"))
    doc = F.when(F.col("pos") == 0, F.struct("doc_id", F.unhex("sha").alias("sha"), "row", *keys)).alias("doc")
    now = materialize(with_names(rows.select("row", "blocks", "pos", "block", doc), pieces.select(F.explode(cut).alias("block"))).select("row", "blocks", F.col("blocks").alias("left"), "pos", "name", "doc"), "names")
    done = []
    while True:
        made.append(now)
        done.append(now.where("left = 1").select("doc", "blocks", "name"))
        rest = now.where("left > 1")
        if rest.isEmpty():
            return reduce(DataFrame.union, done)
        pairs = rest.groupBy("row", F.shiftright("pos", 1).alias("pos"), "blocks", "left").agg(
            F.min(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("a"),
            F.coalesce(F.min(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(-1)).alias("b"),
            F.first("doc", ignorenulls=True).alias("doc"),
        )
        pairs = materialize(pairs, "pairs")
        now = materialize(with_names(pairs, pairs.select("a", "b")).select("row", "blocks", F.shiftright(F.col("left") + 1, 1).alias("left"), "pos", "name", "doc"), "names")
        drop(pairs)


def exact_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keys: tuple[str, ...] = (), block: int = BLOCK, made: list[DataFrame] | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 for each row of docs, and the key columns asked for. made gets the tables that it reads."""
    made = [] if made is None else made
    named = identities(docs, doc_id, text, keys, block, made).select("blocks", "name", "doc.*")
    first = named.groupBy("blocks", "name").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first"), F.count("*").alias("group_size"))
    first = materialize(first, "first")
    made.append(first)
    return named.join(first, ["blocks", "name"]).select("doc_id", F.col("first.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("first.row")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"), *keys)


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay."""
    keyed, made = with_row_key(docs), []
    stays = materialize(exact_duplicates(keyed, keys=ROW, made=made).where("kept").select(*ROW), "stays")
    for done in made:
        drop(done)
    # the rows that stay are in proportion to the documents: a join by shuffle at every size
    return keyed.join(stays.hint("merge"), list(ROW), "left_semi").drop(*ROW)


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))


OP9_SQL = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents)
SELECT doc_id,
       min(doc_id) OVER (PARTITION BY body) AS keep_id,
       count(*) OVER (PARTITION BY body) AS group_size,
       row_number() OVER (PARTITION BY body ORDER BY doc_id NULLS LAST) = 1 AS kept,
       sha256(body) AS text_sha256
FROM t
"""
