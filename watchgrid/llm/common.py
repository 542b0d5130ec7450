"""Helpers that the operators share: scratch tables, row keys, splits and components."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, the only word separator that the operators know.
WHITE = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only a local master, where driver and executors are one process, may leave it unset.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"file://{tempfile.gettempdir()}/watchgrid-{os.getuid()}"


@contextmanager
def shuffles_deleted(spark: SparkSession) -> Iterator[None]:
    """Within it, a write's shuffle files go as soon as it is done, rather than when the driver collects garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: cuts lineage and survives lost executors.

    The files go when the driver ends, or at drop().
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/wg-{uuid.uuid4().hex}/{name}"
    with shuffles_deleted(spark):
        df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where.getParent())
    out = spark.read.schema(df.schema).parquet(path)
    out._wg_path = path
    return out


def drop(df: DataFrame) -> None:
    """Delete the files of a materialize() result that nothing reads any more."""
    spark = df.sparkSession
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df._wg_path).getParent()
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


ROW = ("_wg_file", "_wg_index")


def with_row_key(df: DataFrame) -> DataFrame:
    """df with the two ROW columns, which name a row and stay the same however the scan is split or retried.

    They are a hash of the file's path and the row's place in it; a frame that isn't read from files is written first.
    """
    try:
        meta = df.metadataColumn("_metadata")
        return df.select("*", F.xxhash64(meta["file_path"]).alias(ROW[0]), meta["row_index"].alias(ROW[1]))
    except AnalysisException:
        return with_row_key(materialize(df, "rows"))


def split_of(key: Column, mod: int) -> Column:
    """crc32 of the key as text, modulo mod; a null key counts as the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % mod


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of edges (u, v): root is the smallest node that it reaches.

    Alternating stars: each round hooks every node's larger neighbours to its smallest one, then the smaller
    ones; rounds end when no pair changes. A node's neighbours are never gathered: each step is a minimum by
    key, which Spark combines before its shuffle, and a join on that key. Each round is written out, and so are the
    minima: a join of two written tables can be split at a node with very many neighbours.
    """
    now = materialize(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    sign = None
    while True:
        both = now.union(now.select("v", "u"))
        low = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "low")
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = materialize(large, "large")
        least = materialize(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        new = materialize(small, "edges")
        for done in (low, large, least, now):
            drop(done)
        now = new
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(seen) == sign:
            break
        sign = tuple(seen)
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
