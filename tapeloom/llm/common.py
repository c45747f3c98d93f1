"""Shared helpers: durable intermediate tables, word patterns, connected components."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a maximal run of characters other than the six ASCII white-space ones.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """Folder that all executors share: spark.checkpoint.dir. Where that is unset, local sessions get a folder of
    their own, and on a cluster, whose executors would not see it, that is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tapeloom-")
        spark.sparkContext.setCheckpointDir(base)
    return base


def new_path(spark: SparkSession, label: str) -> str:
    return os.path.join(shared_dir(spark), f"{label}-{uuid.uuid4().hex}")


#: Drops the shuffle files of a write once it has ended, rather than at the driver's next garbage collection.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back: cuts lineage, survives lost executors,
    and later readers take only the columns that they need."""
    spark = df.sparkSession
    path, before = new_path(spark, label), spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    stored = spark.read.schema(df.schema).parquet(path)
    stored.stored_at = path
    return stored


def materialize_by(df: DataFrame, label: str, column: str) -> DataFrame:
    """Like materialize, in buckets of a column: later joins on it take the rows where they are, so that wide rows are
    shuffled once and not in each join."""
    spark = df.sparkSession
    name, n, before = f"{label}_{uuid.uuid4().hex}", int(spark.conf.get("spark.sql.shuffle.partitions")), spark.conf.get(_CLEANUP, "false")
    path = new_path(spark, label)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.repartition(n, column).write.option("compression", "zstd").option("path", path).bucketBy(n, column).format("parquet").saveAsTable(name)
    finally:
        spark.conf.set(_CLEANUP, before)
    stored = spark.table(name)
    stored.stored_at, stored.stored_as = path, name
    return stored


def discard(*tables: DataFrame) -> None:
    """Deletes tables that materialize or materialize_by wrote, once all that is made of them is written."""
    for table in tables:
        jvm, spark = table.sparkSession._jvm, table.sparkSession
        if name := table.__dict__.get("stored_as"):
            spark.sql(f"DROP TABLE IF EXISTS {name}")
        path = jvm.org.apache.hadoop.fs.Path(table.stored_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def word_count(text: Column) -> Column:
    """Number of words; null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def unit_interval(key: Column, seed: str) -> Column:
    """Number in (0, 1) from the md5 of seed and key: the same in any engine and on any rerun."""
    hex13 = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null")))), 1, 13)
    return (F.conv(hex13, 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for all nodes of the undirected edges (a, b); component is the smallest node reachable.

    Alternating large-star and small-star rounds over DataFrames: each round is a min per node (with
    map-side combine) and a join back, so a hub is never gathered in one task; rounds grow with the
    logarithm of the longest chain. Only two counts per round reach the driver.
    """
    e = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc")
    seen = None
    for _ in range(max_rounds):
        both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e1 = large.where("a <> b").distinct()
        low1 = e1.groupBy("a").agg(F.min("b").alias("m"))
        small = e1.join(low1, "a")
        nxt = small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low1.select("a", F.col("m").alias("b"))).distinct()
        old, e = e, materialize(nxt, "cc")
        discard(old)
        mark = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if mark == seen:
            break
        seen = mark
    else:
        raise RuntimeError("connected components did not settle")
    nodes = e.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component"))
    roots = e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return nodes.union(roots.join(nodes.select("node"), "node", "left_anti"))
