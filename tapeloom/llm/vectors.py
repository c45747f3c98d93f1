"""Vector tables for the two searches: validity, distinct vectors with their smallest ids, shards, query blocks."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Queries of a block; a block meets each shard once.
BLOCK_QUERIES = 512


def valid(v: Column) -> Column:
    """True for vectors with components that are all finite numbers."""
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return v.isNotNull() & (F.size(v) > 0) & ~F.coalesce(bad, F.lit(True))


def clean(table: DataFrame) -> DataFrame:
    """(vec_id, v) of the valid rows; rows without a vec_id take no part."""
    return table.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("v")).where(F.col("vec_id").isNotNull() & valid(F.col("v")))


def one_vector(rows: DataFrame) -> DataFrame:
    """rows (vec_id, v), with one vector for each vec_id: of different vectors that share an id, the one whose hash is
    smallest counts, wherever it stands.

    Only hashes are grouped; ids with two of them are the rare case, whose table Spark joins by its size.
    """
    hashed = rows.withColumn("own", F.xxhash64("v"))
    spread = hashed.groupBy("vec_id").agg(F.min("own").alias("lo"), F.max("own").alias("hi")).where("lo <> hi").select("vec_id", "lo")
    return hashed.join(spread, "vec_id", "left").where("lo is null or own = lo").select("vec_id", "v")


def distinct_vectors(rows: DataFrame, keep: int) -> DataFrame:
    """(dim, h, v, ids): each distinct vector once, with its `keep` smallest ids.

    More ids of one vector can't be among keep - 1 results besides the query. The row_number filter prunes
    before the shuffle (group limit), so a vector that a third of the rows hold is not gathered anywhere.
    """
    keyed = rows.withColumn("h", F.xxhash64("v")).withColumn("g", F.xxhash64(F.lit(1), "v")).withColumn("dim", F.size("v"))
    order = Window.partitionBy("dim", "h", "g").orderBy("vec_id")
    few = keyed.withColumn("n", F.row_number().over(order)).where(F.col("n") <= keep)
    return few.groupBy("dim", "h", "g").agg(F.first("v").alias("v"), F.array_distinct(F.sort_array(F.collect_list("vec_id"))).alias("ids")).drop("g")


def shards(distinct: DataFrame, rows: int) -> tuple[DataFrame, DataFrame]:
    """distinct with a shard number, and (dim, shards) of the shard count of each dimension."""
    counts = distinct.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).select("dim", F.ceil(F.col("n") / rows).cast("int").alias("shards"))
    return distinct.join(F.broadcast(counts), "dim").withColumn("shard", F.pmod("h", "shards").cast("int")), counts


def query_blocks(queries: DataFrame, counts: DataFrame) -> DataFrame:
    """(dim, shard, ids, vectors): blocks of queries as binary, one row for each shard that they visit."""
    n = queries.count()
    blocks = max(1, math.ceil(n / BLOCK_QUERIES))

    def gather(table: pa.Table) -> pa.Table:
        ids = table.column("vec_id").to_numpy()
        order = np.argsort(ids, kind="stable")
        vectors = np.array(table.column("v").to_pylist(), np.float64)[order]
        return pa.table({"dim": pa.array([vectors.shape[1]], pa.int32()), "ids": [ids[order].astype("<i8").tobytes()], "vectors": [vectors.tobytes()]})

    rows = queries.dropDuplicates(["vec_id", "v"]).withColumn("dim", F.size("v")).withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)))
    packed = rows.groupBy("dim", "block").applyInArrow(gather, "dim int, ids binary, vectors binary")
    return packed.join(F.broadcast(counts), "dim").withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1))).drop("shards")


def best(found: DataFrame, k: int, nearest: bool) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of each query over all shards, ties to the smaller vec_id."""
    order = Window.partitionBy("query_id").orderBy(F.col("score").asc() if nearest else F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def flatten(ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and values of lists."""
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int64)
    return offsets, np.array([y for x in ids for y in x], np.int64)


def pick(scores: np.ndarray, rows: np.ndarray, offsets: np.ndarray, ids: np.ndarray, own: int, k: int, nearest: bool) -> list[tuple[int, object]]:
    """(vec_id, score) of the k best: rows with scores, each standing for all of its ids but the query's own."""
    pairs = [(s, i) for s, r in zip(scores.tolist(), rows.tolist()) for i in ids[offsets[r] : offsets[r + 1]].tolist() if i != own]
    pairs.sort(key=lambda p: (p[0] if nearest else -p[0], p[1]))
    return [(i, s) for s, i in pairs[:k]]
