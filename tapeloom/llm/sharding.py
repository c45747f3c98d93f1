"""Sharding by minimax contiguous partition over atomic groups of equal texts.

Groups are ordered by the 64-bit hash of their text. The smallest feasible shard capacity is found by
binary search with a greedy check. The check runs on the driver over block sums: blocks are hash ranges,
65,536 at first; only blocks in which a cut may fall are split further, by 8 bits a round, until the
capacity is exact. What reaches the driver is thus bounded by the block count, not by the data.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize

FIRST_BITS, STEP_BITS = 16, 8
#: Slots are numbered within this many cells a shard, so no task sorts a whole shard.
CELLS = 4096


def _size(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + F.lit(8)).cast("long")


def _blocks(groups: DataFrame, bits: int, within: DataFrame | None = None, parent_bits: int = 0) -> np.ndarray:
    """Rows (block, bits, bytes, groups, largest group) of the hash ranges of 2^bits keys."""
    g = groups
    if within is not None:
        g = g.withColumn("parent", F.shiftright("h", parent_bits)).join(F.broadcast(within), "parent")
    rows = g.groupBy(F.shiftright("h", bits).alias("block")).agg(F.sum("bytes"), F.count(F.lit(1)), F.max("bytes")).collect()
    return np.array([(r[0], bits, r[1], r[2], r[3]) for r in rows], dtype=np.int64).reshape(-1, 5)


class _Order:
    """Blocks in key order with their prefix sums."""

    def __init__(self, blocks: np.ndarray):
        start = np.left_shift(blocks[:, 0], blocks[:, 1])
        self.blocks = blocks[np.argsort(start, kind="stable")]
        self.start = np.sort(start, kind="stable")
        self.sums, self.single = self.blocks[:, 2], self.blocks[:, 3] == 1
        self.prefix = np.concatenate([[0], np.cumsum(self.sums)])
        self.total, self.largest = int(self.prefix[-1]), int(self.blocks[:, 4].max(initial=0))

    def walk(self, capacity: int, shards: int, fluid: bool, at: int = 0) -> tuple[list[int], bool]:
        """Greedy cut positions in bytes from byte `at`, and whether the shards hold all. fluid: a block
        of several groups may be cut anywhere, which is a lower bound; else nowhere, an upper bound."""
        cuts = []
        for _ in range(shards):
            if (reach := at + capacity) >= self.total:
                return cuts, True
            i = int(np.searchsorted(self.prefix, reach, "right")) - 1
            at = reach if fluid and not self.single[i] else int(self.prefix[i])
            cuts.append(at)
        return cuts, False

    def least(self, shards: int, fluid: bool) -> int:
        lo, hi = max(-(-self.total // shards), self.largest if fluid else int(self.sums.max(initial=0)), 1), max(self.total, 1)
        while lo < hi:
            mid = (lo + hi) // 2
            lo, hi = (lo, mid) if self.walk(mid, shards, fluid)[1] else (mid + 1, hi)
        return lo

    def open(self, shards: int) -> np.ndarray:
        """Blocks of several groups that must be split: those over a 64th of an even shard, or else those
        in which a cut may fall."""
        many = ~self.single
        if (big := many & (self.sums > self.total // (64 * shards))).any():
            return big
        low, high = self.least(shards, True), self.least(shards, False)
        mask = np.zeros(len(self.sums), bool)
        if low < high:
            early, late = self.walk(low, shards, False)[0], self.walk(high, shards, True)[0]
            for k, e in enumerate(early):
                l = late[k] if k < len(late) else self.total
                i, j = np.searchsorted(self.prefix, [e, l], "right") - 1
                mask[max(0, i - 1) : j + 1] = True
        return mask & many


def _cuts(order: _Order, shards: int) -> tuple[int, list[int]]:
    """The capacity, and shards - 1 first keys of later shards. Every shard stays within the smallest
    feasible capacity; below it, the cut nearest to an even share of what remains is taken."""
    capacity = order.least(shards, False)
    at, cuts = 0, []
    for k in range(shards - 1):
        left = shards - k
        first = int(np.searchsorted(order.prefix, at))
        far = int(np.searchsorted(order.prefix, at + capacity, "right")) - 1
        even = at + (order.total - at) / left
        i = min(max(int(np.abs(order.prefix[first : far + 1] - even).argmin()) + first, first), far)
        lo, hi = i, far  # the remaining shards must suffice; later cuts leave less
        while lo < hi:
            mid = (lo + hi) // 2
            lo, hi = (lo, mid) if order.walk(capacity, left - 1, False, int(order.prefix[mid]))[1] else (mid + 1, hi)
        at = int(order.prefix[lo])
        cuts.append(int(order.start[lo]) if lo < len(order.start) else None)
    return capacity, cuts


def plan_cuts(groups: DataFrame, shards: int) -> tuple[int, list[int]]:
    """Capacity and cut keys for groups (h, bytes)."""
    blocks = _blocks(groups, 64 - FIRST_BITS)
    if not len(blocks):
        return 0, [None] * (shards - 1)
    order = _Order(blocks)
    spark = groups.sparkSession
    while (mask := order.open(shards)).any():
        parts = [order.blocks[~mask]]
        for bits in np.unique(order.blocks[mask, 1]):
            ids = order.blocks[mask & (order.blocks[:, 1] == bits), 0]
            within = spark.createDataFrame([(int(x),) for x in ids], "parent long")
            parts.append(_blocks(groups, max(0, int(bits) - STEP_BITS), within, int(bits)))
        order = _Order(np.concatenate(parts))
    return _cuts(order, shards)


def shard_documents(docs: DataFrame, shards: int = 24) -> DataFrame:
    """Documents with shard, slot and law: equal texts share a shard, the largest shard is as small as
    contiguous cuts of the hash order allow, and slots count from 0 in each shard without gaps.

    Null text counts as the empty text (size 8, checksum 0). Null and repeated doc_ids keep a row each.
    An empty table gives no rows. Other columns are not read.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = materialize(docs.select("doc_id", _size(F.col("text")).alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("h")), "shard")
    groups = materialize(slim.groupBy("h").agg(F.sum("size").alias("bytes")), "groups")
    _, cuts = plan_cuts(groups, shards)
    shard = sum(((F.col("h") >= F.lit(c)).cast("int") for c in cuts if c is not None), F.lit(0))
    placed = slim.withColumn("shard", shard).withColumn("cell", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(CELLS)).cast("int"))
    counts = placed.groupBy("shard", "cell").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("shard", "cell", (F.sum("n").over(Window.partitionBy("shard").orderBy("cell")) - F.col("n")).alias("base"))
    local = F.row_number().over(Window.partitionBy("shard", "cell").orderBy("doc_id", "h"))
    # at most shards * CELLS rows are broadcast
    return (
        placed.withColumn("local", local).join(F.broadcast(before), ["shard", "cell"])
        .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("base") + F.col("local") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    )
