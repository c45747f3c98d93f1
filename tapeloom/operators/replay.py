"""Replay of a tape: arrival times with injected lateness, micro-batches, delivery check."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def arrivals(trades: DataFrame, mean_s: float = 10.0, late_permille: int = 20) -> DataFrame:
    """trades with arrival_us: a share of them, picked by id, is late by an exponential delay drawn from the id."""
    i = F.col("agg_trade_id")
    u = (F.pmod(i * 7919 + 13, F.lit(100_000)) + F.lit(0.5)) / F.lit(100_000)
    delay = F.floor(-F.log(F.lit(1.0) - u) * F.lit(float(mean_s)) * F.lit(1e6)).cast("long")
    late = F.pmod(i * 104_729, F.lit(1000)) < late_permille
    return trades.withColumn("injected", late).withColumn("arrival_us", F.col("event_us") + F.when(late, delay).otherwise(F.lit(0)))


def random_arrivals(trades: DataFrame, fraction: float, mean_s: float, seed: int = 42) -> DataFrame:
    """As arrivals, with Spark's generator: the same distribution, other draws."""
    delay = F.floor(-F.log(F.lit(1.0) - F.rand(seed)) * F.lit(float(mean_s)) * F.lit(1e6)).cast("long")
    late = F.rand(seed + 1) < fraction
    return trades.withColumn("injected", late).withColumn("arrival_us", F.col("event_us") + F.when(late, delay).otherwise(F.lit(0)))


def batched(arrived: DataFrame, tick_s: float = 0.5) -> DataFrame:
    """arrived with batch_id (from 0, without gaps) and clock_us, the last instant of the batch's tick.

    The numbering runs over one row a batch; the trades meet it in an equi join.
    """
    tick = int(tick_s * 1_000_000)
    start = arrived.agg(F.min("event_us").alias("start_us"))
    raw = arrived.crossJoin(F.broadcast(start)).withColumn("slot", F.floor((F.col("arrival_us") - F.col("start_us")) / tick).cast("long"))
    slots = raw.groupBy("slot").agg(F.min("start_us").alias("s")).select("slot", (F.row_number().over(Window.orderBy("slot")) - 1).alias("batch_id"), (F.col("s") + (F.col("slot") + 1) * tick).alias("clock_us"))
    return raw.join(slots, "slot").drop("slot", "start_us")


def in_arrival_order(arrived: DataFrame) -> DataFrame:
    return arrived.orderBy("arrival_us", "symbol", "agg_trade_id")


def delivery(emitted: DataFrame, landed: DataFrame) -> DataFrame:
    """emitted, landed and distinct counts, and whether all agree."""
    one = landed.agg(F.count(F.lit(1)).alias("landed"), F.countDistinct("symbol", "agg_trade_id").alias("distinct_rows"))
    return emitted.agg(F.count(F.lit(1)).alias("emitted")).crossJoin(one).withColumn("ok", (F.col("emitted") == F.col("landed")) & (F.col("landed") == F.col("distinct_rows")))
