"""Watermark-closed bars in closed form: what each batch accepts, drops and emits depends on per-batch facts only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import floor_to, ratio
from ..sources.stage import staged


#: Batches whose running maximum is taken in one task.
BATCH_BLOCK = 65_536


def watermarks(batches: DataFrame, lateness_s: float) -> DataFrame:
    """(batch_id, clock, min_event, wm, pwm): the watermark after each batch and the one before it. One row a batch; running
    maxima are taken by blocks of batches, and the blocks before are added, one row a block."""
    per = batches.groupBy("batch_id").agg(F.max("event_us").alias("max_event"), F.max("clock_us").alias("clock"), F.min("event_us").alias("min_event"))
    per = per.withColumn("_block", F.floor(F.col("batch_id") / BATCH_BLOCK))
    own = Window.partitionBy("_block").orderBy("batch_id")
    tops = per.groupBy("_block").agg(F.max("max_event").alias("_top"))
    before = tops.select("_block", F.max("_top").over(Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)).alias("_before"))
    late = F.lit(int(lateness_s * 1_000_000))
    seen = lambda last: F.greatest(F.max("max_event").over(own.rowsBetween(Window.unboundedPreceding, last)), F.col("_before")) - late
    return per.join(before, "_block").select("batch_id", "max_event", "clock", "min_event", seen(0).alias("wm"), seen(-1).alias("pwm"))


def split_late(batches: DataFrame, marks: DataFrame, step: int) -> DataFrame:
    """batches with bar_us, pwm and late: the bar ended at or before the watermark that the batch met."""
    bar = floor_to(F.col("event_us"), step)
    return batches.join(marks.select("batch_id", "pwm"), "batch_id").withColumn("bar_us", bar).withColumn("late", F.coalesce(F.col("bar_us") + step <= F.col("pwm"), F.lit(False)))


def _ohlcv() -> list[Column]:
    amount = (F.col("price") * F.col("quantity")).cast("decimal(36,16)")
    sell = F.when(F.col("is_buyer_maker"), F.col("quantity")).otherwise(F.lit(0).cast("decimal(18,8)"))
    return [
        F.min_by("price", "agg_trade_id").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "agg_trade_id").alias("close"),
        F.sum("quantity").cast("decimal(24,8)").alias("volume"), F.sum(amount).cast("decimal(28,8)").alias("quote_volume"), F.sum(sell).cast("decimal(24,8)").alias("sell_volume"), F.count(F.lit(1)).alias("trade_count"),
    ]


def trade_bars(trades: DataFrame, step: int) -> DataFrame:
    """Bars straight from trades: the hindsight truth, and the candles that stand in for official ones."""
    return trades.withColumn("bar_us", floor_to(F.col("event_us"), step)).groupBy("symbol", "bar_us").agg(*_ohlcv())


def emitted(bars: DataFrame, marks: DataFrame, step: int) -> DataFrame:
    """bars with emitted_us: the clock of the first batch whose watermark reached the bar's end, else of the last
    batch. Each batch lists the bar ends that it passes, so this is an equi join."""
    last = marks.agg(F.max_by("clock", "batch_id").alias("last_clock"))
    from_us = F.coalesce(floor_to(F.col("pwm"), step) + step, floor_to(F.col("min_event"), step))
    to_us = floor_to(F.col("wm"), step)
    ends = marks.where(to_us >= from_us).select(F.explode(F.sequence(from_us, to_us, F.lit(step))).alias("end_us"), "clock")
    closed = bars.withColumn("end_us", F.col("bar_us") + step).join(ends, "end_us", "left")
    return closed.crossJoin(F.broadcast(last)).withColumn("emitted_us", F.coalesce("clock", "last_clock")).drop("end_us", "clock", "last_clock")


def base_bars(batches: DataFrame, lateness_s: float, step: int) -> DataFrame:
    marks = watermarks(batches, lateness_s)
    accepted = split_late(batches, marks, step).where("not late")
    return emitted(accepted.groupBy("symbol", "bar_us").agg(*_ohlcv()), marks, step)


def rolled_up(base: DataFrame, batches: DataFrame, lateness_s: float, step: int) -> DataFrame:
    """Larger bars from base bars, merging their partial values. Bars before that of the first batch's earliest
    trade are never emitted."""
    marks = watermarks(batches, lateness_s)
    first = marks.agg(floor_to(F.min_by("min_event", "batch_id"), step).alias("first_bar"))
    up = base.withColumn("up_us", floor_to(F.col("bar_us"), step)).groupBy("symbol", "up_us").agg(
        F.min_by("open", "bar_us").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "bar_us").alias("close"),
        F.sum("volume").cast("decimal(24,8)").alias("volume"), F.sum("quote_volume").cast("decimal(28,8)").alias("quote_volume"), F.sum("sell_volume").cast("decimal(24,8)").alias("sell_volume"),
        F.sum("trade_count").alias("trade_count"), F.count(F.lit(1)).alias("active_bars"),
    )
    up = up.withColumnRenamed("up_us", "bar_us").withColumn("vwap", ratio(F.col("quote_volume"), F.col("volume")).cast("decimal(18,8)"))
    return emitted(up.crossJoin(F.broadcast(first)).where("bar_us >= first_bar").drop("first_bar"), marks, step)


def late_trades(batches: DataFrame, lateness_s: float, step: int) -> DataFrame:
    """Dropped trades with the watermark that they met."""
    return split_late(batches, watermarks(batches, lateness_s), step).where("late").withColumnRenamed("pwm", "watermark_us").drop("late", "bar_us")


def build_stats(batches: DataFrame, lateness_s: float, step: int) -> DataFrame:
    split = split_late(batches, watermarks(batches, lateness_s), step)
    counts = split.agg(F.count_if(~F.col("late")).alias("accepted"), F.count_if("late").alias("dropped"))
    return counts.withColumn("dropped_pct", 100 * ratio(F.col("dropped"), F.col("accepted") + F.col("dropped")))


def compared(truth: DataFrame, bars: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Accuracy of bars against the truth, for each value of keys: counts of bars off by price, volume or at all, and the
    largest errors."""
    keys = keys or []
    b = bars.select(*keys, "symbol", "bar_us", *[F.col(c).alias(f"b_{c}") for c in ("open", "high", "low", "close", "volume", "sell_volume")])
    j = truth.join(b, [*keys, "symbol", "bar_us"], "left")
    price_off = F.greatest(*[F.abs(ratio(F.col(f"b_{c}"), F.col(c)) - 1) for c in ("open", "high", "low", "close")])
    volume_off = F.abs(ratio(F.col("b_volume"), F.col("volume")) - 1)
    share = F.abs(ratio(F.col("b_sell_volume"), F.col("b_volume")) - ratio(F.col("sell_volume"), F.col("volume")))
    wrong = (price_off > 0) | (volume_off > 0)
    return j.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("bars"), F.count_if(F.col("b_volume").isNull()).alias("missing_bars"), F.count_if(wrong).alias("wrong_bars"), F.count_if(volume_off > 0.01).alias("volume_off_1pct"),
        F.max(price_off * 10_000).alias("max_price_bps"), F.max(volume_off * 100).alias("max_volume_pct"), F.max(share * 100).alias("max_share_pp"),
    )


def bar_delay(bars: DataFrame, step: int) -> DataFrame:
    """Seconds from a bar's end to its emission: exact median and 95th percentile, the flushed tail left out."""
    delay = (F.col("emitted_us") - F.col("bar_us") - step) / F.lit(1e6)
    return bars.agg(F.percentile(delay, F.lit(0.5)).alias("p50_s"), F.percentile(delay, F.lit(0.95)).alias("p95_s"))


def lateness_sweep(batches: DataFrame, settings: list[float], base_step: int, up_step: int) -> DataFrame:
    """One row for each lateness setting: drops, accuracy of the larger bars, delay of the base bars.

    The tape is read once. A trade accepted under one lateness is accepted under any longer one, so it has a level: the
    first setting that accepts it. Trades are summed up by bar and level; a setting's bars are those of its level and
    the levels before, merged, and everything after works on bars with a column for the setting.
    """
    settings = sorted(float(x) for x in settings)
    marks = watermarks(batches, 0.0)
    bar = floor_to(F.col("event_us"), base_step)
    need = F.col("pwm") - bar - base_step  # a lateness beyond this accepts the trade
    level = F.lit(len(settings))
    for k in reversed(range(len(settings))):
        level = F.when(F.col("pwm").isNull() | (need < int(settings[k] * 1_000_000)), k).otherwise(level)
    parts = batches.join(marks.select("batch_id", "pwm"), "batch_id").withColumn("bar_us", bar).withColumn("level", level)
    parts = staged(parts.groupBy("symbol", "bar_us", "level").agg(F.min("agg_trade_id").alias("first_id"), F.max("agg_trade_id").alias("last_id"), *_ohlcv()), "sweep-parts")
    kept = ("open", "high", "low", "close", "volume", "quote_volume", "sell_volume", "trade_count")

    def merged(rows: DataFrame, keys: list[str]) -> DataFrame:
        sums = [F.sum(c).cast(rows.schema[c].dataType).alias(c) for c in kept[4:]]
        return rows.groupBy(*keys).agg(F.min_by("open", "first_id").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "last_id").alias("close"), *sums)

    each = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(x).alias("lateness_s")) for k, x in enumerate(settings)])).alias("s")
    spread = parts.select("*", each).where("level <= s.k").select("s.lateness_s", *parts.columns)
    base = merged(spread, ["lateness_s", "symbol", "bar_us"])

    # emission: the batches of each setting
    per = marks.select("*", each).select("s.lateness_s", "batch_id", "clock", "min_event", *[(F.col(c) - (F.col("s.lateness_s") * 1_000_000).cast("long")).alias(c) for c in ("wm", "pwm")])
    from_us = F.coalesce(floor_to(F.col("pwm"), base_step) + base_step, floor_to(F.col("min_event"), base_step))
    to_us = floor_to(F.col("wm"), base_step)
    ends = per.where(to_us >= from_us).select("lateness_s", F.explode(F.sequence(from_us - base_step, to_us - base_step, F.lit(base_step))).alias("bar_us"), "clock")
    facts = F.broadcast(marks.agg(F.max_by("clock", "batch_id").alias("last_clock"), floor_to(F.min_by("min_event", "batch_id"), up_step).alias("first_bar")))  # one row
    closed = base.join(ends, ["lateness_s", "bar_us"], "left").crossJoin(facts)
    delay = (F.coalesce("clock", "last_clock") - F.col("bar_us") - base_step) / F.lit(1e6)
    delays = closed.groupBy("lateness_s").agg(F.percentile(delay, F.lit(0.5)).alias("p50_s"), F.percentile(delay, F.lit(0.95)).alias("p95_s"))

    up = merged(base.withColumns({"first_id": F.col("bar_us"), "last_id": F.col("bar_us"), "bar_us": floor_to(F.col("bar_us"), up_step)}), ["lateness_s", "symbol", "bar_us"])
    up = up.crossJoin(facts).where("bar_us >= first_bar").drop("first_bar", "last_clock")
    truth = merged(parts.withColumn("bar_us", floor_to(F.col("bar_us"), up_step)), ["symbol", "bar_us"]).select("*", each).select("s.lateness_s", "symbol", "bar_us", *kept)
    errors = compared(truth, up, ["lateness_s"])
    counts = parts.select("trade_count", "level", each).groupBy("s.lateness_s").agg(F.sum(F.when(F.col("level") <= F.col("s.k"), F.col("trade_count")).otherwise(0)).alias("accepted"), F.sum("trade_count").alias("all"))
    counts = counts.select("lateness_s", "accepted", (F.col("all") - F.col("accepted")).alias("dropped"), (100 * ratio(F.col("all") - F.col("accepted"), F.col("all"))).alias("dropped_pct"))
    return counts.join(errors, "lateness_s").join(delays, "lateness_s")
