"""Hour-of-day profile, dense grid and rolling features of bars."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import DAY, HOUR, SECOND, ratio, ratio_or_infinite


def hour_of(us):
    return F.floor(F.pmod(us, F.lit(DAY)) / HOUR).cast("int")


def hour_profile(candles: DataFrame, from_us: int, to_us: int) -> DataFrame:
    """(symbol, hour, days, bars, volume_median, ret_std) of the candles of a range. The return crosses gaps and days;
    the range's first is null."""
    part = candles.where((F.col("bar_us") >= from_us) & (F.col("bar_us") < to_us))
    ret = F.col("close").cast("double") / F.lag(F.col("close").cast("double")).over(Window.partitionBy("symbol").orderBy("bar_us")) - 1
    rows = part.select("symbol", hour_of(F.col("bar_us")).alias("hour"), F.floor(F.col("bar_us") / DAY).alias("day"), F.col("volume").cast("double").alias("volume"), ret.alias("ret"))
    return rows.groupBy("symbol", "hour").agg(F.countDistinct("day").alias("days"), F.count(F.lit(1)).alias("bars"), F.median("volume").alias("volume_median"), F.stddev_samp("ret").alias("ret_std"))


def daily_profiles(candles: DataFrame, from_us: int, to_us: int, back: int = 7) -> DataFrame:
    """(symbol, day, hour, days, bars, volume_median, ret_std): for each day from from_us to to_us the profile of the `back`
    days before it. Each candle counts for the days that follow it, so all days are one aggregation; returns cross
    gaps and days, and only a symbol's very first is null."""
    ret = F.col("close").cast("double") / F.lag(F.col("close").cast("double")).over(Window.partitionBy("symbol").orderBy("bar_us")) - 1
    own = F.floor(F.col("bar_us") / DAY)
    rows = candles.select("symbol", hour_of(F.col("bar_us")).alias("hour"), own.alias("own"), F.col("volume").cast("double").alias("volume"), ret.alias("ret"))
    first, last = F.greatest(F.col("own") + 1, F.lit(from_us // DAY)), F.least(F.col("own") + back, F.lit(to_us // DAY - 1))
    rows = rows.where(first <= last).withColumn("day", F.explode(F.sequence(first, last)))
    return rows.groupBy("symbol", "day", "hour").agg(F.countDistinct("own").alias("days"), F.count(F.lit(1)).alias("bars"), F.median("volume").alias("volume_median"), F.stddev_samp("ret").alias("ret_std"))


def reconciled(bars: DataFrame, official: DataFrame) -> DataFrame:
    """Counts of bars that equal the official candles in prices, volume, buy volume and everything."""
    o = official.select("symbol", "bar_us", *[F.col(c).alias(f"o_{c}") for c in ("open", "high", "low", "close", "volume", "sell_volume")])
    j = bars.join(o, ["symbol", "bar_us"])
    prices = (F.col("open") == F.col("o_open")) & (F.col("high") == F.col("o_high")) & (F.col("low") == F.col("o_low")) & (F.col("close") == F.col("o_close"))
    volume = F.col("volume") == F.col("o_volume")
    buys = F.col("volume") - F.col("sell_volume") == F.col("o_volume") - F.col("o_sell_volume")
    return j.agg(F.count(F.lit(1)).alias("bars"), F.count_if(prices).alias("prices_equal"), F.count_if(volume).alias("volume_equal"), F.count_if(buys).alias("buy_volume_equal"), F.count_if(prices & volume & buys).alias("all_equal"))


#: Steps of a block of time: a symbol's series is worked on block by block, with the rows before a block that it needs.
BLOCK = 14_400


def _block(time: Column, span: int) -> Column:
    return F.floor(time / F.lit(span))


def _laid_out(spans: DataFrame, sparse: DataFrame, value: str, step: int, block: int, keys: tuple[str, ...] = (), back: bool = False) -> DataFrame:
    """(keys, bar_us, value) at every step from `first` to `last` of each span (keys, first, last): the value of sparse (keys,
    bar_us, value) at the step, else the last one before it (back: the first one after).

    Blocks are laid out first and take what comes over from other blocks, one row a block; then their steps, which are
    filled within the block. No task holds a whole series.
    """
    span = block * step
    # back to front where values come from behind: a frame that only grows is read once
    ends, along = (F.min_by, lambda c: F.col(c).desc()) if back else (F.max_by, F.col)
    blocks = spans.select(*keys, "first", "last", F.explode(F.sequence(_block(F.col("first"), span), _block(F.col("last"), span))).alias("_block"))
    edge = sparse.groupBy(*keys, _block(F.col("bar_us"), span).alias("_block")).agg(ends(value, "bar_us").alias("_edge"))
    over = Window.partitionBy(*keys).orderBy(along("_block")).rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.join(edge, [*keys, "_block"], "left").withColumn("_over", F.last("_edge", ignorenulls=True).over(over))
    start = F.col("_block") * span
    steps = blocks.select(*keys, "_block", "_over", F.explode(F.sequence(F.greatest("first", start), F.least("last", start + span - step), F.lit(step))).alias("bar_us"))
    own = Window.partitionBy(*keys, "_block").orderBy(along("bar_us")).rowsBetween(Window.unboundedPreceding, 0)
    joined = steps.join(sparse.select(*keys, "bar_us", F.col(value).alias("_own")), [*keys, "bar_us"], "left")
    return joined.select(*keys, "bar_us", F.coalesce(F.last("_own", ignorenulls=True).over(own), "_over").alias(value))


def with_halo(rows: DataFrame, time: str, step: int, halo: int, block: int = BLOCK) -> DataFrame:
    """Dense rows by block, each block with the `halo` steps before it: column _block, and _own where a row is the block's
    own. Frames of up to halo rows back are whole for a block's own rows."""
    span = block * step
    at = _block(F.col(time), span)
    late = F.pmod(F.col(time), F.lit(span)) >= (block - halo) * step
    blocks = F.when(late, F.array(at, at + 1)).otherwise(F.array(at))
    return rows.withColumn("_block", F.explode(blocks)).withColumn("_own", F.col("_block") == at)


def dense_grid(bars: DataFrame, step: int, to_us: int | None = None, block: int = BLOCK) -> DataFrame:
    """Each symbol's bars at every step from its first bar to the horizon of all (or to_us): close carried forward,
    volumes 0 where nothing traded."""
    spans = bars.groupBy("symbol").agg(F.min("bar_us").alias("first"))
    if to_us is None:
        spans = spans.crossJoin(F.broadcast(bars.agg(F.max("bar_us").alias("last"))))  # one row
    else:
        spans = spans.withColumn("last", F.lit(to_us))
    row = F.struct(F.col("close").cast("double").alias("close"), F.col("bar_us").alias("at"), "volume", "sell_volume").alias("row")
    grid = _laid_out(spans, bars.select("symbol", "bar_us", row), "row", step, block, ("symbol",))
    traded = lambda c: F.when(F.col("row.at") == F.col("bar_us"), F.col(f"row.{c}")).otherwise(F.lit(0).cast("decimal(24,8)")).alias(c)
    return grid.select("symbol", "bar_us", F.col("row.close").alias("close"), traded("volume"), traded("sell_volume"))


def known_at(grid: DataFrame, bars: DataFrame, step: int, block: int = BLOCK) -> DataFrame:
    """grid with known_us: when the step was known, which for steps without a bar is when the next bar was; null after the
    last bar."""
    first = bars.groupBy("bar_us").agg(F.min("emitted_us").alias("known_us"))
    spans = bars.agg(F.min("bar_us").alias("first"), F.max("bar_us").alias("last")).where("first is not null")
    return grid.join(_laid_out(spans, first, "known_us", step, block, back=True), "bar_us", "left")


def features(grid: DataFrame, profile: DataFrame, step: int = SECOND, block: int = BLOCK) -> DataFrame:
    """ret_60, vol_60, vol_120, sell_share_120 and their measures against the hour's profile.

    A profile with days goes by day and hour, one without by hour. A missing hour gives null. A profile of zero gives infinity, so that a rule on it fires. The windows are
    bounded row frames of a symbol's block of time; the profile is a small table that Spark may broadcast by its size.
    """
    order = Window.partitionBy("symbol", "_block").orderBy("bar_us")
    sums = lambda c: F.sum(c).over(order.rowsBetween(Window.unboundedPreceding, 0))
    f = with_halo(grid, "bar_us", step, 120, block).withColumns({"ret_60": ratio(F.col("close"), F.lag("close", 60).over(order)) - 1, "_v": sums("volume"), "_s": sums("sell_volume"), "_place": F.row_number().over(order)})
    # sums of the last rows as differences of running ones: decimals, so exact
    last = lambda c, n: F.when(F.col("_place") == n, F.col(c)).when(F.col("_place") > n, F.col(c) - F.lag(c, n).over(order)).cast("double")
    f = f.withColumns({"vol_60": last("_v", 60), "vol_120": last("_v", 120), "sell_120": last("_s", 120)}).drop("_v", "_s", "_place")
    f = f.withColumn("sell_share_120", ratio(F.col("sell_120"), F.col("vol_120"))).where("_own").drop("_block", "_own").withColumn("hour", hour_of(F.col("bar_us")))
    keys = ["symbol", "hour"]
    if "day" in profile.columns:
        f, keys = f.withColumn("day", F.floor(F.col("bar_us") / DAY)), ["symbol", "hour", "day"]
    f = f.join(profile.select(*keys, "volume_median", "ret_std"), keys, "left")
    f = f.withColumn("ret_60_ref_z", ratio_or_infinite(F.col("ret_60"), F.col("ret_std"))).withColumn("vol_60_ref_ratio", ratio_or_infinite(F.col("vol_60"), F.col("volume_median")))
    return f.withColumn("vol_120_ref_ratio", ratio_or_infinite(F.col("vol_120"), 2 * F.col("volume_median")))


def rolling_features(featured: DataFrame, window: int = 1800, warmup: int = 600, step: int = SECOND, block: int = BLOCK) -> DataFrame:
    """featured with ret_60_z, vol_60_ratio and vol_120_ratio against the window that ended 60 (120) rows ago.

    Rolling medians over long frames are quadratic as SQL frames, so they go to pandas, whose rolling median is
    incremental: a block of a symbol's time with the window + 120 rows before it, which is all that its rows look back on.
    """
    halo = window + 120
    if block < halo:
        raise ValueError("a block is at least as long as what its rows look back on")

    def roll(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bar_us")
        base = lambda s, gap, how: getattr(s.rolling(window, min_periods=warmup), how)().shift(gap)
        z = base(pdf["ret_60"], 60, "std")
        m60, m120 = base(pdf["vol_60"], 60, "median"), base(pdf["vol_120"], 120, "median")
        own, out = pdf["_own"].to_numpy(), pdf[["symbol", "bar_us"]].copy()
        for name, value in (("ret_60_z", pdf["ret_60"] / z.where(z != 0)), ("vol_60_ratio", pdf["vol_60"] / m60.where(m60 != 0)), ("vol_120_ratio", pdf["vol_120"] / m120.where(m120 != 0))):
            out[name] = value.astype(object).where(value.notna(), None)
        return out[own]

    kept = with_halo(featured.select("symbol", "bar_us", "ret_60", "vol_60", "vol_120"), "bar_us", step, halo, block)
    rolled = kept.groupBy("symbol", "_block").applyInPandas(roll, "symbol string, bar_us long, ret_60_z double, vol_60_ratio double, vol_120_ratio double")
    return featured.join(rolled, ["symbol", "bar_us"])
