"""Event study: forward returns after alerts against matched control minutes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import DAY, MINUTE, floor_to
from .features import hour_of

HORIZONS, CONTROLS, DRAWS = (5, 15, 60), 20, 2000


def entry_minute(detected_us: Column) -> Column:
    """The first full minute after an alert was known."""
    return floor_to(detected_us, MINUTE) + MINUTE


def forward_returns(starts: DataFrame, minutes: DataFrame, horizons=HORIZONS) -> DataFrame:
    """starts (symbol, entry_us, ...) with ret_{h}m in per cent; null where either minute has no bar. One join on
    exploded offsets instead of one join a horizon."""
    close = minutes.select("symbol", F.col("bar_us").alias("at"), F.col("close").cast("double").alias("c"))
    keyed = starts.select("symbol", "entry_us").distinct()
    want = keyed.select("symbol", "entry_us", F.explode(F.array(*[F.lit(h) for h in (0, *horizons)])).alias("h")).withColumn("at", F.col("entry_us") + F.col("h").cast("long") * MINUTE)
    got = want.join(close, ["symbol", "at"], "left").groupBy("symbol", "entry_us").agg(*[F.max(F.when(F.col("h") == h, F.col("c"))).alias(f"c{h}") for h in (0, *horizons)])
    rets = got.select("symbol", "entry_us", *[((F.col(f"c{h}") / F.col("c0") - 1) * 100).alias(f"ret_{h}m") for h in horizons])
    return starts.join(rets, ["symbol", "entry_us"], "left")


def control_pool(minutes: DataFrame, alerts: DataFrame, around: int = 60) -> DataFrame:
    """Minutes of a symbol with no alert within an hour. An exploded equi anti-join, not a range join."""
    busy = alerts.select("symbol", F.explode(F.sequence(F.lit(-around), F.lit(around))).alias("m"), floor_to(F.col("detected_us"), MINUTE).alias("t")).select("symbol", (F.col("t") + F.col("m").cast("long") * MINUTE).alias("bar_us")).distinct()
    return minutes.select("symbol", "bar_us").join(busy, ["symbol", "bar_us"], "left_anti")


def _number(key: Column) -> Column:
    """A number of 52 bits from the md5 of a key."""
    return F.conv(F.substring(F.md5(key.cast("string")), 1, 13), 16, 10).cast("long")


def sampled_controls(events: DataFrame, pool: DataFrame, most: int = CONTROLS, seed: int | None = None) -> DataFrame:
    """(event_id, symbol, entry_us) of up to `most` pool minutes of the same symbol and hour on other days for each event.

    The pool's minutes of a symbol and hour stand in one hashed (or, with a seed, random) order; an event takes
    them from a place of its own on. An hour has 60 minutes of the event's day at most, so most + 60 places are
    enough, and no event meets all of the pool.
    """
    order = F.rand(seed) if seed is not None else F.md5(F.col("entry_us").cast("string"))
    p = pool.select("symbol", F.col("bar_us").alias("entry_us"), hour_of(F.col("bar_us")).alias("hour"), F.floor(F.col("bar_us") / DAY).alias("p_day"))
    p = p.withColumn("at", F.row_number().over(Window.partitionBy("symbol", "hour").orderBy(order, "entry_us")) - 1)
    sizes = p.groupBy("symbol", "hour").agg(F.count(F.lit(1)).alias("n"))
    e = events.select("event_id", "symbol", hour_of(F.col("entry_us")).alias("hour"), F.floor(F.col("entry_us") / DAY).alias("day")).join(sizes, ["symbol", "hour"])
    places = e.select("*", F.explode(F.sequence(F.lit(0), F.least(F.col("n"), F.lit(most + 60)).cast("int") - 1)).alias("step"))
    places = places.withColumn("at", F.pmod(_number(F.col("event_id")) + F.col("step"), F.col("n")).cast("int"))
    j = places.join(p, ["symbol", "hour", "at"]).where("day <> p_day")
    return j.withColumn("k", F.row_number().over(Window.partitionBy("event_id").orderBy("step"))).where(F.col("k") <= most).select("event_id", "symbol", "entry_us")


def study(rows: DataFrame, keys: list[str], sign: Column | None = None, horizons=HORIZONS) -> DataFrame:
    """n, mean and hit rate of returns for each horizon: absolute ones, or times a sign. The hit rate counts missing
    returns as misses; hit_rate_known leaves them out."""
    x = F.explode(F.array(*[F.struct(F.lit(h).alias("horizon"), (F.abs(F.col(f"ret_{h}m")) if sign is None else sign * F.col(f"ret_{h}m")).alias("x")) for h in horizons]))
    flat = rows.select(*keys, x.alias("r")).select(*keys, "r.*")
    hit = F.avg(F.when(F.coalesce(F.col("x") > 0, F.lit(False)), 100.0).otherwise(0.0))
    return flat.groupBy(*keys, "horizon").agg(F.count("x").alias("n"), F.avg("x").alias("mean"), hit.alias("hit_rate"), F.avg(F.when(F.col("x") > 0, 100.0).when(F.col("x").isNotNull(), 0.0)).alias("hit_rate_known"))


def split_day(runs: DataFrame) -> DataFrame:
    """The first day of the holdout: that at two thirds of the official days."""
    days = runs.select("trade_date").distinct().agg(F.array_sort(F.collect_set("trade_date")).alias("days"))
    return days.select(F.col("days")[F.floor(F.size("days") * 2 / 3).cast("int")].alias("split_day"))


def bootstrap_ci(rows: DataFrame, keys: list[str], value: str, draws: int = DRAWS, seed: int = 7, row_id: str | None = None) -> DataFrame:
    """(keys, ci_lo, ci_hi): percentile interval of the mean for each group; null under five values.

    A draw weighs each row by a Poisson number of mean one, which tends to the counts of a resample, and weighted sums
    merge: tasks send a sum a group and draw, never a group's rows. A row's weights hang on row_id and the
    seed alone, so that reruns agree; without row_id they hang on the rows' places.
    """
    kinds = dict(rows.dtypes)
    sized = rows.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_x"), (F.xxhash64(F.lit(seed), row_id) if row_id else F.xxhash64(F.lit(seed), F.monotonically_increasing_id())).alias("_id"))

    def weigh(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for group, part in pdf.groupby(keys, dropna=False, sort=False):
                n, w, wx = len(part), np.zeros(draws), np.zeros(draws)
                for x, i in zip(part["_x"].to_numpy(), part["_id"].to_numpy()):
                    weight = np.random.Generator(np.random.Philox(key=int(i) & (2**64 - 1))).poisson(1.0, draws)
                    w += weight
                    wx += weight * x
                group = group if isinstance(group, tuple) else (group,)
                yield pd.DataFrame({**{k: pd.Series([g] * draws, dtype=pdf[k].dtype) for k, g in zip(keys, group)}, "_draw": np.arange(draws), "_n": n, "_w": w, "_wx": wx})

    sums = sized.mapInPandas(weigh, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", _draw long, _n long, _w double, _wx double")
    means = sums.groupBy(*keys, "_draw").agg(F.sum("_n").alias("_n"), F.try_divide(F.sum("_wx"), F.sum("_w")).alias("_mean"))
    ends = means.groupBy(*keys).agg(F.max("_n").alias("_n"), F.percentile("_mean", F.array(F.lit(0.025), F.lit(0.975))).alias("_ci"))
    enough = lambda k: F.when(F.col("_n") >= 5, F.col("_ci")[k])
    found = ends.select(*[F.col(k).alias(f"_{k}") for k in keys], enough(0).alias("ci_lo"), enough(1).alias("ci_hi"))
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    on = same[0]
    for c in same[1:]:
        on = on & c
    return rows.select(*keys).distinct().join(found, on, "left").select(*keys, "ci_lo", "ci_hi")


def control_means(events: DataFrame, controls: DataFrame, minutes: DataFrame, keys: list[str], horizons=HORIZONS) -> DataFrame:
    """(keys, horizon, controls, control): how large moves are after the control minutes of the events of each group. events:
    (event_id, keys); controls: (event_id, symbol, entry_us)."""
    moves = forward_returns(controls.join(events.select("event_id", *keys), "event_id"), minutes, horizons)
    each = F.explode(F.array(*[F.struct(F.lit(h).alias("horizon"), F.abs(F.col(f"ret_{h}m")).alias("x")) for h in horizons]))
    return moves.select(*keys, each.alias("r")).groupBy(*keys, "r.horizon").agg(F.count("r.x").alias("controls"), F.avg("r.x").alias("control"))


def of_official_runs(rows: DataFrame, official: DataFrame) -> DataFrame:
    """Rows of the runs that count, with their trade_date. official: (trade_date, run_id), one run a day."""
    return rows.join(official.select("run_id", "trade_date"), "run_id")


def study_table(returns: DataFrame, controls: DataFrame, minutes: DataFrame, draws: int = DRAWS) -> DataFrame:
    """The whole study as one table (section, signal, split, horizon, n, value, control, ci_lo, ci_hi, hit_rate): sizes of moves
    after each rule beside those after its controls; returns in the flow's and in the shock's direction.

    returns: (event_id, rule, dataset, sell_share_120, ret_60, ret_{h}m).
    """
    sizes = study(returns, ["rule", "dataset"]).join(control_means(returns, controls, minutes, ["rule", "dataset"]), ["rule", "dataset", "horizon"], "left")
    parts = [("size", F.lit(True), None), ("direction", F.col("rule") == "one_sided_flow", F.when(F.col("sell_share_120") < 0.5, 1).otherwise(-1)), ("shock", F.col("rule") == "price_shock", F.signum("ret_60"))]
    out = None
    for section, which, sign in parts:
        rows = returns.where(which)
        each = F.explode(F.array(*[F.struct(F.lit(h).alias("horizon"), (F.abs(F.col(f"ret_{h}m")) if sign is None else sign * F.col(f"ret_{h}m")).alias("x")) for h in HORIZONS]))
        flat = rows.select("rule", "dataset", "event_id", each.alias("r")).select("rule", "dataset", "r.horizon", "r.x", F.concat_ws(":", F.lit(section), "event_id", "r.horizon").alias("id"))
        ci = bootstrap_ci(flat, ["rule", "dataset", "horizon"], "x", draws, row_id="id")
        found = (sizes if sign is None else study(rows, ["rule", "dataset"], sign).withColumn("control", F.lit(None).cast("double"))).join(ci, ["rule", "dataset", "horizon"])
        rate = F.lit(None).cast("double") if sign is None else F.col("hit_rate")
        part = found.where("n > 0").select(F.lit(section).alias("section"), F.col("rule").alias("signal"), F.col("dataset").alias("split"), "horizon", "n", F.col("mean").alias("value"), "control", "ci_lo", "ci_hi", rate.alias("hit_rate"))
        out = part if out is None else out.unionByName(part)
    return out
