"""Evidence for incidents, as a fixed set of joins. Windows meet rows by buckets of time, so no join is a nested loop."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import DAY, MINUTE, SECOND, floor_to, ratio, rounded
from .intervals import overlapping, within


def windows(inc: DataFrame) -> DataFrame:
    """(incident_no, w_symbol, w_start, w_end): from a minute before the opening to the last activity."""
    return inc.select("incident_no", F.col("symbol").alias("w_symbol"), (F.col("opened_us") - 60 * SECOND).alias("w_start"), F.col("last_active_us").alias("w_end"))


def _inside(win: DataFrame, rows: DataFrame, time: str) -> DataFrame:
    """Rows of the window's own symbol, both ends included."""
    return within(win.withColumn("symbol", F.col("w_symbol")), rows, "w_start", "w_end", time, ["symbol"])


def flow(win: DataFrame, bars: DataFrame) -> DataFrame:
    g = _inside(win, bars, "bar_us").groupBy("incident_no").agg(F.sum("volume").alias("v"), F.sum("sell_volume").alias("s"), F.sum("trade_count").alias("trades"), F.max_by("close", "bar_us").cast("double").alias("price_at_end"))
    return g.select("incident_no", F.col("v").cast("double").alias("volume"), ratio(F.col("s"), F.col("v")).alias("sell_share"), "trades", "price_at_end")


def price_after(win: DataFrame, minutes: DataFrame, after=(30, 60)) -> DataFrame:
    """Closes so many minutes after the minute in which the window ended."""
    end = floor_to(F.col("w_end"), MINUTE)
    wanted = win.select("incident_no", "w_symbol", F.explode(F.array(*[F.struct(F.lit(m).alias("m"), (end + m * MINUTE).alias("at")) for m in after])).alias("x"))
    hit = wanted.select("incident_no", F.col("w_symbol").alias("symbol"), "x.m", F.col("x.at").alias("bar_us")).join(minutes.select("symbol", "bar_us", "close"), ["symbol", "bar_us"], "left")
    return hit.groupBy("incident_no").agg(*[F.max(F.when(F.col("m") == m, F.col("close"))).cast("double").alias(f"price_{m}m_after") for m in after])


def other_symbols(win: DataFrame, bars: DataFrame) -> DataFrame:
    """Return of every other symbol over the window."""
    j = within(win, bars, "w_start", "w_end", "bar_us", []).where("w_symbol <> symbol")
    return j.groupBy("incident_no", F.col("symbol").alias("other_symbol")).agg((ratio(F.max_by("close", "bar_us"), F.min_by("open", "bar_us")) - 1).alias("other_return"))


def overlaps(win: DataFrame, tolerance_s: int = 300) -> DataFrame:
    """Incidents of other symbols whose windows overlap within the tolerance."""
    t = tolerance_s * SECOND
    left = win.select("incident_no", "w_symbol", (F.col("w_start") - t).alias("l_start"), (F.col("w_end") + t).alias("l_end"))
    right = win.select(F.col("incident_no").alias("o_no"), F.col("w_symbol").alias("o_symbol"), F.col("w_start").alias("r_start"), F.col("w_end").alias("r_end"))
    j = overlapping(left, right).where("w_symbol <> o_symbol")
    return j.groupBy("incident_no").agg(F.array_sort(F.collect_list("o_no")).alias("overlapping"))


def timeline(inc: DataFrame, with_incident: DataFrame) -> DataFrame:
    """Alerts of an incident in order, with seconds from its opening."""
    j = with_incident.where("incident_no is not null").join(inc.select("incident_no", "opened_us"), "incident_no")
    item = F.struct("fired_us", "alert_no", "rule", F.floor((F.col("fired_us") - F.col("opened_us")) / SECOND).cast("int").alias("seconds_from_open"))
    return j.groupBy("incident_no").agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: F.struct(x["rule"].alias("rule"), x["seconds_from_open"].alias("seconds_from_open"))).alias("alert_timeline"))


def trade_sizes(win: DataFrame, trades: DataFrame) -> DataFrame:
    """Was it one big order or a crowd: shares of the largest and the ten largest trades, and the median size."""
    q = F.col("quantity").cast("double")
    ranked = _inside(win, trades, "event_us").withColumn("rank", F.row_number().over(Window.partitionBy("incident_no").orderBy(F.col("quantity").desc(), "agg_trade_id")))
    g = ranked.groupBy("incident_no").agg(F.max(q).alias("most"), F.sum(q).alias("all"), F.sum(F.when(F.col("rank") <= 10, q)).alias("ten"), F.median(q).alias("median_trade_size"))
    return g.select("incident_no", rounded(F.col("most") / F.col("all") * 100, 2).alias("largest_trade_pct"), rounded(F.col("ten") / F.col("all") * 100, 1).alias("top10_pct"), "median_trade_size")


def day_summary(minutes: DataFrame, profile: DataFrame) -> DataFrame:
    """Each symbol's days: prices, range, and volume against the normal one of the day's own profile."""
    keys = ["symbol", "day"]
    normal = profile.groupBy(*keys).agg(F.sum(F.col("volume_median") * 60).alias("normal"))
    o, c = F.min_by("open", "bar_us").cast("double"), F.max_by("close", "bar_us").cast("double")
    days = minutes.withColumn("day", F.floor(F.col("bar_us") / DAY)).groupBy(*keys)
    g = days.agg(o.alias("open"), c.alias("close"), F.max("high").cast("double").alias("high"), F.min("low").cast("double").alias("low"), F.sum("volume").cast("double").alias("volume")).join(normal, keys, "left")
    moved, spread = rounded((F.col("close") / F.col("open") - 1) * 100, 2), rounded((F.col("high") / F.col("low") - 1) * 100, 2)
    return g.select(*keys, "open", "close", moved.alias("day_return_pct"), spread.alias("range_pct"), rounded(ratio(F.col("volume"), F.col("normal")), 2).alias("volume_vs_normal_x"))


def alerts_by_rule(with_incident: DataFrame) -> DataFrame:
    return with_incident.groupBy("rule").agg(F.count(F.lit(1)).alias("alerts"), F.count_if(F.col("incident_no").isNull()).alias("not_in_any_incident"))


def incident_evidence(observed: DataFrame, with_incident: DataFrame, bars: DataFrame, minutes: DataFrame, trades: DataFrame | None = None) -> DataFrame:
    """One row an incident: all evidence joined; other symbols as an array; trade sizes null once trades are purged."""
    win = windows(observed)
    pct = lambda c: rounded((F.col(c) / F.col("price_at_open") - 1) * 100, 2)
    others = other_symbols(win, bars).groupBy("incident_no").agg(F.array_sort(F.collect_list(F.struct("other_symbol", rounded(F.col("other_return") * 100, 2).alias("move_pct")))).alias("other_moves"))
    e = observed.join(flow(win, bars), "incident_no", "left").join(price_after(win, minutes), "incident_no", "left").join(others, "incident_no", "left")
    e = e.join(overlaps(win), "incident_no", "left").join(timeline(observed, with_incident), "incident_no", "left")
    if trades is not None:
        e = e.join(trade_sizes(win, trades), "incident_no", "left")
    else:
        e = e.withColumns({c: F.lit(None).cast("double") for c in ("largest_trade_pct", "top10_pct", "median_trade_size")})
    return e.select(
        "incident_no", "symbol", "status", F.date_format(F.timestamp_micros("opened_us"), "HH:mm:ss").alias("opened_utc"), rounded((F.col("last_active_us") - F.col("opened_us")) / (60 * SECOND), 1).alias("active_minutes"),
        "price_at_open", "price_low", "price_high", "price_at_end", pct("price_low").alias("lowest_pct"), pct("price_high").alias("highest_pct"), pct("price_at_end").alias("move_at_end_pct"),
        pct("price_30m_after").alias("move_30m_after_pct"), pct("price_60m_after").alias("move_60m_after_pct"), rounded(F.col("max_abs_ret_60_ref_z"), 1).alias("max_move_x"), rounded(F.col("max_vol_60_ref_ratio"), 1).alias("max_volume_x"),
        rounded(F.col("sell_share") * 100, 1).alias("sell_pct"), "volume", "trades", "other_moves", F.coalesce("overlapping", F.array().cast("array<int>")).alias("overlapping"), "alert_timeline",
        F.col("largest_trade_pct").isNull().alias("trades_purged"), "largest_trade_pct", "top10_pct", "median_trade_size",
    )
