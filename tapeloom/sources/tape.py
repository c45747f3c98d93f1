"""Trade and candle readers: headerless CSV files with declared schemas, and the events table as a tape."""

from __future__ import annotations

import hashlib
import urllib.request
import zipfile
from datetime import date
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import epoch_micros, unit_micros

TRADES_CSV = "agg_trade_id BIGINT, price DECIMAL(18,8), quantity DECIMAL(18,8), first_trade_id BIGINT, last_trade_id BIGINT, ts BIGINT, is_buyer_maker BOOLEAN, is_best_match BOOLEAN"
KLINES_CSV = "open_time BIGINT, open DECIMAL(18,8), high DECIMAL(18,8), low DECIMAL(18,8), close DECIMAL(18,8), volume DECIMAL(24,8), close_time BIGINT, quote_volume DECIMAL(28,8), trade_count BIGINT, taker_buy_volume DECIMAL(24,8), taker_buy_quote_volume DECIMAL(28,8), unused STRING"
#: The start of the tape's clock, 2024-01-01, in microseconds; the compressed clock runs 720 times as fast.
ORIGIN_US, COMPRESSION = 1_704_067_200_000_000, 720


def read_trades(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """Trades of each symbol's CSV path, event_us in microseconds whatever the file's unit."""
    parts = [spark.read.schema(TRADES_CSV).csv(path, header=False).withColumn("symbol", F.lit(symbol)) for symbol, path in paths.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("symbol", "agg_trade_id", "price", "quantity", "first_trade_id", "last_trade_id", "is_buyer_maker", unit_micros(F.col("ts")).alias("event_us"))


def read_klines(spark: SparkSession, symbol: str, path: str) -> DataFrame:
    """Official one-minute candles."""
    raw = spark.read.schema(KLINES_CSV).csv(path, header=False)
    return raw.select(F.lit(symbol).alias("symbol"), unit_micros(F.col("open_time")).alias("open_us"), "open", "high", "low", "close", "volume", "quote_volume", "trade_count", "taker_buy_volume")


def between(trades: DataFrame, start_us: int, end_us: int) -> DataFrame:
    """Rows from start, end excluded."""
    return trades.where((F.col("event_us") >= start_us) & (F.col("event_us") < end_us))


def events_as_trades(events: DataFrame, compressed: bool = False) -> DataFrame:
    """The events table in the shape of trades. compressed: 30 days run in one hour."""
    us = epoch_micros(F.col("ts"))
    if compressed:
        us = F.lit(ORIGIN_US) + F.floor((us - ORIGIN_US) / F.lit(COMPRESSION)).cast("long")
    return events.select(
        F.col("event_type").alias("symbol"), F.col("event_id").alias("agg_trade_id"), (F.lit(1000) + F.col("value")).cast("decimal(18,8)").alias("price"),
        (F.get_json_object("props", "$.k").cast("int") + 1).cast("decimal(18,8)").alias("quantity"), F.col("event_id").alias("first_trade_id"), F.col("event_id").alias("last_trade_id"),
        (F.col("user_id") % 2 == 0).alias("is_buyer_maker"), us.alias("event_us"),
    )


def missing_days(present: DataFrame, symbols: list[str], day: date, lookback: int = 7) -> DataFrame:
    """(symbol, day) of the lookback before a day for which no candles are present."""
    spark = present.sparkSession
    days = spark.range(1, lookback + 1).select(F.date_sub(F.lit(day), F.col("id").cast("int")).alias("day"))
    wanted = spark.createDataFrame([(s,) for s in symbols], "symbol string").join(F.broadcast(days))  # lookback times symbols rows
    return wanted.join(present.select("symbol", "day").distinct(), ["symbol", "day"], "left_anti")


def fetch_archive(url: str, folder: str, opener=urllib.request.urlopen) -> Path:
    """Downloads a zip and its .CHECKSUM once, verifies sha256, deletes on mismatch, unpacks the CSV."""
    target = Path(folder) / url.rsplit("/", 1)[1]
    out = target.with_suffix(".csv")
    if out.exists():
        return out
    target.parent.mkdir(parents=True, exist_ok=True)
    for suffix in ("", ".CHECKSUM"):
        with opener(url + suffix) as response:
            Path(f"{target}{suffix}").write_bytes(response.read())
    wanted = Path(f"{target}.CHECKSUM").read_text().split()[0]
    if hashlib.sha256(target.read_bytes()).hexdigest() != wanted:
        target.unlink()
        raise ValueError(f"checksum of {target.name} does not match")
    with zipfile.ZipFile(target) as z:
        z.extractall(target.parent)
    return out
