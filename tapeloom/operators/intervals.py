"""Joins of intervals with points and with one another, as equi-joins on buckets of time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import HOUR


def _bucket(us, width: int):
    return F.floor(us / F.lit(width))


def within(spans: DataFrame, rows: DataFrame, start: str, end: str, time: str, on: list[str], width: int = HOUR) -> DataFrame:
    """Rows inside of spans, both ends included, that agree in the columns on; columns of both. A span is laid out over the
    buckets that it touches, a row has one, so a pair meets once and no bucket holds more than its own time."""
    laid = spans.where(F.col(start) <= F.col(end)).withColumn("_bucket", F.explode(F.sequence(_bucket(F.col(start), width), _bucket(F.col(end), width))))
    placed = rows.withColumn("_bucket", _bucket(F.col(time), width))
    return laid.join(placed, [*on, "_bucket"]).where(F.col(time).between(F.col(start), F.col(end))).drop("_bucket")


def overlapping(left: DataFrame, right: DataFrame, width: int = HOUR) -> DataFrame:
    """Pairs of spans (l_start, l_end) and (r_start, r_end) that have a point in common; columns of both. Both sides are laid
    out over buckets; a pair counts in the bucket where the later of the two begins."""
    a = left.withColumn("_bucket", F.explode(F.sequence(_bucket(F.col("l_start"), width), _bucket(F.col("l_end"), width))))
    b = right.withColumn("_bucket", F.explode(F.sequence(_bucket(F.col("r_start"), width), _bucket(F.col("r_end"), width))))
    j = a.join(b, "_bucket").where((F.col("l_start") <= F.col("r_end")) & (F.col("r_start") <= F.col("l_end")))
    return j.where(F.col("_bucket") == _bucket(F.greatest("l_start", "r_start"), width)).drop("_bucket")
