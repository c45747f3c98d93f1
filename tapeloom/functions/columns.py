"""Column expressions with the semantics that the operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Epoch numbers above this are microseconds, others milliseconds.
MICROS_FROM = 100_000_000_000_000
SECOND, MINUTE, HOUR, DAY = 1_000_000, 60_000_000, 3_600_000_000, 86_400_000_000


def epoch_micros(ts: Column) -> Column:
    """Microseconds of a zoneless or UTC timestamp."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts.cast("timestamp_ntz"))


def unit_micros(epoch: Column) -> Column:
    """Milliseconds or microseconds, by magnitude, to microseconds."""
    return F.when(epoch > MICROS_FROM, epoch).otherwise(epoch * 1000)


def floor_to(us: Column, step: int) -> Column:
    return us - F.pmod(us, F.lit(step))


def rounded(x: Column, digits: int) -> Column:
    """Half-up rounding that does not depend on an engine's own round()."""
    return F.floor(x * F.lit(10.0**digits) + F.lit(0.5)) / F.lit(10.0**digits)


def ratio(a: Column, b: Column) -> Column:
    """a / b as double; null where b is 0 or null."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def ratio_or_infinite(a: Column, b: Column) -> Column:
    """a / b as double; plus or minus infinity where b is 0 and a is not, null where both are."""
    a, b = a.cast("double"), b.cast("double")
    return F.when(b == 0, F.when(a > 0, F.lit(float("inf"))).when(a < 0, F.lit(float("-inf")))).otherwise(F.try_divide(a, b))
