"""Rounding and arithmetic that come out alike in Spark, DuckDB and Python (half to even, by rint)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(x: Column, digits: int = 6) -> Column:
    scale = F.lit(float(10**digits))
    return F.rint(x * scale) / scale


def whole(x: Column) -> Column:
    return F.rint(x).cast("bigint")


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0 or null."""
    return F.try_divide(a, b)


def sane_cost(x: Column) -> Column:
    """A cost that can be trusted: a finite number that isn't negative; else null."""
    c = x.try_cast("double")
    return F.when(c.isNotNull() & ~F.isnan(c) & (c >= 0) & (c < F.lit(float("inf"))), c)


def scenario(ev_ratio: Column, percent: Column) -> Column:
    """ev_ratio less `percent` of a hundred, in integer millionths, half up."""
    n = whole(ev_ratio * F.lit(1e6))
    return F.floor((n * (F.lit(100) - percent) + F.lit(50)) / F.lit(100)).cast("double") / F.lit(1e6)


def backoff(attempts: int = 4, base: float = 0.5, most: float = 8.0, total: float = 20.0) -> list[float]:
    """The waits between attempts without jitter, as far as their sum stays within `total`."""
    waits: list[float] = []
    for k in range(attempts - 1):
        wait = min(most, base * 2**k)
        if sum(waits) + wait > total:
            break
        waits.append(wait)
    return waits


def jittered(draws: Column, base: float = 0.5, most: float = 8.0, total: float = 20.0) -> Column:
    """The waits before each retry for an array of draws from [0, 1), as far as their sum stays within `total`."""
    waits = F.transform(draws, lambda u, k: F.least(F.lit(most), F.lit(base) * F.pow(F.lit(2.0), k)) * (F.lit(0.5) + F.lit(0.5) * u))
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(True).alias("on"), F.array().cast("array<double>").alias("waits"))

    def add(held, wait):
        on = held.on & (held.sum + wait <= total)
        return F.struct(F.when(on, held.sum + wait).otherwise(held.sum).alias("sum"), on.alias("on"), F.when(on, F.concat(held.waits, F.array(wait))).otherwise(held.waits).alias("waits"))

    return F.aggregate(waits, start, add, lambda held: held.waits)
