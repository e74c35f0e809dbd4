"""Exact percentiles without sorting or holding the column in one task."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The bracket is counted in so many bins at a time; only their counts reach the driver.
BINS = 1_024


def exact_percentile(df: DataFrame, column: str, q: float, accuracy: int = 10_000) -> float | None:
    """The linearly interpolated percentile of a column of finite doubles, null and NaN left out.

    A sketch brackets the wanted rank within ``n / accuracy`` on either side.  The bracket is
    then counted in ``BINS`` bins, and the bin that holds the rank is the next bracket, until it
    is one value: a few rounds, as each is ``BINS`` times narrower.
    """
    number = F.col(column)
    values = df.where(number.isNotNull() & ~F.isnan(number)).groupBy(column).agg(F.count(F.lit(1)).alias("_times"))
    n = values.agg(F.sum("_times")).first()[0]
    if not n:
        return None
    rank = q * (n - 1)
    lower, upper = math.floor(rank), math.ceil(rank)
    slack = 2.0 / accuracy
    low, high = df.where(number.isNotNull() & ~F.isnan(number)).select(
        F.percentile_approx(column, max(0.0, lower / n - slack), accuracy).alias("low"),
        F.percentile_approx(column, min(1.0, (upper + 1) / n + slack), accuracy).alias("high"),
    ).first()
    total = F.coalesce(F.sum("_times"), F.lit(0))
    below = values.where(number < low).agg(total).first()[0]
    while low < high:
        width = high / BINS - low / BINS
        place = F.floor((number - low) / width) if width > 0 else (number > low).cast("long")
        bins = values.where(number.between(low, high)).groupBy(F.least(place, F.lit(BINS - 1)).alias("_bin"))
        counted = bins.agg(F.sum("_times").alias("times"), F.min(column).alias("low"), F.max(column).alias("high"))
        for row in sorted(counted.collect()):
            if below + row.times > lower:
                low, high = row.low, row.high
                break
            below += row.times
    if lower == upper or values.where(number <= low).agg(total).first()[0] > upper:
        return low
    above = values.where(number > low).agg(F.min(column)).first()[0]
    return low + (above - low) * (rank - lower)
