"""Exact quantiles of very many values without one task that holds them all."""

from __future__ import annotations

from math import floor

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: So many distinct values of a bracket are ordered in one task.
BRACKET = 1 << 18
ACCURACY = 10000


def exact_quantiles(df: DataFrame, value: str, probabilities: list[float], most: int = BRACKET) -> list[float | None]:
    """Quantiles by linear interpolation between ranks, as ``percentile`` has them; None for a table without values.

    A mergeable sketch brackets the two ranks of a quantile; the next pass counts what lies below the bracket and what
    equals each value inside it. A bracket of too many distinct values is bracketed again. Only counts and bounds reach
    the driver. ``df`` is read twice or more: pass a stored table.
    """
    rows = df.select(F.col(value).cast("double").alias("v")).filter("v is not null")
    n = rows.count()
    return [_quantile(rows, p, n, most) for p in probabilities] if n else [None] * len(probabilities)


def _quantile(rows: DataFrame, p: float, n: int, most: int) -> float:
    at = (n - 1) * p
    below, inside, count = 0, rows, n
    last = None
    while True:
        want = (floor(at) - below, min(floor(at) + 1, n - 1) - below)
        margin = 2 / ACCURACY
        probe = [max(0.0, want[0] / count - margin), min(1.0, (want[1] + 1) / count + margin)]
        low, high = inside.agg(F.percentile_approx("v", probe, ACCURACY).alias("q")).first()["q"]
        c = inside.agg(
            F.count_if(F.col("v") < low).alias("under"), F.count_if((F.col("v") >= low) & (F.col("v") <= high)).alias("in"),
            F.approx_count_distinct(F.when((F.col("v") >= low) & (F.col("v") <= high), F.col("v"))).alias("kinds"),
        ).first()
        if not c["under"] <= want[0] or not c["under"] + c["in"] > want[1]:
            low, high, c = None, None, None  # the sketch missed: order what there is
            break
        if c["kinds"] <= most or (low, high) == last:
            break
        last = (low, high)
        inside = inside.filter((F.col("v") >= low) & (F.col("v") <= high))
        below, count = below + c["under"], c["in"]
    part = inside if c is None else inside.filter((F.col("v") >= low) & (F.col("v") <= high))
    below += 0 if c is None else c["under"]
    kinds = part.groupBy("v").agg(F.count(F.lit(1)).alias("k"))
    upto = kinds.withColumn("upto", F.sum("k").over(Window.orderBy("v")))  # at most a bracket of rows
    a, b = (upto.filter(F.col("upto") > floor(at) - below), upto.filter(F.col("upto") > min(floor(at) + 1, n - 1) - below))
    lo, hi = a.agg(F.min("v")).first()[0], b.agg(F.min("v")).first()[0]
    return lo + (hi - lo) * (at - floor(at)) if hi != lo else lo


def robust_outliers(profiles: DataFrame, item: str, value: str, least: float = 3.5) -> DataFrame:
    """(item, value, z): items whose value lies over ``least`` robust deviations above the median of all items.

    z is .6745 (value - median) / MAD, the median distance from the median; with a MAD of 0 nothing is an outlier.
    """
    (mid,) = exact_quantiles(profiles, value, [0.5])
    if mid is None:
        return profiles.limit(0).select(F.col(item).cast("string").alias("item"), F.col(value).cast("double").alias("value"), F.lit(0.0).alias("z"))
    (mad,) = exact_quantiles(profiles.select(F.abs(F.col(value) - F.lit(mid)).alias("_d")), "_d", [0.5])
    z: Column = F.try_divide(F.lit(0.6745) * (F.col(value) - F.lit(mid)), F.lit(float(mad)))
    return profiles.select(F.col(item).cast("string").alias("item"), F.col(value).cast("double").alias("value"), z.alias("z")).filter(F.col("z") > least)
