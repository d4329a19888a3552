"""Time series per key: smoothing, trends, outliers, change points, drift, forecasts.

Smoothing forgets exponentially, so a fold over a bounded frame of the last ``frame`` rows equals the fold over
the whole history to within (1 - alpha) ** frame; frames are sized from ``alpha`` and a tolerance. Every operator is
thus a window over (key, time) with bounded state per row.
"""

from __future__ import annotations

from math import ceil, log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def frame_of(alpha: float, tolerance: float = 1e-12) -> int:
    return max(2, ceil(log(tolerance) / log(1 - alpha)))


def _ordered(keys, order):
    return Window.partitionBy(*keys).orderBy(*order)


def ewma(df: DataFrame, keys, order, value: str, alpha: float, seed: Column | None = None, out: str = "smoothed"):
    """s = alpha x + (1 - alpha) s, from the first value (or ``seed``)."""
    k = frame_of(alpha)
    values = F.collect_list(value).over(_ordered(keys, order).rowsBetween(-k, 0))
    start = F.col("_v")[0] if seed is None else seed
    tail = F.slice("_v", 2, k) if seed is None else F.col("_v")
    fold = F.aggregate(tail, start.cast("double"), lambda s, x: alpha * x + (1 - alpha) * s)
    return df.withColumn("_v", values).withColumn(out, fold).drop("_v")


def ewma_state(df: DataFrame, keys, order, value: str, alpha: float, variant: str = "simple", **limits) -> DataFrame:
    """Level, trend and variance of simple, double or adaptive smoothing.

    The variance is alpha e**2 + (1 - alpha) v with e the error against the previous level. Adaptive smoothing
    raises alpha by half when the deviation of the last 10 values exceeds ``volatility``, else lowers it by 5 %,
    within ``least`` and ``most``.
    """
    least, most, volatility = limits.get("least", 0.05), limits.get("most", 0.5), limits.get("volatility", 2.0)
    # level and trend together forget by sqrt(1 - alpha) a row
    slowest = {"simple": alpha, "double": 1 - (1 - alpha) ** 0.5, "adaptive": min(alpha, max(least, alpha * 0.95))}[variant]
    k = frame_of(slowest)
    w = _ordered(keys, order)
    rows = df.withColumn("_vol", F.coalesce(F.stddev_pop(value).over(w.rowsBetween(-9, 0)), F.lit(0.0)))
    rows = rows.withColumn("_in", F.collect_list(F.struct(F.col(value).cast("double").alias("x"), F.col("_vol").alias("w"))).over(w.rowsBetween(-k, 0)))
    zero = F.struct(F.col("_in")[0]["x"].alias("s"), F.lit(0.0).alias("t"), F.lit(0.0).alias("v"))

    def step(state, row):
        s, t, v, x = state["s"], state["t"], state["v"], row["x"]
        var = alpha * (x - s) * (x - s) + (1 - alpha) * v
        if variant == "double":
            level = alpha * x + (1 - alpha) * (s + t)
            return F.struct(level.alias("s"), (alpha * (level - s) + (1 - alpha) * t).alias("t"), var.alias("v"))
        a = F.lit(alpha)
        if variant == "adaptive":
            a = F.when(row["w"] > volatility, min(most, alpha * 1.5)).otherwise(max(least, alpha * 0.95))
        return F.struct((a * x + (1 - a) * s).alias("s"), t.alias("t"), var.alias("v"))

    rows = rows.withColumn("_st", F.aggregate(F.slice("_in", 2, k), zero, step))
    return rows.select(*df.columns, F.col("_st.s").alias("level"), F.col("_st.t").alias("trend_value"), F.col("_st.v").alias("variance"))


def slope(df: DataFrame, keys, order, value: str, n: int, out: str = "slope") -> DataFrame:
    """Least-squares slope of the last ``n`` values against their index."""
    w = _ordered(keys, order)
    rows = df.withColumn("_i", F.row_number().over(w))
    return rows.withColumn(out, F.coalesce(F.regr_slope(F.col(value).cast("double"), F.col("_i").cast("double")).over(w.rowsBetween(1 - n, 0)), F.lit(0.0))).drop("_i")


def direction(slope_col: Column, deviation: Column) -> Column:
    return F.when(F.abs(slope_col) < deviation * 0.1, "stable").when(slope_col > 0, "increasing").otherwise("decreasing")


def ewma_trend(df, keys, order, value, alpha, volatility: float | None = None):
    """Trend of the last 10 values: direction against a tenth of the deviation, strength, from 5 values on.

    With ``volatility`` given, a deviation of the last 10 values above twice that makes the direction ``volatile``.
    """
    rows = slope(ewma_state(df, keys, order, value, alpha), keys, order, value, 10)
    w = _ordered(keys, order)
    sd = F.sqrt("variance")
    found = direction(F.col("slope"), sd)
    if volatility is not None:
        found = F.when(F.stddev_pop(value).over(w.rowsBetween(-9, 0)) > 2 * volatility, "volatile").otherwise(found)
    rows = rows.withColumn("n", F.row_number().over(w)).withColumn("direction", F.when(F.col("n") < 5, "stable").otherwise(found))
    return rows.withColumn("strength", F.when(F.col("n") < 5, 0.0).otherwise(F.least(F.lit(1.0), F.abs("slope") / (sd + 0.001))))


def ewma_outlier(df, keys, order, value, alpha):
    """Distance from the mean of the last 20 values in deviations, above 2.5; from 10 values on."""
    w = _ordered(keys, order)
    rows = ewma_state(df, keys, order, value, alpha).withColumn("n", F.row_number().over(w))
    rows = rows.withColumn("_m", F.avg(value).over(w.rowsBetween(-19, 0)))
    z = F.abs(F.col(value) - F.col("_m")) / (F.sqrt("variance") + 0.001)
    rows = rows.withColumn("z", F.when(F.col("n") < 10, 0.0).otherwise(z)).drop("_m")
    return rows.withColumn("is_outlier", F.col("z") > 2.5).withColumn("score", F.least(F.lit(1.0), F.col("z") / 2.5))


def ewma_anomaly(df, keys, order, value, alpha):
    """Deviation from the level above 2.5 deviations, with score and confidence."""
    rows = ewma_state(df, keys, order, value, alpha).withColumn("n", F.row_number().over(_ordered(keys, order)))
    gap, limit = F.abs(F.col(value) - F.col("level")), F.sqrt("variance") * 2.5
    return (
        rows.withColumn("is_anomalous", gap > limit)
        .withColumn("score", F.least(F.lit(1.0), gap / (limit + 0.001)))
        .withColumn("confidence", F.least(F.lit(0.95), F.col("n") / 30))
    )


def volatility_analysis(df, keys, order, value):
    """Deviation of the last 10 and of the 5 before each value, spikes over twice its mean, regime.

    The mean is that of the history within the last 20 values, so that no row needs the whole series. The regime is the
    deviation against it: low below half, medium below 1.5, high below 3 times, else extreme; low without history.
    """
    w = _ordered(keys, order)
    rows = df.withColumn("volatility", F.coalesce(F.stddev_pop(value).over(w.rowsBetween(-9, 0)), F.lit(0.0)))
    before = F.when(F.row_number().over(w) > 5, F.stddev_pop(value).over(w.rowsBetween(-5, -1)))
    rows = rows.withColumn("history", before)
    rows = rows.withColumn("_mean", F.avg("history").over(w.rowsBetween(-14, 0)))
    v, m = F.col("volatility"), F.col("_mean")
    rows = rows.withColumn("spike", F.coalesce(F.col("history") > m * 2, F.lit(False)))
    regime = F.when(m.isNull() | (v < m * 0.5), "low").when(v < m * 1.5, "medium").when(v < m * 3, "high").otherwise("extreme")
    return rows.withColumn("regime", regime).drop("_mean")


def change_flag(df, keys, order, value, alpha, k: float = 2.0):
    """Whether the mean of the last 5 differs from that of the 10 before by more than ``k`` deviations."""
    w = _ordered(keys, order)
    rows = ewma_state(df, keys, order, value, alpha).withColumn("n", F.row_number().over(w))
    gap = F.abs(F.avg(value).over(w.rowsBetween(-4, 0)) - F.avg(value).over(w.rowsBetween(-14, -5)))
    return rows.withColumn("gap", gap).withColumn("changed", F.when(F.col("n") < 15, False).otherwise(F.col("gap") > k * F.sqrt("variance")))


def ewma_forecast(df, keys, order, value, alpha):
    """Next value with a band of two deviations, and how often the last 9 steps stayed within one."""
    w = _ordered(keys, order)
    rows = ewma_state(df, keys, order, value, alpha).withColumn("_step", F.abs(F.col(value) - F.lag(value).over(w)))
    near = F.collect_list("_step").over(w.rowsBetween(-8, 0))
    sd = F.sqrt("variance")
    hits = F.size(F.filter(F.col("_near"), lambda x: x <= sd))
    rows = rows.withColumn("n", F.row_number().over(w)).withColumn("_near", near)
    return (
        rows.withColumn("next_min", F.col("level") - 2 * sd)
        .withColumn("next_max", F.col("level") + 2 * sd)
        .withColumn("accuracy", F.when(F.col("n") < 10, 0.5).otherwise(hits / 9))
        .drop("_step", "_near")
    )


HORIZONS = [(1, 0.3), (5, 0.2), (15, 0.1), (60, 0.05)]


def multi_window_ewma(df, keys, order, value):
    """Level of four smoothing factors, and their consensus: rising if at least three stand above the slower one."""
    out = df
    for minutes, alpha in HORIZONS:
        out = ewma(out, keys, order, value, alpha, out=f"level_{minutes}m")
    votes = sum((F.when(F.col(f"level_{a}m") > F.col(f"level_{b}m"), 1).otherwise(0) for a, b in ((1, 5), (5, 15), (15, 60))), F.lit(0))
    return out.withColumn("rising_votes", votes).withColumn("consensus", F.when(votes >= 2, "increasing").otherwise("decreasing"))


def ewma_risk(anomaly: Column, trend: Column, volatility: Column, value: Column, baseline: Column, confidence: Column, weights=(0.4, 0.2, 0.2, 0.2)):
    """Weighted anomaly, trend, volatility and baseline deviation, times the confidence (0.5 at least)."""
    t = F.when(trend == "volatile", 0.8).when(trend.isin("increasing", "decreasing"), 0.4).otherwise(0.1)
    v = F.least(F.lit(1.0), volatility / 10)
    b = F.least(F.lit(1.0), F.abs(value - baseline) / (baseline + 0.001))
    score = anomaly * weights[0] + t * weights[1] + v * weights[2] + b * weights[3]
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score * F.greatest(F.lit(0.5), confidence)))


def outliers(df, keys, value, method="zscore"):
    """Rows outside 2.5 deviations, or outside 1.5 interquartile ranges; keys of 5 rows at least."""
    if method == "zscore":
        stats = df.groupBy(*keys).agg(F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s"), F.count(F.lit(1)).alias("_n"))
        rows = df.join(stats, keys).withColumn("score", F.abs(F.col(value) - F.col("_m")) / (F.col("_s") + 0.001))
        return rows.filter((F.col("score") > 2.5) & (F.col("_n") >= 5)).drop("_m", "_s", "_n")
    stats = df.groupBy(*keys).agg(F.percentile(value, [0.25, 0.75]).alias("_q"), F.count(F.lit(1)).alias("_n"))
    iqr = F.col("_q")[1] - F.col("_q")[0]
    low, high = F.col("_q")[0] - 1.5 * iqr, F.col("_q")[1] + 1.5 * iqr
    rows = df.join(stats, keys).filter(((F.col(value) < low) | (F.col(value) > high)) & (F.col("_n") >= 5))
    return rows.withColumn("score", F.greatest(F.abs(F.col(value) - low), F.abs(F.col(value) - high)) / iqr).drop("_q", "_n")


def rolling_stats(df, keys, order, value, n=10):
    """Mean, variance and slope of full frames of ``n`` rows."""
    w = _ordered(keys, order).rowsBetween(1 - n, 0)
    rows = slope(df, keys, order, value, n)
    rows = rows.withColumn("mean", F.avg(value).over(w)).withColumn("variance", F.var_pop(value).over(w)).withColumn("_c", F.count(value).over(w))
    return rows.filter(F.col("_c") == n).drop("_c").withColumn("trend", direction(F.col("slope"), F.sqrt("variance")))


def trend_analysis(df, keys, order, value):
    """Slope of the last quarter and of the whole series of each key."""
    w = _ordered(keys, order)
    rows = df.withColumn("_i", F.row_number().over(w).cast("double")).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    late = F.col("_i") > F.col("_n") - F.floor(F.col("_n") / 4)
    y, x = F.col(value).cast("double"), F.col("_i")
    return rows.groupBy(*keys).agg(
        F.regr_slope(F.when(late, y), F.when(late, x)).alias("short_slope"), F.regr_slope(y, x).alias("long_slope"),
        F.stddev_pop(value).alias("std"), F.count(F.lit(1)).alias("n"),
    )


def seasonality(df, keys, ts, value):
    """Variance of the hour means over a 24-hour spine (0 for hours without rows) against the variance; detected over 0.3."""
    hours = df.groupBy(*keys, F.hour(ts).alias("_h")).agg(F.avg(value).alias("_a"))
    of_hours = hours.groupBy(*keys).agg(F.sum("_a").alias("_s"), F.sum(F.col("_a") * F.col("_a")).alias("_q"))
    spread = F.col("_q") / 24 - (F.col("_s") / 24) * (F.col("_s") / 24)
    total = df.groupBy(*keys).agg(F.var_pop(value).alias("_v"), F.count(F.lit(1)).alias("n"))
    strength = spread / (F.col("_v") + 0.001)
    out = of_hours.join(total, keys).withColumn("strength", F.when(F.col("n") < 60, 0.0).otherwise(F.least(F.lit(1.0), strength)))
    return out.withColumn("detected", F.col("strength") > 0.3).drop("_s", "_q", "_v")


def change_points(df, keys, order, value, size=5):
    """Rows where the means of the ``size`` rows before and from there on differ by more than 1.5 deviations."""
    w = _ordered(keys, order)
    sd = F.stddev_pop(value).over(Window.partitionBy(*keys))
    before, after = w.rowsBetween(-size, -1), w.rowsBetween(0, size - 1)
    rows = df.withColumn("_full", (F.count(value).over(before) == size) & (F.count(value).over(after) == size))
    gap = F.abs(F.avg(value).over(after) - F.avg(value).over(before))
    rows = rows.withColumn("magnitude", F.try_divide(gap, sd * 1.5))
    return rows.filter(F.col("_full") & (F.col("magnitude") > 1)).drop("_full")


def linear_forecast(df, keys, order, value, horizon=10, last=50, z=1.96):
    """Line through the last 50 rows carried on for ``horizon`` steps, with a band and decaying confidence."""
    w = _ordered(keys, [F.col(o).desc() if isinstance(o, str) else o.desc() for o in order])
    rows = df.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= last)
    y, x = F.col(value).cast("double"), (-F.col("_r")).cast("double")
    fit = rows.groupBy(*keys).agg(F.regr_slope(y, x).alias("_s"), F.regr_intercept(y, x).alias("_b"), F.stddev_pop(value).alias("_sd"))
    out = fit.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    out = out.withColumn("forecast", F.coalesce("_s", F.lit(0.0)) * (F.col("step") - 1) + F.col("_b"))
    out = out.withColumn("low", F.col("forecast") - z * F.col("_sd")).withColumn("high", F.col("forecast") + z * F.col("_sd"))
    return out.withColumn("confidence", F.greatest(F.lit(0.1), 0.9 - 0.05 * F.col("step"))).drop("_s", "_b", "_sd")


def detect_drift(df, keys, value, baseline, threshold=0.2):
    """Relative distance of the smoothed value from its baseline: adapt from ``threshold``, rollback from 1."""
    gap = F.col(value) - F.col(baseline)
    rows = df.withColumn("magnitude", F.abs(gap) / (F.abs(F.col(baseline)) + 0.001))
    rows = rows.withColumn("direction", F.when(gap > 0, "increase").when(gap < 0, "decrease").otherwise("stable"))
    m = F.col("magnitude")
    return rows.withColumn("action", F.when(m >= 1, "rollback").when(m >= threshold, "adapt").otherwise("monitor"))


def traffic_anomalies(stats: DataFrame, base_rate, base_latency, base_error) -> DataFrame:
    """Scores of rate, latency, errors and bandwidth against baselines; the combined type, score and risk."""
    rate = F.abs(F.col("requests_per_minute") - base_rate) / base_rate
    late = F.abs(F.col("mean_latency") - base_latency) / base_latency
    err = F.col("error_rate") / F.greatest(base_error, F.lit(0.001))
    expected = F.col("requests_per_minute") * 1024
    band = F.abs(F.col("bytes") - expected) / F.greatest(expected, F.lit(1.0))
    checks = [("request_rate", rate, 2.0), ("response_time", late, 1.5), ("error_rate", err, 3.0), ("bandwidth", band, 2.0)]
    found = F.array_compact(F.array(*[F.when(d > k, F.lit(n)) for n, d, k in checks]))
    scores = F.greatest(*[F.when(d > k, F.least(d / k, F.lit(1.0))).otherwise(0.0) for _, d, k in checks])
    out = stats.withColumn("anomaly_types", F.array_join(found, ",")).withColumn("anomaly_score", scores)
    risk = F.col("anomaly_score") * 0.6 + F.least(F.col("error_rate") * 5, F.lit(0.3)) + F.least(F.col("mean_latency") / 1000, F.lit(0.2))
    return out.withColumn("risk", F.least(F.lit(1.0), risk))


def session_timing(df, session, ts, tie):
    """Gap to the previous row of the session in seconds; bursts under 1 s, idle over 5 minutes."""
    w = Window.partitionBy(session).orderBy(ts, tie)
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    rows = df.withColumn("gap", (us - F.lag(us).over(w)) / 1e6)
    return rows.withColumn("burst", F.coalesce(F.col("gap") < 1, F.lit(False))).withColumn("idle", F.coalesce(F.col("gap") > 300, F.lit(False)))


def adapt_baselines(df, keys, order, value, alpha=0.1, tolerance=0.5):
    """Baseline after each batch row: moved by ``alpha`` towards the value, unless it lies over ``tolerance`` away."""
    w = _ordered(keys, order)
    k = 400
    rows = df.withColumn("_v", F.collect_list(F.col(value).cast("double")).over(w.rowsBetween(-k, 0)))
    move = lambda b, x: F.when(F.abs(x - b) / (F.abs(b) + 0.001) > tolerance, b).otherwise(b + alpha * (x - b))
    return rows.withColumn("baseline", F.aggregate(F.slice("_v", 2, k), F.col("_v")[0], move)).drop("_v")


def confidence_interval(df: DataFrame, keys, value: str, z: float = 1.96) -> DataFrame:
    """Per key the mean less and plus ``z`` standard errors."""
    half = z * F.sqrt(F.var_pop(value) / F.count(F.lit(1)))
    return df.groupBy(*keys).agg((F.avg(value) - half).alias("low"), (F.avg(value) + half).alias("high"))


def volume_anomalies(df: DataFrame, slot: Column, least_z: float = 3.0) -> DataFrame:
    """(slot, n, z): slots whose row count lies over ``least_z`` deviations from the mean of all slots."""
    counts = df.groupBy(slot.alias("slot")).agg(F.count(F.lit(1)).alias("n"))
    stats = counts.agg(F.avg("n").alias("_m"), F.stddev_pop("n").alias("_s"))
    z = F.try_divide(F.abs(F.col("n") - F.col("_m")), F.col("_s"))
    return counts.crossJoin(F.broadcast(stats)).withColumn("z", z).filter(F.col("z") > least_z).drop("_m", "_s")  # one row


def ew_fold(df: DataFrame, keys, order, value: str, alpha: float) -> DataFrame:
    """(keys, value, n): the exponentially weighted fold of all of a key's values, its first one as the start.

    The fold is a weighted sum: the k-th value from the end weighs alpha (1 - alpha)**k, the first of all
    (1 - alpha)**(n - 1). Weights need only ranks, so partial sums are combined before anything is shuffled by key again.
    """
    w = _ordered(keys, order)
    rows = df.withColumn("_i", F.row_number().over(w)).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    decay = F.pow(F.lit(1 - alpha), F.col("_n") - F.col("_i"))
    weight = F.when(F.col("_i") == 1, decay).otherwise(alpha * decay)
    return rows.groupBy(*keys).agg(F.sum(weight * F.col(value)).alias("value"), F.count(F.lit(1)).alias("n"))


def trend_segments(df, keys, order, value, seconds: Column, size=5):
    """(keys, segment, n, seconds, slope, trend, change_points): a series cut where its level changes.

    A segment begins at the first of consecutive change points (see ``change_points``). ``seconds`` is the time of a row.
    The slope is per row; it is stable under a tenth of the segment's deviation, as is a segment of one row.
    """
    w = _ordered(keys, order)
    every = Window.partitionBy(*keys)
    before, after = w.rowsBetween(-size, -1), w.rowsBetween(0, size - 1)
    full = (F.count(value).over(before) == size) & (F.count(value).over(after) == size)
    gap = F.abs(F.avg(value).over(after) - F.avg(value).over(before))
    rows = df.withColumn("_flag", F.coalesce(full & (F.try_divide(gap, F.stddev_pop(value).over(every) * 1.5) > 1), F.lit(False)))
    rows = rows.withColumns({"_new": F.col("_flag") & ~F.coalesce(F.lag("_flag").over(w), F.lit(False)), "_i": F.row_number().over(w).cast("double"), "_at": seconds})
    rows = rows.withColumn("segment", F.sum(F.col("_new").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    y = F.col(value).cast("double")
    g = rows.groupBy(*keys, "segment").agg(
        F.count(F.lit(1)).alias("n"), (F.max("_at") - F.min("_at")).alias("seconds"), F.coalesce(F.regr_slope(y, F.col("_i")), F.lit(0.0)).alias("slope"),
        F.stddev_pop(value).alias("_d"), F.count_if("_flag").alias("change_points"),
    )
    still = (F.col("n") < 2) | (F.col("_d") == 0)
    return g.withColumn("trend", F.when(still, "stable").otherwise(direction(F.col("slope"), F.col("_d")))).drop("_d")


# The name of the pattern of each direction.
TREND_PATTERNS = {"increasing": "increasing_trend", "decreasing": "decreasing_trend", "stable": "stable_pattern"}


def trend_patterns(df, keys, order, value, ts, seconds: Column, size=5):
    """Per key: the dominant pattern with its share, segments, change points, and stability (1 less a tenth of the change points).

    The direction that holds for most of the time dominates (ties by name; a series without duration goes by rows),
    unless the hours of the day explain a larger share (see ``seasonality``).
    """
    parts = trend_segments(df, keys, order, value, seconds, size)
    names = F.create_map(*[F.lit(x) for kv in TREND_PATTERNS.items() for x in kv])
    g = parts.groupBy(*keys, names[F.col("trend")].alias("pattern")).agg(
        F.sum("seconds").alias("_s"), F.sum("n").alias("_n"), F.count(F.lit(1)).alias("_k"), F.sum("change_points").alias("_c")
    )
    all_of = Window.partitionBy(*keys)
    s, n = F.sum("_s").over(all_of), F.sum("_n").over(all_of)
    g = g.withColumn("share", F.when(s > 0, F.try_divide(F.col("_s"), s)).otherwise(F.col("_n") / n))
    best = g.groupBy(*keys).agg(
        F.min(F.struct((-F.round("share", 9)).alias("o"), "pattern", "share")).alias("_b"), F.sum("_k").alias("segments"), F.sum("_c").alias("change_points")
    )
    season = seasonality(df, keys, ts, value).select(*keys, F.when(F.col("detected"), F.col("strength")).alias("_season"))
    out = best.join(season, keys, "left")
    by_hour = F.coalesce(F.col("_season") > F.col("_b.share"), F.lit(False))
    return out.select(
        *keys, F.when(by_hour, "seasonal_pattern").otherwise(F.col("_b.pattern")).alias("pattern"),
        F.when(by_hour, F.col("_season")).otherwise(F.col("_b.share")).alias("share"), "segments", "change_points",
        F.greatest(F.lit(0.0), 1 - F.col("change_points") / 10).alias("stability"),
    )


def temporal_features(df: DataFrame, keys, ts: str) -> DataFrame:
    """Per key the mean, deviation and distinct number of the hours and of the weekdays (Monday is 0) of its times."""
    h, d = F.hour(ts), F.weekday(ts)
    stats = lambda c, n, many: [F.avg(c).alias(f"{n}_mean"), F.stddev_pop(c).alias(f"{n}_std"), F.count_distinct(c).alias(many)]
    return df.groupBy(*keys).agg(*stats(h, "hour", "hours"), *stats(d, "day", "days"))


def baseline_ema(df: DataFrame, keys, order, seeds: dict[str, float], alpha: float = 0.1) -> DataFrame:
    """``df`` with ``{column}_baseline`` for each column of ``seeds``: its average smoothed on from the seed given there."""
    out = df
    for column, seed in seeds.items():
        out = ewma(out, keys, order, column, alpha, seed=F.lit(float(seed)), out=f"{column}_baseline")
    return out


def series_insights(df: DataFrame, keys, order, value: str, alpha: float = 0.3, volatility: float = 0.15) -> DataFrame:
    """(insight, severity, series, share, confidence) over all series: what holds for a large part of them now.

    ``trend_change`` (medium): over 70 % end rising. ``volatility_spike`` (high): over 50 % end volatile, see
    ``ewma_trend``. ``volatility_regime`` (high): over 30 % end in a high or extreme regime. Series are reduced to their
    last row before any is compared; no series gives no insight.
    """
    rows = volatility_analysis(ewma_trend(df, keys, order, value, alpha, volatility), keys, order, value)
    last = rows.groupBy(*keys).agg(F.max_by(F.struct("direction", "regime"), "n").alias("x")).select("x.*")
    held = {"trend_change": F.col("direction") == "increasing", "volatility_spike": F.col("direction") == "volatile", "volatility_regime": F.col("regime").isin("high", "extreme")}
    g = last.agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(c).alias(n) for n, c in held.items()])
    rules = [("trend_change", "medium", 0.7, 0.8), ("volatility_spike", "high", 0.5, 0.9), ("volatility_regime", "high", 0.3, 0.85)]
    each = [F.struct(F.lit(n).alias("insight"), F.lit(s).alias("severity"), F.col(n).alias("series"), F.try_divide(F.col(n), F.col("_n")).alias("share"), F.lit(c).alias("confidence"), F.lit(m).alias("_least")) for n, s, m, c in rules]
    return g.select(F.explode(F.array(*each)).alias("i")).select("i.*").filter("share > _least").drop("_least")


def validate_series(df: DataFrame, keys, order, value: str, alpha: float, window: int, least: float = 0.7) -> DataFrame:
    """(keys, points, accuracy, issues, is_valid): checks of a smoothing's parameters and of its forecasts per series.

    Issues: ``alpha_range`` (not between 0 and 1, both left out; there is no accuracy then), ``window_size`` (below 10),
    ``low_accuracy`` (of the last forecast, below ``least``).
    """
    sound = 0 < alpha < 1
    if sound:
        g = ewma_forecast(df, keys, order, value, alpha).groupBy(*keys).agg(F.max("n").alias("points"), F.max_by("accuracy", "n").alias("accuracy"))
    else:
        g = df.groupBy(*keys).agg(F.count(F.lit(1)).cast("int").alias("points")).withColumn("accuracy", F.lit(None).cast("double"))
    found = [F.when(F.lit(not sound), F.lit("alpha_range")), F.when(F.lit(window < 10), F.lit("window_size")), F.when(F.col("accuracy") < least, F.lit("low_accuracy"))]
    out = g.withColumn("issues", F.array_compact(F.array(*found)))
    return out.withColumn("is_valid", F.size("issues") == 0)
