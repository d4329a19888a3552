"""Queries: time series."""

from __future__ import annotations

from pyspark.sql import functions as F

from duskline.operators import report as R
from duskline.operators import series as W

from .registry import query, rnd

K, O, V = ["user_id"], ["ts", "event_id"], "value"
BASE = "b AS (SELECT user_id, event_id, ts, value AS x, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events)"


def ev(t):
    return t.events.select("user_id", "event_id", "ts", "value")


def fold(alpha, variant="simple", vol=2.0, most=0.5, least=0.05):
    """The sequential fold as a recursive CTE: level s, trend t, variance v."""
    a = f"{alpha}"
    if variant == "adaptive":
        a = f"(CASE WHEN b.w > {vol} THEN {min(most, alpha * 1.5)} ELSE {max(least, alpha * 0.95)} END)"
    level = f"{a} * b.x + (1 - {a}) * r.s" if variant != "double" else f"{alpha} * b.x + (1 - {alpha}) * (r.s + r.t)"
    trend = f"{alpha} * ({level} - r.s) + (1 - {alpha}) * r.t" if variant == "double" else "0.0::double"
    b = BASE.replace("AS i FROM events)", "AS i, coalesce(stddev_pop(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), 0) AS w FROM events)")
    return (
        f"WITH RECURSIVE {b}, r AS (SELECT user_id, event_id, i, x, x AS s, 0.0::double AS t, 0.0::double AS v FROM b WHERE i = 1 UNION ALL "
        f"SELECT b.user_id, b.event_id, b.i, b.x, ({level})::double, ({trend})::double, ({alpha} * (b.x - r.s) * (b.x - r.s) + (1 - {alpha}) * r.v)::double FROM r JOIN b ON b.user_id = r.user_id AND b.i = r.i + 1)"
    )


@query("w01_ewma", fold(0.3) + " SELECT event_id, round(s, 5) AS level FROM r")
def _(t):
    return W.ewma(ev(t), K, O, V, 0.3).select("event_id", rnd("smoothed").alias("level"))


for variant in ("double", "adaptive"):

    @query(f"w0{2 + (variant == 'adaptive')}_ewma_{variant}", fold(0.3, variant) + " SELECT event_id, round(s, 5) AS level, round(t, 5) AS trend_value FROM r")
    def _(t, variant=variant):
        return W.ewma_state(ev(t), K, O, V, 0.3, variant).select("event_id", rnd("level").alias("level"), rnd("trend_value").alias("trend_value"))


@query("w04_ew_variance", fold(0.3) + " SELECT event_id, round(v, 4) AS variance FROM r")
def _(t):
    return W.ewma_state(ev(t), K, O, V, 0.3).select("event_id", rnd("variance", 4).alias("variance"))


SLOPE = "coalesce(regr_slope(x, i) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), 0)"


@query("w05_ewma_trend", fold(0.3) + f", q AS (SELECT *, {SLOPE} AS sl FROM r) SELECT event_id, CASE WHEN i < 5 THEN 'stable' WHEN abs(sl) < sqrt(v) * 0.1 THEN 'stable' WHEN sl > 0 THEN 'increasing' ELSE 'decreasing' END AS direction, round(CASE WHEN i < 5 THEN 0 ELSE least(1, abs(sl) / (sqrt(v) + 0.001)) END, 5) AS strength FROM q")
def _(t):
    return W.ewma_trend(ev(t), K, O, V, 0.3).select("event_id", "direction", rnd("strength").alias("strength"))


@query("w06_ewma_outlier", fold(0.3) + ", q AS (SELECT *, CASE WHEN i < 10 THEN 0 ELSE abs(x - avg(x) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)) / (sqrt(v) + 0.001) END AS z FROM r) SELECT event_id, round(z, 4) AS z, z > 2.5 AS is_outlier FROM q")
def _(t):
    return W.ewma_outlier(ev(t), K, O, V, 0.3).select("event_id", rnd("z", 4).alias("z"), "is_outlier")


@query("w07_ewma_anomaly", fold(0.3) + " SELECT event_id, abs(x - s) > sqrt(v) * 2.5 AS is_anomalous, round(least(1, abs(x - s) / (sqrt(v) * 2.5 + 0.001)), 5) AS score, round(least(0.95, i / 30), 5) AS confidence FROM r")
def _(t):
    return W.ewma_anomaly(ev(t), K, O, V, 0.3).select("event_id", "is_anomalous", rnd("score").alias("score"), rnd("confidence").alias("confidence"))


@query(
    "w08_volatility_analysis",
    f"WITH {BASE}, h AS (SELECT *, coalesce(stddev_pop(x) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), 0) AS vol, CASE WHEN i > 5 THEN stddev_pop(x) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) END AS hist FROM b), "
    "m AS (SELECT *, avg(hist) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN 14 PRECEDING AND CURRENT ROW) AS mean FROM h) SELECT event_id, round(vol, 5) AS volatility, coalesce(hist > mean * 2, false) AS spike, CASE WHEN mean IS NULL OR vol < mean * 0.5 THEN 'low' WHEN vol < mean * 1.5 THEN 'medium' WHEN vol < mean * 3 THEN 'high' ELSE 'extreme' END AS regime FROM m",
)
def _(t):
    return W.volatility_analysis(ev(t), K, O, V).select("event_id", rnd("volatility").alias("volatility"), "spike", "regime")


@query("w09_change_flag", fold(0.3) + ", q AS (SELECT *, abs(avg(x) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) - avg(x) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN 14 PRECEDING AND 5 PRECEDING)) AS gap FROM r) SELECT event_id, CASE WHEN i < 15 THEN false ELSE gap > 2 * sqrt(v) END AS changed FROM q")
def _(t):
    return W.change_flag(ev(t), K, O, V, 0.3).select("event_id", "changed")


@query(
    "w10_ewma_forecast",
    fold(0.3) + ", d AS (SELECT *, abs(x - lag(x) OVER (PARTITION BY user_id ORDER BY i)) AS st FROM r), l AS (SELECT *, list(st) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN 8 PRECEDING AND CURRENT ROW) AS near FROM d) "
    "SELECT event_id, round(s - 2 * sqrt(v), 4) AS next_min, round(s + 2 * sqrt(v), 4) AS next_max, round(CASE WHEN i < 10 THEN 0.5 ELSE len(list_filter(near, lambda q: q <= sqrt(v))) / 9 END, 5) AS accuracy FROM l",
)
def _(t):
    return W.ewma_forecast(ev(t), K, O, V, 0.3).select("event_id", rnd("next_min", 4).alias("next_min"), rnd("next_max", 4).alias("next_max"), rnd("accuracy").alias("accuracy"))


MULTI = f"WITH RECURSIVE {BASE}, r AS (SELECT user_id, event_id, i, x AS p, x AS q, x AS u, x AS w FROM b WHERE i = 1 UNION ALL SELECT b.user_id, b.event_id, b.i, (0.3 * x + 0.7 * p)::double, (0.2 * x + 0.8 * q)::double, (0.1 * x + 0.9 * u)::double, (0.05 * x + 0.95 * w)::double FROM r JOIN b ON b.user_id = r.user_id AND b.i = r.i + 1)"


@query("w11_multi_window_ewma", MULTI + " SELECT event_id, round(p, 4) AS level_1m, round(w, 4) AS level_60m, CASE WHEN (p > q)::int + (q > u)::int + (u > w)::int >= 2 THEN 'increasing' ELSE 'decreasing' END AS consensus FROM r WHERE i > 1")
def _(t):
    out = W.multi_window_ewma(ev(t), K, O, V)
    first = F.row_number().over(W._ordered(K, O))
    out = out.withColumn("n", first).filter("n > 1")
    return out.select("event_id", rnd("level_1m", 4).alias("level_1m"), rnd("level_60m", 4).alias("level_60m"), "consensus")


@query(
    "w12_ewma_risk",
    fold(0.3) + f", q AS (SELECT *, {SLOPE} AS sl, coalesce(stddev_pop(x) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), 0) AS vol FROM r) SELECT event_id, round(greatest(0, least(1, (least(1, abs(x - s) / (sqrt(v) * 2.5 + 0.001)) * 0.4 + CASE WHEN i < 5 OR abs(sl) < sqrt(v) * 0.1 THEN 0.1 ELSE 0.4 END * 0.2 + least(1, vol / 10) * 0.2 + least(1, abs(x - 250) / 250.001) * 0.2) * greatest(0.5, least(0.95, i / 30)))), 4) AS risk FROM q",
)
def _(t):
    rows = W.ewma_trend(ev(t), K, O, V, 0.3)
    limit = F.sqrt("variance") * 2.5
    vol = F.coalesce(F.stddev_pop(V).over(W._ordered(K, O).rowsBetween(-9, 0)), F.lit(0.0))
    anomaly = F.least(F.lit(1.0), F.abs(F.col(V) - F.col("level")) / (limit + 0.001))
    return rows.withColumn("vol", vol).select("event_id", rnd(W.ewma_risk(anomaly, F.col("direction"), F.col("vol"), F.col(V), F.lit(250.0), F.least(F.lit(0.95), F.col("n") / 30)), 4).alias("risk"))


@query("w13_outliers_zscore", "WITH s AS (SELECT user_id, avg(value) AS m, stddev_pop(value) AS sd, count(*) AS n FROM events GROUP BY user_id) SELECT event_id, round(abs(value - m) / (sd + 0.001), 4) AS score FROM events JOIN s USING (user_id) WHERE n >= 5 AND abs(value - m) / (sd + 0.001) > 2.5")
def _(t):
    return W.outliers(ev(t), K, V).select("event_id", rnd("score", 4).alias("score"))


@query("w14_outliers_iqr", "WITH s AS (SELECT user_id, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3, count(*) AS n FROM events GROUP BY user_id), z AS (SELECT event_id, value, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi, q3 - q1 AS iqr FROM events JOIN s USING (user_id) WHERE n >= 5) SELECT event_id, round(greatest(abs(value - lo), abs(value - hi)) / iqr, 4) AS score FROM z WHERE value < lo OR value > hi")
def _(t):
    return W.outliers(ev(t), K, V, "iqr").select("event_id", rnd("score", 4).alias("score"))


@query("w15_rolling_stats", f"WITH {BASE}, q AS (SELECT *, {SLOPE} AS sl, avg(x) OVER w AS m, var_pop(x) OVER w AS va FROM b WINDOW w AS (PARTITION BY user_id ORDER BY i ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)) SELECT event_id, round(m, 5) AS mean, round(va, 4) AS variance, CASE WHEN abs(sl) < sqrt(va) * 0.1 THEN 'stable' WHEN sl > 0 THEN 'increasing' ELSE 'decreasing' END AS trend FROM q WHERE i >= 10")
def _(t):
    return W.rolling_stats(ev(t), K, O, V).select("event_id", rnd("mean").alias("mean"), rnd("variance", 4).alias("variance"), "trend")


TA = f"{BASE}, n AS (SELECT *, count(*) OVER (PARTITION BY user_id) AS n FROM b), g AS (SELECT user_id, regr_slope(CASE WHEN i > n - n // 4 THEN x END, CASE WHEN i > n - n // 4 THEN i END) AS ss, regr_slope(x, i) AS ls, stddev_pop(x) AS sd, count(*) AS n FROM n GROUP BY user_id)"


@query("w16_trend_analysis", f"WITH {TA} SELECT user_id, round(coalesce(ss, 0), 5) AS short_slope, round(coalesce(ls, 0), 5) AS long_slope, n FROM g WHERE n >= 8")
def _(t):
    return W.trend_analysis(ev(t), K, O, V).filter("n >= 8").select("user_id", rnd(F.coalesce("short_slope", F.lit(0.0))).alias("short_slope"), rnd(F.coalesce("long_slope", F.lit(0.0))).alias("long_slope"), "n")


@query("w17_seasonality", "WITH h AS (SELECT event_type, hour(ts) AS h, avg(value) AS a FROM events GROUP BY 1, 2), s AS (SELECT event_type, sum(a * a) / 24 - (sum(a) / 24) * (sum(a) / 24) AS sp FROM h GROUP BY 1), v AS (SELECT event_type, var_pop(value) AS v, count(*) AS n FROM events GROUP BY 1) SELECT event_type, n, round(CASE WHEN n < 60 THEN 0 ELSE least(1, sp / (v + 0.001)) END, 5) AS strength, n >= 60 AND sp / (v + 0.001) > 0.3 AS detected FROM s JOIN v USING (event_type)")
def _(t):
    return W.seasonality(t.events, ["event_type"], "ts", "value").withColumn("strength", rnd("strength"))


CP = f"{BASE}, q AS (SELECT *, abs(avg(x) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) - avg(x) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)) / (stddev_pop(x) OVER (PARTITION BY user_id) * 1.5) AS m, count(*) OVER (PARTITION BY user_id) AS n FROM b)"


@query("w18_change_points", f"WITH {CP} SELECT event_id, round(m, 4) AS magnitude FROM q WHERE i > 5 AND i <= n - 4 AND m > 1")
def _(t):
    return W.change_points(ev(t), K, O, V).select("event_id", rnd("magnitude", 4).alias("magnitude"))


@query("w19_linear_forecast", "WITH l AS (SELECT user_id, value AS y, -row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS x FROM events), f AS (SELECT user_id, coalesce(regr_slope(y, x), 0) AS s, regr_intercept(y, x) AS b, stddev_pop(y) AS sd FROM l WHERE x >= -50 GROUP BY user_id), e AS (SELECT user_id, unnest(range(1, 11)) AS step, s, b, sd FROM f) SELECT user_id, step::int AS step, round(s * (step - 1) + b, 4) AS forecast, round(s * (step - 1) + b + 1.96 * sd, 4) AS high, round(greatest(0.1, 0.9 - 0.05 * step), 5) AS confidence FROM e")
def _(t):
    return W.linear_forecast(ev(t), K, O, V).select("user_id", "step", rnd("forecast", 4).alias("forecast"), rnd("high", 4).alias("high"), rnd("confidence").alias("confidence"))


@query("w20_confidence_interval", "SELECT user_id, round(avg(value) - 1.96 * sqrt(var_pop(value) / count(*)), 4) AS low, round(avg(value) + 1.96 * sqrt(var_pop(value) / count(*)), 4) AS high FROM events GROUP BY user_id")
def _(t):
    return W.confidence_interval(t.events, K, V).select("user_id", rnd("low", 4).alias("low"), rnd("high", 4).alias("high"))


@query("w21_baseline_ema", f"WITH RECURSIVE {BASE}, r AS (SELECT user_id, event_id, i, (0.1 * x + 0.9 * 100)::double AS s FROM b WHERE i = 1 UNION ALL SELECT b.user_id, b.event_id, b.i, (0.1 * x + 0.9 * s)::double FROM r JOIN b ON b.user_id = r.user_id AND b.i = r.i + 1) SELECT event_id, round(s, 4) AS baseline FROM r")
def _(t):
    return W.ewma(ev(t), K, O, V, 0.1, seed=F.lit(100.0)).select("event_id", rnd("smoothed", 4).alias("baseline"))


@query("w22_detect_drift", f"WITH RECURSIVE {BASE}, r AS (SELECT user_id, event_id, i, x AS s FROM b WHERE i = 1 UNION ALL SELECT b.user_id, b.event_id, b.i, (0.1 * x + 0.9 * s)::double FROM r JOIN b ON b.user_id = r.user_id AND b.i = r.i + 1), m AS (SELECT *, abs(s - 50) / 50.001 AS m FROM r) SELECT event_id, round(m, 4) AS magnitude, CASE WHEN s > 50 THEN 'increase' WHEN s < 50 THEN 'decrease' ELSE 'stable' END AS direction, CASE WHEN m >= 1 THEN 'rollback' WHEN m >= 0.2 THEN 'adapt' ELSE 'monitor' END AS action FROM m")
def _(t):
    rows = W.ewma(ev(t), K, O, V, 0.1).withColumn("base", F.lit(50.0))
    return W.detect_drift(rows, K, "smoothed", "base").select("event_id", rnd("magnitude", 4).alias("magnitude"), "direction", "action")


@query("w23_adapt_baselines", f"WITH RECURSIVE {BASE}, r AS (SELECT user_id, event_id, i, x AS s FROM b WHERE i = 1 UNION ALL SELECT b.user_id, b.event_id, b.i, (CASE WHEN abs(x - s) / (abs(s) + 0.001) > 0.5 THEN s ELSE s + 0.1 * (x - s) END)::double FROM r JOIN b ON b.user_id = r.user_id AND b.i = r.i + 1) SELECT event_id, round(s, 4) AS baseline FROM r")
def _(t):
    return W.adapt_baselines(ev(t), K, O, V).select("event_id", rnd("baseline", 4).alias("baseline"))


STATS = "s AS (SELECT epoch_us(time_bucket(INTERVAL '1 hour', ts)) // 1000000 AS bucket, count(*) / 60 AS r, avg(duration_ms) AS l, avg((status_code >= 400)::int) AS e, sum(content_length)::double AS b FROM requests GROUP BY 1), d AS (SELECT *, abs(r - 0.2) / 0.2 AS dr, abs(l - 40) / 40 AS dl, e / 0.1 AS de, abs(b - r * 1024) / greatest(r * 1024, 1) AS db FROM s)"


@query("w24_traffic_anomalies", f"WITH {STATS}, a AS (SELECT *, greatest(CASE WHEN dr > 2 THEN least(dr / 2, 1) ELSE 0 END, CASE WHEN dl > 1.5 THEN least(dl / 1.5, 1) ELSE 0 END, CASE WHEN de > 3 THEN least(de / 3, 1) ELSE 0 END, CASE WHEN db > 2 THEN least(db / 2, 1) ELSE 0 END) AS sc FROM d) SELECT bucket, concat_ws(',', CASE WHEN dr > 2 THEN 'request_rate' END, CASE WHEN dl > 1.5 THEN 'response_time' END, CASE WHEN de > 3 THEN 'error_rate' END, CASE WHEN db > 2 THEN 'bandwidth' END) AS anomaly_types, round(least(1, sc * 0.6 + least(e * 5, 0.3) + least(l / 1000, 0.2)), 5) AS risk FROM a", "requests")
def _(t):
    out = W.traffic_anomalies(R.traffic_stats(t.requests, "1h"), F.lit(0.2), F.lit(40.0), F.lit(0.1))
    return out.select(F.unix_timestamp("bucket").alias("bucket"), "anomaly_types", rnd("risk").alias("risk"))


@query("w25_volume_anomalies", "WITH h AS (SELECT hour(ts) AS hour, count(*) AS n FROM events GROUP BY 1), z AS (SELECT *, abs(n - avg(n) OVER ()) / stddev_pop(n) OVER () AS z FROM h) SELECT hour, n, round(z, 5) AS z FROM z WHERE z > 1")
def _(t):
    return W.volume_anomalies(t.events, F.hour("ts"), 1.0).select(F.col("slot").alias("hour"), "n", rnd("z").alias("z"))


@query("w26_session_timing", "WITH g AS (SELECT event_id, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id)) / 1e6 AS gap FROM events) SELECT event_id, round(gap, 3) AS gap, coalesce(gap < 1, false) AS burst, coalesce(gap > 300, false) AS idle FROM g")
def _(t):
    return W.session_timing(t.events, "user_id", "ts", "event_id").select("event_id", rnd("gap", 3).alias("gap"), "burst", "idle")


@query("w27_series_insights", f"WITH {TA} SELECT count_if(ls > 0) * 1.0 / count(*) > 0.7 AS mostly_rising, count_if(sd > 50) * 1.0 / count(*) > 0.5 AS mostly_volatile, count(*) AS series FROM g")
def _(t):
    g = W.trend_analysis(ev(t), K, O, V)
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    return g.agg((share(F.col("long_slope") > 0) > 0.7).alias("mostly_rising"), (share(F.col("std") > 50) > 0.5).alias("mostly_volatile"), F.count(F.lit(1)).alias("series"))


@query(
    "w28_trend_patterns",
    f"WITH {CP}, f AS (SELECT *, i > 5 AND i <= n - 4 AND m > 1 AS flag FROM q), g AS (SELECT *, (flag AND NOT coalesce(lag(flag) OVER (PARTITION BY user_id ORDER BY i), false))::int AS nw FROM f), "
    "h AS (SELECT *, sum(nw) OVER (PARTITION BY user_id ORDER BY i) AS seg FROM g), s AS (SELECT user_id, seg, count(*) AS k, (max(epoch_us(ts)) - min(epoch_us(ts))) / 1e6 AS sec, coalesce(regr_slope(x, i), 0) AS sl, stddev_pop(x) AS sd, count_if(flag) AS c FROM h GROUP BY 1, 2), "
    "t AS (SELECT *, CASE WHEN k < 2 OR sd = 0 OR abs(sl) < sd * 0.1 THEN 'stable_pattern' WHEN sl > 0 THEN 'increasing_trend' ELSE 'decreasing_trend' END AS pattern FROM s), "
    "p AS (SELECT user_id, pattern, sum(sec) AS sec, sum(k) AS k, count(*) AS segs, sum(c) AS c FROM t GROUP BY 1, 2), w AS (SELECT *, CASE WHEN sum(sec) OVER u > 0 THEN sec / sum(sec) OVER u ELSE k / sum(k) OVER u END AS share FROM p WINDOW u AS (PARTITION BY user_id)), "
    "bb AS (SELECT user_id, arg_min(pattern, struct_pack(o := -round(share, 9), p := pattern)) AS pattern, arg_min(share, struct_pack(o := -round(share, 9), p := pattern)) AS share, sum(segs)::bigint AS segments, sum(c)::bigint AS change_points FROM w GROUP BY 1), "
    "hr AS (SELECT user_id, hour(ts) AS h, avg(x) AS a FROM b0 GROUP BY 1, 2), sn AS (SELECT user_id, CASE WHEN any_value(n) < 60 THEN 0 ELSE least(1, (sum(a * a) / 24 - pow(sum(a) / 24, 2)) / (any_value(v) + 0.001)) END AS st FROM hr JOIN (SELECT user_id, count(*) AS n, var_pop(x) AS v FROM b0 GROUP BY 1) USING (user_id) GROUP BY 1) "
    "SELECT user_id, CASE WHEN st > 0.3 AND st > share THEN 'seasonal_pattern' ELSE pattern END AS pattern, round(CASE WHEN st > 0.3 AND st > share THEN st ELSE share END, 4) AS share, segments, change_points, round(greatest(0, 1 - change_points / 10), 4)::double AS stability FROM bb JOIN sn USING (user_id)".replace("b0", "(SELECT user_id, ts, value AS x FROM events)"),
)
def _(t):
    p = W.trend_patterns(ev(t), K, O, V, "ts", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    return p.withColumn("share", rnd("share", 4)).withColumn("stability", rnd("stability", 4))


@query("w29_validate_series", fold(0.3) + ", d AS (SELECT *, abs(x - lag(x) OVER (PARTITION BY user_id ORDER BY i)) AS st FROM r), l AS (SELECT *, list(st) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN 8 PRECEDING AND CURRENT ROW) AS near FROM d), a AS (SELECT user_id, i, CASE WHEN i < 10 THEN 0.5 ELSE len(list_filter(near, lambda q: q <= sqrt(v))) / 9 END AS acc FROM l) SELECT user_id, max(i) >= 10 AS enough, round(arg_max(acc, i), 5) AS accuracy, max(i) >= 10 AND arg_max(acc, i) >= 0.7 AS valid FROM a GROUP BY user_id")
def _(t):
    f = W.ewma_forecast(ev(t), K, O, V, 0.3).groupBy("user_id").agg(F.max("n").alias("n"), F.max_by("accuracy", "n").alias("a"))
    return f.select("user_id", (F.col("n") >= 10).alias("enough"), rnd("a").alias("accuracy"), ((F.col("n") >= 10) & (F.col("a") >= 0.7)).alias("valid"))


@query("z04_ew_fold", f"WITH RECURSIVE {BASE}, r AS (SELECT user_id, i, x AS s FROM b WHERE i = 1 UNION ALL SELECT b.user_id, b.i, (0.2 * x + 0.8 * s)::double FROM r JOIN b ON b.user_id = r.user_id AND b.i = r.i + 1) SELECT user_id, max(i) AS n, round(arg_max(s, i), 5) AS value FROM r GROUP BY user_id")
def _(t):
    return W.ew_fold(ev(t), K, O, V, 0.2).select("user_id", "n", rnd("value").alias("value"))
