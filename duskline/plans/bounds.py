"""Queries: what draws, models and sketches must hold, as figures and flags that SQL can state."""

from __future__ import annotations

from pyspark.sql import functions as F

from duskline.operators import limits as L
from duskline.operators import ml as M
from duskline.streaming import streams as X

from .entities import feedback
from .registry import query, rnd
from .streamq import run

N = lambda: F.count(F.lit(1))


@query("b06_selection_quality", "SELECT country, count(*) AS decisions, true AS known, true AS better_than_chance FROM requests GROUP BY country", "requests")
def _(t):
    """Each decision gets an action of its context, and on the whole one of no lower expectation than a uniform choice.

    A mean of few decisions scatters, so it may fall short by three of its standard errors.
    """
    p = L.beta_posterior(feedback(t), ["country", "action"]).withColumn("expected", F.col("alpha") / (F.col("alpha") + F.col("beta")))
    chosen = L.select_actions(t.requests.select("request_id", "country"), p.select("country", "action", "alpha", "beta"), "country", "action", "request_id")
    got = chosen.join(p.select("country", F.col("action").alias("chosen"), "expected"), ["country", "chosen"], "left")
    chance = p.groupBy("country").agg(F.avg("expected").alias("chance"))
    g = got.groupBy("country").agg(N().alias("decisions"), F.bool_and(F.col("expected").isNotNull()).alias("known"), F.avg("expected").alias("mean"), F.stddev_pop("expected").alias("sd"))
    short = 3 * F.col("sd") / F.sqrt("decisions")
    return g.join(chance, "country").select("country", "decisions", "known", (F.col("mean") >= F.col("chance") - short).alias("better_than_chance"))


HELD = "WITH x AS (SELECT (duration_ms > 40 AND method = 'GET')::int AS label FROM requests), g AS (SELECT label, count(*) AS n FROM x GROUP BY 1) SELECT sum(n - floor(n * 0.8))::bigint AS held, true AS beats_majority FROM g"
COLS = ["duration", "is_get", "status"]


def held_out(t, train):
    """Rows kept from the training, and whether more of them are right than their majority class has."""
    r = t.requests.select(
        "request_id", (F.col("duration_ms") / 100).alias("duration"), (F.col("method") == "GET").cast("double").alias("is_get"), (F.col("status_code") / 500).alias("status"),
        ((F.col("duration_ms") > 40) & (F.col("method") == "GET")).cast("int").alias("label"),
    )
    s = M.stratified_split(r, "label", "request_id")
    out = train(s.filter("is_train")).transform(M.assemble(s.filter("NOT is_train"), COLS))
    share = F.avg("label")
    right = F.avg((F.col("prediction") == F.col("label")).cast("int"))
    return out.agg(N().alias("held"), (right > F.greatest(share, 1 - share)).alias("beats_majority"))


@query("e06_forest_held_out", HELD, "requests")
def _(t):
    return held_out(t, lambda rows: M.train_forest(rows, COLS, "label"))


@query("e07_mlp_held_out", HELD, "requests")
def _(t):
    return held_out(t, lambda rows: M.train_mlp(rows, COLS, "label", (16, 8), iterations=60))


@query("e08_isolation_order", "SELECT count(*) AS n, true AS in_range, true AS extremes_stand_out FROM requests", "requests")
def _(t):
    """Scores lie in 0..1, and rows beyond three deviations score higher on average than rows within one."""
    cols = ["duration_ms", "content_length"]
    r = t.requests.select("request_id", *cols)
    s = M.isolation_score(r, M.train_isolation(r, cols, "request_id"), cols)
    z = M.standard_scale(s.withColumn("z", F.col("duration_ms")), ["z"]).withColumn("z", F.abs("z"))
    far, near = F.avg(F.when(F.col("z") > 3, F.col("anomaly_score"))), F.avg(F.when(F.col("z") < 1, F.col("anomaly_score")))
    return z.agg(N().alias("n"), F.bool_and(F.col("anomaly_score").between(0, 1)).alias("in_range"), F.coalesce(far > near, F.lit(True)).alias("extremes_stand_out"))


# the mean squared error left by two of three components is the least eigenvalue of the correlations, in closed form
EIGEN = "WITH c AS (SELECT count(*) AS n, corr(duration_ms, parity) AS a, corr(duration_ms, user_id) AS b, corr(parity, user_id) AS c FROM requests), p AS (SELECT *, sqrt((a * a + b * b + c * c) / 3) AS p FROM c) SELECT n, n - 1 - floor((n - 1) * 0.95::double)::bigint AS anomalies, round(1 + 2 * p * cos(acos(greatest(-1, least(1, a * b * c / (p * p * p)))) / 3 + 2 * pi() / 3), 5) AS mean_error FROM p"


@query("e11_reconstruction_error", EIGEN, "requests")
def _(t):
    r = t.requests.select("request_id", "duration_ms", F.col("parity").cast("double").alias("parity"), F.col("user_id").cast("double").alias("user_id"))
    out = M.reconstruction_anomalies(r, ["duration_ms", "parity", "user_id"], 2)
    return out.agg(N().alias("n"), F.count_if("is_anomaly").alias("anomalies"), rnd(F.avg("error")).alias("mean_error"))


@query("x09_visitors_within_bound", "SELECT epoch_us(time_bucket(INTERVAL '1 day', ts)) // 1000000 AS start, count(DISTINCT user_id) AS visitors, true AS within FROM events GROUP BY 1")
def _(t):
    """The stream's estimates against the exact counts: within three of its standard errors of 2 %, and one."""
    e = run(t, lambda s: X.stream_visitors(s, "user_id")).select(F.unix_timestamp("start").alias("start"), F.col("visitors").alias("estimate"))
    day = F.unix_timestamp(F.date_trunc("day", "ts"))
    truth = t.events.groupBy(day.alias("start")).agg(F.count_distinct("user_id").alias("visitors"))
    n = F.col("visitors")
    return truth.join(e, "start", "left").select("start", "visitors", (F.abs(F.col("estimate") - n) <= 0.06 * n + 1).alias("within"))
