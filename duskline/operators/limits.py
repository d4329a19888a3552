"""Rate-limit replay per key, limit policies and their analytics; feedback learning."""

from __future__ import annotations

from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .running import running_sums

FEEDBACK = {"true_positive": 0.30, "false_positive": -0.25, "user_satisfied": 0.15, "user_unsatisfied": -0.075, "cost_low": 0.10, "cost_high": -0.05, "threat_reduced": 0.20, "threat_persisted": -0.20}
DECISION = "request_id long, key string, allowed boolean, remaining long"


class _Limiter:
    """The state of one key's limiter: times of allowed requests within the window, tokens, last request."""

    def __init__(self, algorithm: str, limit: int, window_us: int, rate: float):
        self.slides, self.fills = algorithm != "token_bucket", algorithm != "sliding"
        self.limit, self.window_us, self.rate = limit, window_us, rate
        self.kept: deque[int] = deque()
        self.tokens, self.last = limit, None

    def decide(self, t: int) -> tuple[bool, int]:
        """Only allowed requests count in the window; whole tokens are refilled at each request, up to the limit."""
        left = self.limit
        if self.slides:
            while self.kept and self.kept[0] < t - self.window_us:
                self.kept.popleft()
            left = self.limit - len(self.kept)
        if self.fills:
            if self.last is not None:
                self.tokens = min(self.limit, self.tokens + int((t - self.last) * self.rate // 1_000_000))
            self.last = t
            left = min(left, self.tokens)
        ok = left >= 1
        if ok:
            if self.slides:
                self.kept.append(t)
            self.tokens -= 1
        return ok, max(0, left - ok)


def replay(df: DataFrame, key: str, algorithm: str, limit: int, window_seconds: int = 3600, rate: float = 0.001, ts: str = "ts") -> DataFrame:
    """Replay a limiter (sliding, token_bucket or hybrid: both must allow) over the requests of each key, in time order.

    Each decision depends on those before it, so a key's requests follow one another: rows are dealt by key, sorted
    inside the partitions, and streamed through a fold that holds one limiter at a time, of at most ``limit`` times.
    However hot a key, no task holds its rows.
    """
    rows = df.select(
        F.col("request_id").cast("long").alias("request_id"), F.col(key).cast("string").alias("key"),
        F.unix_micros(F.col(ts).cast("timestamp")).alias("us"),
    )
    rows = rows.repartition("key").sortWithinPartitions("key", "us", "request_id")

    def run(batches):
        current, limiter = object(), None
        for pdf in batches:
            allowed, remaining = [], []
            for k, t in zip(pdf["key"], pdf["us"].tolist()):
                if k != current:
                    current, limiter = k, _Limiter(algorithm, limit, window_seconds * 1_000_000, rate)
                ok, left = limiter.decide(t)
                allowed.append(ok)
                remaining.append(left)
            yield pd.DataFrame({"request_id": pdf["request_id"], "key": pdf["key"], "allowed": allowed, "remaining": remaining})

    return rows.mapInPandas(run, DECISION)


THREAT_FACTOR = {"low": 1.2, "medium": 0.8, "high": 0.5, "critical": 0.2}


def effective_limit(base: Column, threat: Column, trust: Column, zone: Column, pattern: Column) -> Column:
    """Base limit times threat, trust, zone and time factors, rounded down, 1 at least."""
    t = F.create_map(*[F.lit(x) for kv in THREAT_FACTOR.items() for x in kv])[threat]
    g = F.when(zone == "high_risk", 0.5).when(zone == "safe", 1.2).otherwise(1.0)
    p = F.when(pattern == "peak_hours", 0.9).when(pattern == "weekend", 1.1).otherwise(1.0)
    # rounded first, so that a whole number is not missed by the last bit of a double
    return F.greatest(F.lit(1), F.floor(F.round(base * F.coalesce(t, F.lit(1.0)) * (0.5 + trust) * g * p, 6)))


def limit_metrics(df: DataFrame, by: str, ts: str = "ts") -> DataFrame:
    """Per hour and group: requests, violations and their rate, latency, effectiveness."""
    bad = F.count_if(F.col("status_code") >= 400)
    g = df.groupBy(F.date_trunc("hour", ts).alias("bucket"), by).agg(
        F.count(F.lit(1)).alias("requests"), bad.alias("violations"), F.avg("duration_ms").alias("latency"), F.count_if(F.col("status_code") == 403).alias("blocked")
    )
    g = g.withColumn("violation_rate", F.col("violations") / F.col("requests"))
    return g.withColumn("effectiveness", F.coalesce(F.try_divide("blocked", "violations"), F.lit(1.0)))


def feedback_reward(df: DataFrame, signals: str = "signals") -> DataFrame:
    weights = F.create_map(*[F.lit(x) for kv in FEEDBACK.items() for x in kv])
    total = F.aggregate(F.transform(signals, lambda s: F.coalesce(weights[s], F.lit(0.0))), F.lit(0.0), lambda a, x: a + x)
    return df.withColumn("reward", F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)))


def auto_signals(threat: Column, action: Column, subsequent: Column, completed: Column) -> Column:
    quiet = action.isin("allow", "monitor")
    pick = lambda c, a, b: F.when(c, F.lit(a)).otherwise(F.lit(b))
    return F.array_compact(F.array(
        F.when((threat > 0.7) & (action != "allow"), F.lit("true_positive")), F.when((threat <= 0.3) & (action != "allow"), F.lit("false_positive")),
        pick(completed, "user_satisfied", "user_unsatisfied"), pick(quiet, "cost_low", "cost_high"), pick(~subsequent, "threat_reduced", "threat_persisted"),
    ))


def outcome_reward(blocked: Column, impact: Column, missed: Column) -> Column:
    return F.when(missed, -2).when(impact, -1).when(blocked, 1).otherwise(0)


def beta_posterior(feedback: DataFrame, keys: list[str], reward: str = "reward", alpha: float = 1, beta: float = 1) -> DataFrame:
    """Beta parameters per context and action: rewards of 0.5 at least are successes."""
    win = F.count_if(F.col(reward) >= 0.5)
    n = F.count(F.lit(1))
    return feedback.groupBy(*keys).agg((win + alpha).alias("alpha"), (n - win + beta).alias("beta"), n.alias("selections"), F.sum(reward).alias("reward_sum"))


def bandit_stats(posterior: DataFrame, context: str, action: str, least: int = 10) -> DataFrame:
    p = posterior.withColumn("expected", F.col("alpha") / (F.col("alpha") + F.col("beta")))
    return p.groupBy(context).agg(
        F.max_by(action, F.struct("expected", action)).alias("best"), F.max("expected").alias("expected"), F.bool_and(F.col("selections") >= least).alias("enough")
    )


def _uniforms(key: np.ndarray, seed: int, stream: int) -> np.ndarray:
    """A uniform in (0, 1) for each key, by a 64-bit mix of the key, the seed and the number of the draw."""
    x = key.astype(np.int64).view(np.uint64) ^ np.uint64((seed * 0x9E3779B97F4A7C15 + stream * 0xD1B54A32D192ED03) & 0xFFFFFFFFFFFFFFFF)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 0x9E3779B97F4A7C15)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    x ^= x >> np.uint64(32)
    return ((x >> np.uint64(11)).astype(float) + 0.5) / 2.0**53


def _gamma(shape: np.ndarray, key: np.ndarray, seed: int, stream: int) -> np.ndarray:
    """Logarithms of gamma draws by squeezed rejection, all rows at once; each round only those not yet accepted."""
    a = np.where(shape < 1, shape + 1, shape)
    d = a - 1 / 3
    c = 1 / np.sqrt(9 * d)
    out, left = np.zeros(len(a)), np.arange(len(a))
    while len(left):
        k = key[left]
        u, v, w = (_uniforms(k, seed, stream + i) for i in range(3))
        stream += 4
        x = np.sqrt(-2 * np.log(u)) * np.cos(2 * np.pi * v)
        base = 1 + c[left] * x
        cube = np.maximum(base, 1e-300) ** 3
        ok = (base > 0) & (np.log(w) < 0.5 * x * x + d[left] * (1 - cube + 3 * np.log(np.maximum(base, 1e-300))))
        out[left[ok]] = np.log(d[left[ok]]) + np.log(cube[ok])
        left = left[~ok]
    small = shape < 1
    if small.any():
        out[small] += np.log(_uniforms(key[small], seed, stream + 3)) / shape[small]
    return out


def beta_draw(seed: int = 7):
    """An Arrow UDF (alpha, beta, key) -> one draw, the same for the same key and seed, however rows are batched.

    Two gamma draws from hashed uniforms. Null, if the key is null or a parameter is null or not above 0.
    """

    @F.pandas_udf("double")
    def draw(alpha: pd.Series, beta: pd.Series, key: pd.Series) -> pd.Series:
        a, b = alpha.to_numpy(float), beta.to_numpy(float)
        out = np.full(len(a), np.nan)
        ok = (a > 0) & (b > 0) & np.isfinite(a) & np.isfinite(b) & key.notna().to_numpy()
        k = key[ok].to_numpy().astype(np.int64)
        out[ok] = 1 / (1 + np.exp(np.clip(_gamma(b[ok], k, seed, 1 << 40) - _gamma(a[ok], k, seed, 0), -700, 700)))
        return pd.Series(out).astype(object).where(ok, None).astype("Float64")

    return draw


def select_actions(decisions: DataFrame, posterior: DataFrame, context: str, action: str, key: str, seed: int = 7) -> DataFrame:
    """Thompson selection: for each decision the action of its context with the greatest draw."""
    options = decisions.join(posterior, context)
    drawn = options.withColumn("draw", beta_draw(seed)("alpha", "beta", F.xxhash64(key, action)))
    return drawn.groupBy(key, context).agg(F.max_by(action, F.struct("draw", action)).alias("chosen"))


def limit_advice(threat: Column, abnormal: Column, emergency: bool = False, block_from: float = 0.9, limit_from: float = 0.7) -> dict[str, Column]:
    """Columns ``action`` (allow, monitor, limit, block), ``factor`` of the limit, and ``confidence``."""
    band = lambda a, b, c, d, e: F.when(threat >= block_from, a).when(threat >= limit_from, b).when(threat >= 0.5, c).when(threat >= 0.3, d).otherwise(e)
    action = band("block", "limit", "limit", "monitor", "allow")
    factor = band(0.1, 0.3, 0.6, 0.8, 1.0)
    sure = band(0.95, 0.9, 0.8, 0.7, 0.8)
    if emergency:
        action = F.when(threat > 0.5, "block").otherwise("limit")
        factor, sure = F.least(factor, F.lit(0.2)), F.least(sure + 0.1, F.lit(1.0))
    odd = F.coalesce(abnormal, F.lit(False))
    return {"action": action, "factor": factor * F.when(odd, 0.5).otherwise(1.0), "confidence": F.when(odd, F.least(sure + 0.1, F.lit(1.0))).otherwise(sure)}


def limit_violations(df: DataFrame, bad: Column, key: str = "ip", threat: str = "severity", ts: str = "ts", tie: str = "request_id") -> DataFrame:
    """Violations with their running number per key and severity: by threat level or by number over 2, 5 and 10."""
    out = running_sums(df.filter(bad), key, [ts, tie], {"nth": F.lit(1)}, F.date_trunc("day", ts))
    n, t = F.col("nth"), F.col(threat)
    level = F.when((t == "critical") | (n > 10), "critical").when((t == "high") | (n > 5), "high").when((t == "medium") | (n > 2), "medium")
    return out.withColumn("violation_severity", level.otherwise("low"))


def limit_trend(df: DataFrame, as_of: str, ts: str = "ts", hours: int = 6) -> DataFrame:
    """Mean hourly effectiveness of the last hours against the ones before, and the trend (5 % either way is stable).

    Effectiveness of an hour: 0.7 x twice the violation rate (1 at most) + 0.3 x (1 - latency / 50), the latter 0 at least.
    """
    end = F.lit(as_of).cast(df.schema[ts].dataType)
    back = lambda h: end - F.expr(f"INTERVAL {h} HOUR")
    late = df.filter((F.col(ts) >= back(2 * hours)) & (F.col(ts) < end))
    g = late.groupBy(F.date_trunc("hour", ts).alias("_h")).agg(
        F.avg((F.col("status_code") >= 400).cast("int")).alias("_v"), F.avg("duration_ms").alias("_l")
    )
    score = F.least(F.col("_v") * 2, F.lit(1.0)) * 0.7 + F.greatest(F.lit(0.0), 1 - F.col("_l") / 50) * 0.3
    new = F.col("_h") >= back(hours)
    out = g.agg(F.avg(F.when(new, score)).alias("recent"), F.avg(F.when(~new, score)).alias("before"))
    change = F.try_divide(F.col("recent") - F.col("before"), F.col("before"))
    return out.withColumn("trend", F.when(change > 0.05, "improving").when(change < -0.05, "degrading").otherwise("stable"))


def decision_context(threat: Column, reputation: Column) -> Column:
    """``low``, ``medium`` or ``high`` threat and ``suspicious``, ``unknown`` or ``trusted`` reputation as one key."""
    a = F.when(threat <= 0.3, "low").when(threat <= 0.7, "medium").otherwise("high")
    return F.concat_ws(":", a, F.when(reputation <= 0.4, "suspicious").when(reputation <= 0.7, "unknown").otherwise("trusted"))


# Actions from mild to severe, and what each outcome is worth.
BANDIT_ACTIONS = ("allow", "monitor", "challenge", "block", "isolate")
IMMEDIATE = {"true_positive": 0.30, "user_satisfaction": 0.15, "resource_cost": 0.10, "threat_reduction": 0.20}


def immediate_reward(action: Column, threat: Column, executed: Column) -> Column:
    """Reward known at once: severe action on a threat, no action without one, cost, and what is left of the threat."""
    place = F.create_map(*[F.lit(x) for i, a in enumerate(BANDIT_ACTIONS) for x in (a, i / (len(BANDIT_ACTIONS) - 1))])[action]
    p = lambda c, n: F.when(c, IMMEDIATE[n]).otherwise(0.0)
    total = (
        p((threat > 0.7) & (place >= 0.5), "true_positive") + p((threat <= 0.3) & (action == "allow"), "user_satisfaction")
        + p(action == "allow", "resource_cost") + IMMEDIATE["threat_reduction"] * (1 - place)
    )
    return F.when(executed, F.coalesce(total, F.lit(0.0))).otherwise(0.0)


def bandit_history(df: DataFrame, context: str, reward: str, exploited: Column, best: Column, ts: str = "ts", tie: str = "request_id") -> DataFrame:
    """Per decision: cumulative reward, exploitation rate and regret (against ``best``) of its context up to it."""
    sums = {"cumulative": F.col(reward), "_exploited": exploited.cast("long"), "_decisions": F.lit(1), "regret": best - F.col(reward)}
    out = running_sums(df, context, [ts, tie], sums, F.date_trunc("day", ts))
    return out.withColumn("exploitation_rate", F.col("_exploited") / F.col("_decisions")).drop("_exploited", "_decisions")
