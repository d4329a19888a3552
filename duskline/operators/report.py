"""Time-range reporting: buckets, measurements, trends, summaries, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UNITS = {"m": "minutes", "h": "hours", "d": "days", "w": "weeks"}


def time_bucket(ts: Column | str, every: str) -> Column:
    """Start of the bucket of ``1m 5m 15m 1h 6h 1d 1w 1M``; weeks start on Monday."""
    col = F.col(ts) if isinstance(ts, str) else ts
    if every == "1M":
        return F.date_trunc("month", col)
    if every == "1w":
        return F.date_trunc("week", col)
    return F.window(col, f"{every[:-1]} {UNITS[every[-1]]}")["start"]


def query_points(df, start=None, end=None, tags=None, fields=None, order=None, limit=None, offset=None, ts="ts"):
    """Rows of a time range with equal tags, selected fields, order and page."""
    if start is not None:
        df = df.filter(F.col(ts) >= F.lit(start).cast(df.schema[ts].dataType))
    if end is not None:
        df = df.filter(F.col(ts) < F.lit(end).cast(df.schema[ts].dataType))
    for k, v in (tags or {}).items():
        df = df.filter(F.col(k) == v)
    if fields:
        df = df.select(*fields)
    if order:
        df = df.orderBy(*order)
    if offset:
        df = df.offset(offset)
    return df.limit(limit) if limit else df


def aggregate_points(df: DataFrame, fn: str, field: str, pct: float = 0.95, every: str | None = None, group_by=(), ts="ts"):
    """mean, sum, count, min, max, median or percentile of a field, per bucket and group."""
    col = F.col(field)
    agg = {
        "mean": F.avg(col), "sum": F.sum(col), "count": F.count(col), "min": F.min(col), "max": F.max(col),
        "median": F.median(col), "percentile": F.percentile(col, pct),
    }[fn]
    keys = [*([time_bucket(ts, every).alias("bucket")] if every else []), *group_by]
    return df.groupBy(*keys).agg(agg.alias("value"))


def fill_gaps(df: DataFrame, every: str, how: str, key: str, bucket: str = "bucket", value: str = "value") -> DataFrame:
    """A row for every bucket between a key's first and last; the value is none, null, previous, linear or zero."""
    if how == "none":
        return df
    step = F.expr(f"INTERVAL {every[:-1]} {UNITS[every[-1]].upper().rstrip('S')}")
    spine = df.groupBy(key).agg(F.explode(F.sequence(F.min(bucket), F.max(bucket), step)).alias(bucket))
    out = spine.join(df, [key, bucket], "left")
    if how == "zero":
        return out.withColumn(value, F.coalesce(value, F.lit(0.0)))
    before = Window.partitionBy(key).orderBy(bucket).rowsBetween(Window.unboundedPreceding, 0)
    if how == "previous":
        return out.withColumn(value, F.last(value, ignorenulls=True).over(before))
    if how == "linear":
        after = Window.partitionBy(key).orderBy(bucket).rowsBetween(0, Window.unboundedFollowing)
        at = F.unix_timestamp(bucket)
        known = F.when(F.col(value).isNotNull(), at)
        out = (
            out.withColumn("_a", F.last(value, ignorenulls=True).over(before))
            .withColumn("_b", F.first(value, ignorenulls=True).over(after))
            .withColumn("_ta", F.last(known, ignorenulls=True).over(before))
            .withColumn("_tb", F.first(known, ignorenulls=True).over(after))
        )
        slope = (F.col("_b") - F.col("_a")) / (F.col("_tb") - F.col("_ta"))
        line = F.when(F.col("_tb") == F.col("_ta"), F.col("_a")).otherwise(F.col("_a") + slope * (at - F.col("_ta")))
        return out.withColumn(value, line).drop("_a", "_b", "_ta", "_tb")
    return out


def response_time_report(df, every="1h", endpoint="path", value="duration_ms", ts="ts"):
    p = F.percentile(value, [0.95, 0.99])
    out = df.groupBy(time_bucket(ts, every).alias("bucket"), endpoint).agg(F.avg(value).alias("mean"), p.alias("_p"))
    return out.withColumn("p95", F.col("_p")[0]).withColumn("p99", F.col("_p")[1]).drop("_p")


def throughput_report(df, every="1h", ts="ts"):
    return df.groupBy(time_bucket(ts, every).alias("bucket")).agg(F.count(F.lit(1)).alias("requests"))


def error_rate_report(df, every="1h", error: Column | None = None, ts="ts"):
    err = F.sum(F.when(error if error is not None else F.col("status_code") >= 400, 1).otherwise(0))
    return df.groupBy(time_bucket(ts, every).alias("bucket")).agg((F.try_divide(err, F.count(F.lit(1))) * 100).alias("error_rate"))


def top_endpoints(df, k=10, endpoint="path", value="duration_ms"):
    return df.groupBy(endpoint).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean")).orderBy(F.desc("n"), endpoint).limit(k)


def top_with_share(df: DataFrame, by: str, k: int) -> DataFrame:
    """Top groups with their percentage of all rows."""
    counts = df.groupBy(by).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    shares = counts.crossJoin(F.broadcast(total)).withColumn("share", F.col("n") * 100.0 / F.col("total"))
    return shares.drop("total").orderBy(F.desc("n"), by).limit(k)


def series_trend(df: DataFrame, keys: list[str], value: str, order: list[str]) -> DataFrame:
    """Per key: mean, nearest-rank median and p95, extremes, second half against first half in percent, trend class."""
    ordered = Window.partitionBy(*keys).orderBy(*order)
    ranked = Window.partitionBy(*keys).orderBy(value, *order)
    whole = Window.partitionBy(*keys)
    rows = (
        df.withColumn("_n", F.count(F.lit(1)).over(whole))
        .withColumn("_i", F.row_number().over(ordered) - 1)
        .withColumn("_r", F.row_number().over(ranked) - 1)
    )
    half = F.floor(F.col("_n") / 2)
    out = rows.groupBy(*keys).agg(
        F.avg(value).alias("average"),
        F.max(F.when(F.col("_r") == half, F.col(value))).alias("median"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
        F.max(F.when(F.col("_r") == F.floor(F.col("_n") * 0.95), F.col(value))).alias("p95"),
        F.count(F.lit(1)).alias("points"),
        F.avg(F.when(F.col("_i") < half, F.col(value))).alias("_a"),
        F.avg(F.when(F.col("_i") >= half, F.col(value))).alias("_b"),
    )
    rate = F.when(F.col("_a") > 0, (F.col("_b") - F.col("_a")) / F.col("_a") * 100).otherwise(0.0)
    out = out.withColumn("change_rate", rate).drop("_a", "_b")
    c = F.col("change_rate")
    trend = F.when(c > 10, "increasing").when(c < -10, "decreasing").when(F.abs(c) > 5, "volatile").otherwise("stable")
    return out.withColumn("trend", trend)


def last_by(df: DataFrame, key: str, field: str, ts: str = "ts") -> DataFrame:
    return df.groupBy(key).agg(F.max_by(field, ts).alias(field))


def recent(df: DataFrame, minutes: int, as_of: str, limit: int = 1000, ts: str = "ts", tie: str = "request_id"):
    end = F.lit(as_of).cast("timestamp_ntz")
    start = end - F.expr(f"INTERVAL {minutes} MINUTE")
    return df.filter((F.col(ts) >= start) & (F.col(ts) <= end)).orderBy(F.desc(ts), tie).limit(limit)


def traffic_stats(df: DataFrame, every: str, ts: str = "ts") -> DataFrame:
    """Per window: requests, per minute, distinct addresses and agents, mean latency, error rate, bytes."""
    minutes = int(every[:-1]) * {"m": 1, "h": 60, "d": 1440}[every[-1]]
    n = F.count(F.lit(1))
    return df.groupBy(time_bucket(ts, every).alias("bucket")).agg(
        n.alias("requests"),
        (n / minutes).alias("requests_per_minute"),
        F.count_distinct("ip").alias("unique_ips"),
        F.count_distinct("user_agent").alias("unique_agents"),
        F.avg("duration_ms").alias("mean_latency"),
        (F.sum(F.when(F.col("status_code") >= 400, 1).otherwise(0)) / n).alias("error_rate"),
        F.sum("content_length").alias("bytes"),
    )


def classification_metrics(df: DataFrame, pred: str, label: str) -> DataFrame:
    """Confusion counts with accuracy, precision, recall, F1 and false-positive rate (0 where undefined)."""
    hit = lambda p, y: F.count_if((F.col(pred) == p) & (F.col(label) == y))
    c = df.agg(hit(1, 1).alias("tp"), hit(1, 0).alias("fp"), hit(0, 0).alias("tn"), hit(0, 1).alias("fn"))
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    tp, fp, tn, fn = (F.col(x) for x in ("tp", "fp", "tn", "fn"))
    out = c.withColumn("accuracy", ratio(tp + tn, tp + fp + tn + fn)).withColumn("precision", ratio(tp, tp + fp))
    out = out.withColumn("recall", ratio(tp, tp + fn)).withColumn("fpr", ratio(fp, fp + tn))
    return out.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def latency_percentiles(df: DataFrame, key: str, value: str) -> DataFrame:
    """Nearest-rank p50, p95 and p99 per key: the value of rank ceil(p n)."""
    w = Window.partitionBy(key)
    rows = df.withColumn("_n", F.count(F.lit(1)).over(w)).withColumn("_r", F.row_number().over(w.orderBy(value)))
    at = lambda p: F.max(F.when(F.col("_r") == F.greatest(F.ceil(F.col("_n") * p), F.lit(1)), F.col(value)))
    return rows.groupBy(key).agg(at(0.50).alias("p50"), at(0.95).alias("p95"), at(0.99).alias("p99"))


def health_score(p95_insert: Column, p95_query: Column, error_rate: Column, accuracy: Column, growth: Column) -> Column:
    """100 minus penalties: 20 latency, 30 errors, 25 accuracy, 15 growth."""
    return (
        F.lit(100)
        - F.when((p95_insert > 10000) | (p95_query > 5000), 20).otherwise(0)
        - F.when(error_rate > 0.01, 30).otherwise(0)
        - F.when(accuracy < 0.8, 25).otherwise(0)
        - F.when(growth > 0.1, 15).otherwise(0)
    )


def histogram(df: DataFrame, value: str, low: float, high: float, n: int) -> DataFrame:
    return df.groupBy(F.width_bucket(value, F.lit(low), F.lit(high), F.lit(n)).cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def fit_baseline(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    p = F.percentile(value, [0.25, 0.5, 0.75, 0.95])
    out = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.min(value).alias("min"),
        F.max(value).alias("max"), p.alias("_p"), F.skewness(value).alias("skew"), F.kurtosis(value).alias("kurt"),
    )
    for i, name in enumerate(("p25", "median", "p75", "p95")):
        out = out.withColumn(name, F.col("_p")[i])
    return out.drop("_p")


def assemble_flows(packets: DataFrame, keys: list[str], ts: str, timeout: int, size: str = "bytes", tie: str = "conn_id"):
    """Flows per key: a gap of more than ``timeout`` seconds starts a new one."""
    w = Window.partitionBy(*keys).orderBy(ts, tie)
    at = F.unix_timestamp(ts)
    gap = at - F.lag(at).over(w)
    rows = packets.withColumn("_gap", gap).withColumn("flow", F.sum(F.when(gap > timeout, 1).otherwise(0)).over(w))
    inner = F.when(F.col("_gap") <= timeout, F.col("_gap"))
    return rows.groupBy(*keys, "flow").agg(
        F.count(F.lit(1)).alias("packets"), F.sum(size).alias("bytes"), F.avg(size).alias("mean_size"),
        (F.max(at) - F.min(at)).alias("duration"), F.avg(inner).alias("mean_gap"),
    )


RETENTION_DAYS = {"threat": 30, "performance": 7, "behavior": 365, "health": 5 * 365, "rate": 2 * 365}


def apply_retention(df: DataFrame, days: int, as_of: str, ts: str = "ts") -> tuple[DataFrame, DataFrame]:
    """(kept, expired) by the cutoff ``as_of - days``."""
    cutoff = F.lit(as_of).cast("timestamp_ntz") - F.expr(f"INTERVAL {days} DAY")
    return df.filter(F.col(ts) >= cutoff), df.filter(F.col(ts) < cutoff)


def archive_expired(expired: DataFrame, path: str, ts: str = "ts") -> None:
    expired.withColumn("date", F.to_date(ts)).write.mode("append").partitionBy("date").parquet(path)


def rollup_points(df: DataFrame, unit: str, keys: list[str], value: str, ts: str = "ts") -> DataFrame:
    """Sum, count, least and greatest per unit, so that roll-ups can be rolled up again."""
    first = "value_sum" not in df.columns
    s, n, lo, hi = (value, None, value, value) if first else ("value_sum", "value_count", "value_min", "value_max")
    return df.groupBy(F.date_trunc(unit, ts).alias(ts), *keys).agg(
        F.sum(s).alias("value_sum"), (F.count(F.lit(1)) if first else F.sum(n)).alias("value_count"),
        F.min(lo).alias("value_min"), F.max(hi).alias("value_max"),
    )


# --- sessions, traffic and inventories ----------------------------------------------------------


def _n() -> Column:
    return F.count(F.lit(1))


def session_table(df: DataFrame, kind: str, converted: Column, ts: str = "ts") -> DataFrame:
    """(session_id, start, n, duration, converted, kind): one row per session; duration in seconds."""
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    return df.groupBy("session_id").agg(
        F.min(ts).alias("start"), _n().alias("n"), ((F.max(us) - F.min(us)) / 1e6).alias("duration"),
        F.max(converted.cast("int")).alias("converted"), F.min(kind).alias("kind"),
    )


def session_metrics(sessions: DataFrame, every: str) -> DataFrame:
    """Mean duration and total actions of the sessions that start in each bucket."""
    g = sessions.groupBy(time_bucket("start", every).alias("bucket"))
    return g.agg(F.avg("duration").alias("avg_duration"), F.sum("n").alias("total_views"))


def conversion_trend(sessions: DataFrame, every: str) -> DataFrame:
    """Share of converted sessions per bucket."""
    return sessions.groupBy(time_bucket("start", every).alias("bucket")).agg(F.avg("converted").alias("avg_conversion_rate"))


def user_type_mix(sessions: DataFrame) -> DataFrame:
    """Sessions and mean duration per kind of user."""
    return sessions.groupBy("kind").agg(_n().alias("user_count"), F.avg("duration").alias("avg_duration"))


def geo_distribution(df: DataFrame, by: str = "country", k: int = 20) -> DataFrame:
    return df.groupBy(by).agg(_n().alias("n"), F.avg("risk_score").alias("mean")).orderBy(F.desc("n"), by).limit(k)


def traffic_basic(df: DataFrame) -> DataFrame:
    """Connections, bytes, packets, distinct ends and the time range of a table of connections."""
    return df.agg(
        _n().alias("connections"), F.sum("bytes").alias("bytes"), F.sum("packets").alias("packets"), F.avg("bytes").alias("mean_bytes"),
        F.count_distinct("source").alias("sources"), F.count_distinct("destination").alias("destinations"),
        F.min("ts").alias("first"), F.max("ts").alias("last"),
    )


def temporal_profile(df: DataFrame, ts: str = "ts") -> DataFrame:
    """(unit, slot, n, peak): rows by hour, weekday and day of the month; ``peak`` marks the busiest slot of a unit."""
    slots = {"hour": F.hour(ts), "weekday": F.weekday(ts), "day": F.dayofmonth(ts)}
    pairs = F.array(*[F.struct(F.lit(u).alias("unit"), c.cast("long").alias("slot")) for u, c in slots.items()])
    counts = df.select(F.explode(pairs).alias("s")).groupBy("s.unit", "s.slot").agg(_n().alias("n"))
    first = F.row_number().over(Window.partitionBy("unit").orderBy(F.desc("n"), "slot"))  # 24, 7 and 31 rows
    return counts.withColumn("peak", first == 1)


def flow_counts(df: DataFrame, keys=("protocol", "source", "destination")) -> DataFrame:
    """Rows per value of each key; the other keys are null."""
    return df.groupingSets([[k] for k in keys], *keys).agg(_n().alias("n"))


def graph_stats(edges: DataFrame) -> DataFrame:
    """Edges per type and in total (null)."""
    return edges.rollup("type").agg(_n().alias("n"))


def alert_summary(df: DataFrame, *by: str) -> DataFrame:
    """Counts over all combinations of the columns ``by``."""
    return df.cube(*by).agg(_n().alias("n"))


def rolling_summary(df: DataFrame, minutes: int, as_of: str, key: str, value: str, ts: str = "ts", tie: str = "request_id") -> DataFrame:
    """Per key over the last minutes: mean, extremes, and the relative change from the first value to the last."""
    end = F.lit(as_of).cast(df.schema[ts].dataType)
    late = df.filter((F.col(ts) <= end) & (F.col(ts) >= end - F.expr(f"INTERVAL {minutes} MINUTE")))
    at = F.struct(ts, tie)
    first, last = F.min_by(value, at), F.max_by(value, at)
    return late.groupBy(key).agg(
        F.avg(value).alias("mean"), F.max(value).alias("max"), F.min(value).alias("min"), F.try_divide(last - first, first).alias("trend")
    )


def adaptation_stats(df: DataFrame, key: str, success: Column, confidence: str, order: str) -> DataFrame:
    """Per key: adaptations, successful ones, mean confidence and the latest."""
    return df.groupBy(key).agg(
        _n().alias("total"), F.count_if(success).alias("successes"), F.avg(confidence).alias("mean_confidence"), F.max(order).alias("last_id")
    )


def detection_summary(df: DataFrame, kind: str = "event_type", severity: str = "severity", confidence: str = "risk_score") -> DataFrame:
    """Detections and mean confidence by type, by severity, and in all."""
    return df.groupingSets([[kind], [severity], []], kind, severity).agg(_n().alias("n"), F.avg(confidence).alias("confidence"))


def deception_stats(requests: DataFrame, traps: DataFrame, path: str = "path", key: str = "request_id") -> DataFrame:
    """Accesses per trap path, zero for those never touched."""
    hits = requests.groupBy(F.col(path).alias("trap_path")).agg(F.count(key).alias("_n"))
    return traps.join(hits, "trap_path", "left").withColumn("accesses", F.coalesce("_n", F.lit(0))).drop("_n")


def feedback_stats(df: DataFrame, signals: Column, action: str, actions: list[str]) -> DataFrame:
    """Rows per signal (of an array) and action, one column per action."""
    rows = df.select(action, F.explode(signals).alias("signal"))
    return rows.groupBy("signal").agg(*[F.count_if(F.col(action) == a).alias(a) for a in actions])


def rule_stats(rules: DataFrame, by: str, enabled: Column) -> DataFrame:
    return rules.groupBy(by).agg(_n().alias("rules"), F.count_if(enabled).alias("enabled"))


def crypto_inventory(df: DataFrame, *by: str) -> DataFrame:
    """Entries per value of each property (algorithm, key size and the like)."""
    return flow_counts(df, by)


def table_usage(df: DataFrame, by: str, size: Column, budget: float) -> DataFrame:
    """Rows, bytes and share of the budget per group."""
    b = F.sum(size)
    return df.groupBy(by).agg(_n().alias("n"), b.alias("bytes"), (b / budget).alias("share"))


def score_history(df: DataFrame, score: str = "risk_score", ts: str = "ts", tie: str = "request_id") -> DataFrame:
    """Per session: mean and last score, the change from first to last, and its class (0.1 either way is stable)."""
    at = F.struct(ts, tie)
    g = df.groupBy("session_id").agg(
        F.avg(score).alias("mean"), F.max_by(score, at).alias("last"), (F.max_by(score, at) - F.min_by(score, at)).alias("change")
    )
    c = F.col("change")
    return g.withColumn("trend", F.when(c > 0.1, "increasing").when(c < -0.1, "decreasing").otherwise("stable"))


def traffic_distribution(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Requests, bytes and largest request by method, by status and by hour; ``level`` tells which."""
    r = df.withColumn("hour", F.hour(ts))
    g = r.groupingSets([["method"], ["status_code"], ["hour"]], "method", "status_code", "hour")
    return g.agg(F.grouping_id().alias("level"), _n().alias("n"), F.sum("content_length").alias("bytes"), F.max("content_length").alias("peak"))


def dns_stats(df: DataFrame, domain: Column, size: Column, answers: Column) -> DataFrame:
    return df.groupBy(domain.alias("domain")).agg(_n().alias("queries"), F.avg(size).alias("mean_size"), F.sum(answers).alias("answers"))
