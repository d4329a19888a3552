"""Reports of several sections as one table (section, name, metric, value), and insights from profiles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duskline.functions.scalars import port_class

from . import report as R
from .graph import _checkpoint
from .quantiles import robust_outliers


def _n() -> Column:
    return F.count(F.lit(1))


def _rows(df: DataFrame, section: str, name: Column, **metrics: Column) -> DataFrame:
    each = F.array(*[F.struct(F.lit(m).alias("metric"), v.cast("double").alias("value")) for m, v in metrics.items()])
    return df.select(F.lit(section).alias("section"), name.cast("string").alias("name"), F.explode(each).alias("m")).select("section", "name", "m.*")


def _all(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _trend(df: DataFrame, name: str, value: str, order: list[str]) -> DataFrame:
    """The statistics of a series of buckets; the metric of the change is its class."""
    t = R.series_trend(df.select(F.lit(name).alias("_k"), F.col(value).cast("double").alias(value), *order), ["_k"], value, order)
    stats = _rows(t, "trend", F.lit(name), **{c: F.col(c) for c in ("average", "median", "min", "max", "p95", "points")})
    return stats.unionByName(t.select(F.lit("trend").alias("section"), F.lit(name).alias("name"), F.concat(F.lit("change:"), "trend").alias("metric"), F.col("change_rate").alias("value")))


def performance_report(df: DataFrame, every: str = "1h", endpoint: str = "path", value: str = "duration_ms", ts: str = "ts") -> DataFrame:
    """Summary, trends and top endpoints of requests.

    The series are the mean time of a bucket and endpoint, the requests and the error rate of a bucket: one row a
    bucket, so the trends order few rows. Uptime is 100 less the mean error rate.
    """
    times = _checkpoint(R.response_time_report(df, every, endpoint, value, ts).select("bucket", endpoint, "mean"))
    load = _checkpoint(R.throughput_report(df, every, ts).join(R.error_rate_report(df, every, ts=ts), "bucket"))
    top = R.top_endpoints(df, 10, endpoint, value)
    return _all(
        _rows(times.agg(F.avg("mean").alias("m")), "summary", F.lit("response_time"), average=F.col("m")),
        _rows(load.agg(F.sum("requests").alias("n"), F.avg("error_rate").alias("e")), "summary", F.lit("load"), throughput=F.col("n"), error_rate=F.col("e"), uptime=100 - F.col("e")),
        _trend(times, "response_time", "mean", ["bucket", endpoint]), _trend(load, "throughput", "requests", ["bucket"]), _trend(load, "error_rate", "error_rate", ["bucket"]),
        _rows(top, "top_endpoints", F.col(endpoint), requests=F.col("n"), mean=F.col("mean")),
    )


def threat_counts(df: DataFrame, kind: str, every: str = "1h", ts: str = "ts") -> DataFrame:
    """Threats per bucket and type."""
    return df.groupBy(R.time_bucket(ts, every).alias("bucket"), kind).agg(_n().alias("n"))


def blocked_counts(df: DataFrame, blocked: Column, every: str = "1h", ts: str = "ts") -> DataFrame:
    """Blocked rows per bucket."""
    return df.groupBy(R.time_bucket(ts, every).alias("bucket")).agg(F.count_if(blocked).alias("blocked"))


def threat_report(df: DataFrame, kind: str, risk: str, blocked: Column, place: str, every: str = "1h", ts: str = "ts") -> DataFrame:
    """Summary, hourly trends, types with shares, and places of a table of threats.

    False positives are taken as 5 % of all, as there is no other sign of them.
    """
    hours = _checkpoint(
        df.groupBy(R.time_bucket(ts, every).alias("bucket")).agg(_n().alias("n"), F.avg(risk).alias("risk"), F.count_if(blocked).alias("blocked"))
    )
    types = df.groupBy(kind).agg(_n().alias("n"))
    total = hours.agg(F.sum("n").alias("_t"))
    shares = types.crossJoin(F.broadcast(total)).withColumn("share", F.col("n") * 100.0 / F.col("_t"))  # one row
    places = df.groupBy(place).agg(_n().alias("n"), F.avg(risk).alias("mean")).orderBy(F.desc("n"), place).limit(20)
    sums = hours.agg(F.sum("n").alias("n"), F.sum("blocked").alias("b"), F.avg("risk").alias("r"))
    return _all(
        _rows(sums, "summary", F.lit("threats"), total=F.col("n"), blocked=F.col("b"), false_positives=F.round(F.col("n") * 0.05), average_risk=F.col("r")),
        _trend(hours, "threat_count", "n", ["bucket"]), _trend(hours, "risk_score", "risk", ["bucket"]), _trend(hours, "blocked", "blocked", ["bucket"]),
        _rows(shares, "types", F.col(kind), threats=F.col("n"), percentage=F.col("share")),
        _rows(places, "places", F.col(place), threats=F.col("n"), mean_risk=F.col("mean")),
    )


def log_report(logs: DataFrame, source: str = "source", level: str = "level", score: str = "threat_score", ts: str = "timestamp") -> DataFrame:
    """Totals, threats (score over .5), errors, warnings, the time range (epoch seconds), and entries per source."""
    measures = {
        "entries": _n(), "threats": F.count_if(F.col(score) > 0.5), "errors": F.count_if(F.col(level) == "ERROR"), "warnings": F.count_if(F.col(level) == "WARN"),
    }
    whole = logs.agg(*[v.alias(k) for k, v in measures.items()], F.min(F.unix_timestamp(ts)).alias("start"), F.max(F.unix_timestamp(ts)).alias("end"))
    each = logs.groupBy(source).agg(*[v.alias(k) for k, v in measures.items()])
    return _all(
        _rows(whole, "total", F.lit("all"), **{c: F.col(c) for c in (*measures, "start", "end")}), _rows(each, "source", F.col(source), **{c: F.col(c) for c in measures})
    )


def dashboard_analytics(df: DataFrame, threat: Column, kind: str, names: dict[str, str], k: int = 5, ts: str = "ts") -> DataFrame:
    """Threats by day, week and month, their types with shares, and the ``k`` most frequent of each named column (all rows).

    The trends name a period by its first day; the last 7 days, 7 weeks and 6 months that have threats.
    """
    bad = df.filter(threat)
    spans = F.array(*[F.struct(F.lit(u).alias("unit"), F.to_date(F.date_trunc(u, ts)).alias("day")) for u in ("day", "week", "month")])
    counts = bad.select(F.explode(spans).alias("s")).groupBy("s.unit", "s.day").agg(_n().alias("n"))
    late = F.row_number().over(Window.partitionBy("unit").orderBy(F.desc("day")))  # one row a day at most
    counts = counts.withColumn("_r", late).filter(F.col("_r") <= F.when(F.col("unit") == "month", 6).otherwise(7))
    types = R.top_with_share(bad, kind, 2**31 - 1)
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("span"), F.col(c).cast("string").alias("name")) for n, c in names.items()]))
    g = df.select(pairs.alias("p")).groupBy("p.span", "p.name").agg(_n().alias("n"))
    best = F.row_number().over(Window.partitionBy("span").orderBy(F.desc("n"), "name"))
    top = g.withColumn("_r", best).filter(F.col("_r") <= k)
    return _all(
        counts.select(F.concat(F.lit("trend:"), "unit").alias("section"), F.col("day").cast("string").alias("name"), F.lit("threats").alias("metric"), F.col("n").cast("double").alias("value")),
        _rows(types, "types", F.col(kind), threats=F.col("n"), percentage=F.col("share")),
        top.select(F.concat(F.lit("top:"), "span").alias("section"), "name", F.lit("rows").alias("metric"), F.col("n").cast("double").alias("value")),
    )


def protocol_report(df: DataFrame, protocol: str = "protocol", volume: str = "bytes") -> DataFrame:
    """Rows, share and bytes of each protocol, and the diversity: how many protocols, and the entropy of their shares in bits."""
    g = df.groupBy(protocol).agg(_n().alias("n"), F.sum(volume).alias("b"))
    return _with_diversity(g, "protocol", F.col(protocol), bytes=F.col("b"))


def port_report(df: DataFrame, port: str = "port", k: int = 20) -> DataFrame:
    """The ``k`` busiest ports, rows and share of each class, and the diversity of ports."""
    g = df.groupBy(port).agg(_n().alias("n"))
    top = g.orderBy(F.desc("n"), port).limit(k)
    classes = g.groupBy(port_class(port).alias("class")).agg(F.sum("n").alias("n"))
    whole = _with_diversity(g, "port", F.col(port)).filter("section = 'diversity'")
    shares = _with_diversity(classes, "class", F.col("class")).filter("section = 'class'")
    return _all(_rows(top, "port", F.col(port), n=F.col("n")), shares, whole)


def _with_diversity(g: DataFrame, section: str, name: Column, **more: Column) -> DataFrame:
    total = g.agg(F.sum("n").alias("_t"))
    p = g.crossJoin(F.broadcast(total)).withColumn("_p", F.col("n") / F.col("_t"))  # one row
    d = p.agg(_n().alias("k"), F.sum(-F.col("_p") * F.log2("_p")).alias("h"))
    return _rows(p, section, name, n=F.col("n"), share=F.col("_p") * 100, **more).unionByName(_rows(d, "diversity", F.lit(section), distinct=F.col("k"), entropy=F.col("h")))


def resource_usage(df: DataFrame, host: str, value: str, error: Column, every: str = "1h", ts: str = "ts") -> DataFrame:
    """Mean of a measure and error rate in percent per bucket and host."""
    return df.groupBy(R.time_bucket(ts, every).alias("bucket"), host).agg(F.avg(value).alias("usage"), (F.avg(error.cast("int")) * 100).alias("error_rate"))


def limit_effectiveness(df: DataFrame, by: str, blocked: Column, violation: Column, every: str = "1h", ts: str = "ts") -> DataFrame:
    """Requests, blocked ones, violations and the share let through per bucket and group."""
    b = blocked.cast("int")
    return df.groupBy(R.time_bucket(ts, every).alias("bucket"), by).agg(
        _n().alias("requests"), F.sum(b).alias("blocked"), F.sum(violation.cast("int")).alias("violations"), F.avg(1 - b).alias("effectiveness")
    )


# --- insights into rate limits ------------------------------------------------------------------

ADVICE = {
    "abuse_pattern": "Lower the limits of the address or block it",
    "policy_optimization": "Raise the limits of the endpoint, nothing violates them",
    "performance_issue": "Find out why the endpoint is slow before its limits are raised",
    "geographic_threat": "Apply stricter limits to the place",
    "temporal_anomaly": "Look into the burst of requests of the hour",
}


def limit_insights(df: DataFrame, address="ip", endpoint="path", place="country", latency="duration_ms", violation: Column | None = None, ts="ts") -> DataFrame:
    """(insight, item, value, z, severity, recommendation) of five detectors over profiles of the requests.

    Abuse: addresses by violations; performance: endpoints by mean time; places by violation rate; hours by requests:
    each against all others by a robust z over 3.5 (critical over 10, high over 6, else medium). Optimisation:
    endpoints without any violation, low. A profile is an aggregate that every task starts for its own rows.
    """
    bad = violation if violation is not None else F.col("status_code") >= 400
    rate = F.avg(bad.cast("int").cast("double"))
    profiles = [
        ("abuse_pattern", df.groupBy(F.col(address).alias("item")).agg(F.count_if(bad).alias("v"))),
        ("performance_issue", df.groupBy(F.col(endpoint).alias("item")).agg(F.avg(latency).alias("v"))),
        ("geographic_threat", df.groupBy(F.col(place).alias("item")).agg(rate.alias("v"))),
        ("temporal_anomaly", df.groupBy(F.date_format(F.date_trunc("hour", ts), "yyyy-MM-dd HH").alias("item")).agg(_n().alias("v"))),
    ]
    z = F.col("z")
    severity = F.when(z > 10, "critical").when(z > 6, "high").otherwise("medium")
    parts = [robust_outliers(_checkpoint(p), "item", "v").select(F.lit(name).alias("insight"), "item", "value", "z", severity.alias("severity")) for name, p in profiles]
    clean = df.groupBy(F.col(endpoint).cast("string").alias("item")).agg(_n().alias("n"), rate.alias("r")).filter("r = 0")
    parts.append(clean.select(F.lit("policy_optimization").alias("insight"), "item", F.col("n").cast("double").alias("value"), F.lit(None).cast("double").alias("z"), F.lit("low").alias("severity")))
    advice = F.create_map(*[F.lit(x) for kv in ADVICE.items() for x in kv])
    return _all(*parts).withColumn("recommendation", advice[F.col("insight")])


def limit_optimizations(df: DataFrame, blocked: Column, violation: Column, harmless: Column, latency: str = "duration_ms", most_false: float = 0.1, least_effective: float = 0.8) -> DataFrame:
    """(type, value, expected_improvement, confidence, difficulty, risk_level): what to change, by thresholds.

    Threshold tuning if more of the blocked rows are harmless than ``most_false``, policy adjustment if less of the
    violations are blocked than ``least_effective``, another algorithm if the mean time exceeds 10 ms.
    """
    m = df.agg(
        F.try_divide(F.count_if(blocked & harmless), F.count_if(blocked)).alias("f"), F.try_divide(F.count_if(blocked & violation), F.count_if(violation)).alias("e"), F.avg(latency).alias("l")
    )
    row = lambda c, kind, value, *rest: F.when(c, F.struct(F.lit(kind).alias("type"), value.cast("double").alias("value"), *[F.lit(v).alias(k) for k, v in rest]))
    what = lambda gain, sure, hard, risk: (("expected_improvement", gain), ("confidence", sure), ("difficulty", hard), ("risk_level", risk))
    found = F.array_compact(F.array(
        row(F.col("f") > most_false, "threshold_tuning", F.col("f"), *what(0.15, 0.8, "medium", "medium")),
        row(F.col("e") < least_effective, "policy_adjustment", F.col("e"), *what(0.25, 0.7, "easy", "low")),
        row(F.col("l") > 10, "algorithm_change", F.col("l"), *what(0.1, 0.9, "hard", "medium")),
    ))
    return m.select(F.explode(found).alias("o")).select("o.*")
