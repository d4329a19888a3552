"""Frequency and cardinality: count-min and HyperLogLog sketches, visitor metrics, frequency risk."""

from __future__ import annotations

from math import ceil, e, log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duskline.functions.scalars import is_bot, is_suspicious_item


def cms_shape(eps: float, confidence: float) -> tuple[int, int]:
    """(depth, width) for an error of eps N with the given confidence."""
    return max(1, ceil(log(1 / (1 - confidence)))), max(2, ceil(e / eps))


def _cells(item: Column, depth: int, width: int, seed: int) -> Column:
    rows = F.sequence(F.lit(0), F.lit(depth - 1))
    return F.transform(rows, lambda r: F.struct(r.alias("row"), F.pmod(F.xxhash64(item, r, F.lit(seed)), F.lit(width)).alias("bucket")))


def cms_build(df: DataFrame, item: str, eps: float = 0.001, confidence: float = 0.99, seed: int = 1) -> DataFrame:
    """The sketch as an open table (row, bucket, cnt); its depth x width cells are all that is aggregated or shuffled."""
    depth, width = cms_shape(eps, confidence)
    cells = df.select(F.explode(_cells(F.col(item).cast("string"), depth, width, seed)).alias("x"))
    return cells.groupBy("x.row", "x.bucket").agg(F.count(F.lit(1)).alias("cnt"))


def cms_merge(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).groupBy("row", "bucket").agg(F.sum("cnt").alias("cnt"))


def cms_query(sketch: DataFrame, items: DataFrame, item: str, eps: float = 0.001, confidence: float = 0.99, seed: int = 1):
    """Estimate per item: the least of its cells."""
    depth, width = cms_shape(eps, confidence)
    asked = items.select(F.col(item).cast("string").alias(item)).distinct()
    cells = asked.select(item, F.explode(_cells(F.col(item), depth, width, seed)).alias("_cell")).select(item, "_cell.row", "_cell.bucket")
    return cells.join(sketch, ["row", "bucket"], "left").groupBy(item).agg(F.min(F.coalesce("cnt", F.lit(0))).alias("estimate"))


def cms_top_k(sketch: DataFrame, candidates: DataFrame, item: str, k: int = 10, **shape) -> DataFrame:
    """(item, estimate, rank): the ``k`` candidates of highest estimate, ties by item. Null is no candidate."""
    top = cms_query(sketch, candidates.filter(F.col(item).isNotNull()), item, **shape).orderBy(F.desc("estimate"), item).limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("estimate"), item)))  # k rows


def cms_metrics(sketch: DataFrame, eps: float = 0.001, confidence: float = 0.99) -> DataFrame:
    depth, width = cms_shape(eps, confidence)
    out = sketch.agg(F.count(F.lit(1)).alias("filled"), (F.sum("cnt") / depth).alias("inserts"))
    return out.withColumn("fill_ratio", F.col("filled") / (depth * width)).withColumn("bytes", F.lit(8 * depth * width))


def hll_build(df: DataFrame, key: str, item: str, p: int = 12) -> DataFrame:
    return df.groupBy(key).agg(F.hll_sketch_agg(item, p).alias("sketch"))


def hll_estimate(sketches: DataFrame, key: str) -> DataFrame:
    return sketches.select(key, F.hll_sketch_estimate("sketch").alias("estimate"))


def hll_merge(sketches: DataFrame, *keys: str) -> DataFrame:
    return sketches.groupBy(*keys).agg(F.hll_union_agg("sketch").alias("sketch"))


VISITOR = {"ips": "ip", "sessions": "session_id", "agents": "user_agent", "locations": "city", "paths": "path"}


def visitor_metrics(df: DataFrame, every: str | None = None, exact: bool = True, ts: str = "ts") -> DataFrame:
    """Distinct addresses, sessions, agents, locations and paths in total or per window."""
    from .report import time_bucket

    distinct = F.count_distinct if exact else F.approx_count_distinct
    keys = [time_bucket(ts, every).alias("bucket")] if every else []
    return df.groupBy(*keys).agg(*[distinct(col).alias(name) for name, col in VISITOR.items()])


THRESHOLDS = {"baseline": 5, "suspicious": 10, "anomalous": 20, "critical": 40}


def frequency_risk(df: DataFrame, item: str, thresholds: dict[str, float] = THRESHOLDS) -> DataFrame:
    """Count per item with its ratio to the baseline, risk level by thresholds, and linear risk score."""
    t = thresholds
    out = df.groupBy(F.col(item).alias("item")).agg(F.count(F.lit(1)).alias("frequency"))
    f = F.col("frequency")
    level = F.when(f >= t["critical"], "critical").when(f >= t["anomalous"], "anomalous").when(f >= t["suspicious"], "suspicious").otherwise("normal")
    score = F.when(f <= t["baseline"], 0.0).when(f >= t["critical"], 1.0).otherwise((f - t["baseline"]) / (t["critical"] - t["baseline"]))
    return out.withColumn("deviation", f / t["baseline"]).withColumn("level", level).withColumn("risk", score)


def frequency_pattern(df: DataFrame, item: str, ts: str = "ts", unit: str = "minute") -> DataFrame:
    """burst, increasing, decreasing or steady, from the counts of an item per time unit."""
    per = df.groupBy(F.col(item).alias("item"), F.date_trunc(unit, ts).alias("_b")).agg(F.count(F.lit(1)).alias("_n"))
    g = per.groupBy("item").agg(
        F.count(F.lit(1)).alias("windows"), F.avg("_n").alias("mean"), F.var_pop("_n").alias("variance"),
        F.min_by("_n", "_b").alias("_first"), F.max_by("_n", "_b").alias("_last"),
    )
    change = (F.col("_last") - F.col("_first")) / F.greatest(F.col("_first"), F.lit(1))
    g = g.withColumn("change", change).drop("_first", "_last")
    kind = (
        F.when(F.col("windows") < 2, "steady")
        .when(F.col("variance") / F.col("mean") > 2, "burst")
        .when(F.col("change") > 0.5, "increasing")
        .when(F.col("change") < -0.5, "decreasing")
        .otherwise("steady")
    )
    return g.withColumn("pattern", kind)


def frequency_anomalies(df: DataFrame, item: str, ts: str = "ts", spike: float = 5, rare: float = 0.001) -> DataFrame:
    """Spikes, rare suspicious items and bursts with severity; one row per item and kind."""
    f = frequency_risk(df, item).join(frequency_pattern(df, item, ts, "hour"), "item")
    total = F.broadcast(df.agg(F.count(F.lit(1)).alias("_total")))  # one row
    f = f.crossJoin(total)
    d, share = F.col("deviation"), F.col("frequency") / F.col("_total")
    spikes = f.filter((d >= spike) & F.col("pattern").isin("increasing", "burst")).select(
        "item", F.lit("frequency_spike").alias("kind"),
        F.when(d >= 50, "critical").when(d >= 20, "high").when(d >= 10, "medium").otherwise("low").alias("severity"),
    )
    rares = f.filter((share <= rare) & (F.col("frequency") == 1) & is_suspicious_item("item")).select(
        "item", F.lit("rare_item").alias("kind"),
        F.when(share < 0.0001, "critical").when(share < 0.001, "high").otherwise("low").alias("severity"),
    )
    s = 0.8 * F.col("risk")
    bursts = f.filter("pattern = 'burst'").select(
        "item", F.lit("burst_pattern").alias("kind"),
        F.when(s >= 0.8, "critical").when(s >= 0.6, "high").when(s >= 0.4, "medium").otherwise("low").alias("severity"),
    )
    return spikes.unionByName(rares).unionByName(bursts)


def cardinality_risk(metrics: DataFrame) -> DataFrame:
    """Risk from ratios of distinct counts (columns of ``visitor_metrics``), 1 at most."""
    r = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))
    a, b, c, d = r("ips", "sessions"), r("agents", "ips"), r("locations", "ips"), r("paths", "sessions")
    score = (
        F.when(a > 0.8, 0.3).when(a < 0.1, 0.2).otherwise(0.0) + F.when(b < 0.1, 0.4).when(b > 2, 0.2).otherwise(0.0)
        + F.when(c > 0.5, 0.2).otherwise(0.0) + F.when(d > 10, 0.3).otherwise(0.0)
    )
    return metrics.withColumn("ip_session", a).withColumn("agent_ip", b).withColumn("risk", F.least(F.lit(1.0), score))


def visitor_trend(df: DataFrame, every: str = "1d", ts: str = "ts", item: str = "ip") -> DataFrame:
    """Distinct items per period with growth in percent, class, and z / 3 against the 7 periods before."""
    from .report import time_bucket

    per = df.groupBy(time_bucket(ts, every).alias("bucket")).agg(F.count_distinct(item).alias("n"))
    w = Window.orderBy("bucket")  # one row per period
    before = w.rowsBetween(-7, -1)
    out = per.withColumn("_p", F.lag("n").over(w)).withColumn("_m", F.avg("n").over(before)).withColumn("_s", F.stddev_pop("n").over(before))
    growth = F.coalesce(F.try_divide((F.col("n") - F.col("_p")) * 100.0, F.col("_p")), F.lit(0.0))
    out = out.withColumn("growth", growth)
    out = out.withColumn("trend", F.when(growth > 5, "increasing").when(growth < -5, "decreasing").otherwise("stable"))
    z = F.coalesce(F.try_divide(F.abs(F.col("n") - F.col("_m")), F.col("_s")), F.lit(0.0))
    return out.withColumn("anomaly", F.least(F.lit(1.0), z / 3)).drop("_p", "_m", "_s")


def compare_periods(df: DataFrame, periods: dict[str, tuple[str, str]], item: str, ts: str = "ts") -> DataFrame:
    """Distinct items in each named period [from, to)."""
    at = lambda v: F.lit(v).cast("timestamp_ntz")
    aggs = [F.count_distinct(F.when((F.col(ts) >= at(a)) & (F.col(ts) < at(b)), F.col(item))).alias(n) for n, (a, b) in periods.items()]
    wide = df.agg(*aggs)
    return wide.unpivot([], list(periods), "period", "n")


# Weights of the kinds of key, and what an anomaly of each severity adds.
KEY_WEIGHTS = {"ip_address": 0.3, "user_agent": 0.2, "request_path": 0.3, "session_id": 0.2}
SEVERITY_BOOST = {"critical": 0.3, "high": 0.2, "medium": 0.1}


def key_risks(df: DataFrame, key: str, kinds: dict[str, str]) -> DataFrame:
    """(key, kind, risk): the frequency risk of each row's value in every column of ``kinds`` (kind -> column)."""
    parts = []
    for kind, col in kinds.items():
        risk = frequency_risk(df, col).select("item", "risk")
        parts.append(df.select(key, F.col(col).alias("item")).join(risk, "item").select(key, F.lit(kind).alias("kind"), "risk"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def sketch_risk(analyses: DataFrame, anomalies: DataFrame, key: str) -> DataFrame:
    """Per key: the weighted mean of its kinds' risks plus boosts for anomalies, 1 at most, and no less than the greatest risk.

    ``analyses`` has (key, kind, risk), ``anomalies`` (key, severity). ``param_...`` kinds weigh 0.1, others unknown 1.
    """
    w = F.create_map(*[F.lit(x) for kv in KEY_WEIGHTS.items() for x in kv])[F.col("kind")]
    w = F.coalesce(w, F.when(F.col("kind").startswith("param_"), 0.1).otherwise(1.0))
    g = analyses.groupBy(key).agg((F.sum(F.col("risk") * w) / F.sum(w)).alias("_mean"), F.max("risk").alias("_max"))
    boost = F.coalesce(F.create_map(*[F.lit(x) for kv in SEVERITY_BOOST.items() for x in kv])[F.col("severity")], F.lit(0.0))
    b = anomalies.groupBy(key).agg(F.sum(boost).alias("_boost"))
    risk = F.greatest(F.least(F.col("_mean") + F.coalesce("_boost", F.lit(0.0)), F.lit(1.0)), "_max")
    return g.join(b, key, "left").select(key, risk.alias("risk"))


def visitor_pattern(df: DataFrame, every: str = "1d", points: int = 24, ts: str = "ts", item: str = "ip") -> DataFrame:
    """One row: class of the last ``points`` periods, mean growth, forecast with its range, busiest and quietest hour.

    steady below 2 % of mean growth either way, growing and declining beyond 10 %, else spiky above a coefficient of
    variation of 0.5 and seasonal below; fewer than 3 periods are steady.
    """
    last = visitor_trend(df, every, ts, item).select("bucket", "n").orderBy(F.desc("bucket")).limit(points)
    before = F.lag("n").over(Window.orderBy("bucket"))  # one row per period
    g = last.withColumn("_g", F.try_divide((F.col("n") - before) * 100.0, before)).agg(
        F.count(F.lit(1)).alias("periods"), F.coalesce(F.avg("_g"), F.lit(0.0)).alias("growth"), F.max_by("n", "bucket").alias("_last"),
        F.try_divide(F.stddev_pop("n"), F.avg("n")).alias("_cv"),
    )
    m = F.col("growth")
    kind = (
        F.when((F.col("periods") < 3) | (F.abs(m) < 2), "steady").when(m > 10, "growing").when(m < -10, "declining")
        .when(F.col("_cv") > 0.5, "spiky").otherwise("seasonal")
    )
    ahead = F.col("_last") * (1 + m / 100)
    hours = df.groupBy(F.hour(ts).alias("_h")).agg(F.count_distinct(item).alias("_n")).agg(
        F.max_by("_h", F.struct(F.col("_n"), -F.col("_h"))).alias("peak_hour"), F.min_by("_h", F.struct("_n", "_h")).alias("low_hour")
    )
    out = g.withColumns({"pattern": kind, "next": F.round(ahead), "low": F.round(ahead * 0.8), "high": F.round(ahead * 1.2)})
    return out.drop("_last", "_cv").crossJoin(F.broadcast(hours))  # one row each


def _shares(df: DataFrame, group: Column, name: str, item: str) -> DataFrame:
    """Distinct items per group, with its percentage of the sum over all groups."""
    g = df.groupBy(group.alias(name)).agg(F.count_distinct(item).alias("visitors"))
    total = g.agg(F.sum("visitors").alias("_n"))  # one row
    return g.crossJoin(F.broadcast(total)).select(name, "visitors", (F.col("visitors") * 100.0 / F.col("_n")).alias("percentage"))


def visitors_by_geo(df: DataFrame, item: str = "ip", country: str = "country") -> DataFrame:
    """(country, visitors, percentage)."""
    return _shares(df, F.col(country), "country", item)


def visitors_by_agent(df: DataFrame, item: str = "ip", agent: str = "user_agent") -> DataFrame:
    """(kind, visitors, percentage) by bot, browser and tool."""
    kind = F.when(is_bot(agent), "bot").when(F.col(agent).startswith("Mozilla"), "browser").otherwise("tool")
    return _shares(df, kind, "kind", item)


def visitor_insights(trend: DataFrame) -> DataFrame:
    """(bucket, insight) from ``visitor_trend``: growth over 50 %, anomaly over 0.7, decline below -30 %; one row each."""
    rules = [("growth", F.col("growth") > 50), ("anomaly", F.col("anomaly") > 0.7), ("decline", F.col("growth") < -30)]
    found = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules]))
    return trend.select("bucket", F.explode(found).alias("insight"))
