"""Queries: reporting, aggregation, retention."""

from __future__ import annotations

from pyspark.sql import functions as F

from duskline.operators import report as R
from duskline.operators import summary as Y
from duskline.sources.tables import parse_logs

from .basics import LOG_LINE
from .registry import query, rnd

HOUR = "epoch_us(time_bucket(INTERVAL '1 hour', ts)) // 1000000"


def stamped(df, *rounded, at="bucket"):
    out = df.withColumn(at, F.unix_timestamp(at)) if at in df.columns else df
    for r in rounded:
        out = out.withColumn(r, rnd(F.col(r).cast("double"), 5))
    return out


@query("a01_query_points", "SELECT request_id, duration_ms FROM requests WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-15' AND method = 'POST' ORDER BY duration_ms DESC, request_id LIMIT 50 OFFSET 10", "requests")
def _(t):
    return R.query_points(t.requests, "2024-01-05", "2024-01-15", {"method": "POST"}, ["request_id", "duration_ms"], [F.desc("duration_ms"), "request_id"], 50, 10)


for fn, sql in {"mean": "avg(value)", "sum": "sum(value)", "count": "count(value)", "min": "min(value)", "max": "max(value)", "median": "median(value)", "percentile": "quantile_cont(value, 0.95)"}.items():

    @query(f"a02_aggregate_{fn}", f"SELECT {HOUR.replace('1 hour', '6 hours')} AS bucket, event_type, round(({sql})::double, 5) AS value FROM events GROUP BY 1, 2")
    def _(t, fn=fn):
        return stamped(R.aggregate_points(t.events, fn, "value", every="6h", group_by=["event_type"]), "value")


GRID = "g AS (SELECT event_type, time_bucket(INTERVAL '1 hour', ts) AS b, sum(value) AS v FROM events WHERE user_id % 10 = 3 GROUP BY 1, 2), sp AS (SELECT event_type, unnest(generate_series(min(b), max(b), INTERVAL '1 hour')) AS b FROM g GROUP BY event_type), j AS (SELECT event_type, b, v FROM sp LEFT JOIN g USING (event_type, b))"
FILL = {
    "zero": "coalesce(v, 0)",
    "null": "v",
    "previous": "last_value(v IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY b ROWS UNBOUNDED PRECEDING)",
}
for how, sql in FILL.items():

    @query(f"a03_fill_{how}", f"WITH {GRID} SELECT event_type, epoch_us(b) // 1000000 AS bucket, round({sql}, 5) AS value FROM j")
    def _(t, how=how):
        g = R.aggregate_points(t.events.filter("user_id % 10 = 3"), "sum", "value", every="1h", group_by=["event_type"])
        return stamped(R.fill_gaps(g, "1h", how, "event_type"), "value")


@query(
    "a03_fill_linear",
    f"WITH {GRID}, k AS (SELECT *, last_value(v IGNORE NULLS) OVER p AS a, first_value(v IGNORE NULLS) OVER f AS c, last_value(CASE WHEN v IS NOT NULL THEN epoch(b) END IGNORE NULLS) OVER p AS ta, "
    "first_value(CASE WHEN v IS NOT NULL THEN epoch(b) END IGNORE NULLS) OVER f AS tc FROM j WINDOW p AS (PARTITION BY event_type ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), f AS (PARTITION BY event_type ORDER BY b ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) "
    "SELECT event_type, epoch_us(b) // 1000000 AS bucket, round(CASE WHEN tc = ta THEN a ELSE a + (c - a) / (tc - ta) * (epoch(b) - ta) END, 5) AS value FROM k",
)
def _(t):
    g = R.aggregate_points(t.events.filter("user_id % 10 = 3"), "sum", "value", every="1h", group_by=["event_type"])
    return stamped(R.fill_gaps(g, "1h", "linear", "event_type"), "value")


BUCKETS = {"1m": "1 minute", "5m": "5 minutes", "15m": "15 minutes", "1h": "1 hour", "6h": "6 hours", "1d": "1 day"}
for every, interval in BUCKETS.items():

    @query(f"a04_bucket_{every}", f"SELECT epoch_us(time_bucket(INTERVAL '{interval}', ts)) // 1000000 AS bucket, count(*) AS n FROM events GROUP BY 1")
    def _(t, every=every):
        return stamped(t.events.groupBy(R.time_bucket("ts", every).alias("bucket")).agg(F.count(F.lit(1)).alias("n")))


for every, unit in {"1w": "week", "1M": "month"}.items():

    @query(f"a04_bucket_{unit}", f"SELECT epoch_us(date_trunc('{unit}', o_orderdate)) // 1000000 AS bucket, count(*) AS n FROM orders GROUP BY 1")
    def _(t, every=every):
        return stamped(t.orders.groupBy(R.time_bucket("o_orderdate", every).alias("bucket")).agg(F.count(F.lit(1)).alias("n")))


@query("a05_response_time_report", f"SELECT {HOUR} AS bucket, path, round(avg(duration_ms), 5) AS mean, round(quantile_cont(duration_ms, 0.95), 5) AS p95, round(quantile_cont(duration_ms, 0.99), 5) AS p99 FROM requests GROUP BY 1, 2", "requests")
def _(t):
    return stamped(R.response_time_report(t.requests), "mean", "p95", "p99")


@query("a06_throughput_report", f"SELECT {HOUR} AS bucket, count(*) AS requests FROM requests GROUP BY 1", "requests")
def _(t):
    return stamped(R.throughput_report(t.requests))


@query("a07_error_rate_report", f"SELECT {HOUR} AS bucket, round(sum((status_code >= 400)::int) / count(*) * 100, 5) AS error_rate FROM requests GROUP BY 1", "requests")
def _(t):
    return stamped(R.error_rate_report(t.requests), "error_rate")


@query("a08_top_endpoints", "SELECT path, count(*) AS n, round(avg(duration_ms), 5) AS mean FROM requests GROUP BY path ORDER BY n DESC, path LIMIT 10", "requests")
def _(t):
    return stamped(R.top_endpoints(t.requests), "mean")


@query("a09_threat_counts", f"SELECT {HOUR} AS bucket, event_type, count(*) AS n FROM requests WHERE risk_score > 0.5 GROUP BY 1, 2", "requests")
def _(t):
    return stamped(Y.threat_counts(t.requests.filter("risk_score > 0.5"), "event_type"))


@query("a10_risk_trend", f"SELECT {HOUR} AS bucket, round(avg(risk_score), 5) AS value FROM requests GROUP BY 1", "requests")
def _(t):
    return stamped(R.aggregate_points(t.requests, "mean", "risk_score", every="1h"), "value")


@query("a11_blocked_counts", f"SELECT {HOUR} AS bucket, count_if(status_code = 403) AS blocked FROM requests GROUP BY 1", "requests")
def _(t):
    return stamped(Y.blocked_counts(t.requests, F.col("status_code") == 403))


@query("a12_top_threat_types", "SELECT event_type, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 5)::double AS share FROM events GROUP BY event_type ORDER BY n DESC, event_type LIMIT 3")
def _(t):
    return stamped(R.top_with_share(t.events, "event_type", 3), "share")


@query("a13_geo_distribution", "SELECT country, count(*) AS n, round(avg(risk_score), 5) AS mean FROM requests GROUP BY country ORDER BY n DESC, country LIMIT 20", "requests")
def _(t):
    return stamped(R.geo_distribution(t.requests), "mean")


SESS = "s AS (SELECT session_id, min(ts) AS start, count(*) AS n, (max(epoch_us(ts)) - min(epoch_us(ts))) / 1e6 AS duration, max((event_type = 'purchase')::int) AS converted, min(country) AS kind FROM requests GROUP BY session_id)"


def sessions(t):
    return R.session_table(t.requests, "country", F.col("event_type") == "purchase")


@query("a14_session_metrics", f"WITH {SESS} SELECT epoch_us(time_bucket(INTERVAL '1 day', start)) // 1000000 AS bucket, round(avg(duration), 4) AS avg_duration, sum(n)::bigint AS total_views FROM s GROUP BY 1", "requests")
def _(t):
    m = R.session_metrics(sessions(t), "1d")
    return m.select(F.unix_timestamp("bucket").alias("bucket"), rnd("avg_duration", 4).alias("avg_duration"), "total_views")


@query("a14_conversion_trend", f"WITH {SESS} SELECT epoch_us(time_bucket(INTERVAL '1 day', start)) // 1000000 AS bucket, round(avg(converted), 5) AS rate FROM s GROUP BY 1", "requests")
def _(t):
    return R.conversion_trend(sessions(t), "1d").select(F.unix_timestamp("bucket").alias("bucket"), rnd("avg_conversion_rate").alias("rate"))


@query("a14_user_type_mix", f"WITH {SESS} SELECT kind, count(*) AS user_count, round(avg(duration), 4) AS avg_duration FROM s GROUP BY kind", "requests")
def _(t):
    return R.user_type_mix(sessions(t)).withColumn("avg_duration", rnd("avg_duration", 4))


@query("a15_last_by", "SELECT user_id, arg_max(value, struct_pack(a := ts, b := event_id)) AS value FROM events GROUP BY user_id")
def _(t):
    return R.last_by(t.events.withColumn("ts", F.struct("ts", "event_id")), "user_id", "value")


@query("a16_resource_usage", f"SELECT {HOUR} AS bucket, host, round(avg(content_length), 4) AS usage, round(avg((status_code >= 400)::int) * 100, 5) AS error_rate FROM requests GROUP BY 1, 2", "requests")
def _(t):
    return stamped(Y.resource_usage(t.requests, "host", "content_length", F.col("status_code") >= 400).withColumn("usage", rnd("usage", 4)), "error_rate")


@query("a17_limit_effectiveness", f"SELECT {HOUR} AS bucket, path, count(*) AS requests, sum((status_code = 403)::int)::bigint AS blocked, sum((status_code >= 400)::int)::bigint AS violations, round(avg(1 - (status_code = 403)::int), 5) AS effectiveness FROM requests GROUP BY 1, 2", "requests")
def _(t):
    return stamped(Y.limit_effectiveness(t.requests, "path", F.col("status_code") == 403, F.col("status_code") >= 400), "effectiveness")


@query("a18_recent", "SELECT request_id FROM requests WHERE ts BETWEEN TIMESTAMP '2024-01-14 12:00:00' AND TIMESTAMP '2024-01-15 12:00:00' ORDER BY ts DESC, request_id LIMIT 1000", "requests")
def _(t):
    return R.recent(t.requests, 1440, "2024-01-15 12:00:00").select("request_id")


TREND_SQL = """WITH r AS (SELECT {k} AS k, {v} AS v, count(*) OVER (PARTITION BY {k}) AS n, row_number() OVER (PARTITION BY {k} ORDER BY {o}) - 1 AS i, row_number() OVER (PARTITION BY {k} ORDER BY {v}, {o}) - 1 AS q FROM {f}),
 g AS (SELECT k, avg(v) AS average, max(CASE WHEN q = n // 2 THEN v END) AS median, min(v) AS min, max(v) AS max, max(CASE WHEN q = floor(n * 0.95) THEN v END) AS p95, count(*) AS points, avg(CASE WHEN i < n // 2 THEN v END) AS a, avg(CASE WHEN i >= n // 2 THEN v END) AS b FROM r GROUP BY k),
 c AS (SELECT *, CASE WHEN a > 0 THEN (b - a) / a * 100 ELSE 0 END AS rate FROM g)
 SELECT k AS {k}, round(average, 5) AS average, round(median, 5) AS median, round(min, 5) AS min, round(max, 5) AS max, round(p95, 5) AS p95, points, round(rate, 5) AS change_rate, CASE WHEN rate > 10 THEN 'increasing' WHEN rate < -10 THEN 'decreasing' WHEN abs(rate) > 5 THEN 'volatile' ELSE 'stable' END AS trend FROM c"""


@query("a19_series_trend", TREND_SQL.format(k="user_id", v="value", o="ts, event_id", f="events"))
def _(t):
    return stamped(R.series_trend(t.events, ["user_id"], "value", ["ts", "event_id"]), "average", "median", "min", "max", "p95", "change_rate")


for every, (interval, minutes) in {"1m": ("1 minute", 1), "5m": ("5 minutes", 5), "15m": ("15 minutes", 15), "1h": ("1 hour", 60)}.items():

    @query(f"a22_traffic_stats_{every}", f"SELECT epoch_us(time_bucket(INTERVAL '{interval}', ts)) // 1000000 AS bucket, count(*) AS requests, round(count(*) / {minutes}, 5) AS requests_per_minute, count(DISTINCT ip) AS unique_ips, count(DISTINCT user_agent) AS unique_agents, round(avg(duration_ms), 5) AS mean_latency, round(avg((status_code >= 400)::int), 5) AS error_rate, sum(content_length)::bigint AS bytes FROM requests GROUP BY 1", "requests")
    def _(t, every=every):
        return stamped(R.traffic_stats(t.requests, every), "requests_per_minute", "mean_latency", "error_rate")


@query("a24_traffic_basic", "SELECT count(*) AS connections, round(sum(bytes), 2) AS bytes, sum(packets)::bigint AS packets, round(avg(bytes), 5) AS mean_bytes, count(DISTINCT source) AS sources, count(DISTINCT destination) AS destinations FROM connections", "connections")
def _(t):
    out = R.traffic_basic(t.connections).drop("first", "last")
    return out.withColumn("bytes", rnd("bytes", 2)).withColumn("mean_bytes", rnd("mean_bytes", 5))


@query("a26_temporal_profile", "WITH p AS (SELECT 'hour' AS unit, hour(ts) AS slot, count(*) AS n FROM events GROUP BY 2 UNION ALL SELECT 'weekday', isodow(ts) - 1, count(*) FROM events GROUP BY 2 UNION ALL SELECT 'day', day(ts), count(*) FROM events GROUP BY 2) SELECT *, row_number() OVER (PARTITION BY unit ORDER BY n DESC, slot) = 1 AS peak FROM p")
def _(t):
    return R.temporal_profile(t.events)


@query("a28_flow_counts", "SELECT protocol, source, destination, count(*) AS n FROM connections GROUP BY GROUPING SETS ((protocol), (source), (destination))", "connections")
def _(t):
    return R.flow_counts(t.connections)


@query(
    "a29_assemble_flows",
    "WITH l AS (SELECT *, epoch_us(ts) // 1000000 - lag(epoch_us(ts) // 1000000) OVER w AS gap FROM connections WINDOW w AS (PARTITION BY source, protocol ORDER BY ts, conn_id * 10 + line)), "
    "f AS (SELECT *, sum(CASE WHEN gap > 604800 THEN 1 ELSE 0 END) OVER (PARTITION BY source, protocol ORDER BY ts, conn_id * 10 + line) AS flow FROM l) "
    "SELECT source, protocol, flow::bigint AS flow, count(*) AS packets, round(sum(bytes), 2) AS bytes, round(avg(bytes), 4) AS mean_size, max(epoch_us(ts) // 1000000) - min(epoch_us(ts) // 1000000) AS duration, round(avg(CASE WHEN gap <= 604800 THEN gap END), 4) AS mean_gap FROM f GROUP BY 1, 2, 3", "connections",
)
def _(t):
    c = t.connections.withColumn("tie", F.col("conn_id") * 10 + F.col("line"))
    out = R.assemble_flows(c, ["source", "protocol"], "ts", 604800, tie="tie")
    return out.withColumn("bytes", rnd("bytes", 2)).withColumn("mean_size", rnd("mean_size", 4)).withColumn("mean_gap", rnd("mean_gap", 4))


@query("a30_fit_baseline", "SELECT event_type, count(*) AS n, round(avg(value), 5) AS mean, round(stddev_pop(value), 5) AS std, min(value) AS min, max(value) AS max, round(quantile_cont(value, 0.25), 5) AS p25, round(median(value), 5) AS median, round(quantile_cont(value, 0.75), 5) AS p75, round(quantile_cont(value, 0.95), 5) AS p95, round(kurtosis_pop(value), 5) AS kurt FROM events GROUP BY event_type")
def _(t):
    return stamped(R.fit_baseline(t.events, ["event_type"], "value").drop("skew"), "mean", "std", "p25", "median", "p75", "p95", "kurt")


@query("a31_histogram", "SELECT (CASE WHEN value < 0 THEN 0 WHEN value >= 500 THEN 21 ELSE floor(value / 25) + 1 END)::bigint AS bin, count(*) AS n FROM events GROUP BY 1")
def _(t):
    return R.histogram(t.events, "value", 0, 500, 20)


@query("a32_graph_stats", "SELECT type, count(*) AS n FROM edges GROUP BY ROLLUP (type)", "edges")
def _(t):
    return R.graph_stats(t.edges)


@query("a33_alert_summary", "SELECT severity, event_type, count(*) AS n FROM requests GROUP BY CUBE (severity, event_type)", "requests")
def _(t):
    return R.alert_summary(t.requests, "severity", "event_type")


@query("a35_request_features", "WITH e AS (SELECT session_id, count(DISTINCT path) AS endpoints FROM requests GROUP BY session_id) SELECT request_id, count(*) OVER (PARTITION BY ip, date_trunc('minute', ts)) AS per_minute, endpoints, round(avg(duration_ms) OVER (PARTITION BY ip), 5) AS mean_latency, round(avg((status_code >= 400)::int) OVER (PARTITION BY ip), 5) AS error_rate FROM requests JOIN e USING (session_id)", "requests")
def _(t):
    from duskline.operators.ml import request_features

    return stamped(request_features(t.requests).select("request_id", "per_minute", "endpoints", "mean_latency", "error_rate"), "mean_latency", "error_rate")


METRICS_SQL = "WITH c AS (SELECT count_if(pred = 1 AND label = 1) AS tp, count_if(pred = 1 AND label = 0) AS fp, count_if(pred = 0 AND label = 0) AS tn, count_if(pred = 0 AND label = 1) AS fn FROM labelled), m AS (SELECT *, (tp + tn) / (tp + fp + tn + fn) AS accuracy, coalesce(tp / nullif(tp + fp, 0), 0) AS prec, coalesce(tp / nullif(tp + fn, 0), 0) AS rec, coalesce(fp / nullif(fp + tn, 0), 0) AS fpr FROM c) SELECT tp, fp, tn, fn, round(accuracy, 5) AS accuracy, round(prec, 5) AS precision, round(rec, 5) AS recall, round(fpr, 5) AS fpr, round(coalesce(2 * prec * rec / nullif(prec + rec, 0), 0), 5) AS f1 FROM m"


@query("a36_classification_metrics", METRICS_SQL, "labelled")
def _(t):
    return stamped(R.classification_metrics(t.labelled, "pred", "label"), "accuracy", "precision", "recall", "fpr", "f1")


@query("a37_latency_percentiles", "WITH r AS (SELECT path, duration_ms AS v, count(*) OVER (PARTITION BY path) AS n, row_number() OVER (PARTITION BY path ORDER BY duration_ms) AS i FROM requests) SELECT path, max(CASE WHEN i = greatest(ceil(n * 0.5), 1) THEN v END) AS p50, max(CASE WHEN i = greatest(ceil(n * 0.95), 1) THEN v END) AS p95, max(CASE WHEN i = greatest(ceil(n * 0.99), 1) THEN v END) AS p99 FROM r GROUP BY path", "requests")
def _(t):
    return R.latency_percentiles(t.requests, "path", "duration_ms")


@query("a38_rolling_summary", "SELECT host, round(avg(duration_ms), 5) AS mean, max(duration_ms) AS max, min(duration_ms) AS min, round((arg_max(duration_ms, struct_pack(a := ts, b := request_id)) - arg_min(duration_ms, struct_pack(a := ts, b := request_id))) / arg_min(duration_ms, struct_pack(a := ts, b := request_id)), 5) AS trend FROM requests WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-25' GROUP BY host", "requests")
def _(t):
    return stamped(R.rolling_summary(t.requests, 20 * 1440, "2024-01-25", "host", "duration_ms"), "mean", "trend")


@query("a39_health_score", "SELECT host, (100 - CASE WHEN quantile_cont(content_length, 0.95) > 10000 OR quantile_cont(duration_ms, 0.95) > 5000 THEN 20 ELSE 0 END - CASE WHEN avg((status_code >= 500)::int) > 0.01 THEN 30 ELSE 0 END - CASE WHEN avg((risk_score < 0.5)::int) < 0.8 THEN 25 ELSE 0 END)::int AS score FROM requests GROUP BY host", "requests")
def _(t):
    g = t.requests.groupBy("host").agg(F.percentile("content_length", 0.95).alias("a"), F.percentile("duration_ms", 0.95).alias("b"), F.avg((F.col("status_code") >= 500).cast("int")).alias("e"), F.avg((F.col("risk_score") < 0.5).cast("int")).alias("c"))
    return g.select("host", R.health_score(F.col("a"), F.col("b"), F.col("e"), F.col("c"), F.lit(0.0)).alias("score"))


@query("a40_adaptation_stats", "SELECT user_id, count(*) AS total, count_if(value > 350) AS successes, round(avg(value), 5) AS mean_confidence, max(event_id) AS last_id FROM events GROUP BY user_id")
def _(t):
    return stamped(R.adaptation_stats(t.events, "user_id", F.col("value") > 350, "value", "event_id"), "mean_confidence")


@query("a41_detection_summary", "SELECT event_type, severity, count(*) AS n, round(avg(risk_score), 5) AS confidence FROM requests GROUP BY GROUPING SETS ((event_type), (severity), ())", "requests")
def _(t):
    return stamped(R.detection_summary(t.requests), "confidence")


@query("a42_deception_stats", "SELECT p AS trap_path, count(request_id) AS accesses FROM (SELECT unnest(['/admin/config?debug=1', '/api/items/7', '/never']) AS p) x LEFT JOIN requests ON path = p GROUP BY p", "requests")
def _(t):
    traps = t.spark.createDataFrame([("/admin/config?debug=1",), ("/api/items/7",), ("/never",)], "trap_path string")
    return R.deception_stats(t.requests, traps)


@query("a43_feedback_stats", "SELECT signal, count_if(event_type = 'click') AS click, count_if(event_type = 'error') AS error FROM (SELECT event_type, unnest(CASE WHEN value > 200 THEN ['fast', 'seen'] ELSE ['seen'] END) AS signal FROM events) GROUP BY signal")
def _(t):
    s = F.when(F.col("value") > 200, F.array(F.lit("fast"), F.lit("seen"))).otherwise(F.array(F.lit("seen")))
    return R.feedback_stats(t.events, s, "event_type", ["click", "error"])


@query("a44_rule_stats", "SELECT p_brand, count(*) AS rules, count_if(p_size > 25) AS enabled FROM part GROUP BY p_brand")
def _(t):
    return R.rule_stats(t.part, "p_brand", F.col("p_size") > 25)


@query("a45_crypto_inventory", "SELECT p_brand, p_type, p_size, count(*) AS n FROM part GROUP BY GROUPING SETS ((p_brand), (p_type), (p_size))")
def _(t):
    return R.crypto_inventory(t.part, "p_brand", "p_type", "p_size")


@query("a46_table_usage", "SELECT event_type, count(*) AS n, sum(length(props))::bigint AS bytes, round(sum(length(props)) / 100000.0, 5)::double AS share FROM events GROUP BY event_type")
def _(t):
    return stamped(R.table_usage(t.events, "event_type", F.length("props"), 100000.0), "share")


@query("a47_score_history", "WITH h AS (SELECT session_id, avg(risk_score) AS m, arg_max(risk_score, struct_pack(a := ts, b := request_id)) AS last, arg_max(risk_score, struct_pack(a := ts, b := request_id)) - arg_min(risk_score, struct_pack(a := ts, b := request_id)) AS c FROM requests GROUP BY session_id) SELECT session_id, round(m, 5) AS mean, last, round(c, 5) AS change, CASE WHEN c > 0.1 THEN 'increasing' WHEN c < -0.1 THEN 'decreasing' ELSE 'stable' END AS trend FROM h", "requests")
def _(t):
    return stamped(R.score_history(t.requests), "mean", "change")


@query("a48_traffic_distribution", "SELECT method, status_code, hour(ts) AS hour, grouping_id(method, status_code, hour(ts)) AS level, count(*) AS n, sum(content_length)::bigint AS bytes, max(content_length) AS peak FROM requests GROUP BY GROUPING SETS ((method), (status_code), (hour(ts)))", "requests")
def _(t):
    return R.traffic_distribution(t.requests)


@query("a49_dns_stats", "SELECT regexp_extract(url, '//([^/?#]*)', 1) AS domain, count(*) AS queries, round(avg(length(html)), 5) AS mean_size, sum(len(string_split(url, '/')))::bigint AS answers FROM pages GROUP BY 1")
def _(t):
    return stamped(R.dns_stats(t.pages, F.regexp_extract("url", "//([^/?#]*)", 1), F.length("html"), F.size(F.split("url", "/"))), "mean_size")


@query("n01_apply_retention", "SELECT ts >= TIMESTAMP '2024-01-31' - INTERVAL 7 DAY AS kept, count(*) AS n FROM events GROUP BY 1")
def _(t):
    kept, expired = R.apply_retention(t.events, R.RETENTION_DAYS["performance"], "2024-01-31")
    return kept.select(F.lit(True).alias("kept")).unionAll(expired.select(F.lit(False).alias("kept"))).groupBy("kept").agg(F.count(F.lit(1)).alias("n"))


@query("n02_archive_expired", "SELECT cast(ts AS date)::varchar AS date, count(*) AS n FROM events WHERE ts < TIMESTAMP '2024-01-31' - INTERVAL 7 DAY GROUP BY 1")
def _(t):
    _, expired = R.apply_retention(t.events, 7, "2024-01-31")
    return expired.groupBy(F.to_date("ts").cast("string").alias("date")).agg(F.count(F.lit(1)).alias("n"))


@query("n03_rollup_points", "SELECT event_type, epoch_us(date_trunc('month', ts)) // 1000000 AS ts, round(sum(value), 4) AS value_sum, count(*) AS value_count, min(value) AS value_min, max(value) AS value_max FROM events GROUP BY 1, date_trunc('month', ts)")
def _(t):
    hourly = R.rollup_points(t.events, "hour", ["event_type"], "value")
    monthly = R.rollup_points(R.rollup_points(hourly, "day", ["event_type"], "value"), "month", ["event_type"], "value")
    return monthly.withColumn("ts", F.unix_timestamp("ts")).withColumn("value_sum", rnd("value_sum", 4))


# --- reports of several sections ----------------------------------------------------------------


def listed(sql: str, section: str, name: str, **metrics: str) -> str:
    """Rows (section, name, metric, value) of a SQL relation."""
    return " UNION ALL ".join(f"SELECT '{section}' AS section, ({name})::varchar AS name, '{m}' AS metric, ({v})::double AS value FROM ({sql})" for m, v in metrics.items())


def trended(rel: str, name: str, value: str, order: str) -> str:
    t = TREND_SQL.format(k="grp", v=value, o=order, f=f"(SELECT 1 AS grp, * FROM {rel})").replace("round(", "exact(")
    t = t.replace("exact(average, 5)", "average").replace("exact(median, 5)", "median").replace("exact(min, 5)", "min").replace("exact(max, 5)", "max").replace("exact(p95, 5)", "p95").replace("exact(rate, 5)", "rate")
    stats = listed(t, "trend", f"'{name}'", average="average", median="median", min="min", max="max", p95="p95", points="points")
    return f"{stats} UNION ALL SELECT 'trend', '{name}', concat('change:', trend), change_rate FROM ({t})"


def valued(df):
    return df.withColumn("value", rnd("value", 4))


BY_HOUR = "time_bucket(INTERVAL '1 hour', ts)"


@query(
    "a20_performance_report",
    f"WITH tm AS (SELECT {BY_HOUR} AS bucket, path, avg(duration_ms) AS mean FROM requests GROUP BY 1, 2), ld AS (SELECT {BY_HOUR} AS bucket, count(*) AS requests, sum((status_code >= 400)::int) / count(*) * 100 AS error_rate FROM requests GROUP BY 1), "
    "tp AS (SELECT path, count(*) AS n, avg(duration_ms) AS mean FROM requests GROUP BY path ORDER BY n DESC, path LIMIT 10), al AS ("
    + " UNION ALL ".join([
        listed("SELECT avg(mean) AS m FROM tm", "summary", "'response_time'", average="m"),
        listed("SELECT sum(requests) AS n, avg(error_rate) AS e FROM ld", "summary", "'load'", throughput="n", error_rate="e", uptime="100 - e"),
        trended("tm", "response_time", "mean", "bucket, path"), trended("ld", "throughput", "requests::double", "bucket"), trended("ld", "error_rate", "error_rate", "bucket"),
        listed("SELECT * FROM tp", "top_endpoints", "path", requests="n", mean="mean"),
    ]) + ") SELECT section, name, metric, round(value, 4) AS value FROM al",
    "requests",
)
def _(t):
    return valued(Y.performance_report(t.requests))


@query(
    "a21_threat_report",
    f"WITH th AS (SELECT * FROM requests WHERE risk_score > 0.3), hr AS (SELECT {BY_HOUR} AS bucket, count(*) AS n, avg(risk_score) AS risk, count_if(status_code = 403) AS blocked FROM th GROUP BY 1), "
    "ty AS (SELECT event_type, count(*) AS n, count(*) * 100.0 / sum(count(*)) OVER () AS share FROM th GROUP BY 1), pl AS (SELECT country, count(*) AS n, avg(risk_score) AS mean FROM th GROUP BY 1 ORDER BY n DESC, country LIMIT 20), al AS ("
    + " UNION ALL ".join([
        listed("SELECT sum(n) AS n, sum(blocked) AS b, avg(risk) AS r FROM hr", "summary", "'threats'", total="n", blocked="b", false_positives="floor(n * 0.05 + 0.5)", average_risk="r"),
        trended("hr", "threat_count", "n::double", "bucket"), trended("hr", "risk_score", "risk", "bucket"), trended("hr", "blocked", "blocked::double", "bucket"),
        listed("SELECT * FROM ty", "types", "event_type", threats="n", percentage="share"), listed("SELECT * FROM pl", "places", "country", threats="n", mean_risk="mean"),
    ]) + ") SELECT section, name, metric, round(value, 4) AS value FROM al",
    "requests",
)
def _(t):
    return valued(Y.threat_report(t.requests.filter("risk_score > 0.3"), "event_type", "risk_score", F.col("status_code") == 403, "country"))


LOGGED = "lg AS (SELECT w[1] AS stamp, w[2] AS level, w[3] AS source, array_to_string(w[4:], ' ') AS m FROM (SELECT string_split(value, ' ') AS w FROM (" + LOG_LINE.replace("{events}", "events") + ") l) WHERE len(w) >= 4), lm AS (SELECT *, regexp_matches(m, '(?i)failed.+login') AND regexp_matches(m, '(?i)brute.?force') OR regexp_matches(m, '(?i)malware') AND regexp_matches(m, '(?i)suspicious') AS bad FROM lg)"
LOG_COUNTS = "count(*) AS entries, count_if(bad) AS threats, count_if(level = 'ERROR') AS errors, count_if(level = 'WARN') AS warnings"
LOG_NAMES = {c: c for c in ("entries", "threats", "errors", "warnings")}


@query(
    "a23_log_report",
    f"WITH {LOGGED}, al AS (" + listed(f"SELECT {LOG_COUNTS}, min(epoch(stamp::timestamp)) AS start, max(epoch(stamp::timestamp)) AS fin FROM lm", "total", "'all'", **LOG_NAMES, start="start", end="fin")
    + " UNION ALL " + listed(f"SELECT source, {LOG_COUNTS} FROM lm GROUP BY 1", "source", "source", **LOG_NAMES) + ") SELECT section, name, metric, floor(value)::double AS value FROM al",
)
def _(t):
    return Y.log_report(parse_logs(t.spark.sql(LOG_LINE, events=t.events)))


NAMES = {"agent": "user_agent", "country": "country", "city": "city", "ip": "ip"}


@query(
    "a34_dashboard_analytics",
    "WITH th AS (SELECT * FROM requests WHERE risk_score > 0.3), sp AS (SELECT unit, cast(d AS date) AS d, count(*) AS n FROM (SELECT unnest(['day', 'week', 'month']) AS unit, unnest([date_trunc('day', ts), date_trunc('week', ts), date_trunc('month', ts)]) AS d FROM th) GROUP BY 1, 2), "
    "ls AS (SELECT * FROM sp QUALIFY row_number() OVER (PARTITION BY unit ORDER BY d DESC) <= CASE WHEN unit = 'month' THEN 6 ELSE 7 END), ty AS (SELECT event_type, count(*) AS n, count(*) * 100.0 / sum(count(*)) OVER () AS share FROM th GROUP BY 1), "
    "nm AS (" + " UNION ALL ".join(f"SELECT '{k}' AS span, {c}::varchar AS name, count(*) AS n FROM requests GROUP BY 2" for k, c in NAMES.items()) + "), tp AS (SELECT * FROM nm QUALIFY row_number() OVER (PARTITION BY span ORDER BY n DESC, name) <= 5), "
    "al AS (SELECT concat('trend:', unit) AS section, d::varchar AS name, 'threats' AS metric, n::double AS value FROM ls UNION ALL " + listed("SELECT * FROM ty", "types", "event_type", threats="n", percentage="share")
    + " UNION ALL SELECT concat('top:', span), name, 'rows', n FROM tp) SELECT section, name, metric, round(value, 4) AS value FROM al",
    "requests",
)
def _(t):
    return valued(Y.dashboard_analytics(t.requests, F.col("risk_score") > 0.3, "event_type", NAMES))


def diverse(rel: str, key: str, section: str, more: str = "") -> str:
    p = f"SELECT {key} AS k, n, {more or '0'} AS b, n / sum(n) OVER () AS p FROM {rel}"
    each = listed(p, section, "k", n="n", share="p * 100", **({"bytes": "b"} if more else {}))
    return each + " UNION ALL " + listed(f"SELECT count(*) AS k, sum(-p * log2(p)) AS h FROM ({p})", "diversity", f"'{section}'", distinct="k", entropy="h")


@query("a25_protocol_stats", "WITH g AS (SELECT protocol, count(*) AS n, sum(bytes) AS vol FROM connections GROUP BY 1), al AS (" + diverse("g", "protocol", "protocol", "vol") + ") SELECT section, name, metric, round(value, 4) AS value FROM al", "connections")
def _(t):
    return valued(Y.protocol_report(t.connections))


@query("a27_port_stats", "WITH g AS (SELECT port, count(*) AS n FROM connections GROUP BY 1), c AS (SELECT CASE WHEN port < 1024 THEN 'well_known' WHEN port < 49152 THEN 'registered' ELSE 'dynamic' END AS cl, sum(n) AS n FROM g GROUP BY 1), al AS (SELECT 'port' AS section, port::varchar AS name, 'n' AS metric, n::double AS value FROM (SELECT * FROM g ORDER BY n DESC, port LIMIT 20) UNION ALL (SELECT * FROM (" + diverse("g", "port", "port") + ") WHERE section = 'diversity') UNION ALL (SELECT * FROM (" + diverse("c", "cl", "class") + ") WHERE section = 'class')) SELECT section, name, metric, round(value, 4) AS value FROM al", "connections")
def _(t):
    return valued(Y.port_report(t.connections))
