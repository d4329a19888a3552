"""Queries: sources, projections, scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from duskline.functions import scalars as S
from duskline.operators import enrich as E
from duskline.sources import tables as T

from .registry import query, rnd

BUSINESS = "(hour(ts) BETWEEN 9 AND 17 AND isodow(ts) <= 5)"


@query("s04_standardize", "SELECT source AS source_ip, destination AS destination_ip, port AS destination_port, protocol, bytes FROM connections", "connections")
def _(t):
    raw = t.connections.select(F.col("source").alias("src_ip"), F.col("destination").alias("dst_ip"), F.col("port").alias("dst_port"), F.col("protocol").alias("proto"), F.col("bytes").alias("length"))
    return T.standardize(raw)


@query("s05_rename_shipper_fields", "SELECT request_id, ip AS src_ip, event_type, body AS raw_payload, 'splunk' AS source FROM requests", "requests")
def _(t):
    raw = t.requests.select("request_id", F.col("ip").alias("src"), F.col("event_type").alias("action"), F.col("body").alias("raw"))
    return T.rename_shipper_fields(raw, "splunk")


LOG_LINE = """SELECT event_id, CASE WHEN event_id % 17 = 0 THEN 'too short' ELSE concat(
  replace(cast(date_trunc('second', ts) AS string), ' ', 'T'), ' ', upper(event_type), ' host-', cast(user_id % 6 AS string), ' ',
  CASE event_id % 4 WHEN 0 THEN 'auth failed user login brute force' WHEN 1 THEN 'Unauthorized access' WHEN 2 THEN 'suspicious malware' ELSE 'all quiet here' END) END AS value FROM {events}"""


@query(
    "s06_read_logs",
    "SELECT epoch(strptime(p[1], '%Y-%m-%dT%H:%M:%S'))::BIGINT AS at, p[2] AS level, p[3] AS source, array_to_string(p[4:], ' ') AS message, "
    "round(0.3 * (" + " + ".join(f"cast(regexp_matches(array_to_string(p[4:], ' '), '(?i){x}') AS int)" for x in T.LOG_PATTERNS) + "), 6) AS threat_score "
    "FROM (SELECT string_split(value, ' ') AS p FROM (" + LOG_LINE.replace("{events}", "events") + ") l) x WHERE len(p) >= 4",
)
def _(t):
    logs = T.parse_logs(t.spark.sql(LOG_LINE, events=t.events))
    return logs.select(F.unix_timestamp("timestamp").alias("at"), "level", "source", "message", rnd("threat_score", 6).alias("threat_score"))


@query("s09_decode_domain_event", "SELECT cast(request_id AS string) AS request_id, ip, round(risk_score, 6) AS risk_score, severity AS threat_level, epoch_us(ts) // 1000000 AS at FROM requests", "requests")
def _(t):
    r = t.requests
    value = F.to_json(F.struct(F.col("request_id").cast("string").alias("request_id"), "ip", "risk_score", F.col("severity").alias("threat_level"), F.unix_millis(F.col("ts").cast("timestamp")).alias("timestamp_ms")))
    out = T.decode_domain_event(r.select(value.alias("value")), "threat")
    return out.select("request_id", "ip", rnd("risk_score", 6).alias("risk_score"), "threat_level", F.unix_seconds("timestamp").alias("at"))


@query(
    "s10_sanitize_points",
    "SELECT CASE WHEN event_id % 7 = 0 OR (event_id % 3 = 0 AND event_id % 2 = 0) THEN 'reject' ELSE 'valid' END AS outcome, count(*) AS n, "
    "cast(sum(CASE WHEN event_id % 7 = 0 OR (event_id % 3 = 0 AND event_id % 2 = 0) THEN 0 ELSE (event_id % 3 <> 0)::int + (event_id % 2 <> 0)::int END) AS bigint) AS n_fields FROM events GROUP BY 1",
)
def _(t):
    e = t.events
    m = F.when(F.col("event_id") % 7 == 0, "").otherwise("performance")
    fields = F.create_map(F.lit("a"), F.when(F.col("event_id") % 3 != 0, F.col("value")), F.lit("b"), F.when(F.col("event_id") % 2 != 0, F.col("value")))
    points = e.select(m.alias("measurement"), F.create_map(F.lit("t"), F.col("event_type")).alias("tags"), fields.alias("fields"), F.col("ts").cast("string").alias("timestamp"))
    good, bad = T.sanitize_points(points)
    rows = good.select(F.lit("valid").alias("outcome"), F.size("fields").alias("k")).unionByName(bad.select(F.lit("reject").alias("outcome"), F.lit(0).alias("k")))
    return rows.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"), F.sum("k").alias("n_fields"))


@query("s12_performance_points", "SELECT host, path AS endpoint, method, cast(status_code AS string) AS status_code, duration_ms AS response_time, 1.0::double AS request_count, (CASE WHEN status_code >= 400 THEN 1 ELSE 0 END)::double AS error_count, (epoch_us(ts) // 1000000) AS at FROM requests", "requests")
def _(t):
    return T.to_performance_points(t.requests).withColumn("at", F.unix_timestamp("ts")).drop("ts")


@query("s12_threat_points", "SELECT ip AS ip_address, event_type AS threat_type, severity, session_id, country, risk_score, status_code = 403 AS blocked FROM requests", "requests")
def _(t):
    return T.to_threat_points(t.requests).drop("ts")


@query("s12_behavior_points", "SELECT session_id, country AS location, 1.0::double AS action_count, (path LIKE '/api%')::int::double AS api_calls, (event_type = 'purchase')::int::double AS conversions FROM requests", "requests")
def _(t):
    return T.to_behavior_points(t.requests).drop("ts")


@query("s15_exposition_text", "SELECT concat('requests_total{host=\"', host, '\",method=\"', method, '\"} ', cast(count(*) AS string)) AS value FROM requests GROUP BY host, method", "requests")
def _(t):
    return T.to_exposition_text(t.requests.groupBy("host", "method").count(), "requests_total", ["host", "method"], "count")


@query("s16_audit_rows", "SELECT sha256(concat(cast(request_id AS string), '|', method)) AS audit_id, request_id, method AS action, cast(status_code AS string) AS status, cast(cast(ts AS date) AS string) AS day FROM requests", "requests")
def _(t):
    a = t.requests.select("request_id", F.col("method").alias("action"), F.col("status_code").cast("string").alias("status"), "ts")
    return T.audit_rows(a).withColumn("day", F.col("day").cast("string")).drop("ts")


@query(
    "p01_normalize_events",
    "SELECT cast(event_id AS string) AS event_id, 'app' AS source, CASE event_id % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE '0.0.0.0' END AS src_ip, CASE WHEN event_id % 2 = 0 THEN 'd' END AS dst_ip, "
    "event_type, CASE event_type WHEN 'error' THEN 'high' WHEN 'view' THEN 'medium' ELSE 'low' END AS severity, cast(user_id AS string) AS user_id FROM events",
)
def _(t):
    e = t.events
    payload = F.create_map(
        F.lit("id"), F.col("event_id").cast("string"), F.lit("src_ip"), F.when(F.col("event_id") % 3 == 0, "a").otherwise(""),
        F.lit("client_ip"), F.when(F.col("event_id") % 3 == 1, "b"), F.lit("target_ip"), F.when(F.col("event_id") % 2 == 0, "d"),
        F.lit("action"), F.col("event_type"), F.lit("userId"), F.col("user_id").cast("string"),
        F.lit("level"), F.when(F.col("event_type") == "error", "ERROR").when(F.col("event_type") == "view", "warn").otherwise("other"),
    )
    return S.normalize_events(e.select(F.lit("app").alias("source"), payload.alias("payload"))).select("event_id", "source", "src_ip", "dst_ip", "event_type", "severity", "user_id")


@query("p02_normalize_severity", "SELECT event_type, CASE event_type WHEN 'error' THEN 'high' ELSE 'low' END AS severity, count(*) AS n FROM events GROUP BY 1, 2")
def _(t):
    return t.events.select("event_type", S.normalize_severity(F.upper("event_type")).alias("severity")).groupBy("event_type", "severity").agg(F.count(F.lit(1)).alias("n"))


@query("p03_normalize_path", "SELECT page_id, lower(regexp_replace(regexp_replace(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*', ''), '[?#].*$', '')) AS path FROM pages")
def _(t):
    return t.pages.select("page_id", S.normalize_path("url").alias("path"))


@query("p04_normalize_user_agent", r"SELECT request_id, lower(trim(regexp_replace(regexp_replace(user_agent, '/[0-9.]+', '', 'g'), '\s+', ' ', 'g'))) AS agent FROM requests", "requests")
def _(t):
    return t.requests.select("request_id", S.normalize_user_agent("user_agent").alias("agent"))


@query("p05_location_key", "SELECT DISTINCT lower(concat_ws('|', country, region, city)) AS location FROM requests", "requests")
def _(t):
    return t.requests.select(S.location_key("country", "region", "city").alias("location")).distinct()


ACTION_SQL = """CASE WHEN status_code = 404 THEN 'error_404' WHEN status_code = 403 THEN 'error_403' WHEN status_code >= 500 THEN 'error_500' WHEN status_code >= 400 THEN 'error_404'
  WHEN contains(path, '/auth/') OR contains(path, '/login') THEN CASE WHEN method = 'POST' THEN CASE WHEN status_code = 200 THEN 'login_success' ELSE 'login_failure' END ELSE 'login_attempt' END
  WHEN contains(path, '/logout') THEN 'logout' WHEN path LIKE '/api/%' THEN 'api_call' WHEN contains(path, '/search') THEN 'search' WHEN method = 'POST' THEN 'form_submit'
  WHEN contains(path, '/download') OR contains(path, '.pdf') OR contains(path, '.zip') THEN 'download' WHEN method IN ('PUT', 'PATCH') THEN 'form_submit' WHEN method = 'DELETE' THEN 'api_call' ELSE 'page_view' END"""


@query("p06_classify_action", f"SELECT request_id, {ACTION_SQL} AS action FROM requests", "requests")
def _(t):
    return t.requests.select("request_id", S.classify_action().alias("action"))


@query(
    "p07_classify_context",
    "SELECT request_id, CASE WHEN ip LIKE '10.0.0.%' THEN 'suspicious' WHEN contains(path, '/admin') THEN 'privileged' WHEN contains(lower(user_agent), 'bot') THEN 'suspicious' "
    "WHEN risk_score > 0.8 THEN 'suspicious' WHEN risk_score > 0.6 THEN 'restricted' ELSE 'authenticated' END AS context FROM requests", "requests",
)
def _(t):
    return t.requests.select("request_id", S.classify_context().alias("context"))


@query("p08_classify_resource", r"SELECT path, CASE WHEN contains(path, '/admin') THEN 'admin' WHEN path LIKE '/api%' THEN 'api' WHEN regexp_matches(path, '\.[a-zA-Z0-9]+$') THEN 'file' ELSE 'endpoint' END AS class, count(*) AS n FROM requests GROUP BY 1, 2", "requests")
def _(t):
    return t.requests.groupBy("path", S.classify_resource("path").alias("class")).agg(F.count(F.lit(1)).alias("n"))


@query("p09_port_class", "SELECT CASE WHEN port < 1024 THEN 'well_known' WHEN port < 49152 THEN 'registered' ELSE 'dynamic' END AS class, count(*) AS n FROM connections GROUP BY 1", "connections")
def _(t):
    return t.connections.groupBy(S.port_class("port").alias("class")).agg(F.count(F.lit(1)).alias("n"))


IOC = "CASE event_id % 8 WHEN 0 THEN ip WHEN 1 THEN 'evil.example' WHEN 2 THEN 'https://a.example/x' WHEN 3 THEN 'a@b.example' WHEN 4 THEN md5(ip) WHEN 5 THEN '/tmp/x' WHEN 6 THEN 'HKEY_LOCAL' ELSE 'none at all' END"


@query("p10_classify_ioc", "SELECT request_id, CASE request_id % 8 WHEN 0 THEN 'ip_address' WHEN 1 THEN 'domain' WHEN 2 THEN 'url' WHEN 3 THEN 'email' WHEN 4 THEN 'md5_hash' WHEN 5 THEN 'file_path' WHEN 6 THEN 'registry_key' ELSE 'unknown' END AS type FROM requests", "requests")
def _(t):
    return t.requests.select("request_id", S.classify_ioc(F.expr(IOC.replace("event_id", "request_id"))).alias("type"))


@query("p11_temporal_context", f"SELECT event_id, hour(ts) AS hour, isodow(ts) - 1 AS weekday, {BUSINESS} AS is_business_hours, isodow(ts) >= 6 AS is_weekend FROM events")
def _(t):
    return t.events.select("event_id", *[v.alias(k) for k, v in S.temporal_context("ts").items()])


@query("p12_time_pattern", f"SELECT CASE WHEN {BUSINESS} THEN 'peak_hours' WHEN isodow(ts) >= 6 THEN 'weekend' ELSE 'off_hours' END AS pattern, count(*) AS n FROM events GROUP BY 1")
def _(t):
    return t.events.groupBy(S.time_pattern("ts").alias("pattern")).agg(F.count(F.lit(1)).alias("n"))


@query("p13_geo_zone", "SELECT country, CASE WHEN country IN ('CN','RU','KP') THEN 'high_risk' ELSE 'moderate' END AS zone, (CASE WHEN country IN ('CN','RU','KP','IR') THEN 0.8 ELSE 0.2 END)::double AS risk, count(*) AS n FROM requests GROUP BY 1, 2, 3", "requests")
def _(t):
    return t.requests.groupBy("country", S.geo_zone("country").alias("zone"), S.country_risk("country").alias("risk")).agg(F.count(F.lit(1)).alias("n"))


@query("p14_suspicious_predicates", f"SELECT request_id, regexp_matches(lower(user_agent), 'bot|crawler|spider|scraper|curl|wget|python|java|perl|ruby|php') AS agent, regexp_matches(ip, '{S.PRIVATE_IP}') AS private, regexp_matches(path, '{S.SUSPICIOUS_ITEM}') AS item FROM requests", "requests")
def _(t):
    return t.requests.select("request_id", S.is_suspicious_ua("user_agent").alias("agent"), S.is_private_ip("ip").alias("private"), S.is_suspicious_item("path").alias("item"))


@query("p15_browser_anomaly", "SELECT user_agent, NOT regexp_matches(user_agent, '(?i)mozilla/5\\.0.*(chrome|firefox|safari|edge)') AS anomaly, contains(lower(user_agent), 'bot') AS bot, count(*) AS n FROM requests GROUP BY 1, 2, 3", "requests")
def _(t):
    return t.requests.groupBy("user_agent", S.browser_anomaly("user_agent").alias("anomaly"), S.is_bot("user_agent").alias("bot")).agg(F.count(F.lit(1)).alias("n"))


@query("p16_filter_nodes", "SELECT c_custkey, c_name FROM customer WHERE contains(c_name, '7') ORDER BY c_custkey LIMIT 20 OFFSET 5")
def _(t):
    return E.filter_nodes(t.customer, "c_name", "7", "c_custkey", 5, 20).select("c_custkey", "c_name")


@query("p17_list_edges", "SELECT src, dst FROM edges WHERE type = 'CONNECTED_TO' ORDER BY src, dst LIMIT 50 OFFSET 3", "edges")
def _(t):
    return E.list_edges(t.edges, "CONNECTED_TO", 3, 50).select("src", "dst")


@query("p18_suppress_whitelisted", "SELECT request_id, ip FROM requests WHERE ip NOT IN (SELECT ip FROM assets WHERE criticality_score / 4 <= 0.5)", "requests", "assets")
def _(t):
    rules = t.assets.select(F.col("ip").alias("value"), (F.col("criticality_score") / 4).alias("tune"))
    return E.suppress_whitelisted(t.requests, rules).select("request_id", "ip")


@query("p19_deception_hits", "SELECT request_id, path, 'honeypot' AS trap FROM requests WHERE path = '/admin/config?debug=1' OR path = '/api/items/7'", "requests")
def _(t):
    traps = t.spark.createDataFrame([("/admin/config?debug=1", "honeypot"), ("/api/items/7", "honeypot")], "trap_path string, trap string")
    return E.deception_hits(t.requests, traps).select("request_id", "path", "trap")


@query("p20_interpolate", "SELECT request_id, concat('block ', ip, ' for ', event_type, ' {{x}}') AS step FROM requests", "requests")
def _(t):
    return t.requests.select("request_id", S.interpolate(F.lit("block {{ip}} for {{kind}} {{x}}"), F.create_map(F.lit("ip"), F.col("ip"), F.lit("kind"), F.col("event_type")), ["ip", "kind", "x"]).alias("step"))


@query("f01_shannon_entropy", f"WITH d AS (SELECT DISTINCT url FROM pages), ch AS (SELECT url, unnest(string_split(url, '')) AS c FROM d), n AS (SELECT url, c, count(*) AS k FROM ch GROUP BY ALL), s AS (SELECT *, sum(k) OVER (PARTITION BY url) AS tot FROM n) SELECT url, round(-sum(k / tot * log2(k / tot)), 6) AS entropy FROM s GROUP BY url")
def _(t):
    return t.pages.select("url").distinct().select("url", rnd(S.shannon_entropy("url"), 6).alias("entropy"))


@query("f02_count_chars", "SELECT doc_id, cast(len(regexp_extract_all(text, '[.,;!?]')) AS bigint) AS marks FROM documents")
def _(t):
    return t.documents.select("doc_id", S.count_chars("text", ".,;!?").cast("long").alias("marks"))


@query(
    "f03_extract_matches",
    "WITH p AS (SELECT page_id, url, regexp_split_to_array(url, '[0-9]+') AS a, regexp_extract_all(url, '[0-9]+') AS m FROM pages), i AS (SELECT *, unnest(range(1, len(m) + 1)) AS k FROM p), "
    "s AS (SELECT page_id, url, m[k] AS matched, (coalesce(list_sum(list_transform(a[1:k], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[1:k - 1], lambda x: length(x))), 0))::int AS start FROM i) "
    "SELECT page_id, matched, start, (start + length(matched))::int AS stop, substr(url, greatest(start - 3, 0) + 1, start + length(matched) + 3 - greatest(start - 3, 0)) AS context FROM s",
)
def _(t):
    m = F.explode(S.extract_matches("url", "[0-9]+", 3)).alias("m")
    return t.pages.select("page_id", m).select("page_id", "m.matched", "m.start", "m.stop", "m.context")


@query("f04_content_hash", "SELECT doc_id, sha256(text) AS sha, substr(sha256(text), 1, 16) AS short_id FROM documents")
def _(t):
    h = S.content_hash("text")
    return t.documents.select("doc_id", h["sha256"].alias("sha"), h["short_id"].alias("short_id"))


@query("f05_parse_time", "SELECT event_id, CASE event_id % 3 WHEN 2 THEN NULL ELSE (epoch_us(ts) // 1000000) END AS at FROM events")
def _(t):
    text = F.when(F.col("event_id") % 3 == 0, F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).when(F.col("event_id") % 3 == 1, F.unix_millis(F.col("ts").cast("timestamp")).cast("string")).otherwise("not a time")
    return t.events.select("event_id", F.unix_seconds(S.parse_time(text)).alias("at"))


@query("f06_parse_duration_size", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN 604800 WHEN 1 THEN 31536000 WHEN 2 THEN 1800 END::bigint AS seconds, CASE event_id % 3 WHEN 0 THEN 10737418240 WHEN 1 THEN 524288 END::bigint AS bytes FROM events")
def _(t):
    d = F.when(F.col("event_id") % 4 == 0, "7d").when(F.col("event_id") % 4 == 1, "1y").when(F.col("event_id") % 4 == 2, "30m").otherwise("soon")
    z = F.when(F.col("event_id") % 3 == 0, "10GB").when(F.col("event_id") % 3 == 1, "512KB").otherwise("much")
    return t.events.select("event_id", S.parse_duration(d).alias("seconds"), S.parse_size(z).alias("bytes"))


@query("f07_clamp_ratio_sigmoid", "SELECT event_id, round(greatest(0, least(1, value / 300)), 6) AS clamped, round(value / greatest(user_id - 5, 0.001), 6) AS ratio, round(1 / (1 + exp(-(value - 250) / 100)), 6) AS sig FROM events")
def _(t):
    return t.events.select("event_id", rnd(S.clamp01(F.col("value") / 300), 6).alias("clamped"), rnd(S.safe_ratio("value", (F.col("user_id") - 5).cast("double")), 6).alias("ratio"), rnd(S.sigmoid((F.col("value") - 250) / 100), 6).alias("sig"))


@query("f08_recency", "SELECT event_id, round(exp(-(epoch(TIMESTAMP '2024-02-01') - epoch(ts)) / 604800.0), 6) AS weight FROM events")
def _(t):
    return t.events.select("event_id", rnd(S.recency("ts", "2024-02-01", 604800), 6).alias("weight"))


@query("f09_time_correlation", "WITH g AS (SELECT event_id, abs(epoch_us(ts) - epoch_us(date_trunc('hour', ts))) AS gap_us FROM events) SELECT event_id, gap_us, greatest(0.0::double, 1.0::double - gap_us / 300e6) AS corr FROM g")
def _(t):
    """The gap in whole microseconds is divided once, so both sides have the same double and nothing is rounded."""
    hour = F.date_trunc("hour", "ts")
    return t.events.select("event_id", S.time_gap("ts", hour).alias("gap_us"), S.time_correlation("ts", hour).alias("corr"))


@query("f10_json_blob", "SELECT request_id FROM requests WHERE contains(lower(body), 'powershell') OR contains(lower(path), 'powershell')", "requests")
def _(t):
    return S.json_blob(t.requests.select("request_id", "body", "path")).filter(F.col("blob").contains("powershell")).select("request_id")


@query("f11_payload_keys", "SELECT event_id, array_to_string(json_keys(props), ',') AS keys FROM events")
def _(t):
    return t.events.select("event_id", F.array_join(S.payload_keys("props"), ",").alias("keys"))


@query(
    "f12_text_features",
    r"SELECT doc_id, length(text) AS text_length, len(w) AS word_count, len(list_distinct(w)) AS unique_words, len(regexp_extract_all(text, '!')) AS exclamations, len(regexp_extract_all(text, '\?')) AS questions, len(regexp_extract_all(text, '[A-Z]')) AS capitals "
    r"FROM (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w FROM documents)",
)
def _(t):
    return t.documents.select("doc_id", *[v.cast("long").alias(k) for k, v in S.text_features("text").items()])


@query("f13_temporal_features", "SELECT user_id, round(avg(hour(ts)), 6) AS hour_mean, round(stddev_pop(hour(ts)), 6) AS hour_std, count(DISTINCT hour(ts)) AS hours, round(avg(isodow(ts) - 1), 6) AS day_mean, round(stddev_pop(isodow(ts) - 1), 6) AS day_std, count(DISTINCT isodow(ts)) AS days FROM events GROUP BY user_id")
def _(t):
    from duskline.operators.series import temporal_features

    f = temporal_features(t.events, ["user_id"], "ts")
    return f.withColumns({c: rnd(c, 6) for c in ("hour_mean", "hour_std", "day_mean", "day_std")})


@query("f14_hash_quality", "SELECT 0.0::double AS collision_rate, true AS even FROM (SELECT count(text) AS n FROM documents)")
def _(t):
    """No collisions of xxhash64 over document texts, and buckets as even as chance lets them be (Poisson)."""
    q = S.hash_quality(t.documents.dropDuplicates(["text"]), "text")
    return q.select("collision_rate", (F.col("bucket_variance") < 2 * F.col("bucket_mean")).alias("even"))
