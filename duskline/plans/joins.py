"""Queries: joins, sorts, limits, set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from duskline.functions import scalars as S
from duskline.operators import enrich as E
from duskline.operators import explain as X

from .registry import query, rnd


@query(
    "j01_enrich_assets",
    "SELECT request_id, coalesce(a.c, h.c, 1.0)::double AS criticality FROM requests r LEFT JOIN (SELECT ip, max(criticality_score) c FROM assets GROUP BY ip) a ON r.ip = a.ip "
    "LEFT JOIN (SELECT hostname, max(criticality_score) c FROM assets GROUP BY hostname) h ON r.host = h.hostname", "requests", "assets",
)
def _(t):
    return E.enrich_assets(t.requests, t.assets).select("request_id", F.col("criticality").cast("double").alias("criticality"))


RANGES = "SELECT n_nationkey * 65536 * 2 + 167772160 AS start_ip, n_nationkey * 65536 * 2 + 167772160 + 70000 AS end_ip, n_name AS geo FROM {nation}"


@query(
    "j02_enrich_geo",
    "SELECT request_id, geo FROM (SELECT request_id, list_reduce(list_transform(string_split(ip, '.'), lambda x: x::bigint), lambda a, b: a * 256 + b) AS n FROM requests) r LEFT JOIN (" + RANGES.replace("{nation}", "nation") + ") g ON n BETWEEN start_ip AND end_ip", "requests",
)
def _(t):
    return E.enrich_geo(t.requests.select("request_id", "ip"), t.spark.sql(RANGES, nation=t.nation)).select("request_id", "geo")


INTEL_SQL = "greatest(coalesce(virustotal_score, 0), coalesce(abuseipdb_score, 0))"


@query(
    "j03_enrich_threat_intel",
    f"SELECT request_id, round({INTEL_SQL}, 6)::double AS intel_score, CASE WHEN {INTEL_SQL} >= 80 THEN 'malicious' WHEN {INTEL_SQL} >= 40 THEN 'suspicious' ELSE 'clean' END AS reputation, "
    "concat_ws(',', CASE WHEN virustotal_score >= 60 THEN 'virustotal' END, CASE WHEN abuseipdb_score >= 60 THEN 'abuseipdb' END) AS tags FROM requests LEFT JOIN intel USING (ip)", "requests", "intel",
)
def _(t):
    return E.enrich_threat_intel(t.requests, t.intel).select("request_id", rnd("intel_score", 6).alias("intel_score"), "reputation", F.array_join("intel_tags", ",").alias("tags"))


@query("j04_ip_reputation", f"SELECT ip, round({INTEL_SQL}, 6)::double AS intel_score, CASE WHEN {INTEL_SQL} >= 80 THEN 'malicious' WHEN {INTEL_SQL} >= 40 THEN 'suspicious' ELSE 'clean' END AS reputation FROM (SELECT DISTINCT ip FROM requests) LEFT JOIN intel USING (ip)", "requests", "intel")
def _(t):
    return E.ip_reputation(t.requests, t.intel).withColumn("intel_score", rnd("intel_score", 6))


@query("j05_ioc_reputation", "SELECT request_id, CASE WHEN ip IN (SELECT ip FROM assets) THEN 0.1 WHEN ip IN (SELECT ip FROM intel WHERE virustotal_score > 50) THEN 0.9 ELSE 0.5 END::double AS reputation FROM requests", "requests", "assets", "intel")
def _(t):
    r = t.requests.select("request_id", F.col("ip").alias("ioc"))
    return E.ioc_reputation(r, t.intel.filter("virustotal_score > 50").select(F.col("ip").alias("ioc")), t.assets.select(F.col("ip").alias("ioc"))).select("request_id", "reputation")


@query(
    "j06_pair_requests",
    "SELECT a.request_id AS a_id, b.request_id AS b_id, round(abs(epoch_us(a.ts) - epoch_us(b.ts)) / 1e6, 3) AS gap FROM requests a JOIN requests b ON a.path = b.path AND a.ip < b.ip AND abs(epoch_us(a.ts) - epoch_us(b.ts)) <= 300000000", "requests",
)
def _(t):
    p = E.pair_within(t.requests.select("request_id", "ip", "ts", "path"), "ip", "ts", 300, "path")
    return p.select(F.col("a.request_id").alias("a_id"), F.col("b.request_id").alias("b_id"), rnd("gap_seconds", 3).alias("gap"))


@query("j07_pair_users", "SELECT a.request_id AS a_id, b.request_id AS b_id FROM requests a JOIN requests b ON a.country = b.country AND a.user_id < b.user_id AND abs(epoch_us(a.ts) - epoch_us(b.ts)) <= 300000000", "requests")
def _(t):
    p = E.pair_within(t.requests.select("request_id", "user_id", "ts", "country"), "user_id", "ts", 300, "country")
    return p.select(F.col("a.request_id").alias("a_id"), F.col("b.request_id").alias("b_id"))


@query(
    "j14_attach_baseline",
    "SELECT e.event_id, b.value AS baseline FROM events e ASOF LEFT JOIN (SELECT user_id, ts, value FROM events WHERE event_type = 'purchase') b ON e.user_id = b.user_id AND e.ts >= b.ts WHERE e.event_type <> 'purchase'",
)
def _(t):
    e = t.events.select("event_id", "user_id", "ts", "value", "event_type")
    out = E.attach_baseline(e.filter("event_type <> 'purchase'").select("event_id", "user_id", "ts"), e.filter("event_type = 'purchase'"), "user_id", "ts", "value")
    return out.select("event_id", "baseline")


POLICIES = [
    ("api", True, 10, "/api/*", []), ("api_post", True, 20, "/api/*", ["POST"]), ("admin", True, 30, "/admin/*", []),
    ("off", False, 99, "*", []), ("default", True, 1, "*", []),
]


def policies(t):
    return t.spark.createDataFrame(POLICIES, "policy_id string, enabled boolean, priority int, endpoint string, methods array<string>")


@query("j15_match_policy", "SELECT request_id, CASE WHEN path LIKE '/admin/%' THEN 'admin' WHEN path LIKE '/api/%' AND method = 'POST' THEN 'api_post' WHEN path LIKE '/api/%' THEN 'api' ELSE 'default' END AS policy_id FROM requests", "requests")
def _(t):
    return E.match_policy(t.requests, policies(t)).select("request_id", "policy_id")


@query("l11_apply_blocks", "SELECT request_id, EXISTS (SELECT 1 FROM assets b WHERE b.ip = r.ip AND r.ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-12') AS blocked FROM requests r", "requests", "assets")
def _(t):
    blocks = t.assets.select("ip", F.expr("TIMESTAMP_NTZ '2024-01-05'").alias("start"), F.expr("TIMESTAMP_NTZ '2024-01-12'").alias("end"))
    return E.apply_blocks(t.requests, blocks).select("request_id", "blocked")


@query("t01_top_k", "SELECT ip, count(*) AS n FROM requests GROUP BY ip ORDER BY n DESC, ip LIMIT 10", "requests")
def _(t):
    return E.top_k(t.requests, "ip", 10)


@query("t02_top_k_per_group", "SELECT event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) <= 5")
def _(t):
    return E.top_k_per_group(t.events, ["event_type"], [F.desc("value"), F.col("event_id")], 5).select("event_type", "event_id", "value")


@query("t03_rank_matches", "SELECT request_id, severity FROM requests ORDER BY CASE severity WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END DESC, risk_score DESC, request_id LIMIT 100", "requests")
def _(t):
    return X.rank_matches(t.requests, "severity", "risk_score", "request_id").limit(100).select("request_id", "severity")


@query("t04_top_violators", "SELECT ip, count(*) AS violations, max(epoch_us(ts) // 1000000) AS last_seen FROM requests WHERE status_code >= 400 GROUP BY ip ORDER BY violations DESC, ip LIMIT 10", "requests")
def _(t):
    v = E.top_violators(t.requests, F.col("status_code") >= 400)
    return v.withColumn("last_seen", F.unix_timestamp("last_seen"))


@query("t05_page", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 50")
def _(t):
    return E.page(t.orders, [F.desc("o_totalprice"), "o_orderkey"], 50, 25).select("o_orderkey", "o_totalprice")


@query("t06_keep_last", "SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 20")
def _(t):
    return E.top_k_per_group(t.events, ["user_id"], [F.desc("ts"), F.desc("event_id")], 20).select("user_id", "event_id")


@query("u01_combine", "SELECT s_suppkey AS id, s_acctbal AS balance, NULL::varchar AS segment FROM supplier UNION ALL SELECT c_custkey, c_acctbal, c_mktsegment FROM customer")
def _(t):
    return E.combine(t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("balance")), t.customer.select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment")))


@query("u02_distinct_values", "SELECT user_id, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS types FROM events GROUP BY user_id")
def _(t):
    return E.distinct_values(t.events, "user_id", "event_type").select("user_id", F.array_join("values", ",").alias("types"))


@query("u03_common_tokens", "SELECT request_id, array_to_string(list_sort(list_distinct(list_intersect(list_filter(regexp_split_to_array(lower(path), '[/ ]'), lambda y: length(y) > 0), list_filter(regexp_split_to_array(lower(concat('/api/items/', event_type)), '[/ ]'), lambda y: length(y) > 0)))), ',') AS common FROM requests", "requests")
def _(t):
    return t.requests.select("request_id", F.array_join(E.common_tokens(F.col("path"), F.concat(F.lit("/api/items/"), "event_type")), ",").alias("common"))


@query("u04_new_items", "SELECT user_id, CASE WHEN p THEN 'kept' ELSE 'new' END AS state FROM (SELECT user_id, bool_or(ts < TIMESTAMP '2024-01-02') AS p, bool_or(ts >= TIMESTAMP '2024-01-02' AND ts < TIMESTAMP '2024-01-04') AS c FROM events GROUP BY user_id) WHERE c")
def _(t):
    before = t.events.filter("ts < TIMESTAMP_NTZ '2024-01-02'").select("user_id")
    now = t.events.filter("ts >= TIMESTAMP_NTZ '2024-01-02' AND ts < TIMESTAMP_NTZ '2024-01-04'").select("user_id")
    return E.new_items(now, before)


@query(
    "u05_dedupe_alerts",
    "WITH a AS (SELECT * FROM requests WHERE severity IN ('medium', 'high') QUALIFY row_number() OVER (PARTITION BY event_type, ip, time_bucket(INTERVAL '1 hour', ts) ORDER BY ts, request_id) = 1) "
    "SELECT request_id, sha256(concat(event_type, '|', ip)) AS alert_hash FROM a QUALIFY row_number() OVER (PARTITION BY date_trunc('minute', ts) ORDER BY ts, request_id) <= 2", "requests",
)
def _(t):
    return E.dedupe_alerts(t.requests, ["event_type", "ip"], "1 hour", 2, 2).select("request_id", "alert_hash")
