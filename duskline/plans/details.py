"""Queries: explanations of scores, patterns, evaluation, and whole results of single operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from duskline.functions import scalars as S
from duskline.operators import detect as D
from duskline.operators import enrich as E
from duskline.operators import explain as X
from duskline.operators import graph as G
from duskline.operators import ml as M
from duskline.operators import sequence as Q
from duskline.operators import series as W
from duskline.operators import sketch as K

from .detection import BAND, SIGS
from .entities import CS
from .registry import query, rnd
from .serieq import BASE, SLOPE, fold

KEY, ORDER, VALUE = ["user_id"], ["ts", "event_id"], "value"


def ev(t):
    return t.events.select("user_id", "event_id", "ts", "value")


# --- explanations -------------------------------------------------------------------------------


@query("g02_request_patterns", "SELECT session_id, path, method, count(*) AS frequency, hour(min(ts))::int AS hour, (isodow(min(ts)) - 1)::int AS weekday FROM requests GROUP BY 1, 2, 3", "requests")
def _(t):
    return X.request_patterns(t.requests)


REFERRER = "CASE request_id % 4 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE concat('https://ref', cast(request_id % 5 AS string), '.example/') END"


@query(
    "g02_referrers",
    f"WITH r AS (SELECT session_id, nullif({REFERRER}, '') AS ref FROM requests), c AS (SELECT session_id, ref, count(*) AS n FROM r GROUP BY 1, 2) SELECT session_id, coalesce(sum(CASE WHEN ref IS NULL THEN n END), 0)::bigint AS direct_access, coalesce(sum(CASE WHEN ref IS NOT NULL THEN n END), 0)::bigint AS referred, count(ref) AS referrers, arg_min(ref, struct_pack(n := -n, r := ref)) FILTER (WHERE ref IS NOT NULL) AS top_referrer FROM c GROUP BY 1",
    "requests",
)
def _(t):
    return X.referrer_stats(t.requests.withColumn("referrer", F.expr(REFERRER)), "session_id", "referrer")


LEVEL7 = BAND("risk_score", D.BANDS_GO, "minimal")
OPEN_HOURS = "(hour(ts) BETWEEN 9 AND 17 AND isodow(ts) <= 5)"


@query(
    "g07_explanations",
    f"WITH x AS (SELECT *, {LEVEL7} AS lv, country = 'RU' AND parity = 0 AS vpn, country = 'CN' AND parity = 1 AS proxy FROM requests) SELECT request_id, lv AS level, "
    f"concat_ws(',', CASE WHEN duration_ms / 400 > 0.7 THEN concat('behavioral_anomaly:0.4:', round(duration_ms / 400, 3)::varchar) END, CASE WHEN vpn OR proxy THEN 'anonymization_tools:0.3:0.8' END, CASE WHEN NOT {OPEN_HOURS} THEN 'off_hours_access:0.2:0.6' END) AS factors, "
    "concat_ws('; ', CASE lv WHEN 'critical' THEN 'Block request immediately; Trigger security alert; Log detailed forensic data' WHEN 'high' THEN 'Apply enhanced authentication; Increase monitoring; Rate limit aggressively' WHEN 'medium' THEN 'Monitor closely; Apply standard rate limiting' WHEN 'low' THEN 'Allow with normal monitoring' END, CASE WHEN vpn THEN 'Verify user identity due to VPN usage' END, CASE WHEN method <> 'POST' AND lv <> 'low' THEN 'Encourage user authentication' END) AS recommendations, "
    "concat_ws(',', CASE WHEN risk_score > 0.8 THEN 'malicious_behavior' END, CASE WHEN risk_score > 0.6 THEN 'suspicious_pattern' END, CASE WHEN risk_score > 0.4 THEN 'anomaly_detected' END) AS threat_types FROM x",
    "requests",
)
def _(t):
    r = t.requests.withColumn("level", S.risk_level("risk_score", D.BANDS_GO, "minimal"))
    c, p = F.col("country"), F.col("parity")
    x = X.explain_score(
        F.col("risk_score"), F.col("level"), F.col("duration_ms") / 400, (c == "RU") & (p == 0), (c == "CN") & (p == 1),
        S.temporal_context("ts")["is_business_hours"], F.col("method") == "POST",
    )
    own = F.round(F.col("duration_ms") / 400 + 3e-8, 3).cast("string")
    text = lambda f: F.concat_ws(":", f["factor"], f["weight"].cast("string"), F.when(f["factor"] == "behavioral_anomaly", own).otherwise(f["impact"].cast("string")))
    return r.select(
        "request_id", "level", F.array_join(F.transform(x["factors"], text), ",").alias("factors"),
        F.array_join(x["recommendations"], "; ").alias("recommendations"), F.array_join(x["threat_types"], ",").alias("threat_types"),
    )


@query(
    "g09_signature_fusion",
    f"WITH m AS (SELECT request_id, avg(CASE severity WHEN 'critical' THEN 0.9 WHEN 'high' THEN 0.7 WHEN 'medium' THEN 0.5 ELSE 0.3 END) AS s, avg(confidence) AS c, string_agg(DISTINCT category, ',' ORDER BY category) AS k FROM ({SIGS}) GROUP BY 1), "
    "x AS (SELECT request_id, coalesce(k, '') AS threat_types, least(1, coalesce(s, 0) * 0.3 + risk_score * 0.25 + parity / 5 * 0.25 + duration_ms / 500 * 0.2) AS v, least(1, coalesce(c, 0) * 0.3 + (1 - (request_id % 7) / 10) * 0.25 + (1 - abs(parity / 5)) * 0.25 + (1 - duration_ms / 500) * 0.2) AS f FROM requests LEFT JOIN m USING (request_id)) "
    f"SELECT request_id, round(v, 5)::double AS score, round(f, 5)::double AS confidence, {BAND('v', D.BANDS_RS, 'minimal')} AS level, CASE WHEN v >= 0.9 THEN 'quarantine' WHEN v >= 0.7 THEN 'block' WHEN v >= 0.5 THEN 'challenge' WHEN v >= 0.3 THEN 'monitor' ELSE 'allow' END AS action, threat_types FROM x",
    "requests",
)
def _(t):
    r = t.requests.withColumns({"rep": F.col("parity") / 5, "odd": F.col("duration_ms") / 500, "dev": (F.col("request_id") % 7) / 10})
    x = X.fuse_signature_scores(r, D.signature_match(t.requests, "body", "request_id"), "request_id", "risk_score", "rep", "odd", "dev")
    return x.select(
        "request_id", rnd("fused_score").alias("score"), rnd("fused_confidence").alias("confidence"), F.col("fused_level").alias("level"), "action",
        F.array_join("threat_types", ",").alias("threat_types"),
    )


@query(
    "g19_intel_assessment",
    "WITH g AS (SELECT user_id, avg(CASE WHEN parity <> 3 THEN risk_score END) AS a, max(CASE WHEN status_code = 403 THEN risk_score END) AS b, nullif(count_if(status_code = 500), 0) AS c, nullif(count_if(severity = 'high'), 0) AS d FROM requests GROUP BY 1), "
    "s AS (SELECT *, coalesce(a * 0.3, 0) + coalesce(b * 0.25, 0) + least(1, coalesce(c, 0) / 10) * 0.2 + least(1, coalesce(d, 0) / 20) * 0.25 AS v FROM g) "
    f"SELECT user_id, round(v, 5) AS score, {BAND('v', D.BANDS_GO, 'minimal')} AS level, CASE WHEN v >= 0.8 THEN 'immediate' WHEN v >= 0.6 THEN 'high' WHEN v >= 0.4 THEN 'medium' ELSE 'low' END AS priority, ((a IS NOT NULL)::int + (b IS NOT NULL)::int + (c IS NOT NULL)::int + (d IS NOT NULL)::int) / 4 AS confidence, "
    "concat_ws(',', CASE WHEN a IS NOT NULL THEN 'ioc_reputation' END, CASE WHEN b IS NOT NULL THEN 'actor_attribution' END, CASE WHEN c IS NOT NULL THEN 'network_anomalies' END, CASE WHEN d IS NOT NULL THEN 'text_indicators' END) AS factors FROM s",
    "requests",
)
def _(t):
    g = t.requests.groupBy("user_id").agg(
        F.avg(F.when(F.col("parity") != 3, F.col("risk_score"))).alias("a"), F.max(F.when(F.col("status_code") == 403, F.col("risk_score"))).alias("b"),
        F.count_if(F.col("status_code") == 500).alias("c"), F.count_if(F.col("severity") == "high").alias("d"),
    )
    x = g.select("user_id", X.intel_risk(*map(F.col, "abcd")).alias("x")).select("user_id", "x.*")
    return x.withColumn("score", rnd("score")).withColumn("factors", F.array_join(F.transform("factors", lambda f: f["factor"]), ","))


TRAPS = "SELECT 'honeypot_access' AS type, concat('/api/orders?id=', cast(p_partkey % 9 AS string)) AS trap FROM part WHERE p_partkey % 9 < 3 UNION SELECT 'credential_trap', concat('c', cast(p_partkey AS string)) FROM part WHERE p_partkey % 50 = 7 UNION SELECT 'decoy_file_access', 'hello world 5' FROM part"
SCORE16 = "(CASE WHEN contains(lower(user_agent), 'bot') THEN 2 ELSE 0 END + CASE WHEN contains(lower(user_agent), 'curl') THEN 3 ELSE 0 END + CASE WHEN contains(lower(user_agent), 'python') THEN 3 ELSE 0 END + CASE WHEN ip LIKE '192.168.%' THEN 1 ELSE 0 END + CASE WHEN method = 'POST' THEN 1 ELSE 0 END + CASE WHEN length(body) > 0 THEN 1 ELSE 0 END)"


@query(
    "d16_deception_traps",
    f"WITH t AS ({TRAPS}), h AS (SELECT request_id, type, trap, {SCORE16} AS s FROM requests JOIN t ON (type = 'honeypot_access' AND trap = path) OR (type = 'credential_trap' AND trap = concat('c', user_id::varchar)) OR (type = 'decoy_file_access' AND trap = body)), l AS (SELECT request_id, type, trap, CASE WHEN type = 'credential_trap' OR s >= 5 THEN 'critical' WHEN s >= 3 THEN 'high' WHEN s >= 1 THEN 'medium' ELSE 'low' END AS level FROM h) "
    "SELECT *, CASE level WHEN 'critical' THEN 1.0 WHEN 'high' THEN 0.75 WHEN 'medium' THEN 0.5 ELSE 0.25 END::double AS threat_level FROM l",
    "requests",
)
def _(t):
    traps = t.spark.sql(TRAPS.replace("FROM part", "FROM {part}"), part=t.part)
    r = t.requests.withColumn("credential", F.concat(F.lit("c"), F.col("user_id").cast("string")))
    return X.deception_events(r, traps, "request_id", {"honeypot_access": "path", "credential_trap": "credential", "decoy_file_access": "body"})


@query(
    "g13_tier_metrics",
    "WITH x AS (SELECT CASE WHEN risk_score BETWEEN 0 AND 0.3 THEN 'monitor' WHEN risk_score BETWEEN 0.3 AND 0.5 THEN 'warn' WHEN risk_score BETWEEN 0.5 AND 0.7 THEN 'restrict' WHEN risk_score BETWEEN 0.7 AND 0.85 THEN 'block' WHEN risk_score BETWEEN 0.85 AND 1 THEN 'isolate' END AS tier, duration_ms FROM requests) SELECT tier, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 5)::double AS share, round(avg(duration_ms), 4) AS mean_latency FROM x GROUP BY 1",
    "requests",
)
def _(t):
    m = X.response_metrics(D.response_tier(t.requests, "risk_score", "ip", "ts", "request_id"), "tier", "duration_ms")
    return m.withColumn("share", rnd("share")).withColumn("mean_latency", rnd("mean_latency", 4))


STATUS = "CASE request_id % 3 WHEN 0 THEN 'resolved' WHEN 1 THEN 'open' END"


@query("g15_expire_alerts", f"SELECT request_id, {STATUS} AS status FROM requests WHERE NOT coalesce({STATUS} = 'resolved' AND ts < TIMESTAMP '2024-01-16 06:00:00' - INTERVAL 24 HOUR, false)", "requests")
def _(t):
    a = t.requests.select("request_id", F.expr(STATUS).alias("status"), F.col("ts").alias("updated_at"))
    return X.expire_alerts(a, "2024-01-16 06:00:00").select("request_id", "status")


# --- sketches, sequences, sets ------------------------------------------------------------------


@query("k03_top_items", "SELECT ip, n AS estimate, row_number() OVER (ORDER BY n DESC, ip)::int AS rank FROM (SELECT ip, count(*) AS n FROM requests GROUP BY ip) ORDER BY n DESC, ip LIMIT 10", "requests")
def _(t):
    """The sketch is wide enough for these items that the least of their cells is the true count."""
    return K.cms_top_k(K.cms_build(t.requests, "ip", 0.0001), t.requests, "ip", 10, eps=0.0001)


KIND = "CASE WHEN contains(lower(user_agent), 'bot') THEN 'bot' WHEN user_agent LIKE 'Mozilla%' THEN 'browser' ELSE 'tool' END"


@query("k11_visitors_by_geo", "WITH g AS (SELECT country, count(DISTINCT ip) AS visitors FROM requests GROUP BY 1) SELECT *, round(visitors * 100.0 / sum(visitors) OVER (), 4)::double AS percentage FROM g", "requests")
def _(t):
    return K.visitors_by_geo(t.requests).withColumn("percentage", rnd("percentage", 4))


@query("k11_visitors_by_agent", f"WITH g AS (SELECT {KIND} AS kind, count(DISTINCT ip) AS visitors FROM requests GROUP BY 1) SELECT *, round(visitors * 100.0 / sum(visitors) OVER (), 4)::double AS percentage FROM g", "requests")
def _(t):
    return K.visitors_by_agent(t.requests).withColumn("percentage", rnd("percentage", 4))


TP = "l AS (SELECT ts, lag(event_type) OVER (PARTITION BY session_id ORDER BY ts, request_id) AS context, event_type AS next FROM requests), m AS (SELECT context, next, count(*) AS c, max(epoch_us(ts)) AS last FROM l WHERE context IS NOT NULL GROUP BY 1, 2), p AS (SELECT *, (c + 0.5) / (sum(c) OVER w + 0.5 * count(*) OVER w) AS pr, least(0.95, c / 100 * exp(-greatest((epoch_us(TIMESTAMP '2024-02-01') - last) / 3.6e9, 0) / 168)) AS conf FROM m WINDOW w AS (PARTITION BY context))"


def request_matrix(t):
    r = t.requests.select("session_id", "ts", "request_id", "event_type")
    return Q.transition_probs(r, "session_id", ["ts", "request_id"], "event_type", "ts", "2024-02-01 00:00:00", lam=0.5)


@query("q03_transition_confidence", f"WITH {TP} SELECT context, next, c AS count, last AS last_seen, round(pr, 5) AS probability, round(conf, 5) AS confidence FROM p", "requests")
def _(t):
    seen = F.unix_micros(F.col("last_seen").cast("timestamp"))
    return request_matrix(t).withColumns({"last_seen": seen, "probability": rnd("probability"), "confidence": rnd("confidence")})


@query("q07_statistics", f"WITH {TP}, s AS (SELECT count(DISTINCT s) AS states FROM (SELECT context AS s FROM m UNION ALL SELECT next FROM m)) SELECT count(DISTINCT context) AS contexts, count(*) AS transitions, coalesce(sum(c), 0)::bigint AS observations, max(last) AS last_seen, any_value(states) AS states, round(coalesce(count(*) / nullif(any_value(states), 0), 0), 5)::double AS per_state FROM m, s", "requests")
def _(t):
    return Q.matrix_stats(request_matrix(t)).withColumns({"last_seen": F.unix_micros(F.col("last_seen").cast("timestamp")), "per_state": rnd("per_state")})


@query("q07_transition_prob", f"WITH {TP}, e AS (SELECT DISTINCT event_type AS t FROM requests), a AS (SELECT a.t AS context, b.t AS next FROM e a, e b UNION ALL SELECT 'start', t FROM e) SELECT context, next, round(coalesce(pr, 0), 5)::double AS probability FROM a LEFT JOIN p USING (context, next)", "requests")
def _(t):
    types = t.requests.select(F.col("event_type").alias("context")).distinct()
    nexts = types.select(F.col("context").alias("next"))
    asked = types.crossJoin(F.broadcast(nexts)).unionByName(nexts.withColumn("context", F.lit("start")))  # event types, not rows
    return Q.transition_prob(request_matrix(t), asked).select("context", "next", rnd("probability").alias("probability"))


@query("u04_kept_items", "SELECT user_id FROM events GROUP BY user_id HAVING bool_or(ts < TIMESTAMP '2024-01-02') AND bool_or(ts >= TIMESTAMP '2024-01-02' AND ts < TIMESTAMP '2024-01-04')")
def _(t):
    before = t.events.filter("ts < TIMESTAMP_NTZ '2024-01-02'").select("user_id")
    now = t.events.filter("ts >= TIMESTAMP_NTZ '2024-01-02' AND ts < TIMESTAMP_NTZ '2024-01-04'").select("user_id")
    return E.kept_items(now, before)


# --- series -------------------------------------------------------------------------------------


def ema_sql(x: str, seed: float) -> str:
    return f"(0.1 * {x} + 0.9 * {seed})::double"


@query(
    "w21_baselines",
    "WITH RECURSIVE s AS (SELECT host, epoch_us(date_trunc('hour', ts)) // 1000000 AS bucket, count(*) / 60 AS rate, avg(duration_ms) AS latency, avg((status_code >= 400)::int) AS error FROM requests GROUP BY 1, 2), b AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY bucket) AS i FROM s), "
    f"r AS (SELECT host, bucket, i, {ema_sql('rate', 0.1)} AS a, {ema_sql('latency', 40.0)} AS l, {ema_sql('error', 0.05)} AS e FROM b WHERE i = 1 UNION ALL SELECT b.host, b.bucket, b.i, {ema_sql('b.rate', 'r.a')}, {ema_sql('b.latency', 'r.l')}, {ema_sql('b.error', 'r.e')} FROM r JOIN b ON b.host = r.host AND b.i = r.i + 1) "
    "SELECT host, bucket, round(a, 5) AS rate, round(l, 4) AS latency, round(e, 5) AS error FROM r",
    "requests",
)
def _(t):
    s = t.requests.groupBy("host", F.unix_timestamp(F.date_trunc("hour", "ts")).alias("bucket")).agg(
        (F.count(F.lit(1)) / 60).alias("rate"), F.avg("duration_ms").alias("latency"), F.avg((F.col("status_code") >= 400).cast("int")).alias("error")
    )
    x = W.baseline_ema(s, ["host"], ["bucket"], {"rate": 0.1, "latency": 40.0, "error": 0.05})
    return x.select("host", "bucket", rnd("rate_baseline").alias("rate"), rnd("latency_baseline", 4).alias("latency"), rnd("error_baseline").alias("error"))


VOL10 = "stddev_pop(x) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)"
DIR = f"q AS (SELECT *, {SLOPE} AS sl, {VOL10} AS vol FROM r), d AS (SELECT *, CASE WHEN i < 5 THEN 'stable' WHEN vol > 2 * 30 THEN 'volatile' WHEN abs(sl) < sqrt(v) * 0.1 THEN 'stable' WHEN sl > 0 THEN 'increasing' ELSE 'decreasing' END AS direction FROM q)"


@query("w05_volatile_override", fold(0.3) + f", {DIR} SELECT event_id, direction FROM d")
def _(t):
    return W.ewma_trend(ev(t), KEY, ORDER, VALUE, 0.3, 30).select("event_id", "direction")


@query(
    "w27_insights",
    fold(0.3)
    + f", {DIR.replace('2 * 30', '2 * 10')}, h AS (SELECT *, CASE WHEN i > 5 THEN stddev_pop(x) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) END AS hist FROM d), m AS (SELECT *, avg(hist) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN 14 PRECEDING AND CURRENT ROW) AS mean FROM h), "
    "z AS (SELECT arg_max(direction, i) AS dn, arg_max(mean IS NOT NULL AND vol >= mean * 1.5, i) AS hi FROM m GROUP BY user_id), c AS (SELECT count(*) AS n, count_if(dn = 'increasing') AS a, count_if(dn = 'volatile') AS b, count_if(hi) AS c FROM z) "
    "SELECT insight, severity, series::bigint AS series, round(series / n, 5)::double AS share, confidence::double AS confidence FROM (SELECT 'trend_change' AS insight, 'medium' AS severity, a AS series, n, 0.7 AS lim, 0.8 AS confidence FROM c UNION ALL SELECT 'volatility_spike', 'high', b, n, 0.5, 0.9 FROM c UNION ALL SELECT 'volatility_regime', 'high', c, n, 0.3, 0.85 FROM c) WHERE series / n > lim",
)
def _(t):
    return W.series_insights(ev(t), KEY, ORDER, VALUE, 0.3, 10).withColumn("share", rnd("share"))


@query(
    "w29_series_quality",
    fold(0.3)
    + ", d AS (SELECT *, abs(x - lag(x) OVER (PARTITION BY user_id ORDER BY i)) AS st FROM r), l AS (SELECT *, list(st) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN 8 PRECEDING AND CURRENT ROW) AS near FROM d), a AS (SELECT user_id, i, CASE WHEN i < 10 THEN 0.5 ELSE len(list_filter(near, lambda q: q <= sqrt(v))) / 9 END AS acc FROM l), g AS (SELECT user_id, max(i) AS points, arg_max(acc, i) AS acc FROM a GROUP BY 1) "
    "SELECT user_id, points, round(acc, 5) AS accuracy, concat_ws(',', 'window_size', CASE WHEN acc < 0.7 THEN 'low_accuracy' END) AS issues, false AS is_valid FROM g",
)
def _(t):
    return W.validate_series(ev(t), KEY, ORDER, VALUE, 0.3, 8).withColumn("accuracy", rnd("accuracy")).withColumn("issues", F.array_join("issues", ","))


# --- graph --------------------------------------------------------------------------------------


@query(
    "r03_geo_proximity",
    "WITH l AS (SELECT request_id, country AS c, region AS r, city AS t, lag(country) OVER w AS lc, lag(region) OVER w AS lr, lag(city) OVER w AS lt FROM requests WINDOW w AS (PARTITION BY ts::date, parity ORDER BY ts, request_id)) SELECT request_id, CASE WHEN lc IS NULL THEN 0 WHEN c = lc AND r = lr AND t = lt THEN 1 WHEN c = lc AND r = lr THEN 0.8 WHEN c = lc THEN 0.6 ELSE 0.1 END::double AS proximity FROM l",
    "requests",
)
def _(t):
    from pyspark.sql import Window

    place = F.struct("country", "region", "city")
    w = Window.partitionBy(F.to_date("ts"), "parity").orderBy("ts", "request_id")
    r = t.requests.select("request_id", place.alias("a"), F.lag(place).over(w).alias("b"))
    return r.select("request_id", G.geo_proximity(F.col("a"), F.col("b")).alias("proximity"))


@query(
    "r10_ip_neighbourhood",
    "WITH RECURSIVE e AS (SELECT user_id::varchar AS a, session_id AS b FROM requests UNION SELECT session_id, ip FROM requests), u AS (SELECT a AS src, b AS dst FROM e UNION SELECT b, a FROM e), h AS (SELECT ip AS node, ip AS seed, 0 AS d FROM (SELECT DISTINCT ip FROM requests WHERE ip LIKE '10.1.1.%') UNION SELECT u.dst, seed, d + 1 FROM h JOIN u ON h.node = u.src WHERE d < 5) SELECT seed, node, min(d)::int AS hops FROM h WHERE node <> seed GROUP BY 1, 2",
    "requests",
)
def _(t):
    """Asked for a depth of 9, which is clamped to 5."""
    _, e = G.build_graph(t.requests)
    seeds = t.requests.filter("ip LIKE '10.1.1.%'").select(F.col("ip").alias("id")).distinct()
    return G.ip_graph(e.filter("type IN ('USED', 'CONNECTED_TO')"), seeds, 9)


BOT = "nf AS (SELECT src FROM links GROUP BY 1 HAVING min(first_ts) > TIMESTAMP '1996-07-01' - INTERVAL 4380 HOUR AND min(first_ts) <= TIMESTAMP '1996-07-01'), nd AS (SELECT DISTINCT src, dst FROM links SEMI JOIN nf USING (src)), nm AS (SELECT src, count(*) AS k FROM nd GROUP BY 1 HAVING count(*) > 5), nt AS (SELECT dst FROM nd GROUP BY 1 HAVING count(*) > 1)"


@query(
    "r14_threat_report",
    f"WITH {CS}, {BOT}, cs AS (SELECT CASE WHEN sessions / ips > 5 AND failed > 5 THEN 0.9 WHEN sessions / ips > 3 AND failed > 3 THEN 0.7 WHEN sessions / ips > 2 AND failed > 1 THEN 0.5 ELSE 0.3 END AS s FROM g), "
    "bt AS (SELECT DISTINCT src, CASE WHEN k > 20 THEN 0.9 WHEN k > 10 THEN 0.7 ELSE 0.5 END AS s FROM nm JOIN nd USING (src) SEMI JOIN nt USING (dst)), "
    "al AS (SELECT count(DISTINCT CASE WHEN contains(path, '/admin') THEN path END) AS a, count(DISTINCT path) AS r FROM requests GROUP BY user_id), "
    "z AS (SELECT s FROM cs UNION ALL SELECT s FROM bt UNION ALL SELECT CASE WHEN a > 5 THEN 0.9 WHEN a > 3 THEN 0.7 WHEN a > 1 THEN 0.5 ELSE 0.2 END FROM al WHERE a > 0 AND r > a) "
    "SELECT count(*) AS threats, round(avg(s), 2)::double AS mean, count_if(s >= 0.85) AS critical, count_if(s >= 0.7 AND s < 0.85) AS high FROM z",
    "requests", "links",
)
def _(t):
    edges = t.requests.select(F.col("user_id").cast("string").alias("src"), F.col("path").alias("dst")).distinct()
    kind = F.when(F.col("path").contains("/admin"), "admin").otherwise("page")
    lateral = G.admin_lateral(edges, t.requests.select("path", kind.alias("type")).distinct())
    return G.graph_report(G.credential_stuffing(t.requests), G.botnet_devices(t.links, "1996-07-01", 4380), lateral)


# --- models -------------------------------------------------------------------------------------


@query("e03_encode_columns", "WITH k AS (SELECT event_id, event_type, user_id::varchar AS u, value FROM events) SELECT event_id, (dense_rank() OVER (ORDER BY event_type) - 1)::double AS event_type_encoded, round(avg(value) OVER (PARTITION BY u), 5) AS u_encoded FROM k")
def _(t):
    e = t.events.select("event_id", "event_type", F.col("user_id").cast("string").alias("u"), "value")
    return M.encode(e, ["event_type", "u"], "value").select("event_id", "event_type_encoded", rnd("u_encoded").alias("u_encoded"))


PRED = "SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 2 ELSE quality END AS label, CASE WHEN doc_id % 5 = 0 THEN 2 WHEN doc_id % 3 = 0 THEN toxic ELSE quality END AS pred FROM labels"
CONF = f"x AS ({PRED}), k AS (SELECT DISTINCT c FROM (SELECT label AS c FROM x UNION ALL SELECT pred FROM x)), m AS (SELECT a.c AS label, b.c AS predicted, count(x.doc_id) AS n FROM k a CROSS JOIN k b LEFT JOIN x ON x.label = a.c AND x.pred = b.c GROUP BY 1, 2)"


def predicted(t):
    return t.spark.sql(PRED.replace("FROM labels", "FROM {labels}"), labels=t.labels)


@query("e10_confusion_matrix", f"WITH {CONF} SELECT * FROM m")
def _(t):
    return M.confusion_matrix(predicted(t), "pred", "label")


@query(
    "e10_evaluation_report",
    f"WITH {CONF}, r AS (SELECT label::varchar AS class, sum(n)::bigint AS support, sum(CASE WHEN label = predicted THEN n ELSE 0 END) AS hit FROM m GROUP BY 1), q AS (SELECT predicted::varchar AS class, sum(n) AS p FROM m GROUP BY 1), "
    "c AS (SELECT class, coalesce(hit / nullif(p, 0), 0) AS pr, coalesce(hit / nullif(support, 0), 0) AS re, support, hit FROM r JOIN q USING (class)), f AS (SELECT *, coalesce(2 * pr * re / nullif(pr + re, 0), 0) AS f1 FROM c), "
    "z AS (SELECT class, pr, re, f1, support FROM f UNION ALL SELECT 'accuracy', sum(hit) / sum(support), sum(hit) / sum(support), sum(hit) / sum(support), sum(support) FROM f UNION ALL SELECT 'macro avg', avg(pr), avg(re), avg(f1), sum(support) FROM f UNION ALL SELECT 'weighted avg', sum(pr * support) / sum(support), sum(re * support) / sum(support), sum(f1 * support) / sum(support), sum(support) FROM f) "
    "SELECT class, round(pr, 5) AS precision, round(re, 5) AS recall, round(f1, 5) AS f1, support::bigint AS support FROM z",
)
def _(t):
    return M.evaluation_report(predicted(t), "pred", "label").withColumns({c: rnd(c) for c in ("precision", "recall", "f1")})
