"""Queries: sketches, sequences, graphs, limits, feedback, forensics, models."""

from __future__ import annotations

from pyspark.sql import functions as F

from duskline.functions import scalars as S
from duskline.operators import enrich as E
from duskline.operators import forensics as H
from duskline.operators import graph as G
from duskline.operators import limits as L
from duskline.operators import ml as M
from duskline.operators import report as R
from duskline.operators import sequence as Q
from duskline.operators import sketch as K
from duskline.operators import summary as Y

from .registry import query, rnd, rnd_many

N = lambda: F.count(F.lit(1))


def within_bound(t, item, sketch):
    """Estimates against the true counts: never below, and above by 0.1 % of all rows at most."""
    truth = t.requests.groupBy(item).agg(N().alias("n"))
    total = t.requests.agg(N().alias("total"))
    e = F.col("estimate")
    out = K.cms_query(sketch, t.requests, item).join(truth, item).crossJoin(F.broadcast(total))  # one row
    return out.withColumn("within", (e >= F.col("n")) & (e <= F.col("n") + F.ceil(0.001 * F.col("total"))))


@query("k02_cms_query", "SELECT path, count(*) AS n, true AS within FROM requests GROUP BY path", "requests")
def _(t):
    return within_bound(t, "path", K.cms_build(t.requests, "path")).select("path", "n", "within")


@query("k03_cms_top_k", "SELECT count(*) AS found, true AS within FROM (SELECT DISTINCT ip FROM requests LIMIT 10)", "requests")
def _(t):
    top = within_bound(t, "ip", K.cms_build(t.requests, "ip")).orderBy(F.desc("estimate"), "ip").limit(10)
    return top.agg(N().alias("found"), F.bool_and("within").alias("within"))


@query("k04_cms_merge", "SELECT 'whole' AS part, sum(c)::bigint AS inserts FROM (SELECT count(*) AS c FROM requests)", "requests")
def _(t):
    r = t.requests
    m = K.cms_merge(K.cms_build(r.filter("parity < 2"), "path"), K.cms_build(r.filter("parity >= 2"), "path"))
    return m.filter("row = 0").agg(F.lit("whole").alias("part"), F.sum("cnt").alias("inserts"))


@query("k06_cms_metrics", "SELECT count(*)::double AS inserts, true AS plausible, 8 * 5 * 2719 AS bytes FROM requests", "requests")
def _(t):
    m = K.cms_metrics(K.cms_build(t.requests, "path"))
    full = (F.col("filled") > 0) & (F.col("fill_ratio") <= 1) & (F.abs(F.col("fill_ratio") * F.col("bytes") / 8 - F.col("filled")) < 1e-6)
    return m.select("inserts", full.alias("plausible"), F.col("bytes").cast("int").alias("bytes"))


@query("k07_hll_estimate", "SELECT country, true AS within FROM requests GROUP BY country", "requests")
def _(t):
    """Estimates within 6 % (over three standard errors) of the distinct sessions."""
    truth = t.requests.groupBy("country").agg(F.count_distinct("session_id").alias("n"))
    e = K.hll_estimate(K.hll_build(t.requests, "country", "session_id"), "country").join(truth, "country")
    return e.select("country", (F.abs(F.col("estimate") - F.col("n")) <= 0.06 * F.col("n") + 1).alias("within"))


@query("k08_hll_merge", "SELECT host, true AS within FROM requests GROUP BY host", "requests")
def _(t):
    """Sketches of (host, country) merged by host, against the distinct sessions of the host."""
    parts = t.requests.groupBy("host", "country").agg(F.hll_sketch_agg("session_id", 12).alias("sketch"))
    truth = t.requests.groupBy("host").agg(F.count_distinct("session_id").alias("n"))
    e = K.hll_estimate(K.hll_merge(parts, "host"), "host").join(truth, "host")
    return e.select("host", (F.abs(F.col("estimate") - F.col("n")) <= 0.06 * F.col("n") + 1).alias("within"))


VIS = "count(DISTINCT ip) AS ips, count(DISTINCT session_id) AS sessions, count(DISTINCT user_agent) AS agents, count(DISTINCT city) AS locations, count(DISTINCT path) AS paths"


@query("k10_visitor_metrics", f"SELECT epoch_us(time_bucket(INTERVAL '1 day', ts)) // 1000000 AS bucket, {VIS} FROM requests GROUP BY 1", "requests")
def _(t):
    return K.visitor_metrics(t.requests, "1d").withColumn("bucket", F.unix_timestamp("bucket"))


@query("k11_visitors_by_geo_agent", "SELECT country, CASE WHEN contains(lower(user_agent), 'bot') THEN 'bot' WHEN user_agent LIKE 'Mozilla%' THEN 'browser' ELSE 'tool' END AS kind, count(DISTINCT ip) AS visitors FROM requests GROUP BY 1, 2", "requests")
def _(t):
    kind = F.when(S.is_bot("user_agent"), "bot").when(F.col("user_agent").startswith("Mozilla"), "browser").otherwise("tool")
    return t.requests.groupBy("country", kind.alias("kind")).agg(F.count_distinct("ip").alias("visitors"))


FR = "f AS (SELECT ip AS item, count(*) AS f FROM requests GROUP BY ip), r AS (SELECT item, f, f / 5 AS d, CASE WHEN f >= 40 THEN 'critical' WHEN f >= 20 THEN 'anomalous' WHEN f >= 10 THEN 'suspicious' ELSE 'normal' END AS level, CASE WHEN f <= 5 THEN 0 WHEN f >= 40 THEN 1 ELSE (f - 5) / 35 END AS risk FROM f)"


@query("k12_frequency_risk", f"WITH {FR} SELECT item, f AS frequency, round(d, 5) AS deviation, level, round(risk, 5) AS risk FROM r", "requests")
def _(t):
    return K.frequency_risk(t.requests, "ip").select("item", "frequency", rnd("deviation").alias("deviation"), "level", rnd("risk").alias("risk"))


FP = "p AS (SELECT ip AS item, date_trunc('hour', ts) AS b, count(*) AS n FROM requests GROUP BY 1, 2), g AS (SELECT item, count(*) AS w, avg(n) AS m, var_pop(n) AS v, (arg_max(n, b) - arg_min(n, b)) / greatest(arg_min(n, b), 1) AS ch FROM p GROUP BY item), t AS (SELECT *, CASE WHEN w < 2 THEN 'steady' WHEN v / m > 2 THEN 'burst' WHEN ch > 0.5 THEN 'increasing' WHEN ch < -0.5 THEN 'decreasing' ELSE 'steady' END AS pattern FROM g)"


@query("k13_frequency_pattern", f"WITH {FP} SELECT item, w AS windows, round(m, 5) AS mean, round(v, 5) AS variance, pattern FROM t", "requests")
def _(t):
    return K.frequency_pattern(t.requests, "ip", unit="hour").select("item", "windows", rnd("mean").alias("mean"), rnd("variance").alias("variance"), "pattern")


@query("k14_frequency_anomalies", "WITH n AS (SELECT 1.0 / count(*) AS share FROM requests) SELECT concat(path, '#', cast(request_id AS varchar)) AS item, 'rare_item' AS kind, CASE WHEN share < 0.0001 THEN 'critical' WHEN share < 0.001 THEN 'high' ELSE 'low' END AS severity FROM requests, n WHERE share <= 0.001 AND regexp_matches(path, '" + S.SUSPICIOUS_ITEM.replace("\\.php$|\\.asp$|", "").replace("|\\.env$", "") + "')", "requests")
def _(t):
    tagged = t.requests.withColumn("tagged", F.concat_ws("#", "path", F.col("request_id").cast("string")))
    return K.frequency_anomalies(tagged, "tagged")


RISK = "CASE WHEN {0} <= 5 THEN 0 WHEN {0} >= 40 THEN 1 ELSE ({0} - 5) / 35 END"


@query("k15_sketch_risk", f"WITH {FR}, {FP}, c AS (SELECT request_id, ip, count(*) OVER (PARTITION BY ip) AS c1, count(*) OVER (PARTITION BY user_agent) AS c2, count(*) OVER (PARTITION BY path) AS c3, count(*) OVER (PARTITION BY session_id) AS c4 FROM requests), k AS (SELECT request_id, ip, {RISK.format('c1')} AS r1, {RISK.format('c2')} AS r2, {RISK.format('c3')} AS r3, {RISK.format('c4')} AS r4 FROM c), an AS (SELECT item, sum(b) AS b FROM (SELECT item, CASE WHEN d >= 50 THEN 0.3 WHEN d >= 20 THEN 0.2 WHEN d >= 10 THEN 0.1 ELSE 0 END AS b FROM r JOIN t USING (item) WHERE d >= 5 AND pattern IN ('increasing', 'burst') UNION ALL SELECT item, CASE WHEN 0.8 * risk >= 0.8 THEN 0.3 WHEN 0.8 * risk >= 0.6 THEN 0.2 WHEN 0.8 * risk >= 0.4 THEN 0.1 ELSE 0 END FROM r JOIN t USING (item) WHERE pattern = 'burst') GROUP BY item) SELECT request_id, round(greatest(least(0.3 * r1 + 0.2 * r2 + 0.3 * r3 + 0.2 * r4 + coalesce(b, 0), 1), r1, r2, r3, r4), 5)::double AS risk FROM k LEFT JOIN an ON an.item = k.ip", "requests")
def _(t):
    kinds = {"ip_address": "ip", "user_agent": "user_agent", "request_path": "path", "session_id": "session_id"}
    odd = t.requests.select("request_id", F.col("ip").alias("item")).join(K.frequency_anomalies(t.requests, "ip"), "item")
    return K.sketch_risk(K.key_risks(t.requests, "request_id", kinds), odd, "request_id").withColumn("risk", rnd("risk"))


@query("k16_cardinality_risk", f"WITH v AS (SELECT epoch_us(time_bucket(INTERVAL '1 day', ts)) // 1000000 AS bucket, {VIS} FROM requests GROUP BY 1) SELECT bucket, round(least(1, CASE WHEN ips / sessions > 0.8 THEN 0.3 WHEN ips / sessions < 0.1 THEN 0.2 ELSE 0 END + CASE WHEN agents / ips < 0.1 THEN 0.4 WHEN agents / ips > 2 THEN 0.2 ELSE 0 END + CASE WHEN locations / ips > 0.5 THEN 0.2 ELSE 0 END + CASE WHEN paths / sessions > 10 THEN 0.3 ELSE 0 END), 5) AS risk FROM v", "requests")
def _(t):
    return K.cardinality_risk(K.visitor_metrics(t.requests, "1d")).select(F.unix_timestamp("bucket").alias("bucket"), rnd("risk").alias("risk"))


VT = "v AS (SELECT time_bucket(INTERVAL '1 day', ts) AS b, count(DISTINCT ip) AS n FROM requests GROUP BY 1), w AS (SELECT *, coalesce((n - lag(n) OVER (ORDER BY b)) * 100.0 / lag(n) OVER (ORDER BY b), 0) AS growth, abs(n - avg(n) OVER q) / nullif(stddev_pop(n) OVER q, 0) AS z FROM v WINDOW q AS (ORDER BY b ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING))"


@query("k17_visitor_trend", f"WITH {VT} SELECT epoch_us(b) // 1000000 AS bucket, n, round(growth, 5) AS growth, CASE WHEN growth > 5 THEN 'increasing' WHEN growth < -5 THEN 'decreasing' ELSE 'stable' END AS trend, round(least(1, coalesce(z, 0) / 3), 5) AS anomaly FROM w", "requests")
def _(t):
    return K.visitor_trend(t.requests).select(F.unix_timestamp("bucket").alias("bucket"), "n", rnd("growth").alias("growth"), "trend", rnd("anomaly").alias("anomaly"))


@query("k18_visitor_pattern", "WITH d AS (SELECT time_bucket(INTERVAL '1 day', ts) AS b, count(DISTINCT ip) AS n FROM requests GROUP BY 1 ORDER BY b DESC LIMIT 24), w AS (SELECT *, (n - lag(n) OVER (ORDER BY b)) * 100.0 / lag(n) OVER (ORDER BY b) AS g FROM d), a AS (SELECT count(*) AS periods, coalesce(avg(g), 0) AS m, arg_max(n, b) AS l, stddev_pop(n) / avg(n) AS cv FROM w), h AS (SELECT hour(ts)::int AS h, count(DISTINCT ip) AS n FROM requests GROUP BY 1) SELECT periods, round(m, 5) AS growth, CASE WHEN periods < 3 OR abs(m) < 2 THEN 'steady' WHEN m > 10 THEN 'growing' WHEN m < -10 THEN 'declining' WHEN cv > 0.5 THEN 'spiky' ELSE 'seasonal' END AS pattern, round(l * (1 + m / 100), 0)::double AS next, round(l * (1 + m / 100) * 0.8, 0)::double AS low, round(l * (1 + m / 100) * 1.2, 0)::double AS high, (SELECT h FROM h ORDER BY n DESC, h LIMIT 1) AS peak_hour, (SELECT h FROM h ORDER BY n, h LIMIT 1) AS low_hour FROM a", "requests")
def _(t):
    return K.visitor_pattern(t.requests).withColumn("growth", rnd("growth"))


@query("k19_visitor_insights", f"WITH {VT} SELECT epoch_us(b) // 1000000 AS bucket, 'growth' AS insight FROM w WHERE growth > 50 UNION ALL SELECT epoch_us(b) // 1000000, 'anomaly' FROM w WHERE z / 3 > 0.7 UNION ALL SELECT epoch_us(b) // 1000000, 'decline' FROM w WHERE growth < -30", "requests")
def _(t):
    v = K.visitor_trend(t.requests).withColumn("bucket", F.unix_timestamp("bucket"))
    return K.visitor_insights(v)


@query("k20_compare_periods", "SELECT 'first' AS period, count(DISTINCT ip) AS n FROM requests WHERE ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2024-01-08' UNION ALL SELECT 'second', count(DISTINCT ip) FROM requests WHERE ts >= TIMESTAMP '2024-01-08' AND ts < TIMESTAMP '2024-01-15'", "requests")
def _(t):
    return K.compare_periods(t.requests, {"first": ("2024-01-01", "2024-01-08"), "second": ("2024-01-08", "2024-01-15")}, "ip")


# --- sequences ----------------------------------------------------------------------------------

SQ = ["step"]
TR = "l AS (SELECT session, step, lag(state) OVER w AS context, state AS next FROM states WINDOW w AS (PARTITION BY session ORDER BY step)), tr AS (SELECT * FROM l WHERE context IS NOT NULL), m AS (SELECT context, next, count(*) AS c FROM tr GROUP BY 1, 2), p AS (SELECT *, (c + 1) / (sum(c) OVER (PARTITION BY context) + count(*) OVER (PARTITION BY context)) AS pr FROM m)"


@query("q01_sessionize", "WITH g AS (SELECT user_id, event_id, ts, CASE WHEN coalesce(epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) > 86400000000, true) THEN 1 ELSE 0 END AS nw FROM events), s AS (SELECT *, sum(nw) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS no FROM g) SELECT user_id, no::bigint AS session_no, count(*) AS n, max(epoch_us(ts) // 1000000) - min(epoch_us(ts) // 1000000) AS duration FROM s GROUP BY 1, 2")
def _(t):
    s = Q.sessionize(t.events, "user_id", "ts", "event_id", 86400)
    at = F.unix_timestamp("ts")
    return s.groupBy("user_id", "session_no").agg(N().alias("n"), (F.max(at) - F.min(at)).alias("duration"))


@query("q02_learn_transitions", f"WITH {TR} SELECT context, next, c AS count FROM m", "states")
def _(t):
    return Q.learn_transitions(t.states, "session", SQ, "state").select("context", "next", "count")


@query("q02_second_order", "WITH l AS (SELECT concat(lag(state, 2) OVER w, '>', lag(state) OVER w) AS context, lag(state, 2) OVER w AS far, state AS next FROM states WINDOW w AS (PARTITION BY session ORDER BY step)) SELECT context, next, count(*) AS count FROM l WHERE far IS NOT NULL GROUP BY 1, 2", "states")
def _(t):
    return Q.learn_transitions(t.states, "session", SQ, "state", 2).select("context", "next", "count")


@query("q03_transition_probs", f"WITH {TR} SELECT context, next, round(pr, 5) AS probability FROM p", "states")
def _(t):
    return Q.learn_transitions(t.states, "session", SQ, "state").select("context", "next", rnd("probability").alias("probability"))


@query("q04_prune_transitions", f"WITH {TR} SELECT context, next FROM m WHERE c >= 5", "states")
def _(t):
    return Q.prune_transitions(Q.learn_transitions(t.states, "session", SQ, "state"), 5).select("context", "next")


@query("q05_predict_next", f"WITH {TR}, k AS (SELECT *, row_number() OVER (PARTITION BY context ORDER BY pr DESC, next) AS r FROM p QUALIFY r <= 5), s AS (SELECT *, sum(-pr * log2(pr)) OVER (PARTITION BY context) AS e, count(*) OVER (PARTITION BY context) AS n, max(pr) OVER (PARTITION BY context) AS b FROM k) SELECT context, next, r AS rank, round(least(1, CASE WHEN n > 1 THEN e / log2(n) ELSE 0 END + 1 - b), 5) AS anomaly_score FROM s", "states")
def _(t):
    return Q.predict_next(Q.learn_transitions(t.states, "session", SQ, "state")).select("context", "next", "rank", rnd("anomaly_score").alias("anomaly_score"))


@query("q06_validate_sequences", f"WITH {TR}, kept AS (SELECT * FROM p WHERE c >= 5) SELECT session, count(*) AS steps, count_if(pr IS NULL) AS unseen, count_if(pr < 0.1) AS improbable, count_if(pr IS NULL) = 0 AS valid, round(1 - (count_if(pr IS NULL) + 0.5 * count_if(pr < 0.1)) / count(*), 5) AS confidence FROM tr LEFT JOIN kept USING (context, next) GROUP BY session", "states")
def _(t):
    m = Q.prune_transitions(Q.learn_transitions(t.states, "session", SQ, "state"), 5)
    return Q.validate_sequences(t.states, m, "session", SQ, "state").withColumn("confidence", rnd("confidence"))


@query("q07_matrix_stats", f"WITH {TR} SELECT count(*) AS transitions, count(DISTINCT context) AS contexts, sum(c)::bigint AS total, round(avg(pr), 5) AS mean FROM p", "states")
def _(t):
    return Q.learn_transitions(t.states, "session", SQ, "state").agg(N().alias("transitions"), F.count_distinct("context").alias("contexts"), F.sum("count").alias("total"), rnd(F.avg("probability")).alias("mean"))


@query("q08_discover_patterns", "WITH w AS (SELECT session, state AS a, lead(state, 1) OVER w AS b, lead(state, 2) OVER w AS c, lead(state, 3) OVER w AS d, lead(state, 4) OVER w AS e FROM states WINDOW w AS (PARTITION BY session ORDER BY step)), g AS (SELECT session, concat_ws('>', a, b) AS pattern FROM w WHERE b IS NOT NULL UNION ALL SELECT session, concat_ws('>', a, b, c) FROM w WHERE c IS NOT NULL UNION ALL SELECT session, concat_ws('>', a, b, c, d) FROM w WHERE d IS NOT NULL UNION ALL SELECT session, concat_ws('>', a, b, c, d, e) FROM w WHERE e IS NOT NULL) SELECT pattern, count(*) AS count, count(DISTINCT session) AS support FROM g GROUP BY pattern HAVING count(*) >= 2", "states")
def _(t):
    return Q.discover_patterns(t.states, "session", SQ, "state")


TQ = "l AS (SELECT session_id, ts, request_id, event_type, lag(event_type) OVER w AS context, event_type AS next, lead(epoch_us(ts)) OVER w AS nx FROM requests{0} WINDOW w AS (PARTITION BY session_id ORDER BY ts, request_id)), m AS (SELECT context, next, count(*) AS c FROM l WHERE context IS NOT NULL GROUP BY 1, 2), p AS (SELECT *, (c + 1) / (sum(c) OVER (PARTITION BY context) + count(*) OVER (PARTITION BY context)) AS pr FROM m), sc AS (SELECT session_id, avg(1 - pr) AS a, max(1 - pr) AS worst FROM l JOIN p USING (context, next) GROUP BY 1)"
RQ = ["ts", "request_id"]


@query("q10_user_journeys", f"WITH {TQ.format('')} SELECT session_id, arg_min(event_type, struct_pack(a := ts, b := request_id)) AS start, arg_max(event_type, struct_pack(a := ts, b := request_id)) AS \"end\", count(*)::int AS steps, string_agg(event_type, '>' ORDER BY ts, request_id) AS path, round(sum(coalesce(nx - epoch_us(ts), 0)) / 1e6, 3) AS in_steps, round((max(epoch_us(ts)) - min(epoch_us(ts))) / 1e6, 3) AS duration, coalesce(any_value(a) > 0.6, false) AS is_anomalous, round(coalesce(any_value(worst), 0), 5) AS risk FROM l LEFT JOIN sc USING (session_id) GROUP BY session_id", "requests")
def _(t):
    r = t.requests.select("session_id", "ts", "request_id", "event_type")
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    j = Q.user_journeys(r, "session_id", RQ, "event_type", at, Q.learn_transitions(r, "session_id", RQ, "event_type"))
    total = F.aggregate("step_durations", F.lit(0.0), lambda a, x: a + x)
    return j.select("session_id", "start", "end", "steps", F.array_join("path", ">").alias("path"), rnd(total, 3).alias("in_steps"), rnd("duration", 3).alias("duration"), "is_anomalous", rnd("risk").alias("risk"))


GRAMS = "w AS (SELECT session, state AS a, lead(state, 1) OVER w AS b, lead(state, 2) OVER w AS c, lead(state, 3) OVER w AS d, lead(state, 4) OVER w AS e FROM states WINDOW w AS (PARTITION BY session ORDER BY step)), g AS (SELECT session, concat_ws('>', a, b) AS pattern FROM w WHERE b IS NOT NULL UNION ALL SELECT session, concat_ws('>', a, b, c) FROM w WHERE c IS NOT NULL UNION ALL SELECT session, concat_ws('>', a, b, c, d) FROM w WHERE d IS NOT NULL UNION ALL SELECT session, concat_ws('>', a, b, c, d, e) FROM w WHERE e IS NOT NULL), pt AS (SELECT pattern, count(*) AS c, count(DISTINCT session) AS s FROM g GROUP BY pattern HAVING count(*) >= 2), q AS (SELECT *, c / sum(c) OVER () AS pr FROM pt)"


@query("q11_behavior_insights", f"WITH {GRAMS}, ss AS (SELECT session, count(*) AS n, arg_max(state, step) AS last FROM states GROUP BY session), ab AS (SELECT count_if(last <> 'assistant' AND n > 3) AS k, count(*) AS n FROM ss) SELECT 'common_pattern' AS insight, pattern AS item, 'low' AS impact, s AS affected FROM (SELECT * FROM q WHERE c > 10 AND pr >= 0.005 ORDER BY c DESC, pattern LIMIT 3) UNION ALL SELECT 'anomalous_sequence', pattern, 'high', s FROM (SELECT * FROM q WHERE pr < 0.005 ORDER BY c DESC, pattern LIMIT 2) UNION ALL SELECT 'journey_abandonment', 'sessions', 'medium', k FROM ab WHERE k > 0.3 * n UNION ALL SELECT 'rare_behavior', min(pattern), 'medium', sum(s)::bigint FROM q WHERE c < 5 AND pr < 0.01 HAVING count(*) > 0", "states")
def _(t):
    s = t.states.groupBy("session").agg(N().alias("steps"), (F.max_by("state", "step") == "assistant").alias("is_complete"))
    return Q.behavior_insights(Q.rate_patterns(Q.discover_patterns(t.states, "session", SQ, "state")), s)


@query("q13_behavior_trend", "WITH d AS (SELECT cast(ts AS date) AS d, count_if(event_type = 'error') * 1.0 / count(*) AS r FROM events GROUP BY 1), k AS (SELECT *, row_number() OVER (ORDER BY d) AS i, row_number() OVER (ORDER BY d DESC) AS j FROM d), x AS (SELECT avg(CASE WHEN i <= 3 THEN r END) AS o, avg(CASE WHEN j <= 3 THEN r END) AS n FROM k) SELECT round(o, 5) AS older, round(n, 5) AS recent, CASE WHEN n < o * 0.8 THEN 'improving' WHEN n > o * 1.2 THEN 'degrading' ELSE 'stable' END AS trend FROM x")
def _(t):
    b = Q.behavior_trend(t.events, F.col("event_type") == "error")
    return b.select(rnd("older").alias("older"), rnd("recent").alias("recent"), "trend")


@query("q13_markov_report", "WITH " + TQ.format(" WHERE ts > TIMESTAMP '2024-01-20' - INTERVAL 168 HOUR AND ts <= TIMESTAMP '2024-01-20'") + ", n AS (SELECT session_id, count(*) AS n FROM l GROUP BY 1) SELECT count(*) AS sequences, round(avg(n), 5) AS mean_length, round(avg(coalesce((a > 0.6)::int, 0)), 5) AS anomaly_rate, (SELECT count(*) FROM m) AS patterns, (SELECT coalesce(sum(c), 0)::bigint FROM m) AS transitions FROM n LEFT JOIN sc USING (session_id)", "requests")
def _(t):
    m = Q.markov_report(t.requests.select("session_id", "ts", "request_id", "event_type"), "session_id", RQ, "event_type", "2024-01-20", 168)
    return m.withColumn("mean_length", rnd("mean_length")).withColumn("anomaly_rate", rnd("anomaly_rate"))


@query("q14_prediction_metrics", f"WITH {TR}, h AS (SELECT context, next FROM tr WHERE session % 5 = 0), mm AS (SELECT context, next, count(*) AS c FROM tr WHERE session % 5 <> 0 GROUP BY 1, 2), b AS (SELECT context, next AS best FROM mm QUALIFY row_number() OVER (PARTITION BY context ORDER BY c DESC, next) = 1) SELECT count(*) AS n, round(avg(coalesce((best = next)::int, 0)), 5) AS accuracy FROM h LEFT JOIN b USING (context)", "states")
def _(t):
    m = Q.learn_transitions(t.states.filter("session % 5 <> 0"), "session", SQ, "state")
    held = Q.transitions(t.states.filter("session % 5 = 0"), "session", SQ, "state")
    return Q.prediction_metrics(m, held).withColumn("accuracy", rnd("accuracy"))


@query("q15_compress_sequences", "WITH f AS (SELECT user_id, event_id, count(*) OVER (PARTITION BY user_id, event_type) AS f, count(*) OVER (PARTITION BY user_id) AS n, ts FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY f DESC, ts, event_id) AS r FROM f) SELECT user_id, event_id FROM r WHERE n <= 10 OR r <= floor(n * 0.7)")
def _(t):
    return Q.compress_sequences(t.events, "user_id", ["ts", "event_id"], "event_type", 0.7, 10).select("user_id", "event_id")


@query("q16_sequence_risk", "SELECT session_id, round(least(1, avg(risk_score) * 0.4 + max(risk_score) * 0.3 + avg((status_code >= 400)::int) * 0.2 + least(1, count(*) / 10) * 0.1), 5) AS risk FROM requests GROUP BY session_id", "requests")
def _(t):
    s = Q.sequence_risk(F.avg("risk_score"), F.max("risk_score"), F.avg((F.col("status_code") >= 400).cast("int")), F.least(F.lit(1.0), N() / 10))
    return t.requests.groupBy("session_id").agg(rnd(s).alias("risk"))


# --- graphs -------------------------------------------------------------------------------------


RP = "rp AS (SELECT a.request_id AS a_id, b.request_id AS b_id, a.ip AS a_ip, b.ip AS b_ip, least(1, CASE WHEN a.user_agent = b.user_agent THEN 0.1 ELSE 0 END + 0.15 + 0.25 * greatest(0, 1 - abs(epoch_us(a.ts) - epoch_us(b.ts)) / 300e6) + 0.2 * CASE WHEN a.city = b.city AND a.country = b.country THEN 1.0 WHEN a.region = b.region AND a.country = b.country THEN 0.8 WHEN a.country = b.country THEN 0.6 ELSE 0.1 END + CASE WHEN a.event_type = b.event_type THEN 0.3 ELSE 0 END) AS s FROM requests a JOIN requests b ON a.path = b.path AND a.ip < b.ip AND abs(epoch_us(a.ts) - epoch_us(b.ts)) <= 300000000), rs AS (SELECT * FROM rp WHERE s > 0.3)"


def relations(t):
    r = t.requests.select("request_id", "ip", "ts", "path", "user_agent", "country", "region", "city", "event_type")
    p = G.relation_strength(E.pair_within(r, "ip", "ts", 300, "path"))
    return p.select(F.col("a.request_id").alias("a_id"), F.col("b.request_id").alias("b_id"), F.col("a.ip").alias("a_ip"), F.col("b.ip").alias("b_ip"), "strength")


@query("r01_relation_strength", f"WITH {RP} SELECT a_id, b_id, round(s, 4) AS strength FROM rs", "requests")
def _(t):
    return relations(t).select("a_id", "b_id", rnd("strength", 4).alias("strength"))


@query("r03_geo_clusters", "SELECT country, region, city, count(*) AS requests, count(DISTINCT ip) AS ips, round(avg(risk_score), 5) AS risk, CASE WHEN avg(risk_score) > 0.7 THEN 'high' WHEN avg(risk_score) > 0.4 THEN 'medium' ELSE 'low' END AS threat FROM requests GROUP BY 1, 2, 3", "requests")
def _(t):
    return G.geo_clusters(t.requests).withColumn("risk", rnd("risk"))


@query("r06_build_graph", "SELECT 'User' AS kind, count(DISTINCT user_id) AS n FROM requests UNION ALL SELECT 'Session', count(DISTINCT session_id) FROM requests UNION ALL SELECT 'IP', count(DISTINCT ip) FROM requests UNION ALL SELECT 'Resource', count(DISTINCT path) FROM requests UNION ALL SELECT 'USED', count(DISTINCT (user_id, session_id)) FROM requests UNION ALL SELECT 'CONNECTED_TO', count(DISTINCT (session_id, ip)) FROM requests UNION ALL SELECT 'ACCESSED', count(DISTINCT (session_id, path)) FROM requests", "requests")
def _(t):
    nodes, edges = G.build_graph(t.requests)
    return nodes.groupBy(F.col("label").alias("kind")).agg(N().alias("n")).unionByName(edges.groupBy(F.col("type").alias("kind")).agg(N().alias("n")))


UND = "u AS (SELECT DISTINCT src, dst FROM (SELECT src, dst FROM edges UNION ALL SELECT dst, src FROM edges) WHERE src <> dst)"


@query("r07_k_hop", f"WITH RECURSIVE {UND}, h AS (SELECT 's1' AS seed, 's1' AS node, 0 AS d UNION SELECT h.seed, u.dst, d + 1 FROM h JOIN u ON h.node = u.src WHERE d < 2) SELECT seed, node, min(d)::int AS hops FROM h GROUP BY 1, 2", "edges")
def _(t):
    return G.k_hop(t.edges, t.spark.createDataFrame([("s1",)], "id string"), 2)


@query("r08_kill_chain_subgraph", "WITH RECURSIVE e AS (SELECT DISTINCT src, dst FROM links WHERE last_ts >= TIMESTAMP '2001-09-01' - INTERVAL 1440 HOUR), u AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), h AS (SELECT 's2' AS node, 0 AS d UNION SELECT u.dst, d + 1 FROM h JOIN u ON h.node = u.src WHERE d < 3) SELECT node, min(d)::int AS hops FROM h GROUP BY 1 HAVING min(d) > 0 ORDER BY hops, node LIMIT 100", "links")
def _(t):
    return G.kill_chain_subgraph(t.links, t.spark.createDataFrame([("s2",)], "id string"), 1440, "2001-09-01", 3).select("node", "hops")


@query("r09_lateral_paths", "WITH e AS (SELECT DISTINCT src, dst FROM (SELECT src, dst FROM edges UNION ALL SELECT concat('s', substr(dst, 2)), concat('c', substr(src, 2)) FROM edges)) SELECT concat_ws('>', 'c1', e1.dst) AS path, 1 AS hops FROM e e1 WHERE src = 'c1' UNION ALL SELECT concat_ws('>', 'c1', e1.dst, e2.dst), 2 FROM e e1 JOIN e e2 ON e2.src = e1.dst WHERE e1.src = 'c1' AND e2.dst NOT IN ('c1', e1.dst)", "edges")
def _(t):
    back = t.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "type")
    out = G.lateral_paths(t.edges.unionByName(back), t.spark.createDataFrame([("c1",)], "id string"), 2)
    return out.select(F.array_join("path", ">").alias("path"), "hops").distinct()


@query("j09_shared_ips", "SELECT dst, count(DISTINCT src) AS sources FROM edges GROUP BY dst HAVING count(DISTINCT src) >= 2", "edges")
def _(t):
    return G.shared_neighbours(t.edges)


@query("j08_user_session_ip", "SELECT r.user_id, r.session_id, r.ip, count(*) AS requests, count_if(risk_score > 0.5) AS threats FROM requests r GROUP BY 1, 2, 3", "requests")
def _(t):
    _, e = G.build_graph(t.requests)
    k = t.requests.groupBy("session_id", "ip").agg(N().alias("requests"), F.count_if(F.col("risk_score") > 0.5).alias("threats"))
    return E.user_session_ip(e).join(k, ["session_id", "ip"]).select(F.col("user_id").cast("long").alias("user_id"), "session_id", "ip", "requests", "threats")


@query("j10_session_chain", "SELECT user_id, session_id, string_agg(DISTINCT path, ' ' ORDER BY path) AS paths FROM requests GROUP BY 1, 2", "requests")
def _(t):
    return E.session_chain(t.requests).select("user_id", "session_id", F.array_join("paths", " ").alias("paths"))


@query("j11_access_path", "SELECT request_id, path, row_number() OVER (ORDER BY ts, request_id) AS position FROM requests WHERE user_id = 3 ORDER BY position LIMIT 50", "requests")
def _(t):
    return E.access_path(t.requests, "user_id", 3).select("request_id", "path", "position")


@query("j12_threat_patterns", "SELECT event_type, path, count(*) AS n FROM requests WHERE ts >= TIMESTAMP '2024-01-10' AND risk_score > 0.2 GROUP BY 1, 2 ORDER BY n DESC, event_type, path LIMIT 100", "requests")
def _(t):
    return E.threat_patterns(t.requests, "2024-01-10", 0.2)


@query("j13_devices_by_pattern", "SELECT user_agent, count(*) AS n FROM requests WHERE contains(user_agent, 'Mozilla') GROUP BY 1 ORDER BY n DESC, user_agent LIMIT 50", "requests")
def _(t):
    return E.devices_by_pattern(t.requests, "Mozilla")


SIMILAR = "CASE WHEN a.method = b.method THEN 0.2 ELSE 0 END + CASE WHEN a.user_agent = b.user_agent THEN 0.3 ELSE 0 END + CASE WHEN gap < 1000000 THEN 0.3 WHEN gap < 10000000 THEN 0.1 ELSE 0 END + CASE WHEN contains(a.path, b.path) OR contains(b.path, a.path) THEN 0.2 ELSE 0 END"
PLACE = "CASE WHEN a.country = b.country AND a.region = b.region AND a.city = b.city THEN 1.0 WHEN a.country = b.country AND a.region = b.region THEN 0.8 WHEN a.country = b.country THEN 0.6 ELSE 0.1 END"


@query(
    "r02_user_relation",
    f"WITH q AS (SELECT a, b, abs(epoch_us(a.ts) - epoch_us(b.ts)) AS gap FROM requests a JOIN requests b ON a.user_id < b.user_id AND abs(epoch_us(a.ts) - epoch_us(b.ts)) <= 300000000), "
    f"w AS (SELECT a.user_id AS a, b.user_id AS b, 1 - gap / 300e6 AS tc, ({SIMILAR})::double AS bs, ({PLACE})::double AS gp FROM q), "
    "x AS (SELECT a, b, CASE WHEN tc > 0.8 THEN 'session_sharing' WHEN bs > 0.7 THEN 'behavior_similarity' ELSE 'geographic_proximity' END AS kind, CASE WHEN tc > 0.8 THEN tc * 0.6 + bs * 0.4 WHEN bs > 0.7 THEN bs * 0.7 + gp * 0.3 ELSE gp * 0.8 + bs * 0.2 END AS st FROM w) "
    "SELECT a, b, count(*) AS meetings, arg_max(kind, st) AS kind, round(max(st), 4) AS strength FROM x GROUP BY 1, 2",
    "requests",
)
def _(t):
    r = t.requests.select("user_id", "ts", "method", "user_agent", "path", "country", "region", "city")
    return G.related_users(r).withColumn("strength", rnd_many("strength", 4))


@query("r07_path_counts", "WITH e AS (SELECT src AS a, dst AS b FROM edges UNION ALL SELECT dst, src FROM edges), l AS (SELECT a, b, count(*) AS m FROM e GROUP BY 1, 2), d AS (SELECT a, sum(m) AS d FROM l GROUP BY 1), two AS (SELECT x.a AS s, y.b AS w, sum(x.m * CASE WHEN y.b = x.a THEN y.m - 1 ELSE y.m END) AS n, sum(CASE WHEN y.b = x.a THEN x.m * (x.m - 1) ELSE 0 END) AS back FROM l x JOIN l y ON y.a = x.b GROUP BY 1, 2) SELECT s AS node, max(ds.d)::bigint AS paths1, sum(n)::bigint AS paths2, sum(CASE WHEN w = s THEN back * (dw.d - 2) ELSE n * (dw.d - 1) END)::bigint AS paths3 FROM two JOIN d dw ON dw.a = w JOIN d ds ON ds.a = s GROUP BY s", "edges")
def _(t):
    """All nodes at once; the oracle multiplies out the two-step pairs that the operator never makes."""
    return G.path_counts(t.edges).drop("paths")


@query("r07_relation_analysis", "WITH e AS (SELECT row_number() OVER () AS id, src, dst FROM edges), h AS (SELECT id, src AS a, dst AS b FROM e UNION ALL SELECT id, dst, src FROM e), s AS (SELECT unnest(['c1', 'c4', 's9', 'none']) AS seed), p1 AS (SELECT seed, id AS e1, b FROM s JOIN h ON h.a = seed), p2 AS (SELECT seed, e1, h.id AS e2, h.b FROM p1 JOIN h ON h.a = p1.b AND h.id <> e1), p3 AS (SELECT seed, h.b FROM p2 JOIN h ON h.a = p2.b AND h.id NOT IN (e1, e2)), u AS (SELECT seed, b FROM p1 UNION ALL SELECT seed, b FROM p2 UNION ALL SELECT seed, b FROM p3) SELECT seed, count(DISTINCT b) AS related, count(b) AS paths, least(1, count(DISTINCT b) * 0.02 + count(b) * 0.01)::double AS risk FROM s LEFT JOIN u USING (seed) GROUP BY 1", "edges")
def _(t):
    seeds = t.spark.createDataFrame([("c1",), ("c4",), ("s9",), ("none",)], "id string")
    return G.relation_analysis(t.edges, seeds)


CA = f"{RP}, ru AS (SELECT DISTINCT src, dst FROM (SELECT a_ip AS src, b_ip AS dst FROM rs UNION ALL SELECT b_ip, a_ip FROM rs)), rr AS (SELECT src, dst FROM ru UNION SELECT a.src, b.dst FROM ru a JOIN ru b ON a.dst = b.src WHERE a.src <> b.dst), rn AS (SELECT src, count(*) AS related FROM rr GROUP BY 1 HAVING count(*) >= 3), ra AS (SELECT src, count(*) AS requests, count(DISTINCT path) AS paths FROM rr JOIN requests q ON q.ip = rr.dst GROUP BY 1), ca AS (SELECT src AS ip, related, requests, paths, concat_ws(',', CASE WHEN related > 5 THEN 'ddos' END, CASE WHEN requests > 100 THEN 'brute_force' END, CASE WHEN paths > 20 THEN 'port_scanning' END) AS patterns, CASE WHEN related > 5 THEN 'critical' WHEN requests > 100 THEN 'high' ELSE 'medium' END AS severity, least(1, least(related / 10, 0.4) + 0.2 * ((related > 5)::int + (requests > 100)::int + (paths > 20)::int)) AS confidence FROM rn JOIN ra USING (src) WHERE related > 5 OR requests > 100 OR paths > 20)"


#: Requests of any path; the path only adds to the strength.
RP_ANY = RP.replace("+ 0.15 +", "+ CASE WHEN a.path = b.path THEN 0.15 ELSE 0 END +").replace("a.path = b.path AND a.ip", "a.ip")


def attacks(t, pairs):
    edges = pairs.select(F.col("a_ip").alias("src"), F.col("b_ip").alias("dst"))
    return G.coordinated_attacks(edges, t.requests, wide=20)


@query("r04_coordinated_attacks", f"WITH {CA.replace(RP, RP_ANY)} SELECT ip, related, requests, paths, patterns, severity, round(confidence, 5) AS confidence FROM ca", "requests")
def _(t):
    return attacks(t, G.address_links(t.requests)).withColumn("patterns", F.array_join("patterns", ",")).withColumn("confidence", rnd("confidence"))


@query("r05_relation_risk", f"WITH {CA}, st AS (SELECT ip, avg(s) * 0.3 AS s FROM (SELECT a_ip AS ip, s FROM rs UNION ALL SELECT b_ip, s FROM rs) GROUP BY ip), cl AS (SELECT country, region, city, avg(risk_score) AS r FROM requests GROUP BY 1, 2, 3 HAVING avg(risk_score) > 0.5), pl AS (SELECT ip, max(r) * 0.2 AS c FROM (SELECT DISTINCT ip, country, region, city FROM requests) JOIN cl USING (country, region, city) GROUP BY ip) SELECT ip, round(least(1, coalesce(CASE severity WHEN 'critical' THEN 0.8 WHEN 'high' THEN 0.6 WHEN 'medium' THEN 0.4 WHEN 'low' THEN 0.2 END, 0) + coalesce(s, 0) + coalesce(c, 0)), 5)::double AS risk FROM (SELECT DISTINCT ip FROM requests) LEFT JOIN ca USING (ip) LEFT JOIN st USING (ip) LEFT JOIN pl USING (ip)", "requests")
def _(t):
    found = attacks(t, G.address_links(t.requests, same=("path",)))
    return G.relation_risk(t.requests, found, G.address_strengths(t.requests), G.geo_clusters(t.requests)).withColumn("risk", rnd("risk"))


@query("r10_ip_graph", f"WITH RECURSIVE {UND}, h AS (SELECT 'c1' AS node, 0 AS d UNION SELECT u.dst, d + 1 FROM h JOIN u ON h.node = u.src WHERE d < 1) SELECT count(DISTINCT node) - 1 AS related FROM h", "edges")
def _(t):
    return G.k_hop(t.edges, t.spark.createDataFrame([("c1",)], "id string"), 1).filter("hops > 0").agg(N().alias("related"))


CS = "g AS (SELECT user_id, count(DISTINCT session_id) AS sessions, count(DISTINCT ip) AS ips, count(DISTINCT CASE WHEN status_code = 401 THEN session_id END) AS failed FROM requests GROUP BY 1 HAVING count(DISTINCT session_id) > 3 AND count(DISTINCT CASE WHEN status_code = 401 THEN session_id END) > 0)"


@query("r11_credential_stuffing", f"WITH {CS} SELECT user_id, sessions, failed, round(sessions / ips, 5) AS ratio, CASE WHEN sessions / ips > 5 AND failed > 5 THEN 0.9 WHEN sessions / ips > 3 AND failed > 3 THEN 0.7 WHEN sessions / ips > 2 AND failed > 1 THEN 0.5 ELSE 0.3 END::double AS score FROM g", "requests")
def _(t):
    return G.credential_stuffing(t.requests).select("user_id", "sessions", "failed", rnd("ratio").alias("ratio"), "score")


@query("r12_botnets", "WITH f AS (SELECT src FROM links GROUP BY 1 HAVING min(first_ts) > TIMESTAMP '1996-07-01' - INTERVAL 4380 HOUR AND min(first_ts) <= TIMESTAMP '1996-07-01'), d AS (SELECT DISTINCT src, dst FROM links SEMI JOIN f USING (src)), m AS (SELECT src, count(*) AS targets FROM d GROUP BY src HAVING count(*) > 5) SELECT a.src, b.src AS other, targets, count(*) AS shared, CASE WHEN targets > 20 THEN 0.9 WHEN targets > 10 THEN 0.7 WHEN targets > 5 THEN 0.5 ELSE 0.3 END::double AS score FROM d a JOIN m USING (src) JOIN d b ON a.dst = b.dst AND a.src <> b.src GROUP BY 1, 2, 3", "links")
def _(t):
    return G.botnets(t.links, "1996-07-01", 4380)


@query("r13_admin_lateral", "WITH g AS (SELECT user_id::varchar AS user, count(DISTINCT CASE WHEN contains(path, '/admin') THEN path END) AS a, count(DISTINCT path) AS r FROM requests GROUP BY 1) SELECT user, a AS admin_resources, r AS resources, CASE WHEN a > 5 THEN 0.9 WHEN a > 3 THEN 0.7 WHEN a > 1 THEN 0.5 ELSE 0.2 END::double AS score FROM g WHERE a > 0 AND r > a", "requests")
def _(t):
    edges = t.requests.select(F.col("user_id").cast("string").alias("src"), F.col("path").alias("dst")).distinct()
    kind = F.when(F.col("path").contains("/admin"), "admin").otherwise("page")
    return G.admin_lateral(edges, t.requests.select("path", kind.alias("type")).distinct())


@query("r14_graph_report", f"WITH {CS}, s AS (SELECT CASE WHEN sessions / ips > 5 AND failed > 5 THEN 0.9 WHEN sessions / ips > 3 AND failed > 3 THEN 0.7 WHEN sessions / ips > 2 AND failed > 1 THEN 0.5 ELSE 0.3 END AS score FROM g) SELECT count(*) AS threats, round(avg(score), 5) AS mean, count_if(score >= 0.7) AS high FROM s", "requests")
def _(t):
    return G.credential_stuffing(t.requests).agg(N().alias("threats"), rnd(F.avg("score")).alias("mean"), F.count_if(F.col("score") >= 0.7).alias("high"))


@query("r15_gnn_export", "WITH n AS (SELECT DISTINCT user_id::varchar AS id, 'User' AS label FROM requests UNION ALL SELECT DISTINCT session_id, 'Session' FROM requests UNION ALL SELECT DISTINCT ip, 'IP' FROM requests UNION ALL SELECT DISTINCT path, 'Resource' FROM requests), a AS (SELECT user_id::varchar AS id, 'User' AS label, count(*) AS k FROM requests GROUP BY 1), h AS (SELECT *, ('0x' || substr(md5('42|' || id), 1, 8))::bigint % 100 AS h FROM n) SELECT id, label, row_number() OVER (ORDER BY substr(md5(id), 1, 2), id, label) - 1 AS index, CASE WHEN h < 70 THEN 'train' WHEN h < 85 THEN 'val' ELSE 'test' END AS split, CASE label WHEN 'IP' THEN 0 WHEN 'Resource' THEN 1 WHEN 'Session' THEN 2 ELSE 3 END AS label_index, coalesce(k, 0)::double AS actions, CASE label WHEN 'User' THEN 9 WHEN 'Session' THEN 10 WHEN 'IP' THEN 11 ELSE 13 END AS kind_at, 13 AS features FROM h LEFT JOIN a USING (id, label)", "requests")
def _(t):
    nodes, edges = G.build_graph(t.requests)
    acts = t.requests.groupBy(F.col("user_id").cast("string").alias("id")).agg(N().alias("action_count")).withColumn("label", F.lit("User"))
    out, _ = G.gnn_export(nodes.join(acts, ["id", "label"], "left"), edges)
    f = F.col("features")
    return out.select("id", "label", "index", "split", "label_index", f[3].alias("actions"), (F.array_position(F.slice(f, 8, 6), 1.0) + 7).cast("int").alias("kind_at"), F.size(f).alias("features"))


USERS = "xu AS (SELECT DISTINCT a.user_id AS x, b.user_id AS y FROM requests a JOIN requests b ON a.country = b.country AND a.user_id < b.user_id AND abs(epoch_us(a.ts) - epoch_us(b.ts)) <= 60000000), u AS (SELECT x AS src, y AS dst FROM xu UNION ALL SELECT y, x FROM xu), d AS (SELECT src, count(*) AS d FROM u GROUP BY src)"


def user_graph(t):
    return G.met_within(t.requests.select("user_id", "ts", "country"), "user_id", "ts", 60, "country")


@query("r16_topology", f"WITH RECURSIVE {USERS}, h(node, root) AS (SELECT src, src FROM u UNION SELECT u.dst, h.root FROM h JOIN u ON h.node = u.src WHERE u.dst > h.root), cc AS (SELECT node, min(root) AS c FROM h GROUP BY node), tr AS (SELECT a.src, count(*) AS t FROM u a JOIN u b ON a.src = b.src AND a.dst <> b.dst JOIN u c ON c.src = a.dst AND c.dst = b.dst GROUP BY a.src), cl AS (SELECT coalesce(t, 0) / (d * (d - 1)) AS c FROM d LEFT JOIN tr USING (src) WHERE d > 1 UNION ALL SELECT 0 FROM d WHERE d < 2) SELECT count(*) AS nodes, (sum(d) / 2)::bigint AS edges, max(d) AS max_degree, round(sum(d) / (count(*) * (count(*) - 1)), 6) AS density, round((SELECT avg(c) FROM cl), 6) AS clustering, (SELECT count(DISTINCT c) FROM cc) AS components FROM d", "requests")
def _(t):
    return G.topology(user_graph(t), once=True).withColumn("density", rnd("density", 6)).withColumn("clustering", rnd("clustering", 6))


@query("r16_centrality", f"WITH {UND}, d AS (SELECT src AS node, count(*) AS degree FROM u GROUP BY src) SELECT node, degree, round(degree / ((SELECT count(*) FROM d) - 1), 6) AS centrality FROM d ORDER BY degree DESC, node LIMIT 10", "edges")
def _(t):
    return G.degree_centrality(t.edges).withColumn("centrality", rnd("centrality", 6))


def spread_labels(rounds: int = 8) -> str:
    """Label propagation over u(src, dst) in SQL, as many rounds as the graph's diameter at least."""
    steps = ["l0 AS MATERIALIZED (SELECT DISTINCT src AS node, src AS l FROM u)"]
    for i in range(1, rounds + 1):
        near = f"SELECT u.src AS node, min(l) AS m FROM u JOIN l{i - 1} p ON u.dst = p.node GROUP BY u.src"
        steps.append(f"l{i} AS MATERIALIZED (SELECT node, least(l, m) AS l FROM l{i - 1} JOIN ({near}) x USING (node))")
    return ", ".join(steps)


@query("r16_components", f"WITH {UND.replace('u AS', 'u AS MATERIALIZED')}, {spread_labels()} SELECT node, l AS component FROM l8", "edges")
def _(t):
    return G.components(t.edges)


@query("r16_triangles", f"WITH {USERS} SELECT count(*) AS triangles FROM xu e JOIN xu f ON e.y = f.x JOIN xu g ON g.x = e.x AND g.y = f.y", "requests")
def _(t):
    return G.triangles(user_graph(t), once=True)


@query("r17_ioc_neighbors", "SELECT DISTINCT ioc, neighbor, type FROM (SELECT src AS ioc, dst AS neighbor, type FROM edges UNION ALL SELECT dst, src, type FROM edges) WHERE ioc IN ('s1', 's2', 'c3')", "edges")
def _(t):
    return G.ioc_neighbors(t.edges, t.spark.createDataFrame([("s1",), ("s2",), ("c3",)], "ioc string"))


IOCS = "SELECT s_nationkey % 5 AS case_id, s_name AS ioc, s_acctbal / 10000 AS score FROM {supplier}"
ACTORS = "SELECT n_regionkey AS case_id, n_name AS actor, n_nationkey / 25.0D AS confidence FROM {nation}"
GRAPH = "SELECT s_name AS id, 'ioc' AS type, 0.0D AS score FROM {supplier} UNION ALL SELECT c_name, 'host', 0.1D FROM {customer}"


@query("r17_update_threat_graph", "WITH i AS (SELECT s_nationkey % 5 AS case_id, s_name AS ioc, s_acctbal / 10000 AS score FROM supplier), a AS (SELECT n_regionkey AS case_id, n_name AS actor, n_nationkey / 25.0 AS confidence FROM nation), n AS (SELECT 'ioc' AS type, score FROM (SELECT ioc, max(score) AS score FROM i GROUP BY ioc) UNION ALL SELECT 'host', 0.1 FROM customer UNION ALL SELECT 'threat_actor', confidence FROM a), e AS (SELECT actor AS src, ioc AS dst, max(confidence) AS confidence FROM a JOIN i USING (case_id) GROUP BY 1, 2), g AS (SELECT type, 0.5 AS c FROM edges) SELECT 'node ' || type AS kind, count(*) AS n, round(sum(score), 4)::double AS weight FROM n GROUP BY type UNION ALL SELECT 'edge attributed_to', count(*), round(sum(confidence), 4)::double FROM e UNION ALL SELECT 'edge ' || type, count(*), round(sum(c), 4)::double FROM g GROUP BY type", "edges")
def _(t):
    sql = lambda q, **k: t.spark.sql(q, **k)
    iocs, actors = sql(IOCS, supplier=t.supplier), sql(ACTORS, nation=t.nation)
    known = t.edges.withColumn("confidence", F.lit(0.1))
    nodes, edges = G.update_threat_graph(sql(GRAPH, supplier=t.supplier, customer=t.customer), known, iocs, t.edges.withColumn("confidence", F.lit(0.5)), actors)
    sums = lambda d, kind, w: d.groupBy(F.concat_ws(" ", F.lit(kind), "type").alias("kind")).agg(N().alias("n"), rnd(F.sum(w), 4).alias("weight"))
    return sums(nodes, "node", "score").unionByName(sums(edges, "edge", "confidence"))


# --- limits and feedback ------------------------------------------------------------------------


@query("l01_limit_sliding", "WITH RECURSIVE b AS (SELECT request_id, ip, epoch_us(ts) AS us, row_number() OVER (PARTITION BY ip ORDER BY epoch_us(ts), request_id) AS i FROM requests), r AS (SELECT request_id, ip, i, true AS allowed, [us] AS kept FROM b WHERE i = 1 UNION ALL SELECT b.request_id, b.ip, b.i, len(list_filter(r.kept, lambda x: x >= b.us - 86400000000)) < 2, CASE WHEN len(list_filter(r.kept, lambda x: x >= b.us - 86400000000)) < 2 THEN list_append(list_filter(r.kept, lambda x: x >= b.us - 86400000000), b.us) ELSE list_filter(r.kept, lambda x: x >= b.us - 86400000000) END FROM r JOIN b ON b.ip = r.ip AND b.i = r.i + 1) SELECT request_id, allowed FROM r", "requests")
def _(t):
    return L.replay(t.requests, "ip", "sliding", 2, 86400).select("request_id", "allowed")


@query("l02_limit_token_bucket", "WITH RECURSIVE b AS (SELECT request_id, ip, epoch_us(ts) AS us, row_number() OVER (PARTITION BY ip ORDER BY epoch_us(ts), request_id) AS i FROM requests), r AS (SELECT request_id, ip, i, us, true AS allowed, 2::bigint AS tokens FROM b WHERE i = 1 UNION ALL SELECT b.request_id, b.ip, b.i, b.us, least(3, r.tokens + (b.us - r.us) // 43200000000) >= 1, least(3, r.tokens + (b.us - r.us) // 43200000000) - CASE WHEN least(3, r.tokens + (b.us - r.us) // 43200000000) >= 1 THEN 1 ELSE 0 END FROM r JOIN b ON b.ip = r.ip AND b.i = r.i + 1) SELECT request_id, allowed, tokens AS remaining FROM r", "requests")
def _(t):
    return L.replay(t.requests, "ip", "token_bucket", 3, 86400, 1 / 43200).select("request_id", "allowed", "remaining")


KEPT = "list_filter(r.kept, lambda x: x >= b.us - 86400000000)"
LEFT = f"least(3 - len({KEPT}), least(3, r.tokens + (b.us - r.us) // 43200000000))"


@query("l03_limit_hybrid", f"WITH RECURSIVE b AS (SELECT request_id, ip, epoch_us(ts) AS us, row_number() OVER (PARTITION BY ip ORDER BY epoch_us(ts), request_id) AS i FROM requests), r AS (SELECT request_id, ip, i, us, true AS allowed, 2::bigint AS remaining, [us] AS kept, 2::bigint AS tokens FROM b WHERE i = 1 UNION ALL SELECT b.request_id, b.ip, b.i, b.us, {LEFT} >= 1, greatest(0, {LEFT} - ({LEFT} >= 1)::int), CASE WHEN {LEFT} >= 1 THEN list_append({KEPT}, b.us) ELSE {KEPT} END, least(3, r.tokens + (b.us - r.us) // 43200000000) - ({LEFT} >= 1)::int FROM r JOIN b ON b.ip = r.ip AND b.i = r.i + 1) SELECT request_id, allowed, remaining FROM r", "requests")
def _(t):
    return L.replay(t.requests, "ip", "hybrid", 3, 86400, 1 / 43200).select("request_id", "allowed", "remaining")


@query("l04_effective_limit", "SELECT request_id, greatest(1, floor(round(100 * CASE severity WHEN 'low' THEN 1.2 WHEN 'medium' THEN 0.8 ELSE 0.5 END * (0.5 + parity / 8) * CASE WHEN country IN ('CN','RU','KP') THEN 0.5 ELSE 1.0 END * CASE WHEN hour(ts) BETWEEN 9 AND 17 AND isodow(ts) <= 5 THEN 0.9 WHEN isodow(ts) >= 6 THEN 1.1 ELSE 1.0 END, 6)))::bigint AS lim FROM requests", "requests")
def _(t):
    lim = L.effective_limit(F.lit(100), F.col("severity"), F.col("parity") / 8, S.geo_zone("country"), S.time_pattern("ts"))
    return t.requests.select("request_id", lim.cast("long").alias("lim"))


@query("l06_limit_advice", "WITH x AS (SELECT request_id, risk_score AS r, parity = 4 AS odd FROM requests) SELECT request_id, CASE WHEN r >= 0.9 THEN 'block' WHEN r >= 0.5 THEN 'limit' WHEN r >= 0.3 THEN 'monitor' ELSE 'allow' END AS action, round(CASE WHEN r >= 0.9 THEN 0.1 WHEN r >= 0.7 THEN 0.3 WHEN r >= 0.5 THEN 0.6 WHEN r >= 0.3 THEN 0.8 ELSE 1.0 END * CASE WHEN odd THEN 0.5 ELSE 1 END, 5)::double AS factor, round(least(1, CASE WHEN r >= 0.9 THEN 0.95 WHEN r >= 0.7 THEN 0.9 WHEN r >= 0.5 THEN 0.8 WHEN r >= 0.3 THEN 0.7 ELSE 0.8 END + CASE WHEN odd THEN 0.1 ELSE 0 END), 5)::double AS confidence FROM x", "requests")
def _(t):
    a = L.limit_advice(F.col("risk_score"), F.col("parity") == 4)
    return t.requests.select("request_id", a["action"].alias("action"), rnd(a["factor"]).alias("factor"), rnd(a["confidence"]).alias("confidence"))


@query("l07_limit_metrics", "SELECT epoch_us(date_trunc('hour', ts)) // 1000000 AS bucket, path, count(*) AS requests, count_if(status_code >= 400) AS violations, round(count_if(status_code >= 400) / count(*), 5) AS violation_rate, round(coalesce(count_if(status_code = 403) / nullif(count_if(status_code >= 400), 0), 1), 5) AS effectiveness FROM requests GROUP BY date_trunc('hour', ts), path", "requests")
def _(t):
    m = L.limit_metrics(t.requests, "path")
    return m.select(F.unix_timestamp("bucket").alias("bucket"), "path", "requests", "violations", rnd("violation_rate").alias("violation_rate"), rnd("effectiveness").alias("effectiveness"))


@query("l08_limit_violations", "WITH v AS (SELECT request_id, severity, count(*) OVER (PARTITION BY ip ORDER BY ts, request_id) AS nth FROM requests WHERE status_code >= 400) SELECT request_id, nth, CASE WHEN nth > 10 THEN 'critical' WHEN severity = 'high' OR nth > 5 THEN 'high' WHEN severity = 'medium' OR nth > 2 THEN 'medium' ELSE 'low' END AS level FROM v", "requests")
def _(t):
    v = L.limit_violations(t.requests, F.col("status_code") >= 400)
    return v.select("request_id", "nth", F.col("violation_severity").alias("level"))


@query("l09_limit_trend", "WITH h AS (SELECT date_trunc('hour', ts) AS h, avg((status_code >= 400)::int) AS v, avg(duration_ms) AS l FROM requests WHERE ts >= TIMESTAMP '2024-01-20' - INTERVAL 48 HOUR AND ts < TIMESTAMP '2024-01-20' GROUP BY 1), s AS (SELECT h, least(v * 2, 1) * 0.7 + greatest(0, 1 - l / 50) * 0.3 AS s FROM h), x AS (SELECT avg(CASE WHEN h >= TIMESTAMP '2024-01-20' - INTERVAL 24 HOUR THEN s END) AS r, avg(CASE WHEN h < TIMESTAMP '2024-01-20' - INTERVAL 24 HOUR THEN s END) AS b FROM s) SELECT round(r, 5) AS recent, round(b, 5) AS before, CASE WHEN (r - b) / b > 0.05 THEN 'improving' WHEN (r - b) / b < -0.05 THEN 'degrading' ELSE 'stable' END AS trend FROM x", "requests")
def _(t):
    out = L.limit_trend(t.requests, "2024-01-20", hours=24)
    return out.select(rnd("recent").alias("recent"), rnd("before").alias("before"), "trend")


def outliers(name: str, rel: str) -> str:
    m = f"SELECT *, quantile_cont(v::double, 0.5) OVER () AS md FROM ({rel})"
    d = f"SELECT *, quantile_cont(abs(v - md), 0.5) OVER () AS mad FROM ({m})"
    z = f"SELECT item, v, CASE WHEN mad > 0 THEN 0.6745 * (v - md) / mad END AS z FROM ({d})"
    return f"SELECT '{name}' AS insight, item::varchar AS item, v::double AS value, z, CASE WHEN z > 10 THEN 'critical' WHEN z > 6 THEN 'high' ELSE 'medium' END AS severity FROM ({z}) WHERE z > 3.5"


@query(
    "l10_limit_insights",
    "WITH al AS (" + " UNION ALL ".join([
        outliers("abuse_pattern", "SELECT ip AS item, count_if(status_code >= 400) AS v FROM requests GROUP BY 1"),
        outliers("performance_issue", "SELECT path AS item, avg(duration_ms) AS v FROM requests GROUP BY 1"),
        outliers("geographic_threat", "SELECT country AS item, avg((status_code >= 400)::int) AS v FROM requests GROUP BY 1"),
        outliers("temporal_anomaly", "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS item, count(*) AS v FROM requests GROUP BY 1"),
        "SELECT 'policy_optimization', path, count(*)::double, NULL::double, 'low' FROM requests GROUP BY path HAVING avg((status_code >= 400)::int) = 0",
    ]) + ") SELECT insight, item, round(value, 4) AS value, round(z, 4) AS z, severity, CASE insight " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in Y.ADVICE.items()) + " END AS recommendation FROM al",
    "requests",
)
def _(t):
    return Y.limit_insights(t.requests).withColumn("value", rnd("value", 4)).withColumn("z", rnd("z", 4))


@query("l10_limit_optimizations", "WITH m AS (SELECT count_if(status_code = 403 AND risk_score < 0.3) / nullif(count_if(status_code = 403), 0) AS f, count_if(status_code = 403) / nullif(count_if(status_code >= 400), 0) AS e, avg(duration_ms) AS l FROM requests), al AS (SELECT 'threshold_tuning' AS type, f AS value, 0.15 AS expected_improvement, 0.8 AS confidence, 'medium' AS difficulty, 'medium' AS risk_level FROM m WHERE f > 0.1 UNION ALL SELECT 'policy_adjustment', e, 0.25, 0.7, 'easy', 'low' FROM m WHERE e < 0.8 UNION ALL SELECT 'algorithm_change', l, 0.1, 0.9, 'hard', 'medium' FROM m WHERE l > 10) SELECT type, round(value, 4) AS value, expected_improvement::double AS expected_improvement, confidence::double AS confidence, difficulty, risk_level FROM al", "requests")
def _(t):
    o = Y.limit_optimizations(t.requests, F.col("status_code") == 403, F.col("status_code") >= 400, F.col("risk_score") < 0.3)
    return o.withColumn("value", rnd("value", 4))


ACT = "CASE event_type WHEN 'error' THEN 'block' WHEN 'click' THEN 'monitor' WHEN 'view' THEN 'allow' WHEN 'signup' THEN 'challenge' ELSE 'isolate' END"
REW = f"greatest(0, least(1, CASE WHEN risk_score > 0.7 AND {ACT} <> 'allow' THEN 0.3 ELSE 0 END - CASE WHEN risk_score <= 0.3 AND {ACT} <> 'allow' THEN 0.25 ELSE 0 END + CASE WHEN status_code < 400 THEN 0.15 ELSE -0.075 END + CASE WHEN {ACT} IN ('allow', 'monitor') THEN 0.1 ELSE -0.05 END + CASE WHEN parity = 0 THEN -0.2 ELSE 0.2 END))"


def feedback(t):
    r = t.requests.withColumn("action", F.expr(ACT))
    s = L.auto_signals(F.col("risk_score"), F.col("action"), F.col("parity") == 0, F.col("status_code") < 400)
    return L.feedback_reward(r.withColumn("signals", s))


@query("b01_feedback_reward", f"SELECT request_id, round({REW}, 5) AS reward FROM requests", "requests")
def _(t):
    return feedback(t).select("request_id", rnd("reward").alias("reward"))


@query("b02_auto_signals", f"SELECT request_id, (1 + 1 + 1 + CASE WHEN risk_score > 0.7 AND {ACT} <> 'allow' THEN 1 ELSE 0 END + CASE WHEN risk_score <= 0.3 AND {ACT} <> 'allow' THEN 1 ELSE 0 END)::int AS n FROM requests", "requests")
def _(t):
    return feedback(t).select("request_id", F.size("signals").alias("n"))


@query("b03_outcome_reward", "SELECT request_id, CASE WHEN parity = 0 THEN -2 WHEN parity = 1 THEN -1 WHEN status_code = 403 THEN 1 ELSE 0 END AS reward FROM requests", "requests")
def _(t):
    return t.requests.select("request_id", L.outcome_reward(F.col("status_code") == 403, F.col("parity") == 1, F.col("parity") == 0).alias("reward"))


PO = f"f AS (SELECT country, {ACT} AS action, {REW} AS reward FROM requests), po AS (SELECT country, action, count_if(reward >= 0.5) + 1 AS a, count(*) - count_if(reward >= 0.5) + 1 AS b, count(*) AS n FROM f GROUP BY 1, 2)"


@query("b04_beta_posterior", f"WITH {PO} SELECT country, action, a::double AS alpha, b::double AS beta, n AS selections FROM po", "requests")
def _(t):
    f = feedback(t)
    p = L.beta_posterior(f, ["country", "action"])
    return p.select("country", "action", F.col("alpha").cast("double").alias("alpha"), F.col("beta").cast("double").alias("beta"), "selections")


@query("b05_bandit_stats", f"WITH {PO} SELECT country, arg_max(action, struct_pack(e := a / (a + b), x := action)) AS best, round(max(a / (a + b)), 5) AS expected, bool_and(n >= 10) AS enough FROM po GROUP BY country", "requests")
def _(t):
    f = feedback(t)
    return L.bandit_stats(L.beta_posterior(f, ["country", "action"]), "country", "action").withColumn("expected", rnd("expected"))


@query("b06_select_actions")
def _(t):
    p = L.beta_posterior(feedback(t), ["country", "action"]).select("country", "action", "alpha", "beta")
    return L.select_actions(t.requests.select("request_id", "country"), p, "country", "action", "request_id")


@query("b07_decision_context", "SELECT request_id, concat(CASE WHEN risk_score <= 0.3 THEN 'low' WHEN risk_score <= 0.7 THEN 'medium' ELSE 'high' END, ':', CASE WHEN parity / 4 <= 0.4 THEN 'suspicious' WHEN parity / 4 <= 0.7 THEN 'unknown' ELSE 'trusted' END) AS context FROM requests", "requests")
def _(t):
    return t.requests.select("request_id", L.decision_context(F.col("risk_score"), F.col("parity") / 4).alias("context"))


@query("b07_immediate_reward", f"WITH x AS (SELECT request_id, risk_score AS r, parity, {ACT} AS a FROM requests), y AS (SELECT *, CASE a WHEN 'allow' THEN 0 WHEN 'monitor' THEN 0.25 WHEN 'challenge' THEN 0.5 WHEN 'block' THEN 0.75 ELSE 1 END AS p FROM x) SELECT request_id, round(CASE WHEN parity = 0 THEN 0 ELSE CASE WHEN r > 0.7 AND p >= 0.5 THEN 0.3 ELSE 0 END + CASE WHEN r <= 0.3 AND a = 'allow' THEN 0.15 ELSE 0 END + CASE WHEN a = 'allow' THEN 0.1 ELSE 0 END + 0.2 * (1 - p) END, 5)::double AS reward FROM y", "requests")
def _(t):
    return t.requests.select("request_id", rnd(L.immediate_reward(F.expr(ACT), F.col("risk_score"), F.col("parity") != 0)).alias("reward"))


@query("b08_bandit_history", "SELECT request_id, round(sum(risk_score) OVER w, 3) AS cumulative, round(avg((parity > 0)::int) OVER w, 5) AS exploitation_rate, round(sum(1 - risk_score) OVER w, 3) AS regret FROM requests WINDOW w AS (PARTITION BY country ORDER BY ts, request_id)", "requests")
def _(t):
    h = L.bandit_history(t.requests, "country", "risk_score", F.col("parity") > 0, F.lit(1.0))
    return h.select("request_id", rnd("cumulative", 3).alias("cumulative"), rnd("exploitation_rate").alias("exploitation_rate"), rnd("regret", 3).alias("regret"))


# --- forensics ----------------------------------------------------------------------------------


@query("h01_port_scans", "SELECT source, count(DISTINCT port) AS ports FROM connections GROUP BY 1 HAVING count(DISTINCT port) > 100", "connections")
def _(t):
    return H.port_scans(t.connections, "source", "port")


@query("h02_rare_groups", "WITH g AS (SELECT destination, count(*) AS n FROM connections GROUP BY 1) SELECT destination, n FROM g WHERE n < (SELECT quantile_cont(n, 0.05) FROM g)", "connections")
def _(t):
    return H.rare_groups(t.connections, "destination")


ABOVE = "WITH g AS (SELECT source, {m} AS v FROM connections GROUP BY 1), p AS (SELECT quantile_cont(v, {p}) AS p FROM g) SELECT source, round(v, 2) AS value, round(least(10, v / p), 5) AS risk FROM g, p WHERE v > p"


@query("h03_hunt_exfiltration", ABOVE.format(m="sum(bytes)", p=0.95), "connections")
def _(t):
    return H.hunt_above(t.connections, "source", F.sum("bytes"), 0.95).select("source", rnd("value", 2).alias("value"), rnd("risk").alias("risk"))


@query("h04_hunt_fanout", ABOVE.format(m="count(DISTINCT destination)", p=0.9), "connections")
def _(t):
    return H.hunt_above(t.connections, "source", F.count_distinct("destination"), 0.9).select("source", rnd("value", 2).alias("value"), rnd("risk").alias("risk"))


@query("h05_hunt_dns", "SELECT url, string_agg(DISTINCT cast(page_id % 7 AS varchar), ',' ORDER BY cast(page_id % 7 AS varchar)) AS sources, count(*) AS n FROM pages WHERE contains(url, 'track') OR contains(url, 'ads') GROUP BY url")
def _(t):
    p = t.pages.withColumn("src", (F.col("page_id") % 7).cast("string"))
    return H.hunt_dns(p, "url", "src", ["track", "ads"]).withColumn("sources", F.array_join("sources", ","))


@query("h06_hunt", f"WITH f AS (SELECT 'exfiltration' AS hunt, source, value::double AS value FROM ({ABOVE.format(m='sum(bytes)', p=0.95)}) a UNION ALL SELECT 'fanout', source, value FROM ({ABOVE.format(m='count(DISTINCT destination)', p=0.9)}) b UNION ALL SELECT 'scan', source, ports FROM (SELECT source, count(DISTINCT port) AS ports FROM connections GROUP BY 1 HAVING count(DISTINCT port) > 100)) SELECT hunt, source, round(value, 2) AS value, CASE WHEN source IS NULL THEN 'low' ELSE 'high' END AS severity FROM (SELECT unnest(['exfiltration', 'fanout', 'scan']) AS hunt) LEFT JOIN f USING (hunt)", "connections")
def _(t):
    return H.hunt_all(t.connections).withColumn("value", rnd("value", 2))


@query("h07_forensic_report", f"WITH u AS MATERIALIZED (SELECT DISTINCT * FROM (SELECT concat('s', source::varchar) AS src, concat('d', destination::varchar) AS dst FROM connections UNION ALL SELECT concat('d', destination::varchar), concat('s', source::varchar) FROM connections)), {spread_labels()}, d AS (SELECT src, count(*) AS d FROM u GROUP BY src), tm AS (SELECT 'hour' AS unit, hour(ts) AS slot, count(*) AS n FROM connections GROUP BY 2 UNION ALL SELECT 'weekday', isodow(ts) - 1, count(*) FROM connections GROUP BY 2 UNION ALL SELECT 'day', day(ts), count(*) FROM connections GROUP BY 2), pr AS (SELECT protocol, count(*) AS n, sum(bytes) AS b FROM connections GROUP BY 1), hv AS (SELECT n, abs(n - avg(n) OVER ()) / nullif(stddev_pop(n) OVER (), 0) AS z FROM tm WHERE unit = 'hour'), al AS ("
    "SELECT 'basic' AS section, 'connections' AS metric, count(*)::double AS value FROM connections UNION ALL SELECT 'basic', 'bytes', sum(bytes)::double FROM connections UNION ALL SELECT 'basic', 'packets', sum(packets)::double FROM connections UNION ALL SELECT 'basic', 'mean_bytes', avg(bytes)::double FROM connections UNION ALL SELECT 'basic', 'sources', count(DISTINCT source) FROM connections UNION ALL SELECT 'basic', 'destinations', count(DISTINCT destination) FROM connections "
    "UNION ALL SELECT 'protocol', protocol, n FROM pr UNION ALL SELECT 'protocol_bytes', protocol, b FROM pr UNION ALL SELECT 'time', concat(unit, ':', slot::varchar), n FROM tm UNION ALL SELECT 'peak', unit, slot FROM tm QUALIFY row_number() OVER (PARTITION BY unit ORDER BY n DESC, slot) = 1 "
    "UNION ALL SELECT 'port_class', CASE WHEN port < 1024 THEN 'well_known' WHEN port < 49152 THEN 'registered' ELSE 'dynamic' END, count(*) FROM connections GROUP BY 2 UNION ALL SELECT 'anomalies', 'volume_hours', count(*) FROM hv WHERE z > 3 UNION ALL SELECT 'anomalies', 'port_scan_sources', count(*) FROM (SELECT source FROM connections GROUP BY 1 HAVING count(DISTINCT port) > 100) UNION ALL SELECT 'anomalies', 'rare_protocols', count(*) FROM pr WHERE n < (SELECT quantile_cont(n, 0.05) FROM pr) "
    "UNION ALL SELECT 'topology', 'nodes', count(*) FROM d UNION ALL SELECT 'topology', 'edges', sum(d) / 2 FROM d UNION ALL SELECT 'topology', 'max_degree', max(d) FROM d UNION ALL SELECT 'topology', 'density', sum(d) / (count(*) * (count(*) - 1)) FROM d UNION ALL SELECT 'topology', 'clustering', 0 UNION ALL SELECT 'topology', 'components', count(DISTINCT l) FROM l8) SELECT section, metric, round(value, 2) AS value FROM al", "connections")
def _(t):
    """Sources and destinations are two kinds of node, so there are no triangles."""
    return H.forensic_report(t.connections).withColumn("value", rnd("value", 2))


def cases(t):
    ents = t.assets.select(F.col("asset_id").alias("case_id"), "ip")
    return H.investigation_context(E.enrich_assets(t.requests, t.assets), ents, "2024-01-15")


CASES = "c AS (SELECT a.asset_id AS case_id, r.*, coalesce((SELECT max(criticality_score) FROM assets z WHERE z.ip = r.ip), (SELECT max(criticality_score) FROM assets z WHERE z.hostname = r.host), 1.0)::double AS crit FROM requests r JOIN assets a ON a.ip = r.ip WHERE r.ts <= TIMESTAMP '2024-01-15' AND r.ts >= TIMESTAMP '2024-01-12')"


@query("h08_investigation_context", f"WITH {CASES} SELECT case_id, request_id FROM c", "requests", "assets")
def _(t):
    return cases(t).select("case_id", "request_id")


KC = "k AS (SELECT case_id, ts, unnest([CASE WHEN contains(lower(event_type), 'login') OR contains(lower(event_type), 'auth') THEN 'initial_access' END, CASE WHEN contains(lower(event_type), 'exec') OR contains(lower(body), 'powershell') OR contains(lower(body), 'cmd') THEN 'execution' END, CASE WHEN contains(lower(body), 'registry') OR contains(lower(body), 'startup') OR contains(lower(body), 'scheduled task') THEN 'persistence' END, CASE WHEN contains(lower(body), 'remote') OR contains(lower(body), 'psexec') OR contains(lower(body), 'lateral') THEN 'lateral_movement' END, CASE WHEN contains(lower(event_type), 'exfil') OR contains(lower(event_type), 'large_upload') OR contains(lower(body), 'transfer') THEN 'exfiltration' END]) AS stage FROM x), kc AS (SELECT case_id, stage, count(*) AS n, min(ts) AS first_seen, max(ts) AS last_seen FROM k WHERE stage IS NOT NULL GROUP BY 1, 2)"
STAGED = "x AS (SELECT * REPLACE (CASE event_type WHEN 'signup' THEN 'login_failed' WHEN 'purchase' THEN 'large_upload' ELSE event_type END AS event_type, CASE request_id % 10 WHEN 5 THEN 'psexec remote' WHEN 6 THEN 'registry startup' ELSE body END AS body) FROM c)"


def shared(t):
    """The events of one case for each address, and the cases that share them."""
    ents, members = H.shared_cases(t.assets.select(F.col("asset_id").alias("case_id"), "ip"))
    return H.investigation_context(E.enrich_assets(t.requests, t.assets), ents, "2024-01-15"), members


def staged(events):
    """Events of cases with types and bodies that show every stage."""
    k = F.when(F.col("event_type") == "signup", "login_failed").when(F.col("event_type") == "purchase", "large_upload").otherwise(F.col("event_type"))
    b = F.when(F.col("request_id") % 10 == 5, "psexec remote").when(F.col("request_id") % 10 == 6, "registry startup").otherwise(F.col("body"))
    return events.withColumns({"event_type": k, "body": b})


@query("h09_kill_chain_timeline", f"WITH {CASES}, {STAGED}, {KC} SELECT case_id, stage, n, epoch_us(first_seen) AS first_seen, epoch_us(last_seen) AS last_seen FROM kc", "requests", "assets")
def _(t):
    events, members = shared(t)
    k = H.for_all_cases(H.kill_chain_timeline(staged(events), "case_id", "ts", "event_type", "body"), members)
    return k.withColumns({c: F.unix_micros(F.col(c).cast("timestamp")) for c in ("first_seen", "last_seen")})


INC = f"{CASES}, g AS (SELECT case_id, count(*) AS events, count(DISTINCT host) AS hosts, max(crit) AS cr FROM c GROUP BY 1), s AS (SELECT *, least(1, 0.2 + least(0.2, events * 0.03) + least(0.3, hosts * 0.05) + least(0.3, cr / 10)) AS sc FROM g)"


@query("h10_incident_score", f"WITH {INC} SELECT case_id, events, hosts, round(sc, 4) AS score, CASE WHEN sc >= 0.8 THEN 'critical' WHEN sc >= 0.65 THEN 'high' WHEN sc >= 0.45 THEN 'medium' ELSE 'low' END AS severity FROM s", "requests", "assets")
def _(t):
    events, members = shared(t)
    s = H.for_all_cases(H.incident_score(events, "case_id", "host", "criticality", "event_type", "body"), members)
    return s.select("case_id", "events", "hosts", rnd("score", 4).alias("score"), "severity")


@query(
    "h11_incident_report",
    f"WITH {CASES}, {STAGED}, {KC}, g AS (SELECT case_id, count(*) AS events, count(DISTINCT host) AS hosts, max(crit) AS cr, max((contains(lower(event_type), 'exfil') OR contains(lower(event_type), 'large_upload') OR contains(lower(body), 'transfer'))::int) AS ex, max((contains(lower(body), 'remote') OR contains(lower(body), 'psexec') OR contains(lower(body), 'lateral'))::int) AS la, "
    "string_agg(DISTINCT host, ',' ORDER BY host) AS systems, concat_ws(',', CASE WHEN bool_or(contains(lower(body), 'powershell')) THEN 'T1059.001' END, CASE WHEN bool_or(contains(lower(body), 'psexec')) THEN 'T1569.002' END) AS techniques FROM x GROUP BY 1), "
    "s AS (SELECT *, least(1, 0.2 + least(0.2, events * 0.03) + least(0.3, hosts * 0.05) + least(0.3, cr / 10) + 0.2 * ex + 0.15 * la) AS sc FROM g), "
    "o AS (SELECT case_id, string_agg(concat(stage, ':', n), ',' ORDER BY list_position(['initial_access', 'execution', 'persistence', 'lateral_movement', 'exfiltration'], stage)) AS stages FROM kc GROUP BY 1), "
    "r AS (SELECT case_id, ts, request_id, row_number() OVER (PARTITION BY case_id ORDER BY ts, request_id) AS a, row_number() OVER (PARTITION BY case_id ORDER BY ts DESC, request_id DESC) AS b FROM x), tl AS (SELECT case_id, string_agg(request_id::varchar, ',' ORDER BY ts, request_id) AS timeline FROM r WHERE a <= 3 OR b <= 3 GROUP BY 1) "
    "SELECT case_id, round(sc, 4) AS score, CASE WHEN sc >= 0.8 THEN 'critical' WHEN sc >= 0.65 THEN 'high' WHEN sc >= 0.45 THEN 'medium' ELSE 'low' END AS severity, systems, techniques, stages, timeline FROM s LEFT JOIN o USING (case_id) JOIN tl USING (case_id)",
    "requests", "assets",
)
def _(t):
    events, members = shared(t)
    r = H.incident_report(staged(events), "case_id", "ts", "request_id", "host", "criticality", "event_type", "body", 3)
    r = H.for_all_cases(r, members)
    text = lambda c, f: F.array_join(F.transform(c, f), ",")
    return r.select(
        "case_id", rnd("score", 4).alias("score"), "severity", F.array_join("systems", ",").alias("systems"), F.array_join("techniques", ",").alias("techniques"),
        text("stages", lambda s: F.concat(s["stage"], F.lit(":"), s["n"].cast("string"))).alias("stages"),
        text("timeline", lambda e: e["id"].cast("string")).alias("timeline"),
    )


@query("h12_flow_anomalies", "WITH g AS (SELECT 'fan_out' AS kind, source AS entity, count(DISTINCT destination)::double AS v FROM connections GROUP BY 2 UNION ALL SELECT 'fan_in', destination, count(DISTINCT source) FROM connections GROUP BY 2 UNION ALL SELECT 'volume', source, sum(bytes) FROM connections GROUP BY 2), z AS (SELECT *, abs(v - avg(v) OVER (PARTITION BY kind)) / (stddev_pop(v) OVER (PARTITION BY kind) + 0.001) AS z FROM g) SELECT kind, entity, round(v, 2) AS value, round(z, 4) AS z FROM z WHERE z > 1.5", "connections")
def _(t):
    return H.flow_anomalies(t.connections).withColumn("value", rnd("value", 2)).withColumn("z", rnd("z", 4))


# --- models -------------------------------------------------------------------------------------


@query("e01_ml_features", "SELECT request_id, hour(ts) AS hour, isodow(ts) - 1 AS day_of_week, (isodow(ts) >= 6)::int AS is_weekend, (country NOT IN ('US','CA','GB'))::int AS is_foreign, contains(lower(user_agent), 'bot')::int AS is_bot, (NOT regexp_matches(user_agent, '(?i)mozilla/5\\.0.*(chrome|firefox|safari|edge)'))::int AS browser_anomaly FROM requests", "requests")
def _(t):
    return M.ml_features(t.requests).select("request_id", "hour", "day_of_week", "is_weekend", "is_foreign", "is_bot", "browser_anomaly")


@query("e02_impute", "WITH m AS (SELECT median(CASE WHEN event_id % 4 <> 0 THEN value END) AS m FROM events) SELECT event_id, CASE WHEN event_id % 4 <> 0 THEN value ELSE m END AS value, CASE WHEN event_id % 3 = 0 THEN 'unknown' ELSE event_type END AS event_type FROM events, m")
def _(t):
    e = t.events.select("event_id", F.when(F.col("event_id") % 4 != 0, F.col("value")).alias("value"), F.when(F.col("event_id") % 3 != 0, F.col("event_type")).alias("event_type"))
    return M.impute(e, ["value"], ["event_type"])


@query("e03_encode", "SELECT event_id, dense_rank() OVER (ORDER BY event_type)::int - 1 AS event_type_index, round(avg(value) OVER (PARTITION BY user_id), 5) AS user_id_target FROM events")
def _(t):
    e = M.target_encode(M.label_encode(t.events, "event_type"), "user_id", "value")
    return e.select("event_id", "event_type_index", rnd("user_id_target").alias("user_id_target"))


@query("e04_scale", "SELECT event_id, round((value - avg(value) OVER ()) / stddev_pop(value) OVER (), 5) AS value FROM events")
def _(t):
    return M.standard_scale(t.events.select("event_id", "value"), ["value"]).withColumn("value", rnd("value"))


@query("e05_stratified_split", "SELECT event_type, floor(count(*) * 0.8)::bigint AS train FROM events GROUP BY 1")
def _(t):
    return M.stratified_split(t.events, "event_type", "event_id").groupBy("event_type").agg(F.count_if(F.col("is_train")).alias("train"))


@query("e06_forest")
def _(t):
    f = M.ml_features(t.requests).withColumn("label", (F.col("status_code") >= 400).cast("int"))
    cols = ["hour", "day_of_week", "is_foreign", "is_bot", "mean_latency"]
    return M.train_forest(f, cols, "label").transform(M.assemble(f, cols)).select("request_id", "label", F.col("prediction").cast("int").alias("prediction"))


@query("e07_mlp")
def _(t):
    f = M.standard_scale(M.ml_features(t.requests).withColumn("label", (F.col("status_code") >= 400).cast("int")), ["hour", "mean_latency"])
    cols = ["hour", "is_foreign", "is_bot", "mean_latency"]
    return M.train_mlp(f, cols, "label", (16, 8)).transform(M.assemble(f, cols)).select("request_id", "label", F.col("prediction").cast("int").alias("prediction"))


@query("e08_isolation")
def _(t):
    cols = ["duration_ms", "status_code"]
    return M.isolation_score(t.requests.select("request_id", *cols), M.train_isolation(t.requests, cols, "request_id"), cols).select("request_id", "anomaly_score")


@query("e09_ensemble", "WITH s AS (SELECT request_id, risk_score * 0.4 + parity / 4 * 0.4 + 0.2 / (1 + exp(duration_ms / 100 - 2)) AS s FROM requests) SELECT request_id, round(s, 5) AS score, CASE WHEN s >= 0.9 THEN 'block' WHEN s >= 0.7 THEN 'challenge' WHEN s >= 0.5 THEN 'monitor' ELSE 'allow' END AS action FROM s", "requests")
def _(t):
    r = t.requests.withColumn("p", F.col("parity") / 4).withColumn("a", F.col("duration_ms") / 100 - 2)
    return M.ensemble_score(r, "risk_score", "p", "a").select("request_id", rnd("threat_score").alias("score"), "action")


@query("e10_evaluate", "WITH g AS (SELECT prob, sum(label) AS p, count(*) - sum(label) AS q FROM labelled GROUP BY prob), b AS (SELECT *, coalesce(sum(q) OVER (ORDER BY prob ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM g) SELECT round(sum(p * (below + q / 2)) / (sum(p) * sum(q)), 5) AS auc FROM b", "labelled")
def _(t):
    return M.auc(t.labelled, "prob", "label").withColumn("auc", rnd("auc"))


@query("e11_reconstruction")
def _(t):
    r = t.requests.select("request_id", F.col("duration_ms").alias("a"), F.col("content_length").cast("double").alias("b"), F.col("status_code").cast("double").alias("c"))
    return M.reconstruction_anomalies(r, ["a", "b", "c"], 2).select("request_id", "error", "is_anomaly")


@query("e12_needs_retrain", "SELECT count(*) AS n, count(*) >= 1000 OR max(ts) < TIMESTAMP '2024-01-31' - INTERVAL 24 HOUR AS retrain FROM events WHERE ts > TIMESTAMP '2024-01-31' - INTERVAL 7 DAY AND ts <= TIMESTAMP '2024-01-31'")
def _(t):
    return M.needs_retrain(t.events, "2024-01-31").select("n", "retrain")


# --- SQL functions and plug-ins -----------------------------------------------------------------


@query("z01_rule_set", "SELECT request_id FROM requests WHERE regexp_matches(body, '(?i)passwd')", "requests")
def _(t):
    from duskline.functions.plugins import RuleSet

    rules = RuleSet().add("a", "(?i)passwd").add("b", "hello").disable("b")
    return rules.match(t.requests.select("request_id", "body"), "body").select("request_id")


@query("z02_detector", "SELECT request_id FROM requests WHERE duration_ms > 200", "requests")
def _(t):
    from duskline.functions.plugins import DETECTORS, register_detector

    register_detector("slow", lambda df: df.filter("duration_ms > 200"))
    return DETECTORS["slow"](t.requests).select("request_id")


@query("z05_match_table", "SELECT page_id, unnest(regexp_extract_all(url, '[0-9]+')) AS value FROM pages")
def _(t):
    from duskline.functions.plugins import match_table

    return match_table(t.pages, "page_id", "url", {"number": "[0-9]+"}).select("page_id", "value")


@query("z06_sql_functions", "SELECT DISTINCT path, lower(regexp_replace(path, '[?#].*$', '')) AS norm FROM requests", "requests")
def _(t):
    from duskline.functions.plugins import register_functions

    register_functions(t.spark)
    return t.spark.sql("SELECT DISTINCT path, dl_normalize_path(path) AS norm FROM {r}", r=t.requests)
