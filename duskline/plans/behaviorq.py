"""Queries: anomalies of sessions, clusters of anomalous runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from duskline.operators import behavior as B
from duskline.operators import sequence as Q

from .registry import query, rnd

ORDER = ["ts", "request_id"]


def visits(t):
    """Requests with a context (suspicious if severe, normal if of low severity) and twice the risk, 1 at most."""
    c = F.when(F.col("severity") == "high", "suspicious").when(F.col("severity") == "low", "normal").otherwise("authenticated")
    return t.requests.select("session_id", "ts", "request_id", "event_type", F.least(F.lit(1.0), F.col("risk_score") * 2).alias("risk_score"), c.alias("context"))


VISITS = (
    "v AS (SELECT session_id, ts, request_id, event_type, least(1.0::double, risk_score * 2) AS risk_score, CASE severity WHEN 'high' THEN 'suspicious' WHEN 'low' THEN 'normal' ELSE 'authenticated' END AS context FROM requests), "
    "s AS (SELECT session_id, list(event_type ORDER BY ts, request_id) AS l, list(context ORDER BY ts, request_id) AS cs, list(epoch_us(ts) / 1e6 ORDER BY ts, request_id) AS tms, count(*) AS n, max(risk_score) AS risk FROM v GROUP BY 1), "
    "rs AS (SELECT session_id, i, k, array_to_string(l[i:i + k - 1], '>') AS pattern, l[i:i + k - 1] AS states, cs[i:i + k - 1] AS cx, risk FROM s, unnest(range(1, n)) a(i), unnest([2, 3, 4, 5]) b(k) WHERE i + k - 1 <= n), "
    "pr AS (SELECT pattern, count(*) AS c, count(DISTINCT session_id) AS support, any_value(states) AS states, list_sort(list_distinct(flatten(list(cx)))) AS contexts, avg(risk) AS mean_risk, avg(risk) > {risky} AS odd FROM rs GROUP BY 1 HAVING count(*) >= {least})"
)
SQL_LEVEL = "CASE WHEN mean_risk > 0.8 THEN 'critical' WHEN mean_risk > 0.6 THEN 'high' WHEN mean_risk > 0.4 THEN 'medium' ELSE 'low' END"


@query(
    "q08_pattern_profiles",
    f"WITH {VISITS.format(risky=0.7, least=2)} SELECT pattern, c AS count, support, array_to_string(contexts, ',') AS contexts, round(mean_risk, 4) AS mean_risk, {SQL_LEVEL} AS risk_level, odd AS is_anomalous, least(0.95, c / 50)::double AS confidence FROM pr",
    "requests",
)
def _(t):
    p = B.pattern_profiles(visits(t), "session_id", ORDER, "event_type", "context", "risk_score", 2)
    return p.select("pattern", "count", "support", F.array_join("contexts", ",").alias("contexts"), rnd("mean_risk", 4).alias("mean_risk"), "risk_level", "is_anomalous", "confidence")


@query(
    "q09_sequence_anomalies",
    f"WITH {VISITS.format(risky=0.7, least=3)}, tr AS (SELECT session_id, l[i] AS context, l[i + 1] AS next, tms[i + 1] - tms[i] AS gap FROM s, unnest(range(1, n)) a(i)), m AS (SELECT context, next, count(*) AS c FROM tr GROUP BY 1, 2), "
    "p AS (SELECT *, (c + 1) / (sum(c) OVER (PARTITION BY context) + count(*) OVER (PARTITION BY context)) AS p FROM m), mm AS (SELECT * FROM p WHERE c >= 5), "
    "st AS (SELECT session_id, count_if(p IS NULL) AS unseen, count_if(p < 0.1) AS rare, count_if(gap < 0.1 OR gap > 300) AS odd FROM tr LEFT JOIN mm USING (context, next) GROUP BY 1), "
    "cv AS (SELECT session_id, count(DISTINCT j) AS covered FROM rs JOIN pr USING (pattern), unnest(range(i, i + k)) x(j) GROUP BY 1), "
    "w AS (SELECT s.session_id, n AS steps, n < 2 AS short, CASE WHEN pr.c IS NULL THEN 0.8 WHEN pr.c < 5 THEN 0.6 WHEN pr.odd THEN 0.9 ELSE 0.2 END AS a, least(1, coalesce(unseen, 0) * 0.3::double) AS b, least(1, coalesce(st.odd, 0) * 0.2::double) AS g, coalesce(covered, 0) / n AS covered, "
    "list_contains(cs, 'suspicious') AS sus, list_contains(cs, 'normal') AS nor, coalesce(unseen, 0) + coalesce(rare, 0) > 0 AS bad, risk FROM s LEFT JOIN pr ON pattern = array_to_string(l, '>') LEFT JOIN st USING (session_id) LEFT JOIN cv USING (session_id)), "
    "z AS (SELECT *, CASE WHEN short THEN 0.5 ELSE a * 0.4 + b * 0.4 + g * 0.2 END AS score, CASE WHEN NOT short AND b > 0.8 THEN 'impossible_transition' WHEN NOT short AND g > 0.6 THEN 'timing_anomaly' WHEN NOT short AND sus AND nor THEN 'context_mismatch' ELSE 'rare_sequence' END AS type FROM w) "
    "SELECT session_id, steps, CASE WHEN NOT short THEN a END::double AS pattern_score, CASE WHEN NOT short THEN b END::double AS transition_score, CASE WHEN NOT short THEN g END::double AS timing_score, round(covered, 4) AS covered, round(score, 4)::double AS score, NOT short AND score > 0.7 AS is_anomalous, type, "
    "CASE WHEN short THEN 'low' WHEN score > 0.9 OR type = 'impossible_transition' THEN 'critical' WHEN score > 0.7 THEN 'high' WHEN score > 0.5 THEN 'medium' ELSE 'low' END AS severity, "
    "CASE WHEN short THEN '' ELSE concat_ws('; ', CASE WHEN bad THEN 'Invalid state transitions detected' END, CASE WHEN sus THEN 'Suspicious behavioral context' END, CASE WHEN risk > 0.7 THEN 'High risk score assigned' END) END AS risk_factors, "
    "CASE WHEN short THEN '' WHEN type = 'impossible_transition' THEN 'Investigate potential bot activity; Check for session hijacking' WHEN type = 'timing_anomaly' THEN 'Monitor for automated behavior; Consider rate limiting' WHEN type = 'context_mismatch' THEN 'Review authentication status; Check for privilege escalation' ELSE 'Monitor user behavior closely; Consider additional verification' END AS recommendations FROM z",
    "requests",
)
def _(t):
    v = visits(t)
    patterns = B.pattern_profiles(v, "session_id", ORDER, "event_type", "context", "risk_score", 3)
    matrix = Q.prune_transitions(Q.learn_transitions(v, "session_id", ORDER, "event_type"), 5)
    a = B.sequence_anomalies(v, patterns, matrix, "session_id", ORDER, "event_type", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6, "context", "risk_score")
    texts = {c: F.array_join(c, "; ") for c in ("risk_factors", "recommendations")}
    return a.withColumns(texts | {c: rnd(c, 4) for c in ("covered", "score", "pattern_score", "transition_score", "timing_score")})


@query(
    "q12_anomaly_clusters",
    f"WITH {VISITS.format(risky=0.7, least=1)}, o AS (SELECT *, {SQL_LEVEL} AS level FROM pr WHERE odd), k AS (SELECT *, concat(level, '|', array_to_string(contexts, ',')) AS cluster FROM o), "
    "g AS (SELECT cluster, count(*) AS patterns, count_if(level = 'critical') AS cr, count_if(level = 'high') AS hi, sum(least(3, c))::bigint AS affected, avg(CASE level WHEN 'critical' THEN 1 WHEN 'high' THEN 0.7 ELSE 0.3 END) AS risk FROM k GROUP BY 1), "
    "cx AS (SELECT cluster, list_sort(list(x)) AS xs FROM (SELECT cluster, x, count(*) AS c FROM k, unnest(contexts) u(x) GROUP BY 1, 2) JOIN g USING (cluster) WHERE c > 0.5 * patterns GROUP BY 1), "
    "ca AS (SELECT cluster, list_sort(list(x)) AS xs FROM (SELECT cluster, x, count(*) AS c FROM k, unnest(states) u(x) GROUP BY 1, 2) JOIN g USING (cluster) WHERE c > 0.6 * patterns GROUP BY 1) "
    "SELECT cluster, patterns, affected, round(risk, 4)::double AS risk_score, CASE WHEN cr > 0 THEN 'critical' WHEN hi > 0.5 * patterns THEN 'high' WHEN hi > 0 THEN 'medium' ELSE 'low' END AS severity, coalesce(array_to_string(cx.xs, ','), '') AS common_contexts, coalesce(array_to_string(ca.xs, ','), '') AS common_actions FROM g LEFT JOIN cx USING (cluster) LEFT JOIN ca USING (cluster)",
    "requests",
)
def _(t):
    c = B.anomaly_clusters(B.pattern_profiles(visits(t), "session_id", ORDER, "event_type", "context", "risk_score"))
    return c.select("cluster", "patterns", "affected", rnd("risk_score", 4).alias("risk_score"), "severity", *[F.array_join(x, ",").alias(x) for x in ("common_contexts", "common_actions")])
