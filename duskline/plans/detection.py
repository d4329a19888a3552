"""Queries: detection, score fusion, triage."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from duskline.functions import scalars as S
from duskline.operators import detect as D
from duskline.operators import explain as X

from .registry import query, rnd

BODY = "concat(body, chr(10), path)"


def sample():
    return F.concat("body", F.lit("\n"), "path")


@query("d01_sigma_match", "SELECT request_id, r.id AS rule FROM requests JOIN (SELECT 'r1' AS id, 'error' AS et, ['powershell', 'enc'] AS w UNION ALL SELECT 'r2', NULL, ['script'] UNION ALL SELECT 'r3', 'view', ['hello', '1']) r ON (r.et IS NULL OR r.et = event_type) AND len(list_filter(r.w, lambda x: NOT contains(lower(body), x))) = 0", "requests")
def _(t):
    rules = t.spark.createDataFrame([("r1", "error", ["powershell", "enc"]), ("r2", None, ["script"]), ("r3", "view", ["hello", "1"])], "id string, event_type string, contains array<string>")
    return D.sigma_match(t.requests, rules, "body").select("request_id", F.col("id").alias("rule"))


HEUR = " + ".join(f"CASE WHEN regexp_matches(s, '{p}') THEN {w} ELSE 0 END" for _, p, w in D.HEURISTICS)
HTYPES = ", ".join(f"CASE WHEN regexp_matches(s, '{p}') THEN '{n}' END" for n, p, _ in D.HEURISTICS)


@query(
    "d03_payload_heuristics",
    f"WITH x AS (SELECT request_id, {BODY} AS s FROM requests), y AS (SELECT request_id, least(1, {HEUR} + least(0.2, len(regexp_extract_all(s, '[<>''\"`;$|&]')) / 500)) AS score, concat_ws(',', {HTYPES}) AS types FROM x) "
    "SELECT request_id, CASE WHEN types = '' THEN 'none' ELSE types END AS types, round(score, 5) AS score, CASE WHEN score >= 0.85 THEN 'critical' WHEN score >= 0.65 THEN 'high' WHEN score >= 0.4 THEN 'medium' ELSE 'low' END AS level, round(least(1, 0.5 + score / 2), 5) AS confidence FROM y", "requests",
)
def _(t):
    out = D.payload_heuristics(t.requests, sample())
    return out.select("request_id", F.array_join("threat_types", ",").alias("types"), rnd("heuristic_score").alias("score"), F.col("heuristic_level").alias("level"), rnd("heuristic_confidence").alias("confidence"))


@query("d04_payload_scan", f"SELECT request_id, regexp_matches(body, '{D.PAYLOAD}') AS matched FROM requests", "requests")
def _(t):
    return t.requests.select("request_id", D.payload_scan(F.col("body")).alias("matched"))


SIGS = " UNION ALL ".join(f"SELECT '{n}' AS signature, '{c}' AS category, '{s}' AS severity, {1 - f}::double AS confidence, regexp_extract(body, '{p}', 0) AS matched, request_id, body FROM requests WHERE regexp_matches(body, '{p}')" for n, p, c, s, f in D.SIGNATURES)


@query("d05_signature_match", f"SELECT request_id, signature, category, severity, round(confidence, 5) AS confidence, instr(body, matched) AS position, matched FROM ({SIGS})", "requests")
def _(t):
    return D.signature_match(t.requests, "body", "request_id").withColumn("confidence", rnd("confidence"))


@query("d06_literal_match", "SELECT request_id, lit, instr(concat(path, ' ', user_agent, ' ', body), lit) AS position FROM requests, (SELECT unnest(['passwd', 'script', 'curl', 'powershell']) AS lit) WHERE contains(concat(path, ' ', user_agent, ' ', body), lit)", "requests")
def _(t):
    lits = t.spark.createDataFrame([("passwd",), ("script",), ("curl",), ("powershell",)], "lit string")
    return D.literal_match(t.requests, lits, "request_id")


CATALOGUE = [("num", r"[0-9]{4,}", "data", "low", 0.5), ("word_ing", r"\b[a-z]{6,}ing\b", "text", "medium", 0.8), ("rare", r"zzzz", "none", "high", 0.1)]


@query("d07_pattern_match", r"SELECT doc_id, pattern_id, matched FROM (SELECT doc_id, 'num' AS pattern_id, unnest(regexp_extract_all(text, '[0-9]{4,}')) AS matched FROM documents UNION ALL SELECT doc_id, 'word_ing', unnest(regexp_extract_all(text, '\b[a-z]{6,}ing\b')) FROM (SELECT doc_id, regexp_replace(text, '[^\x00-\x7f]', ' ', 'g') AS text FROM documents))")
def _(t):
    docs = t.documents
    num = D.pattern_match(docs, "text", "doc_id", CATALOGUE[:1], 0.4)
    ascii_ = docs.withColumn("text", F.regexp_replace("text", r"[^\x00-\x7f]", " "))
    return num.unionByName(D.pattern_match(ascii_, "text", "doc_id", CATALOGUE[1:], 0.4)).select("doc_id", "pattern_id", "matched")


VAL = lambda c: "least(1, " + " + ".join(f"CASE WHEN regexp_matches({c}, '{p}') THEN {s * 0.25} ELSE 0 END" for p, s in D.VALIDATION) + ")"


@query("d08_validate_requests", f"SELECT request_id, round(least(1, {VAL('path')} * 0.3 + {VAL('user_agent')} * 0.2 + {VAL('body')} * 0.5), 5) AS score FROM requests", "requests")
def _(t):
    return t.requests.select("request_id", rnd(D.validate_requests(F.col("path"), F.col("user_agent"), F.col("body"))).alias("score"))


@query("d10_extract_indicators", r"SELECT page_id, 'url' AS type, unnest(regexp_extract_all(url, 'https?://[^\s<>" + '"' + r"]+')) AS value FROM pages UNION ALL SELECT page_id, 'technique', unnest(regexp_extract_all(url, 'T[0-9]{4}(?:\.[0-9]{3})?')) FROM pages")
def _(t):
    return D.extract_indicators(t.pages, "url", "page_id").filter("type IN ('url', 'technique')")


@query("d11_shared_attack_patterns", "SELECT a.request_id AS a_id, b.request_id AS b_id FROM requests a JOIN requests b ON a.user_id = b.user_id AND a.request_id < b.request_id WHERE (contains(a.body, '1=1') AND contains(b.body, '1=1')) OR (contains(a.body, '<script') AND contains(b.body, '<script')) OR (contains(a.body, '../') AND contains(b.body, '../'))", "requests")
def _(t):
    return D.shared_attack_patterns(t.requests, "request_id", "user_id", "body")


@query("d12_request_anomalies", "SELECT request_id, concat_ws(',', CASE WHEN content_length * 1000 > 10485760 THEN 'large_request' END, CASE WHEN duration_ms / 10 > 10 THEN 'slow_response' END, CASE WHEN country IN ('CN','RU') THEN 'geographic_anomaly' END) AS types, round(CASE WHEN content_length * 1000 > 10485760 THEN 0.4 ELSE 0 END + CASE WHEN duration_ms / 10 > 10 THEN 0.3 ELSE 0 END + CASE WHEN country IN ('CN','RU') THEN 0.3 ELSE 0 END, 5) AS score FROM requests", "requests")
def _(t):
    r = t.requests.withColumn("size", F.col("content_length") * 1000)
    return D.request_anomalies(r, "size", F.col("duration_ms") / 10, "country").select("request_id", F.array_join("anomaly_types", ",").alias("types"), rnd("anomaly_score").alias("score"))


ENT = "e AS (SELECT u, -sum(k / tot * log2(k / tot)) AS ent FROM (SELECT u, ch, count(*) AS k, sum(count(*)) OVER (PARTITION BY u) AS tot FROM (SELECT user_agent AS u, unnest(string_split(user_agent, '')) AS ch FROM (SELECT DISTINCT user_agent FROM requests)) GROUP BY u, ch) GROUP BY u)"


@query("d13_user_agent_score", f"WITH {ENT} SELECT u AS user_agent, round(least(1, CASE WHEN regexp_matches(lower(u), 'bot|crawler|spider|scraper') THEN 0.5 ELSE 0 END + CASE WHEN length(u) < 10 THEN 0.3 ELSE 0 END + CASE WHEN ent > 4 THEN 0.2 ELSE 0 END), 5) AS score FROM e", "requests")
def _(t):
    return t.requests.select("user_agent").distinct().select("user_agent", rnd(D.user_agent_score("user_agent")).alias("score"))


@query("d14_zscore_request", "WITH b AS (SELECT path, avg(content_length) AS sm, stddev_pop(content_length) AS ss, avg(duration_ms) AS lm, stddev_pop(duration_ms) AS ls FROM requests GROUP BY path), z AS (SELECT request_id, (content_length - sm) / nullif(ss, 0) AS sz, (duration_ms - lm) / nullif(ls, 0) AS lz FROM requests JOIN b USING (path)) SELECT request_id, round(sz, 5) AS size_z, round(lz, 5) AS latency_z, CASE WHEN abs(sz) > 3 THEN 0.3 ELSE 0 END::double + CASE WHEN abs(lz) > 2.5 THEN 0.2 ELSE 0 END::double AS score FROM z", "requests")
def _(t):
    mean = lambda c, n: [F.avg(c).alias(f"{n}_mean"), F.stddev_pop(c).alias(f"{n}_std")]
    b = t.requests.groupBy("path").agg(*mean("content_length", "size"), *mean("duration_ms", "latency"))
    z = D.zscore_request(t.requests, b, "path", "content_length", "duration_ms")
    return z.select("request_id", rnd("size_z").alias("size_z"), rnd("latency_z").alias("latency_z"), F.col("zscore_risk").alias("score"))


DEC = "CASE WHEN contains(lower(user_agent), 'bot') THEN 2 ELSE 0 END + CASE WHEN contains(lower(user_agent), 'curl') THEN 3 ELSE 0 END + CASE WHEN contains(lower(user_agent), 'python') THEN 3 ELSE 0 END + CASE WHEN method = 'POST' THEN 1 ELSE 0 END + CASE WHEN length(body) > 0 THEN 1 ELSE 0 END"
LEVEL = f"CASE WHEN {DEC} >= 5 THEN 'critical' WHEN {DEC} >= 3 THEN 'high' WHEN {DEC} >= 1 THEN 'medium' ELSE 'low' END"


@query("d15_deception_level", f"SELECT request_id, {LEVEL} AS level FROM requests", "requests")
def _(t):
    return t.requests.select("request_id", D.deception_level("user_agent", "ip", "method", "body").alias("level"))


@query("d16_deception_events", f"SELECT request_id, {LEVEL} AS level, CASE {LEVEL} WHEN 'critical' THEN 1.0 WHEN 'high' THEN 0.75 WHEN 'medium' THEN 0.5 ELSE 0.25 END::double AS threat FROM requests WHERE path = '/admin/config?debug=1'", "requests")
def _(t):
    traps = t.spark.createDataFrame([("honeypot_access", "/admin/config?debug=1")], "type string, trap string")
    return X.deception_events(t.requests, traps, "request_id", {"honeypot_access": "path"}).select("request_id", "level", F.col("threat_level").alias("threat"))


CODE = "SELECT p_partkey AS id, concat(concat('contract C ', chr(123)), chr(10), concat('function f() public ', chr(123)), chr(10), CASE p_partkey % 3 WHEN 0 THEN 'x.call(1);' WHEN 1 THEN 'require(tx.origin == a);' ELSE 'y.send(2);' END, chr(10), CASE p_partkey % 2 WHEN 0 THEN 'total = total - 1;' ELSE 'emit Done(price);' END, chr(10), chr(125), chr(10), CASE p_partkey % 5 WHEN 0 THEN concat('function kill() ', chr(123), ' selfdestruct(o); ', chr(125)) ELSE concat('function g() ', chr(123), ' require(ok); ', chr(125)) END, chr(10), chr(125)) AS code FROM {part}"
CODE_D = CODE.replace("{part}", "part")
FAM = " UNION ALL ".join(f"SELECT id, i AS line, '{n}' AS family, '{s}' AS severity FROM l WHERE regexp_matches(c, '{p}')" for n, p, s in D.SOURCE_PATTERNS)
LINES = f"l AS (SELECT id, unnest(range(1, len(a) + 1)) AS i, unnest(a) AS c FROM (SELECT id, string_split(code, chr(10)) AS a FROM ({CODE_D}) z) y)"


ADVICE = "CASE family " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in D.RECOMMENDATIONS.items()) + " END"


@query("d17_scan_sources", f"WITH {LINES} SELECT id, line::int AS line, family, severity, {ADVICE} AS recommendation FROM ({FAM}) f")
def _(t):
    return D.scan_sources(t.spark.sql(CODE, part=t.part), "id", "code")


@query(
    "d18_scan_source_rules",
    rf"WITH {LINES}, n AS (SELECT *, sum(regexp_matches(c, '\bfunction\b')::int) OVER (PARTITION BY id ORDER BY i) AS fn FROM l), f AS (SELECT id, fn, min(CASE WHEN regexp_matches(c, '\.call') THEN i END) AS ca, max(CASE WHEN regexp_matches(c, '\w+\s*[-+]?=[^=]') THEN i END) AS asg, max(regexp_matches(c, 'onlyOwner|require')::int) AS g, max(regexp_matches(c, '(?i)oracle|price')::int) AS o FROM n WHERE fn > 0 GROUP BY id, fn) "
    "SELECT id, count_if(ca < asg) AS late_state_change, count_if(g = 0) AS unguarded, count_if(o = 1) AS oracle_use, count(*) AS functions FROM f GROUP BY id",
)
def _(t):
    return D.scan_source_rules(t.spark.sql(CODE, part=t.part), "id", "code")


@query("d19_source_score", f"WITH {LINES} SELECT id, greatest(0, 100 - sum(CASE severity WHEN 'critical' THEN 25 WHEN 'high' THEN 15 WHEN 'medium' THEN 8 ELSE 3 END))::bigint AS score FROM ({FAM}) f GROUP BY id")
def _(t):
    return D.source_score(D.scan_sources(t.spark.sql(CODE, part=t.part), "id", "code"), "id")


# the sources with a loop and comments, some with bad names
GAS_CODE = f"SELECT id, CASE id % 4 WHEN 0 THEN concat(code, chr(10), 'for (uint i = 0; i < xs.length; i++) ', chr(123), ' xs.push(i); ', chr(125), chr(10), '// a note') WHEN 1 THEN concat(code, chr(10), '  /** doc */ function Bad_name(string memory s) if (a && b) else c') WHEN 2 THEN concat('contract lower', chr(10), chr(10), code) ELSE code END AS code FROM ({CODE})"
GAS_D = GAS_CODE.replace("{part}", "part")


@query(
    "d19_gas_findings",
    f"WITH g AS ({GAS_D}), m AS ({{}})".format(" UNION ALL ".join(f"SELECT id, code, '{n}' AS pattern, unnest(regexp_extract_all(code, '{p}')) AS matched FROM g" for n, p, _ in D.GAS_PATTERNS))
    + " SELECT id, (length(code[:strpos(code, matched) - 1]) - length(replace(code[:strpos(code, matched) - 1], chr(10), '')) + 1)::int AS line, pattern, matched, CASE pattern " + " ".join(f"WHEN '{n}' THEN '{r}'" for n, _, r in D.GAS_PATTERNS) + " END AS recommendation FROM m",
)
def _(t):
    return D.gas_findings(t.spark.sql(GAS_CODE, part=t.part), "id", "code")


QUALITY = rf"q AS (SELECT id, string_split(code, chr(10)) AS l, regexp_extract_all(code, 'function\s+(\w+)', 1) AS f, regexp_extract_all(code, 'contract\s+(\w+)', 1) AS k, len(regexp_extract_all(code, '(?i)\b(if|else|for|while|case|catch)\b|&&|\|\|')) AS b, len(regexp_extract_all(code, '/\*\*[\s\S]*?\*/\s*function')) AS d FROM ({GAS_D})), n AS (SELECT id, len(l)::int AS total_lines, len(list_filter(l, lambda x: starts_with(trim(x), '//')))::int AS comment_lines, len(list_filter(l, lambda x: trim(x) = ''))::int AS empty_lines, len(f)::int AS functions, (b + 1) / greatest(len(f), 1) AS complexity, CASE WHEN len(f) > 0 THEN d / len(f) * 100 ELSE 0 END AS documentation, len(list_filter(f, lambda x: regexp_matches(x, '^[a-z][a-zA-Z0-9]*$')))::int AS camel, len(list_filter(k, lambda x: regexp_matches(x, '^[A-Z][a-zA-Z0-9]*$')))::int AS pascal, len(f) + len(k) AS names FROM q)"


@query("d19_source_quality", f"WITH {QUALITY} SELECT id, total_lines, comment_lines, empty_lines, functions, round(complexity, 4) AS complexity, round(documentation, 2) AS documentation, camel AS camel_case_functions, pascal AS pascal_case_contracts, (names - camel - pascal)::int AS violations, round(comment_lines / total_lines * 100, 2) AS comment_ratio FROM n")
def _(t):
    q = D.source_quality(t.spark.sql(GAS_CODE, part=t.part), "id", "code").withColumn("violations", F.size("violations"))
    return q.withColumns({"complexity": rnd("complexity", 4), "documentation": rnd("documentation", 2), "comment_ratio": rnd("comment_ratio", 2)})


GAS_LINES = f"l AS (SELECT id, unnest(range(1, len(a) + 1)) AS i, unnest(a) AS c FROM (SELECT id, string_split(code, chr(10)) AS a FROM ({GAS_D}) z) y)"


@query("d19_corpus_score", f"WITH {QUALITY}, {GAS_LINES}, v AS (SELECT id, sum(CASE severity WHEN 'critical' THEN 25 WHEN 'high' THEN 15 WHEN 'medium' THEN 8 ELSE 3 END) AS w FROM ({FAM}) f GROUP BY id) SELECT id, greatest(0, greatest(0, 100 - coalesce(w, 0)) - CASE WHEN comment_lines / total_lines * 100 < 10 THEN 5 ELSE 0 END - CASE WHEN complexity > 10 THEN 10 ELSE 0 END)::bigint AS score FROM n LEFT JOIN v USING (id)")
def _(t):
    code = t.spark.sql(GAS_CODE, part=t.part)
    return D.corpus_score(D.scan_sources(code, "id", "code"), D.source_quality(code, "id", "code"), "id")


@query("d20_gas_price_outliers", "WITH m AS (SELECT o_custkey, avg(o_totalprice) AS m FROM orders GROUP BY 1) SELECT o_custkey, round(avg(CASE WHEN o_totalprice > 2 * m THEN 1.0 ELSE 0 END), 5) AS share, avg(CASE WHEN o_totalprice > 2 * m THEN 1.0 ELSE 0 END) > 0.1 AS suspicious FROM orders JOIN m USING (o_custkey) GROUP BY 1")
def _(t):
    return D.gas_price_outliers(t.orders, "o_custkey", "o_totalprice").withColumn("share", rnd("share"))


ALGORITHMS = "['rsa', 'ecc', 'dh', 'ecdh', 'aes', 'sha256', 'sha512', 'ecdsa', 'des']"
CRYPTO = f"c AS (SELECT p_partkey, ({ALGORITHMS})[p_partkey % 9 + 1] AS a, p_size * 100 AS b, (['low', 'normal', 'high'])[p_partkey // 9 % 3 + 1] AS c, p_retailprice / 80 AS y FROM part), t AS (SELECT *, round(greatest(0, least(1, CASE WHEN a IN ('rsa', 'ecc', 'dh', 'ecdh') THEN 0.9 WHEN a = 'aes' THEN 0.5 WHEN a = 'sha256' THEN 0.3 WHEN a = 'sha512' THEN 0.2 ELSE 0.5 END + CASE WHEN a IN ('rsa', 'dh') AND b < 2048 OR a IN ('ecc', 'ecdh') AND b < 256 THEN 0.1 WHEN a IN ('rsa', 'dh') AND b >= 4096 OR a IN ('ecc', 'ecdh') AND b >= 384 THEN -0.1 WHEN a = 'aes' AND b < 256 THEN 0.2 ELSE 0 END)), 6) AS th FROM c), u AS (SELECT *, CASE WHEN th > 0.80001 AND y < 10 THEN 3 WHEN th > 0.60001 AND y < 15 THEN 2 WHEN th > 0.40001 AND y < 20 THEN 1 ELSE 0 END AS q FROM t), v AS (SELECT *, CASE WHEN c = 'high' AND q < 2 THEN q + 1 WHEN c = 'low' AND q >= 2 THEN q - 1 ELSE q END AS w FROM u)"


@query("d21_crypto_risk", f"WITH {CRYPTO} SELECT p_partkey, round(th, 5)::double AS threat, CASE WHEN a = 'aes' THEN CASE WHEN b < 256 THEN 'aes_256' ELSE 'post_quantum_symmetric' END WHEN a IN ('rsa', 'dh') THEN CASE WHEN c = 'high' THEN 'lattice_based_kem' ELSE 'code_based_kem' END WHEN a IN ('ecc', 'ecdh') THEN CASE WHEN c = 'high' THEN 'lattice_based_kem' ELSE 'isogeny_based_kem' END WHEN a = 'ecdsa' THEN CASE WHEN c = 'high' THEN 'lattice_based_signatures' ELSE 'hash_based_signatures' END ELSE 'hybrid_classical_post_quantum' END AS target, (['low', 'medium', 'high', 'critical'])[w + 1] AS urgency, round(th * 0.4 + ([0.2, 0.5, 0.8, 1.0])[w + 1] * 0.3 + greatest(0, least(1, (30 - y) / 30)) * 0.3, 5)::double AS risk FROM v")
def _(t):
    pick = lambda names, i: F.element_at(F.array(*map(F.lit, names)), i + 1)
    key = F.col("p_partkey")
    c = t.part.select(
        "p_partkey", pick(re.findall(r"\w+", ALGORITHMS), (key % 9).cast("int")).alias("algorithm"), (F.col("p_size") * 100).alias("key_size"),
        pick(["low", "normal", "high"], (F.floor(key / 9) % 3).cast("int")).alias("criticality"), (F.col("p_retailprice") / 80).alias("break_years"),
    )
    return D.crypto_risk(c).select("p_partkey", rnd("threat").alias("threat"), "target", "urgency", rnd("risk").alias("risk"))


@query("d22_findings_risk", "WITH s AS (SELECT host, sum(CASE severity WHEN 'critical' THEN 10 WHEN 'high' THEN 7 WHEN 'medium' THEN 4 ELSE 1 END)::bigint AS score FROM requests WHERE hour(ts) = 3 GROUP BY host) SELECT *, CASE WHEN score >= 20 THEN 'critical' WHEN score >= 10 THEN 'high' WHEN score >= 5 THEN 'medium' ELSE 'low' END AS level FROM s", "requests")
def _(t):
    return D.findings_risk(t.requests.filter("hour(ts) = 3"), "host", "severity")


BR = "g AS (SELECT request_id, session_id, path, method, ip, user_agent, epoch_us(ts) AS us, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY session_id ORDER BY ts, request_id)) / 1e6 AS gap FROM requests), s AS (SELECT session_id, count(*) AS n, count(DISTINCT (path, method)) AS kinds, (max(us) - min(us)) / 1e6 AS sec, count_if(gap < 1) AS bursts, min(user_agent) AS ua, min(ip) AS ip FROM g GROUP BY session_id), c AS (SELECT *, n / greatest(sec / 60, 1) AS rate FROM s), k AS (SELECT *, (rate > 60)::int + (bursts > 10)::int + (sec > 3600)::int AS m, CASE WHEN rate > 60 THEN least(rate / 100, 1) * 0.7 ELSE 0 END + CASE WHEN bursts > 10 THEN least(bursts / 20, 1) * 0.6 ELSE 0 END + CASE WHEN sec > 3600 THEN 0.35 ELSE 0 END AS tot FROM c), b AS (SELECT *, CASE WHEN m = 0 THEN 0.1 ELSE least(1, tot / m * CASE WHEN kinds < 5 THEN 1.2 ELSE 1 END * CASE WHEN regexp_matches(lower(ua), 'bot|crawler|spider|scraper|curl|wget|python|java|perl|ruby|php') THEN 1.3 ELSE 1 END * CASE WHEN ip LIKE '10.%' THEN 1.4 ELSE 1 END) END AS risk FROM k)"


@query("g01_behavior_risk", f"WITH {BR} SELECT session_id, n, round(risk, 5) AS risk FROM b", "requests")
def _(t):
    return D.behavior_risk(t.requests).select("session_id", "n", rnd("behavior_risk").alias("risk"))


@query("g02_session_patterns", "WITH r AS (SELECT session_id, path, row_number() OVER (PARTITION BY session_id ORDER BY ts DESC, request_id DESC) AS k, ts, request_id FROM requests) SELECT session_id, string_agg(path, ' ' ORDER BY ts, request_id) AS pages FROM r WHERE k <= 20 GROUP BY session_id", "requests")
def _(t):
    p = X.page_sequence(t.requests, "session_id", "path", ["ts", "request_id"])
    return p.select("session_id", F.array_join("pages", " ").alias("pages"))


@query("g03_base_score", "SELECT request_id, round(risk_score * 0.4 + duration_ms / 600 * 0.3 + parity / 5 * 0.3, 5) AS base, round(risk_score * 0.4 + duration_ms / 600 * 0.35 + parity / 5 * 0.25, 5) AS average FROM requests", "requests")
def _(t):
    parts = F.col("risk_score"), F.col("duration_ms") / 600, F.col("parity") / 5
    return t.requests.select("request_id", rnd(X.base_score(*parts)).alias("base"), rnd(X.average_score(*parts)).alias("average"))


def factors():
    h = S.temporal_context("ts")
    return {"off_hours": ~h["is_business_hours"], "weekend": h["is_weekend"], "night": F.hour("ts") <= 6, "high_risk_country": F.col("country").isin("CN", "RU"), "poor_reputation": F.col("status_code") >= 400}


CTX = "(CASE WHEN NOT (hour(ts) BETWEEN 9 AND 17 AND isodow(ts) <= 5) THEN 1.2 ELSE 1 END * CASE WHEN isodow(ts) >= 6 THEN 1.1 ELSE 1 END * CASE WHEN hour(ts) <= 6 THEN 1.3 ELSE 1 END * CASE WHEN country IN ('CN','RU') THEN 1.5 ELSE 1 END * CASE WHEN status_code >= 400 THEN 1.5 ELSE 1 END)"


@query("g04_contextual_score", f"SELECT request_id, round(least(1, risk_score * (1 + ({CTX} - 1) * 0.7)), 5) AS score FROM requests", "requests")
def _(t):
    return t.requests.select("request_id", rnd(D.contextual_score(F.col("risk_score"), factors())).alias("score"))


@query("g05_score_confidence", "SELECT request_id, round(greatest(0.1, least(1, 0.5 + CASE WHEN parity * 4 > 10 THEN 0.1 ELSE 0 END + CASE WHEN duration_ms > 300 THEN 0.1 ELSE 0 END + CASE WHEN country <> 'RU' THEN 0.1 ELSE -0.1 END + CASE WHEN method = 'POST' THEN 0.15 ELSE 0 END - CASE WHEN status_code >= 400 THEN 0.1 ELSE 0 END)), 5) AS confidence FROM requests", "requests")
def _(t):
    country = F.when(F.col("country") == "RU", "unknown").otherwise(F.col("country"))
    c = D.score_confidence(F.col("parity") * 4, F.col("duration_ms"), country, F.col("method") == "POST", F.col("status_code") < 400)
    return t.requests.select("request_id", rnd(c).alias("confidence"))


BAND = lambda c, b, d: "CASE " + " ".join(f"WHEN {c} >= {x} THEN '{n}'" for x, n in b) + f" ELSE '{d}' END"


@query("g06_risk_level", f"SELECT request_id, {BAND('risk_score', D.BANDS_GO, 'minimal')} AS wide, {BAND('risk_score', D.BANDS_RS, 'minimal')} AS narrow FROM requests", "requests")
def _(t):
    return t.requests.select("request_id", S.risk_level("risk_score", D.BANDS_GO, "minimal").alias("wide"), S.risk_level("risk_score", D.BANDS_RS, "minimal").alias("narrow"))


@query("g07_explain_score", "SELECT request_id, concat_ws(',', CASE WHEN risk_score > 0.7 THEN 'behavioral_anomaly' END, CASE WHEN NOT (hour(ts) BETWEEN 9 AND 17 AND isodow(ts) <= 5) THEN 'off_hours_access' END) AS factors FROM requests", "requests")
def _(t):
    h = S.temporal_context("ts")
    f = F.array_compact(F.array(F.when(F.col("risk_score") > 0.7, F.lit("behavioral_anomaly")), F.when(~h["is_business_hours"], F.lit("off_hours_access"))))
    return t.requests.select("request_id", F.array_join(f, ",").alias("factors"))


@query("g08_fuse_scores", "SELECT request_id, round(least(1, risk_score * 0.25 + duration_ms / 500 * 0.2 + parity / 5 * 0.2 + 0.5 * 0.15 + 0.3 * 0.2), 5) AS score FROM requests", "requests")
def _(t):
    return t.requests.select("request_id", rnd(D.fuse_scores(F.col("risk_score"), F.col("duration_ms") / 500, F.col("parity") / 5, F.lit(0.5), F.lit(0.3))).alias("score"))


@query("g09_fuse_signature_scores", f"WITH m AS (SELECT request_id, avg(CASE severity WHEN 'high' THEN 0.7 ELSE 0.5 END) AS s FROM ({SIGS}) GROUP BY request_id), x AS (SELECT request_id, least(1, coalesce(s, 0) * 0.3 + risk_score * 0.25 + parity / 5 * 0.25 + 0.1) AS v FROM requests LEFT JOIN m USING (request_id)) SELECT request_id, round(v, 5) AS score, CASE WHEN v >= 0.9 THEN 'quarantine' WHEN v >= 0.7 THEN 'block' WHEN v >= 0.5 THEN 'challenge' WHEN v >= 0.3 THEN 'monitor' ELSE 'allow' END AS action FROM x", "requests")
def _(t):
    w = F.when(F.col("severity") == "high", 0.7).otherwise(0.5)
    m = D.signature_match(t.requests, "body", "request_id").groupBy("request_id").agg(F.avg(w).alias("s"))
    r = t.requests.drop("severity").join(m, "request_id", "left").withColumn("v", F.least(F.lit(1.0), F.coalesce("s", F.lit(0.0)) * 0.3 + F.col("risk_score") * 0.25 + F.col("parity") / 5 * 0.25 + 0.1))
    return r.select("request_id", rnd("v").alias("score"), S.first_of(D.ACTIONS, S.risk_level("v", D.BANDS_RS, "minimal"), "allow").alias("action"))


@query("g10_triage", "SELECT request_id, CASE WHEN risk_score < 0.35 AND parity / 4 < 0.5 THEN 'close' WHEN severity = 'critical' OR (risk_score >= 0.8 AND parity / 4 >= 0.75) THEN 'escalate' WHEN risk_score >= 0.5 AND parity / 4 >= 0.6 THEN 'auto-respond' ELSE 'close' END AS outcome FROM requests", "requests")
def _(t):
    return t.requests.select("request_id", D.triage(F.col("risk_score"), F.col("parity") / 4, F.col("severity")).alias("outcome"))


@query("g11_map_ttps", "SELECT request_id, concat_ws(',', CASE WHEN (parity + 1) / 5 > 0.75 AND duration_ms / 100 > 0.75 THEN 'T1041' END, CASE WHEN (parity + 1) / 5 > 0.7 THEN 'T1021' END, NULL) AS some, CASE WHEN contains(body, 'powershell') THEN 'T1059.001' ELSE '' END AS hints FROM requests", "requests")
def _(t):
    ttps = D.map_ttps(F.lit(0.0), F.col("duration_ms") / 100, (F.col("parity") + 1) / 5)
    some = F.array_join(F.reverse(F.array_sort(F.filter(ttps, lambda x: x.isin("T1041", "T1021")))), ",")
    return t.requests.select("request_id", some.alias("some"), F.array_join(D.ttps_of_text(F.col("body")), ",").alias("hints"))


@query("g12_response_tier", "WITH x AS (SELECT request_id, CASE WHEN risk_score BETWEEN 0 AND 0.3 THEN 'monitor' WHEN risk_score BETWEEN 0.3 AND 0.5 THEN 'warn' WHEN risk_score BETWEEN 0.5 AND 0.7 THEN 'restrict' WHEN risk_score BETWEEN 0.7 AND 0.85 THEN 'block' WHEN risk_score BETWEEN 0.85 AND 1 THEN 'isolate' END AS tier, count(*) OVER (PARTITION BY ip ORDER BY epoch_us(ts) // 1000000 RANGE BETWEEN 300 PRECEDING AND CURRENT ROW) AS recent, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY ip ORDER BY ts, request_id)) / 1e6 AS gap FROM requests) SELECT request_id, tier, recent, recent > 3 AS escalate, coalesce(gap < CASE tier WHEN 'monitor' THEN 60 WHEN 'warn' THEN 120 WHEN 'restrict' THEN 300 WHEN 'block' THEN 600 ELSE 900 END, false) AS in_cooldown FROM x", "requests")
def _(t):
    return D.response_tier(t.requests, "risk_score", "ip", "ts", "request_id").select("request_id", "tier", "recent", "escalate", "in_cooldown")


@query("g13_response_metrics", "SELECT CASE WHEN risk_score BETWEEN 0 AND 0.3 THEN 'monitor' WHEN risk_score BETWEEN 0.3 AND 0.5 THEN 'warn' WHEN risk_score BETWEEN 0.5 AND 0.7 THEN 'restrict' WHEN risk_score BETWEEN 0.7 AND 0.85 THEN 'block' WHEN risk_score BETWEEN 0.85 AND 1 THEN 'isolate' END AS tier, count(*) AS n, round(avg(duration_ms), 5) AS latency FROM requests GROUP BY 1", "requests")
def _(t):
    return D.response_tier(t.requests, "risk_score", "ip", "ts", "request_id").transform(X.response_metrics, "tier", "duration_ms").select("tier", "n", rnd("mean_latency").alias("latency"))


@query("g14_plan_playbooks", "SELECT request_id, p.id AS playbook_id, p.pos AS position, p.step FROM requests JOIN (SELECT 'brute_force' AS id, 'error' AS et, 0.1 AS mr, unnest([0, 1]) AS pos, unnest(['block_ip', 'notify']) AS step UNION ALL SELECT 'fraud', 'purchase', 0.2, 0, 'hold') p ON p.et = event_type AND risk_score >= p.mr AND parity / 4 >= 0.5", "requests")
def _(t):
    books = t.spark.createDataFrame([("brute_force", "error", 0.1, 0.5, ["block_ip", "notify"]), ("fraud", "purchase", 0.2, 0.5, ["hold"])], "playbook_id string, trigger_type string, min_risk double, min_confidence double, steps array<string>")
    return D.plan_playbooks(t.requests.withColumn("confidence", F.col("parity") / 4), books)


@query("g15_route_alerts", "SELECT DISTINCT request_id, ch AS channel FROM requests JOIN (SELECT 'email' AS ch, 2 AS r UNION ALL SELECT 'pager', 3 UNION ALL SELECT 'log', 1) x ON CASE severity WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END >= r", "requests")
def _(t):
    rules = t.spark.createDataFrame([("medium", ["email"]), ("high", ["pager"]), ("low", ["log"])], "severity string, channels array<string>")
    return D.route_alerts(t.requests.select("request_id", "severity"), rules)


ADVICE_SQL = "CASE severity WHEN 'critical' THEN 'block source now; isolate systems; start incident response' WHEN 'high' THEN 'block source; watch for more; review policies' WHEN 'medium' THEN 'watch source; log more; review traffic' ELSE 'log; watch trends' END"
KIND_SQL = "CASE event_type WHEN 'error' THEN 'intrusion' WHEN 'click' THEN 'ddos' WHEN 'purchase' THEN 'malware' ELSE 'other' END"


@query("g16_build_alerts", f"WITH m AS (SELECT request_id, list_sort(list(DISTINCT signature)) AS s FROM ({SIGS}) x GROUP BY request_id), t AS (SELECT r.*, coalesce(s, []) AS s, {KIND_SQL} AS kind, greatest(coalesce(virustotal_score, 0), coalesce(abuseipdb_score, 0)) AS sc FROM requests r LEFT JOIN m USING (request_id) LEFT JOIN intel USING (ip) WHERE severity <> 'low') SELECT request_id, substr(sha256(concat_ws('-', kind, ip, request_id::varchar)), 1, 16) AS alert_id, sha256(concat_ws('-', kind, ip, host, array_to_string(s, ','))) AS alert_hash, array_to_string(s, ',') AS signatures, CASE WHEN parity > 2 THEN 2 ELSE 1 END AS n_evidence, concat_ws('/', country, region, city) AS place, CASE WHEN sc >= 80 THEN 'malicious' WHEN sc >= 40 THEN 'suspicious' ELSE 'clean' END AS reputation, concat({ADVICE_SQL}, CASE kind WHEN 'intrusion' THEN '; check for privilege escalation; review access logs' WHEN 'ddos' THEN '; limit rates; enable ddos protection' WHEN 'malware' THEN '; scan systems; update signatures' ELSE '' END) AS recommendations FROM t", "requests", "intel")
def _(t):
    kind = F.expr(KIND_SQL)
    threats = t.requests.filter("severity <> 'low'").select(
        "request_id", kind.alias("threat_type"), "severity", F.col("risk_score").alias("confidence"), "ip", F.col("host").alias("dest"), "country", "region", "city",
        F.when(F.col("parity") > 2, F.col("risk_score")).alias("behavior"),
    )
    a = D.build_alerts(threats, D.signature_match(t.requests, "body", "request_id"), t.intel)
    return a.select(
        "request_id", "alert_id", "alert_hash", F.array_join("signatures", ",").alias("signatures"), F.size("evidence").alias("n_evidence"),
        F.concat_ws("/", "geo.country", "geo.region", "geo.city").alias("place"), "reputation", F.array_join("recommendations", "; ").alias("recommendations"),
    )


@query("g17_indicator_risk", "SELECT host, round(avg(CASE severity WHEN 'critical' THEN 1.0 WHEN 'high' THEN 0.8 WHEN 'medium' THEN 0.5 ELSE 0.2 END), 5) AS risk FROM requests GROUP BY host", "requests")
def _(t):
    return D.indicator_risk(t.requests, "host", "severity").select("host", rnd("indicator_risk").alias("risk"))


@query("g18_user_reputation", "WITH g AS (SELECT user_id, avg(risk_score) AS r, count_if(status_code = 401) AS f, count(DISTINCT session_id) AS sessions FROM requests GROUP BY user_id), s AS (SELECT *, greatest(0, 1 - r - least(0.3, f * 0.05)) AS rep FROM g) SELECT user_id, f AS failed, sessions, round(rep, 5) AS reputation, CASE WHEN rep >= 0.9 THEN 'trusted' WHEN rep >= 0.6 THEN 'normal' ELSE 'suspicious' END AS tier FROM s", "requests")
def _(t):
    return D.user_reputation(t.requests).select("user_id", "failed", "sessions", rnd("reputation").alias("reputation"), "tier")


@query("g19_intel_risk", "WITH g AS (SELECT country, avg(risk_score) AS a, avg((status_code >= 400)::int) AS b, count(DISTINCT ip) / 100 AS c, max(risk_score) AS d FROM requests GROUP BY country), s AS (SELECT country, least(1, a * 0.3 + b * 0.25 + least(1, c) * 0.2 + d * 0.25) AS v FROM g) SELECT country, round(v, 5) AS risk, CASE WHEN v >= 0.8 THEN 'critical' WHEN v >= 0.6 THEN 'high' WHEN v >= 0.4 THEN 'medium' WHEN v >= 0.2 THEN 'low' ELSE 'minimal' END AS level FROM s", "requests")
def _(t):
    g = t.requests.groupBy("country").agg(F.avg("risk_score").alias("a"), F.avg((F.col("status_code") >= 400).cast("int")).alias("b"), (F.count_distinct("ip") / 100).alias("c"), F.max("risk_score").alias("d"))
    g = g.withColumn("v", F.least(F.lit(1.0), F.col("a") * 0.3 + F.col("b") * 0.25 + F.least(F.lit(1.0), F.col("c")) * 0.2 + F.col("d") * 0.25))
    return g.select("country", rnd("v").alias("risk"), S.risk_level("v", D.BANDS_GO, "minimal").alias("level"))


def flagship(t):
    """Requests enriched, scored per user and day, and triaged."""
    from duskline.operators import enrich as E

    r = E.enrich_threat_intel(E.enrich_assets(t.requests, t.assets), t.intel)
    r = r.withColumn("score", D.contextual_score(F.col("risk_score") * F.least(F.col("criticality"), F.lit(2.0)), factors()))
    g = r.groupBy("user_id", F.to_date("ts").cast("string").alias("day")).agg(
        F.count(F.lit(1)).alias("requests"), rnd(F.max("score")).alias("score"), rnd(F.avg("intel_score")).alias("intel")
    )
    g = g.withColumn("level", S.risk_level("score", D.BANDS_GO, "minimal"))
    return g.withColumn("outcome", D.triage(F.col("score"), F.least(F.lit(0.95), F.col("requests") / 4), F.col("level")))


@query(
    "q00_flagship",
    f"WITH e AS (SELECT r.*, least(coalesce(a.c, h.c, 1.0), 2.0) AS crit, {'greatest(coalesce(virustotal_score, 0), coalesce(abuseipdb_score, 0))'} AS intel FROM requests r LEFT JOIN (SELECT ip, max(criticality_score) c FROM assets GROUP BY ip) a ON r.ip = a.ip LEFT JOIN (SELECT hostname, max(criticality_score) c FROM assets GROUP BY hostname) h ON r.host = h.hostname LEFT JOIN intel i ON r.ip = i.ip), "
    f"s AS (SELECT *, least(1, risk_score * crit * (1 + ({CTX} - 1) * 0.7)) AS score FROM e), g AS (SELECT user_id, cast(cast(ts AS date) AS varchar) AS day, count(*) AS requests, round(max(score), 5) AS score, round(avg(intel), 5) AS intel FROM s GROUP BY 1, 2), l AS (SELECT *, {BAND('score', D.BANDS_GO, 'minimal')} AS level, least(0.95, requests / 4) AS conf FROM g) "
    "SELECT user_id, day, requests, score, intel, level, CASE WHEN score < 0.35 AND conf < 0.5 THEN 'close' WHEN level = 'critical' OR (score >= 0.8 AND conf >= 0.75) THEN 'escalate' WHEN score >= 0.5 AND conf >= 0.6 THEN 'auto-respond' ELSE 'close' END AS outcome FROM l", "requests", "assets", "intel",
)
def _(t):
    return flagship(t)
