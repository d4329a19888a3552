"""The given tables in the shape of security data: requests, connections, points, graph tables.

Each view is SQL that Spark and DuckDB both take, so that the same rows feed a
query and its oracle. Names in braces are the tables it reads.
"""

from __future__ import annotations

import re

REQUESTS = """
SELECT event_id AS request_id, ts, user_id,
  concat(cast(user_id AS string), '-', cast(cast(ts AS date) AS string)) AS session_id,
  concat('10.', cast(user_id % 3 AS string), '.', cast(user_id % 4 AS string), '.', cast(user_id % 250 AS string)) AS ip,
  CASE user_id % 5 WHEN 0 THEN 'Mozilla/5.0 (Windows NT 10.0) Chrome/120.0' WHEN 1 THEN 'curl/8.1.2'
    WHEN 2 THEN 'Googlebot/2.1' WHEN 3 THEN 'Mozilla/5.0 (X11; Linux) Firefox/121.0'
    ELSE 'python-requests/2.31' END AS user_agent,
  CASE user_id % 4 WHEN 0 THEN 'US' WHEN 1 THEN 'CA' WHEN 2 THEN 'RU' ELSE 'CN' END AS country,
  concat('R', cast(user_id % 3 AS string)) AS region,
  concat('City', cast(user_id % 7 AS string)) AS city,
  CASE event_type WHEN 'signup' THEN '/api/auth/Register' WHEN 'error' THEN '/admin/config?debug=1'
    WHEN 'click' THEN concat('/api/items/', cast(event_id % 20 AS string))
    WHEN 'view' THEN '/static/page.html' ELSE concat('/api/orders?id=', cast(event_id % 9 AS string)) END AS path,
  CASE event_type WHEN 'signup' THEN 'POST' WHEN 'purchase' THEN 'POST' WHEN 'error' THEN 'DELETE' ELSE 'GET' END AS method,
  CASE event_type WHEN 'error' THEN CASE event_id % 4 WHEN 0 THEN 500 WHEN 1 THEN 403 WHEN 2 THEN 401 ELSE 404 END
    WHEN 'purchase' THEN 201 ELSE 200 END AS status_code,
  value AS duration_ms, cast(floor(value * 100) AS bigint) AS content_length,
  CASE event_id % 10 WHEN 0 THEN concat(chr(39), ' OR 1=1 --') WHEN 1 THEN '<script>alert(1)</script>'
    WHEN 2 THEN '; cat /etc/passwd' WHEN 3 THEN '../../etc/shadow' WHEN 4 THEN 'powershell -enc AAAA'
    ELSE concat('hello world ', cast(event_id % 13 AS string)) END AS body,
  event_type, value / 500.0 AS risk_score,
  CASE event_type WHEN 'error' THEN 'high' WHEN 'signup' THEN 'medium' ELSE 'low' END AS severity,
  concat('host-', cast(user_id % 6 AS string)) AS host, event_id % 5 AS parity
FROM {events}
"""

CONNECTIONS = """
SELECT l_orderkey AS conn_id, l_linenumber AS line, l_shipdate AS ts, l_suppkey AS source, o_custkey AS destination,
  l_partkey % 65536 AS port, l_returnflag AS protocol, l_extendedprice AS bytes, cast(l_quantity AS bigint) AS packets
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey
"""

ASSETS = """
SELECT s_suppkey AS asset_id, concat('10.', cast(s_suppkey % 3 AS string), '.', cast(s_suppkey % 4 AS string), '.', cast(s_suppkey % 250 AS string)) AS ip,
  concat('host-', cast(s_suppkey % 9 AS string)) AS hostname, s_name AS owner,
  CASE WHEN s_acctbal > 5000 THEN 3.0 WHEN s_acctbal > 0 THEN 2.0 ELSE 1.0 END AS criticality_score
FROM {supplier}
"""

INTEL = """
SELECT concat('10.', cast(c_custkey % 3 AS string), '.', cast(c_custkey % 4 AS string), '.', cast(c_custkey % 250 AS string)) AS ip,
  max(c_acctbal / 100.0) AS virustotal_score, min(c_acctbal / 120.0) AS abuseipdb_score
FROM {customer}
GROUP BY c_custkey % 3, c_custkey % 4, c_custkey % 250
"""

# who dealt with whom: customers are users, suppliers are hosts, parts are resources
EDGES = """
SELECT DISTINCT concat('c', cast(o_custkey AS string)) AS src, concat('s', cast(l_suppkey AS string)) AS dst,
  CASE l_returnflag WHEN 'A' THEN 'AUTHENTICATED_AS' WHEN 'N' THEN 'CONNECTED_TO' ELSE 'EXECUTED' END AS type
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey
"""

# the same with the times of the first and the last dealing
LINKS = EDGES.replace("SELECT DISTINCT", "SELECT").replace(" AS type\n", " AS type, min(l_shipdate) AS first_ts, max(l_shipdate) AS last_ts\n") + "GROUP BY 1, 2, 3\n"

STATES = """
SELECT conv_id AS session, turn AS step, role AS state, length(text) AS size FROM {conversations}
"""

LABELLED = """
SELECT doc_id, quality AS label, toxic AS pred, (doc_id % 100) / 100.0 AS prob FROM {labels}
"""

VIEWS: dict[str, tuple[str, tuple[str, ...]]] = {
    name: (sql, tuple(dict.fromkeys(re.findall(r"\{(\w+)\}", sql))))
    for name, sql in {
        "requests": REQUESTS,
        "connections": CONNECTIONS,
        "assets": ASSETS,
        "intel": INTEL,
        "edges": EDGES,
        "links": LINKS,
        "states": STATES,
        "labelled": LABELLED,
    }.items()
}


def with_views(sql: str, needs: tuple[str, ...]) -> str:
    """``sql`` under a WITH clause that defines the views it needs."""
    parts = [f"{n} AS ({re.sub(r'[{}]', '', VIEWS[n][0])})" for n in needs]
    if not parts:
        return sql
    body = sql.strip()
    if re.match(r"with\s+recursive\b", body, re.I):
        return f"WITH RECURSIVE {', '.join(parts)}, {re.sub(r'(?i)^with\s+recursive', '', body)}"
    if re.match(r"with\b", body, re.I):
        return f"WITH {', '.join(parts)}, {re.sub(r'(?i)^with', '', body)}"
    return f"WITH {', '.join(parts)} {body}"
