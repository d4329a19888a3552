"""Column functions: normalisation, classification, text and time helpers. All are built-in expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Names, lists and patterns that results depend on.
SEVERITY = {
    "info": "low", "low": "low", "medium": "medium", "high": "high", "critical": "critical",
    "warn": "medium", "warning": "medium", "error": "high",
}
SEVERITY_RANK = {"low": 1, "medium": 2, "high": 3, "critical": 4}
HIGH_RISK_ZONES = ["CN", "RU", "KP"]
HIGH_RISK_COUNTRIES = ["CN", "RU", "KP", "IR"]
BOT_WORDS = ["bot", "crawler", "spider"]
SUSPICIOUS_AGENTS = [
    "bot", "crawler", "spider", "scraper", "curl", "wget", "python", "java", "perl", "ruby", "php",
]
PRIVATE_IP = r"^(10\.|192\.168\.|172\.(1[6-9]|2[0-9]|3[01])\.)"
SUSPICIOUS_ITEM = (
    r"(?i)admin|\.php$|\.asp$|phpmyadmin|wp-admin|\.env$|config|backup|test|debug|dev|api/v[0-9]+|bot|crawler|spider|scanner"
)
COMMON_BROWSER = r"(?i)mozilla/5\.0.*(chrome|firefox|safari|edge)"
IOC_TYPES = [
    ("ip_address", r"^[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}$"),
    ("domain", r"(?i)^[a-z0-9]([a-z0-9-]{0,61}[a-z0-9])?\.([a-z]{2,})$"),
    ("url", r"(?i)^https?://"),
    ("email", r"(?i)^[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}$"),
    ("md5_hash", r"(?i)^[a-f0-9]{32}$"),
    ("sha1_hash", r"(?i)^[a-f0-9]{40}$"),
    ("sha256_hash", r"(?i)^[a-f0-9]{64}$"),
    ("file_path", r"(?i)^[a-z]:\\|^/"),
    ("registry_key", r"(?i)^HKEY_"),
]
DURATIONS = {"s": 1, "m": 60, "h": 3600, "d": 86400, "w": 604800, "y": 31536000}
SIZES = {"B": 1, "KB": 1 << 10, "MB": 1 << 20, "GB": 1 << 30, "TB": 1 << 40}


def c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def first_of(mapping: dict[str, str], key: Column, default: str) -> Column:
    """Look a key up in a literal map."""
    return F.coalesce(F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])[key], F.lit(default))


def contains_any(col: Column | str, words: list[str]) -> Column:
    low = F.lower(c(col))
    return reduce(lambda a, b: a | b, [low.contains(w) for w in words])


def normalize_severity(col: Column | str) -> Column:
    return first_of(SEVERITY, F.lower(F.coalesce(c(col), F.lit("low"))), "low")


def severity_rank(col: Column | str) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in SEVERITY_RANK.items() for x in kv])[c(col)], F.lit(0))


def normalize_path(col: Column | str) -> Column:
    """Path of a URL or path, query and fragment stripped, lower case."""
    bare = F.regexp_replace(c(col), r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*", "")
    return F.lower(F.regexp_replace(bare, r"[?#].*$", ""))


def normalize_user_agent(col: Column | str) -> Column:
    """Agent without version numbers, white space squeezed, lower case."""
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(c(col), r"/[0-9.]+", ""), r"\s+", " ")))


def location_key(country, region, city) -> Column:
    return F.lower(F.concat_ws("|", c(country), c(region), c(city)))


def classify_action(path="path", method="method", status="status_code") -> Column:
    """Action of a request: status decides first, then path, then method."""
    p, m, s = c(path), c(method), F.coalesce(c(status), F.lit(200))
    get = m == "GET"
    named = [
        ("back_button", r"(?i)/back$|history\.back"),
        ("refresh", r"(?i)/refresh$|reload"),
        ("redirect", r"(?i)/redirect"),
        ("scroll", r"(?i)/scroll|pagination"),
        ("click", r"(?i)/click|button|link"),
        ("rate_limit_hit", r"(?i)/rate-limit|429"),
        ("captcha_challenge", r"(?i)/captcha|challenge"),
        ("blocked_request", r"(?i)/blocked|denied"),
    ]
    out = (
        F.when(s == 404, "error_404")
        .when(s == 403, "error_403")
        .when(s >= 500, "error_500")
        .when(s >= 400, "error_404")
        .when((p.contains("/auth/") | p.contains("/login")) & (m != "POST"), "login_attempt")
        .when((p.contains("/auth/") | p.contains("/login")) & (s == 200), "login_success")
        .when(p.contains("/auth/") | p.contains("/login"), "login_failure")
        .when(p.contains("/logout"), "logout")
        .when(p.startswith("/api/"), "api_call")
        .when(p.contains("/search"), "search")
        .when((m == "POST") & ~p.contains("/api/"), "form_submit")
        .when(p.contains("/download") | p.contains(".pdf") | p.contains(".zip"), "download")
        .when((m == "POST") & p.contains("/upload"), "upload")
    )
    for name, pattern in named:
        out = out.when(get & p.rlike(pattern), name)
    return out.when(m.isin("PUT", "PATCH"), "form_submit").when(m == "DELETE", "api_call").otherwise("page_view")


def classify_context(ip="ip", path="path", user="user_id", session="session_id", agent="user_agent", risk="risk_score"):
    """Context of a request; the first rule that applies wins."""
    user_text = c(user).cast("string")
    return (
        F.when(c(ip).startswith("10.0.0.") | c(ip).contains("suspicious"), "suspicious")
        .when(c(path).contains("/admin") | c(path).contains("/privileged") | user_text.contains("admin"), "privileged")
        .when(c(user).isNull() & c(session).isNull(), "anonymous")
        .when(contains_any(F.coalesce(c(agent), F.lit("")), BOT_WORDS), "suspicious")
        .when(c(risk) > 0.8, "suspicious")
        .when(c(risk) > 0.6, "restricted")
        .when(c(user).isNotNull(), "authenticated")
        .otherwise("normal")
    )


def classify_resource(path) -> Column:
    p = c(path)
    return (
        F.when(p.contains("/admin"), "admin")
        .when(p.startswith("/api"), "api")
        .when(p.rlike(r"\.[a-zA-Z0-9]+$"), "file")
        .otherwise("endpoint")
    )


def port_class(port) -> Column:
    return F.when(c(port) < 1024, "well_known").when(c(port) < 49152, "registered").otherwise("dynamic")


def classify_ioc(col) -> Column:
    out = None
    for name, pattern in IOC_TYPES:
        hit = c(col).rlike(pattern)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("unknown")


def temporal_context(ts) -> dict[str, Column]:
    """Hour, weekday (Monday 0), business hours (9 to 17, Monday to Friday), weekend."""
    hour, day = F.hour(c(ts)), F.weekday(c(ts))
    return {
        "hour": hour,
        "weekday": day,
        "is_business_hours": hour.between(9, 17) & (day < 5),
        "is_weekend": day >= 5,
    }


def time_pattern(ts) -> Column:
    t = temporal_context(ts)
    return F.when(t["is_business_hours"], "peak_hours").when(t["is_weekend"], "weekend").otherwise("off_hours")


def geo_zone(country) -> Column:
    return F.when(c(country) == "LOCAL", "safe").when(c(country).isin(HIGH_RISK_ZONES), "high_risk").otherwise("moderate")


def country_risk(country) -> Column:
    return F.when(c(country).isin(HIGH_RISK_COUNTRIES), 0.8).otherwise(0.2)


def is_suspicious_ua(agent) -> Column:
    return contains_any(agent, SUSPICIOUS_AGENTS)


def is_bot(agent) -> Column:
    return contains_any(agent, BOT_WORDS)


def is_private_ip(ip) -> Column:
    return c(ip).rlike(PRIVATE_IP)


def is_suspicious_item(item) -> Column:
    return c(item).rlike(SUSPICIOUS_ITEM)


def browser_anomaly(agent) -> Column:
    return ~F.coalesce(c(agent).rlike(COMMON_BROWSER), F.lit(False))


def shannon_entropy(col) -> Column:
    """Bits per character; 0 for an empty string."""
    chars = F.filter(F.split(c(col), ""), lambda x: x != "")
    n = F.size(chars).cast("double")
    parts = F.transform(F.array_distinct(chars), lambda x: F.size(F.filter(chars, lambda y: y == x)) / n)
    return F.when(F.length(c(col)) == 0, 0.0).otherwise(F.aggregate(parts, F.lit(0.0), lambda a, p: a - p * F.log2(p)))


def count_chars(col, char_class: str) -> Column:
    return F.regexp_count(c(col), F.lit(f"[{char_class}]"))


def extract_matches(col, pattern: str, context: int = 20) -> Column:
    """All matches as structs (matched, start, stop, context): places from 0, stop exclusive."""
    text = c(col)
    found, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    total = lambda xs: F.aggregate(xs, F.lit(0), lambda a, x: a + F.length(x))

    def place(m: Column, i: Column) -> Column:
        start = total(F.slice(between, F.lit(1), i + 1)) + total(F.slice(found, F.lit(1), i))
        low = F.greatest(start - context, F.lit(0))
        around = F.substring(text, low + 1, start + F.length(m) + context - low)
        return F.struct(m.alias("matched"), start.alias("start"), (start + F.length(m)).alias("stop"), around.alias("context"))

    return F.transform(found, place)


def parse_time(col) -> Column:
    """ISO text, or digits as epoch milliseconds; null if neither."""
    return F.when(c(col).rlike(r"^[0-9]{10,}$"), F.timestamp_millis(c(col).try_cast("bigint"))).otherwise(
        F.try_to_timestamp(c(col))
    )


def parse_duration(col) -> Column:
    """Seconds of ``7d``, ``1y``, ``30m``; null if it isn't one."""
    n, unit = F.regexp_extract(c(col), r"^([0-9]+)([smhdwy])$", 1), F.regexp_extract(c(col), r"^([0-9]+)([smhdwy])$", 2)
    return n.try_cast("bigint") * F.create_map(*[F.lit(x) for kv in DURATIONS.items() for x in kv])[unit]


def parse_size(col) -> Column:
    """Bytes of ``10GB``; null if it isn't a size."""
    pattern = r"^([0-9]+)(B|KB|MB|GB|TB)$"
    n, unit = F.regexp_extract(c(col), pattern, 1), F.regexp_extract(c(col), pattern, 2)
    return n.try_cast("bigint") * F.create_map(*[F.lit(x) for kv in SIZES.items() for x in (kv[0], int(kv[1]))])[unit].cast("bigint")


def clamp01(col) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c(col)))


def safe_ratio(a, b, floor: float = 0.001) -> Column:
    return c(a) / F.greatest(c(b), F.lit(floor))


def sigmoid(col) -> Column:
    return 1 / (1 + F.exp(-c(col)))


def recency(ts, as_of: str, tau_seconds: float) -> Column:
    age = F.unix_micros(F.lit(as_of).cast("timestamp")) - F.unix_micros(c(ts).cast("timestamp"))
    return F.exp(-(age / 1e6) / tau_seconds)


def time_gap(a, b) -> Column:
    """Microseconds between two times."""
    return F.abs(F.unix_micros(c(a).cast("timestamp")) - F.unix_micros(c(b).cast("timestamp")))


def time_correlation(a, b, span_seconds: float = 300) -> Column:
    """1 at the same time, falling to 0 at ``span_seconds``."""
    return F.greatest(F.lit(0.0), 1 - time_gap(a, b) / F.lit(span_seconds * 1e6))


def epoch_seconds(ts) -> Column:
    return F.unix_micros(c(ts).cast("timestamp")) / 1e6


def risk_level(score, bands: list[tuple[float, str]], default: str) -> Column:
    """The name of the first band (highest first) that the score reaches."""
    out = None
    for least, name in bands:
        out = F.when(c(score) >= least, name) if out is None else out.when(c(score) >= least, name)
    return out.otherwise(default)


def json_blob(df: DataFrame, name: str = "blob") -> DataFrame:
    """All columns of a row as lower-cased JSON text, for substring search."""
    return df.withColumn(name, F.lower(F.to_json(F.struct(*df.columns))))


def text_features(col) -> dict[str, Column]:
    words = F.filter(F.split(c(col), r"\s+"), lambda w: w != "")
    return {
        "text_length": F.length(c(col)),
        "word_count": F.size(words),
        "unique_words": F.size(F.array_distinct(words)),
        "exclamations": F.regexp_count(c(col), F.lit("!")),
        "questions": F.regexp_count(c(col), F.lit(r"\?")),
        "capitals": F.regexp_count(c(col), F.lit("[A-Z]")),
    }


def normalize_events(raw: DataFrame, payload: str = "payload") -> DataFrame:
    """Unified events of raw (source, payload map or JSON text): the first non-empty alias of each field."""
    is_json = dict(raw.dtypes)[payload] == "string"

    def get(key: str) -> Column:
        value = F.get_json_object(c(payload), f"$.{key}") if is_json else F.try_element_at(c(payload), F.lit(key))
        return F.nullif(value, F.lit(""))

    def first(*keys: str) -> Column:
        return F.coalesce(*[get(k) for k in keys])

    return raw.select(
        first("event_id", "id").alias("event_id"),
        c("source"),
        F.coalesce(first("src_ip", "srcIp", "source_ip", "client_ip", "ip"), F.lit("0.0.0.0")).alias("src_ip"),
        first("dst_ip", "dstIp", "destination_ip", "target_ip").alias("dst_ip"),
        first("timestamp", "time", "event_time").alias("timestamp"),
        F.coalesce(first("event_type", "eventType", "action", "type"), F.lit("unknown")).alias("event_type"),
        normalize_severity(first("severity", "level", "priority")).alias("severity"),
        c(payload).alias("raw_payload"),
        first("user_id", "userId").alias("user_id"),
        first("host", "hostname", "device").alias("host"),
        (F.json_object_keys(c(payload)) if is_json else F.map_keys(c(payload))).alias("original_keys"),
    )


def interpolate(template, values: Column, keys: list[str]) -> Column:
    """Replace ``{{key}}`` by the map's value; unknown keys stay."""
    out = c(template)
    for k in keys:
        out = F.replace(out, F.lit("{{" + k + "}}"), F.coalesce(F.try_element_at(values, F.lit(k)), F.lit("{{" + k + "}}")))
    return out


def content_hash(col) -> dict[str, Column]:
    """SHA-256, SHA-512 and a short id of a text."""
    c = F.col(col) if isinstance(col, str) else col
    return {"sha256": F.sha2(c, 256), "sha512": F.sha2(c, 512), "short_id": F.substring(F.sha2(c, 256), 1, 16)}


def payload_keys(col) -> Column:
    """The keys of a JSON object."""
    return F.json_object_keys(F.col(col) if isinstance(col, str) else col)


def hash_quality(df, col: str, buckets: int = 1024):
    """One row: collision rate of xxhash64 over the distinct values, and mean and variance of the bucket sizes."""
    values = df.filter(F.col(col).isNotNull()).select(col, F.xxhash64(col).alias("_h"))
    sizes = values.groupBy(F.pmod("_h", F.lit(buckets)).alias("_b")).agg(F.count(F.lit(1)).alias("n"))
    rate = values.agg((1 - F.try_divide(F.count_distinct("_h"), F.count_distinct(col))).alias("collision_rate"))
    return sizes.agg(F.var_pop("n").alias("bucket_variance"), F.avg("n").alias("bucket_mean")).crossJoin(F.broadcast(rate))  # one row each
