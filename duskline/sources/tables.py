"""Readers and writers: connection files, logs, points, domain events, streams, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Column aliases, log patterns and topic schemas that results depend on.
ALIASES = {
    "src_ip": "source_ip", "dst_ip": "destination_ip", "src_port": "source_port", "dst_port": "destination_port",
    "proto": "protocol", "ts": "timestamp", "time": "timestamp", "length": "bytes", "size": "bytes",
}
CONNECTION = (
    "timestamp timestamp, source_ip string, destination_ip string, source_port int, destination_port int, "
    "protocol string, bytes bigint, packets int"
)
LOG_PATTERNS = ["attack", "malware", "intrusion", "unauthorized", "suspicious", "failed.+login", "brute.?force"]
DOMAIN_EVENTS = {
    "threat": "request_id string, ip string, risk_score double, threat_level string, timestamp_ms bigint",
    "response": "request_id string, action string, tier string, timestamp_ms bigint",
    "feedback": "session_id string, action string, reward double, timestamp_ms bigint",
    "metric": "name string, value double, labels map<string,string>, timestamp_ms bigint",
    "graph": "src string, dst string, type string, timestamp_ms bigint",
}


def standardize(df: DataFrame, aliases: dict[str, str] = ALIASES) -> DataFrame:
    """Rename known aliases unless the standard name is there already."""
    names = {a: s for a, s in aliases.items() if a in df.columns and s not in df.columns}
    taken: set[str] = set()
    out = {}
    for a, s in names.items():
        if s not in taken:
            taken.add(s)
            out[a] = s
    return df.withColumnsRenamed(out)


def read_connections(spark: SparkSession, path: str, fmt: str, schema: str = CONNECTION, **options) -> DataFrame:
    """Connections from csv, json or a JDBC table, with standard column names; ``options`` are those of the reader.

    A JDBC table is read in parallel if the options name a partitionColumn with its bounds and numPartitions.
    """
    if fmt == "csv":
        return standardize(spark.read.options(**({"header": True} | options)).schema(schema).csv(path))
    if fmt == "json":
        return standardize(spark.read.options(**options).schema(schema).json(path))
    if fmt == "jdbc":
        return standardize(spark.read.format("jdbc").options(url=path, **options).load())
    raise ValueError(f"unknown format {fmt!r}")


def rename_shipper_fields(df: DataFrame, tag: str) -> DataFrame:
    """Log-shipper names to event names, with a source tag."""
    groups = {
        "src_ip": ["src_ip", "src", "source_ip"], "timestamp": ["timestamp", "_time"],
        "event_type": ["event_type", "action"], "raw_payload": ["raw_payload", "raw", "_raw"],
    }
    used = {a for names in groups.values() for a in names}
    new = [F.coalesce(*[F.col(a) for a in names if a in df.columns]).alias(n) for n, names in groups.items() if any(a in df.columns for a in names)]
    return df.select(*[x for x in df.columns if x not in used], *new, F.lit(tag).alias("source"))


def parse_logs(lines: DataFrame, value: str = "value") -> DataFrame:
    """``timestamp level source message`` lines with a threat score; lines of fewer than four fields are dropped."""
    parts = F.filter(F.split(F.col(value), r"\s+"), lambda x: x != "")
    out = lines.withColumn("_p", parts).filter(F.size("_p") >= 4)
    message = F.array_join(F.slice("_p", 4, F.size("_p") - 3), " ")
    return out.select(
        F.try_to_timestamp(F.col("_p")[0], F.lit("yyyy-MM-dd'T'HH:mm:ss")).alias("timestamp"),
        F.col("_p")[1].alias("level"),
        F.col("_p")[2].alias("source"),
        message.alias("message"),
        log_threat_score(message).alias("threat_score"),
    )


def log_threat_score(message):
    m = F.col(message) if isinstance(message, str) else message
    score = F.lit(0.0)
    for p in LOG_PATTERNS:
        score = score + F.when(m.rlike(f"(?i){p}"), 0.3).otherwise(0.0)
    return score


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    return parse_logs(spark.read.text(path))


def decode_domain_event(df: DataFrame, kind: str, value: str = "value") -> DataFrame:
    """Columns of one of the five domain events from JSON text, with the time decoded."""
    event = df.select(F.from_json(F.col(value).cast("string"), DOMAIN_EVENTS[kind]).alias("e")).select("e.*")
    return event.withColumn("timestamp", F.timestamp_millis("timestamp_ms")).drop("timestamp_ms")


def sanitize_points(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, rejects) of points (measurement, tags map, fields map, timestamp text): null fields are dropped."""
    fields = F.map_filter("fields", lambda k, v: v.isNotNull())
    ok = (F.coalesce(F.length("measurement"), F.lit(0)) > 0) & F.col("tags").isNotNull() & F.col("fields").isNotNull() & (F.size(fields) > 0)
    ok = F.coalesce(ok, F.lit(False))
    time = F.try_to_timestamp(F.col("timestamp").cast("string"))
    good = df.filter(ok).withColumn("fields", fields).withColumn("tags", F.map_filter("tags", lambda k, v: v.isNotNull()))
    return good.withColumn("timestamp", time), df.filter(~ok)


def to_performance_points(df: DataFrame) -> DataFrame:
    return df.select(
        F.coalesce("host", F.lit("localhost")).alias("host"),
        F.coalesce("path", F.lit("/")).alias("endpoint"),
        F.coalesce("method", F.lit("GET")).alias("method"),
        F.coalesce(F.col("status_code").cast("string"), F.lit("200")).alias("status_code"),
        F.coalesce("duration_ms", F.lit(0.0)).alias("response_time"),
        F.lit(1.0).alias("request_count"),
        F.when(F.col("status_code") >= 400, 1.0).otherwise(0.0).alias("error_count"),
        "ts",
    )


def to_threat_points(df: DataFrame) -> DataFrame:
    return df.select(
        F.col("ip").alias("ip_address"),
        F.col("event_type").alias("threat_type"),
        "severity",
        F.coalesce("session_id", F.lit("unknown")).alias("session_id"),
        F.coalesce("country", F.lit("unknown")).alias("country"),
        F.coalesce("risk_score", F.lit(0.0)).alias("risk_score"),
        (F.col("status_code") == 403).alias("blocked"),
        "ts",
    )


def to_behavior_points(df: DataFrame) -> DataFrame:
    return df.select(
        "session_id",
        F.coalesce("country", F.lit("unknown")).alias("location"),
        F.lit(1.0).alias("action_count"),
        F.when(F.col("path").startswith("/api"), 1.0).otherwise(0.0).alias("api_calls"),
        F.when(F.col("event_type") == "purchase", 1.0).otherwise(0.0).alias("conversions"),
        "ts",
    )


def load_attack_catalog(spark: SparkSession, path: str) -> DataFrame:
    """Techniques of a STIX bundle: id, name, tactics."""
    bundle = spark.read.schema(
        "objects array<struct<type:string,name:string,external_references:array<struct<source_name:string,external_id:string>>,"
        "kill_chain_phases:array<struct<phase_name:string>>>>"
    ).json(path, multiLine=True)
    rows = bundle.select(F.explode("objects").alias("o")).filter("o.type = 'attack-pattern'")
    ids = F.filter("o.external_references", lambda r: r["source_name"] == "mitre-attack")
    return rows.select(ids[0]["external_id"].alias("technique_id"), "o.name", F.col("o.kill_chain_phases.phase_name").alias("tactics"))


def save_report(df: DataFrame, path: str, fmt: str) -> None:
    if fmt == "text":
        df = df.select(F.to_json(F.struct(*df.columns)).alias("value"))
    df.write.mode("overwrite").format(fmt).save(path)


def to_exposition_text(df: DataFrame, name: str, labels: list[str], value: str) -> DataFrame:
    """Lines ``name{label="x"} value``."""
    parts = F.concat_ws(",", *[F.concat(F.lit(f'{x}="'), F.col(x).cast("string"), F.lit('"')) for x in labels])
    return df.select(F.concat(F.lit(name + "{"), parts, F.lit("} "), F.col(value).cast("string")).alias("value"))


def audit_rows(actions: DataFrame) -> DataFrame:
    """Response steps as audit rows with their day, for an append-only table partitioned by day."""
    return actions.select(
        F.sha2(F.concat_ws("|", "request_id", "action"), 256).alias("audit_id"), "request_id", "action", "status", "ts",
        F.to_date("ts").alias("day"),
    )


def read_event_stream(spark: SparkSession, fmt: str, options: dict[str, str], schema: str, path: str | None = None) -> DataFrame:
    """JSON events from a topic (``kafka``) or from files of JSON lines or Parquet."""
    reader = spark.readStream.format(fmt).options(**options)
    if fmt == "kafka":
        return reader.load().select(F.from_json(F.col("value").cast("string"), schema).alias("e")).select("e.*")
    return reader.schema(schema).load(path)


def write_event_stream(df: DataFrame, key: str, fmt: str, path: str, checkpoint: str, **options):
    """Rows as JSON keyed by ``key``; to files the payload is one column ``value``."""
    rows = df.select(F.col(key).cast("string").alias("key"), F.to_json(F.struct(*df.columns)).alias("value"))
    return rows.writeStream.format(fmt).option("checkpointLocation", checkpoint).options(**options).trigger(availableNow=True).start(path)


def write_points(stream: DataFrame, path: str, checkpoint: str):
    """Batches of points to Parquet partitioned by batch and day; a batch that is tried again replaces itself."""

    def put(batch: DataFrame, number: int) -> None:
        batch.withColumn("day", F.to_date("ts")).write.mode("overwrite").partitionBy("day").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
