"""Structured Streaming forms of the operators. Each equals its batch twin over the same rows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import DoubleType, LongType, StructField, StructType


def with_lateness(stream: DataFrame, ts: str, delay: str) -> DataFrame:
    """Drop rows that come later than ``delay`` after the newest event time (read as UTC if it has no zone)."""
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)


def tumbling_counts(stream: DataFrame, key: str, width: str = "1 minute", ts: str = "ts", delay: str = "10 minutes") -> DataFrame:
    g = with_lateness(stream, ts, delay).groupBy(F.window(ts, width), key).agg(F.count(F.lit(1)).alias("n"))
    return g.select(F.col("window.start").alias("start"), key, "n")


def sliding_stats(stream: DataFrame, size: str = "5 minutes", slide: str = "1 minute", ts: str = "ts", delay: str = "10 minutes") -> DataFrame:
    g = with_lateness(stream, ts, delay).groupBy(F.window(ts, size, slide)).agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"))
    return g.select(F.col("window.start").alias("start"), "n", "mean")


def session_stats(stream: DataFrame, key: str, gap: str = "1 hour", ts: str = "ts", delay: str = "10 minutes") -> DataFrame:
    g = with_lateness(stream, ts, delay).groupBy(F.session_window(ts, gap), key).agg(F.count(F.lit(1)).alias("n"))
    return g.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), key, "n")


def stream_visitors(stream: DataFrame, item: str, width: str = "1 day", ts: str = "ts", delay: str = "10 minutes") -> DataFrame:
    g = with_lateness(stream, ts, delay).groupBy(F.window(ts, width)).agg(F.approx_count_distinct(item, 0.02).alias("visitors"))
    return g.select(F.col("window.start").alias("start"), "visitors")


def dedupe_stream(stream: DataFrame, keys: list[str], ts: str = "ts", delay: str = "1 hour") -> DataFrame:
    return with_lateness(stream, ts, delay).dropDuplicatesWithinWatermark(keys)


def join_threat_response(threats: DataFrame, responses: DataFrame, key: str = "request_id", bound: str = "10 minutes", how: str = "inner"):
    """Threats with the responses to the same request within the bound after them (columns ts and r_ts)."""
    a = with_lateness(threats, "ts", bound)
    b = responses.select(F.col(key).alias("_k"), F.col("ts").alias("r_ts"), "action")
    b = with_lateness(b, "r_ts", bound)
    near = (F.col(key) == F.col("_k")) & (F.col("r_ts") >= F.col("ts")) & (F.col("r_ts") <= F.col("ts") + F.expr(f"INTERVAL {bound}"))
    return a.join(b, near, how).drop("_k")


def detection_stream(stream: DataFrame, assets: DataFrame, intel: DataFrame) -> DataFrame:
    """Requests enriched by static tables, scored and triaged, row by row."""
    from duskline.functions.scalars import risk_level
    from duskline.operators.detect import BANDS_GO, triage
    from duskline.operators.enrich import enrich_assets, enrich_threat_intel

    r = enrich_threat_intel(enrich_assets(stream, assets), intel)
    r = r.withColumn("score", F.least(F.lit(1.0), F.col("risk_score") * F.col("criticality") * (1 + F.col("intel_score") / 100)))
    r = r.withColumn("level", risk_level("score", BANDS_GO, "minimal"))
    return r.withColumn("outcome", triage(F.col("score"), F.lit(0.8), F.col("level")))


def route_by_level(stream: DataFrame, path: str, checkpoint: str):
    """Write each micro-batch to one folder per level; a batch that is retried replaces its own files."""

    def put(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("level", "batch").parquet(path)

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class EwmaProcessor(StatefulProcessor):
    """Smoothing per key: the state is level and variance."""

    def __init__(self, alpha: float = 0.3):
        self.alpha = alpha

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("ewma", StructType([StructField("s", DoubleType()), StructField("v", DoubleType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows)).sort_values(["ts", "event_id"])
        s, v = self.state.get() if self.state.exists() else (None, 0.0)
        levels = []
        for x in pdf["value"]:
            if s is None:
                s = float(x)
            else:
                v = self.alpha * (x - s) ** 2 + (1 - self.alpha) * v
                s = self.alpha * x + (1 - self.alpha) * s
            levels.append(s)
        self.state.update((s, v))
        yield pd.DataFrame({"user_id": key[0], "event_id": pdf["event_id"].values, "level": levels})

    def close(self) -> None:
        pass


def stream_ewma(stream: DataFrame, key: str = "user_id", alpha: float = 0.3) -> DataFrame:
    """(user_id, event_id, level) with the smoothed value of each row; rows must come in time order per key."""
    return stream.groupBy(key).transformWithStateInPandas(
        EwmaProcessor(alpha), "user_id long, event_id long, level double", outputMode="Append", timeMode="None"
    )


class BucketProcessor(StatefulProcessor):
    """Token bucket per key: the state is tokens and the time of the last request; idle keys may expire."""

    def __init__(self, limit: int, rate: float, expire: bool):
        self.limit, self.rate, self.expire = limit, rate, expire

    def init(self, handle: StatefulProcessorHandle) -> None:
        schema = StructType([StructField("tokens", LongType()), StructField("us", LongType())])
        ttl = int(1000 * (self.limit / self.rate + 1)) if self.expire else None
        self.state = handle.getValueState("bucket", schema, ttlDurationMs=ttl)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows)).sort_values(["us", "request_id"])
        tokens, last = self.state.get() if self.state.exists() else (self.limit, int(pdf["us"].iloc[0]))
        allowed = []
        for t in pdf["us"]:
            tokens = min(self.limit, tokens + int((t - last) * self.rate // 1_000_000))
            last = int(t)
            ok = tokens >= 1
            tokens -= ok
            allowed.append(ok)
        self.state.update((int(tokens), last))
        yield pd.DataFrame({"key": key[0], "request_id": pdf["request_id"].values, "allowed": allowed})

    def close(self) -> None:
        pass


def stream_limit(stream: DataFrame, limit: int, rate: float, expire: bool = True) -> DataFrame:
    """(key, request_id, allowed) for requests with columns key, request_id, us.

    With ``expire``, state of keys that were idle for long enough to refill is dropped by processing time; that
    suits a running stream, not a replay of old data.
    """
    return stream.groupBy("key").transformWithStateInPandas(
        BucketProcessor(limit, rate, expire),
        "key string, request_id long, allowed boolean",
        outputMode="Append",
        timeMode="ProcessingTime" if expire else "None",
    )


def stream_posterior(stream: DataFrame, path: str, checkpoint: str, keys: list[str]):
    """Merge Beta posteriors per micro-batch: each batch writes its counts once, readers sum them."""
    from duskline.operators.limits import beta_posterior

    def put(batch: DataFrame, batch_id: int) -> None:
        p = beta_posterior(batch, keys, alpha=0, beta=0).withColumn("batch", F.lit(batch_id))
        p.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_posterior(spark, path: str, keys: list[str], alpha: float = 1, beta: float = 1) -> DataFrame:
    p = spark.read.parquet(path).groupBy(*keys)
    return p.agg((F.sum("alpha") + alpha).alias("alpha"), (F.sum("beta") + beta).alias("beta"), F.sum("selections").alias("selections"))


def metrics_snapshot(stream: DataFrame, every: str = "1 minute"):
    """Running totals per event type, for a processing-time trigger in update mode."""
    return stream.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"))
