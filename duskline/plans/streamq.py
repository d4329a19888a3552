"""Queries: streams over the events file, run to the end of the input and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duskline.operators.graph import shared_folder
from duskline.streaming import streams as X

from .registry import query, rnd

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def run(t, build, mode: str = "complete") -> DataFrame:
    """Run ``build(stream)`` over the events table to its end; the result is a table in the shared folder.

    Each batch has a folder of its own, so a batch that is tried again replaces what it wrote.
    """
    spark = t.spark
    at = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    stream = spark.readStream.schema(t.events.schema).option("pathGlobFilter", "*.parquet").parquet(f"{t.sf_dir}/events.parquet*")
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        out = build(stream)

        def put(batch: DataFrame, batch_id: int) -> None:
            batch.write.mode("overwrite").parquet(f"{at}/out" if mode == "complete" else f"{at}/out/{batch_id}")

        writer = out.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{at}/cp")
        writer.trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(PROVIDER, before)
    return spark.read.schema(out.schema).option("recursiveFileLookup", "true").parquet(f"{at}/out")


@query("x01_tumbling_counts", "SELECT epoch_us(time_bucket(INTERVAL '1 minute', ts)) // 1000000 AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def _(t):
    return run(t, lambda s: X.tumbling_counts(s, "event_type")).withColumn("start", F.unix_timestamp("start"))


@query("x02_sliding_stats", "SELECT (epoch_us(time_bucket(INTERVAL '30 minutes', ts)) // 1000000) - 1800 * k AS start, count(*) AS n, round(avg(value), 5) AS mean FROM events, (SELECT unnest([0, 1]) AS k) GROUP BY 1")
def _(t):
    return run(t, lambda s: X.sliding_stats(s, "1 hour", "30 minutes")).select(F.unix_timestamp("start").alias("start"), "n", rnd("mean").alias("mean"))


@query("x03_session_stats", "WITH g AS (SELECT user_id, ts, CASE WHEN coalesce(epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) >= 3600000000, true) THEN 1 ELSE 0 END AS nw FROM events), s AS (SELECT *, sum(nw) OVER (PARTITION BY user_id ORDER BY ts) AS no FROM g) SELECT user_id, min(epoch_us(ts) // 1000000) AS start, count(*) AS n FROM s GROUP BY user_id, no")
def _(t):
    return run(t, lambda s: X.session_stats(s, "user_id")).select("user_id", F.unix_timestamp("start").alias("start"), "n")


@query("x04_stream_ewma", "WITH RECURSIVE b AS (SELECT user_id, event_id, value AS x, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events), r AS (SELECT user_id, event_id, i, x AS s FROM b WHERE i = 1 UNION ALL SELECT b.user_id, b.event_id, b.i, (0.3 * x + 0.7 * s)::double FROM r JOIN b ON b.user_id = r.user_id AND b.i = r.i + 1) SELECT user_id, event_id, round(s, 5) AS level FROM r")
def _(t):
    return run(t, lambda s: X.stream_ewma(s.select("user_id", "event_id", "ts", "value")), "append").withColumn("level", rnd("level"))


@query("x09_stream_visitors")
def _(t):
    return run(t, lambda s: X.stream_visitors(s, "user_id"))


@query("x12_metrics_snapshot", "SELECT event_type, count(*) AS n, round(avg(value), 5) AS mean FROM events GROUP BY 1")
def _(t):
    return run(t, X.metrics_snapshot).withColumn("mean", rnd("mean"))
