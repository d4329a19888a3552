"""Invariants, small scenarios and file round trips."""

from __future__ import annotations

import json
from math import e, sqrt

import pytest
from pyspark.sql import functions as F

from duskline.functions import scalars as S
from duskline.operators import detect, forensics, limits, sketch
from duskline.sources import tables
from duskline.streaming import streams

SF = "/root/testdata/sf0.001"


def test_count_min_never_under_and_within_bound(spark):
    events = spark.read.parquet(f"{SF}/events.parquet")
    truth = {str(r.user_id): r.n for r in events.groupBy("user_id").agg(F.count("*").alias("n")).collect()}
    eps, n = 0.01, sum(truth.values())
    got = sketch.cms_query(sketch.cms_build(events, "user_id", eps), events, "user_id", eps).collect()
    assert len(got) == len(truth)
    over = [r.estimate - truth[r.user_id] for r in got]
    assert min(over) >= 0 and sum(x <= e * eps * n for x in over) >= 0.99 * len(over)


def test_hll_error_and_merge(spark):
    df = spark.range(20000).withColumn("k", F.col("id") % 4)
    parts = sketch.hll_build(df, "k", "id", 12)
    for r in sketch.hll_estimate(parts, "k").collect():
        assert abs(r.estimate - 5000) <= 4 * 1.04 / sqrt(2**12) * 5000
    whole = sketch.hll_merge(parts.withColumn("a", F.lit(1)), "a")
    assert abs(sketch.hll_estimate(whole, "a").first().estimate - 20000) <= 0.07 * 20000


def test_rewards(spark):
    rows = [(True, False, False, 1), (False, True, False, -1), (False, False, True, -2)]
    df = spark.createDataFrame(rows, "b boolean, i boolean, m boolean, want int")
    assert df.filter(limits.outcome_reward(F.col("b"), F.col("i"), F.col("m")) != F.col("want")).count() == 0


def test_best_arm_is_chosen_most(spark):
    arms = spark.createDataFrame([("c", "monitor", 2.0, 18.0), ("c", "block", 18.0, 2.0), ("c", "isolate", 8.0, 12.0)], "ctx string, arm string, alpha double, beta double")
    chosen = limits.select_actions(spark.range(500).withColumn("ctx", F.lit("c")), arms, "ctx", "arm", "id")
    assert chosen.groupBy("chosen").count().orderBy(F.desc("count")).first().chosen == "block"


def test_sigma_rule_files(spark, tmp_path):
    (tmp_path / "r.yml").write_text("id: r1\ntitle: Failed logins\nlevel: high\nevent_type: login_failed\ncontains:\n  - password\n  - failed\n")
    rules = detect.read_sigma_rules(spark, str(tmp_path))
    assert rules.first().contains == ["password", "failed"]
    ev = spark.createDataFrame([(1, "login_failed", "Password check FAILED"), (2, "login_failed", "ok"), (3, "other", "password failed")], "id2 int, event_type string, blob string")
    assert [r.id2 for r in detect.sigma_match(ev, rules).collect()] == [1]


def test_connection_files_round_trip(spark, tmp_path):
    rows = [("2024-01-01 00:00:00", "192.168.1.1", "10.0.0.1", 1, 80, "TCP", 10, 1)]
    df = spark.createDataFrame(rows, "timestamp string, source_ip string, destination_ip string, source_port int, destination_port int, protocol string, bytes long, packets int")
    df.write.csv(str(tmp_path / "c"), header=True)
    df.write.json(str(tmp_path / "j"))
    for fmt, at in (("csv", "c"), ("json", "j")):
        r = tables.read_connections(spark, str(tmp_path / at), fmt).first()
        assert (r.source_ip, r.destination_port, r.bytes) == ("192.168.1.1", 80, 10)
    for fmt in ("json", "csv", "text"):
        tables.save_report(df, str(tmp_path / f"r{fmt}"), fmt)
        assert spark.read.text(str(tmp_path / f"r{fmt}")).count() == 1
    with pytest.raises(ValueError):
        tables.read_connections(spark, "x", "odd")


def test_log_line_scores(spark):
    df = spark.createDataFrame([("2024-01-01T00:00:00 ERROR auth failed user login brute force",), ("too few",)], "value string")
    r = tables.parse_logs(df).collect()
    assert len(r) == 1 and abs(r[0].threat_score - 0.6) < 1e-9


def test_attack_catalog(spark, tmp_path):
    bundle = {"objects": [{"type": "attack-pattern", "name": "X", "external_references": [{"source_name": "mitre-attack", "external_id": "T1"}], "kill_chain_phases": [{"phase_name": "p"}]}, {"type": "other"}]}
    (tmp_path / "b.json").write_text(json.dumps(bundle))
    assert tables.load_attack_catalog(spark, str(tmp_path / "b.json")).first().technique_id == "T1"


def test_incident_of_four_events(spark):
    rows = [("login_failed", "ws-1", ""), ("process_exec", "ws-1", "powershell -enc AAA"), ("remote_exec", "db-1", "psexec \\\\db-1"), ("large_upload", "db-1", "")]
    ev = spark.createDataFrame([(1, *r, 1.0) for r in rows], "case int, kind string, host string, command string, crit double")
    r = forensics.incident_score(ev, "case", "host", "crit", "kind", "command").first()
    assert abs(r.score - 0.87) < 1e-9 and r.severity == "critical"
    stages = {x.stage for x in forensics.kill_chain(ev, "kind", "command").collect()}
    assert {"execution", "lateral_movement", "exfiltration"} <= stages


def test_normalise_payload_json(spark):
    raw = spark.createDataFrame([("elk", json.dumps({"src_ip": "", "ip": "1.2.3.4", "level": "WARN", "type": "x"}))], "source string, payload string")
    r = S.normalize_events(raw).first()
    assert (r.src_ip, r.severity, r.event_type, r.dst_ip) == ("1.2.3.4", "medium", "x", None)


def _sink(spark, df, tmp_path, mode="append"):
    df.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).outputMode(mode).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
    return spark.read.parquet(str(tmp_path / "out"))


def _stream(spark):
    df = spark.read.parquet(f"{SF}/events.parquet")
    return df, spark.readStream.schema(df.schema).parquet(f"{SF}/events.parquet*")


def test_stream_dedupe_and_limit(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    df, stream = _stream(spark)
    assert _sink(spark, streams.dedupe_stream(stream, ["event_id"], delay="60 days"), tmp_path).count() == df.count()
    keyed = stream.select(F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("request_id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    got = _sink(spark, streams.stream_limit(keyed, 3, 1 / 43200, expire=False), tmp_path / "l")
    batch = limits.replay(df.withColumnRenamed("event_id", "request_id"), "user_id", "token_bucket", 3, 86400, 1 / 43200)
    both = got.select("request_id", F.col("allowed").alias("a")).join(batch, "request_id")
    assert both.count() == df.count() and both.filter("a <> allowed").count() == 0


def test_stream_sinks(spark, tmp_path):
    df, stream = _stream(spark)
    tables.write_event_stream(stream, "event_id", "json", str(tmp_path / "o"), str(tmp_path / "c1")).awaitTermination()
    assert spark.read.json(str(tmp_path / "o")).count() == df.count()
    tables.write_points(stream, str(tmp_path / "p"), str(tmp_path / "c2")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "p")).count() == df.count()
    scored = stream.withColumn("reward", F.col("value") / 500).withColumn("level", F.col("event_type"))
    streams.stream_posterior(scored, str(tmp_path / "b"), str(tmp_path / "c3"), ["event_type"]).awaitTermination()
    post = streams.read_posterior(spark, str(tmp_path / "b"), ["event_type"])
    assert post.agg(F.sum("selections")).first()[0] == df.count()
    streams.route_by_level(scored, str(tmp_path / "r"), str(tmp_path / "c4")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "r")).count() == df.count()
    more = stream.withColumnRenamed("event_id", "request_id")
    joined = streams.join_threat_response(more, more.withColumn("action", F.lit("block")))
    assert _sink(spark, joined.select("request_id", "action"), tmp_path / "j").count() == df.count()


def test_detection_stream(spark, tmp_path):
    from duskline.plans.registry import Tables
    from duskline.plans import views

    t = Tables(spark, SF)
    _, stream = _stream(spark)
    stream.createOrReplaceTempView("stream_events")
    requests = spark.sql(views.REQUESTS.replace("{events}", "stream_events"))
    out = streams.detection_stream(requests, t.assets, t.intel).select("request_id", "level", "outcome")
    got = _sink(spark, out, tmp_path)
    want = streams.detection_stream(t.requests, t.assets, t.intel).select("request_id", "level", "outcome")
    assert got.exceptAll(want).count() == 0 and got.count() == want.count()
