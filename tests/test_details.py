"""Edges of the explaining, evaluating and summarising operators."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from duskline.operators import explain as X
from duskline.operators import graph as G
from duskline.operators import ml as M
from duskline.operators import sequence as Q
from duskline.operators import series as W
from duskline.operators import sketch as K


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def test_explanation_of_nulls_and_levels(spark):
    df = spark.createDataFrame(
        [(1, 0.9, "critical", 0.8, True, None, False, None), (2, 0.1, "minimal", None, None, None, None, True), (3, 0.3, "low", 0.71, False, True, True, False)],
        "id int, s double, l string, b double, vpn boolean, proxy boolean, hours boolean, auth boolean",
    )
    x = X.explain_score(*[F.col(c) for c in ("s", "l", "b", "vpn", "proxy", "hours", "auth")])
    a, b, c = df.select("id", *[v.alias(k) for k, v in x.items()]).orderBy("id").collect()
    assert [f.factor for f in a.factors] == ["behavioral_anomaly", "anonymization_tools", "off_hours_access"]
    assert a.factors[0].impact == 0.8 and a.threat_types == ["malicious_behavior", "suspicious_pattern", "anomaly_detected"]
    assert a.recommendations[-2:] == [X.ADVICE_VPN, X.ADVICE_LOGIN] and len(a.recommendations) == 5
    assert b.factors == [] and b.recommendations == [] and b.threat_types == []
    assert [f.factor for f in c.factors] == ["behavioral_anomaly", "anonymization_tools"] and c.recommendations == X.ADVICE["low"]


def test_fusion_without_matches(spark):
    df = spark.createDataFrame([(1, 1.0, 1.0, 1.0, 0.0), (2, 0.0, -0.5, 0.0, 0.0)], "id int, b double, r double, a double, d double")
    none = spark.createDataFrame([], "id int, category string, severity string, confidence double")
    one, two = X.fuse_signature_scores(df, none, "id", "b", "r", "a", "d").orderBy("id").collect()
    assert one.fused_score == pytest.approx(0.7) and one.action == "block" and one.threat_types == []
    assert two.fused_confidence == pytest.approx(0.25 + 0.125 + 0.2) and two.action == "allow"


def test_intel_risk_counts_only_what_is_there(spark):
    df = spark.createDataFrame([(1, 1.0, 1.0, 30, 40), (2, None, None, 0, None)], "id int, a double, b double, c int, d int")
    full, none = df.select("id", X.intel_risk(*map(F.col, "abcd")).alias("x")).select("id", "x.*").orderBy("id").collect()
    assert full.score == pytest.approx(1.0) and full.priority == "immediate" and full.confidence == 1.0 and len(full.factors) == 4
    assert none.score == 0.0 and none.level == "minimal" and none.priority == "low" and none.confidence == 0.0 and none.factors == []


def test_referrers_direct_only_and_ties(spark):
    df = spark.createDataFrame([("a", None), ("a", ""), ("b", "y"), ("b", "x"), ("b", None)], "s string, r string")
    assert rows(X.referrer_stats(df, "s", "r"), "s") == [("a", 2, 0, 0, None), ("b", 1, 2, 2, "x")]


def test_page_sequence_keeps_the_last(spark):
    df = spark.createDataFrame([("a", i, f"p{i}") for i in range(30)], "s string, i int, page string")
    assert rows(X.page_sequence(df, "s", "page", ["i"])) == [("a", [f"p{i}" for i in range(10, 30)])]


def test_traps_of_all_kinds(spark):
    df = spark.createDataFrame([(1, "/trap", "x", "curl", "10.0.0.1", "POST", "b"), (2, "/", "fake", "a", "1.1.1.1", "GET", None), (3, None, None, None, None, None, None)], "id int, path string, user string, user_agent string, ip string, method string, body string")
    traps = spark.createDataFrame([("honeypot_access", "/trap"), ("honeypot_access", "/trap"), ("credential_trap", "fake")], "type string, trap string")
    got = rows(X.deception_events(df, traps, "id", {"honeypot_access": "path", "credential_trap": "user"}), "id")
    assert got == [(1, "honeypot_access", "/trap", "critical", 1.0), (2, "credential_trap", "fake", "critical", 1.0)]


def test_expiry_keeps_open_and_unknown(spark):
    t = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(1, "resolved", t), (2, "open", t), (3, None, t), (4, "resolved", None), (5, "resolved", t + dt.timedelta(days=1, hours=1))], "id int, status string, updated_at timestamp_ntz")
    assert [r.id for r in X.expire_alerts(df, "2024-01-03 00:00:00").orderBy("id").collect()] == [2, 3, 4, 5]
    assert X.expire_alerts(df.filter("id = 1"), "2024-01-02 00:00:00").count() == 1  # exactly 24 hours old


def test_transition_confidence_and_lookup(spark):
    t = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([("s", i, "ab"[i % 2], t) for i in range(5)], "s string, i int, x string, ts timestamp_ntz")
    m = Q.transition_probs(df, "s", ["i"], "x", "ts", "2024-01-08 00:00:00")
    assert rows(m.select("context", "next", "count", F.round("confidence", 6)), "context") == [("a", "b", 2, 0.007358), ("b", "a", 2, 0.007358)]
    late = Q.transition_probs(df, "s", ["i"], "x", "ts", "2023-01-01 00:00:00").select(F.max("confidence")).first()[0]
    assert late == pytest.approx(0.02)
    asked = spark.createDataFrame([("a", "b"), ("a", "z"), (None, "a")], "context string, next string")
    assert rows(Q.transition_prob(m, asked).select("next", "probability"), "next") == [("a", 0.0), ("b", 1.0), ("z", 0.0)]
    empty = Q.matrix_stats(m.filter("false")).first()
    assert (empty.states, empty.transitions, empty.observations, empty.per_state) == (0, 0, 0, 0.0)


def test_top_k_of_few_and_null(spark):
    df = spark.createDataFrame([("a",), ("a",), (None,), ("b",)], "x string")
    assert rows(K.cms_top_k(K.cms_build(df, "x"), df, "x", 5), "rank") == [("a", 2, 1), ("b", 1, 2)]


def test_series_checks(spark):
    df = spark.createDataFrame([("k", i, float(i % 7)) for i in range(30)], "k string, i int, v double")
    bad = W.validate_series(df, ["k"], ["i"], "v", 1.5, 5).first()
    assert bad.issues == ["alpha_range", "window_size"] and bad.accuracy is None and not bad.is_valid and bad.points == 30
    flat = W.validate_series(df.withColumn("v", F.lit(1.0)), ["k"], ["i"], "v", 0.3, 10).first()
    assert flat.is_valid and flat.accuracy == 1.0
    rising = df.withColumn("v", F.col("i") * 1.0)
    assert [r.insight for r in W.series_insights(rising, ["k"], ["i"], "v", 0.3, 100.0).collect()] == ["trend_change", "volatility_regime"]  # 10 values spread wider than 5
    assert W.series_insights(df.filter("false"), ["k"], ["i"], "v").count() == 0


def test_clamped_depth(spark):
    edges = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(9)], "src string, dst string")
    seeds = spark.createDataFrame([("n0",)], "id string")
    assert G.ip_graph(edges, seeds, 99).agg(F.max("hops")).first()[0] == 5
    assert G.ip_graph(edges, seeds, -3).count() == 1


def test_graph_report_of_nothing(spark):
    none = spark.createDataFrame([], "score double")
    assert rows(G.graph_report(none, none)) == [(0, 0.0, 0, 0)]
    some = spark.createDataFrame([(0.85,), (0.7,), (0.84,), (0.1,)], "score double")
    assert rows(G.graph_report(some, none)) == [(4, 0.62, 1, 2)]


def test_botnet_devices_equal_the_pairs(spark):
    t = dt.datetime(2024, 1, 1)
    links = [(f"d{i}", f"t{(i * 3 + j) % 40}", t) for i in range(12) for j in range(i)] + [("alone", f"u{j}", t) for j in range(8)]
    links = spark.createDataFrame(links, "src string, dst string, first_ts timestamp_ntz")
    pairs = G.botnets(links, "2024-01-02", 48).select("src", "targets", "score").distinct()
    assert rows(G.botnet_devices(links, "2024-01-02", 48).select("src", "targets", "score"), "src") == rows(pairs, "src")
    assert pairs.count() > 0


def test_encoding_by_cardinality(spark):
    df = spark.createDataFrame([(i, "ab"[i % 2], None if i == 0 else f"c{i % 11}", float(i)) for i in range(22)], "id int, few string, many string, y double")
    got = {r.id: r for r in M.encode(df, ["few", "many"], "y").collect()}
    assert got[1].few_encoded == 1.0 and got[0].many_encoded is None and got[1].many_encoded == pytest.approx((1 + 12) / 2)
    assert M.encode(df, ["many"]).agg(F.max("many_encoded")).first()[0] == 10.0  # no label: an index


def test_evaluation_of_missing_classes(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (2, 0), (None, 1)], "y int, p int")
    assert rows(M.confusion_matrix(df, "p", "y"), "label", "predicted") == [(0, 0, 1), (0, 1, 1), (0, 2, 0), (1, 0, 0), (1, 1, 1), (1, 2, 0), (2, 0, 1), (2, 1, 0), (2, 2, 0)]
    r = {x["class"]: x for x in M.evaluation_report(df, "p", "y").collect()}
    assert r["2"].precision == 0.0 and r["2"].support == 1 and r["accuracy"].f1 == 0.5 and r["weighted avg"].recall == pytest.approx(0.5)


@pytest.mark.parametrize(("a", "b"), [(1.0, 1.0), (0.4, 0.7), (30.0, 5.0), (2.0, 400.0), (1e6, 3e6)])
def test_beta_draws_have_the_right_moments(spark, a, b):
    from duskline.operators.limits import beta_draw

    n = 40000
    draws = spark.range(n, numPartitions=4).select("id", beta_draw(3)(F.lit(a), F.lit(b), F.xxhash64("id")).alias("x"))
    m, v, low, high, kinds = draws.agg(F.avg("x"), F.var_pop("x"), F.min("x"), F.max("x"), F.count_distinct("x")).first()
    mean, var = a / (a + b), a * b / ((a + b) ** 2 * (a + b + 1))
    assert abs(m - mean) < 5 * (var / n) ** 0.5 and abs(v / var - 1) < 0.06
    assert 0 <= low and high <= 1 and kinds > 0.99 * n


def test_beta_draws_repeat_and_pass_nulls(spark):
    from duskline.operators.limits import beta_draw

    df = spark.createDataFrame([(1, 2.0, 3.0), (2, None, 1.0), (3, 0.0, 1.0), (None, 1.0, 1.0), (5, 2.0, 3.0)], "k long, a double, b double")
    one = rows(df.coalesce(1).select("k", beta_draw()("a", "b", "k").alias("x")), "k")
    assert one == rows(df.repartition(5).select("k", beta_draw()("a", "b", "k").alias("x")), "k")
    assert [k for k, x in one if x is None] == [None, 2, 3] and one[1][1] != one[-1][1]
