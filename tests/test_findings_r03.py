"""What the review of round 3 found, each by a small case."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from duskline.operators import detect as D
from duskline.operators import enrich as E
from duskline.operators import explain as X
from duskline.operators import forensics as H
from duskline.operators import graph as G
from duskline.operators import ml as M
from duskline.operators import sequence as Q
from duskline.plans import all as plans
from duskline.plans.registry import Tables

SF = "/root/testdata/sf0.001"


def test_average_score_above_one(spark):
    df = spark.createDataFrame([(2.0, 2.0, 0.0)], "b double, s double, r double")
    assert df.select(X.average_score(*map(F.col, "bsr"))).first()[0] == pytest.approx(1.5)


def test_score_beyond_all_tiers_cools_down_longest(spark):
    t = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(i, "a", t + dt.timedelta(seconds=s), 1.1) for i, s in enumerate([0, 899, 1799])], "id int, s string, ts timestamp_ntz, score double")
    out = D.response_tier(df, "score", "s", "ts", "id").orderBy("id").collect()
    assert [(r.tier, r.in_cooldown) for r in out] == [(None, False), (None, True), (None, False)]


def test_share_of_a_sequence_is_exact(spark):
    df = spark.range(90).select("id", F.lit("s").alias("s"), F.lit("x").alias("state"))
    assert Q.compress_sequences(df, "s", ["id"], "state", 0.7, 10).count() == 63


def scans(df) -> int:
    return df._jdf.queryExecution().optimizedPlan().toString().count("parquet")


@pytest.mark.parametrize("name", ["r04_coordinated_attacks", "r05_relation_risk"])
def test_pairs_of_addresses_are_made_once(spark, name):
    assert scans(plans.QUERIES[name](spark, SF)) <= 4  # more than ten times as many with the pairs made for each use


def test_risk_of_grouped_pairs(spark):
    pairs = spark.createDataFrame([("a", "b", 0.4), ("a", "b", 0.8), ("a", "c", 1.0)], "a_ip string, b_ip string, strength double")
    attacks = spark.createDataFrame([("a", "high")], "ip string, severity string")
    requests = spark.createDataFrame([(x, "US", "R", "C") for x in "abc"], "ip string, country string, region string, city string")
    places = spark.createDataFrame([("US", "R", "C", 0.6)], "country string, region string, city string, risk double")
    got = {r.ip: r.risk for r in G.relation_risk(requests, attacks, G.address_pairs(pairs), places).collect()}
    one = {r.ip: r.risk for r in G.relation_risk(requests, attacks, pairs, places).collect()}
    assert got == pytest.approx(one) and got["a"] == pytest.approx(0.6 + 2.2 / 3 * 0.3 + 0.12)


def test_cases_of_the_same_addresses_share_their_events(spark):
    cases = spark.createDataFrame([(1, "a"), (1, "b"), (2, "b"), (2, "a"), (3, "a"), (4, "a"), (5, "c")], "case_id int, ip string")
    t = dt.datetime(2024, 1, 1)
    events = spark.createDataFrame([(i, ip, t, "h", 1.0, "auth", "psexec") for i, ip in enumerate("aabc")], "id int, ip string, ts timestamp_ntz, host string, crit double, kind string, text string")
    few, members = H.shared_cases(cases)
    assert few.count() == 4
    report = lambda e: H.incident_report(H.investigation_context(events, e, "2024-01-02"), "case_id", "ts", "id", "host", "crit", "kind", "text")
    key = lambda df: sorted(map(str, df.collect()))
    assert key(H.for_all_cases(report(few), members)) == key(report(cases))


def test_split_orders_no_whole_label(spark):
    df = spark.range(3000).select("id", F.when(F.col("id") % 7 > 0, F.col("id") % 2).alias("y"))
    got = M.stratified_split(df, "y", "id", 0.7)
    order = Window.partitionBy("y").orderBy(F.xxhash64(F.lit(42), "id"), "id")
    want = df.withColumn("is_train", F.row_number().over(order) <= F.floor(F.count(F.lit(1)).over(Window.partitionBy("y")) * F.expr("0.7bd")))
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    windows = [x for x in got._jdf.queryExecution().optimizedPlan().toString().splitlines() if "row_number" in x and "Window" in x]
    assert windows and all("_c#" in x for x in windows)
    assert "BroadcastHashJoin" in M.balanced(df, "y")._jdf.queryExecution().executedPlan().toString()


def test_components_of_chains_rings_and_stars(spark):
    chain = [(f"n{i:03}", f"n{i + 1:03}") for i in range(0, 60)]
    zigzag = [(f"z{(i * 37) % 101:03}", f"z{((i + 1) * 37) % 101:03}") for i in range(100)]
    df = spark.createDataFrame(chain + zigzag + [("s9", "s1"), ("s9", "s2"), ("a", "a"), ("p", "q"), ("q", "p")], "src string, dst string")
    got = {r.node: r.component for r in G.components(df).collect()}
    want = {x: {"n": "n000", "z": "z000", "s": "s1", "p": "p", "q": "p"}[x[0]] for e in chain + zigzag + [("s9", "s1"), ("s9", "s2"), ("p", "q")] for x in e}
    assert got == want


def test_edges_of_a_relation_analysis_are_read_once(spark):
    edges = spark.read.parquet(f"{SF}/orders.parquet").select(F.col("o_orderkey").cast("string").alias("src"), F.col("o_custkey").cast("string").alias("dst"))
    assert scans(G.relation_analysis(edges, spark.createDataFrame([("1",)], "id string"))) == 0
    assert scans(G.k_hop(edges, spark.createDataFrame([("1",)], "id string"), 1)) == 0


def test_edges_of_a_topology_are_made_once(spark):
    edges = spark.read.parquet(f"{SF}/orders.parquet").select((F.col("o_orderkey") + 100000).alias("src"), F.col("o_custkey").alias("dst"))
    assert scans(G.triangles(edges)) == 0 and scans(G.topology(edges)) == 0


def test_pairs_of_two_users_meet_in_one_task(spark):
    r = plans_requests(spark).limit(400)
    dealt = G.user_relations(E.pair_within(r, "user_id", "ts", 3000, together=50))
    plan = dealt._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 2 and plan.count("hashpartitioning(_ad") == 1  # the limit's and the rows'; none of pairs
    assert "SortAggregate" not in plan
    key = lambda df: sorted(map(str, df.collect()))
    want = key(G.user_relations(E.pair_within(r, "user_id", "ts", 3000)))
    assert len(want) > 100 and key(dealt) == want


def test_tasks_of_a_pair_join_follow_the_pairs(spark, monkeypatch):
    monkeypatch.setattr(E, "CANDIDATES", 50)
    pairs = E.pair_within(plans_requests(spark).select("user_id", "ts", "country"), "user_id", "ts", 300, "country")
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and pairs.rdd.getNumPartitions() > 8


def plans_requests(spark):
    return Tables(spark, SF).requests.select("user_id", "ts", "method", "user_agent", "path", "country", "region", "city")
