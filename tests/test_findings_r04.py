"""What the review of round 4 found, each by a small case."""

from __future__ import annotations

import datetime as dt
import itertools
import random

import pytest
from pyspark.sql import functions as F

from duskline.operators import enrich as E
from duskline.operators import graph as G
from duskline.operators import links as L

REQUEST = "request_id int, ip string, ts timestamp_ntz, path string, user_agent string, country string, region string, city string, event_type string"


def requests_of_all_kinds(spark, n=400, seed=1):
    rng = random.Random(seed)
    pick = lambda *x: rng.choice(x)
    t = dt.datetime(2024, 1, 1)
    rows = [
        (i, pick(None, *(f"10.0.0.{k}" for k in range(60))), t + dt.timedelta(microseconds=rng.randrange(6_000_000_000)), pick("/a", "/b", "/c", None),
         pick("x", "y", "z", "u", None), pick("US", "CA", "RU", None), pick("R1", "R2", None), pick("C1", "C2", None), pick("click", "view", "error", "signup", "buy", None))
        for i in range(n)
    ]
    return spark.createDataFrame(rows, REQUEST)


def linked_by_pairs(r, same_path: bool):
    a, b = (r.select(F.struct(*r.columns).alias(x)) for x in "ab")
    gap = F.abs(F.unix_micros(F.col("a.ts").cast("timestamp")) - F.unix_micros(F.col("b.ts").cast("timestamp")))
    p = a.crossJoin(b).filter((F.col("a.ip") < F.col("b.ip")) & (gap <= 300_000_000)).withColumn("gap_seconds", gap / 1e6)
    p = p.filter("a.path = b.path") if same_path else p
    return {(x.a, x.b) for x in G.relation_strength(p).select(F.col("a.ip").alias("a"), F.col("b.ip").alias("b")).distinct().collect()}


def test_requests_of_different_paths_link_addresses(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [(1, "a", t, "/p", "x", "US", "R", "C", "view"), (2, "b", t + dt.timedelta(seconds=299), "/q", "y", "CA", "R", "C", "view"), (3, "c", t, "/q", "z", "RU", "R", "C", "buy")]
    assert [tuple(r) for r in G.address_links(spark.createDataFrame(rows, REQUEST)).collect()] == [("a", "b")]


@pytest.mark.parametrize("square", [8192, 0])
@pytest.mark.parametrize("same", [(), ("path",)])
def test_links_equal_those_of_all_pairs(spark, monkeypatch, square, same):
    monkeypatch.setattr(L, "SQUARE", square)
    monkeypatch.setattr(L, "BATCH", 100)
    monkeypatch.setattr(L, "ROWS", 50)
    r = requests_of_all_kinds(spark)
    got = [(x.a_ip, x.b_ip) for x in G.address_links(r, same=same).collect()]
    want = linked_by_pairs(r, bool(same))
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 50


def test_pairs_of_requests_are_no_rows(spark):
    plan = G.address_links(requests_of_all_kinds(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan


def test_two_steps_by_blocks(spark):
    rng = random.Random(3)
    few = {(f"n{a}", f"n{b}") for a, b in itertools.combinations(range(60), 2) if rng.random() < 0.02}
    many = {(f"m{a}", f"m{b}") for a, b in itertools.combinations(range(90), 2) if rng.random() < 0.7 and a % 30}
    for edges in (few, few | many):
        both = edges | {(b, a) for a, b in edges}
        want = both | {(a, d) for a, b in both for c, d in both if b == c and a != d}
        out = L.within_two(spark.createDataFrame(sorted(both), "src string, dst string"))
        got = [tuple(r) for r in out.collect()]
        assert len(got) == len(set(got)) and set(got) == want
        assert ("FlatMapGroupsInPandas" in out._jdf.queryExecution().executedPlan().toString()) == (edges is not few)


@pytest.mark.parametrize("batch", [2_000_000, 40])
def test_users_are_related_in_arrays(spark, monkeypatch, batch):
    real = L.pairs
    monkeypatch.setattr(L, "pairs", lambda end, first=None: real(end, first, batch))
    r = requests_of_all_kinds(spark).withColumn("method", F.when(F.col("request_id") % 3 > 0, F.concat(F.lit("m"), F.col("request_id") % 2)))
    r = r.withColumn("user_id", F.when(F.col("request_id") % 7 > 0, F.xxhash64("ip") % 40)).drop("ip", "request_id", "event_type")
    made = G.related_users(r)
    assert "Join" not in made._jdf.queryExecution().executedPlan().toString()
    key = lambda df: sorted(tuple(x) for x in df.select("a", "b", "meetings", "kind", F.round("strength", 9)).collect())
    want = key(G.user_relations(E.pair_within(r, "user_id", "ts", 300)))
    assert len(want) > 100 and any(x[2] > 2 for x in want) and key(made) == want


def test_entities_that_met(spark):
    r = requests_of_all_kinds(spark)
    p = E.pair_within(r, "ip", "ts", 60, "country")
    want = {(x.a, x.b) for x in p.select(F.col("a.ip").alias("a"), F.col("b.ip").alias("b")).collect()}
    got = [tuple(x) for x in G.met_within(r, "ip", "ts", 60, "country").collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 50


@pytest.mark.parametrize("bits", [True, False])
def test_triangles_by_common_neighbours(spark, monkeypatch, bits):
    monkeypatch.setattr(G, "neighbour_bytes", lambda nodes: 0 if bits else 1e18)
    rng = random.Random(5)
    edges = {(f"n{a}", f"n{b}") for a, b in itertools.combinations(range(150), 2) if rng.random() < 0.15 and a % 3 == b % 3} | {("x", "y")}
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    through = {n: sum(b in near[a] for a, b in itertools.combinations(near[n], 2)) for n in near}
    df = spark.createDataFrame([*sorted(edges), ("x", "x"), ("y", "x")], "src string, dst string")
    found = G.triangles_through(G._checkpoint(G._single(df)))
    assert ("MapInArrow" in found._jdf.queryExecution().executedPlan().toString()) == bits
    assert {r.node: r._t for r in found.collect()} == {n: t for n, t in through.items() if t}
    assert G.triangles(df).first()[0] == sum(through.values()) // 3
    t = G.topology(df).first()
    mean = sum(2 * through[n] / (len(near[n]) * (len(near[n]) - 1)) for n in near if len(near[n]) > 1) / len(near)
    assert (t.nodes, t.edges, t.components) == (len(near), len(edges), 4) and t.clustering == pytest.approx(mean)


def test_a_forest_joins_the_same_nodes(spark, monkeypatch):
    monkeypatch.setattr(L, "BATCH", 60)
    rng = random.Random(6)
    edges = [(a, a // 50 * 50 + rng.randrange(50)) for a in [rng.randrange(300) for _ in range(3000)]]
    df = spark.createDataFrame(edges, "src long, dst long").repartition(3)
    thin = L.forest(df)
    assert thin.count() < 2000
    assert sorted(G.components(df).collect()) == sorted(G.components(thin).collect()) and G.components(df).select("component").distinct().count() == 6


def test_two_kinds_of_node_list_no_triangles(spark):
    df = spark.createDataFrame([("s1", "d1"), ("s1", "d2"), ("s2", "d1")], "src string, dst string")
    assert G.topology(df, two_kinds=True).collect() == G.topology(df).collect()
    assert G.topology(df.limit(0), two_kinds=True).collect() == G.topology(df.limit(0)).collect()


def test_strengths_of_addresses_are_added_up_in_arrays(spark, monkeypatch):
    monkeypatch.setattr(L, "ROWS", 30)
    r = requests_of_all_kinds(spark)
    p = G.relation_strength(E.pair_within(r, "ip", "ts", 300, "path")).select(F.explode(F.array("a.ip", "b.ip")).alias("ip"), "strength")
    want = {x.ip: (x.n, x.mean) for x in p.groupBy("ip").agg(F.count("*").alias("n"), F.avg("strength").alias("mean")).collect()}
    made = G.address_strengths(r)
    got = {x.ip: (x.n, x.mean) for x in made.collect()}
    assert len(want) > 50 and got.keys() == want.keys()
    assert all(got[k][0] == want[k][0] and got[k][1] == pytest.approx(want[k][1]) for k in want)
