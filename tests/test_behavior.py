"""Session anomalies and clusters on small hand-made tables and against brute force."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from duskline.operators import behavior as B
from duskline.operators import enrich as E
from duskline.operators import forensics as H
from duskline.operators import graph as G
from duskline.operators import sequence as Q
from duskline.operators import series as W

VISITS = "s string, i long, a string, c string, r double, at double"


def visits(spark, sessions):
    rows = [(s, i, a, c, r, at) for s, steps in sessions.items() for i, (a, c, r, at) in enumerate(steps)]
    return spark.createDataFrame(rows, VISITS)


def steps(path, context="normal", risk=0.1, gap=10.0):
    return [(a, context, risk, gap * i) for i, a in enumerate(path)]


def test_sequence_anomalies(spark):
    past = visits(spark, {f"p{k}": steps("abc") for k in range(10)} | {f"q{k}": steps("ab", risk=0.9) for k in range(2)} | {f"z{k}": steps("xy", risk=0.9) for k in range(6)})
    patterns = B.pattern_profiles(past, "s", ["i"], "a", "c", "r")
    matrix = Q.learn_transitions(past, "s", ["i"], "a")
    now = visits(spark, {
        "known": steps("abc"), "unknown": steps("abcab"), "odd": steps("xy"), "jump": steps("cbaxc"), "slow": steps("abcbc", gap=400.0),
        "one": steps("a"), "mixed": [("a", "normal", 0.1, 0.0), ("b", "suspicious", 0.8, 5.0)], "null": [(None, None, None, None), ("b", None, None, 1.0)],
    })
    got = {r.s: r for r in B.sequence_anomalies(now, patterns, matrix, "s", ["i"], "a", F.col("at"), "c", "r").collect()}
    assert set(got) == {"known", "unknown", "odd", "jump", "slow", "one", "mixed", "null"}
    near = lambda r, *want: all(abs(x - y) < 1e-9 for x, y in zip((r.pattern_score, r.transition_score, r.timing_score, r.covered), want))
    assert near(got["known"], 0.2, 0, 0, 1) and abs(got["known"].score - 0.08) < 1e-9 and got["known"].severity == "low"
    assert near(got["unknown"], 0.8, 0.3, 0, 1)  # c>a is no transition, both halves are known runs
    assert near(got["odd"], 0.9, 0, 0, 1)
    assert near(got["jump"], 0.8, 1.0, 0, 0) and got["jump"].type == "impossible_transition" and got["jump"].severity == "critical"
    assert got["jump"].recommendations == list(B.ADVICE["impossible_transition"])
    assert got["slow"].timing_score == 0.8 and got["slow"].type == "timing_anomaly"
    assert got["one"].score == 0.5 and got["one"].severity == "low" and got["one"].pattern_score is None and got["one"].risk_factors == []
    assert got["mixed"].type == "context_mismatch" and got["mixed"].risk_factors == ["Suspicious behavioral context", "High risk score assigned"]
    assert B.sequence_anomalies(now.limit(0), patterns, matrix, "s", ["i"], "a", F.col("at"), "c", "r").count() == 0


def test_gap_model_bounds_the_usual(spark):
    rng = random.Random(3)
    past = visits(spark, {f"p{k}": [("a", "n", 0.0, 0.0), ("b", "n", 0.0, rng.uniform(900, 1100))] for k in range(60)})
    gaps = B.gap_model(past, "s", ["i"], "a", F.col("at"))
    bounds = gaps.collect()
    assert [(r.context, r.next) for r in bounds] == [("a", "b")] and 400 < bounds[0].low < 900 and 1100 < bounds[0].high < 1800
    now = visits(spark, {"usual": [("a", "n", 0.0, 0.0), ("b", "n", 0.0, 1000.0)], "fast": [("a", "n", 0.0, 0.0), ("b", "n", 0.0, 30.0)]})
    patterns, matrix = B.pattern_profiles(past, "s", ["i"], "a", "c", "r"), Q.learn_transitions(past, "s", ["i"], "a")
    got = {r.s: r.timing_score for r in B.sequence_anomalies(now, patterns, matrix, "s", ["i"], "a", F.col("at"), "c", "r", gaps).collect()}
    assert got == {"usual": 0.0, "fast": 0.2}


def test_similar_sets_is_exact(spark):
    rng = random.Random(4)
    sets = {f"k{i}": rng.sample("abcdefghijkl", rng.randrange(0, 8)) for i in range(80)}
    sets |= {f"m{i}": sets["k3"] for i in range(3)} | {"none": None}
    df = spark.createDataFrame(list(sets.items()), "id string, items array<string>")
    for least in (0.3, 0.6, 1.0):
        got = {(r.a, r.b): r.jaccard for r in B.similar_sets(df, "id", "items", least).collect()}
        want = {}
        names = sorted(k for k, v in sets.items() if v)
        for x, a in enumerate(names):
            for b in names[x + 1 :]:
                i, u = len(set(sets[a]) & set(sets[b])), len(set(sets[a]) | set(sets[b]))
                if i / u >= least - 1e-12:
                    want[a, b] = i / u
        assert got == want


def test_clusters_follow_chains_of_similar_contexts(spark):
    rows = [
        ("a>b", 5, ["a", "b"], ["n", "s"], "high", True), ("a>c", 1, ["a", "c"], ["n", "s", "x"], "high", True), ("a>d", 2, ["a", "d"], ["s", "x", "n", "y"], "high", True),
        ("e>f", 9, ["e", "f"], ["q"], "high", True), ("g>h", 1, ["g", "h"], ["n", "s"], "critical", True), ("i>j", 7, ["i", "j"], ["n", "s"], "high", False),
        ("k>l", 1, ["k", "l"], [], "low", True),
    ]
    p = spark.createDataFrame(rows, "pattern string, count long, states array<string>, contexts array<string>, risk_level string, is_anomalous boolean")
    exact = B.anomaly_clusters(p).collect()
    assert sorted(r.patterns for r in exact) == [1] * 6
    got = {tuple(r.common_contexts): r for r in B.anomaly_clusters(p, 0.6).collect() if r.severity == "high"}
    chain = got["n", "s", "x"]
    assert (chain.patterns, chain.affected, chain.common_actions) == (3, 6, ["a"]) and abs(chain.risk_score - 0.7) < 1e-9
    assert len(B.anomaly_clusters(p, 0.6).collect()) == 4
    assert B.anomaly_clusters(p.limit(0), 0.6).count() == 0


def test_path_counts_equal_listing_them(spark):
    rng = random.Random(7)
    edges = [(f"n{rng.randrange(9)}", f"n{rng.randrange(9)}", rng.choice("xyz")) for _ in range(40)] + [("n0", "n1", "x"), ("n1", "n0", "x"), ("n0", "n0", "x"), ("p", "q", "x")]
    df = spark.createDataFrame(edges, "src string, dst string, type string")
    ends = [(i, a, b) for i, (a, b, _) in enumerate(edges) if a != b]
    beside = [(i, a, b) for i, a, b in ends] + [(i, b, a) for i, a, b in ends]

    def walk(node, used, depth):
        for i, a, b in beside:
            if a == node and i not in used:
                yield depth, b
                if depth < 3:
                    yield from walk(b, used | {i}, depth + 1)

    nodes = sorted({a for _, a, _ in beside})
    found = {n: list(walk(n, frozenset(), 1)) for n in nodes}
    got = {r.node: (r.paths1, r.paths2, r.paths3) for r in G.path_counts(df).collect()}
    assert got == {n: tuple(sum(d == k for d, _ in found[n]) for k in (1, 2, 3)) for n in nodes}
    seeds = spark.createDataFrame([(n,) for n in nodes[:4] + ["p", "zz", "p"]], "id string")
    rel = {r.seed: (r.related, r.paths) for r in G.relation_analysis(df, seeds).collect()}
    want = {n: (len({b for _, b in found.get(n, [])}), len(found.get(n, []))) for n in nodes[:4] + ["p", "zz"]}
    assert rel == want


def test_pairs_of_a_hot_block_are_whole(spark):
    rng = random.Random(8)
    rows = [(i, f"u{rng.randrange(12)}", "hot" if i % 3 == 0 else f"k{i % 7}", 1000.0 + rng.uniform(0, 900)) for i in range(300)] + [(900, None, "hot", 1000.0), (901, "u1", None, 1000.0)]
    df = spark.createDataFrame(rows, "i long, u string, k string, s double").withColumn("ts", F.timestamp_micros((F.col("s") * 1e6).cast("long")))
    for block in ("k", None):
        want = sorted((a[0], b[0]) for a in rows for b in rows if a[1] and b[1] and a[1] < b[1] and (block is None or (a[2] and a[2] == b[2])) and abs(a[3] - b[3]) <= 120)
        for most in (4096, 5):
            p = E.pair_within(df.drop("s"), "u", "ts", 120, block, most)
            assert sorted((r.x, r.y) for r in p.select(F.col("a.i").alias("x"), F.col("b.i").alias("y")).collect()) == want


def test_user_relations(spark):
    place = lambda c, r, t: (c, r, t)
    base = ("GET", "agent", "/a/b")
    rows = [("u1", 0.0, *base, *place("US", "R1", "C1")), ("u2", 20.0, *base, *place("US", "R1", "C1")), ("u3", 200.0, *base, *place("US", "R1", "C2")),
            ("u4", 130.0, "POST", "other", "/z", *place(None, None, None)), ("u5", 200.5, "GET", "agent", "/a", *place("FR", "R9", "C9"))]
    df = spark.createDataFrame(rows, "user_id string, s double, method string, user_agent string, path string, country string, region string, city string")
    df = df.withColumn("ts", F.timestamp_micros((F.col("s") * 1e6).cast("long"))).drop("s")
    got = {(r.a, r.b): (r.kind, round(r.strength, 4)) for r in G.user_relations(E.pair_within(df, "user_id", "ts", 300)).collect()}
    assert got["u1", "u2"] == ("session_sharing", round((1 - 20 / 300) * 0.6 + 0.7 * 0.4, 4))
    assert got["u1", "u3"] == ("geographic_proximity", round(0.8 * 0.8 + 0.7 * 0.2, 4))
    assert got["u1", "u4"] == ("geographic_proximity", 0.0)
    assert got["u3", "u5"][0] == "session_sharing" and got["u1", "u5"] == ("geographic_proximity", round(0.1 * 0.8 + 0.7 * 0.2, 4))


def test_trend_patterns(spark):
    flat = [("flat", i, 5.0) for i in range(20)]
    up = [("up", i, float(i)) for i in range(20)]
    step = [("step", i, 1.0 if i < 30 else 50.0 + 3 * (i - 30)) for i in range(40)]
    rows = flat + up + step + [("one", 0, 1.0)]
    df = spark.createDataFrame(rows, "k string, i long, v double").withColumn("ts", F.timestamp_seconds(F.col("i") * 60))
    got = {r.k: r for r in W.trend_patterns(df, ["k"], ["i"], "v", "ts", F.col("i") * 60.0).collect()}
    assert (got["flat"].pattern, got["flat"].share, got["flat"].stability) == ("stable_pattern", 1.0, 1.0)
    assert got["up"].pattern == "increasing_trend" and got["one"].pattern == "stable_pattern"
    # the change shows some rows before the jump; the longest part before it is flat
    assert got["step"].segments == 2 and got["step"].pattern == "stable_pattern" and 0.5 < got["step"].share < 0.9 and got["step"].change_points > 0


def test_incident_report(spark):
    rows = [(1, i, "login_failed" if i == 0 else "view", "ws-1", 1.0, "") for i in range(50)]
    rows += [(1, 50, "process_exec", "ws-1", 1.0, "powershell -enc AAA"), (1, 51, "remote_exec", "db-1", 2.0, "psexec db-1"), (1, 52, "large_upload", "db-1", 2.0, ""), (2, 0, "view", None, None, None)]
    df = spark.createDataFrame(rows, "c long, i long, kind string, host string, crit double, text string").withColumn("ts", F.timestamp_seconds(F.col("i")))
    got = {r.c: r for r in H.incident_report(df, "c", "ts", "i", "host", "crit", "kind", "text", 4).collect()}
    one, two = got[1], got[2]
    assert one.systems == ["db-1", "ws-1"] and one.techniques == ["T1059.001", "T1569.002"] and abs(one.confidence - 0.6) < 1e-9
    assert [(s.stage, s.n, s.first_seen.second) for s in one.stages] == [("initial_access", 1, 0), ("execution", 2, 50), ("lateral_movement", 1, 51), ("exfiltration", 1, 52)]
    assert [e.id for e in one.timeline] == [0, 1, 2, 3, 49, 50, 51, 52] and one.severity == "critical" and one.events == 53
    assert two.systems == [] and two.techniques == [] and two.stages is None and [e.id for e in two.timeline] == [0]
    assert H.incident_report(df.limit(0), "c", "ts", "i", "host", "crit", "kind", "text").count() == 0
