"""Entity graphs as edge tables (src, dst, type): neighbourhoods, paths, threats, topology."""

from __future__ import annotations

import re
import tempfile

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .links import PairTable, by_entities, classes, common_neighbours, forest, linked, neighbour_bytes, pair_means, within_two


def _checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage in the folder of ``spark.checkpoint.dir`` (in local mode, where it is unset, in a new one)."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def shared_folder(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.conf.get("spark.master", "")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-")
    return base.rstrip("/")


def undirected(edges: DataFrame) -> DataFrame:
    """Distinct edges in both directions, without loops."""
    both = edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return both.filter("src <> dst").distinct()


def k_hop(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """(seed, node, hops): nodes within ``depth`` hops of each seed, by frontier expansion.

    ``edges`` are stored once and met as they are: only what a frontier reaches is made distinct, not all edges.
    """
    return _expand(_checkpoint(edges.select("src", "dst")), seeds, depth)


def _expand(stored: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    links = stored.union(stored.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).filter("src <> dst")
    reached = seeds.select(F.col("id").alias("seed"), F.col("id").alias("node"), F.lit(0).alias("hops"))
    frontier = reached
    for h in range(1, depth + 1):
        step = frontier.select("seed", "node").join(links, F.col("node") == F.col("src")).select("seed", F.col("dst").alias("node")).distinct()
        frontier = step.join(reached, ["seed", "node"], "left_anti").withColumn("hops", F.lit(h))
        reached = reached.unionByName(frontier)
        if h > 1:
            reached = _checkpoint(reached)
            frontier = reached.filter(F.col("hops") == h)
    return reached


def relation_score(hops: DataFrame) -> DataFrame:
    """Per seed: neighbours and a score that saturates at 100 of them."""
    g = hops.filter("hops > 0").groupBy("seed").agg(F.count(F.lit(1)).alias("related"), F.count_if(F.col("hops") == 1).alias("direct"))
    return g.withColumn("risk", F.least(F.lit(1.0), F.col("related") / 100))


def path_counts(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(node, paths1, paths2, paths3, paths): undirected paths of one to three distinct edges from every node.

    Edges are the rows of ``edges``: parallel ones are different, loops are left out. No path is listed. With m the
    edges between two nodes and d the edges of one, a path of two edges is a first edge and one of the d - 1 others of
    its end. For three, the same count of each neighbour is shared by all nodes beside it; what went back over the first
    edge is taken off, and returns by a parallel edge go on over one of the d - 2 others of the start. All nodes
    together cost two joins of the edges; ``nodes`` (id) keeps some.
    """
    both = edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).filter("src <> dst")
    links = both.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("m"))
    degree = links.groupBy("src").agg(F.sum("m").alias("d"))
    m, d = F.col("m"), F.col("d")
    two = links.join(degree.select(F.col("src").alias("dst"), "d"), "dst").groupBy("src").agg(F.sum(m * (d - 1)).alias("two"))
    per_node = degree.join(two, "src")
    near = links if nodes is None else links.join(nodes.select(F.col("id").alias("src")), "src", "left_semi")
    near = near.join(two.select(F.col("src").alias("dst"), F.col("two").alias("_t")), "dst").join(degree, "src")
    three = near.groupBy("src").agg(F.sum(m * (F.col("_t") - m * (d - 1)) + m * (m - 1) * (d - 2)).alias("paths3"))
    out = three.join(per_node, "src").select(F.col("src").alias("node"), d.alias("paths1"), F.col("two").alias("paths2"), "paths3")
    return out.withColumn("paths", F.col("paths1") + F.col("paths2") + F.col("paths3"))


def relation_analysis(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(seed, related, paths, risk) for every seed (id): other nodes within three hops, paths to them, relation score.

    A seed is related to itself if a path comes back to it: by a parallel edge, or round a triangle. Seeds without
    edges have none. The frontiers of all seeds grow together and are deduplicated at each hop.
    """
    edges = _checkpoint(edges.select("src", "dst"))
    hops = _checkpoint(_expand(edges, seeds, 3).filter("hops > 0"))
    near = hops.filter("hops = 1").select("seed", "node")
    both = edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).filter("src <> dst")
    twice = both.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("m")).filter("m > 1").select(F.col("src").alias("seed"), F.col("dst").alias("node"))
    links = undirected(edges)
    beside = near.join(links, F.col("node") == F.col("src")).select("seed", F.col("dst").alias("node"))
    round_trip = near.join(twice, ["seed", "node"], "left_semi").select("seed").union(near.join(beside, ["seed", "node"], "left_semi").select("seed")).distinct()
    related = hops.select("seed", "node").union(round_trip.select("seed", F.col("seed").alias("node"))).groupBy("seed").agg(F.count(F.lit(1)).alias("related"))
    paths = path_counts(edges, seeds).select(F.col("node").alias("seed"), "paths")
    out = seeds.select(F.col("id").alias("seed")).distinct().join(related, "seed", "left").join(paths, "seed", "left")
    out = out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("related", "paths")})
    return out.withColumn("risk", F.least(F.lit(1.0), F.col("related") * 0.02 + F.col("paths") * 0.01))


def lateral_paths(edges: DataFrame, start: DataFrame, depth: int = 4, types=("CONNECTED_TO", "AUTHENTICATED_AS", "EXECUTED")) -> DataFrame:
    """(path array, hops): simple directed paths from the start nodes over some edge types."""
    e = edges.filter(F.col("type").isin(*types)).select("src", "dst").distinct()
    paths = start.select(F.array("id").alias("path"), F.col("id").alias("_end"))
    out = None
    for h in range(1, depth + 1):
        grown = paths.join(e, F.col("_end") == F.col("src")).filter(~F.array_contains("path", F.col("dst")))
        paths = grown.select(F.concat("path", F.array("dst")).alias("path"), F.col("dst").alias("_end"))
        found = paths.select("path", F.lit(h).alias("hops"))
        out = found if out is None else out.unionByName(found)
    return out


def shared_neighbours(edges: DataFrame, least: int = 2) -> DataFrame:
    """Targets with at least ``least`` sources, and how many."""
    g = edges.groupBy("dst").agg(F.count_distinct("src").alias("sources"))
    return g.filter(F.col("sources") >= least)


def relation_strength(pairs: DataFrame) -> DataFrame:
    """Strength of request pairs (structs a and b): agents, paths, time, place and behaviour, kept above 0.3."""
    same = lambda c: F.col(f"a.{c}") == F.col(f"b.{c}")
    geo = F.when(same("city") & same("country"), 1.0).when(same("region") & same("country"), 0.8).when(same("country"), 0.6).otherwise(0.1)
    s = (
        F.when(same("user_agent"), 0.1).otherwise(0.0) + F.when(same("path"), 0.15).otherwise(0.0)
        + 0.25 * F.greatest(F.lit(0.0), 1 - F.col("gap_seconds") / 300) + 0.2 * geo + F.when(same("event_type"), 0.3).otherwise(0.0)
    )
    return pairs.withColumn("strength", F.least(F.lit(1.0), s)).filter(F.col("strength") > 0.3)


def address_links(requests: DataFrame, seconds: int = 300, least: float = 0.3, same: tuple[str, ...] = ()) -> DataFrame:
    """(a_ip, b_ip), a_ip < b_ip: addresses with two requests within ``seconds`` that ``relation_strength`` keeps, each two once.

    ``same``: columns that the two requests must share.
    """
    def strength(equal: dict[str, bool], gap: float, near: float) -> float:  # term by term as in ``relation_strength``
        agent, path, kind = 0.1 * equal["user_agent"], 0.15 * equal["path"], 0.3 * equal["event_type"]
        return agent + path + 0.25 * max(0.0, 1 - gap / 300) + 0.2 * near + kind

    attributes = {c: (c,) for c in ("user_agent", "path", "event_type")}
    places = {1.0: ("city", "country"), 0.8: ("region", "country"), 0.6: ("country",), 0.1: ()}
    return linked(requests, "ip", "ts", seconds, strength, attributes, places, least, same).toDF("a_ip", "b_ip")


def address_strengths(requests: DataFrame, seconds: int = 300, least: float = 0.3) -> DataFrame:
    """(ip, n, mean): how many request pairs of one path relate an address to others, and their mean strength; stored."""

    def prepare(rows: pd.DataFrame):
        agent, kind, country, region, city = (pd.factorize(rows[c])[0] for c in ("user_agent", "event_type", "country", "region", "city"))
        same = lambda x, i, j: (x[i] >= 0) & (x[i] == x[j])

        def place(i, j):
            land = same(country, i, j)
            return np.where(land & same(city, i, j), 1.0, np.where(land & same(region, i, j), 0.8, np.where(land, 0.6, 0.1)))

        near = PairTable(*classes(rows["country"], rows["region"], rows["city"]), place)

        def value(i, j, gap):  # term by term as in ``relation_strength``
            s = 0.1 * same(agent, i, j) + 0.15 + 0.25 * np.maximum(0.0, 1 - gap / 1e6 / 300) + 0.2 * near(i, j) + 0.3 * same(kind, i, j)
            return np.where(s > least, np.minimum(1.0, s), np.nan)

        return value

    r = requests.select("ip", "ts", "path", "user_agent", "country", "region", "city", "event_type")
    return _checkpoint(pair_means(r, "ip", "ts", seconds, "path", prepare))


def geo_proximity(a: Column, b: Column) -> Column:
    """Nearness of two places (structs of country, region, city): 1 same city, .8 region, .6 country, .1 none; 0 if unknown."""
    same = lambda c: a[c] == b[c]
    near = F.when(same("country") & same("region") & same("city"), 1.0).when(same("country") & same("region"), 0.8).when(same("country"), 0.6)
    return F.when(a["country"].isNull() | b["country"].isNull(), 0.0).otherwise(F.coalesce(near, F.lit(0.1)))


def behavior_similarity(a: Column, b: Column, gap: Column | None = None) -> Column:
    """.2 for the same method, .3 for the same agent, .3 within a second or .1 within ten, .2 if one path holds the other."""
    when = lambda c, v: F.when(c, v).otherwise(0.0)
    if gap is None:
        gap = F.abs(F.unix_micros(a["ts"].cast("timestamp")) - F.unix_micros(b["ts"].cast("timestamp"))) / 1e6
    near = F.when(gap < 1, 0.3).when(gap < 10, 0.1).otherwise(0.0)
    holds = a["path"].contains(b["path"]) | b["path"].contains(a["path"])
    return F.least(F.lit(1.0), when(a["method"] == b["method"], 0.2) + when(a["user_agent"] == b["user_agent"], 0.3) + near + when(holds, 0.2))


def user_relations(pairs: DataFrame) -> DataFrame:
    """(a, b, meetings, kind, strength): how the users of request pairs (structs a and b) are related, by their strongest pair.

    A pair within a minute shares a session (time .6, behaviour .4); else behaviour over .7 (.7, place .3), else place
    (.8, behaviour .2). Equal strengths take the first kind by name.
    """
    a, b = F.col("a"), F.col("b")
    deal = [c for c in pairs.columns if c == "_deal"]  # pairs that are dealt by their users are grouped where they are
    time, like, place = F.greatest(F.lit(0.0), 1 - F.col("gap_seconds") / 300), behavior_similarity(a, b, F.col("gap_seconds")), geo_proximity(a, b)
    rows = pairs.select(*deal, a["user_id"].alias("a"), b["user_id"].alias("b"), time.alias("time"), like.alias("like"), place.alias("place"))
    time, like, place = map(F.col, ("time", "like", "place"))
    # a number for each kind, in the order of their names: numbers are updated in place, while a struct would have all pairs sorted
    strengths = {
        "behavior_similarity": F.when((time <= 0.8) & (like > 0.7), like * 0.7 + place * 0.3),
        "geographic_proximity": F.when((time <= 0.8) & (like <= 0.7), place * 0.8 + like * 0.2),
        "session_sharing": F.when(time > 0.8, time * 0.6 + like * 0.4),
    }
    most = F.greatest(*strengths)
    kind = F.coalesce(*[F.when(F.col(k) == most, F.lit(k)) for k in strengths])
    grouped = rows.groupBy(*deal, "a", "b").agg(F.count(F.lit(1)).alias("meetings"), *[F.max(s).alias(k) for k, s in strengths.items()])
    return grouped.select("a", "b", "meetings", kind.alias("kind"), most.alias("strength"))


# The kinds of user relation by name, and nearness of places.
KINDS = ("behavior_similarity", "geographic_proximity", "session_sharing")
NEARNESS = (0.0, 0.1, 0.6, 0.8, 1.0)


def related_users(requests: DataFrame, seconds: int = 300) -> DataFrame:
    """``user_relations`` of the requests of different users within ``seconds``, pairs being made and grouped in arrays.

    All but the time is the same for all pairs of two kinds of request: behaviour and place are looked up in tables.
    """
    like = np.array([min(1.0, (x & 1) * 0.2 + (x >> 1 & 1) * 0.3 + (0.0, 0.1, 0.3)[x >> 3] + (x >> 2 & 1) * 0.2) for x in range(24)])
    place = np.array(NEARNESS)[:, None]
    early = np.where(like > 0.7, like * 0.7 + place * 0.3, place * 0.8 + like * 0.2).ravel()
    early_kind = np.broadcast_to(np.where(like > 0.7, 0, 1), (5, 24)).ravel().astype(np.int8)

    def prepare(rows: pd.DataFrame):
        method, agent, path, country, region, city = (pd.factorize(rows[c])[0] for c in ("method", "user_agent", "path", "country", "region", "city"))
        paths = rows["path"].to_numpy()

        def holds(i, j):
            code = path[i] * (path.max() + 1) + path[j]
            known = (path[i] >= 0) & (path[j] >= 0)
            met, first, at = np.unique(np.where(known, code, -1), return_index=True, return_inverse=True)
            return np.array([c >= 0 and (paths[j[f]] in paths[i[f]] or paths[i[f]] in paths[j[f]]) for c, f in zip(met, first)], bool)[at]

        def acts(i, j):
            return ((method[i] >= 0) & (method[i] == method[j])) + 4 * holds(i, j).astype(np.uint8)

        def where(i, j):
            land, part, town = ((x[i] >= 0) & (x[i] == x[j]) for x in (country, region, city))
            near = np.where(land & part & town, 4, np.where(land & part, 3, np.where(land, 2, 1)))
            near[(country[i] < 0) | (country[j] < 0)] = 0
            return (2 * ((agent[i] >= 0) & (agent[i] == agent[j])) + 24 * near).astype(np.uint8)

        acts_of, where_of = PairTable(*classes(rows["method"], rows["path"]), acts), PairTable(*classes(*(rows[c] for c in ("user_agent", "country", "region", "city"))), where)

        def make(i, j, gap):
            seen = acts_of(i, j) + where_of(i, j) + np.uint8(8) * ((gap < 10_000_000).view(np.uint8) + (gap < 1_000_000))
            time = np.maximum(0.0, 1 - gap / 1e6 / 300)
            value, kind = early[seen], early_kind[seen]
            soon = np.flatnonzero(time > 0.8)
            value[soon], kind[soon] = time[soon] * 0.6 + like[seen[soon] % 24] * 0.4, 2
            return [np.ones(len(i), np.int64), kind, value]

        def group(start, columns):
            n, kind, value = columns
            most = np.maximum.reduceat(value, start)
            least = np.minimum.reduceat(np.where(value == np.repeat(most, np.diff(np.r_[start, len(value)])), kind, 9), start)
            return [np.add.reduceat(n, start), least.astype(np.int8), most]

        return make, group

    made = by_entities(requests, "user_id", "ts", seconds, prepare, "meetings bigint, kind tinyint, strength double")
    kind = F.when(F.col("kind") == 0, KINDS[0]).when(F.col("kind") == 1, KINDS[1]).otherwise(KINDS[2])
    return made.withColumn("kind", kind)


def met_within(df: DataFrame, entity: str, ts: str, seconds: int, block: str | None = None) -> DataFrame:
    """(src, dst), src < dst: entities with two rows within ``seconds`` under an equal ``block``, each two once."""
    nothing = lambda rows: (lambda i, j, gap: [], lambda start, columns: [])
    return by_entities(df, entity, ts, seconds, nothing, "", block).toDF("src", "dst")


def geo_clusters(df: DataFrame) -> DataFrame:
    g = df.groupBy("country", "region", "city").agg(F.count(F.lit(1)).alias("requests"), F.count_distinct("ip").alias("ips"), F.avg("risk_score").alias("risk"))
    return g.withColumn("threat", F.when(F.col("risk") > 0.7, "high").when(F.col("risk") > 0.4, "medium").otherwise("low"))


def build_graph(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of users, sessions, addresses and resources with first and last sight."""
    spec = [("User", F.col("user_id").cast("string")), ("Session", F.col("session_id")), ("IP", F.col("ip")), ("Resource", F.col("path"))]
    rows = requests.select(F.explode(F.array(*[F.struct(F.lit(n).alias("label"), c.alias("id")) for n, c in spec])).alias("n"), "ts")
    nodes = rows.groupBy("n.label", "n.id").agg(F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))
    links = [("USED", "user_id", "session_id"), ("CONNECTED_TO", "session_id", "ip"), ("ACCESSED", "session_id", "path")]
    arr = F.array(*[F.struct(F.col(a).cast("string").alias("src"), F.col(b).cast("string").alias("dst"), F.lit(n).alias("type")) for n, a, b in links])
    return nodes, requests.select(F.explode(arr).alias("e")).select("e.*").distinct()


def credential_stuffing(requests: DataFrame) -> DataFrame:
    """Users with over 3 sessions from over 1 address and failed ones; score by ratio."""
    g = requests.groupBy("user_id").agg(
        F.count_distinct("session_id").alias("sessions"), F.count_distinct("ip").alias("ips"), F.count_distinct("country").alias("places"),
        F.count_distinct(F.when(F.col("status_code") == 401, F.col("session_id"))).alias("failed"),
    ).filter((F.col("sessions") > 3) & (F.col("failed") > 0))
    r = F.col("sessions") / F.col("ips")
    s = F.when((r > 5) & (F.col("failed") > 5), 0.9).when((r > 3) & (F.col("failed") > 3), 0.7).when((r > 2) & (F.col("failed") > 1), 0.5).otherwise(0.3)
    return g.withColumn("ratio", r).withColumn("score", s)


def botnets(links: DataFrame, as_of: str, hours: int, least: int = 5) -> DataFrame:
    """(src, other, shared, targets, score): new devices with over ``least`` targets, and new devices that share one.

    ``links`` has (src, dst, first_ts). A device is new if first seen within ``hours`` before ``as_of``; only new
    devices meet in the self-join, so its size depends on them, not on how common a target is among the old ones.
    """
    end = F.lit(as_of).cast(links.schema["first_ts"].dataType)
    first = links.groupBy("src").agg(F.min("first_ts").alias("_f")).filter((F.col("_f") > end - F.expr(f"INTERVAL {hours} HOUR")) & (F.col("_f") <= end))
    d = links.join(first, "src", "left_semi").select("src", "dst").distinct()
    many = d.groupBy("src").agg(F.count(F.lit(1)).alias("targets")).filter(F.col("targets") > least)
    other = d.select(F.col("src").alias("other"), F.col("dst").alias("_d"))
    pairs = d.join(many, "src").join(other, (F.col("dst") == F.col("_d")) & (F.col("src") != F.col("other")))
    n = F.col("targets")
    return pairs.groupBy("src", "other", "targets").agg(F.count(F.lit(1)).alias("shared")).withColumn(
        "score", F.when(n > 20, 0.9).when(n > 10, 0.7).when(n > 5, 0.5).otherwise(0.3)
    )


def botnet_devices(links: DataFrame, as_of: str, hours: int, least: int = 5) -> DataFrame:
    """(src, targets, shared_targets, score): the devices of ``botnets``, each once, without meeting any in pairs.

    A target is shared if two new devices or more have it; who shares it is a group-by away, linear in the links.
    """
    end = F.lit(as_of).cast(links.schema["first_ts"].dataType)
    first = links.groupBy("src").agg(F.min("first_ts").alias("_f")).filter((F.col("_f") > end - F.expr(f"INTERVAL {hours} HOUR")) & (F.col("_f") <= end))
    d = links.join(first, "src", "left_semi").select("src", "dst").distinct()
    met = d.groupBy("dst").agg(F.count(F.lit(1)).alias("_k")).filter("_k > 1")
    g = d.join(met, "dst", "left").groupBy("src").agg(F.count(F.lit(1)).alias("targets"), F.count("_k").alias("shared_targets"))
    n = F.col("targets")
    return g.filter((n > least) & (F.col("shared_targets") > 0)).withColumn("score", F.when(n > 20, 0.9).when(n > 10, 0.7).when(n > 5, 0.5).otherwise(0.3))


def topology(edges: DataFrame, once: bool = False, two_kinds: bool = False) -> DataFrame:
    """One row: nodes, edges, greatest degree, density, mean clustering and components of the undirected graph.

    The distinct edges are stored, so what made them runs once. ``once``: each edge is there once, with src < dst.
    ``two_kinds``: no edge links two nodes of one kind, so there is no triangle and the clustering is 0.
    """
    edges = _checkpoint(edges.select("src", "dst") if once else _single(edges))
    deg = both_ways(edges).groupBy("src").agg(F.count(F.lit(1)).alias("d"))
    out = deg.agg(F.count(F.lit(1)).alias("nodes"), (F.sum("d") / 2).cast("long").alias("edges"), F.max("d").alias("max_degree"))
    out = out.withColumn("density", F.coalesce(F.try_divide(2.0 * F.col("edges"), F.col("nodes") * (F.col("nodes") - 1)), F.lit(0.0)))
    parts = components(edges).agg(F.count_distinct("component").alias("components"))
    if two_kinds:
        mean = parts.select(F.when(F.col("components") > 0, 0.0).alias("clustering"))
    else:
        mean = clustering(edges, once=True).agg(F.avg("clustering").alias("clustering"))
    return out.crossJoin(F.broadcast(mean)).crossJoin(F.broadcast(parts))  # one row each


def _single(edges: DataFrame) -> DataFrame:
    """Distinct edges without loops, once each: (src, dst) with src < dst."""
    return edges.filter("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def degree_centrality(edges: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` nodes of greatest degree, with it over the number of other nodes."""
    deg = undirected(edges).groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("degree"))
    n = deg.agg((F.count(F.lit(1)) - 1).alias("_n"))
    out = deg.crossJoin(F.broadcast(n)).withColumn("centrality", F.try_divide("degree", "_n")).drop("_n")  # one row
    return out.orderBy(F.desc("degree"), "node").limit(k)


def clustering(edges: DataFrame, once: bool = False) -> DataFrame:
    """(node, clustering): triangles through a node over the pairs of its neighbours; 0 below two neighbours."""
    edges = edges if once else _checkpoint(_single(edges))
    deg = both_ways(edges).groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("_d"))
    share = F.coalesce(F.try_divide(2.0 * F.coalesce("_t", F.lit(0)), F.col("_d") * (F.col("_d") - 1)), F.lit(0.0))
    return deg.join(triangles_through(edges), "node", "left").select("node", share.alias("clustering"))


def triangles_through(edges: DataFrame) -> DataFrame:
    """(node, _t): triangles through each node that has any; ``edges`` are there once each.

    Paths of two edges are listed and closed by a join where they take less than the neighbours of all nodes as bits,
    sent to the blocks; else blocks of nodes meet and count the common neighbours of each edge.
    """
    degree = both_ways(edges).groupBy("src").agg(F.count(F.lit(1)).alias("_d"))
    d = F.col("_d").cast("double")
    nodes, squares = degree.agg(F.count(F.lit(1)), F.coalesce(F.sum(d * d), F.lit(0.0))).first()
    if 24 * squares / 6 <= neighbour_bytes(nodes):
        listed = triangle_list(edges).select(F.explode(F.array("a", "x", "y")).alias("node"))
        return listed.groupBy("node").agg(F.count(F.lit(1)).alias("_t"))
    return common_neighbours(edges, nodes)


def triangle_list(edges: DataFrame) -> DataFrame:
    """(a, x, y): every triangle once; edges are turned from lower to higher degree first, which bounds the join."""
    u = undirected(edges)
    deg = u.groupBy("src").agg(F.count(F.lit(1)).alias("d"))
    e = u.join(deg.select("src", F.col("d").alias("da")), "src").join(deg.select(F.col("src").alias("dst"), F.col("d").alias("db")), "dst")
    e = e.filter("da < db or (da = db and src < dst)").select("src", "dst")
    f = e.toDF("s2", "d2")
    two = e.join(f, F.col("src") == F.col("s2")).filter("dst < d2").select(F.col("src").alias("a"), F.col("dst").alias("x"), F.col("d2").alias("y"))
    closing = e.select(F.least("src", "dst").alias("x"), F.greatest("src", "dst").alias("y"))
    return two.join(closing, ["x", "y"])


def triangles(edges: DataFrame, once: bool = False) -> DataFrame:
    """Number of triangles; the distinct edges are stored, so what made them runs once (``once`` as in ``topology``)."""
    through = triangles_through(_checkpoint(edges.select("src", "dst") if once else _single(edges)))
    return through.agg((F.coalesce(F.sum("_t"), F.lit(0)) / 3).cast("long").alias("triangles"))


def components(edges: DataFrame) -> DataFrame:
    """(node, component): smallest node reachable, by contraction.

    Each node points to the least of itself and its neighbours; pointer jumping makes that the least node of its tree.
    Then the trees are the nodes and what links two of them the edges, until no edge is left. Edges are read three times
    a round, and soon there are few. First each task leaves of its edges only what joins the same nodes (``forest``).
    """
    thin = forest(edges)
    links = _checkpoint(undirected(thin))
    labels = None
    while True:
        hook = links.groupBy(F.col("src").alias("node")).agg(F.min(F.least("src", "dst")).alias("component"))
        hook = _checkpoint(hook)
        while True:
            up = hook.select(F.col("node").alias("component"), F.col("component").alias("_j"))
            jumped = _checkpoint(hook.join(up, "component").select("node", F.col("_j").alias("component"), (F.col("_j") < F.col("component")).alias("_moved")))
            hook = jumped.drop("_moved")
            if jumped.filter("_moved").isEmpty():
                break
        if labels is None:
            labels = hook
        else:
            root = hook.select(F.col("node").alias("component"), F.col("component").alias("_r"))
            labels = _checkpoint(labels.join(root, "component", "left").select("node", F.coalesce("_r", "component").alias("component")))
        a = hook.select(F.col("node").alias("src"), F.col("component").alias("_a"))
        b = hook.select(F.col("node").alias("dst"), F.col("component").alias("_b"))
        cross = links.join(a, "src").join(b, "dst").filter("_a <> _b")
        links = _checkpoint(cross.select(F.col("_a").alias("src"), F.col("_b").alias("dst")).distinct())
        if links.isEmpty():
            return labels


# The columns and kinds of node that make the features, in their order.
GNN_NUMBERS = ("risk_score", "score", "failed_logins", "action_count")
GNN_FLAGS = ("proxy", "vpn", "tor")
GNN_KINDS = ("Threat", "User", "Session", "IP", "Device", "Resource")


def gnn_export(nodes: DataFrame, edges: DataFrame, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(nodes with index, 13 features, label and split, edges by index).

    ``nodes`` has (id, label) and any of the number and flag columns, missing ones being 0. The dense index follows
    buckets of a hash of the id, then the id, so no task orders all nodes. The label numbers the kinds by name. The
    split is about 70 : 15 : 15 by hash.
    """
    def number(name: str) -> Column:
        return F.coalesce(F.col(name).cast("double"), F.lit(0.0)) if name in nodes.columns else F.lit(0.0)

    features = F.array(*map(number, GNN_NUMBERS + GNN_FLAGS), *[(F.col("label") == k).cast("double") for k in GNN_KINDS])
    kinds = nodes.select("label").distinct().withColumn("label_index", F.row_number().over(Window.orderBy("label")) - 1)  # one row a kind
    b = nodes.withColumn("features", features).join(kinds, "label").withColumn("_b", F.substring(F.md5("id"), 1, 2))
    sizes = b.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))  # 256 rows
    start = sizes.withColumn("_s", F.coalesce(F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    w = Window.partitionBy("_b").orderBy("id", "label")
    idx = b.withColumn("_r", F.row_number().over(w) - 1).join(F.broadcast(start), "_b").withColumn("index", F.col("_s") + F.col("_r"))
    h = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), "id")), 1, 8), 16, 10).cast("long") % 100
    out = idx.select("id", "label", "index", "features", "label_index", F.when(h < 70, "train").when(h < 85, "val").otherwise("test").alias("split"))
    i = out.select(F.col("id").alias("src"), F.col("index").alias("src_index"))
    j = out.select(F.col("id").alias("dst"), F.col("index").alias("dst_index"))
    return out, edges.join(i, "src").join(j, "dst").select("src_index", "dst_index")


def coordinated_attacks(edges: DataFrame, requests: DataFrame, least: int = 3, busy: int = 100, wide: int = 50) -> DataFrame:
    """Addresses with at least ``least`` others within two hops that show an attack pattern together.

    ``edges`` link addresses. ddos: over 5 related ones; brute_force: over ``busy`` requests from them; scanning: over
    ``wide`` distinct paths among these. (ip, related, requests, paths, patterns, severity, confidence) Links and related
    addresses are stored, so what made the edges runs once.
    """
    links = _checkpoint(undirected(edges))
    related = _checkpoint(within_two(links))
    seen = requests.groupBy(F.col("ip").alias("dst"), "path").agg(F.count(F.lit(1)).alias("_n"))
    g = related.groupBy("src").agg(F.count(F.lit(1)).alias("related")).filter(F.col("related") >= least)
    acts = related.join(seen, "dst").groupBy("src").agg(F.sum("_n").alias("requests"), F.count_distinct("path").alias("paths"))
    out = g.join(acts, "src", "left").select(F.col("src").alias("ip"), "related", F.coalesce("requests", F.lit(0)).alias("requests"), F.coalesce("paths", F.lit(0)).alias("paths"))
    tests = {"ddos": F.col("related") > 5, "brute_force": F.col("requests") > busy, "port_scanning": F.col("paths") > wide}
    out = out.withColumn("patterns", F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in tests.items()]))).filter(F.size("patterns") > 0)
    severity = F.when(tests["ddos"], "critical").when(tests["brute_force"], "high").otherwise("medium")
    sure = F.least(F.lit(1.0), F.least(F.col("related") / 10, F.lit(0.4)) + F.size("patterns") * 0.2)
    return out.withColumn("severity", severity).withColumn("confidence", sure)


def address_pairs(pairs: DataFrame) -> DataFrame:
    """(a_ip, b_ip, n, strength): how often two addresses are related, and the mean strength; stored, a row per two addresses."""
    return _checkpoint(pairs.groupBy("a_ip", "b_ip").agg(F.count(F.lit(1)).alias("n"), F.avg("strength").alias("strength")))


def relation_risk(requests: DataFrame, attacks: DataFrame, pairs: DataFrame, clusters: DataFrame) -> DataFrame:
    """(ip, risk): by severity of its coordinated attack, mean strength of its relations, and threat of its place.

    ``attacks`` is as ``coordinated_attacks`` gives it, ``pairs`` has (a_ip, b_ip, strength) or, as ``address_pairs``
    gives them, their means and numbers (n), or are by address (``address_strengths``); ``clusters`` is as ``geo_clusters`` gives it; only places with a risk above
    0.5 count.
    """
    base = F.when(F.col("severity") == "critical", 0.8).when(F.col("severity") == "high", 0.6).when(F.col("severity") == "medium", 0.4).otherwise(0.2)
    a = attacks.select("ip", base.alias("_a"))
    if "mean" in pairs.columns:
        s = pairs.select("ip", (F.col("mean") * 0.3).alias("_s"))
    else:
        n = F.col("n") if "n" in pairs.columns else F.lit(1)
        both = pairs.select(F.explode(F.array("a_ip", "b_ip")).alias("ip"), "strength", n.alias("n"))
        s = both.groupBy("ip").agg((F.sum(F.col("strength") * F.col("n")) / F.sum("n") * 0.3).alias("_s"))
    hot = clusters.filter("risk > 0.5").select("country", "region", "city", F.col("risk").alias("_r"))
    at = requests.select("ip", "country", "region", "city").distinct()
    c = at.join(hot, ["country", "region", "city"]).groupBy("ip").agg((F.max("_r") * 0.2).alias("_c"))
    out = at.select("ip").distinct().join(a, "ip", "left").join(s, "ip", "left").join(c, "ip", "left")
    return out.select("ip", F.least(F.lit(1.0), sum((F.coalesce(x, F.lit(0.0)) for x in ("_a", "_s", "_c")), F.lit(0.0))).alias("risk"))


def kill_chain_subgraph(edges: DataFrame, seeds: DataFrame, hours: int, as_of: str, depth: int = 5, limit: int = 100, ts: str = "last_ts") -> DataFrame:
    """(seed, node, hops): the nearest ``limit`` nodes within 1 to 5 hops over edges of the window (or without a time)."""
    start = F.lit(as_of).cast(edges.schema[ts].dataType) - F.expr(f"INTERVAL {hours} HOUR")
    late = edges.filter(F.col(ts).isNull() | (F.col(ts) >= start))
    return k_hop(late, seeds, max(1, min(depth, 5))).filter("hops > 0").orderBy("hops", "seed", "node").limit(limit)


def admin_lateral(edges: DataFrame, resources: DataFrame) -> DataFrame:
    """Users that access administrative and other resources: (user, admin_resources, resources, score).

    ``edges`` has (src user, dst path), ``resources`` (path, type).
    """
    seen = edges.select("src", "dst").distinct().join(resources, F.col("dst") == F.col("path"))
    admin = F.count_if(F.col("type") == "admin")
    g = seen.groupBy(F.col("src").alias("user")).agg(admin.alias("admin_resources"), F.count(F.lit(1)).alias("resources"))
    n = F.col("admin_resources")
    g = g.filter((n > 0) & (F.col("resources") > n))
    return g.withColumn("score", F.when(n > 5, 0.9).when(n > 3, 0.7).when(n > 1, 0.5).otherwise(0.2))


def ioc_neighbors(edges: DataFrame, iocs: DataFrame) -> DataFrame:
    """(ioc, neighbor, type): what the indicators are linked with, in either direction."""
    back = edges.select(F.col("dst").alias("ioc"), F.col("src").alias("neighbor"), "type")
    both = edges.select(F.col("src").alias("ioc"), F.col("dst").alias("neighbor"), "type").unionByName(back)
    return both.join(iocs.select("ioc").distinct(), "ioc", "left_semi").distinct()


def update_threat_graph(nodes: DataFrame, edges: DataFrame, iocs: DataFrame, relations: DataFrame, actors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The graph with the indicators, relations and actors of new cases; what is there already is replaced by key.

    ``nodes`` (id, type, score), ``edges`` (src, dst, type, confidence), ``iocs`` (case_id, ioc, score), ``relations``
    (src, dst, type, confidence), ``actors`` (case_id, actor, confidence): an actor is linked to its case's indicators.
    """
    fresh = iocs.select(F.col("ioc").alias("id"), F.lit("ioc").alias("type"), "score").unionByName(
        actors.select(F.col("actor").alias("id"), F.lit("threat_actor").alias("type"), F.col("confidence").alias("score"))
    )
    by_id = fresh.groupBy("id", "type").agg(F.max("score").alias("score"))
    blame = actors.join(iocs, "case_id").select(F.col("actor").alias("src"), F.col("ioc").alias("dst"), F.lit("attributed_to").alias("type"), "confidence")
    by_ends = relations.unionByName(blame).groupBy("src", "dst", "type").agg(F.max("confidence").alias("confidence"))
    return (
        nodes.join(by_id, ["id", "type"], "left_anti").unionByName(by_id),
        edges.join(by_ends, ["src", "dst", "type"], "left_anti").unionByName(by_ends),
    )


def ip_graph(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """(seed, node, hops) of all nodes but the seed around each seed (id), the depth clamped to 1..5."""
    return k_hop(edges, seeds, max(1, min(5, depth))).filter("hops > 0")


def graph_report(*threats: DataFrame, score: str = "score") -> DataFrame:
    """One row over tables of threats: total, mean (2 digits, 0 if none), critical (.85 and more), high (.7 to .85)."""
    rows = None
    for t in threats:
        part = t.select(F.col(score).cast("double").alias("s"))
        rows = part if rows is None else rows.unionByName(part)
    s = F.col("s")
    mean = F.coalesce(F.round(F.avg(s), 2), F.lit(0.0))
    return rows.agg(F.count(F.lit(1)).alias("threats"), mean.alias("mean"), F.count_if(s >= 0.85).alias("critical"), F.count_if((s >= 0.7) & (s < 0.85)).alias("high"))
