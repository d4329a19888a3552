"""Nearest neighbours by hierarchical navigable small-world graphs, one per shard.

Vectors are dealt to shards of about ``shard_rows`` by hash of the id. A shard grows
with the table up to what a task can hold, so that a query descends few graphs. Each shard
is one row of the index table: ids, vectors, and for every level of the graph its
nodes and a flat array of neighbours (``width`` per node, -1 for none).
Levels are drawn from the id's hash; each level is built from the top down,
nodes going in by batches: a beam search from the level above finds candidates,
nodes of the same batch are compared directly, the diversity rule of HNSW picks
the neighbours, and back links are cut by the same rule.

A query descends every shard's graph and searches its lowest level with a beam
of ``beam``; shard results are merged, with Euclidean distances in double
precision from the original vectors, ties to the smaller id. Queries meet
shards in blocks, so a task holds one shard and one block of queries.

Graphs are over 32-bit vectors: those of a shard are centred and scaled to its own
size first, so neither an offset nor very small or large components cost
precision, and distances are taken from differences. Vectors that are equal in 32
bits are one node with the list of its members; members are told apart by exact
distances (of members equal in 64 bits only the k smallest ids are read). A query
that lies farther from a shard than ``FAR`` times its size, or for which the graph
leaves fewer than k candidates though the shard has more, is compared with the
whole shard, so every query gets its k rows.

Vectors that are null, zero, or hold null or non-finite components take no part;
vectors of different length never meet. A query's own row is no candidate.
Repeated ids and vectors are separate candidates (not for a query of that id).
Empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, mix64
from .lattice import valid

INDEX = "dim int, shard int, ids binary, vectors binary, node binary, levels array<struct<nodes:binary,links:binary>>"
#: Bytes of the vectors of a shard, and how far outside a shard its graph still tells its vectors apart.
SHARD_BYTES, FAR = 1 << 27, 1e5


class Level:
    """One layer: the nodes in it (rows of the shard) and their flat neighbour array."""

    def __init__(self, nodes: np.ndarray, width: int, links: np.ndarray | None = None):
        self.nodes = nodes
        self.width = width
        self.links = np.full((len(nodes), width), -1, np.int32) if links is None else links.reshape(len(nodes), width)


def beam_search(x: np.ndarray, level: Level, q: np.ndarray, entry: np.ndarray, beam: int, at_once: int = 4):
    """For each query the ``beam`` nearest nodes found: (distances squared, places in the level), sorted."""
    n, b = len(level.nodes), len(q)
    vec = x[level.nodes]
    beam = min(beam, n)
    best_d = np.full((b, beam), np.inf, np.float32)
    best_i = np.full((b, beam), -1, np.int64)
    done = np.ones((b, beam), bool)
    best_d[:, 0] = ((vec[entry] - q) ** 2).sum(axis=1)
    best_i[:, 0] = entry
    done[:, 0] = False
    seen = np.zeros((b, n + 1), bool)  # the last column stands for no node
    seen[np.arange(b), entry] = True
    seen[:, n] = True
    active = np.arange(b)
    while len(active):
        open_d = np.where(done[active], np.inf, best_d[active])
        take = min(at_once, beam)
        pick = np.argpartition(open_d, take - 1, axis=1)[:, :take] if take < beam else np.tile(np.arange(beam), (len(active), 1))
        can = np.isfinite(np.take_along_axis(open_d, pick, axis=1))
        more = can.any(axis=1)
        active, pick, can = active[more], pick[more], can[more]
        if not len(active):
            break
        places = np.take_along_axis(best_i[active], pick, axis=1)
        done[active[:, None], pick] = True
        near = np.where(can[:, :, None], level.links[np.where(can, places, 0)], -1).reshape(len(active), -1).astype(np.int64)
        near[near < 0] = n
        near.sort(axis=1)
        twice = np.zeros(near.shape, bool)
        twice[:, 1:] = near[:, 1:] == near[:, :-1]
        fresh = ~seen[active[:, None], near] & ~twice
        seen[active[:, None], near] = True
        r, c = np.nonzero(fresh)
        d = np.full(near.shape, np.inf, np.float32)
        v = near[r, c]
        gap = vec[v] - q[active][r]
        d[r, c] = np.einsum("ij,ij->i", gap, gap)
        all_d = np.concatenate((best_d[active], d), axis=1)
        all_i = np.concatenate((best_i[active], near), axis=1)
        all_done = np.concatenate((done[active], np.zeros(d.shape, bool)), axis=1)
        keep = np.argpartition(all_d, beam - 1, axis=1)[:, :beam]
        best_d[active] = np.take_along_axis(all_d, keep, axis=1)
        best_i[active] = np.take_along_axis(all_i, keep, axis=1)
        done[active] = np.take_along_axis(all_done, keep, axis=1) | ~np.isfinite(best_d[active])
    best_i[~np.isfinite(best_d)] = -1  # places that stand for no node
    order = np.argsort(best_d, axis=1, kind="stable")
    return np.take_along_axis(best_d, order, axis=1), np.take_along_axis(best_i, order, axis=1)


def diverse(vec: np.ndarray, d: np.ndarray, i: np.ndarray, most: int) -> np.ndarray:
    """From sorted candidates (rows; -1 for none) take those nearer to the node than to any taken one, then the nearest rest."""
    b, n = i.shape
    v = vec[np.where(i < 0, 0, i)]
    sq = (v**2).sum(axis=2)
    between = sq[:, :, None] + sq[:, None, :] - 2 * np.matmul(v, v.transpose(0, 2, 1))
    nearest = np.full((b, n), np.inf, np.float32)
    taken = np.zeros((b, n), bool)
    count = np.zeros(b, np.int64)
    for k in range(n):
        ok = (i[:, k] >= 0) & np.isfinite(d[:, k]) & (count < most) & (nearest[:, k] > d[:, k])
        taken[:, k] = ok
        count += ok
        nearest[ok] = np.minimum(nearest[ok], between[ok, k])
    rank = np.where(taken, 0, 1) * (n + 1) + np.arange(n)
    rank[(i < 0) | ~np.isfinite(d)] = 4 * n + 4
    order = np.argsort(rank, axis=1, kind="stable")[:, :most]
    out = np.take_along_axis(i, order, axis=1)
    bad = np.take_along_axis(rank, order, axis=1) > 3 * n + 3
    out = np.where(bad, -1, out)
    if out.shape[1] < most:
        out = np.pad(out, ((0, 0), (0, most - out.shape[1])), constant_values=-1)
    return out


def _add_back_links(vec: np.ndarray, level: Level, new: np.ndarray, chosen: np.ndarray) -> None:
    """Link the chosen neighbours back to the new nodes, cutting full lists by the diversity rule."""
    source = np.repeat(new, chosen.shape[1])
    target = chosen.ravel()
    ok = target >= 0
    source, target = source[ok], target[ok]
    d = ((vec[source] - vec[target]) ** 2).sum(axis=1)
    order = np.lexsort((d, target))
    source, target = source[order], target[order]
    nodes, first, count = np.unique(target, return_index=True, return_counts=True)
    for lo in range(0, len(nodes), 512):
        part = slice(lo, lo + 512)
        room = min(int(count[part].max()), 2 * level.width)
        col = np.arange(room)
        at = np.minimum(first[part, None] + col, len(source) - 1)
        extra = np.where(col < count[part, None], source[at], -1)
        i = np.concatenate((level.links[nodes[part]].astype(np.int64), extra), axis=1)
        d = ((vec[np.where(i < 0, 0, i)] - vec[nodes[part]][:, None, :]) ** 2).sum(axis=2)
        d[i < 0] = np.inf
        order = np.argsort(d, axis=1, kind="stable")
        d, i = np.take_along_axis(d, order, axis=1), np.take_along_axis(i, order, axis=1)
        level.links[nodes[part]] = diverse(vec, d, i, level.width)


def build(x: np.ndarray, ids: np.ndarray, m: int = 16, beam: int = 64, batch: int = 256) -> list[Level]:
    """The levels of the graph over float32 rows ``x``, lowest first."""
    u = (mix64(ids.astype(np.int64).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(11)).astype(np.float64) / 2.0**53
    height = np.minimum(np.floor(-np.log(np.maximum(u, 1e-16)) / np.log(m)), 12).astype(int)
    levels: list[Level] = []
    for h in range(height.max(), -1, -1):
        nodes = np.flatnonzero(height >= h)
        nodes = nodes[np.argsort(-height[nodes], kind="stable")]
        level = Level(nodes, 2 * m if h == 0 else m)
        vec = x[nodes]
        place = np.full(len(x), -1, np.int64)
        place[nodes] = np.arange(len(nodes))
        added = 0
        while added < len(nodes):
            size = max(1, min(batch, added, len(nodes) - added))
            new = np.arange(added, added + size)
            q = vec[new]
            if added:
                part = Level(nodes[:added], level.width, level.links[:added])
                entry = place[descend(x, levels, q, upto=h)] if levels else np.zeros(size, np.int64)
                d, i = beam_search(x, part, q, np.where(entry < added, entry, 0), beam)
            else:
                d, i = np.zeros((size, 0), np.float32), np.zeros((size, 0), np.int64)
            mutual = ((q[:, None, :] - q[None, :, :]) ** 2).sum(axis=2)
            np.fill_diagonal(mutual, np.inf)
            d = np.concatenate((d, mutual), axis=1)
            i = np.concatenate((i, np.tile(new, (size, 1))), axis=1)
            order = np.argsort(d, axis=1, kind="stable")[:, :beam]
            d, i = np.take_along_axis(d, order, axis=1), np.take_along_axis(i, order, axis=1)
            chosen = diverse(vec, d, i, m)
            level.links[new, :m] = chosen
            _add_back_links(vec, level, new, chosen)
            added += size
        levels.insert(0, level)
    return levels


def descend(x: np.ndarray, levels: list[Level], q: np.ndarray, upto: int) -> np.ndarray:
    """Rows of the nearest nodes found by greedy search through ``levels`` (lowest first), for entry below them."""
    at = np.zeros(len(q), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        level = levels[k]
        if k < len(levels) - 1:
            place = np.full(len(x), -1, np.int64)
            place[level.nodes] = np.arange(len(level.nodes))
            at = place[row]
        _, i = beam_search(x, level, q, at, 4)
        row = level.nodes[i[:, 0]]
    return row


def search(x: np.ndarray, levels: list[Level], q: np.ndarray, beam: int):
    """Nearest rows found: (float distances squared, rows), ``beam`` per query, sorted; -1 for none."""
    if len(levels) > 1:
        row = descend(x, levels[1:], q, 0)
        place = np.full(len(x), -1, np.int64)
        place[levels[0].nodes] = np.arange(len(levels[0].nodes))
        entry = place[row]
    else:
        entry = np.zeros(len(q), np.int64)
    d, i = beam_search(x, levels[0], q, entry, beam)
    return d, np.where(i < 0, -1, levels[0].nodes[np.where(i < 0, 0, i)])


def frame_of(exact: np.ndarray):
    """A function that maps vectors to the 32-bit frame of a shard: centred on it, its farthest component at 1.

    Vectors far outside the shard are cut there; the function tells which.
    """
    size = np.abs(exact).max()
    middle = (exact / size).mean(axis=0)
    reach = np.abs(exact / size - middle).max() or 1.0

    def apply(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        with np.errstate(over="ignore"):
            y = (v / size - middle) / reach
        far = ~(np.abs(y).max(axis=1) <= FAR)
        return np.clip(np.nan_to_num(y, posinf=FAR, neginf=-FAR), -FAR, FAR).astype(np.float32), far

    return apply


def distances(rows: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Euclidean distances in double precision, also where their squares are out of range."""
    with np.errstate(over="ignore"):
        gap = np.abs(rows - v)
        top = gap.max(axis=1, initial=0.0)
        plain = np.sqrt((gap**2).sum(axis=1))
    odd = np.flatnonzero((top > 0) & ((top < 1e-140) | (top > 1e140)) & np.isfinite(top))
    if len(odd):
        plain[odd] = top[odd] * np.sqrt(((gap[odd] / top[odd, None]) ** 2).sum(axis=1))
    return plain


class Shard:
    """A shard's rows by id, its nodes of rows that are equal in 32 bits, and their graph."""

    def __init__(self, ids: np.ndarray, exact: np.ndarray, node: np.ndarray | None = None, levels: list[Level] | None = None, m: int = 16, beam: int = 64):
        self.ids, self.exact = ids, exact
        self.frame = frame_of(exact)
        x = self.frame(exact)[0] + np.float32(0)  # no negative zeros
        if node is None:
            _, node = np.unique(x.view(np.dtype((np.void, x.itemsize * x.shape[1]))).ravel(), return_inverse=True)
        self.node = node.astype(np.int64)
        self.members = np.argsort(self.node, kind="stable")  # rows of a node lie together, by id
        sizes = np.bincount(self.node)
        self.first = np.cumsum(sizes) - sizes
        self.end = self.first + sizes
        heads = self.members[self.first]
        self.x = x[heads]
        alike = (exact[self.members] == exact[np.repeat(heads, sizes)]).all(axis=1)
        self.alike = np.logical_and.reduceat(alike, self.first)
        self.levels = build(self.x, ids[heads], m, beam) if levels is None else levels

    def nearest(self, query_ids: np.ndarray, queries: np.ndarray, k: int, beam: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query the rows of its k nearest found (not of its own id) and their distances."""
        q, far = self.frame(queries)
        _, found = search(self.x, self.levels, q, beam)
        out = []
        for qid, vec, nodes, away in zip(query_ids, queries, found, far):
            rows = np.zeros(0, np.int64)
            if not away:
                parts = [self.members[self.first[n] : min(self.end[n], self.first[n] + k + 1) if self.alike[n] else self.end[n]] for n in nodes[nodes >= 0]]
                rows = np.concatenate(parts)
                rows = rows[self.ids[rows] != qid]
            if len(rows) < k and len(rows) < len(self.ids):
                rows = np.flatnonzero(self.ids != qid)
            d = distances(self.exact[rows], vec)
            best = np.lexsort((self.ids[rows], d))[:k]
            out.append((rows[best], d[best]))
        return out


def build_index(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    shard_rows: int | None = None,
    m: int = 16,
    beam: int = 64,
) -> DataFrame:
    """The index table of all valid vectors, a row per shard, written to the shared folder.

    By default a shard has 4096 rows, or a 64th of a larger table, but 65536 rows and ``SHARD_BYTES`` at most.
    """
    rows = vectors.filter(valid(vector_col) & F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector"), F.size(vector_col).alias("dim")
    )
    n, dim = rows.agg(F.count("*"), F.coalesce(F.max("dim"), F.lit(1))).first()
    shards = -(-n // (shard_rows or max(1, min(65536, max(4096, n // 64), SHARD_BYTES // (8 * dim))))) or 1

    def make(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id", kind="stable")
        ids = pdf["id"].to_numpy(np.int64)
        original = np.stack([np.asarray(v, np.float64) for v in pdf["vector"]])
        shard = Shard(ids, original, m=m, beam=beam)
        packed = [
            {"nodes": v.nodes.astype("<i4").tobytes(), "links": v.links.astype("<i4").tobytes()} for v in shard.levels
        ]
        row = (int(key[0]), int(key[1]), ids.astype("<i8").tobytes(), original.astype("<f8").tobytes(), shard.node.astype("<i4").tobytes(), packed)
        return pd.DataFrame([row], columns=["dim", "shard", "ids", "vectors", "node", "levels"])

    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("id", F.lit("shard")), F.lit(shards)).cast("int"))
    return materialize(dealt.groupBy("dim", "shard").applyInPandas(make, INDEX), "hnsw-index")


def nearest(
    index: DataFrame,
    queries: DataFrame,
    k: int = 10,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    beam: int = 192,
    m: int = 16,
    block_rows: int = 8192,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found for each valid query, by exact distance."""
    q = queries.filter(valid(vector_col) & F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("query_id"), F.col(vector_col).alias("vector"), F.size(vector_col).alias("dim")
    )
    q = materialize(q, "hnsw-queries")
    blocks = -(-q.count() // block_rows) or 1
    q = q.withColumn("block", F.pmod(F.xxhash64("query_id", F.lit("block")), F.lit(blocks)).cast("int"))
    shards = index.select(F.col("dim").alias("at_dim"), F.col("shard").alias("at_shard"))
    # every query meets every shard of its length once; blocks bound what a task holds
    asked = q.join(shards, q["dim"] == F.col("at_dim")).select("at_dim", "at_shard", "block", "query_id", "vector")
    served = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def find(key, shard: pd.DataFrame, ask: pd.DataFrame) -> pd.DataFrame:
        if not len(shard) or not len(ask):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": int, "vec_id": int})
        s, dim = shard.iloc[0], int(key[0])
        ids = np.frombuffer(s["ids"], "<i8")
        exact = np.frombuffer(s["vectors"], "<f8").reshape(len(ids), dim)
        levels = []
        for h, v in enumerate(s["levels"]):
            levels.append(
                Level(np.frombuffer(v["nodes"], "<i4").astype(np.int64), 2 * m if h == 0 else m,
                      np.frombuffer(v["links"], "<i4"))
            )
        have = Shard(ids, exact, np.frombuffer(s["node"], "<i4"), levels)
        out = []
        for lo in range(0, len(ask), 256):
            part = ask.iloc[lo : lo + 256]
            want = np.stack([np.asarray(v, np.float64) for v in part["vector"]])
            for qid, (rows, d) in zip(part["query_id"], have.nearest(part["query_id"].to_numpy(), want, k, beam)):
                out.append(pd.DataFrame({"query_id": qid, "vec_id": ids[rows], "score": d}))
        return pd.concat(out, ignore_index=True)

    blocks_of = asked.groupBy("at_dim", "at_shard", "block")
    hits = (
        served.groupBy("dim", "shard", "block")
        .cogroup(blocks_of)
        .applyInPandas(find, "query_id long, vec_id long, score double")
    )
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return (
        hits.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
        .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    )
