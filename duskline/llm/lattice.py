"""Embedding near-duplicates by E8 lattice hashing.

Each table projects unit vectors at random to ``codes`` blocks of 8 dimensions
and decodes every block to its nearest point of the E8 lattice; the points
together name a cell. A vector is stored under its cell and also probes the
cells that replace one or both points by the neighbour next nearest to it. Pairs
that meet are verified by cosine in double precision.

A pair may meet in several tables; it counts where it meets first, which both
vectors' cells tell, so links are counted inside the tasks and no pair is
emitted. Only a spanning forest of each bucket's links goes on to the connected
components. Equal vectors are one item with a weight. A bucket of more than
``block`` rows is cut into blocks that meet pairwise in separate tasks, so
no task holds a large bucket.

Vectors that are null, zero, or hold null or non-finite components link with
nothing. Vectors of different length never meet. Vectors of any finite size are
scaled before their norm is taken. Repeated ids are separate rows: each has the
links of its own vector. Empty tables give no rows; extra columns are ignored.
Items are named by 64 bits of a hash of the vector's content.

Random pairs share a cell with probability of about 0.0365 ** codes, so ``codes``
grows with the logarithm of the number of distinct vectors, which keeps the meetings
of a vector from growing with the table; per table two vectors of cosine 0.95 meet
with probability of about 0.74 ** codes (more if they are nearer), so ``tables``
grows with ``codes`` (see ``hash_shape``).
"""

from __future__ import annotations

from itertools import combinations, product
from math import ceil, log

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Intermediates, discard, materialize, mix64
from .components import connected_components

SCALE = 0.9
#: A further code is used from each multiple of 1 / 0.0365 of so many vectors on.
PER_CODE = 4000


def shortest_vectors() -> np.ndarray:
    """The 240 least vectors of E8: (+-1, +-1, 0...) and (+-1/2)**8 with an even number of minus signs."""
    out = []
    for i, j in combinations(range(8), 2):
        for a, b in product((1.0, -1.0), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = a, b
            out.append(v)
    out += [np.array(s) for s in product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array(out)


def _nearest_even(x: np.ndarray) -> np.ndarray:
    """Nearest integer vectors of even sum: round, and where the sum is odd turn the worst rounded entry."""
    f = np.rint(x)
    error = x - f
    odd = np.flatnonzero(f.sum(axis=1) % 2 != 0)
    worst = np.abs(error[odd]).argmax(axis=1)
    f[odd, worst] += np.where(error[odd, worst] >= 0, 1.0, -1.0)
    return f


def decode_e8(x: np.ndarray) -> np.ndarray:
    """Nearest points of E8, the union of the even integer vectors and their shift by one half."""
    whole, half = _nearest_even(x), _nearest_even(x - 0.5) + 0.5
    nearer = ((x - whole) ** 2).sum(axis=1) <= ((x - half) ** 2).sum(axis=1)
    return np.where(nearer[:, None], whole, half)


class LatticeHash:
    """Cells of unit vectors: ``base`` [n, tables] and ``probes`` [n, tables, 2**codes - 1]."""

    def __init__(self, dim: int, tables: int, codes: int, seed: int = 5):
        rng = np.random.default_rng(seed + dim)
        # multiples of 2**-20, as the vectors are made: then sums of products are exact in any order,
        # and a vector has the same cells wherever they are computed
        self.projections = np.rint(rng.normal(size=(tables, codes, dim, 8)) / (np.sqrt(8) * SCALE) * 2**20) / 2**20
        self.tables, self.codes = tables, codes
        self.neighbours = shortest_vectors()

    @staticmethod
    def _name(points: np.ndarray) -> np.ndarray:
        twice = np.rint(points * 2).astype(np.int64).view(np.uint64)
        h = np.zeros(len(points), np.uint64)
        for k in range(8):
            h = mix64(h * np.uint64(31) + twice[:, k])
        return h

    def cells(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, ways = len(unit), list(product((0, 1), repeat=self.codes))
        unit = np.rint(unit * 2**20) / 2**20
        out = np.zeros((n, self.tables, len(ways)), np.uint64)
        for t in range(self.tables):
            names = []
            for c in range(self.codes):
                z = unit @ self.projections[t, c]
                p = decode_e8(z)
                side = p + self.neighbours[((z - p) @ self.neighbours.T).argmax(axis=1)]
                names.append((self._name(p), self._name(side)))
            for w, way in enumerate(ways):
                h = np.full(n, t + 1, np.uint64)
                for c, which in enumerate(way):
                    h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + names[c][which])
                out[:, t, w] = h
        return out[:, :, 0], out[:, :, 1:]


def unit_vectors(vectors) -> tuple[np.ndarray, np.ndarray]:
    """Stacked unit vectors of equally long, valid vectors; scaled first, so that no square overflows or vanishes."""
    x = np.stack([np.asarray(v, dtype=np.float64) for v in vectors])
    scaled = x / np.abs(x).max(axis=1)[:, None]
    return scaled / np.linalg.norm(scaled, axis=1)[:, None], x


def hash_shape(n: int, missed: float = 0.002) -> tuple[int, int]:
    """(tables, codes) for ``n`` distinct vectors: at most the share ``missed`` of pairs of cosine 0.95 meets nowhere."""
    codes = max(2, 1 + ceil(log(max(n, 1) / PER_CODE) / log(1 / 0.0365)))
    return ceil(log(missed) / log(1 - 0.74**codes)), codes


def valid(vector: str):
    """Vectors that take part: not null, not zero, all components finite."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return v.isNotNull() & F.coalesce(finite, F.lit(False)) & F.coalesce(F.exists(v, lambda x: x != 0), F.lit(False))


def hash_rows(items: DataFrame, tables: int, codes: int) -> DataFrame:
    """(cell, is_base, item, weight, vector): a row for each cell a vector is stored in or probes."""

    def run(batches):
        hashes: dict[int, LatticeHash] = {}
        for pdf in batches:
            size = pdf["vector"].map(len)
            for dim, part in pdf.groupby(size.to_numpy()):
                lattice = hashes.setdefault(dim, LatticeHash(dim, tables, codes))
                for lo in range(0, len(part), 1000):
                    rows = part.iloc[lo : lo + 1000]
                    base, probes = lattice.cells(unit_vectors(rows["vector"])[0])
                    cells = np.concatenate((base, probes.reshape(len(rows), -1)), axis=1)
                    n = cells.shape[1]
                    cells = mix64(cells + np.uint64(dim))
                    yield pd.DataFrame(
                        {
                            "cell": cells.ravel().view(np.int64),
                            "is_base": np.tile(np.arange(n) < base.shape[1], len(rows)),
                            "item": np.repeat(rows["item"].to_numpy(), n),
                        }
                    )

    return items.select("item", "vector").mapInPandas(run, "cell long, is_base boolean, item long")


def first_meeting(x, y, i, j, low_is_x, dim: int) -> np.ndarray:
    """The cell in which each pair (i, j) is counted: of the first table where the two vectors meet.

    ``x`` and ``y`` are (base, probes) of all vectors. Where one probes the other's cell, the pair is counted in
    the cell that is probed; if each probes the other's, in the one that the smaller id probes.
    """
    bx, px, by, py = x[0][i], x[1][i], y[0][j], y[1][j]
    both = bx == by
    x_probes = (px == by[:, :, None]).any(axis=2)
    y_probes = (py == bx[:, :, None]).any(axis=2)
    t = (both | x_probes | y_probes).argmax(axis=1)
    r = np.arange(len(t))
    low_probes = np.where(low_is_x, x_probes[r, t], y_probes[r, t])
    at_y = both[r, t] | np.where(low_is_x, low_probes, ~low_probes)
    return mix64(np.where(at_y, by[r, t], bx[r, t]) + np.uint64(dim))


def link_cells(pdf: pd.DataFrame, threshold: float, tables: int, codes: int, lattices: dict[int, LatticeHash]):
    """Counted links (rows a, b of ``pdf``) of all the cell blocks in a frame of one vector length.

    Within a block (i, i) of a cell all rows meet; in a block (i, j) those of slice i meet those of slice j.
    """
    unit, _ = unit_vectors(pdf["vector"])
    cell, bi, bj, part = (pdf[c].to_numpy() for c in ("cell", "i", "j", "slice"))
    item, base = pdf["item"].to_numpy(), pdf["is_base"].to_numpy()
    new = np.ones(len(cell), bool)
    new[1:] = (cell[1:] != cell[:-1]) | (bi[1:] != bi[:-1]) | (bj[1:] != bj[:-1])
    starts = np.append(np.flatnonzero(new), len(cell))
    left, right = [], []
    for lo, hi in zip(starts[:-1], starts[1:]):
        if hi - lo < 2 or not base[lo:hi].any():
            continue
        if bi[lo] == bj[lo]:
            xs = ys = np.arange(lo, hi)
        else:
            rows = np.arange(lo, hi)
            xs, ys = rows[part[lo:hi] == bi[lo]], rows[part[lo:hi] == bj[lo]]
        for at in range(0, len(xs), 512):
            some = xs[at : at + 512]
            a, b = np.nonzero(unit[some] @ unit[ys].T >= threshold - 1e-9)
            a, b = some[a], ys[b]
            ok = (base[a] | base[b]) & (item[a] != item[b])
            if bi[lo] == bj[lo]:
                ok &= a < b
            left.append(a[ok])
            right.append(b[ok])
    if not left:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    a, b = np.concatenate(left), np.concatenate(right)
    exact = np.concatenate(
        [np.zeros(0), *((unit[a[k : k + 65536]] * unit[b[k : k + 65536]]).sum(axis=1) for k in range(0, len(a), 65536))]
    )
    a, b = a[exact >= threshold], b[exact >= threshold]
    if not len(a):
        return a, b
    dim = unit.shape[1]
    lattice = lattices.setdefault(dim, LatticeHash(dim, tables, codes))
    used, place = np.unique(np.concatenate((a, b)), return_inverse=True)
    cells = lattice.cells(unit[used])
    pa_, pb_ = place[: len(a)], place[len(a) :]
    mine = np.zeros(len(a), bool)
    for k in range(0, len(a), 16384):
        s = slice(k, k + 16384)
        where = first_meeting(cells, cells, pa_[s], pb_[s], item[a[s]] < item[b[s]], dim)
        mine[s] = where.view(np.int64) == cell[a[s]]
    return a[mine], b[mine]


def forest(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the edges."""
    up: dict[int, int] = {}

    def root(v):
        while (p := up.get(v, v)) != v:
            up[v] = up.get(p, p)
            v = p
        return v

    out = []
    for x, y in zip(a.tolist(), b.tolist()):
        p, q = root(x), root(y)
        if p != q:
            up[max(p, q)] = min(p, q)
            out.append((x, y))
    return out


def near_duplicates(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    threshold: float = 0.95,
    tables: int | None = None,
    codes: int | None = None,
    block: int = 2000,
    frame_rows: int = 20000,
) -> DataFrame:
    """One row per row of ``vectors``: vec_id, n_links, component_id, kept.

    ``tables`` and ``codes`` follow from the number of distinct vectors unless they are given.
    """
    with Intermediates() as made:
        out, *used = _linked(vectors, id_col, vector_col, threshold, tables, codes, block, frame_rows)
        made.keep(*used)
    return out


def _linked(vectors, id_col, vector_col, threshold, tables, codes, block, frame_rows) -> list[DataFrame]:
    """The result of ``near_duplicates``, then the stored tables it is read from."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("vector"))
    good = rows.filter(valid("vector") & F.col("vec_id").isNotNull())
    # equal vectors are one item
    content = F.xxhash64(F.md5(F.concat_ws(",", F.col("vector").cast("array<string>"))))
    keyed = good.withColumn("item", content)
    items = materialize(
        keyed.groupBy("item").agg(
            F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("weight"), F.any_value("vector").alias("vector")
        ),
        "lattice-items",
    )
    shape = hash_shape(items.count())
    tables, codes = tables or shape[0], codes or shape[1]
    cells = materialize(hash_rows(items, tables, codes), "lattice-cells")
    counts = cells.groupBy("cell").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("is_base").cast("int")).alias("stored")
    )
    counts = counts.filter((F.col("n") > 1) & (F.col("stored") > 0))
    met = cells.join(counts, "cell").withColumn("slices", F.ceil(F.col("n") / block).cast("int"))
    met = met.withColumn("slice", F.pmod(F.xxhash64("item", "cell"), F.col("slices")).cast("int"))
    # block (i, j), i <= j, of a bucket meets in one task
    pairs = F.transform(
        F.sequence(F.lit(0), F.col("slices") - 1),
        lambda o: F.struct(F.least("slice", o).alias("i"), F.greatest("slice", o).alias("j")),
    )
    met = met.select("cell", "is_base", "item", "slice", F.explode(pairs).alias("at"))
    met = met.join(items.drop("least"), "item").select("cell", "is_base", "item", "weight", "vector", "slice", "at.i", "at.j")

    # many small cells share a frame of bounded size
    frames = counts.agg(F.sum(F.col("n") * F.ceil(F.col("n") / block))).first()[0] or 0
    frame = F.pmod(F.xxhash64("cell", "i", "j"), F.lit(int(frames) // frame_rows + 1))

    def link(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        lattices: dict[int, LatticeHash] = {}
        size = pdf["vector"].map(len).to_numpy()
        for dim in np.unique(size):
            part = pdf[size == dim].sort_values(["cell", "i", "j", "item"]).reset_index(drop=True)
            a, b = link_cells(part, threshold, tables, codes, lattices)
            item, weight = part["item"].to_numpy(), part["weight"].to_numpy()
            x, y = item[a], item[b]
            both = pd.DataFrame({"item": np.concatenate((x, y)), "links": np.concatenate((weight[b], weight[a]))})
            sums = both.groupby("item", as_index=False)["links"].sum()
            sums["other"] = sums["item"]
            tree = forest(x, y)
            out += [sums, pd.DataFrame({"item": [p for p, _ in tree], "links": 0, "other": [q for _, q in tree]})]
        return pd.concat(out, ignore_index=True).astype("int64")

    found = materialize(
        met.withColumn("frame", frame).groupBy("frame").applyInPandas(link, "item long, links long, other long"),
        "lattice-links",
    )
    labels = connected_components(found.filter("item <> other").select(F.col("item").alias("a"), F.col("other").alias("b")))
    links = found.groupBy("item").agg(F.sum("links").alias("links"))
    per_item = (
        items.select("item", "least", "weight")
        .join(links, "item", "left")
        .join(labels.withColumnRenamed("node", "item"), "item", "left")
        .select(
            "item",
            "least",
            (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"),
            F.coalesce("component", "item").alias("component"),
        )
    )
    per_item = materialize(per_item, "lattice-per-item")
    discard(cells, found)
    named_by = materialize(per_item.groupBy("component").agg(F.min("least").alias("component_id")), "lattice-components")
    per_item = materialize(per_item.join(named_by, "component").drop("component", "least"), "lattice-result")
    linked = keyed.select("vec_id", "item").join(per_item, "item").select("vec_id", "n_links", "component_id")
    alone = rows.filter(~(valid("vector") & F.col("vec_id").isNotNull())).select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")
    )
    out = linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
    return [out, per_item]
