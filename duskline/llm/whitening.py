"""Whitening of embeddings by a matrix-free block Jacobi-Davidson eigensolver.

Each entry c becomes the integer ``floor(scale * c) + shift``, so that counts,
sums and deviations are exact. The covariance is never formed: a product with a
block of directions is one pass in which every task adds up
``x (x . u)`` over its centred rows, and the partial sums (dimensions x
directions) are added in the order of their tasks; those of many tasks through
one more shuffle to about the square root of their number.

On the driver lives only what has the size of the model, dimensions x (components
+ search space). Rayleigh-Ritz over the search space gives approximate
components; those whose residual reaches double precision are locked and
projected out; for the others the projected correction equation
``(I-QQ') (V-theta) (I-QQ') t = -r`` is solved by MINRES (all of them in step, a
pass per step), and the corrections widen the space.

Vectors that are null, empty, or hold null or non-finite entries are dropped.
Vectors of different length are fitted apart, each length with its own list (the
driver loops over the lengths). Entries beyond 2**62 after scaling are cut there.
Directions whose variance double precision can't tell from none (at most
``FLAT`` times the largest) are no components, so a list of equal vectors, or of
one, gives no rows. Ids may be null or repeated; equal eigenvalues give any
orthonormal basis of their space. Empty tables give no rows; extra columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Intermediates, materialize

#: A residual of so much of the largest eigenvalue is double precision for sums over many rows.
RESIDUAL = 2.0**-45
#: Variances of so small a share of the largest are lost in the rounding of the largest.
FLAT = 1e-11
#: Partial sums of more tasks are first added in a shuffle.
FEW_TASKS = 64
OUT = (
    "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double, "
    "eigenvalue double, deviation_exact decimal(38,0)"
)


@contextmanager
def small_batches(spark: SparkSession, size: str = "8m"):
    """Batches to Python workers of at most ``size`` bytes, however long the vectors."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, size)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def integers(vectors: DataFrame, id_col: str, vector_col: str, scale: int = 64, shift: int = 1000000) -> DataFrame:
    """(vec_id, dim, x): the usable vectors as integers."""
    v = F.col(vector_col)
    good = v.isNotNull() & (F.size(v) > 0) & F.forall(
        v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))
    )
    most = F.lit(2.0**62)
    x = F.transform(v, lambda c: F.floor(F.greatest(F.least(c.cast("double") * scale, most), -most)) + F.lit(shift).cast("long"))
    return vectors.filter(good).select(F.col(id_col).cast("long").alias("vec_id"), F.size(v).alias("dim"), x.alias("x"))


def matrix(batch: pa.RecordBatch, dim: int) -> np.ndarray:
    column = batch.column(batch.schema.get_field_index("x"))
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dim)


@dataclass
class Centre:
    """Rows, exact sums per dimension, and the mean as whole part and rest."""

    n: int
    sums: list[int]

    def __post_init__(self):
        self.whole = np.array([s // self.n for s in self.sums], np.int64)
        self.rest = np.array([(s % self.n) / self.n for s in self.sums])

    def apply(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole).astype(np.float64) - self.rest

    def deviations(self, x: np.ndarray) -> list[int]:
        """Sums of (n x - S)**2, exact."""
        most = max(int(np.abs(x).max(initial=0)), max(abs(int(w)) for w in self.whole)) + 1
        if 2 * self.n * most < 1 << 62:
            y = x * self.n - np.array(self.sums, np.int64)
            if float(np.abs(y).max(initial=0)) ** 2 * y.shape[1] < 2.0**62:
                return (y * y).sum(axis=1).tolist()
        y = x.astype(object) * self.n - np.array(self.sums, object)
        return (y * y).sum(axis=1).tolist()


def centre(rows: DataFrame, dim: int) -> Centre:
    """The exact sums, from high and low halves that no task can overflow."""

    def add(batches):
        high, low, n = np.zeros(dim, np.int64), np.zeros(dim, np.int64), 0
        for batch in batches:
            x = matrix(batch, dim)
            high += (x >> 31).sum(axis=0)
            low += (x & 0x7FFFFFFF).sum(axis=0)
            n += len(x)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(dim, dtype=np.int32)), pa.array(high), pa.array(low), pa.array(np.full(dim, n, np.int64))],
            ["at", "high", "low", "n"],
        )

    parts = rows.select("x").mapInArrow(add, "at int, high long, low long, n long")
    total = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
    got = parts.groupBy("at").agg(total("high"), total("low"), F.sum("n").alias("n")).orderBy("at").collect()
    return Centre(int(got[0].n), [(int(r.high) << 31) + int(r.low) for r in got])


def summed(rows: DataFrame, mid: Centre, size: int, part: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all centred rows of ``part(rows)``, an array of ``size``; the same in every run."""
    dim = len(mid.sums)

    def add(batches):
        total = np.zeros(size)
        for batch in batches:
            x = matrix(batch, dim)
            for lo in range(0, len(x), 2048):
                total += part(mid.apply(x[lo : lo + 2048])).ravel()
        task = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays([pa.array([task], pa.int32()), pa.array([total.tobytes()])], ["task", "sums"])

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("task")
        total = np.zeros(size)
        for s in pdf["sums"]:
            total += np.frombuffer(s)
        return pd.DataFrame({"task": [pdf["task"].iloc[0]], "sums": [total.tobytes()]})

    merged = rows.select("x").mapInArrow(add, "task int, sums binary")
    tasks = rows.rdd.getNumPartitions()
    if tasks > FEW_TASKS:
        merged = merged.groupBy(F.pmod("task", F.lit(round(tasks**0.5))).alias("g")).applyInPandas(merge, "task int, sums binary")
    total = np.zeros(size)
    for _, s in sorted(map(tuple, merged.collect())):
        total += np.frombuffer(s)
    return total


def minres(operator: Callable[[np.ndarray], np.ndarray], b: np.ndarray, steps: int, reduce: float) -> np.ndarray:
    """Approximate solutions of symmetric systems, a column each, all in step, by the MINRES recurrence."""
    x = np.zeros_like(b)
    beta = np.linalg.norm(b, axis=0)
    first = np.where(beta > 0, beta, 1.0)
    v, v_last = b / first, np.zeros_like(b)
    w, w_last = np.zeros_like(b), np.zeros_like(b)
    c = c_last = np.ones(b.shape[1])
    s = s_last = np.zeros(b.shape[1])
    eta = beta.copy()
    for _ in range(steps):
        a = operator(v)
        alpha = (v * a).sum(axis=0)
        a -= alpha * v + beta * v_last
        beta_next = np.linalg.norm(a, axis=0)
        delta = c * alpha - c_last * s * beta
        r1 = np.hypot(delta, beta_next)
        r2, r3 = s * alpha + c_last * c * beta, s_last * beta
        live = r1 > 1e-300
        r1 = np.where(live, r1, 1.0)
        c_last, s_last, c, s = c, s, np.where(live, delta / r1, 1.0), np.where(live, beta_next / r1, 0.0)
        w_last, w = w, (v - r3 * w_last - r2 * w) / r1
        x += np.where(live, c * eta, 0.0) * w
        eta = -s * eta
        v_last, v = v, a / np.where(beta_next > 0, beta_next, 1.0)
        beta = beta_next
        if (np.abs(eta) <= reduce * first).all():
            break
    return x


def jacobi_davidson(
    product: Callable[[np.ndarray], np.ndarray], dim: int, k: int, spare: int = 4, inner: int = 8, seed: int = 11
) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues and unit eigenvectors of a symmetric operator, by falling value.

    ``product(U)`` is the operator times a block. A search space of more than ``4 k + spare`` directions restarts
    from its best. When the space and the locked vectors span everything, Rayleigh-Ritz is exact.
    """
    k = min(k, dim)
    rng = np.random.default_rng(seed)
    basis = np.linalg.qr(rng.normal(size=(dim, min(dim, k + spare))))[0]
    image = product(basis)
    locked, values = np.zeros((dim, 0)), np.zeros(0)
    while True:
        inside = basis.T @ image
        theta, turn = np.linalg.eigh((inside + inside.T) / 2)
        theta, turn = theta[::-1], turn[:, ::-1]
        basis, image = basis @ turn, image @ turn
        wanted = k - len(values)
        r = image[:, :wanted] - basis[:, :wanted] * theta[:wanted]
        r -= locked @ (locked.T @ r)
        largest = max(abs(theta[0]), np.abs(values).max(initial=0.0))
        done = np.linalg.norm(r, axis=0) <= RESIDUAL * largest
        lead = wanted if done.all() or basis.shape[1] + locked.shape[1] >= dim else int(np.argmin(done))
        locked, values = np.hstack((locked, basis[:, :lead])), np.concatenate((values, theta[:lead]))
        basis, image, theta, r = basis[:, lead:], image[:, lead:], theta[lead:], r[:, lead:]
        if len(values) >= k:
            order = np.argsort(-values, kind="stable")
            return values[order], locked[:, order]
        if basis.shape[1] > 4 * k + spare:
            keep = k - len(values) + spare
            basis, image = basis[:, :keep], image[:, :keep]
        known = np.hstack((locked, basis[:, : r.shape[1]]))
        away = lambda t: t - known @ (known.T @ t)
        shift = theta[: r.shape[1]]
        t = minres(lambda u: away(product(away(u)) - away(u) * shift), away(-r), inner, 1e-3)
        t = t / np.maximum(np.linalg.norm(t, axis=0), 1e-300)
        for _ in range(2):
            t -= locked @ (locked.T @ t)
            t -= basis @ (basis.T @ t)
        u, size, _ = np.linalg.svd(t, full_matrices=False)
        fresh = u[:, size > 1e-9]
        if not fresh.shape[1]:
            fresh = rng.normal(size=(dim, 1))
        room = dim - locked.shape[1] - basis.shape[1]
        fresh = fresh[:, :room]
        for _ in range(2):
            fresh -= locked @ (locked.T @ fresh)
            fresh -= basis @ (basis.T @ fresh)
            fresh = np.linalg.qr(fresh)[0]
        basis, image = np.hstack((basis, fresh)), np.hstack((image, product(fresh)))


@dataclass
class Whitening:
    """A fitted whitening of vectors of one length: centre, eigenvalues, unit vectors (columns), total variance."""

    centre: Centre
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float

    @property
    def projection(self) -> np.ndarray:
        return self.vectors / np.sqrt(self.values)


def fit(rows: DataFrame, dim: int, components: int = 32) -> Whitening:
    """Fit ``components`` components, or as many as the list has, to stored rows (vec_id, x) of one length."""
    mid = centre(rows, dim)
    trace = float(summed(rows, mid, 1, lambda c: np.array([(c * c).sum()]))[0]) / mid.n

    def product(u: np.ndarray) -> np.ndarray:
        return summed(rows, mid, dim * u.shape[1], lambda c: c.T @ (c @ u)).reshape(dim, -1) / mid.n

    if trace > 0:
        values, vectors = jacobi_davidson(product, dim, components)
        good = values > FLAT * values[0]
        values, vectors = values[good], vectors[:, good]
    else:
        values, vectors = np.zeros(0), np.zeros((dim, 0))
    model = Whitening(mid, values, vectors, trace, 0.0)
    if k := len(values):
        p = model.projection

        def moments(c):
            w = c @ p
            return np.concatenate(((w.T @ w).ravel(), w.sum(axis=0)))

        m = summed(rows, mid, k * k + k, moments) / mid.n
        model.identity_error = float(np.abs(m[: k * k].reshape(k, k) - np.outer(m[k * k :], m[k * k :]) - np.eye(k)).max())
    return model


def transform(rows: DataFrame, model: Whitening) -> DataFrame:
    """A row per vector and component, columns as in ``OUT``.

    ``deviation`` is null where it is beyond a long; ``deviation_exact`` then still has it.
    """
    dim, k = len(model.centre.sums), len(model.values)
    explained = model.values / model.trace if k else model.values

    def project(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                x = matrix(part, dim)
                exact = model.centre.deviations(x)
                w = model.centre.apply(x) @ model.projection
                at = pa.array(np.repeat(np.arange(len(x)), k))
                tile = lambda v: pa.array(np.tile(v, len(x)))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(part.schema.get_field_index("vec_id")).take(at),
                        tile(np.arange(1, k + 1, dtype=np.int32)),
                        pa.array(np.full(len(at), model.centre.n)),
                        pa.array([d if d < 1 << 63 else None for d in exact], pa.int64()).take(at),
                        pa.array(w.ravel()),
                        tile(explained),
                        pa.array(np.full(len(at), model.identity_error)),
                        tile(model.values),
                        pa.array([d if d < 10**38 else None for d in exact], pa.decimal128(38)).take(at),
                    ],
                    [f.split()[0] for f in OUT.split(", ")],
                )

    return rows.select("vec_id", "x").mapInArrow(project, OUT)


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 32) -> DataFrame:
    """Fit on all usable vectors and return their whitened components (see ``transform``)."""
    spark = vectors.sparkSession
    with Intermediates() as held, small_batches(spark):
        rows = materialize(integers(vectors, id_col, vector_col), "whiten-rows")
        held.keep(rows)
        out = spark.createDataFrame([], OUT)
        for (dim,) in sorted(map(tuple, rows.select("dim").distinct().collect())):
            same = rows.filter(F.col("dim") == dim)
            out = out.unionByName(transform(same, fit(same, dim, components)))
        return out
