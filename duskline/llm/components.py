"""Connected components of a stored edge table, by contraction."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize

#: So few edges (256 KB) are closed in one task; more of them are contracted in rounds.
FEW = 1 << 14


def close(batches):
    """(node, component) of all edges ``(a, b)`` of a partition."""
    least: dict = {}

    def top(x: int) -> int:
        while least[x] != x:
            least[x] = x = least[least[x]]
        return x

    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
            least.setdefault(a, a)
            least.setdefault(b, b)
            x, y = top(a), top(b)
            least[max(x, y)] = min(x, y)
    nodes = list(least)
    columns = [pa.array(nodes, pa.int64()), pa.array([top(x) for x in nodes], pa.int64())]
    yield pa.RecordBatch.from_arrays(columns, ["node", "component"])


def connected_components(edges: DataFrame, few: int = FEW) -> DataFrame:
    """(node, component) for every node of ``edges(a, b)``; the component is its smallest node.

    In each round every node joins the least of itself and its neighbours, and
    edges are rewritten between what is left; stars take one or two rounds, a
    path of n nodes O(log n) in practice. All tables stay distributed: minima are
    pre-aggregated per task, hot nodes are plain join keys that can be split, and
    each round is a written table. What is left is closed at once when it is at
    most ``few`` edges; the components are the same.
    """
    pairs = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct()
    pairs = materialize(pairs, "cc-edges")
    labels: DataFrame | None = None
    while (size := pairs.count()) > 0:
        last = size <= few
        both = pairs.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(
            pairs.select(F.col("b").alias("node"), F.col("a").alias("other"))
        )
        least = both.groupBy("node").agg(F.min("other").alias("low"))
        step = least.select("node", F.least("node", "low").alias("component"))
        if last:
            step = pairs.coalesce(1).mapInArrow(close, "node long, component long")
        step = materialize(step, "cc-step")
        if labels is not None:
            moved = step.select(F.col("node").alias("component"), F.col("component").alias("low"))
            further = labels.join(moved, "component", "left").select(
                "node", F.coalesce("low", "component").alias("component")
            )
            further = materialize(further, "cc-labels")
            discard(labels)
        if not last:
            left = step.select(F.col("node").alias("a"), F.col("component").alias("a2"))
            right = step.select(F.col("node").alias("b"), F.col("component").alias("b2"))
            moved = pairs.join(left, "a").join(right, "b").filter("a2 <> b2")
            moved = materialize(
                moved.select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b")).distinct(), "cc-edges"
            )
            discard(pairs)
            pairs = moved
        if labels is None:
            labels = step
        else:
            discard(step)
            labels = further
        if last:
            break
    if labels is None:
        labels = materialize(pairs.select(F.col("a").alias("node"), F.col("b").alias("component")), "cc-labels")
    discard(pairs)
    return labels
