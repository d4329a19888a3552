"""Nearest neighbours of vectors of any finite shape: recall against brute force in extended precision."""

from __future__ import annotations

import numpy as np
import pytest

from duskline.llm import hnsw

RNG = np.random.default_rng(12)
PLAIN = RNG.normal(size=(1200, 16))
SHAPES = {
    "plain": PLAIN,
    "all equal": np.tile(PLAIN[:1], (1000, 1)),
    "three groups": np.repeat(PLAIN[:3], 300, axis=0),
    "third equal": np.concatenate((PLAIN[:600], np.tile(PLAIN[600:601], (300, 1)))),
    "offset 1e4": PLAIN + 1e4,
    "offset 1e9": PLAIN + 1e9,
    "1e-25": PLAIN * 1e-25,
    "1e25": PLAIN * 1e25,
    "1e-200": PLAIN * 1e-200,
    "1e200": PLAIN * 1e200,
    "1e-310": PLAIN * 1e-310,
    "two far": np.concatenate((PLAIN[:298], PLAIN[:2] * 1e25)),
    "two clusters": np.concatenate((PLAIN[:500], PLAIN[500:1000] + 1e5)),
    "few": PLAIN[:7],
    "one": PLAIN[:1],
    "line": np.arange(1, 801)[:, None] * PLAIN[:1],
}


def brute(ids, x, q, qid, k=10):
    gap = np.abs(x.astype(np.longdouble) - q.astype(np.longdouble))
    d = np.sqrt((gap**2).sum(axis=1)).astype(np.float64)
    other = np.flatnonzero(ids != qid)
    return other[np.lexsort((ids[other], d[other]))[:k]], d


@pytest.mark.parametrize("shape", SHAPES)
def test_recall(shape):
    x = SHAPES[shape]
    ids = np.arange(len(x)) * 3
    ask = np.arange(0, len(x), max(1, len(x) // 60))
    got = hnsw.Shard(ids, x).nearest(ids[ask], x[ask], 10, 192)
    hit = total = 0
    for at, (rows, d) in zip(ask, got):
        want, exact = brute(ids, x, x[at], ids[at])
        assert len(rows) == min(10, len(x) - 1)
        assert np.allclose(d, exact[rows], rtol=1e-13, atol=0) and (np.diff(d) >= 0).all()
        hit, total = hit + len(set(want) & set(rows)), total + len(want)
    assert hit >= 0.9 * total
    if shape in ("all equal", "three groups"):
        assert hit == total  # ties to the smaller id


def test_query_far_outside_a_shard():
    shard = hnsw.Shard(np.arange(1000), PLAIN[:1000])
    for q in (np.full((1, 16), 1e30), np.full((1, 16), 1e7), np.full((1, 16), 1e300)):
        ((rows, d),) = shard.nearest(np.array([-1]), q, 10, 192)
        want, exact = brute(np.arange(1000), PLAIN[:1000], q[0], -1)
        assert sorted(d.tolist()) == d.tolist() and np.allclose(d, np.sort(exact)[:10], rtol=1e-12)
        assert len(rows) == 10


def test_repeated_ids_and_clashing_columns(spark):
    rows = [(i % 150, [float(v) for v in PLAIN[i]], i, i, i, i, "q") for i in range(300)] + [(5, None, 1, 1, 1, 1, "q"), (None, [1.0] * 16, 1, 1, 1, 1, "q"), (7, [0.0] * 16, 1, 1, 1, 1, "q")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, dim int, shard int, block int, id int, vector string")
    got = hnsw.nearest(hnsw.build_index(df, shard_rows=64), df.filter("vec_id in (0, 100)"), block_rows=2).collect()
    for q, at in ((0, (0, 150)), (100, (100, 250))):
        mine = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == q)
        assert len(mine) >= 10
        ids = np.array([i % 150 for i in range(300)])
        near = {round(float(np.sqrt(((PLAIN[j] - PLAIN[a]) ** 2).sum())), 9) for a in at for j in range(300) if ids[j] != q}
        assert all(round(s, 9) in near for _, _, s in mine)
