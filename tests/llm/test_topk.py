from __future__ import annotations

import math

import numpy as np
import pytest

from concord.llm import topk
from concord.llm.common import table

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, k=20, step=20):
    usable = [
        (at, i, [math.floor(64 * float(x)) for x in v])
        for at, (i, v) in enumerate(rows)
        if v and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = []
    for at, i, q in usable:
        if i is None or i % step:
            continue
        scored = [
            (-sum(a * b for a, b in zip(q, v)), j is None, j or 0)
            for other, j, v in usable
            if other != at and len(v) == len(q)
        ]
        out += [(i, n, None if no else j, -s) for n, (s, no, j) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=lambda r: (r[0], r[1], r[2] is None, r[2] or 0))


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: (r[0], r[1], r[2] is None, r[2] or 0))


def test_whole_table(spark):
    vectors = table(spark, "/root/testdata/sf0.001", "embeddings")
    assert found(topk.top_k(vectors)) == plain([(r.vec_id, r.embedding) for r in vectors.collect()])


def test_small_blocks_and_many_ties(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 4) / 4], 0) for i in range(400)]
    rows += [(1000 + i, [0.25, 0.5, -0.5, 0.25], 0) for i in range(150)]
    vectors = spark.createDataFrame(rows, SCHEMA)
    assert found(topk.top_k(vectors, pivots=5, block_rows=16, k=7)) == plain([r[:2] for r in rows], k=7)


def test_awkward_rows(spark):
    rows = [
        (0, [1.0, 2.0], 0), (20, [0.5, -1.0], 0), (20, [0.5, -1.0], 0), (1, [1.0, 2.0], 0), (None, [3.0, 3.0], 0),
        (2, None, 0), (3, [], 0), (40, [float("nan"), 1.0], 0), (60, [float("inf"), 1.0], 0), (4, [None, 1.0], 0),
        (80, [1.0, 2.0, 3.0], 0), (5, [0.1, 0.2, -0.3], 0), (100, [7.0], 0), (120, [0.0, 0.0], 0), (-20, [-0.01, 0.01], 0),
    ]
    vectors = spark.createDataFrame(rows, SCHEMA)
    assert found(topk.top_k(vectors)) == plain([r[:2] for r in rows])
    assert topk.top_k(spark.createDataFrame([], SCHEMA)).count() == 0
    with pytest.raises(ValueError):
        topk.top_k(spark.createDataFrame([(0, [1e9], 0), (1, [1e9], 0)], SCHEMA))


def test_equal_vectors(spark):
    rows = [(i, [0.5, 0.5, 0.1], 0) for i in range(90)]
    assert found(topk.top_k(spark.createDataFrame(rows, SCHEMA), block_rows=8)) == plain([r[:2] for r in rows])


def test_pivot_bounds_hold():
    rng = np.random.default_rng(2)
    x = rng.integers(-60, 60, (300, 8)).astype(float)
    top = float((x * x).sum(axis=1).max())
    pivots = topk.spread_pivots(topk.lift(x, top), 6)
    tables = topk.distances(topk.lift(x, top), pivots)
    q = x[:20]
    asked = topk.distances(np.concatenate((q, np.zeros((20, 1))), axis=1), pivots)
    low = np.abs(asked[:, None, :] - tables[None]).max(axis=2)
    real = np.sqrt(np.maximum((q * q).sum(axis=1)[:, None] + top - 2 * q @ x.T, 0))
    assert (low <= real + 1e-6).all()
