from __future__ import annotations

import hashlib
import math

import numpy as np
import pytest
from comparing import TESTDATA, assert_same, duck

from concord.llm import bitplanes
from concord.llm.oracle import clusters_sql

SCHEMA = "vec_id long, embedding array<float>, cluster string, x int, planes string"


def lloyd(rows, k=40, rounds=5, scale=256, seed=2):
    """One vector, one component after the other."""
    kept = [
        (i, [math.floor(scale * float(x)) for x in v])
        for i, v in rows
        if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)
    ]
    name = lambda i: hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    centers = [v for _, v in sorted(kept, key=lambda r: (name(r[0]), r[1]))[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centers))

    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(nearest(v)[1], []).append(v)
        centers = [[sum(x) // len(groups[n]) for x in zip(*groups[n])] if n in groups else c for n, c in enumerate(centers)]
    found = [(i, *nearest(v)[::-1]) for i, v in kept]
    total = {n: sum(d for _, c, d in found if c == n) for n in range(len(centers))}
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centers]
    return sorted(((i, c, d, total[c], sum(total.values()), sha[c]) for i, c, d in found), key=str)


def test_planes_hold_every_number():
    rng = np.random.default_rng(1)
    for planes in (1, 2, 9, 28):
        x = rng.integers(-(2 ** (planes - 1)), 2 ** (planes - 1), (50, 64))
        packed = bitplanes.pack_planes(x, planes)
        assert (bitplanes.unpack_planes(packed) == x).all()
        assert (bitplanes.dot_products(packed, packed[:7]) == x @ x[:7].T).all()
        assert (bitplanes.squared_norms(packed) == (x * x).sum(axis=1)).all()


def test_planes_for_limits():
    assert [bitplanes.planes_for(*r) for r in ((0, 0), (-1, 0), (-2, 1), (-3, 1), (0, 4), (-256, 255))] == [1, 1, 2, 3, 4, 9]
    with pytest.raises(OverflowError):
        bitplanes.planes_for(0, 1 << 40)


def awkward(rng):
    rows = [(i, rng.normal(0, 0.4, 64).astype(np.float32).tolist()) for i in range(60)]
    rows += [rows[3], (3, rows[4][1]), (None, rows[5][1]), (None, rows[5][1]), (70, rows[6][1])]
    rows += [(80, None), (81, []), (82, [0.5] * 63), (83, [0.5] * 65), (84, [None] + [0.5] * 63)]
    rows += [(85, [float("nan")] + [0.0] * 63), (86, [float("-inf")] + [0.0] * 63), (87, [0.0] * 64), (88, [100.0] * 64)]
    return rows


@pytest.mark.parametrize("k", [1, 7, 200])
def test_awkward_vectors(spark, k):
    rows = awkward(np.random.default_rng(k))
    df = spark.createDataFrame([(i, v, "c", 1, "p") for i, v in rows], SCHEMA)
    assert sorted(map(tuple, bitplanes.cluster(df, k=k).collect()), key=str) == lloyd(rows, k)


def test_empty_table(spark):
    assert bitplanes.cluster(spark.createDataFrame([], SCHEMA)).collect() == []


def test_more_vectors_than_a_chunk(spark, monkeypatch):
    monkeypatch.setattr(bitplanes, "VECTORS_AT_ONCE", 16)
    folder = TESTDATA / "sf0.001"
    found = bitplanes.cluster(spark.read.parquet(f"{folder}/embeddings.parquet"), k=9, rounds=3, scale=100, seed=5)
    assert_same(found, duck(folder), clusters_sql(9, 3, 100, 5))
