from __future__ import annotations

import itertools
import zlib

import numpy as np
import pytest
from brute import awkward, empty

from concord.llm import sharding
from concord.llm.common import table


def check(rows, docs, shards=8):
    want = sorted((str(i), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in docs)
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in rows) == want
    assert all(r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < shards for r in rows)
    for s in range(shards):
        slots = sorted(r.slot for r in rows if r.shard == s)
        assert slots == list(range(len(slots)))
    home = {}
    for r in rows:
        assert home.setdefault((r.text_crc32, r.size), r.shard) == r.shard
    return np.bincount([r.shard for r in rows], weights=[r.size for r in rows], minlength=shards)


@pytest.mark.parametrize("which", ["table", "awkward"])
def test_law(spark, which):
    docs = awkward(spark) if which == "awkward" else table(spark, "/root/testdata/sf0.01", "documents")
    loads = check(sharding.shard(docs).collect(), [tuple(r) for r in docs.select("doc_id", "text").collect()])
    if which == "table":
        assert loads.max() - loads.min() <= 0.001 * loads.sum()


def test_levels_agree_with_balance(spark):
    rng = np.random.default_rng(3)
    sizes = rng.integers(1, 5000, 3000).tolist() + [1_000_000]
    items = spark.createDataFrame([(str(i), s) for i, s in enumerate(sizes)], "item string, size long")
    placed = {int(r["item"]): r["shard"] for r in sharding.assign(items, 8, cell=256, parts=16).collect()}
    assert sorted(placed) == list(range(len(sizes)))
    loads = np.bincount([placed[i] for i in range(len(sizes))], weights=sizes, minlength=8)
    small = sum(sizes[:-1]) - loads.max() + 1_000_000
    assert loads.max() - loads.min() <= 2000 or loads.max() <= 1_000_000 + small / 100


def test_differencing_against_all_partitions():
    rng = np.random.default_rng(4)
    for _ in range(20):
        sizes = rng.integers(1, 50, 7)
        part = sharding.difference(sizes, 2)
        got = abs(sizes[part == 0].sum() - sizes[part == 1].sum())
        best = min(abs(sum(s if p else -s for s, p in zip(sizes, ps))) for ps in itertools.product((0, 1), repeat=7))
        assert best <= got <= best + sizes.max()


def test_known_example():
    part = sharding.difference(np.array([8, 7, 6, 5, 4]), 2)
    loads = np.bincount(part, weights=[8, 7, 6, 5, 4])
    assert sorted(loads) == [14, 16]


def test_empty(spark):
    assert sharding.shard(empty(spark)).count() == 0
