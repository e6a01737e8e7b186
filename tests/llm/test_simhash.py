from __future__ import annotations

import numpy as np
import pytest
import xxhash
from brute import awkward, empty, lower, roots, words

from concord.llm import simhash
from concord.llm.common import table
from concord.llm.components import components


def plain_fingerprint(text, width=4):
    w = words(lower(text))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + width]) for i in range(max(1, len(w) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def expected(rows, radius=4):
    prints = [plain_fingerprint(text) for _, text in rows]
    nodes = sorted(set(prints))
    values = np.array(nodes, dtype=np.uint64)
    near = np.bitwise_count(values[:, None] ^ values[None, :]) <= radius
    root = roots(nodes, [(nodes[i], nodes[j]) for i, j in zip(*np.nonzero(np.triu(near, 1)))])
    least = {}
    for (doc_id, _), p in zip(rows, prints):
        old = least.get(root[p])
        least[root[p]] = doc_id if old is None else old if doc_id is None else min(old, doc_id)
    return [(doc_id, f"{p:016x}", least[root[p]]) for (doc_id, _), p in zip(rows, prints)]


def key(row):
    return tuple((x is not None, x or 0) if not isinstance(x, str) else (True, x) for x in row)


def test_whole_table_against_all_pairs(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    found = [tuple(r)[:3] for r in simhash.near_duplicates(docs).collect()]
    assert sorted(found, key=key) == sorted(expected(rows), key=key)


def test_awkward_rows(spark):
    docs = awkward(spark)
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    found = [tuple(r)[:3] for r in simhash.near_duplicates(docs).collect()]
    assert sorted(found, key=key) == sorted(expected(rows), key=key)


def test_keep_one(spark):
    docs = awkward(spark)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    groups = simhash.near_duplicates(docs).select("node").distinct().count()
    rows = kept.collect()
    assert len(rows) == groups
    assert sorted(r.doc_id for r in rows if r.doc_id in (1, 2)) == [1]


def test_empty(spark):
    assert simhash.near_duplicates(empty(spark)).count() == 0
    assert simhash.keep_one(empty(spark)).count() == 0


@pytest.mark.parametrize("radius", [0, 1, 3, 4, 7])
def test_bit_sliced_comparison(radius):
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    flips = rng.integers(0, 64, (400, 6))
    values = base[rng.integers(0, 40, 400)]
    for i in range(6):
        values = np.where(rng.random(400) < 0.4, values ^ (np.uint64(1) << flips[:, i].astype(np.uint64)), values)
    runs = np.sort(rng.integers(0, 7, 400))
    linked = simhash.run_links(runs, values, radius)
    nodes = [(int(r), int(v)) for r, v in zip(runs, values)]
    pairs = [
        (nodes[i], nodes[j])
        for i in range(400)
        for j in range(i)
        if runs[i] == runs[j] and int(values[i] ^ values[j]).bit_count() <= radius
    ]
    want = roots(set(nodes), pairs)
    unsigned = [(a & (1 << 64) - 1, b & (1 << 64) - 1) for a, b in linked]
    of_value = {}
    for r, v in set(nodes):
        of_value.setdefault(v, set()).add(r)
    got = roots(set(nodes), [((r, a), (r, b)) for a, b in unsigned for r in of_value[a] & of_value[b]])
    same = lambda m: {frozenset(n for n in m if m[n] == root) for root in set(m.values())}
    for links_at in unsigned:
        assert int(links_at[0] ^ links_at[1]).bit_count() <= radius * 64
    # Links of one run may join equal values of another run, never separate what is linked.
    assert all(any(w <= g for g in same(got)) for w in same(want))


def test_large_buckets_are_cut_without_loss(spark):
    rng = np.random.default_rng(5)
    values = {0}
    while len(values) < 600:
        values |= {int(v) ^ 1 << int(b) for v, b in zip(rng.choice(list(values), 50), rng.integers(0, 60, 50))}
    nodes = spark.createDataFrame([(v,) for v in values], "fp long")
    cut = [tuple(r) for r in simhash.links(nodes, 4, block_rows=64).collect()]
    whole = [tuple(r) for r in simhash.links(nodes, 4).collect()]
    same = lambda m: {frozenset(n for n in m if m[n] == r) for r in set(m.values())}
    assert same(roots(values, cut)) == same(roots(values, whole))


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(0, 60)]
    star = [(1000, i) for i in range(1001, 1040)]
    found = {r.node: r.root for r in components(spark.createDataFrame(chain + star + [(7, 7)], "a long, b long")).collect()}
    assert len({found[i] for i in range(61)}) == 1 and len({found[i] for i in range(1000, 1040)}) == 1
    assert found[0] != found[1000]
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
