from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
import pytest
from brute import awkward, empty

from concord.llm import packing
from concord.llm.common import table


def check(rows, limit=4096):
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= limit
    return len(by_sequence)


def expected_pieces(rows):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    tokenizer.encode_special_tokens = True
    out = []
    for doc_id, text in rows:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], dtype="<u4")
        for piece, start in enumerate(range(0, len(ids), 4096)):
            part = ids[start : start + 4096]
            out.append((doc_id, piece, start, len(part), zlib.crc32(part.tobytes())))
    return out


def order(row):
    return tuple((x is not None, x or 0) for x in row)


@pytest.mark.parametrize("which", ["table", "awkward"])
def test_pieces_and_places(spark, which):
    docs = awkward(spark) if which == "awkward" else table(spark, "/root/testdata/sf0.001", "documents")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    found = packing.pack(docs).collect()
    assert sorted((tuple(r)[:5] for r in found), key=order) == sorted(expected_pieces(rows), key=order)
    tokens = sum(r.length for r in found)
    assert check(found) <= 1.05 * tokens / 4096 + 2


def test_groups_cost_few_sequences(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    whole = check(packing.pack(docs).collect())
    cut = check(packing.pack(docs, group_pieces=128, loose_pieces=64).collect())
    assert cut <= whole * 1.05


def test_empty(spark):
    assert packing.pack(empty(spark)).count() == 0


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_every_capacity_holds(rule):
    rng = np.random.default_rng(2)
    lengths = np.concatenate((rng.integers(1, 60, 400), rng.integers(200, 900, 60)))
    capacity = packing.Capacity(tokens=1024, documents=7, attention=500_000, rule=rule)
    lengths = np.minimum(lengths, capacity.longest)
    sequence, offset = packing.best_fit(lengths, capacity)
    for s in set(sequence.tolist()):
        own = lengths[sequence == s]
        assert own.sum() <= 1024 and len(own) <= 7 and (own**2).sum() <= 500_000
        at = offset[sequence == s]
        assert sorted(at) == np.concatenate(([0], np.cumsum(own[np.argsort(at)])[:-1])).tolist()


def test_norm_rule_is_best_fit_when_tokens_alone_count():
    lengths = np.array([6, 5, 4, 3, 2])
    capacity = packing.Capacity(tokens=10, documents=100, attention=100, weights=(1.0, 0.0, 0.0))
    sequence, _ = packing.best_fit(lengths, capacity)
    assert sequence.tolist() == [0, 1, 0, 1, 1]


def test_impossible_capacities_are_refused():
    with pytest.raises(ValueError):
        packing.Capacity(tokens=0)
    with pytest.raises(ValueError):
        packing.Capacity(rule="worst")


def test_every_limit_can_bind(spark):
    """Placed pieces keep within documents and attention cost where these, not the tokens, fill a sequence."""
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    for documents, attention in ((3, 4096 * 4096), (4096, 300_000)):
        capacity = packing.Capacity(tokens=4096, documents=documents, attention=attention)
        sequences = {}
        for r in packing.pack(docs, capacity=capacity).collect():
            sequences.setdefault(r.sequence_id, []).append(r.length)
        assert max(map(len, sequences.values())) <= documents
        assert max(sum(n * n for n in x) for x in sequences.values()) <= attention
        full = [x for x in sequences.values() if len(x) == documents or sum(n * n for n in x) > 0.8 * attention]
        assert len(full) > len(sequences) / 2


def test_many_equal_rows_fill_their_sequences(spark):
    docs = spark.createDataFrame([(None, "")] * 3000 + [(7, "one two")] * 3000, "doc_id long, text string")
    found = packing.pack(docs, group_pieces=500, loose_pieces=100).collect()
    assert len(found) == 6000 and check(found) <= 4


def test_fewer_remembered_words_give_the_same_pieces(spark):
    docs = spark.range(300).selectExpr("id AS doc_id", "repeat(concat(sha(CAST(id AS STRING)), ' The cat; '), 1 + int(id % 9)) AS text")
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    whole = packing.pack(docs).select(*columns).collect()
    assert sorted(packing.pack(docs, memo_words=50, at_once=500).select(*columns).collect()) == sorted(whole)
