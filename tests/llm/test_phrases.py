from __future__ import annotations

import re
from collections import Counter

import brute
import numpy as np
import pytest
from comparing import TESTDATA, assert_same, duck

from concord.llm import phrases
from concord.llm.oracle import phrases_sql


def counted(rows, longest):
    found = Counter()
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", brute.lower(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            for n in range(1, longest + 1):
                found.update(("und" if lang is None else lang, " ".join(w[i : i + n])) for i in range(len(w) - n + 1))
    return found


def best(rows, threshold, longest, limit, percent):
    f = counted(rows, longest)
    cand = {p: a for p, a in f.items() if " " in p[1] and a >= threshold}
    totals = Counter()
    for (lang, p), a in f.items():
        totals[lang] += a if " " not in p else 0
    found = []
    for (lang, p), a in cand.items():
        w = p.split(" ")
        cuts = [(f[lang, " ".join(w[:k])], f[lang, " ".join(w[k:])]) for k in range(1, len(w))]
        score, k = min((10**6 * a * a // (l * r), k) for k, (l, r) in enumerate(cuts))
        inside = [
            b for (g, q), b in cand.items() if g == lang and len(q.split(" ")) > len(w) and f" {p} " in f" {q} "
        ]
        if not any(100 * b >= percent * a for b in inside):
            found.append((lang, -score, -a, p.encode(), *cuts[k], totals[lang]))
    ranks, result = Counter(), []
    for lang, score, a, p, l, r, n in sorted(found):
        ranks[lang] += 1
        if ranks[lang] <= limit:
            result.append((lang, ranks[lang], p.decode(), -a, l, r, n, -score))
    return sorted(result)


AWKWARD = (
    [("en", t) for _, t in brute.AWKWARD]
    + [(None, "New York is big, new york is NEW york! a\tb a b\x1ca b")] * 3
    + [("de", "a b c d a b c d. a b c! x a b")] * 4
    + [("", "ä ö ä ö ß ä ö")] * 2
    + [("und", "new york"), ("fr", "..,,;;"), ("en x", "b c b c b c")]
)


@pytest.mark.parametrize(
    # So few slots that phrases share them: some start early, none is counted wrongly.
    ("threshold", "longest", "shards", "slots"), [(2, 3, 2, 1 << 16), (3, 2, 1, 64), (2, 4, 2, 64), (2, 1, 2, 64)]
)
def test_awkward_texts(spark, threshold, longest, shards, slots):
    schema = "lang string, text string, phrase string, f int, words int, n int, shard int, rank int"
    docs = spark.createDataFrame([(g, t, "p", 1, 2, 3, 4, 5) for g, t in AWKWARD], schema).repartition(3)
    found = phrases.collocations(docs, threshold, longest, 30, 50, shards, slots)
    assert sorted(map(tuple, found.collect())) == best(AWKWARD, threshold, longest, 30, 50)


def test_empty_table(spark):
    assert phrases.collocations(spark.createDataFrame([], "lang string, text string")).collect() == []


def test_short_stretches_and_other_settings(spark, monkeypatch):
    monkeypatch.setattr(phrases, "WORDS_AT_ONCE", 500)
    folder = TESTDATA / "sf0.001"
    found = phrases.collocations(spark.read.parquet(f"{folder}/documents.parquet"), 5, 4, 100, 80, 2)
    assert_same(found, duck(folder), phrases_sql(5, 4, 100, 80))


def test_exact_where_products_pass_64_bits(spark):
    big = [("en", 1, "x", 10**14), ("en", 1, "y", 10**14 - 1), ("en", 2, "x y", 10**14 - 3)]
    counts = spark.createDataFrame(big, "lang string, words int, phrase string, f long")
    assert phrases.scored(counts).first()["score"] == 10**6 * (10**14 - 3) ** 2 // (10**14 * (10**14 - 1))


def test_counting_begins_when_subphrases_are_frequent(spark):
    """The scan stops early when nothing longer starts late, and runs further cycles when something does."""
    rare = spark.createDataFrame([("en", "one two three")] * 4, "lang string, text string").coalesce(1)
    assert phrases.phrase_counts(rare, threshold=10).where("words > 1").count() == 0
    late = spark.createDataFrame([("en", "one two three")] * 12, "lang string, text string").coalesce(1)
    found = {r.phrase: r.f for r in phrases.phrase_counts(late, threshold=12).collect()}
    assert found == {p: 12 for p in ("one", "two", "three", "one two", "two three", "one two three")}


def test_blocks_of_hashes_come_back_whole_and_small():
    """A million pairs of a stretch take few bytes each, in whichever number of ranges, and merge to the same sums."""
    draw = np.random.default_rng(5)
    keys = np.unique(draw.integers(0, 1 << phrases.HASH_BITS, 1 << 20).astype(np.uint64))
    counts = draw.integers(1, 12, len(keys))
    for bins in (1, 51):
        blocks = list(phrases.blocks_of(keys, counts, bins))
        assert np.array_equal(np.concatenate([phrases.keys_of(n, first, gaps) for n, _, first, gaps, _ in blocks]), keys)
        assert sum(len(gaps) + len(times) for *_, gaps, times in blocks) <= 4 * len(keys)
        assert [b for _, b, *_ in blocks] == list(range(bins))


def test_rare_phrases_of_the_greatest_length_are_not_counted_as_texts():
    """Triples of frequent pairs travel as hashes until they reach the threshold themselves."""
    stream, words = np.array([1, 2, 3, 0, 1, 2, 0, 2, 3, 0]), np.arange(4, dtype=np.uint64)
    since = [np.zeros(64, np.uint8), np.zeros(64, np.uint8), np.full(64, phrases.NEVER, np.uint8)]
    found = [(n, members is None) for n, members, _, _ in phrases.count_stretch(stream, words, 1, 2, 3, since)]
    assert (3, True) in found and (3, False) not in found and (2, False) in found


@pytest.mark.parametrize("n", [2, 3, 4])
def test_distinct_phrases_of_many_words(n):
    """Phrases are told apart alike whether or not their word numbers fit into one number."""
    draw = np.random.default_rng(9)
    for kinds in (4, 1 << 22):
        stream = draw.integers(1, kinds, 3000) // draw.choice([1, kinds // 3], 3000) + 1
        place = np.arange(len(stream) - n)
        members, counts = phrases.distinct(stream, place, n)
        want = Counter(tuple(stream[i : i + n].tolist()) for i in place)
        assert dict(zip(map(tuple, members.tolist()), counts.tolist())) == want


def test_a_task_sends_a_word_once_for_two_million(spark):
    docs = spark.createDataFrame([("en", b"a b " * 30_000)] * 25, "lang string, text binary").coalesce(1)
    since = [spark.sparkContext.broadcast(phrases.zlib.compress(bytes([phrases.NEVER]) * 64, 1)) for _ in range(2)]
    found = phrases._count_step(docs, 0, 4, 2, since, 4).where("words = 1").collect()
    assert sorted((r.lang, r.phrase, r.f) for r in found) == [("en", "a", 750_000), ("en", "b", 750_000)]
