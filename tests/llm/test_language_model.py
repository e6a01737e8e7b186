from __future__ import annotations

import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from brute import awkward, empty, fold, lower, words

from concord.llm import common, kneser_ney
from concord.llm.common import table
from concord.llm.queries import op2_kneser_ney


def plain_model(texts, order):
    """Modified Kneser-Ney over tuples of words."""
    raw = Counter()
    for text in texts:
        tokens = ["<s>"] * (order - 1) + words(lower(text)) + ["</s>"]
        raw.update(tuple(tokens[i - order + 1 : i + 1]) for i in range(order - 1, len(tokens)))
    grams = {order: raw}
    for m in range(order - 1, 0, -1):
        grams[m] = Counter(g[1:] for g in grams[m + 1])
    unigrams = Counter()
    for g, c in raw.items():
        unigrams[g[-1]] += c
    cut = {m: kneser_ney.discounts(*(sum(c == i for c in grams[m].values()) for i in (1, 2, 3, 4))) for m in grams}
    total = {m: defaultdict(int) for m in grams}
    taken = {m: defaultdict(float) for m in grams}
    for m in grams:
        for g, c in grams[m].items():
            total[m][g[:-1]] += c
            taken[m][g[:-1]] += cut[m][min(c, 3) - 1]

    def less(m, c):
        return max(c - (0, *cut[m])[min(c, 3)], 0)

    def probability(gram):
        m = len(gram)
        if m == 0:
            return 1 / (max(len(unigrams), 1) + 1)
        head = gram[:-1]
        if head not in total[m]:
            return probability(gram[1:])
        return (less(m, grams[m].get(gram, 0)) + taken[m][head] * probability(gram[1:])) / total[m][head]

    def score(text):
        tokens = ["<s>"] * (order - 1) + words(lower(text)) + ["</s>"]
        return sum(math.log10(probability(tuple(tokens[i - order + 1 : i + 1]))) for i in range(order - 1, len(tokens)))

    return unigrams, score


@pytest.mark.parametrize("order", [2, 3, 4])
@pytest.mark.parametrize("which", ["table", "awkward"])
def test_against_plain_model(spark, order, which):
    docs = awkward(spark) if which == "awkward" else table(spark, "/root/testdata/sf0.001", "documents")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    unigrams, score = plain_model([t for i, t in rows if fold(i, 10)], order)
    n, v = sum(unigrams.values()), len(unigrams)
    want = []
    for doc_id, text in rows:
        tokens = [*words(lower(text)), "</s>"]
        base = sum(math.log10((unigrams[t] + 0.1) / (n + 0.1 * (v + 1))) for t in tokens)
        want.append((doc_id, fold(doc_id, 10) == 0, len(tokens), sum(unigrams[t] > 0 for t in tokens), n, base, score(text)))
    found = [tuple(r)[:7] for r in kneser_ney.language_model_scores(docs, order).collect()]
    order_ = lambda r: (r[0] is not None, r[0] or 0, r[2])
    for a, b in zip(sorted(found, key=order_), sorted(want, key=order_), strict=True):
        assert a[:5] == b[:5]
        assert a[5] == pytest.approx(b[5], rel=1e-9) and a[6] == pytest.approx(b[6], rel=1e-6)


def test_beats_the_base_on_held_out_texts(spark):
    found = kneser_ney.language_model_scores(table(spark, "/root/testdata/sf0.01", "documents")).where("held_out").collect()
    assert sum(r.score for r in found) > sum(r.base_score for r in found)


def test_probabilities_of_a_context_sum_to_one(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["a b a c", "b a b", "a a a b c d", "d e f a"])], "doc_id long, text string")
    model = kneser_ney.train(docs, order=2)
    arrays = kneser_ney.Arrays(model.folder)
    vocabulary = ["a", "b", "c", "d", "e", "f", "unheard"]
    for context in ("a", "d", "unheard"):
        total = 0.0
        for word in vocabulary:
            flat = kneser_ney.hashes(f"{context} {word}".encode(), 2)
            total += kneser_ney.probabilities(model, arrays, flat)[0][2]
        total += kneser_ney.probabilities(model, arrays, kneser_ney.hashes(context.encode(), 2))[0][2]
        assert total == pytest.approx(1.0, abs=1e-9)


def test_empty(spark):
    assert kneser_ney.language_model_scores(empty(spark)).count() == 0
    some = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    model = kneser_ney.train(empty(spark))
    assert all(r.n_known == 0 and r.score < 0 for r in kneser_ney.score(some, model).collect())


def test_query_takes_a_middle_order(spark, tmp_path):
    """The registered query is the model of order 3, whose interpolation has an order between words and whole n-grams."""
    rows = [(i, "a b c a b d") for i in range(1, 30)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    scores = lambda df: sorted(tuple(r) for r in df.collect())
    found = scores(op2_kneser_ney(spark, str(tmp_path)))
    assert found == scores(kneser_ney.language_model_scores(docs, 3))
    assert found != scores(kneser_ney.language_model_scores(docs, 2))


@pytest.mark.parametrize("kinds", [5, 1 << 30])
def test_blocks_come_back_whole_and_small(kinds):
    """n-grams of a block come back as they were, whatever the number of words, in far fewer bytes than their hashes."""
    draw = np.random.default_rng(3)
    words = np.unique(draw.integers(0, 1 << 63, 3000).astype(np.uint64))
    columns = [draw.integers(0, len(words), 60_000).astype(np.uint32) for _ in range(3)]
    columns, counts = kneser_ney.summed(columns, max(kinds, len(words)), np.full(60_000, 300))
    rows = sorted(zip(*(words[c].tolist() for c in columns), counts.tolist()))
    blocks = kneser_ney._dealt(3, 4, words, columns, counts)
    assert sum(len(x) for b in blocks for x in b if isinstance(x, bytes)) < 12 * len(counts)
    found = []
    for block in kneser_ney._table(blocks).to_pylist():
        names, some, times = kneser_ney._decoded([block])
        found += zip(*(names[c].tolist() for c in some), times.tolist())
    assert sorted(found) == rows


@pytest.mark.parametrize("order", [2, 4])
def test_followers_of_frequent_words_are_spread(spark, monkeypatch, order):
    """With many shards the words behind a frequent word lie in several, and sums over the followers of a context come from all."""
    monkeypatch.setattr(kneser_ney, "shuffle_partitions", lambda _: 40)
    draw = np.random.default_rng(4)
    rows = [(i, " ".join(f"w{min(int(x), 60)}" for x in draw.zipf(1.3, 30))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    model = kneser_ney.train(docs, order=order)
    assert model.heavy[1].max() > 2
    _, score = plain_model([t for _, t in rows], order)
    found = {r.doc_id: r.score for r in kneser_ney.score(docs, model).collect()}
    for doc_id, text in rows:
        assert found[doc_id] == pytest.approx(score(text), rel=1e-6)


def test_disk_is_bounded_by_the_input(spark, tmp_path, monkeypatch):
    """What the training leaves in the shared folder takes few bytes for each n-gram of an order."""
    texts = table(spark, "/root/testdata/sf0.01", "documents")
    grams = {order: set() for order in (2, 3)}
    for (text,) in texts.select("text").collect():
        tokens = ["<s>", "<s>", *words(lower(text or "")), "</s>"]
        for order, found in grams.items():
            found.update(tuple(tokens[i - order + 1 : i + 1]) for i in range(2, len(tokens)))
    monkeypatch.setattr(common, "ensure_checkpoint_dir", lambda _: str(tmp_path))
    kneser_ney.train(texts)
    used = sum(p.stat().st_size for p in tmp_path.rglob("*") if p.is_file())
    assert 0 < used < 20 * (len(grams[2]) + len(grams[3]))
