from __future__ import annotations

import numpy as np
import pytest
from brute import awkward, empty, fold

from concord.llm import convnet
from concord.llm.common import table

SMALL = convnet.Shape(chunk=128, overlap=16, filters=12, hidden=6, per_class=200, rounds=10)


@pytest.fixture(scope="module")
def net():
    rng = np.random.default_rng(0)
    good = [b" ".join(rng.choice([b"the", b"cat", b"sat", b"on", b"mats"], rng.integers(5, 200))) for _ in range(120)]
    bad = [b" ".join(rng.choice([b"the$$$", b"cat***", b"on|"], rng.integers(5, 200))) for _ in range(120)]
    return convnet.fit(good + bad, [1] * 120 + [0] * 120, SMALL)


def test_learns_and_looks_at_the_whole_text(net):
    assert net.score(b"the cat sat on the mats the cat sat") > 0.8
    assert net.score(b"the$$$ cat*** on| the$$$ cat***") < 0.2
    clean, junk = b"the cat sat on mats " * 40, b"the$$$ cat*** on| " * 400
    assert net.score(clean + junk) < net.score(clean)


def test_chunks_cover_every_byte():
    for n in (0, 1, 112, 127, 128, 129, 1000):
        covered = set()
        for a in convnet.chunk_starts(n, SMALL):
            covered |= set(range(a, a + SMALL.chunk))
        assert covered >= set(range(n))


def test_scores_alone_and_together_agree(net):
    texts = [b"", b"the cat", b"x" * 5000, b"sat on " * 900]
    together = net.scores(texts)
    assert np.allclose(together, [net.score(t) for t in texts], atol=1e-5)
    assert ((together >= 0) & (together <= 1)).all()


def test_one_class_or_none():
    assert convnet.fit([b"a"], [1], SMALL).score(b"zzz") > 0.9
    assert convnet.fit([b"a"], [0], SMALL).score(b"") < 0.1
    assert convnet.fit([], [], SMALL).score(b"a") == 0.5


def test_awkward_and_empty_tables(spark, net):
    docs = awkward(spark)
    found = convnet.classify(docs, net).collect()
    assert len(found) == docs.count()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in found)
    assert all(r.held_out == (fold(r.doc_id, 5) == 0) for r in found)
    kept = convnet.keep_good(docs, net)
    assert kept.columns == docs.columns and kept.count() == sum(r.predicted for r in found)
    assert convnet.classify(empty(spark), net).count() == 0
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (None, 1, 0), (2, None, 0)], "doc_id long, quality int, toxic int")
    assert convnet.train(docs, labels, shape=SMALL).score(b"a") == 0.5


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    shape = convnet.Shape(per_class=250, rounds=8)
    found = convnet.classify(docs, convnet.train(docs, labels, shape=shape)).where("held_out").join(labels, "doc_id").collect()
    assert sum(r.predicted == r.quality for r in found) / len(found) > 0.93
