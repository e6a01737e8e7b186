from __future__ import annotations

import itertools
import zlib

import public_tokenizers
import pytest
from brute import awkward, empty

from concord.llm import nbest
from concord.llm.common import table


@pytest.fixture(scope="module")
def seg():
    return nbest.Segmenter(public_tokenizers.path(nbest.VOCABULARY), 4)


def all_segmentations(pieces, word):
    ends = pieces.arcs(word)
    found = {0: [(0, ())]}
    for end in range(1, len(word) + 1):
        found[end] = [(s + a, ids + own) for start, a, own in ends[end] for s, ids in found[start]]
    return found[len(word)]


@pytest.mark.parametrize("word", ["▁the", "▁tion", "aaaa", "▁ßöü", "▁漢a", "\U0001f600x", "▁", "▁don't"])
def test_search_against_all_segmentations(seg, word):
    whole = all_segmentations(seg.pieces, word)
    assert len({ids for _, ids in whole}) == len(whole)
    found = nbest.n_best(seg.pieces, word, 6)
    assert [s for s, _ in found] == sorted((s for s, _ in whole), reverse=True)[:6]
    assert set(found) <= set(whole) and len(set(found)) == len(found)
    score, ids, loss = seg.lattices.solve([word])[0]
    assert score == found[0][0] and seg.pieces.decode(memoryview(ids).cast("I")) == word
    assert loss == (found[0][0] - found[1][0] if len(found) > 1 else loss)


def test_texts_against_all_combinations(seg):
    for text in ("the cat sat", "aa aa", "", "  two  spaces ", "ß漢 it's"):
        words = nbest.words_of(text)
        assert "".join(words) == nbest.MARK + text.replace(" ", nbest.MARK)
        found = next(iter(seg.texts([text])))
        options = [all_segmentations(seg.pieces, w) for w in words]
        best = sorted((sum(o[0] for o in c) for c in itertools.product(*(sorted(o, reverse=True)[:6] for o in options))), reverse=True)
        assert [s for s, _, _ in found] == best[: len(found)] and len(found) == min(4, len(best))
        assert len({ids for _, ids, _ in found}) == len(found) and all(ok for _, _, ok in found)


def test_long_word_with_countless_ties(seg):
    found = nbest.n_best(seg.pieces, "▁" + "a" * 3000, 4)
    assert len(found) == 4 and found == sorted(found, key=lambda x: -x[0])


@pytest.mark.parametrize("which", ["table", "awkward"])
def test_round_trip(spark, which):
    docs = awkward(spark) if which == "awkward" else table(spark, "/root/testdata/sf0.001", "documents")
    encoded = nbest.encode(docs).cache()
    rows = nbest.decode(encoded).collect()
    want = {(str(r.doc_id), r.text or "") for r in docs.collect()}
    assert {(str(r.doc_id), r.text) for r in rows} == want
    assert all(r.decodes and r.n_ids == len(r.ids) for r in rows)
    assert sum(r["rank"] == 1 for r in rows) == docs.count()
    for r in rows[:20]:
        assert r.ids_crc32 == zlib.crc32(nbest.packed(r.ids))


def test_empty(spark):
    assert nbest.decode(nbest.encode(empty(spark))).count() == 0


@pytest.mark.parametrize("text", ["a  b", "   x", "a    ", "if a:\n    b"])
def test_runs_of_spaces_against_the_uncut_text(seg, text):
    """Pieces of several marks are taken: all segmentations of the whole marked text, not of its words."""
    marked = nbest.MARK + text.replace(" ", nbest.MARK)
    want = sorted((s for s, _ in all_segmentations(seg.pieces, marked)), reverse=True)[:4]
    found = next(iter(seg.texts([text])))
    assert [s for s, _, _ in found] == want and all(ok for _, _, ok in found)


def test_texts_are_solved_together_by_number_and_size(monkeypatch):
    monkeypatch.setattr(nbest, "TEXTS_AT_ONCE", 3)
    monkeypatch.setattr(nbest, "CHARACTERS_AT_ONCE", 10)
    texts = ["ab", "", "c", "d", "e" * 30, "f" * 6, "g" * 6, ""]
    parts = [texts[part] for part in nbest.stretches(texts)]
    assert parts == [["ab", "", "c"], ["d"], ["e" * 30], ["f" * 6], ["g" * 6, ""]]
    assert list(nbest.stretches([])) == []
