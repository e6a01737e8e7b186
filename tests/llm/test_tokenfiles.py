from __future__ import annotations

import numpy as np
import public_tokenizers
import pytest
from brute import awkward, empty

from concord.llm import tokenfiles
from concord.llm.common import table


def plain_counts(tokens, end):
    out, n = [], 0
    for t in tokens:
        if t == end:
            out.append(n)
            n = 0
        else:
            n += 1
    return out + [n] * (n > 0)


@pytest.mark.parametrize("span", [1, 2, 5, 4096])
def test_stitching_across_blocks_and_spans(spark, span):
    rng = np.random.default_rng(span)
    rows, want = [], {}
    for f, density in enumerate((0.0, 0.5, 0.05, 0.01, 1.0)):
        tokens = np.where(rng.random(157) < density, 9, 1).astype("<u2")
        if f == 3:
            tokens[:] = 1
            tokens[[0, 100, 156]] = 9
        want |= {(f"f{f}", i): n for i, n in enumerate(plain_counts(tokens, 9))}
        rows += [(f"f{f}", b, tokens[b * 10 : b * 10 + 10].tobytes()) for b in range(16)]
    blocks = spark.createDataFrame(rows, "file string, block long, data binary")
    found = tokenfiles.stitched(tokenfiles.scan_blocks(blocks, 9), span).collect()
    assert {(r.file, r.ordinal): r.n_tokens for r in found} == want and len(found) == len(want)


def test_files_on_disk(spark, tmp_path):
    rng = np.random.default_rng(1)
    want = {}
    for name, n in (("a", 70_000), ("b", 3), ("c", 65_536 * 2), ("empty", 0)):
        tokens = np.where(rng.random(n) < 0.0005, 50_256, 7).astype("<u2")
        tokens.tofile(tmp_path / name)
        want |= {(name, i): c for i, c in enumerate(plain_counts(tokens, 50_256))}
    found = tokenfiles.token_counts(spark, f"file://{tmp_path}").collect()
    assert {(r.file.rsplit("/", 1)[1], r.ordinal): r.n_tokens for r in found} == want


@pytest.mark.parametrize("which", ["table", "awkward"])
def test_documents(spark, which):
    docs = awkward(spark) if which == "awkward" else table(spark, "/root/testdata/sf0.001", "documents")
    encode = tokenfiles.encoding(public_tokenizers.path(tokenfiles.VOCABULARY)).encode_ordinary
    want = sorted((str(r.doc_id), len(encode(r.text or ""))) for r in docs.collect())
    found = tokenfiles.document_tokens(docs).collect()
    assert sorted((str(r.doc_id), r.n_tokens) for r in found) == want


def test_empty(spark):
    assert tokenfiles.document_tokens(empty(spark)).count() == 0
