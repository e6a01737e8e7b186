"""Plain Python versions that the tests compare with, and small tables with the awkward rows."""

from __future__ import annotations

import re
import zlib
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
AWKWARD = [
    (1, "the quick brown fox jumps over the lazy dog again and again"),
    (2, "the quick brown fox jumps over the lazy dog again and again"),
    (2, "the quick brown fox jumps over the lazy dog again and again"),
    (3, ""),
    (4, None),
    (None, "a text without an id"),
    (None, None),
    (5, " \t\n\x0b\x0c\r "),
    (6, "word"),
    (7, "äöü ß 漢字 \U0001f600 é  x <|endoftext|> it's don't.,!"),
    (8, "long " * 30_000),
    (9, "line one\nline one\n\nline two\nline one\n \n"),
    (10, "x" * 50_000),
]
SCHEMA = "doc_id long, text string"


def awkward(spark):
    """The awkward rows, with columns whose names could clash with those of the operators."""
    rows = [(i, t, "en", f"s{k % 3}", 1, "x", 2.0, 3) for k, (i, t) in enumerate(AWKWARD)]
    return spark.createDataFrame(
        rows, SCHEMA + ", lang string, source string, n_chars long, fp string, score double, sequence_id int"
    )


def empty(spark):
    return spark.createDataFrame([], SCHEMA + ", lang string, source string, n_chars long")


def lower(text: str | None) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def words(text: str | None) -> list[str]:
    return WORD.findall(text or "")


def fold(doc_id, folds: int) -> int:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % folds


def roots(nodes, pairs):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        parent[find(a)] = find(b)
    return {n: find(n) for n in nodes}


def rule_counts(text: str | None) -> dict[str, int]:
    text = text or ""
    w = words(text)
    lines = [x for x in text.split("\n") if words(x)]
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    often = Counter(windows)
    covered = {i + k for i, x in enumerate(windows) if often[x] > 1 for k in range(8)}
    return {
        "n_words": len(w),
        "word_chars": sum(map(len, w)),
        "n_symbols": sum(text.count(c) for c in "#*$%&|<>"),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(covered),
    }
