"""N-best segmentation with the pieces of a SentencePiece vocabulary, and decoding.

A text is cut before each run of white-space marks, which stays with what follows: pieces hold marks only at their
beginning (a vocabulary with others has its texts solved whole). Over the piece lattice of such a word a forward Viterbi pass gives the best score of every prefix; these scores are the exact remaining cost of a backward A*
search from the end of the word, which therefore yields segmentations in order of their score. The best segmentations of
a text are combinations of its words' best, merged one word after the other.
"""

from __future__ import annotations

import heapq
import math
import re
import zlib
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "piece_bpe_32k.model"
MARK = "▁"
WORDS = re.compile(f"{MARK}+[^{MARK}]*")
MEMO_WORDS = 500_000
#: Texts and characters that are solved together: words of many texts share the passes over their length.
TEXTS_AT_ONCE, CHARACTERS_AT_ONCE = 1024, 1 << 22
UNIT = 1_000_000
NEVER = -(1 << 62)


class Pieces:
    """Pieces, ids and scores of a vocabulary file.

    The file holds ranks of merges, not probabilities; a piece's score is the logarithm of its share under Zipf's law,
    -log(rank + 2), in whole millionths, so that sums are exact and equal segmentations tie exactly. A character without a piece is written as its bytes, each with the score of the last rank and one
    more, so that bytes are never preferred.
    """

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.ids: dict[str, int] = {}
        self.score: dict[int, int] = {}
        self.text: dict[int, str] = {}
        self.bytes: dict[int, int] = {}
        size = model.get_piece_size()
        for i in range(size):
            if model.is_byte(i):
                self.bytes[int(model.id_to_piece(i)[3:5], 16)] = i
            elif not (model.is_unknown(i) or model.is_control(i) or model.is_unused(i)):
                piece = model.id_to_piece(i)
                self.ids[piece] = i
                self.score[i] = -round(UNIT * math.log(-model.get_score(i) + 2))
                self.text[i] = piece
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.byte_score = -round(UNIT * (math.log(size + 2) + 1))
        self.longest = max(map(len, self.ids), default=1)
        #: Whether a piece reaches from one word into the next.
        self.across = any(len(WORDS.findall(MARK + piece)) > 1 for piece in self.ids)

    def arcs(self, word: str) -> list[list[tuple[int, int, tuple[int, ...]]]]:
        """For each end position the arcs that end there: start, score, ids."""
        ends: list[list[tuple[int, int, tuple[int, ...]]]] = [[] for _ in range(len(word) + 1)]
        for start in range(len(word)):
            for end in range(start + 1, min(len(word), start + self.longest) + 1):
                i = self.ids.get(word[start:end])
                if i is not None:
                    ends[end].append((start, self.score[i], (i,)))
            if word[start] not in self.ids:
                raw = tuple(self.bytes[b] for b in word[start].encode())
                ends[start + 1].append((start, self.byte_score * len(raw), raw))
        return ends

    def decode(self, ids: Iterator[int]) -> str:
        """The text of ids; the first mark is the one that encoding added."""
        ids = tuple(ids)
        try:
            return "".join(map(self.text.__getitem__, ids))
        except KeyError:  # some are bytes
            pass
        out, raw = [], bytearray()
        for i in ids:
            if i in self.byte_of:
                raw.append(self.byte_of[i])
                continue
            if raw:
                out.append(raw.decode(errors="replace"))
                raw.clear()
            out.append(self.text[i])
        out.append(raw.decode(errors="replace"))
        return "".join(out)


def n_best(pieces: Pieces, word: str, n: int) -> list[tuple[int, tuple[int, ...]]]:
    """Up to ``n`` best segmentations of ``word`` by score; segmentations of equal score come in a fixed order."""
    ends = pieces.arcs(word)
    best = [0] + [NEVER] * len(word)
    for end in range(1, len(word) + 1):
        best[end] = max((best[s] + score for s, score, _ in ends[end]), default=NEVER)
    # A state is a suffix already cut, as (first piece, rest); what the forward pass knows of the prefix makes its priority
    # the exact score of its best completion. Of equal priorities the state nearest to the beginning goes first.
    agenda: list[tuple] = [(-best[-1], len(word), 0, 0, ())]
    found: list[tuple[int, tuple[int, ...]]] = []
    pushed = 0
    while agenda and len(found) < n:
        _, at, _, done, suffix = heapq.heappop(agenda)
        if at == 0:
            ids: list[int] = []
            while suffix:
                own, suffix = suffix
                ids += own
            found.append((done, tuple(ids)))
            continue
        for start, score, own in ends[at]:
            pushed += 1
            total = done + score
            heapq.heappush(agenda, (-(total + best[start]), start, pushed, total, (own, suffix)))
    return found


def merge_best(left: list[tuple[int, tuple]], right: list[tuple[int, tuple]], n: int) -> list[tuple[int, tuple]]:
    """The ``n`` best sums of one of ``left`` and one of ``right``, both in falling order; the second item of the result
    holds (left item, right item)."""
    heap = [(-(left[0][0] + right[0][0]), 0, 0)]
    seen, out = {(0, 0)}, []
    while heap and len(out) < n:
        total, i, j = heapq.heappop(heap)
        out.append((-total, (left[i][1], right[j][1])))
        for a, b in ((i + 1, j), (i, j + 1)):
            if a < len(left) and b < len(right) and (a, b) not in seen:
                seen.add((a, b))
                heapq.heappush(heap, (-(left[a][0] + right[b][0]), a, b))
    return out


def words_of(text: str) -> list[str]:
    """Spaces become marks, one is put in front, and each run of marks begins a word; joined, the words give the marked
    text. No piece reaches from one word into the next unless it holds a mark behind another character."""
    return WORDS.findall(MARK + text.replace(" ", MARK))


class Lattices:
    """Best segmentation, its score and the loss of the second best, for many words at once.

    Words of one length share numpy arrays: substrings are looked up by polynomial hash, and the forward and backward
    Viterbi passes run over all words together. The second best segmentation has an arc that the best has not, so that the
    best score through any such arc gives its loss.
    """

    BASE = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        texts = list(pieces.ids)
        hashes = np.array([self._hash(t) for t in texts], dtype=np.uint64)
        order = np.argsort(hashes)
        self.hashes = hashes[order]
        self.id_of = np.array([pieces.ids[t] for t in texts], dtype=np.int32)[order]
        self.score_of = np.array([pieces.score[i] for i in self.id_of.tolist()], dtype=np.int64)
        if len(np.unique(self.hashes)) < len(self.hashes):
            raise ValueError("two pieces share a hash")
        self.maybe = np.zeros(1 << 20, dtype=bool)  # most substrings are no piece: they are looked up no further
        self.maybe[self.hashes >> np.uint64(44)] = True

    def _hash(self, text: str) -> int:
        h = 0
        for c in text:
            h = (h * int(self.BASE) + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
        return h

    def solve(self, words: list[str]) -> list[tuple[int, tuple[int, ...], int]]:
        """(score, ids, loss) of each word, all of one length; loss is the score lost by the second best."""
        size = len(words[0])
        code = np.frombuffer("".join(words).encode("utf-32-le"), dtype="<u4").reshape(-1, size).T.astype(np.uint64)
        prefix = np.zeros((size + 1, len(words)), dtype=np.uint64)
        for i in range(size):
            prefix[i + 1] = prefix[i] * self.BASE + code[i] + np.uint64(1)
        power = np.full(size + 1, self.BASE)
        power[0] = 1
        power = np.multiply.accumulate(power)
        arcs: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        for i in range(size):
            for j in range(i + 1, min(size, i + self.pieces.longest) + 1):
                h = prefix[j] - prefix[i] * power[j - i]
                some = np.flatnonzero(self.maybe[h >> np.uint64(44)])
                at = np.minimum(np.searchsorted(self.hashes, h[some]), len(self.hashes) - 1)
                hit = self.hashes[at] == h[some]
                some, at = some[hit], at[hit]
                if not len(some) and j > i + 1:
                    continue
                score, own = np.full(len(words), NEVER), np.full(len(words), -1, dtype=np.int32)
                score[some], own[some] = self.score_of[at], self.id_of[at]
                if j == i + 1 and len(some) < len(words):
                    c = code[i]
                    width = 1 + (c > 0x7F).astype(np.int64) + (c > 0x7FF) + (c > 0xFFFF)
                    score = np.where(own < 0, width * self.pieces.byte_score, score)
                arcs[i, j] = score, own
        forward = np.full((size + 1, len(words)), NEVER, dtype=np.int64)
        forward[0] = 0
        back = np.zeros((size + 1, len(words)), dtype=np.int32)
        for (i, j), (score, _) in sorted(arcs.items(), key=lambda x: (x[0][1], x[0][0])):
            total = np.maximum(forward[i] + score, NEVER)
            better = total > forward[j]
            forward[j] = np.where(better, total, forward[j])
            back[j] = np.where(better, i, back[j])
        backward = np.full_like(forward, NEVER)
        backward[size] = 0
        for (i, j), (score, _) in sorted(arcs.items(), key=lambda x: (-x[0][0], x[0][1])):
            backward[i] = np.maximum(backward[i], np.maximum(score + backward[j], NEVER))
        on_path = np.zeros_like(forward, dtype=bool)
        on_path[size] = True
        for j in range(size, 0, -1):
            at = np.flatnonzero(on_path[j])
            on_path[back[j][at], at] = True
        second = np.full(len(words), NEVER, dtype=np.int64)
        for (i, j), (score, _) in arcs.items():
            through = np.where(on_path[j] & (back[j] == i), NEVER, forward[i] + score + backward[j])
            second = np.maximum(second, through)
        loss = np.maximum(forward[size] - second, 0)
        chosen = np.full((len(words), size), -2, dtype=np.int32)  # -2: no piece begins here, -1: one without an id
        for (i, j), (_, own) in arcs.items():
            on = on_path[j] & (back[j] == i)
            chosen[on, i] = own[on]
        taken = chosen >= 0
        ends = np.cumsum(taken.sum(axis=1)).tolist()
        data = chosen[taken].astype("<u4").tobytes()
        ids = [data[4 * a : 4 * b] for a, b in zip([0, *ends], ends)]
        for k in np.flatnonzero((chosen == -1).any(axis=1)).tolist():
            raw = self.pieces.bytes
            parts = [[x] if x >= 0 else [raw[b] for b in words[k][i].encode()] for i, x in enumerate(chosen[k].tolist()) if x > -2]
            ids[k] = packed(chain.from_iterable(parts))
        return list(zip(forward[size].tolist(), ids, loss.tolist()))


def packed(ids) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    return array("I", ids).tobytes()


class Segmenter:
    """N-best segmentation of texts, remembering words: (score, ids, loss, decodes) of the best, and the n best of those
    words for which a text has asked."""

    LONGEST, AT_ONCE = 48, 1 << 21

    def __init__(self, path: str, n: int):
        self.pieces = Pieces(path)
        self.lattices = Lattices(self.pieces)
        self.n = n
        self.memo: dict[str, tuple[int, bytes, int, bool]] = {}
        self.best: dict[str, list[tuple[int, tuple[int, ...]]]] = {}

    def learn(self, words: set[str]) -> None:
        """Makes sure that ``memo`` holds all of ``words``."""
        new = [w for w in words if w not in self.memo]
        if len(self.memo) + len(new) > MEMO_WORDS:
            self.memo.clear()
            self.best.clear()
            new = words
        by_size: dict[int, list[str]] = {}
        for word in new:
            by_size.setdefault(len(word), []).append(word)
        for size, some in by_size.items():
            if size > self.LONGEST:
                found = [self._alone(w) for w in some]
            else:
                step = max(8, self.AT_ONCE // (size * size))
                found = [x for at in range(0, len(some), step) for x in self.lattices.solve(some[at : at + step])]
            for word, (score, ids, loss) in zip(some, found):
                self.memo[word] = score, ids, loss, self.pieces.decode(memoryview(ids).cast("I")) == word

    def _alone(self, word: str) -> tuple[int, bytes, int]:
        found = n_best(self.pieces, word, 2)
        return found[0][0], packed(found[0][1]), found[0][0] - found[1][0] if len(found) > 1 else -NEVER

    def word(self, word: str) -> list[tuple[int, tuple[int, ...]]]:
        found = self.best.get(word)
        if found is None:
            found = self.best[word] = n_best(self.pieces, word, self.n)
        return found

    def texts(self, texts: list[str]) -> Iterator[list[tuple[int, bytes, bool]]]:
        """``text`` of some texts, as many as fit into memory together."""
        split = [["".join(words_of(x))] if self.pieces.across else words_of(x) for x in texts]
        self.learn(set(chain.from_iterable(split)))
        return map(self.text, split)

    def text(self, words: list[str]) -> list[tuple[int, bytes, bool]]:
        """Up to n best segmentations of a whole text of known words: score, ids and whether they decode to the text, best
        first.

        A word that loses more by its second choice than n - 1 other words do can't depart from its best: only the words
        with the smallest losses are searched.
        """
        scores, ids, losses, right = zip(*map(self.memo.__getitem__, words))
        base, right = sum(scores), all(right)
        losses = np.array(losses)
        close = np.argsort(losses, kind="stable") if len(losses) < 64 else np.argpartition(losses, self.n - 1)
        kept: list[tuple[int, tuple]] = [(0, ())]
        for at in sorted(close[: self.n - 1].tolist(), key=lambda at: (losses[at], at)):
            options = self.word(words[at])
            if len(options) > 1:
                own = [(score - options[0][0], (at, choice)) for choice, (score, _) in enumerate(options)]
                kept = [(lost, a + (b,) if b[1] else a) for lost, (a, b) in merge_best(kept, own, self.n)]
        out = [(base, b"".join(ids), right)]
        for lost, changes in kept[1:]:
            parts, same = list(ids), right
            for at, choice in changes:
                chosen = self.word(words[at])[choice][1]
                parts[at] = packed(chosen)
                same = same and self.pieces.decode(chosen) == words[at]
            out.append((base + lost, b"".join(parts), same))
        return out


def stretches(texts: list[str]) -> Iterator[slice]:
    """Cuts ``texts`` into parts of bounded number and size; a text above the size is a part of its own."""
    start = size = 0
    for at, text in enumerate(texts):
        if at > start and (at - start == TEXTS_AT_ONCE or size + len(text) > CHARACTERS_AT_ONCE):
            yield slice(start, at)
            start, size = at, 0
        size += len(text)
    if start < len(texts):
        yield slice(start, len(texts))


_SEGMENTERS: dict[tuple[str, int], Segmenter] = {}


def segmenter(path: str, n: int) -> Segmenter:
    if (path, n) not in _SEGMENTERS:
        _SEGMENTERS[path, n] = Segmenter(path, n)
    return _SEGMENTERS[path, n]


def encode(docs: DataFrame, n: int = 4, id_col: str = "doc_id", text_col: str = "text",
           vocabulary: str | None = None, with_ids: bool = True) -> DataFrame:
    """Up to ``n`` rows per row of ``docs``: doc_id, rank (from 1), score, n_ids, ids_crc32, decodes and, if asked for, ids.

    ids_crc32 is over the ids as little-endian unsigned 32-bit integers; decodes tells whether decoding the ids gives the
    text back. Null texts are empty: a text without characters is the lone mark. Ties come in a fixed order; a mark that a
    text itself holds decodes to a space, as the vocabulary has it; repeated rows stay; other columns are not looked at; an empty table gives no
    rows. ``vocabulary`` is the path of a model file.
    """
    path = vocabulary or public_tokenizers.path(VOCABULARY)
    names = ["doc_id", "rank", "score", "n_ids", "ids_crc32", "decodes"] + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = segmenter(path, n)
        for batch in batches:
            doc_ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for part in stretches(texts):
                rows = []
                for doc_id, found in zip(doc_ids[part], cut.texts(texts[part])):
                    for rank, (score, ids, same) in enumerate(found, 1):
                        row = (doc_id, rank, score / UNIT, len(ids) // 4, zlib.crc32(ids), same)
                        rows.append((*row, np.frombuffer(ids, "<i4")) if with_ids else row)
                kinds = [pa.int64(), pa.int32(), pa.float64(), pa.int64(), pa.int64(), pa.bool_(), pa.list_(pa.int32())]
                columns = list(zip(*rows)) or [[]] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)

    schema = "doc_id long, rank int, score double, n_ids long, ids_crc32 long, decodes boolean" + ", ids array<int>" * with_ids
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return plain.mapInArrow(run, schema)


def decode(encoded: DataFrame, ids_col: str = "ids", vocabulary: str | None = None) -> DataFrame:
    """``encoded`` with a column ``text`` decoded from its ids; null ids give null."""
    path = vocabulary or public_tokenizers.path(VOCABULARY)

    @F.arrow_udf("string")
    def text(ids: pa.Array) -> pa.Array:
        pieces = segmenter(path, 1).pieces
        plain = lambda x: pieces.decode(x)[1:].replace(MARK, " ")
        return pa.array([None if x is None else plain(x) for x in ids.to_pylist()], pa.string())

    return encoded.withColumn("text", text(F.col(ids_col)))
