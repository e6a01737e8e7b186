"""Packing of documents into training sequences by vector best-fit.

A sequence has three capacities: tokens, documents and attention cost (the sum of squared piece lengths). Pieces are taken
in decreasing order of size; each goes to the open sequence where it fits under every capacity and that scores best, by the
weighted norm of what stays free (``rule="norm"``, least is best) or by the weighted dot product of demand and free
capacity (``rule="dot"``, greatest is best).
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from math import ceil

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concord.llm.common import trim, written
from concord.llm.wordids import MEMO_WORDS, TEXT_AT_ONCE, SpacedWords, word_ids

TOKENIZER = "word_bpe_49k.json"
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


@dataclass(frozen=True)
class Capacity:
    """Limits of one sequence and the weights of the three dimensions, each taken as a share of its limit.

    The defaults for documents and attention cost are the bounds that 4096 tokens imply, so that they cost no sequence.
    """

    tokens: int = 4096
    documents: int = 4096
    attention: int = 4096 * 4096
    weights: tuple[float, float, float] = (1.0, 0.05, 0.05)
    rule: str = "norm"

    def __post_init__(self) -> None:
        if min(self.tokens, self.documents) < 1 or self.attention < self.tokens:
            raise ValueError("a sequence has to hold at least one piece")
        if self.rule not in ("norm", "dot"):
            raise ValueError(f"no such rule: {self.rule}")

    @property
    def longest(self) -> int:
        """Tokens of the longest piece that fits alone."""
        return min(self.tokens, int(self.attention**0.5))


# ---- token ids


def pieces(
    docs: DataFrame, id_col: str, text_col: str, path: str, end_id: int, longest: int,
    memo_words: int = MEMO_WORDS, at_once: int = TEXT_AT_ONCE,
) -> DataFrame:
    """Pieces of each document's ids (with ``end_id`` behind them): only documents above ``longest`` tokens are cut."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trim()  # what earlier tasks of this worker left
        encode = word_ids(path, SpacedWords(), memo_words, at_once).encode_all
        end = np.array([end_id], dtype="<u4")
        for batch in batches:
            found = [[], [], [], [], []]
            texts = (text.as_py() or "" for text in batch.column(1))
            for doc_id, words in zip(batch.column(0).to_pylist(), encode(texts)):
                ids = np.concatenate((words, end))
                for piece, start in enumerate(range(0, len(ids), longest)):
                    part = ids[start : start + longest]
                    for column, value in zip(found, (doc_id, piece, start, len(part), zlib.crc32(part))):
                        column.append(value)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(found[0], pa.int64()),
                    pa.array(found[1], pa.int32()),
                    *(pa.array(x, pa.int64()) for x in found[2:]),
                ],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return plain.mapInArrow(cut, PIECES)


# ---- best fit


def best_fit(lengths: np.ndarray, capacity: Capacity) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of every piece. A piece that fits nowhere opens a sequence."""
    limit = np.array([capacity.tokens, capacity.documents, capacity.attention], dtype=np.float64)
    weight = np.asarray(capacity.weights) / limit ** (2 if capacity.rule == "norm" else 1)
    if capacity.rule == "dot":
        weight = weight / limit
    order = np.lexsort((np.arange(len(lengths)), -lengths))
    sequence = np.empty(len(lengths), dtype=np.int64)
    offset = np.empty(len(lengths), dtype=np.int64)
    free = np.empty((3, 1024))
    number = np.empty(1024, dtype=np.int64)
    count, opened = 0, 0
    least = np.array([lengths.min(initial=0), 1, float(lengths.min(initial=0)) ** 2])
    for seen, at in enumerate(order):
        size = float(lengths[at])
        need = np.array([size, 1.0, size * size])
        rest = free[:, :count] - need[:, None]
        fits = (rest >= 0).all(axis=0)
        if fits.any():
            if capacity.rule == "norm":
                score = weight @ (rest * rest)
            else:
                score = -((weight * need) @ free[:, :count])
            score[~fits] = np.inf
            best = int(score.argmin())
        else:
            if count == free.shape[1]:
                free = np.concatenate((free, np.empty_like(free)), axis=1)
                number = np.concatenate((number, np.empty_like(number)))
            best, count, opened = count, count + 1, opened + 1
            free[:, best], number[best] = limit, opened - 1
        sequence[at] = number[best]
        offset[at] = capacity.tokens - int(free[0, best])
        free[:, best] -= need
        if seen % 256 == 255:  # sequences that not even the smallest piece fits are done
            open_ = (free[:, :count] >= least[:, None]).all(axis=0)
            kept = int(open_.sum())
            free[:, :kept], number[:kept] = free[:, :count][:, open_], number[:count][open_]
            count = kept
    return sequence, offset


def _packed(capacity: Capacity, tail: bool) -> Callable[[pa.Table], pa.Table]:
    """Packs one group; with ``tail`` the pieces of badly filled sequences come back unplaced (sequence_id null)."""

    def pack(group: pa.Table) -> pa.Table:
        group = group.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending")])
        lengths = group.column("length").to_numpy()
        sequence, offset = best_fit(lengths, capacity)
        name = (group.column("group")[0].as_py() << 32) + sequence
        loose = np.zeros(len(lengths), dtype=bool)
        if tail:
            filled = np.bincount(sequence, weights=lengths)
            loose = filled[sequence] < 0.97 * capacity.tokens
        return group.append_column("sequence_id", pa.array(name, pa.int64(), mask=loose)).append_column(
            "offset", pa.array(offset, pa.int64(), mask=loose)
        )

    return pack


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer: str | None = None,
    end_id: int = 1,
    capacity: Capacity = Capacity(),
    group_pieces: int = 4096,
    loose_pieces: int = 256,
    memo_words: int = MEMO_WORDS,
    at_once: int = TEXT_AT_ONCE,
) -> DataFrame:
    """Places every piece of every document: doc_id, piece, start, length, ids_crc32, sequence_id and offset.

    Documents are encoded once, and only the pieces' numbers are written and shuffled. Pieces are dealt at random into
    groups of about ``group_pieces``, one task packs a group, and the pieces of sequences that stay under 97 % full are
    dealt into groups of ``loose_pieces`` (of more where they are small) and packed again, so that grouping costs few
    sequences. Null and empty texts are one piece with
    the end id alone; whole texts are encoded whatever their length; null ids and repeated rows are pieces like any other,
    dealt by their row number; ties go to the sequence opened first; other columns are not looked at; an empty table gives
    no rows. ``tokenizer`` is the path of a vocabulary file. A worker remembers ``memo_words`` words and encodes texts of
    ``at_once`` characters together: fewer take less memory and more time.
    """
    path = tokenizer or public_tokenizers.path(TOKENIZER)
    found = pieces(docs, id_col, text_col, path, end_id, capacity.longest, memo_words, at_once)
    found = written(found.withColumn("__row", F.monotonically_increasing_id()))
    schema = f"{PIECES}, __row long, group long, sequence_id long, offset long"
    first = max(1, ceil(found.count() / group_pieces))
    grouped = found.withColumn("group", F.pmod(F.xxhash64("__row"), F.lit(first)))
    once = written(grouped.groupBy("group").applyInArrow(_packed(capacity, tail=True), schema))
    done, loose = once.where("sequence_id IS NOT NULL"), once.where("sequence_id IS NULL")
    left, tokens = loose.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
    # Groups of many small pieces hold at least the tokens of some sequences.
    again = max(1, min(ceil(left / loose_pieces), ceil(tokens / (8 * capacity.tokens))))
    dealt = F.lit(first) + F.pmod(F.xxhash64("__row", F.lit(1)), F.lit(again))
    spread = loose.drop("sequence_id", "offset", "group").withColumn("group", dealt)
    rest = spread.groupBy("group").applyInArrow(_packed(capacity, tail=False), schema)
    return done.unionByName(rest).drop("group", "__row")
