"""Interpolated modified Kneser-Ney language model.

Words are 64-bit hashes. Tasks count their own tokens, combine equal n-grams and send sorted blocks to shards, in which an
n-gram is the places of its words among the block's words, two or three bytes each. The last two words of an n-gram choose its
shard, so that a shard has all it needs for every lower order, in which each distinct n-gram counts once for the n-gram
without its first word: nothing is shuffled twice. N-grams are counted in ``ROUNDS``, each over all texts for its share of the shards,
whose shuffle files go before the next round.

A shard is one file in the shared folder: its words, contexts as a tree from their last word backwards, and behind each context the
words that follow it with their counts, all as places among the shard's words. Workers map the file into memory. The words that
follow a very frequent word are spread over several shards; sums over the followers of a context then come from all of these. Nothing of the model passes
through the driver but counts of counts and the very frequent words. A file appears by rename, so that a repeated task leaves the same file.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce
from math import ceil
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from concord.llm.common import (
    LOWER,
    fold,
    local_path,
    remove,
    shared_path,
    shuffle_partitions,
    shuffles_removed,
    text_bytes,
    written_at,
)

U = np.uint64
BOS, END = U(0x9F1B5C3D7E2A4861), U(0x3A7D9E5B1C6F8204)
#: Tokens that a task gathers before it combines them, and tokens scored at once.
GATHER, SCORE = 4_000_000, 1_000_000
#: Passes over the texts, each for its share of the shards: what is shuffled at once is that share.
ROUNDS = 2
#: The words that follow a very frequent word are spread over so many shards at most.
SALTS = 16
#: Text in bytes in which very frequent words are looked for; they only decide where n-grams lie.
OFTEN_BYTES = 16 << 20
#: Contexts with so many followers have the sums over them stored; for others they are added up when asked for.
MANY = 8
#: Files that a worker keeps mapped.
OPEN = 500
BLOCK = "kind int, level int, bin int, ctx binary, runs binary, rest binary, words binary, counts binary, heads long, grams long"
NONE = np.empty(0, U)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def hashes(data: bytes, order: int) -> np.ndarray:
    """Hashes of a text's tokens: ``order - 1`` marks of the beginning, the words, the end."""
    words = data.translate(LOWER).split()
    out = np.empty(order + len(words), dtype=U)
    out[: order - 1] = BOS
    out[order - 1 : -1] = np.fromiter(map(xxh3_64_intdigest, words), dtype=U, count=len(words))
    out[-1] = END
    return out


#: Very frequent words, sorted, and over how many shards the words that follow each are spread.
Heavy = tuple[np.ndarray, np.ndarray]
NO_HEAVY: Heavy = (NONE, np.empty(0, np.int64))


def before(flat: np.ndarray, distance: int) -> np.ndarray:
    """For each position the token ``distance`` places before it (meaningless where a text begins)."""
    return np.concatenate((np.full(min(distance, len(flat)), BOS), flat[:-distance]))


def salts_of(previous: np.ndarray, heavy: Heavy) -> np.ndarray:
    words, salts = heavy
    out = np.ones(len(previous), dtype=np.int64)
    if len(words):
        at = np.minimum(np.searchsorted(words, previous), len(words) - 1)
        hit = words[at] == previous
        out[hit] = salts[at[hit]]
    return out


def salted(previous: np.ndarray, salt: np.ndarray, shards: int) -> np.ndarray:
    return (mix(previous + salt * U(0xD6E8FEB86659FD93)) % U(shards)).astype(np.int64)


def shard_of(previous: np.ndarray, word: np.ndarray, shards: int, heavy: Heavy = NO_HEAVY) -> np.ndarray:
    return salted(previous, word % salts_of(previous, heavy).astype(U), shards)


def bin_of(key: np.ndarray, bins: int) -> np.ndarray:
    return (mix(key ^ U(0xA0761D6478BD642F)) % U(bins)).astype(np.int64)


# ---- blocks: sorted n-grams of one shard, as places of their words among the words of the block


def narrow(values: np.ndarray) -> bytes:
    """Whole numbers in as few bytes as the largest one needs: all lowest bytes, then all next ones."""
    width = max(1, -(-int(values.max(initial=0)).bit_length() // 8))
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def widened(data: bytes, count: int) -> np.ndarray:
    """The ``count`` numbers of ``narrow``."""
    out = np.zeros((count, 8), dtype=np.uint8)
    if count:
        out[:, : len(data) // count] = np.frombuffer(data, np.uint8).reshape(-1, count).T
    return out.view("<u8")[:, 0]


def numbered(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values, sorted, and for each value its place among them."""
    order = np.argsort(values)
    ordered = values[order]
    new = np.concatenate(([True], ordered[1:] != ordered[:-1]))
    place = np.empty(len(values), dtype=np.uint32)
    place[order] = np.cumsum(new, dtype=np.uint32) - np.uint32(1)
    return ordered[new], place


def summed(columns: list[np.ndarray], kinds: int, counts: np.ndarray | None = None) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows of ``columns`` of numbers below ``kinds``, sorted, with summed counts; each row counts once without
    ``counts``."""
    bits = max(1, int(kinds).bit_length())
    if bits * len(columns) > 64:
        order = np.lexsort(columns[::-1])
        columns = [c[order] for c in columns]
        new = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
        starts = np.flatnonzero(np.concatenate(([True], new)))
        columns = [c[starts] for c in columns]
    else:
        packed = columns[0].astype(U)
        for column in columns[1:]:
            packed <<= U(bits)
            packed |= column.astype(U)
        order = None if counts is None else np.argsort(packed)
        if order is None:
            packed.sort()
        else:
            packed = packed[order]
        starts = np.flatnonzero(np.concatenate(([True], packed[1:] != packed[:-1])))
        packed = packed[starts]
        mask, last = U((1 << bits) - 1), len(columns) - 1
        rows = len(columns[0])
        columns = [((packed >> U(bits * (last - i))) & mask).astype(np.uint32) for i in range(last + 1)]
        if counts is None:
            return columns, np.diff(np.concatenate((starts, [rows])))
    if counts is None:
        return columns, np.diff(np.concatenate((starts, [len(order)])))
    return columns, np.add.reduceat(counts[order].astype(np.int64), starts)


def run_heads(sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts = np.flatnonzero(np.concatenate(([True], sorted_keys[1:] != sorted_keys[:-1])))
    return starts, np.diff(np.concatenate((starts, [len(sorted_keys)])))


def _encoded(words: np.ndarray, columns: list[np.ndarray], counts: np.ndarray) -> tuple[bytes, ...]:
    """The words that occur, lengths of runs of one first word, first words of the runs and middle ones, last ones, counts."""
    if len(words) <= 4 * len(counts):
        there = np.zeros(len(words), dtype=bool)
        for column in columns:
            there[column] = True
        place = np.cumsum(there) - 1
        own, columns = words[there], [place[c] for c in columns]
    else:
        used, place = np.unique(np.concatenate(columns), return_inverse=True)
        own, columns = words[used], np.split(place, len(columns))
    starts, runs = run_heads(columns[0])
    rest = np.concatenate((columns[0][starts], *columns[1:-1]))
    return own.tobytes(), narrow(runs), narrow(rest), narrow(columns[-1]), narrow(counts), len(starts), len(counts)


def _decoded(rows: list[dict]) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """All words of some blocks, sorted, the n-grams as places among them, and their counts."""
    own = [np.frombuffer(row["ctx"], U) for row in rows]
    words = np.unique(np.concatenate(own))
    blocks = []
    for row, names in zip(rows, own):
        place = np.searchsorted(words, names).astype(np.uint32)
        n, heads, middle = row["grams"], row["heads"], row["level"] - 2
        rest = place[widened(row["rest"], heads + middle * n)]
        first = np.repeat(rest[:heads], widened(row["runs"], heads).astype(np.int64))
        columns = [first, *(rest[heads + i * n : heads + (i + 1) * n] for i in range(middle)), place[widened(row["words"], n)]]
        blocks.append((columns, widened(row["counts"], n).astype(np.int64)))
    columns = [np.concatenate(c) for c in zip(*(b[0] for b in blocks))]
    return words, columns, np.concatenate([b[1] for b in blocks])


def _table(rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows)) if rows else [[]] * 10
    kinds = [pa.int32()] * 3 + [pa.binary()] * 5 + [pa.int64()] * 2
    names = ["kind", "level", "bin", "ctx", "runs", "rest", "words", "counts", "heads", "grams"]
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)


def _dealt(
    level: int, shards: int, words: np.ndarray, columns: list[np.ndarray], counts: np.ndarray, heavy: Heavy = NO_HEAVY
) -> list[tuple]:
    """One encoded row per shard; n-grams, whose first column is the last word but one, keep their order inside a shard."""
    to = shard_of(words[columns[0]], words[columns[-1]], shards, heavy)
    order = np.argsort(to, kind="stable")
    starts, _ = run_heads(to[order])
    parts = np.split(order, starts[1:])
    return [(0, level, int(to[p[0]]), *_encoded(words, [c[p] for c in columns], counts[p])) for p in parts if len(p)]


def _keyed(kind: int, level: int, bins: int, keys: np.ndarray, *values: np.ndarray) -> list[tuple]:
    """Rows of sums by key: the values stand one after the other."""
    to = bin_of(keys, bins)
    order = np.argsort(to, kind="stable")
    starts, _ = run_heads(to[order])
    out = []
    for p in np.split(order, starts[1:]):
        if len(p):
            packed = narrow(np.concatenate([v[p] for v in values]))
            out.append((kind, level, int(to[p[0]]), keys[p].tobytes(), b"", b"", b"", packed, 0, len(p)))
    return out


def _unkeyed(rows: list[dict], values: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Distinct keys, sorted, with the sums of each of their values."""
    keys, parts = [], [[] for _ in range(values)]
    for row in rows:
        own = np.frombuffer(row["ctx"], U)
        flat = widened(row["counts"], values * len(own))
        keys.append(own)
        for to, part in zip(parts, np.split(flat.astype(np.int64), values)):
            to.append(part)
    if not keys:
        return NONE, [np.empty(0, np.int64)] * values
    keys_ = np.concatenate(keys)
    order = np.argsort(keys_, kind="stable")
    starts, _ = run_heads(keys_[order])
    return keys_[order][starts], [np.add.reduceat(np.concatenate(p)[order], starts) for p in parts]


def count_of_counts(counts: np.ndarray) -> np.ndarray:
    return np.bincount(np.minimum(counts, 5), minlength=6)[1:5].astype("<u8")


# ---- files


def smallest(counts: np.ndarray) -> np.ndarray:
    """Counts in the narrowest unsigned type that holds them all."""
    return counts.astype(np.min_scalar_type(int(counts.max(initial=0))))


def save(folder: str, name: str, arrays: dict[str, np.ndarray]) -> None:
    """One file: the length of a header, the header (where each array lies), the arrays."""
    os.makedirs(folder, exist_ok=True)
    places, at = {}, 0
    for key, array in arrays.items():
        places[key] = (array.dtype.str, at, len(array))
        at += -(-array.nbytes // 8) * 8
    head = json.dumps(places).encode()
    head += b" " * (-len(head) % 8)
    part = f"{folder}/.{name}-{uuid4().hex}"
    with open(part, "wb") as out:
        out.write(len(head).to_bytes(8, "little") + head)
        for array in arrays.values():
            out.write(array.tobytes() + bytes(-array.nbytes % 8))
    os.replace(part, f"{folder}/{name}")


def wide(name: str, values: np.ndarray) -> dict[str, np.ndarray]:
    """Whole numbers as two lower bytes and what is above them, of which there is nothing for small ones."""
    high = smallest(values >> 16)
    return {f"{name}-low": (values & 0xFFFF).astype(np.uint16), f"{name}-high": high if high.any() else high[:0]}


def counted(name: str, counts: np.ndarray) -> dict[str, np.ndarray]:
    """Counts in one byte; those from 255 on once more, with their places."""
    large = np.flatnonzero(counts >= 255)
    return {name: np.minimum(counts, 255).astype(np.uint8), f"{name}-at": large.astype(np.uint32), f"{name}-large": smallest(counts[large])}


class Stored(dict):
    """The arrays of one file."""

    def wide(self, name: str, at: np.ndarray) -> np.ndarray:
        out = self[f"{name}-low"].take(at).astype(np.int64)
        high = self[f"{name}-high"]
        return out + high.take(at) * np.int64(1 << 16) if len(high) else out

    def counted(self, name: str, at: np.ndarray) -> np.ndarray:
        out = self[name][at].astype(np.int64)
        large = np.flatnonzero(out == 255)
        if len(large):
            out[large] = self[f"{name}-large"][np.searchsorted(self[f"{name}-at"], at[large])]
        return out

    def search(self, name: str, first: np.ndarray, end: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which targets are among the sorted numbers of ``wide`` from ``first`` to before ``end``, and the places of these."""
        found = first.astype(np.int64)
        rows = np.flatnonzero(first < end)
        low, high, wanted = found[rows], end[rows].astype(np.int64), target[rows]
        while len(rows):
            middle = (low + high) >> 1
            below = self.wide(name, middle) < wanted
            high = np.where(below, high, middle)
            low = np.where(below, middle + 1, low)
            done = low >= high
            if done.any():
                found[rows[done]] = low[done]
                left = np.flatnonzero(~done)
                rows, low, high, wanted = rows[left], low[left], high[left], wanted[left]
        hit = np.flatnonzero(found < end)
        hit = hit[self.wide(name, found[hit]) == target[hit]]
        return hit, found[hit]

    def places(self, words: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Places of ``words[ids]`` among the words of the shard, -1 for others; the words are sorted."""
        stored = self["words"]
        ids, back = np.unique(ids, return_inverse=True)
        asked = words[ids]
        at = np.minimum(np.searchsorted(stored, asked), len(stored) - 1)
        return np.where(stored[at] == asked, at, -1)[back]

    def followers(self, depth: int, node: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of contexts: the sum of the counts of their followers, and how many of these have a count of one, two, and more."""
        starts, name = self[f"runs{depth}"], f"count{depth}"
        first = starts[node].astype(np.int64)
        length = starts[node + 1].astype(np.int64) - first
        out = tuple(np.zeros(len(node), dtype=np.int64) for _ in range(4))
        for i in range(MANY - 1):
            some = np.flatnonzero((length > i) & (length < MANY))
            if not len(some):
                break
            counts = self.counted(name, first[some] + i)
            out[0][some] += counts
            for to, hit in zip(out[1:], (counts == 1, counts == 2, counts > 2)):
                to[some] += hit
        some = np.flatnonzero(length >= MANY)
        at = np.searchsorted(self[f"many{depth}"], node[some])
        for to, value in zip(out, ("total", "one", "two", "more")):
            to[some] = self[f"{value}{depth}"][at]
        return out


class Arrays:
    """The files of a model, mapped when first asked for."""

    def __init__(self, folder: str):
        self.folder = folder
        self.open: dict[str, Stored | None] = {}

    def get(self, name: str) -> Stored | None:
        if name not in self.open:
            if len(self.open) >= OPEN:
                self.open.clear()
            path = f"{self.folder}/{name}"
            self.open[name] = self._mapped(path) if os.path.exists(path) else None
        return self.open[name]

    @staticmethod
    def _mapped(path: str) -> Stored:
        data = np.memmap(path, np.uint8, "r").view(np.ndarray)
        start = 8 + int(data[:8].view("<u8")[0])
        places = json.loads(data[8:start].tobytes())
        kinds = {key: (np.dtype(kind), start + at, rows) for key, (kind, at, rows) in places.items()}
        return Stored({k: data[at : at + rows * kind.itemsize].view(kind) for k, (kind, at, rows) in kinds.items()})

    def find(self, prefix: str, bins: np.ndarray, keys: np.ndarray, values: tuple[str, ...]) -> list[np.ndarray]:
        """The values stored for ``keys`` in their bins, 0 where a key is not stored."""
        out = [np.zeros(len(keys), dtype=np.int64) for _ in values]
        order = np.lexsort((keys, bins))
        starts, _ = run_heads(bins[order]) if len(keys) else (np.empty(0, np.int64), None)
        for part in np.split(order, starts[1:]) if len(keys) else []:
            stored = self.get(f"{prefix}-{bins[part[0]]}")
            if stored is None or not len(stored["words"]):
                continue
            at = stored.places(keys, part)
            hit = at >= 0
            for to, value in zip(out, values):
                to[part[hit]] = stored[value][at[hit]]
        return out


_ARRAYS: dict[str, Arrays] = {}


# ---- counting


def _often(order: int, shards: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Tokens of a batch that may be very frequent, with their counts, and under no word the number of all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                flat = np.concatenate([hashes(text.as_py(), order) for text in batch.column(0)])
                words, counts = np.unique(flat, return_counts=True)
                some = 2 * shards * counts > len(flat)
                found = pa.array([None, *words[some].view(np.int64).tolist()], pa.int64())
                yield pa.RecordBatch.from_arrays([found, pa.array([len(flat), *counts[some].tolist()], pa.int64())], names=["word", "f"])

    return run


def _heavy(body: DataFrame, size: int, order: int, shards: int) -> Heavy:
    """Words that make up more than a shard's share of the tokens: at most as many as there are shards."""
    if not size:
        return NO_HEAVY
    some = body.sample(min(1.0, OFTEN_BYTES / size), 11) if size > OFTEN_BYTES else body
    found = some.mapInArrow(_often(order, shards), "word long, f long").groupBy("word").agg(F.sum("f").alias("f"))
    rows = found.orderBy(F.desc("f"), F.col("word").asc_nulls_first()).limit(shards + 1).collect()
    total = sum(r["f"] for r in rows if r["word"] is None)
    salts = {r["word"]: min(SALTS, ceil(r["f"] * shards / total)) for r in rows if r["word"] is not None}
    words = np.array([w for w, n in salts.items() if n > 1], dtype=np.int64).view(U)
    by_word = np.argsort(words)
    return words[by_word], np.array([n for n in salts.values() if n > 1], dtype=np.int64)[by_word]


def _gather(
    order: int, shards: int, heavy: Heavy, turn: int, turns: int
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def combined(parts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        flat = np.concatenate(parts)
        parts.clear()
        taken = np.flatnonzero((flat != BOS) & (shard_of(before(flat, 1), flat, shards, heavy) % turns == turn))
        if len(taken):
            words, place = numbered(flat)
            del flat
            columns, counts = summed([place[taken - i] for i in (*range(1, order), 0)], len(words))
            yield _table(_dealt(order, shards, words, columns, counts, heavy)).combine_chunks().to_batches()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        for batch in batches:
            for text in batch.column(0):
                parts.append(hashes(text.as_py(), order))
                size += len(parts[-1])
                if size >= GATHER:
                    yield from combined(parts)
                    parts, size = [], 0
        if parts:
            yield from combined(parts)

    return run


def _merge(folder: str, order: int, bins: int) -> Callable[[pa.Table], pa.Table]:
    """One shard: writes its file, yields sums by word and counts of counts."""

    def run(group: pa.Table) -> pa.Table:
        shard = group.column("bin")[0].as_py()
        names, columns, counts = _decoded(group.to_pylist())
        columns, counts = summed(columns, len(names), counts)
        raw = np.zeros(len(names), dtype=np.int64)
        np.add.at(raw, columns[-1], counts)
        stored, out = {"words": names}, []
        for depth in range(order - 1, 0, -1):
            changes = [c[1:] != c[:-1] for c in columns[:-1]]
            starts = np.flatnonzero(np.concatenate(([True], np.logical_or.reduce(changes))))
            if depth > 1:
                parents = np.concatenate(([True], np.logical_or.reduce(changes[:-1])))
                kids = np.append(np.flatnonzero(parents[starts]), len(starts))
                stored[f"kids{depth - 1}"] = kids.astype(np.uint32)
            runs = np.append(starts, len(counts))
            many = np.flatnonzero(np.diff(runs) >= MANY)
            sums = [np.add.reduceat(x.astype(np.int64), starts)[many] for x in (counts, counts == 1, counts == 2, counts > 2)]
            stored |= wide(f"node{depth}", columns[-2][starts]) | wide(f"next{depth}", columns[-1])
            stored |= counted(f"count{depth}", counts)
            stored |= {f"runs{depth}": runs.astype(np.uint32), f"many{depth}": many.astype(np.uint32)}
            stored |= {f"{name}{depth}": smallest(x) for name, x in zip(("total", "one", "two", "more"), sums)}
            out.append((9, depth + 1, -1, b"", b"", b"", b"", count_of_counts(counts).tobytes(), 0, 0))
            if depth > 1:
                columns, counts = summed([*columns[:-2], columns[-1]], len(names))
        save(folder, f"shard-{shard}", stored)
        continued = np.bincount(columns[-1], minlength=len(names))
        there = np.flatnonzero(continued)
        return _table(out + _keyed(1, 1, bins, names[there], continued[there], raw[there]))

    return run


def _finish(folder: str, order: int) -> Callable[[pa.Table], pa.Table]:
    """Sums by word of one bin; bin -1 holds the counts of counts."""

    def run(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        bin_ = rows[0]["bin"]
        out: list[tuple[str, int, int]] = []
        if bin_ < 0:
            for level in range(2, order + 1):
                found = [np.frombuffer(r["counts"], "<u8") for r in rows if r["level"] == level]
                out += [(f"n{i + 1}", level, int(x)) for i, x in enumerate(np.sum(found, axis=0))]
        else:
            words, (continued, raw) = _unkeyed(rows, 2)
            save(folder, f"word-{bin_}", {"words": words, "continued": smallest(continued), "raw": smallest(raw)})
            out += [("words", 1, len(words)), ("tokens", 1, int(raw.sum())), ("continued", 1, int(continued.sum()))]
            out += [(f"n{i + 1}", 1, int(x)) for i, x in enumerate(count_of_counts(continued))]
        return pa.Table.from_pydict({k: [r[i] for r in out] for i, k in enumerate(("name", "level", "value"))})

    return run


@dataclass(frozen=True)
class Model:
    """Where the arrays are, and the few numbers that hold for all of them.

    ``discounts`` are by order, for counts of one, two, and three or more; ``free`` is the share of the continuation
    counts that the discounts of the lowest order take.
    """

    folder: str
    order: int
    shards: int
    bins: int
    words: int = 0
    tokens: int = 0
    continued: int = 0
    free: float = 1.0
    discounts: dict[int, tuple[float, float, float]] = field(default_factory=dict)
    heavy: Heavy = NO_HEAVY


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts from counts of counts; 0.5, 1 and 1.5 where those don't define them."""
    if min(n1, n2, n3, n4) <= 0:
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    found = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return tuple(min(max(d, 0.05), c) for d, c in zip(found, (1.0, 2.0, 3.0)))


def train(texts: DataFrame, text_col: str = "text", order: int = 3) -> Model:
    """Counts all n-grams of all ``texts``; nothing is pruned. Null texts are empty: one end token."""
    if order < 2:
        raise ValueError("the order is at least 2")
    spark = texts.sparkSession
    body = texts.select(text_bytes(F.col(text_col)).alias("body"))
    size = body.agg(F.coalesce(F.sum(F.octet_length("body")), F.lit(0)).alias("n")).first()["n"]
    shards = max(shuffle_partitions(spark), ceil(size / (16 << 20)))
    heavy = _heavy(body, size, order, shards)
    folder = local_path(shared_path(spark))
    sums: list[tuple[DataFrame, str]] = []
    with shuffles_removed(spark):
        for turn in range(ROUNDS):
            blocks = body.mapInArrow(_gather(order, shards, heavy, turn, ROUNDS), BLOCK)
            sums.append(written_at(blocks.groupBy("bin").applyInArrow(_merge(folder, order, shards), BLOCK)))
        rows = reduce(DataFrame.unionByName, [x for x, _ in sums])
        found = written_at(rows.groupBy("bin").applyInArrow(_finish(folder, order), "name string, level long, value long"))
    remove(spark, *[path for _, path in sums])
    found = found[0]
    numbers = {(r["name"], r["level"]): r["v"] for r in found.groupBy("name", "level").agg(F.sum("value").alias("v")).collect()}
    of = lambda name, level=1: numbers.get((name, level), 0)
    cut = {level: discounts(*(of(f"n{i}", level) for i in (1, 2, 3, 4))) for level in range(1, order + 1)}
    often = of("words") - of("n1") - of("n2")
    free = (cut[1][0] * of("n1") + cut[1][1] * of("n2") + cut[1][2] * often) / max(of("continued"), 1)
    return Model(folder, order, shards, shards, of("words"), of("tokens"), of("continued"), free, cut, heavy)


# ---- scoring


def _less(counts: np.ndarray, cut: tuple[float, float, float]) -> np.ndarray:
    return np.maximum(counts - np.array([0.0, *cut])[np.minimum(counts, 3)], 0)


def _paired(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct pairs, sorted, as their left and right numbers, and for each pair its place among them."""
    keys = (left.astype(U) << U(32)) | right.astype(U)
    found, place = np.unique(keys, return_inverse=True)
    return (found >> U(32)).astype(np.int64), (found & U(0xFFFFFFFF)).astype(np.int64), place


def _slices(sorted_shards: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Each shard with its rows."""
    if len(sorted_shards):
        starts, runs = run_heads(sorted_shards)
        for start, rows in zip(starts.tolist(), runs.tolist()):
            yield int(sorted_shards[start]), slice(start, start + rows)


def _roots(
    words: np.ndarray, token: np.ndarray, shard: np.ndarray, model: Model
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct pairs of a shard and a last word of a context, sorted, and for each row its place among them."""
    kinds, once = len(words), np.zeros(len(words), dtype=bool)
    once[token] = True
    spread = salts_of(words, model.heavy) > 1
    used = np.flatnonzero(once & ~spread)
    single = salted(words[used], np.zeros(len(used), dtype=U), model.shards) * kinds + used
    many = np.flatnonzero(spread[token])
    several = shard[many] * kinds + token[many]
    keys = np.concatenate((single, np.unique(several)))
    keys.sort()
    place = np.zeros(kinds, dtype=np.int64)
    place[used] = np.searchsorted(keys, single)
    context = place[token]
    context[many] = np.searchsorted(keys, several)
    return keys // kinds, keys % kinds, context


def _followers(model: Model, arrays: Arrays, words: np.ndarray, back: np.ndarray, real: np.ndarray) -> list[np.ndarray]:
    """For each order from 2 on, by row: of the context at each place of ``real`` the four sums over its followers, and the
    count of the token there among them. Tokens are ``words[back]``; distinct contexts and n-grams are looked up once.
    """
    tokens = [back[real - i] for i in range(1, model.order)]
    previous, word = words[tokens[0]], back[real]
    own = shard_of(previous, words[word], model.shards, model.heavy)
    at, shard = np.arange(len(real)), own
    salts = salts_of(previous, model.heavy)
    spread = np.flatnonzero(salts > 1)
    if len(spread):
        times = salts[spread]
        others = np.repeat(spread, times)
        salt = np.arange(len(others)) - np.repeat(np.cumsum(times) - times, times)
        asked = np.unique(others * model.shards + salted(previous[others], salt.astype(U), model.shards))
        others, there = asked // model.shards, asked % model.shards
        new = there != own[others]
        at, shard = np.concatenate((at, others[new])), np.concatenate((shard, there[new]))
    out = [np.zeros((5, len(real)), dtype=np.int64) for _ in tokens]
    # The first rows ask for the token in the shard that has it; for them: where the n-gram without its first word was found.
    mine = len(real)
    place = np.zeros(mine, dtype=np.int64)
    for depth, token in enumerate(tokens, 1):
        if depth == 1:
            shards, last, context = _roots(words, token[at], shard, model)
            first = end = np.zeros(len(last), dtype=np.int64)
        else:
            above, last, context = _paired(context, token[at])
            shards, first, end = shards[above], first[above], end[above]
        sums, run, kids = (np.zeros((n, len(last)), dtype=np.int64) for n in (4, 2, 2))
        for number, rows in _slices(shards):
            stored = arrays.get(f"shard-{number}")
            if stored is None:
                continue
            ends = end[rows] if depth > 1 else np.full(rows.stop - rows.start, len(stored["node1-low"]))
            hit, node = stored.search(f"node{depth}", first[rows], ends, stored.places(words, last[rows]))
            hit += rows.start
            for to, value in zip(sums, stored.followers(depth, node)):
                to[hit] = value
            run[0, hit], run[1, hit] = stored[f"runs{depth}"][node], stored[f"runs{depth}"][node + 1]
            if depth < len(tokens):
                kids[0, hit], kids[1, hit] = stored[f"kids{depth}"][node], stored[f"kids{depth}"][node + 1]
        for to, value in zip(out[depth - 1], sums):
            to += value[context[:mine]]
            if len(at) > mine:
                np.add.at(to, at[mine:], value[context[mine:]])
        # The longest n-grams are nearly all distinct, and only asked for where the one without its first word was found.
        asked = np.flatnonzero((place >= 0) & (run[1] > run[0])[context[:mine]])
        heads, names, back_ = _paired(context[asked], word[asked])
        counts, places = np.zeros(len(heads), np.int64), np.full(len(heads), -1)
        for number, rows in _slices(shards[heads]):
            stored = arrays.get(f"shard-{number}")
            found = stored.places(words, names[rows])
            hit, next_ = stored.search(f"next{depth}", run[0, heads[rows]], run[1, heads[rows]], found)
            counts[rows.start + hit] = stored.counted(f"count{depth}", next_)
            places[rows.start + hit] = found[hit]
        out[depth - 1][4][asked] = counts[back_]
        place[:] = -1
        place[asked] = places[back_]
        first, end = kids
    return out


def probabilities(model: Model, arrays: Arrays, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Model probability and training count of the token at each position of ``flat``."""
    words, back = np.unique(flat, return_inverse=True)
    continued, raw = arrays.find("word", bin_of(words, model.bins), words, ("continued", "raw"))
    kinds = max(model.words, 1)
    # What the discounts took goes to all words and one unknown word alike; without any training that is everything.
    free = model.free if model.continued else 1.0
    p = (_less(continued, model.discounts[1]) / max(model.continued, 1) + free / (kinds + 1))[back]
    real = np.flatnonzero(flat != BOS)
    found = _followers(model, arrays, words, back, real)
    for level, (total, one, two, more, count) in zip(range(2, model.order + 1), found):
        d1, d2, d3 = model.discounts[level]
        known, all_ = total > 0, np.maximum(total, 1)
        keep = np.where(known, (d1 * one + d2 * two + d3 * more) / all_, 1.0)
        p[real] = np.where(known, _less(count, model.discounts[level]) / all_, 0.0) + keep * p[real]
    return p, raw[back]


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", folds: int = 10) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity.

    Null and empty texts are one end token; repeated rows stay; other columns are not looked at; an empty table gives no
    rows. A model of no text knows no token and gives all the same probability.
    """
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"]
    out_schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double"

    def scored(ids: list, held: list, parts: list[np.ndarray]) -> pa.RecordBatch:
        arrays = _ARRAYS.setdefault(model.folder, Arrays(model.folder))
        flat = np.concatenate(parts)
        p, raw = probabilities(model, arrays, flat)
        real = flat != BOS
        starts = np.concatenate(([0], np.cumsum([len(x) for x in parts])[:-1]))
        base = np.log10((raw + 0.1) / (model.tokens + 0.1 * (model.words + 1)))
        tokens = np.array([len(x) - model.order + 1 for x in parts])
        total = np.add.reduceat(np.where(real, np.log10(p), 0.0), starts)
        columns = [
            pa.array(ids, pa.int64()), pa.array(held, pa.bool_()), pa.array(tokens, pa.int64()),
            pa.array(np.add.reduceat((real & (raw > 0)).astype(np.int64), starts), pa.int64()),
            pa.array(np.full(len(ids), model.tokens), pa.int64()),
            pa.array(np.add.reduceat(np.where(real, base, 0.0), starts)), pa.array(total), pa.array(10 ** (-total / tokens)),
        ]
        return pa.RecordBatch.from_arrays(columns, names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, held, parts, size = [], [], [], 0
        for batch in batches:
            for doc_id, out, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                ids.append(doc_id)
                held.append(out)
                parts.append(hashes(text.as_py(), model.order))
                size += len(parts[-1])
                if size >= SCORE:
                    yield scored(ids, held, parts)
                    ids, held, parts, size = [], [], [], 0
        if parts:
            yield scored(ids, held, parts)

    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (fold(F.col(id_col), folds) == 0).alias("held_out"),
        text_bytes(F.col(text_col)).alias("body"),
    )
    return rows.mapInArrow(run, out_schema)


def language_model_scores(docs: DataFrame, order: int = 3, id_col: str = "doc_id", text_col: str = "text",
                          folds: int = 10) -> DataFrame:
    """Learns from the rows outside fold 0 and scores all rows, see ``score``."""
    model = train(docs.where(fold(F.col(id_col), folds) != 0), text_col, order)
    return score(docs, model, id_col, text_col, folds)
