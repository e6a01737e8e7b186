"""SimHash near-duplicates with bit-sliced comparison of fingerprints.

A fingerprint is 64 bits; two texts are linked when at most ``radius`` bits differ. Equal fingerprints are one node. Nodes
meet in buckets of equal bits (pigeonhole: with radius + m blocks of bits, two linked fingerprints agree in m of them), a
bucket above ``block_rows`` is compared block by block, and inside a run the comparison is bit-sliced: the candidates'
bits stand vertically, one machine word for one bit of 64 candidates, and differing bits are counted for all of them at
once by carry-save counters. A word is abandoned once all its candidates exceed the radius. A run yields a spanning forest
of its links, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from concord.llm.common import LOWER, text_bytes, trim, written
from concord.llm.components import components

BITS = 64
#: Bits that runs of one comparison may fill at once: queries times words of 64 candidates.
ENTRIES = 1 << 18
FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


# ---- fingerprints


def fingerprint(data: bytes, width: int) -> int:
    """Bits that are set in over half of the hashes of all ``width``-word shingles; 0 for a text without words."""
    words = data.translate(LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) < width:
        hashes = np.array([xxh64_intdigest(joined, 42)], dtype=np.uint64)
    else:
        ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - width + 1].tolist()
        pieces = (joined[a:b] for a, b in zip(starts, ends[width - 1 :].tolist()))
        hashes = np.fromiter((xxh64_intdigest(x, 42) for x in pieces), dtype=np.uint64, count=len(starts))
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 15):
        part = hashes[at : at + (1 << 15)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits((2 * ones > len(hashes)).astype(np.uint8), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprint_column(text: Column, width: int = 4) -> Column:
    """The fingerprint of a text as a signed long; null and empty texts give 0."""

    @F.arrow_udf("long")
    def of(texts: pa.Array) -> pa.Array:
        found = pa.array([fingerprint(x.as_py(), width) for x in texts], type=pa.int64())
        trim()
        return found

    return of(text_bytes(text))


# ---- bit-sliced comparison of sorted runs


def _planes(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bit planes of each run's values: (64, words), valid candidates of each word, first word of each run."""
    words = -(-sizes // 64)
    first = np.concatenate(([0], np.cumsum(words)[:-1]))
    place = np.arange(len(values)) - np.repeat(starts, sizes) + 64 * np.repeat(first, sizes)
    padded = np.zeros(64 * int(words.sum()), dtype=np.uint64)
    padded[place] = values
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 64, 8), axis=2, bitorder="little")
    planes = np.packbits(bits.transpose(2, 0, 1), axis=2, bitorder="little").reshape(BITS, -1, 8)
    there = np.zeros(len(padded), dtype=np.uint8)
    there[place] = 1
    valid = np.packbits(there.reshape(-1, 64), axis=1, bitorder="little")
    return np.ascontiguousarray(planes).view(np.uint64)[:, :, 0], valid.view(np.uint64)[:, 0], first


def within(planes: np.ndarray, words: np.ndarray, queries: np.ndarray, radius: int) -> np.ndarray:
    """For each entry (word of 64 candidates, query value) the candidates within ``radius``, as 64 bits.

    Carry-save counters hold the number of differing bits of all candidates of a word; a counter that overflows stays
    marked. After every eight planes, entries whose candidates all exceed the radius are abandoned.
    """
    out = np.zeros(len(words), dtype=np.uint64)
    alive = np.arange(len(words))
    width = max(1, int(radius + 1).bit_length())
    counter = [np.zeros(len(words), dtype=np.uint64) for _ in range(width)]
    over = np.zeros(len(words), dtype=np.uint64)
    for p in range(BITS):
        flip = np.where((queries >> np.uint64(p)) & np.uint64(1), FULL, np.uint64(0))
        carry = planes[p][words] ^ flip
        for i in range(width):
            counter[i], carry = counter[i] ^ carry, counter[i] & carry
        over |= carry
        if p % 8 == 7:
            far = over | _exceeds(counter, radius)
            keep = far != FULL
            if not keep.all():
                words, queries, alive, over = words[keep], queries[keep], alive[keep], over[keep]
                counter = [c[keep] for c in counter]
            if not len(alive):
                return out
    out[alive] = ~(over | _exceeds(counter, radius))
    return out


def _exceeds(counter: list[np.ndarray], radius: int) -> np.ndarray:
    """Candidates whose counter is above ``radius``: the first bit from the top that differs from it decides."""
    above, equal = np.zeros_like(counter[0]), np.full_like(counter[0], FULL)
    for i in reversed(range(len(counter))):
        if radius >> i & 1:
            equal = equal & counter[i]
        else:
            above, equal = above | (equal & counter[i]), equal & ~counter[i]
    return above


def _forest(members: np.ndarray, near: np.ndarray) -> list[tuple[int, int]]:
    """Star links (first member, member) of each component, from the rows of candidates near each member."""
    links = []
    left = np.packbits(np.ones(len(members), dtype=np.uint8), bitorder="little")
    left = np.concatenate((left, np.zeros(near.shape[1] * 8 - len(left), dtype=np.uint8))).view(np.uint64)
    linked = np.bitwise_count(near).sum(axis=1) > 1
    for i in np.flatnonzero(linked):
        if not left[i // 64] >> np.uint64(i % 64) & np.uint64(1):
            continue
        group = near[i] & left
        new = group
        while new.any():
            at = np.flatnonzero(np.unpackbits(new.view(np.uint8), bitorder="little"))
            reach = np.bitwise_or.reduce(near[at], axis=0) & left
            new = reach & ~group
            group = group | reach
        left = left & ~group
        at = np.flatnonzero(np.unpackbits(group.view(np.uint8), bitorder="little"))
        links += [(int(members[i]), int(members[j])) for j in at if j != i]
    return links


def run_links(runs: np.ndarray, values: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links inside each run of equal ``runs`` (sorted); ``values`` are uint64 fingerprints."""
    links: list[tuple[int, int]] = []
    if not len(runs):
        return links
    starts = np.concatenate(([0], np.flatnonzero(np.diff(runs)) + 1))
    sizes = np.diff(np.concatenate((starts, [len(runs)])))
    starts, sizes = starts[sizes > 1], sizes[sizes > 1]
    cost = np.cumsum(sizes * -(-sizes // 64))
    while len(starts):
        n = max(1, int(np.searchsorted(cost, ENTRIES, side="right")))
        mine = np.concatenate([np.arange(a, a + s) for a, s in zip(starts[:n], sizes[:n])])
        own = values[mine]
        at = np.concatenate(([0], np.cumsum(sizes[:n])[:-1]))
        planes, valid, first = _planes(own, at, sizes[:n])
        words_each = -(-sizes[:n] // 64)
        per_query = np.repeat(words_each, sizes[:n])
        begin = np.concatenate(([0], np.cumsum(per_query)[:-1]))
        words = np.arange(int(per_query.sum())) - np.repeat(begin - np.repeat(first, sizes[:n]), per_query)
        near = within(planes, words, np.repeat(own, per_query), radius) & valid[words]
        counts = np.add.reduceat(np.bitwise_count(near).astype(np.int64), begin)
        run_of = np.repeat(np.arange(n), sizes[:n])
        for k in np.unique(run_of[counts > 1]):
            a, s, w = at[k], sizes[k], words_each[k]
            links += _forest(own[a : a + s].view(np.int64), near[begin[a] : begin[a] + s * w].reshape(s, w))
        starts, sizes, cost = starts[n:], sizes[n:], cost[n:] - cost[n - 1]
    return links


def _compare(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Runs arrive sorted; the last run of a batch waits for the next one."""
    held: tuple[np.ndarray, np.ndarray] = (np.empty(0, np.int64), np.empty(0, np.uint64))

    def result(runs: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
        links = np.array(run_links(runs, values, radius), dtype=np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(links[:, 0]), pa.array(links[:, 1])], names=["a", "b"])

    for batch in batches:
        runs = np.concatenate((held[0], batch.column("run").to_numpy()))
        values = np.concatenate((held[1], batch.column("fp").to_numpy().view(np.uint64)))
        if not len(runs):
            continue
        cut = int(np.flatnonzero(runs != runs[-1])[-1]) + 1 if runs[0] != runs[-1] else 0
        if cut:
            yield result(runs[:cut], values[:cut])
        held = runs[cut:], values[cut:]
    yield result(*held)


# ---- Spark


def tables_for(nodes: int, radius: int, bucket_rows: int = 4096) -> list[int]:
    """Masks of the bucket tables: the fewest agreeing blocks for which a bucket has about ``bucket_rows`` random nodes."""
    for agree in range(1, BITS - radius + 1):
        blocks = radius + agree
        edges = [BITS * i // blocks for i in range(blocks + 1)]
        if agree == 4 or nodes >> (BITS * agree // blocks) <= bucket_rows:
            break
    block = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:])]
    return [sum(block[i] for i in chosen) for chosen in combinations(range(blocks), agree)]


def links(nodes: DataFrame, radius: int = 4, block_rows: int = 2048) -> DataFrame:
    """Links (a, b) that connect all distinct fingerprints ``fp`` within ``radius`` bits, as spanning forests of runs.

    A bucket with more than ``block_rows`` nodes is cut into blocks by hash, and each pair of blocks is a run of its own,
    so no bucket has to fit into a task. No pair is lost.
    """
    masks = tables_for(nodes.count(), radius)
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    tables = F.array(*[F.struct(F.lit(i).alias("t"), F.lit(m).cast("long").alias("mask")) for i, m in enumerate(signed)])
    keyed = nodes.select("fp", F.explode(tables).alias("x")).select(
        "fp", F.xxhash64("x.t", F.col("fp").bitwiseAND(F.col("x.mask"))).alias("bucket")
    )
    large = keyed.groupBy("bucket").count().where(F.col("count") > block_rows)
    large = large.select("bucket", F.ceil(F.col("count") / (block_rows // 2)).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64(F.lit(7), "fp"), F.col("blocks")).cast("int")
    pair = F.struct(F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    cut = (
        keyed.join(large, "bucket", "left")
        .withColumn("own", F.when(F.col("blocks").isNull(), 0).otherwise(own))
        .withColumn(
            "other",
            F.explode(
                F.when(F.col("blocks").isNull(), F.array(F.lit(0))).otherwise(
                    F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: k != F.col("own"))
                )
            ),
        )
        .select("fp", F.xxhash64("bucket", pair).alias("run"))
    )
    runs = cut.repartition("run").sortWithinPartitions("run")
    return runs.mapInArrow(lambda batches: _compare(batches, radius), "a long, b long")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, radius: int = 4
) -> DataFrame:
    """One row per row of ``docs``: doc_id, fp (long), fingerprint (hex) and component_id.

    component_id is the smallest id of the component, ``node`` the fingerprint that names the component. Null and empty
    texts have fingerprint 0 and are linked like any other; repeated rows stay repeated; null ids are ignored for the
    smallest id unless a component has no other; other columns are not looked at. An empty table gives no rows.
    """
    prints = written(
        docs.select(F.col(id_col).alias("doc_id"), fingerprint_column(F.col(text_col), width).alias("fp"))
    )
    nodes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(links(nodes.select("fp"), radius))
    rooted = nodes.join(roots, nodes.fp == roots.node, "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("node")
    )
    rooted = written(rooted)
    named = rooted.groupBy("node").agg(F.min("least").alias("component_id"))
    classes = written(rooted.join(named, "node").select("fp", "node", "component_id"))
    return prints.join(classes, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "fp", "node"
    )


def keep_one(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, radius: int = 4
) -> DataFrame:
    """The rows of ``docs`` without near-copies: of each component the row with the smallest id (null ids last) stays.

    Rows that agree in id and fingerprint count as one, texts without words are copies of each other, whole texts count
    whatever their length, and an empty table stays empty. Columns and their order stay as they are.
    """
    found = near_duplicates(docs, id_col, text_col, width, radius)
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), F.col("fp").alias("fp"))
    best = written(found.groupBy("node").agg(F.min(order).alias("best")).select("best.id", "best.fp"))
    # The row travels in one struct, so that no name of a column can clash.
    marked = docs.select(
        F.struct("*").alias("row"), F.col(id_col).alias("doc_id"), fingerprint_column(F.col(text_col), width).alias("fp")
    )
    same = marked["doc_id"].eqNullSafe(best["id"]) & (marked["fp"] == best["fp"])
    return marked.join(best, same, "left_semi").dropDuplicates(["doc_id", "fp"]).select("row.*")
