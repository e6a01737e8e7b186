"""Byte-balanced sharding of indivisible groups by Karmarkar-Karp differencing.

A partial partition is a tuple of part sums. Differencing takes the two partial partitions with the largest spread and
adds them in opposite order, largest to smallest, until one is left. Groups are dealt by hash into cells of bounded size;
each cell is differenced into many fine parts, which are the items of the next level, until at most ``CELL`` are left to
be differenced into the shards. A group larger than a part stays a part of its own, so that the last level still
balances it against all others.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concord.llm.common import groups_for, shuffle_partitions, written

CELL = 8192
PARTS = 64
ITEM = "item string, size long"


def difference(sizes: np.ndarray, parts: int) -> np.ndarray:
    """Part number of every item after differencing all of them into ``parts`` parts. Ties go by item order."""
    n = len(sizes)
    if not n:
        return np.empty(0, dtype=np.int64)
    sums: list[np.ndarray | None] = []
    for size in sizes:
        first = np.zeros(parts, dtype=np.int64)
        first[0] = size
        sums.append(first)
    # A node's slots are its parts, largest first; left and right say which slot of a child went into which slot.
    left: list[tuple[int, np.ndarray]] = []
    right: list[tuple[int, np.ndarray]] = []
    heap = [(-int(size), i) for i, size in enumerate(sizes)]
    heapq.heapify(heap)
    turned = np.arange(parts)[::-1]
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[1], heapq.heappop(heap)[1]
        total = sums[a] + sums[b][::-1]
        order = np.argsort(-total, kind="stable")
        total = total[order]
        place = np.empty(parts, dtype=np.int64)
        place[order] = np.arange(parts)
        left.append((a, place))
        right.append((b, place[turned]))
        sums[a] = sums[b] = None
        sums.append(total - total[-1])
        heapq.heappush(heap, (-int(total[0] - total[-1]), len(sums) - 1))
    where: list[np.ndarray | None] = [None] * len(sums)
    where[-1] = np.arange(parts)
    for node in range(len(sums) - 1, n - 1, -1):
        slots = where[node]
        for child, place in (left[node - n], right[node - n]):
            where[child] = slots[place]
        where[node] = None
    return np.array([w[0] for w in where[:n]], dtype=np.int64)


def _differenced(parts: int) -> Callable[[pa.Table], pa.Table]:
    def run(cell: pa.Table) -> pa.Table:
        cell = cell.sort_by([("size", "descending"), ("item", "ascending")])
        return cell.append_column("part", pa.array(difference(cell.column("size").to_numpy(), parts)))

    return run


def assign(items: DataFrame, shards: int, cell: int = CELL, parts: int = PARTS) -> DataFrame:
    """(item, shard) for a table of (item, size) with one row per item."""
    spark = items.sparkSession
    levels: list[DataFrame] = []
    now = items.select(F.col("item").cast("string").alias("item"), F.col("size").cast("long").alias("size"))
    count = now.count()
    while count > cell:
        cells = groups_for(spark, count, cell)
        fine = min(parts, max(shards, cell // cells)) if cells < cell else parts
        keyed = now.withColumn("cell", F.pmod(F.xxhash64(F.lit(len(levels)), "item"), F.lit(cells)))
        split = keyed.groupBy("cell").applyInArrow(_differenced(fine), f"{ITEM}, cell long, part long")
        into = F.concat_ws("-", F.lit(len(levels)), "cell", "part")
        split = written(split.select("item", "size", into.alias("into")))
        levels.append(split.select("item", "into"))
        now = written(split.groupBy("into").agg(F.sum("size").alias("size")).withColumnRenamed("into", "item"))
        count = now.count()
    # At most ``cell`` part sums are left, whatever the input: the last differencing is the driver's.
    rest = sorted(now.collect(), key=lambda r: (-r["size"], r["item"]))
    part = difference(np.array([r["size"] for r in rest], dtype=np.int64), shards)
    found = spark.createDataFrame([(r["item"], int(p)) for r, p in zip(rest, part)], "item string, shard int")
    for level in reversed(levels):
        found = level.join(found.withColumnRenamed("item", "into"), "into").select("item", "shard")
    return found


def shard(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, size, text_crc32, law, shard, slot and grown_shard.

    Rows of equal text are one indivisible group (by the 128-bit hash of the text); null texts are a group of their own,
    of one byte each, as are empty ones. The law is ``bytes``: sizes near equal, groups whole. slot numbers the rows of a
    shard from 0 without gaps. Repeated rows and null ids are rows like any other; other columns are not looked at; an
    empty table gives no rows.
    """
    text = F.col(text_col)
    group = F.when(text.isNull(), F.lit("null")).otherwise(F.md5(text.cast("binary")))
    rows = written(
        docs.select(
            F.col(id_col).alias("doc_id"),
            (F.octet_length(F.coalesce(text, F.lit(""))) + 1).cast("long").alias("size"),
            F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
            group.alias("item"),
            F.monotonically_increasing_id().alias("row"),
        )
    )
    groups = written(rows.groupBy("item").agg(F.sum("size").alias("size")))
    placed = rows.join(assign(groups, shards), "item").drop("item")
    # Rows are numbered inside small strips of all shards; the strips' counts, summed in order, give the offsets.
    strips = max(4 * shuffle_partitions(docs.sparkSession), ceil(rows.count() / 100_000))
    strip = F.pmod(F.xxhash64("row"), F.lit(strips)).cast("int")
    placed = written(placed.withColumn("strip", strip))
    counts = placed.groupBy("shard", "strip").count()
    before = "coalesce(sum(count) over (partition by shard order by strip rows between unbounded preceding and 1 preceding), 0)"
    offsets = counts.select("shard", "strip", F.expr(before).alias("before"))
    own = F.expr("row_number() over (partition by shard, strip order by row) - 1")
    numbered = placed.withColumn("own", own).join(offsets, ["shard", "strip"])
    return numbered.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("before") + F.col("own")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
