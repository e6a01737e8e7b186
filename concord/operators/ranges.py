"""Where in the key space the differences are.

Boundaries of ranges of equal row count are found by row position. For whole-number and date keys this needs no sort:
each pass counts the rows in equal-width buckets of the intervals that still hold a wanted position, and narrows every
interval to the bucket that holds it. A pass is one scan of the key column with a partial aggregation; its result has at
most ``chunks * BUCKETS`` rows whatever the size of the table. Keys of other types and keys of several columns are found by
bracketing each position with a sample and counting (:mod:`concord.operators.selection`).
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from concord.functions.columns import col
from concord.operators.bounds import count_below, with_place
from concord.operators.keyed import IS_ORPHAN, ORPHANS, SOURCE, aligned_key, key_type, orphan_content
from concord.operators.selection import row_count, values_at
from concord.operators.summary import part_counts
from concord.plans.compare_plan import ComparePlan, KeyRange

BUCKETS = 4096
#: Counts that one pass brings to the driver at most; with many intervals each gets fewer buckets, and a pass more.
COUNTS_AT_ONCE = 1 << 20

_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_EPOCH = dt.date(1970, 1, 1)


@dataclass
class _Target:
    """A wanted position: the value at 0-based ``offset`` lies in [low, high] and ``before`` rows lie below low."""

    offset: int
    low: int
    high: int
    before: int = 0


def boundary_offsets(rows: int, chunks: int) -> list[int]:
    """0-based positions of the boundaries that cut ``rows`` rows into ``chunks`` parts of equal size."""
    if chunks < 2 or rows < 2:
        return []
    size = -(-rows // chunks)
    return [i * size for i in range(1, chunks) if i * size < rows]


def range_boundaries(df: DataFrame, column: str | Sequence[str], chunks: int) -> list:
    """Values of ``column`` at the boundary positions of its sorted non-NULL values; equal boundaries are kept once.

    With several columns a boundary is a tuple, and rows count in which all of them are filled.
    """
    columns = [column] if isinstance(column, str) else list(column)
    if len(columns) > 1:
        return list(dict.fromkeys(values_at(df, columns, boundary_offsets(row_count(df, columns), chunks))))
    name = columns[0]
    data_type = df.schema[name].dataType
    keys = df.select(col(name).alias("key")).filter(F.col("key").isNotNull())
    if isinstance(data_type, _WHOLE):
        values = _narrow(keys.select(F.col("key").cast("long").alias("x")), chunks)
    elif isinstance(data_type, T.DateType):
        days = _narrow(keys.select(F.unix_date("key").cast("long").alias("x")), chunks)
        values = [_EPOCH + dt.timedelta(days=day) for day in days]
    else:
        values = [value for (value,) in values_at(df, [name], boundary_offsets(row_count(df, [name]), chunks))]
    return list(dict.fromkeys(values))


def _narrow(keys: DataFrame, chunks: int) -> list[int]:
    rows, low, high = keys.agg(F.count("x"), F.min("x"), F.max("x")).first()
    targets = [_Target(offset, low, high) for offset in boundary_offsets(rows, chunks)]
    while any(target.low < target.high for target in targets):
        intervals = sorted({(target.low, target.high) for target in targets if target.low < target.high})
        buckets = max(2, min(BUCKETS, COUNTS_AT_ONCE // len(intervals)))
        widths = {interval: -(-(interval[1] - interval[0] + 1) // buckets) for interval in intervals}
        counts = _bucket_counts(keys, intervals, widths)
        for target in targets:
            interval = (target.low, target.high)
            if interval in widths:
                _step(target, counts[interval], widths[interval])
    return [target.low for target in targets]


def _bucket_counts(keys: DataFrame, intervals: list[tuple[int, int]], widths: dict) -> dict:
    """Rows per bucket of each interval. Intervals are disjoint, so a row falls into one bucket at most."""
    # Lower ends may lie further from a key than a long can tell.
    wide = any(high - low >= 2**63 for low, high in intervals)
    kind = "decimal(20,0)" if wide else "long"
    lows, sizes = (
        F.array(*map(F.lit, values)).cast("array<" + kind + ">")
        for values in ([low for low, _ in intervals], [widths[interval] for interval in intervals])
    )
    x = F.col("x").cast(kind)
    at = F.col("interval")
    found = (
        keys.withColumn("interval", count_below(F.col("x"), [high for _, high in intervals]))
        .filter(F.col("interval") < len(intervals))
        .filter(F.col("x") >= F.get(lows, at))
        .select("interval", (x - F.get(lows, at)).alias("distance"), F.get(sizes, at).alias("width"))
        .selectExpr("interval", "CAST(distance div width AS BIGINT) AS bucket")
        .groupBy("interval", "bucket")
        .agg(F.expr("count(*)").alias("rows"))
        .collect()
    )
    counts: dict = {interval: {} for interval in intervals}
    for row in found:
        counts[intervals[row["interval"]]][row["bucket"]] = row["rows"]
    return counts


def _step(target: _Target, counts: dict[int, int], width: int) -> None:
    before = target.before
    for bucket in sorted(counts):
        if before + counts[bucket] > target.offset:
            low = target.low + bucket * width
            target.before, target.high, target.low = before, min(low + width - 1, target.high), low
            return
        before += counts[bucket]
    raise AssertionError("the table changed between two passes")


def key_ranges(boundaries: list) -> list[KeyRange]:
    """Contiguous ranges ``(lower, upper]``; the first and the last are open."""
    lowers = [None, *boundaries]
    uppers = [*boundaries, None]
    return [KeyRange(lower, upper) for lower, upper in zip(lowers, uppers)]


def _number_text(value: object) -> str:
    if isinstance(value, tuple):
        return "(" + ", ".join(map(_number_text, value)) + ")"
    return f"{value:,}" if isinstance(value, int) else str(value)


def range_label(number: int, total: int, column: str, key_range: KeyRange) -> str:
    """Fixed texts of a range label."""
    lower, upper = key_range.lower, key_range.upper
    if lower is None and upper is None:
        bounds = "all rows"
    elif lower is None:
        bounds = f"{column} ≤ {_number_text(upper)}"
    elif upper is None:
        bounds = f"{column} > {_number_text(lower)}"
    else:
        bounds = f"{column} {_number_text(lower)} – {_number_text(upper)}"
    return f"Chunk {number} of {total} ({bounds})"


def boundaries_frame(spark: SparkSession, boundaries: list, data_type: T.DataType) -> DataFrame:
    schema = T.StructType([T.StructField("boundary_no", T.IntegerType()), T.StructField("boundary", data_type)])
    return spark.createDataFrame(list(enumerate(boundaries, start=1)), schema)


def ranges_frame(spark: SparkSession, column: str, boundaries: list, data_type: T.DataType) -> DataFrame:
    """One row per range: ``bucket``, ``lower``, ``upper``, ``label``."""
    ranges = key_ranges(boundaries)
    schema = T.StructType(
        [
            T.StructField("bucket", T.IntegerType()),
            T.StructField("lower", data_type),
            T.StructField("upper", data_type),
            T.StructField("label", T.StringType()),
        ]
    )
    rows = [
        (number, key_range.lower, key_range.upper, range_label(number, len(ranges), column, key_range))
        for number, key_range in enumerate(ranges, start=1)
    ]
    return spark.createDataFrame(rows, schema)


def bucket_of(key: Column, boundaries: list) -> Column:
    """1-based number of the range that holds the key; NULL belongs to the first."""
    return count_below(key, boundaries) + 1


def with_bucket(rows: DataFrame, plan: ComparePlan, boundaries: list) -> DataFrame:
    """Aligned rows with the number of the range of their leading key, or of as many keys as a boundary has values.

    NULL is below everything, so that it belongs to the first range of what precedes it.
    """
    if not boundaries or not isinstance(boundaries[0], tuple):
        return rows.withColumn("bucket", bucket_of(F.expr(aligned_key(plan)[0]), boundaries))
    pairs = plan.keys[: len(boundaries[0])]
    kinds = [key_type(pair, SOURCE) for pair in pairs]
    keys = [F.expr(sql).cast(kind) for sql, kind in zip(aligned_key(plan), kinds)]
    return with_place(rows, keys, kinds, boundaries, "bucket").withColumn("bucket", F.expr("bucket div 2 + 1").cast("int"))


def diff_by_range(rows: DataFrame, plan: ComparePlan, boundaries: list) -> DataFrame:
    """Counts per key range, before moved rows are reconciled; they add up to the counts of the whole table."""
    return part_counts(with_bucket(rows, plan, boundaries), "bucket")


def tallies_by_range(rows: DataFrame, plan: ComparePlan, boundaries: list) -> DataFrame:
    """Orphan content tallies per key range, to be stored next to the counts and combined later."""
    return (
        with_bucket(rows, plan, boundaries)
        .filter(IS_ORPHAN)
        .selectExpr("bucket", "category", f"{orphan_content(plan)} AS content_hash")
        .groupBy("bucket", "content_hash")
        .agg(*[F.expr(f"count_if(category = '{name}')").alias(name) for name in ORPHANS])
    )
