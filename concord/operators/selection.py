"""Values at given positions of a sorted table, without sorting it.

Works for keys of any type that Spark orders, and for several key columns compared one after the other. In each round a
sample of bounded size puts two bracketing points around each wanted position; one counting pass tells exactly how many
rows lie below, on and between the points; the next round looks only between the points that hold a position. A sample
can be unlucky, which costs another round and never a wrong result. A stretch with no more rows than its share of the
sample is read whole, which ends the search. The table is scanned twice a round, each round leaves about a hundredth of
the rows, and what comes to the driver is bounded by ``SAMPLE`` and the number of positions.
"""

from __future__ import annotations

import datetime as dt
import math
from bisect import bisect_left
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from concord.functions.columns import col, quote
from concord.operators.bounds import with_place

#: Rows that the samples of one round bring to the driver, about.
SAMPLE = 1 << 16
#: Rows of a sample that a stretch gets at least, however many stretches are open.
LEAST_SHARE = 64
#: How far from a position its points lie, in standard deviations of its place in the sample.
SPREAD = 3.0

_EPOCH = dt.datetime(1970, 1, 1)


@dataclass
class _Stretch:
    """The rows between two neighbouring points: ``before`` rows lie below, ``rows`` inside."""

    before: int
    rows: int
    offsets: list[int]


def _encoded(name: str, data_type: T.DataType) -> str:
    """Timestamps travel as microseconds, because a Python datetime is read in the zone of the driver."""
    column = quote(name)
    if isinstance(data_type, T.TimestampType):
        return f"unix_micros({column})"
    if isinstance(data_type, T.TimestampNTZType):
        seconds = f"unix_date(CAST({column} AS DATE)) * 86400L + hour({column}) * 3600L + minute({column}) * 60L"
        return f"({seconds}) * 1000000L + CAST(extract(SECOND FROM {column}) * 1000000 AS BIGINT)"
    return column


def _decoded(value: object, data_type: T.DataType) -> object:
    if isinstance(data_type, T.TimestampType):
        return dt.datetime.fromtimestamp(value // 10**6).replace(microsecond=value % 10**6)
    if isinstance(data_type, T.TimestampNTZType):
        return _EPOCH + dt.timedelta(microseconds=value)
    return value


def _plain(value: object) -> object:
    return bytes(value) if isinstance(value, bytearray) else value


def _points(sample: list[tuple], stretch: _Stretch) -> list[tuple]:
    """Two values of the sorted sample around each wanted position."""
    found: set[int] = set()
    for offset in stretch.offsets:
        share = (offset - stretch.before + 0.5) / stretch.rows
        at = share * len(sample)
        spread = SPREAD * math.sqrt(len(sample) * share * (1 - share)) + 1
        found |= {math.floor(at - spread), math.floor(at + spread)}
    return [sample[at] for at in sorted(found) if 0 <= at < len(sample)]


def values_at(df: DataFrame, columns: Sequence[str], offsets: Sequence[int], sample: int = SAMPLE) -> list[tuple]:
    """The keys at the 0-based ``offsets`` of the rows of ``df`` in the order of ``columns``; rows with a NULL key don't count."""
    types = [df.schema[name].dataType for name in columns]
    names = [f"k{i}" for i in range(len(columns))]
    keys = df.where(" AND ".join(f"{quote(name)} IS NOT NULL" for name in columns))
    keys = keys.selectExpr(*[f"{quote(name)} AS {alias}" for name, alias in zip(columns, names)])
    encoded = [f"{_encoded(name, kind)} AS {name}" for name, kind in zip(names, types)]

    def placed(points: list[tuple]) -> DataFrame:
        return with_place(keys, [F.col(name) for name in names], types, points, "place")

    points: list[tuple] = []
    rows = keys.count()
    if any(not 0 <= offset < rows for offset in offsets):
        raise ValueError(f"offsets must lie in 0..{rows - 1}")
    open_at = {0: _Stretch(0, rows, sorted(offsets))} if offsets else {}
    found: dict[int, tuple] = {}
    turn = 0
    while open_at:
        share = max(LEAST_SHARE, sample // len(open_at))
        rates = [min(1.0, share / open_at[at].rows) if at in open_at else 0.0 for at in range(len(points) + 1)]
        # No row that lies on a point is wanted. The filter stays above the columns that it reads, because one is random.
        by_place = [rate for at in rates for rate in (at, 0.0)]
        drawn = placed(points).withColumn("draw", F.rand(turn))
        chosen = drawn.where(F.col("draw") < F.get(F.array(*map(F.lit, by_place)), F.col("place"))).drop("draw")
        samples: dict[int, list[tuple]] = {at: [] for at in open_at}
        # As many rows as the driver takes are sorted by one task, which saves the scan that a range partitioning takes.
        for row in chosen.repartition(1).sortWithinPartitions("place", *names).selectExpr("place", *encoded).collect():
            samples[row["place"] // 2].append(tuple(_plain(row[name]) for name in names))
        still: list[int] = []
        for at, stretch in open_at.items():
            if rates[at] < 1.0:
                still.append(at)
            else:
                found.update({offset: samples[at][offset - stretch.before] for offset in stretch.offsets})
        if not still:
            break
        # The ends of an open stretch stay points, so that the counts between them are those of its rows.
        finer: list[tuple] = []
        span: dict[int, tuple[int, int]] = {}
        for at in still:
            inside = list(dict.fromkeys(_points(samples[at], open_at[at])))
            if at > 0 and (not finer or finer[-1] is not points[at - 1]):
                finer.append(points[at - 1])
            low = len(finer)
            finer += inside
            span[at] = low, len(finer)
            if at < len(points):
                finer.append(points[at])
        counted = placed(finer).groupBy("place").agg(F.expr("count(*)").alias("rows")).collect()
        counts = {row["place"]: row["rows"] for row in counted}
        closer: dict[int, _Stretch] = {}
        for at in still:
            below, (low, high) = open_at[at].before, span[at]
            wanted = open_at[at].offsets
            for place in range(low, high + 1):
                for equal in (False, True):
                    if equal and place == high:
                        continue
                    here = counts.get(2 * place + equal, 0)
                    mine = wanted[bisect_left(wanted, below) : bisect_left(wanted, below + here)]
                    if mine and equal:
                        found.update(dict.fromkeys(mine, finer[place]))
                    elif mine:
                        closer[place] = _Stretch(below, here, mine)
                    below += here
        points, open_at, turn = finer, closer, turn + 1
    return [tuple(_decoded(value, kind) for value, kind in zip(found[offset], types)) for offset in offsets]


def row_count(df: DataFrame, columns: Sequence[str]) -> int:
    """Rows whose key columns are all filled."""
    return df.select(*map(col, columns)).where(" AND ".join(f"{quote(name)} IS NOT NULL" for name in columns)).count()
