"""Position of a row inside its group, also when one group holds a large part of the table.

Repeated keys and moved rows are paired by position: the first Source row of a group with the first Target row, and so
on. ``row_number`` over the group gives the position, but it puts a whole group into one task. Groups above a row limit
are therefore placed by value range over many tasks: identical rows are counted first, the distinct rows are range
partitioned by (group, order), and the position is the count of rows in earlier partitions plus the count of earlier
rows in the own partition. Both ways give the same positions.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concord.functions.columns import all_of, col, quote
from concord.operators.expand import repeat_rows
from concord.session import materialize

HOT_GROUP_ROWS = 1_000_000
BROADCAST_GROUPS = 10_000
ROWS_PER_PLACE = 1_000_000
MOST_PLACES = 100_000

ROWS = "__rows"
START = "__start"
_PLACE = "__place"


@dataclass(frozen=True)
class HotGroups:
    """Groups above the row limit and the rows they hold together; ``few`` tells that their number was checked and is
    small enough to broadcast."""

    groups: DataFrame
    few: bool
    rows: int


def find_hot_groups(
    counts: DataFrame, group: Sequence[str], rows: str, limit: int = HOT_GROUP_ROWS
) -> HotGroups | None:
    """The groups of ``counts`` (one row per group) above the limit: at most total rows / limit of them."""
    hot = materialize(counts.filter(f"{quote(rows)} > {limit}"))
    number, total = hot.agg(F.expr("count(*)"), F.sum(rows)).first()
    return HotGroups(hot.select(*[col(name) for name in group]), number <= BROADCAST_GROUPS, total) if number else None


def places_for(df: DataFrame, rows: int, each: int = ROWS_PER_PLACE) -> int:
    """How many tasks ``rows`` rows are cut over: at least as many as the session shuffles into."""
    usual = max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return min(max(usual, -(-rows // each)), MOST_PLACES)


def ordering(names: Sequence[str]) -> str:
    return ", ".join(f"{quote(name)} ASC NULLS FIRST" for name in names)


def listing(names: Sequence[str]) -> str:
    return ", ".join(quote(name) for name in names)


def with_positions(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[str],
    position: str,
    hot: HotGroups | None = None,
) -> DataFrame:
    """Adds the 1-based position of each row inside its group, by ``order`` (ascending, NULL first).

    The columns of ``hot`` are some or all of the ``group`` columns. Without order columns all rows of a group are
    alike and any numbering does.
    """
    by = ordering(order) or "1"
    row_number = f"CAST(row_number() OVER (PARTITION BY {listing(group)} ORDER BY {by}) AS BIGINT) AS {quote(position)}"
    if hot is None:
        return df.selectExpr("*", row_number)
    cold, heavy = split_hot(df, hot)
    spread = spread_positions(heavy, group, order, position, places_for(df, hot.rows))
    return cold.selectExpr("*", row_number).unionByName(spread)


def split_hot(df: DataFrame, hot: HotGroups) -> tuple[DataFrame, DataFrame]:
    """Rows outside and inside the hot groups."""
    names = hot.groups.columns
    marks = hot.groups.selectExpr(*[f"{quote(name)} AS __hot_{i}" for i, name in enumerate(names)])
    marks = F.broadcast(marks) if hot.few else marks
    is_hot = F.expr(all_of(f"{quote(name)} <=> __hot_{i}" for i, name in enumerate(names)))
    return df.join(marks, is_hot, "left_anti"), df.join(marks, is_hot, "left_semi")


def spread_positions(
    df: DataFrame, group: Sequence[str], order: Sequence[str], position: str, places: int
) -> DataFrame:
    """Positions as by :func:`with_positions`, with every group cut over many tasks."""
    starts, largest = counted_starts(df, group, order, places)
    repeated = repeat_rows(starts, ROWS, "__copy", largest=largest)
    return repeated.selectExpr(*[quote(name) for name in df.columns], f"{START} + __copy AS {quote(position)}")


def counted_starts(
    df: DataFrame, group: Sequence[str], order: Sequence[str], places: int
) -> tuple[DataFrame, int]:
    """The distinct rows of ``df`` with their count in ``ROWS`` and the number of earlier rows of the group in ``START``;
    and the largest count."""
    columns = df.columns
    inner = [*order, *[name for name in columns if name not in group and name not in order]]
    counted = df.groupBy(*[col(name) for name in columns]).agg(F.expr("count(*)").alias(ROWS))
    by_range = [col(name).asc_nulls_first() for name in [*group, *inner]]
    # Both readers below need the same placement, so it is written once.
    placed = materialize(counted.repartitionByRange(places, *by_range).withColumn(_PLACE, F.spark_partition_id()))

    earlier = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    local = f"coalesce(sum({ROWS}) OVER (PARTITION BY {listing([*group, _PLACE])} ORDER BY {ordering(inner) or '1'} {earlier}), 0L)"
    # One row per group and place, so this window holds at most `places` rows of a group.
    before = (
        placed.groupBy(*[col(name) for name in group], _PLACE)
        .agg(F.sum(ROWS).alias(ROWS))
        .selectExpr(
            *[f"{quote(name)} AS __g{i}" for i, name in enumerate(group)],
            f"{_PLACE} AS __gp",
            f"coalesce(sum({ROWS}) OVER (PARTITION BY {listing(group)} ORDER BY {_PLACE} {earlier}), 0L) AS __before",
        )
    )
    same_place = all_of([*[f"{quote(name)} <=> __g{i}" for i, name in enumerate(group)], f"{_PLACE} = __gp"])
    starts = (
        placed.selectExpr("*", f"{local} AS __local")
        .join(before, F.expr(same_place))
        .selectExpr(*[quote(name) for name in columns], ROWS, f"__before + __local AS {START}")
    )
    return starts, placed.agg(F.max(ROWS)).first()[0] or 0
