"""Comparing keys with sorted bounds, of one or several key columns."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from functools import reduce
from math import prod

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bounds that are compared one by one.
FEW_BOUNDS = 24

_EPOCH = dt.datetime(1970, 1, 1)


def literal(value: object, kinds: Sequence[T.DataType], names: Sequence[str]) -> Column:
    """A bound of one or several key columns: the value itself or a struct in the order of the keys. A time may come as
    microseconds."""
    values = value if isinstance(value, tuple) else (value,)
    columns = []
    for part, kind in zip(values, kinds):
        if isinstance(part, int) and isinstance(kind, T.TimestampType):
            columns.append(F.timestamp_micros(F.lit(part).cast("long")))
            continue
        if isinstance(part, int) and isinstance(kind, T.TimestampNTZType):
            part = _EPOCH + dt.timedelta(microseconds=part)
        if isinstance(part, dt.datetime) and isinstance(kind, T.TimestampNTZType):
            part = part.isoformat(sep=" ")
        columns.append(F.lit(part).cast(kind))
    return columns[0] if len(columns) == 1 else F.struct(*[c.alias(name) for c, name in zip(columns, names)])


def count_below(key: Column, bounds: list) -> Column:
    """How many of the sorted ``bounds`` lie below the key; 0 for NULL.

    A few bounds are compared one by one, which is compiled code. Many are searched by halves: the expression doesn't grow
    with their number but for one literal array.
    """
    if len(bounds) <= FEW_BOUNDS:
        return reduce(Column.__add__, [F.when(key > F.lit(bound), 1).otherwise(0) for bound in bounds], F.lit(0))
    values = F.array(*map(F.lit, bounds))

    def halve(acc: Column, _: Column) -> Column:
        middle = F.floor((acc["low"] + acc["high"]) / 2).cast("int")
        above = (acc["low"] < acc["high"]) & (key > F.get(values, middle))
        low, high = F.when(above, middle + 1).otherwise(acc["low"]), F.when(above, acc["high"]).otherwise(middle)
        return F.struct(low.cast("int").alias("low"), high.cast("int").alias("high"))

    start = F.struct(F.lit(0).alias("low"), F.lit(len(bounds)).alias("high"))
    steps = F.sequence(F.lit(1), F.lit(len(bounds).bit_length()))
    return F.aggregate(steps, start, halve, lambda acc: acc["low"])


_PLAIN = (
    T.BooleanType, T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType, T.DateType,
    T.BinaryType,
)


def _ordered(kind: T.DataType, values: set) -> list | None:
    """The values as Spark orders them, or None where Python can't tell. The zone of the driver is in a time of an instant,
    unless it comes as microseconds."""
    if isinstance(kind, T.TimestampType):
        known = all(isinstance(value, int) for value in values)
    else:
        known = isinstance(kind, (*_PLAIN, T.TimestampNTZType)) or kind == T.StringType()
    return sorted(values) if known and all(value == value for value in values) else None


def _places(value: Column, bounds: list[Column]) -> Column:
    """Twice the number of ``bounds`` below the value, and one more where the value is one of them; 0 for NULL."""

    def search(low: int, high: int) -> Column:
        if low == high:
            return F.lit(2 * low)
        middle = (low + high) // 2
        higher = F.when(value > bounds[middle], search(middle + 1, high))
        return higher.when(value == bounds[middle], 2 * middle + 1).otherwise(search(low, middle))

    return search(0, len(bounds))


def with_place(df: DataFrame, keys: Sequence[Column], kinds: Sequence[T.DataType], bounds: list, name: str) -> DataFrame:
    """Adds where the keys lie among the sorted ``bounds``: ``2 * i`` between two of them, of which ``i`` are below, and
    ``2 * i + 1`` on the one that has ``i`` below it. NULL is below everything.

    Each key column is placed among its own few values in the bounds, and the places make one number that compares with the
    bounds as the whole key does: no struct is built or compared per row, and what is compiled stays small however many
    columns there are.
    """
    rows = [bound if isinstance(bound, tuple) else (bound,) for bound in bounds]
    own = [_ordered(kind, set(column)) for column, kind in zip(zip(*rows), kinds)]
    sizes = [2 * len(values or ()) + 1 for values in own]
    if not bounds:
        return df.withColumn(name, F.lit(0))
    if None in own or len(bounds) > FEW_BOUNDS or prod(sizes) >= 1 << 62:
        names = [f"k{i}" for i in range(len(kinds))]
        key = F.struct(*[column.alias(alias) for column, alias in zip(keys, names)]) if len(kinds) > 1 else keys[0]
        literals = [literal(bound, kinds, names) for bound in bounds]
        on_bound = F.coalesce(key == F.get(F.array(*literals), F.col(name)), F.lit(False)).cast("int")
        return df.withColumn(name, count_below(key, literals)).withColumn(name, 2 * F.col(name) + on_bound)
    code = F.lit(0).cast("long")
    for key, kind, values, size in zip(keys, kinds, own, sizes):
        code = code * size + _places(key, [literal(value, [kind], []) for value in values])
    numbers = []
    for row in rows:
        number = 0
        for value, values, size in zip(row, own, sizes):
            number = number * size + 2 * values.index(value) + 1
        numbers.append(F.lit(number).cast("long"))
    return df.withColumn(name, code).withColumn(name, _places(F.col(name), numbers))


def above(keys: Sequence[Column], bound: object) -> Column:
    """Whether the keys lie above the bound, column by column; NULL is below everything.

    The leading column is compared on its own as well, because that is what a scan can use to skip files and row groups.
    """
    values = bound if isinstance(bound, tuple) else (bound,)
    found = keys[len(values) - 1] > F.lit(values[-1])
    for key, value in reversed(list(zip(keys, values[:-1]))):
        found = (key > F.lit(value)) | ((key == F.lit(value)) & found)
    return (keys[0] >= F.lit(values[0])) & found if len(values) > 1 else found


def not_above(keys: Sequence[Column], bound: object) -> Column:
    """The opposite of :func:`above`, never NULL."""
    values = bound if isinstance(bound, tuple) else (bound,)
    last = keys[len(values) - 1]
    found = (last <= F.lit(values[-1])) | last.isNull()
    for key, value in reversed(list(zip(keys, values[:-1]))):
        found = (key < F.lit(value)) | key.isNull() | ((key == F.lit(value)) & found)
    return ((keys[0] <= F.lit(values[0])) | keys[0].isNull()) & found if len(values) > 1 else found
