"""How one pair of tables is compared: which columns are key, which are values, and under which rules."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, replace

from pyspark.sql import types as T

from concord.plans.table import TableRef

STRICT = "strict"
COERCE = "coerce"

TEMPORAL_TYPES = (T.DateType, T.TimestampType, T.TimestampNTZType, T.TimeType)


@dataclass(frozen=True)
class KeyRange:
    """Rows whose leading key lies in ``(lower, upper]``; an open bound is None.

    A bound that is a tuple holds values of as many leading keys, which are compared one after the other.
    """

    lower: object = None
    upper: object = None


@dataclass(frozen=True)
class CompareOptions:
    """Choices of the caller for one table.

    match_key            replaces the declared key for aligning rows
    declared_key_as_value  with a match key, whether the declared key is compared as a value
    exclude_columns      value columns that are not compared
    exclude_by_type      leave date, timestamp and uuid columns out of the values
    uuid_columns         text columns that hold a uuid (Spark has no uuid type); field metadata ``{"type": "uuid"}`` works too
    large_columns        columns compared by SHA-256; binary columns always are
    type_policy          ``strict``: values of different types differ unless both are NULL; ``coerce``: compared by value
    key_unique           True: trust that no key repeats; False: pair repeated keys by position; None: look
    key_not_null         True: use plain equality on the key, which lets bucketed tables join without a shuffle
    key_collation        collation under which text keys are equal, as ``UTF8_LCASE`` or ``UTF8_BINARY_RTRIM``; the rows keep
                         the spelling of each side; goes with neither key ranges nor digests
    key_range            compare only this range of the leading key, or keys
    summary_by_digest    count the summary of wide rows from one SHA-256 per row, which is all that is shuffled besides the
                         key; applies to keyless tables and unique keys whose values have the same types on both sides
    """

    match_key: tuple[str, ...] = ()
    declared_key_as_value: bool = False
    exclude_columns: tuple[str, ...] = ()
    exclude_by_type: bool = True
    uuid_columns: tuple[str, ...] = ()
    large_columns: tuple[str, ...] = ()
    type_policy: str = STRICT
    key_unique: bool | None = None
    key_not_null: bool = False
    key_range: KeyRange | None = None
    key_collation: str | None = None
    summary_by_digest: bool = False

    def __post_init__(self) -> None:
        if self.type_policy not in (STRICT, COERCE):
            raise ValueError(f"type_policy must be {STRICT!r} or {COERCE!r}, got {self.type_policy!r}")
        if self.key_collation is not None and not re.fullmatch(r"\w+", self.key_collation):
            raise ValueError(f"not a name of a collation: {self.key_collation!r}")
        if self.key_collation is not None and self.key_range is not None:
            raise ValueError("key ranges are cut by plain order, under which equal keys of a collation may lie apart")


@dataclass(frozen=True)
class ColumnPair:
    """One common column: Source spelling is the reported name, each side keeps its own spelling and type."""

    name: str
    target_name: str
    source_type: T.DataType
    target_type: T.DataType
    large: bool = False
    collation: str | None = None

    @property
    def same_type(self) -> bool:
        return comparable(self.source_type, self.target_type)


@dataclass(frozen=True)
class ComparePlan:
    table_name: str
    source: TableRef
    target: TableRef
    common: tuple[ColumnPair, ...]
    keys: tuple[ColumnPair, ...]
    values: tuple[ColumnPair, ...]
    options: CompareOptions

    @property
    def usable_key(self) -> bool:
        return bool(self.keys)

    @property
    def keys_only(self) -> bool:
        return self.usable_key and not self.values


def comparable(left: T.DataType, right: T.DataType) -> bool:
    """Whether two types hold the same kind of value: decimals of any scale do, and so do all text types."""
    if isinstance(left, T.DecimalType) and isinstance(right, T.DecimalType):
        return True
    text = (T.StringType, T.CharType, T.VarcharType)
    if isinstance(left, text) and isinstance(right, text):
        return True
    if isinstance(left, T.ArrayType) and isinstance(right, T.ArrayType):
        return comparable(left.elementType, right.elementType)
    if isinstance(left, T.MapType) and isinstance(right, T.MapType):
        return comparable(left.keyType, right.keyType) and comparable(left.valueType, right.valueType)
    if isinstance(left, T.StructType) and isinstance(right, T.StructType):
        return [field.name.lower() for field in left] == [field.name.lower() for field in right] and all(
            comparable(a.dataType, b.dataType) for a, b in zip(left, right)
        )
    return left == right


def common_columns(source: TableRef, target: TableRef, large_columns: Iterable[str] = ()) -> tuple[ColumnPair, ...]:
    """Columns found on both sides by case-insensitive name, in Source order."""
    targets = {field.name.lower(): field for field in target.df.schema}
    large = {name.lower() for name in large_columns}
    pairs = []
    for field in source.df.schema:
        partner = targets.get(field.name.lower())
        if partner is not None:
            is_large = field.name.lower() in large or (
                isinstance(field.dataType, T.BinaryType) and isinstance(partner.dataType, T.BinaryType)
            )
            pairs.append(ColumnPair(field.name, partner.name, field.dataType, partner.dataType, is_large))
    return tuple(pairs)


def _excluded_by_type(table: TableRef, uuid_columns: Iterable[str]) -> set[str]:
    uuids = {name.lower() for name in uuid_columns}
    return {
        field.name.lower()
        for field in table.df.schema
        if isinstance(field.dataType, TEMPORAL_TYPES)
        or field.name.lower() in uuids
        or str((field.metadata or {}).get("type", "")).lower() in ("uuid", "uniqueidentifier")
    }


def _collated(pair: ColumnPair, collation: str | None) -> ColumnPair:
    """Collations are for text; keys of different types are matched as text and so are collated too."""
    text = (T.StringType, T.CharType, T.VarcharType)
    applies = not pair.same_type or isinstance(pair.source_type, text)
    return replace(pair, collation=collation if applies else None)


def resolve_plan(source: TableRef, target: TableRef, options: CompareOptions | None = None) -> ComparePlan:
    """Splits the common columns into key and values.

    The declared key is usable when both sides declare the same non-empty list in the same order. A match key replaces
    it and must name common columns. Without a usable key the tables are compared as multisets of the value columns.
    """
    options = options or CompareOptions()
    common = common_columns(source, target, options.large_columns)
    by_name = {pair.name.lower(): pair for pair in common}
    declared = [name.lower() for name in source.keys]
    declared_usable = bool(declared) and declared == [name.lower() for name in target.keys]

    if options.match_key:
        key_names = [name.lower() for name in options.match_key]
        missing = [name for name in options.match_key if name.lower() not in by_name]
        if missing:
            raise ValueError(f"match key of {source.full_name} names columns that are not common: {missing}")
    else:
        key_names = declared if declared_usable and all(name in by_name for name in declared) else []

    excluded = {name.lower() for name in options.exclude_columns}
    if options.exclude_by_type:
        excluded |= _excluded_by_type(source, options.uuid_columns)
    if options.match_key and not options.declared_key_as_value:
        excluded |= set(declared)

    keys = tuple(_collated(by_name[name], options.key_collation) for name in key_names)
    values = tuple(
        pair for pair in common if pair.name.lower() not in key_names and pair.name.lower() not in excluded
    )
    return ComparePlan(source.full_name, source, target, common, keys, values, options)
