"""Keyed comparison: align both sides on the key and class every row.

The result holds one row per aligned key:

    category         matched, changed, only_in_source, only_in_target
    source_key       struct of the key columns, NULL when the row is missing in Source
    target_key       same for Target
    changed_columns  array of the names of unequal value columns, in column order
    source, target   structs of the value columns, NULL when the row is missing on that side

Only key and value columns are read. Large columns are replaced by their SHA-256 before the join, so the shuffle never
carries their content. A key range is applied to each side before the join, where it reaches the scan.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from concord.functions.canonical import comparable, comparable_type, content_hash, plain_text
from concord.functions.columns import all_of, any_of, col, quote, struct_of, text
from concord.functions.equality import values_equal
from concord.operators.bounds import above, not_above
from concord.operators.ordinals import HOT_GROUP_ROWS, HotGroups, find_hot_groups, places_for, with_positions
from concord.plans.compare_plan import ColumnPair, ComparePlan, KeyRange
from concord.plans.table import TableRef

MATCHED = "matched"
CHANGED = "changed"
ONLY_IN_SOURCE = "only_in_source"
ONLY_IN_TARGET = "only_in_target"
REASSIGNED = "reassigned"
ORPHANS = (ONLY_IN_SOURCE, ONLY_IN_TARGET)
IS_ORPHAN = f"category IN ('{ONLY_IN_SOURCE}', '{ONLY_IN_TARGET}')"

#: Rows of both sides that one task of an anti join sorts, about.
ROWS_PER_TASK = 250_000

SOURCE = "s"
TARGET = "t"
POSITION = "__position"


def in_range(keys: Sequence[Column], key_range: KeyRange | None) -> Column | None:
    """``(lower, upper]`` on the leading key, or on as many keys as a bound has values. NULL is below everything: a NULL key
    belongs to the first range, the one without a lower bound."""
    if key_range is None or (key_range.lower is None and key_range.upper is None):
        return None
    if key_range.lower is None:
        return not_above(keys, key_range.upper)
    low = above(keys, key_range.lower)
    if key_range.upper is None:
        return low
    if isinstance(key_range.upper, tuple):
        return low & not_above(keys, key_range.upper)
    return low & (keys[0] <= F.lit(key_range.upper))


def side_name(pair: ColumnPair, side: str) -> str:
    return pair.name if side == SOURCE else pair.target_name


def side_type(pair: ColumnPair, side: str) -> T.DataType:
    return pair.source_type if side == SOURCE else pair.target_type


def key_type(pair: ColumnPair, side: str) -> T.DataType:
    """Type of a key column inside the key struct."""
    return side_type(pair, side) if pair.same_type else T.StringType()


def value_type(pair: ColumnPair, side: str) -> T.DataType:
    """Type of a value column inside the source/target struct."""
    data_type = side_type(pair, side)
    if pair.large:
        return T.StringType()
    return comparable_type(data_type)


def key_expression(pair: ColumnPair, side: str) -> str:
    column = quote(side_name(pair, side))
    # Keys of different types are matched as text.
    key = column if pair.same_type else plain_text(column, side_type(pair, side))
    return f"collate({key}, '{pair.collation}')" if pair.collation else key


def spelled(name: str, pair: ColumnPair) -> str:
    """The key of a scanned row as its side spells it."""
    return f"collate({name}, 'UTF8_BINARY')" if pair.collation else name


def value_expression(pair: ColumnPair, side: str) -> str:
    column = quote(side_name(pair, side))
    if pair.large:
        return f"sha2(CAST({column} AS BINARY), 256)"
    return comparable(column, side_type(pair, side))


def side_frame(plan: ComparePlan, side: str) -> DataFrame:
    return plan.source.df if side == SOURCE else plan.target.df


def scan(plan: ComparePlan, side: str) -> DataFrame:
    """Key and value columns of one side as ``{side}k0.. {side}v0..`` and a presence flag."""
    df = side_frame(plan, side)
    if plan.keys:
        condition = in_range([col(side_name(pair, side)) for pair in plan.keys], plan.options.key_range)
        if condition is not None:
            df = df.filter(condition)
    return df.selectExpr(
        *[f"{key_expression(pair, side)} AS {side}k{i}" for i, pair in enumerate(plan.keys)],
        *[f"{value_expression(pair, side)} AS {side}v{i}" for i, pair in enumerate(plan.values)],
        f"true AS {side}_present",
    )


def _key_names(plan: ComparePlan, side: str) -> list[str]:
    return [f"{side}k{i}" for i in range(len(plan.keys))]


def _spelled_keys(plan: ComparePlan, side: str) -> list[str]:
    return [spelled(name, pair) for name, pair in zip(_key_names(plan, side), plan.keys)]


def _value_names(plan: ComparePlan, side: str) -> list[str]:
    return [f"{side}v{i}" for i in range(len(plan.values))]


def rows_per_key(plan: ComparePlan) -> DataFrame:
    """The larger row count of the two sides for each key: one scan of the key columns of each side."""
    names = [f"k{i}" for i in range(len(plan.keys))]
    source, target = (
        scan(plan, side).selectExpr(*[f"{side}{name} AS {name}" for name in names], f"{flag}L AS in_source")
        for side, flag in ((SOURCE, 1), (TARGET, 0))
    )
    return (
        source.unionByName(target)
        .groupBy(*names)
        .agg(F.expr("greatest(sum(in_source), sum(1L - in_source))").alias("rows"))
    )


@dataclass(frozen=True)
class KeyProfile:
    """What is known about the keys of both sides: whether they repeat, which repeat too often for one task, and whether
    none of them is NULL."""

    repeats: bool
    hot: HotGroups | None
    not_null: bool


def profile_keys(plan: ComparePlan, hot_rows: int) -> KeyProfile:
    """Trusts a key declared unique; otherwise looks at the keys of both sides first."""
    if plan.options.key_unique:
        return KeyProfile(False, None, plan.options.key_not_null)
    names = [f"k{i}" for i in range(len(plan.keys))]
    counts = rows_per_key(plan)
    has_null = any_of(f"{name} IS NULL" for name in names)
    most, nulls = counts.agg(F.expr("coalesce(max(rows), 0L)"), F.expr(f"count_if({has_null})")).first()
    not_null = plan.options.key_not_null or nulls == 0
    if most <= 1 and plan.options.key_unique is None:
        return KeyProfile(False, None, not_null)
    hot = find_hot_groups(counts, names, "rows", hot_rows) if most > hot_rows else None
    return KeyProfile(True, hot, not_null)


def _with_side_positions(plan: ComparePlan, side: str, hot: HotGroups | None) -> DataFrame:
    if hot is not None:
        groups = hot.groups.selectExpr(*[f"{name} AS {side}{name}" for name in hot.groups.columns])
        hot = replace(hot, groups=groups)
    return with_positions(scan(plan, side), _key_names(plan, side), _value_names(plan, side), f"{side}{POSITION}", hot)


def same_key(plan: ComparePlan, not_null: bool) -> str:
    """Keys without NULL join by plain equality, which can use the partitioning and bucketing of the raw columns."""
    operator = "=" if not_null else "<=>"
    return all_of(f"{SOURCE}k{i} {operator} {TARGET}k{i}" for i in range(len(plan.keys)))


def align(plan: ComparePlan, hot_rows: int = HOT_GROUP_ROWS, places: int | None = None) -> DataFrame:
    """Full outer join of the two scans on the key, cut into ``places`` tasks if given and keys neither repeat nor are NULL.

    When keys repeat, the rows of a key are paired by position in value order and the surplus stays unpaired.
    """
    if not plan.keys:
        raise ValueError(f"{plan.table_name} has no usable key; compare it as a multiset")
    profile = profile_keys(plan, hot_rows)
    condition = same_key(plan, profile.not_null)
    if profile.repeats:
        source, target = (_with_side_positions(plan, side, profile.hot) for side in (SOURCE, TARGET))
        condition += f" AND {SOURCE}{POSITION} = {TARGET}{POSITION}"
    else:
        source, target = scan(plan, SOURCE), scan(plan, TARGET)
        if places and profile.not_null:
            source, target = (df.repartition(places, *_key_names(plan, side)) for df, side in ((source, SOURCE), (target, TARGET)))
    return source.join(target, F.expr(condition), "full_outer")


def _struct(names: list[str], pairs: tuple[ColumnPair, ...], present: str) -> str:
    fields = [(pair.name, name) for name, pair in zip(names, pairs)] or [("present", "true")]
    return f"CASE WHEN {present} IS NOT NULL THEN {struct_of(fields)} END"


def keyed_rows(plan: ComparePlan, hot_rows: int = HOT_GROUP_ROWS) -> DataFrame:
    """Every aligned row with its category."""
    equal = [
        values_equal(f"{SOURCE}v{i}", f"{TARGET}v{i}", pair, plan.options.type_policy)
        for i, pair in enumerate(plan.values)
    ]
    category = (
        f"CASE WHEN {SOURCE}_present IS NULL THEN '{ONLY_IN_TARGET}' WHEN {TARGET}_present IS NULL THEN '{ONLY_IN_SOURCE}' "
        f"WHEN {all_of(equal)} THEN '{MATCHED}' ELSE '{CHANGED}' END"
    )
    names = ", ".join(f"CASE WHEN NOT ({same}) THEN {text(pair.name)} END" for same, pair in zip(equal, plan.values))
    nothing = "CAST(array() AS ARRAY<STRING>)"
    changed = f"array_compact(array({names}))" if names else nothing
    both = f"{SOURCE}_present IS NOT NULL AND {TARGET}_present IS NOT NULL"
    return align(plan, hot_rows).selectExpr(
        f"{category} AS category",
        f"{_struct(_spelled_keys(plan, SOURCE), plan.keys, SOURCE + '_present')} AS source_key",
        f"{_struct(_spelled_keys(plan, TARGET), plan.keys, TARGET + '_present')} AS target_key",
        f"CASE WHEN {both} THEN {changed} ELSE {nothing} END AS changed_columns",
        f"{_struct(_value_names(plan, SOURCE), plan.values, SOURCE + '_present')} AS source",
        f"{_struct(_value_names(plan, TARGET), plan.values, TARGET + '_present')} AS target",
    )


def differing(rows: DataFrame) -> DataFrame:
    return rows.filter(f"category <> '{MATCHED}'")


def one_sided(plan: ComparePlan, category: str) -> DataFrame:
    """Rows of one side whose key is missing on the other side: an anti join that reads only the key of the other side.

    Keys that are not declared unique may repeat: then the rows are aligned, and the surplus of a key belongs to the
    result as well.
    """
    if not plan.options.key_unique:
        struct = "source" if category == ONLY_IN_SOURCE else "target"
        return (
            keyed_rows(plan)
            .filter(f"category = '{category}'")
            .selectExpr(
                *[f"{quote(pair.name, struct + '_key')} AS {quote(pair.name)}" for pair in plan.keys],
                *[f"{quote(pair.name, struct)} AS {quote(pair.name)}" for pair in plan.values],
            )
        )
    side, other = (SOURCE, TARGET) if category == ONLY_IN_SOURCE else (TARGET, SOURCE)
    against = scan(plan, other).select(*_key_names(plan, other))
    own = scan(plan, side)
    rows = side_frame(plan, side).count() + side_frame(plan, other).count()
    places = places_for(own, rows, ROWS_PER_TASK)
    if plan.options.key_not_null and places > places_for(own, 0):
        # What a task sorts doesn't grow with the tables: the join gives its other side as many partitions.
        against = against.repartition(places, *_key_names(plan, other)).hint("merge")
    return (
        own.join(against, F.expr(same_key(plan, plan.options.key_not_null)), "left_anti")
        .selectExpr(
            *[f"{key} AS {quote(pair.name)}" for key, pair in zip(_spelled_keys(plan, side), plan.keys)],
            *[f"{side}v{i} AS {quote(pair.name)}" for i, pair in enumerate(plan.values)],
        )
    )


def orphan_content(plan: ComparePlan) -> str:
    """Content hash over the values of the side on which an orphan exists; NULL for other rows."""

    def side_hash(struct: str, side: str) -> str:
        return content_hash((quote(pair.name, struct), value_type(pair, side)) for pair in plan.values)

    return (
        f"CASE category WHEN '{ONLY_IN_SOURCE}' THEN {side_hash('source', SOURCE)} "
        f"WHEN '{ONLY_IN_TARGET}' THEN {side_hash('target', TARGET)} END"
    )


def aligned_key(plan: ComparePlan) -> list[str]:
    """The key columns of a row: of Source, or of Target for a row only there."""
    return [
        f"coalesce({quote(pair.name, 'source_key')}, {quote(pair.name, 'target_key')})"
        for pair in plan.keys
    ]


DIGEST = "__digest"


def digest_plan(plan: ComparePlan) -> ComparePlan | None:
    """The plan with the values of each row replaced by one SHA-256 before the shuffle.

    Counts stay the same: equal values have equal text and the text of a row is injective. The plan is None where that
    does not hold or nothing is gained: value columns of different types, no value columns, or keys that may repeat
    and would pair in another order.
    """
    if not plan.values or any(pair.source_type != pair.target_type for pair in plan.values):
        return None
    if plan.keys and not plan.options.key_unique:
        return None

    def digested(side: str) -> TableRef:
        table = plan.source if side == SOURCE else plan.target
        digest = content_hash((value_expression(pair, side), value_type(pair, side)) for pair in plan.values)
        keys = [quote(side_name(pair, side)) for pair in plan.keys]
        return replace(table, df=table.df.selectExpr(*keys, f"{digest} AS {DIGEST}"))

    pair = ColumnPair(DIGEST, DIGEST, T.StringType(), T.StringType())
    return replace(plan, source=digested(SOURCE), target=digested(TARGET), values=(pair,))
