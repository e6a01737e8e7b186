from concord.plans.compare_plan import (
    COERCE,
    STRICT,
    ColumnPair,
    CompareOptions,
    ComparePlan,
    KeyRange,
    common_columns,
    resolve_plan,
)
from concord.plans.table import TABLE, VIEW, Side, TableRef, pair_tables

__all__ = [
    "COERCE",
    "STRICT",
    "TABLE",
    "VIEW",
    "ColumnPair",
    "CompareOptions",
    "ComparePlan",
    "KeyRange",
    "Side",
    "TableRef",
    "common_columns",
    "pair_tables",
    "resolve_plan",
]
