"""Reconciliation of tables on Spark: is one table a faithful copy of another, and if not, where do they differ?"""

from concord.operators.run import RunComparison, TableComparison, compare_sides, compare_tables
from concord.plans import CompareOptions, KeyRange, Side, TableRef, resolve_plan
from concord.session import build_session

__all__ = [
    "CompareOptions",
    "KeyRange",
    "RunComparison",
    "Side",
    "TableComparison",
    "TableRef",
    "build_session",
    "compare_sides",
    "compare_tables",
    "resolve_plan",
]
