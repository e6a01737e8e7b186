"""Equality of values across the two sides, as SQL text."""

from __future__ import annotations

from pyspark.sql import types as T

from concord.plans.compare_plan import COERCE, ColumnPair

_FAMILIES = (T.NumericType, (T.TimestampType, T.TimestampNTZType, T.DateType))


def shared_domain(pair: ColumnPair) -> bool:
    """Whether Spark can compare the two types as they are, without parsing text."""
    return pair.same_type or any(
        isinstance(pair.source_type, family) and isinstance(pair.target_type, family) for family in _FAMILIES
    )


def values_equal(source: str, target: str, pair: ColumnPair, type_policy: str) -> str:
    """NULL equals NULL, NULL never equals a value.

    Under the strict policy values of different types are unequal unless both are NULL. Under the coerce policy they
    are compared by value where the types allow it and as text otherwise.
    """
    if pair.large or pair.same_type:
        return f"{source} <=> {target}"
    if type_policy == COERCE:
        if shared_domain(pair):
            return f"{source} <=> {target}"
        return f"CAST({source} AS STRING) <=> CAST({target} AS STRING)"
    return f"{source} IS NULL AND {target} IS NULL"
