"""Writing expressions as SQL text.

Operators describe their expressions as text for ``selectExpr`` and ``expr``: a table of many columns becomes one call
per column instead of one call per function, which keeps planning short for wide tables and runs of many tables.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def quote(name: str, struct: str | None = None) -> str:
    """A column, or a field of a struct column, by its exact name, also when the name holds dots or spaces."""
    quoted = "`" + name.replace("`", "``") + "`"
    return f"{struct}.{quoted}" if struct else quoted


def col(name: str) -> Column:
    return F.col(quote(name))


def text(value: str) -> str:
    """A string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def truth(value: bool) -> str:
    return "true" if value else "false"


def all_of(conditions: Iterable[str]) -> str:
    return " AND ".join(f"({condition})" for condition in conditions) or "true"


def any_of(conditions: Iterable[str]) -> str:
    return " OR ".join(f"({condition})" for condition in conditions) or "false"


def struct_of(fields: Iterable[tuple[str, str]]) -> str:
    """A struct from (name, expression) pairs."""
    return "named_struct(" + ", ".join(f"{text(name)}, {value}" for name, value in fields) + ")"
