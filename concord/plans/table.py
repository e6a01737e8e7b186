"""Tables as seen by a comparison."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

TABLE = "Table"
VIEW = "View"


@dataclass(frozen=True)
class TableRef:
    """One table or view of one side: its rows, its declared key and, for a view, its definition."""

    name: str
    df: DataFrame
    keys: tuple[str, ...] = ()
    schema_name: str = "dbo"
    kind: str = TABLE
    definition: str | None = None

    def __post_init__(self) -> None:
        object.__setattr__(self, "keys", tuple(self.keys))

    @property
    def full_name(self) -> str:
        return f"{self.schema_name}.{self.name}"


@dataclass(frozen=True)
class Side:
    """All tables and views of one side, addressed by case-insensitive full name."""

    tables: Mapping[str, TableRef] = field(default_factory=dict)

    @staticmethod
    def of(tables: Iterable[TableRef]) -> "Side":
        return Side({table.full_name.lower(): table for table in tables})

    def get(self, full_name: str) -> TableRef | None:
        return self.tables.get(full_name.lower())


def pair_tables(
    source: Side, target: Side, exclude: Iterable[str] = (), only: Iterable[str] | None = None
) -> list[tuple[TableRef, TableRef]]:
    """Tables and views found on both sides by case-insensitive name, in Source order.

    ``exclude`` and ``only`` accept the full name or the bare table name.
    """
    excluded = {name.lower() for name in exclude}
    wanted = None if only is None else {name.lower() for name in only}

    def listed(table: TableRef, names: set[str]) -> bool:
        return table.full_name.lower() in names or table.name.lower() in names

    pairs = []
    for table in source.tables.values():
        partner = target.get(table.full_name)
        if partner is None or listed(table, excluded):
            continue
        if wanted is None or listed(table, wanted):
            pairs.append((table, partner))
    return pairs
