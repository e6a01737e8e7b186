"""Readers for the tables of a side."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession

from concord.plans.compare_plan import KeyRange
from concord.plans.table import TABLE, VIEW, Side, TableRef

FILE_FORMATS = ("parquet", "orc", "csv", "json")


def read_files(spark: SparkSession, path: str, file_format: str = "parquet", schema: str | None = None, **options) -> DataFrame:
    """A table stored as files. Text formats need a schema: inferring one reads the data twice and may differ per side."""
    if file_format not in FILE_FORMATS:
        raise ValueError(f"file format must be one of {FILE_FORMATS}")
    if file_format in ("csv", "json") and schema is None:
        raise ValueError(f"{file_format} needs a schema")
    reader = spark.read.format(file_format).options(**options)
    return (reader.schema(schema) if schema else reader).load(path)


def files_side(
    spark: SparkSession,
    folder: str,
    keys: Mapping[str, Sequence[str]],
    file_format: str = "parquet",
    schemas: Mapping[str, str] | None = None,
    schema_name: str = "dbo",
    **options,
) -> Side:
    """A side of tables stored as ``folder/<name>.<format>``, with their keys (an empty list for a table without one)."""
    return Side.of(
        TableRef(
            name,
            read_files(spark, f"{folder}/{name}.{file_format}", file_format, (schemas or {}).get(name), **options),
            tuple(key),
            schema_name,
        )
        for name, key in keys.items()
    )


def catalog_side(
    spark: SparkSession,
    database: str,
    keys: Mapping[str, Sequence[str]] | None = None,
    schema_name: str | None = None,
) -> Side:
    """All tables and views of a catalog database; views never have a key unless one is given.

    Two databases of one catalog are compared under a common ``schema_name``.
    """
    keys = {name.lower(): tuple(key) for name, key in (keys or {}).items()}
    tables = []
    for table in spark.catalog.listTables(database):
        if table.isTemporary:
            continue
        full_name = f"`{database}`.`{table.name}`"
        is_view = table.tableType == "VIEW"
        tables.append(
            TableRef(
                table.name,
                spark.table(full_name),
                keys.get(table.name.lower(), ()),
                schema_name or database,
                VIEW if is_view else TABLE,
                view_definition(spark, full_name) if is_view else None,
            )
        )
    return Side.of(tables)


def view_definition(spark: SparkSession, full_name: str) -> str | None:
    described = spark.sql(f"DESCRIBE TABLE EXTENDED {full_name}").filter("col_name = 'View Text'").collect()
    return described[0]["data_type"] if described else None


def range_predicates(column: str, ranges: Sequence[KeyRange]) -> list[str]:
    """One WHERE condition per key range for a partitioned JDBC read; NULL keys go with the first range."""
    conditions = []
    for key_range in ranges:
        parts = []
        if key_range.lower is not None:
            parts.append(f"{column} > {_literal(key_range.lower)}")
        if key_range.upper is not None:
            parts.append(f"{column} <= {_literal(key_range.upper)}")
        condition = " AND ".join(parts) or "1 = 1"
        if key_range.lower is None and key_range.upper is not None:
            condition = f"({condition} OR {column} IS NULL)"
        conditions.append(condition)
    return conditions


def _literal(value: object) -> str:
    if isinstance(value, bool):
        return "1" if value else "0"
    if isinstance(value, (int, float)):
        return repr(value)
    return "'" + str(value).replace("'", "''") + "'"


def read_jdbc(
    spark: SparkSession,
    url: str,
    table: str,
    properties: Mapping[str, str],
    key_column: str | None = None,
    ranges: Sequence[KeyRange] = (),
) -> DataFrame:
    """A database table, read in one task per key range when ranges are given."""
    if key_column and ranges:
        return spark.read.jdbc(url, table, predicates=range_predicates(key_column, ranges), properties=dict(properties))
    return spark.read.jdbc(url, table, properties=dict(properties))
