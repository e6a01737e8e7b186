"""Column, object and row-count metadata of a side."""

from __future__ import annotations

import json
from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from concord.functions.columns import quote, struct_of, text, truth
from concord.plans.table import TABLE, VIEW, Side, TableRef

COLUMN_SCHEMA = (
    "schema_name string, table_name string, kind string, column_name string, ordinal int, data_type string, "
    "max_length int, precision int, scale int, is_nullable boolean, is_identity boolean, is_primary_key boolean, "
    "primary_key_ordinal int"
)
#: Types whose smallest and largest value file footers hold in full.
FOOTER_TYPES = (
    T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.BooleanType, T.DateType
)
OBJECT_SCHEMA = "schema_name string, name string, kind string, modified_at timestamp, definition string"


def _declared(table: TableRef, field: T.StructField, ordinal: int) -> dict:
    """What is declared about a column. What Spark types do not carry may come in the field metadata:
    ``type``, ``max_length``, ``precision``, ``scale``, ``identity``."""
    metadata = field.metadata or {}
    keys = [name.lower() for name in table.keys]
    is_key = field.name.lower() in keys
    decimal = isinstance(field.dataType, T.DecimalType)
    return {
        "schema_name": table.schema_name,
        "table_name": table.name,
        "kind": table.kind,
        "column_name": field.name,
        "ordinal": ordinal,
        "data_type": metadata.get("type") or ("decimal" if decimal else field.dataType.simpleString()),
        "max_length": metadata.get("max_length", 0),
        "precision": metadata.get("precision", field.dataType.precision if decimal else 0),
        "scale": metadata.get("scale", field.dataType.scale if decimal else 0),
        "is_nullable": field.nullable,
        "is_identity": bool(metadata.get("identity", False)),
        "is_primary_key": is_key,
        "primary_key_ordinal": keys.index(field.name.lower()) + 1 if is_key else 0,
    }


def declared_columns(spark: SparkSession, tables: Iterable[TableRef]) -> DataFrame:
    """The column list from the table schemas alone."""
    rows = [
        _declared(table, field, ordinal)
        for table in tables
        for ordinal, field in enumerate(table.df.schema, start=1)
    ]
    return spark.createDataFrame(rows, COLUMN_SCHEMA)


def observed_columns(tables: Iterable[TableRef]) -> DataFrame:
    """The column list with length and nullability as the data shows them.

    Files declare every column nullable and text without a length; here text is ``varchar`` of the longest value in
    bytes and a column is nullable when it holds a NULL. One scan with a single global aggregation per table.
    """
    return reduce(DataFrame.unionByName, [_observed(table) for table in tables])


def _observed(table: TableRef) -> DataFrame:
    measures, entries = [], []
    for i, field in enumerate(table.df.schema):
        declared = _declared(table, field, i + 1)
        facts = {name: _literal(value) for name, value in declared.items()}
        measures.append(F.expr(f"count_if({quote(field.name)} IS NULL)").alias(f"nulls{i}"))
        facts["is_nullable"] = f"nulls{i} > 0"
        if isinstance(field.dataType, (T.StringType, T.BinaryType)):
            measures.append(F.expr(f"CAST(coalesce(max(octet_length({quote(field.name)})), 0) AS INT)").alias(f"length{i}"))
            facts["max_length"] = f"length{i}"
            facts["data_type"] = "'varchar'" if isinstance(field.dataType, T.StringType) else "'varbinary'"
        entries.append(struct_of(facts.items()))
    return table.df.agg(*measures).selectExpr(f"inline(array({', '.join(entries)}))")


def _literal(value: object) -> str:
    if isinstance(value, bool):
        return truth(value)
    return text(value) if isinstance(value, str) else str(value)


def side_objects(spark: SparkSession, side: Side) -> DataFrame:
    """Tables and views of a side as an object list; only views have a definition."""
    rows = [(t.schema_name, t.name, t.kind, None, t.definition) for t in side.tables.values()]
    return spark.createDataFrame(rows, OBJECT_SCHEMA)


def information_schema_columns(
    columns: DataFrame, tables: DataFrame, constraints: DataFrame, key_usage: DataFrame
) -> DataFrame:
    """The column list from the standard catalog views ``INFORMATION_SCHEMA.COLUMNS``, ``TABLES``, ``TABLE_CONSTRAINTS``
    and ``KEY_COLUMN_USAGE`` of a database, read over JDBC or from a dump.

    Lengths are in bytes, -1 for unbounded. The views do not tell identity columns; it is false.
    """
    primary = constraints.filter("constraint_type = 'PRIMARY KEY'").select("constraint_schema", "constraint_name")
    key = key_usage.join(primary, ["constraint_schema", "constraint_name"], "left_semi").selectExpr(
        "table_schema", "table_name", "column_name", "ordinal_position AS key_ordinal"
    )
    kind = tables.selectExpr(
        "table_schema", "table_name", f"IF(table_type = 'VIEW', '{VIEW}', '{TABLE}') AS kind"
    )
    return (
        columns.join(kind, ["table_schema", "table_name"])
        .join(key, ["table_schema", "table_name", "column_name"], "left")
        .selectExpr(
            "table_schema AS schema_name",
            "table_name",
            "kind",
            "column_name",
            "CAST(ordinal_position AS INT) AS ordinal",
            "data_type",
            "CAST(coalesce(character_octet_length, 0) AS INT) AS max_length",
            "CAST(coalesce(numeric_precision, 0) AS INT) AS precision",
            "CAST(coalesce(numeric_scale, 0) AS INT) AS scale",
            "is_nullable = 'YES' AS is_nullable",
            "false AS is_identity",
            "key_ordinal IS NOT NULL AS is_primary_key",
            "CAST(coalesce(key_ordinal, 0) AS INT) AS primary_key_ordinal",
        )
    )


def information_schema_objects(tables: DataFrame, views: DataFrame, routines: DataFrame) -> DataFrame:
    """The object list from ``INFORMATION_SCHEMA.TABLES``, ``VIEWS`` and ``ROUTINES``; modification dates are known for
    routines only."""
    table_likes = tables.join(
        views.select("table_schema", "table_name", "view_definition"), ["table_schema", "table_name"], "left"
    ).selectExpr(
        "table_schema AS schema_name",
        "table_name AS name",
        f"IF(table_type = 'VIEW', '{VIEW}', '{TABLE}') AS kind",
        "CAST(NULL AS TIMESTAMP) AS modified_at",
        "view_definition AS definition",
    )
    return table_likes.unionByName(
        routines.selectExpr(
            "routine_schema AS schema_name",
            "routine_name AS name",
            "IF(routine_type = 'FUNCTION', 'Function', 'Stored procedure') AS kind",
            "last_altered AS modified_at",
            "routine_definition AS definition",
        )
    )


def catalog_functions(spark: SparkSession, database: str, schema_name: str | None = None) -> DataFrame:
    """The functions stored in a catalog database as an object list, named under ``schema_name`` when given."""
    rows = [
        (schema_name or database, function.name, "Function", None, _function_text(function))
        for function in spark.catalog.listFunctions(database)
        if not function.isTemporary and function.namespace and function.namespace[-1] == database
    ]
    return spark.createDataFrame(rows, OBJECT_SCHEMA)


def _function_text(function) -> str:
    """Signature and body of a SQL function, which the catalog describes as JSON; the class of any other function."""
    try:
        facts = json.loads(function.description or "")
    except ValueError:
        return function.className
    body = facts.get("sqlFunction.expression") or facts.get("sqlFunction.query")
    if body is None:
        return function.className
    return f"({facts.get('sqlFunction.inputParam', '')}) RETURNS {facts.get('sqlFunction.returnType')} RETURN {body}"


def row_counts(source: Side, target: Side) -> DataFrame:
    """Exact row counts of every table of either side, side by side; NULL where a side lacks the table.

    For Parquet the count comes from file footers.
    """

    def counted(side: Side) -> DataFrame | None:
        parts = [
            table.df.agg(F.count(F.lit(1)).alias("rows")).select(
                F.lit(table.full_name).alias("table_name"), F.lit(table.full_name.lower()).alias("match"), "rows"
            )
            for table in side.tables.values()
        ]
        return reduce(DataFrame.unionByName, parts) if parts else None

    left, right = counted(source), counted(target)
    if left is None and right is None:
        raise ValueError("neither side has a table")
    if left is None:
        left = right.filter(F.lit(False))
    if right is None:
        right = left.filter(F.lit(False))
    s = left.select(F.col("match").alias("s_match"), F.col("table_name").alias("s_name"), F.col("rows").alias("source_rows"))
    t = right.select(F.col("match").alias("t_match"), F.col("table_name").alias("t_name"), F.col("rows").alias("target_rows"))
    return s.join(t, F.col("s_match") == F.col("t_match"), "full_outer").select(
        F.coalesce("s_name", "t_name").alias("table_name"), "source_rows", "target_rows"
    )


def footer_statistics(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """Rows of a Parquet folder and, for each column, ``{name}_filled``, ``{name}_min`` and ``{name}_max``, from file footers.

    Spark answers such aggregates from the footers only through its newer Parquet reader, for whole numbers, floats, booleans
    and dates; the session that has it on is one of its own, so that other reads keep their reader. A column of another type
    raises an error, because it would be read whole.
    """
    session = spark.newSession()
    older = session.conf.get("spark.sql.sources.useV1SourceList").split(",")
    session.conf.set("spark.sql.sources.useV1SourceList", ",".join(name for name in older if name.strip() != "parquet"))
    session.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    table = session.read.parquet(path)
    wrong = [name for name in columns if not isinstance(table.schema[name].dataType, FOOTER_TYPES)]
    if wrong:
        raise ValueError(f"file footers hold no exact bounds of {wrong}")
    return table.agg(
        F.expr("count(*)").alias("rows"),
        *[
            F.expr(f"{function}({quote(name)})").alias(f"{name}_{suffix}")
            for name in columns
            for function, suffix in (("count", "filled"), ("min", "min"), ("max", "max"))
        ],
    )
