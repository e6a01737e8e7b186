from __future__ import annotations

import datetime as dt
import tempfile

from concord import Side, compare_sides
from concord.operators import objects
from concord.operators.columns import column_changes, ddl_lines
from concord.sources.metadata import (
    catalog_functions,
    declared_columns,
    information_schema_columns,
    information_schema_objects,
    side_objects,
)
from concord.sources.readers import catalog_side, files_side

from comparing import TESTDATA


def views(spark, *columns):
    tables = spark.createDataFrame([("dbo", "T", "BASE TABLE"), ("dbo", "V", "VIEW")], "table_schema string, table_name string, table_type string")
    names = "table_schema string, table_name string, column_name string, ordinal_position int, is_nullable string, data_type string, character_octet_length int, numeric_precision int, numeric_scale int"
    constraints = spark.createDataFrame(
        [("dbo", "pk", "PRIMARY KEY"), ("dbo", "fk", "FOREIGN KEY")],
        "constraint_schema string, constraint_name string, constraint_type string",
    )
    usage = spark.createDataFrame(
        [("dbo", "pk", "dbo", "T", "b", 1), ("dbo", "pk", "dbo", "T", "a", 2), ("dbo", "fk", "dbo", "T", "c", 1)],
        "constraint_schema string, constraint_name string, table_schema string, table_name string, column_name string, ordinal_position int",
    )
    return spark.createDataFrame(list(columns), names), tables, constraints, usage


COLUMNS = (
    ("dbo", "T", "a", 1, "NO", "int", None, 10, 0),
    ("dbo", "T", "b", 2, "NO", "nvarchar", 100, None, None),
    ("dbo", "T", "c", 3, "YES", "varbinary", -1, None, None),
    ("dbo", "V", "a", 1, "YES", "decimal", None, 18, 4),
)


def test_information_schema_columns(spark):
    found = information_schema_columns(*views(spark, *COLUMNS))
    keys = {(row.table_name, row.column_name): (row.is_primary_key, row.primary_key_ordinal, row.kind) for row in found.collect()}
    assert keys == {
        ("T", "a"): (True, 2, "Table"),
        ("T", "b"): (True, 1, "Table"),
        ("T", "c"): (False, 0, "Table"),
        ("V", "a"): (False, 0, "View"),
    }
    lines = {row.ddl_line for row in ddl_lines(found).collect()}
    assert "[b] [nvarchar](50) NOT NULL" in lines and "[c] [varbinary](MAX) NULL" in lines and "[a] [decimal](18, 4) NULL" in lines
    wider = information_schema_columns(*views(spark, *COLUMNS[:1], ("dbo", "T", "b", 2, "NO", "nvarchar", 200, None, None), *COLUMNS[2:]))
    assert [(row.column_name, row.changed_facets) for row in column_changes(found, wider).collect()] == [("b", "max_length")]


def test_information_schema_objects(spark):
    _, tables, _, _ = views(spark, *COLUMNS)
    definitions = spark.createDataFrame([("dbo", "V", "SELECT 1")], "table_schema string, table_name string, view_definition string")
    moment = dt.datetime(2024, 1, 1)
    routines = spark.createDataFrame(
        [("dbo", "f", "FUNCTION", moment, "x"), ("dbo", "p", "PROCEDURE", moment, "y")],
        "routine_schema string, routine_name string, routine_type string, last_altered timestamp, routine_definition string",
    )
    found = {row.name: (row.kind, row.definition, row.modified_at) for row in information_schema_objects(tables, definitions, routines).collect()}
    assert found == {
        "T": ("Table", None, None),
        "V": ("View", "SELECT 1", None),
        "f": ("Function", "x", moment),
        "p": ("Stored procedure", "y", moment),
    }


def test_two_catalog_databases(spark):
    for name, amount, body in (("prod", 1, "x * 2"), ("stage", 2, "x * 3")):
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {name}")
        spark.range(3).selectExpr("id", f"id * {amount} AS v").write.mode("overwrite").saveAsTable(f"{name}.t")
        spark.sql(f"CREATE OR REPLACE VIEW {name}.big AS SELECT * FROM {name}.t WHERE v > {amount}")
        spark.sql(f"DROP FUNCTION IF EXISTS {name}.twice")
        spark.sql(f"CREATE FUNCTION {name}.twice(x INT) RETURNS INT RETURN {body}")
        spark.sql(f"DROP FUNCTION IF EXISTS {name}.same")
        spark.sql(f"CREATE FUNCTION {name}.same(x INT) RETURNS INT RETURN x")
    prod, stage = (catalog_side(spark, name, {"t": ("id",)}, "main") for name in ("prod", "stage"))
    run = compare_sides(prod, stage)
    assert {name: table.summary.first().comparison for name, table in run.tables.items()} == {"main.t": "keyed", "main.big": "multiset"}
    assert run["main.t"].summary.first().changed == 2
    lists = [
        side_objects(spark, side).unionByName(catalog_functions(spark, name, "main"))
        for side, name in ((prod, "prod"), (stage, "stage"))
    ]
    classes = {row.name: row.object_class for row in objects.object_classes(*lists).selectExpr("source_name AS name", "object_class").collect()}
    assert classes == {"t": "Identical", "big": "Different", "twice": "Different", "same": "Identical"}
    assert column_changes(declared_columns(spark, prod.tables.values()), declared_columns(spark, stage.tables.values())).count() == 0


def test_sides_in_other_file_formats(spark):
    folder = tempfile.mkdtemp(prefix="concord-formats-")
    supplier = spark.read.parquet(str(TESTDATA / "sf0.001" / "supplier.parquet"))
    schema = "s_suppkey long, s_name string, s_nationkey int, s_acctbal double"
    keys = {"supplier": ("s_suppkey",)}
    expected = files_side(spark, str(TESTDATA / "sf0.001"), keys)
    for file_format in ("orc", "json", "csv"):
        supplier.write.format(file_format).save(f"{folder}/supplier.{file_format}")
        side = files_side(spark, folder, keys, file_format, {"supplier": schema})
        row = compare_sides(expected, side).summary.first()
        assert (row.matched, row.has_differences) == (supplier.count(), False)
    assert isinstance(expected, Side)
