from __future__ import annotations

import datetime as dt

import pytest

from concord import Side, TableRef
from concord.operators import columns as column_ops
from concord.operators import objects
from concord.sources.metadata import COLUMN_SCHEMA, OBJECT_SCHEMA, declared_columns, observed_columns, row_counts, side_objects
from concord.sources.readers import catalog_side


def column(table="Customers", name="Name", kind="Table", **changes):
    row = dict(
        schema_name="dbo",
        table_name=table,
        kind=kind,
        column_name=name,
        ordinal=1,
        data_type="nvarchar",
        max_length=50,
        precision=0,
        scale=0,
        is_nullable=True,
        is_identity=False,
        is_primary_key=False,
        primary_key_ordinal=0,
    )
    row.update(changes)
    return row


def column_list(spark, *rows):
    return spark.createDataFrame(list(rows), COLUMN_SCHEMA)


def object_list(spark, *rows):
    return spark.createDataFrame([("dbo", name, kind, None, text) for name, kind, text in rows], OBJECT_SCHEMA)


def changes(spark, source, target):
    found = column_ops.column_changes(column_list(spark, *source), column_list(spark, *target))
    return sorted((row.column_name, row.change, row.changed_facets) for row in found.collect())


@pytest.mark.parametrize(
    "facet,value",
    [
        ("data_type", "varchar"),
        ("max_length", 100),
        ("precision", 3),
        ("scale", 1),
        ("is_nullable", False),
        ("is_identity", True),
        ("is_primary_key", True),
    ],
)
def test_each_facet_counts_as_a_change(spark, facet, value):
    assert changes(spark, [column()], [column(**{facet: value})]) == [("Name", "Changed", facet)]


def test_what_is_no_column_change(spark):
    same = column(table="CUSTOMERS", name="NAME", data_type="NVARCHAR", ordinal=9, primary_key_ordinal=3)
    assert changes(spark, [column()], [same]) == []


def test_one_sided_columns_and_tables(spark):
    source = [column(), column(name="Old"), column(table="Gone")]
    target = [column(), column(name="New"), column(table="Fresh")]
    assert changes(spark, source, target) == [("New", "Only in Target", ""), ("Old", "Only in Source", "")]


def classes(spark, source, target, marks=None):
    found = objects.object_classes(object_list(spark, *source), object_list(spark, *target), marks)
    return {row.full_name: row.object_class for row in found.collect()}


def test_object_classes(spark):
    source = [("T", "Table", None), ("V", "View", "a"), ("F", "Function", "x"), ("P", "Stored procedure", "p"), ("Same", "View", "s")]
    target = [("t", "Table", None), ("V", "View", "A"), ("F", "Function", None), ("Q", "Stored procedure", "p"), ("Same", "View", "s")]
    assert classes(spark, source, target) == {
        "dbo.T": "Identical",
        "dbo.V": "Different",
        "dbo.F": "Different",
        "dbo.P": "Only in Source",
        "dbo.Q": "Only in Target",
        "dbo.Same": "Identical",
    }
    marks = spark.createDataFrame([("DBO.t",)], "full_name string")
    assert classes(spark, source, target, marks)["dbo.T"] == "Different"


def test_a_table_and_a_routine_of_one_name_are_two_objects(spark):
    found = objects.object_presence(object_list(spark, ("X", "Table", None)), object_list(spark, ("X", "Function", "f")))
    assert sorted((row.kind, row.presence) for row in found.collect()) == [
        ("Function", "Only in Target"),
        ("Table", "Only in Source"),
    ]


def test_modified_dates_are_reported(spark):
    moment = dt.datetime(2024, 5, 1, 12, 30)
    source = spark.createDataFrame([("dbo", "V", "View", moment, "a")], OBJECT_SCHEMA)
    target = spark.createDataFrame([("dbo", "V", "View", None, "a")], OBJECT_SCHEMA)
    row = objects.object_classes(source, target).first()
    assert (row.object_class, row.source_modified_at, row.target_modified_at) == ("Identical", moment, None)


def numbered(prefix, count, kind="Table", text=None):
    return [(f"{prefix}{i}", kind, text) for i in range(count)]


def percentages(spark, source, target):
    row = objects.difference_percentages(objects.object_classes(object_list(spark, *source), object_list(spark, *target))).first()
    return round(row[0], 4), round(row[1], 4), row[2]


def test_percentages(spark):
    # 10 source objects: 2 only there, 1 only in target, 3 of the 8 common ones differ.
    source = numbered("a", 5, "View", "x") + numbered("d", 3, "View", "x") + numbered("s", 2)
    target = numbered("a", 5, "View", "x") + numbered("d", 3, "View", "y") + numbered("t", 1)
    assert percentages(spark, source, target) == (27.2727, 37.5, False)
    assert percentages(spark, [], []) == (0.0, 0.0, True)
    # 5 source objects: a routine only in Source, a table only in Target, a routine different.
    source = numbered("k", 3) + [("f", "Function", "x"), ("gone", "Stored procedure", "p")]
    target = numbered("k", 3) + [("f", "Function", "y"), ("new", "Table", None)]
    assert percentages(spark, source, target) == (33.3333, 25.0, False)


def kinds(spark, source, target, compared=objects.KINDS):
    found = objects.object_classes(object_list(spark, *source), object_list(spark, *target))
    return {row.kind: row for row in objects.kind_summary(found, compared).collect()}


def test_summary_per_kind(spark):
    source = [("Customers", "Table", None), ("Orders", "Table", None), ("P", "Stored procedure", "x")]
    target = [("Customers", "Table", None), ("P", "Stored procedure", "x"), ("Q", "Stored procedure", "x")]
    found = kinds(spark, source, target)
    assert set(found) == {"Tables", "Stored Procedures"}
    assert (found["Tables"].source_count, found["Tables"].target_count, found["Tables"].only_in_source) == (2, 1, 1)
    procedures = found["Stored Procedures"]
    assert (procedures.source_count, procedures.target_count, procedures.only_in_target) == (1, 2, 1)
    assert kinds(spark, [("P", "Stored procedure", "x")], [])["Stored Procedures"].difference_percent == 100.0


def test_kind_that_was_not_compared_is_stated(spark):
    found = kinds(spark, [("T", "Table", None)], [("T", "Table", None)], ("Table", "View"))
    assert found["Tables"].status == "compared" and found["Functions"].status == "not compared"
    assert found["Functions"].source_count is None and "Views" not in found


def test_view_that_became_a_table(spark):
    found = kinds(spark, [("X", "View", "v")], [("X", "Table", None)])
    assert (found["Views"].source_count, found["Views"].target_count, found["Views"].different) == (1, 0, 1)
    assert (found["Tables"].source_count, found["Tables"].target_count, found["Tables"].different) == (0, 1, 0)


@pytest.mark.parametrize(
    "facts,line",
    [
        (dict(data_type="nvarchar", max_length=100), "[Name] [nvarchar](50) NULL"),
        (dict(data_type="varchar", max_length=100), "[Name] [varchar](100) NULL"),
        (dict(data_type="varbinary", max_length=-1), "[Name] [varbinary](MAX) NULL"),
        (dict(data_type="nchar", max_length=-1), "[Name] [nchar](MAX) NULL"),
        (dict(data_type="decimal", precision=18, scale=2, is_nullable=False), "[Name] [decimal](18, 2) NOT NULL"),
        (dict(data_type="int"), "[Name] [int] NULL"),
    ],
)
def test_ddl_line(spark, facts, line):
    assert column_ops.ddl_lines(column_list(spark, column(**facts))).first().ddl_line == line


def ddl(spark, source, target):
    found = column_ops.ddl_diff(column_list(spark, *source), column_list(spark, *target)).orderBy("line_no").collect()
    return [(row.source_text, row.target_text, row.highlight) for row in found]


def test_ddl_diff(spark):
    source = [column(name="Id", data_type="int"), column(name="Name", ordinal=2), column(name="Old", data_type="int", ordinal=3)]
    target = [column(name="Id", data_type="int"), column(name="NAME", ordinal=2, max_length=100), column(name="New", data_type="int", ordinal=3)]
    assert ddl(spark, source, target) == [
        ("CREATE TABLE [dbo].[Customers]", "CREATE TABLE [dbo].[Customers]", False),
        ("(", "(", False),
        ("    [Id] [int] NULL,", "    [Id] [int] NULL,", False),
        ("    [Name] [nvarchar](25) NULL,", "    [NAME] [nvarchar](50) NULL,", True),
        ("    [Old] [int] NULL,", None, True),
        (None, "    [New] [int] NULL", True),
        (")", ")", False),
    ]


def test_ddl_of_a_missing_table_is_all_highlighted(spark):
    found = ddl(spark, [column(kind="View")], [column(table="Other")])
    gone = [line for line in found if line[0] is not None]
    assert gone == [
        ("CREATE VIEW [dbo].[Customers]", None, True),
        ("(", None, True),
        ("    [Name] [nvarchar](25) NULL", None, True),
        (")", None, True),
    ]


def test_declared_and_observed_columns(spark):
    df = spark.createDataFrame([(1, "abc", None), (2, "é", None)], "id int not null, name string, at decimal(8,3)")
    table = TableRef("T", df, ("ID",))
    declared = {row.column_name: row for row in declared_columns(spark, [table]).collect()}
    assert (declared["id"].is_primary_key, declared["id"].primary_key_ordinal, declared["id"].is_nullable) == (True, 1, False)
    assert (declared["at"].data_type, declared["at"].precision, declared["at"].scale) == ("decimal", 8, 3)
    observed = {row.column_name: row for row in observed_columns([table]).collect()}
    assert (observed["name"].data_type, observed["name"].max_length, observed["name"].is_nullable) == ("varchar", 3, False)
    assert observed["at"].is_nullable


def test_catalog_side_and_row_counts(spark):
    spark.sql("CREATE DATABASE IF NOT EXISTS shop")
    spark.sql("CREATE OR REPLACE VIEW shop.open_orders AS SELECT 1 AS id UNION ALL SELECT 2")
    side = catalog_side(spark, "shop", {"Open_Orders": ("id",)})
    view = side.get("SHOP.OPEN_ORDERS")
    assert view.kind == "View" and "UNION ALL" in view.definition and view.keys == ("id",)
    assert side_objects(spark, side).first().definition == view.definition
    other = Side.of([TableRef("Open_Orders", spark.range(5), schema_name="Shop"), TableRef("x", spark.range(1))])
    counts = {row.table_name: (row.source_rows, row.target_rows) for row in row_counts(side, other).collect()}
    assert counts == {"shop.open_orders": (2, 5), "dbo.x": (None, 1)}
    spark.sql("DROP VIEW shop.open_orders")
