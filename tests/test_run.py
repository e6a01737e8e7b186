from __future__ import annotations

import tempfile

import pytest
from pyspark.sql import functions as F

from concord import CompareOptions, Side, TableRef, compare_sides, compare_tables
from concord.demo import queries as demo
from concord.operators import summary
from concord.operators.examples import capped_examples
from concord.sources.readers import read_files
from concord.sources.sinks import discrepancy_rows, write_run

from comparing import TESTDATA

FOLDER = str(TESTDATA / "sf0.001")
COUNTS = ("source_rows", "target_rows", "matched", "changed", "missing_from_target", "missing_from_source", "reassigned")


def numbers(row):
    return tuple(row[name] for name in COUNTS)


def swapped(comparison):
    return compare_tables(comparison.plan.target, comparison.plan.source, comparison.plan.options).summary.first()


def test_expected_counts_of_derived_targets(spark):
    assert numbers(demo.orders(spark, FOLDER).summary.first()) == (1500, 1479, 1337, 120, 31, 10, 12)
    assert numbers(demo.lineitem(spark, FOLDER).summary.first()) == (6000, 5965, 5846, 0, 154, 119, 0)
    options = CompareOptions(match_key=("l_orderkey", "l_linenumber"), exclude_by_type=False)
    row = summary.part_counts(demo.lineitem(spark, FOLDER, options).rows).first()
    assert (row.matched, row.changed, row.only_in_source, row.only_in_target) == (5838, 91, 71, 36)


def test_swapping_sides_swaps_the_missing_counts(spark):
    for comparison in (demo.orders(spark, FOLDER), demo.lineitem(spark, FOLDER)):
        there, back = comparison.summary.first(), swapped(comparison)
        assert (there.matched, there.changed, there.reassigned) == (back.matched, back.changed, back.reassigned)
        assert there.missing_from_target == back.missing_from_source and there.missing_from_source == back.missing_from_target
        assert there.source_rows == there.matched + there.changed + there.missing_from_target + there.reassigned


def test_same_result_when_the_key_is_looked_at_or_paired(spark):
    expected = numbers(demo.orders(spark, FOLDER).summary.first())
    for unique in (None, False):
        options = CompareOptions(key_unique=unique, exclude_by_type=False)
        assert numbers(demo.orders(spark, FOLDER, options).summary.first()) == expected


@pytest.mark.parametrize("hot_rows", [1, 3])
def test_spreading_groups_gives_the_same_pairs(spark, hot_rows):
    options = CompareOptions(match_key=("l_linenumber", "l_returnflag"), exclude_by_type=False)
    usual, spread = (
        compare_tables(comparison.plan.source, comparison.plan.target, options, hot_rows=limit).rows
        for comparison in (demo.lineitem(spark, FOLDER),)
        for limit in (1_000_000, hot_rows)
    )
    assert usual.exceptAll(spread).count() == 0 and spread.exceptAll(usual).count() == 0


def test_summary_percentages(spark):
    def percent(**counts):
        row = dict.fromkeys(COUNTS, 0) | counts
        schema = ", ".join(f"{name} long" for name in COUNTS)
        found = summary._with_verdict(spark.createDataFrame([tuple(row[name] for name in COUNTS)], schema)).first()
        return found.has_differences, found.percent_differs

    assert percent(source_rows=100, changed=3, missing_from_target=2, missing_from_source=1, reassigned=4) == (True, 10.0)
    assert percent(missing_from_source=5) == (True, 0.0)
    assert percent(source_rows=10, matched=10) == (False, 0.0)
    assert percent(source_rows=1, missing_from_source=5)[1] == 500.0


def small_sides(spark):
    same = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    other = spark.createDataFrame([(1, "a"), (2, "x"), (3, "c")], "id int, v string")
    source = Side.of([TableRef("A", same, ("id",)), TableRef("b", same, ("id",)), TableRef("c", same), TableRef("only", same)])
    target = Side.of([TableRef("a", same, ("id",)), TableRef("B", other, ("id",)), TableRef("C", other), TableRef("extra", same)])
    return source, target


def test_pairing_exclusion_order_and_rollup(spark):
    source, target = small_sides(spark)
    run = compare_sides(source, target)
    assert [row.table_name for row in run.report().collect()] == ["dbo.b", "dbo.c", "dbo.A"]
    rollup = run.rollup().first()
    assert (rollup.tables_compared, rollup.tables_differing) == (3, 2)
    assert set(compare_sides(source, target, exclude=("DBO.B", "a")).tables) == {"dbo.c"}
    assert set(compare_sides(source, target, only=("C",)).tables) == {"dbo.c"}
    nothing = compare_sides(source, target, only=())
    assert nothing.tables == {} and nothing.summary is None


def test_options_apply_per_table(spark):
    source, target = small_sides(spark)
    run = compare_sides(source, target, options={"B": CompareOptions(exclude_columns=("v",))})
    assert run["dbo.b"].summary.first().changed == 0
    assert run["dbo.c"].summary.first().missing_from_target == 1


def test_recompared_table_replaces_its_row(spark):
    source, target = small_sides(spark)
    old = compare_sides(source, target).summary
    new = compare_sides(source, target, options={"b": CompareOptions(exclude_columns=("v",))}, only=("b",)).summary
    merged = {row.table_name: row.changed for row in summary.replace_tables(old, new).collect()}
    assert merged == {"dbo.A": 0, "dbo.b": 0, "dbo.c": 0}


@pytest.mark.parametrize("file_format", ["parquet", "json", "orc", "csv"])
def test_writing_a_run(spark, file_format):
    source, target = small_sides(spark)
    folder = tempfile.mkdtemp(prefix="concord-sink-")
    run = compare_sides(source, target)
    for _ in range(2):  # a repeated run replaces its own rows
        written = write_run(run, folder, file_format)
    expected = {row.table_name: numbers(row) for row in run.summary.collect()}
    assert {row.table_name: numbers(row) for row in written.collect()} == expected
    reader = spark.read.format(file_format)
    schema = "row_key string, changed_columns string, source string, target string, row_count long, category string, table_name string"
    if file_format == "csv":
        schema = "row_key string, changed_columns string, source_key string, target_key string, source string, target string, row_count long, category string, table_name string"
    rows = reader.schema(schema).load(f"{folder}/differences").collect()
    assert sorted((row.table_name, row.category, row.row_count) for row in rows) == [
        ("dbo.b", "changed", 1),
        ("dbo.b", "only_in_target", 1),
        ("dbo.c", "only_in_source", 1),
        ("dbo.c", "only_in_target", 1),
        ("dbo.c", "only_in_target", 1),
    ]
    assert reader.schema("table_name string").load(f"{folder}/summary").count() == 3


def test_discrepancy_rows_hold_every_difference(spark):
    comparison = demo.orders(spark, FOLDER)
    assert discrepancy_rows(comparison).count() == comparison.differences.count() == 173


def test_examples_are_capped_and_totals_exact(spark):
    rows = spark.createDataFrame([(c, i) for c, n in (("x", 25), ("y", 3)) for i in range(n)], "category string, k int")
    found = capped_examples(rows, ["category"], ["k"], 10).orderBy("category", "example_no").collect()
    assert [(row.k, row.total, row.not_shown) for row in found if row.category == "x"] == [(i, 25, 15) for i in range(10)]
    assert [(row.k, row.total, row.not_shown) for row in found if row.category == "y"] == [(i, 3, 0) for i in range(3)]


def test_acceptance(spark):
    comparison = demo.orders(spark, FOLDER)
    keys = comparison.difference_keys()
    before = comparison.summary.first()
    changed = keys.filter("category = 'changed'").orderBy("row_key").limit(5)
    repeated = changed.unionByName(changed)  # accepting twice counts once
    foreign = keys.limit(1).withColumn("row_key", F.lit("o_orderkey=-1"))
    row = summary.accepted_summary(keys, repeated.unionByName(foreign), comparison.summary).first()
    assert (row.changed, row.accepted, row.has_differences) == (before.changed - 5, 5, True)
    everything = summary.accepted_summary(keys, keys, comparison.summary).first()
    assert everything.accepted == 173 and not everything.has_differences
    nothing = keys.filter(F.lit(False))
    whole = summary.accepted_summary(keys, nothing, comparison.summary, ("DBO.Orders",)).first()
    assert whole.accepted == 173 and not whole.has_differences


def test_acceptance_without_a_key(spark):
    source = TableRef("t", spark.createDataFrame([("a",)] * 5 + [("b",)], "v string"))
    target = TableRef("t", spark.createDataFrame([("a",)] * 2 + [("c",)] * 4, "v string"))
    comparison = compare_tables(source, target)
    keys = comparison.difference_keys()
    three = keys.filter("row_count = 3")
    row = summary.accepted_summary(keys, three, comparison.summary).first()
    assert (row.missing_from_target, row.missing_from_source, row.accepted) == (1, 4, 3)
    with pytest.raises(ValueError):
        comparison.cells


def test_text_files_need_a_schema(spark):
    with pytest.raises(ValueError):
        read_files(spark, "/nowhere", "csv")
    with pytest.raises(ValueError):
        read_files(spark, "/nowhere", "xlsx")


def test_differences_and_summary_come_from_one_scan_of_each_side(spark):
    """The job that writes the differences also counts both sides; nothing reads the sides again."""
    from concord.demo import queries as demo
    from comparing import TESTDATA

    comparison = demo.orders(spark, str(TESTDATA / "sf0.001"))
    summary = comparison.summary_of_differences
    assert summary.collect() == comparison.summary.collect()
    for frame in (summary, comparison.differences):
        text = frame._jdf.queryExecution().executedPlan().toString()
        assert "orders.parquet" not in text and "Join" not in text and "Window" not in text
