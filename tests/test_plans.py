"""Shapes of physical plans that decide whether an operator holds at scale."""

from __future__ import annotations

import pytest

from concord import CompareOptions, KeyRange, TableRef, compare_tables
from concord.demo import queries as demo
from concord.demo.queries import QUERIES

from comparing import TESTDATA

FOLDER = str(TESTDATA / "sf0.001")


def plan_of(df):
    """The plan before adaptive execution changes it."""
    text = df._jdf.queryExecution().executedPlan().toString()
    return text.split("== Initial Plan ==")[-1]


def exchanges(text):
    return text.count("Exchange hashpartitioning")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_cross_join_and_no_python(spark, name):
    text = plan_of(QUERIES[name](spark, FOLDER))
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "MapInPandas"):
        assert operator not in text


def test_keyed_diff_shuffles_each_side_once(spark):
    text = plan_of(demo.orders(spark, FOLDER).rows)
    assert exchanges(text) == 2 and text.count("SortMergeJoin") == 1


def test_numbered_rows_are_not_shuffled_again_for_the_join(spark):
    options = CompareOptions(match_key=("l_orderkey", "l_linenumber"), exclude_by_type=False)
    assert exchanges(plan_of(demo.lineitem(spark, FOLDER, options).rows)) == 2


def test_multiset_diff_needs_one_shuffle_and_no_join(spark):
    text = plan_of(QUERIES["multiset_diff_rows"](spark, FOLDER))
    assert exchanges(text) == 1 and "Join" not in text


def test_key_range_reaches_both_scans(spark):
    df = spark.read.parquet(f"{FOLDER}/orders.parquet")
    table = TableRef("orders", df, ("o_orderkey",))
    text = plan_of(compare_tables(table, table, CompareOptions(key_unique=True, key_range=KeyRange(100, 200))).rows)
    assert text.count("GreaterThan(o_orderkey,100), LessThanOrEqual(o_orderkey,200)") == 2


def test_only_needed_columns_are_read(spark):
    df = spark.read.parquet(f"{FOLDER}/orders.parquet")
    table = TableRef("orders", df, ("o_orderkey",))
    options = CompareOptions(key_unique=True, exclude_columns=("o_orderpriority", "o_orderstatus", "o_totalprice"))
    text = plan_of(compare_tables(table, table, options).rows)
    assert text.count("ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint>") == 2


def test_large_column_is_hashed_below_the_shuffle(spark):
    text = plan_of(QUERIES["keyed_diff_large_text"](spark, FOLDER))
    below = text[text.index("Exchange hashpartitioning") :]
    assert "sha2" in below and "sha2" not in text[: text.index("Exchange hashpartitioning")]


def test_digest_is_all_that_is_shuffled_besides_the_key(spark):
    text = plan_of(QUERIES["table_summary_by_digest"](spark, FOLDER))
    join = text[text.index("SortMergeJoin") :]
    scans = [line for line in join.splitlines() if "sk0" in line and "Project" in line]
    assert scans and all("sha2" in line for line in scans)


def test_lines_are_shuffled_once(spark):
    text = plan_of(QUERIES["text_line_diff"](spark, FOLDER))
    assert text.count("REPARTITION_BY_COL") == 1
    assert exchanges(text) - 1 <= 2


def test_no_window_over_a_whole_table(spark):
    for name in ("range_boundaries", "key_ranges", "diff_by_range", "capped_examples", "hash_samples", "keyed_diff_dup_keys"):
        text = plan_of(QUERIES[name](spark, FOLDER))
        for line in text.splitlines():
            if "Window [" in line:
                assert not line.rstrip().endswith("], []")
                assert ", [], [" not in line


def test_examples_are_limited_before_the_shuffle(spark):
    text = plan_of(QUERIES["capped_examples"](spark, FOLDER))
    assert text.count("WindowGroupLimit") >= 2


def test_bucketed_tables_join_without_shuffle(spark):
    df = spark.read.parquet(f"{FOLDER}/orders.parquet")
    for name in ("bucketed_a", "bucketed_b"):
        df.write.mode("overwrite").bucketBy(4, "o_orderkey").sortBy("o_orderkey").saveAsTable(name)
    source, target = (TableRef("orders", spark.table(name), ("o_orderkey",)) for name in ("bucketed_a", "bucketed_b"))
    options = CompareOptions(key_unique=True, key_not_null=True)
    comparison = compare_tables(source, target, options)
    assert exchanges(plan_of(comparison.rows)) == 0
    assert comparison.summary.first().matched == 1500


def test_rows_of_one_side_take_more_tasks_for_more_rows(spark, monkeypatch):
    """The sort of a task held a share of the table that grew with it."""
    before = sorted(QUERIES["only_in_target"](spark, FOLDER).collect())
    monkeypatch.setattr("concord.operators.keyed.ROWS_PER_TASK", 30)
    found = QUERIES["only_in_target"](spark, FOLDER)
    assert sorted(found.collect()) == before
    # 1,500 rows and 1,486 of the target.
    text = plan_of(found)
    assert "SortMergeJoin" in text and exchanges(text) == text.count(", 100), ") > 0
