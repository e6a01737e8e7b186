from __future__ import annotations

import datetime as dt

import pytest
from comparing import TESTDATA

from concord import CompareOptions, TableRef, compare_tables
from concord.operators.digest import Bucketing, DigestComparison, _runs
from concord.operators.keyed import differing
from concord.operators.summary import part_counts

FOLDER = str(TESTDATA / "sf0.001")


def pair(spark, schema, source, target, keys=("k",), **options):
    left, right = (spark.createDataFrame(rows, schema) for rows in (source, target))
    return compare_tables(TableRef("t", left, keys), TableRef("t", right, keys), CompareOptions(**options))


def rows(df):
    return sorted(map(str, df.collect()))


def assert_as_whole(comparison, buckets):
    digest = DigestComparison(comparison.plan, buckets)
    assert rows(digest.differences) == rows(differing(comparison.rows))
    assert digest.counts.collect() == part_counts(comparison.rows).collect()
    return digest


KEYS = {
    "long": [None, -(2**63), -5, 0, 0, 1, 7, 2**63 - 1],
    "int": [None, -3, -3, 0, 4, 5],
    "date": [None, dt.date(1, 1, 1), dt.date(1970, 1, 1), dt.date(2024, 2, 29), dt.date(9999, 12, 31)],
    "string": [None, "", "a", "a", "ä", "b"],
    "double": [None, float("nan"), -0.0, 1.5],
    "decimal(20,2)": [None, 0, 5],
}


@pytest.mark.parametrize("kind", KEYS)
@pytest.mark.parametrize("buckets", [1, 3, 64])
def test_same_as_comparison_of_all_rows(spark, kind, buckets):
    from decimal import Decimal

    keys = [Decimal(k) if kind.startswith("decimal") and k is not None else k for k in KEYS[kind]]
    source = [(k, i % 3 or None, "x") for i, k in enumerate(keys)]
    target = [(k, i % 3 or None, "y" if i == 2 else "x") for i, k in enumerate(keys) if i != 1]
    digest = assert_as_whole(pair(spark, f"k {kind}, a int, b string", source, target), buckets)
    assert not digest.equal
    assert assert_as_whole(pair(spark, f"k {kind}, a int, b string", source, source[::-1]), buckets).equal


def test_null_and_neighbouring_columns_are_told_apart(spark):
    schema = "k int, a string, b string"
    for left, right in (((1, None, "x"), (1, "x", None)), ((1, "ab", "c"), (1, "a", "bc")), ((1, None, None), (1, "", ""))):
        assert not assert_as_whole(pair(spark, schema, [left], [right]), 4).equal


def test_rows_that_repeat_count(spark):
    schema = "k int, v string"
    twice = pair(spark, schema, [(1, "a"), (1, "a"), (2, "b")], [(1, "a"), (2, "b"), (2, "b")])
    assert not assert_as_whole(twice, 8).equal
    swapped = pair(spark, schema, [(1, "a"), (1, "b")], [(1, "b"), (1, "a")])
    assert assert_as_whole(swapped, 8).equal


def test_empty_sides(spark):
    assert assert_as_whole(pair(spark, "k int, v int", [], []), 4).equal
    assert not assert_as_whole(pair(spark, "k int, v int", [], [(1, 2)]), 4).equal


def test_types_that_differ_are_never_equal(spark):
    left = TableRef("t", spark.createDataFrame([(1, 5)], "k int, v int"), ("k",))
    right = TableRef("t", spark.createDataFrame([(1, 5)], "k int, v long"), ("k",))
    for policy in ("strict", "coerce"):
        assert_as_whole(compare_tables(left, right, CompareOptions(type_policy=policy)), 4)


def test_only_rows_of_differing_buckets_are_shuffled(spark):
    source = spark.read.parquet(f"{FOLDER}/orders.parquet")
    target = source.selectExpr("*").where("o_orderkey <> 801")
    options = CompareOptions(key_unique=True, key_not_null=True, exclude_by_type=False)
    tables = [TableRef("orders", df, ("o_orderkey",)) for df in (source, target)]
    digest = DigestComparison(compare_tables(*tables, options).plan, 100)
    narrow = digest.narrowed
    assert 0 < narrow.source.df.count() <= source.count() / 50
    text = digest.differences._jdf.queryExecution().executedPlan().toString()
    assert text.count("GreaterThanOrEqual(o_orderkey,") >= 2 and "Python" not in text
    assert [r["source_key"]["o_orderkey"] for r in digest.differences.collect()] == [801]
    same = DigestComparison(compare_tables(tables[0], tables[0], options).plan, 100)
    assert same.equal
    plan = same.differences._jdf.queryExecution().optimizedPlan().toString()
    assert plan.startswith("LocalRelation <empty>")


def test_digests_shuffle_sums_alone(spark):
    source = spark.read.parquet(f"{FOLDER}/orders.parquet")
    table = TableRef("orders", source, ("o_orderkey",))
    digest = DigestComparison(compare_tables(table, table, CompareOptions(key_unique=True)).plan, 16)
    text = digest.digests._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert text.count("Exchange") == 1 and "Join" not in text and text.count("partial_sum") >= 1


def test_bounds_and_runs():
    by = Bucketing(4, -10, 5)
    assert by.bounds(0, 0) == (-10, -6) and by.bounds(2, 3) == (0, 9)
    assert _runs([0, 1, 2, 5, 7, 8]) == [(0, 2), (5, 5), (7, 8)] and _runs([]) == []
