"""Multiset comparison and sampling on small tables."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

import pytest

from concord import CompareOptions, TableRef, compare_tables
from concord.operators import multiset
from concord.operators.expand import repeat_rows


def counted(**counts):
    return [(name,) for name, count in counts.items() for _ in range(count)]


def compare(spark, source, target, schema="h string", options=None):
    return compare_tables(
        TableRef("t", spark.createDataFrame(source, schema)), TableRef("t", spark.createDataFrame(target, schema)), options
    )


@pytest.mark.parametrize(
    "source,target,expected",
    [
        (dict(h1=3, h2=1), dict(h1=3, h2=1), (4, 4, 4, 0, 0)),
        (dict(h1=2), {}, (2, 0, 0, 2, 0)),
        ({}, dict(h1=5), (0, 5, 0, 0, 5)),
        (dict(h1=3), dict(h1=2), (3, 2, 2, 1, 0)),
        (dict(h1=3, h2=4), dict(h1=3), (7, 3, 3, 4, 0)),
    ],
)
def test_multiset_totals(spark, source, target, expected):
    comparison = compare(spark, counted(**source), counted(**target))
    row = comparison.summary.first()
    assert (row.source_rows, row.target_rows, row.matched, row.missing_from_target, row.missing_from_source) == expected
    assert row.has_differences == (expected[3] + expected[4] > 0)


def test_largest_difference_first(spark):
    comparison = compare(spark, counted(small=1, big=10), [])
    top = multiset.top_discrepancies(comparison.plan, 10).collect()
    assert [row.content.h for row in top] == ["big", "small"]
    assert [row.content.h for row in multiset.top_discrepancies(comparison.plan, 1).collect()] == ["big"]


SCHEMA = "Id int, Depot string, Seen timestamp, Weight decimal(8,3)"
PARCELS = [
    (31, "Voss", dt.datetime(2022, 7, 9, 6, 30), Decimal("4.125")),
    (32, None, None, Decimal("0.500")),
    (33, "Voss", dt.datetime(2022, 7, 9, 6, 30), Decimal("4.125")),
    (34, "Voss", dt.datetime(2022, 7, 9, 6, 30), Decimal("4.125")),
    (35, None, None, Decimal("0.500")),
    (36, "Hamar", None, None),
]


def test_hash_counts_and_samples(spark):
    df = spark.createDataFrame(PARCELS, SCHEMA)
    assert sorted(row.occurrences for row in multiset.hash_counts(df, ["Depot", "Seen", "Weight"]).collect()) == [1, 2, 3]
    options = CompareOptions(exclude_by_type=False, exclude_columns=("Id",))
    plan = compare(spark, PARCELS, [PARCELS[1], PARCELS[4], PARCELS[5]], SCHEMA, options).plan
    samples = multiset.sample_rows(plan, multiset.discrepancies(plan)).collect()
    assert [(row.row.Id, row.row.Depot, row.sampled_side) for row in samples] == [(i, "Voss", "source") for i in (31, 33, 34)]


def test_samples_are_limited(spark):
    plan = compare(spark, counted(x=9), counted(y=9)).plan
    samples = multiset.sample_rows(plan, multiset.discrepancies(plan)).collect()
    assert sorted((row.row.h, row.sample_no) for row in samples) == [(name, n) for name in "xy" for n in (1, 2, 3)]


@pytest.mark.parametrize("chunk_rows", [100_000, 2])
def test_surplus_and_common_rows(spark, chunk_rows):
    plan = compare(spark, counted(a=7, b=2, c=1), counted(a=2, b=5, d=1)).plan
    surplus = multiset.surplus_rows(plan, True, chunk_rows).collect()
    assert sorted(row.h for row in surplus) == ["a"] * 5 + ["c"]
    assert sorted(row.h for row in multiset.surplus_rows(plan, False, chunk_rows).collect()) == ["b"] * 3 + ["d"]
    assert sorted(row.h for row in multiset.common_rows(plan, chunk_rows).collect()) == ["a"] * 2 + ["b"] * 2


def test_repeat_rows_numbers_copies(spark):
    df = spark.createDataFrame([("a", 7), ("b", 0), ("c", 3)], "v string, n long")
    copies = sorted((row.v, row.i) for row in repeat_rows(df, "n", "i", 3).collect())
    assert copies == [("a", i) for i in range(1, 8)] + [("c", i) for i in range(1, 4)]


def test_contents_of_other_type_match_as_text(spark):
    source = TableRef("t", spark.createDataFrame([(1, "x")], "a int, b string"))
    target = TableRef("t", spark.createDataFrame([(1, "x")], "a bigint, b string"))
    assert compare_tables(source, target).summary.first().matched == 1
