from __future__ import annotations

import datetime as dt
from decimal import Decimal

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from concord import CompareOptions, KeyRange, TableRef, compare_tables
from concord.operators import ranges, summary
from concord.sources.readers import range_predicates


def boundaries_by_sorting(values, chunks):
    ordered = sorted(value for value in values if value is not None)
    return list(dict.fromkeys(ordered[i] for i in ranges.boundary_offsets(len(ordered), chunks)))


def test_ranges_from_boundaries():
    assert ranges.key_ranges([]) == [KeyRange(None, None)]
    found = [(r.lower, r.upper) for r in ranges.key_ranges([-7, 12, 55])]
    assert found == [(None, -7), (-7, 12), (12, 55), (55, None)]
    assert ranges.boundary_offsets(100, 1) == [] and ranges.boundary_offsets(1, 5) == []
    assert ranges.boundary_offsets(10, 3) == [4, 8]
    assert ranges.boundary_offsets(10, 5000) == list(range(1, 10))


def test_labels():
    # The form of a label is a fixed value.
    label = ranges.range_label
    assert label(1, 1, "parcel", KeyRange()) == "Chunk 1 of 1 (all rows)"
    assert label(1, 3, "parcel", KeyRange(None, 4321)) == "Chunk 1 of 3 (parcel ≤ 4,321)"
    assert label(2, 3, "parcel", KeyRange(4321, 7654321)) == "Chunk 2 of 3 (parcel 4,321 – 7,654,321)"
    assert label(3, 3, "parcel", KeyRange(7654321, None)) == "Chunk 3 of 3 (parcel > 7,654,321)"


@pytest.mark.parametrize(
    "values",
    [
        [5, 5, 5, 5, 1, 2, None, None],
        [-(2**63), 2**63 - 1, 0, 7, 7, 7, -3],
        [2**62, -(2**62), 2**62 + 1, 5],
        list(range(0, 100_000, 37)),
        [3],
        [],
    ],
)
@pytest.mark.parametrize("chunks", [2, 5])
def test_exact_boundaries_of_long_keys(spark, values, chunks):
    df = spark.createDataFrame([(value,) for value in values], "k long")
    assert ranges.range_boundaries(df, "k", chunks) == boundaries_by_sorting(values, chunks)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(-(10**12), 10**12), min_size=2, max_size=60), st.integers(2, 7))
def test_boundaries_of_any_keys(spark, values, chunks):
    df = spark.createDataFrame([(value,) for value in values], "k long")
    assert ranges.range_boundaries(df, "k", chunks) == boundaries_by_sorting(values, chunks)


def test_boundaries_of_dates_and_text(spark):
    days = [dt.date(2024, 1, 1) + dt.timedelta(days=i * i % 97) for i in range(60)]
    df = spark.createDataFrame([(day, f"k{day.toordinal() % 53:03d}") for day in days], "d date, t string")
    assert ranges.range_boundaries(df, "d", 4) == boundaries_by_sorting(days, 4)
    texts = [row.t for row in df.collect()]
    assert ranges.range_boundaries(df, "t", 4) == boundaries_by_sorting(texts, 4)


def parcels(spark):
    """240 keys: every seventh weighs more in Target, keys from 200 to 210 are missing there and three are new."""
    schema = "Id int, Weight decimal(8,3)"
    source = [(i, Decimal(i)) for i in range(240)]
    target = [(i, Decimal(i + 1) if i % 7 == 0 else Decimal(i)) for i in range(240) if not 200 <= i <= 210]
    target += [(i, Decimal(-1)) for i in (300, 301, 302)]
    return (
        TableRef("p", spark.createDataFrame(source, schema), ("Id",)),
        TableRef("p", spark.createDataFrame(target, schema), ("Id",)),
    )


def test_parts_add_up_to_the_whole(spark):
    source, target = parcels(spark)
    changed = sum(i % 7 == 0 and not 200 <= i <= 210 for i in range(240))
    whole = compare_tables(source, target)
    boundaries = ranges.range_boundaries(source.df, "Id", 6)
    assert boundaries == boundaries_by_sorting(range(240), 6)
    parts = ranges.diff_by_range(whole.rows, whole.plan, boundaries).collect()
    assert len(parts) == 6
    total = [sum(part[name] for part in parts) for name in ("only_in_source", "changed", "matched", "only_in_target")]
    assert total == [11, changed, 229 - changed, 3]
    # The same through separate comparisons of each range, filtered at the scan.
    singles = [
        compare_tables(source, target, CompareOptions(key_range=key_range)).summary.first()
        for key_range in ranges.key_ranges(boundaries)
    ]
    assert sum(row.missing_from_target for row in singles) == 11 and sum(row.missing_from_source for row in singles) == 3
    assert sum(row.changed for row in singles) == changed and sum(row.matched for row in singles) == 229 - changed


def test_thousands_of_ranges(spark):
    """Boundaries and buckets of very many ranges, with few counts in the driver at once."""
    df = spark.range(20_000).selectExpr("id * 1000003 % 20011 AS k")
    boundaries = ranges.range_boundaries(df, "k", 3000)
    assert boundaries == boundaries_by_sorting([row.k for row in df.collect()], 3000)
    found = df.select("k", ranges.bucket_of(F.col("k"), boundaries).alias("b")).groupBy("b").count().collect()
    assert len(found) >= len(boundaries) and sum(row["count"] for row in found) == 20_000
    assert max(row["count"] for row in found) <= 8


def test_bucket_of_every_place(spark):
    df = spark.createDataFrame([(k,) for k in (None, -5, 3, 4, 10, 11, 99)], "k int")
    found = [row.b for row in df.select(ranges.bucket_of(F.col("k"), [3, 10, 11]).alias("b")).collect()]
    assert found == [1, 1, 1, 2, 2, 3, 4]
    assert {row.b for row in df.select(ranges.bucket_of(F.col("k"), []).alias("b")).collect()} == {1}


def test_combined_counts_reconcile_once(spark):
    columns = "table_name string, source_rows long, target_rows long, matched long, only_in_source long, only_in_target long, changed long"
    parts = spark.createDataFrame([("t", 100, 90, 80, 5, 2, 1), ("t", 200, 210, 195, 0, 3, 2)], columns)
    tallies = spark.createDataFrame(
        [("t", "a", 2, 0), ("t", "a", 0, 1), ("t", "b", 1, 0)],
        "table_name string, content_hash string, only_in_source long, only_in_target long",
    )
    row = summary.combine_parts(parts, tallies).first()
    assert (row.source_rows, row.target_rows, row.matched, row.changed) == (300, 300, 275, 3)
    assert (row.missing_from_target, row.missing_from_source, row.reassigned) == (4, 4, 1)


def test_predicates_for_partitioned_reads():
    found = range_predicates("k", ranges.key_ranges([10, 20]))
    assert found == ["(k <= 10 OR k IS NULL)", "k > 10 AND k <= 20", "k > 20"]
    assert range_predicates("k", ranges.key_ranges([])) == ["1 = 1"]
    assert range_predicates("k", ranges.key_ranges(["O'x"]))[1] == "k > 'O''x'"
