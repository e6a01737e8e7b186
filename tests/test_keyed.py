"""Keyed comparison on small tables with known results."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

import pytest

from concord import CompareOptions, KeyRange, TableRef, compare_tables
from concord.operators.keyed import differing, one_sided
from concord.operators.reassign import orphan_tallies
from concord.plans import COERCE

ALL = CompareOptions(exclude_by_type=False)


def table(spark, rows, schema, keys=("Id",), name="t"):
    return TableRef(name, spark.createDataFrame(rows, schema), keys)


def compare(spark, source, target, schema, options=ALL, keys=("Id",), **kwargs):
    return compare_tables(table(spark, source, schema, keys), table(spark, target, schema, keys), options, **kwargs)


def counts(comparison):
    row = comparison.summary.first()
    return (row.matched, row.changed, row.missing_from_target, row.missing_from_source, row.reassigned)


def categories(rows):
    return sorted((row.category, row.source_key, row.target_key) for row in rows.collect())


PARCELS = "Id int, Depot string, Weight decimal(8,3), Fragile boolean"
SOURCE = [
    (11, "Oslo", Decimal("0.250"), True),
    (12, "Bergen", Decimal("7.125"), False),
    (13, "Tromsø", None, False),
    (14, "Bodø", Decimal("3.000"), None),
    (15, "Molde", Decimal("1.500"), True),
]
TARGET = [
    (11, "Oslo", Decimal("0.250"), True),
    (12, "Bergen", Decimal("7.126"), False),
    (13, "Tromsø", None, False),
    (14, "Narvik", Decimal("3.000"), False),
    (21, "Hamar", Decimal("2.750"), False),
    (22, "Voss", Decimal("9.000"), True),
]


def test_parcels(spark):
    comparison = compare(spark, SOURCE, TARGET, PARCELS)
    summary = comparison.summary.first()
    assert (summary.source_rows, summary.target_rows) == (5, 6)
    assert counts(comparison) == (2, 2, 1, 2, 0)
    changed = {row.source_key.Id: row for row in comparison.rows.filter("category = 'changed'").collect()}
    assert {i: row.changed_columns for i, row in changed.items()} == {12: ["Weight"], 14: ["Depot", "Fragile"]}
    assert (changed[12].source.Weight, changed[12].target.Weight) == (Decimal("7.125"), Decimal("7.126"))
    assert [row.Id for row in one_sided(comparison.plan, "only_in_source").collect()] == [15]
    assert sorted(row.Id for row in one_sided(comparison.plan, "only_in_target").collect()) == [21, 22]


def test_table_against_itself(spark):
    comparison = compare(spark, SOURCE, SOURCE, PARCELS)
    assert counts(comparison) == (5, 0, 0, 0, 0)
    assert not comparison.summary.first().has_differences
    assert comparison.differences.count() == 0


def test_binary_and_large_text_travel_as_hash(spark):
    kind = "Id int, Image binary"
    before = [(i, bytearray([i, 0, 255 - i])) for i in range(4)]
    after = [(i, bytearray([i, i % 2, 255 - i])) for i in range(4)]
    blob = compare(spark, before, after, kind)
    assert counts(blob) == (2, 2, 0, 0, 0)
    assert all(len(row.source.Image) == 64 for row in blob.rows.filter("category = 'changed'").collect())
    options = CompareOptions(large_columns=("letter",))
    before = [(i, f"Dear customer {i}, " + "thank you. " * 40) for i in range(3)]
    after = [(i, text if i != 1 else text + "Yours") for i, text in before]
    letters = compare(spark, before, after, "Id int, Letter string", options)
    assert counts(letters) == (2, 1, 0, 0, 0)
    assert "customer" not in str(letters.rows.collect())
    cells = {row.column_name: row for row in letters.cells.collect()}
    assert cells["Letter"].source_value == "(large column — content differs)"
    assert cells["Id"].cell_kind == "Matched" and cells["Letter"].cell_kind == "RealDifference"


def test_reassigned_row(spark):
    schema = "Id int, Depot string, Shelf int"
    source = [(3, "Oslo", 40), (5, "Voss", 41), (8, "Molde", 42)]
    target = [(3, "Oslo", 40), (30, "Molde", 42), (50, "Voss", 44)]
    comparison = compare(spark, source, target, schema)
    assert sorted(row.category for row in comparison.rows.collect()) == ["matched"] + ["only_in_source"] * 2 + ["only_in_target"] * 2
    assert counts(comparison) == (1, 0, 1, 1, 1)
    moved = comparison.differences.filter("category = 'reassigned'").first()
    assert (moved.source_key.Id, moved.target_key.Id, moved.source.Depot) == (8, 30, "Molde")
    kinds = {row.column_name: row.cell_kind for row in comparison.cells.filter("category = 'reassigned'").collect()}
    assert kinds == {"Id": "ExpectedDifference", "Depot": "Matched", "Shelf": "Matched"}


def test_moved_and_edited_row_stays_two_orphans(spark):
    comparison = compare(spark, [(1, "a")], [(6, "b")], "Id int, Text string")
    assert counts(comparison) == (0, 0, 1, 1, 0)


@pytest.mark.parametrize("hot_rows", [1_000_000, 1])
def test_equal_contents_pair_by_count_in_key_order(spark, hot_rows):
    source = [(1, "Same"), (2, "Same")]
    target = [(10, "Same"), (11, "Same"), (12, "Same")]
    comparison = compare(spark, source, target, "Id int, Text string", hot_rows=hot_rows)
    assert counts(comparison) == (0, 0, 0, 1, 2)
    assert [(row.category, row.source_key and row.source_key.Id, row.target_key.Id) for row in comparison.differences.orderBy("target_key").collect()] == [
        ("reassigned", 1, 10),
        ("reassigned", 2, 11),
        ("only_in_target", None, 12),
    ]


def test_keys_only_table_pairs_all_orphans(spark):
    comparison = compare(spark, [(1,), (2,)], [(2,), (3,)], "Id int")
    assert counts(comparison) == (1, 0, 0, 0, 1)
    assert comparison.summary.first().keys_only


def test_null_equality_and_floats(spark):
    nan = float("nan")
    source = [(1, None, nan), (2, None, 0.0), (3, "", 1.0)]
    target = [(1, None, nan), (2, "x", -0.0), (3, None, 1.0)]
    rows = compare(spark, source, target, "Id int, a string, b double").rows.orderBy("source_key").collect()
    assert [(row.category, row.changed_columns) for row in rows] == [
        ("matched", []),
        ("changed", ["a"]),
        ("changed", ["a"]),
    ]


def test_null_key_matches_null_only(spark):
    comparison = compare(spark, [(None, "x"), (1, "y")], [(None, "x"), (2, "z")], "Id int, a string")
    assert counts(comparison) == (1, 0, 1, 1, 0)
    empty_text = compare(spark, [(None, "x")], [("", "x")], "Id string, a string")
    assert counts(empty_text) == (0, 0, 0, 0, 1)


def test_type_policies(spark):
    def drifted(policy):
        source = table(spark, [(1, 5, None), (2, 7, 1)], "Id int, v int, w int")
        target = table(spark, [(1, 5, None), (2, 7, 1)], "Id int, v bigint, w string")
        return compare_tables(source, target, CompareOptions(type_policy=policy))

    assert counts(drifted("strict")) == (0, 2, 0, 0, 0)
    assert drifted("strict").rows.orderBy("source_key").first().changed_columns == ["v"]
    assert counts(drifted(COERCE)) == (2, 0, 0, 0, 0)
    with pytest.raises(ValueError):
        CompareOptions(type_policy="loose")


def test_decimals_compare_by_value_and_key_types_as_text(spark):
    source = table(spark, [(1, Decimal("1.50"))], "Id int, a decimal(10,2)")
    target = table(spark, [("1", Decimal("1.5000"))], "Id string, a decimal(12,4)")
    assert counts(compare_tables(source, target, ALL)) == (1, 0, 0, 0, 0)


def test_names_ignore_case_and_odd_names_work(spark):
    source = TableRef("T", spark.createDataFrame([(1, "a", 1)], "ID int, `odd.name it's` string, gone int"), ("ID",))
    target = TableRef("t", spark.createDataFrame([(1, "b", 2)], "id int, `ODD.NAME IT'S` string, new int"), ("id",))
    comparison = compare_tables(source, target, ALL)
    changed = comparison.rows.first()
    assert changed.changed_columns == ["odd.name it's"]
    assert counts(comparison) == (0, 1, 0, 0, 0)
    assert comparison.cells.count() == 2


def test_key_lists_have_to_agree(spark):
    schema = "a int, b int, v int"
    keyed = compare_tables(table(spark, [(1, 2, 3)], schema, ("a", "b")), table(spark, [(1, 2, 3)], schema, ("B", "A")))
    assert not keyed.plan.usable_key and keyed.summary.first().comparison == "multiset"


def test_no_common_column_is_a_zero_row(spark):
    source, target = table(spark, [(1,)], "a int", ()), table(spark, [(1,)], "b int", ())
    summary = compare_tables(source, target).summary.first()
    assert (summary.source_rows, summary.target_rows, summary.has_differences) == (0, 0, False)


def test_exclusions(spark):
    moment = dt.datetime(2024, 1, 1)
    schema = "Id int, noise string, at timestamp, row_id string, v int"
    source = [(1, "a", moment, "u1", 1)]
    target = [(1, "b", moment + dt.timedelta(days=1), "u2", 1)]
    by_type = compare(spark, source, target, schema, CompareOptions(uuid_columns=("row_id",)))
    assert by_type.rows.first().changed_columns == ["noise"]
    named = compare(spark, source, target, schema, CompareOptions(uuid_columns=("ROW_ID",), exclude_columns=("Noise",)))
    assert counts(named) == (1, 0, 0, 0, 0)
    everything = compare(spark, source, target, schema, ALL)
    assert everything.rows.first().changed_columns == ["noise", "at", "row_id"]


def test_temporal_key_is_never_excluded(spark):
    schema = "at timestamp, v int"
    rows = [(dt.datetime(2024, 1, 1), 1)]
    comparison = compare(spark, rows, rows, schema, CompareOptions(), keys=("at",))
    assert [pair.name for pair in comparison.plan.keys] == ["at"] and counts(comparison) == (1, 0, 0, 0, 0)


def test_match_key_aligns_drifted_invoices(spark):
    schema = "InvoiceNumber int, ClientId int, Period string, Amount int"
    source = [(100, 1, "Jan", 10), (101, 2, "Jan", 20), (102, 3, "Jan", 30)]
    target = [(102, 1, "Jan", 10), (103, 2, "Jan", 20), (104, 3, "Jan", 31)]
    keys = ("InvoiceNumber",)
    declared = compare(spark, source, target, schema, ALL, keys)
    assert counts(declared)[1] == 1  # 102 pairs with the wrong invoice
    matched = compare(spark, source, target, schema, CompareOptions(match_key=("ClientId", "Period")), keys)
    assert counts(matched) == (2, 1, 0, 0, 0)
    with_number = CompareOptions(match_key=("ClientId", "Period"), declared_key_as_value=True)
    assert counts(compare(spark, source, target, schema, with_number, keys)) == (0, 3, 0, 0, 0)
    with pytest.raises(ValueError):
        compare(spark, source, target, schema, CompareOptions(match_key=("Nothing",)), keys)


@pytest.mark.parametrize("hot_rows", [1_000_000, 2])
def test_repeated_keys_pair_by_position(spark, hot_rows):
    source = [(1, "a"), (1, "b"), (1, "b"), (1, "c"), (2, "x"), (None, "n"), (None, "n")]
    target = [(1, "a"), (1, "b"), (1, "d"), (2, "x"), (2, "y"), (None, "n"), (None, "n"), (None, "o")]
    comparison = compare(spark, source, target, "Id int, v string", hot_rows=hot_rows)
    pairs = sorted(
        (row.category, row.source and row.source.v, row.target and row.target.v) for row in comparison.rows.collect()
    )
    assert pairs == sorted(
        [
            ("matched", "a", "a"),
            ("matched", "b", "b"),
            ("changed", "b", "d"),
            ("only_in_source", "c", None),
            ("matched", "x", "x"),
            ("only_in_target", None, "y"),
            ("matched", "n", "n"),
            ("matched", "n", "n"),
            ("only_in_target", None, "o"),
        ]
    )


def test_key_range_and_null_key(spark):
    rows = [(None, 0), (1, 1), (2, 2), (3, 3), (4, 4)]

    def keys(lower, upper):
        options = CompareOptions(key_range=KeyRange(lower, upper))
        return sorted(str(row.source_key.Id) for row in compare(spark, rows, rows, "Id int, v int", options).rows.collect())

    assert keys(1, 3) == ["2", "3"]
    assert keys(None, 1) == ["1", "None"]
    assert keys(3, None) == ["4"]


def test_maps_arrays_and_structs_compare_by_value(spark):
    schema = "Id int, m map<string,int>, a array<double>, s struct<x:int,y:string>"
    source = [(1, {"a": 1, "b": 2}, [1.0, 2.0], (1, "q")), (2, {"a": 1}, [1.0], (1, None))]
    target = [(1, {"b": 2, "a": 1}, [1.0, 2.0], (1, "q")), (9, {"a": 1}, [1.0], (1, None))]
    comparison = compare(spark, source, target, schema)
    assert counts(comparison) == (1, 0, 0, 0, 1)


def test_content_hash_keeps_separators_and_nulls_apart(spark):
    schema = "Id int, a string, b string"
    source = [(1, "a|b", "c"), (2, "x\x1f", "y"), (3, None, "n"), (4, "\\N", "m"), (5, "\\s", "z")]
    target = [(11, "a", "b|c"), (12, "x", "\x1fy"), (13, "n", None), (14, None, "m"), (15, "\x1f", "z")]
    comparison = compare(spark, source, target, schema)
    assert counts(comparison) == (0, 0, 5, 5, 0)
    assert orphan_tallies(comparison.rows, comparison.plan).count() == 10


def test_timestamps_keep_full_precision(spark):
    schema = "Id int, at timestamp_ntz"
    first, second = dt.datetime(2024, 1, 1, 10, 0, 0, 1), dt.datetime(2024, 1, 1, 10, 0, 0, 2)
    comparison = compare(spark, [(1, first)], [(2, second)], schema)
    assert counts(comparison) == (0, 0, 1, 1, 0)
    assert counts(compare(spark, [(1, first)], [(2, first)], schema)) == (0, 0, 0, 0, 1)


def test_differing_leaves_matched_rows_out(spark):
    comparison = compare(spark, SOURCE, TARGET, PARCELS)
    assert differing(comparison.rows).count() == 5


def test_time_of_day_is_excluded_by_default(spark):
    source, target = (
        TableRef("t", spark.sql(f"SELECT 1 AS Id, TIME '{text}' AS at, 5 AS v"), ("Id",)) for text in ("10:00:00", "11:00:00")
    )
    assert counts(compare_tables(source, target)) == (1, 0, 0, 0, 0)
    assert counts(compare_tables(source, target, ALL)) == (0, 1, 0, 0, 0)


def test_summary_by_digest_counts_the_same(spark):
    def both(source, target, schema, keys=("Id",)):
        found = []
        for digest in (False, True):
            options = CompareOptions(exclude_by_type=False, key_unique=bool(keys), summary_by_digest=digest)
            found.append(compare(spark, source, target, schema, options, keys).summary.first())
        assert found[0] == found[1]
        return found[1]

    nan = float("nan")
    schema = "Id int, a string, b double, c binary"
    source = [(1, None, nan, None), (2, "x", 0.0, bytearray(b"q")), (3, "m", 1.0, None), (4, "k", 2.0, None)]
    target = [(1, None, nan, None), (2, "x", -0.0, bytearray(b"q")), (9, "m", 1.0, None), (4, None, 2.0, None)]
    row = both(source, target, schema)
    assert (row.matched, row.changed, row.reassigned) == (2, 1, 1)
    assert both(source, target, schema, ()).comparison == "multiset"


def test_digest_is_left_out_where_it_would_count_otherwise(spark):
    source = table(spark, [(1, 5)], "Id int, v int")
    target = table(spark, [(1, 5)], "Id int, v bigint")
    options = CompareOptions(key_unique=True, summary_by_digest=True)
    assert counts(compare_tables(source, target, options)) == (0, 1, 0, 0, 0)
    repeated = [(1, "b"), (1, "a")]
    unsure = CompareOptions(summary_by_digest=True)
    assert counts(compare(spark, repeated, repeated[:1], "Id int, v string", unsure)) == (0, 1, 1, 0, 0)
