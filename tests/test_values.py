"""Nested and precise values: equal values have equal hashes, other values other hashes, whatever holds them."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

import pytest

from concord import CompareOptions, TableRef, compare_tables
from concord.functions.canonical import content_hash
from concord.operators.keyed import ONLY_IN_SOURCE, ONLY_IN_TARGET, one_sided
from concord.operators.multiset import discrepancies, sample_rows
from concord.sources.sinks import discrepancy_rows

T0 = dt.datetime(2023, 5, 6, 7, 8, 9, 100)
T1 = dt.datetime(2023, 5, 6, 7, 8, 9, 101)
ALL = CompareOptions(exclude_by_type=False)

PAIRS = [
    ("timestamp", T0, T1),
    ("timestamp_ntz", T0, T1),
    ("struct<t: timestamp>", (T0,), (T1,)),
    ("array<timestamp_ntz>", [T0], [T1]),
    ("map<string, timestamp>", {"k": T0}, {"k": T1}),
    ("array<string>", ["a", "b"], ["a,b"]),
    ("array<string>", ["a", None], ["a", "null"]),
    ("array<string>", ['x","y'], ["x", "y"]),
    ("struct<a: string, b: string>", ("1", None), (None, "1")),
    ("map<string, array<int>>", {"p": [1], "q": []}, {"p": [], "q": [1]}),
    ("array<map<string, int>>", [{"p": 1}, {"q": 2}], [{"q": 2}, {"p": 1}]),
    ("struct<m: map<int, struct<x: decimal(4,2)>>>", ({1: (Decimal("1.50"),)},), ({1: (Decimal("1.05"),)},)),
    ("array<binary>", [b"\x01"], [b"\x10"]),
]


def hashes(spark, kind, *values):
    df = spark.createDataFrame([(v,) for v in values], f"v {kind}")
    return [r.h for r in df.selectExpr(f"{content_hash([('v', df.schema['v'].dataType)])} AS h").collect()]


@pytest.mark.parametrize("kind, one, other", PAIRS)
def test_different_values_differ_everywhere(spark, kind, one, other):
    assert len(set(hashes(spark, kind, one, one, other))) == 2
    side = lambda v: TableRef("t", spark.createDataFrame([(1, v)], f"k int, v {kind}"), keys=("k",))
    for by_digest in (False, True):
        options = CompareOptions(exclude_by_type=False, key_unique=True, summary_by_digest=by_digest)
        assert compare_tables(side(one), side(other), options).summary.first().changed == 1
        assert compare_tables(side(one), side(one), options).summary.first().matched == 1
    row = discrepancy_rows(compare_tables(side(one), side(other), ALL)).first()
    assert row.source != row.target


@pytest.mark.parametrize(
    "kind, one, other",
    [
        ("array<double>", [0.0], [-0.0]),
        ("struct<x: float, y: array<double>>", (0.0, [float("nan"), -0.0]), (-0.0, [float("nan"), 0.0])),
        ("map<string, int>", {"a": 1, "b": 2}, {"b": 2, "a": 1}),
        ("array<map<string, int>>", [{"a": 1, "b": 2}], [{"b": 2, "a": 1}]),
    ],
)
def test_equal_values_hash_alike(spark, kind, one, other):
    assert len(set(hashes(spark, kind, one, other))) == 1


def test_decimals_hash_by_value(spark):
    values = {"decimal(2,1)": "1.5", "decimal(5,2)": "1.50", "decimal(9,4)": "1.5000"}
    assert len({hashes(spark, kind, Decimal(v))[0] for kind, v in values.items()}) == 1
    assert hashes(spark, "decimal(5,2)", Decimal("100.00")) != hashes(spark, "decimal(5,2)", Decimal("10.00"))
    assert hashes(spark, "decimal(9,8)", Decimal("0.00000001")) != hashes(spark, "decimal(9,8)", Decimal("0.00000000"))


def test_moved_row_with_another_decimal_scale(spark):
    side = lambda k, v, kind: TableRef("t", spark.createDataFrame([(k, Decimal(v))], f"k int, v {kind}"), keys=("k",))
    found = compare_tables(side(1, "1.5", "decimal(2,1)"), side(2, "1.50", "decimal(3,2)"), CompareOptions(type_policy="coerce"))
    assert [r.category for r in found.differences.collect()] == ["reassigned"]


def test_samples_of_tables_with_maps(spark):
    kind = "a int, m map<string, map<string, int>>"
    source = TableRef("t", spark.createDataFrame([(1, {"x": {"y": 1}}), (1, {"x": {"y": 1}})], kind))
    target = TableRef("t", spark.createDataFrame([(1, {"x": {"y": 1}})], kind))
    comparison = compare_tables(source, target, ALL)
    samples = sample_rows(comparison.plan, discrepancies(comparison.plan)).collect()
    assert [r.row.m for r in samples] == [{"x": {"y": 1}}] * 2


def test_keys_with_commas_stay_apart(spark):
    kind = "a string, b string, v int"
    keys = [("x, b=y", "z"), ("x", "y, b=z"), ("x\\", ", b=z"), ("x\\, b=", "z")]
    side = lambda v: TableRef("t", spark.createDataFrame([(*k, v) for k in keys], kind), keys=("a", "b"))
    found = compare_tables(side(1), side(2), ALL)
    assert len({r.row_key for r in found.difference_keys().collect()}) == len(keys)


def test_surplus_of_a_repeated_key_is_one_sided(spark):
    side = lambda n: TableRef("t", spark.createDataFrame([(7, i) for i in range(n)] + [(8, n)], "k int, v int"), keys=("k",))
    plan = compare_tables(side(3), side(2), ALL).plan
    assert [tuple(r) for r in one_sided(plan, ONLY_IN_SOURCE).collect()] == [(7, 2)]
    assert one_sided(plan, ONLY_IN_TARGET).count() == 0
