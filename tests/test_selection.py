"""Order statistics by sampling and counting, ranges over several keys, collated keys, footer statistics."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from concord import CompareOptions, KeyRange, TableRef, compare_tables
from concord.operators import ranges
from concord.operators.bounds import with_place
from concord.operators.digest import DigestComparison
from concord.operators.keyed import scan
from concord.operators.selection import _points, _Stretch, values_at
from concord.sources.metadata import footer_statistics

ROWS = 20_000


def keys(spark):
    """A value that a third of the rows share, NaN, text, decimals beyond a long, bytes and both kinds of time."""
    return spark.range(ROWS).selectExpr(
        "CASE WHEN id % 3 = 0 THEN 'hot' ELSE sha(CAST(id AS STRING)) END AS text",
        "CASE WHEN id % 7 = 0 THEN double('nan') ELSE id * 0.37 END AS number",
        "CAST(id * id % 10007 AS DECIMAL(38, 4)) * 1000000000000000000000 AS wide",
        "unhex(sha(CAST(id AS STRING))) AS bytes",
        "timestamp_micros(id * 1234567891) AS at",
        "CAST(timestamp_micros(id * id * 91) AS TIMESTAMP_NTZ) AS local_at",
    )


@pytest.mark.parametrize("column", ["text", "number", "wide", "bytes", "at", "local_at"])
def test_values_at_positions(spark, column):
    df = keys(spark)
    ordered = [row[0] for row in df.select(column).orderBy(column).collect()]
    offsets = [0, ROWS // 3, ROWS // 2, 2 * ROWS // 3 - 1, ROWS - 1]
    # Such a small sample takes several rounds.
    found = [value for (value,) in values_at(df, [column], offsets, sample=400)]
    assert str(found) == str([bytes(ordered[i]) if column == "bytes" else ordered[i] for i in offsets])


def test_several_columns_and_nulls(spark):
    df = spark.range(3000).selectExpr("IF(id % 10 = 0, NULL, id % 3) AS a", "CAST(id * 7919 % 101 AS STRING) AS b", "id % 5 AS c")
    ordered = sorted((row.a, row.b, row.c) for row in df.collect() if row.a is not None)
    offsets = [0, 1, 899, 1350, 2699]
    assert values_at(df, ["a", "b", "c"], offsets, sample=300) == [ordered[i] for i in offsets]
    with pytest.raises(ValueError):
        values_at(df, ["a"], [2700])
    assert values_at(df, ["a"], []) == [] and ranges.range_boundaries(df.limit(0), ["a", "b"], 4) == []


def test_points_bracket_the_position():
    sample = [(i,) for i in range(1000)]
    low, high = _points(sample, _Stretch(500, 100_000, [50_500]))
    assert low[0] < 500 < high[0] and high[0] - low[0] < 120
    assert _points(sample, _Stretch(0, 100_000, [0])) == [(1,)] or _points(sample, _Stretch(0, 100_000, [0]))[-1][0] < 5


def test_many_positions(spark):
    df = spark.range(ROWS).selectExpr("sha(CAST(id AS STRING)) AS k")
    ordered = sorted(row.k for row in df.collect())
    found = ranges.range_boundaries(df, "k", 300)
    assert found == [ordered[i] for i in ranges.boundary_offsets(ROWS, 300)]
    counts = df.select(ranges.bucket_of(F.col("k"), found).alias("b")).groupBy("b").count().collect()
    assert len(counts) == len(found) + 1 and max(row["count"] for row in counts) <= -(-ROWS // 300) + 1


def sides(spark):
    """Keys (kind, number) with few kinds, NULLs in both; rows of one side and changed rows everywhere."""
    schema = "kind string, number int, v int"
    rows = [(kind, n if n % 9 else None if n == 0 else n, n) for kind in ("a", "b", None) for n in range(60)]
    target = [(kind, n, v + (v % 7 == 0)) for kind, n, v in rows if v % 11 != 5] + [("c", 1, 1), (None, 77, 1)]
    return tuple(TableRef("x", spark.createDataFrame(part, schema), ("kind", "number")) for part in (rows, target))


def test_composite_ranges_add_up(spark):
    source, target = sides(spark)
    whole = compare_tables(source, target)
    boundaries = ranges.range_boundaries(source.df, ("kind", "number"), 4)
    assert len(boundaries) == 3 and all(isinstance(boundary, tuple) for boundary in boundaries)
    parts = {row.bucket: row for row in ranges.diff_by_range(whole.rows, whole.plan, boundaries).collect()}
    names = ("source_rows", "target_rows", "matched", "changed")
    for number, key_range in enumerate(ranges.key_ranges(boundaries), start=1):
        single = compare_tables(source, target, CompareOptions(key_range=key_range)).summary.first()
        assert [single[name] for name in names] == [parts[number][name] for name in names]
    total = whole.summary.first()
    assert [sum(part[name] for part in parts.values()) for name in names] == [total[name] for name in names]
    assert ranges.range_label(2, 4, "kind, number", KeyRange(("a", 7), ("b", 1234))) == "Chunk 2 of 4 (kind, number (a, 7) – (b, 1,234))"


def test_composite_range_reaches_the_scan(spark, tmp_path):
    spark.range(100).selectExpr("CAST(id % 4 AS INT) AS a", "id AS b", "id AS v").write.parquet(str(tmp_path / "t"))
    table = TableRef("t", spark.read.parquet(str(tmp_path / "t")), ("a", "b"))
    options = CompareOptions(key_unique=True, key_range=KeyRange((1, 13), (2, 50)))
    plan = compare_tables(table, table, options).plan
    spark.conf.set("spark.sql.maxMetadataValueLength", "2000")
    text = scan(plan, "s")._jdf.queryExecution().toString()
    spark.conf.unset("spark.sql.maxMetadataValueLength")
    # The rest of the list is not shown.
    assert "GreaterThanOrEqual(a,1), Or(GreaterThan(a,1),And(EqualTo(a,1),GreaterThan(b,13)))" in text
    found = {(row.sk0, row.sk1) for row in scan(plan, "s").collect()}
    assert found == {(n % 4, n) for n in range(100) if (1, 13) < (n % 4, n) <= (2, 50)}


@pytest.mark.parametrize("unique", [True, False, None])
def test_collated_keys(spark, unique):
    source = spark.createDataFrame([("Aa", 1), ("bB", 2), ("c", 3), (None, 4), ("É", 5)], "k string, v int")
    target = spark.createDataFrame([("AA", 1), ("bb", 5), ("D", 3), (None, 4), ("é", 5)], "k string, v int")
    options = CompareOptions(key_collation="UTF8_LCASE", key_unique=unique)
    rows = compare_tables(TableRef("x", source, ("k",)), TableRef("x", target, ("k",)), options).rows
    assert rows.schema["source_key"].dataType["k"].dataType == T.StringType()
    found = {(row.category, row.source_key and row.source_key.k, row.target_key and row.target_key.k) for row in rows.collect()}
    assert found == {
        ("matched", "Aa", "AA"), ("changed", "bB", "bb"), ("only_in_source", "c", None), ("only_in_target", None, "D"),
        ("matched", None, None), ("matched", "É", "é"),
    }


def test_trailing_spaces_and_repeats_under_a_collation(spark):
    source = spark.createDataFrame([("a", 1), ("a ", 2), ("b", 3)], "k string, v int")
    target = spark.createDataFrame([("a  ", 2), ("a", 1), ("b  ", 3)], "k string, v int")
    options = CompareOptions(key_collation="UTF8_BINARY_RTRIM")
    row = compare_tables(TableRef("x", source, ("k",)), TableRef("x", target, ("k",)), options).summary.first()
    assert (row.matched, row.changed, row.missing_from_source, row.missing_from_target) == (3, 0, 0, 0)
    with pytest.raises(ValueError):
        CompareOptions(key_collation="x') --")
    with pytest.raises(ValueError):
        CompareOptions(key_collation="UTF8_LCASE", key_range=KeyRange("a", "b"))
    with pytest.raises(ValueError):
        DigestComparison(compare_tables(TableRef("x", source, ("k",)), TableRef("x", target, ("k",)), options).plan).counts


def test_footer_statistics(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(1000).selectExpr("IF(id % 4 = 0, NULL, id) AS k", "DATE'2024-01-01' AS d", "'x' AS t").repartition(3).write.parquet(path)
    found = footer_statistics(spark, path, ["k", "d"])
    row = found.first()
    assert (row.rows, row.k_filled, row.k_min, row.k_max, row.d_max) == (1000, 750, 1, 999, dt.date(2024, 1, 1))
    text = found._jdf.queryExecution().toString()
    assert "PushedAggregation: [COUNT(*), COUNT(k), MIN(k), MAX(k)" in text
    assert spark.conf.get("spark.sql.parquet.aggregatePushdown") == "false"
    with pytest.raises(ValueError):
        footer_statistics(spark, path, ["t"])


def test_wide_decimals_keep_their_type(spark):
    df = spark.createDataFrame([(Decimal("1.50"),), (Decimal("2.25"),), (Decimal("9.00"),)], "k decimal(30,2)")
    assert ranges.range_boundaries(df, "k", 3) == [Decimal("2.25"), Decimal("9.00")]


def test_places_among_bounds_compare_columns_not_structs(spark):
    """Rows compared with bounds as whole structs ran as code too large to be compiled to machine code."""
    kinds = [T.StringType(), T.TimestampNTZType(), T.LongType()]
    day = lambda n: dt.datetime(2020, 1, 1) + dt.timedelta(days=n)
    rows = [(a, b and day(b), c) for a in (None, "A", "B", "C") for b in (None, 1, 2, 3) for c in (None, -5, 0, 7)]
    df = spark.createDataFrame(rows, T.StructType([T.StructField(f"k{i}", kind) for i, kind in enumerate(kinds)]))
    bounds = [("A", day(2), 0), ("A", day(2), 7), ("B", day(1), 1), ("B", day(3), -5), ("C", day(2), 0)]
    placed = with_place(df, [F.col(f"k{i}") for i in range(3)], kinds, bounds, "place")
    filled = lambda row: tuple((value is not None, value) if value is not None else (False,) for value in row)
    wanted = {row: 2 * sum(filled(b) < filled(row) for b in bounds) + (row in bounds) for row in rows}
    assert {tuple(row[:3]): row["place"] for row in placed.collect()} == wanted
    assert "struct" not in placed._jdf.queryExecution().optimizedPlan().toString()
