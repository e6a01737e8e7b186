from __future__ import annotations

from pathlib import Path

from concord import CompareOptions, TableRef, compare_tables
from concord.operators.incremental import _within, incremental_summary, merged_ranges
from concord.plans.compare_plan import KeyRange

COUNTS = ("source_rows", "target_rows", "matched", "changed", "missing_from_target", "missing_from_source", "reassigned")


def write(spark, rows, path, mode="append"):
    spark.createDataFrame(rows, "id int, v string").coalesce(1).write.mode(mode).parquet(str(path))


def plan(spark, folder, **options):
    sides = (TableRef("t", spark.read.parquet(f"{folder}/{side}"), ("id",)) for side in ("s", "t"))
    return compare_tables(*sides, CompareOptions(**options)).plan


def check(run, spark, folder):
    """The counts of a whole new comparison."""
    sides = (TableRef("t", spark.read.parquet(f"{folder}/{side}"), ("id",)) for side in ("s", "t"))
    want, row = compare_tables(*sides).summary.first(), run.summary.first()
    assert [row[name] for name in COUNTS] == [want[name] for name in COUNTS]
    assert row.has_differences == want.has_differences


def ranges_of(spark, state, keys):
    """The ranges that hold the keys, by the stored bounds and plain comparison."""
    last = sorted(path.name for path in Path(state).iterdir())[-1]
    bounds = [row.boundary for row in spark.read.parquet(f"{state}/{last}/bounds").orderBy("boundary_no").collect()]
    return tuple(sorted({1 + sum(key > bound for bound in bounds) for key in keys}))


def test_only_ranges_of_changed_files_are_compared_again(spark, tmp_path):
    rows = [(i, f"v{i}") for i in range(100)]
    for at in range(0, 100, 20):
        write(spark, rows[at : at + 20], tmp_path / "s")
        write(spark, rows[at : at + 20], tmp_path / "t")
    state = str(tmp_path / "state")
    first = incremental_summary(plan(spark, tmp_path), state, ranges=10)
    assert first.compared == tuple(range(1, 11)) and first.ranges == 10
    check(first, spark, tmp_path)
    assert incremental_summary(plan(spark, tmp_path), state).compared == ()

    # A new file with keys of two ranges; one of its rows is the content of a row that Source loses below.
    write(spark, [(15, "other"), (95, "v95"), (200, "v30")], tmp_path / "t")
    added = incremental_summary(plan(spark, tmp_path), state)
    assert added.compared == ranges_of(spark, state, [15, 95, 200]) and len(added.compared) == 2
    check(added, spark, tmp_path)

    # A file rewritten without some of its rows: the ranges that it held before count as changed as well.
    victim = next(p for p in (tmp_path / "t").glob("*.parquet") if spark.read.parquet(str(p)).where("id = 30").count())
    victim.unlink()
    write(spark, [(i, f"v{i}") for i in range(20, 30)], tmp_path / "t")
    shrunk = incremental_summary(plan(spark, tmp_path), state)
    assert shrunk.compared == ranges_of(spark, state, range(20, 40)) and len(shrunk.compared) < 5
    check(shrunk, spark, tmp_path)
    assert shrunk.summary.first().reassigned == 1


def test_another_plan_and_a_broken_run_compare_everything(spark, tmp_path):
    write(spark, [(i, "a") for i in range(10)] + [(None, "n")], tmp_path / "s")
    write(spark, [(i, "a") for i in range(9)] + [(None, "m")], tmp_path / "t")
    state = str(tmp_path / "state")
    check(incremental_summary(plan(spark, tmp_path), state, ranges=2), spark, tmp_path)
    assert incremental_summary(plan(spark, tmp_path, type_policy="coerce"), state, ranges=2).compared == (1, 2)
    for mark in (tmp_path / "state").glob("*/plan/_SUCCESS"):
        mark.unlink()
    assert incremental_summary(plan(spark, tmp_path), state, ranges=2).compared == (1, 2)


def test_empty_sides(spark, tmp_path):
    write(spark, [], tmp_path / "s")
    write(spark, [], tmp_path / "t")
    run = incremental_summary(plan(spark, tmp_path), str(tmp_path / "state"))
    check(run, spark, tmp_path)
    write(spark, [(1, "a")], tmp_path / "t")
    check(incremental_summary(plan(spark, tmp_path), str(tmp_path / "state")), spark, tmp_path)


def test_the_compared_ranges_reach_the_scans(spark, tmp_path):
    write(spark, [(i, "a") for i in range(10)], tmp_path / "s")
    write(spark, [(i, "a") for i in range(10)], tmp_path / "t")
    cut = _within(plan(spark, tmp_path), [2, 4, 6], {2, 3})
    text = cut.target.df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(id,2)" in text and "LessThanOrEqual(id,6)" in text
    assert merged_ranges([2, 4, 6], {1, 3, 4}) == [KeyRange(None, 2), KeyRange(4, None)]
