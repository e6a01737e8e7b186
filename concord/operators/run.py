"""Comparison of one table and of whole sides."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import cached_property, reduce

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from concord.functions.columns import text
from concord.operators.cells import cell_diff, row_key
from concord.operators.keyed import (
    ONLY_IN_SOURCE,
    ONLY_IN_TARGET,
    differing,
    digest_plan,
    keyed_rows,
)
from concord.operators.multiset import discrepancies
from concord.operators.ordinals import HOT_GROUP_ROWS
from concord.operators.reassign import reconcile
from concord.operators.summary import (
    empty_summary,
    keyed_summary,
    multiset_summary,
    report_order,
    run_rollup,
    summary_from_differences,
)
from concord.plans.compare_plan import CompareOptions, ComparePlan, resolve_plan
from concord.plans.table import Side, TableRef, pair_tables
from concord.session import discard, materialize, materialized, side_by_side


class TableComparison:
    """The comparison of one pair of tables.

    ``rows`` and ``summary`` are lazy. ``differences`` is what a run writes, shows and reconciles: the unequal rows
    alone, evaluated once and kept in the checkpoint folder, with moved rows already paired. The pass that finds them also
    counts the rows of both sides, so that ``summary_of_differences`` needs no further look at these.
    """

    def __init__(self, plan: ComparePlan, hot_rows: int = HOT_GROUP_ROWS) -> None:
        self.plan = plan
        self.hot_rows = hot_rows

    @property
    def table_name(self) -> str:
        return self.plan.table_name

    @cached_property
    def rows(self) -> DataFrame:
        """All aligned rows, matched ones included, before moved rows are paired."""
        return keyed_rows(self.plan, self.hot_rows)

    @cached_property
    def _kept(self) -> tuple[DataFrame, int, int]:
        """The differences, and the rows of each side as observed in the same job: one scan per side."""
        seen = Observation()
        counted = self.rows.observe(
            seen,
            F.expr(f"count_if(category <> '{ONLY_IN_TARGET}')").alias("source_rows"),
            F.expr(f"count_if(category <> '{ONLY_IN_SOURCE}')").alias("target_rows"),
        )
        unequal, path = materialized(differing(counted))
        paired = reconcile(unequal, self.plan, self.hot_rows)
        if paired is not unequal:
            paired = materialize(paired)
            discard(unequal.sparkSession, path)
        return paired, seen.get["source_rows"], seen.get["target_rows"]

    @cached_property
    def differences(self) -> DataFrame:
        if not self.plan.usable_key:
            return discrepancies(self.plan)
        return self._kept[0]

    @cached_property
    def summary(self) -> DataFrame:
        if not self.plan.common:
            return empty_summary(self.plan)
        digested = digest_plan(self.plan) if self.plan.options.summary_by_digest else None
        plan = digested or self.plan
        if not plan.usable_key:
            return multiset_summary(plan)
        return keyed_summary(keyed_rows(plan, self.hot_rows) if digested else self.rows, plan)

    @cached_property
    def summary_of_differences(self) -> DataFrame:
        """The summary counted from ``differences`` and the sizes of the sides observed with them: no side is read again."""
        if not self.plan.usable_key:
            return self.summary
        return summary_from_differences(*self._kept, self.plan)

    @property
    def cells(self) -> DataFrame:
        if not self.plan.usable_key:
            raise ValueError(f"{self.table_name} has no usable key; its differences are contents, not cells")
        return cell_diff(self.differences, self.plan)

    def difference_keys(self, condition: str = "true") -> DataFrame:
        """``table_name category row_key row_count`` of the differences, the form in which differences are accepted.

        Without a key a difference is a content with all its surplus rows, and its key is the content hash.
        """
        found = self.differences.filter(condition)
        name = f"{text(self.table_name)} AS table_name"
        if self.plan.usable_key:
            return found.selectExpr(name, "category", f"{row_key(self.plan)} AS row_key", "1L AS row_count")
        category = f"IF(missing_from_target > 0, '{ONLY_IN_SOURCE}', '{ONLY_IN_TARGET}') AS category"
        return found.selectExpr(
            name, category, "content_hash AS row_key", "missing_from_target + missing_from_source AS row_count"
        )


class RunComparison:
    """The comparison of all tables found on both sides."""

    def __init__(self, tables: list[TableComparison]) -> None:
        self.tables = {table.table_name: table for table in tables}

    def __getitem__(self, table_name: str) -> TableComparison:
        return self.tables[table_name]

    @cached_property
    def summary(self) -> DataFrame | None:
        """One row per table as one lazy frame, so that Spark runs the tables side by side; None without tables."""
        parts = side_by_side(lambda table: table.summary, self.tables.values())
        return reduce(DataFrame.unionByName, parts) if parts else None

    def report(self) -> DataFrame:
        return report_order(self.summary)

    def rollup(self) -> DataFrame:
        return run_rollup(self.summary)


def compare_tables(
    source: TableRef, target: TableRef, options: CompareOptions | None = None, hot_rows: int = HOT_GROUP_ROWS
) -> TableComparison:
    return TableComparison(resolve_plan(source, target, options), hot_rows)


def compare_sides(
    source: Side,
    target: Side,
    options: Mapping[str, CompareOptions] | None = None,
    default: CompareOptions | None = None,
    exclude: Iterable[str] = (),
    only: Iterable[str] | None = None,
) -> RunComparison:
    """Compares every table and view that both sides have; ``options`` are looked up by full or bare table name."""
    chosen = {name.lower(): value for name, value in (options or {}).items()}
    comparisons = []
    for source_table, target_table in pair_tables(source, target, exclude, only):
        option = chosen.get(source_table.full_name.lower()) or chosen.get(source_table.name.lower()) or default
        comparisons.append(compare_tables(source_table, target_table, option))
    return RunComparison(comparisons)
