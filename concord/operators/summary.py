"""Exact counts per table, per part of a table and per run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concord.functions.columns import any_of, struct_of, text, truth
from concord.operators.keyed import (
    CHANGED,
    IS_ORPHAN,
    MATCHED,
    ONLY_IN_SOURCE,
    ONLY_IN_TARGET,
    REASSIGNED,
    orphan_content,
)
from concord.operators.multiset import multiset_totals
from concord.plans.compare_plan import ComparePlan

KEYED = "keyed"
MULTISET = "multiset"
NOT_COMPARED = "no common columns"

# The four kinds of difference and the summary column that counts each.
DIFFERENCES = {
    CHANGED: "changed",
    ONLY_IN_SOURCE: "missing_from_target",
    ONLY_IN_TARGET: "missing_from_source",
    REASSIGNED: "reassigned",
}
COUNT_COLUMNS = ("source_rows", "target_rows", "matched", *DIFFERENCES.values())
PART_COLUMNS = ("source_rows", "target_rows", "matched", "changed", "only_in_source", "only_in_target")
DIFFERING = " + ".join(DIFFERENCES.values())


def _with_verdict(counts: DataFrame) -> DataFrame:
    """Adds whether anything differs and the share of Source rows that do.

    The share can exceed 100 and is 0 for an empty Source, so ``has_differences`` is the verdict.
    """
    return counts.selectExpr(
        "*",
        f"{DIFFERING} > 0 AS has_differences",
        f"CASE WHEN source_rows = 0 THEN 0.0D ELSE ({DIFFERING}) * 100.0D / source_rows END AS percent_differs",
    )


def _finish(counts: DataFrame, plan: ComparePlan, comparison: str) -> DataFrame:
    named = counts.selectExpr(
        f"{text(plan.table_name)} AS table_name",
        f"'{comparison}' AS comparison",
        f"{truth(plan.keys_only)} AS keys_only",
        *COUNT_COLUMNS,
    )
    return _with_verdict(named)


def keyed_summary(rows: DataFrame, plan: ComparePlan) -> DataFrame:
    """One row of counts from all aligned rows, moved rows taken out of both orphan counts.

    The rows are counted by orphan content first (one group holds everything else and collapses before the shuffle);
    the number of moved rows follows from those tallies without pairing rows.
    """
    letters = {"m": MATCHED, "c": CHANGED, "s": ONLY_IN_SOURCE, "t": ONLY_IN_TARGET}
    totals = (
        rows.selectExpr("category", f"{orphan_content(plan)} AS content_hash")
        .groupBy("content_hash")
        .agg(*[F.expr(f"count_if(category = '{category}')").alias(letter) for letter, category in letters.items()])
        .agg(
            *[F.expr(f"coalesce(sum({letter}), 0L)").alias(letter) for letter in letters],
            F.expr("coalesce(sum(least(s, t)), 0L)").alias("r"),
        )
    )
    counts = totals.selectExpr(
        "m + c + s AS source_rows",
        "m + c + t AS target_rows",
        "m AS matched",
        "c AS changed",
        "s - r AS missing_from_target",
        "t - r AS missing_from_source",
        "r AS reassigned",
    )
    return _finish(counts, plan, KEYED)


def summary_from_differences(differences: DataFrame, source_rows: int, target_rows: int, plan: ComparePlan) -> DataFrame:
    """The same row of counts from reconciled differences only, with the row counts of the sides read separately."""
    counts = differences.agg(
        *[F.expr(f"count_if(category = '{category}')").alias(name) for category, name in DIFFERENCES.items()]
    ).selectExpr(
        "*",
        f"{source_rows}L AS source_rows",
        f"{target_rows}L AS target_rows",
        f"{source_rows}L - changed - missing_from_target - reassigned AS matched",
    )
    return _finish(counts, plan, KEYED)


def multiset_summary(plan: ComparePlan) -> DataFrame:
    """One row of counts for a table without a usable key: everything that differs is missing on one side."""
    return _finish(multiset_totals(plan).selectExpr("*", "0L AS changed", "0L AS reassigned"), plan, MULTISET)


def empty_summary(plan: ComparePlan) -> DataFrame:
    """A row of zeros for a pair of tables without common columns."""
    zeros = plan.source.df.sparkSession.range(1).selectExpr(*[f"0L AS {name}" for name in COUNT_COLUMNS])
    return _finish(zeros, plan, NOT_COMPARED)


def part_counts(rows: DataFrame, *parts: str) -> DataFrame:
    """Counts per part of a table, before moved rows are reconciled: a row may move to another part."""
    counts = {
        "source_rows": f"category <> '{ONLY_IN_TARGET}'",
        "target_rows": f"category <> '{ONLY_IN_SOURCE}'",
        "matched": f"category = '{MATCHED}'",
        "changed": f"category = '{CHANGED}'",
        "only_in_source": f"category = '{ONLY_IN_SOURCE}'",
        "only_in_target": f"category = '{ONLY_IN_TARGET}'",
    }
    return rows.groupBy(*parts).agg(*[F.expr(f"count_if({test})").alias(name) for name, test in counts.items()])


def combine_parts(parts: DataFrame, tallies: DataFrame) -> DataFrame:
    """Adds up stored counts of parts and reconciles moved rows once, over the whole table.

    ``parts`` has ``table_name`` and the columns of :func:`part_counts`; ``tallies`` has ``table_name``,
    ``content_hash`` and the orphan counts of each part.
    """
    moved = (
        tallies.groupBy("table_name", "content_hash")
        .agg(F.expr(f"least(sum({ONLY_IN_SOURCE}), sum({ONLY_IN_TARGET}))").alias("moved"))
        .selectExpr("table_name", *[f"0L AS {name}" for name in PART_COLUMNS], "moved")
    )
    sums = (
        parts.selectExpr("table_name", *PART_COLUMNS, "0L AS moved")
        .unionByName(moved)
        .groupBy("table_name")
        .agg(*[F.sum(name).alias(name) for name in (*PART_COLUMNS, "moved")])
    )
    counts = sums.selectExpr(
        "table_name",
        "source_rows",
        "target_rows",
        "matched",
        "changed",
        "only_in_source - moved AS missing_from_target",
        "only_in_target - moved AS missing_from_source",
        "moved AS reassigned",
    )
    return _with_verdict(counts)


def run_rollup(summary: DataFrame) -> DataFrame:
    """One row for the whole run."""
    return summary.agg(
        F.expr("count(*)").alias("tables_compared"),
        F.expr("count_if(has_differences)").alias("tables_differing"),
        *[F.expr(f"coalesce(sum({name}), 0L)").alias(name) for name in COUNT_COLUMNS],
    )


def report_order(summary: DataFrame) -> DataFrame:
    """Differing tables first, then by name."""
    return summary.orderBy(F.expr("has_differences").desc(), F.expr("lower(table_name)"))


def replace_tables(old: DataFrame, new: DataFrame) -> DataFrame:
    """The summary of an earlier run with the rows of recompared tables replaced."""
    columns = ", ".join(old.columns)
    runs = old.selectExpr(f"struct({columns}) AS row", "0 AS run").unionByName(
        new.selectExpr(f"struct({columns}) AS row", "1 AS run")
    )
    return runs.groupBy("row.table_name").agg(F.max_by("row", "run").alias("row")).select("row.*")


def changed_column_profile(rows: DataFrame, plan: ComparePlan) -> DataFrame:
    """How often each value column is among the changed ones, and its share of the changed rows.

    One pass with one conditional count per column; columns that change in nearly every row are candidates for
    exclusion.
    """
    changed = rows.filter(f"category = '{CHANGED}'")
    totals = changed.agg(
        F.expr("count(*)").alias("changed_rows"),
        *[
            F.expr(f"count_if(array_contains(changed_columns, {text(pair.name)}))").alias(f"n{i}")
            for i, pair in enumerate(plan.values)
        ],
    )
    entries = [
        struct_of([("column_name", text(pair.name)), ("changed_count", f"n{i}")]) for i, pair in enumerate(plan.values)
    ]
    return totals.selectExpr("changed_rows", f"inline(array({', '.join(entries)}))").selectExpr(
        "*", "CASE WHEN changed_rows = 0 THEN 0.0D ELSE changed_count / changed_rows END AS share"
    )


def accepted_summary(
    differences: DataFrame, accepted: DataFrame, summary: DataFrame, accept_tables: tuple[str, ...] = ()
) -> DataFrame:
    """The summary after some differences were accepted.

    ``differences`` holds ``table_name``, ``category``, ``row_key`` and ``row_count``, ``accepted`` the first three of
    them; accepted rows leave the count of their category and are counted as accepted. Tables in ``accept_tables`` are accepted as a whole. A table with
    nothing left counts as identical. Acceptance is an argument of the run and is stored nowhere.
    """
    identity = ["table_name", "category", "row_key"]
    sides = ["source_rows", "target_rows", "matched"]
    names = list(DIFFERENCES.values())
    hits = differences.select(*identity, "row_count").join(accepted.select(*identity), identity, "left_semi")
    stacked = summary.selectExpr("table_name", *sides, *names, *[f"0L AS a_{name}" for name in names]).unionByName(
        hits.selectExpr(
            "table_name",
            *[f"0L AS {name}" for name in (*sides, *names)],
            *[f"IF(category = '{category}', row_count, 0L) AS a_{name}" for category, name in DIFFERENCES.items()],
        )
    )
    whole = any_of(f"lower(table_name) = {text(name.lower())}" for name in accept_tables)
    taken = {name: f"IF({whole}, {name}, least({name}, a_{name}))" for name in names}
    return (
        stacked.groupBy("table_name")
        .agg(*[F.sum(name).alias(name) for name in stacked.columns[1:]])
        .selectExpr(
            "table_name",
            *sides,
            *[f"{name} - {value} AS {name}" for name, value in taken.items()],
            f"{' + '.join(taken.values())} AS accepted",
        )
        .selectExpr("*", f"{DIFFERING} > 0 AS has_differences")
    )
