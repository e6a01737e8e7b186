"""Writing the result of a run: every differing row, never a sample, and the summary."""

from __future__ import annotations

from functools import reduce
from urllib.parse import quote

from pyspark.sql import DataFrame

from concord.functions.canonical import JSON_OPTIONS
from concord.functions.columns import text
from concord.operators.cells import row_key
from concord.operators.keyed import ONLY_IN_SOURCE, ONLY_IN_TARGET
from concord.operators.run import RunComparison, TableComparison
from concord.session import side_by_side
from concord.sources.readers import FILE_FORMATS


def discrepancy_rows(comparison: TableComparison) -> DataFrame:
    """All differences of a table in one shape for all tables: values as JSON text per side.

    ``table_name category row_key changed_columns source_key target_key source target row_count``; for a table without
    a key one row stands for ``row_count`` equal rows.
    """
    plan = comparison.plan
    name = f"{text(plan.table_name)} AS table_name"
    if not plan.usable_key:
        in_source = "missing_from_target > 0"
        return comparison.differences.selectExpr(
            name,
            f"CASE WHEN {in_source} THEN '{ONLY_IN_SOURCE}' ELSE '{ONLY_IN_TARGET}' END AS category",
            "content_hash AS row_key",
            "'' AS changed_columns",
            "CAST(NULL AS STRING) AS source_key",
            "CAST(NULL AS STRING) AS target_key",
            f"CASE WHEN {in_source} THEN {_json('content')} END AS source",
            f"CASE WHEN NOT {in_source} THEN {_json('content')} END AS target",
            "abs(source_count - target_count) AS row_count",
        )
    return comparison.differences.selectExpr(
        name,
        "category",
        f"{row_key(plan)} AS row_key",
        "concat_ws(',', changed_columns) AS changed_columns",
        *[f"{_json(struct)} AS {struct}" for struct in ("source_key", "target_key", "source", "target")],
        "1L AS row_count",
    )


def _json(struct: str) -> str:
    return f"to_json({struct}, {JSON_OPTIONS})"


def write_table(comparison: TableComparison, path: str, file_format: str = "parquet") -> DataFrame:
    """Writes the differences of one table to its own folder under ``path`` and returns its summary.

    The folder is replaced as a whole, so a repeated run leaves no rows of an earlier one. The heavy join runs once,
    and the same job counts the rows of the two sides: the summary comes from the differences and these counts.
    """
    _check(file_format)
    folder = f"{path}/table_name={quote(comparison.table_name, safe='.-_ ')}"
    rows = discrepancy_rows(comparison).drop("table_name")
    rows.write.mode("overwrite").format(file_format).partitionBy("category").save(folder)
    return comparison.summary_of_differences


def write_run(run: RunComparison, path: str, file_format: str = "parquet") -> DataFrame | None:
    """Writes ``path/differences`` and ``path/summary`` for all tables of a run and returns the summary."""
    _check(file_format)
    summaries = side_by_side(
        lambda comparison: write_table(comparison, f"{path}/differences", file_format), run.tables.values()
    )
    if not summaries:
        return None
    summary = reduce(DataFrame.unionByName, summaries)
    summary.write.mode("overwrite").format(file_format).save(f"{path}/summary")
    return summary


def _check(file_format: str) -> None:
    if file_format not in FILE_FORMATS:
        raise ValueError(f"file format must be one of {FILE_FORMATS}")
