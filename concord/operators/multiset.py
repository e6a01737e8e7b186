"""Comparison of tables without a usable key, as multisets of row content.

Both sides are stacked with a side flag and counted in one aggregation over the value columns themselves, so equal
content needs no join, the partial aggregation collapses repeated content before the shuffle, and no hash collision can
merge two contents. A content hash is computed only as an identifier of what differs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from concord.functions.canonical import comparable, content_hash, plain_text
from concord.functions.columns import all_of, quote, struct_of
from concord.operators.expand import CHUNK_ROWS, repeat_rows
from concord.operators.keyed import SOURCE, TARGET, side_frame, side_name, side_type, value_expression, value_type
from concord.plans.compare_plan import ColumnPair, ComparePlan

SAMPLES_PER_CONTENT = 3
MISSING_FROM_TARGET = "greatest(source_count - target_count, 0L)"
MISSING_FROM_SOURCE = "greatest(target_count - source_count, 0L)"


def _expression(pair: ColumnPair, side: str) -> str:
    # Contents of different types are matched as text.
    if pair.large or pair.same_type:
        return value_expression(pair, side)
    return plain_text(quote(side_name(pair, side)), side_type(pair, side))


def _content_type(pair: ColumnPair) -> T.DataType:
    return value_type(pair, SOURCE) if pair.same_type else T.StringType()


def _side_content(plan: ComparePlan, side: str, source: int) -> DataFrame:
    return side_frame(plan, side).selectExpr(
        *[f"{_expression(pair, side)} AS v{i}" for i, pair in enumerate(plan.values)], f"{source}L AS in_source"
    )


def content_counts(plan: ComparePlan) -> DataFrame:
    """Occurrences of each content on each side: ``content`` struct, ``source_count``, ``target_count``."""
    names = [f"v{i}" for i in range(len(plan.values))]
    counted = (
        _side_content(plan, SOURCE, 1)
        .unionByName(_side_content(plan, TARGET, 0))
        .groupBy(*names)
        .agg(F.sum("in_source").alias("source_count"), F.expr("sum(1L - in_source)").alias("target_count"))
    )
    content = struct_of((pair.name, name) for name, pair in zip(names, plan.values)) if names else "NULL"
    return counted.selectExpr(f"{content} AS content", "source_count", "target_count")


def discrepancies(plan: ComparePlan) -> DataFrame:
    """Contents whose counts differ, with the surplus of each side and the identifying hash."""
    digest = content_hash((quote(pair.name, "content"), _content_type(pair)) for pair in plan.values)
    return (
        content_counts(plan)
        .filter("source_count <> target_count")
        .selectExpr(
            f"{digest} AS content_hash",
            "content",
            "source_count",
            "target_count",
            f"{MISSING_FROM_TARGET} AS missing_from_target",
            f"{MISSING_FROM_SOURCE} AS missing_from_source",
        )
    )


def multiset_totals(plan: ComparePlan) -> DataFrame:
    """One row: rows per side, matched rows, surplus per side, number of differing contents."""
    totals = {
        "source_rows": "source_count",
        "target_rows": "target_count",
        "matched": "least(source_count, target_count)",
        "missing_from_target": MISSING_FROM_TARGET,
        "missing_from_source": MISSING_FROM_SOURCE,
    }
    return content_counts(plan).agg(
        *[F.expr(f"coalesce(sum({value}), 0L)").alias(name) for name, value in totals.items()],
        F.expr("count_if(source_count <> target_count)").alias("differing_contents"),
    )


def top_discrepancies(plan: ComparePlan, limit: int) -> DataFrame:
    """The ``limit`` differing contents with the largest count difference; ties by hash."""
    return (
        discrepancies(plan)
        .selectExpr("*", "abs(source_count - target_count) AS delta")
        .orderBy(F.col("delta").desc(), "content_hash")
        .limit(limit)
    )


def surplus_rows(plan: ComparePlan, of_source: bool, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Rows that one side has more often than the other, each as often as it is in surplus."""
    return _repeated(plan, MISSING_FROM_TARGET if of_source else MISSING_FROM_SOURCE, chunk_rows)


def common_rows(plan: ComparePlan, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Rows found on both sides, each as often as on the side that has fewer."""
    return _repeated(plan, "least(source_count, target_count)", chunk_rows)


def _repeated(plan: ComparePlan, times: str, chunk_rows: int) -> DataFrame:
    counted = content_counts(plan).selectExpr("content", f"{times} AS times")
    return repeat_rows(counted, "times", "copy", chunk_rows).select("content.*")


def row_hashes(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``df`` with the content hash of each row over the given columns (all by default)."""
    fields = {field.name: field.dataType for field in df.schema}
    digest = content_hash((quote(name), fields[name]) for name in columns or df.columns)
    return df.selectExpr("*", f"{digest} AS row_hash")


def hash_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Occurrences of each row hash on one side."""
    return row_hashes(df, columns).groupBy("row_hash").agg(F.expr("count(*)").alias("occurrences"))


def sample_rows(plan: ComparePlan, found: DataFrame, samples: int = SAMPLES_PER_CONTENT) -> DataFrame:
    """Up to ``samples`` whole rows for each discrepancy of ``found``, from the side in surplus.

    All common columns are shown, also those left out of the comparison, in a fixed order of rows. Rows meet their
    discrepancy by the content columns, so no row is hashed again, and the row limit is applied before the shuffle by
    content as well, so a content with very many rows stays cheap.
    """
    parts = []
    for side, surplus, other in ((SOURCE, "missing_from_target", "source"), (TARGET, "missing_from_source", "target")):
        df = side_frame(plan, side)
        names = [f"__c{i}" for i in range(len(plan.values))]
        needed = found.filter(f"{surplus} > 0").selectExpr(
            "content_hash",
            "source_count",
            "target_count",
            *[f"{quote(pair.name, 'content')} AS __d{i}" for i, pair in enumerate(plan.values)],
        )
        row = struct_of((pair.name, quote(side_name(pair, side))) for pair in plan.common)
        by = ", ".join(f"{comparable(quote(f.name), f.dataType)} ASC NULLS FIRST" for f in df.schema)
        rank = f"row_number() OVER (PARTITION BY content_hash ORDER BY {by}) AS sample_no"
        same_content = all_of(f"{name} <=> __d{i}" for i, name in enumerate(names))
        parts.append(
            df.selectExpr("*", *[f"{_expression(pair, side)} AS {name}" for name, pair in zip(names, plan.values)])
            .join(needed, F.expr(same_content))
            .selectExpr("*", rank)
            .filter(f"sample_no <= {samples}")
            .selectExpr(
                "content_hash", "source_count", "target_count", f"'{other}' AS sampled_side", "sample_no", f"{row} AS row"
            )
        )
    return parts[0].unionByName(parts[1])
