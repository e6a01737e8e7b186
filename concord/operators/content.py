"""Audits of large content: its guessed type, conflicts with a label column, and the content pairs of changed rows."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concord.functions.columns import all_of, col, quote, text
from concord.functions.content_type import guess_extension, looks_like_pdf
from concord.operators.keyed import (
    CHANGED,
    IS_ORPHAN,
    SOURCE,
    TARGET,
    aligned_key,
    key_expression,
    keyed_rows,
    side_name,
)
from concord.operators.ordinals import HOT_GROUP_ROWS
from concord.plans.compare_plan import ColumnPair, ComparePlan
from concord.plans.table import TableRef

CONTENT = "__content"


def content_type_audit(source: DataFrame, target: DataFrame, content: str) -> DataFrame:
    """Rows per guessed type on each side, NULL content counted under NULL; only leading bytes are shuffled."""
    sides = [
        df.selectExpr(f"'{name}' AS side", f"{guess_extension(quote(content))} AS content_type")
        for name, df in (("source", source), ("target", target))
    ]
    return sides[0].unionByName(sides[1]).groupBy("side", "content_type").agg(F.expr("count(*)").alias("row_count"))


def content_label_conflicts(
    source: DataFrame, target: DataFrame, keys: Sequence[str], flag: str, content: str
) -> DataFrame:
    """Keys flagged as PDF whose content on either side does not look like one, also when both sides agree.

    NULL content is no conflict. Content is reduced to a verdict first, and both sides meet in one aggregation by key,
    so a key with very many rows collapses before the shuffle.
    """

    def side(df: DataFrame, name: str) -> DataFrame:
        other = "target" if name == "source" else "source"
        return df.selectExpr(
            *[quote(key) for key in keys],
            f"{quote(flag)} AS {name}_flag",
            f"CAST(NULL AS BOOLEAN) AS {other}_flag",
            f"{guess_extension(quote(content))} AS {name}_type",
            f"CAST(NULL AS STRING) AS {other}_type",
            f"NOT ({looks_like_pdf(quote(content))}) AS wrong",
        )

    return (
        side(source, "source")
        .unionByName(side(target, "target"))
        .groupBy(*[col(key) for key in keys])
        .agg(
            F.expr("coalesce(bool_or(source_flag), bool_or(target_flag))").alias("flagged"),
            F.expr("bool_or(wrong)").alias("wrong"),
            F.max("source_type").alias("source_type"),
            F.max("target_type").alias("target_type"),
        )
        .filter("flagged AND wrong")
        .drop("flagged", "wrong")
    )


def large_content_pairs(
    plan: ComparePlan, differences: DataFrame, column: str, hot_rows: int = HOT_GROUP_ROWS
) -> DataFrame:
    """The real content of one large column on both sides, for rows where it differs or that exist on one side only.

    The comparison itself carries only hashes; here both sides are first cut to the differing keys and aligned again
    with the content beside its hash. A missing row and a NULL both show as NULL.
    """
    pair = next(pair for pair in plan.values if pair.name.lower() == column.lower())
    differs = f"array_contains(changed_columns, {text(pair.name)})"
    wanted = f"{IS_ORPHAN} OR (category = '{CHANGED}' AND {differs})"
    keys = differences.filter(wanted).selectExpr(
        *[f"{key} AS __k{i}" for i, key in enumerate(aligned_key(plan))]
    )

    def cut(side: str) -> TableRef:
        table = plan.source if side == SOURCE else plan.target
        same_key = all_of(f"{key_expression(key, side)} <=> __k{i}" for i, key in enumerate(plan.keys))
        rows = table.df.join(keys, F.expr(same_key), "left_semi")
        return replace(table, df=rows.withColumn(CONTENT, col(side_name(pair, side))))

    content = ColumnPair(CONTENT, CONTENT, pair.source_type, pair.target_type)
    narrowed = replace(plan, source=cut(SOURCE), target=cut(TARGET), values=(*plan.values, content))
    return (
        keyed_rows(narrowed, hot_rows)
        .filter(wanted)
        .selectExpr(
            *[f"{key} AS {quote(pair.name)}" for key, pair in zip(aligned_key(plan), plan.keys)],
            "category",
            f"source.{CONTENT} AS source_content",
            f"target.{CONTENT} AS target_content",
        )
    )
