"""Rows that moved to another key.

A row only in Source and a row only in Target with equal values are one row under a new key. Equal contents pair by
position in key order, as often as the side with fewer has them. The counts need no pairing: they follow from the
content tallies of the orphans.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concord.operators.keyed import IS_ORPHAN, ONLY_IN_SOURCE, ONLY_IN_TARGET, REASSIGNED, orphan_content
from concord.operators.ordinals import (
    BROADCAST_GROUPS,
    HOT_GROUP_ROWS,
    find_hot_groups,
    split_hot,
    with_positions,
)
from concord.plans.compare_plan import ComparePlan
from concord.session import materialize


def orphan_tallies(rows: DataFrame, plan: ComparePlan) -> DataFrame:
    """Orphans counted by content: ``content_hash``, ``only_in_source``, ``only_in_target``."""
    return (
        rows.filter(IS_ORPHAN)
        .selectExpr("category", f"{orphan_content(plan)} AS content_hash")
        .groupBy("content_hash")
        .agg(*[F.expr(f"count_if(category = '{name}')").alias(name) for name in (ONLY_IN_SOURCE, ONLY_IN_TARGET)])
    )


def reassigned_total(tallies: DataFrame) -> DataFrame:
    """One row with the exact number of moved rows."""
    return tallies.agg(F.expr(f"coalesce(sum(least({ONLY_IN_SOURCE}, {ONLY_IN_TARGET})), 0L)").alias(REASSIGNED))


def reconcile(differences: DataFrame, plan: ComparePlan, hot_rows: int = HOT_GROUP_ROWS) -> DataFrame:
    """``differences`` with each pair of orphans of equal content replaced by one ``reassigned`` row.

    ``differences`` is read several times; pass it materialized.
    """
    others = differences.filter(f"NOT {IS_ORPHAN}")
    orphans = differences.filter(IS_ORPHAN).selectExpr("*", f"{orphan_content(plan)} AS content_hash")
    tallies = materialize(
        orphan_tallies(differences, plan)
        .filter(f"{ONLY_IN_SOURCE} > 0 AND {ONLY_IN_TARGET} > 0")
        .selectExpr("content_hash", f"greatest({ONLY_IN_SOURCE}, {ONLY_IN_TARGET}) AS rows")
    )
    contents, most = tallies.agg(F.count("rows"), F.max("rows")).first()
    if not contents:
        return differences
    hot = find_hot_groups(tallies, ["content_hash"], "rows", hot_rows) if most > hot_rows else None

    # Only contents seen on both sides can pair; the rest of the orphans keep their category. Hot contents are shared
    # ones and leave before the join, so that it has no heavy key.
    cold, heavy = split_hot(orphans, hot) if hot else (orphans, None)
    shared = tallies.selectExpr("content_hash AS shared_hash")
    shared = F.broadcast(shared) if contents <= BROADCAST_GROUPS else shared
    is_shared = F.expr("content_hash = shared_hash")
    unshared = cold.join(shared, is_shared, "left_anti").drop("content_hash")
    candidates = cold.join(shared, is_shared, "left_semi")
    if heavy is not None:
        candidates = candidates.unionByName(heavy)

    def positioned(category: str, side: str) -> DataFrame:
        rows = candidates.filter(f"category = '{category}'").select("content_hash", f"{side}_key", side)
        numbered = with_positions(rows, ["content_hash"], [f"{side}_key"], "position", hot)
        return numbered.selectExpr(f"content_hash AS {side}_hash", f"position AS {side}_position", f"{side}_key", side)

    paired = (
        positioned(ONLY_IN_SOURCE, "source")
        .join(
            positioned(ONLY_IN_TARGET, "target"),
            F.expr("source_hash = target_hash AND source_position = target_position"),
            "full_outer",
        )
        .selectExpr(
            f"CASE WHEN target_hash IS NULL THEN '{ONLY_IN_SOURCE}' WHEN source_hash IS NULL THEN '{ONLY_IN_TARGET}' "
            f"ELSE '{REASSIGNED}' END AS category",
            "source_key",
            "target_key",
            "CAST(array() AS ARRAY<STRING>) AS changed_columns",
            "source",
            "target",
        )
    )
    return others.unionByName(unshared).unionByName(paired)
