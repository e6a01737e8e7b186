"""Differences as one record per cell, and as flat rows for a sink."""

from __future__ import annotations

from pyspark.sql import DataFrame

from concord.functions.canonical import canonical_text, display_text
from concord.functions.columns import quote, struct_of, text
from concord.operators.keyed import (
    CHANGED,
    REASSIGNED,
    SOURCE,
    TARGET,
    aligned_key,
    differing,
    key_type,
    value_type,
)
from concord.plans.compare_plan import ColumnPair, ComparePlan

# Kinds of a cell and the texts shown instead of a large column.
CELL_MATCHED = "Matched"
CELL_EXPECTED = "ExpectedDifference"
CELL_REAL = "RealDifference"
LARGE_DIFFERS = "(large column — content differs)"
LARGE_MATCHES = "(large column — content matches)"
LARGE_ONE_SIDED = "(large column)"


def row_key(plan: ComparePlan) -> str:
    """Text that identifies a difference inside its table and category: ``name=value`` pairs of the aligned key.

    A comma inside a value is written with a backslash before it (and a backslash doubled, as in canonical text), so that
    different keys never read alike.
    """

    def side_text(struct: str, side: str) -> str:
        def value(pair: ColumnPair) -> str:
            return f"replace({canonical_text(quote(pair.name, struct), key_type(pair, side))}, ',', {text(chr(92) + ',')})"

        parts = [f"concat({text(pair.name + '=')}, {value(pair)})" for pair in plan.keys]
        return f"concat_ws(', ', {', '.join(parts)})"

    source, target = side_text("source_key", SOURCE), side_text("target_key", TARGET)
    return f"CASE WHEN source_key IS NOT NULL THEN {source} ELSE {target} END"


def _cell(plan: ComparePlan, position: int, pair: ColumnPair) -> str:
    is_key = position < len(plan.keys)
    differs = f"array_contains(changed_columns, {text(pair.name)})"
    if is_key:
        kind = f"CASE category WHEN '{REASSIGNED}' THEN '{CELL_EXPECTED}' WHEN '{CHANGED}' THEN '{CELL_MATCHED}' ELSE '{CELL_REAL}' END"
        source = display_text(quote(pair.name, "source_key"), key_type(pair, SOURCE))
        target = display_text(quote(pair.name, "target_key"), key_type(pair, TARGET))
    else:
        kind = (
            f"CASE WHEN category = '{REASSIGNED}' OR (category = '{CHANGED}' AND NOT {differs}) "
            f"THEN '{CELL_MATCHED}' ELSE '{CELL_REAL}' END"
        )
        source = display_text(quote(pair.name, "source"), value_type(pair, SOURCE))
        target = display_text(quote(pair.name, "target"), value_type(pair, TARGET))
        if pair.large:
            source = target = (
                f"CASE WHEN category NOT IN ('{CHANGED}', '{REASSIGNED}') THEN {text(LARGE_ONE_SIDED)} "
                f"WHEN {differs} THEN {text(LARGE_DIFFERS)} ELSE {text(LARGE_MATCHES)} END"
            )
    return struct_of(
        [
            ("column_no", str(position)),
            ("column_name", text(pair.name)),
            ("source_value", f"CASE WHEN source_key IS NULL THEN '' ELSE {source} END"),
            ("target_value", f"CASE WHEN target_key IS NULL THEN '' ELSE {target} END"),
            ("cell_kind", kind),
        ]
    )


def cell_diff(differences: DataFrame, plan: ComparePlan) -> DataFrame:
    """One record per column of each differing row: ``category row_key column_name source_value target_value cell_kind``.

    A changed value is a real difference, unchanged values and the key match, the key of a moved row is an expected
    difference, and every column of a one-sided row is a real difference with the other side blank.
    """
    cells = [_cell(plan, position, pair) for position, pair in enumerate((*plan.keys, *plan.values))]
    return differing(differences).selectExpr(
        "category", f"{row_key(plan)} AS row_key", f"inline(array({', '.join(cells)}))"
    )


def flat_rows(rows: DataFrame, plan: ComparePlan) -> DataFrame:
    """Rows with one column per field: keys, ``category``, ``changed_columns`` as sorted text, and both sides.

    Keys come from Source, or from Target for a row only there; ``target_<key>`` holds the new key of a moved row.
    """
    return rows.selectExpr(
        *[f"{key} AS {quote(pair.name)}" for key, pair in zip(aligned_key(plan), plan.keys)],
        "category",
        "concat_ws(',', sort_array(changed_columns)) AS changed_columns",
        *[
            f"CASE WHEN category = '{REASSIGNED}' THEN {quote(pair.name, 'target_key')} END AS {quote('target_' + pair.name)}"
            for pair in plan.keys
        ],
        *[
            f"{quote(pair.name, struct)} AS {quote(struct + '_' + pair.name)}"
            for struct in ("source", "target")
            for pair in plan.values
        ],
    )
