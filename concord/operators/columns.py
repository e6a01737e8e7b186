"""Column metadata: differences per table pair, and the column list of a table as DDL lines.

A column list has ``schema_name table_name kind column_name ordinal data_type max_length precision scale is_nullable
is_identity is_primary_key primary_key_ordinal``, one row per column; see :mod:`concord.sources.metadata`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concord.operators.objects import VIEW

COMPARED = ("data_type", "max_length", "precision", "scale", "is_nullable", "is_identity", "is_primary_key")
ONLY_IN_SOURCE, ONLY_IN_TARGET, CHANGED = "Only in Source", "Only in Target", "Changed"

FULL_NAME = "concat_ws('.', schema_name, table_name)"

# Fixed formats of a declared type: text lengths in characters, MAX for unbounded, precision and scale for decimals.
TYPE_TEXT = """concat('[', data_type, ']', CASE
  WHEN lower(data_type) IN ('nvarchar', 'nchar')
    THEN concat('(', IF(max_length = -1, 'MAX', CAST(max_length div 2 AS STRING)), ')')
  WHEN lower(data_type) IN ('varchar', 'char', 'binary', 'varbinary')
    THEN concat('(', IF(max_length = -1, 'MAX', CAST(max_length AS STRING)), ')')
  WHEN lower(data_type) IN ('decimal', 'numeric') THEN concat('(', precision, ', ', scale, ')')
  ELSE '' END)"""
COLUMN_LINE = f"concat('[', column_name, '] ', {TYPE_TEXT}, IF(is_nullable, ' NULL', ' NOT NULL'))"


def _joined(source: DataFrame, target: DataFrame) -> DataFrame:
    def side(columns: DataFrame, name: str) -> DataFrame:
        return columns.selectExpr(
            f"lower({FULL_NAME}) AS {name}_table",
            f"lower(column_name) AS {name}_match",
            f"struct({FULL_NAME} AS full_name, *, {COLUMN_LINE} AS line) AS {name}",
        )

    return side(source, "source").join(
        side(target, "target"),
        F.expr("source_table = target_table AND source_match = target_match"),
        "full_outer",
    ).selectExpr("coalesce(source_table, target_table) AS table_key", "source", "target")


def column_changes(source: DataFrame, target: DataFrame) -> DataFrame:
    """Columns of tables found on both sides that exist on one side only or differ in type, length, precision, scale,
    nullability, identity or key membership. Column order and key order are not differences."""

    def differs(name: str) -> str:
        left, right = f"source.{name}", f"target.{name}"
        if name == "data_type":
            left, right = f"lower({left})", f"lower({right})"
        return f"CASE WHEN NOT ({left} <=> {right}) THEN '{name}' END"

    facets = f"concat_ws(',', {', '.join(differs(name) for name in COMPARED)})"
    both = "source IS NOT NULL AND target IS NOT NULL"
    # Windows over the columns of one table only.
    on_both_sides = " AND ".join(f"max({side} IS NOT NULL) OVER (PARTITION BY table_key)" for side in ("source", "target"))
    return (
        _joined(source, target)
        .selectExpr(
            f"{on_both_sides} AS compared",
            "coalesce(source.full_name, target.full_name) AS full_name",
            "coalesce(source.column_name, target.column_name) AS column_name",
            f"CASE WHEN target IS NULL THEN '{ONLY_IN_SOURCE}' WHEN source IS NULL THEN '{ONLY_IN_TARGET}' "
            f"WHEN {facets} <> '' THEN '{CHANGED}' END AS change",
            f"IF({both}, {facets}, '') AS changed_facets",
            "source.data_type AS source_type",
            "target.data_type AS target_type",
        )
        .filter("compared AND change IS NOT NULL")
        .drop("compared")
    )


def changed_tables(source: DataFrame, target: DataFrame) -> DataFrame:
    """Full names of tables with at least one column change."""
    return column_changes(source, target).select("full_name").distinct()


def ddl_lines(columns: DataFrame) -> DataFrame:
    """The column lines of each table in column order."""
    return columns.selectExpr(f"{FULL_NAME} AS full_name", "ordinal", f"{COLUMN_LINE} AS ddl_line")


def ddl_diff(source: DataFrame, target: DataFrame) -> DataFrame:
    """The DDL of both sides line by line, aligned by column name.

    A column of one side has an absent (NULL) partner. A line is highlighted when the two texts differ; when the whole
    table is missing on one side, all its lines are. Source columns come first, then those only in Target.
    """
    # Windows over the columns of one table only; the header and bracket lines hang on its first column.
    table = "PARTITION BY table_key"

    def header(side: str) -> str:
        create = f"concat('CREATE ', IF({side}.kind = '{VIEW}', 'VIEW', 'TABLE'), ' [', {side}.schema_name, '].[', {side}.table_name, ']')"
        return f"max({create}) OVER ({table}) AS {side}_header"

    numbered = _joined(source, target).selectExpr(
        "*",
        f"row_number() OVER ({table} ORDER BY source IS NULL, coalesce(source.ordinal, target.ordinal)) AS n",
        f"count(*) OVER ({table}) AS columns",
        header("source"),
        header("target"),
    )

    def line(line_no: str, source_text: str, target_text: str, highlight: str) -> str:
        return (
            f"named_struct('line_no', CAST({line_no} AS INT), 'source_text', {source_text}, "
            f"'target_text', {target_text}, 'highlight', {highlight})"
        )

    def column_text(side: str) -> str:
        return f"IF({side} IS NULL, NULL, concat('    ', {side}.line, IF(n = columns, '', ',')))"

    def bracket(character: str) -> list[str]:
        return [f"IF({side}_header IS NULL, NULL, '{character}')" for side in ("source", "target")]

    one_sided = "source_header IS NULL OR target_header IS NULL"
    own = line("n + 2", column_text("source"), column_text("target"), "NOT (source.line <=> target.line)")
    frame = [
        line("1", "source_header", "target_header", one_sided),
        line("2", *bracket("("), one_sided),
        line("columns + 3", *bracket(")"), one_sided),
    ]
    lines = f"IF(n = 1, array({', '.join([*frame, own])}), array({own}))"
    return numbered.selectExpr("table_key AS full_name", f"inline({lines})")
