"""Schema objects (tables, views, functions, procedures): presence, class, and counts per kind.

An object list has the columns ``schema_name name kind modified_at definition``; table-likes and routines are matched
separately, by case-insensitive full name. Definitions are compared by SHA-256, so the join never carries their text.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concord.functions.columns import struct_of, text

TABLE, VIEW, FUNCTION, PROCEDURE = "Table", "View", "Function", "Stored procedure"
KINDS = (TABLE, VIEW, FUNCTION, PROCEDURE)
KIND_LABELS = {TABLE: "Tables", VIEW: "Views", FUNCTION: "Functions", PROCEDURE: "Stored Procedures"}

ONLY_IN_SOURCE, ONLY_IN_TARGET, DIFFERENT, IDENTICAL = "Only in Source", "Only in Target", "Different", "Identical"
SECTION_ORDER = (ONLY_IN_SOURCE, ONLY_IN_TARGET, DIFFERENT, IDENTICAL)


def of_kinds(objects: DataFrame, kinds: Iterable[str] = (TABLE,)) -> DataFrame:
    """The objects of the chosen kinds; tables by default."""
    return objects.filter(F.col("kind").isin(list(kinds)))


def _prepared(objects: DataFrame, side: str) -> DataFrame:
    full_name = "concat_ws('.', schema_name, name)"
    return objects.selectExpr(
        f"IF(kind IN ('{TABLE}', '{VIEW}'), 'table', 'routine') AS {side}_family",
        f"lower({full_name}) AS {side}_match",
        f"{full_name} AS {side}_full_name",
        f"schema_name AS {side}_schema",
        f"name AS {side}_name",
        f"kind AS {side}_kind",
        f"modified_at AS {side}_modified_at",
        f"sha2(definition, 256) AS {side}_digest",
    )


def object_classes(source: DataFrame, target: DataFrame, changed_tables: DataFrame | None = None) -> DataFrame:
    """Every object of either side with its class.

    A routine or view differs when its definition does. ``changed_tables`` (column ``full_name``) adds the tables and
    views whose columns differ, see :func:`concord.operators.columns.changed_tables`.
    """
    joined = _prepared(source, "source").join(
        _prepared(target, "target"),
        F.expr("source_family = target_family AND source_match = target_match"),
        "full_outer",
    )
    marked = "false"
    if changed_tables is not None:
        marks = changed_tables.selectExpr("lower(full_name) AS marked").distinct()
        joined = joined.join(marks, F.expr("source_family = 'table' AND source_match = marked"), "left")
        marked = "marked IS NOT NULL"
    return joined.selectExpr(
        "coalesce(source_full_name, target_full_name) AS full_name",
        "coalesce(source_kind, target_kind) AS kind",
        f"CASE WHEN target_match IS NULL THEN '{ONLY_IN_SOURCE}' WHEN source_match IS NULL THEN '{ONLY_IN_TARGET}' "
        f"WHEN NOT (source_digest <=> target_digest) OR {marked} THEN '{DIFFERENT}' ELSE '{IDENTICAL}' END AS object_class",
        *[f"{side}_{name}" for side in ("source", "target") for name in ("schema", "name", "kind", "modified_at")],
    )


def object_presence(source: DataFrame, target: DataFrame) -> DataFrame:
    """Names on one side only or on both, without looking at definitions."""
    names = [frame.withColumn("definition", F.lit(None).cast("string")) for frame in (source, target)]
    return object_classes(*names).selectExpr(
        "full_name", "kind", f"IF(object_class = '{IDENTICAL}', 'Both', object_class) AS presence"
    )


def report_order(classes: DataFrame) -> DataFrame:
    """Objects by section (one-sided first, identical last), then by name."""
    sections = ", ".join(text(name) for name in SECTION_ORDER)
    return classes.orderBy(F.expr(f"array_position(array({sections}), object_class)"), F.expr("lower(full_name)"))


def kind_summary(classes: DataFrame, compared_kinds: Iterable[str] = KINDS) -> DataFrame:
    """Counts per kind. Kinds without any object are left out; kinds that were not read are stated, never shown as 0."""
    compared = tuple(compared_kinds)
    # A view that became a table counts once on each side, under its own kind there.
    source_side = struct_of(
        [
            ("kind", "source_kind"),
            ("s", "1L"),
            ("t", "0L"),
            ("only_s", f"IF(object_class = '{ONLY_IN_SOURCE}', 1L, 0L)"),
            ("only_t", "0L"),
            ("differs", f"IF(object_class = '{DIFFERENT}', 1L, 0L)"),
        ]
    )
    target_side = struct_of(
        [
            ("kind", "target_kind"),
            ("s", "0L"),
            ("t", "1L"),
            ("only_s", "0L"),
            ("only_t", f"IF(object_class = '{ONLY_IN_TARGET}', 1L, 0L)"),
            ("differs", "0L"),
        ]
    )
    labels = " ".join(f"WHEN {text(kind)} THEN {text(label)}" for kind, label in KIND_LABELS.items())
    counts = (
        classes.selectExpr(f"inline(array({source_side}, {target_side}))")
        .filter(F.col("kind").isin(list(compared)))
        .groupBy("kind")
        .agg(
            F.sum("s").alias("source_count"),
            F.sum("t").alias("target_count"),
            F.sum("only_s").alias("only_in_source"),
            F.sum("only_t").alias("only_in_target"),
            F.sum("differs").alias("different"),
        )
    )
    result = counts.selectExpr(
        f"CASE kind {labels} END AS kind",
        "'compared' AS status",
        "source_count",
        "target_count",
        "only_in_source",
        "only_in_target",
        "different",
        "IF(source_count + only_in_target = 0, 0.0D, (only_in_source + only_in_target + different) * 100.0D "
        "/ (source_count + only_in_target)) AS difference_percent",
    )
    skipped = [(KIND_LABELS[kind], "not compared") for kind in KINDS if kind not in compared]
    if not skipped:
        return result
    missing = classes.sparkSession.createDataFrame(skipped, "kind string, status string")
    return result.unionByName(missing, allowMissingColumns=True)


def difference_percentages(classes: DataFrame) -> DataFrame:
    """Objects on one side only as a share of all objects, and differing objects as a share of the common ones."""
    counts = classes.agg(
        F.expr(f"count_if(object_class IN ('{ONLY_IN_SOURCE}', '{ONLY_IN_TARGET}'))").alias("one_sided"),
        F.expr(f"count_if(object_class = '{DIFFERENT}')").alias("different"),
        F.expr("count(*)").alias("objects"),
    )
    return counts.selectExpr(
        "IF(objects = 0, 0.0D, one_sided * 100.0D / objects) AS object_difference_percent",
        "IF(objects = one_sided, 0.0D, different * 100.0D / (objects - one_sided)) AS definition_difference_percent",
        "one_sided = 0 AND different = 0 AS is_identical",
    )
