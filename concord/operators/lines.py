"""Line differences of a text column between the two sides of a keyed table (definitions, documents).

Rows are aligned as in the keyed comparison, so repeated keys pair by position and never multiply.
"""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concord.functions.columns import col, quote
from concord.operators.keyed import POSITION, SOURCE, TARGET, align
from concord.operators.ordinals import HOT_GROUP_ROWS, listing, places_for
from concord.plans.compare_plan import ComparePlan
from concord.session import materialize

SAME, ONLY_SOURCE, ONLY_TARGET = "same", "only_source", "only_target"
ROW_NO = "row_no"
#: Bytes of lines that one task aligns, about; a line counts with so many bytes besides its own.
BYTES_PER_TASK, BYTES_PER_LINE = 32 << 20, 64


def split_lines(text: str) -> str:
    """Lines of a text; CRLF counts as LF and an empty text has one empty line."""
    return f"split(replace({text}, '\\r\\n', '\\n'), '\\n', -1)"


def _text_pairs(
    plan: ComparePlan, text: str, changed_only: bool, one_sided: bool, hot_rows: int, places: int | None = None
) -> tuple[DataFrame, list[str]]:
    """The texts to be compared as ``source_text`` and ``target_text``, and the columns that identify a row.

    When keys repeat, the position inside the key is one of these columns.
    """
    pair = next(pair for pair in plan.common if pair.name.lower() == text.lower())
    aligned = align(replace(plan, values=(replace(pair, large=False),)), hot_rows, places)
    keys = [key.name for key in plan.keys]
    identity = [f"coalesce({SOURCE}k{i}, {TARGET}k{i}) AS {quote(key)}" for i, key in enumerate(keys)]
    if f"{SOURCE}{POSITION}" in aligned.columns:
        identity.append(f"coalesce({SOURCE}{POSITION}, {TARGET}{POSITION}) AS {ROW_NO}")
        keys.append(ROW_NO)
    if not one_sided:
        aligned = aligned.filter(f"{SOURCE}_present AND {TARGET}_present")
    if changed_only:
        aligned = aligned.filter(f"NOT ({SOURCE}v0 <=> {TARGET}v0)")
    return aligned.selectExpr(*identity, f"{SOURCE}v0 AS source_text", f"{TARGET}v0 AS target_text"), keys


def line_diff(
    plan: ComparePlan,
    text: str,
    changed_only: bool = True,
    one_sided: bool = False,
    hot_rows: int = HOT_GROUP_ROWS,
) -> DataFrame:
    """Lines of both texts with ``same``, ``only_source`` or ``only_target``.

    The first occurrence of a line in Source pairs with the first in Target, the second with the second, and so on, so
    an inserted or deleted line does not mark the lines after it. A missing text marks all lines of the other one; two
    missing texts have no lines. ``one_sided`` also takes rows that exist on one side only.
    """
    pairs, keys = _text_pairs(plan, text, changed_only, one_sided, hot_rows)
    key_list = listing(keys)
    sides = ", ".join(
        f"named_struct('in_source', {flag}, 'lines', {split_lines(side)})"
        for flag, side in (("true", "source_text"), ("false", "target_text"))
    )
    lines = (
        pairs.selectExpr(*[quote(key) for key in keys], f"inline(array({sides}))")
        .selectExpr(*[quote(key) for key in keys], "in_source", "posexplode(lines) AS (line_no, line)")
        # One shuffle serves the numbering and the pairing below.
        .repartition(*[col(key) for key in keys], "line")
    )
    occurrence = f"row_number() OVER (PARTITION BY {key_list}, line, in_source ORDER BY line_no) AS occurrence"
    paired = (
        lines.selectExpr("*", occurrence)
        .groupBy(*[col(key) for key in keys], "line", "occurrence")
        .agg(
            F.expr("max(IF(in_source, line_no + 1, NULL))").alias("source_line_no"),
            F.expr("max(IF(in_source, NULL, line_no + 1))").alias("target_line_no"),
        )
    )
    return paired.selectExpr(
        *[quote(key) for key in keys],
        "source_line_no",
        "target_line_no",
        "line",
        f"CASE WHEN target_line_no IS NULL THEN '{ONLY_SOURCE}' WHEN source_line_no IS NULL THEN '{ONLY_TARGET}' "
        f"ELSE '{SAME}' END AS status",
    )


def positional_line_diff(
    plan: ComparePlan,
    text: str,
    changed_only: bool = True,
    one_sided: bool = False,
    hot_rows: int = HOT_GROUP_ROWS,
) -> DataFrame:
    """Line n of Source against line n of Target; the lines of a row are zipped in place, without a shuffle of lines."""
    pairs, keys = _text_pairs(plan, text, changed_only, one_sided, hot_rows)
    names = [quote(key) for key in keys]
    arrays = [
        f"coalesce({split_lines(side + '_text')}, CAST(array() AS ARRAY<STRING>)) AS {side}_line"
        for side in ("source", "target")
    ]
    return (
        pairs.selectExpr(*names, *arrays)
        .selectExpr(*names, "posexplode(arrays_zip(source_line, target_line)) AS (position, pair)")
        .selectExpr(
            *names,
            "position + 1 AS line_no",
            "pair.source_line",
            "pair.target_line",
            "NOT (pair.source_line <=> pair.target_line) AS changed",
        )
    )


#: Per gap: every pair of occurrences (one side may be missing), those that may become anchors in order of Source, how
#: long the longest increasing run of Target lines is that ends at each, and one longest run, last pair first.
_CANDIDATES = "filter(pairs, x -> x.s IS NOT NULL AND x.t IS NOT NULL)"
_ANCHORS = "filter(candidates, x -> x.alone = exists(candidates, y -> y.alone))"
_PLACE = "IF(coalesce(x.t > try_element_at(a.tails, -1), true), size(a.tails), size(filter(a.tails, v -> v < x.t)))"
_LEVELS = f"""aggregate(anchors,
  named_struct('tails', CAST(array() AS ARRAY<INT>), 'levels', CAST(array() AS ARRAY<INT>)),
  (a, x) -> transform(array({_PLACE}), p -> named_struct(
    'tails', concat(slice(a.tails, 1, p), array(x.t), slice(a.tails, p + 2, size(a.tails))),
    'levels', concat(a.levels, array(p + 1))))[0],
  a -> a.levels)"""
_CHAIN = """aggregate(reverse(arrays_zip(anchors, levels)),
  named_struct('need', coalesce(array_max(levels), 0), 'chain', CAST(array() AS ARRAY<STRUCT<s: INT, t: INT>>)),
  (a, x) -> IF(x.levels = a.need,
    named_struct('need', a.need - 1, 'chain', concat(a.chain, array(named_struct('s', x.anchors.s, 't', x.anchors.t)))), a),
  a -> a.chain)"""
#: The lines of a gap again, and both ends of each anchor.
_LINES = "inline(concat({})) AS (in_source, no, line, s, t)".format(
    ", ".join(
        f"transform({items}, x -> named_struct('in_source', {side}, 'no', {no}, 'line', {line}, 's', {s}, 't', {t}))"
        for items, side, no, line, s, t in (
            ("filter(pairs, x -> x.s IS NOT NULL)", "true", "x.s", "x.line", "CAST(NULL AS INT)", "CAST(NULL AS INT)"),
            ("filter(pairs, x -> x.t IS NOT NULL)", "false", "x.t", "x.line", "CAST(NULL AS INT)", "CAST(NULL AS INT)"),
            ("chain", "true", "x.s", "CAST(NULL AS STRING)", "x.s", "x.t"),
            ("chain", "false", "x.t", "CAST(NULL AS STRING)", "x.s", "x.t"),
        )
    )
)


def _text_bytes(plan: ComparePlan, text: str) -> int:
    """Bytes of the lines of both sides."""
    pair = next(pair for pair in plan.common if pair.name.lower() == text.lower())
    total = 0
    for df, name in ((plan.source.df, pair.name), (plan.target.df, pair.target_name)):
        own = f"octet_length({quote(name)})"
        breaks = f"({own} - octet_length(replace({quote(name)}, '\n', '')) + 1)"
        total += df.agg(F.expr(f"coalesce(sum({own} + {BYTES_PER_LINE} * {breaks}), 0L)")).first()[0]
    return total


def _by_row(lines: DataFrame, size: int) -> DataFrame:
    """Lines of one text together; what a task gets doesn't grow with the tables."""
    places = places_for(lines, size, BYTES_PER_TASK)
    return lines.repartition(places, "row") if places > places_for(lines, 0) else lines.repartition("row")


def _anchored(lines: DataFrame, size: int = 0) -> DataFrame:
    """One round over the open lines (row, gap, in_source, no, line) of ``size`` bytes: adds anchors (s, t), the new gaps and
    ``live``.

    A gap is named by the Source line that was anchored before it. All steps cluster by ``row``, hence one shuffle.
    """
    same = "PARTITION BY row, gap, line, in_source"
    pairs = (
        _by_row(lines, size)
        .selectExpr("*", f"row_number() OVER ({same} ORDER BY no) AS nth", f"count(*) OVER ({same}) AS times")
        .groupBy("row", "gap", "line", "nth")
        .agg(
            F.expr("max(IF(in_source, no, NULL)) AS s"),
            F.expr("max(IF(in_source, NULL, no)) AS t"),
            F.expr("max(times) = 1 AS alone"),
        )
    )
    chained = (
        pairs.groupBy("row", "gap")
        .agg(F.expr("sort_array(collect_list(struct(s, t, line, alone))) AS pairs"))
        .selectExpr("*", f"{_CANDIDATES} AS candidates")
        .selectExpr("row", "gap", "pairs", f"{_ANCHORS} AS anchors")
        .selectExpr("*", f"{_LEVELS} AS levels")
        .selectExpr("row", "gap", "pairs", f"{_CHAIN} AS chain")
    )
    placed = (
        chained.selectExpr("row", "gap", "size(chain) > 0 AS moved_on", _LINES)
        .groupBy("row", "gap", "moved_on", "in_source", "no")
        .agg(F.max("line").alias("line"), F.max("s").alias("s"), F.max("t").alias("t"))
        .selectExpr(
            "row", "moved_on", "in_source", "no", "line", "s", "t",
            "coalesce(max(s) OVER (PARTITION BY row, gap, in_source ORDER BY no), gap) AS gap",
        )
    )
    both = " AND ".join(
        f"count_if(s IS NULL AND {side}) OVER (PARTITION BY row, gap) > 0" for side in ("in_source", "NOT in_source")
    )
    return placed.selectExpr("*", f"s IS NULL AND moved_on AND {both} AS live").where("s IS NULL OR in_source").drop("moved_on")


def aligned_line_diff(
    plan: ComparePlan,
    text: str,
    changed_only: bool = True,
    one_sided: bool = False,
    hot_rows: int = HOT_GROUP_ROWS,
) -> DataFrame:
    """Lines of both texts side by side and in order: a line that moved is ``only_source`` and ``only_target``.

    Patience alignment. Lines that occur once on each side of a gap (at first the whole text) are candidates, where there are
    none, the n-th occurrence on one side with the n-th on the other; a longest run of candidates in the order of both sides
    becomes anchors, and the gaps between them are aligned in the next round, until no gap has a line in common. Where no line
    repeats, this is a longest common subsequence. ``position`` counts the rows of the display: in each gap first the
    lines of Source, then those of Target.

    Every round is one shuffle by text; a gap is gathered in one row, as the text it comes from was. Rounds are few: only gaps
    that gained an anchor and still have open lines on both sides go on. A missing text marks all lines of the other one, two
    missing texts have no lines, an empty text has one empty line, CRLF counts as LF.
    """
    whole = size = _text_bytes(plan, text)
    places = places_for(plan.source.df, whole, BYTES_PER_TASK)
    places = places if places > places_for(plan.source.df, 0) else None
    found, keys = _text_pairs(plan, text, changed_only, one_sided, hot_rows, places)
    sides = ", ".join(
        f"named_struct('in_source', {flag}, 'lines', {split_lines(side)})"
        for flag, side in (("true", "source_text"), ("false", "target_text"))
    )
    opened = (
        found.selectExpr(f"struct({listing(keys)}) AS row", f"inline(array({sides}))")
        .selectExpr("row", "in_source", "posexplode(lines) AS (no, line)")
        .selectExpr("row", "0 AS gap", "in_source", "no + 1 AS no", "line")
    )
    rounds = []
    while True:
        done = materialize(_anchored(opened, size))
        rounds.append(done.where("NOT live"))
        opened = done.where("live").select("row", "gap", "in_source", "no", "line")
        left, size = opened.agg(F.expr("count(*)"), F.expr(f"coalesce(sum(octet_length(line) + {BYTES_PER_LINE}), 0L)")).first()
        if not left:
            break
    kind = "CASE WHEN s IS NOT NULL THEN 0 WHEN in_source THEN 1 ELSE 2 END"
    return _by_row(reduce(DataFrame.unionByName, rounds), whole).selectExpr(
        "row.*",
        f"row_number() OVER (PARTITION BY row ORDER BY gap, {kind}, no) AS position",
        "IF(in_source, no, NULL) AS source_line_no",
        "IF(in_source, t, no) AS target_line_no",
        "line",
        f"CASE WHEN s IS NOT NULL THEN '{SAME}' WHEN in_source THEN '{ONLY_SOURCE}' ELSE '{ONLY_TARGET}' END AS status",
    )
