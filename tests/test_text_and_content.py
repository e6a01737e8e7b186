from __future__ import annotations

import random

import pytest

from concord import CompareOptions, TableRef, compare_tables
from concord.functions.content_type import guess_extension
from concord.operators import content, lines
from concord.operators.keyed import differing


def plan(spark, source, target, schema="id int, text string", **options):
    left, right = (TableRef("t", spark.createDataFrame(rows, schema), ("id",)) for rows in (source, target))
    return compare_tables(left, right, CompareOptions(**options)).plan


def marked(spark, a, b, **kwargs):
    found = lines.line_diff(plan(spark, [(1, a)], [(1, b)]), "text", **kwargs).collect()
    return (
        [row.line for row in sorted(found, key=lambda row: row.source_line_no or 0) if row.status == "only_source"],
        [row.line for row in sorted(found, key=lambda row: row.target_line_no or 0) if row.status == "only_target"],
        len(found),
    )


@pytest.mark.parametrize(
    "a,b,expected",
    [
        ("SELECT 1", "SELECT 1", ([], [], 0)),
        ("a\nb", None, (["a", "b"], [], 2)),
        (None, "a\nb", ([], ["a", "b"], 2)),
        (None, None, ([], [], 0)),
        ("x\nSELECT 1", "x\nSELECT 2", (["SELECT 1"], ["SELECT 2"], 3)),
        ("a", "a\nb", ([], ["b"], 2)),
        ("a\r\nb", "a\nb", ([], [], 2)),
        ("a\nb\nc", "a\n-- new comment\nb\nc", ([], ["-- new comment"], 4)),
        ("a\n-- old comment\nb\nc", "a\nb\nc", (["-- old comment"], [], 4)),
        ("", "a", ([""], ["a"], 2)),
        ("a\n\na", "a\na\na", ([""], ["a"], 4)),
    ],
)
def test_line_diff(spark, a, b, expected):
    assert marked(spark, a, b) == expected


def test_line_diff_of_one_sided_rows_and_equal_texts(spark):
    p = plan(spark, [(1, "a\nb"), (2, "same")], [(2, "same"), (3, "c")])
    assert lines.line_diff(p, "text").count() == 0
    found = lines.line_diff(p, "text", changed_only=False, one_sided=True).collect()
    assert sorted((row.id, row.line, row.status) for row in found) == [
        (1, "a", "only_source"),
        (1, "b", "only_source"),
        (2, "same", "same"),
        (3, "c", "only_target"),
    ]


@pytest.mark.parametrize("hot_rows", [1_000_000, 2])
def test_repeated_keys_do_not_multiply_texts(spark, hot_rows):
    p = plan(spark, [(1, "a"), (1, "b\nc"), (1, "d")], [(1, "a"), (1, "b\nx"), (1, "d")])
    found = lines.line_diff(p, "text", hot_rows=hot_rows).collect()
    assert sorted((row.row_no, row.line, row.status) for row in found) == [
        (2, "b", "same"),
        (2, "c", "only_source"),
        (2, "x", "only_target"),
    ]


def test_positional_line_diff(spark):
    found = lines.positional_line_diff(plan(spark, [(1, "a\nb\nc")], [(1, "a\nnew\nb\nc")]), "text").orderBy("line_no").collect()
    assert [(row.source_line, row.target_line, row.changed) for row in found] == [
        ("a", "a", False),
        ("b", "new", True),
        ("c", "b", True),
        (None, "c", True),
    ]


@pytest.mark.parametrize(
    "value,extension",
    [(b"%PDF-1.7", ".pdf"), (b"PK\x03\x04rest", ".xlsx"), (b"GIF89a", ".bin"), (b"%P", ".bin"), (b"", ".bin"), (None, None)],
)
def test_content_types(spark, value, extension):
    df = spark.createDataFrame([(None if value is None else bytearray(value),)], "c binary")
    assert df.selectExpr(f"{guess_extension('c')} AS e").first().e == extension


def test_content_type_audit_and_conflicts(spark):
    schema = "id int, is_pdf boolean, body binary"
    pdf, other = bytearray(b"%PDF-1"), bytearray(b"abcd")
    source = spark.createDataFrame([(1, True, pdf), (2, True, other), (3, False, other), (4, True, None), (5, True, pdf)], schema)
    target = spark.createDataFrame([(1, True, pdf), (2, True, other), (3, False, other), (4, True, None), (5, True, other), (6, True, other)], schema)
    audit = {(row.side, row.content_type): row.row_count for row in content.content_type_audit(source, target, "body").collect()}
    assert audit[("source", ".pdf")] == 2 and audit[("target", ".bin")] == 4 and audit[("source", None)] == 1
    found = content.content_label_conflicts(source, target, ["id"], "is_pdf", "body").orderBy("id").collect()
    assert [(row.id, row.source_type, row.target_type) for row in found] == [(2, ".bin", ".bin"), (5, ".pdf", ".bin"), (6, None, ".bin")]


@pytest.mark.parametrize("hot_rows", [1_000_000, 1])
def test_large_content_pairs(spark, hot_rows):
    schema = "id int, body binary"
    source = [(1, bytearray(b"same")), (2, bytearray(b"old")), (3, None), (7, bytearray(b"x")), (7, bytearray(b"y"))]
    target = [(1, bytearray(b"same")), (2, bytearray(b"new")), (4, bytearray(b"t")), (7, bytearray(b"x")), (7, bytearray(b"z"))]
    left, right = (TableRef("t", spark.createDataFrame(rows, schema), ("id",)) for rows in (source, target))
    comparison = compare_tables(left, right, hot_rows=hot_rows)
    found = content.large_content_pairs(comparison.plan, differing(comparison.rows), "body", hot_rows).collect()
    # The rows of key 7 pair in the order of their hashes.
    plain = sorted(
        (row.id, row.category, row.source_content and bytes(row.source_content), row.target_content and bytes(row.target_content))
        for row in found
        if row.id != 7
    )
    assert plain == [
        (2, "changed", b"old", b"new"),
        (3, "only_in_source", None, None),
        (4, "only_in_target", None, b"t"),
    ]
    assert all(row.source_content != row.target_content for row in found if row.id == 7)


def common_length(a, b):
    """Length of a longest common subsequence, by the table."""
    row = [0] * (len(b) + 1)
    for x in a:
        before, row = row, [0]
        for j, y in enumerate(b):
            row.append(before[j] + 1 if x == y else max(before[j + 1], row[j]))
    return row[-1]


def alignments(spark, texts, **kwargs):
    rows = [(i, a) for i, (a, _) in enumerate(texts)], [(i, b) for i, (_, b) in enumerate(texts)]
    found = lines.aligned_line_diff(plan(spark, *rows), "text", changed_only=False, **kwargs).collect()
    return [sorted((r for r in found if r.id == i), key=lambda r: r.position) for i in range(len(texts))]


def check_alignment(rows, a, b):
    """Every line once, in order on both sides, and no line in common left between two pairs."""
    assert [r.position for r in rows] == list(range(1, len(rows) + 1))
    for side, text in (("source_line_no", a), ("target_line_no", b)):
        shown = [(getattr(r, side), r.line) for r in rows if getattr(r, side) is not None]
        assert shown == list(enumerate(text, 1))
    gap = {"only_source": set(), "only_target": set()}
    for r in [*rows, None]:
        if r is None or r.status == "same":
            assert not gap["only_source"] & gap["only_target"]
            gap = {"only_source": set(), "only_target": set()}
        else:
            gap[r.status].add(r.line)


def test_aligned_diff_is_a_longest_common_subsequence_of_distinct_lines(spark):
    draw = random.Random(5)
    texts = []
    for _ in range(60):
        a = draw.sample("abcdefghijklmnop", draw.randint(1, 12))
        b = draw.sample("abcdefghijklmnop", draw.randint(1, 12))
        texts.append((a, b))
    for rows, (a, b) in zip(alignments(spark, [("\n".join(a), "\n".join(b)) for a, b in texts]), texts):
        check_alignment(rows, a, b)
        assert sum(r.status == "same" for r in rows) == common_length(a, b)


def test_aligned_diff_of_repeated_lines_is_in_order_and_leaves_nothing_in_common(spark):
    draw = random.Random(6)
    texts = [tuple([draw.choice("abcd ") for _ in range(draw.randint(1, 14))] for _ in "ab") for _ in range(60)]
    for rows, (a, b) in zip(alignments(spark, [("\n".join(a), "\n".join(b)) for a, b in texts]), texts):
        check_alignment(rows, a, b)
        assert sum(r.status == "same" for r in rows) <= common_length(a, b)


def test_aligned_diff_shows_a_moved_line_twice_and_takes_empty_and_long_texts(spark):
    long = [f"line {i}" for i in range(3000)]
    moved = long[1500:] + long[:1500]
    found = alignments(
        spark,
        [("a\nb\nc", "b\nc\na"), ("", "a"), (None, "a"), ("a\r\nb", None), (None, None), ("\n\n", "\n"),
         ("\n".join(long), "\n".join(moved))],
    )
    shown = [[(r.source_line_no, r.target_line_no, r.line, r.status) for r in rows] for rows in found[:6]]
    assert shown == [
        [(1, None, "a", "only_source"), (2, 1, "b", "same"), (3, 2, "c", "same"), (None, 3, "a", "only_target")],
        [(1, None, "", "only_source"), (None, 1, "a", "only_target")],
        [(None, 1, "a", "only_target")],
        [(1, None, "a", "only_source"), (2, None, "b", "only_source")],
        [],
        [(1, 1, "", "same"), (2, 2, "", "same"), (3, None, "", "only_source")],
    ]
    check_alignment(found[6], long, moved)
    assert sum(r.status == "same" for r in found[6]) == 1500


def test_aligned_diff_of_an_empty_table(spark):
    assert lines.aligned_line_diff(plan(spark, [], []), "text").collect() == []


def test_a_round_of_alignment_shuffles_once(spark):
    rows = spark.createDataFrame([(1, 0, True, 1, "a")], "id int, gap int, in_source boolean, no int, line string")
    opened = rows.selectExpr("struct(id) AS row", "gap", "in_source", "no", "line")
    executed = lines._anchored(opened)._jdf.queryExecution().executedPlan().toString()
    assert executed.count("Exchange") == 1


def test_aligned_diff_takes_more_tasks_for_more_text(spark, monkeypatch):
    texts = [(f"a{i}\nb\nc\nd{i}", f"c\na{i}\nb\nx\nd{i}") for i in range(60)]
    before = alignments(spark, texts)
    monkeypatch.setattr(lines, "BYTES_PER_TASK", 256)
    assert alignments(spark, texts) == before
    p = plan(spark, *([(i, pair[side]) for i, pair in enumerate(texts)] for side in (0, 1)))
    size = sum(len(text) + 64 * (text.count("\n") + 1) for pair in texts for text in pair)
    assert lines._text_bytes(p, "text") == size
    executed = lines.aligned_line_diff(p, "text", changed_only=False)._jdf.queryExecution().executedPlan().toString()
    assert f", {-(-size // 256)}), REPARTITION_BY_NUM" in executed
