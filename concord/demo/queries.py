"""One runnable query per operator, over the given tables and their derived targets."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concord.demo import targets
from concord.functions.columns import col, struct_of, text
from concord.operators import columns as column_ops
from concord.operators import content, lines, multiset, objects, ranges, reassign, summary
from concord.operators.cells import flat_rows
from concord.operators.digest import DigestComparison
from concord.operators.examples import capped_examples
from concord.operators.incremental import incremental_summary
from concord.operators.keyed import CHANGED, MATCHED, ONLY_IN_SOURCE, ONLY_IN_TARGET, REASSIGNED, differing, one_sided
from concord.operators.run import RunComparison, TableComparison, compare_sides, compare_tables
from concord.plans import COERCE, CompareOptions, KeyRange, Side, TableRef
from concord.plans.compare_plan import common_columns
from concord.session import ensure_checkpoint_dir
from concord.sources.metadata import footer_statistics, observed_columns, row_counts
from concord.sources.sinks import discrepancy_rows

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

CHUNKS = 5
# Orders are declared with a primary key; the date is compared as well unless a query is about exclusions.
PRIMARY_KEY = CompareOptions(key_unique=True, key_not_null=True, exclude_by_type=False)
NO_KEY = CompareOptions(exclude_by_type=False)
BY_PART = CompareOptions(
    exclude_by_type=False,
    exclude_columns=(
        "l_orderkey",
        "l_suppkey",
        "l_linenumber",
        "l_quantity",
        "l_extendedprice",
        "l_discount",
        "l_tax",
        "l_shipdate",
    ),
)


def query(function: Query) -> Query:
    """Registers a query under its name; a trailing underscore sets it apart from a function it calls."""
    QUERIES[function.__name__.rstrip("_")] = function
    return function


def _ref(table: str, df: DataFrame, keys: tuple[str, ...] | None = None) -> TableRef:
    return TableRef(table, df, targets.KEYS[table] if keys is None else keys)


def _pair(spark: SparkSession, folder: str, table: str, sql: str | None = None) -> tuple[TableRef, TableRef]:
    source = _ref(table, targets.load(spark, folder, table))
    return source, _ref(table, targets.derive(spark, folder, table, sql or targets.TARGETS[table]))


def orders(spark: SparkSession, folder: str, options: CompareOptions = PRIMARY_KEY, sql: str | None = None) -> TableComparison:
    return compare_tables(*_pair(spark, folder, "orders", sql), options)


def lineitem(spark: SparkSession, folder: str, options: CompareOptions = NO_KEY) -> TableComparison:
    return compare_tables(*_pair(spark, folder, "lineitem"), options)


def documents(spark: SparkSession, folder: str) -> TableComparison:
    options = CompareOptions(key_unique=True, key_not_null=True, large_columns=("text",))
    return compare_tables(*_pair(spark, folder, "documents"), options)


def sides(spark: SparkSession, folder: str) -> tuple[Side, Side]:
    """Five tables: two that differ by key, one that drifted in schema, one without a key, one identical."""
    source, target = [], []
    for table in ("orders", "customer", "lineitem", "part", "supplier"):
        left = _ref(table, targets.load(spark, folder, table))
        right = left
        if table in targets.TARGETS:
            right = _ref(table, targets.derive(spark, folder, table, targets.TARGETS[table]))
        source.append(left)
        target.append(right)
    # Exists in Source only, so it takes part in no comparison.
    source.append(_ref("nation", targets.load(spark, folder, "nation")))
    return Side.of(source), Side.of(target)


def whole_run(spark: SparkSession, folder: str, only: tuple[str, ...] | None = None) -> RunComparison:
    return compare_sides(*sides(spark, folder), default=PRIMARY_KEY, only=only)


# Keyed comparison ---------------------------------------------------------------------------------------------------


def _flat(comparison: TableComparison, rows: DataFrame) -> DataFrame:
    flat = flat_rows(rows, comparison.plan)
    return flat.drop(*[f"target_{pair.name}" for pair in comparison.plan.keys])


def _counts(rows: DataFrame) -> DataFrame:
    return summary.part_counts(rows)


@query
def keyed_diff_rows(spark, folder):
    comparison = orders(spark, folder)
    return _flat(comparison, comparison.rows)


@query
def keyed_diff_counts(spark, folder):
    return _counts(orders(spark, folder).rows)


@query
def only_in_source(spark, folder):
    return one_sided(orders(spark, folder).plan, ONLY_IN_SOURCE)


@query
def only_in_target(spark, folder):
    return one_sided(orders(spark, folder).plan, ONLY_IN_TARGET)


@query
def matched_rows(spark, folder):
    rows = orders(spark, folder).rows.filter(F.col("category") == MATCHED)
    return rows.select("source_key.*", "source.*")


@query
def changed_rows(spark, folder):
    comparison = orders(spark, folder)
    return _flat(comparison, comparison.rows.filter(F.col("category") == CHANGED)).drop("category")


@query
def cell_diff(spark, folder):
    return orders(spark, folder).cells


@query
def keyed_diff_default_exclusions(spark, folder):
    options = CompareOptions(key_unique=True, key_not_null=True)
    comparison = orders(spark, folder, options, targets.ORDERS_REDATED)
    return _flat(comparison, comparison.rows)


@query
def keyed_diff_excluded(spark, folder):
    options = CompareOptions(
        key_unique=True, key_not_null=True, exclude_by_type=False, exclude_columns=("O_TotalPrice", "o_orderdate")
    )
    comparison = orders(spark, folder, options)
    return _flat(comparison, comparison.rows)


@query
def keyed_diff_custom_key(spark, folder):
    options = CompareOptions(match_key=("user_id", "ts"))
    comparison = compare_tables(*_pair(spark, folder, "events"), options)
    return _flat(comparison, comparison.rows)


@query
def keyed_diff_type_policy(spark, folder):
    """Changed rows of a table whose key column kept its type but a value column did not, under both type policies."""
    parts = []
    for policy in ("strict", COERCE):
        options = CompareOptions(key_unique=True, key_not_null=True, type_policy=policy)
        comparison = compare_tables(*_pair(spark, folder, "customer"), options)
        parts.append(_counts(comparison.rows).withColumn("type_policy", F.lit(policy)))
    return parts[0].unionByName(parts[1])


@query
def keyed_diff_range(spark, folder):
    source = targets.load(spark, folder, "orders")
    boundaries = ranges.range_boundaries(source, "o_orderkey", CHUNKS)
    chosen = KeyRange(boundaries[0], boundaries[-1])
    options = CompareOptions(key_unique=True, key_not_null=True, exclude_by_type=False, key_range=chosen)
    comparison = orders(spark, folder, options)
    return _flat(comparison, comparison.rows)


@query
def keyed_diff_large_text(spark, folder):
    comparison = documents(spark, folder)
    return _flat(comparison, comparison.rows)


@query
def keyed_diff_dup_keys(spark, folder):
    options = CompareOptions(match_key=("l_orderkey", "l_linenumber"), exclude_by_type=False)
    comparison = lineitem(spark, folder, options)
    return _flat(comparison, comparison.rows)


@query
def reassigned_rows(spark, folder):
    moved = orders(spark, folder).differences.filter(F.col("category") == REASSIGNED)
    return moved.select(
        F.col("source_key.o_orderkey").alias("source_o_orderkey"),
        F.col("target_key.o_orderkey").alias("target_o_orderkey"),
        "source.*",
    )


@query
def keyed_diff_reconciled(spark, folder):
    comparison = orders(spark, folder)
    return flat_rows(comparison.differences, comparison.plan)


@query
def orphan_content_counts(spark, folder):
    comparison = orders(spark, folder)
    return reassign.orphan_tallies(comparison.rows, comparison.plan)


@query
def reassigned_count(spark, folder):
    comparison = orders(spark, folder)
    return reassign.reassigned_total(reassign.orphan_tallies(comparison.rows, comparison.plan))


@query
def large_content_pairs(spark, folder):
    comparison = documents(spark, folder)
    return content.large_content_pairs(comparison.plan, differing(comparison.rows), "text")


# Multisets ----------------------------------------------------------------------------------------------------------


@query
def row_hash(spark, folder):
    source = targets.load(spark, folder, "lineitem")
    return multiset.row_hashes(source, source.columns).select(*source.columns, "row_hash")


@query
def hash_counts(spark, folder):
    """Contents of the target, in which copied rows occur more than once."""
    target = targets.derive(spark, folder, "lineitem", targets.LINEITEM)
    return multiset.hash_counts(target, target.columns)


@query
def multiset_diff_counts(spark, folder):
    return multiset.multiset_totals(lineitem(spark, folder).plan)


@query
def multiset_diff_rows(spark, folder):
    found = multiset.discrepancies(lineitem(spark, folder).plan)
    return found.select("content.*", "source_count", "target_count", "missing_from_target", "missing_from_source")


@query
def top_discrepancies(spark, folder):
    found = multiset.top_discrepancies(lineitem(spark, folder, BY_PART).plan, 10)
    return found.select("content_hash", "content.*", "source_count", "target_count", "delta")


@query
def hash_samples(spark, folder):
    plan = lineitem(spark, folder, BY_PART).plan
    samples = multiset.sample_rows(plan, multiset.discrepancies(plan))
    return samples.select("content_hash", "source_count", "target_count", "sampled_side", "sample_no", "row.*")


@query
def rows_missing_from_target(spark, folder):
    return multiset.surplus_rows(lineitem(spark, folder).plan, of_source=True)


@query
def rows_missing_from_source(spark, folder):
    return multiset.surplus_rows(lineitem(spark, folder).plan, of_source=False)


@query
def rows_common(spark, folder):
    return multiset.common_rows(lineitem(spark, folder).plan)


# Summaries ----------------------------------------------------------------------------------------------------------


@query
def table_summary(spark, folder):
    return orders(spark, folder).summary


@query
def table_summary_by_digest(spark, folder):
    return orders(spark, folder, replace(PRIMARY_KEY, summary_by_digest=True)).summary


@query
def multiset_summary_by_digest(spark, folder):
    return lineitem(spark, folder, replace(NO_KEY, summary_by_digest=True)).summary


@query
def report_summary(spark, folder):
    return whole_run(spark, folder).report()


@query
def run_rollup(spark, folder):
    return whole_run(spark, folder).rollup()


@query
def recompare_merge(spark, folder):
    """A run whose customer row is replaced after customer was compared again by value."""
    first = whole_run(spark, folder).summary
    again = compare_sides(
        *sides(spark, folder),
        options={"customer": CompareOptions(key_unique=True, key_not_null=True, type_policy=COERCE)},
        only=("customer",),
    ).summary
    return summary.replace_tables(first, again)


@query
def combine_summaries(spark, folder):
    """Counts of five key ranges added up and reconciled once."""
    comparison = orders(spark, folder)
    boundaries = ranges.range_boundaries(comparison.plan.source.df, "o_orderkey", CHUNKS)
    name = F.lit(comparison.table_name).alias("table_name")
    parts = ranges.diff_by_range(comparison.rows, comparison.plan, boundaries).select(name, "*")
    tallies = ranges.tallies_by_range(comparison.rows, comparison.plan, boundaries).select(name, "*")
    return summary.combine_parts(parts, tallies)


@query
def incremental_summary_(spark, folder):
    """The target arrives in two parts; the second run compares only the key ranges of the files added since the first."""
    path, state = (f"{ensure_checkpoint_dir(spark)}/{uuid4().hex}" for _ in range(2))
    target = targets.derive(spark, folder, "orders", targets.ORDERS)
    late = ranges.range_boundaries(target, "o_orderkey", CHUNKS)[-1:]
    arrived = ranges.bucket_of(col("o_orderkey"), late) == 1
    source = _ref("orders", targets.load(spark, folder, "orders"))
    for part in (arrived, ~arrived):
        target.where(part).write.mode("append").parquet(path)
        pair = compare_tables(source, _ref("orders", spark.read.parquet(path)), PRIMARY_KEY)
        run = incremental_summary(pair.plan, state, CHUNKS)
    return run.summary


@query
def changed_column_profile(spark, folder):
    comparison = orders(spark, folder)
    return summary.changed_column_profile(comparison.rows, comparison.plan)


@query
def accepted_summary(spark, folder):
    """Every changed row whose only change is the priority, and every moved row, is accepted."""
    comparison = orders(spark, folder)
    only_priority = "concat_ws(',', changed_columns) = 'o_orderpriority'"
    accepted = comparison.difference_keys(f"category = '{REASSIGNED}' OR {only_priority}")
    return summary.accepted_summary(comparison.difference_keys(), accepted, comparison.summary_of_differences)


@query
def capped_examples_(spark, folder):
    comparison = orders(spark, folder)
    flat = flat_rows(comparison.differences, comparison.plan)
    return capped_examples(flat, ["category"], ["o_orderkey"], 10)


@query
def discrepancy_rows_(spark, folder):
    return discrepancy_rows(orders(spark, folder))


# Ranges -------------------------------------------------------------------------------------------------------------


@query
def range_boundaries(spark, folder):
    source = targets.load(spark, folder, "orders")
    boundaries = ranges.range_boundaries(source, "o_orderkey", CHUNKS)
    return ranges.boundaries_frame(spark, boundaries, source.schema["o_orderkey"].dataType)


@query
def key_ranges(spark, folder):
    source = targets.load(spark, folder, "orders")
    boundaries = ranges.range_boundaries(source, "o_orderkey", CHUNKS)
    return ranges.ranges_frame(spark, "o_orderkey", boundaries, source.schema["o_orderkey"].dataType)


@query
def diff_by_range(spark, folder):
    comparison = orders(spark, folder)
    source = comparison.plan.source.df
    boundaries = ranges.range_boundaries(source, "o_orderkey", CHUNKS)
    counts = ranges.diff_by_range(comparison.rows, comparison.plan, boundaries)
    labels = ranges.ranges_frame(spark, "o_orderkey", boundaries, source.schema["o_orderkey"].dataType)
    return counts.join(F.broadcast(labels.select("bucket", "label")), "bucket")


@query
def composite_range_boundaries(spark, folder):
    """Ranges over three key columns, of which the first has few values."""
    source = targets.load(spark, folder, "lineitem")
    names = ["l_returnflag", "l_shipdate", "l_orderkey"]
    boundaries = ranges.range_boundaries(source, names, CHUNKS)
    key_type = source.select(*names).schema
    return ranges.boundaries_frame(spark, boundaries, key_type).select("boundary_no", "boundary.*")


@query
def diff_by_composite_range(spark, folder):
    """Counts per range of (type, user, time) of events."""
    options = CompareOptions(match_key=("event_type", "user_id", "ts"))
    comparison = compare_tables(*_pair(spark, folder, "events"), options)
    boundaries = ranges.range_boundaries(comparison.plan.source.df, options.match_key, CHUNKS)
    return ranges.diff_by_range(comparison.rows, comparison.plan, boundaries)


@query
def range_boundaries_by_type(spark, folder):
    """Boundaries of text and time keys, exact without a sort."""
    found = []
    for table, name in (("pages", "url"), ("documents", "source"), ("orders", "o_orderdate")):
        source = targets.load(spark, folder, table)
        frame = ranges.boundaries_frame(spark, ranges.range_boundaries(source, name, CHUNKS), source.schema[name].dataType)
        found.append(frame.select(F.lit(name).alias("column_name"), "boundary_no", col("boundary").cast("string").alias("boundary")))
    return found[0].unionByName(found[1]).unionByName(found[2])


@query
def digest_buckets(spark, folder):
    """Which parts of the key space of orders are equal, told by sums of hashes alone."""
    return DigestComparison(orders(spark, folder, sql=targets.ORDERS_LOCAL).plan, targets.DIGEST_BUCKETS).digests


@query
def digest_diff_counts(spark, folder):
    """Orders against themselves but for a stretch of keys: only that stretch is compared row by row."""
    comparison = orders(spark, folder, sql=targets.ORDERS_LOCAL)
    return DigestComparison(comparison.plan, targets.DIGEST_BUCKETS).counts


@query
def digest_diff_rows(spark, folder):
    """Differences by digests where keys are dealt by hash: events by user and time."""
    options = CompareOptions(match_key=("user_id", "ts"))
    comparison = compare_tables(*_pair(spark, folder, "events"), options)
    return _flat(comparison, DigestComparison(comparison.plan, targets.DIGEST_BUCKETS).differences)


@query
def keyed_diff_collated(spark, folder):
    """Customers by name, whose case differs between the sides."""
    options = CompareOptions(match_key=("c_name",), key_unique=True, key_not_null=True, key_collation="UTF8_LCASE")
    comparison = compare_tables(*_pair(spark, folder, "customer", targets.CUSTOMER_NAMES), options)
    return _flat(comparison, comparison.rows)


# Metadata and schema ------------------------------------------------------------------------------------------------


@query
def footer_statistics_(spark, folder):
    """Rows and key bounds of orders and lineitem from file footers alone."""
    key = {"orders": "o_orderkey", "lineitem": "l_orderkey"}
    parts = [
        footer_statistics(spark, f"{folder}/{table}.parquet", [name]).selectExpr(
            f"'{table}' AS table_name", "rows", f"{name}_filled AS filled", f"{name}_min AS lowest", f"{name}_max AS highest"
        ).first()
        for table, name in key.items()
    ]
    return spark.createDataFrame(parts, "table_name string, rows long, filled long, lowest long, highest long")


@query
def row_counts_(spark, folder):
    return row_counts(*sides(spark, folder))


@query
def common_tables(spark, folder):
    """Tables of both sides but for an excluded one, with their sizes."""
    source, target = sides(spark, folder)
    kept = compare_sides(source, target, exclude=("dbo.Part",)).tables
    both = row_counts(
        Side.of(comparison.plan.source for comparison in kept.values()),
        Side.of(comparison.plan.target for comparison in kept.values()),
    )
    return both


@query
def common_columns_(spark, folder):
    """Common columns of a drifted table pair with the number of non-NULL values on each side."""
    source, target = _pair(spark, folder, "customer")
    pairs = common_columns(source, target)

    def filled(df: DataFrame, names: list[str], alias: str) -> DataFrame:
        totals = df.agg(*[F.count(col(name)).alias(f"n{i}") for i, name in enumerate(names)])
        entries = [
            struct_of([("column_no", str(i)), ("column_name", text(pair.name)), (alias, f"n{i}")])
            for i, pair in enumerate(pairs)
        ]
        return totals.selectExpr(f"inline(array({', '.join(entries)}))")

    left = filled(source.df, [pair.name for pair in pairs], "source_filled")
    right = filled(target.df, [pair.target_name for pair in pairs], "target_filled")
    return left.join(right, ["column_no", "column_name"])


@query
def schema_columns(spark, folder):
    source, _ = sides(spark, folder)
    return observed_columns(source.tables.values())


@query
def schema_column_diff(spark, folder):
    source, target = sides(spark, folder)
    return column_ops.column_changes(
        observed_columns(source.tables.values()), observed_columns(target.tables.values())
    )


@query
def ddl_lines(spark, folder):
    source, _ = sides(spark, folder)
    return column_ops.ddl_lines(observed_columns(source.tables.values()))


@query
def ddl_diff(spark, folder):
    source, target = sides(spark, folder)
    return column_ops.ddl_diff(observed_columns(source.tables.values()), observed_columns(target.tables.values()))


def _object_lists(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return tuple(
        targets.derive(spark, folder, "documents", sql) for sql in (targets.OBJECTS_SOURCE, targets.OBJECTS_TARGET)
    )


@query
def object_presence(spark, folder):
    return objects.object_presence(*_object_lists(spark, folder))


@query
def object_classes(spark, folder):
    classes = objects.object_classes(*_object_lists(spark, folder))
    return classes.drop("source_modified_at", "target_modified_at")


@query
def schema_summary(spark, folder):
    """Tables, views and functions compared; procedures were not asked for."""
    kinds = (objects.TABLE, objects.VIEW, objects.FUNCTION)
    source, target = (objects.of_kinds(frame, kinds) for frame in _object_lists(spark, folder))
    return objects.kind_summary(objects.object_classes(source, target), kinds)


@query
def schema_percentages(spark, folder):
    return objects.difference_percentages(objects.object_classes(*_object_lists(spark, folder)))


# Text and content ---------------------------------------------------------------------------------------------------


@query
def text_line_diff(spark, folder):
    return lines.line_diff(documents(spark, folder).plan, "text", one_sided=True)


@query
def text_positional_diff(spark, folder):
    return lines.positional_line_diff(documents(spark, folder).plan, "text", one_sided=True)


@query
def text_aligned_diff(spark, folder):
    options = CompareOptions(key_unique=True, key_not_null=True, large_columns=("text",))
    moved = compare_tables(*_pair(spark, folder, "documents", targets.DOCUMENT_LINES), options)
    return lines.aligned_line_diff(moved.plan, "text", one_sided=True)


def _page_sides(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return tuple(targets.derive(spark, folder, "pages", sql) for sql in (targets.PAGES_SOURCE, targets.PAGES_TARGET))


@query
def content_type_audit(spark, folder):
    return content.content_type_audit(*_page_sides(spark, folder), "body")


@query
def content_label_conflicts(spark, folder):
    return content.content_label_conflicts(*_page_sides(spark, folder), ["page_id"], "is_pdf", "body")
