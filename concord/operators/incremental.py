"""Runs that compare again only the key ranges whose files changed since the last run.

A run leaves three tables: the counts of each key range by category and orphan content, the manifest (which file, in which
version, holds rows of which range) and the bounds of the ranges. The next run takes the files of both sides from the hidden
``_metadata`` column, without reading a column of data. Ranges of files that are new, gone or rewritten are compared again, with
their bounds pushed down to both scans; the counts of all others are taken over, and moved rows are reconciled over all of them.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from concord.functions.columns import col
from concord.operators.keyed import (
    IS_ORPHAN,
    ONLY_IN_SOURCE,
    ONLY_IN_TARGET,
    ORPHANS,
    SOURCE,
    TARGET,
    in_range,
    keyed_rows,
    orphan_content,
    side_name,
)
from concord.operators.ordinals import HOT_GROUP_ROWS
from concord.operators.ranges import boundaries_frame, bucket_of, key_ranges, range_boundaries, with_bucket
from concord.operators.summary import PART_COLUMNS, combine_parts
from concord.plans.compare_plan import ComparePlan, KeyRange

VERSION = ("side", "file", "size", "modified")
#: Changed files that are named to a scan one by one; beyond that all ranges are compared.
FILES_BY_NAME = 10_000


@dataclass(frozen=True)
class IncrementalRun:
    """The summary of the whole table, and the numbers of the key ranges that this run compared, of ``ranges``."""

    summary: DataFrame
    compared: tuple[int, ...]
    ranges: int


def _files(plan: ComparePlan, side: str) -> DataFrame:
    df = (plan.source if side == SOURCE else plan.target).df
    return df.select(
        F.lit(side).alias("side"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_size").alias("size"),
        F.col("_metadata.file_modification_time").alias("modified"),
        bucket_key(plan, side).alias("key"),
    )


def bucket_key(plan: ComparePlan, side: str) -> Column:
    return col(side_name(plan.keys[0], side))


def _current(plan: ComparePlan) -> DataFrame:
    """The files of both sides that hold rows; only their footers are read."""
    return reduce(DataFrame.unionByName, [_files(plan, side).select(*VERSION).distinct() for side in (SOURCE, TARGET)])


def _manifest(plan: ComparePlan, boundaries: list, fresh: dict[str, list[str]] | None = None) -> DataFrame:
    """Which file holds rows of which range: of all files, or of those named, the only ones then read."""
    parts = []
    for side in (SOURCE, TARGET):
        files = _files(plan, side)
        if fresh is not None:
            files = files.where(F.col("file").isin(fresh[side]) if fresh[side] else F.lit(False))
        parts.append(files.select(*VERSION, bucket_of(F.col("key"), boundaries).alias("bucket")).distinct())
    return reduce(DataFrame.unionByName, parts)


def merged_ranges(boundaries: list, wanted: set[int]) -> list[KeyRange]:
    """The wanted ranges by number, neighbours as one."""
    found: list[KeyRange] = []
    for number, one in enumerate(key_ranges(boundaries), start=1):
        if number in wanted:
            joins = number - 1 in wanted
            found.append(KeyRange(found.pop().lower, one.upper) if joins else one)
    return found


def _within(plan: ComparePlan, boundaries: list, wanted: set[int]) -> ComparePlan:
    chosen = merged_ranges(boundaries, wanted)

    def cut(df: DataFrame, side: str) -> DataFrame:
        tests = [in_range([bucket_key(plan, side)], one) for one in chosen]
        if any(test is None for test in tests):
            return df
        return df.where(reduce(Column.__or__, tests))

    source = replace(plan.source, df=cut(plan.source.df, SOURCE))
    return replace(plan, source=source, target=replace(plan.target, df=cut(plan.target.df, TARGET)))


def _counts(plan: ComparePlan, boundaries: list, hot_rows: int) -> DataFrame:
    """Rows by range, category and, for orphans, content: one pass gives the counts and the tallies of the parts."""
    rows = with_bucket(keyed_rows(plan, hot_rows), plan, boundaries)
    return (
        rows.selectExpr("bucket", "category", f"{orphan_content(plan)} AS content_hash")
        .groupBy("bucket", "category", "content_hash")
        .agg(F.count("*").alias("n"))
    )


def _combined(counts: DataFrame, plan: ComparePlan) -> DataFrame:
    tests = (
        f"category <> '{ONLY_IN_TARGET}'", f"category <> '{ONLY_IN_SOURCE}'",
        *(f"category = '{name}'" for name in PART_COLUMNS[2:]),
    )
    sums = [F.expr(f"sum(IF({test}, n, 0L))").alias(name) for test, name in zip(tests, PART_COLUMNS)]
    name = F.lit(plan.table_name).alias("table_name")
    zeros = plan.source.df.sparkSession.range(1).selectExpr(*[f"0L AS {column}" for column in PART_COLUMNS])
    parts = counts.groupBy("bucket").agg(*sums).drop("bucket").unionByName(zeros).select(name, "*")
    orphans = [F.expr(f"sum(IF(category = '{side}', n, 0L))").alias(side) for side in ORPHANS]
    tallies = counts.where(IS_ORPHAN).groupBy("content_hash").agg(*orphans).select(name, "*")
    return combine_parts(parts, tallies)


def _last_version(spark: SparkSession, state: str) -> int | None:
    """The last run that was stored as a whole."""
    jvm = spark._jvm.org.apache.hadoop.fs
    folder = jvm.Path(state)
    store = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(folder):
        return None
    names = [entry.getPath().getName() for entry in store.listStatus(folder)]
    whole = [int(name) for name in names if name.isdigit() and store.exists(jvm.Path(f"{state}/{name}/plan/_SUCCESS"))]
    return max(whole, default=None)


def incremental_summary(
    plan: ComparePlan, state: str, ranges: int = 256, hot_rows: int = HOT_GROUP_ROWS
) -> IncrementalRun:
    """The summary of a keyed table from the stored counts of the last run and the ranges whose files changed.

    ``state`` is a folder of the shared store for this pair of tables. Both sides have to be files read by Spark, with a leading
    key of one type. The first run, another plan (columns, key, options) and more than 10,000 changed files compare everything. A run
    that breaks off leaves the state of the run before. ``ranges`` is only looked at when everything is compared; a file whose size and
    modification time are as before counts as unchanged.
    """
    if not plan.usable_key or not plan.keys[0].same_type:
        raise ValueError(f"{plan.table_name} needs a leading key of the same type on both sides")
    if plan.options.key_collation:
        raise ValueError("key ranges are cut by plain order, under which equal keys of a collation may lie apart")
    spark = plan.source.df.sparkSession
    signature = repr((plan.table_name, plan.keys, plan.values, plan.options))
    last = _last_version(spark, state)
    old = f"{state}/{last:08d}" if last is not None else None
    if old and spark.read.parquet(f"{old}/plan").first()["signature"] != signature:
        old = None
    new = f"{state}/{(last or 0) + 1:08d}"
    fresh = None
    if old:
        kept = spark.read.parquet(f"{old}/manifest")
        current = _current(plan).cache()
        listed = current.join(kept, list(VERSION), "left_anti").select("side", "file").take(FILES_BY_NAME + 1)
        if len(listed) <= FILES_BY_NAME:
            fresh = {side: [row["file"] for row in listed if row["side"] == side] for side in (SOURCE, TARGET)}
    if fresh is None:
        boundaries = range_boundaries(plan.source.df, plan.keys[0].name, ranges)
        affected = set(range(1, len(boundaries) + 2))
        manifest = _manifest(plan, boundaries)
        counts = _counts(plan, boundaries, hot_rows)
    else:
        bounds = spark.read.parquet(f"{old}/bounds")
        boundaries = [row["boundary"] for row in bounds.orderBy("boundary_no").collect()]
        added = _manifest(plan, boundaries, fresh)
        gone = kept.join(current, list(VERSION), "left_anti")
        # At most as many rows as there are ranges.
        affected = {row["bucket"] for row in gone.select("bucket").union(added.select("bucket")).distinct().collect()}
        manifest = kept.join(current, list(VERSION), "left_semi").unionByName(added)
        stored = spark.read.parquet(f"{old}/counts")
        counts = stored
        if affected:
            again = _counts(_within(plan, boundaries, affected), boundaries, hot_rows)
            counts = stored.where(~F.col("bucket").isin(sorted(affected))).unionByName(again)
    manifest.write.mode("overwrite").parquet(f"{new}/manifest")
    counts.write.mode("overwrite").parquet(f"{new}/counts")
    key_type = plan.source.df.schema[plan.keys[0].name].dataType
    boundaries_frame(spark, boundaries, key_type).write.mode("overwrite").parquet(f"{new}/bounds")
    # Written last: a version counts from here on.
    spark.createDataFrame([(signature,)], "signature string").write.mode("overwrite").parquet(f"{new}/plan")
    if old:
        current.unpersist()
    summary = _combined(spark.read.parquet(f"{new}/counts"), plan)
    return IncrementalRun(summary, tuple(sorted(affected)), len(boundaries) + 1)
