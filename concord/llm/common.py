"""What the operators of this package share: tables, words, and results written once to the shared folder."""

from __future__ import annotations

import ctypes
import math
from collections.abc import Iterator
from contextlib import contextmanager
from uuid import uuid4

import pyarrow as pa

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from concord.session import ensure_checkpoint_dir

#: A word is a run of anything but ASCII white space, which is also how ``bytes.split`` without arguments cuts.
WORD = r"[^\x20\x09-\x0D]+"
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession) -> str:
    """A new folder name below the folder that driver and executors share."""
    return f"{ensure_checkpoint_dir(spark)}/{uuid4().hex}"


def local_path(path: str) -> str:
    """The shared folder as a mounted path, for files that executors open themselves.

    Raises for a store that is not mounted: such files can't be mapped into memory there.
    """
    if path.startswith("file:"):
        return "/" + path[len("file:") :].lstrip("/")
    if "://" in path:
        raise ValueError(f"{path} has to be a mounted folder (file: or a plain path)")
    return path


def written(df: DataFrame) -> DataFrame:
    """``df`` evaluated once into Parquet in the shared folder: readers share it, and a lost executor loses none of it."""
    return written_at(df)[0]


def written_at(df: DataFrame) -> tuple[DataFrame, str]:
    """As ``written``, with the folder, for tables that are removed once their last reader is done."""
    path = shared_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def remove(spark: SparkSession, *paths: str) -> None:
    """Deletes folders of the shared store whose tables no one reads any more."""
    for path in paths:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Jobs run inside hand their rows to Python in batches of at most ``rows``, for long texts in little memory."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = int(spark.conf.get(name))
    spark.conf.set(name, str(min(rows, before) if before > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, str(before))


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a job run inside go when it ends, not when the driver happens to collect its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def trim() -> None:
    """Gives the memory that this worker has freed back to the system; elsewhere than on Linux only Arrow's."""
    pa.default_memory_pool().release_unused()
    give_back = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if give_back:
        give_back(0)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def groups_for(spark: SparkSession, rows: int, rows_each: int) -> int:
    """Number of groups of about ``rows_each`` rows, but never fewer than the tasks of a shuffle."""
    return max(1, math.ceil(rows / rows_each), min(shuffle_partitions(spark), math.ceil(rows / 64)))


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id written as text, modulo ``folds``; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def text_bytes(text: Column) -> Column:
    """UTF-8 bytes of a text, none for null."""
    return F.coalesce(text, F.lit("")).cast("binary")
