"""Session settings and lineage-cutting shared by all operators."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from threading import Lock
from typing import TypeVar
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_CHECKPOINT_LOCK = Lock()

Item = TypeVar("Item")
Result = TypeVar("Result")


def build_session(app_name: str = "concord", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators were tuned for.

    Adaptive execution merges small shuffle partitions and splits skewed join partitions. Rows numbered inside their key
    may join on (key, number) where they are, without a second shuffle. UTC keeps timestamp text the same on every
    machine. Values in ``conf`` (dots written as ``__``) win over these.
    """
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.requireAllClusterKeysForCoPartition": "false",
        "spark.sql.session.timeZone": "UTC",
        "spark.checkpoint.compress": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        "spark.python.sql.dataFrameDebugging.enabled": "false",
    }
    settings.update({name.replace("__", "."): value for name, value in conf.items()})
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for name, value in settings.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The checkpoint folder of the session; on a cluster it has to be a shared folder named by ``spark.checkpoint.dir``.

    Only a local session gets a temporary folder of its own: executors of a cluster could not read it.
    """
    context = spark.sparkContext
    with _CHECKPOINT_LOCK:
        if not context.getCheckpointDir():
            folder = spark.conf.get("spark.checkpoint.dir", None)
            if folder is None:
                if not context.master.startswith("local"):
                    raise ValueError("set spark.checkpoint.dir to a folder that all executors can read")
                folder = tempfile.mkdtemp(prefix="concord-checkpoint-")
            context.setCheckpointDir(folder)
        return context.getCheckpointDir()


def _storable(data_type: T.DataType) -> bool:
    """Whether Parquet holds values of this type."""
    if isinstance(data_type, T.ArrayType):
        return _storable(data_type.elementType)
    if isinstance(data_type, T.MapType):
        return _storable(data_type.keyType) and _storable(data_type.valueType)
    if isinstance(data_type, T.StructType):
        return len(data_type) > 0 and all(_storable(field.dataType) for field in data_type)
    return not isinstance(data_type, (T.NullType, T.CalendarIntervalType))


def materialized(df: DataFrame) -> tuple[DataFrame, str | None]:
    """``df`` written once to the checkpoint folder, for several readers, and the folder to discard behind the last one.

    It is a Parquet table, of which a reader takes only the columns it needs; a frame with types that Parquet lacks becomes a
    checkpoint, which Spark cleans itself.
    """
    folder = ensure_checkpoint_dir(df.sparkSession)
    if not _storable(df.schema):
        return df.checkpoint(eager=True), None
    path = f"{folder}/{uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def materialize(df: DataFrame) -> DataFrame:
    """As :func:`materialized`, for tables that stay as long as the checkpoint folder."""
    return materialized(df)[0]


def discard(spark: SparkSession, path: str | None) -> None:
    """Deletes a folder of :func:`materialized` that no frame reads any more."""
    if path:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def side_by_side(work: Callable[[Item], Result], items: Iterable[Item], at_most: int = 8) -> list[Result]:
    """Runs ``work`` for several tables at once, so that small tables share the cluster; results keep the order."""
    with ThreadPoolExecutor(max_workers=at_most) as pool:
        return list(pool.map(work, items))
