"""K-means over vectors of 64 components by bit planes.

Components become integers, ``floor(scale * x)``. Bit ``b`` of all 64 components of a vector is one unsigned 64-bit number,
its plane ``b``; in two's complement plane ``b`` weighs ``2**b`` and the last one ``-2**b``. The dot product of two vectors is
then the sum over pairs of planes of both weights times the number of components in which both bits are set, a popcount of
an AND. Squared distances come from dot products. Everything is whole-number arithmetic, so results are exact and the same
whatever the order of rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from concord.llm.common import written

WIDTH = 64
#: A squared distance of 64 components has to fit into a signed 64-bit number.
MOST_PLANES = 28
#: Vectors compared at once: bounds the memory of a task whatever the size of an Arrow batch.
VECTORS_AT_ONCE = 8192
ASSIGNED = "vec_id long, cluster int, distance long"
MOVED = "cluster int, component int, total long, vectors long"


def pack_planes(vectors: np.ndarray, planes: int) -> np.ndarray:
    """Bit planes (n, planes) of whole numbers (n, 64); component ``i`` is bit ``i``."""
    bits = (vectors[:, None, :] >> np.arange(planes)[None, :, None]) & 1
    return np.packbits(bits.astype(np.uint8), axis=2, bitorder="little").view("<u8")[:, :, 0]


def unpack_planes(planes: np.ndarray) -> np.ndarray:
    """The whole numbers (n, 64) again."""
    n, count = planes.shape
    bits = np.unpackbits(np.ascontiguousarray(planes).view(np.uint8).reshape(n, count, 8), axis=2, bitorder="little")
    return np.einsum("b,nbi->ni", plane_weights(count), bits.astype(np.int64))


def plane_weights(planes: int) -> np.ndarray:
    weights = np.int64(1) << np.arange(planes, dtype=np.int64)
    weights[-1] = -weights[-1]
    return weights


def dot_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact dot products (n, k) of vectors given as planes (n, p) and (k, p)."""
    weights = plane_weights(a.shape[1])
    dots = np.zeros((len(a), len(b)), dtype=np.int64)
    for i, weight in enumerate(weights):
        for j, other in enumerate(weights):
            dots += weight * other * np.bitwise_count(a[:, i, None] & b[None, :, j]).astype(np.int64)
    return dots


def squared_norms(planes: np.ndarray) -> np.ndarray:
    """Dot product of every vector with itself; planes ``i < j`` count twice."""
    weights = plane_weights(planes.shape[1])
    norms = np.zeros(len(planes), dtype=np.int64)
    for i, weight in enumerate(weights):
        norms += weight * weight * np.bitwise_count(planes[:, i]).astype(np.int64)
        for j in range(i + 1, len(weights)):
            norms += 2 * weight * weights[j] * np.bitwise_count(planes[:, i] & planes[:, j]).astype(np.int64)
    return norms


def nearest(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroid (the smaller number of several) and squared distance of every vector, all given as planes."""
    partial = squared_norms(centroids)[None, :] - 2 * dot_products(vectors, centroids)
    cluster = partial.argmin(axis=1)
    return cluster, partial[np.arange(len(vectors)), cluster] + squared_norms(vectors)


def quantized(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(vec_id, x): vectors of exactly 64 finite components as whole numbers. A component beyond 64 bits raises."""
    usable = f"size(v) = {WIDTH} AND forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity'))"
    whole = f"transform(v, x -> CAST(floor(CAST({scale} AS DOUBLE) * x) AS BIGINT))"
    plain = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    return plain.where(f"v IS NOT NULL AND {usable}").selectExpr("vec_id", f"{whole} AS x")


def planes_for(low: int, high: int) -> int:
    """Planes that hold all numbers from ``low`` to ``high`` in two's complement."""
    planes = 1 + max(high.bit_length(), (-low - 1).bit_length() if low < 0 else 0)
    if planes > MOST_PLANES:
        raise OverflowError(f"components from {low} to {high} make squared distances beyond 64 bits")
    return planes


def _packed(whole: DataFrame, planes: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, VECTORS_AT_ONCE):
                part = batch.slice(at, VECTORS_AT_ONCE)
                x = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, WIDTH)
                raw = np.ascontiguousarray(pack_planes(x, planes)).tobytes()
                size = 8 * planes
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([raw[i : i + size] for i in range(0, len(raw), size)], pa.binary())],
                    names=["vec_id", "planes"],
                )

    return whole.select("vec_id", "x").mapInArrow(run, "vec_id long, planes binary")


def _chunks(batches: Iterator[pa.RecordBatch], planes: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, VECTORS_AT_ONCE):
            part = batch.slice(at, VECTORS_AT_ONCE)
            raw = b"".join(part.column(1).to_pylist())
            yield part.column(0), np.frombuffer(raw, dtype="<u8").reshape(-1, planes)


def _moved(packed: DataFrame, centroids: np.ndarray, planes: int) -> DataFrame:
    """Component sums and sizes of the clusters, one row per task, cluster and component."""
    centers = pack_planes(centroids, planes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(centers)
        totals, sizes = np.zeros((k, WIDTH), dtype=np.int64), np.zeros(k, dtype=np.int64)
        for _, vectors in _chunks(batches, planes):
            cluster, _ = nearest(vectors, centers)
            order = np.argsort(cluster, kind="stable")
            found, first, counts = np.unique(cluster[order], return_index=True, return_counts=True)
            totals[found] += np.add.reduceat(unpack_planes(vectors[order]), first, axis=0)
            sizes[found] += counts
        some = np.flatnonzero(sizes)
        if len(some):
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat(some, WIDTH), pa.int32()),
                    pa.array(np.tile(np.arange(WIDTH), len(some)), pa.int32()),
                    pa.array(totals[some].ravel(), pa.int64()),
                    pa.array(np.repeat(sizes[some], WIDTH), pa.int64()),
                ],
                names=["cluster", "component", "total", "vectors"],
            )

    return packed.mapInArrow(run, MOVED)


def _assigned(packed: DataFrame, centroids: np.ndarray, planes: int) -> DataFrame:
    centers = pack_planes(centroids, planes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, vectors in _chunks(batches, planes):
            cluster, distance = nearest(vectors, centers)
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(cluster, pa.int32()), pa.array(distance, pa.int64())],
                names=["vec_id", "cluster", "distance"],
            )

    return packed.mapInArrow(run, ASSIGNED)


def first_centroids(whole: DataFrame, k: int, seed: int) -> np.ndarray:
    """The ``k`` vectors with the smallest sha256 of ``seed:vec_id``; a null id counts as empty text, ties go to the smaller
    components."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    rows = whole.orderBy(key, "x").limit(k).collect()
    return np.array([row["x"] for row in rows], dtype=np.int64).reshape(-1, WIDTH)


def moved_centroids(packed: DataFrame, centroids: np.ndarray, planes: int) -> np.ndarray:
    """Centroids after one round: floor of the mean of each cluster, empty clusters unchanged."""
    sums = _moved(packed, centroids, planes).groupBy("cluster", "component").agg(
        F.sum("total").alias("total"), F.sum("vectors").alias("vectors")
    )
    after = centroids.copy()
    for row in sums.collect():  # at most k * 64 rows
        after[row["cluster"], row["component"]] = row["total"] // row["vectors"]
    return after


def cluster(
    vectors: DataFrame,
    k: int = 40,
    rounds: int = 5,
    scale: int = 256,
    seed: int = 2,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """Clusters of all vectors with exactly 64 finite components: vec_id, cluster, distance, cluster_inertia, inertia and
    centroid_sha256.

    Vectors are packed into planes once and written; each round reads the planes, and only sums of clusters leave a task.
    The driver holds the ``k`` centroids. Other vectors (null, shorter, longer, with null, NaN or infinite components) take no
    part; repeated rows and null ids are vectors like any other; with fewer vectors than ``k`` there are fewer centroids; an
    empty table gives no rows; other columns are not looked at. Components are limited to 27 bits and a sign, because
    squared distances have to fit into 64 bits: greater ones raise ``OverflowError``.
    """
    if k < 1:
        raise ValueError("k has to be at least 1")
    spark = vectors.sparkSession
    whole = quantized(vectors, id_col, vector_col, scale)
    low, high = whole.agg(F.min(F.array_min("x")), F.max(F.array_max("x"))).first()
    if low is None:
        return spark.createDataFrame([], f"{ASSIGNED}, cluster_inertia long, inertia long, centroid_sha256 string")
    planes = planes_for(low, high)
    centroids = first_centroids(whole, k, seed)
    packed = written(_packed(whole, planes))
    for _ in range(rounds):
        centroids = moved_centroids(packed, centroids, planes)
    found = written(_assigned(packed, centroids, planes))
    return found.join(F.broadcast(_described(spark, found, centroids)), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )


def _described(spark: SparkSession, found: DataFrame, centroids: np.ndarray) -> DataFrame:
    """One row per cluster that has vectors: its inertia, that of all, and the checksum of its centroid."""
    schema = T.StructType(
        [
            T.StructField("cluster", T.IntegerType()),
            T.StructField("cluster_inertia", T.LongType()),
            T.StructField("inertia", T.LongType()),
            T.StructField("centroid_sha256", T.StringType()),
        ]
    )
    sums = {row["cluster"]: row["total"] for row in found.groupBy("cluster").agg(F.sum("distance").alias("total")).collect()}
    names = [hashlib.sha256(",".join(map(str, row)).encode()).hexdigest() for row in centroids.tolist()]
    inertia = sum(sums.values())
    return spark.createDataFrame([(c, total, inertia, names[c]) for c, total in sums.items()], schema)
