"""Exact top-k inner products by pivot-table elimination.

Vectors are lifted so that a larger inner product is a smaller distance: with M the largest norm, x becomes
(x, sqrt(M^2 - |x|^2)) and a query q becomes (q, 0), and |q - x|^2 = |q|^2 + M^2 - 2 q.x. Distances from every vector to the
pivots are computed once; the triangle inequality then bounds each query's distance to a block, and to each vector in it,
from below by the largest difference over all pivots. Vectors are evaluated in the order of their bounds until no bound
can beat the k-th score found.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concord.llm.common import written

#: Relative slack on squared distances, far above the rounding of double arithmetic.
SLACK = 1e-9
#: Stands for a null id, which sorts last.
NO_ID = np.iinfo(np.int64).max
VECTORS = "row long, vec_id long, dim int, v array<double>, table array<double>, norm double"


def lift(v: np.ndarray, top: float) -> np.ndarray:
    return np.concatenate((v, np.sqrt(np.maximum(top - (v * v).sum(axis=1), 0))[:, None]), axis=1)


def distances(lifted: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    square = (lifted * lifted).sum(axis=1)[:, None] + (pivots * pivots).sum(axis=1) - 2 * (lifted @ pivots.T)
    return np.sqrt(np.maximum(square, 0))


def spread_pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """Farthest-first choice of up to ``count`` different rows."""
    chosen = [0]
    far = distances(sample, sample[:1])[:, 0]
    while len(chosen) < min(count, len(sample)) and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, distances(sample, sample[chosen[-1:]])[:, 0])
    return sample[chosen]


def _matrix(column: pa.ChunkedArray | pa.Array, rows: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)


def search_block(
    ids: np.ndarray, rows: np.ndarray, vectors: np.ndarray, table: np.ndarray, query: np.ndarray, own: int,
    query_table: np.ndarray, least: float, top: float, k: int,
) -> tuple[np.ndarray, np.ndarray]:
    """Places and scores of the query's best ``k`` vectors of a block with a score of at least ``least``.

    ``table`` is (pivots, vectors). Ties go to the smaller id, then to the earlier row.
    """
    whole = float(query @ query) + top
    bound = np.abs(table[0] - query_table[0])
    for j in range(1, len(table)):
        np.maximum(bound, np.abs(table[j] - query_table[j]), out=bound)
    best = (whole - bound * bound) / 2 + SLACK * (whole + 1)
    at = np.flatnonzero((best >= least) & (rows != own))
    at = at[np.argsort(-best[at], kind="stable")]
    kept, scores = np.empty(0, dtype=np.int64), np.empty(0)
    for start in range(0, len(at), 256):
        part = at[start : start + 256]
        if len(kept) == k and best[part[0]] < scores[-1]:
            break
        found = vectors[part] @ query
        good = found >= (max(least, scores[-1]) if len(kept) == k else least)
        kept, scores = np.concatenate((kept, part[good])), np.concatenate((scores, found[good]))
        order = np.lexsort((rows[kept], ids[kept], -scores))[:k]
        kept, scores = kept[order], scores[order]
    return kept, scores


def _search(batches: Iterator[pa.RecordBatch], top: float, k: int) -> Iterator[pa.RecordBatch]:
    """Of each block first its vectors come, then queries; only the vectors of one block are held."""
    block, parts, ready = None, [], None
    for batch in batches:
        blocks, kinds = batch.column("block").to_numpy(), batch.column("kind").to_numpy()
        cuts = np.flatnonzero((np.diff(blocks) != 0) | (np.diff(kinds) != 0)) + 1
        out: list[tuple] = []
        for start, end in zip([0, *cuts], [*cuts, len(blocks)]):
            if start == end:
                continue
            piece = pa.Table.from_batches([batch.slice(start, end - start)])
            if blocks[start] != block:
                block, parts, ready = blocks[start], [], None
            if kinds[start] == 0:
                parts.append(piece)
                continue
            if not parts:
                continue
            if ready is None:
                whole = pa.concat_tables(parts).combine_chunks()
                n = whole.num_rows
                ids = whole.column("vec_id").combine_chunks().fill_null(NO_ID).to_numpy()
                table = np.ascontiguousarray(_matrix(whole.column("table"), n).T)
                ready = ids, whole.column("row").to_numpy(), _matrix(whole.column("v"), n), table
            n = piece.num_rows
            queries, tables = _matrix(piece.column("v"), n), _matrix(piece.column("table"), n)
            for i, (row, name, least) in enumerate(
                zip(*(piece.column(c).to_pylist() for c in ("row", "vec_id", "least")))
            ):
                least = -np.inf if least is None else least
                kept, scores = search_block(*ready, queries[i], row, tables[i], least, top, k)
                out += [(row, name, int(ready[0][j]), int(ready[1][j]), int(s)) for j, s in zip(kept, scores)]
        columns = list(zip(*out)) if out else [[]] * 5
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, pa.int64()) for c in columns], names=["query_row", "query_id", "vec_id", "row", "score"]
        )


def top_k(
    vectors: DataFrame,
    query_step: int = 20,
    k: int = 20,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    scale: int = 64,
    pivots: int = 32,
    sample_rows: int = 4096,
    block_rows: int = 16_384,
) -> DataFrame:
    """query_id, rank, vec_id and score of each query's ``k`` largest integer inner products; ties go to the smaller id.

    Components are floor(scale * x). Queries are the rows whose id is divisible by ``query_step``; every other row is a
    candidate, rows that repeat the query's vector or id too. Null vectors, and vectors with null or non-finite
    components, or without any, take no part; vectors meet only vectors of their own length; a null id sorts last; other
    columns are not looked at; an empty table gives no rows. Raises when a score may exceed 2^53, where doubles stop
    being exact. Pivots are chosen from at most ``sample_rows`` rows: they decide how much is skipped, never the result.
    """
    spark = vectors.sparkSession
    value = F.col(vector_col)
    usable = value.isNotNull() & (F.size(value) > 0) & F.forall(
        value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf"))
    )
    ints = F.transform(value, lambda x: F.floor(x.cast("double") * scale).cast("double"))
    base = vectors.where(F.coalesce(usable, F.lit(False))).select(
        F.monotonically_increasing_id().alias("row"),
        F.col(id_col).cast("long").alias("vec_id"),
        F.size(value).alias("dim"),
        ints.alias("v"),
    )
    base = base.withColumn("norm", F.aggregate("v", F.lit(0.0), lambda acc, x: acc + x * x))
    base = written(base)
    empty = "query_id long, rank int, vec_id long, score long"
    sizes = {r["dim"]: (r["n"], r["top"]) for r in base.groupBy("dim").agg(
        F.count("*").alias("n"), F.max("norm").alias("top")).collect()}
    results = [
        _one_length(base.where(F.col("dim") == dim), n, top, query_step, k, pivots, sample_rows, block_rows)
        for dim, (n, top) in sorted(sizes.items())
    ]
    if not results:
        return spark.createDataFrame([], empty)
    found = results[0]
    for more in results[1:]:
        found = found.unionByName(more)
    rank = F.expr("row_number() over (partition by query_row order by score desc, vec_id asc nulls last, row)")
    last = F.when(F.col("vec_id") == int(NO_ID), None).otherwise(F.col("vec_id"))
    ranked = found.withColumn("rank", rank).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int"), last.alias("vec_id"), "score")


def _one_length(base, n, top, query_step, k, pivots, sample_rows, block_rows) -> DataFrame:
    if top >= 2.0**52:
        raise ValueError("scores may exceed 2^53 and can't be exact")
    spark = base.sparkSession
    block_rows = max(block_rows, ceil(n / 16_384))
    sample = base.orderBy(F.xxhash64("row"), "row").limit(sample_rows).select("v").collect()
    chosen = spread_pivots(lift(np.array([r["v"] for r in sample]), top), pivots)

    def tabled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            v = _matrix(batch.column("v"), batch.num_rows)
            table = distances(lift(v, top), chosen)
            asked = distances(np.concatenate((v, np.zeros((len(v), 1))), axis=1), chosen)
            cells = table.argmin(axis=1)
            nested = [
                pa.ListArray.from_arrays(np.arange(len(v) + 1, dtype=np.int32) * len(chosen), x.ravel())
                for x in (table, asked)
            ]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("row", "vec_id", "v", "norm")), *nested, pa.array(cells, pa.int32())],
                names=["row", "vec_id", "v", "norm", "table", "asked", "cell"],
            )

    schema = "row long, vec_id long, v array<double>, norm double, table array<double>, asked array<double>, cell int"
    spread = written(base.mapInArrow(tabled, schema))
    counts = {r["cell"]: ceil(r["count"] / block_rows) for r in spread.groupBy("cell").count().collect()}
    parts = F.create_map(*[F.lit(x) for pair in counts.items() for x in pair])
    part = F.pmod(F.xxhash64("row"), parts[F.col("cell")].cast("long")).cast("int")
    placed = spread.withColumn("block", F.col("cell") * 65_536 + part)
    # At most 16,384 blocks and one more for each pivot, whatever the input: their bounds fit into the driver.
    ends = placed.select("block", F.posexplode("table").alias("p", "d")).groupBy("block", "p")
    bounds = ends.agg(F.min("d").alias("low"), F.max("d").alias("high")).collect()
    names = np.array(sorted({r["block"] for r in bounds}))
    at = {b: i for i, b in enumerate(names.tolist())}
    low, high = np.zeros((len(names), len(chosen))), np.zeros((len(names), len(chosen)))
    for r in bounds:
        low[at[r["block"]], r["p"]], high[at[r["block"]], r["p"]] = r["low"], r["high"]

    candidates = placed.select("block", F.lit(0).alias("kind"), "row", "vec_id", "v", "table", F.lit(None).cast("double").alias("least"))
    queries = placed.where(F.col("vec_id") % query_step == 0).select("block", "row", "vec_id", "v", F.col("asked").alias("table"))

    def searched(asked: DataFrame) -> DataFrame:
        both = candidates.unionByName(asked.withColumn("kind", F.lit(1)))
        runs = both.repartition("block").sortWithinPartitions("block", "kind")
        return runs.mapInArrow(
            lambda batches: _search(batches, top, k), "query_row long, query_id long, vec_id long, row long, score long"
        )

    home = written(searched(queries.withColumn("least", F.lit(None).cast("double"))))
    reached = home.groupBy("query_row").agg(F.min("score").alias("least"), F.count("*").alias("n"))
    reached = reached.select(F.col("query_row").alias("row"), F.when(F.col("n") >= k, F.col("least")).cast("double").alias("least"))

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each query once for every other block that its bounds don't rule out."""
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                some = batch.slice(start, 256)
                v, asked = _matrix(some.column("v"), some.num_rows), _matrix(some.column("table"), some.num_rows)
                least = some.column("least").to_pandas().fillna(-np.inf).to_numpy()
                gap = np.zeros((len(v), len(names)))
                for j in range(asked.shape[1]):
                    own = asked[:, j][:, None]
                    np.maximum(gap, np.maximum(low[None, :, j] - own, own - high[None, :, j]), out=gap)
                whole = ((v * v).sum(axis=1) + top)[:, None]
                go = ((whole - gap * gap) / 2 + SLACK * (whole + 1) >= least[:, None]) & (
                    names[None, :] != some.column("block").to_numpy()[:, None]
                )
                i, j = np.nonzero(go)
                taken = some.take(pa.array(i))
                yield taken.set_column(taken.schema.get_field_index("block"), "block", pa.array(names[j].astype(np.int32)))

    seeded = queries.join(reached, "row", "left").select("block", "row", "vec_id", "v", "table", "least")
    away = searched(seeded.mapInArrow(others, "block int, row long, vec_id long, v array<double>, table array<double>, least double"))
    return home.unionByName(away)
