"""Connected components of a link table by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concord.llm.common import written


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b); nodes of one component share the root, which is one of them.

    Each round every node points to the neighbour (or itself) with the smallest hash under the round's own seed, and links
    are carried over to the nodes pointed at. Seeds change, so that chains shrink by a constant share in each round,
    whatever the ids are: rounds grow with the logarithm of the longest chain. Nodes with very many links are combined
    before the shuffle. Every round is written to the shared folder. An empty table gives an empty result.
    """
    spark = links.sparkSession
    edges = written(links.where("a <> b").select("a", "b"))
    maps: list[DataFrame] = []
    while not edges.isEmpty():
        seed = len(maps)
        order = lambda c: F.struct(F.xxhash64(F.lit(seed), F.col(c)).alias("h"), F.col(c).alias("node"))
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        chosen = both.groupBy("a").agg(F.min(order("b")).alias("best"))
        to = F.when(order("a") < F.col("best"), F.col("a"))
        step = written(chosen.select(F.col("a").alias("node"), F.coalesce(to, F.col("best.node")).alias("root")))
        maps.append(step)
        for end in ("a", "b"):
            edges = (
                edges.join(step.withColumnRenamed("node", end), end)
                .drop(end)
                .withColumnRenamed("root", end)
            )
        least, most = F.least("a", "b"), F.greatest("a", "b")
        edges = written(edges.where("a <> b").select(least.alias("a"), most.alias("b")).distinct())
    if not maps:
        return spark.createDataFrame([], "node long, root long")
    found = maps[-1]
    for step in reversed(maps[:-1]):
        later = found.select(F.col("node").alias("root"), F.col("root").alias("last"))
        found = written(step.join(later, "root", "left").select("node", F.coalesce("last", "root").alias("root")))
    return found
