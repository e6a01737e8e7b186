"""Turning a counted row back into that many rows."""

from __future__ import annotations

from pyspark.sql import DataFrame

from concord.functions.columns import col, quote

CHUNK_ROWS = 100_000


def repeat_rows(
    df: DataFrame, times: str, copy: str, chunk_rows: int = CHUNK_ROWS, largest: int | None = None
) -> DataFrame:
    """Each row ``times`` times, numbered 1.. in ``copy``.

    A count above ``chunk_rows`` is first cut into chunks that are spread over the tasks, so that one heavily repeated
    row does not write all of its copies from one task. That branch is left out when the ``largest`` count is known to
    be smaller.
    """
    count = f"CAST({quote(times)} AS BIGINT)"
    small = df.filter(f"{count} BETWEEN 1 AND {chunk_rows}").selectExpr("*", f"explode(sequence(1L, {count})) AS {quote(copy)}")
    if largest is not None and largest <= chunk_rows:
        return small
    first = f"__chunk * {chunk_rows}L + 1L"
    large = (
        df.filter(f"{count} > {chunk_rows}")
        .selectExpr("*", f"explode(sequence(0L, ({count} - 1L) div {chunk_rows}L)) AS __chunk")
        .repartition(*[col(name) for name in [*df.columns, "__chunk"]])
        .selectExpr("*", f"explode(sequence({first}, least({count}, {first} + {chunk_rows - 1}L))) AS {quote(copy)}")
        .drop("__chunk")
    )
    return small.unionByName(large)
