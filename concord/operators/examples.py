"""A few examples per table and category next to the exact totals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concord.functions.columns import col
from concord.operators.ordinals import listing, ordering

EXAMPLES_PER_CATEGORY = 10
STRANDS = 64


def capped_examples(
    differences: DataFrame, group: Sequence[str], order: Sequence[str], limit: int = EXAMPLES_PER_CATEGORY
) -> DataFrame:
    """The first ``limit`` rows of each group by ``order``, with ``example_no``, ``total`` and ``not_shown``.

    The first rows are picked in two steps, per strand of a group and then per group: a group with most of the rows is
    cut over many tasks and the last step sees at most ``limit`` rows of each strand.
    """

    def ranked(groups: Sequence[str]) -> str:
        return f"row_number() OVER (PARTITION BY {listing(groups)} ORDER BY {ordering(order)}) AS example_no"

    first = (
        differences.selectExpr("*", f"pmod(xxhash64({listing(order)}), {STRANDS}) AS __strand")
        .selectExpr("*", ranked([*group, "__strand"]))
        .filter(f"example_no <= {limit}")
        .drop("example_no", "__strand")
        .selectExpr("*", ranked(group))
        .filter(f"example_no <= {limit}")
    )
    totals = differences.groupBy(*[col(name) for name in group]).agg(F.expr("count(*)").alias("total"))
    return first.join(totals, list(group)).selectExpr("*", f"greatest(total - {limit}, 0L) AS not_shown")
