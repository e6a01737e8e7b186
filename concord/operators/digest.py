"""Comparison by digests of key buckets: only rows of buckets that differ are ever shuffled.

The rows of both sides are put into buckets by their key and each bucket is summed up: number of rows, and the sums of two
independent 64-bit hashes of key and values. Source counts up and Target counts down, so that one scan of the compared
columns of each side and one partial aggregation leave nothing but zeros for a bucket that is equal. Equal sums are taken
for equal rows: the chance of an error is about 2**-128 for a bucket. The rows of the other buckets are read again and
compared as always.

Whole-number and date keys lie in buckets of equal width, so that the second read skips what file statistics rule out;
other keys are dealt by hash.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, replace
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from concord.functions.columns import any_of, col, quote
from concord.operators.keyed import (
    SOURCE,
    TARGET,
    differing,
    key_expression,
    keyed_rows,
    scan,
    side_frame,
    side_name,
)
from concord.operators.summary import part_counts
from concord.plans.compare_plan import ComparePlan

BUCKETS = 4096
#: Runs of neighbouring buckets that are pushed to the scans one by one; more are pushed as the span they lie in.
RUNS_PUSHED = 32

_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_HALVES = ("low_a", "high_a", "low_b", "high_b")
_EPOCH = dt.date(1970, 1, 1)


@dataclass(frozen=True)
class Bucketing:
    """How keys fall into buckets ``0 .. buckets - 1``; a NULL leading key of a range bucketing is bucket -1.

    ``low`` is the smallest leading key and ``width`` the keys in a bucket, both NULL where keys are dealt by hash.
    """

    buckets: int
    low: int | None = None
    width: int | None = None
    dates: bool = False

    @property
    def by_range(self) -> bool:
        return self.low is not None

    def expression(self, key: str, keys: list[str]) -> str:
        """The bucket, from the leading key and from all keys."""
        if not self.by_range:
            return f"CAST(pmod(xxhash64({', '.join(keys)}), {self.buckets}L) AS INT)"
        number = f"CAST(unix_date({key}) AS BIGINT)" if self.dates else f"CAST({key} AS BIGINT)"
        # The distance of two keys may pass 64 bits.
        return f"coalesce(CAST((CAST({number} AS DECIMAL(20,0)) - {self.low}BD) div {self.width}BD AS INT), -1)"

    def bounds(self, first: int, last: int) -> tuple:
        """Smallest and largest key of a run of buckets."""
        low, high = self.low + first * self.width, self.low + (last + 1) * self.width - 1
        if self.dates:
            return _EPOCH + dt.timedelta(days=low), _EPOCH + dt.timedelta(days=min(high, 2932896))
        return low, min(high, 2**63 - 1)


def bucketing(plan: ComparePlan, buckets: int = BUCKETS) -> Bucketing:
    """Equal widths over the leading keys of both sides if these are whole numbers or dates of one kind, else by hash."""
    if buckets < 1:
        raise ValueError("at least one bucket is needed")
    if any(pair.collation for pair in plan.keys):
        raise ValueError("equal keys of a collation have different hashes, so that they can't be compared by digests")
    lead = plan.keys[0]
    dates = all(isinstance(t, T.DateType) for t in (lead.source_type, lead.target_type))
    if not dates and not (lead.same_type and isinstance(lead.source_type, _WHOLE)):
        return Bucketing(buckets)
    ends = []
    for side in (SOURCE, TARGET):
        key = col(side_name(lead, side))
        key = F.unix_date(key) if dates else key.cast("long")
        ends += [x for x in side_frame(plan, side).agg(F.min(key), F.max(key)).first() if x is not None]
    if not ends:
        return Bucketing(buckets)
    width = -(-(max(ends) - min(ends) + 1) // buckets)
    return Bucketing(buckets, min(ends), width, dates)


def _digested(plan: ComparePlan, side: str, by: Bucketing) -> DataFrame:
    keys = [f"{side}k{i}" for i in range(len(plan.keys))]
    values = [f"{side}v{i}" for i in range(len(plan.values))]
    # A hash skips NULL, so that each column goes with a mark that tells whether it is one.
    parts = ", ".join(f"{name}, {name} IS NULL" for name in (*keys, *values))
    sign = 1 if side == SOURCE else -1
    return (
        scan(plan, side)
        .selectExpr(
            f"{by.expression(keys[0], keys)} AS bucket", f"xxhash64(1, {parts}) AS a", f"xxhash64(2, {parts}) AS b"
        )
        .selectExpr(
            "bucket",
            f"{sign}L AS rows",
            # Halves of 32 bits: sums of up to 2**31 rows fit into a long.
            *[f"{sign}L * ({h} & 4294967295L) AS low_{h}" for h in "ab"],
            *[f"{sign}L * shiftrightunsigned({h}, 32) AS high_{h}" for h in "ab"],
        )
    )


def bucket_digests(plan: ComparePlan, by: Bucketing) -> DataFrame:
    """``bucket source_rows target_rows equal``: one scan per side and one shuffle of at most ``buckets`` rows per task.

    Columns of different types are never equal, as hashes of different types are not.
    """
    if not plan.keys:
        raise ValueError(f"{plan.table_name} has no usable key; compare it as a multiset")
    both = _digested(plan, SOURCE, by).unionByName(_digested(plan, TARGET, by))
    zero = " AND ".join(f"{half} = 0" for half in _HALVES)
    return (
        both.groupBy("bucket")
        .agg(
            F.expr("sum(greatest(rows, 0L))").alias("source_rows"),
            F.expr("sum(greatest(-rows, 0L))").alias("target_rows"),
            *[F.sum(half).alias(half) for half in _HALVES],
        )
        .selectExpr("bucket", "source_rows", "target_rows", f"source_rows = target_rows AND {zero} AS equal")
    )


def _runs(buckets: list[int]) -> list[tuple[int, int]]:
    """Neighbouring buckets as (first, last)."""
    runs: list[tuple[int, int]] = []
    for bucket in buckets:
        if runs and bucket == runs[-1][1] + 1:
            runs[-1] = (runs[-1][0], bucket)
        else:
            runs.append((bucket, bucket))
    return runs


class DigestComparison:
    """A keyed comparison that reads rows only where digests differ.

    At most ``buckets`` digests come to the driver. Results equal those of the comparison of all rows, also for keys that
    repeat: a bucket holds all rows of its keys.
    """

    def __init__(self, plan: ComparePlan, buckets: int = BUCKETS) -> None:
        self.plan = plan
        self.by = bucketing(plan, buckets)

    @cached_property
    def digests(self) -> DataFrame:
        return bucket_digests(self.plan, self.by)

    @cached_property
    def _found(self) -> tuple[list[int], int]:
        """The buckets that differ, and the rows of one side in all others."""
        rows = self.digests.collect()
        return sorted(r.bucket for r in rows if not r.equal), sum(r.source_rows for r in rows if r.equal)

    @property
    def equal(self) -> bool:
        return not self._found[0]

    def _narrow(self, side: str) -> DataFrame:
        df = side_frame(self.plan, side)
        buckets = self._found[0]
        if not buckets:
            return df.where("false")
        keys = [f"({key_expression(pair, side)})" for pair in self.plan.keys]
        bucket = self.by.expression(keys[0], keys)
        if self.by.by_range:
            df = df.where(self._pushed(quote(side_name(self.plan.keys[0], side)), [b for b in buckets if b >= 0]))
        return df.where(F.expr(bucket).isin(buckets))

    def _pushed(self, key: str, buckets: list[int]) -> str:
        """What a scan can skip by: the key ranges of the buckets, or the span they lie in."""
        runs = _runs(buckets)
        if len(runs) > RUNS_PUSHED:
            runs = [(runs[0][0], runs[-1][1])]
        kind = "DATE" if self.by.dates else ""
        parts = [f"{key} IS NULL"] if -1 in self._found[0] else []
        for first, last in runs:
            low, high = (f"DATE'{x}'" if kind else f"{x}L" for x in self.by.bounds(first, last))
            parts.append(f"{key} >= {low} AND {key} <= {high}")
        return any_of(parts)

    @cached_property
    def narrowed(self) -> ComparePlan:
        """The plan with both sides cut down to the buckets that differ."""
        source, target = (
            replace(table, df=self._narrow(side)) for side, table in ((SOURCE, self.plan.source), (TARGET, self.plan.target))
        )
        return replace(self.plan, source=source, target=target)

    @property
    def differences(self) -> DataFrame:
        """The rows that are not matched, before moved rows are paired."""
        return differing(keyed_rows(self.narrowed))

    @property
    def counts(self) -> DataFrame:
        """The counts of the whole table: rows of equal buckets are matched without being compared."""
        matched = self._found[1]
        found = part_counts(keyed_rows(self.narrowed))
        return found.selectExpr(
            *[f"{name} + {matched}L AS {name}" for name in ("source_rows", "target_rows", "matched")],
            "changed",
            "only_in_source",
            "only_in_target",
        )
