"""Headline queries at one scale; prints one JSON line with the median of the warm runs of each query."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from concord import build_session
from concord.demo.queries import QUERIES

HEADLINE = (
    "keyed_diff_counts",
    "keyed_diff_rows",
    "changed_rows",
    "table_summary",
    "keyed_diff_reconciled",
    "keyed_diff_dup_keys",
    "keyed_diff_custom_key",
    "keyed_diff_large_text",
    "cell_diff",
    "multiset_diff_counts",
    "multiset_diff_rows",
    "rows_missing_from_target",
    "hash_samples",
    "diff_by_range",
    "range_boundaries",
    "report_summary",
    "text_line_diff",
    "text_positional_diff",
    "large_content_pairs",
    "capped_examples",
    "accepted_summary",
    "object_classes",
    "schema_column_diff",
)


def run(spark, name: str, folder: str) -> float:
    started = time.perf_counter()
    QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - started


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeats = int(os.environ.get("BENCH_REPEATS", "3"))
    names = sys.argv[1:] or HEADLINE
    spark = build_session(
        "concord-bench",
        f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus if cpus.isdigit() else "8",
        spark__ui__enabled="false",
        spark__driver__memory="12g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in names:
        run(spark, name, folder)
        seconds[name] = round(statistics.median(run(spark, name, folder) for _ in range(repeats)), 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "reconciliation_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")),
                "cpus": cpus,
                "repeats": repeats,
            }
        )
    )


if __name__ == "__main__":
    main()
