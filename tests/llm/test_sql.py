"""Queries that SQL can express, against DuckDB over whole tables."""

from __future__ import annotations

import pytest
from comparing import TESTDATA, assert_same, duck

from concord.llm.oracle import ORACLE, quality_rules_sql
from concord.llm.queries import QUERIES
from concord.llm.rules import Risk, quality_rules


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query(spark, name):
    folder = TESTDATA / "sf0.01"
    assert_same(QUERIES[name](spark, str(folder)), duck(folder), ORACLE[name])


def test_cutoffs_that_labels_allow(spark):
    """A risk that the few labels of the small table can prove, so that cutoffs are chosen and reject."""
    folder = TESTDATA / "sf0.1"
    control = Risk(risk=0.2, level=0.2)
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    found = quality_rules(docs, labels, control)
    assert_same(found, duck(folder), quality_rules_sql(control))
    assert found.where("NOT base_failed AND NOT kept").count() > 0
