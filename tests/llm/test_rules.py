from __future__ import annotations

import math

import pytest
from brute import awkward, empty, rule_counts
from pyspark.sql import functions as F

from concord.llm import rules
from concord.llm.common import table

LABELS = "doc_id long, quality int, toxic int"


def order(row):
    return tuple((x is not None, x or 0) for x in row)


@pytest.mark.parametrize("which", ["table", "awkward"])
def test_counts(spark, which):
    docs = awkward(spark) if which == "awkward" else table(spark, "/root/testdata/sf0.001", "documents")
    labels = spark.createDataFrame([], LABELS)
    found = [tuple(r) for r in rules.quality_rules(docs, labels).collect()]
    want = []
    for doc_id, text in (tuple(r) for r in docs.select("doc_id", "text").collect()):
        c = rule_counts(text)
        failed = c["n_words"] < 20 or 100 * c["n_repeat_words"] > 30 * c["n_words"]
        want.append((doc_id, *c.values(), failed, not failed))
    assert sorted(found, key=order) == sorted(want, key=order)


def test_empty(spark):
    labels = spark.createDataFrame([], LABELS)
    assert rules.quality_rules(empty(spark), labels).count() == 0
    assert rules.keep_passing(empty(spark), labels).count() == 0


@pytest.mark.parametrize("n,k,share", [(10, 0, 0.1), (100, 3, 0.1), (2000, 4, 0.005), (5000, 24, 0.005), (50, 5, 0.1)])
def test_binomial_tail(spark, n, k, share):
    row = spark.range(1).select(rules.binomial_tail(F.lit(n).cast("long"), F.lit(k).cast("long"), share).alias("p")).first()
    exact = sum(math.comb(n, i) * share**i * (1 - share) ** (n - i) for i in range(k + 1))
    assert row.p == pytest.approx(1.0 if k >= n * share else exact, rel=1e-9)


def test_false_rejections_stay_below_the_risk(spark):
    """Half of the good texts hold some symbols: a cutoff below their rate would reject too many."""
    rows, labels = [], []
    for i in range(4000):
        bad = i % 4 == 0
        marks = 30 if bad else (i % 2) * (i % 5)
        rows.append((i, " ".join(["word"] * 3 + [f"w{i}x{j}" for j in range(60)] + ["#"] * marks), "en" if i % 3 else "de"))
        labels.append((i, int(not bad), 0))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    known = spark.createDataFrame(labels, LABELS)
    control = rules.Risk(risk=0.04)
    found = {r.doc_id: r for r in rules.quality_rules(docs, known, control).collect()}
    for lang in ("en", "de"):
        good = [found[i] for i, _, own in rows if own == lang and i % 4]
        bad = [found[i] for i, _, own in rows if own == lang and i % 4 == 0]
        assert sum(not r.kept for r in good) <= 0.04 * len(good)
        assert not any(r.kept for r in bad)
    kept = rules.keep_passing(docs, known, control)
    assert kept.columns == docs.columns and kept.count() == sum(r.kept for r in found.values())


def test_few_labels_allow_no_cutoff(spark):
    docs = spark.createDataFrame([(i, "a # b " * 20 + str(i), None) for i in range(30)], "doc_id long, text string, lang string")
    known = spark.createDataFrame([(i, i % 2, 0) for i in range(30)], LABELS)
    measured = rules.written(rules.measure(docs))
    assert rules.thresholds(measured, known, rules.Risk(), "lang", "doc_id", "quality").count() == 0


def test_too_many_strata_are_refused(spark):
    docs = spark.createDataFrame([(i, f"a{i} " * 2 + " ".join(f"{i}w{j}" for j in range(30)), str(i)) for i in range(30)], "doc_id long, text string, lang string")
    known = spark.createDataFrame([(i, 1, 0) for i in range(30)], LABELS)
    with pytest.raises(ValueError):
        rules.quality_rules(docs, known, rules.Risk(most_strata=5))
