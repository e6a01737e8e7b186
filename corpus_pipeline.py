"""The corpus pipeline: stages over ``documents``, each written and read again by the next one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from concord.llm import convnet, packing, rules, simhash
from concord.llm.common import arrow_rows, table, written

#: Documents that go to a Python worker together; a worker and its executor hold them, and several copies of them, at once.
BATCH_ROWS = 1000


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the network rejects go."""
    return convnet.keep_good(docs, convnet.train(docs, table(spark, sf_dir, "labels")))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base or a rule go."""
    return rules.keep_passing(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-copies stays: fingerprints of four-word shingles at most 4 bits apart."""
    with arrow_rows(spark, BATCH_ROWS):
        return simhash.keep_one(docs, width=4, radius=4)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document left, placed in a sequence; workers still hold what the stages before left in them."""
    with arrow_rows(spark, BATCH_ROWS):
        return packing.pack(docs, memo_words=100_000, at_once=1 << 19)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("pack", pack),
]

#: A fitted network, components of near-copies and best-fit are beyond SQL; tests compare with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
