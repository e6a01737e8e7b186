from __future__ import annotations

import subprocess
import sys
from pathlib import Path

import corpus_pipeline
from brute import awkward, empty
from test_packing import check, expected_pieces, order

import __spark_entry__
from concord.llm import convnet, rules, simhash
from concord.llm.common import table, written

FOLDER = "/root/testdata/sf0.001"
REPO = Path(corpus_pipeline.__file__).parent


def test_stages_follow_from_their_operators(spark):
    docs, labels = table(spark, FOLDER, "documents"), table(spark, FOLDER, "labels")
    ids = lambda df: sorted(r.doc_id for r in df.collect())
    net = convnet.train(docs, labels)
    want = ids(convnet.classify(docs, net).where("predicted = 1"))
    kept = written(corpus_pipeline.quality_classifier(spark, docs, FOLDER))
    assert kept.columns == docs.columns and ids(kept) == want
    passed = written(corpus_pipeline.quality_rules(spark, kept, FOLDER))
    assert passed.columns == docs.columns and ids(passed) == ids(rules.quality_rules(kept, labels).where("kept"))
    single = written(corpus_pipeline.near_dedup(spark, passed, FOLDER))
    assert single.columns == docs.columns
    assert ids(single) == sorted({r.component_id for r in simhash.near_duplicates(passed).collect()})
    found = corpus_pipeline.pack(spark, single, FOLDER).collect()
    check(found)
    assert sorted((tuple(r)[:5] for r in found), key=order) == sorted(
        expected_pieces([(r.doc_id, r.text) for r in single.collect()]), key=order
    )
    assert sorted(tuple(r)[:5] for r in corpus_pipeline.run(spark, FOLDER).collect()) == sorted(tuple(r)[:5] for r in found)


def test_stages_take_awkward_and_empty_tables(spark):
    """What each stage keeps of the awkward rows is what its operator says of them, whatever the columns are called."""
    names = ("__n_words", "__words", "__kept", "__base_failed", "__cut", "__fp", "__node", "row", "id")
    docs = awkward(spark).selectExpr("*", *[f"'{n}' AS `{n}`" for n in names])
    rows = lambda df: sorted(map(tuple, df.select("doc_id", "text").collect()), key=order)
    passed = written(corpus_pipeline.quality_rules(spark, docs, FOLDER))
    assert passed.columns == docs.columns
    labels = table(spark, FOLDER, "labels")
    verdicts = rules.quality_rules(docs, labels).where("kept").collect()
    assert sorted(r.doc_id or 0 for r in verdicts) == sorted(r[0] or 0 for r in rows(passed))
    single = written(corpus_pipeline.near_dedup(spark, docs, FOLDER))
    assert single.columns == docs.columns and [r["row"] for r in single.collect()] == ["row"] * single.count()
    found = simhash.near_duplicates(docs)
    assert single.count() == found.select("node").distinct().count()
    assert rows(single) == rows(simhash.keep_one(docs)) and {1, 3}.issubset({r.doc_id for r in single.collect()})
    scored = written(corpus_pipeline.quality_classifier(spark, docs, FOLDER))
    assert scored.columns == docs.columns and set(rows(scored)) <= set(rows(docs))
    none = empty(spark)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        none = written(stage(spark, none, FOLDER))
        assert none.columns == empty(spark).columns and none.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, none, FOLDER).count() == 0


def test_entry_lists_every_operator():
    names = __spark_entry__.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 14))
    assert set(__spark_entry__.oracle_sql()) <= set(names)


def test_nothing_outside_imports_this_package():
    """The entry has to work without the package: its folder is hidden from a fresh interpreter."""
    code = (
        "import sys, importlib.abc\n"
        f"sys.path.insert(0, {str(REPO)!r})\n"
        "class Hide(importlib.abc.MetaPathFinder):\n"
        "    def find_spec(self, name, path, target=None):\n"
        "        if name.startswith(('concord.llm', 'corpus_pipeline')):\n"
        "            raise ModuleNotFoundError(name)\n"
        "import importlib.util as u\n"
        "real = u.find_spec\n"
        "u.find_spec = lambda n, *a: None if n.startswith(('concord.llm', 'corpus_pipeline')) else real(n, *a)\n"
        "sys.meta_path.insert(0, Hide())\n"
        "import __spark_entry__ as e\n"
        "assert not any(n.startswith('op') for n in e.queries()) and 'pipeline' not in e.queries()\n"
        "assert set(e.queries()) == set(e.oracle_sql())\n"
    )
    subprocess.run([sys.executable, "-c", code], check=True, timeout=120)


def test_documents_go_to_python_in_small_batches(spark, monkeypatch):
    """Near-dedup and packing hand over at most ``BATCH_ROWS`` documents at a time, and the session keeps its own setting."""
    name, seen = "spark.sql.execution.arrow.maxRecordsPerBatch", []
    before = spark.conf.get(name)
    for module in (corpus_pipeline.simhash, corpus_pipeline.packing):
        plain = module.written
        monkeypatch.setattr(module, "written", lambda df, plain=plain: seen.append(spark.conf.get(name)) or plain(df))
    docs = table(spark, FOLDER, "documents")
    corpus_pipeline.pack(spark, corpus_pipeline.near_dedup(spark, docs, FOLDER), FOLDER)
    assert set(seen) == {str(corpus_pipeline.BATCH_ROWS)} and spark.conf.get(name) == before
