import os

import pytest

import __spark_entry__ as entry
import corpus_pipeline

from .test_dedup import brute_groups, brute_passages

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_stages_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    out = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        out.append(docs)
    good, first, cut, packed = out
    assert good.columns == first.columns == cut.columns == columns
    kept = {r.doc_id for r in good.collect()}
    assert sum(i in kept for i, q in labels.items() if q == 1) >= 0.9 * sum(labels.values())  # learnt from 81 labels

    rows = sorted((r.doc_id, r.text) for r in good.collect())
    want = {c for _, _, c in brute_groups(rows, 5, 80)}
    left = sorted((r.doc_id, r.text) for r in first.collect())
    assert [i for i, _ in left] == sorted(want)

    removed = {i: n for i, _, n, _, _ in brute_passages(left, 100)}
    texts = {r.doc_id: r.text for r in cut.collect()}
    assert texts.keys() == removed.keys()
    for i, t in left:
        assert len(t.encode()) - removed[i] - len(texts[i].encode()) in range(0, 40)  # split characters
    assert all(r.n_chars == len(r.text) for r in cut.collect())
    assert {r.doc_id for r in packed.collect()} == set(texts)
    assert packed.agg({"length": "sum"}).first()[0] == sum(r.doc_tokens for r in packed.where("start = 0").collect())


def test_registered(spark):
    assert "pipeline" in entry.queries() and corpus_pipeline.ORACLE_SQL is None
    names = [n for n in entry.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert corpus_pipeline.run(spark, SF).count() > 0
