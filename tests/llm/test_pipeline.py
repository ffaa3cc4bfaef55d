"""The pipeline's contract and its stages on edge rows."""

from __future__ import annotations

import re

import corpus_pipeline as cp
from sessionflow.llm import queries

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_take_effect(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = docs.count()
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and out.schema.simpleString() == docs.schema.simpleString(), name
        path = str(tmp_path / name)
        out.write.parquet(path)
        docs = spark.read.parquet(path)
    after = docs.count()
    assert 0 < after < before
    emails = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    assert not any(emails.search(r.text) for r in docs.collect())
    packed = cp.STAGES[-1][1](spark, docs, SF)
    assert {r.doc_id for r in packed.collect()} == {r.doc_id for r in docs.collect()}
    assert [n for n, _ in cp.STAGES] == ["toxicity", "quality", "simhash", "pii", "packing"]
    assert {(r.doc_id, r.piece, r.ids_crc32) for r in cp.run(spark, SF).collect()} == {
        (r.doc_id, r.piece, r.ids_crc32) for r in packed.collect()
    }


def test_stages_on_edge_rows(spark, edge_docs, no_docs):
    for name, stage in cp.STAGES:
        out = stage(spark, edge_docs, SF)
        assert out.count() >= 0 and (name == "packing" or out.columns == edge_docs.columns)
        assert stage(spark, no_docs, SF).count() == 0


def test_one_query_per_operator():
    names = list(queries.queries())
    assert [int(re.match(r"op(\d+)_", n)[1]) for n in names] == list(range(1, 14))


def test_the_rest_does_not_import_this_subpackage():
    import pathlib

    root = pathlib.Path(queries.__file__).parents[1]
    for path in root.rglob("*.py"):
        if "llm" not in path.parts:
            assert "llm" not in path.read_text(), path
