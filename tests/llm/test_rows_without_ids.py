"""Rows without doc_id, alone and beside others, pass every operator on documents and every pipeline stage."""

import random

import pytest
from test_text_ops import prose

import corpus_pipeline
from lodestar.llm.queries import queries


def documents():
    rnd = random.Random(21)
    long_ = prose(rnd, 60)
    return [(i, prose(rnd, 40), "ab"[i % 2]) for i in range(20)] + [(None, long_, "a"), (None, long_, "a"), (None, None, None), (None, "", "b"), (50, long_, "b"), (None, "mail x.y@z.example.com " + prose(rnd, 30), "b")]


@pytest.mark.parametrize("name", sorted(k for k in queries() if not k.startswith(("op2_", "op8_"))))
def test_queries(spark, tables, name):
    docs = documents()
    d = tables(documents=docs, labels=[(i, i % 2, 0) for i in range(20)] + [(None, 1, 0)], benchmark=[(1, docs[3][1]), (None, docs[4][1])])
    got = queries()[name](spark, d).collect()
    assert sorted(r.doc_id for r in got if r.doc_id is not None) == sorted(i for i, *_ in docs if i is not None)
    assert len(got) == len(docs)
    rows = [r.asDict() for r in got if r.doc_id is None]
    if name == "op5_repeats":
        assert all(r["n_removed"] == 0 for r in rows)
    if name == "op6_simhash":
        assert [r.component_id for r in got if r.doc_id == 50] == [50]
    if name == "op9_mixing":
        assert all(r["taken"] <= 2 * r["size"] for r in rows)


def test_stages(spark, tables):
    docs = documents()
    d = tables(documents=docs, labels=[(i, 1, 0) for i in range(20)], benchmark=[(1, prose(random.Random(3), 30))])
    rows = spark.read.parquet(f"{d}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, rows, d)
        if name == "near_copies":
            assert got.where("doc_id is null").count() == 5
        elif name in ("decontaminate", "pii"):
            assert got.count() == rows.count()
        rows = got if name != "quality" else rows  # all rows go on, whatever the classifier makes of so few labels
