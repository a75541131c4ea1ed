"""On the given tables: operators with SQL against DuckDB, search recall against brute force, held-out accuracy of trained models."""

import os
import zlib

import duckdb
import numpy as np
import pandas as pd
import pytest

from lodestar.llm.queries import oracle_sql, queries

SF = os.environ.get("LODESTAR_SF", "/root/testdata/sf0.01")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_matches_oracle(spark, duck, name):
    got, want = queries()[name](spark, SF).toPandas(), duck.execute(oracle_sql()[name]).df()
    key = got.columns[0]
    assert list(got.columns) == list(want.columns)
    for c in got.columns:
        a, b = (x.sort_values(key)[c].reset_index(drop=True) for x in (got, want))
        assert ((a == b) | (a.isna() & b.isna())).all(), c


def test_quality_on_held_out_rows(spark):
    got = queries()["op1_quality"](spark, SF).toPandas()
    lab = pd.read_parquet(f"{SF}/labels.parquet").merge(got, on="doc_id")
    held = lab[lab.held_out]
    assert set(held.doc_id) == {i for i in lab.doc_id if zlib.crc32(str(i).encode()) % 5 == 0}
    good, bad = held.score[held.quality == 1].to_numpy(), held.score[held.quality == 0].to_numpy()
    assert (good[:, None] > bad[None]).mean() > 0.95 and (held.predicted == held.quality).mean() > 0.95


def test_search_recall(spark):
    e = pd.read_parquet(f"{SF}/embeddings.parquet").sort_values("vec_id")
    x, ids = np.stack(e.embedding).astype(float), e.vec_id.to_numpy()
    unit = x / np.sqrt((x * x).sum(1, keepdims=True))
    got = queries()["op2_ann"](spark, SF).toPandas().groupby("query_id").vec_id.apply(set)
    hits = []
    for i in np.flatnonzero(ids % 50 == 0):
        s = unit @ unit[i]
        s[i] = -9
        hits.append(len(got[ids[i]] & set(ids[np.argsort(-s)[:5]])) / 5)
    assert np.mean(hits) >= 0.9


def test_language_model_beats_single_words_on_held_out_text(spark):
    got = queries()["op4_hmm"](spark, SF).toPandas()
    held = got[got.held_out]
    assert held.score.sum() > held.base_score.sum() and (got.score <= 0).all()
