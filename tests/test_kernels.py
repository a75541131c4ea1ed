import math

import pytest
from pyspark.sql import functions as F

from lodestar.functions import kernels as K


def one(df):
    return df.first().asDict()


def test_rnd_is_half_up(spark):
    r = one(spark.range(1).select(K.rnd(F.lit(0.00005)).alias("a"), K.rnd(F.lit(2.5), 0).alias("b"), K.rnd(F.lit(-1.25), 1).alias("c")))
    assert (r["a"], r["b"], r["c"]) == (0.0001, 3.0, -1.2)


def test_entropy_and_hhi(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (2, "a")], "k int, v string")
    got = {r.k: (r.entropy, r.hhi) for r in K.entropy_hhi(df, "k", "v").collect()}
    assert got == {1: (1.0, 0.5), 2: (0.0, 1.0)}


def test_divergence_bounds(spark):
    p = spark.createDataFrame([(1, "a", 1.0), (2, "a", 0.5), (2, "b", 0.5)], "k int, v string, p double")
    q = spark.createDataFrame([(1, "b", 1.0), (2, "a", 0.5), (2, "b", 0.5)], "k int, v string, p double")
    got = {r.k: (r.jsd, r.cosine_distance) for r in K.js_divergence(p, q, "k", "v").collect()}
    assert got[1] == (1.0, 1.0) and got[2] == (0.0, pytest.approx(0.0))


def test_gini(spark):
    df = spark.createDataFrame([(1, 1), (1, 1), (1, 1), (2, 0), (2, 0), (2, 9), (3, 5)], "k int, v int")
    got = {r.k: r.gini for r in K.gini(df, "k", "v").collect()}
    assert got[1] == pytest.approx(0) and got[2] == pytest.approx(1) and got[3] == 0


def test_cusum_against_loop(spark):
    for values in ([1.0] * 10 + [9.0] * 10, [1.0, 2.0] * 12, [3.0] * 20, [1.0, 5.0]):
        n, m = len(values), sum(values) / len(values)
        up = down = top = 0.0
        if n >= 15:
            for v in values:
                up, down = max(0, up + v - m), max(0, down - v + m)
                top = max(top, up, down)
        r = one(spark.createDataFrame([(values,)], "z array<double>").select(K.cusum(F.col("z")).alias("c")))["c"]
        assert r.score == pytest.approx(top) and r.alarm == (top >= 4)


def test_cohort_normalize(spark):
    df = spark.createDataFrame([("a", float(v)) for v in (1, 2, 3, 4, 100)] + [("b", 7.0)], "k string, v double")
    got = {(r.k, r.v): r for r in K.cohort_normalize(df, "k", "v").collect()}
    assert got["a", 100.0].mad_score == pytest.approx((100 - 3) / 1.4826) and got["a", 100.0].pct == 1.0 and got["a", 1.0].confidence == "medium"
    assert got["b", 7.0].z == 0 and got["b", 7.0].mad_score == 0 and got["b", 7.0].confidence == "low"


def test_decay_and_normalise(spark):
    d = lambda k, a, h: K.decay(F.lit(k), F.lit(a), F.lit(h))
    r = one(spark.range(1).select(d("exponential", 7.0, 7.0).alias("e"), d("linear", 7.0, 7.0).alias("l"), d("step", 8.0, 7.0).alias("s"), d("none", 99.0, 7.0).alias("n"), K.normalise(F.lit("bounded"), F.lit(5.0), F.lit(0.0), F.lit(10.0)).alias("b")))
    assert (r["e"], r["l"], r["s"], r["n"], r["b"]) == (0.5, 0.5, 0.0, 1.0, 0.5)
    assert tuple(one(spark.range(1).select(d("exponential", 7.0, 0.0).alias("a"), d("other", 14.0, 7.0).alias("b"), d("linear", 7.0, -1.0).alias("c"))).values()) == (1.0, 0.25, 1.0)
    n = lambda k, v, lo, hi, *mid: K.normalise(F.lit(k), F.lit(float(v)), F.lit(float(lo)), F.lit(float(hi)), *(F.lit(float(m)) for m in mid))
    pieces = [(-1, 0, 1, 5, 0.0), (0.5, 0, 1, 5, 0.25), (1, 0, 1, 5, 0.5), (3, 0, 1, 5, 0.75), (6, 0, 1, 5, 1.0), (2, 0, 0, 4, 0.75), (3, 0, 4, 4, 0.375)]
    got = one(spark.range(1).select(*(n("piecewise", v, lo, hi, mid).alias(f"p{i}") for i, (v, lo, mid, hi, _) in enumerate(pieces))))
    assert tuple(got.values()) == tuple(x[-1] for x in pieces)
    assert tuple(one(spark.range(1).select(n("zscore", -1.5, 0, 3).alias("a"), n("zscore", 9, 0, 3).alias("b"), n("zscore", -0.5, 0, 0).alias("c"))).values()) == (0.5, 1.0, 0.5)
    conf = lambda c, m: K.edge_confidence(F.lit(c), F.lit(m), F.lit(1))
    assert tuple(one(spark.range(1).select(conf(1, 2).alias("a"), conf(3, 100).alias("b"))).values()) == pytest.approx((1.0, 0.46))


def test_sets_and_cosine(spark):
    df = spark.createDataFrame([([1, 2, 3], [2, 3, 4], [1.0, 0.0], [0.0, 0.0])], "a array<int>, b array<int>, x array<double>, y array<double>")
    r = one(df.select(K.jaccard(F.col("a"), F.col("b")).alias("j"), K.overlap_min(F.col("a"), F.col("b")).alias("o"), K.cosine(F.col("x"), F.col("x")).alias("c"), K.cosine(F.col("x"), F.col("y")).alias("z")))
    assert r["j"] == 0.5 and r["o"] == pytest.approx(2 / 3) and r["c"] == 1.0 and r["z"] == 0.0


def test_cadence(spark):
    df = spark.createDataFrame([(1, 0, 1), (1, 10, 2), (1, 20, 3), (2, 5, 4)], "k int, s int, i int").withColumn("ts", F.timestamp_seconds("s"))
    r = K.cadence(df, "k", "ts", "i").collect()
    assert len(r) == 1 and r[0].mean_gap == 10 and r[0].cv == 0 and r[0].burstiness == -1
