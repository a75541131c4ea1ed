import random

from pyspark.sql import functions as F

from lodestar.operators import relational as R
from lodestar.plans.battle import ledger


def at(df, *cols):
    return df.withColumns({c: F.timestamp_seconds(c) for c in cols})


def test_top_k_and_latest(spark):
    df = spark.createDataFrame([(1, 5), (1, 7), (1, 7), (2, 1)], "k int, v int")
    assert sorted((r.k, r.v) for r in R.top_k(df, ["k"], [F.desc("v")], 2).collect()) == [(1, 7), (1, 7), (2, 1)]
    assert sorted((r.k, r.v) for r in R.latest(df, ["k"], [F.desc("v")]).collect()) == [(1, 7), (2, 1)]


def test_islands(spark):
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate(["a", "a", None, None, "a", "b"])], "k int, i int, v string")
    assert [r.island for r in R.islands(df, ["k"], ["i"], "v").orderBy("i").collect()] == [1, 1, 2, 2, 3, 4]


def test_gap_islands_use_latest_end(spark):
    df = at(spark.createDataFrame([(1, 0, 100, 1), (1, 10, 20, 2), (1, 140, 150, 3), (1, 300, 310, 4)], "k int, s int, e int, i int"), "s", "e")
    assert [r.island for r in R.gap_islands(df, ["k"], "s", "e", "i", 45).orderBy("i").collect()] == [1, 1, 1, 2]


def test_band_join_against_loop(spark):
    rnd = random.Random(1)
    a = [(rnd.randrange(3), rnd.randrange(2000), i) for i in range(80)]
    b = [(rnd.randrange(3), rnd.randrange(2000), i) for i in range(80)]
    da, db = at(spark.createDataFrame(a, "k int, ta int, i int"), "ta"), at(spark.createDataFrame(b, "k int, tb int, j int"), "tb")
    got = sorted((r.i, r.j) for r in R.band_join(da, db, ["k"], "ta", "tb", 60).collect())
    assert got == sorted((x[2], y[2]) for x in a for y in b if x[0] == y[0] and abs(x[1] - y[1]) <= 60)


def test_overlap_join_against_loop(spark):
    rnd = random.Random(2)
    iv = lambda: (lambda s: (s, s + rnd.randrange(0, 400)))(rnd.randrange(2000))
    a = [(rnd.randrange(2), *iv(), i) for i in range(60)]
    b = [(rnd.randrange(2), *iv(), i) for i in range(60)]
    day = 86_400
    da = spark.createDataFrame([(k, s * day, e * day, i) for k, s, e, i in a], "k int, sa long, ea long, i int")
    db = spark.createDataFrame([(k, s * day, e * day, i) for k, s, e, i in b], "k int, sb long, eb long, j int")
    got = sorted((r.i, r.j) for r in R.overlap_join(at(da, "sa", "ea"), at(db, "sb", "eb"), ["k"], ("sa", "ea"), ("sb", "eb")).collect())
    assert got == sorted((x[3], y[3]) for x in a for y in b if x[0] == y[0] and x[1] <= y[2] and y[1] <= x[2])


def test_upsert(spark):
    old = spark.createDataFrame([(1, 10, 5, "x"), (2, 20, 6, "y")], "k int, first int, n int, s string")
    new = spark.createDataFrame([(2, 99, 1, "z"), (3, 30, 2, "w")], "k int, first int, n int, s string")
    got = sorted(tuple(r) for r in R.upsert(old, new, ["k"], keep_first=["first"], add=["n"]).collect())
    assert got == [(1, 10, 5, "x"), (2, 20, 7, "z"), (3, 30, 2, "w")]


def test_insert_absent(spark):
    old = spark.createDataFrame([(1, "a")], "k int, s string")
    new = spark.createDataFrame([(1, "b"), (2, "c"), (2, "c")], "k int, s string")
    assert sorted(tuple(r) for r in R.insert_absent(old, new, ["k"]).collect()) == [(1, "a"), (2, "c")]


def test_keep_spaced_against_loop(spark):
    rnd = random.Random(3)
    rows = [(rnd.randrange(4), rnd.randrange(5000), i) for i in range(200)]
    got = {r.i for r in R.keep_spaced(at(spark.createDataFrame(rows, "k int, t int, i int"), "t"), "k", "t", "i", 100).collect()}
    want = set()
    for k in range(4):
        last = None
        for _, t, i in sorted((r for r in rows if r[0] == k), key=lambda r: (r[1], r[2])):
            if last is None or t - last >= 100:
                want.add(i)
                last = t
    assert got == want


def test_ledger_invariants(spark):
    km = spark.createDataFrame([(1, 100, 7, 50.0), (2, 100, 7, 25.0)], "sequence_id long, victim_character_id long, victim_alliance_id long, total_value double")
    ka = spark.createDataFrame([(1, 5, 500.0, True), (1, 6, 0.0, False), (2, 5, 10.0, False), (2, 6, 1.0, True)], "sequence_id long, character_id long, damage_done double, final_blow boolean")
    r = {x.character_id: x for x in ledger(km, ka).collect()}
    assert r[100].losses == 2 and r[100].isk_lost == 75 and r[5].final_kills == 1 and r[5].contributed_kills == 2 and r[6].damage == 1
    assert sum(x.final_kills for x in r.values()) == sum(x.losses for x in r.values()) == 2


def test_pairs(spark):
    df = spark.createDataFrame([(1, 3), (1, 2), (1, 3), (2, 9)], "g int, n int")
    assert [tuple(r)[1:] for r in R.pairs(df, ["g"], "n").collect()] == [(2, 3)]


def test_ranked_counts(spark):
    rnd = random.Random(4)
    v = [rnd.randrange(40) / 4 for _ in range(500)] + [1e9, -5.0]
    got = {r.v: (r.below, r.upto, r.total) for r in R.value_counts_ranked(spark.createDataFrame([(x,) for x in v] + [(None,)], "v double"), "v", 8).collect()}
    assert got == {x: (sum(y < x for y in v), sum(y <= x for y in v), len(v)) for x in set(v)}
    assert R.value_counts_ranked(spark.createDataFrame([], "v double"), "v").count() == 0
