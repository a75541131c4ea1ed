"""Queries that once left rows out, against SQL or loops over all rows."""

from pathlib import Path

import duckdb

from lodestar.operators import graph as G
from lodestar.plans import registry

SF = "/root/testdata/sf0.001"
Q = registry.queries()


def sql(text):
    c = duckdb.connect()
    c.execute("set TimeZone='UTC'")
    for f in Path(SF).glob("*.parquet"):
        c.execute(f"create view {f.stem} as select * from '{f}'")
    return c.execute(text).fetchall()


def test_theaters_hold_all_battles(spark):
    got = Q["theater_clusters"](spark, SF).toPandas()
    battles = sql("SELECT user_id % 10 % 3, min(ts), max(ts) FROM events GROUP BY user_id % 10, CAST(ts AS DATE), user_id % 10 % 3 ORDER BY 1, 2")
    want, last = [], None
    for region, start, end in battles:
        if last is None or last[0] != region or (start - last[2]).total_seconds() > 45 * 60:
            want.append(last := [region, start, end, 0])
        last[2], last[3] = max(last[2], end), last[3] + 1
    assert got.battles.sum() == len(battles)
    assert sorted(zip(got.region, got.started_at, got.ended_at, got.battles)) == sorted(map(tuple, want))


def test_former_allies_of_any_organisation(spark):
    got = Q["former_allies_attacking"](spark, SF).collect()
    since = {}
    for who, org, at in sql("SELECT o_custkey, o_orderpriority, min(o_orderdate) FROM orders GROUP BY 1, 2"):
        since.setdefault(who, {})[org] = at
    attacks = {}
    for attacker, victim, at in sql("SELECT l_suppkey, o_custkey, o_orderdate FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2, 3, o_orderkey"):
        x, y = since.get(attacker, {}), since.get(victim, {})
        if any(x[o] <= at and y[o] <= at for o in x.keys() & y.keys()):
            attacks.setdefault(attacker, []).append(victim)
    assert {(r.attacker, r.attacks, r.victims) for r in got} == {(a, len(v), len(set(v))) for a, v in attacks.items()} and attacks


def test_corridors_have_two_to_five_systems(spark):
    kills = dict(sql("SELECT o_orderkey % 25, count(*) FROM orders GROUP BY 1"))
    cut = sorted(kills.values())[(len(kills) + 1) // 2 - 1]
    active = {s for s, n in kills.items() if n >= cut}
    near = {s: {(s + k) % 25 for k in (1, -1, 5, -5)} & active for s in active}
    paths, want = [(s,) for s in active], set()
    for _ in range(4):
        paths = [(*p, s) for p in paths for s in near[p[-1]] if s not in p]
        want |= {("-".join(map(str, p)), len(p), sum(kills[s] for s in p)) for p in paths if p[0] < p[-1]}
    got = Q["threat_corridors"](spark, SF).collect()
    assert {(r.path, r.length, r.kills) for r in got} == want and len(got) == len(want)
    assert {r.length for r in got} == {2, 3, 4, 5}


def test_evidence_four_hops_away(spark):
    e = spark.createDataFrame([(k, k + 1, 0.5) for k in range(1, 6)], "src long, dst long, w double")
    got = G.evidence_paths(e, spark.createDataFrame([(1,), (2,)], "source long"), spark.createDataFrame([(6,)], "target long")).collect()
    assert [(r.source, r.hops) for r in got] == [(2, 4)]


def test_both_sides_hold_every_row(spark):
    got = [tuple(r) for r in Q["insert_if_absent"](spark, SF).select("c_custkey", "c_name").collect()]
    assert sorted(got) == sorted(sql("SELECT c_custkey, c_name FROM customer"))
    got = [tuple(r) for r in Q["upsert_merge"](spark, SF).select("user_id", "n", "last_seen").collect()]
    assert sorted(got) == sorted(sql("SELECT user_id, count(*), max(ts) FROM events GROUP BY 1"))
