import datetime as dt
import io
import json
import random
import tarfile

from pyspark.sql import functions as F

from lodestar.operators import fits
from lodestar.sources import readers, sinks


def test_archives_to_events(spark, tmp_path):
    km = {"killmail_id": 5, "killmail_time": "2024-01-01T10:00:00Z", "solar_system_id": 30, "victim": {"character_id": 1, "items": [{"item_type_id": 9, "quantity_destroyed": 2}]}, "attackers": [{"character_id": 2, "final_blow": True, "damage_done": 5.5}, {"character_id": 3}], "zkb": {"totalValue": 12.5}}
    with tarfile.open(tmp_path / "day.tar.bz2", "w:bz2") as t:
        for name, text in (("a.json", json.dumps(km)), ("b.json", json.dumps({"killmail": km | {"killmail_id": 6}})), ("c.json", "{bad"), ("d.txt", "x"), ("e.json", json.dumps(km))):
            info = tarfile.TarInfo(name)
            info.size = len(text)
            t.addfile(info, io.BytesIO(text.encode()))
    raw = readers.archive_texts(spark, str(tmp_path))
    assert raw.count() == 4
    ev = readers.normalised(raw)
    assert sorted((r.sequence_id, r.total_value, r.npc) for r in ev.collect()) == [(5, 12.5, False), (6, 12.5, False)]
    assert readers.attackers_of(ev).where("final_blow").count() == 2 and readers.items_of(ev).agg(F.sum("quantity_destroyed")).first()[0] == 4


def test_bridge_lists(spark, tmp_path):
    (tmp_path / "x.txt").write_text("# list\nA-1 » B 2\nB 2 --> A-1\nC -> D  note\nnothing\nE » E\n")
    assert sorted(map(tuple, readers.bridge_lists(spark, str(tmp_path)).collect())) == [("A-1", "B 2"), ("C", "D")]


def test_table_versions(spark, tmp_path):
    t = sinks.Table(spark, f"file://{tmp_path}/t")
    df = lambda *r: spark.createDataFrame(list(r), "src string, k int, n int")
    got = lambda: sorted(map(tuple, t.read().select("src", "k", "n").collect()))
    assert t.read() is None
    t.refresh(df(("a", 1, 1), ("a", 2, 2), ("b", 3, 3)))
    t.upsert(df(("a", 2, 5), ("c", 4, 4)), ["src", "k"], add=["n"])
    assert got() == [("a", 1, 1), ("a", 2, 7), ("b", 3, 3), ("c", 4, 4)]
    t.replace_where(df(("a", 9, 9)), ["src"])
    assert got() == [("a", 9, 9), ("b", 3, 3), ("c", 4, 4)]
    t.insert_absent(df(("b", 3, 99), ("d", 5, 5)), ["src", "k"])
    t.delete_absent(df(("a", 9, 0), ("b", 3, 0), ("d", 5, 0)), ["src", "k"])
    t.retain(F.col("n") > 3)
    assert got() == [("a", 9, 9), ("d", 5, 5)]


def test_encoders(spark):
    df = spark.createDataFrame([("a b", 1, dt.datetime(1970, 1, 1, 0, 0, 1)), ("a b", 2, dt.datetime(1970, 1, 1, 0, 0, 2))], "tag string, v int, ts timestamp")
    assert df.select(sinks.line_protocol("m", ["tag"], ["v"], "ts")).first()[0] == "m,tag=a\\ b v=1 1000000000"
    s = sinks.snapshot(df, "tag", "2024-01-01 00:00:00", 60).first()
    assert json.loads(s.payload)[0]["v"] == 1 and s.expires_at == dt.datetime(2024, 1, 1, 0, 1)
    a, b = (sinks.checksum(x, ["tag", "v"]).first() for x in (df, df.orderBy(F.desc("v"))))
    assert a == b and a.rows == 2


def test_families_and_modules(spark):
    x = spark.createDataFrame([(1, "p", list(range(10)), 5), (1, "q", list(range(9)), 3), (1, "r", [50, 51], 9), (2, "q", list(range(9)), 1)], "hull int, fingerprint string, modules array<int>, n long")
    assert {(r.hull, r.fingerprint): r.family for r in fits.merge_families(x).collect()} == {(1, "p"): "p", (1, "q"): "p", (1, "r"): "r", (2, "q"): "q"}
    m = spark.createDataFrame([("f", i, "gun", 2) for i in range(5)] + [("f", 0, "rare", 1)], "family string, fit int, module string, qty int")
    assert [tuple(r) for r in fits.canonical_modules(m).collect()] == [("f", "gun", 2)]


def test_matching_is_greedy(spark):
    rnd = random.Random(5)
    pairs = list({(rnd.randrange(12), rnd.randrange(12)): rnd.randrange(6) / 2 for _ in range(60)}.items())
    rows = [(a, b, s) for (a, b), s in pairs]
    used_a, used_b, want = set(), set(), []
    for a, b, s in sorted(rows, key=lambda r: (-r[2], r[0], r[1])):
        if a not in used_a and b not in used_b:
            want.append((a, b))
            used_a.add(a)
            used_b.add(b)
    got = fits.match_greedy(spark.createDataFrame(rows, "a int, b int, score double"))
    assert sorted((r.a, r.b) for r in got.collect()) == sorted(want)
