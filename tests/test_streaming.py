import datetime as dt

from pyspark.sql import functions as F

from lodestar.plans.profiles import lifecycle
from lodestar.streaming import flows as S

T0 = dt.datetime(2024, 1, 1)


def write(spark, path, rows, name):
    df = spark.createDataFrame([(i, T0 + dt.timedelta(seconds=s), u, "view", float(v), "{}") for i, s, u, v in rows], "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")
    df.coalesce(1).write.mode("append").parquet(str(path))


def test_stream_equals_batch_and_resumes(spark, tmp_path):
    src, out = tmp_path / "in", []
    sink = lambda b, n: out.extend((n, r.event_id) for r in b.collect())
    write(spark, src, [(1, 0, 1, 1), (2, 60, 2, 2), (1, 0, 1, 1)], "a")
    flow = lambda: S.deduplicated(S.events(spark, str(src)))
    S.run_once(flow(), str(tmp_path / "cp"), sink)
    write(spark, src, [(2, 60, 2, 2), (3, 120, 3, 3)], "b")
    S.run_once(flow(), str(tmp_path / "cp"), sink)
    assert sorted(i for _, i in out) == [1, 2, 3]


def test_bucketed_complete(spark, tmp_path):
    src, out = tmp_path / "in", {}
    write(spark, src, [(1, 0, 1, 1), (2, 3599, 11, 2), (3, 3600, 1, 5), (4, 90_000 * 5, 2, 1)], "a")

    def sink(b, n):
        out.update({(r.bucket, r.system_id): (r.n, r.value) for r in b.collect()})

    S.run_once(S.bucketed(S.events(spark, str(src)), repair="1 hour"), str(tmp_path / "cp"), sink, "update")
    assert out[T0, 1] == (2, 3.0) and out[T0 + dt.timedelta(hours=1), 1] == (1, 5.0)


def test_sessions(spark, tmp_path):
    src, out = tmp_path / "in", []
    write(spark, src, [(1, 0, 1, 1), (2, 1800, 1, 1), (3, 9000, 1, 1), (4, 10**6, 3, 1), (5, 2 * 10**6, 3, 1)], "a")
    S.run_once(S.sessions(S.events(spark, str(src)), repair="1 hour"), str(tmp_path / "cp"), lambda b, n: out.extend((r.system_id, r.n) for r in b.collect()))
    assert (1, 2) in out and (1, 1) in out


def test_classified(spark):
    raw = spark.createDataFrame([('{"killmail_id": 5}',), ("{}",), ("[1",), ("text",)], "payload string")
    assert [r.kind for r in S.classified(raw, "killmail_id long", "killmail_id").collect()] == ["valid", "non_actionable", "malformed", "malformed"]


def test_horizon_and_cursor(spark):
    rows = [("a", False, True, T0, "5", "4", 0), ("b", True, True, T0, "4", "4", 2), ("c", True, False, T0, "5", "4", 0), ("d", True, True, T0, "5", "4", 0), ("e", True, True, T0 - dt.timedelta(hours=2), "3", "4", 0)]
    st = spark.createDataFrame(rows, "dataset_key string, enabled boolean, backfill_done boolean, watermark timestamp, cursor string, previous_cursor string, stall_count int")
    got = {r.dataset_key: r for r in S.horizon(st, T0 + dt.timedelta(minutes=5)).collect()}
    assert {k: r.status for k, r in got.items()} == {"a": "stopped", "b": "stalled", "c": "backfilling", "d": "caught_up", "e": "catching_up"}
    assert got["e"].cursor == "4"  # never goes back
    df = spark.createDataFrame([(i, T0 + dt.timedelta(seconds=s)) for i, s in ((1, 0), (2, 10), (3, 10), (4, 20))], "id long, ts timestamp")
    ids = lambda d: sorted(r.id for r in d.collect())
    assert ids(S.since(df, "ts", "id", (T0 + dt.timedelta(seconds=10), 2))) == [3, 4]
    assert ids(S.since(df, "ts", "id", (T0 + dt.timedelta(seconds=10), 2), 10)) == [1, 2, 3, 4]


def test_lifecycle_states(spark):
    day = lambda n: dt.date(2024, 1, n)
    prev = spark.createDataFrame([(1, "active", 0.5, day(1)), (2, "suppressed", 0.5, day(1)), (3, "active", 0.5, day(9)), (4, "resolved", 0.5, day(1)), (5, "resolved", 0.5, day(1))], "key long, state string, severity double, last_at date")
    cand = spark.createDataFrame([(1, 0.9, day(10)), (2, 0.9, day(10)), (4, 0.5, day(10)), (6, 0.4, day(10))], "key long, severity double, at date")
    as_of = spark.createDataFrame([(day(10),)], "as_of date")
    assert {r.key: r.state for r in lifecycle(prev, cand, as_of).collect()} == {1: "escalated", 2: "suppressed", 3: "resolved", 4: "active", 5: "expired", 6: "active"}


def test_cursor_reset_and_backfill(spark):
    df = spark.createDataFrame([("a", 5, True), ("a", 9, True), ("b", 3, False), ("b", 8, True)], "dataset_key string, id long, done boolean")
    st = spark.createDataFrame([("a", 20), ("b", 8), ("c", 4)], "dataset_key string, cursor long")
    assert {r.dataset_key: (r.cursor, r.was_reset) for r in S.cursor_reset(df, st, "id").collect()} == {"a": (9, True), "b": (2, True), "c": (4, False)}
    old = T0 - dt.timedelta(days=2)
    st = spark.createDataFrame([("a", T0, 1, None), ("b", T0, 0, None), ("c", T0, 0, T0), ("d", T0, 0, old), ("e", old, 0, old)], "dataset_key string, watermark timestamp, gaps int, proposed_at timestamp")
    assert {r.dataset_key: r.verdict for r in S.backfill_verdicts(st, T0 + dt.timedelta(minutes=1)).collect()} == {"a": "running", "b": "proposed", "c": "soaking", "d": "approved", "e": "running"}
