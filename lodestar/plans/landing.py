"""Queries of the landing side: archives, payload classes, increments, versioned tables, streams with late and repeated rows, cursors."""

from __future__ import annotations

import io
import tarfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.functions.kernels import exact_sum, rnd, tier
from lodestar.operators import block_pairs as B
from lodestar.operators import fits, graph as G
from lodestar.plans.incremental import shared
from lodestar.plans.registry import query
from lodestar.sources import readers, sinks
from lodestar.sources import views as V
from lodestar.streaming import flows as S


def payloads(spark: SparkSession, d: str) -> DataFrame:
    """Killmails as JSON payloads, half of them nested: month, sequence_id, payload."""
    km = V.killmails(spark, d)
    p = F.struct(
        F.col("sequence_id").alias("killmail_id"), F.date_format("killmail_time", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("killmail_time"), F.col("system_id").cast("bigint").alias("solar_system_id"),
        F.struct(F.col("victim_character_id").alias("character_id")).alias("victim"), F.struct(F.col("total_value").alias("totalValue")).alias("zkb"),
    )
    text = F.when(F.col("sequence_id") % 2 == 0, F.to_json(p)).otherwise(F.to_json(F.struct(p.alias("killmail"))))
    return km.select(F.date_format("killmail_time", "yyyy-MM").alias("month"), "sequence_id", text.alias("payload"))


@query("archive_events", V.ctes("km") + """SELECT sequence_id, killmail_time, CAST(system_id AS BIGINT) AS system_id, round(total_value, 4) AS total_value FROM km""")
def archive_events(spark: SparkSession, d: str) -> DataFrame:
    """Archives of payloads, one a month, read member by member and normalised; each has a payload twice and one that is no JSON."""

    def pack(pdf):
        import pandas as pd

        buf = io.BytesIO()
        with tarfile.open(fileobj=buf, mode="w:gz") as tar:
            for name, text in [*zip(pdf.sequence_id, pdf.payload), ("again", pdf.payload.iloc[0]), ("bad", "{no json")]:
                info = tarfile.TarInfo(f"{name}.json")
                info.size = len(text.encode())
                tar.addfile(info, io.BytesIO(text.encode()))
        return pd.DataFrame({"path": [f"{pdf.month.iloc[0]}.tar.gz"], "content": [buf.getvalue()]})

    tars = payloads(spark, d).groupBy("month").applyInPandas(pack, "path string, content binary")
    return readers.normalised(readers.members(tars)).select("sequence_id", "killmail_time", "system_id", rnd("total_value").alias("total_value"))


@query("payload_classes", """SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'malformed' WHEN 1 THEN 'non_actionable' WHEN 2 THEN 'malformed' ELSE 'valid' END AS kind, CASE WHEN event_id % 4 = 3 THEN event_id END AS killmail_id FROM events""")
def payload_classes(spark: SparkSession, d: str) -> DataFrame:
    """Payload text as valid, empty or malformed."""
    e, i = V.read(spark, d, "events").select("event_id"), F.col("event_id")
    text = F.when(i % 4 == 0, F.lit('{"killmail_id": 5')).when(i % 4 == 1, F.lit("{}")).when(i % 4 == 2, F.lit("no json")).otherwise(F.concat(F.lit('{"killmail_id": '), i.cast("string"), F.lit("}")))
    return S.classified(e.withColumn("payload", text), "killmail_id long", "killmail_id").select("event_id", "kind", F.col("j.killmail_id").alias("killmail_id"))


@query("keyset_increment", "SELECT event_id, ts FROM events WHERE event_id > (SELECT max(event_id) // 2 FROM events)")
def keyset_increment(spark: SparkSession, d: str) -> DataFrame:
    """What lies past a cursor, pushed down to the scan."""
    e = V.read(spark, d, "events").select("event_id", "ts")
    return readers.after(e, "event_id", e.agg(F.max("event_id")).first()[0] // 2)


@query("bridge_pairs", "SELECT DISTINCT least(a.n_name, b.n_name) AS a, greatest(a.n_name, b.n_name) AS b FROM nation a JOIN nation b ON b.n_nationkey = (a.n_nationkey + 1) % 25 WHERE a.n_name <> b.n_name")
def bridge_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Free-text lists of pairs in several notations and both directions, with comments."""
    n = V.read(spark, d, "nation").select("n_nationkey", "n_name")
    p = n.join(n.toDF("k", "other"), (F.col("n_nationkey") + 1) % 25 == F.col("k"))
    arrow = F.element_at(F.array(*map(F.lit, (" » ", " --> ", " -> ", " => "))), (F.col("n_nationkey") % 4 + 1).cast("int"))
    lines = p.select(F.explode(F.array(F.concat("n_name", arrow, "other"), F.concat("other", F.lit(" » "), "n_name", F.lit("   note")), F.lit("# list"), F.lit("nothing"))).alias("value"))
    path = shared(spark, "bridges")
    lines.write.text(path)
    return readers.bridge_lists(spark, path)


@query("dimension_lookup", "SELECT l_orderkey, l_linenumber, l_partkey, p_brand, count(*) AS n FROM lineitem LEFT JOIN part ON p_partkey = l_partkey GROUP BY 1, 2, 3, 4")
def dimension_lookup(spark: SparkSession, d: str) -> DataFrame:
    """A dimension joined by broadcast if its counted size allows."""
    dim = readers.dimension(V.read(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey")
    return V.read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").join(dim, "l_partkey", "left").groupBy("l_orderkey", "l_linenumber", "l_partkey", "p_brand").agg(F.count(F.lit(1)).alias("n"))


_BOOK = "SELECT l_suppkey AS source_id, l_partkey AS type_id, count(*) AS n, min(l_shipdate) AS first_at, max(l_shipdate) AS last_at FROM lineitem"


def book(df: DataFrame) -> DataFrame:
    return df.groupBy(F.col("l_suppkey").alias("source_id"), F.col("l_partkey").alias("type_id")).agg(F.count(F.lit(1)).alias("n"), F.min("l_shipdate").alias("first_at"), F.max("l_shipdate").alias("last_at"))


@query("book_replaced_by_source", f"""WITH o AS ({_BOOK} WHERE l_linestatus = 'F' GROUP BY 1, 2), n AS ({_BOOK} WHERE l_linestatus = 'O' AND l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_nationkey < 12) GROUP BY 1, 2)
SELECT * FROM n UNION ALL SELECT * FROM o WHERE source_id NOT IN (SELECT source_id FROM n)""")
def book_replaced_by_source(spark: SparkSession, d: str) -> DataFrame:
    """The current book in a versioned table: what a new reading has of a source replaces all of that source, other sources stay."""
    li = V.read(spark, d, "lineitem")
    some = V.read(spark, d, "supplier").where("s_nationkey < 12").select(F.col("s_suppkey").alias("l_suppkey"))
    t = sinks.Table(spark, shared(spark, "book"))
    t.refresh(book(li.where("l_linestatus = 'F'")))
    t.replace_where(book(li.where("l_linestatus = 'O'").join(some, "l_suppkey", "left_semi")), ["source_id"])
    return t.read()


@query("table_writes", f"""WITH o AS ({_BOOK} WHERE l_linestatus = 'F' GROUP BY 1, 2), n AS ({_BOOK} WHERE l_linestatus = 'O' GROUP BY 1, 2),
u AS (SELECT coalesce(o.source_id, n.source_id) AS source_id, coalesce(o.type_id, n.type_id) AS type_id, coalesce(o.n, 0) + coalesce(n.n, 0) AS n, coalesce(o.first_at, n.first_at) AS first_at, greatest(o.last_at, n.last_at) AS last_at FROM o FULL JOIN n ON o.source_id = n.source_id AND o.type_id = n.type_id)
SELECT * FROM u WHERE type_id IN (SELECT p_partkey FROM part WHERE p_size <= 40) AND last_at >= (SELECT max(l_shipdate) FROM lineitem) - INTERVAL 2000 DAY""")
def table_writes(spark: SparkSession, d: str) -> DataFrame:
    """Refresh, accumulating upsert, insert if absent, deletion of what is gone, and retention, one after the other on one table."""
    li = V.read(spark, d, "lineitem")
    t = sinks.Table(spark, shared(spark, "writes"))
    new = book(li.where("l_linestatus = 'O'"))
    t.refresh(book(li.where("l_linestatus = 'F'")))
    t.upsert(new, ["source_id", "type_id"], add=["n"], keep_first=["first_at"], greatest=["last_at"])
    t.insert_absent(new, ["source_id", "type_id"])
    t.delete_absent(V.read(spark, d, "part").where("p_size <= 40").select(F.col("p_partkey").alias("type_id")), ["type_id"])
    t.retain(F.col("last_at") >= F.lit(li.agg(F.max("l_shipdate")).first()[0]) - F.expr("INTERVAL 2000 DAYS"))
    return t.read()


@query("snapshot_payloads", """SELECT l_suppkey AS source_id, CAST(to_json(list({'n': l_quantity::BIGINT, 'type_id': l_partkey} ORDER BY l_quantity::BIGINT, l_partkey)) AS VARCHAR) AS payload, TIMESTAMP '2024-01-01 00:05:00' AS expires_at FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1""")
def snapshot_payloads(spark: SparkSession, d: str) -> DataFrame:
    """One row a key with its rows as JSON and the time it ends."""
    li = V.read(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_suppkey").alias("source_id"), F.col("l_quantity").cast("bigint").alias("n"), F.col("l_partkey").alias("type_id"))
    return sinks.snapshot(li, "source_id", "2024-01-01 00:00:00", 300)


@query("rebuilt_from_raw", V.ctes("mo") + """, o AS (SELECT source_type, source_id, type_id, CAST(observed_at AS DATE) AS day, min(CASE WHEN NOT is_buy_order THEN price END) AS ask, max(CASE WHEN is_buy_order THEN price END) AS bid, sum(volume_remain) AS volume, count(*) AS n FROM mo GROUP BY ALL),
r AS (SELECT source_type, type_id, date_trunc('month', day) AS month, min(ask) AS low, max(ask) AS high, CAST(sum(volume) AS BIGINT) AS volume, CAST(sum(n) AS BIGINT) AS n FROM o GROUP BY ALL)
SELECT 'projection' AS layer, source_type, type_id, CAST(day AS VARCHAR) AS at, round(min(ask), 4) AS low, round(max(bid), 4) AS high, CAST(sum(volume) AS BIGINT) AS volume, CAST(sum(n) AS BIGINT) AS n FROM o GROUP BY ALL
UNION ALL SELECT 'rollup', source_type, type_id, CAST(CAST(month AS DATE) AS VARCHAR), round(low, 4), round(high, 4), volume, n FROM r""")
def rebuilt_from_raw(spark: SparkSession, d: str) -> DataFrame:
    """All layers anew from raw orders: the book by source and day is written once, daily projections and monthly rollups come from it."""
    mo = V.market_orders(spark, d)
    raw = mo.groupBy("source_type", "source_id", "type_id", F.to_date("observed_at").alias("day")).agg(
        F.min(F.when(~F.col("is_buy_order"), F.col("price"))).alias("ask"), F.max(F.when(F.col("is_buy_order"), F.col("price"))).alias("bid"), F.sum("volume_remain").alias("volume"), F.count(F.lit(1)).alias("n")
    )
    t = sinks.Table(spark, shared(spark, "rebuilt"))
    t.refresh(raw)
    o = t.read()
    out = lambda layer, at, high: o.groupBy("source_type", "type_id", at.cast("string").alias("at")).agg(rnd(F.min("ask")).alias("low"), rnd(F.max(high)).alias("high"), F.sum("volume").alias("volume"), F.sum("n").alias("n")).withColumn("layer", F.lit(layer))
    cols = ["layer", "source_type", "type_id", "at", "low", "high", "volume", "n"]
    return out("projection", F.col("day"), "bid").select(*cols).unionByName(out("rollup", F.trunc("day", "month"), "ask").select(*cols))


@query("deduplicated_stream", "SELECT event_id, ts, event_type FROM events")
def deduplicated_stream(spark: SparkSession, d: str) -> DataFrame:
    """A stream that brings every event twice, each kept once within the repair window."""
    root = shared(spark, "dedupe")
    e = spark.read.parquet(f"{d}/events.parquet")
    for k in (1, 2):
        e.coalesce(2).write.mode("append").parquet(f"{root}/in")
    S.run_once(S.deduplicated(S.events(spark, f"{root}/in", 1), repair="60 days"), f"{root}/checkpoint", lambda b, n: b.write.mode("overwrite").parquet(f"{root}/out/batch={n}"))
    return spark.read.parquet(f"{root}/out").select("event_id", "ts", "event_type")


@query("reinforced_stream", "SELECT user_id, min(ts) AS first_seen, max(ts) AS last_reinforced, count(*) AS times FROM events GROUP BY 1")
def reinforced_stream(spark: SparkSession, d: str) -> DataFrame:
    """Running first seen, last reinforced and count of each character: updates of a stream, the last of each kept."""
    root = shared(spark, "reinforced")
    V.read(spark, d, "events").repartition(3).withColumn("ts", F.col("ts").cast("timestamp_ntz")).write.parquet(f"{root}/in")
    S.run_once(S.reinforced(S.events(spark, f"{root}/in", 1)), f"{root}/checkpoint", lambda b, n: b.write.mode("overwrite").parquet(f"{root}/out/batch={n}"), "update")
    got = spark.read.parquet(f"{root}/out")
    last = F.max_by(F.struct("first_seen", "last_reinforced", "times"), "times")
    return got.groupBy("user_id").agg(last.alias("s")).select("user_id", "s.*")


@query("session_stream", V.ctes("es") + """, g AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w < 2700000000 THEN 0 ELSE 1 END AS fresh FROM es WINDOW w AS (PARTITION BY system_id ORDER BY ts, event_id)),
i AS (SELECT *, sum(fresh) OVER (PARTITION BY system_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT system_id, min(ts) AS start_at, max(ts) + INTERVAL 45 MINUTE AS end_at, count(*) AS n FROM i GROUP BY system_id, k""")
def session_stream(spark: SparkSession, d: str) -> DataFrame:
    """Sessions of a system over a stream: all files are one batch, so none is late; rows far ahead close the sessions.

    A gap of 45 minutes begins a session, where a session window still merges, so its gap is a microsecond less.
    """
    root = shared(spark, "sessions")
    e = V.read(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    for k in (1, 2, 3):  # the watermark moves after a batch, and what it closes comes with the next
        part = e if k == 1 else e.limit(1).withColumn("ts", F.expr(f"timestamp_ntz'2100-01-0{k} 00:00:00'"))
        part.write.parquet(f"{root}/in/part={k}")
        stream = S.sessions(S.events(spark, f"{root}/in/part=*", 2**31 - 1), "44 minutes 59 seconds 999999 microseconds", repair="1 hour")
        S.run_once(stream, f"{root}/checkpoint", lambda b, n: b.write.mode("overwrite").parquet(f"{root}/out/batch={n}"))
    got = spark.read.parquet(f"{root}/out").where("start_at < timestamp'2100-01-01 00:00:00'")
    return got.select("system_id", "start_at", (F.col("end_at") + F.expr("INTERVAL 1 MICROSECOND")).alias("end_at"), "n")


@query("cursor_with_repair", """WITH c AS (SELECT ts, event_id FROM events ORDER BY ts, event_id LIMIT 1 OFFSET (SELECT count(*) // 2 FROM events)),
p AS (SELECT e.event_id, e.ts FROM events e, c WHERE e.ts > c.ts OR e.ts = c.ts AND e.event_id > c.event_id), r AS (SELECT e.event_id, e.ts FROM events e, c WHERE e.ts >= c.ts - INTERVAL 3600 SECOND)
SELECT 'after' AS kind, * FROM p UNION ALL SELECT 'repair', * FROM r""")
def cursor_with_repair(spark: SparkSession, d: str) -> DataFrame:
    """Rows past a (time, id) cursor, and with a repair window of an hour before it."""
    e = V.read(spark, d, "events").select("event_id", "ts")
    n = e.count()
    at = e.orderBy("ts", "event_id").offset(n // 2).limit(1).first()
    past = lambda seconds: S.since(e, "ts", "event_id", (at.ts, at.event_id), seconds)
    return past(0).select(F.lit("after").alias("kind"), "*").union(past(3600).select(F.lit("repair").alias("kind"), "*"))


_STATE = """s AS (SELECT concat(event_type, ':', user_id % 10) AS dataset_key, event_type <> 'error' AS enabled, user_id % 10 <> 3 AS backfill_done, max(ts) AS watermark, CAST(max(event_id) AS BIGINT) AS top, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY event_type, user_id % 10), m AS (SELECT max(ts) AS m FROM events)"""


def dataset_state(spark: SparkSession, d: str) -> DataFrame:
    """States of made-up datasets, one a type and system: dataset_key, enabled, backfill_done, watermark, top, n."""
    e = V.read(spark, d, "events").withColumn("k", F.col("user_id") % 10)
    g = e.groupBy("event_type", "k").agg(F.max("ts").alias("watermark"), F.max("event_id").alias("top"), F.count(F.lit(1)).alias("n"))
    return g.select(F.concat_ws(":", "event_type", F.col("k").cast("string")).alias("dataset_key"), (F.col("event_type") != "error").alias("enabled"), (F.col("k") != 3).alias("backfill_done"), "watermark", "top", "n")


@query("freshness_states", f"WITH {_STATE}" + """ SELECT dataset_key, CAST(floor(epoch(m)) - floor(epoch(watermark)) AS BIGINT) AS lag_seconds, CAST(CASE WHEN n % 3 = 0 THEN 3 ELSE 0 END AS INTEGER) AS stall_count,
CASE WHEN NOT enabled THEN 'stopped' WHEN n % 3 = 0 THEN 'stalled' WHEN NOT backfill_done THEN 'backfilling' WHEN floor(epoch(m)) - floor(epoch(watermark)) <= 43200 THEN 'caught_up' ELSE 'catching_up' END AS status FROM s, m""")
def freshness_states(spark: SparkSession, d: str) -> DataFrame:
    """All five states: switched off, a cursor that has not moved for three rounds, in backfill, fresh, behind."""
    s = dataset_state(spark, d)
    as_of = s.agg(F.max("watermark")).first()[0]
    stuck = F.col("n") % 3 == 0
    state = s.select("dataset_key", "enabled", "backfill_done", "watermark", F.lit("5").alias("cursor"), F.when(stuck, "5").otherwise("4").alias("previous_cursor"), F.when(stuck, 2).otherwise(0).alias("stall_count"))
    return S.horizon(state, as_of, fresh_seconds=43_200).select("dataset_key", "lag_seconds", F.col("stall_count").cast("int").alias("stall_count"), "status")


@query("cursors_reset", f"WITH {_STATE}" + """, r AS (SELECT concat(event_type, ':', user_id % 10) AS dataset_key, max(event_id) AS most, min(CASE WHEN event_id % 997 = 5 THEN event_id END) AS open_id FROM events GROUP BY 1),
c AS (SELECT dataset_key, top + CASE WHEN n % 2 = 0 THEN 1000 ELSE -1 END AS cursor FROM s)
SELECT dataset_key, CAST(least(cursor, most, coalesce(open_id - 1, cursor)) AS BIGINT) AS cursor, least(cursor, most, coalesce(open_id - 1, cursor)) < cursor AS was_reset FROM c JOIN r USING (dataset_key)""")
def cursors_reset(spark: SparkSession, d: str) -> DataFrame:
    """Cursors past the data, or past rows that are not done, go back."""
    rows = V.read(spark, d, "events").select(F.concat_ws(":", "event_type", (F.col("user_id") % 10).cast("string")).alias("dataset_key"), "event_id", (F.col("event_id") % 997 != 5).alias("done"))
    state = dataset_state(spark, d).select("dataset_key", (F.col("top") + F.when(F.col("n") % 2 == 0, 1000).otherwise(-1)).alias("cursor"))
    return S.cursor_reset(rows, state, "event_id")


@query("backfill_states", f"WITH {_STATE}" + """, b AS (SELECT dataset_key, floor(epoch(m)) - floor(epoch(watermark)) <= 43200 AND n % 4 <> 0 AS ready, CASE n % 3 WHEN 0 THEN NULL WHEN 1 THEN m - INTERVAL 2 HOUR ELSE m - INTERVAL 30 HOUR END AS proposed_at, m FROM s, m)
SELECT dataset_key, CASE WHEN NOT ready THEN 'running' WHEN proposed_at IS NULL THEN 'proposed' WHEN floor(epoch(m)) - floor(epoch(proposed_at)) >= 86400 THEN 'approved' ELSE 'soaking' END AS verdict, CASE WHEN ready THEN coalesce(proposed_at, m) END AS next_proposed_at FROM b""")
def backfill_states(spark: SparkSession, d: str) -> DataFrame:
    """Backfills as running, proposed, soaking or approved."""
    s = dataset_state(spark, d)
    as_of = s.agg(F.max("watermark")).first()[0]
    now, k = F.lit(as_of).cast("timestamp"), F.col("n") % 3
    ago = F.when(k == 1, now - F.expr("INTERVAL 2 HOURS")).when(k == 2, now - F.expr("INTERVAL 30 HOURS"))
    state = s.select("dataset_key", "watermark", F.when(F.col("n") % 4 == 0, 1).otherwise(0).alias("gaps"), ago.alias("proposed_at"))
    return S.backfill_verdicts(state, as_of, fresh_seconds=43_200).select("dataset_key", "verdict", "next_proposed_at")


@query("stale_recomputed", V.ctes("es") + """, g AS (SELECT character_id, count(*) AS n, max(ts) AS last_at, round(CAST(sum(CAST(damage AS DECIMAL(20,4))) AS DOUBLE), 4) AS damage FROM es GROUP BY 1), t AS (SELECT max(ts) - INTERVAL 1 DAY AS c FROM es),
o AS (SELECT character_id, count(*) AS n, round(CAST(sum(CAST(damage AS DECIMAL(20,4))) AS DOUBLE), 4) AS damage FROM es, t WHERE ts <= c GROUP BY 1)
SELECT g.character_id, g.n, g.damage, g.last_at > c AS recomputed FROM g, t""")
def stale_recomputed(spark: SparkSession, d: str) -> DataFrame:
    """Results of a day ago, of which only those with newer events are computed anew; the others are kept as they are."""
    e = V.event_stream(spark, d)
    cut = e.agg(F.max("ts") - F.expr("INTERVAL 1 DAY")).first()[0]
    agg = lambda df, new: df.groupBy("character_id").agg(F.count(F.lit(1)).alias("n"), rnd(exact_sum(F.col("damage"))).alias("damage")).withColumn("recomputed", F.lit(new))
    t = sinks.Table(spark, shared(spark, "stale"))
    t.refresh(agg(e.where(F.col("ts") <= F.lit(cut)), False))
    stale = e.where(F.col("ts") > F.lit(cut)).select("character_id").distinct()
    t.upsert(agg(e.join(stale, "character_id", "left_semi"), True), ["character_id"])
    return t.read()


@query("alerts_by_priority", """WITH a AS (SELECT o_orderkey, o_custkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'critical' WHEN '2-HIGH' THEN 'warning' WHEN '3-MEDIUM' THEN 'notice' ELSE 'info' END AS severity, o_orderdate FROM orders WHERE o_orderstatus = 'O'),
r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE severity WHEN 'critical' THEN 0 WHEN 'warning' THEN 1 WHEN 'notice' THEN 2 ELSE 3 END, o_orderdate DESC, o_orderkey) AS place FROM a) SELECT o_custkey, CAST(place AS INTEGER) AS place, o_orderkey, severity FROM r WHERE place <= 3""")
def alerts_by_priority(spark: SparkSession, d: str) -> DataFrame:
    """The three first of each customer in an order given by CASE, then the newest."""
    p = F.col("o_orderpriority")
    severity = F.when(p == "1-URGENT", "critical").when(p == "2-HIGH", "warning").when(p == "3-MEDIUM", "notice").otherwise("info")
    a = V.read(spark, d, "orders").where("o_orderstatus = 'O'").select("o_orderkey", "o_custkey", severity.alias("severity"), "o_orderdate")
    first = F.when(F.col("severity") == "critical", 0).when(F.col("severity") == "warning", 1).when(F.col("severity") == "notice", 2).otherwise(3)
    w = Window.partitionBy("o_custkey").orderBy(first, F.desc("o_orderdate"), "o_orderkey")
    return a.withColumn("place", F.row_number().over(w)).where("place <= 3").select("o_custkey", "place", "o_orderkey", "severity")


@query("weekday_histogram", V.ctes("es") + "SELECT character_id, CAST(dayofweek(ts) + 1 AS INTEGER) AS weekday, count(*) AS n FROM es GROUP BY 1, 2")
def weekday_histogram(spark: SparkSession, d: str) -> DataFrame:
    return V.event_stream(spark, d).groupBy("character_id", F.dayofweek("ts").alias("weekday")).agg(F.count(F.lit(1)).alias("n"))


@query("character_profile", V.ctes("es") + """, s AS (SELECT character_id, system_id, count(*) AS n FROM es GROUP BY 1, 2), h AS (SELECT character_id, ship_type_id, count(*) AS n FROM es GROUP BY 1, 2), d AS (SELECT character_id, CAST(ts AS DATE) AS day, count(*) AS n FROM es GROUP BY 1, 2)
SELECT character_id, 'system' AS section, CAST(rn AS INTEGER) AS place, CAST(system_id AS VARCHAR) AS label, n FROM (SELECT *, row_number() OVER (PARTITION BY character_id ORDER BY n DESC, system_id) AS rn FROM s) WHERE rn <= 3
UNION ALL SELECT character_id, 'hull', CAST(rn AS INTEGER), CAST(ship_type_id AS VARCHAR), n FROM (SELECT *, row_number() OVER (PARTITION BY character_id ORDER BY n DESC, ship_type_id) AS rn FROM h) WHERE rn <= 5
UNION ALL SELECT character_id, 'recent', CAST(rn AS INTEGER), CAST(day AS VARCHAR), n FROM (SELECT *, row_number() OVER (PARTITION BY character_id ORDER BY day DESC) AS rn FROM d) WHERE rn <= 7
UNION ALL SELECT character_id, 'total', 1, 'events', count(*) FROM es GROUP BY 1""")
def character_profile(spark: SparkSession, d: str) -> DataFrame:
    """A character's page as one result: sections of top systems, top hulls, latest days and totals."""
    es = V.event_stream(spark, d)

    def section(name: str, key, most: int, newest: bool = False) -> DataFrame:
        g = es.groupBy("character_id", key.alias("k")).agg(F.count(F.lit(1)).alias("n"))
        order = [F.desc("k")] if newest else [F.desc("n"), F.col("k")]
        g = g.withColumn("place", F.row_number().over(Window.partitionBy("character_id").orderBy(*order))).where(F.col("place") <= most)
        return g.select("character_id", F.lit(name).alias("section"), "place", F.col("k").cast("string").alias("label"), "n")

    total = es.groupBy("character_id").agg(F.count(F.lit(1)).alias("n")).select("character_id", F.lit("total").alias("section"), F.lit(1).alias("place"), F.lit("events").alias("label"), "n")
    out = section("system", F.col("system_id"), 3).union(section("hull", F.col("ship_type_id"), 5)).union(section("recent", F.to_date("ts"), 7, True))
    return out.union(total)


def fitted_hulls(spark: SparkSession, d: str) -> DataFrame:
    """Fits of the killmails: hull, fit, fingerprint and modules (small module numbers, so that fits repeat)."""
    li = V.read(spark, d, "lineitem").select(F.col("l_orderkey").alias("fit"), (F.col("l_partkey") % 9).cast("int").alias("module"))
    f = li.groupBy("fit").agg(F.array_sort(F.collect_set("module")).alias("modules"))
    return f.select((F.col("fit") % 5).cast("int").alias("hull"), "fit", F.array_join(F.col("modules").cast("array<string>"), ",").alias("fingerprint"), "modules")


@query("fit_family_merge")
def fit_family_merge(spark: SparkSession, d: str) -> DataFrame:
    """Families of like fits: the most frequent fingerprint first, each joins the first family whose founder it matches by Jaccard (a loop in the tests)."""
    g = fitted_hulls(spark, d).groupBy("hull", "fingerprint").agg(F.first("modules").alias("modules"), F.count(F.lit(1)).alias("n"))
    return fits.merge_families(g)


@query("doctrine_modules", """WITH f AS (SELECT DISTINCT l_orderkey % 5 AS family, l_orderkey AS fit, CAST(l_partkey % 9 AS INTEGER) AS module, count(*) AS qty FROM lineitem GROUP BY l_orderkey, l_partkey % 9), n AS (SELECT family, count(DISTINCT fit) AS fits FROM f GROUP BY 1)
SELECT CAST(family AS INTEGER) AS family, module, CAST(greatest(1, round_even(sum(qty) / max(fits), 0)) AS INTEGER) AS qty FROM f JOIN n USING (family) GROUP BY family, module HAVING count(DISTINCT fit) >= 0.3 * max(fits)""")
def doctrine_modules(spark: SparkSession, d: str) -> DataFrame:
    """Modules that a share of a family's fits has, with their rounded mean quantity."""
    li = V.read(spark, d, "lineitem")
    m = li.groupBy((F.col("l_orderkey") % 5).cast("int").alias("family"), F.col("l_orderkey").alias("fit"), (F.col("l_partkey") % 9).cast("int").alias("module")).agg(F.count(F.lit(1)).alias("qty"))
    return fits.canonical_modules(m, 0.3)


@query("one_to_one_matches")
def one_to_one_matches(spark: SparkSession, d: str) -> DataFrame:
    """Battles matched one to one with operations by shared pilots, best first (a loop in the tests)."""
    es = V.event_stream(spark, d).withColumn("day", F.to_date("ts"))
    a = es.where("side_key in ('click', 'view')").select(F.col("day").alias("a"), "character_id").distinct()
    b = es.where("side_key in ('error', 'purchase')").select(F.col("system_id").cast("bigint").alias("b"), "day", "character_id").distinct()
    pairs = a.join(b, (F.col("a") == F.col("day")) & (a.character_id == b.character_id)).groupBy(F.datediff("a", F.lit("2024-01-01")).cast("bigint").alias("a"), "b").agg(F.count(F.lit(1)).cast("double").alias("score"))
    return fits.match_greedy(G.cut(pairs))


@query("copresence_events", V.ctes("es") + """, p AS (SELECT DISTINCT system_id, date_trunc('hour', ts) AS h, character_id, side_key FROM es),
m AS (SELECT x.character_id AS a, y.character_id AS b, CASE WHEN x.side_key = y.side_key THEN 'same_side' ELSE 'same_battle' END AS kind FROM p x JOIN p y ON x.system_id = y.system_id AND x.h = y.h AND x.character_id < y.character_id),
d AS (SELECT DISTINCT system_id % 3 AS area, CAST(ts AS DATE) AS day, character_id, system_id FROM es), r AS (SELECT x.character_id AS a, y.character_id AS b, 'related_engagement' AS kind FROM d x JOIN d y ON x.area = y.area AND x.day = y.day AND x.character_id < y.character_id AND x.system_id <> y.system_id),
q AS (SELECT DISTINCT user_id AS character_id, CAST(date_trunc('week', ts) AS DATE) AS week, user_id % 7 AS org FROM events), s AS (SELECT x.character_id AS a, y.character_id AS b, 'same_organisation' AS kind FROM q x JOIN q y ON x.week = y.week AND x.org = y.org AND x.character_id < y.character_id),
c AS (SELECT DISTINCT system_id, CAST(ts AS DATE) AS day, character_id FROM es), k AS (SELECT x.character_id AS a, y.character_id AS b, 'same_system_day' AS kind FROM c x JOIN c y ON x.system_id = y.system_id AND x.day = y.day AND x.character_id < y.character_id),
z AS (SELECT * FROM m UNION ALL SELECT * FROM r UNION ALL SELECT * FROM s UNION ALL SELECT * FROM k)
SELECT a, b, kind, count(*) AS n, round(count(*) * CASE kind WHEN 'same_battle' THEN 1.0 WHEN 'same_side' THEN 1.5 WHEN 'related_engagement' THEN 0.6 WHEN 'same_organisation' THEN 1.2 ELSE 0.4 END, 4) AS weight FROM z GROUP BY a, b, kind HAVING count(*) >= 2""")
def copresence_events(spark: SparkSession, d: str) -> DataFrame:
    """Co-presence of five kinds with their weights: in one battle, on one side, in a related engagement, in one organisation, in one system on a day."""
    es = V.event_stream(spark, d)
    day, hour, week = F.unix_date(F.to_date("ts")), F.floor(F.unix_seconds("ts") / 3600), F.unix_date(F.to_date(F.date_trunc("week", "ts")))

    def nodes(space, item, *more) -> DataFrame:
        """Each character's spaces and the codes of what it has there, distinct with more."""
        rows = es.select("character_id", space.cast("long").alias("s"), item.alias("i"), *more).where("s is not null and i is not null").distinct()
        return rows.groupBy("character_id").agg(F.collect_set("s").alias("spaces"), F.collect_list(F.struct(B.code(F.col("s"), F.col("i")).alias("c"), *(c for c in rows.columns[3:]))).alias("z"))

    def met(df: DataFrame, kinds) -> DataFrame:
        """Rows of two nodes, the kind and n of two and more; kinds gives the counts of each kind for the pairs of two blocks."""

        def run(x, y, one):
            a, b = B.numbers(x, "character_id"), B.numbers(y, "character_id")
            for kind, n in kinds(x, y):
                ok = (n >= 2) & B.ordered(a, b, one)
                yield from B.runs({"node": a, "kind": pa.array([kind] * len(a))}, ok, {"others": b, "n": lambda r, c, n=n: n[r, c].astype(np.int32)}, ("node", "kind", "others", "n"))

        return B.unrolled(B.met_blocks(df, "character_id", run, "node long, kind string, others array<long>, n array<int>"), "others", "other", "n")

    def by_side(x, y):
        every = B.product(B.Rows.of(x, "codes"), B.Rows.of(y, "codes"))
        same = B.alike_elements(x, y, "codes", "sides")
        return ("same_side", same), ("same_battle", every - same)

    def by_place(x, y):
        place = B.product(B.Rows.of(x, "codes"), B.Rows.of(y, "codes"))
        return ("same_system_day", place), ("related_engagement", B.product(B.Rows.of(x, "areas"), B.Rows.of(y, "areas")) - place)

    def by_org(x, y):
        return (("same_organisation", B.product(B.Rows.of(x, "codes"), B.Rows.of(y, "codes"))),)

    battle = nodes(F.col("system_id"), hour, F.col("side_key").alias("side")).select("character_id", "spaces", F.col("z.c").alias("codes"), F.col("z.side").alias("sides"))
    # two of a system are of its area too: one product of areas holds both kinds
    near = nodes(F.col("system_id") % 3, day, F.col("system_id").alias("system")).select("character_id", "spaces", F.transform("z", lambda r: B.code(r["system"], r["c"].bitwiseAND(0xFFFFFFFF))).alias("codes"), F.col("z.c").alias("areas"))
    org = nodes(F.col("character_id") % 7, week).select("character_id", "spaces", F.col("z.c").alias("codes"))
    g = met(battle, by_side).union(met(near, by_place)).union(met(org, by_org)).select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b"), "kind", F.col("n").cast("long").alias("n"))
    k = F.col("kind")
    weight = F.when(k == "same_battle", 1.0).when(k == "same_side", 1.5).when(k == "related_engagement", 0.6).when(k == "same_organisation", 1.2).otherwise(0.4)
    return g.select("a", "b", "kind", "n", rnd(F.col("n") * weight).alias("weight"))


@query("event_severity", V.ctes("km") + """, t AS (SELECT quantile_disc(total_value, 0.5) AS mid, quantile_disc(total_value, 0.9) AS top FROM km) SELECT sequence_id, CASE WHEN total_value >= top THEN 'high' WHEN total_value >= mid THEN 'medium' ELSE 'low' END AS severity FROM km, t""")
def event_severity(spark: SparkSession, d: str) -> DataFrame:
    """Tiers by exact percentiles."""
    km = V.killmails(spark, d)
    at = km.agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY total_value) AS mid"), F.expr("percentile_disc(0.9) WITHIN GROUP (ORDER BY total_value) AS top")).first()
    return km.select("sequence_id", tier(F.col("total_value"), ((at.top, "high"), (at.mid, "medium")), "low").alias("severity"))
