"""Incremental and write-side queries: rollups of the event stream, upserts, exports, retention, freshness."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions.kernels import exact_sum, rnd
from lodestar.operators import relational as R
from lodestar.operators.graph import is_local
from lodestar.plans.registry import query
from lodestar.sources.sinks import line_protocol
from lodestar.sources import views as V
from lodestar.streaming import flows as S

HOURLY = """SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS bucket, CAST(user_id % 10 AS INTEGER) AS system_id, count(*) AS n, count(DISTINCT user_id) AS pilots, round(CAST(sum(CAST(value AS DECIMAL(20,4))) AS DOUBLE), 4) AS value FROM events GROUP BY 1, 2"""


@query("events_rollup_1h", HOURLY)
def events_rollup_1h(spark: SparkSession, d: str) -> DataFrame:
    g = V.read(spark, d, "events").groupBy(F.window("ts", "1 hour").alias("w"), (F.col("user_id") % 10).cast("int").alias("system_id"))
    return g.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("pilots"), rnd(exact_sum(F.col("value"))).alias("value")).select(F.col("w.start").alias("bucket"), "system_id", "n", "pilots", "value")


@query("streamed_rollup_1h", """SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS bucket, CAST(user_id % 10 AS INTEGER) AS system_id, count(*) AS n, round(CAST(sum(CAST(value AS DECIMAL(20,4))) AS DOUBLE), 4) AS value FROM events GROUP BY 1, 2""")
def streamed_rollup_1h(spark: SparkSession, d: str) -> DataFrame:
    """The hourly rollup by Structured Streaming over what is there now: partial buckets per micro-batch, merged on read like an accumulating upsert."""
    root = shared(spark, "stream")

    def sink(batch: DataFrame, number: int) -> None:
        # a retried batch overwrites its own folder, so each counts once
        p = batch.groupBy(F.date_trunc("hour", "ts").alias("bucket"), (F.col("user_id") % 10).cast("int").alias("system_id")).agg(F.count(F.lit(1)).alias("n"), F.sum(rnd("value").cast("decimal(20,4)")).alias("value"))
        p.write.mode("overwrite").parquet(f"{root}/parts/batch={number}")

    src = spark.readStream.schema(S.EVENTS).parquet(f"{d}/events.parque[t]").withColumn("ts", F.col("ts").cast("timestamp"))
    S.run_once(src, f"{root}/checkpoint", sink)
    parts = spark.read.parquet(f"{root}/parts")
    return parts.groupBy("bucket", "system_id").agg(F.sum("n").alias("n"), rnd(F.sum("value").cast("double")).alias("value"))


def shared(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder of spark.checkpoint.dir; one of our own where that is unset (tests, local runs)."""
    import uuid

    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not is_local(spark):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        _OWN.append(tempfile.TemporaryDirectory(prefix="lodestar-"))
        root = f"file://{_OWN[-1].name}"
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


_OWN: list = []


@query("upsert_merge", """WITH o AS (SELECT user_id, min(ts) AS first_seen, max(ts) AS last_seen, count(*) AS n FROM events WHERE event_id % 2 = 0 GROUP BY 1), u AS (SELECT user_id, min(ts) AS first_seen, max(ts) AS last_seen, count(*) AS n FROM events WHERE event_id % 2 = 1 GROUP BY 1)
SELECT coalesce(o.user_id, u.user_id) AS user_id, coalesce(o.first_seen, u.first_seen) AS first_seen, greatest(o.last_seen, u.last_seen) AS last_seen, coalesce(o.n, 0) + coalesce(u.n, 0) AS n FROM o FULL JOIN u ON o.user_id = u.user_id""")  # fmt: skip
def upsert_merge(spark: SparkSession, d: str) -> DataFrame:
    """Accumulating upsert: first seen kept, last seen folded, counts added."""
    e = V.read(spark, d, "events")
    agg = lambda df: df.groupBy("user_id").agg(F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.count(F.lit(1)).alias("n"))
    return R.upsert(agg(e.where("event_id % 2 = 0")), agg(e.where("event_id % 2 = 1")), ["user_id"], keep_first=["first_seen"], greatest=["last_seen"], add=["n"])


@query("insert_if_absent", "SELECT c_custkey, c_name FROM customer WHERE c_custkey % 4 = 0 UNION ALL SELECT c_custkey, c_name FROM customer n WHERE (c_custkey % 4 <> 0 OR c_custkey % 6 = 0) AND NOT EXISTS (SELECT 1 FROM customer o WHERE o.c_custkey % 4 = 0 AND o.c_custkey = n.c_custkey)")
def insert_if_absent(spark: SparkSession, d: str) -> DataFrame:
    c = V.read(spark, d, "customer").select("c_custkey", "c_name")
    return R.insert_absent(c.where("c_custkey % 4 = 0"), c.where("c_custkey % 4 <> 0 or c_custkey % 6 = 0"), ["c_custkey"])


@query("spaced_events", V.ctes("es").replace("WITH", "WITH RECURSIVE", 1) + """, x AS (SELECT event_id, character_id, ts, row_number() OVER (PARTITION BY character_id ORDER BY ts, event_id) AS i FROM es),
n AS (SELECT a.character_id, a.i, min(b.i) AS nxt FROM x a JOIN x b ON a.character_id = b.character_id AND b.ts >= a.ts + INTERVAL 6 HOUR GROUP BY 1, 2),
r AS (SELECT character_id, CAST(1 AS BIGINT) AS i FROM x WHERE i = 1 UNION ALL SELECT n.character_id, n.nxt FROM r JOIN n ON n.character_id = r.character_id AND n.i = r.i)
SELECT event_id, x.character_id, ts FROM r JOIN x ON x.character_id = r.character_id AND x.i = r.i""")  # fmt: skip
def spaced_events(spark: SparkSession, d: str, seconds: int = 21_600) -> DataFrame:
    """Events at least `seconds` after the last kept one of their character."""
    return R.keep_spaced(V.event_stream(spark, d), "character_id", "ts", "event_id", seconds).select("event_id", "character_id", "ts")


@query("line_protocol_export", """SELECT event_id, concat('events,type=', event_type, '\\,\\ a\\=b,system=', user_id % 10, ' user=', user_id, 'i ', epoch_us(ts) * 1000) AS line FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 2 DAY""")
def line_protocol_export(spark: SparkSession, d: str) -> DataFrame:
    """Incremental export with an overlap, encoded as line protocol."""
    e = V.read(spark, d, "events")
    t = F.broadcast(e.agg(F.max("ts").alias("m")))
    rows = e.join(t, F.col("ts") >= F.col("m") - F.expr("INTERVAL 2 DAYS"))
    rows = rows.select("event_id", "ts", F.concat(F.col("event_type"), F.lit(", a=b")).alias("type"), (F.col("user_id") % 10).alias("system"), F.concat(F.col("user_id").cast("string"), F.lit("i")).alias("user"))
    return rows.select("event_id", line_protocol("events", ["type", "system"], ["user"], "ts").alias("line"))


@query("retention", "SELECT event_id, event_type, ts FROM events WHERE NOT (event_type = 'view' AND ts < (SELECT max(ts) FROM events) - INTERVAL 7 DAY OR event_type = 'error' AND ts < (SELECT max(ts) FROM events) - INTERVAL 14 DAY)")
def retention(spark: SparkSession, d: str) -> DataFrame:
    """What is left once old rows go, by type and age."""
    e = V.read(spark, d, "events").select("event_id", "event_type", "ts")
    t = F.broadcast(e.agg(F.max("ts").alias("m")))
    old = lambda k, n: (F.col("event_type") == k) & (F.col("ts") < F.col("m") - F.expr(f"INTERVAL {n} DAYS"))
    return e.crossJoin(t).where(~(old("view", 7) | old("error", 14))).drop("m")


@query("freshness", """WITH e AS (SELECT event_type AS dataset_key, max(ts) AS watermark, count(*) AS n FROM events GROUP BY 1), t AS (SELECT max(ts) AS m FROM events)
SELECT dataset_key, CAST(floor(epoch(m)) - floor(epoch(watermark)) AS BIGINT) AS lag_seconds, CASE WHEN floor(epoch(m)) - floor(epoch(watermark)) <= 900 THEN 'caught_up' ELSE 'catching_up' END AS status FROM e, t""")  # fmt: skip
def freshness(spark: SparkSession, d: str) -> DataFrame:
    e = V.read(spark, d, "events")
    as_of = e.agg(F.max("ts")).first()[0]
    state = e.groupBy(F.col("event_type").alias("dataset_key")).agg(F.max("ts").alias("watermark"), F.max(F.col("ts").cast("string")).alias("cursor")).select("*", F.lit(True).alias("enabled"), F.lit(True).alias("backfill_done"), F.lit(None).cast("string").alias("previous_cursor"), F.lit(0).alias("stall_count"))
    return S.horizon(state, as_of).select("dataset_key", "lag_seconds", "status")


@query("membership_union_distinct", "SELECT s_nationkey AS nation FROM supplier UNION SELECT c_nationkey FROM customer WHERE c_acctbal > 9000")
def membership_union_distinct(spark: SparkSession, d: str) -> DataFrame:
    return V.read(spark, d, "supplier").select(F.col("s_nationkey").alias("nation")).union(V.read(spark, d, "customer").where("c_acctbal > 9000").select("c_nationkey")).distinct()


@query("inactive_customers", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') AND EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority LIKE '1%')")
def inactive_customers(spark: SparkSession, d: str) -> DataFrame:
    """Anti and semi joins: no finished order, and some urgent one."""
    o = V.read(spark, d, "orders")
    c = V.read(spark, d, "customer").select("c_custkey")
    k = lambda df: df.select(F.col("o_custkey").alias("c_custkey"))
    return c.join(k(o.where("o_orderstatus = 'F'")), "c_custkey", "left_anti").join(k(o.where(F.col("o_orderpriority").startswith("1"))), "c_custkey", "left_semi")


@query("ewma_durations", """WITH x AS (SELECT o_custkey, o_totalprice AS v, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS i, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders)
SELECT o_custkey, round(sum(CASE WHEN i = 1 THEN pow(0.8, n - 1) ELSE 0.2 * pow(0.8, n - i) END * v), 1) AS ewma, max(n) AS n FROM x GROUP BY 1""")  # fmt: skip
def ewma_durations(spark: SparkSession, d: str, alpha: float = 0.2) -> DataFrame:
    """Running weighted average over each group's values in time order."""
    g = V.read(spark, d, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderdate", "o_orderkey", "o_totalprice"))).alias("z"))
    vals = F.transform("z", lambda s: s["o_totalprice"])
    ewma = F.aggregate(F.slice(vals, 2, F.size("z")), F.element_at(vals, 1), lambda a, x: alpha * x + (1 - alpha) * a)
    return g.select("o_custkey", rnd(ewma, 1).alias("ewma"), F.size("z").cast("bigint").alias("n"))
