"""Structured Streaming forms of the incremental operators, and the state machines around them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

EVENTS = T.StructType(
    [
        T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()), T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()),
        T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType()),
    ]
)


def events(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    """Event files of a folder as a stream, with ts as a timestamp of the session's zone."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_batch).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def deduplicated(df: DataFrame, key: str = "event_id", ts: str = "ts", repair: str = "3 days") -> DataFrame:
    """Each key once within the repair window."""
    return df.withWatermark(ts, repair).dropDuplicatesWithinWatermark([key])


def bucketed(df: DataFrame, unit: str = "1 hour", repair: str = "3 days", dedupe: bool = True) -> DataFrame:
    """Tumbling rollup by system and window; late rows count up to the repair window."""
    d = deduplicated(df, repair=repair) if dedupe else df.withWatermark("ts", repair)
    g = d.groupBy(F.window("ts", unit).alias("w"), (F.col("user_id") % 10).cast("int").alias("system_id"))
    return g.agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("user_id").alias("pilots"), F.sum("value").alias("value")).select(F.col("w.start").alias("bucket"), "system_id", "n", "pilots", "value")


def sessions(df: DataFrame, gap: str = "45 minutes", repair: str = "3 days") -> DataFrame:
    """Sessions of a system: points merge while gaps are at most `gap`."""
    g = df.withWatermark("ts", repair).groupBy(F.session_window("ts", gap).alias("s"), (F.col("user_id") % 10).cast("int").alias("system_id"))
    return g.agg(F.count(F.lit(1)).alias("n")).select(F.col("s.start").alias("start_at"), F.col("s.end").alias("end_at"), "system_id", "n")


def classified(raw: DataFrame, schema: str, key: str) -> DataFrame:
    """Payload text as valid, empty or malformed, with the parsed fields."""
    parsed = F.from_json("payload", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    j = raw.withColumn("j", parsed)
    kind = F.when(F.col("j._bad").isNotNull() | F.col("j").isNull(), "malformed").when(F.col(f"j.{key}").isNull(), "non_actionable").otherwise("valid")
    return j.withColumn("kind", kind)


def reinforced(df: DataFrame) -> DataFrame:
    """Running first seen, last reinforced and count of each character, as an update stream."""
    return df.groupBy("user_id").agg(F.min("ts").alias("first_seen"), F.max("ts").alias("last_reinforced"), F.count(F.lit(1)).alias("times"))


def run_once(df: DataFrame, checkpoint: str, sink: Callable[[DataFrame, int], None], mode: str = "append") -> StreamingQuery:
    """Run over all there is now, batch by batch, and stop: the sink gets each batch and its number, so a retry can be told apart."""
    q = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(sink).start()
    q.awaitTermination()
    return q


def horizon(state: DataFrame, as_of, stall_after: int = 3, fresh_seconds: int = 900) -> DataFrame:
    """Freshness of each dataset: stopped, stalled, backfilling, caught up, catching up, by the first that holds.

    state: dataset_key, enabled, backfill_done, watermark, cursor, previous_cursor, stall_count.
    """
    lag = F.unix_seconds(F.lit(as_of).cast("timestamp")) - F.unix_seconds("watermark")
    stalls = F.when(F.col("cursor") > F.coalesce("previous_cursor", F.lit("")), 0).otherwise(F.col("stall_count") + 1)
    s = state.withColumn("lag_seconds", lag).withColumn("stall_count", stalls).withColumn("cursor", F.greatest("cursor", F.coalesce("previous_cursor", F.col("cursor"))))
    status = F.when(~F.col("enabled"), "stopped").when(F.col("stall_count") >= stall_after, "stalled").when(~F.col("backfill_done"), "backfilling").when(F.col("lag_seconds") <= fresh_seconds, "caught_up").otherwise("catching_up")
    return s.withColumn("status", status)


def since(df: DataFrame, ts: str, tie: str, cursor: tuple | None, repair_seconds: int = 0) -> DataFrame:
    """Rows after a cursor (time, id), which a repair window takes back so that late rows are read again."""
    if cursor is None:
        return df
    at, i = cursor
    if repair_seconds:
        return df.where(F.col(ts) >= F.lit(at).cast("timestamp") - F.expr(f"INTERVAL {repair_seconds} SECONDS"))
    return df.where((F.col(ts) > F.lit(at).cast("timestamp")) | ((F.col(ts) == F.lit(at).cast("timestamp")) & (F.col(tie) > i)))


def cursor_reset(df: DataFrame, state: DataFrame, key: str) -> DataFrame:
    """Cursors (dataset_key, cursor) that lie past the data or above rows not done yet go back: to the largest key, or before the first such row.

    df: dataset_key, the key column, done.
    """
    g = df.groupBy("dataset_key").agg(F.max(key).alias("_max"), F.min(F.when(~F.col("done"), F.col(key))).alias("_open"))
    c = F.least("cursor", "_max", F.col("_open") - 1)
    return state.join(g, "dataset_key", "left").select("dataset_key", F.coalesce(c, "cursor").alias("cursor"), (F.coalesce(c, "cursor") < F.col("cursor")).alias("was_reset"))


def backfill_verdicts(state: DataFrame, as_of, soak_hours: int = 24, fresh_seconds: int = 900) -> DataFrame:
    """Backfills as proposed, soaking or approved: caught up and without gaps, first seen so, and so for the soak time.

    state: dataset_key, watermark, gaps, proposed_at.
    """
    now = F.lit(as_of).cast("timestamp")
    ready = (F.unix_seconds(now) - F.unix_seconds("watermark") <= fresh_seconds) & (F.col("gaps") == 0)
    soaked = F.unix_seconds(now) - F.unix_seconds("proposed_at") >= soak_hours * 3600
    verdict = F.when(~ready, "running").when(F.col("proposed_at").isNull(), "proposed").when(soaked, "approved").otherwise("soaking")
    return state.select("*", verdict.alias("verdict"), F.when(~ready, None).otherwise(F.coalesce("proposed_at", now)).alias("next_proposed_at"))
