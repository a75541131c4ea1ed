"""Logical views of the analytics model over the physical tables, as DataFrames, and the same as DuckDB CTEs for the oracles.

The bindings are structural stand-ins: lineitem is the order book and the attacker list, orders the killmails, events the battle stream.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table, with naive timestamps as timestamps of the session's zone (set it to UTC)."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    naive = {c: F.col(c).cast("timestamp") for c, kind in df.dtypes if kind == "timestamp_ntz"}
    return df.withColumns(naive) if naive else df


def market_orders(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "lineitem").select(
        F.when(F.col("l_returnflag") == "N", "market_hub").otherwise("alliance_structure").alias("source_type"), F.col("l_suppkey").alias("source_id"), F.col("l_partkey").alias("type_id"),
        (F.col("l_linestatus") == "O").alias("is_buy_order"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), F.col("l_quantity").cast("bigint").alias("volume_remain"),
        F.col("l_shipdate").alias("observed_at"),
    )


def killmails(spark: SparkSession, d: str) -> DataFrame:
    o, c = read(spark, d, "orders"), read(spark, d, "customer").select("c_custkey", "c_nationkey")
    n = read(spark, d, "nation").select(F.col("n_nationkey").alias("system_id"), F.col("n_regionkey").alias("region_id"))
    k = o.join(c, o.o_custkey == c.c_custkey).select(
        F.col("o_orderkey").alias("sequence_id"), F.col("o_orderdate").alias("killmail_time"), F.col("o_custkey").alias("victim_character_id"),
        (F.col("c_nationkey") + 1).cast("bigint").alias("victim_alliance_id"), (F.col("o_orderkey") % 25).cast("int").alias("system_id"), F.col("o_totalprice").alias("total_value"),
        F.col("o_orderstatus").alias("mail_type"),
    )
    return k.join(n, "system_id")


def attackers(spark: SparkSession, d: str) -> DataFrame:
    li, s = read(spark, d, "lineitem"), read(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_suppkey", "l_partkey", "l_extendedprice", "l_shipdate")
    li = li.withColumn("final_blow", F.row_number().over(w) == 1)
    return li.join(s, li.l_suppkey == s.s_suppkey).select(
        F.col("l_orderkey").alias("sequence_id"), (F.col("l_suppkey") + 1).alias("character_id"), (F.col("s_nationkey") + 1).cast("bigint").alias("alliance_id"), F.col("l_partkey").alias("ship_type_id"),
        F.col("l_extendedprice").alias("damage_done"), "final_blow",
    )


def killmail_items(spark: SparkSession, d: str) -> DataFrame:
    q, gone = F.col("l_quantity").cast("bigint"), F.col("l_returnflag") == "R"
    return read(spark, d, "lineitem").select(F.col("l_orderkey").alias("sequence_id"), F.col("l_partkey").alias("item_type_id"), F.when(gone, q).otherwise(0).alias("quantity_destroyed"), F.when(gone, 0).otherwise(q).alias("quantity_dropped"))


def event_stream(spark: SparkSession, d: str) -> DataFrame:
    return stream_columns(read(spark, d, "events"))


def stream_columns(events: DataFrame) -> DataFrame:
    return events.select(
        "event_id", "ts", F.col("user_id").alias("character_id"), (F.col("user_id") % 10).cast("int").alias("system_id"), F.col("event_type").alias("side_key"), F.col("value").alias("damage"),
        F.get_json_object("props", "$.k").cast("int").alias("ship_type_id"),
    )


def types(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "part").select(F.col("p_partkey").alias("type_id"), F.col("p_name").alias("type_name"), F.col("p_brand").alias("group_name"), F.col("p_size").alias("volume"), F.col("p_retailprice").alias("base_price"))


def system_graph(spark: SparkSession, d: str) -> DataFrame:
    """Ring and chords over the systems, both directions: src, dst."""
    n = read(spark, d, "nation").select(F.col("n_nationkey").alias("a"))
    e = n.select("a", F.explode(F.array((F.col("a") + 1) % 25, (F.col("a") + 5) % 25)).alias("b"))
    return e.select(F.col("a").alias("src"), F.col("b").alias("dst")).union(e.select(F.col("b").alias("src"), F.col("a").alias("dst"))).distinct()


def membership(spark: SparkSession, d: str) -> DataFrame:
    """Order dates as joins to o_orderpriority; a period ends where the next begins."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return read(spark, d, "orders").select(F.col("o_custkey").alias("character_id"), F.col("o_orderpriority").alias("org"), F.col("o_orderdate").alias("start_at"), F.col("o_orderkey").alias("seq"), F.lead("o_orderdate").over(w).alias("end_at"))


def co_supply(spark: SparkSession, d: str, min_shared: int = 150) -> DataFrame:
    """Supplier pairs a < b that share at least min_shared parts: a, b, shared. Counted by part, so the join key is the part."""
    p = read(spark, d, "lineitem").select(F.col("l_suppkey").alias("s"), F.col("l_partkey").alias("p")).distinct()
    pairs = p.select(F.col("s").alias("a"), "p").join(p.select(F.col("s").alias("b"), "p"), "p").where("a < b")
    return pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared")).where(F.col("shared") >= min_shared)


CTE = {
    "mo": """mo AS (SELECT CASE WHEN l_returnflag = 'N' THEN 'market_hub' ELSE 'alliance_structure' END AS source_type, l_suppkey AS source_id, l_partkey AS type_id,
        l_linestatus = 'O' AS is_buy_order, l_extendedprice / l_quantity AS price, CAST(l_quantity AS BIGINT) AS volume_remain, l_shipdate AS observed_at FROM lineitem)""",
    "km": """km AS (SELECT o_orderkey AS sequence_id, o_orderdate AS killmail_time, o_custkey AS victim_character_id, CAST(c_nationkey + 1 AS BIGINT) AS victim_alliance_id,
        CAST(o_orderkey % 25 AS INTEGER) AS system_id, o_totalprice AS total_value, o_orderstatus AS mail_type, n_regionkey AS region_id
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON n_nationkey = o_orderkey % 25)""",
    "ka": """ka AS (SELECT l_orderkey AS sequence_id, l_suppkey + 1 AS character_id, CAST(s_nationkey + 1 AS BIGINT) AS alliance_id, l_partkey AS ship_type_id, l_extendedprice AS damage_done,
        row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey, l_partkey, l_extendedprice, l_shipdate) = 1 AS final_blow FROM lineitem JOIN supplier ON l_suppkey = s_suppkey)""",
    "ki": """ki AS (SELECT l_orderkey AS sequence_id, l_partkey AS item_type_id, CASE WHEN l_returnflag = 'R' THEN CAST(l_quantity AS BIGINT) ELSE 0 END AS quantity_destroyed,
        CASE WHEN l_returnflag = 'R' THEN 0 ELSE CAST(l_quantity AS BIGINT) END AS quantity_dropped FROM lineitem)""",
    "es": """es AS (SELECT event_id, ts, user_id AS character_id, CAST(user_id % 10 AS INTEGER) AS system_id, event_type AS side_key, value AS damage,
        CAST(json_extract_string(props, '$.k') AS INTEGER) AS ship_type_id FROM events)""",
    "sg": """sg AS (SELECT DISTINCT src, dst FROM (SELECT n_nationkey AS src, (n_nationkey + k) % 25 AS dst FROM nation, (SELECT unnest([1, 5]) AS k)
        UNION ALL SELECT (n_nationkey + k) % 25, n_nationkey FROM nation, (SELECT unnest([1, 5]) AS k)))""",
    "mh": """mh AS (SELECT o_custkey AS character_id, o_orderpriority AS org, o_orderdate AS start_at, o_orderkey AS seq,
        lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS end_at FROM orders)""",
    "cs": """cs AS (WITH p AS (SELECT DISTINCT l_suppkey AS s, l_partkey AS p FROM lineitem) SELECT x.s AS a, y.s AS b, count(*) AS shared FROM p x JOIN p y ON x.p = y.p AND x.s < y.s GROUP BY ALL HAVING count(*) >= 150)""",
}


def ctes(*names: str) -> str:
    return "WITH " + ",\n".join(CTE[n] for n in names)
