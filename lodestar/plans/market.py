"""Market: rollups, order-book projection, comparison, alerts, demand, criticality and purchase plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.functions.kernels import clamp, exact_sum, rnd, safe_div, tier
from lodestar.operators.relational import full_outer, latest, top_k
from lodestar.plans.registry import query
from lodestar.sources import views as V

R4 = rnd


def price_rollup(orders: DataFrame, unit: str) -> DataFrame:
    """Asks per bucket, source kind and type: weighted, least, greatest and mean price, with the weighted mean's parts kept mergeable."""
    g = orders.where(~F.col("is_buy_order")).groupBy(F.date_trunc(unit, "observed_at").alias("bucket"), "source_type", "type_id")
    out = g.agg(
        exact_sum(F.col("price") * F.col("volume_remain")).alias("price_volume"), F.sum("volume_remain").alias("volume"), F.min("price").alias("lo"), F.max("price").alias("hi"),
        exact_sum(F.col("price")).alias("price_sum"), F.count(F.lit(1)).alias("n"),
    )
    return out.select("bucket", "source_type", "type_id", "volume", "n", R4(safe_div(F.col("price_volume"), F.col("volume"))).alias("weighted_price"), R4("lo").alias("min_price"), R4("hi").alias("max_price"), R4(F.col("price_sum") / F.col("n")).alias("avg_price"))


def _rollup_sql(unit: str) -> str:
    return f"""{V.ctes('mo')}
    SELECT CAST(date_trunc('{unit}', observed_at) AS TIMESTAMP) AS bucket, source_type, type_id, CAST(sum(volume_remain) AS BIGINT) AS volume, count(*) AS n,
      round(CAST(sum(CAST(price * volume_remain AS DECIMAL(20,4))) AS DOUBLE) / sum(volume_remain), 4) AS weighted_price, round(min(price), 4) AS min_price, round(max(price), 4) AS max_price,
      round(CAST(sum(CAST(price AS DECIMAL(20,4))) AS DOUBLE) / count(*), 4) AS avg_price FROM mo WHERE NOT is_buy_order GROUP BY ALL"""


@query("price_rollup_1d", _rollup_sql("day"))
def price_rollup_1d(spark: SparkSession, d: str) -> DataFrame:
    return price_rollup(V.market_orders(spark, d), "day")


@query("price_rollup_1h", _rollup_sql("hour"))
def price_rollup_1h(spark: SparkSession, d: str) -> DataFrame:
    return price_rollup(V.market_orders(spark, d), "hour")


@query("stock_rollup_1d", f"""{V.ctes('mo')}
SELECT CAST(date_trunc('day', observed_at) AS TIMESTAMP) AS bucket, source_type, source_id, CAST(sum(volume_remain) AS BIGINT) AS stock, count(*) AS listings, count(DISTINCT type_id) AS n_types
FROM mo WHERE NOT is_buy_order GROUP BY ALL""")  # fmt: skip
def stock_rollup_1d(spark: SparkSession, d: str) -> DataFrame:
    g = V.market_orders(spark, d).where(~F.col("is_buy_order")).groupBy(F.date_trunc("day", "observed_at").alias("bucket"), "source_type", "source_id")
    return g.agg(F.sum("volume_remain").alias("stock"), F.count(F.lit(1)).alias("listings"), F.countDistinct("type_id").alias("n_types"))


@query("item_loss_1d", f"""{V.ctes('km', 'ki')}
SELECT CAST(date_trunc('day', killmail_time) AS TIMESTAMP) AS bucket, item_type_id, CAST(sum(quantity_destroyed) AS BIGINT) AS destroyed, CAST(sum(quantity_dropped) AS BIGINT) AS dropped,
  count(DISTINCT km.sequence_id) AS killmails FROM km JOIN ki USING (sequence_id) GROUP BY ALL""")  # fmt: skip
def item_loss_1d(spark: SparkSession, d: str) -> DataFrame:
    j = V.killmails(spark, d).select("sequence_id", "killmail_time").join(V.killmail_items(spark, d), "sequence_id")
    return j.groupBy(F.date_trunc("day", "killmail_time").alias("bucket"), "item_type_id").agg(F.sum("quantity_destroyed").alias("destroyed"), F.sum("quantity_dropped").alias("dropped"), F.countDistinct("sequence_id").alias("killmails"))


@query("hull_loss_1d", f"""{V.ctes('km', 'ka')}, hull AS (SELECT sequence_id, ship_type_id FROM ka WHERE final_blow)
SELECT CAST(date_trunc('day', killmail_time) AS TIMESTAMP) AS bucket, ship_type_id, count(*) AS losses, count(DISTINCT victim_character_id) AS victims,
  round(CAST(sum(CAST(total_value AS DECIMAL(20,4))) AS DOUBLE), 2) AS value_lost FROM km JOIN hull USING (sequence_id) GROUP BY ALL""")  # fmt: skip
def hull_loss_1d(spark: SparkSession, d: str) -> DataFrame:
    hull = V.attackers(spark, d).where("final_blow").select("sequence_id", "ship_type_id")
    j = V.killmails(spark, d).join(hull, "sequence_id")
    return j.groupBy(F.date_trunc("day", "killmail_time").alias("bucket"), "ship_type_id").agg(F.count(F.lit(1)).alias("losses"), F.countDistinct("victim_character_id").alias("victims"), rnd(exact_sum(F.col("total_value")), 2).alias("value_lost"))


def project_book(orders: DataFrame) -> DataFrame:
    """Best ask and bid, volume and order counts per source and type."""
    ask, bid = ~F.col("is_buy_order"), F.col("is_buy_order")
    return orders.groupBy("source_type", "source_id", "type_id").agg(
        F.min(F.when(ask, F.col("price"))).alias("best_sell"), F.max(F.when(bid, F.col("price"))).alias("best_buy"), F.sum("volume_remain").alias("total_volume"),
        F.sum(ask.cast("bigint")).alias("sell_orders"), F.sum(bid.cast("bigint")).alias("buy_orders"), F.max("observed_at").alias("observed_at"),
    )


@query("orderbook_projection", f"""{V.ctes('mo')}
SELECT source_type, source_id, type_id, round(min(CASE WHEN NOT is_buy_order THEN price END), 4) AS best_sell, round(max(CASE WHEN is_buy_order THEN price END), 4) AS best_buy,
  CAST(sum(volume_remain) AS BIGINT) AS total_volume, CAST(sum(CAST(NOT is_buy_order AS BIGINT)) AS BIGINT) AS sell_orders, CAST(sum(CAST(is_buy_order AS BIGINT)) AS BIGINT) AS buy_orders, max(observed_at) AS observed_at
FROM mo GROUP BY ALL""")  # fmt: skip
def orderbook_projection(spark: SparkSession, d: str) -> DataFrame:
    return project_book(V.market_orders(spark, d)).withColumn("best_sell", R4("best_sell")).withColumn("best_buy", R4("best_buy"))


@query("latest_snapshot_per_type", f"""{V.ctes('mo')}
SELECT source_type, type_id, source_id, observed_at, round(price, 4) AS price, volume_remain, is_buy_order FROM mo
QUALIFY row_number() OVER (PARTITION BY source_type, type_id ORDER BY observed_at DESC, source_id, price, volume_remain, is_buy_order) = 1""")  # fmt: skip
def latest_snapshot_per_type(spark: SparkSession, d: str) -> DataFrame:
    order = [F.desc("observed_at"), "source_id", "price", "volume_remain", "is_buy_order"]
    return latest(V.market_orders(spark, d), ["source_type", "type_id"], order).select("source_type", "type_id", "source_id", "observed_at", R4("price").alias("price"), "volume_remain", "is_buy_order")


@query("ohlc_daily", """SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS bucket, event_type, first(value ORDER BY ts, event_id) AS open, max(value) AS high, min(value) AS low,
  last(value ORDER BY ts, event_id) AS close, round(CAST(sum(CAST(value AS DECIMAL(20,4))) AS DOUBLE) / count(*), 4) AS average, count(*) AS n FROM events GROUP BY ALL""")  # fmt: skip
def ohlc_daily(spark: SparkSession, d: str) -> DataFrame:
    at = F.struct("ts", "event_id")
    g = V.read(spark, d, "events").groupBy(F.date_trunc("day", "ts").alias("bucket"), "event_type")
    return g.agg(F.min_by("value", at).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", at).alias("close"), R4(exact_sum(F.col("value")) / F.count(F.lit(1))).alias("average"), F.count(F.lit(1)).alias("n"))


_ALERT = """, day AS (SELECT max(CAST(date_trunc('day', observed_at) AS TIMESTAMP)) AS b FROM mo WHERE source_type = 'market_hub' AND NOT is_buy_order),
ref AS (SELECT type_id, CAST(sum(CAST(price * volume_remain AS DECIMAL(20,4))) AS DOUBLE) / sum(volume_remain) AS w FROM mo, day
  WHERE source_type = 'market_hub' AND NOT is_buy_order AND observed_at >= b - INTERVAL 30 DAY GROUP BY type_id),
ask AS (SELECT type_id, min(price) AS ask FROM mo WHERE source_type = 'alliance_structure' AND NOT is_buy_order GROUP BY type_id)"""


@query("deal_alerts", V.ctes("mo") + _ALERT + """
SELECT type_id, round(ask, 4) AS ask, round(w, 4) AS reference, round(ask / w, 6) AS ratio, round(abs(100 - 100 * ask / w), 4) AS anomaly,
  CASE WHEN ask / w <= 0.5 THEN 'critical' WHEN ask / w <= 0.7 THEN 'very_strong' WHEN ask / w <= 0.85 THEN 'strong' ELSE 'watch' END AS severity FROM ask JOIN ref USING (type_id) WHERE w > 0 AND ask / w <= 0.95""")  # fmt: skip
def deal_alerts(spark: SparkSession, d: str) -> DataFrame:
    """Asks at 95 % or less of the weighted hub price of the 30 days before the hub's latest bucket."""
    mo = V.market_orders(spark, d).where(~F.col("is_buy_order"))
    hub = mo.where("source_type = 'market_hub'")
    day = hub.agg(F.max(F.date_trunc("day", "observed_at")).alias("b"))  # one row
    ref = hub.join(F.broadcast(day), F.col("observed_at") >= F.col("b") - F.expr("INTERVAL 30 DAYS")).groupBy("type_id").agg((exact_sum(F.col("price") * F.col("volume_remain")) / F.sum("volume_remain")).alias("w"))
    ask = mo.where("source_type = 'alliance_structure'").groupBy("type_id").agg(F.min("price").alias("ask"))
    r = F.col("ask") / F.col("w")
    sev = F.when(r <= 0.5, "critical").when(r <= 0.7, "very_strong").when(r <= 0.85, "strong").otherwise("watch")
    return ask.join(ref, "type_id").where((F.col("w") > 0) & (r <= 0.95)).select("type_id", R4("ask").alias("ask"), R4("w").alias("reference"), rnd(r, 6).alias("ratio"), R4(F.abs(100 - 100 * r)).alias("anomaly"), sev.alias("severity"))


def evaluate_market(j: DataFrame) -> DataFrame:
    """Opportunity and risk scores of the alliance book (a_*) against the hub (h_*)."""
    has, miss = F.col("a_sell").isNotNull(), F.col("a_sell").isNull()
    dev = F.when(has & (F.col("h_sell") > 0), 100 * (F.col("a_sell") - F.col("h_sell")) / F.col("h_sell")).otherwise(0.0)
    vol, n = F.coalesce("a_vol", F.lit(0)), F.coalesce("a_n", F.lit(0))
    weak = (vol < 25) | (n < 3)
    j = j.withColumn("dev", dev).withColumn("weak", weak).withColumn("vol", vol)
    delta = F.least(F.lit(100.0), F.bround(4 * F.abs("dev"), 0))
    hub_vol = F.least(F.lit(100.0), F.bround(F.least(F.coalesce("h_vol", F.lit(0)), F.lit(5000)) / 50.0, 0))
    stock = F.when(F.col("weak"), 100.0 * F.greatest(F.lit(0), 25 - F.col("vol")) / 25.0).otherwise(0.0)
    opp = 45 * miss.cast("int") + 35 * (F.col("dev") <= -15).cast("int") + 0.35 * hub_vol + 0.20 * stock
    risk = 40 * (F.col("dev") >= 15).cast("int") + 35 * F.col("weak").cast("int") + 0.25 * delta + 0.20 * hub_vol
    return j.select(
        "type_id", R4("dev").alias("deviation"), "weak", R4(clamp(opp, 0, 100)).alias("opportunity"), R4(clamp(risk, 0, 100)).alias("risk"),
        tier(F.greatest(opp, risk), [(75, "critical"), (55, "high"), (35, "medium")], "low").alias("tier"),
    )


@query("market_comparison", V.ctes("mo") + """, a AS (SELECT type_id, min(CASE WHEN NOT is_buy_order THEN price END) AS a_sell, sum(volume_remain) AS a_vol, count(*) AS a_n FROM mo WHERE source_type = 'alliance_structure' GROUP BY 1),
h AS (SELECT type_id, min(CASE WHEN NOT is_buy_order THEN price END) AS h_sell, sum(volume_remain) AS h_vol FROM mo WHERE source_type = 'market_hub' GROUP BY 1),
j AS (SELECT coalesce(a.type_id, h.type_id) AS type_id, a_sell, h_sell, coalesce(a_vol, 0) AS vol, coalesce(a_n, 0) AS n, coalesce(h_vol, 0) AS hv,
  CASE WHEN a_sell IS NOT NULL AND h_sell > 0 THEN 100 * (a_sell - h_sell) / h_sell ELSE 0 END AS dev FROM a FULL JOIN h ON a.type_id = h.type_id),
k AS (SELECT *, vol < 25 OR n < 3 AS weak, least(100.0, round_even(4 * abs(dev), 0)) AS delta, least(100.0, round_even(least(hv, 5000) / 50.0, 0)) AS hvs FROM j),
s AS (SELECT *, 45 * CAST(a_sell IS NULL AS INT) + 35 * CAST(dev <= -15 AS INT) + 0.35 * hvs + 0.2 * CASE WHEN weak THEN 100.0 * greatest(0, 25 - vol) / 25.0 ELSE 0 END AS opp,
  40 * CAST(dev >= 15 AS INT) + 35 * CAST(weak AS INT) + 0.25 * delta + 0.2 * hvs AS risk FROM k)
SELECT type_id, round(dev, 4) AS deviation, weak, round(CAST(greatest(0, least(100, opp)) AS DOUBLE), 4) AS opportunity, round(CAST(greatest(0, least(100, risk)) AS DOUBLE), 4) AS risk,
  CASE WHEN greatest(opp, risk) >= 75 THEN 'critical' WHEN greatest(opp, risk) >= 55 THEN 'high' WHEN greatest(opp, risk) >= 35 THEN 'medium' ELSE 'low' END AS tier FROM s""")  # fmt: skip
def market_comparison(spark: SparkSession, d: str) -> DataFrame:
    mo = V.market_orders(spark, d)
    ask = F.min(F.when(~F.col("is_buy_order"), F.col("price")))
    a = mo.where("source_type = 'alliance_structure'").groupBy("type_id").agg(ask.alias("a_sell"), F.sum("volume_remain").alias("a_vol"), F.count(F.lit(1)).alias("a_n"))
    h = mo.where("source_type = 'market_hub'").groupBy("type_id").agg(ask.alias("h_sell"), F.sum("volume_remain").alias("h_vol"))
    return evaluate_market(full_outer(a, h, ["type_id"]))


@query("loss_demand_top", V.ctes("km", "ki", "mo") + """, t AS (SELECT max(killmail_time) AS m FROM km),
l AS (SELECT item_type_id AS type_id, CAST(sum(quantity_destroyed + quantity_dropped) AS BIGINT) AS lost, count(DISTINCT km.sequence_id) AS killmails FROM km JOIN ki USING (sequence_id), t WHERE killmail_time >= m - INTERVAL 7 DAY GROUP BY 1),
s AS (SELECT type_id, CAST(sum(volume_remain) AS BIGINT) AS stock FROM mo WHERE source_type = 'alliance_structure' AND NOT is_buy_order GROUP BY 1)
SELECT type_id, lost, killmails, coalesce(stock, 0) AS stock, greatest(0, lost - coalesce(stock, 0)) AS gap FROM l LEFT JOIN s USING (type_id) ORDER BY lost DESC, type_id LIMIT 250""")  # fmt: skip
def loss_demand_top(spark: SparkSession, d: str) -> DataFrame:
    """The 250 most lost types of the last 7 days with their stock; both sides are aggregated before the join."""
    km = V.killmails(spark, d).select("sequence_id", "killmail_time")
    t = km.agg(F.max("killmail_time").alias("m"))
    recent = km.join(F.broadcast(t), F.col("killmail_time") >= F.col("m") - F.expr("INTERVAL 7 DAYS")).select("sequence_id")
    lost = recent.join(V.killmail_items(spark, d), "sequence_id").groupBy(F.col("item_type_id").alias("type_id")).agg(F.sum(F.col("quantity_destroyed") + F.col("quantity_dropped")).alias("lost"), F.countDistinct("sequence_id").alias("killmails"))
    stock = V.market_orders(spark, d).where("source_type = 'alliance_structure' and not is_buy_order").groupBy("type_id").agg(F.sum("volume_remain").alias("stock"))
    top = lost.orderBy(F.desc("lost"), "type_id").limit(250)
    zero = F.coalesce("stock", F.lit(0))
    return top.join(stock, "type_id", "left").select("type_id", "lost", "killmails", zero.alias("stock"), F.greatest(F.lit(0), F.col("lost") - zero).alias("gap"))


@query("price_movers", V.ctes("mo") + """, t AS (SELECT max(observed_at) AS m FROM mo),
p AS (SELECT type_id, CAST(sum(CASE WHEN observed_at >= m - INTERVAL 60 DAY THEN CAST(price AS DECIMAL(20,4)) END) AS DOUBLE) / count(CASE WHEN observed_at >= m - INTERVAL 60 DAY THEN 1 END) AS recent,
  CAST(sum(CAST(price AS DECIMAL(20,4))) AS DOUBLE) / count(*) AS base FROM mo, t WHERE observed_at >= m - INTERVAL 280 DAY GROUP BY 1)
SELECT type_id, round(recent, 4) AS recent, round(base, 4) AS base, round((recent - base) / base, 6) AS change FROM p WHERE recent IS NOT NULL AND base > 0 ORDER BY abs(round((recent - base) / base, 6)) DESC, type_id LIMIT 300""")  # fmt: skip
def price_movers(spark: SparkSession, d: str, short_days: int = 60, long_days: int = 280) -> DataFrame:
    """Largest relative change of the short window's mean price against the long one's (the windows are parameters: 3 and 14 days on dense data)."""
    mo = V.market_orders(spark, d).select("type_id", "price", "observed_at")
    t = mo.agg(F.max("observed_at").alias("m"))
    inside = F.col("observed_at") >= F.col("m") - F.expr(f"INTERVAL {short_days} DAYS")
    j = mo.join(F.broadcast(t), F.col("observed_at") >= F.col("m") - F.expr(f"INTERVAL {long_days} DAYS"))
    p = j.groupBy("type_id").agg(safe_div(exact_sum(F.when(inside, F.col("price"))), F.count(F.when(inside, 1)), None).alias("recent"), (exact_sum(F.col("price")) / F.count(F.lit(1))).alias("base"))
    out = p.where("recent is not null and base > 0").select("type_id", R4("recent").alias("recent"), R4("base").alias("base"), rnd((F.col("recent") - F.col("base")) / F.col("base"), 6).alias("change"))
    return out.orderBy(F.desc(F.abs("change")), "type_id").limit(300)


@query("snapshot_daily", V.ctes("mo") + """, s AS (SELECT source_type, source_id, type_id, observed_at, min(CASE WHEN NOT is_buy_order THEN price END) AS ask, max(CASE WHEN is_buy_order THEN price END) AS bid FROM mo GROUP BY 1, 2, 3, 4)
SELECT CAST(date_trunc('day', observed_at) AS TIMESTAMP) AS bucket, source_type, type_id, count(*) AS snapshots, round(first(ask ORDER BY observed_at, source_id) FILTER (ask IS NOT NULL), 4) AS open,
  round(max(ask), 4) AS high, round(min(ask), 4) AS low, round(last(ask ORDER BY observed_at, source_id) FILTER (ask IS NOT NULL), 4) AS close, round(max(bid), 4) AS best_bid FROM s GROUP BY 1, 2, 3""")  # fmt: skip
def snapshot_daily(spark: SparkSession, d: str) -> DataFrame:
    """Snapshot metrics folded into daily open, high, low and close of the best ask."""
    s = V.market_orders(spark, d).groupBy("source_type", "source_id", "type_id", "observed_at").agg(F.min(F.when(~F.col("is_buy_order"), F.col("price"))).alias("ask"), F.max(F.when(F.col("is_buy_order"), F.col("price"))).alias("bid"))
    at = F.when(F.col("ask").isNotNull(), F.struct("observed_at", "source_id"))
    g = s.groupBy(F.date_trunc("day", "observed_at").alias("bucket"), "source_type", "type_id")
    return g.agg(F.count(F.lit(1)).alias("snapshots"), R4(F.min_by("ask", at)).alias("open"), R4(F.max("ask")).alias("high"), R4(F.min("ask")).alias("low"), R4(F.max_by("ask", at)).alias("close"), R4(F.max("bid")).alias("best_bid"))


@query("item_criticality", V.ctes("ki") + """, dep AS (SELECT item_type_id AS type_id, count(DISTINCT sequence_id) AS uses, CAST(sum(quantity_destroyed + quantity_dropped) AS BIGINT) AS moved FROM ki GROUP BY 1),
peers AS (SELECT p_brand, p_type, count(*) - 1 AS n FROM part GROUP BY 1, 2),
mo AS (SELECT l_partkey AS type_id, CAST(sum(CASE WHEN l_linestatus = 'F' THEN CAST(l_quantity AS BIGINT) ELSE 0 END) AS BIGINT) AS stock FROM lineitem GROUP BY 1)
SELECT p_partkey AS type_id, coalesce(uses, 0) AS uses, n AS peers, round(least(1.0, n / 5.0), 6) AS substitutability, n = 0 AND coalesce(uses, 0) >= 2 OR n <= 1 AND coalesce(uses, 0) >= 3 AS spof,
  round(0.3 * coalesce(uses, 0) + 25 * (1 - least(1.0, n / 5.0)) + 25 * CAST(n = 0 AND coalesce(uses, 0) >= 2 OR n <= 1 AND coalesce(uses, 0) >= 3 AS INT), 4) AS criticality,
  round(CASE WHEN coalesce(stock, 0) > 0 THEN coalesce(moved, 0) / stock ELSE 0 END, 6) AS turnover
FROM part JOIN peers USING (p_brand, p_type) LEFT JOIN dep ON dep.type_id = p_partkey LEFT JOIN mo ON mo.type_id = p_partkey""")  # fmt: skip
def item_criticality(spark: SparkSession, d: str) -> DataFrame:
    """Dependence, substitutes in the group, single point of failure, and turnover of stock."""
    ki = V.killmail_items(spark, d)
    dep = ki.groupBy(F.col("item_type_id").alias("type_id")).agg(F.countDistinct("sequence_id").alias("uses"), F.sum(F.col("quantity_destroyed") + F.col("quantity_dropped")).alias("moved"))
    stock = V.read(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("type_id")).agg(F.sum(F.when(F.col("l_linestatus") == "F", F.col("l_quantity").cast("bigint")).otherwise(0)).alias("stock"))
    part = V.read(spark, d, "part").select(F.col("p_partkey").alias("type_id"), "p_brand", "p_type")
    part = part.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("p_brand", "p_type")) - 1)
    j = part.join(dep, "type_id", "left").join(stock, "type_id", "left").withColumn("u", F.coalesce("uses", F.lit(0)))
    sub = F.least(F.lit(1.0), F.col("n") / 5.0)
    spof = ((F.col("n") == 0) & (F.col("u") >= 2)) | ((F.col("n") <= 1) & (F.col("u") >= 3))
    turn = safe_div(F.coalesce("moved", F.lit(0)), F.coalesce("stock", F.lit(0)))
    return j.select("type_id", F.col("u").alias("uses"), F.col("n").alias("peers"), rnd(sub, 6).alias("substitutability"), spof.alias("spof"), R4(0.3 * F.col("u") + 25 * (1 - sub) + 25 * spof.cast("int")).alias("criticality"), rnd(turn, 6).alias("turnover"))


_TREND_SQL = V.ctes("mo") + """, t AS (SELECT max(observed_at) AS m FROM mo),
p AS (SELECT type_id, CAST(sum(CASE WHEN observed_at >= m - INTERVAL 90 DAY THEN CAST(price AS DECIMAL(20,4)) END) AS DOUBLE) / nullif(count(CASE WHEN observed_at >= m - INTERVAL 90 DAY THEN 1 END), 0) AS p7,
  CAST(sum(CAST(price AS DECIMAL(20,4))) AS DOUBLE) / count(*) AS p30 FROM mo, t WHERE observed_at >= m - INTERVAL 365 DAY GROUP BY 1)
SELECT type_id, round((p7 - p30) / p30, 6) AS velocity, CASE WHEN abs((p7 - p30) / p30) < 0.05 THEN 'stable' WHEN (p7 - p30) / p30 > 0.2 THEN 'spike' WHEN (p7 - p30) / p30 < -0.2 THEN 'crash'
  WHEN (p7 - p30) / p30 > 0 THEN 'rising' ELSE 'falling' END AS regime FROM p WHERE p7 IS NOT NULL AND p30 > 0"""


@query("price_trend_regimes", _TREND_SQL)
def price_trend_regimes(spark: SparkSession, d: str) -> DataFrame:
    mo = V.market_orders(spark, d).select("type_id", "price", "observed_at")
    t = mo.agg(F.max("observed_at").alias("m"))
    inside = F.col("observed_at") >= F.col("m") - F.expr("INTERVAL 90 DAYS")
    p = mo.join(F.broadcast(t), F.col("observed_at") >= F.col("m") - F.expr("INTERVAL 365 DAYS")).groupBy("type_id")
    p = p.agg(safe_div(exact_sum(F.when(inside, F.col("price"))), F.count(F.when(inside, 1)), None).alias("p7"), (exact_sum(F.col("price")) / F.count(F.lit(1))).alias("p30")).where("p7 is not null and p30 > 0")
    v = (F.col("p7") - F.col("p30")) / F.col("p30")
    return p.select("type_id", rnd(v, 6).alias("velocity"), F.when(F.abs(v) < 0.05, "stable").when(v > 0.2, "spike").when(v < -0.2, "crash").when(v > 0, "rising").otherwise("falling").alias("regime"))


@query("buyall_plan", V.ctes("km", "ki", "mo") + """, t AS (SELECT max(killmail_time) AS m FROM km),
dm AS (SELECT item_type_id AS type_id, CAST(ceil(sum(quantity_destroyed + quantity_dropped) / 90.0 * 14) AS BIGINT) AS demand FROM km JOIN ki USING (sequence_id), t WHERE killmail_time >= m - INTERVAL 90 DAY GROUP BY 1),
st AS (SELECT type_id, CAST(sum(volume_remain) AS BIGINT) AS stock FROM mo WHERE source_type = 'alliance_structure' AND NOT is_buy_order AND observed_at >= (SELECT m FROM t) - INTERVAL 14 DAY GROUP BY 1),
pr AS (SELECT type_id, coalesce(min(CASE WHEN NOT is_buy_order THEN price END), max(CASE WHEN is_buy_order THEN price END), 0) AS unit FROM mo WHERE source_type = 'market_hub' GROUP BY 1)
SELECT type_id, demand, coalesce(stock, 0) AS stock, greatest(0, demand - coalesce(stock, 0)) AS buy, CAST(ROUND(CAST(coalesce(unit, 0) AS DECIMAL(20,4)) * greatest(0, demand - coalesce(stock, 0)), 2) AS DOUBLE) AS line_cost,
  CAST(greatest(0, demand - coalesce(stock, 0)) * p_size AS BIGINT) AS line_volume FROM dm LEFT JOIN st USING (type_id) LEFT JOIN pr USING (type_id) JOIN part ON p_partkey = type_id WHERE demand > coalesce(stock, 0)""")  # fmt: skip
def buyall_plan(spark: SparkSession, d: str, window_days: int = 90, runway_days: int = 14) -> DataFrame:
    """Demand over the runway less stock, priced at the hub's ask, else bid."""
    km = V.killmails(spark, d).select("sequence_id", "killmail_time")
    t = F.broadcast(km.agg(F.max("killmail_time").alias("m")))
    recent = km.join(t, F.col("killmail_time") >= F.col("m") - F.expr(f"INTERVAL {window_days} DAYS")).select("sequence_id")
    lost = F.sum(F.col("quantity_destroyed") + F.col("quantity_dropped"))
    dm = recent.join(V.killmail_items(spark, d), "sequence_id").groupBy(F.col("item_type_id").alias("type_id")).agg(F.ceil(lost / float(window_days) * runway_days).alias("demand"))
    mo = V.market_orders(spark, d)
    st = mo.where("source_type = 'alliance_structure' and not is_buy_order").join(t, F.col("observed_at") >= F.col("m") - F.expr("INTERVAL 14 DAYS")).groupBy("type_id").agg(F.sum("volume_remain").alias("stock"))
    buy_side = F.col("is_buy_order")
    pr = mo.where("source_type = 'market_hub'").groupBy("type_id").agg(F.coalesce(F.min(F.when(~buy_side, F.col("price"))), F.max(F.when(buy_side, F.col("price")))).alias("unit"))
    part = V.read(spark, d, "part").select(F.col("p_partkey").alias("type_id"), "p_size")
    j = dm.join(st, "type_id", "left").join(pr, "type_id", "left").join(part, "type_id")
    stock = F.coalesce("stock", F.lit(0))
    buy = F.greatest(F.lit(0), F.col("demand") - stock)
    cost = F.round(rnd(F.coalesce("unit", F.lit(0.0))).cast("decimal(20,4)") * buy.cast("decimal(10,0)"), 2).cast("double")
    return j.where(F.col("demand") > stock).select("type_id", "demand", stock.alias("stock"), buy.alias("buy"), cost.alias("line_cost"), (buy * F.col("p_size")).cast("bigint").alias("line_volume"))


@query("economic_pressure", V.ctes("km", "ki") + """, f AS (SELECT item_type_id AS type_id, victim_alliance_id, CAST(sum(quantity_destroyed) AS BIGINT) AS destroyed FROM km JOIN ki USING (sequence_id) GROUP BY 1, 2),
t AS (SELECT count(DISTINCT victim_alliance_id) AS n FROM km), s AS (SELECT type_id, count(DISTINCT victim_alliance_id) AS alliances, CAST(sum(destroyed) AS BIGINT) AS destroyed FROM f GROUP BY 1),
p AS (SELECT p_partkey AS type_id, count(*) OVER (PARTITION BY p_brand) AS fam, count(*) OVER (PARTITION BY p_brand, p_type) - 1 AS subs, p_retailprice AS price FROM part),
z AS (SELECT type_id, alliances, destroyed, 0.6 * (1.0 / fam) + 0.4 * alliances / n AS penetration, 1 - least(1.0, subs / 8.0) AS substitution, 0.7 * (1 - least(1.0, destroyed / 1000.0)) + 0.3 * least(1.0, log10(price) / 10) AS friction,
  least(1.0, destroyed / 30.0 / 10.0) AS pressure FROM s JOIN p USING (type_id), t)
SELECT type_id, alliances, destroyed, round(penetration, 6) AS penetration, round(substitution, 6) AS substitution, round(friction, 6) AS friction, round(pressure, 6) AS pressure,
  round(0.15 * penetration + 0.25 * substitution + 0.20 * friction + 0.10 * pressure, 6) AS score FROM z""")  # fmt: skip
def economic_pressure(spark: SparkSession, d: str) -> DataFrame:
    """Sub-scores of economic warfare per item: penetration, substitution, friction and pressure."""
    km = V.killmails(spark, d).select("sequence_id", "victim_alliance_id")
    n = F.broadcast(km.agg(F.countDistinct("victim_alliance_id").alias("n_all")))
    f = km.join(V.killmail_items(spark, d), "sequence_id").groupBy(F.col("item_type_id").alias("type_id"), "victim_alliance_id").agg(F.sum("quantity_destroyed").alias("x"))
    s = f.groupBy("type_id").agg(F.count(F.lit(1)).alias("alliances"), F.sum("x").alias("destroyed"))
    part = V.read(spark, d, "part").select(
        F.col("p_partkey").alias("type_id"), F.count(F.lit(1)).over(Window.partitionBy("p_brand")).alias("fam"), (F.count(F.lit(1)).over(Window.partitionBy("p_brand", "p_type")) - 1).alias("subs"), F.col("p_retailprice").alias("price")
    )
    j = s.join(part, "type_id").crossJoin(n)  # one row
    pen = 0.6 * (1.0 / F.col("fam")) + 0.4 * F.col("alliances") / F.col("n_all")
    sub = 1 - F.least(F.lit(1.0), F.col("subs") / 8.0)
    fri = 0.7 * (1 - F.least(F.lit(1.0), F.col("destroyed") / 1000.0)) + 0.3 * F.least(F.lit(1.0), F.log10("price") / 10)
    pre = F.least(F.lit(1.0), F.col("destroyed") / 30.0 / 10.0)
    r = lambda c, name: rnd(c, 6).alias(name)
    return j.select("type_id", "alliances", "destroyed", r(pen, "penetration"), r(sub, "substitution"), r(fri, "friction"), r(pre, "pressure"), r(0.15 * pen + 0.25 * sub + 0.20 * fri + 0.10 * pre, "score"))


@query("dashboard_kpis", V.ctes("mo") + """SELECT count(*) AS orders, count(DISTINCT type_id) AS types, CAST(sum(CAST(is_buy_order AS BIGINT)) AS BIGINT) AS bids, count(DISTINCT CASE WHEN source_type = 'market_hub' THEN type_id END) AS hub_types,
  round(100.0 * count(DISTINCT CASE WHEN source_type = 'alliance_structure' THEN type_id END) / count(DISTINCT type_id), 4) AS coverage_pct, max(observed_at) AS fresh_at FROM mo""")  # fmt: skip
def dashboard_kpis(spark: SparkSession, d: str) -> DataFrame:
    mo = V.market_orders(spark, d)
    # distinct types first, so that the counts of distinct values need no expansion of all rows
    t = mo.groupBy("type_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("is_buy_order").cast("bigint")).alias("b"), F.max((F.col("source_type") == "market_hub").cast("int")).alias("hub"), F.max((F.col("source_type") != "market_hub").cast("int")).alias("own"), F.max("observed_at").alias("at"))
    return t.agg(F.sum("n").alias("orders"), F.count(F.lit(1)).alias("types"), F.sum("b").alias("bids"), F.sum("hub").alias("hub_types"), rnd(100.0 * F.sum("own") / F.count(F.lit(1)), 4).alias("coverage_pct"), F.max("at").alias("fresh_at"))


@query("fit_families", """WITH f AS (SELECT l_orderkey AS sequence_id, list_sort(list(DISTINCT l_partkey % 40)) AS modules FROM lineitem GROUP BY 1),
x AS (SELECT modules, count(*) AS n FROM f GROUP BY 1)
SELECT array_to_string(modules, ',') AS fingerprint, CAST(len(modules) AS INTEGER) AS n_modules, n, round(1 - exp(-n / 5.0), 6) AS confidence FROM x""")  # fmt: skip
def fit_families(spark: SparkSession, d: str) -> DataFrame:
    """Exact fingerprints of fits with their confidence; merging by Jaccard is operators.fits.merge_families."""
    f = V.read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set(F.col("l_partkey") % 40)).alias("modules"))
    x = f.groupBy("modules").agg(F.count(F.lit(1)).alias("n"))
    return x.select(F.array_join(F.col("modules").cast("array<string>"), ",").alias("fingerprint"), F.size("modules").alias("n_modules"), "n", rnd(1 - F.exp(-F.col("n") / 5.0), 6).alias("confidence"))


@query("type_names_resolved", """SELECT l_partkey AS type_id, coalesce(nullif(trim(p_name), ''), concat('Type #', CAST(l_partkey AS VARCHAR))) AS label, concat_ws(':', CAST(l_suppkey AS VARCHAR), CAST(l_partkey AS VARCHAR)) AS key, count(*) AS n
FROM lineitem LEFT JOIN part ON p_partkey = l_partkey AND p_size > 25 WHERE l_quantity BETWEEN 10 AND 40 AND l_returnflag IN ('R', 'A') GROUP BY ALL HAVING count(*) >= 2""")  # fmt: skip
def type_names_resolved(spark: SparkSession, d: str) -> DataFrame:
    """Labels with a fallback over a filtered order book: BETWEEN, IN, HAVING and an outer join to a dimension."""
    li = V.read(spark, d, "lineitem").where(F.col("l_quantity").between(10, 40) & F.col("l_returnflag").isin("R", "A"))
    dim = V.read(spark, d, "part").where("p_size > 25").select("p_partkey", "p_name")
    # counted before the join: the label depends on the type alone
    n = li.groupBy("l_partkey", "l_suppkey").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")
    j = n.join(dim, n.l_partkey == dim.p_partkey, "left")
    return j.select(F.col("l_partkey").alias("type_id"), F.coalesce(F.nullif(F.trim("p_name"), F.lit("")), F.concat(F.lit("Type #"), F.col("l_partkey").cast("string"))).alias("label"), F.concat_ws(":", F.col("l_suppkey").cast("string"), F.col("l_partkey").cast("string")).alias("key"), "n")


@query("top_sources_per_type", V.ctes("mo") + """, s AS (SELECT type_id, source_id, CAST(sum(volume_remain) AS BIGINT) AS volume FROM mo GROUP BY 1, 2)
SELECT type_id, source_id, volume, CAST(row_number() OVER (PARTITION BY type_id ORDER BY volume DESC, source_id) AS INTEGER) AS rn FROM s QUALIFY rn <= 3""")  # fmt: skip
def top_sources_per_type(spark: SparkSession, d: str) -> DataFrame:
    s = V.market_orders(spark, d).groupBy("type_id", "source_id").agg(F.sum("volume_remain").alias("volume"))
    return top_k(s, ["type_id"], [F.desc("volume"), "source_id"], 3)
