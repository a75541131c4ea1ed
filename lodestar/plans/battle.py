"""Battles and theaters: rollups, target and side metrics, actors, suspicion, types, escalation, timelines, ledgers, composition.

The fixture's battle is a system and a day; window and least participants are parameters (15 minutes and 20 on dense data).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.functions.kernels import clamp, exact_sum, rnd, safe_div, tier
from lodestar.operators.graph import cut
from lodestar.operators.relational import gap_islands, value_counts_ranked
from lodestar.plans.registry import query
from lodestar.sources import views as V

WINDOW_SECONDS = 86_400
MIN_PARTICIPANTS = 13


def with_battle(events: DataFrame, seconds: int = WINDOW_SECONDS) -> DataFrame:
    start = F.floor(F.unix_seconds("ts") / seconds) * seconds
    return events.withColumn("bucket", start).withColumn("battle_id", F.sha2(F.concat_ws(":", F.col("system_id").cast("string"), start.cast("string")), 256))


BATTLE = V.ctes("es") + """, b AS (SELECT *, CAST(floor(epoch(ts) / 86400) * 86400 AS BIGINT) AS bucket, sha256(concat(system_id, ':', CAST(floor(epoch(ts) / 86400) * 86400 AS BIGINT))) AS battle_id FROM es)"""


@query("battle_rollups", BATTLE + """, g AS (SELECT battle_id, min(system_id) AS system_id, min(ts) AS started_at, max(ts) AS ended_at, count(*) AS n_events, count(DISTINCT character_id) AS participants, count(DISTINCT side_key) AS sides,
CAST(sum(CAST(damage AS DECIMAL(20,4))) AS DOUBLE) AS damage FROM b GROUP BY 1)
SELECT battle_id, system_id, started_at, ended_at, n_events, participants, sides, round(damage, 4) AS damage, greatest(1, CAST(floor(epoch(ended_at)) - floor(epoch(started_at)) AS BIGINT)) AS duration_seconds,
  CASE WHEN participants >= 200 THEN 'mega' WHEN participants >= 100 THEN 'large' WHEN participants >= 50 THEN 'medium' WHEN participants >= 20 THEN 'small' ELSE 'micro' END AS size_class, participants >= 13 AS eligible FROM g""")  # fmt: skip
def battle_rollups(spark: SparkSession, d: str, seconds: int = WINDOW_SECONDS, least: int = MIN_PARTICIPANTS) -> DataFrame:
    g = with_battle(V.event_stream(spark, d), seconds).groupBy("battle_id").agg(
        F.min("system_id").alias("system_id"), F.min("ts").alias("started_at"), F.max("ts").alias("ended_at"), F.count(F.lit(1)).alias("n_events"), F.countDistinct("character_id").alias("participants"),
        F.countDistinct("side_key").alias("sides"), rnd(exact_sum(F.col("damage"))).alias("damage"),
    )
    size = tier(F.col("participants"), [(200, "mega"), (100, "large"), (50, "medium"), (20, "small")], "micro")
    return g.withColumn("duration_seconds", F.greatest(F.lit(1), F.unix_seconds("ended_at") - F.unix_seconds("started_at"))).withColumn("size_class", size).withColumn("eligible", F.col("participants") >= least)


@query("battle_participants", BATTLE + """SELECT battle_id, character_id, count(DISTINCT event_id) AS events, count(*) AS rows_seen, first(side_key ORDER BY ts, event_id) AS side_key, min(ts) AS first_seen, max(ts) AS last_seen,
count(DISTINCT ship_type_id) AS ships, round(CAST(sum(CAST(damage AS DECIMAL(20,4))) AS DOUBLE), 4) AS damage FROM b GROUP BY 1, 2""")  # fmt: skip
def battle_participants(spark: SparkSession, d: str) -> DataFrame:
    return with_battle(V.event_stream(spark, d)).groupBy("battle_id", "character_id").agg(
        F.countDistinct("event_id").alias("events"), F.count(F.lit(1)).alias("rows_seen"), F.min_by("side_key", F.struct("ts", "event_id")).alias("side_key"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"),
        F.countDistinct("ship_type_id").alias("ships"), rnd(exact_sum(F.col("damage"))).alias("damage"),
    )


DPS_CUTS = [(2000, "2000+"), (1000, "1000-2000"), (500, "500-1000"), (250, "250-500"), (100, "100-250")]
TARGETS = BATTLE + """, t AS (SELECT *, greatest(1, CAST(floor(epoch(ts)) - floor(epoch(min(ts) OVER (PARTITION BY battle_id))) AS BIGINT)) AS ttd FROM b),
u AS (SELECT *, ship_type_id % 8 AS hull, damage / ttd * 10000 AS dps FROM t WHERE damage > 0 AND ship_type_id > 0),
v AS (SELECT *, CASE WHEN dps >= 2000 THEN '2000+' WHEN dps >= 1000 THEN '1000-2000' WHEN dps >= 500 THEN '500-1000' WHEN dps >= 250 THEN '250-500' WHEN dps >= 100 THEN '100-250' ELSE '<100' END AS dps_bucket FROM u),
r AS (SELECT *, row_number() OVER (PARTITION BY hull, dps_bucket ORDER BY ttd, event_id) AS rn, count(*) OVER (PARTITION BY hull, dps_bucket) AS n FROM v),
m AS (SELECT hull, dps_bucket, max(CASE WHEN rn = n // 2 + 1 THEN ttd END) AS med FROM r GROUP BY 1, 2),
tm AS (SELECT event_id, battle_id, side_key, character_id, ttd, dps_bucket, greatest(1, med) AS expected_ttd, greatest(0.05, least(8.0, ttd / greatest(1, med))) AS sustain FROM v JOIN m USING (hull, dps_bucket))"""


def target_table(spark: SparkSession, d: str) -> DataFrame:
    """Time to die, damage rate and how long targets last against the upper median of their hull and rate bucket, over all rows."""
    b = with_battle(V.event_stream(spark, d))
    start = b.groupBy("battle_id").agg(F.min("ts").alias("started"))
    t = b.join(start, "battle_id").withColumn("ttd", F.greatest(F.lit(1), F.unix_seconds("ts") - F.unix_seconds("started"))).where("damage > 0 and ship_type_id > 0")
    t = t.withColumn("hull", F.col("ship_type_id") % 8).withColumn("dps", F.col("damage") / F.col("ttd") * 10000).withColumn("dps_bucket", tier(F.col("dps"), DPS_CUTS, "<100"))
    # upper median from counts of equal values: sorted[n // 2]
    c = t.groupBy("hull", "dps_bucket", "ttd").agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy("hull", "dps_bucket")
    c = c.withColumn("upto", F.sum("c").over(w.orderBy("ttd"))).withColumn("n", F.sum("c").over(w))
    med = c.where(F.col("upto") >= F.floor(F.col("n") / 2) + 1).groupBy("hull", "dps_bucket").agg(F.min("ttd").alias("med"))
    e = F.greatest(F.lit(1), F.col("med"))
    return t.join(F.broadcast(med), ["hull", "dps_bucket"]).select("event_id", "battle_id", "side_key", "character_id", "ttd", "dps_bucket", e.alias("expected_ttd"), clamp(F.col("ttd") / e, 0.05, 8.0).alias("sustain"))


@query("target_metrics", TARGETS + "SELECT event_id, battle_id, ttd, dps_bucket, expected_ttd, round(sustain, 6) AS sustain FROM tm")
def target_metrics(spark: SparkSession, d: str) -> DataFrame:
    return target_table(spark, d).select("event_id", "battle_id", "ttd", "dps_bucket", "expected_ttd", rnd("sustain", 6).alias("sustain"))


SIDES = TARGETS + """, s AS (SELECT battle_id, side_key, count(*) AS kills, count(DISTINCT character_id) AS pilots, CAST(sum(CAST(sustain AS DECIMAL(20,4))) AS DOUBLE) / count(*) AS avg_sustain FROM tm GROUP BY 1, 2),
g AS (SELECT battle_id, count(DISTINCT character_id) AS participants, greatest(1, CAST(floor(epoch(max(ts))) - floor(epoch(min(ts))) AS BIGINT)) / 60.0 AS dur_min FROM b GROUP BY 1),
e AS (SELECT *, CASE WHEN participants >= 14 THEN 'upper' ELSE 'lower' END AS size_class, avg_sustain / ln(1 + kills / greatest(1, dur_min) + 1e-6) AS eff FROM s JOIN g USING (battle_id)),
z AS (SELECT *, round(CASE WHEN stddev_pop(eff) OVER (PARTITION BY size_class) > 0 THEN (eff - avg(eff) OVER (PARTITION BY size_class)) / stddev_pop(eff) OVER (PARTITION BY size_class) ELSE 0 END, 4) AS z, cume_dist() OVER (ORDER BY round(eff, 6)) AS pct FROM e)"""


def side_scores(spark: SparkSession, d: str) -> DataFrame:
    """Side metrics and their z within the size class, aggregated on each side of the join before it, so no count is multiplied."""
    b = with_battle(V.event_stream(spark, d))
    s = target_table(spark, d).groupBy("battle_id", "side_key").agg(F.count(F.lit(1)).alias("kills"), F.countDistinct("character_id").alias("pilots"), (exact_sum(F.col("sustain")) / F.count(F.lit(1))).alias("avg_sustain"))
    g = b.groupBy("battle_id").agg(F.countDistinct("character_id").alias("participants"), (F.greatest(F.lit(1), F.unix_seconds(F.max("ts")) - F.unix_seconds(F.min("ts"))) / 60.0).alias("dur_min"))
    e = s.join(g, "battle_id").withColumn("size_class", F.when(F.col("participants") >= 14, "upper").otherwise("lower"))
    e = e.withColumn("eff", F.col("avg_sustain") / F.log(1 + F.col("kills") / F.greatest(F.lit(1.0), F.col("dur_min")) + 1e-6)).withColumn("eff6", rnd("eff", 6))
    st = e.groupBy("size_class").agg(F.avg("eff").alias("mu"), F.stddev_pop("eff").alias("sd"))
    return e.join(F.broadcast(st), "size_class").withColumn("z", rnd(safe_div(F.col("eff") - F.col("mu"), F.col("sd"))))


def side_table(spark: SparkSession, d: str) -> DataFrame:
    """Side scores with percentiles, from counts of values."""
    e = cut(side_scores(spark, d))  # read twice below
    return e.join(value_counts_ranked(e, "eff6"), "eff6").withColumn("pct", F.col("upto") / F.col("total"))


@query("side_anomalies", SIDES + """SELECT battle_id, side_key, kills, pilots, size_class, round(eff, 6) AS efficiency, z, round(pct, 6) AS pct, CASE WHEN z > 2 THEN 'high_sustain' WHEN z < -1 THEN 'low_sustain' ELSE 'normal' END AS anomaly FROM z""")
def side_anomalies(spark: SparkSession, d: str) -> DataFrame:
    z = F.col("z")
    return side_table(spark, d).select("battle_id", "side_key", "kills", "pilots", "size_class", F.col("eff6").alias("efficiency"), "z", rnd("pct", 6).alias("pct"), F.when(z > 2, "high_sustain").when(z < -1, "low_sustain").otherwise("normal").alias("anomaly"))


ACTORS = BATTLE + """, p AS (SELECT battle_id, character_id, count(DISTINCT event_id) AS pc, max(CAST(ship_type_id % 10 = 0 AS INT)) AS logi, max(CAST(ship_type_id % 10 = 1 AS INT)) AS command, max(CAST(ship_type_id % 25 = 2 AS INT)) AS capital,
first(side_key ORDER BY ts, event_id) AS side_key FROM b GROUP BY 1, 2), a AS (SELECT *, pc / greatest(1, max(pc) OVER (PARTITION BY battle_id)) AS centrality FROM p)"""


def actor_table(spark: SparkSession, d: str) -> DataFrame:
    ship = F.col("ship_type_id")
    p = with_battle(V.event_stream(spark, d)).groupBy("battle_id", "character_id").agg(
        F.countDistinct("event_id").alias("pc"), F.max((ship % 10 == 0).cast("int")).alias("logi"), F.max((ship % 10 == 1).cast("int")).alias("command"), F.max((ship % 25 == 2).cast("int")).alias("capital"),
        F.min_by("side_key", F.struct("ts", "event_id")).alias("side_key"),
    )
    p = p.withColumn("centrality", F.col("pc") / F.greatest(F.lit(1), F.max("pc").over(Window.partitionBy("battle_id"))))
    return p.withColumn("visibility", F.least(F.lit(1.0), F.col("centrality") + 0.2 * F.col("logi") + 0.2 * F.col("command") + 0.3 * F.col("capital")))


@query("actor_features", ACTORS + "SELECT battle_id, character_id, pc, logi, command, capital, round(centrality, 6) AS centrality, round(least(1.0, centrality + 0.2 * logi + 0.2 * command + 0.3 * capital), 6) AS visibility FROM a")
def actor_features(spark: SparkSession, d: str) -> DataFrame:
    return actor_table(spark, d).select("battle_id", "character_id", "pc", "logi", "command", "capital", rnd("centrality", 6).alias("centrality"), rnd("visibility", 6).alias("visibility"))


@query("suspicion_v1", SIDES + """, p AS (SELECT battle_id, character_id, max(CAST(ship_type_id % 10 = 0 AS INT)) AS logi, max(CAST(ship_type_id % 10 = 1 AS INT)) AS command, max(CAST(ship_type_id % 25 = 2 AS INT)) AS capital, first(side_key ORDER BY ts, event_id) AS side_key FROM b GROUP BY 1, 2),
bz AS (SELECT battle_id, CAST(sum(CAST(z AS DECIMAL(20,4))) AS DOUBLE) AS zs, count(*) AS zn FROM z GROUP BY 1), tot AS (SELECT sum(zs) AS ts, sum(zn) AS tn FROM bz),
o AS (SELECT p.*, coalesce(zs, 0) AS zs, coalesce(zn, 0) AS zn, coalesce(z.z, 0) AS own, coalesce(CAST(z.z IS NOT NULL AS INT), 0) AS has, CAST(coalesce(z.z, 0) > 2 AS INT) AS hs, CAST(coalesce(z.z, 0) < -1 AS INT) AS ls FROM p LEFT JOIN bz USING (battle_id) LEFT JOIN z ON z.battle_id = p.battle_id AND z.side_key = p.side_key),
f AS (SELECT character_id, count(*) AS battles, sum(hs) / count(*) AS hs, sum(ls) / count(*) AS ls, (count(DISTINCT side_key) - 1) / count(*) AS cross_side, least(1.0, sum(2 * logi + 2 * command + 3 * capital) / (3.0 * count(*))) AS role,
  CAST(sum(CAST(zs - own AS DECIMAL(20,4))) AS DOUBLE) AS os, sum(zn - has) AS onn, CAST(sum(CAST(zs AS DECIMAL(20,4))) AS DOUBLE) AS bs, sum(zn) AS bn FROM o GROUP BY 1)
SELECT character_id, battles, round(hs, 6) AS high_sustain, round(cross_side, 6) AS cross_side, round(role, 6) AS role, round(CASE WHEN onn > 0 THEN os / onn ELSE 0 END - CASE WHEN tn - bn > 0 THEN (ts - bs) / (tn - bn) ELSE 0 END, 4) AS uplift,
  round(CASE WHEN battles < 5 THEN 0 ELSE greatest(0, least(1, 0.2 * hs + 0.12 * cross_side + 0.22 * (CASE WHEN onn > 0 THEN os / onn ELSE 0 END - CASE WHEN tn - bn > 0 THEN (ts - bs) / (tn - bn) ELSE 0 END) + 0.08 * (hs - ls) + 0.08 * role)) END, 4) AS score FROM f, tot""")  # fmt: skip
def suspicion_v1(spark: SparkSession, d: str) -> DataFrame:
    """Uplift of the opposing sides' anomaly where a pilot is present, against all other battles: totals less what was present."""
    z = cut(side_scores(spark, d).select("battle_id", "side_key", "z"))
    bz = z.groupBy("battle_id").agg(exact_sum(F.col("z")).alias("zs"), F.count(F.lit(1)).alias("zn"))
    tot = F.broadcast(bz.agg(F.sum("zs").alias("ts"), F.sum("zn").alias("tn")))  # one row
    o = actor_table(spark, d).join(bz, "battle_id", "left").join(z, ["battle_id", "side_key"], "left")
    own, zs, zn = F.coalesce("z", F.lit(0.0)), F.coalesce("zs", F.lit(0.0)), F.coalesce("zn", F.lit(0))
    n = F.count(F.lit(1))
    f = o.groupBy("character_id").agg(
        n.alias("battles"), (F.sum((own > 2).cast("int")) / n).alias("hs"), (F.sum((own < -1).cast("int")) / n).alias("ls"), ((F.countDistinct("side_key") - 1) / n).alias("cross_side"),
        F.least(F.lit(1.0), F.sum(2 * F.col("logi") + 2 * F.col("command") + 3 * F.col("capital")) / (3.0 * n)).alias("role"), exact_sum(zs - own).alias("os"), F.sum(zn - F.col("z").isNotNull().cast("int")).alias("onn"),
        exact_sum(zs).alias("bs"), F.sum(zn).alias("bn"),
    ).crossJoin(tot)
    up = safe_div(F.col("os"), F.col("onn")) - safe_div(F.col("ts") - F.col("bs"), F.col("tn") - F.col("bn"))
    score = F.when(F.col("battles") < 5, 0.0).otherwise(clamp(0.2 * F.col("hs") + 0.12 * F.col("cross_side") + 0.22 * up + 0.08 * (F.col("hs") - F.col("ls")) + 0.08 * F.col("role")))
    return f.select("character_id", "battles", rnd("hs", 6).alias("high_sustain"), rnd("cross_side", 6).alias("cross_side"), rnd("role", 6).alias("role"), rnd(up).alias("uplift"), rnd(score).alias("score"))


@query("battle_types", ACTORS + """, g AS (SELECT battle_id, greatest(1, CAST(floor(epoch(max(ts))) - floor(epoch(min(ts))) AS BIGINT)) AS dur, count(DISTINCT character_id) AS n, count(DISTINCT side_key) AS sides FROM b GROUP BY 1),
s AS (SELECT battle_id, max(c) / sum(c) AS imbalance FROM (SELECT battle_id, side_key, count(*) AS c FROM p GROUP BY 1, 2) GROUP BY 1), c AS (SELECT battle_id, sum(capital) / count(*) AS cap FROM p GROUP BY 1)
SELECT battle_id, n, sides, round(imbalance, 6) AS imbalance, CASE WHEN sides >= 5 THEN 'third_party' WHEN dur <= 120 AND n < 50 THEN 'camp' WHEN dur >= 600 AND n >= 13 AND cap >= 0.1 THEN 'timer' WHEN imbalance >= 0.5 AND n >= 10 THEN 'defense' ELSE 'skirmish' END AS battle_type,
  round(CASE WHEN sides >= 5 THEN least(1.0, 0.6 + 0.1 * (sides - 3)) WHEN dur <= 120 AND n < 50 THEN 0.7 WHEN dur >= 600 AND n >= 13 AND cap >= 0.1 THEN least(1.0, 0.6 + 0.15 * cap + 0.002 * n) WHEN imbalance >= 0.5 AND n >= 10 THEN 0.5 + 0.3 * imbalance ELSE 0.5 END, 6) AS confidence
FROM g JOIN s USING (battle_id) JOIN c USING (battle_id)""")  # fmt: skip
def battle_types(spark: SparkSession, d: str, third_sides: int = 5, timer_n: int = 13, defense: float = 0.5) -> DataFrame:
    """An ordered decision list; its cuts are parameters."""
    b = with_battle(V.event_stream(spark, d))
    g = b.groupBy("battle_id").agg(F.greatest(F.lit(1), F.unix_seconds(F.max("ts")) - F.unix_seconds(F.min("ts"))).alias("dur"), F.countDistinct("character_id").alias("n"), F.countDistinct("side_key").alias("sides"))
    a = actor_table(spark, d).groupBy("battle_id", "side_key").agg(F.count(F.lit(1)).alias("c"), F.sum("capital").alias("caps")).groupBy("battle_id").agg((F.max("c") / F.sum("c")).alias("imbalance"), (F.sum("caps") / F.sum("c")).alias("cap"))
    third, camp = F.col("sides") >= third_sides, (F.col("dur") <= 120) & (F.col("n") < 50)
    timer, dfn = (F.col("dur") >= 600) & (F.col("n") >= timer_n) & (F.col("cap") >= 0.1), (F.col("imbalance") >= defense) & (F.col("n") >= 10)
    kind = F.when(third, "third_party").when(camp, "camp").when(timer, "timer").when(dfn, "defense").otherwise("skirmish")
    conf = F.when(third, F.least(F.lit(1.0), 0.6 + 0.1 * (F.col("sides") - 3))).when(camp, 0.7).when(timer, F.least(F.lit(1.0), 0.6 + 0.15 * F.col("cap") + 0.002 * F.col("n"))).when(dfn, 0.5 + 0.3 * F.col("imbalance")).otherwise(0.5)
    return g.join(a, "battle_id").select("battle_id", "n", "sides", rnd("imbalance", 6).alias("imbalance"), kind.alias("battle_type"), rnd(conf, 6).alias("confidence"))


@query("theater_clusters", BATTLE + """, g AS (SELECT battle_id, min(system_id) AS system_id, system_id % 3 AS region, min(ts) AS s, max(ts) AS e FROM b GROUP BY battle_id, system_id % 3),
o AS (SELECT *, max(e) OVER (PARTITION BY region ORDER BY s, battle_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM g),
i AS (SELECT *, sum(CASE WHEN pe IS NULL OR epoch_us(s) - epoch_us(pe) > 2700000000 THEN 1 ELSE 0 END) OVER (PARTITION BY region ORDER BY s, battle_id ROWS UNBOUNDED PRECEDING) AS island FROM o)
SELECT region, CAST(island AS BIGINT) AS island, count(*) AS battles, count(DISTINCT system_id) AS systems, min(s) AS started_at, max(e) AS ended_at, sha256(string_agg(battle_id, '|' ORDER BY battle_id)) AS theater_id FROM i GROUP BY 1, 2""")  # fmt: skip
def theater_clusters(spark: SparkSession, d: str, gap_minutes: int = 45) -> DataFrame:
    """Battles of one area that begin within the gap of the latest end before them; the id hashes the sorted battle ids."""
    g = with_battle(V.event_stream(spark, d)).groupBy("battle_id", (F.col("system_id") % 3).alias("region")).agg(F.min("system_id").alias("system_id"), F.min("ts").alias("s"), F.max("ts").alias("e"))
    i = gap_islands(g, ["region"], "s", "e", "battle_id", gap_minutes * 60)
    return i.groupBy("region", "island").agg(F.count(F.lit(1)).alias("battles"), F.countDistinct("system_id").alias("systems"), F.min("s").alias("started_at"), F.max("e").alias("ended_at"), F.sha2(F.array_join(F.array_sort(F.collect_list("battle_id")), "|"), 256).alias("theater_id"))


TIMELINE = V.ctes("es") + """, m AS (SELECT system_id, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS bucket, count(DISTINCT CASE WHEN side_key IN ('click', 'view') THEN event_id END) AS a, count(DISTINCT CASE WHEN side_key NOT IN ('click', 'view') THEN event_id END) AS b FROM es GROUP BY 1, 2),
w AS (SELECT *, sum(a) OVER x AS sa, sum(b) OVER x AS sb FROM m WINDOW x AS (PARTITION BY system_id ORDER BY bucket ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)), tl AS (SELECT system_id, bucket, a AS side_a, b AS side_b, round((sa - sb) / (sa + sb), 6) AS momentum FROM w)"""


def timeline(spark: SparkSession, d: str, unit: str = "hour") -> DataFrame:
    """Kills of either side per bucket, and momentum over the last five present buckets."""
    first = F.col("side_key").isin("click", "view")
    m = V.event_stream(spark, d).groupBy("system_id", F.date_trunc(unit, "ts").alias("bucket")).agg(F.countDistinct(F.when(first, F.col("event_id"))).alias("side_a"), F.countDistinct(F.when(~first, F.col("event_id"))).alias("side_b"))
    w = Window.partitionBy("system_id").orderBy("bucket").rowsBetween(-4, 0)
    sa, sb = F.sum("side_a").over(w), F.sum("side_b").over(w)
    return m.withColumn("momentum", rnd((sa - sb) / (sa + sb), 6))


@query("theater_timeline", TIMELINE + "SELECT * FROM tl")
def theater_timeline(spark: SparkSession, d: str) -> DataFrame:
    return timeline(spark, d)


@query("turning_points", TIMELINE + ", l AS (SELECT *, momentum - lag(momentum) OVER (PARTITION BY system_id ORDER BY bucket) AS delta FROM tl) SELECT system_id, bucket, momentum, round(delta, 6) AS delta FROM l WHERE abs(round(delta, 6)) >= 0.3")
def turning_points(spark: SparkSession, d: str, least: float = 0.3) -> DataFrame:
    delta = F.col("momentum") - F.lag("momentum").over(Window.partitionBy("system_id").orderBy("bucket"))
    return timeline(spark, d).withColumn("delta", rnd(delta, 6)).where(F.abs("delta") >= least).select("system_id", "bucket", "momentum", "delta")


@query("character_ledger", V.ctes("km", "ka") + """, v AS (SELECT victim_character_id AS character_id, count(*) AS losses, CAST(sum(CAST(total_value AS DECIMAL(20,4))) AS DOUBLE) AS isk_lost FROM km GROUP BY 1),
f AS (SELECT character_id, count(*) AS final_kills, CAST(sum(CAST(total_value AS DECIMAL(20,4))) AS DOUBLE) AS isk_killed FROM ka JOIN km USING (sequence_id) WHERE final_blow GROUP BY 1),
a AS (SELECT character_id, count(DISTINCT sequence_id) AS contributed, CAST(sum(CAST(damage_done AS DECIMAL(20,4))) AS DOUBLE) AS damage FROM ka GROUP BY 1)
SELECT character_id, coalesce(losses, 0) AS losses, round(coalesce(isk_lost, 0), 2) AS isk_lost, coalesce(final_kills, 0) AS final_kills, round(coalesce(isk_killed, 0), 2) AS isk_killed, coalesce(contributed, 0) AS contributed_kills, round(coalesce(damage, 0), 2) AS damage
FROM v FULL JOIN f USING (character_id) FULL JOIN a USING (character_id)""")  # fmt: skip
def character_ledger(spark: SparkSession, d: str) -> DataFrame:
    return ledger(V.killmails(spark, d), V.attackers(spark, d))


def ledger(km: DataFrame, ka: DataFrame) -> DataFrame:
    """Losses and value once per killmail; value killed for the final blow only; contribution per distinct killmail; damage per row."""
    tall = km.select(F.col("victim_character_id").alias("character_id"), F.lit(1).alias("losses"), F.col("total_value").alias("isk_lost"), F.lit(0).alias("final_kills"), F.lit(0.0).alias("isk_killed"))
    final = ka.where("final_blow").join(km.select("sequence_id", "total_value"), "sequence_id")
    tall = tall.unionByName(final.select("character_id", F.lit(0).alias("losses"), F.lit(0.0).alias("isk_lost"), F.lit(1).alias("final_kills"), F.col("total_value").alias("isk_killed")))
    own = tall.groupBy("character_id").agg(F.sum("losses").alias("losses"), rnd(exact_sum(F.col("isk_lost")), 2).alias("isk_lost"), F.sum("final_kills").alias("final_kills"), rnd(exact_sum(F.col("isk_killed")), 2).alias("isk_killed"))
    a = ka.groupBy("character_id").agg(F.countDistinct("sequence_id").alias("contributed_kills"), rnd(exact_sum(F.col("damage_done")), 2).alias("damage"))
    j = own.join(a, "character_id", "full")
    return j.select("character_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("losses", "isk_lost", "final_kills", "isk_killed", "contributed_kills", "damage")])


@query("alliance_ledger", V.ctes("km", "ka") + """, v AS (SELECT victim_alliance_id AS alliance_id, count(*) AS losses FROM km GROUP BY 1), f AS (SELECT alliance_id, count(*) AS kills FROM ka JOIN km USING (sequence_id) WHERE final_blow GROUP BY 1)
SELECT alliance_id, coalesce(losses, 0) AS losses, coalesce(kills, 0) AS kills, round(CASE WHEN coalesce(kills, 0) + coalesce(losses, 0) > 0 THEN coalesce(kills, 0) / (coalesce(kills, 0) + coalesce(losses, 0)) ELSE 0.5 END, 6) AS efficiency,
CASE WHEN alliance_id <= 8 THEN 'friendly' WHEN alliance_id <= 16 THEN 'opponent' ELSE 'third_party' END AS side FROM v FULL JOIN f USING (alliance_id)""")  # fmt: skip
def alliance_ledger(spark: SparkSession, d: str) -> DataFrame:
    """Kills, losses and efficiency per alliance with the configured side: first match of friendly, opponent, else third party."""
    km = V.killmails(spark, d)
    v = km.groupBy(F.col("victim_alliance_id").alias("alliance_id")).agg(F.count(F.lit(1)).alias("losses"))
    f = V.attackers(spark, d).where("final_blow").join(km.select("sequence_id"), "sequence_id").groupBy("alliance_id").agg(F.count(F.lit(1)).alias("kills"))
    kills, losses = F.coalesce("kills", F.lit(0)), F.coalesce("losses", F.lit(0))
    side = F.when(F.col("alliance_id").isin(*range(1, 9)), "friendly").when(F.col("alliance_id").isin(*range(9, 17)), "opponent").otherwise("third_party")
    return v.join(f, "alliance_id", "full").select("alliance_id", losses.alias("losses"), kills.alias("kills"), rnd(safe_div(kills, kills + losses, 0.5), 6).alias("efficiency"), side.alias("side"))


@query("side_composition", BATTLE + """, r AS (SELECT battle_id, side_key, ship_type_id % 4 AS role, count(*) AS n FROM b GROUP BY 1, 2, 3), s AS (SELECT battle_id, side_key, CAST(sum(n) AS BIGINT) AS pilots, sum(n * [1.0, 2.0, 3.5, 6.0][role + 1]) / sum(n) AS hull_weight,
CAST(sum(CASE role WHEN 0 THEN n ELSE 0 END) AS BIGINT) AS r0, CAST(sum(CASE role WHEN 1 THEN n ELSE 0 END) AS BIGINT) AS r1, CAST(sum(CASE role WHEN 2 THEN n ELSE 0 END) AS BIGINT) AS r2, CAST(sum(CASE role WHEN 3 THEN n ELSE 0 END) AS BIGINT) AS r3 FROM r GROUP BY 1, 2),
e AS (SELECT *, -(CASE WHEN r0 > 0 THEN r0 / pilots * log2(r0 / pilots) ELSE 0 END + CASE WHEN r1 > 0 THEN r1 / pilots * log2(r1 / pilots) ELSE 0 END + CASE WHEN r2 > 0 THEN r2 / pilots * log2(r2 / pilots) ELSE 0 END + CASE WHEN r3 > 0 THEN r3 / pilots * log2(r3 / pilots) ELSE 0 END) AS h FROM s)
SELECT battle_id, side_key, pilots, r0, r1, r2, r3, round(h / log2(13), 6) AS role_balance, round(CAST(hull_weight AS DOUBLE), 6) AS hull_weight, round(CAST(hull_weight AS DOUBLE) * (1 + 0.5 * r1 / pilots) * sqrt(pilots), 6) AS expected FROM e""")  # fmt: skip
def side_composition(spark: SparkSession, d: str) -> DataFrame:
    """Roles of a side as a pivot, their entropy against 13 roles, mean hull weight and expected performance."""
    role = F.col("ship_type_id") % 4
    g = with_battle(V.event_stream(spark, d)).groupBy("battle_id", "side_key").agg(F.count(F.lit(1)).alias("pilots"), *[F.sum((role == k).cast("bigint")).alias(f"r{k}") for k in range(4)])
    n = F.col("pilots")
    h = sum((F.when(F.col(f"r{k}") > 0, F.col(f"r{k}") / n * F.log2(F.col(f"r{k}") / n)).otherwise(0.0) for k in range(4)), F.lit(0.0))
    w = (1.0 * F.col("r0") + 2.0 * F.col("r1") + 3.5 * F.col("r2") + 6.0 * F.col("r3")) / n
    return g.select("battle_id", "side_key", "pilots", "r0", "r1", "r2", "r3", rnd(-h / F.log2(F.lit(13.0)), 6).alias("role_balance"), rnd(w, 6).alias("hull_weight"), rnd(w * (1 + 0.5 * F.col("r1") / n) * F.sqrt(n), 6).alias("expected"))


@query("escalation_chains")
def escalation_chains(spark: SparkSession, d: str, gap_hours: int = 72, overlap: float = 0.10) -> DataFrame:
    """Greedy chains within an area: a battle joins the open chain whose last end is within the gap and which shares enough pilots with a member."""
    b = with_battle(V.event_stream(spark, d), 6 * 3600).withColumn("area", F.col("system_id"))
    g = b.groupBy("area", "battle_id").agg(F.min("ts").alias("s"), F.max("ts").alias("e"), F.collect_set("character_id").alias("pilots"))
    # a battle past the gap from every end before it can join no chain, so the runs between such gaps are groups of their own
    g = gap_islands(g, ["area"], "s", "e", "battle_id", gap_hours * 3600)
    return g.groupBy("area", "island").applyInPandas(lambda pdf: _chains(pdf, gap_hours, overlap), "area int, chain_id string, battles int, started_at timestamp, ended_at timestamp, peak int, grade string")


def _chains(pdf, gap_hours: int, overlap: float):
    import hashlib

    import pandas as pd

    chains: list[list] = []
    for r in pdf.sort_values(["s", "battle_id"]).itertuples():
        pilots = set(r.pilots)
        for c in chains:
            last = max(m.e for m, _ in c)
            if (r.s - last).total_seconds() <= gap_hours * 3600 and any(len(pilots & p) >= overlap * max(1, min(len(pilots), len(p))) for _, p in c):
                c.append((r, pilots))
                break
        else:
            chains.append([(r, pilots)])
    rows = []
    for c in chains:
        if len(c) >= 2:
            peak = max(len(p) for _, p in c)
            grade = "critical" if len(c) >= 5 else "major" if peak >= 100 else "moderate" if len(c) >= 3 or peak >= 50 else "minor"
            ids = sorted(m.battle_id for m, _ in c)
            rows.append((int(pdf.area.iloc[0]), hashlib.sha256("|".join(ids).encode()).hexdigest(), len(c), c[0][0].s, max(m.e for m, _ in c), peak, grade))
    return pd.DataFrame(rows, columns=["area", "chain_id", "battles", "started_at", "ended_at", "peak", "grade"])
