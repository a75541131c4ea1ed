"""Character behaviour: feature windows, footprints, cadence, co-presence, cohorts, baselines, histories and pre-op joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.functions import kernels as K
from lodestar.functions.kernels import clamp, exact_sum, rnd, safe_div
from lodestar.operators.relational import islands, latest, met_pairs, overlap_join
from lodestar.plans.registry import query
from lodestar.sources import views as V

WINDOWS = (("7d", 7), ("14d", 14), ("30d", 30))
AS_OF = "(SELECT max(ts) FROM events)"


def as_of(es: DataFrame) -> DataFrame:
    return F.broadcast(es.agg(F.max("ts").alias("as_of")))  # one row


def windowed(es: DataFrame) -> DataFrame:
    """Each event once for every trailing window that it is in."""
    age = F.unix_micros("as_of") - F.unix_micros("ts")
    labels = F.array_compact(F.array(*[F.when(age <= n * 86_400_000_000, F.lit(w)) for w, n in WINDOWS], F.lit("lifetime")))
    return es.crossJoin(as_of(es)).withColumn("win", F.explode(labels))


WIN = V.ctes("es") + f""", w AS (SELECT es.*, win FROM es, (SELECT unnest(['7d', '14d', '30d', 'lifetime']) AS win)
WHERE win = 'lifetime' OR epoch_us({AS_OF}) - epoch_us(ts) <= CASE win WHEN '7d' THEN 7 WHEN '14d' THEN 14 ELSE 30 END * 86400000000)"""


@query("feature_windows", WIN + """SELECT character_id, win, count(*) AS events, count(DISTINCT system_id) AS systems, count(DISTINCT CAST(ts AS DATE)) AS active_days, count(DISTINCT side_key) AS sides, round(CAST(sum(CAST(damage AS DECIMAL(20,4))) AS DOUBLE), 4) AS damage,
round(CAST(sum(CAST(hour(ts) >= 22 OR hour(ts) < 6 AS INT)) AS DOUBLE) / count(*), 6) AS night_share FROM w GROUP BY 1, 2""")  # fmt: skip
def feature_windows(spark: SparkSession, d: str) -> DataFrame:
    night = (F.hour("ts") >= 22) | (F.hour("ts") < 6)
    return windowed(V.event_stream(spark, d)).groupBy("character_id", "win").agg(
        F.count(F.lit(1)).alias("events"), F.countDistinct("system_id").alias("systems"), F.countDistinct(F.to_date("ts")).alias("active_days"), F.countDistinct("side_key").alias("sides"),
        rnd(exact_sum(F.col("damage"))).alias("damage"), rnd(F.sum(night.cast("int")) / F.count(F.lit(1)), 6).alias("night_share"),
    )


@query("hour_histogram", V.ctes("es") + """SELECT character_id, CAST(hour(ts) AS INTEGER) AS hour, CAST(dayofweek(ts) AS INTEGER) AS weekday, count(*) AS n FROM es GROUP BY 1, 2, 3""")
def hour_histogram(spark: SparkSession, d: str) -> DataFrame:
    """Hours and weekdays (0: Sunday) of activity."""
    return V.event_stream(spark, d).groupBy("character_id", F.hour("ts").alias("hour"), (F.dayofweek("ts") - 1).alias("weekday")).agg(F.count(F.lit(1)).alias("n"))


@query("dominant_side", V.ctes("es") + """, c AS (SELECT character_id, side_key, count(*) AS n FROM es GROUP BY 1, 2) SELECT character_id, side_key, n FROM c QUALIFY row_number() OVER (PARTITION BY character_id ORDER BY n DESC, side_key) = 1""")
def dominant_side(spark: SparkSession, d: str) -> DataFrame:
    return latest(V.event_stream(spark, d).groupBy("character_id", "side_key").agg(F.count(F.lit(1)).alias("n")), ["character_id"], [F.desc("n"), "side_key"])


@query("footprint_entropy", V.ctes("es") + """, c AS (SELECT character_id, ship_type_id % 10 AS area, count(*) AS n FROM es GROUP BY 1, 2), p AS (SELECT *, n / sum(n) OVER (PARTITION BY character_id) AS p FROM c)
SELECT character_id, round(-sum(p * log2(p)), 6) AS entropy, round(CAST(sum(n * n) AS BIGINT) / CAST(sum(n) * sum(n) AS BIGINT), 6) AS hhi FROM p GROUP BY 1""")  # fmt: skip
def footprint_entropy(spark: SparkSession, d: str) -> DataFrame:
    """Entropy (bits) and concentration of where a character is seen."""
    es = V.event_stream(spark, d).withColumn("area", F.col("ship_type_id") % 10)
    return K.entropy_hhi(es, "character_id", "area").select("character_id", rnd("entropy", 6).alias("entropy"), rnd("hhi", 6).alias("hhi"))


@query("footprint_jsd", V.ctes("es") + f""", m AS (SELECT character_id, ship_type_id % 10 AS area, epoch_us({AS_OF}) - epoch_us(ts) <= 14 * 86400000000 AS cur FROM es),
c AS (SELECT character_id, area, count(CASE WHEN cur THEN 1 END) AS a, count(CASE WHEN NOT cur THEN 1 END) AS b FROM m GROUP BY 1, 2),
p AS (SELECT character_id, area, coalesce(a / nullif(sum(a) OVER (PARTITION BY character_id), 0), 0) AS a, coalesce(b / nullif(sum(b) OVER (PARTITION BY character_id), 0), 0) AS b FROM c)
SELECT character_id, round(greatest(0, least(1, sum(CASE WHEN a > 0 THEN a * log2(a / ((a + b) / 2)) ELSE 0 END + CASE WHEN b > 0 THEN b * log2(b / ((a + b) / 2)) ELSE 0 END) / 2)), 6) AS jsd,
  round(1 - sum(a * b) / nullif(sqrt(sum(a * a)) * sqrt(sum(b * b)), 0), 6) AS cosine_distance FROM p GROUP BY 1""")  # fmt: skip
def footprint_jsd(spark: SparkSession, d: str) -> DataFrame:
    """Divergence of the last 14 days' areas from those before."""
    es = V.event_stream(spark, d).withColumn("area", F.col("ship_type_id") % 10)
    m = es.crossJoin(as_of(es)).withColumn("cur", F.unix_micros("as_of") - F.unix_micros("ts") <= 14 * 86_400_000_000)
    p, q = K.shares(m.where("cur"), "character_id", "area"), K.shares(m.where("not cur"), "character_id", "area")
    return K.js_divergence(p, q, "character_id", "area").select("character_id", rnd("jsd", 6).alias("jsd"), rnd("cosine_distance", 6).alias("cosine_distance"))


@query("footprint_change", V.ctes("es") + f""", m AS (SELECT character_id, ship_type_id % 25 AS area, epoch_us({AS_OF}) - epoch_us(ts) <= 14 * 86400000000 AS cur FROM es),
a AS (SELECT character_id, count(DISTINCT CASE WHEN cur THEN area END) AS cur_n, count(DISTINCT CASE WHEN NOT cur THEN area END) AS prev_n FROM m GROUP BY 1),
n AS (SELECT character_id, count(*) AS new_n FROM (SELECT character_id, area FROM m GROUP BY 1, 2 HAVING max(CAST(cur AS INT)) = 1 AND min(CAST(cur AS INT)) = 1) GROUP BY 1)
SELECT character_id, cur_n, prev_n, coalesce(new_n, 0) AS new_areas, round(CASE WHEN prev_n > 0 THEN greatest(0, least(1, (cur_n - prev_n) / prev_n)) ELSE 1 END, 6) AS expansion, round(CASE WHEN prev_n > 0 THEN greatest(0, least(1, (prev_n - cur_n) / prev_n)) ELSE 0 END, 6) AS contraction
FROM a LEFT JOIN n USING (character_id)""")  # fmt: skip
def footprint_change(spark: SparkSession, d: str) -> DataFrame:
    """Expansion, contraction and new areas as set algebra over the areas of both periods."""
    es = V.event_stream(spark, d).withColumn("area", F.col("ship_type_id") % 25)
    cur = F.unix_micros("as_of") - F.unix_micros("ts") <= 14 * 86_400_000_000
    g = es.crossJoin(as_of(es)).groupBy("character_id").agg(F.collect_set(F.when(cur, F.col("area"))).alias("c"), F.collect_set(F.when(~cur, F.col("area"))).alias("p"))
    c, p = F.size("c").cast("bigint"), F.size("p").cast("bigint")
    return g.select("character_id", c.alias("cur_n"), p.alias("prev_n"), F.size(F.array_except("c", "p")).cast("bigint").alias("new_areas"), rnd(F.when(p > 0, clamp((c - p) / p)).otherwise(1.0), 6).alias("expansion"), rnd(F.when(p > 0, clamp((p - c) / p)).otherwise(0.0), 6).alias("contraction"))


@query("cadence_metrics", V.ctes("es") + """, g AS (SELECT character_id, epoch_us(ts) / 1e6 - lag(epoch_us(ts) / 1e6) OVER (PARTITION BY character_id ORDER BY ts, event_id) AS gap FROM es),
s AS (SELECT character_id, count(*) AS n_gaps, avg(gap) AS m, stddev_pop(gap) AS sd, max(gap) AS max_gap FROM g WHERE gap IS NOT NULL GROUP BY 1)
SELECT character_id, n_gaps, round(m, 2) AS mean_gap, round(sd, 2) AS sd_gap, round(max_gap, 2) AS max_gap, round(CASE WHEN m > 0 THEN sd / m ELSE 0 END, 4) AS cv, round(CASE WHEN sd + m > 0 THEN (sd - m) / (sd + m) ELSE 0 END, 4) AS burstiness FROM s""")  # fmt: skip
def cadence_metrics(spark: SparkSession, d: str) -> DataFrame:
    c = K.cadence(V.event_stream(spark, d), "character_id", "ts", "event_id")
    return c.select("character_id", "n_gaps", rnd("mean_gap", 2).alias("mean_gap"), rnd("sd_gap", 2).alias("sd_gap"), rnd("max_gap", 2).alias("max_gap"), rnd("cv").alias("cv"), rnd("burstiness").alias("burstiness"))


@query("cusum_drift", V.ctes("es").replace("WITH", "WITH RECURSIVE", 1) + """, c AS (SELECT character_id, CAST(ts AS DATE) AS day, CAST(count(*) AS DOUBLE) AS n FROM es GROUP BY 1, 2),
x AS (SELECT character_id, n - sum(n) OVER w / count(*) OVER w AS z, row_number() OVER (PARTITION BY character_id ORDER BY day) AS i, count(*) OVER w AS days FROM c WINDOW w AS (PARTITION BY character_id)),
r AS (SELECT character_id, i, days, greatest(0.0, z) AS up, greatest(0.0, -z) AS down, abs(z) AS top FROM x WHERE i = 1
UNION ALL SELECT x.character_id, x.i, x.days, greatest(0.0, up + z), greatest(0.0, down - z), greatest(top, up + z, down - z) FROM r JOIN x ON x.character_id = r.character_id AND x.i = r.i + 1),
s AS (SELECT character_id, CASE WHEN max(days) >= 15 THEN max(top) ELSE 0 END AS score, max(days) AS days FROM r GROUP BY 1)
SELECT character_id, days, round(score, 4) AS score, score >= 4 AS alarm FROM s""")  # fmt: skip
def cusum_drift(spark: SparkSession, d: str) -> DataFrame:
    """Two-sided CUSUM over a character's daily counts, in date order."""
    days = V.event_stream(spark, d).groupBy("character_id", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    g = days.groupBy("character_id").agg(F.array_sort(F.collect_list(F.struct("day", "n"))).alias("z"))
    c = K.cusum(F.transform("z", lambda x: x["n"]))
    return g.select("character_id", F.size("z").alias("days"), rnd(c["score"]).alias("score"), c["alarm"].alias("alarm"))


@query("reactivation", V.ctes("es") + f""", g AS (SELECT character_id, ts, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY character_id ORDER BY ts, event_id) AS gap FROM es)
SELECT character_id, max(ts) AS last_seen, round(coalesce(max(gap), 0) / 86400000000.0, 4) AS longest_gap_days, coalesce(max(CASE WHEN gap >= 2 * 86400000000 AND ts >= {AS_OF} - INTERVAL 7 DAY THEN 1 ELSE 0 END), 0) = 1 AS reactivated FROM g GROUP BY 1""")  # fmt: skip
def reactivation(spark: SparkSession, d: str, dormant_days: int = 2) -> DataFrame:
    """Activity in the last 7 days that ended a dormancy (30 days on sparse data)."""
    es = V.event_stream(spark, d)
    gap = F.unix_micros("ts") - F.lag(F.unix_micros("ts")).over(Window.partitionBy("character_id").orderBy("ts", "event_id"))
    g = es.withColumn("gap", gap).crossJoin(as_of(es))
    woke = (F.col("gap") >= dormant_days * 86_400_000_000) & (F.col("ts") >= F.col("as_of") - F.expr("INTERVAL 7 DAYS"))
    return g.groupBy("character_id").agg(F.max("ts").alias("last_seen"), rnd(F.coalesce(F.max("gap"), F.lit(0)) / 86_400_000_000.0).alias("longest_gap_days"), F.coalesce(F.max(F.when(woke, 1).otherwise(0)) == 1, F.lit(False)).alias("reactivated"))


@query("gini_concentration", V.ctes("es") + """, c AS (SELECT character_id, system_id, side_key, count(*) AS v FROM es GROUP BY 1, 2, 3), r AS (SELECT *, row_number() OVER (PARTITION BY character_id ORDER BY v) AS i FROM c),
g AS (SELECT character_id, CAST(sum(i * v) AS DOUBLE) AS iv, CAST(sum(v) AS DOUBLE) AS v, count(*) AS n FROM r GROUP BY 1)
SELECT character_id, n, round(CASE WHEN n > 1 AND v > 0 THEN greatest(0, least(1, (2 * iv / (n * v) - (n + 1) / n) * n / (n - 1))) ELSE 0 END, 6) AS gini FROM g""")  # fmt: skip
def gini_concentration(spark: SparkSession, d: str) -> DataFrame:
    c = V.event_stream(spark, d).groupBy("character_id", "system_id", "side_key").agg(F.count(F.lit(1)).alias("v"))
    return K.gini(c, "character_id", "v").select("character_id", "n", rnd("gini", 6).alias("gini"))


@query("cohort_normalize", V.ctes("es") + """, c AS (SELECT character_id, side_key AS evidence_key, count(*) AS value FROM es GROUP BY 1, 2),
s AS (SELECT evidence_key, avg(value) AS mu, stddev_pop(value) AS sd, median(value) AS med, count(*) AS n FROM c GROUP BY 1), m AS (SELECT evidence_key, median(abs(value - med)) AS mad FROM c JOIN s USING (evidence_key) GROUP BY 1)
SELECT character_id, evidence_key, value, round(CASE WHEN sd > 0 THEN (value - mu) / sd ELSE 0 END, 4) AS z, round(CASE WHEN mad > 0 THEN (value - med) / (1.4826 * mad) ELSE 0 END, 4) AS mad_score,
  round(cume_dist() OVER (PARTITION BY evidence_key ORDER BY value), 6) AS pct, CASE WHEN n >= 10 THEN 'high' WHEN n >= 5 THEN 'medium' ELSE 'low' END AS confidence FROM c JOIN s USING (evidence_key) JOIN m USING (evidence_key)""")  # fmt: skip
def cohort_normalize(spark: SparkSession, d: str) -> DataFrame:
    c = V.event_stream(spark, d).groupBy("character_id", F.col("side_key").alias("evidence_key")).agg(F.count(F.lit(1)).alias("value"))
    return K.cohort_normalize(c, "evidence_key", "value").select("character_id", "evidence_key", "value", rnd("z").alias("z"), rnd("mad_score").alias("mad_score"), rnd("pct", 6).alias("pct"), "confidence")


@query("cohort_baselines", V.ctes("es") + """, a AS (SELECT character_id, count(*) AS n, count(DISTINCT system_id) AS systems, sum(CAST(side_key = 'purchase' AS INT)) / count(*) AS logi, count(DISTINCT CAST(ts AS DATE)) AS days FROM es GROUP BY 1),
l AS (SELECT *, unnest(list_filter([CASE WHEN n >= 60 THEN 'combat_active' END, CASE WHEN n < 60 THEN 'low_activity' END, CASE WHEN logi >= 0.2 THEN 'logistics' END, CASE WHEN days <= 25 THEN 'newly' END], lambda x: x IS NOT NULL)) AS cohort FROM a)
SELECT cohort, count(*) AS members, round(avg(n), 4) AS mean_n, round(stddev_pop(n), 4) AS sd_n, round(median(n), 4) AS median_n, round(avg(logi), 6) AS mean_logi FROM l GROUP BY 1""")  # fmt: skip
def cohort_baselines(spark: SparkSession, d: str) -> DataFrame:
    """Members may have several cohorts; each cohort's mean, deviation and median."""
    a = V.event_stream(spark, d).groupBy("character_id").agg(F.count(F.lit(1)).alias("n"), (F.sum((F.col("side_key") == "purchase").cast("int")) / F.count(F.lit(1))).alias("logi"), F.countDistinct(F.to_date("ts")).alias("days"))
    n = F.col("n")
    label = F.array_compact(F.array(F.when(n >= 60, F.lit("combat_active")), F.when(n < 60, F.lit("low_activity")), F.when(F.col("logi") >= 0.2, F.lit("logistics")), F.when(F.col("days") <= 25, F.lit("newly"))))
    return a.withColumn("cohort", F.explode(label)).groupBy("cohort").agg(F.count(F.lit(1)).alias("members"), rnd(F.avg("n")).alias("mean_n"), rnd(F.stddev_pop("n")).alias("sd_n"), rnd(F.median("n")).alias("median_n"), rnd(F.avg("logi"), 6).alias("mean_logi"))


@query("copresence_edges", V.ctes("es") + """, c AS (SELECT DISTINCT system_id, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS h, character_id FROM es)
SELECT x.character_id AS a, y.character_id AS b, count(*) AS meetings, round(count(*) * 1.5, 4) AS weight, max(x.h) AS last_at FROM c x JOIN c y ON x.system_id = y.system_id AND x.h = y.h AND x.character_id < y.character_id GROUP BY 1, 2 HAVING count(*) >= 2""")  # fmt: skip
def copresence_edges(spark: SparkSession, d: str) -> DataFrame:
    """Pairs seen in one system and hour, weighted by event type."""
    c = V.event_stream(spark, d).select("system_id", F.date_trunc("hour", "ts").alias("h"), "character_id").distinct().withColumn("at", F.col("h"))
    n = F.count(F.lit(1))
    return met_pairs(c, ["system_id"], ["h"], "character_id").groupBy("meet", "a", "b").agg(n.alias("meetings"), rnd(n * 1.5).alias("weight"), F.max("x.at").alias("last_at")).where("meetings >= 2").drop("meet")


@query("system_time_edges", V.ctes("es") + """SELECT x.character_id AS a, y.character_id AS b, count(*) AS n, round(min(abs(epoch_us(x.ts) - epoch_us(y.ts))) / 1e6, 2) AS closest FROM es x JOIN es y ON x.system_id = y.system_id AND x.character_id < y.character_id
AND abs(epoch_us(x.ts) - epoch_us(y.ts)) <= 1800000000 GROUP BY 1, 2""")  # fmt: skip
def system_time_edges(spark: SparkSession, d: str, seconds: int = 1800) -> DataFrame:
    """Pairs in one system within a band of time: a bucketed band join."""
    es = V.event_stream(spark, d).select("system_id", "character_id", "ts")
    j = met_pairs(es, ["system_id"], [], "character_id", ("ts", seconds))
    return j.groupBy("meet", "a", "b").agg(F.count(F.lit(1)).alias("n"), rnd(F.min(F.abs(F.unix_micros("x.ts") - F.unix_micros("y.ts"))) / 1e6, 2).alias("closest")).drop("meet")


@query("continuation_rate", V.ctes("es") + """, n AS (SELECT character_id, lead(epoch_us(ts)) OVER (PARTITION BY character_id ORDER BY ts, event_id) - epoch_us(ts) <= 7200000000 AS goes FROM es)
SELECT character_id, count(*) AS events, round(count(CASE WHEN goes THEN 1 END) / count(*), 6) AS continuation FROM n GROUP BY 1""")  # fmt: skip
def continuation_rate(spark: SparkSession, d: str, seconds: int = 7200) -> DataFrame:
    goes = F.lead(F.unix_micros("ts")).over(Window.partitionBy("character_id").orderBy("ts", "event_id")) - F.unix_micros("ts") <= seconds * 1_000_000
    return V.event_stream(spark, d).withColumn("goes", goes).groupBy("character_id").agg(F.count(F.lit(1)).alias("events"), rnd(F.count(F.when(F.col("goes"), 1)) / F.count(F.lit(1)), 6).alias("continuation"))


@query("behavioral_scores", V.ctes("es") + """, c AS (SELECT character_id, system_id, side_key, count(*) AS v FROM es GROUP BY 1, 2, 3), r AS (SELECT *, row_number() OVER (PARTITION BY character_id ORDER BY v) AS i FROM c),
g AS (SELECT character_id, CAST(sum(i * v) AS DOUBLE) AS iv, CAST(sum(v) AS DOUBLE) AS v, count(*) AS n FROM r GROUP BY 1), gi AS (SELECT character_id, CASE WHEN n > 1 THEN greatest(0, least(1, (2 * iv / (n * v) - (n + 1) / n) * n / (n - 1))) ELSE 0 END AS gini FROM g),
q AS (SELECT character_id, lead(epoch_us(ts)) OVER (PARTITION BY character_id ORDER BY ts, event_id) - epoch_us(ts) AS gap, side_key FROM es),
f AS (SELECT character_id, count(*) AS events, count(CASE WHEN gap <= 7200000000 THEN 1 END) / count(*) AS cont, greatest(0, least(1, ((stddev_pop(gap) - avg(gap)) / (stddev_pop(gap) + avg(gap)) + 1) / 2)) AS burst, (count(DISTINCT side_key) - 1) / 4.0 AS cross_side FROM q GROUP BY 1)
SELECT character_id, events, round(0.10 * (1 - cont) + 0.10 * gini + 0.10 * coalesce(burst, 0) + 0.15 * cross_side, 4) AS score, CASE WHEN events >= 30 THEN 'high' WHEN events >= 10 THEN 'medium' ELSE 'low' END AS confidence FROM f JOIN gi USING (character_id) WHERE events >= 3""")  # fmt: skip
def behavioral_scores(spark: SparkSession, d: str) -> DataFrame:
    """Weighted behaviour components of characters with three or more events."""
    es = V.event_stream(spark, d)
    gi = K.gini(es.groupBy("character_id", "system_id", "side_key").agg(F.count(F.lit(1)).alias("v")), "character_id", "v").select("character_id", "gini")
    gap = F.lead(F.unix_micros("ts")).over(Window.partitionBy("character_id").orderBy("ts", "event_id")) - F.unix_micros("ts")
    n = F.count(F.lit(1))
    f = es.withColumn("gap", gap).groupBy("character_id").agg(
        n.alias("events"), (F.count(F.when(F.col("gap") <= 7_200_000_000, 1)) / n).alias("cont"), F.stddev_pop("gap").alias("sd"), F.avg("gap").alias("mu"), ((F.countDistinct("side_key") - 1) / 4.0).alias("cross_side"),
    )
    burst = F.coalesce(clamp(((F.col("sd") - F.col("mu")) / (F.col("sd") + F.col("mu")) + 1) / 2), F.lit(0.0))
    score = 0.10 * (1 - F.col("cont")) + 0.10 * F.col("gini") + 0.10 * burst + 0.15 * F.col("cross_side")
    return f.join(gi, "character_id").where("events >= 3").select("character_id", "events", rnd(score).alias("score"), F.when(F.col("events") >= 30, "high").when(F.col("events") >= 10, "medium").otherwise("low").alias("confidence"))


@query("peer_normalised", V.ctes("es") + """, c AS (SELECT system_id, character_id, count(*) AS v FROM es GROUP BY 1, 2), w AS (SELECT *, sum(v) OVER (PARTITION BY system_id) AS s, count(*) OVER (PARTITION BY system_id) AS n FROM c)
SELECT system_id, character_id, v AS own, round((s - v) / (n - 1), 6) AS peer_mean, round(v / ((s - v) / (n - 1)), 6) AS ratio FROM w WHERE n > 1""")  # fmt: skip
def peer_normalised(spark: SparkSession, d: str) -> DataFrame:
    """Own activity against the mean of the others: (sum - own) / (n - 1)."""
    c = V.event_stream(spark, d).groupBy("system_id", "character_id").agg(F.count(F.lit(1)).alias("own"))
    t = c.groupBy("system_id").agg(F.sum("own").alias("s"), F.count(F.lit(1)).alias("n")).where("n > 1")
    peer = (F.col("s") - F.col("own")) / (F.col("n") - 1)
    return c.join(t, "system_id").select("system_id", "character_id", "own", rnd(peer, 6).alias("peer_mean"), rnd(F.col("own") / peer, 6).alias("ratio"))


@query("counterintel_presence", V.ctes("es") + """, b AS (SELECT DISTINCT system_id, CAST(ts AS DATE) AS day, character_id FROM es), t AS (SELECT system_id, CAST(ts AS DATE) AS day, CAST(sum(CAST(damage AS DECIMAL(20,4))) AS DOUBLE) / count(*) AS m FROM es GROUP BY 1, 2), a AS (SELECT CAST(sum(CAST(m AS DECIMAL(20,4))) AS DOUBLE) AS s, count(*) AS n FROM t),
p AS (SELECT character_id, CAST(sum(CAST(m AS DECIMAL(20,4))) AS DOUBLE) AS ps, count(*) AS pn FROM b JOIN t USING (system_id, day) GROUP BY 1)
SELECT character_id, pn AS battles, round(ps / pn, 4) AS present_mean, round((s - ps) / (n - pn), 4) AS control_mean, round((ps / pn) / ((s - ps) / (n - pn)), 6) AS lift, (ps / pn) / ((s - ps) / (n - pn)) >= 1.25 AS over FROM p, a WHERE n > pn""")  # fmt: skip
def counterintel_presence(spark: SparkSession, d: str) -> DataFrame:
    """Mean intensity of the battles a character was in against all others, from totals less its own."""
    es = V.event_stream(spark, d).withColumn("day", F.to_date("ts"))
    t = es.groupBy("system_id", "day").agg((exact_sum(F.col("damage")) / F.count(F.lit(1))).alias("m"))
    a = F.broadcast(t.agg(exact_sum(F.col("m")).alias("s"), F.count(F.lit(1)).alias("n")))
    p = es.select("system_id", "day", "character_id").distinct().join(t, ["system_id", "day"]).groupBy("character_id").agg(exact_sum(F.col("m")).alias("ps"), F.count(F.lit(1)).alias("battles")).crossJoin(a).where("n > battles")
    own, ctl = F.col("ps") / F.col("battles"), (F.col("s") - F.col("ps")) / (F.col("n") - F.col("battles"))
    return p.select("character_id", "battles", rnd(own).alias("present_mean"), rnd(ctl).alias("control_mean"), rnd(own / ctl, 6).alias("lift"), (own / ctl >= 1.25).alias("over"))


@query("history_islands", V.ctes("mh") + """, c AS (SELECT *, CASE WHEN org IS DISTINCT FROM lag(org) OVER w OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS new FROM mh WINDOW w AS (PARTITION BY character_id ORDER BY start_at, seq)),
i AS (SELECT *, sum(new) OVER (PARTITION BY character_id ORDER BY start_at, seq ROWS UNBOUNDED PRECEDING) AS island FROM c)
SELECT character_id, CAST(island AS BIGINT) AS island, min(org) AS org, min(start_at) AS start_at, last(end_at ORDER BY start_at, seq) AS end_at, count(*) AS joins FROM i GROUP BY 1, 2""")  # fmt: skip
def history_islands(spark: SparkSession, d: str) -> DataFrame:
    """Consecutive memberships of one organisation as one period."""
    i = islands(V.membership(spark, d), ["character_id"], ["start_at", "seq"], "org")
    return i.groupBy("character_id", "island").agg(F.min("org").alias("org"), F.min("start_at").alias("start_at"), F.max_by("end_at", F.struct("start_at", "seq")).alias("end_at"), F.count(F.lit(1)).alias("joins"))


@query("interval_overlap", V.ctes("mh") + """, m AS (SELECT * FROM mh WHERE end_at IS NOT NULL)
SELECT x.character_id AS a, y.character_id AS b, x.org, count(*) AS overlaps, CAST(sum(date_diff('day', CAST(greatest(x.start_at, y.start_at) AS DATE), CAST(least(x.end_at, y.end_at) AS DATE))) AS BIGINT) AS days FROM m x JOIN m y ON x.org = y.org AND x.character_id < y.character_id AND x.start_at <= y.end_at AND y.start_at <= x.end_at GROUP BY 1, 2, 3 HAVING sum(date_diff('day', CAST(greatest(x.start_at, y.start_at) AS DATE), CAST(least(x.end_at, y.end_at) AS DATE))) >= 365""")  # fmt: skip
def interval_overlap(spark: SparkSession, d: str, least_days: int = 365) -> DataFrame:
    """Shared membership periods of pairs, by a bucketed interval join."""
    m = V.membership(spark, d).where("end_at is not null")
    a = m.select("org", F.col("character_id").alias("a"), F.col("start_at").alias("sa"), F.col("end_at").alias("ea"))
    b = m.select("org", F.col("character_id").alias("b"), F.col("start_at").alias("sb"), F.col("end_at").alias("eb"))
    j = overlap_join(a, b, ["org"], ("sa", "ea"), ("sb", "eb")).where("a < b")
    return j.groupBy("a", "b", "org").agg(F.count(F.lit(1)).alias("overlaps"), F.sum(F.datediff(F.least("ea", "eb"), F.greatest("sa", "sb"))).cast("bigint").alias("days")).where(F.col("days") >= least_days)


@query("pre_op_join", V.ctes("mh", "km") + """SELECT mh.character_id, mh.seq, mh.org, min(killmail_time) AS first_op, count(*) AS ops FROM mh JOIN km ON km.victim_character_id = mh.character_id AND date_diff('day', CAST(start_at AS DATE), CAST(killmail_time AS DATE)) BETWEEN 0 AND 14 AND killmail_time > start_at GROUP BY 1, 2, 3""")
def pre_op_join(spark: SparkSession, d: str, days: int = 14) -> DataFrame:
    """Joins followed by an operation within the days after: an equi join with a bounded time condition."""
    mh, km = V.membership(spark, d), V.killmails(spark, d).select(F.col("victim_character_id").alias("character_id"), "killmail_time")
    j = mh.join(km, "character_id").where(F.datediff("killmail_time", "start_at").between(0, days) & (F.col("killmail_time") > F.col("start_at")))
    return j.groupBy("character_id", "seq", "org").agg(F.min("killmail_time").alias("first_op"), F.count(F.lit(1)).alias("ops"))


@query("refresh_tiers", V.ctes("es") + f""", l AS (SELECT character_id, max(ts) AS last FROM es GROUP BY 1) SELECT character_id, last, CASE WHEN last >= {AS_OF} - INTERVAL 12 HOUR THEN 'hot' WHEN last >= {AS_OF} - INTERVAL 36 HOUR THEN 'warm' ELSE 'cold' END AS tier FROM l""")
def refresh_tiers(spark: SparkSession, d: str) -> DataFrame:
    """Hot, warm or cold by the last event (7 and 30 days on sparse data)."""
    es = V.event_stream(spark, d)
    l = es.groupBy("character_id").agg(F.max("ts").alias("last")).crossJoin(as_of(es))  # noqa: E741
    return l.select("character_id", "last", F.when(F.col("last") >= F.col("as_of") - F.expr("INTERVAL 12 HOURS"), "hot").when(F.col("last") >= F.col("as_of") - F.expr("INTERVAL 36 HOURS"), "warm").otherwise("cold").alias("tier"))


@query("json_payload_extract", """SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, json_extract_string(props, '$.missing') AS missing, concat('{"id":', event_id, ',"type":"', event_type, '"}') AS payload FROM events""")
def json_payload_extract(spark: SparkSession, d: str) -> DataFrame:
    return V.read(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"), F.get_json_object("props", "$.missing").alias("missing"), F.to_json(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("type"))).alias("payload"))


@query("weight_recalibration", """WITH f AS (SELECT d.source, l.quality FROM labels l JOIN documents d USING (doc_id)), p AS (SELECT source, count(*) AS n, sum(CAST(quality = 1 AS INT)) / count(*) AS prec FROM f GROUP BY 1)
SELECT source, n, round(prec, 6) AS precision, round(prec / sum(prec) OVER (), 6) AS weight FROM p""")  # fmt: skip
def weight_recalibration(spark: SparkSession, d: str) -> DataFrame:
    """Signal weights from the precision of analyst labels."""
    f = V.read(spark, d, "labels").select("doc_id", "quality").join(V.read(spark, d, "documents").select("doc_id", "source"), "doc_id")
    p = f.groupBy("source").agg(F.count(F.lit(1)).alias("n"), (F.sum((F.col("quality") == 1).cast("int")) / F.count(F.lit(1))).alias("p"))
    t = F.broadcast(p.agg(F.sum("p").alias("t")))
    return p.crossJoin(t).select("source", "n", rnd("p", 6).alias("precision"), rnd(F.col("p") / F.col("t"), 6).alias("weight"))
