"""Alliances and geography: activity, top-k lists, posture, trend, relations, corridors, map intelligence, sovereignty changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.functions.kernels import clamp, edge_confidence, exact_sum, rnd, safe_div, tier
from lodestar.operators.relational import pairs, top_k
from lodestar.plans.registry import query
from lodestar.sources import views as V


def kills(spark: SparkSession, d: str) -> DataFrame:
    """Distinct (alliance, killmail) with the killmail's time, place and value."""
    ka = V.attackers(spark, d).groupBy("sequence_id", "alliance_id").agg(F.countDistinct("character_id").alias("gang"))
    return ka.join(V.killmails(spark, d), "sequence_id")


AK = V.ctes("km", "ka") + """, ak AS (SELECT ka.sequence_id, alliance_id, count(DISTINCT character_id) AS gang FROM ka GROUP BY 1, 2), k AS (SELECT ak.*, km.* EXCLUDE (sequence_id) FROM ak JOIN km USING (sequence_id))"""


@query("alliance_activity", AK + """SELECT alliance_id, count(*) AS kills, count(DISTINCT CASE WHEN killmail_time >= (SELECT max(killmail_time) FROM km) - INTERVAL 365 DAY THEN sequence_id END) AS recent_kills, round(avg(gang), 6) AS avg_gang,
count(DISTINCT system_id) AS systems, round(CAST(sum(CAST(total_value AS DECIMAL(20,4))) AS DOUBLE), 2) AS value FROM k GROUP BY 1""")  # fmt: skip
def alliance_activity(spark: SparkSession, d: str) -> DataFrame:
    k = kills(spark, d)
    t = F.broadcast(V.read(spark, d, "orders").agg(F.max("o_orderdate").alias("as_of")))
    inside = F.col("killmail_time") >= F.col("as_of") - F.expr("INTERVAL 365 DAYS")
    return k.crossJoin(t).groupBy("alliance_id").agg(F.count(F.lit(1)).alias("kills"), F.sum(inside.cast("bigint")).alias("recent_kills"), rnd(F.avg("gang"), 6).alias("avg_gang"), F.countDistinct("system_id").alias("systems"), rnd(exact_sum(F.col("total_value")), 2).alias("value"))


@query("alliance_geo_topk", AK + """, s AS (SELECT alliance_id, system_id, min(region_id) AS region_id, count(*) AS kills FROM k GROUP BY 1, 2) SELECT alliance_id, system_id, region_id, kills, CAST(row_number() OVER (PARTITION BY alliance_id ORDER BY kills DESC, system_id) AS INTEGER) AS rn FROM s QUALIFY rn <= 5""")
def alliance_geo_topk(spark: SparkSession, d: str) -> DataFrame:
    s = kills(spark, d).groupBy("alliance_id", "system_id").agg(F.min("region_id").alias("region_id"), F.count(F.lit(1)).alias("kills"))
    return top_k(s, ["alliance_id"], [F.desc("kills"), "system_id"], 5)


@query("alliance_ship_topk", V.ctes("ka") + """, s AS (SELECT alliance_id, ship_type_id, count(*) AS uses FROM ka GROUP BY 1, 2) SELECT alliance_id, ship_type_id, uses, CAST(row_number() OVER (PARTITION BY alliance_id ORDER BY uses DESC, ship_type_id) AS INTEGER) AS rn FROM s QUALIFY rn <= 7""")
def alliance_ship_topk(spark: SparkSession, d: str) -> DataFrame:
    s = V.attackers(spark, d).groupBy("alliance_id", "ship_type_id").agg(F.count(F.lit(1)).alias("uses"))
    return top_k(s, ["alliance_id"], [F.desc("uses"), "ship_type_id"], 7)


@query("alliance_posture", AK + """, p AS (SELECT alliance_id, count(*) AS total, count(*) / (90 / 7.0) AS kpw, avg(gang) AS gang FROM k WHERE killmail_time >= (SELECT max(killmail_time) FROM km) - INTERVAL 90 DAY GROUP BY 1)
SELECT alliance_id, total, round(kpw, 6) AS kills_per_week, round(gang, 6) AS avg_gang, CASE WHEN kpw >= 50 AND gang >= 10 THEN 'aggressive' WHEN kpw >= 20 AND gang >= 8 THEN 'committed' WHEN kpw >= 10 THEN 'balanced' WHEN total < 10 THEN 'infrequent' WHEN kpw >= 3 THEN 'opportunistic' ELSE 'infrequent' END AS posture FROM p""")  # fmt: skip
def alliance_posture(spark: SparkSession, d: str) -> DataFrame:
    t = F.broadcast(V.read(spark, d, "orders").agg(F.max("o_orderdate").alias("as_of")))
    k = kills(spark, d).join(t, F.col("killmail_time") >= F.col("as_of") - F.expr("INTERVAL 90 DAYS"))
    p = k.groupBy("alliance_id").agg(F.count(F.lit(1)).alias("total"), F.avg("gang").alias("gang")).withColumn("kpw", F.col("total") / (90 / 7.0))
    w, g = F.col("kpw"), F.col("gang")
    posture = F.when((w >= 50) & (g >= 10), "aggressive").when((w >= 20) & (g >= 8), "committed").when(w >= 10, "balanced").when(F.col("total") < 10, "infrequent").when(w >= 3, "opportunistic").otherwise("infrequent")
    return p.select("alliance_id", "total", rnd(w, 6).alias("kills_per_week"), rnd(g, 6).alias("avg_gang"), posture.alias("posture"))


@query("alliance_trend", AK + """, p AS (SELECT alliance_id, count(CASE WHEN killmail_time >= m - INTERVAL 7 DAY THEN 1 END) AS k7, count(CASE WHEN killmail_time < m - INTERVAL 7 DAY THEN 1 END) AS k30 FROM k, (SELECT max(killmail_time) AS m FROM km) WHERE killmail_time >= m - INTERVAL 30 DAY GROUP BY 1)
SELECT alliance_id, k7, k30 AS k8_30, CASE WHEN k7 > 1.5 * k30 / (23 / 7.0) THEN 'rising' WHEN k7 < 0.5 * k30 / (23 / 7.0) THEN 'declining' ELSE 'steady' END AS trend FROM p""")  # fmt: skip
def alliance_trend(spark: SparkSession, d: str) -> DataFrame:
    t = F.broadcast(V.read(spark, d, "orders").agg(F.max("o_orderdate").alias("as_of")))
    k = kills(spark, d).join(t, F.col("killmail_time") >= F.col("as_of") - F.expr("INTERVAL 30 DAYS"))
    new = F.col("killmail_time") >= F.col("as_of") - F.expr("INTERVAL 7 DAYS")
    p = k.groupBy("alliance_id").agg(F.sum(new.cast("bigint")).alias("k7"), F.sum((~new).cast("bigint")).alias("k8_30"))
    rate = F.col("k8_30") / (23 / 7.0)
    return p.withColumn("trend", F.when(F.col("k7") > 1.5 * rate, "rising").when(F.col("k7") < 0.5 * rate, "declining").otherwise("steady"))


@query("opposition_daily", AK + """SELECT CAST(date_trunc('day', killmail_time) AS TIMESTAMP) AS day, alliance_id, count(*) AS kills, count(DISTINCT system_id) AS systems, count(CASE WHEN total_value >= 300000 THEN 1 END) AS notable, round(max(total_value), 2) AS top_value FROM k GROUP BY 1, 2""")
def opposition_daily(spark: SparkSession, d: str, notable: float = 300_000) -> DataFrame:
    g = kills(spark, d).groupBy(F.date_trunc("day", "killmail_time").alias("day"), "alliance_id")
    return g.agg(F.count(F.lit(1)).alias("kills"), F.countDistinct("system_id").alias("systems"), F.sum((F.col("total_value") >= notable).cast("bigint")).alias("notable"), rnd(F.max("total_value"), 2).alias("top_value"))


ALLIED = AK + """, ae AS (SELECT a.alliance_id AS a, b.alliance_id AS b, count(*) AS n, max(a.killmail_time) AS last_at FROM k a JOIN k b ON a.sequence_id = b.sequence_id AND a.alliance_id < b.alliance_id GROUP BY 1, 2 HAVING count(*) >= 3),
he AS (SELECT alliance_id AS a, victim_alliance_id AS b, count(*) AS n, max(killmail_time) AS last_at FROM k WHERE alliance_id <> victim_alliance_id GROUP BY 1, 2 HAVING count(*) >= 3)"""
_CONF = "0.6 * least(1.0, n / greatest(1.0, 0.3 * max(n) OVER ())) + 0.4 * CASE WHEN dd <= 7 THEN 1.0 WHEN dd <= 30 THEN 0.7 WHEN dd <= 90 THEN 0.4 ELSE 0.1 END"


def allied(spark: SparkSession, d: str, least: int = 3) -> DataFrame:
    """Pairs of alliances on one killmail: a < b, counted by killmail."""
    p = pairs(V.attackers(spark, d).select("sequence_id", "alliance_id"), ["sequence_id"], "alliance_id")
    p = p.join(V.killmails(spark, d).select("sequence_id", "killmail_time"), "sequence_id")
    return p.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.max("killmail_time").alias("last_at")).where(F.col("n") >= least)


def hostile(spark: SparkSession, d: str, least: int = 3) -> DataFrame:
    k = kills(spark, d).where("alliance_id <> victim_alliance_id")
    return k.groupBy(F.col("alliance_id").alias("a"), F.col("victim_alliance_id").alias("b")).agg(F.count(F.lit(1)).alias("n"), F.max("killmail_time").alias("last_at")).where(F.col("n") >= least)


def with_confidence(e: DataFrame, as_of: DataFrame) -> DataFrame:
    most = F.broadcast(e.agg(F.max("n").alias("most")))
    j = e.crossJoin(most).crossJoin(F.broadcast(as_of))  # one row each
    return j.select("a", "b", "n", rnd(edge_confidence(F.col("n"), F.col("most"), F.datediff("as_of", "last_at")), 6).alias("confidence"))


@query("allied_edges", ALLIED + f", c AS (SELECT *, date_diff('day', CAST(last_at AS DATE), CAST((SELECT max(killmail_time) FROM km) AS DATE)) AS dd FROM ae) SELECT a, b, n, round({_CONF}, 6) AS confidence FROM c")
def allied_edges(spark: SparkSession, d: str) -> DataFrame:
    return with_confidence(allied(spark, d), V.read(spark, d, "orders").agg(F.max("o_orderdate").alias("as_of")))


@query("hostile_edges", ALLIED + f", c AS (SELECT *, date_diff('day', CAST(last_at AS DATE), CAST((SELECT max(killmail_time) FROM km) AS DATE)) AS dd FROM he) SELECT a, b, n, round({_CONF}, 6) AS confidence FROM c")
def hostile_edges(spark: SparkSession, d: str) -> DataFrame:
    return with_confidence(hostile(spark, d), V.read(spark, d, "orders").agg(F.max("o_orderdate").alias("as_of")))


@query("ceasefires", ALLIED + "SELECT ae.a, ae.b, ae.n AS allied_n, he.n AS hostile_n FROM ae JOIN he ON ae.a = he.a AND ae.b = he.b")
def ceasefires(spark: SparkSession, d: str) -> DataFrame:
    return allied(spark, d).select("a", "b", F.col("n").alias("allied_n")).join(hostile(spark, d).select("a", "b", F.col("n").alias("hostile_n")), ["a", "b"])


@query("transitive_allies", ALLIED + """, s AS (SELECT a, b FROM ae WHERE n >= (SELECT quantile_disc(n, 0.7) FROM ae)), u AS (SELECT a, b FROM s UNION ALL SELECT b, a FROM s)
SELECT x.a AS a, y.b AS b, count(*) AS bridges FROM u x JOIN u y ON x.b = y.a AND x.a < y.b WHERE NOT EXISTS (SELECT 1 FROM u z WHERE z.a = x.a AND z.b = y.b) GROUP BY 1, 2 HAVING count(*) >= 2""")  # fmt: skip
def transitive_allies(spark: SparkSession, d: str) -> DataFrame:
    """Alliances with two or more common strong allies that are not allies themselves."""
    e = allied(spark, d)
    cut = F.broadcast(e.agg(F.expr("percentile_disc(0.7) WITHIN GROUP (ORDER BY n)").alias("cut")))
    s = e.join(cut, F.col("n") >= F.col("cut")).select("a", "b")
    u = s.union(s.select("b", "a"))
    two = u.select("a", F.col("b").alias("m")).join(u.select(F.col("a").alias("m"), F.col("b").alias("c")), "m").where("a < c").groupBy("a", F.col("c").alias("b")).agg(F.count(F.lit(1)).alias("bridges"))
    return two.where("bridges >= 2").join(u, ["a", "b"], "left_anti")


@query("system_threat", V.ctes("km") + """, t AS (SELECT max(killmail_time) AS m FROM km), s AS (SELECT system_id, count(*) AS total, count(CASE WHEN killmail_time >= m - INTERVAL 365 DAY THEN 1 END) AS recent, count(DISTINCT CASE WHEN victim_alliance_id > 20 THEN victim_alliance_id END) AS hostiles FROM km, t GROUP BY 1)
SELECT system_id, total, recent, hostiles, round(total * (1 + recent / total) * (1 + 0.2 * hostiles), 6) AS score, CASE WHEN total * (1 + recent / total) * (1 + 0.2 * hostiles) >= 1200 THEN 'critical' WHEN total * (1 + recent / total) * (1 + 0.2 * hostiles) >= 1000 THEN 'high' ELSE 'medium' END AS level FROM s""")  # fmt: skip
def system_threat(spark: SparkSession, d: str, cuts=((1200, "critical"), (1000, "high"))) -> DataFrame:
    """Hot spots, on distinct killmails per system; the level's cuts are parameters."""
    km = V.killmails(spark, d)
    t = F.broadcast(km.agg(F.max("killmail_time").alias("m")))
    inside = F.col("killmail_time") >= F.col("m") - F.expr("INTERVAL 365 DAYS")
    s = km.crossJoin(t).groupBy("system_id").agg(F.count(F.lit(1)).alias("total"), F.sum(inside.cast("bigint")).alias("recent"), F.countDistinct(F.when(F.col("victim_alliance_id") > 20, F.col("victim_alliance_id"))).alias("hostiles"))
    score = F.col("total") * (1 + F.col("recent") / F.col("total")) * (1 + 0.2 * F.col("hostiles"))
    return s.withColumn("score", rnd(score, 6)).withColumn("level", tier(score, cuts, "medium"))


ACTIVE = V.ctes("km", "sg") + ", act AS (SELECT system_id, count(*) AS n FROM km GROUP BY 1 HAVING count(*) >= (SELECT quantile_disc(c, 0.5) FROM (SELECT count(*) AS c FROM km GROUP BY system_id)))"


@query("threat_corridors", ACTIVE + """, e AS (SELECT src, dst FROM sg WHERE src IN (SELECT system_id FROM act) AND dst IN (SELECT system_id FROM act)),
p2 AS (SELECT src AS s1, dst AS s2, x.n + y.n AS total FROM e JOIN act x ON x.system_id = src JOIN act y ON y.system_id = dst),
p3 AS (SELECT p2.* EXCLUDE (total), dst AS s3, total + n AS total FROM p2 JOIN e ON s2 = src JOIN act ON system_id = dst WHERE dst <> s1),
p4 AS (SELECT p3.* EXCLUDE (total), dst AS s4, total + n AS total FROM p3 JOIN e ON s3 = src JOIN act ON system_id = dst WHERE dst NOT IN (s1, s2)),
p5 AS (SELECT p4.* EXCLUDE (total), dst AS s5, total + n AS total FROM p4 JOIN e ON s4 = src JOIN act ON system_id = dst WHERE dst NOT IN (s1, s2, s3)),
al AS (SELECT concat_ws('-', s1, s2) AS path, s1, s2 AS sn, 2 AS len, total FROM p2 UNION ALL SELECT concat_ws('-', s1, s2, s3), s1, s3, 3, total FROM p3
UNION ALL SELECT concat_ws('-', s1, s2, s3, s4), s1, s4, 4, total FROM p4 UNION ALL SELECT concat_ws('-', s1, s2, s3, s4, s5), s1, s5, 5, total FROM p5)
SELECT path, CAST(len AS INTEGER) AS length, CAST(total AS BIGINT) AS kills, round(total / len * (1 + 0.1 * len), 6) AS score FROM al WHERE s1 < sn""")  # fmt: skip
def threat_corridors(spark: SparkSession, d: str, most: int = 5) -> DataFrame:
    """Simple paths over active systems only, of 2 to `most` systems, first end before the last."""
    n = V.killmails(spark, d).groupBy("system_id").agg(F.count(F.lit(1)).alias("n"))
    cut = F.broadcast(n.agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY n)").alias("cut")))
    act = n.join(cut, F.col("n") >= F.col("cut")).select("system_id", "n")
    e = V.system_graph(spark, d).join(act.select(F.col("system_id").alias("src")), "src", "left_semi").join(act.select(F.col("system_id").alias("dst"), "n"), "dst")
    p = e.join(act.select(F.col("system_id").alias("src"), F.col("n").alias("n0")), "src").select(F.array("src", "dst").alias("path"), (F.col("n0") + F.col("n")).alias("total"))
    out = None
    for k in range(2, most + 1):
        step = e.select(F.col("src").alias("_at"), F.col("dst").alias("_to"), F.col("n").alias("_n"))
        if k > 2:
            p = p.join(step, F.element_at("path", -1) == F.col("_at")).where(~F.array_contains("path", F.col("_to"))).select(F.concat("path", F.array("_to")).alias("path"), (F.col("total") + F.col("_n")).alias("total"))
        row = p.where(F.element_at("path", 1) < F.element_at("path", -1)).select(F.array_join(F.col("path").cast("array<string>"), "-").alias("path"), F.lit(k).alias("length"), F.col("total").alias("kills"), rnd(F.col("total") / k * (1 + 0.1 * k), 6).alias("score"))
        out = row if out is None else out.union(row)
    return out


@query("map_label_priority", V.ctes("km", "sg") + """, b AS (SELECT system_id, count(*) AS battles FROM km GROUP BY 1), g AS (SELECT src AS system_id, count(*) AS deg FROM sg GROUP BY 1),
h AS (SELECT a.src AS system_id, count(DISTINCT c.dst) AS reach FROM sg a JOIN sg c ON a.dst = c.src AND c.dst <> a.src GROUP BY 1)
SELECT system_id, deg, reach, coalesce(battles, 0) AS battles, round(0.4 * reach / max(reach) OVER () + 0.3 * deg / max(deg) OVER () + 0.3 * coalesce(battles, 0) / max(battles) OVER (), 6) AS priority FROM g JOIN h USING (system_id) LEFT JOIN b USING (system_id)""")  # fmt: skip
def map_label_priority(spark: SparkSession, d: str) -> DataFrame:
    """Label priority .4 reach (stand-in for betweenness, which graphs.betweenness has), .3 degree, .3 battles, each over its largest."""
    sg = V.system_graph(spark, d)
    g = sg.groupBy(F.col("src").alias("system_id")).agg(F.count(F.lit(1)).alias("deg"))
    h = sg.select(F.col("src").alias("system_id"), F.col("dst").alias("m")).join(sg.select(F.col("src").alias("m"), F.col("dst").alias("c")), "m").where("c <> system_id").groupBy("system_id").agg(F.countDistinct("c").alias("reach"))
    b = V.killmails(spark, d).groupBy("system_id").agg(F.count(F.lit(1)).alias("battles"))
    j = g.join(h, "system_id").join(b, "system_id", "left").withColumn("battles", F.coalesce("battles", F.lit(0)))
    top = F.broadcast(j.agg(F.max("reach").alias("mr"), F.max("deg").alias("md"), F.max("battles").alias("mb")))
    return j.crossJoin(top).select("system_id", "deg", "reach", "battles", rnd(0.4 * F.col("reach") / F.col("mr") + 0.3 * F.col("deg") / F.col("md") + 0.3 * F.col("battles") / F.col("mb"), 6).alias("priority"))


@query("edge_risk", V.ctes("km", "sg") + """, k AS (SELECT system_id, count(*) AS n FROM km WHERE killmail_time >= (SELECT max(killmail_time) FROM km) - INTERVAL 30 DAY GROUP BY 1)
SELECT src, dst, coalesce(a.n, 0) + coalesce(b.n, 0) AS battles, round(0.3 * (coalesce(a.n, 0) + coalesce(b.n, 0)) + 0.2 * 10 * CAST(coalesce(a.n, 0) + coalesce(b.n, 0) >= 3 AS INT), 6) AS risk FROM sg LEFT JOIN k a ON a.system_id = src LEFT JOIN k b ON b.system_id = dst WHERE src < dst""")  # fmt: skip
def edge_risk(spark: SparkSession, d: str) -> DataFrame:
    km = V.killmails(spark, d)
    t = F.broadcast(km.agg(F.max("killmail_time").alias("m")))
    n = km.join(t, F.col("killmail_time") >= F.col("m") - F.expr("INTERVAL 30 DAYS")).groupBy("system_id").agg(F.count(F.lit(1)).alias("n"))
    e = V.system_graph(spark, d).where("src < dst").join(n.select(F.col("system_id").alias("src"), F.col("n").alias("a")), "src", "left").join(n.select(F.col("system_id").alias("dst"), F.col("n").alias("b")), "dst", "left")
    battles = F.coalesce("a", F.lit(0)) + F.coalesce("b", F.lit(0))
    return e.select("src", "dst", battles.alias("battles"), rnd(0.3 * battles + 0.2 * 10 * (battles >= 3).cast("int"), 6).alias("risk"))


@query("sovereignty_changes", V.ctes("km") + """, o AS (SELECT system_id, CASE WHEN killmail_time >= (SELECT max(killmail_time) FROM km) - INTERVAL 730 DAY THEN 'cur' ELSE 'prev' END AS era, victim_alliance_id, count(*) AS n FROM km GROUP BY 1, 2, 3),
w AS (SELECT system_id, era, victim_alliance_id AS holder FROM o QUALIFY row_number() OVER (PARTITION BY system_id, era ORDER BY n DESC, victim_alliance_id) = 1)
SELECT coalesce(p.system_id, c.system_id) AS system_id, p.holder AS previous, c.holder AS current, CASE WHEN p.holder IS NULL THEN 'gained' WHEN c.holder IS NULL THEN 'lost' WHEN p.holder <> c.holder THEN 'changed' ELSE 'held' END AS change
FROM (SELECT * FROM w WHERE era = 'prev') p FULL JOIN (SELECT * FROM w WHERE era = 'cur') c ON p.system_id = c.system_id""")  # fmt: skip
def sovereignty_changes(spark: SparkSession, d: str) -> DataFrame:
    """Holder of a system then and now, as a change record."""
    km = V.killmails(spark, d)
    t = F.broadcast(km.agg(F.max("killmail_time").alias("m")))
    o = km.crossJoin(t).withColumn("era", F.when(F.col("killmail_time") >= F.col("m") - F.expr("INTERVAL 730 DAYS"), "cur").otherwise("prev")).groupBy("system_id", "era", "victim_alliance_id").agg(F.count(F.lit(1)).alias("n"))
    w = top_k(o, ["system_id", "era"], [F.desc("n"), "victim_alliance_id"], 1)
    p, c = w.where("era = 'prev'").select("system_id", F.col("victim_alliance_id").alias("previous")), w.where("era = 'cur'").select("system_id", F.col("victim_alliance_id").alias("current"))
    change = F.when(F.col("previous").isNull(), "gained").when(F.col("current").isNull(), "lost").when(F.col("previous") != F.col("current"), "changed").otherwise("held")
    return p.join(c, "system_id", "full").select("system_id", "previous", "current", change.alias("change"))


@query("shell_scores", V.ctes("km") + """, a AS (SELECT victim_alliance_id AS alliance_id, count(DISTINCT victim_character_id) AS members, count(*) AS losses, date_diff('day', min(killmail_time), max(killmail_time)) AS age, count(DISTINCT system_id) AS systems FROM km GROUP BY 1)
SELECT alliance_id, members, losses, round(0.15 * greatest(0, least(1, 1 - age / 3000.0)) + 0.25 * greatest(0, least(1, losses / members / 20.0)) + 0.20 * greatest(0, least(1, 1 - losses / 1000.0)) + 0.10 * greatest(0, least(1, 1 - members / 100.0)) + 0.10 * greatest(0, least(1, systems / 25.0)), 6) AS score FROM a""")  # fmt: skip
def shell_scores(spark: SparkSession, d: str) -> DataFrame:
    """Shell-organisation score from age, turnover, activity, size and churn."""
    a = V.killmails(spark, d).groupBy(F.col("victim_alliance_id").alias("alliance_id")).agg(F.countDistinct("victim_character_id").alias("members"), F.count(F.lit(1)).alias("losses"), F.datediff(F.max("killmail_time"), F.min("killmail_time")).alias("age"), F.countDistinct("system_id").alias("systems"))
    s = 0.15 * clamp(1 - F.col("age") / 3000.0) + 0.25 * clamp(F.col("losses") / F.col("members") / 20.0) + 0.20 * clamp(1 - F.col("losses") / 1000.0) + 0.10 * clamp(1 - F.col("members") / 100.0) + 0.10 * clamp(F.col("systems") / 25.0)
    return a.select("alliance_id", "members", "losses", rnd(s, 6).alias("score"))


@query("staging_systems", V.ctes("km", "sg") + """, n AS (SELECT system_id, count(DISTINCT victim_character_id) AS pilots, count(*) AS battles FROM km WHERE killmail_time >= (SELECT max(killmail_time) FROM km) - INTERVAL 60 DAY GROUP BY 1),
j AS (SELECT s, t, min(h) AS h FROM (SELECT src AS s, dst AS t, 1 AS h FROM sg UNION ALL SELECT a.src, b.dst, 2 FROM sg a JOIN sg b ON a.dst = b.src WHERE a.src <> b.dst) GROUP BY 1, 2),
g AS (SELECT s AS system_id, CAST(sum(pilots) AS BIGINT) AS pilots, CAST(sum(battles) AS BIGINT) AS battles, avg(h) AS jumps FROM j JOIN n ON n.system_id = j.t GROUP BY 1)
SELECT system_id, pilots, battles, round(jumps, 6) AS avg_jumps, round(0.4 * least(1.0, pilots / 300.0) + 0.35 * least(1.0, battles / 350.0) + 0.25 * (1 - jumps / 4), 6) AS score FROM g WHERE pilots >= 3 AND battles >= 2 AND 0.4 * least(1.0, pilots / 300.0) + 0.35 * least(1.0, battles / 350.0) + 0.25 * (1 - jumps / 4) >= 0.15""")  # fmt: skip
def staging_systems(spark: SparkSession, d: str) -> DataFrame:
    """Systems within two jumps of much fighting."""
    km, sg = V.killmails(spark, d), V.system_graph(spark, d)
    t = F.broadcast(km.agg(F.max("killmail_time").alias("m")))
    n = km.join(t, F.col("killmail_time") >= F.col("m") - F.expr("INTERVAL 60 DAYS")).groupBy(F.col("system_id").alias("t")).agg(F.countDistinct("victim_character_id").alias("p"), F.count(F.lit(1)).alias("b"))
    two = sg.select(F.col("src").alias("s"), F.col("dst").alias("m")).join(sg.select(F.col("src").alias("m"), F.col("dst").alias("t")), "m").where("s <> t").select("s", "t", F.lit(2).alias("h"))
    near = sg.select(F.col("src").alias("s"), F.col("dst").alias("t"), F.lit(1).alias("h")).union(two).groupBy("s", "t").agg(F.min("h").alias("h"))
    g = near.join(n, "t").groupBy(F.col("s").alias("system_id")).agg(F.sum("p").alias("pilots"), F.sum("b").alias("battles"), F.avg("h").alias("jumps"))
    score = 0.4 * F.least(F.lit(1.0), F.col("pilots") / 300.0) + 0.35 * F.least(F.lit(1.0), F.col("battles") / 350.0) + 0.25 * (1 - F.col("jumps") / 4)
    return g.where((F.col("pilots") >= 3) & (F.col("battles") >= 2) & (score >= 0.15)).select("system_id", "pilots", "battles", rnd("jumps", 6).alias("avg_jumps"), rnd(score, 6).alias("score"))


@query("leaderboard", V.ctes("km", "ka") + """, f AS (SELECT character_id, count(*) AS kills, CAST(sum(CAST(total_value AS DECIMAL(20,4))) AS DOUBLE) AS value FROM ka JOIN km USING (sequence_id) WHERE final_blow GROUP BY 1)
SELECT 'kills' AS board, character_id, CAST(kills AS DOUBLE) AS score, CAST(row_number() OVER (ORDER BY kills DESC, character_id) AS INTEGER) AS place FROM f QUALIFY place <= 20
UNION ALL SELECT 'value', character_id, round(value, 2), CAST(row_number() OVER (ORDER BY value DESC, character_id) AS INTEGER) AS place FROM f QUALIFY place <= 20""")  # fmt: skip
def leaderboard(spark: SparkSession, d: str, k: int = 20) -> DataFrame:
    """Boards by kills and by value: two top-k lists of one table, in long form."""
    f = V.attackers(spark, d).where("final_blow").join(V.killmails(spark, d).select("sequence_id", "total_value"), "sequence_id").groupBy("character_id").agg(F.count(F.lit(1)).cast("double").alias("kills"), rnd(exact_sum(F.col("total_value")), 2).alias("value"))
    tall = f.unpivot("character_id", ["kills", "value"], "board", "score")
    return top_k(tall, ["board"], [F.desc("score"), "character_id"], k, "place").select("board", "character_id", "score", "place")


@query("recent_killmails", V.ctes("km") + "SELECT sequence_id, killmail_time, victim_alliance_id, round(total_value, 2) AS total_value FROM km WHERE region_id = 2 AND mail_type <> 'P' AND total_value >= 100000 ORDER BY killmail_time DESC, sequence_id DESC LIMIT 50 OFFSET 10")
def recent_killmails(spark: SparkSession, d: str) -> DataFrame:
    k = V.killmails(spark, d).where("region_id = 2 and mail_type <> 'P' and total_value >= 100000").orderBy(F.desc("killmail_time"), F.desc("sequence_id"))
    return k.offset(10).limit(50).select("sequence_id", "killmail_time", "victim_alliance_id", rnd("total_value", 2).alias("total_value"))
