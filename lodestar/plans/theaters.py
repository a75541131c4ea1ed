"""Theaters from battles by all merge rules, with absorption and splits, and the second suspicion score with its thirteen components.

Stand-ins: two systems make a constellation, six a region; pilots who click or view are friendly; the alliance of a pilot is its number
mod 5. Cuts on numbers of pilots are parameters, since the fixture's battles are small.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.functions.kernels import clamp, exact_sum, rnd, safe_div
from lodestar.operators import graph as G
from lodestar.operators.relational import band_join, gap_islands, met_pairs, overlap_join
from lodestar.plans.battle import SIDES, actor_table, side_scores, with_battle
from lodestar.plans.registry import query
from lodestar.sources import views as V

#: Merge window and overlaps, absorption margin, and the split's weights and cuts.
GAP, REGION_OVERLAP, GATE_OVERLAP, MARGIN = 45 * 60, 0.10, 0.05, 5 * 60
SPLIT_AT, SCALE, COMMAND, FRIENDLY, OPPONENT, LATE = 6, 3, 3, 2, 2, 1
GEO = {2: 2, 3: 3}  # gates: weight; adjacent 0, farther GEO_FAR, unknown GEO_UNKNOWN
GEO_FAR, GEO_UNKNOWN = 5, 3
FRIENDLY_JACCARD, COMMAND_JACCARD, LATE_SECONDS, SAME_SYSTEM_SECONDS, PRIMARY_SHARE = 0.40, 0.50, 5 * 60, 30 * 60, 0.30
WINDOW = 900

THEATERS = V.ctes("es", "sg").replace("WITH", "WITH RECURSIVE", 1) + """, b0 AS (SELECT *, sha256(concat(system_id, ':', CAST(floor(epoch(ts) / 900) * 900 AS BIGINT))) AS battle_id FROM es),
bt AS (SELECT battle_id, min(system_id) AS system_id, min(system_id) // 2 AS con, min(system_id) // 6 AS region, min(ts) AS s, max(ts) AS e, count(DISTINCT character_id) AS n FROM b0 GROUP BY 1),
pl AS (SELECT DISTINCT battle_id, character_id FROM b0), sd AS (SELECT * FROM bt WHERE n >= 2),
near AS (SELECT a.battle_id AS a, b.battle_id AS b, a.con = b.con AS same_con, a.region = b.region AS same_region, a.system_id AS sa, b.system_id AS sb, a.n AS na, b.n AS nb FROM sd a JOIN sd b ON a.battle_id < b.battle_id AND greatest(epoch_us(b.s) - epoch_us(a.e), epoch_us(a.s) - epoch_us(b.e)) <= 2700000000),
ov AS (SELECT near.a, near.b, count(*) AS k FROM near JOIN pl x ON x.battle_id = a JOIN pl y ON y.battle_id = b AND y.character_id = x.character_id GROUP BY 1, 2),
hop AS (SELECT s, t, min(d) AS d FROM (SELECT DISTINCT src AS s, src AS t, 0 AS d FROM sg UNION ALL SELECT src, dst, 1 FROM sg UNION ALL SELECT DISTINCT a.src, b.dst, 2 FROM sg a JOIN sg b ON a.dst = b.src UNION ALL SELECT DISTINCT a.src, c.dst, 3 FROM sg a JOIN sg b ON a.dst = b.src JOIN sg c ON b.dst = c.src) GROUP BY 1, 2),
lk AS (SELECT a, b FROM near LEFT JOIN ov USING (a, b) LEFT JOIN hop ON hop.s = sa AND hop.t = sb WHERE same_con OR same_region AND k >= 0.10 * least(na, nb) OR d <= 1 AND k >= 0.05 * least(na, nb)),
le AS (SELECT a AS src, b AS dst FROM lk UNION ALL SELECT b, a FROM lk), rr(node, reach) AS (SELECT battle_id, battle_id FROM sd UNION SELECT node, dst FROM rr JOIN le ON src = reach), th AS (SELECT node AS battle_id, min(reach) AS root FROM rr GROUP BY 1),
tw AS (SELECT root, min(s) AS s, max(e) AS e FROM th JOIN bt USING (battle_id) GROUP BY 1), ts AS (SELECT DISTINCT root, system_id FROM th JOIN bt USING (battle_id)),
ab AS (SELECT bt.battle_id, min(root) AS root FROM bt JOIN ts USING (system_id) JOIN tw USING (root) WHERE n < 2 AND bt.s <= tw.e + INTERVAL 5 MINUTE AND bt.e >= tw.s - INTERVAL 5 MINUTE GROUP BY 1),
al AS (SELECT root, bt.* FROM (SELECT * FROM th UNION ALL SELECT * FROM ab) JOIN bt USING (battle_id)),
fr AS (SELECT battle_id, list(DISTINCT character_id) FILTER (WHERE side_key IN ('click', 'view')) AS friends, list(DISTINCT character_id) FILTER (WHERE side_key IN ('click', 'view') AND ship_type_id % 10 = 1) AS command FROM b0 GROUP BY 1),
oc AS (SELECT battle_id, character_id % 5 + 1 AS alliance, count(DISTINCT character_id) AS c FROM b0 WHERE side_key NOT IN ('click', 'view') GROUP BY 1, 2),
op AS (SELECT battle_id, alliance AS primary_opp FROM oc QUALIFY row_number() OVER (PARTITION BY battle_id ORDER BY c DESC, alliance) = 1 AND c >= 0.30 * sum(c) OVER (PARTITION BY battle_id)),
x AS (SELECT al.*, coalesce(friends, []) AS friends, coalesce(command, []) AS command, coalesce(primary_opp, 0) AS opp FROM al LEFT JOIN fr USING (battle_id) LEFT JOIN op USING (battle_id)),
y AS (SELECT *, lag(system_id) OVER w AS p_system, lag(e) OVER w AS p_e, lag(n) OVER w AS p_n, lag(friends) OVER w AS p_friends, lag(command) OVER w AS p_command, lag(opp) OVER w AS p_opp FROM x WINDOW w AS (PARTITION BY root ORDER BY s, battle_id)),
z AS (SELECT y.*, greatest(0, (epoch_us(y.s) - epoch_us(p_e)) / 1000000.0) AS gap, CASE WHEN p_system = system_id THEN 0 WHEN d IS NULL THEN 5 WHEN d <= 1 THEN 0 WHEN d = 2 THEN 2 WHEN d = 3 THEN 3 ELSE 5 END AS geo FROM y LEFT JOIN hop ON hop.s = p_system AND hop.t = system_id),
v AS (SELECT *, CASE WHEN p_system IS NULL OR p_system = system_id AND gap < 1800 THEN 0 ELSE geo + CASE WHEN (n >= 4) <> (p_n >= 4) THEN 3 ELSE 0 END
+ CASE WHEN len(command) >= 1 AND len(p_command) >= 1 AND len(list_intersect(command, p_command)) / len(list_distinct(list_concat(command, p_command))) < 0.5 THEN 3 ELSE 0 END
+ CASE WHEN len(list_concat(friends, p_friends)) > 0 AND len(list_intersect(friends, p_friends)) / len(list_distinct(list_concat(friends, p_friends))) < 0.4 THEN 2 ELSE 0 END
+ CASE WHEN opp > 0 AND p_opp > 0 AND opp <> p_opp THEN 2 ELSE 0 END + CASE WHEN gap >= 300 THEN 1 ELSE 0 END END AS score FROM z),
sg2 AS (SELECT *, sum(CASE WHEN score >= 6 THEN 1 ELSE 0 END) OVER (PARTITION BY root ORDER BY s, battle_id ROWS UNBOUNDED PRECEDING) AS seg FROM v)"""


def battles(spark: SparkSession, d: str) -> DataFrame:
    """battle_id, system_id, constellation, region, s, e, n, friends, command and opp (the main opposing alliance, 0 for none)."""
    b = with_battle(V.event_stream(spark, d), WINDOW)
    friend, k = F.col("side_key").isin("click", "view"), F.col("character_id")
    g = b.groupBy("battle_id").agg(
        F.min("system_id").alias("system_id"), F.min("ts").alias("s"), F.max("ts").alias("e"), F.countDistinct("character_id").alias("n"), F.collect_set(F.when(friend, k)).alias("friends"),
        F.collect_set(F.when(friend & (F.col("ship_type_id") % 10 == 1), k)).alias("command"),
    )
    c = b.where(~friend).groupBy("battle_id", (k % 5 + 1).alias("alliance")).agg(F.countDistinct("character_id").alias("c"))
    c = c.groupBy("battle_id").agg(F.sum("c").alias("all_"), F.min(F.struct((-F.col("c")).alias("c"), "alliance")).alias("top"))
    c = c.select("battle_id", F.when(-F.col("top.c") >= PRIMARY_SHARE * F.col("all_"), F.col("top.alliance")).alias("opp"))
    g = g.withColumn("con", F.floor(F.col("system_id") / 2)).withColumn("region", F.floor(F.col("system_id") / 6))
    return G.cut(g.join(c, "battle_id", "left").withColumn("opp", F.coalesce("opp", F.lit(0))))


def merged(bt: DataFrame, pilots: DataFrame, hops: DataFrame, seed: int, gates: int) -> DataFrame:
    """battle_id and root of the seed battles: one constellation and near in time; one region and shared pilots; few gates and shared pilots."""
    seeds = bt.where(F.col("n") >= seed).select("battle_id", "system_id", "con", "region", "s", "e", "n")
    first = Window.partitionBy("con", "island")
    same = gap_islands(seeds, ["con"], "s", "e", "battle_id", GAP).select(F.col("battle_id").alias("a"), F.min("battle_id").over(first).alias("b"))
    # pairs that share a pilot are met at the pilot's own battles, near in time
    p = pilots.join(seeds, "battle_id")
    other = p.select("character_id", *(F.col(c).alias(f"{c}_b") for c in seeds.columns))
    pairs = band_join(p, other, ["character_id"], "s", "s_b", GAP + WINDOW).where("battle_id < battle_id_b")
    gap = F.greatest(F.unix_micros("s_b") - F.unix_micros("e"), F.unix_micros("s") - F.unix_micros("e_b"))
    by = ["battle_id", "battle_id_b", "region", "region_b", "system_id", "system_id_b", "n", "n_b"]
    shared = pairs.where(gap <= GAP * 1_000_000).groupBy(*by).agg(F.count(F.lit(1)).alias("k")).join(hops, ["system_id", "system_id_b"], "left")
    part = F.col("k") / F.least("n", "n_b")
    met = shared.where(((F.col("region") == F.col("region_b")) & (part >= REGION_OVERLAP)) | ((F.col("hops") <= gates) & (part >= GATE_OVERLAP)))
    links = same.where("a <> b").union(met.select(F.col("battle_id").alias("a"), F.col("battle_id_b").alias("b")))
    comp = G.components(G.cut(G.undirected(links).distinct()))
    return seeds.select("battle_id").join(comp.withColumnRenamed("node", "battle_id"), "battle_id", "left").select("battle_id", F.coalesce("component", "battle_id").alias("root"))


def absorbed(bt: DataFrame, roots: DataFrame, seed: int) -> DataFrame:
    """Smaller battles in a theater's systems and time, each in the first of its theaters."""
    t = roots.join(bt, "battle_id").groupBy("root").agg(F.min("s").alias("ts"), F.max("e").alias("te"), F.collect_set("system_id").alias("systems"))
    margin = F.expr(f"INTERVAL {MARGIN} SECONDS")
    t = t.select("root", (F.col("ts") - margin).alias("ts"), (F.col("te") + margin).alias("te"), F.explode("systems").alias("system_id"))
    small = bt.where(F.col("n") < seed).select("battle_id", "system_id", "s", "e")
    return overlap_join(small, t, ["system_id"], ("s", "e"), ("ts", "te"), 1).groupBy("battle_id").agg(F.min("root").alias("root"))


def split(al: DataFrame, hops: DataFrame, mega: int, officers: int) -> DataFrame:
    """seg of each battle of a root: a new one where the signals between neighbours in time add up to SPLIT_AT."""
    w = Window.partitionBy("root").orderBy("s", "battle_id")
    for c in ("system_id", "e", "n", "friends", "command", "opp"):
        al = al.withColumn(f"p_{c}", F.lag(c).over(w))
    al = al.join(hops.toDF("p_system_id", "system_id", "hops"), ["p_system_id", "system_id"], "left")
    gap = F.greatest(F.lit(0.0), (F.unix_micros("s") - F.unix_micros("p_e")) / 1_000_000)
    like = lambda c: F.size(F.array_intersect(c, f"p_{c}")) / F.nullif(F.size(F.array_union(c, f"p_{c}")), F.lit(0))
    same = F.col("p_system_id") == F.col("system_id")
    geo = F.when(same, 0).when(F.col("hops").isNull(), GEO_FAR).when(F.col("hops") <= 1, 0)
    for gates, weight in GEO.items():
        geo = geo.when(F.col("hops") == gates, weight)
    sign = lambda cond, weight: F.when(cond, weight).otherwise(0)
    score = geo.otherwise(GEO_FAR) + sign((F.col("n") >= mega) != (F.col("p_n") >= mega), SCALE)
    score += sign((F.size("command") >= officers) & (F.size("p_command") >= officers) & (like("command") < COMMAND_JACCARD), COMMAND)
    score += sign(like("friends") < FRIENDLY_JACCARD, FRIENDLY) + sign((F.col("opp") > 0) & (F.col("p_opp") > 0) & (F.col("opp") != F.col("p_opp")), OPPONENT) + sign(gap >= LATE_SECONDS, LATE)
    score = F.when(F.col("p_system_id").isNull() | (same & (gap < SAME_SYSTEM_SECONDS)), 0).otherwise(score)
    al = al.withColumn("score", score)
    return al.withColumn("seg", F.sum((F.col("score") >= SPLIT_AT).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def theater_battles(spark: SparkSession, d: str, seed: int = 2, gates: int = 1, mega: int = 4, officers: int = 1) -> DataFrame:
    """Every battle of a theater with its root, seg and the score against the battle before it."""
    bt = battles(spark, d)
    pilots = with_battle(V.event_stream(spark, d), WINDOW).select("battle_id", "character_id").distinct()
    sg = V.system_graph(spark, d)
    hops = G.cut(G.hops(sg, sg.select(F.col("src").alias("source")).distinct(), 3).toDF("system_id", "system_id_b", "hops"))  # systems only
    roots = merged(bt, pilots, F.broadcast(hops), seed, gates)
    roots = G.cut(roots)
    al = roots.union(absorbed(bt, roots, seed).select("battle_id", "root")).join(bt, "battle_id")
    return G.cut(split(al, F.broadcast(hops), mega, officers))


@query("theaters", THEATERS + """, pp AS (SELECT root, seg, count(DISTINCT character_id) AS pilots FROM sg2 JOIN pl USING (battle_id) GROUP BY 1, 2)
SELECT sha256(string_agg(battle_id, '|' ORDER BY battle_id)) AS theater_id, count(*) AS battles, count(DISTINCT system_id) AS systems, max(pilots) AS pilots, min(s) AS started_at, max(e) AS ended_at, max(n) AS peak FROM sg2 JOIN pp USING (root, seg) WHERE pilots >= 3 GROUP BY root, seg""")
def theaters(spark: SparkSession, d: str, least_pilots: int = 3) -> DataFrame:
    """Theaters by all rules: merged, with small battles absorbed, split where neighbours differ too much; those of too few pilots go."""
    al = theater_battles(spark, d)
    pilots = with_battle(V.event_stream(spark, d), WINDOW).select("battle_id", "character_id").distinct()
    pp = al.select("root", "seg", "battle_id").join(pilots, "battle_id").groupBy("root", "seg").agg(F.countDistinct("character_id").alias("pilots"))
    g = al.groupBy("root", "seg").agg(
        F.sha2(F.array_join(F.array_sort(F.collect_list("battle_id")), "|"), 256).alias("theater_id"), F.count(F.lit(1)).alias("battles"), F.countDistinct("system_id").alias("systems"), F.min("s").alias("started_at"), F.max("e").alias("ended_at"), F.max("n").alias("peak")
    )
    return g.join(pp, ["root", "seg"]).where(F.col("pilots") >= least_pilots).select("theater_id", "battles", "systems", "pilots", "started_at", "ended_at", "peak")


@query("theater_boundaries", THEATERS + "SELECT battle_id, root, CAST(score AS INTEGER) AS score, CAST(seg AS BIGINT) AS seg FROM sg2")
def theater_boundaries(spark: SparkSession, d: str) -> DataFrame:
    """The score of each battle against the one before it in its theater, and the segment it is in."""
    return theater_battles(spark, d).select("battle_id", "root", F.col("score").cast("int").alias("score"), "seg")


@query("theater_graph", THEATERS + """, q AS (SELECT DISTINCT root, character_id FROM sg2 JOIN pl USING (battle_id)), t AS (SELECT character_id, count(*) AS theaters FROM q GROUP BY 1)
SELECT a.character_id AS a, b.character_id AS b, count(*) AS shared, round(count(*) / least(min(x.theaters), min(y.theaters)), 6) AS closeness FROM q a JOIN q b ON a.root = b.root AND a.character_id < b.character_id JOIN t x ON x.character_id = a.character_id JOIN t y ON y.character_id = b.character_id GROUP BY 1, 2 HAVING count(*) >= 3""")
def theater_graph(spark: SparkSession, d: str) -> DataFrame:
    """Pilots that meet in three theaters or more, by the share of the rarer one's theaters."""
    pilots = with_battle(V.event_stream(spark, d), WINDOW).select("battle_id", "character_id").distinct()
    q = G.cut(theater_battles(spark, d).select("root", "battle_id").join(pilots, "battle_id").select("root", "character_id").distinct())
    t = q.groupBy("character_id").agg(F.count(F.lit(1)).alias("theaters"))
    # pilots of fewer than three theaters meet no one in three
    often = q.join(t.where("theaters >= 3"), "character_id", "left_semi")
    n = met_pairs(often, ["root"], [], "character_id").groupBy("meet", "a", "b").agg(F.count(F.lit(1)).alias("shared")).where("shared >= 3").drop("meet")
    j = n.join(t.toDF("a", "ta"), "a").join(t.toDF("b", "tb"), "b")
    return j.select("a", "b", "shared", rnd(F.col("shared") / F.least("ta", "tb"), 6).alias("closeness"))


#: Weights of the second suspicion score.
V2 = {
    "high_sustain_frequency": 0.12, "cross_side_rate": 0.09, "enemy_efficiency_uplift": 0.12, "anomaly_delta_score": 0.10, "baseline_adjusted_uplift": 0.10, "co_occurrence_density": 0.09,
    "engagement_avoidance": 0.10, "anomalous_co_occurrence_density": 0.07, "cross_side_cluster_score": 0.06, "anomalous_neighbor_density": 0.05, "bridge_score": 0.04, "pagerank_score": 0.03, "role_weight": 0.03,
}

_SUM = " + ".join(f"{w} * {c}" for c, w in V2.items())


@query("suspicion_v2", SIDES + f""", p AS (SELECT battle_id, character_id, min(system_id) AS system_id, max(CAST(ship_type_id % 10 = 0 AS INT)) AS logi, max(CAST(ship_type_id % 10 = 1 AS INT)) AS command, max(CAST(ship_type_id % 25 = 2 AS INT)) AS capital, max(ts) AS seen_at, first(side_key ORDER BY ts, event_id) AS side_key FROM b GROUP BY 1, 2),
bz AS (SELECT battle_id, CAST(sum(CAST(z AS DECIMAL(20,4))) AS DOUBLE) AS zs, count(*) AS zn FROM z GROUP BY 1), tot AS (SELECT sum(zs) AS ts, sum(zn) AS tn FROM bz),
o AS (SELECT p.*, coalesce(zs, 0) AS zs, coalesce(zn, 0) AS zn, coalesce(z.z, 0) AS own, coalesce(CAST(z.z IS NOT NULL AS INT), 0) AS has, CAST(coalesce(z.z, 0) > 2 AS INT) AS hs, CAST(coalesce(z.z, 0) < -1 AS INT) AS ls FROM p LEFT JOIN bz USING (battle_id) LEFT JOIN z ON z.battle_id = p.battle_id AND z.side_key = p.side_key),
f AS (SELECT character_id, count(*) AS battles, sum(hs) / count(*) AS hs, sum(ls) / count(*) AS ls, (count(DISTINCT side_key) - 1) / count(*) AS cross_side, least(1.0, sum(2 * logi + 2 * command + 3 * capital) / (3.0 * count(*))) AS role,
  CAST(sum(CAST(zs - own AS DECIMAL(20,4))) AS DOUBLE) AS os, sum(zn - has) AS onn, CAST(sum(CAST(zs AS DECIMAL(20,4))) AS DOUBLE) AS bs, sum(zn) AS bn,
  CAST(sum(CAST(CASE WHEN hs = 0 AND ls = 0 THEN own ELSE 0 END AS DECIMAL(20,4))) AS DOUBLE) AS ns, sum(CAST(hs = 0 AND ls = 0 AS INT)) AS nn FROM o GROUP BY 1),
up AS (SELECT *, CASE WHEN onn > 0 THEN os / onn ELSE 0 END - CASE WHEN tn - bn > 0 THEN (ts - bs) / (tn - bn) ELSE 0 END AS uplift, CASE WHEN nn > 0 THEN ns / nn ELSE 0 END AS expected FROM f, tot),
e2 AS (SELECT x.character_id AS a, y.character_id AS b, count(*) AS k, sum(greatest(x.hs, y.hs)) AS h, sum(CAST(x.side_key <> y.side_key AS INT)) AS c FROM o x JOIN o y ON x.battle_id = y.battle_id AND x.character_id <> y.character_id GROUP BY 1, 2),
n AS (SELECT a AS character_id, count(*) AS deg, sum(k) AS k, sum(h) AS h, sum(c) AS c, sum(CAST(up.hs > 0 AS INT)) AS bad, count(DISTINCT b % 12) AS groups FROM e2 JOIN up ON up.character_id = b GROUP BY 1),
md AS (SELECT sum(deg) / count(*) AS mean_deg FROM n), av AS (SELECT character_id, system_id, count(*) AS c FROM p GROUP BY 1, 2), ar AS (SELECT system_id, sum(c) / (SELECT sum(c) FROM av) AS rate FROM av GROUP BY 1),
aw AS (SELECT av.character_id, system_id, c / sum(c) OVER (PARTITION BY av.character_id) AS rate FROM av), ax AS (SELECT character_id, greatest(0, max(ar.rate - aw.rate)) AS avoid FROM aw JOIN ar USING (system_id) GROUP BY 1),
rc AS (SELECT character_id, sum(hs) / count(*) AS recent FROM o WHERE seen_at >= (SELECT max(seen_at) FROM o) - INTERVAL 7 DAY GROUP BY 1),
c AS (SELECT up.character_id, battles, coalesce(recent, 0) AS recent, hs AS high_sustain_frequency, cross_side AS cross_side_rate, greatest(0, least(1, (uplift + 1) / 2)) AS enemy_efficiency_uplift, greatest(0, least(1, (hs - ls + 1) / 2)) AS anomaly_delta_score, greatest(0, least(1, (uplift - expected + 1) / 2)) AS baseline_adjusted_uplift,
  least(1, coalesce(n.k / n.deg, 0) / 10.0) AS co_occurrence_density, least(1, coalesce(avoid, 0)) AS engagement_avoidance, least(1, coalesce(n.h / n.deg, 0) / 10.0) AS anomalous_co_occurrence_density, least(1, coalesce(n.c / n.deg, 0) / 5.0) AS cross_side_cluster_score, least(1, coalesce(n.bad / n.deg, 0) / 3.0) AS anomalous_neighbor_density,
  least(1, coalesce(n.groups, 0) / 10.0) AS bridge_score, least(1, coalesce(n.deg / mean_deg, 0) / 50.0) AS pagerank_score, role AS role_weight FROM up LEFT JOIN n USING (character_id) LEFT JOIN ax USING (character_id) LEFT JOIN rc USING (character_id), md),
sc AS (SELECT *, CASE WHEN battles >= 5 THEN greatest(0, least(1, {_SUM})) ELSE 0 END AS all_time FROM c)
SELECT character_id, battles, round(all_time, 4) AS all_time, round(greatest(0, least(1, all_time * 0.6 + recent * 0.4)), 4) AS recent, round(greatest(0, least(1, all_time * 0.6 + recent * 0.4)) - all_time, 4) AS momentum, {", ".join(f"round({c}, 4) AS {c}" for c in V2)} FROM sc""")
def suspicion_v2(spark: SparkSession, d: str, least: int = 5, recent_days: int = 7) -> DataFrame:
    """Thirteen weighted components over battles and the co-occurrence graph, all-time, recent and the difference.

    Stand-ins: neighbours by shared battles, groups by number mod 12, degree over its mean for the rank, systems for whom a pilot avoids.
    """
    z = G.cut(side_scores(spark, d).select("battle_id", "side_key", "z"))
    bz = z.groupBy("battle_id").agg(exact_sum(F.col("z")).alias("zs"), F.count(F.lit(1)).alias("zn"))
    tot = F.broadcast(bz.agg(F.sum("zs").alias("ts"), F.sum("zn").alias("tn")))  # one row
    seen = with_battle(V.event_stream(spark, d)).groupBy("battle_id", "character_id").agg(F.min("system_id").alias("system_id"), F.max("ts").alias("at"))
    o = actor_table(spark, d).join(seen, ["battle_id", "character_id"]).join(bz, "battle_id", "left").join(z, ["battle_id", "side_key"], "left")
    own = F.coalesce("z", F.lit(0.0))
    o = o.select(
        "battle_id", "character_id", "side_key", "system_id", "at", "logi", "command", "capital", F.coalesce("zs", F.lit(0.0)).alias("zs"), F.coalesce("zn", F.lit(0)).alias("zn"), own.alias("own"), F.col("z").isNotNull().cast("int").alias("has"),
        (own > 2).cast("int").alias("hs"), (own < -1).cast("int").alias("ls"),
    )
    o, n = G.cut(o), F.count(F.lit(1))
    usual = (F.col("hs") == 0) & (F.col("ls") == 0)
    f = o.groupBy("character_id").agg(
        n.alias("battles"), (F.sum("hs") / n).alias("hs"), (F.sum("ls") / n).alias("ls"), ((F.countDistinct("side_key") - 1) / n).alias("cross_side"), F.least(F.lit(1.0), F.sum(2 * F.col("logi") + 2 * F.col("command") + 3 * F.col("capital")) / (3.0 * n)).alias("role"),
        exact_sum(F.col("zs") - F.col("own")).alias("os"), F.sum(F.col("zn") - F.col("has")).alias("onn"), exact_sum(F.col("zs")).alias("bs"), F.sum("zn").alias("bn"), exact_sum(F.when(usual, F.col("own")).otherwise(0.0)).alias("ns"), F.sum(usual.cast("int")).alias("nn"),
    ).crossJoin(tot)
    f = f.withColumn("uplift", safe_div(F.col("os"), F.col("onn")) - safe_div(F.col("ts") - F.col("bs"), F.col("tn") - F.col("bn"))).withColumn("expected", safe_div(F.col("ns"), F.col("nn")))
    f = G.cut(f)
    seen = o.join(f.select("character_id", (F.col("hs") > 0).cast("int").alias("bad")), "character_id").select("system_id", "battle_id", "character_id", "side_key", "hs", "bad")
    met = met_pairs(seen, ["system_id"], ["battle_id"], "character_id").groupBy("meet", "a", "b")
    met = met.agg(n.alias("k"), F.sum(F.greatest("x.hs", "y.hs")).alias("h"), F.sum((F.col("x.side_key") != F.col("y.side_key")).cast("int")).alias("c"), F.max("x.bad").alias("xb"), F.max("y.bad").alias("yb"))
    both = F.explode(F.array(F.struct("a", "b", F.col("yb").alias("bad")), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), F.col("xb").alias("bad")))).alias("e")
    e = met.select(both, "k", "h", "c").select("e.*", "k", "h", "c")
    net = G.cut(e.groupBy(F.col("a").alias("character_id")).agg(n.alias("deg"), *(F.sum(c).alias(c) for c in ("k", "h", "c", "bad")), F.countDistinct(F.col("b") % 12).alias("groups")))
    mean = F.broadcast(net.agg((F.sum("deg") / F.count(F.lit(1))).alias("mean_deg")))  # one row
    av = o.groupBy("character_id", "system_id").agg(n.alias("c"))
    all_ = F.broadcast(av.agg(F.sum("c").alias("all_")))  # one row
    rate = av.groupBy("system_id").agg(F.sum("c").alias("s")).crossJoin(all_).select("system_id", (F.col("s") / F.col("all_")).alias("rate"))
    mine = av.withColumn("mine", F.col("c") / F.sum("c").over(Window.partitionBy("character_id"))).join(rate, "system_id")
    avoid = mine.groupBy("character_id").agg(F.greatest(F.lit(0.0), F.max(F.col("rate") - F.col("mine"))).alias("avoid"))
    last = F.broadcast(o.agg((F.max("at") - F.expr(f"INTERVAL {recent_days} DAYS")).alias("since")))  # one row
    recent = o.join(last, F.col("at") >= F.col("since")).groupBy("character_id").agg((F.sum("hs") / n).alias("recent"))
    j = f.join(net, "character_id", "left").join(avoid, "character_id", "left").join(recent, "character_id", "left").crossJoin(mean)
    each = lambda c: F.coalesce(F.col(c) / F.col("deg"), F.lit(0.0))
    upto = lambda c, top: F.least(F.lit(1.0), c / top)
    part = {
        "high_sustain_frequency": F.col("hs"), "cross_side_rate": F.col("cross_side"), "enemy_efficiency_uplift": clamp((F.col("uplift") + 1) / 2), "anomaly_delta_score": clamp((F.col("hs") - F.col("ls") + 1) / 2),
        "baseline_adjusted_uplift": clamp((F.col("uplift") - F.col("expected") + 1) / 2), "co_occurrence_density": upto(each("k"), 10.0), "engagement_avoidance": upto(F.coalesce("avoid", F.lit(0.0)), 1.0),
        "anomalous_co_occurrence_density": upto(each("h"), 10.0), "cross_side_cluster_score": upto(each("c"), 5.0), "anomalous_neighbor_density": upto(each("bad"), 3.0), "bridge_score": upto(F.coalesce("groups", F.lit(0)), 10.0),
        "pagerank_score": upto(F.coalesce(F.col("deg") / F.col("mean_deg"), F.lit(0.0)), 50.0), "role_weight": F.col("role"),
    }
    j = j.select("character_id", "battles", F.coalesce("recent", F.lit(0.0)).alias("recent"), *(v.alias(c) for c, v in part.items()))
    total = None
    for c, w in V2.items():
        total = w * F.col(c) if total is None else total + w * F.col(c)
    j = j.withColumn("all_time", F.when(F.col("battles") >= least, clamp(total)).otherwise(0.0)).withColumn("now", clamp(F.col("all_time") * 0.6 + F.col("recent") * 0.4))
    return j.select("character_id", "battles", rnd("all_time").alias("all_time"), rnd("now").alias("recent"), rnd(F.col("now") - F.col("all_time")).alias("momentum"), *(rnd(c).alias(c) for c in V2))
