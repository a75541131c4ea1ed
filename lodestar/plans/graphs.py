"""Graph queries over the co-supply graph, the part-supplier graph and the system graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.functions.kernels import cosine, rnd
from lodestar.operators import graph as G
from lodestar.operators.relational import met_pairs, pairs, top_k
from lodestar.plans.registry import query
from lodestar.sources import views as V

CS = V.ctes("cs") + ", e AS (SELECT a AS src, b AS dst FROM cs UNION ALL SELECT b, a FROM cs)"


def supply(spark: SparkSession, d: str) -> DataFrame:
    return G.cut(G.undirected(V.co_supply(spark, d)))


@query("degree", CS + " SELECT src AS node, count(*) AS degree FROM e GROUP BY 1")
def degree(spark: SparkSession, d: str) -> DataFrame:
    return G.degree(G.undirected(V.co_supply(spark, d)))


def _pagerank_sql(rounds: int) -> str:
    sql = CS + ", o AS (SELECT src, count(*) AS out FROM e GROUP BY 1), l AS (SELECT e.src, e.dst, out FROM e JOIN o USING (src)), n AS (SELECT DISTINCT src AS node FROM e), r0 AS (SELECT node, 1.0::DOUBLE AS rank FROM n)"
    for i in range(rounds):
        sql += f", r{i + 1} AS (SELECT n.node, 0.15 + 0.85 * coalesce(s, 0) AS rank FROM n LEFT JOIN (SELECT dst, sum(rank / out) AS s FROM l JOIN r{i} ON node = src GROUP BY 1) ON dst = node)"
    return sql + f" SELECT node, round(rank, 6) AS rank FROM r{rounds}"


@query("pagerank_k5", _pagerank_sql(5))
def pagerank_k5(spark: SparkSession, d: str) -> DataFrame:
    return G.pagerank(supply(spark, d), 5).select("node", rnd("rank", 6).alias("rank"))


def _lpa_sql(rounds: int) -> str:
    sql = CS + ", r0 AS (SELECT DISTINCT src AS node, src AS label FROM e)"
    for i in range(rounds):
        sql += f", r{i + 1} AS (SELECT src AS node, label FROM (SELECT src, label, count(*) AS v FROM e JOIN r{i} ON node = dst GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY src ORDER BY v DESC, label) = 1)"
    return sql + f" SELECT node, label FROM r{rounds}"


@query("label_propagation_k3", _lpa_sql(3))
def label_propagation_k3(spark: SparkSession, d: str) -> DataFrame:
    return G.label_propagation(supply(spark, d), 3)


def _hits_sql(rounds: int) -> str:
    sql = CS + ", h0 AS (SELECT DISTINCT src AS node, 1.0::DOUBLE AS hub FROM e)"
    for i in range(rounds):
        sql += f", x{i + 1} AS (SELECT dst AS node, sum(hub) AS a FROM e JOIN h{i} ON node = src GROUP BY 1), a{i + 1} AS (SELECT node, a / sqrt(sum(a * a) OVER ()) AS auth FROM x{i + 1})"
        sql += f", y{i + 1} AS (SELECT src AS node, sum(auth) AS h FROM e JOIN a{i + 1} ON node = dst GROUP BY 1), h{i + 1} AS (SELECT node, h / sqrt(sum(h * h) OVER ()) AS hub FROM y{i + 1})"
    return sql + f" SELECT node, round(hub, 6) AS hub, round(auth, 6) AS auth FROM h{rounds} JOIN a{rounds} USING (node)"


@query("hits_k3", _hits_sql(3))
def hits_k3(spark: SparkSession, d: str) -> DataFrame:
    return G.hits(supply(spark, d), 3).select("node", rnd("hub", 6).alias("hub"), rnd("auth", 6).alias("auth"))


@query("k_core_5", CS.replace("WITH", "WITH RECURSIVE", 1) + """, r AS (SELECT 0 AS round_no, src, dst FROM e
UNION ALL SELECT round_no + 1, src, dst FROM (SELECT *, count(*) OVER (PARTITION BY src) AS x, count(*) OVER (PARTITION BY dst) AS y FROM r) WHERE x >= 5 AND y >= 5 AND round_no < 40)
SELECT DISTINCT src AS node FROM r WHERE round_no = 40""")  # fmt: skip
def k_core_5(spark: SparkSession, d: str) -> DataFrame:
    return G.k_core(supply(spark, d), 5)


@query("components", """WITH RECURSIVE cs AS (SELECT a, b FROM (WITH p AS (SELECT DISTINCT l_suppkey AS s, l_partkey AS p FROM lineitem) SELECT x.s AS a, y.s AS b, count(*) AS n FROM p x JOIN p y ON x.p = y.p AND x.s < y.s GROUP BY 1, 2) WHERE n >= 150),
e AS (SELECT a AS src, b AS dst FROM cs UNION ALL SELECT b, a FROM cs), r(node, reach) AS (SELECT DISTINCT src, src FROM e UNION SELECT r.node, e.dst FROM r JOIN e ON e.src = r.reach) SELECT node, min(reach) AS component FROM r GROUP BY 1""")  # fmt: skip
def components(spark: SparkSession, d: str) -> DataFrame:
    return G.components(supply(spark, d))


@query("common_neighbors", CS + """, g AS (SELECT src, count(*) AS d FROM e GROUP BY 1), c AS (SELECT x.src AS a, y.dst AS b, count(*) AS common FROM e x JOIN e y ON x.dst = y.src AND x.src < y.dst GROUP BY 1, 2 HAVING count(*) >= 2)
SELECT c.a, c.b, common, round(common / (p.d + q.d - common), 6) AS jaccard, p.d * q.d AS attachment FROM c JOIN g p ON p.src = c.a JOIN g q ON q.src = c.b WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.src = c.a AND e.dst = c.b)""")  # fmt: skip
def common_neighbors(spark: SparkSession, d: str) -> DataFrame:
    return G.common_neighbours(supply(spark, d)).withColumn("jaccard", rnd("jaccard", 6))


@query("triangles", CS + " SELECT x.a, x.b, y.b AS c FROM cs x JOIN cs y ON x.b = y.a JOIN cs z ON z.a = x.a AND z.b = y.b")
def triangles(spark: SparkSession, d: str) -> DataFrame:
    return G.triangles(supply(spark, d))


@query("chains", CS + """ SELECT x.a AS a, x.b AS b, y.b AS c, z.b AS d FROM cs x JOIN cs y ON x.b = y.a JOIN cs z ON y.b = z.a WHERE NOT EXISTS (SELECT 1 FROM cs s WHERE s.a = x.a AND s.b = y.b)
AND NOT EXISTS (SELECT 1 FROM cs s WHERE s.a = x.a AND s.b = z.b) AND NOT EXISTS (SELECT 1 FROM cs s WHERE s.a = x.b AND s.b = z.b)""")  # fmt: skip
def chains(spark: SparkSession, d: str) -> DataFrame:
    return G.chains(supply(spark, d))


@query("stars", CS + """, t AS (SELECT DISTINCT x.src AS centre, x.dst AS leaf FROM e x JOIN e y ON y.src = x.dst JOIN e z ON z.src = x.src AND z.dst = y.dst)
SELECT src AS centre, count(*) AS leaves FROM e WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.centre = e.src AND t.leaf = e.dst) AND src IN (SELECT src FROM e GROUP BY 1 HAVING count(*) >= 4) GROUP BY 1 HAVING count(*) >= 4""")  # fmt: skip
def stars(spark: SparkSession, d: str) -> DataFrame:
    return G.stars(supply(spark, d))


@query("shortest_hops", V.ctes("sg").replace("WITH ", "WITH RECURSIVE ", 1) + ", r(source, node, h) AS (SELECT DISTINCT src, src, 0 FROM sg UNION SELECT source, dst, h + 1 FROM r JOIN sg ON src = node WHERE h < 5) SELECT source, node, CAST(min(h) AS INTEGER) AS hops FROM r GROUP BY 1, 2")
def shortest_hops(spark: SparkSession, d: str) -> DataFrame:
    e = G.cut(V.system_graph(spark, d))
    return G.hops(e, e.select(F.col("src").alias("source")).distinct(), 5)


@query("map_betweenness", V.ctes("sg").replace("WITH", "WITH RECURSIVE", 1) + """, w AS (SELECT 0 AS d, src AS s, src AS t, CAST(1 AS DOUBLE) AS n FROM (SELECT DISTINCT src FROM sg)
UNION ALL SELECT d + 1, s, dst, sum(n) FROM w JOIN sg ON t = src WHERE d < 12 GROUP BY d + 1, s, dst),
p AS (SELECT s, t, min(d) AS d, min_by(n, d) AS n FROM w GROUP BY 1, 2),
b AS (SELECT a.t AS node, sum(CASE WHEN a.s <> a.t AND b.s <> b.t THEN a.n * b.n / p.n ELSE 0 END) AS score FROM p a JOIN p b ON a.t = b.s JOIN p ON p.s = a.s AND p.t = b.t AND p.d = a.d + b.d GROUP BY 1)
SELECT node, round(score / 2, 6) AS betweenness FROM b""")  # fmt: skip
def map_betweenness(spark: SparkSession, d: str) -> DataFrame:
    """Betweenness of the systems from every source (each pair counted from both ends, so halved)."""
    e = V.system_graph(spark, d)
    b = G.betweenness(e, e.select(F.col("src").alias("source")).distinct())
    return b.select("node", rnd(F.col("score") / 2, 6).alias("betweenness"))


@query("bridges_and_cuts", CS.replace("WITH", "WITH RECURSIVE", 1) + """, br(a, b, node) AS (SELECT src, dst, src FROM e WHERE src < dst
UNION SELECT a, b, e.dst FROM br JOIN e ON e.src = node WHERE NOT (e.src = a AND e.dst = b)),
v AS (SELECT src AS cut, min(dst) AS start FROM e GROUP BY 1), ar(cut, node) AS (SELECT cut, start FROM v UNION SELECT cut, e.dst FROM ar JOIN e ON e.src = node WHERE e.dst <> cut)
SELECT 'bridge' AS kind, src AS a, dst AS b FROM e WHERE src < dst AND NOT EXISTS (SELECT 1 FROM br WHERE br.a = src AND br.b = dst AND node = dst)
UNION ALL SELECT DISTINCT 'articulation', src, NULL FROM e WHERE NOT EXISTS (SELECT 1 FROM ar WHERE cut = src AND node = dst)""")  # fmt: skip
def bridges_and_cuts(spark: SparkSession, d: str) -> DataFrame:
    e = supply(spark, d)
    return G.bridges(e, G.components(e))


@query("typed_interactions", V.ctes("km", "ka") + """, a AS (SELECT DISTINCT sequence_id, character_id, max(final_blow) OVER (PARTITION BY sequence_id, character_id) AS fb FROM ka),
c AS (SELECT character_id AS src, victim_character_id AS dst, CASE WHEN fb THEN 'DIRECT_COMBAT' ELSE 'ASSISTED_KILL' END AS type FROM a JOIN km USING (sequence_id))
SELECT type, src, dst, count(*) AS n FROM c GROUP BY 1, 2, 3 UNION ALL SELECT 'SAME_FLEET', x.character_id, y.character_id, count(*) FROM a x JOIN a y ON x.sequence_id = y.sequence_id AND x.character_id < y.character_id GROUP BY 1, 2, 3 HAVING count(*) >= 3""")  # fmt: skip
def typed_interactions(spark: SparkSession, d: str) -> DataFrame:
    """Attacker to victim by role, and pairs that attacked together three times or more."""
    a = V.attackers(spark, d).groupBy("sequence_id", "character_id").agg(F.max("final_blow").alias("fb"))
    km = V.killmails(spark, d).select("sequence_id", "victim_character_id")
    c = a.join(km, "sequence_id").groupBy(F.when(F.col("fb"), "DIRECT_COMBAT").otherwise("ASSISTED_KILL").alias("type"), F.col("character_id").alias("src"), F.col("victim_character_id").alias("dst")).agg(F.count(F.lit(1)).alias("n"))
    f = pairs(a, ["sequence_id"], "character_id").groupBy(F.lit("SAME_FLEET").alias("type"), F.col("a").alias("src"), F.col("b").alias("dst")).agg(F.count(F.lit(1)).alias("n")).where("n >= 3")
    return c.union(f)


@query("co_occurrence_edges", V.ctes("es") + """, c AS (SELECT system_id, CAST(ts AS DATE) AS day, character_id, min(side_key) AS side FROM es GROUP BY 1, 2, 3), t AS (SELECT max(CAST(ts AS DATE)) AS m FROM es)
SELECT x.character_id AS a, y.character_id AS b, count(*) AS total, count(CASE WHEN x.day >= m - 7 THEN 1 END) AS recent, count(CASE WHEN x.side <> y.side THEN 1 END) AS crossed, 2 * count(CASE WHEN x.day >= m - 7 THEN 1 END) + count(*) AS weight
FROM c x JOIN c y ON x.system_id = y.system_id AND x.day = y.day AND x.character_id < y.character_id, t GROUP BY 1, 2 HAVING count(*) >= 2""")  # fmt: skip
def co_occurrence_edges(spark: SparkSession, d: str) -> DataFrame:
    """Pairs in one battle: total, recent and crossed-sides counts with the derived weight, pruned under two."""
    es = V.event_stream(spark, d)
    c = es.groupBy("system_id", F.to_date("ts").alias("day"), "character_id").agg(F.min("side_key").alias("side"))
    t = F.broadcast(es.agg(F.max(F.to_date("ts")).alias("m")))
    p = met_pairs(c.withColumn("on", F.col("day")), ["system_id"], ["day"], "character_id").crossJoin(t)
    recent = F.count(F.when(F.col("x.on") >= F.date_sub("m", 7), 1))
    g = p.groupBy("meet", "a", "b").agg(F.count(F.lit(1)).alias("total"), recent.alias("recent"), F.count(F.when(F.col("x.side") != F.col("y.side"), 1)).alias("crossed"), (2 * recent + F.count(F.lit(1))).alias("weight"))
    return g.where("total >= 2").drop("meet")


@query("graph_quality", CS + """, g AS (SELECT count(*) AS edges, count(DISTINCT (src, dst)) AS uniq, count(CASE WHEN src = dst THEN 1 END) AS loops FROM e), n AS (SELECT count(*) AS nodes, count(CASE WHEN s_suppkey NOT IN (SELECT src FROM e) THEN 1 END) AS orphans FROM supplier)
SELECT edges, edges - uniq AS duplicates, loops, nodes, orphans, round(1 - 0.5 * (edges - uniq) / edges - 0.5 * orphans / nodes, 6) AS score FROM g, n""")  # fmt: skip
def graph_quality(spark: SparkSession, d: str) -> DataFrame:
    e = supply(spark, d)
    g = e.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("c")).agg(F.coalesce(F.sum("c"), F.lit(0)).alias("edges"), F.count(F.lit(1)).alias("u"), F.coalesce(F.sum(F.when(F.col("src") == F.col("dst"), F.col("c"))), F.lit(0)).alias("loops"))
    s = V.read(spark, d, "supplier").select(F.col("s_suppkey").alias("src"))
    n = s.join(e.select("src").distinct().withColumn("has", F.lit(1)), "src", "left").agg(F.count(F.lit(1)).alias("nodes"), F.count(F.when(F.col("has").isNull(), 1)).alias("orphans"))
    dup = F.col("edges") - F.col("u")
    share = lambda x, of: F.when(F.col(of) == 0, float("nan")).otherwise(0.5 * x / F.nullif(F.col(of), F.lit(0)))  # noqa: E731  nothing of nothing has no score, as in SQL
    score = 1 - share(dup, "edges") - share(F.col("orphans"), "nodes")
    return g.crossJoin(n).select("edges", dup.alias("duplicates"), "loops", "nodes", "orphans", F.when(F.isnan(score), score).otherwise(rnd(score, 6)).alias("score"))  # one row each


@query("node_windows", V.ctes("es") + """, t AS (SELECT max(ts) AS m FROM es) SELECT character_id AS node, count(CASE WHEN ts >= m - INTERVAL 7 DAY THEN 1 END) AS n7, count(CASE WHEN ts >= m - INTERVAL 14 DAY THEN 1 END) AS n14, count(*) AS n30, count(DISTINCT CASE WHEN ts >= m - INTERVAL 7 DAY THEN system_id END) AS s7 FROM es, t GROUP BY 1""")
def node_windows(spark: SparkSession, d: str) -> DataFrame:
    es = V.event_stream(spark, d)
    t = F.broadcast(es.agg(F.max("ts").alias("m")))
    last = lambda n: F.col("ts") >= F.col("m") - F.expr(f"INTERVAL {n} DAYS")
    return es.crossJoin(t).groupBy(F.col("character_id").alias("node")).agg(F.count(F.when(last(7), 1)).alias("n7"), F.count(F.when(last(14), 1)).alias("n14"), F.count(F.lit(1)).alias("n30"), F.countDistinct(F.when(last(7), F.col("system_id"))).alias("s7"))


@query("engagement_avoidance", V.ctes("km", "ka") + """, k AS (SELECT DISTINCT sequence_id, alliance_id FROM ka), v AS (SELECT alliance_id, victim_alliance_id AS v, count(*) AS n FROM k JOIN km USING (sequence_id) GROUP BY 1, 2),
o AS (SELECT v, sum(n) / (SELECT sum(n) FROM v) AS rate FROM v GROUP BY 1), a AS (SELECT alliance_id, v, n / sum(n) OVER (PARTITION BY alliance_id) AS rate FROM v)
SELECT alliance_id, round(max(o.rate - a.rate), 6) AS avoidance, arg_min(a.v, (a.rate - o.rate, a.v)) AS most_avoided FROM a JOIN o USING (v) GROUP BY 1""")  # fmt: skip
def engagement_avoidance(spark: SparkSession, d: str) -> DataFrame:
    """How far an alliance's rate of fighting another falls short of the overall rate, at most."""
    k = V.attackers(spark, d).select("sequence_id", "alliance_id").distinct().join(V.killmails(spark, d).select("sequence_id", F.col("victim_alliance_id").alias("v")), "sequence_id")
    n = k.groupBy("alliance_id", "v").agg(F.count(F.lit(1)).alias("n"))
    own = n.withColumn("rate", F.col("n") / F.sum("n").over(Window.partitionBy("alliance_id")))
    tot = F.broadcast(n.agg(F.sum("n").alias("t")))
    o = n.groupBy("v").agg(F.sum("n").alias("s")).crossJoin(tot).select("v", (F.col("s") / F.col("t")).alias("o_rate"))
    j = own.join(o, "v")
    return j.groupBy("alliance_id").agg(rnd(F.max(F.col("o_rate") - F.col("rate")), 6).alias("avoidance"), F.min_by("v", F.struct(F.col("rate") - F.col("o_rate"), F.col("v"))).alias("most_avoided"))


@query("role_signals", CS + """, d AS (SELECT src AS node, count(*) AS degree FROM e GROUP BY 1), r AS (SELECT *, (rank() OVER (ORDER BY degree) - 1) / count(*) OVER () AS pr FROM d)
SELECT node, degree, round(pr, 6) AS pct, CASE WHEN pr >= 0.9 THEN 'coordinator' WHEN pr >= 0.8 THEN 'core_line' WHEN degree <= 3 THEN 'periphery' ELSE 'regular' END AS role FROM r""")  # fmt: skip
def role_signals(spark: SparkSession, d: str) -> DataFrame:
    """Roles from percentile ranks; ranks of a degree come from counts of degrees."""
    deg = G.degree(supply(spark, d))
    c = deg.groupBy("degree").agg(F.count(F.lit(1)).alias("c"))
    w = Window.orderBy("degree")  # one row for each distinct degree
    c = c.select("degree", ((F.sum("c").over(w) - F.col("c")) / F.sum("c").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("pr"))
    role = F.when(F.col("pr") >= 0.9, "coordinator").when(F.col("pr") >= 0.8, "core_line").when(F.col("degree") <= 3, "periphery").otherwise("regular")
    return deg.join(c, "degree").select("node", "degree", rnd("pr", 6).alias("pct"), role.alias("role"))


@query("evidence_paths", V.ctes("sg").replace("WITH", "WITH RECURSIVE", 1) + """, w AS (SELECT src, dst, CASE WHEN (src - dst) % 5 = 0 THEN CAST(0.80 AS DOUBLE) ELSE CAST(0.90 AS DOUBLE) END AS w FROM sg),
p AS (SELECT src AS source, [src, dst] AS path, w AS score, 1 AS hops FROM w WHERE src % 7 <> 0
UNION ALL SELECT source, list_append(path, dst), score * w, hops + 1 FROM p JOIN w ON path[-1] = src WHERE NOT list_contains(path, dst) AND hops < 4),
h AS (SELECT * FROM p WHERE path[-1] % 7 = 0 QUALIFY row_number() OVER (PARTITION BY source ORDER BY hops, score DESC, path) = 1)
SELECT source, array_to_string(path, '-') AS path, round(score, 6) AS score, hops FROM h""")  # fmt: skip
def evidence_paths(spark: SparkSession, d: str) -> DataFrame:
    """Best shortest path of each system to a flagged one, scored by the product of edge weights."""
    sg = V.system_graph(spark, d)
    e = G.cut(sg.withColumn("w", F.when((F.col("src") - F.col("dst")) % 5 == 0, 0.80).otherwise(0.90)))
    n = e.select(F.col("src").alias("source")).distinct()
    p = G.evidence_paths(e, n.where("source % 7 <> 0"), n.where("source % 7 = 0").select(F.col("source").alias("target")))
    return p.select("source", F.array_join(F.col("path").cast("array<string>"), "-").alias("path"), rnd("score", 6).alias("score"), "hops")


@query("centroid_anomaly", """WITH x AS (SELECT vec_id, label, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings), c AS (SELECT label, i, avg(v::DOUBLE) AS m FROM x GROUP BY 1, 2),
d AS (SELECT vec_id, label, sum(v::DOUBLE * m) / (sqrt(sum(v::DOUBLE * v)) * sqrt(sum(m * m))) AS cos FROM x JOIN c USING (label, i) GROUP BY 1, 2) SELECT vec_id, label, round(1 - cos, 4) AS distance FROM d""")  # fmt: skip
def centroid_anomaly(spark: SparkSession, d: str) -> DataFrame:
    """Cosine distance of a vector from the centroid of its label (sums by label and component, partial in the tasks)."""
    e = V.read(spark, d, "embeddings").select("vec_id", "label", "embedding")
    c = e.select("label", F.posexplode("embedding").alias("i", "v")).groupBy("label", "i").agg(F.avg(F.col("v").cast("double")).alias("m"))
    c = c.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "m"))).alias("z")).select("label", F.transform("z", lambda s: s["m"]).alias("centroid"))
    return e.join(c, "label").select("vec_id", "label", rnd(1 - cosine(F.col("embedding"), F.col("centroid"))).alias("distance"))


@query("embedding_topk_similarity", """WITH q AS (SELECT vec_id AS q, embedding::DOUBLE[] AS a FROM embeddings WHERE vec_id % 100 = 0), s AS (SELECT q, vec_id, list_cosine_similarity(a, embedding::DOUBLE[]) AS s FROM q, embeddings WHERE vec_id <> q)
SELECT q AS query_id, vec_id, round(s, 6) AS similarity, CAST(row_number() OVER (PARTITION BY q ORDER BY s DESC, vec_id) AS INTEGER) AS rn FROM s QUALIFY rn <= 5""")  # fmt: skip
def embedding_topk_similarity(spark: SparkSession, d: str, blocks: int = 64) -> DataFrame:
    """Exact most similar vectors of a fixed query set, against all rows: the set meets the rows block by block, and each block sends on its best."""
    e = V.read(spark, d, "embeddings").select("vec_id", "embedding")
    q = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("a"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    rows = e.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"))
    s = rows.join(q, "block").where("vec_id <> query_id").select("query_id", "vec_id", cosine(F.col("a"), F.col("embedding")).alias("s"))
    return top_k(s, ["query_id"], [F.desc("s"), "vec_id"], 5).select("query_id", "vec_id", rnd("s", 6).alias("similarity"), "rn")
