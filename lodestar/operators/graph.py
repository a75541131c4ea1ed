"""Graph operators over edge DataFrames (src, dst[, w]). Undirected graphs hold both directions.

Iterations are fixed or end when nothing changes; each cuts its lineage by checkpoint() into the folder of spark.checkpoint.dir, so a
lost executor costs one round.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.operators.relational import top_k

_OWN: list[tempfile.TemporaryDirectory] = []


def is_local(spark) -> bool:
    """Whether driver and executors are one process, so that a folder of the driver is one of all."""
    return spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")


def cut(df: DataFrame) -> DataFrame:
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        path = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not path:  # tests and local runs only
            if not is_local(df.sparkSession):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            _OWN.append(tempfile.TemporaryDirectory(prefix="lodestar-"))
            path = _OWN[-1].name
        sc.setCheckpointDir(path)
    return df.checkpoint()


def undirected(e: DataFrame, a: str = "a", b: str = "b", *rest: str) -> DataFrame:
    return e.select(F.col(a).alias("src"), F.col(b).alias("dst"), *rest).union(e.select(F.col(b).alias("src"), F.col(a).alias("dst"), *rest))


def degree(e: DataFrame) -> DataFrame:
    return e.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("degree"))


def pagerank(e: DataFrame, rounds: int, damping: float = 0.85) -> DataFrame:
    """Unnormalised power iteration (1 - d) + d * sum(rank / out-degree); nodes without in-edges keep 1 - d."""
    out = e.groupBy("src").agg(F.count(F.lit(1)).alias("out"))
    links = cut(e.join(out, "src").select("src", "dst", "out"))
    nodes = cut(e.select(F.col("src").alias("node")).union(e.select("dst")).distinct())
    r = nodes.withColumn("rank", F.lit(1.0))
    for i in range(rounds):
        got = links.join(r, links.src == r.node).groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("rank") / F.col("out")).alias("s"))
        r = nodes.join(got, "node", "left").select("node", (1 - damping + damping * F.coalesce("s", F.lit(0.0))).alias("rank"))
        if i % 4 == 3:
            r = cut(r)
    return r


def label_propagation(e: DataFrame, rounds: int) -> DataFrame:
    """Synchronous: each node takes the heaviest label around it, the smallest of equals."""
    e = cut(e.select("src", "dst", F.col("w") if "w" in e.columns else F.lit(1.0).alias("w")))
    lab = e.select(F.col("src").alias("node")).distinct().withColumn("label", F.col("node"))
    for i in range(rounds):
        votes = e.join(lab, e.dst == lab.node).groupBy("src", "label").agg(F.sum("w").alias("v"))
        lab = top_k(votes, ["src"], [F.desc("v"), "label"], 1).select(F.col("src").alias("node"), "label")
        if i % 3 == 2:
            lab = cut(lab)
    return lab


def hits(e: DataFrame, rounds: int) -> DataFrame:
    """Hubs and authorities, each scaled to length 1 a round."""
    nodes = cut(e.select(F.col("src").alias("node")).union(e.select("dst")).distinct())
    r = nodes.withColumn("hub", F.lit(1.0))

    def scaled(df: DataFrame, c: str) -> DataFrame:
        n = F.broadcast(df.agg(F.sqrt(F.sum(F.col(c) * F.col(c))).alias("_n")))
        return df.crossJoin(n).select("node", (F.col(c) / F.col("_n")).alias(c))  # one row

    auth = None
    for _ in range(rounds):
        auth = scaled(e.join(r, e.src == r.node).groupBy(F.col("dst").alias("node")).agg(F.sum("hub").alias("auth")), "auth")
        r = cut(scaled(e.join(auth, e.dst == auth.node).groupBy(F.col("src").alias("node")).agg(F.sum("auth").alias("hub")), "hub"))
    return nodes.join(r, "node", "left").join(auth, "node", "left").select("node", F.coalesce("hub", F.lit(0.0)).alias("hub"), F.coalesce("auth", F.lit(0.0)).alias("auth"))


def k_core(e: DataFrame, k: int) -> DataFrame:
    """Nodes left when those of degree under k go, again and again."""
    e, n = cut(e.select("src", "dst").distinct()), -1
    while (m := e.count()) != n:
        n = m
        keep = e.groupBy("src").agg(F.count(F.lit(1)).alias("d")).where(F.col("d") >= k).select("src")
        e = cut(e.join(keep, "src", "left_semi").join(keep.withColumnRenamed("src", "dst"), "dst", "left_semi").select("src", "dst"))
    return e.select(F.col("src").alias("node")).distinct()


def core_numbers(e: DataFrame, most: int) -> DataFrame:
    """The largest k up to `most` whose core a node is in."""
    out, e = degree(e).select("node", F.lit(0).alias("core")), cut(e)
    for k in range(1, most + 1):
        core = k_core(e, k).withColumn("_in", F.lit(k))
        out = cut(out.join(core, "node", "left").select("node", F.coalesce("_in", "core").alias("core")))
        e = e.join(core.select(F.col("node").alias("src")), "src", "left_semi").join(core.select(F.col("node").alias("dst")), "dst", "left_semi")
    return out


def hops(e: DataFrame, sources: DataFrame, most: int) -> DataFrame:
    """Fewest steps from each source (column source) to each node, up to `most`: frontier expansion."""
    found = sources.select("source", F.col("source").alias("node")).withColumn("hops", F.lit(0))
    front = found
    for k in range(1, most + 1):
        step = front.join(e, front.node == e.src).select("source", F.col("dst").alias("node")).distinct()
        front = step.join(found.select("source", "node"), ["source", "node"], "left_anti").withColumn("hops", F.lit(k))
        found = found.union(front)
        if k % 2 == 0:
            found, front = cut(found), cut(front)
    return found


def common_neighbours(e: DataFrame, least: int = 2) -> DataFrame:
    """Pairs a < b that are not adjacent and have common neighbours: count, Jaccard and preferential attachment."""
    deg = degree(e)
    two = e.select(F.col("src").alias("a"), F.col("dst").alias("m")).join(e.select(F.col("src").alias("m"), F.col("dst").alias("b")), "m").where("a < b")
    cn = two.groupBy("a", "b").agg(F.count(F.lit(1)).alias("common")).where(F.col("common") >= least)
    cn = cn.join(e.select(F.col("src").alias("a"), F.col("dst").alias("b")), ["a", "b"], "left_anti")
    j = cn.join(deg.select(F.col("node").alias("a"), F.col("degree").alias("da")), "a").join(deg.select(F.col("node").alias("b"), F.col("degree").alias("db")), "b")
    return j.select("a", "b", "common", (F.col("common") / (F.col("da") + F.col("db") - F.col("common"))).alias("jaccard"), (F.col("da") * F.col("db")).alias("attachment"))


def oriented(e: DataFrame) -> DataFrame:
    """Each undirected edge once, from the end of smaller (degree, id): keeps the fan-out of hubs bounded in motif joins."""
    deg = degree(e)
    j = e.join(deg.select(F.col("node").alias("src"), F.col("degree").alias("ds")), "src").join(deg.select(F.col("node").alias("dst"), F.col("degree").alias("dd")), "dst")
    return j.where(F.struct("ds", "src") < F.struct("dd", "dst")).select("src", "dst")


def triangles(e: DataFrame) -> DataFrame:
    """Triangles a < b < c, once each, over degree-oriented edges."""
    o = cut(oriented(e))
    wedge = o.select(F.col("src").alias("x"), F.col("dst").alias("y")).join(o.select(F.col("src").alias("x"), F.col("dst").alias("z")), "x").where("y < z")
    closed = e.select(F.col("src").alias("y"), F.col("dst").alias("z"))
    t = wedge.join(closed, ["y", "z"])
    s = F.array_sort(F.array("x", "y", "z"))
    return t.select(s[0].alias("a"), s[1].alias("b"), s[2].alias("c"))


def chains(e: DataFrame) -> DataFrame:
    """Chains a < b < c < d without shortcuts."""
    up = e.where("src < dst")
    p = up.select(F.col("src").alias("a"), F.col("dst").alias("b")).join(up.select(F.col("src").alias("b"), F.col("dst").alias("c")), "b")
    p = p.join(up.select(F.col("src").alias("a"), F.col("dst").alias("c")), ["a", "c"], "left_anti")
    p = p.join(up.select(F.col("src").alias("c"), F.col("dst").alias("d")), "c")
    for x in ("a", "b"):
        p = p.join(up.select(F.col("src").alias(x), F.col("dst").alias("d")), [x, "d"], "left_anti")
    return p.select("a", "b", "c", "d")


def stars(e: DataFrame, leaves: int = 4) -> DataFrame:
    """Centres with at least `leaves` neighbours no two of which are adjacent."""
    deg = degree(e).where(F.col("degree") >= leaves)
    c = e.join(deg, e.src == deg.node).select(F.col("src").alias("centre"), F.col("dst").alias("leaf"))
    joined = c.select("centre", F.col("leaf").alias("x")).join(e.select(F.col("src").alias("x"), F.col("dst").alias("y")), "x").join(c.select("centre", F.col("leaf").alias("y")), ["centre", "y"])
    tied = joined.select("centre", F.col("x").alias("leaf")).distinct()
    free = c.join(tied, ["centre", "leaf"], "left_anti")
    return free.groupBy("centre").agg(F.count(F.lit(1)).alias("leaves")).where(F.col("leaves") >= leaves)


def betweenness(e: DataFrame, sources: DataFrame) -> DataFrame:
    """Dependencies of the nodes on shortest paths from the given sources, level by level for all sources at once.

    Forward, a level's path counts go along the edges to nodes not reached before; backward, a level's dependencies go to the level
    before by the share of paths. Every step is a join, so no task holds the graph.
    """
    e = cut(e.select("src", "dst").distinct())
    front = sources.select("source", F.col("source").alias("node"), F.lit(1.0).alias("paths")).distinct()
    seen, levels = front.select("source", "node"), [cut(front)]
    while True:
        step = levels[-1].join(e, F.col("node") == F.col("src")).groupBy("source", F.col("dst").alias("node")).agg(F.sum("paths").alias("paths"))
        front = cut(step.join(seen, ["source", "node"], "left_anti"))
        if front.isEmpty():
            break
        levels.append(front)
        seen = cut(seen.union(front.select("source", "node")))
    total, after = [], levels[-1].withColumn("on", F.lit(0.0))
    for level in reversed(levels[:-1]):
        total.append(after.select("node", "on"))
        share = after.select("source", F.col("node").alias("dst"), ((1 + F.col("on")) / F.col("paths")).alias("share"))
        back = level.join(e, F.col("node") == F.col("src")).join(share, ["source", "dst"]).groupBy("source", "node").agg(F.sum(F.col("paths") * F.col("share")).alias("on"))
        after = cut(level.join(back, ["source", "node"], "left").select("source", "node", "paths", F.coalesce("on", F.lit(0.0)).alias("on")))
    out = after.select("node", F.lit(0.0).alias("on"))  # a source is no node between
    for t in total:
        out = out.union(t)
    return out.groupBy("node").agg(F.sum("on").alias("score"))


def bridges(e: DataFrame, component: DataFrame, edges_most: int = 2_000_000) -> DataFrame:
    """Bridge edges (a < b) and articulation points by component (node, component): one group each, refused past edges_most edges."""
    from lodestar.operators.graph_local import low_links

    j = e.where("src < dst").join(component.withColumnRenamed("node", "src"), "src").select("component", "src", "dst")
    large = j.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > edges_most).limit(1).count()
    if large:
        raise ValueError(f"a component has more than {edges_most} edges")

    def run(pdf):
        import pandas as pd

        br, art = low_links(list(zip(pdf.src, pdf.dst)))
        return pd.DataFrame([("bridge", a, b) for a, b in br] + [("articulation", v, None) for v in art], columns=["kind", "a", "b"]).astype({"a": "Int64", "b": "Int64"})

    return j.groupBy("component").applyInPandas(run, "kind string, a long, b long")


def components(e: DataFrame, most: int = 100) -> DataFrame:
    """Smallest node reachable, by label doubling: labels go to neighbours, then to the label of the label, until nothing changes."""
    lab = cut(e.select(F.col("src").alias("node")).distinct().withColumn("component", F.col("node")))
    for _ in range(most):
        near = e.join(lab.withColumnRenamed("node", "dst"), "dst").groupBy(F.col("src").alias("node")).agg(F.min("component").alias("m"))
        new = lab.join(near, "node", "left").select("node", F.least("component", "m").alias("component"))
        jump = new.select(F.col("node").alias("component"), F.col("component").alias("up"))
        new = cut(new.join(jump, "component", "left").select("node", F.coalesce("up", "component").alias("component")))
        changed = new.join(lab.withColumnRenamed("component", "was"), "node").where("component <> was").limit(1).count()
        lab = new
        if not changed:
            return lab
    raise RuntimeError("labels did not settle")


def fast_rp(e: DataFrame, dims: int = 64, weights=(0.0, 1.0, 1.0, 0.8, 0.4), seed: int = 42) -> DataFrame:
    """Random projection embeddings: hash-seeded signs averaged over neighbourhoods, weighted by distance."""
    nodes = e.select(F.col("src").alias("node")).distinct()
    third = lambda i: F.pmod(F.xxhash64(F.col("node"), F.lit(i), F.lit(seed)), F.lit(6))
    v = nodes.select("node", F.array(*[F.when(third(i) == 0, 3**0.5).when(third(i) == 1, -(3**0.5)).otherwise(0.0) for i in range(dims)]).alias("v"))
    total = None
    for w in weights:
        part = v.select("node", F.transform("v", lambda x, w=w: x * w).alias("t"))
        total = part if total is None else total.join(part.withColumnRenamed("t", "u"), "node").select("node", F.zip_with("t", "u", lambda a, b: a + b).alias("t"))
        flat = e.join(v.withColumnRenamed("node", "dst"), "dst").select("src", F.posexplode("v").alias("i", "x"))
        means = flat.groupBy("src", "i").agg(F.avg("x").alias("x")).groupBy("src").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("z"))
        v = cut(means.select(F.col("src").alias("node"), F.transform("z", lambda s: s["x"]).alias("v")))
        total = cut(total)
    return total.select("node", F.col("t").alias("embedding"))


def evidence_paths(e: DataFrame, sources: DataFrame, targets: DataFrame, most: int = 4) -> DataFrame:
    """Shortest path of each source to its nearest target over edges (src, dst, w); score is the product of weights. Ties: best score, then path."""
    p = sources.select("source", F.array("source").alias("path"), F.lit(1.0).alias("score"))
    done, hit = [], targets.select(F.col("target").alias("_t"))
    for k in range(1, most + 1):
        p = p.join(e, F.element_at("path", -1) == e.src).where(~F.array_contains("path", F.col("dst"))).select("source", F.concat("path", F.array("dst")).alias("path"), (F.col("score") * F.col("w")).alias("score"))
        # one way to a node is enough: the best
        p = cut(top_k(p.withColumn("_end", F.element_at("path", -1)), ["source", "_end"], [F.desc("score"), "path"], 1).drop("rn", "_end"))
        done.append(p.join(hit, F.element_at("path", -1) == F.col("_t"), "left_semi").withColumn("hops", F.lit(k)))
    out = done[0]
    for x in done[1:]:
        out = out.union(x)
    return top_k(out, ["source"], ["hops", F.desc("score"), "path"], 1).drop("rn")


