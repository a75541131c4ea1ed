"""Approximate nearest neighbours by learned partitions.

A neighbour graph over a bounded sample is cut into balanced parts (recursive spectral bisection at the median, then swaps that keep
the balance). A small network learns the parts of a vector and its neighbours. Every vector of the table is indexed under its COPIES most
probable parts; a query goes to its most probable parts and is reranked there by exact cosine in double precision.

How many parts a query goes to is measured: for a few vectors outside the training sample the true neighbours are found among all rows,
and the fewest parts are taken that hold TARGET_RECALL of them, a quarter of all parts at most. The same holds at every size.

Equal vectors are indexed once with their smallest ids, as many as a result can hold, so a vector that many rows share costs as
much as one. Parts are split into blocks of bounded size by vector, and queries of a part into blocks too; only the best of each block
pair go on.

Defined results: vectors that are null, of another length than most, zero, or with null or non-finite components take no part, as
queries or candidates; null ids neither; fewer candidates than asked for give fewer rows; equal scores go to the smaller id. Rows that
repeat an id with one vector are one row; an id with several vectors is asked with each, and a candidate counts by its best score. No row
of the query's own id is a candidate.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.llm._base import column, table, written

TOP = 5
#: Vectors that the graph and the network are fitted on, those of the smallest hash.
SAMPLE = 16_384
#: Vectors whose true neighbours among all rows tell how many parts to probe.
MEASURED = 256
NEIGHBOURS = 10
HIDDEN = 96
TARGET_RECALL = 0.94
#: Parts that a vector is indexed under.
COPIES = 4
#: Vectors for each part, up to MOST_PARTS parts, as many as the sample can tell apart.
PART_ROWS = 40
MOST_PARTS = SAMPLE // 16
BLOCK_ROWS = 20_000


def matrix(col: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """The usable vectors of a list column as rows, and which rows of the column they are."""
    values = col.flatten().cast(pa.float64())  # flatten leaves out null lists
    flat = values.to_numpy(zero_copy_only=False)  # null components are NaN here
    size = np.asarray(col.value_lengths().fill_null(0))
    ends = np.cumsum(size)
    rows = np.flatnonzero(size == dim) if dim else np.zeros(0, np.int64)
    x = flat[(ends[rows] - dim)[:, None] + np.arange(dim)] if len(rows) else np.zeros((0, dim))
    ok = np.isfinite(x).all(1) & (x != 0).any(1)
    return x[ok], rows[ok]


def unit(x: np.ndarray) -> np.ndarray:
    big = np.abs(x).max(1, keepdims=True)
    y = x / np.where(big > 0, big, 1)
    return (y / np.sqrt((y * y).sum(1, keepdims=True))).astype(np.float32)


def neighbours(x: np.ndarray, k: int) -> np.ndarray:
    """The k nearest other rows of each row, by blocks."""
    out = np.zeros((len(x), max(0, min(k, len(x) - 1))), np.int64)
    for s in range(0, len(x) if out.shape[1] else 0, 1024):
        sim = x[s : s + 1024] @ x.T
        sim[np.arange(len(sim)), np.arange(s, s + len(sim))] = -np.inf
        near = np.argpartition(-sim, out.shape[1] - 1, axis=1)[:, : out.shape[1]]
        out[s : s + 1024] = near
    return out


def bisect(nodes: np.ndarray, a: np.ndarray, b: np.ndarray, rng) -> np.ndarray:
    """One side of a balanced cut: the second eigenvector of the walk on the sub-graph, split at its median, then paired swaps."""
    place = np.full(int(max(a.max(initial=0), b.max(initial=0), nodes.max())) + 1, -1)
    place[nodes] = np.arange(len(nodes))
    u, v = place[a], place[b]
    keep = (u >= 0) & (v >= 0)
    u, v, n = u[keep], v[keep], len(nodes)
    deg = np.bincount(u, minlength=n) + np.bincount(v, minlength=n) + 1.0
    f = rng.normal(size=n)
    for _ in range(60):
        f -= (f * deg).sum() / deg.sum()
        f = 0.5 * f + 0.5 * (f + np.bincount(u, f[v], n) + np.bincount(v, f[u], n)) / deg
        f /= np.abs(f).max() + 1e-12
    side = np.zeros(n, bool)
    side[np.argsort(f, kind="stable")[n // 2 :]] = True
    for _ in range(8):  # swap as many of either side as gain by it
        s = np.where(side, 1.0, -1.0)
        pull = (np.bincount(u, s[v], n) + np.bincount(v, s[u], n)) * -s  # edges over the cut less those within
        one, two = np.flatnonzero(side & (pull > 0)), np.flatnonzero(~side & (pull > 0))
        k = min(len(one), len(two)) // 2
        if k == 0:
            break
        side[one[np.argsort(-pull[one])[:k]]] = False
        side[two[np.argsort(-pull[two])[:k]]] = True
    return side


def balanced_parts(near: np.ndarray, parts: int, seed: int = 3) -> np.ndarray:
    """A part of each row of the neighbour graph; sizes differ by at most one a level."""
    rng = np.random.default_rng(seed)
    a, b = np.repeat(np.arange(len(near)), near.shape[1]), near.ravel()
    label = np.zeros(len(near), np.int64)
    for level in range(parts.bit_length() - 1):
        new = np.zeros_like(label)
        for p in range(2**level):
            nodes = np.flatnonzero(label == p)
            if len(nodes):
                inner = (label[a] == p) & (label[b] == p)
                new[nodes] = 2 * p + bisect(nodes, a[inner], b[inner], rng)
        label = new
    return label


@dataclass
class Router:
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(x @ self.w1 + self.b1, 0) @ self.w2 + self.b2

    def parts(self, x: np.ndarray, k: int) -> np.ndarray:
        z = self.logits(x)
        return np.argsort(-z, axis=1, kind="stable")[:, :k]


def train_router(x: np.ndarray, soft: np.ndarray, steps: int = 900, batch: int = 256, seed: int = 5) -> Router:
    rng = np.random.default_rng(seed)
    d, p = x.shape[1], soft.shape[1]
    f = np.float32
    r = Router((rng.normal(size=(d, HIDDEN)) * (2 / d) ** 0.5 * d**0.5 / 2).astype(f), np.zeros(HIDDEN, f), (rng.normal(size=(HIDDEN, p)) * HIDDEN**-0.5).astype(f), np.zeros(p, f))
    params = [r.w1, r.b1, r.w2, r.b2]
    m, v = [np.zeros_like(q) for q in params], [np.zeros_like(q) for q in params]
    for t in range(1, steps + 1 if len(x) else 1):
        i = rng.integers(0, len(x), batch)
        h = np.maximum(x[i] @ r.w1 + r.b1, 0)
        z = h @ r.w2 + r.b2
        q = np.exp(z - z.max(1, keepdims=True))
        dz = (q / q.sum(1, keepdims=True) - soft[i]) / batch
        dh = (dz @ r.w2.T) * (h > 0)
        for k, g in enumerate((x[i].T @ dh, dh.sum(0), h.T @ dz, dz.sum(0))):
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.999 * v[k] + 0.001 * g * g
            params[k] -= (0.01 * (1 - t / (steps + 1)) * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)).astype(f)
    return r


def fit(sample: np.ndarray, parts: int) -> Router:
    """The router of a sample of unit vectors: soft labels are the parts of a vector and its neighbours in the graph."""
    near = neighbours(sample, NEIGHBOURS)
    label = balanced_parts(near, parts)
    soft = np.zeros((len(sample), parts), np.float32)
    np.add.at(soft, (np.arange(len(sample)), label), 1.0)
    for k in range(near.shape[1]):
        np.add.at(soft, (np.arange(len(sample)), label[near[:, k]]), 1.0)
    return train_router(sample, soft / (1.0 + near.shape[1]))


def exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Cosines of q and each row of x, in double precision and the same for equal rows wherever they stand."""
    return (x * q).sum(1) / (np.sqrt((x * x).sum(1)) * np.sqrt((q * q).sum()))


def best_rows(q: np.ndarray, x: np.ndarray, ids: list[list[int]], k: int) -> list[list[tuple[float, int]]]:
    """For each query the k best (score, id), best first. ids: the rows of each vector."""
    out = []
    xs = unit(x).astype(np.float64)
    for s in range(0, len(q), 256):
        sim = unit(q[s : s + 256]).astype(np.float64) @ xs.T
        take = min(len(x), 2 * k + 8)
        near = np.argpartition(-sim, take - 1, axis=1)[:, :take] if take < len(x) else np.broadcast_to(np.arange(len(x)), sim.shape)
        for i in range(len(sim)):
            score = exact(q[s + i], x[near[i]])
            rows = [(float(c), v) for c, j in zip(score, near[i]) for v in ids[j]]
            out.append(sorted(rows, key=lambda r: (-r[0], r[1]))[:k])
    return out


def vectors(col: pa.Array, dtype: str) -> np.ndarray:
    """Rows of packed vectors, in double precision."""
    return np.frombuffer(b"".join(col.to_pylist()), dtype).reshape(len(col), -1).astype(np.float64)


def packed(df: DataFrame, id_col: str, vec_col: str, dim: int, dtype: str) -> DataFrame:
    """id, vec (bytes) and its md5 as key, of the rows with an id and a usable vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, rows = matrix(column(b, "vec"), dim)
            ids = column(b, "id").to_numpy(zero_copy_only=False)[rows].astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array([v.tobytes() for v in x.astype(dtype) + 0], pa.binary())], names=["id", "vec"])

    some = df.select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec")).where("id is not null and vec is not null")
    return some.mapInArrow(run, "id long, vec binary").withColumn("key", F.md5("vec"))


def distinct_vectors(rows: DataFrame, keep: int) -> DataFrame:
    """key, vec and its `keep` smallest ids, of packed rows. A hot vector meets in its `keep` rows of each task only."""
    w = Window.partitionBy("key").orderBy("id")
    few = rows.dropDuplicates(["key", "id"]).withColumn("r", F.row_number().over(w)).where(F.col("r") <= keep)
    return few.groupBy("key").agg(F.first("vec").alias("vec"), F.array_sort(F.collect_list("id")).alias("ids"))


def probes_needed(homes: DataFrame, router_b, asked: np.ndarray, keys: list[str], dtype: str, parts: int, top: int, target: float) -> tuple[int, float]:
    """The fewest parts that hold `target` of the true neighbours of the vectors `asked` among all rows, a quarter of all at most, and
    the share that so many parts hold. Tasks send their nearest rows with the rank of the part that has them."""
    if not len(asked):
        return 1, 1.0  # fewer than 8 vectors: two parts, and each vector is in both

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, own = unit(asked), {k: i for i, k in enumerate(keys)}
        rank = np.argsort(router_b.value.parts(q, parts), 1)
        best = np.full((len(q), top), -np.inf)
        reach = np.zeros((len(q), top), np.int64)
        for b in batches:
            x = vectors(column(b, "vec"), dtype)
            if not len(x):
                continue
            at = np.stack(column(b, "parts").to_pylist())
            sim = q.astype(np.float64) @ unit(x).astype(np.float64).T
            for j, key in enumerate(column(b, "key").to_pylist()):
                if key in own:
                    sim[own[key], j] = -np.inf
            take = min(top, len(x))
            i = np.argpartition(-sim, take - 1, axis=1)[:, :take]
            r = np.stack([rank[k][at[j]].min(1) for k, j in enumerate(i)])
            best, reach = np.concatenate([best, np.take_along_axis(sim, i, 1)], 1), np.concatenate([reach, r], 1)
            o = np.argsort(-best, 1, kind="stable")[:, :top]
            best, reach = np.take_along_axis(best, o, 1), np.take_along_axis(reach, o, 1)
        query, k = np.nonzero(np.isfinite(best))
        yield pa.RecordBatch.from_arrays([pa.array(query), pa.array(best[query, k]), pa.array(reach[query, k])], names=["query", "score", "reach"])

    rows = homes.select("key", "vec", "parts").mapInArrow(run, "query long, score double, reach long")
    rows = rows.withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "reach"))).where(F.col("r") <= top)
    reach = np.array([r.reach for r in rows.select("reach").collect()])  # MEASURED * top at most
    k = next(k for k in range(1, parts + 1) if (reach < k).mean() >= target)
    k = min(k, max(1, parts // 4))
    return k, float((reach < k).mean())


@dataclass
class Index:
    """homes: key, vec, ids and the parts of each distinct vector; probes: parts a query goes to; recall: measured at that many."""

    homes: DataFrame
    router_b: object
    dim: int
    dtype: str
    parts: int
    probes: int
    recall: float


def build(df: DataFrame, id_col: str, vec_col: str, top: int = TOP) -> Index:
    spark = df.sparkSession
    dims = df.select(F.size(vec_col).alias("d")).where("d > 0").groupBy("d").count().orderBy(F.desc("count"), "d").first()
    dim = dims.d if dims else 0
    dtype = "<f4" if isinstance(df.schema[vec_col].dataType.elementType, T.FloatType) else "<f8"
    index = written(distinct_vectors(packed(df, id_col, vec_col, dim, dtype), top + 1), "ann-index")
    n = index.count()
    parts = 1 << min(MOST_PARTS.bit_length() - 1, max(1, round(np.log2(max(n, 1) / PART_ROWS))))
    measured = min(MEASURED, n // 8)
    # keys are hashes; twice what is wanted is let through, whatever the number of tasks
    wanted = SAMPLE + measured
    top_key = f"{min(0xFFFFFFFF, int(2 * wanted / max(n, 1) * 2**32)):08x}g"
    got = index.where(F.col("key") < top_key).orderBy("key").limit(wanted).select("key", "vec").toArrow()
    sample, keys = vectors(got.column("vec").combine_chunks(), dtype) if got.num_rows else np.zeros((0, max(dim, 1))), got.column("key").to_pylist()
    router_b = spark.sparkContext.broadcast(fit(unit(sample[measured:]) if n else sample.astype(np.float32), parts))
    copies = min(COPIES, parts)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            to = router_b.value.parts(unit(vectors(column(b, "vec"), dtype)), copies) if b.num_rows else np.zeros((0, 1), np.int64)
            yield pa.RecordBatch.from_arrays([*(column(b, c) for c in ("key", "vec", "ids")), pa.array(to.tolist(), pa.list_(pa.int32()))], names=["key", "vec", "ids", "parts"])

    homes = written(index.mapInArrow(route, "key string, vec binary, ids array<long>, parts array<int>"), "ann-homes")
    probes, recall = probes_needed(homes, router_b, sample[:measured], keys[:measured], dtype, parts, top, TARGET_RECALL)
    return Index(homes, router_b, dim, dtype, parts, probes, recall)


def met(ix: Index, asked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vectors and queries dealt to (part, block of vectors, block of queries)."""
    router_b, dtype, probes = ix.router_b, ix.dtype, ix.probes

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            to = router_b.value.parts(unit(vectors(column(b, "vec"), dtype)), probes) if b.num_rows else np.zeros((0, 1), np.int64)
            yield pa.RecordBatch.from_arrays([column(b, "key"), column(b, "vec"), pa.array(to.tolist(), pa.list_(pa.int32()))], names=["key", "vec", "parts"])

    asked = written(asked.select("key", "vec").mapInArrow(route, "key string, vec binary, parts array<int>").select("key", "vec", F.explode("parts").alias("part")), "ann-queries")
    homes = ix.homes.select("key", "vec", "ids", F.explode("parts").alias("part"))
    count = lambda df, c: df.groupBy("part").agg(F.count(F.lit(1)).alias(c))
    blocks = lambda c: F.ceil(F.greatest(F.coalesce(c, F.lit(1)), F.lit(1)) / BLOCK_ROWS).cast("int")
    sizes = F.broadcast(count(homes, "n").join(count(asked, "q"), "part", "left").select("part", blocks("n").alias("cbs"), blocks("q").alias("qbs")))  # MOST_PARTS rows at most
    own = lambda k: F.pmod(F.xxhash64("key"), F.col(k)).cast("int")
    all_ = lambda k: F.explode(F.sequence(F.lit(0), F.col(k) - 1))
    left = homes.join(sizes, "part").select("part", own("cbs").alias("cb"), all_("qbs").alias("qb"), "vec", "ids")
    return left, asked.join(sizes, "part").select("part", own("qbs").alias("qb"), all_("cbs").alias("cb"), "key", "vec")


def search(df: DataFrame, id_col: str, vec_col: str, is_query, top: int = TOP) -> DataFrame:
    """query_id, rank, id and score: for the rows that is_query selects, the nearest rows but those of the query's id."""
    ix = build(df, id_col, vec_col, top)
    queries = written(packed(df.where(is_query), id_col, vec_col, ix.dim, ix.dtype).dropDuplicates(["key", "id"]), "ann-asked")
    left, right = met(ix, distinct_vectors(queries, 1))
    dtype = ix.dtype

    def meet(found, q):
        schema = pa.schema([("key", pa.string()), ("id", pa.int64()), ("score", pa.float64())])
        if not found.num_rows or not q.num_rows:
            return schema.empty_table()
        vec = lambda t: vectors(t.column("vec").combine_chunks(), dtype)
        best = best_rows(vec(q), vec(found), found.column("ids").to_pylist(), top + 1)
        rows = [(k, i, s) for k, b in zip(q.column("key").to_pylist(), best) for s, i in b]
        return pa.Table.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate(schema.types)], schema=schema)

    on = ["part", "cb", "qb"]
    hits = left.groupBy(*on).cogroup(right.groupBy(*on)).applyInArrow(meet, "key string, id long, score double")
    # a vector is met in several parts: each counts once
    nearest = lambda by, k: F.row_number().over(Window.partitionBy(by).orderBy(F.desc("score"), "id")) <= k
    hits = hits.groupBy("key", "id").agg(F.max("score").alias("score")).withColumn("near", nearest("key", top + 1)).where("near").drop("near")
    hits = hits.groupBy("key").agg(F.collect_list(F.struct("id", "score")).alias("hits"))  # top + 1 at most
    out = queries.select(F.col("id").alias("query_id"), "key").join(hits, "key").select("query_id", F.explode("hits").alias("h")).select("query_id", "h.*")
    out = out.where("id <> query_id").groupBy("query_id", "id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return out.withColumn("rank", rank).where(F.col("rank") <= top).select("query_id", F.col("rank").cast("int").alias("rank"), "id", "score")


def op2_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search(table(spark, sf_dir, "embeddings", "vec_id", "embedding"), "vec_id", "embedding", F.col("vec_id") % 50 == 0)
    return found.withColumnRenamed("id", "vec_id").orderBy("query_id", "rank")
