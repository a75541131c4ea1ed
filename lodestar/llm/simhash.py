"""SimHash near-dedup by the generalised pigeonhole principle.

Fingerprints: 64 bits over 3-word shingles (XXH64, seed 42). Distinct fingerprints are joined at 3 or fewer differing bits:

1. Bit pairs that agree more than chance puts go into one partition (correlations from counts aggregated over all fingerprints).
2. For each fingerprint, thresholds t_i of the partitions (-1: not probed) with sum t_i = 3 - m + 1 are allocated by dynamic
   programming on estimated candidate counts, so that a partition whose value is frequent is avoided and others are widened. Any
   fingerprint within 3 bits then differs in at most t_i bits in some partition i.
3. A bucket holds all fingerprints with one value of a partition, and those that probe it. Probes are verified on all 64 bits;
   buckets send on a spanning forest of their links, never all pairs. Buckets past HOT rows are split into blocks by block pairs.

Components of the links give the groups. Exact copies share a fingerprint and count once in all of this.

Defined results: texts with no words have fingerprint zero and link like any other; repeated rows are rows of one group; a null doc_id
is never the smallest of its group (null if the group has no other); an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm._base import column, components, most_frequent, pieces, shuffle_parts, small_batches, table, text_bytes, written

SHINGLE = 3
SEED = 42
DISTANCE = 3
#: Rows of a bucket that one task verifies; more are split into block pairs.
HOT = 20_000
#: Most values a partition, on average, whose counts are told to all tasks; others count as the mean.
KNOWN_VALUES = 20_000
#: Hot values that are told to all tasks, at most: blocks have HOT rows up to some 10^10 fingerprints.
HOT_VALUES = 2_000_000
HOT_COPIES, HOT_MOST = 1_000, 1_000_000


def fingerprint(text: bytes, piece: int = 1 << 20) -> int:
    """The majority of each bit over all shingles; long texts go through in pieces."""
    h, ones, total, held = xxhash.xxh64_intdigest, np.zeros(64, np.int64), 0, []
    for part in pieces(text, piece):
        w = held + part.lower().split()
        got = [h(b" ".join(s), SEED) for s in zip(*(w[k:] for k in range(SHINGLE)))]
        held = w[1 - SHINGLE :]
        a = np.array(got, np.uint64)
        for k in range(0, len(a), 1 << 15):
            ones += np.unpackbits(a[k : k + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        total += len(a)
    if not total:
        return h(b" ".join(held), SEED) if held else 0
    return int(np.packbits(2 * ones > total, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches):
            fp = np.array([fingerprint(t) for t in text_bytes(b)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([column(b, "doc_id"), pa.array(fp)], names=["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp long")


def bits_of(fp: np.ndarray) -> np.ndarray:
    return np.unpackbits(fp.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def bit_counts(distinct: DataFrame) -> tuple[int, np.ndarray]:
    """How many fingerprints there are and how often bits i and j are both set: 64 x 64 sums, made in each task and added up."""

    def run(batches):
        total, n = np.zeros((64, 64), np.int64), 0
        for b in batches:
            x = bits_of(column(b, "fp").to_numpy()).astype(np.float32)
            for k in range(0, len(x), 1 << 20):
                total += (x[k : k + (1 << 20)].T @ x[k : k + (1 << 20)]).astype(np.int64)
            n += len(x)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(4097)), pa.array(np.append(total.ravel(), n))], names=["k", "n"])

    got = distinct.select("fp").mapInArrow(run, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).collect()
    flat = np.zeros(4097, np.int64)
    for r in got:
        flat[r.k] = r.n
    return int(flat[-1]), flat[:-1].reshape(64, 64)


def partitions(n: int, both: np.ndarray) -> list[np.ndarray]:
    """Bit groups: as many as make probes and expected candidates cheapest, each grown by the bits most correlated with it."""
    cost = {m: sum_probes(m) * 4 + n * sum_probes(m) / 2 ** (64 / m) for m in (2, 3, 4)}
    m = min(cost, key=cost.get)
    p = np.diag(both) / max(n, 1)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    corr = np.abs((both / max(n, 1) - np.outer(p, p)) / np.outer(sd, sd))
    free, out = list(range(64)), []
    for k in range(m):
        size = len(free) // (m - k)
        group = [free.pop(0)]
        while len(group) < size:
            best = max(free, key=lambda b: corr[b, group].mean())
            free.remove(best)
            group.append(best)
        out.append(np.array(sorted(group)))
    return out


def sum_probes(m: int) -> int:
    """Probes of a fingerprint if all thresholds are as even as can be."""
    extra, width = DISTANCE - m + 1, 64 // m
    return sum(1 + (width if k < extra else 0) for k in range(m))


def value_of(fp: np.ndarray, group: np.ndarray) -> np.ndarray:
    """The bits of a partition as one number."""
    u, out = fp.view(np.uint64), np.zeros(len(fp), np.uint64)
    for k, b in enumerate(group):
        out |= ((u >> np.uint64(b)) & np.uint64(1)) << np.uint64(k)
    return out.view(np.int64)


def flips(width: int, t: int) -> list[np.ndarray]:
    """Masks that change exactly 0, 1, ... t bits."""
    return [np.array([sum(1 << b for b in c) for c in combinations(range(width), d)], np.int64) for d in range(t + 1)]


class Plan:
    """Partitions, the known value counts, and what they say of a fingerprint's thresholds."""

    def __init__(self, groups: list[np.ndarray], known: list[tuple[np.ndarray, np.ndarray]], mean: list[float], hot: tuple[np.ndarray, np.ndarray]):
        self.groups, self.known, self.mean, self.hot = groups, known, mean, hot
        self.budget = DISTANCE - len(groups) + 1

    def count(self, i: int, v: np.ndarray) -> np.ndarray:
        keys, counts = self.known[i]
        if not len(keys):
            return np.full(len(v), self.mean[i])
        at = np.minimum(np.searchsorted(keys, v), len(keys) - 1)
        return np.where(keys[at] == v, counts[at], self.mean[i])

    def thresholds(self, values: list[np.ndarray]) -> np.ndarray:
        """The cheapest t (rows: fingerprints, columns: partitions) with sum = budget, by dynamic programming over the partitions."""
        n, m = len(values[0]), len(values)
        ts = range(-1, self.budget + m)  # one partition may take all while the others are at -1
        cost = np.full((m, n, len(ts)), np.inf)
        for i, v in enumerate(values):
            width = len(self.groups[i])
            cost[i, :, 0] = 0
            near = self.count(i, v)
            cost[i, :, 1] = 1 + near
            if len(ts) > 2:
                one = sum((self.count(i, v ^ f) for f in flips(width, 1)[1]), np.zeros(n))
                cost[i, :, 2] = 1 + width * 4 + near + one
            for k in range(3, len(ts)):  # past one bit, values are taken as mean ones
                ways = sum(len(f) for f in flips(width, 2)) if k == 3 else width**3
                cost[i, :, k] = ways * 4 + near + ways * self.mean[i]
        # best[s]: cost of the partitions so far with thresholds that sum to s - i - 1
        span = self.budget + m + 1
        best, choice = np.full((n, span), np.inf), np.zeros((m, n, span), np.int8)
        best[:, 0] = 0
        for i in range(m):
            new = np.full((n, span), np.inf)
            for k in range(len(ts)):
                for s in range(span - k):
                    c = best[:, s] + cost[i, :, k]
                    better = c < new[:, s + k]
                    new[better, s + k] = c[better]
                    choice[i, better, s + k] = k
            best = new
        out, s = np.zeros((n, m), np.int64), np.full(n, self.budget + m)
        for i in range(m - 1, -1, -1):
            k = choice[i, np.arange(n), s]
            out[:, i] = k - 1
            s = s - k
        return out

    def rows(self, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """key, fingerprint and kind (1: found there, 2: probes it, 3: both) of all rows, hot buckets split into block pairs."""
        values = [value_of(fp, g) for g in self.groups]
        t = self.thresholds(values)
        keys, fps, kinds = [], [], []
        for i, v in enumerate(values):
            base = np.int64(i) << np.int64(40)
            keys.append(base | v)
            fps.append(fp)
            kinds.append(np.where(t[:, i] >= 0, 3, 1))
            for k in range(1, int(t[:, i].max(initial=-1)) + 1):
                sel = t[:, i] >= k
                for f in flips(len(self.groups[i]), k)[k]:
                    keys.append(base | (v[sel] ^ f))
                    fps.append(fp[sel])
                    kinds.append(np.full(int(sel.sum()), 2))
        key, f, kind = np.concatenate(keys), np.concatenate(fps), np.concatenate(kinds)
        block = np.zeros(len(key), np.int64)
        hot_keys, splits = self.hot
        if len(hot_keys):
            at = np.minimum(np.searchsorted(hot_keys, key), len(hot_keys) - 1)
            is_hot = hot_keys[at] == key
            ks, fs, kd, bl = [key[~is_hot]], [f[~is_hot]], [kind[~is_hot]], [block[~is_hot]]
            for h in np.unique(key[is_hot]):
                sel = key == h
                s = int(splits[np.searchsorted(hot_keys, h)])
                own = (f[sel].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)).astype(np.int64) % s
                for other in range(s):
                    for bit, number in ((1, other * s + own), (2, own * s + other)):  # found in the column of its block, probes its row
                        w = (kind[sel] & bit) > 0
                        ks.append(key[sel][w])
                        fs.append(f[sel][w])
                        kd.append(np.full(int(w.sum()), bit))
                        bl.append(number[w] + 1)
            key, f, kind, block = map(np.concatenate, (ks, fs, kd, bl))
        return key, f, kind, block


def links_within(key: np.ndarray, fp: np.ndarray, kind: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the verified links between rows of one key, one of which probes and one of which is found there."""
    order = np.lexsort((fp, key))
    key, fp, kind = key[order], fp[order].view(np.uint64), kind[order]
    nodes, node = np.unique(fp, return_inverse=True)
    parent = np.arange(len(nodes))
    ends = np.searchsorted(key, key, side="right")
    out: list[tuple[int, int]] = []

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    rows = np.arange(len(key))
    shift = 1
    while len(rows := rows[rows + shift < ends[rows]]):
        a, b = rows, rows + shift
        ok = np.bitwise_count(fp[a] ^ fp[b]) <= DISTANCE
        ok &= ((kind[a] | kind[b]) == 3) & (fp[a] != fp[b])
        x, y = node[a[ok]], node[b[ok]]
        if len(x):
            px, py = parent[x], parent[y]
            for _ in range(3):
                px, py = parent[px], parent[py]
            for i, j in zip(x[px != py].tolist(), y[px != py].tolist()):
                ri, rj = root(i), root(j)
                if ri != rj:
                    parent[max(ri, rj)] = min(ri, rj)
                    out.append((i, j))
        shift += 1
    signed = nodes.view(np.int64)
    return [(int(signed[i]), int(signed[j])) for i, j in out]


def make_plan(distinct: DataFrame) -> tuple[int, Plan]:
    n, both = bit_counts(distinct)
    groups = partitions(n, both)
    m = len(groups)

    def values(batches):
        for b in batches:
            fp = column(b, "fp").to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([(np.int64(i) << np.int64(40)) | value_of(fp, g) for i, g in enumerate(groups)]))], names=["key"])

    counts = distinct.select("fp").mapInArrow(values, "key long").groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    counts = written(counts.where("n > 1"), "simhash-values")
    known = most_frequent(counts, KNOWN_VALUES * m).collect()
    lists: list[list[tuple[int, int]]] = [[] for _ in groups]
    for r in known:
        lists[r.key >> 40].append((r.key & ((1 << 40) - 1), r.n))
    pairs = [(np.array([v for v, _ in sorted(x)], np.int64), np.array([c for _, c in sorted(x)], np.float64)) for x in lists]
    mean = [max(0.0, (n - c.sum())) / 2 ** min(len(g), 60) for (_, c), g in zip(pairs, groups)]
    most = max(HOT, m * n // HOT_VALUES)  # so at most HOT_VALUES are past it
    past = counts.where(F.col("n") > most).orderBy("key").toArrow()
    hot = (past.column("key").to_numpy(), -(-past.column("n").to_numpy() // most))
    return n, Plan(groups, pairs, mean, hot)


def linked(distinct: DataFrame) -> DataFrame:
    """Links (a, b) between distinct fingerprints that connect what distances of 3 or less connect."""
    spark = distinct.sparkSession
    n, plan = make_plan(distinct)
    plan_b = spark.sparkContext.broadcast(plan)

    def probe(batches):
        for b in batches:
            fp = column(b, "fp").to_numpy()
            for k in range(0, len(fp), 20_000):
                key, f, kind, block = plan_b.value.rows(fp[k : k + 20_000])
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(f), pa.array(kind.astype(np.int8)), pa.array(block)], names=["key", "fp", "kind", "block"])

    def verify(batches):
        got = [(column(b, "key").to_numpy(), column(b, "fp").to_numpy(), column(b, "kind").to_numpy(), column(b, "block").to_numpy()) for b in batches]
        if got:
            key, f, kind, block = (np.concatenate(x) for x in zip(*got))
            both = np.unique(np.stack([key, block], 1), axis=0, return_inverse=True)[1].ravel() if block.any() else key
            pairs = links_within(both, f, kind.astype(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], names=["a", "b"])

    parts = max(shuffle_parts(spark), n * sum_probes(len(plan.groups)) // 2_000_000 + 1)
    return distinct.select("fp").mapInArrow(probe, "key long, fp long, kind byte, block long").repartition(parts, "key", "block").mapInArrow(verify, "a long, b long")


def groups(docs: DataFrame) -> DataFrame:
    """doc_id, fp and component_id of every row of docs."""
    fps = written(fingerprints(docs), "simhash")
    distinct = written(fps.groupBy("fp").agg(F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("n")), "simhash-distinct")
    comp = written(components(linked(distinct)), "simhash-components")
    low = distinct.join(comp, distinct.fp == comp.node).groupBy("component").agg(F.min("low").alias("group_low"))
    label = comp.join(low, "component").select("node", "group_low")
    label = distinct.join(label, distinct.fp == label.node, "left").select(F.col("fp").alias("_fp"), F.when(F.col("node").isNull(), F.col("low")).otherwise(F.col("group_low")).alias("component_id"), "n")
    # fingerprints that very many rows share are sent to the rows, so no task gets them all; there are at most HOT_MOST such
    most = max(HOT_COPIES, fps.count() // HOT_MOST)
    hot = F.broadcast(label.where(F.col("n") > most))
    on = fps.fp == F.col("_fp")
    some = fps.join(hot, on).select("doc_id", "fp", "component_id")
    rest = fps.join(hot, on, "left_anti").join(label.where(F.col("n") <= most), on).select("doc_id", "fp", "component_id")
    return some.union(rest)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = groups(table(spark, sf_dir, "documents", "doc_id", "text"))
    return g.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
