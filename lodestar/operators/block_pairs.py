"""Pairs of nodes by products of matrices: a task holds two blocks of nodes, and one product counts what all of their pairs share.

Pairs and meetings grow with the square of a space's nodes, so neither is a row of a shuffle: each node goes once to every pair of blocks
that meets in a space, with a list of codes of what it has. Results leave a task as runs, one row of arrays for each node, and become
rows of pairs in the JVM.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.operators import relational
from lodestar.operators.graph import cut

#: Columns of a matrix at once, cells of a matrix that is kept whole, and pairs of a batch of runs.
COLUMNS, CELLS, RUN = 1024, 1 << 25, 1 << 18


def code(space: Column, item: Column) -> Column:
    """One long for a space and an item of 32 bits each; null where one is."""
    return space.cast("long") * F.lit(1 << 32) + item.cast("long")


def _dealt(nodes: DataFrame, node: str, block: int) -> tuple[DataFrame, DataFrame]:
    """Nodes with their block _z, and the sets of blocks that meet in a space."""
    home = F.array_min("spaces")
    nodes = cut(nodes.where(F.col(node).isNotNull() & (F.size("spaces") > 0)))
    size = nodes.groupBy(home.alias("_home")).agg(F.ceil(F.count(F.lit(1)) / block).alias("_k"))
    z = F.xxhash64("_home", F.pmod(F.xxhash64(node), F.col("_k"))).alias("_z")
    dealt = nodes.join(size, home == F.col("_home")).select(*nodes.columns, z)
    met = dealt.select(F.explode("spaces").alias("_space"), "_z").groupBy("_space").agg(F.collect_set("_z").alias("_w"))
    return dealt, met.select(F.explode("_w").alias("_u"), "_w").select("_u", F.explode("_w").alias("_v"))


def _grouped(run: Callable[[pa.Table, pa.Table, bool], Iterator[pa.RecordBatch]]):
    """run on the two sides of each meeting in a task; of a block with itself, both sides are the same."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = list(batches)
        if not got:
            return
        t = pa.Table.from_batches(got).combine_chunks()
        u, v, side = (t.column(c).to_numpy() for c in ("_u", "_v", "_side"))
        order = np.lexsort((side, v, u))
        u, v, side = u[order], v[order], side[order]
        at = np.flatnonzero(np.append(True, (u[1:] != u[:-1]) | (v[1:] != v[:-1])))
        for lo, hi in zip(at, np.append(at[1:], len(u))):
            mid = lo + int(np.searchsorted(side[lo:hi], 1))
            x = t.take(pa.array(order[lo:mid])).combine_chunks()
            y = t.take(pa.array(order[mid:hi])).combine_chunks() if mid < hi else x
            yield from run(x, y, bool(u[lo] == v[lo]))

    return f


def met_blocks(nodes: DataFrame, node: str, run, schema: str) -> DataFrame:
    """run(x, y, one) on every two blocks that meet in one of `spaces` (an array of longs), each pair of nodes once; one: the block meets itself."""
    dealt, met = _dealt(nodes, node, relational.BLOCK)
    met = cut(met.where("_u <= _v").distinct())
    to = met.select(F.col("_u").alias("_z"), "_u", "_v", F.lit(0).alias("_side")).union(met.where("_u < _v").select(F.col("_v").alias("_z"), "_u", "_v", F.lit(1).alias("_side")))
    return _sent(dealt, to, met.count(), run, schema)


def around_blocks(nodes: DataFrame, node: str, run, schema: str) -> DataFrame:
    """run(x, y, one) on every block x and all nodes y of other blocks that meet it in one of `spaces`; one: there are no others."""
    dealt, met = _dealt(nodes, node, max(1, relational.BLOCK // 8))
    met = cut(met.distinct())
    to = met.select(F.col("_v").alias("_z"), "_u", F.col("_u").alias("_v"), (F.col("_u") != F.col("_v")).cast("int").alias("_side"))
    return _sent(dealt, to, met.where("_u = _v").count(), lambda x, y, _: run(x, y, y is x), schema)


def _sent(dealt: DataFrame, to: DataFrame, meetings: int, run, schema: str) -> DataFrame:
    parts = max(int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")), meetings)
    return dealt.join(to, "_z").drop("_z", "spaces").repartition(parts, "_u", "_v").mapInArrow(_grouped(run), schema)


def numbers(t: pa.Table, name: str) -> np.ndarray:
    return t.column(name).to_numpy()


class Rows:
    """Codes of some rows, with weights: a sparse matrix."""

    def __init__(self, row: np.ndarray, code: np.ndarray, weight: np.ndarray, n: int):
        self.row, self.code, self.weight, self.n = row, code, weight, n

    @classmethod
    def of(cls, t: pa.Table, codes: str, weights: str | None = None) -> Rows:
        row, c = flat(t, codes)
        return cls(row, c, np.ones(len(c)) if weights is None else flat(t, weights)[1].astype(float), len(t))

    def dense(self, columns: np.ndarray, kind=np.float32) -> np.ndarray:
        at = np.minimum(np.searchsorted(columns, self.code), len(columns) - 1)
        here = columns[at] == self.code
        out = np.bincount(self.row[here] * len(columns) + at[here], self.weight[here], self.n * len(columns))
        return out.reshape(self.n, len(columns)).astype(kind)

    def most(self) -> float:
        return float(np.bincount(self.row, self.weight).max(initial=0.0))


def whole(t: pa.Table, name: str) -> pa.Array:
    """A column as one array."""
    col = t.column(name).combine_chunks()
    return (col.chunk(0) if col.num_chunks else pa.array([], col.type)) if isinstance(col, pa.ChunkedArray) else col


def elements(t: pa.Table, name: str) -> pa.Array:
    """All elements of a column of arrays."""
    return whole(t, name).flatten()


def flat(t: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray]:
    """Row and value of all elements of a column of arrays."""
    size = whole(t, name).value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(size)), size), elements(t, name).to_numpy(zero_copy_only=False)


def kind_for(x: Rows, y: Rows):
    """A float whose whole numbers hold every sum of products."""
    return np.float32 if x.most() * y.most() < 1 << 24 else np.float64


def product(x: Rows, y: Rows) -> np.ndarray:
    """Sums over equal codes of the products of weights, exact, for all rows of x and y."""
    kind = kind_for(x, y)
    both, out = np.intersect1d(x.code, y.code), np.zeros((x.n, y.n), kind)
    for k in range(0, len(both), COLUMNS):
        m = x.dense(both[k : k + COLUMNS], kind)
        out += m @ (m if y is x else y.dense(both[k : k + COLUMNS], kind)).T
    return out


def alike_elements(x: pa.Table, y: pa.Table, codes: str, words: str) -> np.ndarray:
    """For all rows of x and y, how many elements have equal codes and equal words, nulls being no word."""
    (rx, cx), (ry, cy) = flat(x, codes), flat(y, codes)
    word = pa.concat_arrays([elements(x, words), elements(y, words)]).dictionary_encode()
    number, many = word.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64), len(word.dictionary)
    rows = lambda r, c, w, n: Rows(r[w >= 0], c[w >= 0] * many + w[w >= 0], np.ones(int((w >= 0).sum())), n)
    return product(rows(rx, cx, number[: len(cx)], len(x)), rows(ry, cy, number[len(cx) :], len(y)))


class Together:
    """Products of chosen rows of one matrix with each other; it is kept whole where it is small enough."""

    def __init__(self, rows: Rows):
        columns = np.unique(rows.code)
        self.rows, self.kind = rows, kind_for(rows, rows)
        self.whole = rows.dense(columns, self.kind) if 0 < rows.n * len(columns) <= CELLS else None

    def some(self, at: np.ndarray) -> Rows:
        place = np.full(self.rows.n, -1)
        place[at] = np.arange(len(at))
        row = place[self.rows.row]
        return Rows(row[row >= 0], self.rows.code[row >= 0], self.rows.weight[row >= 0], len(at))

    def counts(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        if self.whole is None:
            return product(self.some(i), self.some(j))
        return self.whole[i] @ self.whole[j].T


def ordered(x: np.ndarray, y: np.ndarray, one: bool) -> np.ndarray | bool:
    """The pairs to look at: all of two blocks, and a < b of one."""
    return x[:, None] < y[None, :] if one else True


def runs(keys: dict[str, np.ndarray | pa.Array], ok: np.ndarray, values: dict[str, np.ndarray | Callable], names: Sequence[str]) -> Iterator[pa.RecordBatch]:
    """Rows of ok that have true cells, with their keys, and arrays of each value at these: an array by column, one by row and column, or a function of both."""
    upto = np.cumsum(np.count_nonzero(ok, axis=1))
    lo = 0
    while lo < len(ok):
        before = int(upto[lo - 1]) if lo else 0
        hi = max(lo + 1, int(np.searchsorted(upto, before + RUN, side="right")))
        if upto[hi - 1] > before:
            r, c = np.nonzero(ok[lo:hi])
            some = np.flatnonzero(np.diff(upto[lo:hi], prepend=before)) + lo
            ends = pa.array(np.append(0, upto[some] - before).astype(np.int32))
            out = {k: v.take(pa.array(some)) if isinstance(v, pa.Array) else pa.array(v[some]) for k, v in keys.items()}
            for k, v in values.items():
                at = v(r + lo, c) if callable(v) else v[c] if v.ndim == 1 else v[lo:hi][r, c]
                out[k] = pa.ListArray.from_arrays(ends, pa.array(at))
            yield pa.RecordBatch.from_arrays([out[n] for n in names], names=list(names))
        lo = hi


def unrolled(runs: DataFrame, others: str, name: str, *values: str) -> DataFrame:
    """One row for each element of others (as name), with that of each value."""
    keys = [c for c in runs.columns if c not in {others, *values}]
    each = runs.select(*keys, *values, F.posexplode(others).alias("_i", name))
    return each.select(*keys, name, *(F.get(F.col(v), F.col("_i")).alias(v) for v in values))
