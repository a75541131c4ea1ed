"""Benchmark decontamination: a generalised suffix automaton of the normalised test items, streamed over the training tokens.

Words are runs of letters, digits and characters past ASCII, A-Z lower-cased. The automaton tracks for every document word the longest
factor of any item that ends there; a length of 10 or more marks the last 10 words (items of fewer words count whole).

Items are packed into automata of at most SHARD_WORDS words. One scan of the documents streams them through AT_ONCE automata, so what is
sent to executors at once is bounded; if the benchmark needs more, its spans are written scan by scan and joined by document.

Defined results: null or empty texts and items without words have no windows; items with a null item_id are left out; repeated items
count once per item_id; repeated document rows get a row each.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain, islice, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.llm._base import column, pieces, small_batches, table, text_bytes, tidy, with_fields, written

WINDOW = 10
#: Most words of benchmark items in one automaton (an item longer than this has one of its own).
SHARD_WORDS = 100_000
#: Automata that one scan goes through.
AT_ONCE = 8
#: The pipeline drops documents of which at least this share is hit; of others it removes the spans.
DROP_COVERAGE = 0.5

_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


class Automaton:
    """Suffix automaton of several word sequences. State 0 is the root."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        self.ids = [i for i, _ in items]
        self.vocab: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.len = [-1], [0]
        seqs = [[self.vocab.setdefault(w, len(self.vocab) + 1) for w in ws] for _, ws in items]
        for seq in seqs:
            last = 0
            for w in seq:
                last = self._extend(last, w)
        self.lengths = sorted({min(window, len(s)) for s in seqs if s})
        marks: dict[tuple[int, int], set[int]] = {}
        for k, seq in enumerate(seqs):
            if seq:
                n = min(window, len(seq))
                s = size = 0
                for w in seq:
                    s, size = self.step(s, size, w)
                    if size >= n:
                        marks.setdefault((self.at_length(s, n), n), set()).add(k)
        self.marks = {k: tuple(v) for k, v in marks.items()}
        self.pairs = np.zeros(1 << 20, bool)
        for seq in seqs:
            a = np.array(seq, np.int64)
            self.pairs[pair_slot(a[:-1], a[1:])] = True
        self.single = np.zeros(len(self.vocab) + 1, bool)
        for seq in seqs:
            if len(seq) == 1:
                self.single[seq[0]] = True

    def _extend(self, last: int, w: int) -> int:
        to = self.next[last].get(w)
        if to is not None:
            if self.len[to] == self.len[last] + 1:
                return to
            return self._split(last, w, to)
        cur = self._state(self.len[last] + 1)
        p = last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = cur
            p = self.link[p]
        if p < 0:
            self.link[cur] = 0
        else:
            q = self.next[p][w]
            self.link[cur] = q if self.len[q] == self.len[p] + 1 else self._split(p, w, q)
        return cur

    def _state(self, size: int) -> int:
        self.next.append({})
        self.link.append(0)
        self.len.append(size)
        return len(self.len) - 1

    def _split(self, p: int, w: int, q: int) -> int:
        copy = self._state(self.len[p] + 1)
        self.next[copy] = dict(self.next[q])
        self.link[copy], self.link[q] = self.link[q], copy
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = copy
            p = self.link[p]
        return copy

    def step(self, s: int, size: int, w: int) -> tuple[int, int]:
        while s and w not in self.next[s]:
            s = self.link[s]
            size = self.len[s]
        to = self.next[s].get(w)
        return (to, size + 1) if to is not None else (0, 0)

    def at_length(self, s: int, n: int) -> int:
        """The state of the last n words of a match that stands in s."""
        while self.len[self.link[s]] >= n:
            s = self.link[s]
        return s

    def scan(self, seq: list[int]) -> tuple[list[tuple[int, int]], set[int]]:
        """Hit spans [start, end) of word numbers, merged, and the items with an occurring window."""
        spans: list[tuple[int, int]] = []
        found: set[int] = set()
        s = size = 0
        for i, w in enumerate(seq):
            s, size = self.step(s, size, w) if w else (0, 0)
            best = 0
            for n in self.lengths:
                if n > size:
                    break
                if (got := self.marks.get((self.at_length(s, n), n))) is not None:
                    best = n
                    found.update(got)
            if best:
                start = i + 1 - best
                while spans and spans[-1][1] >= start:
                    start = min(start, spans.pop()[0])
                spans.append((start, i + 1))
        return spans, found


def pair_slot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return ((a * 1000003) ^ (b * 40503)) & ((1 << 20) - 1)


def candidates(auto: Automaton, ids: np.ndarray) -> list[tuple[int, int]]:
    """Stretches of the word numbers that can hold a window: known words, each pair of neighbours also a pair in some item."""
    n = len(ids)
    if not n:
        return []
    linked = np.zeros(n, bool)
    linked[1:] = (ids[1:] > 0) & (ids[:-1] > 0) & auto.pairs[pair_slot(ids[:-1], ids[1:])]
    starts = np.flatnonzero(~linked)
    sizes = np.diff(np.append(starts, n))
    least = auto.lengths[0] if auto.lengths else n + 1
    ok = (sizes >= least) & (ids[starts] > 0) & ((sizes > 1) | auto.single[ids[starts]])
    return [(int(a), int(a + m)) for a, m in zip(starts[ok], sizes[ok])]


def load_items(benchmark: DataFrame, shard_words: int = SHARD_WORDS) -> Iterator[list[tuple[str, list[bytes]]]]:
    """Items in shards of bounded size, read one partition at a time."""
    shard: list[tuple[str, list[bytes]]] = []
    total = 0
    rows = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").where("item_id is not null and text is not null")
    for r in rows.toLocalIterator():
        ws = words_of(r.text.encode())
        if shard and total + len(ws) > shard_words:
            yield shard
            shard, total = [], 0
        if ws:
            shard.append((r.item_id, ws))
            total += len(ws)
    if shard:
        yield shard


def scan_texts(autos: list[Automaton], texts: list[bytes]) -> Iterator[tuple[int, list[tuple[int, int]], set[str]]]:
    """For each text the number of its words, the hit spans (word numbers) and the ids of the items found."""
    for t in texts:
        spans: list[tuple[int, int]] = []
        found: set[str] = set()
        ids = [[] for _ in autos]
        for part in pieces(t):  # white space parts words, so none is cut
            ws = words_of(part)
            for of, auto in zip(ids, autos):
                of.append(np.fromiter(map(auto.vocab.get, ws, repeat(0)), np.int64, len(ws)))
        for of, auto in zip(ids, autos):
            of = np.concatenate(of) if of else np.zeros(0, np.int64)
            for a, b in candidates(auto, of):
                sp, it = auto.scan(of[a:b].tolist())
                spans += [(a + x, a + y) for x, y in sp]
                found |= {auto.ids[k] for k in it}
        yield sum(map(len, ids[0])), spans, found


FOUND = {"n_words": T.LongType(), "starts": T.ArrayType(T.IntegerType()), "ends": T.ArrayType(T.IntegerType()), "items": T.ArrayType(T.StringType())}


def scan(docs: DataFrame, benchmark: DataFrame, keep: list[str], shard_words: int = SHARD_WORDS, *, then: tuple | None = None) -> DataFrame:
    """The columns `keep` with n_words, the hit word spans (starts, ends) and the item ids found. then: a function of batches of these and the
    schema of what it gives; it runs in the worker of the scan where one scan takes all items."""
    spark = docs.sparkSession

    def part(autos_b, cols: list[str], source: DataFrame, then: tuple | None = None) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in small_batches(batches):
                got = list(scan_texts(autos_b.value, text_bytes(b)))
                yield pa.RecordBatch.from_arrays(
                    [
                        *(column(b, k) for k in cols),
                        pa.array([g[0] for g in got], pa.int64()),
                        pa.array([[s for s, _ in g[1]] for g in got], pa.list_(pa.int32())),
                        pa.array([[e for _, e in g[1]] for g in got], pa.list_(pa.int32())),
                        pa.array([sorted(g[2]) for g in got], pa.list_(pa.string())),
                    ],
                    names=[*cols, "n_words", "starts", "ends", "items"],
                )

        f, schema = then or (iter, with_fields(source, cols, **FOUND))
        return source.select(*dict.fromkeys([*cols, "text"])).mapInArrow(tidy(lambda batches: f(run(batches))), schema)

    autos = map(Automaton, load_items(benchmark, shard_words))
    first, second = list(islice(autos, AT_ONCE)) or [Automaton([])], next(autos, None)
    if second is None:
        return part(spark.sparkContext.broadcast(first), keep, docs, then)
    # more items than one scan takes: what each finds is written, and joined by row
    rows = docs.select(*keep, "text") if "text" not in keep else docs.select(*keep)
    rows = rows.withColumn("_row", F.sha2(F.to_json(F.struct(*rows.columns)), 256))
    found, group = None, first
    autos = chain([second], autos)
    while group:
        autos_b = spark.sparkContext.broadcast(group)
        got = written(part(autos_b, ["_row"], rows).where(F.size("items") > 0), "hits")
        autos_b.destroy()
        found, group = got if found is None else found.union(got), list(islice(autos, AT_ONCE))
    found = found.groupBy("_row").agg(F.flatten(F.collect_set(F.arrays_zip("starts", "ends"))).alias("z"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    found = found.select("_row", F.col("z.starts").alias("starts"), F.col("z.ends").alias("ends"), "items")
    counted = part(spark.sparkContext.broadcast([Automaton([])]), [*keep, "_row"], rows).drop("starts", "ends", "items")
    none = F.array().cast("array<int>")
    all_ = counted.join(found, "_row", "left").select(*keep, "n_words", F.coalesce("starts", none).alias("starts"), F.coalesce("ends", none).alias("ends"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))
    return all_.mapInArrow(*then) if then else all_


def merged(starts, ends) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(zip(starts, ends)):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def n_hit(starts: str = "starts", ends: str = "ends"):
    """Words covered by the spans, overlaps once."""
    z = F.array_sort(F.arrays_zip(F.col(starts).alias("starts"), F.col(ends).alias("ends")))
    zero = F.struct(F.lit(0).alias("to"), F.lit(0).alias("n"))
    step = lambda a, s: F.struct(F.greatest(a["to"], s["ends"]).alias("to"), (a["n"] + F.greatest(F.lit(0), s["ends"] - F.greatest(a["to"], s["starts"]))).alias("n"))
    return F.aggregate(z, zero, step, lambda a: a["n"].cast("long"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = scan(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"), ["doc_id"])
    out = got.select("doc_id", "n_words", n_hit().alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"))
    return out.withColumn("contaminated", F.col("n_hit") > 0)


_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def cut(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the words of the spans (in order, apart) and what stands between them."""
    out, last, words = [], 0, enumerate(_WORD.finditer(text))
    for a, b in spans:
        begin = next(m.start() for i, m in words if i == a) if b - a > 1 else None
        m = next(m for i, m in words if i == b - 1)
        out.append(text[last : m.start() if begin is None else begin])
        last = m.end()
    return b"".join([*out, text[last:]])


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str, drop_coverage: float = DROP_COVERAGE) -> DataFrame:
    """Pipeline stage: documents of which half or more is hit go; of others the hit spans are cut out and n_chars is set anew."""
    cols = docs.columns
    rows = docs.select(F.struct(*cols).alias("doc"), "text")  # columns of any name pass through as one

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            doc = column(b, "doc")
            texts, keep = doc.field("text").to_pylist(), []
            for i, (n, s, e) in enumerate(zip(*(column(b, c).to_pylist() for c in ("n_words", "starts", "ends")))):
                spans = merged(s, e)
                hit = sum(y - x for x, y in spans)
                keep.append(hit == 0 or hit < drop_coverage * n)
                if spans and keep[-1]:
                    texts[i] = cut(texts[i].encode(), spans).decode()
            yield pa.RecordBatch.from_arrays([(pa.array(texts, pa.string()) if k == "text" else doc.field(k)).filter(pa.array(keep, pa.bool_())) for k in cols], names=cols)

    changed = scan(rows, table(spark, sf_dir, "benchmark", "item_id", "text"), ["doc"], then=(run, docs.schema))
    return changed.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType)) if "n_chars" in cols else changed


_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
ORACLE = rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), i AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), win AS (
  SELECT item_id, n, array_to_string(list_slice(w, p, p + n - 1), ' ') AS s
  FROM (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS p FROM i WHERE len(w) > 0)
), ns AS (SELECT DISTINCT n FROM win), dw AS (
  SELECT doc_id, n, p, array_to_string(list_slice(w, p, p + n - 1), ' ') AS s
  FROM (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS p FROM d, ns WHERE len(w) >= n)
), hits AS (
  SELECT DISTINCT dw.doc_id, dw.p, dw.n, win.item_id FROM dw JOIN win ON dw.n = win.n AND dw.s = win.s
), h AS (
  SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS k FROM hits) GROUP BY doc_id
), it AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS ids FROM hits GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(it.n_items, 0) AS n_items,
       sha256(coalesce(it.ids, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN it USING (doc_id)
"""
