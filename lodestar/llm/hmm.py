"""LM scoring: a hidden Markov language model over words.

Symbols: the most frequent words, classes of all other words (by hash of their last three bytes), and the end of text. A word within a
class has its smoothed share of the class, so the model gives every word a probability. Baum-Welch: each pass reads all training
documents, tasks add up expected counts, and the sums over all tasks give the next model. Nothing is learned from a sample. Scores are
exact: a scaled forward recursion over each whole text.

Word counts cover all training documents. Only the most frequent, HEAD_WORDS at most, go to tasks; for rarer words each task sends one row per
word and pack of texts, which meets the count of the word in a join, so nothing that grows with the vocabulary is broadcast. Texts are
turned into symbols once; passes and scoring read those.

Texts are never cut. Those longer than LONG tokens go through in blocks of SEGMENT: the product of a block's matrices gives exactly what comes
into the next block from the left and into the last from the right, so all blocks run side by side, transitions between them included.

Defined results: null and empty texts are the end token alone; repeated rows are counted and scored each; a null doc_id counts as
training; with no training documents every word is unknown and all symbols are equally likely.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm._base import column, held_out, most_frequent, pieces, shuffle_parts, small_batches, table, text_bytes, written

STATES = 8
SYMBOL_WORDS = 8192
CLASSES = 1024
HEAD_WORDS = 131_072
LONG, SEGMENT = 1 << 14, 1024
#: Tokens that go through forward-backward side by side.
AT_ONCE = 1 << 20
PASSES = 5
PRIOR = 50.0
SYMBOL = np.uint16  # SYMBOL_WORDS + CLASSES + 1 of them
FLUSH_WORDS = 200_000


def word_class(w: bytes) -> int:
    return zlib.crc32(w[-3:]) % CLASSES


def tokens_of(text: bytes) -> list[bytes]:
    return text.lower().split()


@dataclass
class Vocabulary:
    """words: the most frequent with their counts, first those that are symbols. n, v: tokens and distinct tokens, end included."""

    words: list[bytes]
    counts: np.ndarray
    n: int
    v: int
    ends: int
    class_n: np.ndarray  # tokens of the words of each class (symbol words left out)
    class_v: np.ndarray
    index: dict[bytes, int] = field(default_factory=dict)

    def __getstate__(self):
        return self.__dict__ | {"index": {}}

    def ready(self) -> Vocabulary:
        if len(self.index) != len(self.words):
            self.index = {w: i for i, w in enumerate(self.words)}
            self.symbol = np.array([i if i < SYMBOL_WORDS else SYMBOL_WORDS + word_class(w) for i, w in enumerate(self.words)], np.int32)
            self.log_count = np.log10(self.counts + 0.5)
        return self

    @property
    def end(self) -> int:
        return SYMBOL_WORDS + CLASSES

    def class_total(self) -> np.ndarray:
        return self.class_n + 0.5 * (self.class_v + 1)

    def unigram(self) -> np.ndarray:
        """Shares of the symbols; unused word symbols have none."""
        k = min(len(self.words), SYMBOL_WORDS)
        p = np.zeros(SYMBOL_WORDS + CLASSES + 1)
        p[:k] = self.counts[:k] + 0.5
        p[SYMBOL_WORDS : self.end] = self.class_total()
        p[self.end] = self.ends + 0.5
        return p / p.sum()


@dataclass
class Model:
    start: np.ndarray
    step: np.ndarray  # STATES x STATES
    emit: np.ndarray  # symbols x STATES


def word_counts(docs: DataFrame) -> DataFrame:
    """w and n: how often each word occurs in docs, added up in tasks first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        pack = lambda: pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["w", "n"])
        for b in small_batches(batches):
            for t in (x for t in text_bytes(b) for x in pieces(t)):
                seen.update(tokens_of(t))
                if len(seen) > FLUSH_WORDS:
                    yield pack()
                    seen = Counter()
        if seen:
            yield pack()

    return docs.select("text").mapInArrow(run, "w binary, n long").groupBy("w").agg(F.sum("n").alias("n"))


def vocabulary(counts: DataFrame, ends: int) -> Vocabulary:
    cls = F.crc32(F.substring("w", -3, 3)) % CLASSES
    by_class = counts.groupBy(cls.cast("int").alias("k")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).collect()
    top = most_frequent(counts, HEAD_WORDS).toArrow().sort_by([("n", "descending"), ("w", "ascending")])
    words, c = top.column("w").to_pylist(), top.column("n").to_numpy().astype(np.int64)
    class_n, class_v = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in by_class:
        class_n[r.k], class_v[r.k] = r.n, r.v
    n, v = int(class_n.sum()) + ends, int(class_v.sum()) + (ends > 0)
    for w, k in zip(words[:SYMBOL_WORDS], c):
        class_n[word_class(w)] -= k
        class_v[word_class(w)] -= 1
    return Vocabulary(words, c, n, v, ends, class_n, class_v)


@dataclass
class Blocks:
    """Sequences of one width (padded by -1), longest first, with what comes into them: the state before the first token, the weight of
    what follows the last, and the state after the last token of the block before (0: there is none)."""

    seqs: np.ndarray
    lengths: np.ndarray
    left: np.ndarray
    right: np.ndarray
    before: np.ndarray


def products(m: Model, seqs: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each block the product of its matrices, from the state before the first token to that of the last, and its log10 scale."""
    out = np.broadcast_to(np.eye(STATES), (len(seqs), STATES, STATES)).copy()
    log = np.zeros(len(seqs))
    live = np.searchsorted(-lengths, -np.arange(seqs.shape[1]), side="left")
    for t, k in enumerate(live.tolist()):
        x = out[:k] if t == 0 else out[:k] @ m.step
        x = x * m.emit[seqs[:k, t], None, :]
        s = x.sum((1, 2))
        out[:k] = x / s[:, None, None]
        log[:k] += np.log10(s)
    return out, log


def padded(cuts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.array([len(c) for c in cuts], np.int64)
    seqs = np.full((len(cuts), int(lengths.max(initial=0))), -1, np.int32)
    for i, c in enumerate(cuts):
        seqs[i, : len(c)] = c
    return seqs, lengths


def through(m: Model, seq: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Left, right and before of each block of a long text, and log10 of its probability."""
    cuts = [seq[k : k + SEGMENT] for k in range(0, len(seq), SEGMENT)]
    parts = [products(m, *padded(cuts[k : k + 4096])) for k in range(0, len(cuts), 4096)]
    mats, total = np.concatenate([p[0] for p in parts]), sum(float(p[1].sum()) for p in parts)
    left, right, before = np.zeros((len(cuts), STATES)), np.ones((len(cuts), STATES)), np.zeros((len(cuts), STATES))
    a = m.start
    for b, x in enumerate(mats):
        left[b] = a
        end = a @ x
        total += math.log10(end.sum())
        end = end / end.sum()
        if b + 1 < len(cuts):
            before[b + 1] = end
            a = end @ m.step
    for b in range(len(cuts) - 2, -1, -1):
        r = m.step @ (mats[b + 1] @ right[b + 1])
        right[b] = r / r.sum()
    return left, right, before, total


def blocks(m: Model, symbols: list[np.ndarray]) -> Iterator[Blocks]:
    """The texts' symbols, none cut off from what is around it, AT_ONCE tokens at most at once, padding included."""
    rows = []
    for s in symbols:
        if len(s) <= LONG:
            rows.append((s, m.start, np.ones(STATES), np.zeros(STATES)))
        else:
            left, right, before, _ = through(m, s)
            rows += [(s[k * SEGMENT : (k + 1) * SEGMENT], left[k], right[k], before[k]) for k in range(len(left))]
    rows.sort(key=lambda c: -len(c[0]))
    k = 0
    while k < len(rows):
        part = rows[k : k + max(1, min(4096, AT_ONCE // len(rows[k][0])))]
        yield Blocks(*padded([r[0] for r in part]), *(np.array([r[i] for r in part]) for i in (1, 2, 3)))
        k += len(part)


class Counts:
    """Expected counts of one or more tasks."""

    def __init__(self, n_symbols: int):
        self.start, self.step, self.emit = np.zeros(STATES), np.zeros((STATES, STATES)), np.zeros((n_symbols, STATES))

    def add(self, m: Model, b: Blocks) -> None:
        """Forward-backward over the blocks."""
        seqs, width, n = b.seqs, b.seqs.shape[1], len(b.seqs)
        alpha = np.zeros((width, n, STATES), np.float32)
        scale = np.ones((width, n), np.float32)
        emit, step = m.emit.astype(np.float32), m.step.astype(np.float32)
        live = np.searchsorted(-b.lengths, -np.arange(width), side="left")  # blocks longer than t
        a = b.left.astype(np.float32)
        for t in range(width):
            k = live[t]
            a = (a if t == 0 else a[:k] @ step) * emit[seqs[:k, t]]
            s = a.sum(1)
            a /= s[:, None]
            alpha[t, :k], scale[t, :k] = a, s
        last = alpha[b.lengths - 1, np.arange(n)]
        beta = b.right / (last * b.right).sum(1)[:, None]
        beta = beta.astype(np.float32)
        gammas, syms = [], []
        for t in range(width - 1, -1, -1):
            k = live[t]
            if t + 1 < width and (q := live[t + 1]):
                out = beta[:q] * emit[seqs[:q, t + 1]] / scale[t + 1, :q, None]
                self.step += (alpha[t, :q].T @ out) * step
                beta[:q] = out @ step.T
            gammas.append(alpha[t, :k] * beta[:k])
            syms.append(seqs[:k, t])
        g, x = np.concatenate(gammas), np.concatenate(syms)
        for s in range(STATES):
            self.emit[:, s] += np.bincount(x, g[:, s], len(self.emit))
        first = ~b.before.any(1)
        self.start += gammas[-1][first].sum(0)
        if not first.all():  # the step from the block before
            into = emit[seqs[~first, 0]] * beta[~first]
            from_ = b.before[~first]
            into = into / (from_ @ step * into).sum(1)[:, None]
            self.step += (from_.T @ into) * step

    def model(self, prior: np.ndarray) -> Model:
        emit = self.emit + PRIOR * prior[:, None]
        return Model((self.start + 1) / (self.start + 1).sum(), (self.step + 1) / (self.step + 1).sum(1, keepdims=True), emit / emit.sum(0))


def random_model(prior: np.ndarray) -> Model:
    rng = np.random.default_rng(11)
    emit = prior[:, None] * rng.gamma(2.0, 0.5, (len(prior), STATES)) + 1e-12 * prior[:, None]
    return Model(np.full(STATES, 1 / STATES), 0.9 * np.eye(STATES) + 0.1 / STATES, emit / emit.sum(0))


def unpacked(b: pa.RecordBatch) -> list[np.ndarray]:
    return [np.frombuffer(x, SYMBOL) for x in column(b, "sym").to_pylist()]


def baum_welch_pass(train: DataFrame, prior: np.ndarray, model: Model) -> Model:
    """One pass over all rows of train (sym): tasks add up expected counts, then the counts of all tasks are added up."""
    n_symbols = SYMBOL_WORDS + CLASSES + 1
    model_b = train.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, any_, m = Counts(n_symbols), False, model_b.value
        for b in small_batches(batches, 8 << 20, 20_000, "sym"):
            any_ = True
            for block in blocks(m, unpacked(b)):
                c.add(m, block)
        if any_:
            flat = np.concatenate([c.start, c.step.ravel(), c.emit.ravel()])
            k = np.flatnonzero(flat)
            piece = k // 4096
            at = np.flatnonzero(np.diff(piece, prepend=-1))
            ends = np.append(at[1:], len(k))
            yield pa.RecordBatch.from_arrays(
                [pa.array(piece[at]), pa.array([k[i:j].tolist() for i, j in zip(at, ends)], pa.list_(pa.int64())), pa.array([flat[k[i:j]].tolist() for i, j in zip(at, ends)], pa.list_(pa.float64()))],
                names=["piece", "k", "v"],
            )

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for piece, k, v in zip(column(b, "piece").to_pylist(), column(b, "k"), column(b, "v")):
                total = sums.setdefault(piece, np.zeros(4096))
                total[k.values.to_numpy() % 4096] += v.values.to_numpy()
        for piece, total in sums.items():
            k = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([piece], pa.int64()), pa.array([(k + piece * 4096).tolist()], pa.list_(pa.int64())), pa.array([total[k].tolist()], pa.list_(pa.float64()))], names=["piece", "k", "v"])

    schema = "piece long, k array<long>, v array<double>"
    sums = train.select("sym").mapInArrow(run, schema)
    # in two steps, so that no task adds up what all tasks send
    sums = sums.repartition(shuffle_parts(train.sparkSession), "piece", F.pmod(F.spark_partition_id(), F.lit(16))).mapInArrow(add, schema)
    sums = sums.repartition(min(16, shuffle_parts(train.sparkSession)), "piece").mapInArrow(add, schema)
    flat = np.zeros(-(-(STATES + STATES**2 + STATES * n_symbols) // 4096) * 4096)
    for r in sums.collect():  # as many numbers as the model has
        flat[r.k] = r.v
    c = Counts(n_symbols)
    c.start, c.step = flat[:STATES], flat[STATES : STATES + STATES**2].reshape(STATES, STATES)
    c.emit = flat[STATES + STATES**2 :][: STATES * n_symbols].reshape(n_symbols, STATES)
    model_b.destroy()
    return c.model(prior)


@dataclass
class Fitted:
    """The model, the count of each word, and the encoded rows of all documents."""

    voc: Vocabulary
    model: Model
    counts: DataFrame
    rows: DataFrame


def fit(docs: DataFrame) -> Fitted:
    """Vocabulary and model from the rows of docs (doc_id, text, train) where train is true; all rows are encoded."""
    learned = docs.where("train")
    counts = written(word_counts(learned), "lm-counts")
    n = learned.count()
    voc = vocabulary(counts, n)
    rows = encode(docs, voc)
    train, prior = rows.where("train and row is not null"), voc.unigram()
    model = random_model(prior)
    for _ in range(PASSES):
        model = baum_welch_pass(train, prior, model)
    return Fitted(voc, model, counts, rows)


def forward(model: Model, seqs: list[np.ndarray]) -> np.ndarray:
    """log10 of the probability of each sequence: the scaled forward recursion, all texts side by side, longest first, the blocks of long ones too."""
    long = [i for i, s in enumerate(seqs) if len(s) > LONG]
    if long:
        out = np.zeros(len(seqs))
        out[long] = [through(model, seqs[i])[3] for i in long]
        rest = np.setdiff1d(np.arange(len(seqs)), long)
        out[rest] = forward(model, [seqs[i] for i in rest]) if len(rest) else 0
        return out
    order = np.argsort([-len(s) for s in seqs], kind="stable")
    lengths = np.array([len(seqs[i]) for i in order], np.int64)
    flat = np.concatenate([seqs[i] for i in order])
    at = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    live = np.searchsorted(-lengths, -np.arange(lengths[0]), side="left")
    total = np.zeros(len(seqs))
    a = np.broadcast_to(model.start, (len(seqs), STATES))
    for t in range(lengths[0]):
        k = live[t]
        a = (a if t == 0 else a[:k] @ model.step) * model.emit[flat[at[:k] + t]]
        s = a.sum(1)
        a /= s[:, None]
        total[:k] += np.log10(s)
    out = np.zeros(len(seqs))
    out[order] = total
    return out


ROW_SCHEMA = "row long, doc_id {}, train boolean, n_tokens long, n_known long, base double, extra double, sym binary, w binary, at binary, times binary"


class Encoded:
    """Texts as symbols, with the sums over their frequent words and the places of rarer ones; many texts go through at once."""

    def __init__(self, v: Vocabulary, texts: list[bytes], at_once: int = 1 << 18):
        k = len(texts)
        self.v, self.log_class = v, np.log10(v.class_total())
        self.n_tokens, self.known = np.ones(k, np.int64), np.full(k, int(v.ends > 0), np.int64)
        self.base, self.extra = np.full(k, math.log10(v.ends + 0.5)), np.zeros(k)
        self.rare: dict[bytes, int] = {}
        self.rare_class: list[int] = []
        self.rare_word, self.rare_text, parts = [], [], [[] for _ in texts]
        words, text, size = [], [], []
        for i, t in enumerate(texts):
            for p in pieces(t):
                w = tokens_of(p)
                words += w
                text.append(i)
                size.append(len(w))
                if len(words) >= at_once:
                    self._add(words, text, size, parts)
                    words, text, size = [], [], []
        self._add(words, text, size, parts)
        end = np.array([v.end], SYMBOL)
        self.seqs = [np.concatenate([*p, end]) for p in parts]

    def _add(self, words: list[bytes], text: list[int], size: list[int], parts: list[list[np.ndarray]]) -> None:
        v, n = self.v, len(self.base)
        head = np.fromiter(map(v.index.get, words, repeat(-1)), np.int64, len(words))
        of = np.repeat(np.array(text, np.int64), size)
        sym = np.zeros(len(words), np.int32)
        hit = head >= 0
        if len(v.words):
            sym[hit] = v.symbol[head[hit]]
        logs = v.log_count[head[hit]] if len(v.words) else np.zeros(0)
        far = np.flatnonzero(~hit)
        rare = np.empty(len(far), np.int64)
        for j, i in enumerate(far.tolist()):
            w = words[i]
            got = self.rare.get(w)
            if got is None:
                got = self.rare[w] = len(self.rare)
                self.rare_class.append(word_class(w))
            rare[j] = got
        sym[far] = SYMBOL_WORDS + np.array(self.rare_class, np.int32)[rare] if len(far) else 0
        self.rare_word.append(rare)
        self.rare_text.append(of[far])
        add = lambda at, w=None: np.bincount(at, w, n)
        self.n_tokens += add(of)
        self.known += add(of[hit])
        self.base += add(of[hit], logs)
        inside = head[hit] >= SYMBOL_WORDS
        cls = sym >= SYMBOL_WORDS
        self.extra += add(of[hit][inside], logs[inside]) - add(of[cls], self.log_class[sym[cls] - SYMBOL_WORDS])
        sym = sym.astype(SYMBOL)
        ends = np.cumsum(size)
        for i, a, b in zip(text, ends - size if len(size) else (), ends):
            parts[i].append(sym[a:b])


def encode(docs: DataFrame, voc: Vocabulary) -> DataFrame:
    """A row for each of docs (doc_id, text, train) with its symbols and the sums over its frequent words, and rows of rarer words: w, at (rows), times."""
    voc_b = docs.sparkSession.sparkContext.broadcast(voc)
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = [f.split()[0] for f in ROW_SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = voc_b.value.ready()
        row = TaskContext.get().partitionId() << 40
        for b in small_batches(batches, 8 << 20, 20_000):
            texts = text_bytes(b)
            e, k = Encoded(v, texts), len(texts)
            ids = np.arange(row, row + k)
            row += k
            none = lambda n, *c: [pa.nulls(n, t) for t in c]
            cols = [pa.array(ids), column(b, "doc_id"), column(b, "train"), *map(pa.array, (e.n_tokens, e.known, e.base, e.extra)), pa.array([x.tobytes() for x in e.seqs], pa.binary())]
            yield pa.RecordBatch.from_arrays([*cols, *none(k, *[pa.binary()] * 3)], names=names)
            if e.rare:
                key = np.concatenate(e.rare_word) * k + np.concatenate(e.rare_text)
                key, times = np.unique(key, return_counts=True)
                word, doc = np.divmod(key, k)
                cut = np.searchsorted(word, np.arange(len(e.rare) + 1))
                at_b, times_b = ids[doc].tobytes(), times.astype(np.int32).tobytes()
                found = [list(e.rare), [at_b[8 * i : 8 * j] for i, j in zip(cut[:-1], cut[1:])], [times_b[4 * i : 4 * j] for i, j in zip(cut[:-1], cut[1:])]]
                yield pa.RecordBatch.from_arrays([*none(len(e.rare), *(c.type for c in cols)), *(pa.array(c, pa.binary()) for c in found)], names=names)

    return written(docs.select("doc_id", "text", "train").mapInArrow(run, ROW_SCHEMA.format(kind)), "lm-rows")


def scored(fitted: Fitted) -> DataFrame:
    """doc_id, train, n_tokens, n_known, base_score and score of every document."""
    voc, rows, counts = fitted.voc, fitted.rows, fitted.counts
    model_b = rows.sparkSession.sparkContext.broadcast(fitted.model)
    kept = ["row", "doc_id", "train", "n_tokens", "n_known", "base"]
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches, 8 << 20, 20_000, "sym"):
            score = forward(model_b.value, unpacked(b)) + column(b, "extra").to_numpy()
            yield pa.RecordBatch.from_arrays([*(column(b, c) for c in kept), pa.array(score)], names=[*kept, "score"])

    each = rows.where("row is not null").select(*kept, "extra", "sym").mapInArrow(run, f"row long, doc_id {kind}, train boolean, n_tokens long, n_known long, base double, score double")
    rare = rows.where("w is not null").select("w", "at", "times").join(counts, "w", "left").select("at", "times", F.coalesce("n", F.lit(0)).alias("n"))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = column(b, "at").to_pylist()
            size = np.array([len(x) // 8 for x in at], np.int64)
            if not size.sum():
                continue
            row = np.frombuffer(b"".join(at), np.int64)
            times = np.frombuffer(b"".join(column(b, "times").to_pylist()), np.int32)
            n = np.repeat(column(b, "n").to_numpy(), size)
            u, inv = np.unique(row, return_inverse=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(u), pa.array(np.bincount(inv, times * np.log10(n + 0.5))), pa.array(np.bincount(inv, times * (n > 0)).astype(np.int64))], names=["r", "logs", "seen"]
            )

    far = rare.mapInArrow(spread, "r long, logs double, seen long").groupBy("r").agg(F.sum("logs").alias("logs"), F.sum("seen").alias("seen"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    out = each.join(far, F.col("row") == F.col("r"), "left")
    d = math.log10(voc.n + 0.5 * (voc.v + 1))
    return out.select(
        "doc_id", "train", "n_tokens", (F.col("n_known") + zero("seen")).cast("long").alias("n_known"),
        (F.col("base") + F.coalesce("logs", F.lit(0.0)) - F.lit(d) * F.col("n_tokens")).alias("base_score"), (F.col("score") + F.coalesce("logs", F.lit(0.0))).alias("score"),
    )


def op4_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    out = F.coalesce(held_out(F.col("doc_id"), 1), F.lit(False))
    fitted = fit(docs.select("doc_id", "text", (~out).alias("train")))
    return scored(fitted).select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", F.lit(fitted.voc.n).cast("long").alias("train_tokens"), "base_score", "score")
