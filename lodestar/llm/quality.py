"""Quality classifier: a byte-level convolutional network in numpy.

Texts are cut into overlapping chunks of 32 bytes, one every 8 bytes, up to the last byte. Each byte gives a learned embedding. Learned
filters run over every chunk, their responses are max-pooled over the whole document, and a hidden layer combines the maxima into one
probability. Long texts go through in pieces with a running maximum, so memory does not grow with them; training reads whole texts too.

Defined results: a null or empty text is scored as 32 padding bytes; repeated rows are scored each; a table without usable labels
gives the neutral model, 0.5 everywhere; null labels are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.llm._base import column, hash_sample, held_out, small_batches, table, text_bytes, with_fields

STEP = 8  # bytes from one chunk to the next
BLOCKS = 4  # a chunk is BLOCKS * STEP bytes
EMBED = 4
FILTERS = 24
HIDDEN = 12
#: At most so many labelled rows train the network, those of the smallest hash.
TRAIN_ROWS = 4000
#: And of these as many, in order of the hash, as hold so many bytes.
TRAIN_BYTES = 64 << 20
#: Chunks that go through at once.
PIECE = 1 << 16
THRESHOLD = 0.3


@dataclass
class Network:
    embed: np.ndarray  # 256 x EMBED
    conv: np.ndarray  # BLOCKS x STEP*EMBED x FILTERS
    conv_b: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray

    def arrays(self) -> list[np.ndarray]:
        return [self.embed, self.conv, self.conv_b, self.w1, self.b1, self.w2, self.b2]


def new_network(seed: int = 7) -> Network:
    r = np.random.default_rng(seed)
    f = np.float32
    width = STEP * EMBED
    return Network(
        r.normal(0, 0.5, (256, EMBED)).astype(f), r.normal(0, (BLOCKS * width) ** -0.5, (BLOCKS, width, FILTERS)).astype(f), np.zeros(FILTERS, f),
        r.normal(0, FILTERS**-0.5, (FILTERS, HIDDEN)).astype(f), np.zeros(HIDDEN, f), np.zeros(HIDDEN, f) + r.normal(0, HIDDEN**-0.5, HIDDEN).astype(f), np.zeros(1, f),
    )


def pieces(texts: list[bytes], most: int) -> Iterator[list[tuple[int, bytes, int]]]:
    """Groups of (text, bytes, chunks) of up to `most` chunks: all chunks of all texts, those of a long text over several groups."""
    group, total = [], 0
    for i, t in enumerate(texts):
        chunks = max(BLOCKS, -(-len(t) // STEP)) - BLOCKS + 1
        for at in range(0, chunks, most):
            n = min(most, chunks - at)
            if total + n > most and group:
                yield group
                group, total = [], 0
            group.append((i, t[at * STEP : (at + n + BLOCKS - 1) * STEP], n))
            total += n
    if group:
        yield group


def layout(group: list[tuple[int, bytes, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pieces padded to whole blocks in one byte array, and the first block and the number of chunks of each."""
    chunks = np.array([n for _, _, n in group], np.int64)
    first = np.cumsum(chunks + BLOCKS - 1) - chunks - BLOCKS + 1
    out = np.zeros(int((chunks + BLOCKS - 1).sum()) * STEP, np.uint8)
    for (_, t, _), at in zip(group, first * STEP):
        out[at : at + len(t)] = np.frombuffer(t, np.uint8)
    return out, first, chunks


def responses(net: Network, x: np.ndarray) -> np.ndarray:
    """Filter responses of the chunk that starts at each block (those over the end are not valid)."""
    n = len(x) // STEP
    rows = net.embed[x].reshape(n, -1)
    out = rows @ net.conv[0]
    for b in range(1, BLOCKS):
        out[: n - b] += rows[b:] @ net.conv[b]
    return out


def pooled(net: Network, texts: list[bytes], where: bool = False, most: int = PIECE):
    """The largest response of each filter in each text; with `where` also the bytes of the chunk that gave it."""
    top = np.full((len(texts), FILTERS), -np.inf, np.float32)
    win = np.zeros((len(texts), FILTERS, BLOCKS * STEP), np.uint8) if where else None
    for group in pieces(texts, most):
        x, first, chunks = layout(group)
        r = responses(net, x)
        for (i, _, _), f, c in zip(group, first, chunks) if where else ():
            at = f + r[f : f + c].argmax(0)
            better = r[at, np.arange(FILTERS)] > top[i]
            win[i, better] = x[at[better, None] * STEP + np.arange(BLOCKS * STEP)]
            top[i, better] = r[at[better], np.flatnonzero(better)]
        if not where:
            ends = np.stack([first, first + chunks], 1).ravel()
            best = np.maximum.reduceat(np.vstack([r, r[-1:]]), ends, axis=0)[::2]
            np.maximum.at(top, [i for i, _, _ in group], best)
    return (top, win) if where else top


def head(net: Network, top: np.ndarray):
    a = np.tanh(top + net.conv_b)
    h = np.tanh(a @ net.w1 + net.b1)
    return a, h, 1 / (1 + np.exp(-(h @ net.w2 + net.b2).astype(np.float64)))


def train(texts: list[bytes], y: np.ndarray, steps: int = 500, batch: int = 32, rate: float = 0.01, seed: int = 7) -> Network:
    """Adam on the log loss; the gradient of a maximum goes to the chunk that gave it. Half of each batch is of either class, and
    the bias is set back to the true shares at the end, so the score stays a probability."""
    net = new_network(seed)
    groups = [np.flatnonzero(y == v) for v in (0, 1)]
    if not len(groups[0]) or not len(groups[1]):
        net.w2[:] = 0
        return net
    rng = np.random.default_rng(seed)
    params = net.arrays()
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, steps + 1):
        pick = np.concatenate([rng.choice(g, batch // 2) for g in groups])
        top, win = pooled(net, [texts[i] for i in pick], True)
        a, h, p = head(net, top)
        d = ((p - y[pick]) / batch).astype(np.float32)
        g_w2, g_b2 = h.T @ d, d.sum(keepdims=True)
        dh = np.outer(d, net.w2) * (1 - h * h)
        g_w1, g_b1 = a.T @ dh, dh.sum(0)
        da = (dh @ net.w1.T) * (1 - a * a)
        g_cb = da.sum(0)
        g_conv, g_embed = np.zeros_like(net.conv), np.zeros_like(net.embed)
        g = np.einsum("dk,dkbc->kbc", da, net.embed[win])
        g_conv[:] = g.reshape(FILTERS, BLOCKS, STEP * EMBED).transpose(1, 2, 0)
        w = net.conv.transpose(2, 0, 1).reshape(FILTERS, BLOCKS * STEP, EMBED)
        back = da[:, :, None, None] * w[None]
        flat = win.ravel()
        for e in range(EMBED):
            g_embed[:, e] = np.bincount(flat, back[..., e].ravel(), 256)
        for k, (q, gr) in enumerate(zip(params, [g_embed, g_conv, g_cb, g_w1, g_b1, g_w2, g_b2])):
            gr = gr + 1e-4 * q
            m[k] = 0.9 * m[k] + 0.1 * gr
            v[k] = 0.999 * v[k] + 0.001 * gr * gr
            lr = rate * min(1.0, 2 * (1 - step / (steps + 1)))
            q -= (lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    net.b2 += np.float32(np.log(len(groups[1]) / len(groups[0])))
    return net


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = TRAIN_ROWS) -> Network:
    """Train on at most `rows` labelled rows, of TRAIN_BYTES at most, outside the held-out fold (crc32 mod 5 = 0): those of the smallest hashes of doc_id."""
    known = labels.select("doc_id", F.col(label).alias("_y")).where(F.col("_y").isin(0, 1) & ~held_out(F.col("doc_id"), 0))
    known = known.groupBy("doc_id").agg(F.min("_y").alias("_y"))
    known = hash_sample(known, rows, labels.count())
    got = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("_y").alias("_y"))
    before = F.sum(F.coalesce(F.octet_length("text").cast("long"), F.lit(0))).over(Window.orderBy(F.xxhash64("doc_id"), "doc_id"))  # `rows` rows at most
    got = got.withColumn("_b", before).where(F.col("_b") <= TRAIN_BYTES).drop("_b").toArrow().sort_by("doc_id")
    texts = [(t or "").encode() for t in got.column("text").to_pylist()]
    return train(texts, np.array(got.column("_y").to_pylist(), np.int64))


def score_texts(net: Network, texts: list[bytes]) -> np.ndarray:
    return head(net, pooled(net, texts))[2] if texts else np.zeros(0)


def scored(docs: DataFrame, net: Network, keep: list[str], threshold: float = THRESHOLD) -> DataFrame:
    """The columns `keep` with score and predicted; every byte of every text is read."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches, 1 << 20):
            s = score_texts(net, text_bytes(b, "text"))
            yield pa.RecordBatch.from_arrays([*(column(b, k) for k in keep), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=[*keep, "score", "predicted"])

    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, with_fields(docs, keep, score=T.DoubleType(), predicted=T.IntegerType()))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    net = fit(docs, table(spark, sf_dir, "labels"))
    out = scored(docs, net, ["doc_id"])
    return out.select("doc_id", F.coalesce(held_out(F.col("doc_id"), 0), F.lit(False)).alias("held_out"), "score", "predicted")


def reject_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents scored under the threshold go."""
    net = fit(docs, table(spark, sf_dir, "labels"))
    rows = docs.select(F.struct(*docs.columns).alias("doc"), "text")  # columns of any name pass through as one
    return scored(rows, net, ["doc"]).where("predicted = 1").select("doc.*")
