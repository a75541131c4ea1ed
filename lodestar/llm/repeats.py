"""Suffix-array dedup: exact repeats of 100 bytes, by threshold-bounded interval expansion on a Burrows-Wheeler transform.

Every byte goes that a 100-byte string covers which also starts earlier (smaller doc_id, or earlier in the same document).

1. Anchors. In each 100-byte window the 24-byte gram of the least hash is its anchor, so equal windows have equal anchors at equal
   places. An anchor's context is what the windows that have it cover, at most 176 bytes. Hashes only route: contexts whose anchors
   have one hash meet, and the transform decides on their bytes.
2. The transform (`repeats_in`) takes bounded packs of contexts. Contexts that are equal byte for byte are one row of text with several
   places. Rows are ordered as far as needed, then intervals are extended backward breadth-first, which gives the common prefixes of
   neighbouring rows by increasing value, up to 99. Rows that no such value separates agree in 100 bytes; all places but the
   earliest are repeats.
3. Tasks do so for the texts at hand, FLUSH_BYTES at a time, and deal one anchor of each context by its hash. Where anchors of several
   tasks have one hash, their contexts are fetched, meet in packs and are decided in the same way.

Anchor hashes that very many documents share are found on a 1/64 sample of the documents beforehand. Their windows are dealt by the
hash of all 100 bytes instead, so that a common line or passage is spread out and added up in the tasks first. That only changes how
rows are dealt; results are those of the other way.

Texts are read in pieces of PIECE bytes, so a long one takes no more memory than others.

Defined results: null is the empty text; texts under 100 bytes have no windows; rows of one doc_id are taken as one document; rows
without doc_id keep all bytes; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm._base import column, partition_keys, shuffle_parts, small_batches, table, text_bytes, written

LENGTH = 100
GRAM = 24
SPAN = LENGTH - GRAM + 1  # grams in a window
CONTEXT = LENGTH + SPAN - 1
DEPTH = 128  # rows are ordered by so many bytes
PACK_BYTES = 1_500_000
PIECE = 2 << 20
FLUSH_BYTES = 16 << 20
BUCKET_ANCHORS = 400_000
MOST_PARTS = 20_000  # tasks of a shuffle; each goes through its buckets one by one
ASKED = 50_000  # contexts that are cut from texts at once
HASH_BITS = 64  # fewer in a test of collisions
HOT_SHARE = 64  # 1 / share of the documents tell which anchors are hot
HOT_ROWS = 200_000
HOT_MOST = 1_000_000  # at most so many anchors are hot

_M = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def _mixer(k: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 2**63, (2, k), dtype=np.uint64) | np.uint64(1)


_MIX = {k: _mixer(k, k) for k in (CONTEXT // 8, 13)}


def hash_rows(rows: np.ndarray) -> np.ndarray:
    """64-bit hash of each row of bytes (a multiple of 8 wide)."""
    v = np.ascontiguousarray(rows).view(np.uint64)
    a, b = _MIX[v.shape[1]]
    y = (v ^ _M[1]) * a
    y ^= y >> np.uint64(31)
    y *= _M[0]
    y ^= y >> np.uint64(29)
    h = (y * b).sum(1)
    return (h ^ (h >> np.uint64(32))) * _M[2]


def gram_hashes(x: np.ndarray) -> np.ndarray:
    n = len(x) - GRAM + 1
    h = np.zeros(n, np.uint64)
    for j in range(GRAM // 8):
        y = np.ndarray((n,), "<u8", x.data, 8 * j, (1,)) * _M[j]
        y ^= y >> np.uint64(29)
        h += y
        h *= _M[2]
    h ^= h >> np.uint64(32)
    h *= _M[0]
    return h ^ (h >> np.uint64(29))


def sliding(a: np.ndarray, width: int, op) -> np.ndarray:
    """op over every window of that width, by doubling."""
    cur, size = a, 1
    while size * 2 <= width:
        cur = op(cur[:-size], cur[size:])
        size *= 2
    n = len(a) - width + 1
    return op(cur[:n], cur[width - size : width - size + n]) if size < width else cur[:n]


class Anchors:
    """Columns of anchors: hash of the gram, hash of the context, document, place, bytes of context before and from the place."""

    KINDS = (np.uint64, np.uint64, np.int64, np.uint32, np.uint8, np.uint8)

    def __init__(self, *cols: np.ndarray):
        self.h, self.g, self.doc, self.pos, self.before, self.after = cols

    def take(self, i) -> Anchors:
        return Anchors(*(c[i] for c in self.cols()))

    def cols(self):
        return self.h, self.g, self.doc, self.pos, self.before, self.after

    def __len__(self):
        return len(self.h)

    @staticmethod
    def join(parts: list[Anchors]) -> Anchors:
        return Anchors(*(np.concatenate(c) if parts else np.zeros(0, k) for c, k in zip(zip(*(p.cols() for p in parts)) if parts else [()] * 6, Anchors.KINDS)))

    def pack(self) -> bytes:
        """All but the hashes of contexts, which only sort what is at hand."""
        return b"".join(np.ascontiguousarray(c, k).tobytes() for c, k in zip(self.cols(), self.KINDS) if c is not self.g)

    @staticmethod
    def unpack(data: bytes) -> Anchors:
        n, at, out = len(data) // 22, 0, []
        for i, k in enumerate(Anchors.KINDS):
            size = n * np.dtype(k).itemsize * (i != 1)
            out.append(np.frombuffer(data[at : at + size], k) if size or i != 1 else np.zeros(n, k))
            at += size
        return Anchors(*out)


def anchors_of(texts: list[bytes], ids: np.ndarray, base: np.ndarray, hot: np.ndarray | None = None, bits: int = HASH_BITS) -> tuple[Anchors, np.ndarray, np.ndarray]:
    """The anchors of all windows of the texts, those of hot hashes as single windows; where in a buffer each stands, and the buffer.

    base: where each text begins in its document.
    """
    sizes = np.array([len(t) for t in texts], np.int64)
    x = np.frombuffer(b"".join([bytes(SPAN), *texts, bytes(LENGTH + 8)]), np.uint8)
    first = np.cumsum(sizes) - sizes + SPAN
    h = gram_hashes(x)
    key = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)  # the low half tells the place, so ties go left
    place = (sliding(key, SPAN, np.minimum) & np.uint64(0xFFFFFFFF)).astype(np.int64)  # the anchor of each window
    step = np.zeros(len(x) + 1, np.int32)
    ok = sizes >= LENGTH
    np.add.at(step, first[ok], 1)
    np.add.at(step, first[ok] + sizes[ok] - LENGTH + 1, -1)
    place[np.cumsum(step)[: len(place)] <= 0] = -1  # windows over the end of a text
    cut = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
    stop = np.append(cut[1:], len(place))
    cut, stop = cut[place[cut] >= 0], stop[place[cut] >= 0]
    at = place[cut]  # each anchor with the run of windows that have it
    doc = np.searchsorted(first, at, side="right") - 1
    before, after = at - cut, stop - 1 + LENGTH - at
    rows = np.lib.stride_tricks.sliding_window_view(x, CONTEXT)[at - (SPAN - 1)] if len(at) else np.zeros((0, CONTEXT), np.uint8)
    k = np.arange(CONTEXT) - (SPAN - 1)
    for i in range(0, len(at), 65_536):
        j = slice(i, i + 65_536)
        rows[j] *= (k >= -before[j, None]) & (k < after[j, None])
    g = hash_rows(rows) ^ (before.astype(np.uint64) * _M[2]) ^ (after.astype(np.uint64) * _M[1])
    out = Anchors(h[at], g, ids[doc], (at - first[doc] + base[doc]).astype(np.uint32), before.astype(np.uint8), after.astype(np.uint8))
    few = np.uint64((1 << bits) - 1)
    if hot is None or not len(hot):
        out.h, out.g = out.h & few, out.g & few
        return out, at, x
    is_hot = np.isin(out.h, hot)
    parts, places = [out.take(~is_hot)], [at[~is_hot]]
    for off in range(SPAN) if is_hot.any() else ():  # windows that start `off` before the anchor
        sel = is_hot & (before >= off) & (after + off >= LENGTH)
        w = np.lib.stride_tricks.sliding_window_view(x, LENGTH)[at[sel] - off]
        w = np.concatenate([w, np.zeros((len(w), 4), np.uint8)], 1)
        h1 = hash_rows(w)
        h2 = hash_rows(np.ascontiguousarray(w[:, ::-1]))
        n = int(sel.sum())
        parts.append(Anchors(h1, h2, out.doc[sel], (out.pos[sel] - off).astype(np.uint32), np.zeros(n, np.uint8), np.full(n, LENGTH, np.uint8)))
        places.append(at[sel] - off)
    out = Anchors.join(parts)
    out.h, out.g = out.h & few, out.g & few
    return out, np.concatenate(places), x


def merged(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Intervals joined where they touch, by document."""
    if not len(doc):
        return doc, start, end
    o = np.lexsort((start, doc))
    doc, start, end = doc[o], start[o].astype(np.int64), end[o].astype(np.int64)
    base = np.cumsum(np.append(False, doc[1:] != doc[:-1])).astype(np.int64) << 34
    far = np.maximum.accumulate(base + end)
    new = np.append(True, base[1:] + start[1:] > far[:-1])
    i = np.flatnonzero(new)
    return doc[i], start[i], (far - base)[np.append(i[1:], len(doc)) - 1]


def row_order(x: np.ndarray) -> np.ndarray:
    """Rotations of x ordered by their first DEPTH bytes: 8 bytes at once, then doubling among those not told apart yet."""
    n = len(x)
    p = np.concatenate([x, np.resize(x, 8)])
    key = np.ndarray((n,), ">u8", p.data, 0, (1,)).astype(np.uint64)
    rows = np.argsort(key)
    key = key[rows]
    new = np.append(True, key[1:] != key[:-1])
    at = np.flatnonzero(new)
    rank = np.empty(n, np.int64)
    rank[rows] = np.repeat(at, np.diff(np.append(at, n)))
    step = 8
    while step < DEPTH:
        slots = np.flatnonzero(~(new & np.append(new[1:], True)))
        if not len(slots):
            break
        r = rows[slots]
        key = (rank[r].astype(np.uint64) << np.uint64(32)) | rank[(r + step) % n].astype(np.uint64)
        o = np.argsort(key)
        key, r = key[o], r[o]
        rows[slots] = r
        fresh = np.append(True, key[1:] != key[:-1])
        new[slots] = fresh
        rank[r] = np.repeat(slots[fresh], np.diff(np.append(np.flatnonzero(fresh), len(r))))
        step *= 2
    return rows


def common_prefixes(x: np.ndarray, rows: np.ndarray, least: int = LENGTH) -> np.ndarray:
    """Common prefix of each row and the one before where it is under `least`, else -1.

    Intervals of rows that share a prefix of l bytes are extended backward by every byte before them. An end that no shorter prefix
    has set gets the value l, and its interval goes on to the next level; others stop. Levels end at `least`.
    """
    n = len(x)
    last = x[rows - 1]
    by = np.argsort(last, kind="stable")
    to = np.empty(n, np.int64)  # where the row that starts one byte earlier stands
    to[by] = np.arange(n)
    nxt, prv = np.full(n, n + 1, np.int64), np.full(n, -1, np.int64)  # the next and last row with the same byte before it
    same = last[by[1:]] == last[by[:-1]]
    nxt[by[:-1][same]] = by[1:][same]
    prv[by[1:][same]] = by[:-1][same]
    out = np.full(n + 1, -1, np.int16)
    out[[0, n]] = 0
    start, end = np.array([0]), np.array([n])
    for value in range(least):
        size = end - start
        if not len(size):
            break
        r = np.arange(size.sum()) + np.repeat(start - np.cumsum(size) + size, size)
        ends = np.sort(to[r[nxt[r] >= np.repeat(end, size)]]) + 1
        starts = np.sort(to[r[prv[r] < np.repeat(start, size)]])
        fresh = out[ends] < 0
        start, end = starts[fresh], ends[fresh]
        out[end] = value
    return out[:n]


def repeated(data: np.ndarray, sizes: np.ndarray, doc: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, ...]:
    """Windows within the contexts, by the transform: context, offset, and whether an equal one starts earlier. data: the contexts, a 0 after each."""
    rows = row_order(data)
    group = np.cumsum(common_prefixes(data, rows) >= 0)
    first = np.cumsum(sizes + 1) - sizes - 1
    ctx = np.searchsorted(first, rows, side="right") - 1
    off = rows - first[ctx]
    keep = off + LENGTH <= sizes[ctx]
    group, ctx, off = group[keep], ctx[keep], off[keep]
    if not len(ctx):
        return ctx, off, keep[:0]
    at = np.unique(doc, return_inverse=True)[1].ravel()[ctx].astype(np.int64) << 34
    at += place[ctx] + off
    cut = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    low = np.repeat(np.minimum.reduceat(at, cut), np.diff(np.append(cut, len(at))))
    return ctx, off, at > low


def gather(data: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """data[f : f + n] of each f and n, one after the other."""
    return data[np.arange(size.sum()) + np.repeat(first - np.cumsum(size) + size, size)]


def equal_rows(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the bytes from a and from b are the same."""
    out = np.ones(len(a), bool)
    for i in range(0, len(a), 8192):
        k = slice(i, i + 8192)
        eq = gather(data, a[k], size[k]) == gather(data, b[k], size[k])
        out[k] = np.logical_and.reduceat(eq, np.cumsum(size[k]) - size[k])
    return out


def repeats_in(h: np.ndarray, g: np.ndarray, doc: np.ndarray, start: np.ndarray, size: np.ndarray, data: np.ndarray, first: np.ndarray, pack: int = PACK_BYTES):
    """Repeats (doc, start, end) among contexts that meet by h, and the numbers of the earliest of each different context.

    data[first : first + size] are the bytes of a context that starts at `start` in its document.
    """
    o = np.lexsort((start, doc, g, h))
    h, g, doc, start, size, first = h[o], g[o], doc[o], start[o].astype(np.int64), size[o].astype(np.int64), first[o]
    none = np.zeros(0, np.int64)
    if not len(o):
        return (none, none, none), none
    new = np.append(True, (h[1:] != h[:-1]) | (g[1:] != g[:-1]) | (size[1:] != size[:-1]))
    like = np.flatnonzero(~new)
    new[like] = ~equal_rows(data, first[like], first[like - 1], size[like])
    lead = np.flatnonzero(new)
    of = np.cumsum(new) - 1  # the context of each place
    met = np.append(np.flatnonzero(np.append(True, h[lead][1:] != h[lead][:-1])), len(lead))
    total = np.append(0, np.cumsum(size[lead] + 1))
    places = np.append(lead, len(h))
    found, i = [], 0
    while i < len(met) - 1:  # packs of whole hashes
        j = max(i + 1, int(np.searchsorted(total[met], total[met[i]] + pack, side="right")) - 1)
        k = lead[met[i] : met[j]]
        n = size[k]
        x = np.zeros(int((n + 1).sum()), np.uint8)
        to = np.cumsum(n + 1) - n - 1
        x[np.arange(n.sum()) + np.repeat(to - np.cumsum(n) + n, n)] = gather(data, first[k], n) + 1  # UTF-8 has no byte 255
        ctx, off, again = repeated(x, n, doc[k], start[k])
        found.append(merged(doc[k][ctx[again]], (start[k][ctx] + off)[again], (start[k][ctx] + off)[again] + LENGTH))
        # a window is repeated at every later place of its context
        low, high = np.full(len(k), 1 << 40), np.zeros(len(k), np.int64)
        np.minimum.at(low, ctx, off)
        np.maximum.at(high, ctx, off + LENGTH)
        p = np.arange(places[met[i]], places[met[j]])
        p = p[~new[p]]
        own = lead[of[p]]
        p = p[(doc[p] != doc[own]) | (start[p] != start[own])]  # not one place that was met twice
        c = of[p] - met[i]
        found.append(merged(doc[p], start[p] + low[c], start[p] + high[c]))
        i = j
    return merged(*(np.concatenate(c) for c in zip(*found))), o[lead]


def pieces(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[list[bytes], np.ndarray, np.ndarray]]:
    """Texts, their doc_ids and where they begin: long texts in pieces that overlap by a window less a byte."""
    for b in small_batches(batches, most):
        ids = column(b, "doc_id").to_numpy().astype(np.int64)
        texts = text_bytes(b)
        if len(texts) == 1 and len(texts[0]) > most:
            for at in range(0, len(texts[0]) - LENGTH + 1, most):
                yield [texts[0][at : at + most + LENGTH - 1]], ids, np.array([at])
        else:
            yield texts, ids, np.zeros(len(texts), np.int64)


def hot_anchors(docs: DataFrame, n_anchors: int) -> np.ndarray:
    """Anchor hashes of more than HOT_ROWS different contexts, as 1 / HOT_SHARE of the documents have it."""
    most, bits, piece = max(HOT_ROWS, n_anchors // HOT_MOST), HASH_BITS, PIECE
    if n_anchors <= most:
        return np.zeros(0, np.uint64)

    def run(batches):
        for texts, ids, base in pieces(batches, piece):
            a = anchors_of(texts, ids, base, bits=bits)[0]
            u, n = np.unique(np.unique(np.stack([a.h, a.g], 1), axis=0)[:, 0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(n)], names=["h", "n"])

    sample = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(HOT_SHARE)) == 0)
    got = sample.mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") * HOT_SHARE > most).orderBy(F.desc("n"), "h").limit(HOT_MOST).collect()
    return np.sort(np.array([r.h for r in got], np.int64).view(np.uint64))


def _bytes(*cols: np.ndarray) -> bytes:
    return b"".join(np.ascontiguousarray(c, np.int64).tobytes() for c in cols)


def _find(docs: DataFrame, keys: np.ndarray, buckets: int, hot_b) -> DataFrame:
    """kind 1: repeats (doc_id, start, end); kind 2: contexts that meet others of their hash elsewhere (doc_id, start, end, h)."""
    names, parts, bits, flush, pack, piece = ["key", "bucket", "repeats", "anchors"], len(keys), HASH_BITS, FLUSH_BYTES, PACK_BYTES, PIECE

    def deal(kept: list[tuple[Anchors, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        shift = np.cumsum([0, *(len(x) for _, _, x in kept)])
        a = Anchors.join([k[0] for k in kept])
        at = np.concatenate([k[1] + n for k, n in zip(kept, shift)])
        data = np.concatenate([k[2] for k in kept])
        o = np.argsort(a.h, kind="stable")
        a, at = a.take(o), at[o]
        twice = np.zeros(len(a), bool)
        twice[1:] = a.h[1:] == a.h[:-1]
        twice[:-1] |= twice[1:]
        m, before = a.take(twice), a.before[twice].astype(np.int64)
        gone, lead = repeats_in(m.h, m.g, m.doc, m.pos.astype(np.int64) - before, before + m.after, data, at[twice] - before, pack)
        first = Anchors.join([a.take(~twice), m.take(lead)])
        bucket = (first.h >> np.uint64(20 if bits == 64 else 0)) % np.uint64(buckets)
        o = np.lexsort((first.pos, first.doc, bucket))
        first, bucket = first.take(o), bucket[o].astype(np.int64)
        cut = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else np.zeros(0, np.int64)
        packs = [first.take(slice(i, j)).pack() for i, j in zip(cut, np.append(cut[1:], len(bucket)))]
        to = np.append(keys[bucket[cut] % parts], keys[int(gone[0][0]) % parts if len(gone[0]) else 0])
        yield pa.RecordBatch.from_arrays(
            [pa.array(to), pa.array(np.append(bucket[cut], -1)), pa.array([*[None] * len(packs), _bytes(*gone)], pa.binary()), pa.array([*packs, None], pa.binary())], names=names
        )

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, size = [], 0
        for texts, ids, base in pieces(batches, piece):
            kept.append(anchors_of(texts, ids, base, hot_b.value, bits))
            size += len(kept[-1][2])
            if size > flush:
                yield from deal(kept)
                kept, size = [], 0
        if kept:
            yield from deal(kept)

    def rows(kind: int, *cols: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(cols[0]), kind, np.int8)), *(pa.array(np.ascontiguousarray(c, np.int64)) for c in cols)], names=["kind", "doc_id", "start", "end", "h"])

    def ask(packs: list[bytes]) -> pa.RecordBatch:
        """Anchors whose hash came from several flushes; those of one are decided there."""
        flushes = [Anchors.unpack(x) for x in packs]
        source = np.repeat(np.arange(len(flushes)), [len(f) for f in flushes])
        a = Anchors.join(flushes)
        o = np.argsort(a.h, kind="stable")
        h, source = a.h[o], source[o]
        cut = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
        several = np.repeat(np.minimum.reduceat(source, cut) < np.maximum.reduceat(source, cut), np.diff(np.append(cut, len(h))))
        a = a.take(o[several])
        start = a.pos.astype(np.int64) - a.before
        return rows(2, a.doc, start, start + a.before + a.after, a.h.view(np.int64))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gone, packs, at = [], [], -1
        for b in batches:
            for bucket, r, x in zip(column(b, "bucket").to_pylist(), column(b, "repeats").to_pylist(), column(b, "anchors").to_pylist()):
                if bucket != at and packs:
                    yield ask(packs)
                    packs = []
                at = bucket
                if x is not None:
                    packs.append(x)
                elif r:
                    gone.append(np.frombuffer(r, np.int64).reshape(3, -1))
        if packs:
            yield ask(packs)
        if gone:
            d, s, e = merged(*np.concatenate(gone, 1))
            yield rows(1, d, s, e, np.zeros(len(d), np.int64))

    dealt = docs.mapInArrow(scan, "key long, bucket long, repeats binary, anchors binary").repartition(parts, "key").sortWithinPartitions("bucket")
    return written(dealt.mapInArrow(meet, "kind byte, doc_id long, start long, end long, h long"), "repeats-found")


def _compare(docs: DataFrame, found: DataFrame, keys: np.ndarray, buckets: int) -> DataFrame:
    """Repeats (doc_id, start, end) among the contexts asked for, by the transform."""
    parts, at_once, pack, bits = len(keys), ASKED, PACK_BYTES, HASH_BITS
    asked = found.where("kind = 2").groupBy("doc_id").agg(F.collect_list(F.struct("start", "end", "h")).alias("asked")).withColumnRenamed("doc_id", "_d")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zip_ = pa.Codec("zstd", 1)
        for b in small_batches(batches):
            z = column(b, "asked")
            flat, n = z.flatten(), np.asarray(z.value_lengths())
            starts, ends, hs = (flat.field(k).to_numpy() for k in range(3))
            docs_, which = np.repeat(column(b, "doc_id").to_numpy(), n), np.repeat(np.arange(b.num_rows), n)
            texts = text_bytes(b)
            for i in range(0, len(hs), at_once):
                part = slice(i, i + at_once)
                start, end, h, doc, w = starts[part], ends[part], hs[part], docs_[part], which[part]
                bucket = ((h.view(np.uint64) >> np.uint64(20 if bits == 64 else 0)) % np.uint64(buckets)).astype(np.int64)
                o = np.argsort(bucket, kind="stable")
                edge = np.flatnonzero(np.append(True, np.diff(bucket[o]) != 0))
                heads, datas = [], []
                for k in np.split(o, edge[1:]):
                    data = [texts[t][s:e] for t, s, e in zip(w[k].tolist(), start[k].tolist(), end[k].tolist())]
                    g = np.array([xxhash.xxh64_intdigest(t) & ((1 << min(bits, 63)) - 1) for t in data], np.int64)
                    heads.append(_bytes(h[k], g, doc[k], start[k], np.array([len(t) for t in data])))
                    datas.append(zip_.compress(b"".join(data), asbytes=True))
                bucket = bucket[o][edge]
                yield pa.RecordBatch.from_arrays([pa.array(keys[bucket % parts]), pa.array(bucket), pa.array(heads, pa.binary()), pa.array(datas, pa.binary())], names=["key", "bucket", "head", "data"])

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def one() -> pa.RecordBatch:
            heads_ = [np.frombuffer(x, np.int64).reshape(5, -1) for x in heads]
            h, g, doc, start, size = np.concatenate(heads_, 1)
            data = b"".join(zip_.decompress(x, int(n[4].sum()), asbytes=True) for x, n in zip(datas, heads_))
            d, s, e = repeats_in(h, g, doc, start, size, np.frombuffer(data, np.uint8), np.cumsum(size) - size, pack)[0]
            return pa.RecordBatch.from_arrays([pa.array(d), pa.array(s), pa.array(e)], names=["doc_id", "start", "end"])

        zip_ = pa.Codec("zstd")
        heads, datas, at = [], [], -1
        for b in batches:
            for bucket, head, data in zip(column(b, "bucket").to_pylist(), column(b, "head").to_pylist(), column(b, "data").to_pylist()):
                if bucket != at and heads:
                    yield one()
                    heads, datas = [], []
                at = bucket
                heads.append(head)
                datas.append(data)
        if heads:
            yield one()

    met = docs.join(asked.hint("shuffle_hash"), F.col("doc_id") == F.col("_d")).select("doc_id", "text", "asked")
    dealt = met.mapInArrow(cut, "key long, bucket long, head binary, data binary").repartition(parts, "key").sortWithinPartitions("bucket")
    return dealt.mapInArrow(decide, "doc_id long, start long, end long")


def find_repeats(docs: DataFrame) -> DataFrame:
    """Repeats (doc_id, start, end) in UTF-8 bytes, some overlapping."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null and text is not null")
    n = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    n_anchors = 2 * n // (SPAN + 1)
    buckets = max(shuffle_parts(spark), n_anchors // BUCKET_ANCHORS + 1)
    keys = partition_keys(spark, min(buckets, MOST_PARTS))
    found = _find(docs, keys, buckets, spark.sparkContext.broadcast(hot_anchors(docs, n_anchors)))
    return found.where("kind = 1").select("doc_id", "start", "end").union(_compare(docs, found, keys, buckets))


def cut_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, kept (the remaining bytes), n_bytes, n_removed and n_spans of every row of docs."""
    spans = find_repeats(docs).groupBy("doc_id").agg(F.collect_list(F.struct("start", "end")).alias("gone")).withColumnRenamed("doc_id", "_d")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches):
            kept, count = [], []
            for t, z in zip(text_bytes(b), column(b, "gone").to_pylist()):
                parts, last, n, gone = [], 0, 0, 0
                for s, e in sorted((r["start"], r["end"]) for r in z or ()):
                    if s > last or not n:
                        parts.append(t[last:s])
                        n += 1
                    gone += e - max(s, last) if e > last else 0
                    last = max(last, e)
                kept.append(b"".join([*parts, t[last:]]))
                count.append((len(t), gone, n))
            yield pa.RecordBatch.from_arrays([column(b, "doc_id"), pa.array(kept, pa.binary()), *(pa.array(list(c), pa.int64()) for c in zip(*count))], names=["doc_id", "kept", "n_bytes", "n_removed", "n_spans"])

    met = docs.select("doc_id", "text").join(spans.hint("shuffle_hash"), F.col("doc_id") == F.col("_d"), "left").select("doc_id", "text", "gone")
    return met.mapInArrow(run, f"doc_id {kind}, kept binary, n_bytes long, n_removed long, n_spans long")


def op5_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = cut_repeats(table(spark, sf_dir, "documents", "doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
