"""PII: candidate gradient boosting.

High-recall generators propose overlapping spans: the base patterns, written-out addresses, every four parts of a dotted run, every 12 to
19 digits of a run of digit groups, every stretch from a plus sign that ends with a group, every 7 to 11 digits of looser groups. Boosted
trees score each by features of its format and of the text around it. Base spans (email, ip, card, phone, as the patterns and
their checks have them) always stay, with their score; of the other candidates those past a calibrated threshold are added as kind
other, best first, where they touch no span that is already taken.

Training labels: candidates of a bounded sample of documents that the base checks accept, each taken for itself, are positive, those they
reject (a failed Luhn sum, an octet past 255, too few digits) negative; every candidate of written texts is positive if it is what the
text holds of a person, else negative. The threshold of each
generator is the lowest at which the calibration fold keeps a precision of PRECISION.

Positions are code points. Defined results: null is the empty text; repeated rows get a row each; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm._base import column, small_batches, table

KINDS = ("email", "ip", "card", "phone", "other")
#: The patterns of the base kinds.
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
#: Generators of further candidates: written-out addresses, dotted runs, digit groups, and looser groups.
WRITTEN = re.compile(r"[A-Za-z0-9._%+-]{1,64}\s?(?:\(at\)|\[at\]|\x20at\x20|@)\s?[A-Za-z0-9-]{1,63}(?:\s?(?:\(dot\)|\[dot\]|\x20dot\x20|\.)\s?[A-Za-z0-9-]{1,63}){1,4}")
SPELLED = re.compile(r"\(at\)|\[at\]|\x20dot\x20|\(dot\)|\[dot\]")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+){3,}")
LOOSE = re.compile(r"\(?[0-9]+(?:[().\x20/-]{1,2}[0-9]+)*")
NUMBER = re.compile(r"[0-9]+")
GENERATORS = 9  # the base kinds, then written-out addresses, dotted runs, digit groups, from a plus sign, looser groups
JUDGED = (5, 6, 7)  # those whose candidates the base checks can accept
#: About so many documents give candidates to learn from, of which those of the smallest hash are taken.
SAMPLE_DOCS = 2000
SAMPLE_CANDIDATES = 20_000
PRECISION = 0.98
TREES, DEPTH, RATE, BINS = 60, 3, 0.2, 24
CONTEXT = 24
CUES = ("tel", "phone", "call", "fax", "mobile", "mail", "contact", "ssn", "social", "card", "account", "passport", "version", "isbn", "page", "order", "date")

#: Last parts that written-out addresses usually have.
ENDINGS = frozenset("com net org edu gov io co de fr es uk eu info biz us ca".split())


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping addresses: from each @ back over the local part, forth over the domain."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind number) by start, then kind."""
    out = [(s, e, 0) for s, e in emails(text)] if "@" in text else []
    if DIGIT.search(text):
        out += [(m.start(), m.end(), 1) for m in IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p) <= 255 for p in m.group().split("."))]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 12:
                d = m.group().replace(" ", "").replace("-", "")
                if 12 <= len(d) <= 19 and luhn(d):
                    out.append((m.start(), m.end(), 2))
        if "+" in text:
            out += [(m.start(), m.end(), 3) for m in PHONE.finditer(text) if 9 <= sum("0" <= c <= "9" for c in m.group()) <= 15]
    out.sort(key=lambda s: (s[0], s[2]))
    return out


def stretches(groups: list[tuple[int, int]], least: int, most: int, parts: int) -> Iterator[tuple[int, int]]:
    """Every run of at most `parts` neighbouring groups with least to most digits."""
    for i, (s, _) in enumerate(groups):
        n = 0
        for a, e in groups[i : i + parts]:
            n += e - a
            if n > most:
                break
            if n >= least:
                yield s, e


def candidates(text: str) -> list[tuple[int, int, int]]:
    """(start, end, generator) of all generators but the base patterns, overlaps and all."""
    out = []
    low = text.lower()
    if "@" in text or "(at)" in low or "[at]" in low or " dot " in low:
        out += [(m.start(), m.end(), 4) for m in WRITTEN.finditer(text) if "@" in m.group() or SPELLED.search(m.group())]
    if not DIGIT.search(text):
        return out
    groups = lambda m: [(g.start(), g.end()) for g in NUMBER.finditer(text, m.start(), m.end())]
    for m in DOTTED.finditer(text):
        g = groups(m)
        out += [(a[0], b[1], 5) for a, b in zip(g, g[3:])]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12:
            out += [(s, e, 6) for s, e in stretches(groups(m), 12, 19, 6)]
    if "+" in text:
        for m in PHONE.finditer(text):
            out += [(m.start(), e, 7) for s, e in stretches(groups(m), 9, 15, 8) if s == m.start() + 1]
    for m in LOOSE.finditer(text):
        if m.end() - m.start() >= 8:
            at, to = m.span()
            out += [(s - (s > at and text[s - 1] == "("), e, 8) for s, e in stretches(groups(m), 7, 11, 5) if e - s > 7]
    return out


class Taken:
    """Stretches of a text that spans take, disjoint."""

    def __init__(self, spans: list[tuple[int, int, int]]):
        self.ends: list[tuple[int, int]] = []
        for s, e, _ in sorted(spans):
            if self.ends and s < self.ends[-1][1]:
                self.ends[-1] = (self.ends[-1][0], max(e, self.ends[-1][1]))
            else:
                self.ends.append((s, e))

    def touch(self, s: int, e: int) -> bool:
        k = bisect_left(self.ends, (s, 0))
        return (k < len(self.ends) and self.ends[k][0] < e) or (k > 0 and self.ends[k - 1][1] > s)

    def add(self, s: int, e: int) -> None:
        insort(self.ends, (s, e))


def accepted(text: str) -> bool:
    """Whether the base patterns and checks take all of a candidate as one span."""
    return any((s, e) == (0, len(text)) for s, e, _ in base_spans(text))


def features(text: str, s: int, e: int, gen: int) -> list[float]:
    t = text[s:e]
    digits = "".join(c for c in t if "0" <= c <= "9")
    before, after = text[max(0, s - CONTEXT) : s].lower(), text[e : e + CONTEXT].lower()
    groups = [len(g) for g in re.findall(r"[0-9]+", t)]
    parts = t.split(".")
    quad = len(parts) == 4 and all(p.isdigit() for p in parts)
    return [
        gen if gen < 4 else (0, 1, 2, 3, 4)[gen - 4], float(len(set(groups)) == 1), float(bool(re.search(r"[0-9][\x20.-]$", before))), float(bool(re.match(r"[\x20.-][0-9]", after))),
        float(len(groups) > 1 and all(1900 <= int(g) <= 2100 for g in re.findall(r"[0-9]{1,9}", t))), e - s, len(digits), len(groups), max(groups, default=0), min(groups, default=0), groups[0] if groups else 0, groups[-1] if groups else 0,
        float(bool(digits) and luhn(digits)), float(quad), max((min(int(p[:6]), 999) for p in parts), default=0) if quad else 0, t.count("."), t.count("-"), t.count(" "), t.count("("), t.count("/"),
        float(t[:1] == "+" or before[-1:] == "+"), t.count("@"), float(" dot " in t.lower() or "(dot)" in t.lower() or "[dot]" in t.lower()), float("(at)" in t.lower() or "[at]" in t.lower() or " at " in t.lower()),
        int(digits[0]) if digits else -1, sum(c.isalpha() for c in t), float(before[-1:].isalnum()), float(after[:1].isalnum()), float(before[-1:] in ".-/$€"), float(after[:1] in "%-/"),
        float(re.split(r"[^a-z]+", t.lower())[-1] in ENDINGS), *(float(c in before) for c in CUES),
    ]


@dataclass
class Trees:
    """Complete trees of DEPTH levels: feature and cut of each inner node, value of each leaf."""

    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray
    bias: float

    def proba(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.bias)
        rows = np.arange(len(x))
        for f, c, v in zip(self.feature, self.cut, self.leaf):
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                at = 2 * at + 1 + (x[rows, f[at]] > c[at])
            z += v[at - (2**DEPTH - 1)]
        return 1 / (1 + np.exp(-z))


def boost(x: np.ndarray, y: np.ndarray, l2: float = 1.0) -> Trees:
    """Newton boosting of the log loss over binned features."""
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(k, c, side="left") for k, c in zip(cuts, x.T)], 1)
    inner = 2**DEPTH - 1
    p0 = np.clip(y.mean(), 0.01, 0.99) if len(y) else 0.5
    out = Trees(np.zeros((TREES, inner), np.int64), np.full((TREES, inner), np.inf), np.zeros((TREES, inner + 1)), float(np.log(p0 / (1 - p0))))
    z = np.full(len(y), out.bias)
    for t in range(TREES if len(y) else 0):
        p = 1 / (1 + np.exp(-z))
        g, h = y - p, p * (1 - p)
        at = np.zeros(len(y), np.int64)
        for node in range(inner):
            sel = np.flatnonzero(at == node)
            best = (1e-9, 0, -1)
            if len(sel) > 1:
                gs, hs = g[sel], h[sel]
                whole = gs.sum() ** 2 / (hs.sum() + l2)
                for f, k in enumerate(cuts):
                    if len(k):
                        gl = np.cumsum(np.bincount(binned[sel, f], gs, len(k) + 1))[:-1]
                        hl = np.cumsum(np.bincount(binned[sel, f], hs, len(k) + 1))[:-1]
                        gain = gl**2 / (hl + l2) + (gs.sum() - gl) ** 2 / (hs.sum() - hl + l2) - whole
                        if gain.max() > best[0]:
                            best = (gain.max(), f, int(gain.argmax()))
            if best[2] >= 0:
                out.feature[t, node], out.cut[t, node] = best[1], cuts[best[1]][best[2]]
            at[sel] = 2 * node + 1 + (binned[sel, best[1]] > best[2] if best[2] >= 0 else 0)
        leaf = at - inner
        value = RATE * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + l2)
        out.leaf[t] = value
        z += value[leaf]
    return out


def with_luhn(digits: str) -> str:
    """digits with the last one set so that the sum is right."""
    return next(digits[:-1] + c for c in "0123456789" if luhn(digits[:-1] + c))


def examples(seed: int = 9, each: int = 100) -> list[tuple[str, int, int]]:
    """Written texts with the span (start, end) of what is somebody's, in forms that the base patterns miss, or (0, 0): numbers that are nobody's."""
    r = np.random.default_rng(seed)
    n = lambda k: "".join(map(str, r.integers(0, 10, k)))
    word = lambda: "".join(r.choice(list("abcdefghijklmnoprstuvwy"), int(r.integers(3, 9))))
    year = lambda: str(r.integers(1900, 2030))
    card = lambda first: with_luhn(str(first) + n(15))
    fours = lambda d, c: c.join(d[i : i + 4] for i in range(0, 16, 4))
    some = lambda: int(r.integers(3, 7))
    bad = lambda d: d[:-1] + str((int(with_luhn(d)[-1]) + int(r.integers(1, 10))) % 10)
    yes = [
        lambda: f"{word()}.{word()} (at) {word()} (dot) com", lambda: f"{word()}[at]{word()}[dot]org", lambda: f"{word()}{n(2)} at {word()} dot net", lambda: f"{word()} @ {word()}.com",
        lambda: f"({n(3)}) {n(3)}-{n(4)}", lambda: f"{r.integers(200, 999)}-{r.integers(200, 999)}-{n(4)}", lambda: f"{r.integers(100, 899)}-{n(2)}-{n(4)}",
        lambda: card(some()), lambda: card(some()), lambda: fours(card(some()), str(r.choice([" ", "-"]))),
    ]
    no = [
        lambda: f"{year()}-{r.integers(10, 13)}-{r.integers(10, 29)}", lambda: f"{r.integers(1, 29)}/{r.integers(1, 13)}/{year()}", lambda: f"{r.integers(1, 999)} {n(3)} {n(3)}", lambda: " ".join(year() for _ in range(r.integers(2, 9))),
        lambda: " ".join(n(2) for _ in range(r.integers(4, 12))), lambda: " ".join(n(3) for _ in range(r.integers(3, 9))), lambda: " ".join(n(int(r.integers(1, 6))) for _ in range(8)), lambda: "-".join(n(int(r.integers(1, 5))) for _ in range(5)),
        lambda: f"{r.integers(1, 20)}.{n(2)}.{n(4)}.{n(1)}", lambda: f"978-{n(1)}-{n(4)}-{n(4)}-{n(1)}", lambda: f"{n(3)}.{n(6)}", lambda: f"{n(4)}-{n(4)}", lambda: n(int(r.integers(7, 12))), lambda: bad(card(r.integers(0, 10))), lambda: fours(bad(card(some())), " "),
        lambda: n(4) + " " + n(12), lambda: with_luhn(n(13)) if r.random() < 0.5 else with_luhn(n(18)), lambda: f"{bad(n(16))} {bad(n(16))}", lambda: f"{word()} at {word()} dot {word()}", lambda: f"{word()} at {word()} dot {word()} dot {word()}",
    ]
    cues = [["tel ", "phone: ", "call me ", "contact ", "", "", "write to "], ["version ", "isbn ", "page ", "order ", "date ", "", "", "no. "]]
    out = []
    for label, kinds in ((1, yes), (0, no)):
        for make in kinds:
            for _ in range(each):
                t = make()
                long = bool(label) and sum(c.isdigit() for c in t) == 16
                beside = r.random() if long else 1.0  # a card before or behind another number
                lead = f"{word()} {word()} {'' if long or t[0].isalpha() else r.choice(cues[1 - label])}{bad(n(16)) + ' ' if beside < 0.3 else ''}"
                after = f" {bad(n(16))}" if 0.3 <= beside < 0.6 else ""
                out.append((f"{lead}{t}{after} {word()} {word()}", len(lead) * label, (len(lead) + len(t)) * label))
    return out


@dataclass
class Detector:
    trees: Trees
    thresholds: np.ndarray  # by generator

    def scored(self, text: str) -> tuple[list, list, list]:
        """Base spans, all spans, and the score of each of all. The trees score every candidate of every generator."""
        base = base_spans(text)
        cand = base + candidates(text)
        if not cand:
            return base, base, []
        p = self.trees.proba(np.array([features(text, *c) for c in cand], float))
        out, taken = {c: float(q) for c, q in zip(base, p)}, Taken(base)
        for i in np.lexsort(([c[0] - c[1] for c in cand], [c[0] for c in cand], -p)):
            s, e, gen = cand[i]
            if gen >= 4 and p[i] >= self.thresholds[gen] and not taken.touch(s, e):
                taken.add(s, e)
                out[s, e, 4] = float(p[i])
        all_ = sorted(out, key=lambda x: (x[0], x[2]))
        return base, all_, [out[x] for x in all_]

    def spans(self, text: str) -> tuple[list, list]:
        """Base spans, and all spans."""
        return self.scored(text)[:2]


def labelled(text: str) -> tuple[list[list[float]], list[int], list[int]]:
    """Features, labels and generators of a text's candidates. Parts of a base span say nothing, and forms that no base check knows neither."""
    base = base_spans(text)
    taken, x, y, gens = Taken(base), [], [], []
    for s, e, gen in base + candidates(text):
        if gen < 4 or (gen in JUDGED and not taken.touch(s, e)):
            x.append(features(text, s, e, gen))
            y.append(int(gen < 4 or accepted(text[s:e])))
            gens.append(gen)
    return x, y, gens


def train(x: list[list[float]], y: list[int], gens: list[int]) -> Detector:
    """Trees on these candidates and the written examples, thresholds on the fold that the trees have not seen."""
    x, y, gens = list(x), list(y), list(gens)
    for t, s, e in examples():  # every candidate of these texts, by whether it is the span
        for c in candidates(t):
            x.append(features(t, *c))
            y.append(int(c[:2] == (s, e)))
            gens.append(c[2])
    x, y, gens = np.array(x, float), np.array(y, float), np.array(gens)
    fold = np.random.default_rng(3).random(len(y)) < 0.3
    trees = boost(x[~fold], y[~fold])

    def cut(sel: np.ndarray) -> float:
        p = trees.proba(x[sel])
        order = np.argsort(-p)
        good = np.cumsum(y[sel][order]) / np.arange(1, len(p) + 1) >= PRECISION
        return max(0.5, p[order][np.flatnonzero(good)[-1]]) if good.any() else 1.1

    whole = cut(fold)  # for generators with few candidates
    return Detector(trees, np.array([cut(fold & (gens == g)) if (fold & (gens == g)).sum() >= 20 else whole for g in range(GENERATORS)]))


def fit(docs: DataFrame, sample: int = SAMPLE_DOCS) -> Detector:
    """Train on candidates of about `sample` documents: the hash of doc_id picks them before any text is looked at, tasks send features."""
    bits = 1 << 24
    share = min(bits, -(-bits * sample // max(docs.count(), 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches):
            for t in column(b, "text").to_pylist():
                x, y, gens = labelled(t)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), pa.array(y, pa.int32()), pa.array(gens, pa.int32())], names=["x", "y", "gen"])

    some = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(bits)) < share).where("text is not null").select("text")
    key = F.xxhash64(F.to_json("x"), "y", "gen")
    got = some.mapInArrow(run, "x array<double>, y int, gen int").withColumn("k", key).orderBy("k", "gen", "y").limit(SAMPLE_CANDIDATES).collect()
    return train([r.x for r in got], [r.y for r in got], [r.gen for r in got])


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, e, k in spans)


def scan(docs: DataFrame, detector: Detector) -> DataFrame:
    """doc_id, the number of base spans of each kind, base_sha256, spans and the score of each span, of every row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches):
            rows = []
            for t in column(b, "text").to_pylist():
                base, all_, p = detector.scored(t or "")
                kinds = [k for _, _, k in base]
                rows.append((*(kinds.count(k) for k in range(4)), hashlib.sha256(joined(base).encode()).hexdigest(), joined(all_), ",".join(f"{v:.4f}" for v in p)))
            yield pa.RecordBatch.from_arrays([column(b, "doc_id"), *(pa.array(list(c), t) for c, t in zip(zip(*rows), types))], names=names)

    types = [pa.int64()] * 4 + [pa.string()] * 3
    names = ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "scores"]
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, scores string")


def redact(text: str, spans: list[tuple[int, int, int]]) -> str:
    """Each stretch of touching spans becomes the name of its first kind in angle brackets."""
    out, last = [], 0
    for s, e, k in spans:
        if s >= last:
            out += [text[last:s], f"<{KINDS[k].upper()}>"]
        last = max(last, e)
    return "".join([*out, text[last:]])


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return scan(docs, fit(docs))


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: personal data is replaced in the texts, n_chars is set anew; every document stays."""
    detector, cols = fit(docs), docs.columns
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches):
            texts = [t and redact(t, detector.spans(t)[1]) for t in column(b, "text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if k == "text" else column(b, k) for k in cols], names=cols)

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType)) if "n_chars" in cols else out
