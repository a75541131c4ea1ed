"""Secret scans: patterns, and two character Markov models compared by log-likelihood ratio.

Base spans (kinds assign, access, hex) come from fixed patterns. The method adds spans of kind markov: tokens of 16 or more characters
of the base64 alphabet whose mean log-likelihood ratio per character, random strings against ordinary identifiers, is past THRESHOLD
and that touch no base span. Both models are trained from labelled samples: random strings are values that the patterns label as
secrets, and strings drawn over the usual alphabets; identifiers are all other words, alone and joined the ways code joins them, and
numbers. Tasks count character pairs over the whole texts of about SAMPLE_DOCS documents, those of a share of the hashes of doc_id, and
values over those of HIT_SHARE times that share; only counts leave the tasks.

Positions are code points. Defined results: null is the empty text; repeated rows get a row each; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm._base import column, small_batches, table

KINDS = ("assign", "access", "hex", "markov")
#: The patterns of the base kinds.
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
BLANK = re.compile(r"\s")
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Documents whose words train the model of identifiers, about so many; values are counted in HIT_SHARE times as many.
SAMPLE_DOCS = 1000
HIT_SHARE = 16
PRIOR = 0.5
#: Mean log-likelihood ratio (natural log) of a character above which a token is a secret: 0 is as likely random as not.
THRESHOLD = 0.2
_CODE = np.zeros(256, np.int64)
_CODE[[ord(c) for c in ALPHABET]] = np.arange(1, len(ALPHABET) + 1)
SIZE = len(ALPHABET) + 1


def values(text: str) -> list[str]:
    """The values that the patterns label as secrets."""
    out = []
    if any(k in text.lower() for k in KEYWORDS):
        out += [m[2] for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [m[0] for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    return out + HEX.findall(text)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind number) of the base patterns, by start, then kind."""
    out = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        out += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        out += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    out.sort(key=lambda s: (s[0], s[2]))
    return out


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, e, k in spans)


def codes(s: str) -> np.ndarray:
    return _CODE[np.frombuffer(s.encode("latin-1", "replace"), np.uint8)]


def pair_counts(samples: list[str]) -> np.ndarray:
    """How often a character follows the one before; row 0 is the start."""
    n = np.zeros((SIZE, SIZE), np.int64)
    for k in range(0, len(samples), 100_000):
        part = samples[k : k + 100_000]
        c = codes("\0" + "\0".join(part))
        keep = np.ones(len(c) - 1, bool)
        keep[np.cumsum([len(t) + 1 for t in part])[:-1] - 1] = False  # from the end of one to the start of the next
        n += np.bincount((c[:-1] * SIZE + c[1:])[keep], minlength=SIZE * SIZE).reshape(SIZE, SIZE)
    return n


class Models:
    """Log probabilities of a character after the one before, random strings against identifiers."""

    def __init__(self, random: np.ndarray, identifiers: np.ndarray):
        log = lambda n: np.log((n + PRIOR) / (n + PRIOR).sum(1, keepdims=True))
        self.ratio = log(random) - log(identifiers)

    def llr(self, s: str) -> float:
        """Mean log-likelihood ratio of a character."""
        c = np.concatenate([[0], codes(s)])
        return float(self.ratio[c[:-1], c[1:]].mean())


def drawn(n: int = 1500, seed: int = 5) -> list[str]:
    """Random strings over the alphabets of usual secrets."""
    rng = np.random.default_rng(seed)
    sets = ["0123456789abcdef", ALPHABET[:62], ALPHABET[:64], "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", ALPHABET[:62] + "_-"]
    return ["".join(rng.choice(list(sets[i % len(sets)]), int(rng.integers(16, 64)))) for i in range(n)]


def numbers(n: int, seed: int = 6) -> list[str]:
    """Numbers are ordinary too."""
    rng = np.random.default_rng(seed)
    return ["".join(rng.choice(list("0123456789"), int(rng.integers(6, 24)))) for _ in range(n)]


def identifiers(text: str) -> list[str]:
    """The words of a text outside its base spans, alone and joined as in code: snake, kebab, camel, paths, numbered."""
    plain, last = [], 0
    for s, e, _ in [*base_spans(text), (len(text), len(text), 0)]:
        plain += re.findall(r"[A-Za-z]{3,}", text[last:s])
        last = max(last, e)
    joins = []
    for i in range(0, len(plain) - 1, 3):
        w, how = plain[i : i + 2 + i % 3], (i // 3) % 5
        joins.append("_".join(w) if how == 0 else "-".join(w) if how == 1 else "".join(x.title() for x in w) if how == 2 else "/".join(w) if how == 3 else "_".join(w) + str(i % 100))
    return plain + joins


def parts(text: str, most: int = 1 << 20) -> Iterator[str]:
    """The text in parts of about `most` characters that end at a line or a blank, for counting."""
    at = 0
    while at < len(text):
        m = BLANK.search(text, min(at + most, len(text)))
        end = m.end() if m else len(text)
        yield text[at:end]
        at = end


def train(texts: list[str]) -> Models:
    """Models of texts at hand."""
    return Models(*(pair_counts(x) + sum((pair_counts(get(t)) for t in texts), np.zeros((SIZE, SIZE), np.int64)) for x, get in START))


#: What both models know before any text: strings drawn at random, and numbers and a few common names.
START = ((drawn(), values), (numbers(300) + ["identifier", "value", "name"], identifiers))


def spans(models: Models, text: str, threshold: float = THRESHOLD) -> tuple[list, list]:
    """Base spans, and all spans."""
    base = base_spans(text)
    more = []
    for m in TOKEN.finditer(text):
        s, e = m.span()
        if models.llr(m.group()) > threshold and not any(a < e and s < b for a, b, _ in base):
            more.append((s, e, 3))
    return base, sorted(base + more, key=lambda x: (x[0], x[2])) if more else base


def fit(docs: DataFrame, sample: int = SAMPLE_DOCS) -> Models:
    """Character pairs counted in tasks: the hash of doc_id picks the documents before any text is looked at."""
    bits = 1 << 24
    share = min(bits, -(-bits * sample // max(docs.count(), 1)))
    wide = min(bits, HIT_SHARE * share)
    place = F.pmod(F.xxhash64("doc_id"), F.lit(bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((2, SIZE, SIZE), np.int64)
        for b in small_batches(batches):
            for t, near in zip(column(b, "text").to_pylist(), column(b, "near").to_pylist()):
                for part in parts(t):
                    n[0] += pair_counts(values(part))
                    if near:
                        n[1] += pair_counts(identifiers(part))
        k = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(n.ravel()[k])], names=["pair", "n"])

    some = docs.where(place < wide).where("text is not null").select("text", (place < share).alias("near"))
    total = np.zeros(2 * SIZE * SIZE, np.int64)
    for r in some.mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect():  # 2 * SIZE ** 2 rows at most
        total[r.pair] = r.n
    return Models(*(pair_counts(x) + n for (x, _), n in zip(START, total.reshape(2, SIZE, SIZE))))


def scan(docs: DataFrame, models: Models) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans of every row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches):
            rows = []
            for t in column(b, "text").to_pylist():
                base, all_ = spans(models, t or "")
                kinds = [k for _, _, k in base]
                rows.append((*(kinds.count(k) for k in range(3)), hashlib.sha256(joined(base).encode()).hexdigest(), joined(all_)))
            yield pa.RecordBatch.from_arrays([column(b, "doc_id"), *(pa.array(list(c), t) for c, t in zip(zip(*rows), types))], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return scan(docs, fit(docs))
