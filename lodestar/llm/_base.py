"""Shared helpers of the training-data operators: tables, the shared folder, packed rows, components."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters that separate words in all contracts that say ``[^\x20\x09-\x0D]+``; ``bytes.split()`` uses the same.
WORD_RE = "[^\\x20\\x09-\\x0D]+"

_OWN: list[tempfile.TemporaryDirectory] = []


#: Bytes of a batch that goes to a Python worker at once, unless the session says otherwise: long texts must not add up there.
BATCH_BYTES = 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*cols) if cols else df


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that spark.checkpoint.dir names; a folder of our own only where that is unset and all runs here (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = held.get() if held.isDefined() else None
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        if not _OWN:
            _OWN.append(tempfile.TemporaryDirectory(prefix="lodestar-"))
        root = f"file://{_OWN[0].name}"
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet in the shared folder and read back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def partition_keys(spark: SparkSession, parts: int) -> np.ndarray:
    """A long for each of `parts` hash partitions that repartition(parts, key) sends there: packs dealt by them fill all tasks alike."""
    span = 16 * parts + 1000
    while True:
        rows = spark.range(span).groupBy(F.pmod(F.hash("id"), F.lit(parts)).alias("p")).agg(F.min("id").alias("id")).collect()
        if len(rows) == parts:
            return np.array([r.id for r in sorted(rows, key=lambda r: r.p)], np.int64)
        span *= 2


def held_out(col, remainder: int, modulus: int = 5):
    """crc32(doc_id as text) mod 5 == remainder."""
    return F.crc32(col.cast("string").cast("binary")) % modulus == remainder


def hash_sample(df: DataFrame, rows: int, of: int, over: int = 2, key: str = "doc_id") -> DataFrame:
    """The `rows` rows of smallest hash among those whose hash is in a share of over * rows / of, `of` being the rows of the table.

    The share bounds what all tasks together send to the last one, however many tasks there are. If df keeps fewer than one in `over`
    of the table's rows, the sample may be smaller.
    """
    bits = 1 << 24
    share = min(bits, -(-bits * over * rows // max(of, 1)))
    return df.where(F.pmod(F.xxhash64(key), F.lit(bits)) < share).orderBy(F.xxhash64(key), key).limit(rows)


def most_frequent(counts: DataFrame, most: int, n: str = "n") -> DataFrame:
    """Rows of the largest counts, at most `most`: cut between steps of an eighth of an octave, so no task has to rank all rows."""
    step = F.floor(F.log2(n) * 8).cast("int")
    held, cut = 0, None
    for r in sorted(counts.groupBy(step.alias("s")).agg(F.count(F.lit(1)).alias("v")).collect(), key=lambda r: -r.s):
        held += r.v
        if held > most:
            break
        cut = r.s
    return counts.where(step >= cut if cut is not None else F.lit(False))


def with_fields(df: DataFrame, keep: list[str], **fields: T.DataType) -> T.StructType:
    """The schema of the columns `keep` of df, followed by new fields."""
    return T.StructType([*df.select(*keep).schema.fields, *(T.StructField(k, t) for k, t in fields.items())])


def text_bytes(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """UTF-8 bytes of each text, null as empty, without decoding."""
    col = batch.column(batch.schema.get_field_index(name))
    if pa.types.is_string(col.type) or pa.types.is_large_string(col.type):
        col = col.cast(pa.large_binary() if pa.types.is_large_string(col.type) else pa.binary())
    return [b if b is not None else b"" for b in col.to_pylist()]


_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def pieces(text: bytes, most: int = 1 << 20) -> Iterator[bytes]:
    """The text cut at white space into pieces of about `most` bytes."""
    at = 0
    while at < len(text):
        m = _SPACE.search(text, min(at + most, len(text)))
        end = m.end() if m else len(text)
        yield text[at:end]
        at = end


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def small_batches(batches, most_bytes: int = 8 << 20, most_rows: int = 4096, name: str = "text"):
    """Slices of the batches whose texts hold at most most_bytes (or one row)."""
    for batch in batches:
        i = batch.schema.get_field_index(name)
        sizes = np.diff(_offsets(batch.column(i)))
        start, total = 0, 0
        for k, n in enumerate(sizes):
            if k > start and (total + n > most_bytes or k - start >= most_rows):
                yield batch.slice(start, k - start)
                start, total = k, 0
            total += int(n)
        if batch.num_rows > start:
            yield batch.slice(start, batch.num_rows - start)


def _offsets(col: pa.Array) -> np.ndarray:
    if len(col) == 0:
        return np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type) else np.int32
    return np.frombuffer(col.buffers()[1], kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, giving freed memory back to the system at its end: Python workers are kept for later tasks, and the heap of a large one with them."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
            trim(0)

    return f


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """Connected components of (a, b) links as (node, component), component the smallest node reachable.

    Alternating large-star and small-star rounds over the links alone; each round is written to the shared folder, so the plan
    stays short and a lost executor costs one round. Ends when the links no longer change; a star is then one hop deep.
    Nodes that share no link do not appear. An empty input gives an empty result.
    """
    e = edges.select(F.least(a, b).alias("v"), F.greatest(a, b).alias("u")).where("v <> u").distinct()
    e = written(e, "cc")
    seen = None
    for _ in range(max_rounds):
        both = e.select(F.col("u").alias("x"), F.col("v").alias("y")).union(e.select(F.col("v").alias("x"), F.col("u").alias("y")))
        low = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        # large star: neighbours larger than x go to the smallest around x
        e = both.where("y > x").join(low, "x").select(F.col("m").alias("v"), F.col("y").alias("u")).where("v <> u").distinct()
        # small star: x and its smaller neighbours go to the smallest of them
        least = e.groupBy("u").agg(F.min("v").alias("m"))
        e = e.join(least, "u").select(F.explode(F.array(F.col("u"), F.col("v"))).alias("u"), F.col("m").alias("v")).where("v <> u").distinct()
        e = written(e.select("v", "u"), "cc")
        s = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        if (s[0], s[1]) == seen:
            break
        seen = (s[0], s[1])
    else:
        raise RuntimeError(f"links did not settle in {max_rounds} rounds")
    return e.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component").union(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
