"""WARC as a PySpark Python data source.

Reading: partitions are planned over files; filters on record type and header fields are pushed down; each record's headers are
parsed first, and a payload is decoded only if the record passes and the schema asks for it. Otherwise the reader seeks to the next
record: past Content-Length in plain files, and by the skip lengths ('sl' extra field) of a gzip member, or by inflating without
keeping where a member has none.

Writing: each task writes files of bounded size under a name of its own; commit lists them, abort removes them.

Paths go through pyarrow.fs, so file:, hdfs:, s3: and gs: URIs work where their client libraries are present.

Defined results of op8: null html is an empty payload; a null page_id is always a response and never referred to; repeated rows of one
page_id with one payload are records of the same type; an empty table gives no archive records.
"""

from __future__ import annotations

import base64
import io
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, In, InputPartition, WriterCommitMessage

from lodestar.llm._base import shared_dir, table

SCHEMA = "record_type string, record_id string, target_uri string, date string, payload_digest string, payload_bytes long, refers_to string, headers map<string,string>, payload binary"
#: Header of each column that a filter can be pushed on.
HEADER_OF = {"record_type": "warc-type", "record_id": "warc-record-id", "target_uri": "warc-target-uri", "date": "warc-date", "refers_to": "warc-refers-to"}
FILE_BYTES = 64 << 20
HEAD_BYTES = 4096
BATCH_BYTES = 4 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def open_fs(path: str) -> tuple[pafs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        if path.startswith("file:") and not path.startswith("file://"):
            path = "file://" + path[5:]
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), path


def clean(value: str) -> str:
    """A header value: line ends and other control characters percent-encoded."""
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in value)


def record(kind: str, record_id: str, uri: str | None, date: str, digest: str, n: int, payload: bytes | None, refers_to: str | None) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % n
    block = http + (payload or b"")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {date}"]
    if uri is not None:
        head.append(f"WARC-Target-URI: {clean(uri)}")
    head.append(f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}")
    if kind == "revisit":
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{refers_to}>"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = 1) -> bytes:
    """A gzip member with the lengths of itself and of its content in an 'sl' extra field."""
    c = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = c.compress(data) + c.flush()
    total = 10 + 2 + 12 + len(body) + 8
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<HccHII", 12, b"s", b"l", 8, total, len(data)) + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def parse_head(data: bytes) -> tuple[dict[str, str], int] | None:
    """Header fields (names in lower case) and where the block starts; None if data ends before the head does."""
    end = data.find(b"\r\n\r\n")
    if end < 0:
        return None
    out: dict[str, str] = {}
    name = ""
    for i, line in enumerate(data[:end].decode("utf-8", "replace").split("\r\n")):
        if i == 0:
            if not line.startswith("WARC/"):
                raise ValueError(f"not a WARC record: {line[:40]!r}")
        elif line[:1] in " \t" and name:
            out[name] += " " + line.strip()
        else:
            name, _, value = line.partition(":")
            name = name.strip().lower()
            out[name] = value.strip()
    return out, end + 4


class GzipRecord:
    """One gzip member: its first bytes are inflated for the head, the rest only on demand."""

    def __init__(self, f, at: int):
        self.f, self.at, self.total = f, at, None
        f.seek(at)
        fixed = f.read(10)
        flags, extra = fixed[3], b""
        size = 10
        if flags & 4:
            n = struct.unpack("<H", f.read(2))[0]
            extra = f.read(n)
            size += 2 + n
        for bit in (8, 16):  # name, comment
            if flags & bit:
                while f.read(1) not in (b"\0", b""):
                    size += 1
                size += 1
        if flags & 2:
            f.read(2)
            size += 2
        k = 0
        while k + 4 <= len(extra):
            n = struct.unpack("<H", extra[k + 2 : k + 4])[0]
            if extra[k : k + 2] == b"sl" and n == 8:
                self.total = struct.unpack("<I", extra[k + 4 : k + 8])[0]
            k += 4 + n
        self.z, self.data, self.done = zlib.decompressobj(-15), b"", False
        self.read_bytes = size

    def more(self, n: int) -> bool:
        if self.done:
            return False
        chunk = self.z.unconsumed_tail or self.f.read(65536)
        if not self.z.unconsumed_tail:
            self.read_bytes += len(chunk)
        self.data += self.z.decompress(chunk, n)
        self.done = self.z.eof or not chunk
        return True

    def head(self) -> tuple[dict[str, str], int]:
        while (got := parse_head(self.data)) is None:
            if not self.more(HEAD_BYTES):
                raise ValueError("the archive ends within a record head")
        return got

    def block(self, start: int, n: int) -> bytes:
        parts, have = [self.data], len(self.data)
        while have < start + n and not self.done:
            self.data = b""
            self.more(1 << 20)
            parts.append(self.data)
            have += len(self.data)
        self.data = b"".join(parts)
        return self.data[start : start + n]

    def end(self) -> int:
        if self.total is not None:
            return self.at + self.total
        while not self.done:
            self.data = b""
            self.more(1 << 20)
        return self.at + self.read_bytes - len(self.z.unused_data) + 8


class PlainRecord:
    def __init__(self, f, at: int):
        self.f, self.at, self.data = f, at, b""
        f.seek(at)

    def head(self) -> tuple[dict[str, str], int]:
        while (got := parse_head(self.data)) is None:
            more = self.f.read(HEAD_BYTES)
            if not more:
                raise ValueError("the archive ends within a record head")
            self.data += more
        self.start, self.length = got[1], int(got[0].get("content-length", 0))
        return got

    def block(self, start: int, n: int) -> bytes:
        have = self.data[start : start + n]
        return have + self.f.read(n - len(have))

    def end(self) -> int:
        return self.at + self.start + self.length + 4


def records(f, wanted=lambda head: True) -> Iterator[tuple[dict[str, str], object]]:
    """Head and a function giving the block, for each wanted record of a seekable file."""
    size = f.seek(0, 2)
    at = 0
    while at < size:
        f.seek(at)
        magic = f.read(2)
        if not magic.strip(b"\r\n"):
            at += max(1, len(magic))
            continue
        rec = GzipRecord(f, at) if magic == b"\x1f\x8b" else PlainRecord(f, at)
        head, start = rec.head()
        if wanted(head):
            n = int(head.get("content-length", 0))
            yield head, lambda rec=rec, start=start, n=n: rec.block(start, n)
        at = rec.end()


def payload_of(head: dict[str, str], block: bytes) -> bytes:
    if head.get("content-type", "").startswith("application/http"):
        return block.partition(b"\r\n\r\n")[2]
    return block


def hex_digest(value: str | None) -> str | None:
    if not value:
        return None
    kind, _, v = value.rpartition(":")
    if kind.lower() == "sha1" and len(v) == 32:
        return base64.b32decode(v).hex()
    return v.lower()


def bare(value: str | None) -> str | None:
    return value.strip("<>") if value else None


@dataclass
class FilePart(InputPartition):
    path: str


class WarcReader(DataSourceReader):
    def __init__(self, schema, options: dict):
        self.columns = schema.fieldNames()
        self.arrow = pa.schema([(f.name, _ARROW[f.name]) for f in schema.fields])
        self.path = options["path"]
        self.tests: list[tuple[str, frozenset]] = []

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 and f.attribute[0] in HEADER_OF:
                self.tests.append((f.attribute[0], frozenset(f.value if isinstance(f, In) else [f.value])))
            else:
                yield f

    def partitions(self):
        fs, root = open_fs(self.path)
        info = fs.get_file_info(root)
        files = [info] if info.type == pafs.FileType.File else fs.get_file_info(pafs.FileSelector(root, recursive=True, allow_not_found=True))
        return [FilePart(i.path) for i in sorted(files, key=lambda i: -(i.size or 0)) if i.type == pafs.FileType.File and i.path.endswith((".warc", ".warc.gz"))]

    def wanted(self, head: dict[str, str]) -> bool:
        for name, values in self.tests:
            v = head.get(HEADER_OF[name])
            if (bare(v) if name in ("record_id", "refers_to") else v) not in values:
                return False
        return True

    def read(self, partition):
        if partition is None:  # no archive files
            return
        fs, _ = open_fs(self.path)
        rows, held = [], 0
        with fs.open_input_file(partition.path) as raw:
            f = io.BufferedReader(raw, 1 << 16) if not isinstance(raw, io.RawIOBase) else raw
            for head, block in records(f, self.wanted):
                rows.append(tuple(_VALUE[c](head, block) for c in self.columns))
                held += 200 + (len(rows[-1][self.columns.index("payload")] or b"") if "payload" in self.columns else 0)
                if held >= BATCH_BYTES:
                    yield self._batch(rows)
                    rows, held = [], 0
        if rows:
            yield self._batch(rows)

    def _batch(self, rows):
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), self.arrow.types)], schema=self.arrow)


def _http_length(head: dict[str, str], block) -> int | None:
    """Payload bytes: the Content-Length of the HTTP head within the block, which a revisit keeps too."""
    if not head.get("content-type", "").startswith("application/http"):
        return int(head.get("content-length", 0))
    http = block().partition(b"\r\n\r\n")[0].decode("latin-1").lower()
    n = [x.partition(":")[2] for x in http.split("\r\n") if x.startswith("content-length:")]
    return int(n[0]) if n else None


_VALUE = {
    "record_type": lambda h, b: h.get("warc-type"), "record_id": lambda h, b: bare(h.get("warc-record-id")), "target_uri": lambda h, b: h.get("warc-target-uri"),
    "date": lambda h, b: h.get("warc-date"), "payload_digest": lambda h, b: hex_digest(h.get("warc-payload-digest")), "payload_bytes": _http_length,
    "refers_to": lambda h, b: bare(h.get("warc-refers-to")), "headers": lambda h, b: list(h.items()), "payload": lambda h, b: payload_of(h, b()),
}
_ARROW = {k: pa.string() for k in ("record_type", "record_id", "target_uri", "date", "payload_digest", "refers_to")} | {"payload_bytes": pa.int64(), "headers": pa.map_(pa.string(), pa.string()), "payload": pa.binary()}


@dataclass
class Written(WriterCommitMessage):
    files: list


class WarcWriter(DataSourceWriter):
    """Rows need record_type, record_id, target_uri, date, payload_digest, payload_bytes, refers_to and payload, by name."""

    def __init__(self, options: dict, overwrite: bool = False):
        self.path, self.overwrite = options["path"], overwrite
        self.job = uuid.uuid4().hex  # made on the driver, so all tasks of the job share it
        self.gzip = options.get("compression", "gzip") == "gzip"

    def write(self, iterator):
        fs, root = open_fs(self.path)
        fs.create_dir(root, recursive=True)
        files, out, size = [], None, 0
        try:
            for r in iterator:
                if out is None:
                    files.append(f"{root}/part-{self.job}-{uuid.uuid4().hex}.warc{'.gz' * self.gzip}")
                    out, size = fs.open_output_stream(files[-1], compression=None), 0
                data = record(r.record_type, r.record_id, r.target_uri, r.date, r.payload_digest, r.payload_bytes, None if r.payload is None else bytes(r.payload), r.refers_to)
                data = member(data) if self.gzip else data
                out.write(data)
                size += len(data)
                if size >= FILE_BYTES:
                    out.close()
                    out = None
        except BaseException:
            if out is not None:
                out.close()
            for f in files:
                fs.delete_file(f)
            raise
        if out is not None:
            out.close()
        return Written(files)

    def commit(self, messages):
        """Files of this job that no committed task names are of attempts that were lost: they go, and so does what is overwritten."""
        fs, root = open_fs(self.path)
        kept = {f.rpartition("/")[2] for m in messages if m is not None for f in m.files}
        for i in fs.get_file_info(pafs.FileSelector(root, allow_not_found=True)):
            own = i.base_name.startswith(f"part-{self.job}-")
            if i.type == pafs.FileType.File and i.base_name not in kept and (own or self.overwrite and i.base_name.endswith((".warc", ".warc.gz"))):
                fs.delete_file(i.path)

    def abort(self, messages):
        fs, _ = open_fs(self.path)
        for m in messages:
            for f in m.files if m is not None else []:
                fs.delete_file(f)


class WarcDataSource(DataSource):
    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(schema, self.options)

    def writer(self, schema, overwrite):
        return WarcWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


MIN_REVISIT_BYTES = 1000
DATE = "2024-01-01T00:00:00Z"


def as_records(pages: DataFrame, date: str = DATE) -> DataFrame:
    """The record of each page: of equal payloads the largest page_id is the response, the others revisit it without payload."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    p = pages.select("page_id", "url", payload.alias("payload")).withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("payload_digest", F.sha1("payload"))
    long_ones = p.where((F.col("payload_bytes") >= MIN_REVISIT_BYTES) & F.col("page_id").isNotNull()).select("page_id", "payload_digest", "payload_bytes")
    tops = long_ones.groupBy("payload_digest", "payload_bytes").agg(F.max("page_id").alias("top"), F.min("page_id").alias("low")).where("low < top").drop("low")
    refs = long_ones.join(tops, ["payload_digest", "payload_bytes"]).where("page_id < top").groupBy("page_id", "payload_digest").agg(F.max("top").alias("top"))
    # joined by page, not by payload: a payload that many pages share is then no hot key
    j = p.join(refs, ["page_id", "payload_digest"], "left")
    again = F.col("top").isNotNull()
    urn = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(c.cast("string"), F.lit("none")))
    return j.select(
        F.when(again, "revisit").otherwise("response").alias("record_type"), urn(F.col("page_id")).alias("record_id"), F.col("url").alias("target_uri"), F.lit(date).alias("date"),
        "payload_digest", "payload_bytes", F.when(again, urn(F.col("top"))).alias("refers_to"), F.when(~again, F.col("payload")).alias("payload"),
    )


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    register(spark)
    path = shared_dir(spark, "warc")
    as_records(table(spark, sf_dir, "pages", "page_id", "url", "html")).write.format("warc").mode("append").save(path)
    read = lambda cols: spark.read.format("warc").schema(cols).load(path)
    # responses are checked against what the archive holds; revisits need their heads only
    full = read("record_type string, record_id string, payload binary").where("record_type = 'response'")
    full = full.select("record_id", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"), "record_type", F.lit(None).cast("string").alias("refers_to"))
    again = read("record_type string, record_id string, payload_digest string, payload_bytes long, refers_to string").where("record_type = 'revisit'")
    out = full.union(again.select("record_id", "payload_bytes", "payload_digest", "record_type", "refers_to"))
    number = lambda c: F.regexp_extract(c, r"^urn:page:(-?\d+)$", 1).try_cast("long")
    return out.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"))


ORACLE = """
WITH p AS (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
t AS (SELECT payload_digest, payload_bytes, max(page_id) AS top FROM p WHERE payload_bytes >= 1000 GROUP BY ALL)
SELECT page_id, p.payload_bytes, p.payload_digest, CASE WHEN page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id < top THEN top END AS refers_to
FROM p LEFT JOIN t ON p.payload_digest = t.payload_digest AND p.payload_bytes = t.payload_bytes
"""
