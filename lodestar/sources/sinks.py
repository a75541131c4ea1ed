"""Write semantics over Parquet tables in a folder: refresh, replace by partition, upsert, append of what is absent, retention, encoders.

Results are written beside the table and take its place by a rename of the version file, so readers see one whole version, a failed write
leaves the old one, and a retried write starts anew.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.operators import relational as R


class Table:
    """A versioned Parquet table: folder/v=<id> and a file CURRENT that names the version."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._p = jvm.org.apache.hadoop.fs.Path
        self._fs = self._p(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def version(self) -> str | None:
        at = self._p(f"{self.path}/CURRENT")
        if not self._fs.exists(at):
            return None
        return self.spark.read.text(f"{self.path}/CURRENT").first()[0]

    def read(self) -> DataFrame | None:
        v = self.version()
        return None if v is None else self.spark.read.parquet(f"{self.path}/v={v}")

    def refresh(self, df: DataFrame, by: Sequence[str] = ()) -> None:
        """Wipe and insert."""
        old, new = self.version(), uuid.uuid4().hex
        w = df.write
        (w.partitionBy(*by) if by else w).parquet(f"{self.path}/v={new}")
        out = self._fs.create(self._p(f"{self.path}/CURRENT.{new}"), True)
        out.write(bytearray(new.encode()))
        out.close()
        self._fs.delete(self._p(f"{self.path}/CURRENT"), False)
        if not self._fs.rename(self._p(f"{self.path}/CURRENT.{new}"), self._p(f"{self.path}/CURRENT")):
            raise OSError(f"the new version of {self.path} could not take its place")
        if old:
            self._fs.delete(self._p(f"{self.path}/v={old}"), True)

    def upsert(self, df: DataFrame, key: Sequence[str], **how) -> None:
        old = self.read()
        self.refresh(df if old is None else R.upsert(old, df, key, **how))

    def insert_absent(self, df: DataFrame, key: Sequence[str]) -> None:
        old = self.read()
        self.refresh(df.dropDuplicates(list(key)) if old is None else R.insert_absent(old, df, key))

    def replace_where(self, df: DataFrame, by: Sequence[str]) -> None:
        """Rows of the groups that df has are replaced, others stay (one source's order book)."""
        old = self.read()
        self.refresh(df if old is None else old.join(df.select(*by).distinct(), list(by), "left_anti").unionByName(df))

    def delete_absent(self, df: DataFrame, key: Sequence[str]) -> None:
        old = self.read()
        if old is not None:
            self.refresh(old.join(df.select(*key).distinct(), list(key), "left_semi"))

    def retain(self, keep: Column) -> None:
        old = self.read()
        if old is not None:
            self.refresh(old.where(keep))


def line_protocol(measurement: str, tags: Sequence[str], fields: Sequence[str], ts: str) -> Column:
    """measurement,tag=v field=v time-in-ns; commas, spaces and equal signs in tags are escaped."""
    esc = lambda c: F.regexp_replace(F.col(c).cast("string"), r"([,= ])", r"\\$1")
    t = F.concat(F.lit(measurement), *[F.concat(F.lit(f",{c}="), esc(c)) for c in tags])
    return F.concat_ws(" ", t, F.concat_ws(",", *[F.concat(F.lit(f"{c}="), F.col(c).cast("string")) for c in fields]), (F.unix_micros(ts) * 1000).cast("string"))


def snapshot(df: DataFrame, key: str, as_of, ttl_seconds: int) -> DataFrame:
    """One row per key: its rows as a JSON array, with the time it ends."""
    rest = [c for c in df.columns if c != key]
    g = df.groupBy(key).agg(F.to_json(F.array_sort(F.collect_list(F.struct(*rest)))).alias("payload"))
    return g.withColumn("expires_at", F.lit(as_of).cast("timestamp") + F.expr(f"INTERVAL {ttl_seconds} SECONDS"))


def checksum(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows and an order-free checksum, for exports."""
    return df.agg(F.count(F.lit(1)).alias("rows"), F.sum(F.xxhash64(*key).cast("decimal(38,0)")).alias("checksum"))
