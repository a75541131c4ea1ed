"""Readers of the landing formats: tar archives of JSON, line lists, raw payloads, keyset increments, static dimensions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Canonical killmail payload.
PAYLOAD = (
    "killmail_id long, killmail_time string, solar_system_id long, "
    "victim struct<character_id:long, corporation_id:long, alliance_id:long, ship_type_id:long, damage_taken:double, items:array<struct<item_type_id:long, flag:int, quantity_destroyed:long, quantity_dropped:long>>>, "
    "attackers array<struct<character_id:long, corporation_id:long, alliance_id:long, ship_type_id:long, damage_done:double, final_blow:boolean>>, "
    "zkb struct<totalValue:double, npc:boolean, hash:string>"
)


def archive_texts(spark: SparkSession, path: str, suffix: str = ".json") -> DataFrame:
    """Members of the tar archives (plain, gzip, bzip2, xz) in a folder as rows: archive, member, payload."""
    return members(spark.read.format("binaryFile").option("pathGlobFilter", "*.tar*").load(path), suffix)


def members(archives: DataFrame, suffix: str = ".json") -> DataFrame:
    """Members of archives (path, content) as rows. An archive is held as it is stored; its members are read one after the other."""

    def run(batches):
        import io
        import tarfile

        import pandas as pd

        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"]):
                rows = []
                with tarfile.open(fileobj=io.BytesIO(content), mode="r:*") as tar:
                    for m in tar:
                        if m.isfile() and m.name.endswith(suffix):
                            rows.append((name, m.name, tar.extractfile(m).read().decode("utf-8", "replace")))
                            if len(rows) >= 1000:
                                yield pd.DataFrame(rows, columns=["archive", "member", "payload"])
                                rows = []
                yield pd.DataFrame(rows, columns=["archive", "member", "payload"])

    return archives.select("path", "content").mapInPandas(run, "archive string, member string, payload string")


def normalised(raw: DataFrame, payload: str = "payload") -> DataFrame:
    """Payload text as canonical events: nested payloads ({"killmail": ...}) are unwrapped, malformed ones go."""
    j = F.from_json(F.coalesce(F.get_json_object(payload, "$.killmail"), F.get_json_object(payload, "$.esi"), F.col(payload)), PAYLOAD)
    k = raw.select(j.alias("k")).where("k.killmail_id is not null").dropDuplicates(["k"])
    return k.select(F.col("k.killmail_id").alias("sequence_id"), F.to_timestamp("k.killmail_time").alias("killmail_time"), F.col("k.solar_system_id").alias("system_id"), "k.victim", "k.attackers", F.col("k.zkb.totalValue").alias("total_value"), F.coalesce("k.zkb.npc", F.lit(False)).alias("npc"))


def attackers_of(events: DataFrame) -> DataFrame:
    return events.select("sequence_id", F.posexplode("attackers").alias("position", "a")).select("sequence_id", "position", "a.*")


def items_of(events: DataFrame) -> DataFrame:
    return events.select("sequence_id", F.explode("victim.items").alias("i")).select("sequence_id", "i.*")


def bridge_lists(spark: SparkSession, path: str) -> DataFrame:
    """Free-text lists with lines like `A » B` (also -> and -->): a, b, once a pair whatever its direction."""
    sep = r"\s*(?:»|-->|->|=>)\s*"
    t = spark.read.text(path).select(F.trim(F.regexp_replace("value", r"#.*$", "")).alias("v")).where(F.col("v").rlike(sep))
    p = t.select(F.split("v", sep).alias("p")).select(F.trim(F.col("p")[0]).alias("x"), F.trim(F.split(F.col("p")[1], r"\s{2,}|\t")[0]).alias("y")).where("x <> '' and y <> ''")
    return p.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).where("a <> b").distinct()


def after(df: DataFrame, key: str, cursor) -> DataFrame:
    """Keyset increment: rows past the cursor. No row limit, so no batch can cut a group in two."""
    return df if cursor is None else df.where(F.col(key) > F.lit(cursor))


def dimension(df: DataFrame, key: str, most_rows: int = 1_000_000) -> DataFrame:
    """A dimension to broadcast where it has at most most_rows rows; larger ones are joined as they are."""
    small = df.limit(most_rows + 1).count() <= most_rows
    d = df.dropDuplicates([key])
    return F.broadcast(d) if small else d
