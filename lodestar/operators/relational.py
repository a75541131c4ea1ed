"""Relational operators that the plans are composed of."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k(df: DataFrame, by: Sequence[str], order: Sequence[Column | str], k: int, rank: str = "rn") -> DataFrame:
    """The k first rows of each group; order must be total. Catalyst turns the filter into a group limit before the shuffle."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(rank) <= k)


def latest(df: DataFrame, by: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    return top_k(df, by, order, 1, "_rn").drop("_rn")


def islands(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str, out: str = "island") -> DataFrame:
    """Number of the run of equal values that a row is in."""
    w = Window.partitionBy(*by).orderBy(*order)
    new = ~F.col(value).eqNullSafe(F.lag(value).over(w)) | (F.row_number().over(w) == 1)
    return df.withColumn("_new", new.cast("int")).withColumn(out, F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def gap_islands(df: DataFrame, by: Sequence[str], start: str, end: str, tie: str, gap_seconds: int, out: str = "island") -> DataFrame:
    """Runs of intervals that begin within gap_seconds of the latest end before them."""
    w = Window.partitionBy(*by).orderBy(start, tie)
    before = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = before.isNull() | (F.unix_micros(start) - F.unix_micros(before) > gap_seconds * 1_000_000)
    return df.withColumn("_new", new.cast("int")).withColumn(out, F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def band_join(a: DataFrame, b: DataFrame, on: Sequence[str], a_ts: str, b_ts: str, seconds: int) -> DataFrame:
    """Pairs with equal keys whose times differ by at most `seconds`: one side meets the buckets next to its own, then the exact test.

    Columns of the sides must differ but for `on`. A plain range condition would make a product of each key's rows.
    """
    bucket = lambda c: F.floor(F.unix_micros(c) / (seconds * 1_000_000))
    left = a.withColumn("_b", bucket(F.col(a_ts)))
    right = b.withColumn("_b", F.explode(F.sequence(bucket(F.col(b_ts)) - 1, bucket(F.col(b_ts)) + 1)))
    j = left.join(right, [*on, "_b"]).drop("_b")
    return j.where(F.abs(F.unix_micros(a_ts) - F.unix_micros(b_ts)) <= seconds * 1_000_000)


def overlap_join(a: DataFrame, b: DataFrame, on: Sequence[str], a_iv: tuple[str, str], b_iv: tuple[str, str], bucket_days: int = 64) -> DataFrame:
    """Pairs with equal keys whose intervals share a time. Both sides are cut into buckets; a pair counts in the bucket of its first common one."""
    day = lambda c: F.floor(F.unix_micros(c) / (bucket_days * 86_400_000_000))
    left = a.withColumn("_b", F.explode(F.sequence(day(F.col(a_iv[0])), day(F.col(a_iv[1])))))
    right = b.withColumn("_b", F.explode(F.sequence(day(F.col(b_iv[0])), day(F.col(b_iv[1])))))
    j = left.join(right, [*on, "_b"]).where((F.col(a_iv[0]) <= F.col(b_iv[1])) & (F.col(b_iv[0]) <= F.col(a_iv[1])))
    return j.where(F.col("_b") == day(F.greatest(a_iv[0], b_iv[0]))).drop("_b")


def pairs(df: DataFrame, group: Sequence[str], node: str) -> DataFrame:
    """Pairs a < b of the distinct nodes of a group."""
    d = df.select(*group, node).distinct()
    return d.withColumnRenamed(node, "a").join(d.withColumnRenamed(node, "b"), list(group)).where("a < b")


#: Nodes of a block on average: a task holds the pairs of two blocks at once.
BLOCK = 800


def met_pairs(df: DataFrame, space: Sequence[str], item: Sequence[str], node: str, band: tuple[str, int] | None = None) -> DataFrame:
    """Pairs of rows with equal space and item, of nodes a < b, as (meet, a, b, x, y): x and y are the rows of a and b. Group by meet, a, b.

    Pairs grow with the square of a group, so they are not shuffled: nodes are dealt to blocks, rows go to each pair of blocks that meets in
    their space, and the result is partitioned by that pair (meet), which decides where a and b are grouped; it is one for a pair of nodes.
    With a band (column, seconds), times of the rows differ by that much at most.
    """
    rows = df.where(F.col(node).isNotNull())
    for c in (*space, *item):
        rows = rows.where(F.col(c).isNotNull())
    home = rows.groupBy(F.col(node).alias("_node")).agg(F.min(F.struct(*space)).alias("_home"))
    size = home.groupBy("_home").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("_k"))
    block = home.join(size, "_home").select("_node", F.xxhash64("_home", F.pmod(F.xxhash64("_node"), F.col("_k"))).alias("_z"))
    rows = rows.join(block, rows[node] == F.col("_node")).drop("_node")
    around = rows.groupBy(*(F.col(c).alias(f"_s_{c}") for c in space)).agg(F.collect_set("_z").alias("_w"))
    count = around.select(F.explode("_w").alias("u"), "_w").select("u", F.explode("_w").alias("w")).where("u <= w").distinct().count()
    keep = [F.col(c) for c in df.columns if c not in {*space, *item}]
    on = [F.col(c) == F.col(f"_s_{c}") for c in space]
    rows = rows.join(around, on).select(*space, *item, "_z", F.struct(*keep).alias("_row"), F.explode("_w").alias("_w"))
    meet = F.xxhash64(F.least("_z", "_w"), F.greatest("_z", "_w")).alias("meet")
    sides = F.when(F.col("_z") < F.col("_w"), F.array(F.lit(0))).when(F.col("_z") > F.col("_w"), F.array(F.lit(1))).otherwise(F.array(F.lit(0), F.lit(1)))
    rows = rows.select(*space, *item, meet, (F.col("_z") == F.col("_w")).alias("_one"), "_row", F.explode(sides).alias("_side"))
    group = ["meet", "_one", *space, *item]
    if band:
        at = F.floor(F.unix_micros(F.col(f"_row.{band[0]}")) / (band[1] * 1_000_000))
        near = F.when(F.col("_side") == 0, F.array(at)).otherwise(F.sequence(at - 1, at + 1))
        rows, group = rows.withColumn("_b", F.explode(near)), [*group, "_b"]
    lists = [F.collect_list(F.when(F.col("_side") == i, F.col("_row"))).alias(c) for i, c in ((0, "_p"), (1, "_q"))]
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")), count)
    two = rows.repartition(parts, "meet").groupBy(*group).agg(*lists).select("meet", "_one", F.explode("_p").alias("_p"), "_q").select("meet", "_one", "_p", F.explode("_q").alias("_q"))
    p, q = F.col(f"_p.{node}"), F.col(f"_q.{node}")
    two = two.where((p < q) | ~F.col("_one") & (p != q))
    if band:
        two = two.where(F.abs(F.unix_micros(F.col(f"_p.{band[0]}")) - F.unix_micros(F.col(f"_q.{band[0]}"))) <= band[1] * 1_000_000)
    first, last = F.when(p < q, F.col("_p")).otherwise(F.col("_q")), F.when(p < q, F.col("_q")).otherwise(F.col("_p"))
    return two.select("meet", F.least(p, q).alias("a"), F.greatest(p, q).alias("b"), first.alias("x"), last.alias("y"))


def full_outer(a: DataFrame, b: DataFrame, on: Sequence[str]) -> DataFrame:
    return a.join(b, list(on), "full")


def upsert(old: DataFrame, new: DataFrame, key: Sequence[str], keep_first: Sequence[str] = (), add: Sequence[str] = (), least: Sequence[str] = (), greatest: Sequence[str] = ()) -> DataFrame:
    """Rows of old replaced or joined by those of new: keep_first keeps old values, add sums, least and greatest fold, the rest take new."""
    o = old.select(*key, *[F.col(c).alias(f"_o_{c}") for c in old.columns if c not in key], F.lit(True).alias("_old"))
    n = new.select(*key, *[F.col(c).alias(f"_n_{c}") for c in old.columns if c not in key], F.lit(True).alias("_new"))
    j = o.join(n, list(key), "full")
    cols = []
    for c in old.columns:
        if c in key:
            cols.append(F.col(c))
            continue
        a, b = F.col(f"_o_{c}"), F.col(f"_n_{c}")
        if c in keep_first:
            v = F.coalesce(a, b)
        elif c in add:
            v = F.when(a.isNull() & b.isNull(), None).otherwise(F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)))
        elif c in least:
            v = F.least(a, b)
        elif c in greatest:
            v = F.greatest(a, b)
        else:
            v = F.when(F.col("_new"), b).otherwise(a)
        cols.append(v.alias(c))
    return j.select(*cols)


def insert_absent(old: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    return old.unionByName(new.dropDuplicates(list(key)).join(old.select(*key), list(key), "left_anti"))


def value_counts_ranked(df: DataFrame, col: str, buckets: int = 64) -> DataFrame:
    """Each distinct value of col with below (rows under it), upto (rows at or under it) and total, without ordering all values in one task.

    Values are dealt to ranges cut at approximate quantiles; counts run within each range, on top of the ranges before it. The cuts only
    decide who counts what: results are exact, and equal values share a range. Ranks, cume_dist, percent_rank and discrete percentiles
    follow from the three numbers.
    """
    c = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("_c"))
    cuts = sorted(set(df.select(F.col(col).cast("double")).approxQuantile(col, [i / buckets for i in range(1, buckets)], 0.5 / buckets)))
    bucket = F.lit(0)
    if cuts:
        bucket = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda x: x < F.col(col)))
    c = c.withColumn("_b", bucket)
    ranges = c.groupBy("_b").agg(F.sum("_c").alias("_s"))  # at most `buckets` rows
    w = Window.orderBy("_b")
    ranges = ranges.select("_b", (F.sum("_s").over(w) - F.col("_s")).alias("_before"), F.sum("_s").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("total"))
    upto = F.sum("_c").over(Window.partitionBy("_b").orderBy(col)) + F.col("_before")
    return c.join(F.broadcast(ranges), "_b").select(col, (upto - F.col("_c")).alias("below"), upto.alias("upto"), "total")


def keep_spaced(df: DataFrame, by: str, ts: str, tie: str, seconds: int) -> DataFrame:
    """Rows that come `seconds` or more after the last kept row of their group: a running choice over each group's sorted times."""
    rows = df.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(F.unix_micros(ts).alias("t"), F.col(tie).alias("i")))).alias("z"))
    zero = F.struct(F.lit(None).cast("bigint").alias("last"), F.array().cast("array<bigint>").alias("keep"))

    def step(a, x):
        take = a["last"].isNull() | (x["t"] - a["last"] >= seconds * 1_000_000)
        return F.struct(F.when(take, x["t"]).otherwise(a["last"]).alias("last"), F.when(take, F.concat(a["keep"], F.array(x["i"].cast("bigint")))).otherwise(a["keep"]).alias("keep"))

    kept = rows.select(by, F.explode(F.aggregate("z", zero, step, lambda a: a["keep"])).alias(tie))
    return df.join(kept, [by, tie], "left_semi")
