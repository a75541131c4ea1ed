"""Mixing sources to target weights along a time-varying curriculum.

Targets: sources in code-point order (null last) weigh 3, 1, 2, repeating, and share 150 % of all words; a target stops at twice its
source's words and the excess is reshared by weight until none is above. Each source's weight changes linearly over the training run,
with the target as its integral. Documents of a source stand in a fixed pseudo-random order (a hash of doc_id and text), once a pass; the
words before an occurrence of a document are its cumulative demand, and the time at which the integrated schedule reaches that demand is its
training position. A document that is taken again has a position for every time.

Cumulative sums are taken in two steps, over 4,096 hash ranges of each source and within each range, so a source that holds a third of
all rows is spread over as many tasks as the others. Sources are ranked, and the level that targets reach is found, on tables of one row a
source, for any number of sources.

Defined results: a null text has size 0; a null source is a source of its own; documents of size 0 take 0 words and have no position;
repeated rows and rows without doc_id are taken as rows; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.llm._base import WORD_RE, shuffle_parts, table, written

WEIGHTS = (3.0, 1.0, 2.0)
#: Change of a source's weight over the run, in shares of its mean: from 1 - s at the start to 1 + s at the end; repeating.
SLOPES = (0.5, 0.0, -0.5)
BUDGET = 1.5
MOST_REPEATS = 2.0
RANGE_DIGITS = 3
#: Sources that the driver looks at when it settles the level; more are split again.
AT_ONCE = 10_000
KEY = ["no_source", "name"]


def ranked(sums: DataFrame) -> DataFrame:
    """no_source, name, n and rank (from 0, in code-point order, null last) of every source: ranks within ranges of names, plus those before."""
    one = sums.groupBy(*KEY).agg(F.sum("words").alias("n"))
    one = written(one.repartitionByRange(shuffle_parts(sums.sparkSession), *KEY).withColumn("part", F.spark_partition_id()), "mix-names")
    before, total = {}, 0
    for r in one.groupBy("part").agg(F.count(F.lit(1)).alias("c")).orderBy("part").collect():  # one row a partition
        before[r.part], total = total, total + r.c
    at = F.row_number().over(Window.partitionBy("part").orderBy(*KEY)) - 1
    ahead = F.coalesce(*[F.when(F.col("part") == k, v) for k, v in before.items()], F.lit(0)) if before else F.lit(0)
    return one.select(*KEY, "n", (at + ahead).cast("long").alias("rank"))


def level_of(sources: DataFrame, budget: float, most: float) -> float | None:
    """The words for a weight of 1 at which targets hold the budget: sources with limit / weight under it are full. None: all are.

    Sources are added up by steps of limit / weight; the step in which the level lies is split until few enough are in it.
    """
    lo, hi, below = 0.0, float("inf"), 0.0  # the level is in lo..hi; limits of sources under lo
    share = F.col("ratio")
    all_ = sources.agg(F.sum("n").alias("n"), F.sum("w").alias("w"), F.min(share).alias("lo"), F.max(share).alias("hi")).first()
    if not all_.n:
        return None
    want, above = budget * all_.n, all_.w
    if want >= most * all_.n:
        return None
    lo, hi = all_.lo, all_.hi
    while True:
        inside = sources.where((share >= lo) & (share <= hi))
        if lo == hi or inside.count() <= AT_ONCE:
            break
        width = (hi - lo) / 1000
        steps = inside.groupBy(F.least(F.floor((share - lo) / width), F.lit(999)).alias("s")).agg(F.sum("n").alias("n"), F.sum("w").alias("w"), F.min(share).alias("a"), F.max(share).alias("b"))
        for r in sorted(steps.collect(), key=lambda r: r.s):  # 1000 at most
            # the level is in this step if sources up to its end cannot all be full
            if (want - below - most * r.n) <= r.b * (above - r.w) or r.b == hi:
                lo, hi = r.a, r.b
                break
            below, above = below + most * r.n, above - r.w
    if lo == hi:
        return (want - below) / above
    for r in sorted(inside.select("n", "w", "ratio").collect(), key=lambda r: r.ratio):
        if (want - below) / above * r.w <= most * r.n:
            return (want - below) / above
        below, above = below + most * r.n, above - r.w
    return (want - below) / above


def with_targets(sums: DataFrame, weights: Sequence[float], slopes: Sequence[float], budget: float, most: float) -> DataFrame:
    """no_source, name, source_size, target and slope of every source."""
    pick = lambda v: F.element_at(F.array(*map(F.lit, v)), (F.col("rank") % len(v) + 1).cast("int"))
    s = ranked(sums).select(*KEY, "n", pick(weights).alias("w"), pick(slopes).alias("slope")).withColumn("ratio", F.lit(most) * F.col("n") / F.col("w"))
    s = written(s, "mix-sources")
    level = level_of(s, budget, most)
    target = F.lit(most) * F.col("n") if level is None else F.least(F.lit(most) * F.col("n"), F.col("w") * F.lit(level))
    return s.select(*KEY, F.col("n").alias("source_size"), target.cast("double").alias("target"), "slope")


def invert_demand(u, s):
    """The time t in 0..1 at which t + s (t*t - t), the integral of the schedule 1 + s (2t - 1), reaches the share u."""
    root = F.sqrt(F.greatest(F.lit(0.0), (1 - s) * (1 - s) + 4 * s * u))
    return F.when(F.abs(s) < 1e-9, u).otherwise((root - (1 - s)) / (2 * s))


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, slopes: Sequence[float] = SLOPES, budget: float = BUDGET, most: float = MOST_REPEATS, carry: str = "doc_id") -> DataFrame:
    """The column `carry`, size, source_size, target, taken and positions (0 to 1, one for each time), a row for each row of docs."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD_RE)), F.lit(0)).cast("long")
    order = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce("text", F.lit("")))))
    sized = docs.select(F.col(carry).alias("carried"), F.col("source").isNull().alias("no_source"), F.coalesce("source", F.lit("")).alias("name"), size.alias("size"), order.alias("k"))
    sized = sized.withColumn("range", F.substring("k", 1, RANGE_DIGITS))
    sums = written(sized.groupBy(*KEY, "range").agg(F.sum("size").alias("words")), "mix-ranges")
    before = Window.partitionBy(*KEY).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*KEY, "range", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("base"))
    starts = starts.join(with_targets(sums, weights, slopes, budget, most), KEY)
    within = Window.partitionBy(*KEY, "range").orderBy("k", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.withColumn("ahead", F.coalesce(F.sum("size").over(within), F.lit(0))).join(starts, [*KEY, "range"])
    start, n, t = F.col("base") + F.col("ahead"), F.col("source_size"), F.col("target")
    words = F.floor(t + 0.5)
    passes = F.when(n > 0, F.floor(words / n)).otherwise(0)  # over the whole source
    rest = F.least(F.greatest(words - passes * n - start, F.lit(0)), F.col("size"))
    times = F.when(F.col("size") > 0, passes + (rest > 0).cast("long")).otherwise(0)
    share = lambda j: F.least((j * n + start) / t, F.lit(1.0))
    at = F.transform(F.sequence(F.lit(0).cast("long"), times - 1), lambda j: F.round(invert_demand(share(j), F.col("slope")), 9))
    positions = F.when(times > 0, at).otherwise(F.array().cast("array<double>"))
    return placed.select(F.col("carried").alias(carry), "size", "source_size", "target", (passes * F.col("size") + rest).cast("long").alias("taken"), positions.alias("positions"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(table(spark, sf_dir, "documents", "doc_id", "source", "text"))
    return out.select("doc_id", "size", "source_size", "target", "taken", F.get("positions", F.lit(0)).alias("position"), F.get("positions", F.lit(1)).alias("position_again")).orderBy("position", "doc_id")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage, the last: the documents the mix takes, range-sorted by their first position, with size, source_size, target, taken,
    position and all positions; where docs has such a column, the new one's name begins with mix_."""
    rows = docs.select(F.struct(*docs.columns).alias("doc"), *(c for c in ("doc_id", "source", "text")))
    got = mix(rows, carry="doc").where("taken > 0").withColumn("position", F.get("positions", F.lit(0)))

    def free(c: str) -> str:
        while c in docs.columns:
            c = f"mix_{c}"
        return c

    got = got.select("doc.*", *(F.col(c).alias(free(c)) for c in ("size", "source_size", "target", "taken", "position", "positions")))
    return got.orderBy(free("position"), "doc_id")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, md5(concat(CAST(doc_id AS VARCHAR), ':', md5(coalesce(text, '')))) AS k FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS n, [3.0, 1.0, 2.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS w,
         [0.5, 0.0, -0.5][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS slope
  FROM d GROUP BY source
), f AS (  -- sources by how soon they are full: the level at which the first not full one stops
  SELECT *, (1.5 * sum(n) OVER () - coalesce(sum(2.0 * n) OVER (ORDER BY 2.0 * n / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(w) OVER (ORDER BY 2.0 * n / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM s
), t AS (
  SELECT source, n AS source_size, slope, CAST(least(2.0 * n, w * (SELECT level FROM f WHERE level * w <= 2.0 * n ORDER BY 2.0 * n / w, source LIMIT 1)) AS DOUBLE) AS target FROM f
), p AS (
  SELECT d.*, source_size, target, slope, CAST(coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY k, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), q AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(floor(target + 0.5) / source_size) ELSE 0 END AS passes FROM p
), r AS (
  SELECT *, least(greatest(floor(target + 0.5) - passes * source_size - start, 0), size) AS rest FROM q
), u AS (
  SELECT *, size > 0 AND passes + CAST(rest > 0 AS INT) > 0 AS once, size > 0 AND passes + CAST(rest > 0 AS INT) > 1 AS twice, least(start / target, 1.0) AS u1, least((source_size + start) / target, 1.0) AS u2 FROM r
)
SELECT doc_id, size, source_size, target, CAST(passes * size + rest AS BIGINT) AS taken,
       CASE WHEN once THEN round(CASE WHEN slope = 0 THEN u1 ELSE (sqrt((1 - slope) * (1 - slope) + 4 * slope * u1) - (1 - slope)) / (2 * slope) END, 9) END AS position,
       CASE WHEN twice THEN round(CASE WHEN slope = 0 THEN u2 ELSE (sqrt((1 - slope) * (1 - slope) + 4 * slope * u2) - (1 - slope)) / (2 * slope) END, 9) END AS position_again
FROM u
"""
