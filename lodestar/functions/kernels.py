"""Analytic kernels as column and DataFrame functions; all of them run in the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: From the median deviation to the standard deviation of a normal distribution; alarm and least length of the CUSUM.
MAD_SCALE = 1.4826
CUSUM_ALARM, CUSUM_LEAST = 4.0, 15


def rnd(c, k: int = 4) -> Column:
    """Half up by floor, in plain double arithmetic."""
    c = F.col(c) if isinstance(c, str) else c
    return F.floor(c.cast("double") * F.lit(float(10**k)) + 0.5) / float(10**k)


def clamp(c, lo: float = 0.0, hi: float = 1.0) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), c))


def safe_div(n, d, default: float = 0.0) -> Column:
    return F.when(d > 0, n / d).otherwise(F.lit(default))


def exact_sum(c) -> Column:
    """Sum over decimals, so that the order of rows cannot show."""
    return F.sum(rnd(c).cast("decimal(20,4)")).cast("double")


def tier(c, cuts: Sequence[tuple[float, str]], other: str) -> Column:
    """The label of the first cut that c reaches (cuts from high to low)."""
    out = None
    for at, label in cuts:
        out = F.when(c >= at, label) if out is None else out.when(c >= at, label)
    return out.otherwise(other)


def cohort_normalize(df: DataFrame, key: str, value: str) -> DataFrame:
    """z, mad_score, pct and confidence of value within its key: z by population deviation, MAD by a second median, pct by cume_dist."""
    w = Window.partitionBy(key)
    s = df.groupBy(key).agg(F.avg(value).alias("_mu"), F.stddev_pop(value).alias("_sd"), F.median(value).alias("_med"), F.count(F.lit(1)).alias("_n"))
    j = df.join(s, key)
    mad = j.groupBy(key).agg(F.median(F.abs(F.col(value) - F.col("_med"))).alias("_mad"))
    j = j.join(mad, key)
    return j.select(
        *df.columns, F.when(F.col("_sd") > 0, (F.col(value) - F.col("_mu")) / F.col("_sd")).otherwise(0.0).alias("z"),
        F.when(F.col("_mad") > 0, (F.col(value) - F.col("_med")) / (MAD_SCALE * F.col("_mad"))).otherwise(0.0).alias("mad_score"), F.cume_dist().over(w.orderBy(value)).alias("pct"),
        F.when(F.col("_n") >= 10, "high").when(F.col("_n") >= 5, "medium").otherwise("low").alias("confidence"),
    )


def shares(df: DataFrame, by: str, key: str) -> DataFrame:
    """by, key, n and its share p of by's rows."""
    c = df.groupBy(by, key).agg(F.count(F.lit(1)).alias("n"))
    return c.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy(by)))


def entropy_hhi(df: DataFrame, by: str, key: str) -> DataFrame:
    return shares(df, by, key).groupBy(by).agg((-F.sum(F.col("p") * F.log2("p"))).alias("entropy"), (F.sum(F.col("n") * F.col("n")) / (F.sum("n") * F.sum("n"))).alias("hhi"))


def js_divergence(p: DataFrame, q: DataFrame, by: str, key: str) -> DataFrame:
    """Jensen-Shannon divergence (bits) and cosine distance of two sparse distributions (by, key, p)."""
    j = p.select(by, key, F.col("p").alias("a")).join(q.select(by, key, F.col("p").alias("b")), [by, key], "full")
    a, b = F.coalesce("a", F.lit(0.0)), F.coalesce("b", F.lit(0.0))
    m = (a + b) / 2
    half = lambda x: F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)
    return j.groupBy(by).agg(
        clamp(F.sum(half(a) + half(b)) / 2).alias("jsd"),
        (1 - F.sum(a * b) / F.nullif(F.sqrt(F.sum(a * a)) * F.sqrt(F.sum(b * b)), F.lit(0.0))).alias("cosine_distance"),
    )


def gini(df: DataFrame, by: str, value: str) -> DataFrame:
    """Lorenz Gini with the n / (n - 1) correction, clamped."""
    w = Window.partitionBy(by).orderBy(value)
    r = df.withColumn("_i", F.row_number().over(w))
    g = r.groupBy(by).agg(F.sum(F.col("_i") * F.col(value)).alias("iv"), F.sum(value).alias("v"), F.count(F.lit(1)).alias("n"))
    n = F.col("n").cast("double")
    raw = F.when((n > 1) & (F.col("v") > 0), (2 * F.col("iv") / (n * F.col("v")) - (n + 1) / n) * n / (n - 1)).otherwise(0.0)
    return g.select(by, clamp(raw).alias("gini"), F.col("n"))


def cadence(df: DataFrame, by: str, ts: str, tie: str) -> DataFrame:
    """Gaps in seconds: mean, deviation, longest, variation and burstiness."""
    gap = F.unix_micros(ts) / 1e6 - F.lag(F.unix_micros(F.col(ts)) / 1e6).over(Window.partitionBy(by).orderBy(ts, tie))
    g = df.select(by, gap.alias("gap")).where("gap is not null").groupBy(by)
    g = g.agg(F.count(F.lit(1)).alias("n_gaps"), F.avg("gap").alias("mean_gap"), F.stddev_pop("gap").alias("sd_gap"), F.max("gap").alias("max_gap"))
    return g.withColumn("cv", safe_div(F.col("sd_gap"), F.col("mean_gap"))).withColumn("burstiness", safe_div(F.col("sd_gap") - F.col("mean_gap"), F.col("sd_gap") + F.col("mean_gap")))


def cusum(values: Column, alarm: float = CUSUM_ALARM, least: int = CUSUM_LEAST) -> Column:
    """Largest two-sided CUSUM of an array about its own mean, in units of the values; struct(score, alarm). Under `least` values: 0."""
    n = F.size(values)
    mean = F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / n
    zero = F.struct(F.lit(0.0).alias("up"), F.lit(0.0).alias("down"), F.lit(0.0).alias("top"))

    def step(a, x):
        z = x - mean
        up, down = F.greatest(F.lit(0.0), a["up"] + z), F.greatest(F.lit(0.0), a["down"] - z)
        return F.struct(up.alias("up"), down.alias("down"), F.greatest(a["top"], up, down).alias("top"))

    score = F.when(n >= least, F.aggregate(values, zero, step, lambda a: a["top"])).otherwise(0.0)
    return F.struct(score.alias("score"), (score >= alarm).alias("alarm"))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two arrays of doubles, 0 for a norm under 1e-12."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm >= 1e-12, dot(a, b) / norm).otherwise(0.0)


def jaccard(a: Column, b: Column) -> Column:
    u = F.size(F.array_union(a, b))
    return F.when(u > 0, F.size(F.array_intersect(a, b)) / u).otherwise(0.0)


def overlap_min(a: Column, b: Column) -> Column:
    m = F.least(F.size(F.array_distinct(a)), F.size(F.array_distinct(b)))
    return F.when(m > 0, F.size(F.array_intersect(a, b)) / m).otherwise(0.0)


def sample_confidence(n) -> Column:
    return 1 - F.exp(-n / 5.0)


def decay(kind, age_days, half_life) -> Column:
    """none, exponential (half-life), linear (to 0 at two half-lives) or step (1, then 0 past the half-life).

    A half-life of 0 or less never decays; kinds of other names are exponential.
    """
    half = F.nullif(half_life, F.lit(0.0))
    return (
        F.when((kind == "none") | (half_life <= 0), 1.0).when(kind == "linear", F.greatest(F.lit(0.0), 1 - age_days / (2 * half)))
        .when(kind == "step", F.when(age_days <= half_life, 1.0).otherwise(0.0)).otherwise(F.pow(F.lit(0.5), age_days / half))
    )


def normalise(kind, v, lo, hi, mid=None) -> Column:
    """binary, bounded (lo..hi), zscore (its size, capped at hi), piecewise (lo to 0, mid to 0.5, hi to 1) or percentile, into 0..1."""
    mid = (lo + hi) / 2 if mid is None else mid
    no_step = lambda d: F.nullif(d, F.lit(0.0))
    below = F.coalesce(0.5 * (v - lo) / no_step(mid - lo), F.lit(0.5))
    above = F.coalesce(0.5 + 0.5 * (v - mid) / no_step(hi - mid), F.lit(1.0))
    piecewise = F.when(v <= lo, 0.0).when(v >= hi, 1.0).when(v <= mid, below).otherwise(above)
    return (
        F.when(kind == "binary", F.when(v > 0, 1.0).otherwise(0.0)).when(kind == "bounded", clamp((v - lo) / no_step(hi - lo)))
        .when(kind == "zscore", clamp(F.when(hi > 0, F.abs(v) / no_step(hi)).otherwise(F.abs(v)))).when(kind == "piecewise", piecewise).otherwise(clamp(v))
    )


def weighted(weights: dict[str, float]) -> Column:
    """Sum of weight times column, columns missing a value count 0."""
    out = F.lit(0.0)
    for c, w in weights.items():
        out = out + F.lit(w) * F.coalesce(F.col(c), F.lit(0.0))
    return out


def edge_confidence(count, most, days) -> Column:
    """0.6 volume (full at 30 % of the largest, 1 at least) + 0.4 recency (7, 30, 90 days)."""
    volume = F.least(F.lit(1.0), count / F.greatest(F.lit(1.0), 0.3 * most))
    return 0.6 * volume + 0.4 * F.when(days <= 7, 1.0).when(days <= 30, 0.7).when(days <= 90, 0.4).otherwise(0.1)
