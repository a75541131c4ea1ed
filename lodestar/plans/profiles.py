"""Profiles: signal definitions, emission, decaying fusion, ranks and deltas, compound signals, events with a life cycle, calibration."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.functions.kernels import clamp, decay, exact_sum, normalise, rnd, safe_div
from lodestar.operators.graph import cut
from lodestar.operators.relational import value_counts_ranked
from lodestar.plans.registry import query
from lodestar.sources import views as V

#: type, domain, weight, decay, half-life in days, normaliser, low, high
SIGNALS = [
    ("activity", "behaviour", 1.0, "exponential", 14.0, "bounded", 0.0, 120.0),
    ("damage", "combat", 0.8, "exponential", 7.0, "bounded", 0.0, 10000.0),
    ("reach", "movement", 0.6, "linear", 10.0, "bounded", 0.0, 10.0),
    ("errors", "conduct", 0.5, "step", 5.0, "binary", 0.0, 1.0),
    ("purchases", "market", 0.4, "none", 1.0, "bounded", 0.0, 40.0),
]
DEF_SQL = "defs(signal_type, domain, weight, dk, half_life, nk, lo, hi) AS (VALUES " + ", ".join(f"('{a}', '{b}', {w}::DOUBLE, '{k}', {h}::DOUBLE, '{n}', {lo}::DOUBLE, {hi}::DOUBLE)" for a, b, w, k, h, n, lo, hi in SIGNALS) + ")"


def definitions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SIGNALS, "signal_type string, domain string, weight double, dk string, half_life double, nk string, lo double, hi double")


def emit(spark: SparkSession, d: str) -> DataFrame:
    """Signals in long form: character_id, signal_type, value, at, n."""
    e = lambda k: F.sum((F.col("side_key") == k).cast("double"))
    g = V.event_stream(spark, d).groupBy("character_id").agg(
        F.count(F.lit(1)).cast("double").alias("activity"), exact_sum(F.col("damage")).alias("damage"), F.countDistinct("ship_type_id").cast("double").alias("reach"), e("error").alias("errors"), e("purchase").alias("purchases"),
        F.max("ts").alias("at"), F.count(F.lit(1)).alias("n"),
    )
    return g.unpivot(["character_id", "at", "n"], ["activity", "damage", "reach", "errors", "purchases"], "signal_type", "value")


EMIT = V.ctes("es") + ", " + DEF_SQL + """, g AS (SELECT character_id, CAST(count(*) AS DOUBLE) AS activity, CAST(sum(CAST(damage AS DECIMAL(20,4))) AS DOUBLE) AS damage, CAST(count(DISTINCT ship_type_id) AS DOUBLE) AS reach,
CAST(count(CASE WHEN side_key = 'error' THEN 1 END) AS DOUBLE) AS errors, CAST(count(CASE WHEN side_key = 'purchase' THEN 1 END) AS DOUBLE) AS purchases, max(ts) AS att, count(*) AS n FROM es GROUP BY 1),
s AS (SELECT character_id, att, n, signal_type, value FROM g UNPIVOT (value FOR signal_type IN (activity, damage, reach, errors, purchases))), t AS (SELECT max(ts) AS m FROM es)"""


@query("signal_emitter", EMIT + " SELECT character_id, signal_type, round(value, 4) AS value, n FROM s")
def signal_emitter(spark: SparkSession, d: str) -> DataFrame:
    return emit(spark, d).select("character_id", "signal_type", rnd("value").alias("value"), "n")


FUSE = EMIT + """, w AS (SELECT s.*, domain, weight, CASE dk WHEN 'exponential' THEN pow(0.5, age / half_life) WHEN 'linear' THEN greatest(0, 1 - age / (2 * half_life)) WHEN 'step' THEN CASE WHEN age <= half_life THEN 1 ELSE 0 END ELSE 1 END AS dec,
CASE nk WHEN 'binary' THEN CASE WHEN value > 0 THEN 1.0 ELSE 0.0 END ELSE greatest(0, least(1, (value - lo) / (hi - lo))) END AS norm, 1 - exp(-n / 5.0) AS conf FROM (SELECT s.*, (epoch_us(m) - epoch_us(att)) / 86400000000.0 AS age FROM s, t) s JOIN defs USING (signal_type)),
f AS (SELECT character_id, greatest(0, least(1, sum(norm * dec * conf * weight) / sum(weight))) AS risk, sum(conf * weight) / sum(weight) AS confidence, sum(dec * weight) / sum(weight) AS freshness, count(DISTINCT domain) / 5.0 AS coverage, sum(weight) / 3.3 AS effective, max(att) AS att FROM w WHERE dec >= 0.01 GROUP BY 1)"""


def fuse(signals: DataFrame, defs: DataFrame, as_of: DataFrame) -> DataFrame:
    """Risk as the weighted mean of normalised, decayed, confident signals; signals decayed under .01 are left out."""
    age = (F.unix_micros("as_of") - F.unix_micros("at")) / 86_400_000_000.0
    w = signals.join(F.broadcast(defs), "signal_type").crossJoin(F.broadcast(as_of))
    w = w.withColumn("dec", decay(F.col("dk"), age, F.col("half_life"))).withColumn("norm", normalise(F.col("nk"), F.col("value"), F.col("lo"), F.col("hi"))).withColumn("conf", 1 - F.exp(-F.col("n") / 5.0))
    k = F.col("weight")
    all_w, n_domains = sum(s[2] for s in SIGNALS), len({s[1] for s in SIGNALS})
    return w.where("dec >= 0.01").groupBy("character_id").agg(
        clamp(F.sum(F.col("norm") * F.col("dec") * F.col("conf") * k) / F.sum(k)).alias("risk"), (F.sum(F.col("conf") * k) / F.sum(k)).alias("confidence"), (F.sum(F.col("dec") * k) / F.sum(k)).alias("freshness"),
        (F.countDistinct("domain") / float(n_domains)).alias("coverage"), (F.sum(k) / all_w).alias("effective"), F.max("at").alias("at"),
    )


def fused(spark: SparkSession, d: str) -> DataFrame:
    return fuse(emit(spark, d), definitions(spark), V.event_stream(spark, d).agg(F.max("ts").alias("as_of")))


@query("signal_fusion", FUSE + " SELECT character_id, round(risk, 6) AS risk, round(confidence, 6) AS confidence, round(freshness, 6) AS freshness, round(coverage, 6) AS coverage, round(effective, 6) AS effective FROM f")
def signal_fusion(spark: SparkSession, d: str) -> DataFrame:
    return fused(spark, d).select("character_id", *[rnd(c, 6).alias(c) for c in ("risk", "confidence", "freshness", "coverage", "effective")])


@query("signal_contributions", FUSE + """, c AS (SELECT character_id, signal_type, round(norm * dec * conf * weight, 6) AS part FROM w WHERE dec >= 0.01)
SELECT character_id, string_agg(signal_type, ',' ORDER BY part DESC, signal_type) AS top_signals FROM (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY character_id ORDER BY part DESC, signal_type) <= 3) GROUP BY 1""")  # fmt: skip
def signal_contributions(spark: SparkSession, d: str) -> DataFrame:
    """The three largest contributions of each character, as a list in order."""
    as_of = V.event_stream(spark, d).agg(F.max("ts").alias("as_of"))
    age = (F.unix_micros("as_of") - F.unix_micros("at")) / 86_400_000_000.0
    w = emit(spark, d).join(F.broadcast(definitions(spark)), "signal_type").crossJoin(F.broadcast(as_of)).withColumn("dec", decay(F.col("dk"), age, F.col("half_life"))).where("dec >= 0.01")
    part = rnd(normalise(F.col("nk"), F.col("value"), F.col("lo"), F.col("hi")) * F.col("dec") * (1 - F.exp(-F.col("n") / 5.0)) * F.col("weight"), 6)
    top = F.slice(F.array_sort(F.collect_list(F.struct((-part).alias("p"), "signal_type"))), 1, 3)
    return w.groupBy("character_id").agg(F.array_join(F.transform(top, lambda s: s["signal_type"]), ",").alias("top_signals"))


@query("risk_ranks", FUSE + """, r AS (SELECT character_id, round(risk, 6) AS risk FROM f) SELECT character_id, risk, CAST(rank() OVER (ORDER BY risk DESC) AS INTEGER) AS rank, round(percent_rank() OVER (ORDER BY risk), 6) AS percentile FROM r""")
def risk_ranks(spark: SparkSession, d: str) -> DataFrame:
    """Rank and percent rank, from counts of values in ranges."""
    r = cut(fused(spark, d).select("character_id", rnd("risk", 6).alias("risk")))
    c = value_counts_ranked(r, "risk")
    rank, pct = (F.col("total") - F.col("upto") + 1).cast("int"), safe_div(F.col("below"), F.col("total") - 1)
    return r.join(c, "risk").select("character_id", "risk", rank.alias("rank"), rnd(pct, 6).alias("percentile"))


@query("score_deltas", V.ctes("es") + """, s AS (SELECT character_id, CAST(ts AS DATE) AS day, count(*) AS n FROM es GROUP BY 1, 2)
SELECT a.character_id, CAST(a.day AS VARCHAR) AS day, a.n, a.n - b.n AS delta_1d, a.n - c.n AS delta_7d FROM s a LEFT JOIN s b ON a.character_id = b.character_id AND b.day = a.day - 1 LEFT JOIN s c ON a.character_id = c.character_id AND c.day = a.day - 7""")  # fmt: skip
def score_deltas(spark: SparkSession, d: str) -> DataFrame:
    """Change against the snapshots of one and seven days before."""
    s = V.event_stream(spark, d).groupBy("character_id", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    before = lambda k: s.select("character_id", F.date_add("day", k).alias("day"), F.col("n").alias(f"n{k}"))
    j = s.join(before(1), ["character_id", "day"], "left").join(before(7), ["character_id", "day"], "left")
    return j.select("character_id", F.col("day").cast("string").alias("day"), "n", (F.col("n") - F.col("n1")).alias("delta_1d"), (F.col("n") - F.col("n7")).alias("delta_7d"))


@query("percentile_thresholds", FUSE + """, r AS (SELECT round(risk, 6) AS v, row_number() OVER (ORDER BY round(risk, 6), character_id) AS i, count(*) OVER () AS n FROM f)
SELECT max(CASE WHEN i = floor(n * 0.10) + 1 THEN v END) AS p10, max(CASE WHEN i = floor(n * 0.50) + 1 THEN v END) AS p50, max(CASE WHEN i = floor(n * 0.90) + 1 THEN v END) AS p90, max(n) AS n FROM r""")  # fmt: skip
def percentile_thresholds(spark: SparkSession, d: str) -> DataFrame:
    """Exact discrete percentiles (the value at floor(n p), from 0) for calibration."""
    c = value_counts_ranked(cut(fused(spark, d).select(rnd("risk", 6).alias("v"))), "v")
    at = lambda p: F.min(F.when(F.col("upto") > F.floor(F.col("total") * p), F.col("v")))
    return c.agg(at(0.10).alias("p10"), at(0.50).alias("p50"), at(0.90).alias("p90"), F.max("total").alias("n"))


#: compound, required signals, least normalised value, scoring
COMPOUNDS = [("busy_trader", ("activity", "purchases"), 0.3, "mean"), ("roaming_fighter", ("damage", "reach"), 0.4, "min"), ("erratic", ("errors", "activity", "reach"), 0.5, "min")]
REQ_SQL = "req(compound, signal_type, least, mode, needed) AS (VALUES " + ", ".join(f"('{c}', '{s}', {m}::DOUBLE, '{k}', {len(r)})" for c, r, m, k in COMPOUNDS for s in r) + ")"


@query("compound_signals", FUSE + ", " + REQ_SQL + """ SELECT character_id, compound, count(*) AS matched, round(CASE WHEN min(mode) = 'min' THEN min(round(norm, 6)) ELSE avg(round(norm, 6)) END, 6) AS score FROM w JOIN req USING (signal_type) WHERE norm >= least GROUP BY 1, 2 HAVING count(*) = min(needed)""")
def compound_signals(spark: SparkSession, d: str) -> DataFrame:
    """Compounds whose required signals are all there: requirements joined to signals, and matches counted."""
    req = spark.createDataFrame([(c, s, m, k, len(r)) for c, r, m, k in COMPOUNDS for s in r], "compound string, signal_type string, least double, mode string, needed int")
    w = emit(spark, d).join(F.broadcast(definitions(spark)), "signal_type").withColumn("norm", normalise(F.col("nk"), F.col("value"), F.col("lo"), F.col("hi")))
    v = rnd("norm", 6)
    g = w.join(F.broadcast(req), "signal_type").where("norm >= least").groupBy("character_id", "compound").agg(F.count(F.lit(1)).alias("matched"), F.min("needed").alias("needed"), F.min("mode").alias("mode"), F.min(v).alias("lo_"), F.avg(v).alias("mean_"))
    return g.where("matched = needed").select("character_id", "compound", "matched", rnd(F.when(F.col("mode") == "min", F.col("lo_")).otherwise(F.col("mean_")), 6).alias("score"))


def lifecycle(prev: DataFrame, cand: DataFrame, as_of: DataFrame, expire_days: int = 7, escalate: float = 0.2) -> DataFrame:
    """States of events after a round: a full join of the states before (key, state, severity, last_at) with candidates (key, severity, at).

    New candidates become active; known ones are refreshed, escalate if severity rose by `escalate`, and wake if they were resolved;
    suppressed ones stay so. Events without a candidate are resolved, and expire once resolved for `expire_days`.
    """
    j = prev.withColumnsRenamed({"severity": "old", "state": "was"}).join(cand, "key", "full").crossJoin(F.broadcast(as_of))
    days = F.datediff("as_of", "last_at")
    seen = F.col("at").isNotNull()
    state = (
        F.when(seen & (F.col("was") == "suppressed"), "suppressed").when(seen & F.col("was").isNull(), "active").when(seen & (F.col("severity") >= F.col("old") + escalate), "escalated").when(seen, "active")
        .when(F.col("was") == "suppressed", "suppressed").when(F.col("was").isin("resolved", "expired") & (days >= expire_days), "expired").otherwise("resolved")
    )
    return j.select("key", state.alias("state"), F.coalesce("severity", "old").alias("severity"), F.coalesce("at", "last_at").alias("last_at"))


@query("event_lifecycle", V.ctes("es") + """, t AS (SELECT max(CAST(ts AS DATE)) AS m FROM es), c AS (SELECT character_id AS key, CAST(ts AS DATE) AS day, count(*) AS n FROM es GROUP BY 1, 2),
p AS (SELECT key, CASE WHEN key % 11 = 0 THEN 'suppressed' WHEN max(day) < (SELECT m FROM t) - 3 THEN 'resolved' ELSE 'active' END AS was, max(n) / 10.0 AS old, max(day) AS last_at FROM c, t WHERE day < m - 1 AND n >= 4 GROUP BY 1),
k AS (SELECT key, max(n) / 10.0 AS severity, max(day) AS att FROM c, t WHERE day >= m - 1 AND n >= 4 GROUP BY 1), j AS (SELECT coalesce(p.key, k.key) AS key, was, old, last_at, severity, att FROM p FULL JOIN k ON p.key = k.key)
SELECT key, CASE WHEN att IS NOT NULL AND was = 'suppressed' THEN 'suppressed' WHEN att IS NOT NULL AND was IS NULL THEN 'active' WHEN att IS NOT NULL AND severity >= old + 0.2 THEN 'escalated' WHEN att IS NOT NULL THEN 'active' WHEN was = 'suppressed' THEN 'suppressed'
  WHEN was IN ('resolved', 'expired') AND date_diff('day', last_at, m) >= 7 THEN 'expired' ELSE 'resolved' END AS state, round(coalesce(severity, old), 4) AS severity, CAST(coalesce(att, last_at) AS VARCHAR) AS last_at FROM j, t""")  # fmt: skip
def event_lifecycle(spark: SparkSession, d: str) -> DataFrame:
    es = V.event_stream(spark, d)
    t = es.agg(F.max(F.to_date("ts")).alias("as_of"))
    c = es.groupBy(F.col("character_id").alias("key"), F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n")).where("n >= 4").crossJoin(F.broadcast(t))
    new = F.col("day") >= F.date_sub("as_of", 1)
    prev = c.where(~new).groupBy("key", "as_of").agg((F.max("n") / 10.0).alias("severity"), F.max("day").alias("last_at"))
    prev = prev.select("key", F.when(F.col("key") % 11 == 0, "suppressed").when(F.col("last_at") < F.date_sub("as_of", 3), "resolved").otherwise("active").alias("state"), "severity", "last_at")
    cand = c.where(new).groupBy("key").agg((F.max("n") / 10.0).alias("severity"), F.max("day").alias("at"))
    return lifecycle(prev, cand, t).withColumn("severity", rnd("severity")).withColumn("last_at", F.col("last_at").cast("string"))


@query("rank_runs", V.ctes("es") + """, s AS (SELECT character_id, CAST(ts AS DATE) AS day, count(*) AS n FROM es GROUP BY 1, 2), u AS (SELECT *, n > lag(n) OVER (PARTITION BY character_id ORDER BY day) AS up FROM s),
i AS (SELECT *, sum(CASE WHEN up THEN 0 ELSE 1 END) OVER (PARTITION BY character_id ORDER BY day ROWS UNBOUNDED PRECEDING) AS g FROM u) SELECT character_id, CAST(max(c) AS BIGINT) AS longest_run FROM (SELECT character_id, g, count(CASE WHEN up THEN 1 END) AS c FROM i GROUP BY 1, 2) GROUP BY 1""")  # fmt: skip
def rank_runs(spark: SparkSession, d: str) -> DataFrame:
    """Most consecutive rises."""
    s = V.event_stream(spark, d).groupBy("character_id", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("character_id").orderBy("day")
    u = s.withColumn("up", F.coalesce(F.col("n") > F.lag("n").over(w), F.lit(False)))
    i = u.withColumn("g", F.sum((~F.col("up")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return i.groupBy("character_id", "g").agg(F.sum(F.col("up").cast("bigint")).alias("c")).groupBy("character_id").agg(F.max("c").alias("longest_run"))
