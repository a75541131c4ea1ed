"""Further inquiries: series statistics, expanded engagements, calendar parts, motifs, entry points, doctrines, presence patterns, alerts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.functions.kernels import exact_sum, rnd, safe_div
from lodestar.operators import block_pairs as B
from lodestar.operators.relational import pairs, top_k
from lodestar.plans.registry import query
from lodestar.sources import views as V


@query("series_statistics", V.ctes("mo") + """, t AS (SELECT max(observed_at) AS m FROM mo) SELECT type_id, count(*) AS n, round(CAST(sum(CAST(price AS DECIMAL(20,4))) AS DOUBLE) / count(*), 2) AS mean, round(coalesce(stddev_samp(price), 0), 2) AS sd, CAST(sum(volume_remain) AS BIGINT) AS volume FROM mo, t WHERE observed_at >= m - INTERVAL 1 YEAR AND source_type = 'market_hub' GROUP BY 1""")
def series_statistics(spark: SparkSession, d: str) -> DataFrame:
    """Range, filter, group, then mean, sample deviation and sum, as a time-series store would give them."""
    mo = V.market_orders(spark, d).where("source_type = 'market_hub'")
    t = F.broadcast(V.read(spark, d, "lineitem").agg(F.max("l_shipdate").alias("m")))
    g = mo.join(t, F.col("observed_at") >= F.add_months("m", -12)).groupBy("type_id")
    return g.agg(F.count(F.lit(1)).alias("n"), rnd(exact_sum(F.col("price")) / F.count(F.lit(1)), 2).alias("mean"), rnd(F.coalesce(F.stddev_samp("price"), F.lit(0.0)), 2).alias("sd"), F.sum("volume_remain").alias("volume"))


@query("calendar_parts", """SELECT o_orderkey, strftime(o_orderdate, '%Y-W%U') AS week, strftime(o_orderdate, '%Y-%m') AS month, CAST(dayofweek(o_orderdate) + 1 AS INTEGER) AS weekday, CAST(hour(o_orderdate) AS INTEGER) AS hour, CAST(epoch(date_trunc('hour', o_orderdate)) // 900 * 900 AS BIGINT) AS quarter,
date_diff('day', CAST(o_orderdate AS DATE), DATE '2001-12-31') AS age_days FROM orders""")  # fmt: skip
def calendar_parts(spark: SparkSession, d: str) -> DataFrame:
    """Weeks count from the first Sunday, weekdays from 1 on Sunday, quarter hours from the epoch."""
    t = F.col("o_orderdate")
    week = F.floor((F.dayofyear(t) + 7 - F.dayofweek(t)) / 7)
    return V.read(spark, d, "orders").select(
        "o_orderkey", F.concat(F.date_format(t, "yyyy"), F.lit("-W"), F.lpad(week.cast("string"), 2, "0")).alias("week"), F.date_format(t, "yyyy-MM").alias("month"), F.dayofweek(t).alias("weekday"), F.hour(t).alias("hour"),
        (F.floor(F.unix_seconds(t) / 900) * 900).alias("quarter"), F.datediff(F.lit("2001-12-31").cast("date"), t).cast("bigint").alias("age_days"),
    )


@query("expanded_engagements", V.ctes("es") + """, w AS (SELECT system_id, CAST(ts AS DATE) AS day, min(epoch_us(ts)) AS s, max(epoch_us(ts)) AS e FROM es WHERE side_key = 'purchase' GROUP BY 1, 2),
p AS (SELECT DISTINCT system_id, CAST(ts AS DATE) AS day, character_id FROM es WHERE side_key = 'purchase')
SELECT w.system_id, CAST(w.day AS VARCHAR) AS day, count(*) AS n, count(DISTINCT es.character_id) AS characters FROM w JOIN es ON es.system_id = w.system_id AND epoch_us(es.ts) BETWEEN s - 3600000000 AND e + 3600000000 JOIN p ON p.system_id = w.system_id AND p.day = w.day AND p.character_id = es.character_id GROUP BY w.system_id, w.day""")  # fmt: skip
def expanded_engagements(spark: SparkSession, d: str, margin_seconds: int = 3600) -> DataFrame:
    """Events within an engagement's time and a margin that share a participant with it: day-bucketed range join, then the guard."""
    es = V.event_stream(spark, d)
    core = es.where("side_key = 'purchase'").withColumn("day", F.to_date("ts"))
    us = F.unix_micros("ts")
    w = core.groupBy("system_id", "day").agg((F.min(us) - margin_seconds * 1_000_000).alias("s"), (F.max(us) + margin_seconds * 1_000_000).alias("e"))
    day = lambda c: F.floor(c / 86_400_000_000)
    w = w.withColumn("_b", F.explode(F.sequence(day(F.col("s")), day(F.col("e")))))
    j = es.withColumn("_b", day(us)).join(w, ["system_id", "_b"]).where((us >= F.col("s")) & (us <= F.col("e")))
    j = j.join(core.select("system_id", "day", "character_id").distinct(), ["system_id", "day", "character_id"], "left_semi")
    return j.groupBy("system_id", F.col("day").cast("string").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("character_id").alias("characters"))


DAYS = V.ctes("es") + ", c AS (SELECT DISTINCT system_id, CAST(ts AS DATE) AS day, character_id FROM es), p AS (SELECT x.system_id, x.character_id AS a, y.character_id AS b, x.day FROM c x JOIN c y ON x.system_id = y.system_id AND x.day = y.day AND x.character_id < y.character_id)"


def meetings(spark: SparkSession, d: str) -> DataFrame:
    return pairs(V.event_stream(spark, d).select("system_id", F.to_date("ts").alias("day"), "character_id"), ["system_id", "day"], "character_id")


@query("fleet_cores", DAYS + """, n AS (SELECT a, b, count(*) AS together FROM p GROUP BY 1, 2 HAVING count(*) >= 28) SELECT x.a, x.b, y.b AS c, least(x.together, y.together, z.together) AS together FROM n x JOIN n y ON x.b = y.a JOIN n z ON z.a = x.a AND z.b = y.b""")
def fleet_cores(spark: SparkSession, d: str, least: int = 28) -> DataFrame:
    """Triples each two of which met often. Who has fewer days than that meets no one as often; the others' days are rows of matrices, and a task
    makes all triples of the first characters that it has."""
    c = V.event_stream(spark, d).select("character_id", F.col("system_id").alias("s"), F.to_date("ts").alias("day")).where("s is not null and day is not null").distinct()
    c = c.groupBy("character_id").agg(F.collect_list(B.code(F.col("s"), F.unix_date("day"))).alias("codes"), F.collect_set(F.col("s").cast("long")).alias("spaces")).where(F.size("codes") >= least)

    def run(x, y, one):
        every = x if one else pa.concat_tables([x, y])
        ids = B.numbers(every, "character_id")
        order = np.argsort(ids)
        rows, ids, firsts = B.Rows.of(every.take(pa.array(order)), "codes"), ids[order], B.numbers(x, "character_id")
        met = B.Together(rows)
        for i in np.searchsorted(ids, firsts).tolist():
            with_i = met.counts(np.array([i]), np.arange(i + 1, len(ids)))[0]
            often = np.flatnonzero(with_i >= least)
            at, t = often + i + 1, with_i[often]
            step = max(1, (1 << 22) // max(len(at), 1))
            for k in range(0, len(at), step):
                b, c = at[k : k + step], at[k:]
                n = met.counts(b, c)
                ok = (n >= least) & (b[:, None] < c[None, :])
                np.minimum(n, t[k : k + step, None], out=n)
                np.minimum(n, t[None, k:], out=n)
                yield from B.runs({"a": np.full(len(b), ids[i]), "b": ids[b]}, ok, {"c": ids[c], "together": lambda r, q, n=n: n[r, q].astype(np.int32)}, ("a", "b", "c", "together"))

    j = B.unrolled(B.around_blocks(c, "character_id", run, "a long, b long, c array<long>, together array<int>").withColumnRenamed("c", "cs"), "cs", "c", "together")
    return j.select("a", "b", "c", F.col("together").cast("long").alias("together"))


@query("rotating_scouts", V.ctes("es") + """, c AS (SELECT system_id % 3 AS area, CAST(ts AS DATE) AS day, first(character_id ORDER BY ts, event_id) AS scout FROM es GROUP BY 1, 2), l AS (SELECT *, lag(scout) OVER (PARTITION BY area ORDER BY day) AS before FROM c)
SELECT area, count(*) AS days, count(DISTINCT scout) AS scouts, count(CASE WHEN scout <> before THEN 1 END) AS changes FROM l GROUP BY 1""")  # fmt: skip
def rotating_scouts(spark: SparkSession, d: str) -> DataFrame:
    """Who comes first each day, and how often that changes."""
    c = V.event_stream(spark, d).groupBy((F.col("system_id") % 3).alias("area"), F.to_date("ts").alias("day")).agg(F.min_by("character_id", F.struct("ts", "event_id")).alias("scout"))
    c = c.withColumn("before", F.lag("scout").over(Window.partitionBy("area").orderBy("day")))
    return c.groupBy("area").agg(F.count(F.lit(1)).alias("days"), F.countDistinct("scout").alias("scouts"), F.count(F.when(F.col("scout") != F.col("before"), 1)).alias("changes"))


@query("entry_points", V.ctes("es") + """, t AS (SELECT max(ts) AS m FROM es), r AS (SELECT es.* FROM es, t WHERE ts >= m - INTERVAL 7 DAY), u AS (SELECT 'system' AS kind, CAST(system_id AS BIGINT) AS id, count(*) AS heat FROM r GROUP BY 2
UNION ALL SELECT 'pilot', character_id, count(*) FROM r GROUP BY 2 UNION ALL SELECT 'ship', CAST(ship_type_id AS BIGINT), count(*) FROM r GROUP BY 2) SELECT kind, id, heat, CAST(row_number() OVER (PARTITION BY kind ORDER BY heat DESC, id) AS INTEGER) AS place FROM u QUALIFY place <= 10""")  # fmt: skip
def entry_points(spark: SparkSession, d: str, k: int = 10) -> DataFrame:
    """The hottest systems, pilots and ships of the last week: one pass with an unpivot."""
    es = V.event_stream(spark, d)
    t = F.broadcast(es.agg(F.max("ts").alias("m")))
    r = es.join(t, F.col("ts") >= F.col("m") - F.expr("INTERVAL 7 DAYS")).select(F.col("system_id").cast("bigint").alias("system"), F.col("character_id").alias("pilot"), F.col("ship_type_id").cast("bigint").alias("ship"))
    heat = r.unpivot([], ["system", "pilot", "ship"], "kind", "id").groupBy("kind", "id").agg(F.count(F.lit(1)).alias("heat"))
    return top_k(heat, ["kind"], [F.desc("heat"), "id"], k, "place")


@query("auto_doctrines", V.ctes("km") + """, t AS (SELECT max(killmail_time) AS m FROM km), f AS (SELECT sequence_id, min(l_partkey) % 50 AS hull, sha256(string_agg(DISTINCT CAST(l_partkey % 8 AS VARCHAR), ',' ORDER BY CAST(l_partkey % 8 AS VARCHAR))) AS fingerprint FROM km JOIN lineitem ON l_orderkey = sequence_id, t WHERE killmail_time >= m - INTERVAL 1 YEAR GROUP BY 1),
g AS (SELECT hull, fingerprint, count(*) AS losses FROM f GROUP BY 1, 2 HAVING count(*) >= 3) SELECT hull, fingerprint, losses, CAST(ceil(losses / 365.0 * 14) AS BIGINT) AS target, round(1 - exp(-losses / 5.0), 6) AS confidence FROM g""")  # fmt: skip
def auto_doctrines(spark: SparkSession, d: str, days: int = 365, runway: int = 14, least: int = 3) -> DataFrame:
    """Fits lost again and again, with the number to keep for the runway."""
    km = V.killmails(spark, d).select("sequence_id", "killmail_time")
    t = F.broadcast(km.agg(F.max("killmail_time").alias("m")))
    recent = km.join(t, F.col("killmail_time") >= F.add_months("m", -12)).select("sequence_id")
    li = V.read(spark, d, "lineitem").select(F.col("l_orderkey").alias("sequence_id"), "l_partkey")
    f = recent.join(li, "sequence_id").groupBy("sequence_id").agg((F.min("l_partkey") % 50).alias("hull"), F.sha2(F.array_join(F.array_sort(F.collect_set((F.col("l_partkey") % 8).cast("string"))), ","), 256).alias("fingerprint"))
    g = f.groupBy("hull", "fingerprint").agg(F.count(F.lit(1)).alias("losses")).where(F.col("losses") >= least)
    return g.select("hull", "fingerprint", "losses", F.ceil(F.col("losses") / float(days) * runway).alias("target"), rnd(1 - F.exp(-F.col("losses") / 5.0), 6).alias("confidence"))


@query("presence_patterns", V.ctes("es") + """, b AS (SELECT system_id, CAST(ts AS DATE) AS day, character_id, count(*) AS n, CAST(sum(CAST(damage AS DECIMAL(20,4))) AS DOUBLE) AS dmg, count(CASE WHEN side_key = 'error' THEN 1 END) AS losses FROM es GROUP BY 1, 2, 3),
t AS (SELECT system_id, day, count(DISTINCT character_id) AS pilots, CAST(sum(CAST(dmg AS DECIMAL(20,4))) AS DOUBLE) / sum(n) AS mean_dmg FROM b GROUP BY 1, 2)
SELECT character_id, count(*) AS battles, round(count(CASE WHEN dmg / n < 0.5 * mean_dmg THEN 1 END) / count(*), 6) AS low_output, round(count(CASE WHEN n = 1 THEN 1 END) / count(*), 6) AS token, round(count(CASE WHEN losses > 0 THEN 1 END) / count(*), 6) AS loss_rate FROM b JOIN t USING (system_id, day) GROUP BY 1 HAVING count(*) >= 5""")  # fmt: skip
def presence_patterns(spark: SparkSession, d: str) -> DataFrame:
    """High presence with low output, token participation and losses, per character."""
    b = V.event_stream(spark, d).groupBy("system_id", F.to_date("ts").alias("day"), "character_id").agg(F.count(F.lit(1)).alias("n"), exact_sum(F.col("damage")).alias("dmg"), F.count(F.when(F.col("side_key") == "error", 1)).alias("losses"))
    t = b.groupBy("system_id", "day").agg((exact_sum(F.col("dmg")) / F.sum("n")).alias("mean_dmg"))
    n, share = F.count(F.lit(1)), lambda c: rnd(F.count(F.when(c, 1)) / F.count(F.lit(1)), 6)
    g = b.join(t, ["system_id", "day"]).groupBy("character_id").agg(n.alias("battles"), share(F.col("dmg") / F.col("n") < 0.5 * F.col("mean_dmg")).alias("low_output"), share(F.col("n") == 1).alias("token"), share(F.col("losses") > 0).alias("loss_rate"))
    return g.where("battles >= 5")


@query("repeat_targeting", V.ctes("km", "ka") + """, k AS (SELECT DISTINCT sequence_id, character_id FROM ka), v AS (SELECT k.character_id, victim_alliance_id, count(*) AS kills FROM k JOIN km USING (sequence_id) GROUP BY 1, 2), s AS (SELECT *, sum(kills) OVER (PARTITION BY character_id) AS total FROM v)
SELECT character_id, victim_alliance_id, kills, round(kills / total, 6) AS share FROM s WHERE kills >= 5 AND kills / total >= 0.06""")  # fmt: skip
def repeat_targeting(spark: SparkSession, d: str) -> DataFrame:
    """Alliances that a pilot attacks more often than its mix would have it."""
    k = V.attackers(spark, d).select("sequence_id", "character_id").distinct()
    v = k.join(V.killmails(spark, d).select("sequence_id", "victim_alliance_id"), "sequence_id").groupBy("character_id", "victim_alliance_id").agg(F.count(F.lit(1)).alias("kills"))
    s = v.withColumn("total", F.sum("kills").over(Window.partitionBy("character_id")))
    return s.where("kills >= 5 and kills / total >= 0.06").select("character_id", "victim_alliance_id", "kills", rnd(F.col("kills") / F.col("total"), 6).alias("share"))


@query("former_allies_attacking", V.ctes("mh", "km", "ka") + """, p AS (SELECT character_id, org, min(start_at) AS since FROM mh GROUP BY 1, 2), a AS (SELECT DISTINCT sequence_id, character_id - 1 AS attacker FROM ka),
h AS (SELECT DISTINCT sequence_id, a.attacker, km.victim_character_id FROM a JOIN km USING (sequence_id) JOIN p x ON x.character_id = a.attacker AND x.since <= killmail_time
JOIN p y ON y.character_id = km.victim_character_id AND y.org = x.org AND y.since <= killmail_time)
SELECT attacker, count(*) AS attacks, count(DISTINCT victim_character_id) AS victims FROM h GROUP BY 1""")  # fmt: skip
def former_allies_attacking(spark: SparkSession, d: str) -> DataFrame:
    """Attacks on those with whom the attacker has shared an organisation before."""
    p = V.membership(spark, d).groupBy("character_id", "org").agg(F.min("start_at").alias("since"))
    a = V.attackers(spark, d).select("sequence_id", (F.col("character_id") - 1).alias("attacker")).distinct()
    j = a.join(V.killmails(spark, d).select("sequence_id", "killmail_time", "victim_character_id"), "sequence_id")
    j = j.join(p.select(F.col("character_id").alias("attacker"), "org", F.col("since").alias("sa")), "attacker").join(p.select(F.col("character_id").alias("victim_character_id"), "org", F.col("since").alias("sv")), ["victim_character_id", "org"])
    # an attack counts once, however many organisations the two have shared
    return j.where("sa <= killmail_time and sv <= killmail_time").select("sequence_id", "attacker", "victim_character_id").distinct().groupBy("attacker").agg(F.count(F.lit(1)).alias("attacks"), F.countDistinct("victim_character_id").alias("victims"))


@query("system_alerts", V.ctes("km") + """, t AS (SELECT max(killmail_time) AS m FROM km), s AS (SELECT system_id, count(CASE WHEN killmail_time >= m - INTERVAL 7 DAY THEN 1 END) AS w, count(CASE WHEN killmail_time >= m - INTERVAL 30 DAY THEN 1 END) AS mth FROM km, t GROUP BY 1)
SELECT system_id, 'surge' AS alert, w AS value FROM s WHERE mth > 0 AND w / mth > 0.35 UNION ALL SELECT system_id, 'quiet', mth FROM s WHERE w = 0""")  # fmt: skip
def system_alerts(spark: SparkSession, d: str) -> DataFrame:
    """Alerts as rows of a stack: one scan, several predicates."""
    km = V.killmails(spark, d)
    t = F.broadcast(km.agg(F.max("killmail_time").alias("m")))
    last = lambda n: F.col("killmail_time") >= F.col("m") - F.expr(f"INTERVAL {n} DAYS")
    s = km.crossJoin(t).groupBy("system_id").agg(F.count(F.when(last(7), 1)).alias("w"), F.count(F.when(last(30), 1)).alias("mth"))
    alert = lambda name, cond, v: F.when(cond, F.struct(F.lit(name).alias("alert"), v.alias("value")))
    rows = F.array_compact(F.array(alert("surge", (F.col("mth") > 0) & (safe_div(F.col("w"), F.col("mth")) > 0.35), F.col("w")), alert("quiet", F.col("w") == 0, F.col("mth"))))
    return s.select("system_id", F.explode(rows).alias("r")).select("system_id", "r.alert", "r.value")


@query("evidence_rubric", V.ctes("es") + """, g AS (SELECT character_id, count(*) AS n, count(DISTINCT CAST(ts AS DATE)) AS days, count(DISTINCT system_id) AS systems, count(DISTINCT ship_type_id) AS ships FROM es GROUP BY 1)
SELECT character_id, round(least(1 - exp(-n / 5.0), least(1.0, days / 28.0), least(1.0, ships / 60.0), CASE WHEN systems >= 1 THEN 1.0 ELSE 0.0 END), 6) AS confidence FROM g""")  # fmt: skip
def evidence_rubric(spark: SparkSession, d: str) -> DataFrame:
    """Confidence as the weakest of four sub-scores."""
    g = V.event_stream(spark, d).groupBy("character_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct(F.to_date("ts")).alias("days"), F.countDistinct("system_id").alias("systems"), F.countDistinct("ship_type_id").alias("ships"))
    one = F.lit(1.0)
    return g.select("character_id", rnd(F.least(1 - F.exp(-F.col("n") / 5.0), F.least(one, F.col("days") / 28.0), F.least(one, F.col("ships") / 60.0), F.when(F.col("systems") >= 1, 1.0).otherwise(0.0)), 6).alias("confidence"))
