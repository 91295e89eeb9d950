"""Queries on promotion, serving and the dashboard's remaining panels."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import laws
from ..operators import matrix as M
from ..operators import methods as X
from ..operators import quality as Q
from ..operators import temporal as P
from .base import E, events, query, r6, read
from .forecasts import BASE, PATH, matrix, minutes, observed, split
from .inference import spread
from .observations import QC, log, qc
from .reports import BOARD, pair


@query("t9_promotion_gate", f"""WITH {BOARD}, m AS (SELECT bucket, method, count(p) AS n, count(DISTINCT valid) AS nv, count(p) / count(*) AS cov, round(avg(abs(p - y)), 6) AS mae FROM al GROUP BY 1, 2),
e1 AS (SELECT * FROM m WHERE cov >= 0.8 AND n >= 8 AND nv >= 8), r AS (SELECT bucket, mae AS ref FROM e1 WHERE method = 'equal_weight'), b AS (SELECT bucket, arg_min(method, (mae, method)) AS best, min(mae) AS mae FROM e1 GROUP BY 1)
SELECT bucket, CASE WHEN ref IS NOT NULL AND mae < 0.99 * ref THEN best ELSE 'equal_weight' END AS promoted, mae, ref FROM b LEFT JOIN r USING (bucket)""")
def t9(spark, d):
    """The best eligible method where it beats the reference by a hundredth, else the reference."""
    e = F.abs(F.col("p") - F.col("y"))
    m = pair(spark, d).groupBy("bucket", "method").agg(F.count("p").alias("n"), F.count_distinct("valid").alias("nv"), (F.count("p") / F.count("*")).alias("cov"), r6(F.avg(e), "mae")).where("cov >= 0.8 and n >= 8 and nv >= 8")
    best = m.groupBy("bucket").agg(F.min_by("method", F.struct("mae", "method")).alias("best"), F.min("mae").alias("mae"), F.max(F.when(F.col("method") == "equal_weight", F.col("mae"))).alias("ref"))
    return best.select("bucket", F.when(F.col("ref").isNotNull() & (F.col("mae") < 0.99 * F.col("ref")), F.col("best")).otherwise("equal_weight").alias("promoted"), "mae", "ref")


@query("t10_pooled_gate", f"WITH {BOARD} SELECT CASE WHEN bucket IN ('12-24h', '24-48h', '48-96h') THEN 'far' ELSE bucket END AS pool, method, count(*) AS n, round(avg(abs(p - y)), 6) AS mae FROM al GROUP BY 1, 2")
def t10(spark, d):
    pool = F.when(F.col("bucket").isin("12-24h", "24-48h", "48-96h"), "far").otherwise(F.col("bucket"))
    return pair(spark, d).groupBy(pool.alias("pool"), "method").agg(F.count("*").alias("n"), r6(F.avg(F.abs(F.col("p") - F.col("y"))), "mae"))


@query("t22_latch", f"WITH {E}, d AS (SELECT event_type, us // 86400000000 AS day, avg(value) AS v FROM e GROUP BY 1, 2), a AS (SELECT *, v > median(v) OVER (PARTITION BY event_type) AS hit FROM d), i AS (SELECT *, day - row_number() OVER (PARTITION BY event_type, hit ORDER BY day) AS run FROM a) SELECT event_type, min(day) AS first_day, count(*) AS days FROM i WHERE hit GROUP BY event_type, run HAVING count(*) >= 3")
def t22(spark, d):
    """Verdicts that hold on three days running; a day counts once."""
    day = events(spark, d).groupBy("event_type", F.floor(F.col("us") / 86_400_000_000).cast("long").alias("day")).agg(F.avg("value").alias("v"))
    hit = day.withColumn("hit", F.col("v") > F.median("v").over(Window.partitionBy("event_type"))).where("hit")
    runs = hit.withColumn("run", F.col("day") - F.row_number().over(Window.partitionBy("event_type").orderBy("day")))
    return runs.groupBy("event_type", "run").agg(F.min("day").alias("first_day"), F.count("*").alias("days")).where("days >= 3").drop("run")


@query("ag24_pooled_skill", f"WITH {BOARD}, m AS (SELECT fold, method, count(*) AS n, avg(abs(p - y)) AS mae FROM al GROUP BY 1, 2) SELECT method, sum(n)::BIGINT AS n, round(sum(n * mae) / sum(n), 6) AS mae FROM m WHERE n >= 24 GROUP BY 1")
def ag24(spark, d):
    m = pair(spark, d).groupBy("fold", "method").agg(F.count("*").alias("n"), F.avg(F.abs(F.col("p") - F.col("y"))).alias("mae")).where("n >= 24")
    return m.groupBy("method").agg(F.sum("n").alias("n"), r6(F.sum(F.col("n") * F.col("mae")) / F.sum("n"), "mae"))


@query("j10_snapshot_grid", f"WITH {BASE} SELECT issue, source FROM snaps, (SELECT DISTINCT source FROM cyc)")
def j10(spark, d):
    e = events(spark, d)
    snaps = e.select(F.floor(F.col("us") / 3_600_000_000).cast("long").alias("issue")).distinct()
    return M.with_each(snaps, e.select(F.col("event_type").alias("source")), "source")


@query("b8_release", f"WITH {BOARD}, m AS (SELECT bucket, method, round(avg(abs(p - y)), 6) AS mae FROM al GROUP BY 1, 2), w AS (SELECT bucket, arg_min(method, (mae, method)) AS method FROM m GROUP BY 1) SELECT substr(sha256(string_agg(bucket || '=' || method, ';' ORDER BY bucket)), 1, 16) AS release_id, count(*) AS slices FROM w")
def b8(spark, d):
    """The winners of all slices and an identifier made of them."""
    m = pair(spark, d).groupBy("bucket", "method").agg(r6(F.avg(F.abs(F.col("p") - F.col("y"))), "mae"))
    won = m.groupBy("bucket").agg(F.min_by("method", F.struct("mae", "method")).alias("method"))
    parts = F.array_sort(F.collect_list(F.concat("bucket", F.lit("="), "method")))  # a slice a bucket
    return won.agg(F.substring(F.sha2(F.array_join(parts, ";"), 256), 1, 16).alias("release_id"), F.count("*").alias("slices"))


@query("b13_minutely_product", f"""WITH {PATH}, mm AS (SELECT issue, m::INTEGER AS m, p + (m / 60.0 - lead) / (l1 - lead) * (p1 - p) AS p FROM k, range(1, 61) AS r(m) WHERE l1 IS NOT NULL AND m >= lead * 60 AND m < l1 * 60), f AS (SELECT issue, arg_min(p, m) AS p0 FROM mm GROUP BY 1)
SELECT issue, count(*) AS n, round(avg(p + CASE WHEN exp(-m / 60.0) >= 0.05 THEN exp(-m / 60.0) ELSE 0 END * (y - p0)), 6) AS mean, round(min(p), 6) AS low FROM mm JOIN f USING (issue) JOIN truth ON valid = issue GROUP BY 1""")
def b13(spark, d):
    """The next hour's minutes, anchored once to the last observation."""
    mm = minutes(spark, d)
    first = mm.groupBy("issue").agg(F.min_by("p", "m").alias("p0"))
    rows = mm.join(first, "issue").join(observed(spark, d), "issue")
    return rows.groupBy("issue").agg(F.count("*").alias("n"), r6(F.avg(F.col("p") + S.anchor_weight(F.col("m") / 60, 1.0) * (F.col("obs") - F.col("p0"))), "mean"), r6(F.min("p"), "low"))


@query("dz1_flagged_share", f"WITH {E}, {QC}, s AS (SELECT user_id % 7 AS station, count(*) AS n, count(*) FILTER (value IS NULL) AS missing, count(*) FILTER ((b | s | f) = 0) AS clean FROM q2 GROUP BY 1) SELECT station, round(1 - clean / nullif(n - missing, 0), 6) AS flagged, CASE WHEN 1 - clean / nullif(n - missing, 0) >= 0.25 THEN 'red' WHEN 1 - clean / nullif(n - missing, 0) >= 0.05 THEN 'amber' ELSE 'green' END AS light FROM s")
def dz1(spark, d):
    s = Q.summary(qc(log(spark, d)).withColumn("station", F.col("user_id") % 7), ["station"])
    share = 1 - F.try_divide(F.col("clean"), F.col("samples") - F.col("missing"))
    return s.select("station", r6(share, "flagged"), F.when(share >= 0.25, "red").when(share >= 0.05, "amber").otherwise("green").alias("light"))


@query("dz7_release_lineage", "SELECT o_custkey, o_orderkey, o_orderstatus <> lag(o_orderstatus) OVER w AS changed, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS age FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
def dz7(spark, d):
    w = Window.partitionBy("o_custkey")
    old = w.orderBy("o_orderdate", "o_orderkey")
    return read(spark, d, "orders").select("o_custkey", "o_orderkey", (F.col("o_orderstatus") != F.lag("o_orderstatus").over(old)).alias("changed"), F.row_number().over(w.orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))).cast("long").alias("age"))


@query("sc1_station_times", "SELECT o_orderkey, epoch_us(try_cast(t AS TIMESTAMP)) AS us FROM (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate::TIMESTAMP, '%Y-%m-%d %H:%M:%S') WHEN 1 THEN strftime(o_orderdate::TIMESTAMP, '%Y-%m-%d %H:%M:%S') || '.250' ELSE 'no time' END AS t FROM orders)")
def sc1(spark, d):
    from ..sources.archive import utc

    text = F.date_format(F.col("o_orderdate").cast("timestamp"), "yyyy-MM-dd HH:mm:ss")
    t = F.when(F.col("o_orderkey") % 3 == 0, text).when(F.col("o_orderkey") % 3 == 1, F.concat(text, F.lit(".250"))).otherwise("no time")
    return read(spark, d, "orders").withColumn("t", t).select("o_orderkey", F.unix_micros(utc("t")).alias("us"))


@query("e33_censored_gamma")
def e33(spark, d):
    """Amounts above 60, of truths and grounded sources."""
    above = lambda rows: rows.withColumn("x", F.greatest(F.col("x") - 60, F.lit(0.0))).withColumn("raw", F.col("x")).withColumn("y", F.greatest(F.col("y") - 60, F.lit(0.0)))
    train, test = (above(rows) for rows in split(spark, d))
    return spread(laws.censored_gamma(X.grounded(train, train), X.grounded(train, test)), laws.LEVELS)
