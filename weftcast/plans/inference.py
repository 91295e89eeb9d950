"""Queries on inference, ordered methods, serving and ledgers."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import inference as I
from ..operators import methods as X
from ..operators import relations as R
from ..operators import laws as L
from ..operators import sequential as Q
from .base import E, events, query, r6, read
from .forecasts import BASE, BIAS, matrix, observed, score, split  # noqa: F401
from .reports import BOARD, pair


def losses(spark, d):
    return I.collapsed(pair(spark, d), ["bucket"])


def differences(spark, d):
    return I.loss_differences(losses(spark, d), ["bucket"], "equal_weight", "grounded_equal_weight")


@query("t5_diebold_mariano", f"""WITH {BOARD}, l AS (SELECT bucket, valid, method, avg(abs(p - y)) AS loss FROM al GROUP BY 1, 2, 3), d AS (SELECT bucket, valid, max(loss) FILTER (method = 'equal_weight') - max(loss) FILTER (method = 'grounded_equal_weight') AS d FROM l GROUP BY 1, 2),
c AS (SELECT *, d - avg(d) OVER (PARTITION BY bucket) AS c FROM d WHERE d IS NOT NULL), k AS (SELECT *, c * lag(c) OVER w AS c1, c * lag(c, 2) OVER w AS c2 FROM c WINDOW w AS (PARTITION BY bucket ORDER BY valid)),
v AS (SELECT bucket, count(*) AS n, avg(d) AS m, sum(c * c) / count(*) + 2 * 2.0 / 3 * coalesce(sum(c1), 0) / count(*) + 2 * 1.0 / 3 * coalesce(sum(c2), 0) / count(*) AS v FROM k GROUP BY 1)
SELECT bucket, n, round(m, 6) AS mean_diff, round(CASE WHEN n >= 8 AND v > 0 THEN m / sqrt(v / n) * sqrt((n + 1 - 6 + 6.0 / n) / n) END, 6) AS stat FROM v""")
def t5(spark, d):
    return I.dm_moments(differences(spark, d), ["bucket"], 2).select("bucket", "n", r6(F.col("mean_diff"), "mean_diff"), r6(F.col("stat"), "stat"))


@query("t5_dm_p_values")
def t5p(spark, d):
    return I.dm_table(differences(spark, d), ["bucket"], 2)


@query("t7_model_confidence_set")
def t7(spark, d):
    return I.confidence_sets(losses(spark, d), ["bucket"])


@query("t11_benjamini_hochberg", "WITH p AS (SELECT l_returnflag AS g, l_partkey AS k, ((sum(l_quantity) * 37) % 1009 / 1009)::DOUBLE AS p FROM lineitem GROUP BY 1, 2), r AS (SELECT *, p * count(*) OVER (PARTITION BY g) / row_number() OVER (PARTITION BY g ORDER BY p) AS raw FROM p) SELECT g, k, round(least(1, min(raw) OVER (PARTITION BY g ORDER BY p DESC)), 6) AS adjusted FROM r")
def t11(spark, d):
    p = read(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("g"), F.col("l_partkey").alias("k")).agg(((F.sum("l_quantity") * 37) % 1009 / 1009).cast("double").alias("p"))
    w = Window.partitionBy("g")
    raw = p.withColumn("raw", F.col("p") * F.count("*").over(w) / F.row_number().over(w.orderBy("p")))
    return raw.select("g", "k", r6(F.least(F.lit(1.0), F.min("raw").over(w.orderBy(F.desc("p")))), "adjusted"))


@query("t20_t21_slopes", "SELECT o_custkey % 25 AS g, count(*) AS n, round(regr_slope(o_totalprice, o_orderkey), 6) AS slope, round(regr_intercept(o_totalprice, o_orderkey), 3) AS intercept FROM orders GROUP BY 1 HAVING count(*) >= 4")
def t20(spark, d):
    return read(spark, d, "orders").groupBy((F.col("o_custkey") % 25).alias("g")).agg(F.count("*").alias("n"), r6(F.regr_slope("o_totalprice", "o_orderkey"), "slope"), F.round(F.regr_intercept("o_totalprice", "o_orderkey"), 3).alias("intercept")).where("n >= 4")


@query("b1_truth_clocks", f"WITH {E} SELECT event_id, us // 3600000000 + 2 AS hourly_known, us // 60000000 + 5 AS minutely_known, (epoch(timezone('America/Los_Angeles', (timezone('America/Los_Angeles', timezone('UTC', ts))::DATE + 1)::TIMESTAMP)) / 3600 + 1)::BIGINT AS daily_known FROM e")
def b1(spark, d):
    next_day = F.date_add(S.local_date(F.col("ts").cast("timestamp"), "America/Los_Angeles"), 1)
    known = F.unix_seconds(F.to_utc_timestamp(next_day.cast("timestamp"), "America/Los_Angeles")) / 3600 + 1
    return events(spark, d).select("event_id", (F.floor(F.col("us") / 3_600_000_000) + 2).cast("long").alias("hourly_known"), (F.floor(F.col("us") / 60_000_000) + 5).cast("long").alias("minutely_known"), known.cast("long").alias("daily_known"))


@query("b10_residual_dressing", f"WITH {BASE}, r AS (SELECT bucket, count(*) AS n, quantile_cont(y - x, 0.1) AS lo, quantile_cont(y - x, 0.9) AS hi FROM matrix WHERE y IS NOT NULL GROUP BY 1), g AS (SELECT quantile_cont(y - x, 0.1) AS lo, quantile_cont(y - x, 0.9) AS hi FROM matrix WHERE y IS NOT NULL) SELECT issue, valid, source, round(x + CASE WHEN n >= 24 THEN r.lo ELSE g.lo END, 6) AS low, round(x + CASE WHEN n >= 24 THEN r.hi ELSE g.hi END, 6) AS high FROM matrix LEFT JOIN r USING (bucket), g")
def b10(spark, d):
    m = matrix(spark, d)
    e = m.where("y is not null").withColumn("e", F.col("y") - F.col("x"))
    q = F.percentile("e", F.array(F.lit(0.1), F.lit(0.9)))
    pools, whole = e.groupBy("bucket").agg(F.count("*").alias("n"), q.alias("q")), e.agg(q.alias("g"))
    rows = m.join(pools, "bucket", "left").crossJoin(F.broadcast(whole))  # one row
    used = F.when(F.col("n") >= 24, F.col("q")).otherwise(F.col("g"))
    return rows.select("issue", "valid", "source", r6(F.col("x") + used[0], "low"), r6(F.col("x") + used[1], "high"))


@query("sc13_sc15_curves", "WITH q AS (SELECT o_custkey, list_sort(list(o_totalprice::DOUBLE)) AS q FROM orders GROUP BY 1) SELECT o_custkey, round(q[1], 4) AS lowest, round(CASE WHEN len(q) = 1 THEN q[1] WHEN len(q) = 2 THEN q[1] + (q[2] - q[1]) * 0.5 ELSE q[2] + (q[3] - q[2]) * 0.5 END, 4) AS mid FROM q")
def sc13(spark, d):
    q = read(spark, d, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.col("o_totalprice").cast("double"))).alias("q"))
    knots = F.transform("q", lambda v, i: (i + 1).cast("double"))
    at = F.when(F.size("q") == 2, 1.5).otherwise(2.5)
    return q.select("o_custkey", F.round(F.element_at("q", 1), 4).alias("lowest"), F.round(S.interpolated(at, knots, F.col("q")), 4).alias("mid"))


@query("snk8_ledger_pruning", "SELECT o_orderkey FROM (SELECT o_orderkey, o_orderdate::DATE AS t FROM orders) WHERE t >= (SELECT max(o_orderdate::DATE) FROM orders) - 730 ORDER BY t DESC, o_orderkey DESC LIMIT 500")
def snk8(spark, d):
    o = read(spark, d, "orders").select("o_orderkey", F.unix_date(F.col("o_orderdate").cast("date")).alias("t"))
    now = o.agg(F.max("t")).first()[0]
    return R.pruned(o.withColumn("at", F.col("t") * 10_000_000_000 + F.col("o_orderkey")), "at", now * 10_000_000_000, 730 * 10_000_000_000, 500).select("o_orderkey")


@query("e30_ewa")
def e30(spark, d):
    return score(Q.experts(*grounded_split(spark, d)))


@query("e31_boa")
def e31(spark, d):
    return score(Q.experts(*grounded_split(spark, d), second_order=True))


@query("e23_seamless_regression")
def e23(spark, d):
    return score(Q.seamless(*split(spark, d), observed(spark, d)))


@query("e24_inverse_covariance")
def e24(spark, d):
    return score(Q.inverse_covariance(*split(spark, d)))


def spread(pred, levels=Q.LEVELS):
    low, high = levels.index(0.1), levels.index(0.9)
    inside = F.when((F.col("y") >= F.col("q")[low]) & (F.col("y") <= F.col("q")[high]), 1.0).otherwise(0.0)
    scored = pred.where("q is not null")
    return scored.groupBy("fold", "bucket").agg(F.count("*").alias("n"), r6(F.avg(F.abs(F.col("p") - F.col("y"))), "mae"), r6(F.avg(inside), "coverage80"))


def daylight():
    """Whether the sun is up at the site when a row is valid."""
    return sun() > 0


def sun():
    return S.solar_elevation_deg(F.timestamp_seconds(F.col("valid") * 3600), 34.2768, -117.1692)


def grounded_split(spark, d):
    """Training and test rows with each source's bias added, as bases of the distributional methods."""
    train, test = (rows.withColumn("raw", F.col("x")) for rows in split(spark, d))
    return X.grounded(train, train), X.grounded(train, test)


@query("e32_emos")
def e32(spark, d):
    return spread(L.emos(*grounded_split(spark, d)), L.LEVELS)


@query("e32_emos_of_bounded_values")
def e32b(spark, d):
    """The same for values that are never negative: a normal law cut off at zero."""
    return spread(L.emos(*grounded_split(spark, d), minimum=0.0), L.LEVELS)


@query("e34_idr")
def e34(spark, d):
    return spread(L.isotonic_distribution(*grounded_split(spark, d)), L.LEVELS)


@query("e37_conformal")
def e37(spark, d):
    return spread(Q.conformal(*split(spark, d), X.grounded, daylight()))


def calibration(spark, d, beta):
    """Probabilities of quality by length, recalibrated by source; brier scores before and after on the third of the rows that is held out."""
    rows = read(spark, d, "documents").join(read(spark, d, "labels"), "doc_id").select("source", F.least(F.lit(1.0), F.col("n_chars") / 5000.0).alias("p"), F.col("quality").cast("double").alias("y"), F.when(F.col("doc_id") % 3 == 0, "test").otherwise("train").alias("part"))
    out = Q.recalibrated(rows, "source", "p", "y", "part", beta)
    brier = lambda c: r6(F.avg((F.col(c) - F.col("y")) ** 2), "b")
    return out.groupBy("source").agg(F.count("*").alias("n"), brier("p").alias("before"), brier("after").alias("after"))


@query("e39_pop_platt")
def e39(spark, d):
    return calibration(spark, d, beta=False)


@query("e40_pop_beta")
def e40(spark, d):
    return calibration(spark, d, beta=True)
