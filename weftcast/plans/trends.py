"""Queries on how verdicts change: leaders that are confirmed, discoveries, benchmarks and the newest evaluations beside each other."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import truth as T
from .base import E, QUERIES, SQL, events, query, r6
from .reports import BOARD, pair


def confirmed_transitions(samples: DataFrame, by: list[str], time: str, leader: str, hold: int) -> DataFrame:
    """by, previous, leader and flips of labels whose leader has changed: runs of one leader last until the next begins, the newest as long as it has been seen; those that held less than ``hold`` don't count, and neither do neighbours of one leader then. A label of fewer than two samples can't be compared."""
    w = Window.partitionBy(*by)
    seen = samples.withColumn("__last", F.max(time).over(w)).withColumn("__n", F.count("*").over(w)).where("__n >= 2")
    starts = seen.withColumn("__was", F.lag(leader).over(w.orderBy(time))).where(~F.col("__was").eqNullSafe(F.col(leader)))
    held = starts.withColumn("__held", F.coalesce(F.lead(time).over(w.orderBy(time)), F.col("__last")) - F.col(time)).where(F.col("__held") >= hold)
    kept = held.withColumn("__before", F.lag(leader).over(w.orderBy(time))).where(~F.col("__before").eqNullSafe(F.col(leader)))
    return kept.groupBy(*by).agg(F.max_by("__before", time).alias("previous"), F.max_by(leader, time).alias("leader"), (F.count("*") - 1).alias("flips")).where("flips >= 1")


@query("w12_confirmed_transitions", f"""WITH {E}, h AS (SELECT user_id % 5 AS label, us // 3600000000 AS hour, event_type, sum(value) AS v FROM e GROUP BY ALL), l AS (SELECT label, hour, arg_max(event_type, (v, event_type)) AS leader FROM h GROUP BY 1, 2),
s AS (SELECT *, max(hour) OVER (PARTITION BY label) AS last, count(*) OVER (PARTITION BY label) AS n, lag(leader) OVER (PARTITION BY label ORDER BY hour) AS was FROM l), r AS (SELECT *, coalesce(lead(hour) OVER (PARTITION BY label ORDER BY hour), last) - hour AS held FROM s WHERE n >= 2 AND was IS DISTINCT FROM leader),
k AS (SELECT * FROM (SELECT *, lag(leader) OVER (PARTITION BY label ORDER BY hour) AS before FROM r WHERE held >= 3) WHERE before IS DISTINCT FROM leader)
SELECT label, arg_max(before, hour) AS previous, arg_max(leader, hour) AS leader, count(*) - 1 AS flips FROM k GROUP BY label HAVING count(*) >= 2""")
def w12c(spark, d):
    """Per group of users: which kind of event led last, after which, and how often that has changed, leads of under three hours aside."""
    hours = events(spark, d).groupBy((F.col("user_id") % 5).alias("label"), F.floor(F.col("us") / T.HOUR).cast("long").alias("hour"), "event_type").agg(F.sum("value").alias("v"))
    leader = hours.groupBy("label", "hour").agg(F.max_by("event_type", F.struct("v", "event_type")).alias("leader"))
    return confirmed_transitions(leader, ["label"], "hour", "leader", 3)


@query("ag20_discoveries", f"""WITH p AS ({SQL['t11_benjamini_hochberg']}), q AS ({SQL['t11_e_bh']})
SELECT 'p' AS family, count(*) FILTER (adjusted <= 0.1) AS discoveries, count(adjusted) AS pairs FROM p UNION ALL SELECT 'e', count(*) FILTER (discovery), count(*) FILTER (k % 7 > 0) FROM q""")
def ag20d(spark, d):
    """What either correction for many tests flags, and of how many pairs that it could test."""
    by_p, by_e = QUERIES["t11_benjamini_hochberg"](spark, d), QUERIES["t11_e_bh"](spark, d)
    p = by_p.agg(F.lit("p").alias("family"), F.count_if(F.col("adjusted") <= 0.1).alias("discoveries"), F.count("adjusted").alias("pairs"))
    return p.unionByName(by_e.agg(F.lit("e").alias("family"), F.count_if("discovery").alias("discoveries"), F.count_if(F.col("k") % 7 > 0).alias("pairs")))


def against_benchmark(board: DataFrame, by: list[str], benchmark: str) -> DataFrame:
    """benchmark_mae, best_mae (the least of all other methods in a slice) and slices, over slices that have both, weighted by the benchmark's cases. board: by, method, n, mae."""
    known = board.where("mae is not null and n is not null")
    own = known.where(F.col("method") == benchmark).groupBy(*by).agg(F.min("mae").alias("own"), F.max("n").alias("n"))
    rest = known.where(F.col("method") != benchmark).groupBy(*by).agg(F.min("mae").alias("best"))
    both = own.join(rest, by).where("n > 0")
    mean = lambda c: F.try_divide(F.sum(F.col(c) * F.col("n")), F.sum("n"))
    return both.agg(mean("own").alias("benchmark_mae"), mean("best").alias("best_mae"), F.count("*").alias("slices")).where("slices > 0")


@query("ag20_benchmark", f"""WITH {BOARD}, m AS (SELECT fold, bucket, method, count(p) AS n, avg(abs(p - y)) AS mae FROM al GROUP BY ALL), o AS (SELECT fold, bucket, mae AS own, n FROM m WHERE method = 'equal_weight'), b AS (SELECT fold, bucket, min(mae) AS best FROM m WHERE method <> 'equal_weight' GROUP BY ALL)
SELECT round(sum(own * n) / sum(n), 6) AS benchmark_mae, round(sum(best * n) / sum(n), 6) AS best_mae, count(*) AS slices FROM o JOIN b USING (fold, bucket) WHERE n > 0""")
def ag20b(spark, d):
    """Equal weight as the benchmark of all else, over the slices that have both."""
    board = pair(spark, d).groupBy("fold", "bucket", "method").agg(F.count("p").alias("n"), F.avg(F.abs(F.col("p") - F.col("y"))).alias("mae"))
    out = against_benchmark(board, ["fold", "bucket"], "equal_weight")
    return out.select(r6(F.col("benchmark_mae"), "benchmark_mae"), r6(F.col("best_mae"), "best_mae"), "slices")


def quality_change(board: DataFrame, by: list[str], order: str = "created") -> DataFrame:
    """before, after, percent and slices: the means, weighted by cases, of the best errors of all slices in the two newest evaluations. One evaluation gives no row. board: evaluation, ``order``, by, method, n, mae; evaluations are few."""
    best = board.where("mae is not null and n is not null").groupBy("evaluation", *by).agg(F.max(order).alias("at"), F.min("mae").alias("mae"), F.max("n").alias("n"))
    each = best.groupBy("evaluation").agg(F.max("at").alias("at"), F.try_divide(F.sum(F.col("mae") * F.col("n")), F.sum("n")).alias("mae"), F.count("*").alias("slices"))
    last = each.agg(F.slice(F.sort_array(F.collect_list(F.struct("at", "evaluation", "mae", "slices")), asc=False), 1, 2).alias("e")).where(F.size("e") == 2)
    before, after = F.col("e")[1]["mae"], F.col("e")[0]["mae"]
    return last.where(before.isNotNull() & after.isNotNull()).select(before.alias("before"), after.alias("after"), F.when(before > 0, (after - before) / before * 100).otherwise(0.0).alias("percent"), F.col("e")[0]["slices"].alias("slices"))


@query("ag20_quality_delta", f"""WITH {BOARD}, m AS (SELECT fold, bucket, method, count(p) AS n, avg(abs(p - y)) AS mae FROM al GROUP BY ALL), b AS (SELECT fold, bucket, min(mae) AS mae, max(n) AS n FROM m GROUP BY ALL), ev AS (SELECT fold, sum(mae * n) / sum(n) AS mae, count(*) AS slices FROM b GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY fold DESC) AS k FROM ev)
SELECT round(o.mae, 6) AS before, round(n.mae, 6) AS after, round((n.mae - o.mae) / o.mae * 100, 4) AS percent, n.slices FROM r n, r o WHERE n.k = 1 AND o.k = 2""")
def ag20q(spark, d):
    """The newest fold beside the one before, by the best method of each slice."""
    board = pair(spark, d).groupBy(F.col("fold").alias("evaluation"), "bucket", "method").agg(F.count("p").alias("n"), F.avg(F.abs(F.col("p") - F.col("y"))).alias("mae"), F.max("fold").alias("created"))
    return quality_change(board, ["bucket"]).select(r6(F.col("before"), "before"), r6(F.col("after"), "after"), F.round("percent", 4).alias("percent"), "slices")


#: Shares of changed slices, distances from the nominal coverage and days of a gap from which a panel is amber or red.
CHURN_AMBER, CHURN_RED, COVERAGE, COVERAGE_AMBER, GAP_FACTOR, GAP_DAYS = 0.3, 0.6, 0.8, 0.1, 1.5, 4
FOLD_BOARD = f"{BOARD}, fb AS (SELECT fold, bucket, method, count(p) AS n, avg(abs(p - y)) AS mae FROM al GROUP BY ALL)"


def fold_board(spark, d) -> DataFrame:
    return pair(spark, d).groupBy("fold", "bucket", "method").agg(F.count("p").alias("n"), F.avg(F.abs(F.col("p") - F.col("y"))).alias("mae"))


def churn(winners: DataFrame, order: str, keys: list[str], most: int = 30) -> DataFrame:
    """Of each release but the first: slices that it shares with the one before, the share of them whose method changed, and what that is a sign of; the newest ``most``. winners: order (releases are numbered), keys, method."""
    before = winners.select(*keys, (F.col(order) + 1).alias(order), F.col("method").alias("was"))
    rate = winners.join(before, [*keys, order]).groupBy(order).agg(F.count("*").alias("slices"), F.avg((F.col("method") != F.col("was")).cast("double")).alias("rate"))
    newest = rate.orderBy(F.desc(order)).limit(most)
    return newest.withColumn("status", F.when(F.col("rate") >= CHURN_RED, "red").when(F.col("rate") >= CHURN_AMBER, "amber").otherwise("ok"))


@query("ag27_churn_panel", f"""WITH {FOLD_BOARD}, w AS (SELECT fold, bucket, arg_min(method, (round(mae, 9), method)) AS method FROM fb GROUP BY 1, 2), r AS (SELECT a.fold, count(*) AS slices, avg(CASE WHEN a.method <> b.method THEN 1.0 ELSE 0 END) AS rate FROM w a JOIN w b ON a.bucket = b.bucket AND a.fold = b.fold + 1 GROUP BY 1)
SELECT fold, slices, round(rate, 6) AS rate, CASE WHEN rate >= {CHURN_RED} THEN 'red' WHEN rate >= {CHURN_AMBER} THEN 'amber' ELSE 'ok' END AS status FROM r ORDER BY fold DESC LIMIT 30""")
def ag27c(spark, d):
    """How many slices change hands from fold to fold."""
    winners = fold_board(spark, d).groupBy("fold", "bucket").agg(F.min_by("method", F.struct(F.round("mae", 9), F.col("method"))).alias("method"))
    return churn(winners, "fold", ["bucket"]).select("fold", "slices", r6(F.col("rate"), "rate"), "status")


@query("ag27_promise_panel", f"""WITH {BOARD}, c AS (SELECT method, bucket, valid // 24 AS day, count(p) AS n, avg(abs(p - y)) AS live FROM al GROUP BY ALL), b AS (SELECT *, sum(n * live) OVER u / sum(n) OVER u AS promised FROM c WINDOW u AS (PARTITION BY method, bucket ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
p AS (SELECT method, day, sum(n * live) / sum(n) AS live, sum(n * promised) / sum(n) AS promised FROM b WHERE promised IS NOT NULL GROUP BY 1, 2), l AS (SELECT *, sum(CASE WHEN live > promised THEN 1 ELSE 0 END) OVER (PARTITION BY method ORDER BY day ROWS 6 PRECEDING) AS late, row_number() OVER (PARTITION BY method ORDER BY day DESC) AS k FROM p)
SELECT method, day, round(live, 6) AS live, round(promised, 6) AS promised, CASE WHEN live > {GAP_FACTOR} * promised THEN 'red' WHEN late >= {GAP_DAYS} THEN 'amber' ELSE 'ok' END AS status FROM l WHERE k <= 60""")
def ag27p(spark, d):
    """Each day's error of a method beside what its slices had promised by then, both weighted by cases, for the last sixty days: red beyond half as bad again, amber after four worse days of seven."""
    cells = pair(spark, d).groupBy("method", "bucket", F.floor(F.col("valid") / 24).cast("long").alias("day")).agg(F.count("p").alias("n"), F.avg(F.abs(F.col("p") - F.col("y"))).alias("live"))
    before = Window.partitionBy("method", "bucket").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    told = cells.withColumn("promised", F.sum(F.col("n") * F.col("live")).over(before) / F.sum("n").over(before)).where("promised is not null")
    mean = lambda c: (F.sum(F.col("n") * F.col(c)) / F.sum("n")).alias(c)
    days = told.groupBy("method", "day").agg(mean("live"), mean("promised"))
    by = Window.partitionBy("method")
    late = F.sum(F.when(F.col("live") > F.col("promised"), 1).otherwise(0)).over(by.orderBy("day").rowsBetween(-6, 0))
    last = days.withColumn("late", late).withColumn("k", F.row_number().over(by.orderBy(F.desc("day")))).where("k <= 60")
    status = F.when(F.col("live") > GAP_FACTOR * F.col("promised"), "red").when(F.col("late") >= GAP_DAYS, "amber").otherwise("ok")
    return last.select("method", "day", r6(F.col("live"), "live"), r6(F.col("promised"), "promised"), status.alias("status"))


@query("ag27_coverage_panel", f"""WITH {BOARD}, er AS (SELECT fold, bucket, method, y - p AS e FROM al), s AS (SELECT bucket, method, fold + 1 AS fold, quantile_cont(e, 0.1) AS lo, quantile_cont(e, 0.9) AS hi FROM er GROUP BY ALL), c AS (SELECT er.fold, er.method, er.bucket, count(*) AS n, avg(CASE WHEN er.e BETWEEN lo AND hi THEN 1.0 ELSE 0 END) AS cov FROM er JOIN s USING (fold, bucket, method) GROUP BY ALL),
g AS (SELECT fold, method, sum(n) AS n, sum(n * cov) / sum(n) AS coverage FROM c GROUP BY 1, 2), t AS (SELECT method FROM g GROUP BY 1 ORDER BY sum(n) DESC, 1 LIMIT 8)
SELECT fold, method, n::BIGINT AS n, round(coverage, 6) AS coverage, abs(coverage - {COVERAGE}) > {COVERAGE_AMBER} AS off FROM g WHERE method IN (SELECT method FROM t)""")
def ag27v(spark, d):
    """How much of a fold lies within four fifths of the errors of the one before, by method, weighted by cases; the eight with most of them."""
    e = pair(spark, d).withColumn("e", F.col("y") - F.col("p")).select("fold", "bucket", "method", "e")
    q = F.percentile("e", F.array(F.lit(0.1), F.lit(0.9)))
    spread = e.groupBy("bucket", "method", (F.col("fold") + 1).alias("fold")).agg(q.alias("q"))
    inside = F.avg(F.when(F.col("e").between(F.col("q")[0], F.col("q")[1]), 1.0).otherwise(0.0))
    cells = e.join(spread, ["fold", "bucket", "method"]).groupBy("fold", "method", "bucket").agg(F.count("*").alias("n"), inside.alias("cov"))
    g = cells.groupBy("fold", "method").agg(F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("cov")) / F.sum("n")).alias("coverage"))
    top = g.groupBy("method").agg(F.sum("n").alias("total")).orderBy(F.desc("total"), "method").limit(8).select("method")
    return g.join(F.broadcast(top), "method", "left_semi").select("fold", "method", "n", r6(F.col("coverage"), "coverage"), (F.abs(F.col("coverage") - COVERAGE) > COVERAGE_AMBER).alias("off"))  # eight rows


@query("ag27_footprint_panel", f"WITH {FOLD_BOARD}, c AS (SELECT fold, method, sum(n) AS rows, count(DISTINCT bucket) AS slices FROM fb GROUP BY 1, 2) SELECT fold, max(rows)::BIGINT AS rows, count(*) AS methods, max(slices) AS slices, sum(sum(rows)) OVER (ORDER BY fold)::BIGINT AS volume FROM c GROUP BY fold")
def ag27f(spark, d):
    """How many rows an evaluation has, and how many all have up to it."""
    c = fold_board(spark, d).groupBy("fold", "method").agg(F.sum("n").alias("rows"), F.count_distinct("bucket").alias("slices"))
    g = c.groupBy("fold").agg(F.max("rows").alias("rows"), F.count("*").alias("methods"), F.max("slices").alias("slices"), F.sum("rows").alias("v"))
    return g.select("fold", "rows", "methods", "slices", F.sum("v").over(Window.orderBy("fold").rowsBetween(Window.unboundedPreceding, 0)).alias("volume"))  # a row a fold
