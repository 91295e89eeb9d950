"""Queries on drift, breaks, gates and what is served because of them."""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import inference as I
from ..operators import release as R
from ..operators import temporal as P
from ..sources import observability as O
from ..sources.scratch import session_dir, settled
from .base import E, events, query, r6, read
from .forecasts import BASE, BIAS, MEAN, board, matrix, relations
from .reports import BOARD, pair

DAY_US = 86_400_000_000
#: The rule of ``robust_scale`` in SQL, over rows s(keys, e): centre, scale, n of the groups that can be judged.
SCALED = """{n}q AS (SELECT {by}, count(*) AS n, median(e) AS centre, quantile_cont(e, 0.75) - quantile_cont(e, 0.25) AS iqr FROM {rows} GROUP BY {by}),
{n}s AS (SELECT {by}, any_value(n) AS n, any_value(centre) AS centre, greatest(1.4826 * median(abs(e - centre)), 0.1 * any_value(iqr), 1e-3) AS scale FROM {rows} JOIN {n}q USING ({by}) GROUP BY {by} HAVING 1.4826 * median(abs(e - centre)) >= 1e-3 AND avg(CASE WHEN abs(e - centre) <= 1e-3 THEN 1.0 ELSE 0 END) <= 0.9)"""

RESIDUALS = "r AS (SELECT source, bucket, issue, avg(x - y) AS e FROM matrix WHERE y IS NOT NULL GROUP BY 1, 2, 3)"
DEVIATIONS = "d0 AS (SELECT issue, bucket, source, x - median(x) OVER (PARTITION BY issue, valid) AS dev, count(*) OVER (PARTITION BY issue, valid) AS k FROM matrix), d AS (SELECT source, bucket, issue, avg(dev) AS e FROM d0 WHERE k >= 4 GROUP BY 1, 2, 3)"


@query("t16_page_hinkley", f"""WITH {BASE}, {RESIDUALS}, {SCALED.format(n='r', by='source, bucket', rows='r')},
z AS (SELECT source, bucket, issue, n, greatest(-8, least(8, (e - centre) / scale)) AS z FROM r JOIN rs USING (source, bucket) WHERE n >= 48),
m AS (SELECT *, avg(z) OVER w AS mean, row_number() OVER w AS k FROM z WINDOW w AS (PARTITION BY source, bucket ORDER BY issue ROWS UNBOUNDED PRECEDING)),
c AS (SELECT *, sum(CASE WHEN k > 1 THEN z - mean - 0.1 ELSE 0 END) OVER w AS up, sum(CASE WHEN k > 1 THEN mean - z - 0.1 ELSE 0 END) OVER w AS down FROM m WINDOW w AS (PARTITION BY source, bucket ORDER BY issue ROWS UNBOUNDED PRECEDING)),
x AS (SELECT *, up - least(0, min(up) OVER w) AS a, down - least(0, min(down) OVER w) AS b FROM c WINDOW w AS (PARTITION BY source, bucket ORDER BY issue ROWS UNBOUNDED PRECEDING))
SELECT source, bucket, any_value(n) AS n, round(greatest(max(a), max(b)), 5) AS highest, greatest(max(a), max(b)) > greatest(25, 4 * sqrt(any_value(n))) AS alarm FROM x GROUP BY 1, 2""")
def t16(spark, d):
    e = matrix(spark, d).where("y is not null").groupBy("source", "bucket", "issue").agg(F.avg(F.col("x") - F.col("y")).alias("e"))
    return I.page_hinkley_table(e, ["source", "bucket"], "issue", "e").select("source", "bucket", "n", F.round("highest", 5).alias("highest"), "alarm")


def deviations(spark, d):
    w = Window.partitionBy("issue", "valid")
    rows = matrix(spark, d).withColumn("dev", F.col("x") - F.median("x").over(w)).withColumn("k", F.count("*").over(w)).where("k >= 4")
    return rows.groupBy("source", "bucket", "issue").agg(F.avg("dev").alias("e"))


@query("t15_consensus_shift", f"""WITH {BASE}, {DEVIATIONS}, t AS (SELECT bucket, max(issue) - 72 AS edge FROM d GROUP BY 1), past AS (SELECT source, bucket, e FROM d JOIN t USING (bucket) WHERE issue <= edge AND issue > edge - 504), {SCALED.format(n='p', by='source, bucket', rows='past')},
now AS (SELECT source, bucket, count(*) AS k, avg(e) AS e FROM d JOIN t USING (bucket) WHERE issue > edge GROUP BY 1, 2)
SELECT source, bucket, k AS recent, n AS past, round((e - centre) / (scale / sqrt(k)), 5) AS z, abs((e - centre) / (scale / sqrt(k))) > 6 AS alarm FROM now JOIN ps USING (source, bucket) WHERE k >= 4 AND n >= 24""")
def t15(spark, d):
    """The last three days' deviation from the other sources against the three weeks before."""
    dev = deviations(spark, d)
    edge = dev.groupBy("bucket").agg((F.max("issue") - 72).alias("edge"))
    rows = dev.join(F.broadcast(edge), "bucket")  # a row a bucket
    past = I.standardised(rows.where("issue <= edge and issue > edge - 504"), ["source", "bucket"], "e").groupBy("source", "bucket").agg(F.first("n").alias("past"), F.first("__centre").alias("c"), F.first("__scale").alias("s"))
    now = rows.where("issue > edge").groupBy("source", "bucket").agg(F.count("*").alias("recent"), F.avg("e").alias("e"))
    z = (F.col("e") - F.col("c")) / (F.col("s") / F.sqrt("recent"))
    return now.join(past, ["source", "bucket"]).where("recent >= 4 and past >= 24").select("source", "bucket", "recent", "past", F.round(z, 5).alias("z"), (F.abs(z) > 6).alias("alarm"))


DAY = "e AS (SELECT event_type, epoch_us(ts) // 86400000000 AS day, avg(value) AS v FROM events GROUP BY 1, 2)"


def days(spark, d):
    return events(spark, d).groupBy("event_type", F.floor(F.col("us") / DAY_US).cast("long").alias("day")).agg(F.avg("value").alias("v"))


def critical_sql(n: str) -> str:
    """The interpolated critical value in SQL."""
    c = I.SNHT_CRITICAL
    between = " ".join(f"WHEN {n} <= {b} THEN {v} + ({n} - {a}) * {(w - v) / (b - a)!r}" for (a, v), (b, w) in zip(c, c[1:]))
    return f"CASE WHEN {n} <= {c[0][0]} THEN {c[0][1]} {between} ELSE {c[-1][1]} END"


#: Over rows {{rows}}(key, day, v): the statistic, its place and the day after it, of each key.
HOMOGENEITY = """{n}z AS (SELECT *, (v - avg(v) OVER w) / nullif(stddev_pop(v) OVER w, 0) AS z FROM {rows} WINDOW w AS (PARTITION BY key)),
{n}k AS (SELECT *, row_number() OVER o AS k, sum(z) OVER o AS s, lead(day) OVER (PARTITION BY key ORDER BY day) AS nx, count(*) OVER (PARTITION BY key) AS n, sum(z) OVER (PARTITION BY key) AS a FROM {n}z WINDOW o AS (PARTITION BY key ORDER BY day ROWS UNBOUNDED PRECEDING)),
{n}t AS (SELECT *, s * s / k + (a - s) * (a - s) / (n - k) AS t FROM {n}k WHERE k < n),
{n}h AS (SELECT key, max(t) AS t, arg_max(day, (round(t, 9), -k)) AS at, arg_max(nx, (round(t, 9), -k)) AS nx, any_value(n) AS n FROM {n}t GROUP BY 1)"""


@query("t18_homogeneity", f"WITH {DAY}, s AS (SELECT event_type AS key, day, v FROM e), {HOMOGENEITY.format(n='s', rows='s')} SELECT key AS event_type, round(t, 6) AS t, sh.at, n, round(({critical_sql('n')})::DOUBLE, 6) AS critical, t > {critical_sql('n')} AS breaks FROM sh")
def t18(spark, d):
    found = I.snht(days(spark, d), ["event_type"], "day", "v")
    limit = I.snht_critical(F.col("n"))
    return found.select("event_type", r6(F.col("t"), "t"), "at", "n", r6(limit, "critical"), (F.col("t") > limit).alias("breaks"))


@query("t18_pettitt", f"""WITH {DAY}, r AS (SELECT *, rank() OVER (PARTITION BY event_type ORDER BY v) + (count(*) OVER (PARTITION BY event_type, v) - 1) / 2.0 AS r FROM e),
k AS (SELECT *, row_number() OVER o AS k, count(*) OVER (PARTITION BY event_type) AS n, sum(r) OVER o AS s FROM r WINDOW o AS (PARTITION BY event_type ORDER BY day ROWS UNBOUNDED PRECEDING)), u AS (SELECT *, abs(2 * s - k * (n + 1)) AS u FROM k)
SELECT event_type, max(u)::DOUBLE AS u, arg_max(day, (u, -k)) AS at, any_value(n) AS n, round(least(1, 2 * exp(-6 * max(u) ** 2 / (any_value(n) ** 2 * (any_value(n) + 1)))), 6) AS p_value FROM u GROUP BY 1""")
def t18p(spark, d):
    return I.pettitt(days(spark, d), ["event_type"], "day", "v").select("event_type", F.col("u").cast("double").alias("u"), "at", "n", r6(F.col("p_value"), "p_value"))


@query("t18_craddock", f"WITH {DAY} SELECT event_type, day, round(sum(v - m) OVER (PARTITION BY event_type ORDER BY day ROWS UNBOUNDED PRECEDING), 6) AS cusum FROM (SELECT *, avg(v) OVER (PARTITION BY event_type) AS m FROM e)")
def t18c(spark, d):
    return I.craddock(days(spark, d), ["event_type"], "day", "v").select("event_type", "day", r6(F.col("cusum"), "cusum"))


STATIONS = f"{E}, st AS (SELECT user_id % 10 AS st, us // {DAY_US} AS day, avg(value) AS v FROM e GROUP BY 1, 2), p AS (SELECT a.st || '-' || b.st AS key, a.st = 0 AS own, day, a.v - b.v AS v FROM st a JOIN st b USING (day) WHERE a.st < b.st)"


def station_pairs(spark, d):
    st = events(spark, d).groupBy((F.col("user_id") % 10).alias("st"), F.floor(F.col("us") / DAY_US).cast("long").alias("day")).agg(F.avg("value").alias("v"))
    a, b = st.alias("a"), st.alias("b")
    both = a.join(b, (F.col("a.day") == F.col("b.day")) & (F.col("a.st") < F.col("b.st")))
    return both.select(F.concat_ws("-", F.col("a.st").cast("string"), F.col("b.st").cast("string")).alias("key"), (F.col("a.st") == 0).alias("own"), F.col("a.day").alias("day"), (F.col("a.v") - F.col("b.v")).alias("v"))


ATTRIBUTION = f"""WITH {STATIONS}, {HOMOGENEITY.format(n='p', rows='p')}, b AS (SELECT key, starts_with(key, '0-') AS own, t > {critical_sql('n')} AS breaks, coalesce(nx, ph.at) AS day FROM ph WHERE n >= 7),
o AS (SELECT list_sort(list(day) FILTER (own AND breaks)) AS l FROM b), c AS (SELECT l[len(l) // 2 + 1] AS day FROM o),
a AS (SELECT count(*) FILTER (own) AS series, count(*) FILTER (own AND breaks) AS breaks, count(*) FILTER (own AND b.breaks AND abs(b.day - c.day) <= 2) AS coincident, count(*) FILTER (NOT own) AS pairs, count(*) FILTER (NOT own AND breaks) AS pair_breaks, any_value(c.day) AS break_day FROM b, c)"""
VERDICT = "CASE WHEN series < 3 THEN 'inconclusive' WHEN coincident * 3 >= 2 * series AND pair_breaks * 3 <= pairs THEN 'station_drift' WHEN coincident * 3 >= 2 * series OR pair_breaks * 3 > pairs THEN 'regime' ELSE 'inconclusive' END"


def attribution(spark, d):
    """One row: how many series of the station and of its neighbours break, how many of the station's about the same day, and what that says."""
    b = I.broken(station_pairs(spark, d), ["key", "own"], "day", "v")
    own = b.where("own and breaks").agg(F.array_sort(F.collect_list("day")).alias("l"))  # a day a neighbour
    day = own.select(F.get("l", F.floor(F.size("l") / 2).cast("int")).alias("break_day"))
    near = F.abs(F.col("day") - F.col("break_day")) <= 2
    counts = b.crossJoin(F.broadcast(day)).agg(F.count_if("own").alias("series"), F.count_if(F.col("own") & F.col("breaks")).alias("breaks"), F.count_if(F.col("own") & F.col("breaks") & near).alias("coincident"), F.count_if(~F.col("own")).alias("pairs"), F.count_if(~F.col("own") & F.col("breaks")).alias("pair_breaks"), F.first("break_day").alias("break_day"))  # one row
    return counts.withColumn("verdict", F.expr(VERDICT))


@query("t19_break_attribution", f"{ATTRIBUTION} SELECT *, {VERDICT} AS verdict FROM a")
def t19(spark, d):
    return attribution(spark, d)


#: Verdicts hold from the third day running on; the days from the break to the last one are no truth.
LATCH = f"x AS (SELECT day, avg(v) AS v FROM (SELECT us // {DAY_US} AS day, value AS v FROM e) GROUP BY 1), m AS (SELECT day, v > median(v) OVER () AS hit FROM x), i AS (SELECT day, day - row_number() OVER (ORDER BY day) AS run FROM m WHERE hit), l AS (SELECT run, min(day) AS first_day, max(day) AS last_day, count(*) AS days FROM i GROUP BY 1 HAVING count(*) >= 3)"


@query("pf14_truth_quarantine", f"WITH {BASE}, {LATCH}, q AS (SELECT max_by(first_day, last_day) AS a, max(last_day) AS b FROM l) SELECT valid, round(CASE WHEN valid // 24 BETWEEN a AND b THEN NULL ELSE y END, 6) AS y FROM truth LEFT JOIN q ON true")
def pf14(spark, d):
    """Truths of the last latched run of days, three or more in a row over the median, are null. Days are a few thousand rows a decade."""
    day = events(spark, d).groupBy(F.floor(F.col("us") / DAY_US).cast("long").alias("day")).agg(F.avg("value").alias("v"))
    hit = day.crossJoin(F.broadcast(day.agg(F.median("v").alias("m")))).where("v > m")  # one row
    run = P.numbered(hit, "day", 365).withColumn("run", F.col("day") - F.col("__number")).groupBy("run").agg(F.min("day").alias("first"), F.max("day").alias("last"), F.count("*").alias("n")).where("n >= 3")
    last = run.agg(F.max_by("first", "last").alias("a"), F.max("last").alias("b"))
    inside = F.coalesce((F.floor(F.col("valid") / 24)).between(F.col("a"), F.col("b")), F.lit(False))
    return relations(spark, d)[2].crossJoin(F.broadcast(last)).select("valid", r6(F.when(~inside, F.col("y")), "y"))  # one row


@query("t20_inversion_days", f"""WITH {E}, st AS (SELECT us // {DAY_US} AS day, user_id % 9 AS st, avg(value) AS t FROM e WHERE hour(ts) BETWEEN 16 AND 23 GROUP BY 1, 2), l AS (SELECT day, regr_slope(t, st * 0.1) AS slope, count(*) AS k FROM st GROUP BY 1 HAVING count(DISTINCT st) >= 4)
SELECT day, round(slope - 6.5, 5) AS lapse, slope - 6.5 >= 0 AS inversion FROM l""")
def t20i(spark, d):
    return inversions(spark, d).select("day", F.round("lapse", 5).alias("lapse"), "inversion")


def inversions(spark, d):
    """Days on which temperatures, already put to one elevation, still rise with it by more than the lapse: stations are a tenth of a km apart."""
    e = events(spark, d).where(F.hour("ts").between(16, 23))
    st = e.groupBy(F.floor(F.col("us") / DAY_US).cast("long").alias("day"), (F.col("user_id") % 9).alias("st")).agg(F.avg("value").alias("t"))
    fit = st.groupBy("day").agg((F.regr_slope("t", F.col("st") * 0.1) - 6.5).alias("lapse"), F.count_distinct("st").alias("k")).where("k >= 4")
    return fit.withColumn("inversion", F.col("lapse") >= 0)


@query("ag12_daily_drift", f"""WITH {E}, st AS (SELECT us // {DAY_US} AS day, user_id % 9 AS st, avg(value) AS t FROM e WHERE hour(ts) BETWEEN 16 AND 23 GROUP BY 1, 2), inv AS (SELECT day FROM st GROUP BY 1 HAVING count(DISTINCT st) >= 4 AND regr_slope(t, st * 0.1) >= 6.5),
h AS (SELECT us // 3600000000 AS hour, avg(value) FILTER (event_type = 'click') AS a, avg(value) FILTER (event_type = 'view') AS b FROM e WHERE hour(ts) BETWEEN 14 AND 23 GROUP BY 1)
SELECT hour // 24 AS day, round(median(a - b), 6) AS diff, count(*) AS hours FROM h WHERE a IS NOT NULL AND b IS NOT NULL AND hour // 24 NOT IN (SELECT day FROM inv) GROUP BY 1 HAVING count(*) >= 6""")
def ag12(spark, d):
    """The daytime median difference of two stations on days of six hours at least, without inversion days."""
    pick = lambda t: F.avg(F.when(F.col("event_type") == t, F.col("value")))
    h = events(spark, d).where(F.hour("ts").between(14, 23)).groupBy(F.floor(F.col("us") / 3_600_000_000).cast("long").alias("hour")).agg(pick("click").alias("a"), pick("view").alias("b")).where("a is not null and b is not null")
    by_day = h.groupBy(F.floor(F.col("hour") / 24).cast("long").alias("day")).agg(r6(F.median(F.col("a") - F.col("b")), "diff"), F.count("*").alias("hours")).where("hours >= 6")
    return by_day.join(inversions(spark, d).where("inversion").select("day"), "day", "left_anti")


SHIELD = "f AS (SELECT l_returnflag AS station, count(*) AS n, regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept, sqrt(greatest((regr_syy(y, x) - regr_slope(y, x) ** 2 * regr_sxx(y, x)) / greatest(count(*) - 2, 1) / regr_sxx(y, x), 0)) AS se FROM s GROUP BY 1)"


@query("t21_shield_error", f"WITH s AS (SELECT l_returnflag, l_extendedprice / 1000 AS y, l_quantity * 20 / 1000 / (1 + greatest(l_discount * 10, 0)) AS x FROM lineitem WHERE l_quantity * 20 > 50), {SHIELD} SELECT station, n, round(slope, 5) AS slope, round(intercept, 5) AS intercept, round(se, 6) AS se, slope / se > 2 AS heats FROM f WHERE n >= 100")
def t21(spark, d):
    """What a shield adds with sun and without wind: a line through daytime residuals, its slope's standard error, and whether it is over twice that."""
    toa = F.col("l_quantity") * 20
    rows = read(spark, d, "lineitem").where(toa > 50).select(F.col("l_returnflag").alias("station"), (F.col("l_extendedprice") / 1000).alias("y"), S.solar_load(toa, F.col("l_discount") * 10).alias("x"))
    fit = rows.groupBy("station").agg(F.count("*").alias("n"), F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"), F.regr_syy("y", "x").alias("syy"), F.regr_sxx("y", "x").alias("sxx")).where("n >= 100")
    rest = (F.col("syy") - F.col("slope") * F.col("slope") * F.col("sxx")) / F.greatest(F.col("n") - 2, F.lit(1))
    fit = fit.withColumn("se", F.sqrt(F.greatest(F.try_divide(rest, F.col("sxx")), F.lit(0.0))))
    return fit.select("station", "n", F.round("slope", 5).alias("slope"), F.round("intercept", 5).alias("intercept"), r6(F.col("se"), "se"), (F.try_divide(F.col("slope"), F.col("se")) > 2).alias("heats"))


@query("sc11_solar_load", "SELECT l_orderkey, l_linenumber, round(l_quantity / 1000 / (1 + greatest(l_discount - 0.05, 0)), 9) AS load FROM lineitem")
def sc11(spark, d):
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(S.solar_load(F.col("l_quantity"), F.col("l_discount") - 0.05), 9).alias("load"))


@query("t11_e_bh", "WITH p AS (SELECT l_returnflag AS g, l_partkey AS k, CASE WHEN l_partkey % 7 > 0 THEN 0.5 + (sum(l_quantity) * 37) % 1009 END AS e FROM lineitem GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY e DESC NULLS LAST) AS rk, count(e) OVER (PARTITION BY g) AS n FROM p), b AS (SELECT g, coalesce(max(rk) FILTER (rk * e / n >= 10), 0) AS best FROM r GROUP BY 1), t AS (SELECT g, best, min(e) FILTER (rk = best) AS bar FROM r JOIN b USING (g) GROUP BY 1, 2) SELECT g, k, coalesce(e >= bar, false) AS discovery, round(n / (0.1 * greatest(best, 1)), 6) AS threshold FROM r JOIN t USING (g)")
def t11e(spark, d):
    rows = read(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("g"), F.col("l_partkey").alias("k")).agg(F.sum("l_quantity").alias("q"))
    rows = rows.select("g", "k", F.when(F.col("k") % 7 > 0, 0.5 + (F.col("q") * 37) % 1009).alias("e"))
    return I.e_benjamini_hochberg(rows, "e", ["g"], 0.1).select("g", "k", "discovery", r6(F.col("threshold"), "threshold"))


REFERENCES = ["best_provider", "damped_grounded_equal_weight", "equal_weight"]
CANDIDATES = [*REFERENCES, "grounded_equal_weight", "inverse_mse"]


def contest(spark, d):
    """Predictions of references and candidates."""
    return settled(board(spark, d, CANDIDATES), "contest")  # the board and the losses both read it


def eligible(rows, by):
    """Methods that may be promoted: on four fifths of their cases, eight of them, and eight valid times."""
    e = F.abs(F.col("p") - F.col("y"))
    board = rows.groupBy(*by, "method").agg(F.count("p").alias("n"), F.count_distinct("valid").alias("times"), (F.count("p") / F.count("*")).alias("coverage"), r6(F.avg(e), "mae"))
    return board.where("coverage >= 0.8 and n >= 8 and times >= 8").select(*by, "method", "mae")


def decided(spark, d, rule):
    rows = contest(spark, d)
    losses = I.collapsed(rows.where("p is not null"), ["bucket"])
    return I.gated(losses, eligible(rows, ["bucket"]), ["bucket"], REFERENCES, rule)


@query("t9_mcs_gate")
def t9m(spark, d):
    return decided(spark, d, "mcs")


@query("t9_sequential_gate")
def t9s(spark, d):
    return decided(spark, d, "sequential")


@query("t9_legacy_gate")
def t9l(spark, d):
    return decided(spark, d, "legacy")


@query("t10_pooled_mcs_gate")
def t10m(spark, d):
    """The gate on the far buckets together, for decisions that each alone has too few times for."""
    rows = contest(spark, d).where(F.col("bucket").isin("12-24h", "24-48h", "48-96h")).withColumn("bucket", F.lit("pooled_12h+"))
    return I.gated(I.collapsed(rows.where("p is not null"), ["bucket"]), eligible(rows, ["bucket"]), ["bucket"], REFERENCES)


@query("t12_blocked_promotions")
def t12(spark, d):
    """Slices that serve something over 15 % worse than what leads them, and what held the leader."""
    won = decided(spark, d, "mcs").where("gate is not null")
    gap = F.try_divide(F.col("winner_mae"), F.col("candidate_mae")) - 1
    return won.withColumn("gap", gap).where((F.col("gap") > 0.15) | (F.col("gap").isNull() & (F.col("winner_mae") > F.col("candidate_mae")))).select("bucket", "candidate", "winner", "gate", r6(F.col("gap"), "gap"))


#: A fold's scores are an evaluation, made when its last issue is; those of odd folds know no references.
ODD_FOLDS = "grounded_equal_weight"


def evaluations(spark, d):
    """A log of evaluations out of the contest's folds."""
    rows = contest(spark, d)
    made = rows.groupBy("fold").agg(F.max("issue").alias("created"))
    log = rows.join(made, "fold").withColumn("evaluation", F.concat(F.lit("fold-"), F.lpad(F.col("fold").cast("string"), 3, "0")))
    return log.where((F.col("fold") % 2 == 0) | (F.col("method") == ODD_FOLDS))


@query("b8_newest_evaluations", f"""WITH {BASE}, {BIAS}, {MEAN.format(rows='test').replace('pred AS', 'pe AS')}, {MEAN.format(rows='gtest').replace('pred AS', 'pg AS')}, al AS (SELECT 'equal_weight' AS method, * FROM pe UNION ALL SELECT 'grounded_equal_weight', * FROM pg),
log AS (SELECT al.*, 'fold-' || lpad(fold::VARCHAR, 3, '0') AS evaluation, max(issue) OVER (PARTITION BY fold) AS created FROM al WHERE fold % 2 = 0 OR method = 'grounded_equal_weight'),
ev AS (SELECT bucket, evaluation, max(created) AS created, count(DISTINCT method) FILTER (method = 'equal_weight') AS refs FROM log GROUP BY ALL), w AS (SELECT bucket, arg_max(evaluation, (created, evaluation)) AS evaluation FROM ev WHERE refs = 1 GROUP BY 1)
SELECT bucket, method, evaluation, count(p) AS n, round(avg(abs(p - y)), 6) AS mae FROM log JOIN w USING (bucket, evaluation) GROUP BY ALL""")
def b8n(spark, d):
    """The methods of each slice's newest evaluation that has the reference, among evaluations that may lack it."""
    rows = pair(spark, d)
    made = rows.groupBy("fold").agg(F.max("issue").alias("created"))
    log = rows.join(made, "fold").withColumn("evaluation", F.concat(F.lit("fold-"), F.lpad(F.col("fold").cast("string"), 3, "0")))
    log = settled(log.where((F.col("fold") % 2 == 0) | (F.col("method") == ODD_FOLDS)), "log")
    every = R.board(R.newest_complete(log, ["bucket"], ["equal_weight"]), ["bucket"])
    return every.select("bucket", "method", "evaluation", "n", r6(F.col("mae"), "mae"))


@query("b8_release_mint")
def b8(spark, d):
    """The release after the newest evaluations: of each slice the gate's winner on its newest complete evaluation, or the incumbent of the release before within a standard error; the fallback where the last fortnight did half as badly again as promised; equal weight for the first hour by a pin."""
    log = settled(evaluations(spark, d), "log")
    by, last = ["bucket"], log.agg(F.max("created").alias("m"))
    older = log.crossJoin(F.broadcast(last)).where("created < m").drop("m")  # one row
    before = R.decided(older, by, REFERENCES).select("bucket", F.col("method").alias("incumbent"))
    live = R.pooled_live(log.crossJoin(F.broadcast(log.agg(F.max("valid").alias("now")))), by, F.col("now"))  # one row
    pins = spark.createDataFrame([("0-1h", R.FALLBACK)], "bucket string, pin string")
    release = R.minted(settled(R.decided(log, by, REFERENCES, incumbents=before, pins=pins, live=live), "decisions"), by, 0)
    return release.select("bucket", "method", "reason", "n", r6(F.col("mae"), "mae"), "evaluation", "retained", "pinned", "release_id")


@query("b7_served_methods")
def b7s(spark, d):
    """How many rows of each slice a method serves: that of the release, if it may serve there, else equal weight, degraded. The damped method may not serve the first hours."""
    log = settled(evaluations(spark, d), "log")
    release = R.decided(log, ["bucket"], REFERENCES)
    slices = log.select("bucket").distinct()
    able = slices.crossJoin(F.broadcast(log.select("method").distinct())).where("not (method = 'damped_grounded_equal_weight' and bucket in ('0-1h', '1-3h'))")  # a row a method
    rows = log.select("issue", "valid", "bucket").distinct()
    return R.method_of(rows, release, ["bucket"], supported=able).groupBy("bucket", "method", "reason", "degraded").agg(F.count("*").alias("n"))


@query("b17_observability", f"""WITH {BASE}, {BIAS}, {MEAN.format(rows='test').replace('pred AS', 'pe AS')}, {MEAN.format(rows='gtest').replace('pred AS', 'pg AS')}, al AS (SELECT 'equal_weight' AS method, * FROM pe UNION ALL SELECT 'grounded_equal_weight', * FROM pg)
SELECT method, 'hourly' AS product, 'value' AS variable, max(issue)::BIGINT AS issue, count(*)::DOUBLE AS n, count(*) FILTER (p IS NULL)::DOUBLE AS missing, round(avg(p), 6) AS mean, max(lead)::DOUBLE AS longest FROM al GROUP BY method""")
def b17(spark, d):
    """What is known of the run that served each method: metrics taken while its rows were written, read back from where they are kept."""
    folder = f"{session_dir(spark)}/observed-{uuid.uuid4().hex}"
    rows = settled(pair(spark, d), "served")
    for method in ("equal_weight", "grounded_equal_weight"):
        own = rows.where(F.col("method") == method)
        issue = own.agg(F.max("issue")).first()[0]
        metrics = {"n": F.count("*"), "missing": F.count_if(F.col("p").isNull()), "mean": F.avg("p"), "longest": F.max("lead")}
        write = lambda out, m=method: out.write.parquet(f"{folder}/served/method={m}")
        O.measured(own, write, metrics, {"method": method, "product": "hourly", "variable": "value", "issue": issue}, f"{folder}/seen", trajectory=method != "equal_weight")
    seen = O.snapshots(spark, f"{folder}/seen")
    return seen.select("method", "product", "variable", "issue", O.metric("n").alias("n"), O.metric("missing").alias("missing"), r6(O.metric("mean"), "mean"), O.metric("longest").alias("longest"))


@query("t13_winners_curse")
def t13(spark, d):
    """By bucket: how much the least mean loss is too low by being chosen, from valid times resampled in blocks, and the median-unbiased value with its bound."""
    losses = I.collapsed(contest(spark, d).where("p is not null"), ["bucket"])

    def run(key, pdf):
        wide = pdf.pivot_table(index="valid", columns="method", values="loss").dropna().sort_index().to_numpy()
        if len(wide) < 8 or wide.shape[1] < 2:
            return pd.DataFrame(columns=range(6))
        best = wide.mean(axis=0).min()
        both = I.median_unbiased(wide) or (np.nan, np.nan)
        return pd.DataFrame([[key[0], len(wide), float(best), float(best - I.chosen_bias(wide)), *map(float, both)]])

    return losses.groupBy("bucket").applyInPandas(run, "bucket string, n long, winner_mae double, corrected_mae double, hybrid_mae double, hybrid_upper double")


@query("t8_e_process")
def t8(spark, d):
    """The bettor's wealth on equal weight's loss over the grounded one's, by bucket: the first half of the times, then the rest from the stored state."""
    differences = I.loss_differences(I.collapsed(pair(spark, d), ["bucket"]), ["bucket"], "equal_weight", "grounded_equal_weight")
    middle = differences.agg(F.expr("percentile(valid, 0.5)").alias("m"))
    first = differences.crossJoin(F.broadcast(middle)).where("valid <= m").drop("m")  # one row
    nothing = spark.createDataFrame([], f"bucket string, {I.WEALTH}")
    state = I.advanced_wealth(first, nothing, ["bucket"], "v1")
    return I.advanced_wealth(differences, state, ["bucket"], "v1").select("bucket", r6(F.col("log_e"), "log_e"))


@query("ag16_alignment", f"""WITH {E}, h AS (SELECT us // 3600000000 AS hour, avg(value) AS m, avg(value) FILTER (us % 3600000000 < 600000000) AS i FROM e GROUP BY 1), f AS (SELECT us // 3600000000 + 1 AS hour, event_type AS source, avg(value) AS x FROM e GROUP BY 1, 2),
c AS (SELECT source, count(*) AS n, corr(x, m) AS r_mean, corr(x, i) AS r_inst FROM f JOIN h USING (hour) WHERE i IS NOT NULL GROUP BY 1), p AS (SELECT *, CASE WHEN n >= 72 THEN CASE WHEN r_inst >= r_mean THEN 'instantaneous' ELSE 'interval_mean' END END AS preferred FROM c),
w AS (SELECT CASE WHEN coalesce(sum(n) FILTER (preferred = 'interval_mean'), 0) > coalesce(sum(n) FILTER (preferred = 'instantaneous'), 0) THEN 'interval_mean' ELSE 'instantaneous' END AS recommended FROM p)
SELECT source, n, CASE WHEN n >= 72 THEN round(r_mean, 6) END AS r_mean, CASE WHEN n >= 72 THEN round(r_inst, 6) END AS r_inst, preferred, recommended FROM p, w""")
def ag16(spark, d):
    """Which semantics each source goes with better, and what the majority by cases says."""
    e = events(spark, d).withColumn("hour", F.floor(F.col("us") / 3_600_000_000).cast("long"))
    h = e.groupBy("hour").agg(F.avg("value").alias("m"), F.avg(F.when(F.col("us") % 3_600_000_000 < 600_000_000, F.col("value"))).alias("i"))
    f = e.groupBy((F.col("hour") + 1).alias("hour"), F.col("event_type").alias("source")).agg(F.avg("value").alias("x"))
    enough = lambda c: F.when(F.col("n") >= 72, F.col(c)).alias(c)
    c = f.join(h, "hour").where("i is not null").groupBy("source").agg(F.count("*").alias("n"), P.safe_correlation("x", "m").alias("r_mean"), P.safe_correlation("x", "i").alias("r_inst")).select("source", "n", enough("r_mean"), enough("r_inst"))
    c = c.withColumn("preferred", F.when(F.col("r_inst") >= F.col("r_mean"), "instantaneous").when(F.col("r_inst") < F.col("r_mean"), "interval_mean"))
    votes = lambda s: F.coalesce(F.sum(F.when(F.col("preferred") == s, F.col("n"))), F.lit(0))
    majority = c.agg(F.when(votes("interval_mean") > votes("instantaneous"), "interval_mean").otherwise("instantaneous").alias("recommended"))
    return c.crossJoin(F.broadcast(majority)).select("source", "n", r6(F.col("r_mean"), "r_mean"), r6(F.col("r_inst"), "r_inst"), "preferred", "recommended")  # one row
