"""Queries on forecasts: as-of selection, matrices, and every method's out-of-fold errors."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import matrix as M
from ..operators import methods as X
from ..operators import temporal as P
from ..operators.foldsums import Folds
from ..operators.truth import HOUR
from ..sources.scratch import dealt, settled
from .base import E, events, query, r6

LEADS, CAP, INITIAL, STEP = 48, 12, 240, 120
BUCKET = "CASE " + " ".join(f"WHEN lead >= {a} AND lead < {b} THEN '{n}'" for a, b, n in S.LEAD_EDGES["hourly"][:7]) + " END"

BASE = f"""{E},
cyc AS (SELECT event_type AS source, us // 3600000000 AS fetched, avg(value) AS v FROM e GROUP BY 1, 2),
fx AS (SELECT source, fetched, fetched + l AS valid, v * (1 + l / 97.0) AS x FROM cyc, generate_series(1, {LEADS}) AS g(l)),
truth AS (SELECT us // 3600000000 AS valid, avg(value) AS y FROM e GROUP BY 1),
snaps AS (SELECT DISTINCT us // 3600000000 AS issue FROM e),
sel AS (SELECT issue, source, max(fetched) AS fetched FROM snaps JOIN cyc ON fetched <= issue AND issue - fetched <= {CAP} GROUP BY 1, 2),
matrix AS (SELECT *, {BUCKET} AS bucket FROM (SELECT issue, valid, valid - issue AS lead, source, x, y FROM sel JOIN fx USING (source, fetched) LEFT JOIN truth USING (valid) WHERE valid >= issue)),
folds AS (SELECT k::INTEGER AS fold, lo + {INITIAL} + {STEP} * k AS origin FROM (SELECT min(issue) AS lo, max(issue) AS hi FROM matrix), range(0, 100) AS r(k) WHERE lo + {INITIAL} + {STEP} * k < hi),
train AS (SELECT fold, m.* FROM matrix m JOIN folds ON valid + 2 <= origin WHERE y IS NOT NULL),
test AS (SELECT fold, m.* FROM matrix m JOIN folds ON issue > origin AND issue <= origin + {STEP} WHERE y IS NOT NULL)"""

#: Bias tables and corrected rows, as templates over the aggregate.
GROUND = """lb AS (SELECT fold, source, bucket, count(*) AS n, {agg} AS b FROM train GROUP BY ALL), gb AS (SELECT fold, source, {agg} AS g FROM train GROUP BY ALL),
gtest AS (SELECT t.* REPLACE (t.x + coalesce(coalesce(n / (n + 6.0), 0) * coalesce(b, g) + (1 - coalesce(n / (n + 6.0), 0)) * g, 0) AS x) FROM test t LEFT JOIN gb USING (fold, source) LEFT JOIN lb USING (fold, source, bucket)),
gtrain AS (SELECT t.* REPLACE (t.x + coalesce(coalesce(n / (n + 6.0), 0) * coalesce(b, g) + (1 - coalesce(n / (n + 6.0), 0)) * g, 0) AS x) FROM train t LEFT JOIN gb USING (fold, source) LEFT JOIN lb USING (fold, source, bucket))"""
BIAS = GROUND.format(agg="avg(y - x)")
MEAN = "pred AS (SELECT fold, issue, valid, lead, bucket, any_value(y) AS y, avg(x) AS p FROM {rows} GROUP BY ALL)"
SCORE = "SELECT fold, bucket, count(*) AS n, round(avg(abs(p - y)), 6) AS mae, round(sqrt(avg((p - y) ** 2)), 6) AS rmse, round(avg(p - y), 6) AS bias FROM pred WHERE p IS NOT NULL GROUP BY 1, 2"
CELL = "fold, issue, valid, lead, bucket"


def relations(spark, d):
    """Cycles, forecasts, truth and snapshots out of events, in whole hours."""
    e = events(spark, d).withColumn("h", F.floor(F.col("us") / HOUR).cast("long"))
    cycles = e.groupBy(F.col("event_type").alias("source"), F.col("h").alias("fetched")).agg(F.avg("value").alias("v"))
    forecasts = cycles.withColumn("l", F.explode(F.sequence(F.lit(1), F.lit(LEADS)))).select("source", "fetched", (F.col("fetched") + F.col("l")).alias("valid"), (F.col("v") * (1 + F.col("l") / 97.0)).alias("x"))
    truth = e.groupBy(F.col("h").alias("valid")).agg(F.avg("value").alias("y"))
    snapshots = e.select(F.col("h").alias("issue")).distinct()
    return cycles, forecasts, truth, snapshots


def matrix(spark, d):
    cycles, forecasts, truth, snapshots = relations(spark, d)
    return M.matrix(M.as_of_selection(snapshots, cycles, CAP), forecasts, truth)


def split(spark, d):
    rows = settled(matrix(spark, d), "matrix")  # fits, corrections and predictions all read it
    return M.train_test(rows, M.fold_origins(rows, INITIAL, STEP), STEP)


def folds(spark, d):
    """The same folds for fits that are sums over steps."""
    rows = settled(dealt(matrix(spark, d), "issue"), "matrix")
    return Folds(rows, M.fold_origins(rows, INITIAL, STEP), STEP)


def observed(spark, d):
    """What is known at an issue: the hour's truth."""
    return relations(spark, d)[2].select(F.col("valid").alias("issue"), F.col("y").alias("obs"))


def score(pred, *by):
    e = F.col("p") - F.col("y")
    return pred.where("p is not null").groupBy(*by, "fold", "bucket").agg(F.count("*").alias("n"), r6(F.avg(F.abs(e)), "mae"), r6(F.sqrt(F.avg(e * e)), "rmse"), r6(F.avg(e), "bias"))


@query("j1_asof_selection", f"WITH {BASE} SELECT issue, source, fetched FROM sel")
def j1(spark, d):
    cycles, _, _, snapshots = relations(spark, d)
    return M.as_of_selection(snapshots, cycles, CAP).select("issue", "source", "fetched")


@query("j2_observation_at_issue", f"WITH {E}, s AS (SELECT DISTINCT us // 3600000000 * 3600000000 AS issue FROM e), o AS (SELECT us, max_by(value, event_id) AS value FROM e GROUP BY us) SELECT issue, round(CASE WHEN issue - us <= 1800000000 THEN value END, 6) AS obs FROM s ASOF LEFT JOIN o ON issue >= us")
def j2(spark, d):
    e = events(spark, d)
    snaps = e.select((F.floor(F.col("us") / HOUR) * HOUR).cast("long").alias("issue")).distinct()
    obs = e.groupBy("us").agg(F.max_by("value", "event_id").alias("obs"))
    return P.asof_join(snaps, obs, "issue", "us", [], 1_800_000_000, ["obs"], width=24 * HOUR).select("issue", r6(F.col("obs"), "obs"))


@query("j3_trend", f"WITH {E}, a AS (SELECT event_id, event_type, us, value, us - 600000000 AS t FROM e), o AS (SELECT event_type, us, max_by(value, event_id) AS old FROM e GROUP BY 1, 2) SELECT event_id, round(CASE WHEN t - o.us <= 7200000000 THEN value - old END, 6) AS trend FROM a ASOF LEFT JOIN o ON a.event_type = o.event_type AND t >= o.us")
def j3(spark, d):
    e = events(spark, d)
    left = e.select("event_id", "event_type", "value", (F.col("us") - 600_000_000).alias("t"))
    right = e.groupBy("event_type", "us").agg(F.max_by("value", "event_id").alias("old"))
    return P.asof_join(left, right, "t", "us", ["event_type"], 7_200_000_000, ["old"]).select("event_id", r6(F.col("value") - F.col("old"), "trend"))


@query("j4_matrix", f"WITH {BASE} SELECT issue, valid, lead, bucket, source, round(x, 6) AS x, round(y, 6) AS y FROM matrix")
def j4(spark, d):
    return matrix(spark, d).select("issue", "valid", F.col("lead").cast("long").alias("lead"), "bucket", "source", r6(F.col("x"), "x"), r6(F.col("y"), "y"))


@query("rs1_pivot", f"WITH {BASE} SELECT issue, valid, " + ", ".join(f"round(max(x) FILTER (source = '{s}'), 6) AS fx_{s}" for s in ("click", "view", "purchase")) + " FROM matrix GROUP BY 1, 2")
def rs1(spark, d):
    wide = matrix(spark, d).groupBy("issue", "valid").pivot("source", ["click", "view", "purchase"]).agg(F.max("x"))
    return wide.select("issue", "valid", *[r6(F.col(s), f"fx_{s}") for s in ("click", "view", "purchase")])


@query("rs2_unpivot", f"WITH {BASE}, w AS (SELECT issue, max(x) AS hi, min(x) AS lo FROM matrix GROUP BY 1) SELECT issue, 'hi' AS stat, round(hi, 6) AS value FROM w UNION ALL SELECT issue, 'lo', round(lo, 6) FROM w")
def rs2(spark, d):
    w = matrix(spark, d).groupBy("issue").agg(r6(F.max("x"), "hi"), r6(F.min("x"), "lo"))
    return w.unpivot("issue", ["hi", "lo"], "stat", "value")


@query("ag8_ages", f"WITH {BASE} SELECT issue, source, (issue - fetched)::BIGINT AS age FROM sel")
def ag8(spark, d):
    return matrix(spark, d).select("issue", "source", (F.col("issue") - F.col("fetched")).alias("age")).distinct()


@query("ag9_daily_aggregates", f"""WITH {BASE}, c AS (SELECT issue, valid, avg(x) AS m FROM matrix GROUP BY 1, 2)
SELECT issue, valid // 24 AS day, round(max(m), 6) AS high, round(min(m), 6) AS low, round(coalesce(sum(m), 0), 6) AS total, round(count(m) / 24.0, 6) AS coverage FROM c GROUP BY 1, 2""")
def ag9(spark, d):
    cells = matrix(spark, d).groupBy("issue", "valid").agg(F.avg("x").alias("m"))
    return cells.groupBy("issue", F.floor(F.col("valid") / 24).cast("long").alias("day")).agg(r6(F.max("m"), "high"), r6(F.min("m"), "low"), r6(F.coalesce(F.sum("m"), F.lit(0.0)), "total"), r6(F.count("m") / 24, "coverage"))


@query("ag10_source_daily", f"WITH {BASE} SELECT issue, source, valid // 24 AS day, round(max(x), 6) AS high, round(min(x), 6) AS low FROM matrix GROUP BY 1, 2, 3 HAVING count(*) / 24.0 >= 0.8")
def ag10(spark, d):
    g = matrix(spark, d).groupBy("issue", "source", F.floor(F.col("valid") / 24).cast("long").alias("day")).agg(F.count("*").alias("n"), r6(F.max("x"), "high"), r6(F.min("x"), "low"))
    return g.where("n / 24 >= 0.8").drop("n")


@query("b2_folds", f"WITH {BASE} SELECT fold, 'train' AS part, count(*) AS n, min(issue) AS lo, max(valid) AS hi FROM train GROUP BY 1 UNION ALL SELECT fold, 'test', count(*), min(issue), max(valid) FROM test GROUP BY 1")
def b2(spark, d):
    train, test = split(spark, d)
    parts = train.select("fold", "issue", "valid", F.lit("train").alias("part")).unionByName(test.select("fold", "issue", "valid", F.lit("test").alias("part")))
    return parts.groupBy("fold", "part").agg(F.count("*").alias("n"), F.min("issue").alias("lo"), F.max("valid").alias("hi"))


def registered(name: str, number: str, sql: str | None):
    def run(spark, d):
        return score(folds(spark, d).predicted([name]))

    query(f"{number}_{name}", sql and f"WITH {BASE}, {sql} {SCORE}")(run)


WEIGHTS = """{bias}, cnt AS (SELECT fold, bucket, count(DISTINCT (issue, valid)) AS n FROM gtrain GROUP BY ALL),
l0 AS (SELECT fold, bucket, source, count(*) AS k, avg(abs(x - y) ** {power}) AS loss FROM gtrain GROUP BY ALL), l1 AS (SELECT *, 1 / greatest(coalesce(CASE WHEN k >= 12 THEN loss END, max(CASE WHEN k >= 12 THEN loss END) OVER (PARTITION BY fold, bucket), 1), 1e-6) AS r FROM l0), l2 AS (SELECT fold, bucket, source, r / max(r) OVER (PARTITION BY fold, bucket) AS w FROM l1),
g0 AS (SELECT fold, source, count(*) AS k, avg(abs(x - y) ** {power}) AS loss FROM gtrain GROUP BY ALL), g1 AS (SELECT *, 1 / greatest(coalesce(CASE WHEN k >= 12 THEN loss END, max(CASE WHEN k >= 12 THEN loss END) OVER (PARTITION BY fold), 1), 1e-6) AS r FROM g0), g2 AS (SELECT fold, source, r / max(r) OVER (PARTITION BY fold) AS gw FROM g1),
ww AS (SELECT t.*, coalesce(coalesce(n / (n + 6.0), 0) * coalesce(w, gw) + (1 - coalesce(n / (n + 6.0), 0)) * gw, 1) AS w FROM gtest t LEFT JOIN g2 USING (fold, source) LEFT JOIN l2 USING (fold, bucket, source) LEFT JOIN cnt USING (fold, bucket)),
pred AS (SELECT fold, issue, valid, lead, bucket, any_value(y) AS y, sum(w * x) / sum(w) AS p FROM ww GROUP BY ALL)"""
TRIM = "pred AS (SELECT fold, issue, valid, lead, bucket, any_value(y) AS y, list_avg(list_sort(list(x))[floor(0.2 * count(x))::INTEGER + 1 : count(x) - floor(0.2 * count(x))::INTEGER]) AS p FROM {rows} GROUP BY ALL)"
EWMA = """bins AS (SELECT *, floor((valid % 24) / 3) AS bin FROM train), num AS (SELECT *, row_number() OVER (PARTITION BY fold, source, bucket, bin ORDER BY issue, valid) AS i, count(*) OVER (PARTITION BY fold, source, bucket, bin) AS n FROM bins),
eb AS (SELECT fold, source, bucket, bin, count(*) AS n, sum(0.05 * pow(0.95, n - i) * (x - y)) AS b FROM num GROUP BY fold, source, bucket, bin),
etest AS (SELECT t.* REPLACE (x - coalesce(n / (n + 10.0) * b, 0) AS x) FROM (SELECT *, floor((valid % 24) / 3) AS bin FROM test) t LEFT JOIN eb USING (fold, source, bucket, bin)), etrain AS (SELECT t.* REPLACE (x - coalesce(n / (n + 10.0) * b, 0) AS x) FROM bins t LEFT JOIN eb USING (fold, source, bucket, bin))"""
AFFINE = """lv AS (SELECT fold, source, bucket, count(*) AS n, var_pop(x) * count(*) AS sxx, covar_pop(x, y) AS c, var_pop(x) AS v, avg(x) AS mx, avg(y) AS my FROM train GROUP BY ALL), gv AS (SELECT fold, source, var_pop(x) * count(*) AS sxx, covar_pop(x, y) AS c, var_pop(x) AS v, avg(x) AS mx, avg(y) AS my FROM train GROUP BY ALL),
la AS (SELECT fold, source, bucket, n, CASE WHEN sxx >= 1e-9 AND abs(c / v) <= 5 THEN c / v ELSE 1 END AS s, CASE WHEN sxx >= 1e-9 AND abs(c / v) <= 5 THEN my - c / v * mx ELSE 0 END AS i FROM lv), ga AS (SELECT fold, source, CASE WHEN sxx >= 1e-9 AND abs(c / v) <= 5 THEN c / v ELSE 1 END AS gs, CASE WHEN sxx >= 1e-9 AND abs(c / v) <= 5 THEN my - c / v * mx ELSE 0 END AS gi FROM gv),
afx AS (SELECT t.*, coalesce(n / (n + 6.0), 0) AS w, s, i, gs, gi FROM test t LEFT JOIN ga USING (fold, source) LEFT JOIN la USING (fold, source, bucket)),
ax AS (SELECT fold, issue, valid, lead, bucket, y, coalesce(w * coalesce(i, gi) + (1 - w) * gi, 0) + coalesce(w * coalesce(s, gs) + (1 - w) * gs, 1) * x AS x FROM afx)"""
BEST = """lm AS (SELECT fold, source, bucket, count(*) AS n, avg(abs(x - y)) AS m FROM train GROUP BY ALL), gm AS (SELECT fold, source, avg(abs(x - y)) AS g FROM train GROUP BY ALL),
pred AS (SELECT fold, issue, valid, lead, bucket, any_value(y) AS y, arg_min(x, (coalesce(CASE WHEN n >= 24 THEN m END, g, 1e300), source)) AS p FROM test LEFT JOIN gm USING (fold, source) LEFT JOIN lm USING (fold, source, bucket) GROUP BY ALL)"""
BASEP = """ptrain AS (SELECT fold, issue, valid, lead, bucket, any_value(y) AS y, avg(x) AS p FROM gtrain GROUP BY ALL), ptest AS (SELECT fold, issue, valid, lead, bucket, any_value(y) AS y, avg(x) AS p FROM gtest GROUP BY ALL)"""
DAMP = f"""{BIAS}, {BASEP}, cl AS (SELECT fold, valid % 24 AS hod, avg(y) AS c FROM train GROUP BY ALL),
tr AS (SELECT t.*, c, k FROM ptrain t JOIN cl ON cl.fold = t.fold AND hod = valid % 24, range(0, 21) AS r(k)), er AS (SELECT fold, bucket, k, count(*) AS n, round(avg(abs(c + k / 20.0 * (p - c) - y)), 9) AS m FROM tr GROUP BY ALL),
bs AS (SELECT fold, bucket, any_value(n) AS n, arg_min(k, (m, -k)) AS k FROM er GROUP BY ALL),
pred AS (SELECT t.* REPLACE (c + coalesce((n * k / 20.0 + 6) / (n + 6.0), 1) * (p - c) AS p) FROM ptest t JOIN cl ON cl.fold = t.fold AND hod = valid % 24 LEFT JOIN bs ON bs.fold = t.fold AND bs.bucket = t.bucket)"""

registered("equal_weight", "e4", MEAN.format(rows="test"))
registered("grounded_equal_weight", "e7", f"{BIAS}, {MEAN.format(rows='gtest')}")
registered("affine_equal_weight", "e8", f"{AFFINE}, {MEAN.format(rows='ax')}")
registered("grounded_median_equal_weight", "e9", f"{GROUND.format(agg='median(y - x)')}, {MEAN.format(rows='gtest')}")
registered("best_provider", "e3", BEST)
registered("inverse_mse", "e10", WEIGHTS.format(bias=BIAS, power=2))
registered("inverse_mae", "e11", WEIGHTS.format(bias=BIAS, power=1))
registered("trimmed_mean", "e12", TRIM.format(rows="test"))
registered("grounded_trimmed_mean", "e13", f"{BIAS}, {TRIM.format(rows='gtest')}")
registered("ewma_grounded_equal_weight", "e14", f"{EWMA}, {MEAN.format(rows='etest')}")
registered("ewma_inverse_mae", "e15", f"{EWMA}, lw AS (SELECT fold, source, 1 / greatest(avg(abs(x - y)), 1e-6) AS w FROM etrain GROUP BY ALL), pred AS (SELECT fold, issue, valid, lead, bucket, any_value(y) AS y, sum(coalesce(w, 1) * x) / sum(coalesce(w, 1)) AS p FROM etest LEFT JOIN lw USING (fold, source) GROUP BY ALL)")
registered("damped_grounded_equal_weight", "e25", DAMP)

RESIDUAL = """p0 AS (SELECT fold, issue, arg_min(p, lead) AS p0 FROM {rows} WHERE lead < 6 GROUP BY ALL), r0 AS (SELECT p0.fold, p0.issue, o.y - p0 AS r0 FROM p0 JOIN truth o ON o.valid = p0.issue)"""


@query("e1_persistence", f"WITH {BASE}, pred AS (SELECT DISTINCT t.fold, t.issue, t.valid, t.bucket, t.y, o.y AS p FROM test t LEFT JOIN truth o ON o.valid = t.issue) {SCORE}")
def e1(spark, d):
    _, test = split(spark, d)
    return score(test.select(*X.CELL, "y").distinct().join(observed(spark, d), "issue", "left").withColumnRenamed("obs", "p"))


@query("e5_passthrough", f"WITH {BASE}, pred AS (SELECT fold, issue, valid, bucket, y, x AS p FROM test WHERE source = 'click') {SCORE}")
def e5(spark, d):
    return score(split(spark, d)[1].where("source = 'click'").withColumnRenamed("x", "p"))


def anchored_sql(base_ctes: str, taus=X.TAUS) -> str:
    w = "CASE " + " ".join(f"WHEN tau = {t} THEN CASE WHEN exp(-lead / {t}) >= 0.05 THEN exp(-lead / {t}) ELSE 0 END" for t in taus[1:]) + " ELSE 0 END"
    return f"""WITH {BASE}, {base_ctes},
ra AS (SELECT a.fold, a.issue, o.y - a.p0 AS r0 FROM (SELECT fold, issue, arg_min(p, lead) AS p0 FROM ptrain WHERE lead < 6 GROUP BY ALL) a JOIN truth o ON o.valid = a.issue), rb AS (SELECT a.fold, a.issue, o.y - a.p0 AS r0 FROM (SELECT fold, issue, arg_min(p, lead) AS p0 FROM ptest WHERE lead < 6 GROUP BY ALL) a JOIN truth o ON o.valid = a.issue),
tau AS (SELECT unnest([{', '.join(map(str, taus))}]) AS tau), er AS (SELECT fold, tau, round(avg((p + ({w}) * r0 - y) ** 2), 9) AS m FROM ptrain JOIN ra USING (fold, issue), tau GROUP BY ALL), bt AS (SELECT fold, arg_min(tau, (m, tau)) AS tau FROM er GROUP BY ALL),
pred AS (SELECT t.* REPLACE (p + ({w}) * coalesce(r0, 0) AS p) FROM ptest t LEFT JOIN rb USING (fold, issue) LEFT JOIN bt USING (fold)) {SCORE}"""


@query("e17_anchored_grounded_equal_weight", anchored_sql(f"{BIAS}, {BASEP}"))
def e17(spark, d):
    return score(X.anchored(*split(spark, d), observed(spark, d)))


@query("e20_anchored_ewma", anchored_sql(f"{EWMA}, " + BASEP.replace("gtrain", "etrain").replace("gtest", "etest")))
def e20(spark, d):
    return score(X.anchored(*split(spark, d), observed(spark, d), X.ewma_equal))


_head, _tail = WEIGHTS.split("ww AS")
#: The weighted base on test and on training rows.
WEIGHTED = f"{_head}wt AS{_tail.replace('ww', 'wt').replace('pred AS', 'ptest AS')}, wr AS{_tail.replace('ww', 'wr').replace('FROM gtest', 'FROM gtrain').replace('pred AS', 'ptrain AS')}"


@query("e18_anchored_inverse_mse", anchored_sql(WEIGHTED.format(bias=BIAS, power=2)))
def e18(spark, d):
    return score(X.anchored(*split(spark, d), observed(spark, d), X.inverse_mse))


SLOPE = f"""{BIAS}, {BASEP}, ra AS (SELECT a.fold, a.issue, o.y - a.p0 AS r0 FROM (SELECT fold, issue, arg_min(p, lead) AS p0 FROM ptrain WHERE lead < 6 GROUP BY ALL) a JOIN truth o ON o.valid = a.issue), rb AS (SELECT a.fold, a.issue, o.y - a.p0 AS r0 FROM (SELECT fold, issue, arg_min(p, lead) AS p0 FROM ptest WHERE lead < 6 GROUP BY ALL) a JOIN truth o ON o.valid = a.issue),
f AS (SELECT * FROM ptrain JOIN ra USING (fold, issue) WHERE r0 <> 0), ls AS (SELECT fold, bucket, count(*) AS n, greatest(-0.5, least(1.5, sum((y - p) * r0) / sum(r0 * r0))) AS s FROM f GROUP BY ALL), gs AS (SELECT fold, greatest(-0.5, least(1.5, sum((y - p) * r0) / sum(r0 * r0))) AS g FROM f GROUP BY ALL),
pred AS (SELECT t.* REPLACE (p + coalesce(coalesce(n / (n + 6.0), 0) * coalesce(s, g) + (1 - coalesce(n / (n + 6.0), 0)) * g, 0) * coalesce(r0, 0) AS p) FROM ptest t LEFT JOIN rb USING (fold, issue) LEFT JOIN gs USING (fold) LEFT JOIN ls USING (fold, bucket))"""


@query("e22_raft_grounded", f"WITH {BASE}, {SLOPE} {SCORE}")
def e22(spark, d):
    return score(X.residual_slope(*split(spark, d), observed(spark, d)))


@query("e2_climatology")
def e2(spark, d):
    return score(X.climatology(*split(spark, d)))


@query("e27_cluster_equal_weight")
def e27(spark, d):
    return score(X.clustered(*split(spark, d)))


@query("e41_sparse_shrink", f"WITH {BASE}, {BIAS}, {BASEP}, c AS (SELECT fold, bucket, count(*) AS n, avg(y) AS m FROM ptrain GROUP BY ALL), pred AS (SELECT t.* REPLACE (coalesce(n / (n + 2.0) * p + 2 / (n + 2.0) * m, p) AS p) FROM ptest t LEFT JOIN c USING (fold, bucket)) {SCORE}")
def e41(spark, d):
    return score(folds(spark, d).predicted(["sparse_shrink"]))


WINNERS = ("best_provider", "equal_weight", "grounded_equal_weight")


def board(spark, d, names):
    return folds(spark, d).predicted(list(names))


def backtest(spark, d, count: int = 45, names=tuple(X.METHODS)):
    """Errors of every method in each of so many folds and each bucket: fits out of sums over steps, and one pass over the test rows for all methods."""
    rows = settled(dealt(matrix(spark, d), "issue"), "matrix")
    low, high = rows.agg(F.min("issue"), F.max("issue")).first()
    step = max((high - low - INITIAL // 2) // count, 1)
    return score(Folds(rows, list(range(low + INITIAL // 2, high, step))[:count], step).predicted(list(names)), "method")


@query("leaderboard_winners", f"""WITH {BASE}, {BIAS}, {BEST.replace('pred AS', 'pb AS')}, {MEAN.format(rows='test').replace('pred AS', 'pe AS')}, {MEAN.format(rows='gtest').replace('pred AS', 'pg AS')},
al AS (SELECT 'best_provider' AS method, * FROM pb UNION ALL SELECT 'equal_weight', * FROM pe UNION ALL SELECT 'grounded_equal_weight', * FROM pg),
m AS (SELECT bucket, method, count(*) AS n, round(avg(abs(p - y)), 6) AS mae FROM al GROUP BY 1, 2)
SELECT bucket, arg_min(method, (mae, method)) AS winner, min(mae) AS mae, any_value(n) AS n FROM m GROUP BY 1""")
def winners(spark, d):
    m = board(spark, d, WINNERS).groupBy("bucket", "method").agg(F.count("*").alias("n"), r6(F.avg(F.abs(F.col("p") - F.col("y"))), "mae"))
    return m.groupBy("bucket").agg(F.min_by("method", F.struct("mae", "method")).alias("winner"), F.min("mae").alias("mae"), F.first("n").alias("n"))


@query("ag14_aggregate_board", f"""WITH {BASE}, {BIAS}, {MEAN.format(rows='test').replace('pred AS', 'pe AS')}, {MEAN.format(rows='gtest').replace('pred AS', 'pg AS')}, al AS (SELECT 'equal_weight' AS method, * FROM pe UNION ALL SELECT 'grounded_equal_weight', * FROM pg)
SELECT method, bucket, count(*) AS n, round(avg(abs(p - y)), 6) AS mae, round(sqrt(avg((p - y) ** 2)), 6) AS rmse FROM al GROUP BY ROLLUP (method, bucket)""")
def ag14(spark, d):
    e = F.col("p") - F.col("y")
    return board(spark, d, WINNERS[1:]).rollup("method", "bucket").agg(F.count("*").alias("n"), r6(F.avg(F.abs(e)), "mae"), r6(F.sqrt(F.avg(e * e)), "rmse"))


@query("w8_seamless_fill", f"WITH {BASE} SELECT issue, source, valid, round(last_value(CASE WHEN lead % 4 = 0 THEN x END IGNORE NULLS) OVER (PARTITION BY issue, source ORDER BY lead ROWS UNBOUNDED PRECEDING), 6) AS filled FROM matrix")
def w8s(spark, d):
    rows = matrix(spark, d).withColumn("v", F.when(F.col("lead") % 4 == 0, F.col("x")))
    return rows.select("issue", "source", "valid", r6(P.forward_filled("v", ["issue", "source"], "lead"), "filled"))


@query("w9_anchor_rows", f"WITH {BASE} SELECT issue, source, arg_min(valid, lead) AS valid, round(arg_min(x, lead), 6) AS x FROM matrix WHERE lead < 6 AND y IS NOT NULL GROUP BY 1, 2")
def w9(spark, d):
    return P.one_each(matrix(spark, d).where("lead < 6 and y is not null"), ["issue", "source"], [F.col("lead")]).select("issue", "source", "valid", r6(F.col("x"), "x"))


PATH = f"""{BASE}, path AS (SELECT issue, lead, avg(x) AS p FROM matrix WHERE lead <= 3 GROUP BY 1, 2), k AS (SELECT *, lead(lead) OVER w AS l1, lead(p) OVER w AS p1 FROM path WINDOW w AS (PARTITION BY issue ORDER BY lead))"""


def minutes(spark, d):
    """The mean path of each issue, a row a minute of the first hour it spans, by linear interpolation."""
    path = matrix(spark, d).where("lead <= 3").groupBy("issue", "lead").agg(F.avg("x").alias("p"))
    w = Window.partitionBy("issue").orderBy("lead")
    k = path.withColumn("l1", F.lead("lead").over(w)).withColumn("p1", F.lead("p").over(w)).where("l1 is not null")
    m = k.withColumn("m", F.explode(F.sequence((F.col("lead") * 60).cast("int"), (F.col("l1") * 60 - 1).cast("int")))).where("m between 1 and 60")
    return m.select("issue", F.col("m").cast("int").alias("m"), (F.col("p") + (F.col("m") / 60 - F.col("lead")) / (F.col("l1") - F.col("lead")) * (F.col("p1") - F.col("p"))).alias("p"))


@query("m1_minutely_interp", f"WITH {PATH} SELECT issue, m::INTEGER AS m, round(p + (m / 60.0 - lead) / (l1 - lead) * (p1 - p), 6) AS p FROM k, range(1, 61) AS r(m) WHERE l1 IS NOT NULL AND m >= lead * 60 AND m < l1 * 60")
def m1(spark, d):
    return minutes(spark, d).select("issue", "m", r6(F.col("p"), "p"))


@query("m2_minutely_persistence", f"WITH {PATH} SELECT issue, m::INTEGER AS m, round(y, 6) AS p FROM (SELECT DISTINCT issue FROM path) i JOIN truth ON valid = issue, range(1, 61) AS r(m)")
def m2(spark, d):
    issues = matrix(spark, d).where("lead <= 3").select("issue").distinct().join(observed(spark, d), "issue")
    return issues.select("issue", F.explode(F.sequence(F.lit(1), F.lit(60))).alias("m"), r6(F.col("obs"), "p"))


def anchored_minutes(name: str, weight: str, spark_weight):
    sql = f"""WITH {PATH}, mm AS (SELECT issue, m::INTEGER AS m, p + (m / 60.0 - lead) / (l1 - lead) * (p1 - p) AS p FROM k, range(1, 61) AS r(m) WHERE l1 IS NOT NULL AND m >= lead * 60 AND m < l1 * 60),
z AS (SELECT issue, p0 - (CASE WHEN l1 IS NULL THEN 0 ELSE (p1 - p0) / (l1 - l0) END) * l0 AS z FROM (SELECT issue, arg_min(p, lead) AS p0, min(lead) AS l0, arg_min(p1, lead) AS p1, arg_min(l1, lead) AS l1 FROM k GROUP BY 1))
SELECT issue, m, round(p + ({weight}) * (y - z), 6) AS p FROM mm JOIN z USING (issue) JOIN truth ON valid = issue"""

    @query(name, sql)
    def run(spark, d):
        path = matrix(spark, d).where("lead <= 3").groupBy("issue", "lead").agg(F.avg("x").alias("p"))
        w = Window.partitionBy("issue").orderBy("lead")
        first = path.withColumn("l1", F.lead("lead").over(w)).withColumn("p1", F.lead("p").over(w)).groupBy("issue").agg(F.min_by(F.struct("p", "lead", "p1", "l1"), "lead").alias("f"))
        slope = F.coalesce(F.try_divide(F.col("f.p1") - F.col("f.p"), F.col("f.l1") - F.col("f.lead")), F.lit(0.0))
        zero = first.select("issue", (F.col("f.p") - slope * F.col("f.lead")).alias("z")).join(observed(spark, d), "issue")  # the path at lead zero, a straight line through its first two points
        return minutes(spark, d).join(zero, "issue").select("issue", "m", r6(F.col("p") + spark_weight(F.col("m") / 60) * (F.col("obs") - F.col("z")), "p"))


for _n, _tau in (("m3", 0.25), ("m4", 0.5), ("m5", 1.0), ("m6", 3.0)):
    anchored_minutes(f"{_n}_minutely_anchor_tau", f"CASE WHEN exp(-m / 60.0 / {_tau}) >= 0.05 THEN exp(-m / 60.0 / {_tau}) ELSE 0 END", lambda h, t=_tau: S.anchor_weight(h, t))
anchored_minutes("m7_minutely_anchor_full", "1", lambda h: F.lit(1.0))
