"""Queries on boards of distributions, verification, pools of evidence, what is served from them, and alerts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import inference as I
from ..operators import laws
from ..operators import methods as X
from ..operators import sequential as Q
from ..operators import temporal as P
from ..operators import truth as T
from ..sources import sinks as K
from ..sources.scratch import settled
from . import verdicts  # noqa: F401  alerts read its queries
from .archives import folder
from .base import E, events, query, r6, read
from .forecasts import BASE, BEST, BIAS, BUCKET, GROUND, MEAN, PATH, board, matrix, minutes, observed, relations, split
from .inference import daylight  # noqa: F401
from .observations import QC, log, qc
from .reports import BOARD

#: The last 30 % of a matrix by issue, out of the data.
CUT = "cut AS (SELECT min(issue) + floor(0.7 * (max(issue) - min(issue))) AS cut FROM matrix)"


def with_cut(m, share: float = 0.7):
    """Rows with ``cut``, the issue at which so much of the span has passed."""
    cut = m.agg((F.min("issue") + F.floor(share * (F.max("issue") - F.min("issue")))).alias("cut"))
    return m.crossJoin(F.broadcast(cut))  # one row


# Boards of distributions ---------------------------------------------------------------

LEVELS = (0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95)
_q = [f"q[{k}]" for k in range(len(LEVELS))]
_grid = [f"q{k}" for k in range(len(LEVELS))]
PINBALL = "(" + " + ".join(f"greatest({t} * (y - {c}), ({t} - 1) * (y - {c}))" for t, c in zip(LEVELS, _grid)) + f") / {len(LEVELS)}"
ENERGY = "(" + " + ".join(f"abs({c} - y)" for c in _grid) + f") / {len(LEVELS)} - (" + " + ".join(f"abs({a} - {b})" for i, a in enumerate(_grid) for b in _grid[i + 1 :]) + f") / {len(LEVELS) ** 2}"
PIT = "CASE WHEN y < q0 THEN 0.0 WHEN y > q6 THEN 1.0 " + " ".join(f"WHEN y <= {b} THEN {s} + coalesce((y - {a}) / nullif({b} - {a}, 0), 0) * {round(t - s, 4)}" for a, b, s, t in zip(_grid, _grid[1:], LEVELS, LEVELS[1:])) + " END"
GRIDS = f"g AS (SELECT issue, valid, any_value(bucket) AS bucket, any_value(y) AS y, {', '.join(f'quantile_cont(x, {t}) AS q{k}' for k, t in enumerate(LEVELS))} FROM matrix WHERE y IS NOT NULL GROUP BY 1, 2)"


def grids(spark, d):
    """Quantiles of the sources of each cell."""
    g = matrix(spark, d).where("y is not null").groupBy("issue", "valid").agg(F.first("bucket").alias("bucket"), F.first("y").alias("y"), F.percentile("x", F.array(*map(F.lit, LEVELS))).alias("q"))
    return g.select("issue", "valid", "bucket", "y", *[F.col("q")[k].alias(c) for k, c in enumerate(_grid)])


@query("t4_probabilistic_columns", f"""WITH {BASE}, {GRIDS}, p AS (SELECT *, {PIT} AS pit FROM g), b AS (SELECT bucket, least(9, floor(pit * 10)) AS bin, count(*) AS k FROM p GROUP BY 1, 2),
c AS (SELECT bucket, sum(k) AS n, sum(k * k) * 10 / sum(k) - sum(k) AS chi2 FROM b GROUP BY 1)
SELECT bucket, count(*) AS n, round(avg({PINBALL}), 6) AS pinball, round(avg({ENERGY}), 6) AS crps, round(avg(CASE WHEN y BETWEEN q1 AND q5 THEN 1.0 ELSE 0 END), 6) AS coverage80, round(avg(CASE WHEN y BETWEEN q0 AND q6 THEN 1.0 ELSE 0 END), 6) AS coverage90, round(avg(q5 - q1), 6) AS sharpness, round(CASE WHEN count(*) >= 50 THEN any_value(chi2) END, 4) AS pit_chi2 FROM p JOIN c USING (bucket) GROUP BY 1 HAVING count(*) >= 8""")
def t4(spark, d):
    """What quantiles are worth, by bucket: pinball loss, the energy form of the CRPS, coverage, width, and the chi-squared statistic of ten bins of the transforms (from 50 rows on)."""
    p = grids(spark, d).withColumn("pit", F.expr(PIT))
    bins = p.groupBy("bucket", F.least(F.lit(9), F.floor(F.col("pit") * 10)).alias("bin")).agg(F.count("*").alias("k"))
    chi2 = bins.groupBy("bucket").agg((F.sum(F.col("k") * F.col("k")) * 10 / F.sum("k") - F.sum("k")).alias("chi2"))
    inside = lambda a, b: r6(F.avg(F.when(F.col("y").between(F.col(a), F.col(b)), 1.0).otherwise(0.0)), "c")
    out = p.groupBy("bucket").agg(F.count("*").alias("n"), r6(F.avg(F.expr(PINBALL)), "pinball"), r6(F.avg(F.expr(ENERGY)), "crps"), inside("q1", "q5").alias("coverage80"), inside("q0", "q6").alias("coverage90"), r6(F.avg(F.col("q5") - F.col("q1")), "sharpness")).where("n >= 8")
    return out.join(chi2, "bucket").select("bucket", "n", "pinball", "crps", "coverage80", "coverage90", "sharpness", F.when(F.col("n") >= 50, F.round("chi2", 4)).alias("pit_chi2"))


@query("t3_pit_bins", f"WITH {BASE}, {GRIDS}, b AS (SELECT least(9, floor(({PIT}) * 10))::INTEGER AS bin, count(*) AS n FROM g GROUP BY 1) SELECT r.bin::INTEGER AS bin, coalesce(n, 0)::BIGINT AS n FROM range(0, 10) AS r(bin) LEFT JOIN b ON b.bin = r.bin")
def t3(spark, d):
    return pit_bins(spark, d)


def pit_bins(spark, d):
    b = grids(spark, d).groupBy(F.least(F.lit(9), F.floor(F.expr(PIT) * 10)).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    return spark.range(10).select(F.col("id").cast("int").alias("bin")).join(b, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


@query("t3_pit_uniformity")
def t3u(spark, d):
    """Whether the transforms are spread evenly; null without any."""
    counts = [r["n"] for r in pit_bins(spark, d).orderBy("bin").collect()]  # ten rows
    p = I.pit_uniformity(counts)
    return spark.createDataFrame([(sum(counts), None if p != p else float(p))], "n long, p_value double")


@query("t2_energy_crps", f"WITH {BASE}, c AS (SELECT issue, valid, any_value(bucket) AS bucket, any_value(y) AS y, list(x) AS m FROM matrix WHERE y IS NOT NULL GROUP BY 1, 2), s AS (SELECT bucket, list_avg(list_transform(m, lambda v: abs(v - y))) - list_avg(list_transform(m, lambda v: list_avg(list_transform(m, lambda w: abs(v - w))))) / 2 AS e FROM c) SELECT bucket, count(*) AS n, round(avg(e), 6) AS crps FROM s GROUP BY 1")
def t2e(spark, d):
    """The energy form over the members themselves: a cell has as many as there are sources."""
    c = matrix(spark, d).where("y is not null").groupBy("issue", "valid").agg(F.first("bucket").alias("bucket"), F.first("y").alias("y"), F.collect_list("x").alias("m"))
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v) / F.size(a)
    near = mean(F.transform("m", lambda v: F.abs(v - F.col("y"))))
    apart = mean(F.transform("m", lambda v: mean(F.transform("m", lambda w: F.abs(v - w)))))
    return c.groupBy("bucket").agg(F.count("*").alias("n"), r6(F.avg(near - apart / 2), "crps"))


THREE = f"""{BASE}, {BIAS}, {BEST.replace('pred AS', 'pb AS')}, {MEAN.format(rows='test').replace('pred AS', 'pe AS')}, {MEAN.format(rows='gtest').replace('pred AS', 'pg AS')},
al AS (SELECT 'best_provider' AS method, * FROM pb UNION ALL SELECT 'equal_weight', * FROM pe UNION ALL SELECT 'grounded_equal_weight', * FROM pg)"""
REFERENCE = ("best_provider", "equal_weight")


def against(spark, d):
    """Losses of every method and of a reference at the valid times that both have."""
    rows = settled(board(spark, d, (*REFERENCE, "grounded_equal_weight")), "board")
    cases = rows.where("p is not null").select("bucket", "issue", "valid", "method", F.abs(F.col("p") - F.col("y")).alias("loss"))
    ref = cases.where(F.col("method").isin(*REFERENCE)).select("bucket", "issue", "valid", F.col("method").alias("reference"), F.col("loss").alias("ref_loss"))
    both = cases.join(ref, ["bucket", "issue", "valid"]).where("method <> reference")
    return both.groupBy("bucket", "method", "reference", "valid").agg(F.avg("loss").alias("loss"), F.avg("ref_loss").alias("ref_loss")).withColumn("d", F.col("loss") - F.col("ref_loss"))


@query("ag13_skill_against_references", f"""WITH {THREE}, c AS (SELECT bucket, issue, valid, method, abs(p - y) AS loss FROM al WHERE p IS NOT NULL),
b AS (SELECT a.bucket, a.method, r.method AS reference, a.valid, avg(a.loss) AS loss, avg(r.loss) AS ref FROM c a JOIN c r ON a.bucket = r.bucket AND a.issue = r.issue AND a.valid = r.valid AND a.method <> r.method AND r.method IN ('best_provider', 'equal_weight') GROUP BY 1, 2, 3, 4),
k AS (SELECT *, loss - ref - avg(loss - ref) OVER (PARTITION BY bucket, method, reference) AS c FROM b), l AS (SELECT *, c * lag(c) OVER w AS c1, c * lag(c, 2) OVER w AS c2 FROM k WINDOW w AS (PARTITION BY bucket, method, reference ORDER BY valid)),
v AS (SELECT bucket, method, reference, count(*) AS times, avg(loss) AS mae, avg(ref) AS ref, sum(c * c) / count(*) + 2 * 2.0 / 3 * coalesce(sum(c1), 0) / count(*) + 2 * 1.0 / 3 * coalesce(sum(c2), 0) / count(*) AS v FROM l GROUP BY 1, 2, 3)
SELECT bucket, method, reference, times, round(1 - mae / nullif(ref, 0), 6) AS skill, round(CASE WHEN times >= 8 AND v > 0 THEN (mae - ref) / sqrt(v / times) * sqrt((times + 1 - 6 + 6.0 / times) / times) END, 5) AS dm FROM v""")
def ag13(spark, d):
    """Skill and the Diebold-Mariano statistic of each method against each reference, on common cases, a loss a valid time."""
    rows = against(spark, d)
    by = ["bucket", "method", "reference"]
    skill = rows.groupBy(*by).agg(F.count("*").alias("times"), r6(1 - F.try_divide(F.avg("loss"), F.avg("ref_loss")), "skill"))
    dm = I.dm_moments(rows.select(*by, "valid", "d"), by, 2).select(*by, F.round("stat", 5).alias("dm"))
    return skill.join(dm, by)


@query("ag13_dm_p_values")
def ag13p(spark, d):
    return I.dm_table(against(spark, d).select("bucket", "method", "reference", "valid", "d"), ["bucket", "method", "reference"], 2)


# Verification and pools ----------------------------------------------------------------

DAILY = "CASE " + " ".join(f"WHEN lead >= {a} AND lead < {b} THEN '{n}'" for a, b, n in S.LEAD_EDGES["daily"]) + " END"
MINUTE = "CASE " + " ".join(f"WHEN lead >= {a!r} AND lead < {b!r} THEN '{n}'" for a, b, n in S.LEAD_EDGES["minutely"]) + " END"


@query("j14_verification", f"""WITH {PATH}, mm AS (SELECT issue, m, p + (m / 60.0 - lead) / (l1 - lead) * (p1 - p) AS p FROM k, range(1, 61) AS r(m) WHERE l1 IS NOT NULL AND m >= lead * 60 AND m < l1 * 60), mt AS (SELECT us // 60000000 AS minute, avg(value) AS y FROM e GROUP BY 1), dt AS (SELECT valid // 24 AS day, max(y) AS y FROM truth GROUP BY 1),
h AS (SELECT 'hourly' AS product, source AS method, bucket, x AS p, y FROM matrix WHERE y IS NOT NULL UNION ALL
SELECT 'daily', source, {DAILY} AS bucket, p, y FROM (SELECT issue, source, valid // 24 AS day, max(x) AS p, (valid // 24) * 24 - issue AS lead FROM matrix GROUP BY 1, 2, 3, 5) JOIN dt USING (day) UNION ALL
SELECT 'minutely', 'path', {MINUTE} AS bucket, p, y FROM (SELECT *, m / 60.0 AS lead FROM mm) JOIN mt ON minute = issue * 60 + m)
SELECT product, method, bucket, count(*) AS n, round(avg(abs(p - y)), 6) AS mae, round(sqrt(avg((p - y) ** 2)), 6) AS rmse, round(avg(p - y), 6) AS bias FROM h WHERE bucket IS NOT NULL GROUP BY 1, 2, 3 HAVING count(*) >= 5""")
def j14(spark, d):
    """What was forecast against what came, each product by its own key: the hour, the day, the minute."""
    m, truth = matrix(spark, d), relations(spark, d)[2]
    hourly = m.where("y is not null").select(F.lit("hourly").alias("product"), F.col("source").alias("method"), "bucket", F.col("x").alias("p"), "y")
    day = F.floor(F.col("valid") / 24).cast("long").alias("day")
    daily = m.groupBy("issue", "source", day).agg(F.max("x").alias("p")).join(truth.groupBy(day).agg(F.max("y").alias("y")), "day").select(F.lit("daily").alias("product"), F.col("source").alias("method"), S.lead_bucket(F.col("day") * 24 - F.col("issue"), "daily").alias("bucket"), "p", "y")
    grid = events(spark, d).groupBy(F.floor(F.col("us") / T.MINUTE).cast("long").alias("minute")).agg(F.avg("value").alias("y"))
    minutely = minutes(spark, d).withColumn("minute", F.col("issue") * 60 + F.col("m")).join(grid, "minute").select(F.lit("minutely").alias("product"), F.lit("path").alias("method"), S.lead_bucket(F.col("m") / 60, "minutely").alias("bucket"), "p", "y")
    e = F.col("p") - F.col("y")
    return hourly.unionByName(daily).unionByName(minutely).where("bucket is not null").groupBy("product", "method", "bucket").agg(F.count("*").alias("n"), r6(F.avg(F.abs(e)), "mae"), r6(F.sqrt(F.avg(e * e)), "rmse"), r6(F.avg(e), "bias")).where("n >= 5")


@query("j15_live_against_backtest", f"""WITH {BASE}, {CUT}, s AS (SELECT m.*, issue > cut AS live, issue % 3 AS fold FROM matrix m, cut WHERE y IS NOT NULL), b0 AS (SELECT source, bucket, fold, count(*) AS n, avg(abs(x - y)) AS mae FROM s WHERE NOT live GROUP BY 1, 2, 3), b AS (SELECT source, bucket, sum(mae * n) / sum(n) AS mae FROM b0 GROUP BY 1, 2), l AS (SELECT source, bucket, count(*) AS n, avg(abs(x - y)) AS mae FROM s WHERE live GROUP BY 1, 2)
SELECT l.source, l.bucket, l.n, round(l.mae, 6) AS live, round(b.mae, 6) AS backtest, round(l.mae - b.mae, 6) AS gap FROM l LEFT JOIN b USING (source, bucket)""")
def j15(spark, d):
    """Errors of the last 30 % of the span beside what the folds before, weighted by their cases, had promised."""
    s = with_cut(matrix(spark, d)).where("y is not null").withColumn("e", F.abs(F.col("x") - F.col("y")))
    folds = s.where("issue <= cut").groupBy("source", "bucket", (F.col("issue") % 3).alias("fold")).agg(F.count("*").alias("n"), F.avg("e").alias("mae"))
    expected = folds.groupBy("source", "bucket").agg((F.sum(F.col("mae") * F.col("n")) / F.sum("n")).alias("b"))
    live = s.where("issue > cut").groupBy("source", "bucket").agg(F.count("*").alias("n"), F.avg("e").alias("l"))
    return live.join(expected, ["source", "bucket"], "left").select("source", "bucket", "n", r6(F.col("l"), "live"), r6(F.col("b"), "backtest"), r6(F.col("l") - F.col("b"), "gap"))


@query("b9_live_demotion", f"""WITH {BASE}, t AS (SELECT max(valid) AS last FROM matrix WHERE y IS NOT NULL), s AS (SELECT source, bucket, abs(x - y) AS e, valid > last - 336 AS live FROM matrix, t WHERE y IS NOT NULL), m AS (SELECT source, bucket, avg(e) FILTER (NOT live) AS promised, avg(e) FILTER (live) AS live, count(*) FILTER (live) AS n FROM s GROUP BY 1, 2)
SELECT source, bucket, n, round(live / promised, 6) AS ratio, (live > 1.5 * promised AND n >= 24) AS demoted FROM m WHERE promised IS NOT NULL AND live IS NOT NULL""")
def b9(spark, d):
    """A source goes where the last fortnight, of 24 cases at least, is half as bad again as it had promised."""
    rows = matrix(spark, d).where("y is not null")
    live = F.col("valid") > F.col("last") - 336
    e = F.abs(F.col("x") - F.col("y"))
    m = rows.crossJoin(F.broadcast(rows.agg(F.max("valid").alias("last")))).groupBy("source", "bucket").agg(F.avg(F.when(~live, e)).alias("promised"), F.avg(F.when(live, e)).alias("live"), F.count_if(live).alias("n"))  # one row
    return m.where("promised is not null and live is not null").select("source", "bucket", "n", r6(F.col("live") / F.col("promised"), "ratio"), ((F.col("live") > 1.5 * F.col("promised")) & (F.col("n") >= 24)).alias("demoted"))


@query("b11_recalibrated_levels", f"""WITH {BASE}, {GRIDS}, c AS (SELECT min(issue) + floor(0.7 * (max(issue) - min(issue))) AS cut FROM matrix WHERE y IS NOT NULL), s AS (SELECT g.*, issue <= cut AS fit FROM g, c), w AS (SELECT bucket, quantile_cont(greatest(q1 - y, y - q5), 0.8) AS w80, quantile_cont(greatest(q0 - y, y - q6), 0.9) AS w90 FROM s WHERE fit GROUP BY 1 HAVING count(*) >= 50)
SELECT bucket, count(*) AS n, round(avg(CASE WHEN y BETWEEN q1 AND q5 THEN 1.0 ELSE 0 END), 6) AS before80, round(avg(CASE WHEN y BETWEEN q1 - w80 AND q5 + w80 THEN 1.0 ELSE 0 END), 6) AS after80, round(avg(CASE WHEN y BETWEEN q0 AND q6 THEN 1.0 ELSE 0 END), 6) AS before90, round(avg(CASE WHEN y BETWEEN q0 - w90 AND q6 + w90 THEN 1.0 ELSE 0 END), 6) AS after90 FROM s JOIN w USING (bucket) WHERE NOT fit GROUP BY 1""")
def b11(spark, d):
    """Both intervals widened by a quantile of what earlier rows missed them by, each by its own."""
    s = with_cut(settled(grids(spark, d), "grids"))
    miss = lambda a, b: F.greatest(F.col(a) - F.col("y"), F.col("y") - F.col(b))
    w = s.where("issue <= cut").groupBy("bucket").agg(F.percentile(miss("q1", "q5"), 0.8).alias("w80"), F.percentile(miss("q0", "q6"), 0.9).alias("w90"), F.count("*").alias("k")).where("k >= 50")
    share = lambda lo, hi, name: r6(F.avg(F.when(F.col("y").between(lo, hi), 1.0).otherwise(0.0)), name)
    q = lambda k: F.col(f"q{k}")
    return s.where("issue > cut").join(w, "bucket").groupBy("bucket").agg(F.count("*").alias("n"), share(q(1), q(5), "before80"), share(q(1) - F.col("w80"), q(5) + F.col("w80"), "after80"), share(q(0), q(6), "before90"), share(q(0) - F.col("w90"), q(6) + F.col("w90"), "after90"))


@query("j16_funnel", "WITH a AS (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_orderstatus = 'O' GROUP BY 1), b AS (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), c AS (SELECT o_custkey AS k, count(*) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_returnflag = 'R' GROUP BY 1), s AS (SELECT k FROM a UNION SELECT k FROM b UNION SELECT k FROM c) SELECT k, a.n AS open_n, b.n AS done_n, c.n AS returned_n FROM s LEFT JOIN a USING (k) LEFT JOIN b USING (k) LEFT JOIN c USING (k)")
def j16(spark, d):
    from ..operators import relations as R

    o = read(spark, d, "orders")
    layer = lambda rows: rows.groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("n"))
    returned = o.join(read(spark, d, "lineitem").where("l_returnflag = 'R'"), F.col("l_orderkey") == F.col("o_orderkey"))
    return R.funnel(["k"], {"open": layer(o.where("o_orderstatus = 'O'")), "done": layer(o.where("o_orderstatus = 'F'")), "returned": layer(returned)})


POOL = "s AS (SELECT l_orderkey, l_linenumber, l_quantity AS p, l_returnflag AS kind, l_linestatus AS semantics, 'd' || l_suppkey % 3 AS dataset, 'c' || l_partkey % 2 AS config, l_shipdate AS created FROM lineitem)"


@query("pf15_compatible_scores", f"WITH {POOL}, n AS (SELECT max(created) - INTERVAL 400 DAY AS now FROM s) SELECT l_orderkey, l_linenumber, p FROM s, n WHERE kind = 'N' AND dataset = 'd1' AND config = 'c0' AND semantics = 'O' AND created <= now")
def pf15(spark, d):
    """The scores that evidence may be drawn from: live, of today's data, configuration and semantics, and known by now. Kind and fingerprint are folders, so a scan of the others is left out."""
    path = folder(spark, "pool")
    rows = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("p"), F.col("l_returnflag").alias("kind"), F.col("l_linestatus").alias("semantics"), F.concat(F.lit("d"), (F.col("l_suppkey") % 3).cast("string")).alias("dataset"), F.concat(F.lit("c"), (F.col("l_partkey") % 2).cast("string")).alias("config"), F.col("l_shipdate").alias("created"))
    rows.write.partitionBy("kind", "dataset").parquet(path)
    now = rows.agg((F.max("created") - F.expr("INTERVAL 400 DAYS")).alias("now"))
    return K.compatible_scores(spark.read.parquet(path), now, kind="N", dataset="d1", config="c0", semantics="O").select("l_orderkey", "l_linenumber", "p")


@query("pf16_numeric_guards", "WITH a AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'nan'::DOUBLE WHEN 1 THEN 'inf'::DOUBLE WHEN 2 THEN NULL WHEN 3 THEN -value ELSE value END AS age FROM events) SELECT event_id, coalesce(isfinite(age), false) AS finite, coalesce(isfinite(age) AND age >= 0 AND age < 48, false) AS fresh FROM a")
def pf16(spark, d):
    k = F.col("event_id") % 6
    age = F.when(k == 0, float("nan")).when(k == 1, float("inf")).when(k == 3, -F.col("value")).when(k > 3, F.col("value"))
    return read(spark, d, "events").withColumn("age", age).select("event_id", F.coalesce(S.finite(F.col("age")), F.lit(False)).alias("finite"), S.fresh(F.col("age"), 48).alias("fresh"))


@query("pf17_truth_minutes", f"""WITH {E}, {QC}, c AS (SELECT event_id, CASE WHEN (b | s | f) = 0 THEN value END AS t, user_id % 110 AS h FROM q2)
SELECT event_id, t AS temp_c, CASE WHEN h > 0 AND h <= 100 THEN h::DOUBLE END AS humidity_pct, round(CASE WHEN h > 0 AND h <= 100 THEN 243.04 * (ln(h / 100.0) + 17.625 * t / (243.04 + t)) / (17.625 - (ln(h / 100.0) + 17.625 * t / (243.04 + t))) END, 6) AS dew_point_c, round(900 * pow(1 - 9.1 / (t + 9.1 + 273.15), -5.257), 6) AS pressure_sea_hpa FROM c""")
def pf17(spark, d):
    """Channels without their flagged samples as canonical variables, and what follows from them."""
    rows = qc(log(spark, d)).withColumn("h", (F.col("user_id") % 110).cast("double"))
    hqc = F.when((F.col("h") > 0) & (F.col("h") <= 100), 0).otherwise(1)
    out = T.canonical_minutes(rows.withColumn("h_qc", hqc).withColumn("p", F.lit(900.0)), {"temp": ("value", "qc"), "humidity": ("h", "h_qc"), "pressure_station": ("p", None)}, 1400.0, ["event_id"])
    return out.select("event_id", "temp_c", "humidity_pct", r6(F.col("dew_point_c"), "dew_point_c"), r6(F.col("pressure_sea_hpa"), "pressure_sea_hpa"))


@query("pf9_variable_exclusions", f"WITH {E}, c AS (SELECT us // 3600000000 AS hour, event_type AS source, user_id % 2 AS variable, avg(value) AS v FROM e GROUP BY 1, 2, 3) SELECT hour, source, variable, round(CASE WHEN NOT (source = 'click' AND variable = 0 OR source = 'error' AND variable = 1) THEN v END, 6) AS v FROM c")
def pf9(spark, d):
    """A source's variable that is excluded is null; its row stays."""
    c = events(spark, d).groupBy(F.floor(F.col("us") / T.HOUR).cast("long").alias("hour"), F.col("event_type").alias("source"), (F.col("user_id") % 2).alias("variable")).agg(F.avg("value").alias("v"))
    return X.without(c, [("click", 0), ("error", 1)], "v").select("hour", "source", "variable", r6(F.col("v"), "v"))


# Serving -------------------------------------------------------------------------------

@query("b16_no_evidence_reason", f"""WITH {POOL}, g AS (SELECT DISTINCT 'd' || (l_suppkey % 4) AS d, 'c' || (l_partkey % 3) AS c FROM lineitem), f AS (SELECT d, c, count(*) FILTER (kind = 'N') AS live, count(*) FILTER (kind = 'N' AND dataset = d) AS same_data, count(*) FILTER (kind = 'N' AND config = c) AS same_config, count(*) AS n FROM g LEFT JOIN s ON true GROUP BY 1, 2)
SELECT d, c, CASE WHEN n = 0 THEN 'cold_start' WHEN live = 0 THEN 'no_live_evidence' WHEN same_data = 0 THEN 'dataset_changed' WHEN same_config = 0 THEN 'config_changed' ELSE 'no_slice_passed' END AS reason FROM f""")
def b16(spark, d):
    """Why nothing has been promoted, the first of the reasons that holds."""
    s = read(spark, d, "lineitem").select(F.col("l_returnflag").alias("kind"), F.concat(F.lit("d"), (F.col("l_suppkey") % 3).cast("string")).alias("dataset"), F.concat(F.lit("c"), (F.col("l_partkey") % 2).cast("string")).alias("config"), F.col("l_shipdate").alias("created"))
    of = lambda name, column, n: F.concat(F.lit(name), (F.col(column) % n).cast("string"))
    wanted = read(spark, d, "lineitem").select(of("d", "l_suppkey", 4).alias("d"), of("c", "l_partkey", 3).alias("c")).distinct()  # some of them no score knows
    return K.no_evidence_reason(s, wanted, "N").select("d", "c", "reason")


@query("b12_coherence", """WITH q AS (SELECT l_orderkey, l_linenumber, l_quantity AS a, l_quantity + l_tax * 20 AS a2, l_extendedprice / 1500 AS b, l_extendedprice / 1500 + l_discount * 10 AS b2 FROM lineitem),
c AS (SELECT l_orderkey, l_linenumber, least(a, b) AS l0, least(a2, b2) AS l1, greatest(a, b) AS h0, greatest(a2, b2) AS h1 FROM q)
SELECT l_orderkey, l_linenumber, round(l0, 6) AS low_a, round(greatest(l0, l1), 6) AS low_b, round(h0, 6) AS high_a, round(greatest(h0, h1), 6) AS high_b FROM c""")
def b12(spark, d):
    """Two quantile curves of which one may not exceed the other: at each level the lesser is the lower's, and both rise with the level."""
    q = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.array("l_quantity", F.col("l_quantity") + F.col("l_tax") * 20).alias("low"), F.array(F.col("l_extendedprice") / 1500, F.col("l_extendedprice") / 1500 + F.col("l_discount") * 10).alias("high"))
    low, high = S.coherent(F.col("low"), F.col("high"))
    out = q.select("l_orderkey", "l_linenumber", low.alias("lower"), high.alias("upper"))  # new names: a lambda would take an alias of this list for the column
    return out.select("l_orderkey", "l_linenumber", *[r6(F.col(c)[k], f"{name}_{n}") for c, name in (("lower", "low"), ("upper", "high")) for k, n in ((0, "a"), (1, "b"))])


@query("w13_anchor_regimes", f"WITH {E}, a AS (SELECT user_id, event_id, us, event_type IN ('click', 'view') AS anchored FROM e), b AS (SELECT *, sum(CASE WHEN anchored IS DISTINCT FROM was THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT *, lag(anchored) OVER (PARTITION BY user_id ORDER BY us, event_id) AS was FROM a)) SELECT event_id, anchored, min(us) OVER (PARTITION BY user_id, run) AS first_us, max(us) OVER (PARTITION BY user_id, run) AS last_us FROM b")
def w13(spark, d):
    """For each row the span of the rows around it that are anchored, or not, as it is."""
    rows = events(spark, d).select("user_id", "event_id", "us", F.col("event_type").isin("click", "view").alias("anchored"))
    was = F.lag("anchored").over(Window.partitionBy("user_id").orderBy("us", "event_id"))
    runs = P.islands(rows, ["user_id"], ["us", "event_id"], ~was.eqNullSafe(F.col("anchored")), "run")
    run = Window.partitionBy("user_id", "run")
    return runs.select("event_id", "anchored", F.min("us").over(run).alias("first_us"), F.max("us").over(run).alias("last_us"))


@query("w12_held_leaders", f"""WITH {E}, h AS (SELECT us // 3600000000 AS hour, event_type, sum(value) AS v FROM e GROUP BY 1, 2), l0 AS (SELECT hour, arg_max(event_type, (v, event_type)) AS leader FROM h GROUP BY 1), l AS (SELECT * FROM l0 WHERE hour >= (SELECT max(hour) - 72 FROM l0)),
s AS (SELECT *, sum(CASE WHEN lag_ IS DISTINCT FROM leader THEN 1 ELSE 0 END) OVER (ORDER BY hour) AS run FROM (SELECT *, lag(leader) OVER (ORDER BY hour) AS lag_ FROM l)), r AS (SELECT run, any_value(leader) AS leader, min(hour) AS start FROM s GROUP BY 1), t AS (SELECT *, lead(start) OVER (ORDER BY start) AS nxt FROM r)
SELECT leader, start, coalesce(nxt, (SELECT max(hour) FROM l)) - start AS held FROM t WHERE coalesce(nxt, (SELECT max(hour) FROM l)) - start >= 3""")
def w12h(spark, d):
    """Leaders of the last three days that held for three hours at least: a regime lasts until the next begins, the newest as long as it has been seen."""
    hours = events(spark, d).groupBy(F.floor(F.col("us") / T.HOUR).cast("long").alias("hour"), "event_type").agg(F.sum("value").alias("v"))
    leader = hours.groupBy("hour").agg(F.max_by("event_type", F.struct("v", "event_type")).alias("leader"))
    last = leader.agg(F.max("hour").alias("last"))
    window = leader.crossJoin(F.broadcast(last)).where("hour >= last - 72")  # one row; what remains is 73 hours
    by = Window.partitionBy("last")
    starts = window.withColumn("was", F.lag("leader").over(by.orderBy("hour"))).where(~F.col("was").eqNullSafe(F.col("leader")))
    held = F.coalesce(F.lead("hour").over(by.orderBy("hour")), F.col("last")) - F.col("hour")
    return starts.select("leader", F.col("hour").alias("start"), held.alias("held")).where("held >= 3")


@query("dz8_weight_trajectory")
def dz8(spark, d):
    """The weights of the bucket with most rounds as they went, fold by fold; a source that a state doesn't know is null."""
    return Q.weight_history(states(spark, d))


def states(spark, d):
    """Expert states at the origin of each fold."""
    train, test = split(spark, d)
    rows = X.grounded(train, train)
    cells = rows.groupBy(*X.CELL).agg(F.first("y").alias("y"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("source", "x")))).alias("xs"))
    nothing = spark.createDataFrame([], Q.STATE)
    key = F.concat_ws("|", F.col("fold").cast("string"), "bucket")
    made = Q.advanced_experts(cells.withColumn("bucket", key), nothing)
    return made.select(F.split_part("bucket", F.lit("|"), F.lit(1)).cast("int").alias("issue"), F.split_part("bucket", F.lit("|"), F.lit(2)).alias("bucket"), "sources", "state")


@query("b14_warm_started_experts")
def b14(spark, d):
    """Expert weights at the last fold, carried on from the states of the fold before; the same as learned from the start."""
    train, _ = split(spark, d)
    last = train.agg(F.max("fold").alias("k"))
    rows = train.crossJoin(F.broadcast(last)).where("fold = k").drop("k")  # one row
    cells = settled(rows.groupBy(*X.CELL).agg(F.first("y").alias("y"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("source", "x")))).alias("xs")), "history")
    middle = cells.agg(F.expr("percentile(valid, 0.5)").alias("m"))
    old = Q.advanced_experts(cells.crossJoin(F.broadcast(middle)).where("valid <= m").drop("m"), spark.createDataFrame([], Q.STATE))  # one row
    now = Q.advanced_experts(cells, settled(old, "states"))
    parsed = now.select("bucket", F.from_json("sources", "array<string>").alias("s"), F.from_json("state", "struct<w: array<double>, rounds: long>").alias("t"))
    return parsed.select("bucket", F.col("t.rounds").alias("rounds"), F.posexplode("s").alias("k", "source"), "t.w").select("bucket", "source", "rounds", r6(F.get("w", F.col("k")), "weight"))


@query("b15_replayed_documents", f"WITH {BASE}, i AS (SELECT DISTINCT issue FROM sel ORDER BY issue DESC LIMIT 3) SELECT issue, '{{\"issue\":' || issue || ',\"values\":[' || string_agg(round(m)::BIGINT, ',' ORDER BY valid) || ']}}' AS document FROM (SELECT issue, valid, avg(x) AS m FROM matrix JOIN i USING (issue) GROUP BY 1, 2) GROUP BY 1")
def b15(spark, d):
    """The documents of the three newest issues, read back as they were archived."""
    path = folder(spark, "documents")
    cells = matrix(spark, d).groupBy("issue", "valid").agg(F.avg("x").alias("m"))
    newest = cells.select("issue").distinct().orderBy(F.desc("issue")).limit(3)
    points = cells.join(F.broadcast(newest), "issue").groupBy("issue").agg(F.array_sort(F.collect_list(F.struct("valid", F.round("m").cast("long").alias("v")))).alias("v"))  # three rows
    text = F.to_json(F.struct("issue", F.col("v.v").alias("values")))
    served = points.select("issue", text.alias("document")).collect()
    for r in served:
        K.archive_document(spark, path, f"issue-{r['issue']}", r["document"])
    return spark.createDataFrame([(r["issue"], K.archived_document(spark, path, f"issue-{r['issue']}")) for r in served], "issue long, document string")


@query("b4_minutely_backtest", f"""WITH {BASE}, {GROUND.format(agg='avg(y - x)').replace('FROM test t', "FROM (SELECT f.fold, m.* FROM matrix m JOIN folds f ON issue > origin AND issue <= origin + 120 WHERE lead <= 3) t").replace('FROM train t', 'FROM train t')},
path AS (SELECT fold, issue, lead, avg(x) AS p FROM gtest GROUP BY 1, 2, 3), k AS (SELECT *, lead(lead) OVER w AS l1, lead(p) OVER w AS p1 FROM path WINDOW w AS (PARTITION BY fold, issue ORDER BY lead)), mt AS (SELECT us // 60000000 AS minute, avg(value) AS y FROM e GROUP BY 1),
s AS (SELECT fold, issue, m / 60.0 AS lead, p + (m / 60.0 - lead) / (l1 - lead) * (p1 - p) AS p, y FROM k, range(1, 61) AS r(m), mt WHERE l1 IS NOT NULL AND m >= lead * 60 AND m < l1 * 60 AND minute = issue * 60 + m)
SELECT fold, {MINUTE} AS bucket, count(*) AS n, round(avg(abs(p - y)), 6) AS mae FROM s GROUP BY 1, 2""")
def b4(spark, d):
    """Paths of a base that is trained by the hourly clock, scored minute by minute in each fold."""
    rows = settled(matrix(spark, d), "matrix")
    from ..operators import matrix as M
    from .forecasts import INITIAL, STEP

    origins = M.fold_origins(rows, INITIAL, STEP)
    train, _ = M.train_test(rows, origins, STEP)
    test = M.folded(rows.where("lead <= 3"), origins, lambda o: (F.col("issue") > o) & (F.col("issue") <= o + STEP))
    path = X.grounded(train, test).groupBy("fold", "issue", "lead").agg(F.avg("x").alias("p"))
    w = Window.partitionBy("fold", "issue").orderBy("lead")
    k = path.withColumn("l1", F.lead("lead").over(w)).withColumn("p1", F.lead("p").over(w)).where("l1 is not null")
    m = k.withColumn("m", F.explode(F.sequence((F.col("lead") * 60).cast("int"), (F.col("l1") * 60 - 1).cast("int")))).where("m between 1 and 60")
    m = m.withColumn("at", F.col("m") / 60).withColumn("p", F.col("p") + (F.col("at") - F.col("lead")) / (F.col("l1") - F.col("lead")) * (F.col("p1") - F.col("p"))).withColumn("minute", F.col("issue") * 60 + F.col("m"))
    grid = events(spark, d).groupBy(F.floor(F.col("us") / T.MINUTE).cast("long").alias("minute")).agg(F.avg("value").alias("y"))
    return m.join(grid, "minute").groupBy("fold", S.lead_bucket(F.col("at"), "minutely").alias("bucket")).agg(F.count("*").alias("n"), r6(F.avg(F.abs(F.col("p") - F.col("y"))), "mae"))


@query("e42_daily_path_extreme", f"""WITH {BASE}, {CUT}, dm AS (SELECT issue, source, valid // 24 AS day, max(x) AS px, max(y) AS py, count(*) AS n FROM matrix WHERE y IS NOT NULL GROUP BY 1, 2, 3), w AS (SELECT dm.*, cut // 24 AS c FROM dm, cut WHERE n >= 20), b AS (SELECT source, avg(py - px) AS b FROM w WHERE day <= c GROUP BY 1)
SELECT issue, day, round(median(px + b), 6) AS p, round(quantile_cont(px + b, 0.9), 6) AS hi, count(*) AS members FROM w JOIN b USING (source) WHERE day > c GROUP BY 1, 2 HAVING count(*) >= 3""")
def e42(spark, d):
    """The median and a quantile of at least three sources' daily maxima, each freed of its bias of the days before the cut."""
    m = settled(with_cut(matrix(spark, d)).where("y is not null").groupBy("issue", "source", F.floor(F.col("valid") / 24).cast("long").alias("day")).agg(F.max("x").alias("px"), F.max("y").alias("py"), F.count("*").alias("n"), F.floor(F.first("cut") / 24).alias("c")).where("n >= 20"), "daily-paths")
    bias = m.where("day <= c").groupBy("source").agg(F.avg(F.col("py") - F.col("px")).alias("b"))
    v = m.where("day > c").join(bias, "source").withColumn("v", F.col("px") + F.col("b"))
    return v.groupBy("issue", "day").agg(r6(F.median("v"), "p"), r6(F.percentile("v", 0.9), "hi"), F.count("*").alias("members")).where("members >= 3")


@query("e42_daily_marginal_emos")
def e42m(spark, d):
    """A normal law of the day's maximum, by fold: its mean on the grounded maxima of the sources' forecasts and on the mean of the maxima of their hourly paths as given, its spread on that of the sources."""
    train, test = split(spark, d)
    day = F.floor(F.col("valid") / 24).cast("long").alias("day")

    def daily(rows):
        cells = rows.groupBy("fold", "issue", "source", day).agg(F.max("x").alias("x"), F.max("y").alias("y"), F.count("*").alias("n")).where("n >= 12")
        path = cells.groupBy("fold", "issue", "day").agg(F.avg("x").alias("path"))
        lead = F.greatest(F.col("day") * 24 - F.col("issue"), F.lit(0))
        out = cells.join(path, ["fold", "issue", "day"]).select("fold", "issue", (F.col("day") * 24).alias("valid"), lead.alias("lead"), "source", "x", F.col("x").alias("raw"), "path", "y")
        return out.withColumn("bucket", F.when(F.col("lead") < 12, "D0").otherwise("D1"))

    old, new = daily(train), daily(test)
    from .inference import spread

    return spread(laws.emos(X.grounded(old, old), X.grounded(old, new), path=True), laws.LEVELS)


@query("dz12_inputs_of_an_issue", f"WITH {BASE}, {CUT}, i AS (SELECT max(issue) AS issue FROM matrix, cut WHERE issue <= cut) SELECT m.issue, valid, source, 'x' AS variable, round(x, 6) AS value FROM matrix m JOIN i USING (issue) UNION ALL SELECT m.issue, valid, source, 'lead', lead::DOUBLE FROM matrix m JOIN i USING (issue)")
def dz12(spark, d):
    """What a given issue had to go on: here the last one before 70 % of the span."""
    m = matrix(spark, d)
    at = with_cut(m).where("issue <= cut").agg(F.max("issue").alias("issue"))
    rows = m.join(F.broadcast(at), "issue").select("issue", "valid", "source", r6(F.col("x"), "x"), F.col("lead").cast("double").alias("lead"))  # one row
    return rows.unpivot(["issue", "valid", "source"], ["x", "lead"], "variable", "value")


# Reports -------------------------------------------------------------------------------

CHURN = f"d AS (SELECT user_id, us // 86400000000 AS day, arg_max(event_type, (value, event_id)) AS pick, max(value) AS v FROM e GROUP BY 1, 2), t AS (SELECT max(day) - 1 AS day FROM d)"


@query("ag20_selection_churn", f"WITH {E}, {CHURN}, a AS (SELECT user_id, pick FROM d, t WHERE d.day = t.day - 1), b AS (SELECT user_id, pick FROM d, t WHERE d.day = t.day) SELECT CASE WHEN a.pick IS NULL THEN 'added' WHEN b.pick IS NULL THEN 'dropped' WHEN a.pick = b.pick THEN 'kept' ELSE 'changed' END AS what, count(*) AS n FROM a FULL JOIN b USING (user_id) GROUP BY 1")
def ag20(spark, d):
    """How the choices of the last whole day differ from those of the day before."""
    days = events(spark, d).groupBy("user_id", F.floor(F.col("us") / 86_400_000_000).alias("day")).agg(F.max_by("event_type", F.struct("value", "event_id")).alias("pick"))
    both = days.crossJoin(F.broadcast(days.agg((F.max("day") - 1).alias("last")))).where("day between last - 1 and last")  # one row
    a, b = (both.where(c).select("user_id", F.col("pick").alias(n)) for c, n in (("day = last - 1", "a"), ("day = last", "b")))
    what = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "dropped").when(F.col("a") == F.col("b"), "kept").otherwise("changed")
    return a.join(b, "user_id", "full").groupBy(what.alias("what")).agg(F.count("*").alias("n"))


@query("ag20_recalibration_wins", "WITH s AS (SELECT l_orderkey AS cell, l_linenumber % 3 AS k, avg(l_discount * 10) AS cov, avg(l_tax) AS pinball FROM lineitem GROUP BY 1, 2), w AS (SELECT cell, arg_min(k, (round(abs(cov - 0.8), 9), round(pinball, 9), k)) AS k FROM s GROUP BY 1) SELECT CASE k WHEN 0 THEN 'raw' WHEN 1 THEN 'pit' ELSE 'cqr' END AS transform, round(count(*) / sum(count(*)) OVER (), 6) AS share, count(*) AS cells FROM w GROUP BY k")
def ag20r(spark, d):
    """In how many cells each transform comes nearest to its coverage, the lower loss and the simpler one deciding ties."""
    s = read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("cell"), (F.col("l_linenumber") % 3).alias("k")).agg(F.avg(F.col("l_discount") * 10).alias("cov"), F.avg("l_tax").alias("pinball"))
    w = s.groupBy("cell").agg(F.min_by("k", F.struct(F.round(F.abs(F.col("cov") - 0.8), 9), F.round("pinball", 9), "k")).alias("k"))
    n = w.groupBy("k").agg(F.count("*").alias("cells"))
    total = n.agg(F.sum("cells").alias("all"))
    name = F.when(F.col("k") == 0, "raw").when(F.col("k") == 1, "pit").otherwise("cqr")
    return n.crossJoin(F.broadcast(total)).select(name.alias("transform"), r6(F.col("cells") / F.col("all"), "share"), "cells")  # one row


@query("ag20_gate_agreement", f"WITH {BOARD}, m AS (SELECT bucket, fold, method, round(avg(abs(p - y)), 6) AS mae FROM al GROUP BY 1, 2, 3), w AS (SELECT bucket, fold, arg_min(method, (mae, method)) AS method FROM m GROUP BY 1, 2), l AS (SELECT bucket, max(fold) AS fold FROM w GROUP BY 1), c AS (SELECT a.bucket, a.method = b.method AS agree FROM w a JOIN w b ON a.bucket = b.bucket AND b.fold = a.fold - 1 JOIN l ON l.bucket = a.bucket AND l.fold = a.fold) SELECT round(avg(CASE WHEN agree THEN 1.0 ELSE 0 END), 6) AS rate, count(*) FILTER (NOT agree) AS disagreements, count(*) AS slices FROM c")
def ag20g(spark, d):
    """How often two decisions on a slice agree: here the last two folds' winners."""
    rows = board(spark, d, ("equal_weight", "grounded_equal_weight"))
    m = rows.groupBy("bucket", "fold", "method").agg(r6(F.avg(F.abs(F.col("p") - F.col("y"))), "mae"))
    w = m.groupBy("bucket", "fold").agg(F.min_by("method", F.struct("mae", "method")).alias("method"))
    by = Window.partitionBy("bucket").orderBy("fold")
    c = w.withColumn("was", F.lag("method").over(by)).withColumn("gap", F.col("fold") - F.lag("fold").over(by)).withColumn("last", F.max("fold").over(Window.partitionBy("bucket"))).where("fold = last and gap = 1")
    agree = F.col("method") == F.col("was")
    return c.agg(r6(F.avg(F.when(agree, 1.0).otherwise(0.0)), "rate"), F.count_if(~agree).alias("disagreements"), F.count("*").alias("slices"))


@query("ag21_provider_contraction", f"""WITH {E}, c AS (SELECT event_type, us // 86400000000 AS day, count(*) AS n, max(value) AS reach FROM e GROUP BY 1, 2), t AS (SELECT max(day) AS today FROM c), b AS (SELECT event_type, count(DISTINCT day) AS days, median(n) AS med, median(reach) AS far FROM c, t WHERE day >= today - 14 AND day < today GROUP BY 1 HAVING count(DISTINCT day) >= 3)
SELECT event_type, n, round(n / med, 6) AS ratio, days, n < 0.8 * med AS fewer, reach < far - 24 AS shorter FROM c JOIN t ON day = today JOIN b USING (event_type)""")
def ag21(spark, d):
    """Today's rows and reach of each provider against its own fortnight, where that has three days."""
    c = events(spark, d).groupBy("event_type", F.floor(F.col("us") / 86_400_000_000).cast("long").alias("day")).agg(F.count("*").alias("n"), F.max("value").alias("reach"))
    rows = c.crossJoin(F.broadcast(c.agg(F.max("day").alias("today"))))  # one row
    own = rows.where("day >= today - 14 and day < today").groupBy("event_type").agg(F.count_distinct("day").alias("days"), F.median("n").alias("med"), F.median("reach").alias("far")).where("days >= 3")
    return rows.where("day = today").join(own, "event_type").select("event_type", "n", r6(F.col("n") / F.col("med"), "ratio"), "days", (F.col("n") < 0.8 * F.col("med")).alias("fewer"), (F.col("reach") < F.col("far") - 24).alias("shorter"))


@query("ag21_freshness", f"""WITH {E}, t AS (SELECT max(us) AS now FROM e), w AS (SELECT event_type, max(us) AS last, count(*) FILTER (us > now - 86400000000) AS n24, count(*) FILTER (us > now - 86400000000 AND value < 100) AS ok24, any_value(now) AS now FROM e, t GROUP BY 1)
SELECT event_type, round((now - last) / 6e7, 6) AS age_minutes, n24, round(ok24 / nullif(n24, 0), 6) AS success_rate, concat_ws(',', CASE WHEN now - last > 1800000000 THEN 'stale' END, CASE WHEN n24 < 10 THEN 'thin' END, CASE WHEN ok24 / nullif(n24, 0) < 0.9 THEN 'failing' END) AS alarms FROM w""")
def ag21f(spark, d):
    """Age, the last day's rows and successes of each feed, and what is wrong with it."""
    e = events(spark, d)
    rows = e.crossJoin(F.broadcast(e.agg(F.max("us").alias("now"))))  # one row
    recent = F.col("us") > F.col("now") - 86_400_000_000
    w = rows.groupBy("event_type").agg((F.first("now") - F.max("us")).alias("age"), F.count_if(recent).alias("n24"), F.count_if(recent & (F.col("value") < 100)).alias("ok"))
    rate = F.try_divide(F.col("ok"), F.col("n24"))
    alarms = F.concat_ws(",", F.when(F.col("age") > 1_800_000_000, "stale"), F.when(F.col("n24") < 10, "thin"), F.when(rate < 0.9, "failing"))
    return w.select("event_type", r6(F.col("age") / 6e7, "age_minutes"), "n24", r6(rate, "success_rate"), alarms.alias("alarms"))


@query("st1_stable_order", f"WITH {BASE}, o AS (SELECT issue, valid, source, row_number() OVER (ORDER BY issue, valid, source) AS k FROM matrix) SELECT issue, valid, source, k % 1000 AS place FROM o")
def st1(spark, d):
    """The place of each row in a total order of three keys, modulo a thousand: numbered within issues, which are numbered by their sizes."""
    m = matrix(spark, d).select("issue", "valid", "source")
    out = P.cumulative(m, "issue", ["valid", "source"], F.lit(1), "k")
    return out.select("issue", "valid", "source", (F.col("k") % 1000).alias("place"))


@query("sc2_iso_offsets", "SELECT o_orderkey, epoch_us(o_orderdate) - CASE o_orderkey % 3 WHEN 0 THEN 0 WHEN 1 THEN 7200000000 ELSE -25200000000 END AS us FROM orders")
def sc2(spark, d):
    """Times with an offset, to microseconds of UTC."""
    k = F.col("o_orderkey") % 3
    text = F.concat(F.date_format(F.col("o_orderdate").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.when(k == 0, "Z").when(k == 1, "+02:00").otherwise("-07:00"))
    return read(spark, d, "orders").select("o_orderkey", F.unix_micros(F.to_timestamp(text)).alias("us"))


def erf_sql(x: str) -> str:
    """The error function as ``scalars.erf`` has it, in SQL."""
    t = f"(1 / (1 + 0.5 * abs({x})))"
    poly = f"{S.ERF_TERMS[-1]!r}"
    for c in reversed(S.ERF_TERMS[:-1]):
        poly = f"({c!r} + {t} * {poly})"
    return f"(sign({x}) * (1 - {t} * exp(-({x}) * ({x}) + {poly})))"


@query("sc18_gaussian_crps", f"WITH a AS (SELECT o_orderkey, (o_totalprice - 200000) / (50000 + o_custkey) AS z, 50000 + o_custkey AS s FROM orders) SELECT o_orderkey, round(0.5 * (1 + {erf_sql('z / sqrt(2)')}), 6) AS cdf, round(exp(-z * z / 2) / sqrt(2 * pi()), 6) AS pdf, round(s * (z * {erf_sql('z / sqrt(2)')} + sqrt(2 / pi()) * exp(-z * z / 2) - 1 / sqrt(pi())), 4) AS crps FROM a")
def sc18(spark, d):
    s = 50000 + F.col("o_custkey")
    z = (F.col("o_totalprice") - 200000) / s
    return read(spark, d, "orders").select("o_orderkey", r6(S.normal_cdf(z), "cdf"), r6(S.normal_pdf(z), "pdf"), F.round(S.gaussian_crps(F.lit(200000.0), s, F.col("o_totalprice")), 4).alias("crps"))


@query("sc20_json_grids", "SELECT event_id, CASE WHEN event_id % 4 = 1 THEN NULL ELSE value END AS first, 2.5::DOUBLE AS second, CASE WHEN event_id % 4 = 1 THEN '[null, 2.5]' ELSE NULL END AS shown FROM events")
def sc20(spark, d):
    """Arrays to JSON and back; what isn't finite is null on the way."""
    k = F.col("event_id") % 4
    rows = read(spark, d, "events").select("event_id", F.array(F.when(k == 1, float("nan")).otherwise(F.col("value")), F.lit(2.5)).alias("q"))
    back = K.rows_to_scores(K.scores_to_rows(rows), ["q"])
    return K.scores_to_rows(rows).join(back, "event_id").select("event_id", F.get("q", F.lit(0)).alias("first"), F.get("q", F.lit(1)).alias("second"), F.when(k == 1, F.col("q_json")).alias("shown"))


@query("b18_alerts", f"""WITH {BOARD}, now AS (SELECT max(us) AS now FROM e),
h AS (SELECT event_type, max(us) AS last, count(DISTINCT us // 3600000000) AS hours FROM e GROUP BY 1), src AS (SELECT DISTINCT source FROM cyc), fresh AS (SELECT source, max(issue) - max(fetched) AS age FROM sel WHERE issue = (SELECT max(issue) FROM sel) GROUP BY 1),
cov AS (SELECT count(DISTINCT us // 3600000000) / 168.0 AS c FROM e, now WHERE us > now - 604800000000), m AS (SELECT bucket, method, count(*) AS n, avg(abs(p - y)) AS mae, avg(p - y) AS bias FROM al GROUP BY 1, 2),
liv AS (SELECT source, bucket, avg(abs(x - y)) FILTER (valid > last - 72) AS live, avg(abs(x - y)) FILTER (valid <= last - 72) AS past, count(*) FILTER (valid > last - 72) AS n FROM matrix, (SELECT max(valid) AS last FROM matrix WHERE y IS NOT NULL) WHERE y IS NOT NULL GROUP BY 1, 2)
SELECT 'A' AS zone, 'anchor-lost' AS panel, event_type AS subject, round((now - last) / 6e7, 6) AS value FROM h, now WHERE now - last > 1800000000
UNION ALL SELECT 'A', 'provider-dropped', source, NULL FROM src WHERE source NOT IN (SELECT source FROM fresh) UNION ALL SELECT 'A', 'provider-aged-out', source, age::DOUBLE FROM fresh WHERE age >= 2
UNION ALL SELECT 'B', 'truth-thinning', 'hourly', round(c, 6) FROM cov WHERE c < 0.9 UNION ALL SELECT 'C', 'archive-stalled', event_type, round((now - last) / 3.6e9, 6) FROM h, now WHERE now - last > 43200000000
UNION ALL SELECT 'D', 'grounding-bias', method || ' ' || bucket, round(bias, 6) FROM m WHERE n >= 24 AND abs(bias) > 2 UNION ALL SELECT 'D', 'baseline-implausible', a.bucket, round(a.mae / b.mae, 6) FROM m a JOIN m b ON a.bucket = b.bucket WHERE a.method = 'equal_weight' AND b.method = 'grounded_equal_weight' AND a.mae < b.mae
UNION ALL SELECT 'F', 'serving-diverged', source || ' ' || bucket, round(live / past, 6) FROM liv WHERE n >= 24 AND live > 1.1 * past UNION ALL SELECT 'A', 'silent-empty', 'matrix', 0.0 FROM (SELECT count(*) AS n FROM matrix) WHERE n = 0""")
def b18(spark, d):
    """Alerts, each family a filter with its threshold, as rows of zone, panel, subject and value."""
    e, m = events(spark, d), settled(matrix(spark, d), "matrix")
    cycles = relations(spark, d)[0]
    now = e.agg(F.max("us").alias("now"))
    hours = e.groupBy("event_type").agg(F.max("us").alias("last")).crossJoin(F.broadcast(now)).withColumn("lag", F.col("now") - F.col("last"))  # one row
    told = lambda df, zone, panel, subject, value: df.select(F.lit(zone).alias("zone"), F.lit(panel).alias("panel"), subject.alias("subject"), value.cast("double").alias("value"))
    selected = m.select("issue", "source", "fetched").distinct()
    fresh = selected.join(F.broadcast(selected.agg(F.max("issue").alias("issue"))), "issue").groupBy("source").agg((F.max("issue") - F.max("fetched")).alias("age"))  # one row
    week = e.crossJoin(F.broadcast(now)).where("us > now - 604800000000").agg((F.count_distinct(F.floor(F.col("us") / T.HOUR)) / 168.0).alias("c"))
    rows = settled(board(spark, d, ("equal_weight", "grounded_equal_weight")), "board")
    b = rows.groupBy("bucket", "method").agg(F.count("*").alias("n"), F.avg(F.abs(F.col("p") - F.col("y"))).alias("mae"), F.avg(F.col("p") - F.col("y")).alias("bias"))
    pick = lambda name: F.max(F.when(F.col("method") == name, F.col("mae")))
    floor = b.groupBy("bucket").agg((pick("equal_weight") / pick("grounded_equal_weight")).alias("r")).where("r < 1")
    known = m.where("y is not null")
    late, err = F.col("valid") > F.col("last") - 72, F.abs(F.col("x") - F.col("y"))
    live = known.crossJoin(F.broadcast(known.agg(F.max("valid").alias("last")))).groupBy("source", "bucket").agg(F.avg(F.when(late, err)).alias("live"), F.avg(F.when(~late, err)).alias("past"), F.count_if(late).alias("n"))  # one row
    out = [
        told(hours.where("lag > 1800000000"), "A", "anchor-lost", F.col("event_type"), F.round(F.col("lag") / 6e7, 6)),
        told(cycles.select("source").distinct().join(fresh, "source", "left_anti"), "A", "provider-dropped", F.col("source"), F.lit(None)),
        told(fresh.where("age >= 2"), "A", "provider-aged-out", F.col("source"), F.col("age")),
        told(week.where("c < 0.9"), "B", "truth-thinning", F.lit("hourly"), F.round("c", 6)),
        told(hours.where("lag > 43200000000"), "C", "archive-stalled", F.col("event_type"), F.round(F.col("lag") / 3.6e9, 6)),
        told(b.where("n >= 24 and abs(bias) > 2"), "D", "grounding-bias", F.concat_ws(" ", "method", "bucket"), F.round("bias", 6)),
        told(floor, "D", "baseline-implausible", F.col("bucket"), F.round("r", 6)),
        told(live.where("n >= 24 and live > 1.1 * past"), "F", "serving-diverged", F.concat_ws(" ", "source", "bucket"), F.round(F.col("live") / F.col("past"), 6)),
        told(m.agg(F.count("*").alias("n")).where("n = 0"), "A", "silent-empty", F.lit("matrix"), F.col("n")),
    ]
    return K.all_of(out)


@query("ag19_recent_quantiles", f"""WITH {BASE}, {GRIDS}, a AS (SELECT max(valid) AS anchor FROM g) SELECT bucket, count(*) AS n, round(avg({PINBALL}), 6) AS pinball, round(avg(CASE WHEN y BETWEEN q1 AND q5 THEN 1.0 ELSE 0 END), 6) AS coverage80 FROM g, a WHERE valid > anchor - 336 AND valid <= anchor GROUP BY 1""")
def ag19(spark, d):
    """Quantile scores of the fortnight up to the newest truth."""
    g = grids(spark, d)
    rows = g.crossJoin(F.broadcast(g.agg(F.max("valid").alias("anchor")))).where("valid > anchor - 336 and valid <= anchor")  # one row
    return rows.groupBy("bucket").agg(F.count("*").alias("n"), r6(F.avg(F.expr(PINBALL)), "pinball"), r6(F.avg(F.when(F.col("y").between(F.col("q1"), F.col("q5")), 1.0).otherwise(0.0)), "coverage80"))


@query("ag27_weekly_panels", f"WITH {BOARD}, w AS (SELECT method, bucket, (valid // 168) AS week, count(*) AS n, avg(abs(p - y)) AS mae FROM al GROUP BY 1, 2, 3), t AS (SELECT bucket FROM w GROUP BY 1 ORDER BY sum(n) DESC, 1 LIMIT 4) SELECT 'mae' AS panel, method || ' ' || bucket AS series, week AS label, round(mae, 6) AS value FROM w SEMI JOIN t USING (bucket) UNION ALL SELECT 'rows', method, week, sum(n)::DOUBLE FROM w GROUP BY 2, 3 UNION ALL SELECT 'best', bucket, week, round(min(mae), 6) FROM w GROUP BY 2, 3")
def ag27(spark, d):
    """Three panels of the trend report by week: errors of the four largest buckets, rows a method, the best error a bucket."""
    al = settled(board(spark, d, ("equal_weight", "grounded_equal_weight")), "board")
    w = al.groupBy("method", "bucket", F.floor(F.col("valid") / 168).cast("long").alias("week")).agg(F.count("*").alias("n"), F.avg(F.abs(F.col("p") - F.col("y"))).alias("mae"))
    top = w.groupBy("bucket").agg(F.sum("n").alias("total")).orderBy(F.desc("total"), "bucket").limit(4)
    panel = lambda df, name, series, value: df.select(F.lit(name).alias("panel"), series.alias("series"), F.col("week").alias("label"), value.cast("double").alias("value"))
    errors = panel(w.join(F.broadcast(top), "bucket", "left_semi"), "mae", F.concat_ws(" ", "method", "bucket"), F.round("mae", 6))  # four rows
    rows = panel(w.groupBy("method", "week").agg(F.sum("n").alias("n")), "rows", F.col("method"), F.col("n"))
    best = panel(w.groupBy("bucket", "week").agg(F.min("mae").alias("mae")), "best", F.col("bucket"), F.round("mae", 6))
    return errors.unionByName(rows).unionByName(best)


@query("t22_latch_state", f"WITH {E}, d AS (SELECT event_type, us // 86400000000 AS day, avg(value) AS v FROM e GROUP BY 1, 2), a AS (SELECT *, v > median(v) OVER (PARTITION BY event_type) AS hit FROM d), l AS (SELECT event_type, max(day) AS day, max(day) FILTER (NOT hit) AS miss FROM a GROUP BY 1) SELECT l.event_type, l.day, count(a.day) AS streak, min(a.day) AS since, count(a.day) >= 3 AS latched FROM l LEFT JOIN a ON a.event_type = l.event_type AND a.hit AND a.day > coalesce(miss, -1) GROUP BY 1, 2")
def t22s(spark, d):
    """The state of the latch after the last day, carried on day by day over its last four and, for being run twice, the last once more."""
    day = settled(events(spark, d).groupBy("event_type", F.floor(F.col("us") / 86_400_000_000).cast("long").alias("day")).agg(F.avg("value").alias("v")), "days")
    verdicts = day.withColumn("drifts", F.col("v") > F.median("v").over(Window.partitionBy("event_type"))).select("event_type", "day", "drifts")
    last = verdicts.agg(F.max("day")).first()[0]
    if last is None:
        return verdicts.select("event_type", "day", F.lit(0).cast("long").alias("streak"), F.col("day").alias("since"), "drifts").withColumnRenamed("drifts", "latched")
    early = verdicts.where(F.col("day") <= last - 4)
    miss = early.groupBy("event_type").agg(F.max("day").alias("day"), F.max(F.when(~F.col("drifts"), F.col("day"))).alias("miss"))
    runs = miss.join(early.where("drifts").withColumnRenamed("day", "hit"), "event_type", "left").where("hit is null or hit > coalesce(miss, -1)")
    state = miss.select("event_type", "day").join(runs.groupBy("event_type").agg(F.count("hit").alias("streak"), F.min("hit").alias("since")), "event_type", "left").select("event_type", "day", F.coalesce("streak", F.lit(0)).cast("long").alias("streak"), "since")
    for k in (3, 2, 1, 0, 0):
        state = settled(I.latched(state, verdicts.where(F.col("day") == last - k), ["event_type"]).select("event_type", "day", "streak", "since"), "latch")
    return state.withColumn("latched", F.col("streak") >= 3)


@query("dz10_fold_readiness", f"WITH {BASE}, d AS (SELECT issue // 24 AS day, count(DISTINCT issue) AS k FROM matrix GROUP BY 1) SELECT round((max(issue) - min(issue)) / 24.0, 6) AS span_days, (max(issue) - min(issue)) >= 360 AS ready, count(DISTINCT issue) AS issues, (SELECT round(avg(k), 6) FROM d) AS issues_a_day, (SELECT count(DISTINCT fold) FROM test) AS folds FROM matrix")
def dz10(spark, d):
    """How far the matrix reaches, whether that is enough for a fold, how many folds there are and how dense the issues."""
    m = settled(matrix(spark, d), "matrix")
    width = F.max("issue") - F.min("issue")
    per_day = m.groupBy(F.floor(F.col("issue") / 24)).agg(F.count_distinct("issue").alias("k")).agg(r6(F.avg("k"), "issues_a_day"))
    folds = split(spark, d)[1].agg(F.count_distinct("fold").alias("folds"))
    return m.agg(r6(width / 24, "span_days"), (width >= 360).alias("ready"), F.count_distinct("issue").alias("issues")).crossJoin(per_day).crossJoin(folds)  # one row each


@query("dz11_active_flatline", f"WITH {E}, {QC}, l AS (SELECT user_id, event_id, (b | cf)::INTEGER AS qc, row_number() OVER (PARTITION BY user_id ORDER BY us DESC, event_id DESC) AS k FROM q2), s AS (SELECT user_id, count(*) FILTER (f = 4) AS flat FROM q2 GROUP BY 1) SELECT s.user_id, event_id, qc, (qc & 4) = 4 AS active, flat FROM s LEFT JOIN l ON l.user_id = s.user_id AND k = 1")
def dz11(spark, d):
    """Each channel's flags now, by the past alone, beside its history of flat samples."""
    from ..operators import quality

    last = P.one_each(qc(log(spark, d), causal=True), ["user_id"], [F.desc("us"), F.desc("event_id")]).select("user_id", "event_id", F.col("qc").cast("int").alias("qc"))
    flat = quality.summary(qc(log(spark, d)), ["user_id"]).select("user_id", "flat")
    return flat.join(last, "user_id", "left").select("user_id", "event_id", "qc", (F.col("qc").bitwiseAND(F.lit(4)) == 4).alias("active"), "flat")


#: Families of alerts that read another query's rows: zone, panel, subject, value and which rows.
FROM_QUERIES = (
    ("B", "stuck-sensor", "dz11_active_flatline", "CAST(user_id AS STRING)", "flat", "active"),
    ("B", "provider-drifting", "t16_page_hinkley", "concat(source, ' ', bucket, ' residual')", "highest", "alarm"),
    ("B", "provider-drifting", "t15_consensus_shift", "concat(source, ' ', bucket, ' consensus')", "z", "alarm"),
    ("E", "backend-swap", "w12_held_leaders", "leader", "held", "start > (SELECT min(start) FROM rows_)"),
)
#: The newest order stands for the last run; its status for how that ended, its priority for what it was made from.
LAST_RUN = "SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1"


def _state_alerts_sql() -> str:
    from .base import SQL

    parts = [f"SELECT '{zone}' AS zone, '{panel}' AS panel, {subject.replace('STRING', 'VARCHAR')} AS subject, round({value}::DOUBLE, 4) AS value FROM (WITH rows_ AS ({SQL[name]}) SELECT * FROM rows_ WHERE {rows})" for zone, panel, name, subject, value, rows in FROM_QUERIES]
    parts += [f"SELECT 'F', 'serving-refused', o_orderkey::VARCHAR, NULL::DOUBLE FROM ({LAST_RUN}) WHERE o_orderstatus <> 'O'", f"SELECT 'F', 'artifacts-stale', o_orderkey::VARCHAR, NULL::DOUBLE FROM ({LAST_RUN}) WHERE o_orderpriority <> '1-URGENT'"]
    return " UNION ALL ".join(parts)


@query("b18_state_alerts", _state_alerts_sql())
def b18s(spark, d):
    """The families that look at flags, drift, leaders, the last run and what it was made from."""
    from .base import QUERIES

    out = []
    for zone, panel, name, subject, value, rows in FROM_QUERIES:
        df = QUERIES[name](spark, d)
        if "rows_" in rows:  # all but the first leader have taken over from one
            first = df.agg(F.min("start").alias("first"))
            df, rows = df.crossJoin(F.broadcast(first)), "start > first"  # one row
        out.append(df.where(rows).selectExpr(f"'{zone}' AS zone", f"'{panel}' AS panel", f"{subject} AS subject", f"round(CAST({value} AS DOUBLE), 4) AS value"))
    last = read(spark, d, "orders").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(1)
    told = lambda rows, panel: last.where(rows).selectExpr("'F' AS zone", f"'{panel}' AS panel", "CAST(o_orderkey AS STRING) AS subject", "CAST(NULL AS DOUBLE) AS value")
    return K.all_of([*out, told("o_orderstatus <> 'O'", "serving-refused"), told("o_orderpriority <> '1-URGENT'", "artifacts-stale")])


PITS = f"p AS (SELECT *, {PIT} AS pit FROM s)"


@query("t23_recalibration_transforms", f"""WITH {BASE}, {GRIDS}, c AS (SELECT min(issue) + floor(0.7 * (max(issue) - min(issue))) AS cut FROM matrix WHERE y IS NOT NULL), s AS (SELECT g.*, issue <= cut AS fit FROM g, c), {PITS},
f AS (SELECT bucket, count(*) AS k, quantile_cont(greatest(q1 - y, y - q5), 0.8) AS w, quantile_cont(pit, 0.1) AS a, quantile_cont(pit, 0.9) AS b FROM p WHERE fit GROUP BY 1), o AS (SELECT quantile_cont(greatest(q1 - y, y - q5), 0.8) AS w, quantile_cont(pit, 0.1) AS a, quantile_cont(pit, 0.9) AS b FROM p WHERE fit),
ev AS (SELECT p.bucket, y, q1, q5, pit, CASE WHEN k >= 50 THEN f.w ELSE o.w END AS w, CASE WHEN k >= 50 THEN f.a ELSE o.a END AS a, CASE WHEN k >= 50 THEN f.b ELSE o.b END AS b FROM p LEFT JOIN f USING (bucket), o WHERE NOT fit),
x AS (SELECT bucket, count(*) AS n, avg(CASE WHEN y BETWEEN q1 AND q5 THEN 1.0 ELSE 0 END) AS raw, avg(CASE WHEN y BETWEEN q1 - w AND q5 + w THEN 1.0 ELSE 0 END) AS cqr, avg(CASE WHEN pit BETWEEN a AND b THEN 1.0 ELSE 0 END) AS pit FROM ev GROUP BY 1 HAVING count(*) >= 20)
SELECT bucket, n, round(raw, 6) AS raw, round(pit, 6) AS pit, round(cqr, 6) AS cqr FROM x""")
def t23(spark, d):
    """Coverage of 80 % intervals on the later rows, as they are, with levels replaced by quantiles of the earlier rows' transforms, and widened by what those missed: each by the bucket's own 50 rows at least, else by all buckets'."""
    p = settled(with_cut(settled(grids(spark, d), "grids")).withColumn("pit", F.expr(PIT)), "transforms")
    miss = F.greatest(F.col("q1") - F.col("y"), F.col("y") - F.col("q5"))
    learned = lambda g: g.agg(F.count("*").alias("k"), F.percentile(miss, 0.8).alias("w"), F.percentile("pit", F.array(F.lit(0.1), F.lit(0.9))).alias("t"))
    early = p.where("issue <= cut")
    own, overall = learned(early.groupBy("bucket")), learned(early.groupBy()).select(F.col("w").alias("all_w"), F.col("t").alias("all_t"))
    e = p.where("issue > cut").join(own, "bucket", "left").crossJoin(F.broadcast(overall))  # one row
    enough = F.col("k") >= 50
    w, t = F.when(enough, F.col("w")).otherwise(F.col("all_w")), F.when(enough, F.col("t")).otherwise(F.col("all_t"))
    share = lambda inside, name: r6(F.avg(F.when(inside, 1.0).otherwise(0.0)), name)
    y = F.col("y")
    return e.withColumn("w_", w).withColumn("t_", t).groupBy("bucket").agg(F.count("*").alias("n"), share(y.between(F.col("q1"), F.col("q5")), "raw"), share(F.col("pit").between(F.col("t_")[0], F.col("t_")[1]), "pit"), share(y.between(F.col("q1") - F.col("w_"), F.col("q5") + F.col("w_")), "cqr")).where("n >= 20")
