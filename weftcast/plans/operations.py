"""Queries on anchoring curves, drift, gates, serving and operations."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import boosting as G
from ..operators import inference as I
from ..operators import matrix as M
from ..operators import methods as X
from ..operators import sequential as Q
from ..operators import temporal as P
from ..sources.scratch import settled
from .base import E, events, query, r6
from .forecasts import BASE, BASEP, BIAS, CAP, EWMA, PATH, SCORE, matrix, minutes, observed, relations, score, split
from .inference import daylight, grounded_split, losses, spread, sun
from .reports import BOARD, pair

RESIDUALS = "ra AS (SELECT a.fold, a.issue, o.y - a.p0 AS r0 FROM (SELECT fold, issue, arg_min(p, lead) AS p0 FROM ptrain WHERE lead < 6 GROUP BY ALL) a JOIN truth o ON o.valid = a.issue), rb AS (SELECT a.fold, a.issue, o.y - a.p0 AS r0 FROM (SELECT fold, issue, arg_min(p, lead) AS p0 FROM ptest WHERE lead < 6 GROUP BY ALL) a JOIN truth o ON o.valid = a.issue)"
EDGES = [*X.BINS, X.END]
TREND = "ot AS (SELECT n.valid AS issue, (n.y - o.y) / (n.valid - o.valid) AS trend FROM (SELECT valid, y, valid - 1 AS past FROM truth) n ASOF JOIN truth o ON n.past >= o.valid WHERE n.past - o.valid <= 2)"


def curve_sql(base: str, trend: bool = False) -> str:
    """The fitted curve in SQL: sums of every bin as columns of a row a fold, then its knots as rows."""
    span, c = range(len(X.BINS)), X.CENTRES
    inside = [f"lead >= {a} AND lead < {b}" for a, b in zip(EDGES, EDGES[1:])]
    sums = ", ".join(f"count(*) FILTER ({i}) AS n{k}, sum(r0 * (y - p)) FILTER ({i}) AS re{k}, sum(r0 * r0) FILTER ({i}) AS rr{k}, count(trend) FILTER ({i}) AS m{k}, sum(trend * (y - p)) FILTER ({i}) AS te{k}, sum(trend * r0) FILTER ({i}) AS tr{k}, sum(trend * trend) FILTER ({i}) AS tt{k}" for k, i in enumerate(inside))
    shares = ", ".join(f"CASE WHEN n{k} >= 24 AND rr{k} > 0 THEN greatest(0, least(1, re{k} / rr{k})) END AS w{k}" for k in span)
    gains = ", ".join(f"CASE WHEN m{k} >= 24 AND w{k} IS NOT NULL AND tt{k} > 0 THEN greatest(0, least({X.MOST_GAIN}, (te{k} - w{k} * tr{k}) / tt{k})) ELSE 0 END AS g{k}" for k in span)

    def filled(k: int) -> str:
        at = lambda value, ks: "CASE " + " ".join(f"WHEN w{j} IS NOT NULL THEN {value(j)}" for j in ks) + " END"
        back, on = range(k, -1, -1), range(k, len(c))
        w0, w1, k0, k1 = at(lambda j: f"w{j}", back), at(lambda j: f"w{j}", on), at(str, back), at(str, on)
        ahead = at(lambda j: f"CASE WHEN w{j} >= greatest(0.2, 2 / sqrt(n{j})) AND w{j} < 1 THEN pow(w{j}, {c[k] / c[j]}) ELSE w{j} END", span)
        return f"CASE WHEN {k0} IS NULL THEN {ahead} WHEN {k1} IS NULL OR {k0} = {k1} THEN {w0} ELSE {w0} + ({k}.0 - {k0}) / ({k1} - {k0}) * ({w1} - {w0}) END"

    falling = ", ".join(f"least({', '.join(f'f{j}' for j in range(k + 1))}) AS v{k}" if k else "f0 AS v0" for k in span)
    zero = f"CASE WHEN v0 <= 0 THEN 0 WHEN v1 <= 0 OR v1 >= v0 THEN v0 ELSE least(1, v0 * pow(pow(v1 / v0, {1 / (c[1] - c[0])}), {-c[0]})) END"
    knots = " UNION ALL ".join([f"SELECT fold, 0.0 AS x, {zero} AS w, g0 AS g FROM v", *[f"SELECT fold, {c[k]}, v{k}, g{k} FROM v" for k in span], f"SELECT fold, {float(X.END)}, 0, 0 FROM v"])
    joined = "LEFT JOIN ot USING (issue)" if trend else "CROSS JOIN (SELECT NULL::DOUBLE AS trend)"
    return f"""WITH {BASE}, {base}, {RESIDUALS}, {TREND}, s0 AS (SELECT fold, {sums} FROM ptrain JOIN ra USING (fold, issue) {joined} WHERE r0 IS NOT NULL GROUP BY fold), s1 AS (SELECT *, {shares} FROM s0),
s2 AS (SELECT *, {gains}, {', '.join(f'{filled(k)} AS f{k}' for k in span)} FROM s1 WHERE {' OR '.join(f'w{k} IS NOT NULL' for k in span)}), v AS (SELECT *, {falling} FROM s2), k AS ({knots}),
s AS (SELECT *, lead(x) OVER u AS x1, lead(w) OVER u AS w1, lead(g) OVER u AS h1 FROM k WINDOW u AS (PARTITION BY fold ORDER BY x)),
pred AS (SELECT t.* REPLACE (p + coalesce(s.w + (t.lead - s.x) / (s.x1 - s.x) * (s.w1 - s.w), 0) * coalesce(r0, 0) + coalesce(s.g + (t.lead - s.x) / (s.x1 - s.x) * (s.h1 - s.g), 0) * coalesce(trend, 0) AS p) FROM ptest t LEFT JOIN rb USING (fold, issue) {joined} LEFT JOIN s ON s.fold = t.fold AND t.lead >= s.x AND t.lead < s.x1) {SCORE}"""


@query("e19_anchored_fitted", curve_sql(f"{BIAS}, {BASEP}"))
def e19(spark, d):
    return score(X.fitted_curve(*split(spark, d), observed(spark, d)))


@query("e20_anchored_fitted_ewma", curve_sql(f"{EWMA}, " + BASEP.replace("gtrain", "etrain").replace("gtest", "etest")))
def e20(spark, d):
    return score(X.fitted_curve(*split(spark, d), observed(spark, d), X.ewma_equal))


@query("e16_harmonic_grounding")
def e16(spark, d):
    return score(X.harmonic_grounded(*split(spark, d), sun()))


@query("e21_anchored_trend", curve_sql(f"{BIAS}, {BASEP}", trend=True))
def e21(spark, d):
    """The fitted curve with a gain on the recent slope of observations in each bin."""
    obs = observed(spark, d)
    return score(X.fitted_curve(*split(spark, d), obs, trend=X.recent_trend(obs)))


@query("e28_gbt_stack")
def e28(spark, d):
    return score(G.stacked(*split(spark, d)))


@query("e29_gbt_quantile")
def e29(spark, d):
    return spread(G.stacked_quantiles(*split(spark, d)))


@query("e35_idr_bucket_subsampled")
def e35(spark, d):
    return spread(Q.or_global(*grounded_split(spark, d), Q.subsampled_isotonic))


@query("e36_idr_calibrated")
def e36(spark, d):
    return spread(Q.or_global(*grounded_split(spark, d), Q.calibrated_isotonic))


@query("e38_conformal_ewma")
def e38(spark, d):
    return spread(Q.conformal(*split(spark, d), X.ewma_corrected, daylight()))


@query("e26_analog_ensemble")
def e26(spark, d):
    return spread(Q.analogs(*split(spark, d)))


MINUTES = "CASE " + " ".join(f"WHEN m / 60.0 >= {low!r} AND m / 60.0 < {high!r} THEN '{name}'" for low, high, name in S.LEAD_EDGES["minutely"]) + " END"
#: Responses to the first residual, fitted on the first 70 % of the issues and applied to the rest: a bucket's own from 60 rows on, else the overall one.
FITTED = f"""{PATH}, mm AS (SELECT issue, m::INTEGER AS m, p + (m / 60.0 - lead) / (l1 - lead) * (p1 - p) AS p FROM k, range(1, 61) AS r(m) WHERE l1 IS NOT NULL AND m >= lead * 60 AND m < l1 * 60), f AS (SELECT issue, arg_min(p, m) AS p0 FROM mm GROUP BY 1),
t AS (SELECT mm.*, o.y - p0 AS r, n.y - p AS e, {MINUTES} AS b FROM mm JOIN f USING (issue) JOIN truth o ON o.valid = mm.issue JOIN truth n ON n.valid = mm.issue + m // 60), c AS (SELECT min(issue) + floor(0.7 * (max(issue) - min(issue))) AS cut FROM t),
g AS (SELECT sum(e * r) / sum(r * r) AS g FROM t, c WHERE issue <= cut), s AS (SELECT b, CASE WHEN count(*) >= 60 THEN sum(e * r) / sum(r * r) ELSE any_value(g) END AS s FROM t, c, g WHERE issue <= cut GROUP BY 1)"""


def slopes(spark, d):
    mm = minutes(spark, d)
    first = mm.groupBy("issue").agg(F.min_by("p", "m").alias("p0"))
    truth = relations(spark, d)[2]
    now, then = truth.select(F.col("valid").alias("issue"), F.col("y").alias("y0")), truth.select(F.col("valid").alias("v"), F.col("y").alias("y1"))
    t = mm.join(first, "issue").join(now, "issue").withColumn("v", F.col("issue") + F.floor(F.col("m") / 60)).join(then, "v")
    t = settled(t.select("issue", "m", "p", (F.col("y0") - F.col("p0")).alias("r"), (F.col("y1") - F.col("p")).alias("e"), S.lead_bucket(F.col("m") / 60, "minutely").alias("b")), "minutes")
    t = t.crossJoin(F.broadcast(t.agg((F.min("issue") + F.floor(0.7 * (F.max("issue") - F.min("issue")))).alias("cut"))))  # one row
    slope = F.try_divide(F.sum(F.col("e") * F.col("r")), F.sum(F.col("r") * F.col("r")))
    both = t.where("issue <= cut").rollup("b").agg(F.grouping("b").alias("g"), F.count("*").alias("n"), slope.alias("s"))
    whole = both.where("g = 1").select(F.col("s").alias("all"))
    fit = both.where("g = 0").crossJoin(F.broadcast(whole)).select("b", F.when(F.col("n") >= 60, F.col("s")).otherwise(F.col("all")).alias("s"))  # one row
    return t.where("issue > cut"), fit


@query("m8_minutely_ramp", f"WITH {FITTED}, q AS (SELECT b, min(greatest(0, least(1, s))) OVER (ORDER BY list_position(['0-5min', '5-15min', '15-30min', '30-45min', '45-60min'], b)) AS s FROM s) SELECT issue, m, round(p + s * r, 6) AS p FROM t JOIN q USING (b), c WHERE issue > cut")
def m8(spark, d):
    t, s = slopes(spark, d)
    order = F.array_position(F.array(*[F.lit(n) for _, _, n in S.LEAD_EDGES["minutely"]]), F.col("b"))
    ramp = s.select("b", F.min(S.clipped(F.col("s"), 0, 1)).over(Window.orderBy(order)).alias("s"))  # five rows
    return t.join(F.broadcast(ramp), "b").select("issue", "m", r6(F.col("p") + F.col("s") * F.col("r"), "p"))


@query("m9_minutely_fitted_slope", f"WITH {FITTED} SELECT issue, m, round(p + greatest(-0.5, least(1.5, s)) * r, 6) AS p FROM t JOIN s USING (b), c WHERE issue > cut")
def m9(spark, d):
    t, s = slopes(spark, d)
    return t.join(F.broadcast(s), "b").select("issue", "m", r6(F.col("p") + S.clipped(F.col("s"), -0.5, 1.5) * F.col("r"), "p"))  # five rows


@query("t12_gap_annotation", f"WITH {BOARD}, m AS (SELECT bucket, method, avg(abs(p - y)) AS mae FROM al GROUP BY 1, 2) SELECT bucket, round(max(mae) / min(mae) - 1, 6) AS gap, max(mae) / min(mae) - 1 > 0.15 AS wide FROM m GROUP BY 1")
def t12(spark, d):
    m = pair(spark, d).groupBy("bucket", "method").agg(F.avg(F.abs(F.col("p") - F.col("y"))).alias("mae"))
    gap = F.try_divide(F.max("mae"), F.min("mae")) - 1
    return m.groupBy("bucket").agg(r6(gap, "gap"), (gap > 0.15).alias("wide"))


@query("t14_incumbent_retention")
def t14(spark, d):
    """The incumbent stays while the challenger's mean advantage is within one bootstrap standard error."""

    def run(key, pdf):
        wide = pdf.pivot_table(index="valid", columns="method", values="loss").dropna().sort_index()
        if len(wide) < 8 or wide.shape[1] < 2:
            return pd.DataFrame(columns=range(4))
        diff = (wide["equal_weight"] - wide["grounded_equal_weight"]).to_numpy()
        error = I.mean_error(diff)
        return pd.DataFrame([[key[0], len(diff), float(diff.mean()), bool(diff.mean() <= error)]])

    return losses(spark, d).groupBy("bucket").applyInPandas(run, "bucket string, n long, advantage double, retained boolean")


@query("t17_common_mode", f"WITH {BASE}, z AS (SELECT issue, source, avg(x - y) AS e FROM matrix WHERE y IS NOT NULL GROUP BY 1, 2) SELECT issue, count(*) AS sources, count(*) FILTER (abs(e) > 5) AS off, (count(*) >= 3 AND count(*) FILTER (abs(e) > 5) >= count(*) * 2 / 3) AS common FROM z GROUP BY 1")
def t17(spark, d):
    z = matrix(spark, d).where("y is not null").groupBy("issue", "source").agg(F.avg(F.col("x") - F.col("y")).alias("e"))
    off = F.count_if(F.abs("e") > 5)
    return z.groupBy("issue").agg(F.count("*").alias("sources"), off.alias("off"), ((F.count("*") >= 3) & (off >= F.count("*") * 2 / 3)).alias("common"))


@query("t23_recalibration_split", f"""WITH {BASE}, e1 AS (SELECT bucket, issue, y - x AS e FROM matrix WHERE y IS NOT NULL), c AS (SELECT min(issue) + 0.7 * (max(issue) - min(issue)) AS cut FROM e1), q AS (SELECT bucket, count(*) AS n, quantile_cont(e, 0.1) AS lo, quantile_cont(e, 0.9) AS hi FROM e1, c WHERE issue <= cut GROUP BY 1 HAVING count(*) >= 50)
SELECT bucket, count(*) AS n, round(avg(CASE WHEN e BETWEEN lo AND hi THEN 1.0 ELSE 0 END), 6) AS coverage FROM e1 JOIN q USING (bucket), c WHERE issue > cut GROUP BY 1 HAVING count(*) >= 20""")
def t23(spark, d):
    e = matrix(spark, d).where("y is not null").select("bucket", "issue", (F.col("y") - F.col("x")).alias("e"))
    cut = e.agg((F.min("issue") + 0.7 * (F.max("issue") - F.min("issue"))).alias("cut"))
    both = e.crossJoin(F.broadcast(cut))  # one row
    q = both.where("issue <= cut").groupBy("bucket").agg(F.count("*").alias("k"), F.percentile("e", F.array(F.lit(0.1), F.lit(0.9))).alias("q")).where("k >= 50")
    inside = F.when(F.col("e").between(F.col("q")[0], F.col("q")[1]), 1.0).otherwise(0.0)
    return both.where("issue > cut").join(q, "bucket").groupBy("bucket").agg(F.count("*").alias("n"), r6(F.avg(inside), "coverage")).where("n >= 20")


@query("b5_snapshot_now", f"WITH {BASE}, now AS (SELECT max(fetched) + 1 AS now FROM cyc), s AS (SELECT source, max(fetched) AS fetched, any_value(now) AS now FROM cyc, now WHERE fetched <= now AND now - fetched <= {CAP} GROUP BY 1) SELECT source, valid, (valid - now)::BIGINT AS lead, round(x, 6) AS x FROM s JOIN fx USING (source, fetched) WHERE valid >= now")
def b5(spark, d):
    cycles, forecasts, _, _ = relations(spark, d)
    now = cycles.agg((F.max("fetched") + 1).alias("issue"))
    sel = M.as_of_selection(now, cycles, CAP)
    return sel.join(forecasts, ["source", "fetched"]).where("valid >= issue").select("source", "valid", (F.col("valid") - F.col("issue")).alias("lead"), r6(F.col("x"), "x"))


@query("b7_method_per_row", f"WITH {BOARD}, m AS (SELECT bucket, method, round(avg(abs(p - y)), 6) AS mae FROM al GROUP BY 1, 2), r AS (SELECT bucket, arg_min(method, (mae, method)) AS method FROM m GROUP BY 1) SELECT fold, issue, valid, coalesce(CASE WHEN bucket = '0-1h' THEN 'equal_weight' END, r.method, 'equal_weight') AS method, round(p, 6) AS p FROM al JOIN r USING (bucket) WHERE al.method = coalesce(CASE WHEN bucket = '0-1h' THEN 'equal_weight' END, r.method, 'equal_weight')")
def b7(spark, d):
    """What is served: a pin for one bucket, else the release's winner, else equal weight."""
    al = pair(spark, d)
    m = al.groupBy("bucket", "method").agg(r6(F.avg(F.abs(F.col("p") - F.col("y"))), "mae"))
    release = m.groupBy("bucket").agg(F.min_by("method", F.struct("mae", "method")).alias("won"))
    chosen = F.coalesce(F.when(F.col("bucket") == "0-1h", "equal_weight"), F.col("won"), F.lit("equal_weight"))
    return al.join(release, "bucket").where(F.col("method") == chosen).select("fold", "issue", "valid", "method", r6(F.col("p"), "p"))


@query("ag22_funnel_layers", f"WITH {BASE} SELECT source, (SELECT count(*) FROM cyc c WHERE c.source = m.source) AS cycles, count(*) AS rows, max(lead)::BIGINT AS max_lead, count(y) AS scored FROM matrix m GROUP BY 1")
def ag22(spark, d):
    cycles = relations(spark, d)[0].groupBy("source").agg(F.count("*").alias("cycles"))
    return matrix(spark, d).groupBy("source").agg(F.count("*").alias("rows"), F.max("lead").cast("long").alias("max_lead"), F.count("y").alias("scored")).join(cycles, "source").select("source", "cycles", "rows", "max_lead", "scored")


@query("ag23_evaluation_catalogue", f"WITH {BOARD}, k AS (SELECT fold, count(*) AS n FROM al GROUP BY 1) SELECT (SELECT count(*) FROM al) AS rows, (SELECT count(DISTINCT method) FROM al) AS methods, count(*) AS folds, min(n) AS fold_min, median(n)::DOUBLE AS fold_median FROM k")
def ag23(spark, d):
    k = pair(spark, d).groupBy("fold").agg(F.count("*").alias("n"), F.collect_set("method").alias("m"))
    return k.agg(F.sum("n").alias("rows"), F.size(F.array_distinct(F.flatten(F.collect_list("m")))).cast("long").alias("methods"), F.count("*").alias("folds"), F.min("n").alias("fold_min"), F.median("n").alias("fold_median"))


@query("ag27_trend_panels", f"WITH {E}, w AS (SELECT user_id, sum(value) AS w FROM e GROUP BY 1 ORDER BY round(sum(value), 4) DESC, 1 LIMIT 8), l AS (SELECT DISTINCT us // 86400000000 AS day FROM e ORDER BY 1 DESC LIMIT 10) SELECT user_id, us // 86400000000 AS day, round(avg(value), 6) AS v FROM e SEMI JOIN w USING (user_id) WHERE us // 86400000000 IN (SELECT day FROM l) GROUP BY 1, 2")
def ag27(spark, d):
    e = events(spark, d).withColumn("day", F.floor(F.col("us") / 86_400_000_000).cast("long"))
    top = e.groupBy("user_id").agg(F.round(F.sum("value"), 4).alias("w")).orderBy(F.desc("w"), "user_id").limit(8).select("user_id")
    last = e.select("day").distinct().orderBy(F.desc("day")).limit(10)
    return e.join(F.broadcast(top), "user_id", "left_semi").join(F.broadcast(last), "day", "left_semi").groupBy("user_id", "day").agg(r6(F.avg("value"), "v"))  # eight and ten rows


@query("dz5_degraded_share", f"WITH {E}, t AS (SELECT max(us) AS now FROM e) SELECT round(count(*) FILTER (value < 30) / count(*), 6) AS share, count(*) AS n FROM e, t WHERE event_type IS NOT NULL AND us BETWEEN now - 86400000000 AND now")
def dz5(spark, d):
    e = events(spark, d).where("event_type is not null")
    now = e.agg(F.max("us").alias("now"))
    day = e.crossJoin(F.broadcast(now)).where(F.col("us").between(F.col("now") - 86_400_000_000, F.col("now")))  # one row
    return day.agg(r6(F.count_if(F.col("value") < 30) / F.count("*"), "share"), F.count("*").alias("n"))


@query("rs4_explode_minutes", f"WITH {E} SELECT us // 3600000000 AS hour, m::INTEGER AS m, round(avg(value) * (1 + m / 61.0), 6) AS v FROM e, range(1, 61) AS r(m) WHERE event_type = 'view' GROUP BY 1, m")
def rs4(spark, d):
    h = events(spark, d).where("event_type = 'view'").groupBy(F.floor(F.col("us") / 3_600_000_000).cast("long").alias("hour")).agg(F.avg("value").alias("v"))
    return h.select("hour", F.explode(F.sequence(F.lit(1), F.lit(60))).alias("m"), "v").select("hour", "m", r6(F.col("v") * (1 + F.col("m") / 61.0), "v"))


@query("rs5_source_vectors", f"WITH {BASE} SELECT issue, valid, count(x) AS k, round(list_avg(list_sort(list(x))), 6) AS mean FROM matrix GROUP BY 1, 2")
def rs5(spark, d):
    wide = matrix(spark, d).groupBy("issue", "valid").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    return wide.select("issue", "valid", F.size("xs").cast("long").alias("k"), r6(S.masked_mean(F.col("xs")), "mean"))
