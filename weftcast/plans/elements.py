"""Queries on single elements of the engine: flags, filters, windows, order statistics, sets and scalar rules."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import quality as Q
from ..operators import temporal as P
from .base import E, events, query, r6, read
from .forecasts import BASE, matrix
from .observations import QC, log
from .reports import BOARD, pair


@query("pf3_spike_flags", f"WITH {E}, {QC} SELECT event_id, s::INTEGER AS spike FROM q2")
def pf3(spark, d):
    return log(spark, d).withColumn("spike", Q.spike_flag("value", "us", ["user_id"], 0.05).cast("int")).select("event_id", "spike")


@query("pf4_flatline_flags", f"WITH {E}, {QC} SELECT event_id, f::INTEGER AS flat FROM q2")
def pf4(spark, d):
    return Q.with_flatline(log(spark, d), "value", "us", ["user_id"], 720, 4320).select("event_id", F.col("flat").cast("int").alias("flat"))


@query("pf7_absolute_bounds", "SELECT event_id, CASE WHEN value >= 10 AND value <= 200 THEN value END AS value FROM events")
def pf7(spark, d):
    return read(spark, d, "events").select("event_id", F.when(S.bounds_flag(F.col("value"), 10, 200) == 0, F.col("value")).alias("value"))


ODD = "CASE event_id % 5 WHEN 0 THEN 'nan'::DOUBLE WHEN 1 THEN 'inf'::DOUBLE WHEN 2 THEN NULL ELSE value END"


@query("pf13_finite_truth", f"SELECT event_id, x AS value FROM (SELECT event_id, {ODD} AS x FROM events) WHERE isfinite(x)")
def pf13(spark, d):
    k = F.col("event_id") % 5
    x = F.when(k == 0, float("nan")).when(k == 1, float("inf")).when(k > 2, F.col("value"))
    return read(spark, d, "events").select("event_id", x.alias("value")).where(S.finite(F.col("value")))


@query("w3_epoch_peaks", f"""WITH {E}, a AS (SELECT *, lag(value) OVER (PARTITION BY user_id ORDER BY us, event_id) AS b FROM e), c AS (SELECT *, sum(CASE WHEN value < 0.5 * b THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS epoch FROM a)
SELECT event_id, epoch::BIGINT AS epoch, max(value) OVER (PARTITION BY user_id, epoch ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS peak FROM c""")
def w3(spark, d):
    """The highest value so far since the counter last fell by more than half."""
    order = ["us", "event_id"]
    fell = F.col("value") < 0.5 * F.lag("value").over(Window.partitionBy("user_id").orderBy(*order))
    peak = F.max("value").over(Window.partitionBy("user_id", "epoch").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return P.islands(events(spark, d), ["user_id"], order, fell, "epoch").select("event_id", F.col("epoch").cast("long").alias("epoch"), peak.alias("peak"))


@query("w4_run_spans", f"""WITH {E}, a AS (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY us, event_id) AS b FROM e), c AS (SELECT *, sum(CASE WHEN b IS NULL OR b <> event_type THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS run FROM a)
SELECT user_id, run::BIGINT AS run, any_value(event_type) AS event_type, arg_min(value, (us, event_id)) AS first_value, max(us) - min(us) AS span_us, count(*) AS n FROM c GROUP BY user_id, run""")
def w4(spark, d):
    """Runs of one kind of event: their first value, span and length."""
    before = F.lag("event_type").over(Window.partitionBy("user_id").orderBy("us", "event_id"))
    runs = P.islands(events(spark, d), ["user_id"], ["us", "event_id"], before.isNull() | (before != F.col("event_type")), "run")
    out = runs.groupBy("user_id", F.col("run").cast("long").alias("run"))
    return out.agg(F.first("event_type").alias("event_type"), F.min_by("value", F.struct("us", "event_id")).alias("first_value"), (F.max("us") - F.min("us")).alias("span_us"), F.count("*").alias("n"))


@query("w10_newest_complete", "SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS newest FROM orders GROUP BY 1 HAVING count(DISTINCT CASE WHEN o_orderstatus IN ('F', 'O') THEN o_orderstatus END) = 2")
def w10(spark, d):
    """The newest order of the customers who have orders of both references, without a join."""
    both = F.count_distinct(F.when(F.col("o_orderstatus").isin("F", "O"), F.col("o_orderstatus")))
    return read(spark, d, "orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("newest"), both.alias("k")).where("k = 2").drop("k")


@query("st2_newest_three", f"WITH {E} SELECT user_id, event_id, nth::INTEGER AS nth FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY us DESC, event_id DESC) AS nth FROM e) WHERE nth <= 3")
def st2(spark, d):
    """The report keeps three events a user: the limit is the feature."""
    nth = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("us"), F.desc("event_id")))
    return events(spark, d).select("user_id", "event_id", nth.alias("nth")).where("nth <= 3")


@query("st6_order_statistics", f"WITH {E}, a AS (SELECT event_type, us // 86400000000 AS day, value, row_number() OVER w AS k, count(*) OVER (PARTITION BY event_type, us // 86400000000) AS n FROM e WINDOW w AS (PARTITION BY event_type, us // 86400000000 ORDER BY value)) SELECT event_type, day, value AS bound, n FROM a WHERE k = least(n, ceil((n + 1) * 0.8))")
def st6(spark, d):
    """The finite-sample bound of level 0.8 of each kind and day."""
    rows = events(spark, d).select("event_type", F.floor(F.col("us") / 86_400_000_000).cast("long").alias("day"), "value")
    by = Window.partitionBy("event_type", "day")
    ranked = rows.withColumn("k", F.row_number().over(by.orderBy("value"))).withColumn("n", F.count("*").over(by))
    return ranked.where(F.col("k") == F.least(F.col("n"), F.ceil((F.col("n") + 1) * F.lit(0.8)).cast("long"))).select("event_type", "day", F.col("value").alias("bound"), "n")


@query("se2_distinct", "SELECT DISTINCT user_id, event_type FROM events")
def se2(spark, d):
    return read(spark, d, "events").select("user_id", "event_type").distinct()


@query("se4_intersect", "SELECT l_suppkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45 INTERSECT SELECT l_suppkey FROM lineitem WHERE l_returnflag = 'A' AND l_quantity > 45")
def se4(spark, d):
    rows = read(spark, d, "lineitem").where("l_quantity > 45")
    return rows.where("l_returnflag = 'R'").select("l_suppkey").intersect(rows.where("l_returnflag = 'A'").select("l_suppkey"))


@query("sc12_clipped", "SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN greatest(20.0, least(100.0, value)) END AS value FROM events")
def sc12(spark, d):
    return read(spark, d, "events").select("event_id", S.clipped(F.when(F.col("event_id") % 7 != 0, F.col("value")), 20, 100).alias("value"))


@query("sc14_renormalised", """WITH a AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_discount > 0.02 THEN l_quantity END AS v, l_tax + 0.01 AS w FROM lineitem)
SELECT l_orderkey, round(sum(v * w) / nullif(sum(w) FILTER (v IS NOT NULL), 0), 6) AS mean FROM a GROUP BY 1""")
def sc14(spark, d):
    """Weights shared out anew among the lines available; an array holds the lines of one order."""
    v, w = F.when(F.col("l_discount") > 0.02, F.col("l_quantity")).cast("double"), (F.col("l_tax") + 0.01).cast("double")
    lines = read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", v.alias("v"), w.alias("w")))).alias("a"))
    return lines.select("l_orderkey", r6(S.renormalised(F.col("a.v"), F.col("a.w")), "mean"))


@query("sc16_anchor_weights", "SELECT event_id, round(CASE WHEN exp(-hour(ts) / 6.0) >= 0.05 THEN exp(-hour(ts) / 6.0) ELSE 0 END, 6) AS weight FROM events")
def sc16(spark, d):
    return read(spark, d, "events").select("event_id", r6(S.anchor_weight(F.hour("ts"), 6.0), "weight"))


@query("sc17_lead_zero", "WITH m AS (SELECT l_orderkey, l_linenumber AS x, avg(l_quantity) AS y FROM lineitem GROUP BY 1, 2), a AS (SELECT *, lead(x) OVER w AS x2, lead(y) OVER w AS y2, row_number() OVER w AS k FROM m WINDOW w AS (PARTITION BY l_orderkey ORDER BY x)) SELECT l_orderkey, round(y - (y2 - y) * x / (x2 - x), 6)::DOUBLE AS at_zero FROM a WHERE k = 1 AND x2 IS NOT NULL")
def sc17(spark, d):
    """A line through the first two points, read at zero."""
    w = Window.partitionBy("l_orderkey").orderBy("x")
    points = read(spark, d, "lineitem").groupBy("l_orderkey", F.col("l_linenumber").alias("x")).agg(F.avg("l_quantity").cast("double").alias("y"))
    rows = points.select("*", F.lead("x").over(w).alias("x2"), F.lead("y").over(w).alias("y2"), F.row_number().over(w).alias("k"))
    return rows.where("k = 1 and x2 is not null").select("l_orderkey", r6(F.expr("y - (y2 - y) * x / (x2 - x)"), "at_zero"))


@query("sc22_heat_classes", "SELECT event_id, CASE WHEN value < 20 THEN 0 WHEN value < 40 THEN 1 WHEN value < 60 THEN 2 WHEN value < 80 THEN 3 ELSE 4 END AS heat FROM events")
def sc22(spark, d):
    edges = F.array(*[F.lit(float(x)) for x in (20, 40, 60, 80)])
    return read(spark, d, "events").select("event_id", F.size(F.filter(edges, lambda x: x <= F.col("value"))).alias("heat"))


@query("sc23_segments", "SELECT o_orderkey, split_part(o_orderpriority, '-', 1) AS head, starts_with(o_orderpriority, '1') AS urgent FROM orders")
def sc23(spark, d):
    p = F.col("o_orderpriority")
    return read(spark, d, "orders").select("o_orderkey", F.split_part(p, F.lit("-"), F.lit(1)).alias("head"), F.startswith(p, F.lit("1")).alias("urgent"))


@query("sc24_level_grids", "WITH m AS (SELECT l_orderkey, l_linenumber AS k, sum(l_quantity)::BIGINT AS q FROM lineitem GROUP BY 1, 2) SELECT l_orderkey, string_agg(k || ':' || q, ',' ORDER BY k) AS grid FROM m GROUP BY 1")
def sc24(spark, d):
    """Maps of a level to a value, told in the order of the levels."""
    cells = read(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.sum("l_quantity").cast("long").alias("q"))
    grid = F.map_from_entries(F.collect_list(F.struct("l_linenumber", "q")))
    told = F.transform(F.array_sort(F.map_entries(grid)), lambda x: F.concat_ws(":", x["key"].cast("string"), x["value"].cast("string")))
    return cells.groupBy("l_orderkey").agg(F.concat_ws(",", told).alias("grid"))


@query("t1_deterministic_scores", f"WITH {BOARD} SELECT method, bucket, count(*) AS n, round(avg(abs(p - y)), 6) AS mae, round(sqrt(avg((p - y) * (p - y))), 6) AS rmse, round(avg(p - y), 6) AS bias, round(avg(CASE WHEN abs(p - y) <= 20 THEN 1.0 ELSE 0.0 END), 6) AS within FROM al WHERE p IS NOT NULL GROUP BY 1, 2")
def t1(spark, d):
    e = F.col("p") - F.col("y")
    scores = (F.count("*").alias("n"), r6(F.avg(F.abs(e)), "mae"), r6(F.sqrt(F.avg(e * e)), "rmse"), r6(F.avg(e), "bias"), r6(F.avg(F.when(F.abs(e) <= 20, 1.0).otherwise(0.0)), "within"))
    return pair(spark, d).where("p is not null").groupBy("method", "bucket").agg(*scores)


@query("t6_horizon_rule", f"WITH {BOARD} SELECT bucket, least(max(valid - issue) + 1, 48, count(*) - 1)::BIGINT AS horizon FROM pe GROUP BY 1")
def t6(spark, d):
    """Lags of the variance of score differences: the longest lead and one more, 48 and n - 1 at most."""
    rows = pair(spark, d).where("method = 'equal_weight'").groupBy("bucket").agg(F.max(F.col("valid") - F.col("issue")).alias("lead"), F.count("*").alias("n"))
    return rows.select("bucket", F.least(F.col("lead") + 1, F.lit(48), F.col("n") - 1).cast("long").alias("horizon"))


@query("b6_training_as_of", f"WITH {BASE}, n AS (SELECT max(issue) - 240 AS now FROM snaps) SELECT source, bucket, count(*) AS n, round(avg(y - x), 6) AS bias FROM matrix, n WHERE issue <= now AND valid + 2 <= now AND y IS NOT NULL GROUP BY 1, 2")
def b6(spark, d):
    """What a model trained ten days before the last snapshot could know."""
    rows = matrix(spark, d)
    now = events(spark, d).select(F.floor(F.col("us") / 3_600_000_000).cast("long").alias("h")).agg((F.max("h") - 240).alias("now"))
    known = rows.join(F.broadcast(now), (F.col("issue") <= F.col("now")) & (F.col("valid") + 2 <= F.col("now"))).where("y is not null")  # one row
    return known.groupBy("source", "bucket").agg(F.count("*").alias("n"), r6(F.avg(F.col("y") - F.col("x")), "bias"))
