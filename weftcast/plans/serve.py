"""The serving chain as a query."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.scalars import lead_bucket
from ..operators import chain as C
from ..operators import truth as T
from ..sources.scratch import session_dir, settled
from .base import events, query, r6
from .evidence import CUT, MINUTE
from .forecasts import CAP, INITIAL, PATH, STEP, matrix, minutes, observed, relations


@query("predict_now")
def predict_now(spark, d):
    """What is served after four fifths of the span: hours with their quantiles, the next hour's minutes, the method of each slice and why; written to the history and read back."""
    cycles, forecasts, truth, snapshots = relations(spark, d)
    low, high = snapshots.agg(F.min("issue"), F.max("issue")).first()
    now = low + (high - low) * 4 // 5
    folder = f"{session_dir(spark)}/served-{uuid.uuid4().hex}"
    document = C.served_at(spark, folder, now, lambda: C.predict(cycles, forecasts, truth, snapshots, now, CAP, INITIAL, STEP))
    return document.select("issue", "product", "valid", "bucket", "method", "reason", "degraded", "release_id", r6(F.col("p"), "p"), r6(F.col("q")[1], "q10"), r6(F.col("q")[17], "q90"))


def _plans_sql() -> str:
    fading = lambda t: f"CASE WHEN exp(-lead / {t}) >= 0.05 THEN exp(-lead / {t}) ELSE 0 END"
    value = {"minutely_interp": "p", "minutely_persistence": "obs", **{n: f"p + ({fading(t)}) * (obs - z)" for n, t in C.DECAYS.items()}, "minutely_anchor_full": "p + (obs - z)"}
    return f"""WITH {PATH}, {CUT}, mt AS (SELECT us // 60000000 AS minute, avg(value) AS y FROM e GROUP BY 1), f AS (SELECT issue, p0 - (CASE WHEN l1 IS NULL THEN 0 ELSE (p1 - p0) / (l1 - l0) END) * l0 AS z FROM (SELECT issue, arg_min(p, lead) AS p0, min(lead) AS l0, arg_min(p1, lead) AS p1, arg_min(l1, lead) AS l1 FROM k GROUP BY 1)),
s AS (SELECT k.issue, m / 60.0 AS lead, p + (m / 60.0 - k.lead) / (l1 - k.lead) * (p1 - p) AS p, z, truth.y AS obs, mt.y FROM k JOIN f ON f.issue = k.issue JOIN truth ON truth.valid = k.issue - 1, range(1, 61) AS r(m), mt WHERE l1 IS NOT NULL AND m >= k.lead * 60 AND m < l1 * 60 AND minute = k.issue * 60 + m),
b AS (SELECT *, {MINUTE} AS bucket FROM s), v AS ({" UNION ALL ".join(f"SELECT issue, bucket, y, '{n}' AS plan, {e} AS v FROM b" for n, e in value.items())}),
best AS (SELECT bucket, arg_min(plan, (mae, plan)) AS plan FROM (SELECT bucket, plan, round(avg(abs(v - y)), 9) AS mae FROM v, cut WHERE issue <= cut GROUP BY 1, 2) GROUP BY 1)
SELECT bucket, plan, count(*) AS n, round(avg(abs(v - y)), 6) AS mae FROM v JOIN best USING (bucket, plan), cut WHERE issue > cut GROUP BY 1, 2"""


@query("b13_minute_plans", _plans_sql())
def b13p(spark, d):
    """Which construction serves each stretch of the next hour, chosen on the first seven tenths of issues, and its error on the rest; anchored to the hour before the issue."""
    path = matrix(spark, d).where("lead <= 3").groupBy("issue", "lead").agg(F.avg("x").alias("p"))
    w = Window.partitionBy("issue").orderBy("lead")
    first = path.withColumn("l1", F.lead("lead").over(w)).withColumn("p1", F.lead("p").over(w)).where("l1 is not null").groupBy("issue").agg(F.min_by(F.struct("p", "lead", "p1", "l1"), "lead").alias("f"))
    slope = (F.col("f.p1") - F.col("f.p")) / (F.col("f.l1") - F.col("f.lead"))
    start = first.select("issue", (F.col("f.p") - slope * F.col("f.lead")).alias("start"))
    before = observed(spark, d).select((F.col("issue") + 1).alias("issue"), F.col("obs").alias("observed"))
    grid = events(spark, d).groupBy(F.floor(F.col("us") / T.MINUTE).cast("long").alias("minute")).agg(F.avg("value").alias("y"))
    hour = F.col("m") / 60
    rows = minutes(spark, d).join(start, "issue").join(before, "issue").select("issue", (F.col("issue") * 60 + F.col("m")).alias("minute"), lead_bucket(hour, "minutely").alias("bucket"), hour.alias("hour"), F.col("p").alias("path"), "observed", "start").join(grid, "minute")
    cut = matrix(spark, d).agg((F.min("issue") + F.floor(0.7 * (F.max("issue") - F.min("issue")))).alias("cut"))
    rows = settled(rows.crossJoin(F.broadcast(cut)), "minutes")  # one row
    plans = C.best_constructions(rows.where("issue <= cut"))
    served = C.planned_minutes(rows.where("issue > cut"), plans)
    return served.groupBy("bucket", F.col("construction").alias("plan")).agg(F.count("*").alias("n"), r6(F.avg(F.abs(F.col("p") - F.col("y"))), "mae"))
