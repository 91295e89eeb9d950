"""Queries on the observation log: units, quality control, truth tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import quality as Q
from ..operators import temporal as P
from ..operators import truth as T
from .base import E, events, query, r6, read


@query("pf1_units", "SELECT event_id, round(value * 5 / 9 - 160.0 / 9, 6) AS celsius, round(value * 0.44704, 6) AS ms, round(value * 33.8639, 6) AS hpa, round(value * 25.4, 6) AS mm FROM events")
def pf1(spark, d):
    v = F.col("value")
    return read(spark, d, "events").select("event_id", r6(S.converted(v, "degF"), "celsius"), r6(S.converted(v, "mph"), "ms"), r6(S.converted(v, "inHg"), "hpa"), r6(S.converted(v, "inch"), "mm"))


QC = """q0 AS (SELECT *, lag(value) OVER w AS pv, lead(value) OVER w AS nv, lag(us) OVER w AS pt, lead(us) OVER w AS nt FROM (SELECT event_id, user_id, us, floor(value / 20) * 20 AS value FROM e) WINDOW w AS (PARTITION BY user_id ORDER BY us, value)),
q1 AS (SELECT *, CASE WHEN value < 10 OR value > 200 THEN 1 ELSE 0 END AS b,
 CASE WHEN abs(value - pv) > 0.05 * greatest((us - pt) / 60e6, 1) AND abs(value - nv) > 0.05 * greatest((nt - us) / 60e6, 1) AND (value - pv) * (value - nv) > 0 THEN 2 ELSE 0 END AS s,
 sum(CASE WHEN pv IS NULL OR pv <> value OR us - pt > 4320 * 60e6 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY us, value ROWS UNBOUNDED PRECEDING) AS run FROM q0),
q2 AS (SELECT *, CASE WHEN max(us) OVER r - min(us) OVER r >= 720 * 60e6 THEN 4 ELSE 0 END AS f, CASE WHEN us - min(us) OVER r >= 720 * 60e6 THEN 4 ELSE 0 END AS cf FROM q1 WINDOW r AS (PARTITION BY user_id, run))"""


def log(spark, d):
    return events(spark, d).select("event_id", "user_id", "us", (F.floor(F.col("value") / 20) * 20).cast("double").alias("value"))


def qc(df, causal=False):
    return Q.checked(df, "value", "us", ["user_id"], low=10, high=200, per_minute=0.05, flat_minutes=720, gap_minutes=4320, causal=causal)


@query("pf2_pf5_quality_flags", f"WITH {E}, {QC} SELECT event_id, (b | s | f)::INTEGER AS qc, CASE WHEN (b | s | f) = 0 THEN value END AS masked FROM q2")
def pf5(spark, d):
    return qc(log(spark, d)).select("event_id", F.col("qc").cast("int").alias("qc"), Q.masked("value").alias("masked"))


@query("pf5_causal_flags", f"WITH {E}, {QC} SELECT event_id, (b | cf)::INTEGER AS qc FROM q2")
def pf5c(spark, d):
    return qc(log(spark, d), causal=True).select("event_id", F.col("qc").cast("int").alias("qc"))


@query("pf6_quality_summary", f"WITH {E}, {QC} SELECT user_id % 7 AS station, count(*) AS samples, count(*) FILTER (value IS NULL) AS missing, count(*) FILTER (b = 1) AS out_of_bounds, count(*) FILTER (s = 2) AS spikes, count(*) FILTER (f = 4) AS flat, count(*) FILTER ((b | s | f) = 0) AS clean FROM q2 GROUP BY 1")
def pf6(spark, d):
    return Q.summary(qc(log(spark, d)).withColumn("station", F.col("user_id") % 7), ["station"])


@query("pf8_cross_source_outliers", f"""WITH {E}, c AS (SELECT us // 3600000000 AS hour, event_type AS source, avg(value) AS v FROM e GROUP BY 1, 2),
m AS (SELECT *, abs(v - median(v) OVER (PARTITION BY hour)) AS dev, count(v) OVER (PARTITION BY hour) AS k FROM c),
x AS (SELECT *, k >= 4 AND dev > greatest(1.2 * 1.4826 * median(dev) OVER (PARTITION BY hour), 3.0) AS far FROM m)
SELECT hour, source, round(CASE WHEN NOT far THEN v END, 6) AS v FROM x""")
def pf8(spark, d):
    cells = events(spark, d).groupBy(F.floor(F.col("us") / T.HOUR).cast("long").alias("hour"), F.col("event_type").alias("source")).agg(F.avg("value").alias("v"))
    return Q.cross_source_masked(cells, ["hour"], "v", floor=3.0, times=1.2).select("hour", "source", r6(F.col("v"), "v"))


@query("pf10_lead_caps", "WITH c(event_type, cap) AS (SELECT event_type, 5 + row_number() OVER (ORDER BY event_type) * 3 FROM (SELECT DISTINCT event_type FROM events)) SELECT event_id, CASE WHEN event_type = 'click' AND hour(ts) = 3 THEN NULL ELSE round(value, 6) END AS value FROM events JOIN c USING (event_type) WHERE hour(ts) <= cap")
def pf10(spark, d):
    e = read(spark, d, "events")
    caps = e.select("event_type").distinct().withColumn("cap", 5 + 3 * F.row_number().over(Window.orderBy("event_type")))  # one row a source
    kept = e.join(caps, "event_type").where(F.hour("ts") <= F.col("cap"))
    return kept.select("event_id", F.when(~((F.col("event_type") == "click") & (F.hour("ts") == 3)), F.round("value", 6)).alias("value"))


BUCKETS = "CASE " + " ".join(f"WHEN lead >= {a} AND lead < {b} THEN '{n}'" if b != float("inf") else f"WHEN lead >= {a} THEN '{n}'" for a, b, n in S.LEAD_EDGES["hourly"]) + " END"


@query("pf12_lead_buckets", f"WITH l AS (SELECT l_shipdate::DATE - o_orderdate::DATE AS lead FROM lineitem JOIN orders ON l_orderkey = o_orderkey) SELECT {BUCKETS} AS bucket, count(*) AS n, sum(lead)::BIGINT AS total FROM l GROUP BY 1")
def pf12(spark, d):
    lead = F.datediff(F.col("l_shipdate").cast("date"), F.col("o_orderdate").cast("date"))
    rows = read(spark, d, "lineitem").join(read(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(lead.alias("lead"))
    return rows.groupBy(S.lead_bucket(F.col("lead")).alias("bucket")).agg(F.count("*").alias("n"), F.sum("lead").cast("long").alias("total"))


@query("ag1_hourly_truth", f"WITH {E} SELECT event_type, us // 3600000000 AS hour, round(CASE WHEN count(DISTINCT us // 60000000) / 3.0 >= 0.8 THEN avg(value) END, 6) AS mean, round(count(DISTINCT us // 60000000) / 3.0, 6) AS coverage, round(max(value), 6) AS peak FROM e GROUP BY 1, 2")
def ag1(spark, d):
    return T.hourly(events(spark, d), ["event_type"], "value", expected=3).select("event_type", "hour", r6(F.col("mean"), "mean"), r6(F.col("coverage"), "coverage"), r6(F.col("peak"), "peak"))


@query("ag2_instantaneous", f"""WITH {E}, h AS (SELECT *, (us + 1800000000) // 3600000000 AS hour FROM e), o AS (SELECT *, abs(us - hour * 3600000000) AS off FROM h)
SELECT hour, round(coalesce(avg(value) FILTER (off <= 300000000), avg(value)), 6) AS instant FROM o WHERE off <= 600000000 GROUP BY 1""")
def ag2(spark, d):
    return T.instantaneous(events(spark, d), [], "value").select("hour", r6(F.col("instant"), "instant"))


COUNTER = """c0 AS (SELECT user_id, us, value AS c, lag(value) OVER w AS b, us - lag(us) OVER w AS gap FROM e WINDOW w AS (PARTITION BY user_id ORDER BY us, value)),
c1 AS (SELECT *, sum(CASE WHEN c < 0.5 * b THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY us, c ROWS UNBOUNDED PRECEDING) AS epoch FROM c0),
c2 AS (SELECT *, max(c) OVER (PARTITION BY user_id, epoch ORDER BY us, c ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS high FROM c1),
c3 AS (SELECT *, CASE WHEN b IS NULL OR gap > 2880 * 60e6 THEN NULL WHEN c < 0.5 * b THEN c ELSE greatest(c - high, 0) END AS delta FROM c2)"""


@query("ag3_counter_deltas", f"WITH {E}, {COUNTER} SELECT user_id, us, round(c, 6) AS c, round(delta, 6) AS delta FROM c3")
def ag3(spark, d):
    return T.counter_deltas(events(spark, d), ["user_id"], "value", max_gap_minutes=2880).select("user_id", "us", r6(F.col("value"), "c"), r6(F.col("delta"), "delta"))


@query("ag4_hourly_rain", f"WITH {E}, {COUNTER} SELECT us // 3600000000 AS hour, round(coalesce(sum(delta), 0), 6) AS amount, CASE WHEN coalesce(sum(delta), 0) >= 50 THEN 1.0 ELSE 0.0 END::DOUBLE AS pop FROM c3 GROUP BY 1")
def ag4(spark, d):
    rows = T.counter_deltas(events(spark, d), ["user_id"], "value", max_gap_minutes=2880)
    return rows.groupBy(F.floor(F.col("us") / T.HOUR).cast("long").alias("hour")).agg(F.coalesce(F.sum("delta"), F.lit(0.0)).alias("a")).select("hour", r6(F.col("a"), "amount"), F.when(F.col("a") >= 50, 1.0).otherwise(0.0).alias("pop"))


@query("ag5_daily_truth", """WITH z AS (SELECT *, timezone('America/Los_Angeles', timezone('UTC', ts))::DATE AS d FROM events),
g AS (SELECT d, max(value) AS high, min(value) AS low, count(DISTINCT epoch_us(ts) // 60000000) AS m FROM z GROUP BY 1),
k AS (SELECT *, m / ((epoch(timezone('America/Los_Angeles', (d + 1)::TIMESTAMP)) - epoch(timezone('America/Los_Angeles', d::TIMESTAMP))) / 60) AS coverage FROM g)
SELECT (d - DATE '1970-01-01')::INTEGER AS day, round(CASE WHEN coverage >= 0.02 THEN high END, 6) AS high, round(CASE WHEN coverage >= 0.02 THEN low END, 6) AS low, round(coverage, 6) AS coverage FROM k""")
def ag5(spark, d):
    rows = events(spark, d).withColumn("ts", F.col("ts").cast("timestamp"))
    return T.daily(rows, [], "value", "ts", "America/Los_Angeles", 0.02).select(F.unix_date("day").alias("day"), *[r6(F.col(c), c) for c in ("high", "low", "coverage")])


@query("ag6_minute_grid", f"WITH {E} SELECT us // 60000000 AS minute, round(avg(value), 6) AS value FROM e GROUP BY 1")
def ag6(spark, d):
    return events(spark, d).groupBy(F.floor(F.col("us") / T.MINUTE).cast("long").alias("minute")).agg(r6(F.avg("value"), "value"))


@query("ag7_snapshot_times", f"WITH {E} SELECT us // 600000000 AS slot, max(us) AS completed FROM e WHERE event_type = 'purchase' GROUP BY 1")
def ag7(spark, d):
    return events(spark, d).where("event_type = 'purchase'").groupBy(F.floor(F.col("us") / 600_000_000).cast("long").alias("slot")).agg(F.max("us").alias("completed"))


@query("w5_partition_median", f"WITH {E} SELECT event_id, round(value - median(value) OVER (PARTITION BY us // 3600000000), 6) AS dev, count(value) OVER (PARTITION BY us // 3600000000) AS k FROM e")
def w5(spark, d):
    w = Window.partitionBy(F.floor(F.col("us") / T.HOUR))
    return events(spark, d).select("event_id", r6(F.col("value") - F.median("value").over(w), "dev"), F.count("value").over(w).alias("k"))


@query("w6_range_median", f"WITH {E} SELECT event_id, round(median(value) OVER w, 6) AS med, count(*) OVER w AS n FROM e WINDOW w AS (PARTITION BY event_type ORDER BY us RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW)")
def w6(spark, d):
    return P.rolling_median(events(spark, d), "value", ["event_type"], "us", T.HOUR, "med", "n").select("event_id", r6(F.col("med"), "med"), "n")


@query("w7_rolling_correlation", f"""WITH {E}, h AS (SELECT us // 3600000000 AS hour, avg(value) FILTER (event_type = 'click') AS a, avg(value) FILTER (event_type = 'view') AS b FROM e GROUP BY 1),
c AS (SELECT hour, count(CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN 1 END) OVER w AS n, corr(a, b) OVER w AS r FROM h WINDOW w AS (ORDER BY hour ROWS 71 PRECEDING))
SELECT hour, round(CASE WHEN n >= 36 AND NOT isnan(r) THEN r END, 6) AS r FROM c""")
def w7(spark, d):
    pick = lambda t: F.avg(F.when(F.col("event_type") == t, F.col("value")))
    hours = events(spark, d).groupBy(F.floor(F.col("us") / T.HOUR).cast("long").alias("hour")).agg(pick("click").alias("a"), pick("view").alias("b"))
    rows = P.in_slices(P.numbered(hours, "hour", 24 * 365), "__number", 4096, 72)
    r = P.rolling_correlation("a", "b", Window.partitionBy("__slice").orderBy("__number").rowsBetween(-71, 0), 36)
    return rows.withColumn("r", r).where("__own").select("hour", r6(F.col("r"), "r"))


@query("w8_forward_fill", f"WITH {E} SELECT event_id, round(last_value(CASE WHEN value > 60 THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING), 6) AS filled FROM e")
def w8(spark, d):
    rows = events(spark, d).withColumn("v", F.when(F.col("value") > 60, F.col("value")))
    w = Window.partitionBy("user_id").orderBy("us", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return rows.select("event_id", r6(F.last("v", ignorenulls=True).over(w), "filled"))


@query("w11_keep_last", f"WITH {E} SELECT user_id, event_type, event_id, round(value, 6) AS value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY us DESC, event_id DESC) AS k FROM e) WHERE k = 1")
def w11(spark, d):
    return P.one_each(events(spark, d), ["user_id", "event_type"], [F.desc("us"), F.desc("event_id")]).select("user_id", "event_type", "event_id", r6(F.col("value"), "value"))


@query("w12_regime_runs", f"""WITH {E}, h AS (SELECT us // 3600000000 AS hour, event_type, sum(value) AS v FROM e GROUP BY 1, 2), l AS (SELECT hour, arg_max(event_type, (v, event_type)) AS leader FROM h GROUP BY 1),
s AS (SELECT *, CASE WHEN lag(leader) OVER (ORDER BY hour) IS DISTINCT FROM leader THEN 1 ELSE 0 END AS new FROM l), r AS (SELECT *, sum(new) OVER (ORDER BY hour) AS run FROM s)
SELECT run::BIGINT AS run, min(leader) AS leader, min(hour) AS start, count(*) AS hours FROM r GROUP BY 1 HAVING count(*) >= 2""")
def w12(spark, d):
    hours = events(spark, d).groupBy(F.floor(F.col("us") / T.HOUR).cast("long").alias("hour"), "event_type").agg(F.sum("value").alias("v"))
    leader = hours.groupBy("hour").agg(F.max_by("event_type", F.struct("v", "event_type")).alias("leader"))
    rows = P.in_slices(P.numbered(leader, "hour", 24 * 365), "__number", 4096, 1)
    breaks = ~F.lag("leader").over(Window.partitionBy("__slice").orderBy("__number")).eqNullSafe(F.col("leader"))
    runs = P.cumulative(rows.withColumn("new", breaks).where("__own"), "__slice", ["__number"], F.col("new").cast("long"), "run")
    return runs.groupBy("run").agg(F.min("leader").alias("leader"), F.min("hour").alias("start"), F.count("*").alias("hours")).where("hours >= 2")


@query("w14_running_extremes", f"WITH {E} SELECT event_id, round(min(value) OVER w, 6) AS low, round(max(value) OVER w, 6) AS high FROM e WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING)")
def w14(spark, d):
    w = Window.partitionBy("user_id").orderBy("us", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return events(spark, d).select("event_id", r6(F.min("value").over(w), "low"), r6(F.max("value").over(w), "high"))


@query("sc4_sc5_physics", """SELECT s_suppkey, round(CASE WHEN h > 0 AND h <= 100 THEN 243.04 * g / (17.625 - g) END, 6) AS dew, round(p * pow(1 - 9.1 / (t + 9.1 + 273.15), -5.257), 6) AS slp
FROM (SELECT *, ln(h / 100) + 17.625 * t / (243.04 + t) AS g FROM (SELECT s_suppkey, s_acctbal / 300 AS t, 1.0 + s_suppkey % 99 AS h, 840 + s_acctbal / 500 AS p FROM supplier))""")
def sc4(spark, d):
    s = read(spark, d, "supplier").select("s_suppkey", (F.col("s_acctbal") / 300).alias("t"), (1.0 + F.col("s_suppkey") % 99).alias("h"), (840 + F.col("s_acctbal") / 500).alias("p"))
    return s.select("s_suppkey", r6(S.dew_point_c(F.col("t"), F.col("h")), "dew"), r6(S.sea_level_hpa(F.col("p"), F.col("t"), 1400.0), "slp"))


@query("sc6_sc7_sun", f"""WITH {E}, a AS (SELECT event_id, dayofyear(ts) - 1 AS d, dayofyear(ts) AS doy, hour(ts) + minute(ts) / 60.0 + floor(second(ts)) / 3600.0 AS h FROM e), b AS (SELECT *, 2 * pi() / 365 * (d + (h - 12) / 24) AS g FROM a),
c AS (SELECT *, 229.18 * (0.000075 + 0.001868 * cos(g) - 0.032077 * sin(g) - 0.014615 * cos(2 * g) - 0.040849 * sin(2 * g)) AS q, 0.006918 - 0.399912 * cos(g) + 0.070257 * sin(g) - 0.006758 * cos(2 * g) + 0.000907 * sin(2 * g) - 0.002697 * cos(3 * g) + 0.00148 * sin(3 * g) AS dc FROM b),
m AS (SELECT *, h * 60 + q + 4 * -117.1692 AS raw FROM c), k AS (SELECT *, radians((raw - 1440 * floor(raw / 1440)) / 4 - 180) AS w FROM m),
s AS (SELECT *, degrees(asin(greatest(-1, least(1, sin(radians(34.2768)) * sin(dc) + cos(radians(34.2768)) * cos(dc) * cos(w))))) AS el FROM k)
SELECT event_id, round(el, 6) AS elevation, round(1361 * (1 + 0.033 * cos(2 * pi() * doy / 365)) * greatest(sin(radians(el)), 0), 5) AS toa FROM s""")
def sc6(spark, d):
    ts = F.col("ts").cast("timestamp")
    el = S.solar_elevation_deg(ts, 34.2768, -117.1692)
    return read(spark, d, "events").select("event_id", r6(el, "elevation"), F.round(S.toa_irradiance(ts, el), 5).alias("toa"))


@query("sc8_sc9_calendar", "SELECT event_id, round(sin(2 * pi() * hour(ts) / 24), 6) AS hs, round(cos(2 * pi() * hour(ts) / 24), 6) AS hc, hour(timezone('America/Los_Angeles', timezone('UTC', ts)))::INTEGER AS local_hour, month(timezone('America/Los_Angeles', timezone('UTC', ts)))::INTEGER AS local_month FROM events")
def sc8(spark, d):
    s, c = S.cyclical(F.hour("ts"), 24)
    local = F.from_utc_timestamp(F.col("ts").cast("timestamp"), "America/Los_Angeles")
    return read(spark, d, "events").select("event_id", r6(s, "hs"), r6(c, "hc"), F.hour(local).alias("local_hour"), F.month(local).alias("local_month"))


@query("sc10_haversine", """WITH p AS (SELECT n_nationkey, n_nationkey * 3.0 - 30 AS lat, n_nationkey * 7.0 - 90 AS lon FROM nation)
SELECT a.n_nationkey AS a, b.n_nationkey AS b, round(2 * 6371 * asin(sqrt(least(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2), 1))), 5) AS km FROM p a JOIN p b ON a.n_nationkey < b.n_nationkey""")
def sc10(spark, d):
    p = read(spark, d, "nation").select("n_nationkey", (F.col("n_nationkey") * 3.0 - 30).alias("lat"), (F.col("n_nationkey") * 7.0 - 90).alias("lon"))
    a, b = p.alias("a"), p.alias("b")
    km = S.haversine_km(F.col("a.lat"), F.col("a.lon"), F.col("b.lat"), F.col("b.lon"))
    return a.join(b, F.col("a.n_nationkey") < F.col("b.n_nationkey")).select(F.col("a.n_nationkey").alias("a"), F.col("b.n_nationkey").alias("b"), F.round(km, 5).alias("km"))


@query("sc19_sc21_text", "SELECT p_partkey, replace(replace(p_name || '__50%', '%', '%25'), '__', '%5F%5F') AS encoded, p_name || '__50%' AS decoded, substr(sha256(p_name || chr(31) || p_brand), 1, 16) AS id, split_part(p_brand, '#', 2) AS part, starts_with(p_name, 'a') AS a FROM part")
def sc19(spark, d):
    name = F.concat("p_name", F.lit("__50%"))
    return read(spark, d, "part").select("p_partkey", S.encoded_segment(name).alias("encoded"), S.decoded_segment(S.encoded_segment(name)).alias("decoded"), S.short_id(F.col("p_name"), F.col("p_brand")).alias("id"), F.split_part("p_brand", F.lit("#"), F.lit(2)).alias("part"), F.startswith("p_name", F.lit("a")).alias("a"))
