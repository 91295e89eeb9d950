"""Queries on scores and ledgers: joins, boards, verification, reliability, dashboards."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import relations as R
from ..operators import temporal as P
from .base import E, events, query, r6, read
from .forecasts import BASE, BIAS, MEAN, WINNERS, board, matrix, score  # noqa: F401

BOARD = f"""{BASE}, {BIAS}, {MEAN.format(rows='test').replace('pred AS', 'pe AS')}, {MEAN.format(rows='gtest').replace('pred AS', 'pg AS')},
al AS (SELECT 'equal_weight' AS method, * FROM pe UNION ALL SELECT 'grounded_equal_weight', * FROM pg)"""


def pair(spark, d):
    return board(spark, d, WINNERS[1:])


@query("j5_left_blocks", "SELECT c_custkey, c_nationkey, n_name, r_name, coalesce(k, 0)::BIGINT AS orders FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey LEFT JOIN (SELECT o_custkey, count(*) AS k FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def j5(spark, d):
    c, n, r = (read(spark, d, t) for t in ("customer", "nation", "region"))
    k = read(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("k"))
    out = c.join(n, c["c_nationkey"] == n["n_nationkey"], "left").join(r, n["n_regionkey"] == r["r_regionkey"], "left").join(k, c["c_custkey"] == k["o_custkey"], "left")
    return out.select("c_custkey", "c_nationkey", "n_name", "r_name", F.coalesce("k", F.lit(0)).cast("long").alias("orders"))


@query("j6_full_outer", f"WITH {E}, a AS (SELECT us // 3600000000 AS hour, avg(value) AS a FROM e WHERE event_type = 'click' GROUP BY 1), b AS (SELECT us // 3600000000 AS hour, avg(value) AS b FROM e WHERE event_type = 'view' GROUP BY 1) SELECT hour, round(a, 6) AS a, round(b, 6) AS b FROM a FULL JOIN b USING (hour)")
def j6(spark, d):
    e = events(spark, d).withColumn("hour", F.floor(F.col("us") / 3_600_000_000).cast("long"))
    side = lambda t, n: e.where(F.col("event_type") == t).groupBy("hour").agg(r6(F.avg("value"), n))
    return side("click", "a").join(side("view", "b"), "hour", "full")


@query("j7_paired_cases", f"WITH {BOARD} SELECT bucket, count(*) AS n, round(avg(abs(a.p - a.y) - abs(b.p - b.y)), 6) AS diff FROM al a JOIN al b USING (fold, issue, valid, bucket) WHERE a.method = 'equal_weight' AND b.method = 'grounded_equal_weight' GROUP BY 1")
def j7(spark, d):
    m = pair(spark, d).withColumn("l", F.abs(F.col("p") - F.col("y")))
    pick = lambda t: F.max(F.when(F.col("method") == t, F.col("l")))
    cases = m.groupBy("fold", "issue", "valid", "bucket").agg(pick("equal_weight").alias("a"), pick("grounded_equal_weight").alias("b")).where("a is not null and b is not null")
    return cases.groupBy("bucket").agg(F.count("*").alias("n"), r6(F.avg(F.col("a") - F.col("b")), "diff"))


@query("j8_common_cases", f"WITH {BASE}, k AS (SELECT issue, valid FROM matrix GROUP BY 1, 2 HAVING count(DISTINCT source) = (SELECT count(DISTINCT source) FROM matrix)) SELECT source, count(*) AS n, round(avg(x), 6) AS x FROM matrix SEMI JOIN k USING (issue, valid) GROUP BY 1")
def j8(spark, d):
    return R.common_cases(matrix(spark, d), ["issue", "valid"], "source").groupBy("source").agg(F.count("*").alias("n"), r6(F.avg("x"), "x"))


@query("j9_novel_rows", "WITH a AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_custkey END AS k FROM orders WHERE o_orderkey % 2 = 0), b AS (SELECT DISTINCT CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_custkey END AS k FROM orders WHERE o_orderkey % 3 = 0) SELECT o_orderkey, k FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.k IS NOT DISTINCT FROM a.k)")
def j9(spark, d):
    o = read(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 5 != 0, F.col("o_custkey")).alias("k"))
    return R.novel(o.where("o_orderkey % 2 = 0"), o.where("o_orderkey % 3 = 0").select("k").distinct().select(F.col("k")), ["k"])


@query("j11_proximity", "SELECT a.s_suppkey AS a, b.s_suppkey AS b, round(abs(a.s_acctbal - b.s_acctbal), 6) AS gap FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey WHERE abs(a.s_acctbal - b.s_acctbal) <= 500")
def j11(spark, d):
    # Bands as wide as the tolerance: what is near is in the same band or a neighbouring one, so only these meet.
    s = read(spark, d, "supplier").withColumn("band", F.floor(F.col("s_acctbal") / 500))
    a, b = s.alias("a"), s.withColumn("band", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1))).alias("b")
    gap = F.abs(F.col("a.s_acctbal") - F.col("b.s_acctbal"))
    return a.join(b, (F.col("a.s_nationkey") == F.col("b.s_nationkey")) & (F.col("a.band") == F.col("b.band")) & (F.col("a.s_suppkey") < F.col("b.s_suppkey")) & (gap <= 500)).select(F.col("a.s_suppkey").alias("a"), F.col("b.s_suppkey").alias("b"), r6(gap, "gap"))


@query("j12_station_differences", f"WITH {E}, h AS (SELECT event_type AS s, us // 3600000000 AS hour, avg(value) AS v FROM e GROUP BY 1, 2) SELECT a.s AS a, b.s AS b, count(*) AS n, round(avg(a.v - b.v), 6) AS diff, round(median(a.v - b.v), 6) AS med FROM h a JOIN h b ON a.hour = b.hour AND a.s < b.s GROUP BY 1, 2")
def j12(spark, d):
    h = events(spark, d).groupBy(F.col("event_type").alias("s"), F.floor(F.col("us") / 3_600_000_000).alias("hour")).agg(F.avg("value").alias("v"))
    a, b = h.alias("a"), h.alias("b")
    diff = F.col("a.v") - F.col("b.v")
    return a.join(b, (F.col("a.hour") == F.col("b.hour")) & (F.col("a.s") < F.col("b.s"))).groupBy(F.col("a.s").alias("a"), F.col("b.s").alias("b")).agg(F.count("*").alias("n"), r6(F.avg(diff), "diff"), r6(F.median(diff), "med"))


@query("j13_membership", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def j13(spark, d):
    some = read(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return read(spark, d, "orders").join(some, "o_custkey", "left_semi").select("o_orderkey", "o_custkey")


@query("j17_era_rows", f"WITH {E}, r AS (SELECT user_id, max(us) AS reset FROM e WHERE event_type = 'signup' GROUP BY 1) SELECT user_id, count(*) AS n, round(sum(value), 6) AS total FROM e JOIN r USING (user_id) WHERE us >= reset GROUP BY 1")
def j17(spark, d):
    e = events(spark, d)
    reset = e.where("event_type = 'signup'").groupBy("user_id").agg(F.max("us").alias("reset"))
    return e.join(reset, "user_id").where("us >= reset").groupBy("user_id").agg(F.count("*").alias("n"), r6(F.sum("value"), "total"))


@query("j18_backfill_trim", f"WITH {E}, s AS (SELECT event_type, min(us) FILTER (event_id % 7 = 0) AS live FROM e WHERE event_type <> 'view' GROUP BY 1) SELECT event_type, count(*) AS n FROM e LEFT JOIN s USING (event_type) WHERE live IS NULL OR us < live + 86400000000 GROUP BY 1")
def j18(spark, d):
    e = events(spark, d)
    live = e.where("event_type <> 'view'").groupBy("event_type").agg(F.min(F.when(F.col("event_id") % 7 == 0, F.col("us"))).alias("live"))
    return e.join(live, "event_type", "left").where("live is null or us < live + 86400000000").groupBy("event_type").agg(F.count("*").alias("n"))


@query("se1_diagonal_merge", "WITH n AS (SELECT o_orderkey AS k, o_totalprice AS v, NULL::VARCHAR AS s FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_orderkey, NULL, o_orderstatus FROM orders WHERE o_orderkey % 2 = 1) SELECT k, round(v, 6) AS v, s FROM n")
def se1(spark, d):
    o = read(spark, d, "orders")
    a, b = o.where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("k"), r6(F.col("o_totalprice"), "v")), o.where("o_orderkey % 2 = 1").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("s"))
    return a.unionByName(b, allowMissingColumns=True)


@query("snk2_keep_last_merge", "WITH b AS (SELECT 0 AS t, o_custkey AS k, max(o_orderkey) AS v FROM orders GROUP BY 2 UNION ALL SELECT 1, o_custkey, min(o_orderkey) FROM orders WHERE o_custkey % 3 = 0 GROUP BY 2) SELECT k, arg_max(v, t) AS v FROM b GROUP BY 1")
def snk2(spark, d):
    o = read(spark, d, "orders")
    old = o.groupBy(F.col("o_custkey").alias("k")).agg(F.max("o_orderkey").alias("v"))
    new = o.where("o_custkey % 3 = 0").groupBy(F.col("o_custkey").alias("k")).agg(F.min("o_orderkey").alias("v"))
    return R.merged_long(old, new, ["k"])


@query("se3_set_differences", "SELECT 'except' AS op, k FROM (SELECT o_custkey AS k FROM orders EXCEPT SELECT c_custkey FROM customer WHERE c_nationkey < 10) UNION ALL SELECT 'both', k FROM (SELECT o_custkey AS k FROM orders INTERSECT SELECT c_custkey FROM customer WHERE c_nationkey < 10)")
def se3(spark, d):
    a = read(spark, d, "orders").select(F.col("o_custkey").alias("k"))
    b = read(spark, d, "customer").where("c_nationkey < 10").select(F.col("c_custkey").alias("k"))
    return a.subtract(b).select(F.lit("except").alias("op"), "k").unionByName(a.intersect(b).select(F.lit("both").alias("op"), "k"))


@query("st3_top_series", "SELECT p_type, round(sum(l_extendedprice), 2) AS weight FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1 ORDER BY sum(l_extendedprice) DESC, 1 LIMIT 8")
def st3(spark, d):
    j = read(spark, d, "lineitem").join(read(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return j.groupBy("p_type").agg(F.sum("l_extendedprice").alias("w")).orderBy(F.desc("w"), "p_type").limit(8).select("p_type", F.round("w", 2).alias("weight"))


@query("e26_analog_neighbours", """WITH v AS (SELECT vec_id, embedding, label FROM embeddings), q AS (SELECT * FROM v WHERE vec_id % 20 = 0), s AS (SELECT q.vec_id AS q, v.vec_id AS n, v.label, list_sum(list_transform(list_zip(q.embedding, v.embedding), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) * (z[1]::DOUBLE - z[2]::DOUBLE))) AS dist FROM q JOIN v ON q.vec_id <> v.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(dist, 9), n) AS k FROM s) SELECT q, count(*) AS n, round(median(label), 6) AS med, round(max(sqrt(dist)), 5) AS reach FROM r WHERE k <= 25 GROUP BY 1""")
def e26(spark, d):
    """The 25 nearest of every twentieth vector: queries are a stated set and are sent to all rows in blocks."""
    import numpy as np
    import pyarrow as pa

    v = read(spark, d, "embeddings").select("vec_id", "embedding", "label")
    wanted = v.where("vec_id % 20 = 0").select("vec_id", "embedding")
    blocks = -(-wanted.count() // 2048)
    out = None
    for k in range(blocks):  # a block of about 2,048 queries is all that is on the driver and broadcast at a time
        block = wanted.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == k).collect()
        shared = spark.sparkContext.broadcast((np.array([r["vec_id"] for r in block]), np.array([r["embedding"] for r in block], np.float64)))

        def nearest(batches, shared=shared):
            ids, q = shared.value
            best = [(np.empty(0), np.empty(0, np.int64), np.empty(0, np.int32)) for _ in ids]  # the 25 nearest of each query so far
            for b in batches:
                x = np.stack([np.asarray(e, np.float64) for e in b.column(1).to_numpy(zero_copy_only=False)])
                n, label = b.column(0).to_numpy(), b.column(2).to_numpy()
                for j, point in enumerate(q):
                    dist = ((x - point) ** 2).sum(axis=1)
                    some = np.flatnonzero(n != ids[j])
                    some = some[np.argpartition(dist[some], 24)[:25]] if some.size > 25 and np.unique(dist[some]).size == some.size else some
                    all_ = tuple(np.concatenate([old, new[some]]) for old, new in zip(best[j], (dist, n, label)))
                    order = np.lexsort((all_[1], all_[0].round(9)))[:25]
                    best[j] = tuple(c[order] for c in all_)
            for j, (dist, n, label) in enumerate(best):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n.size, ids[j])), pa.array(n), pa.array(label.astype(np.int32)), pa.array(dist)], names=["q", "n", "label", "dist"])

        part = v.mapInArrow(nearest, "q long, n long, label int, dist double")
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = spark.createDataFrame([], "q long, n long, label int, dist double")
    ranked = out.withColumn("k", F.row_number().over(Window.partitionBy("q").orderBy(F.round("dist", 9), "n"))).where("k <= 25")
    return ranked.groupBy("q").agg(F.count("*").alias("n"), r6(F.median("label"), "med"), F.round(F.max(F.sqrt("dist")), 5).alias("reach"))


@query("ag13_leaderboard", f"""WITH {BOARD}, m AS (SELECT bucket, method, count(p) AS n, count(*) AS n_total, count(DISTINCT valid) AS n_valid, avg(abs(p - y)) AS mae, sqrt(avg((p - y) ** 2)) AS rmse, avg(p - y) AS bias, avg(CASE WHEN abs(p - y) <= 10 THEN 1.0 ELSE 0 END) AS within FROM al GROUP BY 1, 2)
SELECT bucket, method, n, n_total, n_valid, round(n / n_total, 6) AS coverage, round(mae, 6) AS mae, round(rmse, 6) AS rmse, round(bias, 6) AS bias, round(within, 6) AS within, round(1 - mae / max(CASE WHEN method = 'equal_weight' THEN mae END) OVER (PARTITION BY bucket), 6) AS skill FROM m""")
def ag13(spark, d):
    e = F.col("p") - F.col("y")
    m = pair(spark, d).groupBy("bucket", "method").agg(F.count("p").alias("n"), F.count("*").alias("n_total"), F.count_distinct("valid").alias("n_valid"), F.avg(F.abs(e)).alias("mae"), r6(F.sqrt(F.avg(e * e)), "rmse"), r6(F.avg(e), "bias"), r6(F.avg(F.when(F.abs(e) <= 10, 1.0).otherwise(0.0)), "within"))
    ref = F.max(F.when(F.col("method") == "equal_weight", F.col("mae"))).over(Window.partitionBy("bucket"))
    return m.withColumn("skill", r6(1 - F.try_divide(F.col("mae"), ref), "s")).select("bucket", "method", "n", "n_total", "n_valid", r6(F.col("n") / F.col("n_total"), "coverage"), r6(F.col("mae"), "mae"), "rmse", "bias", "within", "skill")


@query("ag14_weighted_board", f"WITH {BOARD}, m AS (SELECT bucket, method, count(*) AS n, avg(abs(p - y)) AS mae, sqrt(avg((p - y) ** 2)) AS rmse FROM al GROUP BY 1, 2) SELECT method, sum(n)::BIGINT AS n, round(sum(mae * n) / sum(n), 6) AS mae, round(sqrt(sum(rmse ** 2 * n) / sum(n)), 6) AS rmse FROM m GROUP BY 1")
def ag14w(spark, d):
    e = F.col("p") - F.col("y")
    m = pair(spark, d).groupBy("bucket", "method").agg(F.count("*").alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"))
    return m.groupBy("method").agg(F.sum("n").alias("n"), r6(F.sum(F.col("mae") * F.col("n")) / F.sum("n"), "mae"), r6(F.sqrt(F.sum(F.col("rmse") ** 2 * F.col("n")) / F.sum("n")), "rmse"))


@query("ag15_collapsed_losses", f"WITH {BOARD} SELECT valid, method, round(avg(abs(p - y)), 6) AS loss FROM al GROUP BY 1, 2")
def ag15(spark, d):
    return pair(spark, d).groupBy("valid", "method").agg(r6(F.avg(F.abs(F.col("p") - F.col("y"))), "loss"))


@query("ag17_error_correlation", f"WITH {BASE}, e2 AS (SELECT issue, valid, source, x - y AS err FROM matrix WHERE y IS NOT NULL), c AS (SELECT a.source AS a, b.source AS b, count(*) AS n, corr(a.err, b.err) AS r FROM e2 a JOIN e2 b USING (issue, valid) WHERE a.source < b.source GROUP BY 1, 2), k AS (SELECT greatest(0, least(1, avg(r))) AS rho, (SELECT count(DISTINCT source) FROM e2) AS m FROM c WHERE n >= 24) SELECT a, b, n, round(r, 6) AS r, round(m / (1 + (m - 1) * rho), 6) AS k_eff FROM c, k WHERE n >= 24")
def ag17(spark, d):
    e = matrix(spark, d).where("y is not null").select("issue", "valid", "source", (F.col("x") - F.col("y")).alias("err"))
    a, b = e.alias("a"), e.alias("b")
    same = (F.col("a.issue") == F.col("b.issue")) & (F.col("a.valid") == F.col("b.valid")) & (F.col("a.source") < F.col("b.source"))
    c = a.join(b, same).groupBy(F.col("a.source").alias("a"), F.col("b.source").alias("b")).agg(F.count("*").alias("n"), P.safe_correlation("a.err", "b.err").alias("r"))
    c = c.where("n >= 24")
    rho = c.agg(S.clipped(F.avg("r"), 0, 1).alias("rho")).crossJoin(e.agg(F.count_distinct("source").alias("m")))  # one row each
    return c.crossJoin(F.broadcast(rho)).select("a", "b", "n", r6(F.col("r"), "r"), r6(F.col("m") / (1 + (F.col("m") - 1) * F.col("rho")), "k_eff"))


@query("ag18_consensus_deviation", f"WITH {BASE}, d AS (SELECT issue, bucket, source, x - median(x) OVER (PARTITION BY issue, valid) AS dev, count(*) OVER (PARTITION BY issue, valid) AS k FROM matrix) SELECT issue, bucket, source, round(avg(dev), 6) AS dev FROM d WHERE k >= 4 GROUP BY 1, 2, 3")
def ag18(spark, d):
    w = Window.partitionBy("issue", "valid")
    m = matrix(spark, d).withColumn("dev", F.col("x") - F.median("x").over(w)).withColumn("k", F.count("*").over(w)).where("k >= 4")
    return m.groupBy("issue", "bucket", "source").agg(r6(F.avg("dev"), "dev"))


@query("ag19_recent_quality", f"WITH {BASE}, a AS (SELECT max(valid) AS anchor FROM matrix WHERE y IS NOT NULL) SELECT source, bucket, count(*) AS n, round(avg(abs(x - y)), 6) AS mae FROM matrix, a WHERE y IS NOT NULL AND valid > anchor - 336 AND valid <= anchor GROUP BY 1, 2")
def ag19(spark, d):
    m = matrix(spark, d).where("y is not null")
    anchor = m.agg(F.max("valid").alias("anchor"))
    rows = m.crossJoin(F.broadcast(anchor)).where("valid > anchor - 336 and valid <= anchor")  # one row
    return rows.groupBy("source", "bucket").agg(F.count("*").alias("n"), r6(F.avg(F.abs(F.col("x") - F.col("y"))), "mae"))


@query("ag25_reliability_bins", """WITH s AS (SELECT least(1.0, n_chars / 5000.0) AS p, quality AS y FROM documents JOIN labels USING (doc_id)), b AS (SELECT least(9, floor(p * 10))::INTEGER AS bin, count(*) AS n, avg(p) AS mp, avg(y) AS my FROM s GROUP BY 1)
SELECT bin::INTEGER AS bin, coalesce(n, 0)::BIGINT AS n, round(mp, 6) AS forecast, round(my, 6) AS observed FROM range(0, 10) AS r(bin) LEFT JOIN b USING (bin)""")
def ag25(spark, d):
    s = read(spark, d, "documents").join(read(spark, d, "labels"), "doc_id").select(F.least(F.lit(1.0), F.col("n_chars") / 5000.0).alias("p"), "quality")
    b = s.groupBy(F.least(F.lit(9), F.floor(F.col("p") * 10)).cast("int").alias("bin")).agg(F.count("*").alias("n"), r6(F.avg("p"), "forecast"), r6(F.avg("quality"), "observed"))
    return spark.range(10).select(F.col("id").cast("int").alias("bin")).join(b, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).cast("long").alias("n"), "forecast", "observed")


@query("t3_brier", "WITH s AS (SELECT lang, least(1.0, n_chars / 5000.0) AS p, quality AS y FROM documents JOIN labels USING (doc_id)) SELECT lang, count(*) AS n, round(avg((p - y) ** 2), 6) AS brier, round(avg(CASE WHEN (p >= 0.5) = (y = 1) THEN 1.0 ELSE 0 END), 6) AS hits FROM s GROUP BY 1")
def t3(spark, d):
    s = read(spark, d, "documents").join(read(spark, d, "labels"), "doc_id").withColumn("p", F.least(F.lit(1.0), F.col("n_chars") / 5000.0))
    hit = F.when((F.col("p") >= 0.5) == (F.col("quality") == 1), 1.0).otherwise(0.0)
    return s.groupBy("lang").agg(F.count("*").alias("n"), r6(F.avg((F.col("p") - F.col("quality")) ** 2), "brier"), r6(F.avg(hit), "hits"))


@query("t2_pinball_crps", f"""WITH {BASE}, q AS (SELECT issue, valid, any_value(y) AS y, quantile_cont(x, 0.1) AS a, quantile_cont(x, 0.5) AS b, quantile_cont(x, 0.9) AS c, any_value(bucket) AS bucket FROM matrix WHERE y IS NOT NULL GROUP BY 1, 2),
l AS (SELECT bucket, greatest(0.1 * (y - a), -0.9 * (y - a)) AS p1, greatest(0.5 * (y - b), -0.5 * (y - b)) AS p5, greatest(0.9 * (y - c), -0.1 * (y - c)) AS p9, CASE WHEN y >= a AND y <= c THEN 1.0 ELSE 0 END AS inside FROM q)
SELECT bucket, count(*) AS n, round(avg(p1), 6) AS p10, round(avg(p5), 6) AS p50, round(avg(p9), 6) AS p90, round(avg(2 * (0.3 * p1 + 0.4 * p5 + 0.3 * p9)), 6) AS crps, round(avg(inside), 6) AS coverage80 FROM l GROUP BY 1""")
def t2(spark, d):
    q = matrix(spark, d).where("y is not null").groupBy("issue", "valid").agg(F.first("y").alias("y"), F.first("bucket").alias("bucket"), F.percentile("x", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9))).alias("q"))
    loss = {n: S.pinball(F.col("y"), F.col("q")[k], v) for k, (n, v) in enumerate({"p10": 0.1, "p50": 0.5, "p90": 0.9}.items())}
    inside = F.when((F.col("y") >= F.col("q")[0]) & (F.col("y") <= F.col("q")[2]), 1.0).otherwise(0.0)
    return q.groupBy("bucket").agg(F.count("*").alias("n"), *[r6(F.avg(v), k) for k, v in loss.items()], r6(F.avg(2 * (0.3 * loss["p10"] + 0.4 * loss["p50"] + 0.3 * loss["p90"])), "crps"), r6(F.avg(inside), "coverage80"))


@query("ag26_last_then_mean", f"WITH {E}, l AS (SELECT user_id, us // 3600000000 AS hour, arg_max(value, (us, event_id)) AS v FROM e GROUP BY 1, 2) SELECT hour, round(avg(v), 6) AS v FROM l GROUP BY 1")
def ag26(spark, d):
    last = events(spark, d).groupBy("user_id", F.floor(F.col("us") / 3_600_000_000).cast("long").alias("hour")).agg(F.max_by("value", F.struct("us", "event_id")).alias("v"))
    return last.groupBy("hour").agg(r6(F.avg("v"), "v"))


@query("ag11_neighbour_consensus", f"WITH {E}, s AS (SELECT us // 3600000000 AS hour, user_id % 12 AS station, avg(value) AS v FROM e GROUP BY 1, 2) SELECT hour, round(median(v), 6) AS v, count(*) AS stations FROM s GROUP BY 1 HAVING count(*) >= 3")
def ag11(spark, d):
    s = events(spark, d).groupBy(F.floor(F.col("us") / 3_600_000_000).cast("long").alias("hour"), (F.col("user_id") % 12).alias("station")).agg(F.avg("value").alias("v"))
    return s.groupBy("hour").agg(r6(F.median("v"), "v"), F.count("*").alias("stations")).where("stations >= 3")


@query("dz2_coverage_calendar", f"WITH {E} SELECT us // 86400000000 AS day, round(count(DISTINCT us // 3600000000) / 24.0, 6) AS coverage FROM e GROUP BY 1 ORDER BY 1 DESC LIMIT 25")
def dz2(spark, d):
    g = events(spark, d).groupBy(F.floor(F.col("us") / 86_400_000_000).cast("long").alias("day")).agg(F.count_distinct(F.floor(F.col("us") / 3_600_000_000)).alias("h"))
    return g.orderBy(F.desc("day")).limit(25).select("day", r6(F.col("h") / 24, "coverage"))


@query("dz3_null_share", f"WITH {BASE} SELECT source, round(avg(CASE WHEN y IS NULL THEN 1.0 ELSE 0 END), 6) AS share FROM matrix GROUP BY 1")
def dz3(spark, d):
    return matrix(spark, d).groupBy("source").agg(r6(F.avg(F.when(F.col("y").isNull(), 1.0).otherwise(0.0)), "share"))


@query("dz4_provenance", "SELECT o_orderstatus, list_sort(list(DISTINCT o_orderpriority))::VARCHAR AS kinds FROM orders GROUP BY 1")
def dz4(spark, d):
    kinds = F.array_sort(F.collect_set("o_orderpriority"))
    return read(spark, d, "orders").groupBy("o_orderstatus").agg(F.concat(F.lit("["), F.array_join(kinds, ", "), F.lit("]")).alias("kinds"))


@query("dz6_reasons_per_day", f"WITH {E}, t AS (SELECT user_id % 30 AS reason, count(*) AS total FROM e GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 8) SELECT us // 86400000000 AS day, reason, count(*) AS n FROM e JOIN t ON user_id % 30 = reason GROUP BY 1, 2")
def dz6(spark, d):
    e = events(spark, d).withColumn("reason", F.col("user_id") % 30)
    top = e.groupBy("reason").agg(F.count("*").alias("total")).orderBy(F.desc("total"), "reason").limit(8).select("reason")
    return e.join(F.broadcast(top), "reason").groupBy(F.floor(F.col("us") / 86_400_000_000).cast("long").alias("day"), "reason").agg(F.count("*").alias("n"))  # eight rows


@query("dz9_source_ages", f"WITH {BASE} SELECT source, max(issue) - max(fetched) AS age FROM sel WHERE issue = (SELECT max(issue) FROM sel) GROUP BY 1")
def dz9(spark, d):
    m = matrix(spark, d).select("issue", "source", "fetched").distinct()
    last = m.agg(F.max("issue").alias("issue"))
    return m.join(F.broadcast(last), "issue").select("source", (F.col("issue") - F.col("fetched")).alias("age"))  # one row


@query("grouping_sets", "SELECT l_returnflag, l_linestatus, sum(l_quantity)::DOUBLE AS qty, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())")
def grouping_sets(spark, d):
    li = read(spark, d, "lineitem")
    return li.groupingSets([["l_returnflag", "l_linestatus"], ["l_returnflag"], []], "l_returnflag", "l_linestatus").agg(F.sum("l_quantity").cast("double").alias("qty"), F.count("*").alias("n"))


@query("cube", "SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(avg(o_totalprice), 4) AS price FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def cube(spark, d):
    return read(spark, d, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.round(F.avg("o_totalprice"), 4).alias("price"))
