"""Releases from a log of evaluations, what is served as of a time, and metrics taken on the way."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftcast.operators import release as R
from weftcast.sources import observability as O

LOG = "evaluation string, created long, variable string, bucket string, method string, valid long, p double, y double"
REFS, BY = ["equal_weight", "best_provider"], ["variable", "bucket"]


def evaluation(name, created, methods, buckets=("near", "far"), n=60, seed=1):
    """methods: their mean error in each bucket."""
    rows = []
    for bucket in buckets:
        rng = np.random.default_rng(seed)
        for k in range(n):
            y = float(rng.normal(20, 3))
            for m, size in methods.items():
                rows.append((name, created, "t", bucket, m, k, y + float(rng.normal(0, 0.1)) + size * (1 if k % 2 else -1), y))
    return rows


BASE = {"equal_weight": 2.0, "best_provider": 2.2, "challenger": 1.0}


def table(spark, *evaluations):
    return spark.createDataFrame([r for e in evaluations for r in e], LOG)


def picked(df):
    return {r["bucket"]: r for r in df.collect()}


def test_a_targeted_evaluation_updates_its_slice_alone(spark):
    log = table(spark, evaluation("e1", 10, BASE), evaluation("e2", 20, BASE, ["near"]))
    got = picked(R.decided(log, BY, REFS))
    assert (got["near"]["evaluation"], got["far"]["evaluation"]) == ("e2", "e1")
    assert {r["method"] for r in got.values()} == {"challenger"} and got["near"]["n"] == 60


def test_challengers_alone_decide_nothing(spark):
    alone = evaluation("e9", 99, {"challenger": 0.1})
    got = picked(R.decided(table(spark, evaluation("e1", 10, BASE), alone), BY, REFS))
    assert {r["evaluation"] for r in got.values()} == {"e1"}
    assert R.decided(table(spark, alone), BY, REFS).count() == 0


def test_future_evaluations_and_ties(spark):
    log = table(spark, evaluation("e1", 10, BASE), evaluation("e2", 20, BASE), evaluation("e3", 20, BASE))
    at = lambda t: {r["evaluation"] for r in R.newest_complete(log, BY, REFS, t).select("evaluation").distinct().collect()}
    assert at(9) == set() and at(15) == {"e1"} and at(20) == at(None) == {"e3"}


def test_a_thin_or_weak_challenger_is_held(spark):
    got = picked(R.decided(table(spark, evaluation("e1", 10, BASE | {"challenger": 1.999})), BY, REFS))
    assert {(r["method"], r["reason"]) for r in got.values()} == {("equal_weight", "mcs_not_separated")} or {r["method"] for r in got.values()} <= {"equal_weight", "challenger"}
    thin = picked(R.decided(table(spark, evaluation("e1", 10, BASE, n=7)), BY, REFS))
    assert thin == {}  # none has eight cases


def test_an_incumbent_stays_within_a_standard_error(spark):
    near = BASE | {"old": 1.0}
    log = table(spark, evaluation("e1", 10, near))
    old = spark.createDataFrame([("t", "near", "old"), ("t", "far", "gone")], "variable string, bucket string, incumbent string")
    got = picked(R.decided(log, BY, REFS, incumbents=old))
    both = {r["method"] for r in picked(R.decided(log, BY, REFS)).values()}
    assert both <= {"old", "challenger"} and got["near"]["method"] == "old" and got["far"]["method"] in both and not got["far"]["retained"]
    worse = picked(R.decided(table(spark, evaluation("e1", 10, BASE | {"old": 1.5})), BY, REFS, incumbents=old))
    assert worse["near"]["method"] == "challenger" and not worse["near"]["retained"]
    assert got["near"]["retained"] == (both == {"challenger"})


def test_pins_and_demotion(spark):
    log = table(spark, evaluation("e1", 10, BASE))
    live = spark.createDataFrame([("t", "near", "challenger", 30, 1.6), ("t", "far", "challenger", 23, 9.0)], "variable string, bucket string, method string, live_n long, live_mae double")
    got = picked(R.decided(log, BY, REFS, live=live))
    assert got["near"]["method"] == "equal_weight" and got["near"]["reason"].startswith("demoted challenger: live 1.600") and got["near"]["mae"] == pytest.approx(2.0, abs=0.1)
    assert got["far"]["method"] == "challenger"  # too few live cases
    pins = spark.createDataFrame([("t", "challenger")], "variable string, pin string")
    kept = picked(R.decided(log, BY, REFS, live=live, pins=pins))
    assert {(r["method"], r["reason"], r["pinned"]) for r in kept.values()} == {("challenger", "pinned", True)}


def test_releases_as_of(spark):
    one = R.minted(R.decided(table(spark, evaluation("e1", 10, BASE)), BY, REFS), BY, 100)
    two = R.minted(R.decided(table(spark, evaluation("e2", 20, BASE | {"challenger": 3.0})), BY, REFS), BY, 200)
    names = [df.select("release_id").distinct().collect()[0][0] for df in (one, two)]
    assert names[0] != names[1] and len(names[0]) == 16
    again = R.minted(R.decided(table(spark, evaluation("e1", 10, BASE)), BY, REFS), BY, 300)
    assert again.select("release_id").distinct().collect()[0][0] == names[0]
    ledger = one.unionByName(two)
    at = lambda t: {r["release_id"] for r in R.release_as_of(ledger, t).collect()}
    assert at(99) == set() and at(100) == at(199) == {names[0]} and at(500) == {names[1]}


def test_what_serves_a_row(spark):
    rows = spark.createDataFrame([(1, "t", "near"), (2, "t", "far"), (3, "u", "near"), (4, "v", "near")], "k int, variable string, bucket string")
    made = spark.createDataFrame([("t", "near", "fancy", "won"), ("t", "far", "lost", "won"), ("v", "near", "fancy", "won")], "variable string, bucket string, method string, reason string")
    able = spark.createDataFrame([("fancy", "t"), ("plain", "t"), ("plain", "u"), ("plain", "v")], "method string, variable string")
    pins = spark.createDataFrame([("u", "plain")], "variable string, pin string")
    got = {r["k"]: (r["method"], r["reason"], r["degraded"]) for r in R.method_of(rows, made, BY, pins, able).collect()}
    assert got == {1: ("fancy", "won", False), 2: ("equal_weight", "degraded: unknown method lost", True), 3: ("plain", "pinned", False), 4: ("equal_weight", "degraded: no support here for fancy", True)}
    assert {r["method"] for r in R.method_of(rows, made, BY, pins, able, forced="plain").collect()} == {"plain"}
    with pytest.raises(Exception, match="no support here for fancy"):
        R.method_of(rows, made, BY, None, able, forced="fancy").collect()
    with pytest.raises(Exception, match="unknown method other"):
        R.method_of(rows, made, BY, None, able, forced="other").collect()
    assert R.method_of(rows, made.limit(0), BY).where("method = 'equal_weight' and not degraded").count() == 4


def test_live_cases_are_pooled(spark):
    h = spark.createDataFrame([("t", "near", "m", v, 1.0, None if v == 990 else 3.0) for v in range(600, 1000, 10)], "variable string, bucket string, method string, valid long, p double, y double")
    assert R.pooled_live(h, BY, F.lit(1000)).collect() == [("t", "near", "m", 32, 2.0)]


def identity(method="ewa", issue=7):
    return {"method": method, "product": "hourly", "variable": "t", "issue": issue}


def test_metrics_are_taken_on_the_way(spark, tmp_path):
    """One job, no second pass over the rows; a snapshot round trip; the newest of an identity overwrites in place."""
    df, folder = spark.range(1000).withColumn("p", F.col("id") / 10), str(tmp_path / "seen")
    jobs = []

    def write(out):
        spark.sparkContext.setJobGroup("serve", "serve")
        out.write.mode("overwrite").parquet(str(tmp_path / "served"))
        jobs.extend(spark.sparkContext.statusTracker().getJobIdsForGroup("serve"))

    metrics = {"n": F.count("*"), "mean": F.avg("p")}
    assert O.measured(df, write, metrics, identity(), folder, now=1e9) == {"n": 1000, "mean": 49.95}
    assert len(jobs) == 1 and spark.read.parquet(str(tmp_path / "served")).count() == 1000
    O.measured(df.limit(10), write, metrics, identity(issue=8), folder, now=1e9)
    (seen,) = O.snapshots(spark, folder).collect()
    assert (seen["method"], seen["issue"]) == ("ewa", 8) and O.snapshots(spark, folder).select(O.metric("n")).first()[0] == 10
    assert O.trajectories(spark, folder).count() == 0


def test_only_trajectories_are_appended_and_old_days_go(spark, tmp_path):
    df, folder, write = spark.range(5), str(tmp_path / "seen"), lambda out: out.write.format("noop").mode("overwrite").save()
    for day, method, kept in ((0, "ewa", True), (1, "gew", False), (80, "ewa", True), (95, "boa", True)):
        O.measured(df, write, {"n": F.count("*")}, identity(method, day), folder, kept, now=86_400.0 * day)
    assert sorted(r["issue"] for r in O.trajectories(spark, folder).collect()) == [80, 95] and O.snapshots(spark, folder).count() == 3


def test_telemetry_never_fails_a_job_but_a_job_may(spark, tmp_path):
    bad = str(tmp_path / "file")
    (tmp_path / "file").write_text("in the way")
    write = lambda out: out.write.format("noop").mode("overwrite").save()
    assert O.measured(spark.range(5), write, {"n": F.count("*")}, identity(), bad) == {"n": 5}
    assert O.measured(spark.range(5), write, {}, identity(), str(tmp_path / "none")) == {} and not (tmp_path / "none").exists()
    with pytest.raises(ZeroDivisionError):
        O.measured(spark.range(5), lambda out: 1 / 0, {"n": F.count("*")}, identity(), None)
