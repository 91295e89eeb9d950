"""Rules that had no test of their own: transitions, benchmarks, changes of quality, climatology, clusters, blocked promotions, plans of windows."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftcast.operators import inference, methods
from weftcast.plans import registry, trends

SF = "/root/testdata/sf0.001"
ROW = "fold int, issue long, valid long, lead long, bucket string, source string, x double, y double"


def plain_transitions(samples, hold):
    starts = [(t, v) for k, (t, v) in enumerate(samples) if not k or samples[k - 1][1] != v]
    held = []
    for k, (t, v) in enumerate(starts):
        end = starts[k + 1][0] if k + 1 < len(starts) else samples[-1][0]
        if end - t >= hold and (not held or held[-1] != v):
            held.append(v)
    return (held[-2], held[-1], len(held) - 1) if len(held) > 1 and len(samples) > 1 else None


def test_transitions(spark):
    rng, rows = np.random.default_rng(1), []
    for label in range(12):
        t = 0
        for _ in range(int(rng.integers(1, 40))):
            t += int(rng.integers(1, 3))
            rows.append((label, t, "abc"[int(rng.integers(3)) if rng.random() < 0.4 else label % 3]))
    got = {r["label"]: (r["previous"], r["leader"], r["flips"]) for r in trends.confirmed_transitions(spark.createDataFrame(rows, "label int, t long, leader string"), ["label"], "t", "leader", 3).collect()}
    want = {k: plain_transitions([(t, v) for m, t, v in rows if m == k], 3) for k in range(12)}
    assert got == {k: v for k, v in want.items() if v} and len(got) > 3


def test_benchmark_and_change(spark):
    board = spark.createDataFrame([("a", "ref", 10, 2.0), ("a", "x", 90, 1.0), ("a", "y", 10, None), ("b", "ref", 30, 4.0), ("b", "x", 5, 5.0), ("c", "x", 7, 1.0), ("d", "ref", 0, 9.0), ("d", "x", 1, 1.0)], "slice string, method string, n long, mae double")
    (r,) = trends.against_benchmark(board, ["slice"], "ref").collect()
    assert tuple(r) == (pytest.approx((2 * 10 + 4 * 30) / 40), pytest.approx((1 * 10 + 5 * 30) / 40), 2)
    assert trends.against_benchmark(board.where("method = 'x'"), ["slice"], "ref").count() == 0
    rows = [("e1", 1, "a", "x", 10, 9.0), ("e2", 2, "a", "x", 10, 2.0), ("e2", 2, "a", "y", 20, 3.0), ("e2", 2, "b", "x", 60, 1.0), ("e3", 3, "a", "x", 10, 1.0)]
    log = spark.createDataFrame(rows, "evaluation string, created long, slice string, method string, n long, mae double")
    (r,) = trends.quality_change(log, ["slice"]).collect()
    before = (2.0 * 20 + 1.0 * 60) / 80
    assert tuple(r) == (pytest.approx(before), 1.0, pytest.approx((1 - before) / before * 100), 1)
    assert trends.quality_change(log.where("evaluation = 'e1'"), ["slice"]).count() == 0


def test_climatology_goes_by_the_stations_clock(spark):
    """A daily course of local hours, on both sides of a change to summer time, is followed; one of UTC hours would be an hour off."""
    rows, start = [], 1_709_856_000 // 3600  # 2024-03-08
    local = lambda h: (h - (8 if h < start + 58 else 7)) % 24
    for k in range(24 * 6):
        rows.append((0, start + k - 1, start + k, 1, "a", "s", 0.0, 20 + 5 * float(np.sin(2 * np.pi * local(start + k) / 24))))
    df = spark.createDataFrame(rows, ROW)
    off = lambda zone: methods.climatology(df, df, zone).agg(F.avg(F.abs(F.col("p") - F.col("y")))).first()[0]
    assert off("America/Los_Angeles") < 0.15 < off("UTC")


def test_clusters_leave_one_of_twins(spark):
    rng, rows = np.random.default_rng(3), []
    for k in range(80):
        y, e = float(rng.normal(0, 3)), float(rng.normal(0, 1))
        rows += [(0, k, k + 1, 1, "a", s, y + d, y) for s, d in (("good", 0.9 * e), ("twin", e + float(rng.normal(0, 0.01))), ("other", float(rng.normal(0, 1.2))))]
    df = spark.createDataFrame(rows, ROW)
    new = df.where("issue >= 60")
    got = {r["issue"]: r["p"] for r in methods.clustered(df.where("issue < 60"), new).collect()}
    kept = {r["issue"]: r["p"] for r in new.where("source <> 'twin'").groupBy("issue").agg(F.avg("x").alias("p")).collect()}
    assert got == pytest.approx(kept)


def test_a_blocked_promotion(spark):
    """A leader that the gate holds though it is far better: too few times to tell."""
    rng, rows = np.random.default_rng(4), []
    for k in range(9):
        y = float(rng.normal())
        rows += [("b", m, k, abs(float(rng.normal(0, size)))) for m, size in (("equal_weight", 2.0), ("best_provider", 2.0), ("lucky", 1.0))]
        del y
    losses = spark.createDataFrame(rows, "bucket string, method string, valid long, loss double")
    able = losses.groupBy("bucket", "method").agg(F.avg("loss").alias("mae"))
    (r,) = inference.gated(losses, able, ["bucket"], ["equal_weight", "best_provider"]).collect()
    assert r["candidate"] == "lucky" and r["gate"] == "mcs_not_separated" and r["winner"] in ("equal_weight", "best_provider") and r["winner_mae"] / r["candidate_mae"] - 1 > 0.15


#: Windows without a key that see a row a slice, bin or evaluation, by the column they are ordered by.
ONE_ROW_A_SLICE = ("__time_slice", "part", "__slice", "start", "slot")


@pytest.mark.parametrize("name", ["j1_asof_selection", "j2_observation_at_issue", "j3_trend", "w6_range_median", "w7_rolling_correlation", "w12_regime_runs"])
def test_windows_over_the_log_are_keyed(spark, name):
    plan = registry.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if re.match(r"[\s:+-]*Window \[", line)]
    for line in windows:
        keys, order = re.search(r"\](?:, \[([^\[\]]*)\])?, \[([^\[\]]*)\]$", line).groups()
        assert "slice" in (keys or "") or any(c in order for c in ONE_ROW_A_SLICE), (keys, order)


def test_uniform_transforms():
    assert inference.pit_uniformity([10, 10, 10]) == pytest.approx(1.0)
    assert inference.pit_uniformity([10, 20]) == pytest.approx(0.0679, abs=1e-4)  # chi-square 10/3 on one degree
    assert inference.pit_uniformity([0, 0, 0, 100]) < 1e-12 and np.isnan(inference.pit_uniformity([0, 0]))


def test_weights_of_the_bucket_with_most_rounds(spark):
    import json

    from weftcast.operators import sequential

    of = lambda issue, bucket, sources, w, rounds: (issue, bucket, json.dumps(sources), json.dumps({"w": w, "rounds": rounds}))
    rows = [of(1, "a", ["x", "y"], [0.5, 0.5], 3), of(2, "a", ["x", "y", "z"], [0.2, 0.3, 0.5], 9), of(1, "b", ["x"], [1.0], 5)]
    got = sequential.weight_history(spark.createDataFrame(rows, "issue long, bucket string, sources string, state string")).collect()
    assert {(r["issue"], r["source"]): r["weight"] for r in got} == {(1, "x"): 0.5, (1, "y"): 0.5, (1, "z"): None, (2, "x"): 0.2, (2, "y"): 0.3, (2, "z"): 0.5} and {r["bucket"] for r in got} == {"a"}


def test_only_thin_cells_follow_the_whole_fold(spark):
    """A fold whose cells all have errors enough is served by them alone; one with a thin cell also by all its errors."""
    from weftcast.operators import sequential

    rng, rows = np.random.default_rng(7), []
    for fold, buckets in ((0, "xy"), (1, "xyz")):
        for k in range(200):
            for b in buckets:
                if b == "z" and k % 20:
                    continue
                y = float(rng.normal())
                rows.append((fold, k, k + 1, 1, b, "s", y + float(rng.normal(0, {"x": 0.1, "y": 5.0, "z": 1.0}[b])), y))
    df = spark.createDataFrame(rows, ROW)
    old, new = df.where("issue < 150"), df.where("issue >= 150")
    width = {(r["fold"], r["bucket"]): r["w"] for r in sequential.conformal(old, new, methods.grounded).where("q is not null").groupBy("fold", "bucket").agg(F.avg(F.col("q")[6] - F.col("q")[0]).alias("w")).collect()}
    assert set(width) == {(0, "x"), (0, "y"), (1, "x"), (1, "y"), (1, "z")}
    assert width[0, "x"] < 1 < width[0, "y"] and width[1, "x"] < 1 < width[1, "z"]
