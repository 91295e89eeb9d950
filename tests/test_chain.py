"""The serving chain: what it serves, that it knows nothing of the future, and that an issue is served once."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftcast.operators import chain as C
from weftcast.sources import observability as O

NOW = 330


@pytest.fixture(scope="module")
def world(spark):
    """Three sources with biases, hourly truth, cycles every six hours."""
    rng = np.random.default_rng(1)
    y = {v: float(15 + 6 * np.sin(2 * np.pi * v / 24) + rng.normal(0, 1)) for v in range(500)}
    cycles, forecasts = [], []
    for fetched in range(0, 420, 6):
        for source, bias, size in (("a", 2.0, 0.5), ("b", -3.0, 1.0), ("c", 0.5, 2.0)):
            cycles.append((source, fetched))
            forecasts += [(source, fetched, fetched + k, y[fetched + k] + bias + float(rng.normal(0, size))) for k in range(1, 31)]
    make = spark.createDataFrame
    return make(cycles, "source string, fetched long"), make(forecasts, "source string, fetched long, valid long, x double"), make(list(y.items()), "valid long, y double"), make([(t,) for t in range(0, 420, 3)], "issue long")


def predicted(world, now=NOW, **how):
    return C.predict(*world, now, 12, 120, 60, **how).toPandas().sort_values(["product", "valid"], ignore_index=True)


@pytest.fixture(scope="module")
def document(world):
    return predicted(world)


def test_what_is_served(world, document, spark):
    truth = {r["valid"]: r["y"] for r in world[2].collect()}
    hourly, minutely = (document[document["product"] == p] for p in ("hourly", "minutely"))
    assert set(document["issue"]) == {NOW} and document["release_id"].nunique() == 1 and len(document["release_id"].iloc[0]) == 16
    assert hourly["valid"].is_unique and hourly["valid"].min() == NOW + 1 and len(hourly) >= 24 and not document["degraded"].any()
    assert np.abs(hourly["p"] - hourly["valid"].map(truth)).mean() < 1.5
    q = np.stack(hourly["q"])
    assert q.shape[1] == 19 and (np.diff(q, axis=1) >= 0).all()
    inside = [(a <= truth[v] <= b) for v, a, b in zip(hourly["valid"], q[:, 1], q[:, 17])]
    assert 0.5 < np.mean(inside) <= 1
    assert minutely["valid"].tolist() == list(range(NOW * 60 + 1, NOW * 60 + 61)) and minutely["q"].isna().all()
    assert minutely["p"].diff().abs().max() < 1


def test_nothing_of_the_future_is_known(spark, world, document):
    """Poisoned truths, cycles, forecasts and snapshots behind the issue change nothing, bit for bit."""
    cycles, forecasts, truth, snapshots = world
    late = spark.createDataFrame([("a", NOW + 1), ("z", NOW + 2)], "source string, fetched long")
    poisoned = (
        cycles.unionByName(late),
        forecasts.withColumn("x", F.when(F.col("fetched") > NOW, 1e6).otherwise(F.col("x"))).unionByName(late.withColumn("valid", F.col("fetched") + 1).withColumn("x", F.lit(-1e6))),
        truth.withColumn("y", F.when(F.col("valid") + 2 > NOW, 1e6).otherwise(F.col("y"))),
        snapshots.unionByName(spark.createDataFrame([(NOW + 1,)], "issue long")),
    )
    again = predicted(poisoned)
    assert again.drop(columns=["q", "p"]).equals(document.drop(columns=["q", "p"]))
    assert np.allclose(again["p"], document["p"], rtol=0, atol=1e-9)


def test_pins_forced_methods_and_stale_sources(spark, world, document):
    pins = spark.createDataFrame([("6-12h", "inverse_mse")], "bucket string, pin string")
    got = predicted(world, pins=pins)
    hourly = got[got["product"] == "hourly"]
    assert set(hourly[hourly["bucket"] == "6-12h"]["method"]) == {"inverse_mse"} and set(hourly[hourly["bucket"] == "6-12h"]["reason"]) == {"pinned"}
    assert set(predicted(world, forced="equal_weight")["method"]) == {"equal_weight"}
    with pytest.raises(Exception, match="unknown method other"):
        predicted(world, forced="other")
    with pytest.raises(ValueError, match="fresh"):
        predicted(world, now=450)


def test_an_issue_is_served_once(spark, world, document, tmp_path):
    folder, made = str(tmp_path / "served"), []

    def make():
        made.append(1)
        return spark.createDataFrame(document.astype({"issue": "int64", "valid": "int64"}), C.DOCUMENT)

    one = C.served_at(spark, folder, NOW, make)
    two = C.served_at(spark, folder, NOW, make)
    assert len(made) == 1 and one.count() == two.count() == len(document)
    (seen,) = O.snapshots(spark, f"{folder}/seen").select("issue", O.metric("n").alias("n"), O.metric("degraded").alias("d")).collect()
    assert tuple(seen) == (NOW, len(document), 0)


def test_thin_pools_fall_back(spark):
    log = spark.createDataFrame([("m", "a", 0.0, float(k % 3)) for k in range(30)] + [("m", "b", 0.0, 100.0)] * 5 + [("n", "a", 0.0, 1.0)] * 5, "method string, bucket string, p double, y double")
    points = spark.createDataFrame([("m", "a", 1.0), ("m", "b", 1.0), ("n", "a", 1.0)], "method string, bucket string, p double")
    got = {(r["method"], r["bucket"]): r["q"] for r in C.dressed(points, log, (0.1, 0.5, 0.9)).collect()}
    assert got["m", "a"] == [1.0, 2.0, 3.0] and got["m", "b"][2] > 50 and got["n", "a"] is None


def test_plans_of_minutes(spark):
    """A bucket's plan is its best construction; without an observation it is the path, and says so."""
    rows = [(b, h, 10.0, 16.0, 12.0, y) for b, h, y in (("near", 0.1, 16.0), ("near", 0.2, 16.0), ("far", 0.6, 14.0), ("far", 0.9, 14.0), ("flat", 0.5, 10.0))]
    schema = "bucket string, hour double, path double, observed double, start double, y double"
    df = spark.createDataFrame(rows, schema)
    plans = C.best_constructions(df)
    assert {r["bucket"]: r["plan"] for r in plans.collect()} == {"near": "minutely_persistence", "far": "minutely_anchor_full", "flat": "minutely_interp"}
    more = df.unionByName(spark.createDataFrame([("near", 0.3, 9.0, None, 12.0, None), ("new", 0.5, 10.0, 16.0, 12.0, None)], schema))
    got = {(r["bucket"], r["hour"]): (r["construction"], r["p"]) for r in C.planned_minutes(more, plans).collect()}
    assert got["near", 0.1] == ("minutely_persistence", 16.0) and got["far", 0.9] == ("minutely_anchor_full", 14.0) and got["flat", 0.5] == ("minutely_interp", 10.0)
    assert got["near", 0.3] == ("minutely_interp", 9.0) and got["new", 0.5] == ("minutely_anchor_tau_1h", pytest.approx(10 + 4 * np.exp(-0.5)))
