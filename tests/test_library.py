"""Unit tests of operators that no SQL twin covers, and of sources, sinks and streams."""

import math
import sqlite3

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from weftcast.functions import scalars as S
from weftcast.functions import special
from weftcast.operators import inference, matrix, methods, quality, relations, sequential, temporal
from weftcast.sources import archive, sinks
from weftcast.streaming import live


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_scalars(spark):
    arr = lambda *v: F.array(*[F.lit(x).cast("double") for x in v])
    assert one(spark, S.clipped(F.lit(None).cast("double"), 0, 1)) is None
    assert one(spark, S.clipped(F.lit(1.5), 0, 1)) == 1.0
    assert one(spark, S.median_of(arr(3, 1, 2))) == 2 and one(spark, S.median_of(arr(4, 1, 2, 3))) == 2.5
    assert one(spark, S.trimmed_mean(arr(100, 1, 2, 3, -50))) == 2
    assert one(spark, S.masked_mean(arr(1, None, 3))) == 2 and one(spark, S.masked_mean(arr(None))) is None
    assert one(spark, S.renormalised(arr(1, None, 3), arr(1, 5, 3))) == 2.5
    knots = [S.interpolated(F.lit(x), arr(0, 1, 3), arr(0, 10, 30)) for x in (-1.0, 0.5, 2.0, 9.0)]
    assert [one(spark, k) for k in knots] == [0, 5, 20, 30]
    assert one(spark, S.local_day_minutes(F.to_date(F.lit("2024-03-10")), "America/Los_Angeles")) == 1380
    assert one(spark, S.local_day_minutes(F.to_date(F.lit("2024-11-03")), "America/Los_Angeles")) == 1500
    assert one(spark, S.dew_point_c(F.lit(20.0), F.lit(100.0))) == pytest.approx(20)
    assert one(spark, S.dew_point_c(F.lit(20.0), F.lit(0.0))) is None
    assert [one(spark, S.lead_bucket(F.lit(x))) for x in (-0.1, 0.0, 1.0, 47.9, 240.0)] == [None, "0-1h", "1-3h", "24-48h", "240h+"]
    assert one(spark, S.decoded_segment(S.encoded_segment(F.lit("a__b%")))) == "a__b%"
    assert one(spark, S.source_slug(F.lit("p"), F.lit("best_match"))) == "p" and one(spark, S.source_slug(F.lit("p"), F.lit("m"))) == "p_m"
    with pytest.raises(KeyError):
        S.converted(F.lit(1), "furlong")


def test_special_functions():
    assert special.student_sf(2.0, 10) == pytest.approx(0.0366940, abs=1e-6)
    assert special.chi2_sf(20, 9) == pytest.approx(0.0179124, abs=1e-6)
    assert special.gaussian_crps(0, 1, 0) == pytest.approx(2 * special.normal_pdf(0) - 1 / math.sqrt(math.pi))
    assert special.isotonic(np.array([1, 3, 2, 4.0])).tolist() == [1, 2.5, 2.5, 4]
    assert special.isotonic(np.array([3, 1.0]), np.array([1, 3.0])).tolist() == [1.5, 1.5]
    assert np.allclose(special.simplex_search(lambda p: (p[0] - 1) ** 2 + (p[1] + 2) ** 2, np.zeros(2)), [1, -2], atol=1e-3)


def test_asof_keeps_a_rows_nulls_and_its_tolerance(spark):
    left = spark.createDataFrame([("a", 10), ("a", 20), ("b", 5)], "k string, t long")
    right = spark.createDataFrame([("a", 4, 1.0), ("a", 9, None), ("a", 12, 3.0)], "k string, at long, v double")
    got = {(r["k"], r["t"]): (r["at"], r["v"]) for r in temporal.asof_join(left, right, "t", "at", ["k"], 5, ["at", "v"]).collect()}
    assert got == {("a", 10): (9, None), ("a", 20): (None, None), ("b", 5): (None, None)}
    assert temporal.asof_join(left, right, "t", "at", ["k"], 8, ["v"]).where("k = 'a' and t = 20").first()["v"] == 3.0


def test_quality_rules(spark):
    rows = [("s", k * 60_000_000, v) for k, v in enumerate([1.0, 1.0, 1.0, 1.0, 9.0, 1.0, None, 1.0])]
    df = spark.createDataFrame(rows, "k string, us long, value double")
    got = [r["qc"] for r in quality.checked(df, "value", "us", ["k"], 0, 8, 2, 3, 5).orderBy("us").collect()]
    assert got == [4, 4, 4, 4, 3, 0, 0, 0]
    causal = [r["qc"] for r in quality.checked(df, "value", "us", ["k"], 0, 8, 2, 3, 5, causal=True).orderBy("us").collect()]
    assert causal == [0, 0, 0, 4, 1, 0, 0, 0]


def frame(spark, seed=1, hours=500):
    """Forecasts of three sources with known biases over a daily wave."""
    rng, rows = np.random.default_rng(seed), []
    for issue in range(0, hours, 12):
        for lead in range(1, 25):
            valid = issue + lead
            truth = 10 + 5 * math.sin(valid * 2 * math.pi / 24) + rng.normal(0, 0.3)
            for s, (bias, noise) in {"a": (2, 0.5), "b": (-1, 1), "c": (0, 3)}.items():
                rows.append((issue, valid, lead, "x" if lead <= 12 else "y", s, truth + bias + rng.normal(0, noise), truth))
    return spark.createDataFrame(rows, "issue long, valid long, lead long, bucket string, source string, x double, y double")


@pytest.fixture(scope="module")
def parts(spark):
    df = frame(spark).cache()
    return matrix.train_test(df, matrix.fold_origins(df, 240, 120), 120)


def mae(pred):
    return pred.agg(F.avg(F.abs(F.col("p") - F.col("y")))).first()[0]


def test_methods_learn_biases(spark, parts):
    errors = {name: mae(f(*parts)) for name, f in methods.METHODS.items()}
    assert errors["grounded_equal_weight"] < 0.9 * errors["equal_weight"] + 0.6
    assert errors["inverse_mse"] < errors["grounded_equal_weight"]
    assert errors["inverse_mse"] < 0.6
    assert abs(errors["affine_equal_weight"] - errors["grounded_equal_weight"]) < 0.5
    assert all(e < 3 for e in errors.values())


def test_sequential_methods(spark, parts):
    assert mae(sequential.experts(*parts)) < mae(methods.equal_weight(*parts)) + 1
    assert mae(sequential.seamless(*parts)) < 0.7
    assert mae(sequential.inverse_covariance(*parts)) < 3
    for f in (sequential.emos, sequential.isotonic_distribution, sequential.conformal):
        pred = f(*parts).where("q is not null")
        inside = pred.agg(F.avg(F.when((F.col("y") >= F.col("q")[1]) & (F.col("y") <= F.col("q")[5]), 1.0).otherwise(0.0))).first()[0]
        assert 0.6 < inside <= 1
        assert pred.where("q[0] > q[6]").count() == 0


def test_emos_fits_on_every_row(spark):
    noise = np.random.default_rng(4).normal(0, 1, 1203)
    at = [(0, k, k + 1, 1, "0-1h", float(noise[k] + (9 if k % 3 == 0 and k < 1200 else 0)), name, float(noise[-k - 1] * 0.1 + bias)) for k in range(1203) for name, bias in (("a", -0.5), ("b", 0.5))]
    df = spark.createDataFrame(at, "fold int, issue long, valid long, lead long, bucket string, y double, source string, x double")
    p = [r["p"] for r in sequential.emos(df.where("issue < 1200"), df.where("issue >= 1200")).collect()]
    assert len(p) == 3 and max(p) < 3  # a third of the rows has the bias, each third one


def test_thin_buckets_are_served_by_the_global_fit(spark):
    rng = np.random.default_rng(5)
    at = [(0, k, k + lead, lead, bucket, float(k % 7 + rng.normal()), "a", float(k % 7)) for k in range(220) for lead, bucket in ((1, "x"), (2, "y")) if lead == 1 or k % 10 == 0]
    df = spark.createDataFrame(at, "fold int, issue long, valid long, lead long, bucket string, y double, source string, x double")
    pred = sequential.or_global(df.where("issue < 200"), df.where("issue >= 200"), sequential.isotonic_distribution)
    assert {r["bucket"]: r["n"] for r in pred.where("q is not null and p is not null").groupBy("bucket").agg(F.count("*").alias("n")).collect()} == {"x": 20, "y": 2}


def test_queries_of_distributions_serve_every_bucket(spark):
    from weftcast.plans import registry

    of = lambda name: {(r["fold"], r["bucket"], r["n"]) for r in registry.queries()[name](spark, "/root/testdata/sf0.001").collect()}
    assert of("e32_emos") == of("e35_idr_bucket_subsampled") == of("e36_idr_calibrated")


def test_future_truth_changes_nothing(spark):
    df = frame(spark, 2, 400)
    origin = matrix.fold_origins(df, 240, 400)
    poisoned = df.withColumn("y", F.when(F.col("valid") + 2 > 240, F.col("y") + 1000).otherwise(F.col("y")))
    for f in (methods.inverse_mse, methods.ewma_equal, sequential.experts, sequential.seamless):
        one_, two = (sorted((r["issue"], r["lead"], round(r["p"], 9)) for r in f(*matrix.train_test(d, origin, 400)).collect()) for d in (df, poisoned))
        assert one_ == two


def test_platt_calibrates():
    rng = np.random.default_rng(1)
    p = rng.random(4000)
    y = (rng.random(4000) < 1 / (1 + np.exp(-(0.5 + 2 * np.log(p / (1 - p)))))).astype(float)
    assert np.allclose(sequential.platt(p, y), [0.5, 2], atol=0.25)
    assert sequential.platt(p, np.zeros(4000)).tolist() == [0, 1]


def test_inference(spark):
    rng = np.random.default_rng(3)
    stat, p = inference.diebold_mariano(rng.normal(0.5, 1, 200), 2)
    assert stat > 3 and p < 0.01
    assert inference.diebold_mariano(np.zeros(20), 1) == (0.0, 1.0)
    losses = np.abs(rng.normal(0, 1, (200, 3))) + [0, 0, 1]
    p = inference.confidence_set(losses)
    assert p[2] < 0.1 < p[0] and p[1] > 0.1
    assert inference.e_value_path(rng.normal(0.5, 1, 300))[-1] > 20 > inference.e_value_path(rng.normal(-0.5, 1, 300))[-1]
    shifted = np.concatenate([rng.normal(0, 1, 200), rng.normal(4, 1, 200)])
    assert inference.page_hinkley(shifted)[0] > 150 and inference.page_hinkley(rng.normal(0, 1, 30))[0] == -1
    series = spark.createDataFrame([("s", k, float(v)) for k, v in enumerate(shifted)], "k string, t long, v double")
    assert abs(inference.snht(series, ["k"], "t", "v").first()["at"] - 199) <= 3
    assert inference.pettitt(series, ["k"], "t", "v").first()["p_value"] < 1e-6
    ps = spark.createDataFrame([("g", 0.01), ("g", 0.04), ("g", 0.03), ("g", None)], "k string, p double")
    assert sorted(r["p_adjusted"] for r in inference.with_bh(ps, "p", ["k"]).collect() if r["p"]) == pytest.approx([0.03, 0.04, 0.04])


def test_relations(spark):
    scores = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a")], "c long, method string")
    assert {r["c"] for r in relations.common_cases(scores, ["c"]).collect()} == {1}
    a, b = (spark.createDataFrame(x, "k long, v long") for x in ([(1, 1), (None, 2)], [(None, 5)]))
    assert [r["k"] for r in relations.novel(a, b, ["k"]).collect()] == [1]
    assert {tuple(r) for r in relations.merged_long(a, b, ["k"]).collect()} == {(1, 1), (None, 5)}


def test_archive(spark, tmp_path):
    path = str(tmp_path / "a.db")
    con = sqlite3.connect(path)
    con.executescript("""CREATE TABLE observations(ts TEXT, outTemp REAL);
        INSERT INTO observations VALUES ('2024-01-01 00:00:00', 50), ('2024-01-01 00:00:00', 60), ('2024-01-01 00:05:00.250', 32), ('bad', 1), (NULL, 2);
        CREATE TABLE forecast_runs(id INTEGER, latitude REAL, longitude REAL, completed_at TEXT); INSERT INTO forecast_runs VALUES (1, 34.0, -117.0, '2024-01-01T00:10:00+00:00'), (2, 50.0, 8.0, '2024-01-01T01:00:00+00:00');
        CREATE TABLE provider_results(id INTEGER, run_id INTEGER, provider TEXT, status TEXT, fetched_at TEXT); INSERT INTO provider_results VALUES (1, 1, 'p', 'success', '2024-01-01T00:00:00+00:00'), (2, 1, 'q', 'failed', '2024-01-01T00:00:00+00:00'), (3, 2, 'p', 'success', NULL);
        CREATE TABLE source_forecasts(id INTEGER, provider_result_id INTEGER, model TEXT); INSERT INTO source_forecasts VALUES (1, 1, 'best_match'), (2, 2, 'x'), (3, 3, 'x');
        CREATE TABLE hourly_points(source_forecast_id INTEGER, timestamp_unix INTEGER, temperature REAL); INSERT INTO hourly_points VALUES (1, 1704070800, 5.5), (2, 1704070800, 6), (3, 1704070800, 7);""")
    con.commit()
    con.close()
    got = archive.station(spark, path, {"temp_c": ("outTemp", "degF"), "wind_ms": ("avgwind", "mph")}).orderBy("ts").collect()
    assert [(round(r["temp_c"], 6), r["wind_ms"]) for r in got] == [(10.0, None), (0.0, None)]
    h = archive.hourly_forecasts(spark, path, 34.0, -117.0).collect()
    assert [(r["source"], r["temperature"], r["humidity"], r["lead_hours"]) for r in h] == [("p", 5.5, None, 1.0)]
    assert archive.completions(spark, path, 34.0, -117.0).count() == 1
    assert archive.latest_location(spark, path).first()["latitude"] == 50.0
    assert archive.table(spark, path, "missing", "a long").count() == 0
    assert archive.table(spark, path, "hourly_points").columns == ["source_forecast_id", "timestamp_unix", "temperature"]


def test_previous_runs(spark):
    payload = spark.createDataFrame([('{"hourly": {"time": ["2024-01-05T00:00"], "t_previous_day1_m": [1.5], "t_previous_day2_m": [null]}}',)], "json string")
    got = archive.previous_runs(payload, ["m"], "t", 2).collect()
    assert [(r["source"], r["x"], (r["valid"] - r["fetched"]).days) for r in got] == [("open_meteo_m", 1.5, 1)]


def test_sinks(spark, tmp_path):
    path = str(tmp_path / "ledger")
    rows = spark.createDataFrame([(1, 10), (2, 20), (None, 30)], "k long, t long")
    assert sinks.append_ledger(rows, path, ["k"]) == 3
    assert sinks.append_ledger(rows.union(spark.createDataFrame([(4, 40)], "k long, t long")), path, ["k"]) == 1
    assert sinks.read_dataset(spark, path, "ledger").count() == 4
    assert sinks.append_ledger(spark.createDataFrame([(5, 50)], "k long, t long"), path, ["k"], "t", 50, 20, 2) == 1
    assert sorted(r["k"] for r in sinks.read_dataset(spark, path, "ledger").collect()) == [4, 5]
    shuffled = rows.repartition(3).orderBy(F.rand(1))
    assert sinks.content_fingerprint(rows) == sinks.content_fingerprint(shuffled) != sinks.content_fingerprint(rows.limit(2))
    scored = spark.createDataFrame([(math.nan, [1.0, math.inf])], "p double, q array<double>")
    assert tuple(sinks.scores_to_rows(scored).first()) == (None, "[1.0, null]")
    files = spark.createDataFrame([("g", f"e{k}", k) for k in range(5)], "group string, evaluation string, created long")
    assert {r["evaluation"] for r in sinks.removable_scores(files, files.where("evaluation = 'e0'")).collect()} == {"e1"}


def test_streams(spark, tmp_path):
    rows = pd.DataFrame({"ts": pd.date_range("2024-01-01", periods=300, freq="1min"), "value": np.arange(300.0), "k": "a", "e": 1.0, "d": 1.0})
    source = str(tmp_path / "in")
    spark.createDataFrame(rows).repartition(3).write.parquet(source)
    schema = spark.read.parquet(source).schema
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)

    def ran(df, mode, name):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
        q.processAllAvailable()
        q.stop()
        return spark.table(name).collect()

    ran(live.hourly_truth(stream(), late="10 hours"), "update", "truth")
    best = {}
    for r in spark.table("truth").collect():
        best[r["valid"]] = max(best.get(r["valid"], 0), r["n"])
    assert sorted(best.values()) == [60] * 5
    bias = ran(live.running_bias(stream(), "k"), "update", "bias")
    assert max(r["n"] for r in bias) == 300 and max(r["bias"] for r in bias) == pytest.approx(1 - 0.95**300)
    e = ran(live.e_values(stream(), "k"), "update", "wealth")
    assert max(r["e_value"] for r in e) > 20
    last = ran(live.newest(stream().select("k", "ts", "value"), ["k"], "ts", "10 hours"), "update", "newest")
    assert max(r["value"] for r in last) == 299


def test_resampling_keeps_serial_correlation():
    index = inference.block_index(125)
    assert index.shape == (500, 125) and ((index[:, 1:5] - index[:, :4]) % 125 == 1).all()
    wave = np.repeat(np.random.default_rng(6).normal(0, 1, 50), 10)
    assert inference.mean_error(wave) > 1.5 * wave.std() / math.sqrt(len(wave))
    both = np.stack([wave, -wave], axis=1) + [0, 2 * wave.mean()]  # equal means
    assert inference.chosen_bias(both) < -0.05
