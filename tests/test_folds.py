"""Fits of all folds out of sums over steps give what each fold's own rows give."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftcast.operators import matrix as M
from weftcast.operators import methods as X
from weftcast.operators.foldsums import Folds

COLUMNS = "issue long, valid long, lead long, bucket string, source string, x double, y double"


@pytest.fixture(scope="module")
def rows(spark):
    """Three sources that come and go, one of them constant, ties, missing truths, a bucket that appears late."""
    rng, out = np.random.default_rng(1), []
    truth = {v: (None if rng.random() < 0.1 else float(np.round(rng.normal(20, 5), 1))) for v in range(0, 400)}
    for issue in range(0, 300, 3):
        for lead in (1, 2, 5, 9, 30):
            for source in ("a", "b", "c"):
                if rng.random() < 0.2 or (source == "b" and issue < 60) or (lead == 30 and issue < 150):
                    continue
                y = truth[issue + lead]
                x = 7.0 if source == "c" and lead == 2 else float(np.round((y if y is not None else 20) + {"a": 1, "b": -2, "c": 0.5}[source] + rng.normal(0, 3), 1))
                out.append((issue, issue + lead, lead, "short" if lead < 3 else "mid" if lead < 12 else "long", source, x, y))
    return spark.createDataFrame(out, COLUMNS).cache()


@pytest.fixture(scope="module")
def both(spark, rows):
    origins = list(range(50, 299, 23))
    return M.train_test(rows, origins, 23), Folds(rows, origins, 23)


def test_rows_of_folds(both):
    (train, test), folds = both
    known = folds.train.select(F.explode(F.sequence("since", F.lit(folds.count - 1))).alias("fold"), "issue", "valid", "source")
    plain = lambda df: sorted(map(tuple, df.select("fold", "issue", "valid", "source").collect()))
    assert plain(known) == plain(train) and plain(folds.test) == plain(test)


@pytest.fixture(scope="module")
def predicted(both):
    return both[1].predicted([*X.METHODS, "sparse_shrink"]).toPandas()


@pytest.mark.parametrize("name", sorted(X.METHODS))
def test_methods(both, predicted, name):
    want = X.METHODS[name](*both[0]).toPandas()
    key = ["fold", "issue", "valid", "lead", "bucket"]
    met = want.merge(predicted[predicted["method"] == name], on=key, how="outer", suffixes=("", "_got"))
    assert len(met) == len(want) and (met["y"] == met["y_got"]).all()
    assert met["p"].isna().equals(met["p_got"].isna())
    off = (met["p"] - met["p_got"]).abs()
    assert off.max() < 1e-8, met[off > 1e-8]


def test_medians_by_many_slices(both, rows, spark):
    """However the order is cut, the median is the same."""
    origins = list(range(50, 299, 23))
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        folds = Folds(rows, origins, 23)
        got = {(r["fold"], r["source"], r["bucket"]): r["median"] for r in folds.medians.collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    pdf = both[0][0].toPandas()
    for (fold, source), g in pdf.groupby(["fold", "source"]):
        whole = float((g["y"] - g["x"]).median())
        for bucket in ("short", "mid", "long"):
            own = g[g["bucket"] == bucket]
            share = len(own) / (len(own) + 6)
            want = share * float((own["y"] - own["x"]).median()) + (1 - share) * whole if len(own) else whole
            assert got[fold, source, bucket] == pytest.approx(want, abs=1e-9)


def test_recency_by_slices(both):
    _, folds = both
    wide, narrow = folds.recency(width=10_000).toPandas(), folds.recency(width=7).toPandas()
    met = wide.merge(narrow, on=["fold", "source", "bucket", "bin"], how="outer")
    assert len(met) == len(wide) == len(narrow) and (met["shift_x"] - met["shift_y"]).abs().max() < 1e-12


def test_no_rows(spark, rows):
    for folds in (Folds(rows.limit(0), [50], 23), Folds(rows, [], 23)):
        assert folds.train.count() == 0 and folds.test.count() == 0
    early = Folds(rows.where("issue < 40"), [0, 20], 20)
    got = early.predicted(["equal_weight", "grounded_equal_weight", "best_provider"]).where("fold = 0").toPandas()
    assert len(got) and got["p"].notna().all()


def test_training_rows_are_read_once(both):
    plan = both[1].train._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan


EDGE = [0, 1, 2, 3, 6, 12, 24]


def plain_curve(shares, counts):
    """The rule of the curve, bin by bin, in plain Python."""
    fitted = [k for k, v in enumerate(shares) if v is not None]
    if not fitted:
        return None
    first = fitted[0]
    out = []
    for k in range(6):
        if k < first:
            good = max(0.2, 2 / counts[first] ** 0.5) <= shares[first] < 1
            out.append(shares[first] ** (X.CENTRES[k] / X.CENTRES[first]) if good else shares[first])
        else:
            out.append(float(np.interp(k, fitted, [shares[j] for j in fitted])))
    return np.minimum.accumulate(out).tolist()


@pytest.mark.parametrize(
    "shares",
    [[None, None, None, None, 0.6, None], [None, None, None, None, 0.1, None], [0.9, None, 0.5, 0.4, None, 0.2], [0.3, 0.5, None, None, 0.1, 0.4], [None, 1.0, None, 0.2, None, None], [None] * 6, [0.0] * 6, [None, 0.25, 0.5, None, None, None]],
)
def test_curve_weights(spark, shares):
    counts = [60, 40, 400, 30, 64, 90]
    row = spark.createDataFrame([(*shares, *counts)], ", ".join([*(f"w{k} double" for k in range(6)), *(f"n{k} long" for k in range(6))]))
    got = list(row.select(*[c.alias(f"v{k}") for k, c in enumerate(X.curve_weights([F.col(f"w{k}") for k in range(6)], [F.col(f"n{k}") for k in range(6)]))]).first())
    want = plain_curve(shares, counts)
    assert got == ([None] * 6 if want is None else pytest.approx(want))
    if shares[4] == 0.6:  # a decay fitted late reaches back towards full weight
        assert got[0] > 0.9 and got[:4] == pytest.approx([(0.6 ** (1 / 9)) ** c for c in (0.5, 1.5, 2.5, 4.5)])
    if shares[4] == 0.1 and shares[0] is None:  # within its own noise: flat
        assert got[0] == pytest.approx(0.1)


def test_lead_zero(spark):
    of = lambda a, b: spark.range(1).select(X.at_lead_zero(F.lit(a), F.lit(b)).alias("z")).first()["z"]
    assert 0.9 < of(0.9, 0.7) <= 1.0 and of(0.5, 0.5) == 0.5 and of(0.0, 0.0) == 0.0 and of(0.4, 0.0) == 0.4 and of(0.99, 0.5) == 1.0


def test_gain_on_the_trend(spark):
    """What the residual leaves is put on the trend, where there is one: 2 hours' worth in the first bin, none where it is thin."""
    rng, rows, seen, slopes = np.random.default_rng(3), [], [], []
    for k in range(80):
        trend = float(np.linspace(-1, 1, 80)[k])
        seen.append((k, 11.0))
        if k >= 5:
            slopes.append((k, trend))
        rows.append((0, k, k, 0, "a", "s", 10.0, 11.0 + 2 * trend + float(rng.normal(0, 1e-3))))
        if k < 10:
            rows.append((0, k, k + 4, 4, "b", "s", 10.0, 11.0 + 3 * trend))
    df = spark.createDataFrame(rows, "fold int, issue long, valid long, lead long, bucket string, source string, x double, y double")
    obs, tr = spark.createDataFrame(seen, "issue long, obs double"), spark.createDataFrame(slopes, "issue long, trend double")
    got = {r["issue"]: r for r in X.fitted_curve(df, df, obs, X.equal_weight, trend=tr).where("lead = 0").collect()}
    off = [abs(got[k]["p"] - got[k]["y"]) for k in range(5, 80)]
    assert max(off) < 0.1 and abs(got[0]["p"] - got[0]["y"]) > 1.5  # no trend is known there


def test_recent_trend(spark):
    obs = spark.createDataFrame([(0, 1.0), (1, 3.0), (3, 4.0), (8, 9.0), (20, None), (21, 5.0)], "issue long, obs double").where("obs is not null")
    assert {r["issue"]: r["trend"] for r in X.recent_trend(obs).collect()} == {1: 2.0, 3: 0.5}
