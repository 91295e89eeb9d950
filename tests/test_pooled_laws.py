"""Laws fitted over all rows of a fold, against plain fits on the rows of the fold in one place."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftcast.functions import special
from weftcast.operators import laws, methods, sequential

ROW = "fold int, issue long, valid long, lead long, bucket string, source string, x double, y double"


def table(spark, seed, n=400, folds=2, noise=1.0, shift=0.0, buckets=("a", "b", "c")):
    rng, rows = np.random.default_rng(seed), []
    for fold in range(folds):
        for k in range(n):
            truth = float(np.round(rng.gamma(3, 2) + shift, 1))
            bucket = buckets[k % len(buckets)]
            for s, bias in (("p", 0.6), ("q", -0.2)):
                if rng.random() < 0.9:
                    rows.append((fold, k, k + 1, 1, bucket, s, float(np.round(truth + bias + rng.normal(0, noise), 1)), truth))
    return spark.createDataFrame(rows, ROW).repartition(5)


def halves(df, cut):
    return df.where(F.col("issue") < cut), df.where(F.col("issue") >= cut)


def plain_cells(df):
    return laws.learned(df).toPandas()


def test_normal_law_is_as_good_as_a_simplex_search(spark):
    old, new = halves(table(spark, 1), 300)
    cells = plain_cells(old)
    fits = {}
    original = laws.served
    try:
        laws.served = lambda test, q_of, found, levels: fits.update(found) or original(test, q_of, found, levels)
        pred = laws.emos(old, new).toPandas()
    finally:
        laws.served = original
    assert set(fits) == {0, 1} and len(pred["q"].iloc[0]) == 19
    for fold, g in cells.groupby("fold"):
        def loss(t, g=g):
            return float(g["w"] @ special.gaussian_crps(t[0] + t[1] * g["p"], np.maximum(np.exp(t[2] + t[3] * g["s"]), 1e-3), g["y"]))

        plain = special.simplex_search(loss, np.array([0.0, 1.0, math.log(float(np.std(g["y"] - g["p"]))), 0.0]), 2000)
        assert loss(fits[fold]) <= loss(plain) + 1e-6
    inside = ((pred["y"] >= pred["q"].str[1]) & (pred["y"] <= pred["q"].str[17])).mean()
    assert 0.7 < inside < 0.9 and pred["bucket"].nunique() == 3


def test_thin_folds_have_the_point_alone(spark):
    rows = [(0, k, k + 1, 1, "a", s, float(k % 5) + d, float(k % 5)) for k in range(30) for s, d in (("p", 0.01), ("q", -0.01))]
    old, new = halves(spark.createDataFrame(rows, ROW), 25)
    for method in (laws.emos, laws.isotonic_distribution, laws.censored_gamma, sequential.emos):
        got = method(old, new).toPandas()
        assert len(got) == 5 and got["q"].isna().all() and np.allclose(got["p"], got["y"])
    assert laws.emos(old.limit(0), new).where("q is not null").count() == 0 and laws.emos(old, new.limit(0)).count() == 0


def test_tight_sources_have_a_tight_law(spark):
    rng = np.random.default_rng(3)
    rows = [(0, k, k + 1, 1, "a", s, float(k % 5) + float(rng.normal(0, 0.01)), float(k % 5)) for k in range(150) for s in "pq"]
    got = laws.emos(*halves(spark.createDataFrame(rows, ROW), 120)).toPandas()
    assert (got["q"].str[18] - got["q"].str[0]).max() < 0.1


@pytest.mark.parametrize("bounds", [(0.0, None), (None, 20.0), (0.0, 20.0)])
def test_bounded_laws_stay_in_bounds(spark, bounds):
    df = table(spark, 4, folds=1, shift=-1.5).withColumn("y", F.greatest(F.col("y"), F.lit(0.0)))
    df = df.withColumn("y", F.least(F.col("y"), F.lit(20.0)))
    low, high = bounds
    old, new = halves(df, 300)
    got = laws.emos(old, new, minimum=low, maximum=high).toPandas()
    q = np.stack(got["q"])
    assert (np.diff(q, axis=1) >= 0).all() and (low is None or q.min() >= low) and (high is None or q.max() <= high)
    cells = plain_cells(old)
    a, b = (-math.inf if low is None else low), (math.inf if high is None else high)

    def loss(t):
        mu, sigma = t[0] + t[1] * cells["p"].to_numpy(), np.maximum(np.exp(t[2] + t[3] * cells["s"].to_numpy()), 1e-3)
        z = (cells["y"].to_numpy() - mu) / sigma
        mass = np.array([math.log(max(special.normal_cdf(v) - special.normal_cdf(u), 1e-300)) for u, v in zip((a - mu) / sigma, (b - mu) / sigma)])
        return float(cells["w"] @ (z * z / 2 + np.log(sigma) + mass))

    plain = special.simplex_search(loss, np.array([0.0, 1.0, 0.0, 0.0]), 3000)
    mu, sigma = plain[0] + plain[1] * laws.cells(new).toPandas()["p"].to_numpy(), None
    assert abs(np.median(q[:, 9]) - np.median(np.clip(mu, 0, 20))) < 0.5


def test_truths_beyond_a_bound_fall_back_to_the_unbounded_fit(spark):
    df = table(spark, 5, folds=1)
    old, new = halves(df, 300)
    odd = old.withColumn("y", F.when(F.col("issue") == 17, F.lit(-0.5)).otherwise(F.col("y")))
    got = laws.emos(odd, new, minimum=0.0).toPandas()
    free = laws.emos(odd, new).toPandas()
    met = got.merge(free, on=["fold", "issue"])
    assert got["q"].notna().all() and (got["q"].str[0] >= 0).all() and (met["q_x"].str[9] - met["q_y"].str[9]).abs().median() < 0.2


def test_truncated_quantiles_far_out():
    p = np.array([0.05, 0.5, 0.95])
    far = special.truncated_normal_quantile(p, -30.0, 1.0, 0.0, math.inf)
    assert far == pytest.approx(-np.log(1 - p) / 30, rel=0.02)  # the tail of a normal law is nearly exponential
    assert special.truncated_normal_quantile(p, 30.0, 1.0, -math.inf, 0.0) == pytest.approx(np.sort(-far)[[0, 1, 2]][np.argsort([0, 1, 2])], rel=1e-6)
    assert special.truncated_normal_quantile(p, 0.0, 1.0, -1e9, 1e9) == pytest.approx([special.normal_ppf(v) for v in p], abs=1e-9)
    x = np.array([-40.0, -8.0, -2.0, 0.3])
    assert special.normal_quantile_of_log(special.normal_log_cdf(x)) == pytest.approx(x, rel=1e-9)


def test_exact_quantiles(spark):
    rng = np.random.default_rng(6)
    rows = [(k, float(v)) for k, n in ((1, 1), (2, 2), (3, 257), (4, 1000)) for v in np.round(rng.normal(0, 2, n), 1)]
    got = laws.exact_quantiles(spark.createDataFrame(rows, "fold int, y double").repartition(7), "fold", "y", laws.GRID)
    for k in (1, 2, 3, 4):
        assert got[k] == pytest.approx(np.quantile([v for f, v in rows if f == k], laws.GRID), abs=1e-12)


@pytest.mark.parametrize("cuts", [1, 3, 10])
def test_pools_meet(cuts):
    """Pooling in parts and then the blocks gives what pooling all rows gives, however bases tie across the parts."""
    rng = np.random.default_rng(7)
    base = np.sort(rng.integers(0, 40, 500)).astype(float)
    y = base / 10 + rng.normal(0, 2, 500)
    grid = np.unique(np.quantile(y, laws.GRID))
    pools = laws.Pools(grid)
    for part in np.array_split(np.arange(500), cuts):
        pools.add(base[part], y[part])
    column, start, value, _ = pools.all()
    law = sequential.IsotonicLaw(base, y, grid)
    for z in range(grid.size):
        own = column == z
        got = 1 - value[own][np.searchsorted(start[own], law.at, "right") - 1]
        plain = 1 - special.isotonic(np.array([(y[base == b] > grid[z]).mean() for b in law.at]), np.array([(base == b).sum() for b in law.at], float))
        assert got == pytest.approx(plain, abs=1e-12)


@pytest.mark.parametrize("noise", [0.0, 2.0])
def test_isotonic_law_is_pooled_over_buckets(spark, noise):
    old, new = halves(table(spark, 8, n=300, noise=noise), 240)
    got = laws.isotonic_distribution(old, new).toPandas().sort_values(["fold", "issue"])
    cells, later = laws.cells(old).toPandas(), laws.cells(new).toPandas().sort_values(["fold", "issue"])
    for fold, g in cells.groupby("fold"):
        law = sequential.IsotonicLaw(g["p"].to_numpy(), g["y"].to_numpy())
        want = sequential.read_off(law.rows(later[later["fold"] == fold]["p"].to_numpy()), law.grid, laws.LEVELS)
        assert np.stack(got[got["fold"] == fold]["q"]) == pytest.approx(np.stack(want), abs=1e-6)
    assert got["p"].to_numpy() == pytest.approx(got["q"].str[9].to_numpy())


def test_gamma_law_is_as_good_as_a_simplex_search(spark):
    rng, rows = np.random.default_rng(10), []
    for k in range(500):
        base = rng.gamma(2, 3)
        y = max(float(rng.gamma(max(base, 0.2) ** 2 / 4, 4 / max(base, 0.2))) - 1.0, 0.0)
        rows += [(0, k, k + 1, 1, "xy"[k % 2], s, float(base + d + rng.normal(0, 0.3)), y) for s, d in (("a", -0.5), ("b", 0.5))]
    old, new = halves(spark.createDataFrame(rows, ROW), 400)
    got = laws.censored_gamma(old, new).toPandas()
    assert len(got) == 100 and got["q"].str[0].min() >= 0 and 0.6 < ((got["y"] >= got["q"].str[1]) & (got["y"] <= got["q"].str[17])).mean() < 0.95


def test_path_term_helps_where_the_path_knows_more(spark):
    rng, rows = np.random.default_rng(12), []
    for k in range(400):
        y = float(rng.normal(20, 4))
        path = y + float(rng.normal(0, 0.3))
        rows += [(0, k, k + 1, 1, "a", s, y + float(rng.normal(0, 3)), path, y) for s in "pq"]
    df = spark.createDataFrame(rows, "fold int, issue long, valid long, lead long, bucket string, source string, x double, path double, y double")
    old, new = halves(df, 300)
    off = lambda pred: float((pred["p"] - pred["y"]).abs().mean())
    assert off(laws.emos(old, new, path=True).toPandas()) < 0.5 < off(laws.emos(old, new).toPandas())
    gone = df.withColumn("path", F.lit(None).cast("double"))
    old, new = halves(gone, 300)
    assert laws.emos(old, new, path=True).where("q is not null").count() == 100


def test_grounded_rows_keep_the_spread_as_given(spark):
    df = table(spark, 13, folds=1).withColumn("raw", F.col("x"))
    old, _ = halves(df, 300)
    plain = laws.cells(old).select("issue", "s").orderBy("issue").collect()
    assert laws.cells(methods.grounded(old, old)).select("issue", "s").orderBy("issue").collect() == plain
