"""Methods, laws and tests that have no SQL twin, against plain versions of the same rules."""

import json
import math
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from weftcast.functions import scalars as S
from weftcast.functions import special
from weftcast.operators import boosting, inference, methods, sequential, temporal
from weftcast.plans import registry

SF = "/root/testdata/sf0.001"
SCHEMA = "fold int, issue long, valid long, lead long, bucket string, source string, x double, y double"


def history(seed, issues=80, gaps=True):
    """Rows of one fold: three sources around a daily wave, some of them missing."""
    rng, rows = np.random.default_rng(seed), []
    for issue in range(0, 6 * issues, 6):
        for lead in (1, 2, 5, 9):
            valid = issue + lead
            y = 10 + 4 * math.sin(valid / 24 * 2 * math.pi) + rng.normal()
            for s, bias in (("a", 1.0), ("b", -2.0), ("c", 0.0)):
                if not gaps or rng.random() < 0.85:
                    rows.append((0, issue, valid, lead, "x" if lead < 5 else "y", s, y + bias + rng.normal(), y))
    return rows


def halves(spark, rows, cut):
    df = spark.createDataFrame(rows, SCHEMA)
    return df.where(F.col("issue") < cut), df.where(F.col("issue") >= cut)


def wide(rows):
    """Cells in order with their sources as arrays."""
    cells = {}
    for _, issue, valid, lead, bucket, s, x, y in rows:
        cells.setdefault((issue, valid, lead, bucket), [y, {}])[1][s] = x
    return [(k, v[0], np.array([v[1].get(s, math.nan) for s in "abc"])) for k, v in sorted(cells.items())]


def plain_experts(cells, second_order):
    """Weights by the published updates, one round after another."""
    w, v = np.full(3, 1 / 3), np.zeros(3)
    for _, y, x in sorted(cells, key=lambda c: (c[0][1], c[0][0], c[0][2])):
        up = [k for k in range(3) if not math.isnan(x[k])]
        if len(up) < 2:
            continue
        top = max(max(abs(x[k] - y) for k in up), 1e-9)
        loss = {k: abs(x[k] - y) / top for k in up}
        mix = sum(w[k] * loss[k] for k in up) / sum(w[k] for k in up)
        new = {}
        for k in up:
            r = mix - loss[k]
            if second_order:
                v[k] += r * r
                eta = min(0.5, math.sqrt(math.log(len(up)) / v[k])) if v[k] else 0.5
                new[k] = w[k] * math.exp(eta * r - (eta * r) ** 2)
            else:
                new[k] = w[k] * math.exp(min(0.5, math.sqrt(8 * math.log(len(up)) / len(cells))) * r)
        mass = sum(new.values())
        for k in up:
            w[k] = 0.995 * new[k] + 0.005 * mass / len(up)
        w /= w.sum()
    return w


@pytest.mark.parametrize("second_order", [False, True])
def test_experts(spark, second_order):
    rows = history(1)
    old, new = halves(spark, rows, 360)
    got = {(r["issue"], r["lead"]): r["p"] for r in sequential.experts(old, new, second_order).collect()}
    for bucket in "xy":
        w = plain_experts([c for c in wide(rows) if c[0][3] == bucket and c[0][0] < 360], second_order)
        for (issue, _, lead, b), _, x in wide(rows):
            if b == bucket and issue >= 360:
                here = ~np.isnan(x)
                assert got[issue, lead] == pytest.approx((w[here] * x[here]).sum() / w[here].sum(), rel=1e-9)


def test_experts_go_on_where_they_were(spark):
    cells = spark.createDataFrame([(i, v, le, b, y, {s: float(q) for s, q in zip("abc", x) if not math.isnan(q)}) for (i, v, le, b), y, x in wide(history(2))], "issue long, valid long, lead long, bucket string, y double, xs map<string,double>")
    nothing = spark.createDataFrame([], sequential.STATE)
    early = sequential.advanced_experts(cells.where("valid <= 200"), nothing)
    weights = lambda df: {r["bucket"]: json.loads(r["state"])["w"] for r in df.collect()}
    whole, resumed = weights(sequential.advanced_experts(cells, nothing)), sequential.advanced_experts(cells, early)
    assert all(np.allclose(whole[b], w) for b, w in weights(resumed).items())
    assert weights(sequential.advanced_experts(cells, resumed)) == weights(resumed)  # nothing new changes nothing
    forged = early.withColumn("state", F.regexp_replace("state", '"w": \\[[^\\]]*\\]', '"w": [1.0, 0.0, 0.0]'))
    assert not np.allclose(weights(sequential.advanced_experts(cells, forged))["x"], whole["x"])  # a state is believed ...
    other = cells.withColumn("y", F.when(F.col("valid").isin(7, 11), F.col("y") + 1).otherwise(F.col("y")))
    corrected = weights(sequential.advanced_experts(other, nothing))
    assert all(np.allclose(corrected[b], w) for b, w in weights(sequential.advanced_experts(other, forged)).items())  # ... unless what it has seen has changed


def test_seamless_regression(spark):
    rows = history(3)
    old, new = halves(spark, rows, 360)
    obs = {i: float(i % 11) for i in range(0, 480, 12)}
    observed = spark.createDataFrame(list(obs.items()), "issue long, obs double")
    got = {(r["issue"], r["lead"]): r["p"] for r in sequential.seamless(old, new, observed).collect()}
    design, last = [], {}
    for (issue, _, lead, b), y, x in wide(rows):
        before = last.get(issue, np.full(3, math.nan))
        filled = np.where(np.isnan(x), before, x)
        last[issue] = filled
        mean = np.nanmean(filled)
        design.append((issue, lead, b, y, np.array([*np.where(np.isnan(filled), mean, filled), obs.get(issue, mean), 1.0])))
    def fit(part):
        a, y = np.array([d[4] for d in part]), np.array([d[3] for d in part])
        return np.linalg.solve(a.T @ a + 10 * np.eye(5), a.T @ y)
    train = [d for d in design if d[0] < 360]
    whole = fit(train)
    for b in "xy":
        own = [d for d in train if d[2] == b]
        w = len(own) / (len(own) + 12)
        c = w * fit(own) + (1 - w) * whole
        for issue, lead, bucket, _, a in design:
            if bucket == b and issue >= 360:
                assert got[issue, lead] == pytest.approx(a @ c, rel=1e-7)


def test_isotonic_fits_are_least_squares():
    rng = np.random.default_rng(4)
    for n in (1, 2, 3, 30):
        y, w = np.round(rng.random((n, 5)), 1), rng.integers(1, 4, n)
        fit = special.isotonic(y, w)
        for k in range(5):
            mean = lambda a, b: np.average(y[a : b + 1, k], weights=w[a : b + 1])  # noqa: B023, E731
            assert fit[:, k] == pytest.approx([max(min(mean(a, b) for b in range(i, n)) for a in range(i + 1)) for i in range(n)])


def test_isotonic_laws_don_t_depend_on_the_order_of_rows():
    rng = np.random.default_rng(5)
    x, y = rng.integers(0, 6, 300).astype(float), rng.normal(size=300)
    y += x
    one, order = sequential.IsotonicLaw(x, y), rng.permutation(300)
    two = sequential.IsotonicLaw(x[order], y[order])
    assert np.allclose(one.cdf, two.cdf) and one.at.tolist() == [0, 1, 2, 3, 4, 5]
    assert (np.diff(one.cdf, axis=0) <= 1e-12).all() and (np.diff(one.cdf, axis=1) >= -1e-12).all()
    assert one.rows(np.array([2.5])).tolist() == one.rows(np.array([2.0])).tolist()
    assert one.transforms(np.array([3.0, 3.0]), np.array([-99.0, 99.0])).tolist() == [0, 1]


def test_radii_cover():
    rng = np.random.default_rng(6)
    errors, inside = np.abs(rng.normal(0, 2, 4000)), np.zeros(3)
    radii = sequential.Radii()
    for k, e in enumerate(errors):
        if k >= 1000:
            inside += e <= radii.now()
        radii.see(e)
    assert inside / 3000 == pytest.approx(sequential.COVERAGES, abs=0.04)
    warm = sequential.Radii()
    for e in errors[:20]:
        warm.see(e)
    assert warm.radius == pytest.approx([np.sort(errors[:20])[math.ceil(21 * c) - 1] for c in sequential.COVERAGES])


def test_conformal_cells_and_future_errors(spark):
    rows = history(7, 200)
    old, new = halves(spark, rows, 1000)
    pred = sequential.conformal(old, new, day=F.col("valid") % 24 < 12).where("q is not null")
    inside = pred.agg(F.avg(F.when((F.col("y") >= F.col("q")[1]) & (F.col("y") <= F.col("q")[5]), 1.0).otherwise(0.0))).first()[0]
    assert 0.6 < inside < 0.97 and pred.where("q[0] > q[6] or q[3] <> p").count() == 0
    assert pred.count() == sequential.conformal(old, new).count()


def test_analogs(spark):
    rows = history(8, 60)
    old, new = halves(spark, rows, 300)
    got = {(r["issue"], r["lead"]): (r["p"], r["q"]) for r in sequential.analogs(old, new).collect()}
    train = [c for c in wide(rows) if c[0][0] < 300]
    sd = np.nanstd(np.array([x for _, _, x in train]), axis=0)
    for (issue, _, lead, b), _, x in wide(rows):
        if issue < 300:
            continue
        ways = []
        for (_, _, _, tb), ty, tx in train:
            both = ~np.isnan(x) & ~np.isnan(tx)
            if tb == b and both.any():
                ways.append((math.sqrt(np.mean(((x - tx) / sd)[both] ** 2)), ty))
        ways.sort(key=lambda v: v[0])
        assert got[issue, lead][0] == pytest.approx(np.median([y for _, y in ways[:25]]), abs=1e-9)
        assert got[issue, lead][1] == pytest.approx(np.quantile([y for _, y in ways[:25]], sequential.LEVELS), abs=1e-9)


def test_logistic_fits_meet_the_plain_one(spark):
    rng = np.random.default_rng(9)
    rows = []
    for g, n, shift in (("a", 400, 1.0), ("b", 300, -1.5), ("c", 6, 0.0)):
        p = rng.random(n)
        y = (rng.random(n) < 1 / (1 + np.exp(-(shift + 1.7 * np.log(p / (1 - p)))))).astype(float)
        rows += [(g, float(a), float(b)) for a, b in zip(p, y)]
    df = spark.createDataFrame(rows, "g string, p double, y double")
    frame = pd.DataFrame(rows, columns=["g", "p", "y"])
    for beta in (False, True):
        start = [0.0, 1.0, 1.0] if beta else [0.0, 1.0]
        got = sequential.logistic_fits(df, "g", sequential.logit_terms(F.col("p"), beta), F.col("y"), start)
        whole = sequential.platt(frame["p"].to_numpy(), frame["y"].to_numpy(), beta)
        assert got[None] == pytest.approx(whole, abs=1e-4)
        for g, own in frame.groupby("g"):
            w = len(own) / (len(own) + 6)
            assert got[g] == pytest.approx(w * sequential.platt(own["p"].to_numpy(), own["y"].to_numpy(), beta) + (1 - w) * whole, abs=1e-4)


def test_gamma_functions():
    assert special.log_gamma(np.array([0.1, 1, 2.5, 30])) == pytest.approx([math.lgamma(v) for v in (0.1, 1, 2.5, 30)], abs=1e-11)
    for a, x in ((0.5, 0.2), (3, 2), (3, 9), (40, 35)):
        assert special.gamma_below(a, x) == pytest.approx(1 - special.gamma_sf(a, x), abs=1e-10)
        assert special.gamma_quantile(special.gamma_below(a, x), a) == pytest.approx(x, rel=1e-6)
    for a in (140.0, 160.0, 1e4, 1e8):  # on both sides of where the law changes
        q = special.gamma_quantile(np.array([0.05, 0.5, 0.95]), a)
        assert q == pytest.approx([a - 1.645 * a**0.5, a, a + 1.645 * a**0.5], abs=2 + 1e-6 * a)


def test_censored_gamma_law(spark):
    rng, rows = np.random.default_rng(10), []
    for k in range(900):
        base = rng.gamma(2, 3)
        y = max(rng.gamma(max(base, 0.2) ** 2 / 4, 4 / max(base, 0.2)) - 1.0, 0.0)
        rows += [(0, k, k + 1, 1, "x", s, base + d, y) for s, d in (("a", -0.5), ("b", 0.5))]
    old, new = halves(spark, rows, 600)
    pred = sequential.censored_gamma(old, new).where("q is not null")
    inside = pred.agg(F.avg(F.when((F.col("y") >= F.col("q")[1]) & (F.col("y") <= F.col("q")[5]), 1.0).otherwise(0.0))).first()[0]
    assert 0.72 < inside < 0.93 and pred.where("q[0] < 0").count() == 0 and pred.count() == 300
    dry, later = halves(spark, [(*r[:7], 0.0) for r in rows], 600)
    assert sequential.censored_gamma(dry, later).where("q is not null").count() == 0


def test_boosted_trees():
    rng = np.random.default_rng(11)
    x = rng.random((1500, 3))
    y = 4 * x[:, 0] + np.sin(6 * x[:, 1]) + rng.normal(0, 0.1, 1500)
    p = boosting.boosted(x[:1200], y[:1200], x[1200:], rounds=120)
    assert np.abs(p - y[1200:]).mean() < 0.2
    line = np.column_stack([np.linspace(0, 1, 200), np.full(200, 0.3), np.full(200, 0.5)])
    falling = boosting.boosted(x, -y, line, rounds=60)  # the first feature may only raise
    assert (np.diff(falling) >= -1e-9).all()
    q = boosting.boosted(x[:1200], y[:1200], x[1200:], rounds=120, depth=4, level=0.9)
    assert 0.8 < (y[1200:] <= q).mean() < 0.97
    assert boosting.quantiles_by(np.array([0, 2, 0, 0]), np.array([3.0, 9.0, 1.0, 2.0]), 0.5, 4).tolist() == [2, 0, 9, 0]


def test_stacks_abstain_on_few_rows(spark):
    old, new = halves(spark, history(12, 60), 300)
    assert boosting.stacked(old, new).count() == 0
    old, new = halves(spark, history(12, 200), 1000)
    got = boosting.stacked(old, new, rounds=60)
    assert got.agg(F.avg(F.abs(F.col("p") - F.col("y")))).first()[0] < 1.0
    q = boosting.stacked_quantiles(old, new, rounds=15)
    assert q.where("q[0] > q[6]").count() == 0 and q.count() == got.count()


def test_page_hinkley_as_windows(spark):
    rng = np.random.default_rng(13)
    series = {"still": rng.normal(0, 1, 200), "shift": np.concatenate([rng.normal(0, 1, 150), rng.normal(5, 1, 150)]), "fall": np.concatenate([rng.normal(0, 1, 150), rng.normal(-5, 1, 150)]), "short": rng.normal(0, 1, 30), "flat": np.r_[np.zeros(190), 1.0]}
    df = spark.createDataFrame([(k, t, float(v)) for k, s in series.items() for t, v in enumerate(s)], "k string, t long, v double")
    got = {r["k"]: r for r in inference.page_hinkley_table(df, ["k"], "t", "v").collect()}
    assert set(got) == {"still", "shift", "fall"}
    for k, r in got.items():
        first, top = inference.page_hinkley(series[k])
        assert r["highest"] == pytest.approx(top) and r["alarm"] == (first >= 0) == (k != "still")


def test_wealth_goes_on_and_counts_once(spark):
    rng = np.random.default_rng(14)
    rows = [(b, t, float(rng.normal(0.4, 1))) for b in "xy" for t in range(200)]
    df = spark.createDataFrame(rows, "bucket string, valid long, d double")
    nothing = spark.createDataFrame([], f"bucket string, {inference.WEALTH}")
    logs = lambda s: {r["bucket"]: r["log_e"] for r in s.collect()}
    first = inference.advanced_wealth(df.where("valid < 120"), nothing, ["bucket"], "v1")
    both = inference.advanced_wealth(df, first, ["bucket"], "v1")
    for b, v in logs(both).items():
        assert v == pytest.approx(math.log(inference.e_value_path(np.array([d for k, _, d in rows if k == b]))[-1]))
    assert logs(inference.advanced_wealth(df, both, ["bucket"], "v1")) == pytest.approx(logs(both))
    assert logs(inference.advanced_wealth(df.where("valid >= 120"), first, ["bucket"], "v2")) != pytest.approx(logs(both))


def test_gates(spark):
    rng = np.random.default_rng(15)
    times, refs = 300, ["best_provider", "equal_weight"]
    rows, board = [], []
    for bucket, edge in (("clear", 0.6), ("close", 0.0)):
        base = np.abs(rng.normal(2, 0.5, times))
        for m, add in (("best_provider", 0.05), ("equal_weight", 0.0), ("new", -edge - 0.01)):
            loss = base + add + np.abs(rng.normal(0, 0.2, times))
            rows += [(bucket, m, t, float(v)) for t, v in enumerate(loss)]
            board.append((bucket, m, float(loss.mean())))
    board += [("lone", "new", 1.0), ("half", "new", 1.0), ("half", "equal_weight", 2.0), ("led", "best_provider", 1.0), ("led", "equal_weight", 2.0), ("led", "new", 1.5)]
    losses = spark.createDataFrame(rows, "bucket string, method string, valid long, loss double")
    eligible = spark.createDataFrame(board, "bucket string, method string, mae double")
    for rule, held in (("mcs", "mcs_not_separated"), ("sequential", "e_below_threshold"), ("legacy", "dm_not_significant")):
        got = {r["bucket"]: r for r in inference.gated(losses, eligible, ["bucket"], refs, rule).collect()}
        assert set(got) == {"clear", "close", "half", "led"}
        assert got["clear"]["winner"] == "new" and got["clear"]["gate"] is None
        if got["close"]["candidate"] == "new":
            assert got["close"]["winner"] != "new" and got["close"]["gate"] == held
        assert (got["half"]["winner"], got["half"]["gate"]) == ("equal_weight", "missing_reference")
        assert (got["led"]["winner"], got["led"]["gate"]) == ("best_provider", None)


def test_the_winner_s_curse_is_taken_back():
    rng = np.random.default_rng(16)
    naive, fixed, covered = [], [], 0
    for _ in range(60):
        losses = rng.normal(1.0, 1.0, (80, 6))  # all are equally good: the least mean is too low
        median, upper = inference.median_unbiased(losses, draws=2000)
        naive.append(losses.mean(axis=0).min())
        fixed.append(median)
        covered += upper >= 1.0
    assert np.median(naive) < 0.9 < np.median(fixed) < 1.1 and covered >= 48
    clear = np.column_stack([rng.normal(1, 0.1, 200), rng.normal(9, 0.1, 200)])
    assert inference.median_unbiased(clear, draws=2000)[0] == pytest.approx(clear[:, 0].mean(), abs=0.02)
    assert inference.median_unbiased(np.ones((20, 2))) is None


def test_e_discoveries(spark):
    values = [50.0, 30.0, 12.0, 11.0, 1.0, 0.2, None]
    df = spark.createDataFrame([("g", v) for v in values], "g string, e double")
    got = sorted(((r["e"], r["discovery"]) for r in inference.e_benjamini_hochberg(df, "e", ["g"], 0.2).collect()), key=lambda v: (v[0] is None, v[0]))
    known = sorted((v for v in values if v is not None), reverse=True)
    k = max((j for j in range(1, 7) if j * known[j - 1] / 6 >= 5), default=0)
    assert [d for _, d in got] == [v is not None and v >= known[k - 1] for v, _ in got]


def brute_asof(left, right, tolerance):
    out = {}
    for k, t in left:
        old = [r for r in right if r[0] == k and r[1] <= t and (tolerance is None or t - r[1] <= tolerance)]
        out[k, t] = max(old, key=lambda r: r[1])[2] if old else None
    return out


@pytest.mark.parametrize(("tolerance", "width"), [(7, None), (7, 3), (None, 10), (None, None), (0, 5)])
def test_sliced_as_of_joins(spark, tolerance, width):
    rng = np.random.default_rng(17)
    left = sorted({("ab"[int(rng.integers(2))], int(t)) for t in rng.integers(-50, 300, 120)})
    right = [(k, t, int(rng.integers(100)) if rng.random() < 0.9 else None) for k, t in sorted({("abc"[int(rng.integers(3))], int(t)) for t in rng.integers(-60, 200, 60)})]
    got = temporal.asof_join(spark.createDataFrame(left, "k string, t long"), spark.createDataFrame(right, "k string, at long, v long"), "t", "at", ["k"], tolerance, ["v"], width=width)
    assert {(r["k"], r["t"]): r["v"] for r in got.collect()} == brute_asof(left, right, tolerance)
    assert got.count() == len(left)


def test_sliced_windows(spark):
    rng = np.random.default_rng(18)
    rows = [("ab"[int(rng.integers(2))], int(t), float(rng.integers(50))) for t in rng.integers(-100, 3000, 300)]
    got = temporal.rolling_median(spark.createDataFrame(rows, "k string, t long, v double"), "v", ["k"], "t", 40, "med", "n", slices=2).collect()
    assert len(got) == len(rows)
    for r in got:
        near = [v for k, t, v in rows if k == r["k"] and r["t"] - 40 < t <= r["t"]]
        assert (r["med"], r["n"]) == (np.median(near), len(near))
    times = sorted({t for _, t, _ in rows})
    numbers = temporal.numbered(spark.createDataFrame([(t,) for t in times], "t long"), "t", 100).collect()
    assert {r["t"]: r["__number"] for r in numbers} == {t: k for k, t in enumerate(times)}


def test_no_window_is_keyed_by_a_few_values_alone(spark):
    """Windows over the log have a time slice in their key."""
    for name in ("j1_asof_selection", "j2_observation_at_issue", "j3_trend", "w6_range_median", "w7_rolling_correlation", "w12_regime_runs"):
        plan = registry.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
        for keys in re.findall(r"Window \[.*?\], \[([^\]]*)\], \[", plan):
            assert "slice" in keys or keys == "", (name, keys)


def test_breaks_and_criticals(spark):
    rng = np.random.default_rng(19)
    series = {"broken": np.concatenate([rng.normal(0, 1, 20), rng.normal(6, 1, 20)]), "whole": rng.normal(0, 1, 40), "short": rng.normal(0, 1, 5)}
    df = spark.createDataFrame([(k, t, float(v)) for k, s in series.items() for t, v in enumerate(s)], "k string, t long, v double")
    got = {r["k"]: r for r in inference.broken(df, ["k"], "t", "v").collect()}
    assert set(got) == {"broken", "whole"}
    assert got["broken"]["breaks"] and got["broken"]["day"] == 20 and not got["whole"]["breaks"] and got["whole"]["day"] is None
    z = (series["broken"] - series["broken"].mean()) / series["broken"].std()
    assert got["broken"]["t"] == pytest.approx(max(k * z[:k].mean() ** 2 + (40 - k) * z[k:].mean() ** 2 for k in range(1, 40)))
    limits = [spark.range(1).select(inference.snht_critical(F.lit(n)).alias("v")).first()["v"] for n in (3, 7, 12, 60, 99)]
    assert limits == pytest.approx([5.5, 5.5, 6.61, 8.72, 8.72])


def test_columns_of_the_normal_law(spark):
    z = [-3.0, -0.4, 0.0, 1.3, 2.7]
    df = spark.createDataFrame([(v,) for v in z], "z double")
    got = df.select("z", S.normal_cdf(F.col("z")).alias("c"), S.normal_pdf(F.col("z")).alias("d"), S.gaussian_crps(F.lit(1.0), F.lit(2.0), F.col("z")).alias("s")).collect()
    for r in got:
        assert r["c"] == pytest.approx(special.normal_cdf(r["z"]), abs=2e-7) and r["d"] == pytest.approx(special.normal_pdf(r["z"]))
        assert r["s"] == pytest.approx(float(special.gaussian_crps(1.0, 2.0, r["z"])), abs=1e-6)
    arr = lambda *v: F.array(*map(F.lit, v))
    low, high = S.coherent(arr(1.0, 5.0, 4.0), arr(2.0, 1.0, 9.0))
    assert tuple(df.limit(1).select(low.alias("a"), high.alias("b")).first()) == ([1, 1, 4], [2, 5, 9])


def test_harmonic_curves_fall_back(spark):
    rows = history(20, 60, gaps=False)
    old, new = halves(spark, rows, 300)
    flat = F.lit(30.0)
    got = methods.harmonic_grounded(old, new, flat).agg(F.avg(F.abs(F.col("p") - F.col("y")))).first()[0]
    assert got < methods.equal_weight(old, new).agg(F.avg(F.abs(F.col("p") - F.col("y")))).first()[0]
    few = methods.harmonic_grounded(old.limit(30), new, flat)
    assert {round(r["p"], 9) for r in few.collect()} == {round(r["p"], 9) for r in methods.equal_weight(old, new).collect()}
