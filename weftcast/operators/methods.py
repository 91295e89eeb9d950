"""Blending methods. Each takes training and test rows of all folds at once (fold, issue, valid, lead, bucket, source, x, y) and returns predictions (fold, issue, valid, lead, bucket, y, p). Fits are grouped aggregates on two levels, a source's bucket and the source, so all folds cost one job."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import anchor_weight, interpolated, trimmed_mean
from .temporal import asof_join

KEY = ["fold", "source"]
CELL = ["fold", "issue", "valid", "lead", "bucket"]
#: Rows of prior weight with which a bucket is drawn to its source's fit.
PRIOR = 6.0

METHODS: dict[str, Callable[[DataFrame, DataFrame], DataFrame]] = {}


def method(name: str):
    def put(f):
        METHODS[name] = f
        return f

    return put


def two_levels(train: DataFrame, by: list[str], **aggregates: Column) -> tuple[DataFrame, DataFrame]:
    """The aggregates by ``by`` and bucket (with n), and by ``by`` alone, named with a leading g_; one pass over the rows."""
    both = train.groupingSets([[*by, "bucket"], by], *by, "bucket").agg(F.grouping("bucket").alias("__g"), F.count("*").alias("n"), *[v.alias(k) for k, v in aggregates.items()])
    local = both.where("__g = 0").drop("__g")
    whole = both.where("__g = 1").select(*by, *[F.col(k).alias(f"g_{k}") for k in aggregates])
    return local, whole


def shrunk(rows: DataFrame, levels: tuple[DataFrame, DataFrame], by: list[str], names: list[str], none: float) -> DataFrame:
    """Joins the fit to rows: n/(n + PRIOR) of the bucket's and the rest of the source's."""
    local, whole = levels
    out = rows.join(whole, by, "left").join(local, [*by, "bucket"], "left")
    w = F.coalesce(F.col("n") / (F.col("n") + PRIOR), F.lit(0.0))
    for c in names:
        out = out.withColumn(c, F.coalesce(w * F.coalesce(F.col(c), F.col(f"g_{c}")) + (1 - w) * F.col(f"g_{c}"), F.lit(none)))
    return out.drop("n", *[f"g_{c}" for c in names])


def grounded(train: DataFrame, rows: DataFrame, correction: Column | None = None) -> DataFrame:
    """Rows with each source's shrunk bias added."""
    bias = F.avg(F.col("y") - F.col("x")) if correction is None else correction
    return shrunk(rows, two_levels(train, KEY, bias=bias), KEY, ["bias"], 0.0).withColumn("x", F.col("x") + F.col("bias")).drop("bias")


def mean_of(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*CELL).agg(F.first("y").alias("y"), F.avg("x").alias("p"))


@method("equal_weight")
def equal_weight(train, test):
    return mean_of(test)


@method("grounded_equal_weight")
def grounded_equal_weight(train, test):
    return mean_of(grounded(train, test))


@method("grounded_median_equal_weight")
def grounded_median(train, test):
    return mean_of(grounded(train, test, F.median(F.col("y") - F.col("x"))))


@method("affine_equal_weight")
def affine(train, test):
    """y = a + b x; without spread in x, or with a slope over 5, the source stays as it is."""
    ok = (F.var_pop("x") * F.count("*") >= 1e-9) & (F.abs(F.try_divide(F.covar_pop("x", "y"), F.var_pop("x"))) <= 5)
    slope = F.when(ok, F.try_divide(F.covar_pop("x", "y"), F.var_pop("x"))).otherwise(1.0)
    intercept = F.when(ok, F.avg("y") - F.try_divide(F.covar_pop("x", "y"), F.var_pop("x")) * F.avg("x")).otherwise(0.0)
    rows = shrunk(test, two_levels(train, KEY, slope=slope, intercept=intercept), KEY, ["slope"], 1.0)
    levels = two_levels(train, KEY, intercept=intercept)
    rows = shrunk(rows.drop("intercept", "g_intercept"), levels, KEY, ["intercept"], 0.0)
    return mean_of(rows.withColumn("x", F.col("intercept") + F.col("slope") * F.col("x")))


@method("best_provider")
def best_provider(train, test):
    """Of the sources present in a cell, the one of least error: the bucket's where it has 24 rows, else the source's overall."""
    local, whole = two_levels(train, KEY, mae=F.avg(F.abs(F.col("x") - F.col("y"))))
    rows = test.join(whole, KEY, "left").join(local, [*KEY, "bucket"], "left")
    rank = F.coalesce(F.when(F.col("n") >= 24, F.col("mae")), F.col("g_mae"), F.lit(float("inf")))
    return rows.withColumn("rank", rank).groupBy(*CELL).agg(F.first("y").alias("y"), F.min_by("x", F.struct("rank", "source")).alias("p"))


def inverse_loss(train: DataFrame, test: DataFrame, power: int) -> DataFrame:
    """Grounded, then weighted by 1 / mean loss, drawn to the overall weights; a source of fewer than 12 rows counts as the worst, and if all are thin all count alike."""
    fixed = grounded(train, train)
    loss = F.avg(F.pow(F.abs(F.col("x") - F.col("y")), F.lit(power)))

    def weights(rows: DataFrame, by: list[str]) -> DataFrame:
        w = Window.partitionBy(*by)
        stat = rows.groupBy(*by, "source").agg(F.count("*").alias("k"), loss.alias("loss"))
        worst = F.max(F.when(F.col("k") >= 12, F.col("loss"))).over(w)
        used = F.coalesce(F.when(F.col("k") >= 12, F.col("loss")), worst, F.lit(1.0))
        raw = 1 / F.greatest(used, F.lit(1e-6))
        return stat.withColumn("w", raw).withColumn("w", F.col("w") / F.max("w").over(w)).drop("loss")

    counts = fixed.groupBy("fold", "bucket").agg(F.count_distinct("issue", "valid").alias("n"))
    local = weights(fixed, ["fold", "bucket"]).select("fold", "bucket", "source", "w")
    whole = weights(fixed, ["fold"]).select("fold", "source", F.col("w").alias("g_w"))
    rows = grounded(train, test).join(whole, KEY, "left").join(local, ["fold", "bucket", "source"], "left").join(counts, ["fold", "bucket"], "left")
    share = F.coalesce(F.col("n") / (F.col("n") + PRIOR), F.lit(0.0))
    rows = rows.withColumn("w", F.coalesce(share * F.coalesce("w", "g_w") + (1 - share) * F.col("g_w"), F.lit(1.0)))
    return rows.groupBy(*CELL).agg(F.first("y").alias("y"), (F.sum(F.col("w") * F.col("x")) / F.sum("w")).alias("p"))


@method("inverse_mse")
def inverse_mse(train, test):
    return inverse_loss(train, test, 2)


@method("inverse_mae")
def inverse_mae(train, test):
    return inverse_loss(train, test, 1)


def trimmed(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*CELL).agg(F.first("y").alias("y"), F.collect_list("x").alias("xs")).withColumn("p", trimmed_mean(F.col("xs"))).drop("xs")


@method("trimmed_mean")
def trimmed_equal(train, test):
    return trimmed(test)


@method("grounded_trimmed_mean")
def trimmed_grounded(train, test):
    return trimmed(grounded(train, test))


def ewma_corrected(train: DataFrame, rows: DataFrame, rate: float = 0.05, prior: float = 10.0) -> DataFrame:
    """Each source's running bias by bucket and three-hour bin, in issue order; in closed form it is a sum with geometric weights, so no state is replayed."""
    cell = ["fold", "source", "bucket", "bin"]
    binned = lambda df: df.withColumn("bin", F.floor(F.pmod("valid", F.lit(24)) / 3))
    order = Window.partitionBy(*cell).orderBy("issue", "valid")
    terms = binned(train).withColumn("i", F.row_number().over(order)).withColumn("n", F.count("*").over(Window.partitionBy(*cell)))
    bias = terms.groupBy(*cell).agg(F.count("*").alias("n"), F.sum(rate * F.pow(F.lit(1 - rate), F.col("n") - F.col("i")) * (F.col("x") - F.col("y"))).alias("bias"))
    out = binned(rows).join(bias, cell, "left")
    return out.withColumn("x", F.col("x") - F.coalesce(F.col("n") / (F.col("n") + prior) * F.col("bias"), F.lit(0.0))).drop("n", "bias", "bin")


@method("ewma_grounded_equal_weight")
def ewma_equal(train, test):
    return mean_of(ewma_corrected(train, test))


@method("ewma_inverse_mae")
def ewma_inverse_mae(train, test):
    """Corrected sources, weighted by 1 / mean error over all buckets."""
    loss = ewma_corrected(train, train).groupBy(*KEY).agg((1 / F.greatest(F.avg(F.abs(F.col("x") - F.col("y"))), F.lit(1e-6))).alias("w"))
    rows = ewma_corrected(train, test).join(loss, KEY, "left").withColumn("w", F.coalesce("w", F.lit(1.0)))
    return rows.groupBy(*CELL).agg(F.first("y").alias("y"), (F.sum(F.col("w") * F.col("x")) / F.sum("w")).alias("p"))


def first_residual(base: DataFrame, observed: DataFrame) -> DataFrame:
    """The observation at issue less the base at the issue's shortest lead under six hours."""
    near = base.where("lead < 6").groupBy("fold", "issue").agg(F.min_by("p", "lead").alias("p0"))
    return near.join(observed.select("issue", "obs"), "issue").select("fold", "issue", (F.col("obs") - F.col("p0")).alias("r0"))


TAUS = (0.0, 0.5, 1.0, 2.0, 3.0, 6.0, 12.0, 24.0)


def anchored(train: DataFrame, test: DataFrame, observed: DataFrame, base=grounded_equal_weight) -> DataFrame:
    """The base plus a share of its first residual that decays with the lead; the decay time (or none) has the least squared error in training, the smallest among equals."""
    weights = {0.0: F.lit(0.0), **{t: anchor_weight(F.col("lead"), t) for t in TAUS[1:]}}
    weight = F.lit(0.0)
    for t, w in weights.items():
        weight = F.when(F.col("tau") == t, w).otherwise(weight)
    in_train, in_test = (base(train, rows) for rows in (train, test))
    with_r = lambda rows: rows.join(first_residual(rows, observed), ["fold", "issue"], "left")
    # All decay times are sums of one pass; rows aren't multiplied by them.
    error = lambda w: F.round(F.avg(F.pow(F.col("p") + w * F.col("r0") - F.col("y"), F.lit(2))), 9)
    tried = with_r(in_train).where("r0 is not null").groupBy("fold").agg(*[error(w).alias(f"m{k}") for k, w in enumerate(weights.values())])
    best = tried.select("fold", F.array_min(F.array(*[F.struct(F.col(f"m{k}").alias("m"), F.lit(t).alias("tau")) for k, t in enumerate(weights)]))["tau"].alias("tau"))
    rows = with_r(in_test).join(best, "fold", "left").withColumn("tau", F.coalesce("tau", F.lit(0.0)))
    return rows.withColumn("p", F.col("p") + weight * F.coalesce("r0", F.lit(0.0))).select(*CELL, "y", "p")


#: Left edges of the lead bins of a fitted anchoring curve, the lead from which nothing of the residual is left, the largest gain on a trend in hours.
BINS, END, MOST_GAIN = (0, 1, 2, 3, 6, 12), 24, 3.0
CENTRES = [(a + b) / 2 for a, b in zip([*BINS], [*BINS[1:], END])]


def curve_weights(shares: list[Column], counts: list[Column]) -> list[Column]:
    """The weight of the residual in each bin, out of the fitted shares (null where a bin is too thin).

    Bins between fitted ones lie on straight lines by their number, those behind the last are as it is. Those before the
    first follow the decay that its share implies from full weight at lead 0 (share ** (lead / its lead)), if it is
    credible, at least 0.2 and two standard errors, and under 1; else they are as it is. Weights never rise with the lead.
    """
    fitted = [F.when(v.isNotNull(), F.struct(F.lit(k).alias("k"), v.alias("w"), n.alias("n"), F.lit(CENTRES[k]).alias("at"))) for k, (v, n) in enumerate(zip(shares, counts))]
    first = F.coalesce(*fitted)
    credible = (first["w"] >= F.greatest(F.lit(0.2), 2 / F.sqrt(first["n"]))) & (first["w"] < 1)
    out: list[Column] = []
    for k, centre in enumerate(CENTRES):
        old, new = F.coalesce(*reversed(fitted[: k + 1])), F.coalesce(*fitted[k:])
        line = old["w"] + (k - old["k"]) / F.when(new["k"] > old["k"], new["k"] - old["k"]).otherwise(1) * (new["w"] - old["w"])
        before = F.when(credible, F.pow(first["w"], centre / first["at"])).otherwise(first["w"])
        filled = F.when(old.isNull(), before).when(new.isNull(), old["w"]).otherwise(line)
        out.append(filled if not out else F.least(out[-1], filled))
    return out


def at_lead_zero(first: Column, second: Column) -> Column:
    """The weight at lead 0: the decay between the first two bins carried on, 1 at most; what doesn't fall stays as it is."""
    decay = F.pow(second / first, F.lit(1 / (CENTRES[1] - CENTRES[0])))
    return F.when(first <= 0, 0.0).when((second <= 0) | (second >= first), first).otherwise(F.least(F.lit(1.0), first * F.pow(decay, F.lit(-CENTRES[0]))))


def fitted_curve(train: DataFrame, test: DataFrame, observed: DataFrame, base=grounded_equal_weight, least: int = 24, trend: DataFrame | None = None) -> DataFrame:
    """The base plus a share of its first residual that falls with the lead as fitted: sum(r0 e) / sum(r0 r0) for each bin of ``least`` rows, in [0, 1]; see ``curve_weights``. In between straight lines through the bins' middles, from ``at_lead_zero`` to none at a day. trend (issue, trend) adds a gain on the observations' slope for each fitted bin of ``least`` rows that have one, in [0, MOST_GAIN] hours, fitted on what the residual leaves. A fold without a fitted bin isn't anchored."""
    edges = [*BINS, END]

    def with_r(rows: DataFrame) -> DataFrame:
        points = base(train, rows)
        points = points.join(first_residual(points, observed), ["fold", "issue"], "left")
        return points.withColumn("trend", F.lit(None).cast("double")) if trend is None else points.join(trend.select("issue", "trend"), "issue", "left")

    e, r = F.col("y") - F.col("p"), F.col("r0")
    sums = []
    for k, (low, high) in enumerate(zip(edges, edges[1:])):
        inside = (F.col("lead") >= low) & (F.col("lead") < high)
        also = inside & F.col("trend").isNotNull()
        sums += [F.count_if(inside).alias(f"n{k}"), F.sum(F.when(inside, r * e)).alias(f"re{k}"), F.sum(F.when(inside, r * r)).alias(f"rr{k}")]
        sums += [F.count_if(also).alias(f"m{k}"), F.sum(F.when(also, F.col("trend") * e)).alias(f"te{k}"), F.sum(F.when(also, F.col("trend") * r)).alias(f"tr{k}"), F.sum(F.when(also, F.col("trend") * F.col("trend"))).alias(f"tt{k}")]
    fit = with_r(train).where("r0 is not null").groupBy("fold").agg(*sums)  # one pass; a row a fold
    span = range(len(BINS))
    unit = lambda v: F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))
    for k in span:
        fit = fit.withColumn(f"w{k}", F.when((F.col(f"n{k}") >= least) & (F.col(f"rr{k}") > 0), unit(F.col(f"re{k}") / F.col(f"rr{k}"))))
    gain = [F.when((F.col(f"m{k}") >= least) & F.col(f"w{k}").isNotNull() & (F.col(f"tt{k}") > 0), F.greatest(F.lit(0.0), F.least(F.lit(MOST_GAIN), (F.col(f"te{k}") - F.col(f"w{k}") * F.col(f"tr{k}")) / F.col(f"tt{k}")))).otherwise(0.0) for k in span]
    weights = curve_weights([F.col(f"w{k}") for k in span], [F.col(f"n{k}") for k in span])
    fit = fit.select("fold", F.array(*weights).alias("w"), F.array(*gain).alias("g")).where("w[0] is not null")
    middles, end = F.array(*map(F.lit, CENTRES)), F.array(F.lit(float(END)))
    curve = fit.select("fold", "w", "g", F.concat(F.array(F.lit(0.0)), middles, end).alias("xs"), F.concat(F.array(at_lead_zero(F.col("w")[0], F.col("w")[1])), F.col("w"), F.array(F.lit(0.0))).alias("ys"))
    curve = curve.select("fold", "xs", "ys", F.concat(F.array(F.col("g")[0]), F.col("g"), F.array(F.lit(0.0))).alias("gs"))
    rows = with_r(test).join(F.broadcast(curve), "fold", "left")  # a row a fold
    lead = F.col("lead").cast("double")
    share = lambda ys: F.coalesce(F.when(F.col("lead") < END, interpolated(lead, F.col("xs"), F.col(ys))), F.lit(0.0))
    return rows.select(*CELL, "y", (F.col("p") + share("ys") * F.coalesce("r0", F.lit(0.0)) + share("gs") * F.coalesce("trend", F.lit(0.0))).alias("p"))


def recent_trend(observed: DataFrame, back: int = 1, most: int = 3) -> DataFrame:
    """issue and trend: the change an hour since the newest observation at least ``back`` and at most ``most`` hours before."""
    old = observed.select(F.col("issue").alias("at"), F.col("obs").alias("old"))
    now = observed.withColumn("then", F.col("issue") - back)
    met = asof_join(now, old.withColumn("seen", F.col("at")), "then", "at", [], most - back, ["old", "seen"], width=24 * 7)
    return met.where("old is not null").select("issue", ((F.col("obs") - F.col("old")) / (F.col("issue") - F.col("seen"))).alias("trend"))


def residual_slope(train: DataFrame, test: DataFrame, observed: DataFrame, low: float = -0.5, high: float = 1.5) -> DataFrame:
    """The base plus a bucket's slope times the first residual: sum(e r0) / sum(r0 r0), shrunk and clipped."""
    with_r = lambda rows: rows.join(first_residual(rows, observed), ["fold", "issue"], "left")
    fit = with_r(grounded_equal_weight(train, train)).where("r0 <> 0")
    slope = F.try_divide(F.sum((F.col("y") - F.col("p")) * F.col("r0")), F.sum(F.col("r0") * F.col("r0")))
    rows = shrunk(with_r(grounded_equal_weight(train, test)), two_levels(fit, ["fold"], slope=F.greatest(F.lit(low), F.least(F.lit(high), slope))), ["fold"], ["slope"], 0.0)
    return rows.withColumn("p", F.col("p") + F.col("slope") * F.coalesce("r0", F.lit(0.0))).select(*CELL, "y", "p")


@method("damped_grounded_equal_weight")
def damped(train, test):
    """Between the base and the hourly climatology: the share of least error in training, by bucket, shrunk to 1."""
    clim = train.groupBy("fold", F.pmod("valid", F.lit(24)).alias("hod")).agg(F.avg("y").alias("c"))
    joined = lambda rows: grounded_equal_weight(train, rows).withColumn("hod", F.pmod("valid", F.lit(24))).join(clim, ["fold", "hod"])
    mae = lambda k: F.round(F.avg(F.abs(F.col("c") + k / 20 * (F.col("p") - F.col("c")) - F.col("y"))), 9)
    tried = joined(train).groupBy("fold", "bucket").agg(F.count("*").alias("n"), *[mae(k).alias(f"m{k}") for k in range(21)])
    best = tried.select("fold", "bucket", "n", (-F.array_min(F.array(*[F.struct(F.col(f"m{k}").alias("m"), F.lit(-k).alias("k")) for k in range(21)]))["k"]).alias("k"))
    share = (F.col("n") * F.col("k") / 20 + PRIOR) / (F.col("n") + PRIOR)
    rows = joined(test).join(best, ["fold", "bucket"], "left").withColumn("a", F.coalesce(share, F.lit(1.0)))
    return rows.withColumn("p", F.col("c") + F.col("a") * (F.col("p") - F.col("c"))).select(*CELL, "y", "p")


def without(rows: DataFrame, excluded: list[tuple], value: str, source: str = "source", variable: str = "variable") -> DataFrame:
    """Nulls the values of excluded pairs of source and variable; the rows stay."""
    out = F.lit(False)
    for s, v in excluded:
        out = out | ((F.col(source) == s) & (F.col(variable) == v))
    return rows.withColumn(value, F.when(~out, F.col(value)))


def normal_equations(rows: DataFrame, sets: list[list[str]], keys: list[str], terms: list[Column], target: Column, more: list[Column] | None = None) -> list:
    """Sums of products of all terms and of terms with the target for each grouping, as rows on the driver: a small system each, of which there are as many as folds, sources and buckets. ``whole`` marks the rows that aren't by bucket."""
    n = len(terms)
    products = [F.sum(terms[i] * terms[j]).alias(f"a{i}_{j}") for i in range(n) for j in range(i, n)]
    return rows.groupingSets(sets, *keys).agg((F.grouping("bucket") == 1 if "bucket" in keys else F.lit(True)).alias("whole"), F.count("*").alias("n"), *products, *[F.sum(terms[i] * target).alias(f"b{i}") for i in range(n)], *(more or [])).collect()


def system(row, n: int):
    """The matrix and the right side out of such a row."""
    import numpy as np

    return np.array([[row[f"a{min(i, j)}_{max(i, j)}"] for j in range(n)] for i in range(n)]), np.array([row[f"b{i}"] for i in range(n)])


def ridge_solution(row, n: int, ridge: float = 1.0) -> list[float]:
    """Ridge coefficients; the first term is a constant and isn't penalised."""
    import numpy as np

    a, b = system(row, n)
    return np.linalg.solve(a + np.diag([1e-12, *[ridge] * (n - 1)]), b).tolist()


def of_year(valid: Column, harmonic: int = 1) -> tuple[Column, Column]:
    """Sine and cosine of the day of the year of an hour since 1970."""
    angle = 2 * 3.141592653589793 * harmonic * F.dayofyear(F.timestamp_seconds(valid * 3600)) / 365.25
    return F.sin(angle), F.cos(angle)


def climatology(train: DataFrame, test: DataFrame, zone: str = "America/Los_Angeles") -> DataFrame:
    """Ridge on a harmonic of the month and two of the hour, both of the station's clock. The normal equations of all folds are one aggregate; only they reach the driver."""
    local = F.from_utc_timestamp(F.timestamp_seconds(F.col("valid") * 3600), zone)
    month = 2 * 3.141592653589793 * F.month(local) / 12
    terms = [F.lit(1.0), F.sin(month), F.cos(month), *[f(2 * 3.141592653589793 * k * F.hour(local) / 24) for k in (1, 2) for f in (F.sin, F.cos)]]
    cells = train.select("fold", "valid", "y").distinct()
    rows = [(r["fold"], ridge_solution(r, len(terms))) for r in normal_equations(cells, [["fold"]], ["fold"], terms, F.col("y"))]
    coefficients = train.sparkSession.createDataFrame(rows, "fold int, c array<double>")
    point = sum((F.element_at("c", i + 1) * t for i, t in enumerate(terms)), F.lit(0.0))
    return test.groupBy(*CELL).agg(F.first("y").alias("y")).join(F.broadcast(coefficients), "fold").withColumn("p", point).select(*CELL, "y", "p")  # a row a fold


def harmonic_grounded(train: DataFrame, test: DataFrame, elevation: Column, least: int = 48) -> DataFrame:
    """Each source with its residual added, a ridge on the sun's elevation (its sine and the square of that) and two harmonics of the year: a bucket's own curve from ``least`` rows on, else the source's, else none."""
    sine = F.sin(F.radians(elevation))
    terms = [F.lit(1.0), sine, sine * sine, *of_year(F.col("valid")), *of_year(F.col("valid"), 2)]
    n = len(terms)
    systems = normal_equations(train, [[*KEY, "bucket"], KEY], [*KEY, "bucket"], terms, F.col("y") - F.col("x"))
    rows = [(r["fold"], r["source"], None if r["whole"] else r["bucket"], ridge_solution(r, n)) for r in systems if r["n"] >= least]
    fit = train.sparkSession.createDataFrame(rows, "fold int, source string, bucket string, c array<double>")
    local, whole = fit.where("bucket is not null"), fit.where("bucket is null").select(*KEY, F.col("c").alias("g"))
    out = test.join(F.broadcast(whole), KEY, "left").join(F.broadcast(local), [*KEY, "bucket"], "left").withColumn("c", F.coalesce("c", "g"))  # a row a fold, source and bucket
    shift = sum((F.element_at("c", i + 1) * t for i, t in enumerate(terms)), F.lit(0.0))
    return mean_of(out.withColumn("x", F.col("x") + F.coalesce(shift, F.lit(0.0))))


def clustered(train: DataFrame, test: DataFrame, limit: float = 0.9, least: int = 24) -> DataFrame:
    """Equal weight over sources whose errors aren't nearly those of a better one; the correlations are one aggregate, the choice among few sources is made on the driver."""
    e = train.select("fold", "issue", "valid", "source", (F.col("x") - F.col("y")).alias("e"))
    a, b = e.alias("a"), e.alias("b")
    same = (F.col("a.fold") == F.col("b.fold")) & (F.col("a.issue") == F.col("b.issue")) & (F.col("a.valid") == F.col("b.valid")) & (F.col("a.source") < F.col("b.source"))
    r = F.try_divide(F.covar_pop("a.e", "b.e"), F.sqrt(F.var_pop("a.e") * F.var_pop("b.e")))
    pairs = {(p["fold"], *sorted((p["s"], p["t"]))) for p in a.join(b, same).groupBy(F.col("a.fold").alias("fold"), F.col("a.source").alias("s"), F.col("b.source").alias("t")).agg(r.alias("r"), F.count("*").alias("n")).collect() if p["n"] >= least and p["r"] is not None and abs(p["r"]) >= limit}
    kept: list[tuple] = []
    for row in e.groupBy("fold", "source").agg(F.round(F.avg(F.abs("e")), 9).alias("mae")).orderBy("fold", "mae", "source").collect():
        if not any(f == row["fold"] and (f, *sorted((s, row["source"]))) in pairs for f, s in kept):
            kept.append((row["fold"], row["source"]))
    chosen = train.sparkSession.createDataFrame(kept, "fold int, source string")
    return mean_of(test.join(F.broadcast(chosen), KEY))  # a row a fold and source
