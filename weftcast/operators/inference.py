"""Inference on losses and series. What is a sum is an aggregate or a window; resampling and ordered folds run in pandas, one group of collapsed cases a task, so that a group has as many rows as a slice has valid times."""

from __future__ import annotations

import json
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import interpolated
from ..functions.special import chi2_sf, normal_cdf, student_sf


def collapsed(scores: DataFrame, by: list[str], time: str = "valid") -> DataFrame:
    """The mean loss of each method at each valid time."""
    return scores.groupBy(*by, "method", time).agg(F.avg(F.abs(F.col("p") - F.col("y"))).alias("loss"))


def loss_differences(losses: DataFrame, by: list[str], one: str, two: str, time: str = "valid") -> DataFrame:
    pick = lambda m: F.max(F.when(F.col("method") == m, F.col("loss")))
    return losses.groupBy(*by, time).agg((pick(one) - pick(two)).alias("d")).where("d is not null")


def diebold_mariano(d: np.ndarray, lags: int) -> tuple[float, float]:
    """The small-sample statistic and its two-sided p-value, with a Bartlett long-run variance of ``lags``; zero variance decides by the mean alone."""
    n = len(d)
    if n < 8:
        return math.nan, math.nan
    mean, c = d.mean(), d - d.mean()
    variance = c @ c / n + 2 * sum((1 - k / (lags + 1)) * (c[k:] @ c[:-k]) / n for k in range(1, min(lags, n - 1) + 1))
    if variance <= 0:
        return (0.0, 1.0) if mean == 0 else (math.copysign(math.inf, mean), 0.0)
    h = lags + 1
    stat = mean / math.sqrt(variance / n) * math.sqrt(max((n + 1 - 2 * h + h * (h - 1) / n) / n, 1e-12))
    return stat, 2 * student_sf(abs(stat), n - 1)


def dm_table(differences: DataFrame, by: list[str], lags: int, time: str = "valid") -> DataFrame:
    schema = ", ".join(f"{c} {t}" for c, t in differences.select(*by).dtypes) + ", n long, mean_diff double, stat double, p_value double"

    def test(key, pdf):
        d = pdf.sort_values(time)["d"].to_numpy()
        stat, p = diebold_mariano(d, lags)
        return pd.DataFrame([[*key, len(d), d.mean(), stat, p]]).where(lambda x: x.notna(), None)

    return differences.groupBy(*by).applyInPandas(test, schema)


def dm_moments(differences: DataFrame, by: list[str], lags: int, time: str = "valid") -> DataFrame:
    """The same statistic as windows and one aggregate: products with lagged rows."""
    w = Window.partitionBy(*by).orderBy(time)
    whole = Window.partitionBy(*by)
    c = differences.withColumn("__c", F.col("d") - F.avg("d").over(whole))
    for k in range(1, lags + 1):
        c = c.withColumn(f"__c{k}", F.col("__c") * F.lag("__c", k).over(w))
    n = F.count("*")
    variance = F.sum(F.col("__c") * F.col("__c")) / n + sum((2 * (1 - k / (lags + 1)) * F.coalesce(F.sum(f"__c{k}"), F.lit(0.0)) / n for k in range(1, lags + 1)), F.lit(0.0))
    h = lags + 1
    small = F.sqrt(F.greatest((n + 1 - 2 * h + h * (h - 1) / n) / n, F.lit(1e-12)))
    return c.groupBy(*by).agg(n.alias("n"), F.avg("d").alias("mean_diff"), F.when((n >= 8) & (variance > 0), F.avg("d") / F.sqrt(F.when(variance > 0, variance) / n) * small).alias("stat"))


def block_index(n: int, draws: int = 500, seed: int = 20260718) -> np.ndarray:
    """Rows of resampled series of length n, in circular blocks of the cube root of n."""
    block = max(1, round(n ** (1 / 3)))
    starts = np.random.default_rng(seed).integers(0, n, (draws, -(-n // block)))
    return ((starts[:, :, None] + np.arange(block)) % n).reshape(draws, -1)[:, :n]


def chosen_bias(losses: np.ndarray) -> float:
    """By how much the least mean of resampled losses lies under the least mean (columns are methods)."""
    return float(losses[block_index(len(losses))].mean(axis=1).min(axis=1).mean() - losses.mean(axis=0).min())


def mean_error(series: np.ndarray) -> float:
    """Standard error of the mean of a series with serial correlation."""
    return float(series[block_index(len(series))].mean(axis=1).std())


def confidence_set(losses: np.ndarray, alpha: float = 0.1, draws: int = 500, seed: int = 20260718) -> np.ndarray:
    """p-values of the model confidence set (columns are methods): the worst by the largest t is dropped while its bootstrap p is under alpha; circular blocks of the cube root of n."""
    n, k = losses.shape
    index = block_index(n, draws, seed)
    out, left, reached = np.ones(k), list(range(k)), 0.0
    while len(left) > 1:
        d = losses[:, left] - losses[:, left].mean(axis=1, keepdims=True)
        mean = d.mean(axis=0)
        boot = d[index].mean(axis=1) - mean
        scale = np.sqrt(np.maximum((boot**2).mean(axis=0), 1e-18))
        t = mean / scale
        p = float(((boot / scale).max(axis=1) >= t.max()).mean())
        reached = max(reached, p)
        worst = left[int(t.argmax())]
        out[worst] = reached
        if reached >= alpha:
            for m in left:
                out[m] = max(reached, out[m] if m == worst else 1.0) if m != worst else reached
            break
        left.remove(worst)
    return out


def median_unbiased(losses: np.ndarray, alpha: float = 0.1, draws: int = 100_000, seed: int = 20260718) -> tuple[float, float] | None:
    """The winner's mean loss (the least of the columns) corrected for having won: the median-unbiased value under a normal law cut off where another would have won, and an upper bound of level 1 - alpha; both within the joint band of level 1 - alpha / 10 around what was seen. None where the winner's mean has no spread."""
    means = losses[block_index(len(losses))].mean(axis=1)
    seen = -losses.mean(axis=0)
    cov, best = np.atleast_2d(np.cov(means, rowvar=False)), int(np.argmax(seen))
    sd = math.sqrt(max(cov[best, best], 0.0))
    if sd < 1e-12:
        return None
    low, high = -math.inf, math.inf
    for j in range(seen.size):
        slack = 1 - cov[best, j] / cov[best, best]
        if j == best or abs(slack) < 1e-12:
            continue
        at = (seen[j] - cov[best, j] / cov[best, best] * seen[best]) / slack
        low, high = (max(low, at), high) if slack > 0 else (low, min(high, at))
    beta = alpha / 10
    scale = np.sqrt(np.maximum(np.diag(cov), 1e-24))
    normals = np.random.default_rng(seed).multivariate_normal(np.zeros(seen.size), cov, draws, method="svd")
    reach = float(np.quantile(np.abs(normals / scale).max(axis=1), 1 - beta)) * sd

    def centre(level: float) -> float:
        """The mean at which what was seen stands at ``level`` of the cut law; that falls as the mean rises."""
        a, b = seen[best] - reach, seen[best] + reach
        for _ in range(80):
            m = (a + b) / 2
            lo, hi = max(low, m - reach), min(high, m + reach)
            pa, pb, px = (normal_cdf((v - m) / sd) if math.isfinite(v) else float(v > 0) for v in (lo, hi, seen[best]))
            under = (px - pa) / (pb - pa) if pb - pa > 1e-12 else (0.0 if m > seen[best] else 1.0)
            a, b = (m, b) if under > level else (a, m)
        return (a + b) / 2

    return -centre(0.5), -centre(1 - (alpha - beta) / (1 - beta))


def gate(losses: np.ndarray, methods: list[str], candidate: str, references: list[str], rule: str, alpha: float, lags: int = 1) -> tuple[bool, str | None]:
    """Whether a candidate passes every reference, and what held it if not. losses: a row a valid time, a column a method. Rules: 'mcs', it is in the model confidence set and no reference is; 'sequential', the bettor on its advantage over each has made 1 / alpha; 'legacy', it is better than each by a significant Diebold-Mariano test."""
    if len(losses) < 8:
        return False, "thin"
    at = {m: k for k, m in enumerate(methods)}
    edge = [losses[:, at[r]] - losses[:, at[candidate]] for r in references]
    if rule == "mcs":
        p = confidence_set(losses, alpha)
        return (True, None) if p[at[candidate]] >= alpha and all(p[at[r]] < alpha for r in references) else (False, "mcs_not_separated")
    if rule == "sequential":
        return (True, None) if min(e_value_path(d)[-1] for d in edge) >= 1 / alpha else (False, "e_below_threshold")
    strong = all(d.mean() > 0 and diebold_mariano(d, lags)[1] < 0.05 for d in edge)
    return (True, None) if strong else (False, "dm_not_significant")


def gated(losses: DataFrame, eligible: DataFrame, by: list[str], references: list[str], rule: str = "mcs", alpha: float = 0.1, time: str = "valid") -> DataFrame:
    """What each slice serves. eligible: the slices' methods that may be promoted, with mae. The one of least error is the candidate; a reference that leads stays; without all references, or where the gate holds, the best reference (equal weight among equals) is served, and no reference at all serves nothing. Cases all methods of the decision have count, a mean loss a valid time, so a slice is as many rows as it has times."""
    kinds = dict(eligible.dtypes)
    schema = ", ".join(f"{k} {kinds[k]}" for k in by) + ", candidate string, candidate_mae double, winner string, winner_mae double, gate string"

    def run(key, rows, board):
        ranked = sorted((m, v) for v, m in zip(board["method"], board["mae"]))
        if not ranked:
            return pd.DataFrame(columns=range(len(key) + 5))
        mae, candidate = ranked[0]
        present = sorted((m, n != "equal_weight", n) for m, n in ranked if n in references)
        if not present:
            return pd.DataFrame(columns=range(len(key) + 5))
        best = (present[0][2], present[0][0])
        if candidate in references:
            winner, held = (candidate, mae), None
        elif len(present) < len(references):
            winner, held = best, "missing_reference"
        else:
            names = [candidate, *[n for _, _, n in present]]
            wide = rows[rows["method"].isin(names)].pivot_table(index=time, columns="method", values="loss").reindex(columns=names).dropna().sort_index()
            passed, held = gate(wide.to_numpy(), names, candidate, names[1:], rule, alpha)
            winner = (candidate, mae) if passed else best
        return pd.DataFrame([[*key, candidate, mae, *winner, held]])

    return _renewed(losses).groupBy(*by).cogroup(_renewed(eligible).groupBy(*by)).applyInPandas(run, schema)


def confidence_sets(losses: DataFrame, by: list[str], time: str = "valid", **how) -> DataFrame:
    schema = ", ".join(f"{c} {t}" for c, t in losses.select(*by).dtypes) + ", method string, n long, mean_loss double, mcs_p double"

    def test(key, pdf):
        wide = pdf.pivot_table(index=time, columns="method", values="loss").dropna().sort_index()
        if len(wide) < 8:
            return pd.DataFrame(columns=range(len(key) + 4))
        p = confidence_set(wide.to_numpy(), **how)
        return pd.DataFrame([[*key, m, len(wide), wide[m].mean(), float(v)] for m, v in zip(wide.columns, p)])

    return losses.groupBy(*by).applyInPandas(test, schema)


def benjamini_hochberg(p: str, by: list[str]) -> tuple[Column, Column]:
    """Two columns to add one after the other: p * k / rank, and its least value from the rank on."""
    w = Window.partitionBy(*by)
    rank = F.row_number().over(w.orderBy(F.asc_nulls_last(p)))
    raw = F.when(F.col(p).isNotNull(), F.col(p) * F.count(p).over(w) / rank)
    return raw, F.least(F.lit(1.0), F.min("__raw").over(w.orderBy(F.desc(p)).rowsBetween(Window.unboundedPreceding, 0)))


def with_bh(df: DataFrame, p: str, by: list[str], name: str = "p_adjusted") -> DataFrame:
    raw, adjusted = benjamini_hochberg(p, by)
    return df.withColumn("__raw", raw).withColumn(name, F.when(F.col(p).isNotNull(), adjusted)).drop("__raw")


def _renewed(df: DataFrame) -> DataFrame:
    """The same columns under identities of their own, so that two tables made of one can meet."""
    return df.toDF(*df.columns)


class Wealth:
    """What a bettor on positive values has made of 1: bets by an online Newton step in [0, 0.5], values clipped by the scale of those before (the first counts as its sign). Its logarithm is kept, and how far it has seen."""

    RATE = 2 / (2 - math.log(3))

    def __init__(self, state: dict | None = None):
        state = state or {"log": 0.0, "bet": 0.1, "curve": 1.0, "scale": 0.0, "cursor": None}
        self.log, self.bet, self.curve, self.scale, self.cursor = (state[k] for k in ("log", "bet", "curve", "scale", "cursor"))

    def see(self, x: float, at: int | None = None) -> None:
        if at is not None:
            if self.cursor is not None and at <= self.cursor:
                return
            self.cursor = at
        z = max(-1.0, min(1.0, x / self.scale)) if self.scale else float(np.sign(x))
        won = 1 + self.bet * z
        self.log += math.log(won)
        slope = -z / won
        self.curve += slope * slope
        self.bet = min(0.5, max(0.0, self.bet - self.RATE * slope / self.curve))
        self.scale = max(self.scale, abs(x))

    def state(self) -> dict:
        return {"log": self.log, "bet": self.bet, "curve": self.curve, "scale": self.scale, "cursor": self.cursor}


def e_value_path(z: np.ndarray) -> np.ndarray:
    """The bettor's wealth after each value."""
    bettor, out = Wealth(), np.empty(len(z))
    for k, x in enumerate(z.tolist()):
        bettor.see(x)
        out[k] = math.exp(bettor.log)
    return out


WEALTH = "identity string, log_e double, state string"


def advanced_wealth(differences: DataFrame, states: DataFrame, by: list[str], identity: str, time: str = "valid") -> DataFrame:
    """E-processes by key (states: the keys and WEALTH) carried on over differences (d) past their cursor; a state of another ``identity`` (of configuration and code) is begun anew. The same rows twice change nothing."""
    kinds = dict(differences.dtypes)
    schema = ", ".join(f"{k} {kinds[k]}" for k in by) + ", " + WEALTH

    def run(key, rows, old):
        held = json.loads(old["state"].iloc[0]) if len(old) and old["identity"].iloc[0] == identity else None
        bettor = Wealth(held)
        for at, d in rows.sort_values(time)[[time, "d"]].itertuples(index=False):
            bettor.see(float(d), int(at))
        return pd.DataFrame([[*key, identity, bettor.log, json.dumps(bettor.state())]], columns=[c.split()[0] for c in schema.split(", ")])

    return _renewed(differences).groupBy(*by).cogroup(_renewed(states).groupBy(*by)).applyInPandas(run, schema)


def robust_scale(e: np.ndarray) -> tuple[float, float, bool]:
    """Centre and scale of residuals: the median, and its deviations' median as a sigma, but a tenth of the interquartile range and 0.001 at least; and whether they are too nearly constant to be judged."""
    centre = float(np.median(e))
    off = np.abs(e - centre)
    sigma = 1.4826 * float(np.median(off))
    low, high = np.quantile(e, (0.25, 0.75))
    return centre, max(sigma, 0.1 * float(high - low), 1e-3), sigma < 1e-3 or float((off <= 1e-3).mean()) > 0.9


def page_hinkley(e: np.ndarray, delta: float = 0.1, clip: float = 8.0) -> tuple[int, float]:
    """The first index at which the two-sided test alarms (or -1), and its largest statistic: standardised values less their mean so far and a dead band, summed up, less the least sum so far."""
    n = len(e)
    if n < 48:
        return -1, 0.0
    centre, scale, constant = robust_scale(e)
    if constant:
        return -1, 0.0
    z, limit, top, first = np.clip((e - centre) / scale, -clip, clip), max(25.0, 4 * math.sqrt(n)), 0.0, -1
    for x in (z, -z):
        steps = x - np.cumsum(x) / np.arange(1, n + 1) - delta
        steps[0] = 0
        sums = np.cumsum(steps)
        excursion = sums - np.minimum(np.minimum.accumulate(sums), 0)
        top = max(top, float(excursion.max()))
        over = np.flatnonzero(excursion > limit)
        if over.size and (first < 0 or over[0] < first):
            first = int(over[0])
    return first, top


def standardised(df: DataFrame, by: list[str], value: str, name: str = "z", clip: float = 8.0) -> DataFrame:
    """Adds ``n`` and ``name``, robustly standardised values of each group by the rule of ``robust_scale``; groups that are too nearly constant go."""
    q = df.groupBy(*by).agg(F.count("*").alias("n"), F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("__q"))
    off = F.abs(F.col(value) - F.col("__q")[1])
    spread = df.join(q, by).groupBy(*by).agg((1.4826 * F.median(off)).alias("__sigma"), F.avg(F.when(off <= 1e-3, 1.0).otherwise(0.0)).alias("__near"))
    scale = F.greatest(F.col("__sigma"), 0.1 * (F.col("__q")[2] - F.col("__q")[0]), F.lit(1e-3))
    kept = df.join(q, by).join(spread.where("__sigma >= 1e-3 and __near <= 0.9"), by)
    z = F.greatest(F.lit(-clip), F.least(F.lit(clip), (F.col(value) - F.col("__q")[1]) / scale))
    return kept.withColumn("__scale", scale).withColumn("__centre", F.col("__q")[1]).withColumn(name, z).drop("__q", "__sigma", "__near")


def page_hinkley_table(df: DataFrame, by: list[str], time: str, value: str, delta: float = 0.1, least: int = 48) -> DataFrame:
    """The same test as windows: n, its largest statistic and whether that alarms, for each group of ``least`` rows."""
    w = Window.partitionBy(*by).orderBy(time)
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = standardised(df, by, value).where(F.col("n") >= least).withColumn("__k", F.row_number().over(w)).withColumn("__mean", F.avg("z").over(so_far))
    for side, sign in (("up", 1), ("down", -1)):
        rows = rows.withColumn("__s", F.when(F.col("__k") > 1, sign * (F.col("z") - F.col("__mean")) - delta).otherwise(0.0)).withColumn("__sum", F.sum("__s").over(so_far))
        rows = rows.withColumn(side, F.col("__sum") - F.least(F.lit(0.0), F.min("__sum").over(so_far)))
    top = F.greatest(F.max("up"), F.max("down"))
    return rows.groupBy(*by).agg(F.first("n").alias("n"), top.alias("highest")).withColumn("alarm", F.col("highest") > F.greatest(F.lit(25.0), 4 * F.sqrt("n")))


#: 95 % critical values of the homogeneity statistic by the number of days.
SNHT_CRITICAL = ((7, 5.5), (10, 6.29), (14, 6.93), (21, 7.51), (30, 8.05), (45, 8.46), (60, 8.72))


def snht_critical(n: Column) -> Column:
    """Interpolated between the listed numbers, held beyond them."""
    knots, values = zip(*SNHT_CRITICAL)
    return interpolated(n.cast("double"), F.array(*[F.lit(float(k)) for k in knots]), F.array(*[F.lit(v) for v in values]))


def craddock(df: DataFrame, by: list[str], time: str, value: str, name: str = "cusum") -> DataFrame:
    """The running sum of what a series differs from its mean; a null counts as the mean."""
    off = F.coalesce(F.col(value) - F.avg(value).over(Window.partitionBy(*by)), F.lit(0.0))
    return df.withColumn("__off", off).withColumn(name, F.sum("__off").over(Window.partitionBy(*by).orderBy(time).rowsBetween(Window.unboundedPreceding, 0))).drop("__off")


def broken(df: DataFrame, by: list[str], time: str, value: str, least: int = 7) -> DataFrame:
    """For each series of ``least`` rows whether its homogeneity breaks, and the first time after the break."""
    found = snht(df.where(F.col(value).isNotNull()), by, time, value).where(F.col("n") >= least)
    after = df.where(F.col(value).isNotNull()).withColumn("__next", F.lead(time).over(Window.partitionBy(*by).orderBy(time))).select(*by, F.col(time).alias("at"), F.coalesce("__next", time).alias("day"))
    breaks = F.coalesce(F.col("t") > snht_critical(F.col("n")), F.lit(False))
    return found.join(after, [*by, "at"]).select(*by, "n", "t", breaks.alias("breaks"), F.when(breaks, F.col("day")).alias("day"))


def latched(states: DataFrame, verdicts: DataFrame, by: list[str], least: int = 3) -> DataFrame:
    """States (keys, day, streak, since) a verdict (keys, day, drifts) later: a drift on the next day adds one, on the same day nothing, after a gap it begins anew, and none ends it. ``latched`` from ``least`` days on."""
    old = states.select(*by, F.col("day").alias("__day"), F.col("streak").alias("__streak"), F.col("since").alias("__since"))
    rows = verdicts.join(old, by, "full")
    again, follows = F.col("day") <= F.col("__day"), F.col("day") == F.col("__day") + 1
    goes_on = follows & (F.col("__streak") > 0)
    streak = F.when(F.col("day").isNull() | again, F.col("__streak")).when(~F.col("drifts"), 0).when(goes_on, F.col("__streak") + 1).otherwise(1)
    since = F.when(F.col("day").isNull() | again, F.col("__since")).when(~F.col("drifts"), None).when(goes_on, F.col("__since")).otherwise(F.col("day"))
    out = rows.select(*by, F.greatest("day", "__day").alias("day"), streak.cast("long").alias("streak"), since.alias("since"))
    return out.withColumn("latched", F.col("streak") >= least)


def e_benjamini_hochberg(df: DataFrame, e: str, by: list[str], alpha: float, name: str = "discovery") -> DataFrame:
    """Discoveries among e-values: the k largest, k the greatest rank at which k e / K reaches 1 / alpha; null values are no hypotheses. ``threshold`` is what a value had to reach."""
    w = Window.partitionBy(*by)
    ranked = df.withColumn("__k", F.row_number().over(w.orderBy(F.desc_nulls_last(e)))).withColumn("__n", F.count(e).over(w))
    passes = F.col("__k") * F.col(e) / F.col("__n") >= 1 / alpha
    best = ranked.withColumn("__best", F.coalesce(F.max(F.when(passes, F.col("__k"))).over(w), F.lit(0)))
    bar = F.max(F.when(F.col("__k") == F.col("__best"), F.col(e))).over(w)
    return best.withColumn(name, F.coalesce(F.col(e) >= bar, F.lit(False))).withColumn("threshold", F.col("__n") / (alpha * F.greatest(F.col("__best"), F.lit(1)))).drop("__k", "__n", "__best")


def snht(df: DataFrame, by: list[str], time: str, value: str) -> DataFrame:
    """The homogeneity statistic: over all splits, the largest k z1^2 + (n - k) z2^2 of standardised means on either side; prefix sums, no resampling."""
    w, whole = Window.partitionBy(*by).orderBy(time), Window.partitionBy(*by)
    z = df.withColumn("__z", F.try_divide(F.col(value) - F.avg(value).over(whole), F.stddev_pop(value).over(whole)))
    parts = z.withColumn("__k", F.row_number().over(w)).withColumn("__s", F.sum("__z").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("__n", F.count("*").over(whole)).withColumn("__all", F.sum("__z").over(whole))
    rest = F.col("__all") - F.col("__s")
    t = F.col("__s") * F.col("__s") / F.col("__k") + F.try_divide(rest * rest, F.col("__n") - F.col("__k"))
    split = parts.withColumn("__t", t).where("__k < __n")
    return split.groupBy(*by).agg(F.max("__t").alias("t"), F.max_by(time, F.struct(F.round("__t", 9), -F.col("__k"))).alias("at"), F.first("__n").alias("n"))


def pettitt(df: DataFrame, by: list[str], time: str, value: str) -> DataFrame:
    """The rank test for a change: the largest |2 sum of ranks - k (n + 1)|, and its asymptotic p-value."""
    whole = Window.partitionBy(*by)
    ranks = df.withColumn("__r", F.rank().over(whole.orderBy(value)) + (F.count("*").over(Window.partitionBy(*by, value)) - 1) / 2)
    w = Window.partitionBy(*by).orderBy(time)
    u = ranks.withColumn("__k", F.row_number().over(w)).withColumn("__n", F.count("*").over(whole)).withColumn("__u", F.abs(2 * F.sum("__r").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("__k") * (F.col("__n") + 1)))
    best = u.groupBy(*by).agg(F.max("__u").alias("u"), F.max_by(time, F.struct("__u", -F.col("__k"))).alias("at"), F.first("__n").alias("n"))
    return best.withColumn("p_value", F.least(F.lit(1.0), 2 * F.exp(-6 * F.col("u") * F.col("u") / (F.col("n") * F.col("n") * (F.col("n") + 1)))))


def pit_uniformity(counts: list[int]) -> float:
    """p-value of equal counts."""
    total = sum(counts)
    expected = total / len(counts)
    return chi2_sf(sum((c - expected) ** 2 / expected for c in counts), len(counts) - 1) if total else math.nan
