"""Methods with state in issue order or with an optimiser. Each runs as a grouped pandas function keyed by fold and bucket: a group has the cells of one bucket in one fold, which folds and buckets keep bounded; groups run side by side."""

from __future__ import annotations

import hashlib
import json
import math
from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import masked_mean
from ..functions.special import isotonic
from ..sources.scratch import settled
from . import laws, neighbours
from .methods import grounded, normal_equations, system

CELL = ["fold", "issue", "valid", "lead", "bucket"]
OUT = "fold int, issue long, valid long, lead long, bucket string, y double, p double"
LEVELS = (0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95)


def _wide(train: DataFrame, test: DataFrame) -> DataFrame:
    """One row a cell: the sources' values as a map, tagged by part."""
    tag = lambda df, t: df.groupBy(*CELL).agg(F.first("y").alias("y"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("source", "x")))).alias("xs")).withColumn("part", F.lit(t))
    return tag(train, "train").unionByName(tag(test, "test"))


def per_bucket(train: DataFrame, test: DataFrame, fit, out: str = OUT) -> DataFrame:
    """fit(train_x, train_y, test_x, train_frame, test_frame) gives predictions of the test cells; x has a column a source, NaN where it is missing."""
    names = [c.split()[0] for c in out.split(", ")]

    def run(pdf):
        pdf = pdf.sort_values(["issue", "lead"], kind="stable")
        sources = sorted({s for m in pdf["xs"] for s in dict(m)})
        x = np.array([[dict(m).get(s, math.nan) for s in sources] for m in pdf["xs"]], float).reshape(len(pdf), len(sources))
        old, new = (pdf["part"] == p for p in ("train", "test"))
        if not new.any():
            return pd.DataFrame(columns=names)
        got = fit(x[old], pdf["y"][old].to_numpy(float), x[new], pdf[old], pdf[new])
        frame = pdf.loc[new, [*CELL, "y"]].assign(**(got if isinstance(got, dict) else {"p": got}))
        return frame[names]

    return _wide(train, test).groupBy("fold", "bucket").applyInPandas(run, out)


def _mean(x: np.ndarray) -> np.ndarray:
    some = ~np.isnan(x)
    return np.where(some.any(axis=1), np.nansum(x, axis=1) / np.maximum(some.sum(axis=1), 1), math.nan)


class Experts:
    """Weights of sleeping experts over a stream of forecasts. Losses of a round are relative to the largest among those awake; those asleep keep their share. Exponential weights need to know how many rounds there will be; second-order weights have a rate for each expert, from what its regret has varied."""

    def __init__(self, n: int, horizon: int, second_order: bool, share: float = 0.005):
        self.w, self.v, self.rounds = np.full(n, 1 / max(n, 1)), np.zeros(n), 0
        self.horizon, self.second_order, self.share = max(horizon, 1), second_order, share

    def see(self, row: np.ndarray, truth: float) -> None:
        awake = np.flatnonzero(~np.isnan(row))
        k = awake.size
        if k < 2 or math.isnan(truth):
            return
        self.rounds += 1
        loss = np.abs(row[awake] - truth)
        loss = loss / max(loss.max(), 1e-9)
        own = self.w[awake] if self.w[awake].sum() > 0 else np.full(k, 1 / k)
        regret = own @ loss / own.sum() - loss
        if self.second_order:
            self.v[awake] += regret**2
            rate = np.minimum(0.5, np.sqrt(math.log(k) / np.maximum(self.v[awake], 1e-300)))
            power = rate * regret * (1 - rate * regret)
        else:
            power = min(0.5, math.sqrt(8 * math.log(k) / self.horizon)) * regret
        grown = own * np.exp(np.clip(power, -50, 50))
        self.w[awake] = (1 - self.share) * grown + self.share * grown.mean()
        self.w /= self.w.sum()

    def state(self) -> dict:
        return {"w": self.w.tolist(), "v": self.v.tolist(), "rounds": self.rounds}

    def resume(self, state: dict) -> None:
        self.w, self.v, self.rounds = np.array(state["w"]), np.array(state["v"]), int(state["rounds"])


def expert_weights(x: np.ndarray, y: np.ndarray, second_order: bool, share: float = 0.005) -> np.ndarray:
    """Weights after all of y."""
    group = Experts(x.shape[1], len(y), second_order, share)
    for row, truth in zip(x, y.tolist()):
        group.see(row, truth)
    return group.w


def weighted(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Weighted means over the columns that aren't NaN."""
    live = np.where(np.isnan(x), 0, w)
    return np.where(np.isnan(x), 0, x * live).sum(axis=1) / np.maximum(live.sum(axis=1), 1e-300)


def experts(train: DataFrame, test: DataFrame, second_order: bool = False) -> DataFrame:
    """Weights learned in the order in which truths became known, one set a bucket. The sources should come grounded."""

    def fit(x, y, new, old_frame, _):
        order = np.lexsort((old_frame["lead"], old_frame["issue"], old_frame["valid"]))
        return weighted(new, expert_weights(x[order], y[order], second_order) if len(y) else np.ones(new.shape[1]))

    return per_bucket(train, test, fit)


STATE = "bucket string, cursor long, digest string, sources string, state string"


def advanced_experts(history: DataFrame, states: DataFrame, second_order: bool = True) -> DataFrame:
    """Expert states (STATE) carried on over the rows of ``history`` (issue, valid, lead, bucket, y, xs: a map by source) that became known since their cursor. The digest of what a state has seen, and its sources, have to be those of the history up to the cursor; else, and for exponential weights, whose rate depends on the whole, all is replayed."""

    def run(key, rows, old):
        rows = rows.sort_values(["valid", "issue", "lead"], kind="stable")
        sources = sorted({s for m in rows["xs"] for s in dict(m)})
        names = json.dumps(sources)
        x = np.array([[dict(m).get(s, math.nan) for s in sources] for m in rows["xs"]], float).reshape(len(rows), len(sources))
        y, valid = rows["y"].to_numpy(float), rows["valid"].to_numpy()
        group, start = Experts(len(sources), len(rows), second_order), 0
        if len(old) and second_order and old["sources"].iloc[0] == names:
            seen = int(np.searchsorted(valid, old["cursor"].iloc[0], "right"))
            if old["digest"].iloc[0] == _digest(x[:seen], y[:seen], valid[:seen]):
                group.resume(json.loads(old["state"].iloc[0]))
                start = seen
        for row, truth in zip(x[start:], y[start:].tolist()):
            group.see(row, truth)
        return pd.DataFrame([[key[0], int(valid[-1]), _digest(x, y, valid), names, json.dumps(group.state())]], columns=[c.split()[0] for c in STATE.split(", ")]) if len(rows) else old

    return history.toDF(*history.columns).groupBy("bucket").cogroup(states.toDF(*states.columns).groupBy("bucket")).applyInPandas(run, STATE)


def _digest(*arrays: np.ndarray) -> str:
    out = hashlib.sha256()
    for a in arrays:
        out.update(np.ascontiguousarray(a).tobytes())
    return out.hexdigest()[:16]


def weight_history(states: DataFrame) -> DataFrame:
    """issue, bucket, source, weight (null for a source that a state doesn't know) of the bucket with most rounds, out of states (issue, bucket, sources and state as JSON)."""
    parsed = states.select("issue", "bucket", F.from_json("sources", "array<string>").alias("s"), F.from_json("state", "struct<w: array<double>, rounds: long>").alias("t"))
    most = parsed.groupBy("bucket").agg(F.max("t.rounds").alias("n")).agg(F.max_by("bucket", F.struct("n", "bucket")).alias("bucket"))
    own = parsed.join(F.broadcast(most), "bucket")  # one row
    every = own.select(F.explode("s").alias("source")).distinct()
    known = own.select("issue", "bucket", F.posexplode("s").alias("k", "source"), "t.w").select("issue", "bucket", "source", F.get("w", F.col("k")).alias("weight"))
    return own.select("issue", "bucket").distinct().crossJoin(F.broadcast(every)).join(known, ["issue", "bucket", "source"], "left")  # a row a source


def inverse_covariance(train: DataFrame, test: DataFrame, least: int = 30) -> DataFrame:
    """Weights of least error variance from a covariance shrunk to a multiple of the identity, not negative and at most 2/k each; the mean where too few rows are complete. Means, products and fourth moments are sums; the driver gets a small matrix a fold and bucket."""
    sources = [r["source"] for r in train.select("source").distinct().orderBy("source").collect()]  # few
    k_all = len(sources)
    values = [F.max(F.when(F.col("source") == s, F.col("x"))) for s in sources]
    errors = settled(train.groupBy(*CELL).agg(F.first("y").alias("y"), F.array(*values).alias("x")).select("fold", "bucket", F.transform("x", lambda v: v - F.col("y")).alias("e")), "errors")
    # A bucket's sources are those it has seen; rows that have them all count.
    seen = errors.groupBy("fold", "bucket").agg(F.array(*[F.count(F.col("e")[i]) > 0 for i in range(k_all)]).alias("has"))
    whole = errors.join(seen, ["fold", "bucket"]).where(F.forall(F.zip_with("e", "has", lambda v, h: v.isNotNull() | ~h), lambda ok: ok))
    whole = whole.withColumn("e", F.zip_with("e", "has", lambda v, h: F.when(h, v).otherwise(0.0)))
    means = whole.groupBy("fold", "bucket").agg(F.array(*[F.avg(F.col("e")[i]) for i in range(k_all)]).alias("m"))
    centred = whole.join(means, ["fold", "bucket"]).withColumn("c", F.zip_with("e", "m", lambda v, m: v - m))
    square = F.aggregate(F.transform("c", lambda v: v * v), F.lit(0.0), lambda a, v: a + v)
    pairs = [(i, j) for i in range(k_all) for j in range(i, k_all)]
    sums = centred.withColumn("s", square).groupBy("fold", "bucket").agg(F.count("*").alias("n"), F.sum(F.col("s") * F.col("s")).alias("fourth"), *[F.avg(F.col("c")[i] * F.col("c")[j]).alias(f"c{i}_{j}") for i, j in pairs])
    rows = []
    for r in seen.join(sums, ["fold", "bucket"], "left").collect():
        own = [i for i in range(k_all) if r["has"][i]]
        w = np.zeros(k_all)
        w[own] = 1 / len(own)
        if (r["n"] or 0) >= least:
            s = np.array([[r[f"c{min(i, j)}_{max(i, j)}"] for j in own] for i in own])
            w[own] = least_variance(s, r["n"], r["fourth"])
        rows.append((r["fold"], r["bucket"], *w.tolist()))
    fit = train.sparkSession.createDataFrame(rows, "fold int, bucket string, " + ", ".join(f"w{i} double" for i in range(k_all)))
    weight = F.coalesce(*[F.when(F.col("source") == s, F.col(f"w{i}")) for i, s in enumerate(sources)], F.lit(0.0)) if sources else F.lit(0.0)
    out = test.join(fit, ["fold", "bucket"], "left").withColumn("w", F.coalesce(weight, F.lit(0.0)))
    return out.groupBy(*CELL).agg(F.first("y").alias("y"), F.coalesce(F.try_divide(F.sum(F.col("w") * F.col("x")), F.sum("w")), F.avg("x")).alias("p"))


def least_variance(s: np.ndarray, n: int, fourth: float) -> np.ndarray:
    """Weights out of a covariance (divisor n) of centred errors, with ``fourth`` the sum of the squares of their squared lengths: the covariance is shrunk as far as its own noise, which is (sum |c|^4 - n |s|^2) / n^2, goes."""
    k = len(s)
    mu = np.trace(s) / k
    spread = ((s - mu * np.eye(k)) ** 2).sum()
    noise = min(max(fourth - n * (s**2).sum(), 0.0) / n**2, spread)
    s = noise / max(spread, 1e-12) * mu * np.eye(k) + (1 - noise / max(spread, 1e-12)) * s
    w = np.maximum(np.linalg.solve(s + 1e-12 * np.eye(k), np.ones(k)), 0)
    w = w / w.sum() if w.sum() > 0 else np.full(k, 1 / k)
    for _ in range(k):  # what exceeds the cap goes to the others
        over = w > 2 / k
        if not over.any():
            break
        extra = (w[over] - 2 / k).sum()
        w[over] = 2 / k
        free = w < 2 / k
        if not free.any():
            break
        w[free] += extra * (w[free] / w[free].sum() if w[free].sum() > 0 else 1 / free.sum())
    return w


def seamless(train: DataFrame, test: DataFrame, observed: DataFrame | None = None, ridge: float = 10.0, least: int = 48) -> DataFrame:
    """Ridge regression on all sources, the observation at issue and a constant. A source that is missing keeps its issue's last value, else takes the row's mean; so does a missing observation. Buckets are drawn to their fold's overall fit, and a fold of fewer than ``least`` rows has no prediction. The normal equations of all folds and buckets are one aggregate; only these small systems reach the driver."""
    names = sorted(r["source"] for r in train.select("source").distinct().collect())  # a few sources
    s = [f"s{k}" for k in range(len(names))]

    def design(rows: DataFrame) -> DataFrame:
        wide = rows.groupBy(*CELL).agg(F.first("y").alias("y"), *[F.max(F.when(F.col("source") == n, F.col("x"))).alias(c) for n, c in zip(names, s)])
        lead = Window.partitionBy("fold", "issue").orderBy("lead", "valid").rowsBetween(Window.unboundedPreceding, 0)
        wide = wide.select(*CELL, "y", *[F.last(c, ignorenulls=True).over(lead).alias(c) for c in s])
        mean = masked_mean(F.array(*s))
        wide = wide.withColumn("mean", mean).where("mean is not null")
        wide = wide.withColumn("obs", F.lit(None).cast("double")) if observed is None else wide.join(observed.select("issue", "obs"), "issue", "left")
        return wide.select(*CELL, "y", *[F.coalesce(c, "mean").alias(c) for c in s], *[F.col(c).isNotNull().cast("long").alias(f"has_{c}") for c in s], F.coalesce("obs", "mean").alias("obs"))

    terms = [*map(F.col, s), F.col("obs"), F.lit(1.0)]
    old = design(train)
    seen = [F.sum(f"has_{c}").alias(f"has_{c}") for c in s]
    systems = normal_equations(old, [["fold", "bucket"], ["fold"]], ["fold", "bucket"], terms, F.col("y"), seen)
    whole = {r["fold"]: r for r in systems if r["whole"]}
    rows = []

    def fitted(r, kept):
        own = [k for k in range(len(terms)) if k in kept]
        out = np.zeros(len(terms))
        a, b = system(r, len(terms))
        out[own] = np.linalg.solve(a[np.ix_(own, own)] + ridge * np.eye(len(own)), b[own])
        return out

    for r in systems:
        g = whole[r["fold"]]
        if g["n"] < least:
            continue
        kept = {k for k in range(len(s)) if g[f"has_{s[k]}"]} | {len(s), len(s) + 1}
        w = 1.0 if r["whole"] else r["n"] / (r["n"] + least / 4)
        rows.append((r["fold"], None if r["whole"] else r["bucket"], (w * fitted(r, kept) + (1 - w) * fitted(g, kept)).tolist()))
    fit = train.sparkSession.createDataFrame(rows, "fold int, bucket string, c array<double>")
    local, overall = fit.where("bucket is not null"), fit.where("bucket is null").select("fold", F.col("c").alias("g"))
    out = design(test).join(F.broadcast(overall), "fold", "left").join(F.broadcast(local), ["fold", "bucket"], "left").withColumn("c", F.coalesce("c", "g"))  # a row a fold and bucket
    point = sum((F.element_at("c", k + 1) * t for k, t in enumerate(terms)), F.lit(0.0))
    return out.select(*CELL, "y", point.alias("p"))


QUANTILES = OUT + ", q array<double>"


def emos(train: DataFrame, test: DataFrame, least: int = 60) -> DataFrame:
    """``laws.emos`` with seven levels."""
    return laws.emos(train, test, least, LEVELS)


class IsotonicLaw:
    """P(y <= threshold | base) for a grid of thresholds, each an isotonic fit that falls in the base. Rows of equal base are one, so their order doesn't matter; a base between two that were seen has the law of the lower."""

    def __init__(self, base: np.ndarray, y: np.ndarray, grid: np.ndarray | None = None):
        self.grid = thresholds(y) if grid is None else grid
        self.at, which, size = np.unique(base, return_inverse=True, return_counts=True)
        order = np.argsort(which, kind="stable")
        over = np.add.reduceat((y[order, None] > self.grid).astype(float), np.cumsum(size) - size) / size[:, None]
        self.cdf = np.maximum.accumulate(1 - isotonic(over, size), axis=1)

    def rows(self, base: np.ndarray) -> np.ndarray:
        return self.cdf[np.clip(np.searchsorted(self.at, base, "right") - 1, 0, self.at.size - 1)]

    def transforms(self, base: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Where each y stands in its distribution, 0 below the grid and 1 above."""
        return np.array([np.interp(v, self.grid, r, left=0.0, right=1.0) for v, r in zip(y, self.rows(base))])


def thresholds(y: np.ndarray) -> np.ndarray:
    return np.unique(np.quantile(y, np.linspace(0.02, 0.98, 49)))


def read_off(rows: np.ndarray, grid: np.ndarray, levels=LEVELS) -> list[np.ndarray]:
    """Quantiles of distributions on a grid."""
    rise = np.arange(grid.size) * 1e-12
    return [np.interp(levels, r + rise, grid) for r in rows]


def known(base: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.isfinite(base) & np.isfinite(y))


def isotonic_distribution(train: DataFrame, test: DataFrame, least: int = 100) -> DataFrame:
    """``laws.isotonic_distribution`` with seven levels."""
    return laws.isotonic_distribution(train, test, least, LEVELS)


def subsampled_isotonic(train: DataFrame, test: DataFrame, least: int = 100, halves: int = 50) -> DataFrame:
    """Isotonic laws averaged over halves of the rows, drawn by a generator seeded with their number, all on the grid of the whole."""

    def fit(x, y, new, *_):
        base, at = _mean(x), _mean(new)
        some = known(base, y)
        if some.size < least:
            return {"p": at, "q": [None] * len(at)}
        base, y = base[some], y[some]
        rng, grid, total = np.random.default_rng(some.size), thresholds(y), 0.0
        for _ in range(halves):
            pick = rng.permutation(some.size)[: some.size // 2]
            total = total + IsotonicLaw(base[pick], y[pick], grid).rows(at)
        q = read_off(np.maximum.accumulate(total / halves, axis=1), grid)
        return {"p": np.array([v[LEVELS.index(0.5)] for v in q]), "q": q}

    return per_bucket(train, test, fit, QUANTILES)


def calibrated_isotonic(train: DataFrame, test: DataFrame, least: int = 75) -> DataFrame:
    """Isotonic laws whose levels are replaced by order statistics of the transforms of the last quarter of the rows, 25 at least."""

    def fit(x, y, new, *_):
        base, at = _mean(x), _mean(new)
        some = known(base, y)
        cut = some.size - max(25, some.size // 4)
        if cut < least:
            return {"p": at, "q": [None] * len(at)}
        law = IsotonicLaw(base[some[:cut]], y[some[:cut]])
        pit = np.sort(law.transforms(base[some[cut:]], y[some[cut:]]))
        ranks = [min(max(math.ceil((pit.size + 1) * t), 1), pit.size) for t in LEVELS]
        q = read_off(law.rows(at), law.grid, np.clip(pit[np.array(ranks) - 1], 1e-6, 1 - 1e-6))
        return {"p": np.array([v[LEVELS.index(0.5)] for v in q]), "q": q}

    return per_bucket(train, test, fit, QUANTILES)


def or_global(train: DataFrame, test: DataFrame, method) -> DataFrame:
    """A method's rows; those of a bucket too thin for a law of its own are served by one fitted on all buckets of the fold, which is fitted only where it is needed."""
    cell = ["fold", "issue", "valid", "lead"]
    served = settled(method(train, test), "laws")
    thin = served.where("q is null").select("fold", "bucket").distinct()
    if not thin.limit(1).count():
        return served
    folds = thin.select("fold").distinct()
    old = train.join(F.broadcast(folds), "fold", "left_semi")  # a row a fold
    new = test.join(F.broadcast(thin), ["fold", "bucket"], "left_semi")  # a row a fold and bucket
    whole = method(*(df.withColumn("bucket", F.lit("all")) for df in (old, new))).select(*cell, F.col("p").alias("whole_p"), F.col("q").alias("whole_q"))
    return served.join(whole, cell, "left").select(*CELL, "y", F.when(F.col("q").isNull(), F.col("whole_p")).otherwise(F.col("p")).alias("p"), F.coalesce("q", "whole_q").alias("q"))


COVERAGES = (0.5, 0.8, 0.9)


class Radii:
    """Interval radii that follow a stream of absolute errors. Twenty errors set them, by finite-sample ranks; from then on each moves by a tenth of the largest of the last fifty errors, up by its coverage when missed and down by the rest when not, and an integral of the misses, bent by a tangent, adds to it."""

    WARM, KEPT = 20, 50

    def __init__(self):
        self.radius, self.missed, self.n = np.zeros(len(COVERAGES)), np.zeros(len(COVERAGES)), 0
        self.recent: deque[float] = deque(maxlen=self.KEPT)

    def see(self, error: float) -> None:
        level = np.array(COVERAGES)
        inside = error <= self.now() if self.n >= self.WARM else None
        self.n += 1
        self.recent.append(error)
        if self.n < self.WARM:
            return
        if self.n == self.WARM:
            ordered = np.sort(self.recent)
            ranks = np.minimum(np.ceil((ordered.size + 1) * level).astype(int), ordered.size)
            self.radius = ordered[ranks - 1]
            return
        self.radius = np.maximum(self.radius + 0.1 * self.scale() * (level - inside), 0)
        self.missed += level - inside

    def scale(self) -> float:
        return max([*self.recent, 1e-6])

    def now(self) -> np.ndarray:
        t = max(self.n, 2)
        bend = np.tan(np.clip(self.missed * math.log(t) / (0.5 * t), -1.2, 1.2))
        return np.maximum(self.radius + self.scale() * bend, 0)


def conformal(train: DataFrame, test: DataFrame, base=grounded, day: Column | None = None, delay: int = 2, share: float = 0.7, least: int = 60) -> DataFrame:
    """Intervals around a base. The base is fitted on issues of the first ``share`` whose truth was known by then; radii follow the errors of the later ones in the order in which they became known, for each bucket by day and night, and over all where a cell has seen fewer than twenty. base: a function of training rows and rows to correct."""
    issues = train.select("fold", "issue").distinct()
    w = Window.partitionBy("fold")
    ranked = issues.withColumn("k", F.row_number().over(w.orderBy("issue")) - 1).withColumn("n", F.count("*").over(w))
    at = F.least(F.greatest(F.floor(F.col("n") * F.lit(share)), F.lit(1)), F.greatest(F.col("n") - 1, F.lit(1)))
    cut = ranked.where(F.col("k") == at).select("fold", F.col("issue").alias("cut"))
    split_ = train.join(F.broadcast(cut), "fold", "left")  # a row a fold
    proper = split_.where((F.col("issue") < F.col("cut")) & (F.col("valid") + delay <= F.col("cut")) | F.col("cut").isNull()).drop("cut")
    late = split_.where(F.col("issue") >= F.col("cut")).drop("cut")
    enough = proper.groupBy("fold").agg(F.count_distinct("issue", "valid").alias("k")).where(F.col("k") >= least).select("fold")
    mean = lambda rows: base(proper, rows).groupBy(*CELL).agg(F.first("y").alias("y"), F.avg("x").alias("p")).withColumn("cell", F.concat_ws("|", "bucket", F.lit("") if day is None else day.cast("string")))
    errors = settled(mean(late).join(enough, "fold", "left_semi").select("fold", "cell", "valid", "issue", "lead", F.abs(F.col("y") - F.col("p")).alias("e")).where("e is not null"), "errors")

    def follow(key, pdf):
        radii = Radii()
        for e in pdf.sort_values(["valid", "issue", "lead"])["e"].tolist():
            radii.see(e)
        return pd.DataFrame([[key[0], key[1], radii.now().tolist()]]) if radii.n >= Radii.WARM else pd.DataFrame(columns=range(3))

    # All errors of a fold are followed only where a cell to be served has too few of its own.
    seen = errors.groupBy("fold", "cell").agg(F.count("*").alias("seen"))
    thin = mean(test).select("fold", "cell").distinct().join(seen, ["fold", "cell"], "left").where(F.coalesce("seen", F.lit(0)) < Radii.WARM).select("fold").distinct()
    both = errors.unionByName(errors.join(thin, "fold", "left_semi").withColumn("cell", F.lit("all")))
    tracked = both.groupBy("fold", "cell").applyInPandas(follow, "fold int, cell string, r array<double>")
    whole = tracked.where("cell = 'all'").select("fold", F.col("r").alias("g"))
    rows = mean(test).join(whole, "fold", "left").join(tracked, ["fold", "cell"], "left").withColumn("r", F.coalesce("r", "g"))
    width = lambda k: F.col("r")[k]
    q = F.array(*[F.col("p") - width(k) for k in (2, 1, 0)], F.col("p"), *[F.col("p") + width(k) for k in (0, 1, 2)])
    return rows.select(*CELL, "y", "p", F.when(F.col("r").isNotNull(), q).alias("q"))


def censored_gamma(train: DataFrame, test: DataFrame, least: int = 60, wet: int = 10) -> DataFrame:
    """``laws.censored_gamma`` with seven levels."""
    return laws.censored_gamma(train, test, least, wet, LEVELS)


def analogs(train: DataFrame, test: DataFrame, k: int = 25, least: int = 100, pool: int = 50, block: int = 1024, levels=LEVELS) -> DataFrame:
    """The median and quantiles of what followed the k most alike training rows: the distance is the root mean square over the sources both have, each in its own deviations over the fold. A bucket of fewer than ``pool`` rows looks at all of its fold; a fold of fewer than ``least`` has no prediction. Rows meet in blocks (see ``neighbours``), of which those that are too far don't."""
    levels = list(levels)
    sigma = train.groupBy("fold", "source").agg(F.greatest(F.stddev_pop("x"), F.lit(1e-6)).alias("sd"), F.count("*").alias("n")).where("n >= 2").drop("n")
    sources = [r["source"] for r in train.select("source").distinct().orderBy("source").collect()]  # few

    def cells(rows: DataFrame) -> DataFrame:
        scaled = rows.join(sigma, ["fold", "source"]).withColumn("x", F.col("x") / F.col("sd"))
        at = [F.max(F.when(F.col("source") == s, F.col("x"))) for s in sources]
        out = scaled.groupBy(*CELL).agg(F.first("y").alias("y"), F.array(*at).alias("z"))
        return settled(out.withColumn("id", F.monotonically_increasing_id()), "cells")

    old, new = cells(train), cells(test)
    sizes = settled(old.groupBy("fold", "bucket").agg(F.count("*").alias("n")), "pools")
    enough = sizes.groupBy("fold").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("fold")
    own = sizes.where(F.col("n") >= pool).select("fold", "bucket")
    named = lambda bucket: F.concat_ws("/", F.col("fold").cast("string"), bucket)
    asking = new.join(enough, "fold", "left_semi").join(own.withColumn("own", F.lit(True)), ["fold", "bucket"], "left").withColumn("pool", F.when(F.col("own"), named(F.col("bucket"))).otherwise(named(F.lit("*"))))
    thin = asking.where("own is null").select("fold").distinct()
    candidates = old.join(own, ["fold", "bucket"], "left_semi").withColumn("pool", named(F.col("bucket"))).unionByName(old.join(thin, "fold", "left_semi").withColumn("pool", named(F.lit("*"))))
    found, _ = neighbours.nearest(asking.select("pool", "id", "z", "y"), candidates.select("pool", "id", "z", "y"), k, block)
    law = found.groupBy("id").agg(F.percentile("y", 0.5).alias("p"), F.percentile("y", F.array(*map(F.lit, levels))).alias("q"))
    return asking.join(law, "id", "left").select(*CELL, "y", "p", "q")


def platt(p: np.ndarray, y: np.ndarray, beta: bool = False, rounds: int = 25, ridge: float = 1e-4) -> np.ndarray:
    """Coefficients of the same fit as ``logistic_fits`` on arrays that are at hand: Newton steps, halved until the loss doesn't rise; the identity without five cases of either kind."""
    p = np.clip(p, 1e-4, 1 - 1e-4)
    a = np.column_stack([np.ones(len(p)), np.log(p), -np.log1p(-p)] if beta else [np.ones(len(p)), np.log(p) - np.log1p(-p)])
    c = np.array([0.0, 1.0, 1.0][: a.shape[1]])
    if min((y > 0).sum(), (y <= 0).sum()) < 5:
        return c

    def loss(v):
        z = np.clip(a @ v, -30, 30)
        return float((np.log1p(np.exp(z)) - y * z).sum() + 0.5 * ridge * v @ v)

    for _ in range(rounds):
        mu = 1 / (1 + np.exp(-np.clip(a @ c, -30, 30)))
        step = np.linalg.solve((a * np.maximum(mu * (1 - mu), 1e-6)[:, None]).T @ a + ridge * np.eye(len(c)), a.T @ (mu - y) + ridge * c)
        tries = [c - 0.5**k * step for k in range(20)]
        better = next((v for v in tries if loss(v) <= loss(c)), None)
        if better is None or np.abs(better - c).max() < 1e-8:
            break
        c = better
    return np.clip(c, -8, 8)


def logit_terms(p: Column, beta: bool = False) -> list[Column]:
    """1 and the logit of a probability, or 1, its logarithm and less that of its complement."""
    p = F.greatest(F.lit(1e-4), F.least(F.lit(1 - 1e-4), p))
    return [F.lit(1.0), F.ln(p), -F.ln(1 - p)] if beta else [F.lit(1.0), F.ln(p) - F.ln(1 - p)]


def logistic_fits(rows: DataFrame, by: str, terms: list[Column], y: Column, start: list[float], ridge: float = 1e-4, rounds: int = 25, least: int = 5, prior: float = 6.0) -> dict[str | None, np.ndarray]:
    """Coefficients of ridge logistic regressions, one a group and one over all (under None), by Newton steps that are halved until the loss doesn't rise. Gradients, Hessians and the losses of all halvings of all groups are one aggregate each, so rows never leave their tasks. Without ``least`` cases of either kind a group keeps ``start``; each is drawn to the overall fit by n / (n + prior). Coefficients end within 8."""
    n = len(terms)
    flat = rows.select(F.explode(F.array(F.col(by).cast("string"), F.lit(None).cast("string"))).alias("g"), y.cast("double").alias("y"), F.array(*terms).alias("t")).where("y is not null")
    flat = settled(flat, "terms")  # each step reads it
    counts = {r["g"]: (r["n"], r["wet"]) for r in flat.groupBy("g").agg(F.count("*").alias("n"), F.sum((F.col("y") > 0).cast("long")).alias("wet")).collect()}
    c = {g: np.array(start, float) for g in counts}
    live = {g for g, (total, wet) in counts.items() if wet >= least and total - wet >= least}
    dot = lambda coefficients: sum((F.get(coefficients, F.lit(k)) * F.get("t", F.lit(k)) for k in range(n)), F.lit(0.0))

    def joined(columns: dict[str, dict], schema: str) -> DataFrame:
        table = rows.sparkSession.createDataFrame([(g, *[v[g] for v in columns.values()]) for g in live], f"h string, {schema}")
        return flat.join(F.broadcast(table), F.col("g").eqNullSafe(F.col("h")))  # a row a group

    for _ in range(rounds):
        if not live:
            break
        mu = 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), dot(F.col("c"))))))
        t = [F.get("t", F.lit(k)) for k in range(n)]
        weight = F.greatest(F.col("mu") * (1 - F.col("mu")), F.lit(1e-6))
        sums = joined({"c": {g: c[g].tolist() for g in live}}, "c array<double>").withColumn("mu", mu).groupBy("g").agg(*[F.sum((F.col("mu") - F.col("y")) * t[i]).alias(f"b{i}") for i in range(n)], *[F.sum(weight * t[i] * t[j]).alias(f"a{i}_{j}") for i in range(n) for j in range(i, n)]).collect()
        steps = {}
        for r in sums:
            a, b = system(r, n)
            steps[r["g"]] = np.linalg.solve(a + ridge * np.eye(n), b + ridge * c[r["g"]])
        tries = {g: [(c[g] - 0.5**k * steps[g]).tolist() for k in range(20)] + [c[g].tolist()] for g in live}
        z = F.transform("tries", lambda v: F.greatest(F.lit(-30.0), F.least(F.lit(30.0), dot(v))))
        loss = [F.sum(F.log1p(F.exp(F.get("z", F.lit(k)))) - F.col("y") * F.get("z", F.lit(k))).alias(f"l{k}") for k in range(21)]
        done = set()
        for r in joined({"tries": tries}, "tries array<array<double>>").withColumn("z", z).groupBy("g").agg(*loss).collect():
            g = r["g"]
            penal = lambda k: r[f"l{k}"] + 0.5 * ridge * float(np.square(tries[g][k]).sum())  # noqa: B023, E731
            better = next((k for k in range(20) if penal(k) <= penal(20)), None)
            if better is not None:
                c[g] = np.array(tries[g][better])
            if better is None or np.abs(0.5**better * steps[g]).max() < 1e-8:
                done.add(g)
        live -= done
    share = lambda g: counts[g][0] / (counts[g][0] + prior)
    clipped = {g: np.clip(v, -8, 8) for g, v in c.items()}
    return {g: clipped[g] if g is None else share(g) * clipped[g] + (1 - share(g)) * clipped[None] for g in clipped}


def recalibrated(frame: DataFrame, by: str, p: str, y: str, part: str, beta: bool = False) -> DataFrame:
    """Rows whose ``part`` is 'test' with ``after``, their probability recalibrated on the rows of 'train': by group, drawn to the fit over all; a group without training rows takes that."""
    start = [0.0, 1.0, 1.0] if beta else [0.0, 1.0]
    fits = logistic_fits(frame.where(F.col(part) == "train"), by, logit_terms(F.col(p), beta), F.col(y), start)
    fits.setdefault(None, np.array(start))
    table = frame.sparkSession.createDataFrame([(g, v.tolist()) for g, v in fits.items() if g is not None], "__g string, __c array<double>")
    rows = frame.where(F.col(part) == "test").join(F.broadcast(table), F.col(by).cast("string").eqNullSafe(F.col("__g")), "left")  # a row a group
    c = F.coalesce("__c", F.array(*[F.lit(float(v)) for v in fits[None]]))
    z = sum((F.get(c, F.lit(k)) * t for k, t in enumerate(logit_terms(F.col(p), beta))), F.lit(0.0))
    return rows.withColumn("after", 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), z))))).drop("__g", "__c")
