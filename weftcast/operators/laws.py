"""Distributional methods whose fit is one over all rows of a fold, without a fold ever being in one task.

Parametric laws are fitted by Newton steps on sums: a pass over the training cells gives the losses of all folds at the
points that a gradient, a Hessian and a line search need. Isotonic laws are pooled where the rows are, range by
range of the base, and blocks meet: pooling blocks of pooled rows is pooling the rows. Quantiles are exact,
by places in one sort over the cluster.

Rows are long: fold, issue, valid, lead, bucket, source, x (corrected), perhaps raw (as the source gave it) and path, y.
Predictions are cells with p and q, quantiles at ``levels``; a fold with too little to learn from has the base alone.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.special import gamma_below, gamma_quantile, gaussian_crps, log_gamma, normal_log_cdf, truncated_normal_quantile
from ..sources.scratch import dealt, settled
from .methods import CELL

#: Levels of the quantiles that are served, those of the outcome grid of isotonic laws, the least spread, the days over which weights fade.
LEVELS = tuple(round(0.05 * k, 2) for k in range(1, 20))
GRID = tuple(np.linspace(0.02, 0.98, 49))
LEAST_SPREAD, FADING = 1e-3, 45
QUANTILES = "fold int, issue long, valid long, lead long, bucket string, y double, p double, q array<double>"
#: Blocks of isotonic laws that may go to every task. A fold of n rows has O(n^(2/3)) at most.
MOST_BLOCKS = 8_000_000


def cells(rows: DataFrame) -> DataFrame:
    """One row a cell: y, p (the sources' mean), s (the logarithm of their spread as given, LEAST_SPREAD at least) and path (p where there is none)."""
    raw = F.col("raw") if "raw" in rows.columns else F.col("x")
    path = F.first("path") if "path" in rows.columns else F.lit(None).cast("double")
    out = rows.groupBy(*CELL).agg(F.first("y").alias("y"), F.avg("x").alias("p"), F.stddev_pop(raw).alias("sd"), path.alias("path"))
    return out.select(*CELL, "y", "p", F.log(F.greatest(F.coalesce("sd", F.lit(0.0)), F.lit(LEAST_SPREAD))).alias("s"), F.coalesce("path", "p").alias("path"))


def learned(rows: DataFrame) -> DataFrame:
    """Training cells with a base and a truth, and w, weights that fade with an issue's age in its fold and add up to 1."""
    known = cells(rows).where("p is not null and y is not null")
    age = known.groupBy("fold").agg(F.max("issue").alias("newest"))
    w = F.exp(-(F.col("newest") - F.col("issue")) / F.lit(24.0 * FADING))
    out = known.join(age, "fold").withColumn("w", w)
    total = out.groupBy("fold").agg(F.sum("w").alias("total"))
    out = out.join(total, "fold").select("fold", "issue", "y", "p", "s", "path", (F.col("w") / F.col("total")).alias("w"))
    return dealt(out)  # the passes that follow are work, not reading


Loss = Callable[[np.ndarray, pd.DataFrame], np.ndarray]


def totals(rows: DataFrame, loss: Loss, points: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    """The weighted losses of each fold at its points; one pass over the rows."""

    def run(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            pdf = batch.to_pandas()
            for fold, g in pdf.groupby("fold"):
                if fold in points:
                    with np.errstate(all="ignore"):
                        got = np.array([float(g["w"].to_numpy() @ loss(t, g)) for t in points[fold]])
                    sums[fold] = sums.get(fold, 0.0) + got
        if sums:
            yield pa.RecordBatch.from_pydict({"fold": pa.array(list(sums), pa.int32()), "sums": pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))})

    parts = rows.mapInArrow(run, "fold int, sums array<double>").select("fold", F.posexplode("sums").alias("at", "v"))
    out = {f: np.full(len(t), math.nan) for f, t in points.items()}
    for r in parts.groupBy("fold", "at").agg(F.sum("v").alias("v")).collect():
        out[r["fold"]][r["at"]] = r["v"]
    return out


def lowest(rows: DataFrame, loss: Loss, start: dict[int, np.ndarray], most: int = 30, h: float = 1e-3) -> dict[int, np.ndarray]:
    """For each fold the parameters of least loss from ``start`` on, by damped Newton steps with differences for derivatives. A fold whose loss is infinite or undefined at its start has none."""
    found: dict[int, np.ndarray] = {}
    at = {f: np.array(t, float) for f, t in start.items()}
    live = set(at)
    for turn in range(most):
        if not live:
            break
        k = len(next(iter(at.values())))
        moves = [np.zeros(k)] + [s * h * np.eye(k)[i] for i in range(k) for s in (1, -1)]
        moves += [h * (a * np.eye(k)[i] + b * np.eye(k)[j]) for i, j in itertools.combinations(range(k), 2) for a, b in ((1, 1), (1, -1), (-1, 1), (-1, -1))]
        value = totals(rows, loss, {f: at[f] + np.array(moves) for f in live})
        step = {}
        for f in sorted(live):
            v = value[f]
            if not np.isfinite(v).all():
                live.discard(f)
                if turn:
                    found[f] = at[f]
                continue
            g = (v[1 : 1 + 2 * k : 2] - v[2 : 2 + 2 * k : 2]) / (2 * h)
            curve = np.diag((v[1 : 1 + 2 * k : 2] + v[2 : 2 + 2 * k : 2] - 2 * v[0]) / h**2)
            for n, (i, j) in enumerate(itertools.combinations(range(k), 2)):
                q = v[1 + 2 * k + 4 * n : 5 + 2 * k + 4 * n]
                curve[i, j] = curve[j, i] = (q[0] - q[1] - q[2] + q[3]) / (4 * h**2)
            size, axes = np.linalg.eigh(curve)
            size = np.maximum(np.abs(size), max(1e-6, 1e-6 * np.abs(size).max()))
            step[f] = -axes @ ((axes.T @ g) / size)
        lengths = 0.5 ** np.arange(-1, 12)
        tried = totals(rows, loss, {f: at[f] + np.outer(lengths, step[f]) for f in step})
        for f, v in tried.items():
            best = int(np.nanargmin(np.where(np.isfinite(v), v, np.inf)))
            gain = value[f][0] - v[best]
            if gain > 0:
                at[f] = at[f] + lengths[best] * step[f]
            if not gain > 1e-9 * (1 + abs(value[f][0])):
                found[f] = at[f]
                live.discard(f)
    return found | {f: at[f] for f in live}


def served(test: DataFrame, q_of: Callable, fits: dict[int, np.ndarray], levels: Iterable[float]) -> DataFrame:
    """Test cells with quantiles q_of(parameters, cells) and the median as the point; folds without parameters have the base alone."""
    levels = list(levels)
    middle = levels.index(0.5)

    def run(batches):
        for batch in batches:
            pdf = batch.to_pandas()
            p, q = pdf["p"].to_numpy(float).copy(), [None] * len(pdf)
            for fold, g in pdf.groupby("fold"):
                at = pdf.index.get_indexer(g.index)
                some = at[np.isfinite(p[at])]
                if fold in fits and some.size:
                    with np.errstate(all="ignore"):
                        got = np.sort(q_of(fits[fold], pdf.iloc[some], np.array(levels)), axis=1)
                    for k, row in zip(some, got):
                        q[k] = row.tolist()
                    p[some] = got[:, middle]
            columns = [batch.column(k) for k in range(6)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(p, pa.float64(), mask=np.isnan(p)), pa.array(q, pa.list_(pa.float64()))], names=[*CELL, "y", "p", "q"])

    return cells(test).select(*CELL, "y", "p", "s", "path").mapInArrow(run, QUANTILES)


def _spread(c: float, d: float, g: pd.DataFrame) -> np.ndarray:
    return np.maximum(np.exp(np.clip(c + d * g["s"].to_numpy(), -30, 30)), LEAST_SPREAD)


def _normal(path: bool):
    def of(t, g):
        mu = t[0] + t[1] * g["p"].to_numpy() + (t[4] * g["path"].to_numpy() if path else 0.0)
        return mu, _spread(t[2], t[3], g)

    return of


def emos(train: DataFrame, test: DataFrame, least: int = 60, levels=LEVELS, minimum: float | None = None, maximum: float | None = None, path: bool = False) -> DataFrame:
    """A normal law of mean a + b base (+ e path) and spread exp(c + d ln s), fitted over all cells of a fold with weights that fade.

    Without bounds the CRPS is least. With bounds the law is cut off there and the likelihood is greatest; where a truth
    lies beyond a bound no likelihood is finite, and the fit is the unbounded one, but the law served keeps its bounds. A fold
    of fewer than ``least`` cells has the base alone.
    """
    rows = settled(learned(train), "learned")
    law, bounded = _normal(path), minimum is not None or maximum is not None
    low, high = (-math.inf if minimum is None else minimum), (math.inf if maximum is None else maximum)

    def crps(t, g):
        mu, sigma = law(t, g)
        return gaussian_crps(mu, sigma, g["y"].to_numpy())

    def cut_off(t, g):
        mu, sigma = law(t, g)
        y = g["y"].to_numpy()
        z = (y - mu) / sigma
        mass = log_mass((low - mu) / sigma, (high - mu) / sigma)
        return np.where((y >= low) & (y <= high), z * z / 2 + math.log(2 * math.pi) / 2 + np.log(sigma) + mass, math.inf)

    start = {}
    for r in rows.groupBy("fold").agg(F.count("*").alias("n"), F.stddev_pop(F.col("y") - F.col("p")).alias("sd")).collect():
        if r["n"] >= least:
            start[r["fold"]] = np.array([0.0, 1.0, math.log(max(r["sd"], LEAST_SPREAD)), 0.0, *[0.0] * path])
    fits = lowest(rows, cut_off, start) if bounded else {}
    fits |= lowest(rows, crps, {f: t for f, t in start.items() if f not in fits})

    def quantiles(t, g, at):
        mu, sigma = law(t, g)
        return truncated_normal_quantile(at[None, :], mu[:, None], sigma[:, None], low, high)

    return served(test, quantiles, fits, levels)


def log_mass(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The logarithm of a normal law's mass between a and b; taken from the tail that both are in, so that it doesn't vanish."""
    a, b = np.where(a > 0, -b, a), np.where(a > 0, -a, b)
    upper, lower = normal_log_cdf(b), normal_log_cdf(a)
    return upper + np.log1p(-np.exp(np.minimum(lower - upper, -1e-300)))


#: Amounts up to this are none.
NONE = 1e-9


def _gamma(t, g):
    """Shape, scale and shift of the law of a cell; the shift's parameter is the logarithm of its distance from zero."""
    mu, sigma, shift = t[0] + t[1] * g["p"].to_numpy(), np.exp(np.clip(t[2] + t[3] * g["s"].to_numpy(), -30, 30)), -math.exp(min(t[4], 30))
    reach, sigma = np.maximum(mu - shift, 1e-3), np.maximum(sigma, LEAST_SPREAD)
    return (reach / sigma) ** 2, sigma**2 / reach, shift


def censored_gamma(train: DataFrame, test: DataFrame, least: int = 60, wet: int = 10, levels=LEVELS) -> DataFrame:
    """Amounts that are often none: a gamma law shifted below zero and censored there, of mean a + b base and spread exp(c + d ln s), of greatest likelihood over all cells of a fold with weights that fade. No law in a fold of fewer than ``least`` cells or ``wet`` amounts above none."""
    rows = settled(learned(train), "learned")

    def loss(t, g):
        k, scale, shift = _gamma(t, g)
        y = g["y"].to_numpy()
        rain = y > NONE
        z = np.maximum(y - shift, 1e-12) / scale
        out = -((k - 1) * np.log(z) - z - log_gamma(k) - np.log(scale))
        dry = ~rain
        if dry.any():
            out[dry] = -np.log(np.maximum(gamma_below(k[dry], -shift / scale[dry]), 1e-300))
        return out

    rain = F.when(F.col("y") > NONE, F.col("y"))
    start = {}
    for r in rows.groupBy("fold").agg(F.count("*").alias("n"), F.count(rain).alias("wet"), F.stddev_pop(rain).alias("sd")).collect():
        if r["n"] >= least and r["wet"] >= wet:
            start[r["fold"]] = np.array([0.0, 1.0, math.log(max(r["sd"], LEAST_SPREAD)), 0.0, math.log(0.1)])
    fits = lowest(rows, loss, start)

    def quantiles(t, g, at):
        k, scale, shift = _gamma(t, g)
        return np.maximum(shift + scale[:, None] * gamma_quantile(at[None, :], k[:, None]), 0)

    return served(test, quantiles, fits, levels)


def exact_quantiles(rows: DataFrame, key: str, value: str, levels: Iterable[float]) -> dict:
    """Quantiles of every key by straight lines between order statistics: one sort over the cluster; each task numbers its rows, and those at the wanted places are picked. Keys are few."""
    levels = list(levels)
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    kind = dict(rows.dtypes)[key]

    def number(batches):
        held = {}
        for batch in batches:
            keys, values = batch.column(0).to_pandas(), batch.column(1).to_numpy(zero_copy_only=False)
            place = np.empty(len(keys), np.int64)
            for k, at in keys.groupby(keys).indices.items():
                place[at] = held.get(k, 0) + np.arange(at.size)
                held[k] = held.get(k, 0) + at.size
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values), pa.array(place)], names=["key", "v", "place"])

    ordered = rows.select(F.col(key).alias("key"), F.col(value).alias("v")).repartitionByRange(parts, "key", "v").sortWithinPartitions("key", "v")
    table = settled(ordered.mapInArrow(number, f"key {kind}, v double, place long").withColumn("slice", F.spark_partition_id()), "numbered")
    by_key = Window.partitionBy("key")
    before = F.coalesce(F.sum("n").over(by_key.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    slices = table.groupBy("key", "slice").agg(F.count("*").alias("n")).withColumn("before", before).withColumn("total", F.sum("n").over(by_key)).drop("n")
    at = F.transform(F.array(*map(F.lit, levels)), lambda t: t * (F.col("total") - 1))
    placed = table.join(slices, ["key", "slice"]).withColumn("place", F.col("place") + F.col("before"))
    wanted = placed.where(F.exists(at, lambda h: (F.floor(h) == F.col("place")) | (F.ceil(h) == F.col("place")))).select("key", "total", "place", "v")
    out: dict = {}
    got: dict = {}
    for r in wanted.collect():  # twice the levels a key
        got.setdefault(r["key"], (r["total"], {}))[1][r["place"]] = r["v"]
    for k, (total, by_place) in got.items():
        h = np.array(levels) * (total - 1)
        low, high = (np.array([by_place[int(i)] for i in f(h)]) for f in (np.floor, np.ceil))
        out[k] = low + (h - np.floor(h)) * (high - low)
    return out


def pooled(column: np.ndarray, start: np.ndarray, value: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Blocks of non-decreasing value in each column, from blocks in order of column and start. Pooling what has been pooled in parts gives the same blocks as pooling all at once."""
    while True:
        falls = (value[:-1] >= value[1:]) & (column[:-1] == column[1:])
        if not falls.any():
            return column, start, value, weight
        first = np.flatnonzero(np.append(True, ~falls))
        total = np.add.reduceat(weight, first)
        value = np.add.reduceat(value * weight, first) / total
        column, start, weight = column[first], start[first], total


class Pools:
    """A task's blocks of one fold. Rows come in order of the base; those of one base are one, so the last base is held back until another follows."""

    def __init__(self, grid: np.ndarray):
        self.grid, self.base, self.n, self.over = grid, None, 0.0, np.zeros(grid.size)
        self.blocks = tuple(np.empty(0, t) for t in (np.int64, float, float, float))

    def add(self, base: np.ndarray, y: np.ndarray) -> None:
        at, first, size = np.unique(base, return_index=True, return_counts=True)
        over = np.add.reduceat((y[:, None] > self.grid).astype(float), first)
        size = size.astype(float)
        if self.base is not None and self.base == at[0]:
            over[0], size[0] = over[0] + self.over, size[0] + self.n
        elif self.base is not None:
            at, over, size = np.append(self.base, at), np.vstack([self.over, over]), np.append(self.n, size)
        self.base, self.n, self.over = float(at[-1]), float(size[-1]), over[-1].copy()
        self._pool(at[:-1], over[:-1], size[:-1])

    def _pool(self, at, over, size) -> None:
        if at.size:
            z = self.grid.size
            new = (np.repeat(np.arange(z), at.size), np.tile(at, z), (over / size[:, None]).T.ravel(), np.tile(size, z))
            both = [np.concatenate(x) for x in zip(self.blocks, new)]
            order = np.lexsort((both[1], both[0]))
            self.blocks = pooled(*(x[order] for x in both))

    def all(self):
        if self.base is not None:
            self._pool(np.array([self.base]), self.over[None, :], np.array([self.n]))
            self.base = None
        return self.blocks


def isotonic_blocks(rows: DataFrame, grids: dict[int, np.ndarray]) -> DataFrame:
    """fold, threshold (its index), starts, values: how the share of y over each threshold rises with p, as steps."""
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)

    def pool(batches):
        held: dict[int, Pools] = {}
        for batch in batches:
            pdf = batch.to_pandas()
            for fold, g in pdf.groupby("fold"):
                if fold in grids:
                    held.setdefault(fold, Pools(grids[fold])).add(g["p"].to_numpy(), g["y"].to_numpy())
        for fold, pools in held.items():
            column, start, value, weight = pools.all()
            cuts = np.searchsorted(column, np.arange(pools.grid.size + 1))
            for z, (a, b) in enumerate(zip(cuts, cuts[1:])):
                yield pa.RecordBatch.from_pylist([{"fold": fold, "threshold": z, "starts": start[a:b].tolist(), "values": value[a:b].tolist(), "weights": weight[a:b].tolist()}], pa.schema([("fold", pa.int32()), ("threshold", pa.int32()), ("starts", pa.list_(pa.float64())), ("values", pa.list_(pa.float64())), ("weights", pa.list_(pa.float64()))]))

    ordered = rows.select("fold", "p", "y").repartitionByRange(parts, "fold", "p").sortWithinPartitions("fold", "p")
    schema = "fold int, threshold int, starts array<double>, values array<double>"

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        start, value, weight = (np.concatenate([np.asarray(v, float) for v in pdf[c]]) for c in ("starts", "values", "weights"))
        order = np.argsort(start, kind="stable")
        _, start, value, _ = pooled(np.zeros(start.size, np.int64), start[order], value[order], weight[order])
        return pd.DataFrame([(pdf["fold"].iloc[0], pdf["threshold"].iloc[0], start.tolist(), value.tolist())], columns=["fold", "threshold", "starts", "values"])

    return ordered.mapInArrow(pool, schema + ", weights array<double>").groupBy("fold", "threshold").applyInPandas(meet, schema)


def isotonic_distribution(train: DataFrame, test: DataFrame, least: int = 100, levels=LEVELS) -> DataFrame:
    """P(y <= threshold | base) for each of a fold's outcome quantiles, falling in the base: one isotonic law over all cells of the fold, whatever their bucket. Between bases seen the law of the lower holds, beyond them that of the nearest. A fold of fewer than ``least`` cells has the base alone."""
    rows = settled(cells(train).where("p is not null and y is not null").select("fold", "p", "y"), "learned")
    enough = [r["fold"] for r in rows.groupBy("fold").count().collect() if r["count"] >= least]
    grids = {f: np.unique(v) for f, v in exact_quantiles(rows, "fold", "y", GRID).items() if f in enough}
    blocks = settled(isotonic_blocks(rows, grids), "isotonic")
    if (blocks.agg(F.sum(F.size("starts"))).first()[0] or 0) > MOST_BLOCKS:
        raise ValueError(f"isotonic laws of over {MOST_BLOCKS} blocks can't go to every task")
    laws: dict[int, list] = {}
    for r in blocks.orderBy("fold", "threshold").collect():
        laws.setdefault(r["fold"], []).append((np.array(r["starts"]), np.array(r["values"])))

    def quantiles(law, g, at):
        grid, steps = law
        p = g["p"].to_numpy()
        cdf = np.stack([1 - v[np.clip(np.searchsorted(s, p, "right") - 1, 0, s.size - 1)] for s, v in steps], axis=1)
        cdf = np.maximum.accumulate(cdf, axis=1) + np.arange(grid.size) * 1e-12
        return np.stack([np.interp(at, row, grid) for row in cdf])

    return served(test, quantiles, {f: (grids[f], steps) for f, steps in laws.items()}, levels)
