"""Boosted trees over binned features, for blends of sources. A fold is one grouped task: its rows are those of one history between two origins.

Trees have levels, each node split where the second-order gain is largest. A feature can
be held to raise the prediction: a split on it that would lower it is no candidate, and the
values below a split on it stay on their side of its middle.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sequential import CELL, LEVELS, OUT, QUANTILES

BINS = 64


class Binned:
    """Features as numbers of bins between quantiles of the training rows."""

    def __init__(self, x: np.ndarray):
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]

    def of(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, c, "left") for e, c in zip(self.edges, x.T)], axis=1)


class Tree:
    """Splits by level and a value a leaf."""

    def __init__(self, binned: np.ndarray, slope: np.ndarray, depth: int, least: int, penalty: float, rising: int | None):
        n, width = binned.shape
        node, self.levels = np.zeros(n, np.int64), []
        low, high = np.array([-math.inf]), np.array([math.inf])
        for level in range(depth):
            nodes = 1 << level
            cell = (node[:, None] * width + np.arange(width)) * BINS + binned
            count = np.bincount(cell.ravel(), minlength=nodes * width * BINS).reshape(nodes, width, BINS).cumsum(axis=2)
            total = np.bincount(cell.ravel(), np.repeat(slope, width), nodes * width * BINS).reshape(nodes, width, BINS).cumsum(axis=2)
            rest, other = count[:, :, -1:] - count, total[:, :, -1:] - total
            gain = total**2 / (count + penalty) + other**2 / (rest + penalty) - total[:, :, -1:] ** 2 / (count[:, :, -1:] + penalty)
            gain[(count < least) | (rest < least)] = -math.inf
            bound = lambda v: np.clip(v, low[:, None, None], high[:, None, None])  # noqa: B023, E731
            left, right = bound(-total / (count + penalty)), bound(-other / (rest + penalty))
            if rising is not None:
                gain[:, rising][left[:, rising] > right[:, rising]] = -math.inf
            flat = gain.reshape(nodes, -1)
            pick = flat.argmax(axis=1)
            column, cut = pick // BINS, pick % BINS
            cut = np.where(flat[np.arange(nodes), pick] > 1e-9, cut, BINS)  # else all stay on the left
            self.levels.append((column, cut))
            node = 2 * node + (binned[np.arange(n), column[node]] > cut[node])
            low, high = np.repeat(low, 2), np.repeat(high, 2)
            if rising is not None:
                for k in np.flatnonzero((column == rising) & (cut < BINS)).tolist():
                    middle = (left[k, rising, cut[k]] + right[k, rising, cut[k]]) / 2
                    high[2 * k], low[2 * k + 1] = min(high[2 * k], middle), max(low[2 * k + 1], middle)
        self.leaf, leaves = node, 1 << depth
        size = np.bincount(node, minlength=leaves)
        self.value = np.clip(-np.bincount(node, slope, leaves) / (size + penalty), low, high)

    def leaves(self, binned: np.ndarray) -> np.ndarray:
        node = np.zeros(len(binned), np.int64)
        for column, cut in self.levels:
            node = 2 * node + (binned[np.arange(len(binned)), column[node]] > cut[node])
        return node


def boosted(x: np.ndarray, y: np.ndarray, new: np.ndarray, rounds: int = 300, rate: float = 0.05, depth: int = 5, least: int = 20, rising: int | None = 0, level: float | None = None) -> np.ndarray:
    """Predictions for ``new``. Without a ``level`` the loss is Huber's, whose bend is at the ninth decile of the first residuals; with one it is the pinball loss, and a leaf's value is that quantile of its residuals."""
    bins = Binned(x)
    old, later = bins.of(x), bins.of(new)
    start = float(np.median(y) if level is None else np.quantile(y, level))
    f, out = np.full(len(y), start), np.full(len(new), start)
    bend = max(float(np.quantile(np.abs(y - start), 0.9)), 1e-9)
    for _ in range(rounds):
        slope = np.clip(f - y, -bend, bend) if level is None else (y < f) - level
        tree = Tree(old, slope, depth, least, 1.0, rising)
        value = tree.value if level is None else quantiles_by(tree.leaf, y - f, level, tree.value.size)
        f += rate * value[tree.leaf]
        out += rate * value[tree.leaves(later)]
    return out


def quantiles_by(group: np.ndarray, values: np.ndarray, level: float, groups: int) -> np.ndarray:
    """A quantile of each group's values, the lower of two; 0 for a group without any."""
    order = np.lexsort((values, group))
    at = np.searchsorted(group[order], np.arange(groups + 1))
    size = np.diff(at)
    place = np.minimum(at[:-1] + np.floor(np.maximum(size - 1, 0) * level).astype(np.int64), len(order) - 1)
    return np.where(size > 0, values[order][place], 0.0)


def _features(frame: pd.DataFrame, sources: list[str]) -> np.ndarray:
    """The mean of the sources first, then their spread, the hour, the lead, each source and whether it is there; a missing one counts as the mean."""
    xs = np.array([[dict(m).get(s, math.nan) for s in sources] for m in frame["xs"]], float).reshape(len(frame), len(sources))
    there = ~np.isnan(xs)
    mean = np.where(there, xs, 0).sum(axis=1) / np.maximum(there.sum(axis=1), 1)
    filled = np.where(there, xs, mean[:, None])
    hour = 2 * math.pi * (frame["valid"].to_numpy() % 24) / 24
    return np.column_stack([mean, filled.std(axis=1), np.sin(hour), np.cos(hour), frame["lead"].to_numpy(float), filled, there])


def _by_fold(train: DataFrame, test: DataFrame, predict, out: str, least: int) -> DataFrame:
    names = [c.split()[0] for c in out.split(", ")]
    cells = lambda df, t: df.groupBy(*CELL).agg(F.first("y").alias("y"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("source", "x")))).alias("xs")).withColumn("part", F.lit(t))

    def run(pdf):
        pdf = pdf.sort_values(["issue", "lead"], kind="stable")
        old, new = (pdf[pdf["part"] == p] for p in ("train", "test"))
        if len(old) < least or new.empty:
            return pd.DataFrame(columns=names)
        sources = sorted({s for m in old["xs"] for s in dict(m)})
        got = predict(_features(old, sources), old["y"].to_numpy(float), _features(new, sources))
        return new[[*CELL, "y"]].assign(**got)[names]

    return cells(train, "train").unionByName(cells(test, "test")).groupBy("fold").applyInPandas(run, out)


def stacked(train: DataFrame, test: DataFrame, least: int = 500, rounds: int = 300) -> DataFrame:
    """Boosted trees on the sources; a fold of fewer than ``least`` rows abstains."""
    return _by_fold(train, test, lambda x, y, new: {"p": boosted(x, y, new, rounds)}, OUT, least)


def stacked_quantiles(train: DataFrame, test: DataFrame, least: int = 500, rounds: int = 150) -> DataFrame:
    """A booster for each level; the quantiles of a row are put in order."""

    def predict(x, y, new):
        q = np.sort(np.stack([boosted(x, y, new, rounds, depth=4, level=t) for t in LEVELS], axis=1), axis=1)
        return {"p": q[:, LEVELS.index(0.5)], "q": list(q)}

    return _by_fold(train, test, predict, QUANTILES, least)
