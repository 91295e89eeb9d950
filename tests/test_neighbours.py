"""Nearest neighbours in blocks, and weights out of moments, against plain versions."""

import math

import numpy as np
import pytest

from weftcast.operators import neighbours, sequential


def gappy(seed, n, dims=3, gaps=0.15, grid=0.1):
    rng, out = np.random.default_rng(seed), []
    for k in range(n):
        level = rng.normal(0, 3)
        z = np.round((level + rng.normal(0, 0.3, dims)) / grid) * grid
        out.append(("p" if k % 3 else "q", k, [None if rng.random() < gaps else float(v) for v in z], float(rng.normal())))
    return out


def plain(queries, candidates, k):
    out = {}
    for pool, i, z, _ in queries:
        ways = []
        for other, j, t, y in candidates:
            both = [(a, b) for a, b in zip(z, t) if a is not None and b is not None]
            if other == pool and both:
                ways.append((math.sqrt(sum((a - b) ** 2 for a, b in both) / len(both)), j, y))
        out[i] = sorted(ways)[:k]
    return out


@pytest.mark.parametrize("size, k", [(8, 5), (64, 25), (1024, 3)])
def test_nearest_with_gaps_and_ties(spark, size, k):
    schema = "pool string, id long, z array<double>, y double"
    old, new = gappy(1, 500), gappy(2, 90) + [("p", 1000, [None, None, None], 0.0), ("none", 1001, [1.0, 2.0, 3.0], 0.0)]
    found, seen = neighbours.nearest(spark.createDataFrame(new, schema), spark.createDataFrame(old, schema).repartition(3), k, size)
    got: dict = {}
    for r in found.orderBy("id", "rank").collect():
        got.setdefault(r["id"], []).append((r["distance"], r["other"], r["y"]))
    want = plain(new, old, k)
    for i, ways in want.items():
        mine = got.get(i, [])
        assert [round(d, 9) for d, _, _ in mine] == [round(d, 9) for d, _, _ in ways]
        clear = [j for d, j, _ in ways if sum(abs(d - e) < 1e-9 for e, _, _ in ways) == 1][:-1]
        assert set(clear) <= {j for _, j, _ in mine}
    met = {(r["q"], r["c"]): r["seen"] for r in seen.collect()}
    assert len(met) == seen.count() and any(met.values())


def test_blocks_that_are_too_far_do_not_meet(spark):
    schema = "pool string, id long, z array<double>, y double"
    old, new = gappy(5, 3000, gaps=0.0), gappy(6, 600, gaps=0.0)
    found, seen = neighbours.nearest(spark.createDataFrame(new, schema), spark.createDataFrame(old, schema), 5, 32)
    counts = {r["seen"]: r["count"] for r in seen.groupBy("seen").count().collect()}
    assert counts[False] > counts[True]
    far = {(r["id"], r["rank"]): r["distance"] for r in found.collect()}
    want = plain(new[:60], old, 5)
    assert all(far[i, k + 1] == pytest.approx(d) for i, ways in want.items() for k, (d, _, _) in enumerate(ways))


def test_weights_from_moments():
    rng = np.random.default_rng(3)
    for k in (2, 3, 5):
        c = rng.normal(0, 1, (80, k)) @ rng.normal(0, 1, (k, k))
        c -= c.mean(axis=0)
        s = c.T @ c / len(c)
        mu = np.trace(s) / k
        spread = ((s - mu * np.eye(k)) ** 2).sum()
        noise = min(sum(((np.outer(r, r) - s) ** 2).sum() for r in c) / len(c) ** 2, spread)
        assert max((c**2).sum(axis=1).__pow__(2).sum() - len(c) * (s**2).sum(), 0) / len(c) ** 2 == pytest.approx(noise) or noise == spread
        w = sequential.least_variance(s, len(c), float(((c**2).sum(axis=1) ** 2).sum()))
        assert w.sum() == pytest.approx(1) and w.min() >= 0 and w.max() <= 2 / k + 1e-9


def test_inverse_covariance_against_rows(spark):
    rng, rows = np.random.default_rng(4), []
    for fold in (0, 1):
        for k in range(120):
            y = float(rng.normal())
            for b in ("x", "y") if k < 100 else ("x",):
                for s, size in (("a", 0.2), ("b", 1.0), ("c", 1.5)):
                    if (b == "y" and s == "c") or rng.random() < 0.1:
                        continue
                    rows.append((fold, k, k + 1, 1, b, s, y + float(rng.normal(0, size)), y))
    df = spark.createDataFrame(rows, "fold int, issue long, valid long, lead long, bucket string, source string, x double, y double")
    old, new = df.where("issue < 80"), df.where("issue >= 80")
    got = {(r["fold"], r["issue"], r["bucket"]): r["p"] for r in sequential.inverse_covariance(old, new).collect()}
    for fold in (0, 1):
        for b, sources in (("x", "abc"), ("y", "ab")):
            cells: dict = {}
            for f, i, _, _, bb, s, x, y in rows:
                if f == fold and bb == b:
                    cells.setdefault(i, ({}, y))[0][s] = x
            whole = np.array([[c[s] - y for s in sources] for i, (c, y) in cells.items() if i < 80 and set(c) == set(sources)])
            c = whole - whole.mean(axis=0)
            s = c.T @ c / len(c)
            w = sequential.least_variance(s, len(c), float(((c**2).sum(axis=1) ** 2).sum())) if len(c) >= 30 else np.full(len(sources), 1 / len(sources))
            for i, (cell, _) in cells.items():
                if i >= 80:
                    own = [(w[sources.index(n)], v) for n, v in cell.items()]
                    total = sum(u for u, _ in own)
                    want = sum(u * v for u, v in own) / total if total else np.mean([v for _, v in own])
                    assert got[fold, i, b] == pytest.approx(want)
