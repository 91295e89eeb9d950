"""Operators 11 to 13 against brute force in plain Python."""

import hashlib
import math
from fractions import Fraction

import numpy as np
import pytest

from weftcast.llm import codes, topk, whiten
from weftcast.llm.vectors import floors, packed, unpacked

COLUMNS = "vec_id long, embedding array<float>, label int, x string, near int, row string, error string, query_id int"
NAN, INF = float("nan"), float("inf")


@pytest.fixture
def vectors(spark):
    """Makes an embeddings table with extra columns whose names the operators use themselves."""

    def make(rows):
        return spark.createDataFrame([(i, v, k, "x", 1, "r", "e", 2) for i, v, k in rows], COLUMNS).repartition(3)

    return make


def drawn(n: int, dims: int, seed: int, grid: float = 1 / 64) -> list:
    """Rows on a coarse grid, so that distances and scores tie often; with repeats, nulls and hot copies."""
    rng = np.random.default_rng(seed)
    values = (np.round(rng.normal(0, 0.15, (n, dims)) / grid) * grid).tolist()
    rows = [(k * 5, v, int(rng.integers(0, 4)) if k % 7 else None) for k, v in enumerate(values)]
    rows += [(100_000 + k, values[3], 1) for k in range(n // 3)]
    rows += [(rows[0][0], rows[0][1], 2), (None, values[1], 0), (None, values[2], None)]
    bad = [(7, None, 1), (8, [None, *values[0][1:]], 1), (9, [NAN, *values[0][1:]], 1), (11, [*values[0][1:], INF], 2), (12, [], 1)]
    return rows + bad


def good(rows):
    return [r for r in rows if r[1] and all(c is not None and math.isfinite(c) for c in r[1])]


def plain_codes(rows, parts, entries, rounds, scale):
    rows = [(i, [math.floor(scale * c) for c in v], k) for i, v, k in good(rows)]
    first = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))[:entries]
    width = len(rows[0][1]) // parts
    cut = lambda v: [v[p * width : (p + 1) * width] for p in range(parts)]
    books = [[cut(v)[p] for _, v, _ in first] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    for k in range(rounds + 1):
        near = [[min(range(len(books[p])), key=lambda e: (far(v, books[p][e]), e)) for p, v in enumerate(cut(x))] for _, x, _ in rows]
        if k == rounds:
            break
        for p in range(parts):
            for e in range(len(books[p])):
                mine = [cut(x)[p] for (_, x, _), n in zip(rows, near) if n[p] == e]
                if mine:
                    books[p][e] = [sum(c) // len(mine) for c in zip(*mine)]
    errors = [sum(far(v, books[p][n[p]]) for p, v in enumerate(cut(x))) for (_, x, _), n in zip(rows, near)]
    labels: dict = {}
    for (_, _, k), e in zip(rows, errors):
        labels[k] = labels.get(k, 0) + e
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return [(i, "".join(f"{e:02x}" for e in n), e, labels[k], digest) for (i, _, k), n, e in zip(rows, near, errors)]


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((v is None, v or 0) if not isinstance(v, str) else (False, v) for v in r))


@pytest.mark.parametrize("seed, grid", [(1, 1 / 64), (2, 1 / 16), (3, 1 / 4096)])
def test_codes(vectors, seed, grid):
    rows = drawn(160, 16, seed, grid)
    got = codes.code_digests(vectors(rows), parts=8, entries=16, rounds=6).collect()
    assert ordered(map(tuple, got)) == ordered(plain_codes(rows, 8, 16, 6, 4096))


def test_codes_of_few_rows(vectors, spark):
    rows = [(4, [0.5, -0.25], None), (4, [0.5, -0.25], 3), (1, [0.125, 1.0], None)]
    got = codes.code_digests(vectors(rows), parts=2).collect()
    assert ordered(map(tuple, got)) == ordered(plain_codes(rows, 2, 16, 6, 4096))
    one = codes.code_digests(vectors(rows[:1]), parts=2).collect()
    assert [tuple(r)[:4] for r in one] == [(4, "0000", 0, 0)]
    assert codes.code_digests(vectors([(1, None, 2)]), parts=2).collect() == []
    assert codes.code_digests(vectors([])).columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]


def test_bounds_spare_comparisons_and_change_nothing():
    rng = np.random.default_rng(5)
    x = rng.integers(-600, 600, (3000, 4, 8))
    x = x // 150 * 150 + rng.integers(-9, 9, x.shape)
    books, before, state = x[:16].transpose(1, 0, 2).copy(), None, [np.zeros((3000, 4), np.int64) for _ in range(3)]
    scans = []
    for _ in range(8):
        now = codes.Round(books, before)
        scans.append(now.assign(x, *state))
        want = np.stack([codes.squares(x[:, p], books[p]).argmin(axis=1) for p in range(4)], axis=1)
        assert (state[0] == want).all()
        for p in range(4):
            far = np.sort(codes.squares(x[:, p], books[p]), axis=1)
            assert (state[1][:, p] ** 2 >= far[:, 0]).all() and (state[2][:, p] ** 2 <= far[:, 1]).all()
        sums = np.zeros((4, 16, 9), np.int64)
        for p in range(4):
            for e in range(16):
                mine = x[want[:, p] == e, p]
                sums[p, e, :8], sums[p, e, 8] = mine.sum(axis=0), len(mine)
        before, books = books, codes.moved(books, sums)
    assert scans[0] == 12_000 and scans[-1] < 6_000


def test_roots():
    n = np.array([0, 1, 2, 3, 4, 8, 9, 2**60, 2**60 - 1, (2**30 - 1) ** 2, (2**30 - 1) ** 2 + 1])
    low, high = codes.roots(n)
    assert [int(v) for v in low] == [math.isqrt(int(v)) for v in n] and all(h * h >= v and (h == 0 or (h - 1) ** 2 < v) for h, v in zip(high.tolist(), n.tolist()))


def test_packing():
    for x in ([[1, -2], [3, 32767]], [[1, -2], [70_000, 1]], [[1 << 40, 0], [5, -(1 << 31)], [0, 0]]):
        x = np.array(x, np.int64)
        assert (unpacked(packed(x), 2) == x).all()
    assert floors(np.array([[-0.1, 0.1]], float), 256).tolist() == [[-26, 25]]
    with pytest.raises(OverflowError):
        floors(np.array([[1e300]]), 256)


def plain_top(rows, k, every=50, scale=256):
    rows = [(i, [math.floor(scale * c) for c in v]) for i, v, _ in good(rows)]
    out = []
    for q, (i, v) in enumerate(rows):
        if i is None or i % every:
            continue
        found = [(-sum(a * b for a, b in zip(v, w)), j is None, j or 0) for c, (j, w) in enumerate(rows) if c != q]
        out += [(i, r + 1, None if none else j, -s) for r, (s, none, j) in enumerate(sorted(found)[:k])]
    return out


@pytest.mark.parametrize("seed, grid, bins, group", [(1, 1 / 64, 512, 4096), (2, 1 / 8, 4, 4096), (3, 1 / 4096, 16, 3)])
def test_top_k(vectors, monkeypatch, seed, grid, bins, group):
    from pyspark.sql import functions as F

    monkeypatch.setattr(topk, "GROUP", group)
    rows = drawn(150, 8, seed, grid)
    if bins == 512:
        got = topk.top_k(vectors(rows), F.col("vec_id") % 50 == 0).collect()
        assert ordered(map(tuple, got)) == ordered(plain_top(rows, 5))
    counts = np.random.default_rng(seed).integers(0, 3, (20, bins))
    sent = topk.cut(counts, np.full(20, 4))
    for c, s in zip(counts, sent):
        kept = np.flatnonzero(s)
        low = kept.min()
        assert (s[low:] == c[low:]).all() and s.sum() >= min(4, c.sum()) and (c[low + 1 :].sum() < 4)
    if group == 3:
        got = topk.top_k(vectors(rows), F.col("vec_id") % 50 == 0, k=40).collect()
        assert ordered(map(tuple, got)) == ordered(plain_top(rows, 40))


def test_top_k_of_few(vectors):
    from pyspark.sql import functions as F

    asks = F.col("vec_id") % 50 == 0
    rows = [(0, [1.0, 0.0], 1), (50, [1.0, 0.0], 1), (3, [-1.0, 2.0], None)]
    assert ordered(map(tuple, topk.top_k(vectors(rows), asks).collect())) == ordered(plain_top(rows, 5))
    zeros = [(0, [0.0, 0.0], 1), (1, [0.0, 0.0], 1), (None, [0.0, 0.0], 1)]
    assert ordered(map(tuple, topk.top_k(vectors(zeros), asks).collect())) == ordered(plain_top(zeros, 5))
    for none in ([], rows[:1], rows[2:], [(0, None, 1)]):
        assert topk.top_k(vectors(none), asks).collect() == []


def test_group_of_large_scores_is_exact():
    big = np.array([[2**25 + 1, 3]])
    group = topk.Group(np.array([9]), big, int((big**2).sum()))
    import pyarrow as pa

    scores, own = group.scores(pa.RecordBatch.from_arrays([pa.array([4, 9]), packed(np.array([[1, 1], [2**25 + 1, 3]]))], names=["row", "x"]))
    assert scores.tolist() == [[2**25 + 4], [(2**25 + 1) ** 2 + 9]] and own.tolist() == [1]


@pytest.mark.parametrize("seed, dims", [(1, 6), (2, 3)])
def test_whitening(vectors, seed, dims):
    rows = drawn(120, dims, seed)
    got = whiten.whitening_digests(vectors(rows)).collect()
    ints = [(i, [math.floor(256 * c) for c in v]) for i, v, _ in good(rows)]
    fit = sorted({tuple(x) for _, x in ints})
    n, s = len(fit), [sum(c) for c in zip(*fit)]
    y = np.array([[n * a - b for a, b in zip(x, s)] for x in fit], object)
    cov = np.array([[float(Fraction(int(v), n**3)) for v in r] for r in y.T @ y])
    values, vecs = np.linalg.eigh(cov)
    k = min(4, dims)
    values, vecs = values[::-1][:k], vecs[:, ::-1][:, :k]
    assert len(got) == k * len(ints)
    signs = {}
    by: dict = {}
    for r in got:
        by.setdefault(r.vec_id, []).append(r)
    for i, x in ints:
        dev = sum((n * a - b) ** 2 for a, b in zip(x, s))
        want = (np.array(x) - np.array(s) / n) @ vecs / np.sqrt(values)
        mine = [r for r in by[i] if r.deviation == dev]
        assert {r.component for r in mine} == set(range(1, k + 1)) and all(r.n == n for r in mine)
        if len(by[i]) > k:
            continue
        for r in mine:
            w = want[r.component - 1]
            sign = signs.setdefault(r.component, 1 if r.whitened * w >= 0 else -1)
            assert abs(r.whitened - sign * w) < 1e-9
            assert abs(r.explained - values[r.component - 1] / cov.trace()) < 1e-9 and r.identity_error < 1e-9


def test_scatter_is_exact_at_any_size(spark):
    rng = np.random.default_rng(3)
    x = rng.integers(-(2**40), 2**40, (50, 3))
    table = spark.createDataFrame([(bytes(v.as_py()),) for v in packed(x)], "x binary").repartition(4)
    sums = [int(c) for c in x.sum(axis=0)]
    y = 50 * x.astype(object) - np.array(sums, object)
    assert (whiten.exact_scatter(table, 50, sums, int(np.abs(x).max())) == y.T @ y).all()
    moduli = whiten.primes(10**40)
    assert all(whiten.reconstructed([v % p for p in moduli], moduli) == v for v in (0, 1, -1, 10**39, -(10**39)))


def test_whitening_without_variance(vectors):
    same = [(k, [0.5, 0.25, 0.0], 1) for k in range(4)]
    got = whiten.whitening_digests(vectors(same)).collect()
    assert len(got) == 12 and all(r.n == 1 and r.deviation == 0 and r.whitened is None and r.explained is None and r.identity_error is None for r in got)
    line = [(k, [k / 4, -k / 4, 1.0], 1) for k in range(6)]
    got = whiten.whitening_digests(vectors(line)).collect()
    assert {r.component for r in got if r.whitened is not None} == {1} and all(r.identity_error < 1e-9 for r in got)
    assert abs(next(r.explained for r in got if r.component == 1) - 1) < 1e-12
    assert whiten.whitening_digests(vectors([(1, None, 1)])).collect() == []
