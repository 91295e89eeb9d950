"""Distribution functions that the container has no library for."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np

_normal = NormalDist()


def normal_cdf(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2))


def normal_pdf(x: float) -> float:
    return math.exp(-x * x / 2) / math.sqrt(2 * math.pi)


def normal_ppf(p: float) -> float:
    return _normal.inv_cdf(min(max(p, 1e-300), 1 - 1e-16))


def _continued(f, most: int = 300) -> float:
    """A continued fraction b0 + a1/(b1 + a2/(b2 + ...)) by the modified Lentz method; f(k) gives (a, b)."""
    tiny = 1e-300
    value = f(0)[1] or tiny
    c, d = value, 0.0
    for k in range(1, most):
        a, b = f(k)
        d = 1 / ((b + a * d) or tiny)
        c = (b + a / c) or tiny
        value *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return value


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_inc(b, a, 1 - x)

    def term(k):
        if k == 0:
            return 0, 1
        m = k // 2 if k > 1 else 0
        if k == 1:
            return 1, 1
        j = k - 1
        m = j // 2
        d = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if j % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        return d, 1

    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    return front * (_continued(term) - 1)


def gamma_sf(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function."""
    if x <= 0:
        return 1.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        total = term = 1 / a
        k = a
        while abs(term) > 1e-16 * abs(total):
            k += 1
            term *= x / k
            total += term
        return 1 - front * total
    return front / _continued(lambda k: (0, x + 1 - a) if k == 0 else (-k * (k - a), x + 2 * k + 1 - a))


def chi2_sf(x: float, df: float) -> float:
    return gamma_sf(df / 2, x / 2)


def student_sf(t: float, df: float) -> float:
    """P(T > t)."""
    tail = beta_inc(df / 2, 0.5, df / (df + t * t)) / 2
    return tail if t > 0 else 1 - tail


def erf(x: np.ndarray) -> np.ndarray:
    return np.vectorize(math.erf, otypes=[float])(x)


def gaussian_crps(mu, sigma, y):
    """Of numbers or of arrays."""
    z = (y - mu) / sigma
    return sigma * (z * erf(z / math.sqrt(2)) + math.sqrt(2 / math.pi) * np.exp(-z * z / 2) - 1 / math.sqrt(math.pi))


def log_gamma(x: np.ndarray) -> np.ndarray:
    """ln of the gamma function for positive numbers: Stirling's series beyond 8, after steps up to there."""
    x = np.array(x, float)
    down = np.zeros_like(x)
    for _ in range(8):
        small = x < 8
        down = np.where(small, down + np.log(np.where(small, x, 1.0)), down)
        x = np.where(small, x + 1, x)
    z = 1 / (x * x)
    return (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + (1 / 12 - z * (1 / 360 - z * (1 / 1260 - z / 1680))) / x - down


#: From this shape on the cube root of a gamma variable counts as normal, which is good to 1e-5.
LARGE_SHAPE = 150.0


def gamma_below(a: np.ndarray, x: np.ndarray, most: int = 1000) -> np.ndarray:
    """Regularised lower incomplete gamma function of arrays: its power series, or for large shapes the normal law of the cube root."""
    a, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(x, float))
    x = np.maximum(x, 0.0)
    large = a > LARGE_SHAPE
    out = np.zeros(a.shape)
    if large.any():
        k = a[large]
        z = 3 * np.sqrt(k) * (np.cbrt(x[large] / k) - 1 + 1 / (9 * k))
        out[large] = (1 + erf(z / math.sqrt(2))) / 2
    k, v = a[~large], x[~large]
    if k.size:
        term = np.ones(k.shape)
        total = term.copy()
        for n in range(1, most):
            term = term * v / (k + n)
            total += term
            if (term <= 1e-14 * total).all():
                break
        front = np.exp(k * np.log(np.maximum(v, 1e-300)) - v - log_gamma(k + 1))
        out[~large] = np.where(v > 0, np.clip(front * total, 0, 1), 0.0)
    return out


def gamma_quantile(p: np.ndarray, a: np.ndarray, rounds: int = 60) -> np.ndarray:
    """Where the lower incomplete gamma function reaches p, by halving."""
    p, a = np.broadcast_arrays(np.asarray(p, float), np.asarray(a, float))
    low, high = np.zeros(a.shape), a + 12 * np.sqrt(a) + 40
    for _ in range(rounds):
        middle = (low + high) / 2
        under = gamma_below(a, middle) < p
        low, high = np.where(under, middle, low), np.where(under, high, middle)
    return (low + high) / 2


def simplex_search(f, start: np.ndarray, most: int = 400, step: float = 0.1, tolerance: float = 1e-7) -> np.ndarray:
    """Minimum of f by reflection, expansion, contraction and shrinkage of a simplex."""
    points = [np.array(start, float)]
    for k in range(len(start)):
        p = points[0].copy()
        p[k] += step if p[k] == 0 else step * abs(p[k])
        points.append(p)
    values = [f(p) for p in points]
    for _ in range(most):
        order = np.argsort(values, kind="stable")
        points, values = [points[k] for k in order], [values[k] for k in order]
        if abs(values[-1] - values[0]) <= tolerance * (abs(values[0]) + tolerance):
            break
        middle = np.mean(points[:-1], axis=0)
        trial = lambda c: (p := middle + c * (points[-1] - middle), f(p))  # noqa: B023, E731
        p, v = trial(-1.0)
        if v < values[0]:
            q, w = trial(-2.0)
            p, v = (q, w) if w < v else (p, v)
        elif v >= values[-2]:
            p, v = trial(-0.5 if v < values[-1] else 0.5)
            if v >= values[-1]:
                points = [points[0] + (x - points[0]) / 2 for x in points]
                values = [values[0], *map(f, points[1:])]
                continue
        points[-1], values[-1] = p, v
    return points[int(np.argmin(values))]


def isotonic(y: np.ndarray, w: np.ndarray | None = None) -> np.ndarray:
    """The non-decreasing fit of a sequence, or of each column of an array, by pooling adjacent violators. Neighbours in the wrong order end in one pool whatever is pooled first, so all falling runs of all columns are pooled at once, again and again until none is left."""
    y = np.asarray(y, float)
    columns = y.reshape(len(y), -1).T
    m, n = columns.shape
    if not n:
        return y.copy()
    value = columns.ravel().copy()
    weight = np.tile(np.ones(n) if w is None else np.asarray(w, float), m)
    size, column = np.ones(m * n, np.int64), np.repeat(np.arange(m), n)
    while True:
        falls = (value[:-1] > value[1:]) & (column[:-1] == column[1:])
        if not falls.any():
            return np.repeat(value, size).reshape(m, n).T.reshape(y.shape)
        first = np.flatnonzero(np.append(True, ~falls))
        total = np.add.reduceat(weight, first)
        value = np.add.reduceat(value * weight, first) / total
        weight, size, column = total, np.add.reduceat(size, first), column[first]


def normal_log_cdf(x: np.ndarray) -> np.ndarray:
    """The logarithm of the normal law's lower tail, exact far out: from -5 down by a continued fraction of the tail's ratio to the density."""
    x = np.asarray(x, float)
    far = np.minimum(x, -5.0)
    ratio = np.zeros_like(far)
    for k in range(60, 0, -1):
        ratio = k / (-far + ratio)
    with np.errstate(all="ignore"):
        tail = -far * far / 2 - math.log(2 * math.pi) / 2 - np.log(-far + ratio)
        near = np.log(0.5 * _erfc(-np.maximum(x, -5.0) / math.sqrt(2)))
    return np.where(x == -math.inf, -math.inf, np.where(x < -5, tail, near))


_erfc = np.vectorize(math.erfc, otypes=[float])


def normal_quantile_of_log(log_p: np.ndarray, rounds: int = 12) -> np.ndarray:
    """Where the logarithm of the normal law's lower tail is ``log_p``, for values down to -1e5, by Newton steps on it."""
    log_p = np.minimum(np.asarray(log_p, float), 0.0)
    with np.errstate(all="ignore"):
        half = np.sqrt(-2 * np.minimum(log_p, -math.log(2)))  # a start under the median; above it the mirror of one
        upper = np.sqrt(-2 * np.log(np.clip(-np.expm1(log_p), 1e-300, 0.5)))
        x = np.where(log_p < -math.log(2), -half + np.log1p(half) / np.maximum(half, 1), upper - np.log1p(upper) / np.maximum(upper, 1))
        for _ in range(rounds):
            value = normal_log_cdf(x)
            slope = np.exp(-x * x / 2 - math.log(2 * math.pi) / 2 - value)
            x = x - np.clip((value - log_p) / np.maximum(slope, 1e-300), -2, 2)
    return x


def truncated_normal_quantile(p: np.ndarray, mu: np.ndarray, sigma: np.ndarray, low: float, high: float) -> np.ndarray:
    """Quantiles of a normal law cut off at ``low`` and ``high``. Where both lie above the mean the law is mirrored, so that masses are those of a lower tail and keep their digits."""
    p, mu, sigma = np.broadcast_arrays(p, mu, sigma)
    a, b = (low - mu) / sigma, (high - mu) / sigma
    flip = a > 0
    a, b, q = np.where(flip, -b, a), np.where(flip, -a, b), np.where(flip, 1 - p, p)
    with np.errstate(all="ignore"):
        top, bottom = normal_log_cdf(b), normal_log_cdf(a)
        log_p = top + np.log(q + (1 - q) * np.exp(bottom - top))
    z = normal_quantile_of_log(log_p)
    return np.clip(mu + sigma * np.where(flip, -z, z), low, high)
