"""Whitening of embeddings from an exact scatter matrix, put together from residues.

Components become integers x. The fit list holds each distinct x once: n vectors with sums S. The scatter of the
centred integers n * x - S is exact: every partition reduces them modulo several primes, multiplies residue matrices as
doubles (products of residues of 20 bits, added up over 4096 rows, fit 53 bits), and adds the results up modulo the prime.
The sums of all partitions meet by prime and cell, and Chinese remaindering makes whole numbers of them. There are so
many primes that their product exceeds twice what a cell can reach, so nothing wraps, at any size. Divided by n**3
(numerator and denominator whole until then) that is the covariance, which ``eigh`` decomposes in double precision.

Distinct vectors are found by an aggregate over packed integers, which combines copies before anything is shuffled. The driver
gets sums alone: a number a component, a number a cell and prime, sixteen for the check.

Rows whose vector is null, empty or holds null or non-finite components are dropped; null ids, and rows that repeat,
are rows like others. A direction without variance (fewer distinct vectors than components, constant components) can't be
whitened: whitened is null there, and the identity error is that of the others (null if there are none); explained is
null where nothing varies. Vectors of fewer than ``components`` components have as many as they can. Equal eigenvalues have no
order of their own; the one of ``eigh`` holds for all rows. An empty table gives no rows. All vectors have one length. Columns
besides the two named aren't read.
"""

from __future__ import annotations

import itertools
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .vectors import SLICE, dimension, in_slices, integers, summed, unpacked

#: Residues are under this: SLICE of their products add up to less than 2**53.
LIMIT = 1 << 20


def primes(product: int) -> list[int]:
    """The largest primes under LIMIT whose product exceeds ``product``."""
    found: list[int] = []
    reached = 1
    for p in range(LIMIT - 1, 2, -2):
        if all(p % d for d in range(3, int(p**0.5) + 1, 2)):
            found.append(p)
            reached *= p
            if reached > product:
                break
    return found


def reconstructed(residues: list[int], moduli: list[int]) -> int:
    """The number of least absolute value with these residues (Chinese remainder theorem)."""
    whole = 1
    for p in moduli:
        whole *= p
    value = sum(r * (whole // p) * pow(whole // p, -1, p) for r, p in zip(residues, moduli)) % whole
    return value - whole if 2 * value > whole else value


def _sums(dims: int):
    """A task's sums of all components."""

    def run(batches):
        total = np.zeros(dims, object)

        def step(batch):
            total[:] += unpacked(batch.column(0), dims).sum(axis=0).astype(object)
            return ()

        def last():
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.int64()))], names=["sums"])

        yield from in_slices(step, last)(batches)

    return run


def _scatter(dims: int, n: int, sums: list[int], moduli: list[int]):
    """A task's scatter of n * x - S modulo each prime: the upper triangle, prime after prime."""
    upper = np.triu_indices(dims)

    def run(batches):
        total = np.zeros((len(moduli), upper[0].size), np.int64)

        def step(batch):
            x = unpacked(batch.column(0), dims)
            for k, p in enumerate(moduli):
                centred = ((n % p) * (x % p) - np.array([s % p for s in sums], np.int64)) % p
                centred = centred.astype(np.float64)
                total[k] = (total[k] + (centred.T @ centred)[upper].astype(np.int64)) % p
            return ()

        def last():
            yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()], pa.list_(pa.int64()))], names=["sums"])

        yield from in_slices(step, last)(batches)

    return run


class Fit:
    """What the fit list says: n, S, the first eigenvectors as columns, 1 / sqrt of their eigenvalues (NaN where nothing varies) and their shares of the trace."""

    def __init__(self, n: int, sums: list[int], scatter: np.ndarray, components: int):
        self.n, self.sums, self.dims = n, sums, len(sums)
        covariance = np.array([[float(Fraction(int(v), n**3)) for v in row] for row in scatter])
        values, vectors = np.linalg.eigh(covariance)
        values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
        heavy = np.abs(vectors).argmax(axis=0)
        self.vectors = vectors * np.sign(vectors[heavy, np.arange(vectors.shape[1])])
        trace = float(Fraction(sum(int(scatter[k, k]) for k in range(self.dims)), n**3))
        live = values > trace * self.dims * np.finfo(float).eps
        self.by = np.full(values.size, np.nan)
        self.by[live] = 1 / np.sqrt(values[live])
        self.explained = [None if not trace else max(float(v), 0.0) / trace for v in values]

    def centred(self, x: np.ndarray, largest: int) -> np.ndarray:
        """n * x - S, exactly: 64-bit integers where they fit, else Python's."""
        if self.n * largest < 1 << 61:
            return self.n * x - np.array(self.sums, np.int64)
        return self.n * x.astype(object) - np.array(self.sums, object)

    def whitened(self, centred: np.ndarray) -> np.ndarray:
        return centred.astype(np.float64) @ self.vectors / self.n * self.by


def _moments(fit: Fit, mean: np.ndarray | None):
    """A task's sums of the whitened fit list or, given their mean, of the products of what is left; as doubles."""

    def run(batches):
        total = np.zeros(fit.by.size if mean is None else fit.by.size**2)

        def step(batch):
            x = unpacked(batch.column(0), fit.dims)
            w = fit.whitened(fit.centred(x, int(np.abs(x).max(initial=0))))
            total[:] += w.sum(axis=0) if mean is None else ((w - mean).T @ (w - mean)).ravel()
            return ()

        def last():
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["sums"])

        yield from in_slices(step, last)(batches)

    return run


def _array(found: dict[int, float]) -> np.ndarray:
    return np.array([found[k] for k in range(len(found))])


def identity_error(distinct: DataFrame, fit: Fit) -> float | None:
    """The largest absolute entry of the whitened fit list's covariance minus the identity."""
    mean = _array(summed(distinct.mapInArrow(_moments(fit, None), "sums array<double>"))) / fit.n
    found = _array(summed(distinct.mapInArrow(_moments(fit, mean), "sums array<double>"))) / fit.n
    live = np.flatnonzero(~np.isnan(fit.by))
    off = np.abs(found.reshape(mean.size, -1) - np.eye(mean.size))[np.ix_(live, live)]
    return float(off.max()) if off.size else None


def exact_scatter(distinct: DataFrame, n: int, sums: list[int], largest: int) -> np.ndarray:
    """The scatter matrix of n * x - S over the fit list, in Python's integers."""
    dims = len(sums)
    moduli = primes(2 * n * (2 * n * largest) ** 2)
    found = summed(distinct.mapInArrow(_scatter(dims, n, sums, moduli), "sums array<long>"))
    cells = dims * (dims + 1) // 2
    out = np.zeros((dims, dims), object)
    for c, (i, j) in enumerate(itertools.combinations_with_replacement(range(dims), 2)):
        out[i, j] = out[j, i] = reconstructed([found[k * cells + c] % p for k, p in enumerate(moduli)], moduli)
    return out


def whitened(vectors: DataFrame, components: int = 4, scale: int = 256) -> DataFrame:
    """vec_id, component (from 1, by falling eigenvalue), n, deviation (the sum of squares of n * x - S, exact, as decimal(38, 0)), whitened, explained and identity_error of every valid row."""
    spark = vectors.sparkSession
    schema = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    rows = stored(integers(vectors, scale, {"vec_id": F.col("vec_id").cast("long")}), "whitening-vectors")
    dims = dimension(rows)
    if not dims:
        return spark.createDataFrame([], schema)
    distinct = stored(rows.select("x").distinct(), "fit-list")

    def largest_of(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([int(np.abs(unpacked(batch.column(0), dims)).max(initial=0))], pa.int64())], names=["largest"])

    n, largest = distinct.count(), distinct.mapInArrow(largest_of, "largest long").agg(F.max("largest")).first()[0]
    found = summed(distinct.mapInArrow(_sums(dims), "sums array<long>"))
    sums = [found[k] for k in range(dims)]
    fit = Fit(n, sums, exact_scatter(distinct, n, sums, largest), min(components, dims))
    error = identity_error(distinct, fit)
    k = fit.by.size

    def run(batches):
        def step(batch):
            x = unpacked(batch.column(1), dims)
            y, m = fit.centred(x, largest), len(x)
            small = dims * (2 * n * largest) ** 2 < 1 << 62
            deviation = ((y if small else y.astype(object)) ** 2).sum(axis=1)
            w = fit.whitened(y).ravel()
            repeated = np.repeat(np.arange(m), k)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(repeated)),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * k, n)),
                    pa.array(deviation.tolist(), pa.decimal128(38, 0)).take(pa.array(repeated)) if not small else pa.array(deviation[repeated], pa.int64()).cast(pa.decimal128(38, 0)),
                    pa.array(w, pa.float64(), mask=np.isnan(w)),
                    pa.array(fit.explained * m, pa.float64()),
                    pa.array([error] * (m * k), pa.float64()),
                ],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

        yield from in_slices(step)(batches)

    return rows.select("vec_id", "x").mapInArrow(run, schema)


def whitening_digests(vectors: DataFrame, **how) -> DataFrame:
    """``whitened`` with its deviation as a long; one that doesn't fit is an error."""
    return whitened(vectors, **how).withColumn("deviation", F.col("deviation").cast("long"))
