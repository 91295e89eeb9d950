"""Vector code compression: product codes whose codebooks are fitted by Lloyd rounds with Hamerly's bounds.

Components become integers, vectors are cut into ``parts`` equal parts, and each part position has a codebook of
``entries`` integer vectors. A round assigns every part to its nearest entry (ties to the lower index) and replaces each
entry by the floored mean of its parts.

Every part of every vector has two bounds, kept in a table from round to round: one over the distance to its entry and
one under the distance to the second nearest. When entries move, the bounds move with them. Where the upper one stays
strictly under the lower one, or twice itself strictly under the distance from the entry to its nearest other, no
other entry can be as near and the part keeps its entry; else the upper one is made exact, and if that doesn't settle
it, the part is compared with all entries. A part with two equally near entries never passes a strict test, so it is
always compared, and the lower index wins. Bounds are whole numbers rounded to the safe side; there is no rounding error.

A round is one job: it reads the table of the round before and writes the next into the shared folder, with a row
of sums a task beside the vectors; only these sums, grouped, reach the driver. The table before it is deleted.
Nothing else is shuffled, and a lost executor costs the running round alone.

Rows whose vector is null, empty or holds null or non-finite components are dropped. The first entries come from the rows with
the least ids; among equal ids by the bytes of their integers; null ids come last. Fewer rows than entries make smaller
codebooks, an empty table gives an empty result. Rows that repeat are rows like others. Null labels are one label. All
vectors have one length, a multiple of ``parts``; another length, or components over 2**26 once scaled, is an error.
Columns besides the three named aren't read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StringType, StructField, StructType

from .common import dropped, stored
from .vectors import constant, dimension, in_slices, integers, summed, unpacked

#: Scaled components stay under this, so that squares summed over a part fit 64 bits and bounds 32.
LARGEST = 1 << 26
#: The bound of what isn't there.
FAR = (1 << 31) - 1


def roots(squares: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Square roots of whole numbers, rounded down and up, exactly."""
    low = np.sqrt(squares.astype(np.float64)).astype(np.int64)
    low -= low * low > squares
    low += (low + 1) * (low + 1) <= squares
    return low, low + (low * low < squares)


def squares(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of each row to each entry."""
    apart = x[:, None, :] - entries[None, :, :]
    return np.einsum("nkd,nkd->nk", apart, apart)


class Round:
    """What a round knows of the codebooks: ``books`` (parts, entries, components), how far each entry has moved since the last round, and how far the nearest other entry of its codebook is."""

    def __init__(self, books: np.ndarray, before: np.ndarray | None = None):
        self.books, self.first = books, before is None
        parts, entries, _ = books.shape
        self.apart = np.full((parts, entries), FAR, np.int64)
        self.moves = np.zeros((parts, entries), np.int64)
        for p in range(parts):
            if entries > 1:
                between = squares(books[p], books[p])
                np.fill_diagonal(between, np.iinfo(np.int64).max)
                self.apart[p] = roots(between.min(axis=1))[0]
            if before is not None:
                self.moves[p] = roots(((books[p] - before[p]) ** 2).sum(axis=1))[1]

    def assign(self, x: np.ndarray, near: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> int:
        """Brings the three arrays (rows, parts) up to this round's codebooks; x has (rows, parts, components). Returns how many parts were compared with all entries."""
        scans = 0
        for p in range(x.shape[1]):
            rows = np.arange(len(x)) if self.first else self._unsettled(x, near, upper, lower, p)
            scans += rows.size
            if not rows.size:
                continue
            far = squares(x[rows, p], self.books[p])
            best = far.argmin(axis=1)  # the first of equal ones
            at = np.arange(rows.size)
            upper[rows, p] = roots(far[at, best])[1]
            near[rows, p] = best
            far[at, best] = np.iinfo(np.int64).max
            lower[rows, p] = roots(far.min(axis=1))[0] if far.shape[1] > 1 else FAR
        return scans

    def _unsettled(self, x, near, upper, lower, p: int) -> np.ndarray:
        moves, mine = self.moves[p], near[:, p]
        order = np.argsort(moves)
        most, next_ = moves[order[-1]], moves[order[-2]] if moves.size > 1 else 0
        u = upper[:, p] + moves[mine]
        low = np.maximum(lower[:, p] - np.where(mine == order[-1], next_, most), 0)
        if moves.size == 1:
            low[:] = FAR
        rows = np.flatnonzero(~((u < low) | (2 * u < self.apart[p][mine])))
        u[rows] = roots(self.exact(x[rows], near[rows], p))[1]
        upper[:, p], lower[:, p] = u, low
        left = u[rows]
        return rows[~((left < low[rows]) | (2 * left < self.apart[p][mine[rows]]))]

    def exact(self, x: np.ndarray, near: np.ndarray, p: int) -> np.ndarray:
        """Squared distances of part p to its entry."""
        return ((x[:, p] - self.books[p][near[:, p]]) ** 2).sum(axis=1)


class State:
    """A task's share of a round: the arrays of a slice, out of and into columns."""

    def __init__(self, round_: Round, dims: int):
        self.round, self.dims = round_, dims
        self.parts, self.entries, self.width = round_.books.shape
        self.sums = np.zeros((self.parts, self.entries, self.width + 1), np.int64)

    def assigned(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        x = unpacked(batch.column(2), self.dims)
        if x.size and np.abs(x).max() >= LARGEST:
            raise OverflowError("a scaled component is not under 2**26")
        x, n = x.reshape(len(x), self.parts, self.width), len(x)
        if self.round.first:
            near, upper, lower = (np.zeros((n, self.parts), np.int64) for _ in range(3))
        else:
            near, upper, lower = (np.frombuffer(b"".join(batch.column(k).to_pylist()), kind).reshape(n, self.parts).astype(np.int64) for k, kind in ((3, np.uint8), (4, np.uint32), (5, np.uint32)))
        self.round.assign(x, near, upper, lower)
        return x, near, upper, lower

    def add(self, x: np.ndarray, near: np.ndarray) -> None:
        for p in range(self.parts):
            self.sums[p, :, self.width] += np.bincount(near[:, p], minlength=self.entries)
            for d in range(self.width):
                self.sums[p, :, d] += np.bincount(near[:, p], x[:, p, d], self.entries).astype(np.int64)  # under 2**53 in a slice


def _round(round_: Round, dims: int, schema: StructType):
    """Vectors with their entries and bounds, and behind them a row of the task's sums alone."""
    names = schema.names
    arrow: list = []

    def run(batches):
        state = State(round_, dims)

        def step(batch):
            if not arrow:
                arrow.extend(batch.schema.field(k).type for k in range(2))
            x, near, upper, lower = state.assigned(batch)
            state.add(x, near)
            n = len(x)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(3)), constant(near.astype(np.uint8)), constant(upper.astype(np.uint32)), constant(lower.astype(np.uint32)), pa.nulls(n, pa.list_(pa.int64()))], names=names)

        def last():
            if arrow:
                yield pa.RecordBatch.from_arrays([*(pa.nulls(1, kind) for kind in arrow), *(pa.nulls(1, pa.binary()) for _ in range(4)), pa.array([state.sums.ravel().tolist()], pa.list_(pa.int64()))], names=names)

        yield from in_slices(step, last)(batches)

    return run


def _final(round_: Round, dims: int):
    def run(batches):
        state = State(round_, dims)

        def step(batch):
            x, near, _, _ = state.assigned(batch)
            error = sum(state.round.exact(x, near, p) for p in range(state.parts))
            text = near.astype(np.uint8).tobytes().hex()
            wide = 2 * state.parts
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([text[k : k + wide] for k in range(0, len(text), wide)], pa.string()), pa.array(error, pa.int64())], names=["vec_id", "label", "code", "error"])

        yield from in_slices(step)(batches)

    return run


def moved(books: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """Each entry becomes the floored mean of its parts; one without parts stays. sums: (parts, entries, components and a count)."""
    count = sums[:, :, -1:]
    return np.where(count > 0, sums[:, :, :-1] // np.maximum(count, 1), books)


def encoded(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> tuple[DataFrame, np.ndarray]:
    """vec_id, label, code (two hex digits an entry's index, in part order) and error (squared distances of the integers, summed over parts) of every valid row; and the codebooks (parts, entries, components)."""
    assert 0 < entries <= 256
    spark = vectors.sparkSession
    table = stored(integers(vectors, scale, {"vec_id": F.col("vec_id").cast("long"), "label": F.col("label")}), "part-vectors")
    kinds = table.schema
    dims = dimension(table)
    if not dims:
        empty = StructType([kinds["vec_id"], kinds["label"], StructField("code", StringType()), StructField("error", LongType())])
        return spark.createDataFrame([], empty), np.empty((parts, 0, 0), np.int64)
    if dims % parts:
        raise ValueError(f"vectors of {dims} components cannot be cut into {parts} equal parts")
    first = table.orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(entries).collect()
    start = np.concatenate([unpacked(pa.array([bytes(r.x)], pa.binary()), dims) for r in first])
    books = start.reshape(len(first), parts, dims // parts).transpose(1, 0, 2).copy()
    schema = StructType([kinds["vec_id"], kinds["label"], StructField("x", BinaryType()), StructField("near", BinaryType()), StructField("upper", BinaryType()), StructField("lower", BinaryType()), StructField("sums", ArrayType(LongType()))])
    before, now = None, table.drop("dims")
    for k in range(rounds):
        made = stored(now.mapInArrow(_round(Round(books, before), dims, schema), schema), f"round-{k}")
        total = summed(made.where("sums is not null"))
        dropped(table)
        sums = np.array([total[i] for i in range(len(total))], np.int64).reshape(*books.shape[:2], -1)
        before, books, table = books, moved(books, sums), made
        now = made.where("sums is null").drop("sums")
    codes = stored(now.mapInArrow(_final(Round(books, before), dims), StructType([kinds["vec_id"], kinds["label"], StructField("code", StringType()), StructField("error", LongType())])), "codes")
    dropped(table)
    return codes, books


def codebooks_digest(books: np.ndarray) -> str:
    """SHA-256 of all entries' components in decimal, by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def code_digests(vectors: DataFrame, **how) -> DataFrame:
    """vec_id, code, error, label_error (error summed over the rows of the same label, null being one) and codebooks_sha256 of every valid row."""
    codes, books = encoded(vectors, **how)
    by_label = codes.groupBy("label").agg(F.sum("error").alias("label_error"))
    met = codes.alias("c").join(by_label.alias("s"), F.col("c.label").eqNullSafe(F.col("s.label")))
    return met.select("c.vec_id", "c.code", "c.error", "s.label_error", F.lit(codebooks_digest(books)).alias("codebooks_sha256"))
