"""Vector columns inside a task: valid rows as matrices, integers packed into binary columns."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

#: Rows that are taken together in numpy.
SLICE = 4096


def finite(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The indexes of the rows whose vector is neither null nor empty and holds neither nulls nor non-finite components, and their vectors as a matrix of doubles."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    size = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten()
    values = flat.to_numpy(zero_copy_only=False).astype(np.float64)  # nulls become NaN
    bad = np.zeros(values.size + 1, np.int64)
    np.cumsum(~np.isfinite(values), out=bad[1:])
    at = np.zeros(size.size + 1, np.int64)
    np.cumsum(size, out=at[1:])
    good = (size > 0) & (bad[at[1:]] == bad[at[:-1]])
    rows = np.flatnonzero(good)
    if not rows.size:
        return rows, np.empty((0, 0))
    if (size[rows] != size[rows[0]]).any():
        raise ValueError("vectors of several lengths in one table")
    return rows, values[np.repeat(good, size)].reshape(rows.size, -1)


def floors(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) as 64-bit integers. Like an overflow in Spark's ANSI arithmetic, a component that doesn't fit is an error."""
    out = np.floor(x * float(scale))
    if out.size and np.abs(out).max() >= 2.0**62:
        raise OverflowError("a scaled component does not fit 62 bits")
    return out.astype(np.int64)


def packed(x: np.ndarray) -> pa.Array:
    """Each row of a matrix of integers as bytes, two, four or eight for each by what the row needs: equal rows have equal bytes."""
    if not x.size:
        return pa.array([b""] * len(x), pa.binary())
    low, high = x.min(axis=1), x.max(axis=1)
    width = np.where((low >= -(2**15)) & (high < 2**15), 2, np.where((low >= -(2**31)) & (high < 2**31), 4, 8))
    if (width == width[0]).all():
        data = x.astype(f"<i{width[0]}").tobytes()
        at = np.arange(len(x) + 1, dtype=np.int64) * int(width[0]) * x.shape[1]
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(x), [None, pa.py_buffer(at), pa.py_buffer(data)]).cast(pa.binary())
    return pa.array([row.astype(f"<i{w}").tobytes() for row, w in zip(x, width.tolist())], pa.binary())


def unpacked(column: pa.Array, dims: int) -> np.ndarray:
    """The matrix that ``packed`` made, as 64-bit integers."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(column):
        return np.empty((0, dims), np.int64)
    _, offsets, data = column.buffers()
    big = pa.types.is_large_binary(column.type)
    at = np.frombuffer(offsets, np.int64 if big else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)
    width = np.diff(at) // dims
    out = np.empty((len(column), dims), np.int64)
    for w in np.unique(width).tolist():
        rows = np.flatnonzero(width == w)
        one = data[at[0] : at[-1]] if rows.size == len(column) else np.concatenate([data[at[r] : at[r + 1]] for r in rows.tolist()])
        out[rows] = one.view(f"<i{w}").reshape(rows.size, dims)
    return out


def constant(rows: np.ndarray) -> pa.Array:
    """Rows of one matrix of any type as bytes of one length."""
    rows = np.ascontiguousarray(rows)
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(max(rows.dtype.itemsize * rows.shape[1], 1)), len(rows), [None, pa.py_buffer(rows.tobytes())]).cast(pa.binary())


def integers(vectors: DataFrame, scale: int, keep: dict[str, Column], column: str = "embedding") -> DataFrame:
    """The columns ``keep`` of the valid rows, ``x`` (the vector's components times ``scale``, floored and packed) and ``dims``."""
    names = list(keep)
    chosen = vectors.select(*[c.alias(n) for n, c in keep.items()], F.col(column).alias("vector"))
    schema = StructType([*[chosen.schema[n] for n in names], StructField("x", BinaryType()), StructField("dims", LongType())])

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                rows, values = finite(part.column(len(names)))
                if rows.size:
                    own = part.take(pa.array(rows))
                    x = floors(values, scale)
                    yield pa.RecordBatch.from_arrays([*(own.column(k) for k in range(len(names))), packed(x), pa.array(np.full(rows.size, x.shape[1]))], names=[*names, "x", "dims"])

    return chosen.mapInArrow(run, schema)


def dimension(prepared: DataFrame) -> int:
    """The one length of all vectors, 0 for none."""
    low, high = prepared.agg(F.min("dims"), F.max("dims")).first()
    if low != high:
        raise ValueError(f"vectors of several lengths in one table: {low} and {high}")
    return int(low or 0)


def summed(parts: DataFrame) -> dict[int, int]:
    """The sums of the column ``sums`` (arrays of one length a task or so), place by place."""
    places = parts.select(F.posexplode("sums").alias("place", "value")).groupBy("place").agg(F.sum("value").alias("total"))
    return {r.place: r.total for r in places.collect()}


def in_slices(step: Callable, last: Callable | None = None):
    """A function for mapInArrow: ``step`` for every slice of a batch, ``last`` once a task has seen all its rows."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                yield from step(batch.slice(at, SLICE))
        if last is not None:
            yield from last()

    return run
