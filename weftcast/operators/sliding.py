"""Order statistics of a window that slides over sorted rows, in memory of one window a task."""

from __future__ import annotations

import math
from bisect import bisect_left, insort
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import DoubleType, LongType, StructField, StructType


class Ordered:
    """A multiset of numbers with insertion, deletion and the k-th smallest, as blocks of sorted lists: each costs about the square root of its size."""

    def __init__(self, load: int = 512):
        self.load, self.blocks, self.tops, self.size = load, [], [], 0

    def add(self, v: float) -> None:
        self.size += 1
        if not self.blocks:
            self.blocks, self.tops = [[v]], [v]
            return
        k = min(bisect_left(self.tops, v), len(self.blocks) - 1)
        block = self.blocks[k]
        insort(block, v)
        self.tops[k] = block[-1]
        if len(block) > 2 * self.load:
            self.blocks[k : k + 1] = block[: self.load], block[self.load :]
            self.tops[k : k + 1] = block[self.load - 1], block[-1]

    def remove(self, v: float) -> None:
        k = bisect_left(self.tops, v)
        block = self.blocks[k]
        del block[bisect_left(block, v)]
        self.size -= 1
        if block:
            self.tops[k] = block[-1]
        else:
            del self.blocks[k], self.tops[k]

    def __getitem__(self, k: int) -> float:
        for block in self.blocks:
            if k < len(block):
                return block[k]
            k -= len(block)
        raise IndexError

    def quantile(self, level: float) -> float | None:
        """By a straight line between order statistics; None of nothing."""
        if not self.size:
            return None
        h = level * (self.size - 1)
        low = self[math.floor(h)]
        return low + (h - math.floor(h)) * (self[math.ceil(h)] - low)


def sliding_quantiles(rows: DataFrame, value: str, by: list[str], time: str, width: int, levels: dict[str, float], count: str, own: str, drop: list[str]) -> DataFrame:
    """Quantiles of ``value`` (without nulls and NaN) and the number of rows over (t - width, t] of an integer time, by ``by``; rows with ``own`` alone are returned, without the columns of ``drop``. Rows are sorted within partitions of ``by``; a task keeps the window of the key it is at, and the rows of one time until the next time comes."""
    columns = rows.columns
    keep = [c for c in columns if c not in drop]
    schema = StructType([*(rows.schema[c] for c in keep), *(StructField(n, DoubleType()) for n in levels), StructField(count, LongType())])
    at_time, at_value, at_own = (columns.index(c) for c in (time, value, own))
    at_keys = [columns.index(c) for c in by]

    def run(batches):
        key, window, inside, held = None, Ordered(), deque(), None

        def passed(batch: pa.RecordBatch):
            nonlocal key, window, inside
            t = batch.column(at_time).to_pylist()
            v = batch.column(at_value).to_pylist()
            keys = list(zip(*[batch.column(k).to_pylist() for k in at_keys]))
            out, sizes, a = [], [], 0
            while a < len(t):
                if keys[a] != key:
                    key, window, inside = keys[a], Ordered(), deque()
                b = a
                while b < len(t) and keys[b] == key and t[b] == t[a]:
                    some = v[b] is not None and v[b] == v[b]
                    inside.append((t[b], float(v[b]) if some else None))
                    if some:
                        window.add(float(v[b]))
                    b += 1
                while inside and inside[0][0] <= t[a] - width:
                    _, old = inside.popleft()
                    if old is not None:
                        window.remove(old)
                out += [[window.quantile(q) for q in levels.values()]] * (b - a)
                sizes += [len(inside)] * (b - a)
                a = b
            mask = batch.column(at_own)
            found = pa.RecordBatch.from_arrays([*(batch.column(columns.index(c)) for c in keep), *(pa.array([r[k] for r in out], pa.float64()) for k in range(len(levels))), pa.array(sizes, pa.int64())], names=schema.names)
            return found.filter(mask)

        for batch in batches:
            if not batch.num_rows:
                continue
            if held is not None:
                batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            last = tuple(batch.column(k)[-1].as_py() for k in (*at_keys, at_time))
            same = np.ones(batch.num_rows, bool)
            for k, x in zip((*at_keys, at_time), last):
                same &= np.array([y == x for y in batch.column(k).to_pylist()])
            cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
            held = batch.slice(cut)
            if cut:
                yield passed(batch.slice(0, cut))
        if held is not None:
            yield passed(held)

    return rows.repartition(*by).sortWithinPartitions(*by, time).mapInArrow(run, schema)
