"""Exact top-k search by inner product: the k-th score of each query is located in global histograms.

Components become integers, so scores are whole numbers. Queries go out in bounded groups; a group is a pass over all
candidates, scored in blocks by matrix products (in floats, as long as every score is exact in them). For a group:

1. Every task scores everything and counts, query by query, how many scores fall into each bin of the range that is left.
   It sends the bins from the top down to that in which it has seen as many scores as are wanted: the k-th score
   of all candidates can't lie under the k-th of some. The counts are added up, and the bin that holds the k-th
   score becomes the next range, until a bin is one number wide. Two or three rounds do.
2. A last pass keeps the scores over that number, fewer than k a query, and of those equal to it as many least
   ids as are still wanted, in each task. A window over these few rows ranks them.

So what travels is at most k bins or rows a query and task, however many candidates tie. The driver gets one group of
queries at a time and their ranges.

Rows whose vector is null, empty or holds null or non-finite components take no part. Rows with a null id are candidates and
come last among ties, but never ask. Rows that repeat are rows of their own: each asks, and each is a candidate of the others.
Fewer candidates than k are all returned; an empty table gives no rows. All vectors have one length, and
squared lengths over 2**53 once scaled are an error. Columns besides the two named aren't read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import session_dir, stored
from .vectors import dimension, in_slices, integers, unpacked

#: Queries of a group, about; they are the broadcast of a pass.
GROUP = 4096
#: Bins of a histogram, a power of two.
BINS = 512
#: Candidates that are scored together.
BLOCK = 1024


class Group:
    """A bounded number of queries: their rows and integer vectors."""

    def __init__(self, rows: np.ndarray, x: np.ndarray, longest: int):
        order = np.argsort(rows)
        self.rows, self.dims = rows[order], x.shape[1]
        self.kind = np.float32 if longest < 1 << 24 else np.float64
        self.x = np.ascontiguousarray(x[order].T.astype(self.kind))

    def scores(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        """For columns row and x: scores (candidates, queries), and which of them are a query's own row."""
        out = (unpacked(batch.column(1), self.dims).astype(self.kind) @ self.x).astype(np.int64)
        rows = batch.column(0).to_numpy()
        at = np.searchsorted(self.rows, rows)
        at[at == self.rows.size] = 0
        own = np.flatnonzero(self.rows[at] == rows)
        return out, own * self.rows.size + at[own]


def cut(counts: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Counts (queries, bins) that a task sends: bins from the top down to that in which it reaches ``wanted``; lower ones become 0."""
    above = np.cumsum(counts[:, ::-1], axis=1)[:, ::-1] - counts
    return np.where(above < wanted[:, None], counts, 0)


def _histograms(group, low: np.ndarray, shift: int, wanted: np.ndarray):
    """query (its place in the group), bin, count (a task's share) and how many scores are wanted."""

    def run(batches):
        own: Group = group.value
        n = own.rows.size
        counts = np.zeros(n * BINS, np.int64)

        def step(batch):
            for k in range(0, batch.num_rows, BLOCK):
                scores, mine = own.scores(batch.slice(k, BLOCK))
                bins = (scores - low) >> shift
                bins.ravel()[mine] = -1
                if shift and bins.min() >= -1 and bins.max() < BINS:
                    inside = (bins + np.arange(n) * BINS)[bins >= 0]
                else:
                    q = np.nonzero((bins >= 0) & (bins < BINS))
                    inside = bins[q] + q[1] * BINS
                counts[:] += np.bincount(inside, minlength=n * BINS)
            return ()

        def last():
            sent = cut(counts.reshape(n, BINS), wanted)
            q, b = np.nonzero(sent)
            if q.size:
                yield pa.RecordBatch.from_arrays([pa.array(q.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(sent[q, b]), pa.array(wanted[q])], names=["query", "bin", "count", "wanted"])

        yield from in_slices(step, last)(batches)

    return run


def first_of_each(group: np.ndarray, order: list[np.ndarray], most: np.ndarray) -> np.ndarray:
    """Indexes of the first ``most[g]`` members of each group g, by the keys of ``order``, the first being the main one."""
    at = np.lexsort([*order[::-1], group])
    g = group[at]
    start = np.flatnonzero(np.diff(g, prepend=-1))
    rank = np.arange(g.size) - np.repeat(start, np.diff(np.append(start, g.size)))
    return at[rank < most[g]]


def _winners(group, least: np.ndarray, ties: np.ndarray):
    """query, vec_id and score: all over ``least``, and of those equal to it the ``ties`` least ids a task."""

    def run(batches):
        own: Group = group.value
        n = own.rows.size
        held: list[tuple[np.ndarray, ...]] = []

        def fewer():
            q, ids, none, s = (np.concatenate(x) for x in zip(*held))
            tied = np.flatnonzero(s == least[q])
            few = tied[first_of_each(q[tied], [none[tied], ids[tied]], ties)]
            keep = np.concatenate([np.flatnonzero(s > least[q]), few])
            held[:] = [(q[keep], ids[keep], none[keep], s[keep])]

        def step(batch):
            for k in range(0, batch.num_rows, BLOCK):
                part = batch.slice(k, BLOCK)
                scores, mine = own.scores(part)
                flag = scores >= least
                flag.ravel()[mine] = False
                r, q = np.nonzero(flag)
                if r.size:
                    ids = part.column(2)
                    held.append((q, ids.fill_null(0).to_numpy()[r], ids.is_null().to_numpy(zero_copy_only=False)[r], scores[r, q]))
                    if sum(x[0].size for x in held) > 4 * n * int(ties.max(initial=1)) + 65536:
                        fewer()
            return ()

        def last():
            if held:
                fewer()
                q, ids, none, s = held[0]
                yield pa.RecordBatch.from_arrays([pa.array(own.rows[q]), pa.array(ids, pa.int64(), mask=none), pa.array(s)], names=["query", "vec_id", "score"])

        yield from in_slices(step, last)(batches)

    return run


def located(candidates: DataFrame, group, n: int, wanted: int, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """For each query of a group: the ``wanted``-th highest score, and how many of the scores equal to it belong to the result."""
    low, left = np.full(n, -longest, np.int64), np.full(n, wanted, np.int64)
    shift, per = 0, BINS.bit_length() - 1
    while (2 * longest) >> shift >= BINS:
        shift += per
    for_each = Window.partitionBy("query").orderBy(F.col("bin").desc())
    while True:
        parts = candidates.mapInArrow(_histograms(group, low, shift, left), "query int, bin int, count long, wanted long")
        totals = parts.groupBy("query", "bin").agg(F.sum("count").alias("count"), F.max("wanted").alias("wanted"))
        above = totals.withColumn("upto", F.sum("count").over(for_each)).withColumn("above", F.col("upto") - F.col("count"))
        found = above.where("above < wanted AND upto >= wanted").select("query", "bin", "above").collect()
        at = np.array([r.query for r in found])
        low[at] += np.array([r.bin for r in found], np.int64) << shift
        left[at] -= np.array([r.above for r in found], np.int64)
        if not shift:
            return low, left
        shift = max(shift - per, 0)


def top_k(vectors: DataFrame, asks: Column, k: int = 5, scale: int = 256) -> DataFrame:
    """query_id, rank, vec_id and score of the k best candidates of each row for which ``asks`` (an expression over vec_id) holds."""
    spark = vectors.sparkSession
    vec_id = F.col("vec_id").cast("long")
    prepared = integers(vectors, scale, {"vec_id": vec_id})

    def length(batches):
        for batch in batches:
            dims = batch.column(2).to_numpy()
            x = unpacked(batch.column(1), int(dims[0])) if batch.num_rows else np.empty((0, 0), np.int64)
            yield batch.append_column("longest", pa.array((x.astype(np.float64) ** 2).sum(axis=1)))

    table = stored(prepared.mapInArrow(length, "vec_id long, x binary, dims long, longest double").withColumn("row", F.monotonically_increasing_id()).withColumn("asks", F.coalesce(asks, F.lit(False))), "search-vectors")
    empty = "query_id long, rank int, vec_id long, score long"
    dims = dimension(table)
    rows, asking, longest = table.agg(F.count("*"), F.count_if("asks"), F.max("longest")).first()
    wanted = min(k, rows - 1)
    if not asking or wanted < 1:
        return spark.createDataFrame([], empty)
    if longest >= 2.0**53:
        raise OverflowError("a squared length is not under 2**53")
    groups = -(-asking // GROUP)
    queries = table.where("asks").withColumn("group", F.pmod(F.xxhash64("row"), F.lit(groups)))
    candidates = table.select("row", "x", "vec_id")
    path = f"{session_dir(spark)}/winners-{spark.sparkContext.applicationId}-{id(table)}"
    for g in range(groups):
        mine = queries.where(F.col("group") == g).select("row", "x").collect()  # about GROUP rows
        if not mine:
            continue
        own = Group(np.array([r.row for r in mine]), unpacked(pa.array([bytes(r.x) for r in mine], pa.binary()), dims), int(longest))
        sent = spark.sparkContext.broadcast(own)
        least, ties = located(candidates, sent, own.rows.size, wanted, int(longest))
        candidates.mapInArrow(_winners(sent, least, ties), "query long, vec_id long, score long").write.mode("overwrite").parquet(f"{path}/part={g}")
        sent.destroy()
    found = spark.read.schema("query long, vec_id long, score long").parquet(path)
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    names = table.where("asks").select(F.col("row").alias("query"), F.col("vec_id").alias("query_id"))
    return ranked.join(names, "query").select("query_id", "rank", "vec_id", "score")
