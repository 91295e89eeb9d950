"""Exact nearest neighbours under a distance over what both have, with blocks that are skipped.

Vectors have gaps; the distance of two is the root mean square of their differences over the places both have, and nothing
without such a place. Rows of a pool are sorted over the cluster by which places they have and by their mean, and cut into blocks with a
box (least and largest value at each place). Two boxes bound the distance of all their rows from below. First every block of
queries meets the nearest blocks that have enough rows; that gives each query a k-th distance so far. Then it meets those of the
rest whose bound doesn't exceed the largest of these, and the k best are merged. No task holds a pool, on either side.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import settled

BLOCK = "pool string, block long, n int, places array<boolean>, low array<double>, high array<double>, z binary, ids binary, y binary"


def blocks(rows: DataFrame, size: int) -> DataFrame:
    """rows: pool, id (long), z (array of doubles, null where missing), y. A row a block, of at most ``size`` rows of one pool that have the same places."""
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    have = F.array_join(F.transform("z", lambda v: F.when(v.isNull(), "0").otherwise("1")), "")
    total = F.aggregate(F.transform("z", lambda v: F.coalesce(v, F.lit(0.0))), F.lit(0.0), lambda a, v: a + v)
    order = rows.select("pool", have.alias("places"), (total / F.greatest(F.lit(1), F.size(F.filter("z", lambda v: v.isNotNull())))).alias("mean"), "id", "z", "y")
    ordered = order.repartitionByRange(parts, "pool", "places", "mean", "id").sortWithinPartitions("pool", "places", "mean", "id")

    def cut(batches):
        part, number = TaskContext.get().partitionId(), 0
        for batch in batches:
            pools, places = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            a = 0
            while a < len(pools):
                b = a
                while b < len(pools) and b - a < size and (pools[b], places[b]) == (pools[a], places[a]):
                    b += 1
                z = np.array(batch.column(4).slice(a, b - a).flatten().to_numpy(zero_copy_only=False), float).reshape(b - a, -1)
                there = np.array([c == "1" for c in places[a]])
                box = [np.where(there, f(np.where(there, z, 0.0), axis=0), 0.0).tolist() for f in (np.min, np.max)]
                ids, y = (batch.column(k).slice(a, b - a).to_numpy(zero_copy_only=False) for k in (3, 5))
                yield pa.RecordBatch.from_pylist([{"pool": pools[a], "block": part << 32 | number, "n": b - a, "places": there.tolist(), "low": box[0], "high": box[1], "z": np.nan_to_num(z).tobytes(), "ids": np.asarray(ids, np.int64).tobytes(), "y": np.asarray(y, float).tobytes()}], _SCHEMA)
                number, a = number + 1, b

    return settled(ordered.mapInArrow(cut, BLOCK), "blocks")


_SCHEMA = pa.schema([("pool", pa.string()), ("block", pa.int64()), ("n", pa.int32()), ("places", pa.list_(pa.bool_())), ("low", pa.list_(pa.float64())), ("high", pa.list_(pa.float64())), ("z", pa.binary()), ("ids", pa.binary()), ("y", pa.binary())])


def bounded(queries: DataFrame, candidates: DataFrame) -> DataFrame:
    """Every two blocks of a pool that share a place, and a bound under the distances of their rows. Only boxes meet."""
    box = lambda df, t: df.select("pool", F.col("block").alias(t), F.col("n").alias(f"{t}_n"), F.arrays_zip("places", "low", "high").alias(f"{t}_box"))
    both = box(queries, "q").join(box(candidates, "c"), "pool")
    gaps = F.filter(F.zip_with("q_box", "c_box", lambda a, b: F.when(a["places"] & b["places"], F.greatest(F.lit(0.0), a["low"] - b["high"], b["low"] - a["high"]))), lambda g: g.isNotNull())
    square = F.aggregate(F.transform(gaps, lambda g: g * g), F.lit(0.0), lambda a, v: a + v) / F.size(gaps)
    return both.withColumn("shared", F.size(gaps)).where("shared > 0").select("pool", "q", "c", "c_n", F.sqrt(square).alias("bound"))


def met(pairs: DataFrame, queries: DataFrame, candidates: DataFrame, k: int) -> DataFrame:
    """q, id, other, distance and y of the k best candidates of each query in each pair of blocks."""
    left = queries.select(F.col("block").alias("q"), F.col("places").alias("q_places"), F.col("z").alias("q_z"), F.col("ids").alias("q_ids"))
    right = candidates.select(F.col("block").alias("c"), F.col("places").alias("c_places"), F.col("z").alias("c_z"), F.col("ids").alias("c_ids"), "y")
    rows = pairs.select("q", "c").join(left, "q").join(right, "c")

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                both = np.array(r["q_places"]) & np.array(r["c_places"])
                width = both.size
                mine = np.frombuffer(r["q_z"]).reshape(-1, width)[:, both]
                others = np.frombuffer(r["c_z"]).reshape(-1, width)[:, both]
                ids, names, y = np.frombuffer(r["q_ids"], np.int64), np.frombuffer(r["c_ids"], np.int64), np.frombuffer(r["y"])
                distance = np.sqrt(((mine[:, None, :] - others[None, :, :]) ** 2).sum(axis=2) / both.sum())
                if len(names) > k:
                    # All that tie with the k-th stay until ids decide.
                    kth = np.partition(distance, k - 1, axis=1)[:, k - 1 : k]
                    at, pick = np.nonzero(distance <= kth)
                    order = np.lexsort((names[pick], distance[at, pick], at))
                    at, pick = at[order], pick[order]
                    rank = np.arange(at.size) - np.searchsorted(at, at)
                    at, pick = at[rank < k], pick[rank < k]
                else:
                    at, pick = (x.ravel() for x in np.indices(distance.shape))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(at.size, r["q"])), pa.array(ids[at]), pa.array(names[pick]), pa.array(distance[at, pick]), pa.array(y[pick])], names=["q", "id", "other", "distance", "y"])

    return rows.mapInArrow(run, "q long, id long, other long, distance double, y double")


def best(found: DataFrame, k: int) -> DataFrame:
    """Of each query the k nearest, ties by id."""
    order = Window.partitionBy("q", "id").orderBy("distance", "other")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def nearest(queries: DataFrame, candidates: DataFrame, k: int, size: int = 1024) -> tuple[DataFrame, DataFrame]:
    """id, other, distance, y and rank of the k nearest candidates in each query's pool; and the pairs of blocks with ``seen``, whether they met."""
    q, c = blocks(queries, size), blocks(candidates, size)
    pairs = settled(bounded(q, c), "block-pairs")
    near = Window.partitionBy("q").orderBy("bound", "c")
    before = F.coalesce(F.sum("c_n").over(near.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = pairs.withColumn("first", before < k)
    one = settled(met(first.where("first"), q, c, k), "first-met")
    reach = best(one, k).groupBy("q", "id").agg(F.count("*").alias("n"), F.max("distance").alias("far")).groupBy("q").agg(F.when(F.min("n") < k, F.lit(float("inf"))).otherwise(F.max("far")).alias("far"))
    # A query of the block may share no place with the first blocks; then its block hasn't k of its own yet, and all meet.
    rest = first.where("not first").join(reach, "q", "left").withColumn("seen", F.col("bound") <= F.coalesce("far", F.lit(float("inf"))) * (1 + 1e-9) + 1e-12)
    two = met(rest.where("seen"), q, c, k)
    seen = first.where("first").select("q", "c", F.lit(True).alias("seen")).unionByName(rest.select("q", "c", "seen"))
    return best(one.unionByName(two), k).drop("q"), seen
