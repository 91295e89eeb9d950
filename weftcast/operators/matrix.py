"""Leakage-safe matrices: snapshots, as-of selection, replication, folds. The canonical form is long: one row a source, issue and valid hour."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import lead_bucket
from .temporal import asof_join


#: Sources, and other keys of which every row gets all, that may stand in a plan as a list.
FEW = 1000


def with_each(df: DataFrame, keys: DataFrame, name: str) -> DataFrame:
    """Every row with every distinct value of ``name``: a list in the plan if there are at most FEW values, else a join that Spark plans."""
    values = [r[0] for r in keys.select(name).distinct().limit(FEW + 1).collect()]
    if len(values) > FEW:
        return df.crossJoin(keys.select(name).distinct())
    kind = dict(keys.dtypes)[name]
    return df.withColumn(name, F.explode(F.array(*[F.lit(v).cast(kind) for v in values]))) if values else df.withColumn(name, F.lit(None).cast(kind)).limit(0)


def as_of_selection(snapshots: DataFrame, cycles: DataFrame, cap: int) -> DataFrame:
    """issue, source, fetched: for every snapshot and source the newest cycle at or before it, ``cap`` old at most; a source without one is left out. The grid is no larger than its answer."""
    grid = with_each(snapshots.select("issue"), cycles, "source")
    found = asof_join(grid, cycles.select("source", "fetched").distinct(), "issue", "fetched", ["source"], cap, ["fetched"])
    return found.where("fetched is not null")


def matrix(selection: DataFrame, forecasts: DataFrame, truth: DataFrame, bucket=lead_bucket) -> DataFrame:
    """issue, valid, lead, bucket, source, x, y (null where the truth isn't known); no negative leads."""
    rows = selection.join(forecasts, ["source", "fetched"]).where("valid >= issue").withColumn("lead", F.col("valid") - F.col("issue"))
    return rows.join(truth, "valid", "left").withColumn("bucket", bucket(F.col("lead"))).where("bucket is not null").select("issue", "valid", "lead", "bucket", "source", "x", "y", "fetched")


def fold_origins(rows: DataFrame, initial: int, step: int, issue: str = "issue") -> list[int]:
    """Rolling origins from the first issue + ``initial`` on, before the last issue."""
    low, high = rows.agg(F.min(issue), F.max(issue)).first()
    return [] if low is None else list(range(low + initial, high, step))


def folded(rows: DataFrame, origins: list[int], inside) -> DataFrame:
    """Rows once for each fold whose origin satisfies ``inside``; folds are a short list, so they are exploded from an array and nothing is joined."""
    fold = F.struct(*[]) if not origins else F.array(*[F.struct(F.lit(k).alias("fold"), F.lit(o).cast("long").alias("origin")) for k, o in enumerate(origins)])
    if not origins:
        return rows.withColumn("fold", F.lit(None).cast("int")).limit(0)
    return rows.withColumn("__f", F.explode(F.filter(fold, lambda f: inside(f["origin"])))).withColumn("fold", F.col("__f.fold")).drop("__f")


def train_test(rows: DataFrame, origins: list[int], step: int, delay: int = 2, window: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Training rows of a fold have truth known (``delay`` after it is valid) by its origin, and with a rolling ``window`` issues after its start; test rows have issues in (origin, origin + step]."""
    some = rows.where("y is not null")

    def known(o: Column) -> Column:
        old = F.col("valid") + delay <= o
        return old if window is None else old & (F.col("issue") > o - window)

    return folded(some, origins, known), folded(some, origins, lambda o: (F.col("issue") > o) & (F.col("issue") <= o + step))
