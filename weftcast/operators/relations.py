"""Joins and set operations that evaluation needs beyond the built-in ones."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def common_cases(scores: DataFrame, case: list[str], member: str = "method") -> DataFrame:
    """The rows of cases that every member has scored."""
    everyone = scores.select(member).distinct().agg(F.count("*").alias("__all"))
    whole = scores.groupBy(*case).agg(F.count_distinct(member).alias("__k")).crossJoin(F.broadcast(everyone)).where("__k = __all").select(*case)  # one row
    return scores.join(whole, case, "left_semi")


def novel(rows: DataFrame, ledger: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys the ledger doesn't hold; null equals null."""
    same = reduce(lambda a, b: a & b, [rows[k].eqNullSafe(ledger[k]) for k in keys])
    return rows.join(ledger, same, "left_anti")


def pruned(ledger: DataFrame, time: str, now: int, age: int, keep: int | None = None) -> DataFrame:
    """Rows no older than ``age`` (a null time stays), of these the newest ``keep``, or all where that is None."""
    young = ledger.where(F.col(time).isNull() | (F.col(time) >= now - age))
    return young if keep is None else young.orderBy(F.desc_nulls_last(time)).limit(keep)


def merged_long(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Both tables' rows, columns joined by name; of equal keys the newer table's."""
    both = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)), allowMissingColumns=True)
    rest = [c for c in both.columns if c not in (*keys, "__new")]
    return both.groupBy(*keys).agg(F.max_by(F.struct(*rest), "__new").alias("__r")).select(*keys, "__r.*")


def funnel(spine_keys: list[str], layers: dict[str, DataFrame]) -> DataFrame:
    """The keys of all layers with each layer's columns."""
    spine = reduce(lambda a, b: a.union(b), [df.select(*spine_keys) for df in layers.values()]).distinct()
    for name, df in layers.items():
        spine = spine.join(df.select(*spine_keys, *[F.col(c).alias(f"{name}_{c}") for c in df.columns if c not in spine_keys]), spine_keys, "left")
    return spine
