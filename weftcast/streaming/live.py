"""The same semantics on streams: truth after its clock, snapshots, newest forecasts, running bias and e-values."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def hourly_truth(log: DataFrame, time: str = "ts", value: str = "value", late: str = "2 hours") -> DataFrame:
    """Hourly means of a stream, given out once the truth clock has passed: the watermark is the clock's delay."""
    return log.withWatermark(time, late).groupBy(F.window(time, "1 hour").alias("w")).agg(F.avg(value).alias("mean"), F.max(value).alias("peak"), F.count(value).alias("n")).select(F.col("w.start").alias("valid"), "mean", "peak", "n")


def snapshot_times(runs: DataFrame, time: str = "completed", slot: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """The last completion of each slot."""
    return runs.withWatermark(time, late).groupBy(F.window(time, slot)).agg(F.max(time).alias("issue")).select("issue")


def newest(forecasts: DataFrame, keys: list[str], order: str, late: str = "1 day") -> DataFrame:
    """Of rows with equal keys the one fetched last (a built-in deduplication would keep the first); for update or complete output."""
    rest = [c for c in forecasts.columns if c not in keys]
    return forecasts.withWatermark(order, late).groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("r")).select(*keys, "r.*")


def running_bias(errors: DataFrame, key: str, order: str = "ts", error: str = "e", rate: float = 0.05) -> DataFrame:
    """An exponentially weighted bias for each key, carried as state; rows of a batch are taken in time order."""

    def step(k, batches: Iterator[pd.DataFrame], state: GroupState):
        bias, n = state.get if state.exists else (0.0, 0)
        for e in pd.concat(list(batches)).sort_values(order)[error]:
            bias, n = (1 - rate) * bias + rate * float(e), n + 1
        state.update((bias, n))
        yield pd.DataFrame({"key": [str(k[0])], "bias": [bias], "n": [n]})

    return errors.groupBy(key).applyInPandasWithState(step, "key string, bias double, n long", "bias double, n long", "update", GroupStateTimeout.NoTimeout)


def e_values(differences: DataFrame, key: str, order: str = "ts", difference: str = "d") -> DataFrame:
    """The bettor's wealth for each key, carried as state; a row at or before the cursor has been counted and is passed over."""
    step_rate = 2 / (2 - math.log(3))

    def step(k, batches: Iterator[pd.DataFrame], state: GroupState):
        wealth, bet, weight, scale, cursor = state.get if state.exists else (1.0, 0.1, 1.0, 0.0, -(1 << 62))
        for t, x in pd.concat(list(batches)).sort_values(order)[[order, difference]].itertuples(index=False):
            at = pd.Timestamp(t).value // 1000
            if at <= cursor:
                continue
            z = max(-1.0, min(1.0, x / scale)) if scale else float((x > 0) - (x < 0))
            wealth *= 1 + bet * z
            grad = -z / (1 + bet * z)
            weight += grad * grad
            bet, scale, cursor = min(0.5, max(0.0, bet - step_rate * grad / weight)), max(scale, abs(x)), at
        state.update((wealth, bet, weight, scale, cursor))
        yield pd.DataFrame({"key": [str(k[0])], "e_value": [wealth]})

    return differences.groupBy(key).applyInPandasWithState(step, "key string, e_value double", "wealth double, bet double, weight double, scale double, cursor long", "update", GroupStateTimeout.NoTimeout)


def history_sink(rows: DataFrame, path: str, checkpoint: str):
    """Appends served rows to Parquet, exactly once."""
    return rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
