"""Quality control of an observation log and of forecasts, as bit flags: 1 bounds, 2 spike, 4 flatline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BOUNDS, SPIKE, FLATLINE = 1, 2, 4
MINUTE = 60_000_000


def spike_flag(value: str, time: str, by: list[str], per_minute: float) -> Column:
    """A value that leaves both neighbours in one direction by more than the limit per minute, of one minute at least. time: microseconds."""
    w = Window.partitionBy(*by).orderBy(time, value)
    before, after = F.col(value) - F.lag(value).over(w), F.col(value) - F.lead(value).over(w)
    gap = lambda d: F.greatest(d / MINUTE, F.lit(1.0)) * per_minute
    out = (F.abs(before) > gap(F.col(time) - F.lag(time).over(w))) & (F.abs(after) > gap(F.lead(time).over(w) - F.col(time))) & (before * after > 0)
    return F.when(out, SPIKE).otherwise(0)


def with_flatline(df: DataFrame, value: str, time: str, by: list[str], minutes: float, gap_minutes: float, name: str = "flat", causal: bool = False) -> DataFrame:
    """Flags runs of one value that last ``minutes``; a run ends at another value, a null or a gap. causal: only from the moment at which the run has lasted as long."""
    w = Window.partitionBy(*by).orderBy(time, value)
    new = F.col(value).isNull() | F.lag(value).over(w).isNull() | (F.lag(value).over(w) != F.col(value)) | (F.col(time) - F.lag(time).over(w) > gap_minutes * MINUTE)
    runs = df.withColumn("__run", F.sum(F.when(new, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    run = Window.partitionBy(*by, "__run")
    last = F.col(time) if causal else F.max(time).over(run)
    lasting = (last - F.min(time).over(run) >= minutes * MINUTE) & F.col(value).isNotNull()
    return runs.withColumn(name, F.when(lasting, FLATLINE).otherwise(0)).drop("__run")


def checked(df: DataFrame, value: str, time: str, by: list[str], low: float, high: float, per_minute: float, flat_minutes: float, gap_minutes: float, causal: bool = False) -> DataFrame:
    """Adds ``qc``, the flags joined bit by bit; the causal form looks at the past alone and so knows no spikes. Nulls aren't flagged."""
    bounds = F.when((F.col(value) < low) | (F.col(value) > high), BOUNDS).otherwise(0)
    spike = F.lit(0) if causal else spike_flag(value, time, by, per_minute)
    out = with_flatline(df.withColumn("__spike", spike), value, time, by, flat_minutes, gap_minutes, "__flat", causal)
    return out.withColumn("qc", bounds.bitwiseOR(F.col("__spike")).bitwiseOR(F.col("__flat"))).drop("__spike", "__flat")


def masked(value: str, qc: str = "qc") -> Column:
    return F.when(F.col(qc) == 0, F.col(value))


def summary(df: DataFrame, by: list[str], value: str = "value", qc: str = "qc") -> DataFrame:
    """Samples, missing ones, each flag's count and clean ones."""
    bit = lambda b: F.count_if(F.col(qc).bitwiseAND(F.lit(b)) > 0)
    return df.groupBy(*by).agg(F.count("*").alias("samples"), F.count_if(F.col(value).isNull()).alias("missing"), bit(BOUNDS).alias("out_of_bounds"), bit(SPIKE).alias("spikes"), bit(FLATLINE).alias("flat"), F.count_if((F.col(qc) == 0) & F.col(value).isNotNull()).alias("clean"))


def cross_source_masked(df: DataFrame, cell: list[str], value: str, floor: float, least: int = 4, times: float = 5.0) -> DataFrame:
    """Nulls a source's value that is far from its cell's median: beyond ``times`` robust deviations and beyond ``floor``, in cells of ``least`` sources. Two grouped medians; the cell's rows meet once."""
    w = Window.partitionBy(*cell)
    dev = df.withColumn("__dev", F.abs(F.col(value) - F.median(value).over(w))).withColumn("__k", F.count(value).over(w))
    far = (F.col("__k") >= least) & (F.col("__dev") > F.greatest(times * 1.4826 * F.median("__dev").over(w), F.lit(float(floor))))
    return dev.withColumn("__far", far).withColumn(value, F.when(~F.coalesce("__far", F.lit(False)), F.col(value))).drop("__dev", "__k", "__far")
