"""Truth tables from a minute log: hourly, instantaneous, accumulated and daily."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import dew_point_c, local_date, local_day_minutes, sea_level_hpa

HOUR, MINUTE = 3_600_000_000, 60_000_000


def covered_mean(value: str, minute: Column, expected: Column | int, least: float) -> tuple[Column, Column]:
    """The mean and the coverage (distinct minutes with a value, over those expected); the mean is null below ``least``."""
    coverage = F.count_distinct(F.when(F.col(value).isNotNull(), minute)) / expected
    return F.when(coverage >= least, F.avg(value)), coverage


def hourly(df: DataFrame, by: list[str], value: str, us: str = "us", least: float = 0.8, expected: int = 60) -> DataFrame:
    mean, coverage = covered_mean(value, F.floor(F.col(us) / MINUTE), expected, least)
    return df.groupBy(*by, F.floor(F.col(us) / HOUR).cast("long").alias("hour")).agg(mean.alias("mean"), coverage.alias("coverage"), F.max(value).alias("peak"))


def instantaneous(df: DataFrame, by: list[str], value: str, us: str = "us", near_minutes: int = 5, far_minutes: int = 10) -> DataFrame:
    """The mean around each full hour, within the nearer window or else the farther one."""
    off = F.abs(F.col(us) - F.col("hour") * HOUR)
    rows = df.withColumn("hour", F.floor((F.col(us) + HOUR // 2) / HOUR).cast("long")).withColumn("__off", off).where(F.col("__off") <= far_minutes * MINUTE)
    return rows.groupBy(*by, "hour").agg(F.coalesce(F.avg(F.when(F.col("__off") <= near_minutes * MINUTE, F.col(value))), F.avg(value)).alias("instant"))


def counter_deltas(df: DataFrame, by: list[str], counter: str, us: str = "us", max_gap_minutes: float = 10) -> DataFrame:
    """What a counter that may reset has gained since the row before. A fall below half is a reset, which credits the counter itself; else only what exceeds the epoch's maximum counts. Null for the first row and after a longer gap."""
    w = Window.partitionBy(*by).orderBy(us, counter)
    before = F.lag(counter).over(w)
    reset = df.withColumn("__before", before).withColumn("__gap", F.col(us) - F.lag(us).over(w)).withColumn("__reset", F.coalesce(F.col(counter) < 0.5 * before, F.lit(False)))
    epochs = reset.withColumn("__epoch", F.sum(F.col("__reset").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    high = F.max(counter).over(Window.partitionBy(*by, "__epoch").orderBy(us, counter).rowsBetween(Window.unboundedPreceding, -1))
    gained = F.when(F.col("__before").isNull() | (F.col("__gap") > max_gap_minutes * MINUTE), None).when(F.col("__reset"), F.col(counter)).otherwise(F.greatest(F.col(counter) - high, F.lit(0.0)))
    return epochs.withColumn("delta", gained).drop("__before", "__gap", "__reset", "__epoch")


def daily(df: DataFrame, by: list[str], value: str, ts: str, zone: str, least: float) -> DataFrame:
    """Extremes of a local calendar day, null where too few of its 1380, 1440 or 1500 minutes report."""
    day = df.withColumn("day", local_date(F.col(ts), zone))
    minute = F.floor(F.unix_micros(F.col(ts)) / MINUTE)
    out = day.groupBy(*by, "day").agg(F.max(value).alias("high"), F.min(value).alias("low"), F.count_distinct(F.when(F.col(value).isNotNull(), minute)).alias("minutes"))
    out = out.withColumn("coverage", F.col("minutes") / local_day_minutes(F.col("day"), zone))
    return out.select(*by, "day", *[F.when(F.col("coverage") >= least, F.col(c)).alias(c) for c in ("high", "low")], "coverage")


def canonical_minutes(df: DataFrame, channels: dict[str, tuple[str, str | None]], elevation_m: float, keep: list[str]) -> DataFrame:
    """Channels (their column and the column of their flags) as canonical variables, flagged samples null; the dew point and the pressure at sea level follow from what is left."""
    clean = {name: F.col(c) if flag is None else F.when(F.col(flag) == 0, F.col(c)) for name, (c, flag) in channels.items()}
    none = F.lit(None).cast("double")
    temp, humidity = clean.get("temp", none), clean.get("humidity", none)
    plain = {"wind_speed": "wind_speed_ms", "wind_gust": "wind_gust_ms", "rain_counter": "rain_counter_mm"}
    return df.select(*keep, temp.alias("temp_c"), humidity.alias("humidity_pct"), dew_point_c(temp, humidity).alias("dew_point_c"), *[clean.get(c, none).alias(n) for c, n in plain.items()], sea_level_hpa(clean.get("pressure_station", none), temp, elevation_m).alias("pressure_sea_hpa"))
