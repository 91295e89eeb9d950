"""Metrics of a job, taken while it runs, and where they are kept.

The metrics are aggregates that Spark computes as rows pass (``Observation``), so serving isn't read twice. What is
known of the newest run of each identity is one file; runs of methods with a trajectory are also appended to a history. Writing them never
fails the job that they are of.
"""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

SNAPSHOT = "method string, product string, variable string, issue long, captured double, metrics map<string,string>"


def measured(df: DataFrame, write: Callable[[DataFrame], None], metrics: dict[str, Column], identity: dict, folder: str | None, trajectory: bool = False, now: float | None = None, days: int = 90) -> dict:
    """Runs ``write`` on ``df`` and returns the metrics of the rows that it wrote. identity: method, product, variable, issue. They are kept in ``folder``; an error there is dropped, one of ``write`` is not. A method without metrics leaves nothing."""
    if not metrics:
        write(df)
        return {}
    observation = Observation()
    write(df.observe(observation, *[c.alias(n) for n, c in metrics.items()]))
    got = observation.get
    if folder is not None:
        try:
            _keep(df.sparkSession, folder, identity, got, trajectory, time.time() if now is None else now, days)
        except Exception:  # telemetry alone; the job has succeeded
            pass
    return got


def _keep(spark: SparkSession, folder: str, identity: dict, metrics: dict, trajectory: bool, now: float, days: int) -> None:
    row = (identity["method"], identity["product"], identity["variable"], identity["issue"], now, {k: json.dumps(v, default=str) for k, v in metrics.items()})
    one = spark.createDataFrame([row], SNAPSHOT).coalesce(1)
    name = hashlib.sha256(json.dumps([row[0], row[1], row[2]]).encode()).hexdigest()[:16]
    one.write.mode("overwrite").parquet(f"{folder}/latest/of={name}")
    if trajectory:
        day = int(now // 86_400)
        one.write.mode("append").parquet(f"{folder}/history/day={day}")
        _pruned(spark, f"{folder}/history", day - days)


def _pruned(spark: SparkSession, path: str, oldest: int) -> None:
    """Days before ``oldest`` go; a day is a folder, so nothing is rewritten."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    for status in files.listStatus(at):
        name = status.getPath().getName()
        if name.startswith("day=") and int(name[4:]) < oldest:
            files.delete(status.getPath(), True)


def _read(spark: SparkSession, path: str) -> DataFrame:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], SNAPSHOT)
    return spark.read.schema(SNAPSHOT).parquet(path)


def snapshots(spark: SparkSession, folder: str) -> DataFrame:
    """The newest run of each method, product and variable."""
    return _read(spark, f"{folder}/latest").select("method", "product", "variable", "issue", "captured", "metrics")


def trajectories(spark: SparkSession, folder: str) -> DataFrame:
    """All kept runs of methods with a trajectory."""
    return _read(spark, f"{folder}/history").select("method", "product", "variable", "issue", "captured", "metrics")


def metric(name: str) -> Column:
    """A number out of a run's metrics."""
    return F.col("metrics")[name].cast("double")
