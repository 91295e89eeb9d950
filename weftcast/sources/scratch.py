"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. Where that is unset, a master within one process gets a temporary folder; on a cluster it is an error, as executors wouldn't see the driver's."""
    have = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not have:
        made = spark.sparkContext._jsc.sc().getCheckpointDir()
        have = made.get() if made.isDefined() else None
    if not have:
        if not spark.sparkContext._jsc.sc().isLocal():
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        have = "file://" + tempfile.mkdtemp(prefix="weftcast-")
        spark.conf.set("spark.checkpoint.dir", have)
    return have.rstrip("/")


_folders: dict[str, str] = {}


def session_dir(spark: SparkSession) -> str:
    """A folder of this application in the shared one; it goes when the driver ends."""
    app = spark.sparkContext.applicationId
    if app not in _folders:
        _folders[app] = path = f"{shared_dir(spark)}/weftcast-tables-{app}-{uuid.uuid4().hex[:8]}"

        def clear() -> None:
            with contextlib.suppress(Exception):  # the session may have ended before
                at = spark._jvm.org.apache.hadoop.fs.Path(path)
                at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)

        atexit.register(clear)
    return _folders[app]


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt over as many tasks as there are cores or shuffle partitions, the more of them, for steps whose work is more than their bytes tell."""
    spark = df.sparkSession
    return df.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), *keys)


def settled(df: DataFrame, what: str) -> DataFrame:
    """Writes a table there and reads it back: what several branches need is computed once, lineage ends, and lost executors cost nothing."""
    path = f"{session_dir(df.sparkSession)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
