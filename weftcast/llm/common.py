"""Tables and shared storage of the text operators."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns of the documents table.
DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a master within one process gets a temporary folder, as in tests; a cluster has none that all its machines see, so that is an error."""
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


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a folder, in whatever file system it is."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


_session_dirs: dict[str, str] = {}


def session_dir(spark: SparkSession) -> str:
    """This application's own folder in the shared one, which goes when the driver ends."""
    app = spark.sparkContext.applicationId
    if app not in _session_dirs:
        _session_dirs[app] = path = f"{shared_dir(spark)}/weftcast-{app}-{uuid.uuid4().hex[:8]}"

        def clear() -> None:
            with contextlib.suppress(Exception):  # the session may have ended before
                removed(spark, path)

        atexit.register(clear)
    return _session_dirs[app]


def stored(df: DataFrame, what: str, partition_by: list[str] | None = None) -> DataFrame:
    """Writes a table into the shared folder and reads it back: lineage ends there and lost executors cost nothing."""
    path = f"{session_dir(df.sparkSession)}/{what}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def dropped(df: DataFrame) -> None:
    """Deletes a table that ``stored`` has made, once nothing reads it any more."""
    removed(df.sparkSession, df._stored_at)


def docs_of(docs: DataFrame) -> DataFrame:
    """doc_id and text alone: other columns, whatever their names, never meet those an operator adds."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def as_rows(docs: DataFrame) -> DataFrame:
    """doc_id, text and ``row``, a struct of all columns as they were: whatever their names, none meets those a join adds. ``row.*`` gives them back."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"))


def fold(column: Column, parts: int) -> Column:
    """crc32 of an identifier's decimal text, modulo ``parts``."""
    return F.crc32(column.cast("string").cast("binary")) % F.lit(parts)


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
