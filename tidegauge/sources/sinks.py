"""Sinks: frames as Parquet, logs as JSON lines, runs by id, fitted pipelines."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


_OWN: dict[str, str] = {}


def workspace(spark: SparkSession, label: str) -> str:
    """A new path in the folder of spark.checkpoint.dir, which driver and executors share. Where it is unset, a local session gets a folder of its own; on a cluster that is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        context = spark.sparkContext
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        if context.applicationId not in _OWN:
            _OWN[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="spark-")
        root = _OWN[context.applicationId]
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def write_frame(df: DataFrame, path: str, by: list[str] | None = None) -> DataFrame:
    """df as Parquet, divided by columns if named, and read again with df's columns and types, so an empty table comes back as it was."""
    writer = df.write.mode("overwrite").option("compression", "zstd")
    (writer.partitionBy(*by) if by else writer).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).select(*df.columns)


def written(df: DataFrame, label: str) -> DataFrame:
    """df as a table in the workspace, read again: for frames that are read several times, or whose row numbers must stay."""
    return write_frame(df, workspace(df.sparkSession, label))


def write_bucketed(df: DataFrame, path: str, entity: list[str], buckets: int, by: list[str] | None = None) -> DataFrame:
    """df as Parquet divided by columns and by bucket, a hash of the entity, so that one entity's rows are read from one folder; each bucket is one file a task writes."""
    rows = df.withColumn("bucket", F.pmod(F.xxhash64(*entity), F.lit(buckets)).cast("int"))
    return write_frame(rows.repartition(buckets, "bucket"), path, [*(by or []), "bucket"])


def append_log(df: DataFrame, path: str) -> None:
    """df's rows, appended as JSON lines; rows there stay."""
    df.write.mode("append").json(path)


def write_run(predictions: DataFrame, calibration: DataFrame, path: str, run_id: str) -> None:
    """A run's frames under its id; other runs stay."""
    for name, df in (("predictions", predictions), ("calibration", calibration)):
        df.withColumn("run_id", F.lit(run_id)).write.mode("append").partitionBy("run_id").parquet(f"{path}/{name}")
