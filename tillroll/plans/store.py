"""Intermediate tables in the shared folder, and their removal.

:func:`stored` writes a frame once and reads it back, which cuts the lineage:
after the loss of an executor only the table is read again. All tables of a
session lie in one folder below ``spark.checkpoint.dir``; :func:`release`
removes it, and the end of the session's JVM does so in any case.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession

from tillroll.session import ensure_checkpoint_dir

_FOLDERS: dict[str, str] = {}


def _remove_later(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)


def folder(spark: SparkSession) -> str:
    """The session's folder for intermediate tables (made by the first table)."""
    app = spark.sparkContext.applicationId
    if app not in _FOLDERS:
        _FOLDERS[app] = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tillroll-{uuid.uuid4().hex}"
        _remove_later(spark, _FOLDERS[app])
    return _FOLDERS[app]


def stored(df: DataFrame) -> DataFrame:
    """``df``, computed now, stored in the session's folder and read back."""
    path = f"{folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def observed(df: DataFrame, **figures: Column) -> tuple[DataFrame, dict]:
    """``df`` stored as by :func:`stored`, and aggregates of it taken while it was written."""
    seen = Observation(uuid.uuid4().hex)
    out = stored(df.observe(seen, *[v.alias(k) for k, v in figures.items()]))
    return out, seen.get


def remove(spark: SparkSession, path: str) -> None:
    """Remove a folder that a caller made below :func:`folder`."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def release(spark: SparkSession) -> None:
    """Remove the session's intermediate tables; frames that read them become invalid."""
    path = _FOLDERS.pop(spark.sparkContext.applicationId, None)
    if path:
        remove(spark, path)
