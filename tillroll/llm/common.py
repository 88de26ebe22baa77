"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.session import ensure_checkpoint_dir

#: The six ASCII white-space characters that separate words.
SPACE = r"[\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\f\r"
#: Rows of fixed width that may be broadcast (about 100 bytes each: 20 MB).
BROADCAST_ROWS = 200_000


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once.

    The value is bound as a lambda variable, so neither column collapsing
    nor lambda bodies that mention it repeatedly evaluate it again.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    """Words of a text as an array; a null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def word_count(text: Column) -> Column:
    """Number of words (long), without building the filtered array."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE_CHARS))
    return let(bare, lambda t: F.when(t == "", F.lit(0)).otherwise(
        F.size(F.split(t, SPACE)))).cast("long")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, prefixed until none of them clashes with a column of ``df``."""
    taken, prefix = {c.lower() for c in df.columns}, "_"
    while any((prefix + n).lower() in taken for n in names):
        prefix += "_"
    return [prefix + n for n in names]


def scratch(spark: SparkSession) -> str:
    """A new folder below the shared checkpoint folder, removed when the session's JVM ends."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def stored(df: DataFrame, path: str | None = None) -> DataFrame:
    """``df`` written once as a table in the shared folder and read back.

    Cuts the lineage: a lost executor costs a re-read of the table only.
    """
    spark = df.sparkSession
    path = path or scratch(spark)
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df``, a stored table of narrow rows, marked for broadcast if its counted rows allow.

    Beyond ``rows`` it is returned as it is, and the join shuffles.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
