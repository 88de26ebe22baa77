"""Raw sources: read yearly extracts with an explicit schema, stack them
and normalise header names (O02)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillroll.schema import RAW_SCHEMA


def normalize_name(name: str) -> str:
    """Header → column name: trim, lower-case, spaces to underscores."""
    return name.strip().lower().replace(" ", "_")


def normalize_columns(df: DataFrame) -> DataFrame:
    """Rename every column with :func:`normalize_name` (a projection only)."""
    new = [normalize_name(c) for c in df.columns]
    dupes = sorted({c for c in new if new.count(c) > 1})
    if dupes:
        raise ValueError(f"column names collide after normalisation: {dupes}")
    return df.toDF(*new)


def union_sources(*frames: DataFrame) -> DataFrame:
    """UNION ALL of the extracts by column name; duplicates are kept."""
    if not frames:
        raise ValueError("union_sources needs at least one DataFrame")
    # toDF: a plain (untyped) DataFrame, so the widened schema is not forced
    # back into the first input's encoder
    out = frames[0].toDF(*frames[0].columns)
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def _parsed(name: str, source: T.DataType, target: T.DataType, timestamp_format: str | None) -> Column:
    c = F.col(name)
    if not isinstance(source, T.StringType) or isinstance(target, T.StringType):
        return c.cast(target)
    c = F.trim(c)
    c = F.when(c != "", c)
    if isinstance(target, T.TimestampNTZType) and timestamp_format:
        return F.to_timestamp_ntz(c, F.lit(timestamp_format))
    if isinstance(target, T.IntegralType):
        return c.cast("decimal(38,6)").cast(target)  # a column with gaps is written as 13085.0
    return c.cast(target)


def parse_raw(df: DataFrame, schema: T.StructType = RAW_SCHEMA, optional: Iterable[str] = (),
              timestamp_format: str | None = None) -> DataFrame:
    """The columns of ``schema``, cast from text where they are text.

    A missing column is an error that names it, unless it is in ``optional``
    (then it is null).  Whole numbers may be written with a fraction, empty text
    is null, and ``timestamp_format`` is a Spark datetime pattern (default: ISO).
    """
    have = {f.name: f.dataType for f in df.schema.fields}
    missing = [f.name for f in schema.fields if f.name not in have and f.name not in set(optional)]
    if missing:
        raise ValueError(f"missing columns: {missing}; found: {sorted(have)}")
    return df.select([
        (_parsed(f.name, have[f.name], f.dataType, timestamp_format) if f.name in have
         else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema.fields])


def read_raw(spark: SparkSession, paths: Iterable[str] | str, fmt: str = "parquet",
             schema: T.StructType = RAW_SCHEMA, optional: Iterable[str] = (),
             timestamp_format: str | None = None, **options) -> DataFrame:
    """Read one or more raw extracts and return them stacked, normalised and typed.

    ``fmt`` is any Spark batch format.  CSV extracts are read as text by their own
    header, whatever its order; then all extracts are normalised with O02 and
    parsed with :func:`parse_raw`, each by itself, so a misspelt header in one
    of them is an error.
    """
    frames = []
    for p in [paths] if isinstance(paths, str) else paths:
        r = spark.read.format(fmt).options(**options)
        if fmt == "csv":
            r = r.option("header", "true").option("inferSchema", "false")
        frames.append(parse_raw(normalize_columns(r.load(p)), schema, optional, timestamp_format))
    return union_sources(*frames)
