"""Distribution statistics behind the charts: equal-width histogram
and an exact interpolated quantile (O33)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillroll.plans.selection import values_at
from tillroll.plans.store import stored


def histogram(df: DataFrame, col: str = "lifetime_value", bins: int = 60) -> DataFrame:
    """``bin, lo, hi, customers`` for ``bins`` equal-width bins from the
    minimum to the maximum (last bin closed; empty bins kept with 0).

    Double arithmetic as in numpy; when min = max the range is widened by
    0.5 on each side.  Min/max is a one-row aggregate joined by broadcast;
    the per-bin count is a partially aggregated ``groupBy``; the bins come
    from a ``range`` of the (fixed) bin count, and the edges are spread to
    empty bins by a window over those ``bins`` rows.  ``df`` is read twice
    (min/max, then counts): pass a materialised frame when it is costly.
    """
    x = F.col(col).cast("double")
    mm = (df.agg(F.min(x).alias("mn"), F.max(x).alias("mx"))
            .select(F.when(F.col("mn") == F.col("mx"), F.col("mn") - 0.5)
                     .otherwise(F.col("mn")).alias("_lo"),
                    F.when(F.col("mn") == F.col("mx"), F.col("mx") + 0.5)
                     .otherwise(F.col("mx")).alias("_hi")))
    width = (F.col("_hi") - F.col("_lo"))
    b = F.least(F.floor((x - F.col("_lo")) * F.lit(float(bins)) / width).cast("bigint"),
                F.lit(bins - 1))
    counts = (df.filter(F.col(col).isNotNull()).crossJoin(F.broadcast(mm))
                .groupBy(b.alias("bin"))
                .agg(F.count(F.lit(1)).alias("customers"), F.max("_lo").alias("_lo"),
                     F.max("_hi").alias("_hi")))
    spark = df.sparkSession
    every = Window.partitionBy()  # over the `bins` rows only
    lo, hi = F.max("_lo").over(every), F.max("_hi").over(every)
    w = (hi - lo)
    return (spark.range(bins).withColumnRenamed("id", "bin")
                 .join(F.broadcast(counts), "bin", "left")
                 .select("bin",
                         (lo + F.col("bin") * w / F.lit(float(bins))).alias("lo"),
                         (lo + (F.col("bin") + 1) * w / F.lit(float(bins))).alias("hi"),
                         F.coalesce("customers", F.lit(0)).cast("bigint").alias("customers"))
                 .orderBy("bin"))


def quantile(df: DataFrame, col: str = "lifetime_value", q: float = 0.9,
             approx: bool = False, accuracy: int = 10000, **passes) -> DataFrame:
    """One row ``threshold`` = the q-quantile with linear interpolation
    between the two values around position q·(n-1), as ``percentile`` does.

    Exact and distributed: the column is stored once, and the values at the floor and
    ceiling of the position are found by refined histograms (:func:`values_at`); nothing
    is sorted.  (Spark's ``percentile`` aggregate would merge a map of every distinct
    value in a single task.)  ``approx=True`` uses ``percentile_approx`` instead.  No
    values give a null.
    """
    if approx:
        return df.agg(F.percentile_approx(F.col(col).cast("double"), q, accuracy).alias("threshold"))
    vals = stored(df.select(F.col(col).alias("x")).filter("x IS NOT NULL"))

    def around(n):
        return [math.floor((n - 1) * q) + 1, math.ceil((n - 1) * q) + 1]

    n, (low, high) = values_at(vals, "x", around, **passes)
    out = None
    if low is not None:
        low, high, at = float(low), float(high), (n - 1) * q
        out = low if low == high or at == math.floor(at) else (
            (math.ceil(at) - at) * low + (at - math.floor(at)) * high)
    return df.sparkSession.range(1).select(F.lit(out).cast("double").alias("threshold"))
