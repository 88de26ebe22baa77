"""Opt-in approximate distinct counts from mergeable sketches kept with each load.

The exact distinct customers and invoices of O10 and O13 shuffle every distinct
(key, id) pair.  A sketch frame instead holds one row per (month, country) with the
exact revenue and two HyperLogLog sketches of fixed size, so that it is bounded by
the calendar and the countries, merges across loads, and a new load adds its own
sketches without reading earlier lines.  Revenue stays exact; only the two
distinct counts are estimates, with a relative standard error of about
1.04 / sqrt(2 ** lg_k) (0.8 % by default).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.functions import parts
from tillroll.functions.metrics import month_of

LG_K = 14
KIND = "sketches"
_SCHEMA = "month date, country string, revenue decimal(22,2), customers binary, invoices binary"


def month_sketches(tx: DataFrame, lg_k: int = LG_K) -> DataFrame:
    """``month, country, revenue, customers, invoices``: one scan, partial sketches per task."""
    return tx.groupBy(month_of("invoicedate").alias("month"), "country").agg(
        F.sum("revenue").cast("decimal(22,2)").alias("revenue"),
        F.hll_sketch_agg("customer_id", F.lit(lg_k)).alias("customers"),
        F.hll_sketch_agg("invoice", F.lit(lg_k)).alias("invoices"))


def merged(sketches: DataFrame, key: str) -> DataFrame:
    """``key, revenue, unique_customers, total_orders``: sketches united per ``month`` or ``country``."""
    def estimate(c):
        return F.coalesce(F.hll_sketch_estimate(F.hll_union_agg(c, F.lit(True))), F.lit(0).cast("long"))

    return sketches.groupBy(key).agg(F.sum("revenue").alias("revenue"),
                                     estimate("customers").alias("unique_customers"),
                                     estimate("invoices").alias("total_orders"))


def as_sketches(tx: DataFrame | None, approx) -> DataFrame:
    """What an ``approx=`` argument means: a sketch frame, or True for sketches of ``tx``."""
    return approx if isinstance(approx, DataFrame) else month_sketches(tx)


def refresh_sketches(spark: SparkSession, path: str, lg_k: int = LG_K) -> list[str]:
    """Sketch the loads of the table at ``path`` that have none yet, each from its own lines only;
    returns their names.  The rows of one load are bounded by months and countries."""
    return parts.refresh(spark, path, KIND, lambda tx, folder: month_sketches(tx, lg_k).coalesce(1)
                         .write.mode("overwrite").parquet(folder))


def read_sketches(spark: SparkSession, path: str) -> DataFrame:
    """The sketches of the loads that the table holds now; sketches of replaced loads are not read."""
    return spark.read.schema(_SCHEMA).parquet(*parts.folders(spark, path, KIND))
