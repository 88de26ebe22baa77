"""The customer summary (B1) from mergeable parts kept with each load.

A load's part has two small tables, each one partial hash aggregate of the load's own
lines: ``orders``, one row per (customer, invoice) with its first and last line,
revenue and lines, and ``products``, the distinct (customer, stock code) pairs.
:func:`merged_summary` unites the parts of all loads.  The distinct counts stay exact
where an invoice or a product of a customer comes in several loads, because the
keys themselves are merged, and old lines are not read again.

Neither step expands lines for the two distinct counts; both combine partially
before each shuffle, so a customer with a third of all lines is one row per task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.functions import parts
from tillroll.functions.metrics import SUMMARY_COLUMNS, store_with_recency

KIND, LAST = "summaries", "products"


def order_part(tx: DataFrame) -> DataFrame:
    """``customer_id, invoice, first_line, last_line, revenue, line_count``."""
    return tx.groupBy("customer_id", "invoice").agg(
        F.min("invoicedate").alias("first_line"), F.max("invoicedate").alias("last_line"),
        F.sum("revenue").alias("revenue"), F.count(F.lit(1)).alias("line_count"))


def product_part(tx: DataFrame) -> DataFrame:
    """The distinct ``customer_id, stockcode``."""
    return tx.select("customer_id", "stockcode").distinct()


def merged_summary(orders: DataFrame, products: DataFrame) -> DataFrame:
    """The columns of :func:`tillroll.functions.metrics.customer_summary` without recency,
    from the united order and product parts of any number of loads.

    A null invoice or stock code counts as a line, not as an order or product.  Rows of both
    parts meet in one aggregate by customer, without a join.
    """
    value = orders.schema["revenue"].dataType
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    per_order = orders.groupBy("customer_id", "invoice").agg(
        F.min("first_line").alias("first_line"), F.max("last_line").alias("last_line"),
        F.sum("revenue").alias("revenue"), F.sum("line_count").alias("line_count"))
    rows = per_order.select(
        "customer_id", "first_line", "last_line", "revenue", "line_count",
        F.when(F.col("invoice").isNotNull(), one).otherwise(none).alias("orders"), none.alias("products"))
    pairs = products.distinct().select(
        "customer_id", F.when(F.col("stockcode").isNotNull(), one).otherwise(none).alias("products"))
    return (rows.unionByName(pairs, allowMissingColumns=True).groupBy("customer_id")
            .agg(F.to_date(F.min("first_line")).alias("first_purchase"),
                 F.to_date(F.max("last_line")).alias("last_purchase"),
                 F.coalesce(F.sum("orders"), none).alias("total_orders"),
                 F.sum("products").alias("unique_products"),
                 F.sum("revenue").cast(value).alias("lifetime_value"),
                 F.coalesce(F.sum("line_count"), none).alias("line_count"))
            .select("customer_id", *SUMMARY_COLUMNS))


def _write(tx: DataFrame, folder: str) -> None:
    for name, part in (("orders", order_part(tx)), (LAST, product_part(tx))):
        part.write.mode("overwrite").parquet(f"{folder}/{name}")


def refresh_summaries(spark: SparkSession, path: str) -> list[str]:
    """Write the parts of the loads of the table at ``path`` that have none yet, each from its
    own lines only; returns the names of those loads.  Parts of replaced loads go."""
    done = parts.refresh(spark, path, KIND, _write, LAST)
    parts.prune(spark, path, KIND)
    return done


def read_summary(spark: SparkSession, path: str, as_of=None, recency: bool = True) -> DataFrame:
    """The customer summary of the table at ``path`` from the parts of its loads, for the
    ``summary=`` argument of the reports.  With ``recency`` it is stored, one row per customer,
    and the latest day (unless ``as_of`` gives one) is observed while it is written."""
    where = parts.folders(spark, path, KIND, LAST)
    s = merged_summary(*[spark.read.parquet(*[f"{x}/{name}" for x in where]) for name in ("orders", LAST)])
    return store_with_recency(s, as_of) if recency else s
