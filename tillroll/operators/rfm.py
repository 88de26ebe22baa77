"""RFM segmentation (O07) and its summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.functions.metrics import share_of_total, stored_summary
from tillroll.functions.numeric import mean_of
from tillroll.plans.selection import Tiles, ntiles
from tillroll.schema import SEG_OTHER, SEGMENT_RULES


def segment_of(r, f, m):
    """Six segments by the bounds of :data:`SEGMENT_RULES`, first matching rule wins."""
    score = {"r": F.col(r), "f": F.col(f), "m": F.col(m)}
    out = F.lit(SEG_OTHER)
    for label, bounds in reversed(SEGMENT_RULES):
        fits = F.lit(True)
        for s, (low, high) in bounds.items():
            fits = fits & score[s].between(low, high)
        out = F.when(fits, F.lit(label)).otherwise(out)
    return out


def rfm_segments(tx: DataFrame, as_of=None, n: int = 5, sort: bool = True,
                 summary: DataFrame | None = None, **passes) -> DataFrame:
    """``customer_id, last_purchase_date, recency_days, frequency,
    monetary, r_score, f_score, m_score, rfm_total, segment``.

    Scores are NTILE(n): recency by days descending (n = most recent),
    frequency and monetary ascending; ties broken by ``customer_id``.
    The customers at which the buckets of the three scores begin are found by
    refined histograms in the same passes (:func:`ntiles`); the scores are then a
    projection. A given ``summary`` should be stored, as it is read once per pass.
    """
    s = (summary if summary is not None else stored_summary(
        tx, as_of, need=("total_orders", "lifetime_value"))).select(
        "customer_id", F.col("last_purchase").alias("last_purchase_date"),
        F.col("days_inactive").alias("recency_days"),
        F.col("total_orders").alias("frequency"),
        F.round("lifetime_value", 2).alias("monetary"))
    scored = ntiles(s, [
        Tiles("r_score", (("recency_days", False), ("customer_id", True)), n),
        Tiles("f_score", (("frequency", True), ("customer_id", True)), n),
        Tiles("m_score", (("monetary", True), ("customer_id", True)), n),
    ], **passes)
    out = (scored.withColumn("rfm_total", F.col("r_score") + F.col("f_score") + F.col("m_score"))
                 .withColumn("segment", segment_of("r_score", "f_score", "m_score")))
    if sort:
        out = out.orderBy(F.col("rfm_total").desc(), F.col("monetary").desc(), "customer_id")
    return out


def _segment_totals(rfm: DataFrame) -> DataFrame:
    return (rfm.groupBy("segment")
               .agg(F.count("customer_id").alias("customer_count"),
                    F.sum("monetary").alias("_sum"))
               .select("segment", "customer_count", F.round("_sum", 2).alias("total_revenue"),
                       mean_of("_sum", "customer_count", 2).alias("_avg")))


def rfm_segment_summary(rfm: DataFrame) -> DataFrame:
    """Per segment ``customer_count, total_revenue,
    avg_revenue_per_customer, pct_of_customers`` by revenue descending."""
    t = _segment_totals(rfm).withColumnRenamed("_avg", "avg_revenue_per_customer")
    return share_of_total(t, "customer_count", "pct_of_customers", 2) \
        .orderBy(F.col("total_revenue").desc(), "segment")


def rfm_segment_rollup(rfm: DataFrame) -> DataFrame:
    """``segment, customer_count, total_revenue, avg_revenue`` (2 dp,
    half away from zero), by revenue descending."""
    return (_segment_totals(rfm).withColumnRenamed("_avg", "avg_revenue")
            .orderBy(F.col("total_revenue").desc(), "segment"))
