"""Window reports: ranks within country (O26), lead/lag (O27), moving
average (O28), order sequence (O29), LTV percentiles (O30), first and last
product (O31)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillroll.functions.metrics import fill_months, monthly_revenue
from tillroll.functions.numeric import mean_of, pct
from tillroll.plans.ranking import RankSpec, add_group_rankings, add_rankings
from tillroll.plans.selection import Tiles, ntiles
from tillroll.plans.store import stored
from tillroll.schema import LTV_TIER_CUTS, LTV_TIERS


def customer_rank_in_country(tx: DataFrame, sort: bool = True, **rank_opts) -> DataFrame:
    """``customer_id, country, total_revenue, rank_in_country,
    dense_rank_in_country, row_num_in_country`` by revenue descending
    (row numbers break ties by ``customer_id``).  Countries that fit a task are
    ordinary windows; a dominant one is split over several buckets
    (:func:`add_group_rankings`).  The three columns share one order, so they are one pass."""
    per = (tx.groupBy("customer_id", "country")
             .agg(F.sum("revenue").alias("_rev")))
    by_rev = (("_rev", False),)
    r = add_group_rankings(per, [
        RankSpec("rank_in_country", "rank", by_rev),
        RankSpec("dense_rank_in_country", "dense_rank", by_rev),
        RankSpec("row_num_in_country", "row_number", by_rev, ("customer_id",)),
    ], partition_by=["country"], **rank_opts)
    out = r.select("customer_id", "country", F.round("_rev", 2).alias("total_revenue"),
                   "rank_in_country", "dense_rank_in_country", "row_num_in_country")
    if sort:
        out = out.orderBy(F.col("country").asc_nulls_last(), "rank_in_country",
                          "row_num_in_country")
    return out


def _monthly(tx: DataFrame, fill: bool = False) -> DataFrame:
    m = monthly_revenue(tx, with_counts=False).select(
        "month", F.round("revenue", 2).alias("revenue"))
    return fill_months(m, ["revenue"]) if fill else m


def monthly_lead_lag(tx: DataFrame, fill_months: bool = False) -> DataFrame:
    """``month, current_revenue, prev_month, next_month, mom_change,
    mom_growth_pct`` (one row per month with sales, or per calendar month
    with ``fill_months``; bounded window)."""
    w = Window.orderBy("month")
    m = _monthly(tx, fill_months)
    return (m.select("month", F.col("revenue").alias("current_revenue"),
                     F.lag("revenue", 1).over(w).alias("prev_month"),
                     F.lead("revenue", 1).over(w).alias("next_month"))
             .withColumn("mom_change", F.round(F.col("current_revenue") - F.col("prev_month"), 2))
             .withColumn("mom_growth_pct",
                         pct(F.col("current_revenue") - F.col("prev_month"),
                             F.col("prev_month"), 2))
             .orderBy("month"))


def moving_average(tx: DataFrame, k: int = 3, fill_months: bool = False) -> DataFrame:
    """``month, revenue, moving_avg_<k>m``: mean of the current and up
    to k-1 preceding months with sales (partial at the start); with
    ``fill_months`` months without sales count as 0."""
    w = Window.orderBy("month").rowsBetween(-(k - 1), Window.currentRow)
    m = _monthly(tx, fill_months)
    return (m.withColumn(f"moving_avg_{k}m",
                         mean_of(F.sum("revenue").over(w), F.count("revenue").over(w), 2))
             .orderBy("month"))


def order_sequence(tx: DataFrame, sort: bool = True, **rank_opts) -> DataFrame:
    """One row per (customer, invoice, timestamp) with its value,
    numbered per customer in time order (ties by invoice).  Only customers with more orders
    than a task should hold go through range buckets (:func:`add_group_rankings`)."""
    o = (tx.groupBy("customer_id", "invoice", "invoicedate")
           .agg(F.sum("revenue").alias("_value")))
    r = add_group_rankings(o, [RankSpec("order_sequence_number", "row_number",
                                  (("invoicedate", True),), ("invoice",))],
                     partition_by=["customer_id"], **rank_opts)
    out = r.select("customer_id", "invoice", F.to_date("invoicedate").alias("order_date"),
                   F.round("_value", 2).alias("order_value"), "order_sequence_number")
    return out.orderBy("customer_id", "order_sequence_number") if sort else out


def ltv_tier(p):
    c = F.col(p)
    a, b, d = LTV_TIER_CUTS
    return (F.when(c >= a, F.lit(LTV_TIERS[0])).when(c >= b, F.lit(LTV_TIERS[1]))
             .when(c >= d, F.lit(LTV_TIERS[2])).otherwise(F.lit(LTV_TIERS[3])))


def customer_ltv(tx: DataFrame) -> DataFrame:
    """``customer_id, lifetime_value`` (rounded to cents)."""
    return (tx.groupBy("customer_id")
              .agg(F.round(F.sum("revenue"), 2).alias("lifetime_value")))


def ltv_percentile_tiers(tx: DataFrame, n: int = 100, with_tier: bool = True,
                         sort: bool = True, **passes) -> DataFrame:
    """``customer_id, lifetime_value, ltv_percentile[, ltv_tier]``;
    NTILE(n) by LTV ascending, ties by ``customer_id``; the NTILE is
    computed once and reused by the tier CASE."""
    r = ntiles(stored(customer_ltv(tx)), [
        Tiles("ltv_percentile", (("lifetime_value", True), ("customer_id", True)), n)], **passes)
    if with_tier:
        r = r.withColumn("ltv_tier", ltv_tier("ltv_percentile"))
    return r.orderBy(F.col("lifetime_value").desc(), "customer_id") if sort else r


def first_last_product(tx: DataFrame, sort: bool = True) -> DataFrame:
    """``customer_id, first_product_bought, last_product_bought``.

    The description of the first and last line in time order (ties by
    invoice, stock code, then description with nulls last); a null description
    of the chosen line is returned as null, as FIRST_VALUE / LAST_VALUE do.

    A hash aggregate finds each customer's first and last time; a semi join on
    (customer, time), which spreads a heavy customer's lines over the tasks, keeps
    the lines at these two times, and only they reach ``min_by`` / ``max_by``,
    whose text buffers need a sort-based aggregate."""
    ends = (tx.groupBy("customer_id").agg(F.array_distinct(F.array(F.min("invoicedate"), F.max("invoicedate")))
                                          .alias("_ends"))
              .select("customer_id", F.explode("_ends").alias("invoicedate")))
    lines = tx.select("customer_id", "invoicedate", "invoice", "stockcode", "description").join(
        ends, ["customer_id", "invoicedate"], "left_semi")
    key = F.struct("invoicedate", "invoice", "stockcode",
                   F.col("description").isNull().alias("_null_desc"), "description")
    out = (lines.groupBy("customer_id")
           .agg(F.min_by("description", key).alias("first_product_bought"),
                F.max_by("description", key).alias("last_product_bought")))
    return out.orderBy("customer_id") if sort else out


def running_invoice_revenue(tx: DataFrame, **rank_opts) -> DataFrame:
    """O14 at invoice grain: ``invoice, invoicedate, revenue, running_revenue`` in time
    order (ties by invoice).  One row per invoice is too many for a one-task
    window, so the running total is a ranking column."""
    per = tx.groupBy("invoice", "invoicedate").agg(F.sum("revenue").alias("_rev"))
    r = add_rankings(per, [RankSpec("_run", "running_sum", (("invoicedate", True),), ("invoice",),
                                    value="_rev")], **rank_opts)
    return r.select("invoice", "invoicedate", F.round("_rev", 2).alias("revenue"),
                    F.round("_run", 2).alias("running_revenue"))
