"""Revenue reports: monthly growth (O10), top customers (O11), top products
(O12), countries (O13), running total (O14)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillroll.functions.metrics import customer_summary, monthly_revenue, share_of_total
from tillroll.functions.metrics import fill_months as fill_months_of
from tillroll.functions.numeric import mean_of, pct
from tillroll.functions.sketches import as_sketches, merged


def monthly_revenue_growth(tx: DataFrame, with_orders: bool = True,
                           prev_name: str = "prev_month_revenue",
                           fill_months: bool = False, approx: bool | DataFrame = False) -> DataFrame:
    """``month, total_revenue, unique_customers[, total_orders],
    prev_month_revenue, mom_growth_pct``.  LAG steps over months *with*
    sales; growth is null for the first month or a zero previous month.
    ``fill_months=True`` inserts the months without sales as zero rows, so
    LAG compares calendar-adjacent months.  ``approx`` takes the two distinct
    counts from sketches, of ``tx`` (True) or of a sketch frame such as
    :func:`tillroll.functions.sketches.read_sketches` gives (``tx`` is then not read).

    The window has no partition key on purpose: it runs over one row per
    calendar month, a size fixed by the calendar, not by the data volume.
    """
    m = (merged(as_sketches(tx, approx), "month") if approx else monthly_revenue(tx)).select(
        "month", F.round("revenue", 2).alias("total_revenue"), "unique_customers",
        *(["total_orders"] if with_orders else []))
    if fill_months:
        m = fill_months_of(m, [c for c in m.columns if c != "month"])
    return growth_of_months(m, prev_name)


def growth_of_months(m: DataFrame, prev_name: str = "prev_month_revenue") -> DataFrame:
    """Month-over-month growth on a monthly frame (``month, total_revenue``)."""
    w = Window.orderBy("month")
    prev = F.lag("total_revenue").over(w)
    return (m.withColumn(prev_name, prev)
             .withColumn("mom_growth_pct",
                         pct(F.col("total_revenue") - F.col(prev_name), F.col(prev_name), 2))
             .orderBy("month"))


def _rank_top(df: DataFrame, metric: str, k: int, tie: str, rank_name: str) -> DataFrame:
    """ORDER BY metric DESC LIMIT k, then RANK on the k rows.  Exact: a kept
    row's rank depends only on rows above it, which are all kept."""
    top = df.orderBy(F.col(metric).desc(), F.col(tie)).limit(k)
    return top.withColumn(rank_name, F.rank().over(Window.orderBy(F.col(metric).desc())))


def top_customers(tx: DataFrame, k: int = 10, with_dates: bool = True,
                  rank_name: str = "revenue_rank", summary: DataFrame | None = None) -> DataFrame:
    """``revenue_rank, customer_id, total_orders, total_revenue,
    avg_order_value[, first_purchase, last_purchase]`` for the top k.
    ``avg_order_value`` is the mean *line* revenue."""
    s = (summary if summary is not None else customer_summary(
        tx, recency=False, need=("first_purchase", "total_orders", "lifetime_value", "line_count"))).select(
        "customer_id", "total_orders", F.round("lifetime_value", 2).alias("total_revenue"),
        mean_of("lifetime_value", "line_count", 2).alias("avg_order_value"),
        *(["first_purchase", "last_purchase"] if with_dates else []))
    r = _rank_top(s, "total_revenue", k, "customer_id", rank_name)
    return r.select(rank_name, *s.columns).orderBy(rank_name, "customer_id")


def product_totals(tx: DataFrame) -> DataFrame:
    """Per stock code: ``description`` (max of its spellings), units, revenue.

    Two levels: the lines are first summed per (stock code, spelling), a
    hash aggregate with partial combining; only those few rows reach the
    ``max(description)`` level, whose string buffer needs a sort-based
    aggregate."""
    per_spelling = (tx.groupBy("stockcode", "description")
                      .agg(F.sum("quantity").alias("_units"), F.sum("revenue").alias("_rev")))
    return (per_spelling.groupBy("stockcode")
              .agg(F.max("description").alias("description"),
                   F.sum("_units").alias("total_units_sold"),
                   F.sum("_rev").alias("total_revenue")))


def top_products(tx: DataFrame, k: int = 10) -> DataFrame:
    """``revenue_rank, stockcode, description, total_units_sold,
    total_revenue, pct_of_total_revenue`` (share of *all* products)."""
    grand = tx.agg(F.sum("revenue"))  # = sum over products; no second product shuffle
    p = share_of_total(product_totals(tx), "total_revenue", "pct_of_total_revenue", 2,
                       total=grand)
    r = _rank_top(p, "total_revenue", k, "stockcode", "revenue_rank")
    return (r.select("revenue_rank", "stockcode", "description", "total_units_sold",
                     F.round("total_revenue", 2).alias("total_revenue"),
                     "pct_of_total_revenue")
             .orderBy("revenue_rank", "stockcode"))


def country_revenue(tx: DataFrame, approx: bool | DataFrame = False) -> DataFrame:
    """``rank, country, unique_customers, total_orders, total_revenue,
    pct_of_total``.  One row per country (bounded), so the rank window is a
    plain one.  ``approx`` as in :func:`monthly_revenue_growth`."""
    if approx:
        c = merged(as_sketches(tx, approx), "country")
    else:
        c = (tx.groupBy("country")
               .agg(F.count_distinct("customer_id").alias("unique_customers"),
                    F.count_distinct("invoice").alias("total_orders"),
                    F.sum("revenue").alias("revenue")))
    c = c.withColumn("total_revenue", F.round("revenue", 2)).drop("revenue")
    c = share_of_total(c, "total_revenue", "pct_of_total", 2)
    return (c.withColumn("rank", F.rank().over(Window.orderBy(F.col("total_revenue").desc())))
             .select("rank", "country", "unique_customers", "total_orders", "total_revenue",
                     "pct_of_total")
             .orderBy("rank", F.col("country").asc_nulls_last()))


def cumulative_revenue(tx: DataFrame) -> DataFrame:
    """``sale_date, daily_revenue, cumulative_revenue``.  One row per
    calendar day with sales, so the running window is bounded by the
    calendar span."""
    d = (tx.groupBy(F.to_date("invoicedate").alias("sale_date"))
           .agg(F.round(F.sum("revenue"), 2).alias("daily_revenue")))
    w = Window.orderBy("sale_date").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (d.withColumn("cumulative_revenue", F.round(F.sum("daily_revenue").over(w), 2))
             .orderBy("sale_date"))
