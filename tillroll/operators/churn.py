"""Churn tiers, purchase frequency, cohort retention and purchase cadence."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillroll.functions.metrics import customer_summary, share_of_total
from tillroll.functions.numeric import mean_of, pct
from tillroll.schema import CHURN_CUTS, CHURN_TIERS


def churn_tier(days, cuts=CHURN_CUTS, tiers=CHURN_TIERS):
    """Searched CASE: ``< cuts[0]`` → tiers[0] ... else the last tier."""
    d = F.col(days) if isinstance(days, str) else days
    expr = F.when(d < cuts[0], F.lit(tiers[0]))
    for cut, tier in zip(cuts[1:], tiers[1:-1]):
        expr = expr.when(d < cut, F.lit(tier))
    return expr.otherwise(F.lit(tiers[-1]))


def tier_order(col: str, tiers=CHURN_TIERS):
    """Business order of the tiers (1..n), null for unknown labels."""
    expr = None
    for i, t in enumerate(tiers, start=1):
        expr = (F.when if expr is None else expr.when)(F.col(col) == t, F.lit(i))
    return expr


def churn_flags(tx: DataFrame, as_of=None, cuts=CHURN_CUTS, sort: bool = True,
                summary: DataFrame | None = None) -> DataFrame:
    """``customer_id, last_purchase, days_inactive, total_orders,
    lifetime_value, churn_risk`` — most inactive first."""
    s = summary if summary is not None else customer_summary(
        tx, as_of, need=("total_orders", "lifetime_value"))
    out = s.select(
        "customer_id", "last_purchase", "days_inactive", "total_orders",
        F.round("lifetime_value", 2).alias("lifetime_value"),
        churn_tier("days_inactive", cuts).alias("churn_risk"))
    return out.orderBy(F.col("days_inactive").desc(), "customer_id") if sort else out


def churn_summary(flags: DataFrame, sort: bool = True) -> DataFrame:
    """Per tier ``customer_count, revenue_at_stake, avg_ltv`` in business
    order (Active, Watch, At-Risk, Churned)."""
    out = (flags.groupBy("churn_risk")
                .agg(F.count("customer_id").alias("customer_count"),
                     F.sum("lifetime_value").alias("_ltv_sum"))
                .select("churn_risk", "customer_count",
                        F.round("_ltv_sum", 2).alias("revenue_at_stake"),
                        mean_of("_ltv_sum", "customer_count", 2).alias("avg_ltv")))
    return out.orderBy(tier_order("churn_risk")) if sort else out


def churn_share(summary: DataFrame, scale: int = 1) -> DataFrame:
    """Share of customers per tier, ``scale`` decimals."""
    out = share_of_total(summary.select("churn_risk", "customer_count"),
                         "customer_count", "customer_share_pct", scale)
    return out.select("churn_risk", "customer_share_pct").orderBy(tier_order("churn_risk"))


def purchase_frequency(tx: DataFrame, sort: bool = True) -> DataFrame:
    """How many customers placed exactly N orders, and their share."""
    per_customer = tx.groupBy("customer_id").agg(
        F.count_distinct("invoice").alias("order_count"))
    dist = per_customer.groupBy("order_count").agg(F.count("customer_id").alias("customer_count"))
    out = share_of_total(dist, "customer_count", "pct", 2)
    return out.orderBy("order_count") if sort else out


def _month_number(col):
    """Months since year 0, an integer that steps by one from month to month."""
    return F.year(col) * 12 + F.month(col) - 1


def _cohort_counts(tx: DataFrame, max_offset: int) -> DataFrame:
    """``cohort, active``: per first month (a :func:`_month_number`), how many customers were
    active at each offset 0..max_offset.

    One hash aggregate per customer holds, for each residue r of the month number modulo
    max_offset + 1, the least active month of that residue.  The month at offset k after the
    first is the least month of its residue that the customer can have, so the customer was
    active then exactly if it is the one held.  That is exact for calendars of any length,
    combines partially in the scan tasks, and needs neither distinct pairs nor a window: one
    exchange by customer, of one row per customer and task, then one row per cohort.
    """
    if max_offset < 0:
        raise ValueError("max_offset must not be negative")
    n = max_offset + 1
    month = _month_number("invoicedate")
    per_customer = tx.select("customer_id", month.alias("_m")).groupBy("customer_id").agg(
        F.min("_m").alias("cohort"),
        *[F.min(F.when(F.col("_m") % n == r, F.col("_m"))).alias(f"_r{r}") for r in range(n)])
    least = F.array(*[f"_r{r}" for r in range(n)])
    hits = [F.coalesce(F.get(least, (F.col("cohort") + k) % n) == F.col("cohort") + k, F.lit(False))
            for k in range(n)]
    counts = (per_customer.filter(F.col("cohort").isNotNull()).groupBy("cohort")
              .agg(*[F.count_if(h).alias(f"_n{k}") for k, h in enumerate(hits)]))
    return counts.select("cohort", F.array(*[f"_n{k}" for k in range(n)]).alias("active"))


def _cohort_date():
    return F.make_date(F.floor(F.col("cohort") / 12).cast("int"), F.col("cohort") % 12 + 1, F.lit(1))


def cohort_retention(tx: DataFrame, max_offset: int = 12, scale: int = 2,
                     sort: bool = True) -> DataFrame:
    """``cohort_month, cohort_customers, month_number, retained_customers,
    retention_rate_pct`` for month offsets 0..max_offset.

    Lines are aggregated once, by customer (:func:`_cohort_counts`); offsets at which nobody of
    a cohort was active have no row.  Lines without a date belong to no month.
    """
    out = (_cohort_counts(tx, max_offset)
           .select(_cohort_date().alias("cohort_month"), F.col("active")[0].alias("cohort_customers"),
                   F.posexplode("active").alias("month_number", "retained_customers"))
           .filter(F.col("retained_customers") > 0)
           .withColumn("retention_rate_pct", pct("retained_customers", "cohort_customers", scale)))
    return out.orderBy("cohort_month", "month_number") if sort else out


def cohort_matrix(tx: DataFrame, max_offset: int = 6, scale: int = 1) -> DataFrame:
    """Cohorts as rows (``YYYY-MM``), ``month_0 .. month_<max_offset>``
    retention percentages as columns (null where no customer returned)."""
    rates = [F.when(F.col("active")[k] > 0, pct(F.col("active")[k], F.col("active")[0], scale))
             .alias(f"month_{k}") for k in range(max_offset + 1)]
    return (_cohort_counts(tx, max_offset)
            .select(F.date_format(_cohort_date(), "yyyy-MM").alias("cohort_month"), *rates)
            .orderBy("cohort_month"))


def purchase_cadence(tx: DataFrame, min_gaps: int = 2, sort: bool = True,
                     grain: str = "line") -> DataFrame:
    """Day gaps between a customer's consecutive lines (in time order):
    ``customer_id, gap_count, avg_days_between_purchases (1 dp), min_days,
    max_days`` for customers with at least ``min_gaps`` gaps.

    Exact rewrite that never orders a customer's lines: with L lines on D
    distinct days, there are L-1 gaps; they sum to last-first day; lines on
    the same day give 0-day gaps (so min = 0 when L > D); the non-zero gaps
    are the gaps between consecutive distinct days.  Only the distinct
    (customer, day) pairs are windowed, and those are bounded by the calendar.

    ``grain="order"`` measures between a customer's invoices instead of its
    lines (each invoice dated by its first line).
    """
    if grain not in ("line", "order"):
        raise ValueError("grain must be 'line' or 'order'")
    events = tx.select("customer_id", F.to_date("invoicedate").alias("day"))
    if grain == "order":
        events = (tx.groupBy("customer_id", "invoice")
                    .agg(F.to_date(F.min("invoicedate")).alias("day")).drop("invoice"))
    days = events.groupBy("customer_id", "day").agg(F.count(F.lit(1)).alias("lines"))
    w = Window.partitionBy("customer_id").orderBy("day")
    gaps = days.withColumn("gap", F.datediff("day", F.lag("day").over(w)))
    per = (gaps.groupBy("customer_id")
               .agg(F.sum("lines").alias("n_lines"), F.count(F.lit(1)).alias("n_days"),
                    F.min("day").alias("first_day"), F.max("day").alias("last_day"),
                    F.min("gap").alias("min_day_gap"), F.max("gap").alias("max_day_gap")))
    gap_count = F.col("n_lines") - 1
    out = (per.filter(gap_count >= min_gaps)
              .select("customer_id",
                      gap_count.alias("gap_count"),
                      mean_of(F.datediff("last_day", "first_day").cast("decimal(20,0)"),
                              gap_count, 1).alias("avg_days_between_purchases"),
                      F.when(F.col("n_lines") > F.col("n_days"), F.lit(0))
                       .otherwise(F.col("min_day_gap")).alias("min_days"),
                      F.coalesce(F.col("max_day_gap"), F.lit(0)).alias("max_days")))
    return out.orderBy("avg_days_between_purchases", "customer_id") if sort else out
