"""Shared building blocks: customer summary (B1), monthly revenue (B2),
reference date (B3) and share of total (B4)."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillroll.functions.numeric import pct
from tillroll.plans.store import observed


#: Aggregates of the customer summary, beside the customer.
SUMMARY_COLUMNS = ("first_purchase", "last_purchase", "total_orders", "unique_products",
                   "lifetime_value", "line_count")


def month_of(col) -> Column:
    """First day of the calendar month of a date or timestamp_ntz, computed
    on dates (no time zone is involved, whatever the session zone)."""
    c = F.col(col) if isinstance(col, str) else col
    return F.trunc(F.to_date(c), "month")


def as_of_frame(tx: DataFrame) -> DataFrame:
    """One-row frame ``as_of`` = date of the latest line.

    A partial ``max`` per task over the one pruned column, then a single
    row: no shuffle of lines or customers.
    """
    return tx.agg(F.to_date(F.max("invoicedate")).alias("as_of"))


def with_as_of(df: DataFrame, as_of=None, tx: DataFrame | None = None) -> DataFrame:
    """Attach ``as_of``: a date literal, a Column, or (None) derived from
    ``tx`` as a one-row broadcast."""
    if as_of is None:
        if tx is None:
            raise ValueError("as_of=None needs the transaction frame")
        return df.crossJoin(F.broadcast(as_of_frame(tx)))
    if isinstance(as_of, (str, _dt.date)):
        return df.withColumn("as_of", F.lit(as_of).cast("date"))
    if isinstance(as_of, Column):
        return df.withColumn("as_of", as_of.cast("date"))
    raise TypeError("as_of must be None, a date, an ISO string or a Column")


def customer_summary(tx: DataFrame, as_of=None, recency: bool = True,
                     need: tuple = ()) -> DataFrame:
    """B1: one row per customer.

    ``customer_id, first_purchase, last_purchase, as_of, days_inactive,
    total_orders, unique_products, lifetime_value, line_count``.
    ``recency=False`` leaves out ``as_of``/``days_inactive`` (no reference
    date needed).  ``lifetime_value`` is the exact decimal sum (unrounded; revenue has
    scale 2 so it is already a cent value).  ``need`` names the aggregates a
    caller uses (default: all).

    Without a given ``as_of`` it is the latest ``last_purchase``: the summary is
    then stored (:func:`stored_summary`).
    """
    if recency and as_of is None:
        return stored_summary(tx, need=need)
    s = _summary(tx, need)
    return _with_recency(with_as_of(s, as_of, tx)) if recency else s


def stored_summary(tx: DataFrame, as_of=None, need: tuple = ()) -> DataFrame:
    """:func:`customer_summary` stored once, one row per customer; a job runs while it is built.

    Lines are read and aggregated once: the latest day is observed while the table is written.
    """
    return store_with_recency(_summary(tx, need), as_of)


def store_with_recency(summary: DataFrame, as_of=None) -> DataFrame:
    """A summary stored once, with ``as_of`` (default: its latest ``last_purchase``) and
    ``days_inactive``."""
    s, seen = observed(summary, latest=F.max("last_purchase"))
    return _with_recency(with_as_of(s, F.lit(seen["latest"]) if as_of is None else as_of))


def _with_recency(s: DataFrame) -> DataFrame:
    return s.withColumn("days_inactive", F.datediff("as_of", "last_purchase"))


def _summary(tx: DataFrame, need: tuple) -> DataFrame:
    aggs = {
        "first_purchase": F.to_date(F.min("invoicedate")),
        "last_purchase": F.to_date(F.max("invoicedate")),
        "total_orders": F.count_distinct("invoice"),
        "unique_products": F.count_distinct("stockcode"),
        "lifetime_value": F.sum("revenue"),
        "line_count": F.count(F.lit(1)),
    }
    need = {*need, "last_purchase"} if need else set(aggs)
    return tx.groupBy("customer_id").agg(*[v.alias(k) for k, v in aggs.items() if k in need])


def monthly_revenue(tx: DataFrame, with_counts: bool = True) -> DataFrame:
    """B2: ``month, revenue[, unique_customers, total_orders]`` per calendar
    month with sales (months without sales have no row)."""
    aggs = [F.sum("revenue").alias("revenue")]
    if with_counts:
        aggs += [F.count_distinct("customer_id").alias("unique_customers"),
                 F.count_distinct("invoice").alias("total_orders")]
    return (tx.groupBy(month_of("invoicedate").alias("month"))
              .agg(*aggs))


def fill_months(m: DataFrame, zero_cols) -> DataFrame:
    """Add the calendar months missing between the first and last month of a
    monthly frame, with ``zero_cols`` set to 0 (other columns null).  The
    calendar comes from a one-row min/max and ``sequence``; it is bounded by
    the time span, not by the data volume."""
    types = {f.name: f.dataType for f in m.schema.fields}
    cal = (m.agg(F.min("month").alias("_lo"), F.max("month").alias("_hi"))
             .select(F.explode(F.sequence("_lo", "_hi", F.expr("INTERVAL 1 MONTH")))
                     .alias("month")))
    out = cal.join(m, "month", "left")
    return out.select([F.coalesce(F.col(c), F.lit(0).cast(types[c])).alias(c) if c in zero_cols
                       else F.col(c) for c in m.columns])


def share_of_total(df: DataFrame, col: str, out: str, scale: int = 2,
                   total: DataFrame | None = None) -> DataFrame:
    """``out = round(100.0 * col / total, scale)``.

    ``total=None``: the total is ``sum(col) over ()``, which gathers ``df`` in
    one task; use it only where ``df`` is bounded by construction (countries,
    segments, tiers, distinct order counts), where it also avoids computing
    ``df`` twice.  Otherwise pass ``total``, a one-row frame (for instance
    the grand total taken straight from the fact table), joined by
    broadcast.
    """
    if total is None:
        t = F.sum(col).over(Window.partitionBy())
        return df.withColumn(out, pct(F.col(col), t, scale))
    t = total.select(total.columns[0]).toDF("_total")
    return (df.crossJoin(F.broadcast(t))
              .withColumn(out, pct(F.col(col), F.col("_total"), scale))
              .drop("_total"))
