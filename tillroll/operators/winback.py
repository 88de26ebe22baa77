"""Win-back targeting: candidates (O21), priority score (O22), recovery
model (O23, O24) and top products of at-risk customers (O25)."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillroll.functions.metrics import customer_summary, stored_summary
from tillroll.functions.numeric import mean_of
from tillroll.plans.selection import Tiles, add_rank, ntiles
from tillroll.schema import (RECOVERY_RATES, WINBACK_AT_RISK, WINBACK_CHURN_DAYS,
                             WINBACK_CHURNED, WINBACK_MIN_DAYS, WINBACK_TIER_CUTS,
                             WINBACK_TIERS)


def winback_candidates(tx: DataFrame, as_of=None, min_days: int = WINBACK_MIN_DAYS,
                       churn_days: int = WINBACK_CHURN_DAYS, sort: bool = True,
                       summary: DataFrame | None = None, **rank_opts) -> DataFrame:
    """Customers inactive ≥ ``min_days`` ranked by lifetime value:
    ``priority_rank, customer_id, last_purchase, days_inactive, total_orders,
    lifetime_value, avg_order_value, unique_products_bought, status``
    (status: At-Risk for min..churn days inclusive, Churned above).  A given
    ``summary`` should be stored, as it is read once per pass of the ranking."""
    s = summary if summary is not None else stored_summary(
        tx, as_of, need=("total_orders", "unique_products", "lifetime_value", "line_count"))
    s = s.filter(F.col("days_inactive") >= min_days).select(
        "customer_id", "last_purchase", "days_inactive", "total_orders",
        F.round("lifetime_value", 2).alias("lifetime_value"),
        mean_of("lifetime_value", "line_count", 2).alias("avg_order_value"),
        F.col("unique_products").alias("unique_products_bought"),
        F.when(F.col("days_inactive").between(min_days, churn_days), F.lit(WINBACK_AT_RISK))
         .when(F.col("days_inactive") > churn_days, F.lit(WINBACK_CHURNED)).alias("status"))
    r = add_rank(s, "priority_rank", "lifetime_value", asc=False, **rank_opts)
    out = r.select("priority_rank", *s.columns)
    return out.orderBy(F.col("lifetime_value").desc(), "customer_id") if sort else out


def winback_tier(score):
    c = F.col(score)
    t1, t2, t3 = WINBACK_TIER_CUTS
    return (F.when(c >= t1, F.lit(WINBACK_TIERS[0])).when(c >= t2, F.lit(WINBACK_TIERS[1]))
             .when(c >= t3, F.lit(WINBACK_TIERS[2])).otherwise(F.lit(WINBACK_TIERS[3])))


def winback_priority(tx: DataFrame, as_of=None, n: int = 10,
                     min_days: int = WINBACK_MIN_DAYS, sort: bool = True,
                     summary: DataFrame | None = None, **passes) -> DataFrame:
    """``customer_id, days_inactive, lifetime_value, ltv_decile,
    recency_decile, winback_priority_score, winback_tier`` over customers
    inactive ≥ ``min_days`` (deciles are taken *after* that filter).
    LTV decile ascending; recency decile by days descending (so a larger
    decile means more recently active); ties by ``customer_id``.  A given
    ``summary`` should be stored, as it is read once per pass."""
    s = ((summary if summary is not None else stored_summary(
        tx, as_of, need=("lifetime_value",)))
         .filter(F.col("days_inactive") >= min_days)
         .select("customer_id", "days_inactive",
                 F.round("lifetime_value", 2).alias("lifetime_value")))
    r = ntiles(s, [
        Tiles("ltv_decile", (("lifetime_value", True), ("customer_id", True)), n),
        Tiles("recency_decile", (("days_inactive", False), ("customer_id", True)), n),
    ], **passes)
    out = (r.withColumn("winback_priority_score", F.col("ltv_decile") + F.col("recency_decile"))
            .withColumn("winback_tier", winback_tier("winback_priority_score")))
    if sort:
        out = out.orderBy(F.col("winback_priority_score").desc(), "customer_id")
    return out


def recovery_potential(tx: DataFrame, as_of=None, rates=RECOVERY_RATES,
                       round_inner: bool = True,
                       churn_days: int = WINBACK_CHURN_DAYS,
                       summary: DataFrame | None = None) -> DataFrame:
    """One row ``churned_customers, avg_order_value, recovery_<r>_pct...``.

    Per churned customer (inactive > ``churn_days``) the mean line value
    (rounded to cents when ``round_inner``); then count × mean × rate, which
    is computed exactly as sum × rate.  With no churned customer the row is
    ``0`` and nulls."""
    s = summary if summary is not None else customer_summary(
        tx, as_of, need=("lifetime_value", "line_count"))
    s = s.filter(F.col("days_inactive") > churn_days)
    inner = F.col("lifetime_value") / F.col("line_count").cast("decimal(20,0)")
    if round_inner:
        inner = F.round(inner, 2)
    per = s.select("customer_id", inner.alias("aov"))
    agg = per.agg(F.count("customer_id").alias("churned_customers"),
                  F.sum("aov").alias("_sum"))
    cols = [F.col("churned_customers"),
            mean_of("_sum", "churned_customers", 2).alias("avg_order_value")]
    for r in rates:
        pct_label = int(Decimal(r) * 100)
        cols.append(F.round(F.col("_sum") * F.lit(Decimal(r)), 2)
                    .alias(f"recovery_{pct_label}_pct"))
    return agg.select(*cols)


def recovery_long(recovery: DataFrame) -> DataFrame:
    """The one-row recovery result as ``metric, value`` rows."""
    names = recovery.columns
    wide = recovery.select([F.col(c).cast("double").alias(c) for c in names])
    return wide.unpivot([], names, "metric", "value")


def product_spend(tx: DataFrame) -> DataFrame:
    """``customer_id, stockcode, description`` (largest spelling), ``total_qty, _spent``.

    Lines are summed per spelling first, a hash aggregate with partial combining."""
    return (tx.groupBy("customer_id", "stockcode", "description")
              .agg(F.sum("quantity").alias("_q"), F.sum("revenue").alias("_r"))
              .groupBy("customer_id", "stockcode")
              .agg(F.max("description").alias("description"),
                   F.sum("_q").alias("total_qty"), F.sum("_r").alias("_spent")))


def top_products_at_risk(tx: DataFrame, as_of=None, k: int = 3,
                         lo: int = WINBACK_MIN_DAYS, hi: int = WINBACK_CHURN_DAYS) -> DataFrame:
    """For customers inactive ``lo..hi`` days (inclusive), their products
    ranked by spend: ``customer_id, stockcode, description, total_qty,
    total_spent, product_rank`` with rank ≤ k (ties may give more rows).

    The at-risk customers are found first, from one small row per customer;
    a left semi join keeps their lines (a shuffled join, or a broadcast where
    the runtime size allows), and only those are summed per product.  The rank
    filter becomes a ``WindowGroupLimit``.
    """
    days = customer_summary(tx, as_of, need=("last_purchase",))
    chosen = days.filter(F.col("days_inactive").between(lo, hi)).select("customer_id")
    at_risk = product_spend(tx.join(chosen, "customer_id", "left_semi"))
    w = Window.partitionBy("customer_id").orderBy(F.col("_spent").desc())
    return (at_risk.withColumn("product_rank", F.rank().over(w))
                   .filter(F.col("product_rank") <= k)
                   .select("customer_id", "stockcode", "description", "total_qty",
                           F.round("_spent", 2).alias("total_spent"), "product_rank")
                   .orderBy("customer_id", "product_rank", "stockcode"))
