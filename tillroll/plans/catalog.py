"""Catalog of registered queries: name → ``f(spark, sf_dir) -> DataFrame``.

Every query reads the test tables through the adapter, cleans and types
them, runs one operator over the whole data and returns the result with
boundary types (:func:`tillroll.functions.numeric.to_contract`).  The contract
of the lines is checked where they are loaded (``transactions``,
``write_and_reconcile``, ``transaction_rejects``); reports trust it.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.functions.numeric import to_contract
from tillroll.operators import churn, clean, revenue, rfm, stats, winback, windows
from tillroll.plans.store import folder, remove, stored
from tillroll.schema import BULK_SCALE
from tillroll.sources.adapter import load_tx, raw_lines_from_tables
from tillroll.sources.raw import normalize_columns, read_raw, union_sources
from tillroll.sources.sink import write_and_reconcile

Query = Callable[[SparkSession, str], DataFrame]

# Header names of the yearly extracts, as they appear in the source sheets.
EXTRACT_HEADERS = {"invoice": "Invoice", "stockcode": "StockCode",
                   "description": "Description", "quantity": "Quantity",
                   "invoicedate": "InvoiceDate", "price": "Price",
                   "customer_id": "Customer ID", "country": "Country"}
EXTRACT_SPLIT = "1996-01-01"
EXTRACT_DATES = "M/d/yyyy H:mm"


def _on_tx(fn) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return to_contract(fn(load_tx(spark, sf_dir, on_violation="trust")))
    run.__name__ = getattr(fn, "__name__", "query")
    run.on_tx = lambda tx: to_contract(fn(tx))  # same query over a stored table
    return run


def _raw_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O01 + O02: two extracts (split at a date) with sheet-style headers,
    normalised and stacked again."""
    raw = raw_lines_from_tables(spark, sf_dir)
    early = F.coalesce(F.col("invoicedate") < F.lit(EXTRACT_SPLIT).cast("timestamp_ntz"),
                       F.lit(False))
    sheets = [raw.filter(cond).select([F.col(c).alias(h) for c, h in EXTRACT_HEADERS.items()])
              for cond in (early, ~early)]
    return to_contract(union_sources(*[normalize_columns(s) for s in sheets]))


def _cleaning_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return to_contract(clean.cleaning_audit(raw_lines_from_tables(spark, sf_dir)))


def _raw_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw lines as CSV extracts in the sheets' own text (headers, ids with a fraction,
    US dates), read back by header."""
    raw = raw_lines_from_tables(spark, sf_dir)
    text = raw.withColumns({
        "customer_id": F.concat(F.col("customer_id").cast("string"), F.lit(".0")),
        "invoicedate": F.date_format("invoicedate", EXTRACT_DATES)})
    path = f"{folder(spark)}/extract-{uuid.uuid4().hex}"
    text.select([F.col(c).alias(h) for c, h in EXTRACT_HEADERS.items()]).write.option(
        "header", "true").csv(path)
    return to_contract(read_raw(spark, path, fmt="csv", timestamp_format=EXTRACT_DATES))


def _transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return to_contract(load_tx(spark, sf_dir))


_transactions.on_tx = to_contract


def _transaction_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned lines at bulk quantities, which the contract's revenue type cannot hold."""
    lines = clean.clean_transactions(raw_lines_from_tables(spark, sf_dir)).withColumn(
        "quantity", (F.col("quantity") * BULK_SCALE).cast("int"))
    return to_contract(clean.transaction_rejects(lines).select(
        "invoice", "stockcode", "quantity", "price", "violations"))


def _write_and_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{folder(spark)}/transactions-{uuid.uuid4().hex}"
    try:
        return write_and_reconcile(load_tx(spark, sf_dir), path)
    finally:
        remove(spark, path)


QUERIES: dict[str, Query] = {
    # ingest
    "raw_union": _raw_union,
    "cleaning_audit": _cleaning_audit,
    "raw_extract": _raw_extract,
    "transactions": _transactions,
    "transaction_rejects": _transaction_rejects,
    "write_and_reconcile": _write_and_reconcile,
    # RFM
    "rfm_segments": _on_tx(rfm.rfm_segments),
    "rfm_segment_summary": _on_tx(lambda tx: rfm.rfm_segment_summary(
        rfm.rfm_segments(tx, sort=False))),
    "rfm_segment_rollup": _on_tx(lambda tx: rfm.rfm_segment_rollup(
        rfm.rfm_segments(tx, sort=False))),
    # revenue
    "monthly_revenue_growth": _on_tx(revenue.monthly_revenue_growth),
    "top_customers": _on_tx(revenue.top_customers),
    "top_products": _on_tx(revenue.top_products),
    "country_revenue": _on_tx(revenue.country_revenue),
    "cumulative_revenue": _on_tx(revenue.cumulative_revenue),
    # churn and retention
    "churn_flags": _on_tx(churn.churn_flags),
    "churn_summary": _on_tx(lambda tx: churn.churn_summary(churn.churn_flags(tx, sort=False))),
    "churn_share": _on_tx(lambda tx: churn.churn_share(
        churn.churn_summary(churn.churn_flags(tx, sort=False), sort=False))),
    "purchase_frequency": _on_tx(churn.purchase_frequency),
    "cohort_retention": _on_tx(churn.cohort_retention),
    "cohort_matrix": _on_tx(churn.cohort_matrix),
    "purchase_cadence": _on_tx(churn.purchase_cadence),
    # win-back
    "winback_candidates": _on_tx(winback.winback_candidates),
    "winback_priority": _on_tx(winback.winback_priority),
    "recovery_potential": _on_tx(winback.recovery_potential),
    "recovery_long": _on_tx(lambda tx: winback.recovery_long(winback.recovery_potential(tx))),
    "top_products_at_risk": _on_tx(winback.top_products_at_risk),
    # window reports
    "customer_rank_in_country": _on_tx(windows.customer_rank_in_country),
    "monthly_lead_lag": _on_tx(windows.monthly_lead_lag),
    "moving_average": _on_tx(windows.moving_average),
    "order_sequence": _on_tx(windows.order_sequence),
    "ltv_percentile_tiers": _on_tx(windows.ltv_percentile_tiers),
    "first_last_product": _on_tx(windows.first_last_product),
    "running_invoice_revenue": _on_tx(windows.running_invoice_revenue),
    # notebook variants of the statements above
    "rfm_scores": _on_tx(lambda tx: rfm.rfm_segments(tx).drop("last_purchase_date")),
    "monthly_revenue_trend": _on_tx(lambda tx: revenue.monthly_revenue_growth(
        tx, with_orders=False, prev_name="prev_month")),
    "top_customers_brief": _on_tx(lambda tx: revenue.top_customers(
        tx, with_dates=False, rank_name="rank")),
    "cohort_retention_6m": _on_tx(lambda tx: churn.cohort_retention(tx, max_offset=6, scale=1)
                                  .select("cohort_month", "month_number",
                                          F.col("retention_rate_pct").alias("retention_pct"))),
    "recovery_potential_unrounded": _on_tx(lambda tx: winback.recovery_potential(
        tx, round_inner=False)),
    "ltv_percentiles": _on_tx(lambda tx: windows.ltv_percentile_tiers(tx, with_tier=False)),
    # chart statistics
    "ltv_histogram": _on_tx(lambda tx: stats.histogram(stored(windows.customer_ltv(tx)))),
    "ltv_quantile": _on_tx(lambda tx: stats.quantile(windows.customer_ltv(tx))),
}
