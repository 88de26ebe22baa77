"""Expected results on the micro fixture (hand-checked values)."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from fixture import raw_frame, tx_frame
from tillroll.functions.metrics import customer_summary
from tillroll.operators import churn, clean, revenue, rfm, stats, winback, windows

D = dt.date


@pytest.fixture(scope="module")
def tx(spark):
    return tx_frame(spark).cache()


def test_cleaning_audit(spark):
    rows = {r.rule: r.rows for r in clean.cleaning_audit(raw_frame(spark)).collect()}
    assert rows == {"input": 15, "missing_customer": 2, "cancellation": 1,
                    "non_positive_quantity_or_price": 2, "valid": 10}


def test_typing_rounds_price_and_revenue(tx):
    tag = tx.filter(F.col("invoice") == "c113").first()
    assert str(tag.price) == "0.34" and str(tag.revenue) == "1.01"
    assert tx.count() == 10


def test_contract_violation_raises(spark):
    bad = raw_frame(spark).limit(1).withColumn("stockcode", F.lit(None).cast("string"))
    with pytest.raises(Exception, match="stockcode is null"):
        clean.type_transactions(clean.clean_transactions(bad)).collect()
    assert clean.transaction_rejects(clean.clean_transactions(bad)).count() == 1
    assert clean.type_transactions(clean.clean_transactions(bad), "drop").count() == 0


def test_customer_summary(tx):
    got = {r.customer_id: (r.last_purchase, r.days_inactive, r.total_orders,
                           str(r.lifetime_value), r.line_count)
           for r in customer_summary(tx).collect()}
    assert got == {1: (D(2011, 12, 9), 0, 3, "30.00", 4), 2: (D(2011, 10, 10), 60, 1, "5.00", 1),
                   3: (D(2011, 9, 10), 90, 2, "15.00", 2), 4: (D(2011, 9, 9), 91, 1, "10.00", 1),
                   5: (D(2011, 11, 9), 30, 1, "1.25", 1), 6: (D(2011, 11, 10), 29, 1, "1.01", 1)}


def test_churn_tiers_and_winback_status(tx):
    tiers = {r.customer_id: r.churn_risk for r in churn.churn_flags(tx).collect()}
    assert tiers == {1: "Active", 6: "Active", 5: "Watch", 2: "At-Risk",
                     3: "Churned", 4: "Churned"}
    status = {r.customer_id: r.status for r in winback.winback_candidates(tx).collect()}
    assert status == {2: "At-Risk", 3: "At-Risk", 4: "Churned"}
    rec = winback.recovery_potential(tx).first()
    assert rec.churned_customers == 1 and str(rec.avg_order_value) == "10.00"
    assert str(rec.recovery_10_pct) == "1.00"


def test_monthly_growth_and_moving_average(tx):
    g = [(r.month, str(r.total_revenue), None if r.mom_growth_pct is None else str(r.mom_growth_pct))
         for r in revenue.monthly_revenue_growth(tx).collect()]
    assert g == [(D(2011, 6, 1), "5.00", None), (D(2011, 9, 1), "20.00", "300.00"),
                 (D(2011, 10, 1), "5.00", "-75.00"), (D(2011, 11, 1), "12.26", "145.20"),
                 (D(2011, 12, 1), "20.00", "63.13")]
    ma = [str(r.moving_avg_3m) for r in windows.moving_average(tx).collect()]
    assert ma == ["5.00", "12.50", "10.00", "12.42", "12.42"]
    ll = windows.monthly_lead_lag(tx).collect()
    assert [str(r.next_month) for r in ll] == ["20.00", "5.00", "12.26", "20.00", "None"]


def test_top_products(tx):
    got = [(r.stockcode, r.description, r.total_units_sold, str(r.total_revenue), r.revenue_rank)
           for r in revenue.top_products(tx).collect()]
    assert got[:3] == [("10", "LAMP RED", 5, "25.00", 1), ("11", "MUG", 2, "20.00", 2),
                       ("12", "PEN", 13, "16.25", 3)]
    assert got[3][0] == "13" and got[3][3] == "1.01"


def test_cohorts(tx):
    got = [(r.cohort_month.month, r.cohort_customers, r.month_number, r.retained_customers,
            str(r.retention_rate_pct)) for r in churn.cohort_retention(tx).collect()]
    assert got == [(6, 1, 0, 1, "100.00"), (6, 1, 3, 1, "100.00"), (9, 1, 0, 1, "100.00"),
                   (10, 1, 0, 1, "100.00"), (11, 3, 0, 3, "100.00"), (11, 3, 1, 1, "33.33")]
    m = churn.cohort_matrix(tx).collect()
    assert [r.cohort_month for r in m] == ["2011-06", "2011-09", "2011-10", "2011-11"]
    assert m[0].month_3 == 100.0 and m[0].month_1 is None and str(m[3].month_1) == "33.3"


def test_cadence(tx):
    got = [(r.customer_id, r.gap_count, str(r.avg_days_between_purchases), r.min_days, r.max_days)
           for r in churn.purchase_cadence(tx).collect()]
    assert got == [(1, 3, "10.0", 0, 30)]


def test_top_products_at_risk(tx):
    got = [(r.customer_id, r.stockcode, r.product_rank)
           for r in winback.top_products_at_risk(tx).collect()]
    assert got == [(2, "10", 1), (3, "11", 1), (3, "10", 2)]


@pytest.mark.parametrize("opts", [{}, {"bucket_rows": 2}])
def test_rank_in_country(tx, opts):
    got = [(r.country, r.customer_id, r.rank_in_country, r.dense_rank_in_country,
            r.row_num_in_country) for r in windows.customer_rank_in_country(tx, **opts).collect()]
    assert got == [("EIRE", 3, 1, 1, 1), ("EIRE", 5, 2, 2, 2),
                   ("UK", 1, 1, 1, 1), ("UK", 2, 2, 2, 2), ("UK", 3, 2, 2, 3), ("UK", 6, 4, 3, 4),
                   (None, 4, 1, 1, 1)]


@pytest.mark.parametrize("opts", [{}, {"bucket_rows": 2}])
def test_order_sequence(tx, opts):
    got = [(r.invoice, str(r.order_value), r.order_sequence_number)
           for r in windows.order_sequence(tx, **opts).filter("customer_id = 1").collect()]
    assert got == [("A090", "5.00", 1), ("A091", "5.00", 2), ("A100", "20.00", 3)]


def test_first_last_product(tx):
    got = {r.customer_id: (r.first_product_bought, r.last_product_bought)
           for r in windows.first_last_product(tx).collect()}
    assert got == {1: ("LAMP RED", "MUG"), 2: ("LAMP", "LAMP"), 3: ("LAMP", "MUG"),
                   4: ("PEN", "PEN"), 5: ("PEN", "PEN"), 6: ("TAG", "TAG")}


@pytest.mark.parametrize("opts", [{}, {"leaf": 1, "cells": 8}])
def test_rfm_and_percentiles(tx, opts):
    r = rfm.rfm_segments(tx, **opts).collect()
    assert len(r) == 6
    # NTILE(5) over 6 customers: bucket sizes 2,1,1,1,1
    assert sorted(x.f_score for x in r) == [1, 1, 2, 3, 4, 5]
    assert all(x.rfm_total == x.r_score + x.f_score + x.m_score for x in r)
    p = windows.ltv_percentile_tiers(tx, **opts).collect()
    assert sorted(x.ltv_percentile for x in p) == [1, 2, 3, 4, 5, 6]  # fewer rows than buckets
    summary = rfm.rfm_segment_summary(rfm.rfm_segments(tx, sort=False, **opts)).collect()
    assert sum(x.customer_count for x in summary) == 6


def test_histogram_and_quantile(tx):
    ltv = windows.customer_ltv(tx)
    h = stats.histogram(ltv, bins=60).collect()
    assert len(h) == 60 and sum(x.customers for x in h) == 6 and h[-1].customers == 1
    flat = ltv.withColumn("lifetime_value", F.lit(7))
    h1 = stats.histogram(flat, bins=4).collect()
    assert [x.customers for x in h1] == [0, 0, 6, 0] and h1[0].lo == 6.5
    q = stats.quantile(ltv, q=0.9).first().threshold
    assert q == pytest.approx(22.5)  # values 1.01 1.25 5 10 15 30 → 15 + 0.5*15


def test_empty_input(spark, tx):
    empty = tx.limit(0)
    rec = winback.recovery_potential(empty).collect()
    assert len(rec) == 1 and rec[0].churned_customers == 0 and rec[0].avg_order_value is None
    for fn in (churn.churn_flags, rfm.rfm_segments, windows.first_last_product,
               churn.purchase_cadence, churn.cohort_retention):
        assert fn(empty).count() == 0


@pytest.mark.parametrize("q", [0.0, 0.1, 0.5, 0.9, 0.95, 1.0])
def test_quantile_matches_percentile(spark, q):
    import random
    rnd = random.Random(5)
    df = spark.createDataFrame([(float(rnd.choice([1, 2, 2, 3, 7.5, 100])) + rnd.random(),)
                                for _ in range(501)], "v double")
    want = df.agg(F.percentile("v", F.lit(q)).alias("t")).first().t
    for opts in ({}, {"leaf": 1, "cells": 30}):
        assert stats.quantile(df, "v", q, **opts).first().threshold == want


def test_shared_summary_reports_equal_standalone(tx):
    from tillroll.plans.reports import customer_reports
    shared = customer_reports(tx)
    standalone = {"rfm_segments": rfm.rfm_segments(tx), "top_customers": revenue.top_customers(tx),
                  "churn_flags": churn.churn_flags(tx),
                  "churn_summary": churn.churn_summary(churn.churn_flags(tx, sort=False)),
                  "winback_candidates": winback.winback_candidates(tx),
                  "winback_priority": winback.winback_priority(tx),
                  "recovery_potential": winback.recovery_potential(tx)}
    for name, df in standalone.items():
        assert shared[name].collect() == df.collect(), name


def test_growth_after_a_zero_month(spark):
    from decimal import Decimal
    m = spark.createDataFrame([(D(2011, 1, 1), Decimal("10.00")), (D(2011, 2, 1), Decimal("0.00")),
                               (D(2011, 3, 1), Decimal("5.00"))],
                              "month date, total_revenue decimal(22,2)")
    got = [None if r.mom_growth_pct is None else str(r.mom_growth_pct)
           for r in revenue.growth_of_months(m).collect()]
    assert got == [None, "-100.00", None]


@pytest.mark.parametrize("case", ["empty", "one_customer"])
def test_every_query_on_degenerate_input(tx, case):
    from tillroll.plans.catalog import QUERIES
    t = tx.limit(0) if case == "empty" else tx.filter("customer_id = 1")
    for name, q in QUERIES.items():
        if hasattr(q, "on_tx"):
            rows = q.on_tx(t).collect()
            if case == "one_customer" and name in ("rfm_segments", "churn_flags", "ltv_percentiles"):
                assert len(rows) == 1, name
            if case == "empty" and name in ("recovery_potential", "ltv_quantile"):
                assert len(rows) == 1, name


def test_cadence_by_order(tx):
    got = [(r.customer_id, r.gap_count, str(r.avg_days_between_purchases), r.min_days, r.max_days)
           for r in churn.purchase_cadence(tx, grain="order").collect()]
    assert got == [(1, 2, "15.0", 0, 30)]


def test_calendar_fill(tx):
    g = revenue.monthly_revenue_growth(tx, fill_months=True).collect()
    assert [r.month.month for r in g] == [6, 7, 8, 9, 10, 11, 12]
    assert [str(r.total_revenue) for r in g][:4] == ["5.00", "0.00", "0.00", "20.00"]
    assert g[1].mom_growth_pct is not None and str(g[1].mom_growth_pct) == "-100.00"
    assert g[3].mom_growth_pct is None  # previous month is 0
    ma = [str(r.moving_avg_3m) for r in windows.moving_average(tx, fill_months=True).collect()]
    assert ma == ["5.00", "2.50", "1.67", "6.67", "8.33", "12.42", "12.42"]
    assert len(windows.monthly_lead_lag(tx, fill_months=True).collect()) == 7
