"""Physical-plan checks: the plans hold at scale, not only the results."""

import pytest

from fixture import tx_frame
from tillroll.operators import churn, revenue, rfm, stats, winback, windows
from tillroll.plans.store import stored


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def tx(spark):
    return stored(tx_frame(spark))


def test_top_products_at_risk_filters_lines_by_a_semi_join(tx):
    p = _plan(winback.top_products_at_risk(tx))
    assert "LeftSemi" in p and "WindowGroupLimit" in p
    # no window over all customers: the only windows rank the products that remain
    assert p.count("Window [") == 1


SELECTED = {
    "rfm_segments": lambda tx: rfm.rfm_segments(tx, sort=False),
    "winback_priority": lambda tx: winback.winback_priority(tx, sort=False),
    "ltv_percentile_tiers": lambda tx: windows.ltv_percentile_tiers(tx, sort=False),
    "ltv_quantile": lambda tx: stats.quantile(windows.customer_ltv(tx)),
}
GROUPED = {
    "customer_rank_in_country": lambda tx: windows.customer_rank_in_country(tx, sort=False),
    "order_sequence": lambda tx: windows.order_sequence(tx, sort=False),
}


def _single_partition_children(plan: str) -> list[str]:
    """What feeds every ``Exchange SinglePartition`` of a plan: its next aggregate, window or scan."""
    lines, out = plan.splitlines(), []
    for i, line in enumerate(lines):
        if "Exchange SinglePartition" in line:
            out.append(next((x for x in lines[i + 1:] if "Aggregate(" in x or "Scan" in x), ""))
    return out


@pytest.mark.parametrize("name", SELECTED)
def test_buckets_and_quantiles_are_projections(tx, name):
    p = _plan(SELECTED[name](tx))
    assert "Window" not in p and "Exchange" not in p and "Sort" not in p


def test_rank_windows_lie_within_cells(tx):
    p = _plan(winback.winback_candidates(tx, sort=False))
    assert "hashpartitioning(_cell" in p and p.count("Exchange") == 1


@pytest.mark.parametrize("name", GROUPED)
def test_small_groups_are_ordinary_windows(tx, name):
    p = _plan(GROUPED[name](tx))
    assert p.count("Exchange") == 1 and "_bucket" not in p


@pytest.mark.parametrize("name", GROUPED)
def test_only_hot_groups_go_through_range_buckets(spark, tx, name):
    spark.conf.set("tillroll.ranking.bucketRows", "2")
    try:
        p = _plan(GROUPED[name](tx))
    finally:
        spark.conf.unset("tillroll.ranking.bucketRows")
    assert "LeftAnti" in p and "hashpartitioning(_bucket" in p


def test_no_single_partition_over_rows_in_default_plans(tx):
    p = _plan(windows.running_invoice_revenue(tx))
    assert "hashpartitioning(_bucket" in p
    # only the bucket statistics (one row per bucket) and one-row aggregates pass one task
    for child in _single_partition_children(p):
        assert "_bucket" in child or "keys=[]" in child, child


def test_rank_columns_of_one_order_are_one_pass(tx):
    p = _plan(windows.customer_rank_in_country(tx, sort=False))
    # one shuffle and one sort serve the three columns
    assert p.count("Exchange hashpartitioning") == 1


def test_first_last_product_sorts_only_the_lines_at_the_ends(tx):
    p = _plan(windows.first_last_product(tx, sort=False))
    assert "Window" not in p and "min_by" in p.lower()
    assert "HashAggregate(keys=[customer_id" in p  # the first and last time
    join = p.index("Join")
    assert "SortAggregate" not in p[join:]  # below the join that drops the other lines


def test_cohorts_use_hash_aggregates(tx):
    for df in (churn.cohort_retention(tx, sort=False), churn.cohort_matrix(tx)):
        p = _plan(df)
        assert "ObjectHashAggregate" not in p and "SortAggregate" not in p and "Window" not in p
        # lines combine in the scan and cross one exchange, by customer; cohorts cross the other
        assert p.count("Exchange hashpartitioning") == 2 and "hashpartitioning(customer_id" in p


def test_churn_flags_read_the_lines_once(tx):
    # the summary is stored: what remains reads one row per customer
    p = _plan(churn.churn_flags(tx, sort=False))
    assert "invoicedate" not in p


def test_cadence_windows_distinct_days_only(tx):
    # the only window runs after a (customer, day) aggregate
    p = _plan(churn.purchase_cadence(tx, sort=False))
    assert p.index("Window") < p.rindex("HashAggregate")


def test_filters_and_pruning_reach_the_scan(spark, tmp_path):
    tx_frame(spark).write.parquet(str(tmp_path / "tx"))
    t = spark.read.parquet(str(tmp_path / "tx"))
    p = _plan(revenue.top_products(t.filter("country = 'UK'")))
    assert "PushedFilters: [IsNotNull(country), EqualTo(country,UK)]" in p
    assert "ReadSchema: struct<stockcode:string,description:string,quantity:int,country:string,revenue:decimal(12,2)>" in p


def test_trusted_lines_read_only_the_columns_used(spark):
    from tillroll.sources.adapter import load_tx
    p = _plan(windows.moving_average(load_tx(spark, "/root/testdata/sf0.001", "trust")))
    assert "n_name" not in p.split("ReadSchema: struct<n_nationkey")[-1][:40]


def test_stored_tables_are_removed(spark, tx, tmp_path):
    import os

    from tillroll.plans.reports import customer_reports
    from tillroll.plans.store import folder, release

    for name, df in customer_reports(tx_frame(spark)).items():
        df.write.parquet(str(tmp_path / name))
    path = folder(spark).removeprefix("file:")
    assert os.listdir(path)
    release(spark)
    assert not os.path.exists(path)
