"""Approximate distinct counts: exact revenue, bounded error, one sketch set per load."""

import pytest
from pyspark.sql import functions as F

from fixture import tx_frame
from tillroll.functions import sketches
from tillroll.operators import revenue
from tillroll.sources import read_table, write_and_reconcile
from tillroll.sources.adapter import load_tx


def _rows(df, key):
    return {r[key]: r.asDict() for r in df.collect()}


def test_small_counts_are_exact(spark):
    tx = tx_frame(spark)
    for op, key in ((revenue.monthly_revenue_growth, "month"), (revenue.country_revenue, "country")):
        assert op(tx, approx=True).collect() == op(tx).collect(), key


def test_error_and_columns_on_the_test_table(spark):
    tx = load_tx(spark, "/root/testdata/sf0.01", "trust")
    for op, key in ((revenue.monthly_revenue_growth, "month"), (revenue.country_revenue, "country")):
        want, got = op(tx), op(tx, approx=True)
        assert got.columns == want.columns
        want, got = _rows(want, key), _rows(got, key)
        assert want.keys() == got.keys()
        for k, r in want.items():
            for c, v in r.items():
                if c in ("unique_customers", "total_orders"):
                    assert abs(got[k][c] - v) <= 0.04 * v, (k, c)  # five standard errors
                else:
                    assert got[k][c] == v, (k, c)


def test_sketches_of_loads_are_merged_and_follow_the_table(spark, tmp_path):
    path, tx = str(tmp_path / "tx"), tx_frame(spark)
    write_and_reconcile(tx.filter("customer_id <= 2"), path)
    with pytest.raises(ValueError, match="without sketches"):
        sketches.read_sketches(spark, path)
    assert len(sketches.refresh_sketches(spark, path)) == 1
    # the second load repeats a customer and an invoice of the first
    write_and_reconcile(tx.filter("customer_id > 2 OR invoice = 'A100'"), path, "append")
    assert len(sketches.refresh_sketches(spark, path)) == 1 and not sketches.refresh_sketches(spark, path)
    got = revenue.monthly_revenue_growth(None, approx=sketches.read_sketches(spark, path))
    assert got.collect() == revenue.monthly_revenue_growth(read_table(spark, path)).collect()
    write_and_reconcile(tx.limit(1), path)
    sketches.refresh_sketches(spark, path)
    assert revenue.country_revenue(None, approx=sketches.read_sketches(spark, path)).count() == 1


def test_sketches_with_nulls_and_without_rows(spark):
    tx = tx_frame(spark)
    odd = tx.withColumn("customer_id", F.lit(None).cast("long")).withColumn("country", F.lit(None).cast("string"))
    r = revenue.country_revenue(odd, approx=True).first()
    assert (r.country, r.unique_customers, r.total_orders) == (None, 0, odd.select("invoice").distinct().count())
    assert revenue.country_revenue(tx.filter("false"), approx=True).collect() == []
