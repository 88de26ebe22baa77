"""Driver contract: entry runs; every query has an oracle; results match at sf0.001."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as E  # noqa: E402
from oracle_check import compare, duck  # noqa: E402
from tillroll.plans.catalog import QUERIES  # noqa: E402
from tillroll.plans.oracle_sql import ORACLE  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "segment" in df.columns


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE) and set(QUERIES) <= set(E.queries())
    assert set(E.oracle_sql()) <= set(E.queries())


@pytest.mark.skipif(not os.path.isdir(SF), reason="test data not present")
def test_queries_match_oracle_small(spark):
    con = duck(SF)
    bad = []
    for name, fn in QUERIES.items():
        r = compare(spark, SF, name, fn, ORACLE[name], con)
        if not r.get("match"):
            bad.append(r)
    assert not bad, bad


@pytest.mark.skipif(not os.path.isdir(SF), reason="test data not present")
def test_results_do_not_depend_on_session_time_zone(spark):
    """Midnight timestamps in a zone whose DST switched at midnight."""
    con = duck(SF)
    names = ["monthly_revenue_growth", "cohort_retention", "cumulative_revenue",
             "purchase_cadence", "order_sequence", "churn_flags"]
    spark.conf.set("spark.sql.session.timeZone", "America/Sao_Paulo")
    spark.conf.set("tillroll.ranking.bucketRows", "300")
    try:
        bad = [r for r in (compare(spark, SF, n, E.queries()[n], E.oracle_sql()[n], con)
                           for n in names) if not r.get("match")]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        spark.conf.unset("tillroll.ranking.bucketRows")
    assert not bad, bad
