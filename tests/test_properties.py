"""Invariants over the sf0.001 test tables and random inputs."""

import collections
import os

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tillroll.operators import churn, clean, revenue, rfm, windows
from tillroll.plans.ranking import RankSpec, add_rankings
from tillroll.sources.adapter import load_tx, raw_lines_from_tables

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test data not present")


@pytest.fixture(scope="module")
def tx(spark):
    return load_tx(spark, SF).cache()


def test_ntile_sizes_and_monotonicity(tx):
    r = rfm.rfm_segments(tx, sort=False).collect()
    for score, key in (("f_score", "frequency"), ("m_score", "monetary")):
        sizes = collections.Counter(getattr(x, score) for x in r)
        assert max(sizes.values()) - min(sizes.values()) <= 1
        ordered = sorted(r, key=lambda x: (getattr(x, key), x.customer_id))
        assert [getattr(x, score) for x in ordered] == sorted(getattr(x, score) for x in ordered)


def test_running_total_and_shares(tx):
    cum = revenue.cumulative_revenue(tx).collect()
    total = tx.agg(F.sum("revenue")).first()[0]
    assert cum[-1].cumulative_revenue == total
    shares = [x.pct_of_total for x in revenue.country_revenue(tx).collect()]
    assert abs(float(sum(shares)) - 100) < 0.01 * len(shares)
    freq = churn.purchase_frequency(tx).collect()
    assert abs(float(sum(x.pct for x in freq)) - 100) < 0.01 * len(freq)


def test_cohort_month_zero_is_everyone(tx):
    for r in churn.cohort_retention(tx).filter("month_number = 0").collect():
        assert r.retained_customers == r.cohort_customers and float(r.retention_rate_pct) == 100.0


def test_audit_counts_add_up(spark):
    a = {r.rule: r.rows for r in clean.cleaning_audit(raw_lines_from_tables(spark, SF)).collect()}
    assert a["input"] == a["missing_customer"] + a["cancellation"] + \
        a["non_positive_quantity_or_price"] + a["valid"]
    assert a["valid"] == load_tx(spark, SF).count()


def test_rank_relations(tx):
    r = windows.customer_rank_in_country(tx, sort=False).collect()
    by_country = collections.defaultdict(list)
    for x in r:
        assert x.rank_in_country >= x.dense_rank_in_country
        by_country[x.country].append(x.row_num_in_country)
    for nums in by_country.values():
        assert sorted(nums) == list(range(1, len(nums) + 1))


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.sampled_from(["x", "y", None]), st.one_of(st.none(), st.integers(0, 4))),
                min_size=1, max_size=60),
       st.integers(1, 9))
def test_bucketed_equals_plain_random(spark, rows, bucket_rows):
    df = spark.createDataFrame([(i, g, m) for i, (g, m) in enumerate(rows)], "id long, g string, m int")
    specs = [RankSpec("rn", "row_number", (("m", False),), ("id",)),
             RankSpec("rk", "rank", (("m", True),)), RankSpec("dr", "dense_rank", (("m", False),)),
             RankSpec("nt", "ntile", (("m", True),), ("id",), n=3)]
    for part in ([], ["g"]):
        plain = add_rankings(df, specs, part)
        dist = add_rankings(df, specs, part, bucket_rows=bucket_rows)
        cols = ["id", "rn", "rk", "dr", "nt"]
        assert sorted(plain.select(cols).collect()) == sorted(dist.select(cols).collect())


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.one_of(st.none(), st.integers(1, 6)), st.one_of(st.none(), st.integers(0, 300))),
                max_size=60), st.sampled_from([0, 1, 6, 12]))
def test_cohorts_equal_the_pairs_of_customer_and_month(spark, lines, max_offset):
    """Calendars longer than any machine word, gaps of whole multiples of the offsets, nulls."""
    import datetime as dt
    df = spark.createDataFrame([(c, None if m is None else dt.datetime(1990 + m // 12, m % 12 + 1, 1 + m % 28))
                                for c, m in lines], "customer_id long, invoicedate timestamp_ntz")
    pairs = {(c, m) for c, m in lines if m is not None}
    first = {c: min(m for d, m in pairs if d == c) for c, _ in pairs}
    want = collections.Counter((first[c], m - first[c]) for c, m in pairs if m - first[c] <= max_offset)
    got = {((r.cohort_month.year - 1990) * 12 + r.cohort_month.month - 1, r.month_number):
           (r.cohort_customers, r.retained_customers)
           for r in churn.cohort_retention(df, max_offset).collect()}
    assert got == {(c, k): (want[c, 0], n) for (c, k), n in want.items()}
    for r in churn.cohort_matrix(df, max_offset, 2).collect():
        cohort = (int(r.cohort_month[:4]) - 1990) * 12 + int(r.cohort_month[5:]) - 1
        assert [v is not None for v in r[1:]] == [(cohort, k) in want for k in range(max_offset + 1)]
