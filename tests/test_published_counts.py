"""Counts published in FIXTURES.md for the test tables (measured independently)."""

import collections
import os

import pytest
from pyspark.sql import functions as F

from tillroll.functions.metrics import customer_summary
from tillroll.operators import churn, rfm, winback
from tillroll.sources.adapter import load_tx

EXPECTED = {
    "/root/testdata/sf0.001": dict(
        clean=3578, customers=150,
        churn={"Active": 28, "Watch": 11, "At-Risk": 9, "Churned": 102},
        rfm={"Champion": 27, "Big Spender": 16, "Regular": 21, "At-Risk": 29, "Lost": 31,
             "Potential": 26},
        tiers=[22, 36, 39, 14], inactive=(102, 9, 0, 0)),
    "/root/testdata/sf0.01": dict(
        clean=35257, customers=1499,
        churn={"Active": 152, "Watch": 134, "At-Risk": 126, "Churned": 1087},
        rfm={"Champion": 239, "Big Spender": 185, "Regular": 211, "At-Risk": 281, "Lost": 319,
             "Potential": 264},
        tiers=[225, 421, 396, 171], inactive=(1085, 128, 2, 3)),
}


@pytest.mark.parametrize("sf", sorted(EXPECTED))
def test_published_counts(spark, sf):
    if not os.path.isdir(sf):
        pytest.skip("test data not present")
    want = EXPECTED[sf]
    tx = load_tx(spark, sf).cache()
    assert tx.count() == want["clean"]
    flags = churn.churn_flags(tx, sort=False)
    assert flags.count() == want["customers"]
    assert dict(collections.Counter(r.churn_risk for r in flags.collect())) == want["churn"]
    seg = collections.Counter(r.segment for r in rfm.rfm_segments(tx, sort=False).collect())
    assert dict(seg) == want["rfm"]
    tiers = collections.Counter(r.winback_tier for r in winback.winback_priority(tx, sort=False).collect())
    assert [tiers[t] for t in sorted(tiers)] == want["tiers"]
    d = customer_summary(tx).select("days_inactive")
    got = (d.filter(F.col("days_inactive") > 90).count(),
           d.filter(F.col("days_inactive").between(60, 90)).count(),
           d.filter(F.col("days_inactive") == 90).count(),
           d.filter(F.col("days_inactive") == 60).count())
    assert got == want["inactive"]
    tx.unpersist()
