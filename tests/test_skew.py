"""One customer holding a third of all orders: every query still matches the
DuckDB oracle, with rankings in buckets of 40 rows."""

import os

import pytest
from pyspark.sql import functions as F

from oracle_check import duck, rows_of
from tillroll.operators.clean import clean_transactions, type_transactions
from tillroll.plans.catalog import QUERIES
from tillroll.plans.oracle_sql import ORACLE
from tillroll.sources.adapter import raw_lines_from_tables

SF = os.environ.get("SKEW_SF_DIR", "/root/testdata/sf0.001")
HOT = 7
_ORDER_KEY = "CAST(regexp_replace(invoice, '^C', '') AS BIGINT)"
_SQL_FROM = "  FROM raw\n  WHERE customer_id IS NOT NULL"
_SQL_SKEWED = (f"  FROM (SELECT * REPLACE (CASE WHEN customer_id IS NOT NULL AND {_ORDER_KEY} % 3 = 1 "
               f"THEN {HOT} ELSE customer_id END AS customer_id) FROM raw) raw\n"
               "  WHERE customer_id IS NOT NULL")


def skewed_tx(spark, sf_dir):
    raw = raw_lines_from_tables(spark, sf_dir)
    okey = F.regexp_replace("invoice", "^C", "").cast("bigint")
    raw = raw.withColumn("customer_id", F.when(F.col("customer_id").isNotNull() & (okey % 3 == 1),
                                               F.lit(HOT).cast("bigint"))
                         .otherwise(F.col("customer_id")))
    return type_transactions(clean_transactions(raw))


@pytest.mark.skipif(not os.path.isdir(SF), reason="test data not present")
def test_hot_customer_matches_oracle(spark):
    assert _SQL_FROM in ORACLE["transactions"]
    spark.conf.set("tillroll.ranking.bucketRows", "40")  # the hot customer spans many buckets
    try:
        tx = skewed_tx(spark, SF).cache()
        con = duck(SF)
        share = tx.filter(F.col("customer_id") == HOT).count() / tx.count()
        assert share > 0.3
        bad = []
        for name, q in QUERIES.items():
            if not hasattr(q, "on_tx"):
                continue
            df = q.on_tx(tx)
            rel = con.sql(ORACLE[name].replace(_SQL_FROM, _SQL_SKEWED))
            a = rows_of(df.columns, [tuple(r) for r in df.collect()])
            b = rows_of(rel.columns, rel.fetchall())
            if a != b:
                bad.append((name, len(a), len(b)))
        assert not bad, bad
    finally:
        spark.conf.unset("tillroll.ranking.bucketRows")
