"""Customer summary from parts per load: equal to the summary of all lines, old lines unread."""

import pytest
from pyspark.sql import functions as F

from fixture import tx_frame
from tillroll.functions import summaries
from tillroll.functions.metrics import customer_summary, stored_summary
from tillroll.functions.parts import finished
from tillroll.plans.reports import customer_reports
from tillroll.sources import read_table, write_and_reconcile
from tillroll.sources.adapter import load_tx
from tillroll.sources.sink import table_loads


def _rows(df):
    return sorted((tuple(r) for r in df.select(sorted(df.columns)).collect()), key=repr)


def _load_in_parts(spark, tx, path, k=3):
    """Lines dealt over loads so that a customer's, and an invoice's, lie in several."""
    for i in range(k):
        part = tx.filter(F.pmod(F.xxhash64("stockcode", "invoicedate", "quantity"), F.lit(k)) == i)
        write_and_reconcile(part, path, "append" if i else "overwrite")
        assert len(summaries.refresh_summaries(spark, path)) == 1
    assert summaries.refresh_summaries(spark, path) == []


def test_loads_of_the_test_table_add_up(spark, tmp_path):
    path, tx = str(tmp_path / "tx"), load_tx(spark, "/root/testdata/sf0.001", "trust")
    _load_in_parts(spark, tx, path)
    want, got = stored_summary(tx), summaries.read_summary(spark, path)
    assert [(f.name, f.dataType) for f in got.schema] == [
        (f.name, f.dataType) for f in want.select(got.columns).schema]
    assert _rows(got) == _rows(want)
    assert _rows(summaries.read_summary(spark, path, "2000-01-01")) == _rows(customer_summary(tx, "2000-01-01"))


def test_reports_from_the_parts(spark, tmp_path):
    path, tx = str(tmp_path / "tx"), tx_frame(spark)
    _load_in_parts(spark, tx, path)
    got = customer_reports(None, summary=summaries.read_summary(spark, path))
    for name, df in customer_reports(tx).items():
        assert got[name].collect() == df.collect(), name


def test_a_refresh_reads_the_new_load_only(spark, tmp_path, monkeypatch):
    path, tx = str(tmp_path / "tx"), tx_frame(spark)
    write_and_reconcile(tx.filter("customer_id <= 2"), path)
    summaries.refresh_summaries(spark, path)
    write_and_reconcile(tx.filter("customer_id > 2"), path, "append")
    read = []
    write = summaries._write
    monkeypatch.setattr(summaries, "_write", lambda t, f: (read.extend(
        r.customer_id for r in t.select("customer_id").collect()), write(t, f)))
    assert summaries.refresh_summaries(spark, path) == table_loads(spark, path)[1:]
    assert read and min(read) > 2


def test_replace_and_broken_off_refresh(spark, tmp_path, monkeypatch):
    path, tx = str(tmp_path / "tx"), tx_frame(spark)
    with pytest.raises(FileNotFoundError):
        summaries.read_summary(spark, path)
    write_and_reconcile(tx, path)
    with pytest.raises(ValueError, match="without summaries"):
        summaries.read_summary(spark, path)

    def killed(t, folder):
        summaries.order_part(t.limit(1)).write.parquet(f"{folder}/orders")
        raise RuntimeError("killed")

    with monkeypatch.context() as m:
        m.setattr(summaries, "_write", killed)
        with pytest.raises(RuntimeError, match="killed"):
            summaries.refresh_summaries(spark, path)
    with pytest.raises(ValueError, match="without summaries"):
        summaries.read_summary(spark, path)
    summaries.refresh_summaries(spark, path)
    assert _rows(summaries.read_summary(spark, path)) == _rows(stored_summary(tx))
    write_and_reconcile(tx.filter("customer_id = 1"), path)
    summaries.refresh_summaries(spark, path)
    assert finished(spark, path, "summaries", "products") == set(table_loads(spark, path))
    assert [r.customer_id for r in summaries.read_summary(spark, path).collect()] == [1]


def test_nulls_and_no_lines(spark):
    tx = tx_frame(spark)
    odd = tx.withColumn("invoice", F.when(F.col("customer_id") != 1, F.col("invoice"))).withColumn(
        "stockcode", F.when(F.col("stockcode") != "10", F.col("stockcode"))).withColumn(
        "customer_id", F.when(F.col("customer_id") != 3, F.col("customer_id")))
    for t in (odd, odd.withColumn("invoicedate", F.lit(None).cast("timestamp_ntz")), tx.filter("false")):
        twice = [p(t).unionByName(p(t)) for p in (summaries.order_part, summaries.product_part)]
        want = customer_summary(t, recency=False)
        got = summaries.merged_summary(*[p(t) for p in (summaries.order_part, summaries.product_part)])
        assert _rows(got) == _rows(want)
        again = summaries.merged_summary(*twice)  # the same keys in two loads count once
        keep = ["customer_id", "total_orders", "unique_products", "first_purchase"]
        assert _rows(again.select(keep)) == _rows(want.select(keep))


def test_no_line_is_expanded(spark, tmp_path):
    path = str(tmp_path / "tx")
    write_and_reconcile(tx_frame(spark), path)
    summaries.refresh_summaries(spark, path)
    lines = read_table(spark, path)
    for df in (summaries.order_part(lines), summaries.product_part(lines),
               summaries.read_summary(spark, path, recency=False)):
        p = df._jdf.queryExecution().executedPlan().toString()
        assert "Expand" not in p and "Join" not in p and "SortAggregate" not in p
