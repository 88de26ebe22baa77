"""Raw sources (O01, O02) and the table writer."""

import pytest
from pyspark.sql import functions as F

from fixture import ROWS, raw_frame, tx_frame
from tillroll.sources import (normalize_columns, read_raw, read_table, sink, union_sources, vacuum,
                              write_and_reconcile)

HEADER = "Invoice,StockCode,Description,Quantity,InvoiceDate,Price, Customer ID ,Country"


def _csv(path, rows):
    with open(path, "w") as f:
        f.write(HEADER + "\n")
        for r in rows:
            f.write(",".join("" if v is None else str(v) for v in r) + "\n")


def test_read_raw_csv_extracts(spark, tmp_path):
    a, b = tmp_path / "y1.csv", tmp_path / "y2.csv"
    _csv(a, ROWS[:9])
    _csv(b, ROWS[9:] + ROWS[:1])  # duplicates across extracts are kept
    raw = read_raw(spark, [str(a), str(b)], fmt="csv")
    assert raw.columns == ["invoice", "stockcode", "description", "quantity", "invoicedate",
                           "price", "customer_id", "country"]
    assert raw.count() == 16
    ref = sorted(tuple(str(v) for v in r) for r in raw_frame(spark).collect())
    got = sorted(tuple(str(v) for v in r) for r in raw.collect())
    assert sorted(set(got)) == sorted(set(ref))


def test_normalize_and_union(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int").toDF(" Customer ID ", "Price")
    assert normalize_columns(df).columns == ["customer_id", "price"]
    with pytest.raises(ValueError):
        normalize_columns(spark.createDataFrame([(1, 2)], "a int, b int").toDF("A b", "a B"))
    u = union_sources(spark.range(3), spark.range(2).withColumn("x", F.lit(1)))
    assert u.count() == 5 and u.columns == ["id", "x"]


def _write(path, text):
    with open(path, "w") as f:
        f.write(text)


def test_header_decides_the_columns_whatever_their_order(spark, tmp_path):
    p = tmp_path / "reordered.csv"
    _write(p, "Country,Price,Customer ID,InvoiceDate,Quantity,Description,StockCode,Invoice\n"
              "UK,5.00,13085.0,12/9/2011 10:00,2,LAMP,10,A100\n,1.25,,1/2/2012 0:05,1.0,,11,A101\n")
    raw = read_raw(spark, str(p), fmt="csv", timestamp_format="M/d/yyyy H:mm").collect()
    got = sorted(tuple(None if v is None else str(v) for v in r) for r in raw)
    assert got == [
        ("A100", "10", "LAMP", "2", "2011-12-09 10:00:00", "5.0000", "13085", "UK"),
        ("A101", "11", None, "1", "2012-01-02 00:05:00", "1.2500", None, None)]


def test_missing_column_is_an_error_that_names_it(spark, tmp_path):
    p = tmp_path / "typo.csv"
    _write(p, HEADER.replace(" Customer ID ", "CustomerID") + "\nA,1,x,1,2011-12-09 10:00:00,1,7,UK\n")
    with pytest.raises(ValueError, match="customer_id"):
        read_raw(spark, str(p), fmt="csv")
    q = tmp_path / "short.csv"
    _write(q, "Invoice,StockCode,Quantity,InvoiceDate,Price,Customer ID\nA,1,1,2011-12-09 10:00:00,1,7\n")
    with pytest.raises(ValueError, match="description"):
        read_raw(spark, str(q), fmt="csv")
    raw = read_raw(spark, str(q), fmt="csv", optional=("description", "country")).first()
    assert (raw.invoice, raw.customer_id, raw.description, raw.country) == ("A", 7, None, None)


def test_unreadable_values_fail(spark, tmp_path):
    p = tmp_path / "bad.csv"
    _write(p, HEADER + "\nA,1,x,1,9th of May,1,7,UK\n")
    with pytest.raises(Exception, match="9th of May"):
        read_raw(spark, str(p), fmt="csv").collect()


def test_range_violations_are_rejected_and_reported(spark):
    from tillroll.operators.clean import clean_transactions, transaction_rejects, type_transactions
    raw = raw_frame(spark).filter("invoice = 'A100'").withColumn("price", F.lit("99999999.00").cast("decimal(20,2)"))
    rows = clean_transactions(raw.withColumn("quantity", F.when(F.col("stockcode") == "10", 2).otherwise(101)))
    assert [r.stockcode for r in type_transactions(rows, "drop").collect()] == ["10"]
    assert [(r.stockcode, r.violations) for r in transaction_rejects(rows).collect()] == [
        ("11", "revenue out of range")]
    dear = rows.withColumn("price", F.lit("100000000.00").cast("decimal(20,2)")).filter("stockcode = '10'")
    assert transaction_rejects(dear).first().violations == "price out of range"
    with pytest.raises(Exception, match="revenue out of range"):
        type_transactions(rows).collect()


def test_write_and_reconcile(spark, tmp_path):
    path = str(tmp_path / "tx")
    out = write_and_reconcile(tx_frame(spark), path).first()
    assert (out.rows_expected, out.rows_written) == (10, 10)
    back = spark.read.parquet(path)
    assert "invoice_month" in back.columns
    assert back.filter("invoice_month = '2011-12'").count() == 2
    # append counts its own rows, and adds them
    more = tx_frame(spark).limit(3)
    out = write_and_reconcile(more, path, mode="append").first()
    assert (out.rows_expected, out.rows_written) == (3, 3)
    assert spark.read.parquet(path).count() == 13
    # replace leaves only the new rows and nothing beside the table
    assert write_and_reconcile(more, path).first().rows_written == 3
    assert spark.read.parquet(path).count() == 3
    assert [p.name for p in tmp_path.iterdir()] == ["tx"]


def test_failing_load_leaves_the_old_table(spark, tmp_path):
    path = str(tmp_path / "tx")
    write_and_reconcile(tx_frame(spark), path)
    broken = tx_frame(spark).withColumn("invoice", F.raise_error(F.lit("no more")).cast("string"))
    with pytest.raises(Exception, match="no more"):
        write_and_reconcile(broken, path)
    assert spark.read.parquet(path).count() == 10
    assert [p.name for p in tmp_path.iterdir()] == ["tx"]


def test_write_to_catalog_table(spark, tmp_path):
    for rows in (10, 10):  # made, then replaced
        out = write_and_reconcile(tx_frame(spark), str(tmp_path / "t"), table="tx_fixture_tbl").first()
        assert (out.rows_expected, out.rows_written) == (rows, rows)
        assert spark.table("tx_fixture_tbl").filter("invoice_month = '2011-11'").count() == 4
    spark.sql("DROP TABLE tx_fixture_tbl")


def test_clean_with_audit_counts_during_the_write(spark):
    from tillroll.operators.clean import clean_with_audit
    cleaned, obs = clean_with_audit(raw_frame(spark))
    cleaned.write.format("noop").mode("overwrite").save()
    assert obs.get == {"input": 15, "missing_customer": 2, "cancellation": 1,
                       "non_positive_quantity_or_price": 2}


class Killed(BaseException):
    """The loader's process is gone: nothing after it runs, no clean-up either."""


STEPS = ["write_load", "_pointer", "commit_load", "_point", "_delete"]


@pytest.mark.parametrize("mode", ["overwrite", "append"])
@pytest.mark.parametrize("after", [False, True])
@pytest.mark.parametrize("step", STEPS)
def test_killed_load_leaves_the_old_or_the_new_table(spark, tmp_path, monkeypatch, step, after, mode):
    path = str(tmp_path / "tx")
    write_and_reconcile(tx_frame(spark), path)
    dead = []

    def dying(name, real):
        def run(*args, **kw):
            if dead:
                raise Killed(name)
            if name == step:
                if after:
                    real(*args, **kw)
                dead.append(name)
                raise Killed(name)
            return real(*args, **kw)
        return run

    with monkeypatch.context() as m:
        for name in STEPS:
            m.setattr(sink, name, dying(name, getattr(sink, name)))
        if step == "_delete" and mode == "append":
            assert write_and_reconcile(tx_frame(spark).limit(3), path, mode).first().rows_written == 3
        else:
            with pytest.raises(Killed):
                write_and_reconcile(tx_frame(spark).limit(3), path, mode)
    new = 13 if mode == "append" else 3
    committed = step == "_delete" or (after and step in ("commit_load", "_point"))
    assert read_table(spark, path).count() == (new if committed else 10)
    # what the dead load left goes away, and the table goes on
    vacuum(spark, path)
    held = new if committed else 10
    assert read_table(spark, path).count() == spark.read.parquet(path).count() == held
    write_and_reconcile(tx_frame(spark).limit(2), path, "append")
    assert read_table(spark, path).count() == held + 2


def test_loads_that_race_for_a_pointer_both_land(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "tx")
    write_and_reconcile(tx_frame(spark), path)
    point, raced = sink._point, []

    def second(*args):
        if not raced:
            raced.append(True)
            write_and_reconcile(tx_frame(spark).limit(4), path, "append")
        return point(*args)

    monkeypatch.setattr(sink, "_point", second)
    write_and_reconcile(tx_frame(spark).limit(3), path, "append")
    assert read_table(spark, path).count() == 17


def test_read_table_prunes_months_and_checks_the_schema(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sink, "KEPT_POINTERS", 2)
    path = str(tmp_path / "tx")
    with pytest.raises(FileNotFoundError):
        read_table(spark, path)
    write_and_reconcile(tx_frame(spark).limit(0), path)  # an empty load is a table
    assert read_table(spark, path).count() == 0
    for _ in range(sink.KEPT_POINTERS + 3):
        write_and_reconcile(tx_frame(spark), path)
    t = read_table(spark, path).filter("invoice_month = '2011-12'")
    assert t.count() == 2 and "PartitionFilters: [isnotnull(invoice_month" in (
        t._jdf.queryExecution().executedPlan().toString())
    assert len(sink._numbers(spark, path)) == sink.KEPT_POINTERS + 1
    with pytest.raises(ValueError, match="schema"):
        write_and_reconcile(tx_frame(spark).withColumn("extra", F.lit(1)), path, "append")
    assert read_table(spark, path).count() == spark.read.parquet(path).count() == 10
