"""Incremental ingest equals the batch load, keeps its rows, and resumes without duplicates."""

import pytest
from pyspark.sql import functions as F

from fixture import raw_frame, tx_frame
from tillroll.schema import TX_SCHEMA
from tillroll.sources import read_table, sink, write_and_reconcile
from tillroll.streaming import start_ingest


def _rows(df):
    return sorted(tuple(str(v) for v in r) for r in df.select(*TX_SCHEMA.fieldNames()).collect())


def _parts(spark):
    raw = raw_frame(spark)
    early = F.col("invoicedate") < F.lit("2011-11-01").cast("timestamp_ntz")
    return raw.filter(early), raw.filter(~early)


def test_stream_matches_batch_and_resumes_in_another_session(spark, tmp_path):
    src, table, ck = str(tmp_path / "in"), str(tmp_path / "tx"), str(tmp_path / "ck")
    early, late = _parts(spark)
    early.write.parquet(src + "/part1")
    start_ingest(spark, src + "/*", table, ck).awaitTermination(120)
    first = spark.read.parquet(table).count()
    late.write.parquet(src + "/part2")
    other = spark.newSession()
    for _ in range(2):  # the second run finds nothing new
        start_ingest(other, src + "/*", table, ck).awaitTermination(120)
    got = spark.read.parquet(table)
    assert 0 < first < got.count()
    assert _rows(got) == _rows(tx_frame(spark))


def test_batch_load_then_stream_keeps_all_rows(spark, tmp_path):
    src, table, ck = str(tmp_path / "in"), str(tmp_path / "tx"), str(tmp_path / "ck")
    early, late = _parts(spark)
    from tillroll.operators.clean import clean_transactions, type_transactions
    write_and_reconcile(type_transactions(clean_transactions(early)), table)
    late.write.parquet(src + "/part1")
    start_ingest(spark, src + "/*", table, ck).awaitTermination(120)
    assert _rows(spark.read.parquet(table)) == _rows(tx_frame(spark))


def test_csv_stream_parses_text_and_checks_the_header(spark, tmp_path):
    src, table = tmp_path / "in", str(tmp_path / "tx")
    src.mkdir()
    head = "invoice,stockcode,description,quantity,invoicedate,price,customer_id,country\n"
    (src / "a.csv").write_text(head + "A1,10,LAMP,2,12/9/2011 10:00,5.00,13085.0,UK\n")
    start_ingest(spark, str(src), table, str(tmp_path / "ck"), fmt="csv",
                 timestamp_format="M/d/yyyy H:mm").awaitTermination(120)
    r = spark.read.parquet(table).first()
    assert (r.customer_id, str(r.invoicedate), str(r.revenue)) == (13085, "2011-12-09 10:00:00", "10.00")
    (src / "b.csv").write_text(head.replace("invoice,stockcode", "stockcode,invoice") + "10,A2,x,1,12/9/2011 10:00,1,1,UK\n")
    q = start_ingest(spark, str(src), table, str(tmp_path / "ck"), fmt="csv",
                     timestamp_format="M/d/yyyy H:mm")
    with pytest.raises(Exception):
        q.awaitTermination(120)


def test_checkpoint_is_required(spark, tmp_path):
    with pytest.raises(TypeError):
        start_ingest(spark, str(tmp_path), str(tmp_path / "t"))


def test_retried_batch_lands_once_and_a_replaced_batch_stays_gone(spark, tmp_path, monkeypatch):
    src, table, ck = str(tmp_path / "in"), str(tmp_path / "tx"), str(tmp_path / "ck")
    raw_frame(spark).write.parquet(src + "/part1")
    commit = sink.commit_load

    def fails(*args, **kw):
        commit(*args, **kw)
        raise OSError("lost after the commit")

    import tillroll.streaming.ingest as ingest
    with monkeypatch.context() as m:
        m.setattr(ingest, "commit_load", fails)
        with pytest.raises(Exception, match="lost after the commit"):
            start_ingest(spark, src + "/*", table, ck).awaitTermination(120)
    assert read_table(spark, table).count() == 10
    start_ingest(spark, src + "/*", table, ck).awaitTermination(120)
    assert read_table(spark, table).count() == 10
    write_and_reconcile(tx_frame(spark).limit(2), table)
    assert read_table(spark, table).count() == 2
    raw_frame(spark).limit(1).write.parquet(src + "/part2")
    start_ingest(spark, src + "/*", table, ck).awaitTermination(120)
    assert read_table(spark, table).count() == 3
