"""Write the transaction table and reconcile the stored row count.

A table is a folder of loads, ``<path>/load=<name>/invoice_month=<month>/``, so
the batch load, appended loads and the streaming loader share one layout.  Which
loads are the table is said by the pointer of highest number in ``<path>/_loads``,
a small JSON file that names them.  A load writes its own folder, counts what was
stored, and puts the next pointer in place by one rename of a finished small file:
up to that rename :func:`read_table` reads the old table, from then on the new
one, and no data file is ever moved.  Replaced loads are removed after it.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Pointers kept beside the newest, for readers that listed the folder a moment ago.
KEPT_POINTERS = 10


class ReconciliationError(RuntimeError):
    """The stored row count of a load differs from the rows written."""


def _path(spark: SparkSession, path: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)


def _fs(spark: SparkSession, path: str):
    """Hadoop file system and path object of a path."""
    where = _path(spark, path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def _delete(spark: SparkSession, path: str) -> None:
    fs, where = _fs(spark, path)
    fs.delete(where, True)


def _raised(error: Py4JJavaError, name: str) -> bool:
    return error.java_exception.getClass().getSimpleName() == name


def _read_text(spark: SparkSession, path: str) -> str:
    fs, where = _fs(spark, path)
    stream = fs.open(where)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def _numbers(spark: SparkSession, path: str) -> list[int]:
    fs, where = _fs(spark, f"{path}/_loads")
    if not fs.exists(where):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(where)]
    return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())


def _pointer(spark: SparkSession, path: str) -> tuple[int, dict | None]:
    """Number and content of the newest pointer; (-1, None) where there is no table."""
    while numbers := _numbers(spark, path):
        try:
            return numbers[-1], json.loads(_read_text(spark, f"{path}/_loads/{numbers[-1]:012d}.json"))
        except Py4JJavaError as e:  # superseded and removed since it was listed
            if not _raised(e, "FileNotFoundException"):
                raise
    return -1, None


def _point(spark: SparkSession, path: str, number: int, content: dict) -> bool:
    """Put pointer ``number`` in place; False if another load was first."""
    jvm = spark.sparkContext._jvm
    made, target = f"{path}/_loads/_{uuid.uuid4().hex}", f"{path}/_loads/{number:012d}.json"
    fs, where = _fs(spark, made)
    out = fs.create(where, False)
    try:
        out.write(bytearray(json.dumps(content).encode()))
    finally:
        out.close()
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(
        fs.makeQualified(where).toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(
        getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    try:
        files.rename(fs.makeQualified(where), fs.makeQualified(_path(spark, target)), options)
    except Py4JJavaError as e:
        if not _raised(e, "FileAlreadyExistsException"):
            raise
        fs.delete(where, False)
        return False
    return True


def _types(schema: T.StructType) -> list[tuple[str, str]]:
    return [(f.name, f.dataType.simpleString()) for f in schema.fields]


def commit_load(spark: SparkSession, path: str, load: str, schema: T.StructType, replace: bool = False,
                by_month: bool = True, batch: tuple[str, int] | None = None) -> bool:
    """Make the written folder ``<path>/<load>`` part of the table, or (``replace``) all of it.

    ``batch`` is a stream's name and batch number; the pointer remembers a stream's last
    batch, and a batch that is not newer adds nothing (the result is False).  A load that
    loses the race for a pointer number builds on the winner's pointer.  On a store whose
    rename can overwrite (most object stores) run one loader at a time.
    """
    while True:
        number, now = _pointer(spark, path)
        old = now or {"loads": [], "streams": {}}
        if batch and old["streams"].get(batch[0], -1) >= batch[1]:
            return False
        if old["loads"] and not replace and (_types(T.StructType.fromJson(old["schema"])) != _types(schema)
                                             or old["by_month"] != by_month):
            raise ValueError("the load has another schema or layout than the table")
        new = {"loads": [load] if replace else [*(x for x in old["loads"] if x != load), load],
               "schema": json.loads(schema.json()), "by_month": by_month,
               "streams": {**old["streams"], **({batch[0]: batch[1]} if batch else {})}}
        if _point(spark, path, number + 1, new):
            break
    for gone in set(old["loads"]) - set(new["loads"]):
        _delete(spark, f"{path}/{gone}")
    for n in _numbers(spark, path)[:-1 - KEPT_POINTERS]:
        _delete(spark, f"{path}/_loads/{n:012d}.json")
    return True


def last_batch(spark: SparkSession, path: str, stream: str) -> int:
    """Number of the last batch of a stream that the table holds (-1: none)."""
    return (_pointer(spark, path.rstrip("/"))[1] or {"streams": {}})["streams"].get(stream, -1)


def table_loads(spark: SparkSession, path: str) -> list[str]:
    """Folder names of the loads that are the table at ``path`` now."""
    return (_pointer(spark, path.rstrip("/"))[1] or {"loads": []})["loads"]


def read_table(spark: SparkSession, path: str, loads: list[str] | None = None) -> DataFrame:
    """The table at ``path``: the loads that its newest pointer names (or those of them in
    ``loads``), with the columns ``load`` and ``invoice_month``.  Loads under way or broken
    off are not read.

    A reader that must outlast a replacement of the table it reads keeps a copy."""
    path = path.rstrip("/")
    _, now = _pointer(spark, path)
    if now is None:
        raise FileNotFoundError(f"no table at {path}")
    schema = T.StructType.fromJson(now["schema"]).add("load", "string")
    if now["by_month"]:
        schema = schema.add("invoice_month", "string")
    return (spark.read.schema(schema).option("basePath", path)
            .parquet(*[f"{path}/{x}" for x in now["loads"] if loads is None or x in loads]))


def vacuum(spark: SparkSession, path: str) -> list[str]:
    """Remove what killed loads left: load folders that no pointer names and unfinished
    pointers.  Run it while no load is under way; returns the names removed."""
    path = path.rstrip("/")
    _, now = _pointer(spark, path)
    keep = set(now["loads"]) if now else set()
    gone = []
    for where, left in ((path, lambda n: n.startswith("load=") and n not in keep),
                        (f"{path}/_loads", lambda n: n.startswith("_"))):
        fs, folder = _fs(spark, where)
        names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
        for name in filter(left, names):
            _delete(spark, f"{where}/{name}")
            gone.append(name)
    return sorted(gone)


def _observed_rows(obs) -> int:
    """The rows observed; none where Catalyst proved the input empty and dropped the
    observation with it (the count of the stored rows checks this too)."""
    try:
        return int(obs.get["rows"])
    except Py4JJavaError as e:
        if not _raised(e, "AssertionError"):
            raise
        return 0


def write_load(tx: DataFrame, folder: str, partition_by_month: bool = True) -> None:
    """Write ``tx`` as Parquet files of one load, by ``invoice_month`` (date
    pruning).  The ``rebalance`` hint lets AQE size the write tasks by data
    volume and split a hot month over several tasks."""
    if partition_by_month:
        (tx.withColumn("invoice_month", F.date_format("invoicedate", "yyyy-MM"))
           .hint("rebalance", "invoice_month")
           .write.mode("overwrite").partitionBy("invoice_month").parquet(folder))
    else:
        tx.hint("rebalance").write.mode("overwrite").parquet(folder)


def write_and_reconcile(tx: DataFrame, path: str, mode: str = "overwrite",
                        partition_by_month: bool = True, table: str | None = None) -> DataFrame:
    """Load ``tx`` into the table at ``path``; returns ``rows_expected, rows_written``.

    The load is written to a folder of its own, counted as stored, and compared with
    the count observed on the write itself (the input is scanned once).  Then the
    next pointer names it: alone (``overwrite``) or beside the loads before
    (``append``).  A load that fails, is killed or does not agree leaves the table,
    as :func:`read_table` sees it, as it was.  With ``table``, the folder is also
    registered as that catalog table.
    """
    from pyspark.sql import Observation

    if mode not in ("overwrite", "append"):
        raise ValueError("mode must be 'overwrite' or 'append'")
    spark, path = tx.sparkSession, path.rstrip("/")
    load = f"load={uuid.uuid4().hex}"
    obs = Observation("rows_expected")
    try:
        write_load(tx.observe(obs, F.count(F.lit(1)).alias("rows")), f"{path}/{load}",
                   partition_by_month)
        expected = _observed_rows(obs)
        written = spark.read.schema(tx.schema).parquet(f"{path}/{load}").count()
        if written != expected:
            raise ReconciliationError(f"{written} of {expected} rows were stored")
        commit_load(spark, path, load, tx.schema, replace=mode == "overwrite", by_month=partition_by_month)
    except BaseException:
        if load not in (_pointer(spark, path)[1] or {"loads": []})["loads"]:
            _delete(spark, f"{path}/{load}")
        raise
    if table:
        if not spark.catalog.tableExists(table):
            spark.catalog.createTable(table, path=path, source="parquet")
        spark.sql(f"MSCK REPAIR TABLE {table} SYNC PARTITIONS")
    return spark.createDataFrame([(expected, written)], "rows_expected bigint, rows_written bigint")


def write_jdbc(tx: DataFrame, url: str, table: str, properties: dict | None = None,
               batchsize: int = 5000, mode: str = "overwrite",
               num_partitions: int | None = None) -> DataFrame:
    """O06 for a database sink: Spark's JDBC writer with multi-row batches of
    ``batchsize``; overwrite truncates the existing table (keeps its DDL,
    constraints and indexes) instead of dropping it.  ``num_partitions`` caps
    the concurrent connections (a shuffle, so that reading and cleaning keep
    their own parallelism).  Returns ``rows_expected, rows_written``; the
    written count is a pushed-down ``COUNT(*)``, for ``append`` less the count
    before.  Credentials come from ``properties``, never from code.
    """
    from pyspark.sql import Observation

    spark, props = tx.sparkSession, dict(properties or {})

    def stored_rows():
        return int(spark.read.format("jdbc").option("url", url)
                   .option("query", f"SELECT COUNT(*) AS n FROM {table}")
                   .options(**props).load().first()[0])

    before = stored_rows() if mode == "append" else 0
    obs = Observation("rows_expected")
    out = tx.observe(obs, F.count(F.lit(1)).alias("rows"))
    if num_partitions:
        out = out.repartition(num_partitions)
    (out.write.format("jdbc").mode(mode).option("url", url).option("dbtable", table)
        .option("batchsize", str(batchsize)).option("truncate", "true")
        .options(**props).save())
    return spark.createDataFrame([(int(obs.get["rows"]), stored_rows() - before)],
                                 "rows_expected bigint, rows_written bigint")
