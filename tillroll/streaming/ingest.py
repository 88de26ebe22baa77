"""Incremental load: raw extract files arriving in a folder are cleaned,
typed and added to the transaction table.

The same operators as the batch load run on each micro-batch.  A batch is one
load of the table (:mod:`tillroll.sources.sink`): it writes a folder named after the
stream's checkpoint and the batch number, and the table's pointer remembers the
stream's last batch, so a batch retried after a failure lands exactly once, also if
the table was replaced in between, and the loads of the batch loader stay visible.
The checkpoint is a required, stable folder: a restart with it, in any session,
goes on after the last finished batch.
"""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tillroll.operators.clean import clean_transactions, type_transactions
from tillroll.schema import RAW_SCHEMA
from tillroll.sources.raw import parse_raw
from tillroll.sources.sink import commit_load, last_batch, write_load


def start_ingest(spark: SparkSession, source_dir: str, table_path: str, checkpoint: str, *,
                 fmt: str = "parquet", available_now: bool = True,
                 max_files_per_trigger: int | None = None, query_name: str = "tillroll_ingest",
                 timestamp_format: str | None = None, **read_options) -> StreamingQuery:
    """Start the stream and return its handle.

    ``fmt``: format of the arriving files (``parquet``, ``json``, or ``csv`` with a
    header row that names the columns of :data:`RAW_SCHEMA` in this order; a file
    with another header fails).  ``available_now`` processes everything present
    and stops; otherwise the query keeps running and picks up new files.
    """
    reader = spark.readStream.format(fmt).options(**read_options)
    if fmt == "csv":
        # text columns, checked against the header, then parsed like the batch extracts
        text = ", ".join(f"{f.name} string" for f in RAW_SCHEMA.fields)
        reader = reader.option("header", "true").option("enforceSchema", "false").schema(text)
    else:
        reader = reader.schema(RAW_SCHEMA)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    raw = parse_raw(reader.load(source_dir), timestamp_format=timestamp_format)
    typed = type_transactions(clean_transactions(raw))
    stream = f"{query_name}-{zlib.crc32(checkpoint.rstrip('/').encode()):08x}"

    def add(batch: DataFrame, number: int) -> None:
        path, load = table_path.rstrip("/"), f"load={stream}-{number}"
        if last_batch(batch.sparkSession, path, stream) < number:
            write_load(batch, f"{path}/{load}")
            commit_load(batch.sparkSession, path, load, batch.schema, batch=(stream, number))

    writer = typed.writeStream.queryName(query_name).option(
        "checkpointLocation", checkpoint).foreachBatch(add)
    writer = writer.trigger(availableNow=True) if available_now else writer
    return writer.start()
