"""Session construction and the shared folder for intermediate tables."""

from __future__ import annotations

from pyspark.sql import SparkSession

_CHECKPOINT_CONF = "spark.checkpoint.dir"


def build_session(master: str | None = None, app: str = "tillroll",
                  shuffle_partitions: int | None = None, extra: dict | None = None) -> SparkSession:
    """A session with the settings every operator assumes (AQE, UTC, no UI)."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables that all executors reach.

    It is named by ``spark.checkpoint.dir``. Only a ``local[...]`` session may
    leave it unset (driver and executor are one process there) and gets a
    folder below its warehouse; on a cluster an unset folder is an error.
    """
    configured = spark.conf.get(_CHECKPOINT_CONF, None)
    if configured:
        return configured
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return sc.getCheckpointDir()
    if not sc.master.startswith("local["):
        raise RuntimeError(
            "spark.checkpoint.dir is not set: point it at a folder every executor can reach")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_intermediate"


def scale_conf(input_bytes: float, executor_cores_total: int,
               target_partition_bytes: int = 256 * 1024 ** 2) -> dict:
    """Spark settings sized for an input of ``input_bytes`` on a cluster
    with ``executor_cores_total`` task slots.

    * shuffle partitions: enough for ~``target_partition_bytes`` per reducer
      on the largest shuffle (the fact table before partial aggregation),
      at least 3 waves of the cluster; AQE then coalesces small ones and
      splits skewed ones, so the number is an upper bound, not a target;
    * scan splits of 512 MiB (fewer, larger tasks over Parquet row groups);
    * the broadcast threshold is left at Spark's runtime-size check.
    """
    shuffle = max(3 * executor_cores_total, int(input_bytes // target_partition_bytes))
    return {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(shuffle),
        "spark.sql.shuffle.partitions": str(shuffle),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_partition_bytes),
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.files.maxPartitionBytes": str(512 * 1024 ** 2),
        "spark.sql.session.timeZone": "UTC",
    }
