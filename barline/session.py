"""Session defaults and durable intermediate tables."""

from __future__ import annotations

import hashlib
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL_DIR: dict[str, str] = {}
_LEAST_BUCKETS: dict[tuple[str, str], int] = {}
BUCKET_ROWS = 250_000  # rows of the source's largest table for each bucket


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, memory: str = "12g") -> SparkSession:
    """A session for tests and the local bench; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("barline")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")  # plan building is call-bound
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def work_dir(spark: SparkSession) -> str | None:
    """The shared folder for written intermediates.

    It is the one the cluster names in ``spark.checkpoint.dir``. Where that is unset a
    temporary folder is used in local mode only; on a cluster there is then none, and
    writing a table fails with a message.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir", None
    )
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        return None
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_DIR:
        _LOCAL_DIR[app] = tempfile.mkdtemp(prefix="spark-barline-", dir="/tmp")
    return _LOCAL_DIR[app]


def sized(spark: SparkSession, source: str, rows: int) -> None:
    """Tells how many rows the largest table of ``source`` has; see ``stored``."""
    _LEAST_BUCKETS[(spark.sparkContext.applicationId, source)] = -(-rows // BUCKET_ROWS)


def stored(df: DataFrame, name: str, source: str, keys: list[str], sort: list[str]) -> DataFrame:
    """``df`` written once as a table bucketed by ``keys``, and read back.

    Buckets let every later per-key window, grouping or join start without a shuffle. The
    table outlives lost executors. ``source`` tells tables of different inputs apart. The bucket
    count follows ``spark.sql.shuffle.partitions``, in local mode not beyond twice the
    cores, and grows with the source where ``sized`` was told its rows, so that no bucket does.
    """
    spark = df.sparkSession
    base = work_dir(spark)
    if base is None:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    tag = hashlib.sha256(f"{spark.sparkContext.applicationId}|{source}".encode()).hexdigest()[:12]
    table = f"barline_{name}_{tag}"
    if not spark.catalog.tableExists(table):
        buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        if spark.sparkContext.master.startswith("local"):
            buckets = min(buckets, 2 * spark.sparkContext.defaultParallelism)
        buckets = max(buckets, _LEAST_BUCKETS.get((spark.sparkContext.applicationId, source), 1))
        (
            df.repartition(buckets, *keys)
            .write.format("parquet")
            .mode("overwrite")
            .bucketBy(buckets, *keys)
            .sortBy(*sort)
            .option("path", os.path.join(base, "barline", f"{name}_{tag}"))
            .saveAsTable(table)
        )
    return spark.table(table)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to a new folder under the shared one, and read back: its lineage ends and outlives lost executors."""
    base = work_dir(df.sparkSession)
    if base is None:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    path = os.path.join(base, "barline", f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
