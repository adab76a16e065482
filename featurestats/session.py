"""Session helpers: a local session for tests/bench and a shared work folder.

On a cluster the session is created by the platform; we only read
``spark.checkpoint.dir`` from it.  Only when it is unset (local tests) do we
point it at a fresh scratch folder.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

LOCAL_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.parquet.compression.codec": "zstd",
}


def local_session(
    cores: int | str = 8, shuffle_partitions: int = 8, app: str = "featurestats", checkpoint_dir: str | None = None
) -> SparkSession:
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    builder = builder.config("spark.driver.memory", os.environ.get("FEATURESTATS_DRIVER_MEM", "16g"))
    if checkpoint_dir:
        builder = builder.config("spark.checkpoint.dir", checkpoint_dir)
    for k, v in LOCAL_CONF.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_utc(spark)
    return spark


def cluster_conf(shuffle_bytes: int, target_partition_bytes: int = 256 << 20) -> dict[str, str]:
    """Settings for a large cluster, sized from the expected shuffle volume
    of the biggest job (e.g. a multi-day backfill or a full rollup rebuild).

    * shuffle partitions ≈ shuffle bytes / 256 MB, so every reducer task fits
      in executor memory without spilling much; AQE then coalesces small ones
      and splits skewed ones (joins and REBALANCE writes);
    * scans split at 256 MB with a 8 MB open cost, which packs small files
      (the fragmented-table case) into fewer tasks;
    * the streaming dedup state lives in RocksDB."""
    partitions = max(200, shuffle_bytes // target_partition_bytes)
    return {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_partition_bytes),
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
        "spark.sql.files.maxPartitionBytes": str(target_partition_bytes),
        "spark.sql.files.openCostInBytes": str(8 << 20),
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
        "spark.sql.parquet.compression.codec": "zstd",
        # the default of 128 keys falls back to a sort aggregate for day x segment sketch states
        "spark.sql.objectHashAggregate.sortBased.fallbackThreshold": "65536",
        "spark.sql.streaming.stateStore.providerClass":
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }


def ensure_utc(spark: SparkSession) -> None:
    """Epoch and day arithmetic in this package assumes a UTC session zone."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.  Only when the
    session has none (local tests) is a scratch folder created and set."""
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if root:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(root)
        return root.rstrip("/")
    current = sc.getCheckpointDir()
    if current:
        return current.rstrip("/")
    if not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="featurestats-ckpt-"))
    return sc.getCheckpointDir().rstrip("/")


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique table location under the shared checkpoint folder."""
    return f"{checkpoint_root(spark)}/featurestats/{name}-{uuid.uuid4().hex[:12]}"


def hadoop_path(spark: SparkSession, path: str):
    """(file system, path) on the JVM side; works for every scheme Spark knows."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a table folder exists (Hadoop file system of the path)."""
    fs, p = hadoop_path(spark, path)
    return fs.exists(p)
