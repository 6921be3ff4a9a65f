"""Session construction and small cluster-safety helpers."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
_SCRATCH: set[str] = set()  # scratch folders of this process's sessions


# Settings for a large cluster (e.g. 1000 executors over ~100 TB of parquet): let AQE
# pick the reducer count from a high initial value and an advisory size, keep input
# splits at 256 MB, split skewed join partitions, and keep broadcasts explicit.
CLUSTER_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "40000",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256m",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1g",
    "spark.sql.files.maxPartitionBytes": "256m",
    "spark.sql.shuffle.partitions": "40000",
    "spark.sql.autoBroadcastJoinThreshold": "64m",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.session.timeZone": "UTC",
}


def build_session(master: str = "local[*]", shuffle_partitions: int = 8,
                  app_name: str = "poicraft", extra_conf: dict | None = None) -> SparkSession:
    """Session for tests and local benches. On a cluster, pass your own session
    (or ``extra_conf=CLUSTER_CONF`` as a starting point)."""
    builder = SparkSession.builder
    for key, value in (extra_conf or {}).items():
        builder = builder.config(key, value)
    spark = (
        builder.master(master)
        .appName(app_name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for checkpoints and scratch output.

    Read from ``spark.checkpoint.dir``; only when the session leaves it unset on a
    local master (tests, local runs) a fresh folder of our own is used. On a
    cluster an unset directory is an error.
    """
    sc = spark.sparkContext
    configured = spark.conf.get(CHECKPOINT_CONF, None)
    if not configured:
        current = sc.getCheckpointDir()
        if current:
            return current
        if not sc.master.startswith("local"):
            raise RuntimeError(
                f"set {CHECKPOINT_CONF} to a folder every executor can reach (a distributed "
                "file system or object store); a machine-local folder cannot hold checkpoints "
                "or scratch tables on a cluster")
        configured = tempfile.mkdtemp(prefix="poicraft-ckpt-")
        atexit.register(shutil.rmtree, configured, ignore_errors=True)  # our own folder, empty before
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(configured)
    return configured


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unique folder under the shared checkpoint directory.

    All scratch folders of a session lie in one folder of its application, which is
    removed when the Python process ends with its session still open.
    """
    base = f"{checkpoint_dir(spark)}/scratch/{spark.sparkContext.applicationId}"
    if base not in _SCRATCH:
        _SCRATCH.add(base)
        atexit.register(_remove, spark, base)
    return f"{base}/{name}-{uuid.uuid4().hex}"


def _remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder that this session made, wherever Spark can write."""
    with contextlib.suppress(Exception):  # the session may be gone with its JVM
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back, for several outputs."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
