"""Spark session settings shared by the library, the tests and the benchmark."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings every job in the library assumes: UTC clock for timestamp parsing and
# oracle agreement, ANSI mode (errors surface; parsing uses try_* functions),
# AQE for runtime re-planning (partition coalescing, skew-join splitting, and
# broadcast conversion from measured sizes).
SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.variant.allowDuplicateKeys": "true",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # the exact median's per-key buffer is a small value->count map: keep more keys in
    # the hash map before falling back to sort-based aggregation
    "spark.sql.objectHashAggregate.sortBased.fallbackThreshold": "4096",
    # checkpoint files (rankings, evaluation rounds) are removed once unreferenced
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    # streaming state (S1 keeps every key it has seen) lives in RocksDB, off the JVM heap
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def build_session(master: str | None = None, shuffle_partitions: int = 8,
                  app_name: str = "gleaner") -> SparkSession:
    """Local/test session. On a cluster, the submitted conf wins for anything set there."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in SESSION_CONF.items():
        builder = builder.config(key, value)
    builder = (builder
               .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
               .config("spark.driver.memory", os.environ.get("GLEANER_DRIVER_MEMORY", "8g")))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


# Runtime settings the queries rely on, applied to any session they are given.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    # of a key that a JSON object repeats, the last value counts
    "spark.sql.variant.allowDuplicateKeys": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings the library needs to a session it did not build
    (e.g. the caller's), and make sure a checkpoint folder is known."""
    for key, value in RUNTIME_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by the cluster.

    ``spark.checkpoint.dir`` is read from the session; only when it is unset on a
    local master (local runs, tests) a fresh scratch folder is created and registered.
    A cluster without the setting is an error: a machine-local folder would not be
    visible to other executors.
    """
    current = spark.conf.get("spark.checkpoint.dir", None)
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - Spark Connect: the server's conf names the folder
        if not current:
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
        return current
    if not current:
        current = sc.getCheckpointDir()          # set on the context instead of the conf
    if not current:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
        current = tempfile.mkdtemp(prefix="gleaner-ckpt-")   # local runs and tests only
        spark.conf.set("spark.checkpoint.dir", current)
    sc.setCheckpointDir(current)
    return current


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, never-reused path under the shared checkpoint folder; what is written there
    goes when the driver ends."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    folder = f"{base}/gleaner-scratch/{name}-{uuid.uuid4().hex}"
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - Spark Connect: the server's owner clears the folder
        return f"{folder}/data"
    path = sc._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(sc._jsc.hadoopConfiguration())
    fs.mkdirs(path)
    fs.deleteOnExit(path)
    return f"{folder}/data"
