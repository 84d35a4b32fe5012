"""SparkSession factory and shared scratch-folder handling."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # 32 MB of parquet per input split keeps tasks short and spill-free.
    "spark.sql.files.maxPartitionBytes": str(32 * 1024 * 1024),
    # checkpoint files of DataFrames that are no longer referenced are removed
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app: str = "cohortlab", extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with AQE on and the UI off."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for k, v in _DEFAULTS.items():
        builder = builder.config(k, v)
    if master and master.startswith("local"):
        builder = builder.config("spark.driver.memory", "8g")
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    On a cluster this setting names storage every executor can reach; it is
    only filled in here when unset (local tests), never overridden.
    """
    sc = spark.sparkContext
    root = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir", None)
    if not root:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        # local tests only: a private folder under the system temp dir
        root = tempfile.mkdtemp(prefix="cohortlab-ckpt-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(root)
    return sc.getCheckpointDir() or root


def materialize(df):
    """Write ``df`` to the shared checkpoint folder and cut its lineage.

    Used for small, heavily reused tables (split assignments): later plans read
    the written rows instead of re-deriving them, and a lost executor only
    costs a re-read. Never a machine-local cache.
    """
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)


def write_once(df, name: str):
    """Write ``df`` as Parquet to the shared checkpoint folder and read it back: for tables
    that several jobs read by columns, where a checkpoint would keep whole rows."""
    path = scratch_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the shared checkpoint root for written tables."""
    root = checkpoint_root(spark)
    path = os.path.join(root, f"{name}-{uuid.uuid4().hex[:12]}")
    return path
