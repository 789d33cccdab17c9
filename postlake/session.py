"""Session settings and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def build_session(app_name: str = "postlake", master: str | None = None, cores: int = 8) -> SparkSession:
    """A session for local runs; on a cluster the submitter's settings win."""
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.variant.allowDuplicateKeys", "true")
        # Stream state on disk: days of keys do not fit the heap.
        .config("spark.sql.streaming.stateStore.providerClass",
                "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    )
    if master:
        builder = (
            builder.master(master)
            .config("spark.sql.shuffle.partitions", str(cores))
            .config("spark.ui.enabled", "false")
            .config("spark.driver.memory", "8g")
        )
    return builder.getOrCreate()


def _scheme_is_local(spark: SparkSession) -> bool:
    return spark.sparkContext.master.startswith("local")


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by the cluster.

    Only a local session without the setting gets a folder of its own, as in
    tests; a cluster without the setting is an error, because a machine-local
    folder would not survive the loss of an executor.
    """
    root = spark.conf.get(CHECKPOINT_CONF, None) or spark.sparkContext.getConf().get(CHECKPOINT_CONF, None)
    if not root:
        if not _scheme_is_local(spark):
            raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder shared by all executors")
        root = tempfile.mkdtemp(prefix="postlake-ckpt-")
        spark.conf.set(CHECKPOINT_CONF, root)
    own_disk = os.path.abspath(tempfile.gettempdir())
    plain = root.removeprefix("file://")
    if not _scheme_is_local(spark) and "://" not in plain and (plain == own_disk or plain.startswith(f"{own_disk}/")):
        raise RuntimeError(f"{CHECKPOINT_CONF}={root} is the temporary folder of one machine, not a folder that executors share")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return root


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path for one run below the shared folder."""
    return os.path.join(checkpoint_root(spark), f"{label}-{uuid.uuid4().hex}")


def materialize(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """Write a frame below the shared folder and read it back: (frame, path).

    Loops use this instead of ``checkpoint``: a checkpointed plan keeps the
    constraints of the plan it cut off, and over many self-joins those grow
    until planning takes longer than the work.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def path_exists(spark: SparkSession, path: str) -> bool:
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop_path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Remove a table written by ``materialize`` that nothing reads any more."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop_path, True)
