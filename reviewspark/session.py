"""Session settings, shared scratch space and lineage cuts."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.files.maxPartitionBytes": "134217728",
}


def build_session(app: str = "reviewspark", master: str | None = None, conf: dict | None = None) -> SparkSession:
    """Create (or reuse) a session; on a cluster leave ``master`` unset."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULT_CONF, **(conf or {})}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder for lineage cuts and round trips.

    The cluster names it in ``spark.checkpoint.dir``. Only where that is unset
    (unit tests, a laptop) does the engine fall back to a temporary folder.
    """
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not root:
        root = spark.conf.get("reviewspark.scratch.dir", None)
    if not root:
        root = tempfile.mkdtemp(prefix="spark-reviewspark-")
        spark.conf.set("reviewspark.scratch.dir", root)
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(root)
    return root


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder (never reused, so a retry cannot clash)."""
    return os.path.join(checkpoint_root(spark), "reviewspark-scratch", f"{name}-{uuid.uuid4().hex}")


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``df`` as Parquet in the shared folder, and its path; ``drop_scratch`` gives the space back."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def free_shuffles(spark: SparkSession) -> None:
    """Have the files of finished shuffles deleted now.

    The engine deletes them once the driver has collected what refers to them, which the events of a finished job do
    until they are handled. A driver with little to do seldom collects: the shuffles of a long job pile up.
    """
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    spark._jvm.System.gc()


def drop_scratch(spark: SparkSession, *paths: str) -> None:
    """Delete folders that ``scratch_path`` named and that nothing reads any more."""
    for path in paths:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives executor loss, unlike a local one."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)
