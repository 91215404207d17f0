"""Session defaults and cluster-safe helpers."""
from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Set on a session that has no value of its own; a cluster's settings always win.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app: str = "refaudit", master: str | None = None, **conf: str) -> SparkSession:
    """Create a session with the library defaults; keyword ``conf`` uses ``_`` for ``.``.

    For instance ``spark_sql_shuffle_partitions="64"``.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **{k.replace("_", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names, or a private one where none is set (tests)."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext.getCheckpointDir()
    if path:
        if current is None:
            spark.sparkContext.setCheckpointDir(path)
        return path
    if current is None:
        master = spark.sparkContext.master
        if not master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir=os.environ.get("TMPDIR", "/tmp")))
    return spark.sparkContext.getCheckpointDir()


def stage_table(df: DataFrame, label: str) -> DataFrame:
    """Write an intermediate result once and read it back.

    The table lives in the shared checkpoint folder, so it survives lost executors; readers get
    column pruning, filter pushdown and real sizes for join planning, and plans stay small.
    Used where several later steps read the same parsed or joined rows.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/refaudit-stage/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
