"""Session settings and the shared working folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local_dir: tempfile.TemporaryDirectory | None = None


def build_session(app: str = "shoebox", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings every job in this package assumes."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach; tables that cut lineage are written there.

    The cluster names it in ``spark.checkpoint.dir``. Only a local-mode session
    without that setting, as in tests, takes a temporary folder, which goes when Python ends.
    """
    global _local_dir
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        configured = spark.sparkContext.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    if _local_dir is None:
        _local_dir = tempfile.TemporaryDirectory(prefix="shoebox-")
    return _local_dir.name


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/shoebox/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame, label: str = "cut", cluster_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    The result has no lineage, survives the loss of any executor, is evaluated
    exactly once and is read with column pruning.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    writer = df.write.mode("errorifexists")
    if cluster_by:
        writer = writer.partitionBy(*cluster_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def default_blocks(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
