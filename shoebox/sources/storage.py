"""What the package asks of the file system: listings, and file access inside tasks."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _hadoop(spark: SparkSession, path: str):
    # The one place that reaches into the JVM: Spark has no public call for these questions.
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def exists(spark: SparkSession, path: str) -> bool:
    system, place = _hadoop(spark, path)
    return system.exists(place)


def make_folder(spark: SparkSession, path: str) -> None:
    system, place = _hadoop(spark, path)
    system.mkdirs(place)


def names(spark: SparkSession, path: str) -> list[str]:
    """Names directly in a folder that this package keeps small; none if it is missing."""
    system, place = _hadoop(spark, path)
    return [entry.getPath().getName() for entry in system.listStatus(place)] if system.exists(place) else []


def open_place(path: str):
    """File system and path within it, for a path or URI; used inside tasks."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))
