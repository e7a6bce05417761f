"""New files as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoebox.functions import paths
from shoebox.session import default_blocks
from shoebox.sources.listing import FolderSource

def watch_folder(
    spark: SparkSession,
    folder: str,
    extensions: list[str] | None = None,
    cache_marker: str = ".cache",
    settle_ms: int = 1000,
) -> DataFrame:
    """Image files as they appear below ``folder``, whatever their names: path, length, modified. Contents are not read.

    A file that is changed later comes again; files of the last ``settle_ms`` wait for the next batch.
    """
    spark.dataSource.register(FolderSource)
    reader = spark.readStream.format("folder").option("tasks", default_blocks(spark)).option("settle_ms", settle_ms)
    found = reader.option("path", folder).load().filter("problem IS NULL").select("path", "length", "modified")
    return found.filter(paths.is_image(F.col("path"), extensions, cache_marker))


def without_repeats(stream: DataFrame, key: list[str], event_time: str, delay: str) -> DataFrame:
    """Drop repeated events that arrive within ``delay`` of each other."""
    return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(key)
