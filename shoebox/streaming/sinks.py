"""Exactly-once batch sinks and replay helpers shared by the streams."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from shoebox.sources import storage


def replay(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A stored table as a stream; ``name`` may be a glob."""
    schema = spark.read.option("pathGlobFilter", name).parquet(folder).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)


def write_batch(batch: DataFrame, path: str, batch_id: int) -> None:
    """Store the rows of one micro-batch; a repeated batch replaces its own rows only."""
    batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def for_each(stream: DataFrame, checkpoint: str, handle: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Run ``handle`` on all available data in micro-batches, remembering progress in ``checkpoint``."""
    return (
        stream.writeStream.foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def append(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    return (
        stream.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def finish(query: StreamingQuery) -> None:
    query.awaitTermination()
    failure = query.exception()
    if failure is not None:
        raise failure


_BATCH = re.compile(r"batch_id=(\d+)$")
_COMPACT = re.compile(r"upto=(\d+)$")


def _compacted(spark: SparkSession, path: str) -> int:
    """The last batch of the newest complete compaction, -1 without one."""
    found = [int(m[1]) for m in map(_COMPACT.match, storage.names(spark, f"{path}/compact")) if m]
    return max((n for n in found if storage.exists(spark, f"{path}/compact/upto={n}/_SUCCESS")), default=-1)


def stored(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Rows of all batches written with ``write_batch``, with their ``batch_id``; compacted ones as they were folded."""
    done = _compacted(spark, path)
    later = sorted(int(m[1]) for m in map(_BATCH.match, storage.names(spark, path)) if m and int(m[1]) > done)
    rows = spark.createDataFrame([], T.StructType([*schema.fields, T.StructField("batch_id", T.LongType())]))
    if done >= 0:
        old = spark.read.schema(schema).parquet(f"{path}/compact/upto={done}")
        rows = rows.unionByName(old.withColumn("batch_id", F.lit(done).cast("long")))
    if later:
        new = spark.read.schema(rows.schema).option("basePath", path).parquet(*[f"{path}/batch_id={n}" for n in later])
        rows = rows.unionByName(new)
    return rows


def compact(spark: SparkSession, path: str, schema: T.StructType, fold: Callable[[DataFrame], DataFrame]) -> None:
    """Fold all rows so far into one table that stands for their batches from its completion on.

    ``fold`` keeps the schema. Run it between two runs of the stream; folders of the folded batches may be deleted by hand.
    """
    rows = stored(spark, path, schema)
    last = rows.agg(F.max("batch_id")).first()[0]
    if last is not None and last > _compacted(spark, path):
        fold(rows.drop("batch_id")).select(*schema.names).write.mode("overwrite").parquet(f"{path}/compact/upto={last}")
