"""The decision fold on a stream of actions.

A micro-batch is reduced to span summaries, the same first step as in the batch
fold, and only these are stored. Reading composes them, so an image with very many actions
never gathers in one state entry, and a repeated batch replaces its own summaries.
Batches must follow log order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from shoebox.operators import decisions
from shoebox.streaming.sinks import compact, for_each, stored, write_batch


def _summaries(image_id: T.DataType) -> T.StructType:
    return T.StructType(
        [
            T.StructField("image_id", image_id),
            T.StructField("span", T.LongType()),
            T.StructField("base", T.StringType()),
            T.StructField("toggles", T.LongType()),
            T.StructField("updated_at", T.LongType()),
        ]
    )


def _keepers(keeper_id: T.DataType) -> T.StructType:
    return T.StructType(
        [
            T.StructField("group_id", T.LongType()),
            T.StructField("keeper_id", keeper_id),
            T.StructField("seq", T.LongType()),
        ]
    )


RESETS = T.StructType([T.StructField("reset_seq", T.LongType())])


def follow(actions: DataFrame, path: str, checkpoint: str, span: int = decisions.SPAN) -> StreamingQuery:
    """Store span summaries, keeper choices and resets of every batch below ``path``."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        live = decisions.after_reset(batch)
        rows = decisions.image_actions(live)
        write_batch(decisions.summarise(rows, F.floor(F.col("seq") / span)), f"{path}/spans", batch_id)
        chosen = live.filter(F.col("action") == "assign_keeper").groupBy("group_id")
        keepers = chosen.agg(F.max_by("keeper_id", "seq").alias("keeper_id"), F.max("seq").alias("seq"))
        write_batch(keepers, f"{path}/keepers", batch_id)
        write_batch(decisions.last_reset(batch), f"{path}/resets", batch_id)
        batch.unpersist()

    return for_each(actions, checkpoint, handle)


def _last_reset(spark: SparkSession, path: str) -> DataFrame:
    resets = stored(spark, f"{path}/resets", RESETS)
    return resets.agg(F.coalesce(F.max("reset_seq"), F.lit(-1)).alias("reset_seq"))


def standing(spark: SparkSession, path: str, image_id: T.DataType = T.StringType()) -> DataFrame:
    """Decision per image as of the last batch."""
    spans = stored(spark, f"{path}/spans", _summaries(image_id))
    return decisions.combine(spans.filter(F.col("updated_at") > _last_reset(spark, path).scalar()))


def keepers(spark: SparkSession, path: str, keeper_id: T.DataType = T.StringType()) -> DataFrame:
    """Keeper per group as of the last batch."""
    rows = stored(spark, f"{path}/keepers", _keepers(keeper_id))
    live = rows.filter(F.col("seq") > _last_reset(spark, path).scalar())
    return live.groupBy("group_id").agg(F.max_by("keeper_id", "seq").alias("keeper_id"))


def compact_all(spark: SparkSession, path: str, image_id: T.DataType = T.StringType(), keeper_id: T.DataType = T.StringType()) -> None:
    """Fold the summaries, keeper choices and resets of all batches so far into one row per image, group and log."""
    reset = _last_reset(spark, path).first()[0]

    def spans(rows: DataFrame) -> DataFrame:
        live = rows.filter(F.col("updated_at") > reset)
        return decisions.merged(live).withColumn("span", F.lit(0).cast("long"))

    def chosen(rows: DataFrame) -> DataFrame:
        live = rows.filter(F.col("seq") > reset)
        return live.groupBy("group_id").agg(F.max_by("keeper_id", "seq").alias("keeper_id"), F.max("seq").alias("seq"))

    # The reset goes last: until then it still holds for what was not folded.
    compact(spark, f"{path}/spans", _summaries(image_id), spans)
    compact(spark, f"{path}/keepers", _keepers(keeper_id), chosen)
    compact(spark, f"{path}/resets", RESETS, lambda rows: rows.agg(F.max("reset_seq").alias("reset_seq")))
