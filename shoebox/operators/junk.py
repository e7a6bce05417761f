"""Photo or not: simple rules, or a model the user brings."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoebox import schemas
from shoebox.sources import tables


@dataclass(frozen=True)
class JunkRules:
    """Shares above which flatness, few colours or straight edges speak for a screenshot."""

    block: int = 2
    edge_step: int = 32
    straight_share: float = 0.75
    min_flat: float = 0.25
    max_unique: float = 0.5
    min_straight: float = 0.2


def classify(measured: DataFrame, rules: JunkRules = JunkRules()) -> DataFrame:
    """``image_id, is_junk, reason, confidence`` for every measured image."""
    flat = F.col("flat_ratio") >= rules.min_flat
    few = F.col("unique_ratio") <= rules.max_unique
    straight = F.col("straight_ratio") >= rules.min_straight
    votes = flat.cast("int") + few.cast("int") + straight.cast("int")
    reason = F.when(votes < 2, F.lit(None)).when(straight, "screenshot").otherwise("non-photograph")
    return measured.select(
        "image_id",
        (votes >= 2).cast("int").alias("is_junk"),
        reason.alias("reason"),
        (F.when(votes >= 2, votes).otherwise(3 - votes) / 3.0).alias("confidence"),
    )


Model = Callable[[pd.DataFrame], pd.DataFrame]


def classify_with(images: DataFrame, model: Model | Callable[[], Model], load: bool = False) -> DataFrame:
    """Judge every image with a user's model.

    ``model`` maps a batch of rows to a frame with ``is_junk, reason, confidence``.
    With ``load=True`` it is a factory called once per task, to load weights there.
    The model must give the same answer for the same image, so a retried task agrees.
    """
    id_type = images.schema["image_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        judge = model() if load else model
        for batch in batches:
            out = judge(batch).reset_index(drop=True)
            yield pd.DataFrame(
                {
                    "image_id": batch["image_id"].reset_index(drop=True),
                    "is_junk": out["is_junk"].astype("int32"),
                    "reason": out["reason"],
                    "confidence": out["confidence"].astype("float64"),
                }
            )

    return images.mapInPandas(run, f"image_id {id_type}, is_junk int, reason string, confidence double")


def unjudged(images: DataFrame, judged: DataFrame) -> DataFrame:
    """Images without a stored verdict."""
    return images.join(judged.select("image_id"), "image_id", "left_anti")


def store(verdicts: DataFrame, table_path: str) -> None:
    """Add verdicts with the time they were made, in seconds; an image that has one keeps it."""
    spark = verdicts.sparkSession
    rows = verdicts.withColumn("image_id", F.col("image_id").cast("string"))
    known = tables.read_table(spark, table_path, schemas.JUNK_FLAGS)
    fresh = tables.new_rows(known, rows, order="is_junk", key="image_id")
    tables.append(fresh.withColumn("processed_at", F.unix_timestamp()), table_path, schemas.JUNK_FLAGS)


def flags(verdicts: DataFrame) -> DataFrame:
    return verdicts.filter(F.col("is_junk") == 1).select("image_id", "reason", "confidence")


def summary(verdicts: DataFrame) -> DataFrame:
    return verdicts.agg(F.count_if(F.col("is_junk") == 1).alias("flagged"), F.count(F.lit(1)).alias("total"))
