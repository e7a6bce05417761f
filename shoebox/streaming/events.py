"""Tagged event feeds: split by kind, and keep the latest row per id."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from shoebox.sources.tables import image_index
from shoebox.streaming.sinks import compact, for_each, stored, write_batch

KINDS = ["progress", "row", "complete"]


def of_kind(events: DataFrame, kind: str) -> DataFrame:
    """Payload of one kind; events without a kind belong to none."""
    return events.filter(F.col("kind") == kind).select("seq", f"{kind}.*")


def split(events: DataFrame, path: str, checkpoint: str, kinds: list[str] = KINDS) -> StreamingQuery:
    """Write each kind to its own table below ``path``."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        for kind in kinds:
            write_batch(of_kind(batch, kind), f"{path}/{kind}", batch_id)
        batch.unpersist()

    return for_each(events, checkpoint, handle)


def index(rows: DataFrame, path: str, checkpoint: str, key: str = "id", seq: str = "seq") -> StreamingQuery:
    """Keep first-seen order and latest row per id; each batch adds only its own changes."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        latest = batch.groupBy(key).agg(F.max(seq).alias("last_seen"))
        write_batch(image_index(batch, key, seq).join(latest, key), path, batch_id)

    return for_each(rows, checkpoint, handle)


def _latest(rows: DataFrame, key: str) -> DataFrame:
    """One row per id of stored index rows."""
    rest = [c for c in rows.columns if c not in (key, "first_seen", "last_seen", "batch_id")]
    folded = rows.groupBy(key).agg(
        F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.max_by(F.struct(*rest), "last_seen").alias("_row")
    )
    return folded.select(key, "first_seen", "last_seen", "_row.*")


def current_index(spark: SparkSession, path: str, schema: T.StructType, key: str = "id") -> DataFrame:
    """The index over all batches. ``schema`` describes the stored rows."""
    return _latest(stored(spark, path, schema), key).drop("last_seen")


def compact_index(spark: SparkSession, path: str, schema: T.StructType, key: str = "id") -> None:
    """Fold the index rows of all batches so far into one row per id."""
    compact(spark, path, schema, lambda rows: _latest(rows, key))
