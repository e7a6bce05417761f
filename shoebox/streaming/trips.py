"""Trips of photos that arrive as a stream.

Event-time sessions tell which stretch of an owner's photos is complete. The photos
themselves are stored as they arrive; once a stretch is closed, the batch operator
splits it, distance included, over range blocks. No state holds photos.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from shoebox.operators.ordering import previous
from shoebox.operators.skew import spread_join
from shoebox.operators.trips import TripThresholds, assign_trips, trip_table, usable
from shoebox.session import cut
from shoebox.streaming.sinks import append, compact, for_each, stored, write_batch

TRIPS = T.StructType(
    [
        T.StructField("owner", T.LongType()),
        T.StructField("start_unix_ms", T.LongType()),
        T.StructField("end_unix_ms", T.LongType()),
        T.StructField("photos", T.LongType()),
        T.StructField("centroid_lat", T.DoubleType()),
        T.StructField("centroid_lon", T.DoubleType()),
    ]
)


def store_photos(photos: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    return append(usable(photos), path, checkpoint)


def closed_sessions(photos: DataFrame, limits: TripThresholds, delay: str) -> DataFrame:
    """Time sessions per owner that no later photo can extend: ``owner, first_ms, last_ms``."""
    taken = usable(photos).select("owner", "taken_unix_ms", F.timestamp_millis("taken_unix_ms").alias("taken"))
    gap = f"{int(limits.max_gap_hours * 3600)} seconds"
    sessions = taken.withWatermark("taken", delay).groupBy("owner", F.session_window("taken", gap))
    return sessions.agg(F.min("taken_unix_ms").alias("first_ms"), F.max("taken_unix_ms").alias("last_ms")).drop(
        "session_window"
    )


def follow(
    photos: DataFrame,
    photo_table: str,
    photo_schema: T.StructType,
    path: str,
    checkpoint: str,
    limits: TripThresholds = TripThresholds(),
    delay: str = "1 hour",
) -> StreamingQuery:
    """Write the trips of every closed stretch to ``path``.

    ``photo_table`` is where ``store_photos`` keeps the photos; it must be at least as far along.
    """
    limits = limits.resolved()

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if batch.isEmpty():
            return
        # All photos of an owner between its first and last closed session are in closed sessions.
        stretch = batch.groupBy("owner").agg(F.min("first_ms").alias("first_ms"), F.max("last_ms").alias("last_ms"))
        # Two numbers a batch, so that the scan skips files and row groups outside its time.
        low, high = stretch.agg(F.min("first_ms"), F.max("last_ms")).first()
        rows = spark.read.schema(photo_schema).parquet(photo_table).filter(F.col("taken_unix_ms").between(low, high))
        inside = spread_join(rows, stretch, ["owner"], ["image_id"], "inner").filter(
            F.col("taken_unix_ms").between(F.col("first_ms"), F.col("last_ms"))
        )
        found = trip_table(assign_trips(inside.select(*rows.columns), limits, ["owner"]), ["owner"])
        write_batch(found.select(*TRIPS.names), path, batch_id)

    return for_each(closed_sessions(photos, limits, delay), checkpoint, handle)


def _held(spark: SparkSession, photo_table: str, photo_schema: T.StructType, path: str, limits: TripThresholds) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Stored trips, all photos with the end of their owner's last stored trip (``ended``), and owners with late photos.

    Photos are stored whenever they come. One behind the watermark is in no session: its owner has more photos up to the last
    stored trip's end than the stored trips count. One that just follows a closed session starts another: then trips of
    two batches, or the last trip and the next photo, are no farther apart than the gap.
    """
    gap = int(limits.resolved().max_gap_hours * 3_600_000)
    done = cut(stored(spark, path, TRIPS), "stored")
    ended = done.groupBy("owner").agg(F.max("end_unix_ms").alias("ended"), F.sum("photos").alias("counted"))
    rows = spark.read.schema(photo_schema).parquet(photo_table)
    rows = spread_join(rows, ended.select("owner", "ended"), ["owner"], ["image_id"])
    taken, last = F.col("taken_unix_ms"), F.col("ended")
    seen = rows.groupBy("owner").agg(F.count_if(taken <= last).alias("now"), F.min(F.when(taken > last, taken)).alias("next"))
    apart = F.col("next") - last
    behind = seen.join(ended, "owner").filter((F.col("now") != F.col("counted")) | (apart <= gap)).select("owner")
    order = previous(done, ["owner", "start_unix_ms"], ["owner"], ["end_unix_ms", "batch_id"])
    parted = (F.col("_prev.batch_id") != F.col("batch_id")) & (F.col("start_unix_ms") - F.col("_prev.end_unix_ms") <= gap)
    late = behind.unionByName(order.filter(parted).select("owner")).distinct().withColumn("late", F.lit(True))
    return done.drop("batch_id"), rows, cut(late, "late")


def _split(rows: DataFrame, columns: list[str], limits: TripThresholds) -> DataFrame:
    return trip_table(assign_trips(rows.select(*columns), limits.resolved(), ["owner"]), ["owner"]).select(*TRIPS.names)


def repair(spark: SparkSession, photo_table: str, photo_schema: T.StructType, path: str, limits: TripThresholds = TripThresholds()) -> None:
    """Split the closed stretches of owners with late photos anew, and store their trips in place of the old ones.

    Run it between two runs of ``follow``. Trips of other owners are kept as they are.
    """
    _, rows, late = _held(spark, photo_table, photo_schema, path, limits)
    again = spread_join(rows, late, ["owner"], ["image_id"], "inner").filter(F.col("taken_unix_ms") <= F.col("ended"))
    fixed = cut(_split(again, photo_schema.names, limits), "repaired")
    compact(spark, path, TRIPS, lambda old: spread_join(old, late, ["owner"], ["start_unix_ms"]).filter(F.col("late").isNull()).select(*TRIPS.names).unionByName(fixed))


def close(spark: SparkSession, photo_table: str, photo_schema: T.StructType, path: str, limits: TripThresholds = TripThresholds()) -> DataFrame:
    """All trips once the stream has ended: the stored ones, and those of the photos after an owner's last stored trip.

    A stored trip ends a time session, so without late photos none of the later ones belongs to it. Owners with late photos are
    split anew as a whole.
    """
    done, rows, late = _held(spark, photo_table, photo_schema, path, limits)
    kept = spread_join(done, late, ["owner"], ["start_unix_ms"]).filter(F.col("late").isNull()).select(*TRIPS.names)
    left = spread_join(rows, late, ["owner"], ["image_id"])
    left = left.filter(F.col("late").isNotNull() | F.col("ended").isNull() | (F.col("taken_unix_ms") > F.col("ended")))
    return kept.unionByName(_split(left, photo_schema.names, limits))
