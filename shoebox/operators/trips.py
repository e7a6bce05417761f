"""Trips: photos split by time gaps and by jumps in place."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoebox.functions.geo import haversine_km
from shoebox.operators.ordering import pack, previous, segment

HOUR_MS = 3_600_000

# Defaults and allowed ranges of the two trip thresholds.
DEFAULT_GAP_HOURS = 48
DEFAULT_DISTANCE_KM = 300
GAP_HOURS_RANGE = (1, 168)
DISTANCE_KM_RANGE = (10, 1000)


@dataclass(frozen=True)
class TripThresholds:
    """Unset (0) thresholds take the defaults; others must lie in range."""

    max_gap_hours: float = 0
    max_distance_km: float = 0

    def resolved(self) -> "TripThresholds":
        gap = self.max_gap_hours or DEFAULT_GAP_HOURS
        km = self.max_distance_km or DEFAULT_DISTANCE_KM
        if not GAP_HOURS_RANGE[0] <= gap <= GAP_HOURS_RANGE[1]:
            raise ValueError(f"max_gap_hours must be within {GAP_HOURS_RANGE}, got {gap}")
        if not DISTANCE_KM_RANGE[0] <= km <= DISTANCE_KM_RANGE[1]:
            raise ValueError(f"max_distance_km must be within {DISTANCE_KM_RANGE}, got {km}")
        return TripThresholds(gap, km)


def splits(gap_ms: Column, km: Column, thresholds: TripThresholds) -> Column:
    """True where two neighbours in time belong to different trips.

    Both bounds are inclusive; a missing position (null km) never splits.
    """
    too_late = gap_ms > F.lit(int(thresholds.max_gap_hours * HOUR_MS))
    too_far = km.isNotNull() & (km > F.lit(float(thresholds.max_distance_km)))
    return too_late | too_far


def _gap(prev: Column, cur: Column) -> Column:
    return cur["taken_unix_ms"] - prev["taken_unix_ms"]


def _km(prev: Column, cur: Column) -> Column:
    return haversine_km(prev["latitude"], prev["longitude"], cur["latitude"], cur["longitude"])


def usable(photos: DataFrame) -> DataFrame:
    return photos.filter(F.col("taken_unix_ms").isNotNull())


def assign_trips(
    photos: DataFrame,
    thresholds: TripThresholds = TripThresholds(),
    by: list[str] | None = None,
    blocks: int | None = None,
) -> DataFrame:
    """Photos with a capture time, plus ``trip_id`` and ``pos`` (1-based, chronological).

    ``by`` names the columns that separate libraries or owners; without it the
    whole table is one library. Either way the work is spread over range blocks.
    """
    limits = thresholds.resolved()
    outer = by or []
    rows = usable(photos)
    out = segment(
        rows,
        keys=[*outer, "taken_unix_ms", "image_id"],
        outer=outer,
        carried=["taken_unix_ms", "latitude", "longitude"],
        inner_break=lambda prev, cur: splits(_gap(prev, cur), _km(prev, cur), limits),
        blocks=blocks,
    )
    return out.withColumnRenamed("inner_no", "trip_id").drop("outer_no", "row_no")


def trip_table(members: DataFrame, by: list[str] | None = None) -> DataFrame:
    """One row per trip: start, end, size and the plain mean position (null without GPS)."""
    located = F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
    return members.groupBy(*(by or []), "trip_id").agg(
        F.min("taken_unix_ms").alias("start_unix_ms"),
        F.max("taken_unix_ms").alias("end_unix_ms"),
        F.count(F.lit(1)).alias("photos"),
        F.avg(F.when(located, F.col("latitude"))).alias("centroid_lat"),
        F.avg(F.when(located, F.col("longitude"))).alias("centroid_lon"),
    )


def trip_members(members: DataFrame, by: list[str] | None = None, chunk: int = 10_000) -> DataFrame:
    """Chronological id arrays per trip, in chunks of bounded length."""
    return pack(members, [*(by or []), "trip_id"], "pos", {"image_ids": "image_id"}, chunk)


def trip_summary(photos: DataFrame, trips: DataFrame) -> DataFrame:
    """Number of trips and of photos without a usable capture time."""
    counted = photos.agg(F.count_if(F.col("taken_unix_ms").isNull()).alias("unassigned"))
    return trips.agg(F.count(F.lit(1)).alias("trips")).select(
        "trips", counted.select("unassigned").scalar().alias("unassigned")
    )


def sweep(
    photos: DataFrame, settings: list[TripThresholds], by: list[str] | None = None, blocks: int | None = None
) -> DataFrame:
    """Trip counts for many threshold pairs from one ordered pass.

    Neighbour gaps and distances do not depend on the thresholds, so they are
    computed once; each pair is then one conditional sum.
    """
    resolved = [s.resolved() for s in settings]
    outer = by or []
    steps = with_steps(photos, outer, blocks)
    first = F.col("gap_ms").isNull()
    counts = steps.agg(
        *[
            F.coalesce(F.sum((first | splits(F.col("gap_ms"), F.col("km"), s)).cast("long")), F.lit(0)).alias(f"_{i}")
            for i, s in enumerate(resolved)
        ]
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(float(s.max_gap_hours)).alias("max_gap_hours"),
                F.lit(float(s.max_distance_km)).alias("max_distance_km"),
                F.col(f"_{i}").alias("trips"),
            )
            for i, s in enumerate(resolved)
        ]
    )
    return counts.select(F.inline(rows))


def with_steps(photos: DataFrame, outer: list[str], blocks: int | None = None) -> DataFrame:
    """Timed photos with the gap and distance to the previous photo of the same owner."""
    rows = usable(photos)
    keys = [*outer, "taken_unix_ms", "image_id"]
    out = previous(rows, keys, outer, ["taken_unix_ms", "latitude", "longitude"], blocks)
    prev, cur = F.col("_prev"), F.struct("taken_unix_ms", "latitude", "longitude")
    return out.select(*rows.columns, _gap(prev, cur).alias("gap_ms"), _km(prev, cur).alias("km"))
