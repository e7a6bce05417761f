"""Table schemas."""

from __future__ import annotations

from pyspark.sql import types as T


def _field(name: str, kind: T.DataType, required: bool = False) -> T.StructField:
    return T.StructField(name, kind, not required)


S, L, I, D = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType()

IMAGES = T.StructType(
    [
        _field("id", S, True),
        _field("absolute_path", S, True),
        _field("file_name", S, True),
        _field("original_width", I, True),
        _field("original_height", I, True),
        _field("size_bytes", L, True),
        _field("taken_unix_ms", L),
        _field("latitude", D),
        _field("longitude", D),
        _field("working_image_path", S, True),
        _field("scanned_at", L, True),
    ]
)
JUNK_FLAGS = T.StructType(
    [
        _field("image_id", S, True),
        _field("is_junk", I, True),
        _field("reason", S),
        _field("confidence", D, True),
        _field("processed_at", L, True),
    ]
)
USER_DECISIONS = T.StructType([_field("image_id", S, True), _field("decision", S, True), _field("updated_at", L, True)])
USER_GROUP_KEEPERS = T.StructType([_field("group_id", L, True), _field("keeper_id", S, True)])
SESSION_STATE = T.StructType([_field("key", S, True), _field("value", S), _field("updated_at", L, True)])
QUALITY_FLAGS = T.StructType(
    [
        _field("image_id", S, True),
        _field("reasons", T.ArrayType(S), True),
        _field("sharpness", D, True),
        _field("exposure_score", D, True),
    ]
)
# Group and trip members are rows, so a group of any size stays distributed.
GROUP_MEMBERS = T.StructType(
    [
        _field("group_id", L, True),
        _field("rank", L, True),
        _field("image_id", S, True),
        _field("score", D, True),
        _field("is_keeper", T.BooleanType(), True),
    ]
)
TRIPS = T.StructType(
    [
        _field("trip_id", L, True),
        _field("start_unix_ms", L, True),
        _field("end_unix_ms", L, True),
        _field("photos", L, True),
        _field("centroid_lat", D),
        _field("centroid_lon", D),
    ]
)
