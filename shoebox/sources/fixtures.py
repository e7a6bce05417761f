"""Photo-library tables derived from the given test tables.

Each function is the Spark side of one definition; ``plans/oracle.py`` holds the
same definition as SQL.
"""

from __future__ import annotations

import struct
import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shoebox.sources import storage


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def epoch_ms(ts: Column) -> Column:
    """Milliseconds since the epoch of a zone-less timestamp, whatever the session zone."""
    days = F.datediff(F.to_date(ts), F.lit("1970-01-01").cast("date")).cast("long")
    seconds = F.hour(ts) * 3600 + F.minute(ts) * 60
    millis = F.floor(F.extract(F.lit("SECOND"), ts) * 1000)
    return (days * 86_400_000 + seconds * 1000 + millis).cast("long")


def photos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return photos_from(table(spark, sf_dir, "events"))


def photos_from(events: DataFrame) -> DataFrame:
    eid, uid = F.col("event_id"), F.col("user_id")
    has_gps = eid % 5 != 0
    lat = (40 + uid % 10 + F.when(eid % 23 == 0, 20).otherwise(0)).cast("double") + (eid % 7) * F.lit(0.01)
    lon = (-70 + uid % 20).cast("double") + (eid % 11) * F.lit(0.01)
    return events.select(
        eid.alias("image_id"),
        uid.alias("owner"),
        F.when(eid % 17 != 0, epoch_ms(F.col("ts"))).alias("taken_unix_ms"),
        F.when(has_gps, lat).alias("latitude"),
        F.when(has_gps, lon).alias("longitude"),
        (100_000 + F.floor(F.col("value") * 1000)).cast("long").alias("size_bytes"),
    )


TILE = 8


def tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """8x8 gray images, one row each, pixels in row-major order."""
    vec = F.col("vec_id")
    scale = F.when(vec % 5 == 4, 0.02).otherwise(1.0)
    offset = F.when(vec % 4 == 1, -150.0).when(vec % 4 == 2, 150.0).otherwise(0.0)

    def value(e: Column) -> Column:
        level = F.floor(F.lit(128.0) + F.lit(255.0) * scale * e.cast("double") + offset)
        return F.greatest(F.lit(0), F.least(F.lit(255), level)).cast("int")

    return table(spark, sf_dir, "embeddings").select(
        vec.alias("image_id"),
        F.lit(TILE).alias("height"),
        F.lit(TILE).alias("width"),
        F.transform("embedding", value).alias("gray"),
    )


def colour_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Colour images whose green and blue planes are rotations of the gray one."""
    rotate = lambda by: F.concat(F.slice("gray", by + 1, 64 - by), F.slice("gray", 1, by))
    return tiles(spark, sf_dir).select(
        "image_id", "height", "width", F.col("gray").alias("r"), rotate(21).alias("g"), rotate(42).alias("b")
    )


def picture_name() -> Column:
    """Path of each tile's picture within its folder: some names are hidden, every eleventh file is no picture."""
    vec = F.col("image_id")
    head = F.when(vec % 7 == 0, "_DSC").when(vec % 7 == 1, ".h").otherwise("img")
    return F.concat((vec % 10).cast("string"), F.lit("/"), head, vec.cast("string"), F.when(vec % 11 == 0, ".JPG").otherwise(".png"))


def _png(red: list[int], green: list[int], blue: list[int]) -> bytes:
    """An uncompressed picture of TILE x TILE points."""

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    points = [bytes(v for k in range(row * TILE, row * TILE + TILE) for v in (red[k], green[k], blue[k])) for row in range(TILE)]
    head = struct.pack(">IIBBBBB", TILE, TILE, 8, 2, 0, 0, 0)
    body = zlib.compress(b"".join(b"\0" + line for line in points), 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", body) + chunk(b"IEND", b"")


def picture_files(rows: DataFrame, folder: str) -> None:
    """Write the pictures of ``colour_tiles`` rows below ``folder``, and a sidecar beside every fifth; tasks write them."""

    def put(path: str, content: bytes) -> None:
        system, place = storage.open_place(path)
        system.create_dir(place.rpartition("/")[0], recursive=True)
        with system.open_output_stream(place) as out:
            out.write(content)

    def run(batches):
        for batch in batches:
            for row in batch.itertuples():
                path = f"{folder}/{row.name}"
                put(path, b"broken" if row.image_id % 11 == 0 else _png(list(row.r), list(row.g), list(row.b)))
                if row.image_id % 5 == 0:
                    put(f"{path.rpartition('.')[0]}.xmp", b"<x/>")
            yield batch[["image_id"]]

    named = rows.select("image_id", picture_name().alias("name"), "r", "g", "b")
    named.mapInPandas(run, "image_id long").agg(F.count("image_id")).collect()


def bursts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three near copies of each vector, as feature rows: id, 63-bit hash, histogram, valid."""
    vec = F.col("vec_id")
    amp = F.when(vec % 3 == 0, 0.04).otherwise(0.002)

    def shifted(e: Column, pos: Column) -> Column:
        return e.cast("double") + amp * F.col("k") * ((pos * 7 + F.col("k") * 13) % 5 - 2)

    vectors = table(spark, sf_dir, "embeddings").select(
        "vec_id", "embedding", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("k")
    )
    rows = vectors.select(
        (vec * 3 + F.col("k")).alias("image_id"), F.transform("embedding", shifted).alias("histogram")
    )
    def add(bits: Column, i: Column) -> Column:
        up = F.get("histogram", i) > F.get("histogram", i + 1)
        return bits.bitwiseOR(F.when(up, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(0))

    dhash = F.aggregate(F.sequence(F.lit(0), F.lit(62)), F.lit(0).cast("long"), add)
    return rows.select("image_id", dhash.alias("dhash"), "histogram", F.lit(True).alias("valid"))


def actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return actions_from(table(spark, sf_dir, "events"))


def actions_from(events: DataFrame) -> DataFrame:
    """Decision log: seq, action, image_ids, group_id, keeper_id."""
    kind, uid = F.col("event_type"), F.col("user_id")
    group = F.floor(uid / 10).cast("long")
    reset = (kind == "error") & (F.col("event_id") % 1000 == 0)
    action = (
        F.when(reset, "reset")
        .when(kind == "error", "keep_all")
        .when(kind == "click", "toggle")
        .when(kind == "view", "keep")
        .when(kind == "purchase", "mark")
        .when(kind == "signup", "assign_keeper")
    )
    ids = F.when(kind.isin("click", "view", "purchase"), F.array(uid)).when(
        (kind == "error") & ~reset, F.sequence(group * 10, group * 10 + 9)
    )
    return events.select(
        F.col("event_id").alias("seq"),
        action.alias("action"),
        ids.alias("image_ids"),
        F.when(kind == "signup", group).alias("group_id"),
        F.when(kind == "signup", uid).alias("keeper_id"),
    ).filter(F.col("action").isNotNull())


def groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similar-group membership rows: ten users each, the smallest is recommended."""
    return (
        table(spark, sf_dir, "events")
        .select(F.floor(F.col("user_id") / 10).cast("long").alias("group_id"))
        .distinct()
        .select(
            "group_id",
            F.explode(F.sequence(F.col("group_id") * 10, F.col("group_id") * 10 + 9)).alias("image_id"),
            (F.col("group_id") * 10).alias("recommended_id"),
        )
    )


def flagged(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Image ids flagged by the quality pass and by the junk pass."""
    ids = groups(spark, sf_dir).select("image_id")
    return ids.filter(F.col("image_id") % 4 == 0), ids.filter(F.col("image_id") % 9 == 0)


LIBRARY_ROOT = "/lib"


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file listing: path, length, and for images the decoded width and height."""
    key = F.col("p_partkey")
    stem_key = F.when(key % 8 == 5, key - 5).otherwise(key)
    ext = F.element_at(
        F.array(*[F.lit(e) for e in [".jpg", ".JPEG", ".png", ".webp", ".txt", ".xmp", "", ".gif"]]),
        (key % 8 + 1).cast("int"),
    )
    wide = F.col("p_size") * 100
    high = F.col("p_size") * 75
    portrait = key % 2 == 1
    return table(spark, sf_dir, "part").select(
        F.concat(
            F.lit(LIBRARY_ROOT + "/"),
            F.when(key % 50 == 0, ".cache/").otherwise(""),
            F.lit("d"),
            (F.floor(key / 8) % 10).cast("string"),
            F.lit("/img_"),
            stem_key.cast("string"),
            ext,
        ).alias("path"),
        F.round(F.col("p_retailprice") * 100).cast("long").alias("length"),
        F.when(portrait, high).otherwise(wide).cast("int").alias("width"),
        F.when(portrait, wide).otherwise(high).cast("int").alias("height"),
        F.concat(F.lit("img_"), stem_key.cast("string")).alias("stem"),
    )


def _order_id() -> Column:
    return F.concat(F.lit("y"), F.year("o_orderdate"), F.lit("/"), F.col("o_orderkey"), F.lit(".jpg"))


def library_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images of a library to be copied: id, size_bytes."""
    return table(spark, sf_dir, "orders").select(
        _order_id().alias("id"), F.floor("o_totalprice").cast("long").alias("size_bytes")
    )


def keep_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids the user kept; a few name no known image."""
    key = F.col("o_orderkey")
    orders = table(spark, sf_dir, "orders")
    known = orders.filter(key % 2 == 0).select(_order_id().alias("id"))
    return known.unionByName(
        orders.filter(key % 101 == 0).select(F.concat(F.lit("missing/"), key.cast("string")).alias("id"))
    )


def destination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What already lies in the destination folder: id, size_bytes."""
    key = F.col("o_orderkey")
    return (
        table(spark, sf_dir, "orders")
        .filter(key % 3 == 0)
        .select(
            _order_id().alias("id"),
            (F.floor("o_totalprice") + F.when(key % 7 == 0, 1).otherwise(0)).cast("long").alias("size_bytes"),
        )
    )
