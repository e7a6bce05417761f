"""Folder scans: file listings, image rows, decode errors, scan reports."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shoebox.functions import paths
from shoebox.session import cut, default_blocks, scratch_path
from shoebox.sources import storage

# Fixed value: reason given for a file that cannot be decoded.
UNREADABLE = "File corrupt or encoding format unsupported."


def _plain(path: Column) -> Column:
    """Local file URIs as plain paths; other schemes unchanged."""
    return F.regexp_replace(path, "^file:/+", "/")


def _entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """What lies directly in each folder."""
    from pyarrow import fs

    for batch in batches:
        for folder in batch["folder"]:
            system, place = storage.open_place(folder)
            head = folder[: len(folder) - len(place)] if "://" in folder and folder.endswith(place) else ""
            found = system.get_file_info(fs.FileSelector(place, recursive=False))
            found = [f for f in found if f.type in (fs.FileType.File, fs.FileType.Directory)]
            yield pd.DataFrame(
                {
                    "path": [head + f.path for f in found],
                    "is_folder": [f.type == fs.FileType.Directory for f in found],
                    "length": [f.size or 0 for f in found],
                    "modified": pd.to_datetime([(f.mtime_ns or 0) // 1000 for f in found], unit="us", utc=True),
                }
            )


def list_files(spark: SparkSession, folder: str, recursive: bool = True) -> DataFrame:
    """Every file below ``folder``, whatever its name: path, length, modified. File contents are not read.

    Spark's own readers leave out names that begin with an underscore or a dot, as cameras give them. Folders are
    read by tasks, one level of the tree at a time.
    """
    level = spark.createDataFrame([(folder.rstrip("/") or "/",)], "folder string")
    files = None
    while True:
        spread = level.repartition(default_blocks(spark), "folder")
        found = cut(spread.mapInPandas(_entries, "path string, is_folder boolean, length long, modified timestamp"), "entries")
        here = found.filter(~F.col("is_folder")).select(_plain(F.col("path")).alias("path"), "length", "modified")
        files = here if files is None else files.unionByName(here)
        level = found.filter("is_folder").select(F.col("path").alias("folder"))
        if not recursive or level.isEmpty():
            return files


def _decoded(spark: SparkSession, folder: str, names: str, recursive: bool) -> DataFrame:
    """Spark's pictures of the visible files that match ``names``."""
    read = spark.read.format("image").option("dropInvalid", "false").option("recursiveFileLookup", str(recursive).lower())
    return read.option("pathGlobFilter", names).load(folder).select(_plain(F.col("image.origin")).alias("path"), "image")


def _stage(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Copy files to names that Spark reads; a retried task writes the same names again."""
    for batch in batches:
        for source, target in zip(batch["path"], batch["staged"]):
            from_fs, at = storage.open_place(source)
            to_fs, to = storage.open_place(target)
            to_fs.create_dir(to.rpartition("/")[0], recursive=True)
            with from_fs.open_input_stream(at) as reader, to_fs.open_output_stream(to) as writer:
                while chunk := reader.read(8 << 20):
                    writer.write(chunk)
        yield batch


def read_pixels(
    spark: SparkSession, folder: str, extensions: list[str] | None = None, recursive: bool = True, cache_marker: str = ".cache"
) -> DataFrame:
    """Decoded images: path, width, height, channels and BGR bytes; -1 sizes when unreadable.

    Files are selected by name in the listing, so nothing else is opened. Image files with hidden names, or in folders with such
    names, are first copied to the shared folder under plain names.
    """
    wanted = extensions or paths.IMAGE_EXTENSIONS
    any_case = ",".join("".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in e[1:]) for e in wanted)
    decoded = _decoded(spark, folder, f"*.{{{any_case}}}", recursive)
    below = paths.relative_id(F.col("path"), folder)
    hidden = list_files(spark, folder, recursive).filter(
        paths.is_image(F.col("path"), extensions, cache_marker) & F.concat(F.lit("/"), below).rlike("/[_.]")
    )
    shelf = scratch_path(spark, "hidden")
    target = F.concat(F.lit(f"{shelf}/"), F.sha2("path", 256), paths.extension(F.col("path")))
    named = hidden.select("path", target.alias("staged")).repartition(default_blocks(spark), "path")
    named = cut(named.mapInPandas(_stage, "path string, staged string"), "staged")
    if not named.isEmpty():
        staged = _decoded(spark, shelf, "*", False).withColumnRenamed("path", "staged")
        named = named.withColumn("staged", _plain(F.col("staged")))
        decoded = decoded.unionByName(staged.join(named, "staged").select("path", "image"))
    return decoded.select(
        "path",
        F.col("image.width").alias("width"),
        F.col("image.height").alias("height"),
        F.col("image.nChannels").alias("channels"),
        F.col("image.data").alias("data"),
    )


def image_rows(files: DataFrame, root: str, cache: str = ".cache/res-768") -> DataFrame:
    """``images`` columns from files with path, length, width, height.

    Unreadable files (size below 1) are not rows; see ``scan_errors``.
    """
    path = F.col("path")
    working = F.concat(F.lit(f"{root.rstrip('/')}/{cache}/"), paths.working_name(path, F.col("length")))
    return files.filter(F.col("height") > 0).select(
        paths.relative_id(path, root).alias("id"),
        path.alias("absolute_path"),
        paths.file_name(path).alias("file_name"),
        F.col("width").cast("int").alias("original_width"),
        F.col("height").cast("int").alias("original_height"),
        F.col("length").alias("size_bytes"),
        working.alias("working_image_path"),
    )


def scan_errors(files: DataFrame, root: str) -> DataFrame:
    """``"<id>: <reason>"`` for every image file that could not be decoded."""
    bad = files.filter(F.coalesce(F.col("height"), F.lit(-1)) <= 0)
    return bad.select(F.concat_ws(": ", paths.relative_id(F.col("path"), root), F.lit(UNREADABLE)).alias("error"))


def with_capture(images: DataFrame, capture: DataFrame) -> DataFrame:
    """Attach ``taken_unix_ms, latitude, longitude`` by id; absent metadata stays null."""
    meta = capture.select("id", "taken_unix_ms", "latitude", "longitude")
    return images.join(meta, "id", "left")


def scan_report(files: DataFrame, extensions: list[str] | None = None, cache_marker: str = ".cache") -> DataFrame:
    """Files seen, image files, other files, readable images and errors, in one pass."""
    image = paths.is_image(F.col("path"), extensions, cache_marker)
    readable = image & (F.coalesce(F.col("height"), F.lit(-1)) > 0)
    return files.agg(
        F.count(F.lit(1)).alias("files_seen"),
        F.count_if(image).alias("images_found"),
        F.count_if(~image).alias("skipped_files"),
        F.count_if(readable).alias("images"),
        F.count_if(image & ~readable).alias("errors"),
    )


def working_sizes(images: DataFrame, edge: int = paths.WORKING_EDGE) -> DataFrame:
    width, height = paths.working_size(F.col("original_width"), F.col("original_height"), edge)
    return images.select("id", "original_width", "original_height", width.alias("width"), height.alias("height"))


def working_name_collisions(files: DataFrame) -> DataFrame:
    """Working-image names shared by several files (same stem and size in different folders)."""
    named = files.select(paths.working_name(F.col("path"), F.col("length")).alias("name"))
    return named.groupBy("name").agg(F.count(F.lit(1)).alias("files")).filter(F.col("files") > 1)


def pending(images: DataFrame, done: DataFrame, key: str = "id") -> DataFrame:
    """Rows whose working image (or verdict) does not exist yet."""
    return images.join(done.select(key), key, "left_anti")
