"""Path expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Image formats a scan accepts, the smaller set of the shipped scanner,
# sidecar formats, long edge of a working image.
IMAGE_EXTENSIONS = [".jpg", ".jpeg", ".png", ".heic", ".heif", ".webp", ".tiff", ".tif", ".bmp", ".gif"]
BASIC_EXTENSIONS = [".jpg", ".jpeg", ".png", ".webp"]
SIDECAR_EXTENSIONS = [".xmp", ".aae"]
WORKING_EDGE = 768


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """Last extension with its dot; a leading dot alone makes no extension."""
    return F.regexp_extract(file_name(path), r".(\.[^.]*)$", 1)


def stem(path: Column) -> Column:
    name = file_name(path)
    return F.substr(name, F.lit(1), F.length(name) - F.length(extension(path)))


def folder(path: Column) -> Column:
    return F.regexp_replace(path, r"/[^/]*$", "")


def relative_id(path: Column, root: str) -> Column:
    """Path below ``root`` with ``/`` separators."""
    base = root.rstrip("/") + "/"
    return F.when(F.startswith(path, F.lit(base)), F.substr(path, F.lit(len(base) + 1))).otherwise(path)


def is_image(path: Column, extensions: list[str] | None = None, cache_marker: str = ".cache") -> Column:
    """Accepted extension, and not inside the cache folder."""
    known = F.lower(extension(path)).isin(extensions or IMAGE_EXTENSIONS)
    return known & ~F.contains(path, F.lit(cache_marker))


def working_size(width: Column, height: Column, edge: int = WORKING_EDGE) -> tuple[Column, Column]:
    """Width and height with the long edge at most ``edge``; truncated, never enlarged."""
    longest = F.greatest(width, height)
    scale = F.when(longest > edge, F.lit(float(edge)) / longest).otherwise(F.lit(1.0))
    return (width * scale).cast("int"), (height * scale).cast("int")


def working_name(path: Column, size_bytes: Column) -> Column:
    return F.concat(stem(path), F.lit("_"), size_bytes.cast("string"), F.lit(".jpg"))
