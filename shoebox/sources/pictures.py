"""From decoded pictures to one row of sums per image.

``read_pixels`` rows go through Arrow in small batches; a task holds a few pictures at a time.
Unreadable pictures stay as rows with null sums.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoebox.functions import kernels, paths
from shoebox.operators import features, quality
from shoebox.operators.junk import JunkRules

SUMS = (
    "image_id string, height int, width int, laplacian array<bigint>, levels array<bigint>, "
    "shrunk array<int>, bins array<int>, counts array<bigint>, least bigint, most bigint, "
    "flat_blocks bigint, blocks bigint, straight bigint, lines bigint"
)
_SUM_NAMES = [part.split()[0] for part in SUMS.split(", ")][3:]
# What each judgement needs of them.
QUALITY_SUMS, CONTRAST_SUMS, FEATURE_SUMS = ("laplacian", "levels"), ("levels",), ("shrunk", "bins", "counts", "least", "most")
COLOUR_SUMS, JUNK_SUMS = FEATURE_SUMS[1:], ("levels", "flat_blocks", "blocks", "straight", "lines")

# Rows of sums made at a time; with all sums a row takes about 70 KB at most.
SUMS_HELD = 256


def _pixels(row) -> np.ndarray | None:
    """Pixels by row, column and channel. ``data`` holds a decoder's bytes, or an array of one whole plane after another."""
    if row.height is None or row.height <= 0 or row.width <= 0 or row.data is None or not len(row.data):
        return None
    if isinstance(row.data, np.ndarray):
        return row.data.astype(np.uint8).reshape(row.channels, row.height, row.width).transpose(1, 2, 0)
    return np.frombuffer(row.data, np.uint8).reshape(row.height, row.width, row.channels)


class _Picture(NamedTuple):
    image_id: str | None
    height: int | None
    width: int | None
    channels: int | None
    data: np.ndarray | pa.Buffer | None


def _rows(batch: pa.RecordBatch) -> Iterator[_Picture]:
    for image_id, height, width, channels, data in zip(*batch.columns):
        if not data.is_valid:
            content = None
        elif isinstance(data, pa.ListScalar):
            content = data.values.to_numpy(zero_copy_only=False)
        else:
            content = data.as_buffer()
        yield _Picture(image_id.as_py(), height.as_py(), width.as_py(), channels.as_py(), content)


_ARROW = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "array<int>": pa.list_(pa.int32()), "array<bigint>": pa.list_(pa.int64())}


def _few(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows in batches of at most ``SUMS_HELD``: the sums of a small picture are far larger than its pixels."""
    for batch in batches:
        for start in range(0, batch.num_rows, SUMS_HELD):
            yield batch.slice(start, SUMS_HELD)


def _column(values: list, kind: pa.DataType) -> pa.Array:
    """One column of a batch; whole arrays are laid one after another, not copied number by number."""
    if not pa.types.is_list(kind):
        return pa.array(values, kind)
    there = [np.asarray(v) for v in values if v is not None]
    ends = np.cumsum([0, *(0 if v is None else len(v) for v in values)], dtype=np.int32)
    flat = pa.array(np.concatenate(there) if there else np.zeros(0, np.int64), kind.value_type)
    return pa.ListArray.from_arrays(pa.array(ends), flat, type=kind, mask=pa.array([v is None for v in values], pa.bool_()))


def _measured(bgr: np.ndarray, rules: JunkRules, wanted: set[str]) -> dict:
    """The ``SUMS`` columns among ``wanted``, and those that come with them."""
    out = {}
    gray = kernels.gray_of(bgr)
    if "laplacian" in wanted:
        out["laplacian"] = kernels.laplacian_sums(gray)
    if "levels" in wanted:
        out["levels"] = kernels.level_counts(gray)
    if "shrunk" in wanted:
        out["shrunk"] = kernels.shrunken(gray).astype(np.int32)
    if wanted & {"bins", "counts", "least", "most"}:
        bins, counts = kernels.colour_bins(bgr)
        out |= {"bins": bins.astype(np.int32), "counts": counts, "least": int(counts.min()), "most": int(counts.max())}
    if wanted & {"flat_blocks", "blocks"}:
        out["flat_blocks"], out["blocks"] = kernels.flat_blocks(gray, rules.block)
    if wanted & {"straight", "lines"}:
        out["straight"], out["lines"] = kernels.straight_lines(gray, rules.edge_step, rules.straight_share)
    return out


def picture_sums(pictures: DataFrame, root: str = "", rules: JunkRules = JunkRules(), wanted: Iterable[str] | None = None) -> DataFrame:
    """``read_pixels`` rows to ``SUMS`` rows keyed by image id; of the sums only those ``wanted`` (default: all) are made."""
    asked = set(_SUM_NAMES if wanted is None else wanted)
    if asked - set(_SUM_NAMES):
        raise ValueError(f"no such sums: {sorted(asked - set(_SUM_NAMES))}")
    schema = ", ".join(part for part in SUMS.split(", ") if part.split()[0] in {"image_id", "height", "width", *asked})
    kinds = {part.split()[0]: _ARROW[part.split()[1]] for part in schema.split(", ")}

    def one(row: _Picture) -> dict:
        bgr = _pixels(row)
        return {"image_id": row.image_id, "height": row.height, "width": row.width} | ({} if bgr is None else _measured(bgr, rules, asked))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _few(batches):
            rows = [one(row) for row in _rows(batch)]
            yield pa.RecordBatch.from_arrays([_column([row.get(name) for row in rows], kind) for name, kind in kinds.items()], names=list(kinds))

    keyed = pictures.select(
        paths.relative_id(F.col("path"), root).alias("image_id"), "height", "width", "channels", "data"
    )
    return keyed.mapInArrow(run, schema)


def _part(number: int) -> Column:
    """Histogram ``number`` of ``levels``: 0 for the whole image, then the grid cells."""
    return F.slice("levels", number * 256 + 1, 256)


def _weighted(first: int, last: int, weight: Callable[[Column], Column]) -> Callable[[int], Column]:
    """For the number of a histogram, the weighted sum of its levels ``first`` to ``last``; the others weigh nothing."""
    first, last = max(0, min(255, first)), max(0, min(255, last))
    weights = F.array(*[weight(F.lit(v)) for v in range(first, last + 1)])

    def total(number: int) -> Column:
        terms = F.zip_with(F.slice("levels", number * 256 + first + 1, last - first + 1), weights, lambda n, w: n * w)
        return F.aggregate(terms, F.lit(0.0), lambda acc, x: acc + x)

    return total


def _exposure(limits: quality.QualityThresholds) -> tuple[Callable[[int], Column], Callable[[int], Column]]:
    """Weighted sums of dark and of bright levels, by the number of the histogram."""
    dark = _weighted(0, limits.low_bin_index, lambda v: quality.shadow_weight(v, limits))
    bright = _weighted(limits.high_bin_index, 255, lambda v: quality.highlight_weight(v, limits))
    return dark, bright


def _size(number: int) -> Column:
    """Pixels in histogram ``number``; null where there is none. Cells leave out what does not divide."""
    sides = [F.col(side) if number == 0 else F.floor(F.col(side) / quality.GRID) for side in ("height", "width")]
    return F.when(F.col("levels").isNotNull(), sides[0].cast("long") * sides[1].cast("long"))


def from_planes(images: DataFrame) -> DataFrame:
    """Picture rows of images given as arrays: ``image_id, height, width`` and ``gray``, or ``r, g, b``."""
    colour = "gray" not in images.columns
    data = F.concat("b", "g", "r") if colour else F.col("gray")
    return images.select(F.col("image_id").cast("string").alias("path"), "height", "width", F.lit(3 if colour else 1).alias("channels"), data.alias("data"))


def levels(sums: DataFrame) -> DataFrame:
    """Intensity histogram rows: ``image_id, v, n``."""
    rows = sums.select("image_id", F.posexplode(_part(0)).alias("v", "n"))
    return rows.filter(F.col("n") > 0)


def cell_clipping(sums: DataFrame, limits: quality.QualityThresholds = quality.QualityThresholds()) -> DataFrame:
    """Clipping per image and grid cell: ``image_id, cell, under, over``."""
    dark, bright = _exposure(limits)
    cells = [
        F.struct(
            F.lit(k).alias("cell"),
            _size(k + 1).alias("n"),
            dark(k + 1).alias("under"),
            bright(k + 1).alias("over"),
        )
        for k in range(quality.GRID**2)
    ]
    rows = sums.select("image_id", F.inline(F.array(*cells))).filter(F.col("n") > 0)
    return rows.select("image_id", "cell", (F.col("under") / F.col("n")).alias("under"), (F.col("over") / F.col("n")).alias("over"))


def shrunken_levels(sums: DataFrame) -> DataFrame:
    """Area-averaged 9x8 gray image: ``image_id, ty, tx, level``."""
    rows = sums.select("image_id", F.posexplode("shrunk").alias("i", "level"))
    return rows.select("image_id", F.floor(F.col("i") / features.HASH_COLS).cast("int").alias("ty"), (F.col("i") % features.HASH_COLS).alias("tx"), "level")


def colour_counts(sums: DataFrame) -> DataFrame:
    """Non-empty histogram bins: ``image_id, h_bin, s_bin, n``."""
    rows = sums.select("image_id", F.inline(F.arrays_zip("bins", "counts")))
    h_bin = F.floor(F.col("bins") / features.SATURATION_BINS).cast("int")
    return rows.select("image_id", h_bin.alias("h_bin"), (F.col("bins") % features.SATURATION_BINS).alias("s_bin"), F.col("counts").alias("n"))


def scaled_bins(sums: DataFrame) -> DataFrame:
    """Non-empty bins of the scaled colour histogram: ``image_id, bin, level``; empty bins have level 0 and no row."""
    floor = F.when(F.size("bins") < features.BINS, F.lit(0)).otherwise(F.col("least"))
    rows = sums.select("image_id", "most", floor.alias("floor"), F.inline(F.arrays_zip("bins", "counts")))
    return rows.select("image_id", F.col("bins").alias("bin"), features.scaled(F.col("counts"), F.col("floor"), F.col("most")).alias("level"))


def junk_features(sums: DataFrame) -> DataFrame:
    """``image_id, flat_ratio, unique_ratio, straight_ratio`` of readable pictures.

    - flat_ratio: blocks of one single level among all blocks
    - unique_ratio: distinct levels per pixel
    - straight_ratio: rows and columns that are one long edge, among all borders
    """
    unique = F.size(F.filter(_part(0), lambda n: n > 0)).cast("double") / (F.col("height").cast("long") * F.col("width"))
    straight = F.when(F.col("lines") > 0, F.col("straight") / F.col("lines")).otherwise(0.0)
    return sums.filter(F.col("levels").isNotNull()).select(
        "image_id", (F.col("flat_blocks") / F.col("blocks")).alias("flat_ratio"), unique.alias("unique_ratio"), straight.alias("straight_ratio")
    )


def metrics(sums: DataFrame, limits: quality.QualityThresholds = quality.QualityThresholds()) -> DataFrame:
    """``image_id, valid, sharpness, raw_under, under, over, good_cells`` for every picture.

    With enough well exposed cells ``under`` is set to zero.
    """
    dark, bright = _exposure(limits)
    cells = {}
    for k in range(quality.GRID**2):
        cells |= {f"_s{k}": dark(k + 1), f"_h{k}": bright(k + 1), f"_n{k}": _size(k + 1)}
    wide = sums.withColumns(
        {
            "_n": F.coalesce(_size(0), F.lit(0)),
            "_l": F.col("laplacian")[0],
            "_ll": F.col("laplacian")[1],
            "raw_under": dark(0) / _size(0),
            "over": bright(0) / _size(0),
            **cells,
        }
    )
    return wide.select("image_id", *quality.verdict_inputs(limits))


def contrast(sums: DataFrame) -> DataFrame:
    """``image_id, contrast``: entropy of the gray histogram, 1 for an even spread over 256 levels."""
    n = _size(0)
    n_ln_n = F.aggregate(
        _part(0), F.lit(0.0), lambda acc, x: acc + F.when(x > 0, x * F.ln(x.cast("double"))).otherwise(0.0)
    )
    entropy = F.ln(n) - n_ln_n / n
    return sums.filter(F.col("levels").isNotNull()).select(
        "image_id", (entropy / F.ln(F.lit(256.0))).alias("contrast")
    )


def feature_rows(sums: DataFrame) -> DataFrame:
    """Feature rows ``image_id, dhash, histogram, valid``; unreadable pictures are not valid."""
    histogram = features.scaled_histogram(F.col("bins"), F.col("counts"), F.col("least"), F.col("most"))
    valid = F.col("shrunk").isNotNull()
    return sums.select(
        "image_id",
        F.when(valid, features.dhash_bits(F.col("shrunk"))).alias("dhash"),
        F.when(valid, histogram).alias("histogram"),
        valid.alias("valid"),
    )


def working_images(pictures: DataFrame, root: str, edge: int = paths.WORKING_EDGE) -> DataFrame:
    """Pictures scaled to the working size, as raw pixels: ``id, width, height, channels, data``.

    Write the result as a table; pictures already in it are left out beforehand with ``files.pending``.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.itertuples():
                small = kernels.bilinear(_pixels(row), row.new_width, row.new_height)
                out.append((row.id, row.new_width, row.new_height, row.channels, small.tobytes()))
            yield pd.DataFrame(out, columns=["id", "width", "height", "channels", "data"])

    width, height = paths.working_size(F.col("width"), F.col("height"), edge)
    readable = pictures.filter(F.col("height") > 0).select(
        paths.relative_id(F.col("path"), root).alias("id"),
        "width",
        "height",
        "channels",
        "data",
        F.greatest(width, F.lit(1)).alias("new_width"),
        F.greatest(height, F.lit(1)).alias("new_height"),
    )
    return readable.mapInPandas(run, "id string, width int, height int, channels int, data binary")
