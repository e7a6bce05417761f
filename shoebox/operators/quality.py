"""Sharpness, exposure and the quality verdict.

An image is one row: ``image_id, height, width, gray`` (row-major 0..255 levels,
null when unreadable). Pixels are expanded only inside the scan stage and are
summed before the shuffle, which then carries one small row per image.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Verdict reasons in reporting order with their labels.
REASONS = {"BLURRY": "Blurry", "UNDER_EXPOSED": "Underexposed", "OVER_EXPOSED": "Overexposed"}
UNREADABLE = "UNREADABLE"
UNREADABLE_LABEL = "Unreadable"
GRID = 3


@dataclass(frozen=True)
class QualityThresholds:
    """The default limits of the quality pass."""

    blur_threshold: float = 100.0
    low_bin_index: int = 15
    high_bin_index: int = 240
    cell_passing_score: float = 0.70
    min_passing_cells: int = 2
    underexposed_threshold: float = 0.30
    overexposed_threshold: float = 0.30


def luma(r: Column, g: Column, b: Column) -> Column:
    """8-bit gray level of a colour pixel (299/587/114 weights, rounded half up)."""
    return F.floor((r * 299 + g * 587 + b * 114 + 500) / 1000).cast("int")


def gray_images(colour: DataFrame) -> DataFrame:
    """Gray rows from planes ``r, g, b``."""
    gray = F.transform(F.arrays_zip("r", "g", "b"), lambda p: luma(p["r"], p["g"], p["b"]))
    return colour.select("image_id", "height", "width", gray.alias("gray"))


def shadow_weight(level: Column, limits: QualityThresholds) -> Column:
    low = F.lit(float(limits.low_bin_index))
    return F.when(level <= limits.low_bin_index, F.pow((low - level) / low, F.lit(2.0))).otherwise(0.0)


def highlight_weight(level: Column, limits: QualityThresholds) -> Column:
    high = float(limits.high_bin_index)
    over = (level - F.lit(high)) / F.lit(255.0 - high)
    return F.when(level >= limits.high_bin_index, F.pow(over, F.lit(2.0))).otherwise(0.0)


def verdict_inputs(limits: QualityThresholds) -> list[Column]:
    # Population variance from whole-number sums.
    variance = (F.col("_ll") - F.col("_l") * F.col("_l") / F.col("_n")) / F.col("_n")
    good = F.lit(0)
    for k in range(GRID * GRID):
        n = F.col(f"_n{k}")
        passes = (F.col(f"_s{k}") / n < limits.cell_passing_score) & (F.col(f"_h{k}") / n < limits.cell_passing_score)
        good = good + F.when((n > 0) & passes, 1).otherwise(0)
    under = F.when(good >= limits.min_passing_cells, 0.0).otherwise(F.col("raw_under"))
    return [
        (F.col("_n") > 0).alias("valid"),
        F.when(F.col("_n") > 0, variance).otherwise(0.0).alias("sharpness"),
        F.col("raw_under"),
        under.alias("under"),
        F.col("over"),
        good.alias("good_cells"),
    ]


def verdicts(measured: DataFrame, limits: QualityThresholds = QualityThresholds()) -> DataFrame:
    """Add ``reasons``, ``exposure_score`` and ``low_quality`` to ``metrics`` rows.

    An unreadable image is of low quality. The score is 0.5 when balanced, lower
    when dark and higher when bright.
    """
    valid = F.col("valid")
    reasons = F.array_compact(
        F.array(
            F.when(valid & (F.col("sharpness") < limits.blur_threshold), "BLURRY"),
            F.when(valid & (F.col("under") > limits.underexposed_threshold), "UNDER_EXPOSED"),
            F.when(valid & (F.col("over") > limits.overexposed_threshold), "OVER_EXPOSED"),
            F.when(~valid, UNREADABLE),
        )
    )
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.5 + 0.5 * (F.col("over") - F.col("under"))))
    return measured.withColumn("reasons", reasons).withColumns(
        {"exposure_score": F.when(valid, score), "low_quality": F.size("reasons") > 0}
    )


def flags(judged: DataFrame) -> DataFrame:
    """Flagged images only."""
    return judged.filter("low_quality").select("image_id", "reasons", "sharpness", "exposure_score")


def low_quality(judged: DataFrame, order: str = "image_id") -> DataFrame:
    """Ids of low-quality images in input order."""
    return judged.filter("low_quality").select("image_id").orderBy(order)


def summary(judged: DataFrame) -> DataFrame:
    return judged.agg(F.count_if("low_quality").alias("flagged"), F.count(F.lit(1)).alias("total"))


def reason_labels(reasons: Column) -> Column:
    """Display labels; an unknown reason is an error."""
    pairs = F.create_map(*[F.lit(x) for pair in (REASONS | {UNREADABLE: UNREADABLE_LABEL}).items() for x in pair])

    def label(reason: Column) -> Column:
        known = F.element_at(pairs, reason)
        return F.when(known.isNull(), F.raise_error(F.concat(F.lit("no label for this reason: "), reason))).otherwise(known)

    return F.transform(reasons, label)
