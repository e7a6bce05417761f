"""Difference hash and hue/saturation histogram.

Colour images are rows ``image_id, height, width, r, g, b`` with row-major planes.
All arithmetic is on whole numbers, so results do not depend on summation order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Size of the shrunken image, bins and ranges of the colour histogram.
HASH_ROWS, HASH_COLS = 8, 9
HUE_BINS, HUE_RANGE = 50, 180
SATURATION_BINS, SATURATION_RANGE = 60, 256
BINS = HUE_BINS * SATURATION_BINS


def dhash_bits(levels: Column) -> Column:
    """64-bit hash of 9x8 levels; bit ``row*8 + col`` is set where a cell is brighter than its right neighbour."""
    steps = HASH_COLS - 1

    def add(bits: Column, bit: Column) -> Column:
        left = (bit + F.floor(bit / steps)).cast("int")
        brighter = F.get(levels, left) > F.get(levels, left + 1)
        return bits.bitwiseOR(F.when(brighter, F.call_function("shiftleft", F.lit(1).cast("long"), bit)).otherwise(0))

    return F.aggregate(F.sequence(F.lit(0), F.lit(HASH_ROWS * steps - 1)), F.lit(0).cast("long"), add)


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def hue_saturation(r: Column, g: Column, b: Column) -> tuple[Column, Column]:
    """8-bit hue in [0, 180) and saturation in [0, 255], rounded half up."""
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    span = top - low

    def third(x: Column, y: Column, offset: int) -> Column:
        return F.floor((60 * (x - y) + span) / (2 * span)) + offset

    turned = F.when(top == r, third(g, b, 0)).when(top == g, third(b, r, 60)).otherwise(third(r, g, 120))
    hue = F.when(span == 0, F.lit(0)).otherwise(F.pmod(turned, F.lit(HUE_RANGE)))
    saturation = F.when(top == 0, F.lit(0)).otherwise(F.floor((510 * span + top) / (2 * top)))
    return hue.cast("int"), saturation.cast("int")


def scaled(n: Column, floor: Column, most: Column) -> Column:
    """A count between the smallest and the largest, in [0, 1]; 0 where all are equal."""
    return F.coalesce(F.try_divide(n - floor, most - floor), F.lit(0.0))


def scaled_histogram(bins: Column, counts: Column, least: Column, most: Column) -> Column:
    """All bins scaled to [0, 1] by the smallest and largest count; missing bins count 0.

    ``bins`` (ascending) and ``counts`` are parallel arrays of the non-empty bins, ``least`` and
    ``most`` the extremes of ``counts``. All should be plain columns.
    """
    floor = F.when(F.size(bins) < BINS, F.lit(0)).otherwise(least)

    def empty(bins: Column) -> Column:
        return F.array_repeat(F.lit(0.0), bins.cast("int"))

    def with_gap(n: Column, i: Column) -> Column:
        before = F.coalesce(F.get(bins, i - 1), F.lit(-1))
        return F.concat(
            empty(F.get(bins, i) - before - 1), F.array(scaled(n, floor, most))
        )

    tail = F.lit(BINS - 1) - F.element_at(bins, -1)
    return F.concat(F.flatten(F.transform(counts, with_gap)), empty(tail))


def moments(histogram: Column) -> Column:
    """``n, s, ss`` (size, sum, sum of squares) of a histogram."""
    add = lambda acc, x: acc + x
    return F.struct(
        F.size(histogram).cast("double").alias("n"),
        F.aggregate(histogram, F.lit(0.0), add).alias("s"),
        F.aggregate(F.transform(histogram, lambda x: x * x), F.lit(0.0), add).alias("ss"),
    )


def correlation(x: Column, y: Column, mx: Column, my: Column) -> Column:
    """Pearson correlation of two histograms with known moments; 1 when either is constant."""
    dot = F.aggregate(F.zip_with(x, y, lambda a, b: a * b), F.lit(0.0), lambda acc, v: acc + v)
    n = mx["n"]
    spread = (n * mx["ss"] - mx["s"] * mx["s"]) * (n * my["ss"] - my["s"] * my["s"])
    # The epsilon is that of a double: a smaller spread counts as constant.
    return F.when(spread <= 2.220446049250313e-16, 1.0).otherwise((n * dot - mx["s"] * my["s"]) / F.sqrt(spread))


def histogram_distance(corr: Column) -> Column:
    return 1 - F.greatest(F.lit(-1.0), F.least(F.lit(1.0), corr))


# Weights of colour and structure in the joint distance.
COLOUR_WEIGHT, HASH_WEIGHT, HASH_BITS = 0.4, 0.6, 64
FAR = 1.7976931348623157e308


def joint_distance(corr: Column, bits: Column, both_valid: Column) -> Column:
    near = COLOUR_WEIGHT * histogram_distance(corr) + HASH_WEIGHT * (bits / HASH_BITS)
    return F.when(both_valid, near).otherwise(F.lit(FAR))
